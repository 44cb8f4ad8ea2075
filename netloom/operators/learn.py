"""Training, saving and applying the two stages with Spark ML."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from netloom.functions import constants as K
from netloom.operators import prepare as prep
from netloom.operators.scoring import passes_gate
from netloom.session import cut_lineage


def label_counts(df: DataFrame, label: str) -> dict:
    return {r[label]: r["count"] for r in df.groupBy(label).count().collect()}   # one row per class


def balanced_weights(df: DataFrame, label: str, weight: str | None = None, counts: dict | None = None) -> DataFrame:
    """Column ``train_weight``: balanced class weight times the sample weight."""
    counts = label_counts(df, label) if counts is None else counts
    total, classes = sum(counts.values()), len(counts)
    expr = F.lit(0.0)
    for value, count in counts.items():
        expr = F.when(F.col(label) == value, total / (classes * count)).otherwise(expr)
    return df.withColumn("train_weight", expr * (F.col(weight) if weight else F.lit(1.0)))


#: Rows of a task in training boosted trees, which keep whole rows in memory between passes (a forest keeps bins of features).
TREE_ROWS = 250_000


def stage1_model(df: DataFrame, features: list[str], target: str, kind: str = "forest", weight: str | None = None,
                 trees: int | None = None, depth: int | None = None, seed: int = 42) -> PipelineModel:
    """Binary gate: random forest (100 trees, depth 20) or boosted trees (150 rounds, depth 6, rate 0.1)."""
    counts = label_counts(df, target)
    rows = prep.assemble(balanced_weights(df, target, weight, counts), features)
    shared = dict(featuresCol="features", labelCol=target, weightCol="train_weight", seed=seed)
    if kind == "forest":
        learner = RandomForestClassifier(numTrees=trees or 100, maxDepth=depth or 20, **shared)
    else:
        learner = GBTClassifier(maxIter=trees or 150, maxDepth=depth or 6, stepSize=0.1, **shared)
    # the classes are counted already; without their number the learner would count them once more
    classes = {"ml_attr": {"type": "nominal", "num_vals": int(max(counts)) + 1}} if counts and None not in counts else {}
    given = rows.select("features", F.col(target).alias(target, metadata=classes), "train_weight")
    if kind != "forest" and (total := sum(counts.values())) > TREE_ROWS * df.sparkSession.sparkContext.defaultParallelism:
        given = given.repartition(-(-total // TREE_ROWS))        # files and their splits may hold any number of rows
    model = learner.fit(given)
    return PipelineModel([VectorAssembler(inputCols=features, outputCol="features"), model])


def attack_probability(model: PipelineModel, df: DataFrame, output: str = "p_attack") -> DataFrame:
    scored = model.transform(df)
    return scored.withColumn(output, vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction")


def stage2_model(df: DataFrame, features: list[str], index: str, classes: int, kind: str = "network",
                 hidden: tuple[int, ...] = (64, 32), iterations: int = 100, seed: int = 42) -> PipelineModel:
    """Multi-class model on clipped, scaled features with softened class weights.

    The logistic model takes the weights directly; the network has no weight
    column, so rows of rare classes are repeated by their (rounded) weight.
    """
    weights = {r[index]: r["weight"] for r in prep.class_weights(df, index).collect()}   # one row per class
    expr = F.lit(1.0)
    for label, value in weights.items():
        expr = F.when(F.col(index) == label, value).otherwise(expr)
    rows = prep.assemble(df.withColumn("train_weight", expr), features)
    if kind == "logistic":
        learner = LogisticRegression(featuresCol="features", labelCol=index, weightCol="train_weight",
                                     family="multinomial", maxIter=iterations)
    else:
        floor = min(weights.values())
        copies = F.greatest(F.lit(1), F.round(F.col("train_weight") / floor)).cast("int")
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
        learner = MultilayerPerceptronClassifier(featuresCol="features", labelCol=index, seed=seed,
                                                 layers=[len(features), *hidden, classes], maxIter=iterations)
    model = learner.fit(rows.select("features", index, "train_weight"))
    return PipelineModel([VectorAssembler(inputCols=features, outputCol="features"), model])


def class_probabilities(model: PipelineModel, df: DataFrame, output: str = "probabilities") -> DataFrame:
    return model.transform(df).withColumn(output, vector_to_array("probability")).drop(
        "features", "rawPrediction", "probability", "prediction")


def network_probabilities(df: DataFrame, features: list[str], layers: list[tuple[np.ndarray, np.ndarray]],
                          output: str = "probabilities") -> DataFrame:
    """Probabilities of an external dense network (ReLU, softmax), Arrow batch by batch.

    The weights are broadcast once; their size depends on the network only.
    """
    shared = df.sparkSession.sparkContext.broadcast(layers)

    @F.pandas_udf("array<double>")
    def forward(rows: pd.Series) -> pd.Series:
        x = np.stack(rows.to_numpy())
        for n, (weights, bias) in enumerate(shared.value):
            x = x @ weights + bias
            if n < len(shared.value) - 1:
                x = np.maximum(x, 0.0)
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return pd.Series(list(x / x.sum(axis=1, keepdims=True)))

    return df.withColumn(output, forward(F.array(*[F.col(f"`{f}`").cast("double") for f in features])))


class Layer(NamedTuple):
    """A node of a layer graph: ``kind`` is input, dense, norm, relu, add or softmax.

    Weights of dense: matrix (inputs x units) and bias or None; of norm: gamma, beta, mean, variance, epsilon.
    """

    name: str
    kind: str
    inputs: tuple[str, ...] = ()
    weights: tuple = ()


def residual_graph(weights: dict[str, tuple], blocks: tuple[str, ...] = ("residual_block_1", "residual_block_2")) -> list[Layer]:
    """The residual network of stage 2 from its layers' weights by name; dropout does nothing when scoring.

    A block is dense, norm, relu, dense, norm, added to its input (or to a projection of it), then relu.
    """
    out = [Layer("flow_features", "input"), Layer("input_dense", "dense", ("flow_features",), weights["input_dense"]),
           Layer("input_batch_norm", "norm", ("input_dense",), weights["input_batch_norm"]), Layer("input_relu", "relu", ("input_batch_norm",))]
    for block in blocks:
        last = start = out[-1].name
        for n in (1, 2):
            dense, norm = f"{block}_dense_{n}", f"{block}_batch_norm_{n}"
            out += [Layer(dense, "dense", (last,), weights[dense]), Layer(norm, "norm", (dense,), weights[norm])]
            last = norm
            if n == 1:
                out.append(Layer(f"{block}_relu_1", "relu", (norm,)))
                last = out[-1].name
        if f"{block}_projection" in weights:
            out.append(Layer(f"{block}_projection", "dense", (start,), (weights[f"{block}_projection"][0], None)))
            start = out[-1].name
        out += [Layer(f"{block}_add", "add", (last, start)), Layer(f"{block}_relu_2", "relu", (f"{block}_add",))]
    return out + [Layer("classification_dense", "dense", (out[-1].name,), weights["classification_dense"]),
                  Layer("classification_relu", "relu", ("classification_dense",)),
                  Layer("attack_class", "dense", ("classification_relu",), weights["attack_class"]),
                  Layer("probabilities", "softmax", ("attack_class",))]


def folded(graph: list[Layer]) -> list[Layer]:
    """The same function without norms: one that alone reads a dense layer becomes part of its weights."""
    readers: dict[str, int] = {}
    for layer in graph:
        for name in layer.inputs:
            readers[name] = readers.get(name, 0) + 1
    made, out = {}, []
    for layer in graph:
        before = made.get(layer.inputs[0]) if layer.inputs else None
        if layer.kind == "norm" and before is not None and before.kind == "dense" and readers[before.name] == 1:
            gamma, beta, mean, variance, epsilon = layer.weights
            scale = np.asarray(gamma) / np.sqrt(np.asarray(variance) + epsilon)
            matrix, bias = before.weights
            out.remove(before)
            layer = Layer(layer.name, "dense", before.inputs,
                          (np.asarray(matrix) * scale, ((0.0 if bias is None else np.asarray(bias)) - np.asarray(mean)) * scale + np.asarray(beta)))
        made[layer.name] = layer
        out.append(layer)
    return out


def evaluated(graph: list[Layer], x: np.ndarray) -> np.ndarray:
    """The last layer's values for the rows of ``x``."""
    values: dict[str, np.ndarray] = {}
    for layer in graph:
        given = [values[name] for name in layer.inputs]
        if layer.kind == "input":
            y = x
        elif layer.kind == "dense":
            y = given[0] @ layer.weights[0] + (0.0 if layer.weights[1] is None else layer.weights[1])
        elif layer.kind == "norm":
            gamma, beta, mean, variance, epsilon = layer.weights
            y = (given[0] - mean) / np.sqrt(np.asarray(variance) + epsilon) * gamma + beta
        elif layer.kind == "relu":
            y = np.maximum(given[0], 0.0)
        elif layer.kind == "add":
            y = sum(given)
        elif layer.kind == "softmax":
            y = np.exp(given[0] - given[0].max(axis=1, keepdims=True))
            y = y / y.sum(axis=1, keepdims=True)
        else:
            raise ValueError(f"no such layer: {layer.kind}")
        values[layer.name] = y
    return values[graph[-1].name]


def graph_probabilities(df: DataFrame, features: list[str], graph: list[Layer], output: str = "probabilities") -> DataFrame:
    """Probabilities of a network of branches and sums, Arrow batch by batch; its folded weights are broadcast once.

    Rows with a NULL feature get NULL, for the caller's error table.
    """
    shared = df.sparkSession.sparkContext.broadcast(folded(graph))

    @F.pandas_udf("array<double>")
    def forward(rows: pd.Series) -> pd.Series:
        return pd.Series(list(evaluated(shared.value, np.stack(rows.to_numpy()).astype(float))))

    numbers = [F.col(f"`{f}`").cast("double") for f in features]
    whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in numbers])
    given = F.array(*[F.coalesce(c, F.lit(0.0)) for c in numbers])
    return df.withColumn(output, F.when(whole, forward(given)))


# ---- training a network on all executors ----------------------------------------------------------


@dataclass(frozen=True)
class Training:
    """Settings of `train_network`; steps go over all training rows."""

    hidden: tuple[int, ...] = (64, 32)
    steps: int = 200
    rate: float = 0.02
    least_rate: float = 1e-6
    focal_gamma: float | None = None      # None: cross-entropy
    l2: float = 1e-5
    evaluate_every: int = 5
    patience: int = 8                     # evaluations without gain before it stops,
    rate_patience: int = 3                # and before the rate is halved
    seed: int = 42


def _layers(training: Training, inputs: int, classes: int) -> list[np.ndarray]:
    """He-normal weights and zero biases, as one list: matrix, bias, matrix, bias, ..."""
    rng, sizes, out = np.random.default_rng(training.seed), [inputs, *training.hidden, classes], []
    for a, b in zip(sizes[:-1], sizes[1:]):
        out += [rng.normal(0.0, np.sqrt(2.0 / a), (a, b)), np.zeros(b)]
    return out


def _forward(x: np.ndarray, weights: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Values of every layer, and probabilities."""
    values = [x]
    for n in range(0, len(weights), 2):
        z = values[-1] @ weights[n] + weights[n + 1]
        values.append(np.maximum(z, 0.0) if n < len(weights) - 2 else z)
    p = np.exp(values[-1] - values[-1].max(axis=1, keepdims=True))
    return values, p / p.sum(axis=1, keepdims=True)


def gradients(x: np.ndarray, y: np.ndarray, w: np.ndarray, weights: list[np.ndarray], gamma: float | None) -> tuple[float, list[np.ndarray]]:
    """Weighted loss of some rows and its gradient; focal loss weighs a row by (1 - p) ** gamma."""
    values, p = _forward(x, weights)
    rows, right = np.arange(len(y)), np.clip(p[np.arange(len(y)), y], 1e-12, 1.0)
    loss, slope = -np.log(right), np.ones(len(y))
    if gamma is not None:
        away = 1.0 - right
        slope = away ** gamma - gamma * away ** np.maximum(gamma - 1.0, 0.0) * right * np.log(right)
        loss = away ** gamma * loss
    delta = p.copy()
    delta[rows, y] -= 1.0
    delta *= (slope * w)[:, None]
    out: list[np.ndarray] = []
    for n in range(len(weights) - 2, -1, -2):
        out[:0] = [values[n // 2].T @ delta, delta.sum(axis=0)]
        if n:
            delta = (delta @ weights[n].T) * (values[n // 2] > 0)
    return float((loss * w).sum()), out


#: Rows whose layers are worked out at once; their values fit a core's cache.
PIECE = 2_000


def _blocks(batches):
    """(domain, features, labels, weights) of the rows of each Arrow batch and domain, the numbers as bytes."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
            domains = batch.column("domain").to_pylist()
            for domain in dict.fromkeys(domains):
                own = np.fromiter((d == domain for d in domains), bool, len(domains))
                yield {"domain": domain, "x": x[own].tobytes(), "y": y[own].tobytes(), "w": w[own].tobytes()}


def _arrays(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y = np.frombuffer(block["y"], np.int64)
    return np.frombuffer(block["x"]).reshape(len(y), -1), y, np.frombuffer(block["w"])


def _blocked(rows: DataFrame) -> RDD:
    """Rows packed once in blocks of an Arrow batch, kept while training reads them again and again."""
    def run(batches):
        for made in _blocks(batches):
            yield pa.RecordBatch.from_pydict({"domain": pa.array([made["domain"]], pa.string()), **{
                name: pa.array([made[name]], pa.binary()) for name in "xyw"}})

    packed = rows.mapInArrow(run, "domain string, x binary, y binary, w binary")
    return packed.rdd.map(lambda r: r.asDict()).persist(StorageLevel.MEMORY_AND_DISK)


def _plus(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def _summed(blocks: RDD, weights, gamma: float | None) -> tuple[float, float, np.ndarray]:
    """Loss, weight and gradient of all rows: a task adds up its blocks, and where tasks are many, others add up theirs."""
    def task(given):
        total = None
        for block in given:
            x, y, w = _arrays(block)
            for at in range(0, len(y), PIECE):
                some = slice(at, at + PIECE)
                loss, grads = gradients(x[some], y[some], w[some], weights.value, gamma)
                part = loss, float(w[some].sum()), np.concatenate([g.ravel() for g in grads])
                total = part if total is None else _plus(total, part)
        if total is not None:
            yield total

    parts = blocks.mapPartitions(task)
    return parts.treeReduce(_plus) if blocks.getNumPartitions() > 64 else reduce(_plus, parts.collect())


def _confusion(blocks: RDD, weights) -> list[dict]:
    """(domain, truth, predicted, count), counted."""
    def task(given):
        counts: dict = {}
        for block in given:
            x, y, _ = _arrays(block)
            pairs, times = np.unique(np.stack([y, _forward(x, weights.value)[1].argmax(axis=1)]), axis=1, return_counts=True)
            for truth, predicted, n in zip(*pairs.tolist(), times.tolist()):
                counts[block["domain"], truth, predicted] = counts.get((block["domain"], truth, predicted), 0) + n
        return counts.items()

    found = blocks.mapPartitions(task).reduceByKey(lambda a, b: a + b).collect()      # a row for each domain and pair of classes
    return [{"domain": d, "truth": t, "predicted": p, "count": n} for (d, t, p), n in found]


def _weakest_f1(counts: list) -> float:
    """The smaller macro F1 of the domains, over the classes a domain has."""
    scores = []
    for domain in {r["domain"] for r in counts}:
        own = [r for r in counts if r["domain"] == domain]
        f1 = []
        for label in {r["truth"] for r in own}:
            hit = sum(r["count"] for r in own if r["truth"] == label == r["predicted"])
            all_ = sum(r["count"] * ((r["truth"] == label) + (r["predicted"] == label)) for r in own)
            f1.append(2 * hit / all_)
        scores.append(sum(f1) / len(f1))
    return min(scores, default=0.0)


def train_network(train: DataFrame, validation: DataFrame, features: list[str], index: str, classes: int, weight: str | None = None,
                  domain: str | None = None, training: Training = Training()) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[dict]]:
    """Layers of a dense network (for `network_probabilities`) and the history of its training.

    A step is one pass over the training rows, packed in blocks before: tasks add up the blocks' gradients, which are summed
    in a tree, and the driver takes one Adam step of the size of the network. Rows count by class weight times ``weight``;
    none is repeated. Training is judged on the smaller macro F1 of the validation domains: without gain the rate is
    halved, then training stops, and the best weights are kept.
    """
    spark = train.sparkSession
    weights_of = {r[index]: r["weight"] for r in prep.class_weights(train, index).collect()}   # one row per class
    each = F.lit(1.0)
    for label, value in weights_of.items():
        each = F.when(F.col(index) == label, value).otherwise(each)

    def prepared(df: DataFrame) -> RDD:
        return _blocked(df.select(
            F.array(*[F.col(f"`{f}`").cast("double") for f in features]).alias("x"), F.col(index).cast("bigint").alias("y"),
            (each * (F.col(weight) if weight else F.lit(1.0))).cast("double").alias("w"),
            (F.col(domain).cast("string") if domain else F.lit("all")).alias("domain")))

    rows, held = prepared(train), prepared(validation)
    weights = _layers(training, len(features), classes)
    shapes = [w.shape for w in weights]
    moment, square = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    rate, best, kept, history, since, since_rate = training.rate, -1.0, weights, [], 0, 0
    for step in range(1, training.steps + 1):
        shared = spark.sparkContext.broadcast(weights)
        loss, mass, flat = _summed(rows, shared, training.focal_gamma)
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        grads = [g.reshape(s) / mass + (training.l2 * w if w.ndim == 2 else 0.0)
                 for g, s, w in zip(np.split(flat, cuts), shapes, weights)]
        moment = [0.9 * m + 0.1 * g for m, g in zip(moment, grads)]
        square = [0.999 * v + 0.001 * g * g for v, g in zip(square, grads)]
        weights = [w - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-7)
                   for w, m, v in zip(weights, moment, square)]
        shared.unpersist()
        if step % training.evaluate_every and step < training.steps:
            continue
        shared = spark.sparkContext.broadcast(weights)
        score = _weakest_f1(_confusion(held, shared))
        shared.unpersist()
        history.append({"step": step, "loss": loss / mass, "macro_f1": score, "rate": rate})
        if score > best:
            best, kept, since, since_rate = score, weights, 0, 0
            continue
        since, since_rate = since + 1, since_rate + 1
        if since_rate >= training.rate_patience:
            rate, since_rate = max(rate / 2, training.least_rate), 0
        if since >= training.patience:
            break
    rows.unpersist()
    held.unpersist()
    return list(zip(kept[::2], kept[1::2])), history


def cascade(df: DataFrame, stage1: PipelineModel, stage2: PipelineModel, bounds: dict, stats: dict,
            classes: int, gate: float = K.STAGE1_THRESHOLD) -> DataFrame:
    """Only rows above the gate reach stage 2; the others get no probabilities.

    Stage 1 is computed once, for both branches. Rows without a probability stay,
    with NULL probabilities, for the caller's error table.
    """
    scored = cut_lineage(attack_probability(stage1, df))
    low = scored.filter(F.coalesce(F.col("p_attack") < gate, F.lit(True))).withColumn(
        "probabilities", F.when(F.col("p_attack").isNotNull(), F.array_repeat(F.lit(0.0), classes)))
    names = list(bounds)
    raw = scored.filter(passes_gate("p_attack", gate)).withColumns({f"_{c}": F.col(f"`{c}`") for c in names})
    high = class_probabilities(stage2, prep.apply_scale(prep.apply_clip(raw, bounds), stats))
    # Stage 2 saw clipped and scaled values; the log keeps the raw ones.
    high = high.withColumns({c: F.col(f"_{c}") for c in names}).drop(*[f"_{c}" for c in names])
    return low.unionByName(high)


# ---- bundles ------------------------------------------------------------------------

def save_bundle(spark: SparkSession, path: str, stage1: PipelineModel, stage2: PipelineModel, metadata: dict) -> None:
    stage1.write().overwrite().save(f"{path}/stage1")
    stage2.write().overwrite().save(f"{path}/stage2")
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.mode(
        "overwrite").text(f"{path}/metadata")


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, PipelineModel, dict]:
    """Both stages and the metadata; inconsistent bundles are refused."""
    stage1, stage2 = PipelineModel.load(f"{path}/stage1"), PipelineModel.load(f"{path}/stage2")
    metadata = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    problems = bundle_problems(stage1, stage2, metadata)
    if problems:
        raise ValueError("; ".join(problems))
    return stage1, stage2, metadata


def bundle_problems(stage1: PipelineModel, stage2: PipelineModel, metadata: dict) -> list[str]:
    out = []
    gate, classes = metadata.get("stage1_threshold"), metadata.get("classes", [])
    if gate is None or not 0 <= gate <= 1:
        out.append("stage 1 threshold must be between 0 and 1")
    if stage1.stages[-1].numClasses != 2:
        out.append("stage 1 must have classes 0 and 1")
    for name, model in (("stage1_features", stage1), ("stage2_features", stage2)):
        listed = metadata.get(name, [])
        if len(listed) != len(set(listed)):
            out.append(f"{name} contains duplicates")
        if list(model.stages[0].getInputCols()) != listed:
            out.append(f"{name} differ from the model's order")
    if stage2.stages[-1].numClasses != len(classes):
        out.append("stage 2 classes differ from the encoder")
    focused = set(K.OUTPUT_CLASSES)
    if set(classes) not in (focused, set(K.SOURCE_CLASSES)):
        out.append("stage 2 labels differ from the 7- and 8-class schemas")
    for part in ("clip_bounds", "scale_statistics"):
        if set(metadata.get(part, {})) != set(metadata.get("stage2_features", [])):
            out.append(f"{part} do not cover the stage 2 features")
    return out
