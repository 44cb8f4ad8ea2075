"""Radix selection, cut rows, dyadic labelling, merging profiles, continued batches and networks against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import campaigns as camp, continued, learn, prepare as prep, sketches
from netloom.operators.features import snapshots
from netloom.operators.flows import FlowConfig
from test_flows import frame, traffic


def test_radix_percentiles_on_hostile_values(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, 1.0, float(np.nextafter(1.0, 2.0))] + [7.0] * 400
    values += [rng.choice([1e-310, 3.5, -3.5, 1e300]) for _ in range(300)] + [rng.gauss(0, 1e-9) for _ in range(200)] + [1e18]
    other = [float(i) for i in range(len(values) - 1)] + [None]
    df = spark.createDataFrame(list(zip(values, other)), "x double, y double").repartition(4)
    percents = (0.0, 0.5, 37.0, 50.0, 99.5, 100.0)
    got = {(r["column"], r["percent"]): r["bound"] for r in prep.exact_percentiles(df, ["x", "y"], percents).collect()}
    for p in percents:
        assert got["x", p] == pytest.approx(np.percentile(values, p), rel=1e-12, abs=0.0 if p in (0.0, 100.0) else 1e-320)
        assert got["y", p] == pytest.approx(np.percentile(other[:-1], p), rel=1e-12)
    ends = spark.createDataFrame([(float("inf"),), (float("-inf"),), (2.0,)], "x double")
    assert prep.exact_percentiles(ends, ["x"], (50.0,)).first()["bound"] == 2.0


def md5_order(rows, seed):
    return sorted(rows, key=lambda r: (hashlib.md5(f"{seed}|{r}".encode()).hexdigest(), r))


def test_splits_are_cuts_of_the_md5_order(spark):
    rng = random.Random(2)
    label = {i: rng.choice(["a"] * 30 + ["b"] * 3 + ["c", None]) for i in range(900)}
    df = spark.createDataFrame(list(label.items()), "id long, label string").repartition(5)
    got = {r["id"]: r["split"] for r in prep.stratified_split(df, "label", ["id"], 80, 10).collect()}
    assert len(got) == 900
    for name in set(label.values()):
        own = md5_order([i for i, x in label.items() if x == name], 42)
        n = len(own)
        for place, i in enumerate(own, 1):
            assert got[i] == ("train" if place * 100 <= n * 80 else "validation" if place * 100 <= n * 90 else "test")
    kept = {r["id"] for r in prep.balanced_sample(df, "label", ["id"], 300, keep=40, floor=50).collect()}
    want = set()
    for name in set(label.values()):
        own = md5_order([i for i, x in label.items() if x == name], 42)
        n = len(own)
        want |= set(own[:n if n <= 40 else min(n, max(50, 300 * n // 900))])
    assert kept == want
    assert prep.balanced_sample(df, "label", ["id"], 900).count() == 900
    assert prep.stratified_split(df.limit(0), "label", ["id"], 80, 10).count() == 0


def test_a_split_shuffles_no_whole_row(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 3).alias("label"), F.lit("wide" * 50).alias("wide"))
    plan = prep.stratified_split(df, "label", ["id"], 80, 10)._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning" not in plan.split("== Physical Plan ==")[1]


def test_campaigns_of_any_length(spark):
    rng = random.Random(3)
    hosts = ["a", "b", "c"]
    spans = []
    for i in range(120):
        start, length = rng.randrange(10 ** 13), rng.choice([0, 1, 999, 10 ** 6, 10 ** 9, 3 * 10 ** 12])
        spans.append((f"c{i:03d}", *rng.sample(hosts, 2), rng.choice([None, "TCP"]), start, start + length, f"K{i % 4}"))
    spans.append(("bad", "a", "b", None, 10, 5, "K0"))
    at = [(n, rng.choice([s[4], s[5], rng.randrange(10 ** 13)]), *rng.sample(hosts, 2), rng.choice(["TCP", "UDP"]))
          for n in range(500) for s in [rng.choice(spans)]]
    campaigns = spark.createDataFrame(spans, "campaign_id string, source_ip string, target_ip string, protocol string, "
                                             "started_us long, ended_us long, class_label string")
    rows = spark.createDataFrame(at, "no long, t long, source_ip string, destination_ip string, protocol string")
    got = {r["no"]: r["campaign_id"] for r in camp.label_snapshots(rows, campaigns, ["no"], "t").collect()}
    assert len(got) == 500
    hits = 0
    for no, t, a, b, protocol in at:
        fits = sorted((s[4], s[0]) for s in spans if s[4] <= t <= s[5] and {s[1], s[2]} == {a, b} and s[3] in (None, protocol))
        assert got[no] == (fits[0][1] if fits else None)
        hits += bool(fits)
    assert hits > 100
    assert camp.label_snapshots(rows, campaigns.limit(0), ["no"], "t").where("campaign_id is not null").count() == 0


def test_daily_profiles_merge(spark):
    rng = random.Random(4)
    rows = [(i % 7, rng.gauss(50, 9) if i % 5 else None, f"v{rng.randrange(3000)}") for i in range(20_000)] + [(3, float("inf"), None)]
    df = spark.createDataFrame(rows, "day int, x double, s string").repartition(4)
    daily = sketches.daily_profile(df, "day", ["x", "s"])
    some = {r["column"]: r for r in sketches.merged_profile(daily.where("day in (1, 3, 6)")).collect()}
    own = [r for r in rows if r[0] in (1, 3, 6)]
    xs = sorted(r[1] for r in own if r[1] is not None and r[1] != float("inf"))
    assert (some["x"]["rows"], some["x"]["null_count"], some["x"]["infinities"]) == (len(own), sum(r[1] is None for r in own), 1)
    for q, f in zip(some["x"]["quantiles"], (0.25, 0.5, 0.75)):
        assert abs(sum(x <= q for x in xs) / len(xs) - f) < sketches.RANK_ERROR
    exact = len({r[2] for r in own if r[2]})
    assert abs(some["s"]["about_unique"] - exact) < sketches.DISTINCT_ERROR * exact and some["s"]["quantiles"] is None


def test_continued_batches_equal_one_run(spark, tmp_path):
    rows = traffic(9, 900, 5)
    config = FlowConfig(inactivity_us=1_500_000, emit_after_us=60_000, emit_packets=4)
    df, whole = frame(spark, rows), None
    state = continued.no_state(df)
    for n in range(4):
        made = continued.batch_rows(df.filter(F.floor(F.col("seq") / 225) == n), state, config)
        made.write.parquet(str(tmp_path / str(n)))
        made = spark.read.parquet(str(tmp_path / str(n)))
        state, part = continued.open_after(made), continued.snapshots_of(made)
        whole = part if whole is None else whole.unionByName(part)
    whole = whole.unionByName(continued.flushed(state))
    got = {(r["flow_seq"], r["last_seq"]): r.asDict() for r in whole.collect()}
    want = {(r["flow_seq"], r["last_seq"]): r.asDict() for r in snapshots(df, config).collect()}
    assert set(got) == set(want) and len(want) > 200
    for key, row in want.items():
        for name, value in row.items():
            assert got[key][name] == (pytest.approx(value, rel=1e-12) if isinstance(value, float) else value), (key, name)


# ---- networks ------------------------------------------------------------------------------------


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(5)
    x, y, w = rng.normal(size=(20, 3)), rng.integers(0, 3, 20), rng.random(20) + 0.1
    for gamma in (None, 2.0):
        weights = learn._layers(learn.Training(hidden=(4,)), 3, 3)
        weights[1] += 0.1
        _, grads = learn.gradients(x, y, w, weights, gamma)
        for layer, grad in zip(weights, grads):
            for at in list(np.ndindex(layer.shape))[::3]:
                kept, ends = layer[at], []
                for step in (1e-6, -1e-6):
                    layer[at] = kept + step
                    ends.append(learn.gradients(x, y, w, weights, gamma)[0])
                layer[at] = kept
                assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(grad[at], rel=1e-4, abs=1e-6)


def residual_weights(rng):
    dense = lambda a, b: (rng.normal(size=(a, b)), rng.normal(size=b))
    norm = lambda n: (rng.random(n) + 0.5, rng.normal(size=n), rng.normal(size=n), rng.random(n) + 0.2, 1e-3)
    out = {"input_dense": dense(5, 8), "input_batch_norm": norm(8), "classification_dense": dense(4, 6), "attack_class": dense(6, 7),
           "residual_block_2_projection": (rng.normal(size=(8, 4)),)}
    for block, a, b in ((1, 8, 8), (2, 8, 4)):
        out |= {f"residual_block_{block}_dense_1": dense(a, b), f"residual_block_{block}_batch_norm_1": norm(b),
                f"residual_block_{block}_dense_2": dense(b, b), f"residual_block_{block}_batch_norm_2": norm(b)}
    return out


def test_residual_network_equals_a_plain_evaluation(spark):
    rng = np.random.default_rng(6)
    w = residual_weights(rng)
    x = rng.normal(size=(50, 5))

    def norm(z, name):
        gamma, beta, mean, variance, epsilon = w[name]
        return (z - mean) / np.sqrt(variance + epsilon) * gamma + beta

    z = np.maximum(norm(x @ w["input_dense"][0] + w["input_dense"][1], "input_batch_norm"), 0)
    for block in ("residual_block_1", "residual_block_2"):
        start = z @ w[f"{block}_projection"][0] if f"{block}_projection" in w else z
        h = np.maximum(norm(z @ w[f"{block}_dense_1"][0] + w[f"{block}_dense_1"][1], f"{block}_batch_norm_1"), 0)
        z = np.maximum(norm(h @ w[f"{block}_dense_2"][0] + w[f"{block}_dense_2"][1], f"{block}_batch_norm_2") + start, 0)
    z = np.maximum(z @ w["classification_dense"][0] + w["classification_dense"][1], 0)
    z = z @ w["attack_class"][0] + w["attack_class"][1]
    want = np.exp(z - z.max(axis=1, keepdims=True))
    want /= want.sum(axis=1, keepdims=True)
    graph = learn.residual_graph(w)
    assert "norm" not in {layer.kind for layer in learn.folded(graph)}
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)] + [(50, None, 1.0, 1.0, 1.0, 1.0)],
                               "i long, a double, b double, c double, d double, e double").repartition(3)
    got = {r["i"]: r["probabilities"] for r in learn.graph_probabilities(df, list("abcde"), graph).collect()}
    assert got[50] is None
    assert np.allclose([got[i] for i in range(50)], want, atol=1e-9)


def test_training_stops_and_keeps_the_best(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 0] > 1.6)
    df = spark.createDataFrame([(float(a), float(b), int(c), ["m", "n"][i % 2]) for i, ((a, b), c) in enumerate(zip(x, y))],
                               "a double, b double, y int, domain string").repartition(4)
    settings = learn.Training(hidden=(16,), steps=80, rate=0.05, evaluate_every=4, patience=3, rate_patience=1)
    layers, history = learn.train_network(df, df, ["a", "b"], "y", 3, None, "domain", settings)
    best = max(h["macro_f1"] for h in history)
    assert best > 0.8 and history[-1]["rate"] < 0.05
    guess = learn.network_probabilities(df, ["a", "b"], layers).select(
        "domain", F.col("y").alias("truth"), (F.array_position("probabilities", F.array_max("probabilities")) - 1).alias("predicted"))
    assert learn._weakest_f1(guess.groupBy("domain", "truth", "predicted").count().collect()) == pytest.approx(best)
