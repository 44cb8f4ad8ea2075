"""Classification metrics. One pass counts (truth, prediction); the rest works on
those counts, whose number depends on the classes only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from netloom.functions import constants as K
from netloom.functions.exprs import f1, ratio
from netloom.operators.scoring import attack_mask


def confusion(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("rows"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str, classes: list[str]) -> DataFrame:
    """Every (true class, predicted class) cell with zeros, and the row-normalised share."""
    labels = F.array(*map(F.lit, classes))
    grid = df.sparkSession.range(1).select(F.explode(labels).alias("truth")).select(
        "truth", F.explode(labels).alias("predicted"))
    cells = grid.join(confusion(df, truth, predicted), ["truth", "predicted"], "left").select(
        "truth", "predicted", F.coalesce("rows", F.lit(0)).alias("rows"))
    total = F.sum("rows").over(Window.partitionBy("truth"))
    return cells.withColumn("share", ratio(F.col("rows"), total))


def class_counts(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp / predicted / support per class from confusion counts; labels = truth ∪ prediction."""
    by = by or []
    sides = F.array(
        F.struct(F.col("truth").alias("class"), F.col("rows").alias("support"), F.lit(0).cast("bigint").alias("called"),
                 F.when(F.col("truth") == F.col("predicted"), F.col("rows")).otherwise(0).alias("tp")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("support"),
                 F.col("rows").alias("called"), F.lit(0).cast("bigint").alias("tp")),
    )
    return cells.select(*by, F.inline(sides)).groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("tp").alias("tp"))


def class_report(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """precision, recall, f1 and support per class; 0 where undefined."""
    by = by or []
    counts = class_counts(confusion(df, truth, predicted, by), by)
    tp, called, support = F.col("tp"), F.col("called"), F.col("support")
    return counts.select(
        *by, "class", ratio(tp, called).alias("precision"), ratio(tp, support).alias("recall"),
        f1(tp, called - tp, support - tp).alias("f1"), "support", "tp")


def summary_report(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """accuracy, macro and weighted precision / recall / f1, and the macro-F1 gate."""
    by = by or []
    report = class_report(df, truth, predicted, by)

    def weighted(name: str) -> Column:
        return (F.sum(F.col(name) * F.col("support")) / F.sum("support")).alias(f"weighted_{name}")

    out = report.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.sum("support").alias("rows"),
        *[F.avg(name).alias(f"macro_{name}") for name in ("precision", "recall", "f1")],
        *[weighted(name) for name in ("precision", "recall", "f1")])
    return out.withColumn("passes_gate", F.col("macro_f1") >= K.MACRO_F1_GATE)


def report_long(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """The evaluation report in long form (class, metric, value)."""
    report = class_report(df, truth, predicted)
    total = summary_report(df, truth, predicted)
    names = ["precision", "recall", "f1", "support"]
    per_class = report.select("class", F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])))
    overall = total.select(F.lit("(all)").alias("class"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
        for n in total.columns if n != "passes_gate"])))
    return per_class.unionByName(overall)


def binary_metrics(df: DataFrame, truth_attack: Column, predicted_attack: Column, by: list[str] | None = None) -> DataFrame:
    """Attack-vs-benign precision, recall, F1, false alarms and their rate per 1000 benign."""
    counts = df.groupBy(*(by or [])).agg(
        F.count_if(truth_attack & predicted_attack).alias("tp"),
        F.count_if(~truth_attack & predicted_attack).alias("false_positives"),
        F.count_if(truth_attack & ~predicted_attack).alias("fn"),
        F.count_if(~truth_attack).alias("benign_rows"))
    tp, fp, fn = F.col("tp"), F.col("false_positives"), F.col("fn")
    return counts.select(
        *(by or []), ratio(tp, tp + fp).alias("attack_precision"), ratio(tp, tp + fn).alias("attack_recall"),
        f1(tp, fp, fn).alias("attack_f1"), "false_positives", "benign_rows",
        ratio(fp, F.col("benign_rows")).alias("false_positive_rate"),
        (ratio(fp, F.col("benign_rows")) * 1000).alias("false_alarms_per_1000"))


def thresholded_metrics(df: DataFrame, truth_attack: Column, p_attack: str, threshold: float) -> DataFrame:
    """Accuracy, precision, recall, macro F1 of p >= threshold (here >=, the gate uses <)."""
    called = F.col(p_attack) >= threshold
    counts = df.agg(
        F.count_if(truth_attack & called).alias("tp"), F.count_if(~truth_attack & called).alias("fp"),
        F.count_if(truth_attack & ~called).alias("fn"), F.count_if(~truth_attack & ~called).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counts.select(
        F.lit(threshold).alias("threshold"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ((f1(tp, fp, fn) + f1(tn, fn, fp)) / 2).alias("macro_f1"))


def domain_threshold_scores(df: DataFrame, truth: str, predicted: str, confidence: str,
                            grid: list[float] = K.THRESHOLD_GRID, domain: str = "domain") -> DataFrame:
    """Binary attack F1 per (threshold, domain): all thresholds counted in one pass."""
    attack = F.col(truth) != "Benign"
    sums = []
    for n, limit in enumerate(grid):
        called = attack_mask(predicted, confidence, limit)
        sums += [F.count_if(attack & called).alias(f"tp_{n}"), F.count_if(~attack & called).alias(f"fp_{n}"),
                 F.count_if(attack & ~called).alias(f"fn_{n}")]
    counts = df.groupBy(domain).agg(*sums)
    return counts.select(domain, F.inline(F.array(*[
        F.struct(F.lit(limit).alias("threshold"),
                 f1(F.col(f"tp_{n}"), F.col(f"fp_{n}"), F.col(f"fn_{n}")).alias("score"))
        for n, limit in enumerate(grid)])))


def tune_threshold(df: DataFrame, truth: str, predicted: str, confidence: str,
                   grid: list[float] = K.THRESHOLD_GRID, domain: str = "domain") -> DataFrame:
    """Worst domain decides; the lowest threshold wins ties."""
    if not grid:
        raise ValueError("threshold grid is empty")
    worst = domain_threshold_scores(df, truth, predicted, confidence, grid, domain).groupBy("threshold").agg(
        F.min("score").alias("validation_score"))
    return worst.orderBy(F.desc("validation_score"), F.asc("threshold")).limit(1)


def domain_macro_f1(df: DataFrame, truth: str, predicted: str, labels: list[str] | None = None,
                    domain: str = "domain") -> DataFrame:
    """Macro F1 per domain, over truth ∪ prediction or a fixed label list."""
    report = class_report(df, truth, predicted, [domain])
    if labels is None:
        return report.groupBy(domain).agg(F.avg("f1").alias("macro_f1"))
    known = F.when(F.col("class").isin(labels), F.col("f1"))
    return report.groupBy(domain).agg((F.coalesce(F.sum(known), F.lit(0.0)) / len(labels)).alias("macro_f1"))


def domain_partition_problems(df: DataFrame, expected: list[str], domain: str = "domain") -> DataFrame:
    """Rows without a domain, unknown domains, and expected domains without rows."""
    counts = df.groupBy(F.col(domain).alias("domain")).agg(F.count("*").alias("rows"))
    wanted = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, expected))).alias("domain"))
    outside = counts.filter(F.col("domain").isNull() | ~F.col("domain").isin(expected)).select(
        "domain", F.lit("outside").alias("problem"), "rows")
    empty = wanted.join(counts, "domain", "left_anti").select(
        "domain", F.lit("empty").alias("problem"), F.lit(0).cast("bigint").alias("rows"))
    return outside.unionByName(empty)


def select_model(metrics: DataFrame, model: str, own_f1: str, cic_f1: str) -> DataFrame:
    """The model with the best worst score over its domains."""
    score = F.least(F.col(own_f1), F.coalesce(F.col(cic_f1), F.col(own_f1)))
    return metrics.agg(F.max_by(model, score).alias("model"), F.max(score).alias("score"))


def connection_rollup(df: DataFrame, connection: list[str], order: str, alert: Column, verdict: str) -> DataFrame:
    """Per connection: snapshots, any alert, early (first) and mature (last) verdict."""
    return df.groupBy(*connection).agg(
        F.count("*").alias("snapshots"), F.max(alert.cast("int")).alias("any_alert"),
        F.min_by(verdict, order).alias("early"), F.max_by(verdict, order).alias("mature"))


def throughput(df: DataFrame, confidence: str) -> DataFrame:
    """Scored rows and mean top probability (seconds come from the job's clock)."""
    return df.agg(F.count("*").alias("rows"), F.avg(confidence).alias("mean_confidence"))


def label_collisions(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Identical feature vectors that carry different labels."""
    return df.groupBy(*features).agg(
        F.count("*").alias("rows"), F.min(label).alias("first_label"), F.max(label).alias("last_label"),
    ).filter(F.col("first_label") != F.col("last_label"))
