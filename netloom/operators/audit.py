"""Checks that datasets, plans and saved artifacts agree; every check yields rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from netloom.functions import constants as K
from netloom.operators.prepare import all_finite


def straddling_groups(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups with rows in more than one split."""
    return df.groupBy(group).agg(
        F.min(split).alias("first_split"), F.max(split).alias("last_split"), F.count("*").alias("rows"),
    ).filter(F.col("first_split") != F.col("last_split"))


def set_differences(actual: DataFrame, expected: DataFrame, column: str) -> DataFrame:
    """Values on one side only ("extra": not expected, "absent": expected, not there)."""
    here = actual.select(column).distinct()
    there = expected.select(column).distinct()
    return here.join(there, column, "left_anti").withColumn("problem", F.lit("extra")).unionByName(
        there.join(here, column, "left_anti").withColumn("problem", F.lit("absent")))


def multiset_differences(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose multiplicities differ (``surplus`` > 0: more on the left); empty = equal.

    Counts cancel on the map side, so equal inputs shuffle distinct rows only.
    """
    signed = left.select(*columns, F.lit(1).alias("sign")).unionByName(right.select(*columns, F.lit(-1).alias("sign")))
    return signed.groupBy(*columns).agg(F.sum("sign").alias("surplus")).filter("surplus <> 0")


def align_predictions(truth: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """Predictions matched to truth per snapshot; rows of either side alone are kept."""
    return truth.join(predicted, key, "full_outer")


def metadata_disagreements(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, left, right) where two small metadata tables differ."""
    both = left.alias("l").join(right.alias("r"), key, "full_outer")
    items = [F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), F.struct(
        F.lit(f).alias("field"), F.col(f"l.{f}").cast("string").alias("left_value"),
        F.col(f"r.{f}").cast("string").alias("right_value"))) for f in fields]
    return both.select(key, F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("d")).select(key, "d.*")


def feature_hash(features: Column) -> Column:
    """SHA-256 of the feature list in its JSON text form (``["a", "b"]``)."""
    return F.sha2(F.concat(F.lit('["'), F.concat_ws('", "', features), F.lit('"]')), 256)


def schema_problems(classes: list[str], features: list[str]) -> list[str]:
    """Export agreement of a saved bundle: seven classes, 57 distinct features."""
    out = []
    if set(classes) != set(K.OUTPUT_CLASSES):
        out.append("class set")
    if len(features) != 57 or len(set(features)) != 57:
        out.append("feature list")
    return out


#: The documents of an export: training metadata of both stages, the stage-1 threshold, and the plan's text.
EXPORT_SCHEMA = """bundle bigint, plan string,
ml struct<lab_plan_sha256: string, cic_dataset_sha256: string, stage1_threshold: double, lab_train_rows: bigint,
          lab_validation_rows: bigint>,
dl struct<classes: array<string>, lab_adaptation: struct<lab_plan_sha256: string, cic_dataset_sha256: string,
          training_snapshots: bigint, validation_snapshots: bigint>>,
threshold struct<attack_threshold: double>"""


def export_problems(exports: DataFrame) -> DataFrame:
    """(bundle, problem) for exports (EXPORT_SCHEMA) whose documents do not belong together."""
    dl = "dl.lab_adaptation"
    digest = F.sha2(F.col("plan").cast("binary"), 256)
    count = lambda split: F.get_json_object("plan", f"$.splits.{split}.usable_rows").cast("bigint")
    differ = lambda a, b: ~a.eqNullSafe(b)
    classes = F.array(*map(F.lit, K.OUTPUT_CLASSES))
    rules = {
        "class set": F.size(F.array_except("dl.classes", classes)) + F.size(F.array_except(classes, F.col("dl.classes"))) != 0,
        "plans differ": F.col("ml.lab_plan_sha256").isNull() | differ(F.col("ml.lab_plan_sha256"), F.col(f"{dl}.lab_plan_sha256")),
        "stale plan": differ(F.col("ml.lab_plan_sha256"), digest) | differ(F.col(f"{dl}.lab_plan_sha256"), digest),
        "data sets differ": F.col("ml.cic_dataset_sha256").isNull() | differ(
            F.col("ml.cic_dataset_sha256"), F.col(f"{dl}.cic_dataset_sha256")),
        "threshold": differ(F.col("threshold.attack_threshold"), F.col("ml.stage1_threshold")),
        "train rows": differ(F.col("ml.lab_train_rows"), count("train")) | differ(F.col(f"{dl}.training_snapshots"), count("train")),
        "validation rows": differ(F.col("ml.lab_validation_rows"), count("validation")) | differ(
            F.col(f"{dl}.validation_snapshots"), count("validation")),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]))
    return exports.select("bundle", F.explode(broken).alias("problem"))


def audit_plan(plan: DataFrame, features: int = 57) -> DataFrame:
    """(check_name, expected, actual) for the parts of a split plan that need no data."""
    s = F.col("splits")
    train, held = s["train"], s["validation"]
    distinct = F.size(F.array_distinct("features"))
    checks = [
        ("schema_version", F.lit("1"), F.col("schema_version").cast("string")),
        ("split names", F.lit("train,validation"), F.concat_ws(",", F.array_sort(F.map_keys(s)))),
        ("distinct features", F.lit(str(features)), distinct.cast("string")),
        ("feature count", F.lit(str(features)), F.size("features").cast("string")),
        ("feature hash", feature_hash(F.col("features")), F.col("feature_schema_sha256")),
        ("shared campaigns", F.lit("0"),
         F.size(F.array_intersect(train["campaign_ids"], held["campaign_ids"])).cast("string")),
        ("shared connections", F.lit("0"), F.coalesce(F.greatest(F.lit(0), F.size(
            F.array_intersect(train["connection_ids"], held["connection_ids"]))), F.lit(0)).cast("string")),
    ]
    return _broken(plan, checks)


def audit_split(plan: DataFrame, split: str, data: DataFrame, digests: DataFrame, features: list[str]) -> DataFrame:
    """Rows, campaigns, connections, classes, finiteness and file digest of one split."""
    stats = plan.select(F.col("splits")[split].alias("s"))
    finite = all_finite(features)
    sums = data.agg(F.count("*").alias("rows"), F.count_if(~finite).alias("bad"),
                    F.array_sort(F.collect_set("ClassLabel")).alias("classes"))
    joined = stats.withColumn("one", F.lit(1)).join(sums.withColumn("one", F.lit(1)), "one")
    file = digests.agg(F.max("sha256").alias("sha256")).withColumn("one", F.lit(1))
    base = _broken(joined.join(file, "one", "left"), [
        ("row count", F.col("s.usable_rows").cast("string"), F.col("rows").cast("string")),
        ("non-finite rows", F.lit("0"), F.col("bad").cast("string")),
        ("classes", F.lit(",".join(sorted(K.LAB_CLASSES))), F.concat_ws(",", "classes")),
        ("parquet hash", F.col("s.parquet_sha256"), F.col("sha256")),
    ])
    parts = [base]
    for column, member in (("campaign_id", "campaign_ids"), ("connection_id", "connection_ids")):
        if column not in data.columns:
            continue
        if stats.filter(F.col(f"s.{member}").isNotNull()).isEmpty():   # the plan lists no such ids
            continue
        expected = stats.select(F.explode(f"s.{member}").alias(column))
        actual = data.select(F.col(column).cast("string").alias(column))
        parts.append(set_differences(actual, expected, column).select(
            F.lit(member).alias("check_name"),
            F.when(F.col("problem") == "absent", F.col(column)).alias("expected"),
            F.when(F.col("problem") == "extra", F.col(column)).alias("actual")))
    return reduce(DataFrame.unionByName, parts)


def _broken(df: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    items = [F.when(~expected.eqNullSafe(actual), F.struct(
        F.lit(name).alias("check_name"), expected.alias("expected"), actual.alias("actual")))
        for name, expected, actual in checks]
    return df.select(F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("c")).select("c.*")
