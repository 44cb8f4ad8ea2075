"""Datasets, JSON documents, digests and the report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, LongType, MapType, StringType,
                               StructField, StructType, VariantType)

from netloom.operators.prepare import require_columns


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


EVENT = _struct(action=StringType(), started_epoch=DoubleType(), ended_epoch=DoubleType(), success=BooleanType(),
                actions_completed=LongType(), response_bytes=LongType(), detail=StringType())
LIMITS = _struct(max_seconds=LongType(), max_actions=LongType(), max_outbound_bytes=LongType())
MANIFEST = _struct(
    schema_version=LongType(), campaign_id=StringType(), worker_id=StringType(), mode=StringType(),
    class_label=StringType(), reference_label=StringType(), scenario_label=StringType(), seed=LongType(),
    parameters=MapType(StringType(), StringType()), target_ip=StringType(), source_ip=StringType(),
    started_epoch=DoubleType(), ended_epoch=DoubleType(), started_utc=StringType(), ended_utc=StringType(),
    status=StringType(), actions_attempted=LongType(), actions_succeeded=LongType(),
    estimated_outbound_bytes=LongType(), application_response_bytes=LongType(), header_pad_bytes=LongType(),
    limits=LIMITS, events=ArrayType(EVENT), errors=ArrayType(StringType()))
# Limits and parameters of any JSON type; the reader turns them into their JSON text.
PROFILE = _struct(class_label=StringType(), reference_label=VariantType(), scenario_label=StringType(),
                  max_seconds=VariantType(), max_actions=VariantType(), max_outbound_bytes=VariantType(),
                  parameters=MapType(StringType(), VariantType()))
PROFILES = _struct(schema_version=LongType(), profiles=MapType(StringType(), PROFILE))
SPLIT = _struct(parquet=StringType(), parquet_sha256=StringType(), usable_rows=LongType(),
                campaign_ids=ArrayType(StringType()), connection_ids=ArrayType(StringType()))
SPLIT_PLAN = _struct(schema_version=LongType(), features=ArrayType(StringType()),
                     feature_schema_sha256=StringType(), splits=MapType(StringType(), SPLIT))


def read_dataset(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """Parquet dataset; fails when the path or a required column is missing."""
    return require_columns(spark.read.parquet(path), required or [])


def read_lab_split(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """Only the ids, the label and the features reach the scan."""
    df = spark.read.parquet(path)
    extra = ["connection_id"] if "connection_id" in df.columns else []
    wanted = ["campaign_id", *extra, "ClassLabel", *features]
    return require_columns(df, wanted).select(*wanted)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One nested document per worker; absent members are NULL."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """One row per mode. Documents of another schema version fail the job."""
    raw = spark.read.schema(PROFILES).option("multiLine", True).json(path)
    version = F.coalesce(F.col("schema_version"), F.lit(-1))
    checked = raw.withColumn("profiles", F.when(version == 1, F.col("profiles")).otherwise(
        F.raise_error(F.lit("unsupported campaign profile schema")).cast(raw.schema["profiles"].dataType)))
    rows = checked.select(F.explode("profiles").alias("mode", "p")).select("mode", "p.*")
    return rows.withColumns({
        **{name: F.to_json(name) for name in ("max_seconds", "max_actions", "max_outbound_bytes", "reference_label")},
        "parameters": F.transform_values("parameters", lambda _, value: F.to_json(value))})


def read_split_plan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SPLIT_PLAN).option("multiLine", True).json(path)


def read_metric(spark: SparkSession, path: str, metric: str = "macro_f1") -> DataFrame:
    """A score within [0, 1] per readable report; malformed or missing ones give no row."""
    raw = spark.read.text(path, wholetext=True)
    value = F.get_json_object("value", f"$.{metric}").try_cast("double")
    return raw.select(F.input_file_name().alias("path"), value.alias(metric)).filter(F.col(metric).between(0, 1))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 over whole files, one file per row."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_metrics(overall: DataFrame, binary: DataFrame, path: str) -> None:
    """The metrics document of an evaluation: one row of overall scores, with the binary attack scores nested in it."""
    nested = binary.select(F.struct(*binary.columns).alias("binary_attack_vs_benign"), F.lit(1).alias("_one"))
    overall.withColumn("_one", F.lit(1)).join(nested, "_one").drop("_one").coalesce(1).write.mode("overwrite").json(path)


def write_profile(dataset: DataFrame, columns: DataFrame, infinities: DataFrame, path: str) -> None:
    """The inspection document of a dataset: its shape, and the columns with NULLs and with infinities, by name.

    ``columns``: column, dtype, null_count (`column_profile`); ``infinities``: column, infinities (`infinity_counts`).
    Both have a row for each column, so the document is as long as the schema.
    """
    pairs = lambda df, count: df.where(F.col(count) > 0).agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("column", count)))).alias("m"), F.lit(1).alias("_one"))
    shape = dataset.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(dataset.columns)).alias("columns"), F.lit(1).alias("_one"))
    types = columns.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("column", "dtype")))).alias("dtypes"), F.lit(1).alias("_one"))
    nulls = pairs(columns, "null_count").withColumnRenamed("m", "columns_with_nulls")
    endless = pairs(infinities, "infinities").withColumnRenamed("m", "columns_with_infinities")
    shape.join(types, "_one").join(nulls, "_one").join(endless, "_one").drop("_one").coalesce(1).write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str) -> None:
    """Exact rows per split, kept for later evaluation."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
