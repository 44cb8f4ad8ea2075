"""The alert log: a parquet table whose columns may be added over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netloom.functions.constants import STAGE1_FEATURES, STAGE2_FEATURES

# Log columns and their types, in table order.
LOG_COLUMNS = {
    "timestamp": "string", "source_ip": "string", "destination_ip": "string", "protocol": "string",
    "attack_type": "string", "latency_ms": "bigint", "source_port": "bigint", "destination_port": "bigint",
    "confidence": "double", "verdict": "string", "stage_reached": "string", "model_attack_type": "string",
    "model_verdict": "string", "model_confidence": "double", "stage1_attack_probability": "double",
    "stage1_features_json": "string", "flow_features_json": "string",
    "flow_start_epoch": "double", "flow_end_epoch": "double",
}


ID_TYPE = "decimal(38,0)"


def evolve(log: DataFrame) -> DataFrame:
    """Any older log with the full column set; missing ones are typed NULLs."""
    missing = {name: F.lit(None).cast(kind) for name, kind in LOG_COLUMNS.items() if name not in log.columns}
    return log.withColumns(missing) if missing else log


def features_json(names: list[str], enabled: bool = True) -> Column:
    """Compact JSON of features; NULL when disabled. Non-finite values fail the job."""
    if not enabled:
        return F.lit(None).cast("string")

    def finite(name: str) -> Column:
        value = F.col(name).cast("double")
        bad = F.isnan(value) | (F.abs(value) == float("inf"))
        return F.when(bad, F.raise_error(F.lit(f"not a JSON number: {name}")).cast("double")).otherwise(value)

    return F.to_json(F.struct(*[finite(name).alias(name) for name in names]))


def log_rows(scored: DataFrame, log_features: bool = False) -> DataFrame:
    """Scored snapshots as log rows (19 columns; ``append`` adds the id)."""
    have = set(scored.columns)

    def pick(name: str, kind: str, default=None) -> Column:
        return (F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind)) if name in have
                else F.lit(default).cast(kind))

    union = sorted(set(STAGE1_FEATURES) | set(STAGE2_FEATURES))
    return scored.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        pick("source_ip", "string", "0.0.0.0").alias("source_ip"),
        pick("destination_ip", "string", "0.0.0.0").alias("destination_ip"),
        pick("protocol", "string", "TCP").alias("protocol"),
        # NULL where nothing was measured; the latency gate then says so
        F.col("attack_type"), F.when(pick("latency_ms", "double").isNotNull(), F.ceil(F.greatest(
            pick("latency_ms", "double"), F.lit(1.0)))).alias("latency_ms"),
        pick("Source Port", "bigint", 0).alias("source_port"),
        pick("Destination Port", "bigint", 0).alias("destination_port"),
        F.col("final_confidence").alias("confidence"), "verdict", "stage_reached",
        F.col("attack_type").alias("model_attack_type"), F.col("verdict").alias("model_verdict"),
        F.col("final_confidence").alias("model_confidence"),
        F.col("p_attack").alias("stage1_attack_probability"),
        features_json(STAGE1_FEATURES, log_features).alias("stage1_features_json"),
        features_json(union, log_features).alias("flow_features_json"),
        pick("flow_start_ts", "double").alias("flow_start_epoch"),
        pick("flow_end_ts", "double").alias("flow_end_epoch"),
    )


def append(rows: DataFrame, path: str, batch: int = 0) -> None:
    """Append with an id that grows from batch to batch and is unique within one.

    The id is ``batch * 2**63`` plus Spark's row number, as a decimal, so neither the number of
    batches nor the number of partitions of a batch is bounded by it.
    """
    first = F.lit(str(batch << 63)).cast(ID_TYPE)
    numbered = rows.withColumn("id", (first + F.monotonically_increasing_id()).cast(ID_TYPE))
    # A batch that is retried replaces its own folder, so it never counts twice.
    numbered.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The whole log; columns that a file lacks are NULL. One footer gives the type of the ids."""
    first = spark.read.parquet(path).schema
    ids = first["id"].dataType.simpleString() if "id" in first.names else ID_TYPE
    known = ", ".join(f"{name} {kind}" for name, kind in {"id": ids, **LOG_COLUMNS}.items())
    return spark.read.schema(f"{known}, batch bigint").parquet(path)
