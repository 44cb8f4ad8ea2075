"""Scoring a snapshot stream into the alert log."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from netloom.functions.constants import OUTPUT_CLASSES, STAGE1_FEATURES, STAGE2_FEATURES
from netloom.operators.features import FLOW
from netloom.operators.prepare import all_finite, contract_violations
from netloom.operators.scoring import verdicts
from netloom.sources import alertlog

REQUIRED = sorted(set(STAGE1_FEATURES) | set(STAGE2_FEATURES))


def score_and_log(snapshots: DataFrame, scorer: Callable[[DataFrame], DataFrame], log_path: str,
                  error_path: str, checkpoint: str, classes: list[str] = OUTPUT_CLASSES,
                  log_features: bool = False, counters: str | None = None, **trigger) -> StreamingQuery:
    """Every snapshot is scored and appended; a bad one goes to the error table.

    With a ``counters`` folder every batch also leaves its verdicts by attack type and the number of snapshots
    that could not be classified there; `Progress` adds what only the engine knows (`running_counters` reads both).

    ``scorer`` adds ``p_attack`` and ``probabilities``. Both tables are written per
    batch id, so a batch repeated after a failure replaces itself. ``latency_ms`` is
    the measured time of scoring the batch by its number of rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()          # two tables are written from it; the stateful fold runs once
        scored = None
        try:
            contract_violations(batch, [*FLOW, "last_seq"], REQUIRED).write.mode("overwrite").parquet(
                f"{error_path}/batch={batch_id}")
            good = batch.filter(all_finite([f"`{name}`" for name in REQUIRED]))
            began = time.monotonic()
            scored = verdicts(scorer(good), "p_attack", "probabilities", classes).persist()
            rows = scored.count()
            each = (time.monotonic() - began) * 1000 / max(rows, 1)
            alertlog.append(alertlog.log_rows(scored.withColumn("latency_ms", F.lit(each)), log_features),
                            log_path, batch_id)
            if counters:
                failed = batch.filter(~all_finite([f"`{name}`" for name in REQUIRED])).select(
                    F.lit("ERROR").alias("verdict"), F.lit(None).cast("string").alias("attack_type"))
                scored.select("verdict", "attack_type").unionByName(failed).groupBy("verdict", "attack_type").agg(
                    F.count("*").alias("flows")).coalesce(1).write.mode("overwrite").parquet(f"{counters}/verdicts/batch={batch_id}")
        finally:
            batch.unpersist()
            if scored is not None:
                scored.unpersist()

    return snapshots.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(
        write).trigger(**(trigger or {"processingTime": "1 second"})).start()


PACKETS = "netloom_packets"


def counted(packets: DataFrame) -> DataFrame:
    """The packet stream, with its rows counted on the way for `Progress`."""
    return packets.observe(PACKETS, F.count(F.lit(1)).alias("packets"))


class Progress(StreamingQueryListener):
    """Keeps packets read and rows dropped as late, one row for each batch of the queries of a session.

    Counts come from the engine itself: the observed metric of `counted` and the state operators' own number of
    rows behind the watermark. A repeated batch replaces its row.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.kept = spark, folder, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.keep(event.progress)

    def keep(self, progress) -> None:
        seen = progress.observedMetrics.get(PACKETS)
        late = sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators)
        row = (progress.batchId, int(seen["packets"]) if seen is not None else 0, late)
        if self.kept.get(progress.batchId) != row:
            self.kept[progress.batchId] = row
            self.spark.createDataFrame([row], "batch_id bigint, packets bigint, late bigint").coalesce(1).write.mode(
                "overwrite").parquet(f"{self.folder}/progress/batch={progress.batchId}")

    def finish(self, query: StreamingQuery) -> None:
        """Takes in what the listener has not been told yet; events arrive after the batches they tell of."""
        for progress in query.recentProgress:
            self.keep(progress)


def running_counters(spark: SparkSession, counters: str) -> DataFrame:
    """One row: packets sniffed and dropped, flows analysed, benign and malicious ones, classification errors."""
    progress = spark.read.schema("packets bigint, late bigint").parquet(f"{counters}/progress").agg(
        F.coalesce(F.sum("packets"), F.lit(0)).alias("packets_sniffed"), F.coalesce(F.sum("late"), F.lit(0)).alias("packets_dropped"))
    flows = F.col("flows")
    some = lambda condition: F.coalesce(F.sum(F.when(condition, flows)), F.lit(0)).cast("bigint")
    error = F.col("verdict") == "ERROR"
    verdicts_ = spark.read.schema("verdict string, attack_type string, flows bigint").parquet(f"{counters}/verdicts").agg(
        some(~error).alias("flows_analyzed"), some(F.col("verdict") == "BENIGN").alias("benign_flows"),
        some(F.col("verdict") == "MALICIOUS").alias("malicious_flows"), some(error).alias("classification_errors"))
    return progress.withColumn("one", F.lit(1)).join(verdicts_.withColumn("one", F.lit(1)), "one").drop("one")
