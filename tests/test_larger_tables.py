"""What larger tables bring: ports beyond their field, ids that spread, many keys, many rows a task."""

from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from netloom.operators import continued, learn
from netloom.operators.flows import LIVE, SMALL
from netloom.operators.packets import KEY
from netloom.plans import log_queries as logs
from netloom.streaming import flow_state

PACKET_COLUMNS = ("seq bigint, ts_us bigint, src_ip string, dst_ip string, src_port bigint, dst_port bigint, protocol string, "
                  "flags bigint, pkt_len bigint, header_len bigint, win_size bigint")


def test_capture_keeps_ports_beyond_sixteen_bits(spark):
    rows = [(1001 + n, 50 + n, "10.0.0.1", "192.168.100.10", port, 80, kind, flags, size, header, win)
            for n, (port, kind, flags, size, header, win) in enumerate([
                (40_000, "TCP", 24, 7, 24, 900), (65_536, "TCP", 16, 0, 20, 1), (129_999, "UDP", 0, 3, 8, 0), (70_001_234, "TCP", 2, 0, 40, 5)])]
    rows += [(seq + 1000, ts, b, a, q, p, *rest) for seq, ts, a, b, p, q, *rest in rows]
    out = logs._capture_scan(spark.createDataFrame(rows, PACKET_COLUMNS))
    names = ["ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "flags", "pkt_len", "header_len", "win_size"]
    got = out.select("path", "frame", *names).collect()
    assert sorted(tuple(r) for r in got) == sorted((f"cap-{r[0] // 1000:09d}", r[0] % 1000 - 1, *r[1:]) for r in rows)


def test_number_of_manifest_files_follows_the_events(spark, tmp_path):
    """Ids and campaigns interleave: each range of arrivals meets nearly all campaigns."""
    events = spark.range(60_000).select(
        (F.col("id") % 900).alias("campaign_id"), (F.col("id") * 100).alias("event_id"), (F.col("id") % 2).alias("worker_id"),
        F.lit("10.0.0.1").alias("source_ip"), F.lit("view").alias("action"), F.col("id").alias("started_us"),
        (F.col("id") + 5).alias("ended_us"), (F.col("id") % 3 > 0).alias("success"), (F.col("id") % 7).alias("response_bytes"))
    logs.store_manifests(events, str(tmp_path / "m"))
    assert len(list(Path(tmp_path / "m").rglob("*.txt"))) <= 3
    found = logs.manifest_scan(events).agg(F.sum("events").alias("n"), F.sum("response_bytes").alias("b"), F.count("*").alias("rows")).first()
    assert found["n"] == 60_000 and found["b"] == sum(i % 7 for i in range(60_000)) and found["rows"] == 900


def test_continued_batches_walk_many_keys_in_one_call(spark):
    """One call folds all keys of a partition, batch by batch, wherever Arrow cuts them."""
    n = 600
    df = spark.range(n * 4).select(
        (F.col("id") * 7919 % (n * 4)).alias("seq"), (F.col("id") * 7919 % (n * 4) * 1000).alias("ts_us"),
        F.concat(F.lit("10.0.0."), F.col("id") % n).alias("src_ip"), F.lit("h").alias("dst_ip"), F.lit(5).cast("bigint").alias("src_port"),
        F.lit(80).cast("bigint").alias("dst_port"), F.lit("TCP").alias("protocol"), F.lit(16).cast("bigint").alias("flags"),
        F.lit(3).cast("bigint").alias("pkt_len"), F.lit(20).cast("bigint").alias("header_len"), F.lit(9).cast("bigint").alias("win_size"))
    asked = continued.batch_rows(df, continued.no_state(df), SMALL)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        made = asked.localCheckpoint()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert made.where("open").count() == n and made.where("not open").count() == n   # three packets emit, one stays pending
    ended = continued.flushed(continued.open_after(made))
    assert ended.count() == n and ended.agg(F.countDistinct("flow_seq")).first()[0] == n


class KeptState:
    """The stored state of one group, as Spark hands it to a call."""

    def __init__(self):
        self.value, self.watermark, self.wake, self.hasTimedOut = None, 0, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, at):
        assert at > self.watermark
        self.wake = at

    def getCurrentWatermarkMs(self):
        return self.watermark


def test_keys_of_a_group_share_calls_and_time_out_one_by_one():
    step, state = flow_state._step(LIVE, 0), KeptState()

    def called(*packets):
        columns = [*KEY, *flow_state.PACKET]
        rows = [("a", 1, f"b{key}", 80, "TCP", seq, ts, 0, False, 16, 3, 20, 9, 3, None) for key, seq, ts in packets]
        return [tuple(r) for out in step((0,), iter([pd.DataFrame(rows, columns=columns)]), state) for r in out[["hi_ip", "emit"]].values]

    assert called(*[(key, key, 1_000_000) for key in range(50)]) == [] and state.wake == 2501
    # key 7 goes on, the others are silent: their flows end in the call that brings its packets
    state.watermark = 2_600
    assert sorted(called((7, 100, 2_450_000), (7, 99, 2_400_000))) == sorted((f"b{key}", 4 if key == 7 else 0) for key in range(50))
    state.watermark, state.hasTimedOut = 3_950, True
    assert called() == [] and state.exists           # 7 was seen at 2.45 s
    state.watermark = 3_952
    assert called() == [("b7", 0)] and not state.exists


def test_training_rows_are_packed_once_in_blocks(spark):
    """Blocks hold whole Arrow batches by domain; gradients over their pieces add up to those of all rows."""
    rng = np.random.default_rng(3)
    x, y, w = rng.normal(size=(5_000, 2)), rng.integers(0, 3, 5_000), rng.uniform(0.5, 2.0, 5_000)
    rows = [(x[i].tolist(), int(y[i]), float(w[i]), (None, "a", "b")[i % 3]) for i in range(5_000)]
    blocks = learn._blocked(spark.createDataFrame(rows, "x array<double>, y bigint, w double, domain string").coalesce(1))
    assert blocks.count() <= 3 and sorted(b["domain"] or "" for b in blocks.collect()) == ["", "a", "b"]
    weights = learn._layers(learn.Training(hidden=(4,)), 2, 3)
    shared = spark.sparkContext.broadcast(weights)
    loss, mass, flat = learn._summed(blocks, shared, 2.0)
    whole, grads = learn.gradients(x, y, w, weights, 2.0)
    assert np.isclose(loss, whole) and np.isclose(mass, w.sum()) and np.allclose(flat, np.concatenate([g.ravel() for g in grads]))
    assert sum(r["count"] for r in learn._confusion(blocks, shared)) == 5_000


def test_boosted_trees_bound_the_rows_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(learn, "TREE_ROWS", 100)
    seen = []
    real = learn.GBTClassifier.fit
    monkeypatch.setattr(learn.GBTClassifier, "fit", lambda self, df: seen.append(df.rdd.glom().map(len).collect()) or real(self, df))
    df = spark.range(2_000).coalesce(1).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 17 > 8).cast("int").alias("t"))
    model = learn.stage1_model(df, ["a"], "t", "boosted", None, 2, 2)
    assert max(seen[0]) <= 120 and sum(seen[0]) == 2_000
    right = learn.attack_probability(model, df).select(F.avg(((F.col("p_attack") > 0.5) == (F.col("t") == 1)).cast("int"))).first()[0]
    assert right == 1.0
