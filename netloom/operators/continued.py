"""Flows over many batches: what is open after one batch is a row for each key, and the next batch takes it up.

A row holds sums and last values only, as in the live state, so daily batches give the snapshots of one long run
without any packet being read twice. Every batch costs one shuffle of its packets and of the open keys, which are
walked as sorted partitions, Arrow batch by batch: nothing is paid for a key, nor is a key ever whole in memory.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netloom.operators.features import features
from netloom.operators.flows import FlowConfig
from netloom.operators.packets import KEY, with_key
from netloom.streaming import flow_state as live

_KEY = "lo_ip string, lo_port bigint, hi_ip string, hi_port bigint, protocol string"
#: State travels as JSON text: numbers keep all their digits, whatever is missing.
STATE = _KEY + ", state string"
_ROWS = "open boolean, state string, " + live.OUTPUT_SCHEMA


def no_state(df: DataFrame) -> DataFrame:
    """The state before the first batch."""
    return df.sparkSession.createDataFrame([], STATE)


_ARROW = pa.schema([("open", pa.bool_()), ("state", pa.string()), ("lo_ip", pa.string()), ("lo_port", pa.int64()), ("hi_ip", pa.string()),
                    ("hi_port", pa.int64()), ("protocol", pa.string()), ("emit", pa.int32()), ("longs", pa.list_(pa.int64())),
                    ("squares", pa.list_(pa.string())), ("sample", pa.binary())])
_SENT = 2_048      # rows of an output batch


def _fold(config: FlowConfig):
    def fold(batches):
        """Rows of whole keys, a key's state before its packets, those in arrival order."""
        key, flow, arms, rows = None, None, [None, None], []

        def close():
            if flow is not None or any(arm is not None for arm in arms):
                longs, squares, sample = live.packed(flow, arms)
                rows.append((True, json.dumps([longs, squares, sample.hex()]), *key, 0, [], [], b""))

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

        for batch in batches:
            columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            packets = map(live.Packet._make, zip(*[columns[name] for name in live.Packet._fields]))
            for k, before, p in zip(zip(*[columns[name] for name in KEY]), columns["state"], packets):
                if k != key:
                    close()
                    key, state = k, None
                    if before is not None:
                        longs, squares, sample = json.loads(before)
                        state = longs, squares, bytes.fromhex(sample)
                    flow, arms = live.unpacked(state)
                if before is not None:
                    continue
                out: list[dict] = []
                flow = live.advance(flow, arms, p, config, out)
                rows += [(False, None, *key, row["emit"], *live.packed_row(row)) for row in out]
                if len(rows) >= _SENT:
                    yield sent()
                    rows.clear()
        close()
        if rows:
            yield sent()
    return fold


def batch_rows(packets: DataFrame, before: DataFrame, config: FlowConfig) -> DataFrame:
    """Rows of one batch: accumulators of its snapshots, and what is open after it (``open``). Write it before use."""
    keyed = with_key(packets)
    if "payload" not in keyed.columns:
        keyed = keyed.withColumn("payload", F.lit(None).cast("binary"))
    tcp = F.col("protocol") == "TCP"
    rows = keyed.withColumn("flags", F.when(tcp, F.col("flags")).otherwise(0).cast("bigint")).select(*KEY, *live.PACKET)
    given = rows.unionByName(before.select(*KEY, "state"), allowMissingColumns=True)
    return given.repartition(*KEY).sortWithinPartitions(*KEY, F.col("state").isNull(), "seq").mapInArrow(_fold(config), _ROWS)


def open_after(rows: DataFrame) -> DataFrame:
    return rows.where("open").select(*KEY, "state")


def snapshots_of(rows: DataFrame) -> DataFrame:
    return features(live.numbered(rows.where("not open").drop("open", "state")))


def flushed(state: DataFrame) -> DataFrame:
    """Snapshots of the flows that are open after the last batch, as a replay ends them."""
    parts = F.from_json("state", "array<string>")
    given = state.withColumn("parts", parts).select(
        *KEY, F.from_json(F.col("parts")[0], "array<bigint>").alias("kept"),
        F.from_json(F.col("parts")[1], "array<string>").alias("squares"), F.unhex(F.col("parts")[2]).alias("sample"))
    at = lambda name: F.col("kept")[live.STATE_LONGS.index(name)]
    return features(live.numbered(given.where(at("pending") > 0).select(
        *KEY, F.lit(0).alias("emit"), F.array(*[at(name) for name in live.OUT_LONGS]).alias("longs"),
        F.transform("squares", lambda x: F.coalesce(x, F.lit("0"))).alias("squares"), "sample")))
