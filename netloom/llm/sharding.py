"""Rendezvous hashing of record keys over weighted shards.

Every (key, shard) pair has a pseudo-random number u in (0, 1); a key goes to the shard with the
smallest ``-ln(u) / weight``, so shares follow the weights. A new shard can only win keys for itself,
and a removed one only gives up its own: nothing else moves. Shards are found row by row, without a
shuffle.

Edge cases: a NULL key is the key ``~``; a NULL text has size 1 and the checksum of the empty text;
equal rows are separate rows with adjoining slots; an empty table gives an empty result; further
columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from netloom.session import cut_lineage

#: Rows that one task ranks at most, if keys are spread.
RANKED_ROWS = 200_000


def _hex52(text: Column) -> Column:
    """The first 13 hex digits of the MD5 sum as a number."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: 0 to ``len(weights) - 1``; a weight of 0 keeps a shard empty."""
    name = F.coalesce(key.cast("string"), F.lit("~"))
    bids = []
    for shard, weight in enumerate(weights):
        if weight <= 0:
            continue
        u = (_hex52(F.concat(name, F.lit(f":{shard}"))) + F.lit(0.5)) / F.lit(float(2 ** 52))
        bids.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard")))
    if not bids:
        raise ValueError("no shard has a weight above 0")
    return (F.least(*bids) if len(bids) > 1 else bids[0]).getField("shard")


def with_slots(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``slot``: the position of a row in its group, without gaps from 0, in the order of a hash of ``order``.

    The hash range is cut in so many parts that a part of a group has about RANKED_ROWS rows; counts
    of the parts, summed before they move, give each part its first slot.
    """
    rows = cut_lineage(rows.withColumn("_h", F.md5(F.concat_ws(
        "\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in order]))))
    digits = max(1, math.ceil(math.log(max(rows.count(), 1) / RANKED_ROWS + 1, 16)))
    rows = rows.withColumn("_part", F.substring("_h", 1, digits))
    counts = rows.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_p"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_part").orderBy("_h", *order)
    return (rows.join(starts, (F.col(group) == F.col("_group")) & (F.col("_part") == F.col("_p")))
            .withColumn("slot", F.col("_start") + F.row_number().over(inside) - 1)
            .drop("_h", "_part", "_group", "_p", "_start"))


def shard_rows(docs: DataFrame, shards: int = 16, weights: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard with one more shard of weight 1."""
    weights = list(weights) if weights is not None else [1.0] * shards
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), [*weights, 1.0]).alias("grown_shard"))
    return with_slots(rows, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _bid(shard: int) -> str:
    return (f"{{'c': -ln((CAST('0x' || substr(md5(k || ':{shard}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0),"
            f" 's': {shard}}}")


def least_shard_sql(shards: int = 16) -> str:
    """doc_id, size, shard and grown_shard in DuckDB, for the tests (it has no CRC-32)."""
    few, more = (", ".join(_bid(i) for i in range(n)) for n in (shards, shards + 1))
    return f"""
SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
       list_min([{few}]).s AS shard, list_min([{more}]).s AS grown_shard
FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '~') AS k FROM documents)"""
