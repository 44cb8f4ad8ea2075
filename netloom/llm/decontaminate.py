"""Benchmark decontamination by spaced seeds.

Tokens (runs of letters and digits, lower case) are hashed; a seed is a hash of the tokens under a mask
that ignores the tokens between them, so a replaced token spoils only the seeds that look at it. Training
and benchmark seeds are joined; hits that agree in the shift between document and item form one candidate,
which is compared token by token: it counts if some window of WINDOW tokens (or the whole item, if shorter)
agrees in SHARE of its places or more.

The masks lose nothing the rule would count: MASKS has a set for each range of item lengths, and wherever
the tokens of a window that may be replaced lie, some placement of some mask of the set meets none of them
(tested over all placements for every length). Documents get the seeds of the ranges that the benchmark
has items in. All of it is column expressions: seeds are made and joined row by row in one stage, and only
hits move. The benchmark's seeds are broadcast up to BROADCAST_SEEDS, beyond that both sides are
shuffled by seed; likewise the hits on their way back to the texts.

Edge cases: NULL and empty texts have no tokens and are never hit; items of fewer than five tokens are
not searched, since so little text proves nothing; repeated items are reported each; rows with equal ids
are told apart by their text, and rows equal in both are reported once each; an empty table on either
side gives no hits; further columns are ignored, or kept by `without_benchmark`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from netloom.llm.common import ID, TEXT_ID, keyed
from netloom.session import cut_lineage

WINDOW = 20
SHARE = 80          # percent
SHORTEST = 5
BROADCAST_SEEDS = 1_000_000
BROADCAST_HITS = 300_000
#: Masks by the smallest length of the items they are for, up to the next one. Found by a greedy search.
MASKS = {
    5: ((0, 1, 2, 3), (0, 1, 3, 4), (0, 1, 2, 4), (0, 2, 3, 4)),
    10: ((0, 1, 3, 4, 5), (0, 1, 4, 6, 7), (0, 1, 5, 6, 7)),
    15: ((0, 1, 3, 4, 5, 6), (0, 1, 2, 6, 9, 10), (0, 2, 7, 9, 11, 12)),
    20: ((0, 1, 3, 5, 6, 9, 10), (0, 1, 5, 11, 12, 13, 14), (0, 1, 2, 3, 8, 10, 13), (0, 1, 3, 4, 7, 8, 10),
         (0, 2, 3, 6, 12, 15, 17)),
}
_WEIGHT = max(len(mask) for masks in MASKS.values() for mask in masks)


def tokens(text: str = "text") -> Column:
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", -1)
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def seeds(df: DataFrame, lengths: list[int]) -> DataFrame:
    """``df`` (with token hashes ``h``) as rows of its other columns, place and seed, for these keys of MASKS."""
    others = [c for c in df.columns if c != "h"]
    # lighter masks repeat their first place; the number keeps seeds of different masks apart
    masks = F.array(*[
        F.struct(F.lit(100 * length + i).alias("no"), F.lit(mask[-1]).alias("last"),
                 *[F.lit(mask[k] if k < len(mask) else 0).alias(f"o{k}") for k in range(_WEIGHT)])
        for length in lengths for i, mask in enumerate(MASKS[length])])
    df = df.select(*others, "h", F.explode(masks).alias("_m"))
    # outer: else a filter on the size is inferred and carried below, where it computes all of this again
    df = df.select(*others, "h", "_m", F.posexplode_outer("h").alias("place", "_t"))
    return df.where(F.col("place") + F.col("_m.last") < F.size("h")).select(*others, "place", F.xxhash64(
        "_m.no", *[F.get("h", F.col("place") + F.col(f"_m.o{k}")) for k in range(_WEIGHT)]).alias("seed"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """ID, TEXT_ID, doc_id, item_id, shift, start (in the item), compared and equal: the verified candidates."""
    items = cut_lineage(benchmark.select("item_id", tokens().alias("h")).where(F.size("h") >= SHORTEST)
                        .withColumn("item", F.monotonically_increasing_id()))
    size, bounds = F.size("h"), sorted(MASKS)
    length_class = F.greatest(*[F.when(size >= n, n) for n in bounds])
    lengths = sorted(r[0] for r in items.select(length_class).distinct().collect())  # one row per key of MASKS at most
    if not lengths:
        lengths = bounds[:1]
    of_items = reduce(DataFrame.unionByName, [seeds(items.where(length_class == n).select("item", "h"), [n]) for n in lengths])
    of_items = cut_lineage(of_items.distinct().withColumnRenamed("place", "at"))
    n_seeds = of_items.count()
    found = seeds(keyed(docs).select(ID, TEXT_ID, tokens().alias("h")), lengths)
    known = F.broadcast(of_items) if n_seeds <= BROADCAST_SEEDS else of_items
    hits = cut_lineage(found.join(known, "seed").select(ID, TEXT_ID, "item", (F.col("place") - F.col("at")).alias("shift"))
                       .distinct())
    few = hits.count() <= BROADCAST_HITS
    small = F.broadcast if few else (lambda df: df)
    texts = (keyed(docs).join(small(hits.select(ID, TEXT_ID).distinct()), [ID, TEXT_ID], "left_semi")
             .select(ID, TEXT_ID, "doc_id", tokens().alias("doc")))
    pairs = texts.join(small(hits), [ID, TEXT_ID]).join(items.withColumnRenamed("h", "words"), "item")
    # places of the item that lie inside the document under this shift, from 0
    first = F.greatest(F.lit(0), -F.col("shift"))
    beyond = F.least(F.size("words"), F.size("doc") - F.col("shift"))
    window = F.least(F.lit(WINDOW), F.size("words"))
    pairs = pairs.withColumns({"first": first, "n": beyond - first, "window": window}).where("n >= window")
    # running[i]: equal places among the first i
    same = F.zip_with(F.slice("doc", F.col("first") + F.col("shift") + 1, F.col("n")),
                      F.slice("words", F.col("first") + 1, F.col("n")), lambda a, b: (a == b).cast("int"))
    sums = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("window")), lambda i: F.struct(
        F.aggregate(F.slice("same", i + 1, F.col("window")), F.lit(0), lambda s, x: s + x).alias("equal"),
        (-i).alias("i")))
    best = pairs.withColumn("same", same).withColumn("best", F.array_max(sums))
    return best.where(100 * F.col("best.equal") >= SHARE * F.col("window")).select(
        ID, TEXT_ID, "doc_id", "item_id", "shift", (F.col("first") - F.col("best.i")).alias("start"),
        F.col("window").alias("compared"), F.col("best.equal").alias("equal"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item with an overlap: the best window's place in both, its size and equal tokens."""
    return (overlaps(docs, benchmark).groupBy(ID, TEXT_ID, "doc_id", "item_id")
            .agg(F.max_by(F.struct("compared", "equal", "start", "shift"), F.struct(
                "equal", (-F.col("start")).alias("s"), (-F.col("shift")).alias("d"))).alias("b"),
                F.count("*").alias("n_places"))
            .select("doc_id", "item_id", F.col("b.compared").alias("n_compared"), F.col("b.equal").alias("n_equal"),
                    F.col("b.start").cast("int").alias("item_token"),
                    (F.col("b.start") + F.col("b.shift")).cast("int").alias("doc_token"), "n_places"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a verified overlap, all columns."""
    found = cut_lineage(overlaps(docs, benchmark).select(ID, TEXT_ID).distinct())
    known = F.broadcast(found) if found.count() <= BROADCAST_HITS else found
    return keyed(docs).join(known, [ID, TEXT_ID], "left_anti").select(*docs.columns)
