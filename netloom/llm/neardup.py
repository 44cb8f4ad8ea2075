"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document's set is its distinct k-word shingles (ASCII letters in lower case). Documents with equal
sets are one node, so exact copies cost nothing after the first; nodes are linked by `near.classes`, and
membership is joined back. A pair at the threshold escapes all bands with probability MISS at most.

Shingles and nodes are 64-bit hashes: two different sets count as equal with probability 2**-64 a pair.

Edge cases: NULL, empty and blank texts have the empty set, are linked with nothing and kept; fewer than k
words are one shingle; rows with equal ids and different texts are rows of their own with a common id; rows
without id are linked but never name a component, and a component without any id is NULL with all its
rows kept; an empty table gives an empty result; further columns are ignored, or kept by `first_of_each`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from netloom.llm import near
from netloom.llm.common import ID, LAST_ID, TEXT_ID, keyed, map_batches
from netloom.session import cut_lineage

ROWS, MISS = 4, 1e-7


def _sets(texts, k: int, hashes: near.WordHashes) -> list[np.ndarray]:
    # bytes.lower() changes A-Z alone, and bytes.split() splits at exactly space and \x09-\x0d
    return hashes.sets([(t or "").encode().lower().split() for t in texts], k)


def sketched(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, node (NULL for the empty set) and keys of the bands."""
    count = near.tune(percent, ROWS, MISS)

    def start():
        hashes = near.WordHashes()

        def batch(ids, text_ids, texts):
            sets = _sets(texts, k, hashes)
            return (ids, text_ids, [len(s) for s in sets], [near.set_id(s) if len(s) else None for s in sets],
                    near.bands(sets, ROWS, count))
        return batch
    return map_batches(keyed(docs).select("doc_id", F.col(TEXT_ID).alias("text_id"), "text"),
                       "doc_id bigint, text_id bigint, n_shingles bigint, node bigint, keys array<bigint>", start)


def document_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    return _classes(docs, k, percent).drop("text_id", "component")


def _classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The same with text_id and the component's node (NULL for the empty set)."""
    rows = cut_lineage(sketched(docs, k, percent))  # ids and keys: a small part of the texts' size
    nodes = cut_lineage(rows.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys")))

    def start():
        hashes = near.WordHashes()

        def batch(texts):
            sets = _sets(texts, k, hashes)
            return [near.set_id(s) if len(s) else None for s in sets], [s.astype(np.int64).tolist() for s in sets]
        return batch

    def sets_of(asked: DataFrame) -> DataFrame:
        """Sets of one row of each asked node, read from the texts again."""
        ids = near.few(cut_lineage(nodes.join(asked, "node").select("doc_id").where("doc_id is not null").distinct()))
        without = docs.where("doc_id is null").select("text")
        texts = docs.join(ids, "doc_id", "left_semi").select("text").unionByName(without)
        found = map_batches(texts, "node bigint, set array<bigint>", start)
        return found.join(asked, "node").dropDuplicates(["node"])

    keys = nodes.select("node", F.explode("keys").alias("key"))
    labels = near.classes(keys, sets_of, percent)
    named = nodes.select("node", "doc_id").join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    member = named.join(names, "component").select("node", "component", "component_id")
    out = rows.select("doc_id", "text_id", "n_shingles", "node").join(member, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_id", "n_shingles", "component", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def first_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class, all columns: the smallest id (rows without come last), of equal ids the smallest hash.

    Rows without words are linked with nothing and all stay.
    """
    key = [ID, TEXT_ID]
    rows = cut_lineage(_classes(docs, k, percent).where("component is not null").select(
        F.coalesce(F.col("doc_id"), F.lit(LAST_ID)).alias(ID), F.col("text_id").alias(TEXT_ID), "component"))
    best = rows.groupBy("component").agg(F.min(F.struct(*key)).alias("best"))
    judged = rows.groupBy("component", *key).agg(F.count("*").alias("n")).join(best, "component")
    judged = cut_lineage(judged.select(*key, (F.struct(*key) == F.col("best")).alias("first"), "n"))
    left = keyed(docs).join(near.few(judged.where("not first").select(*key)), key, "left_anti")
    repeated = judged.where("first and n > 1").select(*key)
    if repeated.isEmpty():
        return left.select(*docs.columns)
    again = near.few(repeated)
    return (left.join(again, key, "left_anti").unionByName(
        left.join(again, key, "left_semi").dropDuplicates(key)).select(*docs.columns))
