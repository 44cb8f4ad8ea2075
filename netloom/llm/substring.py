"""Repeated passages: near-duplicate paragraphs by MinHash banding, and exact runs of 50 words wherever they stand.

A paragraph is a line of a text with LEAST_WORDS words or more; its set is its distinct five-word shingles
(ASCII letters in lower case). Bands are tuned so that a pair at the threshold escapes with probability
MISS at most, colliding paragraphs are compared exactly (`near.classes`), and of each component, equal
paragraphs included, only the first one stays: the one in the document with the smallest id, there the
first. Shorter lines alone are never removed; they are too common to be copies of each other.

A passage does not keep to lines: it may stand inside a longer one or reach over many short ones. So each run of
50 words that an earlier document has too is cut out, line breaks and spaces aside, by the sampled prefix doubling of
`suffix` over words. Both rules judge the input; of a run that reaches into removed lines the rest is cut if that are
50 words, too (fewer are no passage). A line whose words are all cut goes.

A text is read once for both, sketches and runs (its words are hashed once, in arrays over many texts), and again only
for paragraphs that collide, where runs differ, and for the result. Tables of paragraphs carry ids and keys. Paragraphs
are known by 64-bit hashes: two different ones count as equal with probability 2**-64 a pair.

Only tables of bounded size are broadcast. Bitmaps (`marks`) tell which band keys and anchors several rows have, and which
lines and texts a larger table asks for; the others stay where they are, and what a bitmap lets through is judged exactly.

Edge cases: NULL and empty texts have no paragraphs; rows with equal ids and different texts are separate
documents, ordered by a hash of the text; rows equal in both are one document (none removes the other);
rows without id come after all others; repeats within one document are removed, too; an empty table gives
an empty result; further columns are ignored, or kept by `without_repeats`.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from netloom.llm import marks, near, suffix
from netloom.llm.common import ID, TEXT_ID, WORD, keyed, map_arrow, written
from netloom.llm.words import Words, parts, words
from netloom.session import cut_lineage

LEAST_WORDS, SHINGLE, PERCENT = 20, 5, 80
ROWS, MISS = 3, 2e-4
#: Lists of lines and runs to remove are broadcast up to so many bytes.
FEW_BYTES = 1 << 23
_U = np.uint64


def _line_id(line: bytes) -> int:
    """What Spark's xxhash64 gives for the same string."""
    value = xxhash.xxh64_intdigest(line, seed=42)
    return value - (1 << 64) if value >> 63 else value


def _shingles(own: Words, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of paragraphs, and for each its paragraph's place in ``lines``."""
    sizes = np.diff(own.lines)[lines] - SHINGLE + 1
    places = np.arange(sizes.sum()) + np.repeat(own.lines[lines] - np.cumsum(sizes) + sizes, sizes)
    return near.windows(own.hashes, SHINGLE)[places], np.repeat(np.arange(len(lines)), sizes)


def sketched(docs: DataFrame) -> DataFrame:
    """id, text_id; per paragraph, its line number, id and band keys; anchors, blocks and spans of the runs of 50 words."""
    count = near.tune(PERCENT, ROWS, MISS)

    def batch(given):
        for part in parts(given, "text"):
            ids, text_ids, texts = part.columns
            own = words(texts.cast("binary").to_pylist())
            long = np.flatnonzero(np.diff(own.lines) >= LEAST_WORDS)
            bounds = np.searchsorted(long, own.texts)
            text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            nodes = [_line_id(own.data[a:b]) for a, b in zip((own.breaks[long] + 1).tolist(), own.breaks[long + 1].tolist())]
            keys = near.band_keys(near.sketch_of(*_shingles(own, long), len(long), ROWS * count), ROWS)
            anchors, blocks, spans, edges = suffix.word_blocks(own)
            yield (ids, text_ids, (bounds, long - own.texts[text]), (bounds, nodes),
                   (bounds, (np.arange(len(long) + 1) * count, keys.ravel())), (edges, anchors), (edges, blocks), (edges, spans))
    return map_arrow(keyed(docs).select(ID, TEXT_ID, "text"),
                     "id bigint, text_id bigint, lines array<int>, nodes array<bigint>, keys array<array<bigint>>, "
                     "anchors array<bigint>, blocks array<bigint>, spans array<bigint>", lambda: batch)


def shared_keys(rows: DataFrame) -> DataFrame:
    """key and node of the bands of `sketched` that several paragraphs have (and a few others)."""
    n = rows.agg(F.sum(F.aggregate("keys", F.lit(0).cast("bigint"), lambda n, k: n + F.size(k)))).first()[0] or 0

    def keys(given):
        yield given.column("keys").flatten().flatten().to_numpy().view(_U)
    several = marks.marked(rows.select("keys"), lambda: keys, marks.places_of(n), 2)

    def start():
        has = marks.reader(several)

        def batch(given):
            bands = given.column("keys").flatten()
            values = bands.flatten().to_numpy()
            at = np.flatnonzero(has(values.view(_U)))
            yield values[at], np.repeat(given.column("nodes").flatten().to_numpy(), bands.value_lengths())[at]
        return batch
    return map_arrow(rows.select("nodes", "keys"), "key bigint, node bigint", start)


def repeated_lines(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """id, text_id and the sorted numbers of the lines to remove; ``rows``: `sketched`, written."""
    def sets(given):
        for part in parts(given, "line"):
            own = words(part.column("line").cast("binary").to_pylist())
            values, owner = _shingles(own, np.arange(part.num_rows))
            order = np.lexsort((values, owner))
            values, owner = values[order], owner[order]
            fresh = np.ones(len(values), bool)
            fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
            yield (part.column("node"), (np.searchsorted(owner[fresh], np.arange(part.num_rows + 1)), values[fresh].astype(np.int64)))

    def sets_of(asked: DataFrame) -> DataFrame:
        asked = cut_lineage(asked)
        lines = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
        lines, first = lines.withColumn("node", F.xxhash64("line")), F.first("line").alias("line")
        if asked.count() <= marks.FEW:
            found = lines.join(F.broadcast(asked), "node", "left_semi").groupBy("node").agg(first)
        else:                                           # copies of a line meet as one of each task
            found = lines.where(marks.member(asked, "node")("node")).groupBy("node").agg(first).join(asked, "node", "left_semi")
        return map_arrow(found, "node bigint, set array<bigint>", lambda: sets)

    labels = near.classes(written(shared_keys(rows)), sets_of, PERCENT, marks.FEW)
    place = F.struct("id", "text_id", "line")
    places = rows.select("id", "text_id", F.explode(F.arrays_zip("lines", "nodes")).alias("p")).select(
        "id", "text_id", F.col("p.lines").alias("line"), F.col("p.nodes").alias("node"))
    firsts = (places.groupBy("node").agg(F.min(place).alias("first"), F.max(place).alias("last"))
              .join(labels, "node", "left").where("component is not null or first <> last")
              .withColumn("component", F.coalesce("component", "node")))
    firsts = cut_lineage(firsts)
    of_class = firsts.groupBy("component").agg(F.min("first").alias("kept"))
    known = cut_lineage(firsts.join(of_class, "component").select("node", "kept"))
    return (places.join(near.few(known, marks.FEW), "node").where(place != F.col("kept"))
            .groupBy("id", "text_id").agg(F.array_sort(F.collect_set("line")).alias("removed")))


def repeated_passages(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """id, text_id and the first and last (excluded) words of runs of 50 words or more that an earlier document has, too."""
    own = rows.select(F.col("id").alias("doc_id"), F.col("text_id").alias("no"), "anchors", "blocks", "spans")
    several = own.groupBy("doc_id").agg(F.min("no").alias("a"), F.max("no").alias("b")).where("a < b")
    order = F.col("doc_id") if several.isEmpty() else F.struct("doc_id", "no")
    given = keyed(docs).select(F.col(ID).alias("doc_id"), F.col(TEXT_ID).alias("no"), "text")
    spans = suffix.removed_word_spans(own, given, order)
    return spans.groupBy(F.col("doc_id").alias("id"), F.col("no").alias("text_id")).agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("words"))


def _left(text: str, removed: list[int], passages: list) -> tuple[str, list[tuple[int, int]]]:
    """The text without the lines and the runs of words, and the runs' places (code points) in lines that stay."""
    gone = set(removed)
    # places of words in code points
    x = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32)
    edge = np.flatnonzero(np.diff(((x == 32) | (x - 9 <= 4)).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    stays = ~np.isin(np.searchsorted(np.flatnonzero(x == 10) - 1, starts), removed)
    staying = np.concatenate(([0], np.cumsum(stays)))
    first, last = np.array(passages, np.int64).T
    runs = np.concatenate(([0], np.flatnonzero(first[1:] > np.maximum.accumulate(last)[:-1]) + 1))
    first, last = first[runs], np.maximum.reduceat(last, runs)
    cuts = staying[last] - staying[first] >= suffix.LENGTH
    spans = list(zip(starts[first[cuts]].tolist(), ends[last[cuts] - 1].tolist()))
    lines, cut, start, at = [], [], 0, 0
    for k, line in enumerate(text.split("\n")):
        end = start + len(line)
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        own, n = [], at
        while n < len(spans) and spans[n][0] < end:
            own.append((max(spans[n][0], start), min(spans[n][1], end)))
            n += 1
        if k not in gone:
            edges = [start, *[x for span in own for x in span], end]
            kept = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            cut += own
            if not own or re.search(WORD, kept):
                lines.append(kept)
        start = end + 1
    return "\n".join(lines), cut


def without_repeats(docs: DataFrame, removed: str = "removed", cut: str = "cut") -> DataFrame:
    """``docs`` with the text that is left, and two columns, added or replaced.

    ``removed``: the numbers of the removed lines; ``cut``: (start, end) in code points of the input text of what is cut
    out of other lines.
    """
    rows = written(sketched(docs))
    lines = repeated_lines(docs, rows).select(F.col("id").alias(ID), F.col("text_id").alias(TEXT_ID), F.col("removed").alias("__removed"))
    words = repeated_passages(docs, rows).select(F.col("id").alias(ID), F.col("text_id").alias(TEXT_ID), F.col("words").alias("__words"))
    found = cut_lineage(lines.join(words, [ID, TEXT_ID], "full"))
    given, key = keyed(docs), [ID, TEXT_ID]
    none = F.array().cast("array<int>"), F.array().cast("array<struct<start:int,end:int>>")
    gone = F.coalesce("__removed", none[0])
    inside = F.udf(lambda text, lines, firsts, ends: None if firsts is None else _left(text, lines, list(zip(firsts, ends))),
                   "text string, cut array<struct<start:int,end:int>>", useArrow=False)
    # texts go to Python only where passages are cut
    passages = inside(F.when(F.col("__words").isNotNull(), F.col("text")), gone, "__words.start", "__words.end")
    left = F.concat_ws("\n", F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__removed", i)))
    names = [c for c in docs.columns if c not in (removed, cut)]

    def judged(rows: DataFrame) -> DataFrame:
        return (rows.withColumn("__left", passages)
                .withColumn("text", F.when(F.col("__words").isNotNull(), F.col("__left.text"))
                            .when(F.col("__removed").isNull(), F.col("text")).otherwise(left))
                .select(*names, gone.alias(removed), F.coalesce("__left.cut", none[1]).alias(cut)))
    length = lambda c, n: n * F.greatest(F.size(c), F.lit(0)).cast("bigint")
    if (found.agg(F.sum(64 + length("__removed", 4) + length("__words", 32))).first()[0] or 0) <= FEW_BYTES:
        return judged(given.join(F.broadcast(found), key, "left"))
    of_found = marks.member(found, *key)
    # texts without repeats stay where they are
    return judged(given.where(of_found(*key)).join(found, key, "left")).unionByName(
        given.where(~of_found(*key)).select(*names, none[0].alias(removed), none[1].alias(cut)))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, paragraphs removed, runs of them and of words, bytes before, removed and left, and the digest, for every row."""
    text, runs = F.coalesce("text", F.lit("")), F.size(F.filter("removed", lambda x: ~F.array_contains("removed", x - 1)))
    given = docs.select("doc_id", "text", F.octet_length(text).cast("bigint").alias("n_bytes"))
    kept = F.octet_length(text).cast("bigint")
    return without_repeats(given).select(
        "doc_id", F.size("removed").cast("bigint").alias("n_removed"), (runs + F.size("cut")).cast("bigint").alias("n_spans"),
        "removed", kept.alias("n_kept_bytes"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"),
        "n_bytes", (F.col("n_bytes") - kept).alias("n_removed_bytes"), "cut")
