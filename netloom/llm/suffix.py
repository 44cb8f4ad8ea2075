"""Exact removal of repeated strings by distributed prefix doubling over sampled positions.

Every 50-byte string that also starts in a document with a smaller id loses its bytes. Ranks of the
strings at all positions double in length: 1, 2, 4 and 8 bytes are exact numbers, 16, 24, 25 and 50 bytes are
64-bit fingerprints of the pair of ranks at p and p + offset. Inside a text that is array work; what has
to meet across documents is ranked by Spark, and positions drop out as soon as they are unique:

1. *24 bytes, sampled.* Of the 27 strings of 24 bytes in each 50-byte string, the one with the smallest
   fingerprint is its anchor. Equal 50-byte strings have equal anchors, and neighbouring ones mostly share
   theirs, so about one position in 14 is ranked. Anchors found in one document alone drop out.
2. *Blocks.* The 50-byte strings that share an anchor form a block, known by the ranks of its first and
   last string. A block that a smaller document has too is removed as a whole.
3. *50 bytes.* Only where one anchor has different blocks (the ends of a repeat, or around an edit) the
   strings of one block of each kind are ranked one by one.

Over bytes (`removed_byte_spans`) what drops out is not shuffled. Bitmaps (`marks`) tell the anchors that several rows
have, the smallest document of each block, and the 50-byte strings that several rows are asked for. Who has a block and
is not marked as its smallest document loses it; a document marked by mistake is asked string by string like the
smallest one, which costs rows and changes nothing. Repeated strings side by side form runs, known like blocks, and what
smaller documents do not have as a run is joined by single strings, exactly. Each bitmap asks for one more pass over the
texts, which stay where they are. Over words, which are few and dear to hash, anchors are written, and a bitmap tells
which rows go on (`removed_word_spans`).

Exact copies of whole texts are found first, by digest. Groups are only ever counted and joined, never
gathered; joins back to the texts move only texts that need it. Ranks are 64-bit fingerprints, so
different strings may be taken for equal with probability 2**-64 a pair.

Edge cases: NULL and empty texts have no bytes; texts below 50 bytes lose none; rows with equal ids do not
remove from each other, and each is judged by its own text; rows without id keep all and remove nothing; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from netloom.llm import marks, near
from netloom.llm.common import map_arrow, map_batches, written
from netloom.llm.words import Words, parts, words
from netloom.session import cut_lineage

LENGTH, ANCHOR = 50, 24
_U = np.uint64


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprint of two ranks, in few passes over the array."""
    h = a * _U(0x9E3779B97F4A7C15)
    h += b
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    return h


def _longer(x8: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of 24 and of 50 units from those of 8, at all positions where 50 fit."""
    x16 = _pair(x8[:-8], x8[8:])
    x25 = _pair(x16[:-9], x16[9:])
    return _pair(x16[:-8], x8[16:]), _pair(x25[:-25], x25[25:])


def ranks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the 24-byte and of the 50-byte strings at all positions where they fit; none if no 50 do."""
    x = np.frombuffer(text.encode(), np.uint8).astype(_U)
    if len(x) < LENGTH:
        return np.empty(0, _U), np.empty(0, _U)
    x = x[:-1] << _U(8) | x[1:]
    x = x[:-2] << _U(16) | x[2:]
    return _longer(x[:-4] << _U(32) | x[4:])


def word_ranks(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the runs of 24 and of 50 words at all places where 50 fit, from the words' hashes."""
    if len(hashes) < LENGTH:
        return np.empty(0, _U), np.empty(0, _U)
    for step in (1, 2, 4):
        hashes = _pair(hashes[:-step], hashes[step:])
    return _longer(hashes)


def blocks(x24: np.ndarray, x50: np.ndarray, places: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(anchor rank, block rank, first start, last start) of each run of 50-unit strings with one anchor.

    ``places``: of several texts side by side, the starts at which 50 units lie in one text; a gap ends a run.
    """
    if not len(x50) or places is not None and not len(places):
        none = np.empty(0, np.int64)
        return none, none, none, none
    # smallest rank in each window of 27, by doubling; of equal ones the first place, found below
    width, least = LENGTH - ANCHOR + 1, x24
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:len(x50)], least[width - span:width - span + len(x50)])
    ends = least[1:] != least[:-1]
    if places is not None:
        least, x50 = least[places], x50[places]
        ends = (least[1:] != least[:-1]) | (places[1:] != places[:-1] + 1)
    edge = np.flatnonzero(ends) + 1
    first = np.concatenate(([0], edge))
    last = np.concatenate((edge - 1, [len(x50) - 1]))
    # a run of equal anchors may be longer than one anchor's windows, if it repeats: cut it
    if (last - first).max() >= width:
        starts = [np.arange(a, b + 1, width) for a, b in zip(first, last)]
        last = np.concatenate([np.minimum(s + width - 1, b) for s, b in zip(starts, last)])
        first = np.concatenate(starts)
    block = _pair(x50[first], x50[last]) + near.mix((last - first).astype(_U))
    own = least[first].astype(np.int64), block.astype(np.int64)
    return (*own, first, last) if places is None else (*own, places[first], places[last])


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``no``: 0, or the rank of the text among the rows of an id that has several."""
    docs = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    several = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if several.isEmpty():
        return docs.withColumn("no", F.lit(0))
    keys = near.few(cut_lineage(several.select("doc_id")))
    texts = docs.join(keys, "doc_id").select("doc_id", F.md5("text").alias("m")).distinct()
    ranked = cut_lineage(texts.withColumn("no", F.row_number().over(Window.partitionBy("doc_id").orderBy("m"))))
    return (docs.withColumn("m", F.md5("text")).join(near.few(ranked), ["doc_id", "m"], "left")
            .select("doc_id", "text", F.coalesce("no", F.lit(0)).alias("no")))


def removed_word_spans(rows: DataFrame, docs: DataFrame, order: Column) -> DataFrame:
    """doc_id, no, start and end (in words) of runs of 50 words that an earlier document has, too (they may overlap).

    ``rows``: a written table of doc_id, no and the arrays of `word_blocks`; ``docs``: doc_id, no and text; ``order``, made of doc_id
    and no, tells which document comes first.
    """
    key = f"doc_id bigint, no {docs.schema['no'].dataType.simpleString()}"

    def anchors(given):
        own = given.column("anchors")
        values, text = own.flatten().to_numpy(), np.repeat(np.arange(given.num_rows), own.value_lengths())
        order = np.lexsort((values, text))
        values, text = values[order], text[order]
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
        yield values[fresh].view(_U)
    # one row's anchors, and a few more, spare rows only: they have one block, or strings that no other document has
    n = rows.agg(F.sum(F.size("anchors"))).first()[0] or 0
    shared = marks.marked(rows.select("anchors"), lambda: anchors, marks.places_of(n), 2)

    def start_met():
        has = marks.reader(shared)

        def batch(given):
            values, blocks, spans = [given.column(c).flatten().to_numpy() for c in ("anchors", "blocks", "spans")]
            at = np.flatnonzero(has(values.view(_U)))
            text = np.repeat(np.arange(given.num_rows), given.column("anchors").value_lengths())[at]
            yield (given.column("doc_id").take(text), given.column("no").take(text), values[at], blocks[at],
                   spans[at] >> 6, (spans[at] >> 6) + (spans[at] & 63))
        return batch
    met = written(map_arrow(rows, f"{key}, anchor bigint, block bigint, first int, last int", start_met))
    leaders = met.groupBy("anchor", "block").agg(F.min(order).alias("least"))
    leaders = cut_lineage(leaders)
    mixed = leaders.groupBy("anchor").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a < b").select("anchor")
    judged = met.join(leaders, ["anchor", "block"])
    whole = judged.where(order > F.col("least")).select("doc_id", "no", "first", "last")
    # one block of each kind stands for all of them
    asked = (judged.where(order == F.col("least")).join(mixed, "anchor").groupBy("doc_id", "no")
             .agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans")))
    asked = cut_lineage(asked)
    if asked.count() <= marks.FEW:
        texts = docs.join(F.broadcast(asked.select("doc_id", "no")), ["doc_id", "no"], "left_semi")
    else:
        texts = docs.where(marks.member(asked, "doc_id", "no")("doc_id", "no"))
    texts = texts.join(asked, ["doc_id", "no"])
    strings = written(map_arrow(texts.select("doc_id", "no", "text", F.col("spans.first").alias("firsts"),
                                             F.col("spans.last").alias("lasts")), f"{key}, rank bigint, at int", lambda: _word_strings))
    earlier = (strings.groupBy("rank").agg(F.min(order).alias("least"), F.max(order).alias("most"))
               .where("least < most").select("rank", "least"))
    single = strings.join(earlier, "rank").where(order > F.col("least")).select(
        "doc_id", "no", F.col("at").alias("first"), F.col("at").alias("last"))
    return whole.unionByName(single).select("doc_id", "no", F.col("first").alias("start"),
                                            (F.col("last") + LENGTH).alias("end"))


def word_blocks(own: Words) -> tuple[np.ndarray, ...]:
    """anchors, blocks, spans and, for each text and behind the last one, the first of them; places count from the text's first word."""
    sizes = np.maximum(np.diff(own.bounds) - LENGTH + 1, 0)
    places = np.arange(sizes.sum()) + np.repeat(own.bounds[:-1] - np.cumsum(sizes) + sizes, sizes)
    anchor, block, first, last = blocks(*word_ranks(own.hashes), places)
    text = np.searchsorted(own.bounds, first, "right") - 1
    # first and last start in one number: a block has at most 27 of them
    return anchor, block, first - own.bounds[text] << 6 | last - first, np.searchsorted(text, np.arange(len(sizes) + 1))


def _word_strings(given):
    """doc_id, no, rank and place of the asked runs of 50 words."""
    for part in parts(given, "text"):
        ids, nos, texts, firsts, lasts = part.columns
        own = words(texts.cast("binary").to_pylist())
        _, x50 = word_ranks(own.hashes)
        asked = np.repeat(own.bounds[:-1], firsts.value_lengths().to_numpy())
        n = len(x50) + 1
        first, last = asked + firsts.flatten().to_numpy(), asked + lasts.flatten().to_numpy()
        # rows that are there twice ask twice
        at = np.flatnonzero(np.cumsum(np.bincount(first, minlength=n) - np.bincount(last + 1, minlength=n)))
        text = np.searchsorted(own.bounds, at, "right") - 1
        yield ids.to_numpy()[text], nos.to_numpy()[text], x50[at].astype(np.int64), at - own.bounds[text]


def removed_byte_spans(docs: DataFrame) -> DataFrame:
    """doc_id, no, start and end of removed bytes (they may overlap), of documents that are no exact copy."""
    texts, key = docs.select("doc_id", "no", "text"), "doc_id bigint, no int"
    sizes = marks.places_for(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)

    def slices(given):
        for at in range(0, given.num_rows, 64):
            yield [c.to_pylist() for c in given.slice(at, 64).columns]

    def anchors(given):
        for _, _, own in slices(given):
            for text in own:
                yield np.unique(blocks(*ranks(text))[0].view(_U))
    shared = marks.marked(texts, lambda: anchors, sizes, 2)

    def start_blocks():
        has = marks.reader(shared)

        def batch(ids, texts):
            found = []
            for text in texts:
                anchor, block, _, _ = blocks(*ranks(text))
                found.append(block[has(anchor.view(_U))])
            return np.repeat(np.array(ids, np.int64), [len(f) for f in found]), np.concatenate(found)
        return batch

    # The smallest document of each block. Whoever has the block and is not marked comes later.
    def of_id(block: np.ndarray, ids: np.ndarray | np.int64) -> np.ndarray:
        return _pair(block.view(_U), near.mix(ids.astype(_U)))

    def firsts(given):
        yield of_id(*[c.to_numpy() for c in given.columns])
    least = (map_batches(texts.select("doc_id", "text"), "doc_id bigint, block bigint", start_blocks)
             .groupBy("block").agg(F.min("doc_id").alias("least")))
    first = marks.marked(least, lambda: firsts, sizes, 1)

    def start_judged():
        has, is_first = marks.reader(shared), marks.reader(first)

        def judged(i: int, text: str) -> tuple[np.ndarray, ...]:
            """Ranks of 50 bytes; first and last starts of blocks of earlier documents; those of blocks to rank."""
            x24, x50 = ranks(text)
            anchor, block, a, b = blocks(x24, x50)
            met = has(anchor.view(_U))
            block, a, b = block[met], a[met], b[met]
            own = is_first(of_id(block, np.full(len(block), i, np.int64)))
            return x50, a[~own], b[~own], a[own], b[own]
        return judged

    def start_strings():
        judged = start_judged()

        def strings_of(given):
            for ids, _, own in slices(given):
                for i, text in zip(ids, own):
                    x50, _, _, a, b = judged(i, text)
                    yield np.unique(x50[_inside(a, b, len(x50))])
        return strings_of
    repeated = marks.marked(texts, start_strings, sizes, 2)

    def start_runs():
        judged, has = start_judged(), marks.reader(repeated)

        def rows(i, text):
            x50, a, b, asked, ends = judged(i, text)
            # what is removed as a whole has no ranks
            gone = np.flatnonzero(np.diff(_inside(a, b, len(x50)).astype(np.int8), prepend=0, append=0))
            at = np.flatnonzero(_inside(asked, ends, len(x50)))
            at = at[has(x50[at])]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | np.isin(at[1:], asked)
            edge = np.flatnonzero(new)
            p, q = at[edge], at[np.append(edge[1:], len(at))[:len(edge)] - 1]
            run = _pair(x50[p], x50[q]) + near.mix((q - p).astype(_U))
            n = len(gone) // 2
            return (np.concatenate([gone[::2], p]), np.concatenate([gone[1::2] - 1, q]),
                    np.concatenate([np.zeros(n, np.int64), run.astype(np.int64)]),
                    [none] * n + (np.split(x50[at].astype(np.int64), edge[1:]) if len(at) else []))

        def batch(ids, nos, texts):
            made = [rows(*row) for row in zip(ids, texts)]
            n = [len(m[0]) for m in made]
            return (np.repeat(np.array(ids, np.int64), n), np.repeat(np.array(nos, np.int32), n),
                    *[np.concatenate([m[k] for m in made]).astype(t) for k, t in enumerate((np.int32, np.int32, np.int64))],
                    [r for m in made for r in m[3]])
        none = np.empty(0, np.int64)
        return batch
    # Repeated strings of a block that stand side by side are a run, judged as a block is.
    found = written(map_batches(texts, f"{key}, first int, last int, run bigint, ranks array<bigint>", start_runs))
    ends = F.min("doc_id").alias("least"), F.max("doc_id").alias("most")
    runs = found.where("size(ranks) > 0")
    heads = written(runs.groupBy("run").agg(*ends).where("least < most").select("run", "least"))
    met = runs.join(heads.hint("merge"), "run", "left")
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    strings = written(met.where(~later).select("doc_id", "no", "first", F.posexplode("ranks").alias("k", "rank"))
                      .select("doc_id", "no", (F.col("first") + F.col("k")).alias("at"), "rank"))
    earlier = written(strings.groupBy("rank").agg(*ends).where("least < most").select("rank", "least"))
    single = strings.join(earlier.hint("merge"), "rank").where("doc_id > least")
    spans = (found.where("size(ranks) = 0").select("doc_id", "no", "first", "last")
             .unionByName(met.where(later).select("doc_id", "no", "first", "last"))
             .unionByName(single.select("doc_id", "no", F.col("at").alias("first"), F.col("at").alias("last"))))
    return spans.select("doc_id", "no", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end"))


def _inside(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges; no two of them overlap."""
    edge = np.zeros(n + 1, np.int8)
    edge[first] += 1
    edge[last + 1] -= 1
    return np.cumsum(edge[:n], dtype=np.int8) > 0


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the bytes left, for every row."""
    given = _numbered(docs)
    texts = given.select("doc_id", "no", F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
                         F.octet_length("text").alias("n"))
    least = texts.where(F.col("n") >= LENGTH).groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least")
    copies = cut_lineage(texts.join(least, "digest").where("doc_id > least").select("doc_id", "no").distinct())
    known = near.few(copies)
    own = given.join(known, ["doc_id", "no"], "left_anti")
    spans = written(removed_byte_spans(own).groupBy("doc_id", "no").agg(
        F.collect_list(F.struct("start", "end")).alias("spans")))
    touched = near.few(spans.select("doc_id", "no"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    changed = map_batches(own.join(touched, ["doc_id", "no"], "left_semi").join(spans, ["doc_id", "no"])
                          .select("doc_id", "text", "spans"), schema, lambda: _cut)
    text = F.coalesce("text", F.lit(""))
    untouched = own.join(touched, ["doc_id", "no"], "left_anti").select("doc_id", "text").unionByName(
        docs.where("doc_id is null").select("doc_id", "text"))
    zero, none = F.lit(0).cast("bigint"), F.sha2(F.lit("").cast("binary"), 256)
    n = F.octet_length(text).cast("bigint")
    kept = untouched.select("doc_id", n.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
                            F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
    lost = given.join(known, ["doc_id", "no"], "left_semi").select(
        "doc_id", n.alias("n_bytes"), n.alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), none.alias("kept_sha256"))
    return changed.unionByName(kept).unionByName(lost)


def _cut(ids, texts, spans):
    out: list[list] = [[], [], [], [], []]
    for i, text, own in zip(ids, texts, spans):
        data = text.encode()
        edge = np.zeros(len(data) + 1, np.int64)
        np.add.at(edge, [s["start"] for s in own], 1)
        np.add.at(edge, [s["end"] for s in own], -1)
        gone = np.cumsum(edge[:-1]) > 0
        left = np.frombuffer(data, np.uint8)[~gone].tobytes()
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        for column, value in zip(out, (i, len(data), int(gone.sum()), runs, hashlib.sha256(left).hexdigest())):
            column.append(value)
    return out
