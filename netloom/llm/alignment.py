"""Cross-tokenizer alignment: tokens of two vocabularies that end at the same bytes, counted corpus-wide.

Every text is encoded twice, by a byte-level vocabulary (side A, of a space and the text) and by a piece
vocabulary (side B, which adds that space itself). Byte offsets where a token of either side ends cut both
into groups; the A and the B token that end there are linked. A text's agreement is how often its linked id
pairs are linked in the whole corpus, so counts of all pairs have to come back to each text. That is an
external count over spilled runs:

1. *Runs.* A task gathers links up to RUN_LINKS, sorts them side-major (B id, A id, text) and spills them as
   zstd runs, one for each radix (B id modulo RADIXES): the pairs with their counts, and apart from these the
   pair-document records.
2. *Counting.* Runs of a radix are merged by a heap, FAN_IN at a time, until one is left; as pairs come side
   by side, the last merge gives each B id's highest count on the way.
3. *Contributions.* The counts go back to the runs of their radix, whose records turn into sums per text.

No task holds more than one run or FAN_IN merged ones; a pair that occurs in every text has one record for
each text, in as many runs as there are. What is counted of a radix is bounded by the two vocabularies, not by
the corpus, and travels to the runs by broadcast only if it is small (BROADCAST_BYTES), else by a join.

Edge cases: NULL and empty texts, and texts whose joined token bytes on either side differ from a space and
the text (the piece side may normalise), have no tokens: zeros and an empty groups_sha256. Rows with equal ids
or equal texts are rows of their own, each counted; rows without id too. Special tokens' strings are plain
text. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from netloom.llm.bpe import NOT_LATIN, byte_letters, vocabulary
from netloom.llm.common import written

RUN_LINKS, RADIXES, FAN_IN = 2_000_000, 16, 32
BROADCAST_BYTES = 64 << 20
#: Texts are encoded so many characters at a time.
BATCH_CHARS = 1 << 20
COMMA, BAR, SEMICOLON, END = range(4)


class Sides:
    """Both encoders, and for each side the bytes, lengths and decimal names of its tokens."""

    def __init__(self, byte_json: str, piece_model: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        given = json.loads(byte_json)
        special = {t["content"] for t in given.get("added_tokens", ())}
        letters = byte_letters()
        plain = {i: bytes(letters[c] for c in t) for t, i in given["model"]["vocab"].items() if t not in special}
        self.a_bytes = [plain.get(i, b"") for i in range(max(plain) + 1)]
        self.exact = Tokenizer.from_str(byte_json)
        self.exact.encode_special_tokens = True
        self.exact.no_truncation()
        self.exact.no_padding()
        # Fixed value: the pattern of byte-level vocabularies. Where no letter is outside Latin-1, the faster
        # library reads it alike; elsewhere their Unicode tables may differ by version.
        self.fast = tiktoken.Encoding(
            "a", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
            mergeable_ranks={b: i for i, b in plain.items()}, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.b_bytes = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.lengths = [np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes)]
        self.names = [np.array([[f"{i}{end}" for i in range(len(side))] for end in (",", "|", ";", "")], object)
                      for side in (self.a_bytes, self.b_bytes)]

    def _piece(self, i: int) -> bytes:
        name = self.pieces.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.pieces.is_byte(i) else name.replace("▁", " ").encode()

    def a_ids(self, text: str) -> list[int]:
        if len(text) < 1 << 16 and not NOT_LATIN.search(text):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides; none where a side does not give back the bytes."""
        out = []
        for text, b in zip(texts, self.pieces.encode(texts, num_threads=1)):
            want = b" " + text.encode()
            if not text or b"".join(map(self.b_bytes.__getitem__, b)) != want:
                out.append(([], []))
                continue
            a = self.a_ids(" " + text)
            out.append((a, b) if b"".join(map(self.a_bytes.__getitem__, a)) == want else ([], []))
        return out


def links(ids: list[tuple[list[int], list[int]]], sides: Sides) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of a batch of texts: A and B id of each link, links per text, and each text's groups as a string.

    Both sides of a text have the same bytes, so offsets may run on from text to text.
    """
    na, nb = np.array([len(a) for a, _ in ids]), np.array([len(b) for _, b in ids])
    a = np.fromiter((x for i, _ in ids for x in i), np.int64, int(na.sum()))
    b = np.fromiter((x for _, i in ids for x in i), np.int64, int(nb.sum()))
    if not len(a):
        return a, b, np.zeros(len(ids), np.int64), [""] * len(ids)
    ends_a, ends_b = np.cumsum(sides.lengths[0][a]), np.cumsum(sides.lengths[1][b])
    at = np.searchsorted(ends_b, ends_a)
    shared_a = ends_b[at] == ends_a
    last_a, last_b = np.flatnonzero(shared_a), at[shared_a]          # last token of each group, by side
    shared_b = np.zeros(len(b), bool)
    shared_b[last_b] = True
    until_a, until_b = np.cumsum(na), np.cumsum(nb)
    per_text = np.diff(np.searchsorted(last_a, until_a), prepend=0)
    # a group's A tokens stand before its B tokens
    group_a, group_b = np.cumsum(shared_a) - shared_a, np.cumsum(shared_b) - shared_b
    place_a = np.arange(len(a)) + np.concatenate(([0], last_b[:-1] + 1))[group_a]
    place_b = np.arange(len(b)) + last_a[group_b] + 1
    end_b = np.where(shared_b, SEMICOLON, COMMA)
    end_b[until_b[nb > 0] - 1] = END
    words = np.empty(len(a) + len(b), object)
    words[place_a] = sides.names[0][np.where(shared_a, BAR, COMMA), a]
    words[place_b] = sides.names[1][end_b, b]
    words, texts, done = words.tolist(), [], 0
    for until in (until_a + until_b).tolist():
        texts.append("".join(words[done:until]))
        done = until
    return a[last_a], b[last_b], per_text, texts


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as zstd of the narrowest type; the first byte is its width."""
    import zstandard

    kind = np.min_scalar_type(int(values.max()) if len(values) else 0)
    return bytes([kind.itemsize]) + zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), f"u{blob[0]}").astype(np.int64)


def _pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=0))


def _unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob))


def spill(pairs: np.ndarray, rows: np.ndarray) -> Iterator[tuple]:
    """Runs (radix, pairs, counts, records of each pair, rows, occurrences) of links: pair (B << 32 | A) and row."""
    order = np.lexsort((rows, pairs))
    pairs, rows = pairs[order], rows[order]
    first = np.flatnonzero(np.concatenate(([True], (pairs[1:] != pairs[:-1]) | (rows[1:] != rows[:-1]))))
    times = np.diff(first, append=len(pairs))
    pairs, rows = pairs[first], rows[first]
    radix = (pairs >> 32) % RADIXES
    for r in range(RADIXES):
        own = radix == r
        if not own.any():
            continue
        p, who, n = pairs[own], rows[own], times[own]
        start = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        # row numbers rise within a pair: their differences are small, and a new pair starts anew
        step = np.diff(who, prepend=0)
        step[start] = who[start]
        yield (r, _pack_sorted(p[start]), pack(np.add.reduceat(n, start)), pack(np.diff(start, append=len(p))),
               pack(step), pack(n))


def records(lengths: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The rows of a run's records again."""
    total = np.cumsum(step)
    start = np.cumsum(lengths) - lengths
    before = total[start] - step[start]
    return total - np.repeat(before, lengths)


_SPILLED = ("kind string, row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, "
            "radix int, run bigint, rows binary, pairs binary, counts binary, lengths binary, steps binary, times binary")
_LOADED: dict[str, Sides] = {}


def _sides(byte_json: str, piece_model: bytes) -> Sides:
    """One pair of encoders for each worker process."""
    name = hashlib.md5(byte_json.encode() + piece_model).hexdigest()
    if name not in _LOADED:
        _LOADED[name] = Sides(byte_json, piece_model)
    return _LOADED[name]


def _batches(texts: Iterable[tuple]) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in texts:
        held.append(row)
        size += len(row[1]) + 1
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def spilled(docs: DataFrame, byte_json: str, piece_model: bytes) -> DataFrame:
    """One row for each text (kind text: its figures) and for each run (kind run); written, as it is read twice."""
    given = docs.sparkSession.sparkContext.broadcast((byte_json, piece_model))  # two vocabularies: a few MB
    out = StructType.fromDDL(_SPILLED)
    names = out.names

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, sides = to_arrow_schema(out), _sides(*given.value)
        base, done = TaskContext.get().partitionId() << 40, 0
        held: list[tuple[np.ndarray, np.ndarray, int]] = []

        def table(rows: list[dict]):
            return pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in names}, schema=arrow)

        def runs():
            pairs, rows = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            start, number = int(rows.min()), base + int(rows.min())
            packed = _pack_sorted(np.unique(rows) - start)
            local = np.searchsorted(np.unique(rows), rows)
            for r, *blobs in spill(pairs, local):
                yield table([{"kind": "run", "radix": r, "run": number, "rows": packed}
                             | dict(zip(names[-5:], blobs))])
            held.clear()

        def texts():
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    yield from zip(part.column(0).to_pylist(), (t or "" for t in part.column(1).to_pylist()))

        for part in _batches(texts()):
            ids = sides.encode([text for _, text in part])
            a, b, per_text, groups = links(ids, sides)
            yield table([{"kind": "text", "row": base + done + i, "doc_id": doc_id, "n_a": len(x), "n_b": len(y),
                          "n_groups": n, "groups_sha256": hashlib.sha256(g.encode()).hexdigest() if g else ""}
                         for i, ((doc_id, _), (x, y), n, g) in enumerate(zip(part, ids, per_text.tolist(), groups))])
            # a text of any length is cut into runs of at most RUN_LINKS
            pairs, rows = b << 32 | a, np.repeat(done + np.arange(len(part)), per_text)
            done += len(part)
            while len(pairs):
                room = RUN_LINKS - sum(h[2] for h in held)
                held.append((pairs[:room], rows[:room], len(pairs[:room])))
                pairs, rows = pairs[room:], rows[room:]
                if sum(h[2] for h in held) >= RUN_LINKS:
                    yield from runs()
        if held:
            yield from runs()

    return written(docs.select("doc_id", "text").mapInArrow(run, out))


def heap_merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """(pair, count) in order from sorted runs of them."""
    last, total = -1, 0
    for pair, n in heapq.merge(*(zip(p.tolist(), c.tolist()) for p, c in runs)):
        if pair != last:
            if total:
                yield last, total
            last, total = pair, 0
        total += n
    if total:
        yield last, total


def with_maxima(counted: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(pair, count, 1 if no pair of the same B id has more) from side-major pairs; a B id's pairs are held only."""
    held: list[tuple[int, int]] = []

    def side():
        most = max(n for _, n in held)
        return [(p, n, int(n == most)) for p, n in held]

    for pair, n in counted:
        if held and held[-1][0] >> 32 != pair >> 32:
            yield from side()
            held = []
        held.append((pair, n))
    if held:
        yield from side()


_COUNTED = "radix int, run bigint, pairs binary, counts binary, best binary"


def counts(runs: DataFrame) -> DataFrame:
    """One row for each radix: its pairs in order, their counts, and which are the highest of their B id."""
    left = runs.select("radix", "run", "pairs", "counts")
    most = left.groupBy("radix").count().agg(F.max("count")).first()[0] or 0
    while True:
        groups = max(1, -(-most // FAN_IN))
        dealt = left.withColumn("run", F.pmod(F.xxhash64("run"), F.lit(groups)))
        left = written(dealt.groupBy("radix", "run").applyInPandas(_merging(groups == 1), _COUNTED))
        if groups == 1:
            return left
        left, most = left.select("radix", "run", "pairs", "counts"), groups


def _merging(final: bool):
    """Merges the runs of a group to one, the last time with the maxima of B ids."""
    def merge(key, pdf):
        import pandas as pd

        merged = heap_merged([(_unpack_sorted(p), unpack(c)) for p, c in zip(pdf["pairs"], pdf["counts"])])
        found = np.array(list(with_maxima(merged) if final else ((p, n, 0) for p, n in merged)), np.int64).reshape(-1, 3)
        return pd.DataFrame({"radix": [key[0]], "run": [key[1]], "pairs": [_pack_sorted(found[:, 0])],
                             "counts": [pack(found[:, 1])], "best": [pack(found[:, 2])]})
    return merge


def contributions(runs: DataFrame, counted: DataFrame) -> DataFrame:
    """row, n_best and count_sum of each text and radix; runs take the counts of their radix by broadcast or join."""
    size = counted.agg(F.sum(F.octet_length("pairs") + F.octet_length("counts"))).first()[0] or 0
    table = counted.select("radix", F.col("pairs").alias("known"), F.col("counts").alias("known_counts"), "best")
    if size <= BROADCAST_BYTES:
        joined = runs.where("kind = 'run'").join(F.broadcast(table), "radix")
    else:  # one copy of the counts for each slice of runs, so that a radix is as many tasks as it needs
        slices = max(1, runs.where("kind = 'run'").count() // (RADIXES * FAN_IN))
        table = table.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        joined = runs.where("kind = 'run'").withColumn(
            "slice", F.pmod(F.xxhash64("run"), F.lit(slices)).cast("int")).join(table, ["radix", "slice"])
    schema = "row bigint, n_best bigint, count_sum bigint"

    def back(batches):
        import pyarrow as pa

        held, table = None, ()
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(i)[r].as_py() for i, n in enumerate(batch.schema.names)}
                if held != row["known"]:
                    held, table = row["known"], (_unpack_sorted(row["known"]), unpack(row["known_counts"]), unpack(row["best"]))
                pairs, lengths, times = _unpack_sorted(row["pairs"]), unpack(row["lengths"]), unpack(row["times"])
                at = np.searchsorted(table[0], pairs)
                who = records(lengths, unpack(row["steps"]))
                rows = _unpack_sorted(row["rows"]) + row["run"]
                total, best = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                np.add.at(total, who, times * np.repeat(table[1][at], lengths))
                np.add.at(best, who, times * np.repeat(table[2][at], lengths))
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(rows[some]), pa.array(best[some]), pa.array(total[some])],
                                                 names=["row", "n_best", "count_sum"])

    return joined.select("radix", "run", "rows", "pairs", "lengths", "steps", "times", "known", "known_counts", "best"
                         ).mapInArrow(back, schema)


def aligned(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    with open(piece_path, "rb") as file:
        rows = spilled(docs, vocabulary(byte_path), file.read())
    runs = rows.where("kind = 'run'")
    sums = contributions(rows, counts(runs)).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    return (rows.where("kind = 'text'").join(sums, "row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
                    F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"),
                    "groups_sha256"))


def pair_counts(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """The alignment table itself: id_b, id_a, links (corpus-wide) and best (no A id is linked with id_b more often)."""
    with open(piece_path, "rb") as file:
        counted = counts(spilled(docs, vocabulary(byte_path), file.read()).where("kind = 'run'"))

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for pairs, n, best in zip(*[batch.column(c).to_pylist() for c in ("pairs", "counts", "best")]):
                pairs = _unpack_sorted(pairs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)),
                     pa.array(unpack(n)), pa.array(unpack(best) == 1)], names=["id_b", "id_a", "links", "best"])
    return counted.mapInArrow(rows, "id_b int, id_a int, links bigint, best boolean")
