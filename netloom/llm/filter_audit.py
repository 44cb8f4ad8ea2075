"""Interaction of five text filters: what each removes, alone, after the others, in every order.

Filters A to D judge a text by itself; E rejects a text that a document with a smaller id has, too, anywhere in
the table. Exact copies are found with radix tries (compressed tries, whose edges are strings):

1. *Adaptive prefixes.* The texts' order is cut into ranges of about equal weight. Bounds are the shortest
   prefixes that separate neighbouring heads of a bounded sample of distinct texts (SAMPLE_ROWS, fitting only);
   heads that stand for too many texts are refined to longer ones until they are whole texts or light enough.
2. *Local tries.* Each task inserts its whole texts into a trie whose terminals hold the smallest id. A row with a
   larger id than its terminal's is a duplicate for certain and leaves as an id with its mask; of copies at most one
   row a task (and trie of TRIE_CHARS) is shuffled with its text, so that a text of a third of all rows is no hot key.
3. *Range tries.* A range arrives sorted, so its trie can be traversed and dropped between two different texts
   once it holds TRIE_CHARS; memory is bounded however uneven the ranges are.
4. *Masks.* What is left of a document is its id and a mask of five bits; masks join the labels by id and are
   counted by part. 32 counts a part give every order and step: a filter that fails with k others is the first to
   remove a text in 120 / k of the 120 orders.

Edge cases: NULL texts are empty; equal empty texts are copies, too; rows with equal ids never make each other
duplicates; rows without id come after all others and have no labels; a document with several labels counts as
good or toxic if any row says so; a NULL language is the part ''; an empty table gives no part, thus no rows;
further columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from netloom.llm.common import LAST_ID, WORD, map_stream, plain_rows
from netloom.session import cut_lineage

FILTERS = "ABCDE"
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
#: Texts a range should hold in bytes, rows that bounds are fitted on, characters of a trie in memory.
RANGE_BYTES, SAMPLE_ROWS, TRIE_CHARS = 64 << 20, 200_000, 16 << 20
#: Letters of a head at first and at most; longer ones only serve balance.
HEAD, LONGEST_HEAD = 16, 1 << 13
_UPPER, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"


def own_mask(text: str) -> int:
    """The bits of filters A to D; bytes.split() splits at exactly space and \\x09-\\x0d."""
    data = text.encode()
    words = data.split()
    upper = len(data) - len(data.translate(None, _UPPER))
    return (BIT["A"] * (len(words) < 100) | BIT["B"] * (100 * len(set(words)) < 80 * len(words))
            | BIT["C"] * (100 * upper > 10 * len(text)) | BIT["D"] * (len(data.translate(None, _SYMBOLS)) < len(data)))


class Trie:
    """A radix trie: an edge is a string, a node the edges below it by first letter, and its terminal if any."""

    __slots__ = ("edges", "terminal")

    def __init__(self):
        self.edges: dict[str, list] = {}
        self.terminal = None

    def insert(self, text: str, new: Callable):
        """The terminal of a text, made by ``new()`` where there is none."""
        node, at = self, 0
        while at < len(text):
            edge = node.edges.get(text[at])
            if edge is None:
                below = Trie()
                node.edges[text[at]] = [text[at:], below]
                node, at = below, len(text)
                break
            label, below = edge
            if text.startswith(label, at):
                node, at = below, at + len(label)
                continue
            same = _common(label, text, at)
            middle = Trie()
            middle.edges[label[same]] = [label[same:], below]
            edge[0], edge[1] = label[:same], middle
            node, at = middle, at + same
        if node.terminal is None:
            node.terminal = new()
        return node.terminal

    def terminals(self) -> Iterator[tuple[str, object]]:
        """(text, terminal) of all texts."""
        stack: list[tuple[str, Trie]] = [("", self)]
        while stack:
            text, node = stack.pop()
            if node.terminal is not None:
                yield text, node.terminal
            stack += [(text + label, below) for label, below in node.edges.values()]


def _common(label: str, text: str, at: int) -> int:
    """Letters that ``label`` and ``text`` from ``at`` on have in common (fewer than the label has)."""
    low, high = 0, len(label)
    while high - low > 1:
        middle = (low + high) // 2
        if text.startswith(label[:middle], at):
            low = middle
        else:
            high = middle
    return low


class Least:
    """A terminal: the smallest id seen, and the rows that have it, by part and mask."""

    __slots__ = ("id", "rows")

    def __init__(self):
        self.id, self.rows = None, {}

    def add(self, doc_id: int, part: str, mask: int, n: int) -> Iterator[tuple[int, str, int, int]]:
        """Takes rows in; gives out those that are duplicates for certain now."""
        if self.id is not None and doc_id > self.id:
            yield doc_id, part, mask | BIT["E"], n
            return
        if self.id is not None and doc_id < self.id:
            for (p, m), count in self.rows.items():
                yield self.id, p, m | BIT["E"], count
            self.rows = {}
        self.id = doc_id
        self.rows[part, mask] = self.rows.get((part, mask), 0) + n


def prefix_bounds(texts: DataFrame, ranges: int, rows: int) -> list[str]:
    """At most ``ranges`` - 1 prefixes that cut the order of the distinct texts in parts of about equal weight."""
    every = max(1, rows // SAMPLE_ROWS)
    sample = texts.withColumn("h", F.xxhash64("text")).where(F.pmod("h", F.lit(every)) == 0)  # all copies or none

    def heads(df: DataFrame, length: int) -> dict[str, int]:
        head = F.substring("text", 1, length).alias("head")
        return {r["head"]: r["n"] for r in df.select("h", head).distinct().groupBy("head").agg(F.count("*").alias("n")).collect()}

    weights, length = heads(sample, HEAD), HEAD
    light = max(1, sum(weights.values()) // (2 * ranges))
    while (heavy := [h for h, n in weights.items() if n > light and len(h) == length]) and length < LONGEST_HEAD:
        listed = texts.sparkSession.createDataFrame([(h,) for h in heavy], "head string").select(F.xxhash64("head").alias("key"))
        listed = F.broadcast(listed)  # 2 * ranges numbers at most
        longer = heads(sample.join(listed, F.xxhash64(F.substring("text", 1, length)) == F.col("key"), "left_semi"), length * 8)
        weights = {h: n for h, n in weights.items() if h not in set(heavy)} | longer
        length *= 8
    bounds, total, done, last = [], sum(weights.values()), 0, None
    for head in sorted(weights):
        if last is not None and done * ranges >= total * (len(bounds) + 1):
            same = next((i for i, (a, b) in enumerate(zip(last, head)) if a != b), min(len(last), len(head)))
            bounds.append(head[:same + 1])
        done, last = done + weights[head], head
    return bounds


def _spread_keys(docs: DataFrame, parts: int) -> list[int]:
    """For each of ``parts`` partitions a number that a repartition by hash puts there."""
    place = F.pmod(F.hash("id"), F.lit(parts))
    rows = docs.sparkSession.range(40 * parts).groupBy(place.alias("place")).agg(F.min("id").alias("id")).collect()
    found = {r["place"]: r["id"] for r in rows}
    return [found.get(i, i) for i in range(parts)]


_LOCAL = "key bigint, text string, doc_id bigint, part string, mask int, n bigint"


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask and n (rows): the failed filters of every row of ``docs``."""
    texts = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"),
                        F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size["bytes"] or 0) // RANGE_BYTES))
    plan = docs.sparkSession.sparkContext.broadcast((prefix_bounds(texts, ranges, size["n"]), _spread_keys(docs, ranges)))

    def local(batches):
        bounds, keys = plan.value
        trie, held, sure = Trie(), 0, 0

        def emit():
            for text, least in trie.terminals():
                key = keys[bisect.bisect_right(bounds, text)]
                for (part, mask), n in least.rows.items():
                    yield key, text, least.id, part, mask, n

        for doc_id, part, text in plain_rows(batches):
            least = trie.insert(text, Least)
            for row in least.add(doc_id, part, own_mask(text) if least.id is None else next(iter(least.rows))[1], 1):
                yield (keys[sure % len(keys)], None, *row)
                sure += 1
            held += len(text)
            if held >= TRIE_CHARS:
                yield from emit()
                trie, held = Trie(), 0
        yield from emit()

    def merged(batches):
        trie, held, last = Trie(), 0, None

        def emit():
            for _, least in trie.terminals():
                for (part, mask), n in least.rows.items():
                    yield least.id, part, mask, n

        for _, text, doc_id, part, mask, n in plain_rows(batches):
            if text is None:
                yield doc_id, part, mask, n
                continue
            if held >= TRIE_CHARS and text != last:
                yield from emit()
                trie, held = Trie(), 0
            yield from trie.insert(text, Least).add(doc_id, part, mask, n)
            held, last = held + len(text), text
        yield from emit()

    shuffled = map_stream(texts, _LOCAL, local).repartition(ranges, "key").sortWithinPartitions("text")
    return map_stream(shuffled, "doc_id bigint, part string, mask int, n bigint", merged)


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: rows by failed filters, and how many of them the labels call so."""
    flags = (labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id")
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad")))
    rows = masks(docs).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).join(flags, "doc_id", "left")
    of = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0).cast("bigint"))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good").alias("good"), of("bad").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    parts = cut_lineage(counted(docs, labels)).groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 at most
    steps = [(order, i + 1, sum(BIT[f] for f in order[:i]), BIT[order[i]])
             for order in map("".join, permutations(FILTERS)) for i in range(len(FILTERS))]
    listed = F.from_json(F.lit("[" + ",".join(
        f'{{"o":"{o}","s":{s},"before":{b},"bit":{f}}}' for o, s, b, f in steps) + "]"),
        "array<struct<o: string, s: int, before: int, bit: int>>")
    rows = parts.select("part", "masks", F.explode(listed).alias("at")).select(
        "part", F.col("at.o").alias("filter_order"), F.col("at.s").alias("step"), "masks", "at.before", "at.bit")
    before, bit = F.col("before"), F.col("bit")

    def total(take: Callable[[Column], Column], value: str = "n") -> Column:
        return F.aggregate(F.filter("masks", lambda x: take(x["mask"])), F.lit(0).cast("bigint"), lambda s, x: s + x[value])

    fails = lambda m: m.bitwiseAND(bit) != 0
    here = lambda m: fails(m) & (m.bitwiseAND(before) == 0)
    orders = len(steps) // len(FILTERS)
    share = F.aggregate(F.filter("masks", lambda x: fails(x["mask"])), F.lit(0).cast("bigint"),
                        lambda s, x: s + x["n"] * (F.lit(orders) / F.bit_count(x["mask"])).cast("bigint"))
    return rows.select(
        "part", "filter_order", "step", total(lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total(here).alias("removed"), total(lambda m: fails(m) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total(lambda m: m == bit).alias("unique_fails"), total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"), share.alias("shapley"))


def oracle_sql() -> str:
    """The same in DuckDB; copies by grouping whole texts."""
    words = f"regexp_extract_all(t, '{WORD.replace('x20', 'x{20}').replace('x09', 'x{09}').replace('x0D', 'x{0D}')}')"
    bits = "+".join(f"CASE WHEN {f} THEN {BIT[name]} ELSE 0 END" for f, name in (
        ("len(w) < 100", "A"), ("100 * len(list_distinct(w)) < 80 * len(w)", "B"),
        ("100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t)", "C"),
        ("regexp_matches(t, '[#$%&*|]')", "D"), ("least < id", "E")))
    joins = " ".join(f"JOIN f f{i} ON " + " AND ".join(f"f{i}.c <> f{j}.c" for j in range(i)) for i in range(1, 5))
    return f"""
WITH given AS (SELECT coalesce(doc_id, {LAST_ID}) AS id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
least AS (SELECT t, min(id) AS least FROM given GROUP BY t),
judged AS (SELECT id, part, {bits} AS mask FROM (SELECT given.*, least, {words} AS w FROM given JOIN least USING (t))),
flags AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
      FROM judged LEFT JOIN flags ON id = doc_id GROUP BY part, mask),
f AS (SELECT unnest(['A','B','C','D','E']) AS c),
orders AS (SELECT f0.c || f1.c || f2.c || f3.c || f4.c AS o FROM f f0 {joins}),
steps AS (SELECT o, s, (1 << (ascii(o[s]) - 65)) AS bit,
                 coalesce(list_sum([1 << (ascii(x) - 65) for x in string_split(o[1:s-1], '') if x <> '']), 0)::INT AS before
          FROM orders, range(1, 6) r(s)),
removed AS (SELECT part, o, s, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS here
            FROM m, steps GROUP BY part, o, s),
shares AS (SELECT part AS p, o[s] AS c, sum(here) AS shapley FROM removed GROUP BY part, o[s])
SELECT part, o AS filter_order, s::INT AS step,
  sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  any_value(shapley)::BIGINT AS shapley
FROM m CROSS JOIN steps JOIN shares ON shares.p = m.part AND shares.c = o[s] GROUP BY part, o, s"""
