"""Quality rules whose limits come from the data, per language and source.

Each text gives counts (one pass in Arrow batches, whole text); each (language, source) gets a quantile
sketch of every rule's measure, and a text fails a rule if its measure lies beyond the fence that the
quantiles of its own group set. The sketch is a histogram with a relative error: values below
2 * LINES are kept exactly, larger ones in bins of 1 / LINES of their size. Sketches merge by adding
counts, so Spark sums them before anything moves, their size depends on the range of values alone, and
the result is the same however rows were dealt out (sampling sketches would differ from run to run).
Groups with fewer than GROUP_ROWS texts use the merged sketch of their language, languages with fewer
the sketch of all texts.

Measures, as integers: mean length of words in hundredths; symbols, words in repeated windows of
eight, and words equal to the one before, per thousand words; repeated lines per thousand lines. Fences: above the upper quartile by
FENCE interquartile ranges, below the lower quartile likewise for word length; a range counts as
at least LEAST_RANGE, so that a group without any spread does not fail for one odd sign.

Edge cases: NULL texts have no words and fail the base rule; NULL languages and sources are groups of
their own; rows with equal ids are judged one by one; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import re
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from netloom.llm.common import WORD, map_rows
from netloom.session import cut_lineage

# Fixed values of the base rule.
SYMBOLS = frozenset("#*$%&|<>")
RUN = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
LINES = 64
GROUP_ROWS = 200
FENCE = 3
LEAST_RANGE = {"word_length": 50, "symbols": 60, "repeats": 100, "stutter": 60, "dup_lines": 150}
_WORD, _SYMBOL = re.compile(WORD), re.compile(r"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stutter", "n_lines")


def repeated_words(words: list[str], run: int = RUN) -> int:
    """Words in windows of ``run`` words that the text has twice or more.

    Windows are compared by a 64-bit hash of their words' numbers, and equal hashes by the words.
    """
    n = len(words) - run + 1
    if n < 2:
        return 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    if len(numbers) == len(words):
        return 0
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    hashes = np.zeros(n, np.uint64)
    for i in range(run):
        hashes = hashes * np.uint64(0xD6E8FEB86659FD93) + mixed[i:i + n]
    order = np.argsort(hashes, kind="stable")
    equal = hashes[order][1:] == hashes[order][:-1]
    if not equal.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][equal]] = True
    maybe[order[:-1][equal]] = True
    starts = np.flatnonzero(maybe)
    counts: dict[bytes, int] = {}
    keys = [ids[i:i + run].tobytes() for i in starts]
    for key in keys:
        counts[key] = counts.get(key, 0) + 1
    edge = np.zeros(len(words) + 1, np.int64)
    hits = starts[[counts[k] > 1 for k in keys]]
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + run, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def count(text: str) -> tuple[int, ...]:
    """COUNTS of a whole text."""
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return (len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)),
            repeated_words(words), sum(map(eq, words, words[1:])), len(lines))


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and COUNTS of each row."""
    def start():
        return lambda doc_id, lang, source, text: [(doc_id, lang, source, *count(text or ""))]
    return map_rows(docs.select("doc_id", "lang", "source", "text"), "doc_id bigint, lang string, source string, "
                    + ", ".join(f"{c} bigint" for c in COUNTS), start)


def _per(part: str, whole: str, factor: int) -> Column:
    """Rounded down, in integers."""
    return F.when(F.col(whole) > 0, F.expr(f"{part} * {factor} div {whole}")).otherwise(F.lit(0)).cast("bigint")


MEASURES = {"word_length": ("word_chars", "n_words", 100), "symbols": ("n_symbols", "n_words", 1000),
            "repeats": ("n_repeat_words", "n_words", 1000), "stutter": ("n_stutter", "n_words", 1000),
            "dup_lines": ("n_dup_lines", "n_lines", 1000)}


def sketch(counts: DataFrame) -> DataFrame:
    """lang, source, measure, bin and n: the mergeable sketch of each group and measure (of texts with words)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), _per(*how).alias("x")) for m, how in MEASURES.items()])
    return (counts.where("n_words > 0").select("lang", "source", F.explode(pairs).alias("p"))
            .select("lang", "source", "p.*")
            # so many low bits are dropped that the leading LINES.bit_length() ones stay
            .withColumn("low_bits", F.greatest(F.length(F.bin("x")) - LINES.bit_length(), F.lit(0)))
            .withColumn("bin", F.expr("shiftleft(shiftright(x, low_bits), low_bits)"))
            .groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n")))


def _fences(merged: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and measure: the number of texts, and the lower and upper fence."""
    group = Window.partitionBy(*keys, "measure")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumns({"upto": F.sum("n").over(upto), "rows": F.sum("n").over(group)})
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("rows"), F.col("bin")))
    least = F.create_map(*[F.lit(x) for pair in LEAST_RANGE.items() for x in pair])
    width = F.greatest(F.col("q3") - F.col("q1"), least[F.col("measure")])
    return (ranked.groupBy(*keys, "measure")
            .agg(F.max("rows").alias("rows"), quartile(1).alias("q1"), quartile(3).alias("q3"))
            .select(*keys, "measure", "rows", (F.col("q1") - FENCE * width).alias("low"),
                    (F.col("q3") + FENCE * width).alias("high")))


def limits(counts: DataFrame) -> DataFrame:
    """One row per (lang, source): a struct (low, high) for each measure, from its own sketch or a merged one."""
    own = cut_lineage(sketch(counts))  # groups times bins: small
    by_lang = own.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n"))
    by_all = by_lang.groupBy("measure", "bin").agg(F.sum("n").alias("n"))
    a, b, c = (_fences(own, ["lang", "source"]).alias("a"), _fences(by_lang, ["lang"]).alias("b"),
               _fences(by_all, []).alias("c"))
    pick = lambda x: (F.when(F.col("a.rows") >= GROUP_ROWS, F.col(f"a.{x}"))
                      .when(F.col("b.rows") >= GROUP_ROWS, F.col(f"b.{x}")).otherwise(F.col(f"c.{x}")))
    same_lang = F.col("a.lang").eqNullSafe(F.col("b.lang"))
    chosen = (a.join(b, same_lang & (F.col("a.measure") == F.col("b.measure")))
              .join(c, F.col("a.measure") == F.col("c.measure"))
              .select("a.lang", "a.source", "a.measure", pick("low").alias("low"), pick("high").alias("high")))
    return chosen.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("measure") == m, F.struct("low", "high"))).alias(f"{m}_limits") for m in MEASURES])


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, failed (rules beyond a fence, comma-joined) and kept of every row."""
    counts = cut_lineage(text_counts(docs))  # numbers only: a small part of the texts' size
    limit = limits(counts).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    judged = counts.join(limit, F.col("lang").eqNullSafe(F.col("_lang"))
                         & F.col("source").eqNullSafe(F.col("_source")), "left")
    failed = F.concat_ws(",", *[
        F.when(~_per(*how).between(F.col(f"{m}_limits.low"), F.col(f"{m}_limits.high")), F.lit(m))
        for m, how in MEASURES.items()])
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), failed.alias("failed")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("failed") == ""))


def oracle_sql(table: str = "documents") -> str:
    """The same rows in DuckDB, for unique ids."""
    word, b = r"[^\x20\x09-\x0D]+", LINES.bit_length()
    per = {m: f"CASE WHEN {w} > 0 THEN {p} * {f} // {w} ELSE 0 END" for m, (p, w, f) in MEASURES.items()}
    least = " ".join(f"WHEN '{m}' THEN {x}" for m, x in LEAST_RANGE.items())
    measure = ", ".join(f"{{'measure': '{m}', 'x': ({how})::BIGINT}}" for m, how in per.items())

    def fences(source: str, keys: str) -> str:
        k = f"{keys}, " if keys else ""
        return f"""(SELECT {k}measure, max(total) AS total, min(bin) FILTER (4 * upto >= total) AS q1,
            min(bin) FILTER (4 * upto >= 3 * total) AS q3 FROM (SELECT *,
            sum(n) OVER (PARTITION BY {k}measure ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {k}measure) AS total
            FROM {source}) GROUP BY {k}measure)"""
    failed = ", ".join(
        f"CASE WHEN {per[m]} < l['{m}'][1] OR {per[m]} > l['{m}'][2] THEN '{m}' END" for m in MEASURES)
    return f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '{word}') AS words FROM {table}),
p AS (SELECT doc_id, i, words[i:i + {RUN - 1}] AS run FROM (
        SELECT doc_id, words, unnest(range(1, len(words) - {RUN - 2})) AS i FROM w WHERE len(words) >= {RUN})),
twice AS (SELECT doc_id, unnest(places) AS i FROM (
        SELECT doc_id, list(i) AS places FROM p GROUP BY doc_id, run HAVING count(*) > 1)),
again AS (SELECT doc_id, count(DISTINCT j) AS n
          FROM (SELECT doc_id, unnest(range(i, i + {RUN})) AS j FROM twice) GROUP BY doc_id),
t AS (SELECT w.doc_id, lang, source, len(words) AS n_words,
        coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(again.n, 0) AS n_repeat_words,
        len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS n_stutter, len(lines) AS n_lines
      FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM w) w
      LEFT JOIN again USING (doc_id)),
x AS (SELECT lang, source, unnest([{measure}], recursive := true) FROM t WHERE n_words > 0),
own AS (SELECT lang, source, measure, (x >> s) << s AS bin, count(*) AS n FROM (
        SELECT *, greatest(length(bin(x)) - {b}, 0)::BIGINT AS s FROM x) GROUP BY ALL),
langs AS (SELECT lang, measure, bin, sum(n) AS n FROM own GROUP BY ALL),
whole AS (SELECT measure, bin, sum(n) AS n FROM own GROUP BY ALL),
chosen AS (SELECT lang, source, measure, q1 - {FENCE} * width AS low, q3 + {FENCE} * width AS high FROM (
        SELECT *, greatest(q3 - q1, CASE measure {least} END) AS width FROM (
        SELECT a.lang, a.source, a.measure,
               CASE WHEN a.total >= {GROUP_ROWS} THEN a.q1 WHEN b.total >= {GROUP_ROWS} THEN b.q1 ELSE c.q1 END AS q1,
               CASE WHEN a.total >= {GROUP_ROWS} THEN a.q3 WHEN b.total >= {GROUP_ROWS} THEN b.q3 ELSE c.q3 END AS q3
        FROM {fences("own", "lang, source")} a
        JOIN {fences("langs", "lang")} b ON a.lang IS NOT DISTINCT FROM b.lang AND a.measure = b.measure
        JOIN {fences("whole", "")} c ON a.measure = c.measure))),
lim AS (SELECT lang, source, map_from_entries(list((measure, [low, high]))) AS l FROM chosen GROUP BY lang, source),
r AS (SELECT t.*, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
        concat_ws(',', {failed}) AS failed
      FROM t LEFT JOIN lim ON t.lang IS NOT DISTINCT FROM lim.lang AND t.source IS NOT DISTINCT FROM lim.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed,
       NOT base_failed AND failed = '' AS kept FROM r"""
