"""Toxicity: a lexicon learned from labels, misspellings by automata, and the context of each hit.

1. *Lexicon.* Words and word stems that are frequent in toxic and absent from other labelled texts,
   counted by Spark over a sample of labelled rows (at most SAMPLE_ROWS, the ones with the smallest
   MD5 of their id). Copies would make any word of theirs look toxic, so texts are counted by the
   min-hash of their triples of words: near copies mostly count once.
2. *Matching.* The terms form a trie. A word is a Levenshtein automaton, kept as bit vectors of its
   positions for 0 to k errors; walking the trie and the automaton together finds every term within k
   errors, with k = 1 from 5 and k = 2 from 9 letters. Stems match the start of a word exactly.
3. *Context.* A hit is quoted if it lies between quotation marks or in a line that starts with ``>``,
   or if a reporting word stands in the window before it and no word of address does.
4. *Score.* Logistic regression on the counts and densities of direct and quoted, exact and inexact hits,
   fitted on the sample. Only texts enter it: ids, languages, sources and labels do not.

Scoring is one pass over whole texts, without a shuffle; lexicon and weights are sent along (their size
is bounded: a term is in MIN_SHARE of the toxic texts or more).

Edge cases: NULL and empty texts have no hits and get the score of a text without hits; rows whose label
is NULL are not learned from; without labels of both kinds every score is 0; an id in several rows is
scored in each and learned from once; NULL ids are not held out; further columns are ignored.
"""

import math
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from netloom.llm.common import map_rows
from netloom.session import cut_lineage

#: Bound of the labelled rows that the lexicon and the weights are fitted on.
SAMPLE_ROWS = 16_000
#: A term is in so large a share of the toxic texts, and in so many of them at least.
MIN_SHARE, MIN_TEXTS = 0.01, 4
#: A term's share of the other texts is at most this part of its share of the toxic ones.
IMPURITY = 0.02
STEM_LETTERS = (4, 5, 6, 7)
THRESHOLD = 0.7

# Characters written for letters, marks of quotation, words of report and of address.
WRITTEN_FOR = str.maketrans("013457@$", "oieastas")
WORDS = re.compile(r"(?:[^\W_]|[@$])+")
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‹": "›"}
REPORT = frozenset("said says wrote writes called calls quote quoted reported according word term sagte schrieb "
                   "nannte dijo escribió llamó dit écrit appelé".split())
ADDRESS = frozenset("you your yours du dich dein ihr euch tú tu usted ustedes toi vous votre".split())
WINDOW = 6


class Lexicon:
    """Terms as a trie, intersected with the Levenshtein automaton of a word."""

    def __init__(self, words: Iterable[str], stems: Iterable[str]):
        self.words, self.stems = frozenset(words), frozenset(stems)
        self.trie: dict = {}
        self.halves: set[tuple[bool, str]] = set()
        self.middles: dict[tuple[int, int], set[str]] = {}
        for word in self.words:
            node = self.trie
            for c in word:
                node = node.setdefault(c, {})
            node[""] = word
            # k errors leave one of k + 1 parts of a term whole; the outer ones are looked up first.
            part = len(word) // (self.errors(len(word)) + 1)
            self.halves |= {(True, word[:part]), (False, word[-part:])} if part else set()
            # With k = 2 and an error in each outer part the middle is whole, moved by one letter at most.
            if self.errors(len(word)) == 2:
                for at in (part - 1, part, part + 1):
                    self.middles.setdefault((at, at + len(word) - 2 * part), set()).add(word[part:len(word) - part])
        self.part_sizes = sorted({len(h) for _, h in self.halves})
        self.longest = max(map(len, self.words), default=0) + 2
        self.stem_sizes = sorted({len(s) for s in self.stems})
        self.known: dict[str, int] = {}

    @staticmethod
    def errors(letters: int) -> int:
        return 0 if letters < 5 else 1 if letters < 9 else 2

    def kind(self, word: str) -> int:
        """0: no term, 1: a term or stem, 2: a misspelled term."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            got = self.known[word] = self._kind(word)
        return got

    def _kind(self, word: str) -> int:
        plain = word.translate(WRITTEN_FOR)
        for w in {word, plain}:
            if w in self.words or any(w[:n] in self.stems for n in self.stem_sizes if len(w) >= n):
                return 1
        if len(plain) < 4 or len(plain) > self.longest or not (any(
                (True, plain[:n]) in self.halves or (False, plain[-n:]) in self.halves for n in self.part_sizes)
                or any(plain[i:j] in parts for (i, j), parts in self.middles.items())):
            return 0
        return 2 if self.near(plain) else 0

    def near(self, word: str) -> bool:
        """Whether a term lies within its number of errors of the word."""
        limit = self.errors(len(word) + 2)
        if not limit:
            return False
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        final = 1 << len(word)
        # states[e]: bit i is set if i letters of the word are read with e errors; leading letters may be skipped
        todo = [(self.trie, [(1 << e + 1) - 1 for e in range(limit + 1)])]
        while todo:
            node, states = todo.pop()
            for c, child in node.items():
                if c == "":
                    if any(states[e] & final for e in range(min(self.errors(len(child)), limit) + 1)):
                        return True
                    continue
                mask, new = masks.get(c, 0), []
                for e, at in enumerate(states):
                    state = (at & mask) << 1
                    if e:
                        less = states[e - 1]
                        state |= less | less << 1 | new[e - 1] << 1  # letter added, replaced, left out
                    new.append(state & (final << 1) - 1)
                if any(new):
                    todo.append((child, new))
        return False


def _quoted(text: str) -> list[tuple[int, int]]:
    """Spans between quotation marks (closed in the same line) and lines of replies."""
    spans, at = [], 0
    for line in text.split("\n"):
        if line.lstrip().startswith(">"):
            spans.append((at, at + len(line)))
        else:
            i = 0
            while i < len(line):
                close = QUOTES.get(line[i])
                end = line.find(close, i + 1) if close else -1
                if end > 0:
                    spans.append((at + i, at + end))
                    i = end
                i += 1
        at += len(line) + 1
    return spans


def features(lexicon: Lexicon, text: str) -> list[float]:
    """Exact and inexact, direct and quoted hits of a whole text: presence, counts, density."""
    low = text.lower()
    words = WORDS.findall(low)
    kinds = list(map(lexicon.kind, words))
    counts = [0, 0, 0, 0]
    if any(kinds):
        starts = [m.start() for m in WORDS.finditer(low)]
        spans = _quoted(low)
        span = 0
        for i, kind in enumerate(kinds):
            if not kind:
                continue
            while span < len(spans) and spans[span][1] < starts[i]:
                span += 1
            inside = span < len(spans) and spans[span][0] < starts[i]
            near = words[max(0, i - WINDOW):i]
            told = not REPORT.isdisjoint(near) and ADDRESS.isdisjoint(near)
            counts[(kind - 1) * 2 + (inside or told)] += 1
    exact, exact_quoted, inexact, inexact_quoted = counts
    per_100 = 100.0 / max(len(words), 20)
    return [float(exact > 0), math.log1p(exact), min(exact * per_100, 5.0),
            float(exact_quoted > 0), math.log1p(exact_quoted),
            float(inexact > 0), math.log1p(inexact), min(inexact * per_100, 5.0), math.log1p(inexact_quoted)]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Text and label of at most ``rows`` labelled ids that are not held out."""
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows))
    return (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # ``rows`` rows at most
            .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """The terms of a sample of (text, toxic)."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,40}"), F.lit(0))
    triple = lambda w: F.when(F.size(w) < 3, F.array(F.xxhash64(w))).otherwise(F.transform(
        F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.slice(w, i, 3))))
    given = rows.select("toxic", words.alias("words")).where(F.size("words") > 0).select(
        "toxic", F.array_distinct("words").alias("words"), F.array_min(triple(F.col("words"))).alias("clump"))
    given = cut_lineage(given.groupBy("toxic", "clump").agg(F.min("words").alias("words")))
    sizes = {r["toxic"]: r["n"] for r in given.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return Lexicon((), ())
    # strings, since only they are made distinct by hash: "=word" and "^stem"
    terms = F.array_distinct(F.concat(
        F.transform("words", lambda w: F.concat(F.lit("="), w)),
        *[F.transform(F.filter("words", lambda w, n=n: F.length(w) > n),
                      lambda w, n=n: F.concat(F.lit("^"), F.substring(w, 1, n))) for n in STEM_LETTERS]))
    found = (given.select("toxic", F.explode(terms).alias("x")).groupBy("x")
             .agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
             .where(F.col("p") >= max(MIN_TEXTS, MIN_SHARE * toxic))
             .where(F.col("n") / other <= IMPURITY * F.col("p") / toxic)
             .select(F.expr("x like '^%'").alias("stem"), F.expr("substr(x, 2)").alias("term")).collect())
    stems = {r["term"] for r in found if r["stem"]}
    return Lexicon({r["term"] for r in found if not r["stem"]},
                   {s for s in stems if not any(s[:n] in stems for n in STEM_LETTERS if n < len(s))})


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[Lexicon, list[float], float]:
    """Lexicon, weights and intercept."""
    given = cut_lineage(sample(docs, labels, rows))  # bounded by ``rows``
    lexicon = learn_lexicon(given)
    counts = {r["toxic"]: r["n"] for r in given.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return lexicon, [], -math.inf
    words, stems = lexicon.words, lexicon.stems

    def start():
        own = Lexicon(words, stems)
        return lambda text, toxic: [(features(own, text or ""), float(toxic))]
    to_vector = F.udf(Vectors.dense, VectorUDT())
    data = map_rows(given.select("text", "toxic"), "f array<double>, label double", start)
    data = cut_lineage(data).select(
        to_vector("f").alias("features"), "label",
        F.when(F.col("label") == 1, 0.5 / counts[1]).otherwise(0.5 / counts[0]).alias("w"))
    model = LogisticRegression(regParam=0.002, weightCol="w", standardization=False, maxIter=60).fit(data)
    return lexicon, list(model.coefficients), model.intercept


def score(docs: DataFrame, model: tuple[Lexicon, list[float], float]) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    lexicon, weights, intercept = model
    words, stems = lexicon.words, lexicon.stems

    def start():
        own = Lexicon(words, stems)

        def row(doc_id, out, text):
            value = 0.0
            if weights:
                z = intercept + sum(w * x for w, x in zip(weights, features(own, text or "")))
                value = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
            return [(doc_id, out, value, int(value >= THRESHOLD))]
        return row
    return map_rows(docs.select("doc_id", held_out().alias("held_out"), "text"),
                    "doc_id bigint, held_out boolean, score double, predicted int", start)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    return score(docs, train(docs, labels, rows))


def without_toxic(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None,
                  rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns; one pass.

    ``labelled`` has the texts to learn from, if they are not in ``docs``.
    """
    lexicon, weights, intercept = train(docs if labelled is None else labelled, labels, rows)
    words, stems = lexicon.words, lexicon.stems
    limit = math.log(THRESHOLD / (1 - THRESHOLD))

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Lexicon(words, stems)
        for texts in batches:
            yield texts.map(lambda t: not weights or intercept + sum(
                w * x for w, x in zip(weights, features(own, t or ""))) < limit).astype(bool)
    return docs.where(clean("text"))
