"""License scans by diagonal voting: where texts quote phrases and notices of licenses, with small edits.

Words of a text are hashed in rolling k-grams, all of which are joined with the positions of equal k-grams in
the templates. A hit at text position p and template position t votes for the diagonal p - t: a quotation is
many votes on one diagonal, words put in or left out move the rest of it to a neighbouring one. Votes are added
up per text, template and diagonal, diagonals at most SLACK apart are merged to one span, and spans are verified
on the words themselves: a phrase must stand there word by word, a notice must share SHARE percent of its words
with the span in order (longest common subsequence).

k is GRAM, or a template's number of words if it is shorter. A template's hits of one diagonal are bounded by its
length, a text's diagonals by the text's. Template positions are broadcast up to BROADCAST_GRAMS, else joined by a
shuffle; spans go back to their texts by broadcast up to BROADCAST_SPANS rows, else by a join.

Edge cases: NULL and empty texts have no words and score 0; rows with equal ids and different texts are scanned
each by itself, equal rows give equal rows; an empty table gives an empty result; further columns are ignored;
overlapping places of a phrase all count.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from netloom.llm import near
from netloom.llm.common import ID, TEXT_ID, keyed, map_batches, written

GRAM, SLACK, SHARE = 4, 8, 80
BROADCAST_GRAMS, BROADCAST_SPANS = 100_000, 200_000

# Phrases whose places are counted exactly, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Openings of well-known notices, as their publishers word them.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation, either version"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
             "published by the Free Software Foundation, either version"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "licensed under the Creative Commons Attribution License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights"),
)
# Fixed value: what separates words, \x00-\x2F \x3A-\x60 \x7B-\x7F after A-Z became a-z; all other bytes are letters.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    exact: bool          # a phrase, each of whose places counts

    @property
    def k(self) -> int:
        return min(GRAM, len(self.words))


def default_templates() -> list[Template]:
    return ([Template(label, tuple(words_of(text)), True) for text, label in PHRASES]
            + [Template(label, tuple(words_of(text)), False) for label, text in NOTICES])


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Signed 64-bit hashes of all rolling windows of ``k`` word hashes."""
    n = max(len(hashes) - k + 1, 0)
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total = near.mix(total + np.uint64(i + 1)) + hashes[i:i + n]
    return near.mix(total).astype(np.int64)


def _hashed(words, hashes: near.WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """gram, template (its number) and at (the position there)."""
    hashes = near.WordHashes()
    rows = [(g, i, at) for i, t in enumerate(templates) for at, g in enumerate(grams(_hashed(t.words, hashes), t.k).tolist())]
    df = spark.createDataFrame(rows, "gram bigint, template int, at int")
    return F.broadcast(df) if len(rows) <= BROADCAST_GRAMS else df


def text_grams(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """ID, TEXT_ID, place and gram: all rolling k-grams of every text, for each k of ``sizes``."""
    def start():
        hashes = near.WordHashes()

        def batch(ids, text_ids, texts):
            lengths, places, found = [], [], []
            for text in texts:
                h = _hashed(words_of(text), hashes)
                each = [grams(h, k) for k in sizes]
                found += each
                places += [np.arange(len(g), dtype=np.int32) for g in each]
                lengths.append(sum(map(len, each)))
            return (np.repeat(np.array(ids, np.int64), lengths), np.repeat(np.array(text_ids, np.int64), lengths),
                    np.concatenate(places), np.concatenate(found))
        return batch
    return map_batches(keyed(docs).select(ID, TEXT_ID, "text"), f"{ID} bigint, {TEXT_ID} bigint, place int, gram bigint", start)


def spans(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """ID, TEXT_ID and spans (template, lowest and highest diagonal, votes) of every text with a hit."""
    hits = text_grams(docs, sorted({t.k for t in templates})).join(template_grams(docs.sparkSession, templates), "gram")
    key = [ID, TEXT_ID, "template"]
    voted = (hits.groupBy(*key, (F.col("place") - F.col("at")).alias("diagonal"))
             .agg(F.collect_set("at").alias("at")))                       # at most a template's positions
    voted = voted.select(*key, "diagonal", F.size("at").alias("votes"))
    exact = F.array(*[F.lit(t.exact) for t in templates])[F.col("template")]
    apart = Window.partitionBy(*key).orderBy("diagonal")                  # diagonals of one text
    step = F.col("diagonal") - F.lag("diagonal").over(apart)
    merged = (voted.withColumn("new", F.when(exact | step.isNull() | (step > SLACK), 1).otherwise(0))
              .withColumn("span", F.sum("new").over(apart))
              .groupBy(*key, "span").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"),
                                         F.sum("votes").alias("votes")))
    return merged.groupBy(ID, TEXT_ID).agg(F.collect_list(F.struct("template", "low", "high", "votes")).alias("spans"))


def common_words(a: tuple[bytes, ...], b: list[bytes]) -> int:
    """Length of the longest common subsequence, a bit for each word of ``a``."""
    at: dict[bytes, int] = defaultdict(int)
    for i, word in enumerate(a):
        at[word] |= 1 << i
    every = row = (1 << len(a)) - 1
    for word in b:
        hit = row & at.get(word, 0)
        row = (row + hit | row - hit) & every
    return len(a) - row.bit_count()


def verified(words: list[bytes], found: list[dict], templates: list[Template]) -> list[tuple[Template, int, int, int]]:
    """(template, first word, end, words in common) of each span that the words bear out at all."""
    out = []
    for span in found:
        template = templates[span["template"]]
        first, end = max(span["low"], 0), min(span["high"] + len(template.words), len(words))
        if template.exact:
            if tuple(words[first:end]) == template.words:
                out.append((template, first, end, len(template.words)))
        elif common := common_words(template.words, words[first:end]):
            out.append((template, first, end, common))
    return out


def _rows(docs: DataFrame, templates: list[Template]) -> DataFrame:
    found = written(spans(docs, templates))
    if found.count() <= BROADCAST_SPANS:
        found = F.broadcast(found)
    return keyed(docs).select("doc_id", ID, TEXT_ID, "text").join(found, [ID, TEXT_ID], "left")


def scan(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """doc_id, label, kind (phrase or notice), first word, end (exclusive), share and the quoted words of each verified span."""
    templates = templates or default_templates()

    def start():
        def batch(ids, texts, found):
            out: list[list] = [[] for _ in range(7)]
            for doc_id, text, own in zip(ids, texts, found):
                words = words_of(text)
                for t, first, end, common in verified(words, own, templates):
                    if 100 * common >= SHARE * len(t.words):
                        for column, value in zip(out, (doc_id, t.label, "phrase" if t.exact else "notice", first, end,
                                                       common / len(t.words), b" ".join(words[first:end]).decode())):
                            column.append(value)
            return out
        return batch
    return map_batches(_rows(docs, templates).where("spans is not null").select("doc_id", "text", "spans"),
                       "doc_id bigint, label string, kind string, first bigint, end bigint, share double, words string", start)


def digest(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """doc_id, n_words, places of the phrases (n_base, first_word, last_word), labels of both kinds and score of every row.

    The score is the largest share of a template's words that a span has, 1 for a phrase.
    """
    templates = templates or default_templates()

    def start():
        def batch(ids, texts, found):
            out: list[list] = [[] for _ in range(8)]
            for doc_id, text, own in zip(ids, texts, found):
                words = words_of(text)
                spans = verified(words, own or [], templates)
                places = [first for t, first, _, _ in spans if t.exact]
                base = {t.label for t, *_ in spans if t.exact}
                more = {t.label for t, _, _, common in spans if 100 * common >= SHARE * len(t.words)}
                for column, value in zip(out, (
                        doc_id, len(words), len(places), min(places, default=None), max(places, default=None),
                        ",".join(sorted(base)), ",".join(sorted(base | more)),
                        max((common / len(t.words) for t, _, _, common in spans), default=0.0))):
                    column.append(value)
            return out
        return batch
    return map_batches(
        _rows(docs, templates).select("doc_id", "text", "spans"),
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double", start)
