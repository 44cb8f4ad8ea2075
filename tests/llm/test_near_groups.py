"""Groups of sets that lie just below and above the threshold: no link is lost, and the work follows their number."""

import random

import pytest
from pyspark.sql import functions as F

from netloom.llm import near
from test_text_operators import WORDS, components_of, edited, frame, prose, shingles, similar


def copies(rng, n, words, edits):
    """Copies of one text with a few replaced words each."""
    base = prose(rng, words).split(" ")
    out = []
    for _ in range(n):
        text = list(base)
        for at in rng.sample(range(words), rng.choice(edits)):
            text[at] = rng.choice(WORDS) + rng.choice(WORDS)
        out.append(" ".join(text))
    return out


def as_sets(spark, texts, k):
    """(node, set) with numbers for shingles, and the sets themselves."""
    sets, number = [shingles(t, k) for t in texts], {}
    rows = [(i, [number.setdefault(x, len(number) + 7) for x in s]) for i, s in enumerate(sets)]
    return spark.createDataFrame(rows, "node bigint, set array<bigint>").repartition(3), sets


def joined(spark, texts, percent, k=3):
    """Candidates of all texts as one group, every text a component of its own; and those that are links."""
    sets, plain = as_sets(spark, texts, k)
    nodes = sets.select("node", F.col("node").alias("component"), F.lit(0).cast("bigint").alias("group"))
    pairs = near.candidates(nodes, sets, percent)
    found = near.verified(pairs, sets, percent).where(F.col("common") * 100 >= F.col("both") * percent)
    return pairs.count(), [(r["a"], r["b"]) for r in found.collect()], plain


@pytest.mark.parametrize("percent,edits", [(85, [1, 2, 3]), (85, [2, 3]), (80, [3, 4, 5]), (85, [0, 1, 6])])
def test_candidates_connect_what_is_linked(spark, percent, edits):
    rng = random.Random(percent + len(edits))
    for words in (60, 150):
        texts = copies(rng, 60, words, edits) + copies(rng, 15, words, edits) + [edited(rng, prose(rng, 40), 0) for _ in range(5)]
        # edits that some copies have in common
        texts += [" ".join(t.split(" ")[:20] + ["common"] + t.split(" ")[21:]) for t in texts[:30]]
        _, found, sets = joined(spark, texts, percent)
        links = similar(sets, percent)
        assert components_of(len(texts), found) == components_of(len(texts), links)


def test_work_follows_the_group(spark):
    """Four times the copies just below the threshold: no more pairs for each."""
    rng = random.Random(11)
    texts = copies(rng, 1200, 150, [3])
    few, *_ = joined(spark, texts[:300], 85)
    many, *_ = joined(spark, texts, 85)
    assert many / 1200 <= max(2 * few / 300, 8)
