"""Near duplicates of sets: fast similarity sketches, banding, exact verification, classes.

A set is the 64-bit hashes of its shingles. The sketch throws every element into one of ``size`` bins,
round after round with new hash functions; a bin keeps the smallest value of the earliest round that
reached it, and rounds ``size`` to ``2 * size - 1`` give each bin in turn every element, so all bins fill.
Equal coordinates of two sketches estimate the Jaccard similarity with the concentration of independent
draws, at the cost of about one pass over the set plus ``size * log(size)`` steps.

Sets that share a band are candidates. `classes` compares them without listing all pairs of a bucket:
first each with the smallest and the largest member; what that links becomes one component. Within a
bucket only members of different components can still matter. Their pairs are not listed either: each is
compared with the majority of its group, and its difference tells with whom it can be linked at all
(`differences`, `candidates`). So no link between sets that share a band is lost, and copies that lie just
below the threshold meet, if at all, in the rare elements of their differences, where counts decide.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from netloom.llm.components import components
from netloom.session import cut_lineage

_U = np.uint64
#: Tables of so many ids or pairs at most are broadcast (16 MB of longs); larger ones are shuffled.
BROADCAST_ROWS = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` numbers that begin at each place where so many are left."""
    n = max(len(h) - k + 1, 0)
    total = np.zeros(n, _U)
    for i in range(k):
        total = mix(total + _U(i + 1)) + h[i:i + n]
    return mix(total + _U(k))


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered for a while."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def shingles(self, words: list[bytes], k: int) -> np.ndarray:
        """The distinct hashed k-word shingles in order; fewer words are one shingle, no words none."""
        if not words:
            return np.empty(0, _U)
        h = np.fromiter(map(self.__getitem__, words), _U, len(words))
        n = max(len(words) - k + 1, 1)
        total = np.zeros(n, _U)
        for i in range(min(k, len(words))):
            total = mix(total + _U(i + 1)) + h[i:i + n]
        return np.unique(mix(total + _U(min(k, len(words)))))


    def sets(self, texts: list[list[bytes]], k: int) -> list[np.ndarray]:
        """`shingles` of many texts in one go: windows that would cross from one text to the next are left out."""
        lengths = np.array([len(words) for words in texts], np.int64)
        if not len(lengths) or lengths.sum() < k:
            return [self.shingles(words, k) for words in texts]
        h = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), _U, int(lengths.sum()))
        owner = np.repeat(np.arange(len(texts)), lengths)
        n = len(h) - k + 1
        inside = owner[:n] == owner[k - 1:]
        values, owner = windows(h, k)[inside], owner[:n][inside]
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[fresh], owner[fresh]
        parts = np.split(values, np.searchsorted(owner, np.arange(1, len(texts))))
        return [part if size >= k else self.shingles(words, k) for part, size, words in zip(parts, lengths, texts)]


def tune(percent: int, rows: int, miss: float) -> int:
    """Bands of ``rows`` coordinates so that a pair at the threshold is missed with probability ``miss`` at most."""
    return int(np.ceil(np.log(miss) / np.log1p(-(percent / 100) ** rows)))


def sketch(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of ``size`` coordinates for each (non-empty) set."""
    return sketch_of(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets), size)


def sketch_of(values: np.ndarray, owner: np.ndarray, n: int, size: int) -> np.ndarray:
    """`sketch` of ``n`` sets whose elements, each with its set's number, stand side by side; repeated ones change nothing."""
    out = np.full(n * size, np.iinfo(_U).max, _U)
    for i in range(2 * size):
        h = mix(values + _U((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bins = (h >> _U(48)).astype(np.int64) % size if i < size else np.int64(i - size)
        value = _U(i) << _U(48) | h & _U((1 << 48) - 1)
        np.minimum.at(out, owner * size + bins, value)
        open_sets = (out.reshape(-1, size) == np.iinfo(_U).max).any(axis=1)
        if not open_sets.any():
            break
        keep = open_sets[owner]
        values, owner = values[keep], owner[keep]
    return out.reshape(-1, size)


def bands(sets: list[np.ndarray], rows: int, count: int) -> list[list[int]]:
    """``count`` signed 64-bit keys for each set; an empty set has none."""
    full = [i for i, s in enumerate(sets) if len(s)]
    out: list[list[int]] = [[] for _ in sets]
    if full:
        for i, row in zip(full, band_keys(sketch([sets[i] for i in full], rows * count), rows).tolist()):
            out[i] = row
    return out


def band_keys(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """The signed 64-bit keys of each sketch's bands of ``rows`` coordinates."""
    count = coordinates.shape[1] // rows
    coordinates = coordinates.reshape(-1, count, rows)
    keys = np.arange(count, dtype=_U)[None, :] * _U(0xD6E8FEB86659FD93)
    for i in range(rows):
        keys = mix(keys + coordinates[:, :, i] + _U(i))
    return keys.astype(np.int64)


def set_id(values: np.ndarray) -> int:
    """Signed 64-bit hash of a whole set."""
    return int(np.uint64(xxhash.xxh64_intdigest(values.tobytes())).astype(np.int64))


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with the advice to broadcast it, if it has so few rows; otherwise as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) with the sizes of intersection and union; pairs whose sizes rule them out are left out."""
    sizes = sets.select("node", F.size("set").alias("n"))
    possible = (pairs.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a")
                .join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
                .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    common = (possible.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
              .join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
              .select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("common")))
    return common.select("a", "b", "common", (F.col("na") + F.col("nb") - F.col("common")).alias("both"))


def classes(keys: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """node and component of all nodes that are linked with another one.

    ``keys``: (key, node) rows of the bands, read twice, so a written table or checkpoint;
    ``sets_of(nodes)``: (node, set) of the asked nodes; ``most``: rows of a table that may be broadcast.
    """
    linked = F.col("common") * 100 >= F.col("both") * percent
    ends = cut_lineage(keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high"))
    members = cut_lineage(keys.join(few(ends, most), "key").select("key", "node", "low", "high").distinct())
    sets = cut_lineage(sets_of(members.select("node").distinct()))
    spokes = members.select(F.col("node").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a <> b")
    spokes = spokes.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    known = cut_lineage(verified(spokes, sets, percent))
    first = known.where(linked).select("a", "b")
    labels = components(first)

    # What is left: members of one bucket in different components.
    own = members.select("key", "node").join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    mixed = own.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.min("node").alias("first")).where(
        "c < d").select("key", "first")
    met = cut_lineage(own.join(mixed, "key").select("node", "component", "first").distinct())
    if met.isEmpty():
        return labels
    groups = components(met.select(F.col("node").alias("a"), F.col("first").alias("b"))).withColumnRenamed("component", "group")
    rest = cut_lineage(candidates(met.select("node", "component").distinct().join(groups, "node"), sets, percent))
    more = cut_lineage(verified(rest, sets, percent).where(linked).select("a", "b"))
    if more.isEmpty():
        return labels
    return components(first.unionByName(more))


def differences(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """group, node, component, excess, size, shared, and of the group: least, greatest, open_least; each set against the majority.

    The hub of a group is what more than half of its sets have. A set's difference D is what it has and the hub
    has not, or the other way round; so |A xor B| = |Da xor Db|, and with c = (100 - percent) / (100 + percent)
    sets are linked exactly if |Da| - c |A| + |Db| - c |B| <= 2 |Da and Db|. The excess is |D| - c |A|, times
    100 + percent; ``least`` and ``greatest`` are the group's. A set is settled if it is linked with the one of the
    least excess for certain; ``open_least`` is the least excess of those that are not (NULL: all are). ``shared``
    are the elements of D that other differences of the group have, too, rare ones first.
    """
    given = cut_lineage(nodes.join(sets, "node"))
    sizes = given.groupBy("group").agg(F.count("*").alias("sets"))
    hubs = (given.select("group", F.explode("set").alias("x")).groupBy("group", "x").agg(F.count("*").alias("n"))
            .join(sizes, "group").where("2 * n > sets").groupBy("group").agg(F.collect_list("x").alias("hub")))  # twice a set at most
    hub = F.coalesce("hub", F.array().cast("array<bigint>"))
    other = F.concat(F.array_except("set", hub), F.array_except(hub, "set"))
    found = given.join(hubs, "group", "left").select("group", "node", "component", F.size("set").alias("own"), other.alias("d"))
    found = cut_lineage(found.withColumn("excess", ((100 + percent) * F.size("d") - (100 - percent) * F.col("own")).cast("bigint")))
    each = found.select("group", "node", F.explode("d").alias("x"))
    common = each.groupBy("group", "x").agg(F.count("*").alias("n")).where("n > 1")
    shared = each.join(common, ["group", "x"]).groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("n", "x"))).alias("shared"))                   # a difference at most
    ends = found.groupBy("group").agg(F.min("excess").alias("least"), F.max("excess").alias("greatest"))
    open_ = found.join(ends, "group").where("excess + least > 0").groupBy("group").agg(F.min("excess").alias("open_least"))
    return (found.join(ends.join(open_, "group", "left"), "group").join(shared, "node", "left").select(
        "group", "node", "component", "excess", "least", "greatest", "open_least", F.size("d").alias("size"),
        F.coalesce(F.transform("shared", lambda e: e["x"]), F.array().cast("array<bigint>")).alias("shared")))


def candidates(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): comparisons that settle which sets of a group are linked; beside one for each set, links only.

    Whom any partner without a common difference element would link, the set of the least excess links: a star.
    Others must share as many difference elements as half their excesses ask for, so at least ``need`` of their
    own, and one among the first m - need + 1 of their m shared ones. There they meet, and go on only if what lies
    behind that place can suffice and if the elements they share do, counted at the first of them.
    """
    unit = 2 * (100 + percent)
    found = cut_lineage(differences(nodes, sets, percent).withColumn("settled", F.col("excess") + F.col("least") <= 0))
    centre = found.groupBy("group").agg(F.min(F.struct("excess", "node", "component")).alias("centre"))
    stars = found.where("settled").join(centre, "group").where(F.col("component") != F.col("centre.component")).select(
        F.col("node").alias("p"), F.col("centre.node").alias("q"))
    # partners of a settled set are open ones, of an open set any
    asked = F.col("excess") + F.when(F.col("settled"), F.col("open_least")).otherwise(F.col("least"))
    some = found.withColumn("need", F.greatest(F.lit(1), F.ceil(asked / unit)).cast("int")).where(
        (F.col("need") <= F.size("shared")) & F.col("open_least").isNotNull())
    places = cut_lineage(some.select("group", "node", "component", "excess", "settled", "shared", F.posexplode(
        F.slice("shared", F.lit(1), F.size("shared") - F.col("need") + 1)).alias("place", "x")).withColumn(
        "left", F.size("shared") - F.col("place")))
    a, b = places.where("not settled").alias("a"), places.alias("b")
    asks, common = F.col("a.excess") + F.col("b.excess"), F.array_intersect("a.shared", "b.shared")
    listed = a.join(b, (F.col("a.group") == F.col("b.group")) & (F.col("a.x") == F.col("b.x"))
                    & (F.col("a.component") != F.col("b.component")) & (F.col("b.settled") | (F.col("a.node") < F.col("b.node")))
                    & (asks <= unit * F.least("a.left", "b.left"))
                    & (asks <= unit * F.size(common)) & (F.get(common, F.lit(0)) == F.col("a.x"))).select(
        F.col("a.node").alias("p"), F.col("b.node").alias("q"))
    return stars.unionByName(listed).select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct()
