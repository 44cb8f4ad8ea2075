"""Preparing labelled flow datasets: labels, cleaning, pruning, scaling, splits."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, NumericType

from netloom.functions import constants as K
from netloom.functions.exprs import clip, is_finite, shuffle_key, strip
from netloom.session import cut_lineage


# ---- schema checks and labels -------------------------------------------------

def missing_columns(schemas: DataFrame, names: list[str]) -> DataFrame:
    """(dataset, column) for every required column that a listed dataset lacks; ``schemas``: dataset, columns."""
    lacking = F.array_except(F.array(*map(F.lit, names)), "columns")
    return schemas.select("dataset", F.explode(lacking).alias("column"))


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; available: {', '.join(df.columns)}")
    return df


def strip_label(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn(label, strip(F.col(label).cast("string")))


def binary_target(df: DataFrame, label: str, target: str = "target") -> DataFrame:
    """0 for the benign synonyms, else 1. Null labels are rejected by keeping NULL."""
    return df.withColumn(target, (~F.col(label).isin(K.BENIGN_LABELS)).cast("int"))


def remap_classes(df: DataFrame, label: str) -> DataFrame:
    """Fold every attack outside the focus list into one class; ``remapped`` marks them."""
    kept = F.col(label).isin(["Benign", *K.FOCUS_CLASSES])
    return df.withColumns({
        "remapped": (~kept).cast("int"),
        label: F.when(kept, F.col(label)).when(F.col(label).isNotNull(), K.OTHER_ATTACK),
    })


#: Classes named in an error text, of each problem.
MESSAGES = 50


def class_violations(df: DataFrame, label: str, allowed: list[str]) -> DataFrame:
    """Classes present but not allowed ("unexpected"), allowed but absent ("missing")."""
    spark = df.sparkSession
    present = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("rows"))
    wanted = spark.range(1).select(F.explode(F.array(*map(F.lit, allowed))).alias("class"))
    extra = present.join(wanted, "class", "left_anti").select("class", F.lit("unexpected").alias("problem"), "rows")
    absent = wanted.join(present, "class", "left_anti").select(
        "class", F.lit("missing").alias("problem"), F.lit(0).cast("bigint").alias("rows"))
    return extra.unionByName(absent)


def check_classes(df: DataFrame, label: str, allowed: list[str], strict: bool = True) -> list[str]:
    """Raise on unexpected classes (strict) and return the messages otherwise, unexpected classes first.

    The decision counts every class; only the text lists no more than ``MESSAGES`` of each problem.
    """
    found = class_violations(df, label, allowed)
    counts = {r["problem"]: r["n"] for r in found.groupBy("problem").agg(F.count("*").alias("n")).collect()}
    messages = []
    for problem in ("unexpected", "missing"):
        if counts.get(problem):
            rows = found.filter(F.col("problem") == problem).orderBy("class").limit(MESSAGES).collect()
            messages += [f"{problem} class: {r['class']}" for r in rows]
            if counts[problem] > MESSAGES:
                messages.append(f"and {counts[problem] - MESSAGES} more {problem} classes")
    if strict and counts.get("unexpected"):
        raise ValueError("; ".join(messages))
    return messages


def drop_columns(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Without label, leakage and timing columns; absent names are ignored."""
    return df.drop(*(names if names is not None else ["Label", "ClassLabel", *K.STAGE1_EXCLUDED]))


def numeric_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(kept numeric or boolean columns, dropped columns), from the schema."""
    kept = [f.name for f in df.schema if isinstance(f.dataType, (NumericType, BooleanType))]
    return kept, [name for name in df.columns if name not in kept]


# ---- values --------------------------------------------------------------------

def fill_non_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(is_finite(F.col(c)), F.col(c)).otherwise(0.0) for c in columns})


def all_finite(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [is_finite(F.col(c).cast("double")) for c in columns])


def finite_rows(df: DataFrame, columns: list[str], label: str | None = None) -> DataFrame:
    keep = all_finite(columns)
    return df.filter(keep & F.col(label).isNotNull() if label else keep)


def contract_violations(df: DataFrame, key: list[str], required: list[str]) -> DataFrame:
    """(key, feature, problem) for missing, non-numeric or non-finite required features."""
    problems = []
    for name in required:
        if name not in df.columns:
            problem = F.lit("missing")
        else:
            number = F.col(name).try_cast("double")
            problem = F.when(number.isNull(), "non-numeric").when(~is_finite(number), "non-finite")
        problems.append(F.when(problem.isNotNull(), F.struct(
            F.lit(name).alias("feature"), problem.alias("problem"))))
    found = F.filter(F.array(*problems), lambda item: item.isNotNull())
    return df.select(*key, F.explode(found).alias("v")).select(*key, "v.feature", "v.problem")


def enforce_contract(df: DataFrame, required: list[str]) -> DataFrame:
    """Strict mode: the job fails on the first row that breaks the contract."""
    require_columns(df, required)

    def strict(name: str) -> Column:
        number = F.col(name).try_cast("double")
        return F.when(is_finite(number), number).otherwise(
            F.raise_error(F.lit(f"non-finite or non-numeric model feature: {name}")).cast("double"))

    return df.withColumns({name: strict(name) for name in required})


def assemble(df: DataFrame, order: list[str], output: str = "features") -> DataFrame:
    """Feature vector in exactly the saved order."""
    if len(order) != len(set(order)):
        raise ValueError("feature list contains duplicates")
    return VectorAssembler(inputCols=order, outputCol=output).transform(require_columns(df, order))


# ---- domains --------------------------------------------------------------------

def append_domains(cic: DataFrame, lab: DataFrame, features: list[str]) -> DataFrame:
    require_columns(cic, features)
    require_columns(lab, features)
    return cic.withColumn("domain", F.lit("cic")).unionByName(lab.withColumn("domain", F.lit("lab")))


def replicate(df: DataFrame, times: int, only: Column | None = None) -> DataFrame:
    """Repeat the rows for which ``only`` holds; the copies are made after the scan."""
    count = F.lit(times) if only is None else F.when(only, times).otherwise(1)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), count)))


def sample_weight(df: DataFrame, lab_weight: float) -> DataFrame:
    return df.withColumn("weight", F.when(F.col("domain") == "lab", float(lab_weight)).otherwise(1.0))


# ---- correlation ------------------------------------------------------------------

def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, left, right, r) for i < j; |r|, NULL when a column is constant.

    Rows where either value is NULL are left out, pair by pair. One pass at any width: a task adds up
    the sums and products of its rows, centred on its own first values, and gives one row per pair.
    """
    names = [f"c{k}" for k in range(len(columns))]
    numbers = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)])
    parts = numbers.mapInPandas(_pair_sums, "i int, j int, n double, mx double, my double, sxx double, syy double, sxy double")
    # Co-moments about each part's means are joined about the common means.
    total = parts.groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mx")).alias("x"), F.sum(F.col("n") * F.col("my")).alias("y"),
        *[F.sum(F.col(s) + F.col("n") * F.col(a) * F.col(b)).alias(s)
          for s, a, b in (("sxx", "mx", "mx"), ("syy", "my", "my"), ("sxy", "mx", "my"))])
    spread = {s: F.col(s) - F.try_divide(F.col(a) * F.col(b), F.col("n"))
              for s, a, b in (("sxx", "x", "x"), ("syy", "y", "y"), ("sxy", "x", "y"))}
    flat = lambda s, t: F.greatest(spread[s], F.lit(0.0)) <= F.lit(1e-12) * F.col(s)
    r = F.when(flat("sxx", "x") | flat("syy", "y"), None).otherwise(
        F.abs(F.try_divide(spread["sxy"], F.sqrt(spread["sxx"] * spread["syy"]))))
    label = lambda k: F.element_at(F.array(*map(F.lit, columns)), F.col(k) + 1)
    return total.select("i", "j", label("i").alias("left"), label("j").alias("right"),
                        F.when(~F.isnan(r), F.when(r > 1, 1.0).otherwise(r)).alias("r"))


def _pair_sums(batches):
    """Per pair of columns and task: count, means and co-moments of the rows that have both."""
    shift, sums = None, None
    for batch in batches:
        x = batch.to_numpy(dtype=float)
        if not len(x):
            continue
        have = ~np.isnan(x)
        if shift is None:
            shift, sums = np.full(x.shape[1], np.nan), np.zeros((4, x.shape[1], x.shape[1]))
        fresh = np.isnan(shift) & have.any(axis=0)       # a column is centred on its first value
        shift[fresh] = x[have.argmax(axis=0), np.arange(x.shape[1])][fresh]
        x = np.where(have, x - shift, 0.0)
        there = have.astype(float)
        # of column i over the rows that also have j: count, sum, sum of squares; and the sum of products
        sums += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
    if shift is None:
        return
    n, first, second, both = sums
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = first / n
        sxx, sxy = second - first * mean, both - first * mean.T
    i, j = np.triu_indices(len(shift), 1)
    keep = n[i, j] > 0
    i, j = i[keep], j[keep]
    yield pd.DataFrame({"i": i, "j": j, "n": n[i, j], "mx": mean[i, j] + shift[i], "my": mean[j, i] + shift[j],
                        "sxx": sxx[i, j], "syy": sxx[j, i], "sxy": sxy[i, j]})


def correlated_columns(pairs: DataFrame, limit: float = K.CORRELATION_LIMIT) -> DataFrame:
    """Columns to drop: correlated above the limit with any earlier column, dropped or not."""
    return pairs.filter(F.col("r") > limit).groupBy(F.col("right").alias("column")).agg(
        F.count("*").alias("partners"), F.max("r").alias("r"))


def prune_correlated(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Drop correlated columns; ``fit_on`` keeps held-out rows out of the statistics."""
    found = correlated_columns(correlation_pairs(fit_on if fit_on is not None else df, columns)).collect()
    dropped = sorted(r["column"] for r in found)
    return df.drop(*dropped), [c for c in columns if c not in dropped]


# ---- percentiles, scaling, weights ---------------------------------------------------

def _radix_counts(batches, level: int, prefixes: dict[int, list[int]]):
    """(column, prefix, digit, n): a task's values that begin with an open prefix, by their next DIGIT_BITS bits.

    A double's bits become an unsigned number in the order of the values: NaN last, -0.0 as 0.0.
    """
    shift, counts = np.uint64(64 - DIGIT_BITS * (level + 1)), {}
    for batch in batches:
        for c, column in enumerate(batch.columns):
            open_ = prefixes.get(c)
            x = column.drop_null().to_numpy(zero_copy_only=False) + 0.0
            if not open_ or not len(x):
                continue
            bits = np.where(np.isnan(x), np.nan, x).view(np.uint64)
            ordered = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))
            digit = (ordered >> shift).astype(np.uint64) & np.uint64((1 << DIGIT_BITS) - 1)
            upper = ordered >> shift >> np.uint64(DIGIT_BITS) if level else np.zeros(len(x), np.uint64)
            for prefix in open_:
                own = digit[upper == np.uint64(prefix)] if level else digit
                if len(own):
                    dense = counts.setdefault((c, prefix), np.zeros(1 << DIGIT_BITS, np.int64))
                    dense += np.bincount(own.astype(np.int64), minlength=1 << DIGIT_BITS)
    for (c, prefix), dense in counts.items():
        some = np.flatnonzero(dense)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), c, np.int32)), pa.array(np.full(len(some), prefix, np.int64)),
             pa.array(some.astype(np.int32)), pa.array(dense[some])], names=["column", "prefix", "digit", "n"])


def _number(ordered: int) -> float:
    """The double that has these bits in the order of the values."""
    bits = np.uint64(ordered)
    bits = bits & np.uint64((1 << 63) - 1) if bits >> np.uint64(63) else ~bits
    return float(np.array([bits]).view(np.float64)[0])


def _open(column: Column, level: int, prefixes: list[int]) -> Column:
    """The values that may begin like one of the prefixes, others NULL; an end that is no number lets more through."""
    shift = 64 - DIGIT_BITS * level
    some = F.lit(False)
    for prefix in prefixes:
        low, high = _number(prefix << shift), _number((prefix + 1 << shift) - 1)
        from_low = column >= low            # so is NaN
        if np.isnan(low):
            from_low = F.isnan(column) if prefix << shift >> 63 else F.lit(True)
        some = some | from_low & (F.lit(True) if np.isnan(high) else column <= high)
    return F.when(some, column)


def _ranks(counts: DataFrame, wanted: list[tuple[int, int, int]]) -> dict[tuple[int, int, int], tuple[int, int]]:
    """(column, prefix, rank below it) -> (digit at that rank, rank below the digit)."""
    spark = counts.sparkSession
    asked = F.broadcast(spark.createDataFrame(sorted(set(wanted)), "column int, prefix long, rank long"))
    upto = F.sum("n").over(Window.partitionBy("column", "prefix").orderBy("digit"))   # a prefix has 65,536 digits
    hit = counts.withColumn("upto", upto).join(asked, ["column", "prefix"]).where(
        (F.col("upto") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
    return {(r["column"], r["prefix"], r["rank"]): (r["digit"], r["rank"] - (r["upto"] - r["n"])) for r in hit.collect()}


#: Bits of a level of the radix selection; four levels make a double.
DIGIT_BITS = 16


def exact_percentiles(df: DataFrame, columns: list[str], percents: tuple[float, ...] = K.CLIP_PERCENTILES,
                      accuracy: int | None = None) -> DataFrame:
    """Exact linear-interpolated percentiles, one row per (column, percent), by radix selection.

    Values are taken as 64-bit numbers in the same order. A pass counts the next 16 bits of all values
    that begin like a wanted one, for all columns and ranks at once, so four passes give every value bit
    by bit, however they are spread: no range of values is assumed and none is gathered. ``accuracy``
    has no effect; callers of the earlier, sketch-based form may still give it.
    """
    spark = df.sparkSession
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])

    def counted(level: int, prefixes: dict[int, list[int]]) -> DataFrame:
        given = numbers
        if level:        # only rows with an open value leave Spark's own scan
            given = numbers.select(*[_open(F.col(c), level, prefixes.get(k, [])).alias(c) for k, c in enumerate(numbers.columns)])
            given = given.where(F.coalesce(*given.columns).isNotNull())
        parts = given.mapInArrow(lambda batches: _radix_counts(batches, level, prefixes),
                                   "column int, prefix bigint, digit int, n bigint")
        return cut_lineage(parts.groupBy("column", "prefix", "digit").agg(F.sum("n").alias("n")))

    counts = counted(0, {c: [0] for c in range(len(columns))})
    total = {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.sum("n").alias("n")).collect()}
    plan, state = [], {}
    for c in total:
        for p in percents:
            rank = (total[c] - 1) * p / 100            # between the 0-based ranks floor(rank) and floor(rank) + 1
            ends = int(rank), min(int(rank) + 1, total[c] - 1)
            plan.append((c, p, *ends, rank - int(rank)))
            state |= {(c, r): (0, r) for r in ends}
    for level in range(64 // DIGIT_BITS):
        if level and state:
            prefixes: dict[int, list[int]] = {}
            for (c, _), (prefix, _) in state.items():
                prefixes.setdefault(c, []).append(prefix)
            counts = counted(level, {c: sorted(set(p)) for c, p in prefixes.items()})
        found = _ranks(counts, [(c, *at) for (c, _), at in state.items()]) if state else {}
        state = {(c, r): (at[0] << DIGIT_BITS | found[c, *at][0], found[c, *at][1]) for (c, r), at in state.items()}

    def value(c: int, rank: int) -> float:
        return _number(state[c, rank][0])

    # a rank that is whole is that value, also beside an infinite one
    rows = [(columns[c], float(p), value(c, a) + (value(c, b) - value(c, a)) * part if part else value(c, a))
            for c, p, a, b, part in plan]
    rows += [(name, float(p), None) for c, name in enumerate(columns) if c not in total for p in percents]
    return spark.createDataFrame(rows, "column string, percent double, bound double")


def clip_bounds(train: DataFrame, columns: list[str], percents: tuple[float, float] = K.CLIP_PERCENTILES) -> DataFrame:
    """(column, low, high) fitted on the training rows, rounded to 32-bit floats."""
    low, high = percents
    return exact_percentiles(train, columns, percents).groupBy("column").agg(
        F.max(F.when(F.col("percent") == low, F.col("bound"))).cast("float").cast("double").alias("low"),
        F.max(F.when(F.col("percent") == high, F.col("bound"))).cast("float").cast("double").alias("high"))


def apply_clip(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Saved bounds on raw features, before scaling."""
    return df.withColumns({c: clip(F.col(c), F.lit(low), F.lit(high)) for c, (low, high) in bounds.items()})


def scale_statistics(train: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, std): population std, 1 where a column does not vary."""
    row = train.agg(*[F.avg(c).alias(f"m_{n}") for n, c in enumerate(columns)],
                    *[F.stddev_pop(c).alias(f"s_{n}") for n, c in enumerate(columns)])
    items = [F.struct(F.lit(c).alias("column"), F.col(f"m_{n}").alias("mean"),
                      F.when(F.col(f"s_{n}") == 0, 1.0).otherwise(F.col(f"s_{n}")).alias("std"))
             for n, c in enumerate(columns)]
    return row.select(F.inline(F.array(*items)))


def apply_scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


def as_dict(small: DataFrame, *values: str) -> dict[str, tuple]:
    """One fitted row per feature column, brought to the driver (bounded by the schema)."""
    return {r["column"]: tuple(r[v] for v in values) for r in small.collect()}


def class_weights(df: DataFrame, label: str, power: float = K.CLASS_WEIGHT_POWER,
                  bounds: tuple[float, float] = K.CLASS_WEIGHT_RANGE) -> DataFrame:
    """Softened balanced weights over the classes present."""
    counts = df.groupBy(label).agg(F.count("*").alias("rows"))
    classes = Window.partitionBy(F.lit(1))   # one row per class
    balanced = F.sum("rows").over(classes) / (F.count("*").over(classes) * F.col("rows"))
    return counts.select(
        label, "rows", balanced.alias("balanced"),
        clip(F.pow(balanced, F.lit(power)), F.lit(bounds[0]), F.lit(bounds[1])).alias("weight"))


# ---- dedup, samples, splits ------------------------------------------------------------

def dedup(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per distinct (features + label); duplicates collapse before the shuffle."""
    return df.select(*columns).distinct()


#: Strata (classes) so many of which may be broadcast with their cut rows.
BROADCAST_STRATA = 10_000


def _order(key: list[str], seed: int) -> Column:
    return F.struct(shuffle_key(seed, *key).alias("digest"), *key)


def _range_counts(df: DataFrame, stratum: str, key: list[str], seed: int) -> DataFrame:
    """Rows of each stratum by the first 16 bits of the rows' md5, with the stratum's size and what lies before."""
    counts = df.groupBy(F.col(stratum).alias("_stratum"), F.substring(shuffle_key(seed, *key), 1, 4).alias("_range")).agg(
        F.count("*").alias("rows"))
    own = Window.partitionBy("_stratum")          # 65,536 ranges at most
    return counts.select("*", F.sum("rows").over(own).alias("n"),
                         (F.sum("rows").over(own.orderBy("_range")) - F.col("rows")).alias("before"))


def _cut_rows(df: DataFrame, counts: DataFrame, stratum: str, key: list[str], cuts: list[Column], seed: int) -> DataFrame:
    """Per _stratum _cut_0, _cut_1, ...: the row (its order) up to which as many rows lie in md5 order as ``cuts`` say.

    A histogram of hash ranges tells which range holds a cut; only the rows of those ranges are ranked, one in 65,536.
    """
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("cut"), (c.cast("bigint") - F.col("before")).alias("place")) for i, c in enumerate(cuts)]))
    borders = counts.select("_stratum", "_range", "rows", at.alias("c")).select("_stratum", "_range", "rows", "c.*").where(
        "place between 1 and rows").groupBy("_stratum", "_range").agg(F.collect_list(F.struct("cut", "place")).alias("cuts"))
    borders = F.broadcast(borders) if borders.count() <= BROADCAST_STRATA else borders
    narrow = df.select(F.col(stratum).alias("s"), _order(key, seed).alias("order"))
    inside = narrow.join(borders, narrow["s"].eqNullSafe(borders["_stratum"]) & (F.substring("order.digest", 1, 4) == F.col("_range")))
    place = F.row_number().over(Window.partitionBy("_stratum", "_range").orderBy("order"))
    hits = inside.withColumn("place", place).select("_stratum", "order", "place", F.explode("cuts").alias("c")).where("place = c.place")
    return hits.groupBy("_stratum").agg(*[F.max(F.when(F.col("c.cut") == i, F.col("order"))).alias(f"_cut_{i}") for i in range(len(cuts))])


def _decided(df: DataFrame, stratum: str, cut_rows: DataFrame) -> DataFrame:
    """``df`` with its stratum's cut rows; few strata travel to the rows, so these are not shuffled."""
    cut_rows = cut_lineage(cut_rows)
    cut_rows = F.broadcast(cut_rows) if cut_rows.count() <= BROADCAST_STRATA else cut_rows
    return df.join(cut_rows, df[stratum].eqNullSafe(cut_rows["_stratum"]), "left").drop("_stratum")


def _upto(order: Column, cut: str) -> Column:
    return F.coalesce(order <= F.col(cut), F.lit(False))


def balanced_sample(df: DataFrame, label: str, key: list[str], size: int, keep: int = 10_000,
                    floor: int = 15_000, seed: int = 42) -> DataFrame:
    """Per class: all rows up to ``keep``, else min(n, max(floor, int(size * n / total))), the first in md5 order.

    Rows equal in ``key`` stay together.
    """
    counts = cut_lineage(_range_counts(df, label, key, seed))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    if size >= total:
        return df
    n = F.col("n")
    share = F.floor(F.lit(size) * n / F.lit(total))
    quota = F.when(n <= keep, n).otherwise(F.least(n, F.greatest(F.lit(floor), share)))
    chosen = _decided(df, label, _cut_rows(df, counts, label, key, [quota], seed))
    return chosen.where(_upto(_order(key, seed), "_cut_0")).drop("_cut_0")


def stratified_split(df: DataFrame, label: str, key: list[str], train: int, validation: int,
                     seed: int = 42) -> DataFrame:
    """Column ``split``; ``train`` and ``validation`` are percentages in md5 order, the rest is test.

    Rows equal in ``key`` stay together.
    """
    counts = cut_lineage(_range_counts(df, label, key, seed))
    cuts = [(F.col("n") * p - F.col("n") * p % 100) / 100 for p in (train, train + validation)]
    order = _order(key, seed)
    return _decided(df, label, _cut_rows(df, counts, label, key, cuts, seed)).withColumn(
        "split", F.when(_upto(order, "_cut_0"), "train").when(_upto(order, "_cut_1"), "validation").otherwise("test")
    ).drop("_cut_0", "_cut_1")


def group_split(df: DataFrame, group: str, validation: int = 20, seed: int = 42) -> DataFrame:
    """Whole groups go to train or validation by hash; no shuffle, no straddling."""
    slot = F.conv(F.substring(shuffle_key(seed, group), 1, 6), 16, 10).cast("bigint") % 100
    return df.withColumn("split", F.when(slot < validation, "validation").otherwise("train"))


def encode_labels(df: DataFrame, label: str) -> DataFrame:
    """Class -> index in alphabetical order (one row per class)."""
    classes = df.filter(F.col(label).isNotNull()).select(label).distinct()
    ordered = classes.agg(F.array_sort(F.collect_set(label)).alias("all"))
    return ordered.select(F.posexplode("all").alias("index", label))
