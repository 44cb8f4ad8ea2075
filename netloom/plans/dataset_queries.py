"""Queries over labelled flows: cleaning, statistics, sampling, splits, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netloom.functions import constants as K
from netloom.functions.exprs import is_finite
from netloom.operators import prepare as prep, profile as prof
from netloom.plans.registry import query, r6, rounded, scratch
from netloom.sources.documents import read_dataset, read_lab_split, write_splits

FEATURES = ["f_qty", "f_price", "f_price2", "f_disc", "f_tax", "f_const"]
CLEAN = ["f_qty", "f_price", "f_price2", "f_disc", "f_tax"]
ID = ["flow_id", "h"]

_finite = "(f_tax IS NOT NULL AND NOT isnan(f_tax) AND NOT isinf(f_tax))"
_stripped = "regexp_replace(class_label, '^\\s+|\\s+$', '', 'g')"
_names = ", ".join(f"'{c}'" for c in K.FOCUS_CLASSES)
_benign = ", ".join(f"'{c}'" for c in K.BENIGN_LABELS)


# ---- scans -------------------------------------------------------------------------

query("parquet_scan", "lineitem", sql="SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")(
    lambda lineitem: prep.require_columns(lineitem, ["l_orderkey", "l_linenumber"]).select(
        "l_orderkey", "l_linenumber", "l_quantity"))


@query("lab_split_scan", "flows", sql=f"""
SELECT campaign_id, connection_id, {_stripped} AS "ClassLabel", f_qty, f_price FROM flows WHERE domain = 'lab'""")
def lab_split_scan(flows: DataFrame) -> DataFrame:
    """Write the lab rows as a wide split file, read back the contract columns only."""
    path = scratch(flows.sparkSession)
    lab = prep.strip_label(flows.filter("domain = 'lab'"), "class_label").withColumnRenamed("class_label", "ClassLabel")
    lab.write.parquet(f"{path}/lab")
    return read_lab_split(flows.sparkSession, f"{path}/lab", ["f_qty", "f_price"])


# ---- labels ----------------------------------------------------------------------------

query("label_strip", "flows", sql=f"""
SELECT {_stripped} AS class_label, count(*) AS "rows" FROM flows GROUP BY 1""")(
    lambda flows: prep.strip_label(flows, "class_label").groupBy("class_label").agg(F.count("*").alias("rows")))

query("binary_target", "flows", sql=f"""
SELECT flow_id, h, CASE WHEN class_label IN ({_benign}) THEN 0 ELSE 1 END AS target FROM flows""")(
    lambda flows: prep.binary_target(flows, "class_label").select("flow_id", "h", "target"))

query("class_remap", "flows", sql=f"""
SELECT CASE WHEN {_stripped} IN ('Benign', {_names}) THEN {_stripped} ELSE 'Other Attack' END AS class_label,
       count(*) AS "rows", sum(CASE WHEN {_stripped} IN ('Benign', {_names}) THEN 0 ELSE 1 END)::BIGINT AS remapped
FROM flows GROUP BY 1""")(
    lambda flows: prep.remap_classes(prep.strip_label(flows, "class_label"), "class_label").groupBy("class_label").agg(
        F.count("*").alias("rows"), F.sum("remapped").alias("remapped")))

query("class_set_violations", "flows", sql=f"""
WITH c AS (SELECT class_label AS class, count(*) AS "rows" FROM flows GROUP BY 1),
a AS (SELECT unnest([{', '.join(f"'{c}'" for c in [*K.SOURCE_CLASSES, 'Unseen'])}]) AS class)
SELECT class, 'unexpected' AS problem, "rows" FROM c WHERE class NOT IN (SELECT class FROM a)
UNION ALL SELECT class, 'missing', 0 FROM a WHERE class NOT IN (SELECT class FROM c)""")(
    lambda flows: prep.class_violations(flows, "class_label", [*K.SOURCE_CLASSES, "Unseen"]))


# ---- columns and values -------------------------------------------------------------------

query("column_exclusion", "flows", sql="""
SELECT flow_id, h, f_qty, f_price2, f_disc, f_const FROM flows""")(
    lambda flows: prep.drop_columns(flows, ["class_label", "domain", "campaign_id", "connection_id", "snapshot_no",
                                            "f_price", "f_tax", *K.STAGE1_EXCLUDED]))

query("numeric_columns", "flows", sql=f"""
SELECT flow_id, h, campaign_id, connection_id, snapshot_no, f_qty, f_price, f_disc FROM flows""")(
    lambda flows: flows.drop("f_price2", "f_tax", "f_const").select(
        prep.numeric_columns(flows.drop("f_price2", "f_tax", "f_const"))[0]))

query("non_finite_to_zero", "flows", sql=f"""
SELECT flow_id, h, CASE WHEN {_finite} THEN f_tax ELSE 0 END AS f_tax FROM flows""")(
    lambda flows: prep.fill_non_finite(flows, ["f_tax"]).select("flow_id", "h", "f_tax"))

query("drop_non_finite_rows", "flows", sql=f"""
SELECT domain, count(*) AS all_rows, count(*) FILTER ({_finite}) AS kept,
       count(*) FILTER (NOT {_finite}) AS removed FROM flows GROUP BY domain""")(
    lambda flows: _removed_rows(flows))


def _removed_rows(flows: DataFrame) -> DataFrame:
    kept = prep.finite_rows(flows, CLEAN).groupBy("domain").agg(F.count("*").alias("kept"))
    both = flows.groupBy("domain").agg(F.count("*").alias("all_rows")).join(kept, "domain", "left")
    kept_rows = F.coalesce("kept", F.lit(0))
    return both.select("domain", "all_rows", kept_rows.alias("kept"), (F.col("all_rows") - kept_rows).alias("removed"))


query("finite_rows", "flows", sql=f"SELECT flow_id, h, f_tax FROM flows WHERE {_finite}")(
    lambda flows: prep.finite_rows(flows, CLEAN, "class_label").select("flow_id", "h", "f_tax"))

query("feature_contract_violations", "flows", sql="""
SELECT flow_id, h, 'f_tax' AS feature, CASE WHEN f_tax IS NULL THEN 'non-numeric' ELSE 'non-finite' END AS problem
FROM flows WHERE f_tax IS NULL OR isnan(f_tax) OR isinf(f_tax)
UNION ALL SELECT flow_id, h, 'class_label', 'non-numeric' FROM flows
UNION ALL SELECT flow_id, h, 'f_absent', 'missing' FROM flows""")(
    lambda flows: prep.contract_violations(flows, ID, ["f_qty", "f_tax", "class_label", "f_absent"]))


@query("ordered_vector", "flows", sql=f"""
SELECT flow_id, h, {", ".join(f"CAST({c} AS DOUBLE) AS v{n}" for n, c in enumerate(CLEAN))} FROM flows WHERE {_finite}""")
def ordered_vector(flows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    vectors = prep.assemble(prep.finite_rows(flows, CLEAN), CLEAN)
    values = vectors.select("flow_id", "h", vector_to_array("features").alias("features"))
    return values.select("flow_id", "h", *[F.col("features")[n].alias(f"v{n}") for n in range(len(CLEAN))])


query("infinity_counts", "flows", sql="""
SELECT * FROM (SELECT 'f_qty' AS "column", count(*) FILTER (isinf(f_qty)) AS infinities FROM flows
UNION ALL SELECT 'f_tax', count(*) FILTER (isinf(f_tax)) FROM flows)""")(
    lambda flows: prof.infinity_counts(flows, ["f_qty", "f_tax"]))


# ---- domains --------------------------------------------------------------------------------

def _domains(flows: DataFrame) -> DataFrame:
    cic, lab = flows.filter("domain = 'cic'").drop("domain"), flows.filter("domain = 'lab'").drop("domain")
    return prep.append_domains(cic, lab, CLEAN)


query("domain_append", "flows", sql="""
SELECT domain, count(*) AS "rows", sum(f_qty) AS qty FROM flows GROUP BY domain""")(
    lambda flows: _domains(flows).groupBy("domain").agg(F.count("*").alias("rows"), F.sum("f_qty").alias("qty")))

query("row_replication", "flows", sql="""
SELECT flow_id, h, copy FROM flows, (SELECT unnest([1, 2, 3]) AS copy) WHERE domain = 'lab' OR copy = 1""")(
    lambda flows: prep.replicate(flows, 3, F.col("domain") == "lab").select("flow_id", "h", "copy"))

query("sample_weights", "flows", sql="""
SELECT flow_id, h, CASE WHEN domain = 'lab' THEN 10.0 ELSE 1.0 END::DOUBLE AS weight FROM flows""")(
    lambda flows: prep.sample_weight(flows, 10.0).select("flow_id", "h", "weight"))


# ---- statistics --------------------------------------------------------------------------------

query("series_statistics", "packets", sql="""
SELECT user_id, min(pkt_len) AS low, max(pkt_len) AS high, round(avg(pkt_len), 6) AS mean,
       round(coalesce(stddev_samp(pkt_len), 0), 6) AS std, round(coalesce(var_samp(pkt_len), 0), 6) AS var
FROM packets GROUP BY user_id""")(
    lambda packets: rounded(packets.groupBy("user_id").agg(
        F.min("pkt_len").alias("low"), F.max("pkt_len").alias("high"), F.avg("pkt_len").alias("mean"),
        F.coalesce(F.stddev_samp("pkt_len"), F.lit(0.0)).alias("std"),
        F.coalesce(F.var_samp("pkt_len"), F.lit(0.0)).alias("var")), "mean", "std", "var"))

query("class_histogram", "flows", sql="""
SELECT class_label, count(*) AS "rows", round(count(*) / sum(count(*)) OVER (), 6) AS share FROM flows GROUP BY 1""")(
    lambda flows: rounded(prof.class_histogram(flows, "class_label"), "share"))

_pairs = [(a, b) for n, a in enumerate(FEATURES) for b in FEATURES[n + 1:]]
_corr = " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", CASE WHEN '{a}' = 'f_const' OR '{b}' = 'f_const' THEN NULL "
    f"ELSE abs(corr({a}, {b})) END AS r FROM z" for a, b in _pairs)
_zeroed = f"z AS (SELECT * REPLACE (CASE WHEN {_finite} THEN f_tax ELSE 0 END AS f_tax) FROM flows)"

query("correlation_matrix", "flows", sql=f"""
WITH {_zeroed}, c AS ({_corr}) SELECT "left", "right", round(r, 6) AS r FROM c""")(
    lambda flows: rounded(prep.correlation_pairs(prep.fill_non_finite(flows, ["f_tax"]), FEATURES), "r").drop("i", "j"))

query("correlation_pruning", "flows", sql=f"""
WITH {_zeroed}, c AS ({_corr})
SELECT "right" AS "column", count(*) AS partners, round(max(r), 6) AS r FROM c WHERE r > 0.95 GROUP BY 1""")(
    lambda flows: rounded(prep.correlated_columns(
        prep.correlation_pairs(prep.fill_non_finite(flows, ["f_tax"]), FEATURES)), "r"))

_bounds = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(quantile_cont({c}, 0.005)::FLOAT::DOUBLE, 6) AS low, "
    f"round(quantile_cont({c}, 0.995)::FLOAT::DOUBLE, 6) AS high FROM t" for c in CLEAN)

query("clip_bounds", "flows", sql=f"""
WITH t AS (SELECT * FROM flows WHERE {_finite}) {_bounds}""")(
    lambda flows: rounded(prep.clip_bounds(prep.finite_rows(flows, CLEAN), CLEAN), "low", "high"))

query("percentile_clipping", "flows", sql=f"""
WITH t AS (SELECT * FROM flows WHERE {_finite}),
b AS (SELECT quantile_cont(f_price, 0.005)::FLOAT::DOUBLE AS lo, quantile_cont(f_price, 0.995)::FLOAT::DOUBLE AS hi FROM t)
SELECT flow_id, h, round(least(greatest(f_price, lo), hi), 6) AS f_price FROM t, b""")(
    lambda flows: _clipped(flows))


def _clipped(flows: DataFrame) -> DataFrame:
    clean = prep.finite_rows(flows, CLEAN)
    bounds = prep.as_dict(prep.clip_bounds(clean, ["f_price"]), "low", "high")
    return rounded(prep.apply_clip(clean, bounds).select("flow_id", "h", "f_price"), "f_price")


_stats = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, "
    f"round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 6) AS std FROM t" for c in [*CLEAN, "f_const"])

query("scale_statistics", "flows", sql=f"WITH t AS (SELECT * FROM flows WHERE {_finite}) {_stats}")(
    lambda flows: rounded(prep.scale_statistics(prep.finite_rows(flows, CLEAN), [*CLEAN, "f_const"]), "mean", "std"))

query("standard_scaling", "flows", sql=f"""
WITH t AS (SELECT * FROM flows WHERE {_finite}), s AS (SELECT avg(f_qty) AS m, stddev_pop(f_qty) AS d FROM t)
SELECT flow_id, h, round((f_qty - m) / d, 6) AS f_qty, (f_const - 1) / 1 AS f_const FROM t, s""")(
    lambda flows: _scaled(flows))


def _scaled(flows: DataFrame) -> DataFrame:
    clean = prep.finite_rows(flows, CLEAN)
    stats = prep.as_dict(prep.scale_statistics(clean, ["f_qty", "f_const"]), "mean", "std")
    return rounded(prep.apply_scale(clean, stats).select("flow_id", "h", "f_qty", "f_const"), "f_qty")


query("class_weights", "flows", sql="""
WITH c AS (SELECT class_label, count(*) AS "rows" FROM flows GROUP BY 1),
b AS (SELECT *, sum("rows") OVER () / (count(*) OVER () * "rows") AS balanced FROM c)
SELECT class_label, "rows", round(balanced, 6) AS balanced,
       round(least(greatest(pow(balanced, 0.5), 0.25), 10.0), 6) AS weight FROM b""")(
    lambda flows: rounded(prep.class_weights(flows, "class_label"), "balanced", "weight"))


# ---- dedup, samples, splits -----------------------------------------------------------------------

RETAINED = ["f_qty", "f_price", "f_price2", "f_disc", "f_const", "class_label"]

query("row_dedup", "flows", sql=f"SELECT DISTINCT {', '.join(RETAINED)} FROM flows")(
    lambda flows: prep.dedup(flows, RETAINED))

query("duplicate_rows_removed", "flows", sql=f"""
SELECT count(*) AS before, count(DISTINCT ({", ".join(RETAINED)})) AS after,
       count(*) - count(DISTINCT ({", ".join(RETAINED)})) AS removed FROM flows""")(
    lambda flows: _duplicates(flows))


def _duplicates(flows: DataFrame) -> DataFrame:
    left = prep.dedup(flows, RETAINED).agg(F.count("*").alias("after"), F.lit(1).alias("one"))
    return flows.agg(F.count("*").alias("before"), F.lit(1).alias("one")).join(left, "one").select(
        "before", "after", (F.col("before") - F.col("after")).alias("removed"))


_ranked = """
r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5('42|' || flow_id || '|' || h), flow_id, h) AS rk,
             count(*) OVER (PARTITION BY {by}) AS n, count(*) OVER () AS total FROM {source})"""

query("balanced_sample", "flows", sql=f"""
WITH {_ranked.format(by='class_label', source='flows')}
SELECT flow_id, h, class_label FROM r
WHERE n <= 1000 OR rk <= least(n, greatest(1500, CAST(floor(20000 * n / total) AS BIGINT)))""")(
    lambda flows: prep.balanced_sample(flows, "class_label", ID, 20_000, keep=1_000, floor=1_500).select(
        "flow_id", "h", "class_label"))

query("split_70_15_15", "flows", sql=f"""
WITH t AS (SELECT *, CASE WHEN class_label IN ({_benign}) THEN 0 ELSE 1 END AS target FROM flows),
{_ranked.format(by='target', source='t').strip()}
SELECT flow_id, h, CASE WHEN rk * 100 <= n * 70 THEN 'train' WHEN rk * 100 <= n * 85 THEN 'validation' ELSE 'test' END AS split
FROM r""")(
    lambda flows: prep.stratified_split(prep.binary_target(flows, "class_label"), "target", ID, 70, 15).select(
        "flow_id", "h", "split"))

query("split_80_10_10", "flows", sql=f"""
WITH {_ranked.format(by='class_label', source='flows')}
SELECT flow_id, h, CASE WHEN rk * 100 <= n * 80 THEN 'train' WHEN rk * 100 <= n * 90 THEN 'validation' ELSE 'test' END AS split
FROM r""")(
    lambda flows: prep.stratified_split(flows, "class_label", ID, 80, 10).select("flow_id", "h", "split"))

GROUP_SQL = "CASE WHEN ('0x' || substr(md5('42|' || campaign_id), 1, 6))::BIGINT % 100 < 20 THEN 'validation' ELSE 'train' END"
query("group_split", "flows", sql=f"SELECT flow_id, h, {GROUP_SQL} AS split FROM flows")(
    lambda flows: prep.group_split(flows, "campaign_id").select("flow_id", "h", "split"))


@query("persisted_test_split", "flows", sql=f"""
WITH {_ranked.format(by='class_label', source='flows')}
SELECT flow_id, h FROM r WHERE rk * 100 > n * 90""")
def persisted_test_split(flows: DataFrame) -> DataFrame:
    """Write the splits, re-read exactly the test rows (partition pruning)."""
    path = scratch(flows.sparkSession)
    write_splits(prep.stratified_split(flows, "class_label", ID, 80, 10).select("flow_id", "h", "split"), path)
    return read_dataset(flows.sparkSession, path).filter("split = 'test'").select("flow_id", "h")


query("label_encoding", "flows", sql="""
SELECT class_label, CAST(dense_rank() OVER (ORDER BY class_label) - 1 AS INTEGER) AS "index"
FROM (SELECT DISTINCT class_label FROM flows)""")(
    lambda flows: prep.encode_labels(flows, "class_label"))


# ---- profiles ----------------------------------------------------------------------------------------

_PROFILED = {"class_label": "string", "domain": "string", "f_tax": "double", "campaign_id": "bigint"}
query("column_profile", "flows", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) FILTER ({c} IS NULL) AS null_count, "
    f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS unique_count FROM flows"
    for c, t in _PROFILED.items()))(
    lambda flows: prof.column_profile(flows, list(_PROFILED)))

query("value_counts", "flows", sql="""
SELECT 'class_label' AS "column", class_label AS value, count(*) AS "rows" FROM flows GROUP BY class_label
UNION ALL SELECT 'domain', domain, count(*) FROM flows GROUP BY domain""")(
    lambda flows: prof.value_counts(flows, ["class_label", "domain"]))

query("top_values_few", "flows", sql="""
SELECT class_label AS value, count(*) AS "rows", round(count(*) / sum(count(*)) OVER () * 100, 6) AS percent
FROM flows GROUP BY 1""")(lambda flows: rounded(prof.top_values(flows, "class_label"), "percent"))

query("top_values_many", "flows", sql="""
SELECT CAST(connection_id AS VARCHAR) AS value, count(*) AS "rows",
       round(count(*) / (SELECT count(*) FROM flows) * 100, 6) AS percent
FROM flows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")(
    lambda flows: rounded(prof.top_values(flows, "connection_id"), "percent"))

query("label_column_finder", "flows", sql="""
SELECT class_label, count(*) AS "rows" FROM flows GROUP BY 1""")(
    lambda flows: flows.groupBy(prof.label_columns(flows)).agg(F.count("*").alias("rows")))

query("sample_rows", "flows", sql="SELECT flow_id, h, class_label FROM flows ORDER BY flow_id, h LIMIT 5")(
    lambda flows: prof.sample_rows(flows.select("flow_id", "h", "class_label"), by=["flow_id", "h"]))
query("approximate_profile", "flows")(lambda flows: prof.approximate_profile(flows, ["class_label", "domain", "f_tax"]))
