"""Documents that are written and read back, audits of files, mergeable profiles, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netloom.functions import constants as K
from netloom.operators import audit, campaigns as camp, evaluate as ev, learn, prepare as prep, profile as prof, sketches
from netloom.plans.dataset_queries import GROUP_SQL
from netloom.plans.registry import query, rounded, scratch
from netloom.plans.score_queries import _plain, _scored, scored
from netloom.sources import documents as docs

# ---- metrics and profile documents -------------------------------------------------------------------

query("metrics_document", "scores", sql=f"""
WITH {_scored(0.3)}, {_plain.strip()},
bin AS (SELECT count(*) FILTER (truth <> 'Benign' AND model_class <> 'Benign') AS tp, count(*) FILTER (truth = 'Benign' AND model_class <> 'Benign') AS fp,
             count(*) FILTER (truth <> 'Benign' AND model_class = 'Benign') AS fn FROM d)
SELECT round(avg(f), 6) AS macro_f1, round((SELECT tp / (tp + fp) FROM bin), 6) AS attack_precision, round((SELECT tp / (tp + fn) FROM bin), 6) AS attack_recall
FROM prf""")(lambda scores: _metrics_document(scores))


def _metrics_document(scores: DataFrame) -> DataFrame:
    path, rows = scratch(scores.sparkSession), scored(scores, 0.3)
    overall = ev.class_report(rows, "truth", "model_class").agg(F.avg("f1").alias("macro_f1"))
    hit, real = F.col("model_class") != "Benign", F.col("truth") != "Benign"
    binary = rows.agg(F.count_if(hit & real).alias("tp"), F.count_if(hit).alias("called"), F.count_if(real).alias("real")).select(
        (F.col("tp") / F.col("called")).alias("precision"), (F.col("tp") / F.col("real")).alias("recall"))
    docs.write_metrics(overall, binary, path)
    found = scores.sparkSession.read.schema(
        "macro_f1 double, binary_attack_vs_benign struct<precision: double, recall: double>").json(path)
    return rounded(found.select("macro_f1", F.col("binary_attack_vs_benign.precision").alias("attack_precision"),
                                F.col("binary_attack_vs_benign.recall").alias("attack_recall")),
                   "macro_f1", "attack_precision", "attack_recall")


_CHECKED = ["class_label", "f_price", "f_tax", "f_disc"]

query("profile_document", "flows", sql="""
SELECT count(*) AS "rows", count(*) FILTER (f_tax IS NULL) AS f_tax_nulls, count(*) FILTER (isinf(f_tax)) AS f_tax_infinities,
       1 AS columns_with_nulls, 'double' AS f_price_type FROM flows""")(lambda flows: _profile_document(flows))


def _profile_document(flows: DataFrame) -> DataFrame:
    path, narrow = scratch(flows.sparkSession), flows.select(*_CHECKED)
    docs.write_profile(narrow, prof.column_profile(narrow), prof.infinity_counts(narrow), path)
    found = flows.sparkSession.read.schema(
        "`rows` bigint, columns int, dtypes map<string, string>, columns_with_nulls map<string, bigint>, "
        "columns_with_infinities map<string, bigint>").json(path)
    return found.select("rows", F.col("columns_with_nulls")["f_tax"].alias("f_tax_nulls"),
                        F.col("columns_with_infinities")["f_tax"].alias("f_tax_infinities"),
                        F.size("columns_with_nulls").alias("columns_with_nulls"), F.col("dtypes")["f_price"].alias("f_price_type"))


# ---- profiles that merge -----------------------------------------------------------------------------

query("merged_profile", "events", sql="""
WITH e AS (SELECT * FROM events WHERE ts::DATE > (SELECT min(ts)::DATE FROM events)),
c AS (SELECT 'user_id' AS "column", count(*) AS "rows", count(*) FILTER (user_id IS NULL) AS null_count FROM e
      UNION ALL SELECT 'event_type', count(*), count(*) FILTER (event_type IS NULL) FROM e
      UNION ALL SELECT 'value', count(*), count(*) FILTER (value IS NULL) FROM e)
SELECT *, 0::BIGINT AS infinities, true AS distinct_within_bound,
       CASE WHEN "column" <> 'event_type' THEN true END AS quantiles_within_bound FROM c""")(lambda events: _merged_profile(events))


def _merged_profile(events: DataFrame) -> DataFrame:
    """Sketches stored by day and merged for all days but the first; their figures against exact ones."""
    path, columns = scratch(events.sparkSession), ["user_id", "event_type", "value"]
    dated = events.withColumn("day", F.to_date("ts"))
    sketches.daily_profile(dated, "day", columns).write.parquet(path)
    daily = events.sparkSession.read.parquet(path)
    first = daily.agg(F.min("day")).first()[0]
    merged = sketches.merged_profile(daily.where(F.col("day") > F.lit(first)))
    known = {r["column"]: r for r in merged.collect()}      # a row for each column
    later = dated.where(F.col("day") > F.lit(first))
    sums = []
    for c in columns:
        sums.append(F.count_distinct(c).alias(f"{c}_n"))
        sums += [F.avg((F.col(c) <= q).cast("double")).alias(f"{c}_{i}") for i, q in enumerate(known[c]["quantiles"] or ())]
    exact = later.agg(*sums).first()
    rows = []
    for c in columns:
        r, about = known[c], exact[f"{c}_n"]
        ranks = [exact[f"{c}_{i}"] for i in range(len(r["quantiles"] or ()))]
        near = None if r["quantiles"] is None else all(rank >= f - sketches.RANK_ERROR for rank, f in zip(ranks, (0.25, 0.5, 0.75)))
        rows.append((c, r["rows"], r["null_count"], r["infinities"], abs(r["about_unique"] - about) <= sketches.DISTINCT_ERROR * about, near))
    return events.sparkSession.createDataFrame(
        rows, "column string, rows bigint, null_count bigint, infinities bigint, distinct_within_bound boolean, quantiles_within_bound boolean")


# ---- audits of files and contracts -------------------------------------------------------------------

query("split_file_audit", "flows", sql=f"""
WITH s AS (SELECT *, {GROUP_SQL} AS split FROM flows), v AS (SELECT * FROM s WHERE split = 'validation')
SELECT 'parquet hash' AS check_name, sha256('validation:' || (count(*) - 1) || chr(10)) AS expected,
       sha256('validation:' || count(*) || chr(10)) AS actual FROM v
UNION ALL SELECT 'connection_ids', '-1', NULL
UNION ALL SELECT 'connection_ids', NULL, min(connection_id::VARCHAR) FROM v
UNION ALL SELECT 'classes', 'Benign,Botnet,Bruteforce,DDoS,DoS,Portscan', string_agg(DISTINCT class_label, ',' ORDER BY class_label) FROM v""")(
    lambda flows: _split_file_audit(flows))


def _split_file_audit(flows: DataFrame) -> DataFrame:
    """A plan whose digest is one of an older file, and whose connections are one short and one too many."""
    spark, path = flows.sparkSession, scratch(flows.sparkSession)
    held = prep.group_split(flows, "campaign_id").filter("split = 'validation'").withColumnRenamed("class_label", "ClassLabel")
    text = lambda n: F.concat(F.lit("validation:"), n.cast("string"))
    held.agg(text(F.count("*")).alias("value")).coalesce(1).write.text(path)
    found = held.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.col("connection_id").cast("string"))).alias("ids"))
    none = F.lit(None).cast("array<string>")
    split = F.struct(F.lit("x").alias("parquet"), F.sha2(F.concat(text(F.col("n") - 1), F.lit("\n")), 256).alias("parquet_sha256"),
                     F.col("n").alias("usable_rows"), none.alias("campaign_ids"),
                     F.concat(F.slice("ids", F.lit(2), F.size("ids")), F.array(F.lit("-1"))).alias("connection_ids"))
    plan = found.select(F.create_map(F.lit("validation"), split).alias("splits"))
    return audit.audit_split(plan, "validation", held.select("campaign_id", "connection_id", "ClassLabel", "f_qty"),
                             docs.file_digests(spark, f"{path}/*.txt"), ["f_qty"])


query("missing_columns", "flows", sql="""
SELECT domain AS dataset, c AS "column" FROM (SELECT DISTINCT domain FROM flows), (VALUES ('f_none'), ('f_tax')) v(c)
WHERE c <> 'f_tax' OR domain = 'lab'""")(lambda flows: _missing_columns(flows))


def _missing_columns(flows: DataFrame) -> DataFrame:
    """A data set per domain, one of them written without a column; what its scan would be refused for."""
    spark, path, rows = flows.sparkSession, scratch(flows.sparkSession), []
    for domain in ("lab", "cic"):
        own = flows.filter(F.col("domain") == domain).select("flow_id", "f_qty", "f_tax")
        (own.drop("f_tax") if domain == "lab" else own).write.parquet(f"{path}/{domain}")
        rows.append((domain, docs.read_dataset(spark, f"{path}/{domain}", ["flow_id"]).columns))
    return prep.missing_columns(spark.createDataFrame(rows, "dataset string, columns array<string>"), ["f_qty", "f_tax", "f_none"])


query("reference_labels", "customer", sql="""
SELECT 'm' || c_custkey AS mode, CASE WHEN c_custkey % 5 = 0 THEN 'reference label' ELSE 'non-finite parameter' END AS rule
FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0 AND c_custkey % 5 <> 0
UNION ALL SELECT 'm' || c_custkey, 'non-finite parameter' FROM customer WHERE c_custkey % 35 = 0""")(lambda customer: _reference_labels(customer))


def _reference_labels(customer: DataFrame) -> DataFrame:
    """Profile documents with numbers for reference labels and endless parameters, read back and judged."""
    path, k = scratch(customer.sparkSession), F.col("c_custkey")
    label = F.when(k % 5 == 0, "7").when(k % 3 == 0, "null").otherwise('"a reference"')
    endless = F.when(k % 7 == 0, F.element_at(F.array(F.lit("NaN"), F.lit("Infinity"), F.lit("-Infinity")), (k % 3 + 1).cast("int"))).otherwise("1.5")
    text = F.concat(F.lit('"m'), k.cast("string"), F.lit('": {"class_label": "DoS", "scenario_label": "lab-a", "reference_label": '), label,
                    F.lit(', "max_seconds": 20, "max_actions": 12, "max_outbound_bytes": 1000, "parameters": {"ratio": '), endless, F.lit("}}"))
    grouped = customer.select(text.alias("t"), F.floor(k / 100).alias("doc")).groupBy("doc").agg(F.concat(
        F.lit('{"schema_version": 1, "profiles": {'), F.array_join(F.collect_list("t"), ", "), F.lit("}}")).alias("value"))
    grouped.repartition("doc").write.partitionBy("doc").text(path)
    return camp.profile_violations(docs.read_profiles(customer.sparkSession, path))


query("bundle_violations", "flows", sql="""
SELECT * FROM (VALUES ('reordered', 'stage2_features differ from the model''s order'), ('short', 'stage 2 classes differ from the encoder'),
  ('short', 'stage 2 labels differ from the 7- and 8-class schemas'), ('gate', 'stage 1 threshold must be between 0 and 1')) t(bundle, problem)""")(
    lambda flows: _bundle_violations(flows))


def _bundle_violations(flows: DataFrame) -> DataFrame:
    """Two small models of the flows, saved and loaded with metadata that fits or does not."""
    spark, path, features = flows.sparkSession, scratch(flows.sparkSession), ["f_qty", "f_price"]
    rows = prep.binary_target(prep.remap_classes(prep.strip_label(flows, "class_label"), "class_label"), "class_label")
    index = {name: float(n) for n, name in enumerate(K.OUTPUT_CLASSES)}
    rows = rows.withColumn("i", F.element_at(F.create_map(*[F.lit(x) for item in index.items() for x in item]), F.col("class_label")))
    stage1 = learn.stage1_model(rows, features, "target", "forest", None, 2, 2)
    stage2 = learn.stage2_model(rows, features, "i", 7, "logistic", iterations=1)
    fits = {"stage1_threshold": 0.3, "classes": list(K.OUTPUT_CLASSES), "stage1_features": features, "stage2_features": features,
            "clip_bounds": dict.fromkeys(features), "scale_statistics": dict.fromkeys(features)}
    learn.save_bundle(spark, path, stage1, stage2, fits)
    stage1, stage2, read = learn.load_bundle(spark, path)
    cases = {"fits": read, "reordered": read | {"stage2_features": features[::-1]},
             "short": read | {"classes": read["classes"][:-1]}, "gate": read | {"stage1_threshold": 1.5}}
    return spark.createDataFrame([(name, problem) for name, metadata in cases.items()
                                  for problem in learn.bundle_problems(stage1, stage2, metadata)], "bundle string, problem string")
