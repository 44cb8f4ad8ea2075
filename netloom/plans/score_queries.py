"""Verdict and metric queries over derived probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netloom.functions import constants as K
from netloom.operators import evaluate as ev, scoring as sc
from netloom.plans.registry import query, r6, rounded

CLASSES = K.OUTPUT_CLASSES
W = [f"w{n}" for n in range(7)]
_sum = " + ".join(W)
_list = "[" + ", ".join(f"w{n}::DOUBLE / s" for n in range(7)) + "]"
_class_list = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"
_display = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in K.DISPLAY_NAMES.items()) + "}"


def _scored(threshold: float) -> str:
    return f"""
a AS (SELECT *, ({_sum})::DOUBLE AS s FROM scores),
b AS (SELECT *, {_list} AS probabilities FROM a),
c AS (SELECT *, list_max(probabilities) AS confidence,
             {_class_list}[list_position(probabilities, list_max(probabilities))] AS predicted_class FROM b),
d AS (SELECT *, CASE WHEN confidence < {threshold} THEN 'Unknown' ELSE predicted_class END AS model_class FROM c)"""


def probabilities(scores: DataFrame) -> DataFrame:
    total = sum((F.col(w) for w in W[1:]), F.col(W[0])).cast("double")
    return scores.withColumn("probabilities", F.array(*[F.col(w).cast("double") / total for w in W])).drop(*W)


def scored(scores: DataFrame, threshold: float = K.UNKNOWN_THRESHOLD) -> DataFrame:
    return sc.argmax_with_unknown(probabilities(scores), "probabilities", CLASSES, threshold)


ID = ["flow_id", "h"]

query("probability_map", "scores", sql=f"""
WITH {_scored(0.6)}
SELECT flow_id, h, unnest({_class_list}) AS class, unnest(probabilities) AS probability FROM d""")(
    lambda scores: probabilities(scores).select(*ID, F.explode(
        sc.probability_map(CLASSES, F.col("probabilities"))).alias("class", "probability")))

query("argmax_unknown", "scores", sql=f"""
WITH {_scored(0.6)}
SELECT flow_id, h, round(confidence, 6) AS confidence, predicted_class, model_class FROM d""")(
    lambda scores: rounded(scored(scores).select(*ID, "confidence", "predicted_class", "model_class"), "confidence"))

query("stage1_gate", "scores", sql="""
SELECT flow_id, h, 'BENIGN' AS verdict, 'Normal Traffic' AS attack_type, round(1 - p_attack, 4) AS final_confidence,
       'Stage 1 (ML)' AS stage_reached FROM scores WHERE p_attack < 0.1""")(
    lambda scores: sc.gate(scores, "p_attack")[0].select(
        *ID, "verdict", "attack_type", "final_confidence", "stage_reached"))

query("gated_rows", "scores", sql="SELECT flow_id, h FROM scores WHERE p_attack >= 0.1")(
    lambda scores: sc.gate(scores, "p_attack")[1].select(*ID))

query("verdict_fusion", "scores", sql=f"""
WITH {_scored(0.6)}
SELECT flow_id, h,
       CASE WHEN p_attack < 0.1 OR model_class = 'Benign' THEN 'BENIGN' ELSE 'MALICIOUS' END AS verdict,
       CASE WHEN p_attack < 0.1 THEN 'Normal Traffic' WHEN model_class = 'Unknown' THEN 'Unknown Attack'
            ELSE {_display}[model_class] END AS attack_type,
       round(CASE WHEN p_attack < 0.1 THEN 1 - p_attack WHEN model_class = 'Unknown' THEN p_attack ELSE confidence END, 4) AS final_confidence,
       CASE WHEN p_attack < 0.1 THEN 'Stage 1 (ML)' ELSE 'Stage 2 (DL)' END AS stage_reached,
       CASE WHEN p_attack < 0.1 THEN NULL ELSE model_class END AS model_class
FROM d""")(
    lambda scores: sc.verdicts(probabilities(scores), "p_attack", "probabilities").select(
        *ID, "verdict", "attack_type", "final_confidence", "stage_reached", "model_class"))

query("display_names", "scores", sql=f"""
SELECT truth, {_display}[truth] AS display_name, count(*) AS "rows" FROM scores GROUP BY 1, 2""")(
    lambda scores: scores.groupBy("truth", sc.display_name(F.col("truth")).alias("display_name")).agg(
        F.count("*").alias("rows")))

query("runtime_attack_mask", "scores", sql=f"""
WITH {_scored(0.3)}
SELECT flow_id, h, (predicted_class <> 'Benign' OR confidence < 0.3) AS alert FROM d""")(
    lambda scores: scored(scores).select(*ID, sc.attack_mask("predicted_class", "confidence", 0.3).alias("alert")))


# ---- metrics ----------------------------------------------------------------------------------

query("confusion_matrix", "scores", sql=f"""
WITH {_scored(0.3)},
g AS (SELECT t AS truth, p AS predicted FROM (SELECT unnest({_class_list}) AS t), (SELECT unnest({_class_list}) AS p)),
n AS (SELECT truth, predicted_class AS predicted, count(*) AS n FROM d GROUP BY 1, 2),
f AS (SELECT g.truth, g.predicted, coalesce(n, 0) AS "rows" FROM g LEFT JOIN n USING (truth, predicted))
SELECT truth, predicted, "rows",
       round(CASE WHEN sum("rows") OVER (PARTITION BY truth) = 0 THEN 0.0
                  ELSE "rows" / sum("rows") OVER (PARTITION BY truth) END, 6) AS share FROM f""")(
    lambda scores: rounded(ev.confusion_matrix(scored(scores), "truth", "predicted_class", CLASSES), "share"))

_report = """
lab AS (SELECT {by} truth AS class FROM d UNION SELECT {by} {pred} FROM d),
rep AS (SELECT {lby} lab.class, count(*) FILTER (d.truth = lab.class) AS support,
               count(*) FILTER (d.{pred} = lab.class) AS called,
               count(*) FILTER (d.truth = lab.class AND d.{pred} = lab.class) AS tp
        FROM lab JOIN d ON (d.truth = lab.class OR d.{pred} = lab.class) {on} GROUP BY ALL),
prf AS (SELECT *, CASE WHEN called = 0 THEN 0.0 ELSE tp / called END AS p,
               CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS r,
               CASE WHEN called + support = 0 THEN 0.0 ELSE 2.0 * tp / (called + support) END AS f FROM rep)"""
_plain = _report.format(by="", lby="", pred="model_class", on="")
_by_domain = _report.format(by="domain,", lby="lab.domain,", pred="model_class", on="AND d.domain = lab.domain")

query("class_report", "scores", sql=f"""
WITH {_scored(0.3)}, {_plain.strip()}
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support, tp FROM prf""")(
    lambda scores: rounded(ev.class_report(scored(scores, 0.3), "truth", "model_class"), "precision", "recall", "f1"))

_summary_names = ["accuracy", "macro_precision", "macro_recall", "macro_f1",
                  "weighted_precision", "weighted_recall", "weighted_f1"]
query("summary_report", "scores", sql=f"""
WITH {_scored(0.3)}, {_plain.strip()}
SELECT round(sum(tp) / sum(support), 6) AS accuracy, sum(support)::BIGINT AS "rows", round(avg(p), 6) AS macro_precision,
       round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1,
       round(sum(p * support) / sum(support), 6) AS weighted_precision,
       round(sum(r * support) / sum(support), 6) AS weighted_recall,
       round(sum(f * support) / sum(support), 6) AS weighted_f1, avg(f) >= 0.7 AS passes_gate FROM prf""")(
    lambda scores: rounded(ev.summary_report(scored(scores, 0.3), "truth", "model_class"), *_summary_names))

query("report_long_form", "scores", sql=f"""
WITH {_scored(0.3)}, {_plain.strip()},
t AS (SELECT sum(tp) / sum(support) AS accuracy, sum(support)::DOUBLE AS n, avg(p) AS mp, avg(r) AS mr, avg(f) AS mf,
             sum(p * support) / sum(support) AS wp, sum(r * support) / sum(support) AS wr, sum(f * support) / sum(support) AS wf FROM prf)
SELECT class, metric, round(value, 6) AS value FROM (
  SELECT class, unnest(['precision', 'recall', 'f1', 'support']) AS metric, unnest([p, r, f, support::DOUBLE]) AS value FROM prf
  UNION ALL SELECT '(all)', unnest(['accuracy', 'rows', 'macro_precision', 'macro_recall', 'macro_f1', 'weighted_precision',
                                    'weighted_recall', 'weighted_f1']), unnest([accuracy, n, mp, mr, mf, wp, wr, wf]) FROM t)""")(
    lambda scores: rounded(ev.report_long(scored(scores, 0.3), "truth", "model_class"), "value"))

_counts = """
n AS (SELECT {by} count(*) FILTER (t AND c) AS tp, count(*) FILTER (NOT t AND c) AS fp,
             count(*) FILTER (t AND NOT c) AS fn, count(*) FILTER (NOT t AND NOT c) AS tn
      FROM (SELECT *, truth <> 'Benign' AS t, {call} AS c FROM d) {group})"""

query("binary_attack_metrics", "scores", sql=f"""
WITH {_scored(0.3)}, {_counts.format(by='domain,', call="model_class <> 'Benign'", group='GROUP BY domain').strip()}
SELECT domain, round(tp / (tp + fp), 6) AS attack_precision, round(tp / (tp + fn), 6) AS attack_recall,
       round(2.0 * tp / (2 * tp + fp + fn), 6) AS attack_f1, fp AS false_positives, fp + tn AS benign_rows,
       round(fp / (fp + tn), 6) AS false_positive_rate, round(1000.0 * fp / (fp + tn), 6) AS false_alarms_per_1000 FROM n""")(
    lambda scores: rounded(ev.binary_metrics(
        scored(scores, 0.3), F.col("truth") != "Benign", F.col("model_class") != "Benign", ["domain"]),
        "attack_precision", "attack_recall", "attack_f1", "false_positive_rate", "false_alarms_per_1000"))

query("thresholded_binary_metrics", "scores", sql=f"""
WITH d AS (SELECT * FROM scores), {_counts.format(by='', call='p_attack >= 0.5', group='').strip()}
SELECT 0.5::DOUBLE AS threshold, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
       round(tp / (tp + fn), 6) AS recall,
       round((2.0 * tp / (2 * tp + fp + fn) + 2.0 * tn / (2 * tn + fn + fp)) / 2, 6) AS macro_f1 FROM n""")(
    lambda scores: rounded(ev.thresholded_metrics(scores, F.col("truth") != "Benign", "p_attack", 0.5),
                           "accuracy", "precision", "recall", "macro_f1"))

_grid = "[" + ", ".join(f"{t:.2f}" for t in K.THRESHOLD_GRID) + "]::DOUBLE[]"
_domain_scores = f"""
q AS (SELECT unnest({_grid}) AS threshold),
e AS (SELECT threshold, domain, count(*) FILTER (t AND c) AS tp, count(*) FILTER (NOT t AND c) AS fp,
             count(*) FILTER (t AND NOT c) AS fn
      FROM (SELECT threshold, domain, truth <> 'Benign' AS t, (predicted_class <> 'Benign' OR confidence < threshold) AS c
            FROM d, q) GROUP BY 1, 2),
sc AS (SELECT threshold, domain, 2.0 * tp / (2 * tp + fp + fn) AS score FROM e)"""

query("threshold_scores", "scores", sql=f"""
WITH {_scored(0.3)}, {_domain_scores.strip()} SELECT threshold, domain, round(score, 6) AS score FROM sc""")(
    lambda scores: rounded(ev.domain_threshold_scores(scored(scores), "truth", "predicted_class", "confidence"), "score"))

query("threshold_tuning", "scores", sql=f"""
WITH {_scored(0.3)}, {_domain_scores.strip()}, w AS (SELECT threshold, min(score) AS score FROM sc GROUP BY 1)
SELECT threshold, round(score, 6) AS validation_score FROM w ORDER BY score DESC, threshold LIMIT 1""")(
    lambda scores: rounded(ev.tune_threshold(scored(scores), "truth", "predicted_class", "confidence"), "validation_score"))

query("domain_macro_f1", "scores", sql=f"""
WITH {_scored(0.3)}, {_by_domain.strip()} SELECT domain, round(avg(f), 6) AS macro_f1 FROM prf GROUP BY domain""")(
    lambda scores: rounded(ev.domain_macro_f1(scored(scores, 0.3), "truth", "model_class"), "macro_f1"))

query("domain_macro_f1_fixed_labels", "scores", sql=f"""
WITH {_scored(0.3)}, {_by_domain.strip()}
SELECT domain, round(sum(f) FILTER (class IN ('Benign', 'DDoS', 'DoS')) / 3, 6) AS macro_f1 FROM prf GROUP BY domain""")(
    lambda scores: rounded(ev.domain_macro_f1(scored(scores, 0.3), "truth", "model_class", ["Benign", "DDoS", "DoS"]), "macro_f1"))

query("domain_partition_check", "scores", sql="""
WITH n AS (SELECT CASE WHEN h % 41 = 0 THEN NULL WHEN h % 43 = 0 THEN 'other' ELSE domain END AS domain FROM scores)
SELECT domain, 'outside' AS problem, count(*) AS "rows" FROM n WHERE domain IS NULL OR domain NOT IN ('cic', 'lab', 'live') GROUP BY 1
UNION ALL SELECT 'live', 'empty', 0""")(
    lambda scores: ev.domain_partition_problems(scores.withColumn(
        "domain", F.when(F.col("h") % 41 == 0, None).when(F.col("h") % 43 == 0, "other").otherwise(F.col("domain"))),
        ["cic", "lab", "live"]))

query("model_selection", "scores", sql="""
WITH u AS (SELECT domain, truth <> 'Benign' AS t, p_attack >= 0.3 AS low, p_attack >= 0.6 AS high FROM scores),
s AS (SELECT domain, unnest(['low', 'high']) AS model,
             unnest([2.0 * count(*) FILTER (t AND low) / (count(*) FILTER (t) + count(*) FILTER (low)),
                     2.0 * count(*) FILTER (t AND high) / (count(*) FILTER (t) + count(*) FILTER (high))]) AS f FROM u GROUP BY domain),
w AS (SELECT model, min(f) AS score FROM s GROUP BY model)
SELECT model, round(score, 6) AS score FROM w ORDER BY score DESC LIMIT 1""")(
    lambda scores: _model_selection(scores))


def _model_selection(scores: DataFrame) -> DataFrame:
    """Two candidate cut-offs play the models: own domain 'lab', other domain 'cic'."""
    attack = F.col("truth") != "Benign"
    parts = []
    for name, cut in (("low", 0.3), ("high", 0.6)):
        parts.append(ev.binary_metrics(scores, attack, F.col("p_attack") >= cut, ["domain"]).select(
            F.lit(name).alias("model"), "domain", "attack_f1"))
    wide = parts[0].unionByName(parts[1]).groupBy("model").agg(
        F.max(F.when(F.col("domain") == "lab", F.col("attack_f1"))).alias("own"),
        F.max(F.when(F.col("domain") == "cic", F.col("attack_f1"))).alias("cic"))
    return rounded(ev.select_model(wide, "model", "own", "cic"), "score")


query("mean_confidence", "scores", sql=f"""
WITH {_scored(0.3)} SELECT count(*) AS "rows", round(avg(confidence), 6) AS mean_confidence FROM d""")(
    lambda scores: rounded(ev.throughput(scored(scores), "confidence"), "mean_confidence"))

query("connection_rollup", "scores", sql=f"""
WITH {_scored(0.3)}
SELECT connection_id, count(*) AS snapshots, max(CASE WHEN model_class <> 'Benign' THEN 1 ELSE 0 END) AS any_alert,
       arg_min(model_class, (snapshot_no, flow_id, h)) AS early, arg_max(model_class, (snapshot_no, flow_id, h)) AS mature
FROM d GROUP BY connection_id""")(
    lambda scores: ev.connection_rollup(
        scored(scores, 0.3).withColumn("at", F.struct("snapshot_no", "flow_id", "h")),
        ["connection_id"], "at", F.col("model_class") != "Benign", "model_class"))

query("label_collisions", "flows", sql="""
SELECT f_qty, f_disc, count(*) AS "rows", min(class_label) AS first_label, max(class_label) AS last_label
FROM flows GROUP BY 1, 2 HAVING count(DISTINCT class_label) > 1""")(
    lambda flows: ev.label_collisions(flows, ["f_qty", "f_disc"], "class_label"))
