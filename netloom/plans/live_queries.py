"""Streaming and model queries; models have no SQL text, only a row check."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from netloom.functions import constants as K
from netloom.operators import continued, evaluate as ev, features as feat, learn, prepare as prep
from netloom.operators.flows import LIVE, SMALL
from netloom.plans.dataset_queries import CLEAN
from netloom.plans.flow_queries import fold_sql
from netloom.plans.registry import query, r6, rounded, scratch
from netloom.plans.score_queries import _plain, _scored, scored
from netloom.sources import alertlog, documents as docs, pcap
from netloom.streaming.flow_state import gap_sessions, stream_snapshots
from netloom.streaming.sink import Progress, counted, running_counters, score_and_log

EPOCH_US = 1_704_067_200_000_000   # 2024-01-01, where the packet clock starts
FILES = 8


def _as_stream(packets: DataFrame, late=None) -> DataFrame:
    """Three time ranges written one after the other, one trigger each; ``late`` packets go with the last."""
    path = f"{scratch(packets.sparkSession)}/packets"
    ends = packets.agg(F.min("ts_us").alias("low"), F.max("ts_us").alias("high")).first()
    third = F.least(F.floor((F.col("ts_us") - ends["low"]) * 3 / (ends["high"] - ends["low"] + 1)), F.lit(2))
    third = third if late is None else F.when(late, 2).otherwise(third)
    for n in range(3):
        packets.filter(third == n).repartition(FILES).write.mode("append").parquet(path)
    return pcap.read_stream(packets.sparkSession, path, packets.schema, FILES)


def _drain(stream: DataFrame) -> DataFrame:
    """Run a stream over what is there and return what it wrote."""
    path = scratch(stream.sparkSession)
    query_ = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option(
        "checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query_.awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/out")


_stream_sql = f"""{fold_sql(LIVE)},
emitted AS (SELECT flow_seq, seq AS last_seq, reason FROM st WHERE reason IS NOT NULL
  UNION ALL SELECT lost_flow, lost_seq, 'ended' FROM st WHERE lost_flow IS NOT NULL
  UNION ALL SELECT flow_seq, acc_seq, 'ended' FROM st
            WHERE open AND pending > 0 AND rn = (SELECT max(rn) FROM p WHERE p.k = st.k)
              AND (seen + {LIVE.inactivity_us}) // 1000 + 1 < (SELECT max(ts_us) // 1000 FROM p) - 2000)
SELECT flow_seq, last_seq, reason FROM emitted"""

query("stream_flow_snapshots", "packets", sql=_stream_sql)(
    lambda packets: _drain(stream_snapshots(_as_stream(packets), LIVE, "2 seconds", EPOCH_US)).select(
        "flow_seq", "last_seq", "reason"))

# The sink end to end. Some early packets arrive with the last files: they are late, dropped and counted.
_LATE = "(seq % 97 = 5 AND ts_us < (SELECT min(ts_us) + (max(ts_us) - min(ts_us)) // 4 FROM packets))"
_SINK_SQL = _stream_sql.replace("FROM packets)", f"FROM (SELECT * FROM packets WHERE NOT {_LATE}) packets)")

query("live_sink_counters", "packets", sql=f"""{_SINK_SQL.rsplit("SELECT", 1)[0]}
SELECT (SELECT count(*) FROM packets) AS packets_sniffed, (SELECT count(*) FROM packets WHERE {_LATE}) AS packets_dropped,
       count(*) FILTER (flow_seq % 11 <> 0) AS flows_analyzed, count(*) FILTER (flow_seq % 11 <> 0 AND flow_seq % 2 = 0) AS benign_flows,
       count(*) FILTER (flow_seq % 11 <> 0 AND flow_seq % 2 = 1) AS malicious_flows, count(*) FILTER (flow_seq % 11 = 0) AS classification_errors,
       count(*) FILTER (flow_seq % 11 <> 0) AS logged, count(*) FILTER (flow_seq % 11 = 0) AS in_error_table FROM emitted""")(
    lambda packets: _sink_counters(packets))


def _sink_counters(packets: DataFrame) -> DataFrame:
    """Stream, score, log: counters, log and error table of the same run must agree."""
    spark, path = packets.sparkSession, scratch(packets.sparkSession)
    ends = packets.agg(F.min("ts_us").alias("low"), F.max("ts_us").alias("high")).first()
    early = F.col("ts_us") < ends["low"] + (ends["high"] - ends["low"]) // 4   # behind the first trigger's watermark
    stream = counted(_as_stream(packets, late=(F.col("seq") % 97 == 5) & early))
    rows = stream_snapshots(stream, LIVE, "2 seconds", EPOCH_US).withColumn(
        "Flow IAT Mean", F.when(F.col("flow_seq") % 11 == 0, float("nan")).otherwise(F.col("Flow IAT Mean")))

    def scorer(df: DataFrame) -> DataFrame:
        even = F.col("flow_seq") % 2 == 0
        return df.withColumns({"p_attack": F.when(even, 0.05).otherwise(0.8), "probabilities": F.array(
            *[F.when(~even, 0.9 if n == 3 else 0.0).otherwise(0.1) for n in range(7)])})

    progress = Progress(spark, f"{path}/counters")
    spark.streams.addListener(progress)
    try:
        run = score_and_log(rows, scorer, f"{path}/log", f"{path}/bad", f"{path}/checkpoint", counters=f"{path}/counters", availableNow=True)
        run.awaitTermination()
        progress.finish(run)
    finally:
        spark.streams.removeListener(progress)
    logged = alertlog.read(spark, f"{path}/log").agg(F.count("*").alias("logged"), F.lit(1).alias("one"))
    bad = spark.read.parquet(f"{path}/bad").select("flow_seq", "last_seq").distinct().agg(
        F.count("*").alias("in_error_table"), F.lit(1).alias("one"))
    return running_counters(spark, f"{path}/counters").withColumn("one", F.lit(1)).join(logged, "one").join(bad, "one").drop("one")


_sessions = """
p AS (SELECT *, CASE WHEN src_port = 80 THEN dst_ip ELSE src_ip END AS client FROM packets),
g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w > 1500000 THEN 1 ELSE 0 END AS cut FROM p WINDOW w AS (PARTITION BY client ORDER BY seq)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY client ORDER BY seq) AS session FROM g)"""

query("gap_sessions", "packets", sql=f"""
WITH {_sessions.strip()}
SELECT count(*) AS packets, sum(pkt_len)::BIGINT AS bytes, min(ts_us) AS start_us, max(ts_us) AS end_us FROM s GROUP BY client, session""")(
    lambda packets: gap_sessions(packets, epoch_us=EPOCH_US).select("packets", "bytes", "start_us", "end_us"))

query("stream_gap_sessions", "packets", sql=f"""
WITH {_sessions.strip()}
SELECT count(*) AS packets, sum(pkt_len)::BIGINT AS bytes, min(ts_us) AS start_us, max(ts_us) AS end_us FROM s GROUP BY client, session
HAVING max(ts_us) + 1500000 <= (SELECT max(ts_us) // 1000 FROM p) * 1000 - 2000000""")(
    lambda packets: _drain(gap_sessions(_as_stream(packets), epoch_us=EPOCH_US)).select("packets", "bytes", "start_us", "end_us"))

query("payload_samples", "packets", "events", sql=f"""{fold_sql(SMALL)},
m AS (SELECT st.flow_seq, st.seq, CASE WHEN p.pkt_len > 0 THEN e.props ELSE '' END AS payload
      FROM st JOIN p ON p.k = st.k AND p.rn = st.rn JOIN events e ON e.event_id = st.seq WHERE NOT st.dropped)
SELECT snap.flow_seq, snap.last_seq, substr(string_agg(payload, '' ORDER BY seq), 1, 512) AS payload_sample
FROM snap JOIN m ON m.flow_seq = snap.flow_seq AND m.seq <= snap.last_seq GROUP BY 1, 2""")(
    lambda packets, events: feat.snapshots(packets.join(
        events.select(F.col("event_id").alias("seq"), F.col("props").cast("binary").alias("payload")), "seq").withColumn(
        "payload", F.when(F.col("pkt_len") > 0, F.col("payload"))), SMALL).select("flow_seq", "last_seq", "payload_sample"))


@query("report_sink", "scores", sql=f"""
WITH {_scored(0.3)}, {_plain.strip()} SELECT class, round(f, 6) AS f1, support FROM prf""")
def report_sink(scores: DataFrame) -> DataFrame:
    """The class report written as JSON and read back."""
    path = scratch(scores.sparkSession)
    docs.write_report(ev.class_report(scored(scores, 0.3), "truth", "model_class"), path)
    return rounded(scores.sparkSession.read.schema("class string, f1 double, support bigint").json(path), "f1")


# ---- models ---------------------------------------------------------------------------------

MODEL_FEATURES = ["f_qty", "f_price", "f_disc", "f_tax"]


def _train_rows(flows: DataFrame) -> DataFrame:
    clean = prep.sample_weight(prep.finite_rows(prep.strip_label(flows, "class_label"), CLEAN), 10.0)
    return prep.binary_target(prep.remap_classes(clean, "class_label"), "class_label")


def _stage1(flows: DataFrame, kind: str, trees: int, depth: int) -> DataFrame:
    rows = _train_rows(flows)
    model = learn.stage1_model(rows, MODEL_FEATURES, "target", kind, "weight", trees, depth)
    return rounded(learn.attack_probability(model, rows).select("flow_id", "h", "target", "p_attack"), "p_attack")


query("stage1_forest", "flows")(lambda flows: _stage1(flows, "forest", 10, 5))
query("stage1_boosted", "flows")(lambda flows: _stage1(flows, "boosted", 5, 3))


def _stage2(flows: DataFrame, kind: str):
    rows = _train_rows(flows)
    index = {name: float(n) for n, name in enumerate(K.OUTPUT_CLASSES)}
    pairs = F.create_map(*[F.lit(x) for item in index.items() for x in item])
    rows = rows.withColumn("label_index", F.element_at(pairs, F.col("class_label")))
    bounds = prep.as_dict(prep.clip_bounds(rows, MODEL_FEATURES), "low", "high")
    clipped = prep.apply_clip(rows, bounds)
    stats = prep.as_dict(prep.scale_statistics(clipped, MODEL_FEATURES), "mean", "std")
    scaled = prep.apply_scale(clipped, stats)
    model = learn.stage2_model(scaled, MODEL_FEATURES, "label_index", 7, kind, (8,), 10)
    return rows, scaled, model, bounds, stats


def _stage2_rows(flows: DataFrame, kind: str) -> DataFrame:
    _, scaled, model, _, _ = _stage2(flows, kind)
    return learn.class_probabilities(model, scaled).select("flow_id", "h", "class_label", "probabilities")


# ---- a residual network with small fixed weights, also written out as SQL -----------------------------

def _weights(rows: int, columns: int, salt: int) -> np.ndarray:
    i, j = np.indices((rows, columns))
    return ((i * 7 + j * 3 + salt) % 11 - 5) / 10


def _norm(units: int, salt: int) -> tuple:
    u = np.arange(units)
    return (1 + (u + salt) % 3 / 4, (u * salt % 5 - 2) / 10, (u + salt) % 4 / 8, 0.5 + (u * 2 + salt) % 5 / 4, 1e-3)


def _dense(rows: int, columns: int, salt: int) -> tuple:
    return _weights(rows, columns, salt), _weights(1, columns, salt + 5)[0]


_NETWORK = learn.residual_graph({
    "input_dense": _dense(3, 4, 1), "input_batch_norm": _norm(4, 2),
    "residual_block_1_dense_1": _dense(4, 4, 3), "residual_block_1_batch_norm_1": _norm(4, 4),
    "residual_block_1_dense_2": _dense(4, 4, 5), "residual_block_1_batch_norm_2": _norm(4, 6),
    "residual_block_2_dense_1": _dense(4, 2, 7), "residual_block_2_batch_norm_1": _norm(2, 8),
    "residual_block_2_dense_2": _dense(2, 2, 9), "residual_block_2_batch_norm_2": _norm(2, 10),
    "residual_block_2_projection": (_weights(4, 2, 11),),
    "classification_dense": _dense(2, 3, 12), "attack_class": _dense(3, 3, 13)})
_INPUTS = ["f_qty / 25", "f_price / 50000", "f_disc * 10"]


def _network_sql(graph: list, inputs: list[str]) -> str:
    """A WITH clause per layer; columns are named by layer number and unit."""
    number = {layer.name: n for n, layer in enumerate(graph)}
    width, steps = {}, []
    for n, layer in enumerate(graph):
        given = [number[name] for name in layer.inputs]
        units = range(width[given[0]]) if given else range(len(inputs))
        column = lambda u, g=given: f"l{g[0]}_{u}"
        if layer.kind == "input":
            made = inputs
        elif layer.kind == "dense":
            matrix, bias = layer.weights
            made = [" + ".join([f"{column(u)} * ({matrix[u, v]!r})" for u in units] + [f"({0.0 if bias is None else float(bias[v])!r})"])
                    for v in range(matrix.shape[1])]
        elif layer.kind == "norm":
            gamma, beta, mean, variance, epsilon = layer.weights
            made = [f"({column(u)} - {mean[u]!r}) / sqrt({variance[u]!r} + {epsilon!r}) * {gamma[u]!r} + ({beta[u]!r})" for u in units]
        elif layer.kind == "relu":
            made = [f"greatest({column(u)}, 0)" for u in units]
        elif layer.kind == "add":
            made = [f"l{given[0]}_{u} + l{given[1]}_{u}" for u in units]
        else:
            made = [f"exp({column(u)}) / ({' + '.join(f'exp({column(v)})' for v in units)})" for u in units]
        width[n] = len(made)
        listed = ", ".join(f"{m.replace('np.float64(', '(')} AS l{n}_{u}" for u, m in enumerate(made))
        steps.append(f"s{n} AS (SELECT *, {listed} FROM {f's{n - 1}' if n else 'flows'})")
    last = len(graph) - 1
    out = ", ".join(f"round(l{last}_{u}, 6) AS p{u}" for u in range(width[last]))
    return f"WITH {', '.join(steps)} SELECT flow_id, h, {out} FROM s{last}"


query("residual_scoring", "flows", sql=_network_sql(_NETWORK, _INPUTS))(
    lambda flows: learn.graph_probabilities(
        flows.select("flow_id", "h", *[F.expr(e).alias(f"x{n}") for n, e in enumerate(_INPUTS)]), ["x0", "x1", "x2"], _NETWORK).select(
        "flow_id", "h", *[r6(F.col("probabilities")[u]).alias(f"p{u}") for u in range(3)]))


query("continued_batches", "packets", sql=f"""{fold_sql(SMALL)}
SELECT flow_seq, last_seq, reason FROM snap""")(lambda packets: _continued(packets))


def _continued(packets: DataFrame) -> DataFrame:
    """Three batches, each written and taken up by the next; together the snapshots of one run."""
    path, last = scratch(packets.sparkSession), packets.agg(F.max("seq")).first()[0]
    state, out = continued.no_state(packets), None
    for n in range(3):
        batch = packets.filter(F.floor(F.col("seq") * 3 / (last + 1)) == n)
        continued.batch_rows(batch, state, SMALL).write.parquet(f"{path}/{n}")
        rows = packets.sparkSession.read.parquet(f"{path}/{n}")
        state, part = continued.open_after(rows), continued.snapshots_of(rows)
        out = part if out is None else out.unionByName(part)
    return out.unionByName(continued.flushed(state)).select("flow_seq", "last_seq", "reason")


@query("weighted_training", "flows", sql="SELECT true AS reaches_bound, true AS loss_falls")
def weighted_training(flows: DataFrame) -> DataFrame:
    """A network trained on three classes that the features decide, a rare one among them; judged on held-out groups."""
    rows = prep.finite_rows(flows, CLEAN)
    label = F.when((F.col("f_qty") > 45) & (F.col("f_disc") > 0.05), 2).when(F.col("f_price") > 40_000, 1).otherwise(0)
    parts = prep.group_split(prep.sample_weight(rows, 10.0).withColumn("label", label), "campaign_id")
    train, held = parts.filter("split = 'train'"), parts.filter("split = 'validation'")
    stats = prep.as_dict(prep.scale_statistics(train, MODEL_FEATURES), "mean", "std")
    train, held = (prep.apply_scale(df, stats) for df in (train, held))
    settings = learn.Training(hidden=(32, 16), steps=60, rate=0.05, focal_gamma=2.0)
    layers, history = learn.train_network(train, held, MODEL_FEATURES, "label", 3, "weight", "domain", settings)
    scored_rows = learn.network_probabilities(held, MODEL_FEATURES, layers)
    guess = (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int")
    named = scored_rows.select("domain", F.col("label").cast("string").alias("truth"), guess.cast("string").alias("guess"))
    weakest = ev.domain_macro_f1(named, "truth", "guess").agg(F.min("macro_f1").alias("f"))
    return weakest.select((F.col("f") >= 0.85).alias("reaches_bound"), F.lit(history[-1]["loss"] < history[0]["loss"]).alias("loss_falls"))


query("stage2_network", "flows")(lambda flows: _stage2_rows(flows, "network"))
query("stage2_logistic", "flows")(lambda flows: _stage2_rows(flows, "logistic"))


@query("cascade_scoring", "flows")
def cascade_scoring(flows: DataFrame) -> DataFrame:
    """Both stages end to end: train, gate, score, fuse."""
    from netloom.operators.scoring import verdicts
    rows, _, stage2, bounds, stats = _stage2(flows, "logistic")
    stage1 = learn.stage1_model(rows, MODEL_FEATURES, "target", "forest", "weight", 10, 5)
    scored_rows = learn.cascade(rows.select("flow_id", "h", *MODEL_FEATURES), stage1, stage2, bounds, stats, 7, 0.3)
    return verdicts(scored_rows, "p_attack", "probabilities", gate_threshold=0.3, unknown_threshold=0.3).select(
        "flow_id", "h", "verdict", "attack_type", r6("final_confidence").alias("confidence"), "stage_reached")
