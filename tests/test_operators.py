"""Operators other than flows: worked examples, brute force and error cases."""

import json
import random
import re
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netloom.functions import constants as K
from netloom.operators import (audit, campaigns as camp, evaluate as ev, learn, prepare as prep, profile as prof,
                               scoring as sc, telemetry as tel)
from netloom.operators.running import Running, running
from netloom.sources import alertlog, documents as docs, pcap


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.select(*names).collect())


# ---- running aggregates ------------------------------------------------------------

def test_sliced_running_equals_one_window(spark):
    rng = random.Random(1)
    data = [(k, i, rng.choice([None, rng.randrange(-9, 9)])) for k in "ab" for i in range(120)]
    df = spark.createDataFrame(data, "k string, i long, v long").withColumn("part", F.floor(F.col("i") / 7))
    specs = {f"{kind}_{inc}": Running(kind, F.col("v"), inc) for kind in ("last", "sum", "max", "min") for inc in (True, False)}
    specs["all"] = Running("sum", F.col("v"), whole=True)
    one = rows(running(df, ["k"], "i", specs), "k", "i", *specs)
    cut = rows(running(df, ["k"], "i", specs, "part"), "k", "i", *specs)
    assert one == cut and len(one) == 240


# ---- preparation ---------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["smooth", "lumpy", "constant", "tiny"])
def test_exact_percentiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(4)
    values = {"smooth": rng.normal(size=3000) * 1e3, "lumpy": rng.integers(0, 4, 3000) * 1.0,
              "constant": np.full(50, 2.5), "tiny": np.array([3.0, 1.0])}[kind]
    df = spark.createDataFrame([(float(v), float(-v)) for v in values], "x double, y double")
    got = {(r["column"], r["percent"]): r["bound"]
           for r in prep.exact_percentiles(df, ["x", "y"], (0.5, 50.0, 99.5), accuracy=100).collect()}
    for name, data in (("x", values), ("y", -values)):
        for p in (0.5, 50.0, 99.5):
            assert got[name, p] == pytest.approx(np.percentile(data, p), rel=1e-12), (name, p)


def test_split_sizes_and_skew(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "big").otherwise("small").alias("c"))
    sizes = {(r["c"], r["split"]): r["count"] for r in
             prep.stratified_split(df, "c", ["id"], 70, 15).groupBy("c", "split").count().collect()}
    assert sizes == {("big", "train"): 630, ("big", "validation"): 135, ("big", "test"): 135,
                     ("small", "train"): 70, ("small", "validation"): 15, ("small", "test"): 15}
    again = prep.stratified_split(df.repartition(7), "c", ["id"], 70, 15)
    assert rows(again, "id", "split") == rows(prep.stratified_split(df, "c", ["id"], 70, 15), "id", "split")


def test_balanced_sample_quota(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "big").otherwise("small").alias("c"))
    out = prep.balanced_sample(df, "c", ["id"], 300, keep=100, floor=150)
    assert {r["c"]: r["count"] for r in out.groupBy("c").count().collect()} == {"big": 270, "small": 100}
    assert prep.balanced_sample(df, "c", ["id"], 5000).count() == 1000


def test_labels_and_classes(spark):
    df = spark.createDataFrame([(c,) for c in K.SOURCE_CLASSES], "ClassLabel string")
    remapped = prep.remap_classes(df, "ClassLabel")
    assert sorted({r["ClassLabel"] for r in remapped.collect()}) == sorted(K.OUTPUT_CLASSES)
    assert remapped.agg(F.sum("remapped")).first()[0] == 2
    assert all(r["target"] == (r["ClassLabel"] != "Benign") for r in prep.binary_target(df, "ClassLabel").collect())
    odd = df.unionByName(spark.createDataFrame([("Unseen",)], "ClassLabel string"))
    with pytest.raises(ValueError, match="Unseen"):
        prep.check_classes(odd, "ClassLabel", K.SOURCE_CLASSES)
    assert prep.check_classes(odd, "ClassLabel", K.SOURCE_CLASSES, strict=False) == ["unexpected class: Unseen"]
    stripped = prep.strip_label(spark.createDataFrame([("\t Dos \n",)], "l string"), "l").first()[0]
    assert stripped == "Dos"
    assert [tuple(r) for r in prep.encode_labels(odd, "ClassLabel").orderBy("index").collect()][:2] == [(0, "Benign"), (1, "Botnet")]


def test_contract_and_schema_errors(spark):
    df = spark.createDataFrame([(1, "2.5", 1.0), (2, "x", float("nan"))], "id long, a string, b double")
    assert rows(prep.contract_violations(df, ["id"], ["a", "b", "c"]), "id", "feature", "problem") == [
        (1, "c", "missing"), (2, "a", "non-numeric"), (2, "b", "non-finite"), (2, "c", "missing")]
    with pytest.raises(ValueError, match="missing columns: Label"):
        prep.require_columns(df, ["Label"])
    with pytest.raises(Exception, match="model feature: a"):
        prep.enforce_contract(df, ["a"]).collect()
    assert prep.enforce_contract(df.filter("id = 1"), ["a", "b"]).first()["a"] == 2.5
    with pytest.raises(ValueError, match="duplicates"):
        prep.assemble(df, ["b", "b"])
    assert prep.drop_columns(df.withColumn("Label", F.lit(1)).withColumn("Flow Duration", F.lit(1))).columns == ["id", "a", "b"]


def test_correlation_rule_counts_dropped_columns(spark):
    """c follows b which itself goes; constants never drop; both code paths agree."""
    data = [(float(i), 2.0 * i + (i % 2) * 0.1, 3.0 * i, 1.0, float(i * 7 % 5)) for i in range(60)]
    names = ["a", "b", "c", "k", "z"]
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in names))
    kept_df, kept = prep.prune_correlated(df, names)
    assert kept == ["a", "k", "z"] and kept_df.columns == kept
    wide = df.select("*", *[(F.rand(n) * 10).alias(f"r{n}") for n in range(9)])
    columns = names + [f"r{n}" for n in range(9)]
    pairs = {(r["left"], r["right"]): r["r"] for r in prep.correlation_pairs(wide, columns).collect()}
    for r in prep.correlation_pairs(df, names).collect():
        other = pairs[r["left"], r["right"]]
        assert (other is None) == (r["r"] is None) and (other is None or other == pytest.approx(r["r"]))


def test_class_weights_and_scaling(spark):
    df = spark.createDataFrame([("a",)] * 98 + [("b",)] * 2, "c string")
    weights = {r["c"]: r["weight"] for r in prep.class_weights(df, "c").collect()}
    assert weights == pytest.approx({"a": (100 / 196) ** 0.5, "b": 5.0})
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    stats = prep.as_dict(prep.scale_statistics(train, ["x", "k"]), "mean", "std")
    assert stats == {"x": (2.0, 1.0), "k": (5.0, 1.0)}
    assert rows(prep.apply_scale(prep.apply_clip(train, {"x": (0.0, 2.0)}), stats), "x", "k") == [(-1.0, 0.0), (0.0, 0.0)]


# ---- policies and metrics -----------------------------------------------------------------

def _probabilities(spark, items, **extra):
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(items)], "id long, p array<double>")
    return df


def test_unknown_is_an_alert(spark):
    df = sc.argmax_with_unknown(_probabilities(spark, [(.6, .4), (.99, .01), (.4, .6), (.01, .99)]), "p", ["Benign", "DoS"], 0.8)
    got = rows(df.withColumn("alert", sc.attack_mask("predicted_class", "confidence", 0.8)), "id", "alert", "model_class")
    assert got == [(0, True, "Unknown"), (1, False, "Benign"), (2, True, "Unknown"), (3, True, "DoS")]


def test_gate_and_fusion_edges(spark):
    df = _probabilities(spark, [(.9, .1), (.5, .5), (.1, .9)]).withColumn("q", F.element_at(F.array(F.lit(0.05), F.lit(0.1), F.lit(0.7)), (F.col("id") + 1).cast("int")))
    got = rows(sc.verdicts(df, "q", "p", ["Benign", "Bruteforce"]), "id", "verdict", "attack_type", "final_confidence", "stage_reached")
    assert got == [(0, "BENIGN", "Normal Traffic", 0.95, "Stage 1 (ML)"), (1, "MALICIOUS", "Unknown Attack", 0.1, "Stage 2 (DL)"),
                   (2, "MALICIOUS", "Brute Force", 0.9, "Stage 2 (DL)")]
    stopped, on = sc.gate(df, "q", 0.0)
    assert stopped.count() == 0 and on.count() == 3
    assert sc.gate(df, "q", 1.0)[1].count() == 0


def test_threshold_tie_takes_lowest_and_weak_domain_counts(spark):
    data = [("cic", "DoS", "DoS", 0.95), ("cic", "Benign", "Benign", 0.95), ("live", "DoS", "DoS", 0.95), ("live", "Benign", "Benign", 0.32)]
    df = spark.createDataFrame(data, "domain string, truth string, predicted string, confidence double")
    best = ev.tune_threshold(df, "truth", "predicted", "confidence", [0.30, 0.35, 0.4]).first()
    assert (best["threshold"], best["validation_score"]) == (0.30, 1.0)
    assert ev.tune_threshold(df, "truth", "predicted", "confidence", [0.35, 0.4]).first()["threshold"] == 0.35
    with pytest.raises(ValueError):
        ev.tune_threshold(df, "truth", "predicted", "confidence", [])
    flipped = df.withColumn("predicted", F.when(F.col("domain") == "live", F.when(F.col("truth") == "DoS", "Benign").otherwise("DoS")).otherwise(F.col("predicted")))
    assert rows(ev.domain_macro_f1(flipped, "truth", "predicted"), "domain", "macro_f1") == [("cic", 1.0), ("live", 0.0)]
    assert rows(ev.domain_partition_problems(df, ["cic", "live", "lab"]), "domain", "problem") == [("lab", "empty")]


def test_report_matches_hand_count(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")]
    df = spark.createDataFrame(pairs, "truth string, predicted string")
    report = {r["class"]: r for r in ev.class_report(df, "truth", "predicted").collect()}
    assert report["a"]["precision"] == 0.75 and report["a"]["recall"] == 0.75
    assert report["b"]["precision"] == pytest.approx(2 / 3) and report["b"]["recall"] == 1.0
    assert (report["c"]["precision"], report["c"]["recall"], report["c"]["f1"]) == (0.0, 0.0, 0.0)
    total = ev.summary_report(df, "truth", "predicted").first()
    assert total["accuracy"] == pytest.approx(5 / 7) and total["macro_f1"] == pytest.approx((0.75 + 0.8 + 0) / 3)
    cells = {(r["truth"], r["predicted"]): r["rows"] for r in ev.confusion_matrix(df, "truth", "predicted", ["a", "b", "c"]).collect()}
    assert cells["a", "b"] == 1 and cells["b", "c"] == 0 and len(cells) == 9


# ---- telemetry ------------------------------------------------------------------------------

def test_dashboard_examples(spark):
    log = spark.createDataFrame(
        [(1, "Normal Traffic", 1), (2, "Normal", 2), (3, "Normal Traffic", 2), (4, "DoS", 3)], "id long, attack_type string, latency_ms long")
    assert rows(tel.window_mix(log, 2), "attack_type", "rows") == [("DoS", 1), ("Normal Traffic", 1)]
    assert tuple(tel.totals(log).first()) == (4, 1)
    # 2.5 rounds half-even to 2; the window holds one attack.
    assert tuple(tel.window_kpis(log, 2).first()) == (2, 1, 2)
    saved = log.withColumns({"confidence": F.lit(0.1), "model_attack_type": F.when(F.col("id") == 4, "Port Scan"),
                             "model_confidence": F.when(F.col("id") == 4, 0.93)})
    last = tel.latest_alert(saved).first()
    assert (last["attack_type"], last["confidence"]) == ("Port Scan", 0.93)
    assert tuple(tel.totals(log.limit(0)).first()) == (0, 0)
    empty = tel.session_summary(log.limit(0)).first()
    assert empty["latency_status"] == "NOT MEASURED" and empty["p95_latency"] == 0
    for bad in (0, 2501):
        with pytest.raises(ValueError):
            tel.latest(log, bad)
    missing = log.withColumn("attack_type", F.lit(None).cast("string"))
    assert tel.totals(missing).first()["total_attacks"] == 4


def test_order_statistic_is_the_indexed_value(spark):
    rng = random.Random(2)
    for n in (1, 19, 20, 333):
        data = [round(rng.expovariate(0.02), 2) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in data], "v double")
        assert tel.order_statistic(df, "v", 0.95).first()[0] == sorted(data)[int(n * 0.95)]


def test_log_schema_and_json(spark, tmp_path):
    old = spark.createDataFrame([("t", "a", "b", "TCP", "DoS", 5)], "timestamp string, source_ip string, destination_ip string, protocol string, attack_type string, latency_ms long")
    evolved = alertlog.evolve(old)
    assert set(alertlog.LOG_COLUMNS) == set(evolved.columns) and evolved.first()["verdict"] is None
    df = spark.createDataFrame([(1.0, float("nan"))], "a double, b double")
    assert df.select(alertlog.features_json(["a"])).first()[0] == '{"a":1.0}'
    assert df.select(alertlog.features_json(["a"], False)).first()[0] is None
    with pytest.raises(Exception, match="not a JSON number: b"):
        df.select(alertlog.features_json(["a", "b"])).collect()
    for _ in range(2):   # a repeated batch replaces itself
        alertlog.append(evolved, str(tmp_path / "log"), 3)
    assert alertlog.read(spark, str(tmp_path / "log")).count() == 1


# ---- documents, campaigns, audits --------------------------------------------------------------

def test_metric_reports(spark, tmp_path):
    for name, text in {"good": '{"macro_f1": 0.83}', "high": '{"macro_f1": 1.2}', "none": "{}", "bad": "not json",
                       "text": '{"macro_f1": "x"}'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = docs.read_metric(spark, str(tmp_path)).collect()
    assert [r["macro_f1"] for r in got] == [0.83] and got[0]["path"].endswith("good.json")


PROFILE = {"class_label": "Portscan", "reference_label": None, "scenario_label": "lab-scan", "max_seconds": 20,
           "max_actions": 12, "max_outbound_bytes": 2048, "parameters": {"ports": [21, 80]}}


def _profile_rules(spark, tmp_path, profiles, version=1):
    path = tmp_path / f"{random.random()}.json"
    path.write_text(json.dumps({"schema_version": version, "profiles": profiles}, indent=1))
    return rows(camp.profile_violations(docs.read_profiles(spark, str(path))), "mode", "rule")


def test_profile_rules(spark, tmp_path):
    def change(**parts):
        return {**PROFILE, **parts}

    udp = change(class_label="DDoS", max_outbound_bytes=20000, parameters={"flows": 10, "packets_per_flow": 1, "payload_bytes": 389})
    good = {"scan": PROFILE, "ddos_udp": udp,
            "dos_slow": change(parameters={"connections": 4, "duration_seconds": 20, "fragment_interval_seconds": 0.6}),
            "ssh_bruteforce": change(parameters={"count": 5, "username": "root", "interval_seconds": 0}),
            "botnet": change(parameters={"count": 8, "delay_ms": 500, "response_bytes": 256})}
    assert _profile_rules(spark, tmp_path, good) == []
    bad = {"Scan": PROFILE, "a": change(class_label="Worm"), "b": change(scenario_label="x"), "c": change(max_actions=121),
           "d": change(max_seconds=2.5), "e": change(parameters={"count": 13}), "f": change(parameters={"count": "3"}),
           "g": change(parameters={"interval_seconds": 21}), "scan_a": change(parameters={"ports": [0]}),
           "scan_b": change(parameters={}), "scan_c": change(parameters={"ports": [1], "technique": "udp", "timing_template": 5}),
           "ssh_bruteforce_x": change(parameters={"count": 11, "username": "Root"}),
           "ddos_udp": {**udp, "parameters": {"flows": 10, "packets_per_flow": 2, "payload_bytes": 1}},
           "botnet_x": change(parameters={"delay_ms": 501, "response_bytes": 257})}
    assert _profile_rules(spark, tmp_path, bad) == [
        ("Scan", "mode syntax"), ("a", "class label"), ("b", "scenario label"), ("botnet_x", "botnet delay"),
        ("botnet_x", "botnet response"), ("c", "max_actions"), ("d", "max_seconds"), ("ddos_udp", "udp packets"),
        ("e", "count"), ("f", "count"), ("g", "interval_seconds"), ("scan_a", "scan ports"), ("scan_b", "scan ports"),
        ("scan_c", "scan technique"), ("scan_c", "scan timing"), ("ssh_bruteforce_x", "ssh count"), ("ssh_bruteforce_x", "ssh username")]
    with pytest.raises(Exception, match="unsupported campaign profile schema"):
        _profile_rules(spark, tmp_path, good, 2)


def test_campaign_status(spark):
    data = [("ok", 1, True), ("ok", 2, True), ("part", 1, True), ("part", 2, False), ("none", 1, False)]
    data += [("many", i, i == 0) for i in range(15)]
    df = spark.createDataFrame([(c, n, f"a{n}", s, 10) for c, n, s in data], "c string, n long, action string, success boolean, response_bytes long")
    got = {r["c"]: r for r in camp.rollup(df, ["c"], "n").collect()}
    assert {c: r["status"] for c, r in got.items()} == {"ok": "completed", "part": "partial", "none": "failed", "many": "partial"}
    assert got["many"]["errors"] == [f"a{n}: " for n in range(1, 11)] and got["ok"]["errors"] == []
    fatal = camp.rollup(df, ["c"], "n", fatal=F.col("c") == "ok")
    assert {r["c"]: r["status"] for r in fatal.collect()}["ok"] == "failed"
    bad = camp.id_violations(spark.createDataFrame([("a b", "w"), ("ok-1", "x" * 65), ("a\n", "w")], "campaign_id string, worker_id string"))
    assert [r["bad_id"] for r in bad.collect()] == ["campaign_id", "worker_id", "campaign_id"]


def test_split_plan_audit_of_a_clean_and_a_broken_plan(spark, tmp_path):
    features = [f"f{n}" for n in range(57)]
    import hashlib
    digest = hashlib.sha256(json.dumps(features).encode()).hexdigest()
    split = lambda ids: {"parquet": "x", "parquet_sha256": "d", "usable_rows": 6, "campaign_ids": ids, "connection_ids": ids}
    plan = {"schema_version": 1, "features": features, "feature_schema_sha256": digest,
            "splits": {"train": split(["t"]), "validation": split(["v"])}}
    data = spark.createDataFrame([(c, "v", "v") for c in K.LAB_CLASSES], "ClassLabel string, campaign_id string, connection_id string")
    data = data.withColumns({f: F.lit(1.0) for f in features})
    digests = spark.createDataFrame([("x", "d")], "path string, sha256 string")

    def problems(doc):
        path = tmp_path / f"{random.random()}.json"
        path.write_text(json.dumps(doc, indent=1))
        df = docs.read_split_plan(spark, str(path))
        both = audit.audit_plan(df).unionByName(audit.audit_split(df, "validation", data, digests, features))
        return sorted(r["check_name"] for r in both.collect())

    assert problems(plan) == []
    plan["schema_version"], plan["splits"]["train"]["campaign_ids"] = 2, ["v"]
    plan["splits"]["validation"]["usable_rows"], plan["splits"]["validation"]["parquet_sha256"] = 7, "e"
    plan["splits"]["validation"]["connection_ids"] = ["w"]
    assert problems(plan) == ["connection_ids", "connection_ids", "parquet hash", "row count", "schema_version", "shared campaigns"]
    assert audit.schema_problems(K.OUTPUT_CLASSES, features) == [] and audit.schema_problems(["a"], features[:3]) == ["class set", "feature list"]


def test_multiset_and_sets(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x long")
    b = spark.createDataFrame([(1,), (2,), (3,)], "x long")
    assert rows(audit.multiset_differences(a, b, ["x"]), "x", "surplus") == [(1, 1), (3, -1)]
    assert audit.multiset_differences(a, a, ["x"]).count() == 0
    assert rows(audit.set_differences(a, b, "x"), "x", "problem") == [(3, "absent")]


# ---- captures ------------------------------------------------------------------------------------

def _ip(protocol, body, version=4, fragment=0):
    head = struct.pack(">BBHHHBBH4s4s", version << 4 | 5, 0, 20 + len(body), 0, fragment, 64, protocol, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2]))
    return head + body


def test_capture_files(spark, tmp_path):
    tcp = struct.pack(">HHIIBBHHH", 1234, 80, 0, 0, 8 << 4, 0x18, 512, 0, 0) + bytes(12) + b"hello"
    udp = struct.pack(">HHHH", 53, 5353, 12, 0) + b"abcd"
    ether, vlan = bytes(12) + b"\x08\x00", bytes(12) + b"\x81\x00\x00\x01\x08\x00"
    frames = [ether + _ip(6, tcp) + b"pad", vlan + _ip(17, udp), ether + _ip(1, bytes(8)), bytes(12) + b"\x86\xdd" + bytes(40), ether + _ip(6, tcp, fragment=5)]
    for name, magic, order, scale in (("a", b"\xd4\xc3\xb2\xa1", "<", 1), ("b", b"\xa1\xb2\x3c\x4d", ">", 1000)):
        out = magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, 1)
        for n, frame in enumerate(frames):
            out += struct.pack(order + "IIII", 100, n * 7 * scale, len(frame), len(frame)) + frame
        (tmp_path / f"{name}.pcap").write_bytes(out)
    got = [r.asDict() for r in pcap.read_packets(spark, str(tmp_path)).orderBy("seq").collect()]
    assert len(got) == 8 and [g["ts_us"] for g in got] == [100_000_000 + n * 7 for n in (0, 1, 2, 4)] * 2
    first, second, third, fourth = got[:4]
    assert (first["protocol"], first["src_port"], first["flags"], first["header_len"], first["win_size"], first["pkt_len"]) == ("TCP", 1234, 0x18, 32, 512, 5)
    assert bytes(first["payload"]) == b"hello" and bytes(second["payload"]) == b"abcd"
    assert (second["protocol"], second["header_len"], second["pkt_len"]) == ("UDP", 8, 4)
    assert all((p["protocol"], p["src_port"], p["header_len"], p["pkt_len"]) == ("OTHER", 0, 20, 0) for p in (third, fourth))
    assert got[4]["seq"] > got[3]["seq"]
    with pytest.raises(Exception, match="not a classic capture"):
        (tmp_path / "x").mkdir()
        (tmp_path / "x" / "c.pcap").write_bytes(b"nonsense-bytes-here-more-than-24")
        pcap.read_packets(spark, str(tmp_path / "x")).collect()


# ---- models -------------------------------------------------------------------------------------

def test_train_save_load_and_cascade(spark, tmp_path):
    rng = random.Random(3)
    data = [(i, k, rng.gauss(3.0 * k, 1.0), rng.gauss(-2.0 * k, 1.0)) for i, k in enumerate([0, 1, 2, 3, 4, 5, 6] * 30)]
    df = spark.createDataFrame(data, "id long, k long, x double, y double").withColumns(
        {"target": (F.col("k") > 0).cast("int"), "label_index": F.col("k").cast("double"), "weight": F.lit(1.0)})
    names = ["x", "y"]
    bounds = prep.as_dict(prep.clip_bounds(df, names), "low", "high")
    clipped = prep.apply_clip(df, bounds)
    stats = prep.as_dict(prep.scale_statistics(clipped, names), "mean", "std")
    stage1 = learn.stage1_model(df, names, "target", "forest", "weight", 10, 4)
    stage2 = learn.stage2_model(prep.apply_scale(clipped, stats), names, "label_index", 7, "logistic", iterations=30)
    meta = {"stage1_threshold": 0.1, "classes": K.OUTPUT_CLASSES, "stage1_features": names, "stage2_features": names,
            "clip_bounds": bounds, "scale_statistics": stats}
    learn.save_bundle(spark, str(tmp_path / "b"), stage1, stage2, meta)
    one, two, loaded = learn.load_bundle(spark, str(tmp_path / "b"))
    assert loaded["classes"] == K.OUTPUT_CLASSES
    out = learn.cascade(df, one, two, bounds, stats, 7)
    scored = sc.verdicts(out, "p_attack", "probabilities", unknown_threshold=0.0).collect()
    assert len(scored) == len(data) and {r["x"] for r in scored} == {d[2] for d in data}
    hits = sum((r["verdict"] == "MALICIOUS") == (r["k"] > 0) for r in scored)
    assert hits / len(data) > 0.9
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 for r in scored if r["stage_reached"].startswith("Stage 2"))
    learn.save_bundle(spark, str(tmp_path / "c"), stage1, stage2, {**meta, "stage2_features": ["y", "x"]})
    with pytest.raises(ValueError, match="stage2_features differ"):
        learn.load_bundle(spark, str(tmp_path / "c"))


def test_external_network(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, -1.0)], "a double, b double")
    layers = [(np.eye(2), np.zeros(2)), (np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]), np.zeros(3))]
    got = [r["probabilities"] for r in learn.network_probabilities(df, ["a", "b"], layers).orderBy("a").collect()]
    e = np.exp([1.0, 2.0, 0.0])
    assert got[1] == pytest.approx(list(e / e.sum())) and got[0] == pytest.approx([1 / 3] * 3)


# ---- profiles, registry ----------------------------------------------------------------------------

def test_profile(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("inf")), (None, None)], "Attack string, v double")
    assert rows(prof.column_profile(df), "column", "dtype", "null_count", "unique_count") == [("Attack", "string", 1, 2), ("v", "double", 1, 3)]
    assert prof.label_columns(df) == ["Attack"]
    assert rows(prof.infinity_counts(df), "column", "infinities") == [("v", 1)]
    many = spark.range(150).select((F.col("id") % 120).alias("x"))
    assert prof.top_values(many, "x").count() == 20 and prof.top_values(many.filter("x < 100"), "x").count() == 100


def test_entry_and_registry(spark, tiny):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.limit(1).count() == 1 and "Flow Duration" in df.columns
    text = {q for q in entry.queries() if re.fullmatch(r"op\d+_\w+|pipeline", q)}   # tested beside the text operators
    names, oracles = set(entry.queries()) - text, set(entry.oracle_sql()) - text
    assert oracles <= names and names - oracles == {
        "approximate_profile", "stage1_forest", "stage1_boosted", "stage2_network",
        "stage2_logistic", "cascade_scoring"}


# ---- no caps -----------------------------------------------------------------------

def test_strict_check_sees_every_unexpected_class(spark):
    allowed = [f"allowed {n:03}" for n in range(120)]
    df = spark.createDataFrame([("zz unseen",)], "label string")
    with pytest.raises(ValueError, match="unexpected class: zz unseen"):
        prep.check_classes(df, "label", allowed)
    messages = prep.check_classes(df, "label", allowed, strict=False)
    assert messages[0] == "unexpected class: zz unseen" and messages[-1] == "and 70 more missing classes"


def test_log_accepts_any_batch_number(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("1.1.1.1", "DDoS")], "source_ip string, attack_type string")
    for batch in (0, 2 ** 20, 2 ** 40):
        alertlog.append(rows, path, batch)
    log = alertlog.read(spark, path)
    assert [int(r["batch"]) for r in log.orderBy("id").collect()] == [0, 2 ** 20, 2 ** 40]
    assert log.select("id").distinct().count() == 3 and "confidence" in log.columns


def test_correlation_of_57_columns_equals_pandas(spark):
    rng = np.random.default_rng(7)
    data = pd.DataFrame(rng.normal(1e4, 3, (300, 57)), columns=[f"f{n}" for n in range(57)])
    data["f9"] = data["f3"] * -2 + rng.normal(0, 0.1, 300)
    data["f5"] = 4.0
    data = data.mask(rng.random(data.shape) < 0.05)
    want = data.corr()
    df = spark.createDataFrame(data).repartition(4)
    got = prep.correlation_pairs(df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in df.columns]), list(data.columns)).collect()
    assert len(got) == 57 * 56 // 2
    for r in got:
        value = want.loc[r["left"], r["right"]]
        assert r["r"] is None if value != value else r["r"] == pytest.approx(abs(value), abs=1e-7)


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert rows(prep.exact_percentiles(df, ["x"], (50.0,)), "column", "percent", "bound") == [("x", 50.0, None)]


@pytest.mark.parametrize("link,head", [(113, b"\0" * 14 + b"\x08\0"), (276, b"\x08\0" + b"\0" * 18),
                                       (0, b"\x02\0\0\0"), (101, b"")])
def test_captures_of_other_links(spark, tmp_path, link, head):
    udp = struct.pack(">HHHH", 5, 53, 9, 0) + b"z"
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(udp), 0, 0, 9, 17, 0, b"\x0a\0\0\x01", b"\x0a\0\0\x02") + udp
    frame = head + ip
    file = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link) + struct.pack("<IIII", 1, 2, len(frame), len(frame)) + frame
    (tmp_path / "a.pcap").write_bytes(file)
    assert [r["dst_port"] for r in pcap.read_packets(spark, str(tmp_path)).collect()] == [53]


def test_unknown_link_is_an_error(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 147))
    with pytest.raises(Exception, match="link type 147"):
        pcap.read_packets(spark, str(tmp_path)).collect()


def test_campaign_counts_actions_and_cuts_texts(spark):
    df = spark.createDataFrame([("c", 1, "scan", True, 9, 4, 3, "x"), ("c", 2, "scan", False, 1, 2, 0, "y" * 130)],
                               "c string, n long, action string, success boolean, response_bytes long, reserved_actions long, "
                               "actions_completed long, detail string")
    got = camp.rollup(df, ["c"], "n").first()
    assert (got["attempted"], got["succeeded"], got["status"], got["errors"]) == (6, 3, "partial", ["scan: " + "y" * 120])
    times = spark.createDataFrame([(1704067200.25,), (0.0,)], "t double").select(camp.utc_text(F.col("t")).alias("u"), "t")
    assert [(r["u"], r["e"]) for r in times.select("u", camp.epoch_of(F.col("u")).alias("e")).collect()] == [
        ("2024-01-01T00:00:00.250Z", 1704067200.25), ("1970-01-01T00:00:00.000Z", 0.0)]
    assert spark.range(1).select(camp.note_text(F.lit("z" * 300)).alias("n")).first()["n"] == "z" * 200
