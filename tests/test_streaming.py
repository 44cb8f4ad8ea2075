"""Batch and stream must give the same snapshots; the sink must isolate errors."""

import pytest
from pyspark.sql import functions as F

from netloom.operators.features import FLOW, snapshots
from netloom.operators.flows import FlowConfig
from netloom.sources import alertlog, pcap
from netloom.streaming.flow_state import stream_snapshots
from netloom.streaming.sink import score_and_log
from test_flows import frame, packet, traffic

CONFIG = FlowConfig(inactivity_us=500_000, emit_after_us=60_000, emit_packets=4)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Ordered traffic in four files; a lone late packet moves the watermark past all flows."""
    path = str(tmp_path_factory.mktemp("stream"))
    rows = traffic(5, 900, 6)
    rows.append(packet(900, rows[-1]["ts_us"] + 60_000_000, ("z", 1), ("y", 2), "UDP"))
    rows.append(packet(901, rows[-1]["ts_us"] + 60_000_000, ("z", 1), ("y", 2), "UDP"))
    df = frame(spark, rows)
    for n in range(4):
        df.filter(F.col("seq").between(n * 226, n * 226 + 225)).coalesce(1).write.mode("append").parquet(path)
    return path, df


def test_stream_equals_batch(spark, files, tmp_path):
    path, df = files
    packets = pcap.read_stream(spark, path, df.schema, 1)
    out = stream_snapshots(packets, CONFIG, "1 second")
    query = out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    names = [c for c in out.columns if c != "step"]
    streamed = {(r["flow_seq"], r["last_seq"]): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r["flow_seq"], r["last_seq"]): r for r in snapshots(df, CONFIG).collect() if r["source_ip"] != "z"}
    streamed = {k: r for k, r in streamed.items() if r["source_ip"] != "z"}
    assert len(batch) > 300 and set(streamed) == set(batch)
    for key, row in batch.items():
        for name in names:
            want, got = row[name], streamed[key][name]
            assert got == (pytest.approx(want, rel=1e-12) if isinstance(want, float) else want), (key, name)


def test_stream_scoring_logs_and_isolates_errors(spark, files, tmp_path):
    path, df = files
    packets = pcap.read_stream(spark, path, df.schema, 2)
    out = stream_snapshots(packets, CONFIG, "1 second")
    # One feature of every flow from one source is broken on purpose.
    broken = out.withColumn("Flow IAT Mean", F.when(
        F.col("source_ip") == "10.0.0.2", float("nan")).otherwise(F.col("Flow IAT Mean")))

    def scorer(rows):
        even = F.col("flow_seq") % 2 == 0
        one_hot = [F.when(~even, 0.9 if n == 3 else 0.0).otherwise(0.1) for n in range(7)]
        return rows.withColumns({"p_attack": F.when(even, 0.05).otherwise(0.8), "probabilities": F.array(*one_hot)})

    query = score_and_log(broken, scorer, str(tmp_path / "log"), str(tmp_path / "bad"), str(tmp_path / "cp"),
                          log_features=True, availableNow=True)
    assert query.awaitTermination(240)
    log = alertlog.read(spark, str(tmp_path / "log"))
    bad = spark.read.parquet(str(tmp_path / "bad"))
    total = snapshots(df, CONFIG)
    expected_bad = total.filter("source_ip = '10.0.0.2'").count()
    assert expected_bad and bad.select(*FLOW, "last_seq").distinct().count() == expected_bad
    rows = log.filter("source_ip <> 'z'").collect()
    assert len(rows) == total.filter("source_ip not in ('10.0.0.2', 'z')").count()
    assert {r["attack_type"] for r in rows} == {"Normal Traffic", "DDoS"}
    assert all(r["stage1_features_json"].startswith('{"Total Fwd Packets":') for r in rows)
    assert log.select("id").distinct().count() == log.count()


def test_live_stream_needs_inactivity(spark, files):
    path, df = files
    with pytest.raises(ValueError):
        stream_snapshots(pcap.read_stream(spark, path, df.schema, 1), FlowConfig())
