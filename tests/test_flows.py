"""Flow reconstruction and features against the plain fold and worked examples."""

import random

import pytest

from netloom.functions.constants import STAGE1_FEATURES, STAGE2_FEATURES
from netloom.operators.features import CONTEXT_COLUMNS, snapshots
from netloom.operators.flows import FlowConfig, dropped_acks, flow_packets
from plain_flow import fold

SCHEMA = ("seq long, ts_us long, src_ip string, dst_ip string, src_port long, dst_port long, "
          "protocol string, flags long, pkt_len long, header_len long, win_size long, "
          "payload_len long, payload binary")
C, S = ("10.0.0.1", 1234), ("10.0.0.2", 80)


def packet(seq, ts_us, src=C, dst=S, protocol="TCP", flags=0, pkt_len=0, header=20, win=0, payload=b""):
    return dict(seq=seq, ts_us=ts_us, src_ip=src[0], dst_ip=dst[0], src_port=src[1], dst_port=dst[1],
                protocol=protocol, flags=flags, pkt_len=pkt_len, header_len=header, win_size=win,
                payload_len=pkt_len, payload=payload)


def frame(spark, rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def traffic(seed, count, keys, disorder=0, step=60_000):
    """Random packets rich in closes, retransmitted FINs, teardown ACKs and tuple reuse."""
    rng = random.Random(seed)
    rows, now = [], 0
    for seq in range(count):
        now += rng.choice([1_000, 1_000, 9_000, step // 4, step // 4, step, step * 3] + [step * 40] * (seq % 40 == 0))
        k = rng.randrange(keys)
        a, b = ("10.0.0.%d" % k, 1000 + k), ("10.1.0.1", 80)
        if k == 0:
            b = a
        if rng.random() < 0.5:
            a, b = b, a
        udp = k % 5 == 4
        flags = 0 if udp else rng.choice([16, 16, 16, 16, 16, 17, 17, 17, 17, 2, 18, 24, 24, 20, 21, 48])
        size = rng.choice([0, 0, 10, 300]) if flags != 16 else rng.choice([0, 0, 0, 5])
        payload = bytes(rng.randrange(256) for _ in range(min(size, 200)))
        rows.append(packet(seq, now - rng.randrange(disorder + 1), a, b, "UDP" if udp else "TCP", flags,
                           size, rng.choice([0, 20, 32]), rng.randrange(65536), payload))
    return rows


def compare(spark, rows, config):
    df = frame(spark, rows)
    want, dropped = fold(rows, config.inactivity_us, config.emit_after_us, config.emit_packets, config.grace_us)
    got = {(r["flow_seq"], r["last_seq"]): r for r in snapshots(df, config).collect()}
    assert sorted(r["seq"] for r in dropped_acks(df, config).select("seq").collect()) == sorted(dropped)
    assert sorted(got) == sorted((w["flow_seq"], w["last_seq"]) for w in want)
    for w in want:
        row = got[w["flow_seq"], w["last_seq"]]
        for name, value in w.items():
            if isinstance(value, float):
                assert row[name] == pytest.approx(value, rel=1e-9, abs=1e-6), name
            else:
                assert row[name] == value, name
    return want, dropped


CONFIGS = {
    "replay": FlowConfig(),
    "live": FlowConfig(inactivity_us=1_500_000),
    "short": FlowConfig(inactivity_us=500_000, emit_after_us=60_000, emit_packets=4),
    "count": FlowConfig(inactivity_us=6_000_000, emit_after_us=8_000_000, emit_packets=3),
}


@pytest.mark.parametrize("mode", CONFIGS)
def test_matches_plain_fold(spark, mode):
    want, dropped = compare(spark, traffic(7, 1500, 6), CONFIGS[mode])
    assert len(want) > 100 and dropped


@pytest.mark.parametrize("mode", ["replay", "short"])
def test_hot_keys_in_slices_match_plain_fold(spark, mode):
    base = CONFIGS[mode]
    config = FlowConfig(base.inactivity_us, base.emit_after_us, base.emit_packets,
                        hot_rows=60, slice_rows=30)
    compare(spark, traffic(3, 700, 4), config)


def test_one_hot_flow_without_any_break(spark):
    """A single long flow: the packet rule never resynchronises by itself."""
    rows = [packet(i, i * 1_000, *((C, S) if i % 3 else (S, C)), flags=24, pkt_len=i % 90) for i in range(600)]
    config = FlowConfig(emit_packets=7, hot_rows=50, slice_rows=32, slices_per_group=4)
    want, _ = compare(spark, rows, config)
    assert len(want) > 80


def test_disordered_timestamps_in_replay(spark):
    compare(spark, traffic(11, 900, 5, disorder=300_000), FlowConfig())
    compare(spark, traffic(11, 500, 3, disorder=300_000), FlowConfig(hot_rows=50, slice_rows=40))


def test_hidden_gap_behind_dropped_acks(spark):
    """A dropped ACK must not keep a flow alive that was opened in between."""
    us = 1_000_000
    rows = [
        packet(0, 0, flags=17), packet(1, 1_000, S, C, flags=17),       # FIN/FIN, client armed
        packet(2, 100_000, S, C, flags=24, pkt_len=5),                   # server opens a flow
        packet(3, 900_000, flags=16),                                    # dropped ACK
        packet(4, 1_900_000, S, C, flags=17),                            # 1.8 s after packet 2
        packet(5, 2_000_000, flags=17), packet(6, 2_100_000, S, C, flags=16),
        packet(7, 9 * us, flags=24, pkt_len=3),
    ]
    want, dropped = compare(spark, rows, FlowConfig(inactivity_us=1_500_000))
    assert dropped == [3, 6]
    assert {w["flow_seq"] for w in want} == {0, 2, 4, 7}


def test_worked_examples(spark):
    rows = [packet(0, 100_000_000, flags=2 | 8, pkt_len=12, header=40, win=512),
            packet(1, 100_010_000, S, C, flags=32, pkt_len=30, header=28, win=256),
            packet(2, 100_020_000, flags=8, pkt_len=18, win=512)]
    row = snapshots(frame(spark, rows), FlowConfig()).collect()[0]
    expected = {"Packet Length Mean": 18, "Packet Length Variance": 72, "Avg Packet Size": 24,
                "Fwd PSH Flags": 1, "PSH Flag Count": 2, "SYN Flag Count": 1, "URG Flag Count": 1,
                "Init Fwd Win Bytes": 512, "Init Bwd Win Bytes": 256, "Fwd Act Data Packets": 2,
                "Fwd Seg Size Min": 20, "Subflow Fwd Packets": 2, "Subflow Bwd Bytes": 30,
                "Avg Fwd Segment Size": 15, "Avg Bwd Segment Size": 30, "Active Mean": 0}
    assert {k: row[k] for k in expected} == expected
    names = set(row.asDict())
    assert not set(STAGE1_FEATURES) - names and not set(STAGE2_FEATURES) - names
    columns = names - {"lo_ip", "lo_port", "hi_ip", "hi_port", "flow_seq", "last_seq", "reason"}
    assert set(CONTEXT_COLUMNS) <= columns and len(columns) == 78


def test_active_and_idle_example(spark):
    times = [100.0, 101.0, 107.5, 109.0, 116.0, 117.5]
    rows = [packet(i, int(t * 1e6), pkt_len=1) for i, t in enumerate(times)]
    row = [r for r in snapshots(frame(spark, rows), FlowConfig()).collect() if r["last_seq"] == 5][0]
    assert (row["Active Min"], row["Active Max"]) == (1_000_000, 1_500_000)
    assert (row["Idle Min"], row["Idle Max"]) == (6_500_000, 7_000_000)
    assert row["Active Std"] > 0 and row["Idle Std"] > 0


def test_http_exchange(spark):
    rows = [packet(0, 0, flags=2, pkt_len=64, header=32, win=64240),
            packet(1, 2_000, S, C, flags=18, pkt_len=64, header=32, win=65160),
            packet(2, 3_000, flags=16, pkt_len=54, win=64240),
            packet(3, 5_000, flags=24, pkt_len=350),
            packet(4, 10_000, S, C, flags=24, pkt_len=1420),
            packet(5, 15_000, flags=17, pkt_len=54)]
    row = snapshots(frame(spark, rows), FlowConfig(inactivity_us=1_500_000)).collect()
    assert len(row) == 1
    row = row[0]
    assert row["reason"] == "first_fin" and row["Total Fwd Packets"] == 4
    assert row["Total Length of Fwd Packets"] == 522 and row["Bwd Packet Length Max"] == 1420
    assert row["Init_Win_bytes_forward"] == 64240 and row["Init_Win_bytes_backward"] == 0
    assert (row["FIN Flag Count"], row["PSH Flag Count"], row["ACK Flag Count"]) == (1, 2, 5)


def test_udp_and_other_protocols(spark):
    rows = [packet(i, i * 10, protocol="udp", pkt_len=120, header=8) for i in range(10)]
    rows += [packet(10, 200, ("a", 0), ("b", 0), "OTHER", pkt_len=84),
             packet(11, 300, ("b", 0), ("a", 0), "OTHER", pkt_len=84)]
    got = {r["protocol"]: r for r in snapshots(frame(spark, rows), FlowConfig()).collect()}
    assert got["UDP"]["Total Fwd Packets"] == 10 and got["UDP"]["Total Length of Fwd Packets"] == 1200
    assert got["UDP"]["Init Fwd Win Bytes"] == -1 and got["UDP"]["Init Bwd Win Bytes"] == -1
    assert got["OTHER"]["Total Fwd Packets"] == got["OTHER"]["Total Backward Packets"] == 1


def test_time_emission_and_many_keys(spark):
    rows = [packet(0, 0, pkt_len=100), packet(1, 120_000, pkt_len=150)]
    got = snapshots(frame(spark, rows), FlowConfig(emit_after_us=100_000)).collect()
    assert len(got) == 1 and got[0]["reason"] == "time" and got[0]["Total Fwd Packets"] == 2
    many = [packet(i, i, ("10.2.0.%d" % (i % 40), 5), pkt_len=1) for i in range(1000)]
    assert flow_packets(frame(spark, many), FlowConfig()).select("flow_seq").distinct().count() == 40


def gap_chain(depth, seed=0):
    """Each hidden gap resets who has finished, so that the next close, its dropped ACK and the next gap differ."""
    rng = random.Random(seed)
    rows, now, side = [], 0, 0
    ends = [(C, S), (S, C)]
    for _ in range(depth):
        rows.append((now, *ends[side], 17, 0))
        rows.append((now + 1_000, *ends[1 - side], 17, 0))
        rows.append((now + 50_000, *ends[1 - side], 24, 5))
        rows.append((now + 900_000, *ends[side], 16, 0))                 # dropped if the FINs above closed
        now += 1_700_000 + rng.choice([0, 0, 1_000, 600_000])            # a gap only if the ACK was dropped
        if rng.random() < 0.5:
            side = 1 - side
    return [packet(i, ts, a, b, flags=flags, pkt_len=size) for i, (ts, a, b, flags, size) in enumerate(rows)]


@pytest.mark.parametrize("limits", [{}, {"hot_rows": 20, "slice_rows": 10}])
def test_gap_chains_of_any_depth(spark, limits):
    config = FlowConfig(inactivity_us=1_500_000, emit_packets=3, **limits)
    want, dropped = compare(spark, gap_chain(40), config)
    assert len(dropped) > 5 and len(want) > 40


def test_decisions_match_the_plain_fold():
    """The state machine alone, whole and cut in pieces, on many small adversarial keys."""
    from netloom.operators import walk

    rng = random.Random(4)
    for round_ in range(300):
        rows = gap_chain(6, round_) if round_ % 3 == 0 else [
            dict(r, src_ip=a[0], src_port=a[1], dst_ip=b[0], dst_port=b[1], protocol="TCP")
            for r in traffic(round_, 40, 2, step=rng.choice([60_000, 400_000])) for a, b in [(C, S) if rng.random() < 0.5 else (S, C)]]
        inactivity = rng.choice([None, 700_000, 1_500_000])
        if round_ % 3:
            inactivity = None if any(b["ts_us"] < a["ts_us"] for a, b in zip(rows, rows[1:])) else inactivity
        _, dropped = fold(rows, inactivity, 10 ** 12, 10 ** 6)

        def kind(r):
            flags = r["flags"]
            return (walk.RESET if flags & 4 else walk.FINISH if flags & 1 else
                    walk.PURE_ACK if flags & 63 == 16 and not r["pkt_len"] else walk.PLAIN)
        given = [(r["seq"], r["ts_us"], int((r["src_ip"], r["src_port"]) != C), kind(r), False) for r in rows]
        codes, _ = walk.decide(given, walk.Rules(), inactivity, 1_000_000)
        assert [g[0] for g, code in zip(given, codes) if code & walk.DROPPED] == dropped
        rules, again = walk.Rules(), []
        for at in range(0, len(given), 7):
            again += walk.decide(given[at:at + 7], rules, inactivity, 1_000_000)[0]
        assert again == codes
