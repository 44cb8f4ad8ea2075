"""Packet and flow queries, checked by a recursive per-packet SQL fold."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from netloom.operators import features as feat
from netloom.operators.flows import LIVE, REPLAY, SMALL, FlowConfig, dropped_acks, flow_packets
from netloom.operators.packets import decode_flags, is_pure_ack, normalise, with_key
from netloom.plans.registry import query, r6

LOW = "CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) THEN {a} ELSE {b} END"

# Directions, flags and key of every packet, one row number per key.
_P = f"""
p AS (SELECT *, CASE WHEN protocol = 'TCP' THEN flags ELSE 0 END AS fl,
             row_number() OVER (PARTITION BY lo_ip, lo_port, hi_ip, hi_port, protocol ORDER BY seq) AS rn,
             min(seq) OVER (PARTITION BY lo_ip, lo_port, hi_ip, hi_port, protocol) AS k
      FROM (SELECT *, {LOW.format(a=0, b=1)} AS side,
                   {LOW.format(a='src_ip', b='dst_ip')} AS lo_ip, {LOW.format(a='src_port', b='dst_port')} AS lo_port,
                   {LOW.format(a='dst_ip', b='src_ip')} AS hi_ip, {LOW.format(a='dst_port', b='src_port')} AS hi_port
            FROM packets) q)"""


def fold_sql(config: FlowConfig) -> str:
    """``WITH RECURSIVE`` clauses: p (packets), st (state after each), snap (snapshots)."""
    expiry = "false" if config.inactivity_us is None else f"p.ts_us - s.seen > {config.inactivity_us}"
    return f"""WITH RECURSIVE {_P},
st(k, rn, seq, ts_us, side, x_arm, dropped, expired, fresh, flow_seq, fin0, fin1, closed, n, reason,
   emitted, mark, pending, seen, arm0, arm1, open, lost_flow, lost_seq, acc_seq) AS (
  SELECT DISTINCT k, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0, NULL::BIGINT, false, false, false, NULL::BIGINT, false,
         false, false, 0::BIGINT, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT,
         false, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT
  FROM p
  UNION ALL
  SELECT p.k, p.rn, p.seq, p.ts_us, p.side,
         CASE WHEN p.side = 0 THEN s.arm0 ELSE s.arm1 END AS a_arm,
         coalesce(p.protocol = 'TCP' AND (p.fl & 63) = 16 AND p.pkt_len = 0 AND p.ts_us <= a_arm, false) AS a_drop,
         (NOT a_drop AND s.open AND {expiry}) AS a_exp,
         (NOT a_drop AND (NOT s.open OR a_exp)) AS a_new,
         CASE WHEN a_new THEN p.seq ELSE s.flow_seq END AS a_flow,
         CASE WHEN a_drop THEN s.fin0 ELSE (s.fin0 AND NOT a_new) OR ((p.fl & 1) <> 0 AND p.side = 0) END AS a_f0,
         CASE WHEN a_drop THEN s.fin1 ELSE (s.fin1 AND NOT a_new) OR ((p.fl & 1) <> 0 AND p.side = 1) END AS a_f1,
         (NOT a_drop AND ((a_f0 AND a_f1) OR (p.fl & 4) <> 0)) AS a_closed,
         CASE WHEN a_drop THEN s.pending WHEN a_new THEN 1 ELSE s.pending + 1 END AS a_n,
         CASE WHEN a_drop THEN NULL WHEN a_closed THEN 'terminated'
              WHEN (a_f0 OR a_f1) AND (a_new OR s.emitted = 0) THEN 'first_fin'
              WHEN a_n >= {config.emit_packets} THEN 'packets'
              WHEN NOT a_new AND p.ts_us - s.mark >= {config.emit_after_us} THEN 'time' END AS a_reason,
         CASE WHEN a_drop THEN s.emitted
              ELSE CASE WHEN a_new THEN 0 ELSE s.emitted END + CASE WHEN a_reason IS NULL THEN 0 ELSE 1 END END,
         CASE WHEN a_drop THEN s.mark WHEN a_new OR a_reason IS NOT NULL THEN p.ts_us ELSE s.mark END,
         CASE WHEN a_reason IS NOT NULL THEN 0 ELSE a_n END,
         CASE WHEN a_drop THEN s.seen WHEN a_new THEN p.ts_us ELSE greatest(s.seen, p.ts_us) END,
         CASE WHEN a_drop THEN s.arm0 WHEN p.side = 0 THEN NULL
              WHEN a_closed AND (p.fl & 4) = 0 THEN p.ts_us + {config.grace_us} ELSE s.arm0 END,
         CASE WHEN a_drop THEN s.arm1 WHEN p.side = 1 THEN NULL
              WHEN a_closed AND (p.fl & 4) = 0 THEN p.ts_us + {config.grace_us} ELSE s.arm1 END,
         CASE WHEN a_drop THEN s.open ELSE NOT a_closed END,
         CASE WHEN a_exp AND s.pending > 0 THEN s.flow_seq END,
         CASE WHEN a_exp AND s.pending > 0 THEN s.acc_seq END,
         CASE WHEN a_drop THEN s.acc_seq ELSE p.seq END
  FROM st s JOIN p ON p.k = s.k AND p.rn = s.rn + 1),
snap AS (
  SELECT k, flow_seq, seq AS last_seq, reason FROM st WHERE reason IS NOT NULL
  UNION ALL SELECT k, lost_flow, lost_seq, 'ended' FROM st WHERE lost_flow IS NOT NULL
  UNION ALL SELECT k, flow_seq, acc_seq, 'ended' FROM st
            WHERE open AND pending > 0 AND rn = (SELECT max(rn) FROM p WHERE p.k = st.k))"""


_MODES = {"replay": REPLAY, "live": LIVE, "small": SMALL}


# ---- packets ---------------------------------------------------------------------

# Header rows as a capture gives them, derived from the packets (some not IPv4).
def headers(packets: DataFrame) -> DataFrame:
    odd = F.col("seq") % 17 == 0
    tcp = F.col("protocol") == "TCP"
    return packets.select(
        "seq", "ts_us", F.when(F.col("seq") % 23 == 0, 6).otherwise(4).alias("ip_version"),
        F.when(odd, 1).when(tcp, 6).otherwise(17).alias("ip_protocol"), "src_ip", "dst_ip", "src_port", "dst_port",
        F.when(tcp, F.col("flags")).alias("tcp_flags"),
        F.when(tcp & (F.col("seq") % 5 != 0), F.col("header_len") / 4).cast("bigint").alias("tcp_data_offset"),
        F.when(tcp, F.col("win_size")).alias("tcp_window"), F.col("pkt_len").alias("l4_payload_len"))


query("packet_normalisation", "packets", sql="""
WITH h AS (SELECT *, seq % 17 = 0 AS odd, protocol = 'TCP' AS tcp FROM packets WHERE seq % 23 <> 0)
SELECT seq, ts_us, src_ip, dst_ip,
       CASE WHEN odd THEN 0 ELSE src_port END AS src_port, CASE WHEN odd THEN 0 ELSE dst_port END AS dst_port,
       CASE WHEN odd THEN 'OTHER' ELSE protocol END AS protocol,
       CAST(CASE WHEN NOT odd AND tcp THEN flags ELSE 0 END AS BIGINT) AS flags,
       CASE WHEN odd THEN 0 ELSE pkt_len END AS pkt_len,
       CASE WHEN odd THEN 20 WHEN tcp THEN CASE WHEN seq % 5 = 0 THEN 20 ELSE header_len END ELSE 8 END AS header_len,
       CASE WHEN NOT odd AND tcp THEN win_size ELSE 0 END AS win_size,
       CASE WHEN odd THEN 0 ELSE pkt_len END AS payload_len FROM h""")(
    lambda packets: normalise(headers(packets)))

query("tcp_flag_decode", "packets", sql="""
SELECT seq, (flags & 1) <> 0 AS is_fin, (flags & 2) <> 0 AS is_syn, (flags & 4) <> 0 AS is_rst,
       (flags & 8) <> 0 AS is_psh, (flags & 16) <> 0 AS is_ack, (flags & 32) <> 0 AS is_urg FROM packets""")(
    lambda packets: decode_flags(packets).select("seq", "is_fin", "is_syn", "is_rst", "is_psh", "is_ack", "is_urg"))

query("pure_ack", "packets", sql="""
SELECT seq FROM packets WHERE protocol = 'TCP' AND (flags & 63) = 16 AND pkt_len = 0""")(
    lambda packets: with_key(packets).filter(is_pure_ack()).select("seq"))

query("bidirectional_key", "packets", sql=f"""
WITH {_P.strip()}
SELECT lo_ip, lo_port, hi_ip, hi_port, protocol, count(*) AS packets,
       count(*) FILTER (side = 0) AS from_low, count(*) FILTER (side = 1) AS from_high
FROM p GROUP BY ALL""")(
    lambda packets: with_key(packets).groupBy(*feat.KEY).agg(
        F.count("*").alias("packets"), F.count_if(F.col("side") == 0).alias("from_low"),
        F.count_if(F.col("side") == 1).alias("from_high")))


# ---- flow instances, emission -------------------------------------------------------

for _name, _config in _MODES.items():
    query(f"flow_snapshots_{_name}", "packets", sql=f"""{fold_sql(_config)}
SELECT flow_seq, last_seq, reason FROM snap""")(
        lambda packets, c=_config: feat.snapshots(packets, c).select("flow_seq", "last_seq", "reason"))
    query(f"teardown_acks_{_name}", "packets", sql=f"""{fold_sql(_config)}
SELECT seq, ts_us FROM st WHERE dropped""")(
        lambda packets, c=_config: dropped_acks(packets, c).select("seq", "ts_us"))
    query(f"flow_instances_{_name}", "packets", sql=f"""{fold_sql(_config)}
SELECT flow_seq, count(*) AS packets, min(ts_us) AS start_us, max(ts_us) AS end_us,
       bool_or(closed) AS terminated, bool_or(fresh AND expired) AS after_expiry
FROM st WHERE rn > 0 AND NOT dropped GROUP BY flow_seq""")(
        lambda packets, c=_config: flow_instances(packets, c))


query("flow_snapshots_hot", "packets", sql=f"""{fold_sql(LIVE)}
SELECT flow_seq, last_seq, reason FROM snap""")(
    lambda packets: feat.snapshots(packets, replace(LIVE, hot_rows=50, slice_rows=4_000)).select("flow_seq", "last_seq", "reason"))


def flow_instances(packets: DataFrame, config: FlowConfig) -> DataFrame:
    """One row per flow; ``after_expiry``: its key's previous flow was still open and expired."""
    rows = flow_packets(packets, config)
    flows = rows.groupBy(*feat.FLOW).agg(
        F.count("*").alias("packets"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"),
        F.bool_or("closes").alias("terminated"), F.bool_or(F.col("starts") & F.col("after_open")).alias("after_expiry"))
    return flows.select("flow_seq", "packets", "start_us", "end_us", "terminated", "after_expiry")


query("expired_pending_live", "packets", sql=f"""{fold_sql(LIVE)}
SELECT lost_flow AS flow_seq, lost_seq AS last_seq FROM st WHERE lost_flow IS NOT NULL""")(
    lambda packets: _expired(packets))


def _expired(packets: DataFrame) -> DataFrame:
    """Snapshots emitted by expiry: the ended flow is not the last one of its key."""
    ended = feat.snapshots(packets, LIVE).filter(F.col("reason") == "ended").select(*feat.FLOW, "last_seq")
    newest = flow_packets(packets, LIVE).groupBy(*feat.KEY).agg(F.max("flow_seq").alias("newest"))
    return ended.join(newest, feat.KEY).filter(F.col("flow_seq") < F.col("newest")).select("flow_seq", "last_seq")


# ---- features ---------------------------------------------------------------------------

def _variance(n: str, total: str, squares: str) -> str:
    m = f"CAST(floor(({total}) / greatest({n}, 2)) AS HUGEINT)"
    rest = f"CAST(({total}) - greatest({n}, 2) * {m} AS DOUBLE)"
    return (f"CASE WHEN {n} > 1 THEN greatest(CAST(({squares}) - 2 * {m} * ({total}) + greatest({n}, 2) * {m} * {m} AS DOUBLE)"
            f" - {rest} * {rest} / CAST(greatest({n}, 2) AS DOUBLE), 0.0) / CAST(greatest({n}, 2) - 1 AS DOUBLE) ELSE 0.0 END")


def _mean(n: str, total: str) -> str:
    return f"CASE WHEN {n} > 0 THEN CAST({total} AS DOUBLE) / CAST({n} AS DOUBLE) ELSE 0.0 END"


def feature_sql(config: FlowConfig) -> str:
    def sums(prefix: str, value: str, test: str = "true") -> str:
        v = f"CASE WHEN {test} THEN {value} END"
        return (f"coalesce(sum({v}), 0)::HUGEINT AS {prefix}_s, coalesce(sum(({v})::HUGEINT * ({v})), 0)::HUGEINT AS {prefix}_q, "
                f"coalesce(min({v}), 0)::DOUBLE AS {prefix}_lo, coalesce(max({v}), 0)::DOUBLE AS {prefix}_hi, "
                f"count({v})::BIGINT AS {prefix}_c")

    def stats(title: str, prefix: str) -> dict[str, str]:
        return {f"{title} Mean": _mean(f"{prefix}_c", f"{prefix}_s"),
                f"{title} Std": f"sqrt({_variance(f'{prefix}_c', f'{prefix}_s', f'{prefix}_q')})",
                f"{title} Max": f"{prefix}_hi", f"{title} Min": f"{prefix}_lo"}

    var_all = _variance("(n + 1)", "(f_s + b_s + x0)", "(f_q + b_q + x0 * x0)")
    sec = "(dur / 1000000.0)"
    cols = {
        "source_ip": "src", "destination_ip": "dst", "Source Port": "sport", "Destination Port": "dport",
        "flow_start_ts": "t0 / 1000000.0", "flow_end_ts": "t1 / 1000000.0",
        "Flow Duration": "dur", "Total Fwd Packets": "f_c", "Total Backward Packets": "b_c",
        "Subflow Fwd Packets": "f_c", "Subflow Bwd Packets": "b_c",
        "Total Length of Fwd Packets": "f_s::BIGINT", "Fwd Packets Length Total": "f_s::BIGINT",
        "Bwd Packets Length Total": "b_s::BIGINT", "Subflow Fwd Bytes": "f_s::BIGINT", "Subflow Bwd Bytes": "b_s::BIGINT",
        **{k.replace("F ", "Fwd Packet Length "): v for k, v in stats("F", "f").items()},
        **{k.replace("B ", "Bwd Packet Length "): v for k, v in stats("B", "b").items()},
        "Avg Fwd Segment Size": _mean("f_c", "f_s"), "Avg Bwd Segment Size": _mean("b_c", "b_s"),
        "Flow Bytes/s": f"(f_s + b_s)::DOUBLE / {sec}", "Flow Packets/s": f"n::DOUBLE / {sec}",
        "Fwd Packets/s": f"f_c::DOUBLE / {sec}", "Bwd Packets/s": f"b_c::DOUBLE / {sec}",
        **stats("Flow IAT", "g"), "Fwd IAT Total": "gf_s::DOUBLE", **stats("Fwd IAT", "gf"),
        "Bwd IAT Total": "gb_s::DOUBLE", **stats("Bwd IAT", "gb"),
        "Fwd Header Length": "f_hdr", "Bwd Header Length": "b_hdr",
        "Min Packet Length": "all_lo", "Max Packet Length": "all_hi", "Packet Length Max": "all_hi",
        "Packet Length Mean": _mean("(n + 1)", "(f_s + b_s + x0)"),
        "Packet Length Std": f"sqrt({var_all})", "Packet Length Variance": var_all,
        "Average Packet Size": _mean("n", "(f_s + b_s)"), "Avg Packet Size": _mean("n", "(f_s + b_s + x0)"),
        "FIN Flag Count": "c_fin", "SYN Flag Count": "c_syn", "PSH Flag Count": "c_psh",
        "ACK Flag Count": "c_ack", "URG Flag Count": "c_urg", "Fwd PSH Flags": "psh0",
        "Init Fwd Win Bytes": "win0", "Init_Win_bytes_forward": "win0",
        "Init Bwd Win Bytes": "win1", "Init_Win_bytes_backward": "win1",
        "Fwd Act Data Packets": "act", "act_data_pkt_fwd": "act",
        "Fwd Seg Size Min": "seg", "min_seg_size_forward": "seg",
        **stats("Active", "av"), **stats("Idle", "iv"),
    }
    floats = {"flow_start_ts", "flow_end_ts", "Flow Duration"} | {
        c for c in cols if any(w in c for w in ("Mean", "Std", "Max", "Min", "/s", "Variance", "Total", "Avg", "Average"))
        and c not in ("Fwd Packets Length Total", "Bwd Packets Length Total", "Total Fwd Packets", "Fwd Seg Size Min",
                      "Total Backward Packets")}
    listed = ", ".join(f'round({sql}, 6) AS "{name}"' if name in floats else f'{sql} AS "{name}"'
                       for name, sql in cols.items())
    flag = lambda bit: f"count(*) FILTER ((fl & {bit}) <> 0)"
    return f"""{fold_sql(config)},
m0 AS (SELECT st.flow_seq, p.*, first_value(p.side) OVER w AS side0,
              p.ts_us - lag(p.ts_us) OVER w AS gap,
              p.ts_us - lag(p.ts_us) OVER (PARTITION BY st.flow_seq, p.side ORDER BY p.seq) AS sgap,
              max(p.ts_us) OVER (PARTITION BY st.flow_seq ORDER BY p.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock
       FROM st JOIN p ON p.k = st.k AND p.rn = st.rn WHERE NOT st.dropped
       WINDOW w AS (PARTITION BY st.flow_seq ORDER BY p.seq)),
m1 AS (SELECT *, side = side0 AS fwd, CASE WHEN ts_us - clock > {config.active_gap_us} THEN ts_us - clock END AS idle FROM m0),
m2 AS (SELECT *, last_value(CASE WHEN idle IS NOT NULL OR clock IS NULL THEN ts_us END IGNORE NULLS) OVER (
                   PARTITION BY flow_seq ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM m1),
m AS (SELECT *, CASE WHEN idle IS NOT NULL AND clock > since THEN clock - since END AS act_us FROM m2),
g AS (SELECT snap.flow_seq, snap.last_seq, any_value(snap.reason) AS reason,
             min_by(src_ip, seq) AS src, min_by(dst_ip, seq) AS dst, min_by(src_port, seq) AS sport, min_by(dst_port, seq) AS dport,
             any_value(protocol) AS protocol, min_by(ts_us, seq) AS t0, max(ts_us) AS t1,
             greatest(max(ts_us) - min_by(ts_us, seq), 10)::DOUBLE AS dur, count(*) AS n, min_by(pkt_len, seq)::HUGEINT AS x0,
             {sums('f', 'pkt_len', 'fwd')}, {sums('b', 'pkt_len', 'NOT fwd')}, {sums('g', 'gap')},
             {sums('gf', 'sgap', 'fwd')}, {sums('gb', 'sgap', 'NOT fwd')}, {sums('av', 'act_us')}, {sums('iv', 'idle')},
             min(pkt_len)::DOUBLE AS all_lo, max(pkt_len)::DOUBLE AS all_hi,
             coalesce(sum(header_len) FILTER (fwd), 0)::BIGINT AS f_hdr, coalesce(sum(header_len) FILTER (NOT fwd), 0)::BIGINT AS b_hdr,
             {flag(1)} AS c_fin, {flag(2)} AS c_syn, {flag(8)} AS c_psh, {flag(16)} AS c_ack, {flag(32)} AS c_urg,
             CAST(min_by((fl & 8) <> 0, seq) AS BIGINT) AS psh0,
             CASE WHEN any_value(protocol) = 'TCP' THEN min_by(win_size, seq) ELSE -1 END AS win0,
             CASE WHEN any_value(protocol) = 'TCP' THEN coalesce(max_by(win_size, seq) FILTER (NOT fwd), 0) ELSE -1 END AS win1,
             count(*) FILTER (fwd AND pkt_len > 0) AS act,
             min(CASE WHEN header_len > 0 THEN header_len ELSE 20 END) FILTER (fwd) AS seg
      FROM snap JOIN m ON m.flow_seq = snap.flow_seq AND m.seq <= snap.last_seq GROUP BY snap.flow_seq, snap.last_seq)
SELECT flow_seq, last_seq, reason, protocol, {listed} FROM g"""


def all_features(packets: DataFrame, config: FlowConfig) -> DataFrame:
    df = feat.snapshots(packets, config)
    doubles = {f.name for f in df.schema if f.dataType.simpleString() == "double"}
    skip = {*feat.KEY, "payload_sample"} - {"protocol"}
    return df.select(*[r6(F.col(f"`{c}`")).alias(c) if c in doubles else F.col(f"`{c}`")
                       for c in df.columns if c not in skip])


query("flow_features_replay", "packets", sql=feature_sql(REPLAY))(lambda packets: all_features(packets, REPLAY))
query("flow_features_small", "packets", sql=feature_sql(SMALL))(lambda packets: all_features(packets, SMALL))

query("protocol_coverage", "packets", sql=f"""{fold_sql(REPLAY)}
SELECT protocol, count(*) AS snapshots, count(DISTINCT flow_seq) AS flows,
       sum(CASE WHEN protocol = 'TCP' THEN 0 ELSE 1 END)::BIGINT AS without_window
FROM snap JOIN (SELECT DISTINCT k, protocol FROM p) u USING (k) GROUP BY protocol""")(
    lambda packets: feat.snapshots(packets, REPLAY).groupBy("protocol").agg(
        F.count("*").alias("snapshots"), F.countDistinct("flow_seq").alias("flows"),
        F.count_if(F.col("Init Fwd Win Bytes") == -1).alias("without_window")))
