"""Cumulative flow snapshots: sums per piece, running sums over a flow's pieces,
then the feature formulas.

Only integer sums, minima, maxima and last values are carried, so batches, slices
and streaming state all give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from netloom.functions.constants import STAGE1_FEATURES, STAGE2_FEATURES
from netloom.functions.moments import WIDE, mean, sample_variance
from netloom.operators import emission
from netloom.operators.flows import FlowConfig, assign
from netloom.operators.packets import KEY
from netloom.operators.pieces import CONSTANTS, FLOW, KINDS, joined_squares
from netloom.operators.running import Running, running
from netloom.session import cut_lineage


def _accumulate(pieces: DataFrame, sliced: bool) -> DataFrame:
    """Running totals at the end of every piece that yields a snapshot."""
    if sliced:
        last = pieces.groupBy(*FLOW, "part").agg(F.max("position").alias("m")).select(
            *FLOW, "part", F.max("m").over(Window.partitionBy(*FLOW)).alias("flow_end"))
        pieces = pieces.join(last, [*FLOW, "part"])
        ends = F.col("flow_end") == F.col("position")
    else:
        ends = F.lead("position").over(Window.partitionBy(*FLOW).orderBy("position")).isNull()
    columns = dict(KINDS) | ({"sample": "gather"} if "sample" in pieces.columns else {})
    kept = joined_squares(pieces).select(
        *FLOW, "part", "position", "emit", *CONSTANTS, ends.alias("is_last"),
        # an empty sample is NULL, so that only the few pieces with payload are gathered
        *[(F.when(F.size(name) > 0, F.col(name)) if name == "sample" else F.col(name)).alias(f"_{name}")
          for name in columns])
    runs = {name: Running(kind, F.col(f"_{name}")) for name, kind in columns.items()}
    out = running(kept, FLOW, "position", runs, "part" if sliced else None)
    return out.filter((F.col("emit") > 0) | F.col("is_last")).select(*FLOW, *CONSTANTS, "emit", *columns)


def accumulated(packets: DataFrame, config: FlowConfig) -> DataFrame:
    """Cumulative accumulators, one row per snapshot."""
    out = None
    for part, sliced in assign(packets, config):
        pieces = (emission.mark_sliced if sliced else emission.mark)(part, config)
        if sliced:
            pieces = cut_lineage(pieces)
        rows = _accumulate(pieces, sliced)
        out = rows if out is None else out.unionByName(rows)
    return out


def _reason() -> Column:
    names = emission.REASONS
    out = F.when(F.col("emit") == 0, "ended")
    for code in range(1, len(names)):
        out = out.when(F.col("emit") == code, names[code])
    return out


def features(acc: DataFrame) -> DataFrame:
    """The snapshot columns from the accumulators (batch and streaming alike)."""
    c = F.col
    tcp = c("protocol") == "TCP"

    def or_zero(value: Column) -> Column:
        return F.coalesce(value, F.lit(0))

    def number(value: Column) -> Column:
        return or_zero(value).cast("double")

    f_n, b_n = or_zero(c("f_n")), or_zero(c("b_n"))
    f_len, b_len = or_zero(c("f_len")), or_zero(c("b_len"))
    packets, volume = f_n + b_n, f_len + b_len
    first = c("first_len")
    duration = F.greatest(c("end_ts") - c("first_ts"), F.lit(10).cast("bigint")).cast("double")
    seconds = duration / F.lit(1e6)
    all_n, all_len = packets + 1, volume + first
    all_len2 = or_zero(c("f_len2")) + or_zero(c("b_len2")) + first * first
    all_var = sample_variance(all_n, all_len, all_len2)

    def stats(prefix: str, title: str, count: Column) -> dict[str, Column]:
        total = or_zero(c(prefix))
        return {
            f"{title} Mean": mean(count, total),
            f"{title} Std": F.sqrt(sample_variance(count, total, F.coalesce(c(f"{prefix}2"), F.lit(0).cast(WIDE)))),
            f"{title} Max": number(c(f"{prefix}_max")),
            f"{title} Min": number(c(f"{prefix}_min")),
        }

    from_low = c("first_side") == 0
    one = F.lit(1).cast("bigint")
    f_gaps, b_gaps = F.greatest(f_n - one, F.lit(0)), F.greatest(b_n - one, F.lit(0))
    f_mean, b_mean = mean(f_n, f_len), mean(b_n, b_len)
    all_max = F.greatest(c("f_max"), c("b_max")).cast("double")
    all_min = F.least(c("f_min"), c("b_min")).cast("double")
    f_win = F.when(tcp, c("first_win")).otherwise(-1).cast("bigint")
    b_win = F.when(tcp, or_zero(c("b_win"))).otherwise(-1).cast("bigint")
    columns: dict[str, Column] = {
        "source_ip": F.when(from_low, c("lo_ip")).otherwise(c("hi_ip")),
        "destination_ip": F.when(from_low, c("hi_ip")).otherwise(c("lo_ip")),
        "flow_start_ts": c("first_ts").cast("double") / F.lit(1e6),
        "flow_end_ts": c("end_ts").cast("double") / F.lit(1e6),
        "Source Port": F.when(from_low, c("lo_port")).otherwise(c("hi_port")),
        "Destination Port": F.when(from_low, c("hi_port")).otherwise(c("lo_port")),
        "Flow Duration": duration,
        "Total Fwd Packets": f_n, "Total Backward Packets": b_n,
        "Subflow Fwd Packets": f_n, "Subflow Bwd Packets": b_n,
        "Total Length of Fwd Packets": f_len, "Fwd Packets Length Total": f_len,
        "Bwd Packets Length Total": b_len,
        "Subflow Fwd Bytes": f_len, "Subflow Bwd Bytes": b_len,
        "Fwd Packet Length Max": number(c("f_max")), "Fwd Packet Length Min": number(c("f_min")),
        "Fwd Packet Length Mean": f_mean,
        "Fwd Packet Length Std": F.sqrt(sample_variance(f_n, f_len, or_zero(c("f_len2")))),
        "Bwd Packet Length Max": number(c("b_max")), "Bwd Packet Length Min": number(c("b_min")),
        "Bwd Packet Length Mean": b_mean,
        "Bwd Packet Length Std": F.sqrt(sample_variance(b_n, b_len, or_zero(c("b_len2")))),
        "Avg Fwd Segment Size": f_mean, "Avg Bwd Segment Size": b_mean,
        "Flow Bytes/s": volume / seconds, "Flow Packets/s": packets / seconds,
        "Fwd Packets/s": f_n / seconds, "Bwd Packets/s": b_n / seconds,
        **stats("gap", "Flow IAT", packets - one),
        "Fwd IAT Total": number(c("f_gap")), **stats("f_gap", "Fwd IAT", f_gaps),
        "Bwd IAT Total": number(c("b_gap")), **stats("b_gap", "Bwd IAT", b_gaps),
        "Fwd Header Length": or_zero(c("f_header")), "Bwd Header Length": or_zero(c("b_header")),
        "Min Packet Length": all_min, "Max Packet Length": all_max, "Packet Length Max": all_max,
        "Packet Length Mean": mean(all_n, all_len),
        "Packet Length Std": F.sqrt(all_var), "Packet Length Variance": all_var,
        "Average Packet Size": mean(packets, volume),
        "Avg Packet Size": mean(packets, all_len),
        "FIN Flag Count": or_zero(c("n_fin")), "SYN Flag Count": or_zero(c("n_syn")),
        "PSH Flag Count": or_zero(c("n_psh")), "ACK Flag Count": or_zero(c("n_ack")),
        "URG Flag Count": or_zero(c("n_urg")),
        "Fwd PSH Flags": (tcp & c("first_psh")).cast("bigint"),
        "Init Fwd Win Bytes": f_win, "Init_Win_bytes_forward": f_win,
        "Init Bwd Win Bytes": b_win, "Init_Win_bytes_backward": b_win,
        "Fwd Act Data Packets": or_zero(c("f_data")), "act_data_pkt_fwd": or_zero(c("f_data")),
        "Fwd Seg Size Min": or_zero(c("f_segment")), "min_seg_size_forward": or_zero(c("f_segment")),
        **stats("active", "Active", or_zero(c("active_n"))),
        **stats("idle", "Idle", or_zero(c("idle_n"))),
    }
    if "sample" in acc.columns:
        joined = F.aggregate("sample", F.lit(b""), lambda a, x: F.concat(a, x))
        columns["payload_sample"] = F.decode(joined, "ISO-8859-1")
    else:
        columns["payload_sample"] = F.lit("")
    return acc.select(
        *FLOW, "last_seq", _reason().alias("reason"),
        *[value.alias(name) for name, value in columns.items()],
    )


CONTEXT_COLUMNS = ["source_ip", "destination_ip", "protocol", "flow_start_ts", "flow_end_ts",
                   "Source Port", "Destination Port"]


def snapshots(packets: DataFrame, config: FlowConfig) -> DataFrame:
    """Packets -> cumulative flow snapshots (78 columns plus key, flow and reason)."""
    return features(accumulated(packets, config))


def model_matrix(snapshot: DataFrame, stage: int) -> DataFrame:
    """Snapshot rows narrowed to one stage's features, in model order, as doubles."""
    names = STAGE1_FEATURES if stage == 1 else STAGE2_FEATURES
    return snapshot.select(*FLOW, "last_seq", *[F.col(n).cast("double").alias(n) for n in names])
