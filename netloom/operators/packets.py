"""Packet rows: normalisation, flag predicates and the direction-free flow key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# TCP flag bits.
FIN, SYN, RST, PSH, ACK, URG = 1, 2, 4, 8, 16, 32

KEY = ["lo_ip", "lo_port", "hi_ip", "hi_port", "protocol"]


def has_flag(bit: int, flags: str | Column = "flags") -> Column:
    flags = F.col(flags) if isinstance(flags, str) else flags
    return flags.bitwiseAND(F.lit(bit)) != 0


def is_pure_ack() -> Column:
    """TCP, ACK alone among the six flags, and no payload."""
    return (
        (F.col("protocol") == "TCP")
        & (F.col("flags").bitwiseAND(F.lit(63)) == ACK)
        & (F.col("pkt_len") == 0)
        & (F.col("payload_len") == 0)
    )


def decode_flags(df: DataFrame) -> DataFrame:
    names = {"is_fin": FIN, "is_syn": SYN, "is_rst": RST, "is_psh": PSH, "is_ack": ACK, "is_urg": URG}
    return df.withColumns({name: has_flag(bit) for name, bit in names.items()})


def normalise(headers: DataFrame) -> DataFrame:
    """Decoded headers -> packet rows.

    Input: seq, ts_us, ip_version, ip_protocol, src_ip, dst_ip, src_port,
    dst_port, tcp_flags, tcp_data_offset (words, null if absent), tcp_window,
    l4_payload_len [, payload]. Only IPv4 is kept; packet length is the
    transport payload length.
    """
    tcp, udp = F.col("ip_protocol") == 6, F.col("ip_protocol") == 17
    known = tcp | udp
    size = F.when(known, F.coalesce("l4_payload_len", F.lit(0))).otherwise(0).cast("bigint")
    extra = [F.when(known, F.col("payload")).alias("payload")] if "payload" in headers.columns else []
    return headers.filter(F.col("ip_version") == 4).select(
        "seq", "ts_us", "src_ip", "dst_ip",
        F.when(known, F.coalesce("src_port", F.lit(0))).otherwise(0).cast("bigint").alias("src_port"),
        F.when(known, F.coalesce("dst_port", F.lit(0))).otherwise(0).cast("bigint").alias("dst_port"),
        F.when(tcp, "TCP").when(udp, "UDP").otherwise("OTHER").alias("protocol"),
        F.when(tcp, F.coalesce("tcp_flags", F.lit(0))).otherwise(0).cast("bigint").alias("flags"),
        size.alias("pkt_len"),
        F.when(tcp, F.coalesce(F.col("tcp_data_offset") * 4, F.lit(20))).when(udp, 8)
        .otherwise(20).cast("bigint").alias("header_len"),
        F.when(tcp, F.coalesce("tcp_window", F.lit(0))).otherwise(0).cast("bigint").alias("win_size"),
        size.alias("payload_len"),
        *extra,
    )


def with_key(packets: DataFrame) -> DataFrame:
    """Add the canonical key and ``side`` (0 = sent by the lower endpoint)."""
    source = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    target = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    low, high = F.least(source, target), F.greatest(source, target)
    base = packets
    if "payload_len" not in packets.columns:
        base = base.withColumn("payload_len", F.col("pkt_len"))
    return base.withColumns({
        "protocol": F.upper("protocol"),
        "lo_ip": low["ip"], "lo_port": low["port"],
        "hi_ip": high["ip"], "hi_port": high["port"],
        "side": F.when(source == low, 0).otherwise(1),
        "self_connection": source == target,
    }).drop("src_ip", "src_port", "dst_ip", "dst_port")
