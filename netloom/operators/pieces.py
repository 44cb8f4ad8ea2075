"""Sums over a piece: the packets of one flow up to and including an emission.

Computed on whole Arrow batches before any shuffle, so what travels is one row per
emission (plus one per batch border), not one per packet. Only integer sums,
minima, maxima and last values are kept; they combine exactly in any grouping.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from netloom.operators.packets import ACK, FIN, KEY, PSH, RST, SYN, URG

FLOW = [*KEY, "flow_seq"]
CONSTANTS = ["first_ts", "first_side", "first_len", "first_win", "first_psh"]
FLAGS = {"fin": FIN, "syn": SYN, "rst": RST, "psh": PSH, "ack": ACK, "urg": URG}

# Accumulator -> how two of them combine.
KINDS: dict[str, str] = {
    **{f"{d}_{x}": kind for d in "fb" for x, kind in (
        ("n", "sum"), ("len", "sum"), ("len2", "sum"), ("min", "min"), ("max", "max"), ("header", "sum"),
        ("gap", "sum"), ("gap2", "sum"), ("gap_min", "min"), ("gap_max", "max"))},
    "gap": "sum", "gap2": "sum", "gap_min": "min", "gap_max": "max",
    "end_ts": "max", "f_data": "sum", "f_segment": "min", "b_win": "last", "last_seq": "max",
    **{f"n_{name}": "sum" for name in FLAGS},
    **{f"{x}{y}": kind for x in ("active", "idle") for y, kind in (
        ("_n", "sum"), ("", "sum"), ("2", "sum"), ("_min", "min"), ("_max", "max"))},
}
ACCUMULATORS = list(KINDS)
DECIMAL_SUMS = ["f_gap2", "b_gap2", "gap2", "active2", "idle2"]
# A square of a gap may pass 64 bits. With gap = a * 2**21 + b its sum of squares is
# 2**42 * sum(a*a) + 2**22 * sum(a*b) + sum(b*b); within a batch those three fit.
LOW_BITS = 21
_PARTS = {name: [f"{name}_aa", f"{name}_ab", f"{name}_bb"] for name in DECIMAL_SUMS}
_LONGS = [name for name in ACCUMULATORS if name not in DECIMAL_SUMS] + [p for parts in _PARTS.values() for p in parts]


def piece_schema(payload: bool) -> StructType:
    return StructType.fromDDL(
        "lo_ip string, lo_port bigint, hi_ip string, hi_port bigint, protocol string, flow_seq bigint, "
        "part bigint, position bigint, emit int, first_ts bigint, first_side int, first_len bigint, "
        "first_win bigint, first_psh boolean, " + ", ".join(f"{name} bigint" for name in _LONGS)
        + (", sample array<binary>" if payload else ""))


def piece_sums(batch: pa.RecordBatch, emit: np.ndarray) -> pa.RecordBatch:
    """One row per piece of the batch; ``emit`` holds the reason code of every packet."""
    def column(name: str) -> pa.Array:
        return batch.column(batch.schema.get_field_index(name))

    def values(name: str, empty: int | bool = 0) -> np.ndarray:
        return column(name).fill_null(empty).to_numpy(zero_copy_only=False)

    n = batch.num_rows
    first = values("begins", False).copy()
    first[0] = True
    first[1:] |= emit[:-1] != 0
    heads = np.nonzero(first)[0]
    tails = np.append(heads[1:], n) - 1
    everything = np.ones(n, dtype=bool)
    out: dict[str, pa.Array] = {}

    def count(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.astype(np.int64), heads)

    def add(name: str, value: np.ndarray, mask: np.ndarray) -> None:
        out[name] = pa.array(np.add.reduceat(np.where(mask, value, 0).astype(np.int64), heads))

    def extreme(name: str, value: np.ndarray, mask: np.ndarray, lowest: bool) -> None:
        rest = np.iinfo(np.int64).max if lowest else np.iinfo(np.int64).min
        pick = np.minimum if lowest else np.maximum
        found = pick.reduceat(np.where(mask, value, rest).astype(np.int64), heads)
        out[name] = pa.array(found, mask=count(mask) == 0)

    def series(name: str, extremes: str, squares: str, value: np.ndarray, mask: np.ndarray) -> None:
        add(name, value, mask)
        extreme(f"{extremes}_min", value, mask, True)
        extreme(f"{extremes}_max", value, mask, False)
        if squares in _PARTS:
            a, b = value >> LOW_BITS, value & ((1 << LOW_BITS) - 1)
            for part, product in zip(_PARTS[squares], (a * a, a * b, b * b)):
                add(part, product, mask)
        else:
            add(squares, value * value, mask)

    forward, tcp = values("forward", False), values("is_tcp", False)
    length, header, flags = values("pkt_len"), values("header_len"), values("flags")
    gap, side_gap = values("gap_us"), values("side_gap_us")
    has_gap = column("gap_us").is_valid().to_numpy(zero_copy_only=False)
    has_side_gap = column("side_gap_us").is_valid().to_numpy(zero_copy_only=False)
    for d, here in (("f", forward), ("b", ~forward)):
        add(f"{d}_n", here, everything)
        series(f"{d}_len", d, f"{d}_len2", length, here)
        add(f"{d}_header", header, here)
        series(f"{d}_gap", f"{d}_gap", f"{d}_gap2", side_gap, here & has_side_gap)
    series("gap", "gap", "gap2", gap, has_gap)
    extreme("end_ts", values("ts_us"), everything, False)
    extreme("last_seq", values("seq"), everything, False)
    add("f_data", forward & (values("payload_len") > 0), everything)
    extreme("f_segment", np.where(header > 0, header, 20), forward, True)
    place = np.maximum.reduceat(np.where(tcp & ~forward, np.arange(n), -1), heads)
    out["b_win"] = pa.array(values("win_size")[place], mask=place < 0)
    for name, bit in FLAGS.items():
        add(f"n_{name}", tcp & (flags & bit != 0), everything)
    for name in ("active", "idle"):
        valid = column(f"{name}_us").is_valid().to_numpy(zero_copy_only=False)
        out[f"{name}_n"] = pa.array(count(valid))
        series(name, name, f"{name}2", values(f"{name}_us"), valid)
    taken = pa.array(heads)
    head = [column(name).take(taken) for name in [*FLOW, "part"]]
    rows = [*head, pa.array(values("position")[tails]), pa.array(emit[tails].astype(np.int32)),
            *[column(name).take(taken) for name in CONSTANTS], *[out[name] for name in _LONGS]]
    names = [*FLOW, "part", "position", "emit", *CONSTANTS, *_LONGS]
    if "payload" in batch.schema.names:
        payload = column("payload")
        valid = payload.is_valid()
        offsets = np.append(0, np.cumsum(count(valid.to_numpy(zero_copy_only=False)))).astype(np.int32)
        rows.append(pa.ListArray.from_arrays(pa.array(offsets), payload.filter(valid)))
        names.append("sample")
    return pa.RecordBatch.from_arrays(rows, names=names)


def joined_squares(pieces: DataFrame) -> DataFrame:
    """The three parts of each sum of squares as one exact decimal."""
    def wide(name: str):
        return F.col(name).cast("decimal(20,0)")

    exact = {name: (wide(aa) * F.lit(1 << 2 * LOW_BITS).cast("decimal(18,0)")
                    + wide(ab) * F.lit(1 << LOW_BITS + 1).cast("decimal(18,0)") + wide(bb)).cast("decimal(38,0)")
             for name, (aa, ab, bb) in _PARTS.items()}
    return pieces.withColumns(exact).drop(*[p for parts in _PARTS.values() for p in parts])
