"""Live flow reconstruction: one bounded state per canonical key.

The state holds sums and last values only, never packets. Each trigger folds the
key's new packets in (time, arrival) order; event-time timeouts end silent flows.
Keys share calls and stored states: a group of keys (by hash) is one call a trigger,
so a key costs what its packets and its numbers cost. A trigger rewrites the states of
the groups it meets, idle keys included; ``groups`` sets how many keys share.
The output rows carry the same accumulators as the batch path and go through the
same feature formulas.
"""

from __future__ import annotations

import pickle
from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netloom.operators.features import features
from netloom.operators.flows import PAYLOAD_SAMPLE, FlowConfig
from netloom.operators.pieces import ACCUMULATORS, DECIMAL_SUMS
from netloom.operators.packets import ACK, FIN, KEY, PSH, RST, SYN, URG, with_key

# Squares can pass 64 bits, so they travel as decimal text.
_FLOW_LONGS = ["flow_seq", "first_ts", "first_side", "first_len", "first_win", "first_psh", "fin0", "fin1",
               "emitted", "pending", "mark", "seen", "last_any", "last_0", "last_1", "active_from"]
_KEY_LONGS = ["arm_0", "arm_1"]
_SUMS = [name for name in ACCUMULATORS if name not in DECIMAL_SUMS]
STATE_LONGS = [*_KEY_LONGS, *_FLOW_LONGS, *_SUMS]
OUT_LONGS = ["flow_seq", "first_ts", "first_side", "first_len", "first_win", "first_psh", *_SUMS]
#: The state of a group: {key: (when to wake, the key's packed state)}, pickled; it holds numbers and text only.
STATE_SCHEMA = "keys binary"
GROUPS = 1_024
# Numbers travel as arrays: a key's rows are a few columns then, whatever is accumulated.
OUTPUT_SCHEMA = ("lo_ip string, lo_port bigint, hi_ip string, hi_port bigint, protocol string, emit int, "
                 "longs array<bigint>, squares array<string>, sample binary")
PACKET = ["seq", "ts_us", "side", "self_connection", "flags", "pkt_len", "header_len", "win_size", "payload_len", "payload"]
Packet = namedtuple("Packet", [*PACKET, "protocol"])
_FLAGS = {"n_fin": FIN, "n_syn": SYN, "n_rst": RST, "n_psh": PSH, "n_ack": ACK, "n_urg": URG}


def _plus(flow: dict, name: str, value: int) -> None:
    flow[name] = (flow.get(name) or 0) + value


def _series(flow: dict, name: str, value: int, extremes: str, squares: str) -> None:
    _plus(flow, name, value)
    _plus(flow, squares, value * value)
    low, high = f"{extremes}_min", f"{extremes}_max"
    flow[low] = value if flow.get(low) is None else min(flow[low], value)
    flow[high] = value if flow.get(high) is None else max(flow[high], value)


def _open(p) -> dict:
    return {"flow_seq": p.seq, "first_ts": p.ts_us, "first_side": p.side, "first_len": p.pkt_len,
            "first_win": p.win_size, "first_psh": int(p.flags & PSH != 0), "fin0": 0, "fin1": 0, "emitted": 0,
            "pending": 0, "mark": p.ts_us, "seen": p.ts_us, "active_from": p.ts_us, "sample": b""}


def _add(flow: dict, p, config: FlowConfig) -> None:
    """One packet into the flow's accumulators."""
    forward = p.self_connection or p.side == flow["first_side"]
    d = "f" if forward else "b"
    if flow.get("last_any") is not None:
        _series(flow, "gap", p.ts_us - flow["last_any"], "gap", "gap2")
        silence = p.ts_us - flow["seen"]
        if silence > config.active_gap_us:
            _series(flow, "idle", silence, "idle", "idle2")
            _plus(flow, "idle_n", 1)
            active = flow["seen"] - flow["active_from"]
            if active > 0:
                _series(flow, "active", active, "active", "active2")
                _plus(flow, "active_n", 1)
            flow["active_from"] = p.ts_us
    mine = f"last_{p.side}"
    if flow.get(mine) is not None:
        _series(flow, f"{d}_gap", p.ts_us - flow[mine], f"{d}_gap", f"{d}_gap2")
    flow["last_any"] = flow[mine] = p.ts_us
    flow["seen"] = flow["end_ts"] = max(flow["seen"], p.ts_us)
    _plus(flow, f"{d}_n", 1)
    _series(flow, f"{d}_len", p.pkt_len, d, f"{d}_len2")
    _plus(flow, f"{d}_header", p.header_len)
    if forward:
        _plus(flow, "f_data", int(p.payload_len > 0))
        size = p.header_len if p.header_len > 0 else 20
        flow["f_segment"] = size if flow.get("f_segment") is None else min(flow["f_segment"], size)
    elif p.protocol == "TCP":
        flow["b_win"] = p.win_size
    for name, bit in _FLAGS.items():
        _plus(flow, name, int(p.flags & bit != 0))
    flow["last_seq"] = max(flow.get("last_seq") or p.seq, p.seq)
    room = PAYLOAD_SAMPLE - len(flow["sample"])
    if room > 0 and p.payload:
        flow["sample"] += bytes(p.payload)[:room]
    flow["pending"] += 1


def advance(flow: dict | None, arms: list, p, config: FlowConfig, out: list) -> dict | None:
    """One packet through the flow rules; returns the flow still open."""
    armed = arms[p.side]
    if armed is not None:
        plain = p.protocol == "TCP" and p.flags & 63 == ACK and p.pkt_len == 0 and p.payload_len == 0
        if plain and p.ts_us <= armed:
            return flow
        arms[p.side] = None
    if flow is not None and config.inactivity_us is not None and p.ts_us - flow["seen"] > config.inactivity_us:
        _end(flow, out)
        flow = None
    if flow is None:
        flow = _open(p)
    _add(flow, p, config)
    if p.flags & FIN:
        flow[f"fin{p.side}"] = 1
    both = flow["fin0"] and flow["fin1"]
    closed = both or flow["n_rst"] > 0
    reason = (1 if closed else 2 if (flow["fin0"] or flow["fin1"]) and not flow["emitted"]
              else 3 if flow["pending"] >= config.emit_packets
              else 4 if p.ts_us - flow["mark"] >= config.emit_after_us else 0)
    if reason:
        flow["emitted"] += 1
        flow["pending"], flow["mark"] = 0, p.ts_us
        out.append({**flow, "emit": reason})
    if not closed:
        return flow
    if both and not flow["n_rst"]:
        arms[1 - p.side] = p.ts_us + config.grace_us
    return None


def _end(flow: dict, out: list) -> None:
    if flow["pending"]:
        out.append({**flow, "emit": 0})


def unpacked(state: tuple | None) -> tuple[dict | None, list]:
    """(open flow or None, until when each side's ACKs are dropped) from the packed state of a key."""
    if state is None:
        return None, [None, None]
    longs, squares, sample = state
    raw = dict(zip(STATE_LONGS, [None if value is None else int(value) for value in longs]))
    flow = {name: value for name, value in raw.items() if name not in _KEY_LONGS and value is not None}
    flow |= {name: int(value) for name, value in zip(DECIMAL_SUMS, squares) if value is not None}
    flow["sample"] = bytes(sample or b"")
    return (flow if "flow_seq" in flow else None), [raw["arm_0"], raw["arm_1"]]


def packed(flow: dict | None, arms: list) -> tuple:
    raw = {"arm_0": arms[0], "arm_1": arms[1], **(flow or {})}
    return ([raw.get(name) for name in STATE_LONGS],
            [None if raw.get(name) is None else str(raw[name]) for name in DECIMAL_SUMS], raw.get("sample") or b"")


def packed_row(row: dict) -> tuple:
    """A snapshot's accumulators as the columns of OUTPUT_SCHEMA."""
    return ([row.get(name) for name in OUT_LONGS], [str(row.get(name) or 0) for name in DECIMAL_SUMS], row["sample"])


def _wake(flow: dict | None, arms: list, config: FlowConfig, epoch_us: int, watermark: int) -> int | None:
    """The first moment (ms) something of a key may end, which the watermark has passed then; None: nothing is open."""
    until = [arm for arm in arms if arm is not None]
    if flow is not None:
        until.append(flow["seen"] + config.inactivity_us)
    return max((min(until) + epoch_us) // 1000 + 1, watermark + 1) if until else None


def _packets(batches: Iterator[pd.DataFrame]) -> dict[tuple, list[Packet]]:
    """Packets by key in (time, arrival) order, column by column out of the Arrow batches."""
    out: dict[tuple, list[Packet]] = {}
    for pdf in batches:
        columns = {name: pdf[name].tolist() for name in {*KEY, *PACKET}}
        packets = map(Packet._make, zip(*[columns[name] for name in Packet._fields]))
        for key, p in zip(zip(*[columns[name] for name in KEY]), packets):
            out.setdefault(key, []).append(p)
    for rows in out.values():
        rows.sort(key=lambda p: (p.ts_us, p.seq))
    return out


def _step(config: FlowConfig, epoch_us: int):
    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = pickle.loads(state.get[0]) if state.exists else {}
        watermark = state.getCurrentWatermarkMs()
        now = watermark * 1000 - epoch_us
        arrived = {} if state.hasTimedOut else _packets(batches)
        made: list[tuple] = []
        # keys with packets, then those without whose time has come
        for key in [*arrived, *[key for key, (wake, _) in kept.items() if wake < watermark and key not in arrived]]:
            flow, arms = unpacked(kept.pop(key)[1] if key in kept else None)
            out: list[dict] = []
            if key in arrived:
                for p in arrived[key]:
                    flow = advance(flow, arms, p, config, out)
            else:
                if flow is not None and now > flow["seen"] + config.inactivity_us:
                    _end(flow, out)
                    flow = None
                arms = [arm if arm is not None and arm >= now else None for arm in arms]
            if (wake := _wake(flow, arms, config, epoch_us, watermark)) is not None:
                kept[key] = wake, packed(flow, arms)
            made += [(*key, row["emit"], *packed_row(row)) for row in out]
        if kept:
            state.update((pickle.dumps(kept),))
            state.setTimeoutTimestamp(max(min(wake for wake, _ in kept.values()), watermark + 1))
        elif state.exists:
            state.remove()
        if made:
            yield pd.DataFrame(made, columns=[*KEY, "emit", "longs", "squares", "sample"])
    return step


def stream_accumulated(packets: DataFrame, config: FlowConfig, delay: str = "2 seconds",
                       epoch_us: int = 0, groups: int = GROUPS) -> DataFrame:
    """Streaming packets (with ``ts_us``) -> snapshot accumulators, append mode.

    ``epoch_us`` is the epoch time at which ``ts_us`` is zero. Rows later than the
    watermark are dropped by Spark and show in the query progress.
    """
    if config.inactivity_us is None:
        raise ValueError("live flows need an inactivity limit, or state would grow without bound")
    keyed = with_key(packets)
    if "payload" not in keyed.columns:
        keyed = keyed.withColumn("payload", F.lit(None).cast("binary"))
    tcp = F.col("protocol") == "TCP"
    rows = keyed.withColumns({
        "event_time": F.timestamp_micros(F.col("ts_us") + F.lit(epoch_us)),
        "flags": F.when(tcp, F.col("flags")).otherwise(0).cast("bigint"),
    }).select(*KEY, "seq", "ts_us", "event_time", "side", "self_connection", "flags", "pkt_len", "header_len",
              "win_size", "payload_len", "payload")
    shared = rows.withColumn("group", F.pmod(F.xxhash64(*KEY), F.lit(groups)))
    folded = shared.withWatermark("event_time", delay).groupBy("group").applyInPandasWithState(
        _step(config, epoch_us), OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
    return numbered(folded)


def numbered(rows: DataFrame) -> DataFrame:
    """The accumulators as columns again."""
    number = {name: F.col("longs")[i] for i, name in enumerate(OUT_LONGS)}
    number["first_psh"] = number["first_psh"] != 0
    number |= {name: F.col("squares")[i].cast("decimal(38,0)") for i, name in enumerate(DECIMAL_SUMS)}
    return rows.select(*KEY, "emit", *[c.alias(name) for name, c in number.items()], F.array("sample").alias("sample"))


def stream_snapshots(packets: DataFrame, config: FlowConfig, delay: str = "2 seconds", epoch_us: int = 0) -> DataFrame:
    return features(stream_accumulated(packets, config, delay, epoch_us))


def gap_sessions(packets: DataFrame, gap: str = "1500 milliseconds", delay: str = "2 seconds",
                 epoch_us: int = 0) -> DataFrame:
    """The gap-only variant with Spark's own session windows (batch or streaming)."""
    timed = with_key(packets).withColumn("event_time", F.timestamp_micros(F.col("ts_us") + F.lit(epoch_us)))
    return timed.withWatermark("event_time", delay).groupBy(*KEY, F.session_window("event_time", gap)).agg(
        F.count("*").alias("packets"), F.sum("pkt_len").alias("bytes"),
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))
