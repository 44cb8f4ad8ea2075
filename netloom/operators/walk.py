"""The flow rules over packets of a key in arrival order, and what follows from them for every packet.

`decide` is the state machine itself: which teardown ACKs are dropped, where silence ends a flow and where flags
close one. Everything else (flow, position, gaps, active periods) follows from its codes by array operations. The
state between two batches is a few numbers of the open key, so a partition is walked once, batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from netloom.operators.packets import ACK, FIN, KEY, PSH, RST

# Kinds of packets, and what is decided about one (bits of a code).
PLAIN, PURE_ACK, FINISH, RESET = range(4)
DROPPED, EXPIRED, CLOSES, BY_FIN = 1, 2, 4, 8
#: Who has finished: nobody, side 0, side 1.
NOBODY, SIDE_0, SIDE_1 = 2, 0, 1
ENTRIES = (SIDE_0, SIDE_1, NOBODY)


@dataclass
class Rules:
    """State of a key: who finished, latest accepted time, until when (and by which packet) ACKs of a side are dropped."""

    finished: int = NOBODY
    clock: int | None = None
    until: list = field(default_factory=lambda: [None, None])
    armed_by: list = field(default_factory=lambda: [None, None])


def decide(packets: Iterable[tuple], rules: Rules, inactivity_us: int | None, grace_us: int) -> tuple[list[int], dict[int, int]]:
    """A code for each (seq, ts, side, kind, to itself), and the arming packet of those dropped, by place."""
    codes, armed_at = [], {}
    until, armed_by, finished, clock = rules.until, rules.armed_by, rules.finished, rules.clock
    for at, (seq, ts, side, kind, own) in enumerate(packets):
        limit = until[side]
        if limit is not None:
            if kind == PURE_ACK and ts <= limit:
                armed_at[at] = armed_by[side]
                codes.append(DROPPED)
                continue
            until[side] = None
        code = 0
        if clock is None or ts > clock:
            if clock is not None and inactivity_us is not None and ts - clock > inactivity_us:
                code, finished = EXPIRED, NOBODY
            clock = ts
        if kind == RESET:
            code, finished = code | CLOSES, NOBODY
        elif kind == FINISH:
            if finished == NOBODY or finished == side or own:
                finished = side
            else:
                code, finished = code | CLOSES | BY_FIN, NOBODY
                until[1 - side], armed_by[1 - side] = ts + grace_us, seq
        codes.append(code)
    rules.finished, rules.clock = finished, clock
    return codes, armed_at


def arrays(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(name).to_numpy(zero_copy_only=False) for name in names]


def kinds(batch: pa.RecordBatch) -> np.ndarray:
    """The kind of each packet; flags count for TCP alone."""
    flags, size, payload = (batch.column(name).fill_null(0).to_numpy(zero_copy_only=False) for name in ("flags", "pkt_len", "payload_len"))
    tcp = pc.fill_null(pc.equal(batch.column("protocol"), "TCP"), False).to_numpy(zero_copy_only=False)
    kind = np.where((flags & 63 == ACK) & (size == 0) & (payload == 0), PURE_ACK, PLAIN)
    kind = np.where(flags & FIN != 0, FINISH, kind)
    return np.where(tcp, np.where(flags & RST != 0, RESET, kind), PLAIN)


def heads(batch: pa.RecordBatch, names: list[str], last: pa.RecordBatch | None) -> np.ndarray:
    """Rows at which any of the columns differs from the row before (NULLs are alike)."""
    new = np.zeros(batch.num_rows, bool)
    for name in names:
        column = batch.column(name)
        if last is not None:
            column = pa.concat_arrays([last.column(name), column])
        differ = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
        missing = column.is_null().to_numpy(zero_copy_only=False)
        new[len(batch) - len(differ):] |= differ | (missing[1:] != missing[:-1])
    if last is None:
        new[0] = True
    return np.flatnonzero(new)


def decided(batches: Iterator[pa.RecordBatch], inactivity_us: int | None, grace_us: int, key: list[str] = KEY,
            entry: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, dict[int, int]]]:
    """(batch, heads of keys, codes, arming packets); with ``entry`` columns finished and clock start a key's state."""
    rules, last = Rules(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = heads(batch, key, last)
        columns = [*arrays(batch, "seq", "ts_us", "side"), kinds(batch), *arrays(batch, "self_connection")]
        rows = list(zip(*[c.tolist() for c in columns]))
        codes: list[int] = []
        armed: dict[int, int] = {}
        bounds = [0, *[s for s in starts.tolist() if s], len(rows)]
        for low, high in zip(bounds[:-1], bounds[1:]):
            if low in starts[:1] or low:
                rules = Rules()
                if entry:
                    rules.finished, rules.clock = batch.column("finished")[low].as_py(), batch.column("clock")[low].as_py()
            found, by = decide(rows[low:high], rules, inactivity_us, grace_us)
            codes += found
            armed |= {low + at: seq for at, seq in by.items()}
        last = batch.slice(len(batch) - 1, 1)
        yield batch, starts, np.array(codes, np.int8), armed


def exits(batches: Iterator[pa.RecordBatch], key: list[str], inactivity_us: int | None, grace_us: int) -> Iterator[pa.RecordBatch]:
    """``key`` and exits of each piece: who has finished after it, for each of ENTRIES before it."""
    states, last, head = [], None, None

    def row():
        out = pa.array([[s.finished for s in states]], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*[head.column(name) for name in key], out], names=[*key, "exits"])

    for batch in batches:
        if not batch.num_rows:
            continue
        starts = heads(batch, key, last)
        columns = [*arrays(batch, "seq", "ts_us", "side"), kinds(batch), *arrays(batch, "self_connection")]
        rows = list(zip(*[c.tolist() for c in columns]))
        bounds = [0, *[s for s in starts.tolist() if s], len(rows)]
        for low, high in zip(bounds[:-1], bounds[1:]):
            if low in starts[:1] or low:
                if head is not None:
                    yield row()
                head, clock = batch.slice(low, 1), batch.column("clock")[low].as_py()
                states = [Rules(finished=e, clock=clock) for e in ENTRIES]
            for state in states:
                decide(rows[low:high], state, inactivity_us, grace_us)
        last = batch.slice(len(batch) - 1, 1)
    if head is not None:
        yield row()


# ---- what follows for every accepted packet ----------------------------------------------------------


@dataclass
class Open:
    """The open flow at a batch's border."""

    first: dict | None = None        # constants of its first packet
    count: int = 0
    last_ts: int = 0
    side_ts: list = field(default_factory=lambda: [None, None])
    clock: int = 0
    active_from: int = 0
    payload: int = 0


def _before(index: np.ndarray) -> np.ndarray:
    """Running maximum of the rows before."""
    out = np.empty(len(index), np.int64)
    out[0] = -1
    np.maximum.accumulate(index[:-1], out=out[1:])
    return out


def context(batch: pa.RecordBatch, codes: np.ndarray, new_key: np.ndarray, closed_before: bool, flow: Open,
            active_gap_us: int, sample: int) -> dict[str, pa.Array]:
    """Columns of a batch of accepted packets; ``flow`` (what was open before) becomes what is open after."""
    n = batch.num_rows
    row = np.arange(n)
    seq, ts, side, own = arrays(batch, "seq", "ts_us", "side", "self_connection")
    expired, closes = codes & EXPIRED != 0, codes & CLOSES != 0
    after_close = np.concatenate(([closed_before], closes[:-1]))
    starts = new_key | expired | after_close
    head = np.maximum.accumulate(np.where(starts, row, -1))
    going = head < 0                                    # rows of the flow that was open before
    base = np.maximum(head, 0)

    def of_first(name: str, values: np.ndarray) -> np.ndarray:
        return np.where(going, flow.first[name], values[base]) if going.any() else values[base]

    flags = batch.column("flags").fill_null(0).to_numpy(zero_copy_only=False)
    win, length = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("win_size", "pkt_len"))
    firsts = {"flow_seq": of_first("flow_seq", seq), "first_ts": of_first("first_ts", ts), "first_side": of_first("first_side", side),
              "first_len": of_first("first_len", length), "first_win": of_first("first_win", win),
              "first_psh": of_first("first_psh", flags & PSH != 0)}
    position = np.where(going, flow.count + row, row - base)
    gap = ts - np.concatenate(([flow.last_ts], ts[:-1]))
    side_gap, has_side_gap = np.zeros(n, np.int64), np.zeros(n, bool)
    for s in (0, 1):
        mine = side == s
        before = _before(np.where(mine, row, -1))
        inside = mine & (before >= 0) & (before >= head)
        side_gap[inside] = ts[inside] - ts[before[inside]]
        has_side_gap |= inside
        if flow.side_ts[s] is not None:
            carried = mine & going & (before < 0)
            side_gap[carried] = ts[carried] - flow.side_ts[s]
            has_side_gap |= carried
    # the flow's clock: a running maximum within the flow, on ranks so that flows can be told apart by addition
    values, rank = np.unique(np.concatenate((ts, [flow.clock])), return_inverse=True)
    order = np.cumsum(starts) * len(values)
    seen = order + rank[:n]
    if going.any():
        seen[0] = max(seen[0], rank[n])
    upto = np.maximum.accumulate(seen)
    clock = np.where(starts, ts, values[np.concatenate(([rank[n]], (upto - order)[:-1])) % len(values)])
    silence = np.where(starts, 0, ts - clock)
    idle = silence > active_gap_us
    island = _before(np.where(starts | idle, row, -1))
    active = clock - np.where(island < 0, flow.active_from, ts[np.maximum(island, 0)])
    out: dict[str, pa.Array] = {
        "flow_seq": pa.array(firsts["flow_seq"]), "position": pa.array(position),
        "forward": pa.array((side == firsts["first_side"]) | own), "closes": pa.array(closes),
        "closed_by_fin": pa.array(codes & BY_FIN != 0), "expired": pa.array(expired), "starts": pa.array(starts),
        "after_open": pa.array(expired & ~new_key & ~after_close),
        "gap_us": pa.array(gap, mask=starts), "side_gap_us": pa.array(side_gap, mask=~has_side_gap),
        "idle_us": pa.array(silence, mask=~idle), "active_us": pa.array(active, mask=~(idle & (active > 0))),
        "first_ts": pa.array(firsts["first_ts"]), "first_side": pa.array(firsts["first_side"].astype(np.int32)),
        "first_len": pa.array(firsts["first_len"]), "first_win": pa.array(firsts["first_win"]),
        "first_psh": pa.array(firsts["first_psh"].astype(bool))}
    held = flow.payload
    if "payload" in batch.schema.names:
        payload = batch.column("payload")
        size = pc.fill_null(pc.binary_length(payload), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(size)
        before = total - size
        used = before - np.where(going, -flow.payload, before[base])
        room = sample - used
        out["payload"] = payload
        cut = np.flatnonzero((room <= 0) & (size > 0) | (size > room))
        if len(cut) or (size == 0).any():
            texts = pc.if_else(pa.array((size > 0) & (room > 0)), payload, None)
            part = np.flatnonzero((room > 0) & (size > room))   # one packet of a flow at most
            if len(part):
                new = [payload[i].as_py()[:room[i]] for i in part.tolist()]
                mask = np.zeros(n, bool)
                mask[part] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(new, payload.type))
            out["payload"] = texts
        held = int(used[-1] + size[-1])
    # what is open after the batch
    last = n - 1
    tail = slice(int(base[last]) if not going[last] else 0, n)
    flow.side_ts = [int(ts[tail][side[tail] == s][-1]) if (side[tail] == s).any() else (flow.side_ts[s] if going[last] else None)
                    for s in (0, 1)]
    flow.first = {name: values[last].item() for name, values in firsts.items()}
    flow.count, flow.last_ts, flow.payload = int(position[last]) + 1, int(ts[last]), held
    flow.clock = int(values[(upto[last] - order[last]) % len(values)])
    at = int(np.maximum.accumulate(np.where(starts | idle, row, -1))[last])
    flow.active_from = int(ts[at]) if at >= 0 else flow.active_from
    return out


COLUMNS = ["flow_seq", "position", "forward", "closes", "closed_by_fin", "expired", "starts", "after_open", "gap_us",
           "side_gap_us", "idle_us", "active_us", "first_ts", "first_side", "first_len", "first_win", "first_psh"]


def with_flow(batches: Iterator[pa.RecordBatch], carried: list[str], inactivity_us: int | None, grace_us: int,
              active_gap_us: int, sample: int) -> Iterator[pa.RecordBatch]:
    """Accepted packets with ``carried`` columns and COLUMNS (and the payload cut to the flow's first ``sample`` bytes)."""
    flow, closed, fresh = Open(), False, True
    for batch, starts, codes, _ in decided(batches, inactivity_us, grace_us):
        new_key = np.zeros(len(batch), bool)
        new_key[starts] = True
        kept = codes & DROPPED == 0
        # a key's first packet is never dropped
        if not kept.any():
            continue
        rows = batch if kept.all() else batch.filter(pa.array(kept))
        fresh = fresh or bool(new_key[0])
        out = context(rows, codes[kept], new_key[kept], closed and not fresh, flow, active_gap_us, sample)
        closed, fresh = bool(codes[kept][-1] & CLOSES), False
        names = [*carried, *COLUMNS, *[n for n in ("payload",) if n in out]]
        yield pa.RecordBatch.from_arrays([out[n] if n in out else rows.column(n) for n in names], names=names)


def dropped(batches: Iterator[pa.RecordBatch], carried: list[str], inactivity_us: int | None, grace_us: int) -> Iterator[pa.RecordBatch]:
    """Dropped packets with ``carried`` columns and armed_at, the packet that closed their connection."""
    for batch, _, codes, armed in decided(batches, inactivity_us, grace_us):
        places = np.flatnonzero(codes & DROPPED)
        if len(places):
            rows = batch.take(pa.array(places))
            yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in carried], pa.array([armed[i] for i in places.tolist()], pa.int64())],
                                             names=[*carried, "armed_at"])


def with_codes(batches: Iterator[pa.RecordBatch], key: list[str], inactivity_us: int | None, grace_us: int) -> Iterator[pa.RecordBatch]:
    """All rows of pieces whose entry state is known, with code and armed_at."""
    for batch, _, codes, armed in decided(batches, inactivity_us, grace_us, key, entry=True):
        at = pa.array([armed.get(i) for i in range(len(batch))] if armed else [None] * len(batch), pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes.astype(np.int32)), at],
                                         names=[*batch.schema.names, "code", "armed_at"])
