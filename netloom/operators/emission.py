"""Snapshot emission: the greedy "N packets or T time since the last" rule.

Each emission restarts both counters, so where the next one falls depends on the
last one; no window expresses that. From an emission at packet p the next is
within N packets, so the rule is a jump table over positions. A task walks the
table over rows sorted by flow and position, Arrow batch by Arrow batch, holding
only the last emission of the open flow.

A flow longer than ``slice_rows`` is cut into slices. The last emission before a
slice is one of the N packets just before it, so a slice is summed up exactly as
a table of N entries (last emission before -> last emission inside). The tables
of a flow are composed in order, and every slice is then walked on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from netloom.operators.flows import FlowConfig
from netloom.operators.packets import FIN, KEY, has_flag
from netloom.operators.pieces import piece_schema, piece_sums
from netloom.session import cut_lineage

# Why a snapshot was emitted (index = code).
REASONS = ["none", "terminated", "first_fin", "packets", "time"]


def jump_table(ts: np.ndarray, ends: np.ndarray, after_us: int, packets: int) -> tuple[np.ndarray, np.ndarray]:
    """Next emission after an emission at each row, and its reason code.

    ``ends`` is the row index just past the flow. Rows whose next emission is not
    in the batch point at ``ends``.
    """
    n = len(ts)
    index = np.arange(n)
    jump = np.minimum(index + packets, ends)
    why = np.full(n, 3, dtype=np.int8)
    found = np.zeros(n, dtype=bool)
    for step in range(1, packets + 1):
        if step >= n:
            break
        late = ts[step:] - ts[:-step] >= after_us
        hit = late & ~found[:-step] & (index[:-step] + step < ends[:-step])
        where = np.nonzero(hit)[0]
        # At the packet limit both rules fire; the packet rule names it.
        target = where + step
        why[where] = np.where(step == packets, 3, 4)
        jump[where] = target
        found[where] = True
    return jump, why


def first_emission(ts, fin, closes, end: int, start: int, last_ts: int, count: int, emitted: bool,
                   after_us: int, packets: int) -> tuple[int, int]:
    """First emission at or after ``start``, given the state before it."""
    stop = min(end, start + packets - count)
    for row in range(start, stop):
        count += 1
        if closes[row]:
            return row, 1
        if fin[row] and not emitted:
            return row, 2
        if count >= packets:
            return row, 3
        if ts[row] - last_ts >= after_us:
            return row, 4
    return end, 0


def _arrays(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False) for name in names]


def _walk(batches: Iterator[pa.RecordBatch], after_us: int, packets: int) -> Iterator[pa.RecordBatch]:
    """Mark emissions (reason codes) and sum each batch's packets up to the next one."""
    last_ts, count, emitted = 0, 0, False
    for batch in batches:
        n = batch.num_rows
        ts, position, fin, closes, begins, entry_ts, entry_count = _arrays(
            batch, "ts_us", "position", "is_fin", "closes", "begins", "entry_ts", "entry_count")
        starts = np.nonzero(begins)[0]
        bounds = np.append(starts, n)
        if n == 0:
            continue
        heads = bounds if bounds[0] == 0 else np.insert(bounds, 0, 0)
        ends = np.repeat(heads[1:], np.diff(heads))
        jump, why = jump_table(ts, ends, after_us, packets)
        # A close ends the flow, so only the last row of a run may be one.
        jumps, reasons = jump.tolist(), why.tolist()
        fins = np.where(fin, np.arange(n), n)
        next_fin = np.minimum.accumulate(fins[::-1])[::-1].tolist()
        emit = np.zeros(n, dtype=np.int8)
        for head, end in zip(heads[:-1].tolist(), heads[1:].tolist()):
            if begins[head] and position[head] == 0:
                # A new flow: its first packet counts as packet one and starts the clock.
                last_ts, count, emitted = int(ts[head]), 0, False
                at = min(next_fin[head], head + packets - 1, jumps[head] if reasons[head] == 4 else end, end)
                reason = 2 if at < end and fin[at] else 3 if at == head + packets - 1 else 4
            else:
                if begins[head]:
                    last_ts, count, emitted = int(entry_ts[head]), int(entry_count[head]), True
                at, reason = first_emission(ts, fin, closes, end, head, last_ts, count, emitted, after_us, packets)
            last = -1
            while at < end:
                emit[at] = reason
                last = at
                at, reason = jumps[at], reasons[at]
            if closes[end - 1]:
                emit[end - 1] = 1
                last = end - 1
            if last >= 0:
                last_ts, count, emitted = int(ts[last]), end - 1 - last, True
            else:
                count += end - head
        yield piece_sums(batch, emit)


def _summarise(batches: Iterator[pa.RecordBatch], after_us: int, packets: int) -> Iterator[pa.RecordBatch]:
    """Per slice: its N-entry table. Rows arrive sorted; ``context`` rows lead a slice."""
    schema = pa.schema([("unit", pa.int64()), ("table", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])
    pending: list[pa.RecordBatch] = []

    def finish() -> pa.RecordBatch:
        table = pa.Table.from_batches(pending)
        ts, fin, closes, context = (
            table.column(name).to_numpy() for name in ("ts_us", "is_fin", "closes", "context"))
        lead, n = int(context.sum()), len(ts)
        ends = np.full(n, n)
        jump = jump_table(ts, ends, after_us, packets)[0].tolist()
        answers: list[int] = []
        memo: dict[int, int] = {}
        for slot in range(max(lead, 1)):
            if lead:
                at = jump[slot]
                if at < lead:   # this context packet cannot be the last emission before the slice
                    answers.append(-1)
                    continue
            else:
                at, _ = first_emission(ts, fin, closes, n, 0, int(ts[0]), 0, False, after_us, packets)
            path = []
            last = at
            while at < n and at not in memo:
                path.append(at)
                last = at
                at = jump[at]
            last = memo[at] if at in memo else last
            memo.update((row, last) for row in path)
            answers.append(last - (n - packets))
        return pa.RecordBatch.from_arrays(
            [pa.array([table.column("unit")[0].as_py()]), pa.array([answers], pa.list_(pa.int64())),
             pa.array([ts[-packets:].tolist()], pa.list_(pa.int64()))], schema=schema)

    for batch in batches:
        cuts = np.nonzero(_arrays(batch, "begins")[0])[0].tolist()
        edges = sorted({0, *cuts, batch.num_rows})
        for low, high in zip(edges[:-1], edges[1:]):
            if low in cuts and pending:
                yield finish()
                pending = []
            pending.append(batch.slice(low, high - low))
    if pending:
        yield finish()


# What the walk and the sums behind it need; everything else stays out of Arrow.
CARRIED = [*KEY, "seq", "ts_us", "flags", "pkt_len", "header_len", "win_size", "payload_len",
           "side", "flow_seq", "position", "forward", "closes", "gap_us", "side_gap_us",
           "idle_us", "active_us", "first_ts", "first_side", "first_len", "first_win", "first_psh"]


def _carried(packets: DataFrame) -> DataFrame:
    return packets.select(*CARRIED, *[name for name in ("payload",) if name in packets.columns])


def mark(packets: DataFrame, config: FlowConfig) -> DataFrame:
    """Ordinary keys: rows of a key share a partition and arrive in order, as the walk that made them left them."""
    rows = _carried(packets).withColumns({
        "is_tcp": F.col("protocol") == "TCP",
        "is_fin": (F.col("protocol") == "TCP") & has_flag(FIN),
        "begins": F.col("position") == 0,
        "entry_ts": F.lit(0).cast("bigint"), "entry_count": F.lit(0).cast("bigint"),
        "part": F.lit(0).cast("bigint"),
    })
    return _apply(rows, config)


def _apply(rows: DataFrame, config: FlowConfig) -> DataFrame:
    after_us, limit = config.emit_after_us, config.emit_packets
    if after_us <= 0 or limit < 1:
        raise ValueError("emission limits must be positive")
    return rows.mapInArrow(lambda batches: _walk(batches, after_us, limit), piece_schema("payload" in rows.columns))


def mark_sliced(packets: DataFrame, config: FlowConfig) -> DataFrame:
    """Hot keys: flows cut into slices of ``slice_rows`` packets by position."""
    size, limit = max(config.slice_rows, config.emit_packets), config.emit_packets
    after_us = config.emit_after_us
    flow = [*KEY, "flow_seq"]
    rows = cut_lineage(_carried(packets).withColumns({
        "is_tcp": F.col("protocol") == "TCP",
        "is_fin": (F.col("protocol") == "TCP") & has_flag(FIN),
        "part": F.floor(F.col("position") / size).cast("bigint"),
    }).drop("first"))

    # Slices that have a successor are full; only those need a table. Slices are
    # counted first, so the join below is on (flow, slice) and never on a hot flow.
    slices = rows.groupBy(*flow, "part").agg(F.count("*").alias("rows_in_slice"))
    parts = F.max("part").over(Window.partitionBy(*flow))
    long_slices = slices.select(*flow, "part", parts.alias("parts")).filter("parts > 0")
    narrow = rows.select(*flow, "part", "position", "ts_us", "is_fin", "closes").join(long_slices, [*flow, "part"])
    context = narrow.filter(F.col("position") % size >= size - limit).withColumns({
        "part": F.col("part") + 1, "context": F.lit(True)})
    full = narrow.withColumn("context", F.lit(False)).unionByName(context).filter("part < parts")
    full = full.withColumn("unit", F.col("part"))
    window = Window.partitionBy(*flow, "part").orderBy("position")
    full = full.withColumn("begins", F.row_number().over(window) == 1)
    table_schema = StructType([
        StructField("unit", LongType()),
        StructField("table", ArrayType(LongType())), StructField("tail", ArrayType(LongType()))])
    names = full.select(*flow).schema

    def summarise(batches):
        return _summarise_with_flow(batches, after_us, limit, flow)

    sums = full.sortWithinPartitions(*flow, "part", "position").mapInArrow(
        summarise, StructType(names.fields + table_schema.fields))
    entries = compose(cut_lineage(sums), flow, limit, config.slices_per_group)
    ready = rows.join(entries, [*flow, "part"], "left").withColumns({
        "entry_ts": F.coalesce("entry_ts", F.lit(0).cast("bigint")),
        "entry_count": F.coalesce("entry_count", F.lit(0).cast("bigint")),
        "begins": F.col("position") % size == 0,
    }).repartition(*flow, "part").sortWithinPartitions(*flow, "part", "position")
    return _apply(ready, config)


def compose(tables: DataFrame, flow: list[str], packets: int, group_size: int) -> DataFrame:
    """Entry state of every slice but a flow's first, from the slices' tables.

    A slot is the place of the last emission among the N packets before a slice.
    Tables are composed within groups of slices, the groups in order, and then the
    slices of each group from the slot it starts with, so no row grows with the flow
    beyond its number of groups.
    """
    def follow(slot: Column, item: Column) -> Column:
        return F.get(item["table"], slot.cast("int"))

    def slots_after(items: Column, first: Column) -> Column:
        begin = F.struct(first.cast("bigint").alias("slot"), F.array().cast("array<bigint>").alias("slots"))
        return F.aggregate(
            items, begin,
            lambda state, item: F.struct(
                follow(state["slot"], item).alias("slot"),
                F.concat(state["slots"], F.array(follow(state["slot"], item))).alias("slots")),
            lambda state: state["slots"])

    grouped = cut_lineage(tables.withColumn("group", F.floor(F.col("unit") / group_size)).groupBy(*flow, "group").agg(
        F.array_sort(F.collect_list(F.struct("unit", "table", "tail"))).alias("slices")))
    starts = F.sequence(F.lit(0).cast("bigint"), F.lit(packets - 1).cast("bigint"))
    composed = grouped.select(*flow, "group", F.transform(
        starts, lambda slot: F.aggregate("slices", slot, follow)).alias("table"))
    chains = composed.groupBy(*flow).agg(F.array_sort(F.collect_list(F.struct("group", "table"))).alias("groups"))
    before = F.concat(F.array(F.lit(0).cast("bigint")), slots_after(F.col("groups"), F.lit(0)))
    begun = chains.select(*flow, F.explode(F.arrays_zip("groups", F.slice(before, 1, F.size("groups")).alias("slot"))).alias("g")).select(
        *flow, F.col("g.groups.group").alias("group"), F.col("g.slot").alias("slot"))
    walked = grouped.join(begun, [*flow, "group"]).withColumn("slots", slots_after(F.col("slices"), F.col("slot")))
    ends = walked.select(*flow, F.explode(F.arrays_zip("slices", "slots")).alias("e"))
    return ends.select(
        *flow, (F.col("e.slices.unit") + 1).alias("part"),
        F.get(F.col("e.slices.tail"), F.col("e.slots").cast("int")).alias("entry_ts"),
        (F.lit(packets - 1) - F.col("e.slots")).cast("bigint").alias("entry_count"))


def _summarise_with_flow(batches, after_us: int, limit: int, flow: list[str]):
    """Attach the flow columns of each slice to its table."""
    heads: list[pa.RecordBatch] = []

    def observed():
        for batch in batches:
            begins = _arrays(batch, "begins")[0]
            for row in np.nonzero(begins)[0].tolist():
                heads.append(batch.select(flow).slice(row, 1))
            yield batch

    for table in _summarise(observed(), after_us, limit):
        head = heads.pop(0)
        yield pa.RecordBatch.from_arrays([*head.columns, *table.columns],
                                         names=[*head.schema.names, *table.schema.names])
