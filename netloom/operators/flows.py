"""Flow reconstruction: which packets belong to which flow instance.

A key's packets are walked in arrival order (``seq``) by one small state machine
(see ``walk``): ordinary keys need one shuffle, one sort and one pass. Keys above
``hot_rows`` packets are cut into pieces at places where only one thing is unknown,
which side has finished. A piece is then a table from the state before it to the
state after it; tables are composed in order, and all pieces walked in parallel.
Flow context of hot keys is a set of running aggregates over slices (see ``running``).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from netloom.operators import walk
from netloom.operators.packets import FIN, KEY, PSH, has_flag, is_pure_ack, with_key
from netloom.operators.running import Running, running
from netloom.session import cut_lineage


PAYLOAD_SAMPLE = 512  # bytes kept per flow


@dataclass(frozen=True)
class FlowConfig:
    """Flow rules (microseconds) and the sizes beyond which a group is split."""

    inactivity_us: int | None = None      # None: replay, flows never expire
    emit_after_us: int = 150_000
    emit_packets: int = 25
    grace_us: int = 1_000_000
    active_gap_us: int = 5_000_000
    hot_rows: int = 4_000_000             # packets per key before it is sliced
    slice_rows: int = 1_000_000           # arrival numbers / packets per slice
    slices_per_group: int = 1_024         # slices whose emission tables are composed together
    broadcast_keys: int = 50_000          # hot keys that may be broadcast


REPLAY = FlowConfig()
LIVE = FlowConfig(inactivity_us=1_500_000)
SMALL = FlowConfig(inactivity_us=5_000_000, emit_after_us=8_000_000, emit_packets=3)


def _cut_in_pieces(packets: DataFrame, config: FlowConfig) -> DataFrame:
    """``packets`` with ``piece``, the first packet of a part of its key, and ``clock``, the key's time before it.

    A piece begins where little of what came before matters: the latest time was set by a packet that is no pure
    ACK, and since the last FIN both sides have sent one, which ends the dropping of teardown ACKs. So only one
    thing is unknown there, who has finished. The first such place of each slice of arrival numbers is taken.
    """
    sliced = packets.withColumn("arrival_slice", F.floor(F.col("seq") / config.slice_rows))
    ts, seq, side, sure = F.col("ts_us"), F.col("seq"), F.col("side"), ~is_pure_ack()
    finish = (F.col("protocol") == "TCP") & has_flag(FIN)
    df = running(cut_lineage(sliced), KEY, "seq", {
        "clock": Running("max", ts, inclusive=False),
        "sure_clock": Running("max", F.when(sure, ts), inclusive=False),
        "fin_at": Running("last", F.when(finish, seq), inclusive=False),
        "sure_0": Running("last", F.when(sure & (side == 0), seq), inclusive=False),
        "sure_1": Running("last", F.when(sure & (side == 1), seq), inclusive=False)}, "arrival_slice")
    unarmed = F.col("fin_at").isNull() | F.col("self_connection") | (
        (F.col("sure_0") > F.col("fin_at")) & (F.col("sure_1") > F.col("fin_at")))
    df = df.withColumn("clear", F.coalesce((F.col("sure_clock") == F.col("clock")) & unarmed, F.lit(False)))
    df = cut_lineage(df.drop("sure_clock", "fin_at", "sure_0", "sure_1"))
    # one row for each slice: its first clear place, and the last one of the slices before
    cuts = df.groupBy(*KEY, "arrival_slice").agg(F.min(F.when(F.col("clear"), F.struct("seq", "clock"))).alias("cut"))
    earlier = Window.partitionBy(*KEY).orderBy("arrival_slice").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.withColumn("earlier", F.last("cut", ignorenulls=True).over(earlier))
    own = F.when(F.col("cut.seq") <= seq, F.col("cut")).otherwise(F.col("earlier"))
    return (df.drop("clock", "clear").join(cuts, [*KEY, "arrival_slice"]).withColumn("own", own)
            .select("*", F.coalesce("own.seq", F.lit(-1)).alias("piece"), F.col("own.clock").alias("clock"))
            .drop("own", "cut", "earlier"))


def _entries(pieces: DataFrame) -> DataFrame:
    """KEY, piece and ``finished``, the state before each piece: the pieces' exits composed in order, one row each."""
    def after(state: Column, item: Column) -> Column:
        at = F.array_position(F.lit(list(walk.ENTRIES)), state).cast("int") - 1
        return F.get(item["exits"], at)

    begin = F.struct(F.lit(walk.NOBODY).alias("state"), F.array().cast("array<int>").alias("before"))
    chains = pieces.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("piece", "exits"))).alias("items"))
    walked = chains.withColumn("before", F.aggregate("items", begin, lambda s, item: F.struct(
        after(s["state"], item).alias("state"), F.concat(s["before"], F.array(s["state"])).alias("before")), lambda s: s["before"]))
    return walked.select(*KEY, F.explode(F.arrays_zip("items", "before")).alias("e")).select(
        *KEY, F.col("e.items.piece").alias("piece"), F.col("e.before").alias("finished"))


def settle_sliced(packets: DataFrame, config: FlowConfig) -> DataFrame:
    """Decisions and context of hot keys: pieces are walked in parallel, twice and never more.

    The first walk gives each piece's transition (who has finished after it, for every state before it); composed
    along the key these give the state before each piece, from which the second walk decides its packets.
    """
    part = [*KEY, "piece"]
    pieces = cut_lineage(_cut_in_pieces(packets, config))
    limits = (config.inactivity_us, config.grace_us)
    narrow = pieces.select(*part, "seq", "ts_us", "side", "self_connection", "flags", "pkt_len", "payload_len", "clock")
    schema = StructType([*narrow.select(*part).schema.fields, StructField("exits", ArrayType(IntegerType()))])
    transitions = narrow.repartition(*part).sortWithinPartitions(*part, "seq").mapInArrow(
        lambda batches: walk.exits(batches, part, *limits), schema)
    known = pieces.join(_entries(cut_lineage(transitions)), part)
    schema = StructType([*known.schema.fields, StructField("code", IntegerType()), StructField("armed_at", LongType())])
    df = known.repartition(*part).sortWithinPartitions(*part, "seq").mapInArrow(
        lambda batches: walk.with_codes(batches, part, *limits), schema)
    bit = lambda b: F.col("code").bitwiseAND(F.lit(b)) != 0
    df = cut_lineage(df.withColumns({
        "dropped": bit(walk.DROPPED), "expired": bit(walk.EXPIRED), "closes": bit(walk.CLOSES),
        "closed_by_fin": bit(walk.BY_FIN)}).drop("code", "piece", "clock", "finished"))
    df = cut_lineage(running(df, KEY, "seq", {
        "expiries": Running("sum", F.col("expired").cast("bigint")),
        "closings": Running("sum", F.col("closes").cast("bigint"), inclusive=False)}, "arrival_slice"))
    df = df.withColumn("epoch", F.col("expiries") + F.coalesce("closings", F.lit(0)))
    accepted, side = ~F.col("dropped"), F.col("side")
    seen = F.struct("epoch", F.col("ts_us").alias("ts"))
    return running(
        df.drop("closings", "expiries"), KEY, "seq", {
            "before": Running("last", F.when(accepted, seen), inclusive=False),
            "before_0": Running("last", F.when(accepted & (side == 0), seen), inclusive=False),
            "before_1": Running("last", F.when(accepted & (side == 1), seen), inclusive=False),
            "flow_clock": Running("max", F.when(accepted, seen), inclusive=False),
            "accepted_no": Running("sum", accepted.cast("bigint"))}, "arrival_slice")


def hot_keys(packets: DataFrame, config: FlowConfig) -> DataFrame:
    """Keys with more than ``hot_rows`` packets (counted with map-side combine)."""
    return packets.groupBy(*KEY).count().filter(F.col("count") > config.hot_rows).select(*KEY)


def split_hot(packets: DataFrame, config: FlowConfig) -> tuple[DataFrame, DataFrame | None]:
    """(packets of ordinary keys, packets of hot keys or None).

    At most rows / hot_rows keys can be hot; they are broadcast only when counted
    to be few, otherwise Catalyst joins them with its adaptive skew handling.
    """
    if packets.count() <= config.hot_rows:
        return packets, None
    keys = cut_lineage(hot_keys(packets, config))
    count = keys.count()
    if count == 0:
        return packets, None
    side = F.broadcast(keys) if count <= config.broadcast_keys else keys
    return packets.join(side, KEY, "left_anti"), packets.join(side, KEY, "left_semi")


def _with_flow_sliced(labels: DataFrame, config: FlowConfig) -> DataFrame:
    """Accepted packets with their flow's first packet, position and gaps."""
    def run(df: DataFrame, **columns: Running) -> DataFrame:
        return running(cut_lineage(df), KEY, "seq", columns, "arrival_slice")

    starts = F.coalesce(F.col("before")["epoch"] != F.col("epoch"), F.lit(True))
    open_before = F.coalesce(F.col("before")["epoch"] == F.col("epoch") - F.col("expired").cast("int"), F.lit(False))
    df = labels.filter(~F.col("dropped")).withColumns({
        "starts": starts, "after_open": F.col("expired") & open_before})
    has_payload = "payload" in df.columns
    if has_payload:
        df = run(df, bytes_before=Running("sum", F.length("payload").cast("bigint"), inclusive=False))
        df = df.withColumn("bytes_before", F.coalesce("bytes_before", F.lit(0)))
    # Active periods, measured on the flow's clock, which never runs back.
    same_flow = F.col("flow_clock")["epoch"] == F.col("epoch")
    df = df.withColumn("clock_us", F.when(same_flow, F.col("flow_clock")["ts"]))
    silence = F.col("ts_us") - F.col("clock_us")
    df = df.withColumn("idle_us", F.when(silence > config.active_gap_us, silence))
    first = F.struct(
        F.col("accepted_no").alias("no"), "seq", "ts_us", "side", "pkt_len", "win_size",
        has_flag(PSH).alias("psh"), *(["bytes_before"] if has_payload else []),
    )
    island = F.when(F.col("starts") | F.col("idle_us").isNotNull(), F.col("ts_us"))
    df = run(df, first=Running("last", F.when(F.col("starts"), first)),
             active_from=Running("last", island, inclusive=False))
    if has_payload:
        room = F.lit(PAYLOAD_SAMPLE) - (F.col("bytes_before") - F.col("first")["bytes_before"])
        df = df.withColumn("payload", F.when(
            (room > 0) & (F.length("payload") > 0),
            F.substring("payload", F.lit(1), room.cast("int")))).drop("bytes_before")
    same_side = F.when(F.col("side") == 0, F.col("before_0")).otherwise(F.col("before_1"))
    active = F.col("clock_us") - F.col("active_from")
    return df.select(
        *[name for name in df.columns if name not in (
            "before", "before_0", "before_1", "flow_clock", "first", "clock_us", "active_from")],
        F.col("first")["seq"].alias("flow_seq"),
        F.col("first")["ts_us"].alias("first_ts"),
        F.col("first")["side"].alias("first_side"),
        F.col("first")["pkt_len"].alias("first_len"),
        F.col("first")["win_size"].alias("first_win"),
        F.col("first")["psh"].alias("first_psh"),
        (F.col("accepted_no") - F.col("first")["no"]).alias("position"),
        ((F.col("side") == F.col("first")["side"]) | F.col("self_connection")).alias("forward"),
        F.when(F.col("before")["epoch"] == F.col("epoch"),
               F.col("ts_us") - F.col("before")["ts"]).alias("gap_us"),
        F.when(same_side["epoch"] == F.col("epoch"),
               F.col("ts_us") - same_side["ts"]).alias("side_gap_us"),
        F.when(F.col("idle_us").isNotNull() & (active > 0), active).alias("active_us"),
    )


#: Columns of a packet that the walk needs, and those it passes on beside its own.
_NEEDED = [*KEY, "seq", "ts_us", "side", "self_connection", "flags", "pkt_len", "payload_len"]
_CARRIED = [*_NEEDED, "header_len", "win_size"]
_FLOW_SCHEMA = ("flow_seq bigint, position bigint, forward boolean, closes boolean, closed_by_fin boolean, expired boolean, "
                "starts boolean, after_open boolean, gap_us bigint, side_gap_us bigint, idle_us bigint, active_us bigint, "
                "first_ts bigint, first_side int, first_len bigint, first_win bigint, first_psh boolean")


def _in_order(packets: DataFrame, names: list[str]) -> DataFrame:
    """Whole keys in one partition each, packets in arrival order: the only shuffle and sort of ordinary keys."""
    return packets.select(*names).repartition(*KEY).sortWithinPartitions(*KEY, "seq")


def _with_flow(packets: DataFrame, config: FlowConfig) -> DataFrame:
    """Accepted packets of ordinary keys with their flow's first packet, position and gaps, by one walk."""
    extra = [name for name in ("payload",) if name in packets.columns]
    rows = _in_order(packets, [*_CARRIED, *extra])
    fields = {f.name: f for f in rows.schema.fields}
    schema = StructType([*[fields[name] for name in _CARRIED], *StructType.fromDDL(_FLOW_SCHEMA).fields, *[fields[n] for n in extra]])
    return rows.mapInArrow(lambda batches: walk.with_flow(
        batches, _CARRIED, config.inactivity_us, config.grace_us, config.active_gap_us, PAYLOAD_SAMPLE), schema)


def assign(packets: DataFrame, config: FlowConfig) -> list[tuple[DataFrame, bool]]:
    """Accepted packets with flow context: ordinary keys, then hot keys if any."""
    keyed = with_key(packets)
    ordinary, hot = split_hot(keyed, config)
    parts = [(_with_flow(ordinary, config), False)]
    if hot is not None:
        parts.append((_with_flow_sliced(settle_sliced(hot, config), config), True))
    return parts


def flow_packets(packets: DataFrame, config: FlowConfig) -> DataFrame:
    """One row per accepted packet: ``flow_seq`` (first packet), position, direction."""
    parts = [part for part, _ in assign(packets, config)]
    columns = [*KEY, "seq", "ts_us", "flow_seq", "position", "forward", "closes", "closed_by_fin",
               "expired", "starts", "after_open"]
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    return out


def dropped_acks(packets: DataFrame, config: FlowConfig) -> DataFrame:
    """Teardown ACKs that belong to an already closed connection."""
    ordinary, hot = split_hot(with_key(packets), config)
    columns = [*KEY, "seq", "ts_us"]
    rows = _in_order(ordinary, _NEEDED)
    fields = {f.name: f for f in rows.schema.fields}
    schema = StructType([*[fields[name] for name in columns], StructField("armed_at", LongType())])
    out = rows.mapInArrow(lambda batches: walk.dropped(batches, columns, config.inactivity_us, config.grace_us), schema)
    if hot is not None:
        out = out.unionByName(settle_sliced(hot, config).filter("dropped").select(*columns, "armed_at"))
    return out


def with_config(config: FlowConfig, **changes) -> FlowConfig:
    return replace(config, **changes)
