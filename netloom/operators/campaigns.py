"""Campaign manifests, budgets, profile rules and ground-truth labelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from netloom.functions.constants import SOURCE_CLASSES
from netloom.operators.running import Running, running

# Hard limits and parameter bounds.
MAX_SECONDS, MAX_ACTIONS, MAX_OUTBOUND_BYTES, MAX_CONCURRENCY = 120, 120, 131_072, 8
INTEGER_BOUNDS = {   # None: the profile's own max_actions
    "count": (1, None), "concurrency": (1, MAX_CONCURRENCY), "connections": (1, None),
    "response_bytes": (0, 2048), "delay_ms": (0, 2000), "flows": (1, None), "packets_per_flow": (1, None),
    "payload_bytes": (1, 512), "canary_bytes": (1, 4096), "interval_ms": (0, 1000),
    "interval_microseconds": (1, 1_000_000),
}
FLOAT_MINIMA = {"interval_seconds": 0.0, "fragment_interval_seconds": 0.001, "duration_seconds": 0.001}
ID_PATTERN = r"^[A-Za-z0-9_-]{1,64}\z"
MODE_PATTERN = r"^[a-z][a-z0-9_]*\z"
USER_PATTERN = r"^[a-z][a-z0-9_-]{0,23}\z"
ERRORS_KEPT, DETAIL_CHARS, NOTE_CHARS = 10, 120, 200


def events_of(manifests: DataFrame) -> DataFrame:
    """One row per event, numbered in document order."""
    return manifests.select("campaign_id", "worker_id", "source_ip", F.posexplode("events").alias("event_no", "e")).select(
        "campaign_id", "worker_id", "source_ip", "event_no", "e.*")


def _given(events: DataFrame, name: str, default) -> Column:
    """A column that older events lack."""
    return F.coalesce(F.col(name), F.lit(default)) if name in events.columns else F.lit(default)


def error_text(events: DataFrame) -> Column:
    """``action: detail``, the detail cut to its first 120 characters."""
    return F.concat(F.col("action"), F.lit(": "), F.left(_given(events, "detail", ""), F.lit(DETAIL_CHARS)))


def note_text(message: Column) -> Column:
    """Errors that are no event's (fatal ones, notes) keep 200 characters."""
    return F.left(message, F.lit(NOTE_CHARS))


def utc_text(epoch: Column) -> Column:
    """Epoch seconds as UTC text in milliseconds: ``2024-01-01T00:00:00.250Z``."""
    micros = F.round(epoch * 1_000_000).cast("bigint")
    whole = F.expr("timestamp_ntz '1970-01-01'") + F.make_dt_interval(secs=(micros / 1_000_000).cast("decimal(18,6)"))
    return F.concat(F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def epoch_of(text: Column) -> Column:
    """The inverse of `utc_text`."""
    moment = F.to_timestamp_ntz(F.rtrim(text, F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS"))
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz '1970-01-01'"), moment) / 1_000_000


def first_errors(events: DataFrame, group: list[str], order: str, keep: int = ERRORS_KEPT) -> DataFrame:
    """The first ``keep`` failed actions per group, in order.

    A group may be huge, so 64 hash shares are cut to ``keep`` rows first.
    """
    failed = events.withColumn("_error", error_text(events)).filter(~F.col("success")).withColumn("_share", F.pmod(F.xxhash64(order), F.lit(64)))
    near = Window.partitionBy(*group, "_share").orderBy(order)
    some = failed.withColumn("_place", F.row_number().over(near)).filter(F.col("_place") <= keep)
    top = some.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy(order))).filter(
        F.col("_place") <= keep)
    return top.groupBy(*group).agg(F.transform(
        F.array_sort(F.collect_list(F.struct(order, F.col("_error")))), lambda e: e["_error"]).alias("errors"))


def rollup(events: DataFrame, group: list[str], order: str, fatal: Column | None = None,
           benign: bool = False) -> DataFrame:
    """Attempted, succeeded, bytes, first errors and status per campaign or worker.

    Attempted are the actions reserved, succeeded the actions that successful events completed.
    """
    fatal_seen = F.max(F.coalesce(fatal, F.lit(False))) if fatal is not None else F.lit(False)
    sums = events.groupBy(*group).agg(
        F.sum(_given(events, "reserved_actions", 1)).alias("attempted"),
        F.sum(F.when(F.col("success"), _given(events, "actions_completed", 1)).otherwise(0)).alias("succeeded"),
        F.sum("response_bytes").alias("response_bytes"), fatal_seen.alias("fatal"),
        F.bool_and("success").alias("all_successful"))
    out = sums.join(first_errors(events, group, order), group, "left").withColumn(
        "errors", F.coalesce("errors", F.array().cast("array<string>")))
    if benign:
        status = F.when(F.col("all_successful"), "completed").otherwise("partial")
    else:
        status = (F.when(F.col("fatal") | (F.col("succeeded") == 0), "failed")
                  .when(F.size("errors") > 0, "partial").otherwise("completed"))
    return out.withColumn("status", status).drop("fatal", "all_successful")


def distributed_sources(workers: DataFrame) -> DataFrame:
    """Campaigns with at least two workers from different addresses, all successful.

    ``workers``: campaign_id, worker_id, source_ip, success."""
    return workers.groupBy("campaign_id").agg(
        F.countDistinct("source_ip").alias("sources"), F.bool_and("success").alias("all_successful"),
    ).withColumn("is_distributed", (F.col("sources") >= 2) & F.col("all_successful"))


def budget_breaches(events: DataFrame, group: list[str], order: str, actions_cap: int, bytes_cap: int,
                    elapsed_cap: int, started: str, slice_rows: int = 4_000_000) -> DataFrame:
    """The first event per campaign at which a running total passes its cap.

    Actions are the reserved ones (one per event if that is not recorded), bytes the estimates of
    what was sent, time since the campaign's first event in the unit of ``started``."""
    keyed = events.withColumn("_share", F.floor(F.col(order) / slice_rows))
    totals = running(keyed, group, order, {
        "actions": Running("sum", _given(events, "reserved_actions", 1).cast("bigint")),
        "bytes": Running("sum", _given(events, "outbound_bytes", 0).cast("bigint")),
        "begun": Running("min", F.col(started), whole=True)}, "_share")
    elapsed = F.col(started) - F.col("begun")
    reason = (F.when(elapsed >= elapsed_cap, "deadline").when(F.col("actions") > actions_cap, "actions")
              .when(F.col("bytes") > bytes_cap, "bytes"))
    hit = totals.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    first = F.min_by(F.struct("reason", "actions", "bytes"), order)
    return hit.groupBy(*group).agg(F.min(order).alias(order), first.alias("f")).select(*group, order, "f.*")


def _level(low: Column, high: Column) -> Column:
    """The smallest power of two (as exponent) that a span is no longer than."""
    return F.ceil(F.log2((high - low + 1).cast("double"))).cast("int")


def label_snapshots(snapshots: DataFrame, campaigns: DataFrame, key: list[str], start: str) -> DataFrame:
    """Ground truth by time range, addresses and protocol (either direction).

    ``campaigns``: campaign_id, source_ip, target_ip, protocol (NULL = any),
    started_us, ended_us, class_label. Time is cut dyadically: a campaign lies in one or two
    cells of the level whose cells are about as long as itself, and a snapshot has one cell
    on each level that any campaign uses (64 at most). So spans of seconds and of months meet
    their snapshots in one equality join, and what meets without matching is bounded by the
    cells' length, less than twice the campaign's. Only (key, campaign) pairs are reduced; whole
    rows are joined once, at the end. Unmatched snapshots stay unlabelled; of several matches the
    earliest campaign counts.
    """
    spans = campaigns.filter(F.col("ended_us") >= F.col("started_us")).withColumn(
        "_level", _level(F.col("started_us"), F.col("ended_us")))
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())   # 64 at most
    cells = F.array_distinct(F.array(*[F.expr(f"shiftright({c}, _level)") for c in ("started_us", "ended_us")]))
    spans = spans.select(
        F.array_sort(F.array("source_ip", "target_ip")).alias("_ends"), "_level", F.explode(cells).alias("_cell"),
        F.col("started_us").alias("_from"), F.col("ended_us").alias("_to"), F.col("protocol").alias("_protocol"),
        "campaign_id", F.col("class_label").alias("ground_truth"))
    narrow = snapshots.select(*key, F.array_sort(F.array("source_ip", "destination_ip")).alias("_ends"),
                              F.col(start).cast("bigint").alias("_at"), F.col("protocol").alias("_kind"))
    chain = narrow.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn(
        "_cell", F.expr("shiftright(_at, _level)"))
    matches = chain.join(spans, ["_ends", "_level", "_cell"]).where(
        F.col("_at").between(F.col("_from"), F.col("_to"))
        & (F.col("_protocol").isNull() | (F.col("_protocol") == F.col("_kind"))))
    found = matches.groupBy(*key).agg(F.min(F.struct("_from", "campaign_id", "ground_truth")).alias("_m")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "_m.campaign_id", "_m.ground_truth")
    same = [snapshots[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    return snapshots.join(found, same, "left").drop(*[f"_k{i}" for i in range(len(key))])

def profile_violations(profiles: DataFrame) -> DataFrame:
    """(mode, rule) for every broken profile rule. Limits and parameters hold JSON text,
    so a quoted "3" is not the number 3."""
    p = F.col("parameters")
    integer = r"^-?\d+\z"

    def number(value: Column) -> Column:
        return value.try_cast("double")

    def whole(value: Column) -> Column:
        return F.when(value.rlike(integer), value.try_cast("bigint"))

    def bad(value: Column, ok: Column) -> Column:
        """Present, and not within the rule (a value of the wrong type never is)."""
        return value.isNotNull() & ~F.coalesce(ok, F.lit(False))

    mode, rules = F.col("mode"), []
    rules.append(("mode syntax", ~mode.rlike(MODE_PATTERN)))
    rules.append(("class label", ~F.coalesce(F.col("class_label").isin(SOURCE_CLASSES), F.lit(False))))
    rules.append(("scenario label", ~F.coalesce(F.col("scenario_label").startswith("lab-"), F.lit(False))))
    if "reference_label" in profiles.columns:        # JSON text: a string, null or absent
        label = F.col("reference_label")
        rules.append(("reference label", label.isNotNull() & (label != "null") & ~label.startswith('"')))
    # numbers that JSON cannot hold arrive as these words
    rules.append(("non-finite parameter", F.coalesce(F.exists(
        F.map_values(p), lambda value: F.coalesce(value.rlike(r'^"?-?(NaN|Infinity)"?\z'), F.lit(False))), F.lit(False))))
    for name, top in (("max_seconds", MAX_SECONDS), ("max_actions", MAX_ACTIONS),
                      ("max_outbound_bytes", MAX_OUTBOUND_BYTES)):
        rules.append((name, ~F.coalesce(whole(F.col(name)).between(1, top), F.lit(False))))
    for name, (low, high) in INTEGER_BOUNDS.items():
        limit = whole(F.col("max_actions")) if high is None else F.lit(high)
        rules.append((name, bad(p[name], whole(p[name]).between(F.lit(low), limit))))
    for name, low in FLOAT_MINIMA.items():
        rules.append((name, bad(p[name], number(p[name]).between(F.lit(low), number(F.col("max_seconds"))))))

    def over(name: str, top: int) -> Column:
        return F.coalesce(number(p[name]) > top, F.lit(False))

    botnet, scan, ssh = mode.startswith("botnet"), mode.startswith("scan"), mode.startswith("ssh_bruteforce")
    rules.append(("botnet delay", botnet & over("delay_ms", 500)))
    rules.append(("botnet response", botnet & over("response_bytes", 256)))
    ports = F.when(p["ports"].rlike(r"^\[-?\d+(,-?\d+)*\]\z"), F.from_json(p["ports"], "array<string>"))
    port_ok = F.forall(ports, lambda port: F.coalesce(port.try_cast("bigint").between(1, 65535), F.lit(False)))
    rules.append(("scan ports", scan & ~F.coalesce(
        (F.size(ports) > 0) & (F.size(ports) <= whole(F.col("max_actions"))) & port_ok, F.lit(False))))
    rules.append(("scan technique", scan & bad(p["technique"], p["technique"].isin('"syn"', '"connect"'))))
    rules.append(("scan timing", scan & bad(p["timing_template"], whole(p["timing_template"]).isin(2, 3, 4))))
    rules.append(("ssh count", ssh & over("count", 10)))
    user = F.regexp_extract(p["username"], r'^"(.*)"\z', 1)
    rules.append(("ssh username", ssh & bad(p["username"], user.rlike(USER_PATTERN))))
    packets = whole(p["flows"]) * whole(p["packets_per_flow"])
    udp = mode == "ddos_udp"
    rules.append(("udp packets", udp & ~F.coalesce(packets <= whole(F.col("max_actions")), F.lit(False))))
    rules.append(("udp bytes", udp & ~F.coalesce(
        packets * whole(p["payload_bytes"]) <= whole(F.col("max_outbound_bytes")), F.lit(False))))
    broken = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules]), lambda x: x.isNotNull())
    return profiles.select("mode", F.explode(broken).alias("rule"))


def id_violations(manifests: DataFrame) -> DataFrame:
    ids = F.array(*[F.when(~F.coalesce(F.col(c).rlike(ID_PATTERN), F.lit(False)), F.lit(c))
                    for c in ("campaign_id", "worker_id")])
    return manifests.select("campaign_id", "worker_id", F.explode(F.filter(ids, lambda x: x.isNotNull())).alias("bad_id"))
