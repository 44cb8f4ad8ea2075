"""Questions over the alert log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from netloom.functions import constants as K
from netloom.functions.exprs import ratio
from netloom.operators.running import Running, running

WINDOW_LIMITS = (1, 2500)


def saved_verdicts(log: DataFrame) -> DataFrame:
    """The model's saved label and confidence win over older rule-based ones."""
    out = log
    for target, saved in (("attack_type", "model_attack_type"), ("confidence", "model_confidence")):
        if saved in log.columns and target in log.columns:
            out = out.withColumn(target, F.coalesce(F.col(saved), F.col(target)))
    return out


def is_attack(label: str = "attack_type") -> Column:
    """A missing label counts as an attack."""
    return ~F.coalesce(F.col(label), F.lit("")).isin(K.NORMAL_LABELS)


def latest(log: DataFrame, limit: int = 500) -> DataFrame:
    if not WINDOW_LIMITS[0] <= limit <= WINDOW_LIMITS[1]:
        raise ValueError(f"limit must be between {WINDOW_LIMITS[0]} and {WINDOW_LIMITS[1]}")
    return log.orderBy(F.desc("id")).limit(limit)


def threat_mix(log: DataFrame) -> DataFrame:
    return saved_verdicts(log).groupBy("attack_type").agg(F.count("*").alias("rows"))


def totals(log: DataFrame) -> DataFrame:
    mix = threat_mix(log)
    return mix.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total_flows"),
                   F.coalesce(F.sum(F.when(is_attack(), F.col("rows"))), F.lit(0)).alias("total_attacks"))


def window_kpis(log: DataFrame, limit: int = 500) -> DataFrame:
    """Latency (half-even), attacks and size of the latest records."""
    return latest(saved_verdicts(log), limit).agg(
        F.coalesce(F.bround(F.avg("latency_ms")), F.lit(0)).cast("bigint").alias("avg_latency"),
        F.count_if(is_attack()).alias("window_attacks"), F.count("*").alias("window_size"))


def window_mix(log: DataFrame, limit: int = 500) -> DataFrame:
    return latest(saved_verdicts(log), limit).groupBy("attack_type").agg(F.count("*").alias("rows"))


def latest_alert(log: DataFrame, limit: int = 500) -> DataFrame:
    """The newest record of the window that is not normal traffic."""
    return latest(saved_verdicts(log), limit).filter(is_attack()).orderBy(F.desc("id")).limit(1)


def order_statistic(df: DataFrame, value: str, fraction: float) -> DataFrame:
    """sorted(values)[int(n * fraction)] without sorting rows in one task: values are
    counted, then the counts are accumulated over slices of the value range."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).count().withColumns(
        {"all": F.lit(1), "slot": F.floor("value")})
    ranks = running(counts, ["all"], "value", {
        "upto": Running("sum", F.col("count")),
        "n": Running("sum", F.col("count"), whole=True)}, "slot")
    wanted = F.floor(F.col("n") * F.lit(fraction))
    return ranks.filter((F.col("upto") - F.col("count") <= wanted) & (wanted < F.col("upto"))).select(
        F.col("value").cast("double").alias("value"))


def session_summary(log: DataFrame, latency: str = "latency_ms", limit_ms: float = K.LATENCY_GATE_MS) -> DataFrame:
    """Flows, verdict shares, mean and p95 latency and the latency gate (one row)."""
    rows = saved_verdicts(log)
    sums = rows.agg(
        F.count("*").alias("flows"), F.count_if(~is_attack()).alias("benign"),
        F.count_if(is_attack()).alias("malicious"),
        F.coalesce(F.avg(latency), F.lit(0.0)).alias("avg_latency"), F.lit(1).alias("one"))
    p95 = order_statistic(rows, latency, 0.95).select(F.col("value").alias("p95"), F.lit(1).alias("one"))
    share = F.greatest(F.col("flows"), F.lit(1))
    return sums.join(p95, "one", "left").select(
        "flows", "benign", "malicious",
        (ratio(F.col("benign"), share) * 100).alias("benign_pct"),
        (ratio(F.col("malicious"), share) * 100).alias("malicious_pct"),
        "avg_latency", F.coalesce("p95", F.lit(0.0)).alias("p95_latency"),
        F.when(F.col("p95").isNull(), "NOT MEASURED").when(F.col("p95") < limit_ms, "PASS")
        .otherwise("FAIL").alias("latency_status"))


def session_counters(packets: DataFrame, errors: DataFrame, error_key: list[str]) -> DataFrame:
    """Packets read, packets dropped (rate limits replace drops: none) and rows that
    could not be classified; ``errors`` is the table of contract violations."""
    read = packets.agg(F.count("*").alias("packets_sniffed"), F.lit(1).alias("one"))
    bad = errors.select(*error_key).distinct().agg(F.count("*").alias("classification_errors"), F.lit(1).alias("one"))
    return read.join(bad, "one").select(
        "packets_sniffed", F.lit(0).cast("bigint").alias("packets_dropped"), "classification_errors")


def attacks_by_type(log: DataFrame) -> DataFrame:
    return saved_verdicts(log).filter(is_attack()).groupBy("attack_type").agg(F.count("*").alias("rows"))


def search(log: DataFrame, text: str | None = None, classes: list[str] | None = None,
           latency: tuple[float, float] | None = None) -> DataFrame:
    """Filter records by text (any of the address or label columns), class and latency range."""
    out = log
    if text:
        fields = [c for c in ("source_ip", "destination_ip", "protocol", "attack_type") if c in log.columns]
        blob = F.lower(F.concat_ws(" ", *fields))
        out = out.filter(blob.contains(text.lower()))
    if classes is not None:
        out = out.filter(F.col("attack_type").isin(classes))
    if latency is not None:
        out = out.filter(F.col("latency_ms").between(*latency))
    return out


def sort_records(log: DataFrame, column: str, descending: bool = False) -> DataFrame:
    first = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_first()
    return log.orderBy(first, F.desc("id"))


def related_records(log: DataFrame, record_id: int) -> DataFrame:
    """Other records from the same source as one record."""
    source = log.filter(F.col("id") == record_id).select("source_ip").limit(1)
    return log.filter(F.col("id") != record_id).join(F.broadcast(source), "source_ip", "left_semi")


def related_counts(log: DataFrame) -> DataFrame:
    """Records and distinct labels per source (counts only: a source may be huge)."""
    return saved_verdicts(log).groupBy("source_ip").agg(
        F.count("*").alias("records"), F.count_if(is_attack()).alias("attacks"))
