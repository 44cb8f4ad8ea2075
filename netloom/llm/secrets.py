"""Secret scans: certain patterns, and weak parts that count only together.

Certain spans (``assign``, ``access``, ``hex``) come from fixed patterns. Weak parts are identifiers
(``user = ...``), opaque values and endpoints; one alone proves nothing. They are joined by interval:
parts of one document that lie in the same scope, ``reach`` characters or less apart, are linked, and
a weak part is reported only when

* an identifier has a secret (certain or opaque) and an endpoint in reach,
* an opaque value has an identifier or access key in reach, and
* an endpoint has both an identifier or access key and a secret in reach.

Positions are code points, ends are exclusive. Scopes are buckets of ``reach`` characters. Parts have no
longest length: each lies in every bucket it covers, and the others meet it there or in a bucket next to
it. A bucket holds few parts, since its length bounds them, so no document and no key gives a large group.
Everything is column expressions and joins.

Edge cases: a NULL or empty text has no spans and the digest of the empty string; NULL ids are kept;
rows that agree in id and text are scanned each for itself and share their links; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from netloom.llm.common import ID, LAST_ID, TEXT_ID, keyed
from netloom.session import cut_lineage

# The patterns of the certain kinds. Letters of the keywords count in either case; the
# classes are written out because engines differ in how they fold letters outside ASCII.
KEYWORD = ("[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
           "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
ASSIGN = rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"      # a shorter run fails as a whole, so the length may stand in the pattern
HEX = r"[0-9a-f]{24,}+"            # likewise; the possessive end keeps a run from being cut
# Weak parts.
LOGIN = r"""\b(?:user|username|login|account|client_id|key_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}+"""
OPAQUE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+(?![A-Za-z0-9+/_=-])"  # with a digit and both cases
ENDPOINT = r"""(?:https?|ftp|s3|jdbc:[a-z]+|[a-z]+ql|amqps?|rediss?)://[^\x20\x09-\x0D"'<>]{4,}+"""
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "login", "opaque", "endpoint")


REACH = 200
BROADCAST_HITS = 100_000


def _lengths(kind: str, pattern: str, ok: Column | None = None) -> Column:
    """Array of struct(no, i, gap, len, ok): matches of a pattern with the lengths of the text before each."""
    found = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(
        F.slice(F.split(F.col("text"), pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("hit"))
    no = KINDS.index(kind)
    flag = (lambda hit: F.lit(True)) if ok is None else ok
    spans = F.transform(zipped, lambda x, i: F.struct(
        F.lit(no).alias("no"), i.alias("i"), F.length(x["gap"]).alias("gap"),
        F.length(x["hit"]).alias("len"), flag(x["hit"]).alias("ok")))
    # A text without a match is not split; most have none.
    return F.when(F.regexp_like(F.col("text"), F.lit(pattern)), spans).otherwise(F.array().cast(
        "array<struct<no:int,i:int,gap:int,len:int,ok:boolean>>"))


def found_parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, parts): a number for each input row, and row, kind number, start and end of each match."""
    mixed = lambda hit: hit.rlike("[0-9]") & hit.rlike("[A-Z]") & hit.rlike("[a-z]")
    long_value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 6
    lists = F.concat(_lengths("assign", ASSIGN, long_value), _lengths("access", ACCESS), _lengths("hex", HEX),
                     _lengths("login", LOGIN), _lengths("opaque", OPAQUE, mixed), _lengths("endpoint", ENDPOINT))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut_lineage(docs.select("doc_id", text.alias("text")).select(
        "doc_id", F.xxhash64("text").alias("text_id"), lists.alias("lists"),
        F.monotonically_increasing_id().alias("row")))
    hits = rows.select("row", F.explode("lists").alias("x")).select("row", "x.*")
    upto = Window.partitionBy("row", "no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    parts = (hits.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).where("ok")
             .select("row", "no", (F.col("end") - F.col("len")).alias("start"), "end"))
    return rows.select("row", "doc_id", "text_id"), parts


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak parts that have their complements in reach and touch no certain span."""
    identifier, secret, endpoint = (F.col("p.no").isin([KINDS.index(k) for k in kinds]) for kinds in (
        ("access", "login"), ("assign", "hex", "opaque"), ("endpoint",)))
    # Parts within reach have points in one bucket, once one of them is widened by reach to either side.
    buckets = lambda more: F.explode(F.sequence(
        F.floor((F.col("start") - more) / reach), F.floor((F.col("end") + more) / reach)))
    weak = parts.where(F.col("no") >= len(BASE)).withColumn("bucket", buckets(0)).alias("c")
    near = parts.withColumn("bucket", buckets(reach)).alias("p")
    gap = F.greatest(F.col("p.start") - F.col("c.end"), F.col("c.start") - F.col("p.end"))
    met = (weak.join(near, (F.col("c.row") == F.col("p.row")) & (F.col("c.bucket") == F.col("p.bucket")) & (gap <= reach))
           .groupBy("c.row", "c.no", "c.start", "c.end")
           .agg(F.max(identifier).alias("i"), F.max(secret).alias("s"), F.max(endpoint).alias("e"),
                F.max((F.col("p.no") < len(BASE)) & (gap < 0)).alias("taken")))
    login, opaque = (F.col("no") == KINDS.index(k) for k in ("login", "opaque"))
    return met.where(~F.col("taken")).where(
        F.when(login, F.col("s") & F.col("e")).when(opaque, F.col("i")).otherwise(F.col("i") & F.col("s"))
    ).select("row", "no", "start", "end")


def scan_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, text_id (a hash) and ``found``: all spans as an array of struct(start, no, end)."""
    rows, parts = found_parts(docs)
    spans = parts.where(F.col("no") < len(BASE)).unionByName(linked(parts, reach))
    lists = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "no", "end"))).alias("found"))
    empty = F.array().cast("array<struct<start:bigint,no:int,end:bigint>>")
    return rows.join(lists, "row", "left").select("doc_id", "text_id", F.coalesce("found", empty).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """The counts, the digest of the certain spans and the text of all spans."""
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda x: F.concat_ws(":", F.element_at(names, x["no"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("found", lambda x: x["no"] < len(BASE))
    count = lambda no: F.size(F.filter("found", lambda x: x["no"] == no)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.concat_ws(",", F.transform(base, text)).cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("found", text)).alias("spans"))


def masked(docs: DataFrame, mark: str = "[secret]", reach: int = REACH) -> DataFrame:
    """``docs`` with every certain span and every linked weak span replaced; same rows and columns.

    Only texts with a span are rebuilt. A column ``n_chars`` follows the text.
    """
    key = [ID, TEXT_ID]
    hits = cut_lineage(scan_secrets(docs, reach).where(F.size("found") > 0).select(
        F.coalesce(F.col("doc_id"), F.lit(LAST_ID)).alias(ID), F.col("text_id").alias(TEXT_ID),
        F.col("found").alias("__found")).dropDuplicates(key))
    known = F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(done, x):  # text up to the span, then the mark, unless the span begins inside the last one
        fresh = x["start"] >= done["at"]
        gap = F.substring(F.col("text"), (done["at"] + 1).cast("int"), (x["start"] - done["at"]).cast("int"))
        return F.struct(F.greatest(done["at"], x["end"]).alias("at"),
                        F.when(fresh, F.concat(done["out"], gap, F.lit(mark))).otherwise(done["out"]).alias("out"))
    whole = F.aggregate("__found", start, step, lambda d: F.concat(
        d["out"], F.substring(F.col("text"), (d["at"] + 1).cast("int"), F.length("text"))))
    changed = F.col("__found").isNotNull()
    out = keyed(docs).join(known, key, "left").withColumn("text", F.when(changed, whole).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
