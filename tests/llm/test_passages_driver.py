"""What op10 sends to the driver does not follow the rows: bitmaps in place of broadcasts, with the same result."""

import random

from pyspark.sql import functions as F

from netloom.llm import marks, near, substring


def table(spark):
    rng = random.Random(8)
    line = lambda n: " ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(n))
    lines, passages = [line(30) for _ in range(6)], [line(60) for _ in range(4)]
    rows = [(1, f"{lines[0]}\n{lines[1]}"), (1, f"{lines[0]}\n{lines[0]}"), (None, lines[0]), (None, None), (2, ""), (2, ""), (3, None)]
    for i in range(4, 60):
        words = rng.choice(lines).split()
        words[rng.randrange(30)] = "x"
        rows.append((i, "\n".join([rng.choice(lines), " ".join(words), f"{line(20)} {rng.choice(passages)} {line(9)}", f"{line(45)}"])))
    return spark.createDataFrame([*rows, rows[9], rows[0]], "doc_id bigint, text string").repartition(3)


def test_small_and_large_tables_give_the_same(spark, monkeypatch):
    docs = table(spark)
    small = sorted(map(str, substring.digest(docs).collect()))
    made, sent, member = [], [], marks.member
    monkeypatch.setattr(marks, "member", lambda *a: made.append(a[1:]) or member(*a))
    monkeypatch.setattr(marks, "FEW", 0)
    monkeypatch.setattr(substring, "FEW_BYTES", 0)
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.columns) or df)
    assert sorted(map(str, substring.digest(docs).collect())) == small
    assert made == [("node",), ("doc_id", "no"), ("__id", "__text_id")] and not sent


def test_lists_of_many_passages_are_not_broadcast(spark, monkeypatch):
    sent, real = [], F.broadcast
    docs = table(spark)
    monkeypatch.setattr(substring, "FEW_BYTES", 1000)
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(df.columns) or real(df))
    got = substring.without_repeats(docs).where("size(cut) > 0").count()
    assert got > 40 and not any("__words" in columns or "anchor" in columns for columns in sent)


def test_member_misses_no_row(spark):
    wanted = spark.range(0, 3000, 3).selectExpr("id", "cast(id as string) as s")
    rows = spark.range(20_000).selectExpr("id", "cast(id as string) as s")
    found = {r["id"] for r in rows.where(marks.member(wanted, "id", "s")("id", "s")).collect()}
    assert set(range(0, 3000, 3)) <= found and len(found) < 4000
    assert not rows.where(marks.member(wanted.limit(0), "id")("id")).count()


def test_shared_keys_are_those_of_several_paragraphs(spark):
    rows = substring.sketched(table(spark)).localCheckpoint()
    keys = rows.select(F.explode(F.arrays_zip("nodes", "keys")).alias("p")).select(F.col("p.nodes").alias("node"), F.explode("p.keys").alias("key"))
    some = {tuple(r) for r in substring.shared_keys(rows).select("key", "node").collect()}
    several = keys.groupBy("key").count().where("count > 1")
    assert {tuple(r) for r in keys.join(several, "key").select("key", "node").collect()} <= some
    assert len(some) < keys.distinct().count() and near.tune(80, 3, 2e-4) == 12
