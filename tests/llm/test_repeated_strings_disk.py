"""Disk and rows of the removal of repeated 50-byte strings, on texts that share many short strings."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa

from netloom.llm import marks, suffix
from netloom.session import cut_lineage, shared_folder


def on_disk(spark):
    """Bytes of the shared folder and of the session's shuffle files."""
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.stat().st_size for folder in [shared_folder(spark), *local] for f in Path(folder).rglob("*") if f.is_file())


def test_disk_stays_within_four_times_the_text(spark):
    rng = random.Random(29)
    # sentences of about 40 bytes: anchors of 24 bytes meet in many texts, strings of 50 seldom
    phrases = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(40)) for _ in range(3000)]
    passages = [" ".join(rng.choice(phrases) for _ in range(6)) for _ in range(40)]
    rows = []
    for i in range(1200):
        parts = [rng.choice(phrases) + str(rng.randrange(10 ** 6)) for _ in range(60)]
        parts.insert(rng.randrange(60), rng.choice(passages))
        rows.append((i, " ".join(parts)))
    size = sum(len(text) for _, text in rows)
    docs = cut_lineage(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    before = on_disk(spark)
    got = suffix.deduplicated(docs).collect()
    used = on_disk(spark) - before
    assert used < 4 * size, used / size
    assert sum(r["n_removed"] > 200 for r in got) > 1000


def test_bitmaps_have_all_numbers_that_rows_share(spark):
    own = {i: [i * 1000 + k for k in range(200)] + [7 * k + 10 ** 9 for k in range(i % 5)] for i in range(40)}
    table = spark.createDataFrame([(i, v) for i, v in own.items()], "id bigint, numbers array<bigint>").repartition(3)

    def numbers(given: pa.RecordBatch):
        for row in given.column("numbers").to_pylist():
            yield np.array(row, np.uint64)
    once = [i * 1000 + k for i in range(40) for k in range(200)]
    for copies, all_ in ((1, {n for v in own.values() for n in v}), (2, {10 ** 9, 10 ** 9 + 7, 10 ** 9 + 14, 10 ** 9 + 21})):
        has = marks.reader(marks.marked(table, lambda: numbers, (16, 8), copies))
        assert has(np.array(sorted(all_), np.uint64)).all()
        assert copies == 1 or has(np.array(once, np.uint64)).mean() < 0.01
    nothing = marks.reader(marks.marked(table.where("id < 0"), lambda: numbers, (16, 8), 2))
    assert not nothing(np.arange(1000, dtype=np.uint64)).any()
