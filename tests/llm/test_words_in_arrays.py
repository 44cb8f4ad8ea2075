"""Words of many texts as arrays, against plain Python, and how often the texts of op10 go to Python."""

import random

import numpy as np
from pyspark.sql.classic.dataframe import DataFrame

from netloom.llm import substring, suffix
from netloom.llm.words import HELD, parts, words


def test_words_lines_and_hashes():
    rng = random.Random(1)
    marks = ["a", "B", "é", "日", " ", "\n", "\t", "\x0b", "\x0c", "\r", "x" * 9, "\x00", "y" * 70, "\x85", " ", "\x1c"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", " ", "\n"]
    own = words([None if t is None else t.encode() for t in texts])
    want = [(t or "").encode().lower().split() for t in texts]
    assert np.diff(own.bounds).tolist() == [len(x) for x in want]
    known = {}
    for word, value in zip([x for y in want for x in y], own.hashes.tolist(), strict=True):
        assert known.setdefault(word, value) == value
    assert len(set(known.values())) == len(known)
    for i, text in enumerate(texts):
        lines = (text or "").encode().split(b"\n")
        for j, line in zip(range(own.texts[i], own.texts[i + 1]), lines, strict=True):
            assert own.data[own.breaks[j] + 1:own.breaks[j + 1]] == line
            assert own.lines[j + 1] - own.lines[j] == len(line.split())
    assert not len(words([]).hashes) and words([None]).bounds.tolist() == [0, 0]


def test_blocks_do_not_reach_over_texts():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 10, 49, 50, 51, 80, 300]))) for _ in range(60)]
    own = words([t.encode() for t in [*texts, " ".join(["q"] * 200)]])
    anchors, blocks, spans, edges = suffix.word_blocks(own)
    for i, (a, b) in enumerate(zip(own.bounds, own.bounds[1:])):
        anchor, block, first, last = suffix.blocks(*suffix.word_ranks(own.hashes[a:b]))
        one = slice(edges[i], edges[i + 1])
        assert anchors[one].tolist() == anchor.tolist() and blocks[one].tolist() == block.tolist()
        assert spans[one].tolist() == (first << 6 | last - first).tolist()


def test_parts_hold_every_row():
    import pyarrow as pa
    texts = ["a" * n for n in (0, HELD * 3, 5, HELD - 1, 2, 0)] + [None, "b"]
    made = list(parts(pa.RecordBatch.from_pydict({"n": list(range(8)), "text": texts}), "text"))
    assert [x for p in made for x in p.column("n").to_pylist()] == list(range(8)) and len(made) > 2


def test_texts_go_to_python_once_for_lines_and_runs(spark, monkeypatch):
    rng = random.Random(3)
    line = " ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(120))
    table = spark.createDataFrame([(1, f"a b\n{line}"), (2, f"{line} end"), (3, f"x {line[60:]}"), (4, None)], "doc_id bigint, text string")
    read, real = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda df, *a, **k: read.append(df.columns) or real(df, *a, **k))
    got = {r["doc_id"]: r["n_removed"] + r["n_spans"] for r in substring.digest(table).collect()}
    assert got[1] == got[4] == 0 and got[2] and got[3]
    # all texts, and those whose runs differ
    assert sum("text" in columns for columns in read) == 2
