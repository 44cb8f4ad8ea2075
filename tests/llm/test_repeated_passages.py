"""Passages of 50 words that keep to no line, against brute force over runs of words."""

import random

from netloom.llm import substring


def own(rng, n):
    return " ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(n))


def test_passages_inside_long_lines_and_over_short_ones(spark):
    rng = random.Random(5)
    passage = own(rng, 55)
    words = passage.split(" ")
    short = "\n".join(" ".join(words[k:k + 6]) for k in range(0, 55, 6))
    a, b = own(rng, 100), own(rng, 80)
    rows = [(1, f"{a} {passage} {b}"), (2, f"é {own(rng, 90)} {passage.upper()}x end"), (3, f"first line\n{short}\nlast line"),
            (4, " ".join(words[:49]) + " " + own(rng, 70)), (4, f"{own(rng, 60)} {' '.join(words[5:])} rest"),
            (None, f"begin {passage}"), (5, own(rng, 200)), (6, None), (7, "")]
    first = {}
    for i, text in sorted(((2 ** 63 - 1 if i is None else i), t or "") for i, t in rows):
        w = text.lower().split()
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k:k + 50]), i)
    table = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, n int").repartition(3)
    got = {r["n"]: r for r in substring.without_repeats(table).collect()}
    for n, (i, text) in enumerate(rows):
        left = (got[n]["text"] or "").split()
        w = (text or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(x.lower() for x in w[k:k + 50])] < (2 ** 63 - 1 if i is None else i):
                gone[k:k + 50] = [True] * 50
        assert left == [x for x, y in zip(w, gone) if not y], n
    assert got[2]["text"] == "first line\nlast line" and not got[2]["removed"] and len(got[2]["cut"]) == 10
    assert got[0]["text"] == rows[0][1] and got[6]["text"] == rows[6][1] and got[7]["text"] is None and got[5]["text"] == "begin "
    sizes = {(r["n_kept_bytes"], r["n_bytes"], r["n_removed_bytes"], r["n_spans"]) for r in substring.digest(table).collect()}
    cut = len("\n".join(rows[2][1].split("\n")[1:-1])) + 1
    assert (20, 20 + cut, cut, 10) in sizes


def test_what_is_left_beside_removed_lines():
    line, tail = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(60))
    text = f"x {tail}\n{line}\ny"
    assert substring._left(text, [1], [(1, 51), (11, 91)]) == ("x \ny", [(2, 2 + len(tail))])
    # twenty words beside a removed line are no passage
    assert substring._left(text, [1], [(41, 91)]) == (f"x {tail}\ny", [])
