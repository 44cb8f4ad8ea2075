"""The ten text operators against brute force, with the odd rows every operator must take."""

import hashlib
import itertools
import json
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from netloom.llm import (bpe, components, decontaminate, html, near, neardup, quality, secrets, sharding, substring,
                         suffix, toxicity)
from netloom.llm.queries import tokenizer

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, node int, removed int, found int, item_id int"
EDGES = [None, "", " ", "\n\n\t", "é", "a", "word", "x" * 3000, "ab " * 2000, "日本語 テキスト next", "<|endoftext|>'s  \r\n"]


def frame(spark, rows):
    """Rows of (doc_id, text) as a table with further columns, some named like the operators' own."""
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), "x", 1, 2, 3, 4) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(EDGES)] + [(1, ""), (6, "word"), (None, "word"), (None, None), (6, "other text"), (6, "word")]
    return rows, frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


WORDS = [a + b for a in "ka lo mi nu re sa to vi".split() for b in "ba ce di fo gu ha jo ke".split()]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def edited(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


def components_of(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


# ---- 1 ---------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer())


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(bpe.vocabulary(tokenizer()))


def test_tokens_equal_the_library(merges, library):
    rng, encoder = random.Random(1), bpe.Encoder(merges)
    letters = list("abcdeiou ABC'\n\t\x1c\x85é日👍٢½-.!") + ["'ll", "  ", "<|endoftext|>"]
    texts = [t or "" for t in EDGES] + ["".join(rng.choices(letters, k=rng.choice([1, 5, 40, 300]))) for _ in range(400)]
    for text in texts:
        ids = encoder.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:80]
        decoder = bpe.Decoder(merges)
        assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == text


def test_streamed_pieces_equal_whole_ones(merges, library):
    rng = random.Random(2)
    for letters in ("ab", "a", "aeiou", "thein", "abcdefghijklmnopqrstuvwxyz"):
        text = "".join(rng.choices(letters, k=20_000))
        data = text.encode()
        ids = list(merges.stream(data[i:i + 777] for i in range(0, len(data), 777)))
        assert ids == library.encode(text, add_special_tokens=False).ids
    assert 0 < merges.lookahead < 5_000


def test_encoded_rows(spark, odd, empty, library):
    rows, df = odd
    got = bpe.encode_digest(df, tokenizer()).collect()
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode(empty, tokenizer()).count() == 0


# ---- 2 ---------------------------------------------------------------------------------

def test_repeated_windows():
    rng = random.Random(3)
    for _ in range(300):
        words = rng.choices("abc", k=rng.randrange(60)) if rng.random() < .5 else rng.choices(WORDS, k=30) * rng.randrange(3)
        runs = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        hit = {j for i in range(len(words) - 7) if runs[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
        assert quality.repeated_words(words) == len(hit)


def test_quality_rules(spark, odd, empty, tmp_path):
    rng = random.Random(4)
    good = [(i, ". ".join(prose(rng, 12) for _ in range(5))) for i in range(300)]
    bad = [(300, " ".join(w + "###" for w in prose(rng, 60).split())), (301, " ".join(w for w in prose(rng, 12).split() for _ in range(5))),
           (302, "\n".join([prose(rng, 6)] * 3 + [prose(rng, 6) for _ in range(1)]))]
    df = frame(spark, good + bad)
    got = {r["doc_id"]: r for r in quality.quality(df).collect()}
    assert all(got[i]["kept"] for i, _ in good)
    assert "symbols" in got[300]["failed"] and "stutter" in got[301]["failed"] and not got[302]["kept"]
    df.select("doc_id", "text", "lang", "source").coalesce(1).write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    names = [d[0] for d in db.execute(quality.oracle_sql()).description]
    want = {r[0]: r for r in db.execute(quality.oracle_sql()).fetchall()}
    assert {i: tuple(r[n] for n in names) for i, r in got.items()} == want
    strange = quality.quality(odd[1]).collect()
    assert len(strange) == len(odd[0]) and all(r["base_failed"] for r in strange if not r["n_words"])
    assert quality.quality(empty).count() == 0


# ---- 3 ---------------------------------------------------------------------------------

def test_main_text():
    page = ('<html><head><title>no</title><style>p{}</style></head><body><header>Top</header><nav>Menu</nav>'
            '<div class="cookie-notice">c</div><article><h1>T &amp; x</h1><!-- <p>no --><p>a<b>b</b>&nbsp; c<p>d<br>e'
            '<script>"</p>"</script><aside>side</aside><div id="comments"><p>hm</p></div><form>f</form>&lt;i&gt;</article>'
            '<footer>end</footer>')
    assert html.main_text(page) == "T & x ab c d e <i>"
    assert html.main_text("<article><p>open <b>end") == "open end"
    assert html.main_text("") == "" and html.main_text("plain") == "plain"


def test_classes_lose_no_article():
    page = '<html class="search"><body class="{}"><div class="sidebar">side</div><div id="page" class="{}"><{} class="{}">a<p>b</{}></div></body>'
    for word in ("has-sidebar", "no-sidebar", "sidebar", "comments-open", "comments", "post related", "search"):
        for tag in ("article", "main"):
            assert html.main_text(page.format(word, word, tag, word, tag)) == "a b", (word, tag)
    assert html.main_text('<article><p class="related">a <span class="search">b</span><section class="social">c</section>'
                          '<div class="ad">no</div><div class="ad-free">d</div></article>') == "a b c d"
    assert html.main_text("<article>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math>, so</article>") == "if x=2, so"
    assert html.main_text('<body class="search"><div class="menu">no</div>all') == "all"


def test_common_lines_is_longest():
    rng = random.Random(5)
    for _ in range(800):
        a, b = (rng.choices("abcdef", k=rng.randrange(12)) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = sorted(html.common_lines(a, b))
        rest = iter(b)
        assert len(found) == best[-1][-1] and all(any(x == y for y in rest) for x in (a[i] for i in found))


def test_extraction_by_neighbours(spark):
    frame_of = lambda body: f"<body><div>Site name</div>{body}<div>All of it</div></body>"
    rows = [(1, "http://h.example/a/1", frame_of("<p>one")), (2, "http://h.example/a/2", frame_of("<p>two<p>more")),
            (3, "http://h.example/b", frame_of("<article>three</article>")), (4, None, "<p>alone"), (5, "http://o.example/", None),
            (6, "http://h.example/a/1", frame_of("<p>one")), (None, "bad", "<main>m</main>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("key", F.lit(1)).withColumn("path", F.lit(2))
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html.extract(df).collect()), key=str)
    assert [g[1] for g in got] == ["one", "two more", "three", "alone", "", "one", "m"]
    assert all(len(t) == n for _, t, n in got)
    assert html.extract(df.limit(0)).count() == 0


def test_neighbours_cross_ranges(spark):
    rows = [("h" if i < 40 else "k", f"/{i:03}", f"key{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "host string, path string, key string").repartition(5)
    got = {r["key"]: ((r["before"] or {"key": None})["key"], (r["after"] or {"key": None})["key"]) for r in html.neighbours(df).collect()}
    assert got == {f"key{i}": (None if i in (0, 40) else f"key{i - 1}", None if i in (39, 59) else f"key{i + 1}") for i in range(60)}


# ---- 4 ---------------------------------------------------------------------------------

def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(30)] + [(rng.randrange(40, 140), rng.randrange(40, 140)) for _ in range(60)]
    df = spark.createDataFrame([(b, a) for a, b in links], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    want = components_of(140, links)
    assert got == {i: want[i] for i in {x for p in links if p[0] != p[1] for x in p}}


def test_sketch_estimates_similarity():
    import numpy as np
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2 ** 63, 900).astype(np.uint64)
    a, b = np.unique(x[:800]), np.unique(x[100:])
    size = 512
    got = near.sketch([a, b, x[:1]], size)
    assert (got != np.iinfo(np.uint64).max).all()
    assert abs((got[0] == got[1]).mean() - 700 / 900) < 5 * (0.25 / size) ** 0.5


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def similar(sets, percent):
    out = []
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                out.append((j, i))
    return out


def test_document_classes(spark, odd, empty):
    rng = random.Random(7)
    bases = [prose(rng, 120) for _ in range(4)]
    rows = [(i, edited(rng, rng.choice(bases), rng.choice([0, .01, .03, .06]))) for i in range(80)] + [(80 + i, prose(rng, 50)) for i in range(10)]
    rows += [(90 + i, t) for i, t in enumerate(EDGES)]
    sets = [shingles(t, 3) for _, t in rows]
    want = components_of(len(rows), similar(sets, 85))
    got = {r["doc_id"]: r for r in neardup.document_classes(frame(spark, rows), 3, 85).collect()}
    assert [(got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i, _ in rows] == [
        (len(s), want[i], want[i] == i) for (i, _), s in zip(rows, sets)]
    left = neardup.first_of_each(frame(spark, rows), 3, 85)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(want))
    strange = neardup.document_classes(odd[1], 3, 85).collect()
    assert len(strange) == len(odd[0])
    kept = neardup.first_of_each(odd[1], 3, 85).collect()
    assert Counter(r["text"] for r in kept)["word"] == 1 and len(kept[0]) == 10
    assert neardup.document_classes(empty).count() == 0 and neardup.first_of_each(empty).count() == 0


# ---- 5 ---------------------------------------------------------------------------------

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_finds_all_within_distance():
    rng = random.Random(8)
    terms = ["".join(rng.choices("abcd", k=rng.randrange(3, 12))) for _ in range(40)]
    lexicon = toxicity.Lexicon(terms, ())
    for _ in range(3000):
        word = "".join(rng.choices("abcd", k=rng.randrange(2, 13)))
        want = any(distance(word, t) <= lexicon.errors(len(t)) for t in terms if lexicon.errors(len(t)))
        assert lexicon.near(word) == want or any(word == t for t in terms)


def test_every_misspelling_within_distance_has_a_kind():
    rng, letters = random.Random(15), "abcdefghijklmnop"
    terms = ["".join(rng.choices(letters, k=n)) for n in [*range(3, 16), 24, 40]]
    for term in terms:
        lexicon = toxicity.Lexicon([term], ())     # alone, so that no part of another term fits
        for _ in range(400):
            word = list(term)
            for _ in range(rng.choice((1, 2, 2, 3))):
                at = rng.randrange(len(word) + 1)
                word[at:at + rng.randrange(2)] = rng.choice(["", *letters])
            word = "".join(word)
            near = distance(word, term) <= lexicon.errors(len(term))
            assert lexicon.kind(word) == (1 if word == term else 2 if near else 0), (term, word)


def test_quotation_is_told_from_abuse():
    lexicon = toxicity.Lexicon(["idiot"], ["grob"])
    direct, quoted, told = (toxicity.features(lexicon, t) for t in (
        "you are an idiot and an 1diot", 'he heard "what an idiot" there', "she said the word idiot"))
    assert direct[0] == 1 and direct[3] == 0 and quoted[0] == 0 == told[0] and quoted[3] == 1 == told[3]
    assert toxicity.features(lexicon, "an idoit idioot grobian")[5] == 1
    assert toxicity.features(lexicon, "") == [0.0] * 9


def test_toxicity_on_held_out_rows(spark, odd, empty):
    rng = random.Random(9)
    slurs = ["zuckbat", "morlup", "vexgrim"]
    rows, labels = [], []
    for i in range(400):
        toxic, words = i % 5 == 0, prose(rng, 80).split()
        for _ in range(4 if toxic else 0):
            words[rng.randrange(80)] = rng.choice(slurs)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    table = spark.createDataFrame(labels + [(None, 1, 1), (5000, 0, None)], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, rows + [(1000, "you vexgrimm"), (1001, None), (None, "zuckbat zuckbat morlup")])
    got = toxicity.toxicity(docs, table).collect()
    by_id = {r["doc_id"]: r for r in got}
    import zlib
    for i, _, toxic in labels:
        assert by_id[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and by_id[i]["predicted"] == toxic
    assert by_id[None]["predicted"] == 1 and by_id[1001]["predicted"] == 0 and 0 <= by_id[1001]["score"] <= 1
    assert {r["doc_id"] for r in toxicity.without_toxic(docs, table).collect()} >= {i for i, _, t in labels if not t}
    nothing = toxicity.toxicity(odd[1], table.limit(0)).collect()
    assert len(nothing) == len(odd[0]) and {r["score"] for r in nothing} == {0.0}
    assert toxicity.toxicity(empty, table).count() == 0


# ---- 6 ---------------------------------------------------------------------------------

def test_contaminated(spark, odd, empty):
    rng = random.Random(10)
    items = [prose(rng, n) for n in (40, 25, 18, 9, 6, 3)]
    swap = lambda t, at: " ".join("zzz" if i in at else w for i, w in enumerate(t.split()))
    rows = [(0, prose(rng, 50)), (1, f"{prose(rng, 9)}. {items[0].upper()}, {prose(rng, 5)}"), (2, swap(items[1], {3, 11})),
            (3, swap(items[2], {0, 4, 9, 14})), (4, f"so {items[3]}"), (5, items[4]), (6, items[5] + " x y"),
            (7, " ".join(items[0].split()[:21])), (8, " ".join(items[0].split()[:12])), (9, None)]
    bench = spark.createDataFrame(list(enumerate(items)) + [(9, None), (None, items[1])], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want = set()
    for item, text in [*enumerate(items), (None, items[1])]:
        words = tokens(text)
        window = min(20, len(words))
        for doc, body in rows:
            there = tokens(body)
            for shift in range(-len(words), len(there)):
                same = [0 <= k + shift < len(there) and there[k + shift] == w for k, w in enumerate(words)]
                if len(words) >= 5 and any(5 * sum(same[k:k + window]) >= 4 * window and 0 <= k + shift <= len(there) - window
                                           for k in range(len(words) - window + 1)):
                    want.add((doc, item))
    assert got == want and {d for d, _ in got} == {1, 2, 4, 5, 7}
    left = decontaminate.without_benchmark(frame(spark, rows), bench)
    assert {r["doc_id"] for r in left.collect()} == {0, 3, 6, 8, 9} and "found" in left.columns
    assert decontaminate.contaminated(odd[1], bench).count() == 0
    assert decontaminate.without_benchmark(odd[1], bench.limit(0)).count() == len(odd[0])
    assert decontaminate.contaminated(empty, bench).count() == 0


def allowed(n):
    """How many tokens of a window of n may be replaced."""
    return next(m for m in range(n, -1, -1) if 100 * (n - m) >= decontaminate.SHARE * n)


def test_masks_lose_no_placement():
    for n in range(decontaminate.SHORTEST, decontaminate.WINDOW + 1):
        masks = decontaminate.MASKS[max(k for k in decontaminate.MASKS if k <= n)]
        places = [sum(1 << i + o for o in mask) for mask in masks for i in range(n - mask[-1])]
        for replaced in itertools.combinations(range(n), allowed(n)):
            spoilt = sum(1 << i for i in replaced)
            assert any(not p & spoilt for p in places), (n, replaced)


def test_replaced_tokens_anywhere(spark):
    rng = random.Random(14)
    items, rows = [], []
    for n in [*range(5, 21), 33] * 3:
        words = [f"{w}{len(items)}" for w in prose(rng, n).split()]
        window = min(n, decontaminate.WINDOW)
        at = rng.randrange(n - window + 1)
        for more in (0, 1):                        # as many as allowed, and one more
            gone = rng.sample(range(at, at + window), allowed(window) + more)
            copy = ["zzz" if i in gone else w for i, w in enumerate(words)][at:at + window]
            rows.append((2 * len(items) + more, f"{prose(rng, 7)} {' '.join(copy)} {prose(rng, 7)}"))
        items.append((len(items), " ".join(words)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    assert got == {(2 * i, i) for i, _ in items}


# ---- 7 ---------------------------------------------------------------------------------

def test_shards(spark, odd, empty, tmp_path):
    import zlib
    df = frame(spark, [(i, f"t{i}" * (i % 7)) for i in range(3000)])
    rows = sharding.shard_rows(df).collect()
    df.select("doc_id", "text").coalesce(1).write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert sorted((r["doc_id"], r["size"], r["shard"], r["grown_shard"]) for r in rows) == sorted(
        db.execute(sharding.least_shard_sql()).fetchall())
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
        assert r["text_crc32"] == zlib.crc32((f"t{r['doc_id']}" * (r["doc_id"] % 7)).encode())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) == set(range(16))
    weighted = Counter(r["shard"] for r in sharding.shard_rows(df, weights=[3, 1, 0]).collect())
    assert 0.70 < weighted[0] / 3000 < 0.80 and 2 not in weighted
    strange = sharding.shard_rows(odd[1]).collect()
    assert len(strange) == len(odd[0]) and len({(r["shard"], r["slot"]) for r in strange}) == len(odd[0])
    assert sharding.shard_rows(empty).count() == 0


# ---- 8 ---------------------------------------------------------------------------------

def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_spans(spark, odd, empty):
    rng = random.Random(11)
    parts = ["password", "PassWd=", "secret: ", "token", "api_key", "APIKEY", "=", ":", "'", '"', " ", "é", "\n", "abc", "abcdef12", "x=y",
             "AKIA", "AKIA" + "Z9" * 9, "0123456789abcdef" * 2, "deadbeef", "ſecret=abcdefg", "."]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(25)))) for i in range(400)] + [(400 + i, t) for i, t in odd[0]  if i is not None]
    got = secrets.digest(secrets.scan_secrets(frame(spark, rows))).collect()
    want = []
    for i, text in rows:
        spans = base_spans(text or "")
        n = Counter(k for _, k, _ in spans)
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        want.append((i, n[0], n[1], n[2], hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert secrets.scan_secrets(empty).count() == 0 and secrets.masked(odd[1]).count() == len(odd[0])


def test_weak_parts_need_their_complements(spark):
    login, opaque, place = "user=alice", "Zx9Kq2Lm7Rt4Wp8Yb3Vn", "https://db.example.net/x"
    key = "AKIA" + "Q7" * 8
    texts = [f"{login} then {opaque} at {place}", f"{login} only", f"{opaque} only", f"{place} only", f"{key} {opaque}",
             f"{login}" + " far" * 200 + f" {opaque} {place}", f"{login} {place}"]
    got = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.scan_secrets(frame(spark, list(enumerate(texts))))).collect()}
    kinds = {i: [s.split(":")[0] for s in v.split(",") if s] for i, v in got.items()}
    assert kinds == {0: ["login", "opaque", "endpoint"], 1: [], 2: [], 3: [], 4: ["access", "opaque"], 5: [], 6: []}
    left = {r["doc_id"]: r for r in secrets.masked(frame(spark, [*enumerate(texts), (9, "é token = abcdef1 b"), (9, None)])).collect() if r["text"]}
    assert left[0]["text"] == "[secret] then [secret] at [secret]" and left[3]["text"] == texts[3]
    assert left[9]["text"] == "é [secret] b" and left[9]["n_chars"] == 12 and left[9]["found"] == 3


def test_weak_parts_of_any_length(spark):
    rng = random.Random(16)
    opaque, login, place = "Zx9Kq2Lm7Rt4Wp8Yb3Vn" * 50, "user=" + "alice" * 30, "https://db.example.net/" + "x" * 700
    key = "AKIA" + "Q7" * 8
    orders = [list(x) for x in itertools.permutations((opaque, login, place))]
    texts = [f"{' ' * rng.randrange(400)}{(' ' * rng.randrange(1, 190)).join(x)}" for x in orders * 3]
    texts += [f"{opaque}{' ' * 199}{key}", f"{opaque}{' ' * 201}{key}", f"{key}{' ' * 200}{opaque}", f"{key}{' ' * 201}{opaque}"]
    left = {r["doc_id"]: r["text"].split() for r in secrets.masked(frame(spark, list(enumerate(texts)))).collect()}
    # in reach of each other: all three where the gaps and the part between them allow it
    for i, text in enumerate(texts[:-4]):
        at = {k: (text.index(v), text.index(v) + len(v)) for k, v in (("i", login), ("s", opaque), ("e", place))}
        met = lambda a, b: max(at[a][0] - at[b][1], at[b][0] - at[a][1]) <= 200
        want = {login: met("i", "s") and met("i", "e"), opaque: met("i", "s"), place: met("e", "i") and met("e", "s")}
        assert left[i] == ["[secret]" if want[x] else x for x in text.split()], i
    n = len(texts)
    assert [left[i].count("[secret]") for i in range(n - 4, n)] == [2, 1, 2, 1]


# ---- 9 ---------------------------------------------------------------------------------

def test_repeated_strings(spark, odd, empty):
    rng = random.Random(12)
    bases = ["".join(rng.choices("ab cé", k=200)) for _ in range(4)]
    rows = []
    for i in range(60):
        text = "".join(rng.choice(bases)[rng.randint(0, 60):rng.randint(80, 200)] + rng.choice(["", "x", "a" * 70, "yy"])
                       for _ in range(rng.randint(0, 4)))
        rows.append((rng.choice([i, i, i, i - 1, None]), rng.choice([text] * 4 + [None, ""])))
    rows += [(100, "ab" * 300), (101, "ab" * 40), (102, "a" * 300), (103, "a" * 49), (104, "a" * 50), (105, "ab" * 300)] + [
        (200 + k if i is not None else None, t) for k, (i, t) in enumerate(odd[0])]
    first = {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (text or "").encode()
        for p in range(len(data) - 49):
            first.setdefault(data[p:p + 50], i)
    want = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if i is not None and first[data[p:p + 50]] < i:
                gone[p:p + 50] = b"\1" * 50
        left = bytes(x for x, y in zip(data, gone) if not y)
        runs = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        want.append((i, len(data), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    got = suffix.deduplicated(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and sum(w[2] for w in want) > 3000
    assert suffix.deduplicated(empty).count() == 0


# ---- 10 --------------------------------------------------------------------------------

def test_repeated_paragraphs(spark, odd, empty):
    rng = random.Random(13)
    shared = [prose(rng, 60) for _ in range(3)] + ["short line shared by all"]
    rows = []
    for i in range(50):
        lines = [edited(rng, rng.choice(shared), rng.choice([0, 0, .02, .1])) if rng.random() < .5 else prose(rng, rng.randrange(5, 60))
                 for _ in range(rng.randrange(4))]
        rows.append((i, "\n".join(lines)))
    places, sets = [], []
    for i, text in rows:
        for k, line in enumerate(text.split("\n")):
            if len(line.split()) >= 20:
                places.append((i, k))
                sets.append(shingles(line, 5))
    label = components_of(len(sets), similar(sets, 80))
    want = defaultdict(list)
    for n, (i, k) in enumerate(places):
        if label[n] != n:
            want[i].append(k)
    got = {r["doc_id"]: r for r in substring.digest(frame(spark, rows)).collect()}
    assert {i: list(r["removed"]) for i, r in got.items() if r["removed"]} == dict(want) and want
    for i, text in rows:
        left = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in want[i])
        assert got[i]["kept_sha256"] == hashlib.sha256(left.encode()).hexdigest() and got[i]["n_removed"] == len(want[i])
    strange = substring.without_repeats(odd[1])
    assert strange.count() == len(odd[0]) and strange.columns.count("removed") == 1
    assert substring.digest(empty).count() == 0


# ---- whole -----------------------------------------------------------------------------

def test_only_the_entry_imports_the_subpackage():
    root = Path(__file__).resolve().parents[2]
    for path in [*root.glob("netloom/**/*.py"), root / "bench.py", *root.glob("tests/*.py")]:
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"\bnetloom\.llm\b|corpus_pipeline", path.read_text()), path


def test_pipeline(spark, tiny, library):
    import corpus_pipeline as pipeline
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "secret_scans", "bpe"]
    out = {r["doc_id"]: r for r in pipeline.run(spark, tiny).collect()}
    # brute force from the stage before: which documents stay, and what they become
    table = spark.read.parquet(f"{tiny}/documents.parquet")
    calm = {r["doc_id"] for r in toxicity.score(table, toxicity.train(table, spark.read.parquet(f"{tiny}/labels.parquet"))).where(
        "predicted = 0").collect()}
    ids = sorted(calm)
    label = components_of(len(ids), similar([shingles(docs[i], 5) for i in ids], 80))
    single = [i for n, i in enumerate(ids) if label[n] == n]
    tokens = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    bench = [tokens(r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    clean = [i for i in single if not any(b in tokens(docs[i]) for b in bench)]
    assert sorted(out) == clean and len(clean) < len(ids)
    for i in clean:
        text, at = "", 0
        for start, _, end in base_spans(docs[i]):
            if start >= at:
                text += docs[i][at:start] + "[secret]"
            at = max(at, end)
        text += docs[i][at:]
        want = library.encode(text, add_special_tokens=False).ids
        assert out[i]["ids"] == want and out[i]["text"] == text and out[i]["n_tokens"] == len(want)
    assert json.dumps(sorted(out)) == json.dumps(clean)
