"""Cross-tokenizer alignment, license scans and the filter audit against brute force."""

import hashlib
import itertools
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from netloom.llm import alignment, filter_audit, licenses
from netloom.llm.queries import tokenizer

SCHEMA = ("doc_id bigint, text string, lang string, source string, row bigint, run bigint, kind string, template int, "
          "spans int, part string, mask int, n int, key bigint, n_chars bigint")
EDGES = [None, "", " ", "\n\n\t", "é", "a", "word", "x" * 3000, "ab " * 2000, "日本語 テキスト next", "<|endoftext|>'s  \r\n",
         "under▁score", "a  double  space ", "<s> </s> <unk>", "é ﬁ ½", "\x00nul", "🙂" * 40]


def frame(spark, rows):
    """Rows of (doc_id, text[, lang]) with further columns that are named like the operators' own."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, 1, 2, "text", 3, 4, "p", 5, 6, 7, 8) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd():
    return [(i, t) for i, t in enumerate(EDGES)] + [(1, ""), (6, "word"), (None, "word"), (None, None), (6, "other text")]


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is None, str(v)) for v in r])


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


# ---- alignment ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    from public_tokenizers import path

    return path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain_alignment(pieces):
    """The contract word by word, one text after the other."""
    import sentencepiece
    from tokenizers import Tokenizer

    from netloom.llm.bpe import byte_letters

    side_a = Tokenizer.from_file(tokenizer())
    side_a.encode_special_tokens = True
    letters, names = byte_letters(), {i: t for t, i in side_a.get_vocab().items()}
    side_b = sentencepiece.SentencePieceProcessor(model_file=pieces)

    def piece(i):
        name = side_b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if side_b.is_byte(i) else name.replace("▁", " ").encode()

    def run(rows):
        out, counts = [], Counter()
        for doc_id, text in rows:
            text = text or ""
            a, b = side_a.encode(" " + text, add_special_tokens=False).ids, side_b.encode(text)
            a_bytes, b_bytes = [bytes(letters[c] for c in names[i]) for i in a], [piece(i) for i in b]
            want = (" " + text).encode()
            if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
                out.append((doc_id, 0, 0, [], ""))
                continue
            ends_b = {e: i for i, e in enumerate(itertools.accumulate(map(len, b_bytes)))}
            groups, found, last_a, last_b = [], [], 0, 0
            for i, e in enumerate(itertools.accumulate(map(len, a_bytes))):
                if e in ends_b:
                    j = ends_b[e]
                    groups.append(",".join(map(str, a[last_a:i + 1])) + "|" + ",".join(map(str, b[last_b:j + 1])))
                    found.append((a[i], b[j]))
                    last_a, last_b = i + 1, j + 1
            counts.update(found)
            out.append((doc_id, len(a), len(b), found, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        most: Counter = Counter()
        for (_, b), n in counts.items():
            most[b] = max(most[b], n)
        return [(i, a, b, len(f), len(f), sum(counts[x] == most[x[1]] for x in f), sum(counts[x] for x in f), g)
                for i, a, b, f, g in out], counts
    return run


def text_of(rng, n):
    return " ".join(rng.choice(["the", "zebra", "unhappily", "2024", "naïve", "Straße", "don't", "a,b", "ça", "  ", "\n"])
                    for _ in range(n))


def test_alignment(spark, odd, pieces, plain_alignment):
    rng = random.Random(1)
    rows = odd + [(100 + i, text_of(rng, rng.randint(1, 200))) for i in range(60)] + [(500, text_of(rng, 30_000))]
    want, counts = plain_alignment(rows)
    assert values(alignment.aligned(frame(spark, rows), tokenizer(), pieces)) == ordered(want)
    table = {(r["id_a"], r["id_b"]): r["links"] for r in alignment.pair_counts(frame(spark, rows), tokenizer(), pieces).collect()}
    assert table == dict(counts)
    assert alignment.aligned(frame(spark, []), tokenizer(), pieces).count() == 0


def test_alignment_over_many_runs(spark, pieces, plain_alignment, monkeypatch):
    """Small runs and fan-in: several passes of merging, one pair in every text, counts joined instead of broadcast."""
    rng = random.Random(2)
    rows = [(i, "the the, " + text_of(rng, 40)) for i in range(120)] + [(7, "the the, ")] * 200
    for name, value in (("RUN_LINKS", 40), ("FAN_IN", 4), ("BROADCAST_BYTES", 0)):
        monkeypatch.setattr(alignment, name, value)
    want, _ = plain_alignment(rows)
    assert values(alignment.aligned(frame(spark, rows), tokenizer(), pieces)) == ordered(want)


def test_faster_library_reads_latin_texts_alike(pieces):
    from public_tokenizers import path

    with open(path("piece_bpe_32k.model"), "rb") as file, open(tokenizer(), encoding="utf-8") as vocabulary:
        sides = alignment.Sides(vocabulary.read(), file.read())
    rng = random.Random(3)
    letters = [chr(c) for c in range(1, 256)] + [" ", "  ", "\n", "'s", "don't", "word", "12", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randint(1, 30)))
        assert sides.a_ids(text) == sides.exact.encode(text, add_special_tokens=False).ids


def test_merged_runs_and_records():
    rng = random.Random(4)
    runs = [Counter(rng.choices(range(50), k=100)) for _ in range(5)]
    parts = [(np.array(sorted(r)), np.array([r[k] for k in sorted(r)])) for r in runs]
    assert dict(alignment.heap_merged(parts)) == dict(sum(runs, Counter()))
    side_major = [(1 << 32 | 5, 3), (1 << 32 | 6, 3), (2 << 32 | 5, 1), (2 << 32 | 9, 4)]
    assert [best for *_, best in alignment.with_maxima(side_major)] == [1, 1, 0, 1]
    pairs, rows = np.array([rng.randrange(200) << 32 | 3 for _ in range(1000)]), np.array([rng.randrange(9) for _ in range(1000)])
    seen = Counter()
    for _, known, _, lengths, steps, times in alignment.spill(pairs, rows):
        pair = np.repeat(np.cumsum(alignment.unpack(known)), alignment.unpack(lengths))
        who = alignment.records(alignment.unpack(lengths), alignment.unpack(steps))
        seen.update(dict(zip(zip(pair.tolist(), who.tolist()), alignment.unpack(times).tolist())))
    assert seen == Counter(zip(pairs.tolist(), rows.tolist()))


# ---- licenses ----------------------------------------------------------------------------------------


def plain_places(text):
    words = licenses.words_of(text)
    return words, [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words))
                   if words[i:i + len(phrase.split())] == [w.encode() for w in phrase.split()]]


def test_license_phrases(spark, odd):
    rng = random.Random(5)
    bits = "gnu general public license apache cc by mit License, GNU-General the of MIT/license CC-BY naïve".split()
    rows = odd + [(100 + i, " ".join(rng.choices(bits, k=rng.randint(1, 80)))) for i in range(80)] + [(300, "mit license " * 9000)]
    want = []
    for doc_id, text in rows:
        words, places = plain_places(text)
        at = [i for i, _ in places]
        want.append((doc_id, len(words), len(at), min(at, default=None), max(at, default=None),
                     ",".join(sorted({label for _, label in places}))))
    got = licenses.digest(frame(spark, rows)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert values(got) == ordered(want)
    assert licenses.digest(frame(spark, [])).count() == 0


def test_words_are_those_of_the_pattern():
    import regex

    rng = random.Random(6)
    for _ in range(500):
        text = "".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(128, 0x2100)])) for _ in range(40))
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        assert licenses.words_of(text) == [w.encode() for w in regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)]


def test_edited_notices_and_unrelated_texts(spark, monkeypatch):
    rng = random.Random(7)
    filler = lambda n: [rng.choice("lorem ipsum dolor sit amet the of software license permission".split()) for _ in range(n)]
    rows, want = [], {}
    for i, (label, notice) in enumerate(licenses.NOTICES):
        words = notice.split()
        for edits in (0, len(words) // 12):
            quoted = list(words)
            for _ in range(edits):
                at = rng.randrange(len(quoted))
                kind = rng.randrange(3)
                quoted[at:at + 1] = [] if kind == 0 else ["changed"] if kind == 1 else [quoted[at], "added"]
            doc_id = 10 * i + (edits > 0)
            rows.append((doc_id, " ".join(filler(300) + quoted + filler(300))))
            want[doc_id] = label
    rows += [(1000 + i, " ".join(filler(600))) for i in range(20)]
    for few in (licenses.BROADCAST_SPANS, 0):     # spans come back by broadcast or by a join
        monkeypatch.setattr(licenses, "BROADCAST_SPANS", few)
        got = {r["doc_id"]: (r["labels"].split(","), r["score"]) for r in licenses.digest(frame(spark, rows)).collect()}
        assert all(label in got[i][0] for i, label in want.items())
        assert all(got[i][0] == [""] and got[i][1] < 0.8 for i in range(1000, 1020))
    found = licenses.scan(frame(spark, rows)).where("kind = 'notice'").collect()
    assert {r["doc_id"] for r in found} >= set(want) and all(0.8 <= r["share"] <= 1 for r in found)


def test_common_words_is_the_longest_subsequence():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([bytes([rng.randrange(97, 101)]) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert licenses.common_words(tuple(a), b) == best[-1][-1]


# ---- filter audit ------------------------------------------------------------------------------------


def test_trie():
    rng = random.Random(9)
    texts = ["".join(rng.choices("ab", k=rng.randrange(8))) for _ in range(300)] + ["x" * 5000, "x" * 4999 + "y", "日本", "日"]
    trie = filter_audit.Trie()
    for i, text in enumerate(texts):
        trie.insert(text, list).append(i)
    assert dict(trie.terminals()) == {t: [i for i, x in enumerate(texts) if x == t] for t in set(texts)}


def audit_by_sql(tmp_path, rows, labels):
    import pyarrow as pa

    db = duckdb.connect()
    given = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()),
                      "lang": pa.array([r[2] if len(r) > 2 else "en" for r in rows], pa.string())})
    marks = pa.table({"doc_id": pa.array([r[0] for r in labels], pa.int64()), "quality": pa.array([r[1] for r in labels], pa.int32()),
                      "toxic": pa.array([r[2] for r in labels], pa.int32())})
    db.register("documents", given)
    db.register("labels", marks)
    return ordered(db.execute(filter_audit.oracle_sql()).fetchall())


@pytest.mark.parametrize("trie_chars", [16 << 20, 500])
def test_audit(spark, odd, tmp_path, monkeypatch, trie_chars):
    """Copies across tasks, one text in a third of all rows, long common heads, labels twice; large and small tries."""
    monkeypatch.setattr(filter_audit, "TRIE_CHARS", trie_chars)
    rng = random.Random(10)
    head = "the same opening of many texts " * 40
    pool = [head + " ".join(rng.choices("Alpha beta gamma $ delta EPSILON zeta eta".split(), k=rng.randint(5, 200))) for _ in range(60)]
    rows = [(r[0], r[1], "en") for r in odd]
    rows += [(1000 + i, rng.choice(pool), rng.choice(["en", "fr", None])) for i in range(200)]
    rows += [(3000 - i, "hot text", rng.choice(["en", "de"])) for i in range(130)] + [(2950, "hot text", "en")] * 2
    labels = [(r[0], rng.randrange(2), rng.randrange(2)) for r in rows[::2] if r[0] is not None]
    labels += labels[:10] + [(None, 1, 1), (9999, 1, 1), (1000, None, 1)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(frame(spark, rows), marks)
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == columns
    assert values(got) == audit_by_sql(tmp_path, rows, labels)


def test_audit_of_nothing(spark):
    assert filter_audit.audit(frame(spark, []), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


def test_bounds_separate_texts_with_a_common_head(spark):
    texts = spark.createDataFrame([("prefix " * 300 + f"{i:05d}",) for i in range(2000)], "text string")
    bounds = filter_audit.prefix_bounds(texts, 8, 2000)
    assert bounds == sorted(bounds) and len(bounds) >= 5
