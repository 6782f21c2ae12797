"""Periodic runs, spelling variants and token files against brute force, with nulls, empty and long texts, repeats and clashing columns."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import mixing, ngram_join, periodic, range_coder, spelling, token_files
from quern.llm.packing import RunIds

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, least, times):
    met = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                met[i, j - i + q] = min(q, met.get((i, j - i + q), q))
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in met.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "times"), [(6, 4), (1, 2), (3, 3)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(3)
    for _ in range(500):
        w = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(70))]
        if w and rng.random() < 0.6:
            a, p = rng.randrange(len(w)), rng.randint(1, max(1, len(w) // times))
            w = [w[i] if i < a else w[min(len(w) - 1, a + (i - a) % p)] for i in range(len(w))]
        assert periodic.runs_of(np.array(w, dtype="int64"), least, times) == brute_runs(w, least, times)


def test_extensions_hold_against_colliding_hashes(monkeypatch):
    """With a hash that calls everything equal, only the words themselves decide."""
    monkeypatch.setattr(periodic.Extension, "_alike", lambda self, i, j, n: True)
    rng = random.Random(4)
    for _ in range(200):
        w = [k % 3 for k in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            if w:
                w[rng.randrange(len(w))] = 7
        assert periodic.runs_of(np.array(w, dtype="int64"), 6, 4) == brute_runs(w, 6, 4)


def test_periodic_runs(spark):
    long = "x y " * 20_000
    rows = [(1, None, 0), (2, "", 0), (3, " \t\n", 0), (4, "a b a b a b a b c", 0), (4, "a b a b a b a b c", 0), (None, "z z z z z z", 0), (5, long, 0), (6, "one two three", 0), (7, "é é é é é é", 0)]
    got = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int")).collect()
    found = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got), key=repr)
    want = [(i, len(WORD.findall(t or "")), brute_runs(WORD.findall(t or ""), 6, 4) if i != 5 else [(0, 40_000, 2)]) for i, t, _ in rows]
    short = {4: "a b c", None: "z", 5: "x y", 6: "one two three", 7: "é"}
    assert found == sorted(((i, n, r, short.get(i, "")) for i, n, r in want), key=repr)
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert periodic.digests(periodic.periodic_runs(empty)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(empty, times=1)


def test_planted_periods(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 50))) for i in range(300)] + [(10**6, None), (None, "a b")]
    got = {r["doc_id"]: r["t"] for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("t")).collect()}
    hits = 0
    for i, t in rows:
        h = zlib.crc32(str(i).encode())
        words = WORD.findall(t or "")
        if i is not None and t is not None and h % 10 == 0:
            g, n = h // 10, len(words)
            if n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
                hits += 1
            t = " ".join(words)
        assert got[i] == t
    assert hits > 10


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


@pytest.mark.parametrize("key_rows", [2, 32])
def test_near_pairs_equal_brute_force(spark, key_rows):
    rng = random.Random(5)
    words = {"".join(rng.choice("aabé") for _ in range(rng.randint(1, 9))) for _ in range(400)} | {"aaaaaaa", "aaaaaa", "ﬁne", "fine"}
    df = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    got = [(r["word"], r["other"]) for r in spelling.near_pairs(df, key_rows=key_rows).collect()]
    ordered = sorted(words)
    want = {frozenset((a, b)) for k, a in enumerate(ordered) for b in ordered[k + 1 :] if one_edit(a, b)}
    assert len(got) == len(set(map(frozenset, got)))  # each pair once
    assert set(map(frozenset, got)) == want
    assert spelling.near_pairs(df.limit(0)).count() == 0


def test_spelling_variants(spark):
    docs = [(1, "Colour colour COLOUR colour colour color " * 30), (2, "colours " * 5 + "coloxr " * 6 + "colo1ur"), (3, None), (4, ""), (None, "colour"), (1, "éclairs éclair"), (5, "coloxs " * 5), (6, "x" * 30_000)]
    df = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, word string")
    counts = {r["word"]: r["n"] for r in spelling.word_counts(df, slip=3).collect()}
    want = Counter()
    for i, t in docs:
        for w in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 3 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                want[w] += 1
    assert counts == dict(want)
    table = spark.createDataFrame([("colour", 150), ("coloxr", 25), ("coloxs", 5), ("colours", 5), ("aaaaaa", 30), ("aaaaab", 30), ("aaaaac", 6), ("rareee", 4), (None, 9)], "word string, n long")
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.spelling_variants(table).collect()}
    assert got == {
        "colour": (150, 2, None, None, "colour"), "coloxr": (25, 2, "colour", 150, "colour"), "coloxs": (5, 1, "coloxr", 25, "colour"), "colours": (5, 1, "colour", 150, "colour"),
        "aaaaaa": (30, 2, None, None, "aaaaaa"), "aaaaab": (30, 2, None, None, "aaaaab"), "aaaaac": (6, 2, "aaaaaa", 30, "aaaaaa"),
    }
    assert spelling.spelling_variants(table.limit(0)).count() == 0


def test_range_coder_round_trip():
    rng = np.random.default_rng(2)
    blocks = [rng.integers(0, 65536, n).astype("uint32") for n in (0, 1, 700, 333)] + [np.zeros(2000, "uint32"), np.full(5, 65535, "uint32"), (np.arange(3000) % 17).astype("uint32")]
    blocks += [np.minimum(rng.geometric(0.01, 900), 49_407).astype("uint32") for _ in range(30)]
    coded = range_coder.encode(blocks)
    for block, back in zip(blocks, range_coder.decode(coded, list(map(len, blocks))), strict=True):
        assert np.array_equal(block, back)
    assert coded[2] == range_coder.encode([blocks[2]])[0]  # whatever stands beside it
    assert len(coded[4]) < 120 and len(coded[6]) < 900
    assert range_coder.encode([]) == [] and range_coder.decode([], []) == []


def test_range_coder_of_long_blocks():
    """More words than a lane has room for at first, next to short ones; whatever is predicted, the classes learn from it."""
    rng = np.random.default_rng(4)
    blocks = [rng.integers(0, 65536, n).astype("uint32") for n in (9000, 3, 0, 1500)] + [rng.choice([0, 65535, 40_000], 4000, p=[0.98, 0.01, 0.01]).astype("uint32")]
    blocks += [np.tile(rng.integers(0, 49_408, n), 3000 // n).astype("uint32") for n in (2, 40, 700)]
    coded = range_coder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, range_coder.decode(coded, list(map(len, blocks))), strict=True))
    assert [range_coder.encode([b])[0] for b in blocks] == coded
    assert len(coded[0]) < 2.2 * 9000 and len(coded[4]) < 400 and len(coded[5]) < 200


def test_token_files(spark, tmp_path):
    import public_tokenizers

    long = "lorem ipsum dolor sit amet " * 9000
    rows = [(5, "Hello world"), (1, None), (3, ""), (None, "no id"), (2, long), (3, "again"), (9, "ünï cödé \U0001f600"), *[(7, "copy of it")] * 40]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    manifest = token_files.write_token_files(df, f"file://{tmp_path}/a", block_ids=64, lanes=7)
    got = sorted((r.asDict() for r in token_files.read_token_files(manifest, with_ids=True, lanes=5).collect()), key=lambda r: r["start"])
    runs = RunIds(public_tokenizers.path("word_bpe_49k.json"))
    at = 0
    for r in got:
        assert r["start"] == at and len(r["ids"]) == r["n_tokens"] and r["ids"][-1] == 1
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows if i is not None)) + [None]
    plain = {(i, tuple(np.frombuffer(runs.whole(t or ""), "<u4").tolist()) + (1,)) for i, t in rows}
    assert {(r["doc_id"], tuple(r["ids"])) for r in got} == plain
    empty = token_files.write_token_files(df.limit(0), f"file://{tmp_path}/b")
    assert empty.count() == 0 and token_files.read_token_files(empty).count() == 0
    path = manifest.orderBy(F.desc("bytes")).first()["path"].removeprefix("file://")
    body = bytearray(open(path, "rb").read())
    body[60] ^= 1
    open(path, "wb").write(body)
    with pytest.raises(Exception, match="damaged"):
        token_files.read_token_files(manifest).count()


def test_texts_are_cut_into_runs_together(monkeypatch):
    """The ids are the tokenizer's own; runs that come again, in one text or another, are met once."""
    import public_tokenizers

    runs = RunIds(public_tokenizers.path("word_bpe_49k.json"), keep=50)
    texts = ["it's we've I'LL don't 'tis '' 's's ,'s x'", "", " \t\n\x0b\x0c\r ", "a1b22,33.-4 'd'", "Ünï ÀÉß÷× ÿ\u0178", "'", "we'r", "it'", "l'l", "\x1cend\x1f a", "<|endoftext|> a <| b", "日本語 and it's", "x" * 70_000, "naïve Äpfel's"]
    rng = np.random.default_rng(3)
    texts += ["".join(rng.choice(list("stvelrdm'' 1,.\n\tAé"), rng.integers(0, 60))) for _ in range(3000)]
    for some in (texts, texts[:1], texts[1:3], texts[10:12], [""], []):
        got = runs.many(some, b"\x01\0\0\0")
        assert [g.tolist() for g in got] == [[*np.frombuffer(runs.whole(t), "<u4").tolist(), 1] for t in some]
    met = []
    fresh = RunIds(public_tokenizers.path("word_bpe_49k.json"))
    meet = fresh._meet
    monkeypatch.setattr(fresh, "_meet", lambda found: met.extend(found) or meet(found))
    for _ in range(2):
        fresh.many(["one two, one", "two three one."] * 50, b"\x01\0\0\0")
    assert sorted(met) == [b",", b".", b"one", b"three", b"two"]


def test_crc_in_sql():
    words = ["", "hello", "é1:ab", "x" * 300]
    values = ", ".join(f"('{w}')" for w in words)
    found = dict(duckdb.sql(f"WITH {periodic.CRC_TABLE} SELECT w, {periodic.crc_sql('w')} FROM (VALUES {values}) v(w), crc").fetchall())
    assert found == {w: zlib.crc32(w.encode()) for w in words}


def test_mixing_does_not_depend_on_the_split_of_equal_rows(spark):
    """More equal rows than a block holds, in one file and in many."""
    rows = [(1, "same words here now", "a")] * 90 + [(1, "same words here now", "b")] * 30 + [(k, "w " * (k % 9), "ab"[k % 2]) for k in range(2, 120)]
    found = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows[::-1] if parts > 1 else rows, "doc_id long, text string, source string").repartition(parts)
        got = mixing.mix(df, block_rows=16).groupBy("doc_id", "size", "source_size", "taken").count()
        whole = mixing.mixed_rows(df, block_rows=16).groupBy("doc_id", "text", "source").count()
        found.append((sorted(map(tuple, got.collect())), sorted(map(tuple, whole.collect()))))
    assert found[0] == found[1]


def test_keep_one_takes_the_same_row_however_rows_are_split(spark):
    rows = [(1, "a b c d e f g", x) for x in ("en", "de", None, "fr")] + [(2, "a b c d e f g", "es"), (3, None, "en")]
    kept = [sorted(map(tuple, ngram_join.keep_one(spark.createDataFrame(r, "doc_id long, text string, lang string").repartition(n)).collect()), key=repr) for r, n in ((rows, 1), (rows[::-1], 5))]
    assert kept[0] == kept[1] and [r[0] for r in kept[0]] == [1, 3]
