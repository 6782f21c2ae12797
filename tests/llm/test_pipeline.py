"""The pipeline's stages, and the operators' options that only it uses."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quern.llm import line_dedup
from quern.llm.common import table, written
from tests.llm.test_operators import brute_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_dedup(rows, min_sites, long_words, long_sites):
    """(doc, text) of rows (doc, text, site) without boilerplate lines but for their first place."""
    sites, first = {}, {}
    for d, t, s in rows:
        for p, line in enumerate(t.split("\n") if t is not None else []):
            if k := line.strip(" \t\r\f\x0b"):
                sites.setdefault(k, set()).add(s)
                first[k] = min(first.get(k, (d, p)), (d, p))

    def goes(k, at):
        return k in sites and len(sites[k]) >= (long_sites if len(WORD.findall(k)) >= long_words else min_sites) and first[k] != at

    return [(d, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not goes(x.strip(" \t\r\f\x0b"), (d, p)))) for d, t, _ in rows]


def passage(n, name):
    return " ".join(f"{name}{k}" for k in range(n))


def test_long_lines_on_a_few_sites_are_boilerplate(spark):
    """A passage of 20 documents, most of them of one hot site, and lines on either side of both limits."""
    hot, few, short = passage(60, "hot"), passage(50, "few"), passage(49, "short")
    rows = [(i, f"own {i}\n {hot}\t\nend {i}", "big" if i % 3 else f"s{i % 9}") for i in range(20)]
    rows += [(30 + i, f"{few}\n{short}\n{passage(55, 'two') if i < 2 else 'x'}", f"t{i}") for i in range(3)]
    rows += [(40 + i, f"common\n{short if i < 6 else i}\nrare {i // 2}", f"u{i}") for i in range(10)] + [(60, None, "s1"), (61, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup.line_dedup(df, long_words=50)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect() if r["text"] is not None) == sorted(x for x in brute_dedup(rows, 10, 50, 3) if x[1] is not None)
    whole = "\n".join(r["text"] or "" for r in got.collect())
    assert whole.count(hot) == whole.count(few) == whole.count("common") == 1 and whole.count("two0 ") == 2 and whole.count(short) == 9
    assert "\n".join(r["text"] or "" for r in line_dedup.line_dedup(df).collect()).count(hot) == 20
    with pytest.raises(ValueError):
        line_dedup.line_dedup(df, long_words=50, long_sites=2)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN, DE = "the house and the garden with a long path to the river", "das haus und der garten mit einem langen weg zum fluss"


def corpus():
    """Rows (doc_id, text, lang, source): clear languages, no letters, nulls, boilerplate, a long passage, near copies."""
    rng = np.random.default_rng(12)
    vocab = {"en": sorted(set(EN.split())), "de": sorted(set(DE.split()))}
    rows = []
    for i in range(90):
        lang = "en" if i % 2 else "de"
        own = " ".join(rng.choice(vocab[lang], int(rng.integers(30, 90))))
        rows.append((i, f"{vocab[lang][0]} foot line\n{own}\n{(EN + ' ') * 5 if i in (4, 9, 20, 31) else own[:40]}", lang if i % 7 else None, f"s{i % 12}"))
    copies = [(100 + i, rows[i][1] + (" the" if i % 2 else " der"), None, "s3") for i in range(0, 30, 3)]
    return rows + copies + [(200, None, "en", "s1"), (201, "", "en", "s1"), (202, "123 -- 456", "de", None), (203, EN, None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows], DOCS)


def back(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()), key=lambda r: r[0])


def packed(df):
    return sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())


def test_every_stage_and_run_equal_brute_force(spark, tmp_path):
    rows = corpus()
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    docs = table(spark, str(tmp_path), "documents")

    docs = written(stage["language ID"](spark, docs, str(tmp_path)), "t")
    now = sorted((r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])), key=lambda r: r[0])
    now = [(i, t, la or ("en" if set(t.split()) & {"the", "and", "house", "with"} else "de"), s) for i, t, la, s in now]  # what a null lang becomes
    assert back(docs) == now and docs.columns == [c.split()[0] for c in DOCS.split(", ")]

    docs = written(stage["line dedup"](spark, docs, str(tmp_path)), "t")
    texts = dict(brute_dedup([(i, t, s) for i, t, _, s in now], 10, 50, 3))
    assert texts != {r[0]: r[1] for r in now}
    now = [(i, texts[i], la, s) for i, _, la, s in now]
    assert back(docs) == now and all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    docs = written(stage["n-gram Jaccard join"](spark, docs, str(tmp_path)), "t")
    low = {i: c for i, _, c in brute_components([(i, t) for i, t, *_ in now], 5, 80)[0]}
    assert any(i != c for i, c in low.items())
    now = [r for r in now if low[r[0]] == r[0]]
    assert back(docs) == now

    docs = written(stage["mixing sources to target weights"](spark, docs, str(tmp_path)), "t")
    mixed, size, total = back(docs), {}, 0
    for _, t, _, s in now:
        size.setdefault(s, []).append(len(WORD.findall(t)))
        total += size[s][-1]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate([*sorted(s for s in size if s is not None), *[s for s in size if s is None]])}
    target, full = {}, set()
    while True:
        level = (total - sum(3 * sum(size[s]) for s in full)) / sum(w for s, w in weight.items() if s not in full)
        target = {s: 3 * sum(n) if s in full else level * weight[s] for s, n in size.items()}
        if not (over := {s for s, n in size.items() if target[s] > 3 * sum(n)} - full):
            break
        full |= over
    taken = Counter(mixed)
    assert set(taken) <= set(now) and max(taken.values()) <= 3
    for s, n in size.items():
        assert abs(sum(len(WORD.findall(r[1])) * k for r, k in taken.items() if r[3] == s) - target[s]) <= max(0.02 * target[s] + 60, max(n) / 2)

    got = stage["best-fit packing"](spark, docs, str(tmp_path))
    t, exp = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, text, *_ in mixed:
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        exp += [(i, k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert packed(got) == sorted(exp)
    assert packed(corpus_pipeline.run(spark, str(tmp_path))) == sorted(exp)


def test_documents_go_on_when_no_language_can_be_learned(spark):
    rows = [(1, EN, None, "a"), (2, "123 !!", None, "a"), (3, None, None, "a"), (4, "é", None, None), (5, "", None, "b"), (None, DE, "de", "b"), (6, "12", "de", "b")]
    got = corpus_pipeline.language_id(spark, frame(spark, rows), "")
    assert got.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted((r["text"] for r in got.collect())) == sorted([EN, DE, "é"])
