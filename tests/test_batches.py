"""Batches by words and bytes against loops."""

import math
import random

import pytest

from quern.operators import batches


def loop_greedy(sizes, most):
    out, batch, total = [], 0, None
    for s in sizes:
        if total is not None and total + s > most:
            batch, total = batch + 1, 0
        total = (total or 0) + s
        out.append(batch)
    return out


def test_greedy_is_the_loop(spark):
    rng = random.Random(2)
    rows, wanted = [], set()
    for k in ("a", "b", "c"):
        sizes = [rng.choice([0, 0, 1, 3, 5, 8, 13, 40]) for _ in range(rng.choice([1, 60, 90]))]
        rows += [(k, p * 3, s if s or p % 2 else None, "x") for p, s in enumerate(sizes)]
        wanted |= {(k, p * 3, b) for p, b in enumerate(loop_greedy(sizes, 20))}
    rows += [(None, 1, 5, "x"), ("a", None, 5, "x")]
    rng.shuffle(rows)
    got = batches.greedy_batches(spark.createDataFrame(rows, "k string, p int, s int, other string").repartition(3), 20, key=["k"], pos="p", size="s")
    assert {(r["k"], r["p"], r["batch"]) for r in got.collect()} == wanted and "other" in got.columns


def loop_words(sections, most):
    out, batch, total = [], -1, 0
    for number, head, blocks in sections:
        units, now, content = [], head, False
        if head + sum(blocks) <= most:
            units = [head + sum(blocks)]
        else:
            for w in blocks:
                if content and w and now + w > most:
                    units.append(now)
                    now, content = 0, False
                now, content = now + w, content or w > 0
            units.append(now)
        for part, words in enumerate(units):
            if batch < 0 or total + words > most:
                batch, total = batch + 1, 0
            total += words
            out.append((number, part, len(units), words, batch))
    return out


def test_word_batches(spark):
    rng = random.Random(4)
    secs, blocks, wanted = [], [], set()
    for doc in (1, 2):
        sections = [(n, rng.randrange(4), [rng.choice([0, 2, 7, 15, 60]) for _ in range(rng.randrange(7))]) for n in range(18)]
        wanted |= {(doc, *row) for row in loop_words(sections, 50)}
        secs += [(doc, n, h) for n, h, _ in sections]
        blocks += [(doc, n, i, w) for n, _, ws in sections for i, w in enumerate(ws)]
    got = batches.word_batches(spark.createDataFrame(blocks, "doc int, section int, block int, words int"), spark.createDataFrame(secs, "doc int, section int, heading_words int"), 50)
    assert {tuple(r) for r in got.collect()} == wanted


def loop_bytes(sizes, max_items, max_bytes, least):
    weight = lambda part: sum(s + 2 for s in part) + 2
    n = min(len(sizes), max(1, least, math.ceil(len(sizes) / max_items), math.ceil(weight(sizes) / max_bytes)))
    each = math.ceil(len(sizes) / n)
    todo, out = [(lo, min(lo + each, len(sizes))) for lo in range(0, len(sizes), each)][::-1], []
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= 1 or weight(sizes[lo:hi]) <= max_bytes:
            out.append((len(out), lo, hi - lo, weight(sizes[lo:hi])))
        else:
            todo += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]
    return out


@pytest.mark.parametrize("max_items, max_bytes, least", [(10, 300, 1), (1000, 120, 4)])
def test_byte_batches(spark, max_items, max_bytes, least):
    rng = random.Random(6)
    rows, wanted = [], set()
    for k in range(3):
        sizes = [rng.choice([1, 5, 20, 200]) for _ in range(rng.choice([1, 33, 70]))]
        rows += [(k, p, s) for p, s in enumerate(sizes)]
        wanted |= {(k, *row) for row in loop_bytes(sizes, max_items, max_bytes, least)}
    got = batches.byte_batches(spark.createDataFrame(rows, "key int, pos int, bytes int"), max_items=max_items, max_bytes=max_bytes, min_batches=least)
    assert {tuple(r) for r in got.collect()} == wanted


def test_empty(spark):
    none = spark.createDataFrame([], "key int, pos int, bytes int")
    assert batches.byte_batches(none, max_items=3, max_bytes=9).count() == 0
    assert batches.greedy_batches(none, 4, key=["key"], pos="pos", size="bytes").count() == 0
