"""URL filters: labels from the rules, and naive Bayes against a brute-force version."""

import math
import zlib

import pytest

from quern.llm import url_filter


def verdicts(spark, urls, **fitting):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {r["page_id"]: (r["verdict"], r["block_score"]) for r in url_filter.url_verdicts(df, **fitting).collect()}


def ruled(block, allow, n=40):
    """Urls that rules block and allow, with the given words beside the rule."""
    return [f"http://{block}{k}.com/de/{block}/{k}" for k in range(n)] + [f"http://{allow}{k}.com/fr/{allow}/{k}" for k in range(n)]


def test_hosts_that_no_rule_decides_take_the_side_of_their_words(spark):
    """The same hosts change sides with what the rules say of their words."""
    new = ["http://www.orangewater.net/x", "http://stonehouse.net/x", None, "no scheme"]
    one = verdicts(spark, ruled("orange", "stone") + new)
    two = verdicts(spark, ruled("stone", "orange") + new)
    assert (one[80][0], one[81][0]) == ("block", "allow") and (two[80][0], two[81][0]) == ("allow", "block")
    assert one[82] == one[83] == ("allow", 0.0)


def test_a_class_without_an_example_leaves_all_allowed(spark):
    for urls in (["http://a.com/fr/x"] * 5, ["http://b.com/de/x"] * 5, ["http://c.net/"]):
        got = verdicts(spark, [*urls, "http://cheap-pills.net/buy"])
        assert got[len(urls)] == ("allow", 0.0)


def test_naive_bayes_equals_brute_force(spark):
    rows = [(f"green{'' if k % 3 else 'tea'}{k % 7}.shop", f"/page/{'sale' * (k % 2)}{k}", k % 4 == 0) for k in range(60)] + [("xqzv.shop", "/page/qqx", True), (None, "/page/1", False), ("a", "b", None)]
    df = spark.createDataFrame(rows, "host string, path string, block boolean")
    got = {(r["host"], r["path"]): r["j"]["block_score"] for r in df.withColumn("j", url_filter.fit(df)("host", "path")).collect()}
    segment = url_filter.Segmenter(url_filter.word_model())

    def words(h, p):
        out = set()
        for k, part in (("h", h or ""), ("p", p or "")):
            for w in segment(part):
                out.add((k, w if w in segment.model or w == "0" else f"#{zlib.crc32(w.encode()) % 65536:04x}"))
        return out

    given = {(h or "", p or "", b) for h, p, b in rows if b is not None}
    n = {b: [words(h, p) for h, p, c in given if c == b] for b in (True, False)}
    seen = {t for b in n for w in n[b] for t in w}
    kinds = {t for t in seen if sum(t in w for b in n for w in n[b]) <= 0.5 * len(given)}
    assert kinds and kinds != seen
    total = {b: sum(len(w & kinds) for w in n[b]) + len(kinds) for b in n}
    for h, p, b in rows:
        odds = math.log((len(n[True]) + 1) / (len(n[False]) + 1))
        for t in words(h, p) & kinds:
            odds += math.log((sum(t in w for w in n[True]) + 1) / total[True]) - math.log((sum(t in w for w in n[False]) + 1) / total[False])
        assert got[(h, p)] == pytest.approx(1 / (1 + math.exp(-odds)))


def test_words_of_all_scripts_and_percent_signs_are_features():
    segment = url_filter.Segmenter(url_filter.word_model())
    assert segment("пример.рф") == ["пример", "рф"] and segment("xn--e1afmkfd.xn--p1ai") == ["пример", "рф"]
    assert segment("/%D0%BA%D1%83%D0%BF%D0%B8/cheappills%20now") == ["купи", "cheap", "pills", "now"]
    assert segment("xn--\ud800.x%") and segment("/a%zz") == ["a", "zz"]
    assert segment("日本語2") == ["日本語", "0"]


def test_words_of_rules_are_features_of_no_row(spark):
    """A path word that a rule names decides nothing, though it is met in one class only."""
    urls = [f"http://stone{k}.example.org/es/{k}" for k in range(60)] + [f"http://stone{k}.example.org/fr/{k}" for k in range(60)]
    got = verdicts(spark, [*urls, "http://stone1.example.net/es/1", "http://stone1.example.net/fr/1"])
    assert got[120] == got[121] and got[120][0] == "allow"


def test_the_cut_comes_from_rows_held_back(spark):
    rows = [(f"{'orange' if k % 3 else 'stone'}{k}.x", f"/{k}", bool(k % 3)) for k in range(400)]
    judge, held = url_filter.calibrated(spark.createDataFrame(rows, "host string, path string, block boolean"))
    assert 60 < held.rows < 140 and held.accuracy == held.recall == held.precision == 1 and held.constant < 0.8 and 0 < held.cut < 1
    noise = [(f"stone{k}.x", f"/{k}", k % 3 == 0) for k in range(400)]
    held = url_filter.calibrated(spark.createDataFrame(noise, "host string, path string, block boolean"))[1]
    assert held.cut == 2 and held.constant >= held.accuracy


def test_best_cut_equals_brute_force():
    for seed in range(50):
        counts = {(k * 7 % 11, bool((k + seed) % (2 + seed % 9) > 2)): (k * seed) % 50 for k in range(11)}
        got = url_filter.best_cut(counts, 10)
        rows = [(k, b) for (k, b), n in counts.items() for _ in range(n)]
        right = {c: sum((k >= c) == b for k, b in rows) for c in range(1, 11)}
        block = sum(b for _, b in rows)
        one = max(block, len(rows) - block)
        best = max(right, key=lambda c: (right[c], -abs(2 * c - 10)))
        other = sum((k >= best) == (block <= len(rows) - block) for k, _ in rows)
        assert (got.cut == 2) == (right[best] - one <= 2 * math.sqrt(other))
        if got.cut <= 1:
            assert got.accuracy == right[best] / len(rows) and got.cut == best / 10
