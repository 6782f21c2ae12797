"""URL filters: rules by host and path, and a naive Bayes verdict over segmented host and path words.

The urls that a rule decides are the labelled rows. Words that any rule names are features of no url, labelled or not, so naive Bayes learns from and
judges by the same kind of words. A part of the labelled urls is held back: from it comes the cut above which a url is blocked, and
whether there is one. Where no cut does better on it than one verdict for all, what the rules say does not carry over to other urls, and none of them is blocked.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import unquote

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, remembered

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end. Empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict): the longest rule whose host is the host or a domain above it and whose path begins the path; null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, say in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last that fits wins
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def word_model(path: str | None = None) -> dict[str, float]:
    """Log probability of whole words of a public vocabulary, whose order is that of merging: the k-th weighs 1 / k."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    end = "</w>"
    words = sorted((k, w.removesuffix(end)) for w, k in vocab.items() if w.endswith(end))
    words = [w for _, w in words if w.isascii() and w.isalpha() and (len(w) > 2 or w in {"a", "i", "an", "at", "be", "by", "do", "go", "in", "is", "it", "me", "my", "no", "of", "on", "or", "to", "up", "us", "we", "tv"})]
    total = math.log(sum(1 / k for k in range(1, len(words) + 1)))
    return {w: -math.log(k) - total for k, w in enumerate(words, 1)}


def viterbi(name: str, model: dict[str, float], longest: int, unknown: float = -14.0) -> list[str]:
    """The likeliest cut of ``name`` into words; a letter outside every word costs ``unknown``, and letters outside that touch make one piece."""
    n = len(name)
    best, came = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        for i in range(max(0, j - longest), j):
            p = model.get(name[i:j], unknown if j - i == 1 else None)
            if p is not None and best[i] + p > best[j]:
                best[j], came[j] = best[i] + p, i
    out, j = [], n
    while j:
        out.append(name[came[j] : j])
        j = came[j]
    joined: list[str] = []
    odd = False
    for w in reversed(out):
        if w in model:
            joined.append(w)
            odd = False
        elif odd:
            joined[-1] += w
        else:
            joined.append(w)
            odd = True
    return joined


class Segmenter:
    """Words of a host and path: runs of letters, of any script, are cut by Viterbi, digits become one mark; runs met before are remembered.

    Percent signs are decoded, and a host's label in ASCII form of another script too. Letters outside the vocabulary's make one word as far as they touch.
    """

    RUNS = re.compile(r"[^\W\d_]+|\d+")

    @staticmethod
    def plain(part: str) -> str:
        if "%" in part:
            part = unquote(part, errors="replace")
        if "xn--" in part:
            labels = []
            for label in part.split("."):
                try:
                    labels.append(label.encode("ascii").decode("idna") if label.startswith("xn--") else label)
                except UnicodeError:
                    labels.append(label)
            part = ".".join(labels)
        return part.lower()

    def __init__(self, model: dict[str, float], keep: int = 200_000):
        self.model, self.longest, self.keep, self.known = model, max(map(len, model)), keep, {}

    def __call__(self, part: str) -> list[str]:
        out: list[str] = []
        for run in self.RUNS.findall(self.plain(part)):
            if run[0].isdigit():
                out.append("0")
                continue
            if (cut := self.known.get(run)) is None:
                cut = viterbi(run, self.model, self.longest)
                if len(run) <= 64:
                    if len(self.known) >= self.keep:
                        self.known.clear()
                    self.known[run] = cut
            out += cut
        return out


def _segmenter(path: str | None) -> Segmenter:
    """This Python worker's segmenter, kept over its tasks."""
    return remembered(f"words {path}", lambda: Segmenter(word_model(path)))


def rule_words(segment: Segmenter, rules: tuple[tuple[str, str], ...]) -> frozenset[str]:
    """The tokens that rules name, of hosts and of paths."""
    parts = [r.partition("/") for r, _ in rules]
    return frozenset(t for domain, _, rest in parts for t in tokens(segment, domain, rest))


def tokens(segment: Segmenter, host: str, path: str) -> list[str]:
    """``h:`` words of the host and ``p:`` words of the path, each once, so that one very long url does not outweigh the rest.

    A word that the vocabulary lacks is one of 65,536 marks by its hash, so there are no more kinds than that and the vocabulary's words, twice.
    """
    known = segment.model
    return sorted({f"{k}:{w if w in known or w == '0' else f'#{zlib.crc32(w.encode()) & 0xFFFF:04x}'}" for k, part in (("h", host), ("p", path)) for w in segment(part)})


def weights(counts: tuple[dict[str, int], dict[str, int]], rows: tuple[int, int], common: float) -> tuple[dict[str, float], float]:
    """Each token's log odds of block against allow, and the prior's, by multinomial naive Bayes with one added to every count.

    ``counts`` and ``rows`` are those of allow and block. A token in more than the share ``common`` of the rows is a stop word.
    """
    found = (rows[0] + rows[1]) * common
    kinds = {t for c in counts for t in c if counts[0].get(t, 0) + counts[1].get(t, 0) <= found}
    whole = [sum(n for t, n in c.items() if t in kinds) + len(kinds) for c in counts]
    return {t: math.log((counts[1].get(t, 0) + 1) / whole[1]) - math.log((counts[0].get(t, 0) + 1) / whole[0]) for t in kinds}, math.log((rows[1] + 1) / (rows[0] + 1))


def fit(examples: DataFrame, *, vocabulary_path: str | None = None, max_rows: int = 200_000, common: float = 0.5, rules: tuple[tuple[str, str], ...] = ()) -> Callable[[Column, Column], Column]:
    """A function of host and path columns to a struct column (verdict, block_score double, words string).

    Multinomial naive Bayes, fitted on ``max_rows`` distinct rows of ``examples`` (host, path, block boolean) on average, picked by
    a hash of host and path. Counts per word and class are summed in Spark; what reaches the driver are two rows per kind of token at most.
    Words in more than the share ``common`` of those rows are stop words, and so are those that ``rules`` name. ``block_score`` is the posterior of block; above
    one half the verdict is ``block``. Words never met in an example weigh nothing. No words: allow, score 0.

    Null host or path: empty; null block: no example. Without an example of either class nothing tells how their words differ: allow, score 0.
    """
    spark = examples.sparkSession
    given = examples.filter("block is not null").select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("host", "path")], "block")
    n = given.count()
    distinct = given.filter(F.pmod(F.xxhash64("host", "path"), F.lit(1 << 20)) < min(1.0, max_rows / max(1, n)) * (1 << 20)).distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment = _segmenter(vocabulary_path)
        named = rule_words(segment, rules)
        for pdf in batches:
            met: Counter[tuple[str, int]] = Counter()
            for h, p, b in zip(pdf["host"], pdf["path"], pdf["block"], strict=True):
                met.update((t, int(b)) for t in [*tokens(segment, h, p), ""] if t not in named)
            yield pd.DataFrame([(t, b, k) for (t, b), k in met.items()], columns=["token", "block", "n"])

    counted = distinct.mapInPandas(count, "token string, block int, n long").groupBy("token", "block").agg(F.sum("n").alias("n"))
    counts: tuple[dict[str, int], dict[str, int]] = ({}, {})
    for r in counted.collect():  # two rows per kind of token at most
        counts[r["block"]][r["token"]] = r["n"]
    rows = tuple(c.pop("", 0) for c in counts)
    learned = all(rows)
    shipped: Broadcast = spark.sparkContext.broadcast(weights(counts, rows, common) if learned else ({}, 0.0))

    @F.pandas_udf("verdict string, block_score double, words string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        segment = _segmenter(vocabulary_path)
        weigh, prior = shipped.value
        named = rule_words(segment, rules)
        for hosts, paths in batches:
            said = []
            for h, p in zip(hosts.fillna(""), paths.fillna(""), strict=True):
                found = [t for t in tokens(segment, h, p) if t not in named]
                odds = prior + math.fsum(weigh.get(t, 0.0) for t in found)
                score = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds)))) if found and learned else 0.0
                said.append(("block" if score > 0.5 else "allow", score, " ".join(segment(h))))
            yield pd.DataFrame(said, columns=["verdict", "block_score", "words"])

    return judge


class HeldBack(NamedTuple):
    """What a fit does on labelled urls that it has not seen: rows, share of right verdicts with ``cut`` and with the better single verdict, recall and precision of block."""

    rows: int
    accuracy: float
    constant: float
    recall: float
    precision: float
    #: Urls whose score reaches it are blocked; 2 (none is) where no cut beats the single verdict by more than chance does.
    cut: float


def best_cut(counts: dict[tuple[int, bool], int], parts: int) -> HeldBack:
    """The cut between ``parts`` steps of the score with most right verdicts; of several that nearest to one half. ``counts``: rows by (step, block).

    It has to beat the better single verdict by more than chance does: where the two differ, by two standard deviations of a coin's throws.
    """
    n = [sum(v for (_, b), v in counts.items() if b == side) for side in (False, True)]
    rows = sum(n)
    allowed, found = [0] * (parts + 2), [0] * (parts + 2)  # rows below each step
    for k in range(parts + 1):
        allowed[k + 1] = allowed[k] + counts.get((k, False), 0)
        found[k + 1] = found[k] + counts.get((k, True), 0)
    best = max(range(1, parts + 1), key=lambda k: (allowed[k] + n[1] - found[k], -abs(2 * k - parts)))
    right = allowed[best] + n[1] - found[best]
    other = (n[0] - allowed[best] + n[1] - found[best]) if n[0] >= n[1] else allowed[best] + found[best]  # rows that it judges otherwise
    if not rows or right - max(n) <= 2 * math.sqrt(other):
        return HeldBack(rows, n[0] / max(rows, 1), max(n) / max(rows, 1), 0.0, 0.0, 2.0)
    hit, said = n[1] - found[best], rows - allowed[best] - found[best]
    return HeldBack(rows, right / rows, max(n) / rows, hit / max(n[1], 1), hit / max(said, 1), best / parts)


def calibrated(examples: DataFrame, *, parts: int = 1000, one_in: int = 4, **fitting) -> tuple[Callable[[Column, Column], Column], HeldBack]:
    """(judge, held back): a fit (:func:`fit`) on the examples but one in ``one_in``, by a hash of the url, and its best cut on those.

    What reaches the driver are two numbers for each of ``parts`` steps of the score.
    """
    kept = F.pmod(F.xxhash64(F.lit("held"), F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))), F.lit(one_in)) == 0
    judge = fit(examples.filter(~kept), **{"common": 0.9} | fitting)
    held = examples.filter(kept & F.col("block").isNotNull()).distinct().withColumn("score", judge("host", "path")["block_score"])
    step = F.least(F.floor(F.col("score") * parts), F.lit(parts)).cast("int")
    counts = {(r["step"], r["block"]): r["n"] for r in held.groupBy(step.alias("step"), "block").agg(F.count("*").alias("n")).collect()}
    return judge, best_cut(counts, parts)


def url_verdicts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, **fitting) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score, words, held_accuracy, held_constant, cut: a row per page.

    A rule decides where one fits (:func:`rule_of`), and such rows are the examples; else the fitted method decides (:func:`calibrated`): block from
    ``cut`` on. ``block_score`` is the method's in either case; the last three columns are those of :class:`HeldBack`. Null url, or one without ``://``: empty
    host and path, no rule, allow. Urls of any length and script are read whole; repeated rows pass one
    for one. Empty table: empty result; other columns are ignored.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_path(F.col("url"))
    split = urls.select("page_id", host.alias("host"), path.alias("path"))
    rule, say = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.select("page_id", "host", "path", rule.alias("rule"), say.alias("say"))
    judge, held = calibrated(ruled.filter("rule is not null").select("host", "path", (F.col("say") == "block").alias("block")), rules=rules, **fitting)
    judged = ruled.withColumn("j", judge("host", "path"))
    verdict = F.coalesce("say", F.when(F.col("j.block_score") >= held.cut, "block").otherwise("allow"))
    return judged.select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "j.block_score", "j.words",
        F.lit(held.accuracy).alias("held_accuracy"), F.lit(held.constant).alias("held_constant"), F.lit(held.cut).alias("cut"),
    )
