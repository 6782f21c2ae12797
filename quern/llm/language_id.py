"""Language ID: per-language unigram probabilities of pieces, summed over all segmentations of each word."""

from __future__ import annotations

import math
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import give_back, remembered

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
START = "▁"  # the vocabulary's mark of a word's start
UNKNOWN = 0  # index of the piece that stands for a character outside the vocabulary
SHORT = 32  # letters of a word that is worth remembering


def words(text: str) -> list[str]:
    return LETTERS.findall(unicodedata.normalize("NFC", text).lower())


def vocabulary(path: str | None = None) -> dict[str, int]:
    """Lower-case pieces of letters of a public sentencepiece vocabulary, numbered from 1."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    letters = {p for p in found if p.removeprefix(START).isalpha() and p == p.lower()}
    return {p: k for k, p in enumerate(sorted(letters), 1)}


def with_prefixes(pieces: dict, beginning: object) -> dict:
    """``pieces`` and every beginning of one, so that a search can stop where no piece goes on."""
    return {p[:n]: beginning for p in pieces for n in range(1, len(p))} | pieces


class Lattice:
    """The ways to cut a word into pieces, as edges (from, to, piece)."""

    def __init__(self, pieces: dict[str, int]):
        self.pieces, self.longest = with_prefixes(pieces, UNKNOWN), max(map(len, pieces), default=1)

    def edges(self, word: str) -> list[tuple[int, int, int]]:
        s, get, out = START + word, self.pieces.get, []
        n = len(s)
        for i in range(n):
            if i == 1:
                continue  # the start mark is part of the first piece
            first = i + (2 if i == 0 else 1)
            single = get(s[i:first], UNKNOWN)
            out.append((i, first, single))
            for j in range(first + 1, min(n, i + self.longest) + 1):
                if (p := get(s[i:j])) is None:
                    break
                if p:
                    out.append((i, j, p))
        return out


def _shares(edges: list[tuple[int, int, int]], n: int, p: list[float], longest: int) -> Iterator[tuple[int, float]]:
    """Each edge's piece and its share of all cuts of a word of ``n`` places, by probability.

    Sums forth and back are kept within range in words of any length: ``forth`` and ``back`` hold, at
    each place, the sum times 2 to the power of minus ``fe`` or ``be`` there.
    """
    forth, back, fe, be = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    forth[0] = back[n] = 1.0
    if n <= 64:
        for i, j, k in edges:
            forth[j] += forth[i] * p[k]
        for i, j, k in reversed(edges):
            back[i] += back[j] * p[k]
    else:
        for sums, powers, order, at, to in ((forth, fe, edges, 0, 1), (back, be, edges[::-1], 1, 0)):
            last = None
            for e in order:
                x, y, q = e[at], e[to], p[e[2]]
                if x != last:  # all that comes to x is there
                    last = x
                    if sums[x]:
                        sums[x], more = math.frexp(sums[x])
                        powers[x] += more
                if not sums[y]:
                    powers[y] = powers[x]
                elif powers[y] < powers[x]:
                    sums[y], powers[y] = math.ldexp(sums[y], powers[y] - powers[x]), powers[x]
                sums[y] += math.ldexp(sums[x] * q, powers[x] - powers[y])
    if not (whole := forth[n]):
        return
    for i, j, k in edges:
        yield k, math.ldexp(forth[i] * p[k] * back[j] / whole, fe[i] + be[j] - fe[n])


def learn(counts: dict[str, dict[str, int]], pieces: dict[str, int], rounds: int = 3, prior: float = 0.02) -> tuple[list[str], dict[int, tuple[float, ...]]]:
    """Languages, and each piece's probability in each: expectation maximisation over all segmentations.

    ``counts``: word counts by language. ``prior`` is added to every piece's expected
    count, so no piece is impossible in a language.
    """
    lattice, langs = Lattice(pieces), sorted(counts)
    tables = []
    for lang in langs:
        edges = [(lattice.edges(w), len(w) + 1, c) for w, c in sorted(counts[lang].items())]
        p = [1.0 / (len(pieces) + 1)] * (len(pieces) + 1)
        for _ in range(rounds):
            expected = [prior] * len(p)
            for es, n, c in edges:
                for k, share in _shares(es, n, p, lattice.longest):
                    expected[k] += c * share
            total = sum(expected)
            p = [e / total for e in expected]
        tables.append(p)
    return langs, {k: tuple(t[k] for t in tables) for k in range(len(pieces) + 1)}


class Places(dict):
    """Words to their rows of a table; a word not met before gets the next row and is listed as fresh."""

    def __init__(self):
        super().__init__()
        self.rows, self.fresh = 0, []

    def __missing__(self, word: str) -> int:
        self[word] = row = self.rows
        self.rows += 1
        self.fresh.append(word)
        return row


class Scorer:
    """Log probability of a word in every language by the forward algorithm, with a bounded memory of words."""

    def __init__(self, pieces: dict[str, int], probabilities: dict[int, tuple[float, ...]], n_langs: int, keep: int = 200_000):
        self.n, self.keep, self.places, self.values = n_langs, keep, Places(), np.empty((1 << 16, n_langs))
        self.at, self.longest = with_prefixes(pieces, UNKNOWN), max(map(len, pieces), default=1)
        self.table = np.array([probabilities[k] for k in range(len(probabilities))])
        self.rows = [tuple(r) for r in self.table.tolist()]
        self.search = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p, k in pieces.items():
            self.search.add_word(p, len(p) << 24 | k)
        self.search.make_automaton()

    def word(self, word: str) -> tuple[float, ...]:
        s, get, longest, langs = START + word, self.at.get, self.longest, range(self.n)
        n, shift = len(s), [0.0] * self.n
        forth: list[list[float] | None] = [None] * (n + 1)
        forth[0] = [1.0] * self.n
        for i in range(n):
            here = forth[i]
            if here is None:
                continue
            forth[i] = None
            first = i + (2 if i == 0 else 1)
            for j in range(first, min(n, i + longest) + 1):
                k = get(s[i:j])
                if not k and j > first:
                    if k is None:
                        break
                    continue
                p, to = self.rows[k or UNKNOWN], forth[j]
                if to is None:
                    forth[j] = [a * b for a, b in zip(here, p)]  # noqa: B905
                else:
                    forth[j] = [t + a * b for t, a, b in zip(to, here, p)]  # noqa: B905
            if i % 24 == 23:  # keep long words' sums within range
                for k in langs:
                    top = max(f[k] for f in forth[i + 1 : i + longest + 1] if f is not None)
                    shift[k] += math.log(top)
                    for f in forth[i + 1 : i + longest + 1]:
                        if f is not None:
                            f[k] /= top
        return tuple(math.log(forth[n][k]) + shift[k] for k in langs)

    def many(self, new: list[str]) -> np.ndarray:
        """:meth:`word` of many words at once: one search finds the pieces in all of them, then the sums go from each start position of all words at a time."""
        joined = "\n".join([START + w for w in new])
        size = np.array([len(w) + 2 for w in new])
        base = np.cumsum(size) - size
        offset = np.arange(len(joined) + 1) - np.repeat(base, size)
        found = np.array(list(self.search.iter(joined)), dtype="int64").reshape(-1, 2)
        ends, length, pieces = found[:, 0] + 1, found[:, 1] >> 24, found[:, 1] & 0xFFFFFF
        # a letter that is no piece is the unknown one; the first letter goes with the start mark
        alone = offset > 1
        alone[base + size - 1] = False
        alone[(ends - 1)[length == 1]] = False
        alone[base] = True
        alone[(ends - 2)[(length == 2) & (offset[ends - 2] == 0)]] = False
        lone = np.flatnonzero(alone)
        starts = np.concatenate([ends - length, lone])
        ends = np.concatenate([ends, np.where(offset[lone] == 0, lone + 2, lone + 1)])
        pieces = np.concatenate([pieces, np.full(len(lone), UNKNOWN)])
        order = np.argsort(offset[starts], kind="stable")
        starts, ends, pieces = starts[order], ends[order], pieces[order]
        forth = np.zeros((len(joined) + 1, self.n))
        forth[base] = 1.0
        cuts = np.searchsorted(offset[starts], np.arange(size.max() + 1))
        for i in range(len(cuts) - 1):
            e = slice(cuts[i], cuts[i + 1])
            forth[ends[e]] += forth[starts[e]] * self.table[pieces[e]]  # a word's pieces from i end at different places
        return np.log(forth[base + size - 1])

    def texts(self, found: list[list[str]]) -> np.ndarray:
        """Each text's log probability in every language, a row each, from its words; each has one at least."""
        rows = np.fromiter(map(self.places.__getitem__, chain.from_iterable(found)), dtype="int64", count=sum(map(len, found)))
        fresh, self.places.fresh = self.places.fresh, []
        first = self.places.rows - len(fresh)
        if self.places.rows > len(self.values):
            self.values = np.concatenate([self.values[:first], np.empty((2 * self.places.rows - first, self.n))])
        long = np.array([len(w) > SHORT for w in fresh], dtype=bool)
        short = np.flatnonzero(~long)
        for k in range(0, len(short), 5000):
            at = short[k : k + 5000]
            self.values[first + at] = self.many([fresh[i] for i in at.tolist()])
        for i in np.flatnonzero(long).tolist():
            self.values[first + i] = self.word(fresh[i])
            del self.places[fresh[i]]
        ends = np.cumsum(list(map(len, found)))
        out = np.add.reduceat(self.values[rows], np.concatenate([[0], ends[:-1]]), axis=0)
        if self.places.rows > self.keep:
            self.places = Places()
        return out


def held_out(id_col: str) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(4)) == 2


def _scorer(name: str, shipped: Broadcast, n_langs: int) -> Scorer | None:
    """The model's scorer, kept over this worker's tasks with the words that it has met."""
    return remembered(f"language {name}", lambda: Scorer(*shipped.value, n_langs)) if n_langs else None


def fit(
    training: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    vocabulary_path: str | None = None,
    sample_chars: int = 400_000,
) -> Callable[[Column], Column]:
    """A function of a text column to a struct column (lang_pred string, score double).

    The model is fitted on whole texts of ``training`` with a language and an id, from
    each language a share of rows, picked by a hash of the id, of ``sample_chars`` code
    points on average, and always the row of smallest hash that has a letter, so that a
    language of a few very long texts is learned too: the bound on what reaches the driver. Words are runs of letters,
    lower-cased; a word's probability in a language is the sum over all its cuts into
    pieces of the vocabulary, a text's the product over its words. ``score`` is the share
    of the best language among all (equal priors); ties go to the first by name.

    Null text, text without a letter, or nothing to learn from: ``und`` with score 0. The
    function's ``languages`` are those learned.
    Texts of any length are read whole; rows are judged one by one, so null ids, repeated
    rows, empty tables and other columns make no difference.
    """
    spark = training.sparkSession
    labelled = training.filter(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("t")
    )
    place = F.struct(F.pmod(F.xxhash64("i"), F.lit(1 << 20)).alias("bucket"), F.xxhash64("i").alias("hash"))
    sizes = labelled.groupBy("lang").agg(F.sum(F.length("t")).alias("n"), F.min(F.when(F.col("t").rlike(r"\p{L}"), place)).alias("least")).filter("n > 0").collect()
    share = spark.createDataFrame([(r["lang"], min(1.0, sample_chars / r["n"]), r["least"] and r["least"]["hash"]) for r in sizes], "lang string, share double, least long")
    picked = labelled.join(F.broadcast(share), "lang").filter((F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < F.col("share") * (1 << 20)) | (F.xxhash64("i") == F.col("least")))
    counted = picked.select("lang", "t").mapInPandas(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for r in counted.collect():
        counts.setdefault(r["lang"], {})[r["word"]] = r["n"]
    pieces = vocabulary(vocabulary_path)
    langs, probabilities = learn(counts, pieces) if counts else ([], {})
    shipped = spark.sparkContext.broadcast((pieces, probabilities))  # vocabulary size times languages
    name = uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _scorer(name, shipped, len(langs))
        for texts in batches:
            said = [("und", 0.0)] * len(texts)
            for some in _in_turn(texts if scorer else []):
                totals = scorer.texts(list(some.values()))
                best = totals.argmax(axis=1)
                shares = np.exp(np.maximum(totals - totals.max(axis=1, keepdims=True), -700.0)).sum(axis=1)
                for k, b, whole in zip(some, best.tolist(), shares.tolist(), strict=True):
                    said[k] = (langs[b], 1.0 / whole)
            yield pd.DataFrame(said, columns=["lang_pred", "score"])
        give_back()

    once = predict.asNondeterministic()  # or a filter on its result would call it a second time
    once.languages = tuple(langs)
    return once


def _in_turn(texts: Iterable[str | None], most: int = 60_000) -> Iterator[dict[int, list[str]]]:
    """Words of the texts that have any, by position, for ``most`` words or one text at a time."""
    some: dict[int, list[str]] = {}
    n = 0
    for k, text in enumerate(texts):
        if text and (found := words(text)):
            some[k] = found
            n += len(found)
            if n >= most:
                yield some
                some, n = {}, 0
    if some:
        yield some


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        n: Counter[tuple[str, str]] = Counter()
        for lang, text in zip(pdf["lang"], pdf["t"], strict=True):
            n.update((lang, w) for w in words(text))
        yield pd.DataFrame([(a, b, c) for (a, b), c in n.items()], columns=["lang", "word", "n"])
