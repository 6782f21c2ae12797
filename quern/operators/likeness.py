"""Exact joins at a difflib ratio: an index of letters bounds 2M/T, so that the ratio itself runs on few pairs and no cross product is needed.

The ratio of two texts is twice the letters that match over all letters. No more can match than the letters they share, so a pair at a ratio
shares so many of its letters (each occurrence for itself) that the rarest few of one meet the rarest few of the other, and lengths differ little.
Null and empty texts are like nothing; equal rows count once; ids are distinct. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.sources.scratch import settled


def plain_label(c: Column) -> Column:
    """Lower case, anything but a-z, 0-9 and spaces to spaces, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " "), " +", " "))


def _letters(t: Column) -> Column:
    """Each letter with its number among its equals so far, as an array."""
    def nth(i: Column) -> Column:
        upto, letter = F.substr(t, F.lit(1), i), F.substr(t, i, F.lit(1))
        return F.concat(letter, F.lit("#"), F.length(upto) - F.length(F.replace(upto, letter, F.lit(""))))

    return F.transform(F.sequence(F.lit(1), F.length(t)), nth)


def ratio_pairs(left: DataFrame, right: DataFrame | None = None, *, least: float) -> DataFrame:
    """a, b, ratio: pairs of texts (id, text) whose difflib ratio is ``least`` (above 0) or more; of ``left`` and ``right``, or within ``left`` once each with a < b.

    A letter that is frequent in all texts is a key of few rows, since each row is indexed by its rarest letters only.
    """
    if not 0 < least <= 1:
        raise ValueError("least has to be above 0 and 1 at most")

    def indexed(df: DataFrame, name: str) -> DataFrame:
        t = df.filter("id is not null and text <> ''").select("id", "text").distinct()
        return settled(t.select("id", "text", F.length("text").alias("n"), _letters(F.col("text")).alias("letters")), name)

    one = indexed(left, "letters")
    two = one if right is None else indexed(right, "letters")
    every = one if right is None else one.select("letters").unionByName(two.select("letters"))
    df = every.select(F.explode("letters").alias("w")).groupBy("w").agg(F.count("*").alias("df"))

    def keys(side: DataFrame) -> DataFrame:
        need = F.ceil(least * (F.col("n") + F.ceil(F.col("n") * (least / (2 - least)) - 1e-9)) / 2 - 1e-9)  # of its letters, shared with the shortest partner
        own = side.select("id", "n", F.explode("letters").alias("w")).join(df, "w").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("ws"))
        return own.select("id", "n", F.posexplode(F.slice("ws", F.lit(1), (F.col("n") - need + 1).cast("int"))).alias("pos", "k")).select("id", "n", "pos", F.col("k.w").alias("w"))

    a = keys(one)
    b = (a if right is None else keys(two)).select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("pos").alias("pos_b"), "w")
    enough = least * (F.col("n") + F.col("m")) / 2 - 1e-9
    fits = (F.least("n", "m") >= enough) & (F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("pos_b")) >= enough)
    near = a.join(b, "w").filter(fits & (F.col("id") < F.col("b")) if right is None else fits).select(F.col("id").alias("a"), "b").distinct()
    side = lambda s, i: s.select(F.col("id").alias(i), F.col("text").alias(f"t{i}"), F.col("letters").alias(f"l{i}"))
    j = near.join(side(one, "a"), "a").join(side(two, "b"), "b")
    most = 2.0 * F.size(F.array_intersect("la", "lb")) / (F.size("la") + F.size("lb"))
    return j.filter(most >= least - 1e-9).select("a", "b", tx.ratio(F.col("ta"), F.col("tb")).alias("ratio")).filter(F.col("ratio") >= least)


def contained_pairs(texts: DataFrame, *, least: int = 4) -> DataFrame:
    """a, b: texts (id, text) where that of ``a``, of ``least`` characters or more, stands within that of ``b`` and is shorter. They meet by its first characters, at any place of the longer one."""
    t = texts.filter(F.col("id").isNotNull() & (F.length("text") >= least)).select("id", "text").distinct()
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - least + 1), lambda i: F.substr("text", i, F.lit(least))))
    long = t.select(F.col("id").alias("b"), F.col("text").alias("tb"), F.explode(runs).alias("k"))
    short = t.select(F.col("id").alias("a"), F.col("text").alias("ta"), F.left("text", F.lit(least)).alias("k"))
    return short.join(long, "k").filter((F.length("ta") < F.length("tb")) & F.col("tb").contains(F.col("ta"))).select("a", "b")


def near_labels(labels: DataFrame, *, least: float = 0.86) -> DataFrame:
    """a, b, why: pairs of labels (label), a < b, whose plain forms (:func:`plain_label`) are equal, stand one within the other (4 characters or more), or have a difflib ratio of ``least`` or more."""
    own = settled(labels.filter("label is not null").select("label", plain_label(F.col("label")).alias("form")).distinct(), "labels")
    forms = own.filter("form <> ''").select(F.col("form").alias("id"), F.col("form").alias("text")).distinct()
    pairs = contained_pairs(forms).select("a", "b", F.lit("contained").alias("why")).unionByName(ratio_pairs(forms, least=least).select("a", "b", F.lit("alike").alias("why")))
    x, y = own.select(F.col("form").alias("a"), F.col("label").alias("la")), own.select(F.col("form").alias("b"), F.col("label").alias("lb"))
    found = pairs.join(x, "a").join(y, "b").select("la", "lb", "why")
    same = x.join(y.withColumnRenamed("b", "a"), "a").filter("la < lb and a <> ''").select("la", "lb", F.lit("equal").alias("why"))
    both = found.unionByName(same).select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"), "why")
    return both.groupBy("a", "b").agg(F.max("why").alias("why"))


def close_matches(words: DataFrame, known: DataFrame, *, n: int = 3, least: float = 0.6) -> DataFrame:
    """word, match, ratio, rank: the ``n`` texts of ``known`` (text) most like each word (word), as difflib's close matches: the match's ratio to the word, ties to the greater text."""
    w, k = words.select(F.col("word").alias("id"), F.col("word").alias("text")), known.select(F.col("text").alias("id"), "text")
    near = ratio_pairs(k, w, least=least)
    place = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("ratio"), F.desc("a")))
    return near.withColumn("rank", place).filter(F.col("rank") <= n).select(F.col("b").alias("word"), F.col("a").alias("match"), "ratio", "rank")


def similar_variants(items: DataFrame, *, least: float = 0.85) -> DataFrame:
    """a, b, ratio: pairs of items (item, variants array), a < b, with the best difflib ratio over their variants' plain forms, where it is ``least`` or more; 4 places."""
    own = items.select("item", F.explode("variants").alias("v")).select("item", plain_label(F.col("v")).alias("form")).filter("form <> ''").distinct()
    own = settled(own, "variants")
    forms = own.select(F.col("form").alias("id"), F.col("form").alias("text")).distinct()
    near = ratio_pairs(forms, least=least)
    same = forms.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("ratio"))
    pairs = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "ratio")).unionByName(same)
    j = own.withColumnRenamed("form", "a").join(pairs, "a").join(own.select(F.col("item").alias("other"), F.col("form").alias("b")), "b").filter("item < other")
    return j.groupBy(F.col("item").alias("a"), F.col("other").alias("b")).agg(F.round(F.max("ratio"), 4).alias("ratio"))


def governed_match(entries: DataFrame, catalogue: DataFrame, *, yes: float = 0.92, candidate: float = 0.80) -> DataFrame:
    """entry, governed, score (4 places), state for entries (entry, names array) and a catalogue (key, names array): the catalogue's key whose names are most like one of the entry's, in lower case.

    state: ``yes`` from ``yes`` on, ``candidate`` from ``candidate`` on, else ``no`` with neither key nor score. Of equal scores the greatest key.
    """
    one = entries.select("entry", F.explode("names").alias("n")).select("entry", F.lower("n").alias("x")).distinct()
    two = catalogue.select("key", F.explode("names").alias("n")).select("key", F.lower("n").alias("y")).distinct()
    as_text = lambda df, c: df.select(F.col(c).alias("id"), F.col(c).alias("text")).distinct()
    near = ratio_pairs(as_text(one, "x"), as_text(two, "y"), least=candidate)
    best = one.join(near.withColumnRenamed("a", "x"), "x").join(two.withColumnRenamed("y", "b"), "b").groupBy("entry").agg(F.max(F.struct(F.round("ratio", 4).alias("score"), F.col("key").alias("key"))).alias("m"))
    state = F.when(F.col("m.score") >= yes, "yes").when(F.col("m.score").isNotNull(), "candidate").otherwise("no")
    return entries.select("entry").distinct().join(best, "entry", "left").select("entry", F.col("m.key").alias("governed"), F.col("m.score").alias("score"), state.alias("state"))


def label_clusters(labels: DataFrame, *, least: float = 0.86) -> DataFrame:
    """label, group, size: labels (label) joined by :func:`near_labels`; labels near none are left out."""
    from quern.operators.taxonomy import label_groups

    return label_groups(labels, near_labels(labels, least=least).select("a", "b"))


def ratio_sql(pairs: str) -> str:
    """CTEs of the ratio in SQL: from the relation ``pairs`` (x, y, tx, ty) to ``ratios`` (x, y, ratio), by the same splitting at the longest match, the first of several in x and then in y.

    Needs WITH RECURSIVE. For texts below 200 characters.
    """
    return f"""hit AS MATERIALIZED (
  SELECT x, y, i, j, count(*) OVER (PARTITION BY x, y, i - j, g) - row_number() OVER (PARTITION BY x, y, i - j, g ORDER BY i) + 1 AS n
  FROM (SELECT *, i - row_number() OVER (PARTITION BY x, y, i - j ORDER BY i) AS g
    FROM (SELECT x, y, i, j FROM {pairs}, unnest(range(0, length(tx))) u(i), unnest(range(0, length(ty))) v(j) WHERE substr(tx, i + 1, 1) = substr(ty, j + 1, 1)))
), part AS (
  SELECT x, y, 0::BIGINT AS a, length(tx)::BIGINT AS b, 0::BIGINT AS c, length(ty)::BIGINT AS d, 0::BIGINT AS n FROM {pairs}
  UNION ALL
  SELECT x, y, u.k.a, u.k.b, u.k.c, u.k.d, u.k.n FROM (
    SELECT part.x, part.y, a, b, c, d, min((-least(hit.n, b - i, d - j), i, j)) AS m FROM part JOIN hit ON part.x = hit.x AND part.y = hit.y AND i >= a AND i < b AND j >= c AND j < d
    WHERE part.n = 0 GROUP BY part.x, part.y, a, b, c, d
  ) q, unnest([{{'a': a, 'b': m[2], 'c': c, 'd': m[3], 'n': 0::BIGINT}}, {{'a': m[2] - m[1], 'b': b, 'c': m[3] - m[1], 'd': d, 'n': 0::BIGINT}}, {{'a': 0::BIGINT, 'b': 0::BIGINT, 'c': 0::BIGINT, 'd': 0::BIGINT, 'n': -m[1]}}]) u(k)
  WHERE (u.k.a < u.k.b AND u.k.c < u.k.d) OR u.k.n > 0
), ratios AS (
  SELECT p.x, p.y, 2.0::DOUBLE * coalesce(s.n, 0) / (length(p.tx) + length(p.ty)) AS ratio FROM {pairs} p LEFT JOIN (SELECT x, y, sum(n)::DOUBLE AS n FROM part GROUP BY x, y) s ON p.x = s.x AND p.y = s.y
)"""
