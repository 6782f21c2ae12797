"""Metric marts: collision policies, latest report wins, restatements, roll-ups, ratios, coverage, history.

Facts are long rows: family, metric, grain, entity, month (``yyyy-MM``), value, source_file, reported_in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import header, is_dimension_value, title_runs
from quern.sources.scratch import dealt

KEY = ["family", "metric", "grain", "entity", "month"]
POLICIES = ("last", "first", "max", "min", "sum", "mean", "weighted_mean", "error")


def vintage() -> Column:
    """Order of reports: by the month reported in (undated first), then by file name."""
    return F.struct(F.coalesce("reported_in", F.lit("")).alias("at"), F.col("source_file"))


def resolve_collisions(rows: DataFrame, policies: dict[str, str], weight_metric: str | None = None, default: str = "last") -> DataFrame:
    """One row per KEY and source_file with policy, n_rows and value, from rows with ``_row`` (their row in the file).

    Several rows of one file under one key are reduced by the metric's policy. ``weighted_mean``
    weighs each value by ``weight_metric`` of the same source row, leaving out pairs without a value
    or with a weight that is missing or not above 0; without any pair, and for
    ``error``, the collision is unresolved and the last row stays.
    """
    if bad := {default, *policies.values()} - set(POLICIES):
        raise ValueError(f"unknown policies: {sorted(bad)}")
    policy = F.lit(default)
    for metric, name in policies.items():
        policy = F.when(F.col("metric") == metric, F.lit(name)).otherwise(policy)
    where = ["family", "grain", "entity", "month", "source_file"]
    if weight_metric:
        # the row's weight rides along in a window over the file's row, no self-join; so many parts that the sort and the row numbers of one stay small
        rows = dealt(rows, rows.count(), *where[2:], "_row", each=1_000_000)
        weight = F.max(F.when(F.col("metric") == weight_metric, F.col("value"))).over(Window.partitionBy(*where, "_row"))
        rows = rows.withColumn("_weight", weight)
    else:
        rows = rows.withColumn("_weight", F.lit(None).cast("double"))
    pair = F.col("value").isNotNull() & (F.col("_weight") > 0)
    grouped = rows.groupBy(*KEY, "source_file").agg(
        F.countDistinct("_row").alias("n_rows"),
        F.max_by("value", "_row").alias("v_last"), F.min_by("value", "_row").alias("v_first"),
        F.max("value").alias("v_max"), F.min("value").alias("v_min"), F.sum("value").alias("v_sum"), F.avg("value").alias("v_mean"),
        F.try_divide(F.sum(F.when(pair, F.col("value") * F.col("_weight"))), F.sum(F.when(pair, F.col("_weight")))).alias("v_weighted"),
    ).withColumn("policy", policy)
    p, many = F.col("policy"), F.col("n_rows") > 1
    value = F.col("v_last")
    for name, col in (("first", "v_first"), ("max", "v_max"), ("min", "v_min"), ("sum", "v_sum"), ("mean", "v_mean"), ("weighted_mean", "v_weighted")):
        value = F.when(p == name, F.coalesce(F.col(col), F.col("v_last"))).otherwise(value)
    open_ = many & ((p == "error") | ((p == "weighted_mean") & F.col("v_weighted").isNull()))
    return grouped.select(*KEY, "source_file", "policy", "n_rows", F.when(many, value).otherwise(F.col("v_last")).alias("value"), open_.alias("unresolved"))


def latest_wins(facts: DataFrame) -> DataFrame:
    """The last report of each key in vintage order: one hash aggregation, no sort of the whole table."""
    rest = [c for c in facts.columns if c not in KEY]
    best = F.max_by(F.struct(*rest), vintage())
    return facts.groupBy(*KEY).agg(best.alias("f")).select(*KEY, *[f"f.{c}" for c in rest])


def restatements(facts: DataFrame) -> DataFrame:
    """Earlier values of keys that were reported with more than one value (rounded to 9 places).

    A row per key and earlier value, from the first file that reported it: value, source_file, reported_in,
    current_value, kind. The change is ``restated`` if every earlier vintage is dated and before the current one, else ``conflict``.
    """
    rounded = facts.withColumn("r", F.bround("value", 9))
    by_value = rounded.groupBy(*KEY, "r").agg(F.min_by(F.struct("value", "source_file", "reported_in"), vintage()).alias("f"), F.max(vintage()).alias("latest"), F.bool_or(F.col("reported_in").isNull()).alias("undated"))
    w = Window.partitionBy(*KEY)
    newest = F.max("latest").over(w)
    seen = by_value.select(*KEY, "r", "f", "latest", "undated", newest.alias("newest"), F.count("*").over(w).alias("n")).filter("n > 1")
    now = F.max(F.when(F.col("latest") == F.col("newest"), F.col("r"))).over(w)
    before = F.when(F.col("latest") != F.col("newest"), ~F.col("undated") & (F.col("latest.at") < F.col("newest.at")))
    out = seen.select("*", now.alias("current_value"), F.min(before).over(w).alias("all_before")).filter(F.col("latest") != F.col("newest"))
    return out.select(
        *KEY, F.col("r").alias("value"), F.col("f.source_file").alias("source_file"), F.col("f.reported_in").alias("reported_in"), "current_value",
        F.when(F.col("all_before"), "restated").otherwise("conflict").alias("kind"),
    )


def weighted_rollup(facts: DataFrame, parents: DataFrame, *, fine: str, coarse: str, rates: list[str], weight: str) -> DataFrame:
    """Facts of grain ``coarse`` from those of ``fine``: the weight metric adds up, a rate is the weighted mean where the weights exceed 0.

    ``parents`` (entity, parent) is the crosswalk, matched without regard to case. A missing weight counts as 0.
    Rates meet their weights by a window over the key instead of a self-join.
    """
    base = facts.filter((F.col("grain") == fine) & F.col("metric").isin([*rates, weight]))
    w = F.max(F.when(F.col("metric") == weight, F.col("value"))).over(Window.partitionBy("family", "entity", "month"))
    weighed = base.withColumn("w", F.coalesce(w, F.lit(0.0)))
    up = weighed.join(parents.select(F.lower("entity").alias("e"), "parent"), F.lower("entity") == F.col("e"))
    out = up.groupBy("family", "metric", "parent", "month").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("w")).alias("vw"), F.sum("w").alias("w"))
    value = F.when(F.col("metric") == weight, F.col("s")).when(F.col("w") > 0, F.col("vw") / F.col("w"))
    return out.select("family", "metric", F.lit(coarse).alias("grain"), F.col("parent").alias("entity"), "month", value.alias("value"), F.lit("<rollup>").alias("source_file")).filter("value is not null")


def prefix_parents(entities: DataFrame, prefixes: list[tuple[str, str]]) -> DataFrame:
    """(entity, parent) by the first prefix in the list that an entity begins with, without regard to case."""
    parent = F.lit(None).cast("string")
    for prefix, name in reversed(prefixes):
        parent = F.when(F.lower("entity").startswith(prefix.lower()), F.lit(name)).otherwise(parent)
    return entities.select("entity", parent.alias("parent")).distinct().filter("parent is not null")


def derived_ratio(facts: DataFrame, *, name: str, numerator: str, denominator: str, scale: float = 1.0) -> DataFrame:
    """numerator / denominator * scale where both exist and the denominator is not 0; one aggregation in place of a join."""
    pair = facts.filter(F.col("metric").isin(numerator, denominator)).groupBy("family", "grain", "entity", "month").agg(
        F.max(F.when(F.col("metric") == numerator, F.col("value"))).alias("n"), F.max(F.when(F.col("metric") == denominator, F.col("value"))).alias("d")
    )
    return pair.filter("n is not null and d <> 0").select(
        "family", F.lit(name).alias("metric"), "grain", "entity", "month", (F.col("n") / F.col("d") * scale).alias("value"), F.lit("<derived>").alias("source_file")
    )


def coverage_holes(facts: DataFrame) -> DataFrame:
    """family, grain, entity, month of each cell of the observed months x entities grid that no fact covers."""
    seen = facts.select("family", "grain", "entity", "month").distinct()
    months = seen.groupBy("family", "grain").agg(F.collect_set("month").alias("months"))  # months of a calendar: a bounded set
    per = seen.groupBy("family", "grain", "entity").agg(F.collect_set("month").alias("own"))
    return per.join(months, ["family", "grain"]).select("family", "grain", "entity", F.explode(F.array_except("months", "own")).alias("month"))


def month_range(start: Column | str, end: Column | str) -> Column:
    """Array of ``yyyy-MM`` from start to end, both included."""
    first = lambda m: F.to_date(F.concat(m if isinstance(m, Column) else F.lit(m), F.lit("-01")))
    return F.transform(F.sequence(first(start), first(end), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))


def coverage_expected(facts: DataFrame, *, start: str, end: str, entities: DataFrame) -> DataFrame:
    """missing_kind, name: expected months of the range and expected entities that no fact has."""
    months = facts.sparkSession.range(1).select(F.explode(month_range(start, end)).alias("month"))
    lost_m = months.join(facts.select("month").distinct(), "month", "left_anti").select(F.lit("month").alias("missing_kind"), F.col("month").alias("name"))
    lost_e = entities.select("entity").distinct().join(facts.select("entity").distinct(), "entity", "left_anti").select(F.lit("entity").alias("missing_kind"), F.col("entity").alias("name"))
    return lost_m.unionByName(lost_e)


def metric_catalog(facts: DataFrame, catalog: DataFrame) -> DataFrame:
    """family, metric, unit, grains (comma list, sorted), first_month, last_month, n_rows: governed metrics with what is there of each; grains empty if nothing is."""
    have = facts.groupBy("family", "metric").agg(
        F.array_join(F.array_sort(F.collect_set(F.nullif("grain", F.lit("")))), ",").alias("grains"), F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count("*").alias("n_rows")
    )
    return catalog.join(have, ["family", "metric"], "left").select(
        "family", "metric", "unit", F.coalesce("grains", F.lit("")).alias("grains"), "first_month", "last_month", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows")
    )


def select_metric(
    facts: DataFrame, metric: str, *, grain: str | None = None, entity: str | None = None, entity_contains: str | None = None, month: str | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Rows of a metric under the filters that are given; contains ignores case and takes ``%`` and ``_`` as they are."""
    out = facts.filter(F.col("metric") == metric)
    for c, v in (("grain", grain), ("entity", entity), ("month", month)):
        out = out.filter(F.col(c) == v) if v is not None else out
    out = out.filter(F.lower("entity").contains(entity_contains.lower())) if entity_contains is not None else out
    out = out.filter(F.col("month") >= start) if start is not None else out
    return out.filter(F.col("month") <= end) if end is not None else out


def first_rows(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` (1 to 100) rows by month, grain, entity with ``truncated``: whether there are more. One fetch of limit + 1 rows."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    top = rows.orderBy("month", "grain", "entity").limit(limit + 1)
    w = Window.orderBy("month", "grain", "entity")  # over limit + 1 rows
    return top.withColumn("k", F.row_number().over(w)).withColumn("truncated", F.count("*").over(Window.partitionBy()) > limit).filter(F.col("k") <= limit).drop("k")


def attach_versions(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` with n_versions and version_state: ``restated`` if all other reports with another value are dated before the current one, ``conflicting`` if not, null without any."""
    other = facts.select(*KEY, F.col("value").alias("v"), F.col("reported_in").alias("r"))
    j = rows.join(other, KEY, "left").filter((F.col("v").isNull()) | (F.bround("v", 9) != F.bround("value", 9)) | (F.col("r").eqNullSafe(F.col("reported_in"))))
    differs = F.bround("v", 9) != F.bround("value", 9)
    out = j.groupBy(*rows.columns).agg(
        F.count_if(differs).alias("n_versions"), F.every(~differs | (F.col("r").isNotNull() & (F.col("r") < F.col("reported_in")))).alias("older")
    )
    return out.select(*rows.columns, "n_versions", F.when(F.col("n_versions") > 0, F.when(F.coalesce("older", F.lit(False)), "restated").otherwise("conflicting")).alias("version_state"))


def attach_notes(rows: DataFrame, notes: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` with notes: a note belongs to rows of its file, of its month or of any if it has none. A computed row (``<...>``) gets the notes of each file that supplied its family that month."""
    suppliers = facts.filter(~F.col("source_file").startswith("<")).select("family", "month", F.col("source_file").alias("from_file")).distinct()
    direct = rows.filter(~F.col("source_file").startswith("<")).withColumn("from_file", F.col("source_file"))
    computed = rows.filter(F.col("source_file").startswith("<")).join(suppliers, ["family", "month"], "left")
    reach = direct.unionByName(computed)
    n = notes.select(F.col("family").alias("nf"), F.col("source_file").alias("ns"), F.col("month").alias("nm"), F.col("text").alias("note"))
    hit = reach.join(n, (F.col("family") == F.col("nf")) & (F.col("from_file") == F.col("ns")) & (F.col("nm").isNull() | (F.col("nm") == F.col("month"))), "left")
    return hit.groupBy(*rows.columns).agg(F.array_join(F.array_sort(F.collect_set("note")), "|").alias("notes"))


def metric_history(facts: DataFrame, computed: DataFrame, metric: str) -> DataFrame:
    """Every report of a metric, and computed facts whose key no report has; is_current marks the report that counts."""
    reports = facts.filter(F.col("metric") == metric)
    w = Window.partitionBy(*KEY)
    marked = reports.withColumn("is_current", (vintage() == F.max(vintage()).over(w)).cast("int"))
    rest = computed.filter(F.col("metric") == metric).join(reports.select(*KEY).distinct(), KEY, "left_anti")
    cols = [*KEY, "value", "source_file", "reported_in", "is_current"]
    return marked.select(*cols).unionByName(rest.select(*KEY, "value", "source_file", F.lit(None).cast("string").alias("reported_in"), F.lit(1).alias("is_current")))


def forward_fill(cells: DataFrame) -> DataFrame:
    """(row_id, col, label, month): a banner's month reaches to the next banner cell; a label that is no month stops it."""
    is_month = F.col("label").rlike(r"^\d{4}-\d{2}$")
    w = Window.partitionBy("row_id").orderBy("col")
    group = F.count(F.when(F.col("label").isNotNull(), 1)).over(w)
    g = cells.withColumn("g", group)
    return g.withColumn("month", F.first(F.when(is_month, F.col("label")), ignorenulls=True).over(Window.partitionBy("row_id", "g").orderBy("col").rowsBetween(Window.unboundedPreceding, 0))).drop("g")


def nested_versions(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` with other_values: the reports of their key with another value (source_file, value, reported_in), by file; empty without any. Keys are nested one by one, each as long as it has reports."""
    other = facts.select(*KEY, F.struct("source_file", "value", "reported_in").alias("o")).join(rows.select(*KEY, F.col("value").alias("now")).distinct(), KEY)
    differing = other.filter(F.bround("o.value", 9) != F.bround("now", 9)).groupBy(*KEY).agg(F.array_sort(F.collect_set("o")).alias("other_values"))
    return rows.join(differing, KEY, "left").withColumn("other_values", F.coalesce("other_values", F.array().cast(differing.schema["other_values"].dataType)))


def attach_merges(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """``rows`` with merged_from (policy, n_rows, inputs) of the merge with their key and file, null if none: the value came of several rows of one file."""
    own = [*KEY, "source_file"]
    m = merges.dropDuplicates(own).select(*own, F.struct("policy", "n_rows", "inputs").alias("merged_from"))
    return rows.join(m, own, "left")


def build_coverage(facts: DataFrame) -> DataFrame:
    """family, metric, grain, n_rows, n_months, n_entities."""
    return facts.groupBy("family", "metric", "grain").agg(F.count("*").alias("n_rows"), F.count_distinct("month").alias("n_months"), F.count_distinct("entity").alias("n_entities"))


def conformed(values: DataFrame, aliases: DataFrame, *, titled: tuple[str, ...] = ()) -> DataFrame:
    """``values`` (dim, value) with entity: an alias (dim, norm, entity) of the value in header form, else the value with single spaces, in title case for the dimensions ``titled``. Null value: null."""
    flat = F.trim(F.regexp_replace("value", r"\s+", " "))
    a = aliases.dropDuplicates(["dim", "norm"]).select("dim", F.col("norm").alias("key_"), F.col("entity").alias("alias_"))
    j = values.withColumn("key_", header(F.col("value"))).join(a, ["dim", "key_"], "left")
    return j.select(*values.columns, F.coalesce("alias_", F.when(F.col("dim").isin(*titled), title_runs(flat)).otherwise(flat)).alias("entity"))


def mapped_ambiguous(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """``rows`` (sheet, raw) with entity: spellings that meet others of their sheet in header form, and only those, go through the mapping (raw, entity), as they are or trimmed; all others stay."""
    spelt = rows.filter(is_dimension_value(F.col("raw"))).select("sheet", header(F.col("raw")).alias("fold"), "raw")
    clash = spelt.groupBy("sheet", "fold").agg(F.count_distinct("raw").alias("n")).filter("n > 1").select("sheet", "fold", F.lit(True).alias("clash"))
    m = mapping.dropDuplicates(["raw"])
    exact, loose = (m.select(F.col("raw").alias(k), F.trim("entity").alias(v)) for k, v in (("k1", "e1"), ("k2", "e2")))
    j = rows.withColumns({"fold": header(F.col("raw")), "k1": F.col("raw"), "k2": F.trim("raw")}).join(clash, ["sheet", "fold"], "left").join(exact, "k1", "left").join(loose, "k2", "left")
    return j.select(*rows.columns, F.when(F.col("clash"), F.coalesce("e1", "e2", "raw")).otherwise(F.col("raw")).alias("entity"))
