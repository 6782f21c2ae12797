"""Facts from spreadsheet cells: rows (file, sheet, row, cells ARRAY<STRING>), as a workbook reader leaves them.

Each layout finds its header row, reads to the first blank row and emits long facts. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import header, is_dimension_value, number

MONTHS = "january february march april may june july august september october november december".split()
SHEET = ["file", "sheet"]


def blank(cells: Column) -> Column:
    return F.forall(cells, lambda c: F.coalesce(F.trim(c), F.lit("")) == "")


def month_of(c: Column, default_year: int | None = None) -> Column:
    """``yyyy-MM`` of a label or file name: the month name that comes first, else a three-letter form at a word's start; year 20xx found, else the default; null if either is missing."""
    low = F.lower(c)

    def first(patterns: list[str]) -> Column:
        hits = [F.when(F.regexp_instr(low, F.lit(p)) > 0, F.struct(F.regexp_instr(low, F.lit(p)).alias("at"), F.lit(k).alias("m"))) for k, p in enumerate(patterns, 1)]
        return F.array_min(F.array_compact(F.array(*hits)))["m"]

    m = F.coalesce(first(MONTHS), first([rf"(?<![a-z]){n[:3]}" for n in MONTHS]))
    y = F.coalesce(F.nullif(F.regexp_extract(low, r"(?<!\d)(20\d\d)(?!\d)", 1), F.lit("")), F.lit(str(default_year) if default_year else None))
    return F.when(m.isNotNull() & y.isNotNull(), F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0")))


def _table(cells: DataFrame, is_header: Column) -> DataFrame:
    """Rows under the first header of each sheet up to the first blank row, with ``head``: the header's normalised cells."""
    n = cells.withColumn("norm", F.transform("cells", lambda c: header(c)))
    marked = n.withColumn("hit", is_header)
    w = Window.partitionBy(*SHEET)
    at = marked.withColumn("at", F.min(F.when(F.col("hit"), F.col("row"))).over(w)).withColumn("head", F.min_by("norm", F.when(F.col("hit"), F.col("row"))).over(w))
    below = at.filter(F.col("row") > F.col("at"))
    run = F.sum(blank(F.col("cells")).cast("int")).over(w.orderBy("row"))
    return below.withColumn("gap", run).filter("gap = 0").select(*SHEET, "row", "cells", "head")


def long_facts(cells: DataFrame, *, dim: str, measures: dict[str, str]) -> DataFrame:
    """file, sheet, row, metric, entity, value: one fact per row and measure found (``measures``: header to metric); totals and error marks are skipped."""
    names = [m.lower() for m in measures]
    is_head = F.array_contains("norm", dim.lower()) & F.arrays_overlap("norm", F.array(*[F.lit(m) for m in names]))
    t = _table(cells, is_head).withColumn("entity", F.try_element_at("cells", F.array_position("head", F.lit(dim.lower())).cast("int")))
    pick = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.array_position("head", F.lit(h.lower())).cast("int").alias("at")) for h, m in measures.items()]))
    found = t.filter(is_dimension_value(F.col("entity"))).withColumn("m", pick).filter("m.at > 0")
    value = number(F.try_element_at("cells", F.col("m.at")))
    return found.select(*SHEET, "row", "m.metric", F.trim("entity").alias("entity"), value.alias("value")).filter("value is not null")


def matrix_facts(cells: DataFrame, *, default_year: int | None = None) -> DataFrame:
    """file, sheet, metric, month, value of metric rows under month columns: the first column of a month and the first row of a label win."""
    months = F.transform("norm", lambda c: month_of(c, default_year))
    t = _table(cells, F.exists(F.slice(months, F.lit(2), F.size("norm")), lambda m: m.isNotNull()) & (F.size("norm") > 1))
    flat = t.select(*SHEET, "row", F.trim(F.element_at("cells", 1)).alias("metric"), F.posexplode(F.arrays_zip("cells", "head")).alias("col", "c"))
    facts = flat.filter("col > 0").select(*SHEET, "row", "metric", "col", month_of(F.col("c.head"), default_year).alias("month"), number(F.col("c.cells")).alias("value"))
    best = facts.filter("month is not null and value is not null and metric <> ''").groupBy(*SHEET, "metric", "month").agg(F.min_by("value", F.struct("row", "col")).alias("value"))
    return best


def wide_month_facts(cells: DataFrame, *, dim: str, measures: dict[str, str], default_year: int | None = None) -> DataFrame:
    """file, sheet, row, metric, entity, month, value: a banner row of months above a header that repeats its measures for each; a month reaches to the next banner cell."""
    names = F.array(*[F.lit(m.lower()) for m in measures])
    n = cells.withColumn("norm", F.transform("cells", lambda c: header(c)))
    is_head = F.array_contains("norm", dim.lower()) & F.arrays_overlap("norm", names)
    w = Window.partitionBy(*SHEET).orderBy("row")
    banner = n.withColumn("banner", F.lag("cells").over(w)).filter(is_head)
    first = banner.withColumn("k", F.row_number().over(w)).filter("k = 1").select(*SHEET, F.col("row").alias("at"), F.posexplode(F.arrays_zip(F.col("norm").alias("h"), F.col("banner").alias("b"))).alias("col", "c"))
    c = Window.partitionBy(*SHEET).orderBy("col")
    label = F.nullif(F.trim("c.b"), F.lit(""))
    run = first.withColumn("g", F.count(label).over(c)).withColumn("month", F.first(month_of(label, default_year), ignorenulls=True).over(Window.partitionBy(*SHEET, "g").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)))
    columns = run.select(*SHEET, "at", "col", F.col("c.h").alias("head"), "month")
    dims = columns.filter(F.col("head") == dim.lower()).groupBy(*SHEET).agg(F.min("col").alias("dim_col"))
    metric = F.create_map(*[F.lit(x) for h, m in measures.items() for x in (h.lower(), m)])
    wanted = columns.filter("month is not null").withColumn("metric", F.try_element_at(metric, F.col("head"))).filter("metric is not null").join(dims, SHEET)
    rows = _table(cells, is_head).select(*SHEET, "row", "cells")
    j = rows.join(wanted, SHEET)
    out = j.select(*SHEET, "row", "metric", F.trim(F.get("cells", F.col("dim_col"))).alias("entity"), "month", number(F.get("cells", F.col("col"))).alias("value"))
    return out.filter(is_dimension_value(F.col("entity")) & F.col("value").isNotNull())


def annotation_cells(cells: DataFrame, *, least: int = 40) -> DataFrame:
    """file, sheet, row, col, text: sentences beside a table: long cells with closing punctuation, with no neighbour to the left, right or below."""
    flat = cells.select(*SHEET, "row", F.posexplode("cells").alias("col", "text")).withColumn("text", F.nullif(F.trim("text"), F.lit("")))
    across = Window.partitionBy(*SHEET, "row").orderBy("col")
    down = Window.partitionBy(*SHEET, "col").orderBy("row")
    seen = flat.withColumns({"l": F.lag("text").over(across), "r": F.lead("text").over(across), "d": F.lead("text").over(down), "p": F.lag("col").over(across)})
    return seen.filter((F.length("text") >= least) & F.col("text").rlike(r"[.!?]") & F.col("l").isNull() & F.col("r").isNull() & F.col("d").isNull() & (F.col("col") > 0)).select(*SHEET, "row", "col", "text")


def tolerant_facts(cells: DataFrame, *, dims: dict[str, list[str]], measures: dict[str, str], entity: str | None = None, scan: int = 40) -> DataFrame:
    """file, sheet, row, grain, metric, entity, value of sheets without a template.

    The header is the first of the first ``scan`` rows that holds a column of ``dims`` (grain to header names) and one of ``measures`` (header to
    metric). The grain is the one whose column, the first of its names found, has most distinct values below; ties to the earlier in ``dims``.
    ``entity``: a pattern from the value's beginning, whose first group becomes the entity where it fits. Blank rows don't end the table.
    """
    names, heads = [c.lower() for cs in dims.values() for c in cs], [m.lower() for m in measures]
    n = cells.withColumn("norm", F.transform("cells", lambda c: header(c)))
    has = lambda xs: F.coalesce(F.arrays_overlap("norm", F.array(*[F.lit(x) for x in xs])), F.lit(False))
    first = n.groupBy(*SHEET).agg(F.min("row").alias("top"))
    head = n.filter(has(names) & has(heads)).join(first, SHEET).filter(F.col("row") < F.col("top") + scan).groupBy(*SHEET).agg(F.min("row").alias("at"), F.min_by("norm", "row").alias("head"))
    below = cells.join(head, SHEET).filter(F.col("row") > F.col("at"))
    col = lambda name: F.nullif(F.array_position("head", F.lit(name.lower())), F.lit(0)).cast("int")
    grains = F.array(*[F.struct(F.lit(g).alias("grain"), F.lit(-k).alias("k"), F.coalesce(*[col(c) for c in cs]).alias("col")) for k, (g, cs) in enumerate(dims.items())])
    spread = below.select(*SHEET, "cells", F.explode(F.filter(grains, lambda g: g["col"].isNotNull())).alias("g")).withColumn("v", F.trim(F.try_element_at("cells", F.col("g.col"))))
    per = spread.groupBy(*SHEET, "g").agg(F.count_distinct(F.when(is_dimension_value(F.col("v")), F.col("v"))).alias("n"))
    best = per.groupBy(*SHEET).agg(F.max_by("g", F.struct("n", "g.k")).alias("g"))
    raw = F.trim(F.try_element_at("cells", F.col("g.col")))
    keyed = below.join(best, SHEET).withColumn("raw", raw).filter(is_dimension_value(F.col("raw")))
    named = F.when(F.col("raw").rlike(f"^(?:{entity})"), F.regexp_extract("raw", f"^(?:{entity})", 1)).otherwise(F.col("raw")) if entity else F.col("raw")
    pick = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), col(h).alias("at")) for h, m in measures.items()]))
    found = keyed.select(*SHEET, "row", F.col("g.grain").alias("grain"), named.alias("entity"), "cells", pick.alias("m")).filter("m.at is not null")
    return found.select(*SHEET, "row", "grain", "m.metric", "entity", number(F.try_element_at("cells", F.col("m.at"))).alias("value")).filter("value is not null")


def sheet_profiles(cells: DataFrame, *, scan: int = 25, samples: int = 3) -> DataFrame:
    """file, sheet, n_rows, n_cols, header_row, columns, samples: the header is the first of the first ``scan`` rows with two cells or more of which 60 % and at least two are words; the samples are rows after it."""
    filled = F.filter("cells", lambda c: F.coalesce(F.trim(c), F.lit("")) != "")
    told = F.size(F.filter(filled, lambda c: c.try_cast("double").isNull()))
    per = cells.groupBy(*SHEET).agg(F.count("row").alias("n_rows"), F.coalesce(F.max(F.size("cells")), F.lit(0)).alias("n_cols"), F.min("row").alias("top"))
    likely = (F.size(filled) >= 2) & (told >= F.greatest(F.lit(2), F.floor(F.size(filled) * 0.6)))
    head = cells.filter(likely).join(per.select(*SHEET, "top"), SHEET).filter(F.col("row") < F.col("top") + scan).groupBy(*SHEET).agg(F.min("row").alias("header_row"), F.min_by(filled, "row").alias("columns"))
    below = cells.join(head.select(*SHEET, "header_row"), SHEET).filter((F.col("row") > F.col("header_row")) & (F.col("row") <= F.col("header_row") + samples))
    shown = below.groupBy(*SHEET).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda x: F.array_join(x["cells"], " | ", "")).alias("samples"))
    return per.join(head, SHEET, "left").join(shown, SHEET, "left").select(*SHEET, "n_rows", "n_cols", "header_row", F.transform("columns", lambda c: F.trim(c)).alias("columns"), "samples")
