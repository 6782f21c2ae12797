"""Text columns: normalisers, tokens, shingles, similarity. JVM expressions but for :func:`folded` and :func:`ratio`."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(c: Column) -> Column:
    """Node id of a label: lower case, runs of anything but a-z and 0-9 to one ``_``, trimmed; ``n`` if nothing is left."""
    s = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("n"))


def header(c: Column) -> Column:
    """Table header: lower case, white space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def words(c: Column, least: int = 1) -> Column:
    """Array of lower-case runs of a-z and 0-9 with ``least`` characters or more; cut at what is between them, which takes a third of the time of finding them."""
    runs = F.split(F.lower(c), "[^a-z0-9]+")
    return F.array_remove(runs, "") if least <= 1 else F.filter(runs, lambda w: F.length(w) >= least)


def fact_tokens(c: Column, stop: frozenset[str]) -> Column:
    """Words without stop words, joined by single spaces."""
    return F.array_join(F.filter(words(c), lambda w: ~w.isin(*sorted(stop))), " ")


def _fold(s: pd.Series) -> pd.Series:
    plain = str.maketrans("‘’“”", "''\"\"")
    folded = s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).lower().translate(plain))
    return folded.str.replace(r"[^\w']+", " ", regex=True).str.strip()


def folded(c: Column) -> Column:
    """NFKC, lower case, typographic quotes made plain, anything but word characters and quotes to spaces, trimmed; an Arrow UDF, as Spark has no NFKC."""
    return F.pandas_udf(_fold, "string")(c)


def shingles(tokens: Column, k: int) -> Column:
    """Distinct runs of k tokens joined by spaces; empty with fewer tokens. The tokens are bound to a variable, or each run would make them again."""
    runs = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - k + 1), lambda i: F.array_join(F.slice(t, i, k), " "))
    return F.element_at(F.transform(F.array(tokens), lambda t: F.when(F.size(t) >= k, F.array_distinct(runs(t))).otherwise(F.array().cast("array<string>"))), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Shared elements over the size of the smaller set; 0 if either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(a), F.size(b))), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either has no length."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """difflib's similarity ratio of two strings (null as empty); an Arrow UDF."""
    return F.pandas_udf(_ratio, "double")(a, b)


def sentences(c: Column) -> Column:
    """Array of trimmed sentences: cut after . ! or ? before white space."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def title(heading: Column, body: Column) -> Column:
    """The heading, unless it has fewer than 3 word characters or is ``Page n``; else the first line with 6 word characters or more, cut to 10 words and 70 characters."""
    fine = (F.length(F.regexp_replace(heading, r"\W", "")) >= 3) & ~F.trim(heading).rlike(r"(?i)^page\s+\d+$")
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.regexp_replace(x, r"\W", "")) >= 6)
    line = F.try_element_at(lines, F.lit(1))
    short = F.substr(F.array_join(F.slice(F.split(F.trim(line), r"\s+"), 1, 10), " "), F.lit(1), F.lit(70))
    return F.when(fine, F.trim(heading)).otherwise(F.coalesce(short, F.trim(heading)))


def short_id(n: int, *parts: Column, algorithm: str = "sha256") -> Column:
    """First ``n`` hex digits of the parts joined by ``|``."""
    joined = F.concat_ws("|", *parts)
    return F.substr(F.sha1(joined) if algorithm == "sha1" else F.sha2(joined, 256), F.lit(1), F.lit(n))


def clock_seconds(c: Column) -> Column:
    """Seconds of ``HH:MM:SS.mmm``, ``MM:SS`` or with a comma; null for anything else."""
    p = F.transform(F.split(F.replace(c, F.lit(","), F.lit(".")), ":"), lambda x: x.try_cast("double"))
    return F.when(F.size(p) == 3, p[0] * 3600 + p[1] * 60 + p[2]).when(F.size(p) == 2, p[0] * 60 + p[1])


def number(c: Column) -> Column:
    """A cell's number: commas, ``$`` and ``%`` dropped, a time of day in seconds; null for anything else."""
    return F.coalesce(F.regexp_replace(c, r"[,$%\s]", "").try_cast("double"), clock_seconds(F.trim(c)))


def is_dimension_value(c: Column) -> Column:
    """Not blank, a total or an error mark."""
    marks = ["", "total", "grand total", "all", "sum", "#n/a", "n/a", "#ref!", "#value!", "#div/0!", "(blank)", "blank"]
    return F.coalesce(~F.lower(F.trim(c)).isin(*marks), F.lit(False))


def first_tag(c: Column, families: list[tuple[str, str]]) -> Column:
    """Array of the families whose pattern the text matches, in their order."""
    return F.array_compact(F.array(*[F.when(c.rlike(pattern), F.lit(name)) for name, pattern in families]))


def cell_name(row: Column, col: Column) -> Column:
    """A cell's name, as in ``B3``, of a row and column from 0; columns up to 18,277 (``ZZZ``), which is beyond a sheet's last, ``XFD``."""
    letter = lambda k: F.chr((F.lit(65) + F.pmod(k, F.lit(26))).cast("long"))
    third = F.when(col >= 702, letter(F.floor((col - 702) / 676))).otherwise("")
    second = F.when(col >= 26, letter(F.floor((col - 26) / 26))).otherwise("")
    return F.concat(third, second, letter(col), (row + 1).cast("string"))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit hashes differ."""
    return F.bit_count(a.bitwiseXOR(b))


def mean_abs(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of one length; null for empty ones or where the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), total / F.nullif(F.size(a), F.lit(0)))


def difference_hash(rows: Column) -> Column:
    """A 64-bit hash of a picture of 8 rows and 9 columns of brightness: a bit for each cell that is darker than its right neighbour, row by row, the first highest."""
    bits = F.flatten(F.transform(rows, lambda r: F.zip_with(F.slice(r, 1, 8), F.slice(r, 2, 8), lambda x, y: (x < y).cast("long"))))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))


def parts(c: Column, mark: str) -> Column:
    """What stands between ``mark`` in a text, trimmed, without empty parts; null: none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), rf"\Q{mark}\E"), lambda x: F.trim(x)), lambda x: x != "")


def utc(c: Column) -> Column:
    """An ISO time as UTC, ``yyyy-MM-ddTHH:mm:ssZ``; a time without a zone is UTC already; null if it is none."""
    return F.date_format(F.to_utc_timestamp(F.try_to_timestamp(c), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def identity(**fields: Column) -> Column:
    """The first 16 hex digits of the sha1 of named values as JSON with sorted keys; nulls are kept as null."""
    return F.left(F.sha1(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})), F.lit(16))


def smart_title(c: Column) -> Column:
    """Words of more than three letters in capitals only become a capital and small letters; the others stay."""
    return F.array_join(F.transform(F.split(F.trim(c), r"\s+"), lambda w: F.when(w.rlike(r"^[A-Z]{4,}$"), F.initcap(w)).otherwise(w)), " ")


def title_runs(c: Column) -> Column:
    """Runs of letters and digits as a capital and small letters, but for runs of three characters at most whose letters are capitals; all else stays."""
    marked = F.regexp_replace(c, "([A-Za-z0-9]+)", "\u0001$1\u0001")
    cap = lambda w: F.when(~w.rlike("^[A-Za-z0-9]+$") | w.rlike("^(?=.*[A-Z])[A-Z0-9]{1,3}$"), w).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2)))))
    return F.array_join(F.transform(F.split(marked, "\u0001"), cap), "")


def preview(body: Column, title: Column, chars: int = 200) -> Column:
    """The first characters of a section's own words: white space as single spaces, without the title (less a leading ``p3 ·`` and a closing ``(part 2)``) and a page number at the beginning."""
    flat = lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
    text, stem = flat(body), flat(F.regexp_replace(title, r"(?i)^\s*p\d+\s*·\s*|\s*\(part \d+\)\s*$", ""))
    rest = F.regexp_replace(F.regexp_replace(F.substr(text, F.length(stem) + 1), "^[ .:—·-]+", ""), r"^\d{1,4}\s+", "")
    return F.left(F.when((stem != "") & F.startswith(F.lower(text), F.lower(stem)), rest).otherwise(text), F.lit(chars))
