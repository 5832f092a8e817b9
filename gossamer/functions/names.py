"""Names and values as people read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.functions import scalars as X


def fuzzy_county(rows: DataFrame, name: str, counties: DataFrame, ratio: float = 0.85) -> DataFrame:
    """Exact slug, else the closest by edit distance with a ratio of at least 0.85 (the county list is a constant)."""
    from gossamer.plans.bounded import bounded_rows, literal_array

    dim = bounded_rows(counties.select("ord", "county_id", X.county_slug("name").alias("slug")), 5000)
    const = literal_array([{"ord": r["ord"], "id": r["county_id"], "slug": r["slug"]} for r in dim], "ord: bigint, id: string, slug: string")
    out = rows.withColumn("_slug", X.county_slug(F.col(name)))
    near = F.transform(const, lambda c: F.struct(F.levenshtein(F.col("_slug"), c["slug"]).alias("d"), c["ord"].alias("ord"), c["id"].alias("id"), F.length(c["slug"]).alias("n")))
    good = F.filter(near, lambda c: F.lit(1.0) - c["d"] / F.greatest(F.length("_slug"), c["n"]) >= ratio)
    return out.withColumn("county", F.array_min(good)["id"]).drop("_slug")


def title_case(text: Column) -> Column:
    """Every run of letters capitalized, digits and punctuation breaking runs."""
    parts = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substr(p, F.lit(2))))), "")


# Abbreviations spelled out and small words kept low.
SPELLED = {"Nr": "near", "Abv": "above", "Blw": "below"}
SMALL = ["At", "Near", "Above", "Below", "Of", "The", "And"]


def site_name(raw: Column) -> Column:
    """X29: 'SALT CREEK AT 22ND STREET NR MCHENRY, IL' reads 'Salt Creek at 22nd Street near McHenry'."""
    head = F.regexp_extract(raw, r"(?s)^(.*),[^,]*$", 1)
    t = title_case(F.when(head != "", head).otherwise(raw))
    words = F.transform(F.split(t, " "), _tidy)
    return F.array_join(words, " ")


def _tidy(w: Column) -> Column:
    mc = F.concat(F.lit("Mc"), F.upper(F.substring(w, 3, 1)), F.substr(w, F.lit(4)))
    out = F.when(w.rlike(r"^Mc[a-z]"), mc).when(w.rlike(r"^\d+(St|Nd|Rd|Th)$"), F.lower(w))
    for a, b in SPELLED.items():
        out = out.when(w == a, b)
    return out.when(w.isin(*SMALL), F.lower(w)).otherwise(w)


def station_name(raw: Column) -> Column:
    """'CHICAGO/OHARE (ORD)' reads 'Chicago Ohare (ORD)'."""
    code = F.regexp_extract(raw, r"\(([^)]*)\)\s*$", 1)
    head = title_case(F.trim(F.regexp_replace(F.regexp_replace(raw, r"\s*\([^)]*\)\s*$", ""), "/", " ")))
    return F.when(code != "", F.concat(head, F.lit(" ("), F.upper(code), F.lit(")"))).otherwise(head)


def report_place(raw: Column) -> Column:
    """'3 E GARDEN PLAIN' reads '3 mi E of Garden Plain'."""
    n, d, rest = (F.regexp_extract(raw, r"^(\d+(?:\.\d+)?)\s+([NSEW]{1,3})\s+(.+)$", i) for i in (1, 2, 3))
    return F.when(n != "", F.concat(n, F.lit(" mi "), d, F.lit(" of "), title_case(rest))).otherwise(title_case(raw))


def display(rows: DataFrame, spec: DataFrame, words: DataFrame) -> DataFrame:
    """A value for people: a flag 'reported', a named word of the scale, the display unit when there is one, else
    the canonical unit. ``spec`` and ``words`` are vocabulary tables."""
    named = words.select(F.col("metric").alias("_m"), "word", "at")
    out = rows.join(F.broadcast(spec), "metric").join(F.broadcast(named), (F.col("_m") == F.col("metric")) & (F.abs(F.col("at") - F.col("value")) < 1e-9), "left")
    shown = F.col("value") * F.coalesce("a", F.lit(1.0)) + F.coalesce("b", F.lit(0.0))
    fixed = None
    for d in range(0, 5):
        fixed = F.when(F.col("decimals") == d, F.format_string(f"%,.{d}f", shown)) if fixed is None else fixed.when(F.col("decimals") == d, F.format_string(f"%,.{d}f", shown))
    text = F.coalesce(fixed, X.nice_number(shown))
    txt = (F.when(F.col("value").isNull(), "—").when(F.col("is_flag"), "reported").when(F.col("word").isNotNull(), F.col("word"))
           .otherwise(F.trim(F.concat(text, F.lit(" "), F.coalesce("shown_unit", "unit")))))
    return out.withColumn("display", txt).drop("_m", "at")
