"""Outlook polygons over points, forecast periods, river stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.functions import geo
from gossamer.operators.rollups import top_per_key
from gossamer.plans.bounded import broadcast_if_small
from gossamer.plans.bucketed import lag_columns, running_count

CELL_DEG = 0.25
TREND_US = 6 * 3600 * 10**6
TREND_STEP = 0.1
FORECAST_US = 5 * 86400 * 10**6
SPARK_POINTS = 48


def covering(outlooks: DataFrame, at: Column) -> DataFrame:
    """The polygons of the issuance valid at the instant: day 1, else 2, else 3, per outlook name."""
    live = outlooks.filter((F.col("valid_from") <= at) & (at < F.col("valid_to")))
    day = live.groupBy("name").agg(F.min("day").alias("_day"))
    return live.join(F.broadcast(day), "name").filter(F.col("day") == F.col("_day")).drop("_day")


def outlook_over_point(points: DataFrame, point_id: str, outlooks: DataFrame, at: Column) -> DataFrame:
    """Highest level whose polygons (holes respected) hold each point.

    Outlooks of one shape become one with the highest level; shapes are listed by the cells their box touches; a point meets only those of its own cell,
    and the highest level is a partially aggregated max.
    """
    o = covering(outlooks, at).groupBy("name", "polygons").agg(F.max("level").alias("level"))
    fl = lambda c: F.floor(c / CELL_DEG).cast("long")
    o = o.withColumn("_q", geo.ring_bounds(F.flatten("polygons")))
    o = o.withColumn("_y", F.explode(F.sequence(fl(F.col("_q.y0")), fl(F.col("_q.y1"))))).withColumn("_x", F.explode(F.sequence(fl(F.col("_q.x0")), fl(F.col("_q.x1")))))
    p = points.select(point_id, "lat", "lon", fl(F.col("lat")).alias("_y"), fl(F.col("lon")).alias("_x"))
    hit = p.join(o.select("name", "level", "polygons", "_y", "_x"), ["_y", "_x"]).filter(geo.point_in_polygon_with_holes("lat", "lon", "polygons"))
    return hit.groupBy(point_id, "name").agg(F.max("level").alias("level"))


def counties_at_risk(counties: DataFrame, outlooks: DataFrame, at: Column) -> DataFrame:
    """Counties (by centre) grouped by their highest level."""
    lv = outlook_over_point(counties, "county_id", outlooks, at).join(broadcast_if_small(counties.select("county_id", F.col("name").alias("county"))), "county_id")
    return lv.groupBy("name", "level").agg(F.sort_array(F.collect_list("county")).alias("counties"))


def next_periods(periods: DataFrame, place: str, now: Column, n: int) -> DataFrame:
    """Periods not ended yet, from the place's first daytime one, the first n."""
    live = periods.filter(F.col("end_at") > now)
    first = live.filter("daytime").groupBy(place).agg(F.min("start_at").alias("_first"))
    p = live.join(first, place).filter(F.col("start_at") >= F.col("_first")).drop("_first")
    return top_per_key(p, [place], [F.asc("start_at"), F.asc("seq")], n, "seq")


def windy(wind) -> Column:
    speeds = F.transform(F.regexp_extract_all(F.coalesce(wind, F.lit("")), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.coalesce(F.array_max(speeds) >= 15, F.lit(False))


def sentence(text) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.concat(F.upper(F.left(t, F.lit(1))), F.lower(F.substr(t, F.lit(2))))


def forecast_text(short, pop, temp, unit, daytime, wind) -> Column:
    """X34: 'Showers likely (60%), low 54°F, wind SW 15-25 mph'."""
    lead = F.concat(short, F.when(pop >= 20, F.concat(F.lit(" ("), pop.cast("string"), F.lit("%)"))).otherwise(""))
    heat = F.when(temp.isNotNull(), F.concat(F.when(daytime, "high ").otherwise("low "), temp.cast("string"), F.lit("°"), unit))
    return F.concat_ws(", ", lead, heat, F.when(windy(wind), F.concat(F.lit("wind "), wind)))


def icon(short, daytime, icons: list[tuple[str, str]]) -> Column:
    """First keyword of the configured list found in the text; a moon never shows by day."""
    out = None
    for key, sym in icons:
        cond = F.lower(short).contains(key.lower())
        out = F.when(cond, sym) if out is None else out.when(cond, sym)
    hit = out.otherwise(F.when(daytime, "☀️").otherwise("🌙"))
    return F.when((hit == "🌙") & daytime, "☀️").otherwise(hit)


def target_instant(first_daytime_start, now: Column, zone: str) -> Column:
    """Six hours into the first daytime period; with none, local noon, tomorrow's from 3 PM on."""
    local = F.from_utc_timestamp(now, zone)
    noon = F.date_trunc("day", local) + F.expr("INTERVAL 12 HOURS")
    noon = F.when(F.hour(local) >= 15, noon + F.expr("INTERVAL 1 DAY")).otherwise(noon)
    return F.coalesce(first_daytime_start + F.expr("INTERVAL 6 HOURS"), F.to_utc_timestamp(noon, zone))


def day_word(now: Column, at: Column, zone: str) -> Column:
    a, b = F.to_date(F.from_utc_timestamp(now, zone)), F.to_date(F.from_utc_timestamp(at, zone))
    return F.when(a == b, "today").when(F.datediff(b, a) == 1, "tomorrow").otherwise(F.date_format(b, "EEEE"))


# ── rivers and series ──────────────────────────────────────────────────────

def rises(series: DataFrame, keys: list[str], tol_abs: float) -> DataFrame:
    """Last value over the window's low when above the tolerance, with three points or more and no single step over
    half of it. Steps come from a two-level lag, the rest from one aggregation."""
    s = lag_columns(series, keys, "taken", "seq", ["stage"], 86400 * 10**6)
    g = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max_by("stage", F.struct("taken", "seq")).alias("last"), F.min("stage").alias("low"),
                             F.max(F.col("stage") - F.col("prev_stage")).alias("step"))
    up = F.col("last") - F.col("low")
    return g.filter((F.col("n") >= 3) & (up > tol_abs) & (F.col("step") <= 0.5 * up)).select(*keys, up.alias("rise"))


RISE_WEIGHTS = [0.35, 0.25, 0.2]


def rank_rises(rise_rows: DataFrame) -> DataFrame:
    """The three biggest rises per metric and their weights."""
    top = top_per_key(rise_rows, ["metric"], [F.desc("rise"), F.asc("site")], len(RISE_WEIGHTS), "site")
    return top.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in RISE_WEIGHTS]), F.col("rank")))


def trend(series: DataFrame, keys: list[str]) -> DataFrame:
    """Last value against the last one at least six hours before it: two aggregations, no ordered pass."""
    at = F.struct("taken", "seq")
    last = series.groupBy(*keys).agg(F.max(F.struct("taken", "seq", "stage")).alias("l")).select(*keys, F.col("l.taken").alias("_t"), F.col("l.stage").alias("last"))
    old = series.join(last, keys).filter(F.unix_micros("_t") - F.unix_micros("taken") >= F.lit(TREND_US)).groupBy(*keys).agg(F.max_by("stage", at).alias("earlier"))
    change = F.col("last") - F.col("earlier")
    return last.join(old, keys).select(*keys, F.when(change >= TREND_STEP, "rising").when(change <= -TREND_STEP, "falling").otherwise("steady").alias("trend"))


def median_of_last_three(series: DataFrame, keys: list[str]) -> DataFrame:
    """The middle of the last three values (upper middle of two)."""
    top = top_per_key(series, keys, [F.desc("taken"), F.desc("seq")], 3, "seq")
    v = F.sort_array(F.collect_list("stage"))
    return top.groupBy(*keys).agg(v.alias("_v"), F.max("taken").alias("taken")).select(
        *keys, F.element_at("_v", (F.floor(F.size("_v") / 2) + 1).cast("int")).alias("stage_now"), "taken")


def sparkline(series: DataFrame, keys: list[str]) -> DataFrame:
    """At most 48 evenly spaced points ending at the newest; series under six points have none."""
    idx = running_count(series, keys, "taken", ["taken", "seq"], 86400 * 10**6, "k")
    n = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("taken").alias("_last"))
    s = idx.join(n, keys).filter(F.col("n") >= 6)
    near = F.bround(F.col("k") * F.lit(SPARK_POINTS - 1.0) / (F.col("n") - 1), 0)
    keep = F.lit(False)
    for d in (-1, 0, 1):
        i = near + d
        keep = keep | ((i >= 0) & (i < SPARK_POINTS) & (F.bround(i * (F.col("n") - 1) / F.lit(SPARK_POINTS - 1.0), 0) == F.col("k")))
    minutes = F.bround((F.unix_micros("taken") - F.unix_micros("_last")) / F.lit(60e6), 0).cast("long")
    return s.filter((F.col("n") <= SPARK_POINTS) | keep).select(*keys, "k", minutes.alias("minutes"), "stage")


def crest_or_fall(forecast: DataFrame, stages: DataFrame, now: Column) -> DataFrame:
    """The first highest forecast value of five days when over the stage by 0.05, else the end value when under it by 0.1."""
    f = forecast.filter((F.col("taken") > now) & (F.unix_micros("taken") - F.unix_micros(now) <= F.lit(FORECAST_US)))
    g = f.groupBy("site").agg(F.max_by(F.struct("stage", "taken"), F.struct(F.col("stage"), (-F.unix_micros("taken")).alias("t"))).alias("top"),
                              F.max_by("stage", F.struct("taken", "seq")).alias("end"))
    j = g.join(stages, "site")
    crest = F.col("top.stage") > F.col("stage_now") + 0.05
    return j.select("site", F.when(crest, F.col("top.stage")).alias("crest"), F.when(crest, F.col("top.taken")).alias("crest_at"),
                    F.when(~crest & (F.col("end") < F.col("stage_now") - TREND_STEP), F.col("end")).alias("falls_to"))


def statewide_headline(extremes: DataFrame, min_field: int = 3) -> DataFrame:
    """Per (metric, stat) the place holding the extreme, when at least three places report. Rows: metric, stat,
    place, value (one per place)."""
    key = F.when(F.col("stat") == "max", F.col("value")).otherwise(-F.col("value"))
    g = extremes.groupBy("metric", "stat").agg(F.max_by(F.struct("place", "value"), F.struct(key.alias("v"), (-F.col("place")).alias("p"))).alias("b"),
                                               F.count(F.lit(1)).alias("field"))
    return g.filter(F.col("field") >= min_field).select("metric", "stat", "b.place", "b.value", "field")
