"""Radar grids: which product window judges a reading, its value there, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.functions import scalars as X
from gossamer.functions.geo import haversine_km

SLACK_US = 15 * 60 * 10**6
NO_COVERAGE = -2.5
HOUR_US = 3600 * 10**6


def load_grid_cells(cells: DataFrame) -> DataFrame:
    """At or below -2.5 means outside coverage; other negatives mean nothing there."""
    v = F.col("value")
    return cells.withColumn("value", F.when(v > NO_COVERAGE, F.greatest(F.lit(0.0), v)))


def windows_by_hour(products: DataFrame) -> DataFrame:
    """Products (metric, window, minutes, valid_at) by the hours they reach: one row per (metric, hour) with the
    candidates shortest first, then earliest. Their number is set by the product list, not by the readings.
    """
    v = F.unix_micros("valid_at")
    lo = F.floor((v - F.col("minutes") * F.lit(60 * 10**6).cast("long")) / HOUR_US).cast("long")
    hi = F.floor(v / HOUR_US).cast("long")
    p = products.withColumn("_h", F.explode(F.sequence(lo, hi)))
    return p.groupBy("metric", "_h").agg(F.sort_array(F.collect_list(F.struct("minutes", v.alias("valid_us"), "window"))).alias("_cands"))


def grid_as_of(readings: DataFrame, products: DataFrame, grids: DataFrame) -> DataFrame:
    """The shortest window, then the earliest valid time, that covers the reading and the slack before it.

    An amount over a stated period uses that period's window without slack; another accumulating amount the default
    window and longer. ``grids`` (metric, default_minutes, periods array) and the product table are small literals of
    configuration; readings meet one row of candidates each.
    """
    r = readings.join(F.broadcast(grids), "metric").withColumn("_h", F.floor(F.unix_micros("observed_at") / HOUR_US).cast("long"))
    stated = F.col("accumulates") & F.coalesce(F.array_contains("periods", F.col("period")), F.lit(False))
    t = F.unix_micros("observed_at")

    def fits(c: Column) -> Column:
        allowed = F.when(~F.col("accumulates"), True).when(stated, c["window"] == F.col("period")).otherwise(c["minutes"] >= F.col("default_minutes"))
        slack = F.when(stated, 0).otherwise(SLACK_US)
        return allowed & (t <= c["valid_us"]) & (c["valid_us"] - c["minutes"] * F.lit(60 * 10**6).cast("long") <= t - slack)

    out = r.join(windows_by_hour(products), ["metric", "_h"], "left")
    return (out.withColumn("_w", F.get(F.filter("_cands", fits), F.lit(0))).withColumn("window", F.col("_w.window"))
            .withColumn("valid_us", F.col("_w.valid_us")).drop("_h", "_cands", "_w", "periods", "default_minutes"))


def grid_sample(readings: DataFrame, cells: DataFrame, on: list[str], lat0: float, lon0: float, step: float, radius_km: float = 0.0) -> DataFrame:
    """The largest cell value within ``radius_km`` of each reading and where it was (radius 0: the point's cell).

    ``lat0`` is the northern edge row's latitude and rows grow south. A reading is copied to the cells in reach and
    joined on (row, col); its copies combine to one row before the shuffle.
    """
    import math

    r0 = F.bround((F.lit(lat0) - F.col("lat")) / step, 0).cast("long")
    c0 = F.bround((F.col("lon") - F.lit(lon0)) / step, 0).cast("long")
    dr = math.ceil(radius_km / (111.32 * step)) if radius_km else 0
    dc = F.ceil(F.lit(radius_km) / (F.lit(111.32 * step) * F.greatest(F.lit(0.1), F.cos(F.radians("lat"))))).cast("long")
    rows = readings.select("seq", *on, "lat", "lon").withColumn("row", F.explode(F.sequence(r0 - dr, r0 + dr)))
    rows = rows.withColumn("col", F.explode(F.sequence(c0 - dc, c0 + dc)))
    la, lo = F.lit(lat0) - F.col("row") * step, F.lit(lon0) + F.col("col") * step
    if radius_km:
        rows = rows.filter(haversine_km(F.col("lat"), F.col("lon"), la, lo) <= radius_km)
    hit = rows.join(cells.select(*on, "row", "col", F.col("value").alias("grid_value")), [*on, "row", "col"])
    rank = F.struct(F.col("grid_value"), (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))
    best = hit.filter(F.col("grid_value").isNotNull()).groupBy("seq").agg(F.max_by(F.struct("grid_value", "row", "col"), rank).alias("b"))
    return best.select("seq", "b.grid_value", "b.row", "b.col")


def grid_verdict(reading, grid_value, min_signal, tol_abs, tol_rel, far_ratio, is_event) -> Column:
    """A10: nodata, agree, far, disagree or quiet."""
    v, g = F.col(reading), F.col(grid_value)
    allowed = F.greatest(F.coalesce(F.lit(tol_abs), F.lit(0.0)), F.coalesce(F.lit(tol_rel), F.lit(0.0)) * F.greatest(F.abs(v), F.abs(g)))
    ratio = F.greatest(v, g) / F.greatest(F.least(v, g), F.lit(1e-9))
    wide = F.abs(v - g) > 2 * (tol_abs or 0.0)
    return (F.when(g.isNull(), "nodata").when((g >= min_signal) & (F.abs(v - g) <= allowed), "agree")
            .when((g >= min_signal) & (ratio >= far_ratio) & wide, "far").when(g >= min_signal, "disagree")
            .when(is_event, "disagree").otherwise("quiet"))


def _valid():
    return F.struct(F.col("valid_us").alias("t"), F.lit(2).alias("o"), F.col("seq").cast("long").alias("id"))


def grid_evidence(judged: DataFrame) -> DataFrame:
    """Evidence rows for A5 from verdicts: agree confirms, far flags; the record gets half weight, far a full miss."""
    agree = F.col("verdict") == "agree"
    return judged.filter(F.col("verdict").isin("agree", "far")).select(
        "seq", _valid().alias("arrival"), F.when(agree, "corroborated").otherwise("flagged").alias("verdict"), F.lit("grid").alias("via"),
        F.when(agree, X.GRID_WEIGHT).otherwise(0.0).alias("agree"), F.when(agree, 0.0).otherwise(1.0).alias("disagree"))


def grid_doubts(judged: DataFrame) -> DataFrame:
    """(seq, arrival) of mild misses: they settle nothing but count half a miss on a person's record."""
    return judged.filter(F.col("verdict") == "disagree").select("seq", _valid().alias("arrival"))
