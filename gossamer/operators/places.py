"""Points to counties and ZIPs, what lies near what, views around a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gossamer.functions import geo
from gossamer.functions import scalars as X
from gossamer.operators.filters import hours_before
from gossamer.plans.bounded import bounded_rows, broadcast_if_small, literal_array
from gossamer.plans.spacetime import cell_keys, cells_reached, within

MAX_COUNTIES = 5000
CELL_DEG = 0.25


def county_points(counties: DataFrame) -> Column:
    """County centres as one constant, in table order; refuses a table that isn't a county table."""
    rows = bounded_rows(counties.select("ord", "county_id", "lat", "lon"), MAX_COUNTIES)
    return literal_array([{"ord": r["ord"], "id": r["county_id"], "lat": r["lat"], "lon": r["lon"]} for r in rows],
                         "ord: bigint, id: string, lat: double, lon: double")


NEAR_DEG = 0.5


def nearest_cells(points: list[dict]) -> list[tuple]:
    """(_ny, _nx, entries) for the half-degree cells of the table's area: the few entries that can be nearest to some
    point of the cell. An entry drops out when it is farther from the cell's centre than the nearest one by more than
    the cell's diameter."""
    import numpy as np

    lat, lon = np.radians([p["lat"] for p in points]), np.radians([p["lon"] for p in points])
    lo_y, hi_y = (int(np.floor((f([p["lat"] for p in points]) + d) / NEAR_DEG)) for f, d in ((min, -1.0), (max, 1.0)))
    lo_x, hi_x = (int(np.floor((f([p["lon"] for p in points]) + d) / NEAR_DEG)) for f, d in ((min, -1.0), (max, 1.0)))
    out = []
    diameter = NEAR_DEG * 111.2 * 2**0.5 * 1.01
    for y in range(lo_y, hi_y + 1):
        for x in range(lo_x, hi_x + 1):
            cy, cx = np.radians((y + 0.5) * NEAR_DEG), np.radians((x + 0.5) * NEAR_DEG)
            h = np.sin((lat - cy) / 2) ** 2 + np.cos(lat) * np.cos(cy) * np.sin((lon - cx) / 2) ** 2
            d = 2 * geo.EARTH_KM * np.arcsin(np.sqrt(h))
            out.append((y, x, [(int(points[i]["ord"]), points[i]["id"], float(points[i]["lat"]), float(points[i]["lon"])) for i in np.flatnonzero(d <= d.min() + diameter)]))
    return out


def nearest_county(points: DataFrame, counties: DataFrame, max_km: float | None = None) -> DataFrame:
    """Nearest centre, ties to table order. A point meets the few candidates of its half-degree cell (one broadcast
    row of a checked county table); outside the table's area it is compared with every centre, a constant."""
    rows = bounded_rows(counties.select("ord", "county_id", "lat", "lon"), MAX_COUNTIES)
    table = [{"ord": r["ord"], "id": r["county_id"], "lat": r["lat"], "lon": r["lon"]} for r in rows]
    ddl = "ord: bigint, id: string, lat: double, lon: double"
    cells = points.sparkSession.createDataFrame(nearest_cells(table), f"_ny long, _nx long, _near array<struct<{ddl}>>")
    cell = lambda c: F.floor(F.col(c) / NEAR_DEG).cast("long")
    out = points.withColumn("_ny", cell("lat")).withColumn("_nx", cell("lon")).join(F.broadcast(cells), ["_ny", "_nx"], "left")
    best = F.when(F.col("_near").isNotNull(), geo.nearest_of("lat", "lon", F.col("_near"), max_km)).when(
        F.col("lat").isNotNull() & F.col("lon").isNotNull(), geo.nearest_of("lat", "lon", literal_array(table, ddl), max_km))
    out = out.withColumn("_n", best)
    return out.withColumn("nearest_county", F.col("_n.id")).withColumn("nearest_km", F.col("_n.km")).drop("_n", "_ny", "_nx", "_near")


def ring_cells(regions: DataFrame, keep: list[str], cell: float = CELL_DEG) -> DataFrame:
    """Regions by the cells their bounding box touches: (_y, _x, regions as an array in ``ord`` order).

    One row per cell, so a point meets one row and needs no aggregation afterwards. Regions per cell are few.
    """
    b = regions.withColumn("_q", geo.ring_bounds("rings"))
    fl = lambda c: F.floor(c / cell).cast("long")
    b = b.withColumn("_y", F.explode(F.sequence(fl(F.col("_q.y0")), fl(F.col("_q.y1")))))
    b = b.withColumn("_x", F.explode(F.sequence(fl(F.col("_q.x0")), fl(F.col("_q.x1")))))
    return b.groupBy("_y", "_x").agg(F.sort_array(F.collect_list(F.struct("ord", *keep, "rings"))).alias("_regions"))


def county_of_point(points: DataFrame, rings: DataFrame, counties: DataFrame) -> DataFrame:
    """The first county whose outline holds the point, else the nearest centre."""
    cells = broadcast_if_small(ring_cells(rings, ["county_id"]))
    p = points.withColumn("_y", F.floor(F.col("lat") / CELL_DEG).cast("long")).withColumn("_x", F.floor(F.col("lon") / CELL_DEG).cast("long"))
    hit = F.filter("_regions", lambda r: geo.point_in_polygon("lat", "lon", r["rings"]))
    out = p.join(cells, ["_y", "_x"], "left").withColumn("_hit", F.get(hit, F.lit(0))["county_id"]).drop("_y", "_x", "_regions")
    near = geo.nearest_of("lat", "lon", county_points(counties))
    return out.withColumn("county_at", F.coalesce("_hit", near["id"])).withColumn("inside", F.col("_hit").isNotNull()).drop("_hit")


# Copies of ZIP places to cells that may be broadcast.
MAX_ZIP_COPIES = 200_000


def with_zip(points: DataFrame, zips: DataFrame, max_km: float = 15.0) -> DataFrame:
    """Adds ``zip5`` and ``zip_km``: the nearest ZIP centre strictly nearer than ``max_km``, ties to table order, else NULL. Of ZIPs at one place only the first can be
    nearest. A point meets one row, the ZIP places in reach of its cell, so no pairs are sorted or grouped."""
    places = zips.groupBy("lat", "lon").agg(F.min(F.struct("ord", "zip5")).alias("_z")).select("lat", "lon", F.col("_z.ord").alias("ord"), F.col("_z.zip5").alias("id"))
    reached = cells_reached(places, F.lit(max_km), grain=1.0)
    cells = reached.groupBy("_cy", "_cx").agg(F.collect_list(F.struct("ord", "id", "lat", "lon")).alias("_near"))
    small = reached.limit(MAX_ZIP_COPIES + 1).count() <= MAX_ZIP_COPIES
    out = cell_keys(points, F.lit(max_km), grain=1.0).join(F.broadcast(cells) if small else cells, ["_cy", "_cx"], "left")
    out = out.withColumn("_n", geo.nearest_of("lat", "lon", F.col("_near"), max_km))
    return out.withColumns({"zip5": F.col("_n.id"), "zip_km": F.col("_n.km")}).drop("_n", "_near", "_cy", "_cx")


def nearest_zip(points: DataFrame, point_id: str, zips: DataFrame, max_km: float = 15.0) -> DataFrame:
    """Points, one row each, that have a ZIP centre in reach."""
    near = with_zip(points.select(point_id, "lat", "lon"), zips, max_km).filter("zip5 IS NOT NULL")
    return near.select(point_id, "zip5", F.col("zip_km").alias("km"))


def around_centres(centres: DataFrame, things: DataFrame, centre_id: str, keep: list[str], km: float, extra: Column | None = None) -> DataFrame:
    """Things within ``km`` of each centre, with the distance."""
    l = centres.select(centre_id, "lat", "lon").withColumn("_r", F.lit(km))
    r = things.select(*keep, F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon")).withColumn("_r", F.lit(km))
    return within(l, r, [], "_r", extra=extra).select(centre_id, *keep, "km")


def gauges_near_county(counties: DataFrame, gauges: DataFrame, km: float = 40.0) -> DataFrame:
    """J26."""
    return around_centres(counties, gauges, "county_id", ["site"], km)


def air_near_county(counties: DataFrame, readings: DataFrame, now: Column, km: float = 40.0, hours: float = 3.0) -> DataFrame:
    """Per county the nearest reading of the last hours; the newest of the nearest."""
    r = readings.filter(F.col("observed_at") >= hours_before(now, hours))
    near = around_centres(counties, r, "county_id", ["seq", "value", "observed_at"], km)
    rank = F.struct(F.round("km", 9).alias("k"), (-F.unix_micros("observed_at")).alias("t"), (-F.col("seq")).alias("s"))
    return near.groupBy("county_id").agg(F.min_by(F.struct("seq", "value", "km"), rank).alias("b")).select("county_id", "b.*")


def neighbor_counties(counties: DataFrame, km: float = 90.0, k: int = 6) -> DataFrame:
    """The six nearest county centres. A county has a bounded number of neighbours in reach."""
    o = counties.select(F.col("county_id").alias("neighbor"), F.col("ord").alias("o_ord"), "lat", "lon")
    p = around_centres(counties, o, "county_id", ["neighbor", "o_ord"], km, extra=F.col("county_id") != F.col("neighbor"))
    w = W.partitionBy("county_id").orderBy(F.round("km", 9), "o_ord")
    return p.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("o_ord")


def near_point(df: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Rows within ``km`` of one point: a box the scan can prune by, then the exact distance."""
    import math

    dlat = km / 111.0
    dlon = km / max(1e-6, 111.0 * math.cos(math.radians(lat)))
    box = F.col("lat").between(lat - dlat, lat + dlat) & F.col("lon").between(lon - dlon, lon + dlon)
    return df.filter(box & (geo.haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")) <= km))


def near_view(signals: DataFrame, alerts: DataFrame, events: DataFrame, lat: float, lon: float, county: str, now: Column,
              hours: float = 3.0, km: float = 30.0) -> DataFrame:
    """(part, id): readings around a point, active alerts of its county once per group, open events within twice the radius."""
    r = near_point(signals.filter((F.col("observed_at") >= hours_before(now, hours)) & (F.col("observed_at") <= now)
                                  & (F.col("quality") != "rejected")), lat, lon, km)
    a = alerts.filter((F.col("county_id") == county) & (F.col("expires").isNull() | (F.col("expires") > now))).groupBy("group_key").agg(F.lit(1).alias("x"))
    e = near_point(events.filter(F.col("status") == "open"), lat, lon, 2 * km)
    return (r.select(F.lit("reading").alias("part"), F.col("seq").cast("string").alias("id"))
            .unionByName(a.select(F.lit("alert").alias("part"), F.col("group_key").alias("id")))
            .unionByName(e.select(F.lit("event").alias("part"), F.col("event_id").alias("id"))))


def near_summary(signals: DataFrame, dim_metric: DataFrame, lat: float, lon: float, now: Column, hours: float, km: float) -> DataFrame:
    """Per metric around a point: peak by direction, people, references, latest."""
    r = near_point(signals.filter((F.col("observed_at") >= hours_before(now, hours)) & (F.col("quality") != "rejected")), lat, lon, km)
    g = r.groupBy("metric").agg(F.max("value").alias("hi_v"), F.min("value").alias("lo_v"), F.count_if(F.col("kind") == "human").alias("people"),
                                F.count_if(F.col("kind") != "human").alias("others"), F.max("observed_at").alias("latest"))
    g = g.join(F.broadcast(dim_metric.select("metric", "direction")), "metric")
    return g.withColumn("peak", F.when(F.col("direction") == "below", F.col("lo_v")).otherwise(F.col("hi_v"))).drop("hi_v", "lo_v", "direction")


def public_points(signals: DataFrame, zips: DataFrame, counties: DataFrame) -> DataFrame:
    """People at their ZIP's centre, else their county's, four decimals; both tables are size-checked dimensions."""
    z = broadcast_if_small(zips.select("zip5", F.col("lat").alias("_zlat"), F.col("lon").alias("_zlon")))
    c = broadcast_if_small(counties.select("county_id", F.col("lat").alias("_clat"), F.col("lon").alias("_clon")))
    out = signals.join(z, "zip5", "left").join(c, "county_id", "left")
    return (out.withColumn("pub_lat", F.bround(F.coalesce("_zlat", "_clat"), 4)).withColumn("pub_lon", F.bround(F.coalesce("_zlon", "_clon"), 4))
            .drop("_zlat", "_zlon", "_clat", "_clon"))


def map_reports(signals: DataFrame, zips: DataFrame, counties: DataFrame, now: Column, hours: float = 24) -> DataFrame:
    """The last day's people (as handles at public points) and official reports (at their own)."""
    s = signals.filter((F.col("observed_at") >= hours_before(now, hours)) & F.col("kind").isin("human", "bot", "official"))
    p = public_points(s, zips, counties)
    person = F.col("kind") != "official"
    lat = F.when(person, F.col("pub_lat")).otherwise(F.bround("lat", 4))
    lon = F.when(person, F.col("pub_lon")).otherwise(F.bround("lon", 4))
    who = F.when(person, X.public_handle("sensor_id")).otherwise("official report")
    return p.select("seq", "metric", who.alias("who"), "quality", lat.alias("lat"), lon.alias("lon")).filter(F.col("lat").isNotNull())
