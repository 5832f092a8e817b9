"""Range join in space and time as an equi join on cells.

Latitude bands, longitude cells sized per band, and time buckets. A left row lies in exactly one cell; a right row is
copied only to the cells its reach touches (about 3 per axis at most, 2 on average with the default grain). A pair
therefore meets once, and the planner sees a plain equi join that adaptive execution can split when a cell is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KM_PER_DEG = 111.0


def _band_height(radius: Column, grain: float) -> Column:
    return radius * (grain / KM_PER_DEG)


def _reach_lon(y: Column, h: Column, radius: Column) -> Column:
    """Degrees of longitude the radius can span inside band ``y``, taken one band further toward the pole."""
    edge = F.least(F.greatest(F.abs(y * h), F.abs((y + 1) * h)) + h, F.lit(89.0))
    return radius / (KM_PER_DEG * F.cos(F.radians(edge)))


def _floor(c: Column) -> Column:
    return F.floor(c).cast("long")


def cell_keys(df: DataFrame, radius: Column, lat="lat", lon="lon", grain: float = 2.0) -> DataFrame:
    """Add the one cell (``_cy``, ``_cx``) a point lies in."""
    h = _band_height(radius, grain)
    out = df.withColumn("_cy", _floor(F.col(lat) / h))
    return out.withColumn("_cx", _floor(F.col(lon) / (_reach_lon(F.col("_cy"), h, radius) * grain)))


def cells_reached(df: DataFrame, radius: Column, lat="lat", lon="lon", grain: float = 2.0) -> DataFrame:
    """Copy each point to every cell that may hold a partner within the radius."""
    h = _band_height(radius, grain)
    lat_reach = radius / KM_PER_DEG
    out = df.withColumn("_cy", F.explode(F.sequence(_floor((F.col(lat) - lat_reach) / h), _floor((F.col(lat) + lat_reach) / h))))
    reach = _reach_lon(F.col("_cy"), h, radius)
    return out.withColumn("_cx", F.explode(F.sequence(
        _floor((F.col(lon) - reach) / (reach * grain)), _floor((F.col(lon) + reach) / (reach * grain)))))


def within(left: DataFrame, right: DataFrame, on: list[str], radius: str, before_us: str | None = None,
           after_us: str | None = None, left_at: str = "observed_at", right_at: str = "o_observed_at",
           how: str = "inner", extra: Column | None = None, grain: float = 2.0, tasks: int | None = None) -> DataFrame:
    """Pairs with distance <= radius and, when given, right time in [left - before, left + after] (inclusive).

    Left has lat/lon, right o_lat/o_lon; radius, before and after are columns of both sides that depend on ``on`` only.
    Adds ``km``. ``extra`` is a further exact condition on the pair. ``tasks`` fixes how many tasks the cells are dealt over, for pairs that are sorted in the
    same task: adaptive execution sees only the sides' bytes and joins small shares.
    """
    from gossamer.functions.geo import haversine_km

    l, r, keys = _cells(left, right, on, radius, before_us, after_us, left_at, right_at, grain)
    if tasks:
        l, r = l.repartition(tasks, *keys), r.repartition(tasks, *keys)
    cond = _near(radius) & (haversine_km("lat", "lon", "o_lat", "o_lon") <= F.col(radius))
    if extra is not None:
        cond = extra & cond
    if before_us:
        gap = F.unix_micros(F.col(right_at)) - F.unix_micros(F.col(left_at))
        cond = (gap >= -F.col(before_us)) & (gap <= F.col(after_us)) & cond
    out = l.join(r, keys, how).filter(cond)
    return out.withColumn("km", haversine_km("lat", "lon", "o_lat", "o_lon")).drop("_cy", "_cx", "_tb")


def _near(radius: str) -> Column:
    """Cheap bound ahead of the exact distance."""
    return F.abs(F.col("lat") - F.col("o_lat")) * F.lit(KM_PER_DEG) <= F.col(radius)


def _cells(left, right, on, radius, before_us, after_us, left_at, right_at, grain) -> tuple[DataFrame, DataFrame, list[str]]:
    """Left rows with their cell, right rows copied to the cells they reach, and the columns that name a cell."""
    params = [c for c in (radius, before_us, after_us) if c]
    l = cell_keys(left, F.col(radius), grain=grain)
    r = cells_reached(right, F.col(radius), "o_lat", "o_lon", grain=grain)
    keys = [*on, "_cy", "_cx"]
    if before_us:
        width = F.greatest(F.lit(1).cast("long"), ((F.col(before_us) + F.col(after_us)) * (grain / 2)).cast("long"))
        lt, rt = F.unix_micros(F.col(left_at)), F.unix_micros(F.col(right_at))
        l = l.withColumn("_tb", _floor(lt / width))
        r = r.withColumn("_tb", F.explode(F.sequence(_floor((rt - F.col(after_us)) / width), _floor((rt + F.col(before_us)) / width))))
        keys.append("_tb")
    return l, r.drop(*params), keys


def closest_within(left: DataFrame, right: DataFrame, on: list[str], radius: str, window_us: str, by: str, row_id: str, carry: list[str], extra,
                   grain: float = 2.0) -> DataFrame:
    """Per left row and value of ``by`` on the right, the right row closest in time (then newest, then latest by ``row_id``) within the radius and window.

    The right rows of one ``by`` in a cell become one row first, so the join gives each (left row, ``by``) once, with all columns of both sides: nothing is
    grouped, shuffled or joined after it. Right columns are o_<name>; ``carry`` names those kept beside o_<row_id>, o_<by>, o_observed_at, o_lat and o_lon.
    ``extra(o)`` is a further condition, where o(name) is a right column. A cell's rows of one ``by`` are held at once, those of one window.
    """
    from gossamer.functions.geo import haversine_km

    l, r, keys = _cells(left, right, on, radius, window_us, window_us, "observed_at", "o_observed_at", grain)
    names = [f"o_{c}" for c in dict.fromkeys([row_id, "observed_at", "lat", "lon", *carry])]
    t = F.unix_micros("o_observed_at")
    r = r.repartition(*keys).groupBy(*keys, f"o_{by}").agg(
        F.collect_list(F.struct(*names)).alias("_o"), F.min(t).alias("_t0"), F.max(t).alias("_t1"), F.min("o_lat").alias("_y0"), F.max("o_lat").alias("_y1"),
        F.min("o_lon").alias("_x0"), F.max("o_lon").alias("_x1"))

    def fits(x):
        gap = F.unix_micros(x["o_observed_at"]) - F.unix_micros("observed_at")
        return (F.abs(gap) <= F.col(window_us)) & extra(lambda c: x[f"o_{c}"]) & (haversine_km(F.col("lat"), F.col("lon"), x["o_lat"], x["o_lon"]) <= F.col(radius))

    def ranked(x):
        gap = F.unix_micros(x["o_observed_at"]) - F.unix_micros("observed_at")
        return F.struct(F.abs(gap).alias("g"), (gap < 0).alias("e"), (-x[f"o_{row_id}"]).alias("r"), x.alias("x"))

    # what bounds a left row's partners is worked out once per row: the join itself compares plain columns
    here = F.unix_micros("observed_at")
    reach = F.col(radius) / KM_PER_DEG
    wide = _reach_lon(F.col("_cy"), _band_height(F.col(radius), grain), F.col(radius))
    bounds = {"_ta": here - F.col(window_us), "_tz": here + F.col(window_us), "_ya": F.col("lat") - reach, "_yz": F.col("lat") + reach, "_xa": F.col("lon") - wide, "_xz": F.col("lon") + wide}
    l = l.withColumns(bounds).repartition(*keys)
    box = ((F.col("_t1") >= F.col("_ta")) & (F.col("_t0") <= F.col("_tz")) & (F.col("_y1") >= F.col("_ya")) & (F.col("_y0") <= F.col("_yz"))
           & (F.col("_x1") >= F.col("_xa")) & (F.col("_x0") <= F.col("_xz")) & (F.col(by) != F.col(f"o_{by}")))
    one = F.col("_o")[0]
    best = F.when(F.size("_o") == 1, F.when(fits(one), one)).otherwise(F.array_min(F.transform(F.filter("_o", fits), ranked))["x"])
    out = l.join(r, keys).filter(box).withColumn("_best", best).filter("_best IS NOT NULL")
    out = out.select(*left.columns, f"o_{by}", *[F.col(f"_best.{n}").alias(n) for n in names])
    return out.withColumn("km", haversine_km("lat", "lon", "o_lat", "o_lon"))
