"""Geometry as Catalyst expressions. Rings are arrays of [lon, lat] points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius, flat-earth km per degree, storm track limits, spelled compass points.
EARTH_KM = 6371.0088
KM_PER_LON_DEG = 111.32
KM_PER_LAT_DEG = 110.57
STORM_TRACK_KM = 10.0
KM_PER_KNOT = 1.852
COMPASS = ["north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest"]
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _c(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(float(x)))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    half_dp = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_dl = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_dp * half_dp + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_dl * half_dl
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(a))


def compass(deg) -> Column:
    """Eight points, half-even at the midpoints."""
    idx = F.pmod(F.bround(_c(deg) / 45.0, 0).cast("int"), F.lit(8))
    return F.element_at(F.array(*[F.lit(n) for n in COMPASS]), idx + 1)


def bearing_deg(dx_east, dy_north) -> Column:
    """Direction of a flat-earth offset, 0 = north, clockwise."""
    d = F.degrees(F.atan2(_c(dx_east), _c(dy_north)))
    return F.when(d < 0, d + 360.0).otherwise(d)


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.transform(
        ring,
        lambda p, i: F.struct(
            p[0].alias("x1"), p[1].alias("y1"),
            F.get(ring, F.pmod(i + 1, n))[0].alias("x2"), F.get(ring, F.pmod(i + 1, n))[1].alias("y2"),
        ),
    )


def _crossings(lat: Column, lon: Column, ring: Column) -> Column:
    def crosses(e: Column) -> Column:
        straddles = (e["y1"] > lat) != (e["y2"] > lat)
        at = e["x1"] + F.try_divide((lat - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"])
        return F.when(straddles & (lon < at), 1).otherwise(0)

    return F.aggregate(_edges(ring), F.lit(0), lambda acc, e: acc + crosses(e))


def point_in_polygon(lat, lon, rings) -> Column:
    """Inside any ring (even-odd rule per ring)."""
    lat, lon, rings = _c(lat), _c(lon), _c(rings)
    return F.coalesce(F.exists(rings, lambda r: (_crossings(lat, lon, r) % 2) == 1), F.lit(False))


def point_in_polygon_with_holes(lat, lon, polygons) -> Column:
    """Inside the first ring of some polygon and outside that polygon's other rings."""
    lat, lon, polygons = _c(lat), _c(lon), _c(polygons)

    def holds(poly: Column) -> Column:
        outer = (_crossings(lat, lon, F.get(poly, F.lit(0))) % 2) == 1
        hole = F.exists(F.slice(poly, F.lit(2), F.greatest(F.size(poly) - 1, F.lit(0))),
                        lambda r: (_crossings(lat, lon, r) % 2) == 1)
        return outer & ~hole

    return F.coalesce(F.exists(polygons, holds), F.lit(False))


def _vec(x, y) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"]


def _from_point(lon, lat, origin_lon, origin_lat) -> Column:
    """Offset in km of a place from an origin, flat earth around the origin."""
    return _vec((lon - origin_lon) * (F.lit(KM_PER_LON_DEG) * F.cos(F.radians(origin_lat))), (lat - origin_lat) * KM_PER_LAT_DEG)


def _nearest_on(segment: Column) -> Column:
    """Point nearest to the origin of the segment from ``p`` to ``q``: p plus its share of the way, the projection kept between 0 and 1."""
    way = F.transform(F.array(segment), lambda s: F.struct(s["p"].alias("p"), _vec(s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]).alias("d")))
    cut = F.transform(way, lambda w: F.struct(w["p"].alias("p"), w["d"].alias("d"), F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(-_dot(w["p"], w["d"]), _dot(w["d"], w["d"])))), F.lit(0.0)).alias("k")))
    return F.transform(cut, lambda w: _vec(w["p"]["x"] + w["k"] * w["d"]["x"], w["p"]["y"] + w["k"] * w["d"]["y"]))[0]


def polygon_gap(lat, lon, rings) -> Column:
    """struct(km, bearing) from the nearest ring edge to the point."""
    lat, lon, rings = _c(lat), _c(lon), _c(rings)
    segments = F.transform(F.flatten(F.transform(rings, _edges)), lambda e: F.struct(_from_point(e["x1"], e["y1"], lon, lat).alias("p"), _from_point(e["x2"], e["y2"], lon, lat).alias("q")))
    nearest = F.array_min(F.transform(F.transform(segments, _nearest_on), lambda v: F.struct(F.sqrt(_dot(v, v)).alias("km"), v.alias("v"))))
    return F.struct(nearest["km"].alias("km"), bearing_deg(-nearest["v"]["x"], -nearest["v"]["y"]).alias("bearing"))


def ring_bounds(rings) -> Column:
    """struct(x0, y0, x1, y1) of all rings."""
    pts = F.flatten(_c(rings))
    xs, ys = F.transform(pts, lambda p: p[0]), F.transform(pts, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
                    F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def storm_arrival_hours(from_deg, speed_kt, points, lat, lon, max_hours: float = 3.0) -> Column:
    """Hours until a moving storm reaches the point, or NULL when it won't or already passed.

    ``points`` are [lat, lon]. A lone point must pass within STORM_TRACK_KM; a line also sweeps what its
    span covers across the track.
    """
    from_deg, speed_kt, points, lat, lon = map(_c, (from_deg, speed_kt, points, lat, lon))
    course = F.radians(F.pmod(from_deg + 180.0, F.lit(360.0)))
    heading, across = _vec(F.sin(course), F.cos(course)), _vec(F.cos(course), -F.sin(course))
    # storm points as seen from the place: distance along the heading (negative: still to come) and off the track
    seen = F.transform(points, lambda p: _from_point(p[1], p[0], lon, lat))
    seen = F.transform(seen, lambda v: F.struct(_dot(v, heading).alias("along"), _dot(v, across).alias("off")))
    ahead = F.transform(F.filter(seen, lambda s: (s["along"] < 0) & (F.abs(s["off"]) <= STORM_TRACK_KM)), lambda s: s["along"])
    # where the line between two neighbouring points crosses the place's own track
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))), lambda i: F.struct(F.get(seen, i - 1).alias("s"), F.get(seen, i).alias("t")))
    crossing = F.transform(F.filter(pairs, lambda w: w["s"]["off"] * w["t"]["off"] <= 0), lambda w: w["s"]["along"] - F.try_divide((w["t"]["along"] - w["s"]["along"]) * w["s"]["off"], w["t"]["off"] - w["s"]["off"]))
    hours = -F.array_max(F.concat(ahead, F.filter(crossing, lambda a: a < 0))) / (speed_kt * KM_PER_KNOT)
    return F.when((speed_kt * KM_PER_KNOT >= 5) & (F.size(points) > 0) & (hours <= max_hours), hours)


def storm_track(from_deg, speed_kt, lat, lon, step_min: int = 15, total_min: int = 60) -> Column:
    """Where a storm point will be every ``step_min`` minutes, as structs (minute, lat, lon)."""
    from_deg, speed_kt, lat, lon = map(_c, (from_deg, speed_kt, lat, lon))
    head = F.radians(F.pmod(from_deg + 180.0, F.lit(360.0)))

    def at(m: Column) -> Column:
        km = speed_kt * KM_PER_KNOT * m / 60.0
        return F.struct(m.alias("minute"),
                        (lat + km * F.cos(head) / KM_PER_LAT_DEG).alias("lat"),
                        (lon + km * F.sin(head) / (F.lit(KM_PER_LON_DEG) * F.cos(F.radians(lat)))).alias("lon"))

    return F.transform(F.sequence(F.lit(step_min), F.lit(total_min), F.lit(step_min)), at)


def geohash(lat, lon, precision: int = 7) -> Column:
    """Base-32 geohash; a point on a midpoint takes the low half."""
    lat, lon = _c(lat), _c(lon)
    total = precision * 5
    lon_bits, lat_bits = (total + 1) // 2, total // 2

    def cell(x: Column, lo: float, span: float, bits: int) -> Column:
        idx = F.ceil((x - lo) / span * float(1 << bits)).cast("long") - 1
        return F.least(F.greatest(idx, F.lit(0).cast("long")), F.lit((1 << bits) - 1).cast("long"))

    ix, iy = cell(lon, -180.0, 360.0, lon_bits), cell(lat, -90.0, 180.0, lat_bits)
    chars = []
    for c in range(precision):
        value = F.lit(0).cast("long")
        for j in range(5):
            k = c * 5 + j
            src, shift = (ix, lon_bits - 1 - k // 2) if k % 2 == 0 else (iy, lat_bits - 1 - k // 2)
            value = value * 2 + F.shiftright(src, shift).bitwiseAND(F.lit(1).cast("long"))
        chars.append(F.substring(F.lit(GEOHASH_ALPHABET), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def nearest_of(lat, lon, places: Column, max_km: float | None = None) -> Column:
    """Entry of a bounded array of structs (ord, id, lat, lon) nearest the point; ties take the lowest ord.

    Strictly nearer than ``max_km`` when given.
    """
    lat, lon = _c(lat), _c(lon)
    best = F.array_min(F.transform(places, lambda p: F.struct(
        haversine_km(lat, lon, p["lat"], p["lon"]).alias("km"), p["ord"].alias("ord"), p["id"].alias("id"))))
    return best if max_km is None else F.when(best["km"] < max_km, best)
