"""Places, grids, audiences, outlooks and rivers on the adapter tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gossamer.catalog import joins as J
from gossamer.catalog.aggregates import events, members
from gossamer.catalog.filters import NOW, now
from gossamer.catalog.joins import hav
from gossamer.catalog.registry import query, table_sql
from gossamer.functions import geo
from gossamer.functions import scalars as X
from gossamer.operators import ahead as H
from gossamer.operators import audience as AU
from gossamer.operators import grids as G
from gossamer.operators import places as P
from gossamer.operators.filters import hours_before, in_or_near
from gossamer.sources import adapter as A

us = F.unix_micros
PEOPLE = J.PEOPLE


def zips(spark, sf):
    """ZIP centres from the supplier table."""
    k = F.col("s_suppkey")
    return A.table(spark, sf, "supplier").select((F.lit(60000) + k % 1000).cast("string").alias("zip5"), k.alias("ord"), (k % 25).cast("string").alias("county_id"),
                                                (F.lit(37.0) + ((k * 7) % 55) / F.lit(10.0)).alias("lat"), (F.lit(-91.5) + ((k * 13) % 45) / F.lit(10.0)).alias("lon"))


table_sql("zips", """SELECT CAST(60000 + s_suppkey % 1000 AS VARCHAR) AS zip5, s_suppkey AS ord, CAST(s_suppkey % 25 AS VARCHAR) AS county_id,
    37.0::DOUBLE + ((s_suppkey*7) % 55)/10.0::DOUBLE AS lat, -91.5::DOUBLE + ((s_suppkey*13) % 45)/10.0::DOUBLE AS lon FROM supplier""")
CROSS = "CASE WHEN (y1 > p.lat) <> (y2 > p.lat) AND p.lon < x1 + (p.lat - y1) * (x2 - x1) / nullif(y2 - y1, 0) THEN 1 ELSE 0 END"
table_sql("inside", f"""SELECT p.sensor_id, county_id AS hit, ord FROM (SELECT sensor_id, lat, lon FROM sensors) p CROSS JOIN county_edges
    GROUP BY p.sensor_id, county_id, ord HAVING sum({CROSS}) % 2 = 1""")
table_sql("nearest", f"""SELECT sensor_id, arg_min(county_id, row(km, ord)) AS near, min(km) AS km FROM (SELECT s.sensor_id, c.county_id, c.ord, {hav('s.lat','s.lon','c.lat','c.lon')} AS km
    FROM sensors s CROSS JOIN dim_county c) GROUP BY 1""")


@query("j7_county_of_point", "SELECT n.sensor_id, coalesce(i.hit, n.near) AS county_at, i.hit IS NOT NULL AS inside FROM nearest n LEFT JOIN (SELECT sensor_id, arg_min(hit, ord) AS hit FROM inside GROUP BY 1) i USING (sensor_id)")
def j7(spark, sf):
    return P.county_of_point(A.sensors(spark, sf), A.county_rings(spark, sf), A.dim_county(spark, sf)).select("sensor_id", "county_at", "inside")


@query("j8_nearest_county", "SELECT sensor_id, near AS county, round(km, 6) AS km FROM nearest")
def j8(spark, sf):
    return P.nearest_county(A.sensors(spark, sf), A.dim_county(spark, sf)).select("sensor_id", F.col("nearest_county").alias("county"), F.round("nearest_km", 6).alias("km"))


@query("j9_nearest_zip", f"""SELECT sensor_id, arg_min(zip5, row(km, ord)) AS zip5, round(min(km), 6) AS km FROM (SELECT s.sensor_id, z.zip5, z.ord, {hav('s.lat','s.lon','z.lat','z.lon')} AS km
    FROM sensors s CROSS JOIN zips z) WHERE km < 15 GROUP BY 1""")
def j9(spark, sf):
    return P.nearest_zip(A.sensors(spark, sf), "sensor_id", zips(spark, sf)).select("sensor_id", "zip5", F.round("km", 6).alias("km"))


def state_rings(spark, sf, state="2"):
    """Outline rings of one state as a constant (its counties' rings; a few dozen points)."""
    import json

    from gossamer.plans.bounded import bounded_rows

    rows = bounded_rows(A.county_rings(spark, sf).filter(F.col("state_id") == state).select("rings"), 200)
    return F.from_json(F.lit(json.dumps([ring for r in rows for ring in r["rings"]])), "array<array<array<double>>>")


INSTATE = "sensor_id IN (SELECT sensor_id FROM inside WHERE hit IN (SELECT county_id FROM dim_county WHERE state_id = '2'))"


@query("f10_in_state", f"SELECT sensor_id FROM sensors WHERE {INSTATE}")
def f10(spark, sf):
    return in_or_near(A.sensors(spark, sf), state_rings(spark, sf)).select("sensor_id")


GAPX = "((x1 - p.lon) * 111.32 * cos(radians(p.lat)))"
GAP = """SELECT sensor_id, hit, px, py, sqrt(px*px + py*py) AS km FROM (SELECT *, ax + f*dx AS px, ay + f*dy AS py FROM (SELECT *, coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    -(ax*dx + ay*dy) / nullif(dx*dx + dy*dy, 0))), 0) AS f FROM (SELECT p.sensor_id, e.county_id AS hit, (x1 - p.lon)*111.32::DOUBLE*cos(radians(p.lat)) AS ax, (y1 - p.lat)*110.57::DOUBLE AS ay,
    (x2 - x1)*111.32::DOUBLE*cos(radians(p.lat)) AS dx, (y2 - y1)*110.57::DOUBLE AS dy FROM sensors p CROSS JOIN county_edges e)))"""
table_sql("gaps", GAP)


@query("f11_in_or_near_state", f"""SELECT sensor_id FROM sensors WHERE {INSTATE} OR sensor_id IN (SELECT sensor_id FROM gaps
    WHERE hit IN (SELECT county_id FROM dim_county WHERE state_id = '2') AND km <= 10)""")
def f11(spark, sf):
    return in_or_near(A.sensors(spark, sf), state_rings(spark, sf), 10.0).select("sensor_id")


@query("x3_point_in_polygon", "SELECT s.sensor_id, i.hit IS NOT NULL AS inside FROM sensors s LEFT JOIN inside i ON i.sensor_id = s.sensor_id AND i.hit = s.county_id")
def x3(spark, sf):
    r = A.county_rings(spark, sf).select("county_id", "rings")
    return A.sensors(spark, sf).join(r, "county_id").select("sensor_id", geo.point_in_polygon("lat", "lon", "rings").alias("inside"))


@query("x5_polygon_gap", "SELECT s.sensor_id, round(min(km), 6) AS km FROM sensors s JOIN gaps g ON g.sensor_id = s.sensor_id AND g.hit = s.county_id GROUP BY 1")
def x5(spark, sf):
    r = A.county_rings(spark, sf).select("county_id", "rings")
    return A.sensors(spark, sf).join(r, "county_id").select("sensor_id", F.round(geo.polygon_gap("lat", "lon", "rings")["km"], 6).alias("km"))


@query("x1_haversine", f"SELECT s.sensor_id, round({hav('s.lat','s.lon','c.lat','c.lon')}, 6) AS km FROM sensors s JOIN dim_county c USING (county_id)")
def x1(spark, sf):
    c = A.dim_county(spark, sf).select("county_id", F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    return A.sensors(spark, sf).join(c, "county_id").select("sensor_id", F.round(geo.haversine_km("lat", "lon", "clat", "clon"), 6).alias("km"))


NAMES = "['north','northeast','east','southeast','south','southwest','west','northwest']"


@query("x4_bearing_compass", f"""SELECT sensor_id, round(d, 6) AS bearing, {NAMES}[CAST(round_even(d / 45, 0) AS BIGINT) % 8 + 1] AS side FROM (
    SELECT sensor_id, CASE WHEN a < 0 THEN a + 360 ELSE a END AS d FROM (SELECT s.sensor_id, degrees(atan2(s.lon - c.lon, s.lat - c.lat)) AS a FROM sensors s JOIN dim_county c USING (county_id)))""")
def x4(spark, sf):
    c = A.dim_county(spark, sf).select("county_id", F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    b = geo.bearing_deg(F.col("lon") - F.col("clon"), F.col("lat") - F.col("clat"))
    return A.sensors(spark, sf).join(c, "county_id").select("sensor_id", F.round(b, 6).alias("bearing"), geo.compass(b).alias("side"))


@query("j26_gauges_near_county", f"SELECT c.county_id, s.sensor_id AS site, round({hav('c.lat','c.lon','s.lat','s.lon')}, 6) AS km FROM dim_county c JOIN sensors s ON {hav('c.lat','c.lon','s.lat','s.lon')} <= 40 WHERE s.kind = 'station'")
def j26(spark, sf):
    g = A.sensors(spark, sf).filter("kind = 'station'").select(F.col("sensor_id").alias("site"), "lat", "lon")
    return P.gauges_near_county(A.dim_county(spark, sf), g).withColumn("km", F.round("km", 6))


@query("j27_air_near_county", f"""SELECT county_id, arg_min(seq, row(k, -epoch_us(observed_at), -seq)) AS seq, round(min(k), 6) AS km FROM (
    SELECT c.county_id, s.seq, s.observed_at, round({hav('c.lat','c.lon','s.lat','s.lon')}, 9) AS k FROM dim_county c CROSS JOIN signals s
    WHERE s.observed_at >= {NOW} - INTERVAL 72 HOURS AND s.metric = 'error') WHERE k <= 40 GROUP BY 1""")
def j27(spark, sf):
    r = A.signals(spark, sf).filter("metric = 'error'")
    return P.air_near_county(A.dim_county(spark, sf), r, now(spark, sf), hours=72).select("county_id", "seq", F.round("km", 6).alias("km"))


@query("j28_neighbor_counties", f"""SELECT county_id, neighbor, rank, n_readings FROM (SELECT a.county_id, b.county_id AS neighbor, row_number() OVER (PARTITION BY a.county_id
    ORDER BY round({hav('a.lat','a.lon','b.lat','b.lon')}, 9), b.ord) AS rank FROM dim_county a JOIN dim_county b ON a.county_id <> b.county_id AND {hav('a.lat','a.lon','b.lat','b.lon')} <= 130)
    JOIN (SELECT county_id AS neighbor, count(*) AS n_readings FROM signals GROUP BY 1) USING (neighbor) WHERE rank <= 6""")
def j28(spark, sf):
    n = A.signals(spark, sf).groupBy(F.col("county_id").alias("neighbor")).agg(F.count(F.lit(1)).alias("n_readings"))
    return P.neighbor_counties(A.dim_county(spark, sf), km=130.0).join(n, "neighbor").select("county_id", "neighbor", F.col("rank").cast("long").alias("rank"), "n_readings")


LAT, LON = 39.5, -89.3


@query("j29_near_view", f"""SELECT 'reading' AS part, CAST(seq AS VARCHAR) AS id FROM assessed WHERE observed_at >= {NOW} - INTERVAL 240 HOURS AND quality <> 'rejected' AND {hav(LAT, LON, 'lat', 'lon')} <= 60
    UNION ALL SELECT DISTINCT 'alert', group_key FROM alert_rows WHERE county_id = '7' AND expires > {NOW} - INTERVAL 24 HOURS
    UNION ALL SELECT 'event', e.event_id FROM event_rows e JOIN (SELECT event_id, arg_min(lat, seq) AS lat, arg_min(lon, seq) AS lon FROM event_members GROUP BY 1) p USING (event_id)
      WHERE status = 'open' AND {hav(LAT, LON, 'p.lat', 'p.lon')} <= 120""")
def j29(spark, sf):
    n = now(spark, sf)
    al = A.alert_rows(spark, sf).withColumn("expires", F.col("expires") + F.expr("INTERVAL 24 HOURS"))
    return P.near_view(A.assessed(spark, sf), al, events(spark, sf), LAT, LON, "7", n, hours=240, km=60)


@query("a35_near_summary", f"""SELECT metric, CASE WHEN direction = 'below' THEN min(value) ELSE max(value) END AS peak, count(*) FILTER (kind = 'human') AS people,
    count(*) FILTER (kind <> 'human') AS others, epoch_us(max(observed_at)) AS latest FROM assessed JOIN dim_metric USING (metric)
    WHERE observed_at >= {NOW} - INTERVAL 240 HOURS AND quality <> 'rejected' AND {hav(LAT, LON, 'lat', 'lon')} <= 60 GROUP BY metric, direction""")
def a35(spark, sf):
    return P.near_summary(A.assessed(spark, sf), A.dim_metric(spark), LAT, LON, now(spark, sf), 240, 60).withColumn("latest", us("latest"))


PUB = """SELECT s.seq, round_even(coalesce(z.lat, c.lat), 4) AS pub_lat, round_even(coalesce(z.lon, c.lon), 4) AS pub_lon, s.kind, s.sensor_id, s.metric, s.quality, s.lat, s.lon, s.observed_at
    FROM assessed s LEFT JOIN (SELECT zip5, arg_min(lat, ord) AS lat, arg_min(lon, ord) AS lon FROM zips GROUP BY 1) z USING (zip5) LEFT JOIN dim_county c ON c.county_id = s.county_id"""
table_sql("pub", PUB)


def zip_table(spark, sf):
    first = zips(spark, sf).groupBy("zip5").agg(F.min_by(F.struct("ord", "county_id", "lat", "lon"), "ord").alias("z"))
    return first.select("zip5", "z.*")


@query("x13_public_point", "SELECT seq, pub_lat, pub_lon FROM pub")
def x13(spark, sf):
    return P.public_points(A.assessed(spark, sf), zip_table(spark, sf), A.dim_county(spark, sf)).select("seq", "pub_lat", "pub_lon")


@query("a27_map_reports", f"""SELECT seq, metric, CASE WHEN kind <> 'official' THEN 's-' || substr(sha1(CAST(sensor_id AS VARCHAR)), 1, 5) ELSE 'official report' END AS who, quality,
    CASE WHEN kind <> 'official' THEN pub_lat ELSE round_even(lat, 4) END AS lat, CASE WHEN kind <> 'official' THEN pub_lon ELSE round_even(lon, 4) END AS lon FROM pub
    WHERE observed_at >= {NOW} - INTERVAL 24 HOURS AND kind IN ('human','bot','official')""")
def a27(spark, sf):
    return P.map_reports(A.assessed(spark, sf), zip_table(spark, sf), A.dim_county(spark, sf), now(spark, sf))


# ── grids ──

MINUTES = {"30m": 30, "1h": 60, "6h": 360, "24h": 1440}
GRID_METRICS = ["click", "purchase"]
TOL_ABS, TOL_REL, MIN_SIGNAL, FAR = 40.0, 0.35, 10.0, 3.0


def products(spark, sf):
    """Products whose valid times follow the readings' hours: each window refreshes at its own pace."""
    hours = A.table(spark, sf, "events").select(F.floor(us("ts") / 3600000000).alias("h")).distinct()
    w = spark.createDataFrame([(m, k, v) for m in GRID_METRICS for k, v in MINUTES.items()], "metric string, window string, minutes int")
    j = hours.withColumn("metric", F.explode(F.array(*[F.lit(m) for m in GRID_METRICS]))).join(F.broadcast(w), "metric")
    return j.select("metric", "window", "minutes", F.timestamp_micros((F.col("h") + 1) * 3600000000).alias("valid_at"))


def grid_rules(spark):
    return spark.createDataFrame([(m, 360, list(MINUTES)) for m in GRID_METRICS], "metric string, default_minutes int, periods array<string>")


def cells(spark, sf):
    """0.1 degree cells over the state; values come from the readings-independent rule of the fixture, masked to the rows in use."""
    raw = A.signals(spark, sf).select("lat", "lon").distinct()
    r0, c0 = F.bround((F.lit(42.5) - F.col("lat")) / 0.1, 0).cast("long"), F.bround((F.col("lon") + 91.5) / 0.1, 0).cast("long")
    near = raw.withColumn("row", F.explode(F.sequence(r0 - 1, r0 + 1))).withColumn("col", F.explode(F.sequence(c0 - 1, c0 + 1))).select("row", "col").distinct()
    v = F.when((F.col("row") + F.col("col")) % 11 == 0, -3.0).otherwise(F.pmod(F.col("row") * 31 + F.col("col") * 17, F.lit(500)).cast("double"))
    return G.load_grid_cells(near.withColumn("value", v))


table_sql("prods", """SELECT m AS metric, w.win AS win, w.minutes, make_timestamp((h + 1) * 3600000000) AS valid_at FROM (SELECT DISTINCT epoch_us(ts) // 3600000000 AS h FROM events)
    CROSS JOIN (VALUES ('click'), ('purchase')) x(m) CROSS JOIN (VALUES ('30m', 30), ('1h', 60), ('6h', 360), ('24h', 1440)) w(win, minutes)""")
table_sql("cell_tab", """SELECT "row", col, CASE WHEN ("row" + col) % 11 = 0 THEN NULL ELSE CAST((("row"*31 + col*17) % 500 + 500) % 500 AS DOUBLE) END AS value FROM (
    SELECT DISTINCT r0 + i AS "row", c0 + j AS col FROM (SELECT CAST(round_even((42.5::DOUBLE - lat) / 0.1::DOUBLE, 0) AS BIGINT) AS r0, CAST(round_even((lon + 91.5::DOUBLE) / 0.1::DOUBLE, 0) AS BIGINT) AS c0
    FROM (SELECT DISTINCT lat, lon FROM signals)) CROSS JOIN range(-1, 2) a(i) CROSS JOIN range(-1, 2) b(j))""")
table_sql("as_of", f"""SELECT seq, arg_min(win, row(minutes, valid_at)) AS win, epoch_us(arg_min(valid_at, row(minutes, valid_at))) AS valid_us FROM (
    SELECT s.seq, p.win, p.minutes, p.valid_at FROM signals s JOIN dim_metric m USING (metric) JOIN prods p ON p.metric = s.metric AND s.observed_at <= p.valid_at
      AND p.valid_at - to_minutes(p.minutes) <= s.observed_at - CASE WHEN m.accumulates AND s.period IS NOT NULL THEN INTERVAL 0 MINUTES ELSE INTERVAL 15 MINUTES END
      AND CASE WHEN NOT m.accumulates THEN true WHEN s.period IS NOT NULL THEN p.win = s.period ELSE p.minutes >= 360 END
    WHERE s.kind IN {PEOPLE}) GROUP BY 1""")
CELL_LA, CELL_LO = '(42.5::DOUBLE - c."row" * 0.1::DOUBLE)', "(-91.5::DOUBLE + c.col * 0.1::DOUBLE)"
table_sql("sampled", f"""SELECT s.seq, arg_max(c.value, row(c.value, -c."row", -c.col)) AS grid_value, arg_max(c."row", row(c.value, -c."row", -c.col)) AS "row",
    arg_max(c.col, row(c.value, -c."row", -c.col)) AS col FROM signals s JOIN cell_tab c
    ON c."row" BETWEEN CAST(round_even((42.5::DOUBLE - s.lat) / 0.1::DOUBLE, 0) AS BIGINT) - 2 AND CAST(round_even((42.5::DOUBLE - s.lat) / 0.1::DOUBLE, 0) AS BIGINT) + 2
    AND c.col BETWEEN CAST(round_even((s.lon + 91.5::DOUBLE) / 0.1::DOUBLE, 0) AS BIGINT) - 2 AND CAST(round_even((s.lon + 91.5::DOUBLE) / 0.1::DOUBLE, 0) AS BIGINT) + 2
    AND c.value IS NOT NULL AND {hav('s.lat', 's.lon', CELL_LA, CELL_LO)} <= 12
    WHERE s.kind IN {PEOPLE} AND s.metric IN ('click','purchase') GROUP BY 1""")
table_sql("verdicts", f"""SELECT seq, win, CASE WHEN g IS NULL THEN 'nodata' WHEN g >= 10 AND abs(value - g) <= greatest(40, 0.35::DOUBLE * greatest(abs(value), abs(g))) THEN 'agree'
    WHEN g >= 10 AND greatest(value, g) / greatest(least(value, g), 1e-9) >= 3 AND abs(value - g) > 80 THEN 'far' WHEN g >= 10 THEN 'disagree'
    WHEN ev THEN 'disagree' ELSE 'quiet' END AS verdict FROM (SELECT s.seq, a.win, s.value, p.grid_value AS g, s.seq IN (SELECT seq FROM crossings) AS ev
    FROM signals s JOIN as_of a USING (seq) LEFT JOIN sampled p USING (seq))""")


def grid_readings(spark, sf):
    s = A.signals(spark, sf).filter(X.is_people() & F.col("metric").isin(*GRID_METRICS))
    return s.join(F.broadcast(A.dim_metric(spark).select("metric", "accumulates", "thresholds", "direction")), "metric")


@query("s21_load_grid_cells", 'SELECT "row", col, value FROM cell_tab')
def s21(spark, sf):
    return cells(spark, sf)


@query("j22_grid_as_of", "SELECT seq, win, valid_us FROM as_of")
def j22(spark, sf):
    r = G.grid_as_of(grid_readings(spark, sf), products(spark, sf), grid_rules(spark))
    return r.filter("window is not null").select("seq", F.col("window").alias("win"), "valid_us")


@query("j23_grid_sample", 'SELECT seq, grid_value, "row", col FROM sampled')
def j23(spark, sf):
    return G.grid_sample(grid_readings(spark, sf), cells(spark, sf), [], 42.5, -91.5, 0.1, 12.0)


def verdicts(spark, sf):
    r = G.grid_as_of(grid_readings(spark, sf), products(spark, sf), grid_rules(spark)).filter("window is not null")
    g = G.grid_sample(grid_readings(spark, sf), cells(spark, sf), [], 42.5, -91.5, 0.1, 12.0).select("seq", "grid_value")
    ev = X.severity("value", "thresholds", "direction") > 0
    return r.join(g, "seq", "left").withColumn("verdict", G.grid_verdict("value", "grid_value", MIN_SIGNAL, TOL_ABS, TOL_REL, FAR, ev))


@query("a10_grid_verdict", "SELECT seq, win, verdict FROM verdicts")
def a10(spark, sf):
    return verdicts(spark, sf).select("seq", F.col("window").alias("win"), "verdict")


# ── audiences ──

ROUTING = [(4, "warnings", 1), (4, "alerts", 2), (3, "warnings", 2), (3, "alerts", 3), (2, "alerts", 4), (1, "digest", 9)]
ROUTE_SQL = ", ".join(f"({a}, '{b}', {c})" for a, b, c in ROUTING)


@query("j10_subscribers_for", """WITH t AS (SELECT event_id AS target_id, 'st.' || county_id AS k2, county_id FROM event_rows WHERE severity >= 1)
    SELECT DISTINCT t.target_id, s.category, s.chat_id FROM t JOIN subscriptions s ON s.category = 'events' AND (s.area = 'st' OR s.area = t.k2
      OR (s.area LIKE 'st.zip.%' AND substr(s.area, 8, 5) IN (SELECT zip5 FROM zips z WHERE z.county_id = t.county_id)))
    WHERE s.chat_id NOT IN (SELECT chat_id FROM sensors WHERE status = 'banned')""")
def j10(spark, sf):
    zc = zips(spark, sf).groupBy("county_id").agg(F.collect_set("zip5").alias("zips"))
    t = events(spark, sf).filter("severity >= 1").join(zc, "county_id", "left").select(
        F.col("event_id").alias("target_id"), F.lit("events").alias("category"), F.array(F.lit("st"), F.concat(F.lit("st."), "county_id")).alias("area_keys"),
        F.coalesce("zips", F.array().cast("array<string>")).alias("zips"))
    return AU.subscribers_for(t, A.subscriptions(spark, sf), A.sensors(spark, sf))


@query("j11_alert_audience", f"""SELECT a.alert_id, s.chat_id, min(r.priority) AS priority FROM alert_rows a JOIN (VALUES {ROUTE_SQL}) r(severity, category, priority) ON r.severity = a.severity
    JOIN subscriptions s ON s.category = r.category AND (s.area = 'st' OR s.area = 'st.' || a.county_id
      OR (s.area LIKE 'st.zip.%' AND EXISTS (SELECT 1 FROM zips z WHERE z.zip5 = substr(s.area, 8, 5) AND z.county_id = a.county_id)))
    WHERE s.chat_id NOT IN (SELECT chat_id FROM sensors WHERE status = 'banned') GROUP BY 1, 2""")
def j11(spark, sf):
    al = A.alert_rows(spark, sf)
    routing = spark.createDataFrame(ROUTING, "severity long, category string, priority int")
    return AU.alert_audience(al, routing, zips(spark, sf).select("zip5", "county_id").distinct(), A.subscriptions(spark, sf), A.sensors(spark, sf))


@query("j12_not_yet_notified", """SELECT "key", chat_id FROM outbox WHERE status = 'pending' AND id % 4 <> 0 AND chat_id <> id % 50""")
def j12(spark, sf):
    o = A.outbox(spark, sf)
    return AU.not_yet_notified(o.filter("status = 'pending'").withColumn("author", F.col("id") % 50), o.filter("id % 4 = 0"), "author").select("key", "chat_id")


def located(spark, sf):
    """Alerts with a polygon around their county and a motion, and the people of nearby counties."""
    al = A.alert_rows(spark, sf).join(A.county_rings(spark, sf).select(
        "county_id", F.col("rings").alias("polygon"), F.col("lat").alias("clat"), F.col("lon").alias("clon")), "county_id")
    people = A.sensors(spark, sf).filter("kind = 'human'").select((F.col("sensor_id") % 25).cast("string").alias("county_id"), "chat_id", "lat", "lon")
    k = F.col("alert_id")
    al = al.select(
        "alert_id", "county_id", "polygon", "sent", "expires", F.col("sent").alias("motion_at"), ((k * 37) % 360).cast("double").alias("from_deg"),
        (F.lit(20) + k % 40).cast("double").alias("speed_kt"),
        F.array(F.array(F.col("clat") - 0.3, F.col("clon") - 0.3), F.array(F.col("clat") + 0.3, F.col("clon") + 0.3)).alias("points"))
    return al, people


table_sql("aud", f"""SELECT a.alert_id, p.chat_id, p.sensor_id, p.lat, p.lon, a.sent, a.expires, a.county_id, c.lat AS clat, c.lon AS clon, CAST((a.alert_id*37) % 360 AS DOUBLE) AS from_deg,
    CAST(20 + a.alert_id % 40 AS DOUBLE) AS kt FROM alert_rows a JOIN dim_county c USING (county_id) JOIN sensors p ON p.county_id = a.county_id
    WHERE p.kind = 'human'""")
_A = "((({lo}) - lon)*111.32::DOUBLE*cos(radians(lat))*ux + (({la}) - lat)*110.57::DOUBLE*uy)"
_C = "((({lo}) - lon)*111.32::DOUBLE*cos(radians(lat))*uy - (({la}) - lat)*110.57::DOUBLE*ux)"
_P1, _P2 = dict(la="clat - 0.3::DOUBLE", lo="clon - 0.3::DOUBLE"), dict(la="clat + 0.3::DOUBLE", lo="clon + 0.3::DOUBLE")
table_sql("frames", f"""SELECT *, {_A.format(**_P1)} AS a1, {_C.format(**_P1)} AS c1, {_A.format(**_P2)} AS a2, {_C.format(**_P2)} AS c2 FROM (
    SELECT *, sin(radians((from_deg + 180) % 360)) AS ux, cos(radians((from_deg + 180) % 360)) AS uy, kt * 1.852::DOUBLE AS speed FROM aud)""")
table_sql("arrivals", """SELECT *, CASE WHEN hours <= 3 THEN hours END AS h FROM (SELECT *, -greatest(CASE WHEN a1 < 0 AND abs(c1) <= 10 THEN a1 END, CASE WHEN a2 < 0 AND abs(c2) <= 10 THEN a2 END,
    CASE WHEN c1 <> c2 AND least(c1, c2) <= 0 AND greatest(c1, c2) >= 0 AND a1 - (a2 - a1)*c1/nullif(c2 - c1, 0) < 0 THEN a1 - (a2 - a1)*c1/nullif(c2 - c1, 0) END) / speed AS hours FROM frames)""")


@query("x6_storm_arrival", "SELECT alert_id, chat_id, round(h, 6) AS hours FROM arrivals")
def x6(spark, sf):
    return AU.unfolded(AU.audience_places(*located(spark, sf)).withColumn("hours", F.round("hours", 6)), "hours")


@query("j31_audience_location", f"""SELECT a.alert_id, a.chat_id, i.hit IS NOT NULL AS inside, CASE WHEN i.hit IS NULL THEN round(g.km, 6) END AS km_outside,
    CASE WHEN i.hit IS NULL THEN {NAMES}[CAST(round_even(CASE WHEN deg < 0 THEN deg + 360 ELSE deg END / 45, 0) AS BIGINT) % 8 + 1] END AS side, a.h IS NOT NULL AS reached
    FROM arrivals a LEFT JOIN inside i ON i.sensor_id = a.sensor_id AND i.hit = a.county_id
    JOIN (SELECT sensor_id, hit, min(km) AS km, arg_min(degrees(atan2(-px, -py)), km) AS deg FROM gaps GROUP BY 1, 2) g ON g.sensor_id = a.sensor_id AND g.hit = a.county_id""")
def j31(spark, sf):
    met = AU.audience_places(*located(spark, sf)).withColumn("km_outside", F.round("km_outside", 6))
    loc = AU.unfolded(met, "inside", "km_outside", "side", "hours", alert=("motion_at",))
    return loc.select("alert_id", "chat_id", "inside", "km_outside", "side", AU.arrival_us(F.col("motion_at"), F.col("hours")).isNotNull().alias("reached"))


@query("x31_when_there", """SELECT alert_id, chat_id, CASE WHEN h IS NOT NULL AND arr >= epoch_us(sent) AND arr <= epoch_us(expires) THEN arr // 1000000 ELSE (epoch_us(sent) + 10800000000) // 1000000 END AS at_s
    FROM (SELECT *, epoch_us(sent) + CAST(trunc(h * 3600e6) AS BIGINT) AS arr FROM arrivals)""")
def x31(spark, sf):
    loc = AU.unfolded(AU.audience_places(*located(spark, sf)), "hours", alert=("sent", "expires", "motion_at"))
    return loc.select("alert_id", "chat_id", F.floor(AU.when_there(us("sent"), us("expires"), AU.arrival_us(F.col("motion_at"), F.col("hours"))) / 1000000).alias("at_s"))


@query("j32_question_eligible", f"""SELECT a.alert_id, a.chat_id FROM aud a JOIN inside i ON i.sensor_id = a.sensor_id AND i.hit = a.county_id
    WHERE a.chat_id NOT IN (SELECT user_id * 10 FROM events WHERE event_type = 'signup' AND ts > {NOW} - INTERVAL 6 HOURS)""")
def j32(spark, sf):
    asked = A.table(spark, sf, "events").filter("event_type = 'signup'").select((F.col("user_id") * 10).alias("chat_id"), F.col("ts").alias("asked_at"))
    return AU.question_eligible(*located(spark, sf), asked, now(spark, sf)).select("alert_id", "chat_id")


@query("x36_storm_track", """SELECT alert_id, m AS minute, round(clat + kt*1.852::DOUBLE*m/60.0::DOUBLE*cos(radians((from_deg + 180) % 360))/110.57::DOUBLE, 6) AS lat,
    round(clon + kt*1.852::DOUBLE*m/60.0::DOUBLE*sin(radians((from_deg + 180) % 360))/(111.32::DOUBLE*cos(radians(clat))), 6) AS lon FROM (
    SELECT a.alert_id, c.lat AS clat, c.lon AS clon, CAST((a.alert_id*37) % 360 AS DOUBLE) AS from_deg, CAST(20 + a.alert_id % 40 AS DOUBLE) AS kt FROM alert_rows a JOIN dim_county c USING (county_id))
    CROSS JOIN (VALUES (15), (30), (45), (60)) v(m)""")
def x36(spark, sf):
    k = F.col("alert_id")
    al = A.alert_rows(spark, sf).join(A.dim_county(spark, sf).select("county_id", F.col("lat").alias("clat"), F.col("lon").alias("clon")), "county_id")
    t = al.select("alert_id", F.explode(geo.storm_track(((k * 37) % 360).cast("double"), (F.lit(20) + k % 40).cast("double"), "clat", "clon")).alias("p"))
    return t.select("alert_id", F.col("p.minute").alias("minute"), F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


@query("j35_settled_notes", f"""SELECT f.seq, p.chat_id, a.user_id AS witness, round({hav('f.lat', 'f.lon', 'w.lat', 'w.lon')} / 1.609344::DOUBLE, 6) AS miles,
    round((epoch_us(a.sent) - epoch_us(f.observed_at)) / 60e6, 6) AS minutes_ahead FROM (SELECT s.*, b.alert_id FROM signals s JOIN by_alert b USING (seq)) f
    JOIN alert_rows a ON a.alert_id = f.alert_id JOIN sensors w ON w.sensor_id = a.user_id JOIN sensors p ON p.sensor_id = f.sensor_id WHERE p.kind = 'human' AND a.user_id <> f.sensor_id""")
def j35(spark, sf):
    from gossamer.operators import corroborate as C

    s, al = A.signals(spark, sf), A.standing_alerts(spark, sf)
    by = C.settle_by_alert(s, al, A.dim_alert_support(spark), A.dim_metric(spark)).select("seq", "alert_id")
    w = al.join(A.sensors(spark, sf).select(F.col("sensor_id").alias("user_id"), F.col("lat").alias("w_lat"), F.col("lon").alias("w_lon")), "user_id").select(
        "alert_id", F.col("user_id").alias("w_sensor_id"), "w_lat", "w_lon", F.col("sent").alias("w_at"))
    st = s.join(by, "seq").join(w, "alert_id")
    return AU.settled_notes(st, A.sensors(spark, sf)).select("seq", "chat_id", "witness", F.round("miles", 6).alias("miles"), F.round("minutes_ahead", 6).alias("minutes_ahead"))


@query("j35_event_contributors", """WITH m AS (SELECT * FROM event_members WHERE kind = 'human' AND event_id IN (SELECT event_id FROM event_members GROUP BY 1 HAVING count(DISTINCT sensor_id) >= 2))
    SELECT DISTINCT event_id, sensor_id FROM m WHERE row(event_id, sensor_id) NOT IN (SELECT row(event_id, arg_max(sensor_id, seq)) FROM m GROUP BY event_id)""")
def j35e(spark, sf):
    m = members(spark, sf)
    ok = m.groupBy("event_id").agg(F.count_distinct("sensor_id").alias("k")).filter("k >= 2")
    return AU.event_contributors(m, ok)


# ── outlooks ──

def outlooks(spark, sf):
    k = F.col("alert_id")
    al = A.standing_alerts(spark, sf).join(A.dim_county(spark, sf).select("county_id", F.col("lat").alias("la"), F.col("lon").alias("lo")), "county_id")

    def square(d):
        return F.array(*[F.array(F.col("lo") + dx * d, F.col("la") + dy * d) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1))])

    hole = F.when(k % 2 == 0, F.array(square(1.2), square(0.3))).otherwise(F.array(square(1.2)))
    return al.select(F.lit("storms").alias("name"), (1 + k % 3).alias("day"), (1 + k % 5).alias("level"), F.col("sent").alias("valid_from"),
                     (F.col("sent") + F.expr("INTERVAL 24 HOURS")).alias("valid_to"), F.array(hole).alias("polygons"))


SQ = "({p}.lat >= la - {d} AND {p}.lat < la + {d} AND {p}.lon >= lo - {d} AND {p}.lon < lo + {d})"
table_sql("looks", f"""SELECT * FROM (SELECT alert_id, 1 + alert_id % 3 AS day, 1 + alert_id % 5 AS "level", c.lat AS la, c.lon AS lo, min(1 + alert_id % 3) OVER () AS first_day
    FROM alert_rows a JOIN dim_county c USING (county_id) WHERE sent <= {NOW} - INTERVAL 100 HOURS AND {NOW} - INTERVAL 100 HOURS < sent + INTERVAL 24 HOURS) WHERE day = first_day""")


def in_look(p):
    return f"({SQ.format(p=p, d='1.2::DOUBLE')} AND NOT (alert_id % 2 = 0 AND {SQ.format(p=p, d='0.3::DOUBLE')}))"


@query("j24_outlook_over_point", f"""SELECT s.sensor_id, 'storms' AS name, max(o."level") AS "level" FROM (SELECT sensor_id, lat + 0.003::DOUBLE AS lat, lon + 0.003::DOUBLE AS lon FROM sensors) s JOIN looks o ON {in_look('s')} GROUP BY 1""")
def j24(spark, sf):
    pts = A.sensors(spark, sf).select("sensor_id", (F.col("lat") + 0.003).alias("lat"), (F.col("lon") + 0.003).alias("lon"))
    return H.outlook_over_point(pts, "sensor_id", outlooks(spark, sf), hours_before(now(spark, sf), 100))


@query("j25_counties_at_risk", f"""SELECT 'storms' AS name, "level", array_to_string(list_sort(list(name)), ';') AS counties FROM (SELECT c.name, max(o."level") AS "level"
    FROM (SELECT name, lat + 0.003::DOUBLE AS lat, lon + 0.003::DOUBLE AS lon FROM dim_county) c JOIN looks o ON {in_look('c')} GROUP BY 1) GROUP BY 2""")
def j25(spark, sf):
    c = A.dim_county(spark, sf).withColumn("lat", F.col("lat") + 0.003).withColumn("lon", F.col("lon") + 0.003)
    return H.counties_at_risk(c, outlooks(spark, sf), hours_before(now(spark, sf), 100)).withColumn("counties", F.array_join("counties", ";"))
