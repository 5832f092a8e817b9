"""Feed normalizers over files: Spark lands the payloads it makes from the driver tables, and the readers scan them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gossamer.catalog.joins import hav
from gossamer.catalog.places import zips  # noqa: F401
from gossamer.catalog.registry import query, table_sql
from gossamer.catalog.scalars import PACK
from gossamer.sources import adapter as A
from gossamer.sources import feeds as S
from gossamer.sources import landing as L
from gossamer.sources import messages as MS
from gossamer.sources import vocab as V

us = F.unix_micros
ISO = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"
SEC = "(epoch_us(ts) // 1000000)"
SISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00'"


def batch_of(rows):
    """A fetch holds a bounded slice of a feed."""
    key = next(c for c in ("batch_id", "event_id", "o_orderkey", "seq") if c in rows.columns)
    return F.col(key) if key == "batch_id" else (F.col(key) / 1000).cast("long")


def parsed(rows, struct, ddl):
    """Features of landed FeatureCollection files."""
    return S.read_features(rows.sparkSession, L.write_features(rows, struct, batch_of(rows)), ddl)


def events(spark, sf, kind=None):
    e = A.table(spark, sf, "events")
    return e.filter(F.col("event_type") == kind) if kind else e


def fips(col):
    return F.concat(F.lit("17"), F.lpad(col.cast("string"), 3, "0"))


def dim(spark, sf):
    """Counties with a five-digit code as their id."""
    return A.dim_county(spark, sf).withColumn("county_id", fips(F.col("ord"))).withColumn("fips", F.col("county_id"))


table_sql("counties5", "SELECT '17' || lpad(county_id, 3, '0') AS county_id, ord, name, lat, lon FROM dim_county")

SEVS = ["Extreme", "Severe", "Moderate", "Minor", "Unknown"]
K = F.col


def alert_features(spark, sf):
    e, k, u = events(spark, sf, "error"), F.col("event_id"), F.col("user_id")
    iso = F.date_format("ts", ISO)
    sev = F.element_at(F.array(*[F.lit(s) for s in SEVS]), (k % 5 + 1).cast("int"))
    same = F.array(F.concat(F.lit("0"), fips(u % 25)), F.concat(F.lit("0"), fips((u + 7) % 25)), F.concat(F.lit("0"), fips(u % 25)), F.lit("099999"))
    poly = F.lit("[[[-90.0,38.0],[-89.0,38.0],[-89.0,39.0]]]")
    params = F.create_map(
        F.lit("maxHailSize"), F.array(F.concat(F.lit("Up to ."), (k % 90 + 10).cast("string"))), F.lit("maxWindGust"), F.array(F.concat((k % 80).cast("string"), F.lit(" MPH"))),
        F.lit("threat"), F.array(F.when(k % 3 == 0, " radar indicated").otherwise("observed")),
        F.lit("eventMotionDescription"), F.array(F.when(k % 4 == 3, F.lit("garbled...text")).otherwise(F.concat(iso, F.lit("...storm..."), (k % 360).cast("string"), F.lit("DEG..."), (k % 60).cast("string"), F.lit("KT...38.5,-90.1 38.75,-90.25")))))
    props = F.struct(
        F.concat(F.lit("urn:"), k.cast("string")).alias("id"), F.struct(same.alias("SAME")).alias("geocode"), F.array(F.struct(F.concat(F.lit("urn:"), (k - 1).cast("string")).alias("identifier"))).alias("references"),
        iso.alias("sent"), F.when(k % 2 == 0, F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), ISO)).alias("ends"), F.date_format(F.col("ts") + F.expr("INTERVAL 6 HOURS"), ISO).alias("expires"),
        sev.alias("severity"), F.concat(F.lit("Flash Flood  Kind-"), (k % 3).cast("string")).alias("event"), F.concat(F.lit("Office "), (u % 7).cast("string"), F.lit(" IL")).alias("senderName"),
        F.lit("head").alias("headline"), params.alias("parameters"))
    feat = F.struct(props["id"].alias("id"), F.when(k % 2 == 0, F.struct(F.lit("Polygon").alias("type"), F.from_json(poly, "array<array<array<double>>>").alias("coordinates"))).alias("geometry"), props.alias("properties"))
    return parsed(e, feat, S.ALERT_FEATURE)


SPECS = [("maxHailSize", None), ("maxWindGust", None), ("threat", ["RADAR INDICATED", "OBSERVED"])]


@query("s1_normalize_alerts", f"""SELECT 'urn:' || event_id AS alert_id, c.county_id, 'alert.flash_flood_kind_' || (event_id % 3) AS metric, [4.0,3.0,2.0,1.0,0.0][event_id % 5 + 1]::DOUBLE AS value,
    {SEC} AS sent_s, {SEC} + CASE WHEN event_id % 2 = 0 THEN 7200 ELSE 21600 END AS expires_s, 'nws:office_' || (user_id % 7) || '_il' AS sensor_id,
    substr(sha1('nws_alerts::urn:' || event_id || '|' || c.county_id), 1, 16) AS "key", 'urn:' || (event_id - 1) AS refs, event_id % 2 = 0 AS has_polygon
    FROM events JOIN counties5 c ON c.ord IN (user_id % 25, (user_id + 7) % 25) WHERE event_type = 'error'""")
def s1(spark, sf):
    a = S.normalize_alerts(alert_features(spark, sf), dim(spark, sf), SPECS)
    return a.select("alert_id", "county_id", "metric", "value", F.unix_seconds("observed_at").alias("sent_s"), F.unix_seconds("expires").alias("expires_s"), "sensor_id", "key",
                    F.array_join("references", ",").alias("refs"), F.col("polygon").isNotNull().alias("has_polygon"))


@query("s2_parse_impact", """SELECT event_id AS id, 'maxHailSize' AS tag, NULL::INTEGER AS "level", (event_id % 90 + 10) / 100.0::DOUBLE AS value FROM events WHERE event_type = 'error'
    UNION ALL SELECT event_id, 'maxWindGust', NULL, (event_id % 80)::DOUBLE FROM events WHERE event_type = 'error' AND event_id % 80 > 0
    UNION ALL SELECT event_id, 'threat', CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END, NULL FROM events WHERE event_type = 'error'""")
def s2(spark, sf):
    f = alert_features(spark, sf)
    r = f.select(F.substring_index("f.id", ":", -1).cast("long").alias("id"), F.explode(S.parse_impact(F.col("f.properties.parameters"), SPECS)).alias("x"))
    return r.select("id", "x.tag", "x.level", "x.value")


@query("s3_parse_motion", f"""SELECT event_id AS id, CASE WHEN event_id % 4 <> 3 THEN {SEC} END AS at_s, CASE WHEN event_id % 4 <> 3 THEN (event_id % 360)::DOUBLE END AS from_deg,
    CASE WHEN event_id % 4 <> 3 THEN (event_id % 60)::DOUBLE END AS speed_kt, CASE WHEN event_id % 4 <> 3 THEN -90.25::DOUBLE END AS last_lon FROM events WHERE event_type = 'error'""")
def s3(spark, sf):
    m = S.parse_motion(F.get(F.try_element_at(F.col("f.properties.parameters"), F.lit("eventMotionDescription")), F.lit(0)))
    r = alert_features(spark, sf).select(F.substring_index("f.id", ":", -1).cast("long").alias("id"), m.alias("m"))
    return r.select("id", F.unix_seconds("m.at").alias("at_s"), "m.from_deg", "m.speed_kt", F.get(F.get("m.points", F.lit(1)), F.lit(1)).alias("last_lon"))


MAP_DDL = "code string, metric string, a double, b double, period string, lo double, hi double, is_flag boolean, ord int"


def mapping(spark, rows):
    return spark.createDataFrame(rows, MAP_DDL)


LATLON = ("37.0::DOUBLE + ((user_id*37) % 550)/100.0::DOUBLE", "-91.5::DOUBLE + ((user_id*53) % 450)/100.0::DOUBLE")
LA = lambda: F.lit(37.0) + ((F.col("user_id") * 37) % 550) / F.lit(100.0)
LO = lambda: F.lit(-91.5) + ((F.col("user_id") * 53) % 450) / F.lit(100.0)
table_sql("near5", f"""SELECT user_id, arg_min(county_id, row(km, ord)) AS near, min(km) AS km FROM (SELECT u.user_id, c.county_id, c.ord, {hav('u.la', 'u.lo', 'c.lat', 'c.lon')} AS km
    FROM (SELECT DISTINCT user_id, {LATLON[0]} AS la, {LATLON[1]} AS lo FROM events) u CROSS JOIN counties5 c) GROUP BY 1""")


@query("s4_normalize_storm_reports", f"""SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'hail_mm' ELSE 'tornado' END AS metric, CASE event_type WHEN 'click' THEN value * 25.4::DOUBLE ELSE 1.0 END::DOUBLE AS value,
    CASE WHEN event_id % 3 = 0 THEN c.county_id ELSE n.near END AS county_id, 'lsr:wfo' || (e.user_id % 4) AS sensor_id FROM events e JOIN near5 n USING (user_id) JOIN counties5 c ON c.ord = e.user_id % 25
    WHERE event_type = 'view' OR (event_type = 'click' AND value * 25.4::DOUBLE BETWEEN 0 AND 5000)""")
def s4(spark, sf):
    k = F.col("event_id")
    e = events(spark, sf).withColumn("cn", F.when(k % 3 == 0, F.concat(F.lit("nation-"), (F.col("user_id") % 25).cast("string"), F.lit(" County"))).otherwise("nowhere"))
    kind = F.when(F.col("event_type") == "click", "Hail").when(F.col("event_type") == "view", "TORNADO").otherwise("OTHER")
    feat = F.struct(F.struct(F.array(LO(), LA()).alias("coordinates")).alias("geometry"), F.struct(
        F.concat(F.lit("wfo"), (F.col("user_id") % 4).cast("string")).alias("wfo"), F.col("value").alias("magf"), F.col("cn").alias("county"), kind.alias("typetext"),
        F.date_format("ts", ISO).alias("valid"), k.cast("string").alias("product_id")).alias("properties"))
    m = mapping(spark, [("HAIL", "hail_mm", 25.4, 0.0, None, 0.0, 5000.0, False, 0), ("TORNADO", "tornado", 1.0, 0.0, None, None, None, True, 1)])
    r = S.normalize_storm_reports(parsed(e, feat, S.REPORT_FEATURE), m, dim(spark, sf))
    return r.select(F.col("product_id").cast("long").alias("id"), "metric", "value", "county_id", "sensor_id")


STATION_MAP = [("tmpf", "temp_c", 5 / 9, -32 * 5 / 9, None, -45.0, 55.0, False, 0), ("gust", "gust_ms", 0.514444, 0.0, None, 0.0, 120.0, False, 1), ("phour", "rain_mm", 25.4, 0.0, "1h", 0.0, 500.0, False, 2)]


@query("s5_normalize_stations", f"""SELECT station, sec, metric, round(value, 6) AS value, period, county_id FROM (
    SELECT 'K' || user_id AS station, {SEC} AS sec, 'temp_c' AS metric, value*(5.0::DOUBLE/9) - 32*5.0::DOUBLE/9 AS value, NULL AS period, user_id FROM events WHERE event_id % 3 <> 0
    UNION ALL SELECT 'K' || user_id, {SEC}, 'gust_ms', value*0.514444::DOUBLE, NULL, user_id FROM events WHERE event_id % 2 = 0
    UNION ALL SELECT 'K' || user_id, {SEC}, 'rain_mm', value*25.4::DOUBLE, '1h', user_id FROM events WHERE event_id % 5 = 0) JOIN (SELECT user_id, near AS county_id FROM near5) USING (user_id)
    WHERE CASE metric WHEN 'temp_c' THEN value BETWEEN -45 AND 55 WHEN 'gust_ms' THEN value BETWEEN 0 AND 120 ELSE value BETWEEN 0 AND 500 END""")
def s5(spark, sf):
    k, v = F.col("event_id"), F.col("value")
    none = F.lit(None).cast("double")
    rows = events(spark, sf).select(
        "event_id", F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("station"), F.lit("n").alias("name"), F.lit("").alias("county"), LA().alias("lat"), LO().alias("lon"),
        F.date_format("ts", ISO).alias("utc_valid"), F.when(k % 3 != 0, v).alias("tmpf"), none.alias("dwpf"), none.alias("relh"), none.alias("sknt"), F.when(k % 2 == 0, v).alias("gust"),
        F.when(k % 5 == 0, v).alias("phour"), none.alias("alti"), none.alias("vsby"), F.lit("m").alias("raw"))
    landed = S.read_rows(spark, L.write_list(rows, F.struct(*[c for c in rows.columns if c != "event_id"]), batch_of(rows), "data"), S.STATION_ROW, "data")
    r = S.normalize_stations(landed, mapping(spark, STATION_MAP), dim(spark, sf))
    return r.select("station", F.unix_seconds("observed_at").alias("sec"), "metric", F.round("value", 6).alias("value"), "period", "county_id")


@query("s6_normalize_air", f"""SELECT '17' || lpad(CAST(e.user_id % 40 AS VARCHAR), 3, '0') || e.user_id AS site, hour_s + 3600 AS observed_s, value, coalesce(c.county_id, n.near) AS county_id FROM (
    SELECT user_id, CASE WHEN event_id % 9 = 0 THEN -999.0 ELSE value END AS value, {SEC} - {SEC} % 3600 AS hour_s FROM events WHERE event_type = 'purchase') e
    JOIN near5 n USING (user_id) LEFT JOIN counties5 c ON c.county_id = '17' || lpad(CAST(e.user_id % 40 AS VARCHAR), 3, '0') WHERE value BETWEEN 0 AND 300""")
def s6(spark, sf):
    u = F.col("user_id")
    site = F.concat(fips(u % 40), u.cast("string"))
    e = events(spark, sf, "purchase")
    raw = e.select("event_id", F.date_format("ts", "MM/dd/yy").alias("date"), F.date_format("ts", "HH:00").alias("time"), site.alias("site"), F.lit("S").alias("name"), F.lit("-6").alias("offset"),
                   F.lit("PM2.5").alias("parameter"), F.lit("UG/M3").alias("unit"), F.when(F.col("event_id") % 9 == 0, "-999").otherwise(F.col("value").cast("string")).alias("value"), F.lit("EPA").alias("agency"))
    s = events(spark, sf).select("event_id", site.alias("site"), F.lit(" Name ").alias("name"), LA().cast("string").alias("lat"), LO().cast("string").alias("lon"))
    s = s.select("event_id", *[F.col(c) if c in s.columns else F.lit("x").alias(c) for c in S.AIR_SITE_COLUMNS])
    hours = S.read_pipe(spark, L.write_lines(raw, S.AIR_COLUMNS, batch_of(raw), "|"), S.AIR_COLUMNS)
    s = S.read_pipe(spark, L.write_lines(s, S.AIR_SITE_COLUMNS, batch_of(s), "|"), S.AIR_SITE_COLUMNS)
    m = mapping(spark, [("PM2.5", "pm25", 1.0, 0.0, "1h", 0.0, 300.0, False, 0)])
    r = S.normalize_air(hours, S.air_sites(s, "17"), m, dim(spark, sf))
    return r.select("site", F.unix_seconds("observed_at").alias("observed_s"), "value", "county_id")


@query("s7_normalize_rain_observers", f"""SELECT station, local_s + 21600 AS observed_s, metric, round(value, 6) AS value FROM (
    SELECT 'IL-' || user_id AS station, ({SEC} // 60) * 60 AS local_s, 'rain_mm' AS metric, value*25.4::DOUBLE AS value FROM events WHERE event_type = 'purchase' AND event_id % 4 <> 0
    UNION ALL SELECT 'IL-' || user_id, ({SEC} // 60) * 60, 'snow_cm', (event_id % 7)*2.54::DOUBLE FROM events WHERE event_type = 'purchase' AND event_id % 7 > 0) WHERE value BETWEEN 0 AND 5000""")
def s7(spark, sf):
    k = F.col("event_id")
    e = events(spark, sf, "purchase").select(
        "event_id", F.date_format("ts", " yyyy-MM-dd").alias("ObservationDate"), F.date_format("ts", " hh:mm a").alias("ObservationTime"), F.concat(F.lit(" il-"), F.col("user_id").cast("string")).alias("StationNumber"),
        F.lit("s").alias("StationName"), LA().cast("string").alias("Latitude"), LO().cast("string").alias("Longitude"),
        F.when(k % 8 == 0, "T").when(k % 8 == 4, "NA").otherwise(F.col("value").cast("string")).alias("TotalPrecipAmt"), (k % 7).cast("string").alias("NewSnowDepth"))
    m = mapping(spark, [("TotalPrecipAmt", "rain_mm", 25.4, 0.0, "24h", 0.0, 5000.0, False, 0), ("NewSnowDepth", "snow_cm", 2.54, 0.0, "24h", 0.0, 5000.0, False, 1)])
    landed = S.read_csv_spaced(spark, L.write_lines(e, S.RAIN_COLUMNS, batch_of(e), ",", header=True), S.RAIN_COLUMNS)
    r = S.normalize_rain_observers(landed, m, dim(spark, sf), "America/Chicago")
    return r.select("station", F.unix_seconds("observed_at").alias("observed_s"), "metric", F.round("value", 6).alias("value"))


@query("s8_normalize_gauges", f"""WITH g AS (SELECT event_id // 1000 AS batch_id, user_id AS site, {SEC} AS sec, value * 0.3048::DOUBLE AS value FROM events WHERE event_type = 'error' AND event_id % 13 <> 0 AND user_id % 6 <> 0 AND user_id % 4 <> 0 AND value * 0.3048::DOUBLE BETWEEN -10 AND 90)
    SELECT batch_id, CAST(g.site AS VARCHAR) AS site, sec, round(value, 6) AS value, CASE WHEN g.site % 2 = 0 THEN c.county_id ELSE n.near END AS county_id FROM g JOIN (SELECT batch_id, max(sec) AS newest FROM g GROUP BY 1) USING (batch_id)
    JOIN near5 n ON n.user_id = g.site JOIN counties5 c ON c.ord = g.site % 25 WHERE newest - sec <= 172800""")
def s8(spark, sf):
    k, u = F.col("event_id"), F.col("user_id")
    e = events(spark, sf, "error").withColumn("batch_id", (k / 1000).cast("long"))
    feat = F.struct(F.struct(F.array(LO(), LA()).alias("coordinates")).alias("geometry"), F.struct(
        F.concat(F.when(u % 6 == 0, "ISWS-").otherwise("USGS-"), u.cast("string")).alias("monitoring_location_id"), F.lit("00065").alias("parameter_code"), F.date_format("ts", ISO).alias("time"),
        F.when(k % 13 == 0, "-999").otherwise(F.col("value").cast("string")).alias("value")).alias("properties"))
    sites = events(spark, sf).filter(u % 4 != 0).select(u.cast("string").alias("site"), F.lit("RIVER").alias("name"), F.when(u % 2 == 0, fips(u % 25)).alias("county_code")).distinct()
    m = mapping(spark, [("00065", "stage_m", 0.3048, 0.0, None, -10.0, 90.0, False, 0)])
    r = S.normalize_gauges(parsed(e, feat, S.GAUGE_FEATURE), sites, m, dim(spark, sf))
    return r.select("batch_id", "site", F.unix_seconds("observed_at").alias("sec"), F.round("value", 6).alias("value"), "county_id")


@query("s9_normalize_soil", """WITH v AS (SELECT user_id, event_type AS code, CASE event_id % 3 WHEN 0 THEN -2 WHEN 1 THEN -8 ELSE -20 END AS depth, event_id, ts, CASE WHEN event_id % 4 <> 0 THEN value END AS value FROM events),
    d AS (SELECT user_id, code, depth, arg_max(value, event_id) AS value, max(event_id) AS e FROM v WHERE value IS NOT NULL GROUP BY 1, 2, 3)
    SELECT user_id || ':IL:SCAN' AS triplet, code, max(depth) AS depth, arg_max(value, depth) AS value, count(*) AS depths FROM d WHERE code IN ('click','view') GROUP BY 1, 2 HAVING arg_max(value, depth) BETWEEN 0 AND 300""")
def s9(spark, sf):
    k = F.col("event_id")
    depth = F.when(k % 3 == 0, -2).when(k % 3 == 1, -8).otherwise(-20)
    e = events(spark, sf).withColumn("depth", depth)
    chunk = (k / 1000).cast("long").alias("file")     # a landed file holds a bounded slice of time
    series = e.groupBy("user_id", "event_type", "depth", chunk).agg(F.sort_array(F.collect_list(F.struct("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("date"), F.when(k % 4 != 0, F.col("value")).alias("value")))).alias("vs"))
    series = series.select("user_id", "file", F.struct(F.struct(F.col("event_type").alias("elementCode"), F.col("depth").alias("heightDepth"), F.lit("pct").alias("storedUnitCode")).alias("stationElement"),
                                               F.transform("vs", lambda v: F.struct(v["date"].alias("date"), v["value"].alias("value"))).alias("values")).alias("d"))
    st = series.groupBy("user_id", "file").agg(F.collect_list("d").alias("data"))
    station = F.struct(F.concat(F.col("user_id").cast("string"), F.lit(":IL:SCAN")).alias("stationTriplet"), "data")
    stations = S.read_structs(spark, L.write_list(st, station, F.col("file")), S.SOIL_STATION, "s")
    places = A.sensors(spark, sf).select(F.concat(F.col("sensor_id").cast("string"), F.lit(":IL:SCAN")).alias("triplet"), "county_id", "lat", "lon")
    m = mapping(spark, [("click", "soil_moisture", 1.0, 0.0, None, 0.0, 300.0, False, 0), ("view", "soil_temp", 1.0, 0.0, None, 0.0, 300.0, False, 1)])
    r = S.normalize_soil(stations, places, m)
    return r.select("triplet", "code", "depth", "value", F.size("profile").cast("long").alias("depths"))


@query("s10_normalize_drought", """WITH l AS (SELECT user_id % 25 AS k, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT '17' || lpad(CAST(k AS VARCHAR), 3, '0') AS fips, CASE WHEN value * 0.2::DOUBLE >= 25 THEN 5.0 WHEN value * 0.4::DOUBLE >= 25 THEN 4.0 WHEN value * 0.6::DOUBLE >= 25 THEN 3.0 WHEN value * 0.8::DOUBLE >= 25 THEN 2.0 WHEN value >= 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM l""")
def s10(spark, sf):
    v = F.col("value")
    rows = events(spark, sf, "view").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("mapDate"), fips(F.col("user_id") % 25).alias("fips"), (v * 0).alias("none"), v.alias("d0"), (v * 0.8).alias("d1"),
                                            (v * 0.6).alias("d2"), (v * 0.4).alias("d3"), (v * 0.2).alias("d4"))
    landed = S.read_rows(spark, L.write_list(rows, F.struct(*[c for c in rows.columns if c != "event_id"]), batch_of(rows)), S.DROUGHT_ROW)
    return S.normalize_drought(landed, dim(spark, sf)).select("fips", "value")


@query("s11_normalize_quakes", f"""SELECT 'q' || event_id AS quake_id, metric, value, epoch_us(ts) // 1000 AS at_ms, n.near AS county_id FROM (SELECT event_id, user_id, ts, 'mag' AS metric, value / 50 AS value FROM events WHERE event_type = 'signup'
    UNION ALL SELECT event_id, user_id, ts, 'intensity', CASE WHEN event_id % 2 = 0 THEN (event_id % 9)::DOUBLE ELSE (event_id % 5)::DOUBLE END FROM events WHERE event_type = 'signup' AND event_id % 3 <> 0 OR (event_type = 'signup' AND event_id % 2 = 0)) JOIN near5 n USING (user_id)
    WHERE value BETWEEN 0 AND 10 AND n.km <= 40""")
def s11(spark, sf):
    k = F.col("event_id")
    e = events(spark, sf, "signup")
    feat = F.struct(F.concat(F.lit("q"), k.cast("string")).alias("id"), F.struct(F.array(LO(), LA(), F.lit(5.0)).alias("coordinates")).alias("geometry"), F.struct(
        (F.col("value") / 50).alias("mag"), F.when(k % 2 == 0, (k % 9).cast("double")).alias("cdi"), F.when(k % 3 != 0, (k % 5).cast("double")).alias("mmi"), F.unix_millis("ts").alias("time"), F.lit("p").alias("place")).alias("properties"))
    m = mapping(spark, [("mag", "mag", 1.0, 0.0, None, 0.0, 10.0, False, 0), ("cdi", "intensity", 1.0, 0.0, None, 0.0, 10.0, False, 1), ("mmi", "intensity", 1.0, 0.0, None, 0.0, 10.0, False, 2)])
    r = S.normalize_quakes(parsed(e, feat, S.QUAKE_FEATURE), m, dim(spark, sf), max_km=40.0)
    return r.select("quake_id", "metric", "value", F.unix_millis("observed_at").alias("at_ms"), "county_id")


@query("s12_normalize_grain_bids", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'soy_basis' ELSE 'corn_basis' END AS metric, round(((o_orderkey % 90) - 40) / 100.0::DOUBLE, 6) AS value,
    (epoch_us(date_trunc('day', o_orderdate)) // 1000000) + CASE WHEN CAST(o_orderdate AS DATE) >= april + CAST((7 - dayofweek(april)) % 7 AS INTEGER) AND CAST(o_orderdate AS DATE) < october - CAST(dayofweek(october) AS INTEGER)
      THEN 39600 ELSE 43200 END AS published_s, round(o_totalprice, 2) AS cash
    FROM (SELECT *, make_date(year(o_orderdate), 4, 1) AS april, make_date(year(o_orderdate), 10, 31) AS october FROM orders) WHERE o_orderkey % 3 <> 0""")
def s12(spark, sf):
    k = F.col("o_orderkey")
    o = A.table(spark, sf, "orders")
    basis = ((k % 90) - 40).cast("string")
    rows = o.select("o_orderkey", F.when(k % 4 == 0, "Soybeans").otherwise("Corn").alias("commodity"), F.concat(F.lit("District "), (k % 5).cast("string")).alias("trade_loc"), k.cast("string").alias("delivery_point"),
                    F.when(k % 2 == 0, basis).alias("basis Min"), F.when(k % 2 == 1, basis).alias("basis Max"), F.lit(None).cast("string").alias("price Max"),
                    F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("avg_price"), F.when(k % 3 != 0, "Yes").otherwise("No").alias("current"),
                    F.concat(F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(" 06:00:00")).alias("published_date"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("report_date"))
    com = spark.createDataFrame([("Corn", "corn_basis", 0.01), ("Soybeans", "soy_basis", 0.01)], "commodity string, metric string, a double")
    reg = spark.createDataFrame([(f"District {i}", f"1700{i}", 40.0, -89.0) for i in range(5)], "trade_loc string, county_id string, lat double, lon double")
    landed = S.read_rows(spark, L.write_list(rows, F.struct(*[c for c in rows.columns if c != "o_orderkey"]), batch_of(rows), "results"), S.GRAIN_ROW, "results")
    r = S.normalize_grain_bids(landed, com, reg, "America/Chicago")
    return r.select(F.col("delivery_point").cast("long").alias("id"), "metric", F.round("value", 6).alias("value"), F.unix_seconds("observed_at").alias("published_s"), F.round("cash_price", 2).alias("cash"))


@query("s13_normalize_items", "SELECT item_id, feed, topic, length(content) AS n, epoch_us(published_at) AS at_us FROM doc_rows")
def s13(spark, sf):
    d = A.documents(spark, sf)
    return d.select("item_id", "feed", "topic", F.length("content").cast("long").alias("n"), us("published_at").alias("at_us"))


@query("s14_statement_headline", """SELECT item_id, CASE WHEN item_id % 3 = 0 THEN substr('Survey of ' || item_id || ' for the storm', 1, 160) ELSE 'Public Information Statement' END AS title, least(length(t), 6000) AS n FROM (
    SELECT item_id, CASE WHEN item_id % 3 = 0 THEN chr(10) || '...Survey of ' || item_id || chr(10) || '   for the storm...' || chr(10) ELSE '' END || content AS t FROM doc_rows)""")
def s14(spark, sf):
    k = F.col("item_id")
    lead = F.when(k % 3 == 0, F.concat(F.lit("\n...Survey of "), k.cast("string"), F.lit("\n   for the storm...\n"))).otherwise("")
    p = A.documents(spark, sf).select("item_id", F.concat(lead, "content").alias("text"), F.lit(None).cast("string").alias("product_name"))
    return S.normalize_statements(p).select("item_id", "title", F.length("content").cast("long").alias("n"))


S15_OK = "NOT (bad OR unknown OR lost OR when_bad OR (metric <> 'signup' AND (value < 0 OR value > 300)))"


@query("s15_normalize_json_readings", f"""SELECT seq, item, metric, CASE WHEN {S15_OK} THEN CASE WHEN metric = 'signup' THEN 1.0 ELSE value END END::DOUBLE AS value, CASE WHEN {S15_OK} THEN least(1.0, greatest(0.0, conf)) END::DOUBLE AS confidence,
    CASE WHEN {S15_OK} THEN stated END AS stated_s, CASE WHEN {S15_OK} THEN coalesce(la, c.lat) END AS lat, CASE WHEN {S15_OK} THEN coalesce(lo, c.lon) END AS lon, CASE WHEN {S15_OK} THEN c.county_id END AS county_id,
    CASE WHEN {S15_OK} THEN tags END AS tags, CASE WHEN {S15_OK} THEN note END AS note, CASE WHEN bad THEN 'invalid JSON' WHEN unknown THEN 'unknown metric nope' WHEN metric <> 'signup' AND (value < 0 OR value > 300) THEN 'outside plausible range'
      WHEN lost THEN 'unknown location nowhere' WHEN when_bad THEN 'bad observed_at' END AS error FROM (
    SELECT seq, 0 AS item, CASE WHEN seq % 17 = 5 THEN NULL WHEN seq % 11 = 3 THEN 'nope' ELSE metric END AS metric, seq % 11 = 3 AS unknown, value, (seq % 15) / 10.0 - 0.2 AS conf, seq % 17 = 5 AS bad, seq % 10 = 7 AS lost, seq % 9 = 4 AS when_bad,
      CASE WHEN seq % 9 = 2 THEN epoch_us(observed_at) // 1000000 END AS stated, CASE WHEN seq % 10 = 1 THEN lat END AS la, CASE WHEN seq % 10 = 1 THEN lon END AS lo, CASE WHEN seq % 10 = 2 THEN county_id END AS own,
      CASE WHEN seq % 3 = 0 THEN 'a;b' ELSE '' END AS tags, 'note ' || seq AS note FROM signals
    UNION ALL SELECT seq, 1, 'click', false, 7.0, 1.0, false, false, false, NULL, NULL, NULL, NULL, '', NULL FROM signals WHERE seq % 4 = 0 AND seq % 17 <> 5) LEFT JOIN dim_county c ON c.county_id = own""")
def s15(spark, sf):
    k = F.col("seq")
    where = (F.when(k % 10 == 1, F.to_json(F.struct("lat", "lon"))).when(k % 10 == 2, F.concat(F.lit("nation "), "county_id", F.lit(" County"))).when(k % 10 == 7, "nowhere"))
    stated = F.when(k % 9 == 2, F.date_format("observed_at", ISO)).when(k % 9 == 4, "yesterday")
    one = F.struct(F.when(k % 11 == 3, "nope").otherwise(F.col("metric")).alias("metric"), F.col("value").alias("value"), F.lit("n").alias("unit"), ((k % 15) / 10.0 - 0.2).alias("confidence"),
                   where.alias("location"), stated.alias("observed_at"), F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("tags"), F.concat(F.lit("note "), k.cast("string")).alias("note"))
    two = F.struct(F.lit("click").alias("metric"), F.lit(7.0).alias("value"), F.lit("n").alias("unit"), F.lit(1.0).alias("confidence"))
    s = A.signals(spark, sf)
    payload = F.when(k % 17 == 5, F.lit("{broken")).when(k % 4 == 0, F.concat(F.lit("["), F.to_json(one), F.lit(","), F.to_json(two), F.lit("]"))).otherwise(F.to_json(one))
    fr = V.frames(spark, [PACK])
    places = A.dim_county(spark, sf).select(F.concat(F.lit("nation"), "county_id").alias("name_key"), "county_id", F.lit(None).cast("string").alias("zip5"), "lat", "lon")
    r = S.normalize_json_readings(s.select("seq", payload.alias("payload")), "seq", fr["dim_metric"], fr["dim_unit"], places)
    return r.select("seq", "item", "metric", "value", "confidence", F.unix_seconds("observed_at").alias("stated_s"), "lat", "lon", "county_id", F.array_join("tags", ";").alias("tags"), "note", "error")


MSG = """SELECT seq, 0 AS clause, 'click' AS metric, CASE WHEN value <= 300 THEN value END AS value, NULL::DOUBLE AS minutes_ago, 'nation_3' AS place, CASE WHEN value <= 300 THEN 'ok' ELSE 'range' END AS state FROM signals WHERE seq % 6 = 0
    UNION ALL SELECT seq, 0, 'purchase', CASE WHEN value <= 300 THEN value END, NULL, NULL, CASE WHEN value <= 300 THEN 'ok' ELSE 'range' END FROM signals WHERE seq % 6 = 1
    UNION ALL SELECT seq, 1, 'signup', 1.0, 20.0, NULL, 'ok' FROM signals WHERE seq % 6 = 1
    UNION ALL SELECT seq, 0, 'click', 100.0, NULL, NULL, 'ok' FROM signals WHERE seq % 6 = 2
    UNION ALL SELECT seq, 0, 'view', NULL, NULL, NULL, 'bare' FROM signals WHERE seq % 12 = 3
    UNION ALL SELECT seq, 0, 'click', 100.0, NULL, NULL, 'ok' FROM signals WHERE seq % 12 = 9 UNION ALL SELECT seq, 0, 'error', NULL, NULL, NULL, 'unknown word' FROM signals WHERE seq % 12 = 9
    UNION ALL SELECT seq, 0, 'click', CASE WHEN value * 100 <= 300 THEN value * 100 END, 120.0, NULL, CASE WHEN value * 100 <= 300 THEN 'ok' ELSE 'range' END FROM signals WHERE seq % 6 = 4
    UNION ALL SELECT seq, 0, 'error', CASE WHEN value <= 300 THEN value END, NULL, NULL, CASE WHEN value <= 300 THEN 'ok' ELSE 'range' END FROM signals WHERE seq % 6 = 5
    UNION ALL SELECT seq, 0, 'view', CASE WHEN value / 10 <= 300 THEN value / 10 END, NULL, NULL, 'ok' FROM signals WHERE seq % 6 = 5"""


@query("s16_extract_readings_from_messages", f"SELECT seq, clause, metric, round(value, 6) AS value, minutes_ago, place, state FROM ({MSG})")
def s16(spark, sf):
    k, v = F.col("seq"), F.col("value").cast("decimal(12,2)").cast("string")
    t = (F.when(k % 6 == 0, F.concat(F.lit("Clicks: "), v, F.lit("n #web @nation_3 -- a note 5n")))
         .when(k % 6 == 1, F.concat(v, F.lit("n of purchases; sign up 20 min ago")))
         .when(k % 6 == 2, F.lit("page click very many"))
         .when(k % 12 == 3, F.lit("view"))
         .when(k % 12 == 9, F.lit("Many clicks at the gate, and few errors"))
         .when(k % 6 == 4, F.concat(F.lit("page click "), v, F.lit("k 2h ago")))
         .otherwise(F.concat(F.lit("errors="), v, F.lit(" and views "), v, F.lit("d"))))
    fr = V.frames(spark, [PACK])
    vocab = {"aliases": [(a, m, sp.get("kind") == "flag") for m, sp in PACK["metrics"].items() for a in [m, *sp.get("aliases", [])]],
             "units": sorted({u for sp in PACK["metrics"].values() for u in sp.get("units", {})}), "words": ["few", "many"]}
    r = MS.extract_readings(A.signals(spark, sf).select("seq", t.alias("text")), "seq", vocab, fr["dim_metric"], fr["dim_unit"], fr["dim_word"])
    state = F.when(F.col("error").isNull(), "ok").when(F.col("error") == "give a value", "bare").when(F.col("error").startswith("outside"), "range").otherwise(F.col("error"))
    return r.select("seq", "clause", "metric", F.round("value", 6).alias("value"), "minutes_ago", "place", state.alias("state"))


def river_gauges(spark, sf):
    e = events(spark, sf, "view")
    pt = F.struct(F.date_format("ts", ISO).alias("validTime"), F.when(F.col("event_id") % 6 == 0, -999.0).otherwise(F.col("value") / 10).alias("primary"))
    g = e.groupBy("user_id", (F.col("event_id") / 1000).cast("long").alias("file")).agg(F.collect_list(pt).alias("data"))
    flow = F.transform("data", lambda p: F.struct(p["validTime"].alias("validTime"), F.when(p["primary"] > -900, p["primary"] + 1.5).otherwise(-999.0).alias("primary")))
    cats = F.struct(*[F.struct(F.when(F.col("user_id") % (i + 2) != 0, 10.0 * (i + 1) - F.col("user_id") % 3).otherwise(-9999.0).alias("stage")).alias(n) for i, n in enumerate(CATEGORIES)])
    gauge = F.struct(F.col("user_id").cast("string").alias("lid"), F.struct("data").alias("observed"), F.struct(flow.alias("data")).alias("forecast"), cats.alias("categories"))
    return S.read_structs(spark, L.write_list(g, gauge, F.col("file")), S.RIVER_GAUGE, "g").select("batch_id", "g.*")


CATEGORIES = ["action", "minor", "moderate", "major"]


@query("s18_normalize_river_gauges", f"""SELECT CAST(user_id AS VARCHAR) AS lid, {SEC} AS sec, value / 10 AS stage, k AS series FROM (SELECT *, 'observed' AS k FROM events UNION ALL SELECT event_id, ts, user_id, event_type, value + 15.0::DOUBLE, props, 'forecast' FROM events)
    WHERE event_type = 'view' AND event_id % 6 <> 0""")
def s18(spark, sf):
    g = river_gauges(spark, sf)
    both = [S.river_series(g, k).withColumn("series", F.lit(k)) for k in ("observed", "forecast")]
    return both[0].unionByName(both[1]).select("lid", F.unix_seconds("taken").alias("sec"), F.round("stage", 6).alias("stage"), "series")


@query("s18_flood_stages", """SELECT batch_id, CAST(user_id AS VARCHAR) AS lid, string_agg(n || '=' || printf('%.1f', st), ';' ORDER BY st, n) AS stages FROM (SELECT DISTINCT user_id, event_id // 1000 AS batch_id FROM events WHERE event_type = 'view'),
    (VALUES (0, 'action'), (1, 'minor'), (2, 'moderate'), (3, 'major')) c(i, n), LATERAL (SELECT (10.0 * (i + 1) - user_id % 3)::DOUBLE AS st) WHERE user_id % (i + 2) <> 0 GROUP BY 1, 2""")
def s18_stages(spark, sf):
    g = S.flood_stages(river_gauges(spark, sf), CATEGORIES)
    return g.select(F.col("batch_id").cast("long").alias("batch_id"), "lid", F.array_join(F.transform("stages", lambda x: F.concat(x["name"], F.lit("="), F.format_string("%.1f", x["stage"]))), ";").alias("stages")).filter("stages <> ''")


@query("s19_normalize_outlooks", f"""SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS "level", {SEC} AS from_s, {SEC} + 86400 AS to_s, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS n_polygons FROM events WHERE event_type = 'error' AND event_id % 3 <> 2""")
def s19(spark, sf):
    k = F.col("event_id")
    ring = "[[-90.0,38.0],[-89.0,38.0],[-89.0,39.0]]"
    word = F.when(k % 3 == 0, "Marginal Risk").when(k % 3 == 1, "Slight Risk").otherwise("None")
    geom = F.struct(F.when(k % 2 == 0, "Polygon").otherwise("MultiPolygon").alias("type"), F.when(k % 2 == 0, f"[{ring}]").otherwise(f"[[{ring}],[{ring}]]").alias("coordinates"))
    props = F.create_map(F.lit("id"), k.cast("string"), F.lit("label"), word, F.lit("valid"), F.date_format("ts", ISO), F.lit("expire"), F.date_format(F.col("ts") + F.expr("INTERVAL 24 HOURS"), ISO))
    geom = F.struct(geom["type"].alias("type"), F.from_json(geom["coordinates"], "array<variant>").alias("coordinates"))
    f = parsed(events(spark, sf, "error"), F.struct(geom.alias("geometry"), props.alias("properties")), S.OUTLOOK_FEATURE)
    lv = spark.createDataFrame([("Marginal", 1), ("Slight", 2)], "word string, level int")
    o = S.normalize_outlooks(f.withColumn("id", F.col("f.properties")["id"].cast("long")), lv, "label", "valid", "expire")
    return o.select("id", "level", F.unix_seconds("valid_from").alias("from_s"), F.unix_seconds("valid_to").alias("to_s"), F.size("polygons").alias("n_polygons"))
