"""From landed files to judged readings in one job: readers, packs, canonical table, keyed insert, arrival order, verdicts; alerts threaded over their references."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import functions as F

from gossamer.catalog.feeds import ISO, LA, LATLON, LO, SEC, SISO, SPECS, alert_features, batch_of, dim, events, parsed
from gossamer.catalog.places import zips
from gossamer.catalog.registry import TABLES, query, table_sql
from gossamer.operators import corroborate as C
from gossamer.operators import threads as TH
from gossamer.session import checkpointed, shared_path
from gossamer.sources import canonical as N
from gossamer.sources import feeds as S
from gossamer.sources import landing as L
from gossamer.sources import vocab as V

PACKS = Path(__file__).resolve().parent.parent / "packs"
us = F.unix_micros


def vocabulary(spark):
    """The packs of the repository as dimension tables; read once by the driver."""
    return V.frames(spark, V.load_packs(PACKS))


def by_feed(fr, feed):
    return S.source_mapping(fr["dim_source_map"], fr["dim_unit"], fr["dim_metric"], feed)


# ── landing: stations, storm reports, air monitors and people's posts, each from its own share of the senders ──

def land_stations(spark, sf):
    k, none = F.col("event_id"), F.lit(None).cast("double")
    e = events(spark, sf).filter("user_id % 10 = 0")
    row = F.struct(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("station"), F.lit("n").alias("name"), F.lit("").alias("county"), LA().alias("lat"), LO().alias("lon"), F.date_format("ts", ISO).alias("utc_valid"),
                   none.alias("tmpf"), F.when(k % 3 != 0, F.col("value")).alias("gust"), F.when(k % 4 == 0, F.col("value") / 100).alias("phour"), F.lit("m").alias("raw"))
    return L.write_list(e, row, batch_of(e), "data")


def land_reports(spark, sf):
    """Two fetches of the same hours: every report lies there twice. The second fetch of each seventh batch was cut off on its way."""
    k = F.col("event_id")
    e = events(spark, sf).filter("user_id % 10 in (1, 3)")
    feature = F.struct(F.struct(F.array(LO(), LA()).alias("coordinates")).alias("geometry"), F.struct(
        F.concat(F.lit("wfo"), (F.col("user_id") % 4).cast("string")).alias("wfo"), (F.col("value") / 100).alias("magf"), F.lit("nowhere").alias("county"), F.when(k % 7 == 0, "Tornado").when(k % 7 == 1, "OTHER").otherwise("Hail").alias("typetext"),
        F.date_format("ts", ISO).alias("valid"), k.cast("string").alias("product_id")).alias("properties"))
    folder = L.write_features(e, feature, batch_of(e))
    again = e.withColumn("batch_id", batch_of(e) + 1_000_000_000)
    broken = F.when(F.col("batch_id") % 7 == 3, F.lit("{cut off")).otherwise(F.to_json(feature))
    return L.write_documents(again, broken, F.col("batch_id"), '{"type": "FeatureCollection", "features": [', "]}", folder)


def land_air(spark, sf):
    e = events(spark, sf).filter("user_id % 10 = 5 and event_type = 'purchase'")
    raw = e.select("event_id", F.date_format("ts", "MM/dd/yy").alias("date"), F.date_format("ts", "HH:00").alias("time"), F.concat(F.lit("17999"), F.col("user_id").cast("string")).alias("site"), F.lit("S").alias("name"),
                   F.lit("-6").alias("offset"), F.lit("PM2.5").alias("parameter"), F.lit("UG/M3").alias("unit"), F.col("value").cast("string").alias("value"), F.lit("EPA").alias("agency"))
    sites = e.select("event_id", F.concat(F.lit("17999"), F.col("user_id").cast("string")).alias("site"), F.lit(" Name ").alias("name"), LA().cast("string").alias("lat"), LO().cast("string").alias("lon"))
    sites = sites.select("event_id", *[F.col(c) if c in sites.columns else F.lit("x").alias(c) for c in S.AIR_SITE_COLUMNS])
    return L.write_lines(raw, S.AIR_COLUMNS, batch_of(raw), "|"), L.write_lines(sites, S.AIR_SITE_COLUMNS, batch_of(sites), "|")


def land_posts(spark, sf):
    """People's posts, a line each: sender, post id, payload."""
    k, v = F.col("event_id"), F.col("value")
    metric = F.when(k % 13 == 0, "nope").when(k % 3 == 0, "hail_mm").when(k % 9 == 1, "tornado").otherwise("gust_ms")
    one = F.struct(metric.alias("metric"), F.when(metric == "hail_mm", v / 100).otherwise(v).alias("value"), F.when(metric == "hail_mm", "in").when(metric == "gust_ms", "kt").alias("unit"), F.date_format("ts", ISO).alias("observed_at"),
                   F.to_json(F.struct(LA().alias("lat"), LO().alias("lon"))).alias("location"))
    folder = shared_path(spark, "posts")
    posts = events(spark, sf).filter("user_id % 10 in (2, 4, 6, 7, 8, 9)").select("event_id", F.col("user_id").alias("sender"), F.when(F.col("user_id") % 10 == 2, "bot").otherwise("human").alias("kind"), F.when(k % 17 == 5, "{broken").otherwise(F.to_json(one)).alias("payload"))
    posts.write.json(folder)
    return folder


def feeds(spark, sf):
    """Every feed's canonical rows, read from its files."""
    fr, counties = vocabulary(spark), dim(spark, sf)
    dm = fr["dim_metric"]
    stations = S.normalize_stations(S.read_rows(spark, land_stations(spark, sf), S.STATION_ROW, "data"), by_feed(fr, "station_fields"), counties)
    reports = S.normalize_storm_reports(S.read_features(spark, land_reports(spark, sf), S.REPORT_FEATURE), by_feed(fr, "report_types"), counties, zips(spark, sf))
    hours, sites = land_air(spark, sf)
    air = S.normalize_air(S.read_pipe(spark, hours, S.AIR_COLUMNS), S.air_sites(S.read_pipe(spark, sites, S.AIR_SITE_COLUMNS), "17"), by_feed(fr, "air_parameters"), counties)
    posts = S.read_lines(spark, land_posts(spark, sf), "event_id long, sender long, kind string, payload string")
    said = S.normalize_json_readings(posts, "event_id", dm, fr["dim_unit"]).filter("error is null").join(posts.select("event_id", "sender", "kind"), "event_id")
    said = S.keyed(said.withColumns({"source": F.lit("web"), "source_id": F.concat_ws(":", "event_id", "item"), "sensor_id": F.concat(F.lit("web:"), "sender")}).drop("event_id", "item", "sender", "error"))
    alerts = S.normalize_alerts(alert_features(spark, sf), counties, SPECS).withColumn("group_key", F.col("alert_id"))
    return [N.canonical(x, dm, t) for x, t in ((stations, None), (reports, None), (air, None), (said, None), (alerts, "weather"))]


def landed(spark, sf):
    """The canonical table: one row per key, stored once and read back for what follows."""
    return checkpointed(N.numbered(checkpointed(N.ingest(feeds(spark, sf)))))


_KEY = "substr(sha1(source || '::' || source_id), 1, 16)"
_PLACE = f"{LATLON[0]} AS lat, {LATLON[1]} AS lon"
table_sql("feed_rows", f"""SELECT 'iem_asos' AS source, 'K' || user_id || '|' || {SISO} || '|gust_ms' AS source_id, 'station:k' || user_id AS sensor_id, 'station' AS kind, 'gust_ms' AS metric, value * 0.514444::DOUBLE AS value, {SEC} AS sec, {_PLACE}, NULL AS period
      FROM events WHERE user_id % 10 = 0 AND event_id % 3 <> 0
    UNION ALL SELECT 'iem_asos', 'K' || user_id || '|' || {SISO} || '|rain_mm', 'station:k' || user_id, 'station', 'rain_mm', value / 100 * 25.4::DOUBLE, {SEC}, {_PLACE}, '1h' FROM events WHERE user_id % 10 = 0 AND event_id % 4 = 0
    UNION ALL SELECT 'iem_lsr', event_id || '|' || {SISO} || '|' || printf('%.2f', {LATLON[0]}) || '|' || printf('%.2f', {LATLON[1]}) || '|' || CASE WHEN event_id % 7 = 0 THEN 'TORNADO' ELSE 'HAIL' END, 'lsr:wfo' || (user_id % 4), 'official',
      CASE WHEN event_id % 7 = 0 THEN 'tornado' ELSE 'hail_mm' END, CASE WHEN event_id % 7 = 0 THEN 1.0 ELSE value / 100 * 25.4::DOUBLE END::DOUBLE, {SEC}, {_PLACE}, NULL FROM events WHERE user_id % 10 IN (1, 3) AND event_id % 7 <> 1
    UNION ALL SELECT 'airnow', '17999' || user_id || '|PM2.5|' || strftime(make_timestamp(h * 1000000), '%Y%m%d%H'), 'airnow:17999' || user_id, 'station', 'pm25', v, h + 3600, lat, lon, '1h'
      FROM (SELECT user_id, {SEC} - {SEC} % 3600 AS h, value AS v, {_PLACE} FROM events WHERE user_id % 10 = 5 AND event_type = 'purchase')
    UNION ALL SELECT 'web', event_id || ':0', 'web:' || user_id, CASE WHEN user_id % 10 = 2 THEN 'bot' ELSE 'human' END, m, CASE m WHEN 'hail_mm' THEN value / 100 * 25.4::DOUBLE WHEN 'tornado' THEN 1.0 ELSE value * 0.514444::DOUBLE END::DOUBLE, {SEC}, {_PLACE}, NULL
      FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'hail_mm' WHEN event_id % 9 = 1 THEN 'tornado' ELSE 'gust_ms' END AS m FROM events) WHERE user_id % 10 IN (2, 4, 6, 7, 8, 9) AND event_id % 13 <> 0 AND event_id % 17 <> 5
    UNION ALL SELECT 'nws_alerts', 'urn:' || event_id || '|' || c.county_id, 'nws:office_' || (user_id % 7) || '_il', 'authority', 'alert.flash_flood_kind_' || (event_id % 3), [4.0,3.0,2.0,1.0,0.0][event_id % 5 + 1]::DOUBLE, {SEC}, c.lat, c.lon, NULL
      FROM events JOIN counties5 c ON c.ord IN (user_id % 25, (user_id + 7) % 25) WHERE event_type = 'error'""")
table_sql("pack_metric", """SELECT * FROM (VALUES ('gust_ms', 60.0::DOUBLE, 180, 6.0::DOUBLE, 0.35::DOUBLE, 0.0::DOUBLE, 120.0::DOUBLE, false, false, true), ('hail_mm', 60.0, 180, 10.0, 0.35, 0.0, 200.0, false, false, true), ('tornado', 60.0, 180, NULL, NULL, 0.0, 1.0, false, true, true),
    ('rain_mm', 60.0, 180, 10.0, 0.35, 0.0, 500.0, true, false, true), ('pm25', 60.0, 180, 40.0, 0.35, 0.0, 300.0, false, false, true)) v(metric, radius_km, window_min, tol_abs, tol_rel, lo, hi, accumulates, is_flag, scored)""")
# one row per key; of two values that one monitor gives for an hour the lesser
table_sql("landed", f"""SELECT *, row_number() OVER (ORDER BY sec, "key") - 1 AS seq, make_timestamp(sec * 1000000) AS observed_at, 'field' AS topic, 'point' AS "precision" FROM (SELECT DISTINCT ON ("key") *
    FROM (SELECT {_KEY} AS "key", * FROM feed_rows LEFT JOIN (SELECT metric, lo, hi FROM pack_metric) USING (metric) WHERE coalesce(value BETWEEN lo AND hi, true)) ORDER BY "key", value)""")


def _of(names: dict[str, str], text: str) -> str:
    for a, b in names.items():
        text = re.sub(rf"\b{a}\b(?!\.)", b, text)
    return text


_NAMES = {"signals": "landed", "dim_metric": "pack_metric", "pairs": "landed_pairs", "earlier": "landed_earlier", "closest": "landed_closest", "corro": "landed_corro"}
for _t in ("pairs", "earlier", "closest", "corro"):
    table_sql(_NAMES[_t], _of(_NAMES, TABLES[_t]))
table_sql("no_support", "SELECT NULL::BIGINT AS seq, NULL::BIGINT AS alert_id WHERE false")
table_sql("landed_arrival", _of(_NAMES | {"alert_sup": "no_support"}, TABLES["arrival"]))


@query("u1_landed_rows", 'SELECT "key", source, source_id, sensor_id, kind, metric, round(value, 6) AS value, sec, period, seq FROM landed')
def u1(spark, sf):
    return landed(spark, sf).select("key", "source", "source_id", "sensor_id", "kind", "metric", F.round("value", 6).alias("value"), F.unix_seconds("observed_at").alias("sec"), "period", "seq")


@query("u2_landed_new", """SELECT "key", seq + 1000 AS seq FROM (SELECT l."key", row_number() OVER (ORDER BY sec, "key") - 1 AS seq FROM landed l WHERE kind NOT IN ('station'))""")
def u2(spark, sf):
    """What a later run adds to a table that holds the stations' rows already."""
    all_feeds = feeds(spark, sf)
    stored = N.ingest(all_feeds[:1] + all_feeds[2:3])
    return N.numbered(checkpointed(N.ingest(all_feeds, stored)), 1000).select("key", "seq")


@query("a4_landed_quality", 'SELECT "key", a.metric, n_corr, n_contra, reference, quality FROM landed_arrival a JOIN landed USING (seq)')
def a4(spark, sf):
    r, dm = landed(spark, sf), vocabulary(spark)["dim_metric"]
    return C.arrival_quality(r, dm, C.counted_neighbors(r, dm)).join(r.select("seq", "key"), "seq").select("key", "metric", "n_corr", "n_contra", "reference", "quality")


@query("s0_unreadable", """SELECT event_id // 1000 + 1000000000 AS batch_id, true AS lost FROM events WHERE user_id % 10 IN (1, 3) GROUP BY 1 HAVING (event_id // 1000 + 1000000000) % 7 = 3""")
def s0(spark, sf):
    bad = L.unreadable(spark, land_reports(spark, sf), f"features array<{S.REPORT_FEATURE}>")
    return bad.select(F.col("batch_id").cast("long").alias("batch_id"), "lost")


@query("s17_vocabulary_tables", """SELECT metric, n, bounds, n_units, n_words, names, codes FROM (SELECT metric, count(*) AS n FROM landed GROUP BY 1) JOIN (VALUES
    ('gust_ms', '0.0..120.0', 4, 2, 'gust|gust_ms|wind gust', 'station_fields:gust=kt/'), ('hail_mm', '0.0..200.0', 2, 2, 'hail|hail size|hail_mm', 'report_types:HAIL=in/'),
    ('tornado', '..', 0, 0, 'tornado|twister', 'report_types:TORNADO=/'), ('rain_mm', '0.0..500.0', 2, 0, 'rain_mm', 'station_fields:phour=in/1h'), ('pm25', '0.0..300.0', 1, 0, 'pm25', 'air_parameters:PM2.5=ug/m3/1h')) v(metric, bounds, n_units, n_words, names, codes) USING (metric)""")
def s17(spark, sf):
    """Every table of the packs, against the readings that use it."""
    fr = vocabulary(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    many = lambda t, by, name: fr[t].groupBy("metric").agg(by.alias(name))
    used = landed(spark, sf).groupBy("metric").agg(F.count(F.lit(1)).alias("n"))
    out = fr["dim_metric"].select("metric", F.concat_ws("..", text("lo"), text("hi")).alias("bounds")).join(used, "metric")
    out = out.join(many("dim_unit", F.count(F.lit(1)), "n_units"), "metric", "left").join(many("dim_word", F.count(F.lit(1)), "n_words"), "metric", "left")
    out = out.join(many("dim_alias", F.array_join(F.sort_array(F.collect_set("alias")), "|"), "names"), "metric")
    code = F.concat(F.col("feed"), F.lit(":"), F.col("code"), F.lit("="), text("unit"), F.lit("/"), text("period"))
    out = out.join(many("dim_source_map", F.array_join(F.sort_array(F.collect_set(code)), "|"), "codes"), "metric")
    return out.select("metric", "n", "bounds", F.coalesce("n_units", F.lit(0)).cast("int").alias("n_units"), F.coalesce("n_words", F.lit(0)).cast("int").alias("n_words"), "names", "codes")


# ── alerts over their references ──

def linked_features(spark, sf):
    """Alert features that reference the sender's last message, the one before it too, or one that was never landed."""
    from gossamer.sources import adapter as A

    a, urn = A.alerts(spark, sf), lambda c: F.concat(F.lit("urn:"), c.cast("string"))
    older = a.select(F.col("alert_id").alias("ref_id"), F.col("ref_id").alias("older"))
    m = a.join(older, "ref_id", "left").withColumn("event_id", F.col("alert_id"))
    k = F.col("alert_id")
    refs = F.array_compact(F.array(F.when(k % 5 != 0, urn(F.col("ref_id"))), F.when(k % 2 == 0, urn(F.col("older"))), F.when(k % 3 == 0, urn(-k))))
    iso = F.date_format("sent", ISO)
    params = F.create_map(F.lit("maxHailSize"), F.array(F.concat(F.lit("Up to ."), (k % 90 + 10).cast("string"))), F.lit("maxWindGust"), F.array(F.concat((k % 80).cast("string"), F.lit(" MPH"))),
                          F.lit("threat"), F.array(F.when(k % 3 == 0, " radar indicated").when(k % 3 == 1, "observed").otherwise("rumour")))
    props = F.struct(urn(k).alias("id"), F.struct(F.array(F.concat(F.lit("017"), F.lpad("county_id", 3, "0"))).alias("SAME")).alias("geocode"), F.transform(refs, lambda r: F.struct(r.alias("identifier"))).alias("references"), iso.alias("sent"),
                     F.date_format("expires", ISO).alias("expires"), F.element_at(F.array(*[F.lit(s) for s in ("Minor", "Severe", "Extreme", "Moderate")]), (k % 4 + 1).cast("int")).alias("severity"),
                     F.concat(F.lit("Kind "), (k % 5).cast("string")).alias("event"), F.col("sender").alias("senderName"), params.alias("parameters"))
    return parsed(m, F.struct(props["id"].alias("id"), props.alias("properties")), S.ALERT_FEATURE)


def messages(spark, sf):
    return checkpointed(S.normalize_alerts(linked_features(spark, sf), dim(spark, sf), SPECS))


table_sql("refs", """SELECT a.alert_id, r.ref FROM alerts a LEFT JOIN (SELECT alert_id AS o, ref_id AS older FROM alerts) p ON p.o = a.ref_id,
    LATERAL (SELECT CASE WHEN a.alert_id % 5 <> 0 THEN a.ref_id END AS ref UNION ALL SELECT CASE WHEN a.alert_id % 2 = 0 THEN older END UNION ALL SELECT CASE WHEN a.alert_id % 3 = 0 THEN -a.alert_id END) r WHERE r.ref IS NOT NULL""")
table_sql("linked", """SELECT alert_id, thread_id FROM (WITH RECURSIVE up(node, root) AS (SELECT alert_id, alert_id FROM alerts UNION SELECT e.b, up.root FROM up
    JOIN (SELECT alert_id AS a, ref AS b FROM refs UNION SELECT ref, alert_id FROM refs) e ON e.a = up.node)
    SELECT node AS alert_id, arg_min(root, row(epoch_us(sent) // 1000000, 'urn:' || root)) AS thread_id FROM up JOIN (SELECT alert_id AS root, sent FROM alerts) USING (root) GROUP BY 1) JOIN (SELECT alert_id FROM alerts) USING (alert_id)""")


@query("g2_threads_of_references", "SELECT 'urn:' || alert_id AS alert_id, 'urn:' || thread_id AS thread_id FROM linked")
def g2(spark, sf):
    return TH.reference_threads(messages(spark, sf))


table_sql("tagged", """SELECT alert_id, 'maxHailSize' AS tag, NULL::INTEGER AS "level", (alert_id % 90 + 10) / 100.0::DOUBLE AS value FROM alerts UNION ALL SELECT alert_id, 'maxWindGust', NULL, (alert_id % 80)::DOUBLE FROM alerts WHERE alert_id % 80 > 0
    UNION ALL SELECT alert_id, 'threat', CASE alert_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END, NULL FROM alerts""")


@query("g4_rises_of_tags", """SELECT 'urn:' || t.alert_id AS alert_id, g.tag FROM (SELECT alert_id, lag(alert_id) OVER (PARTITION BY thread_id ORDER BY epoch_us(sent) // 1000000, 'urn:' || alert_id) AS prev FROM linked JOIN alerts USING (alert_id)) t
    JOIN tagged g ON g.alert_id = t.alert_id LEFT JOIN tagged p ON p.alert_id = t.prev AND p.tag = g.tag WHERE t.prev IS NOT NULL AND (p.alert_id IS NULL OR g."level" > p."level" OR g.value > p.value)""")
def g4(spark, sf):
    m = messages(spark, sf)
    return TH.tag_rises(m, TH.reference_threads(m)).select("alert_id", "tag")
