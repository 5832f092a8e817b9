"""Sinks: each query writes to shared storage and reads back what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from gossamer.catalog import aggregates as AG
from gossamer.catalog import graph as GR
from gossamer.catalog.filters import NOW, ONOW, now
from gossamer.catalog.joins import PEOPLE
from gossamer.catalog.registry import SQL, query, table_sql
from gossamer.functions import scalars as X
from gossamer.operators import measures as M
from gossamer.operators import publish as PB
from gossamer.operators import rollups as R
from gossamer.operators import stories as ST
from gossamer.operators import threads as TH
from gossamer.operators.filters import hours_before
from gossamer.session import shared_path
from gossamer.sources import adapter as A

us = F.unix_micros
REFS = "('station','official','authority')"


@query("k1_write_digest_tables", f"""SELECT 'contributors' AS tab, coalesce(count(*), 0) AS n, coalesce(sum(n_), 0)::BIGINT AS total FROM (SELECT count(*) AS n_ FROM sensors s JOIN assessed g USING (sensor_id) WHERE s.kind IN {PEOPLE} AND s.status = 'active'
      AND g.received_at >= {NOW} - INTERVAL 336 HOURS GROUP BY sensor_id, trust_prior ORDER BY count(*) FILTER (quality = 'corroborated') DESC, n_ DESC, sensor_id LIMIT 10)
    UNION ALL SELECT 'official-alerts', count(*), NULL FROM recap
    UNION ALL SELECT 'reading-list', count(*), sum(relevance)::BIGINT FROM ({SQL['t4_reading_list']})
    UNION ALL SELECT 'station-extremes', count(*), round(sum(value))::BIGINT FROM ({SQL['a18_station_extremes']})
    UNION ALL SELECT 'network-vitals', count(*), round(sum(value))::BIGINT FROM ({SQL['a3_vitals']})
    UNION ALL SELECT 'events', count(*), sum(n_signals)::BIGINT FROM pub_events WHERE updated_us >= epoch_us({NOW} - INTERVAL 168 HOURS)
    UNION ALL SELECT 'county-activity', count(*), sum(n)::BIGINT FROM (SELECT count(*) AS n FROM assessed WHERE observed_at >= {NOW} - INTERVAL 168 HOURS AND quality <> 'rejected' GROUP BY county_id, metric)""")
def k1(spark, sf):
    n = now(spark, sf)
    a = A.assessed(spark, sf)
    mesh = R.mesh(a, n, 168).select(F.col("county_id").alias("county_fips"), F.col("metric").alias("metric_key"), "n", "n_human", "n_sensors", F.col("mean_value").alias("mean"), F.col("max_value").alias("max"), "latest")
    board = R.leaderboard(a, A.sensors(spark, sf), n, 14).select(X.public_handle("sensor_id").alias("name"), F.col("county_id").alias("county"), F.col("trust_prior").alias("trust"), "n", "n_corr")
    ev = public_events(spark, sf).filter(F.col("updated_at") >= hours_before(n, 168)).select(
        "opened_at", "updated_at", "topic", "metric", F.col("label").alias("metric_label"), "title", F.col("county_name").alias("county_label"), F.col("county_id").alias("county_fips"), F.col("pub_lat").alias("lat"),
        F.col("pub_lon").alias("lon"), F.col("peak").alias("peak_value"), X.nice_number("peak").alias("peak_display"), "score", "severity", "n_signals", "n_sensors", "n_reference", "verified", "status")
    extremes = R.station_extremes(R.mesh(a, n, 168, stations_only=True), AG.WANTED).select("metric", "how", "value", F.col("county_id").alias("county"))
    vitals = R.vitals(a, A.sensors(spark, sf), GR.events(spark, sf), A.alert_rows(spark, sf), A.subscriptions(spark, sf), A.dim_county(spark, sf), n).select(F.col("name").alias("metric"), "value")
    items = A.items(spark, sf).filter("relevance IS NOT NULL")
    reading = M.reading_list(items, ["ier"], 30)
    tables = {"events": ev, "official-alerts": AG.recap(spark, sf), "county-activity": mesh, "station-extremes": extremes, "contributors": board, "reading-list": reading, "network-vitals": vitals}
    path = shared_path(spark, "digest")
    PB.write_digest_tables(tables, path)
    out = None
    for t, total in (("contributors", "n"), ("official-alerts", None), ("reading-list", "relevance"), ("county-activity", "n"), ("station-extremes", "value"), ("network-vitals", "value"), ("events", "n_signals")):
        back = spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in PB.DIGEST_TABLES[t])).csv(f"{path}/{t}")
        r = back.agg(F.lit(t).alias("tab"), F.count(F.lit(1)).alias("n"), (F.round(F.sum(F.col(total).cast("double"))).cast("long") if total else F.lit(None).cast("long")).alias("total"))
        out = r if out is None else out.unionByName(r)
    return out


@query("k2_write_snapshot_json", f"""SELECT county_id, count(*) FILTER (kind IN {PEOPLE}) AS human, count(*) FILTER (kind NOT IN {PEOPLE}) AS reference FROM assessed WHERE observed_at >= {NOW} - INTERVAL 168 HOURS GROUP BY 1""")
def k2(spark, sf):
    n = now(spark, sf)
    c = A.assessed(spark, sf).filter(F.col("observed_at") >= hours_before(n, 168)).groupBy("county_id").agg(F.count_if(X.is_people()).alias("human"), F.count_if(X.is_reference()).alias("reference"))
    path = shared_path(spark, "snapshot")
    PB.write_snapshot_json({"counties": c, "gauges": R.latest_gauges(A.gauge_series(spark, sf), n, 6, {"click": "stage_m"})}, path)
    return spark.read.schema("county_id string, human long, reference long").json(f"{path}/counties")


table_sql("pub_events", f"""SELECT e.*, s.witnesses, s.n_reference, s.n_sensors, s.n_reference_sensors, s.verified, s.score, c.name AS county_name, round_even(c.lat, 4) AS pub_lat, round_even(c.lon, 4) AS pub_lon
    FROM event_rows e JOIN scored s USING (event_id) JOIN dim_county c USING (county_id)""")


def public_events(spark, sf):
    sc = GR.scored(spark, sf).select("event_id", "witnesses", "n_reference", "n_sensors", "n_reference_sensors", "verified", "score")
    c = A.dim_county(spark, sf).select("county_id", F.col("name").alias("county_name"), F.bround("lat", 4).alias("pub_lat"), F.bround("lon", 4).alias("pub_lon"))
    m = A.dim_metric(spark).select("metric", "label", "radius_km")
    e = GR.events(spark, sf).drop("lat", "lon").join(sc, "event_id").join(c, "county_id").join(F.broadcast(m), "metric")
    return e.withColumn("title", F.concat("label", F.lit(" "), X.nice_number("peak"), F.lit(" — "), "county_name")).withColumn("category", F.lit("Other"))


@query("k3_write_events_geojson", f"""SELECT event_id, pub_lon AS lon, pub_lat AS lat, round(peak, 6) AS peak, status, witnesses AS sensors, round(score, 3) AS score FROM pub_events WHERE verified AND updated_us >= epoch_us({NOW} - INTERVAL 168 HOURS)""")
def k3(spark, sf):
    path = shared_path(spark, "events-geojson")
    PB.events_geojson(public_events(spark, sf), now(spark, sf)).select("feature").write.text(path)
    schema = "id string, geometry struct<coordinates: array<double>>, properties struct<peak: double, status: string, sensors: long, score: double>"
    b = spark.read.schema(schema).json(path)
    return b.select(F.col("id").alias("event_id"), F.get("geometry.coordinates", F.lit(0)).alias("lon"), F.get("geometry.coordinates", F.lit(1)).alias("lat"), F.round("properties.peak", 6).alias("peak"),
                    "properties.status", "properties.sensors", F.round("properties.score", 3).alias("score"))


@query("k4_write_storms_geojson", """SELECT story_id, round_even(avg(c.lon), 4) AS lon, round_even(avg(c.lat), 4) AS lat, count(*) AS n_members FROM storm_roots r JOIN (SELECT 'event:' || event_id AS ref, county_id FROM event_rows UNION ALL SELECT 'alert:' || alert_id, county_id FROM alert_rows) w USING (ref) JOIN dim_county c USING (county_id) GROUP BY 1""")
def k4(spark, sf):
    lab = ST.stories_components(GR.storm_members(spark, sf))
    c = A.dim_county(spark, sf).select("county_id", F.col("lat").alias("pub_lat"), F.col("lon").alias("pub_lon"))
    where = GR.events(spark, sf).select(F.concat(F.lit("event:"), "event_id").alias("ref"), "county_id").unionByName(
        A.alert_rows(spark, sf).select(F.concat(F.lit("alert:"), F.col("alert_id").cast("string")).alias("ref"), "county_id")).join(c, "county_id")
    m = lab.select("ref", "story_id").join(where, "ref")
    path = shared_path(spark, "storms-geojson")
    PB.storms_geojson(m, ST.story_rows(lab)).select("feature").write.text(path)
    b = spark.read.schema("id string, geometry struct<coordinates: array<double>>, properties struct<n_members: long>").json(path)
    return b.select(F.col("id").alias("story_id"), F.get("geometry.coordinates", F.lit(0)).alias("lon"), F.get("geometry.coordinates", F.lit(1)).alias("lat"), "properties.n_members")


@query("k5_write_cap_rows", """SELECT event_id, CASE WHEN severity >= 0.8 THEN 'Severe' WHEN severity >= 0.5 THEN 'Moderate' ELSE 'Minor' END AS severity, CASE WHEN status = 'closed' THEN 'Past' ELSE 'Unknown' END AS urgency,
    strftime(make_timestamp(updated_us) + INTERVAL 6 HOURS, '%Y-%m-%dT%H:%M:%S') || '-00:00' AS expires, county_name AS area, 6 AS parameters FROM pub_events WHERE verified""")
def k5(spark, sf):
    path = shared_path(spark, "cap")
    PB.cap_rows(public_events(spark, sf), "net@example.org", "Sensor network").write.parquet(path)
    ddl = "identifier string, info struct<severity: string, urgency: string, expires: string, parameter: array<struct<valueName: string, value: string>>, area: struct<areaDesc: string>>"
    b = spark.read.parquet(path).select("event_id", F.from_xml("cap", ddl, {"inferSchema": "false"}).alias("x"))
    return b.select("event_id", "x.info.severity", "x.info.urgency", "x.info.expires", F.col("x.info.area.areaDesc").alias("area"), F.size("x.info.parameter").alias("parameters"))


@query("k6_write_research_tables", f"""SELECT seq, topic, CASE WHEN kind IN {REFS} THEN CAST(sensor_id AS VARCHAR) ELSE 's-' || substr(sha1(CAST(sensor_id AS VARCHAR)), 1, 5) END AS sensor,
    CASE WHEN kind IN {REFS} THEN lat END AS lat, CASE WHEN kind IN {REFS} THEN lon END AS lon, quality FROM assessed WHERE (kind IN {PEOPLE} OR kind = 'official') AND observed_at >= {NOW} - INTERVAL 2160 HOURS""")
def k6(spark, sf):
    path = shared_path(spark, "research")
    PB.write_research_tables({"readings": PB.research_readings(A.assessed(spark, sf), now(spark, sf)), "sensors": PB.research_sensors(A.sensors(spark, sf)),
                              "counties": A.dim_county(spark, sf), "metrics": A.dim_metric(spark)}, path)
    return spark.read.parquet(f"{path}/readings").select("seq", "topic", "sensor", "lat", "lon", "quality")


_HANDLE = f"CASE WHEN kind IN {REFS} THEN CAST(sensor_id AS VARCHAR) ELSE 's-' || substr(sha1(CAST(sensor_id AS VARCHAR)), 1, 5) END"
_SHARED = f"(kind IN {PEOPLE} OR kind = 'official')"


@query("k6_research_events", f"""SELECT event_id, topic, metric, county_id, pub_lat AS lat, pub_lon AS lon, opened_us, updated_us, CASE WHEN status = 'closed' THEN updated_us END AS closed_us, round(peak, 6) AS peak_value, n_signals, n_sensors, n_reference,
    severity, round(score, 3) AS score, status FROM pub_events WHERE updated_us >= epoch_us({NOW} - INTERVAL 2160 HOURS)""")
def k6_events(spark, sf):
    path = shared_path(spark, "research")
    PB.write_research_tables({"events": PB.research_events(public_events(spark, sf), now(spark, sf))}, path)
    b = spark.read.parquet(f"{path}/events")
    return b.select("event_id", "topic", "metric", "county_id", "lat", "lon", us("opened_at").alias("opened_us"), us("updated_at").alias("updated_us"), us("closed_at").alias("closed_us"),
                    F.round("peak_value", 6).alias("peak_value"), "n_signals", "n_sensors", "n_reference", "severity", F.round("score", 3).alias("score"), "status")


@query("k6_research_alerts", f"""SELECT thread_id, severity, array_to_string(counties, ';') AS counties, epoch_us(opened_at) AS opened_us, CASE WHEN expires <= {NOW} THEN epoch_us(expires) END AS ended_us,
    CASE WHEN expires <= {NOW} THEN 'expired' END AS ended_reason, CASE WHEN expires <= {NOW} THEN 'ended' ELSE 'active' END AS status FROM thread_tab WHERE opened_at >= {NOW} - INTERVAL 2160 HOURS""")
def k6_alerts(spark, sf):
    path, n = shared_path(spark, "research"), now(spark, sf)
    PB.write_research_tables({"alerts": PB.research_alerts(TH.thread_rows(*GR.threads(spark, sf), n), n)}, path)
    b = spark.read.parquet(f"{path}/alerts")
    return b.select("thread_id", "severity", F.array_join("counties", ";").alias("counties"), us("opened_at").alias("opened_us"), us("ended_at").alias("ended_us"), "ended_reason", "status")


@query("k6_research_sensors", f"""SELECT {_HANDLE} AS sensor, kind, county_id, coalesce(n, 0) AS n_signals, coalesce(c, 0) AS n_corroborated, coalesce(f, 0) AS n_contradicted, round(trust_prior, 3) AS trust FROM sensors
    LEFT JOIN (SELECT sensor_id, count(*) AS n, count(*) FILTER (quality = 'corroborated') AS c, count(*) FILTER (quality = 'flagged') AS f FROM assessed GROUP BY 1) USING (sensor_id) WHERE status = 'active' AND {_SHARED}""")
def k6_sensors(spark, sf):
    path = shared_path(spark, "research")
    PB.write_research_tables({"sensors": PB.research_sensors(A.sensors(spark, sf), A.assessed(spark, sf))}, path)
    return spark.read.parquet(f"{path}/sensors")


@query("k6_research_reading_events", f"""SELECT seq, event_id FROM assessed LEFT JOIN (SELECT seq, event_id FROM event_members) USING (seq) WHERE {_SHARED} AND observed_at >= {NOW} - INTERVAL 2160 HOURS""")
def k6_reading_events(spark, sf):
    path, a = shared_path(spark, "research"), A.assessed(spark, sf)
    PB.write_research_tables({"readings": PB.with_events(PB.research_readings(a, now(spark, sf)), AG.members(spark, sf))}, path)
    return spark.read.parquet(f"{path}/readings").select("seq", "event_id")


@query("k7_append_run_log", "SELECT 'feed' AS source, count(*) AS fetched, count(*) FILTER (seq % 3 = 0) AS n_new, 'ok' AS status FROM signals")
def k7(spark, sf):
    path, log = shared_path(spark, "landed"), shared_path(spark, "runlog")
    rows = A.signals(spark, sf).withColumn("is_new", F.col("seq") % 3 == 0)
    PB.append_run_log(rows, lambda df: df.write.parquet(path), "feed", log)
    return spark.read.parquet(log).select("source", "fetched", F.col("new").alias("n_new"), "status")


@query("k8_upsert_dimension", """SELECT sensor_id, CASE WHEN sensor_id % 3 = 0 THEN 'moved' ELSE kind END AS kind, CASE WHEN sensor_id % 4 = 1 THEN 0 ELSE sensor_id * 2 END AS n_signals FROM sensors WHERE sensor_id % 4 <> 1 OR sensor_id % 3 = 0""")
def k8(spark, sf):
    s = A.sensors(spark, sf).select("sensor_id", "kind", "registered_at")
    cur = s.filter("sensor_id % 4 <> 1").withColumn("n_signals", F.col("sensor_id") * 2)
    inc = s.filter("sensor_id % 3 = 0").withColumn("kind", F.lit("moved"))
    return PB.upsert_dimension(cur, inc, "sensor_id", ["n_signals"], "registered_at").select("sensor_id", "kind", "n_signals")


def summed(tables, keys):
    """(tab, n, ids): rows and sum of ids of each table read back."""
    out = None
    for name, df in tables.items():
        r = df.agg(F.lit(name).alias("tab"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(keys[name]).cast("long")), F.lit(0)).alias("ids"))
        out = r if out is None else out.unionByName(r)
    return out


@query("k9_prune", f"""SELECT 'signals' AS tab, count(*) AS n, sum(seq)::BIGINT AS ids FROM signals WHERE NOT (kind IN {REFS} AND observed_at < {NOW} - INTERVAL 240 HOURS AND seq NOT IN (SELECT seq FROM event_members))
    UNION ALL SELECT 'outbox', count(*), sum(id)::BIGINT FROM outbox WHERE status = 'pending' OR created_at >= {ONOW} - INTERVAL 8760 HOURS
    UNION ALL SELECT 'run_log', count(*), sum(id)::BIGINT FROM run_log WHERE run_at >= {NOW} - INTERVAL 120 HOURS
    UNION ALL SELECT 'threads', count(*), coalesce(sum(thread_id), 0)::BIGINT FROM thread_tab WHERE expires >= {NOW} - INTERVAL 240 HOURS""")
def k9(spark, sf):
    n = now(spark, sf)
    al, th = GR.threads(spark, sf)
    kept = {"signals": PB.prune_signals(A.signals(spark, sf), AG.members(spark, sf), n, 10), "outbox": PB.prune_outbox(A.outbox(spark, sf), AG.onow(spark, sf), 365),
            "run_log": PB.prune_run_log(A.run_log(spark, sf), n, 5), "threads": PB.prune_threads(TH.thread_rows(al, th, n), n, 10)}
    return summed(PB.rewritten(kept, shared_path(spark, "pruned")), {"signals": "seq", "outbox": "id", "run_log": "id", "threads": "thread_id"})


@query("k10_forget_sensor", """WITH gone AS (SELECT sensor_id, chat_id FROM sensors WHERE sensor_id % 31 = 7)
    SELECT 'signals' AS tab, count(*) AS n, sum(seq)::BIGINT AS ids FROM signals WHERE sensor_id % 31 <> 7 UNION ALL SELECT 'sensors', count(*), sum(sensor_id)::BIGINT FROM sensors WHERE sensor_id % 31 <> 7
    UNION ALL SELECT 'subscriptions', count(*), sum(chat_id)::BIGINT FROM subscriptions WHERE chat_id NOT IN (SELECT chat_id FROM gone)
    UNION ALL SELECT 'outbox', count(*), sum(id)::BIGINT FROM outbox WHERE chat_id NOT IN (SELECT chat_id FROM gone)
    UNION ALL SELECT 'pairs', count(*), sum(a)::BIGINT FROM (SELECT DISTINCT user_id AS a, (user_id * 7) % 97 AS b FROM events) WHERE a NOT IN (SELECT sensor_id FROM gone) AND b NOT IN (SELECT sensor_id FROM gone)""")
def k10(spark, sf):
    s = A.sensors(spark, sf)
    gone = s.filter("sensor_id % 31 = 7").select("sensor_id", "chat_id")
    pairs = A.table(spark, sf, "events").select(F.col("user_id").alias("a"), ((F.col("user_id") * 7) % 97).alias("b")).distinct()
    t = PB.forget_sensor({"signals": (A.signals(spark, sf), "sensor_id"), "sensors": (s, "sensor_id"), "subscriptions": (A.subscriptions(spark, sf), "chat_id"), "outbox": (A.outbox(spark, sf), "chat_id"), "pairs": (pairs, "a|b")}, gone)
    return summed(PB.rewritten(t, shared_path(spark, "forgotten")), {"signals": "seq", "sensors": "sensor_id", "subscriptions": "chat_id", "outbox": "id", "pairs": "a"})
