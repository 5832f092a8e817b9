"""Roll-ups, sorts and measures on the adapter tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gossamer.catalog.filters import NOW, ONOW, now
from gossamer.catalog.registry import query, table_sql
from gossamer.operators import measures as M
from gossamer.operators import rollups as R
from gossamer.operators.filters import hours_before
from gossamer.sources import adapter as A

us = F.unix_micros
PEOPLE = "kind IN ('human','bot')"


def onow(spark, sf):
    return A.latest(A.table(spark, sf, "orders"), "o_orderdate")


MESH = f"""SELECT county_id, metric, count(*) AS n, count(DISTINCT sensor_id) AS n_sensors, count(*) FILTER ({PEOPLE}) AS n_human,
    round(avg(value), 6) AS mean_value, max(value) AS max_value, min(value) AS min_value, epoch_us(max(observed_at)) AS latest
    FROM assessed WHERE observed_at >= {NOW} - INTERVAL 168 HOURS AND quality <> 'rejected'"""


def mesh_out(df):
    return df.withColumn("mean_value", F.round("mean_value", 6)).withColumn("latest", us("latest"))


@query("a1_mesh", MESH + " GROUP BY county_id, metric")
def a1(spark, sf):
    return mesh_out(R.mesh(A.assessed(spark, sf), now(spark, sf), 168))


@query("a1_mesh_people", MESH + f" AND {PEOPLE} GROUP BY county_id, metric")
def a1p(spark, sf):
    return mesh_out(R.mesh(A.assessed(spark, sf), now(spark, sf), 168, people_only=True))


@query("a1_mesh_stations", MESH + " AND kind = 'station' GROUP BY county_id, metric")
def a1s(spark, sf):
    return mesh_out(R.mesh(A.assessed(spark, sf), now(spark, sf), 168, stations_only=True))


@query("a2_county_activity", f"SELECT county_id, count(*) AS n FROM signals WHERE observed_at >= {NOW} - INTERVAL 240 HOURS AND {PEOPLE} GROUP BY 1")
def a2(spark, sf):
    return R.county_activity(A.signals(spark, sf), now(spark, sf), 10, ("human", "bot"))


table_sql("bursts", """SELECT *, sum(fresh) OVER (PARTITION BY metric, county_id ORDER BY observed_at, seq) AS k FROM (
    SELECT *, CASE WHEN epoch_us(observed_at) - lag(epoch_us(observed_at)) OVER (PARTITION BY metric, county_id ORDER BY observed_at, seq) <= 21600000000 THEN 0 ELSE 1 END AS fresh
    FROM crossings)""")
table_sql("event_members", """SELECT *, metric || '|' || county_id || '|' || min(epoch_us(observed_at)) OVER (PARTITION BY metric, county_id, k) AS event_id FROM bursts""")
table_sql("event_rows", f"""SELECT event_id, topic, metric, county_id, epoch_us(min(observed_at)) AS opened_us, epoch_us(max(observed_at)) AS updated_us, count(*) AS n_signals,
    CASE WHEN any_value(direction) = 'below' THEN min(value) ELSE max(value) END AS peak, max(severity) AS severity,
    CASE WHEN epoch_us({NOW}) - epoch_us(max(observed_at)) > 21600000000 THEN 'closed' ELSE 'open' END AS status FROM event_members GROUP BY ALL""")


def members(spark, sf):
    from gossamer.operators import events as E

    return E.event_members(A.signals(spark, sf), A.dim_metric(spark))


def events(spark, sf):
    from gossamer.operators import events as E

    return E.events(members(spark, sf), now(spark, sf))


WEEK = f"received_at >= {NOW} - INTERVAL 168 HOURS"
DAY = f"received_at >= {NOW} - INTERVAL 24 HOURS"


@query("a3_vitals", f"""WITH w AS (SELECT * FROM assessed WHERE {WEEK}), v AS (
    SELECT 'sensors_active_24h' AS name, count(DISTINCT sensor_id)::DOUBLE AS value FROM w WHERE {PEOPLE} AND {DAY}
    UNION ALL SELECT 'sensors_active_7d', count(DISTINCT sensor_id) FROM w WHERE {PEOPLE}
    UNION ALL SELECT 'signals_24h_human', count(*) FROM w WHERE {PEOPLE} AND {DAY}
    UNION ALL SELECT 'signals_24h_reference', count(*) FROM w WHERE NOT {PEOPLE} AND {DAY}
    UNION ALL SELECT 'corroborated_7d', count(*) FROM w WHERE {PEOPLE} AND quality = 'corroborated'
    UNION ALL SELECT 'flagged_7d', count(*) FROM w WHERE {PEOPLE} AND quality = 'flagged'
    UNION ALL SELECT 'human_7d', count(*) FROM w WHERE {PEOPLE}
    UNION ALL SELECT 'counties_covered_7d', count(DISTINCT county_id) FROM w WHERE {PEOPLE}
    UNION ALL SELECT 'counties_reference_7d', count(DISTINCT county_id) FROM w
    UNION ALL SELECT 'corroboration_rate_7d', round(count(*) FILTER (quality = 'corroborated') / count(*), 6) FROM w WHERE {PEOPLE}
    UNION ALL SELECT 'sensors_total', count(*) FROM sensors WHERE {PEOPLE}
    UNION ALL SELECT 'events_open', count(*) FROM event_rows WHERE status = 'open'
    UNION ALL SELECT 'events_24h', count(*) FROM event_rows WHERE updated_us >= epoch_us({NOW} - INTERVAL 24 HOURS)
    UNION ALL SELECT 'alerts_active', count(DISTINCT group_key) FROM alert_rows WHERE expires >= {NOW}
    UNION ALL SELECT 'subscriptions', count(*) FROM subscriptions UNION ALL SELECT 'subscribers', count(DISTINCT chat_id) FROM subscriptions
    UNION ALL SELECT 'counties_total', count(*) FROM dim_county) SELECT * FROM v""")
def a3(spark, sf):
    return R.vitals(A.assessed(spark, sf), A.sensors(spark, sf), events(spark, sf), A.alert_rows(spark, sf), A.subscriptions(spark, sf),
                    A.dim_county(spark, sf), now(spark, sf)).withColumn("value", F.round("value", 6))


LEAD = f"""SELECT s.sensor_id, count(*) AS n, count(*) FILTER (g.quality = 'corroborated') AS n_corr FROM sensors s JOIN assessed g USING (sensor_id)
    WHERE s.{PEOPLE} AND s.status = 'active' AND g.received_at >= {NOW} - INTERVAL 336 HOURS GROUP BY 1"""


@query("a13_leaderboard", LEAD + " ORDER BY n_corr DESC, n DESC, sensor_id LIMIT 10")
def a13(spark, sf):
    return R.leaderboard(A.assessed(spark, sf), A.sensors(spark, sf), now(spark, sf), 14).select("sensor_id", "n", "n_corr")


@query("j18_leaderboard_join", LEAD)
def j18(spark, sf):
    return R.leaderboard(A.assessed(spark, sf), A.sensors(spark, sf), now(spark, sf), 14, limit=2**31 - 1).select("sensor_id", "n", "n_corr")


@query("a14_activity_by_day", f"""WITH d AS (SELECT CAST({NOW} AS DATE) - CAST(i AS INTEGER) AS dd FROM range(0, 14) r(i)),
    s AS (SELECT CAST(observed_at AS DATE) AS dd, count(*) FILTER (topic = 'web' AND {PEOPLE}) AS web, count(*) FILTER (topic = 'sales' AND {PEOPLE}) AS sales,
      count(*) FILTER (topic = 'ops' AND {PEOPLE}) AS ops, count(*) FILTER (NOT {PEOPLE}) AS reference FROM signals GROUP BY 1),
    a AS (SELECT CAST(sent AS DATE) AS dd, count(DISTINCT group_key) AS alerts FROM alert_rows GROUP BY 1)
    SELECT CAST(d.dd AS VARCHAR) AS day, coalesce(web,0) AS web, coalesce(sales,0) AS sales, coalesce(ops,0) AS ops, coalesce(reference,0) AS reference,
    coalesce(alerts,0) AS alerts FROM d LEFT JOIN s USING (dd) LEFT JOIN a USING (dd)""")
def a14(spark, sf):
    out = R.activity_by_day(A.signals(spark, sf), A.alert_rows(spark, sf), ["web", "sales", "ops"], now(spark, sf), 14)
    return out.withColumn("day", F.col("day").cast("string"))


@query("a15_county_rollup", f"""WITH act AS (SELECT county_id, count(*) FILTER ({PEOPLE}) AS human, count(*) FILTER (NOT {PEOPLE}) AS reference FROM assessed
      WHERE observed_at >= {NOW} - INTERVAL 168 HOURS GROUP BY 1),
    al AS (SELECT county_id, count(*) AS alerts FROM alert_rows WHERE expires > {NOW} GROUP BY 1),
    ev AS (SELECT county_id, count(*) AS events FROM event_rows WHERE status = 'open' GROUP BY 1),
    tp AS (SELECT county_id, arg_max(metric, row(n, metric)) AS top_metric FROM (SELECT county_id, metric, count(*) AS n FROM assessed
      WHERE observed_at >= {NOW} - INTERVAL 168 HOURS AND {PEOPLE} AND quality <> 'rejected' GROUP BY 1, 2) GROUP BY 1)
    SELECT county_id, name, coalesce(human,0) AS human, coalesce(reference,0) AS reference, coalesce(alerts,0) AS alerts, coalesce(events,0) AS events, top_metric
    FROM dim_county LEFT JOIN act USING (county_id) LEFT JOIN al USING (county_id) LEFT JOIN ev USING (county_id) LEFT JOIN tp USING (county_id)""")
def a15(spark, sf):
    return R.county_rollup(A.assessed(spark, sf), A.alert_rows(spark, sf), events(spark, sf), A.dim_county(spark, sf), now(spark, sf), 7).drop("lat", "lon")


table_sql("recap", f"""SELECT group_key, arg_max(event, row(sent, alert_id)) AS event, arg_max(severity, row(sent, alert_id)) AS severity,
    arg_max(sender, row(sent, alert_id)) AS sender, max(sent) AS sent, arg_max(expires, row(sent, alert_id)) AS expires, list_sort(list(DISTINCT name)) AS counties
    FROM alert_rows JOIN dim_county USING (county_id) WHERE sent >= {NOW} - INTERVAL 168 HOURS GROUP BY 1""")


def recap(spark, sf):
    return R.alert_recap(A.alert_rows(spark, sf), A.dim_county(spark, sf), now(spark, sf), 168)


@query("a16_alert_recap", "SELECT group_key, event, severity, sender, epoch_us(sent) AS sent, array_to_string(counties, ';') AS counties FROM recap")
def a16(spark, sf):
    return recap(spark, sf).select("group_key", "event", "severity", "sender", us("sent").alias("sent"), F.array_join("counties", ";").alias("counties"))


@query("a17_alert_kinds", """SELECT event, count(*) AS n, array_to_string(list_sort(list(DISTINCT sender)), ';') AS senders, epoch_us(max(expires)) AS expires,
    array_to_string(list_sort(list_distinct(flatten(list(counties)))), ';') AS counties FROM recap GROUP BY 1""")
def a17(spark, sf):
    k = R.alert_kinds(recap(spark, sf))
    return k.select("event", "n", F.array_join("senders", ";").alias("senders"), us("expires").alias("expires"), F.array_join("counties", ";").alias("counties"))


WANTED = [(m, h) for m in ("click", "view", "purchase", "signup", "error") for h in ("max", "min")]
table_sql("station_mesh", f"""SELECT county_id, metric, count(*) AS n, max(value) AS max_value, min(value) AS min_value FROM assessed
    WHERE observed_at >= {NOW} - INTERVAL 168 HOURS AND kind = 'station' AND quality <> 'rejected' GROUP BY 1, 2""")


@query("a18_station_extremes", " UNION ALL ".join(
    f"""SELECT '{m}' AS metric, '{h}' AS how, arg_max({h}_value, row({'' if h == 'max' else '-'}{h}_value, n, county_id)) AS value,
    arg_max(county_id, row({'' if h == 'max' else '-'}{h}_value, n, county_id)) AS county_id FROM station_mesh WHERE metric = '{m}'""" for m, h in WANTED))
def a18(spark, sf):
    return R.station_extremes(R.mesh(A.assessed(spark, sf), now(spark, sf), 168, stations_only=True), WANTED).select("metric", "how", "value", "county_id")


@query("a19_subscription_counts", "SELECT category, count(DISTINCT chat_id) AS n FROM subscriptions GROUP BY 1")
def a19(spark, sf):
    return R.subscription_counts(A.subscriptions(spark, sf))


@query("a20_feed_freshness", "SELECT source, epoch_us(max(run_at)) AS last_ok FROM run_log WHERE status = 'ok' GROUP BY 1")
def a20(spark, sf):
    return R.feed_freshness(A.run_log(spark, sf)).withColumn("last_ok", us("last_ok"))


@query("a21_reference_sizes", f"SELECT 'fam' || (sensor_id % 3) AS family, count(*) AS n FROM sensors WHERE NOT {PEOPLE} GROUP BY 1")
def a21(spark, sf):
    ids = A.sensors(spark, sf).withColumn("id", F.concat(F.lit("fam"), (F.col("sensor_id") % 3).cast("string"), F.lit(":"), F.col("sensor_id").cast("string")))
    return R.reference_sizes(ids, F.substring_index("id", ":", 1))


CADENCE = [("click", 0.1), ("view", 1.0), ("signup", 0.5), ("error", 2.0), ("purchase", 50.0)]


@query("a22_feed_problems", f"""WITH d AS (SELECT source, count(*) FILTER (status = 'error') AS bad, count(*) AS n, max(error) AS err, arg_max(status, id) AS last
      FROM run_log WHERE run_at >= {NOW} - INTERVAL 24 HOURS GROUP BY 1),
    c AS (SELECT * FROM (VALUES {', '.join(f"('{a}', {b}::DOUBLE)" for a, b in CADENCE)}) v(source, stale_hours)),
    f AS (SELECT source, (epoch_us({NOW}) - epoch_us(max(run_at))) / 3600e6 AS age FROM run_log WHERE status = 'ok' GROUP BY 1)
    SELECT source, 'failing' AS problem, bad::DOUBLE AS amount, err AS detail FROM d WHERE bad >= 4 AND bad / n >= 0.3 AND (last = 'error' OR n >= 12)
    UNION ALL SELECT source, 'stale', round(age, 3), NULL FROM f JOIN c USING (source) WHERE age > stale_hours""")
def a22(spark, sf):
    return R.feed_problems(A.run_log(spark, sf), spark.createDataFrame(CADENCE, "source string, stale_hours double"), now(spark, sf), share=0.3)


@query("a23_empty_feed_streaks", """SELECT source, count(*) AS streak FROM (SELECT source, id, fetched, max(CASE WHEN fetched > 4 THEN id END) OVER (PARTITION BY source) AS lastgood FROM run_log)
    WHERE fetched <= 4 AND (lastgood IS NULL OR id > lastgood) GROUP BY 1 HAVING count(*) >= 1""")
def a23(spark, sf):
    log = A.run_log(spark, sf).withColumn("fetched", F.greatest(F.col("fetched") - 4, F.lit(0)))
    return R.empty_streaks(log, runs=1)


OSINCE = f"{ONOW} - INTERVAL 8760 HOURS"


@query("a25_messages_by_kind", f"""SELECT CASE WHEN thread LIKE 'alert:%' AND "key" LIKE '%:ask' THEN 'questions' WHEN thread LIKE 'alert:%' THEN 'alerts'
    WHEN "key" LIKE 'digest:%' THEN 'briefs' WHEN "key" LIKE 'event:%' THEN 'events' WHEN "key" LIKE 'report:%' THEN 'reports'
    WHEN "key" LIKE 'confirm:%' THEN 'notes' ELSE 'other' END AS kind, count(*) AS n FROM outbox
    WHERE status = 'sent' AND action <> 'edit' AND sent_at >= {OSINCE} GROUP BY 1""")
def a25(spark, sf):
    return R.messages_by_kind(A.outbox(spark, sf), hours_before(onow(spark, sf), 8760))


@query("x11_nearest_rank", """SELECT kind, metric, s[CAST(round_even(0.5::DOUBLE * (len(s) - 1), 0) AS BIGINT) + 1] AS p50, s[CAST(round_even(0.95::DOUBLE * (len(s) - 1), 0) AS BIGINT) + 1] AS p95
    FROM (SELECT kind, metric, list_sort(list(value)) AS s FROM signals GROUP BY 1, 2)""")
def x11(spark, sf):
    return R.nearest_rank(A.signals(spark, sf), ["kind", "metric"], "value", [0.5, 0.95])


@query("a26_latest_gauges", f"""SELECT site, arg_max(stage, row(taken, seq)) FILTER (metric = 'click') AS stage_m, arg_max(stage, row(taken, seq)) FILTER (metric = 'view') AS flow,
    epoch_us(max(taken)) AS taken FROM gauge_series WHERE taken >= {NOW} - INTERVAL 72 HOURS AND metric IN ('click','view') GROUP BY 1""")
def a26(spark, sf):
    return R.latest_gauges(A.gauge_series(spark, sf), now(spark, sf), 72, {"click": "stage_m", "view": "flow"}).withColumn("taken", us("taken"))


@query("a28_strongest_by_place", """SELECT round(lat,3) AS lat3, round(lon,3) AS lon3, metric, arg_max(seq, row(w, -seq)) AS seq, round(max(w), 6) AS weight FROM (
    SELECT *, severity + CASE WHEN kind = 'official' THEN 0.01::DOUBLE ELSE 0::DOUBLE END AS w FROM crossings) GROUP BY ALL ORDER BY weight DESC, seq LIMIT 14""")
def a28(spark, sf):
    from gossamer.operators.filters import crossings

    c = crossings(A.signals(spark, sf).join(F.broadcast(A.dim_metric(spark)), "metric"))
    return R.strongest_by_place(c).select("lat3", "lon3", "metric", "seq", F.round("weight", 6).alias("weight"))


@query("a32_night_summary", f"""SELECT county_id, metric, n, n_human, peak FROM (SELECT county_id, metric, count(*) AS n, count(*) FILTER ({PEOPLE}) AS n_human,
      CASE WHEN any_value(direction) = 'below' THEN min(value) ELSE max(value) END AS peak, any_value(direction) AS direction FROM assessed JOIN dim_metric USING (metric)
      WHERE observed_at >= {NOW} - INTERVAL 24 HOURS AND quality <> 'rejected' GROUP BY 1, 2) x
    WHERE n_human > 0 OR EXISTS (SELECT 1 FROM dim_threshold t WHERE t.metric = x.metric AND CASE WHEN direction = 'below' THEN peak <= lim ELSE peak >= lim END)""")
def a32(spark, sf):
    return R.night_summary(A.assessed(spark, sf), A.dim_metric(spark), now(spark, sf), 24)


@query("a36_outbox_counts", "SELECT status, count(*) AS n FROM outbox GROUP BY 1")
def a36(spark, sf):
    return R.outbox_counts(A.outbox(spark, sf))


@query("a37_followup_quota", f"""SELECT chat_id, count(*) AS sent, greatest(0, 5 - count(*)) AS "left" FROM outbox WHERE "key" LIKE 'confirm:%' AND created_at >= {OSINCE}
    AND status IN ('pending','sent') GROUP BY 1""")
def a37(spark, sf):
    return R.followup_quota(A.outbox(spark, sf), "confirm:", hours_before(onow(spark, sf), 8760))


@query("a38_rain_summary", f"""SELECT county_id, max(value) AS max_total, count(DISTINCT sensor_id) AS observers FROM signals WHERE metric = 'purchase' AND period = '24h'
    AND observed_at >= {NOW} - INTERVAL 168 HOURS GROUP BY 1""")
def a38(spark, sf):
    return R.rain_summary(A.signals(spark, sf), "purchase", now(spark, sf), 168)


@query("a39_vocabulary_counts", """SELECT topic, count(*) AS metrics, count(*) FILTER (is_flag) AS flags, any_value(n) AS readings FROM dim_metric
    JOIN (SELECT topic, count(*) AS n FROM signals GROUP BY 1) USING (topic) GROUP BY 1""")
def a39(spark, sf):
    used = A.signals(spark, sf).groupBy("topic").agg(F.count(F.lit(1)).alias("readings"))
    return R.vocabulary_counts(A.dim_metric(spark)).join(used, "topic")


@query("w1_latest_per_key", """SELECT sensor_id, metric, arg_max(seq, row(observed_at, seq)) AS seq, arg_max(value, row(observed_at, seq)) AS value FROM signals GROUP BY 1, 2""")
def w1(spark, sf):
    return R.latest_per_key(A.signals(spark, sf), ["sensor_id", "metric"], ["observed_at", "seq"], ["seq", "value"])


# ── sorts and top-k ──

@query("t3_sensors_ranked", """SELECT sensor_id, count(*) FILTER (quality = 'corroborated') AS n_corr, count(*) AS n FROM assessed GROUP BY 1 ORDER BY n_corr DESC, n DESC, sensor_id LIMIT 50""")
def t3(spark, sf):
    s = A.assessed(spark, sf).groupBy("sensor_id").agg(F.count_if(F.col("quality") == "corroborated").alias("n_corr"), F.count(F.lit(1)).alias("n"))
    return s.orderBy(F.desc("n_corr"), F.desc("n"), "sensor_id").limit(50)


@query("t7_sensor_latest", """SELECT sensor_id, seq, rank FROM (SELECT sensor_id, seq, row_number() OVER (PARTITION BY sensor_id ORDER BY received_at DESC, seq DESC) AS rank FROM signals) WHERE rank <= 6""")
def t7(spark, sf):
    s = A.signals(spark, sf).select("sensor_id", "seq", "received_at")
    return R.top_per_key(s, ["sensor_id"], [F.desc("received_at"), F.desc("seq")], 6, "seq").select("sensor_id", "seq", F.col("rank").cast("long").alias("rank"))


@query("t8_items_to_triage", f"""SELECT item_id FROM items WHERE relevance IS NULL ORDER BY published_at DESC, item_id DESC LIMIT 200""")
def t8(spark, sf):
    return M.items_to_triage(A.items(spark, sf), 200).select("item_id")


from gossamer.catalog.filters import TITLE  # noqa: E402


@query("t4_reading_list", f"""SELECT item_id, relevance FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY relevance DESC, published_at DESC, item_id) AS rn FROM (
    SELECT *, {TITLE} AS k FROM items WHERE relevance IS NOT NULL AND NOT regexp_matches(title, '(?i)ier'))) WHERE rn = 1
    ORDER BY relevance DESC, published_at DESC, item_id LIMIT 30""")
def t4(spark, sf):
    return M.reading_list(A.items(spark, sf).filter("relevance IS NOT NULL"), ["ier"], 30).select("item_id", "relevance")


@query("t9_county_top_readings", f"""WITH r AS (SELECT * FROM assessed WHERE observed_at >= {NOW} - INTERVAL 168 HOURS AND quality <> 'rejected'),
    b AS (SELECT county_id, arg_max(metric, row(n, metric)) AS metric FROM (SELECT county_id, metric, count(*) AS n FROM r WHERE {PEOPLE} GROUP BY 1, 2) GROUP BY 1)
    SELECT county_id, metric, seq, value, rank FROM (SELECT r.county_id, r.metric, seq, value, row_number() OVER (PARTITION BY r.county_id ORDER BY value DESC, seq) AS rank
    FROM r JOIN b ON r.county_id = b.county_id AND r.metric = b.metric WHERE kind <> 'authority') WHERE rank <= 5""")
def t9(spark, sf):
    return R.county_top_readings(A.assessed(spark, sf), now(spark, sf), 168).select("county_id", "metric", "seq", "value", F.col("rank").cast("long").alias("rank"))


@query("t10_digest_ledger", """SELECT CAST(dd AS VARCHAR) AS day, n, sent FROM (SELECT CAST(created_at AS DATE) AS dd, count(*) AS n, count(*) FILTER (status = 'sent') AS sent FROM outbox WHERE "key" LIKE 'digest:%' GROUP BY 1)
    ORDER BY dd DESC LIMIT 60""")
def t10(spark, sf):
    d = A.outbox(spark, sf).filter(F.col("key").startswith("digest:")).groupBy(F.to_date("created_at").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "sent").alias("sent"))
    return d.orderBy(F.desc("day")).limit(60)


# ── weekly measures ──

@query("j16_coverage_gaps", f"SELECT county_id, name FROM dim_county WHERE county_id NOT IN (SELECT county_id FROM signals WHERE {PEOPLE} AND observed_at >= {NOW} - INTERVAL 2 HOURS)")
def j16(spark, sf):
    return M.coverage_gaps(A.signals(spark, sf), A.dim_county(spark, sf), now(spark, sf), 2 / 24).select("county_id", "name")


@query("j19_activation", f"""SELECT s.sensor_id, epoch_us(min(g.received_at)) AS first_us, coalesce(min(g.received_at) - s.registered_at <= INTERVAL 24 HOURS, false) AS activated
    FROM (SELECT sensor_id, kind, registered_at - to_hours(sensor_id % 48) AS registered_at FROM sensors WHERE kind = 'human') s
    LEFT JOIN (SELECT sensor_id, received_at FROM signals) g USING (sensor_id)
    WHERE s.registered_at >= {NOW} - INTERVAL 760 HOURS GROUP BY s.sensor_id, s.registered_at""")
def j19(spark, sf):
    s = A.sensors(spark, sf).withColumn("registered_at", F.timestamp_micros(us("registered_at") - (F.col("sensor_id") % 48) * 3600000000))
    g = A.signals(spark, sf)
    return M.activation(s, g, hours_before(now(spark, sf), 760)).select("sensor_id", us("first_at").alias("first_us"), "activated")


QUEST = """(SELECT 'alert:' || o_orderkey AS thread, o_custkey AS chat_id, o_orderdate AS asked_at, CASE WHEN o_orderkey % 24 = 0 THEN o_orderdate END AS answered_at
    FROM orders WHERE o_orderkey % 6 = 0)"""


def questions(spark, sf):
    k = F.col("o_orderkey")
    return A.table(spark, sf, "orders").filter(k % 6 == 0).select(
        F.concat(F.lit("alert:"), k.cast("string")).alias("thread"), F.col("o_custkey").alias("chat_id"), F.col("o_orderdate").alias("asked_at"),
        F.when(k % 24 == 0, F.col("o_orderdate")).alias("answered_at"))


@query("j20_asked_delivered", f"""SELECT q.thread, q.chat_id, q.answered_at IS NOT NULL AS answered FROM {QUEST} q JOIN outbox o ON o."key" = q.thread || ':ask' AND o.chat_id = q.chat_id
    WHERE o.status = 'sent'""")
def j20(spark, sf):
    return M.asked_delivered(questions(spark, sf), A.outbox(spark, sf)).select("thread", "chat_id", F.col("answered_at").isNotNull().alias("answered"))


OTHREADS = "(SELECT CAST(o_orderkey AS VARCHAR) AS thread_id, o_orderdate - to_minutes(o_orderkey % 60) AS opened_at FROM orders WHERE o_orderkey % 6 = 0)"


def order_threads(spark, sf):
    k = F.col("o_orderkey")
    return A.table(spark, sf, "orders").filter(k % 6 == 0).select(k.cast("string").alias("thread_id"),
                                                                 F.timestamp_micros(us("o_orderdate") - (k % 60) * 60000000).alias("opened_at"))


CARDS = f"""SELECT o.id, (epoch_us(o.sent_at) - epoch_us(t.opened_at)) // 1000000 AS lag_s FROM outbox o JOIN {OTHREADS} t ON o.thread = 'alert:' || t.thread_id
    WHERE o.action = 'card' AND o.status = 'sent' AND o.created_at - t.opened_at <= INTERVAL 30 MINUTES"""


@query("j21_alert_cards", CARDS)
def j21(spark, sf):
    return M.alert_cards(A.outbox(spark, sf), order_threads(spark, sf)).select("id", F.col("lag_s").cast("long").alias("lag_s"))


# the test tables hold too few rows a week: the same measures over 760 hours
DAYS = 760 / 24
OWEEK = f"{ONOW} - INTERVAL 760 HOURS"


@query("a24_weekly_measures", f"""WITH r AS (SELECT * FROM assessed WHERE kind = 'human' AND received_at >= {NOW} - INTERVAL 760 HOURS), c AS ({CARDS} AND o.sent_at >= {OWEEK}),
    k AS (SELECT CASE WHEN thread LIKE 'alert:%' AND "key" LIKE '%:ask' THEN 'questions' WHEN thread LIKE 'alert:%' THEN 'alerts' WHEN "key" LIKE 'digest:%' THEN 'briefs'
      WHEN "key" LIKE 'event:%' THEN 'events' WHEN "key" LIKE 'report:%' THEN 'reports' WHEN "key" LIKE 'confirm:%' THEN 'notes' ELSE 'other' END AS kind, count(*) AS n
      FROM outbox WHERE status = 'sent' AND action <> 'edit' AND sent_at >= {OWEEK} GROUP BY 1),
    j AS (SELECT s.sensor_id, coalesce(min(g.received_at) - s.registered_at <= INTERVAL 24 HOURS, false) AS active FROM sensors s LEFT JOIN signals g USING (sensor_id)
      WHERE s.kind = 'human' AND s.registered_at >= {NOW} - INTERVAL 760 HOURS GROUP BY s.sensor_id, s.registered_at),
    l AS (SELECT list_sort(list(lag_s)) AS s FROM c)
    SELECT 'messages_' || kind AS name, n::DOUBLE AS value FROM k UNION ALL SELECT 'joined', count(*) FROM j UNION ALL SELECT 'activated', count(*) FROM j WHERE active
    UNION ALL SELECT 'messages_per_subscriber_week', round_even((SELECT sum(n) FROM k)::DOUBLE / count(DISTINCT chat_id) * (7.0::DOUBLE / {DAYS!r}::DOUBLE), 1) FROM subscriptions
    UNION ALL SELECT 'human_readings' AS name, count(*)::DOUBLE AS value FROM r UNION ALL SELECT 'corroborated', count(*) FROM r WHERE quality = 'corroborated'
    UNION ALL SELECT 'confirm_minutes_median', round_even(median(CAST(seq % 97 AS DOUBLE)), 1) FROM r WHERE quality = 'corroborated'
    UNION ALL SELECT 'alert_cards', count(*) FROM c
    UNION ALL SELECT 'alert_seconds_p50', s[CAST(round_even(0.5::DOUBLE * (len(s) - 1), 0) AS BIGINT) + 1] FROM l
    UNION ALL SELECT 'alert_seconds_p95', s[CAST(round_even(0.95::DOUBLE * (len(s) - 1), 0) AS BIGINT) + 1] FROM l
    UNION ALL SELECT 'asked', count(*) FROM {QUEST} q JOIN outbox o ON o."key" = q.thread || ':ask' AND o.chat_id = q.chat_id WHERE o.status = 'sent' AND q.asked_at >= {OWEEK}
    UNION ALL SELECT 'answered', count(*) FROM {QUEST} q JOIN outbox o ON o."key" = q.thread || ':ask' AND o.chat_id = q.chat_id WHERE o.status = 'sent' AND q.asked_at >= {OWEEK} AND q.answered_at IS NOT NULL
    UNION ALL SELECT 'counties_covered', count(DISTINCT county_id) FROM signals WHERE {PEOPLE} AND observed_at >= {NOW} - INTERVAL 760 HOURS
    UNION ALL SELECT 'counties_total', count(*) FROM dim_county UNION ALL SELECT 'subscribers', count(DISTINCT chat_id) FROM subscriptions""")
def a24(spark, sf):
    n = now(spark, sf)
    s = A.assessed(spark, sf).withColumn("settled_at", F.when(F.col("quality") == "corroborated", F.timestamp_micros(us("received_at") + (F.col("seq") % 97) * 60000000)))
    return M.weekly(s, A.sensors(spark, sf), A.dim_county(spark, sf), questions(spark, sf), A.outbox(spark, sf), order_threads(spark, sf), A.subscriptions(spark, sf), n, DAYS, onow(spark, sf))
