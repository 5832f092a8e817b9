"""Filters and set operations on the adapter tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gossamer.catalog.registry import query
from gossamer.operators import filters as O
from gossamer.operators import sets as S
from gossamer.sources import adapter as A

NOW = "(SELECT max(ts) FROM events)"
us = lambda c: F.unix_micros(c)


def now(spark, sf):
    return A.latest(A.table(spark, sf, "events"), "ts")


@query("f1_recent_signals", f"""SELECT seq, metric, value, quality FROM assessed WHERE observed_at >= {NOW} - INTERVAL 168 HOURS AND topic = 'web'
    AND kind IN ('human','bot') AND metric LIKE 'cl%' AND quality IN ('corroborated','raw')""")
def f1(spark, sf):
    return O.recent_signals(A.assessed(spark, sf), now(spark, sf), hours=168, topic="web", kinds=("human", "bot"), metric_prefix="cl",
                            quality=("corroborated", "raw")).select("seq", "metric", "value", "quality")


@query("f2_active_alerts", f"SELECT alert_id, county_id, severity FROM alert_rows WHERE expires > {NOW}")
def f2(spark, sf):
    return O.active_alerts(A.alert_rows(spark, sf), now(spark, sf)).select("alert_id", "county_id", "severity")


@query("f3_in_range", "SELECT seq, value FROM signals JOIN dim_metric USING (metric) WHERE value BETWEEN lo AND hi")
def f3(spark, sf):
    return O.in_range(A.signals(spark, sf).join(F.broadcast(A.dim_metric(spark)), "metric")).select("seq", "value")


@query("f4_crosses_threshold", "SELECT seq, metric, value, severity FROM crossings")
def f4(spark, sf):
    return O.crossings(A.signals(spark, sf).join(F.broadcast(A.dim_metric(spark)), "metric")).select("seq", "metric", "value", "severity")


@query("f5_raw_readings_in", f"""SELECT seq, county_id, value FROM assessed WHERE metric = 'click' AND quality = 'raw' AND kind IN ('human','bot')
    AND observed_at BETWEEN {NOW} - INTERVAL 240 HOURS AND {NOW} AND county_id IN (SELECT county_id FROM dim_county WHERE state_id IN ('1','3'))""")
def f5(spark, sf):
    n = now(spark, sf)
    c = A.dim_county(spark, sf).filter(F.col("state_id").isin("1", "3"))
    return O.raw_readings_in(A.assessed(spark, sf), "click", c, O.hours_before(n, 240), n).select("seq", "county_id", "value")


@query("f6_grid_candidates", f"""SELECT seq, metric FROM assessed WHERE metric IN ('click','purchase') AND kind IN ('human','bot') AND quality = 'raw'
    AND observed_at >= {NOW} - INTERVAL 120 HOURS AND seq % 4 <> 0""")
def f6(spark, sf):
    s = A.assessed(spark, sf).withColumn("evidence", F.when(F.col("seq") % 4 == 0, F.lit('{"grid": {"verdict": "quiet"}}')).otherwise(F.col("props")))
    return O.grid_candidates(s, ("click", "purchase"), O.hours_before(now(spark, sf), 120)).select("seq", "metric")


RULES = [("src1", "th", None), ("src2", None, "the of"), ("src3", "der|die", "ungch")]
BLOCK = ["^the ", "ier"]


@query("f9_filter_items", """SELECT item_id, feed FROM doc_rows WHERE NOT regexp_matches(title, '(?i)^the ') AND NOT regexp_matches(title, '(?i)ier')
    AND CASE feed WHEN 'src1' THEN regexp_matches(title || chr(10) || content, '(?i)th')
        WHEN 'src2' THEN NOT regexp_matches(title || chr(10) || content, '(?i)the of')
        WHEN 'src3' THEN regexp_matches(title || chr(10) || content, '(?i)der|die') AND NOT regexp_matches(title || chr(10) || content, '(?i)ungch') ELSE true END""")
def f9(spark, sf):
    rules = spark.createDataFrame(RULES, "feed string, include string, exclude string")
    return O.filter_items(A.documents(spark, sf), rules, BLOCK).select("item_id", "feed")


@query("f12_headline_min_gate", """SELECT seq, metric, value FROM signals JOIN dim_metric USING (metric)
    WHERE headline IS NOT NULL AND (headline_min IS NULL OR CASE WHEN headline = 'max' THEN value >= headline_min ELSE value <= headline_min END)""")
def f12(spark, sf):
    m = A.dim_metric(spark).select("metric", "headline", "headline_min").filter("headline is not null")
    return O.headline_min_gate(A.signals(spark, sf).join(F.broadcast(m), "metric")).select("seq", "metric", "value")


@query("f13_hourly_rate", """SELECT sensor_id, metric, coalesce(bool_or(period = '1h'), false) AS is_rate FROM signals GROUP BY ALL""")
def f13(spark, sf):
    return O.hourly_rate(A.signals(spark, sf), ["sensor_id", "metric"])


@query("f14_rate_limited", """WITH RECURSIVE m AS (SELECT seq, sensor_id, epoch_us(received_at) AS t, row_number() OVER (PARTITION BY sensor_id ORDER BY received_at, seq) AS rn FROM signals),
    f AS (SELECT sensor_id, rn, seq, t, 0::BIGINT AS n_before, [t] AS kept FROM m WHERE rn = 1
      UNION ALL SELECT sensor_id, rn, seq, t, len(k), CASE WHEN len(k) >= 2 THEN k ELSE list_append(k, t) END FROM (SELECT m.*, list_filter(f.kept, lambda x: x >= m.t - 28800000000) AS k FROM f JOIN m ON m.sensor_id = f.sensor_id AND m.rn = f.rn + 1))
    SELECT seq, n_before, n_before >= 2 AS refused FROM f""")
def f14(spark, sf):
    return O.rate_limited(A.signals(spark, sf).select("seq", "sensor_id", "received_at"), minutes=480, limit=2).select("seq", "n_before", "refused")


@query("f15_banned_senders", "SELECT seq, sensor_id FROM signals WHERE sensor_id NOT IN (SELECT sensor_id FROM sensors WHERE status = 'banned')")
def f15(spark, sf):
    return O.without_banned(A.signals(spark, sf), A.sensors(spark, sf)).select("seq", "sensor_id")


ONOW = "(SELECT max(o_orderdate) FROM orders)"


@query("f16_due_messages", f"""SELECT id, priority FROM outbox WHERE status = 'pending' AND next_attempt_at <= {ONOW} AND (stale_at IS NULL OR stale_at >= {ONOW})""")
def f16(spark, sf):
    return O.due_messages(A.outbox(spark, sf), A.latest(A.table(spark, sf, "orders"), "o_orderdate")).select("id", "priority")


@query("f17_has_point", "SELECT seq, lat, lon FROM signals WHERE sensor_id % 7 <> 0")
def f17(spark, sf):
    s = A.signals(spark, sf).withColumn("lat", F.when(F.col("sensor_id") % 7 != 0, F.col("lat")))
    return O.with_point(s).select("seq", "lat", "lon")


@query("f18_message_rows", "SELECT seq, source_id FROM signals WHERE sensor_id = 46 AND source = 'feed2' AND starts_with(source_id, '0:')")
def f18(spark, sf):
    return O.message_rows(A.signals(spark, sf), "feed2", 46, "0").select("seq", "source_id")


@query("u1_union_feeds", """SELECT source, count(*) AS n, count(period) AS n_period FROM (SELECT source, period FROM signals UNION ALL
    SELECT 'alerts', NULL FROM alert_rows) GROUP BY source""")
def u1(spark, sf):
    al = A.alert_rows(spark, sf).select(F.col("alert_id").alias("seq"), F.lit("alerts").alias("source"), "county_id", F.col("sent").alias("observed_at"))
    return S.union_feeds(A.signals(spark, sf), al).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("period").alias("n_period"))


@query("u2_insert_or_ignore", """SELECT "key", min(seq) AS seq FROM (SELECT substr(sha1(source || '::' || source_id), 1, 16) AS "key", seq FROM (
    SELECT source, seq, CAST(seq // 40 AS VARCHAR) AS source_id FROM signals)) WHERE "key" NOT IN (
    SELECT substr(sha1(source || '::' || CAST(seq // 40 AS VARCHAR)), 1, 16) FROM signals WHERE seq < 400) GROUP BY "key" """)
def u2(spark, sf):
    from gossamer.functions.scalars import signal_key

    s = A.signals(spark, sf).withColumn("source_id", (F.col("seq") / 40).cast("long").cast("string")).withColumn("key", signal_key("source", "source_id"))
    return S.insert_or_ignore(s.filter("seq >= 400"), s.filter("seq < 400"), "key", "seq").select("key", "seq")


TITLE = """trim(regexp_replace(lower(CASE WHEN regexp_matches(title, '(?s)^.{12,} - .{0,60}$') THEN regexp_extract(title, '(?s)^(.{12,}) - .{0,60}$', 1)
    ELSE title END), '[^a-z0-9]+', ' ', 'g'))"""


@query("u3_fresh_stories", f"""SELECT min(item_id) AS item_id, k FROM (SELECT item_id, {TITLE} AS k, published_at FROM doc_rows) x WHERE k <> ''
    AND item_id >= 100 AND k NOT IN (SELECT {TITLE} FROM doc_rows WHERE item_id < 100) GROUP BY k
    UNION ALL SELECT item_id, k FROM (SELECT item_id, {TITLE} AS k FROM doc_rows WHERE item_id >= 100) WHERE k = ''""")
def u3(spark, sf):
    d = A.documents(spark, sf)
    return S.fresh_stories(d.filter("item_id >= 100"), d.filter("item_id < 100"), "item_id").select("item_id", F.col("title_key").alias("k"))


@query("u5_set_difference", "SELECT county_id FROM dim_county EXCEPT SELECT county_id FROM assessed WHERE value > 250 AND kind = 'human'")
def u5(spark, sf):
    return S.set_difference(A.dim_county(spark, sf), A.assessed(spark, sf).filter("value > 250 and kind = 'human'"), ["county_id"]).select("county_id")


@query("u6_intersection", """SELECT a.group_key, len(list_intersect(a.c, b.c)) AS shared FROM (SELECT group_key, list(DISTINCT county_id) AS c FROM alert_rows GROUP BY 1) a
    CROSS JOIN (SELECT list(DISTINCT county_id) AS c FROM crossings WHERE severity >= 1) b WHERE len(list_intersect(a.c, b.c)) > 0""")
def u6(spark, sf):
    vocab = A.signals(spark, sf).join(F.broadcast(A.dim_metric(spark)), "metric")
    hot = O.crossings(vocab).filter("severity >= 1").select("county_id").distinct()
    return S.shared_keys(A.alert_rows(spark, sf), "group_key", hot, "county_id")


@query("u7_replace_message", """SELECT seq, base FROM (SELECT seq, seq // 4 AS base, CASE WHEN seq % 4 >= 2 THEN 2 ELSE 1 END AS version,
    max(CASE WHEN seq % 4 >= 2 THEN 2 ELSE 1 END) OVER (PARTITION BY seq // 4) AS newest FROM signals) WHERE version = newest""")
def u7(spark, sf):
    s = A.signals(spark, sf).select("seq", (F.col("seq") / 4).cast("long").alias("base"), F.when(F.col("seq") % 4 >= 2, 2).otherwise(1).alias("version"))
    return S.replace_message(s, "base", "version").select("seq", "base")
