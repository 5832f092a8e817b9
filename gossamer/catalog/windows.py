"""Series, trends, headlines and forecast periods on the adapter tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gossamer.catalog.filters import NOW, now
from gossamer.catalog.registry import query, table_sql
from gossamer.operators import ahead as H
from gossamer.operators import filters as O
from gossamer.operators.filters import hours_before
from gossamer.sources import adapter as A

us = F.unix_micros


def series(spark, sf, hours=None):
    g = A.gauge_series(spark, sf)
    return g if hours is None else g.filter(F.col("taken") >= hours_before(now(spark, sf), hours))


table_sql("rise_rows", f"""SELECT site, metric, lastv - low AS rise FROM (SELECT site, metric, count(*) AS n, arg_max(stage, row(taken, seq)) AS lastv, min(stage) AS low, max(stage - prev) AS step FROM (
    SELECT *, lag(stage) OVER (PARTITION BY site, metric ORDER BY taken, seq) AS prev FROM gauge_series WHERE taken >= {NOW} - INTERVAL 240 HOURS) GROUP BY 1, 2)
    WHERE n >= 3 AND lastv - low > 0.5 AND step <= 0.5 * (lastv - low)""")


def rise_rows(spark, sf):
    return H.rises(series(spark, sf, 240), ["site", "metric"], 0.5)


@query("w2_rise", "SELECT site, metric, round(rise, 6) AS rise FROM rise_rows")
def w2(spark, sf):
    return rise_rows(spark, sf).withColumn("rise", F.round("rise", 6))


@query("w3_rank_rises", """SELECT metric, site, rk AS rank, [0.35, 0.25, 0.2][rk]::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY rise DESC, site) AS rk FROM rise_rows) WHERE rk <= 3""")
def w3(spark, sf):
    return H.rank_rises(rise_rows(spark, sf)).select("metric", "site", F.col("rank").cast("long").alias("rank"), "weight")


@query("w4_statewide_headline", f"""WITH r AS (SELECT s.*, m.headline AS stat, m.accumulates FROM assessed s JOIN dim_metric m USING (metric) WHERE headline IS NOT NULL AND quality <> 'rejected' AND observed_at >= {NOW} - INTERVAL 240 HOURS),
    p AS (SELECT metric, stat, sensor_id AS place, CASE WHEN stat = 'max' THEN max(value) ELSE min(value) END AS value FROM r GROUP BY metric, stat, sensor_id HAVING NOT (bool_or(accumulates) AND bool_or(coalesce(period = '1h', false))))
    SELECT metric, stat, arg_max(place, row(CASE WHEN stat = 'max' THEN value ELSE -value END, -place)) AS place, arg_max(value, row(CASE WHEN stat = 'max' THEN value ELSE -value END, -place)) AS value, count(*) AS field
    FROM p GROUP BY 1, 2 HAVING count(*) >= 3""")
def w4(spark, sf):
    return headlines(spark, sf)


def headlines(spark, sf):
    m = A.dim_metric(spark).select("metric", F.col("headline").alias("stat"), "accumulates").filter("stat is not null")
    r = A.assessed(spark, sf).filter((F.col("quality") != "rejected") & (F.col("observed_at") >= hours_before(now(spark, sf), 240))).join(F.broadcast(m), "metric")
    p = r.groupBy("metric", "stat", F.col("sensor_id").alias("place"), "accumulates").agg(
        F.max("value").alias("hi_v"), F.min("value").alias("lo_v"), F.coalesce(F.max(O.period_hours("period") < 6), F.lit(False)).alias("is_rate"))
    p = p.filter(~(F.col("accumulates") & F.col("is_rate"))).withColumn("value", F.when(F.col("stat") == "max", F.col("hi_v")).otherwise(F.col("lo_v")))
    return H.statewide_headline(p.select("metric", "stat", "place", "value"))


@query("w5_trend", """WITH l AS (SELECT site, metric, max(taken) AS t, arg_max(stage, row(taken, seq)) AS lastv FROM gauge_series GROUP BY 1, 2),
    e AS (SELECT l.site, l.metric, lastv, arg_max(g.stage, row(g.taken, g.seq)) AS earlier FROM l JOIN gauge_series g ON g.site = l.site AND g.metric = l.metric AND g.taken <= l.t - INTERVAL 6 HOURS GROUP BY ALL)
    SELECT site, metric, CASE WHEN lastv - earlier >= 0.1 THEN 'rising' WHEN lastv - earlier <= -0.1 THEN 'falling' ELSE 'steady' END AS trend FROM e""")
def w5(spark, sf):
    return H.trend(series(spark, sf), ["site", "metric"])


table_sql("med3", """SELECT site, metric, list_sort(list(stage))[CAST(count(*) // 2 + 1 AS BIGINT)] AS stage_now, max(taken) AS taken FROM (
    SELECT *, row_number() OVER (PARTITION BY site, metric ORDER BY taken DESC, seq DESC) AS rn FROM gauge_series) WHERE rn <= 3 GROUP BY 1, 2""")


@query("w6_median_of_last_three", "SELECT site, metric, stage_now, epoch_us(taken) AS taken FROM med3")
def w6(spark, sf):
    return H.median_of_last_three(series(spark, sf), ["site", "metric"]).withColumn("taken", us("taken"))


@query("w8_sparkline", """WITH s AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY taken, seq) - 1 AS k, count(*) OVER (PARTITION BY site) AS n, max(taken) OVER (PARTITION BY site) AS lt FROM gauge_series)
    SELECT site, k, CAST(round_even((epoch_us(taken) - epoch_us(lt)) / 60e6, 0) AS BIGINT) AS minutes, stage FROM s WHERE n >= 6 AND (n <= 48 OR k IN (SELECT CAST(round_even(i * (n - 1) / 47.0::DOUBLE, 0) AS BIGINT) FROM range(0, 48) r(i)))""")
def w8(spark, sf):
    return H.sparkline(series(spark, sf), ["site"])


@query("w12_next_periods", f"""WITH p AS (SELECT seq, sensor_id AS place, observed_at AS start_at, seq % 2 = 0 AS daytime FROM signals WHERE observed_at + INTERVAL 12 HOURS > {NOW} - INTERVAL 240 HOURS)
    SELECT place, seq, rk AS rank FROM (SELECT p.place, p.seq, row_number() OVER (PARTITION BY p.place ORDER BY p.start_at, p.seq) AS rk FROM p JOIN (
    SELECT place, min(start_at) AS f FROM p WHERE daytime GROUP BY 1) d ON d.place = p.place AND p.start_at >= d.f) WHERE rk <= 2""")
def w12(spark, sf):
    s = A.signals(spark, sf)
    p = s.select("seq", F.col("sensor_id").alias("place"), F.col("observed_at").alias("start_at"), (F.col("observed_at") + F.expr("INTERVAL 12 HOURS")).alias("end_at"),
                 (F.col("seq") % 2 == 0).alias("daytime"))
    return H.next_periods(p, "place", hours_before(now(spark, sf), 240), 2).select("place", "seq", F.col("rank").cast("long").alias("rank"))


@query("x25_flood_category", """SELECT seq, CASE WHEN stage >= 20 THEN 'major' WHEN stage >= 12 THEN 'moderate' WHEN stage >= 6 + site % 3 THEN 'minor' WHEN stage >= 4 THEN 'action' END AS category FROM gauge_series""")
def x25(spark, sf):
    from gossamer.functions.scalars import flood_category

    stages = F.array(*[F.struct(v.cast("double").alias("stage"), F.lit(n).alias("name")) for n, v in
                       (("action", F.lit(4)), ("minor", 6 + F.col("site") % 3), ("moderate", F.lit(12)), ("major", F.lit(20)))])
    return series(spark, sf).select("seq", flood_category("stage", stages).alias("category"))


@query("x26_crest_falls_to", f"""WITH s AS (SELECT site, arg_max(stage, row(taken, seq)) AS stage_now FROM gauge_series WHERE taken <= {NOW} - INTERVAL 120 HOURS GROUP BY 1),
    f AS (SELECT site, max(stage) AS top, arg_max(stage, row(taken, seq)) AS endv FROM gauge_series WHERE taken > {NOW} - INTERVAL 120 HOURS AND taken <= {NOW} GROUP BY 1)
    SELECT site, CASE WHEN top > stage_now + 0.05::DOUBLE THEN top END AS crest, CASE WHEN NOT top > stage_now + 0.05::DOUBLE AND endv < stage_now - 0.1::DOUBLE THEN endv END AS falls_to FROM f JOIN s USING (site)""")
def x26(spark, sf):
    n = hours_before(now(spark, sf), 120)
    g = series(spark, sf)
    st = g.filter(F.col("taken") <= n).groupBy("site").agg(F.max_by("stage", F.struct("taken", "seq")).alias("stage_now"))
    return H.crest_or_fall(g, st, n).select("site", "crest", "falls_to")


@query("j30_flood_to_place", """SELECT g.site, CASE WHEN g.stage_now >= 12 THEN 0.75 WHEN g.stage_now >= 6 THEN 0.55 WHEN g.stage_now >= 4 THEN 0.3 END::DOUBLE AS weight, s.county_id FROM med3 g JOIN sensors s ON s.sensor_id = g.site
    WHERE g.metric = 'click' AND g.stage_now >= 4""")
def j30(spark, sf):
    return floods(spark, sf)


def floods(spark, sf):
    from gossamer.operators.notable import flood_reasons

    lv = H.median_of_last_three(series(spark, sf).filter("metric = 'click'"), ["site"])
    level = F.when(F.col("stage_now") >= 12, 3).when(F.col("stage_now") >= 6, 2).when(F.col("stage_now") >= 4, 1).otherwise(0)
    return flood_reasons(lv.withColumn("level", level), A.sensors(spark, sf)).select("site", "weight", "county_id")


FORECAST = ["Sunny", "chance Showers  And Thunderstorms", "partly cloudy", "heavy SNOW"]
WIND = ["5 to 10 mph", "10 to 25 mph", "15 mph", ""]
FC_SQL = f"""(SELECT seq, {FORECAST!r}[seq % 4 + 1] AS short, {WIND!r}[(seq // 4) % 4 + 1] AS wind, seq % 90 AS pop, CAST(floor(value) AS BIGINT) AS temp, seq % 2 = 0 AS daytime FROM signals)"""


def forecasts(spark, sf):
    from gossamer.sources.feeds import forecast_periods

    s, k = A.signals(spark, sf), F.col("seq")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % len(xs) + 1).cast("int"))
    raw = s.select("seq", F.struct(pick(FORECAST, k).alias("shortForecast"), pick(WIND, (k / 4).cast("long")).alias("windSpeed"), F.lit("SW").alias("windDirection"),
                                   F.struct((k % 90).alias("value")).alias("probabilityOfPrecipitation"), F.floor("value").cast("long").alias("temperature"), F.lit("F").alias("temperatureUnit"),
                                   (k % 2 == 0).alias("isDaytime"), F.lit("P").alias("name"), F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("startTime"),
                                   F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("endTime")).alias("p"))
    return forecast_periods(raw.select("seq", F.array("p").alias("periods")), "seq")


SENT = "upper(substr(t, 1, 1)) || lower(substr(t, 2))"
FC_ROWS = f"""SELECT seq, pop, temp, daytime, {SENT} AS short, CASE WHEN wind = '' THEN 'SW' ELSE 'SW ' || replace(wind, ' to ', '–') END AS wind FROM (SELECT *, trim(regexp_replace(short, '\\s+', ' ', 'g')) AS t FROM {FC_SQL})"""


@query("s20_normalize_forecast_periods", FC_ROWS)
def s20(spark, sf):
    return forecasts(spark, sf).select("seq", "pop", "temp", "daytime", "short", "wind")


@query("x34_forecast_text", f"""SELECT seq, short || CASE WHEN pop >= 20 THEN ' (' || pop || '%)' ELSE '' END || ', ' || CASE WHEN daytime THEN 'high ' ELSE 'low ' END || temp || '°F'
    || CASE WHEN wind LIKE '%25 mph' OR wind LIKE '%15 mph' THEN ', wind ' || wind ELSE '' END AS txt,
    CASE WHEN lower(short) LIKE '%thunder%' THEN 'T' WHEN lower(short) LIKE '%snow%' THEN 'S' WHEN lower(short) LIKE '%cloud%' THEN 'C' WHEN daytime THEN '☀️' ELSE '🌙' END AS icon FROM ({FC_ROWS})""")
def x34(spark, sf):
    f = forecasts(spark, sf)
    return f.select("seq", H.forecast_text(F.col("short"), F.col("pop"), F.col("temp"), F.col("unit"), F.col("daytime"), F.col("wind")).alias("txt"),
                    H.icon(F.col("short"), F.col("daytime"), [("thunder", "T"), ("snow", "S"), ("cloud", "C")]).alias("icon"))


@query("x35_target_instant", """SELECT seq, epoch_us(CASE WHEN seq % 3 = 0 THEN observed_at + INTERVAL 6 HOURS ELSE date_trunc('day', observed_at - INTERVAL 6 HOURS) + CASE WHEN hour(observed_at - INTERVAL 6 HOURS) >= 15 THEN INTERVAL 42 HOURS ELSE INTERVAL 18 HOURS END END) AS target_us,
    CASE WHEN seq % 3 = 0 THEN CASE WHEN CAST(observed_at AS DATE) = CAST(observed_at - INTERVAL 6 HOURS AS DATE) THEN 'today' ELSE 'tomorrow' END
         WHEN hour(observed_at - INTERVAL 6 HOURS) >= 15 THEN 'tomorrow' ELSE 'today' END AS word FROM signals""")
def x35(spark, sf):
    zone = "America/Chicago"
    t = H.target_instant(F.when(F.col("seq") % 3 == 0, F.col("observed_at")), F.col("observed_at"), zone)
    return A.signals(spark, sf).select("seq", us(t).alias("target_us"), H.day_word(F.col("observed_at"), t, zone).alias("word"))
