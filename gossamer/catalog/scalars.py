"""Scalar rules on the adapter tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gossamer.catalog.registry import query
from gossamer.functions import geo
from gossamer.functions import names as NM
from gossamer.functions import scalars as X
from gossamer.sources import adapter as A
from gossamer.sources import vocab as V

us = F.unix_micros

B32 = geo.GEOHASH_ALPHABET


def _geohash_sql():
    chars = []
    for c in range(7):
        bits = []
        for j in range(5):
            k = c * 5 + j
            src, shift = ("ix", 17 - k // 2) if k % 2 == 0 else ("iy", 16 - k // 2)
            bits.append(f"(({src} >> {shift}) & 1) * {1 << (4 - j)}")
        chars.append(f"substr('{B32}', CAST({' + '.join(bits)} AS INTEGER) + 1, 1)")
    return (f"SELECT sensor_id, {' || '.join(chars)} AS geohash FROM (SELECT sensor_id, CAST(ceil((lon + 180) / 360 * 262144) AS BIGINT) - 1 AS ix, "
            "CAST(ceil((lat + 90) / 180 * 131072) AS BIGINT) - 1 AS iy FROM sensors)")


@query("x2_geohash", _geohash_sql())
def x2(spark, sf):
    return A.sensors(spark, sf).select("sensor_id", geo.geohash("lat", "lon").alias("geohash"))


@query("x7_severity", """SELECT s.seq, coalesce(max(t.severity), 0) AS severity FROM signals s JOIN dim_metric m USING (metric)
    LEFT JOIN dim_threshold t ON t.metric = s.metric AND CASE WHEN m.direction = 'below' THEN s.value <= t.lim ELSE s.value >= t.lim END GROUP BY 1""")
def x7(spark, sf):
    return A.signals(spark, sf).join(F.broadcast(A.dim_metric(spark).drop("topic")), "metric").select("seq", X.severity("value", "thresholds", "direction").alias("severity"))


@query("x8_compatible", """SELECT seq, is_flag OR abs(value - other) <= greatest(tol_abs, tol_rel * greatest(abs(value), abs(other))) AS agrees FROM (
    SELECT seq, metric, value, CAST((sensor_id * 7) % 120 AS DOUBLE) AS other FROM signals) JOIN dim_metric USING (metric)""")
def x8(spark, sf):
    s = A.signals(spark, sf).withColumn("other", ((F.col("sensor_id") * 7) % 120).cast("double")).join(F.broadcast(A.dim_metric(spark).drop("topic")), "metric")
    return s.select("seq", X.compatible("value", "other", "is_flag", "tol_abs", "tol_rel").alias("agrees"))


PACK = {"topic": "web", "alert_support": {"click": ["error_alert"]}, "page_fields": {"clk": {"metric": "click", "unit": "k", "period": "1h"}}, "metrics": {
    "click": {"label": "Clicks", "aliases": ["clicks", "page click"], "units": {"n": 1, "k": {"expr": "x*100"}, "f": {"expr": "(x-32)*5/9"}}, "default_unit": "n", "range": [0, 300], "words": {"few": 5, "many": 100}},
    "view": {"aliases": ["views"], "units": {"n": 1, "d": {"expr": "x/10"}}, "default_unit": "d", "range": [0, 300]},
    "purchase": {"aliases": ["purchases"], "units": {"n": 1, "c": {"expr": "x*9/5+32"}}, "default_unit": "n", "range": [0, 300]},
    "signup": {"kind": "flag", "aliases": ["sign up"]},
    "error": {"aliases": ["errors"], "units": {"n": 1, "sq": {"expr": "x**2"}}, "default_unit": "n", "range": [0, 300]}}}
UNIT_PICK = "['', 'n', 'k', 'd', 'c', 'sq', 'f'][sensor_id % 7 + 1]"
CONVERT = f"""SELECT seq, metric, u, CASE metric WHEN 'signup' THEN 1.0 WHEN 'click' THEN CASE u WHEN '' THEN value WHEN 'n' THEN value WHEN 'k' THEN value * 100 WHEN 'f' THEN (value - 32) * 5 / 9 END
    WHEN 'view' THEN CASE u WHEN '' THEN value / 10 WHEN 'n' THEN value WHEN 'd' THEN value / 10 END WHEN 'purchase' THEN CASE u WHEN '' THEN value WHEN 'n' THEN value WHEN 'c' THEN value * 9 / 5 + 32 END
    ELSE CASE u WHEN '' THEN value WHEN 'n' THEN value WHEN 'sq' THEN value * value END END::DOUBLE AS value FROM (SELECT seq, metric, value, {UNIT_PICK} AS u FROM signals)"""


def converted(spark, sf):
    fr = V.frames(spark, [PACK])
    pick = F.element_at(F.array(*[F.lit(u) for u in ("", "n", "k", "d", "c", "sq", "f")]), (F.col("sensor_id") % 7 + 1).cast("int"))
    s = A.signals(spark, sf).select("seq", "metric", F.col("value").alias("raw_value"), pick.alias("unit"))
    return V.convert_unit(s, fr["dim_unit"], fr["dim_metric"])


@query("x9_convert_unit", f"SELECT seq, round(value, 6) AS value, value IS NULL AS bad FROM ({CONVERT})")
def x9(spark, sf):
    return converted(spark, sf).select("seq", F.round("value", 6).alias("value"), F.col("error").isNotNull().alias("bad"))


@query("s17_load_vocabulary", """SELECT metric, count(*) AS n, count(*) FILTER (value BETWEEN 0 AND 300) AS in_range FROM signals GROUP BY 1""")
def s17(spark, sf):
    m = V.frames(spark, [PACK])["dim_metric"].select("metric", "lo", "hi")
    s = A.signals(spark, sf).join(F.broadcast(m), "metric")
    return s.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.count_if(X.in_range("value", F.coalesce("lo", F.lit(0.0)), F.coalesce("hi", F.lit(300.0)))).alias("in_range"))


# The particle scale's breakpoints.
PM25 = [(0.0, 9.0, 0, 50), (9.1, 35.4, 51, 100), (35.5, 55.4, 101, 150), (55.5, 125.4, 151, 200), (125.5, 225.4, 201, 300), (225.5, 325.4, 301, 500)]
_AQI = "CASE " + " ".join(f"WHEN c <= {hi} THEN CAST(round_even(({i1 - i0} / ({hi - lo!r}::DOUBLE))::DOUBLE * (greatest(c, {lo}::DOUBLE) - {lo}::DOUBLE) + {i0}, 0) AS BIGINT)" for lo, hi, i0, i1 in PM25) + " ELSE 500 END"


@query("x10_aqi_of", f"SELECT seq, {_AQI} AS aqi FROM (SELECT seq, CAST(trunc(value * 10) AS BIGINT) / 10.0::DOUBLE AS c FROM signals)")
def x10(spark, sf):
    return A.signals(spark, sf).select("seq", X.aqi_of("value", PM25).alias("aqi"))


@query("x12_public_handle", "SELECT sensor_id, 's-' || substr(sha1(CAST(sensor_id AS VARCHAR)), 1, 5) AS handle FROM sensors")
def x12(spark, sf):
    return A.sensors(spark, sf).select("sensor_id", X.public_handle("sensor_id").alias("handle"))


@query("x14_area_keys", """SELECT seq, array_to_string(list_filter(['st', 'st.' || county_id, CASE WHEN sensor_id % 3 <> 0 THEN 'st.zip.' || zip5 END, CASE WHEN sensor_id % 5 = 0 THEN 'st.zip.' || zip5 || '-1234' END], lambda x: x IS NOT NULL), ' ') AS keys FROM signals""")
def x14(spark, sf):
    s, k = A.signals(spark, sf), F.col("sensor_id")
    keys = X.area_keys(F.lit("ST"), "county_id", F.when(k % 3 != 0, F.col("zip5")), F.when(k % 5 == 0, F.concat("zip5", F.lit("-1234"))))
    return s.select("seq", F.array_join(keys, " ").alias("keys"))


from gossamer.catalog.filters import TITLE  # noqa: E402


@query("x15_title_key", f"SELECT item_id, {TITLE} AS k FROM (SELECT item_id, title || CASE item_id % 3 WHEN 0 THEN ' - The Daily News' WHEN 1 THEN ' - a - ' ELSE '' END AS title FROM doc_rows)")
def x15(spark, sf):
    d, k = A.documents(spark, sf), F.col("item_id")
    t = F.concat("title", F.when(k % 3 == 0, " - The Daily News").when(k % 3 == 1, " - a - ").otherwise(""))
    return d.select("item_id", X.title_key(t).alias("k"))


@query("x16_county_slug", "SELECT item_id, regexp_replace(replace(lower(title || ' County'), ' county', ''), '[^a-z0-9]', '', 'g') AS slug FROM doc_rows")
def x16(spark, sf):
    return A.documents(spark, sf).select("item_id", X.county_slug(F.concat("title", F.lit(" County"))).alias("slug"))


@query("x17_fuzzy_county", """WITH n AS (SELECT s_suppkey, lower(regexp_replace('NATION_' || (s_suppkey % 25) || CASE s_suppkey % 3 WHEN 1 THEN 'x' WHEN 2 THEN 'abcdef' ELSE '' END, '[^A-Za-z0-9]', '', 'g')) AS slug FROM supplier),
    c AS (SELECT county_id, ord, lower(replace(name, '_', '')) AS cs FROM dim_county),
    d AS (SELECT s_suppkey, county_id, ord, levenshtein(slug, cs) AS dist, 1 - levenshtein(slug, cs)::DOUBLE / greatest(length(slug), length(cs)) AS ratio FROM n CROSS JOIN c)
    SELECT s_suppkey, arg_min(county_id, row(dist, ord)) FILTER (ratio >= 0.85) AS county FROM d GROUP BY 1""")
def x17(spark, sf):
    k = F.col("s_suppkey")
    n = A.table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("NATION_"), (k % 25).cast("string"), F.when(k % 3 == 1, "x").when(k % 3 == 2, "abcdef").otherwise("")).alias("name"))
    return NM.fuzzy_county(n, "name", A.dim_county(spark, sf)).select("s_suppkey", "county")


@query("x18_parse_zip", """SELECT s_suppkey, CASE WHEN s_suppkey % 5 < 4 THEN CAST(60000 + s_suppkey AS VARCHAR) END AS zip5, CASE WHEN s_suppkey % 5 IN (1, 2, 3) THEN (60000 + s_suppkey) || '-1234' END AS zip9 FROM supplier""")
def x18(spark, sf):
    k = F.col("s_suppkey")
    z = (F.lit(60000) + k).cast("string")
    t = F.concat(z, F.when(k % 5 == 1, "-1234").when(k % 5 == 2, " 1234").when(k % 5 == 3, "1234").when(k % 5 == 4, "x").otherwise(""))
    s = A.table(spark, sf, "supplier").select("s_suppkey", t.alias("t"))
    return s.select("s_suppkey", X.parse_zip5("t").alias("zip5"), X.parse_zip9("t").alias("zip9"))


NICE = """CASE WHEN abs(x) >= 10000 THEN format('{:,.0f}', round_even(x / pow(10, floor(log10(abs(x))) - 2), 0) * pow(10, floor(log10(abs(x))) - 2)) WHEN abs(x) >= 100 THEN format('{:,.0f}', round_even(x, 0)) WHEN abs(x) < 0.0001 AND x <> 0 THEN format('{:.2f}', x) ELSE format('{:.3g}', x) END"""


@query("x19_nice_number", f"SELECT seq, {NICE} AS a, {NICE.replace('x', 'y').replace('my', 'max')} AS b FROM (SELECT seq, value AS x, floor(value * 317.3) AS y FROM signals)")
def x19(spark, sf):
    return A.signals(spark, sf).select("seq", X.nice_number("value").alias("a"), X.nice_number(F.floor(F.col("value") * 317.3)).alias("b"))


@query("x20_fraction", """SELECT seq, CASE WHEN x >= 3 THEN format('{:,.0f}', round_even(x, 0)) WHEN r = 0 THEN CAST(w AS VARCHAR) ELSE CASE WHEN w > 0 THEN w || ' ' ELSE '' END || (r // g) || '/' || (16 // g) END AS txt FROM (
    SELECT *, CASE WHEN r % 8 = 0 THEN 8 WHEN r % 4 = 0 THEN 4 WHEN r % 2 = 0 THEN 2 ELSE 1 END AS g FROM (SELECT seq, x, CAST(round_even(x * 16, 0) AS BIGINT) // 16 AS w, CAST(round_even(x * 16, 0) AS BIGINT) % 16 AS r FROM (
    SELECT seq, value / 20.0::DOUBLE AS x FROM signals)))""")
def x20(spark, sf):
    return A.signals(spark, sf).select("seq", X.fraction(F.col("value") / 20.0).alias("txt"))


@query("x21_display", f"""SELECT seq, CASE metric WHEN 'signup' THEN 'reported' WHEN 'view' THEN format('{{:,.2f}}', x / 33.0::DOUBLE) || ' u' WHEN 'error' THEN CASE WHEN x = 5 THEN 'few' ELSE {NICE} || ' n' END ELSE {NICE} || ' n' END AS txt
    FROM (SELECT seq, metric, CASE WHEN metric = 'error' AND seq % 2 = 0 THEN 5.0::DOUBLE ELSE value END AS x FROM signals)""")
def x21(spark, sf):
    s = A.signals(spark, sf).withColumn("value", F.when((F.col("metric") == "error") & (F.col("seq") % 2 == 0), 5.0).otherwise(F.col("value")))
    spec = spark.createDataFrame([("click", "n", False, None, 0.0, None, None), ("purchase", "n", False, None, 0.0, None, None), ("signup", "", True, None, 0.0, None, None),
                                  ("view", "n", False, 1 / 33.0, 0.0, "u", 2), ("error", "n", False, None, 0.0, None, None)],
                                 "metric string, unit string, is_flag boolean, a double, b double, shown_unit string, decimals int")
    words = spark.createDataFrame([("error", "few", 5.0)], "metric string, word string, at double")
    return NM.display(s, spec, words).select("seq", F.col("display").alias("txt"))


@query("x22_parse_iso", "SELECT seq, (epoch_us(observed_at) // 1000000) * 1000000 AS a, (epoch_us(observed_at) // 1000000) * 1000000 AS b, strftime(observed_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS txt FROM signals")
def x22(spark, sf):
    s = A.signals(spark, sf).withColumn("t1", X.iso("observed_at")).withColumn("t2", F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss"))
    return s.select("seq", us(X.parse_iso("t1")).alias("a"), us(X.parse_iso("t2")).alias("b"), F.col("t1").alias("txt"))


@query("x23_local_time", "SELECT seq, strftime(observed_at - INTERVAL 6 HOURS, '%a %-I:%M %p') AS txt FROM signals")
def x23(spark, sf):
    return A.signals(spark, sf).select("seq", X.local_time("observed_at", "America/Chicago").alias("txt"))


@query("x27_window_minutes", """SELECT seq, (1 + seq % 50) * CASE seq % 3 WHEN 0 THEN 1 WHEN 1 THEN 60 ELSE 1440 END AS minutes, CASE seq % 3 WHEN 0 THEN (1 + seq % 50) / 60.0::DOUBLE WHEN 1 THEN (1 + seq % 50)::DOUBLE END AS hours FROM signals""")
def x27(spark, sf):
    from gossamer.operators.filters import period_hours

    k = F.col("seq")
    t = F.concat((1 + k % 50).cast("string"), F.when(k % 3 == 0, "m").when(k % 3 == 1, "h").otherwise("d"))
    s = A.signals(spark, sf).select("seq", t.alias("t"))
    return s.select("seq", X.window_minutes("t").alias("minutes"), period_hours("t").alias("hours"))


@query("x29_tidy_names", """SELECT n_nationkey AS k, n_readings, 'Salt Creek at ' || n_nationkey || CASE WHEN n_nationkey % 10 = 1 AND n_nationkey <> 11 THEN 'st' WHEN n_nationkey % 10 = 2 AND n_nationkey <> 12 THEN 'nd' WHEN n_nationkey % 10 = 3 AND n_nationkey <> 13 THEN 'rd' ELSE 'th' END || ' Street near McHenry' AS txt
    FROM nation JOIN (SELECT user_id % 25 AS k, count(*) AS n_readings FROM events GROUP BY 1) e ON e.k = n_nationkey""")
def x29(spark, sf):
    k = F.col("k")
    n = A.table(spark, sf, "events").groupBy((F.col("user_id") % 25).alias("k")).agg(F.count(F.lit(1)).alias("n_readings"))
    sfx = F.when((k % 10 == 1) & (k != 11), "ST").when((k % 10 == 2) & (k != 12), "ND").when((k % 10 == 3) & (k != 13), "RD").otherwise("TH")
    raw = F.concat(F.lit("SALT CREEK AT "), k.cast("string"), sfx, F.lit(" STREET NR MCHENRY, IL"))
    return n.select("k", "n_readings", NM.site_name(raw).alias("txt"))


@query("x33_grounded", """SELECT item_id, item_id % 3 <> 1 AS grounded FROM doc_rows""")
def x33(spark, sf):
    k = F.col("item_id")
    facts = F.concat(F.lit("peak "), k.cast("string"), F.lit(" at 3:15, 1,250 cfs; "), F.regexp_replace("title", "[0-9]", ""))
    text = F.concat(F.lit("It reached "), F.when(k % 3 == 1, F.concat((k + 77).cast("string"), F.lit(".5"))).otherwise(k.cast("string")), F.when(k % 3 == 2, " with 1250 cfs").otherwise(" by 3:15"))
    return A.documents(spark, sf).select("item_id", X.grounded(text, facts).alias("grounded"))
