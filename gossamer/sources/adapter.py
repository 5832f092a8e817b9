"""Driver Parquet tables seen as engine tables (integer arithmetic only, so any engine agrees exactly)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Small literal dimensions: their size is fixed here, so broadcasting them is safe.
METRICS = [
    # metric, topic, label, radius_km, window_min, tol_abs, tol_rel, lo, hi, direction, accumulates, is_flag, scored, thresholds, headline, headline_min
    ("click", "web", "Clicks", 60.0, 180, 40.0, 0.35, 0.0, 300.0, "above", False, False, True, [(60.0, 0.4), (150.0, 0.7), (250.0, 1.0)], "max", 150.0),
    ("view", "web", "Views", 60.0, 180, 40.0, 0.35, 0.0, 300.0, "below", False, False, True, [(5.0, 0.4), (1.0, 0.8)], "min", None),
    ("purchase", "sales", "Purchases", 60.0, 180, 40.0, 0.35, 0.0, 300.0, "above", True, False, True, [(60.0, 0.4), (150.0, 0.7), (250.0, 1.0)], "max", 100.0),
    ("signup", "sales", "Signups", 60.0, 180, 40.0, 0.35, 0.0, 300.0, "above", False, True, True, [(60.0, 0.4), (150.0, 0.7), (250.0, 1.0)], None, None),
    ("error", "ops", "Errors", 60.0, 180, 40.0, 0.35, 0.0, 300.0, "above", False, False, True, [(60.0, 0.4), (150.0, 0.7), (250.0, 1.0)], "max", None),
]
METRIC_SCHEMA = T.StructType([
    T.StructField("metric", T.StringType()), T.StructField("topic", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("radius_km", T.DoubleType()), T.StructField("window_min", T.IntegerType()),
    T.StructField("tol_abs", T.DoubleType()), T.StructField("tol_rel", T.DoubleType()),
    T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()), T.StructField("direction", T.StringType()),
    T.StructField("accumulates", T.BooleanType()), T.StructField("is_flag", T.BooleanType()), T.StructField("scored", T.BooleanType()),
    T.StructField("thresholds", T.ArrayType(T.StructType([T.StructField("at", T.DoubleType()), T.StructField("severity", T.DoubleType())]))),
    T.StructField("headline", T.StringType()), T.StructField("headline_min", T.DoubleType()),
])
ALERT_SUPPORT = [("click", "error_alert"), ("purchase", "error_alert")]
TOPIC_OF = {m[0]: m[1] for m in METRICS}

COLUMNS = {
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One driver table. A declared schema reads wall-clock times as UTC instants, so time filters still push down."""
    reader = spark.read
    if name in COLUMNS:
        reader = reader.schema(COLUMNS[name])
    return reader.parquet(f"{sf}/{name}.parquet")


def kind_of(uid):
    m = uid % 10
    return (F.when(m == 0, "station").when(m == 1, "official").when(m == 2, "bot").when(m == 3, "authority").otherwise("human"))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    u = F.col("user_id")
    topic = F.coalesce(*[F.when(F.col("event_type") == m, t) for m, t in TOPIC_OF.items()])
    return e.select(
        F.col("event_id").alias("seq"), u.alias("sensor_id"), kind_of(u).alias("kind"),
        topic.alias("topic"), F.col("event_type").alias("metric"), "value",
        F.col("ts").alias("observed_at"), F.col("ts").alias("received_at"),
        (u % 25).cast("string").alias("county_id"),
        (F.lit(37.0) + ((u * 37) % 550) / F.lit(100.0)).alias("lat"),
        (F.lit(-91.5) + ((u * 53) % 450) / F.lit(100.0)).alias("lon"),
        F.when(u % 3 == 0, "24h").when(u % 3 == 1, "1h").alias("period"),
        F.when(u % 4 == 0, "zip5").otherwise("point").alias("precision"),
        (F.lit(60000) + u % 100).cast("string").alias("zip5"),
        F.concat(F.lit("feed"), (u % 4).cast("string")).alias("source"),
        F.concat((F.col("event_id") / 4).cast("long").cast("string"), F.lit(":"), (F.col("event_id") % 4).cast("string")).alias("source_id"),
        "props",
    )


def assessed(spark: SparkSession, sf: str) -> DataFrame:
    """Readings with a stored quality, for the roll-ups that read a finished table."""
    s, ref = signals(spark, sf), F.col("kind").isin("station", "official", "authority")
    return s.withColumn("quality", F.when(ref, "reference").when(F.col("value") > 300, "rejected")
                        .when(F.col("seq") % 11 == 0, "flagged").when(F.col("seq") % 3 == 0, "corroborated").otherwise("raw"))


def sensors(spark: SparkSession, sf: str) -> DataFrame:
    e, u = table(spark, sf, "events"), F.col("user_id")
    return e.groupBy("user_id").agg(F.min("ts").alias("registered_at")).select(
        u.alias("sensor_id"), kind_of(u).alias("kind"), (u % 25).cast("string").alias("county_id"),
        (F.lit(37.0) + ((u * 37) % 550) / F.lit(100.0)).alias("lat"),
        (F.lit(-91.5) + ((u * 53) % 450) / F.lit(100.0)).alias("lon"),
        F.lit(0.5).alias("trust_prior"), "registered_at",
        F.when(u % 29 == 0, "banned").otherwise("active").alias("status"),
        (u * 10).alias("chat_id"))


def dim_county(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        k.cast("string").alias("county_id"), k.cast("long").alias("ord"), F.col("n_name").alias("name"),
        F.col("n_regionkey").cast("string").alias("state_id"),
        (F.lit(37.25) + (k % 5) * F.lit(1.1)).alias("lat"),
        (F.lit(-91.0) + F.floor(k / 5) * F.lit(0.9)).alias("lon"))


def county_rings(spark: SparkSession, sf: str) -> DataFrame:
    """One hexagon per county around its centre; neighbours overlap a little, so table order decides."""
    c = dim_county(spark, sf)
    off = [(-0.5, 0.0), (-0.25, 0.6), (0.25, 0.6), (0.5, 0.0), (0.25, -0.6), (-0.25, -0.6)]
    ring = F.array(*[F.array(F.col("lon") + dx, F.col("lat") + dy) for dx, dy in off])
    return c.withColumn("rings", F.array(ring))


def dim_metric(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METRICS, METRIC_SCHEMA)


def dim_alert_support(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALERT_SUPPORT, "metric string, slug string")


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    """One row per alert message. ``ref_id`` is the previous error of the same user within 24 h.

    The predecessor is looked up per (user, day): each error meets only the last error of its own and of the
    previous day, so no user's whole history lands in one task.
    """
    e = table(spark, sf, "events").filter(F.col("event_type") == "error")
    u = F.col("user_id")
    from gossamer.plans.bucketed import previous_within

    linked = previous_within(e.select("event_id", "user_id", "ts"), keys=["user_id"], at="ts", row_id="event_id",
                             within_us=86400 * 10**6, carry=["event_id"])
    return linked.select(
        F.col("event_id").alias("alert_id"), F.col("prev_event_id").alias("ref_id"), u.alias("user_id"),
        (u % 25).cast("string").alias("county_id"), (1 + F.col("event_id") % 4).alias("severity"),
        F.col("ts").alias("sent"), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("expires"),
        F.lit("error_alert").alias("slug"),
        F.concat(F.lit("office"), (u % 7).cast("string")).alias("sender"))


def alert_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Alert messages without threading, for operators that need no references."""
    u = F.col("user_id")
    return table(spark, sf, "events").filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("alert_id"), u.alias("user_id"), (u % 25).cast("string").alias("county_id"),
        (1 + F.col("event_id") % 4).alias("severity"), F.col("ts").alias("sent"),
        (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("expires"), F.lit("error_alert").alias("slug"),
        F.col("value"), F.concat(F.lit("office"), (u % 7).cast("string")).alias("sender"),
        F.concat(F.lit("g"), (F.col("event_id") / 3).cast("long").cast("string")).alias("group_key"),
        F.concat(F.lit("Kind "), (F.col("event_id") % 5).cast("string")).alias("event"))


def standing_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alert rows, some without an end, some with a far one; every other one with its county's outline as a polygon."""
    k = F.col("alert_id")
    rings = county_rings(spark, sf).select("county_id", F.col("rings").alias("_rings"))
    ends = F.when(k % 13 == 0, F.lit(None).cast("timestamp")).when(k % 17 == 0, F.col("expires") + F.expr("INTERVAL 40 DAYS")).otherwise(F.col("expires"))
    return alert_rows(spark, sf).withColumn("expires", ends).join(rings, "county_id", "left").withColumn("polygon", F.when(k % 2 == 0, F.col("_rings"))).drop("_rings")


def subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    cat = (F.when(seg == "AUTOMOBILE", "warnings").when(seg == "BUILDING", "alerts").when(seg == "FURNITURE", "events")
           .when(seg == "HOUSEHOLD", "reports").otherwise("digest"))
    return table(spark, sf, "customer").select(
        k.alias("chat_id"), cat.alias("category"),
        F.when(k % 10 == 0, "st").when(k % 10 == 1, F.concat(F.lit("st.zip."), (F.lit(60000) + k % 100).cast("string")))
        .otherwise(F.concat(F.lit("st."), F.col("c_nationkey").cast("string"))).alias("area"))


def outbox(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    pre = F.element_at(F.array(*[F.lit(p) for p in ("alert:", "event:", "report:", "digest:", "confirm:", "other:")]),
                       (k % 6 + 1).cast("int"))
    return table(spark, sf, "orders").select(
        k.alias("id"), F.concat(pre, k.cast("string"), F.when(k % 12 == 0, ":ask").otherwise("")).alias("key"),
        F.when(k % 6 == 0, F.concat(F.lit("alert:"), k.cast("string"))).alias("thread"),
        F.col("o_custkey").alias("chat_id"),
        F.when(F.col("o_orderstatus") == "F", "sent").when(F.col("o_orderstatus") == "O", "pending").otherwise("dropped").alias("status"),
        F.when(k % 5 == 0, "card").when(k % 5 == 1, "edit").otherwise("send").alias("action"),
        F.col("o_orderdate").alias("created_at"),
        F.timestamp_micros(F.unix_micros("o_orderdate") + (k % 300) * 1000000).alias("sent_at"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.timestamp_micros(F.unix_micros("o_orderdate") + (k % 3) * 3600000000).alias("next_attempt_at"),
        F.when(k % 4 == 0, F.timestamp_micros(F.unix_micros("o_orderdate") + F.lit(7200000000))).alias("stale_at"))


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("source"), F.col("ts").alias("run_at"),
        F.when(v >= 60, "error").otherwise("ok").alias("status"),
        F.when(v >= 60, F.concat(F.lit("HTTPError: "), F.floor(v).cast("long").cast("string"))).alias("error"),
        F.floor(v / 10).cast("long").alias("fetched"))


def gauge_series(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("site"), F.col("event_type").alias("metric"),
                                             F.col("ts").alias("taken"), (F.col("value") / 10.0).alias("stage"),
                                             F.col("event_id").alias("seq"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(l, "doc_id", "left").select(
        F.col("doc_id").alias("item_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"),
        F.col("source").alias("feed"), F.col("lang").alias("topic"), F.col("quality").alias("relevance"),
        F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") * 3600000000).alias("published_at"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """News rows without the triage join."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"),
        F.col("source").alias("feed"), F.col("lang").alias("topic"),
        F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") * 3600000000).alias("published_at"))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").filter(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "text")


def latest(df: DataFrame, column: str):
    """The newest instant of a column as a literal: one narrow scan, then every filter on it pushes down."""
    return F.lit(df.agg(F.max(column)).first()[0]).cast("timestamp")
