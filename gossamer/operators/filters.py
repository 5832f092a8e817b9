"""Predicates and filters over readings, alerts, items and the delivery ledger."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gossamer.functions import geo
from gossamer.functions import scalars as X
from gossamer.plans.bucketed import bucket_of, sessions


def hours_before(now: Column, hours: float) -> Column:
    return now - F.make_dt_interval(secs=F.lit(hours * 3600.0))


def recent_signals(signals: DataFrame, now: Column | None = None, hours: float | None = None, topic: str | None = None,
                   kinds: Iterable[str] | None = None, county: str | None = None, metric: str | None = None,
                   metric_prefix: str | None = None, quality: Iterable[str] | None = None) -> DataFrame:
    """every predicate is optional; all of them reach the scan."""
    out = signals
    if hours is not None:
        out = out.filter(F.col("observed_at") >= hours_before(now, hours))
    if topic:
        out = out.filter(F.col("topic") == topic)
    if kinds:
        out = out.filter(F.col("kind").isin(*kinds))
    if county:
        out = out.filter(F.col("county_id") == county)
    if metric:
        out = out.filter(F.col("metric") == metric)
    if metric_prefix:
        out = out.filter(F.col("metric").startswith(metric_prefix))
    if quality:
        out = out.filter(F.col("quality").isin(*quality))
    return out


def active_alerts(alerts: DataFrame, now: Column, county: str | None = None) -> DataFrame:
    """not expired, strictly."""
    out = alerts.filter(F.col("expires").isNull() | (F.col("expires") > now))
    return out.filter(F.col("county_id") == county) if county else out


def in_range(signals: DataFrame) -> DataFrame:
    """F3 over rows that carry lo and hi."""
    return signals.filter(X.in_range("value", "lo", "hi"))


def crossings(signals: DataFrame) -> DataFrame:
    """readings past a threshold, with their severity; rows carry thresholds and direction."""
    return signals.withColumn("severity", X.severity("value", "thresholds", "direction")).filter(
        F.col("value").isNotNull() & (F.col("severity") > 0))


def raw_readings_in(signals: DataFrame, metric: str, counties: DataFrame, start: Column, end: Column) -> DataFrame:
    """unsettled people's readings of a metric in some counties over a time range (inclusive)."""
    out = signals.filter((F.col("metric") == metric) & (F.col("quality") == "raw") & X.is_people()
                         & F.col("observed_at").between(start, end))
    return out.join(counties.select("county_id"), "county_id", "left_semi")


def grid_candidates(signals: DataFrame, metrics: Iterable[str], since: Column) -> DataFrame:
    """unsettled people's readings with a point that no grid has judged. ``evidence`` is JSON text."""
    judged = F.variant_get(F.try_parse_json("evidence"), "$.grid", "string")
    return signals.filter(F.col("metric").isin(*metrics) & X.is_people() & (F.col("quality") == "raw")
                          & F.col("lat").isNotNull() & F.col("lon").isNotNull()
                          & (F.col("observed_at") >= since) & judged.isNull())


def filter_items(items: DataFrame, rules: DataFrame, block: list[str]) -> DataFrame:
    """per-feed include and exclude patterns on title and body, global block patterns on the title.

    ``rules`` (feed, include, exclude) is configuration of a few dozen rows. A feed without a rule passes.
    """
    out = items
    for pattern in block:
        out = out.filter(~F.coalesce(F.col("title"), F.lit("")).rlike(f"(?i){pattern}"))
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    hit = lambda c: F.regexp_like(text, F.concat(F.lit("(?i)"), F.col(c)))
    out = out.join(F.broadcast(rules), "feed", "left")
    return out.filter((F.col("include").isNull() | hit("include")) & (F.col("exclude").isNull() | ~hit("exclude"))).drop("include", "exclude")


def in_or_near(points: DataFrame, rings: Column, km: float = 0.0) -> DataFrame:
    """Points inside the outline, or at most ``km`` from an edge of it. ``rings`` is one bounded literal.

    Each distinct place is judged once, however many points share it; a filter on the grouping keys themselves would be moved below their grouping.
    """
    places = points.groupBy("lat", "lon").agg(F.max("lat").alias("_y"), F.max("lon").alias("_x"))
    inside = geo.point_in_polygon("_y", "_x", rings)
    hit = inside if km <= 0 else inside | (geo.polygon_gap("_y", "_x", rings)["km"] <= km)
    return points.join(places.filter(hit), ["lat", "lon"], "left_semi").select(*points.columns)


def headline_min_gate(rows: DataFrame) -> DataFrame:
    """a highest (lowest) value counts only past the vocabulary's minimum (maximum)."""
    short = F.when(F.col("headline") == "max", F.col("value") < F.col("headline_min")).otherwise(F.col("value") > F.col("headline_min"))
    return rows.filter(~F.coalesce(F.col("headline_min").isNotNull() & short, F.lit(False)))


def period_hours(period) -> Column:
    n, u = F.regexp_extract(period, r"^\s*(\d+(?:\.\d+)?)\s*([hm])\s*$", 1), F.regexp_extract(period, r"^\s*(\d+(?:\.\d+)?)\s*([hm])\s*$", 2)
    return F.when(n != "", n.try_cast("double") / F.when(u == "m", 60.0).otherwise(1.0))


def hourly_rate(signals: DataFrame, keys: list[str]) -> DataFrame:
    """whether any reading of a series is over less than six hours."""
    return signals.groupBy(*keys).agg(F.coalesce(F.max(period_hours("period") < 6), F.lit(False)).alias("is_rate"))


def rate_limited(messages: DataFrame, at: str = "received_at", row_id: str = "seq", minutes: int = 10, limit: int = 20) -> DataFrame:
    """the sensor's stored requests in the minutes before each one, and whether it is refused. A refused request is not stored and counts for nothing later.

    That is a fold in order of arrival, but a silence longer than the window forgets everything: each burst between silences is folded by itself, streamed in
    sorted order past a queue of at most ``limit`` times, so neither a busy sensor nor a long burst is held in memory.
    """
    span = minutes * 60 * 10**6
    keyed = messages.withColumn("_b", bucket_of(at, span)).join(sessions(messages, ["sensor_id"], at, span), ["sensor_id", "_b"]).drop("_b").withColumn("_t", F.unix_micros(at))
    schema = T.StructType([*messages.schema.fields, T.StructField("n_before", T.LongType()), T.StructField("refused", T.BooleanType())])
    names = messages.columns

    def fold(batches):
        now, kept = None, deque()
        for b in batches:
            before = []
            for key, t in zip(zip(b.column("sensor_id").to_pylist(), b.column("session_at").to_pylist()), b.column("_t").to_pylist()):
                if key != now:
                    now, kept = key, deque()
                while kept and kept[0] < t - span:
                    kept.popleft()
                before.append(len(kept))
                if len(kept) < limit:
                    kept.append(t)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(before, pa.int64()), pa.array([n >= limit for n in before], pa.bool_())], [*names, "n_before", "refused"])

    order = keyed.repartition("sensor_id", "session_at").sortWithinPartitions("sensor_id", "session_at", "_t", row_id)
    return order.mapInArrow(fold, schema)


def without_banned(signals: DataFrame, sensors: DataFrame) -> DataFrame:
    """F15."""
    return signals.join(sensors.filter(F.col("status") == "banned").select("sensor_id"), "sensor_id", "left_anti")


def due_messages(outbox: DataFrame, now: Column) -> DataFrame:
    """F16: pending, due and not stale, in sending order."""
    stale = F.col("stale_at").isNotNull() & (F.col("stale_at") < now)
    return outbox.filter((F.col("status") == "pending") & (F.col("next_attempt_at") <= now) & ~stale).orderBy("priority", "id")


def with_point(df: DataFrame) -> DataFrame:
    """F17."""
    return df.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def message_rows(signals: DataFrame, source: str, sensor_id, base: str) -> DataFrame:
    """readings of one message, by source id prefix."""
    return signals.filter((F.col("sensor_id") == sensor_id) & (F.col("source") == source) & F.col("source_id").startswith(f"{base}:"))


def ended_for_county(threads: DataFrame, county: str, now: Column, hours: float) -> DataFrame:
    """threads that ended in the last hours and cover a county."""
    return threads.filter((F.col("status") == "ended") & (F.col("ended_at") >= hours_before(now, hours))
                          & F.array_contains("counties", county))
