"""Weekly measures, reading lists and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.functions import scalars as X
from gossamer.operators import rollups as R
from gossamer.operators.filters import hours_before

MICRO = 10**6


def coverage_gaps(signals: DataFrame, counties: DataFrame, now: Column, days: float) -> DataFrame:
    """Counties without a reading from people in the window, by name."""
    active = signals.filter(X.is_people() & (F.col("observed_at") >= hours_before(now, days * 24))).select("county_id").distinct()
    return counties.join(active, "county_id", "left_anti").orderBy("name")


def activation(sensors: DataFrame, signals: DataFrame, since: Column) -> DataFrame:
    """People registered since, with their first reading and whether it came within 24 h. Readings are combined
    per sensor before the join."""
    first = signals.groupBy("sensor_id").agg(F.min("received_at").alias("first_at"))
    s = sensors.filter((F.col("kind") == "human") & (F.col("registered_at") >= since)).join(first, "sensor_id", "left")
    soon = F.unix_micros("first_at") - F.unix_micros("registered_at") <= F.lit(86400 * MICRO)
    return s.withColumn("activated", F.coalesce(soon, F.lit(False)))


def asked_delivered(questions: DataFrame, outbox: DataFrame) -> DataFrame:
    """Questions whose message was delivered."""
    o = outbox.filter(F.col("status") == "sent").select("key", "chat_id")
    return questions.withColumn("key", F.concat("thread", F.lit(":ask"))).join(o, ["key", "chat_id"])


def alert_cards(outbox: DataFrame, threads: DataFrame, first_fanout_min: int = 30) -> DataFrame:
    """Delivered cards queued within half an hour of the thread's opening, with the delay in seconds."""
    o = outbox.filter((F.col("action") == "card") & (F.col("status") == "sent"))
    t = threads.select(F.concat(F.lit("alert:"), "thread_id").alias("thread"), "opened_at")
    c = o.join(t, "thread").filter(F.unix_micros("created_at") - F.unix_micros("opened_at") <= F.lit(first_fanout_min * 60 * MICRO))
    lag = (F.unix_micros("sent_at") - F.unix_micros("opened_at")) / F.lit(1e6)
    return c.withColumn("lag_s", F.greatest(F.lit(0.0), lag))


def weekly(signals: DataFrame, sensors: DataFrame, counties: DataFrame, questions: DataFrame, outbox: DataFrame, threads: DataFrame,
           subscriptions: DataFrame, now: Column, days: int, mail_now: Column | None = None) -> DataFrame:
    """(name, value) of the last ``days`` days. Median and percentiles are located in histograms of whole minutes and seconds and read exactly.

    ``mail_now`` is the end of the period for questions and messages, where their clock is another.
    """
    since = hours_before(now, days * 24)
    mail_since = since if mail_now is None else hours_before(mail_now, days * 24)
    people = signals.filter((F.col("kind") == "human") & (F.col("received_at") >= since))
    settled = people.filter((F.col("quality") == "corroborated") & F.col("settled_at").isNotNull())
    wait = (F.unix_micros("settled_at") - F.unix_micros("received_at")) / F.lit(60e6)
    cards = alert_cards(outbox.filter(F.col("sent_at") >= mail_since), threads).select(F.lit(1).alias("k"), "lag_s")
    asked = asked_delivered(questions.filter(F.col("asked_at") >= mail_since), outbox)
    kinds = R.messages_by_kind(outbox, mail_since)
    readers = subscriptions.select("chat_id").distinct().agg(F.count("chat_id").alias("subscribers"))
    parts = [
        activation(sensors, signals, since).agg(F.count(F.lit(1)).alias("joined"), F.count_if("activated").alias("activated")),
        people.agg(F.count(F.lit(1)).alias("human_readings"), F.count_if((F.col("quality") == "corroborated") & F.col("settled_at").isNotNull()).alias("corroborated")),
        R.median(settled.select(wait.alias("wait")), "wait").select(F.bround("median", 1).alias("confirm_minutes_median")),
        cards.agg(F.count(F.lit(1)).alias("alert_cards")),
        R.nearest_rank(cards, ["k"], "lag_s", [0.5, 0.95]).select(F.col("p50").alias("alert_seconds_p50"), F.col("p95").alias("alert_seconds_p95")),
        asked.agg(F.count(F.lit(1)).alias("asked"), F.count("answered_at").alias("answered")),
        signals.filter(X.is_people() & (F.col("observed_at") >= since)).select("county_id").distinct().agg(F.count("county_id").alias("counties_covered")),
        counties.agg(F.count(F.lit(1)).alias("counties_total")),
        readers,
    ]
    out = kinds.select(F.concat(F.lit("messages_"), "kind").alias("name"), F.col("n").cast("double").alias("value"))
    for p in parts:
        out = out.unionByName(p.select(*[F.col(c).cast("double").alias(c) for c in p.columns]).unpivot([], p.columns, "name", "value"))
    # two one-row totals meet on a constant key
    per = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).withColumn("k", F.lit(1)).join(readers.withColumn("k", F.lit(1)), "k").select(
        F.lit("messages_per_subscriber_week").alias("name"), F.bround(F.when(F.col("subscribers") > 0, F.col("n") / F.col("subscribers") * (7.0 / days)), 1).alias("value"))
    return out.unionByName(per)


def items_to_triage(items: DataFrame, limit: int) -> DataFrame:
    """Newest items without a triage result."""
    return items.filter(F.col("relevance").isNull()).orderBy(F.desc("published_at"), F.desc("item_id")).limit(limit)


def reading_list(items: DataFrame, block: list[str], limit: int) -> DataFrame:
    """T4: kept items, best first, each story once, blocked titles left out."""
    out = items
    for pattern in block:
        out = out.filter(~F.coalesce(F.col("title"), F.lit("")).rlike(f"(?i){pattern}"))
    d = out.withColumn("title_key", X.title_key("title"))
    rank = F.struct((-F.col("relevance")).alias("r"), (-F.unix_micros("published_at")).alias("p"), "item_id")
    best = d.groupBy("title_key").agg(F.min_by(F.struct("item_id", "title", "relevance", "published_at"), rank).alias("b")).select("title_key", "b.*")
    return best.orderBy(F.desc("relevance"), F.desc("published_at"), "item_id").limit(limit)
