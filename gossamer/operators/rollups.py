"""Roll-ups: one aggregation with map-side combine wherever the rule allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gossamer.functions import scalars as X
from gossamer.operators.filters import hours_before

def count_all() -> Column:
    return F.count(F.lit(1))


def mesh(signals: DataFrame, now: Column, hours: float, *, people_only: bool = False, stations_only: bool = False) -> DataFrame:
    """A1: county x metric."""
    s = signals.filter((F.col("observed_at") >= hours_before(now, hours)) & F.col("county_id").isNotNull()
                       & ~F.col("metric").startswith("alert.") & (F.col("quality") != "rejected"))
    if people_only:
        s = s.filter(X.is_people())
    if stations_only:
        s = s.filter(F.col("kind") == "station")
    return s.groupBy("county_id", "metric").agg(
        count_all().alias("n"), F.count_distinct("sensor_id").alias("n_sensors"), F.count_if(X.is_people()).alias("n_human"),
        F.avg("value").alias("mean_value"), F.max("value").alias("max_value"), F.min("value").alias("min_value"),
        F.max("observed_at").alias("latest"))


def county_activity(signals: DataFrame, now: Column, days: float, kinds=None) -> DataFrame:
    """A2."""
    s = signals.filter((F.col("observed_at") >= hours_before(now, days * 24)) & F.col("county_id").isNotNull())
    if kinds:
        s = s.filter(F.col("kind").isin(*kinds))
    return s.groupBy("county_id").agg(count_all().alias("n"))


def vitals(signals: DataFrame, sensors: DataFrame, events: DataFrame, alerts: DataFrame, subscriptions: DataFrame,
           counties: DataFrame, now: Column) -> DataFrame:
    """A3: (name, value) of the network's state. Each input is read once; distinct counts are two-phase."""
    day, week = F.col("received_at") >= hours_before(now, 24), F.col("received_at") >= hours_before(now, 168)
    people, q = X.is_people(), F.col("quality")
    # one row per (sensor, county) first: the distinct counts below are plain counts over its two roll-ups
    per = signals.filter(week).groupBy("sensor_id", "county_id").agg(
        F.max(people & day).alias("p24"), F.max(people).alias("p7"), F.count_if(people & day).alias("h24"), F.count_if(X.is_reference() & day).alias("r24"),
        F.count_if(people & (q == "corroborated")).alias("c7"), F.count_if(people & (q == "flagged")).alias("f7"), F.count_if(people).alias("h7"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    by_sensor = per.groupBy("sensor_id").agg(F.max("p24").alias("p24"), F.max("p7").alias("p7"), *[F.sum(c).alias(c) for c in ("h24", "r24", "c7", "f7", "h7")])
    sig = by_sensor.agg(F.count_if(F.col("p24") & F.col("sensor_id").isNotNull()).alias("sensors_active_24h"), F.count_if(F.col("p7") & F.col("sensor_id").isNotNull()).alias("sensors_active_7d"),
                        total("h24").alias("signals_24h_human"), total("r24").alias("signals_24h_reference"), total("c7").alias("corroborated_7d"), total("f7").alias("flagged_7d"), total("h7").alias("human_7d"))
    by_county = per.filter(F.col("county_id").isNotNull()).groupBy("county_id").agg(F.max("p7").alias("p7")).agg(F.count_if("p7").alias("counties_covered_7d"), count_all().alias("counties_reference_7d"))
    sig = sig.withColumn("corroboration_rate_7d", F.when(F.col("human_7d") > 0, F.col("corroborated_7d") / F.col("human_7d")).otherwise(0.0))
    parts = [
        sig,
        by_county,
        sensors.agg(F.count_if(people).alias("sensors_total")),
        events.agg(F.count_if(F.col("status") == "open").alias("events_open"),
                   F.count_if(F.col("updated_at") >= hours_before(now, 24)).alias("events_24h")),
        alerts.filter(F.col("expires").isNull() | (F.col("expires") >= now)).agg(F.count_distinct("group_key").alias("alerts_active")),
        subscriptions.groupBy("chat_id").agg(count_all().alias("n")).agg(total("n").alias("subscriptions"), F.count("chat_id").alias("subscribers")),
        counties.agg(count_all().alias("counties_total")),
    ]
    out = None
    for p in parts:
        rows = p.select(*[F.col(c).cast("double").alias(c) for c in p.columns]).unpivot([], p.columns, "name", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def leaderboard(signals: DataFrame, sensors: DataFrame, now: Column, days: float, limit: int = 10) -> DataFrame:
    """Most corroborated people. Readings are counted per sensor before the join."""
    counts = signals.filter(X.is_people() & (F.col("received_at") >= hours_before(now, days * 24))).groupBy("sensor_id").agg(
        count_all().alias("n"), F.count_if(F.col("quality") == "corroborated").alias("n_corr"))
    s = sensors.filter(X.is_people() & (F.col("status") == "active"))
    return counts.join(s, "sensor_id").orderBy(F.desc("n_corr"), F.desc("n"), F.desc("trust_prior"), "sensor_id").limit(limit)


def activity_by_day(signals: DataFrame, alerts: DataFrame, topics: list[str], now: Column, days: int) -> DataFrame:
    """Day x topic for people, one reference column, distinct alert groups; zero rows for silent days."""
    start = F.date_sub(F.to_date(now), days - 1)
    day = F.to_date("observed_at")
    s = signals.filter((F.col("observed_at") >= start.cast("timestamp")) & ~F.col("metric").startswith("alert."))
    per = s.groupBy(day.alias("day")).agg(
        *[F.count_if((F.col("topic") == t) & X.is_people()).alias(t) for t in topics], F.count_if(~X.is_people()).alias("reference"))
    al = alerts.filter(F.col("sent") >= start.cast("timestamp")).groupBy(F.to_date("sent").alias("day")).agg(
        F.count_distinct("group_key").alias("alerts"))
    spine = signals.sparkSession.range(days).select(F.date_add(start, F.col("id").cast("int")).alias("day"))
    return spine.join(per, "day", "left").join(al, "day", "left").fillna(0, [*topics, "reference", "alerts"])


def county_rollup(signals: DataFrame, alerts: DataFrame, events: DataFrame, counties: DataFrame, now: Column, days: int) -> DataFrame:
    """A15."""
    since = F.col("observed_at") >= hours_before(now, days * 24)
    act = signals.filter(since).groupBy("county_id").agg(F.count_if(X.is_people()).alias("human"), F.count_if(X.is_reference()).alias("reference"))
    al = alerts.filter(F.col("expires").isNull() | (F.col("expires") > now)).groupBy("county_id").agg(count_all().alias("alerts"))
    ev = events.filter(F.col("status") == "open").groupBy("county_id").agg(count_all().alias("events"))
    top = (signals.filter(since & X.is_people() & (F.col("quality") != "rejected")).groupBy("county_id", "metric").agg(count_all().alias("n"))
           .groupBy("county_id").agg(F.max_by("metric", F.struct("n", "metric")).alias("top_metric")))
    out = counties.select("county_id", "name", "lat", "lon")
    for part in (act, al, ev, top):
        out = out.join(part, "county_id", "left")
    return out.fillna(0, ["human", "reference", "alerts", "events"])


def alert_recap(alerts: DataFrame, counties: DataFrame, now: Column, hours: float) -> DataFrame:
    """One row per alert group: attributes of its newest row and its county names."""
    a = alerts.filter(F.col("sent") >= hours_before(now, hours)).join(counties.select("county_id", "name"), "county_id", "left")
    newest = F.struct("sent", "alert_id")
    return a.groupBy("group_key").agg(
        F.max_by(F.struct("event", "severity", "sender", "sent", "expires"), newest).alias("a"),
        F.sort_array(F.collect_set("name")).alias("counties")).select("group_key", "a.*", "counties")


def alert_kinds(recap: DataFrame) -> DataFrame:
    """Per kind of alert. Counties and senders are sets bounded by the dimension tables."""
    c = recap.groupBy("event").agg(count_all().alias("n"), F.sort_array(F.collect_set("sender")).alias("senders"), F.max("expires").alias("expires"))
    names = recap.select("event", F.explode("counties").alias("name")).groupBy("event").agg(F.sort_array(F.collect_set("name")).alias("counties"))
    return c.join(names, "event", "left")


def station_extremes(mesh_rows: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """The county holding the highest or lowest station value of each wanted metric (ties: most readings, then id)."""
    out = None
    for metric, how in wanted:
        v = F.col(f"{how}_value")
        rank = F.struct((v if how == "max" else -v).alias("v"), "n", "county_id")
        r = mesh_rows.filter((F.col("metric") == metric) & v.isNotNull()).groupBy("metric").agg(
            F.max_by(F.struct(v.alias("value"), "county_id", "n"), rank).alias("b")).select("metric", F.lit(how).alias("how"), "b.*")
        out = r if out is None else out.unionByName(r)
    return out


def subscription_counts(subs: DataFrame) -> DataFrame:
    """A19."""
    return subs.groupBy("category").agg(F.count_distinct("chat_id").alias("n"))


def feed_freshness(run_log: DataFrame) -> DataFrame:
    """A20."""
    return run_log.filter(F.col("status") == "ok").groupBy("source").agg(F.max("run_at").alias("last_ok"))


def reference_sizes(sensors: DataFrame, family: Column) -> DataFrame:
    """A21."""
    return sensors.filter(X.is_reference()).groupBy(family.alias("family")).agg(count_all().alias("n"))


def short_error(error) -> Column:
    """The first 70 characters of an error's message: its words without addresses, up to a bracket or the words "for url"."""
    words = F.filter(F.split(F.trim(F.coalesce(error, F.lit(""))), r"\s+"), lambda w: ~w.startswith("http://") & ~w.startswith("https://"))
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    lead = F.substring_index(F.substring_index(text, "(", 1), " for url ", 1)
    return F.left(F.trim(F.trim(lead), F.lit(" :")), F.lit(70))


def feed_problems(run_log: DataFrame, cadence: DataFrame, now: Column, min_fails: int = 4, share: float = 0.5, chronic: int = 12) -> DataFrame:
    """Feeds failing most of their last day, or without a good run for longer than their cadence allows."""
    day = F.col("run_at") >= hours_before(now, 24)
    per = run_log.filter(day).groupBy("source").agg(
        F.count_if(F.col("status") == "error").alias("bad"), count_all().alias("n"),
        F.max(F.when(F.col("status") == "error", F.col("error"))).alias("err"), F.max_by("status", "id").alias("last"))
    failing = per.filter((F.col("bad") >= min_fails) & (F.col("bad") / F.col("n") >= share)
                         & ((F.col("last") == "error") | (F.col("n") >= chronic)))
    failing = failing.select("source", F.lit("failing").alias("problem"), F.col("bad").cast("double").alias("amount"), short_error(F.col("err")).alias("detail"))
    age = (F.unix_micros(now) - F.unix_micros("last_ok")) / F.lit(3600e6)
    stale = feed_freshness(run_log).join(cadence, "source").withColumn("age", age).filter(F.col("age") > F.col("stale_hours"))
    return failing.unionByName(stale.select("source", F.lit("stale").alias("problem"), F.round("age", 3).alias("amount"), F.lit(None).cast("string").alias("detail")))


def empty_streaks(run_log: DataFrame, runs: int = 3) -> DataFrame:
    """Sources whose latest runs were empty ``runs`` times or more in a row.

    The streak is the runs after the last run that brought something: two aggregates, no ordered pass.
    """
    last = run_log.groupBy("source").agg(F.max(F.when(F.col("fetched") > 0, F.col("id"))).alias("_last"))
    out = run_log.filter(F.col("fetched") == 0).groupBy("source", "id").agg(F.lit(1).alias("one"))
    out = out.join(last, "source").filter(F.coalesce(F.col("id") > F.col("_last"), F.lit(True)))
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("streak")).filter(F.col("streak") >= runs)


def message_kind() -> Column:
    """Kind of a delivered message from its thread and key."""
    k, th = F.col("key"), F.coalesce(F.col("thread"), F.lit(""))
    note = k.startswith("confirm:") | k.startswith("ahead:") | k.startswith("helped:")
    return (F.when(th.startswith("alert:") & k.endswith(":ask"), "questions").when(th.startswith("alert:"), "alerts")
            .when(k.startswith("digest:"), "briefs").when(k.startswith("event:"), "events").when(k.startswith("report:"), "reports")
            .when(note, "notes").otherwise("other"))


def messages_by_kind(outbox: DataFrame, since: Column) -> DataFrame:
    """A25."""
    o = outbox.filter((F.col("status") == "sent") & (F.col("action") != "edit") & (F.col("sent_at") >= since))
    return o.groupBy(message_kind().alias("kind")).agg(count_all().alias("n"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, qs: list[float], step: float = 1.0) -> DataFrame:
    """X11: exact nearest-rank percentiles (rank round-half-even of q(n-1)).

    Values are counted, first per ``step``-wide bucket: ranks are located among bucket totals, and only the buckets that
    hold a wanted rank are ordered value by value. A group's rows never meet in one task.
    """
    return at_ranks(df, keys, value, {f"p{int(q * 100)}": lambda n, q=q: F.bround(F.lit(q) * (n - 1), 0) for q in qs}, step)


def median(df: DataFrame, value: str, step: float = 1.0) -> DataFrame:
    """One row: the mean of the middle value, or of the two middle ones."""
    mid = at_ranks(df.withColumn("_all", F.lit(1)), ["_all"], value, {"a": lambda n: F.floor((n - 1) / 2), "b": lambda n: F.floor(n / 2)}, step)
    return mid.agg(F.max((F.col("a") + F.col("b")) / 2).alias("median"))


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict, step: float) -> DataFrame:
    """Values at ranks (from 0) given as functions of each key's number of rows."""
    v = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(count_all().alias("_c")).withColumn("_s", F.floor(F.col(value) / step))
    s = v.groupBy(*keys, "_s").agg(F.sum("_c").alias("_sc"))
    w = W.partitionBy(*keys)
    s = s.withColumn("_hi", F.sum("_sc").over(w.orderBy("_s"))).withColumn("_n", F.sum("_sc").over(w)).withColumn("_lo", F.col("_hi") - F.col("_sc"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("long").alias("rank")) for name, rank in ranks.items()])
    here = s.withColumn("_q", F.filter(wanted, lambda x: (x["rank"] >= F.col("_lo")) & (x["rank"] < F.col("_hi")))).filter(F.size("_q") > 0)
    inner = v.join(here.select(*keys, "_s", "_lo", "_q"), [*keys, "_s"])
    inner = inner.withColumn("_cum", F.col("_lo") + F.sum("_c").over(W.partitionBy(*keys, "_s").orderBy(value)))
    hits = inner.withColumn("_x", F.explode("_q")).filter((F.col("_x.rank") < F.col("_cum")) & (F.col("_x.rank") >= F.col("_cum") - F.col("_c")))
    return hits.groupBy(*keys).agg(*[F.max(F.when(F.col("_x.name") == name, F.col(value))).alias(name) for name in ranks])


def latest_gauges(series: DataFrame, now: Column, hours: float, wanted: dict[str, str]) -> DataFrame:
    """Newest value per site and metric, one column per metric."""
    s = series.filter((F.col("taken") >= hours_before(now, hours)) & F.col("metric").isin(*wanted))
    newest = lambda m: F.max_by(F.when(F.col("metric") == m, F.col("stage")), F.when(F.col("metric") == m, F.struct("taken", "seq")))
    return s.groupBy("site").agg(*[newest(m).alias(n) for m, n in wanted.items()], F.max("taken").alias("taken"))


def latest_per_key(df: DataFrame, keys: list[str], order: list, keep: list[str]) -> DataFrame:
    """Newest row per key as a partially aggregated max (no window)."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def strongest_by_place(signals: DataFrame, top: int = 14) -> DataFrame:
    """Strongest reading per (rounded place, metric); official ones get 0.01 more. Rows carry severity."""
    weight = F.col("severity") + F.when(F.col("kind") == "official", 0.01).otherwise(0.0)
    r = signals.select("seq", "metric", "value", F.round("lat", 3).alias("lat3"), F.round("lon", 3).alias("lon3"), weight.alias("weight"))
    best = r.groupBy("lat3", "lon3", "metric").agg(F.max_by(F.struct("seq", "value", "weight"), F.struct("weight", -F.col("seq"))).alias("b"))
    return best.select("lat3", "lon3", "metric", "b.*").orderBy(F.desc("weight"), "seq").limit(top)


def outbox_counts(outbox: DataFrame) -> DataFrame:
    """A36."""
    return outbox.groupBy("status").agg(count_all().alias("n"))


def followup_quota(outbox: DataFrame, prefix: str, since: Column, quota: int = 5) -> DataFrame:
    """How many notes each chat may still get."""
    o = outbox.filter(F.col("key").startswith(prefix) & (F.col("created_at") >= since) & F.col("status").isin("pending", "sent"))
    return o.groupBy("chat_id").agg(count_all().alias("sent")).withColumn("left", F.greatest(F.lit(0), F.lit(quota) - F.col("sent")).cast("long"))


def rain_summary(signals: DataFrame, metric: str, now: Column, hours: float) -> DataFrame:
    """Per county the largest day total and the distinct observers."""
    s = signals.filter((F.col("metric") == metric) & (F.col("period") == "24h") & (F.col("observed_at") >= hours_before(now, hours)))
    return s.groupBy("county_id").agg(F.max("value").alias("max_total"), F.count_distinct("sensor_id").alias("observers"))


def vocabulary_counts(dim_metric: DataFrame) -> DataFrame:
    """A39."""
    return dim_metric.groupBy("topic").agg(count_all().alias("metrics"), F.count_if("is_flag").alias("flags"))


def night_summary(signals: DataFrame, dim_metric: DataFrame, now: Column, hours: float) -> DataFrame:
    """Per county, metrics people reported or that went past a threshold; the peak by direction."""
    s = signals.filter((F.col("observed_at") >= hours_before(now, hours)) & F.col("county_id").isNotNull() & (F.col("quality") != "rejected"))
    m = s.groupBy("county_id", "metric").agg(count_all().alias("n"), F.count_if(X.is_people()).alias("n_human"),
                                             F.max("value").alias("hi_value"), F.min("value").alias("lo_value"))
    m = m.join(F.broadcast(dim_metric.select("metric", "direction", "thresholds")), "metric")
    m = m.withColumn("peak", F.when(F.col("direction") == "below", F.col("lo_value")).otherwise(F.col("hi_value")))
    return m.filter((F.col("n_human") > 0) | (X.severity("peak", "thresholds", "direction") > 0)).select("county_id", "metric", "n", "n_human", "peak")


def county_top_readings(signals: DataFrame, now: Column, hours: float, top: int = 5) -> DataFrame:
    """Each county's most reported metric (by people) and its largest readings."""
    s = signals.filter((F.col("observed_at") >= hours_before(now, hours)) & (F.col("quality") != "rejected"))
    best = (s.filter(X.is_people()).groupBy("county_id", "metric").agg(count_all().alias("n"))
            .groupBy("county_id").agg(F.max_by("metric", F.struct("n", "metric")).alias("metric")))
    r = s.join(best, ["county_id", "metric"]).filter(F.col("value").isNotNull() & (F.col("kind") != "authority"))
    return top_per_key(r, ["county_id", "metric"], [F.desc("value"), F.asc("seq")], top, salt="seq")


def top_per_key(df: DataFrame, keys: list[str], order: list, k: int, salt: str) -> DataFrame:
    """Top k rows per key in two levels: k per (key, slice) first, so a hot key is ranked in parallel."""
    sliced = df.withColumn("_s", F.pmod(F.xxhash64(salt), F.lit(256)))
    first = sliced.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_s").orderBy(*order))).filter(F.col("_r") <= k)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.drop("_s", "_r")
