"""Alert messages threaded through their references; thread life cycle; what got worse between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gossamer.plans.bucketed import lag_columns
from gossamer.plans.components import components
from gossamer.session import checkpointed

ABSENT_US = 90 * 10**6
SUSPECT_EMPTY = 3


def alert_threads(alerts: DataFrame) -> DataFrame:
    """(alert_id, thread_id). Messages joined by references, directly or through others, share a thread; the least
    id of the component (ids grow with time) names it.
    """
    edges = alerts.filter(F.col("ref_id").isNotNull()).select(F.col("alert_id").alias("u"), F.col("ref_id").alias("v"))
    roots = components(edges)
    return alerts.select("alert_id").join(roots, alerts.alert_id == roots.node, "left").select(
        "alert_id", F.coalesce("root", "alert_id").alias("thread_id"))


def reference_threads(messages: DataFrame) -> DataFrame:
    """G2 over lists of string ids: (alert_id, thread_id). Messages that reference each other, directly, through others or through one that never came,
    share a thread; the first message sent names it. ``messages`` may hold a row per county.
    """
    m = messages.groupBy("alert_id").agg(F.min("observed_at").alias("sent"), F.first("references").alias("references"))
    edges = m.select(F.col("alert_id").alias("u"), F.explode("references").alias("v"))
    roots = components(edges)
    m = m.select("alert_id", "sent").join(roots, F.col("alert_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "alert_id"))
    named = m.groupBy("root").agg(F.min_by("alert_id", F.struct("sent", "alert_id")).alias("thread_id"))
    return m.select("alert_id", "root").join(named, "root").select("alert_id", "thread_id")


def tag_rises(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """G4 on S2's tags: (alert_id, tag, level, value, text) of what is new or rose against the thread's previous message. Ordered tags compare their place in the
    pack's list, others their number; a thread's first message has nothing to rise from."""
    m = messages.groupBy("alert_id").agg(F.min("observed_at").alias("sent"), F.first("impact").alias("impact")).join(threads, "alert_id")
    out = lag_columns(m.withColumn("_seen", F.lit(True)), ["thread_id"], "sent", "alert_id", ["impact", "_seen"], 86400 * 10**6).filter("prev__seen")
    out = out.select("alert_id", "thread_id", "prev_impact", F.inline("impact"))
    before = F.get(F.filter("prev_impact", lambda x: x["tag"] == F.col("tag")), F.lit(0))
    rose = before.isNull() | F.coalesce(F.col("level") > before["level"], F.lit(False)) | F.coalesce(F.col("value") > before["value"], F.lit(False))
    return out.filter(rose).select("alert_id", "thread_id", "tag", "level", "value", "text")


def thread_rows(alerts: DataFrame, threads: DataFrame, now: Column) -> DataFrame:
    """One row per thread: newest message's attributes, first time, counties, and whether it has expired."""
    a = alerts.join(threads, "alert_id")
    t = a.groupBy("thread_id").agg(
        F.max_by(F.struct("alert_id", "severity", "sent", "expires"), F.struct("sent", "alert_id")).alias("n"),
        F.min("sent").alias("opened_at"), F.count(F.lit(1)).alias("n_messages"), F.sort_array(F.collect_set("county_id")).alias("counties"))
    over = F.col("n.expires").isNotNull() & (F.col("n.expires") <= now)
    return t.select("thread_id", F.col("n.alert_id").alias("current_id"), "n.severity", "opened_at", F.col("n.sent").alias("updated_at"),
                    F.col("n.expires").alias("expires"), "n_messages", "counties", F.when(over, "ended").otherwise("active").alias("status"),
                    F.when(over, F.col("n.expires")).alias("ended_at"))


HOUR_US, DAY_US = 3600 * 10**6, 86400 * 10**6
MAX_ROUNDS = 100


def thread_lifecycle(threads: DataFrame, manifests: DataFrame, seen: DataFrame) -> DataFrame:
    """How and when each thread ended, from fetch manifests.

    ``threads`` (thread_id, current_id, updated_at, expires); ``manifests`` (fetch_at, n_ids) one row per successful
    fetch; ``seen`` (fetch_at, alert_id). A trusted fetch without a thread begins its absence; a fetch 90 s later or more, without a sighting in between, cancels it. It
    expires when a fetch finds its end passed. An empty fetch with three or more threads in force is a glitch and begins no absence.

    Which empty fetches are trusted depends on threads cancelled before them. Rounds start from the threads' own ends alone, which trusts the fewest; every
    round can only cancel earlier and trust more, and each settles at least the first fetch still open, so the rounds end at the fold's own answer.
    """
    f = checkpointed(manifests.select(F.unix_micros("fetch_at").alias("f"), "n_ids").groupBy("f").agg(F.max("n_ids").alias("n_ids")))
    t = checkpointed(threads.select("thread_id", "current_id", F.unix_micros("updated_at").alias("u"), F.unix_micros("expires").alias("x")))
    every, full, empty = f.select("f"), f.filter("n_ids > 0").select("f"), f.filter("n_ids = 0").select("f")
    ids = t.select("thread_id", "current_id", "x")
    marks = t.select("current_id", F.col("u").alias("s")).unionByName(seen.select(F.col("alert_id").alias("current_id"), F.unix_micros("fetch_at").alias("s"))).distinct()
    # each sighting with the next one: an absence lies between them
    runs = lag_columns(marks.withColumn("at", F.timestamp_micros(-F.col("s"))), ["current_id"], "at", "s", ["s"], DAY_US)
    runs = checkpointed(ids.join(runs.select("current_id", "s", F.col("prev_s").alias("next")), "current_id").withColumn("_p", F.col("s") + 1).drop("current_id", "s", "x"))
    ends = t.select("thread_id", "u", "x", F.lit(None).cast("long").alias("cancel_at"))
    trusted, n = _trusted_empty(empty, ends), -1
    for _ in range(MAX_ROUNDS):
        trusted = checkpointed(trusted)
        now = trusted.count()
        if now == n:
            break
        n = now
        missing = next_at_or_after(runs, "_p", full.unionByName(trusted), "missing_at").filter("missing_at IS NOT NULL AND (next IS NULL OR missing_at < next)")
        gone = next_at_or_after(missing.withColumn("_p", F.col("missing_at") + ABSENT_US), "_p", every, "gone_at").filter("gone_at IS NOT NULL AND (next IS NULL OR gone_at < next)")
        cancelled = gone.groupBy("thread_id").agg(F.min("gone_at").alias("cancel_at"))
        ends = checkpointed(t.join(cancelled, "thread_id", "left").select("thread_id", "u", "x", "cancel_at"))
        trusted = _trusted_empty(empty, ends)
    else:
        raise RuntimeError("threads did not settle")
    done = next_at_or_after(ends.withColumn("_p", F.col("x")), "_p", every, "expire_at")
    expired = F.col("expire_at").isNotNull() & (F.col("cancel_at").isNull() | (F.col("expire_at") <= F.col("cancel_at")))
    return done.select("thread_id", F.when(expired, "expired").when(F.col("cancel_at").isNotNull(), "cancelled").alias("reason"), F.least("expire_at", "cancel_at").alias("ended_us"))


def _trusted_empty(empty: DataFrame, t: DataFrame) -> DataFrame:
    """Empty fetches with fewer than three threads in force, neither past their end nor cancelled before: starts minus ends so far, summed within the hour, over the
    hours of the day, and over days."""
    over = F.least("x", F.col("cancel_at") + 1)
    steps = t.select(F.col("u").alias("at"), F.lit(1).alias("d")).unionByName(t.select(F.greatest(over, "u").alias("at"), F.lit(-1).alias("d")).filter("at IS NOT NULL"))
    steps = steps.groupBy("at").agg(F.sum("d").alias("d"))
    axis = steps.select("at", "d", F.lit(0).alias("is_fetch")).unionByName(empty.select(F.col("f").alias("at"), F.lit(0).cast("long").alias("d"), F.lit(1).alias("is_fetch")))
    axis = axis.withColumns({"_h": F.floor(F.col("at") / HOUR_US), "_d": F.floor(F.col("at") / DAY_US)})
    hours = axis.groupBy("_d", "_h").agg(F.sum("d").alias("n"))
    so_far = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    days = hours.groupBy("_d").agg(F.sum("n").alias("n")).select("_d", so_far(W.orderBy("_d")).alias("_days"))  # one row per day
    hours = hours.withColumn("_hours", so_far(W.partitionBy("_d").orderBy("_h"))).join(days, "_d").select("_h", (F.col("_hours") + F.col("_days")).alias("_before"))
    force = F.col("_before") + F.sum("d").over(W.partitionBy("_h").orderBy("at", "is_fetch"))
    return axis.join(hours, "_h").withColumn("in_force", force).filter((F.col("is_fetch") == 1) & (F.col("in_force") < SUSPECT_EMPTY)).select(F.col("at").alias("f"))


def next_at_or_after(rows: DataFrame, at: str, ticks: DataFrame, name: str) -> DataFrame:
    """Add the first tick ``f`` at or after each row's ``at`` (microseconds) as ``name``, NULL when none; ``at`` is dropped.

    Ticks and rows are put in one order inside each hour; past the hour the first tick of the day's later hours counts, past the day that of the
    days after, each from a window over one summary row per hour or day.
    """
    own = F.struct(*[F.col(c) for c in rows.columns])
    kind = rows.select(own.alias("r")).schema["r"].dataType
    both = rows.select(own.alias("r"), F.col(at).alias("_at")).unionByName(ticks.select(F.lit(None).cast(kind).alias("r"), F.col("f").alias("_at")))
    f = F.when(F.col("r").isNull(), F.col("_at"))
    both = both.withColumns({"_h": F.floor(F.col("_at") / HOUR_US), "_d": F.floor(F.col("_at") / DAY_US)})
    later = lambda w: F.first("_first", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    hours = both.groupBy("_d", "_h").agg(F.min(f).alias("_first"))
    days = hours.groupBy("_d").agg(F.min("_first").alias("_first")).select("_d", later(W.orderBy("_d")).alias("_days"))
    hours = hours.withColumn("_today", later(W.partitionBy("_d").orderBy("_h"))).join(days, "_d").select("_h", "_today", "_days")
    on = W.partitionBy("_h").orderBy("_at", F.col("r").isNull()).rowsBetween(0, W.unboundedFollowing)
    found = both.withColumn("_now", F.first(f, ignorenulls=True).over(on)).filter("r IS NOT NULL").join(hours, "_h", "left")
    return found.select("r.*", F.coalesce("_now", "_today", "_days").alias(name)).drop(at)


def impact_rises(versions: DataFrame) -> DataFrame:
    """Per message and tag, what rose since the thread's previous message.

    ``versions`` (thread_id, alert_id, sent, tag, level, value): enumerated tags compare ``level`` (order in the pack's
    list, -1 unknown), numeric ones ``value``. A tag absent before counts as risen.
    """
    out = lag_columns(versions.withColumn("_seen", F.lit(True)), ["thread_id", "tag"], "sent", "alert_id", ["level", "value", "_seen"], 86400 * 10**6)
    rose = F.when(F.col("level").isNotNull(), F.col("prev_level").isNull() | (F.col("level") > F.col("prev_level"))).otherwise(
        F.col("prev_value").isNull() | (F.col("value") > F.col("prev_value")))
    return out.filter(F.coalesce(rose, F.lit(False))).drop("_seen", "prev__seen")


def severity_rises(messages: DataFrame) -> DataFrame:
    """G4's first line: a new event name of at least the old rank, else a higher rank, against the previous message."""
    out = lag_columns(messages, ["thread_id"], "sent", "alert_id", ["event", "severity"], 86400 * 10**6)
    renamed = F.col("prev_event").isNotNull() & (F.col("event") != F.col("prev_event")) & (F.col("severity") >= F.col("prev_severity"))
    change = F.when(renamed, "event").when(F.col("severity") > F.col("prev_severity"), "severity")
    return out.withColumn("change", change).filter(F.col("change").isNotNull())


def first_per_group(alerts: DataFrame, counties: DataFrame, now: Column) -> DataFrame:
    """U4: active alerts, one per group with the counties it covers."""
    a = alerts.filter(F.col("expires").isNull() | (F.col("expires") > now)).join(counties.select("county_id", "name"), "county_id", "left")
    g = a.groupBy("group_key").agg(F.max_by(F.struct("alert_id", "severity", "sent"), F.struct("severity", "sent", "alert_id")).alias("a"),
                                   F.sort_array(F.collect_list("name")).alias("counties"))
    return g.select("group_key", "a.*", "counties")


def card_changes(versions: DataFrame, thread: str, at: str, row_id: str, text: str) -> DataFrame:
    """Versions whose text differs from the thread's previous one (the first always counts)."""
    out = lag_columns(versions.withColumn("_h", F.xxhash64(text)), [thread], at, row_id, ["_h"], 86400 * 10**6)
    return out.filter(F.col("prev__h").isNull() | (F.col("prev__h") != F.col("_h"))).drop("_h", "prev__h")
