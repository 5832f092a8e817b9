"""Threshold crossings grouped into county events, scored, and decided on for a push."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.functions import scalars as X
from gossamer.operators.filters import crossings
from gossamer.plans.bucketed import bucket_of, sessions

IDLE_US = 6 * 3600 * 10**6
MIN_GAP_US = 3 * 3600 * 10**6
ESCALATION = 1.4


def gap_us() -> Column:
    """Longest silence inside an event: max(3 h, twice the metric's window), never past the idle close of 6 h."""
    two = F.col("window_min") * F.lit(2 * 60 * 10**6).cast("long")
    return F.least(F.greatest(F.lit(MIN_GAP_US).cast("long"), two), F.lit(IDLE_US).cast("long"))


KEYS = ["topic", "metric", "_county"]


def event_members(signals: DataFrame, dim_metric: DataFrame) -> DataFrame:
    """G1: every crossing with the event it belongs to. NULL counties group together."""
    vocab = F.broadcast(dim_metric.select("metric", "window_min", "thresholds", "direction", "scored"))
    c = crossings(signals.join(vocab, "metric").filter("scored")).withColumn("_county", F.coalesce("county_id", F.lit("")))
    marks = sessions(c, KEYS, "observed_at", gap_us())
    m = c.withColumn("_b", bucket_of("observed_at", gap_us())).join(marks.select(*KEYS, "_b", "session_at"), [*KEYS, "_b"])
    event_id = F.concat_ws("|", "metric", "_county", F.col("session_at").cast("string"))
    return m.withColumn("event_id", event_id).drop("_b", "_county", "thresholds", "window_min", "scored")


def events(members: DataFrame, now: Column) -> DataFrame:
    """One row per event; idle for six hours (event time) means closed."""
    e = members.groupBy("event_id", "topic", "metric", "county_id", "direction").agg(
        F.min("observed_at").alias("opened_at"), F.max("observed_at").alias("updated_at"), F.count(F.lit(1)).alias("n_signals"),
        F.max("value").alias("max_value"), F.min("value").alias("min_value"), F.max("severity").alias("severity"),
        F.min_by(F.struct("lat", "lon"), "seq").alias("_p"))
    idle = F.unix_micros(now) - F.unix_micros("updated_at") > F.lit(IDLE_US)
    peak = F.when(F.col("direction") == "below", F.col("min_value")).otherwise(F.col("max_value"))
    return e.select("event_id", "topic", "metric", "county_id", "opened_at", "updated_at", "n_signals", peak.alias("peak"), "severity",
                    F.when(idle, "closed").otherwise("open").alias("status"), "_p.lat", "_p.lon")


def per_sensor(members: DataFrame) -> DataFrame:
    """Members combined per (event, sensor) before anything else looks at them: a busy sensor becomes one row."""
    ref = F.col("reference") if "reference" in members.columns else F.lit("none")
    return members.groupBy("event_id", "topic", "metric", "direction", "sensor_id", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("hi_value"), F.min("value").alias("lo_value"), F.max("severity").alias("severity"),
        F.min("seq").alias("first_seq"), F.max(F.struct(F.col("seq"), ref.alias("reference"))).alias("last"),
        F.min_by(F.struct("lat", "lon", "precision"), "seq").alias("spot"))


def sensor_trust(rows: DataFrame, trust: DataFrame) -> DataFrame:
    """Trust each sensor brings to an event: its record on the topic, else its pooled record, else the prior.

    ``trust`` holds (sensor_id, topic, trust) with topic '*' for the pooled record.
    """
    own = trust.filter(F.col("topic") != "*").select("sensor_id", "topic", F.col("trust").alias("_own"))
    pooled = trust.filter(F.col("topic") == "*").select("sensor_id", F.col("trust").alias("_pooled"))
    out = rows.join(own, ["sensor_id", "topic"], "left").join(pooled, "sensor_id", "left")
    return out.withColumn("trust", F.coalesce("_own", "_pooled", F.lit(X.TRUST_PRIOR))).drop("_own", "_pooled")


def event_stats(sensor_rows: DataFrame) -> DataFrame:
    """Rows, distinct sensors, reference rows and reference sensors, mean trust over rows, peak and least."""
    ref = X.is_reference()
    return sensor_rows.groupBy("event_id", "direction").agg(
        F.sum("n").alias("n_signals"), F.count(F.lit(1)).alias("n_sensors"), F.sum(F.when(ref, F.col("n")).otherwise(0)).alias("n_reference"),
        F.count_if(ref).alias("n_reference_sensors"), (F.sum(F.col("trust") * F.col("n")) / F.sum("n")).alias("mean_trust"),
        F.max("hi_value").alias("max_value"), F.min("lo_value").alias("min_value"), F.max("severity").alias("severity"),
        F.max("last")["reference"].alias("reference"))


def cover(spots: pd.DataFrame, km: float = X.SAME_PLACE_KM) -> int:
    """Greedy cover in arrival order: a spot within ``km`` of a counted one is the same witness.

    Looks only at the neighbouring cells of a hash grid, so its cost is linear and its memory is the counted spots.
    """
    import math

    step = km / 111.0
    grid: dict[tuple[int, int], list[tuple[float, float]]] = {}
    n = 0
    for lat, lon in zip(spots["lat"].to_numpy(), spots["lon"].to_numpy()):
        scale = max(0.02, math.cos(math.radians(min(89.0, abs(lat) + 0.01))))
        cy = math.floor(lat / step)
        reach = step / scale
        near = False
        for y in (cy - 1, cy, cy + 1):
            for x in range(math.floor((lon - reach) / step), math.floor((lon + reach) / step) + 1):
                for la, lo in grid.get((y, x), ()):
                    h = (math.sin(math.radians(la - lat) / 2) ** 2
                         + math.cos(math.radians(lat)) * math.cos(math.radians(la)) * math.sin(math.radians(lo - lon) / 2) ** 2)
                    if 2 * 6371.0088 * math.asin(math.sqrt(h)) < km:
                        near = True
                        break
                if near:
                    break
            if near:
                break
        if not near:
            grid.setdefault((cy, math.floor(lon / step)), []).append((lat, lon))
            n += 1
    return n


def witnesses(sensor_rows: DataFrame) -> DataFrame:
    """Independent witnesses per event.

    References and people known only by ZIP count one each. People at exact points are first reduced to distinct
    points (the same point is one witness) and split into blocks of touching 0.4 km cells, which cannot cover each
    other; only events with two points in one block need the ordered cover.
    """
    exact = ~X.is_reference() & (F.col("spot.precision") == "point") & F.col("spot.lat").isNotNull()
    plain = sensor_rows.filter(~F.coalesce(exact, F.lit(False))).groupBy("event_id").agg(F.count(F.lit(1)).cast("long").alias("n"))
    spots = sensor_rows.filter(exact).groupBy("event_id", F.col("spot.lat").alias("lat"), F.col("spot.lon").alias("lon")).agg(
        F.min("first_seq").alias("seq"))
    # a spot whose own and neighbouring cells hold no other spot is a witness by itself
    step = 2 * X.SAME_PLACE_KM / 111.0
    cells = spots.withColumn("_y", F.floor(F.col("lat") / step)).withColumn("_x", F.floor(F.col("lon") / step))
    reach = F.ceil(F.lit(1.0) / F.cos(F.radians(F.least(F.abs("lat") + 0.1, F.lit(89.0))))).cast("long")
    density = cells.groupBy("event_id", "_y", "_x").agg(F.count(F.lit(1)).alias("_c"))
    around = density.join(cells.select("event_id", "_y", "_x", reach.alias("_r")).distinct(), ["event_id", "_y", "_x"])
    around = (around.withColumn("_y", F.explode(F.sequence(F.col("_y") - 1, F.col("_y") + 1)))
              .withColumn("_x", F.explode(F.sequence(F.col("_x") - F.col("_r"), F.col("_x") + F.col("_r"))))
              .groupBy("event_id", "_y", "_x").agg(F.sum("_c").alias("_near")))
    marked = cells.join(around, ["event_id", "_y", "_x"])
    lone = marked.filter(F.col("_near") == 1).groupBy("event_id").agg(F.count(F.lit(1)).cast("long").alias("n"))

    crowded = marked.filter(F.col("_near") > 1).select("event_id", "lat", "lon", "seq")
    folded = crowded.groupBy("event_id").applyInArrow(_fold_arrow, "event_id string, n long")
    return plain.unionByName(lone).unionByName(folded).groupBy("event_id").agg(F.sum("n").alias("witnesses"))


def _fold_arrow(key, table):
    import pyarrow as pa

    pdf = table.select(["lat", "lon", "seq"]).to_pandas().sort_values("seq")
    return pa.table({"event_id": pa.array([key[0].as_py()], pa.string()), "n": pa.array([cover(pdf)], pa.int64())})


def scored_events(stats: DataFrame, witness_rows: DataFrame) -> DataFrame:
    """The event's score, with X32's verified flag (an agreeing reference verifies too)."""
    e = stats.join(witness_rows, "event_id", "left").withColumn("witnesses", F.greatest(F.lit(1), F.coalesce("witnesses", F.lit(1))))
    ok = X.verified("witnesses", "n_reference", "mean_trust") | (F.col("reference") == "agree")
    return e.withColumn("score", X.event_score("severity", "witnesses", "mean_trust", "n_reference", "reference")).withColumn("verified", ok)


def push_decisions(scores: DataFrame, min_score: float = 1.0) -> DataFrame:
    """(event_id, seq, score, reason). The first verified score of at least ``min_score`` pushes; later ones push
    again when at least 1.4 times the last pushed score.

    Each push is one aggregated min over candidates past the last pushed score; a score has a small upper bound, so a
    handful of rounds decide every event without ordering any event's rows.
    """
    from gossamer.session import checkpointed

    cand = checkpointed(scores.filter(F.col("verified") & (F.col("score") >= min_score)).select("event_id", "seq", "score"))
    cur = cand.groupBy("event_id").agg(F.min(F.struct("seq", "score")).alias("p")).select("event_id", "p.seq", "p.score")
    out = cur.withColumn("reason", F.lit("new"))
    while True:
        cur = checkpointed(cur)
        if cur.isEmpty():
            return out
        last = cur.select("event_id", F.col("seq").alias("_s"), F.col("score").alias("_p"))
        nxt = cand.join(last, "event_id").filter((F.col("seq") > F.col("_s")) & (F.col("score") >= F.col("_p") * ESCALATION))
        cur = nxt.groupBy("event_id").agg(F.min(F.struct("seq", "score")).alias("p")).select("event_id", "p.seq", "p.score")
        out = out.unionByName(cur.withColumn("reason", F.lit("escalated")))


def event_source(members: DataFrame) -> DataFrame:
    """The row that best stands for an event: authority, official, station, other; with a url first; newest."""
    order = F.when(F.col("kind") == "authority", 0).when(F.col("kind") == "official", 1).when(F.col("kind") == "station", 2).otherwise(3)
    rank = F.struct(order.alias("o"), F.col("url").isNull().alias("u"), (-F.unix_micros("observed_at")).alias("t"), (-F.col("seq")).alias("s"))
    return members.groupBy("event_id").agg(F.min_by(F.struct("seq", "sensor_id", "kind", "url"), rank).alias("b")).select("event_id", "b.*")


def close_emptied(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events that lost their last reading to a corrected message."""
    return before.select("event_id").distinct().join(after.select("event_id"), "event_id", "left_anti")


def score_path(members: DataFrame) -> DataFrame:
    """(event_id, seq, score, verified) after each member: severity so far, distinct sensors so far, references so far.

    Running values are prefix sums over time buckets: bucket totals first, rows inside a bucket after.
    """
    from pyspark.sql import Window as W

    first = members.groupBy("event_id", "sensor_id").agg(F.min("seq").alias("seq")).select("event_id", "seq", F.lit(1).alias("_new"))
    m = members.join(first, ["event_id", "seq"], "left").withColumn("_new", F.coalesce("_new", F.lit(0)))
    m = m.withColumn("_ref", F.when(X.is_reference(), 1).otherwise(0)).withColumn("_b", bucket_of("observed_at", 3600 * 10**6))
    tot = m.groupBy("event_id", "_b").agg(F.sum("_new").alias("n"), F.sum("_ref").alias("r"), F.max("severity").alias("s"))
    wb = W.partitionBy("event_id").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    tot = tot.select("event_id", "_b", F.coalesce(F.sum("n").over(wb), F.lit(0)).alias("_n0"), F.coalesce(F.sum("r").over(wb), F.lit(0)).alias("_r0"),
                     F.coalesce(F.max("s").over(wb), F.lit(0.0)).alias("_s0"))
    wi = W.partitionBy("event_id", "_b").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    out = m.join(tot, ["event_id", "_b"])
    n, r = F.col("_n0") + F.sum("_new").over(wi), F.col("_r0") + F.sum("_ref").over(wi)
    s = F.greatest(F.col("_s0"), F.max("severity").over(wi))
    out = out.withColumn("_n", n).withColumn("_r", r).withColumn("_s", s)
    score = F.col("_s") * (F.lit(1.0) + F.lit(0.5) * F.log1p((F.col("_n") - 1).cast("double"))) * F.when(F.col("_r") >= 1, 1.25).otherwise(1.0)
    return out.select("event_id", "seq", score.alias("score"), ((F.col("_n") >= 2) | (F.col("_r") >= 1)).alias("verified"))
