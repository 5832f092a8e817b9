"""Several micro-batches end where one batch over everything does."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gossamer.catalog.graph import storm_members
from gossamer.functions import scalars as X
from gossamer.operators import corroborate as C
from gossamer.operators import stories as ST
from gossamer.operators import threads as TH
from gossamer.sources import adapter as A
from gossamer.streaming import jobs as J


def parts(df, order, folder, n=3):
    """The rows in ``n`` files, in order of time."""
    rows = df.orderBy(order).collect()
    for i in range(n):
        chunk = rows[i * len(rows) // n:(i + 1) * len(rows) // n]
        df.sparkSession.createDataFrame(chunk, df.schema).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.mark.parametrize("order", ["observed_at", "backward", "mixed"])
def test_stories_over_batches(spark, sf, tmp_path, order):
    m = storm_members(spark, sf).withColumns({"backward": -F.unix_micros("observed_at"), "mixed": F.xxhash64("ref")})
    parts(m, order, tmp_path / "in")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in m.schema)
    got = J.stories(J.landed(spark, str(tmp_path / "in"), schema, files_per_batch=1).drop("backward", "mixed"), "stories-test")
    want = ST.stories_components(m).select("ref", "story_id")
    assert got.select("ref", "story_id").exceptAll(want).isEmpty() and got.count() == want.count()


def feed_fold(messages, fetches):
    """Plain fold over fetches: {thread: (reason, at)}."""
    live, over = {}, {}
    for at, n, listed in sorted(fetches, key=lambda x: x[0]):
        for u, t, x in [m for m in messages if m[0] <= at]:
            if t not in live and t not in over:
                live[t] = [u, x, None]
        force = sum(x > at for _, x, _ in live.values())
        for t, v in live.items():
            if (n or force < 3) and v[0] < at:
                v[2] = None if n and t in listed else at if v[2] is None else v[2]
        for t, (u, x, miss) in list(live.items()):
            if x <= at or miss is not None and at - miss >= 90:
                over[t] = ("expired" if x <= at else "cancelled", at)
                del live[t]
    return over


@pytest.mark.parametrize("seed", [1, 2])
def test_threads_end_alike_in_batch_and_stream(spark, tmp_path, seed):
    """The fold, the fixed point over all fetches, and the stream over three files in two orders."""
    rnd = random.Random(seed)
    at = lambda s: dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    messages = [(rnd.randrange(0, 3000), t, 0) for t in range(40)]
    messages = [(u, t, u + rnd.randrange(60, 2500)) for u, t, _ in messages]
    fetches = []
    for s in range(15, 4000, 30):
        n = 0 if rnd.random() < 0.4 else 5
        fetches.append((s, n, {t for u, t, x in messages if u <= s and rnd.random() < 0.6} if n else set()))
    want = feed_fold(messages, fetches)
    th = spark.createDataFrame([(t, t, at(u), at(x)) for u, t, x in messages], "thread_id long, current_id long, updated_at timestamp, expires timestamp")
    fe = spark.createDataFrame([(at(s), n) for s, n, _ in fetches], "fetch_at timestamp, n_ids long")
    se = spark.createDataFrame([(at(s), t) for s, _, ls in fetches for t in ls], "fetch_at timestamp, alert_id long")
    us = lambda s: int(at(s).timestamp() * 10**6)
    got = {r["thread_id"]: (r["reason"], r["ended_us"]) for r in TH.thread_lifecycle(th, fe, se).collect() if r["reason"]}
    assert got == {t: (why, us(s)) for t, (why, s) in want.items()} and {w for w, _ in got.values()} == {"expired", "cancelled"}
    feed = F.lit("x").alias("feed")
    e = J.thread_events(th.select(feed, F.col("updated_at").alias("at"), "thread_id", "expires"), se.select(feed, F.col("fetch_at").alias("at"), F.col("alert_id").alias("thread_id")), fe.select(feed, F.col("fetch_at").alias("at"), "n_ids"))
    for order in ("at", "mixed"):
        parts(e.withColumn("mixed", F.xxhash64("at", "kind", "thread_id")), order, tmp_path / order)
        out = J.threads(J.landed(spark, str(tmp_path / order), J.THREAD_EVENT, files_per_batch=1), "3 hours" if order == "mixed" else "10 minutes")
        ended = {r["thread_id"]: (r["reason"], r["ended_us"]) for r in J.run_to_files(out, "threads-test").collect()}
        mark = us(3975) - (10800 if order == "mixed" else 600) * 10**6
        assert ended == {t: v for t, v in got.items() if v[1] < mark}


def test_a_cancelled_thread_makes_an_empty_fetch_trusted(spark):
    """Three threads, one of them gone before the empty fetch: judged by their own ends alone, all three would be in force and the fetch a glitch."""
    at = lambda s: dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    th = spark.createDataFrame([(t, t, at(0), at(99999)) for t in (1, 2, 3)], "thread_id long, current_id long, updated_at timestamp, expires timestamp")
    fe = spark.createDataFrame([(at(s), n) for s, n in ((30, 2), (60, 2), (120, 2), (150, 2), (200, 0), (300, 0))], "fetch_at timestamp, n_ids long")
    se = spark.createDataFrame([(at(s), t) for s in (30, 60, 120, 150) for t in (1, 2)], "fetch_at timestamp, alert_id long")
    got = {r["thread_id"]: (r["reason"], r["ended_us"]) for r in TH.thread_lifecycle(th, fe, se).collect()}
    us = lambda s: int(at(s).timestamp() * 10**6)
    assert got == {3: ("cancelled", us(120)), 1: ("cancelled", us(300)), 2: ("cancelled", us(300))}


def test_verdicts_over_batches(spark, sf, tmp_path):
    """The chain of stateful steps over three files against the batch rule, past the watermark."""
    s = A.signals(spark, sf).select("seq", "sensor_id", "kind", "metric", "topic", "value", "observed_at", "lat", "lon", "period", "precision")
    parts(s, "observed_at", tmp_path / "in")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.schema)
    read = lambda: J.landed(spark, str(tmp_path / "in"), schema, files_per_batch=1).drop("topic", "precision")
    dm = A.dim_metric(spark)
    out = J.run_to_files(J.judged(read(), read(), dm.drop("topic")), "verdicts-test")
    newest = s.agg(F.max(F.unix_micros("observed_at"))).first()[0]
    passed = (F.unix_micros("observed_at") < newest - 10 * 3600 * 10**6) & X.is_people()
    cols = ["seq", "n_corr", "n_contra", "reference", "quality"]
    want = C.arrival_quality(s, dm, C.judged_neighbors(s, dm)).filter(passed).select(*cols)
    got = out.filter(passed).select(*cols)
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() > 0


def test_fan_out_once_over_batches(spark, tmp_path):
    t = spark.createDataFrame([("e1", "events", ["st"], []), ("e2", "events", ["st"], []), ("e1", "events", ["st.1"], [])], "target_id string, category string, area_keys array<string>, zips array<string>")
    for row in t.collect():
        spark.createDataFrame([row], t.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    subs = spark.createDataFrame([(1, "events", "st"), (1, "events", "st.1"), (2, "events", "st.1")], "chat_id long, category string, area string")
    sen = spark.createDataFrame([(9, "banned")], "chat_id long, status string")
    schema = "target_id string, category string, area_keys array<string>, zips array<string>"
    got = J.notify(J.landed(spark, str(tmp_path / "in"), schema, files_per_batch=1), subs, sen, "notify-test")
    assert sorted((r["key"], r["chat_id"]) for r in got.collect()) == [("e1", 1), ("e1", 2), ("e2", 1)]


def test_trust_over_batches(spark, sf, tmp_path):
    s = A.assessed(spark, sf).filter("kind = 'human'").select("sensor_id", "topic", F.col("observed_at").alias("at"), F.when(F.col("quality") == "corroborated", 1.0).otherwise(0.0).alias("agree"), F.lit(0.5).alias("disagree"))
    parts(s, "at", tmp_path / "in")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.schema)
    rec = J.trust(J.landed(spark, str(tmp_path / "in"), schema, files_per_batch=1), "trust-test")
    now = F.lit(s.agg(F.max("at")).first()[0])
    got = J.trust_at(rec, now).select("sensor_id", "topic", F.round("agree", 6).alias("a"), "checks")
    fade = F.pow(F.lit(0.5), (F.unix_micros(now) - F.unix_micros("at")) / F.lit(180 * 86400e6))
    want = s.groupBy("sensor_id", "topic").agg(F.round(F.sum(F.col("agree") * fade), 6).alias("a"), F.count(F.lit(1)).alias("checks"))
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_stream_joins_meet_within_time_buckets(spark):
    """A key of the join holds one time bucket, and no pair across a bucket's border is lost."""
    import datetime as dt

    from pyspark.sql import functions as F

    from gossamer.functions.geo import haversine_km
    from gossamer.sources import adapter as A
    from gossamer.streaming import jobs as J

    t0 = dt.datetime(2026, 5, 1, tzinfo=dt.timezone.utc)
    rows = [(i, i % 17, ["human", "station", "bot"][i % 3], ["click", "purchase"][i % 2], float(i * 7 % 90), t0 + dt.timedelta(minutes=20 * i), 38.0 + i % 5 * 0.2, -91.0 + i % 4 * 0.3, "1h") for i in range(240)]
    r = spark.createDataFrame(rows, "seq long, sensor_id long, kind string, metric string, value double, observed_at timestamp, lat double, lon double, period string")
    dm = A.dim_metric(spark).drop("topic")
    got = J.corroborate(r.drop("period").filter("kind <> 'station'"), r.drop("period"), dm)
    a, b = r.alias("a"), r.alias("b")
    want = a.join(b, (F.col("a.metric") == F.col("b.metric")) & (F.col("a.sensor_id") != F.col("b.sensor_id")) & (F.abs(F.unix_micros("a.observed_at") - F.unix_micros("b.observed_at")) <= 180 * 60 * 10**6)
                  & (haversine_km("a.lat", "a.lon", "b.lat", "b.lon") <= 60)).filter("a.kind <> 'station'").select("a.seq", F.col("b.seq").alias("o_seq"), "a.metric")
    want = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200
    for df in (got, J.judged(r, r, dm)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        join = next(x for x in plan.split("\n") if " Join " in f" {x.strip('+-: ')} " and "haversine" not in x and "_cy" in x)
        assert "_tb" in join
