"""Plans against brute force, and order-free results."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from gossamer.functions.geo import haversine_km
from gossamer.operators import rollups as R
from gossamer.operators import threads as TH
from gossamer.plans import bucketed as B
from gossamer.plans.components import components, resolve_pointers
from gossamer.plans.spacetime import within

T0 = dt.datetime(2026, 5, 1, tzinfo=dt.timezone.utc)


@pytest.mark.parametrize("radius,minutes,grain", [(15.0, 60, 2.0), (60.0, 180, 2.0), (120.0, 30, 1.0), (200.0, 600, 3.0)])
def test_range_join_equals_brute_force(spark, radius, minutes, grain):
    rnd = random.Random(int(radius))
    rows = [(i, 36 + rnd.random() * 8, -93 + rnd.random() * 8, T0 + dt.timedelta(seconds=rnd.randrange(86400))) for i in range(400)]
    a = spark.createDataFrame(rows, "id long, lat double, lon double, observed_at timestamp").withColumn("k", F.lit(1)).withColumn("r", F.lit(radius)).withColumn("w", F.lit(minutes * 60 * 10**6).cast("long"))
    b = a.select("k", "r", "w", *[F.col(c).alias(f"o_{c}") for c in ("id", "lat", "lon", "observed_at")])
    got = within(a, b, ["k"], "r", "w", "w", extra=F.col("id") != F.col("o_id"), grain=grain).select("id", "o_id")
    assert got.count() == got.distinct().count()
    brute = a.drop("r", "w").join(b, "k").filter((F.col("id") != F.col("o_id")) & (haversine_km("lat", "lon", "o_lat", "o_lon") <= radius)
                                                 & (F.abs(F.unix_micros("observed_at") - F.unix_micros("o_observed_at")) <= minutes * 60 * 10**6)).select("id", "o_id")
    assert got.exceptAll(brute).isEmpty() and brute.exceptAll(got).isEmpty()


def test_sessions_inclusive_gap_and_order_free(spark):
    rnd = random.Random(1)
    times, t = [], 0
    for _ in range(300):
        t += rnd.choice([1, 30, 59, 60, 61, 200])
        times.append(t)
    want, start, last = {}, None, None
    for x in times:
        if last is None or x - last > 60:
            start = x
        want[x], last = start, x
    shuffled = times[:]
    rnd.shuffle(shuffled)
    df = spark.createDataFrame([("k", x, T0 + dt.timedelta(seconds=x)) for x in shuffled], "k string, x long, at timestamp")
    marks = B.sessions(df, ["k"], "at", 60 * 10**6)
    got = df.withColumn("_b", B.bucket_of("at", 60 * 10**6)).join(marks, ["k", "_b"])
    base = int(T0.timestamp() * 10**6)
    assert {r["x"]: (r["session_at"] - base) // 10**6 for r in got.collect()} == want


def test_bucketed_ordered_helpers(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), i, T0 + dt.timedelta(minutes=rnd.randrange(5000)), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, id long, at timestamp, v long")
    by = {k: sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])) for k in "ab"}
    lag = {r["id"]: r["prev_v"] for r in B.lag_columns(df, ["k"], "at", "id", ["v"], 3600 * 10**6).collect()}
    cnt = {r["id"]: r["n"] for r in B.running_count(df, ["k"], "at", ["at", "id"], 3600 * 10**6, "n").collect()}
    near = {r["id"]: r["prev_v"] for r in B.previous_within(df, ["k"], "at", "id", 600 * 10**6, ["v"]).collect()}
    trail = {r["id"]: r["n"] for r in B.trailing_count(df, ["k"], "at", 600 * 10**6, "n").collect()}
    for rs in by.values():
        for i, r in enumerate(rs):
            prev = rs[i - 1] if i else None
            assert lag[r[1]] == (prev[3] if prev else None) and cnt[r[1]] == i
            close = prev is not None and (r[2] - prev[2]) <= dt.timedelta(minutes=10)
            assert near[r[1]] == (prev[3] if close else None)
            assert trail[r[1]] == sum(dt.timedelta(0) < r[2] - q[2] <= dt.timedelta(minutes=10) for q in rs)


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)]
    up = {}

    def root(n):
        while up.setdefault(n, n) != n:
            n = up[n]
        return n

    for u, v in edges:
        a, b = root(u), root(v)
        up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {n: root(n) for u, v in edges if u != v for n in (u, v)}
    named = {r["node"]: r["root"] for r in components(df.selectExpr("'urn:' || lpad(u, 4, '0') AS u", "'urn:' || lpad(v, 4, '0') AS v")).collect()}
    assert named == {f"urn:{n:04}": f"urn:{r:04}" for n, r in got.items()}
    assert components(df.limit(0)).count() == 0


def test_pointers(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (9, None)], "id long, up long")
    assert {r["node"]: r["root"] for r in resolve_pointers(links, "id", "up").collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9}


def test_nearest_rank(spark):
    rnd = random.Random(6)
    vals = [round(rnd.random() * 40, 1) for _ in range(333)]
    df = spark.createDataFrame([("a", v) for v in vals] + [("b", 7.0)], "k string, v double")
    got = {r["k"]: (r["p50"], r["p95"]) for r in R.nearest_rank(df, ["k"], "v", [0.5, 0.95]).collect()}
    s = sorted(vals)
    assert got == {"a": (s[round(0.5 * 332)], s[round(0.95 * 332)]), "b": (7.0, 7.0)}


def test_thread_lifecycle(spark):
    m = lambda x: T0 + dt.timedelta(seconds=x)
    threads = spark.createDataFrame([(1, 1, m(0), m(3600)), (2, 2, m(0), m(3600)), (3, 3, m(0), m(600)), (4, 4, m(0), m(99999))], "thread_id long, current_id long, updated_at timestamp, expires timestamp")
    fetch = [(m(30 * i), 2) for i in range(1, 60)] + [(m(45), 0)]
    seen = [(m(30 * i), a) for i in range(1, 60) for a in (1, 4) if a == 4 or i <= 10] + [(m(30 * i), 3) for i in range(1, 60)]
    got = {r["thread_id"]: (r["reason"], r["ended_us"]) for r in TH.thread_lifecycle(threads, spark.createDataFrame(fetch, "fetch_at timestamp, n_ids long"), spark.createDataFrame(seen, "fetch_at timestamp, alert_id long")).collect()}
    at = lambda x: int(m(x).timestamp() * 10**6)
    assert got[1] == ("cancelled", at(330 + 90)) and got[2] == ("cancelled", at(30 + 90)) and got[3] == ("expired", at(600)) and got[4] == (None, None)


def test_alert_support_with_and_without_end(spark):
    from gossamer.operators.corroborate import alert_support

    rnd = random.Random(12)
    at = lambda h: T0 + dt.timedelta(hours=h)
    alerts = [(i, rnd.choice("ab"), "wind", rnd.randrange(1, 5), at(s := rnd.randrange(0, 400)), None if i % 5 == 0 else at(s + rnd.choice([0, 1, 3, 6, 7, 50, 2000, 900000]))) for i in range(60)]
    readings = [(i, "human", "m", rnd.choice("abc"), at(rnd.randrange(0, 900))) for i in range(150)]
    want = {}
    for seq, _, _, county, t in readings:
        best = max(((sev, sent, i) for i, c, _, sev, sent, end in alerts if c == county and sent <= t and (end is None or end > t)), default=None)
        if best:
            want[seq] = (best[2], best[0])
    s = spark.createDataFrame(readings, "seq long, kind string, metric string, county_id string, observed_at timestamp")
    a = spark.createDataFrame(alerts, "alert_id long, county_id string, slug string, severity long, sent timestamp, expires timestamp")
    got = {r["seq"]: (r["alert_id"], r["severity"]) for r in alert_support(s, a, spark.createDataFrame([("m", "wind")], "metric string, slug string")).collect()}
    assert got == want


def test_alert_support_of_short_and_touching_alerts(spark):
    import random

    from gossamer.operators.corroborate import alert_support

    rnd = random.Random(5)
    at = lambda us: T0 + dt.timedelta(microseconds=us)
    top = 3 * 2**30
    alerts = [(i, rnd.choice(["a", None]) if i % 9 == 0 else "a", rnd.choice(["wind", "hail"]), rnd.randrange(1, 4), at(s := rnd.randrange(0, top)), at(s + rnd.choice([-5, 0, 1, 2, 63, 2**20, 2**30 - 1, 2**30, 2**31, 2**33]))) for i in range(80)]
    readings = [(i, "human", "m", "a", at(rnd.choice([rnd.randrange(0, top), int((alerts[i % 80][4 + i % 2] - T0).total_seconds() * 10**6)]))) for i in range(300)]
    want = {}
    for seq, _, _, county, t in readings:
        best = max(((sev, sent, i) for i, c, _, sev, sent, end in alerts if c == county and sent <= t < end), default=None)
        if best:
            want[seq] = (best[2], best[0])
    s = spark.createDataFrame(readings, "seq long, kind string, metric string, county_id string, observed_at timestamp")
    a = spark.createDataFrame(alerts, "alert_id long, county_id string, slug string, severity long, sent timestamp, expires timestamp")
    out = alert_support(s, a, spark.createDataFrame([("m", "wind"), ("m", "hail")], "metric string, slug string"))
    assert "Window" in out._jdf.queryExecution().optimizedPlan().toString()  # readings and alerts in one order, not in a join of each with all
    assert {r["seq"]: (r["alert_id"], r["severity"]) for r in out.collect()} == want and len(want) > 100


def test_closest_neighbours_without_a_shuffle_of_pairs(spark):
    import random

    from gossamer.functions.geo import haversine_km
    from gossamer.operators import corroborate as C
    from gossamer.sources import adapter as A

    rnd = random.Random(3)
    rows = [(i, rnd.randrange(12), "human", "purchase", "sales", rnd.choice([None, 5.0, 50.0, 250.0]), T0 + dt.timedelta(minutes=rnd.randrange(0, 900)), 40.0 + rnd.random() * 1.5, -89.0 + rnd.random() * 1.5,
             "point", rnd.choice([None, "1h"])) for i in range(250)]
    s = spark.createDataFrame(rows, "seq long, sensor_id long, kind string, metric string, topic string, value double, observed_at timestamp, lat double, lon double, precision string, period string")
    far = s.alias("a").join(s.alias("b"), F.expr("b.seq < a.seq AND a.sensor_id <> b.sensor_id AND a.period IS NOT DISTINCT FROM b.period"))
    far = far.select("a.seq", F.col("b.seq").alias("o"), haversine_km("a.lat", "a.lon", "b.lat", "b.lon").alias("km")).collect()
    want, best = {}, {}
    for r in far:
        a, b = rows[r["seq"]], rows[r["o"]]
        gap = (b[6] - a[6]).total_seconds()
        if r["km"] <= 60 and abs(gap) <= 180 * 60:
            best[a[0], b[1]] = min(best.get((a[0], b[1]), (1e9,)), (abs(gap), gap < 0, -b[0]))
    want = {k: -v[2] for k, v in best.items() if rows[k[0]][5] is not None and rows[-v[2]][5] is not None}
    j = C.judged_neighbors(s, A.dim_metric(spark))
    assert {(r["seq"], r["o_sensor_id"]): r["o_seq"] for r in j.collect()} == want and len(want) > 100
    plan = j._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 3  # two small vocabularies and the range join: nothing is joined to the pairs afterwards
    assert plan.index("Join Inner") < plan.index("Aggregate")  # and they are not grouped


def test_median(spark):
    for values in ([3.0], [1.0, 4.0], [5.0, 1.0, 9.5, 2.25], [7.5] * 3 + [0.1]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert R.median(df, "v").first()["median"] == statistics.median(values)
    assert R.median(df.limit(0), "v").first()["median"] is None


def test_settled_outcomes(spark):
    from gossamer.operators import corroborate as C

    arrival = spark.createDataFrame([(1, 7, "human", "t", "raw"), (2, 7, "human", "t", "raw"), (3, 8, "bot", "t", "raw"), (4, 7, "human", "t", "flagged"), (5, 9, "human", "t", "raw")], "seq long, sensor_id long, kind string, topic string, quality string")
    kind = "seq long, arrival struct<t: long, o: int, id: long>, verdict string, via string, agree double, disagree double"
    rows = [(1, (50, 0, 9), "corroborated", "reading", 0.3, 0.0), (1, (40, 3, 8), "corroborated", "total", 0.5, 0.0), (3, (1, 0, 9), "flagged", "reference", 0.0, 1.0), (4, (1, 0, 9), "corroborated", "alert", 1.0, 0.0), (5, (30, 0, 1), "corroborated", "alert", 1.0, 0.0)]
    first = C.first_evidence(spark.createDataFrame(rows, kind))
    doubts = spark.createDataFrame([(1, (45, 2, 1)), (2, (45, 2, 2)), (5, (20, 2, 5))], "seq long, arrival struct<t: long, o: int, id: long>")
    got = sorted((r["sensor_id"], r["agree"], r["disagree"]) for r in C.settled_outcomes(arrival, first, doubts).collect())
    assert got == [(7, 0.0, 0.5), (7, 0.5, 0.0), (9, 0.0, 0.5), (9, 1.0, 0.0)]
    assert {r["seq"]: (r["final_quality"], r["via"]) for r in C.final_quality(arrival, first).collect()} == {1: ("corroborated", "total"), 2: ("raw", None), 3: ("flagged", "reference"), 4: ("flagged", None), 5: ("corroborated", "alert")}


def test_message_tokens(spark):
    from gossamer.sources import messages as MS
    from gossamer.sources import vocab as V

    pack = {"topic": "web", "metrics": {"click": {"aliases": ["clicks", "page click"], "units": {"n": 1, "k": {"expr": "x*1000"}}, "default_unit": "n", "range": [0, 9000], "words": {"few": 5, "many": 100}}, "outage": {"kind": "flag", "aliases": ["outage"]}}}
    fr = V.frames(spark, [pack])
    vocab = {"aliases": [("click", "click", False), ("clicks", "click", False), ("page click", "click", False), ("outage", "outage", True)], "units": ["n", "k"], "words": ["few", "many"]}
    texts = ["clicks: 12n @gate #Web -- note; outage 5 min ago", "many clicks at the gate", "page click very few", "2k of clicks", "clicks", "7 clicks 8 clicks", "nothing here 5"]
    r = MS.extract_readings(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", vocab, fr["dim_metric"], fr["dim_unit"], fr["dim_word"])
    got = sorted(((x["id"], x["clause"], x["metric"], x["value"], x["minutes_ago"], x["place"], tuple(x["tags"]), x["note"], x["error"]) for x in r.collect()), key=str)
    assert got == [(0, 0, "click", 12.0, None, "gate", ("web",), "note", None), (0, 1, "outage", 1.0, 5.0, None, (), None, None), (1, 0, "click", 100.0, None, None, (), None, None), (2, 0, "click", 5.0, None, None, (), None, None),
                   (3, 0, "click", 2000.0, None, None, (), None, None), (4, 0, "click", None, None, None, (), None, "give a value"), (5, 0, "click", 8.0, None, None, (), None, None), (5, 0, "click", None, None, None, (), None, "give a value")]
