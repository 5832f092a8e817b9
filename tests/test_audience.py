"""Audiences on small made tables: against plain rules, and how often a rule is worked out."""

import datetime as dt
import re

from pyspark.sql import functions as F

from gossamer.functions import geo
from gossamer.operators import audience as AU

T0 = dt.datetime(2026, 5, 1, 12, 0, tzinfo=dt.timezone.utc)
RING = [[[-91.5, 37.0], [-90.5, 37.0], [-90.5, 38.0], [-91.5, 38.0]]]


def test_alert_audience_by_class(spark):
    alerts = spark.createDataFrame([(i, [None, "1", "2"][i % 3], 1 + i % 4) for i in range(60)], "alert_id long, county_id string, severity long")
    routing = [(4, "warnings", 1), (4, "alerts", 2), (3, "alerts", 3), (1, "digest", 9)]
    zips = [("60001", "1"), ("60002", "2"), ("60003", "2")]
    areas = ["st", "st.1", "st.2", "st.zip.60001", "st.zip.60002", "st.zip.60003", "st.zip.69999"]
    subs = [(k % 50, ["warnings", "alerts", "digest"][k % 3], areas[k % 7]) for k in range(300)]
    banned = {k for k in range(50) if k % 9 == 0}
    got = AU.alert_audience(alerts, spark.createDataFrame(routing, "severity long, category string, priority int"), spark.createDataFrame(zips, "zip5 string, county_id string"),
                            spark.createDataFrame(subs, "chat_id long, category string, area string"), spark.createDataFrame([(k, "banned" if k in banned else "active") for k in range(50)], "chat_id long, status string"))
    want = {}
    for a in alerts.collect():
        for s, c, p in routing:
            for chat, cat, area in subs:
                here = area == "st" or (a["county_id"] and area == f"st.{a['county_id']}") or (area[7:], a["county_id"]) in zips
                if s == a["severity"] and c == cat and here and chat not in banned:
                    want[a["alert_id"], chat] = min(p, want.get((a["alert_id"], chat), 99))
    rows = got.collect()
    assert {(r["alert_id"], r["chat_id"]): r["priority"] for r in rows} == want and len(rows) == len(want)
    # pairs are unfolded last: nothing is grouped or met after it
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Generate explode(_chats")]
    assert not re.search(r"Aggregate|Join|Repartition", above)


def test_subscribers_by_areas(spark):
    areas = ["st", "st.1", "st.2", "st.zip.60001", "st.zip.60002", None]
    targets = [(None if i == 39 else i % 30, ["events", "alerts", None][i % 3], [["st", f"st.{i % 3}"], ["st", None, "st.2"], None][i % 4 % 3], [["60001"], [], None, ["60001", "60002"]][i % 4]) for i in range(45)]
    subs = [(None if k % 31 == 0 else k % 50, ["events", "alerts", "digest", None][k % 4], areas[k % 6]) for k in range(300)]
    banned = {k for k in range(50) if k % 9 == 0}
    got = AU.subscribers_for(spark.createDataFrame(targets, "target_id long, category string, area_keys array<string>, zips array<string>"), spark.createDataFrame(subs, "chat_id long, category string, area string"),
                             spark.createDataFrame([(k, "banned" if k in banned else "active") for k in range(50)], "chat_id long, status string"))
    want = {(t, c, chat) for t, c, keys, zips in targets for chat, cat, area in subs if c and c == cat and area and chat not in banned
            and (area in (keys or []) or (area.startswith("st.zip.") and area[7:] in (zips or [])))}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) > 100
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate|Join|Repartition", plan[:plan.index("Generate explode(_chats")])


def test_outlooks_of_one_shape_meet_points_once(spark):
    """A point meets each shape once, however many outlooks have it, and gets the highest level."""
    from gossamer.operators import ahead as H

    square = lambda d: [[-90.0 + x * d, 40.0 + y * d] for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    looks = [("storms", 1 + i % 2, i % 5 or None, T0 - dt.timedelta(hours=i % 3), T0 + dt.timedelta(hours=1), [[square(1.2), square(0.3)] if i % 4 else [square(0.1)]]) for i in range(400)]
    looks = spark.createDataFrame(looks, "name string, day int, level int, valid_from timestamp, valid_to timestamp, polygons array<array<array<array<double>>>>")
    points = spark.createDataFrame([(i, 39.0 + i * 0.05, -90.013) for i in range(40)], "p long, lat double, lon double")
    got = H.outlook_over_point(points, "p", looks, F.lit(T0).cast("timestamp"))
    hit = points.join(H.covering(looks, F.lit(T0).cast("timestamp"))).filter(geo.point_in_polygon_with_holes("lat", "lon", "polygons"))
    want = sorted(map(tuple, hit.groupBy("p", "name").agg(F.max("level")).collect()))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[name#\d+, polygons#\d+\]", plan)


def crowd(spark):
    alerts = [(i, "7", RING, float(i % 2 * 90 + 180), 30.0 if i < 40 else 3.0, [[36.5, -91.0], [36.6, -90.7]], T0 + dt.timedelta(minutes=i)) for i in range(80)]
    alerts = spark.createDataFrame(alerts, "alert_id long, county_id string, polygon array<array<array<double>>>, from_deg double, speed_kt double, points array<array<double>>, sent timestamp")
    alerts = alerts.withColumn("expires", F.col("sent") + F.expr("INTERVAL 6 HOURS")).withColumn("motion_at", F.when(F.col("alert_id") != 3, F.col("sent")))
    places = [(37.5, -91.0), (37.1, -90.8), (38.6, -91.0), (None, None)]
    people = spark.createDataFrame([("7", k, *places[k % 4]) for k in range(100)] + [("8", 500, 37.5, -91.0)], "county_id string, chat_id long, lat double, lon double")
    return alerts, people


def test_audience_places_once_each(spark):
    alerts, people = crowd(spark)
    met = AU.audience_places(alerts, people)
    assert met.count() == 4 * 4  # distinct motions times distinct places, of 8,000 pairs
    got = AU.unfolded(met, "inside", "km_outside", "side", "hours", alert=("motion_at",)).withColumn("arrives", AU.arrival_us(F.col("motion_at"), F.col("hours")))
    gap = geo.polygon_gap("lat", "lon", "polygon")
    hours = geo.storm_arrival_hours("from_deg", "speed_kt", "points", "lat", "lon")
    pairs = alerts.join(people, "county_id").withColumn("inside", geo.point_in_polygon("lat", "lon", "polygon"))
    want = pairs.select("alert_id", "chat_id", "inside", F.when(~F.col("inside"), gap["km"]).alias("km_outside"), F.when(~F.col("inside"), geo.compass(gap["bearing"])).alias("side"), hours.alias("hours"),
                        (F.unix_micros("motion_at") + (hours * 3600e6).cast("long")).alias("arrives"))
    cols = want.columns
    want = sorted(map(repr, want.collect()))
    assert sorted(map(repr, got.select(*cols).collect())) == want and len(want) == 8000
    assert got.filter("hours IS NOT NULL").count() > 0


def test_question_eligible_asks_inside_only(spark):
    alerts, people = crowd(spark)
    asked = spark.createDataFrame([(0, T0), (4, T0 - dt.timedelta(hours=9))], "chat_id long, asked_at timestamp")
    got = AU.question_eligible(alerts, people, asked, F.lit(T0)).collect()
    chats = {k for k in range(100) if k % 4 in (0, 1)} - {0}
    assert {(r["alert_id"], r["chat_id"]) for r in got} == {(a, c) for a in range(80) for c in chats} and len(got) == 80 * len(chats)


def test_in_or_near_judges_places_once(spark):
    from gossamer.operators.filters import in_or_near

    pts = spark.createDataFrame([(k, *[(0.5, 0.5), (0.5, 1.05), (3.0, 3.0), (None, 0.5)][k % 4]) for k in range(80)], "id long, lat double, lon double")
    ring = F.array(F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]))
    for km, of in ((0.0, {0}), (10.0, {0, 1})):
        got = in_or_near(pts, ring, km)
        assert got.columns == pts.columns and sorted(r["id"] for r in got.collect()) == [k for k in range(80) if k % 4 in of]
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Join LeftSemi" in plan and plan.index("exists(") < plan.index("Aggregate [lat")
