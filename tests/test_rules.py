"""Literal cases with known answers."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gossamer.functions import geo
from gossamer.functions import names as NM
from gossamer.functions import scalars as X
from gossamer.operators import audience as AU
from gossamer.operators import corroborate as C
from gossamer.operators import events as E
from gossamer.operators import grids as G
from gossamer.operators import notable as N
from gossamer.operators import stories as ST
from gossamer.sources import feeds as S
from gossamer.sources import vocab as V
from gossamer.sources.adapter import METRIC_SCHEMA

T0 = dt.datetime(2026, 5, 1, 12, 0, tzinfo=dt.timezone.utc)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_score(spark):
    cases = [((0.5, 1, 0.5, 0, "none"), 0.5), ((0.8, 2, 0.6, 0, "none"), round(0.8 * (1 + 0.5 * math.log(2)) * 1.2, 3)),
             ((1.0, 1, 0.95, 1, "none"), 2.375), ((1.0, 1, 0.5, 0, "disagree"), 0.7)]
    rows = spark.createDataFrame([(*c, w) for c, w in cases], "s double, n int, t double, r int, ref string, want double")
    for r in rows.withColumn("got", X.event_score("s", "n", "t", "r", "ref")).collect():
        assert r["got"] == pytest.approx(r["want"])


def test_trust_values(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.5, 0.5), (10.0, 0.0, 0.5, 12 / 14), (0.0, 10.0, 0.5, 2 / 14), (0.0, 2.0, 0.9, 0.6)], "a double, d double, p double, want double")
    for r in rows.withColumn("got", X.shrunk("a", "d", "p")).collect():
        assert r["got"] == pytest.approx(r["want"])


def test_half_life_and_sequential_fold(spark):
    old = T0 - dt.timedelta(days=180)
    rows = spark.createDataFrame([("p", "w", old, 1.0, 0.0)] * 4 + [("p", "w", T0, 0.0, 1.0)], "sensor_id string, topic string, at timestamp, agree double, disagree double")
    pri = spark.createDataFrame([("p", 0.5)], "sensor_id string, trust_prior double")
    r = C.trust_record(rows, pri, F.lit(T0)).first()
    assert r["agree"] == pytest.approx(2.0) and r["disagree"] == pytest.approx(1.0) and r["checks"] == 5
    # the record kept step by step, fading before each addition, ends the same
    a, last = 0.0, old
    for at, x in [(old, 1.0)] * 4 + [(T0, 0.0)]:
        a = a * 0.5 ** ((at - last).total_seconds() / 86400 / 180) + x
        last = at
    assert r["agree"] == pytest.approx(a)


def test_handle_and_compass_and_geohash(spark):
    r = one(spark, X.public_handle(F.lit("tg:1")).alias("h"), geo.compass(F.lit(22.5)).alias("a"), geo.compass(F.lit(100.0)).alias("b"), geo.compass(F.lit(350.0)).alias("c"),
            geo.geohash(F.lit(57.64911), F.lit(10.40744)).alias("g"))
    assert (r["h"], r["a"], r["b"], r["c"], r["g"]) == ("s-a48fc", "north", "east", "north", "u4pruyd")


@pytest.mark.parametrize("x,want", [(86.7, "86.7"), (1.75, "1.75"), (0.01, "0.01"), (1013.2, "1,013"), (277002.0, "277,000"), (10.05, "10.1"), (0.5, "0.5"), (99.96, "100"), (0.0, "0"), (-3.14159, "-3.14")])
def test_nice_number(spark, x, want):
    assert one(spark, X.nice_number(F.lit(x)).alias("v"))["v"] == want


@pytest.mark.parametrize("x,want", [(0.0625, "1/16"), (1.5, "1 1/2"), (0.0, "0"), (2.0, "2"), (10.0, "10"), (0.25, "1/4")])
def test_fraction(spark, x, want):
    assert one(spark, X.fraction(F.lit(x)).alias("v"))["v"] == want


def test_titles_and_names(spark):
    r = one(spark, X.title_key(F.lit("River rises fast in town - The Daily")).alias("a"), X.title_key(F.lit("Short - The Daily")).alias("b"),
            NM.site_name(F.lit("SALT CREEK AT 22ND STREET AT OAK BROOK, IL")).alias("c"), NM.report_place(F.lit("3 E GARDEN PLAIN")).alias("d"), NM.station_name(F.lit("CHICAGO/OHARE (ord)")).alias("e"),
            X.county_slug(F.lit("St. Clair County")).alias("f"))
    assert r["a"] == "river rises fast in town" and r["b"] == "short the daily"
    assert r["c"] == "Salt Creek at 22nd Street at Oak Brook" and r["d"] == "3 mi E of Garden Plain" and r["e"] == "Chicago Ohare (ORD)" and r["f"] == "stclair"


def test_polygon_and_storm(spark):
    ring = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((-90.0, 39.0), (-89.0, 39.0), (-89.0, 40.0), (-90.0, 40.0))])
    hole = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((-89.6, 39.4), (-89.4, 39.4), (-89.4, 39.6), (-89.6, 39.6))])
    pts = F.array(F.array(F.lit(39.5), F.lit(-90.0)))
    r = one(spark, geo.point_in_polygon(F.lit(39.5), F.lit(-89.5), F.array(ring)).alias("i"), geo.point_in_polygon(F.lit(41.0), F.lit(-89.5), F.array(ring)).alias("o"),
            geo.point_in_polygon_with_holes(F.lit(39.5), F.lit(-89.5), F.array(F.array(ring, hole))).alias("h"), geo.polygon_gap(F.lit(39.5), F.lit(-88.9), F.array(ring)).alias("g"),
            geo.storm_arrival_hours(F.lit(270.0), F.lit(40.0), pts, F.lit(39.5), F.lit(-89.5)).alias("t"), geo.storm_arrival_hours(F.lit(90.0), F.lit(40.0), pts, F.lit(39.5), F.lit(-89.5)).alias("away"))
    assert r["i"] and not r["o"] and not r["h"]
    assert r["g"]["km"] == pytest.approx(0.1 * 111.32 * math.cos(math.radians(39.5)), rel=1e-3) and r["g"]["bearing"] == pytest.approx(90, abs=1)
    assert r["t"] == pytest.approx(0.5 * 111.32 * math.cos(math.radians(39.5)) / (40 * 1.852), rel=1e-3) and r["away"] is None


@pytest.mark.parametrize("reading,grid,event,want", [(44, 38, True, "agree"), (64, 25, True, "disagree"), (114, 20, True, "far"), (44, 0, True, "disagree"), (6, 0, False, "quiet"), (44, None, True, "nodata")])
def test_grid_verdicts(spark, reading, grid, event, want):
    df = spark.createDataFrame([(float(reading), None if grid is None else float(grid))], "v double, g double")
    assert df.select(G.grid_verdict("v", "g", 13.0, 13.0, 0.6, 3.0, F.lit(event)).alias("x")).first()["x"] == want


HOT = [("temp", "weather", "Temp", 20.0, 60, 3.0, None, -45.0, 55.0, "above", False, False, True, [(40.0, 0.5)], None, None),
       ("rain", "weather", "Rain", 20.0, 60, 5.0, 0.5, 0.0, 500.0, "above", True, False, True, [(25.0, 0.5)], None, None)]


def readings(spark, rows):
    """(seq, sensor, kind, metric, value, minutes, lat, lon, period)"""
    data = [(i, s, k, m, "weather", float(v), T0 + dt.timedelta(minutes=t), la, lo, "point", p) for i, s, k, m, v, t, la, lo, p in rows]
    return spark.createDataFrame(data, "seq long, sensor_id string, kind string, metric string, topic string, value double, observed_at timestamp, lat double, lon double, precision string, period string")


def quality(spark, rows):
    s, m = readings(spark, rows), spark.createDataFrame(HOT, METRIC_SCHEMA)
    a = C.arrival_quality(s, m, C.judged_neighbors(s, m))
    ev = C.evidence_from_people(C.weighted(C.agreements(C.judged_neighbors(s, m)))).unionByName(C.evidence_from_references(s, m))
    return {r["seq"]: (r["quality"], r["final_quality"]) for r in C.final_quality(a, C.first_evidence(ev)).collect()}


def test_corroboration_both_ways(spark):
    q = quality(spark, [(1, "a", "human", "temp", 21.1, 0, 39.78, -89.65, None), (2, "b", "human", "temp", 21.7, 5, 39.80, -89.62, None), (3, "c", "human", "temp", 21.0, 5, 41.88, -87.63, None), (4, "d", "human", "temp", 21.0, 300, 39.78, -89.65, None)])
    assert q == {1: ("raw", "corroborated"), 2: ("corroborated", "corroborated"), 3: ("raw", "raw"), 4: ("raw", "raw")}


def test_two_contradictions_flag(spark):
    f = lambda x: (x - 32) * 5 / 9
    q = quality(spark, [(1, "a", "human", "temp", f(70), 0, 39.78, -89.65, None), (2, "b", "human", "temp", f(71), 2, 39.781, -89.651, None), (3, "c", "human", "temp", f(95), 4, 39.779, -89.65, None)])
    assert q[3][0] == "flagged"


def test_reference_settles_forward_and_period_gates(spark):
    q = quality(spark, [(1, "a", "human", "temp", 21.0, 0, 39.78, -89.65, None), (2, "s", "station", "temp", 20.5, 10, 39.80, -89.65, None),
                        (3, "b", "human", "rain", 30.0, 0, 39.78, -89.65, None), (4, "s", "station", "rain", 2.0, 10, 39.80, -89.65, "1h")])
    assert q[1] == ("raw", "corroborated") and q[2][0] == "reference" and q[3] == ("raw", "raw")


def test_independence(spark):
    base = dict(kind="human", o_kind="human", precision="point", o_precision="point")
    rows = spark.createDataFrame([("human", "human", "point", "point", 0.015, 0), ("human", "human", "point", "point", 4.0, 3), ("human", "station", "point", "point", 0.0, 9)],
                                 "kind string, o_kind string, precision string, o_precision string, km double, together int")
    assert [r["w"] for r in rows.select(C.independence(F.col("together")).alias("w")).collect()] == pytest.approx([0.3, 0.5, 1.0]) and base


def test_witnesses(spark):
    rows = [(1, "a", "human", 39.7800, -89.6500, "point"), (2, "b", "human", 39.7801, -89.6501, "point"), (3, "c", "human", 39.8500, -89.6000, "point"),
            (4, "d", "human", 39.7800, -89.6500, "zip5"), (5, "e", "human", 39.7800, -89.6500, "zip5"), (6, "f", "station", 39.7800, -89.6500, "point")]
    m = spark.createDataFrame([("ev", "t", "m", "above", i, s, k, 1.0, 1.0, la, lo, p) for i, s, k, la, lo, p in rows],
                              "event_id string, topic string, metric string, direction string, seq long, sensor_id string, kind string, value double, severity double, lat double, lon double, precision string")
    assert E.witnesses(E.per_sensor(m)).first()["witnesses"] == 2 + 2 + 1


def test_witnesses_equal_plain_greedy(spark):
    import random

    rnd = random.Random(5)
    pts = [(i, 39.78 + rnd.random() * 0.02, -89.65 + rnd.random() * 0.02) for i in range(300)]
    m = spark.createDataFrame([("ev", "t", "m", "above", i, f"s{i}", "human", 1.0, 1.0, la, lo, "point") for i, la, lo in pts],
                              "event_id string, topic string, metric string, direction string, seq long, sensor_id string, kind string, value double, severity double, lat double, lon double, precision string")
    kept = []
    for _, la, lo in pts:
        if all(ST._km(la, lo, a, b) >= 0.2 for a, b in kept):
            kept.append((la, lo))
    assert E.witnesses(E.per_sensor(m)).first()["witnesses"] == len(kept)


def stories(spark, rows):
    m = spark.createDataFrame([(i, "weather", la, lo, T0 + dt.timedelta(minutes=t), 0.5) for i, la, lo, t in rows], "ref long, topic string, lat double, lon double, observed_at timestamp, severity double")
    return {r["ref"]: r["story_id"] for r in ST.stories_replay(m).collect()}, {r["ref"]: r["story_id"] for r in ST.stories_components(m).collect()}


def test_stories(spark):
    for got in stories(spark, [(1, 39.78, -89.65, 0), (2, 39.95, -89.60, 20), (3, 41.88, -87.63, 25), (4, 39.78, -89.65, 20 + 301)]):
        assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    for got in stories(spark, [(1, 39.80, -90.40, 0), (2, 39.80, -89.65, 5), (3, 39.80, -90.02, 10)]):
        assert got == {1: 1, 2: 1, 3: 1}


def test_rise(spark):
    from gossamer.operators.ahead import rises

    rows = [("up", i, v) for i, v in enumerate([5.7, 6.1, 6.6, 7.1, 7.59])] + [("jump", i, v) for i, v in enumerate([7.7, 7.7, 7.8, 17.5, 17.4])]
    s = spark.createDataFrame([(k, T0 + dt.timedelta(hours=i), v, i) for k, i, v in rows], "site string, taken timestamp, stage double, seq int")
    got = {r["site"]: r["rise"] for r in rises(s, ["site"], 0.1).collect()}
    assert set(got) == {"up"} and got["up"] == pytest.approx(1.89)


def test_push_decisions(spark):
    rows = spark.createDataFrame([("e", 1, 0.9, True), ("e", 2, 1.0, False), ("e", 3, 1.1, True), ("e", 4, 1.5, True), ("e", 5, 1.6, True), ("e", 6, 2.1, True), ("e", 7, 2.25, True)], "event_id string, seq long, score double, verified boolean")
    got = sorted((r["seq"], r["reason"]) for r in E.push_decisions(rows).collect())
    assert got == [(3, "new"), (5, "escalated"), (7, "escalated")]


def test_pick_labels_equals_plain_passes(spark):
    import random

    rnd = random.Random(3)
    rows = [(i, f"t{rnd.randrange(6)}", f"m{rnd.randrange(9)}", rnd.choice(["max", "rise", "event"]), rnd.random() < 0.1, round(rnd.random(), 2), 39 + rnd.random() * 3, -90 + rnd.random() * 3) for i in range(400)]
    df = spark.createDataFrame(rows, "place long, topic string, metric string, kind string, headline boolean, score double, lat double, lon double")
    cand = sorted((r for r in rows if r[5] >= 0.3), key=lambda r: (-r[5], r[0]))
    chosen, seen, per = [], set(), {}
    for stage in range(3):
        for p in cand:
            what = (p[1], p[2], p[3] if p[3] in ("max", "rise") else "other")
            ok = (p[4], what not in seen, all(q[2] != p[2] or ST._km(p[6], p[7], q[6], q[7]) >= 50 for q in chosen))[stage]
            if len(chosen) < 14 and p not in chosen and per.get(p[1], 0) < 3 and ok:
                chosen.append(p)
                seen.add(what)
                per[p[1]] = per.get(p[1], 0) + 1
    got = [r["place"] for r in N.pick_labels(df).filter("tier = 1").orderBy("rank").collect()]
    assert got == [p[0] for p in chosen] and len(got) == 14
    assert N.pick_labels(df).filter("tier = 2").count() == 80


def test_pick_labels_spreads_twins(spark):
    """Few measures over a small area: the third pass decides, and skips what is near a label of its measure."""
    import random

    rows_of = lambda rnd: [(i, f"t{m % 3}", f"m{m}", rnd.choice(["max", "event", "people"]), rnd.random() < 0.02, rnd.choice([0.2, 0.3, 0.5, 0.8, round(rnd.random(), 1)]), 39 + rnd.random(), -90 + rnd.random())
                           for i in range(60) for m in [rnd.randrange(4)]]
    schema = "place long, topic string, metric string, kind string, headline boolean, score double, lat double, lon double"
    third = 0
    for seed in range(3):
        rows = rows_of(random.Random(seed))
        chosen, seen, per = [], set(), {}
        for stage in range(3):
            for p in sorted((r for r in rows if r[5] >= 0.3), key=lambda r: (-r[5], r[0])):
                what = (p[1], p[2], p[3] if p[3] == "max" else "other")
                ok = (p[4], what not in seen, all(q[2] != p[2] or ST._km(p[6], p[7], q[6], q[7]) >= 50 for q in chosen))[stage]
                if len(chosen) < 14 and p not in chosen and per.get(p[1], 0) < 3 and ok:
                    chosen.append(p)
                    seen.add(what)
                    per[p[1]] = per.get(p[1], 0) + 1
                    third += stage == 2
        got = N.pick_labels(spark.createDataFrame(rows, schema), spark.createDataFrame([(r[0],) for r in rows[:5]] + [(999,)], "place long")).collect()
        assert [r["place"] for r in sorted((r for r in got if r["tier"] == 1), key=lambda r: r["rank"])] == [p[0] for p in chosen]
        assert sorted(r["place"] for r in got) == list(range(60))
    assert third > 0
    none = spark.createDataFrame([], schema)
    assert N.pick_labels(none).count() == 0


def test_linked_places_join_the_dots(spark):
    rows = [(i, "t", "m", "people", False, 1.0 - i / 1000, 40.0, -90.0) for i in range(100)]
    df = spark.createDataFrame(rows, "place long, topic string, metric string, kind string, headline boolean, score double, lat double, lon double")
    got = N.pick_labels(df, spark.createDataFrame([(0,), (5,), (99,), (99,), (7777,)], "place long")).collect()
    assert [r["place"] for r in got if r["tier"] == 1] == [0]
    assert sorted(r["place"] for r in got if r["tier"] == 2) == [*range(1, 81), 99]


def test_group_stories(spark):
    rows = [(1, ["1", "2", "3"], ["rain"], "w"), (2, ["1"], ["rain"], "w"), (3, ["2"], [], "w"), (4, ["3"], ["hail"], "w"), (5, ["3", "4"], [], "w"), (6, ["4"], [], "w"), (7, ["2", "1"], ["rain", "hail"], "x"), (8, ["4"], [], "w")]
    df = spark.createDataFrame(rows, "item_id long, counties array<string>, measures array<string>, topic string")
    assert {r["item_id"]: r["group"] for r in N.group_stories(df).collect()} == {1: "1|2|3", 2: "1|2|3", 3: "2", 4: "3", 5: "3|4", 6: "3|4", 7: "1|2|3", 8: "3|4"}


def test_motion_and_impact(spark):
    text = "2026-09-30T03:12:00-00:00...storm...262DEG...43KT...33.56,-103.17 33.13,-103.04"
    r = one(spark, S.parse_motion(F.lit(text)).alias("m"), S.parse_motion(F.lit("nothing")).alias("n"),
            S.parse_impact(F.create_map(F.lit("hail"), F.array(F.lit("Up to .75")), F.lit("wind"), F.array(F.lit("0 MPH")), F.lit("threat"), F.array(F.lit("observed"))),
                           [("hail", None), ("wind", None), ("threat", ["RADAR", "OBSERVED"])]).alias("i"))
    assert r["m"]["from_deg"] == 262 and r["m"]["speed_kt"] == 43 and r["m"]["points"] == [[33.56, -103.17], [33.13, -103.04]] and r["n"] is None
    assert [(x["tag"], x["level"], x["value"]) for x in r["i"]] == [("hail", None, 0.75), ("threat", 1, None)]


def test_vocabulary_files(spark, tmp_path):
    (tmp_path / "w.yaml").write_text("""
topic: weather
metrics:
  temp_c: {unit: degC, aliases: [temp], units: {c: 1, f: {expr: "(x - 32) * 5 / 9"}, k2: {expr: "x ** 2"}}, default_unit: f, range: [-45, 55], event: [[40, 0.5]]}
  tornado: {kind: flag, aliases: [tornado]}
alert_support: {temp_c: [heat_advisory]}
station_fields: {tmpf: {metric: temp_c, unit: f}}
""")
    fr = V.frames(spark, V.load_packs(tmp_path))
    rows = spark.createDataFrame([("temp_c", 212.0, None), ("temp_c", 10.0, "c"), ("temp_c", 3.0, "k2"), ("temp_c", 1.0, "miles"), ("tornado", 7.0, None)], "metric string, raw_value double, unit string")
    got = {(r["metric"], r["unit"]): (r["value"], r["error"]) for r in V.convert_unit(rows, fr["dim_unit"], fr["dim_metric"]).collect()}
    assert got[("temp_c", None)][0] == pytest.approx(100) and got[("temp_c", "c")][0] == 10 and got[("temp_c", "k2")][0] == pytest.approx(9)
    assert got[("temp_c", "miles")][0] is None and "unknown unit" in got[("temp_c", "miles")][1] and got[("tornado", None)][0] == 1
    assert S.source_mapping(fr["dim_source_map"], fr["dim_unit"], fr["dim_metric"], "station_fields").first()["metric"] == "temp_c"


def test_area_keys_and_audience(spark):
    r = one(spark, X.area_keys(F.lit("IL"), F.lit("cook"), F.lit("60601"), F.lit("60601-1234")).alias("k"))
    assert r["k"] == ["il", "il.cook", "il.zip.60601", "il.zip.60601-1234"]
    t = spark.createDataFrame([("e1", "events", ["il", "il.cook"], ["60601"])], "target_id string, category string, area_keys array<string>, zips array<string>")
    subs = spark.createDataFrame([(1, "events", "il"), (1, "events", "il.cook"), (2, "events", "il.zip.60601-1234"), (3, "reports", "il"), (4, "events", "il.will"), (5, "events", "il")], "chat_id long, category string, area string")
    sen = spark.createDataFrame([(5, "banned")], "chat_id long, status string")
    assert sorted(x["chat_id"] for x in AU.subscribers_for(t, subs, sen, "il").collect()) == [1, 2]


def test_refused_requests_count_for_nothing(spark):
    import datetime as dt
    import random
    from collections import defaultdict

    from gossamer.operators.filters import rate_limited

    rnd = random.Random(4)
    t0 = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
    rows = [(k, rnd.choice("aab"), t0 + dt.timedelta(seconds=rnd.choice([0, 600, 601, 1201]) + rnd.randrange(0, 9000))) for k in range(400)]
    kept, want = defaultdict(list), {}
    for k, s, t in sorted(rows, key=lambda r: (r[2], r[0])):
        n = sum((t - x).total_seconds() <= 600 for x in kept[s])
        want[k] = (n, n >= 3)
        if n < 3:
            kept[s].append(t)
    df = spark.createDataFrame(rows, "seq long, sensor_id string, received_at timestamp").repartition(5)
    got = {r["seq"]: (r["n_before"], r["refused"]) for r in rate_limited(df, limit=3).collect()}
    assert got == want and sum(x for _, x in want.values()) > 50


def test_research_tables(spark):
    from gossamer.operators import publish as PB

    now, old = dt.datetime(2024, 6, 1), dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([("e1", now, "closed"), ("e2", now, "open"), ("e3", old, "closed")], "event_id string, updated_at timestamp, status string").selectExpr(
        "*", "'w' topic", "'rain' metric", "'1' county_id", "1.0 pub_lat", "2.0 pub_lon", "updated_at opened_at", "3.5D peak", "2L n_signals", "2L n_sensors", "0L n_reference", "0.5D severity", "0.7D score", "'t' title")
    got = {r["event_id"]: r for r in PB.research_events(e, F.lit(now), units=spark.createDataFrame([("rain", "mm")], "metric string, unit string"), story_of=spark.createDataFrame([("e2", "s1")], "event_id string, story_id string")).collect()}
    assert set(got) == {"e1", "e2"} and got["e1"]["closed_at"] == now and got["e2"]["closed_at"] is None
    assert [got[k]["story_id"] for k in ("e1", "e2")] == [None, "s1"] and got["e1"]["unit"] == "mm"
    assert PB.research_events(e, F.lit(now)).filter("unit IS NULL AND story_id IS NULL").count() == 2
    storms = spark.createDataFrame([(1, now, None), (2, now, 1), (3, old, None)], "story_id long, updated_at timestamp, merged_into long")
    assert [tuple(r) for r in PB.research_storms(storms, F.lit(now)).collect()] == [(1, now)]
    s = spark.createDataFrame([(1, "human", "active", None), (2, "official", "active", 0.71234), (3, "station", "active", 0.5), (4, "bot", "banned", 0.5)], "sensor_id long, kind string, status string, trust_prior double").selectExpr("*", "'1' county_id")
    r = spark.createDataFrame([(1, "corroborated"), (1, "flagged"), (1, "raw")], "sensor_id long, quality string")
    found = sorted(tuple(x) for x in PB.research_sensors(s, r).select("kind", "n_signals", "n_corroborated", "n_contradicted", "trust").collect())
    assert found == [("human", 3, 1, 1, 0.5), ("official", 0, 0, 0, 0.712)]
