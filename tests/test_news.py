"""News tied to readings, on a small literal case."""

from gossamer.operators import notable as N


def linked(spark, readings, reasons, scores, accumulates=False):
    groups = spark.createDataFrame([("g", "1"), ("g", "2"), ("h", "9")], "group string, county_id string")
    named = spark.createDataFrame([("g", "rain", 2), ("g", "flood", 1)], "group string, metric string, n long")
    dm = spark.createDataFrame([(m, "t", None, None, accumulates and m == "flood", False, "above") for m in ("rain", "flood", "wind")],
                               "metric string, topic string, headline string, headline_min double, accumulates boolean, is_flag boolean, direction string")
    r = spark.createDataFrame(readings, "place long, county_id string, metric string, rise double, signed double")
    why = spark.createDataFrame(reasons, "place long, metric string, kind string")
    got = {}
    for x in N.link_news(groups, named, r, why, spark.createDataFrame(scores, "place long, score double"), dm).orderBy("group", "rank").collect():
        got.setdefault(x["group"], []).append((x["place"], x["metric"]))
    return got


READINGS = [(10, "1", "rain", None, 5.0), (11, "2", "rain", None, 9.0), (12, "1", "flood", None, 3.0), (13, "3", "rain", None, 99.0), (14, "2", "wind", None, 1.0), (15, "9", "wind", None, 1.0), (16, "9", "wind", None, 1.0)]
REASONS = [(10, "wind", "event"), (11, "rain", "people"), (14, "wind", "event"), (15, "wind", "event"), (16, "wind", "event")]
SCORES = [(10, 0.4), (11, 0.9), (12, 0.5), (14, 0.8), (15, 0.6), (16, 0.7)]


def test_link_news(spark):
    # the best rain reading of its counties first; place 12 does not stand out by the flood; then event places by score
    assert linked(spark, READINGS, REASONS, SCORES) == {"g": [(11, "rain"), (14, None), (10, None)], "h": [(16, None), (15, None)]}


def test_link_news_by_rise_and_total(spark):
    # a rise says more than a higher level and needs no reason; a running amount needs none either; both come after what stands out on its own
    rising = [(17, "1", "rain", 0.2, 1.0), *READINGS]
    assert linked(spark, rising, REASONS, SCORES, accumulates=True)["g"] == [(14, None), (10, None), (17, "rain"), (12, "flood")]


def test_places_longest_first(spark):
    from gossamer.operators.text import places_in_text

    gaz = spark.createDataFrame([("Rock", ["1"]), ("Rock Island", ["2"]), ("Chicago", ["3"]), ("Chicago area", ["3", "4"])], "name string, fips array<string>")
    docs = spark.createDataFrame([(1, "Flooding in Rock Island and Rock"), (2, "Chicago-area rain"), (3, "Rockford")], "id long, t string")
    got = {}
    for r in places_in_text(docs, "id", "t", gaz, 3).collect():
        got.setdefault(r["id"], set()).add(r["name"])
    assert got == {1: {"Rock Island", "Rock"}, 2: {"Chicago area"}}
