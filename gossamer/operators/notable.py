"""What stands out: reasons, places, news tied to readings, the network graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gossamer.functions import scalars as X
from gossamer.functions.geo import haversine_km
from gossamer.operators.rollups import top_per_key
from gossamer.plans.components import resolve_pointers
from gossamer.session import checkpointed

# What each kind of reason weighs.
W_HEADLINE, W_PEOPLE, W_CHECKED, W_REPORT, W_NEWS = 0.35, 0.3, 0.1, 0.15, 0.4
W_FLOOD = {1: 0.3, 2: 0.55, 3: 0.75, 4: 0.95}
LABELLED, DOTS, PER_TOPIC, TWIN_KM, MIN_LABELLED, LINKS = 14, 80, 3, 50.0, 0.3, 4
HEADLINE_KINDS = ("max", "min", "rise")


def flood_weight(level) -> Column:
    out = None
    for k, v in W_FLOOD.items():
        out = F.when(level == k, v) if out is None else out.when(level == k, v)
    return out


def flood_reasons(gauges: DataFrame, places: DataFrame) -> DataFrame:
    """Gauges at or near flood stage on the map place of the same sensor."""
    g = gauges.filter(F.col("level") > 0)
    return g.join(places, g.site == places.sensor_id).withColumn("weight", flood_weight(F.col("level")))


def reasons(signals: DataFrame) -> DataFrame:
    """(place, metric, kind, weight) from a place's own readings: past a threshold, reported by people (and
    corroborated), reported officially. Rows carry severity and are combined per (place, metric) first."""
    g = signals.groupBy(F.col("sensor_id").alias("place"), "metric", "topic").agg(
        F.max("severity").alias("severity"), F.count_if(X.is_people()).alias("people"),
        F.count_if(X.is_people() & (F.col("quality") == "corroborated")).alias("checked"), F.count_if(F.col("kind") == "official").alias("official"))
    kinds = F.array(
        F.when(F.col("severity") > 0, F.struct(F.lit("event").alias("kind"), F.col("severity").alias("weight"))),
        F.when(F.col("people") > 0, F.struct(F.lit("people").alias("kind"), F.when(F.col("checked") > 0, W_PEOPLE + W_CHECKED).otherwise(W_PEOPLE).alias("weight"))),
        F.when(F.col("official") > 0, F.struct(F.lit("report").alias("kind"), F.lit(W_REPORT).alias("weight"))))
    return g.select("place", "metric", "topic", F.explode(F.array_compact(kinds)).alias("r")).select("place", "metric", "topic", "r.kind", "r.weight")


def place_scores(reason_rows: DataFrame) -> DataFrame:
    """Best weight per kind, summed."""
    return reason_rows.groupBy("place", "kind").agg(F.max("weight").alias("w")).groupBy("place").agg(F.sum("w").alias("score"))


def county_areas(signals: DataFrame, dim_metric: DataFrame) -> DataFrame:
    """Latest county-wide value per (metric, county) past its threshold, counties grouped by value."""
    latest = signals.filter(F.col("county_id").isNotNull() & F.col("value").isNotNull()).groupBy("metric", "county_id").agg(
        F.max_by("value", F.struct("observed_at", "seq")).alias("value"), F.max("observed_at").alias("at_"))
    hit = latest.join(F.broadcast(dim_metric.select("metric", "thresholds", "direction")), "metric").withColumn(
        "sev", X.severity("value", "thresholds", "direction")).filter(F.col("sev") > 0)
    return hit.groupBy("metric", "value", "sev").agg(F.sort_array(F.collect_set("county_id")).alias("counties"), F.max("at_").alias("latest"))


def quiet_topics(dim_metric: DataFrame, shown: DataFrame) -> DataFrame:
    """A31."""
    return dim_metric.select("topic").distinct().join(shown.select("topic"), "topic", "left_anti")


# ── labels ───────────────────────────────────────────────────────────────

def _fitting(candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """Candidates by score as far as their topic has room: three a topic, those already chosen among them."""
    used = F.broadcast(chosen.groupBy("topic").agg(F.count(F.lit(1)).alias("_used")))  # a row per topic of the packs
    by = W.partitionBy("topic").orderBy(F.desc("score"), F.asc("place"))
    ranked = candidates.withColumn("_r", F.row_number().over(by)).join(used, "topic", "left")
    return ranked.filter(F.col("_r") + F.coalesce("_used", F.lit(0)) <= PER_TOPIC).select(*candidates.columns)


def _far_from(places: DataFrame, chosen: DataFrame) -> DataFrame:
    """Places with none of ``chosen`` (some rows per measure of the packs) of the same measure nearby."""
    c = F.broadcast(chosen.select(F.col("metric").alias("_m"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")))
    return places.join(c, (F.col("metric") == F.col("_m")) & (haversine_km("lat", "lon", "_lat", "_lon") < TWIN_KM), "left_anti")


def pick_labels(places: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """T5: (place, tier, rank): at most 14 labelled places (tier 1) in three passes by score, at most three of a topic; the next 80 as dots, and
    those of ``linked`` (place: a story is tied to it) that are neither (tier 2, without rank).

    The passes take headline places, then places that say something no label says yet, then any without a label of the same measure within 50 km.
    ``places`` (place, topic, metric, kind, headline, score, lat, lon), one row each; a measure belongs to one topic. Ties go to the lesser place.

    What a pass can take is bounded by the packs, so each is a few aggregates: three headline places a topic; the best place of each thing said; and of each
    measure the best place, the best one far from it, and the best one far from both, as no topic has room for more.
    """
    best = F.max_by(F.struct("place", "topic", "score", "lat", "lon", "_what"), F.struct("score", -F.col("place")))
    what = F.concat_ws("|", "topic", "metric", F.when(F.col("kind").isin(*HEADLINE_KINDS), F.col("kind")).otherwise("other"))
    p = checkpointed(places.filter(F.col("score").isNotNull()).select("place", "topic", "metric", "headline", "score", "lat", "lon", what.alias("_what")))
    worth = p.filter(F.col("score") >= MIN_LABELLED)
    cols = ["place", "topic", "metric", "score", "lat", "lon", "_what"]
    first = top_per_key(worth.filter("headline").select(*cols), ["topic"], [F.desc("score"), F.asc("place")], PER_TOPIC, "place").select(*cols)
    new = worth.join(F.broadcast(first.select("_what")), "_what", "left_anti").groupBy("_what", "metric").agg(best.alias("b")).select("metric", "b.*").select(*cols)
    two = checkpointed(first.withColumn("step", F.lit(1)).unionByName(_fitting(new, first).withColumn("step", F.lit(2))))
    left = _far_from(worth.select(*cols).join(F.broadcast(two.select("place")), "place", "left_anti"), two)
    rest = None
    for _ in range(PER_TOPIC):
        take = left.groupBy("metric").agg(best.alias("b")).select("metric", "b.*").select(*cols)
        rest, left = take if rest is None else rest.unionByName(take), _far_from(left, take)
    three = two.unionByName(_fitting(rest, two).withColumn("step", F.lit(3)))
    order = W.orderBy("step", F.desc("score"), F.asc("place"))  # three rows a topic and step at most
    picked = checkpointed(three.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= LABELLED).select("place", F.lit(1).alias("tier"), "rank"))
    others = p.join(F.broadcast(picked.select("place")), "place", "left_anti").select("place", "score")
    dots = others.orderBy(F.desc("score"), F.asc("place")).limit(DOTS).select("place")
    if linked is not None:
        dots = dots.unionByName(others.join(linked.select("place"), "place", "left_semi").select("place")).distinct()
    return picked.unionByName(dots.select("place", F.lit(2).alias("tier"), F.lit(None).cast("int").alias("rank")))


# ── news ─────────────────────────────────────────────────────────────────

def group_stories(stories: DataFrame) -> DataFrame:
    """(item_id, group): stories by county set; a set follows the widest other set that holds all its counties when both name a measure in
    common, or when neither names one and they share a topic. Sets of one size go by name. Followed to the end, that names the group.

    ``stories`` (item_id, counties array, measures array, topic). Stories are combined per county set first. A set can only be held by sets that
    have its rarest county, so each set looks there alone, and chains are followed by pointer jumping.
    """
    s = stories.filter(F.size("counties") > 0).withColumn("key", F.array_join(F.sort_array("counties"), "|"))
    # one set's measures and topics are lists of vocabulary names, so collecting them is bounded by the packs
    sets = checkpointed(s.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("measures"))).alias("measures"), F.collect_set("topic").alias("topics")).withColumn("counties", F.split("key", r"\|")))
    at = sets.select("key", F.explode("counties").alias("county"))
    rare = at.join(at.groupBy("county").agg(F.count(F.lit(1)).alias("n")), "county").groupBy("key").agg(F.min(F.struct("n", "county")).alias("r")).select("key", "r.county")
    wide = sets.select(F.col("key").alias("over"), F.col("counties").alias("o_counties"), F.col("measures").alias("o_measures"), F.col("topics").alias("o_topics"), F.explode("counties").alias("county"))
    size, o_size = F.size("counties"), F.size("o_counties")
    first = (o_size > size) | ((o_size == size) & (F.col("over") < F.col("key")))
    alike = F.arrays_overlap("measures", "o_measures") | ((F.size("measures") == 0) & (F.size("o_measures") == 0) & F.arrays_overlap("topics", "o_topics"))
    held = sets.join(rare, "key").join(wide, "county").filter(first & (F.size(F.array_except("counties", "o_counties")) == 0) & alike)
    parent = held.groupBy("key").agg(F.min(F.struct((-o_size).alias("s"), "over")).alias("p")).select("key", "p.over")
    roots = resolve_pointers(sets.select("key").join(parent, "key", "left"), "key", "over")
    return s.join(roots.withColumnRenamed("node", "key"), "key").select("item_id", F.col("root").alias("group"))


def every_reason(own: DataFrame, headlines: DataFrame, rises: DataFrame, floods: DataFrame, dim_metric: DataFrame) -> DataFrame:
    """X28, all kinds but the news: ``own`` reasons, the state's extremes (W4: metric, stat, place, value), the ranked rises (W3: metric, site, weight) and gauges near flood
    stage (J30: site, metric, weight). An extreme short of the pack's least worth telling is none, and only measures whose rise at one site says something have one."""
    m = F.broadcast(dim_metric.select("metric", "topic", "headline_min", _rises().alias("_rises")))
    short = F.when(F.col("stat") == "max", F.col("value") < F.col("headline_min")).otherwise(F.col("value") > F.col("headline_min"))
    row = lambda df, place, kind, weight: df.select(place.alias("place"), "metric", "topic", kind.alias("kind"), weight.cast("double").alias("weight"))
    extreme = row(headlines.join(m, "metric").filter(~F.coalesce(short, F.lit(False))), F.col("place"), F.col("stat"), F.lit(W_HEADLINE))
    up = row(rises.join(m, "metric").filter("_rises"), F.col("site"), F.lit("rise"), F.col("weight"))
    flood = row(floods.join(m, "metric"), F.col("site"), F.lit("flood"), F.col("weight"))
    return own.select("place", "metric", "topic", "kind", "weight").unionByName(extreme).unionByName(up).unionByName(flood)


def _rises() -> Column:
    """Whether a rise at one site means something: not of a running amount, a flag, or what matters when it falls."""
    return ~F.col("accumulates") & ~F.col("is_flag") & (F.col("direction") == "above")


def news_reasons(links: DataFrame) -> DataFrame:
    """The places that stories were tied to."""
    return links.groupBy("place").agg(F.min("metric").alias("metric")).select("place", "metric", F.lit(None).cast("string").alias("topic"), F.lit("news").alias("kind"), F.lit(W_NEWS).alias("weight"))


def bearing(tops: DataFrame, rises: DataFrame, dim_metric: DataFrame) -> DataFrame:
    """(place, county_id, metric, rise, signed): what each place's readings of a measure can say: its rise, and its extreme in the measure's own direction, larger
    saying more. ``tops`` (place, county_id, metric, hi, lo, is_rate): a running amount counts only as a total."""
    m = F.broadcast(dim_metric.select("metric", "direction", "accumulates", _rises().alias("_rises")))
    t = tops.join(m, "metric").filter(~(F.col("accumulates") & F.col("is_rate")))
    up = rises.select(F.col("site").alias("place"), "metric", F.col("rise").alias("_up"))
    return t.join(up, ["place", "metric"], "left").select("place", "county_id", "metric", F.when(F.col("_rises"), F.col("_up")).alias("rise"), F.when(F.col("direction") == "below", -F.col("lo")).otherwise(F.col("hi")).alias("signed"))


def _best(df: DataFrame, keys: list[str], place: str = "place") -> DataFrame:
    """Per key the place with the largest rise, else the largest ``signed`` value; ties to the lesser place. One partial aggregate."""
    order = F.struct(F.col("rise").isNotNull().alias("r"), F.coalesce("rise", "signed").alias("v"), (-F.col(place)).alias("p"))
    return df.groupBy(*keys).agg(F.max_by(F.struct(place, "rise", "signed"), order).alias("b")).select(*keys, "b.*")


def link_news(groups: DataFrame, named: DataFrame, readings: DataFrame, reason_rows: DataFrame, scores: DataFrame, dim_metric: DataFrame, k: int = LINKS) -> DataFrame:
    """(group, place, metric, rank): up to four places that a group of stories bears on.

    For each measure the group's stories name, most named first, headline measures before others, the place in its counties whose reading says most (``bearing``), if the
    place stands out by that measure, or the measure is a running amount, or it rose there. Then places past a threshold there, best score first. Places with a reason of
    their own go before the others. ``groups`` (group, county_id), ``named`` (group, metric, n), ``reason_rows`` without news. Readings are reduced per (county, metric) first.
    """
    m = F.broadcast(dim_metric.select("metric", "accumulates", F.col("headline").isNull().alias("plain")))
    here = groups.join(_best(readings, ["county_id", "metric"]), "county_id").join(named, ["group", "metric"])
    best = _best(here, ["group", "metric", "n"]).join(m, "metric")
    own = reason_rows.select("place", "metric", F.lit(True).alias("own")).distinct()
    fit = best.join(own, ["place", "metric"], "left").filter(F.col("own") | F.col("accumulates") | F.col("rise").isNotNull())
    order = F.struct((-F.col("n")).cast("double").alias("k1"), F.col("plain").alias("k2"), F.col("metric").alias("k3"))
    picks = fit.groupBy("group", "place").agg(F.min(order).alias("o")).select("group", "place", F.col("o.k3").alias("metric"), F.lit(0).alias("part"), "o.k1", "o.k2")
    events = reason_rows.filter("kind = 'event'").select("place").distinct().join(scores, "place").join(readings.select("place", "county_id").distinct(), "place")
    more = groups.join(events, "county_id").groupBy("group", "place").agg(F.max("score").alias("score")).join(picks.select("group", "place"), ["group", "place"], "left_anti")
    more = more.select("group", "place", F.lit(None).cast("string").alias("metric"), F.lit(1).alias("part"), (-F.round("score", 9)).alias("k1"), F.lit(False).alias("k2"))
    stands = reason_rows.select("place", F.lit(0).alias("bare")).distinct()
    both = picks.unionByName(more).join(stands, "place", "left").withColumn("bare", F.coalesce("bare", F.lit(1)))
    out = top_per_key(both, ["group"], [F.asc("bare"), F.asc("part"), F.asc("k1"), F.asc("k2"), F.asc_nulls_last("metric"), F.asc("place")], k, "place")
    return out.select("group", "place", "metric", "rank")


def link_statewide(named: DataFrame, readings: DataFrame, reason_rows: DataFrame, dim_metric: DataFrame, k: int = LINKS) -> DataFrame:
    """J15 for stories about no county: (item_id, place, metric, rank): of each measure named the notable place whose reading says most, if it stands out by that measure."""
    notable = reason_rows.select("place").distinct()
    best = _best(readings.join(notable, "place", "left_semi"), ["metric"]).join(reason_rows.select("place", "metric").distinct(), ["place", "metric"])
    m = F.broadcast(dim_metric.select("metric", F.col("headline").isNull().alias("plain")))
    fit = named.join(F.broadcast(best.select("metric", "place")), "metric").join(m, "metric")  # one row per measure of the packs
    picks = fit.groupBy("item_id", "place").agg(F.min(F.struct("plain", "metric")).alias("o")).select("item_id", "place", "o.plain", "o.metric")
    return top_per_key(picks, ["item_id"], [F.asc("plain"), F.asc("metric")], k, "place").select("item_id", "place", "metric", "rank")


def rank_groups(groups: DataFrame, limit: int = 7) -> DataFrame:
    """Relevance, plus 0.3 when linked, plus 0.05 per further story. Rows: group, relevance, linked, n."""
    score = F.col("relevance") + F.when(F.col("linked"), 0.3).otherwise(0.0) + 0.05 * (F.col("n") - 1)
    return groups.withColumn("score", score).orderBy(F.desc("score"), "group").limit(limit)


def statewide_variety(stories: DataFrame, limit: int = 3) -> DataFrame:
    """T6, statewide part: one story per new topic first, then the strongest left.

    Only the ``limit`` strongest of each topic can be picked, so the choice is two window ranks over those.
    """
    top = top_per_key(stories, ["topic"], [F.desc("score"), F.asc("item_id")], limit, "item_id")
    first = F.when(F.col("rank") == 1, 0).otherwise(1)
    return top.orderBy(first, F.desc("score"), "item_id").limit(limit)


# ── network graph ────────────────────────────────────────────────────────

def graph_nodes(signals: DataFrame, dim_metric: DataFrame, events: DataFrame, keep: DataFrame) -> DataFrame:
    """(id, kind, n): topics, metrics, kept sensors by handle, feeds, counties of kept sensors, events."""
    n = F.count(F.lit(1)).alias("n")
    by_metric = signals.groupBy("metric", "topic").agg(n)
    used = dim_metric.select("metric", "topic").join(by_metric.drop("topic"), "metric", "left").fillna(0, ["n"])
    people = signals.filter(X.is_people()).groupBy("sensor_id", "county_id").agg(n).join(keep, "sensor_id", "left_semi")
    feeds = signals.filter(~X.is_people()).groupBy("source").agg(n)
    node = lambda df, i, k: df.select(i.alias("id"), F.lit(k).alias("kind"), F.col("n"))
    return (node(used.groupBy("topic").agg(F.sum("n").alias("n")), F.concat(F.lit("topic:"), "topic"), "topic")
            .unionByName(node(used, F.concat(F.lit("metric:"), "metric"), "metric"))
            .unionByName(node(people.groupBy("sensor_id").agg(F.sum("n").alias("n")), F.concat(F.lit("sensor:"), X.public_handle("sensor_id")), "sensor"))
            .unionByName(node(people.groupBy("county_id").agg(F.sum("n").alias("n")), F.concat(F.lit("county:"), "county_id"), "county"))
            .unionByName(node(feeds, F.concat(F.lit("feed:"), "source"), "feed"))
            .unionByName(node(events.select("event_id", F.col("n_signals").alias("n")), F.concat(F.lit("event:"), "event_id"), "event")))


def graph_edges(signals: DataFrame, dim_metric: DataFrame, events: DataFrame, keep: DataFrame) -> DataFrame:
    """(source, target, kind, weight). Corroborated links count the (metric, county, day) groups two kept sensors
    share; kept sensors are at most a couple of hundred, so a group's pairs are bounded by that, whatever its readings.
    """
    n = F.count(F.lit(1)).alias("weight")
    h = lambda c: F.concat(F.lit("sensor:"), X.public_handle(c))
    m = F.concat(F.lit("metric:"), "metric")
    edge = lambda df, a, b, k: df.select(a.alias("source"), b.alias("target"), F.lit(k).alias("kind"), F.col("weight").cast("long").alias("weight"))
    people = signals.filter(X.is_people()).join(F.broadcast(keep), "sensor_id", "left_semi")
    belongs = dim_metric.select("metric", "topic", F.lit(1).alias("weight"))
    feeds = signals.filter(~X.is_people()).groupBy("source", "metric").agg(n)
    reports = people.groupBy("sensor_id", "metric").agg(n)
    home = people.groupBy("sensor_id").agg(F.max_by("county_id", F.struct("observed_at", "seq")).alias("county_id")).withColumn("weight", F.lit(1))
    days = people.filter((F.col("quality") == "corroborated") & F.col("county_id").isNotNull()).select(
        "metric", "county_id", F.to_date("observed_at").alias("day"), "sensor_id").distinct()
    pairs = days.join(days.withColumnRenamed("sensor_id", "other"), ["metric", "county_id", "day"]).filter(F.col("sensor_id") < F.col("other"))
    both = pairs.groupBy("sensor_id", "other").agg(n)
    ev = events.select("event_id", "metric", "county_id", F.lit(1).alias("weight"))
    e = F.concat(F.lit("event:"), "event_id")
    return (edge(belongs, m, F.concat(F.lit("topic:"), "topic"), "belongs").unionByName(edge(feeds, F.concat(F.lit("feed:"), "source"), m, "reports"))
            .unionByName(edge(reports, h("sensor_id"), m, "reports")).unionByName(edge(home, h("sensor_id"), F.concat(F.lit("county:"), "county_id"), "home"))
            .unionByName(edge(both, h("sensor_id"), h("other"), "corroborated"))
            .unionByName(edge(ev, e, m, "about")).unionByName(edge(ev.filter("county_id is not null"), e, F.concat(F.lit("county:"), "county_id"), "in")))


def busiest_people(signals: DataFrame, k: int = 200) -> DataFrame:
    """The k people with most readings."""
    g = signals.filter(X.is_people()).groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("n"), "sensor_id").limit(k).select("sensor_id")
