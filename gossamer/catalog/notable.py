"""Notability, news links, network graph and text matching on the adapter tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gossamer.catalog.aggregates import events
from gossamer.catalog.filters import NOW, now
from gossamer.catalog.joins import PEOPLE, hav
from gossamer.catalog import windows as WD
from gossamer.catalog.registry import SQL, query, table_sql
from gossamer.functions import scalars as X
from gossamer.operators import ahead as AH
from gossamer.operators import filters as O
from gossamer.operators import notable as N
from gossamer.operators import text as TX
from gossamer.operators.filters import hours_before
from gossamer.session import checkpointed
from gossamer.sources import adapter as A


def recent(spark, sf, hours=240):
    v = F.broadcast(A.dim_metric(spark).select("metric", "thresholds", "direction"))
    s = A.assessed(spark, sf).filter((F.col("observed_at") >= hours_before(now(spark, sf), hours)) & (F.col("quality") != "rejected")).join(v, "metric")
    return s.withColumn("severity", X.severity("value", "thresholds", "direction"))


table_sql("recents", f"""SELECT a.*, coalesce(c.severity, 0) AS severity FROM assessed a LEFT JOIN (SELECT seq, severity FROM crossings) c USING (seq)
    WHERE a.observed_at >= {NOW} - INTERVAL 240 HOURS AND quality <> 'rejected'""")
table_sql("reason_rows", f"""WITH g AS (SELECT sensor_id AS place, metric, topic, max(severity) AS severity, count(*) FILTER (kind IN {PEOPLE}) AS people,
     count(*) FILTER (kind IN {PEOPLE} AND quality = 'corroborated') AS checked, count(*) FILTER (kind = 'official') AS official FROM recents GROUP BY 1, 2, 3)
    SELECT place, metric, topic, 'event' AS kind, severity AS weight FROM g WHERE severity > 0 UNION ALL SELECT place, metric, topic, 'people', CASE WHEN checked > 0 THEN 0.4 ELSE 0.3 END::DOUBLE FROM g WHERE people > 0
    UNION ALL SELECT place, metric, topic, 'report', 0.15::DOUBLE FROM g WHERE official > 0""")
table_sql("place_scores", "SELECT place, sum(w) AS score FROM (SELECT place, kind, max(weight) AS w FROM reason_rows GROUP BY 1, 2) GROUP BY 1")


table_sql("every_reason", f"""SELECT * FROM reason_rows UNION ALL SELECT place, metric, topic, stat, 0.35::DOUBLE FROM ({SQL['w4_statewide_headline']}) JOIN dim_metric USING (metric) WHERE NOT coalesce(CASE WHEN stat = 'max' THEN value < headline_min ELSE value > headline_min END, false)
    UNION ALL SELECT site, metric, topic, 'rise', weight FROM ({SQL['w3_rank_rises']}) JOIN dim_metric USING (metric) WHERE NOT accumulates AND NOT is_flag AND direction = 'above'
    UNION ALL SELECT site, 'click', 'web', 'flood', weight FROM ({SQL['j30_flood_to_place']})""")
table_sql("every_score", "SELECT place, sum(w) AS score FROM (SELECT place, kind, max(weight) AS w FROM every_reason GROUP BY 1, 2) GROUP BY 1")


def all_reasons(spark, sf):
    """Reasons of all kinds but the news, stored once."""
    floods = WD.floods(spark, sf).withColumn("metric", F.lit("click"))
    return checkpointed(N.every_reason(N.reasons(recent(spark, sf)), WD.headlines(spark, sf), AH.rank_rises(WD.rise_rows(spark, sf)), floods, A.dim_metric(spark)))


@query("x28_reason_weight", "SELECT place, metric, kind, round(weight, 6) AS weight FROM every_reason")
def x28(spark, sf):
    return all_reasons(spark, sf).select("place", "metric", "kind", F.round("weight", 6).alias("weight"))


def shown_news(spark, sf):
    """Reasons of all kinds but the news, and the places tied to groups of stories that are shown."""
    why = all_reasons(spark, sf)
    st = checkpointed(story_rows(spark, sf))
    links = checkpointed(news_links(spark, sf, why, st))
    return why, links.join(N.rank_groups(ranked_stories(spark, sf, st, links)).select("group"), "group", "left_semi")


@query("a33_place_score", "SELECT place, round(sum(w), 6) AS score FROM (SELECT place, kind, max(weight) AS w FROM (SELECT place, kind, weight FROM every_reason UNION ALL SELECT place, 'news', 0.4::DOUBLE FROM shown_links) GROUP BY 1, 2) GROUP BY 1")
def a33(spark, sf):
    """Scores of the finished map: news counts where a story of a shown group is tied."""
    why, shown = shown_news(spark, sf)
    return N.place_scores(why.unionByName(N.news_reasons(shown))).withColumn("score", F.round("score", 6))


@query("a30_county_areas", """WITH l AS (SELECT metric, county_id, arg_max(value, row(observed_at, seq)) AS value FROM signals GROUP BY 1, 2)
    SELECT metric, value, sev, array_to_string(list_sort(list(county_id)), ';') AS counties FROM (SELECT l.metric, l.county_id, l.value, max(t.severity) AS sev FROM l JOIN dim_metric m USING (metric)
    JOIN dim_threshold t ON t.metric = l.metric AND CASE WHEN m.direction = 'below' THEN l.value <= lim ELSE l.value >= lim END GROUP BY 1, 2, 3) GROUP BY 1, 2, 3""")
def a30(spark, sf):
    return N.county_areas(A.signals(spark, sf), A.dim_metric(spark)).select("metric", "value", "sev", F.array_join("counties", ";").alias("counties"))


@query("a31_quiet_topics", f"SELECT DISTINCT topic FROM dim_metric WHERE topic NOT IN (SELECT topic FROM crossings WHERE severity >= 0.7 AND observed_at >= {NOW} - INTERVAL 2 HOURS)")
def a31(spark, sf):
    shown = recent(spark, sf, 2).filter("severity >= 0.7").select("topic").distinct()
    return N.quiet_topics(A.dim_metric(spark), shown)


# ── texts: county names planted in titles, and the documents' own words ──

GAZ = [(f"Nation {k}", [str(k)]) for k in range(25)] + [("Nation 1 area", ["1", "2", "3"]), ("the of", ["4"]), ("der die", ["5", "6"]), ("le la", ["7"]), ("Nation 20 district", ["20", "21"])]


def titled(spark, sf):
    d = A.documents(spark, sf)
    k = F.col("item_id") % 27
    extra = F.when(k < 25, F.concat(F.lit("Rain in Nation-"), k.cast("string"), F.when(F.col("item_id") % 2 == 0, " area floods").otherwise(" errors"))).otherwise("Clicks and gusts")
    return d.withColumn("headline", F.concat(F.col("title"), F.lit(" "), extra))


HEAD = """SELECT item_id, title || ' ' || CASE WHEN item_id % 27 < 25 THEN 'Rain in Nation-' || (item_id % 27) || CASE WHEN item_id % 2 = 0 THEN ' area floods' ELSE ' errors' END ELSE 'Clicks and gusts' END AS headline FROM doc_rows"""
WORDS = r"regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+')"
# literal names on word boundaries; longer names blank shorter ones (only 'Nation 1 area' holds another name here)
_SP = "(' ' || array_to_string(" + WORDS.format(t="headline") + ", ' ') || ' ')"
GAZ_SQL = ", ".join(f"('{n}', {i})" for i, (n, _) in enumerate(GAZ))


@query("j13_places_in_text", f"""SELECT item_id, nm AS name FROM (SELECT item_id, {_SP} AS t FROM ({HEAD})) d JOIN (VALUES {GAZ_SQL}) g(nm, i) ON contains(CASE WHEN nm IN ('Nation 1', 'Nation 20') THEN
    replace(replace(t, ' Nation 1 area ', ' # '), ' Nation 20 district ', ' # ') ELSE t END, ' ' || nm || ' ')""")
def j13(spark, sf):
    gaz = spark.createDataFrame(GAZ, "name string, fips array<string>")
    return TX.places_in_text(titled(spark, sf), "item_id", "headline", gaz, 3).select("item_id", "name").distinct()


NEWS = [("purchase", "rain"), ("error", "flood"), ("error", "error"), ("click", "click"), ("view", "gust"), ("signup", "the of")]


@query("j14_measures_in_text", f"""SELECT DISTINCT item_id, m AS metric FROM (SELECT item_id, {_SP.replace('headline', 'lower(headline)')} AS t FROM ({HEAD})) d
    CROSS JOIN (VALUES {', '.join(f"('{a}', '{b}')" for a, b in NEWS)}) g(m, nm) CROSS JOIN (VALUES (''), ('s'), ('es'), ('ing'), ('ed')) x(e) WHERE contains(t, ' ' || nm || e || ' ')""")
def j14(spark, sf):
    return TX.measures_in_text(titled(spark, sf), "item_id", F.col("headline"), spark.createDataFrame(NEWS, "metric string, name string"), 2)


def story_rows(spark, sf):
    gaz = spark.createDataFrame(GAZ, "name string, fips array<string>")
    t = titled(spark, sf)
    p = TX.places_in_text(t, "item_id", "headline", gaz, 3).groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("fips")))).alias("counties"))
    m = TX.measures_in_text(t, "item_id", F.col("headline"), spark.createDataFrame(NEWS, "metric string, name string"), 2).groupBy("item_id").agg(F.array_sort(F.collect_set("metric")).alias("measures"))
    return t.join(p, "item_id").join(m, "item_id", "left").select("item_id", "counties", F.coalesce("measures", F.array().cast("array<string>")).alias("measures"), "topic")


GAZ_FIPS = ", ".join(f"('{n}', {f!r})" for n, f in GAZ)
table_sql("story_sets", f"""SELECT d.item_id, d.topic, c.counties, coalesce(m.measures, []) AS measures FROM doc_rows d
    JOIN (SELECT item_id, list_sort(list(DISTINCT f)) AS counties FROM (SELECT item_id, unnest(fips) AS f FROM ({SQL['j13_places_in_text']}) JOIN (VALUES {GAZ_FIPS}) g(name, fips) USING (name)) GROUP BY 1) c USING (item_id)
    LEFT JOIN (SELECT item_id, list(DISTINCT metric) AS measures FROM ({SQL['j14_measures_in_text']}) GROUP BY 1) m USING (item_id)""")
table_sql("sets", """SELECT array_to_string(counties, '|') AS "key", counties, list_distinct(flatten(list(measures))) AS measures, list(DISTINCT topic) AS topics FROM story_sets GROUP BY counties""")
table_sql("set_parents", """SELECT a."key", arg_min(b."key", row(-len(b.counties), b."key")) AS over FROM sets a JOIN sets b ON (len(b.counties) > len(a.counties) OR (len(b.counties) = len(a.counties) AND b."key" < a."key"))
    AND list_has_all(b.counties, a.counties) AND (list_has_any(a.measures, b.measures) OR (len(a.measures) = 0 AND len(b.measures) = 0 AND list_has_any(a.topics, b.topics))) GROUP BY 1""")


@query("g7_group_stories_by_place", """SELECT item_id, root AS "group" FROM story_sets JOIN (WITH RECURSIVE up AS (SELECT "key", "key" AS root FROM sets UNION ALL SELECT up."key", p.over FROM up JOIN set_parents p ON p."key" = up.root)
    SELECT "key", root FROM up WHERE root NOT IN (SELECT "key" FROM set_parents)) r ON r."key" = array_to_string(counties, '|')""")
def g7(spark, sf):
    return N.group_stories(story_rows(spark, sf))


table_sql("story_groups", SQL["g7_group_stories_by_place"])
table_sql("bears", """SELECT t.place, t.county_id, t.metric, CASE WHEN direction = 'above' AND NOT accumulates AND NOT is_flag THEN r.rise END AS rise, v FROM (SELECT sensor_id AS place, county_id, metric, direction, accumulates, is_flag,
      CASE WHEN direction = 'below' THEN -min(value) ELSE max(value) END AS v FROM recents JOIN dim_metric USING (metric) GROUP BY sensor_id, county_id, metric, direction, accumulates, is_flag HAVING NOT (accumulates AND bool_or(coalesce(period = '1h', false)))) t LEFT JOIN rise_rows r ON r.site = t.place AND r.metric = t.metric""")
_SAYS = "coalesce(arg_max(place, row(rise, -place)) FILTER (rise IS NOT NULL), arg_max(place, row(v, -place)))"
table_sql("news_links", f"""WITH g AS (SELECT DISTINCT "group", unnest(counties) AS county_id FROM story_groups JOIN story_sets USING (item_id)),
    n AS (SELECT "group", metric, count(DISTINCT item_id) AS n FROM (SELECT "group", item_id, unnest(measures) AS metric FROM story_groups JOIN story_sets USING (item_id)) GROUP BY 1, 2),
    b AS (SELECT "group", metric, n, {_SAYS} AS place FROM g JOIN bears USING (county_id) JOIN n USING ("group", metric) GROUP BY 1, 2, 3),
    f AS (SELECT b.*, m.headline IS NULL AS plain FROM b JOIN dim_metric m USING (metric) LEFT JOIN bears r USING (place, metric) WHERE m.accumulates OR r.rise IS NOT NULL OR EXISTS (SELECT 1 FROM every_reason w WHERE w.place = b.place AND w.metric = b.metric)),
    p AS (SELECT "group", place, arg_min(metric, row(-n, plain, metric)) AS metric, 0 AS part, min(row(-n::DOUBLE, plain, metric)) AS o FROM f GROUP BY 1, 2),
    e AS (SELECT DISTINCT g."group", s.place, NULL AS metric, 1 AS part, row(-round(s.score, 9), false, NULL::VARCHAR) AS o FROM g JOIN (SELECT DISTINCT place, county_id FROM bears) c USING (county_id) JOIN every_score s USING (place)
      WHERE s.place IN (SELECT place FROM every_reason WHERE kind = 'event') AND NOT EXISTS (SELECT 1 FROM p WHERE p."group" = g."group" AND p.place = s.place)),
    r AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY CASE WHEN place IN (SELECT place FROM every_reason) THEN 0 ELSE 1 END, part, o, place) AS rank FROM (SELECT * FROM p UNION ALL SELECT * FROM e))
    SELECT "group", place, metric, rank FROM r WHERE rank <= 4""")
table_sql("group_rank", """SELECT "group", max(coalesce(relevance, 0)) + CASE WHEN "group" IN (SELECT "group" FROM news_links) THEN 0.3 ELSE 0 END::DOUBLE + 0.05::DOUBLE * (count(*) - 1) AS score FROM story_groups JOIN items USING (item_id) GROUP BY 1 ORDER BY score DESC, "group" LIMIT 7""")
table_sql("shown_links", """SELECT DISTINCT place FROM news_links WHERE "group" IN (SELECT "group" FROM group_rank)""")


def place_readings(spark, sf):
    r = recent(spark, sf)
    tops = r.groupBy(F.col("sensor_id").alias("place"), "county_id", "metric").agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.coalesce(F.max(O.period_hours("period") < 6), F.lit(False)).alias("is_rate"))
    return N.bearing(tops, WD.rise_rows(spark, sf), A.dim_metric(spark))


def news_links(spark, sf, why, st):
    g = N.group_stories(st).join(st.select("item_id", "counties", "measures"), "item_id")
    counties = g.select("group", F.explode("counties").alias("county_id")).distinct()
    named = g.select("group", "item_id", F.explode("measures").alias("metric")).groupBy("group", "metric").agg(F.count_distinct("item_id").alias("n"))
    return N.link_news(counties, named, place_readings(spark, sf), why, N.place_scores(why), A.dim_metric(spark))


def ranked_stories(spark, sf, st, links):
    """Groups with their best relevance, size, and whether a reading bears them out."""
    g = N.group_stories(st).join(A.items(spark, sf).select("item_id", "relevance"), "item_id").groupBy("group").agg(F.max(F.coalesce("relevance", F.lit(0))).alias("relevance"), F.count(F.lit(1)).alias("n"))
    return g.join(links.select("group", F.lit(True).alias("_l")).distinct(), "group", "left").withColumn("linked", F.coalesce("_l", F.lit(False)))


@query("j15_link_news_to_readings", 'SELECT "group", place, metric, rank FROM news_links')
def j15(spark, sf):
    return news_links(spark, sf, all_reasons(spark, sf), checkpointed(story_rows(spark, sf))).select("group", "place", "metric", F.col("rank").cast("long").alias("rank"))


def label_rows(spark, sf, why, score):
    """Places with a reason of their own: what leads, whether it is a headline of the state, and the score with news."""
    head = F.max(F.col("kind").isin(*N.HEADLINE_KINDS) & (F.col("weight") >= N.W_HEADLINE))
    lead = why.groupBy("place").agg(F.max_by(F.struct("metric", "topic", "kind"), F.struct(F.round("weight", 6), "metric", "kind")).alias("l"), head.alias("headline"))
    s = A.sensors(spark, sf).select(F.col("sensor_id").alias("place"), "lat", "lon")
    return lead.join(score, "place").join(s, "place").select("place", "l.topic", "l.metric", "l.kind", "headline", F.round("score", 6).alias("score"), "lat", "lon")


_KM = hav("{t}.lat", "{t}.lon", "c.lat", "c.lon")
_FAR = "NOT EXISTS (SELECT 1 FROM {c} c WHERE c.metric = t.metric AND " + _KM.format(t="t") + f" < {N.TWIN_KM})"
_COLS = "place, topic, metric, what, score, lat, lon"
_BEST = "SELECT " + _COLS + " FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY score DESC, place) AS rn FROM {t} t WHERE {w}) WHERE rn <= {n}"
_ROOM = "SELECT " + _COLS + ", {s} AS step FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, place) AS rn FROM {t}) t WHERE rn + (SELECT count(*) FROM {c} c WHERE c.topic = t.topic) <= 3"
table_sql("label_rows", f"""WITH s AS (SELECT place, sum(w) AS score FROM (SELECT place, kind, max(weight) AS w FROM (SELECT place, kind, weight FROM every_reason UNION ALL SELECT place, 'news', 0.4::DOUBLE FROM shown_links) GROUP BY 1, 2) GROUP BY 1),
    l AS (SELECT place, arg_max(row(topic, metric, kind), row(round(weight, 6), metric, kind)) AS l, bool_or(kind IN ('max', 'min', 'rise') AND weight >= {N.W_HEADLINE}::DOUBLE) AS headline FROM every_reason GROUP BY 1)
    SELECT place, l[1] AS topic, l[2] AS metric, l[1] || '|' || l[2] || '|' || CASE WHEN l[3] IN ('max', 'min', 'rise') THEN l[3] ELSE 'other' END AS what, headline, round(score, 6) AS score, lat, lon
    FROM l JOIN s USING (place) JOIN sensors ON sensor_id = place""")
table_sql("labels_worth", f"SELECT * FROM label_rows WHERE score >= {N.MIN_LABELLED}")
table_sql("labels_first", _BEST.format(k="topic", t="labels_worth", w="headline", n=3))
table_sql("labels_new", _BEST.format(k="what", t="labels_worth", w="what NOT IN (SELECT what FROM labels_first)", n=1))
table_sql("labels_two", f"SELECT *, 1 AS step FROM labels_first UNION ALL {_ROOM.format(s=2, t='labels_new', c='labels_first')}")
table_sql("labels_left", f"SELECT {_COLS} FROM labels_worth t WHERE place NOT IN (SELECT place FROM labels_two) AND {_FAR.format(c='labels_two')}")
table_sql("labels_a", _BEST.format(k="metric", t="labels_left", w="true", n=1))
table_sql("labels_b", _BEST.format(k="metric", t="labels_left", w=_FAR.format(c="labels_a"), n=1))
table_sql("labels_c", _BEST.format(k="metric", t="labels_left", w=_FAR.format(c="labels_a") + " AND " + _FAR.format(c="labels_b"), n=1))
table_sql("labels_rest", f"SELECT {_COLS} FROM labels_a UNION ALL SELECT {_COLS} FROM labels_b UNION ALL SELECT {_COLS} FROM labels_c")
table_sql("labels_shown", f"""SELECT place, rank FROM (SELECT place, row_number() OVER (ORDER BY step, score DESC, place) AS rank FROM (SELECT * FROM labels_two UNION ALL {_ROOM.format(s=3, t='labels_rest', c='labels_two')}))
    WHERE rank <= {N.LABELLED}""")


@query("t5_pick_labels", f"""SELECT place, 1 AS tier, rank::INTEGER AS rank FROM labels_shown UNION ALL SELECT place, 2, NULL FROM (SELECT place, row_number() OVER (ORDER BY score DESC, place) AS dot FROM label_rows
    WHERE place NOT IN (SELECT place FROM labels_shown)) WHERE dot <= {N.DOTS} OR place IN (SELECT place FROM shown_links)""")
def t5(spark, sf):
    why, shown = shown_news(spark, sf)
    return N.pick_labels(label_rows(spark, sf, why, N.place_scores(why.unionByName(N.news_reasons(shown)))), shown)



@query("j15_statewide_links", f"""WITH b AS (SELECT metric, {_SAYS} AS place FROM bears WHERE place IN (SELECT place FROM every_reason) GROUP BY 1),
    f AS (SELECT s.item_id, b.place, min(row(m.headline IS NULL, b.metric)) AS o, arg_min(b.metric, row(m.headline IS NULL, b.metric)) AS metric FROM ({SQL['j14_measures_in_text']}) s JOIN b USING (metric) JOIN dim_metric m USING (metric)
      WHERE s.item_id NOT IN (SELECT item_id FROM story_sets) AND EXISTS (SELECT 1 FROM every_reason w WHERE w.place = b.place AND w.metric = b.metric) GROUP BY 1, 2)
    SELECT item_id, place, metric, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY o, place) AS rank FROM f) WHERE rank <= 4""")
def j15_wide(spark, sf):
    t = titled(spark, sf)
    m = TX.measures_in_text(t, "item_id", F.col("headline"), spark.createDataFrame(NEWS, "metric string, name string"), 2)
    wide = m.join(story_rows(spark, sf).select("item_id"), "item_id", "left_anti").select("item_id", "metric").distinct()
    return N.link_statewide(wide, place_readings(spark, sf), all_reasons(spark, sf), A.dim_metric(spark)).select("item_id", "place", "metric", F.col("rank").cast("long").alias("rank"))


@query("t6_group_stories_ranked", 'SELECT "group", round(score, 6) AS score FROM group_rank')
def t6(spark, sf):
    st = checkpointed(story_rows(spark, sf))
    return N.rank_groups(ranked_stories(spark, sf, st, checkpointed(news_links(spark, sf, all_reasons(spark, sf), st)))).select("group", F.round("score", 6).alias("score"))


@query("t6_statewide_variety", """WITH r AS (SELECT item_id, topic, relevance + CASE WHEN item_id % 3 = 0 THEN 0.2 ELSE 0 END::DOUBLE AS score FROM items WHERE relevance IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, item_id) AS rn FROM r) SELECT item_id, topic FROM k ORDER BY CASE WHEN rn = 1 THEN 0 ELSE 1 END, score DESC, item_id LIMIT 3""")
def t6v(spark, sf):
    s = A.items(spark, sf).filter("relevance is not null").withColumn("score", F.col("relevance") + F.when(F.col("item_id") % 3 == 0, 0.2).otherwise(0.0))
    return N.statewide_variety(s).select("item_id", "topic")


# ── graph ──

H = "'sensor:s-' || substr(sha1(CAST({c} AS VARCHAR)), 1, 5)"
table_sql("kept", f"SELECT sensor_id FROM (SELECT sensor_id, count(*) AS n FROM assessed WHERE kind IN {PEOPLE} GROUP BY 1 ORDER BY n DESC, sensor_id LIMIT 200)")


@query("a29_graph_nodes", f"""SELECT 'topic:' || topic AS id, 'topic' AS kind, count(*) AS n FROM assessed GROUP BY 1 UNION ALL SELECT 'metric:' || metric, 'metric', count(*) FROM assessed GROUP BY 1
    UNION ALL SELECT {H.format(c='sensor_id')}, 'sensor', count(*) FROM assessed WHERE sensor_id IN (SELECT sensor_id FROM kept) GROUP BY sensor_id
    UNION ALL SELECT 'county:' || county_id, 'county', count(*) FROM assessed WHERE sensor_id IN (SELECT sensor_id FROM kept) GROUP BY 1
    UNION ALL SELECT 'feed:' || source, 'feed', count(*) FROM assessed WHERE kind NOT IN {PEOPLE} GROUP BY 1 UNION ALL SELECT 'event:' || event_id, 'event', n_signals FROM event_rows""")
def a29n(spark, sf):
    s = A.assessed(spark, sf)
    return N.graph_nodes(s, A.dim_metric(spark), events(spark, sf), N.busiest_people(s))


@query("a29_graph_edges", f"""WITH p AS (SELECT * FROM assessed WHERE kind IN {PEOPLE} AND sensor_id IN (SELECT sensor_id FROM kept)),
    d AS (SELECT DISTINCT metric, county_id, CAST(observed_at AS DATE) AS dd, sensor_id FROM p WHERE quality = 'corroborated')
    SELECT 'metric:' || metric AS source, 'topic:' || topic AS target, 'belongs' AS kind, 1 AS weight FROM dim_metric
    UNION ALL SELECT 'feed:' || source, 'metric:' || metric, 'reports', count(*) FROM assessed WHERE kind NOT IN {PEOPLE} GROUP BY 1, 2
    UNION ALL SELECT {H.format(c='sensor_id')}, 'metric:' || metric, 'reports', count(*) FROM p GROUP BY sensor_id, metric
    UNION ALL SELECT {H.format(c='sensor_id')}, 'county:' || county_id, 'home', 1 FROM p GROUP BY sensor_id, county_id
    UNION ALL SELECT {H.format(c='a.sensor_id')}, {H.format(c='b.sensor_id')}, 'corroborated', count(*) FROM d a JOIN d b ON a.metric = b.metric AND a.county_id = b.county_id AND a.dd = b.dd AND a.sensor_id < b.sensor_id GROUP BY a.sensor_id, b.sensor_id
    UNION ALL SELECT 'event:' || event_id, 'metric:' || metric, 'about', 1 FROM event_rows UNION ALL SELECT 'event:' || event_id, 'county:' || county_id, 'in', 1 FROM event_rows""")
def a29e(spark, sf):
    s = A.assessed(spark, sf)
    return N.graph_edges(s, A.dim_metric(spark), events(spark, sf), N.busiest_people(s))
