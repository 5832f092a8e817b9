"""Events, alert threads and storms on the adapter tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gossamer.catalog import joins as J
from gossamer.catalog.aggregates import events, members
from gossamer.catalog.filters import NOW, now
from gossamer.catalog.registry import query, table_sql
from gossamer.operators import corroborate as C
from gossamer.operators import events as E
from gossamer.operators import stories as ST
from gossamer.operators import threads as TH
from gossamer.plans.components import resolve_pointers
from gossamer.session import checkpointed
from gossamer.sources import adapter as A

us = F.unix_micros
PEOPLE, REFS = J.PEOPLE, J.REFS


@query("g1_events", "SELECT event_id, topic, metric, county_id, opened_us, updated_us, n_signals, peak, severity, status FROM event_rows")
def g1(spark, sf):
    return events(spark, sf).select("event_id", "topic", "metric", "county_id", us("opened_at").alias("opened_us"), us("updated_at").alias("updated_us"),
                                    "n_signals", "peak", "severity", "status")


@query("g1_event_members", "SELECT seq, event_id FROM event_members")
def g1m(spark, sf):
    return members(spark, sf).select("seq", "event_id")


table_sql("trust_rows", f"""SELECT sensor_id, coalesce(topic, '*') AS topic, (2 + agree) / (4 + agree + disagree) AS trust FROM (
    SELECT sensor_id, topic, sum(agree*{J.FADE}) AS agree, sum(disagree*{J.FADE}) AS disagree FROM outcomes WHERE agree > 0 OR disagree > 0
    GROUP BY GROUPING SETS ((sensor_id, topic), (sensor_id)))""")
table_sql("member_trust", """SELECT m.*, coalesce(t.trust, p.trust, 0.5) AS trust FROM event_members m LEFT JOIN trust_rows t ON t.sensor_id = m.sensor_id AND t.topic = m.topic
    LEFT JOIN trust_rows p ON p.sensor_id = m.sensor_id AND p.topic = '*'""")
table_sql("event_stat", f"""SELECT event_id, count(*) AS n_signals, count(DISTINCT sensor_id) AS n_sensors, count(*) FILTER (kind IN {REFS}) AS n_reference,
    count(DISTINCT sensor_id) FILTER (kind IN {REFS}) AS n_reference_sensors, avg(trust) AS mean_trust, max(value) AS max_value, min(value) AS min_value,
    max(severity) AS severity FROM member_trust GROUP BY 1""")
table_sql("wit", f"""SELECT event_id, count(DISTINCT sensor_id) FILTER (kind IN {REFS} OR "precision" <> 'point')
    + count(DISTINCT row(lat, lon)) FILTER (kind IN {PEOPLE} AND "precision" = 'point') AS witnesses FROM event_members GROUP BY 1""")
table_sql("scored", """SELECT e.*, greatest(1, witnesses) AS witnesses, r.reference,
    round_even(e.severity * (1 + 0.5::DOUBLE * ln(greatest(1, witnesses))) * least(2.0::DOUBLE, greatest(0.4::DOUBLE, mean_trust / 0.5::DOUBLE))
     * CASE WHEN n_reference >= 1 OR r.reference = 'agree' THEN 1.25::DOUBLE WHEN r.reference = 'disagree' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END, 3) AS score,
    witnesses >= 2 OR n_reference >= 1 OR mean_trust >= 0.8 OR r.reference = 'agree' AS verified
    FROM event_stat e JOIN wit USING (event_id) JOIN (SELECT event_id, arg_max(a.reference, m.seq) AS reference FROM event_members m JOIN arrival a USING (seq) GROUP BY 1) r USING (event_id)""")


def trust_table(spark, sf, ar=None):
    return C.pooled_trust(J.outcome_rows(spark, sf, ar), A.sensors(spark, sf), now(spark, sf))


def trusted_members(spark, sf):
    """Members combined per sensor with their trust, written once: stats, witnesses and scores all read it."""
    ar = checkpointed(J.arrival(spark, sf))
    trust = trust_table(spark, sf, ar)
    return checkpointed(E.sensor_trust(E.per_sensor(members(spark, sf).join(ar.select("seq", "reference"), "seq")), trust))


@query("a6_event_stats", """SELECT event_id, n_signals, n_sensors, n_reference, n_reference_sensors, round(mean_trust, 6) AS mean_trust, max_value, min_value FROM event_stat""")
def a6(spark, sf):
    st = E.event_stats(trusted_members(spark, sf))
    return st.select("event_id", "n_signals", "n_sensors", "n_reference", "n_reference_sensors", F.round("mean_trust", 6).alias("mean_trust"), "max_value", "min_value")


@query("j17_event_attach_join", "SELECT seq, event_id, sensor_id, round(trust, 6) AS trust FROM member_trust")
def j17(spark, sf):
    trust = trust_table(spark, sf)
    return E.sensor_trust(members(spark, sf), trust).select("seq", "event_id", "sensor_id", F.round("trust", 6).alias("trust"))


@query("a7_witnesses", "SELECT event_id, witnesses FROM wit")
def a7(spark, sf):
    return E.witnesses(E.per_sensor(members(spark, sf)))


def scored(spark, sf):
    rows = trusted_members(spark, sf)
    return E.scored_events(E.event_stats(rows), E.witnesses(rows))


@query("a8_score_event", "SELECT event_id, witnesses, reference, round(score, 3) AS score, verified FROM scored")
def a8(spark, sf):
    return scored(spark, sf).select("event_id", F.col("witnesses").cast("long").alias("witnesses"), "reference", F.round("score", 3).alias("score"), "verified")


@query("x32_verified", "SELECT event_id, n_sensors >= 2 OR n_reference >= 1 OR mean_trust >= 0.8 AS verified FROM event_stat")
def x32(spark, sf):
    from gossamer.functions.scalars import verified

    return E.event_stats(trusted_members(spark, sf)).select("event_id", verified("n_sensors", "n_reference", "mean_trust").alias("verified"))


@query("t1_events_ranked", "SELECT event_id, round(score, 3) AS score FROM scored JOIN event_rows USING (event_id) ORDER BY score DESC, updated_us DESC, event_id LIMIT 50")
def t1(spark, sf):
    ev = events(spark, sf).select("event_id", "updated_at")
    return scored(spark, sf).select("event_id", "score").join(ev, "event_id").orderBy(F.desc("score"), F.desc("updated_at"), "event_id").limit(50).select(
        "event_id", F.round("score", 3).alias("score"))


# running score of an event after each member: severity so far x corroboration so far
table_sql("path", f"""SELECT event_id, seq, max(severity) OVER w * (1 + 0.5::DOUBLE * ln(sum(CASE WHEN firsts = 1 THEN 1 ELSE 0 END) OVER w))
    * CASE WHEN sum(CASE WHEN kind IN {REFS} THEN 1 ELSE 0 END) OVER w >= 1 THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END AS score,
    sum(CASE WHEN firsts = 1 THEN 1 ELSE 0 END) OVER w >= 2 OR sum(CASE WHEN kind IN {REFS} THEN 1 ELSE 0 END) OVER w >= 1 AS verified
    FROM (SELECT *, row_number() OVER (PARTITION BY event_id, sensor_id ORDER BY seq) AS firsts FROM event_members)
    WINDOW w AS (PARTITION BY event_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""")


def score_path(spark, sf):
    return E.score_path(members(spark, sf))


@query("w10_push_decision", """WITH RECURSIVE c AS (SELECT event_id, seq, round(score, 9) AS score FROM path WHERE verified AND round(score, 9) >= 0.6),
    p AS (SELECT event_id, min(seq) AS seq, arg_min(score, seq) AS score, 'new' AS reason FROM c GROUP BY 1
      UNION ALL (SELECT p.event_id, min(c.seq), arg_min(c.score, c.seq), 'escalated' FROM p JOIN c ON c.event_id = p.event_id AND c.seq > p.seq AND c.score >= p.score * 1.4 GROUP BY 1))
    SELECT event_id, seq, round(score, 6) AS score, reason FROM p""")
def w10(spark, sf):
    sc = score_path(spark, sf).withColumn("score", F.round("score", 9))
    return E.push_decisions(sc, min_score=0.6).withColumn("score", F.round("score", 6))


@query("j33_event_source", """SELECT event_id, arg_min(seq, row(CASE kind WHEN 'authority' THEN 0 WHEN 'official' THEN 1 WHEN 'station' THEN 2 ELSE 3 END, url IS NULL, -epoch_us(observed_at), -seq)) AS seq
    FROM (SELECT *, CASE WHEN seq % 3 = 0 THEN 'https://x/' || seq END AS url FROM event_members) GROUP BY 1""")
def j33(spark, sf):
    m = members(spark, sf).withColumn("url", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("https://x/"), F.col("seq").cast("string"))))
    return E.event_source(m).select("event_id", "seq")


# ── alert threads ──

table_sql("closure", """SELECT alert_id, thread_id FROM (WITH RECURSIVE up AS (SELECT alert_id, alert_id AS root, ref_id FROM alerts
    UNION ALL SELECT up.alert_id, a.alert_id, a.ref_id FROM up JOIN alerts a ON a.alert_id = up.ref_id) SELECT alert_id, min(root) AS thread_id FROM up GROUP BY 1)""")


def threads(spark, sf):
    al = A.alerts(spark, sf)
    return al, TH.alert_threads(al)


@query("g2_alert_threads", "SELECT alert_id, thread_id FROM closure")
def g2(spark, sf):
    return threads(spark, sf)[1]


table_sql("thread_tab", f"""SELECT thread_id, arg_max(alert_id, row(sent, alert_id)) AS current_id, arg_max(severity, row(sent, alert_id)) AS severity, min(sent) AS opened_at, max(sent) AS updated_at,
    arg_max(expires, row(sent, alert_id)) AS expires, count(*) AS n_messages, list_sort(list(DISTINCT county_id)) AS counties FROM alerts JOIN closure USING (alert_id) GROUP BY 1""")


@query("g2_thread_rows", f"""SELECT thread_id, current_id, severity, epoch_us(opened_at) AS opened_us, epoch_us(updated_at) AS updated_us, n_messages,
    CASE WHEN expires <= {NOW} THEN 'ended' ELSE 'active' END AS status FROM thread_tab""")
def g2r(spark, sf):
    al, th = threads(spark, sf)
    return TH.thread_rows(al, th, now(spark, sf)).select("thread_id", "current_id", "severity", us("opened_at").alias("opened_us"),
                                                         us("updated_at").alias("updated_us"), "n_messages", "status")


@query("f19_ended_for_county", f"""SELECT thread_id FROM thread_tab WHERE expires <= {NOW} AND expires >= {NOW} - INTERVAL 240 HOURS AND list_contains(counties, '3')""")
def f19(spark, sf):
    from gossamer.operators.filters import ended_for_county

    al, th = threads(spark, sf)
    n = now(spark, sf)
    return ended_for_county(TH.thread_rows(al, th, n), "3", n, 240).select("thread_id")


# fetch manifests: one an hour in which something was viewed, but for each seventh; every fifth is empty. An alert is listed now and then until its last hour
table_sql("manifests", """SELECT h * 3600000000 AS f, CASE WHEN h % 5 = 0 THEN 0 ELSE 1 END AS n_ids FROM (SELECT DISTINCT epoch_us(ts) // 3600000000 AS h FROM events WHERE event_type = 'view') WHERE h % 7 <> 0""")
table_sql("life_threads", """SELECT alert_id AS thread_id, epoch_us(sent) AS u, epoch_us(sent) + (4 + alert_id % 5) * 3600000000 AS x FROM alert_rows WHERE alert_id % 3 = 0""")
table_sql("presence", """SELECT alert_id, f FROM alert_rows, range(1, 6) r(k), LATERAL (SELECT (epoch_us(sent) // 3600000000 + k) * 3600000000 AS f) JOIN manifests USING (f) WHERE n_ids > 0 AND k <= 1 + alert_id % 5 AND (alert_id + k) % 4 <> 0""")
_PUT = "{{'id': a.id, 'u': a.u, 'x': a.x, 'seen': a.seen, 'missing': {m}, 'ended': {e}, 'why': {w}}}"
_MARK = _PUT.format(e="a.ended", w="a.why", m="CASE WHEN a.ended IS NOT NULL OR a.u >= f OR NOT (n_ids > 0 OR force < 3) THEN a.missing WHEN list_contains(a.seen, f) THEN NULL ELSE coalesce(a.missing, f) END")
_END = _PUT.format(m="a.missing", e="CASE WHEN a.ended IS NOT NULL THEN a.ended WHEN a.x <= f OR f - a.missing >= 90000000 THEN f END", w="CASE WHEN a.ended IS NOT NULL THEN a.why WHEN a.x <= f THEN 'expired' WHEN f - a.missing >= 90000000 THEN 'cancelled' END")


# the fold itself, fetch by fetch, over the list of threads; those long over are left out of the next step's list
@query("g3_thread_lifecycle", f"""WITH RECURSIVE polls AS (SELECT f, n_ids, row_number() OVER (ORDER BY f) AS k FROM manifests),
    begun AS (SELECT thread_id AS id, u, x, coalesce(seen, []) AS seen FROM life_threads LEFT JOIN (SELECT alert_id AS thread_id, list(f) AS seen FROM presence GROUP BY 1) USING (thread_id)),
    joins AS (SELECT k, list({{'id': id, 'u': u, 'x': x, 'seen': seen, 'missing': NULL::BIGINT, 'ended': NULL::BIGINT, 'why': NULL::VARCHAR}}) AS s FROM begun JOIN polls ON polls.f >= u AND NOT EXISTS (SELECT 1 FROM polls g WHERE g.k = polls.k - 1 AND g.f >= u) GROUP BY 1),
    step AS (SELECT 0::BIGINT AS k, CAST([] AS STRUCT(id BIGINT, u BIGINT, x BIGINT, seen BIGINT[], missing BIGINT, ended BIGINT, why VARCHAR)[]) AS s
      UNION ALL SELECT k, list_transform(list_transform(s, lambda a: {_MARK}), lambda a: {_END}) FROM (SELECT k, f, n_ids, s, len(list_filter(s, lambda a: a.x > f)) AS force FROM (SELECT polls.*, list_concat(list_filter(step.s, lambda a: a.ended IS NULL), coalesce(joins.s, [])) AS s
        FROM step JOIN polls ON polls.k = step.k + 1 LEFT JOIN joins ON joins.k = polls.k))),
    settled AS (SELECT unnest(s, recursive := true) FROM step)
    SELECT thread_id, why AS reason, ended AS ended_us FROM life_threads LEFT JOIN (SELECT id AS thread_id, why, ended FROM settled WHERE ended IS NOT NULL) USING (thread_id)""")
def g3(spark, sf):
    return TH.thread_lifecycle(*fetched_threads(spark, sf))


def fetched_threads(spark, sf):
    """Threads, manifests and sightings of ``life_threads``, ``manifests`` and ``presence``."""
    hour, k = F.lit(3600 * 10**6).cast("long"), F.col("alert_id")
    h = A.table(spark, sf, "events").filter("event_type = 'view'").select(F.floor(us("ts") / hour).alias("h")).distinct().filter("h % 7 <> 0")
    fetches = h.select(F.timestamp_micros(F.col("h") * hour).alias("fetch_at"), F.when(F.col("h") % 5 == 0, 0).otherwise(1).alias("n_ids"))
    al = A.alert_rows(spark, sf)
    seen = al.select("alert_id", "sent", F.explode(F.sequence(F.lit(1), (1 + k % 5).cast("int"))).alias("i")).filter((k + F.col("i")) % 4 != 0)
    seen = seen.select("alert_id", F.timestamp_micros((F.floor(us("sent") / hour) + F.col("i")) * hour).alias("fetch_at")).join(fetches.filter("n_ids > 0").select("fetch_at"), "fetch_at", "left_semi")
    th = al.filter(k % 3 == 0).select(k.alias("thread_id"), k.alias("current_id"), F.col("sent").alias("updated_at"), F.timestamp_micros(us("sent") + (4 + k % 5) * hour).alias("expires"))
    return th, fetches, seen


@query("g4_impact_rises", """WITH v AS (SELECT a.alert_id, thread_id, sent, 'wind' AS tag, NULL AS "level", CAST(alert_id % 60 AS DOUBLE) AS value FROM alerts a JOIN closure USING (alert_id)
     UNION ALL SELECT a.alert_id, thread_id, sent, 'threat', CAST(alert_id % 3 AS INTEGER), NULL FROM alerts a JOIN closure USING (alert_id))
    SELECT alert_id, tag FROM (SELECT *, lag("level") OVER w AS pl, lag(value) OVER w AS pv, row_number() OVER w AS rn FROM v WINDOW w AS (PARTITION BY thread_id, tag ORDER BY sent, alert_id))
    WHERE CASE WHEN tag = 'threat' THEN pl IS NULL OR "level" > pl ELSE pv IS NULL OR value > pv END""")
def g4(spark, sf):
    al, th = threads(spark, sf)
    m = al.select("alert_id", "sent").join(th, "alert_id")
    k = F.col("alert_id")
    wind = m.withColumn("tag", F.lit("wind")).withColumn("level", F.lit(None).cast("int")).withColumn("value", (k % 60).cast("double"))
    threat = m.withColumn("tag", F.lit("threat")).withColumn("level", (k % 3).cast("int")).withColumn("value", F.lit(None).cast("double"))
    return TH.impact_rises(wind.unionByName(threat)).select("alert_id", "tag")


@query("g4_severity_rises", """SELECT alert_id, CASE WHEN ev <> pe AND severity >= ps THEN 'event' ELSE 'severity' END AS change FROM (
    SELECT alert_id, 'Kind ' || (alert_id % 5) AS ev, severity, lag('Kind ' || (alert_id % 5)) OVER w AS pe, lag(severity) OVER w AS ps FROM alerts JOIN closure USING (alert_id)
    WINDOW w AS (PARTITION BY thread_id ORDER BY sent, alert_id)) WHERE (ev <> pe AND severity >= ps) OR severity > ps""")
def g4s(spark, sf):
    al, th = threads(spark, sf)
    m = al.select("alert_id", "sent", "severity", F.concat(F.lit("Kind "), (F.col("alert_id") % 5).cast("string")).alias("event")).join(th, "alert_id")
    return TH.severity_rises(m).select("alert_id", "change")


@query("u4_first_per_group", f"""SELECT group_key, arg_max(alert_id, row(severity, sent, alert_id)) AS alert_id, max(severity) AS severity, array_to_string(list_sort(list(name)), ';') AS counties
    FROM alert_rows JOIN dim_county USING (county_id) WHERE expires > {NOW} - INTERVAL 48 HOURS GROUP BY 1""")
def u4(spark, sf):
    from gossamer.operators.filters import hours_before

    return TH.first_per_group(A.alert_rows(spark, sf), A.dim_county(spark, sf), hours_before(now(spark, sf), 48)).select(
        "group_key", "alert_id", "severity", F.array_join("counties", ";").alias("counties"))


@query("w11_card_change", """SELECT alert_id, txt FROM (SELECT alert_id, 'sev ' || severity AS txt, lag('sev ' || severity) OVER (PARTITION BY thread_id ORDER BY sent, alert_id) AS prev
    FROM alerts JOIN closure USING (alert_id)) WHERE prev IS NULL OR prev <> txt""")
def w11(spark, sf):
    al, th = threads(spark, sf)
    m = al.select("alert_id", "sent", F.concat(F.lit("sev "), F.col("severity").cast("string")).alias("txt")).join(th, "alert_id")
    return TH.card_changes(m, "thread_id", "sent", "alert_id", "txt").select("alert_id", "txt")


@query("g6_resolve_merged", """SELECT node, min(root) AS root FROM (WITH RECURSIVE up AS (SELECT alert_id AS node, alert_id AS root, ref_id FROM alerts
    UNION ALL SELECT up.node, a.alert_id, a.ref_id FROM up JOIN alerts a ON a.alert_id = up.ref_id) SELECT node, root FROM up WHERE ref_id IS NULL) GROUP BY 1""")
def g6(spark, sf):
    return resolve_pointers(A.alerts(spark, sf), "alert_id", "ref_id")


# ── storms ──

LINK = f"""a.topic = b.topic AND a.ref < b.ref AND abs(epoch_us(a.observed_at) - epoch_us(b.observed_at)) <= 10800000000 AND {J.hav('a.lat','a.lon','b.lat','b.lon')} <= 60"""


def roots_sql(pts: str) -> tuple[str, str]:
    return (f"SELECT a.ref AS u, b.ref AS v FROM {pts} a JOIN {pts} b ON {LINK}",
            f"""SELECT ref, min(r) AS story_id FROM (WITH RECURSIVE reach AS (SELECT ref, ref AS r FROM {pts}
    UNION SELECT CASE WHEN l.u = reach.ref THEN l.v ELSE l.u END, reach.r FROM reach JOIN {pts}_links l ON l.u = reach.ref OR l.v = reach.ref) SELECT * FROM reach) GROUP BY 1""")


# members of storms: events where and when they opened, and warnings at their county's centre
table_sql("storm_pts", """SELECT 'event:' || event_id AS ref, topic, arg_min(lat, seq) AS lat, arg_min(lon, seq) AS lon, min(observed_at) AS observed_at, max(severity) AS severity FROM event_members GROUP BY event_id, topic
    UNION ALL SELECT 'alert:' || alert_id, 'ops', c.lat, c.lon, sent, a.severity / 4.0::DOUBLE FROM alert_rows a JOIN dim_county c USING (county_id)""")
table_sql("cross_pts", "SELECT seq AS ref, topic, lat, lon, observed_at, severity FROM crossings")
for _pts, _roots in (("storm_pts", "storm_roots"), ("cross_pts", "cross_roots")):
    _l, _r = roots_sql(_pts)
    table_sql(f"{_pts}_links", _l)
    table_sql(_roots, _r)


def storm_members(spark, sf):
    ev = events(spark, sf).select(F.concat(F.lit("event:"), "event_id").alias("ref"), "topic", "lat", "lon", F.col("opened_at").alias("observed_at"), "severity")
    c = A.dim_county(spark, sf).select("county_id", "lat", "lon")
    al = A.alert_rows(spark, sf).join(c, "county_id").select(F.concat(F.lit("alert:"), F.col("alert_id").cast("string")).alias("ref"), F.lit("ops").alias("topic"), "lat", "lon",
                                                             F.col("sent").alias("observed_at"), (F.col("severity") / 4.0).alias("severity"))
    return ev.unionByName(al)


def crossing_points(spark, sf):
    from gossamer.operators.filters import crossings

    c = crossings(A.signals(spark, sf).join(F.broadcast(A.dim_metric(spark).drop("topic")), "metric"))
    return c.select(F.col("seq").alias("ref"), "topic", "lat", "lon", "observed_at", "severity")


@query("g5_stories_components", "SELECT ref, story_id FROM storm_roots")
def g5c(spark, sf):
    return ST.stories_components(storm_members(spark, sf)).select("ref", "story_id")


@query("g5_stories_replay")
def g5r(spark, sf):
    return ST.stories_replay(storm_members(spark, sf))


@query("t2_stories_ranked", """SELECT topic, story_id, count(*) AS n_members, max(severity) AS severity FROM storm_pts JOIN storm_roots USING (ref) GROUP BY 1, 2
    ORDER BY severity DESC, max(observed_at) DESC, story_id LIMIT 20""")
def t2(spark, sf):
    rows = ST.story_rows(ST.stories_components(storm_members(spark, sf)))
    return ST.stories_ranked(rows, 20).select("topic", "story_id", "n_members", "severity")


@query("j34_story_of_event", "SELECT event_id, story_id FROM event_rows e JOIN storm_roots r ON r.ref = 'event:' || e.event_id")
def j34(spark, sf):
    return ST.story_of_event(events(spark, sf).select("event_id"), ST.stories_components(storm_members(spark, sf)))


FACTS = """(SELECT story_id, 0 AS part, epoch_us(sent)::DOUBLE AS "key", CAST(alert_id AS VARCHAR) AS id FROM alert_rows a JOIN storm_roots r ON r.ref = 'alert:' || a.alert_id
    UNION ALL SELECT story_id, 1, rk::DOUBLE, event_id FROM (SELECT story_id, event_id, row_number() OVER (PARTITION BY story_id ORDER BY severity DESC, event_id) AS rk FROM (
    SELECT story_id, event_id, severity FROM event_rows e JOIN storm_roots r ON r.ref = 'event:' || e.event_id)) WHERE rk <= 5)"""


def facts(spark, sf):
    return ST.storm_facts(ST.stories_components(storm_members(spark, sf)), events(spark, sf).select("event_id", "severity"), A.alert_rows(spark, sf).select("alert_id", "sent"))


@query("a34_storm_facts", f'SELECT story_id, part, "key", id FROM {FACTS}')
def a34(spark, sf):
    return facts(spark, sf)


@query("x37_template_brief", f"""SELECT story_id, string_agg(CASE part WHEN 0 THEN 'alert ' ELSE 'event ' END || id, '; ' ORDER BY part, "key", id) AS brief FROM {FACTS} GROUP BY 1""")
def x37(spark, sf):
    return ST.template_brief(facts(spark, sf))
