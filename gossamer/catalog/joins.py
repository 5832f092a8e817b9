"""Spatio-temporal joins, corroboration and trust on the adapter tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gossamer.catalog.registry import query, table_sql
from gossamer.operators import corroborate as C
from gossamer.session import checkpointed
from gossamer.sources import adapter as A


def hav(a, b, c, d):
    return (f"(2*6371.0088*asin(sqrt(pow(sin((radians({c})-radians({a}))/2),2) + cos(radians({a}))*cos(radians({c}))"
            f"*pow(sin(radians(({d})-({b}))/2),2))))")


PEOPLE = "('human','bot')"
REFS = "('station','official','authority')"

table_sql("pairs", f"""SELECT s.seq, s.sensor_id, s.kind, s.metric, s.topic, s.value, s.observed_at, s.period, s.precision, m.accumulates, m.is_flag,
    m.tol_abs, m.tol_rel, m.scored, o.seq AS o_seq, o.sensor_id AS o_sensor_id, o.kind AS o_kind, o.value AS o_value,
    o.observed_at AS o_observed_at, o.period AS o_period, o.precision AS o_precision, {hav('s.lat','s.lon','o.lat','o.lon')} AS km
    FROM signals s JOIN dim_metric m USING (metric) JOIN signals o ON o.metric = s.metric AND o.sensor_id <> s.sensor_id
     AND o.observed_at BETWEEN s.observed_at - to_minutes(m.window_min) AND s.observed_at + to_minutes(m.window_min)
    WHERE (o.kind IN {REFS} OR o.value BETWEEN m.lo AND m.hi)
     AND {hav('s.lat','s.lon','o.lat','o.lon')} <= m.radius_km""")
table_sql("earlier", "SELECT * FROM pairs WHERE o_seq < seq AND (NOT accumulates OR period IS NOT DISTINCT FROM o_period)")
AGREES = "(is_flag OR abs(value - o_value) <= greatest(tol_abs, tol_rel * greatest(abs(value), abs(o_value))))"
table_sql("closest", f"""SELECT *, {AGREES} AS agrees FROM (SELECT *, row_number() OVER (PARTITION BY seq, o_sensor_id
    ORDER BY abs(epoch_us(o_observed_at) - epoch_us(observed_at)), o_observed_at DESC, o_seq DESC) AS rn FROM earlier
    WHERE kind IN {PEOPLE}) WHERE rn = 1""")
table_sql("corro", f"""SELECT seq, count(*) FILTER (agrees) AS n_corroborating, count(*) FILTER (NOT agrees) AS n_contradicting,
    bool_or(agrees) FILTER (o_kind IN {REFS}) AS ref_agrees FROM closest GROUP BY seq""")
table_sql("alert_sup", f"""SELECT s.seq, arg_max(a.alert_id, row(a.severity, a.sent, a.alert_id)) AS alert_id,
    max(a.severity) AS severity FROM signals s JOIN dim_alert_support d USING (metric) JOIN standing_alerts a
    ON a.county_id = s.county_id AND a.slug = d.slug AND (a.expires IS NULL OR a.expires > s.observed_at) AND a.sent <= s.observed_at
    WHERE s.kind IN {PEOPLE} GROUP BY s.seq""")
table_sql("arrival", f"""SELECT seq, sensor_id, kind, metric, topic, observed_at, n_corr, n_contra, reference, CASE WHEN kind NOT IN {PEOPLE} THEN 'reference'
    WHEN value NOT BETWEEN lo AND hi THEN 'rejected' WHEN n_corr >= 1 OR reference = 'agree' THEN 'corroborated'
    WHEN reference = 'disagree' OR n_contra >= 2 THEN 'flagged' ELSE 'raw' END AS quality FROM (
    SELECT s.*, m.lo, m.hi, coalesce(n_corroborating, 0) AS n_corr, coalesce(n_contradicting, 0) AS n_contra,
     CASE WHEN s.kind NOT IN {PEOPLE} THEN 'none' WHEN ref_agrees THEN 'agree' WHEN NOT ref_agrees THEN 'disagree'
          WHEN u.alert_id IS NOT NULL THEN 'agree' ELSE 'none' END AS reference
    FROM signals s JOIN dim_metric m USING (metric) LEFT JOIN corro USING (seq) LEFT JOIN alert_sup u USING (seq))""")
table_sql("by_alert", f"""SELECT s.seq, arg_min(a.alert_id, row(a.sent, a.alert_id)) AS alert_id, min(a.sent) AS sent FROM crossings s
    JOIN dim_alert_support d USING (metric) JOIN standing_alerts a ON a.county_id = s.county_id AND a.slug = d.slug
    AND s.observed_at BETWEEN a.sent - to_minutes(s.window_min) AND a.sent LEFT JOIN inside i ON i.sensor_id = s.sensor_id AND i.hit = a.county_id
    WHERE s.kind IN {PEOPLE} AND (a.alert_id % 2 = 1 OR i.hit IS NOT NULL) GROUP BY s.seq""")
table_sql("by_total", f"""SELECT o.seq, arg_min(s.seq, row(s.observed_at, s.seq)) AS ref_seq, min(s.observed_at) AS ref_at FROM signals s JOIN dim_metric m USING (metric)
    JOIN signals o ON o.metric = s.metric AND o.observed_at BETWEEN s.observed_at - INTERVAL 24 HOURS AND s.observed_at
    WHERE s.kind = 'station' AND s.period = '24h' AND o.kind IN {PEOPLE} AND (o.period IS NULL OR o.period = '24h') AND o.value BETWEEN m.lo AND m.hi
     AND {hav('s.lat','s.lon','o.lat','o.lon')} <= m.radius_km
     AND (is_flag OR abs(s.value - o.value) <= greatest(tol_abs, tol_rel * greatest(abs(s.value), abs(o.value)))) GROUP BY o.seq""")
ARRIVAL = "{{'t': {}, 'o': {}, 'id': {}}}"
table_sql("evidence", f"""SELECT o_seq AS seq, {ARRIVAL.format('epoch_us(observed_at)', 0, 'seq')} AS arrival, 'corroborated' AS verdict, 'reading' AS via, weight AS agree, 0.0::DOUBLE AS disagree FROM independent
    UNION ALL SELECT o_seq, {ARRIVAL.format('epoch_us(observed_at)', 0, 'seq')}, CASE WHEN {AGREES} THEN 'corroborated' ELSE 'flagged' END, 'reference',
      CASE WHEN {AGREES} THEN 1.0 ELSE 0.0 END, CASE WHEN {AGREES} THEN 0.0 ELSE 1.0 END FROM earlier WHERE kind IN {REFS} AND o_kind IN {PEOPLE}
    UNION ALL SELECT seq, {ARRIVAL.format('epoch_us(sent)', 1, 'alert_id')}, 'corroborated', 'alert', 1.0, 0.0 FROM by_alert
    UNION ALL SELECT seq, {ARRIVAL.format('epoch_us(ref_at)', 3, 'ref_seq')}, 'corroborated', 'total', 0.5, 0.0 FROM by_total
    UNION ALL SELECT seq, {ARRIVAL.format('valid_us', 2, 'seq')}, CASE verdict WHEN 'agree' THEN 'corroborated' ELSE 'flagged' END, 'grid', CASE verdict WHEN 'agree' THEN 0.5 ELSE 0.0 END,
      CASE verdict WHEN 'agree' THEN 0.0 ELSE 1.0 END FROM verdicts JOIN as_of USING (seq) WHERE verdict IN ('agree', 'far')""")
table_sql("first_evidence", "SELECT seq, min(arrival) AS arrival, arg_min(verdict, arrival) AS verdict, arg_min(via, arrival) AS via, arg_min(agree, arrival) AS agree, arg_min(disagree, arrival) AS disagree FROM evidence GROUP BY seq")
table_sql("final", """SELECT a.*, CASE WHEN quality = 'raw' THEN e.via END AS via,
    CASE WHEN quality = 'raw' THEN coalesce(e.verdict, 'raw') ELSE quality END AS final_quality
    FROM arrival a LEFT JOIN first_evidence e USING (seq)""")
table_sql("agreed", """SELECT *, least(sensor_id, o_sensor_id) AS a, greatest(sensor_id, o_sensor_id) AS b FROM closest WHERE agrees""")
table_sql("together", f"""SELECT *, count(*) OVER (PARTITION BY a, b ORDER BY seq, o_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS together
    FROM agreed WHERE o_kind IN {PEOPLE}""")
table_sql("independent", """SELECT *, least(CASE WHEN "precision" = 'point' AND o_precision = 'point' AND km < 0.2 THEN 0.3 ELSE 1.0 END::DOUBLE,
    1.0::DOUBLE / (1.0::DOUBLE + together / 3.0::DOUBLE)) AS weight FROM together""")
table_sql("outcomes", f"""SELECT sensor_id, topic, observed_at AS happened, CASE WHEN quality <> 'corroborated' THEN 0.0 WHEN reference = 'agree' THEN 1.0
    ELSE least(1.0, coalesce(w, 0.0)) END::DOUBLE AS agree, CASE WHEN quality IN ('flagged','rejected') THEN 1.0 ELSE 0.0 END::DOUBLE AS disagree
    FROM arrival LEFT JOIN (SELECT seq, sum(weight) AS w FROM independent GROUP BY seq) USING (seq)
    WHERE kind IN {PEOPLE} AND quality IN ('corroborated','flagged','rejected')
    UNION ALL SELECT sensor_id, topic, make_timestamp(e.arrival.t), agree, disagree FROM arrival a JOIN first_evidence e USING (seq) WHERE quality = 'raw' AND kind = 'human'
    UNION ALL SELECT sensor_id, topic, make_timestamp(valid_us), 0.0, 0.5 FROM arrival a JOIN verdicts v USING (seq) JOIN as_of USING (seq) LEFT JOIN first_evidence e USING (seq)
    WHERE quality = 'raw' AND kind = 'human' AND v.verdict = 'disagree' AND (e.seq IS NULL OR (valid_us, 2, seq) < (e.arrival.t, e.arrival.o, e.arrival.id))""")
FADE = "pow(0.5, greatest(0, epoch_us((SELECT max(observed_at) FROM signals)) - epoch_us(happened)) / 86400e6 / 180.0)"
STANDING = """(4*0.5+agree)/(4+agree+disagree) AS trust"""


def _inputs(spark, sf):
    return A.signals(spark, sf), A.dim_metric(spark)


@query("j1_neighbor_pairs", """SELECT seq, o_seq, metric, round(km, 6) AS km FROM pairs""")
def j1(spark, sf):
    return C.neighbor_pairs(*_inputs(spark, sf)).select("seq", "o_seq", "metric", F.round("km", 6).alias("km"))


@query("f8_same_period", "SELECT seq, o_seq, period FROM pairs WHERE accumulates AND period IS NOT DISTINCT FROM o_period")
def f8(spark, sf):
    return C.same_period_pairs(C.neighbor_pairs(*_inputs(spark, sf))).filter("accumulates").select("seq", "o_seq", "period")


@query("f7_scored_only", "SELECT seq, metric, value FROM signals WHERE metric <> 'view'")
def f7(spark, sf):
    s, m = _inputs(spark, sf)
    return C.scored_only(s, m.withColumn("scored", F.col("metric") != "view")).select("seq", "metric", "value")


@query("j2_closest_per_sensor", "SELECT seq, o_sensor_id, o_seq, round(km, 6) AS km, agrees FROM closest")
def j2(spark, sf):
    s, m = _inputs(spark, sf)
    return C.closest_neighbors(s, m).select("seq", "o_sensor_id", "o_seq", F.round("km", 6).alias("km"), "agrees")


@query("j3_corroborate", "SELECT seq, n_corroborating, n_contradicting, ref_agrees FROM corro")
def j3(spark, sf):
    return C.counted_neighbors(*_inputs(spark, sf))


@query("j4_alert_support", "SELECT seq, alert_id, severity FROM alert_sup")
def j4(spark, sf):
    return C.alert_support(A.signals(spark, sf), A.standing_alerts(spark, sf), A.dim_alert_support(spark))


def arrival(spark, sf):
    s, m = _inputs(spark, sf)
    return C.arrival_quality(s, m, C.counted_neighbors(s, m), A.standing_alerts(spark, sf), A.dim_alert_support(spark))


@query("a4_judge_quality", "SELECT seq, kind, n_corr, n_contra, reference, quality FROM arrival")
def a4(spark, sf):
    return arrival(spark, sf).select("seq", "kind", "n_corr", "n_contra", "reference", "quality")


@query("j5_settle_by_alert", "SELECT seq, alert_id, epoch_us(sent) AS sent_us FROM by_alert")
def j5(spark, sf):
    s, m = _inputs(spark, sf)
    return C.settle_by_alert(s, A.standing_alerts(spark, sf), A.dim_alert_support(spark), m).select(
        "seq", "alert_id", F.unix_micros("sent").alias("sent_us"))


@query("j6_settle_by_daily_total", "SELECT seq, ref_seq FROM by_total")
def j6(spark, sf):
    return by_total(spark, sf).select("seq", "ref_seq")


def by_total(spark, sf, s=None):
    m = A.dim_metric(spark)
    return C.settle_by_daily_total(A.signals(spark, sf) if s is None else s, m, (F.col("kind") == "station") & (F.col("period") == "24h"))


def settling(spark, sf, ar, weights=True):
    """(first evidence of every raw reading, radar doubts, weighed agreements) from arrival qualities: neighbours, references, alerts, day totals and grids.
    Without ``weights`` people's evidence says what it makes of a reading, but not how much it adds to a record, and no agreements are weighed.
    """
    from gossamer.catalog.places import verdicts
    from gossamer.operators import grids as G

    s, m = _inputs(spark, sf)
    asked = C.in_question(s, ar)
    open_ = asked.filter("unsettled").select("seq")
    if weights:
        found = C.weighted(C.settling_agreements(asked, m), ("weighed", "o_unsettled"))
        found = checkpointed(found.filter("weighed OR o_unsettled").select("seq", "o_seq", "observed_at", "weight", "weighed", "o_unsettled"))
    else:
        found = C.settling_pairs(asked, m, weighed=False).select("seq", "o_seq", "observed_at", F.lit(None).cast("double").alias("weight"), "weighed", F.lit(True).alias("o_unsettled"))
    rest = asked.filter(F.col("unsettled") | ~F.col("kind").isin("human", "bot"))
    by_alert = C.settle_by_alert(rest, A.standing_alerts(spark, sf), A.dim_alert_support(spark), m)
    grid = checkpointed(verdicts(spark, sf).select("seq", "valid_us", "verdict").join(open_, "seq", "left_semi"))
    rows = C.evidence_from_people(found.filter("o_unsettled"))
    for part in (C.evidence_from_references(rest, m), C.evidence_from_alerts(by_alert), C.evidence_from_totals(by_total(spark, sf, rest)), G.grid_evidence(grid)):
        rows = rows.unionByName(part)
    return checkpointed(C.first_evidence(rows)), G.grid_doubts(grid), found.filter("weighed")


@query("a5_final_quality", "SELECT seq, quality, final_quality, via FROM final")
def a5(spark, sf):
    ar = checkpointed(arrival(spark, sf))
    return C.final_quality(ar, settling(spark, sf, ar, weights=False)[0]).select("seq", "quality", "final_quality", "via")


@query("a12_pair_agreements", f"SELECT a, b, count(*) AS n FROM agreed WHERE o_kind IN {PEOPLE} GROUP BY a, b")
def a12(spark, sf):
    return C.pair_agreements(C.people_agreements(*_inputs(spark, sf)))


@query("w9_running_pair_count", "SELECT seq, o_seq, a, b, together FROM together")
def w9(spark, sf):
    return C.running_pair_count(C.people_agreements(*_inputs(spark, sf))).select("seq", "o_seq", "a", "b", "together")


@query("x24_independence", "SELECT seq, o_seq, round(weight, 6) AS weight FROM independent")
def x24(spark, sf):
    return C.weighted(C.people_agreements(*_inputs(spark, sf))).select("seq", "o_seq", F.round("weight", 6).alias("weight"))


def outcome_rows(spark, sf, ar=None):
    """At arrival, and by the evidence that settled a reading later."""
    ar = checkpointed(arrival(spark, sf)) if ar is None else ar
    first, doubts, weighed = settling(spark, sf, ar)
    return C.outcomes(ar, weighed).unionByName(C.settled_outcomes(ar, first, doubts))


@query("a9_trust_record", f"""SELECT sensor_id, topic, round(agree, 6) AS agree, round(disagree, 6) AS disagree, checks, round((2+agree)/(4+agree+disagree), 6) AS trust
    FROM (SELECT sensor_id, topic, sum(agree*{FADE}) AS agree, sum(disagree*{FADE}) AS disagree, count(*) AS checks FROM outcomes
    WHERE agree > 0 OR disagree > 0 GROUP BY ALL)""")
def a9(spark, sf):
    s = A.signals(spark, sf)
    t = C.trust_record(outcome_rows(spark, sf), A.sensors(spark, sf), A.latest(s, "observed_at"))
    return t.select("sensor_id", "topic", F.round("agree", 6).alias("agree"), F.round("disagree", 6).alias("disagree"), "checks",
                    F.round("trust", 6).alias("trust"))


@query("a11_pooled_trust", f"""SELECT sensor_id, coalesce(topic, '*') AS topic, round(agree, 6) AS agree, checks, round((2+agree)/(4+agree+disagree), 6) AS trust
    FROM (SELECT sensor_id, topic, sum(agree*{FADE}) AS agree, sum(disagree*{FADE}) AS disagree, count(*) AS checks FROM outcomes
    WHERE agree > 0 OR disagree > 0 GROUP BY GROUPING SETS ((sensor_id, topic), (sensor_id)))""")
def a11(spark, sf):
    s = A.signals(spark, sf)
    t = C.pooled_trust(outcome_rows(spark, sf), A.sensors(spark, sf), A.latest(s, "observed_at"))
    return t.select("sensor_id", "topic", F.round("agree", 6).alias("agree"), "checks", F.round("trust", 6).alias("trust"))


@query("x30_standing_interval", f"""SELECT sensor_id, topic, round(greatest(0, m - 1.2815515655446008*sd), 6) AS low,
    round(least(1, m + 1.2815515655446008*sd), 6) AS high, checks < 3 AS is_new FROM (SELECT *, a/(a+b) AS m, sqrt(a*b/((a+b)*(a+b)*(a+b+1))) AS sd FROM (
    SELECT sensor_id, topic, 2 + sum(agree*{FADE}) AS a, 2 + sum(disagree*{FADE}) AS b, count(*) AS checks FROM outcomes
    WHERE agree > 0 OR disagree > 0 GROUP BY ALL))""")
def x30(spark, sf):
    s = A.signals(spark, sf)
    t = C.trust_record(outcome_rows(spark, sf), A.sensors(spark, sf), A.latest(s, "observed_at"))
    return t.select("sensor_id", "topic", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "is_new")
