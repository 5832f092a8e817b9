"""Readings against their neighbours, official sources and alerts; trust earned from the outcomes.

Arrival order is the ``seq`` column: at arrival a reading is compared with earlier rows only, and a raw reading is
settled once by the first later evidence. Both are declarative, so any partitioning gives one answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gossamer.functions import geo
from gossamer.functions import scalars as X
from gossamer.plans import closest as CL
from gossamer.plans.bounded import spread, tasks_for
from gossamer.plans.spacetime import closest_within, within

MIN_US = 60 * 10**6
UNIT = 30  # 2^30 microseconds: 18 minutes
LAST_US = 2**55  # the year 3111
PAIR_BUCKETS = 2**21
PARAMS = ["radius_km", "window_min", "tol_abs", "tol_rel", "lo", "hi", "direction", "accumulates", "is_flag", "scored", "thresholds"]


def with_metric(signals: DataFrame, dim_metric: DataFrame, cols: list[str] = PARAMS) -> DataFrame:
    """Vocabulary columns on each reading (the vocabulary is a fixed literal table, a few dozen rows)."""
    return signals.join(F.broadcast(dim_metric.select("metric", *cols)), "metric")


def not_rejected():
    """Official rows are never rejected; people's are when out of range."""
    return X.is_reference() | X.in_range("value", "lo", "hi") | F.col("value").isNull()


def _sides(signals: DataFrame, dim_metric: DataFrame, keep: tuple = ()) -> tuple[DataFrame, DataFrame]:
    base = with_metric(spread(signals.select("seq", "sensor_id", "kind", "metric", "topic", "value", "observed_at", "lat", "lon",
                                             "precision", "period", *keep)), dim_metric.drop("topic"))
    base = base.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    base = base.withColumn("_w", F.col("window_min") * F.lit(MIN_US).cast("long"))
    right = base.filter(not_rejected()).select(
        "metric", "radius_km", "_w",
        *[F.col(c).alias(f"o_{c}") for c in ("seq", "sensor_id", "kind", "value", "observed_at", "lat", "lon", "precision", "period", *keep)])
    return base, right


def neighbor_pairs(signals: DataFrame, dim_metric: DataFrame, *, earlier_only: bool = False, same_period: bool = False,
                   left_filter=None, right_filter=None, keep: tuple = ()) -> DataFrame:
    """Ordered pairs of readings of one metric by two sensors, within its radius and window (both inclusive).

    ``same_period`` adds F8: accumulating metrics compare equal periods only, NULL matching NULL. ``keep`` names further columns to carry on both sides.
    """
    left, right = _sides(signals, dim_metric, keep)
    if left_filter is not None:
        left = left.filter(left_filter)
    if right_filter is not None:
        right = right.filter(right_filter)
    extra = F.col("sensor_id") != F.col("o_sensor_id")
    if earlier_only:
        extra = extra & (F.col("o_seq") < F.col("seq"))
    if same_period:
        extra = extra & (~F.col("accumulates") | F.col("period").eqNullSafe(F.col("o_period")))
    return within(left, right, ["metric"], "radius_km", "_w", "_w", extra=extra).drop("_w")


def judged(closest: DataFrame) -> DataFrame:
    """Each closest neighbour with whether the two values agree."""
    return closest.filter(F.col("value").isNotNull() & F.col("o_value").isNotNull()).withColumn(
        "agrees", X.compatible("value", "o_value", "is_flag", "tol_abs", "tol_rel"))


def judged_neighbors(signals: DataFrame, dim_metric: DataFrame, keep: tuple = ()) -> DataFrame:
    """What each people's reading is compared with at arrival: one neighbour reading per (reading, other sensor), that with the least time apart,
    then newest, then latest row. These rows grow with the square of the readings' density: they are streamed out of the join into counts, and
    no job writes or shuffles them all but those that return them. ``keep`` names further columns of the readings to carry on both sides.
    """
    left, right = _sides(signals, dim_metric, keep)
    left = left.filter(X.is_people() & F.col("scored"))

    def earlier_same_period(o):
        return (o("seq") < F.col("seq")) & (~F.col("accumulates") | F.col("period").eqNullSafe(o("period")))

    best = closest_within(left, right, ["metric"], "radius_km", "_w", "sensor_id", "seq", ["kind", "value", "precision", "period", *keep], earlier_same_period)
    return judged(best.select("seq", "sensor_id", "kind", "metric", "topic", "value", "observed_at", "lat", "lon", "precision", "is_flag", "tol_abs", "tol_rel", *keep,
                              *[f"o_{c}" for c in ("seq", "sensor_id", "kind", "value", "observed_at", "lat", "lon", "precision", *keep)], "km"))


def corroborate(j: DataFrame) -> DataFrame:
    """Per people's reading, distinct agreeing and disagreeing sensors and what reference sensors say."""
    ref = X.is_reference("o_kind")
    return j.groupBy("seq").agg(
        F.count_if("agrees").alias("n_corroborating"), F.count_if(~F.col("agrees")).alias("n_contradicting"),
        F.max(F.when(ref, F.col("agrees"))).alias("ref_agrees"))


# ── the same, counted or picked where the pairs are found: no pair reaches a plan that doesn't return it ──

SENSOR_BITS = 24  # a pair of sensors falls into one of 2^24 buckets


# bits of a compared reading beside those of the plan
REF, PERSON, POINT, FLAG, NO_FLAG, UNSETTLED, WEIGHED, REST = (8 << i for i in range(8))


def _bits(flags: dict) -> Column:
    out = F.lit(0)
    for bit, flag in flags.items():
        out = out + F.when(flag, bit).otherwise(0)
    return out


def _compared(signals: DataFrame, dim_metric: DataFrame, bits: dict | None = None) -> DataFrame:
    """Readings with what their comparison takes; yes and no in the bits of ``_f``, ``bits`` adds some."""
    asked = [c for c in ("unsettled", "weighed") if c in signals.columns]
    base = with_metric(spread(signals.select("seq", "sensor_id", "kind", "metric", "value", "observed_at", "lat", "lon", "precision", "period", *asked)), dim_metric)
    flags = {CL.ASKS: X.is_people() & F.col("scored"), CL.ANSWERS: not_rejected(), CL.STRICT: F.coalesce("accumulates", F.lit(True)), REF: X.is_reference(), PERSON: X.is_people(),
             POINT: F.col("precision") == "point", FLAG: F.col("is_flag"), NO_FLAG: ~F.col("is_flag"), **(bits or {})}
    base = base.withColumns({"_f": _bits(flags), "_t": F.unix_micros("observed_at"), "_w": F.col("window_min") * F.lit(MIN_US).cast("long")})
    return base.select("metric", "radius_km", "_w", "seq", "sensor_id", "_t", "lat", "lon", "value", "period", "tol_abs", "tol_rel", "_f")


def _asked_bits() -> dict:
    return {UNSETTLED: F.col("unsettled"), WEIGHED: F.col("weighed"), REST: ~F.coalesce("weighed", F.lit(False))}


def _closest(rows: DataFrame, finish, schema: str, turns: tuple = ((None, None),)) -> DataFrame:
    return CL.closest(rows, "metric", "radius_km", "_w", "sensor_id", "seq", "period", finish, schema, turns)


def _type(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def _judge(table):
    """X8 on vectors: a function of two rows' numbers that gives (agree, known, both have a value). Comparisons are SQL's: NaN is the largest number."""
    value, valued = CL.floats(table, "value")
    (abs_, has_abs), (rel, has_rel) = CL.floats(table, "tol_abs"), CL.floats(table, "tol_rel")
    flag, not_flag = CL.has(table, FLAG), CL.has(table, NO_FLAG)
    always = flag | (~has_abs & ~has_rel)

    def judge(i, j):
        a, b = value[i], value[j]
        with np.errstate(invalid="ignore"):
            part = np.where(has_rel[i], rel[i] * np.maximum(np.abs(a), np.abs(b)), 0.0)
            allowed = np.maximum(abs_[i], part)
            near = (np.abs(a - b) <= allowed) | np.isnan(allowed)
        both = valued[i] & valued[j]
        agree = both & (always[i] | near)
        return agree, agree | (both & not_flag[i]), both

    return judge


def counted_neighbors(signals: DataFrame, dim_metric: DataFrame) -> DataFrame:
    """J3 of ``judged_neighbors``: only a row per reading leaves the workers that compare."""

    def finish(table, pairs):
        judge, ref = _judge(table), CL.has(table, REF).astype(np.int64) * 4
        counts = np.zeros((table.num_rows, 16), np.int64)  # by (both have a value, reference, known, agrees)
        for g, k, j in pairs:
            agree, known, both = judge(g[k], j)
            counts[g] += np.bincount(k * 16 + (both * 8 + ref[j] + known * 2 + agree), minlength=16 * len(g)).reshape(-1, 16)
        rows = np.flatnonzero(counts[:, 8:].any(axis=1))
        if len(rows):
            c = counts[rows]
            yes, no, by_ref, ref_yes = c[:, 11] + c[:, 15], c[:, 10] + c[:, 14], c[:, 14] + c[:, 15], c[:, 15]
            yield pa.RecordBatch.from_arrays([_taken(table, "seq", rows), pa.array(yes), pa.array(no), pa.array(ref_yes > 0, mask=by_ref == 0)], ["seq", "n_corroborating", "n_contradicting", "ref_agrees"])

    out = _closest(_compared(signals, dim_metric), finish, f"seq {_type(signals, 'seq')}, n_corroborating long, n_contradicting long, ref_agrees boolean")
    return out.groupBy("seq").agg(F.sum("n_corroborating").alias("n_corroborating"), F.sum("n_contradicting").alias("n_contradicting"), F.max("ref_agrees").alias("ref_agrees"))


def _taken(table, name: str, rows) -> pa.Array:
    got = table.column(name).take(pa.array(rows))
    return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got


def _gathered(pairs, chosen):
    """(asking rows, answering rows) of the pairs chosen, some ten thousand at a time."""
    left, right, n = [], [], 0
    for g, k, j in pairs:
        i = g[k]
        keep = chosen(i, j)
        if keep.any():
            left.append(i[keep])
            right.append(j[keep])
            n += len(left[-1])
        if n >= CL.ROWS:
            yield np.concatenate(left), np.concatenate(right)
            left, right, n = [], [], 0
    if n:
        yield np.concatenate(left), np.concatenate(right)


def closest_neighbors(signals: DataFrame, dim_metric: DataFrame) -> DataFrame:
    """(seq, o_sensor_id, o_seq, km, agrees): ``judged_neighbors`` with the columns of J2 only."""

    def finish(table, pairs):
        judge = _judge(table)
        lat, lon = table.column("lat").to_numpy(), table.column("lon").to_numpy()
        for i, j in _gathered(pairs, lambda i, j: judge(i, j)[2]):
            agree, known, _ = judge(i, j)
            yield pa.RecordBatch.from_arrays([_taken(table, "seq", i), _taken(table, "sensor_id", j), _taken(table, "seq", j), pa.array(CL.haversine_km(lat[i], lon[i], lat[j], lon[j])),
                                              pa.array(agree, mask=~known)], ["seq", "o_sensor_id", "o_seq", "km", "agrees"])

    seq, who = _type(signals, "seq"), _type(signals, "sensor_id")
    return _closest(_compared(signals, dim_metric), finish, f"seq {seq}, o_sensor_id {who}, o_seq {seq}, km double, agrees boolean")


def _same_roof(table):
    lat, lon, point = table.column("lat").to_numpy(), table.column("lon").to_numpy(), CL.has(table, POINT)

    def same(i, j):
        roof = point[i] & point[j] & (np.abs(lat[i] - lat[j]) * CL.KM_PER_DEG < X.SAME_PLACE_KM)
        q = np.flatnonzero(roof)
        roof[q] = CL.haversine_km(lat[i[q]], lon[i[q]], lat[j[q]], lon[j[q]]) < X.SAME_PLACE_KM
        return roof

    return same


def people_agreements(signals: DataFrame, dim_metric: DataFrame, buckets: np.ndarray | None = None) -> DataFrame:
    """Agreements of ``judged_neighbors`` between people: (seq, o_seq, a, b, observed_at, same_roof), of rows of ``in_question`` also (weighed, o_unsettled).
    ``buckets`` (bits, see ``_hash``) names the pairs of sensors wanted and perhaps some more; those of all other pairs stay in the workers.
    """
    asked = "unsettled" in signals.columns
    rows = _compared(signals, dim_metric, _asked_bits() if asked else None)
    if buckets is not None:
        rows = rows.withColumn("_hs", _hash("sensor_id"))

    def finish(table, pairs):
        judge, person, roof = _judge(table), CL.has(table, PERSON), _same_roof(table)
        weighed, unsettled = CL.has(table, WEIGHED), CL.has(table, UNSETTLED)
        if buckets is not None:
            hs = table.column("_hs").to_numpy()

        def chosen(i, j):
            keep = person[j]
            if buckets is not None:
                h = hs[i] ^ hs[j]
                keep &= ((buckets[h >> 3] >> (h & 7).astype(np.uint8)) & 1).astype(bool)
            q = np.flatnonzero(keep)
            keep[q] = judge(i[q], j[q])[0]
            return keep

        for i, j in _gathered(pairs, chosen):
            cols = [_taken(table, "seq", i), _taken(table, "seq", j), _taken(table, "sensor_id", i), _taken(table, "sensor_id", j), _taken(table, "_t", i), pa.array(roof(i, j))]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(weighed[i]), pa.array(unsettled[j])] if asked else [])], names)

    names = ["seq", "o_seq", "sensor_id", "o_sensor_id", "_t", "same_roof", *(["weighed", "o_unsettled"] if asked else [])]
    kinds = [_type(signals, c) for c in ("seq", "seq", "sensor_id", "sensor_id")] + ["long", "boolean", "boolean", "boolean"]
    out = pair_keys(_closest(rows, finish, ", ".join(f"{n} {k}" for n, k in zip(names, kinds))))
    return out.select("seq", "o_seq", "a", "b", F.timestamp_micros("_t").alias("observed_at"), *names[5:])


def _hash(c: str) -> Column:
    """A sensor's SENSOR_BITS bits; a pair's bucket is the exclusive or of both."""
    return F.xxhash64(c).bitwiseAND(F.lit(2**SENSOR_BITS - 1))


def settling_pairs(asked: DataFrame, dim_metric: DataFrame, weighed: bool = True) -> DataFrame:
    """Agreements of people whose weight can count, of the rows of ``in_question``: those of ``weighed`` readings, and of each unsettled one the first later agreement
    (all that share its time and row), as only the first evidence settles: (seq, o_seq, sensor_id, o_sensor_id, observed_at, weighed). Without ``weighed`` only the latter.
    """
    rows = _compared(asked, dim_metric, _asked_bits())
    turns = ((WEIGHED, None), (REST, UNSETTLED)) if weighed else ((None, UNSETTLED),)

    def finish(table, pairs):
        judge, person, t, row = _judge(table), CL.has(table, PERSON), table.column("_t").to_numpy(), table.column("seq").to_numpy()
        mine, open_ = CL.has(table, WEIGHED) & weighed, CL.has(table, UNSETTLED)

        def chosen(i, j):
            keep = person[j] & (mine[i] | open_[j])
            q = np.flatnonzero(keep)
            keep[q] = judge(i[q], j[q])[0]
            return keep

        def batch(i, j, counts):
            return pa.RecordBatch.from_arrays([_taken(table, "seq", i), _taken(table, "seq", j), _taken(table, "sensor_id", i), _taken(table, "sensor_id", j), _taken(table, "_t", i),
                                               pa.array(counts)], ["seq", "o_seq", "sensor_id", "o_sensor_id", "_t", "weighed"])

        def firsts(i, j):
            order = np.lexsort((row[i], t[i], j))
            i, j = i[order], j[order]
            start = np.flatnonzero(np.append(True, j[1:] != j[:-1]))
            first = np.repeat(start, np.diff(np.append(start, len(j))))
            keep = (t[i] == t[i[first]]) & (row[i] == row[i[first]])
            return i[keep], j[keep]

        i0, j0 = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, j in _gathered(pairs, chosen):
            if mine[i].any():
                yield batch(i[mine[i]], j[mine[i]], np.ones(int(mine[i].sum()), bool))
            if open_[j].any():
                i0, j0 = firsts(np.concatenate([i0, i[open_[j]]]), np.concatenate([j0, j[open_[j]]]))
        if len(i0):
            yield batch(i0, j0, np.zeros(len(i0), bool))

    seq, who = _type(asked, "seq"), _type(asked, "sensor_id")
    out = _closest(rows, finish, f"seq {seq}, o_seq {seq}, sensor_id {who}, o_sensor_id {who}, _t long, weighed boolean", turns)
    # a reading's first agreement of all cells it reaches
    first = F.rank().over(W.partitionBy("weighed", "o_seq").orderBy("_t", "seq"))
    return out.withColumn("_n", first).filter("weighed OR _n = 1").select("seq", "o_seq", "sensor_id", "o_sensor_id", F.timestamp_micros("_t").alias("observed_at"), "weighed")


def settling_agreements(asked: DataFrame, dim_metric: DataFrame) -> DataFrame:
    """All agreements, for running counts, of the pairs of people in ``settling_pairs``. Which those are comes to the driver as buckets, 2^24 small numbers at most."""
    bucket = _hash("sensor_id").bitwiseXOR(_hash("o_sensor_id")).cast("int").alias("h")
    got = settling_pairs(asked, dim_metric).select(bucket).distinct().toArrow().column("h").to_numpy()
    bits = np.zeros(2**SENSOR_BITS, bool)
    bits[got] = True
    return people_agreements(asked, dim_metric, np.packbits(bits, bitorder="little"))


def alert_support(signals: DataFrame, alerts: DataFrame, dim_support: DataFrame) -> DataFrame:
    """The alert that supports a reading: same county, listed for its metric, not expired when it was observed,
    already received; highest severity, then newest.

    No reading meets its alerts one by one. Time is cut into units no longer than an alert: its first unit is held from its sending on, its last one until it
    expires, and what lies between is covered whole and written as dyadic blocks, of which only the best alert each goes on. A reading then takes the
    best of its unit, the best sent so far in it and the best still to expire in it. An alert without an end covers blocks up to the last one.
    """
    best = F.struct("severity", F.unix_micros("sent").alias("sent"), "alert_id").alias("b")
    s = signals.filter(X.is_people() & F.col("county_id").isNotNull()).join(F.broadcast(dim_support), "metric").select("seq", "county_id", "slug", F.unix_micros("observed_at").alias("t"))
    t0 = F.unix_micros("sent")
    t1 = F.least(F.coalesce(F.unix_micros("expires"), F.lit(LAST_US)), F.lit(LAST_US))
    # the unit is 2^k microseconds: 18 minutes, less for shorter alerts
    a = alerts.filter(t1 > t0).select("county_id", "slug", t0.alias("t0"), t1.alias("t1"), best, F.least(F.lit(UNIT), F.length(F.bin(t1 - t0)) - 1).alias("k"))
    units = sorted(r["k"] for r in a.select("k").distinct().collect())  # UNIT + 1 values at most
    a = a.withColumn("u0", _shift("right", "t0", "k")).withColumn("u1", _shift("right", "t1", "k"))
    where = ["county_id", "slug", "k", "u"]
    starts = a.select("county_id", "slug", "k", F.col("u0").alias("u"), F.col("t0").alias("t"), "b").groupBy(*where, "t").agg(F.max("b").alias("b"))
    ends = a.select("county_id", "slug", "k", F.col("u1").alias("u"), F.col("t1").alias("t"), "b").groupBy(*where, "t").agg(F.max("b").alias("b"))
    # whole units from l up to r: at level j the odd ends of that range, halved j times
    inner = a.select("county_id", "slug", "k", "b", (F.col("u0") + 1).alias("l"), F.col("u1").alias("r")).filter("l < r").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(55) - F.col("k"))))
    inner = inner.withColumn("l", -_shift("right", -F.col("l"), "j")).withColumn("r", _shift("right", "r", "j")).filter("l < r")
    inner = inner.withColumn("u", F.explode(F.filter(F.array(F.when(F.col("l") % 2 != 0, F.col("l")), F.when(F.col("r") % 2 != 0, F.col("r") - 1)), lambda x: x.isNotNull())))
    blocks = inner.groupBy("county_id", "slug", "k", "j", "u").agg(F.max("b").alias("b"))

    seen = s.withColumn("k", F.explode(F.lit(units).cast("array<int>"))).withColumn("u", _shift("right", "t", "k"))
    levels = seen.select(*where).distinct().withColumn("unit", F.col("u")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(55) - F.col("k")))).withColumn("u", _shift("right", "u", "j"))
    whole = levels.join(blocks, ["county_id", "slug", "k", "j", "u"]).groupBy("county_id", "slug", "k", F.col("unit").alias("u")).agg(F.max("b").alias("b"))
    whole = whole.withColumn("t", _shift("left", "u", "k"))

    def rows(df, kind):
        return df.select(*where, "t", F.lit(kind).alias("o"), F.lit(None).cast("long").alias("seq"), "b")

    none = F.lit(None).cast(a.schema["b"].dataType).alias("b")
    both = seen.select(*where, "t", F.lit(1).alias("o"), "seq", none).unionByName(rows(whole, 0)).unionByName(rows(starts, 0)).unionByName(rows(ends, 2))
    unit = W.partitionBy(*where).orderBy("t", "o")
    so_far = F.max(F.when(F.col("o") == 0, F.col("b"))).over(unit.rowsBetween(W.unboundedPreceding, W.currentRow))
    # in falling order an alert that expires at the reading's instant comes after it: it supports no longer
    still = F.max(F.when(F.col("o") == 2, F.col("b"))).over(W.partitionBy(*where).orderBy(F.desc("t"), "o").rowsBetween(W.unboundedPreceding, W.currentRow))
    got = both.withColumn("_so_far", so_far).withColumn("_still", still).filter("o = 1").withColumn("b", F.greatest("_so_far", "_still")).filter("b IS NOT NULL")
    return got.groupBy("seq").agg(F.max("b").alias("b")).select("seq", "b.alert_id", "b.severity")


def _shift(way: str, value, by) -> Column:
    return F.call_function(f"shift{way}", F.col(value) if isinstance(value, str) else value, F.col(by))


def arrival_quality(signals: DataFrame, dim_metric: DataFrame, j: DataFrame, alerts: DataFrame | None = None,
                    dim_support: DataFrame | None = None) -> DataFrame:
    """A4: quality of every reading at arrival, with the counts behind it. ``j`` are its neighbours, judged or already counted."""
    base = with_metric(signals, dim_metric, ["lo", "hi", "scored"])
    c = j if "n_corroborating" in j.columns else corroborate(j)
    out = base.join(c, "seq", "left")
    n_yes, n_no = F.coalesce("n_corroborating", F.lit(0)).cast("long"), F.coalesce("n_contradicting", F.lit(0)).cast("long")
    alert = F.lit(None).cast("long")
    if alerts is not None:
        out = out.join(alert_support(signals, alerts, dim_support).select("seq", "alert_id"), "seq", "left")
        alert = F.col("alert_id")
    people = X.is_people()
    reference = (F.when(~people, "none").when(F.col("ref_agrees"), "agree").when(~F.col("ref_agrees"), "disagree")
                 .when(alert.isNotNull() & F.col("scored"), "agree").otherwise("none"))
    out = out.withColumn("reference", reference).withColumn("n_corr", n_yes).withColumn("n_contra", n_no)
    rejected = F.col("value").isNotNull() & ~X.in_range("value", "lo", "hi")
    quality = (F.when(~people, "reference").when(~F.col("scored"), "raw").when(rejected, "rejected")
               .when((F.col("n_corr") >= 1) | (F.col("reference") == "agree"), "corroborated")
               .when((F.col("reference") == "disagree") | (F.col("n_contra") >= 2), "flagged").otherwise("raw"))
    return out.withColumn("quality", quality).select("seq", "sensor_id", "kind", "metric", "topic", "observed_at",
                                                     "n_corr", "n_contra", "reference", "quality")


def scored_only(signals: DataFrame, dim_metric: DataFrame) -> DataFrame:
    """F7."""
    return with_metric(signals, dim_metric, ["scored"]).filter("scored").drop("scored")


def same_period_pairs(pairs: DataFrame) -> DataFrame:
    """F8 on prepared pairs."""
    return pairs.filter(~F.col("accumulates") | F.col("period").eqNullSafe(F.col("o_period")))


# ── evidence that settles raw readings later ───────────────────────────────

def _arrival(at: str, order: int, row: str):
    return F.struct(F.unix_micros(at).alias("t"), F.lit(order).alias("o"), F.col(row).cast("long").alias("id"))


def _evidence(seq: str, arrival, verdict, via: str, agree, disagree) -> list:
    """One row of evidence: when it came, what it makes of a raw reading, and what that adds to its sender's record."""
    return [F.col(seq).alias("seq"), arrival.alias("arrival"), verdict.alias("verdict"), F.lit(via).alias("via"), agree.cast("double").alias("agree"), disagree.cast("double").alias("disagree")]


def evidence_from_people(weighted_agreements: DataFrame) -> DataFrame:
    """A later reading agrees with an earlier raw one; it is worth its independence."""
    return weighted_agreements.select(*_evidence("o_seq", _arrival("observed_at", 0, "seq"), F.lit("corroborated"), "reading", F.col("weight"), F.lit(0.0)))


def evidence_from_alerts(by_alert: DataFrame) -> DataFrame:
    """Rows of J5."""
    return by_alert.select(*_evidence("seq", _arrival("sent", 1, "alert_id"), F.lit("corroborated"), "alert", F.lit(1.0), F.lit(0.0)))


def evidence_from_totals(by_total: DataFrame) -> DataFrame:
    """Rows of J6: half a reference."""
    return by_total.select(*_evidence("seq", _arrival("ref_at", 3, "ref_seq"), F.lit("corroborated"), "total", F.lit(X.GRID_WEIGHT), F.lit(0.0)))


def evidence_from_references(signals: DataFrame, dim_metric: DataFrame) -> DataFrame:
    """A later reference reading agrees or disagrees with every earlier raw one in reach."""
    pairs = neighbor_pairs(signals, dim_metric, earlier_only=True, same_period=True,
                           left_filter=X.is_reference() & F.col("scored") & F.col("value").isNotNull(), right_filter=X.is_people("o_kind"))
    agrees = X.compatible("value", "o_value", "is_flag", "tol_abs", "tol_rel")
    return pairs.filter(F.col("o_value").isNotNull()).select(*_evidence(
        "o_seq", _arrival("observed_at", 0, "seq"), F.when(agrees, "corroborated").otherwise("flagged"), "reference", F.when(agrees, 1.0).otherwise(0.0), F.when(agrees, 0.0).otherwise(1.0)))


def settle_by_alert(signals: DataFrame, alerts: DataFrame, dim_support: DataFrame, dim_metric: DataFrame) -> DataFrame:
    """Readings a new alert confirms: same county, listed and scored metric, value past a threshold, observed in the
    metric's window before the alert was sent, inside its polygon when it has one. The first such alert counts.
    """
    s = with_metric(signals.filter(X.is_people() & F.col("value").isNotNull()), dim_metric, ["window_min", "thresholds", "direction", "scored"])
    s = s.filter(F.col("scored") & (X.severity("value", "thresholds", "direction") > 0)).join(F.broadcast(dim_support), "metric")
    width = F.col("window_min") * F.lit(MIN_US).cast("long")
    t = F.unix_micros("observed_at")
    s = s.select("seq", "county_id", "slug", "observed_at", "lat", "lon", width.alias("_w"),
                 F.explode(F.sequence(F.floor(t / width), F.floor((t + width) / width))).alias("_b"))
    # one bucket width per (metric, slug) is known on the reading side; the alert takes it from the support list
    widths = dim_support.join(dim_metric.select("metric", "window_min"), "metric").select(
        "slug", (F.col("window_min") * F.lit(MIN_US).cast("long")).alias("_w")).distinct()
    a = alerts.join(F.broadcast(widths), "slug")
    rings = F.col("polygon") if "polygon" in alerts.columns else F.lit(None)
    a = a.select("alert_id", "county_id", "slug", "sent", "_w", F.floor(F.unix_micros("sent") / F.col("_w")).alias("_b"),
                 *([rings.alias("polygon")] if "polygon" in alerts.columns else []))
    hit = s.join(a, ["county_id", "slug", "_w", "_b"]).filter(
        (F.col("observed_at") <= F.col("sent")) & (F.unix_micros("sent") - F.unix_micros("observed_at") <= F.col("_w")))
    if "polygon" in alerts.columns:
        hit = hit.filter(F.col("polygon").isNull() | geo.point_in_polygon("lat", "lon", "polygon"))
    rank = F.struct(F.unix_micros("sent"), "alert_id")
    return hit.groupBy("seq").agg(F.min_by(F.struct("alert_id", "sent"), rank).alias("a")).select("seq", "a.alert_id", "a.sent")


# Scanned bytes whose pairs of readings and day totals one task sorts.
TOTALS_BYTES = 2**18


def settle_by_daily_total(signals: DataFrame, dim_metric: DataFrame, totals_filter) -> DataFrame:
    """A day total confirms people's readings within the radius over its period that agree; the first one counts.

    Confirms only. A reading with another stated period is not compared.
    """
    day = 24 * 3600 * 10**6
    left, right = _sides(signals, dim_metric)
    hours = F.coalesce(F.regexp_extract("period", r"^([0-9.]+)h", 1).try_cast("double"), F.lit(24.0))
    refs = left.filter(totals_filter & F.col("scored") & F.col("value").isNotNull()).withColumn(
        "_period", F.coalesce("period", F.lit("24h"))).withColumn("_span", (hours * 3600e6).cast("long"))
    refs = refs.withColumn("_lo", F.lit(day).cast("long")).withColumn("_hi", F.lit(0).cast("long"))
    people = right.filter(X.is_people("o_kind") & F.col("o_value").isNotNull()).withColumn(
        "_lo", F.lit(day).cast("long")).withColumn("_hi", F.lit(0).cast("long"))
    extra = ((F.unix_micros("observed_at") - F.unix_micros("o_observed_at") <= F.col("_span"))
             & (F.col("o_period").isNull() | (F.col("o_period") == F.col("_period")))
             & X.compatible("value", "o_value", "is_flag", "tol_abs", "tol_rel"))
    tasks = tasks_for(signals, TOTALS_BYTES)
    # a reading is copied to some sixteen cells: a task that copies takes a bounded share of the scan
    p = within(refs, people.repartition(-(-tasks // 8)), ["metric"], "radius_km", "_lo", "_hi", extra=extra, tasks=tasks)
    rank = F.struct(F.unix_micros("observed_at"), "seq")
    return p.groupBy(F.col("o_seq").alias("seq")).agg(F.min_by(F.struct("seq", "observed_at"), rank).alias("r")).select("seq", F.col("r.seq").alias("ref_seq"), F.col("r.observed_at").alias("ref_at"))


def first_evidence(evidence: DataFrame) -> DataFrame:
    """(seq, e: arrival, verdict, via, agree, disagree) of each reading's first evidence."""
    return evidence.groupBy("seq").agg(F.min(F.struct("arrival", "verdict", "via", "agree", "disagree")).alias("e"))


def final_quality(arrival: DataFrame, first: DataFrame) -> DataFrame:
    """A5: a raw reading takes the verdict of its first later evidence; every other quality stands."""
    out = arrival.join(first, "seq", "left")
    raw = (F.col("quality") == "raw") & F.col("e").isNotNull()
    return out.withColumn("via", F.when(raw, F.col("e.via"))).withColumn(
        "final_quality", F.when(raw, F.col("e.verdict")).otherwise(F.col("quality"))).drop("e")


# ── trust ──────────────────────────────────────────────────────────────────

def pair_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("a", F.least("sensor_id", "o_sensor_id")).withColumn("b", F.greatest("sensor_id", "o_sensor_id"))


def agreements(j: DataFrame) -> DataFrame:
    """Each (reading, agreeing sensor) with the kinds, places and pair."""
    return pair_keys(j.filter("agrees"))


def pair_agreements(agreed: DataFrame) -> DataFrame:
    """Agreements per unordered pair of people."""
    return (agreed if "same_roof" in agreed.columns else agreed.filter(X.is_people("o_kind"))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def running_pair_count(agreed: DataFrame, keep: tuple = ()) -> DataFrame:
    """(seq, o_seq, a, b, together, and what X24 and the record need): agreements of the pair before this one.

    One shuffle of narrow rows. A pair has at most one agreement per reading of its two sensors; its order is sorted on disk where it must be, never held.
    """
    if "same_roof" not in agreed.columns:
        agreed = agreed.filter(X.is_people("o_kind")).withColumn("same_roof", same_roof())
    rows = agreed.select("seq", "o_seq", "a", "b", "observed_at", "same_roof", *keep)
    before = W.partitionBy("a", "b").orderBy("seq", "o_seq")
    return rows.withColumn("together", (F.row_number().over(before) - 1).cast("long"))


def same_roof() -> Column:
    return (F.col("precision") == "point") & (F.col("o_precision") == "point") & (F.col("km") < X.SAME_PLACE_KM)


def independence(together):
    """Worth of one agreeing neighbour as a second witness."""
    return F.when(X.is_reference("kind") | X.is_reference("o_kind"), 1.0).otherwise(_worth(same_roof(), together))


def _worth(roof: Column, together: Column) -> Column:
    return F.least(F.when(roof, X.SAME_PLACE_WEIGHT).otherwise(1.0), F.lit(1.0) / (F.lit(1.0) + F.coalesce(together, F.lit(0)) / 3.0))


def weighted(agreed: DataFrame, keep: tuple = ()) -> DataFrame:
    """X24 on every agreement between people."""
    return running_pair_count(agreed, keep).withColumn("weight", _worth(F.col("same_roof"), F.col("together")))


def in_question(signals: DataFrame, arrival: DataFrame) -> DataFrame:
    """Readings with what is still asked of them: ``unsettled``, raw and so settled by later evidence; ``weighed``, corroborated by people alone, whose
    agreements count by their independence. Evidence and weights of all others change nothing.
    """
    asked = arrival.select("seq", (F.col("quality") == "raw").alias("unsettled"), ((F.col("quality") == "corroborated") & (F.col("reference") != "agree")).alias("weighed"))
    return signals.join(asked, "seq")


def pair_bucket() -> Column:
    """A pair's bucket of PAIR_BUCKETS: few enough to send to every task, whatever the number of pairs."""
    return F.pmod(F.xxhash64("a", "b"), F.lit(PAIR_BUCKETS)).alias("_h")


def pairs_in_question(asked: DataFrame, dim_metric: DataFrame) -> DataFrame:
    """(_h): buckets of all pairs of people with an agreement that is asked for, and perhaps of more. Only their agreements need a running count.

    ``asked`` are the rows of ``in_question``; one side of each join holds only what is asked.
    """
    people, other = X.is_people() & F.col("scored"), X.is_people("o_kind")

    def agreeing(left, right):
        p = neighbor_pairs(asked, dim_metric, earlier_only=True, same_period=True, left_filter=left, right_filter=right, keep=("unsettled", "weighed"))
        return pair_keys(judged(p).filter("agrees")).select(pair_bucket())

    return agreeing(people & F.col("weighed"), other).unionByName(agreeing(people, other & F.col("o_unsettled"))).distinct()


def agreements_in_question(asked: DataFrame, dim_metric: DataFrame) -> DataFrame:
    """Agreements (with ``weighed`` and ``o_unsettled``) of every pair of people that has one in question: those of all other pairs are dropped as
    they come out of the join, ahead of any shuffle."""
    all_ = agreements(judged_neighbors(asked, dim_metric, ("unsettled", "weighed"))).filter(X.is_people("o_kind"))
    return all_.withColumn("_h", pair_bucket()).join(F.broadcast(pairs_in_question(asked, dim_metric)), "_h", "left_semi").drop("_h")


def settled_outcomes(arrival: DataFrame, first: DataFrame, doubts: DataFrame | None = None) -> DataFrame:
    """What later evidence adds to people's records: of each raw reading the evidence that settled it, and a radar grid's doubt (``doubts``: seq, arrival)
    that came before."""
    raw = arrival.filter((F.col("quality") == "raw") & (F.col("kind") == "human")).select("seq", "sensor_id", "topic")
    got = raw.join(first, "seq").select("sensor_id", "topic", F.timestamp_micros("e.arrival.t").alias("at"), "e.agree", "e.disagree")
    if doubts is not None:
        open_ = raw.join(doubts, "seq").join(first, "seq", "left").filter(F.col("e").isNull() | (F.col("arrival") < F.col("e.arrival")))
        got = got.unionByName(open_.select("sensor_id", "topic", F.timestamp_micros("arrival.t").alias("at"), F.lit(0.0).alias("agree"), F.lit(X.GRID_WEIGHT).alias("disagree")))
    return got


def outcomes(arrival: DataFrame, weighted_agreements: DataFrame) -> DataFrame:
    """What each people's reading adds to its sender's record at arrival: (sensor, topic, at, agree, disagree)."""
    sums = weighted_agreements.groupBy("seq").agg(F.sum("weight").alias("weight"))
    out = arrival.filter(X.is_people() & F.col("quality").isin("corroborated", "flagged", "rejected")).join(sums, "seq", "left")
    agree = (F.when(F.col("quality") != "corroborated", 0.0).when(F.col("reference") == "agree", 1.0)
             .otherwise(F.least(F.lit(1.0), F.coalesce("weight", F.lit(0.0)))))
    disagree = F.when(F.col("quality").isin("flagged", "rejected"), 1.0).otherwise(0.0)
    return out.select("sensor_id", "topic", F.col("observed_at").alias("at"), agree.alias("agree"), disagree.alias("disagree"))


def trust_record(outcome_rows: DataFrame, priors: DataFrame, now) -> DataFrame:
    """Faded sums per (sensor, topic). Fading composes, so the sequential record equals one sum."""
    w = X.faded_weight("at", now)
    sums = outcome_rows.filter((F.col("agree") > 0) | (F.col("disagree") > 0)).groupBy("sensor_id", "topic").agg(
        F.sum(F.col("agree") * w).alias("agree"), F.sum(F.col("disagree") * w).alias("disagree"), F.count(F.lit(1)).alias("checks"))
    return _standing(sums.join(priors.select("sensor_id", "trust_prior"), "sensor_id", "left"))


def pooled_trust(outcome_rows: DataFrame, priors: DataFrame, now) -> DataFrame:
    """The same over all topics (topic '*') next to each topic, by rollup."""
    w = X.faded_weight("at", now)
    sums = outcome_rows.filter((F.col("agree") > 0) | (F.col("disagree") > 0)).rollup("sensor_id", "topic").agg(
        F.sum(F.col("agree") * w).alias("agree"), F.sum(F.col("disagree") * w).alias("disagree"), F.count(F.lit(1)).alias("checks"))
    sums = sums.filter(F.col("sensor_id").isNotNull()).withColumn("topic", F.coalesce("topic", F.lit("*")))
    return _standing(sums.join(priors.select("sensor_id", "trust_prior"), "sensor_id", "left"))


def _standing(sums: DataFrame) -> DataFrame:
    out = sums.withColumn("s", X.standing_interval("agree", "disagree", F.coalesce("trust_prior", F.lit(X.TRUST_PRIOR))))
    return out.select("sensor_id", "topic", "agree", "disagree", "checks", "s.trust", "s.low", "s.high",
                      (F.col("checks") < X.NEW_BELOW).alias("is_new"))
