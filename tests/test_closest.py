"""Neighbours compared in vectors are those of the range join, and only what can count is weighed."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gossamer.operators import corroborate as C
from gossamer.plans import closest as CL
from gossamer.sources import adapter as A

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "seq long, sensor_id long, kind string, metric string, topic string, value double, observed_at timestamp, lat double, lon double, precision string, period string"


def readings(spark, n=700, seed=5):
    rnd = random.Random(seed)
    place = [(40.0 + rnd.random() * 2, -89.0 + rnd.random() * 2) for _ in range(40)]
    rows = []
    for i in range(n):
        u = rnd.choice([None, *range(60)])
        lat, lon = place[(u or 0) % 40]
        kind = None if u == 59 else ["station", "official", "bot", "human", "human"][(u or 0) % 5]
        rows.append((rnd.choice([None, i, i, i, i, i - 3]), u, kind, rnd.choice(["purchase", "click", "signup", None]), "t", rnd.choice([None, 5.0, 30.0, 60.0, 250.0, 400.0, float("nan")]),
                     None if i % 50 == 7 else T0 + dt.timedelta(minutes=rnd.randrange(0, 1500) // 5 * 5), None if i % 60 == 9 else lat, lon, rnd.choice([None, "point", "point", "zip5"]), rnd.choice([None, "1h", "24h"])))
    return spark.createDataFrame(rows + rows[::9], SCHEMA)  # some stand twice


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_same_as_range_join(spark):
    s, m = readings(spark).cache(), A.dim_metric(spark)
    j = C.judged_neighbors(s, m).cache()
    want = rows_of(C.corroborate(j))
    assert rows_of(C.counted_neighbors(s, m)) == want and len(want) > 50
    km = F.round("km", 6).alias("km")
    want = rows_of(j.select("seq", "o_sensor_id", "o_seq", km, "agrees"))
    assert rows_of(C.closest_neighbors(s, m).select("seq", "o_sensor_id", "o_seq", km, "agrees")) == want and len(want) > 200
    cols = ["seq", "o_seq", "a", "b", "observed_at", "same_roof"]
    want = rows_of(C.agreements(j).filter("o_kind IN ('human', 'bot')").withColumn("same_roof", F.coalesce(C.same_roof(), F.lit(False))).select(*cols))
    assert rows_of(C.people_agreements(s, m).select(*cols)) == want and len(want) > 50
    assert rows_of(C.arrival_quality(s, m, C.counted_neighbors(s, m))) == rows_of(C.arrival_quality(s, m, j))


def test_sensors_with_names(spark):
    s, m = readings(spark, 300, 6), A.dim_metric(spark)
    named = s.withColumn("sensor_id", F.concat(F.lit("web:"), "sensor_id"))
    assert rows_of(C.counted_neighbors(named, m)) == rows_of(C.corroborate(C.judged_neighbors(s, m)))


def test_only_what_settles_is_weighed(spark):
    s, m = readings(spark), A.dim_metric(spark)
    asked = s.withColumn("unsettled", F.col("seq") % 3 == 1).withColumn("weighed", F.col("seq") % 11 == 2).cache()
    every = C.agreements(C.judged_neighbors(asked, m, ("unsettled", "weighed"))).cache()
    full, some = (C.weighted(d, ("weighed", "o_unsettled")).cache() for d in (every, C.settling_agreements(asked, m)))
    cols = ["seq", "o_seq", "weight", "observed_at"]
    want = rows_of(full.filter("weighed").select(*cols))
    assert rows_of(some.filter("weighed").select(*cols)) == want and len(want) > 10
    first = lambda d: rows_of(C.first_evidence(C.evidence_from_people(d.filter("o_unsettled"))))
    assert first(some) == first(full) and len(first(full)) > 10
    # one agreement settles a reading: no pair is counted for the others
    pairs = C.settling_pairs(asked, m, weighed=False)
    assert pairs.select("o_seq").distinct().count() == len(first(full)) <= pairs.count() < full.filter("o_unsettled").count()


def test_cells_that_share_a_number():
    """Two cells of one 64-bit number are told apart, and a table ends where a cell does."""
    cell, check = np.array([1, 1, 1, 1, 2, 2]), np.array([7, 8, 7, 8, 9, 9], np.int32)
    table, starts = CL._sorted(pa.table({"_cell": cell, "_check": check}))
    assert table.column("_check").to_pylist() == [7, 7, 8, 8, 9, 9] and list(starts) == [0, 2, 4]
    cells = np.sort(np.random.default_rng(1).integers(0, 40, 300_000))
    batches = pa.table({"_cell": cells, "_check": cells.astype(np.int32)}).to_batches(max_chunksize=10_000)
    got = [(t, s) for t, s in CL._whole_cells(iter(batches))]
    assert sum(t.num_rows for t, _ in got) == 300_000 and sum(len(s) for _, s in got) == 40 and len(got) > 2
