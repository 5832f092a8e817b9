"""The driver's contract, and every query with SQL against DuckDB on the small tables for a sample of each section."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["a1_mesh", "a4_judge_quality", "a22_feed_problems", "f14_rate_limited", "g1_events", "g2_alert_threads", "j7_county_of_point", "j23_grid_sample", "s1_normalize_alerts", "t7_sensor_latest", "u3_fresh_stories", "w8_sparkline", "x11_nearest_rank"]


def value(v):
    return round(v, 6) if isinstance(v, float) else v


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200


def test_flagship(spark):
    assert set(entry.entry(spark).columns) == {"seq", "kind", "n_corr", "n_contra", "reference", "quality"}


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(str(value(r[names.index(c)])) for c in cols) for r in cur.fetchall())
    got = sorted(tuple(str(value(r[c])) for c in cols) for r in df.collect())
    assert got == want and got
