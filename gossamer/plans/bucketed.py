"""Ordered logic without whole-history windows.

A window over one hot key would put that key's whole history in one task. These helpers cut each key's timeline into
time buckets, work inside a bucket, and carry only one small summary row per bucket across bucket borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucket_of(at, width_us) -> Column:
    at = F.col(at) if isinstance(at, str) else at
    width = width_us if isinstance(width_us, Column) else F.lit(int(width_us)).cast("long")
    return F.floor(F.unix_micros(at) / width).cast("long")


def previous_within(df: DataFrame, keys: list[str], at: str, row_id: str, within_us: int, carry: list[str]) -> DataFrame:
    """Each row with the carried columns of its key's previous row (by time, then id) if at most ``within_us`` before.

    Buckets are ``within_us`` wide, so the previous row lies in the same bucket or is the last of the bucket before;
    that last row is found by a partially aggregated max and joined in.
    """
    b = df.withColumn("_b", bucket_of(at, within_us))
    w = W.partitionBy(*keys, "_b").orderBy(F.col(at), F.col(row_id))
    packed = F.struct(F.col(at).alias("_at"), F.col(row_id).alias("_id"), *[F.col(c).alias(f"prev_{c}") for c in carry])
    inside = b.withColumn("_p", F.lag(packed).over(w))
    last = b.groupBy(*keys, (F.col("_b") + 1).alias("_b")).agg(F.max(packed).alias("_q"))
    out = inside.join(last, [*keys, "_b"], "left").withColumn("_p", F.coalesce("_p", "_q"))
    near = F.unix_micros(F.col(at)) - F.unix_micros(F.col("_p._at")) <= F.lit(within_us).cast("long")
    return out.select(*df.columns, *[F.when(near, F.col(f"_p.prev_{c}")).alias(f"prev_{c}") for c in carry])


def running_count(df: DataFrame, keys: list[str], at: str, order: list[str], width_us: int, name: str) -> DataFrame:
    """Rows of the key strictly before this one (by ``order``), as a two-level prefix count.

    Bucket totals are prefix-summed over buckets only, then added to the count inside the bucket.
    """
    b = df.withColumn("_b", bucket_of(at, width_us))
    totals = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_n").over(
        W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = b.withColumn("_i", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order)) - 1)
    return inner.join(before, [*keys, "_b"]).withColumn(name, (F.col("_before") + F.col("_i")).cast("long")).drop("_before", "_i", "_b")


def lag_columns(df: DataFrame, keys: list[str], at: str, row_id: str, carry: list[str], width_us: int) -> DataFrame:
    """``prev_*`` of the key's previous row (by time, then id) at any distance, in two levels.

    Within a bucket a window finds it; a bucket's first row takes the last row of the previous non-empty bucket from
    a window over one summary row per bucket.
    """
    packed = F.struct(F.col(at).alias("_at"), F.col(row_id).alias("_id"), *[F.col(c).alias(f"prev_{c}") for c in carry])
    b = df.withColumn("_b", bucket_of(at, width_us))
    w = W.partitionBy(*keys, "_b").orderBy(F.col(at), F.col(row_id))
    inside = b.withColumn("_p", F.lag(packed).over(w))
    ends = b.groupBy(*keys, "_b").agg(F.max(packed).alias("_last"))
    ends = ends.select(*keys, "_b", F.lag("_last").over(W.partitionBy(*keys).orderBy("_b")).alias("_q"))
    out = inside.join(ends, [*keys, "_b"])
    return out.withColumn("_p", F.coalesce("_p", "_q")).select(*df.columns, *[F.col(f"_p.prev_{c}").alias(f"prev_{c}") for c in carry])


def sessions(df: DataFrame, keys: list[str], at: str, gap_us) -> DataFrame:
    """(keys, _b, session_at): the session each time bucket belongs to. Rows at most ``gap_us`` apart share a session.

    Buckets are one gap wide, so all rows of a bucket share a session and only bucket ends are compared: rows are first
    aggregated to one row per (key, bucket), and the ordered pass sees those alone. ``gap_us`` may be a column that is
    constant per key. ``session_at`` is the first row's time in microseconds.
    """
    gap = gap_us if isinstance(gap_us, Column) else F.lit(int(gap_us)).cast("long")
    t = F.unix_micros(F.col(at))
    # bucket width gap+1 us would let two rows be gap apart inclusive; width gap keeps them strictly closer
    b = df.select(*keys, t.alias("_t"), gap.alias("_gap"), bucket_of(at, gap).alias("_b"))
    ends = b.groupBy(*keys, "_b").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.max("_gap").alias("_gap"))
    w = W.partitionBy(*keys).orderBy("_b")
    opens = F.col("_first") - F.lag("_last").over(w) > F.col("_gap")
    marked = ends.withColumn("_open", F.when(F.coalesce(opens, F.lit(True)), F.col("_first")))
    return marked.withColumn("session_at", F.last("_open", ignorenulls=True).over(w)).select(*keys, "_b", "session_at")


def trailing_count(df: DataFrame, keys: list[str], at: str, span_us: int, name: str) -> DataFrame:
    """Rows of the key in the ``span_us`` before each row (row's own instant excluded).

    Buckets are one span wide and each row is also seen by the next bucket, so a window holds two spans of one key.
    """
    t = F.unix_micros(F.col(at))
    b = df.withColumn("_t", t).withColumn("_b", F.floor(t / F.lit(span_us)).cast("long")).withColumn("_own", F.lit(True))
    echo = b.select(*[c for c in b.columns if c not in ("_b", "_own")], (F.col("_b") + 1).alias("_b"), F.lit(False).alias("_own"))
    w = W.partitionBy(*keys, "_b").orderBy("_t").rangeBetween(-span_us, -1)
    both = b.unionByName(echo).withColumn(name, F.count(F.lit(1)).over(w))
    return both.filter("_own").drop("_t", "_b", "_own")
