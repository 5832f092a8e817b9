"""Small tables on the driver, only behind a check of their size."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TooLarge(ValueError):
    """A table meant to be a small dimension is not."""


def bounded_rows(df: DataFrame, limit: int) -> list:
    """All rows of a dimension, refusing to collect more than ``limit``."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooLarge(f"more than {limit} rows")
    return rows


def literal_array(rows: list[dict], ddl: str) -> Column:
    """Rows as one constant array of structs (folded to a literal by the optimizer)."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")


def broadcast_if_small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """Broadcast hint when the table has at most ``limit`` rows; otherwise leave the join to the planner."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


SPLIT_BYTES = 128 * 2**20
MAX_TASKS = 20_000
# The planner's size of rows it knows nothing about is near the largest long.
UNKNOWN_BYTES = 2**60


def spread(df: DataFrame) -> DataFrame:
    """Spread a small scan, planned with fewer tasks than the cluster has cores, over all of them ahead of work that copies
    or parses rows. A large input is planned with many splits and passes through unchanged.

    Decided from the optimizer's size estimate and the file list alone: nothing is executed.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= cores * SPLIT_BYTES or not 0 < len(df.inputFiles()) < cores:
        return df
    return df.repartition(cores)


def tasks_for(df: DataFrame, task_bytes: int) -> int:
    """Tasks of ``task_bytes`` of the tables a plan scans, one per core at least. Each scan counts by its files; a join's estimate, the product of its sides, is not used."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    scanned = sum(n for n in sizes if n < UNKNOWN_BYTES)
    return max(df.sparkSession.sparkContext.defaultParallelism, min(MAX_TASKS, -(-scanned // task_bytes)))


def dealt(df: DataFrame, keys: list[str], task_bytes: int) -> DataFrame:
    """Rows dealt by their keys over ``tasks_for`` tasks. For work whose memory is a multiple of its input: adaptive execution measures shuffled bytes and would put too
    much of it in one task. Changes the plan only."""
    return df.repartition(tasks_for(df, task_bytes), *keys)
