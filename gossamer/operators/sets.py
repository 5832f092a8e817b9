"""Unions, insert-or-ignore, first-of-key and set comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions import scalars as X


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """All feeds in one table; a column a feed lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row of each key by ``order``: an aggregated min, so copies combine before they shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def insert_or_ignore(incoming: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """Rows to append: the first of each key not stored yet."""
    return first_per_key(incoming, [key], order).join(existing.select(key), key, "left_anti")


def fresh_stories(incoming: DataFrame, seen: DataFrame, order: str) -> DataFrame:
    """One item per title key not seen before; items without a key always pass."""
    d = incoming.withColumn("title_key", X.title_key("title"))
    keyed = insert_or_ignore(d.filter(F.col("title_key") != ""), seen.select(X.title_key("title").alias("title_key")), "title_key", order)
    return keyed.unionByName(d.filter(F.col("title_key") == ""))


def set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """U5."""
    return left.join(right.select(*keys), keys, "left_anti")


def shared_keys(groups: DataFrame, group: str, wanted: DataFrame, key: str) -> DataFrame:
    """How many distinct keys of each group are among the wanted ones; groups sharing none drop out."""
    return groups.select(group, key).distinct().join(wanted.select(key), key, "left_semi").groupBy(group).agg(
        F.count(F.lit(1)).alias("shared"))


def replace_message(rows: DataFrame, base: str, version: str) -> DataFrame:
    """An edited message's rows replace those of its earlier versions."""
    newest = rows.groupBy(base).agg(F.max(version).alias("_v"))
    return rows.join(newest, base).filter(F.col(version) == F.col("_v")).drop("_v")
