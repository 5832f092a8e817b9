"""One table of readings from all feeds, with string ids, and the arrival order that the comparing operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.operators.sets import insert_or_ignore, union_feeds
from gossamer.plans.bucketed import running_count

CANONICAL = {
    "key": "string", "source": "string", "source_id": "string", "sensor_id": "string", "kind": "string", "topic": "string", "metric": "string", "value": "double", "observed_at": "timestamp",
    "received_at": "timestamp", "expires": "timestamp", "county_id": "string", "lat": "double", "lon": "double", "zip5": "string", "precision": "string", "period": "string", "confidence": "double", "group_key": "string",
}
HOUR_US = 3600 * 10**6


def canonical(rows: DataFrame, dim_metric: DataFrame, topic: str | None = None) -> DataFrame:
    """A feed's readings under the canonical columns; what else it says is kept as JSON in ``evidence``. The topic is the vocabulary's, else ``topic``; a feed
    that does not say when a row came in is taken to deliver at once; official rows are certain."""
    topics = F.broadcast(dim_metric.select("metric", F.col("topic").alias("_topic")))
    rest = [c for c in rows.columns if c not in CANONICAL]
    df = rows.drop("topic").join(topics, "metric", "left").withColumn("topic", F.coalesce("_topic", F.lit(topic)))
    default = {"received_at": F.col("observed_at"), "precision": F.lit("point"), "confidence": F.lit(1.0)}
    own = set(rows.columns) | {"topic"}
    cols = [(F.col(c) if c in own else default.get(c, F.lit(None))).cast(t).alias(c) for c, t in CANONICAL.items()]
    return df.select(*cols, F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("evidence") if rest else F.lit(None).cast("string").alias("evidence"))


def ingest(feeds: list[DataFrame], stored: DataFrame | None = None) -> DataFrame:
    """U1 and U2 in one job: all feeds in one table, the first arrival of each key, without keys stored already."""
    rows = union_feeds(*feeds)
    order = rows.withColumn("_o", F.struct("received_at", "value", "evidence"))
    known = stored if stored is not None else rows.sparkSession.createDataFrame([], "key string")
    return insert_or_ignore(order, known, "key", "_o").select(*rows.columns)


def numbered(readings: DataFrame, start: int = 0) -> DataFrame:
    """``seq``: 0, 1, ... in order of arrival, then key. Counted per hour of arrival and within it; only one row per hour is ordered as a whole."""
    out = running_count(readings, [], "received_at", ["received_at", "key"], HOUR_US, "seq")
    return out.withColumn("seq", F.col("seq") + F.lit(start).cast("long")) if start else out
