"""The landing zone: how fetched payloads lie in it, one document per fetch, and what of it cannot be read.

A fetch is a row (batch_id, document) of Parquet files that hold many: a JSON document, or delimited lines with an optional head, as it came. A file or folder per
fetch would make the driver list and commit, and tasks open, as many as there are fetches. Readers with the landing schemas are in ``feeds``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.plans.bounded import dealt
from gossamer.session import shared_path

DOCUMENTS = "batch_id long, document string"
# Scanned bytes whose records one task gathers to documents, some twenty times as large.
TASK_BYTES = 2**20


def write_documents(rows: DataFrame, record: Column, batch: Column, head: str, tail: str, folder: str | None = None, joint: str = ",") -> str:
    """Write one document per batch: its records between ``head`` and ``tail``. A batch is one fetch, so its size is the provider's."""
    folder = folder or shared_path(rows.sparkSession, "landed")
    each = dealt(rows.withColumn("batch_id", batch.cast("long")), ["batch_id"], TASK_BYTES)
    docs = each.groupBy("batch_id").agg(F.concat(F.lit(head), F.array_join(F.collect_list(record), joint), F.lit(tail)).alias("document"))
    docs.write.mode("append").parquet(folder)
    return folder


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Landed documents as they came: (batch_id, document)."""
    return spark.read.schema(DOCUMENTS).parquet(folder)


def write_features(rows: DataFrame, feature: Column, batch: Column, folder: str | None = None) -> str:
    """FeatureCollection documents."""
    return write_documents(rows, F.to_json(feature), batch, '{"type": "FeatureCollection",\n"features": [', "]}", folder)


def write_list(rows: DataFrame, record: Column, batch: Column, key: str | None = None, folder: str | None = None) -> str:
    """Documents that are a JSON list, or hold it under ``key``."""
    head, tail = (f'{{"{key}": [', "]}") if key else ("[", "]")
    return write_documents(rows, F.to_json(record), batch, head, tail, folder)


def write_lines(rows: DataFrame, columns: list[str], batch: Column, sep: str, header: bool = False, folder: str | None = None) -> str:
    """Delimited text; a null is an empty field."""
    line = F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])
    return write_documents(rows, line, batch, sep.join(columns) + "\n" if header else "", "\n", folder, "\n")


def unreadable(spark: SparkSession, folder: str, ddl: str) -> DataFrame:
    """(batch_id, file, record, lost) of documents that do not parse under the schema. ``lost`` says that nothing of one could be read; else single
    fields were of another type and read as null."""
    from gossamer.sources.feeds import CORRUPT, as_documents

    docs = documents(spark, folder).select("batch_id", F.col("_metadata.file_path").alias("file"), as_documents(F.col("document"), f"{ddl}, {CORRUPT} string").alias("_d"))
    seen = docs.select("batch_id", "file", "_d.*")
    nothing = F.lit(True)
    for c in seen.columns[2:]:
        if c != CORRUPT:
            nothing = nothing & F.col(c).isNull()
    return seen.select("batch_id", "file", F.col(CORRUPT).alias("record"), nothing.alias("lost")).filter("record IS NOT NULL")
