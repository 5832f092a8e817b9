"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.session import shared_path

# Text handed to numpy at a time inside a task: bounds a Python worker's memory whatever the Arrow batch holds.
BLOCK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """Only the two columns the text operators read, under fixed types: other columns, whatever their names, go no further."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


NULL_ID = 2**62
_LEAST_BITS = 24


def identified(docs: DataFrame, name: str = "doc") -> DataFrame:
    """``docs`` with one number for each different (doc_id, text), in order of doc_id, then of a hash of the text; null ids come last.

    Rows that share an id but not a text are different documents, so what one of them holds is never cut from another. The id takes the upper bits, the hash those left,
    24 at least; null ids take half of all numbers. Ids spread so wide that fewer bits would be left are ranked first, which moves each row once more.
    """
    own = F.col("doc_id").cast("long")
    ends = docs.agg(F.min(own).alias("lo"), F.max(own).alias("hi")).first()
    lo, span = ends["lo"] or 0, (ends["hi"] or 0) - (ends["lo"] or 0) + 1
    place, t = own - F.lit(lo), docs
    if span >= 1 << (62 - _LEAST_BITS):
        t, span = _ranked(docs)
        place = F.col("_gs_place")
    bits = 62 - span.bit_length()
    h = F.xxhash64(F.col("text").cast("string"))
    doc = F.when(own.isNull(), F.lit(NULL_ID) + h.bitwiseAND(F.lit(NULL_ID - 1))).otherwise(F.shiftleft(place, bits).bitwiseOR(h.bitwiseAND(F.lit((1 << bits) - 1))))
    return t.withColumn(name, doc).drop("_gs_place")


def _ranked(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows with the rank of their id, and the number of ids: ids sorted by range, counted per part, numbered within it."""
    spark = docs.sparkSession

    def number(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("_gs_id"), pa.array(np.full(b.num_rows, part)), pa.array(np.arange(n, n + b.num_rows))], ["_gs_id", "_part", "_row"])
            n += b.num_rows

    folder, schema = shared_path(spark, "ids"), "_gs_id long, _part long, _row long"
    ids = docs.select(F.col("doc_id").cast("long").alias("_gs_id")).filter("_gs_id IS NOT NULL").distinct()
    ids.repartitionByRange("_gs_id").sortWithinPartitions("_gs_id").mapInArrow(number, schema).write.parquet(folder)
    ids = spark.read.schema(schema).parquet(folder)
    before, n = [], 0
    for part, size in sorted((r["_part"], r["n"]) for r in ids.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):
        before.append((part, n))
        n += size
    ids = ids.join(F.broadcast(spark.createDataFrame(before, "_part long, _before long")), "_part").select("_gs_id", (F.col("_before") + F.col("_row")).alias("_gs_place"))
    return docs.join(ids, F.col("doc_id").cast("long") == F.col("_gs_id"), "left").drop("_gs_id"), n


def broadcast(spark: SparkSession, value) -> Broadcast:
    """A model for Python workers; ``pickle.loads`` of the broadcast's value gives it back. Its classes travel with it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete an intermediate table of our own once nothing reads it any more, on whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def is_held_out(doc_id, mod: int, rest: int):
    """crc32 of the id's text leaves ``rest``; a null id is hashed as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == rest


def blocks(batch: pa.RecordBatch, column: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) of consecutive rows of about ``size`` bytes; a longer text is a block of its own, a null is empty."""
    start, held, total = 0, [], 0
    for i, v in enumerate(batch.column(column)):
        b = v.as_py()
        b = b"" if b is None else b if isinstance(b, bytes) else b.encode("utf-8", "surrogatepass")
        if held and total + len(b) > size:
            yield start, held
            start, held, total = i, [], 0
        held.append(b)
        total += len(b)
    if held:
        yield start, held


def concatenated(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all parts, start of each part and the end)."""
    ends = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    return np.frombuffer(b"".join(parts), np.uint8), ends


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as maximal runs; touching ones join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate(([True], s[1:] > e[:-1]))
    last = np.concatenate((first[1:], [True]))
    return s[first], e[last]
