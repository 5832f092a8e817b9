"""Importance resampling of documents toward a target text distribution.

A 256-byte table lower-cases A-Z and blanks every other ASCII byte but digits and letters, ``bytes.split`` yields the words, and chained
``zlib.crc32`` seeds extend a word's checksum to the runs of words that begin with it, so no n-gram is ever built as a string. Counters
reduce the buckets inside a task; one row per bucket and task goes on.

The bucket counts of both tables are at most ``buckets`` rows each and go to the driver, which makes one integer gain per bucket. A document's
weight is the floored mean of its features' gains; with Gumbel noise by a hash of its id added, the highest scores are a sample without
replacement, proportional to the weights. The draw needs no global sort: scores are integers between fixed ends, so their histogram is bounded whatever
the corpus holds; it gives the cut and each score's first rank, and only the documents drawn are ordered, within their score.

A null text has no words; a document without a feature has weight 0. An empty target makes weights of smoothed counts alone; an empty corpus gives no
rows. Ties go to the smaller id, null ids last, all hashed as the empty text; then to fewer features. Repeated rows are drawn each, on consecutive ranks:
rows equal in id, features and weight are one row with a count until the end, so a row repeated in a third of the table is no hot key.
Long texts are read whole, in one task each. Other columns go no further; ``drawn`` brings the texts back.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gossamer.llm.common import broadcast, texts
from gossamer.session import shared_path

LONGEST = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"

# Fixed by the word pattern: A-Z become a-z; digits, letters and all bytes from 0x80 stay; the rest are blanks.
TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

_SCORED = "doc_id long, n_words long, n_features long, weight long, score long"
# Copies of one row that are expanded at a time.
_STEP = 65_536


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def checksums(w: list[bytes], longest: int = LONGEST) -> list[int]:
    """crc32 of every run of 1 to ``longest`` words: each length's checksums seed the next's, with a space and the next word."""
    crc = zlib.crc32
    level = [crc(x) for x in w]
    out = list(level)
    if longest > 1:
        spaced = [b" " + x for x in w]
        for n in range(1, min(longest, len(w))):
            level = [crc(x, c) for x, c in zip(spaced[n:], level)]
            out += level
    return out


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of the whole table by bucket."""

    def run(batches):
        held = Counter()
        for b in batches:
            for t in b.column("text"):
                if t.is_valid:
                    held.update(c % buckets for c in checksums(words(t.as_py()), longest))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], ["bucket", "n"])

    return docs.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _bytes(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("text", F.col("text").cast("binary"))


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> list[int]:
    """1000 times the log ratio of smoothed bucket shares, target to corpus, floored."""
    source, wanted = ({r["bucket"]: r["n"] for r in bucket_counts(t, longest, buckets).collect()} for t in (docs, target))
    s_all, t_all = sum(source.values()), sum(wanted.values())
    return [math.floor(1000 * math.log((wanted.get(b, 0) + 1.0) * (s_all + buckets) / ((source.get(b, 0) + 1.0) * (t_all + buckets)))) for b in range(buckets)]


def noise(doc_id: int | None, seed: str = SEED) -> int:
    """Gumbel noise in thousandths, from the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], longest: int = LONGEST, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    sent = broadcast(docs.sparkSession, gain)
    n_buckets = len(gain)

    def run(batches):
        gain = pickle.loads(sent.value)
        for b in batches:
            ids, out = b.column("doc_id").to_pylist(), []
            for d, t in zip(ids, b.column("text")):
                w = words(t.as_py()) if t.is_valid else []
                sums = checksums(w, longest)
                weight = sum(gain[c % n_buckets] for c in sums) // len(sums) if sums else 0
                out.append((d, len(w), len(sums), weight, weight + noise(d, seed)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 5, [f.split()[0] for f in _SCORED.split(", ")])

    return _bytes(docs).mapInArrow(run, _SCORED)


def ranked(found: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` rows with ``rank``: 1, 2, ... for the ``percent`` of eligible documents with the highest scores, else null. Reads ``found`` twice: give it a stored table."""
    spark = found.sparkSession
    eligible = F.col("n_words") >= least_words
    counts = {r["score"]: r["n"] for r in found.filter(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()}
    left = percent * sum(counts.values()) // 100
    size, before, taken = left, [], 0
    for s in sorted(counts, reverse=True):
        if taken >= left:
            break
        before.append((s, taken))
        taken += counts[s]
    if not before:
        return found.withColumn("rank", F.lit(None).cast("long"))
    cut = before[-1][0]
    cols = found.columns
    places = F.broadcast(spark.createDataFrame(before, "score long, before long"))  # at most one row per integer score
    reached = eligible & (F.col("score") >= cut)
    rows = found.filter(reached).groupBy(*cols).agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(places, "score").withColumn("first", F.col("before") + F.coalesce(F.sum("copies").over(order), F.lit(0)))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / _STEP).cast("long"))))
    last = F.least(F.lit(_STEP - 1).cast("long"), F.col("copies") - 1 - F.col("step") * _STEP)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    place = F.col("first") + F.col("step") * _STEP + F.col("copy") + 1
    rest = found.filter(~reached).withColumn("rank", F.lit(None).cast("long"))
    return rest.unionByName(rows.select(*cols, F.when(place <= size, place).alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """Every document's (doc_id, n_words, n_features, weight, score, rank)."""
    folder = shared_path(docs.sparkSession, "scored")
    scored(docs, gains(docs, target, longest, buckets), longest, seed).write.parquet(folder)
    return ranked(docs.sparkSession.read.schema(_SCORED).parquet(folder), percent, least_words)


def drawn(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, whose id is among those drawn; a row without an id is compared by null."""
    ids = found.filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("_drawn")), "left_semi")
