"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Items go in by falling length: each to the open bin it leaves least room in. Where none has
room, every permitted length is tried on the lengths still to come, and the one with the least cost per token it would hold is opened.
At the end each bin is cut down to the smallest permitted length that holds its contents.

Documents are dealt by a hash of their id to shards of some ``shard_rows`` rows, so a task packs a bounded number of lengths and the
texts themselves are never moved: only (doc_id, length) is shuffled. Every shard leaves a few bins part empty, a share of them that
falls with shard_rows.

A document longer than the largest length is cut into pieces of that length and a rest. A null or empty text, or one without a word, is
one row with length 0 and no bin. Repeated rows are packed each; ties go by id.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import texts

CAPACITIES = (512, 1024, 2048, 4096, 8192)
SHARD_ROWS = 20_000
# Tokens that opening one more sequence costs besides its length.
OPEN_COST = 32

SCHEMA = "doc_id long, piece long, start long, n_tokens long, bin_id long, bin_capacity long, bin_offset long"


def word_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n): words of each whole text plus one end token; 0 for a text without a word."""

    def run(batches):
        for b in batches:
            n = [len(t.as_py().encode("utf-8", "surrogatepass").split()) if t.is_valid else 0 for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([k + 1 if k else 0 for k in n], pa.int64())], ["doc_id", "n"])

    return texts(docs).mapInArrow(run, "doc_id long, n long")


def _filled(room: int, lengths: list[int], left: dict[int, int]) -> int:
    """Tokens that greedy filling by falling length would put into ``room``."""
    used = 0
    i = bisect_right(lengths, room)
    while i:
        size = lengths[i - 1]
        n = min(left[size], room // size)
        used += n * size
        room -= n * size
        i = min(i - 1, bisect_right(lengths, room))
    return used


def pack(sizes: list[int], capacities=CAPACITIES, open_cost: int = OPEN_COST) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, offset in it, final capacity of each bin); ``sizes`` fall and none is above the largest capacity."""
    left: dict[int, int] = {}
    for s in sizes:
        left[s] = left.get(s, 0) + 1
    lengths = sorted(left)
    rooms: list[tuple[int, int]] = []  # (room, bin) of open bins, sorted
    used: list[int] = []
    where, offset = [], []
    for s in sizes:
        left[s] -= 1
        if not left[s]:
            lengths.pop(bisect_left(lengths, s))
        k = bisect_left(rooms, (s, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            b = len(used)
            used.append(0)
            room = min((c for c in capacities if c >= s), key=lambda c: ((c + open_cost) / (s + _filled(c - s, lengths, left)), c))
        where.append(b)
        offset.append(used[b])
        used[b] += s
        if room > s:
            insort(rooms, (room - s, b))
    return where, offset, [next(c for c in capacities if c >= u) for u in used]


def best_fit(lengths: DataFrame, capacities=CAPACITIES, shard_rows: int = SHARD_ROWS, open_cost: int = OPEN_COST) -> DataFrame:
    """Pack (doc_id, n) rows; one row per piece with its bin, the bin's final length and the piece's place in it."""
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    shards = -(-lengths.count() // shard_rows) or 1

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        items = []
        for d, n in zip(rows["doc_id"], rows["n"]):
            d = None if pd.isna(d) else int(d)
            items += [(d, k, k * top, min(top, n - k * top)) for k in range(-(-n // top))] or [(d, 0, 0, 0)]
        items.sort(key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
        full = [x for x in items if x[3]]
        where, offset, final = pack([x[3] for x in full], capacities, open_cost)
        out = [(*x, (shard << 32) + b, final[b], o) for x, b, o in zip(full, where, offset)] + [(*x, None, None, None) for x in items if not x[3]]
        cols = [c.split()[0] for c in SCHEMA.split(", ")]
        return pd.DataFrame(out, columns=cols).astype("Int64")

    return lengths.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n"), F.lit(shards))).groupBy("shard").applyInPandas(run, SCHEMA)
