"""Substring deduplication by content-defined chunking.

A gear rolling hash of the last 32 bytes sets chunk borders where it is highest within 30 bytes on both sides, so an insertion moves only the
borders near it, no chunk but a whole text is shorter than 30 bytes, and few are much longer than the 61 of the mean. Chunks are named by a 128-bit
digest and the first one in corpus order (smaller doc_id, then earlier place) stays. A passage is found if it holds one whole chunk: of passages
of 50 words nearly all, two thirds of their bytes; a wider radius finds less of them and cuts fewer phrases.

A task writes each digest of a block once with its first place; further ones inside the block are settled there, so a chunk that a third of
all documents share is one row per block. Rows then meet by digest in one shuffle; texts are joined to their intervals in another.

Every repeated chunk goes, however short; ``least`` keeps shorter runs of them on request. A null or empty text has no chunk. A null doc_id
counts as the largest. Rows equal in doc_id and text are one document and get equal results; rows that share only the doc_id, or have none, are documents of their own. Long texts are cut into blocks that overlap by the
gear's 32 bytes and the radius, and the chunks are those of the whole text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import BLOCK_BYTES, blocks, identified, merged, texts
from gossamer.llm.repeats import merged_by, packed

WINDOW = 32
RADIUS = 30
LARGEST = 512
LEAST = 0

_GEAR = np.random.default_rng(5).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)


def gear(b: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte: sum of gear values shifted by their age; 32 bits forget what is older than 32 bytes."""
    h = _GEAR[b]
    for k in (1, 2, 4, 8, 16):
        older = h[:-k] << np.uint32(k)
        h = h.copy()
        h[k:] += older
    return h


def _highest(v: np.ndarray, width: int) -> np.ndarray:
    """Maximum of each run of ``width`` values."""
    k = 1
    while 2 * k <= width:
        v = np.maximum(v[:-k], v[k:])
        k *= 2
    return np.maximum(v[:len(v) - (width - k)], v[width - k:]) if k < width else v


def candidates(text: bytes, radius: int = RADIUS) -> np.ndarray:
    """Places after which a chunk may end: the gear is above all of the ``radius`` before and below none of the ``radius`` after, both inside the text."""
    out = []
    for s in range(0, len(text), BLOCK_BYTES):
        a = max(0, s - WINDOW - radius)
        h = gear(np.frombuffer(text[a:s + BLOCK_BYTES + radius], np.uint8))[max(0, s - radius - a):]
        if len(h) > 2 * radius:
            high, own = _highest(h, radius), h[radius:len(h) - radius]
            out.append(np.flatnonzero((own > high[:len(own)]) & (own >= high[radius + 1:])) + max(0, s - radius) + radius + 1)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def cuts(text: bytes, radius: int = RADIUS, largest: int = LARGEST) -> list[int]:
    """Ends of the chunks of a text: ``radius`` bytes or more each, a shorter text whole; up to ``largest`` and ``radius`` more where no border shows."""
    out, at = [], 0
    for c in [*candidates(text, radius).tolist(), len(text)]:
        while c - at > largest + radius:
            at += largest
            out.append(at)
        if at < c:
            out.append(c)
            at = c
    return out


_ROW = "h1 long, h2 long, doc long, s long, e long, gone boolean"
_GONE = "doc long, s long, e long"


def _record(arrays, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], [f.split()[0] for f in schema.split(", ")])


def _earlier(h1, h2, doc, s, e):
    """Rows in order of digest and place, and whether each has an equal one before it; a place that comes twice (a repeated row) is one."""
    order = np.lexsort((s, doc, h2, h1))
    h1, h2, doc, s, e = h1[order], h2[order], doc[order], s[order], e[order]
    again = np.zeros(len(h1), bool)
    again[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
    once = np.ones(len(h1), bool)
    once[1:] = ~again[1:] | (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])
    h1, h2, doc, s, e, again = h1[once], h2[once], doc[once], s[once], e[once], again[once]
    return h1, h2, doc, s, e, again


def chunk_rows(docs: DataFrame) -> DataFrame:
    """One row per digest of a block with its first place, and the intervals of the block's further copies (``gone``, dealt by document)."""

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for b in batches:
            ids = b.column("doc").to_numpy(zero_copy_only=False)
            for at, part in blocks(b):
                names, s, e, n = [], [], [], []
                for t in part:
                    ends = cuts(t)
                    begins = [0, *ends[:-1]] if ends else []
                    names += [digest(t[x:y]) for x, y in zip(begins, ends)]
                    s += begins
                    e += ends
                    n.append(len(ends))
                h = np.frombuffer(b"".join(names), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
                doc = np.repeat(ids[at:at + len(part)], n)
                h1, h2, doc, s, e, again = _earlier(h[:, 0], h[:, 1], doc, np.array(s, np.int64), np.array(e, np.int64))
                yield _record((h1[~again], h2[~again], doc[~again], s[~again], e[~again], np.zeros(int((~again).sum()), bool)), _ROW)
                d, x, y = merged_by(doc[again], s[again], e[again])
                yield _record((d, np.zeros(len(d), np.int64), d, x, y, np.ones(len(d), bool)), _ROW)

    return docs.select("doc", "text").mapInArrow(run, _ROW)


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc, s, e): intervals of chunks that are not the first of their digest."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            h1, h2, doc, s, e, gone = (pa.Table.from_batches(got).column(c).to_numpy() for c in ("h1", "h2", "doc", "s", "e", "gone"))
            _, _, d, x, y, again = _earlier(h1[~gone], h2[~gone], doc[~gone], s[~gone], e[~gone])
            yield _record(merged_by(np.concatenate((doc[gone], d[again])), np.concatenate((s[gone], x[again])), np.concatenate((e[gone], y[again]))), _GONE)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunk_rows(docs).repartition(parts, "h1").mapInArrow(run, _GONE)


def without_repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, z, spans): compressed text and the repeated chunks of every row of ``docs``."""
    keyed = identified(texts(docs))
    spans = repeated_chunks(keyed).groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return packed(keyed).join(spans, "doc", "left").select("doc_id", "z", "spans")


def digest(found: DataFrame, least: int = LEAST) -> DataFrame:
    """n_bytes, n_chunks, n_repeated chunks, n_removed bytes (runs of ``least`` bytes or more), the removed spans and the sha256 of the rest."""
    schema = "doc_id long, n_bytes long, n_chunks long, n_repeated long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept_sha256 string"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        d = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for z, spans in zip(b.column("z"), b.column("spans")):
                text = d.decompress(z.as_py()) if z.is_valid else b""
                got = spans.values.flatten() if spans.is_valid else None
                s, e = merged(*(x.to_numpy() for x in got)) if got else (np.zeros(0, np.int64),) * 2
                ends = np.array(cuts(text), np.int64)
                repeated = int((np.searchsorted(ends, e) - np.searchsorted(ends, s, side="right") + 1).sum())  # runs are of whole chunks
                long = e - s >= least
                s, e = s[long], e[long]
                h, at = hashlib.sha256(), 0
                for x, y in zip(s.tolist(), e.tolist()):
                    h.update(text[at:x])
                    at = y
                h.update(text[at:])
                out.append((len(text), len(ends), repeated, int((e - s).sum()), len(s), [{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())], h.hexdigest()))
            c = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in c[:5]), pa.array(c[5], span), pa.array(c[6], pa.string())],
                                             ["doc_id", "n_bytes", "n_chunks", "n_repeated", "n_removed", "n_spans", "spans", "kept_sha256"])

    return found.mapInArrow(run, schema)
