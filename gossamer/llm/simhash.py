"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are reduced to distinct values first, so a group of copies is one row however large it is. Two fingerprints within four
bits agree on at least two of six bit blocks, so each value is dealt to the 15 pairs of blocks it could share with another, a key of 20
to 22 bits. Inside a key the values are sorted by Gray rank; runs of them form nodes, nodes form upper nodes, and each node keeps only
the bits on which all below it agree and which its parent has not stated yet. A query walks down adding up differing bits and leaves a
group as soon as the sum passes the limit.

Only connectivity is asked for, so a task never writes pairs: it unites what it finds and writes one edge per value to the least value
of its group. A node whose values all belong to the query's group already is left as well, which keeps a dense group of near copies
from being compared pair by pair. Groups are then joined across keys by the library's component rounds.

``similar`` is the production form: five-word similarity of 0.8 and more moves far more than four bits, so it links by two fingerprints. That of two-word shingles, which
edits disturb least, routes by 48 samples of 20 bits and is searched by the same index within 10 bits; that of five-word shingles must then be within 14.

A null or empty text has fingerprint zero and is linked like any other. Rows without a doc_id take part in links; their component is
the least doc_id reachable, null if there is none. Repeated rows get the same fingerprint and component each.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import blocks, texts
from gossamer.plans.components import components
from gossamer.session import checkpointed

SEED = 42
SHINGLE = 4
LIMIT = 4
# Six blocks of 64 bits: (first bit, width). Four differing bits leave two blocks untouched.
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
FAN = 8
# Of ``similar``: shingles and limits of the routed and the checking fingerprint, samples of bits, and buckets compared directly up to a size.
SHINGLES, LIMITS = (2, 5), (10, 14)
SAMPLES = [np.sort(np.random.default_rng(100 + k).permutation(64)[:20]) for k in range(48)]
SMALL = 32


def _hashes(text: bytes, shingle: int = SHINGLE) -> list[int]:
    w = text.lower().split()  # bytes: A-Z only, and breaks are \x20 and \x09-\x0D
    if not w:
        return []
    h = xxhash.xxh64_intdigest
    if len(w) < shingle:
        return [h(b" ".join(w), SEED)]
    return [h(b" ".join(s), SEED) for s in zip(*(w[k:] for k in range(shingle)))]


def _fingerprints(part: list[bytes], shingle: int) -> np.ndarray:
    each = [_hashes(t, shingle) for t in part]
    n = np.array([len(x) for x in each])
    votes = np.zeros((len(part), 64), np.int64)
    if n.sum():
        h = np.fromiter(itertools.chain.from_iterable(each), np.uint64, int(n.sum()))
        full = np.flatnonzero(n)
        starts = np.concatenate(([0], np.cumsum(n[full])[:-1]))
        bits = np.unpackbits(h.byteswap().view(np.uint8).reshape(-1, 8), axis=1)  # highest bit first
        votes[full] = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, shingles: tuple[int, ...] = (SHINGLE,)) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long; further shingle lengths give fp2 and so on."""
    names = ["fp", *(f"fp{k}" for k in range(2, len(shingles) + 1))]

    def run(batches):
        for b in batches:
            found = [[_fingerprints(part, k) for k in shingles] for _, part in blocks(b)]
            cols = [np.concatenate(c) for c in zip(*found)] or [np.zeros(0, np.int64)] * len(names)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, cols)], ["doc_id", *names])

    return texts(docs).mapInArrow(run, ", ".join(["doc_id long", *(f"{c} long" for c in names)]))


def gray_rank(v: np.ndarray) -> np.ndarray:
    """Position of a value in the reflected Gray sequence."""
    r = v.astype(np.uint64).copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Hierarchy over the values of one key, sorted by Gray rank. ``group`` is each value's group so far (index of its least member)."""

    def __init__(self, values: np.ndarray, check: np.ndarray | None = None, within: int = 64):
        """``check`` holds a second value for each, and links need at most ``within`` differing bits there too."""
        self.order = np.argsort(gray_rank(values), kind="stable")
        self.values, self.check, self.within = values[self.order], None if check is None else check[self.order], within
        n = len(values)
        self.group = np.arange(n)
        full = np.uint64(2**64 - 1)
        levels = [(self.values, np.full(n, full), np.arange(n), np.arange(n) + 1)]  # value, agreed bits, first and last item
        while len(levels[-1][0]) > FAN:
            v, m, lo, hi = levels[-1]
            at = np.arange(0, len(v), FAN)
            both = np.bitwise_and.reduceat(v & m, at)
            neither = np.bitwise_and.reduceat(~v & m, at)
            levels.append((both, both | neither, lo[at], hi[np.minimum(at + FAN, len(v)) - 1]))
        self.levels = levels[::-1]

    def checked(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.check is None:
            return a, b
        ok = np.bitwise_count(self.check[a] ^ self.check[b]) <= self.within
        return a[ok], b[ok]

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the groups of linked items, until every linked pair has one label."""
        while True:
            ga, gb = self.group[a], self.group[b]
            if (ga == gb).all():
                return
            np.minimum.at(self.group, np.maximum(ga, gb), np.minimum(ga, gb))
            while True:
                up = self.group[self.group]
                if (up == self.group).all():
                    break
                self.group = up

    def link(self, limit: int = LIMIT) -> np.ndarray:
        """Group label of every value: two values within ``limit`` bits share one."""
        n = len(self.values)
        v = self.values
        width = min(max(256, n // 64), 4096)
        for step in (1, 2, 4):  # neighbours in Gray order first: most of a dense group is one group before any walk
            near = np.flatnonzero(np.bitwise_count(v[step:] ^ v[:-step]) <= limit)
            self.unite(*self.checked(near, near + step))
        # few queries at a time, so later ones profit from what earlier ones united
        for start in range(0, n, width):
            q = np.arange(start, min(start + width, n))
            node = np.zeros(0, np.int64)
            diff = np.zeros(0, np.int64)
            query = np.zeros(0, np.int64)
            stated = None
            for depth, (value, mask, lo, hi) in enumerate(self.levels):
                if depth == 0:
                    query, node = np.repeat(q, len(value)), np.tile(np.arange(len(value)), len(q))
                    diff = np.zeros(len(query), np.int64)
                    new = mask[node]
                else:
                    kids = node[:, None] * FAN + np.arange(FAN)
                    there = kids < len(value)
                    query, diff, new = np.repeat(query, FAN)[there.ravel()], np.repeat(diff, FAN)[there.ravel()], np.repeat(stated, FAN)[there.ravel()]
                    node = kids.ravel()[there.ravel()]
                    new = mask[node] & ~new  # bits the parent has not counted
                diff = diff + np.bitwise_count((v[query] ^ value[node]) & new)
                least = np.minimum.reduceat(self.group, lo)
                most = np.maximum.reduceat(self.group, lo)
                known = (least == most)[node] & (least[node] == self.group[query])
                ok = (diff <= limit) & (lo[node] < query) & ~known  # each pair once, from its later item
                query, node, diff = query[ok], node[ok], diff[ok]
                stated = mask[node]
            query, node = self.checked(query, node)
            if len(query):
                self.unite(query, node)
        return self.group


def _routes(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (key, value): a pair of blocks and the bits in them."""
    u = fp.view(np.uint64)
    keys = []
    for k, (a, b) in enumerate(itertools.combinations(BLOCKS, 2)):
        one, two = ((u >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in (a, b))
        keys.append((np.uint64(k) << np.uint64(40)) | (one << np.uint64(20)) | two)
    return np.concatenate(keys).view(np.int64), np.tile(fp, len(keys))


def _linked(table: pa.Table) -> pa.Table:
    """Edges (value, least value of its group) of all keys in one partition."""
    key, fp = (table.column(c).to_numpy() for c in ("key", "fp"))
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
    ends = np.concatenate((at[1:], [len(key)]))
    pair = at[ends - at == 2]  # a key of two values is one comparison
    pair = pair[np.bitwise_count(fp[pair].view(np.uint64) ^ fp[pair + 1].view(np.uint64)) <= LIMIT]
    us, vs = [fp[pair + 1]], [fp[pair]]
    for s, e in zip(at[ends - at > 2], ends[ends - at > 2]):
        x = GrayIndex(fp[s:e].view(np.uint64))
        g = x.link()
        moved = np.flatnonzero(g != np.arange(len(g)))
        us.append(x.values[moved].view(np.int64))
        vs.append(x.values[g[moved]].view(np.int64))
    return pa.table({"u": np.concatenate(us), "v": np.concatenate(vs)})


def links(values: DataFrame) -> DataFrame:
    """Edges (u, v) that connect the distinct longs of ``fp`` within four bits; one per value and key at most."""

    def route(batches):
        for b in batches:
            key, fp = _routes(b.column("fp").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], ["key", "fp"])

    def search(batches):
        # A partition holds 16 bytes a value, and its size follows spark.sql.shuffle.partitions.
        got = [b for b in batches if b.num_rows]
        if got:
            yield from _linked(pa.Table.from_batches(got)).to_batches()

    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = values.mapInArrow(route, "key long, fp long").repartition(parts, "key")
    return dealt.mapInArrow(search, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    rows = checkpointed(fingerprints(docs))
    values = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(values.select("fp")))
    # node and root are fingerprints; the smallest doc_id of a root's fingerprints names the component
    named = values.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def _sampled(fp: np.ndarray) -> np.ndarray:
    """Keys of every value: the number of a sample and its bits."""
    u = fp.view(np.uint64)
    keys = []
    for k, sample in enumerate(SAMPLES):
        key = np.full(len(u), k, np.uint64)
        for bit in sample.tolist():
            key = (key << np.uint64(1)) | ((u >> np.uint64(bit)) & np.uint64(1))
        keys.append(key)
    return np.concatenate(keys).view(np.int64)


def _similar(table: pa.Table, limits: tuple[int, int]) -> pa.Table:
    """Edges between values of one key, both as (fp, fp2). Small keys are compared side by side, all keys at once; larger ones through the index."""
    key, fp, fp2 = (table.column(c).to_numpy() for c in ("key", "fp", "fp2"))
    order = np.argsort(key, kind="stable")
    key, fp, fp2 = key[order], fp[order].view(np.uint64), fp2[order].view(np.uint64)
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
    size = np.diff(np.append(at, len(key)))
    small = np.repeat(size <= SMALL, size)
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, min(SMALL, int(size.max(initial=1)))):
        a = np.flatnonzero(small[:-step] & (key[step:] == key[:-step]))
        a = a[np.bitwise_count(fp[a] ^ fp[a + step]) <= limits[0]]
        a = a[np.bitwise_count(fp2[a] ^ fp2[a + step]) <= limits[1]]
        us.append(a + step)
        vs.append(a)
    for s, n in zip(at[size > SMALL].tolist(), size[size > SMALL].tolist()):
        x = GrayIndex(fp[s:s + n], fp2[s:s + n], limits[1])
        g = x.link(limits[0])
        moved = np.flatnonzero(g != np.arange(n))
        us.append(s + x.order[moved])
        vs.append(s + x.order[g[moved]])
    u, v = np.concatenate(us), np.concatenate(vs)
    return pa.table({"a": fp[u].view(np.int64), "a2": fp2[u].view(np.int64), "b": fp[v].view(np.int64), "b2": fp2[v].view(np.int64)})


def similar(docs: DataFrame, shingles: tuple[int, int] = SHINGLES, limits: tuple[int, int] = LIMITS) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs``: groups linked by both fingerprints, named by their least doc_id.

    A link is found if its bits agree on one sample: nearly certain up to six differing bits, 96 % at eight. Small keys hold at most ``SMALL`` values, so no task writes the
    pairs of a dense group.
    """
    rows = checkpointed(fingerprints(docs, shingles))
    values = rows.groupBy("fp", "fp2").agg(F.min("doc_id").alias("least"))

    def route(batches):
        for b in batches:
            fp, fp2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "fp2"))
            yield pa.RecordBatch.from_arrays([pa.array(_sampled(fp)), pa.array(np.tile(fp, len(SAMPLES))), pa.array(np.tile(fp2, len(SAMPLES)))], ["key", "fp", "fp2"])

    def search(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            yield from _similar(pa.Table.from_batches(got), limits).to_batches()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = values.select("fp", "fp2").mapInArrow(route, "key long, fp long, fp2 long").repartition(parts, "key")
    edges = dealt.mapInArrow(search, "a long, a2 long, b long, b2 long").select(F.xxhash64("a", "a2").alias("u"), F.xxhash64("b", "b2").alias("v"))
    named = values.withColumn("node", F.xxhash64("fp", "fp2")).join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "fp2", "component_id"), ["fp", "fp2"]).select("doc_id", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
