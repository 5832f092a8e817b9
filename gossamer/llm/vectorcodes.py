"""Product codes of vectors by member-resident Lloyd rounds.

A vector's components become integers and the vector is cut into equal parts; each part position has a codebook that a few Lloyd rounds move.
The parts live with their owners: blocks of parts dealt by (position, entry, salt) and written there. In a round an owner sums its resident
parts, the sums of all salts meet (one row per entry and component) and make the new codebook; then every owner assigns its residents again.
Parts that keep their entry are written in place by the task that holds them; only those that change it go through the next shuffle, to their
new owner. The salt spreads an entry that holds a third of all parts over many owners.

A block is up to ``BLOCK`` parts of one origin (up to ``ORIGIN`` vectors read together), position and entry: packed member numbers and integers. At the
end blocks, with errors instead of parts, go back to their origin, where the codes are put together. Each step is a table in the shared
folder, so a lost executor costs the tasks it ran; the table before is deleted once the next is written. Only the codebooks reach the
driver: ``entries`` x dimension numbers.

Dropped: a null vector, and one with a null or non-finite component. The dimension is that of the kept vector with the least id whose length
divides by the parts; vectors of other lengths go too. Integers beyond +-2^27 count as +-2^27, so that all sums fit. Null ids come last among the seeds;
equal ids go by their vectors. Rows with equal ids are coded each. With fewer vectors than entries the codebooks are shorter. An empty table gives
no rows. The vectors should come from a stored table: a task that is run again must read its rows in the same order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import broadcast, drop_folder
from gossamer.session import shared_path

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LIMIT = 1 << 27
ORIGIN = 2048
BLOCK = 512

_BLOCKS = "origin long, pos int, entry int, moved boolean, n int, member binary, part binary, ids array<long>, labels array<string>"
_CODES = "vec_id long, label string, code string, error long"
_NAMES = [f.split()[0] for f in _BLOCKS.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string())]
# Position of the one row per origin that holds the ids and labels of its vectors.
HEADER = -1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec, label) of vectors without a null or non-finite component; other columns go no further."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("label"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(F.col("vec").isNotNull() & (F.size("vec") > 0) & sound)


def integers(vec: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(vec * SCALE), -LIMIT, LIMIT).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part; the lower entry wins a tie. Doubles are exact while every product sum stays under 2^53."""
    if max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) <= 1 << 20 and x.shape[1] <= 1024:
        f, c = x.astype(np.float64), book.astype(np.float64)
        far = (c * c).sum(1) - 2 * (f @ c.T)
        e = far.argmin(1)
        return e, (far[np.arange(len(e)), e] + (f * f).sum(1)).astype(np.int64)
    entry, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for a in range(0, len(x), 256):
        far = ((x[a:a + 256, None, :] - book[None]) ** 2).sum(2)
        entry[a:a + 256], error[a:a + 256] = far.argmin(1), far.min(1)
    return entry, error


class Parts:
    """Parts of many blocks side by side; ``x`` holds integers, or errors after the last round."""

    def __init__(self, origin, pos, entry, member, x):
        self.origin, self.pos, self.entry, self.member, self.x = origin, pos, entry, member, x

    @classmethod
    def of(cls, batch, width: int) -> Parts:
        n = batch.column("n").to_numpy(zero_copy_only=False)
        joined = lambda c: b"".join(v.as_py() for v in batch.column(c))
        at = lambda c: np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n)
        return cls(at("origin"), at("pos"), at("entry"), np.frombuffer(joined("member"), np.uint16), np.frombuffer(joined("part"), np.int64 if not width else np.int32).reshape(-1, width or 1))

    def blocks(self, moved: np.ndarray) -> pa.RecordBatch:
        """Packed by (moved, position, entry, origin), at most ``BLOCK`` parts each."""
        o = np.lexsort((self.member, self.origin, self.entry, self.pos, moved))
        keys = np.stack((moved[o].astype(np.int64), self.pos[o], self.entry[o], self.origin[o]), 1)
        new = np.ones(len(o), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(1)
        first = np.flatnonzero(new)
        place = np.arange(len(o)) - np.repeat(first, np.diff(np.append(first, len(o))))
        first = np.flatnonzero(new | (place % BLOCK == 0))
        n = np.diff(np.append(first, len(o)))
        k, member, x = keys[first], self.member[o].astype(np.uint16), np.ascontiguousarray(self.x[o])
        cut = lambda a: _binary(a, np.append(first, len(o)))
        none = len(first)
        return pa.RecordBatch.from_arrays([pa.array(k[:, 3]), pa.array(k[:, 1], pa.int32()), pa.array(k[:, 2], pa.int32()), pa.array(k[:, 0] == 1), pa.array(n, pa.int32()), cut(member), cut(x),
                                           pa.nulls(none, _TYPES[7]), pa.nulls(none, _TYPES[8])], _NAMES)


def _binary(rows: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Bytes of rows[bounds[i]:bounds[i + 1]] as one binary value each."""
    each = rows.dtype.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * each).astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())])


def _pieces(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of some million components: bounds a worker's memory whatever the blocks hold."""
    n = np.cumsum(batch.column("n").to_numpy(zero_copy_only=False)) * width
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(n, (n[a - 1] if a else 0) + (1 << 20), side="right")))
        yield batch.slice(a, b - a)
        a = b


def _begin(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """Blocks of all parts, assigned to the seeds, and the header row of each origin. No shuffle."""
    sent = broadcast(vectors.sparkSession, books)
    parts, _, width = books.shape

    def run(batches):
        books = _value(sent)
        count = 0
        for b in batches:
            for a in range(0, b.num_rows, ORIGIN):
                s = b.slice(a, ORIGIN)
                n, origin = s.num_rows, (TaskContext.get().partitionId() << 32) + count
                count += 1
                x = integers(s.column("vec").flatten().to_numpy(zero_copy_only=False)).reshape(n, parts, width).transpose(1, 0, 2)
                entry = np.concatenate([nearest(x[p], books[p])[0] for p in range(parts)])
                flat = Parts(np.full(n * parts, origin), np.repeat(np.arange(parts), n), entry, np.tile(np.arange(n), parts), x.reshape(-1, width).astype(np.int32))
                yield flat.blocks(np.ones(n * parts, bool))
                yield pa.RecordBatch.from_arrays([pa.array([origin]), pa.array([HEADER], pa.int32()), pa.array([0], pa.int32()), pa.array([True]), pa.array([n], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                                                  pa.array([s.column("vec_id").to_pylist()], _TYPES[7]), pa.array([s.column("label").to_pylist()], _TYPES[8])], _NAMES)

    return vectors.mapInArrow(run, _BLOCKS)


def _value(sent):
    import pickle

    return pickle.loads(sent.value)


def _sums(resident: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """Component sums and, last, the count of every entry: owners add up their residents, the salts meet in one small aggregate."""
    parts, entries, width = shape

    def run(batches):
        total = np.zeros((parts * entries, width + 1), np.int64)
        for b in batches:
            for piece in _pieces(b, width):
                p = Parts.of(piece, width)
                key = p.pos.astype(np.int64) * entries + p.entry
                for d in range(width):  # sums of a piece are exact in doubles
                    total[:, d] += np.bincount(key, p.x[:, d], parts * entries).astype(np.int64)
                total[:, width] += np.bincount(key, minlength=parts * entries)
        used = np.flatnonzero(total[:, width])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, width + 1)), pa.array(np.tile(np.arange(width + 1), len(used)), pa.int64()), pa.array(total[used].ravel())], ["key", "d", "total"])

    out = np.zeros((parts * entries, width + 1), object)
    for r in resident.mapInArrow(run, "key long, d long, total long").groupBy("key", "d").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r["key"], r["d"]] = int(r["total"])
    return out.reshape(parts, entries, width + 1)


def _moved(books: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Floored means of the entries' parts; an entry without parts stays."""
    out = books.copy()
    for p, e in np.argwhere(totals[:, :, -1] > 0):
        out[p, e] = [t // totals[p, e, -1] for t in totals[p, e, :-1]]
    return out


def _assign(resident: DataFrame, books: np.ndarray, last: bool) -> DataFrame:
    """Residents under the new codebook, marked where the entry changed; after the last round with errors in place of parts."""
    sent = broadcast(resident.sparkSession, books)
    width = books.shape[2]

    def run(batches):
        books = _value(sent)
        for b in batches:
            for piece in _pieces(b, width):
                p = Parts.of(piece, width)
                entry, error = np.zeros(len(p.pos), np.int64), np.zeros(len(p.pos), np.int64)
                for k in np.unique(p.pos):
                    at = np.flatnonzero(p.pos == k)
                    entry[at], error[at] = nearest(p.x[at].astype(np.int64), books[k])
                moved, p.entry = entry != p.entry, entry
                if last:
                    moved, p.x = np.zeros(len(moved), bool), error[:, None]
                yield p.blocks(moved)

    return resident.mapInArrow(run, _BLOCKS)


def _together(blocks: DataFrame, parts: int) -> DataFrame:
    """One row per vector from its origin's blocks: the code in part order, two hex digits an entry, and the summed error."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        pos = table.column("pos").to_numpy()
        head = table.slice(int(np.flatnonzero(pos == HEADER)[0]), 1)
        n = head.column("n")[0].as_py()
        code, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
        p = Parts.of(table.filter(pa.array(pos != HEADER)), 0)
        code[p.member, p.pos] = p.entry
        np.add.at(error, p.member, p.x[:, 0])
        raw = code.tobytes().hex()
        ids, labels = (pa.array(head.column(c)[0].as_py(), t) for c, t in (("ids", pa.int64()), ("labels", pa.string())))
        return pa.Table.from_arrays([ids, labels, pa.array([raw[k:k + 2 * parts] for k in range(0, len(raw), 2 * parts)], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return blocks.groupBy("origin").applyInArrow(run, _CODES)


def seeds(kept: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """First codebooks (part, entry, component): the parts of the kept vectors with the least ids. At most ``entries`` vectors reach the driver."""
    order = (F.col("vec_id").asc_nulls_last(), F.col("vec"))
    whole = kept.filter(F.size("vec") % parts == 0)
    first = whole.orderBy(*order).select(F.size("vec").alias("n")).first()
    if first is None:
        return None
    rows = whole.filter(F.size("vec") == first["n"]).orderBy(*order).limit(entries).select("vec").collect()
    return integers(np.array([r["vec"] for r in rows])).reshape(len(rows), parts, -1).transpose(1, 0, 2)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(codes, codebooks): (vec_id, label, code, error) of every usable vector of (vec_id, embedding, label), and the final codebooks as an array by
    part, entry and component. ``entries`` is at most 256."""
    spark = vectors.sparkSession
    kept = usable(vectors)
    books = seeds(kept, parts, entries)
    if rounds < 1 or entries > 256:
        raise ValueError("one round at least, 256 entries at most")
    if books is None:
        return spark.createDataFrame([], _CODES), np.zeros((parts, 0, 0), np.int64)
    shape = books.shape
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners = F.pmod(F.xxhash64("origin"), F.lit(max(4, tasks // 2)))
    read = lambda folder: spark.read.schema(_BLOCKS).parquet(folder)

    blocks = shared_path(spark, "parts")
    _begin(kept.filter(F.size("vec") == parts * shape[2]), books).write.parquet(blocks)
    headers = read(blocks).filter(F.col("pos") == HEADER)
    now, former = read(blocks).filter(F.col("pos") != HEADER), []
    for k in range(rounds):
        arrived = shared_path(spark, "arrivals")
        now.filter("moved").repartition(tasks, F.col("pos"), F.col("entry"), owners).write.parquet(arrived)
        resident = read(arrived) if k == 0 else now.filter("not moved").unionByName(read(arrived))
        books = _moved(books, _sums(resident, shape))
        after = shared_path(spark, "parts")
        _assign(resident, books, k == rounds - 1).write.parquet(after)
        for folder in [arrived, *former]:
            drop_folder(spark, folder)
        now, former = read(after), [after]
    return _together(now.unionByName(headers), parts), books


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def digest(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """Codes with the error summed over each label (null labels together) and the digest of the codebooks."""
    spark = codes.sparkSession
    folder = shared_path(spark, "codes")
    codes.write.parquet(folder)
    codes = spark.read.schema(_CODES).parquet(folder)
    total: Column = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    sums = codes.groupBy(F.col("label").alias("own")).agg(total.alias("label_error"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("own"))).select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
