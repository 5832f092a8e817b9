"""Removal of byte strings that occur earlier in the corpus, over enhanced suffix arrays scanned as common-prefix interval trees.

1. Anchors. Every window of ``length`` bytes is owned by its least 32-byte gram (by hash, leftmost on ties). Equal windows have equal owners at
   equal offsets, so only windows of one owner gram have to meet. An owner and the run of windows it owns is a segment; about one byte in
   35 starts one. Segments are rows of two hashes, a document and a place; copies of a segment inside one block of a task are settled
   there, so a passage in a third of all documents is one row per block.
2. Segments of one owner gram meet. Equal ones keep their first occurrence. A gram with several different segments, as at the border of a
   repeat or an edit, asks for their text.
3. The asked pieces are cut from the documents and dealt by gram. A gram with more than ``hot`` different segments is dealt by single windows
   under the window's own hash, so no task gathers it. Each task builds an enhanced suffix array of its pieces (suffix order by prefix
   doubling, longest common prefixes of neighbours), scans it with a stack into the tree of common-prefix intervals, tests each interval's
   left extensions, and has the maximal repeat groups with all occurrences. All but the first occurrence go.
4. Intervals are joined to their documents and the rest is hashed.

Texts cross the shuffle compressed. Only equality of 128-bit hashes is taken for equality of segments; windows that share just a gram are
compared as text.

A null or empty text has nothing to remove. A null doc_id counts as the largest. Rows equal in doc_id and text are one document and get
equal results; rows that share only the doc_id, or have none, are documents of their own. Very long texts are cut into overlapping blocks for numpy and are otherwise whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import BLOCK_BYTES, blocks, concatenated, identified, merged, texts
from gossamer.session import shared_path

LENGTH = 100
GRAM = 32
HOT = 4096
SUFFIX_BYTES = 1 << 20  # text under one suffix array: some 130 bytes of ranks and sort buffers each

_U = np.uint64
_BYTE_CODES = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
_ODD = np.random.default_rng(11).integers(0, 2**63, 8, dtype=np.uint64) * _U(2) + _U(1)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hash of the 32 bytes from each position on."""
    h = _BYTE_CODES[b]
    for k in range(5):
        h = h[:len(h) - (1 << k)] * _ODD[k] + h[1 << k:] if len(h) > (1 << k) else h[:0]
    h = (h ^ (h >> _U(31))) * _ODD[5]
    return h ^ (h >> _U(29))


def owners(h: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Position of the least gram of the window from each position on."""
    span = length - GRAM + 1
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = _U((1 << 24) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    rest = span - width
    return (np.minimum(key[:n], key[rest:rest + n]) & low).astype(np.int64)


def segments(b: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, gram hash, first window, number of windows) of every segment of several texts laid end to end."""
    h = gram_hashes(b)
    own = owners(h, length)
    n = len(own)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[:n]
    inside = np.arange(n) + length <= ends[text + 1]
    new = np.ones(n, bool)
    new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    new &= inside
    lo = np.flatnonzero(new)
    # windows inside a text run on until the next segment or the text's end
    run = np.cumsum(new) - 1
    count = np.bincount(run[inside], minlength=len(lo)) if len(lo) else np.zeros(0, np.int64)
    return text[lo], h[own[lo]], lo, count


def _pieces(parts: list[bytes], length: int, size: int = BLOCK_BYTES):
    """(texts, their starts in the document, first and last owner position to report) with long texts cut so that every owner is seen with all its windows."""
    if len(parts) > 1 or len(parts[0]) <= 2 * size:
        yield parts, 0, 0, None
        return
    t, reach = parts[0], length - GRAM
    for s in range(0, len(t), size):
        a = max(0, s - reach)
        yield [t[a:s + size + length]], a, s - a, s - a + size


def _ordered(kh, sh, doc, lo, *rest):
    """Segments by gram, hash and place; a place that comes twice (a repeated row) is one."""
    order = np.lexsort((lo, doc, sh, kh))
    kh, sh, doc, lo, *rest = (c[order] for c in (kh, sh, doc, lo, *rest))
    once = np.ones(len(kh), bool)
    once[1:] = (kh[1:] != kh[:-1]) | (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1])
    return [c[once] for c in (kh, sh, doc, lo, *rest)]


def _anchor_rows(docs: np.ndarray, parts: list[bytes], length: int):
    """Segments of a block as (gram, segment hash, doc, lo, n, end), copies within the block as intervals with n = 0."""
    out = []
    for piece, base, first, last in _pieces(parts, length):
        b, ends = concatenated(piece)
        text, kh, lo, n = segments(b, ends, length)
        if last is not None:
            own = owners(gram_hashes(b), length)[lo]
            ok = (own >= first) & (own < last)
            text, kh, lo, n = text[ok], kh[ok], lo[ok], n[ok]
        raw = memoryview(b.tobytes())
        digest = xxhash.xxh3_64_intdigest
        sh = np.fromiter((digest(raw[s:e]) for s, e in zip(lo.tolist(), (lo + n - 1 + length).tolist())), np.uint64, len(lo))
        out.append((kh, sh, docs[text], lo - ends[text] + base, n))
    kh, sh, doc, lo, n = (np.concatenate(c) for c in zip(*out))
    kh, sh, doc, lo, n = _ordered(kh, sh, doc, lo, n)
    copy = np.zeros(len(kh), bool)
    copy[1:] = (kh[1:] == kh[:-1]) & (sh[1:] == sh[:-1])
    d, s, e = merged_by(doc[copy], lo[copy], lo[copy] + n[copy] - 1 + length)
    keep = ~copy
    # copies travel with the rest and are dealt by their document
    return (np.concatenate((kh[keep].view(np.int64), d)), np.concatenate((sh[keep].view(np.int64), np.zeros(len(d), np.int64))), np.concatenate((doc[keep], d)),
            np.concatenate((lo[keep], s)), np.concatenate((n[keep], np.zeros(len(d), np.int64))), np.concatenate((lo[keep] + n[keep] - 1 + length, e)))


def merged_by(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals document by document."""
    if not len(doc):
        return doc, s, e
    order = np.lexsort((s, doc))
    doc, s, e = doc[order], s[order], e[order]
    each = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1])))
    shift = each * (int(e.max()) + 2)
    a, b = merged(s + shift, e + shift)
    at = np.searchsorted(s + shift, a)
    return doc[at], a - shift[at], b - shift[at]


_ANCHOR = "kh long, sh long, doc long, lo long, n long, e long"


def _named(arrays, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], [c.split()[0] for c in schema.split(", ")])


def anchors(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    def run(batches):
        for b in batches:
            ids = b.column("doc").to_numpy(zero_copy_only=False)
            for at, part in blocks(b):
                yield _named(_anchor_rows(ids[at:at + len(part)], part, length), _ANCHOR)

    return docs.select("doc", "text").mapInArrow(run, _ANCHOR)


_MET = "doc long, s long, e long, kh long, n long, hot boolean"


def _meet(t: pa.Table, length: int) -> pa.RecordBatch:
    """Intervals to remove (n = 0) and segments whose text is asked for (n windows from s on)."""
    kh, sh, doc, lo, n, e = (t.column(c).to_numpy() for c in ("kh", "sh", "doc", "lo", "n", "e"))
    direct = n == 0
    gone = [(doc[direct], lo[direct], e[direct])]
    seg = ~direct
    kh, sh, doc, lo, n, e = _ordered(kh[seg], sh[seg], doc[seg], lo[seg], n[seg], e[seg])
    gram = np.ones(len(kh), bool)
    gram[1:] = kh[1:] != kh[:-1]
    first = gram.copy()
    first[1:] |= sh[1:] != sh[:-1]
    gone.append((doc[~first], lo[~first], e[~first]))
    each = np.cumsum(gram) - 1
    kinds = np.bincount(each[first], minlength=int(gram.sum())) if len(kh) else np.zeros(0, np.int64)
    ask = first & (kinds[each] > 1) if len(kh) else first
    d, s, x = merged_by(*(np.concatenate(c) for c in zip(*gone)))
    return _named((np.concatenate((d, doc[ask])), np.concatenate((s, lo[ask])), np.concatenate((x, e[ask])), np.concatenate((np.zeros(len(d), np.int64), kh[ask])),
                   np.concatenate((np.zeros(len(d), np.int64), n[ask])), np.concatenate((np.zeros(len(d), bool), kinds[each[ask]] > HOT))), _MET)


def met(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    def run(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            yield _meet(pa.Table.from_batches(got), length)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "kh").mapInArrow(run, _MET)


class EnhancedSuffixArray:
    """Suffixes of several byte strings with at least ``least`` bytes before their string's end, sorted, with common prefixes of neighbours.

    ``place``: position of each suffix; ``lcp[i]``: common prefix of suffixes i - 1 and i, never beyond a string's end nor 217 bytes.
    """

    def __init__(self, strings: list[bytes], least: int):
        self.least = least
        lens = np.array([len(x) for x in strings], np.int64)
        stops = np.cumsum(lens + 1) - 1  # a sign below every byte ends each string
        self.starts = stops - lens
        n = int(stops[-1]) + 1
        self.text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        self.text[stops] = 0
        self.string = np.repeat(np.arange(len(strings)), lens + 1)
        room = stops[self.string] - np.arange(n)
        padded = np.concatenate((self.text, np.zeros(7, np.int64)))
        key = np.zeros(n, np.int64)
        for k in range(7):
            key = (key << 9) | padded[k:n + k]
        ranks = [np.unique(key, return_inverse=True)[1]]
        steps = [7]
        while steps[-1] < 112:
            r, h = ranks[-1], steps[-1]
            later = np.zeros(n, np.int64)
            later[:max(0, n - h)] = r[h:] + 1
            ranks.append(np.unique(r * (n + 2) + later, return_inverse=True)[1])
            steps.append(2 * h)
        r = ranks[-1]
        later = np.zeros(n, np.int64)
        later[:max(0, n - 112)] = r[112:] + 1
        full = np.flatnonzero(room >= least)
        order = np.lexsort((later[full], r[full]))
        self.place = full[order]
        a, b = self.place[:-1], self.place[1:]
        got = np.zeros(len(a), np.int64)
        for r, h in list(zip(ranks, steps))[::-1]:
            x, y = a + got, b + got
            ok = np.flatnonzero((x < n) & (y < n))
            got[ok[r[x[ok]] == r[y[ok]]]] += h
        live = np.ones(len(a), bool)
        for _ in range(6):
            x, y = a + got, b + got
            live &= (x < n) & (y < n)
            live[live] = self.text[x[live]] == self.text[y[live]]
            got[live] += 1
        self.lcp = np.zeros(len(self.place), np.int64)
        self.lcp[1:] = np.minimum(got, np.minimum(room[a], room[b]))

    def maximal_repeats(self) -> list[tuple[int, int, int]]:
        """(length, first, last + 1) in suffix order of every repeat of ``least`` bytes or more that can't be extended.

        A stack scan of the common prefixes gives the intervals of the tree; one is kept if its occurrences differ in the byte on
        their left, or one of them stands at its string's start.
        """
        place, lcp = self.place, self.lcp
        at_start = place == self.starts[self.string[place]]
        left = np.where(at_start, -1, self.text[np.maximum(place - 1, 0)])
        differs = np.zeros(len(place) + 1, np.int64)
        differs[2:] = np.cumsum(left[1:] != left[:-1])
        opens = np.concatenate(([0], np.cumsum(at_start)))
        out: list[tuple[int, int, int]] = []
        deep = np.flatnonzero(lcp >= self.least)
        if not len(deep):
            return out
        cut = np.flatnonzero(np.diff(deep) > 1)
        for i, j in zip(np.concatenate(([0], cut + 1)).tolist(), np.concatenate((cut, [len(deep) - 1])).tolist()):
            lo, hi = int(deep[i]) - 1, int(deep[j])
            stack: list[tuple[int, int]] = []  # (common prefix, first suffix)
            for k in range(lo + 1, hi + 2):
                value = int(lcp[k]) if k <= hi else 0
                begin = k - 1
                while stack and stack[-1][0] > value:
                    size, begin = stack.pop()
                    if differs[k] - differs[begin + 1] or opens[k] - opens[begin]:
                        out.append((size, begin, k))
                if value and (not stack or stack[-1][0] < value):
                    stack.append((value, begin))
        return out


def removed_by_suffixes(strings: list[bytes], doc: np.ndarray, start: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of all occurrences but the first of every maximal repeat of strings cut from documents at ``start``."""
    out = []
    x = EnhancedSuffixArray(strings, length)
    where = x.string[x.place]
    d, p = doc[where], start[where] + x.place - x.starts[where]
    turn = np.empty(len(d), np.int64)
    turn[np.lexsort((p, d))] = np.arange(len(d))  # place of each occurrence in corpus order
    for size, i, j in x.maximal_repeats():
        k = np.arange(i, j)
        at = turn[i:j]
        # the same place of a document may lie in two strings; it is one occurrence
        first = int(k[at.argmin()])
        k = k[(d[i:j] != d[first]) | (p[i:j] != p[first])]
        out.append((d[k], p[k], p[k] + size))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z
    return merged_by(*(np.concatenate(c) for c in zip(*out)))


def packed(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, z): texts compressed for the shuffle."""

    def run(batches):
        c = zstandard.ZstdCompressor(level=1)
        for b in batches:
            z = [c.compress(t.as_py().encode("utf-8", "surrogatepass")) if t.is_valid else None for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("doc_id"), pa.array(z, pa.binary())], ["doc", "doc_id", "z"])

    return docs.select("doc", "doc_id", "text").mapInArrow(run, "doc long, doc_id long, z binary")


_CUT = "bucket long, doc long, s long, e long, piece binary"


def _cut_batch(b: pa.RecordBatch, length: int):
    d = zstandard.ZstdDecompressor()
    rows: list[tuple] = []
    windows: list[tuple] = []
    for doc, z, ask in zip(b.column("doc").to_pylist(), b.column("z"), b.column("ask")):
        text = d.decompress(z.as_py()) if z.is_valid else b""
        for a in ask.as_py():
            s, n = a["s"], a["n"]
            if a["hot"]:
                windows += [(xxhash.xxh3_64_intdigest(text[k:k + length]) - 2**63, doc, k, text[k:k + length]) for k in range(s, s + n)]
            else:
                rows.append((a["kh"], doc, s, s + n - 1 + length, text[s:s + n - 1 + length]))
    if windows:  # of equal windows in the batch the first goes on, the others are settled here
        windows.sort()
        gone = []
        for k, (h, doc, s, w) in enumerate(windows):
            if k and h == windows[k - 1][0] and w == windows[k - 1][3]:
                gone.append((doc, s))
            else:
                rows.append((h, doc, s, s + length, w))
        if gone:
            doc, s = (np.array(c, np.int64) for c in zip(*gone))
            rows += [(x, x, y, e, None) for x, y, e in zip(*(c.tolist() for c in merged_by(doc, s, s + length)))]
    c = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4], pa.binary())], [f.split()[0] for f in _CUT.split(", ")])


def cut(asked: DataFrame, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The asked segments' texts, dealt by gram; those of hot grams as single windows dealt by their own hash. No piece: an interval to remove."""
    per_doc = asked.groupBy("doc").agg(F.collect_list(F.struct("s", "n", "kh", "hot")).alias("ask"))
    rows = packed(docs).join(per_doc, "doc").select("doc", "z", "ask")
    return rows.mapInArrow(lambda batches: (_cut_batch(b, length) for b in batches), _CUT)


_GONE = "doc long, s long, e long"


def compared(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, s, e) to remove: suffix arrays over the pieces of each partition, of ``SUFFIX_BYTES`` and the rest of a bucket at most."""

    def run(batches):
        bucket, doc, start, text, size = None, [], [], [], 0
        for b in batches:
            direct = pa.compute.is_null(b.column("piece"))
            if pa.compute.any(direct).as_py():
                gone = b.filter(direct)
                yield pa.RecordBatch.from_arrays([gone.column(c) for c in ("doc", "s", "e")], ["doc", "s", "e"])
                b = b.filter(pa.compute.invert(direct))
            for k, d, s, p in zip(*(b.column(c).to_pylist() for c in ("bucket", "doc", "s", "piece"))):
                if k != bucket and size >= SUFFIX_BYTES:
                    yield _named(removed_by_suffixes(text, np.array(doc), np.array(start), length), _GONE)
                    doc, start, text, size = [], [], [], 0
                bucket = k
                doc.append(d)
                start.append(s)
                text.append(p)
                size += len(p)
        if text:
            yield _named(removed_by_suffixes(text, np.array(doc), np.array(start), length), _GONE)

    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _GONE)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans removed (start, end), kept text as bytes is left to ``digest``; one row per row of ``docs``."""
    spark = docs.sparkSession
    keyed = identified(texts(docs))
    found = shared_path(spark, "repeats")
    met(anchors(keyed, length), length).write.parquet(found)
    rows = spark.read.schema(_MET).parquet(found)
    more = compared(cut(rows.filter("n > 0"), keyed, length), length)
    spans = rows.filter("n = 0").select("doc", "s", "e").unionByName(more).groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return packed(keyed).join(spans, "doc", "left").select("doc_id", "z", "spans")


def digest(found: DataFrame) -> DataFrame:
    """The checked columns: n_bytes, n_removed, n_spans, kept_sha256; and the removed spans."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches):
        d = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for z, spans in zip(b.column("z"), b.column("spans")):
                text = d.decompress(z.as_py()) if z.is_valid else b""
                got = spans.values.flatten() if spans.is_valid else None
                s, e = merged(*(a.to_numpy() for a in got)) if got else (np.zeros(0, np.int64),) * 2
                h, at = hashlib.sha256(), 0
                for x, y in zip(s.tolist(), e.tolist()):
                    h.update(text[at:x])
                    at = y
                h.update(text[at:])
                out.append((len(text), int((e - s).sum()), len(s), h.hexdigest()))
            c = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.string())], [f.split()[0] for f in schema.split(", ")])

    return found.mapInArrow(run, schema)
