"""Language-model scoring with a probabilistic suffix tree over words.

The symbols are the training words, one end token per text, and one class for all unknown words, whose mass is shared evenly by as many words as are estimated never to
have occurred. Contexts are the last 0 to ``ORDER`` words. A sequence
belongs to the tree if the training texts hold it ``support`` times, however many texts there are, so the tree grows with the corpus. A context is retained
if its next-symbol distribution diverges from that of the next shorter retained context; its listed symbols are the sequences of the tree that it begins.
Listed and unlisted symbols are smoothed towards the shorter context; the empty context gives each word its count less an absolute discount, and the unknown
class what the discounts add up to. A text begins after one end token.

The tree is tables in the shared folder, a row per sequence, keyed by a 64-bit hash of the hashes of the sequence without its last and without its first
word. Sequences are counted level by level: one is a candidate only if both these parts are in the tree, which a bitmap of fixed size tells; it lets through
some that are not and loses none. The log of a word's probability is that of its own count plus one value for each sequence of the tree that ends at it, and
one for each that ends before it, so a text's score is a sum of values of the sequences in it. Those with at least a ``p_min`` share of all training tokens are
broadcast with their values, as are others of a high count, at most ``top`` of them, and words of a high count, at most ``head`` of them, with theirs; the
rest is looked up where the tables' parts lie: lookups go there packed, a block of texts with a million at a time, and the answers come back packed by block. A document
is known there by its block, the task and number of it, and its place in it, so ``docs`` must come in an order that a retried task repeats, as from a scan.

A null text is the empty text: one end token. Without training texts every text has probability 1 of unknown words. Repeated rows are scored each. Very
long texts are scored whole.
"""

from __future__ import annotations

import math
import pickle
from array import array
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import blocks, broadcast, drop_folder, texts
from gossamer.session import shared_path

ORDER = 3
P_MIN = 1e-4
SUPPORT = 8
STRENGTH = 10.0
DIVERGENCE = 20.0
HEAD = 1 << 16
TOP = 1 << 19
FLUSH = 250_000  # distinct words a task holds before it hands its counts on
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UNIT = 2.0**30  # values of sequences are whole numbers of 1 / UNIT
BITS = 27  # the bitmap of known sequences has 2**BITS bits


def word_counts(docs: DataFrame) -> DataFrame:
    """(token, n): every word of the lower-cased texts, and the empty token once per text as its end."""

    def run(batches):
        held: Counter = Counter()

        def flush():
            got = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["token", "n"])
            held.clear()
            return got

        for b in batches:
            for t in b.column("text"):
                held.update(t.as_py().encode("utf-8", "surrogatepass").lower().split() if t.is_valid else ())
                held[b""] += 1
                if len(held) > FLUSH:
                    yield flush()
        yield flush()

    return texts(docs).select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _least(counts: DataFrame, most: int, floor: float) -> float:
    """2**(b / 8), b the least for which at most ``most`` rows have that ``n``, or ``floor`` if it is lower."""
    sizes = {r["b"]: r["k"] for r in counts.groupBy(F.floor(8 * F.log2("n")).alias("b")).agg(F.count(F.lit(1)).alias("k")).collect()}
    b, held = max(sizes, default=0) + 1, 0
    while b > 0 and held + sizes.get(b - 1, 0) <= most:
        b -= 1
        held += sizes.get(b, 0)
    return min(2.0 ** (b / 8), floor)


def _head(counts: DataFrame, most: int, floor: float) -> tuple[dict, float]:
    """The words with at least 2**(b / 8) occurrences, b the least for which they are at most ``most``, and those with ``floor``; and the lower of these counts."""
    least = _least(counts, most, floor)
    return {bytes(r["token"]): r["n"] for r in counts.filter(F.col("n") >= least).collect()}, least


class WordTree:
    """The tree in memory, for few texts: frequent word sequences, level by level, and the retained ones among them as contexts. The tests hold the tables against it.

    ``codes[d]``: sorted codes of the frequent sequences of d words; a sequence's number is its place plus one, 0 stands for none. A code is the number of the sequence
    without its last word, times ``m``, plus the last word's number.
    """

    def __init__(self, words: dict[bytes, int]):
        self.number = {w: k + 1 for k, w in enumerate(sorted(words))}
        self.m = len(self.number) + 1
        self.count = {1: np.array([0] + [words[w] for w in sorted(words)], float)}
        self.codes: dict[int, np.ndarray] = {}
        self.seen: dict[int, np.ndarray] = {}  # how often each sequence stands before a token
        self.end = self.number.get(b"", 0)

    def numbers(self, texts_: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Words of several texts as numbers, each text led by ORDER ends and closed by one; and which are tokens."""
        get = self.number.get
        lens = np.array([len(w) + ORDER + 1 for w in texts_])
        ids = np.full(int(lens.sum()), self.end, np.int64)
        token = np.ones(len(ids), bool)
        starts = np.cumsum(lens) - lens
        token[(starts[:, None] + np.arange(ORDER)).ravel()] = False
        word = token.copy()
        word[starts + lens - 1] = False
        ids[word] = np.fromiter((get(w, 0) for t in texts_ for w in t), np.int64, int(word.sum()))
        return ids, token

    def sequences(self, ids: np.ndarray, upto: int) -> dict[int, np.ndarray]:
        """{d: number of the frequent sequence of d words that ends at each place}."""
        g = {1: ids}
        for d in range(2, upto + 1):
            g[d] = self._find(d, self.candidates(g, d))
        return g

    def candidates(self, g: dict[int, np.ndarray], d: int) -> np.ndarray:
        """Code of the d words that end at each place, -1 if one end is not frequent."""
        out = np.full(len(g[1]), -1, np.int64)
        ok = (g[d - 1][:-1] > 0) & (g[d - 1][1:] > 0)
        out[1:][ok] = g[d - 1][:-1][ok] * self.m + g[1][1:][ok]
        return out

    def _find(self, d: int, code: np.ndarray) -> np.ndarray:
        out = np.zeros(len(code), np.int64)
        known = self.codes[d]
        if len(known):
            at = np.flatnonzero(code >= 0)
            k = np.minimum(np.searchsorted(known, code[at]), len(known) - 1)
            hit = known[k] == code[at]
            out[at[hit]] = k[hit] + 1
        return out

    def add_level(self, d: int, codes: np.ndarray, counts: np.ndarray, seen: np.ndarray) -> None:
        order = np.argsort(codes)
        self.codes[d] = codes[order]
        self.count[d] = np.concatenate(([0.0], counts[order]))
        self.seen[d - 1] = seen

    def finish(self, root: np.ndarray) -> None:
        """``root``: probability of each frequent word in the empty context. Sets log probabilities of listed symbols and factors of unlisted ones."""
        top = max(self.codes, default=1)
        self.retained = {d: np.zeros(len(self.count[d]), bool) for d in range(1, top)}
        self.listed = {1: root}  # listed[d + 1][g]: probability of the last word of g after the d words before it
        self.factor = {}
        for d in range(1, top):
            codes, n = self.codes[d + 1], self.count[d + 1][1:]
            ctx, word = codes // self.m, codes % self.m
            short = np.array([self._prob(d, int(c), int(w)) for c, w in zip(ctx, word)])
            size = len(self.count[d])
            n_ctx = np.maximum(self.seen[d], np.bincount(ctx, n, size))
            own = n / (n_ctx[ctx] + STRENGTH) + STRENGTH / (n_ctx[ctx] + STRENGTH) * short
            rest = np.maximum(n_ctx - np.bincount(ctx, n, size), 0) / (n_ctx + STRENGTH)
            free = np.maximum(1 - np.bincount(ctx, short, size), 1e-9)
            factor = rest / free + STRENGTH / (n_ctx + STRENGTH)
            # evidence in nats that the context changes what comes next
            gain = n_ctx * (np.bincount(ctx, own * np.log(own / short), size) + factor * free * np.log(factor))
            self.retained[d] = (gain >= DIVERGENCE) & (n_ctx > 0)
            self.listed[d + 1], self.factor[d] = np.concatenate(([0.0], own)), factor
        self.top = top

    def _shorter(self, d: int, g: int) -> int:
        """Number of the last d - 1 words of sequence ``g`` of d words."""
        code = int(self.codes[d][g - 1])
        before, word = code // self.m, code % self.m
        if d == 2:
            return word
        return int(self._find(d - 1, np.array([self._shorter(d - 1, before) * self.m + word]))[0])

    def _prob(self, d: int, ctx: int, word: int) -> float:
        """Probability of ``word`` after the longest retained ending of the d-word sequence ``ctx`` that is shorter than it."""
        scale = 1.0
        while d > 1:
            ctx, d = self._shorter(d, ctx), d - 1
            if ctx and self.retained[d][ctx]:
                g = int(self._find(d + 1, np.array([ctx * self.m + word]))[0])
                if g:
                    return scale * self.listed[d + 1][g]
                scale *= self.factor[d][ctx]
        return scale * self.listed[1][word]

    def score(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(natural log known from the contexts, whether the word's own probability is still to be added) at each place."""
        g = self.sequences(ids, self.top)
        log = np.zeros(len(ids))
        open_ = np.ones(len(ids), bool)
        for d in range(self.top - 1, 0, -1):
            before = np.concatenate(([0], g[d][:-1]))
            here = open_ & self.retained[d][before]
            known = here & (g[d + 1] > 0)
            log[known] += np.log(self.listed[d + 1][g[d + 1][known]])
            open_ &= ~known
            left = here & ~known
            log[left] += np.log(self.factor[d][before[left]])
        return log, open_


def _mix(pre: np.ndarray, suf: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of two longs."""
    rot = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    p1, p2, p3, p4, p5 = (np.uint64(k) for k in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = np.full(len(pre), 42, np.uint64)
    for x in (pre, suf):
        h = rot((h + p5 + np.uint64(8)) ^ (rot(x * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h ^= h >> np.uint64(32)
    return h


class _Words(dict):
    """Numbers of the common words. Another word gets the next free one each time it is met, until ``fresh`` lets go of those: most are not met again soon."""

    def __init__(self, common: list[bytes]):
        super().__init__(zip(common, range(len(common))))
        self.common = len(common)
        self.h = array("Q", [xxhash.xxh64_intdigest(w, 42) for w in common])

    def __missing__(self, word: bytes) -> int:
        self.h.append(xxhash.xxh64_intdigest(word, 42))
        return len(self.h) - 1

    def fresh(self) -> None:
        del self.h[self.common:]


def _hashed(texts_: list[list[bytes]], words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and numbers of the words of several texts, each text between two ends; and which are tokens, all but the first of each."""
    words.fresh()
    lens = np.array([len(w) + 2 for w in texts_])
    number = np.full(int(lens.sum()), words[b""], np.int64)
    token = np.ones(len(number), bool)
    starts = np.cumsum(lens) - lens
    token[starts] = False
    word = token.copy()
    word[starts + lens - 1] = False
    number[word] = np.fromiter(map(words.__getitem__, chain.from_iterable(texts_)), np.int64, int(word.sum()))
    return np.array(words.h, np.uint64)[number], number, token


def _squeezed(x: np.ndarray) -> bytes:
    """Whole numbers for a shuffle: equal bytes of all of them side by side, so that those of small numbers vanish."""
    x = np.ascontiguousarray(x)
    return pa.compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes(), codec="zstd", asbytes=True) + len(x).to_bytes(4, "little") if len(x) else b""


def _loosed(b: bytes, kind) -> np.ndarray:
    if not b:
        return np.zeros(0, kind)
    n, wide = int.from_bytes(b[-4:], "little"), np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(b[:-4], n * wide, codec="zstd", asbytes=True), np.uint8).reshape(wide, n).T.copy().view(kind).ravel()


def _steps(x: np.ndarray) -> bytes:
    """Rising numbers by their differences."""
    return _squeezed(np.diff(x, prepend=x.dtype.type(0)))


def _unsteps(b: bytes, kind) -> np.ndarray:
    return np.cumsum(_loosed(b, kind), dtype=kind)


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (bits[(h >> np.uint64(6)) & np.uint64(len(bits) - 1)] >> (h & np.uint64(63))) & np.uint64(1) > 0


def _sequences(h: np.ndarray, token: np.ndarray, bits: np.ndarray, upto: int):
    """For d from 2 to ``upto``: places where d words end whose first and last d - 1 are in the bitmap, and the hashes of these two."""
    ok = _has(bits, h)
    inside = token[1:]
    for d in range(2, upto + 1):
        at = np.flatnonzero(ok[:-1] & ok[1:] & inside) + 1
        pre, suf = h[at - 1], h[at]
        yield d, at, pre, suf
        h, ok, inside = np.zeros(len(h), np.uint64), np.zeros(len(h), bool), True
        h[at] = _mix(pre, suf)
        ok[at] = _has(bits, h[at])


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bitmap of the longs of ``h``, gathered as words of 64 bits: at most 2**(BITS - 6) rows."""
    h = F.col("h")
    at = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit((1 << (BITS - 6)) - 1))
    got = hashes.groupBy(at.alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("word")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[got.column("at").to_numpy()] = got.column("word").to_numpy().view(np.uint64)
    return out


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The frame written to the shared folder and read back, and where. Spark drops the write's shuffle files at its end: the folder is all that is read later."""
    spark = df.sparkSession
    folder, kept = shared_path(spark, name), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(folder), folder


_PACKED = "part int, code binary, times binary, pre binary, suf binary, n binary"
_FOUND = "pre long, suf long, n long, h long"


def _united(pre: np.ndarray, suf: np.ndarray, n: np.ndarray):
    """(code, pre, suf, n) of the distinct pairs in order of their code, counts added up."""
    code = _mix(pre, suf)
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(code)), bool), code[1:] != code[:-1])))
    return code[first], pre[order[first]], suf[order[first]], np.add.reduceat(n[order], first) if len(first) else n


def _cuts(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, ends): places by part, otherwise as they stand, and where each part begins in that order."""
    order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1, dtype=part.dtype))


def _count(train: DataFrame, bits: np.ndarray, common: list[bytes], d: int, support: int) -> tuple[DataFrame, str]:
    """(pre, suf, n, h): the sequences of d words that occur ``support`` times.

    A task unites some million occurrences at a time and hands them on packed, one row per part, so the shuffle moves few rows. A sequence of common words only
    travels as their numbers in one code, codes by their differences; any other as its two hashes. A part is united by numpy; parts follow
    spark.sql.shuffle.partitions, and codes are spread evenly.
    """
    spark = train.sparkSession
    shared = broadcast(spark, (bits, common))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = min(16, 64 // d)
    coded = min(len(common), 1 << width)
    head = broadcast(spark, np.array([xxhash.xxh64_intdigest(w, 42) for w in common[:coded]], np.uint64))

    def run(batches):
        known, common_ = pickle.loads(shared.value)
        words = _Words(common_)
        held, size = [], 0

        def flush():
            code, pre, suf = (np.concatenate(x) for x in zip(*held))
            code.sort()
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(code)), bool), code[1:] != code[:-1])))
            code, times = code[first], np.diff(np.append(first, len(code)))
            by, ends = _cuts(_part(code * np.uint64(0x9E3779B97F4A7C15), parts), parts)
            code, times = code[by], times[by].astype(np.uint32)
            other, pre, suf, n = _united(pre, suf, np.ones(len(pre), np.int64))
            by = np.lexsort((pre, _part(other, parts)))  # equal first parts side by side: the shuffle compresses them
            ends_ = np.searchsorted(_part(other, parts), np.arange(parts + 1, dtype=np.uint64))
            pre, suf, n = pre[by], suf[by], n[by].astype(np.uint32)
            full = np.flatnonzero(np.diff(ends) + np.diff(ends_))
            a, b = [slice(ends[k], ends[k + 1]) for k in full], [slice(ends_[k], ends_[k + 1]) for k in full]
            cells = [_steps(code[k]) for k in a], [_squeezed(times[k]) for k in a], [pre[k].tobytes() for k in b], [suf[k].tobytes() for k in b], [_squeezed(n[k]) for k in b]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(x, pa.binary()) for x in cells)], [f.split()[0] for f in _PACKED.split(", ")])

        for b in batches:
            for _, part in blocks(b):
                h, number, token = _hashed([t.lower().split() for t in part], words)
                *_, (_, at, pre, suf) = _sequences(h, token, known, d)
                code, short = np.zeros(len(at), np.uint64), np.ones(len(at), bool)
                for k in range(d):
                    own = number[at - k]
                    short &= own < coded
                    code |= own.astype(np.uint64) << np.uint64(width * k)
                held.append((code[short], pre[~short], suf[~short]))
                size += len(at)
                if size > 1_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def unite(batches):
        codes, pairs = [], []
        for b in batches:
            for code, times, pre, suf, n in zip(*(b.column(c).to_pylist() for c in ("code", "times", "pre", "suf", "n"))):
                codes.append((_unsteps(code, np.uint64), _loosed(times, np.uint32)))
                pairs.append((np.frombuffer(pre, np.uint64), np.frombuffer(suf, np.uint64), _loosed(n, np.uint32)))
        if not codes:
            return
        names = [f.split()[0] for f in _FOUND.split(", ")]
        out = lambda pre, suf, n, h: pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (pre, suf, n, h)], names)
        code, times = (np.concatenate(x) for x in zip(*codes))
        if len(code):
            by = np.argsort(code)
            code = code[by]
            first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            n = np.add.reduceat(times[by].astype(np.int64), first)
            often = n >= support
            code, n = code[first[often]], n[often]
            h = pickle.loads(head.value)
            run_ = [h[(code >> np.uint64(width * k)) & np.uint64((1 << width) - 1)] for k in range(d - 1, -1, -1)]
            while len(run_) > 2:
                run_ = [_mix(x, y) for x, y in zip(run_, run_[1:])]
            yield out(*run_, n, _mix(*run_))
        pre, suf, n = (np.concatenate(x) for x in zip(*pairs))
        code, pre, suf, n = _united(pre, suf, n.astype(np.int64))
        often = n >= support
        yield out(pre[often], suf[often], n[often], code[often])

    packed = texts(train).select("text").mapInArrow(run, _PACKED)
    return _stored(packed.repartition(parts, "part").mapInArrow(unite, _FOUND), "sequences")


def _values(train: DataFrame, words: DataFrame, common: list[bytes], order: int, support: int) -> tuple[DataFrame, np.ndarray]:
    """(h, n, x): what each occurrence of a sequence adds to the natural log of a text's probability beyond the words' own, in whole units, so that sums do not depend on
    their order; and the bitmap of the tree.

    ``words`` has h, n and p, a word's probability in the empty context, of the words of the tree.
    """
    n, n_ctx, own, short = (F.col(c) for c in ("n", "n_ctx", "own", "short"))
    level, parts, used = words, [], []
    spark, bits = train.sparkSession, _bitmap(words)
    for d in range(2, order + 2):
        found, at_found = _count(train, bits, common, d, support)
        # a sequence is followed by a token unless it ends a text, and then it begins none: its count is how often it stands before one
        both = found.join(level.select(F.col("h").alias("pre"), F.col("n").alias("n_ctx")), "pre").join(level.select(F.col("h").alias("suf"), F.col("p").alias("short")), "suf")
        both, at_both = _stored(both.select("h", "pre", "n", "n_ctx", "short", ((n + STRENGTH * short) / (n_ctx + STRENGTH)).alias("own")), "states")
        sums = both.groupBy("pre").agg(F.max("n_ctx").alias("n_ctx"), F.sum("n").alias("n"), F.sum("short").alias("short"), F.sum(own * F.log(own / short)).alias("gain"))
        free = F.greatest(1 - short, F.lit(1e-9))
        sums = sums.withColumn("free", free).withColumn("factor", F.greatest(n_ctx - n, F.lit(0)) / (n_ctx + STRENGTH) / free + STRENGTH / (n_ctx + STRENGTH))
        # evidence in nats that the context changes what comes next
        kept, at_kept = _stored(sums.filter(n_ctx * (F.col("gain") + F.col("factor") * F.col("free") * F.log("factor")) >= DIVERGENCE).select("pre", "n_ctx", F.log("factor").alias("lost")), "contexts")
        lost = F.col("lost")
        level = both.join(kept.select("pre", "lost"), "pre", "left").select("h", "n", F.when(lost.isNull(), short).otherwise(own).alias("p"), F.when(lost.isNull(), 0.0).otherwise(F.log(own / short) - lost).alias("x"))
        level, at_level = _stored(level, "level")
        parts += [level.select("h", "n", "x"), kept.select(F.col("pre").alias("h"), F.col("n_ctx").alias("n"), lost.alias("x"))]
        if d <= order:
            bits |= _bitmap(found)
        for folder in (at_found, at_both):
            drop_folder(spark, folder)
        used += [at_kept, at_level]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    values, _ = _stored(every.filter("x != 0").groupBy("h").agg(F.max("n").alias("n"), F.round(F.sum("x") * UNIT).cast("long").alias("x")), "values")
    for folder in used:
        drop_folder(spark, folder)
    return values, bits


def _discount(counts: DataFrame) -> tuple[float, float]:
    """Absolute discount, and an estimate of how many words there are that never occurred: both from the numbers of words that occur once and twice."""
    got = counts.agg(F.count(F.when(F.col("n") == 1, 1)).alias("once"), F.count(F.when(F.col("n") == 2, 1)).alias("twice")).first()
    once, twice = got["once"], got["twice"]
    unseen = once * once / (2 * twice) if twice else once * (once - 1) / 2
    return min(max(once / (once + 2 * twice), 0.05), 0.9) if once + twice else 0.05, max(unseen, 1.0)


_LOOKED = "part int, kind int, block long, a binary, b binary, c binary"
_SUMS = "block long, kind int, a binary, b binary, c binary"
_SCORED = "doc_id long, n_tokens long, n_known long, logs double, score double"
_DOC = np.dtype([("id", "i8"), ("named", "?"), ("n_tokens", "i8"), ("known", "i8"), ("logs", "f8"), ("score", "f8")])
WORDS, VALUES, DOCS, OF_WORDS, OF_VALUES = range(5)  # tables come before the lookups in them, documents before what is said of them


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of the hashes' range that each lies in."""
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _packed(parts: list[int], kind: int, block: int, *cells: list[bytes]) -> pa.RecordBatch:
    n = len(parts)
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([block] * n, pa.int64()), *(pa.array(x, pa.binary()) for x in cells)], [f.split()[0] for f in _LOOKED.split(", ")])


def _tails(table: DataFrame, kind: int, parts: int) -> DataFrame:
    """The table (h, x) as one row per task, some million rows of it, and part of the hashes' range."""

    def run(batches):
        held, size = [], 0

        def flush():
            h, x = (np.concatenate(c) for c in zip(*held))
            by = np.argsort(h)
            h, x = h[by], x[by]
            ends = np.searchsorted(_part(h, parts), np.arange(parts + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(ends))
            cut = lambda v, put: [put(v[ends[k]:ends[k + 1]]) for k in full]
            return _packed(full, kind, 0, cut(h, _steps), cut(x, _squeezed), [b""] * len(full))

        for b in batches:
            if b.num_rows:
                held.append((b.column("h").to_numpy().view(np.uint64), b.column("x").to_numpy()))
                size += b.num_rows
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return table.select("h", "x").mapInArrow(run, _LOOKED)


def _rows(b: pa.RecordBatch, names: str):
    for i in range(b.num_rows):
        yield tuple(b.column(f.split()[0])[i].as_py() for f in names.split(", "))


def _said(block: int, kind: int, *cells: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([kind], pa.int32()), *(pa.array([x], pa.binary()) for x in cells)], [f.split()[0] for f in _SUMS.split(", ")])


def _settled(batches):
    """What one part's tables say to each block's lookups, a row per block and kind: documents' places in the block, how many answers each has, and the answers: counts of
    words, or one sum of values per document."""
    now, tables, sorted_ = None, {}, {}
    for batch in batches:
        for part, kind, block, a, b, c in _rows(batch, _LOOKED):
            if part != now:
                now, tables, sorted_ = part, {}, {}
            if kind in (WORDS, VALUES):
                tables.setdefault(kind, []).append((_unsteps(a, np.uint64), _loosed(b, np.int64)))
                continue
            if kind == DOCS:
                yield _said(block, kind, a, b, c)
                continue
            of = WORDS if kind == OF_WORDS else VALUES
            if of not in sorted_:
                h, x = (np.concatenate(v) for v in zip(*tables.pop(of))) if of in tables else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                by = np.argsort(h)
                sorted_[of] = h[by], x[by]
            h, x = sorted_[of]
            if not len(h):
                continue
            seq, doc, n = _loosed(a, np.uint64), _unsteps(b, np.uint32), _loosed(c, np.uint32)
            k = np.minimum(np.searchsorted(h, seq), len(h) - 1)
            hit = h[k] == seq
            at, said = np.repeat(np.arange(len(doc)), n)[hit], x[k[hit]]
            n = np.bincount(at, minlength=len(doc))
            some = n > 0
            if not len(said):
                continue
            if of == VALUES:
                said = np.add.reduceat(said, np.flatnonzero(np.diff(at, prepend=-1)))
            else:
                said = said.astype(np.uint64)
            yield _said(block, kind, _steps(doc[some]), _squeezed(n[some].astype(np.uint32)) if of == WORDS else b"", _squeezed(said))


def score(docs: DataFrame, train: DataFrame, head: int = HEAD, p_min: float = P_MIN, order: int = ORDER, support: int = SUPPORT, top: int = TOP) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``, learning from ``train``."""
    spark = docs.sparkSession
    counts, _ = _stored(word_counts(train), "words")
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, v = size["n"], size["v"]
    off, unseen = _discount(counts)
    floor = max(2.0, p_min * total)
    common, least = _head(counts, head, floor)
    ranked = sorted(common, key=lambda w: (-common[w], w))
    first = counts.filter(F.col("n") >= support).select(F.xxhash64("token").alias("h"), "n", ((F.col("n") - off) / max(total, 1)).alias("p"))
    values, bits = _values(train, first, ranked, order, support)
    top_least = _least(values, top, floor)
    got = values.filter(F.col("n") >= top_least).toArrow()
    top_h, top_x = got.column("h").to_numpy().view(np.uint64), got.column("x").to_numpy()
    by = np.argsort(top_h)
    top_h, top_x = top_h[by], top_x[by]
    # per common word: log10 of count + 1, and log10 of its probability in the empty context
    head_n = np.array([common[w] for w in ranked], float)
    # a second bit of each, from other bits of its hash: few are looked up that are not there
    valued_bits = _bitmap(values) | _bitmap(values.select(F.shiftrightunsigned("h", BITS).alias("h")))
    shared = broadcast(spark, (bits, valued_bits, top_h, top_x, ranked, np.log10(head_n + 1), np.log10((head_n - off) / max(total, 1))))
    unknown = math.log10(off * v / total / unseen) if total else 0.0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_log10 = UNIT * math.log(10)

    def run(batches):
        known_, valued, top_h, top_x, common_, head_base, head_log = pickle.loads(shared.value)
        words = _Words(common_)
        held, found, size, n_held, block = [], {OF_WORDS: [], OF_VALUES: []}, 0, 0, TaskContext.get().partitionId() << 32

        def at_home(table, h):
            """Place of each hash in a sorted table, and which are there."""
            k = np.minimum(np.searchsorted(table, h), max(len(table) - 1, 0))
            return k, table[k] == h if len(table) else np.zeros(len(h), bool)

        def flush():
            yield _packed([block % parts], DOCS, block, [np.concatenate(held).tobytes()], [b""], [b""])
            for kind, pairs in found.items():
                at, h = (np.concatenate(x) for x in zip(*pairs))
                # by part, then by document: a document's lookups follow each other, so their number is all that is said of them
                slot = _part(h, parts).astype(np.int64) * n_held + at
                by = np.argsort(slot, kind="stable")
                h, slot = h[by], slot[by]
                starts = np.flatnonzero(np.diff(slot, prepend=-1))
                n, part_, doc_ = np.diff(np.append(starts, len(slot))).astype(np.uint32), slot[starts] // n_held, (slot[starts] % n_held).astype(np.uint32)
                ends = np.searchsorted(part_, np.arange(parts + 1))
                full, bounds = np.flatnonzero(np.diff(ends)), np.append(starts, len(slot))
                own = [slice(ends[k], ends[k + 1]) for k in full]
                yield _packed(full, kind, block, [_squeezed(h[bounds[k.start]:bounds[k.stop]]) for k in own], [_steps(doc_[k]) for k in own], [_squeezed(n[k]) for k in own])

        for b in batches:
            ids = b.column("doc_id")
            for first, part in blocks(b):
                n = len(part)
                own_ids = ids.slice(first, n)
                d = np.zeros(n, _DOC)
                d["named"] = own_ids.is_valid().to_numpy(False)
                d["id"] = own_ids.fill_null(0).to_numpy()
                split = [t.lower().split() for t in part]
                h, number, token = _hashed(split, words)
                text = np.repeat(np.arange(n), [len(w) + 2 for w in split])
                del split
                places = np.flatnonzero(token)
                own, doc, k = h[places], text[places], number[places]
                common_ = k < words.common
                add = lambda at, x: np.bincount(at, x, n) if len(at) else np.zeros(n)
                d["n_tokens"], d["known"] = np.bincount(doc, minlength=n), add(doc[common_], None)
                d["logs"] = add(doc[common_], head_base[k[common_]])
                # words outside the head count as unknown here; the table gives the difference for those that are not
                score_ = add(doc[common_], head_log[k[common_]]) + (d["n_tokens"] - d["known"]) * unknown
                found[OF_WORDS].append((doc[~common_] + n_held, own[~common_]))
                size += len(found[OF_WORDS][-1][0])
                for at, seq in [(places, own), *((at, _mix(pre, suf)) for _, at, pre, suf in _sequences(h, token, known_, order + 1))]:
                    hit = np.flatnonzero(_has(valued, seq))
                    hit = hit[_has(valued, seq[hit] >> np.uint64(BITS))]
                    at, seq = text[at[hit]], seq[hit]
                    j, there = at_home(top_h, seq)
                    score_ += add(at[there], top_x[j[there]]) / per_log10
                    found[OF_VALUES].append((at[~there] + n_held, seq[~there]))
                    size += len(found[OF_VALUES][-1][0])
                d["score"] = score_
                held.append(d)
                n_held += n
                if size > 1_000_000 or n_held > 100_000:
                    yield from flush()
                    held, found, size, n_held, block = [], {OF_WORDS: [], OF_VALUES: []}, 0, 0, block + 1
        if held:
            yield from flush()

    def summed(batches):
        """Documents of each block with what was said of them added."""
        now, d, score_ = None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array(d["id"], mask=~d["named"]), *(pa.array(x) for x in (d["n_tokens"], d["known"], d["logs"], d["score"] + score_ / per_log10))], [f.split()[0] for f in _SCORED.split(", ")])

        for batch in batches:
            for block, kind, a, b, c in _rows(batch, _SUMS):
                if kind == DOCS:
                    if d is not None:
                        yield done()
                    now, d = block, np.frombuffer(a, _DOC).copy()
                    score_ = np.zeros(len(d), np.int64)
                    continue
                if block != now:
                    raise ValueError("lookups of texts that came in another order: docs must come from a scan")
                doc = _unsteps(a, np.uint32)
                if kind == OF_VALUES:
                    score_[doc] += _loosed(c, np.int64)
                    continue
                at, times = np.repeat(doc, _loosed(b, np.uint32)), _loosed(c, np.uint64).astype(float)
                add = lambda x: np.bincount(at, x, len(d))
                d["known"] += add(None)
                d["logs"] += add(np.log10(times + 1))
                d["score"] += add(np.log10((times - off) / max(total, 1)) - unknown)
        if d is not None:
            yield done()

    # one shuffle deals lookups, the tables they look in and the documents; each part's table comes first, so its lookups are streamed past it. Another brings the answers back
    # to the documents, packed by block, so that what they are named is not said with each
    c = F.col("n")
    rare = counts.filter(c < least).select(F.xxhash64("token").alias("h"), c.alias("x"))
    looked = texts(docs).select("doc_id", "text").mapInArrow(run, _LOOKED).unionByName(_tails(rare, WORDS, parts)).unionByName(_tails(values.filter(c < top_least), VALUES, parts))
    answers = looked.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(_settled, _SUMS)
    each = answers.repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(summed, _SCORED)
    return each.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * math.log10(total + v + 1)).alias("base_score"), "score")
