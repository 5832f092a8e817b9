"""Benchmark decontamination with one Aho-Corasick automaton over the normalised windows of test questions and answers.

A text is normalised byte by byte (A-Z lower-cased, everything but digits, a-z and non-ASCII turned to a space), so a word of the
normalised text has its place in the original. Windows of consecutive item words are the patterns; one scan of a text gives every
occurrence of every window.

The benchmark is the broadcast side: its windows are measured before they are collected, and cut by a hash into as many automata as
keep each under ``automaton_chars``. With several automata a task runs its documents through one after the other, and holds one at a time;
beyond ``max_parts`` of them it refuses.

A null text has no words; a null item id or item text takes no part; items that share a window are both reported; repeated items count
once; repeated documents are judged each for itself; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import texts

WINDOW = 10
# About 40 bytes of automaton per pattern character: 8 million characters are some 300 MB at the worst, 200 items some 10 MB.
AUTOMATON_CHARS = 8_000_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalised(text: str | None) -> bytes:
    """Same length as the UTF-8 text; words are what is left between spaces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)


def item_windows(items: DataFrame, columns: list[str], window: int = WINDOW) -> DataFrame:
    """(window, items): each distinct window of the named text columns with the ids of the items that have it."""

    def run(batches):
        for b in batches:
            ids, wins = [], []
            for i, *parts in zip(*(b.column(k).to_pylist() for k in range(b.num_columns))):
                for p in parts:
                    w = [x.decode("utf-8", "surrogatepass") for x in normalised(p).split()]
                    for k in range(max(1, len(w) - window + 1)) if w else ():
                        ids.append(i)
                        wins.append(" ".join(w[k:k + window]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(wins, pa.string())], ["item", "window"])

    slim = items.select(F.col("item_id").cast("string").alias("item_id"), *(F.col(c).cast("string").alias(f"_t{k}") for k, c in enumerate(columns)))
    # A window shared by very many items has their list in one row; the list is of benchmark items, whose number is checked below.
    return slim.filter("item_id IS NOT NULL").mapInArrow(run, "item string, window string").groupBy("window").agg(F.collect_set("item").alias("items"))


def _automaton(windows: list[str]):
    a = ahocorasick.Automaton()
    for k, w in enumerate(windows):
        a.add_word(" " + w.encode("utf-8", "surrogatepass").decode("latin-1") + " ", (k, w.count(" ") + 1))
    a.make_automaton()
    return a


def _scan(text: str | None, automaton) -> tuple[list, list, list]:
    """(pattern numbers, word places and byte spans of each occurrence in the original)."""
    flat = normalised(text)
    words = flat.split()
    found = list(automaton.iter(" " + b" ".join(words).decode("latin-1") + " ")) if words else []
    if not found:
        return [], [], []
    sizes = np.array([len(w) for w in words], np.int64)
    after = np.cumsum(sizes + 1)  # where the space after each word stands
    last = np.searchsorted(after, [at for at, _ in found])
    b = np.frombuffer(flat, np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], b.view(np.int8), [0]))))
    starts, ends = edge[0::2], edge[1::2]
    first = last - np.array([n for _, (_, n) in found]) + 1
    return [k for _, (k, _) in found], list(zip(first.tolist(), (last + 1).tolist())), list(zip(starts[first].tolist(), ends[last].tolist()))


def scan(docs: DataFrame, parts: list[list[tuple[str, list[str]]]]) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted) and spans (merged, UTF-8 byte offsets of the original); one automaton per part."""
    sc = docs.sparkSession.sparkContext
    shared = [sc.broadcast(([w for w, _ in p], [sorted(i) for _, i in p])) for p in parts if p]

    def run(batches):
        built = _automaton(shared[0].value[0]) if len(shared) == 1 else None
        for b in batches:
            text = b.column("text").to_pylist()
            n, places, spans, items = [len(normalised(t).split()) for t in text], [[] for _ in text], [[] for _ in text], [set() for _ in text]
            for part in shared:  # of several automata a task holds one at a time
                automaton = built or _automaton(part.value[0])
                for i, t in enumerate(text):
                    which, at, sp = _scan(t, automaton)
                    places[i] += at
                    spans[i] += sp
                    items[i].update(x for k in set(which) for x in part.value[1][k])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array([_covered(p)[1] for p in places], pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                 pa.array([[{"start": s, "end": e} for s, e in _covered(x)[0]] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "n_words", "n_hit", "items", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")


def _covered(spans: list) -> tuple[list, int]:
    out: list = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return out, sum(e - s for s, e in out)


def automaton_parts(items: DataFrame, columns: list[str], window: int = WINDOW, automaton_chars: int = AUTOMATON_CHARS, max_parts: int = 64) -> list[list[tuple[str, list[str]]]]:
    """Windows with their items, in as many parts as keep each automaton under ``automaton_chars``."""
    w = item_windows(items, columns, window).withColumn("_h", F.xxhash64("window"))
    size = w.agg(F.coalesce(F.sum(F.length("window") + 2), F.lit(0)).alias("n")).first()["n"]
    n = -(-size // automaton_chars) or 1
    if n > max_parts:
        raise ValueError(f"benchmark windows of {size} characters need {n} automata, more than {max_parts}")
    return [[(r["window"], r["items"]) for r in w.filter(F.pmod("_h", F.lit(n)) == k).collect()] for k in range(n)]


def decontaminate(docs: DataFrame, items: DataFrame, columns: list[str], **limits) -> DataFrame:
    """One row per document: n_words, n_hit (words inside an occurrence), items, spans."""
    return scan(docs, automaton_parts(items, columns, **limits))


def clean(docs: DataFrame, items: DataFrame, columns: list[str], **limits) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window occurs."""
    sc = docs.sparkSession.sparkContext
    shared = [sc.broadcast([w for w, _ in p]) for p in automaton_parts(items, columns, **limits) if p]
    at = docs.columns.index("text")

    def run(batches):
        built = _automaton(shared[0].value) if len(shared) == 1 else None
        for b in batches:
            keep = [True] * b.num_rows
            for part in shared:
                automaton = built or _automaton(part.value)
                keep = [k and not _scan(t.as_py(), automaton)[0] for k, t in zip(keep, b.column(at))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema) if shared else docs


def digest(found: DataFrame) -> DataFrame:
    """The checked columns of the query."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
