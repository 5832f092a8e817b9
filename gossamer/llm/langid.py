"""Language ID of mixed text: script ranges narrow the candidates, and Viterbi over per-word scores labels spans.

A word is a run of letters. Its score per language is the sum of log probabilities of its hashed letter trigrams, word borders included. Languages whose
training text hardly uses the word's script are out, unless none uses it. The best path through the words pays ``switch`` for each change
of language; the document's language is the one with most letters on the path, its score that share.

Training counts trigrams of a bounded sample, about ``sample_rows`` labelled documents per language chosen by a hash, in Spark; the model is one number per
hashed trigram and language (65,536 times at most ``MAX_LANGUAGES``), which bounds its broadcast. Labelling is a map over documents.

A null text, an empty one or one without letters is ``und`` with score 0; without any labelled row every document is. Repeated rows are labelled each
for itself. Long texts are labelled whole.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.llm.common import BLOCK_BYTES, broadcast

SAMPLE_ROWS = 2000
SWITCH = 8.0
FEATURES = 1 << 16
MAX_LANGUAGES = 256
UNKNOWN = "und"
# Code point ranges of scripts (first, last, script).
SCRIPTS = [
    (0x0041, 0x024F, "latin"), (0x0250, 0x02FF, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x06FF, "arabic"), (0x0750, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0A00, 0x0A7F, "gurmukhi"), (0x0A80, 0x0AFF, "gujarati"),
    (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"), (0x0C80, 0x0CFF, "kannada"), (0x0D00, 0x0D7F, "malayalam"), (0x0E00, 0x0E7F, "thai"), (0x0E80, 0x0EFF, "lao"),
    (0x1000, 0x109F, "myanmar"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"), (0x1200, 0x137F, "ethiopic"), (0x1780, 0x17FF, "khmer"), (0x1E00, 0x1EFF, "latin"),
    (0x1F00, 0x1FFF, "greek"), (0x3040, 0x30FF, "kana"), (0x3130, 0x318F, "hangul"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"),
]
_NAMES = sorted({s for _, _, s in SCRIPTS})
_TABLES: dict = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, script number) by code point; built once per process."""
    if not _TABLES:
        script = np.full(0x110000, len(_NAMES), np.uint8)
        for a, b, s in SCRIPTS:
            script[a:b + 1] = _NAMES.index(s)
        _TABLES["t"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000), script
    return _TABLES["t"]


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def grams(parts: list[str]) -> tuple[np.ndarray, ...]:
    """Of several texts: (trigram number of each letter, first letter of each word among the letters, text of each word, its script, first and last
    character + 1 in the text)."""
    letter, script = _tables()
    lens = np.array([len(p) + 1 for p in parts], np.int64)
    code = np.frombuffer((" ".join(parts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[code]
    c = np.where(is_letter, code, np.uint32(32))
    before = np.concatenate((np.array([32], np.uint32), c[:-1]))
    after = np.concatenate((c[1:], np.array([32], np.uint32)))
    h = before * np.uint32(0x9E3779B1) ^ c * np.uint32(0x85EBCA77) ^ after * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x27D4EB2F)
    at = np.flatnonzero(is_letter)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    starts = at[first]
    ends = at[np.concatenate((first[1:] - 1, [len(at) - 1]))] + 1 if len(at) else starts
    edge = np.concatenate(([0], np.cumsum(lens)))
    text = np.searchsorted(edge, starts, side="right") - 1
    return (h >> np.uint32(16))[at].astype(np.int64), first, text, script[code[starts]], starts - edge[text], ends - edge[text]


class Model:
    """Log probabilities (feature, language), and which languages use a script."""

    def __init__(self, names: list[str], counts: np.ndarray, min_script_share: float = 0.01):
        self.names = names
        grams_, scripts = counts[:FEATURES], counts[FEATURES:]
        self.log = np.log((grams_ + 0.5) / (grams_.sum(0) + 0.5 * FEATURES)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(0), 1)
        out = share < min_script_share
        out[out.all(1)] = False
        self.out = np.where(out, np.float32(-50), np.float32(0))

    def word_scores(self, feature: np.ndarray, first: np.ndarray, script: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.log[feature], first, axis=0) + self.out[script] if len(first) else np.zeros((0, len(self.names)), np.float32)


def viterbi(scores: np.ndarray, n_words: np.ndarray, switch: float) -> np.ndarray:
    """Best language of every word; ``n_words`` in each text, whose words follow one another in ``scores``. Texts go in step."""
    start = np.cumsum(n_words) - n_words
    order = np.argsort(-n_words, kind="stable")
    live = np.searchsorted(-n_words[order], 0, side="left")
    order = order[:live]
    base, left = start[order], n_words[order]
    back = np.zeros(scores.shape, np.int16)
    longest = int(left[0]) if live else 0
    active = np.searchsorted(-left, -np.arange(longest), side="left")  # texts with more than t words
    v = np.zeros((live, scores.shape[1]), np.float32)
    last = np.zeros(live, np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(longest):
        k = active[t]
        at = base[:k] + t
        if t:
            v = v[:k]
            best = v.argmax(1)
            top = v[np.arange(k), best] - switch
            stay = v >= top[:, None]
            back[at] = np.where(stay, own, best[:, None].astype(np.int16))
            v = np.where(stay, v, top[:, None]) + scores[at]
        else:
            v = scores[at]
        last[:k] = np.where(left[:k] == t + 1, v.argmax(1), last[:k])
    label = np.zeros(len(scores), np.int16)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = base[:k] + t
        label[at] = last[:k]
        if t:
            last[:k] = back[at, last[:k]]
    return label


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model of the rows of ``docs`` (doc_id, text, lang) that have both, from about ``sample_rows`` of each language (all of a rarer one)."""
    rows = docs.filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(sizes)
    if not names:
        return Model([], np.zeros((FEATURES + len(_NAMES) + 1, 0)))
    share = F.lit(0.0)
    for n in names:
        share = F.when(F.col("lang") == n, min(1.0, sample_rows / sizes[n])).otherwise(share)
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches):
        for b in batches:
            for lang in set(b.column("lang").to_pylist()):
                texts_ = [_lower(t) for t, l in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()) if l == lang]
                total = np.zeros(FEATURES + len(_NAMES) + 1, np.int64)
                for part in _parts(texts_):
                    feature, first, _, script, *_ = grams(part)
                    total[:FEATURES] += np.bincount(feature, minlength=FEATURES)
                    total[FEATURES:] += np.bincount(script, minlength=len(_NAMES) + 1)
                k = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(total[k])], ["lang", "feature", "n"])

    counts = np.zeros((FEATURES + len(_NAMES) + 1, len(names)))
    got = chosen.select("text", "lang").mapInArrow(count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    counts[got.column("feature").to_numpy(), [names.index(x) for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    return Model(names, counts)


def _parts(texts_: list[str], size: int = BLOCK_BYTES):
    held, total = [], 0
    for t in texts_:
        if held and total + len(t) > size:
            yield held
            held, total = [], 0
        held.append(t)
        total += len(t)
    if held:
        yield held


def _labelled(texts_: list[str], model: Model, switch: float):
    """(language, score, spans) of each text."""
    scores, n_words, starts, ends = [], [], [], []
    for part in _parts(texts_):
        feature, first, text, script, s, e = grams(part)
        scores.append(model.word_scores(feature, first, script))
        n_words.append(np.bincount(text, minlength=len(part)))
        starts.append(s)
        ends.append(e)
    n = np.concatenate(n_words)
    score, s, e = np.concatenate(scores), np.concatenate(starts), np.concatenate(ends)
    label = viterbi(score, n, switch)
    text = np.repeat(np.arange(len(n)), n)
    many = len(model.names)
    letters = np.bincount(text * many + label, weights=e - s, minlength=len(n) * many).reshape(-1, many)
    best, total = letters.argmax(1), letters.sum(1)
    new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (label[1:] != label[:-1])))) if len(text) else np.zeros(0, int)
    last = np.concatenate((new[1:] - 1, [len(text) - 1])) if len(text) else new
    spans: list[list] = [[] for _ in n]
    for k, a, b, l in zip(text[new].tolist(), s[new].tolist(), e[last].tolist(), label[new].tolist()):
        spans[k].append({"start": a, "end": b, "lang": model.names[l]})
    for k in range(len(n)):
        yield (model.names[best[k]], float(letters[k, best[k]] / total[k]), spans[k]) if total[k] else (UNKNOWN, 0.0, [])


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """``docs`` (any columns, among them text) with lang_pred, score and spans (start, end in characters, lang)."""
    span = "array<struct<start:long,end:long,lang:string>>"
    shared = broadcast(docs.sparkSession, model)
    names = docs.columns
    schema = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast(span).alias("spans")).schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        m = pickle.loads(shared.value)
        for b in batches:
            out: list = []
            for part in _parts([t.as_py() or "" for t in b.column("text")], 4 * BLOCK_BYTES):
                out += _labelled([_lower(t) for t in part], m, switch) if m.names else [(UNKNOWN, 0.0, [])] * len(part)
            c = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(c[0], pa.string()), pa.array(c[1], pa.float64()), pa.array(c[2], kind)], ["row", "lang_pred", "score", "spans"])

    return docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
