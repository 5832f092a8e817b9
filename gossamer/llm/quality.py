"""Line-first cleaning: every line is judged by punctuation, navigation and boilerplate rules, failing lines go, and a document
that loses too much of its text goes with them.

Each rule needs one line only, so the work is a map over documents with no shuffle. A null text counts as empty; an empty text has
no words, fails the base rule and is not kept; repeated rows are judged each for itself. Very long texts are handled whole: memory
follows the longest single text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gossamer.llm.common import texts

SYMBOLS = "#*$%&|<>"
# Word breaks of the contract: \x20 and \x09-\x0D.
BREAKS = " \t\n\x0b\x0c\r"
# Phrases of pages' furniture and licence lines.
FURNITURE = (
    r"all rights reserved|privacy policy|terms of (?:use|service)|cookie|enable javascript|sign up|log ?in|subscribe|newsletter"
    r"|licensed under|released under|general public license|lorem ipsum|click here|share (?:this|on)|read more")
BOILERPLATE = re.compile(FURNITURE, re.IGNORECASE)
SEPARATORS = ("|", ">", "»", "›", "·", "•", "/", "~")
NOISE = r"[#*$%&|<>~^=+\\@]{2,}|[!?]{2,}"
_NOISE = re.compile(NOISE)
_TEXT = re.compile(r"[^\W_]")

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, n_lines long, n_kept_lines long, lost_share double, cleaned string")


def line_verdict(line: str, n_words: int, separator_share: float = 0.3, noise_share: float = 0.3, boilerplate_words: int = 40) -> str:
    """'' for a line that stays, else the rule it fails: punctuation, navigation or boilerplate.

    Punctuation: marks come doubled, or symbols in rows, at many of its words, or the line has no letter or digit at all.
    Navigation: separators stand between many of its words. Boilerplate: a short line with a known phrase.
    """
    if len(_NOISE.findall(line)) > noise_share * n_words or not _TEXT.search(line):
        return "punctuation"
    if sum(w in SEPARATORS for w in re.split(f"[{BREAKS}]+", line)) > separator_share * n_words:
        return "navigation"
    if n_words <= boilerplate_words and BOILERPLATE.search(line):
        return "boilerplate"
    return ""


def repeat_words(words: list) -> int:
    """Words inside a window of three words that occurs twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict = {}
    code = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pair = np.unique(code[:-1] * len(seen) + code[1:], return_inverse=True)[1].astype(np.int64)
    _, which, count = np.unique(pair[:-1] * len(seen) + code[2:], return_inverse=True, return_counts=True)
    twice = count[which] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k:n - 2 + k] |= twice
    return int(hit.sum())


def judge(text: str | None, max_lost: float = 0.5) -> tuple:
    """All columns but doc_id for one text."""
    text = text or ""
    n_words = dup = n_lines = n_kept = lost = 0
    seen: set = set()
    good = []
    words: list = []
    for line in text.split("\n"):
        own = line.encode("utf-8", "surrogatepass").split()
        if not own:
            continue
        words += own
        n_lines += 1
        dup += line in seen
        seen.add(line)
        if line_verdict(line, len(own)):
            lost += len(line)
        else:
            n_kept += 1
            good.append(line)
    n_words = len(words)
    repeated = repeat_words(words)
    chars = len(text) - sum(map(text.count, BREAKS))
    failed = n_words < 50 or 100 * repeated > 50 * n_words
    total = lost + sum(map(len, good))
    share = lost / total if total else 0.0
    return (n_words, chars, sum(map(text.count, SYMBOLS)), dup, repeated, failed, not failed and share <= max_lost, n_lines, n_kept, share,
            "\n".join(good))


def clean_lines(docs: DataFrame, max_lost: float = 0.5, with_text: bool = True) -> DataFrame:
    """Counters, verdict and (``with_text``) the text of the lines that stay, one row per row of ``docs``."""
    fields = SCHEMA if with_text else SCHEMA.rpartition(",")[0]
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        for b in batches:
            rows = [judge(t.as_py(), max_lost)[:len(names) - 1] for t in b.column("text")]
            cols = list(zip(*rows)) or [()] * (len(names) - 1)
            kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "lost_share": pa.float64(), "cleaned": pa.string()}
            yield pa.RecordBatch.from_arrays([b.column("doc_id")] + [pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names[1:], cols)], names)

    return texts(docs).mapInArrow(run, fields)
