"""Rows without an id or with clashing ids, noise against text, near copies against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from gossamer.llm import chunks, common, repeats, simhash, suffixtree

SCHEMA = "doc_id long, text string"


def say(rnd, n, letters="bcdfghjklm"):
    return " ".join(rnd.choice(letters) + rnd.choice("aeiou") + rnd.choice(letters) + rnd.choice("aeiou") for _ in range(n))


@pytest.fixture(scope="module")
def clashing():
    rnd = random.Random(8)
    shared = say(rnd, 60)
    alone = [say(rnd, 120) for _ in range(8)]
    rows = [(None, alone[0]), (None, shared + " " + alone[1]), (None, alone[2] + " " + shared), (4, alone[3]), (4, shared + " x " + alone[4]), (4, alone[3]), (5, alone[5]), (-3, alone[6]), (-3, shared)]
    return rows, shared, alone


@pytest.mark.parametrize("wide", [False, True])
def test_documents_are_numbered(spark, clashing, wide):
    rows, _, _ = clashing
    rows = rows + ([(-(2**62), "a"), (2**62, "b"), (2**63 - 1, "c")] if wide else [])
    got = common.identified(spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1))).collect()
    number = {(r["doc_id"], r["text"]): r["doc"] for r in got}
    assert len(got) == len(rows) and len(number) == len(set(number.values())) and all(v >= 0 for v in number.values())
    order = [k[0] for k in sorted(number, key=number.get)]
    assert order == sorted(order, key=lambda x: (x is None, x or 0)) and set(got[0].asDict()) == {"doc_id", "text", "extra", "doc"}




def test_unique_text_stays(spark, clashing):
    """Only the passage that several rows share is cut, and never from all of them."""
    rows, shared, alone = clashing
    for found in (repeats.digest(repeats.without_repeats(spark.createDataFrame(rows, SCHEMA))), chunks.digest(chunks.without_repeated_chunks(spark.createDataFrame(rows, SCHEMA)))):
        got = found.collect()
        assert len(got) == len(rows)
        for r in got:
            assert 0 <= r["n_removed"] <= r["n_bytes"] and r["n_removed"] <= len(shared) + 2
        whole = {hashlib.sha256(t.encode()).hexdigest() for d, t in rows if shared not in t}
        assert whole <= {r["kept_sha256"] for r in got}
        holders = [r for r in got if r["n_bytes"] in {len(t) for _, t in rows if shared in t}]
        assert sum(r["n_removed"] == 0 for r in holders if r["n_bytes"] != len(alone[0])) >= 1


def test_repeats_of_clashing_ids_against_brute_force(spark, clashing):
    rows, _, _ = clashing
    df = spark.createDataFrame(rows, SCHEMA)
    number = {(r["doc_id"], r["text"]): r["doc"] for r in common.identified(df).collect()}
    seen, want = set(), {}
    for d, t in sorted(number, key=number.get):
        b = t.encode()
        gone = [False] * len(b)
        for k in range(len(b) - 99):
            s = b[k:k + 100]
            if s in seen:
                gone[k:k + 100] = [True] * 100
            seen.add(s)
        want[(d, len(b), sum(gone), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())] = sum((d, t) == r for r in rows)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in repeats.digest(repeats.without_repeats(df)).collect()]
    assert sorted(map(str, got)) == sorted(str(k) for k, n in want.items() for _ in range(n))


def test_pipeline_keeps_unique_texts(spark):
    rnd = random.Random(9)
    a, b, c, d, e = (say(rnd, 80) for _ in range(5))
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (7, d), (7, e), (7, d), (None, c), (None, c), (None, b)], SCHEMA).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long")})
    got = P.near_duplicates(spark, docs, "")
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in got.collect()])) == sorted(map(str, [(3, a), (5, b), (7, d), (7, e), (None, c)])) and got.columns == docs.columns


def shingles(t):
    w = t.split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}


def test_near_copies_are_found(spark):
    """Single-word edits, cuts and insertions: of all pairs of 0.8 and more by brute force, nine in ten are linked; unrelated texts never."""
    rnd = random.Random(10)
    rows = []
    for k in range(150):
        w = say(rnd, rnd.choice([60, 120, 300, 900])).split()
        rows.append((10 * k, " ".join(w)))
        c, kind = list(w), k % 3
        share = rnd.choice([0.002, 0.006, 0.012, 0.02])
        if kind == 0:
            for _ in range(max(1, int(share * len(w)))):
                c[rnd.randrange(len(c))] = say(rnd, 1)
        elif kind == 1:
            del c[5:5 + max(1, int(6 * share * len(w)))]
        else:
            c[7:7] = say(rnd, max(1, int(6 * share * len(w)))).split()
        rows.append((10 * k + 1, " ".join(c)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(rows, SCHEMA)).collect()}
    text = dict(rows)
    alike = [(x, x + 1) for x in range(0, 1500, 10) if (lambda a, b: len(a & b) >= 0.8 * len(a | b))(shingles(text[x]), shingles(text[x + 1]))]
    caught = sum(got[x] == got[y] for x, y in alike)
    assert len(alike) > 100 and caught >= 0.9 * len(alike)
    assert all(v // 10 == k // 10 for k, v in got.items())


def test_similar_on_odd_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.similar(none).count() == 0
    rnd = random.Random(11)
    base = say(rnd, 200).split()
    group = []
    for k in range(120):  # one dense group: more than a small key holds
        w = list(base)
        w[rnd.randrange(200)] = "other"
        group.append((1000 + k, " ".join(w)))
    rows = [(1, None), (2, ""), (None, "one"), (3, "one"), (None, None), (4, say(rnd, 30_000)), *group, group[0]]
    got = simhash.similar(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and {r["component_id"] for r in got if (r["doc_id"] or 0) >= 1000} == {1000}
    assert sorted(str(r["component_id"]) for r in got if (r["doc_id"] or 0) < 1000) == ["1", "1", "1", "3", "3", "4"]


def test_noise_scores_below_text(spark):
    rnd = random.Random(12)
    words = [say(rnd, 1) for _ in range(400)]
    text = lambda n: " ".join(words[int(400 * rnd.random() ** 2)] for _ in range(n))
    train = [(k, text(80)) for k in range(120)]
    held = [(1000 + k, text(79) + " " + say(rnd, 1, "npqrstvwxz")) for k in range(30)]
    noise = [(2000 + k, " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(60))) for k in range(30)]
    # words that occur once tell how many others there may be
    train += [(500 + k, say(rnd, 20, "npqrstvwxz")) for k in range(20)]
    rows = suffixtree.score(spark.createDataFrame(held + noise, SCHEMA), spark.createDataFrame(train, SCHEMA)).collect()
    mean = lambda low: sum(r["score"] / r["n_tokens"] for r in rows if low <= r["doc_id"] < low + 1000) / 30
    assert mean(2000) < mean(1000) - 1
