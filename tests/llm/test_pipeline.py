"""The pipeline against a brute-force version of its filters, and on odd tables."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from gossamer.llm import packing

TABLE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipe"))
    rnd = random.Random(3)
    say = lambda n, a="bcdfgh": " ".join(rnd.choice(a) + rnd.choice("aeiou") + rnd.choice(a) + rnd.choice("aeiou") for _ in range(n))
    item, base = say(14), say(120)
    texts = [None, "", "123 456", *[say(90) for _ in range(20)], base, base, base.replace(base.split()[3], "bababa", 1), "before " + item + " " + say(60), say(50) + " 4785380592391139 " + say(30), say(60, "вгджз")]
    rows = [(k, t, None if k % 9 == 8 else "ru" if t and "в" in t else "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[5], (None, texts[6], "en", None, 1), (None, say(70), "en", None, 1)]
    spark.createDataFrame(rows, TABLE).withColumn("_gs", F.lit(1)).withColumn("component_id", F.lit("x")).write.parquet(d + "/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(d + "/benchmark.parquet")
    return d, rows


def test_stages(spark, folder):
    d, rows = folder
    docs = spark.read.parquet(d + "/documents.parquet")
    ids = []
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, d).cache()
        if k < 4:
            assert out.columns == docs.columns
        ids.append(sorted((r["doc_id"] for r in out.collect()), key=str))
        last, docs = docs, out
    have = [r[0] for r in rows]
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    base = next(k for k in texts if list(texts.values()).count(texts[k]) == 2)
    leaked = next(k for k, t in texts.items() if t and t.startswith("before "))
    assert ids[0] == sorted([k for k in have if k not in (0, 1, 2)], key=str)
    # one row of each group: the copy, the near copy and the repeated row go; of the rows without an id the one whose text has one goes
    assert ids[1] == sorted([*{k for k in have if k is not None and k > 2 and k not in (base + 1, base + 2)}, None], key=str)
    assert ids[2] == [k for k in ids[1] if k != leaked] and ids[3] == ids[2]
    new = {r["doc_id"]: r for r in last.collect()}
    kept = {r["doc_id"]: r for r in docs.collect()}
    card = next(k for k, t in texts.items() if t and "4785380592391139" in t)
    assert "4785380592391139" not in new[card]["text"] and new[card]["n_chars"] == len(new[card]["text"])
    assert all(new[k]["text"] == texts[k] for k in new if k not in (card, None))
    assert sorted(kept, key=str) == sorted(new, key=str) and all(r["n_tokens"] == len(new[k]["text"].split()) + 1 for k, r in kept.items())
    assert sorted(tuple(r) for r in P.run(spark, d).select(F.coalesce("doc_id", F.lit(-1)), "piece", "n_tokens").collect()) == sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["n_tokens"]) for r in docs.collect())


def test_empty(spark, folder, tmp_path):
    d = str(tmp_path)
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    out = P.run(spark, d)
    assert out.count() == 0 and [f.split()[0] for f in packing.SCHEMA.split(", ")] == out.columns


def test_registered():
    q = entry.queries()
    assert "pipeline" in q and len([n for n in q if n.startswith("op")]) == 13
