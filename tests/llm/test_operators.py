"""Corpus operators against brute force, and on nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gossamer.llm import chunks, decontamination, langid, packing, pii, quality, repeats, simhash, suffixtree, urlfilter
from gossamer.llm.common import is_held_out

# A column of each name the operators use inside, to see that it goes no further.
CLASH = ("fp", "u", "v", "key", "row", "doc", "z", "spans", "s", "e", "n", "h1", "kh", "component_id", "hits", "window", "shard", "token")


def words(rnd, n, vocabulary=400):
    return " ".join(f"w{int(vocabulary * rnd.random() ** 2)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Nulls, empties, copies, near copies, a shared passage, one long text, repeated rows."""
    rnd = random.Random(1)
    passage = words(rnd, 70)
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one"), (5, "éß two three"), (None, words(rnd, 80))]
    base = words(rnd, 300)
    rows += [(10 + k, base) for k in range(12)]
    for k in range(12):
        w = base.split()
        w[rnd.randrange(len(w))] = f"changed{k}"
        rows.append((30 + k, " ".join(w)))
    rows += [(50 + k, words(rnd, 60) + " " + passage + "\n" + words(rnd, 40)) for k in range(15)]
    rows += [(70 + k, words(rnd, rnd.randrange(1, 200))) for k in range(30)]
    rows += [(200, words(rnd, 30000)), (71, rows[-29][1]), (53, next(t for d, t in rows if d == 53)), (201, "a" * 700), (202, passage)]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(5).withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def raw(t):
    return (t or "").encode()


def test_quality(docs, corpus):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.clean_lines(docs).collect()}
    for d, t in corpus:
        w = raw(t).split()
        r = got[(d, len(w))]
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if x.split()]
        assert r["n_repeat_words"] == len(hit) and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["word_chars"] == sum(len(x.decode()) for x in w)
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_quality_rules(spark):
    rule = lambda line: quality.line_verdict(line, len(line.split()))
    assert rule("A plain sentence, with a comma.") == "" and rule("home | about | contact | news") == "navigation"
    assert rule("BUY!! NOW!! ALL!! OF!! IT!!") == "punctuation" and rule("of%%% the&&& word*** here###") == "punctuation"
    assert rule("All rights reserved.") == "boilerplate" and rule("--- *** ---") == "punctuation"
    clean = " ".join(f"word{k}" for k in range(60)) + "."
    text = clean + "\nhome | about | contact\n" + clean.replace("word", "term")
    r = quality.clean_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["kept"] and r["cleaned"].count("\n") == 1 and "|" not in r["cleaned"] and r["n_kept_lines"] == 2


def test_language(spark, none):
    rnd = random.Random(2)
    speak = {"xx": "abcde", "yy": "fghij", "ru": "абвгд"}
    say = lambda l, n: " ".join("".join(rnd.choice(speak[l]) for _ in range(rnd.randrange(2, 8))) for _ in range(n))
    train = spark.createDataFrame([(k, say(l, 30), l) for k in range(60) for l in speak] + [(0, None, "xx"), (1, "abc", None)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    rows = [(1, None, None), (2, "", None), (3, "123 !!", None), (4, say("xx", 9), "own"), (5, say("yy", 9), None), (6, say("ru", 2), None), (7, say("xx", 20) + " " + say("yy", 30), None)]
    got = {r["row"]["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string"), model).collect()}
    assert [got[k]["lang_pred"] for k in range(1, 8)] == ["und", "und", "und", "xx", "yy", "ru", "yy"]
    assert got[1]["score"] == 0 and got[4]["score"] == 1 and [s["lang"] for s in got[7]["spans"]] == ["xx", "yy"]
    text = rows[6][1]
    assert text[got[7]["spans"][1]["start"]:got[7]["spans"][1]["end"]] == " ".join(text.split()[20:])
    assert langid.identify(none, langid.fit(none)).count() == 0
    assert langid.identify(train, langid.fit(none)).select("lang_pred").distinct().collect()[0][0] == "und"


def test_viterbi_is_exact():
    rnd = np.random.default_rng(3)
    n = np.array([0, 1, 5, 3, 0, 7])
    s = rnd.normal(0, 4, (int(n.sum()), 3)).astype(np.float32)
    got = langid.viterbi(s, n, 3.0)
    import itertools
    at = 0
    for k in n:
        best = max((sum(s[at + i, p[i]] for i in range(k)) - 3.0 * sum(p[i] != p[i - 1] for i in range(1, k)) for p in itertools.product(range(3), repeat=int(k))), default=0)
        p = got[at:at + k]
        assert abs(sum(s[at + i, p[i]] for i in range(k)) - 3.0 * sum(p[i] != p[i - 1] for i in range(1, k)) - best) < 1e-4
        at += k


def fingerprint(t):
    w = [x for x in raw(t).lower().split()]
    h = [xxhash.xxh64_intdigest(b" ".join(w[k:k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs, corpus, none):
    got = [tuple(r) for r in simhash.digest(simhash.near_duplicates(docs)).collect()]
    fps = [fingerprint(t) for _, t in corpus]
    group = list(range(len(corpus)))
    for i in range(len(corpus)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (d, _), g in zip(corpus, group):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    want = [(d, f"{f:016x}", least.get(g)) for (d, _), f, g in zip(corpus, fps, group)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("n", [3, 40, 900])
def test_gray_index(n):
    rnd = random.Random(n)
    seeds = [rnd.getrandbits(64) for _ in range(max(1, n // 12))]
    values = list({rnd.choice(seeds) ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(5))) for _ in range(n)})
    x = simhash.GrayIndex(np.array(values, np.uint64))
    got = x.link()
    v = x.values.tolist()
    group = list(range(len(v)))
    for i in range(len(v)):
        for j in range(i):
            if (v[i] ^ v[j]).bit_count() <= 4 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert got.tolist() == group
    assert sorted(simhash.gray_rank(np.array([0, 1, 3, 2, 6, 7, 5, 4], np.uint64)).tolist()) == simhash.gray_rank(np.array([0, 1, 3, 2, 6, 7, 5, 4], np.uint64)).tolist()


def test_urls(spark):
    urls = [None, "", "nothing", "HTTP://WWW.Example.com/en/a?q#f", "http://example.com/en/x", "https://a.b.example.com/en/", "https://x.net/es/1", "https://net/fr/", "https://other.net/de/", "ftp://site.com", "ftp://site.com?x/en/", "http://badexample.com/en/", "http://a.example.org#/en/"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(100 + k, f"http://bad.example.org/{k}") for k in range(40)] + [(200 + k, f"http://good.example.org/{k}") for k in range(40)] + [(None, "http://bad.example.org/")], "page_id long, url string").withColumn("host", F.lit("x"))
    labels = spark.createDataFrame([(100 + k, 0, 0) for k in range(30)] + [(200 + k, 1, 0) for k in range(30)] + [(200, 1, 0), (201, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in urlfilter.filter_urls(pages, labels).collect()}
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"]) for k in range(len(urls))] == [
        ("", "", None), ("", "", None), ("", "", None), ("www.example.com", "/en/a", "www.example.com/en/"), ("example.com", "/en/x", "example.com/en/"),
        ("a.b.example.com", "/en/", "example.com/en/"), ("x.net", "/es/1", "net/es/"), ("net", "/fr/", "net/fr/"), ("other.net", "/de/", None), ("site.com", "", None),
        ("site.com", "", None), ("badexample.com", "/en/", "com/"), ("a.example.org", "", None)]
    assert got[3]["verdict"] == "allow" and got[4]["verdict"] == "block" and got[105]["verdict"] == "block" and got[139]["verdict"] == "block" and got[205]["verdict"] == "allow"
    assert got[0]["verdict"] == "allow" and got[None]["verdict"] == "block"
    assert {r["verdict"] for r in urlfilter.filter_urls(pages.filter("page_id >= 100"), labels.limit(0)).collect()} == {"allow"}
    assert urlfilter.filter_urls(pages.limit(0), labels).count() == 0


def test_decontamination(spark, docs, corpus, none):
    passage = next(t for d, t in corpus if d == 202).split()
    items = [(1, " ".join(passage[5:25])), (2, passage[30].upper() + ", " + "-".join(passage[31:39])), (3, None), (None, passage[40]), (4, "!!"), (12, " ".join(passage[5:25])), (1, " ".join(passage[5:25]))]
    table = spark.createDataFrame(items, "item_id long, text string")

    def split(t):
        return [w for w in "".join(c.lower() if c.isascii() and c.isupper() else c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in t or "").split(" ") if w]

    want = []
    for d, t in corpus:
        w, hit, found = split(t), set(), set()
        for i, x in items:
            x = split(x)
            for p in {tuple(x[k:k + 10]) for k in range(max(1, len(x) - 9))} if x and i is not None else ():
                for k in range(len(w) - len(p) + 1):
                    if tuple(w[k:k + len(p)]) == p:
                        hit |= set(range(k, k + len(p)))
                        found.add(str(i))
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert any(x[5] for x in want)
    for chars in (decontamination.AUTOMATON_CHARS, 100):
        found = decontamination.decontaminate(docs, table, ["text"], automaton_chars=chars)
        assert sorted((tuple(r) for r in decontamination.digest(found).collect()), key=str) == sorted(want, key=str)
    for r in found.join(docs.select("doc_id", "text"), "doc_id").collect():
        assert sum(len(split(r["text"].encode()[s["start"]:s["end"]].decode())) for s in r["spans"]) == r["n_hit"]
    assert {r["contaminated"] for r in decontamination.digest(decontamination.decontaminate(docs, table.limit(0), ["text"])).collect()} == {False}
    assert decontamination.decontaminate(none, table, ["text"]).count() == 0
    assert decontamination.clean(docs, table, ["text"]).count() == sum(not x[5] for x in want)


def test_packing(spark, docs, corpus, none):
    rows = packing.best_fit(packing.word_lengths(docs), shard_rows=40).collect()
    for d, t in corpus:
        n = len(raw(t).split())
        mine = [r for r in rows if r["doc_id"] == d]
        assert sum(r["n_tokens"] for r in mine) == (n + 1 if n else 0) * sum(d == x for x, _ in corpus)
    bins = {}
    for r in rows:
        if r["n_tokens"]:
            bins.setdefault(r["bin_id"], []).append(r)
        else:
            assert r["bin_id"] is None
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["n_tokens"]
        assert b[0]["bin_capacity"] == next(c for c in packing.CAPACITIES if c >= at)
    assert packing.best_fit(packing.word_lengths(none)).count() == 0


def test_packing_prefers_cheap_bins():
    where, offset, final = packing.pack([500] * 16)
    assert sum(final) <= 8192 and all(o + 500 <= final[b] for b, o in zip(where, offset))
    assert packing.pack([8192, 300]) == ([0, 1], [0, 0], [8192, 512])


def test_pii(spark):
    card, ip, phone = "4785380592391139", "72.162.198.226", "+1 (869) 555-7420"
    texts = [f"a {card}, {ip} {phone} x.y@mail.example.com token = \"1d46e940c38b6b02bbe8\" 2024-02-29", f"again {card}$$$ 4785 3805 9239 1139 and {ip}! 29.02.2024", None, "", "plain words",
             "8007782375593431 300.1.2.3 2023-02-29 000-12-3456", card + " " + card + " 12"]
    got = [r for r in pii.counted(pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).withColumn("hits", F.lit(1)))).orderBy("doc_id").collect()]
    a, b = got[0]["text"].split(), got[1]["text"].split()
    new = a[1].rstrip(",")
    assert new != card and len(new) == 16 and sum(int(c) * (1 + k % 2) - 9 * (k % 2 and c > "4") for k, c in enumerate(new[::-1])) % 10 == 0
    assert b[1] == new + "$$$" and "".join(b[2:6]) == new and b[7] == a[2] + "!" and a[2] != ip and all(int(x) < 256 for x in a[2].split("."))
    assert a[3] == "+1" and len(" ".join(a[3:6])) == len(phone) and "mail.example.com" not in got[0]["text"] and "1d46e9" not in got[0]["text"]
    day = a[-1]
    assert day != "2024-02-29" and b[-1] == ".".join(day.split("-")[::-1])
    assert [got[k]["text"] for k in (2, 3, 4, 5)] == texts[2:6]
    assert got[6]["text"] == f"{new} {new} 12" and [got[0][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1, 0, 1, 1]


def test_feistel_is_a_permutation(spark):
    n = 37 * 41
    df = spark.range(n).select(pii.feistel(F.col("id"), F.lit(37), F.lit(41), "k", "t").alias("v"))
    assert sorted(r["v"] for r in df.collect()) == list(range(n))
    d = spark.range(1000).select(pii.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("v"))
    assert sorted(r["v"] for r in d.collect()) == [f"{k:03}" for k in range(1000)]


def test_scores(spark, docs, corpus, none):
    held = is_held_out(F.col("doc_id"), 7, 2)
    rows = suffixtree.score(docs, docs.filter(~held), head=50, p_min=1e-3).collect()
    c = Counter()
    for d, t in corpus:
        if zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2:
            c.update([*raw(t).lower().split(), b""])
    n, v = sum(c.values()), len(c)
    want = []
    for d, t in corpus:
        x = [*raw(t).lower().split(), b""]
        want.append((d, len(x), sum(c[k] > 0 for k in x), n, round(sum(math.log10((c[k] + 1) / (n + v + 1)) for k in x), 4)))
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows), key=str) == sorted(want, key=str)
    learnt = [r for r in rows if zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 7 != 2]
    assert all(r["score"] <= 0 for r in rows) and sum(r["score"] for r in learnt) > sum(r["base_score"] for r in learnt)
    assert suffixtree.score(none, none).count() == 0
    assert {r["score"] for r in suffixtree.score(docs, none).collect()} == {0.0}


def test_tree_is_a_distribution():
    """Probabilities of all next words sum to one in every state; the state is the longest retained one."""
    rnd = random.Random(5)
    texts = [[w for _ in range(20) for x in [rnd.choice([b"a", b"b"])] for w in (x, b"then", x + b"x", rnd.choice([b"p", b"q", b"r"]))] for _ in range(30)]
    count = Counter(w for t in texts for w in [*t, b""])
    tree = suffixtree.WordTree({w: n for w, n in count.items() if n >= 2})
    seqs = [[tree.end] * suffixtree.ORDER + [tree.number[w] for w in t] + [tree.end] for t in texts]
    for d in range(2, suffixtree.ORDER + 2):
        grams, seen = Counter(), Counter()
        for t in texts:
            ids, token = tree.numbers([t])
            g = tree.sequences(ids, d - 1)
            grams.update(x for x in tree.candidates(g, d)[token].tolist() if x >= 0)
            seen.update(x for x, ok in zip([0, *g[d - 1][:-1].tolist()], token) if ok and x)
        keep = {k: n for k, n in grams.items() if n >= 2}
        size = np.zeros(len(tree.count[d - 1]))
        for k, n in seen.items():
            size[k] = n
        tree.add_level(d, np.array(sorted(keep)), np.array([keep[k] for k in sorted(keep)], float), size)
    tree.finish(tree.count[1] / sum(count.values()))
    assert tree.retained[1].any() and tree.retained[2].any()
    for s in seqs[:3]:
        for at in range(suffixtree.ORDER, len(s), 7):
            total = 0.0
            for w in range(1, tree.m):
                log, open_ = tree.score(np.array([*s[:at], w]))
                total += math.exp(log[-1]) * (tree.listed[1][w] if open_[-1] else 1)
            assert abs(total - 1) < 1e-6


def test_rare_sequences_are_learnt(spark):
    """A sequence seen SUPPORT times counts, however small its share of the tokens; scores are those of the tree in memory."""
    rnd = random.Random(6)
    texts = [words(rnd, 60, 60) for _ in range(150)] + [f"x{k} y z u v " + words(rnd, 20, 60) for k in range(4)] + ["a rare phrase of six words"] * 9 + ["", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    split = [t.encode().split() for t in texts]
    count = Counter(w for t in split for w in [*t, b""])
    total = sum(count.values())
    once, twice = (sum(n == k for n in count.values()) for k in (1, 2))
    off = min(max(once / (once + 2 * twice), 0.05), 0.9) if once + twice else 0.05
    tree = suffixtree.WordTree({w: n for w, n in count.items() if n >= suffixtree.SUPPORT})
    for d in range(2, suffixtree.ORDER + 2):
        grams, seen = Counter(), Counter()
        for t in split:
            ids, token = tree.numbers([t])
            g = tree.sequences(ids, d - 1)
            grams.update(x for x in tree.candidates(g, d)[token].tolist() if x >= 0)
            seen.update(x for x, ok in zip([0, *g[d - 1][:-1].tolist()], token) if ok and x)
        keep = {k: n for k, n in grams.items() if n >= suffixtree.SUPPORT}
        size = np.zeros(len(tree.count[d - 1]))
        for k, n in seen.items():
            size[k] = n
        tree.add_level(d, np.array(sorted(keep)), np.array([keep[k] for k in sorted(keep)], float), size)
    tree.finish((tree.count[1] - off) / total)
    want = {}
    for k, t in enumerate(split):
        ids, token = tree.numbers([t])
        log, open_ = tree.score(ids)
        want[k] = (log[token].sum() + sum(math.log((count[w] - off) / total) for w, o in zip([*t, b""], open_[token]) if o)) / math.log(10)
    for share in (0.5, 1e-9):
        got = {r["doc_id"]: r["score"] for r in suffixtree.score(df, df, head=20, p_min=share, top=20).collect()}
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want)
    alone = sum(math.log10((count[w] - off) / total) for w in [*split[-3], b""])
    assert got[len(texts) - 3] > 0.5 * alone  # its words tell each other


def removed(corpus, length=100):
    seen, out = set(), {}
    for d, t in sorted({(2**63 if d is None else d, t or "") for d, t in corpus}):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            if w in seen:
                gone[p:p + length] = True
            seen.add(w)
        out[d] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeats(docs, corpus, none, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    want = removed(corpus)
    got = [tuple(r) for r in repeats.digest(repeats.without_repeats(docs)).collect()]
    assert sorted(got, key=str) == sorted([(d, *want[2**63 if d is None else d]) for d, _ in corpus], key=str)
    assert repeats.digest(repeats.without_repeats(none)).count() == 0


def test_long_text_in_blocks():
    rnd = random.Random(8)
    b = words(rnd, 4000).encode()
    whole = repeats._anchor_rows(np.array([1]), [b], 100)
    split = [repeats._pieces([b], 100, 1500)]
    rows = []
    for piece, base, first, last in split[0]:
        x, ends = repeats.concatenated(piece)
        _, kh, lo, n = repeats.segments(x, ends)
        own = repeats.owners(repeats.gram_hashes(x))[lo]
        ok = (own >= first) & (own < last)
        rows += list(zip(kh[ok].view(np.int64).tolist(), (lo[ok] + base).tolist(), n[ok].tolist()))
    assert sorted(rows) == sorted((k, s, n) for k, s, n in zip(whole[0].tolist(), whole[3].tolist(), whole[4].tolist()) if n)


def test_suffix_array_and_intervals():
    rnd = random.Random(9)
    strings = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(20, 60))).encode() for _ in range(12)]
    strings += [strings[0][:30] + b"zz" + strings[1][5:40], strings[0]]
    x = repeats.EnhancedSuffixArray(strings, 8)
    at = [(int(x.string[p]), int(p - x.starts[x.string[p]])) for p in x.place]
    suffix = [strings[s][o:] for s, o in at]
    assert len(at) == sum(len(s) - 7 for s in strings) and [s[:100] for s in suffix] == sorted(s[:100] for s in suffix)
    found = {}
    for size, i, j in x.maximal_repeats():
        assert len({s[:size] for s in suffix[i:j]}) == 1 and j - i > 1
        found[suffix[i][:size]] = sorted(at[i:j])
    for r, where in found.items():
        assert where == sorted((k, o) for k, s in enumerate(strings) for o in range(len(s) - len(r) + 1) if s[o:o + len(r)] == r)
    every = Counter(s[o:o + 8] for s in strings for o in range(len(s) - 7))
    assert {w for w, n in every.items() if n > 1} == {r[k:k + 8] for r in found for k in range(len(r) - 7)}


def test_chunks(docs, corpus, none):
    seen, want = set(), {}
    for d, t in sorted({(2**63 if d is None else d, t or "") for d, t in corpus}):
        b, at, runs, n = t.encode(), 0, [], 0
        for e in chunks.cuts(b):
            if b[at:e] in seen:
                n += 1
                if runs and runs[-1][1] == at:
                    runs[-1][1] = e
                else:
                    runs.append([at, e])
            seen.add(b[at:e])
            at = e
        assert at == len(b)
        runs = [r for r in runs if r[1] - r[0] >= chunks.LEAST]
        want[d] = (len(b), len(chunks.cuts(b)), n, sum(e - s for s, e in runs), len(runs))
    got = chunks.digest(chunks.without_repeated_chunks(docs)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted([(d, *want[2**63 if d is None else d]) for d, _ in corpus], key=str)
    passage = next(r for r in got if r["doc_id"] == 202)
    assert passage["n_removed"] > 0.6 * passage["n_bytes"]
    assert chunks.digest(chunks.without_repeated_chunks(none)).count() == 0


def test_short_copies_go(spark):
    got = chunks.digest(chunks.without_repeated_chunks(spark.createDataFrame([(1, "a short text"), (2, "a short text")], "doc_id long, text string"))).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_repeated"], r["n_removed"]) for r in got) == [(1, 12, 0, 0), (2, 12, 1, 12)]


def test_chunk_borders_resist_shifts():
    rnd = random.Random(4)
    b = bytes(rnd.randrange(256) for _ in range(20000))
    a = {b[s:e] for s, e in zip([0, *chunks.cuts(b)], chunks.cuts(b))}
    c = b"inserted" + b
    shifted = {c[s:e] for s, e in zip([0, *chunks.cuts(c)], chunks.cuts(c))}
    assert len(a & shifted) > 0.98 * len(a)
    h, r = chunks.gear(np.frombuffer(b, np.uint8)).tolist(), chunks.RADIUS
    assert chunks.candidates(b).tolist() == [k + 1 for k in range(r, len(h) - r) if max(h[k - r:k]) < h[k] >= max(h[k + 1:k + r + 1])]
    assert min(len(x) for x in a) >= r and max(len(x) for x in a) <= chunks.LARGEST + r
    assert [len(x) for x in (b"a" * n for n in (0, 5, 97)) for _ in chunks.cuts(x)] == [5, 97]
    assert max(np.diff(chunks.cuts(b"a" * 5000))) == chunks.LARGEST


def test_chunk_borders_do_not_depend_on_blocks(monkeypatch):
    rnd = random.Random(5)
    for n in (0, 1, 47, 96, 97, 1000, 1010, 5000):
        b = bytes(rnd.randrange(97, 123) for _ in range(n))
        whole = chunks.cuts(b)
        monkeypatch.setattr(chunks, "BLOCK_BYTES", 500)
        assert chunks.cuts(b) == whole
        monkeypatch.undo()


def test_chunks_find_passages_and_leave_phrases():
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(rnd.randint(2, 10))) for _ in range(3000)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    parts = lambda t: {t.encode()[s:e] for s, e in zip([0, *chunks.cuts(t.encode())], chunks.cuts(t.encode()))}
    within = lambda p: " ".join((text(rnd.randint(20, 200)), p, text(rnd.randint(20, 200))))
    shared = lambda n: sum(bool(parts(within(p)) & parts(within(p))) for p in (text(n) for _ in range(300)))
    assert shared(55) >= 285
    assert shared(6) == 0


def test_answers_follow_blocks_not_documents():
    """Answers to the lookups of many documents of one block come back as one row per kind, and as they were asked."""
    rnd = np.random.default_rng(3)
    h, x = np.sort(rnd.integers(0, 2**63, 500).astype(np.uint64)), rnd.integers(-2**40, 2**40, 500)
    assert (suffixtree._unsteps(suffixtree._steps(h), np.uint64) == h).all() and (suffixtree._loosed(suffixtree._squeezed(x), np.int64) == x).all()
    asked = [np.concatenate((h[rnd.integers(0, 500, 3)], rnd.integers(0, 2**63, 1).astype(np.uint64))) for _ in range(300)]
    ask = [suffixtree._squeezed(np.concatenate(asked))], [suffixtree._steps(np.arange(300, dtype=np.uint32))], [suffixtree._squeezed(np.full(300, 4, np.uint32))]
    rows = [suffixtree._packed([0], suffixtree.VALUES, 0, [suffixtree._steps(h)], [suffixtree._squeezed(x)], [b""]), suffixtree._packed([0], suffixtree.OF_VALUES, 7, *ask)]
    got = [r for b in suffixtree._settled(rows) for r in suffixtree._rows(b, suffixtree._SUMS)]
    assert len(got) == 1 and got[0][:2] == (7, suffixtree.OF_VALUES)
    value = dict(zip(h.tolist(), x.tolist()))
    assert suffixtree._unsteps(got[0][2], np.uint32).tolist() == list(range(300))
    assert suffixtree._loosed(got[0][4], np.int64).tolist() == [sum(value.get(k, 0) for k in a.tolist()) for a in asked]
