"""Vector codes, WARC archives and resampling against brute force, and on odd rows."""

import gzip
import hashlib
import io
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gossamer.llm import resampling, vectorcodes, warc

NAN, INF = float("nan"), float("inf")


def lloyd(rows, parts, entries, rounds):
    """Plain Python version: rows are (id, vector, label); gives {row number: (code, error)} and the codebooks."""
    sound = [(i, r) for i, r in enumerate(rows) if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    sound.sort(key=lambda x: (x[1][0] is None, x[1][0] or 0, x[1][1]))
    width = next(len(r[1]) for _, r in sound if len(r[1]) % parts == 0)
    sound = [(i, [math.floor(256 * x) for x in r[1]]) for i, r in sound if len(r[1]) == width]
    w = width // parts
    cut = lambda v, p: v[p * w:(p + 1) * w]
    books = [[cut(v, p) for _, v in sound[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        at = [[near(v, p) for p in range(parts)] for _, v in sound]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v), a in zip(sound, at) if a[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out = {}
    for i, v in sound:
        code = [near(v, p) for p in range(parts)]
        out[i] = ("".join(f"{e:02x}" for e in code), sum(far(cut(v, p), books[p][e]) for p, e in enumerate(code)))
    return out, books


@pytest.fixture(scope="module")
def vectors():
    rnd = random.Random(4)
    vec = lambda n=16, s=0.3: [np.float32(rnd.gauss(0, s)).item() for _ in range(n)]
    rows = [(k, vec(), k % 3) for k in range(300)]
    rows += [(k, rows[7][1], None) for k in range(300, 500)]  # one vector in two fifths of all rows
    rows += [(900, None, 1), (901, [None] * 16, 1), (902, [NAN] + vec(15), 1), (903, [INF] + vec(15), 0), (904, [], 2), (905, vec(8), 1), (906, vec(17), 1)]
    rows += [(3, rows[3][1], 0), (3, vec(), 1), (None, vec(), 2), (None, vec(), None), (910, [1e30] + vec(15), 5)]
    rnd.shuffle(rows)
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("parts, entries, rounds", [(4, 8, 2), (16, 64, 3), (2, 256, 1)])
def test_codes(spark, vectors, parts, entries, rounds):
    rows = [r for r in vectors if r[0] != 910]
    want, books = lloyd(rows, parts, entries, rounds)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("x") for c in ("pos", "origin", "n", "moved", "part", "code")})
    codes, got = vectorcodes.compress(df, parts, entries, rounds)
    assert got.tolist() == books
    out = vectorcodes.digest(codes, got).collect()
    name = lambda v: (v is None, v or 0)
    assert sorted([(r["vec_id"], r["code"], r["error"]) for r in out], key=lambda x: (name(x[0]), x[1:])) == sorted([(rows[i][0], *c) for i, c in want.items()], key=lambda x: (name(x[0]), x[1:]))
    by = defaultdict(int)
    for i, (_, e) in want.items():
        by[rows[i][2]] += e
    assert Counter(r["label_error"] for r in out) == Counter(by[rows[i][2]] for i in want)
    assert {r["codebooks_sha256"] for r in out} == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}


def test_codes_odd(spark, vectors):
    empty, books = vectorcodes.compress(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and vectorcodes.digest(empty, books).count() == 0
    assert vectorcodes.compress(spark.createDataFrame([(1, None, 1), (2, [NAN] * 16, 1)], SCHEMA))[0].count() == 0
    one = vectorcodes.compress(spark.createDataFrame([(1, [0.5] * 32, None)], SCHEMA))[0].collect()
    assert [tuple(r) for r in one] == [(1, None, "00" * 16, 0)]
    huge = vectorcodes.compress(spark.createDataFrame(vectors, SCHEMA), 4, 8)[0].filter("vec_id = 910").first()
    assert huge["error"] >= 0 and len(huge["code"]) == 8
    with pytest.raises(ValueError):
        vectorcodes.compress(spark.createDataFrame(vectors, SCHEMA), rounds=0)


def test_nearest_both_ways():
    rnd = np.random.default_rng(0)
    x, book = rnd.integers(-9, 9, (500, 3)), rnd.integers(-9, 9, (40, 3))
    big = 1 << 22
    a, b = vectorcodes.nearest(x, book), vectorcodes.nearest(x * big, book * big)
    assert (a[0] == b[0]).all() and (a[1] * big * big == b[1]).all()
    assert all(a[1] == ((x - book[a[0]]) ** 2).sum(1)) and all(a[0] == ((x[:, None] - book[None]) ** 2).sum(2).argmin(1))


@pytest.fixture(scope="module")
def pages():
    rnd = random.Random(5)
    long = "<p>" + "é" * 60 + "</p>"
    rows = [(k, f"http://a.example/{k}", f"<html>{k} " + "".join(rnd.choice("abc <>") for _ in range(rnd.randrange(400)))) for k in range(40)]
    rows += [(k, f"http://b.example/{k}", long) for k in range(60, 90)] + [(k, None, "x" * n) for k, n in ((91, 99), (92, 99), (93, 100), (94, 100), (95, 0))]
    rows += [(96, "http://c.example/a b\r\nX: y", None), (60, "http://b.example/60", long), (None, "http://n.example", long), (None, None, "y" * 150), (None, None, "y" * 150), (97, "http://d.example", "\r\n\r\nWARC/1.1\r\n" * 30)]
    rows += [(98, "http://e.example", "z" * 3_000_000), (99, "http://e.example/2", "".join(chr(rnd.randrange(32, 0x2FFF)) for _ in range(200_000)))]
    rnd.shuffle(rows)
    return rows


PAGES = "page_id long, url string, html string"


def expected(rows):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and p is not None:
            first[b] = min(p, first.get(b, p))
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        again = f is not None and f != p
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None, None))
    return out


def test_warc_round_trip(spark, pages):
    df = spark.createDataFrame(pages, PAGES).repartition(4).withColumns({c: F.lit("x") for c in ("digest", "first", "path", "offset")})
    archives = warc.write_archives(df, archive_bytes=3000)
    listed = archives.collect()
    assert len(listed) > 4 and sum(r["n_records"] for r in listed) == len(pages)
    records = warc.read_archives(archives, with_payload=True)
    assert sorted(map(str, warc.digest(records).collect())) == sorted(map(str, spark.createDataFrame(expected(pages), warc.digest(records).schema).collect()))
    back = warc.payloads(records.filter("record_type <> 'warcinfo'")).collect()
    want = Counter((p, None if u is None else warc.target(u), (h or "").encode()) for p, u, h in pages)
    assert Counter((r["page_id"], r["url"], bytes(r["payload"])) for r in back) == want
    # every archive is a chain of gzip members that any reader can inflate
    path = listed[0]["path"].removeprefix("file:")
    plain = gzip.open(path).read()
    assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and len(gzip.open(path).read()) > listed[0]["n_records"]
    folder = listed[0]["path"].rsplit("/", 1)[0]
    assert warc.archives_in(spark, folder).count() == len(listed)


def test_warc_empty(spark):
    assert warc.digest(warc.read_archives(warc.write_archives(spark.createDataFrame([], PAGES)))).count() == 0


def one(k, html=b"<p>payload</p>" * 20):
    return warc.page_record(k, f"http://x.example/{k}", html, hashlib.sha256(html).hexdigest(), None)


def test_warc_faults():
    good = [one(k) for k in range(3)]
    read = lambda raw: [(r.get("page_id"), r["fault"]) for r in warc.read_stream(io.BytesIO(raw))]
    assert read(b"".join(good)) == [(0, None), (1, None), (2, None)]
    broken = bytearray(good[1])
    broken[len(broken) // 2] ^= 0xFF
    got = read(good[0] + bytes(broken) + good[2])
    assert got[0] == (0, None) and got[-1] == (2, None) and all(f for _, f in got[1:-1]) and len(got) >= 3
    assert read(good[0] + good[1][:-30])[-1] == (None, "cut")
    wrong = warc.page_record(7, None, b"other bytes", hashlib.sha256(b"some bytes").hexdigest(), None)
    assert read(wrong + good[2]) == [(7, "payload digest"), (2, None)]
    plain = zlib.decompress(good[0], 31)
    pack = lambda raw: gzip.compress(raw)
    assert read(pack(plain.replace(b"payload</p>", b"peyload</p>")) + good[2]) == [(0, "block digest"), (2, None)]
    assert read(pack(plain.replace(b"Content-Length: 3", b"Content-Length: 93", 1)))[0][1] == "short"
    assert read(pack(plain.replace(b"WARC/1.1", b"HTTP/1.1", 1)) + good[1]) == [(None, "version"), (1, None)]
    assert read(b"") == [] and read(b"not an archive")[0][1] == "gzip"


def test_warc_other_writers():
    """A record with SHA-1 digests in base 32, lower-case names and a folded line, read in small blocks."""
    import base64

    body = b"HTTP/1.0 200 OK\r\nX: 1\r\n\r\nhello"
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    raw = gzip.compress((f"WARC/1.0\r\nwarc-type: response\r\nwarc-target-uri: http://o.example\r\ncontent-type: application/http;\r\n msgtype=response\r\nwarc-block-digest: {sha(body)}\r\n"
                         f"warc-payload-digest: {sha(b'hello')}\r\ncontent-length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n")
    members = warc.Members(io.BytesIO(raw * 2), block=7)
    for _ in range(2):
        assert members.begin() is not None
        r = warc.read_record(members, True)
        assert r["fault"] is None and r["payload"] == b"hello" and r["url"] == "http://o.example" and r["content_type"].endswith("msgtype=response")
    assert members.begin() is None


def brute_scores(rows, target, longest, buckets, percent, least):
    words = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in t or "").split(" ")
    words = (lambda f: lambda t: [w for w in f(t) if w])(words)
    grams = lambda w: [" ".join(w[k:k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in texts for g in grams(words(x))) for texts in ([r[1] for r in rows], target))
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets))))
    out = []
    for d, x in rows:
        w = words(x)
        g = [gain(bucket(f)) for f in grams(w)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(w), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[5] = k + 1
    return [tuple(r) for r in out]


@pytest.mark.parametrize("longest, percent", [(1, 10), (3, 50), (2, 100)])
def test_resampling(spark, longest, percent):
    rnd = random.Random(6)
    say = lambda n: " ".join(rnd.choice(["Éa", "word", "Other", "x1", "q-r", "t u", "tab\tnew"]) + str(int(30 * rnd.random() ** 3)) for _ in range(n))
    rows = [(k, say(rnd.randrange(0, 60))) for k in range(200)] + [(500, None), (501, ""), (502, " ,. "), (None, say(40)), (None, say(30)), (503, say(20_000)), (7, say(30))]
    rows += [(600, say(25))] * 40  # one row many times
    target = [say(15) for _ in range(9)] + [None, ""]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumns({c: F.lit("x") for c in ("score", "rank", "copies", "bucket")})
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, bench, percent, 20, longest, 97).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert Counter(map(tuple, got)) == Counter(brute_scores(rows, target, longest, 97, percent, 20))


def test_resampling_odd(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    few = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    assert resampling.resample(none, none).count() == 0
    got = resampling.resample(few, none)
    assert {r["doc_id"]: r["rank"] for r in got.collect()} == {1: None, 2: None}
    many = spark.createDataFrame([(k, f"w{k} " * 25) for k in range(50)] + [(None, "w " * 25)], "doc_id long, text string")
    found = resampling.resample(many, few, percent=20)
    assert resampling.drawn(many, found).count() == 10 and found.filter("rank is not null").count() == 10
    assert sorted(r["rank"] for r in found.filter("rank is not null").collect()) == list(range(1, 11))


def test_copies_are_expanded_in_steps(spark, monkeypatch):
    monkeypatch.setattr(resampling, "_STEP", 7)
    rows = spark.createDataFrame([(1, 30, 30, 5, 5)] * 45 + [(2, 30, 30, 4, 4)] * 3 + [(3, 1, 1, 9, 9)], resampling._SCORED)
    got = sorted(r["rank"] for r in resampling.ranked(rows, 100).filter("rank is not null").collect())
    assert got == list(range(1, 49))
    assert [r["rank"] for r in resampling.ranked(rows, 0).collect()] == [None] * 49
