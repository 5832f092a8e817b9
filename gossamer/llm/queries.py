"""The corpus operators over their whole tables, one query each, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm import chunks, decontamination, langid, packing, pii, quality, repeats, resampling, simhash, suffixtree, urlfilter, vectorcodes, warc
from gossamer.llm.common import is_held_out, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents"), with_text=False)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = is_held_out(F.col("doc_id"), 3, 1)
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs.filter(~held)))
    return found.select("row.doc_id", is_held_out(F.col("row.doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["text"]))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(packing.word_lengths(table(spark, sf_dir, "documents")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.counted(pii.pseudonymised(table(spark, sf_dir, "documents")))


def op8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffixtree.score(docs, docs.filter(~is_held_out(F.col("doc_id"), 7, 2)))
    return found.select("doc_id", is_held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.without_repeats(table(spark, sf_dir, "documents")))


def op10_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.digest(chunks.without_repeated_chunks(table(spark, sf_dir, "documents")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.digest(*vectorcodes.compress(table(spark, sf_dir, "embeddings")))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"))))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


QUERIES = {
    "op11_vector_codes": op11_vector_codes, "op12_warc": op12_warc, "op13_resampling": op13_resampling,
    "op10_chunks": op10_chunks,
    "op7_pii": op7_pii, "op8_scores": op8_scores, "op9_repeats": op9_repeats,
    "op1_quality": op1_quality, "op2_language": op2_language, "op3_simhash": op3_simhash, "op4_urls": op4_urls, "op5_decontamination": op5_decontamination, "op6_packing": op6_packing,
}
_WORD = r"[^\x20\x09-\x0D]+"
_SEPARATORS = ", ".join(f"'{c}'" for c in quality.SEPARATORS)
OP1 = rf"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{_WORD}') AS w FROM t),
    grams AS (SELECT r, i, w[i:i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) x(i)),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
    rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest(range(3)) y(k) GROUP BY 1),
    lines AS (SELECT r, line, regexp_extract_all(line, '{_WORD}') AS own FROM t, unnest(string_split(text, chr(10))) z(line)),
    judged AS (SELECT r, line, length(line) AS chars, len(regexp_extract_all(line, '{quality.NOISE}')) > 0.3::DOUBLE * len(own) OR NOT regexp_matches(line, '[\p{{L}}\p{{N}}]')
        OR len(list_filter(own, lambda x: x IN ({_SEPARATORS}))) > 0.3::DOUBLE * len(own) OR (len(own) <= 40 AND regexp_matches(line, '(?i){quality.FURNITURE}')) AS bad FROM lines WHERE len(own) > 0),
    l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (NOT bad) AS n_kept, coalesce(sum(chars) FILTER (bad), 0)::DOUBLE AS lost, sum(chars)::DOUBLE AS chars FROM judged GROUP BY 1),
    f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
      coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_kept, 0) AS n_kept_lines, coalesce(lost / nullif(chars, 0), 0) AS lost_share
      FROM w LEFT JOIN rep USING (r) LEFT JOIN l USING (r))
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_share <= 0.5 AS kept FROM f"""

_LAST = lambda n: f"array_to_string(string_split(host, '.')[-{n}:], '.')"
_STRENGTH = "(SELECT CASE WHEN whole IS NULL OR whole = 0 OR over IS NULL OR over <= 0 THEN 1000.0 ELSE least(greatest(whole / over - 1, 1.0), 1000.0) END FROM (SELECT sum(pow(bad - n * m, 2) - n * m * (1 - m)) AS over, sum(n * (n - 1) * m * (1 - m)) AS whole FROM {t}))"  # noqa: E501
_RULES = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(urlfilter.RULES, key=lambda r: (-len(r[1] + r[2]), r)))
_ACTIONS = " ".join(f"WHEN '{h}{p}' THEN '{a}'" for a, h, p in urlfilter.RULES)
_UPPER, _LOWER = urlfilter.UPPER, urlfilter.LOWER
OP4 = rf"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
    p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
    o AS (SELECT doc_id AS page_id, max(CASE WHEN coalesce(quality = 0, false) OR coalesce(toxic = 1, false) THEN 1 ELSE 0 END) AS bad FROM labels WHERE coalesce(quality, toxic) IS NOT NULL GROUP BY 1),
    h AS (SELECT host, count(o.bad)::DOUBLE AS n, coalesce(sum(o.bad), 0)::DOUBLE AS bad, CASE WHEN regexp_matches(host, '(^|\.)[a-z]{{2,3}}\.[a-z]{{2}}$') THEN {_LAST(3)} ELSE {_LAST(2)} END AS domain, {_LAST(1)} AS suffix
      FROM p LEFT JOIN o USING (page_id) GROUP BY host),
    d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2),
    s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) FROM d) AS m FROM d GROUP BY 1),
    s2 AS (SELECT suffix, (k * m + bad) / (k + n) AS m FROM s, (SELECT {_STRENGTH.format(t='s')} AS k)),
    d1 AS (SELECT d.*, s2.m FROM d JOIN s2 USING (suffix)), d2 AS (SELECT domain, (k * m + bad) / (k + n) AS m FROM d1, (SELECT {_STRENGTH.format(t='d1')} AS k)),
    h1 AS (SELECT h.*, d2.m FROM h JOIN d2 USING (domain)),
    h2 AS (SELECT host, n, (k * m + bad) / (n + k) AS mean, n + k AS total FROM h1, (SELECT {_STRENGTH.format(t='h1')} AS k)),
    j AS (SELECT *, mean - {urlfilter.Z}::DOUBLE * sqrt(mean * (1 - mean) / (total + 1)) AS lower FROM h2),
    r AS (SELECT *, CASE {_RULES} END AS rule FROM p JOIN j USING (host))
    SELECT page_id, host, path, rule, CASE rule {_ACTIONS} ELSE CASE WHEN lower > {urlfilter.THRESHOLD}::DOUBLE THEN 'block' ELSE 'allow' END END AS verdict, n::BIGINT AS n_labelled,
      round(mean, 6) AS bad_share, round(lower, 6) AS bad_lower FROM r"""

_SPLIT = "regexp_extract_all(translate({t}, '" + _UPPER + "', '" + _LOWER + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT.format(t="coalesce(text, '')")} AS w FROM documents),
    i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SPLIT.format(t='text')} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
    win AS (SELECT DISTINCT item, array_to_string(w[p:p + 9], ' ') AS g, least(len(w), 10) AS n FROM i, unnest(range(1, greatest(len(w) - 8, 2))) x(p) WHERE len(w) > 0),
    pos AS (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM win) y, unnest(range(1, len(w) - n + 2)) x(p)),
    hit AS (SELECT pos.r, pos.p, pos.n, win.item FROM pos JOIN win USING (g, n)),
    c AS (SELECT r, count(DISTINCT p + k) AS n_hit FROM (SELECT DISTINCT r, p, n FROM hit), unnest(range(n)) z(k) GROUP BY 1),
    it AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c USING (r) LEFT JOIN it USING (r)"""

_P, _E = vectorcodes.PARTS, vectorcodes.ENTRIES
_ASSIGN = "SELECT r, pos, arg_min(e, far * 1000 + e) AS e, min(far) AS far FROM (SELECT r, p.pos, b.e, list_sum(list_transform(list_zip(p.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far FROM p JOIN {b} b USING (pos)) GROUP BY 1, 2"
_UPDATE = """SELECT pos, e, coalesce(n.c, o.c) AS c FROM {b} o LEFT JOIN (SELECT pos, e, list(m ORDER BY d) AS c FROM (SELECT pos, e, d, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM {a} JOIN p USING (r, pos), unnest(p.v) WITH ORDINALITY u(x, d) GROUP BY 1, 2, 3) GROUP BY 1, 2) n USING (pos, e)"""
OP11 = f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS (SELECT r, pos, v[pos * len(v) // {_P} + 1:(pos + 1) * len(v) // {_P}] AS v FROM k, unnest(range({_P})) x(pos)),
    b0 AS (SELECT pos, r - 1 AS e, v AS c FROM p WHERE r <= {_E}),
    a0 AS MATERIALIZED ({_ASSIGN.format(b="b0")}), b1 AS MATERIALIZED ({_UPDATE.format(b="b0", a="a0")}), a1 AS MATERIALIZED ({_ASSIGN.format(b="b1")}), b2 AS MATERIALIZED ({_UPDATE.format(b="b1", a="a1")}),
    a2 AS ({_ASSIGN.format(b="b2")}),
    o AS (SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY pos) AS code, sum(far)::BIGINT AS error FROM a2 GROUP BY 1)
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, sha256((SELECT string_agg(array_to_string(c, ','), ',' ORDER BY pos, e) FROM b2)) AS codebooks_sha256 FROM o JOIN k USING (r)"""

OP12 = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
    t AS (SELECT *, CASE WHEN n >= {warc.LEAST_REVISIT} THEN min(page_id) OVER (PARTITION BY d) END AS f FROM p)
    SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN f IS DISTINCT FROM page_id AND f IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN f IS DISTINCT FROM page_id THEN f END AS refers_to, NULL::VARCHAR AS fault FROM t"""

# crc32 bit by bit, as a fold over a word's bytes.
_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_N = resampling.BUCKETS
OP13 = f"""WITH RECURSIVE bits AS (SELECT i AS b, 0 AS k, i::BIGINT AS c FROM range(256) x(i) UNION ALL SELECT b, k + 1, {_STEP} FROM bits WHERE k < 8),
    crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
    d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT.format(t="coalesce(text, '')")} AS w FROM documents),
    dw AS (SELECT r, unnest(w) AS w FROM d), tw AS (SELECT unnest({_SPLIT.format(t="coalesce(text, '')")}) AS w FROM benchmark),
    v AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT)),
      lambda a, x: xor(a >> 8, crc.t[(xor(a, x) & 255) + 1])), 4294967295) % {_N} AS b FROM (SELECT w FROM dw UNION SELECT w FROM tw), crc),
    s AS (SELECT b, count(*) AS n FROM dw JOIN v USING (w) GROUP BY 1), t AS (SELECT b, count(*) AS n FROM tw JOIN v USING (w) GROUP BY 1),
    g AS (SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {_N}) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM tw) + {_N}))))::BIGINT AS gain
      FROM (SELECT DISTINCT b FROM v) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
    m AS (SELECT r, sum(gain) AS total, count(*) AS n FROM dw JOIN v USING (w) JOIN g USING (b) GROUP BY 1),
    f AS (SELECT r, doc_id, len(w)::BIGINT AS n, CASE WHEN len(w) = 0 THEN 0 ELSE ((total - ((total % m.n) + m.n) % m.n) // m.n)::BIGINT END AS weight,
      floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise FROM d LEFT JOIN m USING (r)),
    o AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n >= {resampling.LEAST_WORDS} ORDER BY weight + noise DESC, doc_id NULLS LAST, n) AS place,
      count(*) FILTER (n >= {resampling.LEAST_WORDS}) OVER () AS whole FROM f)
    SELECT doc_id, n AS n_features, weight, score, CASE WHEN n >= {resampling.LEAST_WORDS} AND place <= {resampling.PERCENT} * whole // 100 THEN place END AS rank, n AS n_words FROM o"""

SQL: dict[str, str] = {"op11_vector_codes": OP11, "op12_warc": OP12, "op13_resampling": OP13, "op1_quality": OP1, "op4_urls": OP4, "op5_decontamination": OP5}
