"""Places and measures named in texts, by token spans and equality joins instead of one pattern per name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.plans.bounded import broadcast_if_small, spread

# Endings a measure's name may take.
ENDINGS = ["", "s", "es", "ing", "ed"]


def words_of(text: Column) -> Column:
    """A word is a run of letters, digits or '_'."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def word_spans(words: Column, max_words: int) -> Column:
    """Every run of 1..max_words words as structs (start, size, words)."""
    n = F.size(words)

    def runs(i: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.least(F.lit(max_words), n - i)),
                           lambda k: F.struct(i.alias("start"), k.alias("size"), F.array_join(F.slice(words, i + 1, k), " ").alias("words")))

    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), runs)))


def places_in_text(docs: DataFrame, doc_id: str, text: str, gazetteer: DataFrame, max_words: int) -> DataFrame:
    """(doc, name, fips, start): names of the gazetteer a text holds, longest first.

    A match inside or overlapping a longer name's match is dropped, as if longer names were blanked first; among equally
    long names the leftmost wins. Names are compared as words with hyphens read as spaces. The gazetteer is broadcast only
    when its size is checked; texts are expanded to spans and joined by equality, then only matches are compared.
    """
    g = gazetteer.select(F.replace("name", F.lit("-"), F.lit(" ")).alias("words"), "name", "fips", F.length("name").alias("chars"))
    split = spread(docs.select(doc_id, text)).select(doc_id, words_of(F.col(text)).alias("_w"))
    spans = split.select(doc_id, F.explode(word_spans(F.col("_w"), max_words)).alias("s")).select(doc_id, "s.start", "s.size", "s.words")
    hits = spans.join(broadcast_if_small(g), "words")
    # one row per document: its few matches, longest first, folded left to right
    h = hits.groupBy(doc_id).agg(F.sort_array(F.collect_list(F.struct((-F.col("chars")).alias("c"), "start", "size", "name", "fips"))).alias("m"))
    free = F.aggregate(
        "m", F.expr("cast(array() as array<struct<c: int, start: int, size: int, name: string, fips: array<string>>>)"),
        lambda acc, x: F.when(F.exists(acc, lambda y: (x["start"] < y["start"] + y["size"]) & (y["start"] < x["start"] + x["size"])), acc)
        .otherwise(F.concat(acc, F.array(F.struct(x["c"].alias("c"), x["start"].alias("start"), x["size"].alias("size"), x["name"].alias("name"), x["fips"].alias("fips"))))))
    return h.select(doc_id, F.explode(free).alias("x")).select(doc_id, "x.name", "x.fips", "x.start")


def measures_in_text(docs: DataFrame, doc_id: str, text: str, names: DataFrame, max_words: int) -> DataFrame:
    """Distinct (doc, metric) whose name, with one of the endings, occurs as whole words (lower case)."""
    n = names.select("metric", F.explode(F.array(*[F.concat(F.lower("name"), F.lit(e)) for e in ENDINGS])).alias("words"))
    split = spread(docs.select(doc_id, F.lower(text).alias("_t"))).select(doc_id, words_of(F.col("_t")).alias("_w"))
    spans = split.select(doc_id, F.explode(word_spans(F.col("_w"), max_words)).alias("s")).select(doc_id, "s.words")
    return spans.join(broadcast_if_small(n), "words").select(doc_id, "metric").distinct()
