"""Training-corpus pipeline: language ID, near-duplicates, benchmark decontamination, personal data, packing.

Each stage is (name, function of (spark, docs, sf_dir)); ``run`` writes a stage's result as Parquet to the shared folder and reads it as the next
one's documents. All stages but the last return the columns of ``documents``, extra ones included. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm import decontamination, langid, packing, pii, simhash
from gossamer.llm.common import identified, table
from gossamer.session import checkpointed, shared_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: a null, empty or letterless text goes, as does one where no language has three tenths of the letters. Texts in two or three
    languages stay."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    found = langid.identify(docs, langid.fit(labelled))
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.3)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word similarity of 0.8 and more, see ``simhash.similar``) the document with the least doc_id stays, once if its row is repeated.
    Rows that share a doc_id but not a text are different documents; one without a doc_id comes after all others."""
    keyed = identified(docs, "_gs_doc")
    classes = simhash.similar(keyed.select(F.col("_gs_doc").alias("doc_id"), "text"))
    stay = checkpointed(classes.filter("doc_id = component_id").groupBy(F.col("doc_id").alias("_gs_doc")).agg(F.count(F.lit(1)).alias("_gs_n")))
    kept = keyed.join(stay.select("_gs_doc"), "_gs_doc", "left_semi")
    if not stay.filter("_gs_n > 1").isEmpty():
        kept = kept.dropDuplicates(["_gs_doc"])
    return kept.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), ["text"])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms, and n_chars of the new text."""
    found = pii.pseudonymised(docs)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in training sequences."""
    return packing.best_fit(packing.word_lengths(docs))


STAGES = [("language ID", language), ("SimHash near-duplicates", near_duplicates), ("benchmark decontamination", decontaminate), ("personal data", personal_data), ("packing", pack)]

# Language ID and packing are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            folder = shared_path(spark, f"stage{k + 1}")
            docs.write.parquet(folder)
            docs = spark.read.schema(docs.schema).parquet(folder)
    return docs
