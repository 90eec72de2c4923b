"""Cleans a corpus of documents and packs it into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histora.llm import decontamination, jaccard_join, line_dedup, packing, quality
from histora.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects. It is fitted on labelled documents as they were before any stage."""
    model = quality.fit(quality.labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return quality.keep_good(docs.select(*COLUMNS), model)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the boilerplate lines of each source from the texts.

    A page of boilerplate alone is a copy; it stays whole, for the next stage to keep one of each group.
    """
    cleaned = line_dedup.dedup_lines(docs.select(*COLUMNS), "source", keep_bare=True)
    changed = F.col("n_dropped") > 0
    return cleaned.select(
        "doc_id",
        F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest id: five words, similarity of 0.8.

    Rows are judged by their own text, also where ids repeat; rows without a doc_id stay.
    """
    return jaccard_join.one_of_each(docs.select(*COLUMNS), words=5, percent=80)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents contaminated by benchmark items; each row is judged by its own text."""
    return decontamination.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", without_boilerplate),
    ("ngram_jaccard_join", without_near_copies),
    ("benchmark_decontamination", without_benchmarks),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs


#: The classifier, the tokenizer and the packing have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None
