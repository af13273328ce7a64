"""The training-data pipeline: stages that each keep, drop or rewrite documents, ending in packed sequences.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns
of ``documents``; a stage that rewrites a text sets its ``n_chars``. Null texts count as empty,
rows that repeat an id are one document, and an empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm.common import Workspace, table
from strataframe.llm.exact_dedup import exact_groups
from strataframe.llm.ngram_join import ngram_components
from strataframe.llm.packing import pack
from strataframe.llm.quality_model import fit, score
from strataframe.llm.queries import vocabulary
from strataframe.llm.suffix_dedup import suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keeping(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents whose ids are kept, and those without an id."""
    named = docs.join(kept.select("doc_id").distinct(), "doc_id", "left_semi")
    return named.select(COLUMNS).unionByName(docs.where("doc_id is null").select(COLUMNS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more; it learns from labels outside fold 1 of 3."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, carry=COLUMNS).where("score >= 0.5").select(COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return keeping(docs, exact_groups(docs, keep="smallest").where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the one with the smallest id."""
    return keeping(docs, ngram_components(docs, words=5, percent=75).where("doc_id = component_id"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that start in a document of a smaller id too.

    A text that loses all its bytes is dropped with its document; one that was empty stays.
    """
    cut = suffix_dedup(docs, width=50, carry=["lang", "source"])
    cut = cut.where("n_bytes = 0 or n_removed < n_bytes")
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(docs, vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("suffix_array_dedup", repeats),
    ("best_fit_packing", packed),
]

#: Learned scores, components and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
