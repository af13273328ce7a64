"""Answers of reviewers as tables: parsing, the confidence gate and what follows from a review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The least confidence that is accepted.
MIN_CONFIDENCE = 0.7


def parse(raw: DataFrame, schema: str, least: float = MIN_CONFIDENCE, column: str = "raw") -> DataFrame:
    """The fields of ``schema`` (which has confidence) from JSON answers, and why an answer isn't accepted.

    ``problem`` is schema (no JSON, or a field lacks or has another type), confidence, or null; the
    fields of an answer that isn't accepted are null. The input's other columns stay.
    """
    fields = [f.strip().split(" ", 1)[0] for f in schema.split(",")]
    p = raw.withColumn("_a", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    whole = F.coalesce(F.forall(F.array(*[F.col(f"_a.{f}").isNotNull() for f in fields]), lambda ok: ok), F.lit(False))
    p = p.withColumn("problem", F.when(~whole, "schema").when(F.col("_a.confidence") < least, "confidence"))
    return p.select(*[c for c in raw.columns if c != column], *[F.when(F.col("problem").isNull(), F.col(f"_a.{f}")).alias(f) for f in fields], "problem")


def overview(pages: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    """What follows from a page's review (n_panels, confidence): a page without panels can be mended, low confidence needs a person."""
    none = F.col("n_panels") == 0
    return pages.select(
        "page_id",
        F.when(none, "no_panels_detected").alias("warning"),
        F.col("confidence").alias("score"),
        none.alias("can_auto_fix"),
        F.when(F.col("confidence") >= least, "continue").otherwise("manual_intervention").alias("suggested_action"),
    )
