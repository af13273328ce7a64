"""A figure's way through the engine as a DataFrame flow: what is skipped and why, and what the rest gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.operators import engines, features, labels

# The least size of a figure that is worth cutting up, and the kinds that a review lets through.
MIN_W, MIN_H = 300, 200
MODELS = ("velocity_model", "geological_cross_section")
#: Kinds that are skipped where no review has been made.
REJECTED = ("observational", "observational_data", "other")


def gate(figures: DataFrame, reviews: DataFrame | None = None, min_w: int = MIN_W, min_h: int = MIN_H, rejected: tuple[str, ...] = REJECTED) -> DataFrame:
    """(figure_id, status, reason): ready, or skipped by size, by a review, or by the figure's kind.

    ``figures`` has figure_id, w, h and figure_type; ``reviews`` figure_id, kind and recommendation. A
    figure without a review (it failed, or none are given) is judged by its own kind. The texts of
    reasons are fixed values.
    """
    small = (F.col("w") < min_w) | (F.col("h") < min_h)
    too_small = F.format_string(f"too_small_for_auto_segmentation (%dx%d < {min_w}x{min_h})", "w", "h")
    by_kind = F.when(F.col("figure_type").isin(*rejected), F.concat(F.lit("figure_type="), "figure_type"))
    f = figures
    if reviews is not None:
        f = figures.join(reviews.select("figure_id", "kind", "recommendation", F.lit(True).alias("reviewed")), "figure_id", "left")
        says = F.col("recommendation")
        by_kind = (
            F.when(F.col("reviewed").isNull(), by_kind)
            .when(says == "skip", F.concat(F.lit("vlm_recommended_skip: "), "kind"))
            .when(says == "manual_review", F.concat(F.lit("vlm_recommended_manual_review: "), "kind"))
            .when(says.isNull() & ~F.col("kind").isin(*MODELS), F.concat(F.lit("vlm_rejected: "), "kind"))
        )
    reason = F.when(small, too_small).otherwise(by_kind)
    return f.select("figure_id", F.when(reason.isNull(), "ready").otherwise("skipped").alias("status"), reason.alias("reason"))


def process(px: DataFrame, reviews: DataFrame | None = None, **limits: int) -> DataFrame:
    """A row per figure: status (ok, skipped, error), reason, engine, layers found and how well they follow edges.

    Skipped figures never reach an engine. Where an engine fails the
    baseline stands in, with the reason; where that fails too, it is its own figure's error.
    """
    row = features.feature_row(px)
    kinds = features.classify(row).select("figure_id", "figure_type")
    passed = gate(row.select("figure_id", "w", "h").join(kinds, "figure_id"), reviews, **limits)
    todo = features.route(row, features.panel_hash(px)).join(passed.where("status = 'ready'").select("figure_id"), "figure_id", "left_semi")
    lb = engines.segment_by(px.join(todo, "figure_id"))
    bad = lb.where("error is not null").groupBy("figure_id").agg(F.first("error").alias("error"), F.max("failed").alias("failed"))
    good = px.join(lb.where("not failed").select("figure_id", "y", "x", (F.col("lbl") + 1).alias("lbl")), ["figure_id", "y", "x"])
    found = labels.n_layers(good).join(labels.boundary_alignment(good), "figure_id")
    out = passed.join(todo, "figure_id", "left").join(found, "figure_id", "left").join(bad, "figure_id", "left")
    status = F.when(F.col("status") == "skipped", "skipped").when(F.col("error").isNotNull(), "error").otherwise("ok")
    return out.select("figure_id", status.alias("status"), F.coalesce("reason", "error").alias("reason"), "engine", "n_layers", "boundary_alignment")


def metrics(lb: DataFrame) -> DataFrame:
    """All figures of a label map in one row: layers, alignment, small fragments and suspect regions. Facts, no overall score."""
    small = engines.fragments(engines.parts(lb, eight=True)).where("lbl <> 0").groupBy("figure_id").agg(F.count(F.lit(1)).alias("fragments"), F.sum("fraction").alias("share"))
    noise = labels.noise_regions(lb).groupBy("figure_id").agg(F.count(F.lit(1)).alias("suspects"))
    out = labels.n_layers(lb).join(labels.boundary_alignment(lb), "figure_id").join(small, "figure_id", "left").join(noise, "figure_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "figure_id", "n_layers", F.round("boundary_alignment", 4).alias("boundary_alignment"), n("fragments").alias("tiny_fragments"), n("suspects").alias("noise_regions"),
        (n("fragments") > 0).alias("has_tiny_fragments"), (n("suspects") > 0).alias("has_noise"), F.round(n("share"), 5).alias("fragment_fraction"),
    )
