"""A figure's whole way: panels, their kinds and engines, layers with one retry, properties and grids, and what went amiss.

Each step is a relation keyed by figure and panel; skipped figures and panels leave the flow before
the step that would cost something. Steps that several later ones read are staged.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.operators import detection, engines, features, flow, labels, properties
from strataframe.sources.stages import staged

PANEL = ["figure_id", "panel_id"]


class Results(NamedTuple):
    """The relations that a run gives.

    ``figures``: figure_id, status, reason, n_panels, total_layers, engines, warnings. ``panels``: figure_id,
    panel_id, x, y, w, h, figure_type, engine, retry_from, n_layers, is_target, skipped. ``labels``: figure_id,
    panel_id, y, x, lbl, in the panel's own places. ``layers``: figure_id, panel_id, lbl, name, vp, vs, rho.
    """

    figures: DataFrame
    panels: DataFrame
    labels: DataFrame
    layers: DataFrame


def panels_of(px: DataFrame) -> DataFrame:
    """Each figure's panels, or the whole figure as panel 0; ones below 20 pixels go."""
    found = detection.detect(px)
    size = px.groupBy("figure_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    zero = F.lit(0).cast("int")
    whole = size.join(found, "figure_id", "left_anti").select("figure_id", zero.alias("panel_id"), zero.alias("x"), zero.alias("y"), "w", "h", F.lit(1.0).alias("confidence"))
    return found.unionByName(whole).where("w >= 20 and h >= 20")


def cropped(px: DataFrame, panels: DataFrame) -> DataFrame:
    """The pixels of each panel in its own places; ``figure_id`` is then the text figure#panel, which operators take as any id."""
    b = panels.select("figure_id", "panel_id", F.col("x").alias("x0"), F.col("y").alias("y0"), "w", "h")
    p = px.transform(features.beside, b).where("x >= x0 and x < x0 + w and y >= y0 and y < y0 + h")
    return p.select(F.concat_ws("#", "figure_id", "panel_id").alias("figure_id"), (F.col("y") - F.col("y0")).cast("int").alias("y"), (F.col("x") - F.col("x0")).cast("int").alias("x"), "r", "g", "b")


def keyed(panels: DataFrame) -> DataFrame:
    return panels.withColumn("key", F.concat_ws("#", "figure_id", "panel_id"))


def without_bars(px: DataFrame) -> DataFrame:
    """Panels without the strip that their colour bar takes, in their new places; what is left below 30 pixels goes."""
    p = features.beside(features.with_shape(px), features.colorbar(px).select("figure_id", "strip"))
    size = F.greatest(F.lit(4), F.floor(F.least("h", "w") / 10)).cast("int")
    on = lambda side: F.when(F.col("strip") == side, size).otherwise(0)
    p = p.withColumns({"x0": on("left"), "y0": on("top"), "x1": F.col("w") - on("right"), "y1": F.col("h") - on("bottom")})
    p = p.where("x >= x0 and x < x1 and y >= y0 and y < y1 and x1 - x0 >= 30 and y1 - y0 >= 30")
    return p.select("figure_id", (F.col("y") - F.col("y0")).cast("int").alias("y"), (F.col("x") - F.col("x0")).cast("int").alias("x"), "r", "g", "b")


def targets_of(panels: DataFrame, scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """(figure_id, panel_id, warning): of figures with a wanted panel (figure_id, target) that one, else the most complex.

    ``scores`` has figure_id, panel_id, complexity. Figures that aren't in ``wanted``, or want a negative one, have no target.
    """
    p = panels.join(wanted.where("target >= 0"), "figure_id").join(scores, PANEL, "left")
    g = p.groupBy("figure_id").agg(F.first("target").alias("target"), F.max((F.col("panel_id") == F.col("target"))).alias("found"), F.max_by("panel_id", F.struct(F.coalesce("complexity", F.lit(0.0)), -F.col("panel_id"))).alias("best"))
    text = F.format_string("target_panel_fallback: requested_%d_not_found, using_panel_%d", "target", "best")
    return g.select("figure_id", F.when(F.col("found"), F.col("target")).otherwise(F.col("best")).cast("int").alias("panel_id"), F.when(~F.col("found"), text).alias("warning"))


def layers_found(lb: DataFrame) -> DataFrame:
    return lb.groupBy("figure_id").agg(F.count_distinct(F.when(F.col("lbl") != 0, F.col("lbl"))).alias("n_layers"))


def run(px: DataFrame, reviews: DataFrame | None = None, wanted: DataFrame | None = None, **limits: int) -> Results:
    """All figures of ``px`` (figure_id, y, x, r, g, b) through the flow; see Results.

    ``reviews`` and ``limits`` are those of ``flow.gate``; ``wanted`` (figure_id, target) names the panel of
    a figure that counts. A panel with fewer than two layers is tried once more by the engine that
    follows its own, and keeps the better of both. A figure or panel whose engine fails gets the
    baseline's layers, or none with a warning; it never stops the others.
    """
    px = px.select("figure_id", "y", "x", "r", "g", "b")
    row = staged(features.features_of(engines.figure_means(px)), "flow-rows")
    kinds = features.classify(row).select("figure_id", "figure_type")
    gate = staged(flow.gate(row.select("figure_id", "w", "h").join(kinds, "figure_id"), reviews, **limits), "flow-gate")
    ready = features.beside(px, gate.where("status = 'ready'").select("figure_id"), "left_semi")
    panels = staged(panels_of(ready), "flow-panels")
    own = staged(cropped(ready, panels), "flow-crops")
    facts = staged(features.features_of(engines.figure_means(own)), "flow-features")
    every = keyed(panels).join(features.complexity(facts).withColumnRenamed("figure_id", "key"), "key", "left")
    target = targets_of(panels, every.select(*PANEL, "complexity"), wanted) if wanted is not None else panels.sparkSession.createDataFrame([], f"figure_id {panels.schema['figure_id'].dataType.simpleString()}, panel_id int, warning string")
    count = F.count(F.lit(1)).over(Window.partitionBy("figure_id"))
    every = every.join(target.select("figure_id", F.col("panel_id").alias("target"), "warning"), "figure_id", "left").withColumn("count", count)
    every = every.withColumn("is_target", F.col("target").isNull() | (F.col("target") == F.col("panel_id")) | (F.col("count") == 1))
    every = every.join(features.classify(facts).select(F.col("figure_id").alias("key"), "figure_type"), "key", "left")
    every = staged(every, "flow-every")

    todo = features.beside(own, every.where("is_target").select(F.col("key").alias("figure_id")), "left_semi")
    body = staged(without_bars(todo), "flow-bodies")
    # Pixels of a stage are few bytes on disk: unless the joins name the side to hash, they might be broadcast.
    means = staged(engines.figure_means(body), "flow-means")
    routed = staged(features.route(features.features_of(means), engines.hashes(means)), "flow-routes")
    first = staged(engines.segment_by(features.beside(body, routed)).transform(features.beside, routed), "flow-first")
    made = layers_found(first)
    again = features.retry_engine(routed, made).where("retry_engine is not null").select("figure_id", F.col("retry_engine").alias("engine"), F.col("engine").alias("retry_from"))
    again = staged(again, "flow-retries")
    second = staged(engines.segment_by(features.beside(body, again.select("figure_id", "engine"))).transform(features.beside, again), "flow-second")
    better = layers_found(second).withColumnRenamed("n_layers", "now").join(made, "figure_id").where("now > n_layers").select("figure_id")
    columns = ["figure_id", "y", "x", "lbl", "engine", "retry_from", "error", "failed"]
    final = first.withColumn("retry_from", F.lit(None).cast("string")).transform(features.beside, better, "left_anti").select(columns).unionByName(features.beside(second, better, "left_semi").select(columns))
    final = staged(final, "flow-labels")

    said = final.groupBy("figure_id").agg(F.first("engine").alias("engine"), F.first("retry_from").alias("retry_from"), F.max("error").alias("error"), F.max("failed").alias("failed"), F.count_distinct(F.when(F.col("lbl") != 0, F.col("lbl"))).alias("n_layers"))
    p = every.join(said.withColumnRenamed("figure_id", "key"), "key", "left")
    name = F.concat(F.lit("panel_"), F.col("panel_id").cast("string"))
    few = F.col("n_layers")
    warning = (
        F.when(~F.col("is_target"), F.concat(name, F.format_string("_skipped_non_target: target_id=%d", "target")))
        .when(F.col("engine").isNull(), F.concat(name, F.lit("_too_small_after_colorbar_crop")))
        .when(F.col("error").isNotNull(), F.concat(name, F.lit("_engine_failed: "), "error"))
        .when(few == 0, F.concat(name, F.lit("_empty_segmentation: no_layers_found")))
        .when(few < 2, F.concat(name, F.lit("_under_segmented: only_1_layer(s)"), F.when(F.col("retry_from").isNotNull(), "_after_retry").otherwise("")))
        .when(F.col("retry_from").isNotNull(), F.concat(name, F.lit("_retry_fixed: "), "retry_from", F.lit("_to_"), "engine", F.format_string("_now_%d_layers", few)))
    )
    skipped = F.when(~F.col("is_target"), "non_target_panel").when(F.col("engine").isNull(), "too_small")
    p = staged(p.select(*PANEL, "key", "x", "y", "w", "h", "figure_type", "engine", "retry_from", F.coalesce("n_layers", F.lit(0)).alias("n_layers"), "is_target", skipped.alias("skipped"), "warning", F.when(F.col("is_target"), warning).otherwise(warning).alias("said")), "flow-results")
    notes = F.array_sort(F.collect_list(F.struct("panel_id", "said")))
    total = p.groupBy("figure_id").agg(F.count(F.lit(1)).alias("n_panels"), F.sum("n_layers").alias("total_layers"), F.sort_array(F.collect_set("engine")).alias("engines"), F.first("warning", ignorenulls=True).alias("warning"), notes.alias("notes"))
    warnings = F.array_compact(F.concat(F.array("warning"), F.transform("notes", lambda n: n.said)))
    figures = gate.join(total, "figure_id", "left").select(
        "figure_id", F.when(F.col("status") == "skipped", "skipped").otherwise("ok").alias("status"), "reason", F.coalesce("n_panels", F.lit(0)).alias("n_panels"),
        F.coalesce("total_layers", F.lit(0)).alias("total_layers"), F.coalesce("engines", F.expr("cast(array() as array<string>)")).alias("engines"), F.coalesce(warnings, F.expr("cast(array() as array<string>)")).alias("warnings"),
    )
    ids = p.select("key", *PANEL)
    lb = final.where("not failed").select(F.col("figure_id").alias("key"), "y", "x", "lbl").join(ids.hint("shuffle_hash"), "key").select(*PANEL, "y", "x", "lbl")
    return Results(figures, p.drop("key", "warning", "said"), lb, layer_properties(lb))


def layer_properties(lb: DataFrame) -> DataFrame:
    """(figure_id, panel_id, lbl, name, vp, vs, rho): a property ramp over a panel's layers, named by their number."""
    n = lb.where("lbl <> 0").select(*PANEL, "lbl").distinct()
    n = n.select(F.struct(*PANEL).alias("figure_id"), F.col("lbl").alias("ord"), F.concat(F.lit("layer_"), F.col("lbl").cast("string")).alias("name"))
    return properties.ramp(n).select("figure_id.*", F.col("ord").alias("lbl"), "name", "vp", "vs", "rho")


def grid_of(results: Results) -> DataFrame:
    """(figure_id, panel_id, z, x, vp, vs, rho): the property grid of each panel, for the writers of model files."""
    lb = results.labels.select(F.struct(*PANEL).alias("figure_id"), "y", "x", "lbl")
    layers = results.layers.select(F.struct(*PANEL).alias("figure_id"), "lbl", "vp", "vs", "rho")
    return properties.grids(lb, layers).select("figure_id.*", "z", "x", "vp", "vs", "rho")


def metrics(results: Results) -> DataFrame:
    """Consistency of each panel's labels, beside what ``panels`` says of it."""
    lb = results.labels.select(F.struct(*PANEL).alias("figure_id"), "y", "x", "lbl")
    return labels.consistency(lb).select("figure_id.*", "consistency")
