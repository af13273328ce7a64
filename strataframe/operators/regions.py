"""Regions of label maps: what they measure together, and how a user merges one into another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.operators import engines, labels, shapes


def region_stats(lb: DataFrame) -> DataFrame:
    """(figure_id, lbl, area, fraction, n_components, x, y, w, h) of each label but 0; parts hang together over corners too."""
    n = engines.parts(lb.where("lbl <> 0"), eight=True).groupBy("figure_id", "lbl").agg(F.count(F.lit(1)).alias("n_components"))
    s = labels.region_stats(lb).join(n, ["figure_id", "lbl"])
    return s.select("figure_id", "lbl", "area", "fraction", "n_components", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0") + 1).alias("w"), (F.col("y1") - F.col("y0") + 1).alias("h"))


def compute_all(lb: DataFrame) -> DataFrame:
    """A row per figure: n_layers, boundary_alignment, the lists fragments, suspects and stats, and their short forms.

    ``lb`` has r, g, b beside its labels. Facts, no overall score: small fragments and suspects may be right.
    """
    plain = lb.select("figure_id", "y", "x", "lbl")
    rows = lambda df, *c: df.groupBy("figure_id").agg(F.array_sort(F.collect_list(F.struct(*c))).alias("all"))
    small = rows(engines.fragments(engines.parts(plain, eight=True)), "lbl", "part", "area", "fraction").withColumnRenamed("all", "fragments")
    noise = rows(labels.noise_regions(plain), "lbl", "noise", "aspect", "fraction").withColumnRenamed("all", "suspects")
    stats = rows(region_stats(plain), "lbl", "area", "fraction", "n_components", "x", "y", "w", "h").withColumnRenamed("all", "stats")
    out = labels.n_layers(plain).join(labels.boundary_alignment(lb), "figure_id", "left")
    for df in (small, noise, stats):
        out = out.join(df, "figure_id", "left")
    n = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    share = F.coalesce(F.aggregate("fragments", F.lit(0.0), lambda a, f: a + f.fraction), F.lit(0.0))
    return out.select("figure_id", "n_layers", F.round(F.coalesce("boundary_alignment", F.lit(0.0)), 4).alias("boundary_alignment"), "fragments", "suspects", "stats", (n("fragments") > 0).alias("has_fragments"), (n("suspects") > 0).alias("has_suspects"), F.round(share, 5).alias("fragment_fraction"))


def _encloses(points: Column, x: Column, y: Column) -> Column:
    """Whether a closed ring goes around a point, by the crossings of a ray to the right."""

    def crosses(k: Column) -> Column:
        a, b = F.get(points, k), F.get(points, k + 1)
        at = a.x + (y - a.y) * (b.x - a.x) / F.when(b.y == a.y, 1).otherwise(b.y - a.y)
        return ((a.y > y) != (b.y > y)) & (x < at)

    return F.aggregate(F.sequence(F.lit(0), F.size(points) - 2), F.lit(False), lambda inside, k: inside != crosses(k))


def drop_targets(lb: DataFrame, drops: DataFrame, share: float = 0.01) -> DataFrame:
    """(figure_id, ord, lbl, x, y, target): into which layer a user who drops a part at (x, y) merges it.

    ``drops`` has figure_id, ord, lbl (the part's layer), x and y. The target is the layer of the large region
    (``share`` of the figure) around the place, the smallest of several; drops on none, or on their own layer, go.
    """
    r = shapes.rings(lb)
    total = lb.groupBy("figure_id").agg(F.count(F.lit(1)).alias("total"))
    size = r.groupBy("figure_id", "lbl", "part").agg(F.sum("area").alias("pixels"))
    big = r.where("area > 0").join(size, ["figure_id", "lbl", "part"]).join(total, "figure_id").where(F.col("pixels") >= F.floor(F.col("total") * share))
    d = drops.select("figure_id", "ord", F.col("lbl").alias("own"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    hit = d.join(big, "figure_id").where(_encloses(F.col("points"), F.col("px") + 0.5, F.col("py") + 0.5))
    best = hit.groupBy("figure_id", "ord", "own", "px", "py").agg(F.min_by("lbl", F.struct("area", "lbl", "part")).alias("target")).where("target <> own")
    return best.select("figure_id", "ord", F.col("own").alias("lbl"), F.col("px").alias("x"), F.col("py").alias("y"), "target")


def reassign(lb: DataFrame, moves: DataFrame) -> DataFrame:
    """The label map after moves (figure_id, ord, lbl, x, y, target): of layer ``lbl`` the part whose middle is nearest gets the target.

    Several moves of one part: the last one counts. A move never splits a part, and parts are those of the given map.
    """
    p = shapes.parts_of(lb)
    middle = p.groupBy("figure_id", "lbl", "part").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    m = moves.join(middle, ["figure_id", "lbl"]).withColumn("d", (F.col("cx") - F.col("x")) ** 2 + (F.col("cy") - F.col("y")) ** 2)
    m = m.withColumn("near", F.row_number().over(Window.partitionBy("figure_id", "ord").orderBy("d", "part"))).where("near = 1")
    new = m.groupBy("figure_id", "part").agg(F.max_by("target", "ord").alias("target"))
    moved = p.join(new, ["figure_id", "part"]).select("figure_id", "y", "x", "target")
    out = lb.select("figure_id", "y", "x", "lbl").join(moved, ["figure_id", "y", "x"], "left")
    return out.select("figure_id", "y", "x", F.coalesce("target", "lbl").cast("int").alias("lbl"))


def assigned(lb: DataFrame, choices: DataFrame) -> DataFrame:
    """The label map after choices (figure_id, ord, lbl, x, y, target) from a menu: the part under (x, y) gets the target layer."""
    p = shapes.parts_of(lb)
    c = choices.select("figure_id", "ord", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "target")
    new = p.join(c, ["figure_id", "y", "x"]).groupBy("figure_id", "part").agg(F.max_by("target", "ord").alias("target"))
    moved = p.join(new, ["figure_id", "part"]).select("figure_id", "y", "x", "target")
    out = lb.select("figure_id", "y", "x", "lbl").join(moved, ["figure_id", "y", "x"], "left")
    return out.select("figure_id", "y", "x", F.coalesce("target", "lbl").cast("int").alias("lbl"))
