"""Panel candidates: projections, gaps, intervals and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions import colors
from strataframe.operators.features import with_shape


def column_projection(px: DataFrame, white: int = 150) -> DataFrame:
    """Dark pixels of each column."""
    dark = F.when(colors.gray_mean(F.col("r"), F.col("g"), F.col("b")) < white, 1).otherwise(0)
    return px.groupBy("figure_id", "x").agg(F.sum(dark).alias("dark"), F.count(F.lit(1)).alias("h"))


def runs(flags: DataFrame, keys: list[str], at: str, where: Column, least: int) -> DataFrame:
    """Maximal runs of rows that satisfy ``where``, of ``least`` places or more: (keys, lo, hi), hi excluded."""
    island = F.col(at) - F.row_number().over(Window.partitionBy(*keys).orderBy(at))
    out = flags.where(where).withColumn("island", island).groupBy(*keys, "island").agg(F.min(at).alias("lo"), (F.max(at) + 1).alias("hi"))
    return out.where(F.col("hi") - F.col("lo") >= least).drop("island")


def gap_runs(px: DataFrame, ratio: float = 0.5, least: int = 2) -> DataFrame:
    return runs(column_projection(px), ["figure_id"], "x", F.col("dark") < F.col("h") * ratio, least)


def candidates(px: DataFrame, ratio: float = 0.5, least: int = 4) -> DataFrame:
    """Panels between gaps, with the rows that they reach, numbered from the left."""
    wide = runs(column_projection(px), ["figure_id"], "x", F.col("dark") >= F.col("h") * ratio, least)
    p = with_shape(px).withColumn("dark", colors.gray_mean(F.col("r"), F.col("g"), F.col("b")) < 150)
    rows = p.join(wide, "figure_id").where("x >= lo and x < hi and dark").groupBy("figure_id", "lo", "hi", "y", "h", "w").agg(F.count(F.lit(1)).alias("n"))
    ext = rows.where(F.col("n") > 0.1 * (F.col("hi") - F.col("lo"))).groupBy("figure_id", "lo", "hi", "h", "w").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))
    area = (F.col("hi") - F.col("lo")) * (F.col("y1") - F.col("y0"))
    number = F.row_number().over(Window.partitionBy("figure_id").orderBy("lo")) - 1
    return ext.withColumn("area_ratio", F.round(area / (F.col("h") * F.col("w")), 5)).where("area_ratio between 0.02 and 0.95").select("figure_id", number.alias("panel_id"), F.col("lo").alias("x"), F.col("y0").alias("y"), (F.col("hi") - F.col("lo")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), "area_ratio")


def gutter_cells(px: DataFrame) -> DataFrame:
    """Cells between the ends of neighbouring gutters and how dense each is."""
    gaps = gap_runs(px)
    edges = gaps.select("figure_id", F.col("hi").alias("edge")).unionByName(px.select("figure_id").distinct().withColumn("edge", F.lit(0).cast("int"))).distinct()
    cells = edges.select("figure_id", F.col("edge").alias("x0"), F.lead("edge").over(Window.partitionBy("figure_id").orderBy("edge")).alias("x1"))
    cells = cells.join(px.groupBy("figure_id").agg((F.max("x") + 1).alias("w")), "figure_id").select("figure_id", "x0", F.coalesce("x1", "w").alias("x1")).where("x1 > x0")
    proj = column_projection(px)
    out = proj.join(cells, "figure_id").where("x >= x0 and x < x1").groupBy("figure_id", "x0", "x1").agg(F.round(F.sum("dark") / F.sum("h"), 5).alias("density"))
    return out.where("density >= 0.15").withColumn("conf", F.round(F.col("density") * 0.3 + 0.6, 2))


def iou(a: str, b: str) -> Column:
    c = lambda s, k: F.col(f"{s}.{k}")
    iw = F.greatest(F.lit(0), F.least(c(a, "x") + c(a, "w"), c(b, "x") + c(b, "w")) - F.greatest(c(a, "x"), c(b, "x")))
    ih = F.greatest(F.lit(0), F.least(c(a, "y") + c(a, "h"), c(b, "y") + c(b, "h")) - F.greatest(c(a, "y"), c(b, "y")))
    both = iw * ih
    return both / (c(a, "w") * c(a, "h") + c(b, "w") * c(b, "h") - both)


def iou_pairs(boxes: DataFrame, least: float = 0.05) -> DataFrame:
    """Overlapping boxes of a page."""
    a, b = boxes.alias("a"), boxes.alias("b")
    near = (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.box_id") < F.col("b.box_id"))
    return a.join(b, near).select(F.col("a.page_id").alias("page_id"), F.col("a.box_id").alias("a"), F.col("b.box_id").alias("b"), F.round(iou("a", "b"), 5).alias("iou")).where(F.col("iou") >= least)


def suppress(boxes: DataFrame, limit: float = 0.5) -> DataFrame:
    """Non-maximum suppression: boxes by falling confidence, kept if they overlap no kept box of theirs by ``limit``.

    A fold over a page's ordered boxes; a page has few.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("o"), "box_id", "x", "y", "w", "h", "conf")))
    def overlap(p, q):
        iw = F.greatest(F.lit(0), F.least(p.x + p.w, q.x + q.w) - F.greatest(p.x, q.x))
        ih = F.greatest(F.lit(0), F.least(p.y + p.h, q.y + q.h) - F.greatest(p.y, q.y))
        return iw * ih / (p.w * p.h + q.w * q.h - iw * ih)
    g = boxes.groupBy("page_id").agg(order.alias("all"))
    kind = g.schema["all"].dataType.simpleString()
    kept = F.aggregate("all", F.expr(f"cast(array() as {kind})"), lambda acc, p: F.when(F.forall(acc, lambda q: overlap(p, q) < limit), F.concat(acc, F.array(p))).otherwise(acc))
    return g.select("page_id", F.explode(kept).alias("k")).select("page_id", "k.box_id", "k.x", "k.y", "k.w", "k.h", F.col("k.conf").alias("conf"))


def ambiguous(boxes: DataFrame, page_area: int = 700 * 500) -> DataFrame:
    """Pages whose detection needs a second look: one box of low confidence or of nearly the whole page."""
    s = boxes.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.max("conf").alias("conf"), F.max(F.col("w") * F.col("h")).alias("area"))
    return s.select("page_id", "n", (((F.col("n") == 1) & (F.col("conf") < 0.5)) | ((F.col("n") == 1) & (F.col("area") > 0.95 * page_area))).alias("ambiguous"))


def background_type(px: DataFrame, patch: int = 20, shrink: bool = True) -> DataFrame:
    """(figure_id, corner_mean, background, h, w): black, white or the nearer of them, from the corner patches' luma.

    Where patches ``shrink``, they are a quarter of the figure's height and width at most, and white is assumed where that is
    below five; else they are as large in every figure and may meet in a small one.
    """
    p = with_shape(px).withColumn("patch", F.least(F.lit(patch), F.floor(F.col("h") / 4), F.floor(F.col("w") / 4)) if shrink else F.lit(patch))
    corner = ((F.col("y") < F.col("patch")) | (F.col("y") >= F.col("h") - F.col("patch"))) & ((F.col("x") < F.col("patch")) | (F.col("x") >= F.col("w") - F.col("patch")))
    luma = F.when(corner, colors.gray(F.col("r"), F.col("g"), F.col("b")))
    m = p.groupBy("figure_id").agg(F.round(F.avg(luma), 6).alias("corner_mean"), F.first("patch").alias("patch"), F.first("h").alias("h"), F.first("w").alias("w"))
    kind = F.when(F.col("patch") < 5, "white").when(F.col("corner_mean") < 0.35, "black").when(F.col("corner_mean") > 0.65, "white").when(F.col("corner_mean") < 0.5, "black").otherwise("white")
    return m.select("figure_id", "corner_mean", kind.alias("background"), "h", "w")


def merge_overlapping(boxes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Boxes by falling area, ties by id; one that overlaps merged boxes beyond the threshold becomes their common box.

    A fold over a page's boxes, as later boxes are held against merged ones; a page has few.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col("w") * F.col("h")).alias("o"), "box_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))))

    def over(p, q):
        iw, ih = F.least(p.x1, q.x1) - F.greatest(p.x0, q.x0), F.least(p.y1, q.y1) - F.greatest(p.y0, q.y0)
        both = iw * ih
        return (iw > 0) & (ih > 0) & (both > threshold * ((p.x1 - p.x0) * (p.y1 - p.y0) + (q.x1 - q.x0) * (q.y1 - q.y0) - both))

    corners = ("x0", "y0", "x1", "y1")

    def step(acc, p):
        own = F.struct(*[p[c].alias(c) for c in corners])
        hit = F.concat(F.filter(acc, lambda q: over(p, q)), F.array(own))
        side = lambda c: F.transform(hit, lambda q: q[c])
        whole = F.struct(*[(F.array_min if c.endswith("0") else F.array_max)(side(c)).alias(c) for c in corners])
        return F.concat(F.filter(acc, lambda q: ~over(p, q)), F.array(whole))

    none = F.expr("cast(array() as array<struct<x0:bigint,y0:bigint,x1:bigint,y1:bigint>>)")
    m = boxes.groupBy("page_id").agg(order.alias("all")).select("page_id", F.posexplode(F.aggregate("all", none, step)).alias("k", "b"))
    return m.select("page_id", "k", F.col("b.x0").alias("x"), F.col("b.y0").alias("y"), (F.col("b.x1") - F.col("b.x0")).alias("w"), (F.col("b.y1") - F.col("b.y0")).alias("h"))
