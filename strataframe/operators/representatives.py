"""Representative points and colours of layers: from a colour bar's values, from missing colours, from a scan down the middle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions import colors, curves, kernels
from strataframe.functions import seeds as seeds_
from strataframe.operators import engines, features

LAB = ("lab_l", "lab_a", "lab_b")


def bar_pixels(px: DataFrame) -> DataFrame:
    """(figure_id, strip, at, mid, size, r, g, b): the middle line of each figure's colour bar; ``at`` runs along it.

    Figures without a bar have none. A bar taller than wide runs down, else to the right.
    """
    p = features.with_shape(px).join(features.colorbar(px).where("strip <> 'none'"), "figure_id")
    size = F.greatest(F.lit(4), F.floor(F.least("h", "w") / 10)).cast("int")
    p = p.withColumns({"size": size, "side": F.col("strip").isin("left", "right")})
    oy, ox = F.when(F.col("strip") == "bottom", F.col("h") - F.col("size")).otherwise(0), F.when(F.col("strip") == "right", F.col("w") - F.col("size")).otherwise(0)
    p = p.withColumns({"by": F.col("y") - oy, "bx": F.col("x") - ox, "bh": F.when(F.col("side"), F.col("h")).otherwise(F.col("size")), "bw": F.when(F.col("side"), F.col("size")).otherwise(F.col("w"))})
    down = F.col("bh") >= F.col("bw")
    middle = F.when(down, F.col("bx") == F.floor(F.col("bw") / 2)).otherwise(F.col("by") == F.floor(F.col("bh") / 2))
    p = p.where(middle & F.col("by").between(0, F.col("bh") - 1) & F.col("bx").between(0, F.col("bw") - 1))
    return p.select("figure_id", "strip", F.when(down, F.col("by")).otherwise(F.col("bx")).alias("at"), F.when(down, F.col("bh")).otherwise(F.col("bw")).alias("length"), "r", "g", "b")


def at_values(bar: DataFrame, zones: DataFrame) -> DataFrame:
    """``zones`` (figure_id, color_name, value 0 to 100) with the bar's colour at each value, which spans 5 to 95 % of the bar.

    The place is arithmetic, so that it is an equi-join with the bar's pixels; zones of figures without a bar go.
    """
    length = bar.groupBy("figure_id").agg(F.first("length").alias("length"))
    share = 0.05 + F.greatest(F.lit(0), F.least(F.lit(100), F.col("value"))) / 100.0 * 0.9
    z = zones.join(length, "figure_id").withColumn("at", F.floor(share * (F.col("length") - 1)).cast("int"))
    return z.join(bar.select("figure_id", "at", "r", "g", "b"), ["figure_id", "at"]).select("figure_id", "color_name", "value", "at", "r", "g", "b")


def find_points(px: DataFrame, targets: DataFrame, near: float = 45.0, far: float = 50.0) -> DataFrame:
    """(figure_id, color_name, x, y): where each target (figure_id, ord, color_name, r, g, b) is in its figure.

    The middle of the largest part of its colour that isn't background; targets without one go, and of
    several at one place the first stays.
    """
    wanted = targets.groupBy("figure_id").agg(F.array_sort(F.collect_list(F.struct("ord", "color_name", *[F.col(c).cast("double").alias(c) for c in "rgb"]))).alias("targets"))

    def run(t: pa.Table) -> pa.Table:
        _, _, rgb = engines.panel(t)
        back = background(rgb)
        out, used = [], set()
        for q in t.column("targets")[0].as_py():
            at = seeds_.find_pixel(rgb, np.array([q[c] for c in "rgb"]), back, near, far)
            if at and at not in used:
                used.add(at)
                out.append((q["ord"], q["color_name"], *at))
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table({n: pa.array(v, k) for n, v, k in zip(("ord", "color_name", "x", "y"), cols, (pa.int32(), pa.string(), pa.int32(), pa.int32()), strict=True)})

    p = px.select("figure_id", "y", "x", "r", "g", "b").join(wanted, "figure_id")
    return engines.per_figure(p, run, "ord int, color_name string, x int, y int")


def background(rgb: np.ndarray) -> np.ndarray:
    """The median of the corners and the middle."""
    h, w, _ = rgb.shape
    return np.median([rgb[0, 0], rgb[0, -1], rgb[-1, 0], rgb[-1, -1], rgb[h // 2, w // 2]], axis=0)


def scan(px: DataFrame, layers: int = 5, least: int = 8) -> DataFrame:
    """(figure_id, color_name, x, y): a point in each layer down the middle, between the steps of its LAB colour."""

    def run(t: pa.Table) -> pa.Table:
        _, _, rgb = engines.panel(t)
        h, w, _ = rgb.shape
        mid = rgb[:, [max(0, min(w // 2 + k, w - 1)) for k in (-1, 0, 1)]].mean(1).astype(np.uint8).astype(float)
        soft = kernels.gaussian(engines.lab(mid[:, None])[:, 0], max(1.5, h / 300), axes=(0,))
        step = np.linalg.norm(np.diff(soft, axis=0), axis=1)
        cuts = [0, *steps(step, h, layers, least).tolist(), h - 1]
        thick = max(least, h // 50)
        rows = [(f"layer_{k + 1}", w // 2, (a + b) // 2) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b - a >= thick]
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table({n: pa.array(v, k) for n, v, k in zip(("color_name", "x", "y"), cols, (pa.string(), pa.int32(), pa.int32()), strict=True)})

    return px.select("figure_id", "y", "x", "r", "g", "b").transform(engines.per_figure, run, "color_name string, x int, y int")


def steps(step: np.ndarray, h: int, layers: int, least: int) -> np.ndarray:
    """Places of the steps that part layers. The limits are fixed values: higher ones where most of the column is even."""
    if not len(step):
        return np.zeros(0, int)
    middle, top = float(np.median(step)), float(step.max())
    floor, share = (5.0, 80) if middle < 1.0 else (3.0, 70)
    limit = max(floor, np.percentile(step, share))
    if limit > top:
        limit = max(min(floor, 3.0), top * 0.85, middle * 2.0, 1.5)
    at = curves.local_maxima(step)
    at = at[step[at] >= limit]
    return np.sort(curves.spaced(at, step[at], max(least, h // 50, h // (layers * 2))))


def of_zones(px: DataFrame, zones: DataFrame, layers: int = 5) -> DataFrame:
    """(figure_id, source, color_name, x, y): points of a figure's layers, from the best of three sources.

    The values of its zones on its colour bar, if they find two points (four where as many layers
    are expected); else even samples of the bar, if they find two; else the scan down its middle.
    """
    bar = bar_pixels(px)
    first = at_values(bar, zones).withColumn("ord", F.row_number().over(Window.partitionBy("figure_id").orderBy("value", "color_name")))
    named = find_points(px, first).withColumn("source", F.lit("zones"))
    length = bar.groupBy("figure_id").agg(F.first("length").alias("length"))
    lo, hi = F.floor(F.col("length") * 0.05), F.floor(F.col("length") * 0.95) - 1
    even = length.select("figure_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(layers - 1)), lambda k: F.struct((k + 1).alias("ord"), F.floor(lo + (hi - lo) * k / (layers - 1)).cast("int").alias("at")))).alias("s")).select("figure_id", "s.*")
    even = even.join(bar, ["figure_id", "at"]).select("figure_id", "ord", F.concat(F.lit("layer_"), F.col("ord").cast("string")).alias("color_name"), "r", "g", "b")
    sampled = find_points(px, even).withColumn("source", F.lit("bar"))
    down = scan(px, layers).withColumn("ord", F.row_number().over(Window.partitionBy("figure_id").orderBy("y"))).withColumn("source", F.lit("scan"))
    every = [s.withColumn("count", F.count(F.lit(1)).over(Window.partitionBy("figure_id"))).select("figure_id", "source", "ord", "color_name", "x", "y", "count") for s in (named, sampled, down)]
    enough = max(2, min(layers, 4))
    rank = F.when((F.col("source") == "zones") & (F.col("count") >= enough), 1).when((F.col("source") == "bar") & (F.col("count") >= 2), 2).when((F.col("source") == "scan") & (F.col("count") >= 2), 3)
    s = every[0].unionByName(every[1]).unionByName(every[2]).withColumn("rank", rank).where("rank is not null")
    return s.withColumn("best", F.min("rank").over(Window.partitionBy("figure_id"))).where("rank = best").select("figure_id", "source", "color_name", "x", "y")


def refined(px: DataFrame, points: DataFrame) -> DataFrame:
    """(figure_id, ord, color_name, x, y, r, g, b, source): points (figure_id, ord, color_name, x, y) moved to the heart of their layers."""
    wanted = points.groupBy("figure_id").agg(F.array_sort(F.collect_list(F.struct("ord", "color_name", "x", "y"))).alias("points"))

    def run(t: pa.Table) -> pa.Table:
        _, _, rgb = engines.panel(t)
        h, w, _ = rgb.shape
        asked = t.column("points")[0].as_py()
        at = [(max(0, min(w - 1, p["x"])), max(0, min(h - 1, p["y"]))) for p in asked]
        raw = np.stack([rgb[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].reshape(-1, 3).mean(0) for x, y in at])
        rough = engines.nearest(engines.lab(rgb), engines.lab(raw))
        found = seeds_.refine(rgb, at, background(rgb), rough, list(engines.seeds(rgb)))
        rows = [(p["ord"], p["color_name"], x, y, *(float(v) for v in c), s) for p, (c, x, y, s) in zip(asked, found, strict=True)]
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string())
        return pa.table({n: pa.array(v, k) for n, v, k in zip(("ord", "color_name", "x", "y", "r", "g", "b", "source"), zip(*rows, strict=True), kinds, strict=True)})

    p = px.select("figure_id", "y", "x", "r", "g", "b").join(wanted, "figure_id")
    return engines.per_figure(p, run, "ord int, color_name string, x int, y int, r double, g double, b double, source string")


# ---- missing colours


def extended(groups: DataFrame, given: DataFrame, most: int, least: int = 50) -> DataFrame:
    """(figure_id, ord, r, g, b, n): colour groups that a figure's given seeds miss, ``most`` of them at most.

    ``groups`` has figure_id, r, g, b (the group's mean), n, and x, y, a pixel of its own that isn't
    background (null without one); ``given`` has figure_id, r, g, b. From the largest on, a group is taken
    if it has ``least`` pixels, lies 30 from every given seed in LAB and 30 in RGB from those taken before:
    a fold over a figure's ordered groups, which are few.
    """
    lab = lambda df, names: df.withColumns(dict(zip(names, colors.lab(*[F.col(c) for c in "rgb"]), strict=True)))
    known = lab(given.select("figure_id", *[F.col(c).cast("double").alias(c) for c in "rgb"]), LAB).groupBy("figure_id").agg(F.collect_list(F.struct(*LAB)).alias("given"))
    g = lab(groups.where(F.col("x").isNotNull() & (F.col("n") >= least)), LAB).join(known, "figure_id", "left")
    off = F.array_min(F.transform("given", lambda s: F.sqrt(sum((s[c] - F.col(c)) ** 2 for c in LAB))))
    g = g.withColumn("d", F.round(F.coalesce(off, F.lit(float("inf"))), 6)).where("d >= 30")
    item = F.struct((-F.col("n")).alias("o"), (-F.col("d")).alias("p"), *[F.col(c).cast("double").alias(c) for c in "rgb"], F.col("n").cast("long").alias("n"))
    per = g.groupBy("figure_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    kind = per.schema["all"].dataType.simpleString()
    apart = lambda a, b: F.sqrt((a.r - b.r) ** 2 + (a.g - b.g) ** 2 + (a.b - b.b) ** 2) > 30
    step = lambda acc, p: F.when((F.size(acc) < most) & F.forall(acc, lambda q: apart(p, q)), F.concat(acc, F.array(p))).otherwise(acc)
    taken = per.select("figure_id", F.posexplode(F.aggregate("all", F.expr(f"cast(array() as {kind})"), step)).alias("ord", "s"))
    return taken.select("figure_id", "ord", "s.r", "s.g", "s.b", "s.n")
