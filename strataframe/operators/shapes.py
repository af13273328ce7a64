"""Shapes of label maps: boundary edges, rings, polygons with holes, and what a drawn polygon covers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions import kernels
from strataframe.operators import engines
from strataframe.operators.features import beside

PART = ["figure_id", "lbl", "part"]


def parts_of(lb: DataFrame) -> DataFrame:
    """(figure_id, y, x, lbl, part): the connected part of each pixel but those of label 0, numbered over a figure's labels."""

    def run(t: pa.Table) -> pa.Table:
        y, x, lbl = (t.column(c).to_numpy().astype(int) for c in ("y", "x", "lbl"))
        grid = np.zeros((y.max() + 1, x.max() + 1), int)
        grid[y, x] = lbl
        part = np.zeros(grid.shape, int)
        for k in np.unique(lbl[lbl != 0]):
            comp, _ = kernels.components(grid == k)
            part[comp > 0] = comp[comp > 0] + part.max()
        keep = lbl != 0
        return pa.table({n: pa.array(v[keep], pa.int32()) for n, v in (("y", y), ("x", x), ("lbl", lbl), ("part", part[y, x]))})

    return lb.select("figure_id", "y", "x", "lbl").transform(engines.per_figure, run, "y int, x int, lbl int, part int")


def edges(lb: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(figure_id, lbl, x0, y0, x1, y1): sides of pixels against another label or the figure's end, the label to their right.

    Corners of pixels are whole numbers: pixel (y, x) reaches from (x, y) to (x + 1, y + 1). Label 0 has none.
    """
    keys = keys or ["figure_id", "lbl"]
    row, col = Window.partitionBy("figure_id", "y").orderBy("x"), Window.partitionBy("figure_id", "x").orderBy("y")

    def differs(f, w: Window, axis: str, step: int) -> Column:
        # A neighbour in the frame counts only if it is next to the pixel: sparse maps have gaps.
        return ~((f("lbl").over(w) == F.col("lbl")) & (f(axis).over(w) == F.col(axis) + step)) | f("lbl").over(w).isNull()

    x, y = F.col("x"), F.col("y")
    sides = ((differs(F.lag, col, "y", -1), (x, y, x + 1, y)), (differs(F.lead, row, "x", 1), (x + 1, y, x + 1, y + 1)), (differs(F.lead, col, "y", 1), (x + 1, y + 1, x, y + 1)), (differs(F.lag, row, "x", -1), (x, y + 1, x, y)))
    found = F.array_compact(F.array(*[F.when(open_, F.struct(*[v.cast("int").alias(n) for v, n in zip(at, ("x0", "y0", "x1", "y1"), strict=True)])) for open_, at in sides]))
    e = lb.select(*keys, "y", "x", found.alias("sides")).where("lbl <> 0")
    return e.select(*keys, F.explode("sides").alias("s")).select(*keys, "s.*")


def rings(lb: DataFrame) -> DataFrame:
    """(figure_id, lbl, part, ring, points, area): closed rings of each connected part, its outer one and its holes.

    Edges end where the next begin; where two begin at a corner, the right turn is taken, so that a
    part has one outer ring, clockwise on the screen and of positive area, and holes of negative
    area. The areas of a part's rings sum to its pixels. A group is one part's edges.
    """
    labelled = parts_of(lb)
    kind = lb.schema["figure_id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        x0, y0, x1, y1 = (t.column(c).to_pylist() for c in ("x0", "y0", "x1", "y1"))
        after: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for a, b, c, d in zip(x0, y0, x1, y1, strict=True):
            after.setdefault((a, b), []).append((c, d))
        found = []
        while after:
            start = min(after, key=lambda p: (p[1], p[0]))
            at, came, ring = start, (1, 0), [start]
            while True:
                ways = after[at]
                right = (-came[1], came[0])
                to = next((w for w in ways if (w[0] - at[0], w[1] - at[1]) == right), ways[0])
                ways.remove(to)
                if not ways:
                    del after[at]
                came, at = (to[0] - at[0], to[1] - at[1]), to
                ring.append(at)
                if at == start:
                    break
            found.append(ring)
        n = len(found)
        first = [pa.repeat(t.column(k)[0], n) for k in PART]
        return pa.table([*first, pa.array(range(n), pa.int32()), pa.array([[{"x": x, "y": y} for x, y in r] for r in found], pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))], names=[*PART, "ring", "points"])

    e = edges(labelled, PART)
    r = e.groupBy(*PART).applyInArrow(run, f"figure_id {kind}, lbl int, part int, ring int, points array<struct<x:int,y:int>>")
    return r.withColumn("area", signed_area(F.col("points")))


def signed_area(points: Column) -> Column:
    """The shoelace formula over a closed ring; y runs down, so clockwise on the screen is positive."""
    twice = F.aggregate(F.sequence(F.lit(0), F.size(points) - 2), F.lit(0).cast("long"), lambda a, k: a + F.get(points, k).x.cast("long") * F.get(points, k + 1).y - F.get(points, k + 1).x.cast("long") * F.get(points, k).y)
    return twice / 2


def simplified(ring_rows: DataFrame, tolerance: float) -> DataFrame:
    """Rings without points that lie within ``tolerance`` of the line through the kept ones; closed rings stay closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for points in b.column("points").to_pylist():
                at = np.array([(p["x"], p["y"]) for p in points])
                kept = kernels.simplify(at, tolerance) if len(at) >= 4 else at
                out.append([{"x": int(x), "y": int(y)} for x, y in (kept if len(kept) >= 4 else at)])
            k = b.schema.get_field_index("points")
            yield b.set_column(k, b.schema.field(k), pa.array(out, b.schema.field(k).type))

    return ring_rows.mapInArrow(run, ring_rows.schema)


def polygons(lb: DataFrame, least: int = 200, tolerance: float = 2.0, hole: int = 50) -> DataFrame:
    """(figure_id, lbl, part, area, n_vertices, n_holes, wkt): each part of ``least`` pixels as a polygon with its holes.

    Holes of fewer than ``hole`` pixels are filled. ``area`` is the polygon's before it is simplified.
    """
    r = rings(lb).withColumn("pixels", F.sum("area").over(Window.partitionBy(*PART))).where(F.col("pixels") >= least)
    r = r.where((F.col("area") > 0) | (F.col("area") <= -hole))
    text = F.concat(F.lit("("), F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p.x.cast("string"), p.y.cast("string"))), ", "), F.lit(")"))
    s = simplified(r, tolerance).withColumn("text", text)
    order = F.array_sort(F.collect_list(F.struct((F.col("area") < 0).alias("hole"), "ring", "text")))
    g = s.groupBy(*PART).agg(F.sum("area").cast("long").alias("area"), F.sum(F.size("points")).alias("n_vertices"), F.count_if(F.col("area") < 0).alias("n_holes"), order.alias("rings"))
    return g.select(*PART, "area", "n_vertices", "n_holes", F.concat(F.lit("POLYGON ("), F.array_join(F.transform("rings", lambda q: q.text), ", "), F.lit(")")).alias("wkt"))


def features(polys: DataFrame) -> DataFrame:
    """(figure_id, geojson): a figure's polygons as a collection, their rings with the holes after the outer one."""
    body = F.regexp_extract("wkt", r"POLYGON \(\((.*)\)\)", 1)
    ring = F.transform(F.split(body, r"\), \("), lambda q: F.transform(F.split(q, ", "), lambda p: F.transform(F.split(p, " "), lambda v: v.cast("double"))))
    f = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("lbl").alias("layer_id"), "n_vertices").alias("properties"), F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"))
    g = polys.select("figure_id", "lbl", "part", f.alias("f")).groupBy("figure_id").agg(F.array_sort(F.collect_list(F.struct("lbl", "part", "f"))).alias("fs"))
    return g.select("figure_id", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("fs", lambda q: q.f).alias("features"))).alias("geojson"))


def components(lb: DataFrame, least: int = 50) -> DataFrame:
    """(figure_id, id, layer_id, x, y, w, h, area, cx, cy): connected parts of ``least`` pixels, by layer and falling area."""
    p = parts_of(lb).groupBy(*PART).agg(F.count(F.lit(1)).alias("area"), *[f(c).alias(f"{c}{n}") for c in "xy" for n, f in (("0", F.min), ("1", F.max))], F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"))
    number = F.row_number().over(Window.partitionBy("figure_id").orderBy("lbl", F.desc("area"), "part")) - 1
    return p.where(F.col("area") >= least).select("figure_id", number.alias("id"), F.col("lbl").alias("layer_id"), F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0") + 1).alias("w"), (F.col("y1") - F.col("y0") + 1).alias("h"), "area", "cx", "cy")


# ---- drawn polygons


def spans(corners: DataFrame) -> DataFrame:
    """(figure_id, y, lo, hi): the pixels of each row that a polygon covers, its own edges' pixels among them.

    ``corners`` has figure_id, k, x, y (whole numbers) in drawing order; the last joins the first. Each edge
    crosses the rows from its upper end to above its lower one; the crossings of a row pair up from
    the left, by the even-odd rule. Rows that only touch a corner or a level edge have that.
    """
    w = Window.partitionBy("figure_id").orderBy("k")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = corners.select("figure_id", "x", "y", F.coalesce(F.lead("x").over(w), F.first("x").over(whole)).alias("x1"), F.coalesce(F.lead("y").over(w), F.first("y").over(whole)).alias("y1"))
    level = e.where("y = y1").select("figure_id", "y", F.least("x", "x1").alias("lo"), F.greatest("x", "x1").alias("hi"))
    points = corners.select("figure_id", "y", F.col("x").alias("lo"), F.col("x").alias("hi"))
    top, low = F.least("y", "y1"), F.greatest("y", "y1")
    steep = e.where("y <> y1").withColumn("row", F.explode(F.sequence(top, low - 1)))
    cross = steep.select("figure_id", F.col("row").alias("y"), (F.col("x") + (F.col("row") - F.col("y")) * (F.col("x1") - F.col("x")) / (F.col("y1") - F.col("y"))).alias("at"))
    across = Window.partitionBy("figure_id", "y").orderBy("at")
    pairs = cross.withColumns({"n": F.row_number().over(across), "to": F.lead("at").over(across)}).where("n % 2 = 1")
    inside = pairs.select("figure_id", "y", F.ceil(F.col("at") - 1e-9).cast("int").alias("lo"), F.floor(F.col("to") + 1e-9).cast("int").alias("hi")).where("lo <= hi")
    return inside.unionByName(level.select("figure_id", "y", F.col("lo").cast("int"), F.col("hi").cast("int"))).unionByName(points.select("figure_id", "y", F.col("lo").cast("int"), F.col("hi").cast("int"))).distinct()


def within(lb: DataFrame, corners: DataFrame) -> DataFrame:
    """The label map inside each figure's polygon: 0 outside, the labels left numbered from 1 without gaps.

    Figures without a polygon are all 0. The columns covered in each row of a figure, and the labels left, are
    arrays of the figure, so that pixels meet them in the task that has them, by place and without lambdas.
    """
    size = lb.groupBy("figure_id").agg(F.max("y").alias("last"), F.max("x").alias("end"))
    s = beside(spans(corners), size).withColumns({"lo": F.greatest("lo", F.lit(0)), "hi": F.least("hi", "end")}).where("y between 0 and last and lo <= hi")
    s = s.groupBy("figure_id", "y").agg(F.first("last").alias("last"), F.array_distinct(F.flatten(F.collect_list(F.sequence("lo", "hi")))).alias("xs"))
    s = s.groupBy("figure_id").agg(F.first("last").alias("last"), F.map_from_entries(F.collect_list(F.struct("y", "xs"))).alias("of"))
    rows = F.transform(F.sequence(F.lit(0), F.col("last")), lambda y: F.element_at("of", y))
    p = lb.select("figure_id", "y", "x", "lbl").transform(beside, s.select("figure_id", rows.alias("rows")), "left")
    inside = F.coalesce(F.array_contains(F.get("rows", F.col("y")), F.col("x")), F.lit(False))
    p = p.select("figure_id", "y", "x", F.when(inside, F.col("lbl")).otherwise(0).alias("lbl"))
    left = p.where("lbl <> 0").groupBy("figure_id").agg(F.sort_array(F.collect_set("lbl")).alias("left"))
    return p.transform(beside, left, "left").select("figure_id", "y", "x", F.coalesce(F.array_position("left", F.col("lbl")), F.lit(0)).cast("int").alias("lbl"))
