"""Panels of a figure or page: content masks, connected blocks, gaps of projections, layout and what is no panel.

A figure's pixels are labelled by one kernel; all else is grouping, windows and joins by figure,
whose boxes are a few rows each. Joins are hashed by task: by the few bytes of a stage's compressed
files the planner would send sizes and boxes of all figures to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions import colors, kernels
from strataframe.operators import engines, panels
from strataframe.operators.features import beside
from strataframe.sources.stages import staged

BOX = ("x", "y", "w", "h")


def mask(px: DataFrame, white: float = 0.94, dark: float | None = None) -> DataFrame:
    """(figure_id, y, x, on, rows, cols): a figure's content, darker than ``white`` or, on a black one, lighter than ``dark``.

    A figure is black where its corners are; see ``panels.background_type``.
    """
    kinds = panels.background_type(px).select("figure_id", "background", F.col("h").alias("rows"), F.col("w").alias("cols"))
    gray = colors.gray(F.col("r"), F.col("g"), F.col("b"))
    on = F.when(F.col("background") == "black", gray > (1.0 - white if dark is None else dark)).otherwise(gray < white)
    return beside(px, kinds).select("figure_id", "y", "x", on.alias("on"), "rows", "cols")


def page_mask(px: DataFrame, white: int = 245) -> DataFrame:
    """(figure_id, y, x, on, rows, cols): what isn't white, by the mean of the channels."""
    size = px.groupBy("figure_id").agg((F.max("y") + 1).alias("rows"), (F.max("x") + 1).alias("cols"))
    return beside(px, size).select("figure_id", "y", "x", (colors.gray_mean(F.col("r"), F.col("g"), F.col("b")) < white).alias("on"), "rows", "cols")


def least_area(rows: Column, cols: Column, share: float = 0.003) -> Column:
    """The least area of a panel: a share of its figure, a hundred pixels at least."""
    return F.greatest(F.lit(100), F.floor(rows * cols * share)).cast("long")


def most_area(rows: Column, cols: Column) -> Column:
    return F.floor(rows * cols * 0.95)


def blocks(m: DataFrame, eight: bool = True) -> DataFrame:
    """(figure_id, y, x, part): the connected block of each content pixel, numbered in raster order."""

    def run(t: pa.Table, _: pa.Table) -> pa.Table:
        y, x = (t.column(c).to_numpy().astype(int) for c in "yx")
        on = np.zeros((y.max() + 1, x.max() + 1), bool)
        on[y, x] = True
        return pa.table({"y": pa.array(y, pa.int32()), "x": pa.array(x, pa.int32()), "part": pa.array(kernels.components(on, eight)[0][y, x], pa.int32())})

    return engines.per_gathered(m.where("on"), run, "y int, x int, part int", ())


def block_boxes(blocked: DataFrame) -> DataFrame:
    """(figure_id, k, x, y, w, h, n): each block's box and pixels."""
    b = blocked.groupBy("figure_id", F.col("part").alias("k")).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n"))
    return b.select("figure_id", "k", "x", "y", (F.col("x1") + 1 - F.col("x")).alias("w"), (F.col("y1") + 1 - F.col("y")).alias("h"), "n")


def inside(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """The boxes with ``n``, how many of their figure's content pixels lie in each."""
    b = boxes.select("figure_id", *BOX).distinct()
    hit = pixels.select("figure_id", F.col("y").alias("py"), F.col("x").alias("px")).transform(beside, b).where("px >= x and px < x + w and py >= y and py < y + h")
    n = hit.groupBy("figure_id", *BOX).agg(F.count(F.lit(1)).alias("n"))
    return boxes.drop("n").join(n.hint("shuffle_hash"), ["figure_id", *BOX], "left").withColumn("n", F.coalesce("n", F.lit(0)))


# ---- gaps


def profiles(m: DataFrame) -> DataFrame:
    """(figure_id, axis, at, n, rows, cols): content pixels of each column (axis x) and each row (axis y), in one pass."""
    both = F.array(F.struct(F.lit("x").alias("axis"), F.col("x").alias("at")), F.struct(F.lit("y").alias("axis"), F.col("y").alias("at")))
    p = m.select("figure_id", "on", "rows", "cols", F.explode(both).alias("p"))
    return p.groupBy("figure_id", "p.axis", "p.at").agg(F.count_if("on").alias("n"), F.first("rows").alias("rows"), F.first("cols").alias("cols"))


def gaps(m: DataFrame, ratio: float, least: int = 5) -> DataFrame:
    """A row a figure and axis, with ``gaps``: runs [lo, hi) of ``least`` columns (rows) or more with less content than that share of the height (width)."""
    low = F.when(F.col("n") < F.when(F.col("axis") == "x", F.col("rows")).otherwise(F.col("cols")) * ratio, F.col("at"))
    island = low - F.row_number().over(Window.partitionBy("figure_id", "axis", low.isNull()).orderBy("at"))
    runs = profiles(m).withColumns({"low": low, "island": island}).groupBy("figure_id", "axis", "island").agg(F.min("low").alias("lo"), (F.max("low") + 1).alias("hi"), F.max("rows").alias("rows"), F.max("cols").alias("cols"))
    gap = F.when(F.col("hi") - F.col("lo") >= least, F.struct("lo", "hi"))
    return runs.groupBy("figure_id", "axis").agg(F.array_sort(F.collect_list(gap)).alias("gaps"), F.max("rows").alias("rows"), F.max("cols").alias("cols"))


def between(m: DataFrame, ratio: float, least: int = 10) -> DataFrame:
    """(figure_id, axis, rows, cols, stretches): what lies between a figure's gaps and its edges, ``least`` or more wide."""
    end = F.when(F.col("axis") == "x", F.col("cols")).otherwise(F.col("rows"))
    starts = F.concat(F.array(F.lit(0)), F.transform("gaps", lambda g: g.hi))
    ends = F.concat(F.transform("gaps", lambda g: g.lo), F.array(end))
    g = gaps(m, ratio).withColumns({"starts": starts, "ends": ends})
    return g.select("figure_id", "axis", "rows", "cols", F.filter(F.transform(F.sequence(F.lit(0), F.size("gaps")), lambda k: F.struct(F.get("starts", k).cast("int").alias("lo"), F.get("ends", k).cast("int").alias("hi"))), lambda s: s.hi - s.lo >= least).alias("stretches"))


def gap_split(m: DataFrame, ratio: float = 0.15) -> DataFrame:
    """(figure_id, k, x, y, w, h, n): boxes between the gaps of both projections.

    Where columns and rows both split, their grid; where one does, its stretches, drawn in to the
    lines across them with more than 5 % content. Boxes with too little or too much content go. A
    figure's stretches are one row, so that its pixels are read twice: for the projections, and to
    count what lies in the boxes.
    """
    one = lambda axis: F.first(F.when(F.col("axis") == axis, F.col("stretches")), ignorenulls=True)
    f = between(m, ratio).groupBy("figure_id").agg(one("x").alias("vs"), one("y").alias("hs"), F.max("rows").alias("rows"), F.max("cols").alias("cols"))
    box = lambda v, h, line: F.struct(v[0].alias("x"), h[0].alias("y"), (v[1] - v[0]).alias("w"), (h[1] - h[0]).alias("h"), F.lit(line).alias("line"))
    whole = {"x": (F.lit(0), F.col("cols")), "y": (F.lit(0), F.col("rows"))}
    ends = lambda s: (s.lo, s.hi)
    grid = F.flatten(F.transform("vs", lambda v: F.transform("hs", lambda h: box(ends(v), ends(h), "none"))))
    down = F.transform("vs", lambda v: box(ends(v), whole["y"], "y"))
    along = F.transform("hs", lambda h: box(whole["x"], ends(h), "x"))
    v2, h2 = F.size("vs") > 1, F.size("hs") > 1
    made = F.when(v2 & h2, F.filter(grid, lambda q: (q.w >= 50) & (q.h >= 30))).when(v2, F.filter(down, lambda q: q.w >= 50)).when(h2, F.filter(along, lambda q: q.h >= 30))
    f = f.select("figure_id", "rows", "cols", F.explode(made).alias("q"))
    on = m.where("on").select("figure_id", F.col("y").alias("py"), F.col("x").alias("px")).transform(beside, f).where("px >= q.x and px < q.x + q.w and py >= q.y and py < q.y + q.h")
    lines = on.groupBy("figure_id", "q", "rows", "cols", F.when(F.col("q.line") == "y", F.col("py")).when(F.col("q.line") == "x", F.col("px")).otherwise(0).alias("at")).agg(F.count(F.lit(1)).alias("line"))
    # The first and the last line with enough content, and what lies between them.
    across = F.when(F.col("q.line") == "y", F.col("q.w")).otherwise(F.col("q.h"))
    full = F.when((F.col("q.line") == "none") | (F.col("line") > across * 0.05), F.col("at"))
    every = Window.partitionBy("figure_id", "q")
    lines = lines.withColumns({"a": F.min(full).over(every), "b": F.max(full).over(every)}).where("at between a and b")
    found = lines.groupBy("figure_id", "q", "rows", "cols", "a", "b").agg(F.sum("line").alias("n"))
    start = lambda axis: F.when(F.col("q.line") == axis, F.col("a")).otherwise(F.col(f"q.{axis}")).alias(axis)
    size = lambda axis, side: F.when(F.col("q.line") == axis, F.col("b") + 1 - F.col("a")).otherwise(F.col(f"q.{side}")).alias(side)
    found = found.where(F.col("n").between(least_area(F.col("rows"), F.col("cols")), most_area(F.col("rows"), F.col("cols")))).select("figure_id", start("x"), start("y"), size("x", "w"), size("y", "h"), "n")
    return found.select("figure_id", F.row_number().over(Window.partitionBy("figure_id").orderBy("x", "y")).alias("k"), *[F.col(c).cast("int").alias(c) for c in BOX], "n")


# ---- layout


def cluster_layout(boxes: DataFrame) -> DataFrame:
    """Boxes (figure_id, k, x, y, w, h) of one panel as one, where centres look like a grid of columns and rows.

    Centres fall into half as many even bins an axis as there are boxes. If the used bins make
    a grid of half to twice as many cells as boxes, each cell grows its largest box by those
    next to it, larger ones first; boxes below a fifth of the median area stay for themselves.
    Figures without such a grid, and single boxes, stay as they are. ``k`` is renumbered.
    """
    centre = {"x": F.col("x") + F.col("w") / 2, "y": F.col("y") + F.col("h") / 2}
    c = boxes.select("figure_id", "k", *[F.col(b).cast("long").alias(b) for b in BOX], *[centre[a].alias(f"c{a}") for a in "xy"])
    per = c.groupBy("figure_id").agg(F.count(F.lit(1)).alias("count"), F.median(F.col("w") * F.col("h")).alias("median"), *[f(f"c{a}").alias(f"{a}{n}") for a in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    per = per.withColumn("bins", F.greatest(F.lit(2), F.floor(F.col("count") / 2)).cast("int"))
    for a in "xy":
        flat = F.col(f"{a}lo") == F.col(f"{a}hi")
        per = per.withColumns({f"{a}hi": F.when(flat, F.col(f"{a}hi") + 0.5).otherwise(F.col(f"{a}hi")), f"{a}lo": F.when(flat, F.col(f"{a}lo") - 0.5).otherwise(F.col(f"{a}lo"))})
    c = beside(c, per)
    step = {a: (F.col(f"{a}hi") - F.col(f"{a}lo")) / F.col("bins") for a in "xy"}
    for a in "xy":
        c = c.withColumn(f"b{a}", F.least(F.floor((F.col(f"c{a}") - F.col(f"{a}lo")) / step[a]), F.col("bins") - 1).cast("int"))
    used = c.groupBy("figure_id").agg(*[F.sort_array(F.collect_set(f"b{a}")).alias(f"u{a}") for a in "xy"])
    c = beside(c, used)

    def to_middles(a: str) -> Column:
        """How far the centre lies from the middle of each used bin."""
        edge = lambda k: F.col(f"{a}lo") + k * step[a]
        return F.transform(f"u{a}", lambda b: F.abs(F.col(f"c{a}") - (edge(b) + edge(b + 1)) / 2))

    for a in "xy":
        c = c.withColumn(f"d{a}", to_middles(a)).withColumn(f"g{a}", F.array_position(f"d{a}", F.array_min(f"d{a}")))
    cells = F.size("ux") * F.size("uy")
    grid = (F.col("count") > 1) & (cells >= F.col("count") * 0.5) & (cells <= F.col("count") * 2)
    alone = F.when(grid, F.lit(-1)).otherwise(F.col("k"))
    item = F.struct((-F.col("w") * F.col("h")).alias("o"), "k", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    g = c.groupBy("figure_id", F.when(grid, F.col("gx")).otherwise(0).alias("gx"), F.when(grid, F.col("gy")).otherwise(0).alias("gy"), alone.alias("alone")).agg(F.array_sort(F.collect_list(item)).alias("all"), F.first("median").alias("median"), F.min("k").alias("first"))
    corners = ("x0", "y0", "x1", "y1")
    kind = "array<struct<x0:bigint,y0:bigint,x1:bigint,y1:bigint>>"

    def step_(acc: Column, p: Column) -> Column:
        own = F.struct(*[p[k].alias(k) for k in corners])
        s = acc.seed

        def fits(lo: str, hi: str) -> tuple[Column, Column]:
            least = F.least(s[hi] - s[lo], p[hi] - p[lo])
            over = F.least(s[hi], p[hi]) - F.greatest(s[lo], p[lo])
            return F.greatest(F.lit(0), over) >= least * 0.5, F.greatest(F.lit(0), -over) < least * 0.3

        (x_ok, x_close), (y_ok, y_close) = fits("x0", "x1"), fits("y0", "y1")
        tiny = (p.x1 - p.x0) * (p.y1 - p.y0) < F.col("median") * 0.2
        joins = ~tiny & ((x_ok & y_close) | (y_ok & x_close))
        whole = F.struct(*[(F.least if k.endswith("0") else F.greatest)(s[k], p[k]).alias(k) for k in corners])
        return F.struct(F.when(joins, whole).otherwise(s).alias("seed"), F.when(joins, acc.rest).otherwise(F.concat(acc.rest, F.array(own))).alias("rest"))

    seed = F.struct(*[F.col("all")[0][k].alias(k) for k in corners])
    start = F.struct(seed.alias("seed"), F.expr(f"cast(array() as {kind})").alias("rest"))
    folded = g.select("figure_id", "first", F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(1))), start, step_).alias("f"))
    out = folded.select("figure_id", "first", F.posexplode(F.concat("f.rest", F.array("f.seed"))).alias("pos", "b"))
    number = F.row_number().over(Window.partitionBy("figure_id").orderBy("first", "pos")) - 1
    return out.select("figure_id", number.alias("k"), F.col("b.x0").alias("x"), F.col("b.y0").alias("y"), (F.col("b.x1") - F.col("b.x0")).alias("w"), (F.col("b.y1") - F.col("b.y0")).alias("h"))


def merged(boxes: DataFrame, threshold: float) -> DataFrame:
    long = boxes.select(F.col("figure_id").alias("page_id"), F.col("k").alias("box_id"), *[F.col(b).cast("long").alias(b) for b in BOX])
    return panels.merge_overlapping(long, threshold).withColumnRenamed("page_id", "figure_id")


def is_panel(boxes: Column, largest: Column) -> Column:
    """Whether a box is a panel by its shape: no legend, caption, colour bar, icon, thumbnail or strip.

    ``boxes`` is how many its figure has and ``largest`` the area of the largest. The limits are fixed values.
    """
    w, h = F.col("w"), F.col("h")
    long, short, area = F.greatest(w, h), F.least(w, h), w * h
    aspect = long / short
    legend = (long < 150) & aspect.between(0.6, 1.7) & (area < largest * 0.15)
    caption = (short < 110) & (aspect > 3.5)
    icon = (long < 100) & (area < largest * 0.05)
    thumbnail = (boxes >= 6) & (long < 200) & aspect.between(0.5, 2.0) & (area < largest * 0.6)
    return (w >= 30) & (h >= 30) & ~legend & ~caption & ~icon & ~thumbnail & (aspect <= 8)


def detect(px: DataFrame, white: float = 0.94, share: float = 0.003, ratio: float = 0.15) -> DataFrame:
    """(figure_id, panel_id, x, y, w, h, confidence): a figure's panels, by rows and then columns.

    Blocks of content without specks give boxes; a figure without any is split at its gaps.
    Overlapping boxes are merged, three or more are arranged, and what is no panel is left out.
    Figures without panels have no rows.
    """
    m = staged(mask(px, white), "panel-mask")
    size = m.groupBy("figure_id").agg(F.max("rows").alias("rows"), F.max("cols").alias("cols"))
    size = size.select("figure_id", least_area(F.col("rows"), F.col("cols"), share).alias("least"), most_area(F.col("rows"), F.col("cols")).alias("most"))
    blocked = staged(blocks(m), "panel-blocks")
    sized = beside(block_boxes(blocked), size).where(F.col("n") >= F.floor(F.col("least") / 5))
    clean = blocked.join(sized.select("figure_id", F.col("k").alias("part")).hint("shuffle_hash"), ["figure_id", "part"], "left_semi")
    found = sized.where("n >= least and n <= most and w >= 30 and h >= 30").select("figure_id", "k", *BOX)
    found = staged(found, "panel-found")
    none = beside(size, found, "left_anti").select("figure_id")
    split = gap_split(staged(mask(beside(px, none, "left_semi"), 0.94, 0.06), "panel-gaps"), ratio).select("figure_id", "k", *BOX)
    boxes = staged(merged(found.unionByName(split), 0.3), "panel-boxes")
    number = F.count(F.lit(1)).over(Window.partitionBy("figure_id"))
    boxes = boxes.withColumn("count", number)
    many = merged(cluster_layout(boxes.where("count >= 3").drop("count")), 0.2)
    boxes = staged(boxes.where("count < 3").drop("count").unionByName(many), "panel-layout")
    every = Window.partitionBy("figure_id")
    boxes = boxes.withColumns({"count": F.count(F.lit(1)).over(every), "largest": F.max(F.col("w") * F.col("h")).over(every)})
    boxes = inside(clean, beside(boxes, size)).where((F.col("w") * F.col("h")).between(F.col("least"), F.col("most")) & (F.col("n") >= F.col("least") * 0.3))
    boxes = boxes.where(is_panel(F.col("count"), F.col("largest")))
    place = F.row_number().over(every.orderBy("y", "x")) - 1
    return boxes.select("figure_id", place.alias("panel_id"), *[F.col(b).cast("int").alias(b) for b in BOX], F.round(F.least(F.lit(1.0), F.col("n") / F.col("least")), 6).alias("confidence"))


# ---- pages


def gutter_panels(m: DataFrame, share: float = 0.01) -> DataFrame:
    """(figure_id, k, x, y, w, h, confidence): the cells between white gutters, if they are large, square and full enough.

    A figure's gutters are runs of five rows or columns with less than ``share`` content; a cell
    reaches from the end of one to the end of the next. Figures without gutters have no rows.
    """
    one = lambda axis: F.first(F.when(F.col("axis") == axis, F.col("gaps")), ignorenulls=True)
    f = gaps(m, share).groupBy("figure_id").agg(one("x").alias("vs"), one("y").alias("hs"), F.max("rows").alias("rows"), F.max("cols").alias("cols")).where(F.size("vs") + F.size("hs") > 0)
    cuts = lambda found, end: F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), F.transform(found, lambda g: g.hi), F.array(F.col(end)))))
    f = f.withColumns({"xs": cuts("vs", "cols"), "ys": cuts("hs", "rows")})
    pairs = lambda at: F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda k: F.struct(F.get(at, k).alias("lo"), F.get(at, k + 1).alias("hi")))
    cell = F.flatten(F.transform(pairs("xs"), lambda v: F.transform(pairs("ys"), lambda h: F.struct(v.lo.alias("x"), h.lo.alias("y"), (v.hi - v.lo).alias("w"), (h.hi - h.lo).alias("h")))))
    cells = f.select("figure_id", "rows", "cols", F.explode(cell).alias("q")).select("figure_id", "rows", "cols", "q.*")
    cells = cells.where((F.col("w") * F.col("h") >= 0.01 * F.col("rows") * F.col("cols")) & (F.col("h") / F.col("w")).between(0.3, 3.0))
    full = inside(m.where("on"), cells.select("figure_id", *BOX)).withColumn("density", F.col("n") / (F.col("w") * F.col("h"))).where("density >= 0.15")
    number = F.row_number().over(Window.partitionBy("figure_id").orderBy("y", "x")) - 1
    return full.select("figure_id", number.alias("k"), *BOX, F.round(0.6 + 0.3 * F.least("density", F.lit(1.0)), 2).alias("confidence"))


def detect_page(px: DataFrame, white: int = 245) -> DataFrame:
    """(figure_id, k, x, y, w, h, confidence): figure panels of a rendered page.

    Blocks of content that are large, square and dense enough; where there are several, the cells
    between gutters instead, and of boxes that overlap by half the surer. A page without blocks
    is one panel of confidence 0.5.
    """
    m = staged(page_mask(px, white), "page-mask")
    size = m.groupBy("figure_id").agg(F.max("rows").alias("rows"), F.max("cols").alias("cols"))
    b = beside(block_boxes(blocks(m, eight=False)), size).withColumn("density", F.col("n") / (F.col("w") * F.col("h")))
    b = b.where((F.col("w") * F.col("h") >= 0.01 * F.col("rows") * F.col("cols")) & (F.col("h") / F.col("w")).between(0.3, 3.0) & (F.col("density") >= 0.3))
    b = b.select("figure_id", "k", *BOX, (0.7 + 0.2 * F.least("density", F.lit(1.0))).alias("confidence"), F.count(F.lit(1)).over(Window.partitionBy("figure_id")).alias("count"))
    b = staged(b, "page-blocks")
    cells = beside(gutter_panels(m), b.where("count > 1"), "left_semi")
    kept = beside(b.where("count > 1").drop("count"), cells, "left_anti").unionByName(cells)
    page = kept.select(F.col("figure_id").alias("page_id"), F.col("k").alias("box_id"), *[F.col(c).cast("long").alias(c) for c in BOX], F.col("confidence").alias("conf"))
    several = panels.suppress(page, 0.5).select(F.col("page_id").alias("figure_id"), F.col("box_id").alias("k"), *BOX, F.col("conf").alias("confidence"))
    found = several.unionByName(b.where("count = 1").select("figure_id", "k", *[F.col(c).cast("long").alias(c) for c in BOX], "confidence"))
    whole = beside(size, found, "left_anti").select("figure_id", F.lit(0).alias("k"), *[v.cast("long").alias(c) for c, v in zip(BOX, (F.lit(0), F.lit(0), F.col("cols"), F.col("rows")), strict=True)], F.lit(0.5).alias("confidence"))
    return found.unionByName(whole).withColumn("confidence", F.round("confidence", 6))
