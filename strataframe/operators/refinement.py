"""Refinement of a label map: smooth curves through the boundaries of neighbouring layers, behind gates.

Each step is a relation of its own; ``refine`` takes a figure through all of them in one grouped map, so that
pixels are read once and nothing is written between.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions import curves, kernels
from strataframe.operators import engines
from strataframe.operators.horizon import median_of
from strataframe.sources.stages import staged

PAIR = ["figure_id", "ord"]


def neighbour_pairs(lb: DataFrame) -> DataFrame:
    """(figure_id, ord, top, bottom): layers (label 0 is none) next to one another from the top, by median row."""
    med = lb.where("lbl > 0").groupBy("figure_id", "lbl").agg(F.median("y").alias("med"))
    down = Window.partitionBy("figure_id").orderBy("med", "lbl")
    return med.select("figure_id", (F.row_number().over(down) - 1).alias("ord"), F.col("lbl").alias("top"), F.lead("lbl").over(down).alias("bottom")).where("bottom is not null")


def touching(lb: DataFrame) -> DataFrame:
    """(figure_id, y, x, lbl, other): pixels and the differing labels of their four neighbours."""
    row, col = Window.partitionBy("figure_id", "y").orderBy("x"), Window.partitionBy("figure_id", "x").orderBy("y")
    near = F.array(*[f("lbl").over(w) for w in (row, col) for f in (F.lag, F.lead)])
    n = lb.select("figure_id", "y", "x", "lbl", near.alias("near")).where(F.exists("near", lambda v: v != F.col("lbl")))
    return n.select("figure_id", "y", "x", "lbl", F.explode(F.array_distinct(F.filter("near", lambda v: v.isNotNull() & (v != F.col("lbl"))))).alias("other"))


def contacts(lb: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs with ``contact``, how many pixels of the upper layer touch the lower one."""
    n = touching(lb).select("figure_id", F.col("lbl").alias("top"), F.col("other").alias("bottom"))
    n = n.join(pairs, ["figure_id", "top", "bottom"]).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("contact"))
    return pairs.join(n, PAIR, "left").withColumn("contact", F.coalesce("contact", F.lit(0)))


def filled_grid(y: np.ndarray, x: np.ndarray, lbl: np.ndarray, hole: int = -1) -> np.ndarray:
    grid = np.full((y.max() + 1, x.max() + 1), hole)
    grid[y, x] = lbl
    return grid


def crossing_points(grid: np.ndarray, pairs: list[tuple[int, int, int]], sigma: float = 5.0) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(ord, columns, rows) of one figure's pairs (ord, top, bottom), see ``crossings``."""
    out = []
    for ord_, top, bottom in pairs:
        v = kernels.gaussian((grid == top).astype(float) - (grid == bottom), sigma)
        both = (v > 0).any(0) & (v < 0).any(0)
        down = (v[:-1] > 0) & (v[1:] <= 0)
        cols = np.flatnonzero(both)
        at = down.argmax(0)[cols]
        a, b = v[at, cols], v[np.minimum(at + 1, len(v) - 1), cols]
        step = np.where(a - b > 1e-6, a / np.where(a - b > 1e-6, a - b, 1), 0.5)
        last = len(v) - 1 - (v[::-1] > 0).argmax(0)[cols]
        ys = np.where(down.any(0)[cols], at + step, last)
        if len(cols) >= 3 and np.median(np.abs(ys - np.median(ys))) <= len(v) / 10:
            out.append((ord_, cols, ys))
    return out


def crossings(lb: DataFrame, pairs: DataFrame, sigma: float = 5.0) -> DataFrame:
    """(figure_id, ord, x, yb): where a column first goes from the upper layer to the lower one.

    The map is 1 in the upper layer and -1 in the lower, blurred, and crossed between rows by
    interpolation; a column that never crosses gives the last row of the upper layer's side. Pairs
    with fewer than three columns, or whose rows scatter by more than a tenth of the height, give none.
    """

    def run(t: pa.Table, own: pa.Table) -> pa.Table:
        out, ids = [], t.column("figure_id")
        if t.num_rows and own.num_rows:
            y, x, lbl = (t.column(c).to_numpy().astype(int) for c in ("y", "x", "lbl"))
            out = crossing_points(filled_grid(y, x, lbl), sorted(zip(*(own.column(c).to_pylist() for c in ("ord", "top", "bottom")), strict=True)), sigma)
        ord_, cols, ys = (np.concatenate(c) for c in zip(*((np.full(len(c), k), c, v) for k, c, v in out), strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        held = pa.repeat(ids[0], len(ord_)) if len(ord_) else pa.array([], ids.type)
        return pa.table({"figure_id": held, "ord": pa.array(ord_, pa.int32()), "x": pa.array(cols, pa.int32()), "yb": pa.array(ys, pa.float64())})

    # The pairs come beside a figure's pixels once; joined to each pixel, they would be most of what goes to the kernel.
    own = pairs.select(F.col("figure_id").alias("own"), "ord", "top", "bottom").groupBy("own")
    kind = lb.schema["figure_id"].dataType.simpleString()
    return lb.select("figure_id", "y", "x", "lbl").groupBy("figure_id").cogroup(own).applyInArrow(run, f"figure_id {kind}, ord int, x int, yb double")


def fitted(points: DataFrame, method: str = "savgol", smoothness: float = 1.0) -> DataFrame:
    """(figure_id, ord, x, yb): each boundary's points on a smooth curve; a group is one boundary."""
    kind = points.schema["figure_id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("x")
        x, y = t.column("x").to_numpy(), t.column("yb").to_numpy()
        return t.select(["figure_id", "ord", "x"]).append_column("yb", pa.array(curves.fit(x, y, method, smoothness), pa.float64()))

    return points.select(*PAIR, "x", "yb").groupBy(*PAIR).applyInArrow(run, f"figure_id {kind}, ord int, x int, yb double")


def every_column(curve: DataFrame, size: DataFrame, half: int = 5) -> DataFrame:
    """(figure_id, ord, x, yb): the median of the known values around each column, half the height where there are none.

    ``size`` has rows and cols of each figure. Beyond the figure its first and last columns go on.
    The curves are staged, as they are read for their pairs and for their points; their few bytes on disk don't make them fit to broadcast.
    """
    curve = staged(curve.select(*PAIR, "x", "yb"), "known-curves")
    w = Window.partitionBy(*PAIR).orderBy("x")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cols = curve.select(*PAIR).distinct().join(size, "figure_id").withColumn("x", F.explode(F.sequence(F.lit(0), (F.col("cols") - 1).cast("int"))))
    s = cols.join(curve.hint("merge"), [*PAIR, "x"], "left")
    near = F.collect_list("yb").over(w.rowsBetween(-half, half))
    edge = lambda v, n: F.when(v.isNotNull() & (n > 0), F.array_repeat(v, n.cast("int"))).otherwise(F.expr("cast(array() as array<double>)"))
    s = s.select(*PAIR, "x", "rows", "cols", near.alias("near"), F.first("yb").over(whole).alias("a"), F.last("yb").over(whole).alias("b"))
    s = s.withColumn("near", F.array_sort(F.concat("near", edge(F.col("a"), half - F.col("x")), edge(F.col("b"), half - (F.col("cols") - 1 - F.col("x"))))))
    return s.select(*PAIR, "x", F.coalesce(median_of(F.col("near")), F.floor(F.col("rows") / 2).cast("double")).alias("yb"))


def separated(curve: DataFrame, size: DataFrame) -> DataFrame:
    """(figure_id, ord, place, ok): boundaries from the top by median row, and whether a figure's all keep their distance."""
    med = curve.groupBy(*PAIR).agg(F.median("yb").alias("med")).join(size, "figure_id")
    down = Window.partitionBy("figure_id").orderBy("med", "ord")
    gap = F.lead("med").over(down) - F.col("med")
    m = med.select(*PAIR, F.row_number().over(down).alias("place"), (gap < F.greatest(F.lit(3), F.floor(F.col("rows") / 100))).alias("close"))
    return m.select(*PAIR, "place", (~F.max(F.coalesce("close", F.lit(False))).over(Window.partitionBy("figure_id"))).alias("ok"))


def zones(lb: DataFrame, pairs: DataFrame, reach: int = 5) -> DataFrame:
    """(figure_id, ord, y, x): pixels within ``reach`` steps of where the two layers of a pair touch."""
    t = touching(lb).select("figure_id", "y", "x", F.least("lbl", "other").alias("a"), F.greatest("lbl", "other").alias("b"))
    p = pairs.select(*PAIR, F.least("top", "bottom").alias("a"), F.greatest("top", "bottom").alias("b"))
    edge = t.join(p, ["figure_id", "a", "b"]).select(*PAIR, "y", "x").distinct()
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-reach, reach + 1) for dx in range(abs(dy) - reach, reach - abs(dy) + 1)])
    return edge.withColumn("s", F.explode(steps)).select(*PAIR, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).distinct()


def sides(y: np.ndarray, x: np.ndarray, lbl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pixels, by their places in the arrays, and the next ones of their row or column where the label differs."""
    near = []
    for line, at in ((y, x), (x, y)):
        order = np.lexsort((at, line))
        one, two = order[:-1], order[1:]
        cut = (line[one] == line[two]) & (lbl[one] != lbl[two])
        near.append((one[cut], two[cut]))
    one, two = (np.concatenate(s) for s in zip(*near, strict=True))
    return one, two


def moved_labels(y: np.ndarray, x: np.ndarray, was: np.ndarray, touching_: tuple[np.ndarray, np.ndarray], lines: list[tuple], reach: int = 5) -> np.ndarray:
    """One figure's labels after its lines (top, bottom, columns, rows) from the upper one to the lower, see ``adjusted``."""
    lbl = was.copy()
    one, two = touching_
    for upper, lower, col, yb in lines:
        cut = np.full(x.max() + 1, np.nan)
        cut[col] = np.clip(np.rint(yb), 0, y.max())
        meet = ((was[one] == upper) & (was[two] == lower)) | ((was[one] == lower) & (was[two] == upper))
        edge = np.zeros((y.max() + 1, x.max() + 1), bool)
        edge[y[one[meet]], x[one[meet]]] = edge[y[two[meet]], x[two[meet]]] = True
        zone = kernels.dilate(edge, reach)
        at = np.flatnonzero(zone[y, x] & ~np.isnan(cut[x]) & ((lbl == upper) | (lbl == lower)))
        lbl[at] = np.where(y[at] <= cut[x[at]], upper, lower)
    return lbl


def adjusted(lb: DataFrame, pairs: DataFrame, curve: DataFrame, places: DataFrame, reach: int = 5) -> DataFrame:
    """The label map in which zones follow their curves, from the upper boundary to the lower one; all else stays.

    A figure's pixels meet its curves in one grouped map, which finds the ``zones`` of its pairs itself.
    """

    def run(t: pa.Table, facts: pa.Table) -> pa.Table:
        if not t.num_rows or not facts.num_rows:
            return t
        y, x, was = (t.column(c).to_numpy().astype(int) for c in ("y", "x", "lbl"))
        place, top, bottom, col, yb = (facts.column(c).to_numpy() for c in ("place", "top", "bottom", "x", "yb"))
        lines = [(top[own][0], bottom[own][0], col[own], yb[own]) for k in np.unique(place) if (own := (place == k) & (col <= x.max())).any()]
        return t.set_column(t.schema.get_field_index("lbl"), "lbl", pa.array(moved_labels(y, x, was, sides(y, x, was), lines, reach), pa.int32()))

    p = lb.select("figure_id", "y", "x", F.col("lbl").cast("int").alias("lbl"))
    facts = curve.join(pairs, PAIR).join(places.select(*PAIR, "place"), PAIR).select(F.col("figure_id").alias("own"), "place", "top", "bottom", F.col("x").alias("x"), "yb")  # x of its own: the curve's may be the pixels'
    return p.groupBy("figure_id").cogroup(facts.groupBy("own")).applyInArrow(run, p.schema)


def small_parts(y: np.ndarray, x: np.ndarray, lbl: np.ndarray) -> int:
    """Pixels in small parts of labels with several, see ``engines.fragmentation``."""
    hole = int(lbl.min()) - 1
    k, area = kernels.regions(filled_grid(y, x, lbl, hole))
    k, area = k[k != hole], area[k != hole]
    _, which, n = np.unique(k, return_inverse=True, return_counts=True)
    return int(area[(n[which] > 1) & (area < max(50, len(y) // 1000))].sum())


def gates(before: DataFrame, after: DataFrame) -> DataFrame:
    """(figure_id, changed, layers_before, layers_after, frag_before, frag_after) of two label maps, whose pixels of a figure meet in one grouped map."""
    names = ["pixels", "changed", "layers_before", "layers_after", *(f"{n}_{of}" for of in ("before", "after") for n in ("small", "all"))]

    def run(b: pa.Table, a: pa.Table) -> pa.Table:
        rows, ids = [], b.column("figure_id")
        if b.num_rows and a.num_rows:
            (by, bx, bl), (ay, ax, al) = (tuple(t.column(c).to_numpy().astype(int) for c in ("y", "x", "lbl")) for t in (b, a))
            wide = max(bx.max(), ax.max()) + 1
            _, i, j = np.intersect1d(by * wide + bx, ay * wide + ax, assume_unique=True, return_indices=True)
            was, new = bl[i], al[j]
            if len(i):
                rows = [(len(i), int((was != new).sum()), len(np.unique(was[was != 0])), len(np.unique(new[new >= 0])), small_parts(by, bx, bl), len(by), small_parts(ay, ax, al), len(ay))]
        return pa.table({"figure_id": ids[: len(rows)], **{n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(names)}})

    of = lambda df, name: df.select(F.col("figure_id").alias(name), "y", "x", "lbl").groupBy(name)
    kind = before.schema["figure_id"].dataType.simpleString()
    s = of(before, "figure_id").cogroup(of(after, "own")).applyInArrow(run, f"figure_id {kind}, {', '.join(f'{n} long' for n in names)}")
    return s.select("figure_id", (F.col("changed") / F.col("pixels")).alias("changed"), "layers_before", "layers_after", *[F.round(F.col(f"small_{of}") / F.col(f"all_{of}"), 5).alias(f"frag_{of}") for of in ("before", "after")])


def every_column_of(cols: np.ndarray, yb: np.ndarray, height: int, width: int, half: int = 5) -> np.ndarray:
    """One curve's value in each of ``width`` columns, see ``every_column``."""
    known = np.full(width + 2 * half, np.nan)
    known[cols + half] = yb
    known[:half], known[width + half :] = known[half], known[width + half - 1]
    near = np.sort(np.lib.stride_tricks.sliding_window_view(known, 2 * half + 1), axis=1)
    n = (~np.isnan(near)).sum(1)
    at, none = np.arange(width), n == 0
    middle = (near[at, np.maximum(n - 1, 0) // 2] + near[at, n // 2]) / 2.0
    return np.where(none, float(height // 2), middle)


def refined_figure(y: np.ndarray, x: np.ndarray, lbl: np.ndarray, method: str, smoothness: float) -> tuple[np.ndarray, str, int, str | None]:
    """(labels, strategy, boundaries, reason) of one figure, see ``refine``; the labels are the given ones where there is a reason."""
    height, width, total = int(y.max()) + 1, int(x.max()) + 1, len(lbl)
    layers = sorted((float(np.median(y[lbl == k])), int(k)) for k in np.unique(lbl[lbl > 0]))
    pairs = [(k, a, b) for k, ((_, a), (_, b)) in enumerate(zip(layers, layers[1:], strict=False))]
    if not pairs:
        return lbl, "none", 0, "one_layer"
    one, two = sides(y, x, lbl)
    meet = set(zip(lbl[one].tolist(), lbl[two].tolist(), strict=True))
    blur = any((a, b) not in meet and (b, a) not in meet for _, a, b in pairs)
    if blur:
        new, n = engines.blurred(y, x, lbl, 15.0), 0
    else:
        found = crossing_points(filled_grid(y, x, lbl), pairs)
        if not found:
            return lbl, "fit", 0, "no_boundary"
        smooth = curves.fit_all([(cols, ys) for _, cols, ys in found], method, smoothness)
        lines = [every_column_of(cols, ys, height, width) for (_, cols, _), ys in zip(found, smooth, strict=True)]
        down = sorted((float(np.median(line)), ord_, line) for (ord_, _, _), line in zip(found, lines, strict=True))
        n = len(down)
        if any(b[0] - a[0] < max(3, height // 100) for a, b in zip(down, down[1:], strict=False)):
            return lbl, "fit", n, "too_close"
        new = moved_labels(y, x, lbl, (one, two), [(*pairs[ord_][1:], np.arange(width), line) for _, ord_, line in down])
    share = lambda v: Decimal(repr(small_parts(y, x, v) / total)).quantize(Decimal("0.00001"), ROUND_HALF_UP)
    before, after = float(share(lbl)), float(share(new))
    lost = len(np.unique(new[new >= 0])) < len(np.unique(lbl[lbl != 0])) - 1
    cases = [("fragmentation", after > before * 1.5), ("layers_lost", lost)] if blur else [("changed", int((new != lbl).sum()) / total > 0.15), ("layers_lost", lost), ("fragmentation", after > before * 1.2)]
    why = next((name for name, holds in cases if holds), None)
    return (new if why is None else lbl), "blur" if blur else "fit", n, why


def refine(lb: DataFrame, method: str = "savgol", smoothness: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(labels, decisions): the refined label map of each figure, and why it is the refined or the given one.

    Where all neighbouring layers touch, their boundaries are fitted and what lies near them is
    relabelled; if some don't, labels are blurred. Given labels stay where there are fewer than two
    layers, no boundary is coherent or two come together; where more than 15 % of pixels would
    change, more than one layer be lost, or fragmentation grow by a fifth (by half if blurred).
    Decisions: figure_id, strategy (none, blur, fit), boundaries, accepted, reason.

    A figure is one row of its pixels, taken through the steps above in memory; they are dealt by figure unless they
    are already. Both relations run the map for themselves, so that who reads
    both of a costly label map stages it first.
    """
    arrays = lambda t: [t.column(c).to_numpy().astype(int) for c in ("y", "x", "lbl")]

    def labels_of(t: pa.Table, _: pa.Table) -> pa.Table:
        y, x, lbl = arrays(t)
        new, *_ = refined_figure(y, x, lbl, method, smoothness)
        return pa.table({n: pa.array(v, pa.int32()) for n, v in (("y", y), ("x", x), ("lbl", new))})

    def said_of(t: pa.Table, _: pa.Table) -> pa.Table:
        _, strategy, n, reason = refined_figure(*arrays(t), method, smoothness)
        return pa.table({"strategy": [strategy], "boundaries": pa.array([n], pa.int64()), "accepted": [reason is None], "reason": pa.array([reason], pa.string())})

    return engines.per_gathered(lb, labels_of, "y int, x int, lbl int", ("lbl",)), engines.per_gathered(lb, said_of, "strategy string, boundaries long, accepted boolean, reason string", ("lbl",))


def coarse(px: DataFrame, n_layers: int, sigma: float = 2.0, factor: int = 4) -> DataFrame:
    """Labels from a blurred figure at a ``factor``-th of its size, each block one label, numbered from the top from 1."""

    def run(t: pa.Table) -> pa.Table:
        y, x, rgb = engines.panel(t)
        soft = kernels.gaussian(rgb, sigma, axes=(0, 1))
        h, w = max(1, soft.shape[0] // factor), max(1, soft.shape[1] // factor)
        sy, sx = np.minimum(np.arange(soft.shape[0]) * h // soft.shape[0], h - 1), np.minimum(np.arange(soft.shape[1]) * w // soft.shape[1], w - 1)
        block = sy[:, None] * w + sx
        n = np.bincount(block.ravel(), minlength=h * w)
        small = np.stack([np.bincount(block.ravel(), soft[..., c].ravel(), h * w) / n for c in range(3)], 1)
        # From the mean's farthest colour on, each next centre is the colour farthest from those before.
        far, centres = ((small - small.mean(0)) ** 2).sum(1), []
        for _ in range(n_layers):
            centres.append(small[far.argmax()])
            own = ((small - centres[-1]) ** 2).sum(1)
            far = own if len(centres) == 1 else np.minimum(far, own)
        lbl = engines.by_rows(engines.lloyd(small.reshape(h, w, 3), np.array(centres))[0])
        return pa.table({"y": pa.array(y, pa.int32()), "x": pa.array(x, pa.int32()), "lbl": pa.array(lbl[sy][:, sx][y, x] + 1, pa.int32())})

    return px.select("figure_id", "y", "x", "r", "g", "b").transform(engines.per_figure, run, "y int, x int, lbl int")


def local_lines(series: DataFrame, key: str, at: str, value: str, k: int) -> DataFrame:
    """One round of local straight lines over the k nearest rows of a series, without robust weights.

    The frame holds the k - 1 rows either side; its k nearest, the earlier of two as far, are
    weighted by distance, and the line's value at the row is arithmetic over that array.
    """
    near = Window.partitionBy(key).orderBy(at).rowsBetween(-(k - 1), k - 1)
    s = series.select(key, at, F.collect_list(F.struct(F.col(at).cast("double").alias("x"), F.col(value).cast("double").alias("v"))).over(near).alias("near"))
    own = F.col(at).cast("double")
    picked = F.slice(F.array_sort(F.transform("near", lambda p: F.struct(F.abs(p.x - own).alias("d"), (p.x - own).alias("dx"), p.v.alias("v")))), 1, k)
    s = s.withColumn("near", picked).withColumn("radius", F.element_at("near", -1)["d"])
    u = lambda p: p.d / F.col("radius")
    s = s.withColumn("near", F.transform("near", lambda p: F.struct(p.dx.alias("dx"), p.v.alias("v"), F.when(F.col("radius") > 0, F.pow(1 - F.pow(u(p), 3), 3)).otherwise(1.0).alias("w"))))
    total = lambda f: F.aggregate("near", F.lit(0.0), lambda a, p: a + f(p))
    s = s.withColumns({"sw": total(lambda p: p.w), "sx": total(lambda p: p.w * p.dx), "sv": total(lambda p: p.w * p.v), "sxx": total(lambda p: p.w * p.dx * p.dx), "sxv": total(lambda p: p.w * p.dx * p.v)})
    spread = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    line = (F.col("sxx") * F.col("sv") - F.col("sx") * F.col("sxv")) / spread
    return s.select(key, at, F.round(F.when(spread > 1e-9, line).otherwise(F.col("sv") / F.col("sw")), 4).alias("smooth"))
