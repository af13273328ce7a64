"""Segmentation engines: a function from a panel's arrays to labels, run once per figure by grouped maps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions import colors, kernels
from strataframe.functions import seeds as seeds_


def per_figure(df: DataFrame, run: Callable[[pa.Table], pa.Table], columns: str) -> DataFrame:
    """Grouped map by figure, whose id keeps its type; ``run`` gives the other columns."""

    def with_id(t: pa.Table) -> pa.Table:
        own, ids = run(t), t.column("figure_id")
        return own.add_column(0, "figure_id", pa.chunked_array([pa.repeat(ids[0], own.num_rows)], ids.type))

    return df.groupBy("figure_id").applyInArrow(with_id, f"figure_id {df.schema['figure_id'].dataType.simpleString()}, {columns}")


def per_gathered(df: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], columns: str, values: tuple[str, ...], facts: tuple[str, ...] = ()) -> DataFrame:
    """``per_figure`` over one row a figure, which reaches Python several times as fast as a row a pixel.

    ``run`` gets the table of a figure's pixels (y, x and the int columns ``values``, in no order) and its row of
    ``facts``, columns that are equal in all of its pixels. A task that has a figure's pixels gathers them without a sort.
    """
    place = F.shiftleft(F.col("y").cast("long"), 32) + F.col("x").cast("long")
    lists = [F.collect_list(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(f"all_{c}") for c in values]
    g = df.groupBy("figure_id").agg(F.collect_list(place).alias("places"), *lists, *[F.first(c).alias(c) for c in facts])

    def unpacked(t: pa.Table) -> pa.Table:
        flat = lambda c: t.column(c).combine_chunks().flatten().to_numpy()
        at = flat("places")
        return run(pa.table({"y": at >> 32, "x": at & 0xFFFFFFFF, **{c: flat(f"all_{c}") for c in values}}), t.select(list(facts)))

    return per_figure(g, unpacked, columns)


def panel(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, x = t.column("y").to_numpy().astype(int), t.column("x").to_numpy().astype(int)
    rgb = np.zeros((y.max() + 1, x.max() + 1, 3))
    for k, c in enumerate("rgb"):
        rgb[y, x, k] = t.column(c).to_numpy()
    return y, x, rgb


def nearest(rgb: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((rgb[:, :, None, :] - centres) ** 2).sum(3).argmin(2)


def lloyd(rgb: np.ndarray, centres: np.ndarray, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Fixed rounds without a test of convergence; an empty cluster keeps its centre."""
    centres = centres.astype(float).copy()
    for _ in range(rounds):
        lbl = nearest(rgb, centres)
        for k in range(len(centres)):
            if (lbl == k).any():
                centres[k] = rgb[lbl == k].mean(0)
    return lbl, centres


def by_rows(lbl: np.ndarray) -> np.ndarray:
    """Labels renumbered from the top by median row."""
    rows = {k: np.median(np.nonzero(lbl == k)[0]) for k in np.unique(lbl)}
    new = {k: i for i, k in enumerate(sorted(rows, key=lambda k: (rows[k], k)))}
    return np.vectorize(new.get)(lbl)


def drop_small(lbl: np.ndarray, least: int) -> np.ndarray:
    """Small parts of labels with several parts take the commonest label around them; earlier changes count."""
    out = lbl.copy()
    for k in np.unique(lbl):
        comp, n = kernels.components(out == k)
        if n < 2:
            continue
        sizes = np.bincount(comp.ravel(), minlength=n + 1)
        for c in np.flatnonzero(sizes[1:] < least) + 1:
            part = comp == c
            rim = kernels.dilate(part, square=True) & ~part
            if rim.any():
                out[part] = np.bincount(out[rim]).argmax()
    return out


def lab(rgb: np.ndarray) -> np.ndarray:
    v = rgb / 255.0
    v = np.where(v > 0.04045, ((v + 0.055) / 1.055) ** 2.4, v / 12.92)
    t = v @ np.array(colors.XYZ).T / np.array(colors.WHITE)
    f = np.where(t > colors.KNEE, np.cbrt(t), t * colors.SLOPE + colors.SHIFT)
    return np.stack([f[..., 1] * 116 - 16, (f[..., 0] - f[..., 1]) * 500, (f[..., 1] - f[..., 2]) * 200], -1)


def seeds(rgb: np.ndarray, n_layers: int = 5) -> np.ndarray:
    """The figure's colour groups, those unlike its background first, two more than layers at most."""
    back = np.median([rgb[0, 0], rgb[0, -1], rgb[-1, 0], rgb[-1, -1], rgb[rgb.shape[0] // 2, rgb.shape[1] // 2]], axis=0)
    found = np.array([m for m, _ in seeds_.color_groups(rgb, most=20)])
    like = np.sqrt(((found - back) ** 2).sum(1)) < 80
    return found[np.argsort(like, kind="stable")][: n_layers + 2]


def more_seeds(rgb: np.ndarray, given: np.ndarray, most: int) -> np.ndarray:
    """The given seeds and up to ``most`` colours that they miss: of the groups first, then of a finer look at the figure.

    A group counts with a 2000th of the pixels, 50 at least, and half a percent within 50 of it. The
    distances are fixed values: 30 in LAB from the given seeds, 20 for the finer look, and 30 in RGB
    from one another.
    """
    if most <= 0:
        return given
    h, w, _ = rgb.shape
    back = np.median([rgb[0, 0], rgb[0, -1], rgb[-1, 0], rgb[-1, -1], rgb[h // 2, w // 2]], axis=0)
    least, known, found = max(50, h * w // 2000), lab(given), []
    far = lambda c: float(np.sqrt(((known - lab(c[None])) ** 2).sum(1)).min()) if len(given) else np.inf
    apart = lambda c: all(np.sqrt(((c - f) ** 2).sum()) > 30 for f in found)
    seen = lambda c: seeds_.find_pixel(rgb, c, back, 40.0, 50.0) is not None
    groups = [(n, far(m), m) for m, n in seeds_.color_groups(rgb, most=20) if n >= least and np.sqrt(((m - back) ** 2).sum()) >= 80]
    for _, d, m in sorted(groups, key=lambda g: (g[0], g[1]), reverse=True):
        wide = (np.sqrt(((rgb - m) ** 2).sum(2)) < 50) & (np.sqrt(((rgb - back) ** 2).sum(2)) >= 50)
        if len(found) < most and d >= 30 and apart(m) and seen(m) and wide.sum() >= h * w * 0.005:
            found.append(m)
    for m, n in seeds_.color_groups(rgb, 40.0, 30, 20_000):
        if len(found) < most and n >= least and np.sqrt(((m - back) ** 2).sum()) >= 60 and far(m) >= 20 and apart(m) and seen(m):
            found.append(m)
    return np.concatenate([given, np.array(found)]) if found else given


def shape_filter(lbl: np.ndarray, limit: float = 35.0) -> np.ndarray:
    """Thin parts of what is labelled (0 and up), by perimeter squared over area, take the commonest label around them."""
    comp, n = kernels.components(lbl >= 0, eight=True)
    thin = [c for c in range(1, n + 1) if (m := comp == c).any() and kernels.perimeter(m) ** 2 / m.sum() > limit]
    out, slim = lbl.copy(), np.isin(comp, thin)
    for c in thin:
        rim = kernels.dilate(comp == c, square=True) & ~slim
        if rim.any():
            values, counts = np.unique(out[rim], return_counts=True)
            out[comp == c] = values[counts.argmax()]
    return out


def v4_kmeans(rgb: np.ndarray, auto_k: int = 0) -> np.ndarray:
    return shape_filter(kernels.median_filter(nearest(lab(rgb), lab(more_seeds(rgb, seeds(rgb), auto_k))), 5))


def kmeans_full(rgb: np.ndarray, auto_k: int = 0) -> np.ndarray:
    return shape_filter(lloyd(lab(rgb), lab(more_seeds(rgb, seeds(rgb), auto_k)))[0])


def bar_seeds(rgb: np.ndarray, n_layers: int = 5) -> np.ndarray | None:
    """Even samples of the figure's own colour bar, or None: the first strip along a side whose colours vary enough."""
    h, w, _ = rgb.shape
    size = max(4, min(h, w) // 10)
    for strip, down in ((rgb[:size], False), (rgb[-size:], False), (rgb[:, -size:], True), (rgb[:, :size], True)):
        if lab(strip)[..., 1:].reshape(-1, 2).std(0).mean() / 40 > 0.3:
            line = strip[:, strip.shape[1] // 2] if down else strip[strip.shape[0] // 2]
            at = np.linspace(int(0.05 * len(line)), int(0.95 * len(line)) - 1, n_layers).astype(int)
            return np.unique(line[at], axis=0)
    return None


def pastel(rgb: np.ndarray, n_layers: int = 5) -> np.ndarray:
    return shape_filter(lloyd(lab(rgb), lab(seeds(rgb)[:n_layers]))[0])


def redecide(rgb: np.ndarray, lbl: np.ndarray, threshold: float = 55.0) -> np.ndarray:
    """Pixels between two layers of like mean colours, one above the other, take the nearer one."""
    out = lbl.copy()
    means = {k: rgb[lbl == k].mean(0).astype(int) for k in np.unique(lbl)}
    for i in range(int(lbl.max())):
        a, b = means.get(i), means.get(i + 1)
        if a is None or b is None or np.sqrt(((a - b) ** 2).sum()) >= threshold:
            continue
        rim = kernels.dilate(out == i, square=True) & kernels.dilate(out == i + 1, square=True)
        lower = ((rgb - b) ** 2).sum(2) < ((rgb - a) ** 2).sum(2)
        out[rim] = np.where(lower[rim], i + 1, i)
    return out


def colorbar_guided(rgb: np.ndarray, n_layers: int = 5) -> np.ndarray:
    """Rounds from the colour bar's samples; a figure without a bar starts from its colour groups."""
    bar = bar_seeds(rgb, n_layers)
    lbl = by_rows(lloyd(rgb, seeds(rgb)[:n_layers] if bar is None else bar)[0])
    for k in np.unique(lbl):
        lbl[kernels.fill_holes(lbl == k)] = k
    return redecide(rgb, drop_small(lbl, max(8, int(0.001 * lbl.size))))


def merge_small(lbl: np.ndarray, share: float = 0.005) -> np.ndarray:
    """Small parts of labels above 0 take the commonest label of the parts beside them; earlier changes count."""
    comp = np.zeros(lbl.shape, int)
    for k in np.unique(lbl[lbl > 0]):
        own, _ = kernels.components(lbl == k, eight=True)
        comp[own > 0] = own[own > 0] + comp.max()
    ids, first, sizes = np.unique(comp, return_index=True, return_counts=True)
    pairs = np.concatenate([np.stack([comp[:, :-1].ravel(), comp[:, 1:].ravel()], 1), np.stack([comp[:-1].ravel(), comp[1:].ravel()], 1)])
    beside: dict[int, set[int]] = {}
    for a, b in np.unique(pairs[(pairs[:, 0] != pairs[:, 1]) & (pairs > 0).all(1)], axis=0).tolist():
        beside.setdefault(a, set()).add(b)
        beside.setdefault(b, set()).add(a)
    size, now = dict(zip(ids.tolist(), sizes.tolist(), strict=True)), dict(zip(ids.tolist(), lbl.ravel()[first].tolist(), strict=True))
    for c in ids[np.argsort(first)].tolist():
        if c and size[c] < share * lbl.size and c in beside:
            votes: dict[int, int] = {}
            for n in beside[c]:
                votes[now[n]] = votes.get(now[n], 0) + size[n]
            now[c] = min(votes, key=lambda k: (-votes[k], k))
    out = np.array([now[c] for c in ids.tolist()])[np.searchsorted(ids, comp)]
    return np.unique(out, return_inverse=True)[1].reshape(lbl.shape)


def edge_guided(rgb: np.ndarray, weight: float = 0.5, sigma: float = 3.0) -> np.ndarray:
    """Pixels between two centres and near an edge take the commonest label of their edge-free region."""
    own = lab(rgb)
    lbl, centres = lloyd(own, lab(seeds(rgb)), 30)
    edges = kernels.canny(rgb.mean(2) / 255)
    d = np.sort(np.sqrt(((own[:, :, None, :] - centres) ** 2).sum(3)), axis=2)
    unsure = (d[..., 0] / np.maximum(d[..., 1], 1e-9) > 1 - weight) & (kernels.distance_to(edges) <= sigma if edges.any() else False)
    comp, n = kernels.components(~edges, eight=True)
    out = lbl.copy()
    for c in np.unique(comp[unsure & (comp > 0)]):
        out[unsure & (comp == c)] = np.bincount(lbl[comp == c]).argmax()
    return out


def edge_grow(rgb: np.ndarray, penalty: float = 150.0) -> np.ndarray:
    lbl, centres = lloyd(rgb, seeds(rgb), 3)
    used = np.unique(lbl)
    cost = np.sqrt(((rgb[None] - centres[used][:, None, None, :]) ** 2).sum(3))
    start = [tuple(int(v) for v in np.unravel_index(c.argmin(), c.shape)) for c in cost]
    edge = kernels.sobel(rgb.mean(2))
    grown = kernels.grow(cost, start, penalty * edge / max(edge.max(), 1e-9))
    return used[grown]


def without_small(lbl: np.ndarray, share: float = 0.002) -> np.ndarray:
    """Labels in rising order with their holes filled and without parts up to a share of the panel; what is left out is 0."""
    out, least = np.zeros_like(lbl), max(1, int(share * lbl.size))
    for k in np.unique(lbl):
        comp, n = kernels.components(kernels.fill_holes(lbl == k))
        out[(comp > 0) & (np.bincount(comp.ravel(), minlength=n + 1) > least)[comp]] = k
    return out


def merge_tiny(lbl: np.ndarray, share: float = 0.005) -> np.ndarray:
    """Labels of fewer pixels than a share of the panel, 50 at least, go to the commonest label around them; the rest count from 1, 0 stays."""
    out, least = lbl.copy(), max(50, int(share * lbl.size))
    for k in np.unique(lbl[lbl >= 0]):
        mask = out == k
        if not mask.any() or mask.sum() >= least:
            continue
        rim = kernels.dilate(mask, square=True) & ~mask & (out >= 0)
        if rim.any():
            out[mask] = np.bincount(out[rim]).argmax()
    left = np.unique(out[out > 0])
    return np.where(out > 0, np.searchsorted(left, out) + 1, 0)


def to_common(rgb: np.ndarray, lbl: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Labels as numbers of the common colours, each by its mean colour's nearest in LAB."""
    ids, at = np.unique(lbl, return_inverse=True)
    at = at.reshape(lbl.shape)
    mean = np.stack([rgb[at == k].mean(0) for k in range(len(ids))])
    return ((lab(mean)[:, None] - lab(common)[None]) ** 2).sum(2).argmin(1)[at]


def slic_graphcut(rgb: np.ndarray) -> np.ndarray:
    sp = kernels.superpixels(rgb)
    ids, sp = np.unique(sp, return_inverse=True)
    sp = sp.reshape(rgb.shape[:2])
    n = np.bincount(sp.ravel(), minlength=len(ids))
    means = np.stack([np.bincount(sp.ravel(), rgb[..., c].ravel(), len(ids)) / n for c in range(3)], 1)
    pairs = np.concatenate([np.stack([sp[:, :-1].ravel(), sp[:, 1:].ravel()], 1), np.stack([sp[:-1].ravel(), sp[1:].ravel()], 1)])
    pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], 1), axis=0)
    data = np.sqrt(((means[:, None] - seeds(rgb)) ** 2).sum(2))
    return without_small(kernels.relax(data, pairs, means)[sp])


def grayscale(rgb: np.ndarray, n_layers: int = 5) -> np.ndarray:
    gray = rgb.mean(2)
    hist = kernels.gaussian(np.bincount(gray.astype(int).ravel(), minlength=256).astype(float), 2.0)
    found = kernels.peaks(hist, 10, 0.002 * gray.size)
    found = found[np.argsort(-hist[found], kind="stable")][:n_layers] if len(found) > 1 else np.linspace(10, 245, n_layers).astype(int)
    markers = np.zeros(gray.shape, int)
    for k, v in enumerate(np.sort(found), 1):
        comp, n = kernels.components(np.abs(gray - v) < 8, eight=True)
        if n:
            markers[comp == np.bincount(comp.ravel())[1:].argmax() + 1] = k
    return merge_tiny(kernels.watershed(kernels.sobel(kernels.gaussian(gray, 1.0)), markers)) if markers.any() else np.zeros(gray.shape, int)


def ensemble(rgb: np.ndarray) -> np.ndarray:
    """Engines admitted by saturation vote with their consistency as weight; the lowest label wins ties.

    Each engine's labels are first taken to the baseline's colours.
    """
    share = float((np.ptp(rgb, axis=2) > 80).mean())
    votes = [v4_kmeans(rgb)] + ([kmeans_full(rgb)] if share >= 0.1 else []) + ([edge_guided(rgb)] if share >= 0.5 else [])
    if len(votes) == 1:
        return votes[0]
    common = seeds(rgb)
    votes = [votes[0], *(to_common(rgb, v, common) for v in votes[1:])]
    total = np.zeros((*rgb.shape[:2], max(int(v.max()) for v in votes) + 1))
    for v in votes:
        same = np.logical_and.reduce([v == np.roll(v, s, a) for a in (0, 1) for s in (1, -1)]).mean()
        for k in range(total.shape[2]):
            total[..., k] += same * (v == k)
    return merge_small(total.argmax(2))


ENGINES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "v4_kmeans": v4_kmeans,
    "v4_kmeans_pastel": pastel,
    "v4_kmeans_colorbar": colorbar_guided,
    "kmeans_full": kmeans_full,
    "edge_guided": edge_guided,
    "edge_grow": edge_grow,
    "grayscale_agglomerative": grayscale,
    "e027": slic_graphcut,
    "ensemble": ensemble,
}


Engine = str | Callable[[np.ndarray], np.ndarray]


def labelled(t: pa.Table, engine: Engine) -> pa.Table:
    """A figure's labels by an engine, a name or a function; if that fails, by the baseline, else zeros and ``failed``."""
    name = engine if isinstance(engine, str) else engine.__name__
    y, x, rgb = panel(t)
    error, failed = None, True
    lbl = np.zeros(rgb.shape[:2], int)
    for f in ((lambda a: ENGINES[engine](a)) if isinstance(engine, str) else engine, v4_kmeans):
        try:
            lbl, failed = f(rgb), False
            break
        except Exception as e:  # noqa: BLE001  one figure's failure isn't the batch's
            error = error or f"{name}: {e}"
    n = len(y)
    return pa.table({"y": pa.array(y, pa.int32()), "x": pa.array(x, pa.int32()), "lbl": pa.array(lbl[y, x], pa.int32()), "error": pa.array([error] * n, pa.string()), "failed": pa.array([failed] * n, pa.bool_())})


def segment(px: DataFrame, engine: Engine) -> DataFrame:
    """Labels of each figure by one engine; if it fails, by the baseline, else zeros, with the error beside them.

    An engine is one of ENGINES by name, or a function from a panel (rows, columns, 3) to its labels.
    """
    run = lambda t: labelled(t, engine).drop_columns("failed")
    return px.select("figure_id", "y", "x", "r", "g", "b").transform(per_figure, run, "y int, x int, lbl int, error string")


def segment_by(px: DataFrame) -> DataFrame:
    """Labels of each figure by the engine in its column ``engine``; ``failed`` where the baseline fails too."""
    run = lambda t, facts: labelled(t, facts.column("engine")[0].as_py())
    return per_gathered(px, run, "y int, x int, lbl int, error string, failed boolean", ("r", "g", "b"), ("engine",))


def neighbours(line: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pixel the places of the ones before and after it on its line, -1 where there is none."""
    order = np.argsort(line * (at.max() + 1) + at, kind="stable")
    one, two = order[:-1], order[1:]
    same = line[one] == line[two]
    before, after = np.full(len(line), -1), np.full(len(line), -1)
    before[two[same]], after[one[same]] = one[same], two[same]
    return before, after


def means(y: np.ndarray, x: np.ndarray, rgb: list[np.ndarray]) -> dict[str, float | int | None]:
    """One figure's means over pixels that ``features.features_of`` takes, and ``grid``, the sum that ``features.panel_hash`` takes."""
    r, g, b = rgb
    h, w = int(y.max()) + 1, int(x.max()) + 1
    v = (r * 0.2125 + g * 0.7154 + b * 0.0721) / 255.0
    row, col = neighbours(y, x), neighbours(x, y)
    side = lambda c, at: np.where(at < 0, c, c[at])
    left, right = (side(v, at) for at in row)
    sx, dx = (left + 2 * v + right) / 4.0, left - right
    (up_sx, dn_sx), (up_dx, dn_dx), (up, down) = ([side(c, at) for at in col] for c in (sx, dx, v))
    hh, vv = up_sx - dn_sx, (up_dx + 2 * dx + dn_dx) / 4.0
    edge = np.sqrt((hh * hh + vv * vv) / 2.0)

    def central(at: tuple[np.ndarray, np.ndarray], a: np.ndarray, c: np.ndarray) -> np.ndarray:
        none = np.where((at[0] < 0) & (at[1] < 0), np.nan, c - v)
        return np.where(at[0] < 0, none, np.where(at[1] < 0, v - a, (c - a) / 2.0))

    gx, gy = central(row, left, right), central(col, up, down)
    m, step = np.sqrt(gx * gx + gy * gy), np.abs(v - left)[row[0] >= 0]
    m = m[~np.isnan(m)]
    places = lambda n: n // 4 + (3 * n // 4 - n // 4) * np.arange(4) // 3
    on = np.isin(y, places(h)) & np.isin(x, places(w))
    high = np.maximum(np.maximum(r, g), b) - np.minimum(np.minimum(r, g), b)
    return {
        "h": h, "w": w, "vivid": float((high > 80).mean()), "edges": float((edge > 0.05).mean()), "mean": float(m.mean()) if len(m) else None, "sd": float(m.std()) if len(m) else None,
        "striped": float(((np.abs(gy) > 0.05) & (np.abs(gx) < 0.03)).mean()), "d": float(step.mean()) if len(step) else None, "grid": int((r + g + b)[on].sum()) if on.any() else None,
    }


def figure_means(px: DataFrame) -> DataFrame:
    """A row a figure with its ``means``: what ``features.feature_row`` and ``features.panel_hash`` need, in one pass without windows."""

    def run(t: pa.Table, _: pa.Table) -> pa.Table:
        y, x, *rgb = (t.column(c).to_numpy().astype(np.int64) for c in ("y", "x", "r", "g", "b"))
        whole = {"h": pa.int32(), "w": pa.int32(), "grid": pa.int64()}
        return pa.table({n: pa.array([v], whole.get(n, pa.float64())) for n, v in means(y, x, rgb).items()})

    return per_gathered(px, run, "h int, w int, vivid double, edges double, mean double, sd double, striped double, d double, grid long", ("r", "g", "b"))


def hashes(m: DataFrame, modulus: int = 4) -> DataFrame:
    """``features.panel_hash`` of figures' means."""
    return m.where("grid is not null").select("figure_id", ((F.col("grid") + 7 * F.col("h") + 13 * F.col("w")) % modulus).cast("long").alias("panel_hash"))


def labelled_parts(y: np.ndarray, x: np.ndarray, lbl: np.ndarray, eight: bool = False) -> tuple[np.ndarray, ...]:
    """(label, number, order, head, area) of a figure's parts: ``order`` has the pixels part by part, ``head`` where each begins."""
    grid, part = np.full((y.max() + 1, x.max() + 1), -1), np.empty(len(y), np.int64)
    grid[y, x] = lbl
    for k in np.unique(lbl):
        own = lbl == k
        part[own] = kernels.components(grid == k, eight)[0][y[own], x[own]]
    order = np.lexsort((part, lbl))
    a, b = lbl[order], part[order]
    head = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[head], b[head], order, head, np.diff(np.r_[head, len(order)])


def parts(lb: DataFrame, eight: bool = False) -> DataFrame:
    """Connected components: (figure_id, lbl, part, area, x0, y0, x1, y1, cx, cy)."""

    def run(t: pa.Table) -> pa.Table:
        y, x, lbl = (t.column(c).to_numpy().astype(int) for c in ("y", "x", "lbl"))
        k, part, order, head, area = labelled_parts(y, x, lbl, eight)
        y, x = y[order], x[order]
        least, most, total = (lambda v, f=f: f.reduceat(v, head) if len(head) else v[:0] for f in (np.minimum, np.maximum, np.add))
        values = [k, part, area, least(x), least(y), most(x), most(y), total(x) / area, total(y) / area]
        names = ["lbl", "part", "area", "x0", "y0", "x1", "y1", "cx", "cy"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.int32()] * 4, pa.float64(), pa.float64()]
        return pa.table({n: pa.array(v, t) for n, v, t in zip(names, values, kinds, strict=True)})

    return lb.select("figure_id", "y", "x", "lbl").transform(per_figure, run, "lbl int, part int, area long, x0 int, y0 int, x1 int, y1 int, cx double, cy double")


def fragments(components: DataFrame, share: float = 0.003, least: int = 30) -> DataFrame:
    """Components of labels other than 0 below a share of their panel, whose pixels are the areas of all its components."""
    pixels = F.sum("area").over(Window.partitionBy("figure_id"))
    c = components.withColumn("pixels", pixels).where((F.col("area") < F.greatest(F.lit(least), F.floor(F.col("pixels") * share))) & (F.col("lbl") != 0))
    return c.select("figure_id", "lbl", "part", "area", F.round(F.col("area") / F.col("pixels"), 5).alias("fraction"))


def fragmentation(components: DataFrame) -> DataFrame:
    """The share of pixels in small components of labels that have several."""
    pixels = F.sum("area").over(Window.partitionBy("figure_id"))
    c = components.withColumn("pixels", pixels)
    small = F.when(F.col("area") < F.greatest(F.lit(50), F.floor(F.col("pixels") * 0.001)), F.col("area")).otherwise(0)
    many = c.groupBy("figure_id", "lbl").agg(F.count(F.lit(1)).alias("n"), F.sum(small).alias("small"), F.max("pixels").alias("pixels"))
    return many.groupBy("figure_id").agg(F.round(F.sum(F.when(F.col("n") > 1, F.col("small")).otherwise(0)) / F.max("pixels"), 5).alias("fragmentation"))


def fill_holes(lb: DataFrame) -> DataFrame:
    """Labels in rising order take what they enclose; earlier fillings count."""

    def run(t: pa.Table) -> pa.Table:
        y, x, lbl = (t.column(c).to_numpy().astype(int) for c in ("y", "x", "lbl"))
        grid = np.full((y.max() + 1, x.max() + 1), -1)
        grid[y, x] = lbl
        for k in np.unique(lbl):
            grid[kernels.fill_holes(grid == k)] = k
        return pa.table({"y": pa.array(y, pa.int32()), "x": pa.array(x, pa.int32()), "lbl": pa.array(grid[y, x], pa.int32())})

    return lb.select("figure_id", "y", "x", "lbl").transform(per_figure, run, "y int, x int, lbl int")


def remove_small(lb: DataFrame, share: float = 0.001, least: int = 50) -> DataFrame:
    """Small parts of labels with several parts take the commonest label around them."""

    def run(t: pa.Table) -> pa.Table:
        y, x, lbl = (t.column(c).to_numpy().astype(int) for c in ("y", "x", "lbl"))
        grid = np.zeros((y.max() + 1, x.max() + 1), int)
        grid[y, x] = lbl
        out = drop_small(grid, max(least, int(share * grid.size)))
        return pa.table({"y": pa.array(y, pa.int32()), "x": pa.array(x, pa.int32()), "lbl": pa.array(out[y, x], pa.int32())})

    return lb.select("figure_id", "y", "x", "lbl").transform(per_figure, run, "y int, x int, lbl int")


def blurred(y: np.ndarray, x: np.ndarray, lbl: np.ndarray, sigma: float) -> np.ndarray:
    """One figure's labels, see ``label_blur``."""
    grid = np.zeros((y.max() + 1, x.max() + 1), int)
    grid[y, x] = lbl
    ids = np.unique(lbl)
    return ids[np.stack([kernels.gaussian((grid == k).astype(float), sigma) for k in ids]).argmax(0)][y, x]


def label_blur(lb: DataFrame, sigma: float = 15.0) -> DataFrame:
    """Each pixel's label of the largest blurred indicator, the lowest of equals."""

    def run(t: pa.Table) -> pa.Table:
        y, x, lbl = (t.column(c).to_numpy().astype(int) for c in ("y", "x", "lbl"))
        return pa.table({"y": pa.array(y, pa.int32()), "x": pa.array(x, pa.int32()), "lbl": pa.array(blurred(y, x, lbl, sigma), pa.int32())})

    return lb.select("figure_id", "y", "x", "lbl").transform(per_figure, run, "y int, x int, lbl int")


def polygons(lb: DataFrame, least: int = 50, tolerance: float = 2.0) -> DataFrame:
    """(figure_id, lbl, ring, n_vertices, wkt): simplified rings of each label but 0, small parts dropped and small holes filled."""

    def run(t: pa.Table) -> pa.Table:
        y, x, lbl = (t.column(c).to_numpy().astype(int) for c in ("y", "x", "lbl"))
        grid = np.zeros((y.max() + 1, x.max() + 1), int)
        grid[y, x] = lbl
        rows = []
        for k in np.unique(lbl[lbl != 0]):
            comp, n = kernels.components(grid == k)
            mask = (comp > 0) & (np.bincount(comp.ravel(), minlength=n + 1) >= least)[comp]
            for i, ring in enumerate(kernels.outline(kernels.fill_holes(mask)) if mask.any() else []):
                r = kernels.simplify(ring, tolerance)
                rows.append((int(k), i, len(r), "POLYGON ((" + ", ".join(f"{a} {b}" for a, b in r) + "))"))
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.table({"lbl": pa.array(cols[0], pa.int32()), "ring": pa.array(cols[1], pa.int32()), "n_vertices": pa.array(cols[2], pa.int32()), "wkt": pa.array(cols[3], pa.string())})

    return lb.select("figure_id", "y", "x", "lbl").transform(per_figure, run, "lbl int, ring int, n_vertices int, wkt string")


def visual_terms(px: DataFrame) -> DataFrame:
    """(figure_id, quantization, gap_score): the share of the largest colour groups, and a third for each wide white gap.

    Gaps are runs of columns or rows, a tenth of the figure wide, that are white on average; a margin of
    8 % is left out and thin lines are filtered away first.
    """

    def run(t: pa.Table) -> pa.Table:
        _, _, rgb = panel(t)
        gray = rgb @ np.array([0.2125, 0.7154, 0.0721]) / 255
        h, w = gray.shape
        my, mx = max(1, int(h * 0.08)), max(1, int(w * 0.08))
        inner, score = gray[my : h - my, mx : w - mx], 0.0
        if min(inner.shape) >= 20:
            soft = kernels.median_filter(inner, 5)
            wide = 0
            for axis in (0, 1):
                white = np.r_[False, soft.mean(axis) > 0.94, False].astype(int)
                edge = np.diff(white)
                wide += int((np.flatnonzero(edge < 0) - np.flatnonzero(edge > 0) > inner.shape[1 - axis] * 0.10).sum())
            score = min(1.0, wide / 3.0)
        return pa.table({"quantization": pa.array([round(seeds_.quantization(rgb), 4)]), "gap_score": pa.array([score])})

    return px.select("figure_id", "y", "x", "r", "g", "b").transform(per_figure, run, "quantization double, gap_score double")


def color_groups(px: DataFrame) -> DataFrame:
    """(figure_id, ord, r, g, b, n, x, y): a figure's colour groups and the pixel that stands for each."""

    def run(t: pa.Table) -> pa.Table:
        _, _, rgb = panel(t)
        back = np.median([rgb[0, 0], rgb[0, -1], rgb[-1, 0], rgb[-1, -1], rgb[rgb.shape[0] // 2, rgb.shape[1] // 2]], axis=0)
        rows = []
        for k, (mean, n) in enumerate(seeds_.color_groups(rgb)):
            at = seeds_.find_pixel(rgb, mean, back) or (None, None)
            rows.append((k, *(round(float(v), 4) for v in mean), n, *at))
        kinds = [pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(["ord", "r", "g", "b", "n", "x", "y"], kinds, strict=True))})

    return px.select("figure_id", "y", "x", "r", "g", "b").transform(per_figure, run, "ord int, r double, g double, b double, n long, x int, y int")


def smooth_boundary(boundary: DataFrame, smoothness: float = 0.3) -> DataFrame:
    """Local cubic smoothing of each boundary: a window of that share of its width, made odd, borders mirrored."""

    def run(t: pa.Table) -> pa.Table:
        x, y = t.column("x").to_numpy(), t.column("yb").to_numpy()
        order = np.argsort(x)
        n = len(x)
        window = min(max(5, int(smoothness * n)) | 1, n - 1 if n % 2 == 0 else n - 2)
        out = kernels.savgol(y[order], window, min(3, window - 2)) if window >= 5 else y[order]
        return pa.table({"x": pa.array(x[order], pa.int32()), "yb": pa.array(np.round(out, 4))})

    return boundary.transform(per_figure, run, "x int, yb double")
