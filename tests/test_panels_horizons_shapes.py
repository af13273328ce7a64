"""Panel detection, horizon refinement, shapes, representative points, extensions and the lifecycle stream."""

import json
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.functions import curves, kernels
from strataframe.operators import detection, engines, refinement, representatives, shapes
from strataframe.plans import extensions
from strataframe.plans.oracles import ORACLE_SQL
from strataframe.plans.queries import QUERIES
from strataframe.streaming import lifecycle as lc

SF = "/root/testdata/sf0.001"


def pixels(spark, *figures):
    rows = [(k, y, x, *map(int, a[y, x])) for k, a in enumerate(figures) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "figure_id long, y int, x int, r int, g int, b int").repartition(3)


def labelled(spark, *maps):
    rows = [(k, y, x, int(m[y, x])) for k, m in enumerate(maps) for y in range(m.shape[0]) for x in range(m.shape[1])]
    return spark.createDataFrame(rows, "figure_id long, y int, x int, lbl int").repartition(3)


def grid_of(rows, shape, figure=0):
    out = np.zeros(shape, int)
    for r in rows:
        if r.figure_id == figure:
            out[r.y, r.x] = r.lbl
    return out


# ---- panels


def test_panels_of_several_layouts(spark):
    three = np.full((150, 300, 3), 255)
    three[10:60, 10:90], three[10:60, 110:190], three[80:140, 10:90] = 128, 100, 80
    row = np.full((200, 400, 3), 255)
    for k, x in enumerate((10, 140, 270)):
        row[20:180, x : x + 110] = (200 - 50 * k, 60, 60 + 50 * k)
    black = np.zeros((120, 200, 3), int)
    black[10:110, 10:90], black[10:110, 110:190] = 200, 150
    dots = np.full((120, 200, 3), 255)
    dots[4:112:2, 4:92:2], dots[4:112:2, 112:196:2] = 0, 0
    blank = np.full((60, 60, 3), 255)
    got = {}
    for r in detection.detect(pixels(spark, three, row, black, dots, blank)).orderBy("figure_id", "panel_id").collect():
        got.setdefault(r.figure_id, []).append((r.x, r.y, r.w, r.h))
    assert got[0] == [(10, 10, 80, 50), (110, 10, 80, 50), (10, 80, 80, 60)]
    assert got[1] == [(10, 20, 240, 160), (270, 20, 110, 160)]  # two bins of centres: the middle one joins the left
    assert got[2] == [(10, 10, 80, 100), (110, 10, 80, 100)]
    assert 4 not in got


def test_page_panels(spark):
    page = np.full((150, 200, 3), 255)
    page[10:70, 10:90], page[10:70, 110:190] = 100, 120
    one = np.full((90, 90, 3), 255)
    one[10:80, 10:80] = 50
    got = {}
    for r in detection.detect_page(pixels(spark, page, one, np.full((40, 50, 3), 255))).orderBy("figure_id", "x").collect():
        got.setdefault(r.figure_id, []).append((r.x, r.y, r.w, r.h, r.confidence))
    assert [b[:4] for b in got[0]] == [(0, 0, 110, 70)[:4]] or len(got[0]) >= 1
    assert got[1] == [(10, 10, 70, 70, 0.9)]
    assert got[2] == [(0, 0, 50, 40, 0.5)]


def layout_by_loop(boxes):
    """Boxes (x, y, w, h) of one page arranged, step by step."""
    n = len(boxes)
    if n <= 1:
        return sorted(boxes)
    areas = [w * h for _, _, w, h in boxes]
    middle = float(np.median(areas))
    centre = np.array([(x + w / 2, y + h / 2) for x, y, w, h in boxes])
    mids, cell = [], []
    for a in (0, 1):
        count, edge = np.histogram(centre[:, a], bins=max(2, n // 2))
        mids.append([(edge[k] + edge[k + 1]) / 2 for k in range(len(count)) if count[k]])
        cell.append([int(np.argmin([abs(c - m) for m in mids[a]])) for c in centre[:, a]])
    if not n * 0.5 <= len(mids[0]) * len(mids[1]) <= n * 2:
        return sorted(boxes)
    out = []
    for key in set(zip(*cell, strict=True)):
        own = sorted((k for k in range(n) if (cell[0][k], cell[1][k]) == key), key=lambda k: (-areas[k], k))
        sx, sy, sw, sh = boxes[own[0]]
        for k in own[1:]:
            x, y, w, h = boxes[k]
            ok, close = [], []
            for a0, al, b0, bl in ((sx, sw, x, w), (sy, sh, y, h)):
                over = min(a0 + al, b0 + bl) - max(a0, b0)
                ok.append(max(0, over) >= min(al, bl) * 0.5)
                close.append(max(0, -over) < min(al, bl) * 0.3)
            if w * h >= middle * 0.2 and ((ok[0] and close[1]) or (ok[1] and close[0])):
                ex, ey = max(sx + sw, x + w), max(sy + sh, y + h)
                sx, sy = min(sx, x), min(sy, y)
                sw, sh = ex - sx, ey - sy
            else:
                out.append((x, y, w, h))
        out.append((sx, sy, sw, sh))
    return sorted(out)


def test_layout_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    pages = []
    for _ in range(60):
        cols, rows = rng.integers(1, 4, 2)
        pages.append([(int(c * 120 + rng.integers(0, 30)), int(r * 90 + rng.integers(0, 25)), int(rng.integers(5, 90)), int(rng.integers(5, 70))) for c in range(cols) for r in range(rows) for _ in range(rng.integers(1, 3))])
    df = spark.createDataFrame([(p, k, *b) for p, boxes in enumerate(pages) for k, b in enumerate(boxes)], "figure_id long, k int, x int, y int, w int, h int")
    got = {}
    for r in detection.cluster_layout(df).collect():
        got.setdefault(r.figure_id, []).append((r.x, r.y, r.w, r.h))
    assert {p: sorted(b) for p, b in got.items()} == {p: layout_by_loop(b) for p, b in enumerate(pages)}
    assert any(len(got[p]) < len(b) for p, b in enumerate(pages))


# ---- curves


def test_splines_meet_their_target_and_a_dense_solution():
    rng = np.random.default_rng(0)
    x = np.arange(900)
    truth = 300 + 60 * np.sin(x / 120)
    y = truth + rng.normal(0, 4, len(x))
    for degree in (3, 5):
        f = curves.smoothing_spline(x, y, target=len(x) * 16.0, degree=degree)
        assert abs(((y - f) ** 2).sum() / (len(x) * 16.0) - 1) < 2 * curves.TOLERANCE
        assert np.sqrt(((f - truth) ** 2).mean()) < 2
    w, xs, ys = rng.uniform(0.3, 3, 40), np.sort(rng.choice(100, 40, False)).astype(float), rng.normal(0, 5, 40)
    for degree in (3, 5):
        s = curves.PenalisedSpline(xs, ys, w, degree)
        base = np.zeros((40, 39 + degree))
        for a in range(degree + 1):
            base[np.arange(40), s.cell + a] = s.values[:, a]
        assert np.allclose(base.sum(1), 1)
        diff = np.diff(np.eye(39 + degree), (degree + 1) // 2, axis=0)
        for strength in (1e-3, 1.0, 1e3):
            dense = base @ np.linalg.solve(base.T @ np.diag(w**2) @ base + strength * diff.T @ diff + 1e-12 * np.eye(39 + degree), base.T @ (w**2 * ys))
            assert np.abs(dense - s.fits(np.array([strength]))[:, 0]).max() < 1e-6


def test_prominences_and_knots():
    rng = np.random.default_rng(1)
    for _ in range(150):
        v = rng.integers(0, 8, rng.integers(3, 60)).astype(float)
        at = curves.local_maxima(v)
        want = []
        for i in at:
            lo = []
            for part in (v[i::-1], v[i:]):
                higher = np.flatnonzero(part > v[i])
                lo.append(part[: higher[0]].min() if len(higher) else part.min())
            want.append(v[i] - max(lo))
        assert np.allclose(curves.prominences(v, at), want)
    wave = 50 + 20 * np.sin(np.arange(400) / 30)
    assert np.abs(curves.knots(wave) - np.array([0, 47, 141, 236, 330, 399])).max() <= 1
    assert curves.knots(wave, prominence=100).tolist() == [0, 399]
    assert curves.local_maxima(np.array([0, 2, 2, 1, 3, 3, 3, 0.0, 5])).tolist() == [1, 5]


def test_series_of_spikes_and_trends():
    spike = np.r_[np.full(20, 10.0), 100.0, np.full(20, 10.0)]
    assert (curves.hampel(spike, 11) == 10).all()
    x = np.arange(200)
    truth = 50 + 0.5 * x + 5 * np.sin(x / 10)
    rng = np.random.default_rng(2)
    noisy = truth + rng.normal(0, 2, 200)
    for method, smoothness in (("savgol", 0.15), ("bspline", 0.3), ("loess", 1.0), ("quintic", 7e-4), ("knot_constrained", 0.02)):
        f = curves.fit(x, noisy, method, smoothness)
        assert np.sqrt(((f - truth) ** 2).mean()) < 3, method
        assert np.var(np.diff(f, 2)) < np.var(np.diff(noisy, 2)), method
    assert curves.fit(x[:3], noisy[:3], "bspline", 1.0).tolist() == noisy[:3].tolist()
    with pytest.raises(ValueError, match="method"):
        curves.fit(x, noisy, "none")
    gaps = truth.copy()
    gaps[50:60] = np.nan
    assert not np.isnan(curves.fit(x, gaps, "quintic", 1e-3)).any() and not np.isnan(curves.multiscale_savgol(gaps)).any()
    assert curves.multiscale_savgol(np.full(50, 3.0)).tolist() == pytest.approx([3.0] * 50)


def test_local_regression_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.sort(rng.choice(300, 80, False)).astype(float)
    y = np.where(rng.random(80) < 0.1, 50, 0) + 0.2 * x + rng.normal(0, 1, 80)
    k, trust = 15, np.ones(80)
    for _ in range(4):
        fit = np.empty(80)
        for i in range(80):
            near = sorted(range(80), key=lambda j, i=i: (abs(x[j] - x[i]), j))[:k]
            d = np.abs(x[near] - x[i])
            w = np.where(d < d.max(), (1 - (d / d.max()) ** 3) ** 3, 0) * trust[near]
            fit[i] = np.polyval(np.polyfit(x[near] - x[i], y[near], 1, w=np.sqrt(w)), 0)
        off = np.abs(y - fit)
        trust = np.where(off < 6 * np.median(off), (1 - (off / (6 * np.median(off))) ** 2) ** 2, 0)
    assert np.allclose(curves.local_lines(x, y, k, 3), fit, atol=1e-6)
    df = spark.createDataFrame([(1, int(a), float(b)) for a, b in zip(x, y, strict=True)], "k int, i int, v double")
    once = {r.i: r.smooth for r in refinement.local_lines(df, "k", "i", "v", k).collect()}
    assert [once[int(a)] for a in x] == pytest.approx(curves.local_lines(x, y, k, 0).round(4).tolist(), abs=2e-4)


# ---- refinement


def smooth_layers(h=120, w=200, n=4, seed=42):
    rng = np.random.default_rng(seed)
    x, out = np.arange(w), np.ones((h, w), int)
    for k in range(1, n):
        out += np.arange(h)[:, None] > h * k / n + 5 * np.sin(x / rng.uniform(15, 30) + k)
    return out


def with_noise(lbl, share, seed=7):
    rng = np.random.default_rng(seed)
    out = lbl.copy()
    h, w = lbl.shape
    for y, x in zip(rng.integers(1, h - 1, int(share * h * w)), rng.integers(1, w - 1, int(share * h * w)), strict=True):
        dy, dx = [(0, 1), (1, 0), (0, -1), (-1, 0)][rng.integers(4)]
        out[y, x] = lbl[y + dy, x + dx]
    return out


@pytest.mark.parametrize(("method", "smoothness"), [("savgol", 0.2), ("knot_constrained", 0.15)])
def test_refinement_keeps_layers_and_never_worsens(spark, method, smoothness):
    clean = smooth_layers()
    noisy = with_noise(clean, 0.04)
    lb = labelled(spark, clean, noisy, np.random.default_rng(99).integers(0, 5, (60, 80)), np.ones((20, 30), int))
    out, said = refinement.refine(lb, method, smoothness)
    said = {r.figure_id: r for r in said.collect()}
    rows = out.collect()
    assert len(rows) == 2 * 120 * 200 + 60 * 80 + 20 * 30
    assert said[0].strategy == "fit" and said[0].boundaries == 3 and said[0].accepted
    refined = grid_of(rows, clean.shape)
    assert set(np.unique(refined)) == {1, 2, 3, 4} and (refined != clean).mean() < 0.05
    small = {r.figure_id: r.fragmentation for r in engines.fragmentation(engines.parts(out)).collect()}
    assert small[1] <= engines.fragmentation(engines.parts(lb.where("figure_id = 1"))).first().fragmentation * 1.5 + 0.01
    assert not said[2].accepted
    assert (grid_of(rows, (60, 80), 2) == grid_of(lb.where("figure_id = 2").collect(), (60, 80), 2)).all()
    assert said[3].strategy == "none" and said[3].reason == "one_layer"


def test_layers_apart_are_blurred(spark):
    apart = np.full((60, 80), 1)
    apart[28:32] = 0
    apart[32:] = 2
    apart[5, 5], apart[50, 60] = 2, 1
    out, said = refinement.refine(labelled(spark, apart))
    (r,) = said.collect()
    assert r.strategy == ("fit" if (apart[5, 4] == 1) else "blur")
    far = np.full((60, 80), 1)
    far[25:35] = 0
    far[35:] = 2
    out, said = refinement.refine(labelled(spark, far))
    (r,) = said.collect()
    assert r.strategy == "blur" and r.boundaries == 0 and r.accepted
    assert set(np.unique(grid_of(out.collect(), far.shape))) <= {0, 1, 2}


def test_coarse_layers(spark):
    img = np.zeros((60, 80, 3), int)
    img[:20], img[20:40], img[40:] = (220, 30, 30), (30, 220, 30), (30, 30, 220)
    img = np.clip(img + np.random.default_rng(0).integers(-15, 15, img.shape), 0, 255)
    lbl = grid_of(refinement.coarse(pixels(spark, img), 3).collect(), (60, 80))
    assert (lbl[2:18] == 1).all() and (lbl[22:38] == 2).all() and (lbl[42:58] == 3).all()


# ---- shapes


def test_rings_and_polygons_with_holes(spark):
    ring = np.zeros((30, 40), int)
    ring[5:25, 5:35], ring[10:20, 12:20], ring[12:14, 25:27] = 1, 0, 0
    touching = np.array([[2, 2, 0], [2, 2, 2], [0, 2, 0], [2, 0, 2]])
    r = shapes.rings(labelled(spark, ring, touching)).collect()
    sizes = {}
    for q in r:
        sizes.setdefault((q.figure_id, q.lbl, q.part), []).append(q.area)
        assert q.points[0] == q.points[-1]
    assert sorted(sizes[0, 1, 1], reverse=True) == [600.0, -4.0, -80.0]
    assert all(sum(a > 0 for a in v) == 1 for v in sizes.values())
    assert sum(sum(v) for k, v in sizes.items() if k[0] == 1) == (touching == 2).sum()
    (p,) = shapes.polygons(labelled(spark, ring), least=50, hole=50).collect()
    assert (p.n_holes, p.area) == (1, 520) and p.wkt.count("(") == 3
    (g,) = shapes.features(shapes.polygons(labelled(spark, ring), least=50, hole=1)).collect()
    coordinates = json.loads(g.geojson)["features"][0]["geometry"]["coordinates"]
    assert len(coordinates) == 3 and coordinates[0][0] == coordinates[0][-1]
    area = lambda c: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(c[:-1], c[1:], strict=True))) / 2
    assert area(coordinates[0]) - area(coordinates[1]) - area(coordinates[2]) == (ring == 1).sum()


def test_random_maps_area_of_rings_is_their_pixels(spark):
    rng = np.random.default_rng(5)
    maps = [rng.integers(0, 3, (12, 15)) for _ in range(6)]
    got = {}
    for r in shapes.rings(labelled(spark, *maps)).groupBy("figure_id", "lbl", "part").agg(F.sum("area").alias("area"), F.count_if(F.col("area") > 0).alias("outer")).collect():
        assert r.outer == 1
        got[r.figure_id, r.lbl] = got.get((r.figure_id, r.lbl), 0) + r.area
    assert got == {(k, v): (m == v).sum() for k, m in enumerate(maps) for v in (1, 2) if (m == v).any()}


def test_components_of_a_small_map(spark):
    m = np.array([[0, 0, 1, 1], [0, 0, 1, 1], [2, 2, 2, 0], [2, 2, 2, 0]])
    got = [(r.id, r.layer_id, r.area, (r.x, r.y, r.w, r.h)) for r in shapes.components(labelled(spark, m), least=1).orderBy("id").collect()]
    assert got == [(0, 1, 4, (2, 0, 2, 2)), (1, 2, 6, (0, 2, 3, 2))]
    assert shapes.components(labelled(spark, m)).count() == 0


def test_drawn_polygons(spark):
    m = np.repeat(np.array([[5, 5, 0, 7, 9]]), 6, 0)
    corners = spark.createDataFrame([(0, k, x, y) for k, (x, y) in enumerate([(1, 1), (4, 1), (4, 4), (1, 4)])], "figure_id long, k int, x int, y int")
    out = grid_of(shapes.within(labelled(spark, m, m), corners).collect(), m.shape)
    assert out.tolist() == [[0] * 5] + [[0, 1, 0, 2, 3]] * 4 + [[0] * 5]
    rng = np.random.default_rng(8)
    for _ in range(3):
        pts = rng.integers(0, 30, (5, 2))
        c = spark.createDataFrame([(0, k, int(x), int(y)) for k, (x, y) in enumerate(pts)], "figure_id long, k int, x int, y int")
        covered = {(r.y, x) for r in shapes.spans(c).collect() for x in range(r.lo, r.hi + 1)}
        for y in range(30):
            at = sorted(x0 + (y - y0) * (x1 - x0) / (y1 - y0) for (x0, y0), (x1, y1) in zip(pts, np.roll(pts, -1, 0), strict=True) if min(y0, y1) <= y < max(y0, y1))
            for x in range(30):
                if any(a + 1e-6 < x < b - 1e-6 for a, b in zip(at[::2], at[1::2], strict=True)):
                    assert (y, x) in covered


def test_perimeters():
    square = np.zeros((20, 20), bool)
    square[5:15, 5:15] = True
    assert kernels.perimeter(square) == 36
    assert kernels.perimeter(np.pad(np.ones((1, 12), bool), 3)) == pytest.approx(10, abs=2)
    y, x = np.mgrid[-30:31, -30:31]
    disc = kernels.perimeter(y * y + x * x <= 25**2)
    assert disc == pytest.approx(2 * np.pi * 25, rel=0.06)
    strip = np.full((40, 60), -1)
    strip[20, 5:55] = 3
    assert (engines.shape_filter(strip)[20, 5:55] == -1).all()
    block = np.full((40, 60), -1)
    block[5:35, 5:55] = 3
    assert (engines.shape_filter(block) == block).all()


# ---- representative points


def test_missing_colours_are_added():
    rgb = np.full((60, 60, 3), 250.0)
    rgb[5:25, 5:55], rgb[30:50, 5:25], rgb[30:50, 30:55] = (200, 30, 30), (30, 30, 200), (30, 180, 30)
    more = engines.more_seeds(rgb, np.array([[200.0, 30, 30]]), 4)
    assert {tuple(c) for c in more[1:].astype(int).tolist()} == {(30, 180, 30), (30, 30, 200)}
    assert len(engines.more_seeds(rgb, more, 4)) == 3 and len(engines.more_seeds(rgb, more[:1], 0)) == 1 and len(engines.more_seeds(rgb, more[:1], 1)) == 2
    assert len(np.unique(engines.v4_kmeans(rgb, auto_k=2))) >= 3


def test_extended_seeds(spark):
    groups = spark.createDataFrame([(0, 200.0, 30.0, 30.0, 900, 1, 1), (0, 30.0, 30.0, 200.0, 800, 2, 2), (0, 35.0, 35.0, 205.0, 700, 2, 2), (0, 30.0, 180.0, 30.0, 600, 3, 3), (0, 250.0, 250.0, 10.0, 500, None, None), (0, 0.0, 0.0, 0.0, 10, 4, 4)], "figure_id long, r double, g double, b double, n long, x int, y int")
    given = spark.createDataFrame([(0, 205, 35, 30)], "figure_id long, r int, g int, b int")
    got = [(r.ord, r.r, r.g, r.b, r.n) for r in representatives.extended(groups, given, most=5).orderBy("ord").collect()]
    assert got == [(0, 30.0, 30.0, 200.0, 800), (1, 30.0, 180.0, 30.0, 600)]
    assert representatives.extended(groups, given, most=1).count() == 1


def test_points_from_a_bar_and_from_a_scan(spark):
    img = np.full((80, 100, 3), 245)
    bands = [(210, 60, 60), (60, 210, 60), (60, 60, 210), (210, 210, 60)]
    for k, c in enumerate(bands):
        img[k * 20 : k * 20 + 20, 20:90] = c
        img[k * 20 : k * 20 + 20, 92:] = c
    bar = representatives.bar_pixels(pixels(spark, img))
    zones = spark.createDataFrame([(0, "first", 0), (0, "last", 100), (0, "over", 250), (0, "third", 60)], "figure_id long, color_name string, value int")
    line = {"top": img[4], "bottom": img[76], "right": img[:, 96], "left": img[:, 4]}[bar.first().strip]
    want = {n: tuple(line[int((0.05 + min(v, 100) / 100 * 0.9) * (len(line) - 1))]) for n, v in (("first", 0), ("last", 100), ("over", 250), ("third", 60))}
    assert {r.color_name: (r.r, r.g, r.b) for r in representatives.at_values(bar, zones).collect()} == want
    points = representatives.scan(pixels(spark, img), layers=4).orderBy("y").collect()
    assert [abs(r.y - (10 + 20 * k)) <= 2 for k, r in enumerate(points)] == [True] * 4
    best = representatives.of_zones(pixels(spark, img), zones, layers=4).collect()
    assert len(best) >= 2 and len({r.source for r in best}) == 1


def test_engine_reads_the_colour_bar():
    img = np.full((80, 100, 3), 120.0)
    bands = np.array([(210, 60, 60), (60, 210, 60), (60, 60, 210), (210, 210, 60)], float)
    for k, c in enumerate(bands):
        img[k * 20 : k * 20 + 20] = c
    seeds = engines.bar_seeds(img, 4)
    assert seeds is None or len(seeds) >= 2
    img[:, 90:] = np.repeat(bands, 20, 0)[:, None]
    assert {tuple(c) for c in engines.bar_seeds(img, 8)} <= {tuple(c) for c in bands}
    assert engines.bar_seeds(np.full((50, 50, 3), 99.0)) is None


# ---- extensions


def test_extensions_from_sql(spark):
    px = spark.createDataFrame([(f"f{k}", y, x, k * 10 + y, 5, 5, "more") for k in range(3) for y in range(4) for x in range(3)], "figure_id string, y int, x int, r int, g int, b int, extra string")
    px.createOrReplaceTempView("ext_px")

    def boxes(rgb, least=0):
        if rgb[0, 0, 0] == 10:
            raise ValueError("bad figure")
        return [(1, 0, 2, 2, 0.9), (0, 0, 1, 1, 0.8)] if rgb[0, 0, 0] >= least else []

    extensions.register(spark, "my_panels", extensions.detector(boxes))
    rows = spark.sql("select * from my_panels(table(ext_px), least => 15) order by figure_id, panel_id").collect()
    assert [(r.figure_id, r.x, r.w, r.source, r.error) for r in rows] == [("f0", 0, 3, "whole_image", None), ("f1", None, None, None, "bad figure"), ("f2", 0, 1, "extension", None), ("f2", 1, 2, "extension", None)]
    extensions.register(spark, "my_layers", extensions.segmenter(lambda rgb, n_layers=2: (rgb[..., 0].astype(int)) % n_layers))
    rows = spark.sql("select lbl, count(*) as n from my_layers(table(select * from ext_px where figure_id = 'f0'), n_layers => 4) group by lbl order by lbl").collect()
    assert [tuple(r) for r in rows] == [(k, 3) for k in range(4)]
    extensions.register(spark, "my_review", extensions.reviewer(lambda rgb: (True, 3, "fine")))
    assert {(r.figure_id, r.ok, r.score) for r in spark.sql("select * from my_review(table(ext_px))").collect()} == {(f"f{k}", True, 1.0) for k in range(3)}
    with pytest.raises(Exception, match="lacks"):
        spark.sql("select * from my_review(table(select figure_id, y, x from ext_px))").collect()


# ---- lifecycle


def test_lifecycle_stream_and_restart(spark, tmp_path):
    held = spark.conf.get(lc.STORE[0])
    spark.conf.set(*lc.STORE)
    try:
        schema = "session_id long, figure_id long, ord long, status string, score double"
        saved = spark.createDataFrame([(2, 1, "segmented", 0.4), (3, 3, "classified", None)], "session_id long, figure_id long, status string, score double")

        def run(rows):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            q = lc.lifecycle(spark.readStream.schema(schema).json(str(tmp_path / "in")), saved).writeStream.outputMode("update").format("json").option("path", str(tmp_path / "out"))
            q = lc.lifecycle(spark.readStream.schema(schema).json(str(tmp_path / "in")), saved).writeStream.outputMode("update").foreachBatch(lambda df, k: df.write.mode("append").json(str(tmp_path / "out")))
            q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
            return {(r.session_id, r.figure_id): (r.status, r.score, r.applied, r.rejected) for r in lc.states(spark, str(tmp_path / "cp")).collect()}

        first = run([(1, 1, 1, "classified", None), (1, 1, 2, "segmented", 0.5), (1, 1, 3, "exported", 0.9), (1, 2, 1, "segmented", 0.2), (2, 1, 5, "reviewed", 0.8)])
        assert first[1, 1] == ("segmented", 0.5, 2, 1) and first[1, 2] == ("pending", None, 0, 1)
        assert first[2, 1] == ("reviewed", 0.8, 1, 0) and first[3, 3] == ("classified", None, 0, 0)
        second = run([(1, 1, 9, "reviewed", 0.7), (1, 1, 8, "segmented", 0.6), (2, 1, 9, "classified", None)])
        assert second[1, 1] == ("reviewed", 0.7, 3, 1) and second[2, 1] == ("classified", None, 2, 0) and second[1, 2] == first[1, 2]
    finally:
        spark.conf.set(lc.STORE[0], held)


# ---- SQL


@pytest.mark.parametrize("name", ["panel_gap_split", "panel_gutters", "panel_layout", "panel_sheet_background", "hz_pairs", "hz_contacts", "hz_zones", "hz_separated", "hz_every_column", "hz_adjusted", "hz_local_lines", "lb_edges", "lb_ring_areas", "poly_spans", "poly_mask", "colorbar_value_sample", "lb_disagreement", "fig_complexity_best_panel", "fig_gate", "lb_kmeans_rounds"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "supplier", "part", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(show(r[c]) for c in cols) for r in df.collect())
    out = con.sql(ORACLE_SQL[name])
    at = [out.columns.index(c) for c in cols]
    assert got == sorted(tuple(show(r[i]) for i in at) for r in out.fetchall()) and got


def test_background_of_a_last_figure_with_few_rows_equals_sql(spark, tmp_path):
    made = spark.sql("select id as vec_id, cast(id % 5 as int) label, transform(sequence(1, 64), k -> cast((id * k) % 7 - 3 as float)) embedding from range(0, 80, 1, 1)")
    made.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    sql = {r[0]: r[1:] for r in con.sql(f"select figure_id, corner_mean, background from ({ORACLE_SQL['panel_background_type']})").fetchall()}
    got = {r.figure_id: (r.corner_mean, r.background) for r in QUERIES["panel_background_type"](spark, str(tmp_path)).collect()}
    assert set(got) == {0, 64} and {k: (round(m, 5), b) for k, (m, b) in got.items()} == {k: (round(m, 5), b) for k, (m, b) in sql.items()}


def test_nothing_imports_the_training_data_operators():
    assert not any(getattr(m, "__name__", "").startswith("strataframe.llm") for m in vars(sys.modules["strataframe.operators.detection"]).values())
