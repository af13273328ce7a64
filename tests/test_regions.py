"""Regions merged by a user, all metrics of a label map, representative points refined, engines' last steps."""

import numpy as np
import pytest

from strataframe.functions import seeds
from strataframe.operators import engines, regions, representatives
from strataframe.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def labelled(spark, *maps, colours=False):
    more = lambda v: (90 * int(v), 0, 0) if colours else ()
    rows = [(k, y, x, int(m[y, x]), *more(m[y, x])) for k, m in enumerate(maps) for y in range(m.shape[0]) for x in range(m.shape[1])]
    return spark.createDataFrame(rows, "figure_id long, y int, x int, lbl int" + (", r int, g int, b int" if colours else "")).repartition(3)


def grid_of(df, shape):
    out = np.zeros(shape, int)
    for r in df.collect():
        out[r.y, r.x] = r.lbl
    return out


def test_parts_go_where_they_are_dropped(spark):
    m = np.zeros((30, 40), int)
    m[:15], m[15:] = 1, 2
    m[20:23, 10:13], m[25:27, 30:32], m[3:5, 3:5] = 1, 1, 3
    lb = labelled(spark, m)
    drops = spark.createDataFrame([(0, 0, 1, 11.0, 21.0), (0, 1, 3, 20.0, 25.0), (0, 2, 1, 5.0, 10.0), (0, 3, 3, 300.0, 5.0)], "figure_id long, ord int, lbl int, x double, y double")
    targets = regions.drop_targets(lb, drops, share=0.05)
    assert {(r.ord, r.lbl, r.target) for r in targets.collect()} == {(0, 1, 2), (1, 3, 2)}
    want = m.copy()
    want[20:23, 10:13] = want[3:5, 3:5] = 2
    assert (grid_of(regions.reassign(lb, targets), m.shape) == want).all()
    twice = spark.createDataFrame([(0, 0, 1, 11.0, 21.0, 3), (0, 1, 1, 12.0, 22.0, 2)], "figure_id long, ord int, lbl int, x double, y double, target int")
    assert (grid_of(regions.reassign(lb, twice), m.shape)[20:23, 10:13] == 2).all()
    menu = spark.createDataFrame([(0, 0, 1, 30.0, 25.0, 3)], "figure_id long, ord int, lbl int, x double, y double, target int")
    got = grid_of(regions.assigned(lb, menu), m.shape)
    assert (got[25:27, 30:32] == 3).all() and (got != m).sum() == 4
    assert (grid_of(regions.reassign(lb, menu.where("false")), m.shape) == m).all()


def test_all_metrics_with_their_lists(spark):
    m = np.ones((60, 60), int)
    m[30:] = 2
    m[10, 10], m[40, 40] = 2, 0
    (r,) = regions.compute_all(labelled(spark, m, colours=True)).collect()
    assert r.n_layers == 2 and [(f.lbl, f.area) for f in r.fragments] == [(2, 1)] and r.has_fragments and r.fragment_fraction == round(1 / 3600, 5)
    assert [(s.lbl, s.n_components, s.area, s.x, s.y, s.w, s.h) for s in r.stats] == [(1, 1, 1799, 0, 0, 60, 30), (2, 2, 1800, 0, 10, 60, 50)]
    assert r.suspects is None and not r.has_suspects and 0 <= r.boundary_alignment <= 1
    assert all(q.n_layers == len(q.stats) for q in QUERIES["lb_compute_all"](spark, SF).collect())


def test_points_are_refined(spark):
    rgb = np.full((80, 100, 3), 250.0)
    rgb[10:40, 10:90], rgb[45:75, 10:90] = (200, 30, 30), (30, 30, 200)
    points = [(12, 12), (95, 60), (50, 70)]
    rough = engines.nearest(engines.lab(rgb), engines.lab(np.array([[200.0, 30, 30], [250, 250, 250], [30, 30, 200]])))
    out = seeds.refine(rgb, points, np.array([250.0, 250, 250]), rough, [])
    assert out[0][3] in ("inner", "point") and tuple(out[0][0]) == (200, 30, 30)
    assert out[1][3] == "spiral" and tuple(out[1][0]) == (30, 30, 200)
    assert tuple(out[2][0]) == (30, 30, 200)
    blank = np.full((40, 40, 3), 250.0)
    blank[0, 0] = (9, 9, 9)
    far = seeds.refine(blank, [(39, 39), (38, 38)], np.array([250.0, 250, 250]), np.zeros((40, 40), int), [np.array([10.0, 10, 10])])
    assert [f[3] for f in far] == ["spare", "failed"]
    assert seeds.inner_point(np.zeros((5, 5), bool)) is None
    ring = np.zeros((41, 41), bool)
    ring[5:36, 5:36] = True
    ring[15:26, 15:26] = False
    x, y = seeds.inner_point(ring)
    assert seeds.shrunk(ring).any() and 0 <= x < 41 and 0 <= y < 41
    px = spark.createDataFrame([(0, y, x, *map(int, rgb[y, x])) for y in range(80) for x in range(100)], "figure_id long, y int, x int, r int, g int, b int")
    asked = spark.createDataFrame([(0, k, f"c{k}", x, y) for k, (x, y) in enumerate(points)], "figure_id long, ord int, color_name string, x int, y int")
    got = {r.ord: r for r in representatives.refined(px, asked).collect()}
    assert len(got) == 3 and (got[0].r, got[2].b) == (200.0, 200.0)


def test_last_steps_of_engines():
    m = np.ones((40, 50), int)
    m[20:] = 2
    m[5, 5], m[25:35, 10:20] = 2, 1
    out = engines.without_small(m, share=0.01)
    assert out[5, 5] == 1 and (out[25:35, 10:20] == 2).all() and set(np.unique(out)) == {1, 2}
    tiny = np.where(m == 2, 7, 4)
    tiny[0, :6] = 9
    merged = engines.merge_tiny(tiny)
    assert set(np.unique(merged)) == {1, 2} and (merged[0] == 1).all()
    rgb = np.zeros((40, 50, 3))
    rgb[:20], rgb[20:] = (200, 30, 30), (30, 30, 200)
    common = np.array([[30.0, 30, 200], [200, 30, 30]])
    assert (engines.to_common(rgb, np.repeat([[5], [3]], 20, 0).repeat(50, 1), common) == np.repeat([[1], [0]], 20, 0)).all()


@pytest.mark.parametrize("name", ["rep_refined", "lb_reassigned", "lb_drop_targets", "lb_assigned", "seg_ensemble", "seg_e027", "seg_grayscale_agglomerative"])
def test_registered(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows or name == "lb_drop_targets"
