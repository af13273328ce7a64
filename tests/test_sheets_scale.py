"""Pixels of the sheets are spread over tasks, and never taken for a table that is small enough to broadcast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.functions import curves, kernels, seeds
from strataframe.operators import detection, engines, features, overlays, refinement, shapes, workflow
from strataframe.plans import queries
from strataframe.sources import tables


@pytest.fixture
def sf_dir(spark, tmp_path):
    spark.range(40).selectExpr("id as s_suppkey", "'n' as s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def test_sheets_are_dealt_to_all_tasks(spark, sf_dir):
    assert tables.sheets(spark, sf_dir).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_tasks_grow_with_the_sheets(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(tables, "SHEETS_A_TASK", 1)
    assert tables.sheets(spark, sf_dir).rdd.getNumPartitions() == 10


def test_planner_knows_that_pixels_are_many(spark, sf_dir):
    px = tables.sheets(spark, sf_dir)
    assert px._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >= 10 * 160 * 200 * 20


def test_facts_of_figures_are_hashed_by_task(spark, sf_dir):
    px = tables.sheets(spark, sf_dir)
    for df in (detection.mask(px), detection.page_mask(px), features.with_shape(px)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan
        assert plan.count("Exchange hashpartitioning") == plan.count("FileScan parquet")  # the suppliers of each side, and no pixels


def test_drawn_polygons_are_dealt_to_all_tasks(spark, sf_dir):
    assert queries.drawn(spark, sf_dir).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_pixels_within_a_polygon_beyond_the_figure(spark):
    lb = spark.sql("select 1L figure_id, cast(y as int) y, cast(x as int) x, 3 lbl from (select id y from range(6)), (select id x from range(8))")
    corners = spark.createDataFrame([(1, 0, -5, -4), (1, 1, 3, -4), (1, 2, 3, 100000), (1, 3, -5, 100000)], "figure_id long, k int, x int, y int")
    got = {(r.y, r.x): r.lbl for r in shapes.within(lb, corners).collect()}
    assert got == {(y, x): int(x <= 3) for y in range(6) for x in range(8)}


def test_refinement_meets_a_figures_facts_once(spark):
    lb = spark.sql("select 1L figure_id, cast(y as int) y, cast(x as int) x, 1 + cast(y div 4 as int) lbl from (select id y from range(12)), (select id x from range(8))")
    pairs = refinement.neighbour_pairs(lb)
    curve = spark.sql("select 1L figure_id, 0 ord, cast(id as int) x, 5.0D yb from range(8)")
    places = spark.sql("select 1L figure_id, 0 ord, 1 place, true ok")
    out = refinement.adjusted(lb, pairs, curve, places)
    for df in (refinement.crossings(lb, pairs), out, refinement.gates(lb, out)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "Generate" not in plan and "collect_list" not in plan
    got = {(r.y, r.x): r.lbl for r in out.collect()}
    assert got == {(y, x): 1 if y <= 5 else 2 if y < 8 else 3 for y in range(12) for x in range(8)}
    g = refinement.gates(lb, out).first()
    assert (round(g.changed, 6), g.layers_before, g.layers_after, g.frag_before, g.frag_after) == (round(16 / 96, 6), 3, 3, 0.0, 0.0)


def test_parts_of_a_figure_with_holes(spark):
    rows = [(1, y, x, 1 if x < 2 else 2) for y in range(3) for x in range(4) if (y, x) not in {(1, 0), (1, 1), (0, 3)}]
    got = {(r.lbl, r.part): (r.area, r.x0, r.y0, r.x1, r.y1, r.cx, r.cy) for r in engines.parts(spark.createDataFrame(rows, "figure_id long, y int, x int, lbl int")).collect()}
    assert got == {(1, 1): (2, 0, 0, 1, 0, 0.5, 0.0), (1, 2): (2, 0, 2, 1, 2, 0.5, 2.0), (2, 1): (5, 2, 0, 3, 2, 2.4, 1.2)}


def test_vectors_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "VECTORS_A_TASK", 64)
    spark.sql("select id as vec_id, cast(id % 5 as int) label, array(1.0F, 2.0F) embedding from range(640)").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert tables.pixels(spark, str(tmp_path)).rdd.getNumPartitions() == 10


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_known_curves_are_read_once_and_not_broadcast(spark, sf_dir):
    plan = plan_of(queries.QUERIES["hz_every_column"](spark, sf_dir))
    assert "percentile" not in plan  # a stage holds the curves
    curve = spark.sql("select 1L figure_id, 0 ord, cast(id as int) x, 5.0D yb from range(8) where id <> 3")
    plan = plan_of(refinement.every_column(curve, spark.sql("select 1L figure_id, 12 rows, 8 cols")))
    assert "LeftOuter" in plan and not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "LeftOuter" in line]


def test_medians_of_columns_are_taken_once_for_both_layers_of_a_pair(spark, sf_dir):
    lb = queries.bands(spark, sf_dir)
    scans = plan_of(queries.middles(lb)).count("FileScan parquet")
    assert scans == 1 + plan_of(refinement.neighbour_pairs(lb)).count("FileScan parquet")


def test_only_the_strips_pixels_are_taken_to_lab(spark, sf_dir):
    plan = plan_of(features.has_colorbar(tables.sheets(spark, sf_dir)))
    assert any(word in line and ">=" in line and " OR " in line for line in plan.splitlines() for word in ("Filter", "ShuffledHashJoin"))


def test_flow_hashes_facts_beside_pixels(spark, monkeypatch):
    seen, segment_by = [], engines.segment_by
    monkeypatch.setattr(engines, "segment_by", lambda df: seen.append(plan_of(df)) or segment_by(df))
    px = spark.sql("select 1L figure_id, cast(y as int) y, cast(x as int) x, cast((y div 20) * 90 as int) r, cast(x % 7 as int) g, 40 b from (select id y from range(60)), (select id x from range(60))")
    out = workflow.run(px, min_w=30, min_h=30, rejected=())
    assert out.figures.first().status == "ok" and len(seen) == 2
    for plan in (*seen, plan_of(out.labels)):
        assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan and "Window" not in plan  # features come from a stage


def test_only_shown_pixels_go_to_the_picture(spark, monkeypatch):
    seen, per_figure = [], engines.per_figure
    monkeypatch.setattr(engines, "per_figure", lambda df, *a: seen.append(df) or per_figure(df, *a))
    px = spark.sql("select 1L figure_id, cast(y as int) y, cast(x as int) x, 10 r, 20 g, cast(y as int) b from (select id y from range(12)), (select id x from range(8))")
    px = px.unionByName(px.where("y % 3 = 1").withColumn("figure_id", px.figure_id + 1))  # the second lacks all that is shown
    got = {r.figure_id: (r.width, r.height) for r in overlays.pictures(px, most=4).collect()}
    assert got == {1: (3, 4), 2: (3, 4)}
    assert {r.figure_id: r["count"] for r in seen[0].groupBy("figure_id").count().collect()} == {1: 4 * 3 + 8, 2: 8}


@pytest.mark.parametrize("name", ["panel_detect", "panel_detect_page", "panel_gap_split", "panel_gap_stretches", "panel_gutters"])
def test_panels_send_nothing_of_the_figures_through_the_driver(spark, sf_dir, monkeypatch, name):
    plans, staged = [], detection.staged
    monkeypatch.setattr(detection, "staged", lambda df, at: plans.append(plan_of(df)) or staged(df, at))
    plans.append(plan_of(queries.QUERIES[name](spark, sf_dir)))
    assert "BroadcastHashJoin" not in "".join(plans)
    assert all("Range" in below for plan in plans for below in after_broadcasts(plan))


def after_broadcasts(plan: str) -> list[str]:
    """What is sent to all tasks, as two lines below each broadcast: a line of row or column numbers."""
    lines = plan.splitlines()
    return ["".join(lines[k + 1 : k + 3]) for k, line in enumerate(lines) if "BroadcastExchange" in line]


def test_refinement_takes_a_figure_through_one_map(spark, sf_dir, monkeypatch):
    def none(*_):
        raise AssertionError("refine writes nothing between its steps")

    monkeypatch.setattr(refinement, "staged", none)
    lb = queries.bands(spark, sf_dir)
    for df in refinement.refine(lb, "quintic", 1e-4):
        plan = plan_of(df)
        assert plan.count("FileScan parquet") == plan.count("Exchange hashpartitioning") == plan.count("FlatMapGroupsInArrow") == 1  # the suppliers, and no pixels
        assert plan.index("Sort ") < plan.index("collect_list") and "Sort " not in plan[plan.index("collect_list") :]  # rows of figures, and no pixels


def test_refinement_is_what_its_steps_give(spark, sf_dir):
    lb = queries.bands(spark, sf_dir).where("figure_id < 3").localCheckpoint()
    pairs, size = refinement.neighbour_pairs(lb), queries.sheet_size(lb)
    curve = refinement.every_column(refinement.fitted(refinement.crossings(lb, pairs), "bspline", 0.3), size)
    moved = refinement.adjusted(lb, pairs, curve, refinement.separated(curve, size))
    got, said = refinement.refine(lb, "bspline", 0.3)
    assert {(r.strategy, r.boundaries, r.accepted, r.reason) for r in said.collect()} == {("fit", 3, True, None)}
    rows = lambda df: {(r.figure_id, r.y, r.x): r.lbl for r in df.collect()}
    assert rows(got) == rows(moved) != rows(lb)


def test_curves_fitted_together_are_those_fitted_alone():
    rng = np.random.default_rng(3)
    series = [(np.sort(rng.choice(90, n, replace=False)), 5 * rng.normal(size=n).cumsum()) for n in (60, 60, 41, 3)]
    for method, smoothness in (("bspline", 0.3), ("knot_constrained", 0.01), ("quintic", 1e-4)):
        for one, (x, y) in zip(curves.fit_all(series, method, smoothness), series, strict=True):
            assert (one == curves.fit(x, y, method, smoothness)).all()


def test_regions_of_all_labels_are_each_labels_components():
    rng = np.random.default_rng(4)
    for shape in ((1, 1), (1, 9), (9, 1), (17, 23)):
        grid = rng.integers(0, 3, shape)
        label, area = kernels.regions(grid)
        expected = sorted((int(k), int(n)) for k in np.unique(grid) for n in np.bincount(kernels.components(grid == k)[0].ravel())[1:])
        assert sorted(zip(label.tolist(), area.tolist(), strict=True)) == expected


def test_features_without_windows_are_those_of_the_windows(spark, sf_dir):
    px = tables.sheets(spark, sf_dir).where("figure_id < 5").localCheckpoint()
    holes = px.where("figure_id = 1 and (y * 31 + x * 17) % 5 > 0").withColumn("figure_id", F.lit(100).cast("long"))
    dot = px.where("figure_id = 2 and y = 0 and x < 30").withColumn("figure_id", F.lit(101).cast("long"))
    px = px.unionByName(holes).unionByName(dot).unionByName(dot.where("x = 0").withColumn("figure_id", F.lit(102).cast("long")))
    means = engines.figure_means(px)
    assert "Window" not in plan_of(means) and plan_of(means).count("collect_list") > 0
    rows = lambda df: {r.figure_id: r[1:] for r in df.collect()}
    got, expected = rows(features.features_of(means)), rows(features.feature_row(px))
    assert set(got) == set(expected) == {0, 1, 2, 3, 4, 100, 101, 102}
    assert all(a == pytest.approx(b, abs=2e-5) for k in got for a, b in zip(got[k], expected[k], strict=True))
    assert rows(engines.hashes(means)) == rows(features.panel_hash(px))


def test_only_the_strips_of_colour_bars_are_taken_to_lab(spark, sf_dir):
    plan = plan_of(features.strips(tables.sheets(spark, sf_dir)))
    assert any(" OR " in line and ">=" in line for line in plan.splitlines() for word in ("Filter", "ShuffledHashJoin") if word in line)


def test_colour_groups_are_running_means():
    rgb = np.array([[[10, 10, 10], [20, 10, 10], [200, 0, 0], [12, 13, 14]]], float)
    (first, n), (second, m) = seeds.color_groups(rgb)
    assert (n, m) == (3, 1) and np.allclose(first, [14, 11, 34 / 3]) and second.tolist() == [200, 0, 0]
