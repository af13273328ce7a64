"""The whole flow of figures, the classifier with all its terms, pictures, and work sets with their report."""

import base64
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.operators import engines, features, memory, overlays, workflow, worksets
from strataframe.plans.queries import QUERIES, workset
from strataframe.sources import tables

SF = "/root/testdata/sf0.001"


def pixels(spark, figures):
    rows = [(k, y, x, *map(int, a[y, x])) for k, a in figures.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "figure_id string, y int, x int, r int, g int, b int").repartition(3)


def conceptual(h=160, w=200, seed=42):
    """Three vivid blocks on a light ground, with dark strokes."""
    rng = np.random.default_rng(seed)
    a = np.full((h, w, 3), 245)
    for k, c in enumerate([(210, 60, 60), (60, 210, 60), (60, 60, 210)]):
        a[10 + k * 45 : 55 + k * 45, 10 : w - 10] = c
    for _ in range(40):
        y, x = rng.integers(10, h - 20), rng.integers(10, w - 30)
        a[y, x : x + 15] = 30
    return a


def test_figures_go_from_panels_to_grids(spark):
    two = np.full((120, 260, 3), 255)
    two[10:110, 10:120], two[10:110, 140:250] = (200, 60, 60), (60, 60, 200)
    two[60:110, 10:120], two[60:110, 140:250] = (60, 200, 60), (200, 200, 60)
    px = pixels(spark, {"concept": conceptual(), "two": two, "small": np.full((30, 30, 3), 99)})
    wanted = spark.createDataFrame([("two", 7)], "figure_id string, target int")
    out = workflow.run(px, wanted=wanted, min_w=50, min_h=50, rejected=())
    figures = {r.figure_id: r for r in out.figures.collect()}
    assert figures["small"].status == "skipped" and figures["small"].reason.startswith("too_small") and figures["small"].n_panels == 0
    assert figures["concept"].status == "ok" and figures["concept"].total_layers >= 2 and figures["concept"].engines
    panels = {(r.figure_id, r.panel_id): r for r in out.panels.collect()}
    mine = [p for k, p in panels.items() if k[0] == "two"]
    if len(mine) == 2:
        assert sorted(p.skipped or "" for p in mine) == ["", "non_target_panel"]
        assert figures["two"].warnings[0].startswith("target_panel_fallback: requested_7_not_found")
        assert any("skipped_non_target" in w for w in figures["two"].warnings)
    kept = {k for k, p in panels.items() if p.skipped is None}
    lb = out.labels.groupBy("figure_id", "panel_id").agg(F.count_distinct(F.when(F.col("lbl") != 0, F.col("lbl"))).alias("n"), F.count(F.lit(1)).alias("pixels"))
    got = {(r.figure_id, r.panel_id): (r.n, r.pixels) for r in lb.collect()}
    assert got.keys() == kept and all(got[k][0] == panels[k].n_layers for k in kept)
    layers = out.layers.collect()
    assert len(layers) == sum(panels[k].n_layers for k in kept)
    assert all(3000 <= r.vp <= 6000 and r.vp > r.vs for r in layers)
    grid = {(r.figure_id, r.panel_id): r["count"] for r in workflow.grid_of(out).groupBy("figure_id", "panel_id").count().collect()}
    assert grid == {k: got[k][1] for k in kept}
    assert workflow.metrics(out).count() == len(kept)


def test_kinds_by_all_terms(spark):
    gapped = np.full((160, 200, 3), 255)
    for x in (0, 75, 150):
        gapped[:, x : x + 40] = (120, 60, 60)
    row = np.repeat(np.linspace(20, 230, 160)[:, None], 200, 1)
    smooth = np.stack([row, row, row], -1).astype(int)
    bar = smooth.copy()
    bar[:, 175:] = np.stack([np.linspace(0, 255, 160), np.linspace(255, 0, 160), np.full(160, 90)], -1)[:, None].astype(int)
    px = pixels(spark, {"gapped": gapped, "smooth": smooth, "bar": bar, "concept": conceptual(), "small": np.full((40, 40, 3), 9)})
    row = features.feature_row(px).join(engines.visual_terms(px), "figure_id").join(features.has_colorbar(px), "figure_id")
    terms = {r.figure_id: r for r in row.collect()}
    assert terms["bar"].has_colorbar and not terms["smooth"].has_colorbar and not terms["small"].has_colorbar
    assert terms["gapped"].gap_score == pytest.approx(2 / 3) and terms["smooth"].gap_score == 0
    got = {r.figure_id: r for r in features.classify_whole(row).collect()}
    assert (got["small"].figure_type, got["small"].confidence, got["small"].reason) == ("other", 0.95, "Image too small")
    assert got["gapped"].figure_type == "multi_panel" and got["gapped"].confidence == pytest.approx(0.8) and "0.67" in got["gapped"].reason
    for name in ("smooth", "bar", "concept"):
        t = terms[name]
        bar_ = 1.0 if t.has_colorbar else 0.0
        one = t.edge_density * 0.15 + t.quantization * 0.2 + (1 - t.gradient_uniformity) * 0.15 + t.text_density * 0.2 - t.striation * 0.5 - bar_ * 0.25
        two = t.gradient_uniformity * 0.25 + bar_ * 0.3 + (1 - t.edge_density) * 0.15 + (1 - t.quantization) * 0.15 + t.striation * 0.35
        want = "conceptual_model" if one > two + 0.15 else "observational_data" if two > one + 0.15 else "other"
        assert got[name].figure_type == want
        assert got[name].confidence == pytest.approx(min(0.9, 0.5 + max(one, two) * 0.4) if want != "other" else 0.6, abs=1e-4)


def test_features_in_one_pass_are_those_of_each(spark):
    px = tables.pixels(spark, SF)
    whole = {r.figure_id: r for r in features.feature_row(px).collect()}
    for f in (features.saturation_ratio, features.edge_density, features.gradient_uniformity, features.striation, features.text_density):
        for r in f(px).collect():
            (name,) = set(r.asDict()) - {"figure_id"}
            assert whole[r.figure_id][name] == pytest.approx(r[name], abs=2e-5)


def test_overlays_and_pictures(spark):
    m = np.array([[0, 0, 0, 0, 0]] * 3 + [[0, 5, 5, 7, 0]] * 4 + [[0, 0, 0, 0, 0]] * 3)
    px = pixels(spark, {"f": np.full((10, 5, 3), 100)})
    lb = spark.createDataFrame([("f", y, x, int(m[y, x])) for y in range(10) for x in range(5)], "figure_id string, y int, x int, lbl int")
    colours = overlays.distinct_colors(3)
    assert len(set(colours)) == 3 and all(max(c) == 242 for c in colours)
    shown = {(r.y, r.x): (r.r, r.g, r.b) for r in overlays.overlay(px, lb).collect()}
    assert shown[0, 0] == (100, 100, 100) and shown[3, 1] == (255, 255, 255)
    masked = {(r.y, r.x): (r.r, r.g, r.b) for r in overlays.overlay(px, lb.withColumn("lbl", F.when(F.col("y") < 5, 1).otherwise(2)), fill="mask", skip_background=False).collect()}
    assert masked[0, 0] == colours[0] and masked[9, 4] == colours[1] and masked[4, 2] == masked[5, 2] == (255, 255, 255)
    (p,) = overlays.pictures(px, most=4).collect()
    raw = base64.b64decode(p.uri.split(",")[1])
    assert raw.startswith(b"\x89PNG") and (p.width, p.height) == (2, 4)
    at = raw.index(b"IDAT")
    assert len(zlib.decompress(raw[at + 4 : at + 4 + int.from_bytes(raw[at - 4 : at], "big")])) == 4 * (1 + 2 * 3)


def test_worksets_keep_every_record(spark, tmp_path):
    sources = spark.createDataFrame([(1, "a/fig 1.v2.png", 0), (1, "b/ß(x).jpg", 1), (2, "plain", 0)], "session_id long, source_path string, ord long")
    new = worksets.create(sources)
    assert {(r.session_id, r.figure_id, r.status) for r in new.collect()} == {(1, "fig_1_v2", "pending"), (1, "ß_x_", "pending"), (2, "plain", "pending")}
    whole = workset(spark, SF)
    back = worksets.from_json(worksets.to_json(whole))
    key = lambda r: (r["session_id"], r["figure_id"])
    a = {key(r): r.asDict(True) for r in whole.drop("ord").collect()}
    assert a == {key(r): r.asDict(True) for r in back.drop("ord").collect()}
    one = json.loads(worksets.to_json(new.where("session_id = 2")).first().json)
    assert one["session_id"] == "2" and one["workset"][0]["classification"] is None and list(one["workset"][0])[:3] == ["figure_id", "source_path", "status"]
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        worksets.from_json(spark.createDataFrame([(1, '{"workset": [')], "session_id long, json string")).collect()

    change = spark.createDataFrame([(1, "fig_1_v2", "classified", ("conceptual_model", 1.7, "r", None))], f"session_id long, figure_id string, status string, classification {worksets.CLASSIFICATION}")
    updated = worksets.clamped(worksets.update(new, change))
    r = {q.figure_id: q for q in updated.collect()}
    assert r["fig_1_v2"].classification.confidence == 1.0 and r["fig_1_v2"].status == "classified" and r["plain"].classification is None
    gone = {q.figure_id: q for q in worksets.backtrack(updated, "panel").collect()}
    assert not gone["fig_1_v2"].refused and gone["plain"].refused and gone["plain"].status == "pending"
    for stage, (drops, needs, status) in worksets.STAGES.items():
        for q in worksets.backtrack(whole, stage).collect():
            assert q.refused == (needs is not None and a[key(q)][needs] is None)
            assert all(q[n] is None for n in drops) if not q.refused else q.status == a[key(q)]["status"]
            assert q.refused or q.status == status

    said = spark.createDataFrame([(k[0], k[1], 2, "second") for k, e in a.items() if e["segmentation"]] + [(k[0], k[1], 1, "first") for k, e in a.items()], "session_id long, figure_id string, at int, text string")
    for q in worksets.feedback(whole, said).collect():
        assert q.segmentation is None or q.segmentation.user_feedback == ["first", "second"]


def test_report_pages(spark, tmp_path):
    e = workset(spark, SF).withColumn("figure_id", F.concat(F.lit('<b>&"'), "figure_id"))
    images = e.select("figure_id", F.lit("data:a").alias("original"), F.lit("data:b").alias("overlay")).distinct()
    pages = worksets.report(e, images)
    counts = {r.session_id: r["count"] for r in e.groupBy("session_id").count().collect()}
    for r in pages.collect():
        assert r.html.count('<div class="card">') == r.html.count('<div class="detail"') == counts[r.session_id]
        assert "<b>" not in r.html and "&lt;b&gt;&amp;&quot;" in r.html and "<broken>" not in r.html
        assert r.html.startswith("<!doctype html>") and r.html.endswith("</html>") and "data:b" in r.html
    worksets.write_reports(pages, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("session_id=*"))) == len(counts)


def test_tables_as_json(spark):
    props = spark.createDataFrame([("f", "red", 6500.0, 3750.0, 2800.0), ("f", "blue", 2500.0, 1500.0, 2100.0)], "figure_id string, name string, vp double, vs double, rho double")
    saved = worksets.properties_json(props)
    assert json.loads(saved.first().json) == {"red": {"Vp": 6500.0, "Vs": 3750.0, "rho": 2800.0}, "blue": {"Vp": 2500.0, "Vs": 1500.0, "rho": 2100.0}}
    lacking = spark.createDataFrame([("g", '{"red": {"Vp": 1.5, "rho": 2}}')], "figure_id string, json string")
    assert [tuple(r) for r in worksets.properties_of(lacking).collect()] == [("g", "red", 1.5, None, 2.0, ["Vs"])]
    log = tables.attempts(spark, SF)
    doc = worksets.templates_json(memory.patterns(log), memory.engine_rates(log))
    body = json.loads(doc.first().json)
    assert body["summary"]["n_patterns"] == len(body["patterns"]) == memory.patterns(log).count()
    assert body["engine_success_rates"] == {r.engine: r.success_rate for r in memory.engine_rates(log).collect()}
    none = worksets.templates_json(memory.patterns(log.where("false")), memory.engine_rates(log.where("false")))
    assert worksets.templates_of(none).count() == 0


def test_registered_flow(spark):
    rows = QUERIES["flow_figures"](spark, SF).collect()
    assert rows and all(r.status == "ok" and r.n_panels >= 1 for r in rows)
