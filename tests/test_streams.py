"""The attempt log, its windowed rates and feedback as streams."""

import json

from strataframe.streaming import flows


def test_attempts_rates_and_feedback(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = [{"ts": f"2026-01-01T{h:02d}:00:00Z", "engine": e, "outcome": o, "saturation": 0.2, "edge_density": 0.1} for h, e, o in ((1, "a", "success"), (1, "a", "failure"), (2, "b", "success"), (9, "a", "success"))]
    (log / "1.jsonl").write_text("\n".join([json.dumps(r) for r in rows] + ["{ no json"]))

    def run(stream, name, mode):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    # The watermark stands 10 minutes before the latest row, so the last window is still open.
    assert sorted((r.engine, r.n, r.ok) for r in run(flows.engine_rates(flows.attempts(spark, str(log))), "rates", "append")) == [("a", 2, 1), ("b", 1, 1)]
    posts = tmp_path / "posts"
    posts.mkdir()
    (posts / "1.json").write_text("\n".join(map(json.dumps, [{"figure_id": "f1", "text": " two layers "}, {"figure_id": None, "text": "x"}, {"figure_id": "f2", "text": " "}])))
    said = run(flows.feedback(spark.readStream.schema("figure_id string, text string").json(str(posts))), "posts", "append")
    assert sorted((r.status, r.message) for r in said if r.message) == [(200, "【f1】two layers")] and sorted(r.status for r in said) == [200, 400, 400]
