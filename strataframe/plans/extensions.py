"""Detectors, segmenters and reviewers of one's own, callable from SQL over table arguments.

Each kind is a table function of pixels that Spark partitions by figure: a figure's rows reach one
call of the extension as arrays, and its rows of results go on as a relation. ``register`` makes
one of a plain function and gives it a name in SQL:

    register(spark, "my_panels", detector(lambda rgb: [(0, 0, 10, 10, 0.9)]))
    spark.sql("select * from my_panels(table(px))")
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn, SelectedColumn

PIXEL = ("figure_id", "y", "x", "r", "g", "b")
DETECTED = "panel_id int, x int, y int, w int, h int, source string, confidence double"
SEGMENTED = "y int, x int, lbl int"
REVIEWED = "ok boolean, score double, notes string"

#: From a figure's (rows, columns, 3) array and the call's options to result rows.
Extension = Callable[..., Iterable[tuple]]


class Kind:
    """What an extension returns and how its results become rows."""

    def __init__(self, schema: str, run: Extension, rows: Callable[[np.ndarray, Any], Iterable[tuple]]):
        self.schema, self.run, self.rows = schema, run, rows


def detector(run: Extension) -> Kind:
    """``run(rgb)`` gives (x, y, w, h, confidence) boxes; without any, the whole figure is one panel of confidence 0.5."""

    def rows(rgb: np.ndarray, boxes: Any) -> Iterable[tuple]:
        found = list(boxes)
        if not found:
            yield 0, *whole_panel(rgb), "whole_image", 0.5
        for k, (x, y, w, h, confidence) in enumerate(sorted(found, key=lambda b: (b[1], b[0]))):
            yield k, int(x), int(y), int(w), int(h), "extension", float(confidence)

    return Kind(DETECTED, run, rows)


def segmenter(run: Extension) -> Kind:
    """``run(rgb, n_layers=…)`` gives a label map of the figure's shape."""

    def rows(rgb: np.ndarray, labels: Any) -> Iterable[tuple]:
        labels = np.asarray(labels)
        if labels.shape != rgb.shape[:2]:
            raise ValueError(f"labels have shape {labels.shape}, the figure {rgb.shape[:2]}")
        for y, x in np.ndindex(labels.shape):
            yield y, x, int(labels[y, x])

    return Kind(SEGMENTED, run, rows)


def reviewer(run: Extension) -> Kind:
    """``run(rgb)`` gives (ok, score, notes); a score is held between 0 and 1."""

    def rows(rgb: np.ndarray, said: Any) -> Iterable[tuple]:
        ok, score, notes = said
        yield bool(ok), min(1.0, max(0.0, float(score))), str(notes)

    return Kind(REVIEWED, run, rows)


def whole_panel(rgb: np.ndarray) -> tuple[int, int, int, int]:
    return 0, 0, rgb.shape[1], rgb.shape[0]


def register(spark: SparkSession, name: str, kind: Kind) -> None:
    """Makes an extension a table function: name(table(px), option => value, …).

    ``analyze`` asks for the pixel columns alone, partitioned by figure, and gives figure_id the type it
    has. An error in one figure is its own row of nulls with the message in ``error``.
    """
    columns = StructType.fromDDL(kind.schema)
    nulls = (None,) * len(columns)

    @udtf
    class Extended:
        def __init__(self, _analyzed: AnalyzeResult):
            self.pixels: list[tuple] = []
            self.options: dict[str, Any] = {}
            self.figure: Any = None

        @staticmethod
        def analyze(px: AnalyzeArgument, **options: AnalyzeArgument) -> AnalyzeResult:
            if not px.isTable:
                raise ValueError("the first argument is a table of pixels: name(table(px))")
            missing = [c for c in PIXEL if c not in px.dataType.names]
            if missing:
                raise ValueError(f"the table lacks {', '.join(missing)}")
            schema = StructType().add("figure_id", px.dataType["figure_id"].dataType)
            for f in columns:
                schema = schema.add(f)
            return AnalyzeResult(schema.add("error", "string"), partitionBy=[PartitioningColumn("figure_id")], select=[SelectedColumn(c) for c in PIXEL])

        def eval(self, px: Any, **options: Any) -> None:
            self.figure, self.options = px["figure_id"], options
            self.pixels.append(tuple(px[c] for c in PIXEL[1:]))

        def terminate(self) -> Iterable[tuple]:
            if not self.pixels:
                return
            p = np.array(self.pixels)
            y, x = p[:, 0].astype(int), p[:, 1].astype(int)
            rgb = np.zeros((y.max() + 1, x.max() + 1, 3))
            rgb[y, x] = p[:, 2:]
            try:
                out = list(kind.rows(rgb, kind.run(rgb, **self.options)))
            except Exception as e:  # noqa: BLE001  one figure's failure isn't the query's
                yield self.figure, *nulls, str(e)
                return
            for row in out:
                yield self.figure, *row, None

    spark.udtf.register(name, Extended)
