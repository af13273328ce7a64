"""Pictures of label maps: vivid layers over the figure, white borders, and small pictures for a report."""

from __future__ import annotations

import base64
import colorsys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.operators import engines, labels
from strataframe.operators.features import across, beside, down, shape
from strataframe.sources import files

#: How much of a layer's colour each fill shows.
FILLS = {"blend": 0.65, "solid": 0.85, "mask": 1.0}


def distinct_colors(n: int, saturation: float = 0.88, value: float = 0.95) -> list[tuple[int, int, int]]:
    """Vivid colours whose hues lie a golden ratio of the circle apart, the first one after 0.08."""
    step = (5**0.5 - 1) / 2
    return [tuple(int(c * 255) for c in colorsys.hsv_to_rgb((0.08 + step * (k + 1)) % 1.0, saturation, value)) for k in range(n)]


def overlay(px: DataFrame, lb: DataFrame, fill: str = "blend", alpha: float | None = None, skip_background: bool = True, most: int = 64) -> DataFrame:
    """(figure_id, y, x, r, g, b): the figure with each layer in its own colour and white borders between layers.

    A figure's labels take the colours in their order, gray beyond ``most``; its background label keeps the
    figure's pixels and has no border of its own. "mask" shows the layers alone on dark gray.
    """
    share = FILLS[fill] if alpha is None or fill != "blend" else alpha
    palette = F.array(*[F.array(*map(F.lit, c)) for c in distinct_colors(most)])
    gray = F.array(*[F.lit(128)] * 3)
    place = lb.select("figure_id", "lbl").distinct().withColumn("k", F.row_number().over(Window.partitionBy("figure_id").orderBy("lbl")))
    back = labels.background_label(lb).select("figure_id", F.col("background_label").alias("back")) if skip_background else None
    near = [f("lbl").over(w) for w in (across(), down()) for f in (F.lag, F.lead)]
    edge = F.coalesce(F.exists(F.array(*near), lambda v: v != F.col("lbl")), F.lit(False))
    m = lb.select("figure_id", "y", "x", "lbl").withColumn("edge", edge).join(place, ["figure_id", "lbl"])
    m = m.join(back, "figure_id", "left") if back is not None else m.withColumn("back", F.lit(None).cast("int"))
    p = px.select("figure_id", "y", "x", "r", "g", "b").join(m, ["figure_id", "y", "x"])
    is_back = F.coalesce(F.col("lbl") == F.col("back"), F.lit(False))
    own = F.coalesce(F.get(palette, F.col("k") - 1), gray)

    def channel(k: int, c: str):
        base = F.lit(32) if fill == "mask" else F.col(c)
        mixed = F.get(own, F.lit(k)) if fill == "mask" else F.floor(F.col(c) * (1 - share) + F.get(own, F.lit(k)) * share)
        return F.when(~is_back & F.col("edge"), 255).when(is_back, base).otherwise(mixed).cast("int").alias(c)

    return p.select("figure_id", "y", "x", *[channel(k, c) for k, c in enumerate("rgb")])


def pictures(px: DataFrame, most: int = 300) -> DataFrame:
    """(figure_id, width, height, uri): each figure as a PNG in a data address, at most ``most`` pixels wide and high.

    Every ``step``-th pixel of every ``step``-th row is shown, and only these go to Python; a figure's last row
    goes too, so that one which lacks them all has a picture.
    """
    step = F.greatest(F.lit(1), F.expr(f"(greatest(h, w) + {most - 1}) div {most}"))
    shown = beside(px, shape(px).withColumn("step", step)).where("(y % step = 0 and x % step = 0) or y = h - 1")

    def run(t: pa.Table) -> pa.Table:
        h, w, step = (t.column(c)[0].as_py() for c in ("h", "w", "step"))
        y, x = t.column("y").to_numpy(), t.column("x").to_numpy()
        on = (y % step == 0) & (x % step == 0)
        small = np.zeros((-(-h // step), -(-w // step), 3))
        for k, c in enumerate("rgb"):
            small[y[on] // step, x[on] // step, k] = t.column(c).to_numpy()[on]
        small = small.clip(0, 255).astype(np.uint8)
        uri = "data:image/png;base64," + base64.b64encode(files.png(small)).decode()
        return pa.table({"width": pa.array([small.shape[1]], pa.int32()), "height": pa.array([small.shape[0]], pa.int32()), "uri": pa.array([uri])})

    return shown.select("figure_id", "y", "x", "r", "g", "b", "h", "w", "step").transform(engines.per_figure, run, "width int, height int, uri string")
