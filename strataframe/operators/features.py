"""Figure features over the pixel relation; every operator groups or windows by figure alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from strataframe.functions import colors



def rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


def across() -> WindowSpec:
    """A row of pixels from the left."""
    return Window.partitionBy("figure_id", "y").orderBy("x")


def down() -> WindowSpec:
    """A column of pixels from the top."""
    return Window.partitionBy("figure_id", "x").orderBy("y")


def shape(px: DataFrame) -> DataFrame:
    return px.groupBy("figure_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def beside(px: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """Pixels joined to their figure's few rows of ``facts``, which each task hashes for its own figures.

    By size alone the planner might send either side whole to the driver, or sort the pixels.
    """
    return px.join(facts.hint("shuffle_hash"), "figure_id", how)


def with_shape(px: DataFrame) -> DataFrame:
    """A figure's size beside each pixel."""
    return beside(px, shape(px))


def saturation_ratio(px: DataFrame, threshold: int = 80) -> DataFrame:
    return px.groupBy("figure_id").agg(F.round(F.avg(F.when(colors.saturation(*rgb()) > threshold, 1.0).otherwise(0.0)), 6).alias("saturation_ratio"))


def is_grayscale(px: DataFrame, threshold: float = 15.0) -> DataFrame:
    mean = F.avg(colors.saturation(*rgb()))
    return px.groupBy("figure_id").agg(F.round(mean, 6).alias("mean_saturation"), (mean < threshold).alias("is_grayscale"))


def background_color(px: DataFrame) -> DataFrame:
    """The median colour of the corners and the centre, truncated."""
    p = with_shape(px)
    corner = F.col("y").isin(0) | (F.col("y") == F.col("h") - 1)
    side = F.col("x").isin(0) | (F.col("x") == F.col("w") - 1)
    centre = (F.col("y") == F.floor(F.col("h") / 2)) & (F.col("x") == F.floor(F.col("w") / 2))
    return p.where((corner & side) | centre).groupBy("figure_id").agg(*[F.median(c).cast("int").alias(f"bg_{c}") for c in "rgb"])


def panel_hash(px: DataFrame, modulus: int = 4) -> DataFrame:
    """Sum of a 4 x 4 grid's channels between the quarters, plus 7h + 13w, modulo ``modulus``."""
    p = with_shape(px)
    at = lambda n: F.array(*[F.expr(f"cast(floor({n} div 4 + (3 * {n} div 4 - {n} div 4) * {i} / 3.0) as long)") for i in range(4)])
    grid = p.where(F.array_contains(at("h"), F.col("y").cast("long")) & F.array_contains(at("w"), F.col("x").cast("long")))
    return grid.groupBy("figure_id", "h", "w").agg(F.sum(F.col("r") + F.col("g") + F.col("b")).alias("s")).select("figure_id", ((F.col("s") + 7 * F.col("h") + 13 * F.col("w")) % modulus).cast("long").alias("panel_hash"))


def gradients(px: DataFrame, value: Column) -> DataFrame:
    """gx and gy: central differences, one-sided at the borders."""
    v = px.withColumn("v", value)
    def d(w):
        a, b = F.lag("v").over(w), F.lead("v").over(w)
        return F.when(a.isNull(), b - F.col("v")).when(b.isNull(), F.col("v") - a).otherwise((b - a) / 2.0)
    return v.withColumns({"gx": d(across()), "gy": d(down())})


def sobel(px: DataFrame, value: Column) -> DataFrame:
    """``edge``: separable [1 2 1] / 4 and [1 0 -1], borders repeated, sqrt((h² + v²) / 2)."""
    near = lambda c, w: (F.coalesce(F.lag(c).over(w), F.col(c)), F.coalesce(F.lead(c).over(w), F.col(c)))
    smooth = lambda c, w: (near(c, w)[0] + 2 * F.col(c) + near(c, w)[1]) / 4.0
    step = lambda c, w: near(c, w)[0] - near(c, w)[1]
    p = px.withColumn("v", value).withColumns({"sx": smooth("v", across()), "dx": step("v", across())})
    p = p.withColumns({"hh": step("sx", down()), "vv": smooth("dx", down())})
    return p.withColumn("edge", F.sqrt((F.col("hh") * F.col("hh") + F.col("vv") * F.col("vv")) / 2.0))


def edge_density(px: DataFrame, threshold: float = 0.05) -> DataFrame:
    e = sobel(px, colors.gray(*rgb()))
    return e.groupBy("figure_id").agg(F.round(F.avg(F.when(F.col("edge") > threshold, 1.0).otherwise(0.0)), 6).alias("edge_density"))


def noise_level(px: DataFrame) -> DataFrame:
    """On the 0 to 255 scale, times 1.5, at most 1, rounded to 4 places."""
    e = sobel(px, colors.gray(*rgb()) * 255.0)
    share = F.avg(F.when(F.col("edge") > 0.05, 1.0).otherwise(0.0)) * 1.5
    return e.groupBy("figure_id").agg(F.round(F.least(F.lit(1.0), share), 4).alias("noise_level"))


def gradient_uniformity(px: DataFrame) -> DataFrame:
    g = gradients(px, colors.gray(*rgb())).withColumn("m", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    out = g.groupBy("figure_id").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"))
    score = F.when(F.col("mean") < 1e-9, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("sd") / F.col("mean") / 3.0))
    return out.select("figure_id", F.round(score, 5).alias("gradient_uniformity"))


def striation(px: DataFrame) -> DataFrame:
    g = gradients(px, colors.gray(*rgb()))
    flat = F.when((F.abs("gy") > 0.05) & (F.abs("gx") < 0.03), 1.0).otherwise(0.0)
    return g.groupBy("figure_id").agg(F.round(F.least(F.lit(1.0), F.avg(flat) * 3.0), 5).alias("striation"))


def text_density(px: DataFrame) -> DataFrame:
    p = px.withColumn("v", colors.gray(*rgb()))
    p = p.withColumn("d", F.abs(F.col("v") - F.lag("v").over(across())))
    out = p.groupBy("figure_id").agg(F.avg("d").alias("d"), (F.max("y") + 1).alias("h"))
    return out.select("figure_id", F.round(F.when(F.col("h") < 20, 0.0).otherwise(F.least(F.lit(1.0), F.col("d") / 0.15)), 5).alias("text_density"))


def quality_check(px: DataFrame, min_size: int = 100, max_blank: float = 0.95, min_edge: float = 0.005) -> DataFrame:
    """Why a figure is refused: too small, blank, or without edges; the first reason counts."""
    e = sobel(px, colors.gray(*rgb())).groupBy("figure_id").agg(
        (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"),
        F.avg(F.when(F.col("v") > 0.97, 1.0).otherwise(0.0)).alias("blank"), F.avg(F.when(F.col("edge") > 0.05, 1.0).otherwise(0.0)).alias("edges"),
    )
    why = F.when(F.least("h", "w") < min_size, "too_small").when(F.col("blank") > max_blank, "mostly_blank").when(F.col("edges") < min_edge, "no_edges").otherwise("")
    return e.select("figure_id", "h", "w", F.round("blank", 5).alias("blank_ratio"), F.round("edges", 5).alias("edge_ratio"), why.alias("reason"), (why == "").alias("ok"))


def feature_row(px: DataFrame) -> DataFrame:
    """All features of a figure in one pass: rows of pixels, then columns, then one aggregate by figure.

    Each feature alone would read the pixels again; here a pixel's neighbours along its row and its
    column are found once for all.
    """
    row, col = across(), down()
    p = px.withColumn("v", colors.gray(*rgb())).withColumns({"l": F.lag("v").over(row), "r_": F.lead("v").over(row)})
    left, right = F.coalesce("l", "v"), F.coalesce("r_", "v")
    p = p.withColumns({"sx": (left + 2 * F.col("v") + right) / 4.0, "dx": left - right})
    near = {f"{n}_{c}": f(c).over(col) for c in ("v", "sx", "dx") for n, f in (("up", F.lag), ("dn", F.lead))}
    p = p.withColumns(near)
    side = lambda n, c: F.coalesce(f"{n}_{c}", c)
    hh, vv = side("up", "sx") - side("dn", "sx"), (side("up", "dx") + 2 * F.col("dx") + side("dn", "dx")) / 4.0
    central = lambda a, b: F.when(F.col(a).isNull(), F.col(b) - F.col("v")).when(F.col(b).isNull(), F.col("v") - F.col(a)).otherwise((F.col(b) - F.col(a)) / 2.0)
    p = p.withColumns({"edge": F.sqrt((hh * hh + vv * vv) / 2.0), "gx": central("l", "r_"), "gy": central("up_v", "dn_v")})
    p = p.withColumn("m", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    a = p.groupBy("figure_id").agg(
        (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), share(colors.saturation(*rgb()) > 80).alias("vivid"),
        share(F.col("edge") > 0.05).alias("edges"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"),
        share((F.abs("gy") > 0.05) & (F.abs("gx") < 0.03)).alias("striped"), F.avg(F.abs(F.col("v") - F.col("l"))).alias("d"),
    )
    return features_of(a)


def features_of(a: DataFrame) -> DataFrame:
    """A figure's features from its means over pixels: vivid, edges, mean and sd of the gradient, striped, d along rows."""
    even = F.when(F.col("mean") < 1e-9, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("sd") / F.col("mean") / 3.0))
    text = F.when(F.col("h") < 20, 0.0).otherwise(F.least(F.lit(1.0), F.col("d") / 0.15))
    return a.select(
        "figure_id", "h", "w", F.round("vivid", 6).alias("saturation_ratio"), F.round("edges", 6).alias("edge_density"), F.round(even, 5).alias("gradient_uniformity"),
        F.round(F.least(F.lit(1.0), F.col("striped") * 3.0), 5).alias("striation"), F.round(text, 5).alias("text_density"),
    )


def has_colorbar(px: DataFrame) -> DataFrame:
    """(figure_id, has_colorbar): whether the right or the bottom strip varies in colour and lightness; small figures have none.

    The limits are fixed values.
    """
    p = with_shape(px)
    l, a, b = colors.lab(*rgb())
    wide = F.greatest(F.lit(20), F.floor(F.col("w") / 10)), F.greatest(F.lit(20), F.floor(F.col("h") / 10))
    strips = {"r": F.col("x") >= F.col("w") - wide[0], "b": F.col("y") >= F.col("h") - wide[1]}
    # Only the strips' pixels are taken to LAB; each figure has some in both.
    p = p.where(strips["r"] | strips["b"]).select("figure_id", "h", "w", l.alias("ll"), a.alias("aa"), b.alias("bb"), *[s.alias(f"in_{n}") for n, s in strips.items()])
    sd = lambda n, c: F.stddev_pop(F.when(F.col(f"in_{n}"), F.col(c)))
    s = p.groupBy("figure_id").agg(F.first("h").alias("h"), F.first("w").alias("w"), *[sd(n, c).alias(f"{n}_{c}") for n in strips for c in ("ll", "aa", "bb")])
    rich = lambda n: ((F.col(f"{n}_aa") + F.col(f"{n}_bb")) / 2 > 10) & (F.col(f"{n}_ll") > 8)
    return s.select("figure_id", ((F.col("w") >= 100) & (F.col("h") >= 100) & (rich("r") | rich("b"))).alias("has_colorbar"))


def classify_whole(features: DataFrame) -> DataFrame:
    """(figure_id, figure_type, confidence, reason) by all terms: the features, quantization, gap_score and has_colorbar.

    Several wide gaps make a figure multi_panel, or observational_data where stripes run across it;
    else the conceptual and the observational score must differ by more than 0.15. Weights, limits
    and the texts of reasons are fixed values.
    """
    c = F.col
    bar = F.when(c("has_colorbar"), 1.0).otherwise(0.0)
    concept = c("edge_density") * 0.15 + c("quantization") * 0.20 + (1 - c("gradient_uniformity")) * 0.15 + c("text_density") * 0.20 - c("striation") * 0.50 - bar * 0.25
    observed = c("gradient_uniformity") * 0.25 + bar * 0.3 + (1 - c("edge_density")) * 0.15 + (1 - c("quantization")) * 0.15 + c("striation") * 0.35
    f = features.withColumns({"s1": concept, "s2": observed})
    two = lambda *v: [F.format_string("%.2f", x) for x in v]
    say = lambda text, *v: F.format_string(text, *two(*v))
    gapped = c("gap_score") >= 0.5
    least = lambda top, v: F.least(F.lit(top), v)
    cases = [
        (F.least("h", "w") < 50, "other", F.lit(0.95), F.lit("Image too small")),
        (gapped & (c("striation") >= 0.15), "observational_data", least(0.9, 0.6 + c("gap_score") * 0.2), say("Multi-gap figure with horizontal striations (gap=%s, striation=%s) suggests waveform data", c("gap_score"), c("striation"))),
        (gapped, "multi_panel", least(0.95, 0.6 + c("gap_score") * 0.3), say("Detected %s wide panel gaps", c("gap_score"))),
        (c("s1") > c("s2") + 0.15, "conceptual_model", least(0.9, 0.5 + c("s1") * 0.4), say("High edge density (%s) and color quantization (%s) suggest schematic/conceptual diagram", c("edge_density"), c("quantization"))),
        (c("s2") > c("s1") + 0.15, "observational_data", least(0.9, 0.5 + c("s2") * 0.4), F.format_string("Smooth gradients (uniformity=%s) and colorbar=%s suggest data-driven figure", *two(c("gradient_uniformity")), F.initcap(c("has_colorbar").cast("string")))),
    ]
    last = ("other", F.lit(0.6), say("Ambiguous: conceptual_score=%s, observational_score=%s", c("s1"), c("s2")))
    pick = lambda k, other: F.coalesce(*[F.when(when, F.lit(v[k]) if isinstance(v[k], str) else v[k]) for when, *v in cases], other)
    return f.select("figure_id", pick(0, F.lit(last[0])).alias("figure_type"), F.round(pick(1, last[1]), 4).alias("confidence"), pick(2, last[2]).alias("reason"))


def classify(features: DataFrame) -> DataFrame:
    """Conceptual or observational by weighted scores that must differ by 0.15, else other."""
    c = F.col
    conceptual = c("edge_density") * 0.15 + (1 - c("gradient_uniformity")) * 0.15 + c("text_density") * 0.20 - c("striation") * 0.50
    observed = c("gradient_uniformity") * 0.25 + (1 - c("edge_density")) * 0.15 + c("striation") * 0.35
    f = features.withColumns({"s1": F.round(conceptual, 4), "s2": F.round(observed, 4)})
    kind = F.when(F.least("h", "w") < 50, "other").when(c("s1") >= c("s2") + 0.15, "conceptual").when(c("s2") >= c("s1") + 0.15, "observational").otherwise("other")
    return f.select("figure_id", c("s1").alias("conceptual_score"), c("s2").alias("observational_score"), kind.alias("figure_type"))


def complexity(features: DataFrame) -> DataFrame:
    c = F.col
    score = c("edge_density") * 0.5 + c("saturation_ratio") * 0.3 + (1 - c("gradient_uniformity")) * 0.2
    return features.select("figure_id", F.round(F.when(F.least("h", "w") < 10, 0.0).otherwise(score), 4).alias("complexity"))


def best_panel(scores: DataFrame, by: str) -> DataFrame:
    """Of each group the figure of the highest complexity, the first of equals."""
    return scores.groupBy(by).agg(F.max_by("figure_id", F.struct("complexity", -F.col("figure_id"))).alias("figure_id"), F.max("complexity").alias("complexity"))


def route(features: DataFrame, hashes: DataFrame, preference: str = "balanced", has_colorbar: bool = False, velocity_model: bool = True) -> DataFrame:
    """The engine of each figure, by its saturation; vivid figures take turns by their hash."""
    turns = {"balanced": ["kmeans_full", "edge_guided", "edge_grow"], "best": ["ensemble", "kmeans_full", "edge_guided", "edge_grow"]}.get(preference, ["v4_kmeans"])
    s = F.col("saturation_ratio")
    pick = F.element_at(F.array(*map(F.lit, turns)), (F.col("panel_hash") % len(turns) + 1).cast("int"))
    engine = F.when(s < 0.005, "grayscale_agglomerative").when(s < 0.1, "v4_kmeans_colorbar" if has_colorbar else "v4_kmeans_pastel").when(s < 0.5, "v4_kmeans").otherwise(pick)
    return features.join(hashes, "figure_id").select("figure_id", (engine if velocity_model else F.lit("skip")).alias("engine"))


# The engine that follows one which found too few layers.
RETRY = {
    "grayscale_agglomerative": "v4_kmeans",
    "v4_kmeans_pastel": "v4_kmeans_colorbar",
    "v4_kmeans_colorbar": "kmeans_full",
    "v4_kmeans": "edge_guided",
    "edge_guided": "edge_grow",
    "edge_grow": "kmeans_full",
    "kmeans_full": "edge_guided",
}


def retry_engine(routed: DataFrame, layers: DataFrame) -> DataFrame:
    """Figures of fewer than two layers go to the next engine once."""
    chain = F.create_map(*[F.lit(x) for kv in RETRY.items() for x in kv])
    few = F.col("n_layers") < 2
    return routed.join(layers, "figure_id").select("figure_id", "engine", "n_layers", F.when(few, chain[F.col("engine")]).alias("retry_engine"))


def histogram_peaks(px: DataFrame, bins: int = 25, least: float = 0.02, top: int = 8) -> DataFrame:
    """Gray bins of two hundredths of a figure or more, the background's neighbours left out: the eight largest."""
    p = px.withColumn("bin", F.expr(f"least({bins - 1}, cast(floor(cast((r + g + b) / 3.0 as int) * {bins} / 256.0) as int))"))
    c = p.groupBy("figure_id", "bin").agg(F.count(F.lit(1)).alias("n"), *[F.median(x).cast("int").alias(f"m{x}") for x in "rgb"])
    f = Window.partitionBy("figure_id")
    centre = lambda b: (b + 0.5) * 256.0 / bins
    c = c.withColumns({"total": F.sum("n").over(f), "mode": F.max_by("bin", F.struct("n", -F.col("bin"))).over(f)})
    c = c.where((F.col("n") >= least * F.col("total")) & (F.abs(centre(F.col("bin")) - centre(F.col("mode"))) > 30))
    rank = F.row_number().over(f.orderBy(F.desc("n"), "bin"))
    return c.withColumn("rank", rank).where(F.col("rank") <= top).select("figure_id", "rank", "bin", "n", "mr", "mg", "mb")


def lab_stats(px: DataFrame) -> DataFrame:
    ll, a, b = colors.lab(*rgb())
    p = px.select("figure_id", ll.alias("l"), a.alias("a"), b.alias("bb"))
    return p.groupBy("figure_id").agg(*[F.round(f(c), 3).alias(n) for c, n, f in (("l", "l_mean", F.avg), ("l", "l_std", F.stddev_pop), ("a", "a_std", F.stddev_pop), ("bb", "b_std", F.stddev_pop))])


def strips(px: DataFrame) -> DataFrame:
    """Score of every colour-bar candidate: the mean spread of a* and b* over 40; the first above 0.3 is the bar."""
    p = with_shape(px)
    _, a, b = colors.lab(*rgb())
    size = F.greatest(F.lit(4), F.floor(F.least("h", "w") / 10))
    where = {"top": F.col("y") < size, "bottom": F.col("y") >= F.col("h") - size, "right": F.col("x") >= F.col("w") - size, "left": F.col("x") < size}
    # Only the strips' pixels are taken to LAB.
    p = p.where(where["top"] | where["bottom"] | where["right"] | where["left"])
    marked = p.select("figure_id", a.alias("a"), b.alias("bb"), F.explode(F.array_compact(F.array(*[F.when(w, F.struct(F.lit(i).alias("ord"), F.lit(n).alias("strip"))) for i, (n, w) in enumerate(where.items())]))).alias("s"))
    out = marked.groupBy("figure_id", "s.ord", "s.strip").agg(F.round(F.least(F.lit(1.0), (F.stddev_pop("a") + F.stddev_pop("bb")) / 2 / 40), 4).alias("score"))
    return out


def colorbar(px: DataFrame) -> DataFrame:
    found = strips(px).where("score > 0.3").groupBy("figure_id").agg(F.min_by(F.struct("strip", "score"), "ord").alias("s"))
    return shape(px).join(found, "figure_id", "left").select("figure_id", F.coalesce("s.strip", F.lit("none")).alias("strip"), F.coalesce("s.score", F.lit(0.0)).alias("score"))


def colorbar_samples(px: DataFrame, k: int = 5) -> DataFrame:
    """k colours along the left column's strip, from 5 to 95 hundredths of it."""
    p = with_shape(px)
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(i.alias("i"), F.floor(F.floor(F.col("h") * 0.05) + (F.floor(F.col("h") * 0.95) - 1 - F.floor(F.col("h") * 0.05)) * i / (k - 1)).cast("long").alias("at")))
    want = shape(px).select("figure_id", F.explode(at).alias("s")).select("figure_id", "s.i", F.col("s.at").alias("y"))
    return p.where("x = 0").join(want, ["figure_id", "y"]).select("figure_id", "i", "y", "r", "g", "b")
