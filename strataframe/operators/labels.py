"""Operators over label maps (figure_id, y, x, lbl)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions import colors
from strataframe.operators.features import across, down, sobel, with_shape

KEYS = ["figure_id", "y", "x"]

# The names of a palette's colours by rising hue, and six colours to label with.
HUE_NAMES = ["red", "orange", "yellow", "green", "blue", "purple"]
PALETTE = [(200, 60, 60), (220, 140, 50), (210, 200, 70), (70, 180, 90), (60, 90, 200), (140, 70, 170)]


def nearest_palette(px: DataFrame, palette: list[tuple[int, int, int]] = PALETTE, space: str = "rgb") -> DataFrame:
    """The nearest palette entry of each pixel, the first of equals: an array's minimum, so nothing is shuffled."""
    if space == "lab":
        own = list(colors.lab(F.col("r"), F.col("g"), F.col("b")))
        other = [list(colors.lab(*[F.lit(float(v)) for v in c])) for c in palette]
    else:
        own, other = [F.col(c).cast("double") for c in "rgb"], [[F.lit(float(v)) for v in c] for c in palette]
    d = F.array(*[F.round(colors.distance(own, o), 6) for o in other])
    return px.withColumn("d", d).select(*KEYS, "r", "g", "b", (F.array_position("d", F.array_min("d")) - 1).cast("int").alias("lbl"))


def reorder_by_median_row(lb: DataFrame, base: int = 0) -> DataFrame:
    """Labels renumbered from the top by their median row, ties by the old label; negatives become -1."""
    med = lb.where("lbl >= 0").groupBy("figure_id", "lbl").agg(F.median("y").alias("med"))
    rank = F.row_number().over(Window.partitionBy("figure_id").orderBy("med", "lbl")) - 1 + base
    return lb.join(med.select("figure_id", "lbl", rank.alias("new")), ["figure_id", "lbl"], "left").select(*KEYS, F.coalesce("new", F.lit(-1)).alias("lbl"))


def kmeans_rounds(px: DataFrame, palette: list[tuple[int, int, int]] = PALETTE, rounds: int = 3) -> DataFrame:
    """Lloyd's rounds per figure from a given palette; an empty cluster keeps its centre.

    A figure's distinct colours with their counts are one array; all rounds run over it in one
    projection, so that work goes with colours, not pixels, and the plan doesn't grow with rounds.
    The labels are those from before the last update of the centres.
    """
    centre = lambda values: F.struct(*[v.alias(c) for c, v in zip("rgb", values, strict=True)])
    first = F.array(*[centre([F.lit(float(v)) for v in p]) for p in palette])

    def nearest(p, cs):
        d = F.transform(cs, lambda c: F.round((p.r - c.r) * (p.r - c.r) + (p.g - c.g) * (p.g - c.g) + (p.b - c.b) * (p.b - c.b), 6))
        return F.array_position(d, F.array_min(d))

    def moved(cs, _):
        owned = F.transform("colors", lambda p: F.struct(p.r.alias("r"), p.g.alias("g"), p.b.alias("b"), p.n.alias("n"), nearest(p, cs).alias("k")))

        def means(c, i):
            zero = F.struct(*[F.lit(0).cast("long").alias(v) for v in ("n", "r", "g", "b")])
            add = lambda a, p: F.struct((a.n + p.n).alias("n"), *[(a[v] + p.n * p[v]).alias(v) for v in "rgb"])
            mean = lambda s: F.when(s.n > 0, centre([F.round(s[v] / s.n, 6) for v in "rgb"])).otherwise(c)
            return F.aggregate(F.filter(F.col("owned"), lambda p: p.k == i + 1), zero, add, mean)

        return owned, means

    counted = px.groupBy("figure_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    # The rounds are work, not bytes: by size alone all figures would go to one task.
    counted = counted.repartition(int(px.sparkSession.conf.get("spark.sql.shuffle.partitions")), "figure_id")
    per = counted.groupBy("figure_id").agg(F.collect_list(F.struct("r", "g", "b", "n")).alias("colors")).withColumn("cs", first)
    for _ in range(rounds - 1):
        owned, means = moved(F.col("cs"), None)
        per = per.withColumn("owned", owned).withColumn("cs", F.transform("cs", means)).drop("owned")
    out = px.join(per.select("figure_id", "cs"), "figure_id")
    return out.select(*KEYS, nearest(F.struct("r", "g", "b"), F.col("cs")).cast("int").alias("lbl")).withColumn("lbl", F.col("lbl") - 1)


def map_to_common(palette: DataFrame, common: DataFrame) -> DataFrame:
    """(figure_id, lbl, mapped): nearest entry of a common palette, the lowest of equals; both sides are a few rows a figure."""
    d = F.round(colors.distance([F.col(c) for c in "rgb"], [F.col(f"c{c}") for c in "rgb"]), 6)
    return palette.crossJoin(F.broadcast(common)).groupBy("figure_id", "lbl").agg(F.min_by("k", F.struct(d, "k")).alias("mapped"))


def weighted_vote(votes: DataFrame) -> DataFrame:
    """(figure_id, y, x, lbl) of (…, lbl, weight): the label of the largest sum, the lowest of equals."""
    sums = votes.groupBy(*KEYS, "lbl").agg(F.round(F.sum("weight"), 6).alias("s"))
    return sums.groupBy(*KEYS).agg(F.max_by("lbl", F.struct("s", -F.col("lbl"))).alias("lbl"), F.max("s").alias("votes"))


def consistency(lb: DataFrame) -> DataFrame:
    """The share of pixels whose four neighbours, the far side's at a border, have their label."""
    p = with_shape(lb)
    def ring(w):
        full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before = F.coalesce(F.lag("lbl").over(w), F.last("lbl").over(full))
        return (before == F.col("lbl")) & (F.coalesce(F.lead("lbl").over(w), F.first("lbl").over(full)) == F.col("lbl"))
    return p.withColumn("same", ring(across()) & ring(down())).groupBy("figure_id").agg(F.round(F.avg(F.when(F.col("same"), 1.0).otherwise(0.0)), 6).alias("consistency"))


def boundaries(lb: DataFrame) -> DataFrame:
    """A flag for pixels of which some neighbour inside the image has another label."""
    other = F.lit(False)
    for w in (across(), down()):
        for near in (F.lag("lbl").over(w), F.lead("lbl").over(w)):
            other = other | F.coalesce(near != F.col("lbl"), F.lit(False))
    return lb.withColumn("is_boundary", other)


def boundary_alignment(lb: DataFrame) -> DataFrame:
    """The share of boundary pixels on an edge of the image; 0 where there are none."""
    e = sobel(lb, colors.gray(F.col("r"), F.col("g"), F.col("b")))
    on = F.avg(F.when(F.col("is_boundary"), F.when(F.col("edge") > 0.05, 1.0).otherwise(0.0)))
    return boundaries(e).groupBy("figure_id").agg(F.round(F.coalesce(on, F.lit(0.0)), 6).alias("boundary_alignment"))


def region_stats(lb: DataFrame) -> DataFrame:
    """Area, share and box of each label but 0."""
    n = lb.groupBy("figure_id").agg(F.count(F.lit(1)).alias("n"))
    s = lb.where("lbl <> 0").groupBy("figure_id", "lbl").agg(F.count(F.lit(1)).alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return s.join(n, "figure_id").select("figure_id", "lbl", "area", F.round(F.col("area") / F.col("n"), 4).alias("fraction"), "x0", "y0", "x1", "y1")


def noise_regions(lb: DataFrame) -> DataFrame:
    """Labels whose box is very long and small, or a strip along a border."""
    s = region_stats(lb).join(lb.groupBy("figure_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")), "figure_id")
    bw, bh = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    aspect = F.greatest(bw, bh) / F.least(bw, bh)
    touches = (F.col("x0") < F.col("w") * 0.05) | (F.col("x1") > F.col("w") * 0.95) | (F.col("y0") < F.col("h") * 0.05) | (F.col("y1") > F.col("h") * 0.95)
    kind = F.when((aspect > 8) & (F.col("fraction") < 0.15), "extreme_aspect").when(touches & ((aspect > 3) | (F.col("fraction") < 0.05)), "border_strip")
    return s.withColumn("noise", kind).where("noise is not null").select("figure_id", "lbl", F.round(aspect, 4).alias("aspect"), "fraction", "noise")


def background_label(lb: DataFrame) -> DataFrame:
    """The label with the largest product of its share of the border and of the area, if both are large enough."""
    p = with_shape(lb).withColumn("rim", F.col("y").isin(0) | F.col("x").isin(0) | (F.col("y") == F.col("h") - 1) | (F.col("x") == F.col("w") - 1))
    s = p.groupBy("figure_id", "lbl").agg(F.count(F.lit(1)).alias("n"), F.count_if("rim").alias("e"))
    f = Window.partitionBy("figure_id")
    s = s.withColumns({"area": F.col("n") / F.sum("n").over(f), "edge": F.col("e") / F.sum("e").over(f)})
    s = s.where("edge > 0.25 and area > 0.08").withColumn("score", F.round(F.col("edge") * F.col("area"), 6))
    return s.groupBy("figure_id").agg(F.max_by("lbl", F.struct("score", -F.col("lbl"))).alias("background_label"), F.max("score").alias("score"))


def n_layers(lb: DataFrame) -> DataFrame:
    return lb.groupBy("figure_id").agg(F.count_distinct(F.when(F.col("lbl") != 0, F.col("lbl"))).alias("n_layers"))


def palette_median(lb: DataFrame) -> DataFrame:
    """The median colour of each label, named by its place."""
    p = lb.groupBy("figure_id", "lbl").agg(*[F.median(c).alias(c) for c in "rgb"])
    return p.select("figure_id", "lbl", "r", "g", "b", F.concat(F.lit("region_"), F.row_number().over(Window.partitionBy("figure_id").orderBy("lbl")) - 1).alias("name"))


def neighbours(lb: DataFrame) -> DataFrame:
    """(figure_id, lbl, next): each pixel's label with those to its right and below."""
    p = lb.withColumns({"right": F.lead("lbl").over(across()), "below": F.lead("lbl").over(down())})
    return p.select("figure_id", "lbl", F.explode(F.array("right", "below")).alias("next")).where("next is not null")


def broken_pairs(lb: DataFrame) -> DataFrame:
    """Layers next to each other by median row, and whether any of their pixels touch."""
    med = lb.where("lbl <> 0").groupBy("figure_id", "lbl").agg(F.median("y").alias("med"))
    order = Window.partitionBy("figure_id").orderBy("med", "lbl")
    pairs = med.select("figure_id", F.col("lbl").alias("top"), F.lead("lbl").over(order).alias("bot")).where("bot is not null")
    steps = neighbours(lb).where("next <> lbl")
    touch = steps.select("figure_id", F.least("lbl", "next").alias("lo"), F.greatest("lbl", "next").alias("hi")).distinct()
    p = pairs.withColumns({"lo": F.least("top", "bot"), "hi": F.greatest("top", "bot")}).join(touch.withColumn("t", F.lit(True)), ["figure_id", "lo", "hi"], "left")
    return p.select("figure_id", "top", "bot", F.col("t").isNull().alias("broken"))


def names_by_hue(palette: DataFrame) -> DataFrame:
    """(figure_id, lbl, hue, name): names of a figure's colours by rising hue."""
    h = palette.withColumn("hue", F.round(colors.hue(F.col("r"), F.col("g"), F.col("b")), 6))
    rank = F.row_number().over(Window.partitionBy("figure_id").orderBy("hue", "lbl"))
    name = F.when(rank <= len(HUE_NAMES), F.element_at(F.array(*map(F.lit, HUE_NAMES)), F.least(rank, F.lit(len(HUE_NAMES))))).otherwise(F.concat(F.lit("c"), rank - 1))
    return h.select("figure_id", "lbl", "hue", name.alias("name"))


def close_boundaries(lb: DataFrame, palette: list[tuple[int, int, int]] = PALETTE, threshold: float = 55.0) -> DataFrame:
    """Pairs of consecutive labels with like colours, and how many pixels of either touch the other."""
    near = [(i, i + 1) for i in range(len(palette) - 1) if sum((a - b) ** 2 for a, b in zip(palette[i], palette[i + 1], strict=True)) ** 0.5 < threshold]
    steps = neighbours(lb)
    hit = F.lit(False)
    for i, j in near:
        hit = hit | ((F.least("lbl", "next") == i) & (F.greatest("lbl", "next") == j))
    return steps.where(hit).groupBy("figure_id", F.least("lbl", "next").alias("lo"), F.greatest("lbl", "next").alias("hi")).agg(F.count(F.lit(1)).alias("touching"))


def disagreement(one: DataFrame, two: DataFrame) -> DataFrame:
    """(figure_id, disagreement): the share of pixels whose two labels differ."""
    b = one.select(*KEYS, "lbl").join(two.select(*KEYS, F.col("lbl").alias("other")), KEYS)
    return b.groupBy("figure_id").agg(F.round(F.avg(F.when(F.col("lbl") != F.col("other"), 1.0).otherwise(0.0)), 6).alias("disagreement"))
