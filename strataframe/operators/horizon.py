"""Horizons: the boundary between two layers as a row of each column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_boundary(lb: DataFrame, top: int, bottom: int) -> DataFrame:
    """Per column the middle of the two labels' median rows, or of their joint extent where they interleave."""
    is_ = lambda k: F.when(F.col("lbl") == k, F.col("y"))
    s = lb.where(F.col("lbl").isin(top, bottom)).groupBy("figure_id", "x").agg(
        F.median(is_(top)).alias("mt"), F.median(is_(bottom)).alias("mb"), F.max(is_(top)).alias("t1"), F.min(is_(bottom)).alias("b0"), F.min("y").alias("lo"), F.max("y").alias("hi")
    )
    s = s.where("mt is not null and mb is not null")
    return s.select("figure_id", "x", F.round(F.when(F.col("t1") < F.col("b0"), (F.col("mt") + F.col("mb")) / 2).otherwise((F.col("lo") + F.col("hi")) / 2.0), 4).alias("yb"))


def zero_crossing(lb: DataFrame, top: int, bottom: int) -> DataFrame:
    """Per column the first step from the upper to the lower label, between rows by linear interpolation of a 3-row mean."""
    sign = F.when(F.col("lbl") == top, 1.0).when(F.col("lbl") == bottom, -1.0).otherwise(0.0)
    down = Window.partitionBy("figure_id", "x").orderBy("y")
    p = lb.withColumn("s", sign).withColumn("v", F.avg("s").over(down.rowsBetween(-1, 1))).withColumn("n", F.lead("v").over(down))
    hit = p.where((F.col("v") > 0) & (F.col("n") <= 0)).withColumn("at", F.col("y") + F.col("v") / (F.col("v") - F.col("n")))
    return hit.groupBy("figure_id", "x").agg(F.round(F.min_by("at", "y"), 5).alias("yb"))


def median_of(a):
    """The exact median of a sorted array expression."""
    n = F.size(a)
    return (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2.0


def hampel(series: DataFrame, key: str, at: str, value: str, half: int = 10, sigmas: float = 3.0) -> DataFrame:
    """Values far from the median of 2 * half + 1 neighbours (fewer at the ends) become that median.

    A series shorter than a whole window stays as it is. The frame is a bounded array, so the
    median and its deviation are array expressions.
    """
    w = Window.partitionBy(key).orderBy(at).rowsBetween(-half, half)
    s = series.withColumn("near", F.array_sort(F.collect_list(F.col(value)).over(w))).withColumn("med", median_of(F.col("near")))
    s = s.withColumn("mad", median_of(F.array_sort(F.transform("near", lambda v: F.abs(v - F.col("med"))))))
    long = F.count(F.lit(1)).over(Window.partitionBy(key)) >= 2 * half + 1
    s = s.withColumn("long", long)
    out = F.col("long") & (F.abs(F.col(value) - F.col("med")) > sigmas * 1.4826 * F.col("mad"))
    return s.select(key, at, F.round(F.when(out, F.col("med")).otherwise(F.col(value)), 4).alias("filtered"), out.alias("is_outlier"))


def adjust(lb: DataFrame, boundary: DataFrame, top: int, bottom: int, reach: int = 5) -> DataFrame:
    """Pixels of either label within ``reach`` rows of the boundary take the side that they are on."""
    p = lb.join(boundary, ["figure_id", "x"], "left")
    inside = F.col("yb").isNotNull() & F.col("lbl").isin(top, bottom) & (F.abs(F.col("y") - F.col("yb")) <= reach)
    return p.select("figure_id", "y", "x", F.when(inside, F.when(F.col("y") <= F.bround("yb", 0), top).otherwise(bottom)).otherwise(F.col("lbl")).cast("int").alias("lbl"))


def repartition(lb: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Whole columns cut into intervals by their sorted boundaries: the number of boundaries above a pixel."""
    cuts = boundaries.groupBy("figure_id", "x").agg(F.sort_array(F.collect_list("yb")).alias("cuts"))
    p = lb.join(cuts, ["figure_id", "x"], "left")
    return p.select("figure_id", "y", "x", F.size(F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda c: c <= F.col("y"))).alias("lbl"))


def quality_gate(before: DataFrame, after: DataFrame, most: float = 0.15) -> DataFrame:
    """Whether a refined label map may replace the coarse one: few pixels change and at most one layer is lost."""
    b = before.join(after.withColumnRenamed("lbl", "new"), ["figure_id", "y", "x"])
    s = b.groupBy("figure_id").agg(F.avg(F.when(F.col("lbl") != F.col("new"), 1.0).otherwise(0.0)).alias("c"), F.count_distinct("lbl").alias("n0"), F.count_distinct("new").alias("n1"))
    return s.select("figure_id", F.round("c", 6).alias("changed"), F.col("n0").alias("layers_before"), F.col("n1").alias("layers_after"), ((F.col("c") <= most) & (F.col("n1") >= F.col("n0") - 1)).alias("accepted"))
