"""The strategy memory: what engines have achieved on figures with which features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The weights of features in the distance between figures.
WEIGHTS = {"saturation": 2.0, "edge_density": 1.0, "groups": 1.0, "aspect": 0.5}


def bins(attempts: DataFrame) -> DataFrame:
    sat = F.when(F.col("saturation") < 0.1, "pastel").when(F.col("saturation") < 0.5, "mixed").otherwise("vivid")
    edge = F.when(F.col("edge_density") < 0.01, "low").when(F.col("edge_density") < 0.03, "medium").otherwise("high")
    return attempts.withColumns({"sat_bin": sat, "edge_bin": edge})


def engine_rates(attempts: DataFrame, least: int = 2) -> DataFrame:
    ok = F.count_if(F.col("outcome") == "success")
    out = attempts.groupBy("engine").agg(F.count(F.lit(1)).alias("n"), ok.alias("ok"))
    return out.where(F.col("n") >= least).select("engine", "n", F.round(F.col("ok") / F.col("n"), 3).alias("success_rate"))


def patterns(attempts: DataFrame, least: int = 3) -> DataFrame:
    """Per feature bin the engine of the best rate, ties by count and first use; one aggregate by (bin, engine)."""
    b = bins(attempts)
    e = b.groupBy("sat_bin", "edge_bin", "engine").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("outcome") == "success").alias("ok"), F.min("ord").alias("first"), F.sum(F.coalesce("alignment", F.lit(0.0))).alias("al"))
    w = Window.partitionBy("sat_bin", "edge_bin")
    e = e.withColumns({"n": F.sum("c").over(w), "rate": F.col("ok") / F.col("c")}).where((F.col("n") >= least) & (F.col("c") >= 2) & (F.col("rate") > 0))
    best = e.withColumn("k", F.row_number().over(w.orderBy(F.desc("rate"), F.desc("c"), "first"))).where("k = 1")
    return best.select("sat_bin", "edge_bin", F.col("engine").alias("best_engine"), F.col("n"), F.round("rate", 3).alias("success_rate"), F.round(F.col("al") / F.col("c"), 4).alias("avg_alignment"), F.least(F.lit(1.0), F.col("n") / 20.0).alias("confidence"))


def feature_distance(target: dict[str, float]):
    out = F.lit(0.0)
    for k, w in WEIGHTS.items():
        out = out + F.abs(F.col(k) - F.lit(float(target[k]))) * w
    return out / sum(WEIGHTS.values())


def query_similar(attempts: DataFrame, target: dict[str, float], top: int = 3) -> DataFrame:
    """The nearest successful attempts, ties by age; a top-k, so each task keeps k rows."""
    d = attempts.where("outcome = 'success'").withColumn("distance", F.round(feature_distance(target), 6))
    return d.orderBy("distance", "ord").limit(top).select("ord", "engine", "distance")
