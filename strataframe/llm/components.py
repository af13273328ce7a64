"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import Workspace


def connected_components(links: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node that links reach.

    Each step replaces links by links to the smallest known neighbour and is written to the
    shared folder; it ends when a step changes nothing. A node with very many links is reduced
    by a partial aggregate and a join, never gathered.
    """
    edges = work.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), f"{name}0")
    print_of = lambda df: tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.lit(0))).first())
    state, step = print_of(edges), 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: larger neighbours of u go to the smallest node around u.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        step += 1
        edges = work.write(small, f"{name}{step}")
        work.drop(f"{name}{step - 1}")
        now = print_of(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
