"""Exact deduplication by a content sort, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.llm.common import columns, shuffle_parts

#: Characters of the text that the sampled splitters carry; a hash follows, so hot prefixes still split.
PREFIX = 24


def exact_groups(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept and text_sha256.

    Texts are equal when their bytes are; null counts as empty, and empty texts are equal to one
    another. ``keep`` names the id that stays, "smallest" or "largest". Rows that repeat an id
    with its text are one document: all of them are kept or none. A null id never wins over
    another; where all ids of a group are null, they stay.

    Sampled splitters range-partition the texts by (prefix, hash), an external sort puts equal
    texts next to each other, and the window over the sorted runs compares them in full without
    another exchange. A text with more rows than a mean partition (there are fewer of them than
    partitions, which bounds what is broadcast) is aggregated before the shuffle instead, and
    its rows stay where they are.
    """
    spark = docs.sparkSession
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = columns(docs, id_col, text=text_col).withColumnRenamed(id_col, "doc_id").withColumn("h", F.xxhash64("text"))
    total, parts = docs.count(), shuffle_parts(spark)
    hot = [r.h for r in rows.groupBy("h").count().where(F.col("count") > max(2, total // parts)).collect()]
    cold = rows
    if hot:
        few = F.broadcast(spark.createDataFrame([(h,) for h in hot], "h long"))
        cold = rows.join(few, "h", "left_anti")
    same = Window.partitionBy("prefix", "h", "text")
    out = (
        cold.withColumn("prefix", F.substring("text", 1, PREFIX))
        .repartitionByRange("prefix", "h")
        .select("doc_id", best("doc_id").over(same).alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    )
    if hot:
        large = rows.join(few, "h", "left_semi")
        heads = large.groupBy("h", "text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        heads = heads.select("h", "keep_id", "group_size", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
        slim = large.select("doc_id", "h", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
        out = out.unionByName(slim.join(F.broadcast(heads), ["h", "text_sha256"]).select(out.columns))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")

