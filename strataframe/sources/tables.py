"""Relations of the engine derived from the star-schema and event tables.

The given tables hold no images, so figures are built from them by fixed rules: a figure is a
tile of 64 embedding vectors, layered by label; a row is a vector and a column its component.
Both rules read only the columns they need, and no rule looks at other figures' rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and columns of a figure.
TILE = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Vectors of one task at most, on the mean: 65,536 pixels.
VECTORS_A_TASK = 1024


def by_figure(rows: DataFrame) -> DataFrame:
    """Vectors dealt by their figure to as many tasks as their pixels need; by their own few bytes they would be merged into a few."""
    return rows.repartition(max(1, -(-rows.count() // VECTORS_A_TASK)), "figure_id")


def figure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(figure_id, y, label, embedding): vectors of a figure from the top, in the order of their labels."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    e = e.withColumn("figure_id", F.col("vec_id") - F.col("vec_id") % TILE).transform(by_figure)
    down = Window.partitionBy("figure_id").orderBy("label", "vec_id")
    return e.select("figure_id", (F.row_number().over(down) - 1).alias("y"), F.col("label").cast("int").alias("label"), "embedding")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel relation (figure_id, y, x, label, r, g, b), channels 0 to 255."""
    cells = figure_rows(spark, sf_dir).select("figure_id", "y", "label", F.posexplode("embedding").alias("x", "v"))
    shift = F.expr("cast(cast(v as double) * 60 as int)")
    channel = lambda k, c: F.greatest(F.lit(0), F.least(F.lit(255), (F.col("label") * k + c) % 256 + shift))
    return cells.select("figure_id", "y", "x", "label", channel(53, 0).alias("r"), channel(97, 80).alias("g"), channel(151, 160).alias("b"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate panels (page_id, box_id, x, y, w, h, conf): eight parts make a page."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    key = F.col("p_partkey")
    return p.select(
        F.expr("p_partkey div 8").alias("page_id"), key.alias("box_id"),
        (key * 37 % 400).cast("long").alias("x"), (key * 53 % 300).cast("long").alias("y"),
        (F.col("p_size") * 6 + 20).cast("long").alias("w"), (F.col("p_size") * 4 + 20).cast("long").alias("h"),
        (((key * 7) % 100) / 100).alias("conf"),
    )


#: Rows and columns of a sheet.
SHEET_H, SHEET_W = 160, 200

#: Sheets of one task at most, on the mean: two million pixels.
SHEETS_A_TASK = 64


def by_sheet(rows: DataFrame) -> DataFrame:
    """Rows of suppliers dealt by their sheet (figure_id), before any grouping.

    After one, a repartition by the same key is dropped as needless, and what is left is merged by its
    few bytes into one task that would hold all pixels.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // (4 * SHEETS_A_TASK))), "figure_id")


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of several panels (figure_id, y, x, r, g, b): four suppliers make a sheet, each a panel in its quarter.

    By sheet modulo 5: a grid, a row, a column, a grid of separate dots, or a grid on black.
    """
    k = F.col("s_suppkey")
    slot = k % 4
    p = table(spark, sf_dir, "supplier").select(
        F.expr("s_suppkey div 4").alias("figure_id"), k.alias("k"),
        (slot % 2 * 100 + 4 + k * 7 % 12).cast("int").alias("x0"), (F.expr("s_suppkey % 4 div 2") * 80 + 3 + k * 5 % 10).cast("int").alias("y0"),
        (40 + k * 13 % 50).cast("int").alias("w"), (32 + k * 11 % 40).cast("int").alias("h"), slot.alias("slot"),
    ).transform(by_sheet)
    form = F.col("figure_id") % 5
    shown = ~(((form == 1) & (F.col("slot") > 1)) | ((form == 2) & (F.col("slot") % 2 == 1)))
    one = lambda n: F.max(F.when(shown & (F.col("slot") == n), F.struct("k", "x0", "y0", "w", "h"))).alias(f"p{n}")
    s = p.groupBy("figure_id").agg(*[one(n) for n in range(4)])
    # Rows and columns by cross joins: the planner multiplies both sides' sizes, where it takes exploded
    # rows for as small as the sheets and would send the pixels of all figures to the driver.
    line = lambda n, axis: F.broadcast(spark.range(0, n, 1, 1).select(F.col("id").cast("int").alias(axis)))
    s = s.crossJoin(line(SHEET_H, "y"))
    at = lambda n, c: F.col(f"p{n}.{c}")
    row = lambda n: (F.col("y") >= at(n, "y0")) & (F.col("y") < at(n, "y0") + at(n, "h"))
    s = s.select("figure_id", "y", *[F.when(row(n), v).alias(f"{c}{n}") for n in range(4) for c, v in (("k", at(n, "k")), ("lo", at(n, "x0")), ("hi", at(n, "x0") + at(n, "w")))])
    s = s.crossJoin(line(SHEET_W, "x"))
    own = F.coalesce(*[F.when((F.col("x") >= F.col(f"lo{n}")) & (F.col("x") < F.col(f"hi{n}")), F.col(f"k{n}")) for n in range(4)])
    dot = (form != 3) | ((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0))
    back = F.when(form == 4, 0).otherwise(255)
    channel = lambda m: F.when(own.isNotNull() & dot, own * m % 200 + F.col("y") * 3 % 40).otherwise(back).cast("int")
    return s.select("figure_id", "y", "x", channel(53).alias("r"), channel(97).alias("g"), channel(151).alias("b"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempt log (ord, engine, outcome, saturation, edge_density, aspect, groups, alignment)."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    k = F.col("event_id")
    return e.select(
        k.alias("ord"), F.col("event_type").alias("engine"), F.when(k % 4 == 0, "failure").otherwise("success").alias("outcome"),
        ((k * 31 % 1000) / 1000).alias("saturation"), ((k * 17 % 50) / 1000).alias("edge_density"),
        (1 + (k * 13 % 200) / 100).alias("aspect"), (k * 7 % 15).alias("groups"),
        F.when(k % 5 != 0, F.round(F.col("value") % 1, 4)).alias("alignment"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle commands (session_id, figure_id, ord, status, score): a user's events are a session's history."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    names = F.array(*[F.lit(s) for s in STATUSES])
    return e.select(
        F.col("user_id").alias("session_id"), (F.col("event_id") % 6).alias("figure_id"), F.col("event_id").alias("ord"), "ts",
        F.element_at(names, (F.col("event_id") * 11 % 7 + 1).cast("int")).alias("status"), F.round(F.col("value") % 1, 4).alias("score"),
    )


# A figure's states, in the order of its life.
STATUSES = ["pending", "classified", "segmented", "reviewed", "exported", "skipped", "error"]
