"""Reading and writing what the engine exchanges with the outside: images, logs and model files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataframe.operators import properties


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(figure_id, height, width, ok, rgb): images decoded by the JVM; an unreadable file is a row that isn't ok."""
    i = spark.read.format("image").load(folder)
    stem = F.regexp_extract("image.origin", r"([^/]+?)(\.[^./]*)?$", 1)
    return i.select(F.regexp_replace(stem, r"[^\p{IsAlphabetic}\p{IsDigit}_-]", "_").alias("figure_id"), "image.height", "image.width", "image.nChannels", (F.col("image.height") > 0).alias("ok"), F.col("image.data").alias("data"))


def image_pixels(figures: DataFrame) -> DataFrame:
    """The pixel relation of decoded figures; the decoder's channels are blue, green, red."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, h, w, n, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                a = np.frombuffer(data, np.uint8).reshape(h, w, n)
                a = np.repeat(a, 3, 2) if n == 1 else a[:, :, 2::-1]
                y, x = np.indices((h, w)).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array([name] * (h * w)), *(pa.array(v.astype(np.int32)) for v in (y, x, *a.reshape(-1, 3).T))], ["figure_id", "y", "x", "r", "g", "b"])

    return figures.where("ok").select("figure_id", "height", "width", "nChannels", "data").mapInArrow(run, "figure_id string, y int, x int, r int, g int, b int")


def png(rgb: np.ndarray) -> bytes:
    """A PNG of (rows, columns, 3) bytes."""
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + row.tobytes() for row in rgb.astype(np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def write_tomography(grid: DataFrame, path: str) -> None:
    """Text files of node lines under their header, a folder per figure, depth by depth; a figure's lines stay in one file."""
    lines = properties.tomography_lines(grid)
    first = F.row_number().over(Window.partitionBy("figure_id").orderBy("z", "x")) == 1
    value = F.when(first, F.concat(F.lit(properties.TOMOGRAPHY_HEADER + "\n"), "line")).otherwise(F.col("line"))
    lines.select("figure_id", value.alias("value")).write.mode("overwrite").partitionBy("figure_id").text(path)


def append_attempts(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path)


def read_attempts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The attempt log; lines that aren't JSON are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def feature_collections(polygons: DataFrame) -> DataFrame:
    """(figure_id, geojson): a figure's rings as features, in order; a ring's text form becomes coordinates."""
    points = F.split(F.regexp_extract("wkt", r"\(\((.*)\)\)", 1), ", ")
    ring = F.transform(points, lambda p: F.transform(F.split(p, " "), lambda v: v.cast("double")))
    f = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("lbl").alias("layer_id"), "n_vertices").alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    rows = polygons.select("figure_id", "lbl", "ring", f.alias("f")).groupBy("figure_id").agg(F.array_sort(F.collect_list(F.struct("lbl", "ring", "f"))).alias("fs"))
    return rows.select("figure_id", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform("fs", lambda x: x.f).alias("features"))).alias("geojson"))
