"""Intermediate relations of flows with many steps, written to the folder that executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a local session without it, as in tests, uses this machine's temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/strataframe-stages"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The relation, written as Parquet and read again: its plan ends here, and a lost executor costs no step before it.

    For what several later steps read. Flows of many joins would else plan, and run, each step
    once for every use of it.
    """
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _MADE.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> None:
    """Removes this session's stages; for when what was made of them has been written."""
    for held in [m for m in _MADE if m[0] is spark]:
        path = spark._jvm.org.apache.hadoop.fs.Path(held[1])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _MADE.remove(held)
