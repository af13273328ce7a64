"""Streams of the engine: resumable batches, the attempt log, feedback and the figure lifecycle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The states that each state may go to.
NEXT = {
    "pending": ("classified", "skipped", "error"),
    "classified": ("segmented", "skipped", "error", "pending"),
    "segmented": ("reviewed", "error", "classified"),
    "reviewed": ("exported", "error", "segmented", "classified"),
    "exported": ("classified",),
    "skipped": ("pending",),
    "error": ("pending",),
}


def resumable(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], kind: str = "json") -> StreamingQuery:
    """Processes what has arrived since the last run, once, and appends the results; the checkpoint is the resume log."""
    stream = spark.readStream.schema(schema).format(kind).load(source)
    return process(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start()


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """The append-only attempt log as a stream; lines that aren't JSON are passed over."""
    schema = "ts timestamp, engine string, outcome string, saturation double, edge_density double"
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def engine_rates(log: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Success rates by engine and window; what is later than ``late`` is dropped with the state it would need."""
    w = log.withWatermark("ts", late).groupBy(F.window("ts", window), "engine")
    return w.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "success").alias("ok"))


def feedback(messages: DataFrame) -> DataFrame:
    """The status and message of each posted (figure_id, text): 400 without either, else 200."""
    ok = F.col("figure_id").isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) != "")
    return messages.select("figure_id", F.when(ok, 200).otherwise(400).alias("status"), F.when(ok, F.concat(F.lit("【"), "figure_id", F.lit("】"), F.trim("text"))).alias("message"))


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status = state.get[0] if state.exists else "pending"
    rejected = 0
    for batch in batches:
        for want in batch.sort_values("ord")["status"]:
            if want in NEXT.get(status, ()):
                status = want
            elif want != status:
                rejected += 1
    state.update((status,))
    yield pd.DataFrame({"figure_id": [key[0]], "status": [status], "rejected": [rejected]})


def lifecycle(commands: DataFrame) -> DataFrame:
    """The state of each figure after its commands (figure_id, ord, status); forbidden ones are counted and passed over."""
    return commands.groupBy("figure_id").applyInPandasWithState(_advance, "figure_id string, status string, rejected long", "status string", "update", GroupStateTimeout.NoTimeout)
