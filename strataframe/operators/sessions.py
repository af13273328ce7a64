"""Session lifecycle, batch resume and report figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.sources.tables import STATUSES


def latest(history: DataFrame) -> DataFrame:
    """The last state of each figure: one aggregate, no sort of the history."""
    s = history.groupBy("session_id", "figure_id").agg(F.max_by(F.struct("status", "score", "ord"), "ord").alias("s"))
    return s.select("session_id", "figure_id", "s.status", "s.score", "s.ord")


def summary(entries: DataFrame) -> DataFrame:
    """Figures of each status, zeros included."""
    return entries.groupBy("session_id").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES])


def ready(entries: DataFrame, status: str) -> DataFrame:
    return entries.where(F.col("status") == status).select("session_id", "figure_id", "ord")


# The state that a figure goes back to, and the states that have what the stage needs.
BACK_TO = {
    "classify": ("pending", tuple(STATUSES)),
    "panel": ("classified", ("classified", "segmented", "reviewed", "exported")),
    "segment": ("classified", ("segmented", "reviewed", "exported")),
}


def backtrack(entries: DataFrame, stage: str) -> DataFrame:
    """Figures go back to a stage, whatever their state, and lose the segmentation and its score.

    A figure that lacks what the stage needs (a classification, or panels) stays as it is.
    """
    status, able = BACK_TO[stage]
    goes = F.col("status").isin(*able)
    return entries.select("session_id", "figure_id", F.when(goes, F.lit(status)).otherwise(F.col("status")).alias("status"), F.when(~goes, F.col("score")).alias("score"))


def update(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries with the changed fields of (session_id, figure_id, new_status, new_score) replaced."""
    out = entries.join(changes, ["session_id", "figure_id"], "left")
    return out.select("session_id", "figure_id", F.coalesce("new_status", "status").alias("status"), F.coalesce("new_score", "score").alias("score"))


def report_stats(entries: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return entries.groupBy("session_id").agg(F.count(F.lit(1)).alias("total"), n("exported"), n("segmented"), n("skipped"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 4).alias("avg_score"))


def report_cards(entries: DataFrame) -> DataFrame:
    """Band, alert and caption of each figure's card, in the order of the work set."""
    band = F.when(F.col("score") >= 0.75, "good").when(F.col("score") >= 0.6, "warn").otherwise("bad")
    alert = F.coalesce((F.col("score") < 0.7) & (F.col("status") == "segmented"), F.lit(False))
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("ord"))
    return entries.select("session_id", "figure_id", number.alias("card"), band.alias("band"), alert.alias("alert"), F.concat_ws(" ", "status", F.coalesce(F.format_string("%.2f", "score"), F.lit("—"))).alias("caption"))


def resume(listing: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left to do: a listing without what an earlier run has finished."""
    return listing.join(done.select(key), key, "left_anti")


def tally(results: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return results.agg(n("processed"), n("skipped"), n("error"), F.count(F.lit(1)).alias("total"))


ENTRY = "figure_id long, status string, score double, ord long"


def to_json(entries: DataFrame) -> DataFrame:
    """(session_id, json): a session's figures in the order of the work set; a session is one document."""
    row = F.struct("ord", "figure_id", "status", "score")
    return entries.groupBy("session_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(row)).alias("figures")), {"ignoreNullFields": "false"}).alias("json"))


def from_json(saved: DataFrame) -> DataFrame:
    """The entries of saved sessions; a document that can't be read fails, as half a session would be taken for a whole one."""
    s = saved.select("session_id", F.from_json("json", f"figures array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>", {"mode": "FAILFAST"}).alias("s"))
    return s.select("session_id", F.inline("s.figures"))
