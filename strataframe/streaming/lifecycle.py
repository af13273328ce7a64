"""The lifecycle of figures as a stateful stream: commands in, the state after each batch out, with timers and saved sessions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from strataframe.streaming.flows import NEXT

#: The store that stateful processors need, and its setting.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "session_id long, figure_id long, status string, score double, applied long, rejected long, event string"


class Lifecycle(StatefulProcessor):
    """The state of one figure of a session: its status, its score, and how many commands were applied and refused.

    Commands of a batch are taken by ``ord``; one that the status doesn't allow is counted and
    passed over, one that repeats it only brings its score. Going back to ``pending`` or
    ``classified`` clears the score. A figure that has waited ``idle_ms`` in a state that isn't an
    end is told once as "idle". A saved session gives the first state.
    """

    ENDS = ("exported", "skipped")

    def __init__(self, idle_ms: int = 0):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("figure", "status string, score double, applied long, rejected long")

    def _held(self) -> list[Any]:
        return list(self.state.get()) if self.state.exists() else ["pending", None, 0, 0]

    def _row(self, key: tuple, held: list[Any], event: str) -> pd.DataFrame:
        status, score, applied, rejected = held
        return pd.DataFrame({"session_id": [key[0]], "figure_id": [key[1]], "status": [status], "score": pd.array([score], "Float64"), "applied": [applied], "rejected": [rejected], "event": [event]})

    def handleInitialState(self, key: tuple, initial: pd.DataFrame, timers: TimerValues) -> None:
        last = initial.iloc[-1]
        self.state.update((last["status"], None if pd.isna(last["score"]) else float(last["score"]), 0, 0))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: TimerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        commands = pd.concat(list(rows)).sort_values("ord", kind="stable")
        for want, score in zip(commands["status"], commands["score"], strict=True):
            if want == held[0]:
                held[1] = held[1] if pd.isna(score) else float(score)
            elif want in NEXT[held[0]]:
                back = want in ("pending", "classified")
                held = [want, None if back or pd.isna(score) else float(score), held[2] + 1, held[3]]
            else:
                held[3] += 1
        self.state.update(tuple(held))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if held[0] not in self.ENDS:
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._row(key, held, "update")

    def handleExpiredTimer(self, key: tuple, timers: TimerValues, expired: Any) -> Iterator[pd.DataFrame]:
        yield self._row(key, self._held(), "idle")

    def close(self) -> None:
        pass


def lifecycle(commands: DataFrame, saved: DataFrame | None = None, idle_ms: int = 0) -> DataFrame:
    """Rows OUT: the state of each figure that a batch's commands (session_id, figure_id, ord, status, score) touch.

    ``saved`` (session_id, figure_id, status, score) is a session taken up again. State is keyed by session
    and figure, so it is spread over executors and survives a restart from the checkpoint. A key
    costs a row of state; a batch's commands of one key go through one task.
    """
    first = saved.select("session_id", "figure_id", "status", "score").groupBy("session_id", "figure_id") if saved is not None else None
    keyed = commands.select("session_id", "figure_id", "ord", "status", "score").groupBy("session_id", "figure_id")
    return keyed.transformWithStateInPandas(Lifecycle(idle_ms), OUT, "update", "processingTime" if idle_ms else "none", first)


def states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(session_id, figure_id, status, score, applied, rejected): every figure's state as a checkpoint holds it."""
    s = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "figure").load()
    return s.selectExpr("key.session_id", "key.figure_id", "value.*")
