"""Job states as a stream: events folded by key, with deadlines and expiry by timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.config import EngineConfig
from ..operators.jobs import TERMINAL

OUTPUT = "job_id string, status string, progress int, attempts int, table_count int"


class JobFold(StatefulProcessor):
    """Applies each event to its job: a terminal state stays; a failure is retried while attempts are left.

    A job under way gets a timer at its deadline, which counts as a failure if it is still under way then; a job that has ended gets one at
    the end of its time to live, when its state is removed. So state holds only jobs under way and those that ended lately.
    """

    def __init__(self, cfg: EngineConfig):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, progress int, attempts int, table_count int, route string, due long")

    def failed(self, status: str, attempts: int) -> tuple[str, int, int]:
        return ("queued", 0, attempts + 1) if attempts <= self.cfg.max_retries else (status, 0, attempts)

    def save(self, key, now: int, before: int, status, progress, attempts, tables, route) -> pd.DataFrame:
        """Keeps the state, with a timer where its kind of deadline begins (due: when, 0 for none)."""
        due = before
        if status in TERMINAL:
            due = now + int(self.cfg.ttl_s * 1000)
        elif status != "processing":
            due = 0
        elif before == 0:
            due = now + int((self.cfg.ocr_budget_s if route == "ocr" else self.cfg.task_timeout_s) * 1000)
        if due and due != before:
            self.handle.registerTimer(due)
        self.state.update((status, progress, attempts, tables, route, due))
        return pd.DataFrame({"job_id": [key[0]], "status": [status], "progress": [progress], "attempts": [attempts], "table_count": [tables]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, progress, attempts, tables, route, due = self.state.get() if self.state.exists() else ("queued", 0, 1, 0, None, 0)
        if status in TERMINAL:
            return
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for e in events.itertuples(index=False):
            if status in TERMINAL:
                break
            if pd.notna(e.table_count):
                tables = int(e.table_count)
            if pd.notna(e.route):
                route = e.route
            if e.status in ("failed", "timed_out"):
                (status, progress, attempts), due = self.failed(e.status, attempts), 0
                tables, route = (0, None) if status == "queued" else (tables, route)
            elif pd.notna(e.status):
                status, progress = e.status, int(e.progress) if pd.notna(e.progress) else progress
        yield self.save(key, timerValues.getCurrentProcessingTimeInMs(), due, status, progress, attempts, tables, route)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        status, progress, attempts, tables, route, due = self.state.get()
        if due != expiredTimerInfo.getExpiryTimeInMs():  # of an attempt that has ended
            return
        if status in TERMINAL:
            self.state.clear()
        elif status == "processing":
            status, progress, attempts = self.failed("timed_out", attempts)
            yield self.save(key, timerValues.getCurrentProcessingTimeInMs(), 0, status, progress, attempts, 0 if status == "queued" else tables, route)

    def close(self) -> None:
        pass


def job_states(events: DataFrame, cfg: EngineConfig | None = None) -> DataFrame:
    """(job_id, status, progress, attempts, table_count) after each batch of events (job_id, seq, status, progress, table_count, route) and each deadline."""
    return events.groupBy("job_id").transformWithStateInPandas(JobFold(cfg or EngineConfig()), OUTPUT, "Update", "processingTime")
