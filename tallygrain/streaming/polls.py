"""Jobs that are triggered once and polled until they end, as a stream: a job is a key with state, its deadline a timer."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallygrain.sources.recorded import poll_end

OUTCOMES = "job_id string, event string, outcome string, polls long"


class Jobs(StatefulProcessor):
    """State of a job: when it was asked for, when its polls were, and the first that ended it.

    A job is triggered by the first request for it and by no other, also not by one that comes after its end, as long as it is
    remembered (``keep_ms`` after the deadline). Polls may come in any order, before their request too: what counts is decided
    when the watermark has passed the deadline, so late and repeated deliveries change nothing.
    """

    def __init__(self, deadline_ms: int, keep_ms: int):
        self.deadline_ms, self.keep_ms = deadline_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "start long, done boolean, first long")
        self.polls = handle.getMapState("polls", "at long", "state string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        start, done, first = self.job.get() if self.job.exists() else (None, False, None)
        fresh = False
        for r in rows:
            at = r.at_ms
            if done:
                continue
            if first is None or at < first:
                first = at
            if r.kind == "request":
                fresh |= start is None
                start = at if start is None else min(start, at)
            else:  # of polls at one time the one that ends the job counts
                held = self.polls.getValue((at,))[0] if self.polls.containsKey((at,)) else None
                if held in (None, "pending"):
                    self.polls.updateValue((at,), (r.state,))
        if not done:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            # without a request, polls are forgotten as if it had come with the first of them
            self.handle.registerTimer((first if start is None else start) + self.deadline_ms + 1)
        self.job.update((start, done, first))
        if fresh:
            yield Row(job_id=key[0], event="triggered", outcome=None, polls=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        start, done, first = self.job.get()
        if done or start is None:
            self.job.clear()
            self.polls.clear()
            return
        told = sorted((k[0], v[0]) for k, v in self.polls.iterator() if k[0] <= start + self.deadline_ms)
        end = next((i for i, (_, state) in enumerate(told) if state != "pending"), None)
        self.polls.clear()
        self.job.update((start, True, first))
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.keep_ms)
        yield Row(job_id=key[0], event="ended", outcome="timeout" if end is None else told[end][1], polls=len(told) if end is None else end + 1)


def poll_stream(events: DataFrame, deadline_s: int, late: str = "1 minute", keep_s: int = 86_400) -> DataFrame:
    """Of a stream of requests and polls (job_id, kind: request or poll, at timestamp, status): a row 'triggered' the first time
    a job is asked for, and a row 'ended' with its outcome and number of polls once its deadline has passed.

    Outcomes are those of ``recorded.poll_outcomes``. Rows later than ``late`` are left out. Needs the RocksDB state store.
    """
    state = poll_end(F.col("status"))
    rows = events.withWatermark("at", late).select(F.col("job_id").cast("string").alias("job_id"), "kind", "at", F.unix_millis("at").alias("at_ms"), state.alias("state"))
    return rows.groupBy("job_id").transformWithState(Jobs(deadline_s * 1000, keep_s * 1000), OUTCOMES, "append", "EventTime")
