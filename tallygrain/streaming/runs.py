"""Streaming forms of run-log operators: extensions, equal to the batch forms on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tallygrain import config

C = config.ScrapingConfig()


class Successes(StatefulProcessor):
    """State of a URL: runs that the watermark has not passed yet, and its last recorded success while that can still matter.

    Runs wait until nothing earlier can come, so their order of arrival does not matter; a success is forgotten when the time
    has passed in which it turns another down. So state holds what the lateness and the span cover, and no URL for ever.
    """

    def __init__(self, schema: StructType, span_us: int):
        self.schema, self.span_us = schema, span_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")
        self.waiting = handle.getMapState("waiting", "at long, n long", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            at, n = r.at_us, 0
            while self.waiting.containsKey((at, n)):  # runs of one moment, in order of id when their time comes
                n += 1
            self.waiting.updateValue((at, n), tuple(r[f] for f in self.schema.names))
            self.handle.registerTimer(-(-at // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted(((k[0], Row(*self.schema.names)(*v), k) for k, v in self.waiting.iterator() if k[0] <= now), key=lambda x: (x[0], x[1].id))
        last = self.last.get()[0] if self.last.exists() else None
        for at, run, k in due:
            self.waiting.removeKey(k)
            success = run.outcome == "success"
            if not success or last is None or at - last >= self.span_us:
                last = at if success else last
                yield run
        if last is None:
            return
        if last + self.span_us <= now:
            self.last.clear()
        else:
            self.last.update((last,))
            self.handle.registerTimer(-(-(last + self.span_us) // 1000))


def dedup_stream(runs: DataFrame, seconds: int = C.dedup_seconds, late: str = "1 hour") -> DataFrame:
    """Exact success dedup of a stream (id, url, outcome, scraped_at): the rows that the batch form keeps, whatever order they
    come in, each once the watermark has passed it.

    Rows later than ``late`` are left out. Needs the RocksDB state store.
    """
    schema = runs.schema
    rows = runs.withWatermark("scraped_at", late).withColumn("at_us", F.unix_micros("scraped_at"))
    return rows.groupBy("url").transformWithState(Successes(schema, seconds * 1_000_000), schema, "append", "EventTime")


def surge_stream(runs: DataFrame, late: str = "1 hour", slide: str = "1 hour", hours: int = C.surge_window_hours) -> DataFrame:
    """Sliding counts by site of a stream whose scraped_at is a timestamp; rows later than ``late`` are left out."""
    w = runs.withWatermark("scraped_at", late).groupBy("site", F.window("scraped_at", f"{hours} hours", slide).alias("w"))
    return w.agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "invalid_target").alias("invalid")).select("site", F.col("w.end").alias("until"), "total", "invalid")
