"""Streams with state of their own for each key: lifecycles of postings, and alerts of sources that stop writing.

State is kept by transformWithState with event-time timers, so silence is told as soon as the watermark passes it, not when the
next event comes. Within a batch a key's times are put in order (eight bytes each); what comes out doesn't depend on how the
input is cut into batches as long as nothing is later than the watermark allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from boardlake.constants import DAY, RETENTION_DAYS
from boardlake.registry import query
from boardlake.sources.folders import shared_folder

STALL, EPISODE = 7_200, 21_600
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SECOND = 1_000_000
LIFE = "posting_id bigint, event string, at bigint"
ALERTS = "source string, stalled_from bigint, alert bigint, at bigint"


def _times(rows: Iterator[pd.DataFrame]) -> list[int]:
    """Sorted microseconds of a key's rows of one batch."""
    return np.sort(np.concatenate([r["us"].to_numpy() for r in rows])).tolist()


def _timer(us: int) -> int:
    """Milliseconds of a timer at a time or just after it."""
    return -(-us // 1000)


class Lifecycle(StatefulProcessor):
    """listed at the first sighting, delisted after a window of silence, revived by a later sighting, deleted after so long delisted;
    a sighting after that lists it anew. State: last sighting, and when it was delisted (0 if it is not)."""

    def __init__(self, window: int, keep: int) -> None:
        self.window, self.keep = window * _SECOND, keep * _SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "last bigint, delisted bigint")

    def _due(self, last: int, delisted: int) -> int:
        return delisted + self.keep if delisted else last + self.window

    def _told(self, key: tuple, events: list[tuple[str, int]]) -> Iterator[pd.DataFrame]:
        if events:
            yield pd.DataFrame({"posting_id": key[0], "event": [e for e, _ in events], "at": [t // _SECOND for _, t in events]})

    def _passed(self, state: tuple[int, int] | None, now: int, events: list[tuple[str, int]]) -> tuple[int, int] | None:
        """The state when now has come, with the events that silence until then makes."""
        while state and (due := self._due(*state)) <= now:
            events.append(("deleted" if state[1] else "delisted", due))
            state = None if state[1] else (state[0], due)
        return state

    def _keep(self, before: tuple[int, int] | None, state: tuple[int, int] | None) -> None:
        if before == state:
            return
        if before:
            self.handle.deleteTimer(_timer(self._due(*before)))
        if state is None:
            self.life.clear()
        else:
            self.life.update(state)
            self.handle.registerTimer(_timer(self._due(*state)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = tuple(self.life.get()) if self.life.exists() else None
        state, events = before, []
        for now in _times(rows):
            state = self._passed(state, now, events)
            if state is None:
                events.append(("listed", now))
            elif state[1]:
                events.append(("revived", now))
            state = (max(now, state[0]) if state else now, 0)
        self._keep(before, state)
        yield from self._told(key, events)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before, events = tuple(self.life.get()) if self.life.exists() else None, []
        state = self._passed(before, timerValues.getCurrentWatermarkInMs() * 1000, events)
        self._keep(before, state)
        yield from self._told(key, events)

    def close(self) -> None:
        pass


class Liveness(StatefulProcessor):
    """An alert as a source has written nothing for a stall, and one more for each episode that the silence lasts; a write resets it.
    State: last write, and alerts since."""

    def __init__(self, stall: int, episode: int) -> None:
        self.stall, self.episode = stall * _SECOND, episode * _SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("liveness", "last bigint, alerts bigint")

    def _due(self, last: int, alerts: int) -> int:
        return last + self.stall + alerts * self.episode

    def _until(self, state: tuple[int, int], now: int, out: list[tuple[int, int, int]]) -> tuple[int, int]:
        while (due := self._due(*state)) <= now:
            state = (state[0], state[1] + 1)
            out.append((state[0] // _SECOND, state[1], due // _SECOND))
        return state

    def _kept(self, key: tuple, before: tuple[int, int] | None, state: tuple[int, int], out: list[tuple[int, int, int]]) -> Iterator[pd.DataFrame]:
        if before != state:
            if before:
                self.handle.deleteTimer(_timer(self._due(*before)))
            self.state.update(state)
            self.handle.registerTimer(_timer(self._due(*state)))
        if out:
            stalled, alert, at = zip(*out, strict=True)
            yield pd.DataFrame({"source": key[0], "stalled_from": stalled, "alert": alert, "at": at})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before, out = tuple(self.state.get()) if self.state.exists() else None, []
        state = before
        for now in _times(rows):
            state = self._until(state, now, out) if state else (now, 0)
            if now > state[0]:
                state = (now, 0)
        yield from self._kept(key, before, state, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before, out = tuple(self.state.get()), []
        yield from self._kept(key, before, self._until(before, timerValues.getCurrentWatermarkInMs() * 1000, out), out)

    def close(self) -> None:
        pass


def lifecycle(sightings: DataFrame, window: int, keep: int = RETENTION_DAYS * DAY, late: str = "1 hour") -> DataFrame:
    """posting_id, event, at of a stream of sightings (posting_id, ts)."""
    timed = sightings.select("posting_id", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", late)
    return timed.groupBy("posting_id").transformWithStateInPandas(Lifecycle(window, keep), LIFE, "Append", "EventTime")


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First and last write of each source and hour among a task's rows; a stall can't lie between them."""
    for rows in batches:
        hour = rows.groupby(["source", rows["us"] // (3600 * _SECOND)])["us"]
        yield rows.loc[sorted({*hour.idxmin(), *hour.idxmax()})]


def liveness(writes: DataFrame, stall: int = STALL, episode: int = EPISODE, late: str = "1 hour") -> DataFrame:
    """source, stalled_from, alert (1, 2, ...), at of a stream of writes (source, ts)."""
    timed = writes.select("source", "ts", F.unix_micros("ts").alias("us"))
    few = timed.mapInPandas(_ends, timed.schema).withWatermark("ts", late)
    return few.groupBy("source").transformWithStateInPandas(Liveness(stall, episode), ALERTS, "Append", "EventTime")


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that transformWithState needs."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def run(out: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what has landed and return all rows that it has told so far; run again with the same folder, it goes on
    where it was. Rows are appended exactly once by the file sink."""
    spark = out.sparkSession
    with _rocks(spark):
        out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


def landed(spark: SparkSession, path: str, kind: str, per_batch: int | None = None) -> DataFrame:
    """A stream of the files that land at path."""
    read = spark.readStream.schema(kind)
    return (read if per_batch is None else read.option("maxFilesPerTrigger", per_batch)).parquet(path)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    kind = spark.read.parquet(path).schema
    # a pattern, so that one file and a folder of files are both read
    return landed(spark, path.replace(".parquet", "[.]parquet"), kind).withColumn("ts", F.col("ts").cast("timestamp"))


_WATERMARK = "(SELECT epoch_ms(max(ts))::BIGINT * 1000 - 3600000000 AS mark FROM events)"


@query(
    f"""WITH e AS (SELECT user_id AS posting_id, epoch_us(ts) AS t FROM events),
g AS (SELECT *, lag(t) OVER w AS before, lead(t) OVER w AS after FROM e WINDOW w AS (PARTITION BY posting_id ORDER BY t)),
s AS (SELECT posting_id, t AS first, before FROM g WHERE before IS NULL OR t - before >= 43200000000),
f AS (SELECT posting_id, t + 43200000000 AS delisted, coalesce(after, mark) AS next, after IS NULL AS open FROM g, {_WATERMARK} WHERE coalesce(after, mark) - t >= 43200000000)
SELECT posting_id, CASE WHEN before IS NULL OR first - before >= 43200000000 + 172800000000 THEN 'listed' ELSE 'revived' END AS event, first // 1000000 AS at FROM s
UNION ALL SELECT posting_id, 'delisted', delisted // 1000000 FROM f UNION ALL SELECT posting_id, 'deleted', (delisted + 172800000000) // 1000000 FROM f WHERE next >= delisted + 172800000000"""
)
def st_lifecycle_events(spark, sf_dir) -> DataFrame:
    """Lifecycles of postings by their sightings: a silence of 12 hours delists, two days more delete."""
    sightings = _events(spark, sf_dir).select(F.col("user_id").alias("posting_id"), "ts")
    return run(lifecycle(sightings, 12 * 3600, 2 * DAY), shared_folder(spark))


@query(
    f"""WITH w AS (SELECT event_type AS source, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS after FROM events),
g AS (SELECT source, t, coalesce(after, mark) - t AS gap FROM w, {_WATERMARK} WHERE coalesce(after, mark) - t >= 7200000000)
SELECT source, t // 1000000 AS stalled_from, k AS alert, (t + 7200000000 + (k - 1) * 21600000000) // 1000000 AS at
FROM (SELECT source, t, unnest(generate_series(1, 1 + (gap - 7200000000) // 21600000000)) AS k FROM g)"""
)
def st_liveness_alerts(spark, sf_dir) -> DataFrame:
    """Alerts of sources that write nothing for two hours, and again for each six hours more."""
    return run(liveness(_events(spark, sf_dir).select(F.col("event_type").alias("source"), "ts")), shared_folder(spark))
