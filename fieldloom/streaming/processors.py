"""Stateful stream processors with timers: replay protection by nonces, and a circuit breaker.

Both keep a few numbers a key and forget a key by an event-time timer once these can matter no more. Rows of one key and micro-batch are taken in time order; their
number is bounded by the trigger (``maxFilesPerTrigger``), between batches order is that of arrival.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fieldloom.storage import fresh_path

#: Seconds that a nonce is refused again, failures that open a breaker, seconds until it lets one call through.
WINDOW_S, FAILURES, COOL_S = 300, 3, 30
_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _in_order(rows: Iterator[pd.DataFrame], at: str, ordinal: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values([at, ordinal], kind="stable")


class _Keyed(StatefulProcessor):
    """One value state a key, deleted by a timer."""

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if self.over(timerValues.getCurrentWatermarkInMs()):
            self.held.clear()
        return iter([])

    def over(self, now_ms: int) -> bool:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Nonces(_Keyed):
    """Whether a request is fresh: its stamp within ``window_s`` of its arrival, and its nonce not accepted within ``window_s`` before."""

    schema = "until long"

    def __init__(self, key: str, at: str, ordinal: str, stamp: str, window_s: int = WINDOW_S) -> None:
        self.names, self.window = (key, at, ordinal, stamp), pd.Timedelta(seconds=window_s)

    def over(self, now_ms: int) -> bool:
        return self.held.exists() and self.held.get()[0] // 1000 < now_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        name, at, ordinal, stamp = self.names
        until = self.held.get()[0] if self.held.exists() else None
        out = []
        for when, number, stated in _in_order(rows, at, ordinal)[[at, ordinal, stamp]].itertuples(index=False):
            now = when.value // 1000
            if pd.isna(stated) or abs(when - stated) > self.window:
                error = "outside-window"
            elif until is not None and until >= now:
                error = "nonce-used"
            else:
                error, until = None, now + self.window.value // 1000
            out.append((key[0], when, number, error is None, error))
        if until is not None:
            self.held.update((until,))
            self.handle.registerTimer(until // 1000 + 1)
        yield pd.DataFrame(out, columns=[name, at, ordinal, "valid", "error"])


class Breaker(_Keyed):
    """Whether a call may go out: ``failures`` in a row open the breaker; more than ``cool_s`` seconds later one call is let through, and one more failure opens it again."""

    schema = "failures int, opened long"

    def __init__(self, key: str, at: str, ordinal: str, ok: str, failures: int = FAILURES, cool_s: int = COOL_S) -> None:
        self.names, self.failures, self.cool = (key, at, ordinal, ok), failures, cool_s * 1_000_000

    def over(self, now_ms: int) -> bool:
        return self.held.exists() and self.held.get()[0] == 0

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        name, at, ordinal, ok = self.names
        count, opened = self.held.get() if self.held.exists() else (0, 0)
        out = []
        for when, number, good in _in_order(rows, at, ordinal)[[at, ordinal, ok]].itertuples(index=False):
            now = when.value // 1000
            allowed = count < self.failures
            if not allowed and now - opened > self.cool:
                count, allowed = self.failures - 1, True
            if allowed:
                count = 0 if good else count + 1
                if count >= self.failures:
                    opened = now
            out.append((key[0], when, number, allowed, count))
        self.held.update((count, opened))
        self.handle.registerTimer(now // 1000 + 1)
        yield pd.DataFrame(out, columns=[name, at, ordinal, "allowed", "failures"])


def fresh_requests(events: DataFrame, key: str, at: str, ordinal: str, stamp: str, window_s: int = WINDOW_S, late: str = "10 minutes") -> DataFrame:
    """key, at, ordinal, valid, error of every request of a stream."""
    kinds = dict(events.dtypes)
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in (key, at, ordinal)) + ", valid boolean, error string"
    return events.withWatermark(at, late).groupBy(key).transformWithStateInPandas(Nonces(key, at, ordinal, stamp, window_s), ddl, "Append", "EventTime")


def allowed_calls(events: DataFrame, key: str, at: str, ordinal: str, ok: str, failures: int = FAILURES, cool_s: int = COOL_S, late: str = "10 minutes") -> DataFrame:
    """key, at, ordinal, allowed and failures (in a row, after the call) of every call of a stream."""
    kinds = dict(events.dtypes)
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in (key, at, ordinal)) + ", allowed boolean, failures int"
    return events.withWatermark(at, late).groupBy(key).transformWithStateInPandas(Breaker(key, at, ordinal, ok, failures, cool_s), ddl, "Append", "EventTime")


def run_available(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], out: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Everything that lies in ``source`` (Parquet) through ``transform``, written to ``out`` with its checkpoint beside it; run again, it goes on where it stopped."""
    path = out or fresh_path(spark, f"stream-{uuid.uuid4().hex}")
    before = spark.conf.get(_ROCKS[0], None)
    spark.conf.set(*_ROCKS)
    try:
        reader = spark.readStream.schema(schema)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        sink = transform(reader.parquet(source)).writeStream.format("parquet").option("checkpointLocation", f"{path}/_checkpoint")
        sink.trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_ROCKS[0])
        else:
            spark.conf.set(_ROCKS[0], before)
    return spark.read.parquet(f"{path}/rows")
