"""Structured Streaming: replay protection, breaker, retry queue and metrics windows.

State is bounded: nonces leave with the watermark, breaker and queue hold a few numbers per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh_nonces(events: DataFrame, at: str = "ts", nonce: str = "nonce", window: str = "5 minutes") -> DataFrame:
    """Events whose nonce was not seen within ``window`` of event time; later ones than the watermark are refused."""
    return events.withWatermark(at, window).dropDuplicatesWithinWatermark([nonce])


def within(stamp: Column, now: Column, seconds: int) -> Column:
    """Whether an ISO time lies within ``seconds`` of ``now`` (an ISO time too), before or after; false for a text that is no time."""
    millis = lambda c: F.unix_millis(F.try_to_timestamp(c))
    return F.coalesce(F.abs(millis(now) - millis(stamp)) <= seconds * 1000, F.lit(False))


def metric_windows(events: DataFrame, at: str, keys: list[str], value: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Count, total and mean of tumbling windows."""
    found = events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return found.select(F.col("window.start").alias("start"), *keys, "n", "total", "mean")


def breaker(events: DataFrame, key: str, at: str = "ts", ok: str = "ok", failures: int = 3, cool_s: int = 30) -> DataFrame:
    """key, ts, allowed: after ``failures`` failures in a row a key's calls are refused for ``cool_s`` seconds of event time."""

    def run(keys: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count, until = state.get if state.exists else (0, 0.0)
        for pdf in parts:
            pdf = pdf.sort_values(at, kind="stable")
            out = []
            for when, good in zip(pdf[at], pdf[ok]):
                now = when.timestamp()
                allowed = now >= until
                if allowed:
                    count = 0 if good else count + 1
                    if count >= failures:
                        count, until = 0, now + cool_s
                out.append(allowed)
            yield pd.DataFrame({key: pdf[key], at: pdf[at], "allowed": out})
        state.update((count, until))

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, `{at}` timestamp, allowed boolean", "count int, until double", "append", "NoTimeout")


def retry_step(queue: DataFrame, results: DataFrame, limit: int = 5, wait_s: int = 30) -> tuple[DataFrame, DataFrame]:
    """(next queue, dead letters) of (id, attempts, due) after (id, ok, at): failures wait ``wait_s``; those at ``limit`` are dead.

    Attempts are kept in the queue, so the limit holds over calls.
    """
    met = queue.join(results, "id", "left")
    failed = met.filter(F.col("ok").isNotNull() & ~F.col("ok")).select("id", (F.col("attempts") + 1).alias("attempts"), (F.col("at") + F.expr(f"INTERVAL {int(wait_s)} SECONDS")).alias("due"))
    waiting = met.filter(F.col("ok").isNull()).select("id", "attempts", "due")
    return waiting.unionByName(failed.filter(F.col("attempts") < limit)), failed.filter(F.col("attempts") >= limit)


def memory_fold(previous: DataFrame, batch: DataFrame, keep: int = 12) -> DataFrame:
    """Next snapshot (key, occurrences, history, recurrence, stability, version) from the last one and a batch (key, docs, score, conflicts).

    Groups that the batch does not have are left out, as their memory is renewed from batches alone.
    """
    met = batch.join(previous.select("key", "occurrences", "history", "recurrence", "version"), "key", "left")
    past = F.coalesce("history", F.array().cast("array<double>"))
    grown = F.concat(past, F.array("score"))
    held = F.slice(grown, F.greatest(F.size(grown) - keep, F.lit(0)) + 1, keep)
    found = met.select(
        "key", (F.coalesce("occurrences", F.lit(0)) + F.col("docs")).cast("long").alias("occurrences"), held.alias("history"),
        (F.coalesce("recurrence", F.lit(0.0)) + F.col("conflicts")).alias("recurrence"), (F.coalesce("version", F.lit(0)) + 1).alias("version"),
    )
    drift = F.least(F.lit(1.0), F.abs(F.element_at("history", -1) - F.element_at("history", 1)))
    steady = F.when(F.size("history") <= 1, 1.0).otherwise(1 - drift)
    penalty = F.least(F.lit(1.0), F.col("recurrence") / F.greatest(F.lit(1), F.col("occurrences")))
    return found.withColumn("stability", F.round(steady * (1 - 0.5 * penalty), 6))
