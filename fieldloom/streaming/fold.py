"""Folds of ordered event logs: submissions through their transition table, and undo/redo histories.

Events are dealt by key and sorted by their order inside a partition; a task walks over them once and holds the state of one key, whatever the number of its
events. A fold is sequential by definition, so a key with very many events is one long task of constant memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tries of one submission, seconds until the next one, states that are remembered.
MAX_ATTEMPTS, WAIT_S, REMEMBERED = 3, 30, 12


def folded(events: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], start: Callable[[], dict], step: Callable[[dict, tuple], tuple], ddl: str) -> DataFrame:
    """key, order and what ``step`` gives for each event: it gets the key's state (first made by ``start``), which it may change, and (order, columns)."""
    order, columns = list(order), list(columns)
    dealt = events.select(key, *order, *columns).repartition(key).sortWithinPartitions(key, *order)
    kinds = dict(events.dtypes)
    names = [f.split()[0] for f in ddl.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), {}
        for pdf in parts:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                if row[0] != now:
                    now, state = row[0], start()
                out.append((*row[: 1 + len(order)], *step(state, row[1:])))
            yield pd.DataFrame(out, columns=[key, *order, *names])

    return dealt.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in [key, *order]) + ", " + ddl)


def submission_fold(events: DataFrame, key: str, at: str, ordinal: str, kind: str, max_attempts: int = MAX_ATTEMPTS, wait_s: int = WAIT_S) -> DataFrame:
    """key, at, ordinal, status, attempts, due (null unless a retry waits) and history after every event of a submission.

    Events: submit, decline and force (the gate: a declined submission waits until it is forced), accepted, pending, rejected and error (the carrier's answers to what was sent),
    retry (a try if it is due). An answer other than accepted waits ``wait_s`` seconds for a retry; at ``max_attempts`` tries the submission is dead. Submitting what is accepted or dead
    begins a new package. Events that do not fit the status change nothing; a null or unknown kind neither. ``history`` holds the last states, newest last.
    """

    def start() -> dict:
        return {"status": "new", "attempts": 0, "due": None, "forced": False, "history": []}

    def to(state: dict, status: str, due: pd.Timestamp | None = None) -> None:
        state.update(status=status, due=due)
        state["history"] = [*state["history"], status][-REMEMBERED:]

    def step(state: dict, row: tuple) -> tuple:
        when, _, what = row
        status = state["status"]
        if what == "decline" and status in ("new", "retry") and not state["forced"]:
            to(state, "blocked")
        elif what == "force":
            state["forced"] = True
            if status == "blocked":
                to(state, "new")
        elif what == "submit" and status in ("new", "accepted", "dead"):
            state["attempts"] = 1
            to(state, "sent")
        elif what == "retry" and status == "retry" and when >= state["due"]:
            state["attempts"] += 1
            to(state, "sent")
        elif what == "accepted" and status == "sent":
            to(state, "accepted")
        elif what in ("pending", "rejected", "error") and status == "sent":
            if state["attempts"] >= max_attempts:
                to(state, "dead")
            else:
                to(state, "retry", when + pd.Timedelta(seconds=wait_s))
        return state["status"], state["attempts"], state["due"], list(state["history"])

    return folded(events, key, [at, ordinal], [kind], start, step, f"status string, attempts int, due {dict(events.dtypes)[at]}, history array<string>")


def undo_fold(edits: DataFrame, key: str, ordinal: str, action: str, value: str) -> DataFrame:
    """key, ordinal, depth, redos, applied and current after every action of an edit log: edit, undo, redo.

    An edit clears what could be redone; an undo without edits, a redo without undone edits and any other action are not applied. ``depth`` is the number of edits that stand, ``current`` the
    value of the last of them. The fold carries two numbers: the value at a depth is that of the last edit that reached it.
    """

    def start() -> dict:
        return {"depth": 0, "redos": 0}

    def step(state: dict, row: tuple) -> tuple:
        what = row[1]
        applied = what == "edit" or (what == "undo" and state["depth"] > 0) or (what == "redo" and state["redos"] > 0)
        if applied:
            state["depth"] += -1 if what == "undo" else 1
            state["redos"] = 0 if what == "edit" else state["redos"] + (1 if what == "undo" else -1)
        return state["depth"], state["redos"], applied

    counted = folded(edits, key, [ordinal], [action], start, step, "depth int, redos int, applied boolean").join(edits.select(key, ordinal, action, value), [key, ordinal])
    at_depth = Window.partitionBy(key, "depth").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    current = F.when(F.col("depth") > 0, F.last(F.when(F.col(action) == "edit", F.struct(value)), ignorenulls=True).over(at_depth)[value])
    return counted.withColumn("current", current).select(key, ordinal, "depth", "redos", "applied", "current")
