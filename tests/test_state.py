"""Folds and stateful streams: transitions by hand, restart from the checkpoint, forgotten keys, empty tables."""

import datetime as dt

from pyspark.sql import functions as F

from fieldloom.streaming import fold, processors

T0 = dt.datetime(2024, 1, 1)
LOG = "id int, at timestamp, n int, kind string"


def log(*kinds, key=1, gap=40):
    return [(key, T0 + dt.timedelta(seconds=gap * k), k, kind) for k, kind in enumerate(kinds)]


def states(spark, rows):
    found = fold.submission_fold(spark.createDataFrame(rows, LOG), "id", "at", "n", "kind").orderBy("id", "n").collect()
    return [(r.status, r.attempts) for r in found], found


def test_submission_goes_through_its_table(spark):
    got, rows = states(spark, log("submit", "error", "retry", "pending", "retry", "rejected", "retry", "submit", "accepted", "error", None, "other"))
    assert got == [("sent", 1), ("retry", 1), ("sent", 2), ("retry", 2), ("sent", 3), ("dead", 3), ("dead", 3), ("sent", 1), ("accepted", 1), ("accepted", 1), ("accepted", 1), ("accepted", 1)]
    assert rows[1].due == T0 + dt.timedelta(seconds=70) and rows[2].due is None
    assert rows[-1].history == ["sent", "retry", "sent", "retry", "sent", "dead", "sent", "accepted"]


def test_submission_gate_and_early_retry(spark):
    got, _ = states(spark, log("decline", "submit", "force", "decline", "submit"))
    assert [s for s, _ in got] == ["blocked", "blocked", "new", "new", "sent"]
    got, _ = states(spark, log("submit", "error", "retry", gap=10))
    assert got[-1] == ("retry", 1)  # not due yet


def test_submission_remembers_twelve_states_of_many_events(spark):
    _, rows = states(spark, log(*["submit", "accepted"] * 600) + log("submit", key=2))
    assert len(rows) == 1201 and rows[1199].history == ["sent", "accepted"] * 6 and rows[1200].history == ["sent"]
    assert fold.submission_fold(spark.createDataFrame([], LOG), "id", "at", "n", "kind").count() == 0


def test_undo_and_redo(spark):
    actions = [("edit", "a"), ("edit", "b"), ("undo", None), ("redo", None), ("undo", None), ("edit", None), ("redo", None), ("undo", None), ("undo", None), ("undo", None), ("redo", None), ("redo", None), (None, "x")]
    df = spark.createDataFrame([(1, k, a, v) for k, (a, v) in enumerate(actions)], "doc int, n int, action string, value string")
    got = [(r.depth, r.redos, r.applied, r.current) for r in fold.undo_fold(df, "doc", "n", "action", "value").orderBy("n").collect()]
    assert got == [
        (1, 0, True, "a"), (2, 0, True, "b"), (1, 1, True, "a"), (2, 0, True, "b"), (1, 1, True, "a"), (2, 0, True, None), (2, 0, False, None), (1, 1, True, "a"), (0, 2, True, None), (0, 2, False, None),
        (1, 1, True, "a"), (2, 0, True, None), (2, 0, False, None),
    ]


def write(spark, rows, schema, path, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path / name))


def test_breaker_goes_on_from_its_checkpoint(spark, tmp_path):
    schema = "carrier string, ts timestamp, n int, ok boolean"
    at = lambda s: T0 + dt.timedelta(seconds=s)
    run = lambda: processors.run_available(spark, str(tmp_path / "in"), schema, lambda e: processors.allowed_calls(e, "carrier", "ts", "n", "ok"), str(tmp_path / "out"))
    write(spark, [("c", at(0), 0, False), ("c", at(1), 1, False), ("d", at(1), 9, True)], schema, tmp_path, "in")
    run()
    write(spark, [("c", at(2), 2, False), ("c", at(3), 3, True), ("c", at(32), 4, True), ("c", at(33), 5, False), ("c", at(34), 6, True), ("c", at(65), 7, False), ("c", at(66), 8, True)], schema, tmp_path, "in")
    got = {r.n: (r.allowed, r.failures) for r in run().collect()}
    # the third failure comes after the restart and opens it; thirty seconds are not more than thirty; one failure after the first let through opens it again
    assert got == {0: (True, 1), 1: (True, 2), 9: (True, 0), 2: (True, 3), 3: (False, 3), 4: (False, 3), 5: (True, 3), 6: (False, 3), 7: (True, 3), 8: (False, 3)}


def test_nonces_are_refused_over_restarts_and_forgotten_later(spark, tmp_path):
    schema = "nonce string, ts timestamp, n int, stamp timestamp"
    at = lambda s: T0 + dt.timedelta(seconds=s)
    run = lambda: processors.run_available(spark, str(tmp_path / "in"), schema, lambda e: processors.fresh_requests(e, "nonce", "ts", "n", "stamp"), str(tmp_path / "out"))
    write(spark, [("a", at(0), 0, at(0)), ("a", at(10), 1, at(10)), ("b", at(0), 2, at(301)), ("b", at(0), 3, None)], schema, tmp_path, "in")
    run()
    write(spark, [("a", at(300), 4, at(300)), ("a", at(301), 5, at(301)), ("b", at(5), 6, at(5))], schema, tmp_path, "in")
    run()
    write(spark, [("z", at(7200), 7, at(7200))], schema, tmp_path, "in")
    run()
    write(spark, [("a", at(7300), 8, at(7300))], schema, tmp_path, "in")
    got = {r.n: r.error for r in run().select("n", F.coalesce("error", F.lit("")).alias("error")).collect()}
    assert got == {0: "", 1: "nonce-used", 2: "outside-window", 3: "outside-window", 4: "nonce-used", 5: "", 6: "", 7: "", 8: ""}
