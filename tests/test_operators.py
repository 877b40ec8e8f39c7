"""Order-dependent, stateful and source operators against plain Python on small inputs."""

import base64
import gzip
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import graph, ordered, rows
from fieldloom.sources import readers
from fieldloom.streaming import state


def test_consistency_carry(spark):
    data = [(1, 1, "k", "A", 0.5), (1, 2, "k", "B", 0.6), (1, 3, "k", "C", 0.9), (1, 4, "j", "D", 0.1), (2, 1, "k", "E", 0.2)]
    df = spark.createDataFrame(data, "doc int, at int, key string, code string, score double")
    got = ordered.consistency_carry(df, "doc", ["at"], "key", "code", "score").orderBy("doc", "at").collect()
    assert [r.carried for r in got] == ["A", "A", "C", "D", "E"]


def boxes(spark, n=40):
    data = [(k % 3, k, float(k * 37 % 100), float(k * 53 % 90), 30.0, 20.0, k * 7 % 10 / 10) for k in range(n)]
    return data, spark.createDataFrame(data, "page int, block int, x double, y double, width double, height double, conf double")


def test_suppress_overlaps(spark):
    data, df = boxes(spark)
    want = set()
    for page in range(3):
        held = []
        for r in sorted((r for r in data if r[0] == page), key=lambda r: (-r[6], r[1])):
            def iou(a, b):
                both = max(0, min(a[2] + 30, b[2] + 30) - max(a[2], b[2])) * max(0, min(a[3] + 20, b[3] + 20) - max(a[3], b[3]))
                return both / (1200 - both)
            if all(iou(r, h) < 0.3 for h in held):
                held.append(r)
                want.add(r[1])
    assert {r.block for r in ordered.suppress_overlaps(df, "page", "block", "conf", 0.3).filter("kept").collect()} == want


def test_greedy_match_takes_each_prediction_once(spark):
    data = [("p", 1, True, 0.0, 0.0), ("p", 2, True, 0.01, 0.0), ("p", 3, False, 0.01, 0.0), ("p", 4, False, 0.05, 0.0), ("p", 5, False, 9.0, 9.0)]
    df = spark.createDataFrame(data, "page string, id int, truth_row boolean, x double, y double")
    got = ordered.greedy_match(df, "page", "id", "truth_row").collect()
    assert sorted((r.truth, r.prediction) for r in got) == [(1, 3), (2, 4)]


def test_leader_clusters_and_nudging(spark):
    data, df = boxes(spark)
    got = {r.block: r.cluster for r in ordered.leader_clusters(df, "page", ["block"], 25.0).collect()}
    for page in range(3):
        centres = []
        for r in (r for r in data if r[0] == page):
            k = next((k for k, c in enumerate(centres) if math.hypot(r[2] - c[0], r[3] - c[1]) <= 25), None)
            if k is None:
                centres.append([r[2], r[3], 1])
                k = len(centres) - 1
            else:
                a, b, n = centres[k]
                centres[k] = [(a * n + r[2]) / (n + 1), (b * n + r[3]) / (n + 1), n + 1]
            assert got[r[1]] == k
    placed = ordered.nudged(df, "page", "block", "conf").collect()
    for a in placed:
        for b in placed:
            if a.page == b.page and a.block < b.block:
                assert not (abs(a.x - b.x) < 30 and abs(a.placed_y - b.placed_y) < 20)


def test_exclusive_export(spark):
    df = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (2, 1, "B"), (2, 2, "A")], "doc int, at int, code string")
    got = ordered.exclusive_export(df, "doc", ["at"], "code", {"A": ["B"]}).collect()
    assert sorted((r.doc, r.code) for r in got) == [(1, "A"), (2, "A"), (2, "B")]


def test_components_of_a_chain_and_empty_edges(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101)], "src long, dst long")
    assert {r.node: r.root for r in graph.components(edges).collect()} == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}
    assert graph.components(edges.filter("src < 0")).count() == 0


def test_difference_is_null_safe(spark):
    a = spark.createDataFrame([(1, None, 2), (2, 1, 2)], "k int, v int, w int")
    b = spark.createDataFrame([(1, None, 3), (3, 1, 1)], "k int, v int, w int")
    got = {(r.k, r.field): (r.before, r.after) for r in rows.difference(a, b, ["k"], ["v", "w"]).collect()}
    assert got == {(1, "w"): (2, 3), (2, "v"): (1, None), (2, "w"): (2, None), (3, "v"): (None, 1), (3, "w"): (None, 1)}


def test_dictionary_csv(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('code,glossary\nNamedInsured_FullName,"a, ""b"";name\nline"\n,lost\nEffectiveDate,\n')
    got = {r.code: r for r in readers.dictionary_csv(spark, str(path)).collect()}
    assert set(got) == {"NamedInsured_FullName", "EffectiveDate"}
    assert got["NamedInsured_FullName"].keywords[:2] == ['a, "b"', "name\nline"]
    assert got["EffectiveDate"].data_type == "date" and got["EffectiveDate"].description == "Effective Date"


def test_form_fields_plain_zipped_and_broken(spark):
    form = '<form><page><label>Name</label><field sid="F1" x="1" y="2"/></page></form>'
    zipped = "application/x; content-encoding=base64-gzip\n" + base64.b64encode(gzip.compress(form.encode())).decode()
    df = spark.createDataFrame([("a", form), ("b", zipped), ("c", "<form>"), ("d", None)], "form_id string, content string")
    got = {r.form_id: (r.sid, r.label, r.fault) for r in readers.form_fields(df).collect()}
    assert got["a"] == got["b"] == ("F1", "Name", None)
    assert got["c"][2] == got["d"][2] == "ParseError"


def test_checked_artefact():
    good = hashlib.sha256(b'{"a":1}').hexdigest()
    assert readers.checked_artefact('{"payload": {"a": 1}, "hash": "%s"}' % good) == {"a": 1}
    with pytest.raises(ValueError):
        readers.checked_artefact('{"payload": {"a": 2}, "hash": "%s"}' % good)


def test_layout_lines(spark):
    page = [("d", 1, "inch", [("Name", [(1.0, 1.0), (2.0, 1.5)])], [("selected", [(0.5, 1.0), (0.6, 1.1)])])]
    poly = "polygon:array<struct<x:double,y:double>>"
    df = spark.createDataFrame(page, f"doc_id string, pageNumber int, unit string, lines array<struct<content:string,{poly}>>, selectionMarks array<struct<state:string,{poly}>>")
    got = {r.kind: r.box for r in readers.layout_lines(df).collect()}
    assert got["text"].x == 96.0 and got["text"].height == 48.0 and set(got) == {"text", "mark"}


def stream(spark, tmp_path, df, run, out):
    df.write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = run(events).writeStream.format("memory").queryName(out).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(out).collect()


def test_nonces_stream(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "a"), ("2024-01-01 00:00:01", "a"), ("2024-01-01 00:00:02", "b")], "t string, nonce string")
    df = df.select(F.to_timestamp("t").alias("ts"), "nonce")
    assert sorted(r.nonce for r in stream(spark, tmp_path, df, state.fresh_nonces, "nonces")) == ["a", "b"]


def test_breaker_stream(spark, tmp_path):
    df = spark.range(8).select(F.lit("c").alias("carrier"), F.timestamp_seconds(F.col("id") * 5).alias("ts"), (F.col("id") > 5).alias("ok"))
    got = stream(spark, tmp_path, df.coalesce(1), lambda e: state.breaker(e, "carrier"), "breaker")
    assert [r.allowed for r in sorted(got, key=lambda r: r.ts)] == [True] * 3 + [False] * 5


def test_retry_and_memory(spark):
    queue = spark.createDataFrame([("a", 0), ("b", 4), ("c", 1)], "id string, attempts int").withColumn("due", F.timestamp_seconds(F.lit(0)))
    results = spark.createDataFrame([("a", False), ("b", False)], "id string, ok boolean").withColumn("at", F.timestamp_seconds(F.lit(100)))
    waiting, dead = state.retry_step(queue, results)
    assert {r.id: r.attempts for r in waiting.collect()} == {"a": 1, "c": 1} and [r.id for r in dead.collect()] == ["b"]
    before = spark.createDataFrame([("g", 3, [0.2] * 12, 1.0, 7)], "key string, occurrences long, history array<double>, recurrence double, version int")
    batch = spark.createDataFrame([("g", 2, 0.7, 0.5), ("h", 1, 0.4, 0.0)], "key string, docs int, score double, conflicts double")
    got = {r.key: r for r in state.memory_fold(before, batch).collect()}
    assert got["g"].occurrences == 5 and len(got["g"].history) == 12 and got["g"].version == 8
    assert got["g"].stability == round(0.5 * (1 - 0.5 * 0.3), 6) and got["h"].stability == 1.0
