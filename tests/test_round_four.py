"""Findings of the fourth round: whole results where values repeat, without a row or a step for each pair."""

import random
import time

from pyspark.sql import functions as F

from fieldloom import storage
from fieldloom.functions import numeric
from fieldloom.operators import binding, catalogue, evaluation, graph, joins, rows, semantics
from fieldloom.sources import readers


def fnv(text):
    h, raw = 2166136261, text.encode("utf-16-be")
    for k in range(0, len(raw), 2):
        h = (h ^ int.from_bytes(raw[k : k + 2], "big")) * 16777619 % (1 << 32)
    return f"{h:08x}"


def most_rows(df, name="numOutputRows"):
    """The most rows that a node of the executed plan made, and the collected rows."""
    rows, found = df.collect(), []

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        metric = plan.metrics().get(name)
        if metric.isDefined():
            found.append(metric.get().value())
        for k in range(plan.children().size()):
            walk(plan.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return max(found), rows


def test_family_signature_of_many_names_takes_linear_time(spark):
    """F7"""
    names = [f"Customer#{k:09d}" + ("\U0001f600é" if k % 100 == 0 else "") for k in range(12_000)]
    df = spark.createDataFrame([(1, 1.0, n) for n in names], "family int, value double, name string")
    began = time.time()
    row = evaluation.family_clusters(df, "family", "value", "name").first()
    assert row.signature == fnv("|".join(sorted(names, key=lambda n: n.encode()))) and time.time() - began < 40
    odd = spark.createDataFrame([("",), (None,), ("a",), ("\U0001f600",)], "t string").select(numeric.code_units(F.col("t")).alias("u"))
    assert [r.u for r in odd.collect()] == [[], [], [97], [0xD83D, 0xDE00]]


def test_forms_of_repeated_names_make_no_pairs(spark):
    """F10"""
    documents = spark.range(3000).select(F.col("id").alias("doc"), F.lit(-1).cast("long").alias("number"), F.concat(F.lit("blue ring "), (F.col("id") % 3).cast("string"), F.lit("0")).alias("name"))
    forms = spark.range(3000).select((F.col("id") + 10).alias("form"), F.col("id").alias("number"), F.concat(F.lit("ring "), (F.col("id") % 4).cast("string"), F.lit("0")).alias("name"))
    most, rows = most_rows(readers.choose_form(documents, forms, 0.4))
    assert most < 50_000 and len(rows) == 3000
    assert {(r.doc % 3, r.form, r.by) for r in rows} == {(0, 10, "name"), (1, 11, "name"), (2, 12, "name")}


def test_cells_of_a_small_table_are_not_broadcast(spark, tmp_path):
    """F9"""
    spark.range(20).select(F.col("id").alias("pg")).write.parquet(str(tmp_path / "pages"))
    cells = spark.read.parquet(str(tmp_path / "pages")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(199))))
    cells = cells.select("pg", F.col("k").alias("cell"), numeric.box(F.col("k") % 10 * 100, F.floor(F.col("k") / 10) * 50, F.lit(100), F.lit(50)).alias("rb"))
    labels = spark.range(2000).select((F.col("id") % 20).alias("pg"), F.col("id").alias("label"), numeric.box(F.col("id") % 1000, F.col("id") % 970, F.lit(30), F.lit(10)).alias("lb"))
    found = catalogue.contained(labels, cells, "pg")
    want = {}
    for k in range(2000):
        x, y = k % 1000, k % 970
        for c, across in ((x // 100, min(x // 100 * 100 + 100, x + 30) - x), (x // 100 + 1, x + 30 - x // 100 * 100 - 100)):
            for r, down in ((y // 50, min(y // 50 * 50 + 50, y + 10) - y), (y // 50 + 1, y + 10 - y // 50 * 50 - 50)):
                if c < 10 and r < 20 and across > 0 and down > 0 and across * down / 300 >= 0.65:
                    want[k] = (r * 10 + c, round(across * down / 300, 6))
    assert {r.label: (r.cell, r.share) for r in found.collect()} == want
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_values_that_repeat_are_judged_once(spark):
    """F3"""
    seen = F.udf(lambda v: -1 if v is None else len(v), "int").asNondeterministic()
    df = spark.range(5000).select("id", F.when(F.col("id") % 5 != 0, F.repeat(F.lit("a"), (F.col("id") % 4).cast("int"))).alias("t"))
    found = rows.each_value(df, "t", {"n": seen("t")})
    assert {(r.id % 5 == 0 or r.id % 4, r.n) for r in found.collect()} == {(True, -1), (0, 0), (1, 1), (2, 2), (3, 3)} and found.columns == ["id", "t", "n"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("BatchEvalPython") > plan.index("Join") and found.count() == 5000
    many = rows.each_value(spark.range(12_000).select(F.col("id").cast("string").alias("t")), "t", {"n": F.length("t")})
    assert many.count() == 12_000 and "Join" not in many._jdf.queryExecution().optimizedPlan().toString()


def test_widgets_that_repeat_meet_once(spark):
    """F4 and F5"""
    rnd = random.Random(4)
    whole = lambda: (float(rnd.randint(0, 150)), float(rnd.randint(0, 60)), float(rnd.randint(0, 90)), float(rnd.randint(1, 20)))
    part = lambda: (rnd.uniform(-50, 150), rnd.uniform(0, 60), rnd.uniform(0, 2000) if rnd.random() < 0.05 else rnd.uniform(1, 60), rnd.uniform(1, 20))
    made = lambda n: [(k % 3, k, rnd.choice((whole, part))()) for k in range(n)]
    entries, widgets = made(120), made(150)
    entries += [(1, 1000 + k, (5.0, 5.0, 50.0, 20.0)) for k in range(700)] + [(1, 1000, (90.0, 50.0, 50.0, 20.0))]
    widgets += [(1, 2000 + k, (5.0, 9.0, 50.0, 20.0)) for k in range(700)]

    def share(a, b):
        both = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        return round(both / min(a[2] * a[3], b[2] * b[3]), 6) if both > 0 else 0.0

    best = {}
    for p, e, a in entries:
        met = min(((-share(a, b), w) for q, w, b in widgets if p == q and share(a, b) >= 0.45), default=None)
        if met is not None:
            best[p, e] = min(best.get((p, e), met), met)
    box = "struct<x:double,y:double,width:double,height:double>"
    left = spark.createDataFrame(entries, f"page int, entry int, lb {box}").withColumn("kind", F.lit("a"))
    right = spark.createDataFrame(widgets, f"page int, widget int, rb {box}").withColumn("kind2", F.lit("b"))
    kept, remap = catalogue.merge_widgets(left, right, "page")
    most, rows_ = most_rows(remap)
    assert {(r.page, r.entry): r.widget for r in rows_} == {k: w for k, (_, w) in best.items()} and len(rows_) == len(best) and most < 10_000
    got = sorted((r.page, r.key, r.widget) for r in kept.collect())
    assert got == sorted([(p, e, False) for p, e, _ in entries if (p, e) not in best] + [(p, w, True) for p, w, _ in widgets])


def test_regions_of_a_crowded_page_take_no_square(spark):
    """F2"""
    rnd = random.Random(6)
    data = [(1, k, float(rnd.randint(0, 19_000) * 100 + rnd.randint(0, 9)), float(k % 5), 60.0, 20.0) for k in range(20_000)]
    df = spark.createDataFrame(data, "page int, k int, x double, y double, width double, height double")
    began = time.time()
    got = {r.k: (r.x, r.y, r.width, r.height) for r in binding.promoted_regions(df, "page", ["k"]).collect()}
    assert time.time() - began < 40
    held, want = {}, {}  # what meets lies in one column of a hundred
    for _, k, x, y, w, h in data:
        near = held.setdefault(x // 100, [])
        shared = lambda a, b: (max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])), max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])))
        now = (x, y, w, h)
        if sum(i * j for i, j in (shared(now, b) for b in near)) >= 0.65 * w * h:
            continue
        for b in near:
            if now and all(shared(now, b)):
                x1, y1, x2, y2, u1, v1, u2, v2 = now[0], now[1], now[0] + now[2], now[1] + now[3], b[0], b[1], b[0] + b[2], b[1] + b[3]
                cuts = [(x1, y1, u1 - x1, now[3]), (u2, y1, x2 - u2, now[3]), (x1, y1, now[2], v1 - y1), (x1, v2, now[2], y2 - v2)]
                now = max((c for c in cuts if c[2] > 0 and c[3] > 0), key=lambda c: c[2] * c[3], default=None)
        if now:
            near.append(now)
            want[k] = now
    assert got == want


def test_sets_stand_for_their_rows(spark):
    """the pairs of rows are never shuffled."""
    rnd = random.Random(7)
    data = [(k, [rnd.choice("abcdef") for _ in range(rnd.randint(0, 3))]) for k in [*range(700), 5, 6, 10, 20]]
    df = spark.createDataFrame(data, "id int, tokens array<string>")
    asked = F.col("id") % 2 == 0
    owned = {}
    for k, t in data:
        owned.setdefault(k, set()).update(t)
    want = {(a, b) for a in owned for b in owned if a % 2 == 0 and a != b and owned[a] & owned[b]}
    most, found = most_rows(joins.token_index_join(df, "id", "tokens", "tokens", asked), "shuffleRecordsWritten")
    assert sorted(map(tuple, found)) == sorted(want) and most < len(want) / 2
    want = {(a, b) for a, s in data for b, t in data if a % 2 == 0 and s and set(s) < set(t)}
    most, found = most_rows(graph.ontology(df, "id", "tokens", asked), "shuffleRecordsWritten")
    assert sorted(map(tuple, found)) == sorted(want) and most < len(want) / 2
    hints = [("a", "parent", "b"), ("a", "parent", "c"), ("d", "sibling", "a"), ("e", "parent", "b")]
    links = {(a, kind, b) for a in owned for t, kind, h in hints for b in owned if a % 2 == 0 and a != b and t in owned[a] and h in owned[b]}
    want = sorted([*links, *((b, "child", a) for a, kind, b in links if kind == "parent")])
    most, found = most_rows(semantics.ontology_links(df, spark.createDataFrame(hints, "token string, kind string, hint string"), asked), "shuffleRecordsWritten")
    assert sorted(map(tuple, found)) == want and most < len(want) / 2


def test_assignment_keeps_no_pairs(spark, monkeypatch):
    """F1"""
    monkeypatch.setattr(binding, "CHOICES", 2)
    rnd = random.Random(8)
    data = [(g, g * 1000 + f, g * 1000 + p, rnd.randint(0, 5) / 10) for g in range(3) for f in range(60) for p in range(12 * g + 5) if g or rnd.random() < 0.2]
    written = []
    monkeypatch.setattr(binding, "stored", lambda df, name="table": written.append(storage.stored(df, name)) or written[-1])
    scores = spark.createDataFrame(data, "g int, form int, file int, score double")
    got = {r.form: (r.file, r.score, r.margin) for r in binding.assigned(scores, "form", "file", "score", "g").collect()}
    by_form, want, used = {}, {}, set()
    for _, f, p, s in data:
        by_form.setdefault(f, []).append((-s, p))
    for f in sorted(by_form, key=lambda f: (min(by_form[f])[0], f)):
        free = sorted(c for c in by_form[f] if c[1] not in used)
        if free:
            s, second = -free[0][0], -sorted(by_form[f])[1][0] if len(by_form[f]) > 1 else 0.0
            want[f] = free[0][1], s, round((s - second) / s, 6) if s > 0 else 0.0
            used.add(free[0][1])
    assert got == want and max(df.count() for df in written) <= len(by_form) < len(data) / 10
