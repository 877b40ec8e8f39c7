"""Layout, binding, export and source operators on small inputs with odd rows."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import numeric, text
from fieldloom.operators import binding, catalogue, confidence, evaluation, joins, predicates, rows, semantics
from fieldloom.sources import readers, sinks

BOX = "struct<x:double,y:double,width:double,height:double>"


def random_boxes(n, seed=1, size=400):
    rnd = random.Random(seed)
    return [(k % 3, k, (float(rnd.randint(0, size)), float(rnd.randint(0, size)), float(rnd.randint(0, 300)), float(rnd.randint(1, 40)))) for k in range(n)]


def shared(a, b):
    return max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))


def test_touching_boxes_meet_once_whatever_the_cells(spark):
    data = random_boxes(60)
    df = spark.createDataFrame(data, f"page int, k int, b {BOX}")
    want = {(a[1], b[1]) for a in data for b in data if a[0] == b[0] and shared(a[2], b[2]) > 0}
    for size in (16.0, 128.0, 10_000.0):
        got = catalogue.touching(df.select("page", F.col("k").alias("l"), F.col("b").alias("lb")), df.select("page", F.col("k").alias("r"), F.col("b").alias("rb")), "page", size)
        found = [(r.l, r.r) for r in got.select("l", "r").collect()]
        assert len(found) == len(set(found)) and set(found) == want


def test_promoted_regions_share_no_area(spark):
    data = [(p, k, *b) for p, k, b in random_boxes(60, 5, 150)]
    df = spark.createDataFrame(data, "page int, k int, x double, y double, width double, height double")
    got = binding.promoted_regions(df, "page", ["k"]).collect()
    first = {p: min(k for q, k, *_ in data if q == p) for p in range(3)}
    assert {(r.page, r.k) for r in got} >= {(p, k) for p, k in first.items() if next(d for d in data if d[1] == k)[4] > 0}
    original = {d[1]: d[2:] for d in data}
    for r in got:
        x, y, w, h = original[r.k]
        assert r.width > 0 and r.height > 0 and x <= r.x and r.x + r.width <= x + w and y <= r.y and r.y + r.height <= y + h
    for a, b in itertools.combinations(got, 2):
        assert a.page != b.page or shared((a.x, a.y, a.width, a.height), (b.x, b.y, b.width, b.height)) == 0


def test_unique_names_and_schema_with_collisions_and_nulls(spark):
    data = [(1, 1, "C 2"), (1, 2, "C"), (1, 3, "C"), (1, 4, None), (1, 5, " "), (1, 6, "C"), (1, 7, "c_3"), (2, 1, None)]
    df = spark.createDataFrame(data, "doc int, at int, code string").withColumn("kind", F.lit("string"))
    names = [r.name for r in sinks.unique_names(df, "doc", ["at"], "code").orderBy("at").collect()]
    assert len(set(names)) == len(names) == 5 and {"c_2", "c", "c_3"} <= set(names)
    schemas = {r.doc: json.loads(r.schema) for r in sinks.to_schema(df, "doc", ["at"], "code", "kind").collect()}
    assert set(schemas) == {1} and set(schemas[1]["properties"]) == set(names)


def test_exclusive_rows_refuse_chains(spark):
    df = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (1, 3, "C"), (2, 1, "B"), (2, 2, "A")], "doc int, at int, code string")
    got = sorted((r.doc, r.code) for r in rows.exclusive_rows(df, "doc", "at", "code", {"A": ["B", "C"]}).collect())
    assert got == [(1, "A"), (2, "A"), (2, "B")]
    with pytest.raises(ValueError):
        rows.exclusive_rows(df, "doc", "at", "code", {"A": ["B"], "B": ["C"]})


def test_assignment_is_the_one_form_after_the_other(spark):
    rnd = random.Random(3)
    data = [(f, p, rnd.randint(0, 9) / 10) for f in range(8) for p in range(6)]
    got = {r.form: r.file for r in binding.assigned(spark.createDataFrame(data, "form int, file int, score double"), "form", "file", "score").collect()}
    want, used = {}, set()
    for form in sorted(range(8), key=lambda f: (-max(s for g, _, s in data if g == f), f)):
        free = sorted((-s, p) for g, p, s in data if g == form and p not in used)
        if free:
            want[form] = free[0][1]
            used.add(free[0][1])
    assert got == want


def test_suppression_skips_broken_patterns_and_null_texts(spark):
    assert [r[0] for r in predicates.valid_rules([("a(", 1.0, "x"), ("b", 0.0, "")])] == ["b"]
    df = spark.createDataFrame([(None,), ("",), ("Page 1 of 2",), ("Insured:",)], "t string")
    got = [r[0] for r in predicates.with_structure(df.withColumn("family", F.lit(None).cast("string")), "t", "family", "s").select("s").collect()]
    assert [g.matched for g in got[:3]] == [True] * 3 and got[0].reasons == ["empty_text"] and got[2].kinds == ["footer"]


def test_confidence_chain_is_flat_and_ordered(spark):
    assert confidence.chain_expression("s").count("s ") <= confidence.chain_expression("s").count("CASE") * 40
    one = spark.createDataFrame([(0.9, False), (0.1, True)], "s double, low boolean")
    steps = [("floor", "0.62", "low"), ("cap", "0.5", "low"), ("scale", "0.5", "NOT low"), ("add", "0.1", "true")]
    assert [round(r[0], 6) for r in one.select(F.expr(confidence.chain_expression("s", steps))).collect()] == [0.55, 0.6]


def test_fnv_counts_utf16_units(spark):
    def plain(value):
        h = 2166136261
        raw = value.encode("utf-16-be")
        for k in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[k : k + 2], "big")) * 16777619) & 0xFFFFFFFF
        return f"{h:08x}"

    texts = ["", "a", "é日", "x😀y", "a" * 300]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    assert [r[0] for r in df.select(numeric.fnv1a(F.col("t"))).collect()] == [*map(plain, texts), plain("")]


def test_optional_files_and_tampered_artefacts(spark, tmp_path):
    assert readers.taxonomy_json(spark, str(tmp_path / "none.json")).count() == 0
    assert [(r.model, r.present) for r in readers.model_bundle(spark, str(tmp_path), ["a"]).collect()] == [("a", False)]
    assert readers.read_keyed(spark, str(tmp_path / "none"), "k", "v").count() == 0
    (tmp_path / "broken.json").write_text('[{"eLabelName": "a", "category": ')
    assert readers.taxonomy_json(spark, str(tmp_path / "broken.json")).count() == 0
    bad = spark.createDataFrame([('{"payload": {"nodes": []}, "hash": "0"}',)], "content string")
    with pytest.raises(Exception, match="hash does not agree"):
        readers.artefact_rows(bad).collect()


def test_projection_check_fails_a_wrong_choice(spark):
    data = [(1, 1, "A", "n", False), (1, 2, "B", None, False)]
    df = spark.createDataFrame(data, "doc int, at int, code string, role string, x boolean")
    aliases = spark.createDataFrame([("A", "N1", "n", False)], "code string, node string, node_role string, section boolean")
    found = semantics.projected(df, aliases, "doc", "code", "at", "role")
    assert semantics.assert_chosen_first(found, "doc", "code", "chosen").count() == 2
    wrong = found.withColumn("chosen", F.col("code") == "B")
    with pytest.raises(Exception, match="first selectable"):
        semantics.assert_chosen_first(wrong, "doc", "code", "chosen").collect()


def test_empty_tables_give_no_rows(spark):
    boxes = spark.createDataFrame([], f"page int, block int, box {BOX}")
    assert joins.overlapping(boxes, "page", "block", 0.1).count() == 0 and catalogue.context_of(boxes, "page", "block", 3).count() == 0
    fields = spark.createDataFrame([], "doc int, chosen int, confidence double, threshold double, rank int, expected int, expected_rank int, disagreement boolean, weighted double")
    assert evaluation.quality_report(fields, "doc").count() == 0
    features = spark.createDataFrame([(1, [])], "k int, f array<string>")
    assert semantics.hashed_features(features, "k", "f").first().vector == [0.0] * 16


def test_vector_join_against_all_pairs(spark):
    rnd = random.Random(6)
    data = [(k, [rnd.uniform(-1, 1) for _ in range(5)]) for k in range(120)] + [(500, [0.0] * 5)]
    df = spark.createDataFrame(data, "k int, v array<double>")
    got = joins.vector_join(df.filter("k % 40 = 0"), df, "k", "v", 0.3, 4).collect()
    unit = {k: [x / (math.sqrt(sum(y * y for y in v)) or 1) for x in v] for k, v in data}
    for q in (0, 40, 80):
        near = sorted((-round(sum(a * b for a, b in zip(unit[q], unit[k])), 6), k) for k in unit if k != q)
        want = [k for s, k in near if -s >= 0.3][:4]
        assert [r.k for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_text_helpers(spark):
    df = spark.createDataFrame([('say "why?" or "are you sure?"', "1,234,567 a,b"), (None, None)], "a string, b string")
    got = df.select(text.quoted_question(F.col("a")).alias("q"), text.strip_digit_commas(F.col("b")).alias("n"), predicates.display_label(F.col("a")).alias("d")).collect()
    assert got[0].q == "are you sure?" and got[0].n == "1234567 a,b" and got[1].q is None and got[1].d == ""


def test_quantise_by_the_exact_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    from fieldloom.functions import numeric

    values = [0.3255, -0.3255, 1.005, 2.5, -2.5, 0.125, 1e-9, 0.0, 1e15 + 0.3, 4503599627370497.5, 123456.7894999999, 0.1 + 0.2, 1e300] + [(2 * k + 1) / 2000 for k in range(1000)]
    for digits in (0, 3, 6, 11):
        step = Decimal(1).scaleb(-digits)
        got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(numeric.quantise(F.col("v"), digits)).collect()]
        want = [float(Decimal(v).quantize(step, ROUND_HALF_UP)) if abs(v) * 10**digits < 2**53 else v for v in values]
        assert got == want
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double").select(numeric.quantise(F.col("v"))).collect()
    assert odd[0][0] != odd[0][0] and odd[1][0] == float("inf") and odd[2][0] is None


def test_sorted_distinct_in_collation_order(spark):
    from fieldloom.functions import text

    df = spark.createDataFrame([(["b", "a", "B", None, "\u00e1", "A", "a"],), ([],), (None,)], "v array<string>")
    assert [r[0] for r in df.select(text.sorted_distinct(F.col("v"))).collect()] == [["a", "A", "\u00e1", "b", "B"], [], None]


def test_sibling_groups(spark):
    from fieldloom.operators import joins

    chosen = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (3, "x"), (4, "c")], "doc int, code string")
    needs = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), ("x", 9)], "code string, sibling_group int")
    members = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c")], "sibling_group int, code string")
    got = sorted((r.doc, r.code, r.other) for r in joins.sibling_violations(chosen, needs, members).collect())
    assert got == [(1, "a", "c"), (2, "a", "b"), (2, "a", "c")]


def test_dice_join_equals_all_pairs(spark):
    import random

    from fieldloom.operators import joins

    rnd = random.Random(4)
    sets = [[rnd.choice("abcdefghijklmno") for _ in range(rnd.randint(0, 6))] + ["the"] * rnd.randint(0, 1) for _ in range(120)]
    left = spark.createDataFrame([(k, s) for k, s in enumerate(sets[:60])], "l int, tokens array<string>")
    right = spark.createDataFrame([(k, s) for k, s in enumerate(sets[60:])], "r int, tokens array<string>")
    for least in (0.3, 0.55, 1.0):
        got = {(r.l, r.r) for r in joins.dice_join(left, right, "l", "r", "tokens", least).collect()}
        dice = lambda a, b: 2 * len(set(a) & set(b)) / (len(set(a)) + len(set(b))) if a and b else 0.0
        assert got == {(i, j) for i in range(60) for j in range(60) if dice(sets[i], sets[60 + j]) >= least}


def test_metric_snapshot(spark):
    from fieldloom.operators import evaluation

    rows = [("s", k, float(k), k % 2 == 0) for k in range(400)] + [("t", 1, None, False)]
    df = spark.createDataFrame(rows, "service string, n int, ms double, ok boolean")
    got = {r.service: (r.good, r.load, r.mean_latency) for r in evaluation.metric_snapshot(df, "service", ["n"], "ms", {"good": F.col("ok")}, {"load": F.when(F.col("ok"), F.col("ms"))}, 12.0).collect()}
    assert got == {"s": (200, 398.0, 275.0), "t": (0, None, 12.0)}  # the mean of 150 to 399 is 274.5
