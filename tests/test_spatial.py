"""Nearest neighbours by rings equal all pairs of a page."""

import random

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import numeric
from fieldloom.operators import catalogue, evaluation, spatial

FIELDS, LABELS = "page int, field int, fb struct<x:double,y:double,width:double,height:double>, wx double, wy double", "page int, label int, lb struct<x:double,y:double,width:double,height:double>"


def boxes(n, seed, pages=3, spread=1000.0):
    """Some pages with many boxes, many of them at one place, and one far away."""
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        near = rnd.random() < 0.4
        x, y = (rnd.choice([10.0, 11.0, 12.0]), rnd.choice([5.0, 6.0])) if near else (rnd.uniform(0, spread), rnd.uniform(0, spread))
        out.append((rnd.choice([1, 1, 1, 2, pages]), k, (x, y, float(rnd.randint(1, 40)), 10.0)))
    return out


@pytest.mark.parametrize(("k", "discount", "reach"), [(1, 0.0, None), (3, 0.0, None), (2, 40.0, None), (2, 0.0, 60.0)])
def test_rings_equal_all_pairs(spark, k, discount, reach):
    fields = [(p, n, b, 0.5 + n % 3, 1.0 + n % 2) for p, n, b in boxes(150, 1)] + [(9, 900, (0.0, 0.0, 1.0, 1.0), 1.0, 1.0), (1, 901, (-5000.0, 9000.0, 1.0, 1.0), 1.0, 1.0)]
    labels = [*boxes(400, 2), (1, 999, (90000.0, 5.0, 1.0, 1.0))]

    def cost(f, b):
        dx, dy = abs(f[2][0] - b[2][0]), abs(f[2][1] - b[2][1])
        if b[1] % 7 == 0 or (reach is not None and dy > reach):
            return None
        return round(dx * f[3] + dy * f[4] + (30 if b[2][0] > f[2][0] else 0) - (discount if b[1] % 5 == 0 else 0), 6)

    want = {}
    for f in fields:
        met = sorted((cost(f, b), b[1]) for b in labels if b[0] == f[0] and cost(f, b) is not None)
        want |= {(f[0], f[1], r): m for r, m in enumerate(met[:k], 1)}
    dx, dy = F.abs(F.col("fb.x") - F.col("lb.x")), F.abs(F.col("fb.y") - F.col("lb.y"))
    c = dx * F.col("wx") + dy * F.col("wy") + F.when(F.col("lb.x") > F.col("fb.x"), 30).otherwise(0) - F.when(F.col("label") % 5 == 0, discount).otherwise(0)
    c = F.when((F.col("label") % 7 != 0) & (F.lit(True) if reach is None else dy <= reach), F.round(c, 6))
    # which of the labels at one place qualifies depends on its number here, so places are told apart by it
    points = spark.createDataFrame(labels, LABELS).withColumn("own", F.col("label"))
    corner = lambda box: (F.col(f"{box}.x"), F.col(f"{box}.y"))
    got = spatial.k_nearest(
        spark.createDataFrame(fields, FIELDS), points, ["page"], "field", "label", c, k, corner("fb"), corner("lb"), (F.col("wx"), F.col("wy")), discount, (None, None if reach is None else F.lit(reach))
    )
    assert {(r.page, r.field, r["rank"]): (r.cost, r.label) for r in got.collect()} == want


def test_context_equals_all_pairs_with_repeated_boxes(spark):
    rows = [(p, n, b) for p, n, b in boxes(300, 5)] + [(4, 1000 + k, (1.0, 1.0, 2.0, 2.0)) for k in range(20)]
    df = spark.createDataFrame(rows, LABELS).select("page", F.col("label").alias("block"), F.col("lb").alias("box"))
    for k in (1, 4):
        got = {(r.page, r.block, r["rank"]): r.other for r in catalogue.context_of(df, "page", "block", k).collect()}
        middle = lambda b: (b[0] + b[2] / 2, b[1] + b[3] / 2)
        want = {}
        for p, n, b in rows:
            far = lambda o: round(((middle(b)[0] - middle(o)[0]) ** 2 + (middle(b)[1] - middle(o)[1]) ** 2) ** 0.5, 6)  # noqa: B023, E731
            met = sorted((m != n, far(o), m) for q, m, o in rows if q == p)
            want |= {(p, n, r): m for r, (_, _, m) in enumerate(met[:k], 1)}
        assert got == want


def test_nothing_to_meet(spark):
    none = spark.createDataFrame([], LABELS)
    assert spatial.k_nearest(spark.createDataFrame([], FIELDS), none, ["page"], "field", "label", numeric.centre_distance(F.col("fb"), F.col("lb"))).count() == 0


def test_layout_similarity_of_a_shifted_copy(spark):
    rows = [("f", p, "text" if k % 3 else "checkbox", 0.1 + 0.07 * k, 0.9 - 0.06 * k, 0.05, 0.01) for p in (1, 2) for k in range(10)]
    ddl = "form string, page int, kind string, x double, y double, width double, height double"
    truth = spark.createDataFrame(rows, ddl)
    shifted = truth.withColumns({"x": F.col("x") + 0.02, "y": F.col("y") - 0.01})
    pages = spark.createDataFrame([("f", 2, 4)], "form string, truth_pages int, found_pages int")
    row = evaluation.layout_similarity(truth, shifted, "form", "page", "kind", pages).first()
    assert abs(row.score - 0.5) < 1e-9 and row.median_distance < 1e-9 and row.compared_pages == 2 and row.page_coverage == 0.5
