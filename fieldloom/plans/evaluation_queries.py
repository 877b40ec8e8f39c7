"""Registered evaluation operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import numeric, text
from fieldloom.operators import evaluation as E
from fieldloom.plans.predicate_queries import flags, rx
from fieldloom.plans.tables import BLOCKS, CANDIDATES, PROMPT_BLOCKS, blocks, candidates, normalised_sql, prompt_blocks, table
from fieldloom.registry import register


def fnv_sql(x: str) -> str:
    """FNV-1a of a text of characters up to U+FFFF."""
    return f"printf('%08x', CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(regexp_extract_all({x}, '(?s).'), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS BIGINT))"


@register("chosen_ranks", f"WITH {CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY conf DESC, sim DESC, code, ordinal) AS rn, CASE WHEN doc % 5 = 0 THEN 'C' || (doc % 40) ELSE max(code) OVER (PARTITION BY doc) END AS chosen FROM cand) SELECT doc, min(chosen) AS chosen, CAST(coalesce(min(CASE WHEN code = chosen THEN rn END), -1) AS INTEGER) AS rank FROM r GROUP BY doc")
def chosen_ranks(spark, sf_dir):
    c = candidates(spark, sf_dir)
    w = E.Window.partitionBy("doc")
    c = c.withColumn("chosen", F.when(F.col("doc") % 5 == 0, F.concat(F.lit("C"), (F.col("doc") % 40).cast("string"))).otherwise(F.max("code").over(w)))
    return E.chosen_rank(c, ["doc"], [F.col("conf").desc(), F.col("sim").desc(), F.col("code"), F.col("ordinal")], "code", "chosen").withColumn("rank", F.coalesce(F.col("rank"), F.lit(-1)))


_QF = """q AS (SELECT l_suppkey AS doc, CASE WHEN l_partkey % 9 <> 0 THEN l_partkey % 5 END AS chosen, round(l_discount * 10, 6) AS confidence, 0.5 + (l_partkey % 3) / 10.0::DOUBLE AS threshold, CASE WHEN l_partkey % 9 <> 0 AND l_partkey % 4 <> 0 THEN l_linenumber END AS rank,
 CASE WHEN l_orderkey % 3 <> 0 THEN l_orderkey % 5 END AS expected, CASE WHEN l_orderkey % 2 = 0 THEN l_linenumber END AS expected_rank, l_quantity > 40 AS disagreement, round(l_tax * 12.5, 6) AS weighted FROM lineitem)"""
_R = "CASE WHEN {w} > 0 THEN round({p} / {w}, 6) ELSE 0.0 END"


def _ratio(p: str, w: str) -> str:
    return _R.format(p=p, w=w)


_N, _NM, _NK = "count(*)", "count(*) FILTER (chosen IS NOT NULL)", "count(*) FILTER (expected IS NOT NULL)"


@register("quality_report", f"""WITH {_QF} SELECT doc, {_N} AS fields, {_NM} AS mapped, {_ratio(_NM, _N)} AS mapped_rate, {_ratio('count(*) FILTER (chosen = expected)', _NK)} AS exact_accuracy,
 {_ratio('count(*) FILTER (expected IS NOT NULL AND expected_rank <= 3)', _NK)} AS top_n_accuracy, {_ratio('count(*) FILTER (chosen IS NOT NULL AND rank <= 3)', _N)} AS chosen_in_top_n, {_ratio('count(*) FILTER (chosen IS NOT NULL AND confidence >= threshold)', _N)} AS calibrated,
 count(*) FILTER (chosen IS NOT NULL AND confidence < threshold) AS low_confidence, count(*) FILTER (chosen IS NOT NULL AND confidence < threshold AND confidence >= greatest(0, threshold - 0.1)) AS borderline, {_ratio('count(*) FILTER (disagreement)', _N)} AS disagreement_rate,
 {_ratio('sum(CASE WHEN chosen IS NOT NULL THEN greatest(0, least(1, coalesce(1.0 / rank, 0.0) * confidence / threshold)) ELSE 0.0 END)', _N)} AS ranking_quality, {_ratio('sum(CASE WHEN chosen IS NOT NULL THEN greatest(0, least(1, weighted)) ELSE 0.0 END)', _N)} AS signal_stability FROM q GROUP BY doc""")
def quality_report(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey")
    fields = li.select(
        F.col("l_suppkey").alias("doc"), F.when(part % 9 != 0, part % 5).alias("chosen"), F.round(F.col("l_discount") * 10, 6).alias("confidence"), (0.5 + (part % 3) / 10.0).alias("threshold"),
        F.when((part % 9 != 0) & (part % 4 != 0), F.col("l_linenumber")).alias("rank"), F.when(F.col("l_orderkey") % 3 != 0, F.col("l_orderkey") % 5).alias("expected"),
        F.when(F.col("l_orderkey") % 2 == 0, F.col("l_linenumber")).alias("expected_rank"), (F.col("l_quantity") > 40).alias("disagreement"), F.round(F.col("l_tax") * 12.5, 6).alias("weighted"),
    )
    return E.quality_report(fields, "doc")


@register("family_bias", f"WITH {CANDIDATES} SELECT family, count(*) AS n, round(avg(conf), 6) AS mean, round(count(*) FILTER (conf < sim) / count(*), 6) AS below_rate FROM cand GROUP BY family")
def family_bias(spark, sf_dir):
    return E.family_bias(candidates(spark, sf_dir), "family", "conf", "sim")


@register("cross_namespace", f"WITH {CANDIDATES}, e AS (SELECT code AS namespace, avg(conf) AS mean FROM cand GROUP BY 1), o AS (SELECT *, avg(mean) OVER () AS overall FROM e) SELECT namespace, round(mean, 6) AS mean, round(overall, 6) AS overall, round(avg(abs(mean - overall)) OVER (), 6) AS deviation FROM o")
def cross_namespace(spark, sf_dir):
    return E.cross_namespace(candidates(spark, sf_dir).withColumnRenamed("code", "namespace"), "namespace", "conf")


CHECKS = [
    E.Check("named-insured", "code <> 'C3'", hard=True), E.Check("policy-words", "NOT contains(lower(text), 'policy') OR code = 'C7'", impact=0.06),
    E.Check("subcontract", "NOT contains(lower(text), 'contractor') OR conf >= 0.5", impact=0.08), E.Check("exclusive", "NOT (conf > 0.8 AND code = 'C9')", hard=True),
]


@register("rule_scores", f"""WITH {PROMPT_BLOCKS}, q AS (SELECT page, block, text, conf, 'C' || CAST(block // 100 % 40 AS VARCHAR) AS code FROM pb) SELECT page, block, round({' + '.join(f'(CASE WHEN {c.condition} THEN {c.impact} ELSE {-c.impact} END)::DOUBLE' for c in sorted(CHECKS, key=lambda c: c.name))}, 6) AS score_delta,
 array_to_string({flags([(c.name, (f"(NOT ({c.condition}) AND page % 4 <> 0)" if c.name == 'exclusive' else f"NOT ({c.condition})")) for c in sorted(CHECKS, key=lambda c: c.name) if c.hard])}, ',') AS failures FROM q""")
def rule_scores(spark, sf_dir):
    b = prompt_blocks(spark, sf_dir).withColumn("code", F.concat(F.lit("C"), (F.floor(F.col("block") / 100) % 40).cast("string")))
    forced = F.create_map(F.lit("exclusive"), F.when(F.col("page") % 4 == 0, True))
    return E.rule_scores(b, CHECKS, forced).select("page", "block", "score_delta", F.array_join("hard_failures", ",").alias("failures"))


@register("decision_rollup", f"""WITH {CANDIDATES}, e AS (SELECT doc, max(conf) AS s, count(*) FILTER (code = 'C1' AND conf > 0.8) AS b, count(*) FILTER (code = 'C2') AS c, count(*) FILTER (code = 'C3') AS a FROM cand GROUP BY doc),
 o AS (SELECT DISTINCT doc, CASE WHEN doc % 34 = 0 THEN 'accept' ELSE 'refer-to-underwriter' END AS forced FROM cand WHERE doc % 17 = 0),
 w AS (SELECT e.*, forced, CASE WHEN b > 0 OR s >= 0.9 THEN 'decline' WHEN s >= 0.67 OR a > 0 THEN 'refer-to-underwriter' WHEN s >= 0.4 OR c > 0 THEN 'accept-with-conditions' ELSE 'accept' END AS own FROM e LEFT JOIN o USING (doc))
SELECT doc, coalesce(forced, own) AS outcome, CASE WHEN own <> 'accept-with-conditions' THEN '' WHEN c > 0 THEN 'additional-documentation,rule-exception-review' ELSE 'additional-documentation' END AS conditions FROM w""")
def decision_rollup(spark, sf_dir):
    c = candidates(spark, sf_dir)
    keys = c.filter("doc % 17 = 0").select("doc").distinct()
    forced = keys.select("doc", F.lit(1).alias("ordinal"), F.lit("decline").alias("forced")).unionByName(keys.select("doc", F.lit(2).alias("ordinal"), F.when(F.col("doc") % 34 == 0, "accept").otherwise("refer-to-underwriter").alias("forced")))
    code = F.col("code")
    found = E.decision_rollup(c, "doc", "conf", (code == "C1") & (F.col("conf") > 0.8), code == "C2", code == "C3", forced)
    return found.select("doc", "outcome", F.array_join("conditions", ",").alias("conditions"))


@register("family_clusters", f"SELECT CAST(c_nationkey AS BIGINT) AS family, count(*) AS n, round(avg(c_acctbal), 6) AS mean, {fnv_sql('string_agg(c_name, chr(124) ORDER BY c_name)')} AS signature FROM customer GROUP BY 1")
def family_clusters(spark, sf_dir):
    return E.family_clusters(table(spark, sf_dir, "customer").withColumn("family", F.col("c_nationkey").cast("long")), "family", "c_acctbal", "c_name")


@register("calibration_suggestions", f"""WITH {CANDIDATES}, e AS (SELECT family, code, count(*) AS n, avg(conf) AS m, avg(CASE WHEN abs(conf - sim) > 0.5 THEN 1 ELSE 0 END) AS g FROM cand GROUP BY 1, 2 HAVING count(*) >= 2 AND NOT (avg(conf) >= 0.5 AND avg(CASE WHEN abs(conf - sim) > 0.5 THEN 1 ELSE 0 END) < 0.35)),
 r AS (SELECT *, round(greatest(0.4, least(0.95, m + 0.08)), 6) AS proposed, round(least(1.0, n / 5 + g * 0.4), 6) AS confidence FROM e)
SELECT family, CAST(rank AS INTEGER) AS rank, code, n, proposed, confidence FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY confidence DESC, code) AS rank FROM r) WHERE rank <= 12""")
def calibration_suggestions(spark, sf_dir):
    return E.calibration_suggestions(candidates(spark, sf_dir), ["family"], "code", "conf", F.abs(F.col("conf") - F.col("sim")) > 0.5, 0.5, 0.4)


ERROR_KINDS = ["candidate_ranking", "field_type", "label_pairing", "unmapped_field", "label_mismatch", "suppression", "grouping", "table_detection", "duplicate"]


@register("error_totals", f"""WITH e AS (SELECT l_suppkey AS form, l_partkey % 11 AS k FROM lineitem), f AS (SELECT s_suppkey AS form, 100 + s_suppkey % 700 AS fields FROM supplier)
SELECT f.form, f.fields, {', '.join(f'count(*) FILTER (k = {k}) AS {name}' for k, name in enumerate(ERROR_KINDS))}, count(k) AS errors, round(1 - count(k) / f.fields, 6) AS accuracy FROM f LEFT JOIN e USING (form) GROUP BY 1, 2""")
def error_totals(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, [*ERROR_KINDS, "other", "none"])), (F.col("l_partkey") % 11 + 1).cast("int"))
    errors = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("form"), kind.alias("kind"))
    fields = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("form"), (100 + F.col("s_suppkey") % 700).alias("fields"))
    return E.error_totals(errors, "form", "kind", ERROR_KINDS, fields)


@register("accuracy_counters", f"""WITH {CANDIDATES} SELECT family, count(*) AS n, count(*) FILTER (conf >= 0.8) AS accepted, count(*) FILTER (conf >= 0.6 AND conf < 0.8) AS review, count(*) FILTER (conf < 0.6) AS rejected, count(*) FILTER (conf > sim) AS improved, count(*) FILTER (code = 'C1' OR code = 'C2') AS anchors,
 round(count(*) FILTER (conf >= 0.8) / greatest(count(*), 1), 6) AS accepted_rate, round(count(*) FILTER (conf > sim) / greatest(count(*), 1), 6) AS improved_rate FROM cand GROUP BY family""")
def accuracy_counters(spark, sf_dir):
    conf = F.col("conf")
    counts = {"accepted": conf >= 0.8, "review": (conf >= 0.6) & (conf < 0.8), "rejected": conf < 0.6, "improved": conf > F.col("sim"), "anchors": F.col("code").isin("C1", "C2")}
    return E.counters(candidates(spark, sf_dir), ["family"], counts, ["accepted", "improved"])


@register("same_counts", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS left_n, coalesce(b.n, 0) AS right_n, coalesce(a.n, 0) = coalesce(b.n, 0) AS same FROM (SELECT l_partkey % 50 AS k, count(*) AS n FROM lineitem WHERE l_partkey % 50 < 40 GROUP BY 1) a FULL JOIN (SELECT l_suppkey % 50 AS k, count(*) AS n FROM lineitem GROUP BY 1) b ON a.k = b.k")
def same_counts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return E.same_counts(li.select((F.col("l_partkey") % 50).alias("k")).filter("k < 40"), li.select((F.col("l_suppkey") % 50).alias("k")), ["k"])


@register("alignment_scores", """WITH p AS (SELECT l_suppkey AS form, (l_partkey % 100) / 1000.0::DOUBLE AS a, (l_partkey % 100 + l_linenumber) / 1000.0::DOUBLE AS b, (l_orderkey % 100) / 1000.0::DOUBLE AS c, (l_orderkey % 100 + l_partkey % 3) / 1000.0::DOUBLE AS d FROM lineitem),
 s AS (SELECT form, median(a - b) AS dx, median(c - d) AS dy FROM p GROUP BY 1), e AS (SELECT form, s.dx, s.dy, sqrt(avg(power(a - b - dx, 2) + power(c - d - dy, 2))) AS rmse FROM p JOIN s USING (form) GROUP BY ALL)
SELECT form, round(dx, 6) AS dx, round(dy, 6) AS dy, round(rmse, 6) AS rmse, round(exp(-30 * rmse), 6) AS score FROM e""")
def alignment_scores(spark, sf_dir):
    part, order = F.col("l_partkey") % 100, F.col("l_orderkey") % 100
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("form"), (part / 1000.0).alias("a"), ((part + F.col("l_linenumber")) / 1000.0).alias("b"), (order / 1000.0).alias("c"), ((order + F.col("l_partkey") % 3) / 1000.0).alias("d"))
    return E.alignment_score(p, ["form"], ("a", "c"), ("b", "d")).select("form", *[F.round(c, 6).alias(c) for c in ("dx", "dy", "rmse", "score")])


_LAYOUT = """a AS (SELECT l_suppkey % 50 AS form, l_orderkey % 8 AS page, CASE WHEN l_returnflag = 'R' THEN 'checkbox' ELSE 'text' END AS kind, l_linenumber % 2 = 1 AS stated, (l_partkey % 600) / 800.0::DOUBLE AS x,
  (l_orderkey % 1000) / 1000.0::DOUBLE AS y, (60 + l_partkey % 40) / 800.0::DOUBLE AS w, (10 + l_suppkey % 7) / 1000.0::DOUBLE AS h FROM lineitem)"""


@register("layout_similarity", f"""WITH {_LAYOUT}, t AS (SELECT *, row_number() OVER () AS id FROM a WHERE stated), f AS (SELECT form, page, kind, x + 0.01 AS x, y - 0.02 AS y, w, h FROM a WHERE NOT stated AND page <> form % 8),
 tm AS (SELECT form, page, median(x) AS tx, median(y) AS ty, count(*) AS tn FROM t GROUP BY 1, 2), fm AS (SELECT form, page, median(x) AS fx, median(y) AS fy, count(*) AS fn FROM f GROUP BY 1, 2),
 n AS (SELECT t.form, t.page, t.id, min(abs(t.x - (f.x + tx - fx)) + abs(t.y - (f.y + ty - fy)) + abs(t.w - f.w) * 0.5 + abs(t.h - f.h) * 0.5) AS d FROM t JOIN f USING (form, page, kind) JOIN tm USING (form, page) JOIN fm USING (form, page) GROUP BY ALL),
 p AS (SELECT form, page, median(d) AS d FROM n GROUP BY 1, 2), s AS (SELECT p.form, p.d, exp(-24 * p.d) * sqrt(least(tn, fn) / greatest(tn, fn)) AS score FROM p JOIN tm USING (form, page) JOIN fm USING (form, page))
SELECT form, round(avg(score) * 0.875, 6) AS score, round(median(d), 6) AS median_distance, count(*) AS compared_pages, 0.875::DOUBLE AS page_coverage FROM s GROUP BY form""")
def layout_similarity(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a = li.select(
        (F.col("l_suppkey") % 50).alias("form"), (F.col("l_orderkey") % 8).alias("page"), F.when(F.col("l_returnflag") == "R", "checkbox").otherwise("text").alias("kind"), (F.col("l_linenumber") % 2 == 1).alias("stated"),
        ((F.col("l_partkey") % 600) / 800.0).alias("x"), ((F.col("l_orderkey") % 1000) / 1000.0).alias("y"), ((60 + F.col("l_partkey") % 40) / 800.0).alias("width"), ((10 + F.col("l_suppkey") % 7) / 1000.0).alias("height"),
    )
    found = a.filter("not stated and page <> form % 8").withColumns({"x": F.col("x") + 0.01, "y": F.col("y") - 0.02})
    pages = a.select("form").distinct().withColumns({"truth_pages": F.lit(8), "found_pages": F.lit(7)})
    out = E.layout_similarity(a.filter("stated").drop("stated"), found.drop("stated"), "form", "page", "kind", pages)
    return out.select("form", F.round("score", 6).alias("score"), F.round("median_distance", 6).alias("median_distance"), "compared_pages", "page_coverage")


@register("hot_spots", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a >= b AND a >= c THEN 'extract' WHEN b >= c THEN 'map' ELSE 'export' END AS stage, greatest(a, b, c) AS ms FROM (SELECT *, l_quantity AS a, CAST(l_partkey % 50 AS DOUBLE) AS b, CAST(l_suppkey % 50 AS DOUBLE) AS c FROM lineitem)")
def hot_spots(spark, sf_dir):
    h = E.hot_spot({"extract": F.col("l_quantity"), "map": F.col("l_partkey") % 50, "export": F.col("l_suppkey") % 50})
    return table(spark, sf_dir, "lineitem").withColumn("h", h).select("l_orderkey", "l_linenumber", "l_partkey", "h.stage", "h.ms")


@register("structure_counts", f"WITH {BLOCKS} SELECT page, count(*) AS n, count(*) FILTER (flag = 'A') AS tables, count(*) FILTER (flag = 'N') AS labels, count(*) FILTER (flag = 'R') AS marks FROM blk GROUP BY page")
def structure_counts(spark, sf_dir):
    flag = F.col("flag")
    return E.counters(blocks(spark, sf_dir), ["page"], {"tables": flag == "A", "labels": flag == "N", "marks": flag == "R"})


@register("manifest_check", """WITH a AS (SELECT l_suppkey AS form, count(*) FILTER (l_returnflag = 'A') AS x, count(*) FILTER (l_returnflag = 'N') AS y FROM lineitem GROUP BY 1), s AS (SELECT form, x + form % 2 AS x, y + CASE WHEN form % 3 = 0 THEN 1 ELSE 0 END AS y FROM a WHERE form % 7 <> 0)
SELECT a.form, CASE WHEN s.form IS NULL THEN 'fields,labels' ELSE array_to_string(list_filter([CASE WHEN s.x <> a.x THEN 'fields' END, CASE WHEN s.y <> a.y THEN 'labels' END], lambda v: v IS NOT NULL), ',') END AS failed, s.form IS NOT NULL AND s.x = a.x AND s.y = a.y AS ok FROM a LEFT JOIN s USING (form)""")
def manifest_check(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("form"), "l_returnflag")
    counts = {"fields": F.col("l_returnflag") == "A", "labels": F.col("l_returnflag") == "N"}
    actual = rows.groupBy("form").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    stated = actual.filter("form % 7 <> 0").select("form", (F.col("fields") + F.col("form") % 2).alias("fields"), (F.col("labels") + (F.col("form") % 3 == 0).cast("int")).alias("labels"))
    return E.reconcile(stated, rows, "form", counts).select("form", F.array_join("failed", ",").alias("failed"), "ok")


@register("graded_difference", "SELECT code, 'removed' AS change, 'error' AS grade FROM (SELECT DISTINCT l_partkey * 100 + l_suppkey % 100 AS code FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT DISTINCT l_partkey * 100 + l_suppkey % 100 FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT code, 'added', 'warning' FROM (SELECT DISTINCT l_partkey * 100 + l_suppkey % 100 AS code FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT DISTINCT l_partkey * 100 + l_suppkey % 100 FROM lineitem WHERE l_returnflag = 'A')")
def graded_difference(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("code"), "l_returnflag")
    return E.graded_difference(li.filter("l_returnflag = 'A'"), li.filter("l_returnflag = 'R'"), ["code"])


@register("one_sided_difference", "SELECT o.o_orderkey AS family, CASE WHEN o.o_orderkey % 3 = 0 THEN 'added' ELSE 'changed' END AS change, CASE WHEN o.o_orderkey % 3 <> 0 THEN o_orderstatus END AS before, CASE WHEN o.o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS after FROM orders o WHERE o.o_orderkey % 3 = 0 OR (o.o_orderkey % 4 = 0 AND o_orderstatus <> 'X')")
def one_sided_difference(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("family"), F.col("o_orderstatus").alias("value"))
    after = orders.withColumn("value", F.when(F.col("family") % 4 == 0, "X").otherwise(F.col("value")))
    return E.one_sided_difference(orders.filter("family % 3 <> 0"), after, "family", "value")


EXPECTED = [E.Expectation("E1", record=None, pattern="named insured"), E.Expectation("E2", pattern="policy|premium"), E.Expectation("E3", record=None, pattern="^zip")]


@register("expectations", f"WITH {PROMPT_BLOCKS} SELECT page, block, CASE WHEN {rx('text', '(?i)named insured')} THEN 'E1' WHEN {rx('text', '(?i)policy|premium')} THEN 'E2' WHEN {rx('text', '(?i)^zip')} THEN 'E3' END AS expected FROM pb")
def expectations(spark, sf_dir):
    return E.with_expectation(prompt_blocks(spark, sf_dir), "block", "text", EXPECTED).select("page", "block", "expected")


@register("export_faults", """WITH a AS (SELECT DISTINCT l_orderkey AS doc, 'Code' || (l_partkey % 9) AS code FROM lineitem), x AS (SELECT l_orderkey AS doc, CASE l_partkey % 9 WHEN 1 THEN 'LimitCode' WHEN 2 THEN 'EffectiveDate' ELSE 'Code' || (l_partkey % 9) END AS code, CASE WHEN l_suppkey % 2 = 0 THEN '12' ELSE 'abc' END AS value FROM lineitem WHERE l_suppkey % 5 <> 0), p AS (SELECT DISTINCT doc, code FROM x)
SELECT doc, code, 'missing' AS fault FROM a WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc = a.doc AND p.code = a.code) UNION ALL SELECT DISTINCT doc, code, 'type' FROM x WHERE (code = 'LimitCode' AND value = 'abc') OR code = 'EffectiveDate'
UNION ALL SELECT doc, code, 'cardinality' FROM x WHERE code IN ('Code3', 'Code4') GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT doc, code, 'dependency' FROM p WHERE code = 'Code5' AND NOT EXISTS (SELECT 1 FROM p q WHERE q.doc = p.doc AND q.code = 'Code6')""")
def export_faults(spark, sf_dir):
    li, k = table(spark, sf_dir, "lineitem"), F.col("l_partkey") % 9
    plain = F.concat(F.lit("Code"), k.cast("string"))
    accepted = li.select(F.col("l_orderkey").alias("doc"), plain.alias("code"))
    code = F.when(k == 1, "LimitCode").when(k == 2, "EffectiveDate").otherwise(plain)
    exported = li.filter("l_suppkey % 5 <> 0").select(F.col("l_orderkey").alias("doc"), code.alias("code"), F.when(F.col("l_suppkey") % 2 == 0, "12").otherwise("abc").alias("value"))
    return E.export_faults(accepted, exported, "doc", "code", "value", ["Code3", "Code4"], {"Code5": "Code6"})


@register("replay_mismatch", f"""WITH {BLOCKS}, b AS (SELECT block, min(flag) AS flag, min(x) AS x, min(page) AS page FROM blk GROUP BY 1)
SELECT block, CASE WHEN block % 13 = 0 THEN 'missing' WHEN block % 11 = 0 THEN 'label' WHEN block % 7 = 0 THEN 'category' WHEN block % 5 = 0 THEN 'box' END AS mismatch FROM b""")
def replay_mismatch(spark, sf_dir):
    return _replayed(spark, sf_dir)


def _replayed(spark, sf_dir):
    b = blocks(spark, sf_dir).groupBy("block").agg(F.min("flag").alias("label"), F.min("box.x").alias("x"), F.min("page").alias("page")).withColumn("category", F.col("page") % 4)
    at = lambda shift: numeric.box(F.col("x") + shift, F.lit(0), F.lit(10), F.lit(10))
    block = F.col("block")
    fresh = b.filter(block % 13 != 0).select("block", F.when(block % 11 == 0, "?").otherwise(F.col("label")).alias("label"), (F.col("category") + (block % 7 == 0).cast("int")).alias("category"), at(F.when(block % 5 == 0, 9).otherwise(3)).alias("box"), F.lit(2).alias("ordinal"))
    stale = b.select("block", F.lit("stale").alias("label"), "category", at(F.lit(0)).alias("box"), F.lit(1).alias("ordinal")).filter(block % 13 != 0)
    return E.replay_mismatch(b.withColumn("box", at(F.lit(0))), stale.unionByName(fresh), "block", "label", "category", "ordinal").select("block", "mismatch")


@register("mismatch_rates", f"""WITH {BLOCKS}, m AS (SELECT DISTINCT block, CASE WHEN block % 13 = 0 THEN 'missing' WHEN block % 11 = 0 THEN 'label' WHEN block % 7 = 0 THEN 'category' WHEN block % 5 = 0 THEN 'box' END AS k FROM blk)
SELECT block % 100 AS quantity, count(*) AS n, count(*) FILTER (k = 'missing') AS missing, count(*) FILTER (k = 'label') AS label, count(*) FILTER (k = 'category') AS category, count(*) FILTER (k = 'box') AS box, round(count(*) FILTER (k = 'missing') / count(*), 6) AS missing_rate,
 round(count(*) FILTER (k = 'label') / count(*), 6) AS label_rate, round(count(*) FILTER (k = 'category') / count(*), 6) AS category_rate, round(count(*) FILTER (k = 'box') / count(*), 6) AS box_rate, round(count(k) / count(*), 6) AS any_rate FROM m GROUP BY 1""")
def mismatch_rates(spark, sf_dir):
    found = _replayed(spark, sf_dir).withColumn("quantity", F.col("block") % 100)
    return E.mismatch_rates(found, ["quantity"], "mismatch", ["missing", "label", "category", "box"])


@register("text_contradictions", f"""WITH {PROMPT_BLOCKS}, q AS (SELECT {normalised_sql("text || ' ' || CAST(page % 400 AS VARCHAR)")} AS text, block % 3 AS code, conf FROM pb WHERE conf >= 0.2) SELECT text, count(*) AS n, CAST(count(DISTINCT code) AS INTEGER) AS n_codes, min(conf) AS least FROM q WHERE text <> '' GROUP BY text HAVING count(*) >= 2 AND count(DISTINCT code) >= 2 AND min(conf) >= 0.3""")
def text_contradictions(spark, sf_dir):
    b = prompt_blocks(spark, sf_dir).filter("conf >= 0.2").withColumns({"code": F.col("block") % 3, "value": F.concat("text", F.lit(" "), (F.col("page") % 400).cast("string"))})
    return E.duplicate_contradictions(b, "value", "code", "conf", 0.3)


@register("metric_snapshot", """WITH r AS (SELECT user_id % 6 AS service, ts, event_id, event_type, value FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts DESC, event_id DESC) AS rn FROM r WHERE event_type <> 'signup' AND service <> 5)
SELECT r.service, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS sales, arg_max(value, (ts, event_id)) FILTER (event_type = 'view') AS load, any_value(coalesce(m, 12.0)) AS mean_latency
FROM r LEFT JOIN (SELECT service, floor(avg(value) + 0.5) AS m FROM l WHERE rn <= 250 GROUP BY 1) k ON k.service = r.service GROUP BY 1""")
def metric_snapshot(spark, sf_dir):
    kind = F.col("event_type")
    r = table(spark, sf_dir, "events").select((F.col("user_id") % 6).alias("service"), "ts", "event_id", "event_type", "value")
    r = r.withColumn("latency", F.when((kind != "signup") & (F.col("service") != 5), F.col("value")))
    return E.metric_snapshot(r, "service", ["ts", "event_id"], "latency", {"errors": kind == "error", "sales": kind == "purchase"}, {"load": F.when(kind == "view", F.col("value"))}, 12.0)


@register("sibling_violations", """WITH c AS (SELECT DISTINCT l_orderkey AS doc, l_partkey % 40 AS n FROM lineitem), m AS (SELECT i AS n, i % 8 AS grp FROM range(0, 24) t(i))
SELECT a.doc, 'C' || a.n AS code, 'missing-sibling' AS kind, 'C' || m.n AS other FROM c a JOIN m ON m.grp = a.n % 8 AND m.n <> a.n WHERE a.n % 4 < 2 AND NOT EXISTS (SELECT 1 FROM c b WHERE b.doc = a.doc AND b.n = m.n)""")
def sibling_violations(spark, sf_dir):
    from fieldloom.operators import joins

    code = lambda c: F.concat(F.lit("C"), c.cast("string"))
    chosen = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), code(F.col("l_partkey") % 40).alias("code"))
    numbers = spark.range(40).select(code(F.col("id")).alias("code"), "id", (F.col("id") % 8).alias("sibling_group"))
    return joins.sibling_violations(chosen, numbers.filter("id % 4 < 2"), numbers.filter("id < 24"))


_TIE = "(l_partkey * 7 + l_orderkey) % 40000"


@register("quantised_values", f"""WITH k AS (SELECT {_TIE} AS k FROM lineitem), x AS (SELECT DISTINCT k, (2 * k + 1) / 2000.0::DOUBLE AS x FROM k)
SELECT k, CASE WHEN (2 * k + 1) % 125 = 0 THEN (k + 1) / 1000.0::DOUBLE ELSE CAST(printf('%.3f', x) AS DOUBLE) END AS up, CASE WHEN (2 * k + 1) % 125 = 0 THEN -(k + 1) / 1000.0::DOUBLE ELSE CAST(printf('%.3f', -x) AS DOUBLE) END AS down, CAST(printf('%.7f', x / 7) AS DOUBLE) AS fine FROM x""")
def quantised_values(spark, sf_dir):
    k = table(spark, sf_dir, "lineitem").select(F.expr(_TIE).alias("k")).distinct()
    x = (2 * F.col("k") + 1) / F.lit(2000.0)
    return k.select("k", numeric.quantise(x, 3).alias("up"), numeric.quantise(-x, 3).alias("down"), numeric.quantise(x / 7, 7).alias("fine"))


_NAMES = ["zebra", "Zebra", "élan", "elan", "Elan", "ábaco", "abaco", "Äpfel", "apfel", "côte", "cote", "Cote"]


@register("sorted_names", f"""WITH n AS (SELECT DISTINCT l_suppkey AS id, {_NAMES}[CAST((l_partkey + l_orderkey) % 12 + 1 AS INTEGER)] AS v FROM lineitem)
SELECT id, string_agg(v, ',' ORDER BY lower(strip_accents(v)), lower(v), translate(v, 'EZÄC', '1111') = v DESC) AS names FROM n GROUP BY id""")
def sorted_names(spark, sf_dir):
    pick = F.element_at(F.array(*map(F.lit, _NAMES)), ((F.col("l_partkey") + F.col("l_orderkey")) % 12 + 1).cast("int"))
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.collect_set(pick).alias("names"))
    return found.select("id", F.array_join(text.sorted_distinct(F.col("names")), ",").alias("names"))


@register("time_stamps", "SELECT event_id, '1970-01-01T00:00:00.000Z' AS canonical, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS made, strftime(ts + INTERVAL 30 SECOND, '%Y-%m-%dT%H:%M:%S.%gZ') AS due FROM events")
def time_stamps(spark, sf_dir):
    ts = F.col("ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", F.lit(text.CANONICAL_TIME).alias("canonical"), text.iso_time(ts).alias("made"), text.iso_time(text.next_attempt(ts)).alias("due"))
