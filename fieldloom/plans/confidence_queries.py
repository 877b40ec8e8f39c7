"""Registered confidence, threshold and order operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import text
from fieldloom.operators import confidence as C
from fieldloom.operators import predicates as P
from fieldloom.plans.tables import FAMILIES, PROMPT_TEXTS, normalised_sql, sql_list, table
from fieldloom.registry import register

def q6(name: str, of: str | None = None) -> str:
    """A score to six digits for both engines, away from ties."""
    return f"floor({of or name} * 1000000 + 0.5001) / 1000000 AS {name}"


KINDS = ["line1", "line2", "city", "state", "postal", "other"]
FORCED = ["accepted", "review"]
#: Signals as SQL over line items, the same text for both engines; the document's candidates are its lines.
_PICKS = {
    "doc": "l_orderkey", "ordinal": "((CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT)",
    "number": "CAST(l_partkey % 40 AS INTEGER)", "layout": "round(l_discount * 10, 6)", "semantic": "round(l_tax * 12.5, 6)", "dictionary": "round(l_quantity / 50.0, 6)",
    "heuristic": "round((l_partkey % 101) / 100.0, 6)", "anchor": "round((l_suppkey % 11) / 10.0, 6)", "geometry": "round((l_partkey % 17) / 16.0, 6)", "prior": "round((l_suppkey % 9) / 8.0, 6)",
    "carrier": "round((l_partkey % 5) / 5.0, 6)", "general": "round((l_suppkey % 4) / 4.0, 6)", "violations": "CAST(l_partkey % 3 AS INTEGER)", "block_conf": "round((l_orderkey % 10) / 9.0, 6)",
    "carrier_first": "l_partkey % 7 = 0", "general_first": "l_suppkey % 7 = 0", "overridden": "l_orderkey % 11 = 0", "header": "l_orderkey % 5 = 0", "concept": "l_partkey % 2 = 0",
    "consistent": "l_partkey % 13 = 0", "seen": "l_suppkey % 3 = 0", "in_category": "l_partkey % 4 < 2", "text_at": "CAST(l_orderkey % {n} + 1 AS INTEGER)", "kind_at": "CAST(l_partkey % 6 + 1 AS INTEGER)",
    "non_field": "l_orderkey % 19 = 0", "supervision": "round(CASE WHEN l_partkey % 3 = 1 THEN (l_suppkey % 6) / 5.0 ELSE 0.0 END, 6)", "semantic_hint": "round((l_partkey % 4) / 3.0, 6)",
    "category_hint": "round((l_suppkey % 3) / 2.0, 6)", "dictionary_hint": "round((l_partkey % 2) / 1.0, 6)", "label_at": "CAST((l_partkey + l_suppkey) % 12 + 1 AS INTEGER)",
    "family_at": "CAST(l_suppkey % 3 + 1 AS INTEGER)", "forced_at": "CAST(l_orderkey % 2 + 1 AS INTEGER)", "source_at": "CAST(l_partkey % 2 + 1 AS INTEGER)",
}
#: Labels of candidates: each mark of a code, and some without.
LABELS = [
    "Policy_PolicyNumberIdentifier", "OtherPolicy PolicyNumberIdentifier", "Producer_FullName", "NamedInsured FullName", "GeneralInfo NamedInsured", "NamedInsured LegalEntity OtherDescription",
    "OtherGivenNameInitial", "GeneralInfo MailingAddress Line1", "ContactMailingAddress PostalCode", "MailingAddress CityName", "BusinessStartDate", "Remark Text",
]
_PICKS = {k: v.format(n=len(PROMPT_TEXTS)) for k, v in _PICKS.items()}
_PROMPTS = {"is_name": "name", "is_address": "address", "is_place": "city_state_zip", "is_city": "city", "is_state": "state", "is_zip": "zip"}
_LISTS = {"text": ("text_at", PROMPT_TEXTS), "kind": ("kind_at", KINDS), "family": ("family_at", FAMILIES), "forced": ("forced_at", FORCED), "source": ("source_at", ["heuristic", "dictionary"]), "label": ("label_at", LABELS)}
_DERIVED = {
    "category": "greatest(layout, semantic * 0.5)", "low_category": "greatest(layout, semantic * 0.5) < 0.42 AND (heuristic >= 0.42 OR semantic >= 0.48 OR anchor >= 0.28)",
    "rescue": "heuristic >= 0.74 AND greatest(layout, semantic * 0.5) < 0.55", "geometry_first": "geometry >= 0.82 AND (heuristic >= 0.55 OR anchor >= 0.3 OR semantic >= 0.55)",
    "has_category": "greatest(layout, semantic * 0.5) >= 0.5",
}


def signals(spark, sf_dir):
    """Candidates with every signal of the confidence chain."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(*[f"{v} AS {k}" for k, v in _PICKS.items()])
    rows = rows.withColumns({name: F.element_at(F.array(*map(F.lit, values)), F.col(at)) for name, (at, values) in _LISTS.items()})
    n = text.normalise(F.col("text"))
    rows = rows.withColumns({"code": F.concat(F.lit("C"), F.col("number").cast("string")), **{k: P.prompt(n, v) for k, v in _PROMPTS.items()}, "cue": P.field_cue(F.col("text")), **{k: F.expr(v) for k, v in _DERIVED.items()}})
    group = C.Window.partitionBy("doc")
    top = F.max("layout").over(group)
    ordered = group.orderBy(F.desc("layout")).rowsBetween(C.Window.unboundedPreceding, C.Window.unboundedFollowing)
    second = F.coalesce(F.nth_value("layout", 2).over(ordered), F.col("layout"))
    relative = F.when(top > 0, F.col("layout") / top).otherwise(0.0)
    margin = F.when(F.count("*").over(group) == 1, 1.0).when(top > 0, F.least(F.lit(1.0), (top - second) / top / 0.2)).otherwise(0.0)
    return C.anchor_signals(rows.withColumns({"relative": relative, "margin": margin}), "text", "code", "label")


# The SQL states the rules again, in its own words: nothing of it comes from the operators.
_PROMPT_SQL = r"""regexp_matches(n, 'name|applicant|insured|agent|producer') AS is_name, regexp_matches(n, 'address|mailing|street') AS is_address, contains(n, 'city') AND contains(n, 'state') AND regexp_matches(n, 'zip|postal') AS is_place,
 n = 'city' AS is_city, n IN ('state', 'st', 'state province') AS is_state, n IN ('zip', 'zip code', 'postal', 'postal code') AS is_zip,
 regexp_matches(n, '\bpolicy\b') AND regexp_matches(n, '\b(number|no)\b') AS ask_policy, regexp_matches(n, '\b(agent|producer)\b') AND regexp_matches(n, '\bname\b') AS ask_agent,
 regexp_matches(n, '\b(first named insured|named insured|insured name)\b') AS ask_insured, regexp_matches(n, '\bmailing address\b') AS ask_mailing, regexp_matches(n, '\b(date business started|business start date|date business)\b') AS ask_start,
 contains(m, ' policy policynumberidentifier ') AS own_policy, contains(m, ' otherpolicy policynumberidentifier ') AS other_policy, false AS producer_code, false AS insured_code,
 contains(m, ' generalinfo namedinsured ') OR contains(m, ' namedinsured fullname ') AS insured_name, contains(m, ' namedinsured legalentity otherdescription ') AS insured_other, contains(m, ' othergivennameinitial ') AS insured_initial,
 contains(m, ' generalinfo mailingaddress ') AS own_mailing, regexp_matches(m, ' (contactmailingaddress|mailingaddress) (postalcode|stateorprovincecode|cityname) ') AS mailing_part, contains(m, ' businessstartdate ') AS start_code"""
_CUE_SQL = r"(n <> '' AND (ends_with(trim(text), ':') OR regexp_matches(n, 'name|address|city|state|zip|phone|email|date|policy|insured|applicant|dob|birth|effective|expiration|expiry|agent|producer|id|code|operations|premises|subcontractor|description|eff\b|exp\b')))"
SIGNALS = f"""s0 AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _PICKS.items())} FROM lineitem), s1 AS (SELECT *, {', '.join(f'{sql_list(values)}[{at}] AS {name}' for name, (at, values) in _LISTS.items())} FROM s0),
 s2 AS (SELECT *, {normalised_sql('text')} AS n, 'C' || CAST(number AS VARCHAR) AS code, ' ' || {normalised_sql("'C' || CAST(number AS VARCHAR) || ' ' || label")} || ' ' AS m FROM s1),
 s4 AS (SELECT *, {_PROMPT_SQL}, {_CUE_SQL} AS cue, {', '.join(f'{v} AS {k}' for k, v in _DERIVED.items())},
   max(layout) OVER (PARTITION BY doc) AS top, count(*) OVER (PARTITION BY doc) AS cnt, list_reverse_sort(list(layout) OVER (PARTITION BY doc)) AS ls FROM s2),
 s3 AS (SELECT *, ask_insured OR ask_mailing OR ask_policy OR ask_start OR is_city OR is_state OR is_zip OR ask_agent AS anchor_prompt FROM s4),
 sg AS (SELECT *, CASE WHEN top > 0 THEN layout / top ELSE 0.0 END AS relative, CASE WHEN cnt = 1 THEN 1.0 WHEN top > 0 THEN least(1.0, (top - ls[2]) / top / 0.2) ELSE 0.0 END AS margin FROM s3)"""
#: Weights 1.2, 0.5, 0.25, 0.2 and 0.05 * 0.2 over their sums.
_W = {"layout": 1.2 / 2.16, "embedding": 0.5 / 2.16, "lexical": 0.25 / 2.16, "dictionary": 0.2 / 2.16, "heuristic": 0.01 / 2.16}
_V = {"embedding": 0.5 / 0.96, "lexical": 0.25 / 0.96, "dictionary": 0.2 / 0.96, "heuristic": 0.01 / 0.96}
_COLS = {"embedding": "greatest(semantic, layout)", "lexical": "anchor", "dictionary": "dictionary", "heuristic": "heuristic"}
_FACTOR = "CASE family WHEN 'form 140' THEN 1.02::DOUBLE WHEN 'contractors supplement' THEN 0.95::DOUBLE ELSE 1.0 END"
_UNIT = "greatest(0.0, least(1.0, {}))"


def _sum(parts: list[str]) -> str:
    return "(0.0::DOUBLE + " + " + ".join(parts) + ")"


_NORMAL = "round(" + _UNIT.format(_sum([f"round({_UNIT.format(f'0.5 + ({_COLS[n]} - 0.5) * ({_FACTOR})')}, 9) * {w!r}::DOUBLE" for n, w in _V.items()])) + ", 9)"
_EVIDENCE = _UNIT.format(_sum([f"{({'embedding': 'semantic', 'lexical': 'anchor'}).get(n, n)} * {w!r}::DOUBLE" for n, w in _W.items()]))
_FUSED = _UNIT.format("category * 0.38::DOUBLE + heuristic * 0.12::DOUBLE + geometry * 0.2::DOUBLE + prior * 0.15::DOUBLE + semantic * 0.1::DOUBLE + dictionary * 0.03::DOUBLE + anchor * 0.02::DOUBLE")
_EARLY = [
    "CASE WHEN low_category AND relative >= 0.64 THEN greatest(s, 0.62) ELSE s END", "CASE WHEN rescue AND relative >= 0.66 THEN greatest(s, 0.74) ELSE s END", "CASE WHEN geometry_first AND relative >= 0.62 THEN greatest(s, 0.76) ELSE s END",
    "CASE WHEN carrier_first AND carrier >= 0.62 THEN greatest(s, 0.78) ELSE s END", "CASE WHEN general_first AND NOT overridden AND general >= 0.58 THEN greatest(s, 0.79) ELSE s END",
]
_LATER = [
    "s * 0.58 + normal * 0.42", "s * (0.68 + margin * 0.32)", "CASE WHEN source = 'heuristic' AND semantic < 0.72 AND dictionary < 0.45 THEN least(s, 0.62) ELSE s END",
    "CASE WHEN anchor < 0.1 AND semantic < 0.55 THEN least(s, 0.56) WHEN anchor < 0.2 AND semantic < 0.72 THEN least(s, 0.64) ELSE s END",
    "CASE WHEN (is_name OR is_address) AND anchor < 0.34 AND semantic < 0.74 THEN least(s, 0.57) ELSE s END", "CASE WHEN (is_name OR is_address) AND anchor >= 0.65 AND relative > 0.9 THEN s * 1.06 ELSE s END",
    "CASE WHEN layout >= 0.72 AND relative >= 0.88 AND (semantic >= 0.45 OR anchor >= 0.2) THEN greatest(s, 0.64) ELSE s END", "CASE WHEN layout >= 0.82 AND relative >= 0.92 AND (semantic >= 0.72 OR anchor >= 0.24) THEN greatest(s, 0.82) ELSE s END",
    "CASE WHEN is_address AND semantic < 0.78 AND dictionary >= 0.55 THEN least(s, 0.72) ELSE s END",
    "CASE WHEN is_address AND NOT is_place THEN CASE kind WHEN 'line1' THEN least(s, 0.7) WHEN 'line2' THEN least(s, 0.62) WHEN 'city' THEN least(s, 0.54) WHEN 'state' THEN least(s, 0.5) WHEN 'postal' THEN least(s, 0.5) ELSE s END ELSE s END",
    "CASE WHEN is_city AND kind = 'city' THEN greatest(s, 0.78) WHEN is_city THEN least(s, 0.44) ELSE s END", "CASE WHEN is_state AND kind = 'state' THEN greatest(s, 0.78) WHEN is_state THEN least(s, 0.44) ELSE s END",
    "CASE WHEN is_zip AND kind = 'postal' THEN greatest(s, 0.79) WHEN is_zip THEN least(s, 0.44) ELSE s END",
    "CASE WHEN ask_policy AND own_policy THEN greatest(s, 0.84) ELSE s END", "CASE WHEN ask_policy AND other_policy THEN least(s, 0.42) ELSE s END", "CASE WHEN ask_agent AND producer_code THEN greatest(s, 0.78) ELSE s END",
    "CASE WHEN ask_agent AND insured_code THEN least(s, 0.54) ELSE s END", "CASE WHEN ask_insured AND insured_name THEN greatest(s, 0.84) ELSE s END", "CASE WHEN ask_insured AND (insured_other OR insured_initial) THEN least(s, 0.4) ELSE s END",
    "CASE WHEN ask_mailing AND own_mailing THEN greatest(s, 0.84) ELSE s END", "CASE WHEN ask_mailing AND mailing_part THEN least(s, 0.46) ELSE s END", "CASE WHEN ask_start AND start_code THEN greatest(s, 0.77) ELSE s END",
    *_EARLY, "CASE WHEN overridden AND forced = 'accepted' THEN greatest(s, 0.78) WHEN overridden THEN greatest(s, 0.62) ELSE s END",
    "CASE WHEN cue AND NOT anchor_prompt AND NOT header AND NOT non_field AND s >= 0.44 AND anchor >= 0.5 AND dictionary >= 0.28 THEN greatest(s, 0.56) ELSE s END",
    "CASE WHEN cue AND NOT anchor_prompt AND NOT header AND NOT non_field AND s >= 0.4 AND anchor >= 0.44 AND dictionary >= 0.22 AND (semantic >= 0.12 OR heuristic >= 0.32) THEN greatest(s, 0.605) ELSE s END",
    "round(greatest(0.0, least(1.0, s)), 9)",
    "CASE WHEN supervision > 0 THEN least(1.0, s + least(1.0, supervision * 0.08::DOUBLE + semantic_hint * 0.06::DOUBLE + category_hint * 0.05::DOUBLE + dictionary_hint * 0.05::DOUBLE)) ELSE s END",
    "CASE WHEN ask_mailing AND NOT is_place AND mailing_part THEN least(s, 0.48) ELSE s END", "CASE WHEN ask_mailing AND NOT is_place AND own_mailing THEN greatest(s, 0.84) ELSE s END",
    "CASE WHEN ask_insured AND insured_other THEN least(s, 0.42) ELSE s END", "CASE WHEN ask_insured AND insured_name THEN greatest(s, 0.84) ELSE s END",
]
_STAGES = ", ".join(f"k{n} AS (SELECT * REPLACE (({step})::DOUBLE AS s) FROM k{n - 1})" for n, step in enumerate([*_EARLY, *_LATER], 1))
CONFIDENCE = f"""{SIGNALS}, c1 AS (SELECT *, {_NORMAL} AS normal FROM sg), c2 AS (SELECT *, {_UNIT.format(_UNIT.format(f'{_EVIDENCE} * 0.52 + relative * 0.2 + block_conf * 0.1 + {_UNIT.format("heuristic * 0.5 + normal * 0.5")} * 0.18') + f' * 0.38 + {_FUSED} * 0.62')} AS first FROM c1),
 k0 AS (SELECT *, first::DOUBLE AS s FROM c2), {_STAGES}, cf AS (SELECT *, round(s, 9) AS confidence FROM k{len(_EARLY) + len(_LATER)})"""


@register("composite_confidence", f"WITH {CONFIDENCE} SELECT doc, ordinal, code, {q6('normal')}, {q6('confidence')}, {q6('ranked_confidence', 'round(confidence * CASE WHEN violations > 0 AND NOT overridden THEN 0.93 ELSE 1.0 END, 9)')} FROM cf")
def composite_confidence(spark, sf_dir):
    return C.composite(signals(spark, sf_dir), 9).selectExpr("doc", "ordinal", "code", q6("normal"), q6("confidence"), q6("ranked_confidence"))


def _add(*moves: str) -> str:
    return "".join(f" + CAST({m} AS DOUBLE)" for m in moves)


_MOVES = {
    "accepted": "CAST({} AS DOUBLE)" + _add("-0.04", "CASE WHEN has_category AND layout >= 0.72 THEN -0.03 ELSE 0 END", "CASE WHEN low_category THEN -0.02 ELSE 0 END", "CASE WHEN heuristic >= 0.74 THEN -0.03 ELSE 0 END",
     "CASE WHEN geometry_first THEN -0.025 ELSE 0 END", "CASE WHEN carrier > 0 AND (carrier >= 0.7 OR carrier_first) THEN -0.03 ELSE 0 END", "CASE WHEN carrier_first AND carrier >= 0.62 THEN -0.015 ELSE 0 END", "CASE WHEN general >= 0.65 THEN -0.03 ELSE 0 END"),
    "review": "CAST({} AS DOUBLE)" + _add("-0.04", "CASE WHEN has_category AND layout >= 0.72 THEN -0.035 ELSE 0 END", "CASE WHEN NOT has_category OR layout < 0.35 THEN 0.005 ELSE 0 END", "CASE WHEN low_category THEN -0.015 ELSE 0 END",
     "CASE WHEN heuristic >= 0.74 THEN -0.03 ELSE 0 END", "CASE WHEN geometry_first THEN -0.025 ELSE 0 END", "CASE WHEN geometry >= 0.68 THEN -0.025 ELSE 0 END", "CASE WHEN prior >= 0.7 THEN -0.02 ELSE 0 END", "-0.025 * carrier",
     "CASE WHEN carrier > 0 AND (carrier >= 0.7 OR carrier_first) THEN -0.025 ELSE 0 END", "CASE WHEN carrier_first AND carrier >= 0.62 THEN -0.0175 ELSE 0 END", "-0.025 * general", "CASE WHEN general >= 0.65 THEN -0.025 ELSE 0 END"),
    "rejected": "CAST({} AS DOUBLE)" + _add("-0.02", "CASE WHEN heuristic >= 0.74 THEN -0.015 ELSE 0 END", "0.015 * carrier", "CASE WHEN carrier_first AND carrier >= 0.62 THEN 0.015 ELSE 0 END", "0.015 * general"),
}
_RERANKED = "confidence" + _add(
    "CASE WHEN concept THEN 0.055 ELSE 0 END", "CASE WHEN consistent THEN 0.185 ELSE 0 END", "CASE WHEN seen THEN 0.045 ELSE 0 END", "CASE WHEN in_category THEN 0.045 ELSE 0 END", "geometry * 0.06",
    "CASE WHEN NOT overridden AND NOT in_category THEN -0.03 ELSE 0 END", "CASE WHEN NOT overridden AND violations > 0 THEN -0.06 ELSE 0 END", "CASE WHEN NOT overridden AND geometry < 0.32 THEN -0.04 ELSE 0 END",
    "CASE WHEN NOT overridden THEN 0 WHEN forced = 'accepted' THEN 0.32 ELSE 0.28 END", "CASE WHEN carrier > 0 THEN carrier ELSE 0 END", "CASE WHEN NOT overridden THEN general ELSE 0 END",
)


@register("dynamic_thresholds", f"""WITH {SIGNALS}, k AS (SELECT sg.*, CASE WHEN number % 10 = 0 THEN 0.9 END AS code_accepted, CASE WHEN number % 10 = 0 THEN 0.7 END AS code_review, CASE WHEN number % 10 = 0 THEN 0.5 END AS code_rejected,
 CASE WHEN number % 4 = 1 THEN 0.75 END AS cat_accepted, CASE WHEN number % 4 = 1 THEN 0.55 END AS cat_review FROM sg),
 m AS (SELECT *, {_MOVES['accepted'].format('coalesce(cat_accepted - 0.015, code_accepted, 0.8)')} AS a, {_MOVES['review'].format('coalesce(cat_review - 0.01, code_review, 0.6)')} AS r, {_MOVES['rejected'].format('coalesce(code_rejected, 0.45)')} AS j FROM k),
 f AS (SELECT *, round(greatest(0.25, least(0.97, a)), 9) AS accepted FROM m), g AS (SELECT *, round(greatest(0.18, least(accepted - 0.01, r)), 9) AS review FROM f)
SELECT doc, ordinal, accepted, review, round(greatest(0.05, least(review - 0.01, j)), 9) AS rejected, CASE WHEN cat_accepted IS NOT NULL THEN 'category' WHEN code_accepted IS NOT NULL THEN 'code' ELSE 'global' END AS lineage FROM g""")
def dynamic_thresholds(spark, sf_dir):
    numbers = spark.range(40).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("code"), "id")
    codes = numbers.filter("id % 10 = 0").select("code", F.lit(0.9).alias("accepted"), F.lit(0.7).alias("review"), F.lit(0.5).alias("rejected"))
    categories = spark.range(1).select(F.lit(1).alias("category"), F.lit(0.75).alias("accepted"), F.lit(0.55).alias("review"))
    # the evidence named category makes way for the category's number
    s = signals(spark, sf_dir).withColumn("category", F.col("number") % 4)
    return C.dynamic_thresholds(s, codes, categories, (0.8, 0.6, 0.45), 9).select("doc", "ordinal", "accepted", "review", "rejected", "lineage")


_ORDER = "confidence DESC, semantic DESC, anchor DESC, dictionary DESC, heuristic DESC, code"


@register("rerank", f"WITH {CONFIDENCE}, r AS (SELECT *, round({_RERANKED}, 9) AS rerank_score FROM cf) SELECT doc, rank, code, {q6('rerank_score')} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY rerank_score DESC, {_ORDER}) AS INTEGER) AS rank FROM r) WHERE rank <= 10")
def rerank(spark, sf_dir):
    return C.reranked(C.composite(signals(spark, sf_dir), 9), ["doc"]).filter("rank <= 10").selectExpr("doc", "rank", "code", q6("rerank_score"))


@register("fallback_pick", f"""WITH {CONFIDENCE}, r AS (SELECT *, bool_or(general >= 0.75) OVER (PARTITION BY doc) AS passes, row_number() OVER (PARTITION BY doc ORDER BY {_ORDER}) AS rn FROM cf),
 b AS (SELECT *, first_value(CASE WHEN confidence >= 0.5 AND NOT passes THEN rn END) OVER (PARTITION BY doc ORDER BY (confidence >= 0.5) DESC, confidence DESC, code, rn) AS best FROM r)
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN rn = best THEN 0 ELSE 1 END, rn) AS INTEGER) AS rank, code, {q6('confidence')}, CASE WHEN best IS NOT NULL THEN 'confidence_only_fallback' END AS reason FROM b""")
def fallback_pick(spark, sf_dir):
    return C.fallback_pick(C.composite(signals(spark, sf_dir), 9), ["doc"], "general", 0.75, 0.5).selectExpr("doc", "rank", "code", q6("confidence"), "reason")


@register("pinned_order", f"""WITH {SIGNALS}, q AS (SELECT doc, ordinal, kind, layout, doc % 3 = 0 AS wanted FROM sg), miss AS (SELECT d.doc, k.kind FROM (SELECT DISTINCT doc FROM q WHERE wanted) d, (VALUES ('city'), ('state'), ('postal')) k(kind) WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.doc = d.doc AND q.kind = k.kind)),
 u AS (SELECT doc, ordinal, kind, layout, wanted, false AS made FROM q UNION ALL SELECT doc, -1, kind, 0.5, true, true FROM miss), p AS (SELECT *, row_number() OVER (PARTITION BY doc, kind ORDER BY layout DESC, ordinal) = 1 AS lead FROM u),
 w AS (SELECT *, CASE WHEN wanted AND lead AND kind IN ('city', 'state', 'postal') THEN list_position(['city', 'state', 'postal'], kind) ELSE 4 END AS pin FROM p)
SELECT doc, ordinal, kind, made, CAST(row_number() OVER (PARTITION BY doc ORDER BY pin, layout DESC, ordinal) AS INTEGER) AS rank FROM w""")
def pinned_order(spark, sf_dir):
    s = signals(spark, sf_dir).select("doc", "ordinal", "kind", "layout")
    made = spark.createDataFrame([("city", -1, 0.5), ("state", -1, 0.5), ("postal", -1, 0.5)], "kind string, ordinal long, layout double")
    found = C.pinned(s, "doc", "kind", [F.col("layout").desc(), F.col("ordinal")], ["city", "state", "postal"], F.col("doc") % 3 == 0, made)
    return found.select("doc", "ordinal", "kind", "made", "rank")


PATTERNS = [("left", "x", "lt", 0.4, 1.0), ("low", "y", "gte", 0.5, 0.5), ("wide", "area", "gt", 0.02, -1.0), ("point", "x", "eq", 0.25, 2.0)]


@register("geometry_scores", """WITH b AS (SELECT l_orderkey AS page, ((CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS block, l_partkey % 600 / 1000.0::DOUBLE AS x, l_suppkey % 40 / 50.0::DOUBLE AS y, (60 + l_partkey % 40) / 1000.0::DOUBLE AS w, 0.2::DOUBLE AS h, l_partkey % 6 AS k, l_suppkey % 2 = 0 AS cue FROM lineitem),
 a AS (SELECT *, greatest(0, least(1, (1 - least(1, abs(0.1 - x))) * (0.42 / (0.42 + 0.38 + 0.2)) + (1 - least(1, abs(0.1 - y))) * (0.38 / (0.42 + 0.38 + 0.2)) + (1 - least(1, abs(0.04 - w * h) / greatest(0.04, w * h))) * (1 - 0.42 / (0.42 + 0.38 + 0.2) - 0.38 / (0.42 + 0.38 + 0.2)))) AS g FROM b),
 p1 AS (SELECT *, greatest(0, least(1, g + CASE WHEN x + w / 2 < 0.4 THEN 0.08 ELSE 0 END)) AS s1 FROM a), p2 AS (SELECT *, greatest(0, least(1, s1 + CASE WHEN y + h / 2 >= 0.5 THEN 0.04 ELSE 0 END)) AS s2 FROM p1), p3 AS (SELECT *, greatest(0, least(1, s2 - CASE WHEN w * h > 0.02 THEN 0.08 ELSE 0 END)) AS s3 FROM p2),
 p4 AS (SELECT *, greatest(0, least(1, s3 + CASE WHEN abs(x + w / 2 - 0.25) < 1e-6 THEN 0.16 ELSE 0 END)) AS s4 FROM p3)
SELECT page, block, round(g, 6) AS relative, round(s4, 6) AS boosted, round(greatest(0, least(1, 0.45 + (CASE WHEN w * 1000 / 20 > 6 THEN 0.2 ELSE 0 END) + (CASE WHEN w * 1000 / 20 < 1.2 THEN -0.15 ELSE 0 END) + (CASE WHEN y * 1000 < 40 THEN -0.1 ELSE 0 END) + (CASE WHEN cue THEN 0.1 ELSE 0 END) + (CASE WHEN NOT cue THEN CASE WHEN k < 2 THEN 0.2 WHEN k < 5 THEN 0.1 ELSE -0.08 END ELSE 0 END) + (CASE WHEN k % 2 = 0 THEN CASE WHEN k IN (2, 3, 4) THEN 0.15 ELSE -0.05 END ELSE 0 END))), 6) AS agreement FROM p4""")
def geometry_scores(spark, sf_dir):
    from fieldloom.functions.numeric import box
    from fieldloom.plans.tables import place

    li = table(spark, sf_dir, "lineitem")
    unit = box(F.col("l_partkey") % 600 / 1000.0, F.col("l_suppkey") % 40 / 50.0, (60 + F.col("l_partkey") % 40) / 1000.0, F.lit(0.2))
    pixels = box(unit["x"] * 1000, unit["y"] * 1000, unit["width"] * 1000, F.lit(20))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("l_partkey") % 6 + 1).cast("int"))
    cue = F.col("l_suppkey") % 2 == 0
    anchor = box(F.lit(0.1), F.lit(0.1), F.lit(0.2), F.lit(0.2))
    found = li.select(F.col("l_orderkey").alias("page"), place().alias("block"), C.geometry_score(anchor, unit).alias("g"), unit.alias("u"), C.geometry_agreement(pixels, cue, ~cue, F.col("l_partkey") % 2 == 0, kind).alias("agreement"))
    return found.select("page", "block", F.round("g", 6).alias("relative"), F.round(C.pattern_boost(F.col("g"), F.col("u"), PATTERNS)["score"], 6).alias("boosted"), F.round("agreement", 6).alias("agreement"))
