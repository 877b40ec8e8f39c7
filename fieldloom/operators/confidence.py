"""Confidence of candidates: signals, weights, the chain of floors and caps, thresholds, and orders that follow from them.

Rules are tables of (step, value, condition); a condition is a SQL predicate over named signal columns. Each step mentions the
score once (a floor is ``greatest``, a cap ``least``, with a neutral value where the condition fails), so that a chain of any length
stays one flat expression in generated code. Unless stated, signals lie in [0, 1].
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions import text
from fieldloom.functions.numeric import clamp01
from fieldloom.operators import predicates

# The chain that turns a first confidence into the final one, in order.
FIRST_FLOORS = [
    ("floor", "0.62", "low_category AND relative >= 0.64"),
    ("floor", "0.74", "rescue AND relative >= 0.66"),
    ("floor", "0.76", "geometry_first AND relative >= 0.62"),
    ("floor", "0.78", "carrier_first AND carrier >= 0.62"),
    ("floor", "0.79", "general_first AND NOT overridden AND general >= 0.58"),
]
CHAIN = [
    *FIRST_FLOORS,
    ("scale", "0.58", "true"),
    ("add", "normal * 0.42", "true"),
    ("scale", "(0.68 + margin * 0.32)", "true"),
    ("cap", "0.62", "source = 'heuristic' AND semantic < 0.72 AND dictionary < 0.45"),
    ("cap", "0.64", "anchor < 0.2 AND semantic < 0.72"),
    ("cap", "0.56", "anchor < 0.1 AND semantic < 0.55"),
    ("cap", "0.57", "(is_name OR is_address) AND anchor < 0.34 AND semantic < 0.74"),
    ("scale", "1.06", "(is_name OR is_address) AND anchor >= 0.65 AND relative > 0.9"),
    ("floor", "0.64", "layout >= 0.72 AND relative >= 0.88 AND (semantic >= 0.45 OR anchor >= 0.2)"),
    ("floor", "0.82", "layout >= 0.82 AND relative >= 0.92 AND (semantic >= 0.72 OR anchor >= 0.24)"),
    ("cap", "0.72", "is_address AND semantic < 0.78 AND dictionary >= 0.55"),
    ("cap", "0.7", "is_address AND NOT is_place AND kind = 'line1'"),
    ("cap", "0.62", "is_address AND NOT is_place AND kind = 'line2'"),
    ("cap", "0.54", "is_address AND NOT is_place AND kind = 'city'"),
    ("cap", "0.5", "is_address AND NOT is_place AND kind IN ('state', 'postal')"),
    ("floor", "0.78", "is_city AND kind = 'city'"),
    ("cap", "0.44", "is_city AND kind <> 'city'"),
    ("floor", "0.78", "is_state AND kind = 'state'"),
    ("cap", "0.44", "is_state AND kind <> 'state'"),
    ("floor", "0.79", "is_zip AND kind = 'postal'"),
    ("cap", "0.44", "is_zip AND kind <> 'postal'"),
    ("floor", "0.84", "ask_policy AND own_policy"),
    ("cap", "0.42", "ask_policy AND other_policy"),
    ("floor", "0.78", "ask_agent AND producer_code"),
    ("cap", "0.54", "ask_agent AND insured_code"),
    ("floor", "0.84", "ask_insured AND insured_name"),
    ("cap", "0.4", "ask_insured AND (insured_other OR insured_initial)"),
    ("floor", "0.84", "ask_mailing AND own_mailing"),
    ("cap", "0.46", "ask_mailing AND mailing_part"),
    ("floor", "0.77", "ask_start AND start_code"),
    *FIRST_FLOORS,
    ("floor", "0.78", "overridden AND forced = 'accepted'"),
    ("floor", "0.62", "overridden AND forced = 'review'"),
]
#: Scores from the first value on rise to the second one (in two steps, the second sees what the first made).
RESCUES = [
    (0.44, 0.56, "cue AND NOT anchor_prompt AND NOT header AND NOT non_field AND anchor >= 0.5 AND dictionary >= 0.28"),
    (0.4, 0.605, "cue AND NOT anchor_prompt AND NOT header AND NOT non_field AND anchor >= 0.44 AND dictionary >= 0.22 AND (semantic >= 0.12 OR heuristic >= 0.32)"),
]
#: After the score is rounded: the supervision's boost, then the last caps and floors.
HINT_BOOSTS = {"supervision": 0.08, "semantic_hint": 0.06, "category_hint": 0.05, "dictionary_hint": 0.05}
LAST_STEPS = [
    ("cap", "0.48", "ask_mailing AND NOT is_place AND mailing_part"),
    ("floor", "0.84", "ask_mailing AND NOT is_place AND own_mailing"),
    ("cap", "0.42", "ask_insured AND insured_other"),
    ("floor", "0.84", "ask_insured AND insured_name"),
]
#: Prompts that a text is asked for, and what a candidate's normalised code and label say. Normalised text has no underscore, so patterns with one never fit.
ASKS = {"ask_policy": "policy_number", "ask_agent": "agent_name", "ask_insured": "named_insured", "ask_mailing": "mailing_address", "ask_start": "business_start"}
CODE_MARKS = {
    "own_policy": r"\bpolicy\s+policynumberidentifier\b",
    "other_policy": r"\botherpolicy\s+policynumberidentifier\b",
    "producer_code": r"\bproducer_(fullname|contactperson_fullname)\b",
    "insured_code": r"\bnamedinsured_\b",
    "insured_name": r"\b(generalinfo\s+namedinsured|namedinsured\s+fullname)\b",
    "insured_other": r"\bnamedinsured\s+legalentity\s+otherdescription\b",
    "insured_initial": r"\bothergivennameinitial\b",
    "own_mailing": r"\bgeneralinfo\s+mailingaddress(\s+line1)?\b",
    "mailing_part": r"\b(contactmailingaddress|mailingaddress)\s+(postalcode|stateorprovincecode|cityname)\b",
    "start_code": r"\bbusiness(startdate|information_businessstartdate)\b",
}
FUSION = {"category": 0.38, "heuristic": 0.12, "geometry": 0.2, "prior": 0.15, "semantic": 0.1, "dictionary": 0.03, "anchor": 0.02}
SIGNAL_WEIGHTS = {"layout": 1.2, "embedding": 0.5, "lexical": 0.25, "dictionary": 0.2, "heuristic": 0.05}
FAMILY_FACTORS = {"form 125": 1.0, "form 140": 1.02, "contractors supplement": 0.95}
#: Threshold moves: (accepted, review, rejected) by condition.
THRESHOLD_MOVES = [
    ("-0.04", "-0.04", "-0.02", "true"),
    ("-0.03", "-0.035", "0", "has_category AND layout >= 0.72"),
    ("0", "0.005", "0", "NOT has_category OR layout < 0.35"),
    ("-0.02", "-0.015", "0", "low_category"),
    ("-0.03", "-0.03", "-0.015", "heuristic >= 0.74"),
    ("-0.025", "-0.025", "0", "geometry_first"),
    ("0", "-0.025", "0", "geometry >= 0.68"),
    ("0", "-0.02", "0", "prior >= 0.7"),
    ("0", "-0.025 * carrier", "0.015 * carrier", "carrier > 0"),
    ("-0.03", "-0.025", "0", "carrier > 0 AND (carrier >= 0.7 OR carrier_first)"),
    ("-0.03 * 0.5", "-0.025 * 0.7", "0.015", "carrier_first AND carrier >= 0.62"),
    ("0", "-0.025 * general", "0.015 * general", "general > 0"),
    ("-0.03", "-0.025", "0", "general > 0 AND general >= 0.65"),
]
#: Score moves of the rerank.
RERANK_MOVES = [
    ("0.055", "concept"),
    ("0.115 + 0.07", "consistent"),
    ("0.045", "seen"),
    ("0.045", "in_category"),
    ("geometry * 0.06", "true"),
    ("-0.03", "NOT overridden AND NOT in_category"),
    ("-0.06", "NOT overridden AND violations > 0"),
    ("-0.04", "NOT overridden AND geometry < 0.32"),
    ("0.22", "overridden"),
    ("0.1", "overridden AND forced = 'accepted'"),
    ("0.06", "overridden AND forced = 'review'"),
    ("carrier", "carrier > 0"),
    ("general", "NOT overridden"),
]
#: What each step does with the score, and the value that leaves it alone.
STEPS = {"floor": ("greatest({s}, {v})", "0.0"), "cap": ("least({s}, {v})", "1.0"), "scale": ("({s} * {v})", "1.0"), "add": ("({s} + {v})", "0.0")}


def chain_expression(score: str, steps: Sequence[tuple[str, str, str]] = tuple(CHAIN)) -> str:
    """The chain as one SQL expression over ``score`` and the signal columns."""
    for kind, value, condition in steps:
        shape, neutral = STEPS[kind]
        part = value if condition == "true" else f"(CASE WHEN {condition} THEN {value} ELSE {neutral} END)"
        score = shape.format(s=score, v=f"CAST({part} AS DOUBLE)")
    return score


def moved(start: str, moves: Sequence[tuple[str, str]]) -> str:
    """``start`` with the moves whose condition holds added, in order."""
    for value, condition in moves:
        start += f" + CAST(CASE WHEN {condition} THEN {value} ELSE 0 END AS DOUBLE)"
    return start


def normal_weights(names: Sequence[str], layout_present: bool = True, no_heuristic: bool = False) -> dict[str, float]:
    """Signal weights with a total of one; a model's evidence leaves the heuristic a fifth of its weight."""
    held = dict(SIGNAL_WEIGHTS)
    held["heuristic"] *= 0.0 if no_heuristic else 0.2 if layout_present else 1.0
    total = max(1e-6, sum(held[n] for n in names))
    return {n: held[n] / total for n in names}


def family_signal(value: Column, family: Column, digits: int = 6) -> Column:
    """A signal drawn towards (or away from) one half by its family's factor."""
    factor = F.lit(1.0)
    for name, by in FAMILY_FACTORS.items():
        factor = F.when(family == name, by).otherwise(factor)
    return F.round(clamp01(0.5 + (clamp01(value) - 0.5) * factor), digits)


def first_confidence(df: DataFrame, digits: int = 6) -> DataFrame:
    """Adds ``normal`` (blend of family signals) and ``first`` (evidence, rank, block and fused signals) to signal rows."""
    w = normal_weights(["layout", "embedding", "lexical", "dictionary", "heuristic"])
    v = normal_weights(["embedding", "lexical", "dictionary", "heuristic"])
    family = lambda name: family_signal(F.col(name) if name != "embedding" else F.greatest("semantic", "layout"), F.col("family"), digits)
    normal = sum((family({"lexical": "anchor"}.get(n, n)) * v[n] for n in v), F.lit(0.0))
    evidence = sum((F.col({"embedding": "semantic", "lexical": "anchor"}.get(n, n)) * w[n] for n in w), F.lit(0.0))
    fused = sum((F.col(n) * weight for n, weight in FUSION.items()), F.lit(0.0))
    df = df.withColumn("normal", F.round(clamp01(normal), digits))
    base = clamp01(clamp01(evidence) * 0.52 + F.col("relative") * 0.2 + clamp01(F.col("block_conf")) * 0.1 + clamp01(F.col("heuristic") * 0.5 + F.col("normal") * 0.5) * 0.18)
    return df.withColumn("first", clamp01(base * 0.38 + clamp01(fused) * 0.62))


def anchor_signals(df: DataFrame, value: str, code: str, label: str) -> DataFrame:
    """Adds the prompts of ``ASKS``, ``anchor_prompt`` and the marks of ``CODE_MARKS`` from a block's text and a candidate's code and label."""
    names = df.columns
    df = df.withColumns({"_n": text.normalise(F.col(value)), "_code": text.normalise(F.concat_ws(" ", code, label))})
    n = F.col("_n")
    anchor = F.greatest(*[predicates.prompt(n, name).cast("int") for name in predicates.ANCHORS]) == 1
    df = df.withColumns({**{k: predicates.prompt(n, v) for k, v in ASKS.items()}, "anchor_prompt": anchor, **{k: F.col("_code").rlike(p) for k, p in CODE_MARKS.items()}})
    return df.select(*names, *ASKS, "anchor_prompt", *CODE_MARKS)


def composite(df: DataFrame, digits: int = 3) -> DataFrame:
    """Adds ``confidence`` and ``ranked_confidence`` (7 percent less for a missing parent, unless overridden) to rows with all signals.

    Columns beside the signals: those of ``anchor_signals``, ``non_field`` and the hints of ``HINT_BOOSTS``. Each stage is a projection of its own.
    """
    names = df.columns
    df = first_confidence(df, max(6, digits)).withColumn("_c", F.expr(chain_expression("first")))
    for least, to, condition in RESCUES:
        df = df.withColumn("_c", F.when(F.expr(condition) & (F.col("_c") >= least), F.greatest(F.col("_c"), F.lit(to))).otherwise(F.col("_c")))
    df = df.withColumn("_c", F.round(clamp01(F.col("_c")), digits))
    hints = clamp01_once(sum((F.col(name) * weight for name, weight in HINT_BOOSTS.items()), F.lit(0.0)))
    df = df.withColumn("_c", F.when(F.col("supervision") > 0, clamp01_once(F.col("_c") + hints)).otherwise(F.col("_c")))
    df = df.withColumn("confidence", F.round(F.expr(chain_expression("_c", LAST_STEPS)), digits))
    penalty = F.when((F.col("violations") > 0) & ~F.col("overridden"), 1 - 0.07).otherwise(1.0)
    return df.select(*names, "normal", "first", "confidence", F.round(F.col("confidence") * penalty, digits).alias("ranked_confidence"))


def dynamic_thresholds(df: DataFrame, codes: DataFrame, categories: DataFrame, default: tuple[float, float, float], digits: int = 3) -> DataFrame:
    """Adds accepted, review, rejected and ``lineage``: the code's own thresholds, else its category's, else the default, then moved.

    ``codes``: code, accepted, review, rejected; ``categories``: category, accepted, review. Both are small and Spark may broadcast them.
    """
    by_code = codes.select("code", *[F.col(c).alias(f"code_{c}") for c in ("accepted", "review", "rejected")])
    by_category = categories.select("category", *[F.col(c).alias(f"cat_{c}") for c in ("accepted", "review")])
    met = df.join(by_code, "code", "left").join(by_category, "category", "left")
    found = {}
    for name, k, less in (("accepted", 0, "0.015"), ("review", 1, "0.01"), ("rejected", 2, "0")):
        own = f"coalesce(cat_{name} - {less}, code_{name}, {default[k]})" if name != "rejected" else f"coalesce(code_rejected, {default[k]})"
        found[f"_{name}"] = F.expr(moved(f"CAST({own} AS DOUBLE)", [(m[k], m[3]) for m in THRESHOLD_MOVES]))
    met = met.withColumns(found)
    met = met.withColumn("accepted", F.round(F.greatest(F.lit(0.25), F.least(F.lit(0.97), F.col("_accepted"))), digits))
    met = met.withColumn("review", F.round(F.greatest(F.lit(0.18), F.least(F.col("accepted") - 0.01, F.col("_review"))), digits))
    met = met.withColumn("rejected", F.round(F.greatest(F.lit(0.05), F.least(F.col("review") - 0.01, F.col("_rejected"))), digits))
    lineage = F.when(F.col("cat_accepted").isNotNull(), "category").when(F.col("code_accepted").isNotNull(), "code").otherwise("global")
    return met.withColumn("lineage", lineage).drop(*found, *[c for c in met.columns if c.startswith(("code_", "cat_"))])


def candidate_order() -> list[Column]:
    """The order of candidates: confidence, similarity, lexical, dictionary, heuristic, then code in Unicode's collation order."""
    return [*[F.col(c).desc() for c in ("confidence", "semantic", "anchor", "dictionary", "heuristic")], F.collate(F.col("code"), text.COLLATION), F.col("code")]


def reranked(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``rerank_score`` and ``rank``: the moves' sum decides, the usual order breaks ties; confidences stay."""
    scored = df.withColumn("rerank_score", F.round(F.expr(moved("confidence", RERANK_MOVES)), 9))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("rerank_score").desc(), *candidate_order())))


def fallback_pick(df: DataFrame, keys: Sequence[str], fusion: str, limit: float, least: float) -> DataFrame:
    """Adds ``rank`` and ``reason``: where no candidate's fusion score reaches ``limit``, the most confident of at least ``least`` comes first."""
    group = Window.partitionBy(*keys)
    held = df.withColumns({"_passes": F.max((F.col(fusion) >= limit).cast("int")).over(group), "_rank": F.row_number().over(group.orderBy(*candidate_order()))})
    best = F.min(F.when(F.col("confidence") >= least, F.struct(-F.col("confidence"), F.col("code"), F.col("_rank")))).over(group)
    held = held.withColumn("_best", F.when(F.col("_passes") == 0, best["_rank"]))
    front = F.when(F.col("_rank") == F.col("_best"), 0).otherwise(1)
    reason = F.when(F.col("_best").isNotNull(), "confidence_only_fallback")
    return held.withColumn("rank", F.row_number().over(group.orderBy(front, "_rank"))).withColumn("reason", reason).drop("_passes", "_rank", "_best")


def pinned(df: DataFrame, key: str, kind: str, order: Sequence[Column], kinds: Sequence[str], wanted: Column, made: DataFrame) -> DataFrame:
    """Adds ``rank``: of keys that are ``wanted``, the first row of each of ``kinds`` leads, in that order.

    A kind without a row takes its row of ``made`` (columns of ``df`` but the key).
    """
    flagged = df.withColumn("_wanted", wanted)
    have = flagged.filter("_wanted").select(key, kind).distinct()
    asked = flagged.filter("_wanted").select(key).distinct().withColumn(kind, F.explode(F.array(*map(F.lit, kinds))))
    missing = asked.join(have, [key, kind], "left_anti").join(made, kind).withColumn("_wanted", F.lit(True))
    rows = flagged.withColumn("_made", F.lit(False)).unionByName(missing.select(*flagged.columns, F.lit(True).alias("_made")))
    first = F.row_number().over(Window.partitionBy(key, kind).orderBy(*order)) == 1
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col(kind))
    rows = rows.withColumn("_pin", F.when(F.col("_wanted") & first & (place > 0), place).otherwise(len(kinds) + 1))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_pin", *order))
    return rows.withColumn("rank", rank).drop("_pin", "_wanted").withColumnRenamed("_made", "made")


def geometry_score(anchor: Column, other: Column, weights: tuple[float, float, float] = (0.42, 0.38, 0.2)) -> Column:
    """1 for equal boxes (0..1 coordinates): weighted nearness in x, in y, and in area."""
    across, down, _ = (w / sum(weights) for w in weights)
    size = lambda b: b["width"] * b["height"]
    most = F.greatest(size(anchor), size(other), F.lit(1e-6))
    near = [1 - clamp01(F.abs(anchor[p] - other[p])) for p in ("x", "y")]
    return clamp01(near[0] * across + near[1] * down + (1 - clamp01(F.abs(size(anchor) - size(other)) / most)) * (1 - across - down))


def pattern_boost(score: Column, box: Column, patterns: Sequence[tuple[str, str, str, float, float]]) -> Column:
    """score and ids of (id, axis, operator, threshold, weight) patterns that fit a box's centre or area: 0.08 of the weight each."""
    at = {"x": box["x"] + box["width"] / 2, "y": box["y"] + box["height"] / 2, "area": box["width"] * box["height"]}
    test = {"lt": lambda v, t: v < t, "lte": lambda v, t: v <= t, "gt": lambda v, t: v > t, "gte": lambda v, t: v >= t, "eq": lambda v, t: F.abs(v - t) < 1e-6}
    score, ids = clamp01(score), []
    for name, axis, operator, threshold, weight in patterns:
        fits = test[operator](at[axis], threshold)
        score = clamp01_once(score + F.when(fits, weight * 0.08).otherwise(0.0))
        ids.append(F.when(fits, name))
    return F.struct(score.alias("score"), F.array_sort(F.array_compact(F.array(*ids))).alias("ids"))


def clamp01_once(x: Column) -> Column:
    """Into [0, 1] of a number that is no null and finite; mentions it once."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def geometry_agreement(box: Column, cue: Column, is_address: Column, is_place: Column, kind: Column) -> Column:
    """How well a box suits a field: wide, not at the top, with a field word, and of the address part that is asked for."""
    ratio, part = box["width"] / F.greatest(F.lit(1.0), box["height"]), kind.isin("city", "state", "postal")
    one = lambda fits, by: F.when(fits, by).otherwise(0.0)
    address = F.when(is_address, F.when(kind.isin("line1", "line2"), 0.2).when(part, 0.1).otherwise(-0.08)).otherwise(0.0)
    place = F.when(is_place, F.when(part, 0.15).otherwise(-0.05)).otherwise(0.0)
    return clamp01_once(0.45 + one(ratio > 6, 0.2) + one(ratio < 1.2, -0.15) + one(box["y"] < 40, -0.1) + one(cue, 0.1) + address + place)
