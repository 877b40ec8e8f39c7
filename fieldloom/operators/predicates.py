"""Text and layout predicates of form blocks: prompts, cues, headers, suppression, roles, value shapes.

Every rule list is a table of (name, pattern) or (name, weight, condition): all of it stays in generated code, one row at a time,
or is one aggregate over a page. A null text is empty; patterns see normalised text (a-z, 0-9, single spaces) unless stated.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import text
from fieldloom.functions.numeric import clamp01
from fieldloom.operators.joins import first_rule

# What a prompt asks for, by its normalised text. All patterns of a name must fit.
PROMPTS: dict[str, list[str]] = {
    "name": ["name|applicant|insured|agent|producer"],
    "address": ["address|mailing|street"],
    "city_state_zip": ["city", "state", "zip|postal"],
    "address_part": [r"\b(city|state|zip|postal|address|street)\b"],
    "city": [r"^(city)\s*$"],
    "state": [r"^(state|st|state province)\s*$"],
    "zip": [r"^(zip|zip code|postal|postal code)\s*$"],
    "policy_number": [r"\bpolicy\b", r"\b(number|no)\b"],
    "mailing_address": [r"\bmailing\s+address\b"],
    "agent_name": [r"\b(agent|producer)\b", r"\bname\b"],
    "named_insured": [r"\b(first\s+named\s+insured|named\s+insured|insured\s+name)\b"],
    "business_start": [r"\b(date\s+business\s+started|business\s+start\s+date|date\s+business)\b"],
    "identity": [
        r"\b(named\s+insured|insured\s+name|name\s+of\s+insured|applicant\s+name|name\s+of\s+applicant|producer|agent|agency"
        r"|mailing\s+address|location\s+address|street\s+address|business\s+address|address\s+line|city|state|postal|zip)\b"
    ],
    "operations": [
        r"\b(operations\s+description|description\s+of\s+operations|nature\s+of\s+operations|business\s+description"
        r"|nature\s+of\s+business|premises\s+operations|operations\s+in\s+detail)\b"
    ],
}
ANCHORS = ["named_insured", "mailing_address", "policy_number", "business_start", "city", "state", "zip", "agent_name"]
FIELD_CUE = (
    r"name|address|city|state|zip|phone|email|date|policy|insured|applicant|dob|birth|effective|expiration|expiry|agent|producer|id|code"
    r"|operations|premises|subcontractor|description|eff\b|exp\b"
)
FORM_TITLE = "acord|application|supplement|declaration|certificate|insurance|commercial|workers|compensation|liability"
FORM_FIELD = "name|address|city|state|zip|postal|phone|email|dob|birth|applicant|insured"
TITLE_WORD = "acord|application|supplement|declaration|certificate|coverage|liability|insurance|policyholder|commercial"
TITLE_FIELD = "name|address|city|state|zip|phone|email|date|policy|insured|applicant"
INSTRUCTION_START = "^(if yes|if no|please explain|describe|list |include )"
INSTRUCTION = "submitted with|supplemental application|application|operations in detail|have you had|claims during|type of work"
ORGANISATION, TELEPHONE = "insurance company|agency|services|inc|llc|corporation|fax|phone|www|com", r"\d{3}[\s\-\)]*\d{3}[\s\-]\d{4}"
HEADER = r"acord|commercial insurance application|supplemental application|applicant information section|edition|copyright|all rights reserved|form no|\bpage\s+\d+\s+of\s+\d+\b"
TABULAR = (
    r"\byes\b.*\bno\b|\bno\b.*\byes\b|type of work performed|receipts|location|start date|end date|number of|full time employees"
    "|part time employees|day laborers|kind of license|license no|year license issued|date of corporate filing"
)
#: Structure rules: reason, weight, kinds, most words (0: any), pattern of the normalised text, pattern of the trimmed text.
STRUCTURE: list[tuple[str, float, list[str], int, str, str | None]] = [
    ("page_number_or_pagination", 0.45, ["footer"], 0, r"^(page\s+)?\d+\s*(of\s*\d+)?$", None),
    ("form_or_section_header", 0.22, ["header", "section"], 6, "application|form|schedule|supplement|declaration|endorsement|policy|coverage", None),
    ("party_header_or_stub", 0.28, ["header"], 0, "insured|producer|agent|applicant|carrier|company|broker|underwriter", r"[:\-]$"),
    ("branding_or_legal_footer", 0.4, ["logo", "footer"], 0, "logo|copyright|all rights reserved|confidential|proprietary", None),
    ("instructional_copy", 0.24, ["instruction"], 0, "instructions?|please note|complete this section|if yes|if no|explain|describe|list", None),
    ("section_label", 0.2, ["section"], 8, "section|part|schedule|item|table of contents|summary", None),
    ("contact_or_header_metadata", 0.16, ["metadata"], 10, "phone|fax|email|http|address|street|city|state|zip", None),
    ("all_caps_banner", 0.18, ["header"], 0, "", r"^[A-Z0-9\s&.,/-]{8,}$"),
]
FAMILY_MARK = ("family_specific_section_marker", 0.18, "section", "operations|work performed|business description|premises operations")
STRUCTURE_MATCH, HEADER_MATCH, TOP_BAND = 0.3, 0.62, 120.0
#: Line roles: what text and place say, first match first.
QUESTION, INSURER = r"(?i)\?$|^(do you|have you|are you|were there|if yes|describe|explain)\b", r"(?i)\b(insurer|insurance\s+(company|group|corporation|services))\b"
FILLABLE = (
    r"(?i)[:?]\s*$|\b(name|agency|producer|carrier|underwriter|applicant|insured|address|city|state|zip|postal|e-?mail|phone|fax|website"
    r"|contact|representative|code|number|date|year|years|fein|soc sec|payroll|percentage|rate|amount|premium|deductible|limit|employees"
    r"|sales|receipts|revenue)\b"
)
NOTE = r"(?i)^(note|please|instructions?|important)\b"
RISK_CATEGORIES = [
    ("loss-history", "loss|claim|incident|prior"),
    ("operations", "operation|work|class|naics|trade"),
    ("hazard", "hazard|flammable|height|roof|electrical|chemical"),
    ("exposure", "exposure|sales|payroll|receipts|units|revenue"),
    ("applicant", "applicant|insured|entity|experience|years"),
]
OUTCOMES = [(0.8, "decline"), (0.6, "refer-to-underwriter"), (0.4, "accept-with-conditions")]
SHAPES = {"date": r"(\d{4}-\d{2}-\d{2})|(\d{1,2}/\d{1,2}/\d{2,4})", "boolean": "(?i)^(true|false|yes|no|0|1)$", "number": r"^-?\d+(\.\d+)?$"}
EXPECTED = [("date", "date|time"), ("number", "amount|premium|count|number|limit"), ("boolean", "indicator|^is|flag$")]


def _words(n: Column) -> Column:
    return F.size(F.filter(F.split(n, " "), lambda w: w != ""))


def prompt(n: Column, name: str) -> Column:
    """Whether a normalised text asks for ``name``."""
    found = F.lit(True)
    for pattern in PROMPTS[name]:
        found = found & n.rlike(pattern)
    return found


def prompt_flags(value: Column) -> Column:
    """The sorted names of all prompts that a text is, and ``anchor`` for those that anchor a form."""
    n = text.normalise(value)
    flags = [F.when(prompt(n, name), name) for name in PROMPTS]
    anchor = F.when(F.greatest(*[prompt(n, name).cast("int") for name in ANCHORS]) == 1, "anchor")
    return F.array_sort(F.array_compact(F.array(*flags, anchor)))


def field_cue(value: Column, n: Column | None = None) -> Column:
    n = text.normalise(value) if n is None else n
    return (n != "") & (F.trim(value).endswith(":") | n.rlike(FIELD_CUE))


def with_structure(df: DataFrame, value: str, family: str, name: str = "structure") -> DataFrame:
    """Adds ``name``: score, matched, reasons and kinds (sorted) of the structure rules; an empty text matches with 0.2.

    The normalised text, and which rules fit, are columns of projections of their own, so each pattern runs once a row.
    """
    names = df.columns
    df = df.withColumns({"_n": text.normalise(F.coalesce(F.col(value), F.lit(""))), "_plain": F.trim(F.coalesce(F.col(value), F.lit(""))), "_of": text.normalise(F.col(family))})
    df = df.withColumn("_words", _words(F.col("_n")))
    n, plain, words = F.col("_n"), F.col("_plain"), F.col("_words")
    rules = [(reason, weight, kind, n.rlike(a) & (plain.rlike(b) if b else F.lit(True)) & ((words <= most) if most else F.lit(True))) for reason, weight, kind, most, a, b in STRUCTURE]
    reason, weight, kind, pattern = FAMILY_MARK
    rules.insert(-1, (reason, weight, [kind], F.col("_of").contains("contractor") & n.rlike(pattern)))
    df = df.withColumn("_fits", F.array(*[fits for *_, fits in rules]))
    fits = [F.col("_fits")[k] for k in range(len(rules))]
    score = F.lit(0.0)
    for (_, weight, _, _), fit in zip(rules, fits):
        score = score + F.when(fit, weight).otherwise(0.0)
    df = df.withColumn("_score", score)
    empty, score = n == "", F.col("_score")
    kinds = F.concat(*[F.when(fit, F.array(*map(F.lit, kind))).otherwise(F.array().cast("array<string>")) for (_, _, kind, _), fit in zip(rules, fits)])
    signals = F.struct(
        F.when(empty, 0.2).otherwise(F.round(F.least(F.lit(1.0), score), 3)).alias("score"),
        (empty | (score >= STRUCTURE_MATCH)).alias("matched"),
        F.when(empty, F.array(F.lit("empty_text"))).otherwise(F.array_compact(F.array(*[F.when(fit, reason) for (reason, *_), fit in zip(rules, fits)]))).alias("reasons"),
        F.when(empty, F.array(F.lit("empty"))).otherwise(F.array_sort(F.array_distinct(kinds))).alias("kinds"),
    )
    return df.withColumn(name, signals).select(*names, name)


def not_mappable(value: Column, n: Column, words: Column, cue: Column, structure: Column) -> Column:
    """Titles, tables, instructions and long prose without a field cue."""
    bare = ~cue
    title = (words >= 4) & n.rlike(FORM_TITLE) & ~n.rlike(FORM_FIELD)
    prose = (words >= 4) & n.rlike(TITLE_WORD) & ~n.rlike(TITLE_FIELD)
    instruction = F.trim(value).endswith("?") | n.rlike(INSTRUCTION_START) | n.rlike(INSTRUCTION)
    logo = n.rlike(ORGANISATION) | value.rlike(TELEPHONE)
    return (
        (n == "") | title | (bare & (words >= 5) & logo) | (bare & (words >= 6) & n.rlike(TABULAR))
        | (bare & (words >= 8) & (prose | instruction)) | (bare & (words >= 16)) | (bare & structure["matched"])
    )


#: Reasons and weights of the header rules, in order. The structure rules that fit give their own reasons and score in their place.
HEADER_RULES = [
    ("top_of_page", 0.32), ("acord_header_tokens", 0.42), ("logo_or_contact_noise", 0.24), ("no_nearby_field_cue", 0.24), ("title_geometry_proxy", 0.18), ("non_field_pattern", 0.22),
    ("structure", None), ("phase3_field_cue_rebalance", -0.2), ("wave13_1_anchor_prompt_override", -0.34),
]


def header_assessment(df: DataFrame, value: str, box: str, near_cue: str, family: str) -> DataFrame:
    """Adds ``header_score``, ``header`` and ``header_reasons`` from text, place, and whether a neighbour row has a field cue."""
    names = df.columns
    df = with_structure(df, value, family, "_s").withColumn("_n", text.normalise(F.col(value)))
    v, n, s, b = F.col(value), F.col("_n"), F.col("_s"), F.col(box)
    df = df.withColumns({"_words": _words(n), "_cue": field_cue(v, n), "_head": n.rlike(HEADER), "_anchor": prompt(n, "policy_number") | prompt(n, "named_insured") | prompt(n, "mailing_address")})
    words, cue, head, anchor, top = F.col("_words"), F.col("_cue"), F.col("_head"), F.col("_anchor"), b["y"] < TOP_BAND
    fits = [
        top, head, (n.rlike(ORGANISATION) | v.rlike(TELEPHONE)) & (words >= 3), ~cue & ~F.col(near_cue), ((b["height"] >= 20) | ((b["width"] >= 360) & (words >= 4))) & top,
        not_mappable(v, n, words, cue, s), s["matched"], cue & ~top & s["matched"], anchor,
    ]
    df = df.withColumn("_fits", F.array(*fits))
    score, reasons = F.lit(0.0), []
    for k, (reason, weight) in enumerate(HEADER_RULES):
        fit = F.col("_fits")[k]
        score = score + F.when(fit, s["score"] if weight is None else F.lit(weight)).otherwise(0.0)
        reasons.append(F.when(fit, s["reasons"] if weight is None else F.array(F.lit(reason))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_score", score)
    header = ~anchor & ((F.col("_score") >= HEADER_MATCH) | (top & head) | (F.array_contains(s["kinds"], "logo") & (s["score"] >= 0.35)))
    return df.select(*names, F.round(clamp01(F.col("_score")), 3).alias("header_score"), header.alias("header"), F.concat(*reasons).alias("header_reasons"))


def valid_rules(rules: Sequence[tuple[str, float, str]]) -> list[tuple[str, float, str]]:
    """(pattern, weight, reason) rules without those whose pattern cannot be compiled; a missing weight is 0.4."""
    kept = []
    for pattern, weight, reason in rules:
        try:
            re.compile(pattern)
        except re.error:
            continue
        kept.append((pattern, weight if weight else 0.4, reason or f"pattern:{pattern}"))
    return kept


def learned_suppression(value: Column, y: Column, rules: Sequence[tuple[str, float, str]], top: float | None, limit: float = 0.55) -> Column:
    """suppress and reasons: weights of fitting patterns and of the top band, from ``limit`` on."""
    n = text.normalise(value)
    fits = [("top_band", 0.3, y <= top)] if top else []
    fits += [(reason, weight, n.rlike(f"(?i){pattern}")) for pattern, weight, reason in valid_rules(rules)]
    score = F.lit(0.0)
    for _, weight, fit in fits:
        score = score + F.when(fit, weight).otherwise(0.0)
    return F.struct((F.round(score, 9) >= limit).alias("suppress"), F.array_compact(F.array(*[F.when(fit, reason) for reason, _, fit in fits])).alias("reasons"))


def page_skips(blocks: DataFrame, keys: Sequence[str], value: str, box: str, width: float, height: float) -> DataFrame:
    """keys, text_reason, geometry_reason: why a page has too little to work on, or null. One aggregate a page."""
    n = text.normalise(F.col(value))
    words = F.size(F.filter(F.split(n, " "), lambda w: F.length(w) >= 2))
    middle = F.col(f"{box}.y") + F.col(f"{box}.height") / 2
    area = F.greatest(F.lit(0.0), F.col(f"{box}.width")) * F.greatest(F.lit(0.0), F.col(f"{box}.height"))
    found = blocks.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(words).alias("words"),
        F.count_if(field_cue(F.col(value))).alias("cues"),
        (F.sum(area) / max(1.0, width * height)).alias("coverage"),
        F.count_if((middle >= height * 0.2) & (middle <= height * 0.85)).alias("middle"),
    )
    few = F.col("words")
    text_reason = (
        F.when(few < 14, "low-token-page")
        .when((F.col("cues") == 0) & (few < 40), "no-field-cues")
        .when((F.col("cues") <= 1) & (F.col("n") <= 3) & (few / F.col("n") < 8), "sparse-field-cues")
    )
    geometry = F.when((F.col("coverage") < 0.012) & (F.col("middle") == 0), "geometry-header-footer-only").when((F.col("n") <= 3) & (F.col("coverage") < 0.008), "geometry-sparse-coverage")
    return found.select(*keys, text_reason.alias("text_reason"), geometry.alias("geometry_reason"))


def label_detection(value: Column) -> Column:
    """is_label, cues and rejected: a trailing colon or a field word, unless it is an instruction or a question."""
    n, plain = text.normalise(value), F.trim(value)
    cues = F.array_compact(F.array(F.when(plain.endswith(":"), "trailing-colon"), F.when(n.rlike("name|address|city|state|zip|policy|insured|applicant|date|email|phone"), "field-cue-token")))
    told = n.rlike("^(if yes|if no|describe|list |please explain)") | plain.endswith("?")
    return F.struct((~told & (F.size(cues) > 0)).alias("is_label"), cues.alias("cues"), F.when(told, "instruction-or-question").when(F.size(cues) == 0, "no-label-cues").alias("rejected"))


def line_role(value: Column, box: Column, height: float) -> Column:
    """footer, question, header, label, title or description, by text and place on a page of ``height``."""
    letters = F.regexp_replace(value, "[^A-Za-z]", "")
    capital = (F.length(letters) >= 4) & (letters == F.upper(letters))
    fillable = (F.trim(value) != "") & (F.length(F.trim(value)) <= 90) & F.trim(value).rlike(FILLABLE)
    title = ~value.rlike(r"_{3,}|\.{5,}|-{4,}") & (F.length(value) > 0) & (F.length(value) <= 90) & (capital | (box["height"] >= height * 0.022))
    return (
        F.when(box["y"] + box["height"] >= height * 0.92, "footer")
        .when(value.rlike(QUESTION), "question")
        .when(value.rlike(INSURER) & ~value.rlike(r"[:?]\s*$"), "header")
        .when(fillable, "label")
        .when(box["y"] <= height * 0.08, "header")
        .when(title, "title")
        .when((F.length(value) >= 120) | value.rlike(NOTE), "description")
        .otherwise("label")
    )


def risk_category(value: Column) -> Column:
    return first_rule(text.normalise(value), RISK_CATEGORIES, "supplemental")


def outcome(score: Column) -> Column:
    found = F
    for limit, name in OUTCOMES:
        found = found.when(score >= limit, name)
    return found.otherwise("accept")


def residual_class(fields: Column, total: Column, backend: Column, designer: Column, layout: Column) -> Column:
    """Class of a form's remaining errors by what they are most of; limits grow with fields and errors."""
    least = lambda floor, share, of: F.greatest(F.lit(floor), F.floor(of * share + 0.5))
    return (
        F.when((layout > 0) & (layout >= least(60, 0.12, fields)), "layout-driven edge case")
        .when((designer > backend) & (designer >= least(80, 0.18, total)), "designer residual")
        .when((backend > designer) & (backend >= least(90, 0.18, total)), "backend residual")
        .when(total <= 75, "corpus anomaly")
        .otherwise("backend residual")
    )


def expected_type(code: Column) -> Column:
    """The value type that a code's name calls for."""
    return first_rule(code, EXPECTED, "string")


def fits_shape(value: Column, shape: Column) -> Column:
    """Whether a value has the shape of its type; empty values and strings always do."""
    value = F.coalesce(F.trim(value), F.lit(""))
    found = F.when(value == "", True)
    for name, pattern in SHAPES.items():
        found = found.when(shape == name, value.rlike(pattern))
    return found.otherwise(True)


def envelope_fault(body: Column, status: Column) -> Column:
    """The first fault of a JSON response envelope (ok, data, error) with its HTTP status; null for a sound one."""
    parsed = F.from_json(body, "ok boolean, data string, error string")
    return (
        F.when(body.isNull() | (F.trim(body) == ""), "empty-body")
        .when(parsed.isNull() | ~F.trim(body).startswith("{"), "not-an-object")
        .when(parsed["ok"].isNull(), "missing-ok")
        .when(parsed["ok"] & (status >= 400), "ok-with-error-status")
        .when(~parsed["ok"] & (status < 400), "error-with-success-status")
        .when(parsed["ok"] & parsed["data"].isNull(), "missing-data")
        .when(~parsed["ok"] & parsed["error"].isNull(), "missing-error")
    )


def token_precision(query: Column, label: Column) -> Column:
    """0.7 to 1.2: shares of query and label tokens (arrays) that meet each other."""
    met = F.size(F.filter(query, lambda q: F.exists(label, lambda t: t.contains(q) | q.contains(t))))
    score = met / F.size(query) * 0.65 + met / F.size(label) * 0.35
    return F.when((F.size(query) == 0) | (F.size(label) == 0), 1.0).otherwise(0.7 + F.least(F.lit(0.5), score * 0.5))


def label_penalty(value: Column, label: Column) -> Column:
    """Product of factors for labels that a prompt does not ask for, or asks for in these words."""
    q, t = text.normalise(value), text.normalise(label)
    words, tokens = text.tokens(value), text.tokens(label)
    short = (F.size(words) > 0) & (F.size(words) <= 4)
    missed = F.size(F.filter(tokens, lambda x: ~F.exists(words, lambda w: x.contains(w) | w.contains(x))))
    one = lambda fits, factor: F.when(fits, factor).otherwise(1.0)
    place = prompt(q, "city_state_zip")
    return (
        one(short & q.rlike(FORM_FIELD) & t.rlike("acordform|certificate|statement|filing|remark|liability|workers|compensation"), 0.4)
        * F.when(short & (missed >= 6), 0.55).when(short & (missed >= 4), 0.75).otherwise(1.0)
        * one(prompt(q, "name") & t.rlike("indicator|explanation|same as|merged|changed"), 0.25)
        * one(prompt(q, "name") & t.rlike("full name|given name|surname|last name|first name"), 1.4)
        * one(prompt(q, "address") & t.rlike("line one|line two|street|mailing"), 1.25)
        * F.when(place & t.rlike("city|state|province|postal|zip|address"), 1.3).when(place, 0.18).otherwise(1.0)
        * one(t.rlike("capacity|watercraft|trailer|vehicle"), 0.45)
    )


#: Synonyms of form words, folded to one.
ALIASES = [(r"\b(agent|agency|broker)\b", "producer"), (r"\b(applicant|policyholder)\b", "insured"), (r"\b(zip code|zip|postal code)\b", "postal"), (r"\b(e mail)\b", "email"), (r"\b(telephone|tel)\b", "phone")]


def folded(value: Column) -> Column:
    """Normalised text after splitting camel case and digit commas, with synonyms folded to one word."""
    n = text.normalise(text.split_camel(text.strip_digit_commas(F.coalesce(value, F.lit("")))))
    for pattern, word in ALIASES:
        n = F.regexp_replace(n, pattern, word)
    return n


def display_label(value: Column) -> Column:
    """A label as people read it: single spaces, no trailing punctuation or leader dots."""
    plain = F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\.{3,}|_{2,}", " "), r"[\s:;,.\-]+$", ""))


def semantic_label(value: Column, role: Column) -> Column:
    """A short text for what a line is: its display label, with the role where it is no label."""
    shown = display_label(value)
    return F.when(shown == "", F.concat(F.lit("Unlabelled "), role)).when(role == "label", F.initcap(F.lower(shown))).otherwise(F.concat(F.initcap(role), F.lit(": "), shown))
