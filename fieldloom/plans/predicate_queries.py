"""Registered predicates of form blocks, with their SQL; the SQL's fixed values are those of `stated`."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import text
from fieldloom.operators import predicates as P
from fieldloom.operators import rows
from fieldloom.plans import stated as V
from fieldloom.plans.tables import CANDIDATES, PROMPT_BLOCKS, PROMPT_TEXTS, sql_list, candidates, normalised_sql, prompt_blocks, table
from fieldloom.registry import register

_B = f"{PROMPT_BLOCKS}, nb AS (SELECT *, {normalised_sql('text')} AS n, trim(text) AS t FROM pb)"


def rx(x: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_matches({x}, '{quoted}')"


def flags(names: list[tuple[str, str]]) -> str:
    """A list of the names whose condition holds."""
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in names) + "], lambda v: v IS NOT NULL)"


def _prompt(name: str) -> str:
    return "(" + " AND ".join(rx("n", p) for p in V.PROMPTS[name]) + ")"


WORDS = "len(list_filter(string_split(n, ' '), lambda v: v <> ''))"
CUE = f"(n <> '' AND (ends_with(t, ':') OR {rx('n', V.FIELD_CUE)}))"


@register("prompt_predicates", f"WITH {_B} SELECT page, block, array_to_string(list_sort({flags([(k, _prompt(k)) for k in V.PROMPTS] + [('anchor', '(' + ' OR '.join(map(_prompt, V.ANCHORS)) + ')')])}), ',') AS prompts, {CUE} AS cue FROM nb")
def prompt_predicates(spark, sf_dir):
    found = {"prompts": F.array_join(P.prompt_flags(F.col("text")), ","), "cue": P.field_cue(F.col("text"))}
    return rows.each_value(prompt_blocks(spark, sf_dir).select("page", "block", "text"), "text", found).drop("text")


def _structure_rules() -> list[tuple[str, float, list[str], str]]:
    found = [(r, w, k, f"{rx('n', a)}" + (f" AND {rx('t', b)}" if b else "") + (f" AND {WORDS} <= {m}" if m else "")) for r, w, k, m, a, b in V.STRUCTURE]
    r, w, k, p = V.FAMILY_MARK
    found.insert(-1, (r, w, [k], f"contains(lower(family), 'contractor') AND {rx('n', p)}"))
    return found


_SCORE = " + ".join(f"(CASE WHEN {c} THEN {w}::DOUBLE ELSE 0 END)" for _, w, _, c in _structure_rules())
_KIND_LISTS = [f"(CASE WHEN {c} THEN [{', '.join(repr(x) for x in k)}] ELSE []::VARCHAR[] END)" for _, _, k, c in _structure_rules()]
_STRUCTURE = f"""sc AS (SELECT *, CAST(0 AS DOUBLE) + {_SCORE} AS raw FROM nb), st AS (SELECT *,
  CASE WHEN n = '' THEN 0.2 ELSE round(least(1.0, raw), 3) END AS s_score, (n = '' OR raw >= {V.STRUCTURE_MATCH}) AS s_matched,
  CASE WHEN n = '' THEN ['empty_text'] ELSE {flags([(r, c) for r, _, _, c in _structure_rules()])} END AS s_reasons,
  CASE WHEN n = '' THEN ['empty'] ELSE list_sort(list_distinct(flatten([{', '.join(_KIND_LISTS)}]))) END AS s_kinds FROM sc)"""


@register("structure_suppression", f"WITH {_B}, {_STRUCTURE} SELECT page, block, s_score AS score, s_matched AS matched, array_to_string(s_reasons, ',') AS reasons, array_to_string(s_kinds, ',') AS kinds FROM st")
def structure_suppression(spark, sf_dir):
    found = P.with_structure(prompt_blocks(spark, sf_dir), "text", "family", "s")
    return found.select("page", "block", "s.score", "s.matched", F.array_join("s.reasons", ",").alias("reasons"), F.array_join("s.kinds", ",").alias("kinds"))


_LOGO = f"({rx('n', V.ORGANISATION)} OR {rx('text', V.TELEPHONE)})"
_NOT_MAPPABLE = f"""(n = '' OR ({WORDS} >= 4 AND {rx('n', V.FORM_TITLE)} AND NOT {rx('n', V.FORM_FIELD)}) OR (NOT {CUE} AND {WORDS} >= 5 AND {_LOGO})
  OR (NOT {CUE} AND {WORDS} >= 6 AND {rx('n', V.TABULAR)}) OR (NOT {CUE} AND {WORDS} >= 8 AND (({WORDS} >= 4 AND {rx('n', V.TITLE_WORD)} AND NOT {rx('n', V.TITLE_FIELD)})
  OR ends_with(t, '?') OR {rx('n', V.INSTRUCTION_START)} OR {rx('n', V.INSTRUCTION)})) OR (NOT {CUE} AND {WORDS} >= 16) OR (NOT {CUE} AND s_matched))"""
_ANCHOR = f"({_prompt('policy_number')} OR {_prompt('named_insured')} OR {_prompt('mailing_address')})"
_HEADER = [
    ("top_of_page", "0.32::DOUBLE", f"y < {V.TOP_BAND}"), ("acord_header_tokens", "0.42::DOUBLE", rx("n", V.HEADER)), ("logo_or_contact_noise", "0.24::DOUBLE", f"{_LOGO} AND {WORDS} >= 3"),
    ("no_nearby_field_cue", "0.24::DOUBLE", f"NOT {CUE} AND NOT near"), ("title_geometry_proxy", "0.18::DOUBLE", f"(h >= 20 OR (w >= 360 AND {WORDS} >= 4)) AND y < {V.TOP_BAND}"),
    ("non_field_pattern", "0.22::DOUBLE", _NOT_MAPPABLE), ("structure", "s_score", "s_matched"), ("phase3_field_cue_rebalance", "-0.2::DOUBLE", f"{CUE} AND NOT y < {V.TOP_BAND} AND s_matched"), ("wave13_1_anchor_prompt_override", "-0.34::DOUBLE", _ANCHOR),
]
_NEAR = f"""nr AS (SELECT a.page, a.block, bool_or(b.block IS NOT NULL) AS near FROM
  (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x, block) AS rn FROM nb) a LEFT JOIN
  (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x, block) AS rn FROM nb) b
  ON a.page = b.page AND abs(a.rn - b.rn) BETWEEN 1 AND 3 AND abs(a.y - b.y) <= 82 AND {CUE.replace('n <>', 'b.n <>').replace('ends_with(t', 'ends_with(b.t').replace('(n,', '(b.n,')} GROUP BY ALL)"""


@register("header_assessment", f"""WITH {_B}, {_NEAR}, {_STRUCTURE}, hd AS (SELECT *, {' + '.join(f'(CASE WHEN {c} THEN {w} ELSE 0 END)' for _, w, c in _HEADER)} AS hs FROM st JOIN nr USING (page, block))
SELECT page, block, round(greatest(0, least(1, hs)), 3) AS header_score, NOT {_ANCHOR} AND (hs >= {V.HEADER_MATCH} OR (y < {V.TOP_BAND} AND {rx('n', V.HEADER)}) OR (list_contains(s_kinds, 'logo') AND s_score >= 0.35)) AS header,
 array_to_string(flatten([{', '.join(f"CASE WHEN {c} THEN {'s_reasons' if n == 'structure' else repr([n])} ELSE []::VARCHAR[] END" for n, _, c in _HEADER)}]), ',') AS reasons FROM hd""")
def header_assessment(spark, sf_dir):
    b = prompt_blocks(spark, sf_dir).withColumns({"y": F.col("box.y"), "x": F.col("box.x"), "cue": P.field_cue(F.col("text"))})
    near = rows.neighbour_probe(b, ["page"], ["y", "x", "block"], "y", "cue", 3, 82, "near")
    return P.header_assessment(near, "text", "box", "near", "family").select("page", "block", "header_score", "header", F.array_join("header_reasons", ",").alias("reasons"))


LEARNED = [("copyright|reserved", 0.6, "legal"), ("^page", 0.3, ""), ("broken(", 0.9, "broken"), ("section", 0.0, "section")]


@register("learned_suppression", f"""WITH {_B}, q AS (SELECT *, (CASE WHEN y <= 60 THEN 0.3 ELSE 0 END) + (CASE WHEN {rx('n', 'copyright|reserved')} THEN 0.6 ELSE 0 END) + (CASE WHEN {rx('n', '^page')} THEN 0.3 ELSE 0 END) + (CASE WHEN {rx('n', 'section')} THEN 0.4 ELSE 0 END) AS s FROM nb)
SELECT page, block, round(s, 9) >= 0.55 AS suppress, array_to_string({flags([('top_band', 'y <= 60'), ('legal', rx('n', 'copyright|reserved')), ('pattern:^page', rx('n', '^page')), ('section', rx('n', 'section'))])}, ',') AS reasons FROM q""")
def learned_suppression(spark, sf_dir):
    found = prompt_blocks(spark, sf_dir).withColumn("s", P.learned_suppression(F.col("text"), F.col("box.y"), LEARNED, 60.0))
    return found.select("page", "block", "s.suppress", F.array_join("s.reasons", ",").alias("reasons"))


@register("page_skips", f"""WITH {_B}, p AS (SELECT page, count(*) AS n, sum(len(list_filter(string_split(n, ' '), lambda v: length(v) >= 2))) AS words, count(*) FILTER ({CUE}) AS cues,
 sum(greatest(0, w) * greatest(0, h)) / 1000000.0 AS coverage, count(*) FILTER (y + h / 2 >= 200 AND y + h / 2 <= 850) AS middle FROM nb GROUP BY page)
SELECT page, CASE WHEN words < 14 THEN 'low-token-page' WHEN cues = 0 AND words < 40 THEN 'no-field-cues' WHEN cues <= 1 AND n <= 3 AND words / n < 8 THEN 'sparse-field-cues' END AS text_reason,
 CASE WHEN coverage < 0.012 AND middle = 0 THEN 'geometry-header-footer-only' WHEN n <= 3 AND coverage < 0.008 THEN 'geometry-sparse-coverage' END AS geometry_reason FROM p""")
def page_skips(spark, sf_dir):
    return P.page_skips(prompt_blocks(spark, sf_dir), ["page"], "text", "box", 1000.0, 1000.0)


_TOLD = f"({rx('n', '^(if yes|if no|describe|list |please explain)')} OR ends_with(t, '?'))"
_LABEL = flags([("trailing-colon", "ends_with(t, ':')"), ("field-cue-token", rx("n", "name|address|city|state|zip|policy|insured|applicant|date|email|phone"))])


@register("label_detection", f"WITH {_B}, q AS (SELECT *, {_LABEL} AS c FROM nb) SELECT page, block, NOT {_TOLD} AND len(c) > 0 AS is_label, array_to_string(c, ',') AS cues, CASE WHEN {_TOLD} THEN 'instruction-or-question' WHEN len(c) = 0 THEN 'no-label-cues' END AS rejected FROM q")
def label_detection(spark, sf_dir):
    found = prompt_blocks(spark, sf_dir).withColumn("d", P.label_detection(F.col("text")))
    return found.select("page", "block", "d.is_label", F.array_join("d.cues", ",").alias("cues"), "d.rejected")


@register("line_roles", f"""WITH {_B} SELECT page, block, CASE WHEN y + h >= 920 THEN 'footer' WHEN {rx('text', V.QUESTION)} THEN 'question' WHEN {rx('text', V.INSURER)} AND NOT {rx('text', '[:?]\\s*$')} THEN 'header'
 WHEN t <> '' AND length(t) <= 90 AND {rx('t', V.FILLABLE)} THEN 'label' WHEN y <= 80 THEN 'header'
 WHEN NOT {rx('text', '_{3,}|\\.{5,}|-{4,}')} AND length(text) BETWEEN 1 AND 90 AND ((length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 4 AND regexp_replace(text, '[^A-Za-z]', '', 'g') = upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))) OR h >= 22) THEN 'title'
 WHEN length(text) >= 120 OR {rx('text', V.NOTE)} THEN 'description' ELSE 'label' END AS role FROM nb""")
def line_roles(spark, sf_dir):
    return prompt_blocks(spark, sf_dir).select("page", "block", P.line_role(F.col("text"), F.col("box"), 1000.0).alias("role"))


_RISK = "CASE " + " ".join(f"WHEN {rx('n', p)} THEN '{c}'" for c, p in V.RISK_CATEGORIES) + " ELSE 'supplemental' END"


@register("risk_outcomes", f"""WITH {_B}, q AS (SELECT page, block, {_RISK} AS category, greatest(0, least(1, round(1 - least(1, greatest(0, conf)) + (CASE WHEN {rx('n', 'hazard|loss|injury|fire|chemical|decline')} THEN 0.15 ELSE 0 END), 6))) AS severity FROM nb)
SELECT page, block, category, severity, CASE WHEN severity >= 0.8 THEN 'decline' WHEN severity >= 0.6 THEN 'refer-to-underwriter' WHEN severity >= 0.4 THEN 'accept-with-conditions' ELSE 'accept' END AS outcome FROM q""")
def risk_outcomes(spark, sf_dir):
    n = text.normalise(F.col("text"))
    severity = P.clamp01(F.round(1 - P.clamp01(F.col("conf")) + F.when(n.rlike("hazard|loss|injury|fire|chemical|decline"), 0.15).otherwise(0.0), 6))
    found = prompt_blocks(spark, sf_dir).withColumns({"category": P.risk_category(F.col("text")), "severity": severity})
    return found.select("page", "block", "category", "severity", P.outcome(F.col("severity")).alias("outcome"))


@register("residual_classes", """WITH q AS (SELECT l_suppkey AS form, count(*) AS fields, count(*) FILTER (l_returnflag = 'A') AS backend, count(*) FILTER (l_returnflag = 'R') AS designer,
 count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'N' AND l_quantity > 40) AS layout FROM lineitem GROUP BY 1), r AS (SELECT *, backend + designer + layout AS total FROM q)
SELECT form, total, CASE WHEN layout > 0 AND layout >= greatest(60, floor(fields * 0.12 + 0.5)) THEN 'layout-driven edge case' WHEN designer > backend AND designer >= greatest(80, floor(total * 0.18 + 0.5)) THEN 'designer residual'
 WHEN backend > designer AND backend >= greatest(90, floor(total * 0.18 + 0.5)) THEN 'backend residual' WHEN total <= 75 THEN 'corpus anomaly' ELSE 'backend residual' END AS residual FROM r""")
def residual_classes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    counts = li.groupBy(F.col("l_suppkey").alias("form")).agg(
        F.count("*").alias("fields"), F.count_if(flag == "A").alias("backend"), F.count_if(flag == "R").alias("designer"),
        F.count_if((F.col("l_linestatus") == "F") & (flag == "N") & (F.col("l_quantity") > 40)).alias("layout"),
    ).withColumn("total", F.col("backend") + F.col("designer") + F.col("layout"))
    return counts.select("form", "total", P.residual_class(*[F.col(c) for c in ("fields", "total", "backend", "designer", "layout")]).alias("residual"))


_CODES = ["EffectiveDate", "PremiumAmount", "PriorIndicator", "FullName"]
_VALUES = ["2020-01-31", "1/2/99", "yes", "-12.50", "abc", "", "0"]


@register("value_shapes", f"""WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_CODES}[CAST(l_partkey % 4 + 1 AS INTEGER)] AS code, {_VALUES}[CAST(l_suppkey % 7 + 1 AS INTEGER)] AS value FROM lineitem),
 k AS (SELECT *, CASE WHEN {rx('lower(code)', 'date|time')} THEN 'date' WHEN {rx('lower(code)', 'amount|premium|count|number|limit')} THEN 'number' WHEN {rx('lower(code)', 'indicator|^is|flag$')} THEN 'boolean' ELSE 'string' END AS expected FROM q)
SELECT expected, value, count(*) AS n, bool_and(CASE WHEN value = '' OR expected = 'string' THEN true WHEN expected = 'date' THEN {rx('value', V.SHAPES['date'])} WHEN expected = 'boolean' THEN {rx('value', V.SHAPES['boolean'])} ELSE {rx('value', V.SHAPES['number'])} END) AS fits FROM k GROUP BY ALL""")
def value_shapes(spark, sf_dir):
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (F.col(at) % len(values) + 1).cast("int"))
    found = table(spark, sf_dir, "lineitem").select(pick(_CODES, "l_partkey").alias("code"), pick(_VALUES, "l_suppkey").alias("value")).withColumn("expected", P.expected_type(F.col("code")))
    return found.groupBy("expected", "value").agg(F.count("*").alias("n"), F.bool_and(P.fits_shape(F.col("value"), F.col("expected"))).alias("fits"))


_BODIES = ['{"ok":true,"data":"x"}', '{"ok":false,"error":"bad"}', '{"ok":true}', '{"ok":false}', '{"data":"x"}', "[1]", "", "not json"]


@register("envelope_faults", """WITH q AS (SELECT p_partkey, p_partkey % 8 AS k, CASE WHEN p_partkey % 3 = 0 THEN 500 ELSE 200 END AS status FROM part)
SELECT p_partkey, CASE WHEN k = 6 THEN 'empty-body' WHEN k IN (5, 7) THEN 'not-an-object' WHEN k = 4 THEN 'missing-ok' WHEN k IN (0, 2) AND status >= 400 THEN 'ok-with-error-status' WHEN k IN (1, 3) AND status < 400 THEN 'error-with-success-status'
 WHEN k = 2 THEN 'missing-data' WHEN k = 3 THEN 'missing-error' END AS fault FROM q""")
def envelope_faults(spark, sf_dir):
    body = F.element_at(F.array(*map(F.lit, _BODIES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    status = F.when(F.col("p_partkey") % 3 == 0, 500).otherwise(200)
    return table(spark, sf_dir, "part").select("p_partkey", P.envelope_fault(body, status).alias("fault"))


@register("role_gate", f"""WITH {CANDIDATES}, c AS (SELECT *, CASE CAST(substr(code, 2) AS INTEGER) % 3 WHEN 0 THEN 'Producer_' || code WHEN 1 THEN 'NamedInsured_' || code ELSE code END AS full_code, doc % 3 AS role, doc % 7 = 0 AS address FROM cand),
 m AS (SELECT *, max(CASE WHEN starts_with(full_code, CASE role WHEN 0 THEN 'Producer_' ELSE 'NamedInsured_' END) THEN sim END) OVER (PARTITION BY doc) AS best FROM c)
SELECT doc, ordinal, full_code AS code FROM m WHERE role = 2 OR best IS NULL OR CASE WHEN address THEN starts_with(full_code, CASE role WHEN 0 THEN 'Producer_' ELSE 'NamedInsured_' END)
 ELSE NOT starts_with(full_code, CASE role WHEN 0 THEN 'NamedInsured_' ELSE 'Producer_' END) OR sim > best + 0.08 END""")
def role_gate(spark, sf_dir):
    number = F.substring("code", 2, 9).cast("int") % 3
    c = candidates(spark, sf_dir).withColumn("code", F.when(number == 0, F.concat(F.lit("Producer_"), "code")).when(number == 1, F.concat(F.lit("NamedInsured_"), "code")).otherwise(F.col("code")))
    role = F.when(F.col("doc") % 3 == 0, "producer").when(F.col("doc") % 3 == 1, "insured")
    return rows.role_gate(c, ["doc"], "code", "sim", role, F.col("doc") % 7 == 0, {"producer": "Producer_", "insured": "NamedInsured_"}).select("doc", "ordinal", "code")


@register("family_coverage", f"WITH {_B} SELECT page, block, text FROM nb WHERE NOT (family IN ('form 125', 'form 140') AND {rx('n', 'liability')} AND NOT {rx('n', 'section')})")
def family_coverage(spark, sf_dir):
    return rows.denied(prompt_blocks(spark, sf_dir), text.normalise(F.col("text")).rlike("liability"), F.col("family").isin("form 125", "form 140"), text.normalise(F.col("text")).rlike("section")).select("page", "block", "text")


@register("allowed_codes", f"""WITH {CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY conf DESC, ordinal) AS rn, max(conf) OVER (PARTITION BY doc) AS top FROM cand),
 ok AS (SELECT DISTINCT doc, code FROM r WHERE rn <= 2)
SELECT r.doc, r.ordinal, r.code, top < 0.42 AS relaxed FROM r LEFT JOIN ok USING (doc, code) WHERE ok.code IS NOT NULL OR family = 'R' OR top < 0.42""")
def allowed_codes(spark, sf_dir):
    c = candidates(spark, sf_dir)
    return rows.allowed_codes(c, ["doc"], "code", "conf", "ordinal", F.col("family") == "R", k=2).select("doc", "ordinal", "code", "relaxed")


_FACTOR_TEXTS = sql_list(PROMPT_TEXTS)
_MEET = "contains(y, x) OR contains(x, y)"
_FACTORS = [
    (f"short AND {rx('n', V.FORM_FIELD)} AND {rx('m', 'acordform|certificate|statement|filing|remark|liability|workers|compensation')}", 0.4), (f"{_prompt('name')} AND {rx('m', 'indicator|explanation|same as|merged|changed')}", 0.25),
    (f"{_prompt('name')} AND {rx('m', 'full name|given name|surname|last name|first name')}", 1.4), (f"{_prompt('address')} AND {rx('m', 'line one|line two|street|mailing')}", 1.25), (rx("m", "capacity|watercraft|trailer|vehicle"), 0.45),
]


@register("label_factors", f"""WITH {_B}, l AS (SELECT *, {_FACTOR_TEXTS}[CAST(block // 100 % {len(PROMPT_TEXTS)} + 1 AS INTEGER)] AS label FROM nb), k AS (SELECT page, block, n, {normalised_sql('label')} AS m FROM l),
 q AS (SELECT *, list_filter(string_split(n, ' '), lambda v: length(v) >= 3) AS a, list_filter(string_split(m, ' '), lambda v: length(v) >= 3) AS b FROM k),
 r AS (SELECT *, len(a) BETWEEN 1 AND 4 AS short, len(list_filter(a, lambda x: len(list_filter(b, lambda y: {_MEET})) > 0)) AS met, len(list_filter(b, lambda x: len(list_filter(a, lambda y: {_MEET})) = 0)) AS missed FROM q)
SELECT page, block, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 1.0 ELSE 0.7 + least(0.5, (met / len(a) * 0.65 + met / len(b) * 0.35) * 0.5) END, 6) AS boost,
 round({' * '.join(f'(CASE WHEN {c} THEN {w} ELSE 1 END)::DOUBLE' for c, w in _FACTORS)} * (CASE WHEN short AND missed >= 6 THEN 0.55 WHEN short AND missed >= 4 THEN 0.75 ELSE 1 END)
  * (CASE WHEN {_prompt('city_state_zip')} AND {rx('m', 'city|state|province|postal|zip|address')} THEN 1.3 WHEN {_prompt('city_state_zip')} THEN 0.18 ELSE 1 END), 6) AS penalty FROM r""")
def label_factors(spark, sf_dir):
    label = F.element_at(F.array(*map(F.lit, PROMPT_TEXTS)), (F.floor(F.col("block") / 100) % len(PROMPT_TEXTS) + 1).cast("int"))
    b = prompt_blocks(spark, sf_dir).withColumn("label", label)
    boost = P.token_precision(text.tokens(F.col("text")), text.tokens(F.col("label")))
    return b.select("page", "block", F.round(boost, 6).alias("boost"), F.round(P.label_penalty(F.col("text"), F.col("label")), 6).alias("penalty"))


_PLAIN = "regexp_replace(regexp_replace(coalesce(text, ''), '(\\d),(\\d)', '\\1\\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
_FOLD = normalised_sql(_PLAIN)
for _p, _w in V.ALIASES:
    _FOLD = f"regexp_replace({_FOLD}, '{_p}', '{_w}', 'g')"
_SHOWN = "trim(regexp_replace(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '\\.{3,}|_{2,}', ' ', 'g'), '[\\s:;,.\\-]+$', ''))"


@register("folded_labels", f"WITH {PROMPT_BLOCKS} SELECT page, block, {_FOLD} AS folded, {_SHOWN} AS shown FROM pb")
def folded_labels(spark, sf_dir):
    return prompt_blocks(spark, sf_dir).select("page", "block", P.folded(F.col("text")).alias("folded"), P.display_label(F.col("text")).alias("shown"))


@register("text_details", f"""WITH {PROMPT_BLOCKS} SELECT page, block, regexp_replace(text, '(\\d),(\\d)', '\\1\\2', 'g') AS digits, CASE WHEN text LIKE '%?' THEN text END AS question,
 replace(replace(replace(text || ' &lt;&amp;', '&apos;', ''''), '&lt;', '<'), '&amp;', '&') AS plain FROM pb""")
def text_details(spark, sf_dir):
    quoted = F.concat(F.lit('ask "'), F.col("text"), F.lit('" or "so"'))
    b = prompt_blocks(spark, sf_dir)
    return b.select("page", "block", text.strip_digit_commas(F.col("text")).alias("digits"), text.quoted_question(quoted).alias("question"), text.unescape_xml(F.concat("text", F.lit(" &lt;&amp;"))).alias("plain"))
