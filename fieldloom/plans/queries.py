"""Registered queries: one per operator family, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions import numeric, text
from fieldloom.operators import aggregates, graph, joins, ordered, rows
from fieldloom.plans.tables import BLOCKS, CANDIDATES, PART_TOKENS, PROMPT_BLOCKS, blocks, candidates, entries, normalised_sql, part_tokens, prompt_blocks, table
from fieldloom.registry import register
from fieldloom.sources import readers, sinks
from fieldloom.streaming.state import metric_windows as metric_windows_of

WORDS = ["green", "steel", "blue metallic", "brass", "tin", "a"]
_N = normalised_sql


# --- text ------------------------------------------------------------------------------------------------

@register("text_normalise", f"SELECT doc_id, md5({_N('text')}) AS digest, CAST(len(list_filter(string_split({_N('text')}, ' '), lambda t: length(t) >= 3)) AS BIGINT) AS n_tokens FROM documents")
def text_normalise(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(text.normalise(F.col("text"))).alias("digest"), F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@register("text_similarity", f"""WITH {PART_TOKENS}, s AS (SELECT p_partkey, list_distinct(name_tokens) AS a, list_distinct(type_tokens) AS b, name_tokens AS q, type_tokens AS t FROM pt)
SELECT p_partkey, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS dice,
 round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 1.0 * len(list_intersect(a, b)) / least(len(a), len(b)) END, 6) AS overlap,
 round(CASE WHEN len(q) = 0 OR len(t) = 0 THEN 0.0 ELSE 1.0 * len(list_filter(q, lambda x: len(list_filter(t, lambda y: contains(y, x) OR contains(x, y))) > 0)) / len(q) END, 6) AS anchor FROM s""")
def text_similarity(spark, sf_dir):
    a, b = F.col("name_tokens"), F.col("type_tokens")
    return part_tokens(spark, sf_dir).select("p_partkey", F.round(text.dice(a, b), 6).alias("dice"), F.round(text.overlap(a, b), 6).alias("overlap"), F.round(text.anchor_score(a, b), 6).alias("anchor"))


@register("text_hash", """SELECT p_partkey, printf('%08x', CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(regexp_extract_all(p_name, '(?s).'), lambda c: CAST(ord(c) AS BIGINT))),
 lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS BIGINT)) AS fnv FROM part""")
def text_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", numeric.fnv1a(F.col("p_name")).alias("fnv"))


@register("text_names", """SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS canonical, regexp_replace(p_type, '[^A-Za-z0-9._-]+', '-', 'g') AS key,
 coalesce(nullif(regexp_replace(p_type, '[^A-Za-z0-9_.-]|^[^A-Za-z_]+', '', 'g'), ''), 'Field') AS tag,
 replace(replace(replace(replace(replace('<' || p_name || '&', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM part""")
def text_names(spark, sf_dir):
    part, name, kind = table(spark, sf_dir, "part"), F.col("p_name"), F.col("p_type")
    return part.select("p_partkey", text.canonical_name(name).alias("canonical"), text.storage_key(kind).alias("key"), text.xml_tag(kind).alias("tag"), text.escape_xml(F.concat(F.lit("<"), name, F.lit("&"))).alias("escaped"))


@register("token_windows", f"""WITH {PART_TOKENS}, w AS (SELECT name_tokens AS t, unnest(range(1, len(name_tokens) + 1)) AS i FROM pt), g AS (SELECT t, i, unnest([2, 3, 4]) AS n FROM w)
SELECT list_aggregate(t[i:i + n - 1], 'string_agg', ' ') AS tokens, count(*) AS n FROM g WHERE i + n - 1 <= len(t) GROUP BY 1""")
def token_windows(spark, sf_dir):
    found = part_tokens(spark, sf_dir).select(F.explode(text.windows(F.col("name_tokens"))).alias("tokens"))
    return found.groupBy("tokens").agg(F.count("*").alias("n"))


# --- sources ---------------------------------------------------------------------------------------------

_ENTRIES = r"""code AS (SELECT p_partkey, regexp_replace(list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' '), '[^A-Za-z0-9]', '', 'g') || '_' || CAST(p_partkey AS VARCHAR) AS code, p_type || ';' || p_brand AS glossary, p_type, p_brand FROM part),
ent AS (SELECT code, glossary AS description, trim(regexp_replace(regexp_replace(replace(code, '_', ' '), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '\s+', ' ', 'g')) AS label, p_type, p_brand FROM code)"""


@register("dictionary_rows", f"""WITH {_ENTRIES} SELECT code, label, description,
 CASE WHEN regexp_matches(lower(label), 'date|effective|expiration') THEN 'date' WHEN regexp_matches(lower(label), 'amount|premium|limit|price') THEN 'currency' WHEN regexp_matches(lower(label), 'indicator|flag') THEN 'boolean' WHEN regexp_matches(lower(label), 'count|number|percent|size') THEN 'number' ELSE 'string' END AS data_type,
 CAST(len(list_distinct(list_concat(list_filter([trim(p_type), trim(p_brand)], lambda k: k <> ''), list_filter(string_split(label, ' '), lambda w: length(w) > 2)))) AS BIGINT) AS n_keywords FROM ent""")
def dictionary_rows(spark, sf_dir):
    return entries(spark, sf_dir).select("code", "label", "description", "data_type", F.size("keywords").cast("long").alias("n_keywords"))


@register("text_blocks", r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10))) AS block, generate_subscripts(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)), 1) - 1 AS line FROM documents)
SELECT doc_id, count(*) AS n_blocks, max(line * 24.0)::DOUBLE AS last_y, max(length(block) * 7.0)::DOUBLE AS widest FROM l WHERE trim(block, ' ') <> '' GROUP BY 1""")
def text_blocks(spark, sf_dir):
    found = readers.text_blocks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.max("box.y").alias("last_y"), F.max("box.width").alias("widest"))


@register("markup_tags", "WITH t AS (SELECT page_id, unnest(regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) SELECT tag, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM t GROUP BY 1")
def markup_tags(spark, sf_dir):
    found = readers.tags(table(spark, sf_dir, "pages"), "page_id", "html")
    return found.groupBy("page_id", "tag").agg(F.count("*").alias("n")).groupBy("tag").agg(F.sum("n").alias("n"), F.count("*").alias("n_pages"))


# --- filters and decisions -------------------------------------------------------------------------------

@register("accepted_rows", f"""WITH {CANDIDATES}, d AS (SELECT o_orderkey AS doc, CASE WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'open' END AS decision, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'C' || CAST(o_custkey % 40 AS VARCHAR) END AS chosen FROM orders),
r AS (SELECT doc, code, conf, row_number() OVER (PARTITION BY doc ORDER BY ordinal) AS k, first_value(code) OVER (PARTITION BY doc ORDER BY ordinal) AS fallback FROM cand)
SELECT r.doc, r.code, max(r.conf) AS conf FROM r JOIN d USING (doc) WHERE d.decision = 'accepted' AND r.code = coalesce(nullif(d.chosen, ''), r.fallback) GROUP BY 1, 2""")
def accepted_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    chosen = F.when(F.col("o_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("C"), (F.col("o_custkey") % 40).cast("string")))
    decided = orders.select(F.col("o_orderkey").alias("doc"), chosen.alias("chosen"))
    cand = candidates(spark, sf_dir).withColumn("fallback", F.first("code").over(Window.partitionBy("doc").orderBy("ordinal")))
    found = cand.join(decided, "doc").filter(F.col("code") == F.coalesce(F.nullif(F.col("chosen"), F.lit("")), "fallback"))
    return found.groupBy("doc", "code").agg(F.max("conf").alias("conf"))


@register("membership_gate", f"""WITH {CANDIDATES} SELECT doc, ordinal, concat_ws(',', CASE WHEN conf < 0.3 THEN 'low-confidence' END, CASE WHEN sim < 0.2 THEN 'low-similarity' END, CASE WHEN family = 'R' THEN 'family' END) AS reasons, NOT (conf < 0.3 OR sim < 0.2 OR family = 'R') AS accepted FROM cand""")
def membership_gate(spark, sf_dir):
    reasons = F.array_compact(F.array(F.when(F.col("conf") < 0.3, "low-confidence"), F.when(F.col("sim") < 0.2, "low-similarity"), F.when(F.col("family") == "R", "family")))
    return candidates(spark, sf_dir).select("doc", "ordinal", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("accepted"))


@register("strict_or_relaxed", f"""WITH {CANDIDATES}, n AS (SELECT *, count(*) FILTER (WHERE conf >= 0.8) OVER (PARTITION BY doc) AS strict FROM cand) SELECT doc, ordinal, code, conf FROM n WHERE CASE WHEN strict >= 2 THEN conf >= 0.8 ELSE conf >= 0.12 END""")
def strict_or_relaxed(spark, sf_dir):
    found = rows.with_fallback(candidates(spark, sf_dir), ["doc"], F.col("conf") >= 0.8, 2, F.col("conf") >= 0.12)
    return found.select("doc", "ordinal", "code", "conf")


@register("whitelist_fallback", f"""WITH {CANDIDATES}, n AS (SELECT *, count(*) FILTER (WHERE code IN ('C1', 'C2', 'C3', 'C5', 'C8')) OVER (PARTITION BY doc) AS k FROM cand) SELECT doc, ordinal, code FROM n WHERE k = 0 OR code IN ('C1', 'C2', 'C3', 'C5', 'C8')""")
def whitelist_fallback(spark, sf_dir):
    return rows.with_fallback(candidates(spark, sf_dir), ["doc"], F.col("code").isin("C1", "C2", "C3", "C5", "C8")).select("doc", "ordinal", "code")


@register("threshold_decision", f"""WITH {CANDIDATES}, t(family, accepted, review) AS (VALUES ('A', 0.9, 0.7)) SELECT family, CASE WHEN conf >= coalesce(accepted, 0.8) THEN 'accepted' WHEN conf >= coalesce(review, 0.6) THEN 'review' WHEN conf >= 0.45 THEN 'weak' ELSE 'rejected' END AS level, count(*) AS n FROM cand LEFT JOIN t USING (family) GROUP BY 1, 2""")
def threshold_decision(spark, sf_dir):
    limits = spark.createDataFrame([("A", 0.9, 0.7)], "family string, accepted double, review double")
    conf = F.col("conf")
    level = F.when(conf >= F.coalesce("accepted", F.lit(0.8)), "accepted").when(conf >= F.coalesce("review", F.lit(0.6)), "review").when(conf >= 0.45, "weak").otherwise("rejected")
    return candidates(spark, sf_dir).join(F.broadcast(limits), "family", "left").groupBy("family", level.alias("level")).agg(F.count("*").alias("n"))


KINDS = [("date", "date|day"), ("money", "price|amount|[$]"), ("phone", "[0-9]{3}-[0-9]{4}"), ("question", "[?]")]


@register("field_type", """WITH b AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) SELECT CASE WHEN regexp_matches(t, 'date|day') THEN 'date' WHEN regexp_matches(t, 'price|amount|[$]') THEN 'money' WHEN regexp_matches(t, '[0-9]{3}-[0-9]{4}') THEN 'phone' WHEN regexp_matches(t, '[?]') THEN 'question' ELSE 'text' END AS kind, count(*) AS n FROM b GROUP BY 1""")
def field_type(spark, sf_dir):
    kind = joins.first_rule(F.coalesce("text", F.lit("")), KINDS, "text")
    return table(spark, sf_dir, "documents").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@register("header_score", f"""WITH b AS (SELECT item_id, lower(text) AS t, text FROM benchmark) SELECT item_id, round(CASE WHEN length(text) < 60 THEN 0.35 ELSE 0 END + CASE WHEN regexp_matches(t, '[:?]$') THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(t, '^(section|part|page)') THEN 0.4 ELSE 0 END + CASE WHEN regexp_matches(t, '^[a-z ]+$') THEN 0.3 ELSE 0 END, 6) AS score FROM b""")
def header_score(spark, sf_dir):
    low = F.lower("text")
    part = lambda test, w: F.when(test, w).otherwise(0.0)
    score = part(F.length("text") < 60, 0.35) + part(low.rlike("[:?]$"), 0.3) + part(low.rlike("^(section|part|page)"), 0.4) + part(low.rlike("^[a-z ]+$"), 0.3)
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(score, 6).alias("score"))


# --- joins -----------------------------------------------------------------------------------------------

_KEYS = "[" + ", ".join(_N(x) for x in ("p_type", "p_brand")) + "]"


@register("ranked_candidates", f"""WITH {_ENTRIES}, e AS (SELECT code, label, {_N('code')} AS c, {_N('label')} AS l, {_N('description')} AS d, list_concat({_KEYS}, list_transform(list_filter(string_split(label, ' '), lambda w: length(w) > 2), lambda w: lower(w))) AS k FROM ent),
q AS (SELECT query, {_N('query')} AS q, list_filter(string_split({_N('query')}, ' '), lambda t: length(t) > 1) AS w FROM (SELECT unnest({WORDS}) AS query)),
s AS (SELECT query, code, label, CAST(CASE WHEN c = q THEN 200 WHEN starts_with(c, q) THEN 140 WHEN contains(c, q) THEN 100 ELSE 0 END + CASE WHEN l = q THEN 160 WHEN starts_with(l, q) THEN 90 WHEN contains(l, q) THEN 70 ELSE 0 END + CASE WHEN contains(d, q) THEN 50 ELSE 0 END
 + coalesce(list_sum(list_transform(w, lambda t: CASE WHEN contains(c, t) THEN 25 ELSE 0 END + CASE WHEN contains(l, t) THEN 18 ELSE 0 END + CASE WHEN contains(d, t) THEN 10 ELSE 0 END + CASE WHEN len(list_filter(k, lambda y: contains(y, t))) > 0 THEN 14 ELSE 0 END)), 0) AS INTEGER) AS score FROM e, q),
r AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, code, label) AS INTEGER) AS rank, code, label, score FROM s WHERE score > 0) SELECT * FROM r WHERE rank <= 20""")
def ranked_candidates(spark, sf_dir):
    return joins.search_dictionary(entries(spark, sf_dir), WORDS)


RULES = [joins.Rule("R1", "the", 0.4), joins.Rule("R1", "licen[cs]e", 0.9), joins.Rule("R2", "[0-9]{4}", 0.5), joins.Rule("R3", "copyright", 0.7, "web")]


@register("rule_join", """WITH r(code, pattern, weight, family) AS (VALUES ('R1', 'the', 0.4, NULL), ('R1', 'licen[cs]e', 0.9, NULL), ('R2', '[0-9]{4}', 0.5, NULL), ('R3', 'copyright', 0.7, 'web'))
SELECT doc_id, code, CAST(max(weight) AS DOUBLE) AS weight FROM documents JOIN r ON regexp_matches(lower(text), pattern) AND (family IS NULL OR family = source) GROUP BY 1, 2""")
def rule_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return joins.rule_join(docs, "text", RULES, "source").select("doc_id", "code", "weight")


@register("token_index", f"""WITH {PART_TOKENS}, o AS (SELECT DISTINCT p_partkey AS other, unnest(type_tokens) AS token FROM pt), h AS (SELECT DISTINCT p_partkey, unnest(type_tokens) AS token FROM pt WHERE p_partkey % 100 = 0) SELECT DISTINCT p_partkey, other FROM h JOIN o USING (token) WHERE p_partkey <> other""")
def token_index(spark, sf_dir):
    return joins.token_index_join(part_tokens(spark, sf_dir), "p_partkey", "type_tokens", "type_tokens", F.col("p_partkey") % 100 == 0)


@register("vector_join", """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM u a JOIN u b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank, vec_id, similarity FROM s WHERE similarity >= 0.3) SELECT query_id, rank, vec_id, round(similarity, 4) AS similarity FROM r WHERE rank <= 12""")
def vector_join(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").filter("embedding is not null")
    found = joins.vector_join(vectors.filter(F.col("vec_id") % 100 == 0), vectors, "vec_id", "embedding")
    return found.select("query_id", "rank", "vec_id", F.round("similarity", 4).alias("similarity"))


@register("nearest_label", f"""WITH {BLOCKS}, m AS (SELECT f.page, f.block AS field, l.block AS label, round(abs(f.x - l.x) + 2 * abs(f.y - l.y) + CASE WHEN l.x > f.x THEN 50 ELSE 0 END, 6) AS cost FROM blk f JOIN blk l ON f.page = l.page AND f.block % 2 = 0 AND l.block % 2 = 1),
r AS (SELECT page, field, label, cost, row_number() OVER (PARTITION BY page, field ORDER BY cost, label) AS rank FROM m) SELECT page, field, label, cost FROM r WHERE rank = 1""")
def nearest_label(spark, sf_dir):
    found = blocks(spark, sf_dir)
    cost = F.abs(F.col("fb.x") - F.col("lb.x")) + 2 * F.abs(F.col("fb.y") - F.col("lb.y")) + F.when(F.col("lb.x") > F.col("fb.x"), 50).otherwise(0)
    fields = found.filter("block % 2 = 0").withColumnRenamed("block", "field")
    labels = found.filter("block % 2 = 1").withColumnRenamed("block", "label")
    corner = lambda box: (F.col(f"{box}.x"), F.col(f"{box}.y"))
    return joins.nearest(fields, labels, "page", "field", "label", cost, query_at=corner("fb"), point_at=corner("lb"), weights=(1.0, 2.0)).drop("rank")


@register("overlap_pairs", f"""WITH {BLOCKS}, m AS (SELECT a.page, a.block AS "left", b.block AS "right", greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS s, a.w * a.h + b.w * b.h AS t FROM blk a JOIN blk b ON a.page = b.page AND a.block < b.block)
SELECT page, "left", "right", round(s / (t - s), 6) AS iou FROM m WHERE round(s / (t - s), 6) >= 0.05""")
def overlap_pairs(spark, sf_dir):
    return joins.overlapping(blocks(spark, sf_dir), "page", "block", 0.05)


@register("constraint_violations", f"""WITH {CANDIDATES}, s AS (SELECT DISTINCT doc, code FROM cand WHERE conf >= 0.5), p(code, parent) AS (SELECT 'C' || CAST(i AS VARCHAR), 'C' || CAST(i // 2 AS VARCHAR) FROM range(1, 40) t(i)), x(code, other) AS (VALUES ('C3', 'C4'), ('C10', 'C11'))
SELECT s.doc, s.code, 'missing-parent' AS kind, parent AS other FROM s JOIN p USING (code) WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.doc = s.doc AND o.code = parent)
UNION ALL SELECT s.doc, s.code, 'exclusive', other FROM s JOIN x USING (code) WHERE EXISTS (SELECT 1 FROM s o WHERE o.doc = s.doc AND o.code = other)""")
def constraint_violations(spark, sf_dir):
    chosen = candidates(spark, sf_dir).filter("conf >= 0.5")
    parents = spark.range(1, 40).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("code"), F.concat(F.lit("C"), F.floor(F.col("id") / 2).cast("string")).alias("parent"))
    exclusive = spark.createDataFrame([("C3", "C4"), ("C10", "C11")], "code string, other string")
    return joins.constraint_violations(chosen, parents, exclusive)


@register("replay_diff", """WITH b AS (SELECT l_orderkey AS doc, l_linenumber AS block, l_partkey % 40 AS code, l_returnflag AS kind FROM lineitem), r AS (SELECT l_orderkey AS doc, l_linenumber AS block, CASE WHEN l_partkey % 7 = 0 THEN 99 ELSE l_partkey % 40 END AS code, CASE WHEN l_suppkey % 5 = 0 THEN 'N' ELSE l_returnflag END AS kind FROM lineitem WHERE l_quantity > 5)
SELECT b.kind, count(*) AS n, count(*) FILTER (WHERE r.doc IS NULL) AS missing, count(*) FILTER (WHERE r.code <> b.code) AS label_mismatch, count(*) FILTER (WHERE r.kind <> b.kind) AS kind_mismatch, round(count(*) FILTER (WHERE r.doc IS NULL) / greatest(1, count(*)), 6) AS missing_rate FROM b LEFT JOIN r USING (doc, block) GROUP BY 1""")
def replay_diff(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    keys = [F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("block")]
    base = li.select(*keys, (F.col("l_partkey") % 40).alias("code"), F.col("l_returnflag").alias("kind"))
    replay = li.filter("l_quantity > 5").select(*keys, F.when(F.col("l_partkey") % 7 == 0, 99).otherwise(F.col("l_partkey") % 40).alias("r_code"), F.when(F.col("l_suppkey") % 5 == 0, "N").otherwise(F.col("l_returnflag")).alias("r_kind"))
    met = base.join(replay, ["doc", "block"], "left")
    missing = F.count_if(F.col("r_code").isNull())
    return met.groupBy("kind").agg(F.count("*").alias("n"), missing.alias("missing"), F.count_if(F.col("r_code") != F.col("code")).alias("label_mismatch"), F.count_if(F.col("r_kind") != F.col("kind")).alias("kind_mismatch"), F.round(missing / F.greatest(F.lit(1), F.count("*")), 6).alias("missing_rate"))


@register("snapshot_drift", """WITH m AS (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS month, o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2), b AS (SELECT * FROM m WHERE month % 2 = 0), a AS (SELECT month + 1 AS month, status, n, total FROM m WHERE month % 2 = 1),
j AS (SELECT coalesce(b.month, a.month) AS month, coalesce(b.status, a.status) AS status, b.n AS bn, a.n AS an FROM b FULL JOIN a ON b.month = a.month AND b.status = a.status)
SELECT month, status, 'n' AS field, coalesce(bn, 0) AS before, coalesce(an, 0) AS after FROM j WHERE coalesce(bn, 0) <> coalesce(an, 0)""")
def snapshot_drift(spark, sf_dir):
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long")
    m = table(spark, sf_dir, "orders").groupBy(month.alias("month"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    after = m.filter("month % 2 = 1").withColumn("month", F.col("month") + 1)
    return rows.difference(m.filter("month % 2 = 0"), after, ["month", "status"], ["n"], 0)


# --- dedupe, ranking, order ------------------------------------------------------------------------------

@register("dedupe_rules", f"""WITH {CANDIDATES}, f AS (SELECT doc, family, first(code ORDER BY ordinal) AS first_code, last(code ORDER BY ordinal) AS last_code, min(ordinal) AS ordinal FROM cand GROUP BY 1, 2), m AS (SELECT doc, family, code AS max_code FROM (SELECT *, row_number() OVER (PARTITION BY doc, family ORDER BY conf DESC, ordinal) AS k FROM cand) WHERE k = 1) SELECT doc, family, first_code, last_code, ordinal, max_code FROM f JOIN m USING (doc, family)""")
def dedupe_rules(spark, sf_dir):
    cand, keys = candidates(spark, sf_dir).select("doc", "family", "code", "ordinal", "conf"), ["doc", "family"]
    last = rows.last_wins(cand, keys, "ordinal").select(*keys, "ordinal", F.col("code").alias("last_code"))
    first = rows.first_wins(cand, keys, [F.col("ordinal")]).select(*keys, F.col("code").alias("first_code"))
    best = rows.max_wins(cand, keys, "conf", "ordinal").select(*keys, F.col("code").alias("max_code"))
    return last.join(first, keys).join(best, keys)


@register("candidate_rank", f"""WITH {CANDIDATES}, r AS (SELECT doc, ordinal, row_number() OVER w AS rank, conf - lead(conf) OVER w AS gap, conf, max(conf) OVER (PARTITION BY doc) AS top FROM cand WINDOW w AS (PARTITION BY doc ORDER BY conf DESC, sim DESC, code, ordinal)) SELECT doc, ordinal, CAST(rank AS INTEGER) AS rank, round(gap, 6) AS margin, round(CASE WHEN top = 0 THEN 0.0 ELSE conf / top END, 6) AS relative, round(CASE WHEN top = 0 THEN 0.0 ELSE gap / top END, 6) AS relative_margin FROM r""")
def candidate_rank(spark, sf_dir):
    w = Window.partitionBy("doc").orderBy(F.col("conf").desc(), F.col("sim").desc(), "code", "ordinal")
    top = F.max("conf").over(Window.partitionBy("doc"))
    gap, share = F.col("conf") - F.lead("conf").over(w), lambda part: F.round(F.when(top == 0, 0.0).otherwise(part / top), 6)
    return candidates(spark, sf_dir).select("doc", "ordinal", F.row_number().over(w).alias("rank"), F.round(gap, 6).alias("margin"), share(F.col("conf")).alias("relative"), share(gap).alias("relative_margin"))


@register("neighbour_probe", f"""WITH {BLOCKS}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x, block) AS k FROM blk) SELECT a.page, a.block, coalesce(bool_or(b.flag = 'R' AND abs(a.y - b.y) <= 82), false) AS near FROM o a LEFT JOIN o b ON a.page = b.page AND a.k <> b.k AND abs(a.k - b.k) <= 3 GROUP BY 1, 2""")
def neighbour_probe(spark, sf_dir):
    b = blocks(spark, sf_dir).select("page", "block", F.col("box.y").alias("y"), F.col("box.x").alias("x"), (F.col("flag") == "R").alias("cue"))
    return rows.neighbour_probe(b, ["page"], ["y", "x", "block"], "y", "cue", 3, 82, "near").select("page", "block", "near")


@register("look_back_role", f"""WITH {BLOCKS}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x, block) AS k, CASE WHEN flag <> 'N' THEN flag END AS role FROM blk), p AS (SELECT a.page, a.block, min({{'d': a.y - b.y, 'r': b.role}}) AS near FROM o a JOIN o b ON a.page = b.page AND b.k < a.k AND b.k >= a.k - 90 AND b.role IS NOT NULL AND a.y - b.y <= 520 GROUP BY 1, 2) SELECT o.page, o.block, coalesce(o.role, p.near.r) AS section FROM o LEFT JOIN p USING (page, block)""")
def look_back_role(spark, sf_dir):
    b = blocks(spark, sf_dir).select("page", "block", F.col("box.y").alias("y"), F.col("box.x").alias("x"), F.when(F.col("flag") != "N", F.col("flag")).alias("role"))
    return rows.look_back(b, ["page"], ["y", "x", "block"], "y", "role", 90, 520, "section").select("page", "block", "section")


@register("gap_groups", """WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, event_id, CASE WHEN epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts) > 1800 THEN 1 ELSE 0 END AS o FROM events), r AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n, round(max(t) - min(t), 3) AS seconds FROM r GROUP BY 1, 2 HAVING count(*) >= 2""")
def gap_groups(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    found = rows.gap_groups(events, ["user_id"], "t", 1800.0, "run", 2)
    return found.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.round(F.max("t") - F.min("t"), 3).alias("seconds"))


@register("bounded_history", """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n_seen FROM events) SELECT user_id, any_value(n_seen) AS n_seen, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS history FROM r WHERE k <= 12 GROUP BY 1""")
def bounded_history(spark, sf_dir):
    found = rows.history(table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("seen")), ["user_id"], "event_id", "seen")
    return found.select("user_id", F.col("n_seen"), F.array_join("history", ",").alias("history"))


# --- aggregates ------------------------------------------------------------------------------------------

@register("summary_stats", f"WITH {CANDIDATES} SELECT family, count(conf) AS n, round(avg(conf), 6) AS mean, round(min(conf), 6) AS least, round(max(conf), 6) AS greatest FROM cand GROUP BY 1")
def summary_stats(spark, sf_dir):
    return aggregates.summary(candidates(spark, sf_dir), ["family"], "conf")


@register("confidence_histogram", f"WITH {CANDIDATES} SELECT family, CASE WHEN conf < 0.2 THEN '0.0-0.2' WHEN conf < 0.4 THEN '0.2-0.4' WHEN conf < 0.6 THEN '0.4-0.6' WHEN conf < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END AS bucket, count(*) AS n FROM cand GROUP BY 1, 2")
def confidence_histogram(spark, sf_dir):
    return aggregates.histogram(candidates(spark, sf_dir), ["family"], "conf")


@register("code_profile", f"WITH {CANDIDATES}, t AS (SELECT *, 0.4 + (doc % 3) / 10.0 AS threshold FROM cand) SELECT code, count(*) AS n, round(avg(conf), 6) AS mean, min(conf) AS least, max(conf) AS greatest, count(*) FILTER (WHERE conf < threshold) AS n_below, round(avg(CASE WHEN abs(conf - sim) > 0.45 THEN 1 ELSE 0 END), 6) AS disagreement, CAST(arg_max(threshold, {{'d': doc, 'o': ordinal}}) AS DOUBLE) AS threshold FROM t GROUP BY 1")
def code_profile(spark, sf_dir):
    cand = candidates(spark, sf_dir).withColumn("threshold", 0.4 + (F.col("doc") % 3) / 10)
    return aggregates.code_profile(cand, "code", "conf", "threshold", ["doc", "ordinal"], F.abs(F.col("conf") - F.col("sim")) > 0.45)


@register("code_consistency", f"WITH {CANDIDATES}, m AS (SELECT code, family, avg(conf) AS mean, count(*) AS n, count(*) FILTER (WHERE conf < 0.4) AS weak FROM cand GROUP BY 1, 2) SELECT code, count(*) AS n_families, CAST(sum(n) AS BIGINT) AS n, round(max(mean) - min(mean), 6) AS delta, round(max(mean) - min(mean), 6) >= 0.35 AS inconsistent, sum(weak) / sum(n) >= 0.45 AS weak FROM m GROUP BY 1")
def code_consistency(spark, sf_dir):
    return aggregates.consistency(candidates(spark, sf_dir), "code", "family", "conf")


@register("accepted_consistency", f"WITH {CANDIDATES}, m AS (SELECT code, family, avg(conf) AS mean, count(*) AS n, count(*) FILTER (WHERE conf < 0.4) AS weak FROM cand WHERE sim >= 0.5 GROUP BY 1, 2) SELECT code, count(*) AS n_families, CAST(sum(n) AS BIGINT) AS n, round(max(mean) - min(mean), 6) AS delta, round(max(mean) - min(mean), 6) >= 0.35 AS inconsistent, sum(weak) / sum(n) >= 0.45 AS weak FROM m GROUP BY 1")
def accepted_consistency(spark, sf_dir):
    return aggregates.consistency(candidates(spark, sf_dir), "code", "family", "conf", accepted=F.col("sim") >= 0.5)


@register("family_means", f"WITH {CANDIDATES}, m AS (SELECT family, avg(conf) AS mean FROM cand GROUP BY 1), o AS (SELECT *, avg(mean) OVER () AS overall FROM m) SELECT family, round(mean, 6) AS mean, round(overall, 6) AS overall, round(mean - overall, 6) AS delta, round(1 - avg(abs(mean - overall)) OVER (), 6) AS transferability FROM o")
def family_means(spark, sf_dir):
    return aggregates.family_means(candidates(spark, sf_dir), "family", "conf")


@register("group_fusion", f"WITH {CANDIDATES}, g AS (SELECT *, 'G' || CAST(quantity::BIGINT % 10 AS VARCHAR) AS grp FROM cand) SELECT grp, count(DISTINCT doc) AS n_docs, list_aggregate(list_sort(list(DISTINCT family)), 'string_agg', ',') AS families, round(avg(conf), 6) AS conf, round(avg(sim), 6) AS sim, arg_min(code, {{'d': doc, 'o': ordinal}}) AS canonical, count(DISTINCT code) > 1 AS conflict, count(DISTINCT code) AS n_codes FROM g GROUP BY 1")
def group_fusion(spark, sf_dir):
    cand = candidates(spark, sf_dir).withColumn("grp", F.concat(F.lit("G"), (F.col("quantity").cast("long") % 10).cast("string")))
    return aggregates.fusion(cand, "grp", "doc", "family", "code", ["conf", "sim"], ["doc", "ordinal"])


@register("contradictions", f"WITH {CANDIDATES} SELECT CAST(doc AS VARCHAR) AS doc, count(*) AS n, count(DISTINCT code) AS n_codes, min(conf) AS least FROM cand GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT code) >= 2 AND min(conf) >= 0.5")
def contradictions(spark, sf_dir):
    return aggregates.contradictions(candidates(spark, sf_dir).withColumn("doc", F.col("doc").cast("string")), "doc", "code", "conf", 0.5)


@register("risk_score", f"WITH {CANDIDATES}, s AS (SELECT doc, round(least(1, greatest(0, 0.32 * coalesce(avg(CASE WHEN family = 'A' THEN conf END), 0) + 0.33 * coalesce(avg(CASE WHEN family = 'N' THEN conf END), 0) + 0.2 * coalesce(avg(CASE WHEN family = 'R' THEN conf END), 0) + 0.15 * coalesce(avg(sim), 0))), 9) AS score FROM cand GROUP BY 1) SELECT doc, score, CASE WHEN score < 0.34 THEN 'low' WHEN score < 0.67 THEN 'medium' ELSE 'high' END AS class FROM s")
def risk_score(spark, sf_dir):
    parts = [F.when(F.col("family") == f, F.col("conf")) for f in "ANR"] + [F.col("sim")]
    return aggregates.risk(candidates(spark, sf_dir), "doc", parts)


@register("mode_priors", f"WITH {CANDIDATES}, c AS (SELECT family, code, count(*) AS n FROM cand GROUP BY 1, 2) SELECT family, code, round(greatest(0.35 + n / sum(n) OVER (PARTITION BY family), CASE WHEN family = 'A' AND code = 'C1' THEN 0.6 ELSE 0 END), 6) AS weight FROM c")
def mode_priors(spark, sf_dir):
    return aggregates.mode_priors(candidates(spark, sf_dir), "family", "code", {("A", "C1"): 0.6})


@register("exact_median", f"WITH {CANDIDATES} SELECT code, round(median(quantity), 6) AS median, round(quantile_cont(quantity, 0.95), 6) AS p95 FROM cand GROUP BY 1")
def exact_median(spark, sf_dir):
    return candidates(spark, sf_dir).groupBy("code").agg(F.round(F.median("quantity"), 6).alias("median"), F.round(F.percentile("quantity", 0.95), 6).alias("p95"))


@register("error_pivot", "SELECT o_orderpriority AS form, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def error_pivot(spark, sf_dir):
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("form")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return found.select("form", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


# --- graph -----------------------------------------------------------------------------------------------

_GRAPH = "e0 AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_returnflag AS kind FROM lineitem)"


def _edges(spark, sf_dir):
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    return table(spark, sf_dir, "lineitem").select(name("s", "l_suppkey").alias("src"), name("p", "l_partkey").alias("dst"), F.col("l_returnflag").alias("kind")).distinct()


@register("graph_inference", f"WITH {_GRAPH} SELECT dst AS node, kind, string_agg(src, ',' ORDER BY src) AS sources FROM e0 GROUP BY 1, 2")
def graph_inference(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"))
    return graph.neighbours(nodes, _edges(spark, sf_dir)).select("node", "kind", F.array_join("sources", ",").alias("sources"))


@register("graph_scores", f"""WITH {_GRAPH}, i AS (SELECT dst AS node, count(DISTINCT CASE WHEN kind = 'A' THEN src END) AS a, count(DISTINCT CASE WHEN kind = 'N' THEN src END) AS n, count(DISTINCT CASE WHEN kind = 'R' THEN src END) AS r, count(*) AS m, count(DISTINCT src) AS k FROM e0 GROUP BY 1)
SELECT node, round(least(1.0, (CASE WHEN a > 0 THEN 0.15 ELSE 0 END) + (CASE WHEN n > 0 THEN 0.12 ELSE 0 END) + (CASE WHEN r > 0 THEN 0.08 ELSE 0 END)), 6) AS typed_score, a = 0 AND n = 0 AS abstain, round(least(1.0, k / 3) * 0.5 + least(1.0, m / 4) * 0.5, 6) AS both_score FROM i""")
def graph_scores(spark, sf_dir):
    return graph.inference_scores(_edges(spark, sf_dir), {"A": 0.15, "N": 0.12, "R": 0.08}, ("A", "N")).filter("node like 'p%'")


_LINKS = "l0 AS (SELECT l_orderkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM lineitem WHERE l_quantity = 1)"


@register("graph_components", f"WITH RECURSIVE {_LINKS}, e AS (SELECT src, dst FROM l0 UNION SELECT dst, src FROM l0), r(node, reach) AS (SELECT DISTINCT src, src FROM e UNION SELECT r.node, e.dst FROM r JOIN e ON r.reach = e.src) SELECT node, min(reach) AS root FROM r GROUP BY 1")
def graph_components(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_quantity = 1")
    return graph.components(li.select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")))


@register("ontology_edges", f"""WITH {PART_TOKENS}, e AS (SELECT p_partkey AS id, list_distinct(CASE WHEN p_partkey % 10 = 0 THEN type_tokens ELSE list_concat(name_tokens, type_tokens) END) AS t FROM pt WHERE p_partkey % 10 < 5)
SELECT p.id AS parent, c.id AS child FROM e p JOIN e c ON len(p.t) < len(c.t) AND len(p.t) > 0 AND p.id % 100 = 0 AND list_has_all(c.t, p.t)""")
def ontology_edges(spark, sf_dir):
    key = F.col("p_partkey")
    items = F.when(key % 10 == 0, F.col("type_tokens")).otherwise(F.concat("name_tokens", "type_tokens"))
    each = part_tokens(spark, sf_dir).filter(key % 10 < 5).select("p_partkey", items.alias("t"))
    return graph.ontology(each, "p_partkey", "t", F.col("id") % 100 == 0)


# --- order-dependent; the SQL goes through a page row by row ------------------------------------------------

@register("consistency_carry", f"""WITH RECURSIVE {CANDIDATES}, o AS (SELECT *, row_number() OVER (PARTITION BY doc, family ORDER BY ordinal, conf, sim) AS rn FROM cand), s AS (SELECT doc, family, ordinal, rn, code AS carried, conf AS hs FROM o WHERE rn = 1
 UNION ALL SELECT o.doc, o.family, o.ordinal, o.rn, CASE WHEN o.conf >= s.hs + 0.17 AND o.conf >= 0.8 THEN o.code ELSE s.carried END, CASE WHEN o.conf >= s.hs + 0.17 AND o.conf >= 0.8 THEN o.conf ELSE s.hs END FROM s JOIN o ON o.doc = s.doc AND o.family = s.family AND o.rn = s.rn + 1) SELECT doc, ordinal, carried FROM s""")
def consistency_carry(spark, sf_dir):
    found = ordered.consistency_carry(candidates(spark, sf_dir), "doc", ["ordinal", "conf", "sim"], "family", "code", "conf")
    return found.select("doc", "ordinal", "carried")


_BOX = "{'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h}"
_MEETS = "(greatest(0, least(k.x + k.w, o.x + o.w) - greatest(k.x, o.x)) * greatest(0, least(k.y + k.h, o.y + o.h) - greatest(k.y, o.y)))"
_KEEPS = f"len(list_filter(s.held, lambda k: {_MEETS} < o.w * o.h + k.w * k.h AND {_MEETS} >= 0.05 * (o.w * o.h + k.w * k.h - {_MEETS}))) = 0"


@register("overlap_suppression", f"""WITH RECURSIVE {BLOCKS}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY conf DESC, block) AS rn FROM blk), s AS (SELECT page, block, rn, true AS kept, [{_BOX}] AS held FROM o WHERE rn = 1
 UNION ALL SELECT o.page, o.block, o.rn, {_KEEPS}, CASE WHEN {_KEEPS} THEN list_append(s.held, {_BOX}) ELSE s.held END FROM s JOIN o ON o.page = s.page AND o.rn = s.rn + 1) SELECT page, block, kept FROM s""")
def overlap_suppression(spark, sf_dir):
    b = blocks(spark, sf_dir).select("page", "block", "conf", "box.*")
    return ordered.suppress_overlaps(b, "page", "block", "conf", 0.05).select("page", "block", "kept")


_NEAREST = "list_sort(list_transform(list_filter(range(1, len(p.ps) + 1), lambda i: NOT list_contains(s.used, i)), lambda i: {'d': sqrt(power(p.ps[i].x - t.x, 2) + power(p.ps[i].y - t.y, 2)), 'i': i}))[1]"


@register("greedy_match", f"""WITH RECURSIVE {BLOCKS}, p AS (SELECT page, list({{'b': block, 'x': x, 'y': y}} ORDER BY block) AS ps FROM blk WHERE block % 2 = 1 GROUP BY 1), t AS (SELECT page, block, x, y, row_number() OVER (PARTITION BY page ORDER BY block) AS rn FROM blk WHERE block % 2 = 0),
 s AS (SELECT DISTINCT t.page, 0::BIGINT AS rn, []::BIGINT[] AS used, NULL::BIGINT AS truth, NULL::BIGINT AS prediction, NULL::DOUBLE AS far FROM t JOIN p USING (page)
 UNION ALL SELECT t.page, t.rn, CASE WHEN {_NEAREST}.d <= 200 THEN list_append(s.used, {_NEAREST}.i) ELSE s.used END, t.block, CASE WHEN {_NEAREST}.d <= 200 THEN p.ps[{_NEAREST}.i].b END, {_NEAREST}.d FROM s JOIN t ON t.page = s.page AND t.rn = s.rn + 1 JOIN p ON p.page = s.page)
SELECT page, truth, prediction, round(far, 6) AS distance FROM s WHERE prediction IS NOT NULL""")
def greedy_match(spark, sf_dir):
    b = blocks(spark, sf_dir).select("page", "block", "box.*", (F.col("block") % 2 == 0).alias("truth_row"))
    return ordered.greedy_match(b, "page", "block", "truth_row", 200.0)


_FIRST = "coalesce(list_filter(range(1, len(s.cs) + 1), lambda i: sqrt(power(o.x - s.cs[i].a, 2) + power(o.y - s.cs[i].b, 2)) <= 200)[1], len(s.cs) + 1)"


@register("leader_clusters", f"""WITH RECURSIVE {BLOCKS}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x, block) AS rn FROM blk), s AS (SELECT page, block, rn, 0::BIGINT AS cluster, [{{'a': x, 'b': y, 'n': 1}}] AS cs FROM o WHERE rn = 1
 UNION ALL SELECT o.page, o.block, o.rn, {_FIRST} - 1, CASE WHEN {_FIRST} > len(s.cs) THEN list_append(s.cs, {{'a': o.x, 'b': o.y, 'n': 1}}) ELSE list_transform(range(1, len(s.cs) + 1), lambda i: CASE WHEN i = {_FIRST} THEN {{'a': (s.cs[i].a * s.cs[i].n + o.x) / (s.cs[i].n + 1), 'b': (s.cs[i].b * s.cs[i].n + o.y) / (s.cs[i].n + 1), 'n': s.cs[i].n + 1}} ELSE s.cs[i] END) END
 FROM s JOIN o ON o.page = s.page AND o.rn = s.rn + 1) SELECT page, block, CAST(cluster AS INTEGER) AS cluster FROM s""")
def leader_clusters(spark, sf_dir):
    b = blocks(spark, sf_dir).select("page", "block", "box.x", "box.y")
    return ordered.leader_clusters(b, "page", ["y", "x", "block"], 200.0).select("page", "block", "cluster")


@register("element_export", f"""WITH {CANDIDATES} SELECT doc, '<Submission>' || string_agg('<' || code || '>' || CAST(CAST(quantity AS BIGINT) AS VARCHAR) || '</' || code || '>', '' ORDER BY ordinal) || '</Submission>' AS xml FROM cand GROUP BY 1""")
def element_export(spark, sf_dir):
    return sinks.to_elements(candidates(spark, sf_dir).withColumn("quantity", F.col("quantity").cast("long")), "doc", ["ordinal"], "code", "quantity")


_FREE = "coalesce(o.y + 4 * list_filter(range(0, 11), lambda j: len(list_filter(s.held, lambda k: least(k.x + k.w, o.x + o.w) > greatest(k.x, o.x) AND least(k.y + k.h, o.y + 4 * j + o.h) > greatest(k.y, o.y + 4 * j))) = 0)[1], list_max(list_transform(s.held, lambda k: k.y + k.h)))"


@register("label_placement", f"""WITH RECURSIVE {BLOCKS}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY conf DESC, block) AS rn FROM blk), s AS (SELECT page, block, rn, y AS placed_y, [{{'x': x, 'y': y, 'w': w, 'h': h}}] AS held FROM o WHERE rn = 1
 UNION ALL SELECT o.page, o.block, o.rn, {_FREE}, list_append(s.held, {{'x': o.x, 'y': {_FREE}, 'w': o.w, 'h': o.h}}) FROM s JOIN o ON o.page = s.page AND o.rn = s.rn + 1) SELECT page, block, placed_y FROM s""")
def label_placement(spark, sf_dir):
    b = blocks(spark, sf_dir).select("page", "block", "conf", "box.*")
    return ordered.nudged(b, "page", "block", "conf").select("page", "block", "placed_y")


@register("exclusive_export", f"WITH {CANDIDATES}, f AS (SELECT doc, min(ordinal) AS barred_after FROM cand WHERE code = 'C3' GROUP BY 1) SELECT c.doc, c.ordinal, c.code FROM cand c LEFT JOIN f USING (doc) WHERE NOT (c.code = 'C4' AND c.ordinal > coalesce(f.barred_after, 9223372036854775807))")
def exclusive_export(spark, sf_dir):
    return rows.exclusive_rows(candidates(spark, sf_dir).select("doc", "ordinal", "code"), "doc", "ordinal", "code", {"C3": ["C4"]})


@register("schema_export", f"""WITH {CANDIDATES}, n AS (SELECT doc, lower(code) AS base, family, row_number() OVER (PARTITION BY doc, code ORDER BY ordinal, family) AS n FROM cand), u AS (SELECT doc, family, CASE WHEN n > 1 THEN base || '_' || n ELSE base END AS name FROM n)
SELECT doc, '{{"type":"object","properties":{{' || string_agg('"' || name || '":{{"type":"' || family || '"}}', ',' ORDER BY name) || '}}}}' AS schema FROM u GROUP BY 1""")
def schema_export(spark, sf_dir):
    return sinks.to_schema(candidates(spark, sf_dir), "doc", ["ordinal", "family"], "code", "family")


@register("promotions", f"""WITH {PROMPT_BLOCKS}, q AS (SELECT page, block, text, conf, max(CASE WHEN regexp_matches(lower(text), 'insured') THEN {{'c': conf, 'b': -block}} END) OVER (PARTITION BY page) AS a, max(CASE WHEN regexp_matches(lower(text), 'policy|premium') THEN {{'c': conf, 'b': -block}} END) OVER (PARTITION BY page) AS b FROM pb),
 r AS (SELECT *, coalesce(regexp_matches(lower(text), 'insured') AND a = {{'c': conf, 'b': -block}}, false) AS pa, coalesce(regexp_matches(lower(text), 'policy|premium') AND b = {{'c': conf, 'b': -block}}, false) AS pb2 FROM q)
SELECT page, block, CASE WHEN pa THEN 'NamedInsured' WHEN pb2 THEN 'Policy' ELSE 'none' END AS code, CASE WHEN pa THEN greatest(conf, 0.84) WHEN pb2 THEN greatest(conf, 0.78) ELSE conf END AS conf, pa OR pb2 AS promoted FROM r""")
def promotions(spark, sf_dir):
    b = prompt_blocks(spark, sf_dir).withColumn("code", F.lit("none"))
    return rows.promoted(b, "page", "text", "code", "conf", "block", [("NamedInsured", "insured", 0.84), ("Policy", "policy|premium", 0.78)]).select("page", "block", "code", "conf", "promoted")


@register("accepted_candidates", f"""WITH {CANDIDATES}, d AS (SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 3 = 0 THEN 'rejected' ELSE 'accepted' END AS decision, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'C' || (o_orderkey % 40) END AS chosen, CASE WHEN o_orderkey % 7 <> 0 THEN 'C' || (o_custkey % 40) END AS fallback FROM orders),
 k AS (SELECT doc, coalesce(nullif(chosen, ''), nullif(fallback, '')) AS chosen FROM d WHERE decision = 'accepted') SELECT k.doc, k.chosen, min(ordinal) AS ordinal, arg_min(conf, ordinal) AS score FROM k JOIN cand ON k.doc = cand.doc AND k.chosen = cand.code GROUP BY 1, 2""")
def accepted_candidates(spark, sf_dir):
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    code = lambda c: F.concat(F.lit("C"), (F.col(c) % 40).cast("string"))
    decisions = o.select(key.alias("doc"), F.when(key % 3 == 0, "rejected").otherwise("accepted").alias("decision"), F.when(key % 5 == 0, "").otherwise(code("o_orderkey")).alias("chosen"))
    mappings = o.select(key.alias("doc"), F.when(key % 7 != 0, code("o_custkey")).alias("fallback"))
    c = candidates(spark, sf_dir).select("doc", "code", "ordinal", F.col("conf").alias("score"))
    return rows.accepted(decisions, mappings, c, ["doc"])


@register("strict_bindings", "SELECT l_orderkey, l_linenumber, l_partkey * 1000000 + l_suppkey AS k FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'F' AND l_partkey % 4 <> 0 AND l_suppkey % 3 <> 0 AND (l_partkey * 1000000 + l_suppkey) NOT IN (SELECT l_partkey * 1000000 + l_suppkey FROM lineitem WHERE l_quantity > 45)")
def strict_bindings(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_partkey") * 1_000_000 + F.col("l_suppkey"))
    say = lambda test, other="rejected": F.when(test, "accepted").otherwise(other)
    b = li.select("l_orderkey", "l_linenumber", "k", say(F.col("l_returnflag") == "N").alias("mapping"), F.when(F.col("l_partkey") % 4 == 0, "rejected").alias("label"), say(F.col("l_linestatus") == "F").alias("field"), F.when(F.col("l_suppkey") % 3 == 0, "rejected").alias("candidate"))
    return rows.strictly_accepted(b, li.filter("l_quantity > 45"), "k").select("l_orderkey", "l_linenumber", "k")


@register("page_boxes", f"WITH {BLOCKS} SELECT page, block, CAST(greatest(0, least(1000, floor(x / 700 * 1000 + 0.5))) AS INTEGER) AS x0, CAST(greatest(0, least(1000, floor((y + h) / 820 * 1000 + 0.5))) AS INTEGER) AS y1, round(sqrt((x + w / 2) * (x + w / 2) + (y + h / 2) * (y + h / 2)), 6) AS far FROM blk")
def page_boxes(spark, sf_dir):
    scaled = numeric.box_to_1000(F.col("box"), F.lit(700.0), F.lit(820.0))
    origin = numeric.box(F.lit(0), F.lit(0), F.lit(0), F.lit(0))
    return blocks(spark, sf_dir).select("page", "block", scaled[0].alias("x0"), scaled[3].alias("y1"), F.round(numeric.centre_distance(F.col("box"), origin), 6).alias("far"))


@register("edge_overrides", "WITH o AS (SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0) SELECT * FROM o UNION ALL SELECT n_nationkey, 'renamed', n_regionkey FROM nation WHERE n_nationkey % 7 = 0 AND n_nationkey % 5 <> 0")
def edge_overrides(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    renamed = nation.filter("n_nationkey % 7 = 0").withColumns({"n_name": F.lit("renamed"), "ordinal": F.lit(1), "active": F.lit(True)})
    gone = nation.filter("n_nationkey % 5 = 0").withColumns({"ordinal": F.lit(2), "active": F.lit(False)})
    return rows.apply_overrides(nation, renamed.unionByName(gone), "n_nationkey", "ordinal", "active")


@register("signal_fusion", f"WITH {CANDIDATES}, s AS (SELECT doc, code, conf * 0.6 AS score, sim FROM cand UNION ALL SELECT doc, code, sim * 0.4, 0.0 FROM cand) SELECT doc, code, round(sum(score), 6) AS score, max(sim) AS sim FROM s GROUP BY 1, 2")
def signal_fusion(spark, sf_dir):
    cand = candidates(spark, sf_dir)
    lexical = cand.select("doc", "code", (F.col("conf") * 0.6).alias("score"), "sim")
    semantic = cand.select("doc", "code", (F.col("sim") * 0.4).alias("score"), F.lit(0.0).alias("sim"))
    return lexical.unionByName(semantic).groupBy("doc", "code").agg(F.round(F.sum("score"), 6).alias("score"), F.max("sim").alias("sim"))


@register("metric_windows", "SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) // 1000000 AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def metric_windows(spark, sf_dir):
    found = metric_windows_of(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value")
    return found.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))
