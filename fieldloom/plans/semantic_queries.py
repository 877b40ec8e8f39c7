"""Registered code, namespace, graph, family, memory and submission operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import text
from fieldloom.operators import semantics as S
from fieldloom.plans.evaluation_queries import fnv_sql
from fieldloom.plans.predicate_queries import rx
from fieldloom.plans.tables import BLOCKS, CANDIDATES, PART_TOKENS, PROMPT_BLOCKS, blocks, candidates, normalised_sql, part_tokens, prompt_blocks, table
from fieldloom.registry import register


def _str(c, prefix):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def _graph_parts(spark, sf_dir):
    li, orders, customer = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    made = lambda df, s, sk, d, dk: df.select(s.alias("src"), F.lit(sk).alias("src_kind"), d.alias("dst"), F.lit(dk).alias("dst_kind"))
    return {
        "parent": made(customer, _str("c_custkey", "c"), "code", _str("c_nationkey", "n"), "section"), "carrier": made(li, _str("l_partkey", "p"), "code", _str("l_suppkey", "s"), "carrier"),
        "fusion": made(orders, _str("o_orderkey", "o"), "document", _str("o_custkey", "c"), "code"), "memory": made(li.filter("l_quantity = 50"), _str("l_orderkey", "o"), "document", _str("l_partkey", "p"), "code"),
    }


_EDGES = """ge AS (SELECT DISTINCT src, dst, kind, weight, sk, dk FROM (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'parent' AS kind, 0.9 AS weight, 'code' AS sk, 'section' AS dk FROM customer UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, 'carrier', 0.8, 'code', 'carrier' FROM lineitem
 UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'fusion', 0.7, 'document', 'code' FROM orders UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'memory', 0.6, 'document', 'code' FROM lineitem WHERE l_quantity = 50))"""


@register("graph_nodes", f"WITH {_EDGES} SELECT id, kind, count(*) AS degree FROM (SELECT src AS id, sk AS kind FROM ge UNION ALL SELECT dst, dk FROM ge) GROUP BY 1, 2")
def graph_nodes(spark, sf_dir):
    return S.property_graph(_graph_parts(spark, sf_dir))[0]


@register("graph_content", f"WITH {_EDGES} SELECT kind, count(*) AS n, CAST(sum(CAST(('0x' || substr(md5(src || '|' || dst || '|' || kind), 1, 8)) AS BIGINT)) AS BIGINT) AS content FROM ge GROUP BY kind")
def graph_content(spark, sf_dir):
    edges = S.property_graph(_graph_parts(spark, sf_dir))[1]
    return S.content_sum(edges.withColumn("k", F.col("kind")), ["src", "dst", "k"], ["kind"])


@register("edge_weights", f"WITH {_EDGES} SELECT src, dst, kind, CAST(weight AS DOUBLE) AS weight FROM ge")
def edge_weights(spark, sf_dir):
    return S.property_graph(_graph_parts(spark, sf_dir))[1]


HINTS = [("steel", "parent", "brass"), ("brass", "sibling", "nickel"), ("tin", "exclusive", "copper"), ("green", "parent", "blue"), ("small", "sibling", "large"), ("economy", "exclusive", "standard"), ("plated", "parent", "polished")]


@register("ontology_links", f"""WITH {PART_TOKENS}, e AS (SELECT DISTINCT p_partkey AS id, unnest(list_concat(name_tokens, type_tokens)) AS token FROM pt), h(token, kind, hint) AS (VALUES {', '.join(repr(x) for x in HINTS)}),
 l AS (SELECT DISTINCT a.id, h.kind, b.id AS other FROM e a JOIN h USING (token) JOIN e b ON b.token = h.hint WHERE a.id % 50 = 0 AND a.id <> b.id) SELECT id, kind, other FROM l UNION ALL SELECT other, 'child', id FROM l WHERE kind = 'parent'""")
def ontology_links(spark, sf_dir):
    entries = part_tokens(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.concat("name_tokens", "type_tokens").alias("tokens"))
    return S.ontology_links(entries, spark.createDataFrame(HINTS, "token string, kind string, hint string"), F.col("id") % 50 == 0)


@register("equivalence_classes", f"""WITH c AS (SELECT DISTINCT 'k' || (l_partkey % 60) AS code FROM lineitem), m AS (SELECT 'k' || i AS node, 'k' || CASE WHEN i // 4 * 4 < 10 THEN CAST(i // 4 * 4 AS VARCHAR) ELSE CAST(i // 4 * 4 AS VARCHAR) END AS root FROM range(0, 40) t(i)), g AS (SELECT root, list_sort(list(node)) AS codes FROM m GROUP BY 1)
SELECT c.code, coalesce(m.root, c.code) AS canonical, {fnv_sql("array_to_string(coalesce(g.codes, [c.code]), '|')")} AS group_id, CAST(len(coalesce(g.codes, [c.code])) AS INTEGER) AS size FROM c LEFT JOIN m ON c.code = m.node LEFT JOIN g USING (root)""")
def equivalence_classes(spark, sf_dir):
    codes = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("k"), (F.col("l_partkey") % 60).cast("string")).alias("code"))
    roots = spark.range(40).select(_str("id", "k").alias("node"), F.concat(F.lit("k"), (F.floor(F.col("id") / 4) * 4).cast("string")).alias("root"))
    return S.equivalence(codes, roots, "code")


_BUNDLES = [(f"C{k}", ns, p) for ns, p, step in (("core", 100, 1), ("carrier", 200, 3), ("regional", 300, 7)) for k in range(0, 36, step)]
_BUNDLE_SQL = "bn(code, namespace, precedence) AS (VALUES " + ", ".join(repr(b) for b in _BUNDLES) + ")"


def _bundles(spark):
    return spark.createDataFrame(_BUNDLES, "code string, namespace string, precedence int")


@register("arbitration", f"""WITH {CANDIDATES}, {_BUNDLE_SQL}, b AS (SELECT code, arg_max(namespace, precedence) AS ns, max(precedence) AS p, list(namespace) AS al FROM bn GROUP BY code)
SELECT doc, ordinal, coalesce(ns, 'core') AS namespace, array_to_string(list_sort(list_filter(coalesce(al, []), lambda v: v <> ns)), ',') AS overridden, round(coalesce(p, 0) / 300, 6) AS namespace_score FROM cand LEFT JOIN b USING (code)""")
def arbitration(spark, sf_dir):
    found = S.arbitrated(candidates(spark, sf_dir), _bundles(spark), "code", "core")
    return found.select("doc", "ordinal", "namespace", F.array_join("overridden", ",").alias("overridden"), "namespace_score")


@register("harmonisation", f"WITH {_BUNDLE_SQL}, m AS (SELECT *, (CAST(substr(code, 2) AS INTEGER) + precedence // 100) % 4 AS meaning FROM bn) SELECT a.namespace AS \"left\", b.namespace AS \"right\", count(*) AS shared, count(*) FILTER (a.meaning <> b.meaning) AS incompatible FROM m a JOIN m b ON a.code = b.code AND a.namespace < b.namespace GROUP BY 1, 2")
def harmonisation(spark, sf_dir):
    meaning = (F.substring("code", 2, 9).cast("int") + F.floor(F.col("precedence") / 100)) % 4
    return S.harmonisation(_bundles(spark).withColumn("meaning", meaning), "code", "meaning")


@register("token_lattice", f"""WITH {PART_TOKENS}, t AS (SELECT p_partkey, list_concat(name_tokens, type_tokens) AS a FROM pt), i AS (SELECT p_partkey, a, unnest(range(1, len(a) + 1)) AS k FROM t)
SELECT DISTINCT p_partkey, a[k] AS src, a[k + 1] AS dst, 'near' AS kind FROM i WHERE k < len(a) AND a[k] <> a[k + 1] UNION ALL SELECT DISTINCT p_partkey, a[k], a[k + 2], 'span' FROM i WHERE k + 2 <= len(a) AND a[k] <> a[k + 2]""")
def token_lattice(spark, sf_dir):
    items = part_tokens(spark, sf_dir).select("p_partkey", F.concat("name_tokens", "type_tokens").alias("a"))
    return S.lattice(items, "p_partkey", "a")


_ALIASES = [(f"C{k}", f"N{k % 9}", ("owner", "agent", None)[k % 3], k % 5 == 0) for k in range(30)]
_ALIAS_SQL = "al(code, node, node_role, section) AS (VALUES " + ", ".join(f"('{a}', '{n}', {'NULL' if r is None else repr(r)}, {s})" for a, n, r, s in _ALIASES) + ")"
_PROJECTED = f"""{CANDIDATES}, {_ALIAS_SQL}, p AS (SELECT doc, ordinal, cand.code, node, CASE WHEN node IS NULL THEN 'dictionary-only' WHEN doc % 4 < 2 AND node_role IS NOT NULL AND node_role <> CASE WHEN doc % 4 = 0 THEN 'owner' ELSE 'agent' END THEN 'blocked' WHEN section THEN 'section' ELSE 'canonical' END AS status FROM cand LEFT JOIN al USING (code)),
 pr AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY CASE status WHEN 'canonical' THEN 0 WHEN 'dictionary-only' THEN 1 WHEN 'section' THEN 2 ELSE 3 END, ordinal) AS INTEGER) AS place FROM p)"""


def _projected(spark, sf_dir):
    aliases = spark.createDataFrame(_ALIASES, "code string, node string, node_role string, section boolean")
    c = candidates(spark, sf_dir).withColumn("role", F.when(F.col("doc") % 4 == 0, "owner").when(F.col("doc") % 4 == 1, "agent"))
    return S.assert_chosen_first(S.projected(c, aliases, "doc", "code", "ordinal", "role"), "doc", "code", "chosen")


@register("alias_projection", f"WITH {_PROJECTED} SELECT doc, ordinal, code, status, place, place = 1 AND status <> 'blocked' AS chosen FROM pr")
def alias_projection(spark, sf_dir):
    return _projected(spark, sf_dir).select("doc", "ordinal", "code", "status", "place", "chosen")


@register("section_nodes", f"WITH {_PROJECTED} SELECT doc % 100 AS page, node, ordinal % 3 AS instance, min(ordinal) AS ordinal FROM pr WHERE node IS NOT NULL GROUP BY 1, 2, 3")
def section_nodes(spark, sf_dir):
    rows = _projected(spark, sf_dir).select((F.col("doc") % 100).alias("page"), "node", (F.col("ordinal") % 3).alias("instance"), "ordinal")
    return S.sections(rows, "page", "node", "instance", "ordinal")


@register("bundle_signatures", f"""WITH {_BUNDLE_SQL}, s AS (SELECT namespace, CAST(sum(CAST(('0x' || substr(md5(code || '|' || precedence), 1, 8)) AS BIGINT)) AS BIGINT) AS f FROM bn GROUP BY 1) SELECT namespace, f AS found, f + 1 AS stated FROM s WHERE namespace = 'carrier'""")
def bundle_signatures(spark, sf_dir):
    b = _bundles(spark)
    stated = S.content_sum(b, ["code", "precedence"], ["namespace"]).withColumn("content", F.col("content") + (F.col("namespace") == "carrier").cast("long"))
    return S.broken_signatures(b, "namespace", ["code", "precedence"], stated)


NODES = [S.AdapterNode("one", "X1", ("C3", "C4"), ("policy",), 300), S.AdapterNode("one", "X2", (), ("premium", "limit"), 300), S.AdapterNode("two", "Y1", ("C7",), ("insured",), 200)]


def _node_case(part: str) -> str:
    out = []
    for n in NODES:
        equal = f"code IN ({', '.join(map(repr, n.equals))})" if n.equals else "false"
        named = "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in n.aliases) + ")"
        to = "'Z9'" if n.code == "Y1" else (f"'{n.equals[0]}'" if n.equals else "code")
        value = {"carrier": f"'{n.carrier}'", "carrier_code": f"'{n.code}'", "mapped_code": to, "carrier_confidence": f"round(least(1.0, (CASE WHEN {equal} THEN 0.7 ELSE 0.45 END) + (CASE WHEN {named} THEN 0.2 ELSE 0 END) + {n.precedence} / 1000), 6)"}[part]
        out.append(f"WHEN {equal} OR {named} THEN {value}")
    return "CASE " + " ".join(out) + " ELSE " + {"carrier": "'carrier-default'", "carrier_code": "code", "mapped_code": "code", "carrier_confidence": "0.0"}[part] + " END AS " + part


@register("carrier_adapters", f"WITH {PROMPT_BLOCKS}, q AS (SELECT page, block, text, 'C' || (block // 100 % 40) AS code FROM pb) SELECT page, block, {', '.join(map(_node_case, ('carrier', 'carrier_code', 'mapped_code', 'carrier_confidence')))} FROM q")
def carrier_adapters(spark, sf_dir):
    b = prompt_blocks(spark, sf_dir).withColumn("code", F.concat(F.lit("C"), (F.floor(F.col("block") / 100) % 40).cast("string")))
    return S.adapted(b, "code", F.col("text"), NODES, {("two", "Y1"): "Z9"}).select("page", "block", "carrier", "carrier_code", "mapped_code", "carrier_confidence")


_AT = lambda v: f"CAST(CAST(floor({v} / 20 + 0.5) * 20 AS INTEGER) AS VARCHAR)"
_SIG = f"{_AT('x')} || ':' || {_AT('y')} || ':' || {_AT('w')} || ':' || {_AT('h')}"


@register("carrier_signals", f"WITH {PROMPT_BLOCKS}, q AS (SELECT page, block, {_SIG} AS sig, list_filter(string_split({normalised_sql('text')}, ' '), lambda t: length(t) >= 3) AS tk FROM pb), p AS (SELECT DISTINCT sig FROM q WHERE page % 10 = 0) SELECT page, block, round(least(0.1, (CASE WHEN p.sig IS NOT NULL THEN 0.04 ELSE 0 END) + (CASE WHEN list_has_any(tk, ['premium', 'policy']) THEN 0.045 ELSE 0 END)), 6) AS carrier_score FROM q LEFT JOIN p USING (sig)")
def carrier_signals(spark, sf_dir):
    b = prompt_blocks(spark, sf_dir)
    profiles = b.filter("page % 10 = 0").select(S.geometry_signature(F.col("box")).alias("signature"))
    return S.carrier_signals(b, F.col("box"), text.tokens(F.col("text")), profiles, ["premium", "policy"]).select("page", "block", "carrier_score")


@register("generalisations", f"""WITH {PROMPT_BLOCKS}, q AS (SELECT page, block, text, {_SIG} AS sig, 'C' || (block // 100 % 40) AS code FROM pb) SELECT page, block, code = 'C5' AND {rx('text', 'Number')} AS excepted,
 CASE WHEN code = 'C5' AND {rx('text', 'Number')} THEN 0.0 ELSE round(least(0.1, (CASE WHEN (code = 'C5' AND {rx('text', 'Policy|Number')}) OR (code = 'C6' AND {rx('text', '^Named')}) THEN 0.05 ELSE 0 END) + (CASE WHEN (code = 'C5' AND sig = '0:0:60:20') OR (code = 'C6' AND sig = '100:0:160:20') THEN 0.04 ELSE 0 END)), 6) END AS cluster_score FROM q""")
def generalisations(spark, sf_dir):
    b = prompt_blocks(spark, sf_dir).withColumn("code", F.concat(F.lit("C"), (F.floor(F.col("block") / 100) % 40).cast("string")))
    clusters = spark.createDataFrame([("C5", "Policy|Number", "0:0:60:20"), ("C6", "^Named", "100:0:160:20")], "code string, pattern string, signature string")
    exceptions = spark.createDataFrame([("C5", "Number")], "code string, pattern string")
    return S.generalised(b, "code", F.col("text"), S.geometry_signature(F.col("box")), clusters, exceptions).select("page", "block", "excepted", "cluster_score")


@register("best_suggestions", "WITH q AS (SELECT l_orderkey AS k, l_linenumber AS rank, CAST(l_quantity * 6 AS DOUBLE) AS score, 'P' || l_partkey AS code FROM lineitem WHERE l_suppkey % 3 = 0), b AS (SELECT k, arg_max(code, (score, code)) AS code, max(score) AS score FROM q GROUP BY 1) SELECT o_orderkey AS k, coalesce(code, 'UNKNOWN') AS code, round(CASE WHEN score IS NOT NULL THEN least(0.99, 0.5 + score / 300) ELSE 0.5 END, 6) AS confidence FROM orders LEFT JOIN b ON o_orderkey = b.k")
def best_suggestions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter("l_suppkey % 3 = 0").select(F.col("l_orderkey").alias("k"), (F.col("l_quantity") * 6).alias("score"), _str("l_partkey", "P").alias("code"))
    ranked = li.groupBy("k").agg(F.max(F.struct("score", "code")).alias("b")).select("k", "b.score", "b.code", F.lit(1).alias("rank"))
    return S.best_suggestion(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), ranked, "k")


_HASH = "(CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(regexp_extract_all(f, '(?s).'), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS BIGINT))"
_FEATURES = f"{PART_TOKENS}, ft AS (SELECT p_partkey, unnest(list_concat(name_tokens, type_tokens)) AS f FROM pt), hs AS (SELECT p_partkey, {_HASH} AS h FROM ft), sm AS (SELECT p_partkey, h % 16 AS i, CAST(sum(CASE WHEN (h >> 8) % 2 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS v FROM hs GROUP BY 1, 2)"


def _features(spark, sf_dir):
    return part_tokens(spark, sf_dir).select("p_partkey", F.concat("name_tokens", "type_tokens").alias("f"))


@register("feature_hashing", f"WITH {_FEATURES}, nm AS (SELECT p_partkey, sqrt(sum(v * v)) AS z FROM sm GROUP BY 1) SELECT p_partkey, i AS place, round(v / CASE WHEN z = 0 THEN 1 ELSE z END, 6) AS value FROM sm JOIN nm USING (p_partkey) WHERE v <> 0")
def feature_hashing(spark, sf_dir):
    found = S.hashed_features(_features(spark, sf_dir), "p_partkey", "f")
    return found.select("p_partkey", F.posexplode("vector").alias("place", "value")).filter("value <> 0").select("p_partkey", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


@register("sha_features", f"WITH {PART_TOKENS}, ft AS (SELECT p_partkey, sha256(unnest(list_concat(name_tokens, type_tokens))) AS d FROM pt) SELECT p_partkey, CAST(CAST(('0x' || substr(d, 1, 8)) AS BIGINT) % 64 AS INTEGER) AS place, CAST(sum(CASE WHEN CAST(('0x' || substr(d, 9, 2)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS value FROM ft GROUP BY 1, 2 HAVING sum(CASE WHEN CAST(('0x' || substr(d, 9, 2)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) <> 0")
def sha_features(spark, sf_dir):
    return S.sha_features(_features(spark, sf_dir), "p_partkey", "f")


_UNIT = tuple([0.25] * 16)
PROTOTYPES = [S.Prototype("steel-form", ("steel", "nickel"), ("Brand#1",), _UNIT), S.Prototype("tin-form", ("tin", "copper"), ("Brand#2", "Brand#3"), ()), S.Prototype("brass-form", ("brass",), ("Brand#4",), _UNIT)]


def _proto_sql(p: S.Prototype) -> str:
    parts = [f"(CASE WHEN contains(lower(v), '{w}') THEN 0.16 ELSE 0 END)::DOUBLE" for w in p.keywords] + [f"(CASE WHEN starts_with(lower(b), '{x.lower()}') THEN 0.08 ELSE 0 END)::DOUBLE" for x in p.prefixes]
    parts += ["greatest(0.0, coalesce(dt, 0.0)) * 0.35" if p.vector else "0.0", f"(CASE WHEN contains(lower(b), '{p.family.replace('-', ' ')}') THEN 0.25 ELSE 0 END)"]
    return f"[-round(least(1.0, {' + '.join(parts)}), 6)]"


@register("family_classes", f"""WITH {_FEATURES}, nm AS (SELECT p_partkey, sqrt(sum(v * v)) AS z, sum(v) AS t FROM sm GROUP BY 1), q AS (SELECT p_partkey, p_name || ' ' || p_type AS v, p_brand AS b, CASE WHEN z > 0 THEN t / z * 0.25 END AS dt FROM part LEFT JOIN nm USING (p_partkey)),
 s AS (SELECT p_partkey, unnest([{', '.join(f"{{'s': {_proto_sql(p)}[1], 'f': '{p.family}'}}" for p in PROTOTYPES)}]) AS x FROM q), m AS (SELECT p_partkey, min(x) AS x FROM s GROUP BY 1) SELECT p_partkey, CASE WHEN -x.s >= 0.2 THEN x.f ELSE 'unclassified' END AS family, round(abs(x.s), 4) AS family_score FROM m""")
def family_classes(spark, sf_dir):
    vectors = S.hashed_features(_features(spark, sf_dir), "p_partkey", "f")
    part = table(spark, sf_dir, "part").join(vectors, "p_partkey")
    found = S.classified(part, F.concat_ws(" ", "p_name", "p_type"), F.array("p_brand"), F.col("p_brand"), F.col("vector"), PROTOTYPES)
    return found.select("p_partkey", "family", F.round(F.abs("family_score"), 4).alias("family_score"))


_WEIGHTS = [("insured", "owner", 0.6), ("named", "owner", 0.3), ("agent", "agent", 0.7), ("producer", "agent", 0.7), ("policy", "policy", 0.5), ("premium", "policy", 0.4)]
_CENTRES = [("owner", 100.0, 100.0, 80.0, 80.0), ("agent", 400.0, 200.0, 80.0, 80.0), ("policy", 500.0, 700.0, 120.0, 120.0)]


@register("role_scores", f"""WITH {PROMPT_BLOCKS}, b AS (SELECT page * 100000 + block % 99991 AS k, min(text) AS text, min(x) AS x, min(y) AS y FROM pb GROUP BY 1), w(token, role, weight) AS (VALUES {', '.join(map(repr, _WEIGHTS))}), c(role, cx, cy, sx, sy) AS (VALUES {', '.join(map(repr, _CENTRES))}),
 t AS (SELECT k, unnest(string_split({normalised_sql('text')}, ' ')) AS token FROM b), s AS (SELECT k, role, sum(weight) AS ts FROM t JOIN w USING (token) GROUP BY 1, 2),
 g AS (SELECT k, c.role, round(coalesce(ts, 0.0) * 0.7 + greatest(0.0, 1 - sqrt(power((x - cx) / sx, 2) + power((y - cy) / sy, 2))) * 0.3, 6) AS sc FROM b CROSS JOIN c LEFT JOIN s USING (k, role)), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sc DESC, role) AS rn FROM g)
SELECT k, CASE WHEN sc >= 0.08 THEN role END AS role FROM r WHERE rn = 1""")
def role_scores(spark, sf_dir):
    b = prompt_blocks(spark, sf_dir).withColumn("k", F.col("page") * 100000 + F.col("block") % 99991).groupBy("k").agg(F.min("text").alias("text"), F.struct(F.min("box.x").alias("x"), F.min("box.y").alias("y")).alias("box"))
    b = b.withColumn("tokens", F.split(text.normalise(F.col("text")), " "))
    weights = spark.createDataFrame(_WEIGHTS, "token string, role string, weight double")
    return S.role_scores(b, "k", "tokens", "box", weights, spark.createDataFrame(_CENTRES, "role string, cx double, cy double, sx double, sy double"))


@register("pair_scores", """WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 4 <> 0 THEN l_quantity / 50 END AS a, CASE WHEN l_suppkey % 3 <> 0 THEN CAST(l_suppkey % 2 AS DOUBLE) END AS b, CASE WHEN l_partkey % 5 <> 0 THEN l_tax * 12.5 END AS c, CASE WHEN l_orderkey % 10 = 0 THEN 0.2 END AS p FROM lineitem),
 r AS (SELECT *, (CASE WHEN a IS NOT NULL THEN 0.45 ELSE 0 END) + (CASE WHEN b IS NOT NULL THEN 0.35 ELSE 0 END) + (CASE WHEN c IS NOT NULL THEN 0.2 ELSE 0 END) AS t FROM q)
SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(0, least(1, CASE WHEN t > 0 THEN (coalesce(a, 0) * 0.45 + coalesce(b, 0) * 0.35 + coalesce(c, 0) * 0.2) / t ELSE 0 END + (CASE WHEN a >= 0.9 AND b = 1 THEN 0.05 ELSE 0 END) - coalesce(p, 0))) + 0.000001, 3) AS score FROM r""")
def pair_scores(spark, sf_dir):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    s = S.pair_score(F.when(part % 4 != 0, F.col("l_quantity") / 50), F.when(supp % 3 != 0, (supp % 2).cast("double")), F.when(part % 5 != 0, F.col("l_tax") * 12.5), F.when(F.col("l_orderkey") % 10 == 0, 0.2))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(s + 0.000001, 3).alias("score"))


_CONF = "cf0 AS (SELECT o_orderkey AS id, 'g' || (o_custkey % 200) AS \"group\", ['code', 'type', 'value', 'other'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS class FROM orders WHERE o_orderkey % 2 = 0), me AS (SELECT 'g' || i AS \"group\", CAST(i % 15 AS DOUBLE) AS recurrence, (i % 10) / 9.0::DOUBLE AS stability FROM range(0, 150) t(i)), pc AS (SELECT id, \"group\", class, coalesce(recurrence, 0.0) AS recurrence, round((CASE class WHEN 'code' THEN 1.0 WHEN 'type' THEN 0.8 WHEN 'value' THEN 0.6 ELSE 0.4 END) * 0.6 + least(1.0, coalesce(recurrence, 0) / 10) * 0.4, 6) AS severity FROM cf0 LEFT JOIN me USING (\"group\"))"


def _conflicts(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("code", "type", "value", "other")))
    conflicts = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("g"), (F.col("o_custkey") % 200).cast("string")).alias("group"), F.element_at(kinds, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("class"))
    memory = spark.range(150).select(_str("id", "g").alias("group"), (F.col("id") % 15).cast("double").alias("recurrence"), ((F.col("id") % 10) / 9.0).alias("stability"))
    return S.prioritised(conflicts, memory.select("group", "recurrence")), memory


@register("conflict_priority", f"WITH {_CONF} SELECT id, \"group\", severity, CASE WHEN severity >= 0.75 THEN 'high' WHEN severity >= 0.45 THEN 'medium' ELSE 'low' END AS priority FROM pc")
def conflict_priority(spark, sf_dir):
    return _conflicts(spark, sf_dir)[0].select("id", "group", "severity", "priority")


@register("memory_recommendations", f"""WITH {_CONF}, w AS (SELECT "group", max(severity) AS severity FROM pc GROUP BY 1), p AS (SELECT 'g' || c_custkey AS "group", c_mktsegment AS code, (c_custkey % 20) / 19.0::DOUBLE AS fused FROM customer),
 r AS (SELECT "group", code, coalesce(severity, 0) AS s, round(greatest(0, least(1, fused * 0.65 + coalesce(stability, 0) * 0.35 - coalesce(severity, 0) * 0.2)), 6) AS confidence FROM p LEFT JOIN me USING ("group") LEFT JOIN w USING ("group"))
SELECT "group", code, round(confidence, 4) AS confidence, CASE WHEN confidence < 0.55 OR s >= 0.7 THEN 'high' WHEN confidence < 0.75 OR s >= 0.45 THEN 'medium' ELSE 'low' END AS priority FROM r""")
def memory_recommendations(spark, sf_dir):
    conflicts, memory = _conflicts(spark, sf_dir)
    profiles = table(spark, sf_dir, "customer").select(_str("c_custkey", "g").alias("group"), F.col("c_mktsegment").alias("code"), ((F.col("c_custkey") % 20) / 19.0).alias("fused"))
    return S.recommended(profiles, memory, conflicts).select("group", "code", F.round("confidence", 4).alias("confidence"), "priority")


@register("conflict_resolution", f"""WITH {CANDIDATES}, k AS (SELECT doc, code, round(conf * 0.72 + (ordinal % 4) / 3.0 * 0.12 + sim * 0.08 + (ordinal % 3 - 1) * 0.1 * 0.08 - CASE WHEN ordinal % 7 = 0 THEN 0.2 ELSE 0 END, 6) AS score FROM cand), b AS (SELECT doc, code, score, row_number() OVER (PARTITION BY doc ORDER BY score DESC, code) AS rn FROM k WHERE doc % 9 <> 0)
SELECT o_orderkey AS conflict, CASE WHEN o_orderkey % 8 = 0 THEN 'FORCED' ELSE code END AS code, round(CASE WHEN o_orderkey % 8 = 0 THEN 1.0 ELSE score END, 4) AS score, CASE WHEN o_orderkey % 8 = 0 THEN 'reviewer-override' WHEN code IS NOT NULL THEN 'best-score' ELSE 'unresolved' END AS reason FROM orders LEFT JOIN b ON o_orderkey = doc AND rn = 1""")
def conflict_resolution(spark, sf_dir):
    c = candidates(spark, sf_dir).filter("doc % 9 <> 0").select(F.col("doc").alias("block"), "code", F.col("conf").alias("base"), ((F.col("ordinal") % 4) / 3.0).alias("namespace_score"), F.col("sim").alias("graph"), ((F.col("ordinal") % 3 - 1) * 0.1).alias("rule_delta"), (F.col("ordinal") % 7 == 0).alias("hard"))
    conflicts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("conflict"), F.array("o_orderkey").alias("blocks"))
    forced = conflicts.filter("conflict % 8 = 0").select("conflict", F.lit("FORCED").alias("forced"), F.lit(1).alias("ordinal"))
    return S.resolved(conflicts, c, forced.unionByName(forced.select("conflict", F.lit("LATE").alias("forced"), F.lit(2).alias("ordinal")))).select("conflict", "code", F.round("score", 4).alias("score"), "reason")


@register("mapping_rationale", f"WITH {CANDIDATES}, r AS (SELECT doc, list(code || '=' || printf('%.3f', conf) ORDER BY conf DESC, code) AS c, list_reverse_sort(list(conf)) AS l, list_sort(list_distinct(list(family))) AS e FROM cand GROUP BY doc) SELECT doc, array_to_string(c, ' ') AS candidates, len(l) > 1 AND round(l[1] - l[2], 9) <= 0.05 AS ambiguous, array_to_string(e, ',') AS evidence FROM r")
def mapping_rationale(spark, sf_dir):
    c = candidates(spark, sf_dir).select("doc", "code", F.col("conf").alias("confidence"), F.col("family").alias("source"))
    return S.rationale(c, ["doc"]).select("doc", F.array_join("candidates", " ").alias("candidates"), "ambiguous", F.array_join("evidence", ",").alias("evidence"))


@register("decision_replay", "SELECT 'g' || c_custkey AS \"group\", coalesce((SELECT 'P' || max(o_orderkey) FROM orders WHERE o_custkey = c_custkey), c_mktsegment) AS code, 'start' || coalesce((SELECT ',' || string_agg(o_orderkey || ':P' || o_orderkey, ',' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') AS lineage FROM customer")
def decision_replay(spark, sf_dir):
    snapshot = table(spark, sf_dir, "customer").select(_str("c_custkey", "g").alias("group"), F.col("c_mktsegment").alias("code"), F.array(F.lit("start")).alias("lineage"))
    decisions = table(spark, sf_dir, "orders").select(_str("o_custkey", "g").alias("group"), F.col("o_orderkey").alias("id"), _str("o_orderkey", "P").alias("pinned"))
    return S.replayed(snapshot, decisions).select("group", "code", F.array_join("lineage", ",").alias("lineage"))


@register("snapshot_versions", f"WITH {CANDIDATES}, n AS (SELECT family, count(*) AS n, CAST(sum(CAST(('0x' || substr(md5(code || '|' || doc), 1, 8)) AS BIGINT)) AS BIGINT) AS content FROM cand GROUP BY 1) SELECT family, n, content, CASE family WHEN 'A' THEN 3 WHEN 'N' THEN 6 ELSE 1 END AS version FROM n")
def snapshot_versions(spark, sf_dir):
    c = candidates(spark, sf_dir)
    before = S.content_sum(c, ["code", "doc"], ["family"]).filter("family in ('A', 'N')").select("family", (F.col("content") + (F.col("family") == "N").cast("long")).alias("content"), F.when(F.col("family") == "A", 3).otherwise(5).alias("version"))
    return S.snapshot_version(c, ["code", "doc"], ["family"], before)


@register("idempotent_requests", """WITH r AS (SELECT event_id AS ordinal, user_id AS k, event_type AS d, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
 q AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'click' WHEN rn > 1 THEN f END AS before FROM r)
SELECT ordinal, k, CASE WHEN before IS NULL THEN 'fresh' WHEN before = d THEN 'replay' ELSE 'conflict' END AS outcome, CASE WHEN before = d AND k % 3 = 0 THEN 'answer' || k END AS response FROM q""")
def idempotent_requests(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    requests = events.select(F.col("event_id").alias("ordinal"), F.col("user_id").alias("k"), F.col("event_type").alias("d"))
    stored = requests.filter("k % 3 = 0").select("k").distinct().select("k", F.lit("click").alias("d"), _str("k", "answer").alias("response"))
    return S.idempotent(requests, stored, "k", "d").select("ordinal", "k", "outcome", "response")


@register("submission_steps", """WITH s AS (SELECT o_orderkey AS id, o_orderkey % 7 <> 0 AS ready, o_orderkey % 5 <> 0 AS open, o_custkey % 6 AS attempts, o_orderdate AS moment, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS ok FROM orders), t AS (SELECT *, attempts + CASE WHEN ok IS NOT NULL AND ready AND open THEN 1 ELSE 0 END AS tried FROM s),
 u AS (SELECT *, CASE WHEN NOT ready THEN 'blocked' WHEN NOT open THEN 'held' WHEN ok IS NULL THEN 'sent' WHEN ok THEN 'accepted' WHEN tried >= 5 THEN 'dead' ELSE 'retry' END AS status FROM t) SELECT id, status, tried AS attempts, CAST(CASE WHEN status = 'retry' THEN floor(epoch(moment)) + 30 ELSE -1 END AS BIGINT) AS due_s FROM u WHERE id < 100000000""")
def submission_steps(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    submissions = o.select(key.alias("id"), (key % 7 != 0).alias("ready"), (key % 5 != 0).alias("open"), (F.col("o_custkey") % 6).alias("attempts"), F.col("o_orderdate").alias("at"))
    answers = o.filter(key % 3 != 0).select(key.alias("id"), (key % 2 == 0).alias("ok"))
    return S.submission_step(submissions, answers).select("id", "status", "attempts", F.coalesce(F.unix_timestamp("due"), F.lit(-1)).alias("due_s"))


@register("edit_log", "WITH e AS (SELECT user_id AS k, event_id AS o, event_type AS v, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events), c AS (SELECT * FROM e WHERE rn = 1 OR b IS DISTINCT FROM v) SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY o) AS INTEGER) AS step, b AS before, v AS after FROM c")
def edit_log(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("o"), F.col("event_type").alias("v"))
    return S.edit_log(e, "k", "v", "o")


@register("cluster_check", """WITH x AS (SELECT label, vec_id % 2 AS half, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL), m AS (SELECT label, half, list(v ORDER BY i) AS c FROM (SELECT label, half, i, avg(v) AS v FROM x GROUP BY ALL) GROUP BY ALL),
 s AS (SELECT a.label, b.label AS nearest, round(list_cosine_similarity(a.c, b.c), 6) AS similarity FROM m a, m b WHERE a.half = 1 AND b.half = 0) SELECT label, nearest, round(similarity, 4) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, nearest) AS rn FROM s) WHERE rn = 1""")
def cluster_check(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").filter("embedding is not null and label is not null").select(F.col("vec_id").alias("key"), "label", "embedding")
    return S.cluster_faults(rows, "label", "embedding").select("label", "nearest", F.round("similarity", 4).alias("similarity"))


@register("geometry_signatures", f"WITH {BLOCKS} SELECT page, block, {_SIG} AS signature FROM blk")
def geometry_signatures(spark, sf_dir):
    return blocks(spark, sf_dir).select("page", "block", S.geometry_signature(F.col("box")).alias("signature"))
