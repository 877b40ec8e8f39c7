"""Registered sources and sinks: files are written from the tables into the shared folder, read back, and compared as rows."""

from __future__ import annotations

import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from fieldloom.operators.aggregates import fusion
from fieldloom.plans.tables import CANDIDATES, candidates, normalised_sql, table
from fieldloom.registry import register
from fieldloom.sources import readers, sinks
from fieldloom.storage import fresh_path


def _json(df, name):
    path = fresh_path(df.sparkSession, name)
    df.write.json(path)
    return path


@register("taxonomy_categories", f"WITH t AS (SELECT n_name AS label, 'R' || n_regionkey AS category, {normalised_sql('n_name')} AS nn FROM nation) SELECT n_nationkey, x.label, coalesce(t.category, (SELECT min(category) FROM t WHERE nn = {normalised_sql('x.label')})) AS category FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '-' || lower(n_name) || '!' WHEN n_nationkey % 3 = 1 THEN n_name ELSE 'none' END AS label FROM nation) x LEFT JOIN t ON t.label = x.label")
def taxonomy_categories(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    path = _json(nation.select(F.col("n_name").alias("eLabelName"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("category")), "taxonomy")
    known = readers.optional_json(spark, path, "eLabelName string, category string", False).select(F.col("eLabelName").alias("label"), "category")
    known = known.unionByName(readers.taxonomy_json(spark, f"{path}-missing"))
    key = F.col("n_nationkey") % 3
    asked = nation.select("n_nationkey", F.when(key == 0, F.concat(F.lit("-"), F.lower("n_name"), F.lit("!"))).when(key == 1, F.col("n_name")).otherwise("none").alias("label"))
    return readers.with_category(asked, known, "label").select("n_nationkey", "label", "category")


@register("supervision_rules", "WITH s AS (SELECT 's' || (s_suppkey % 7) AS family, s_suppkey, 'K' || (s_suppkey % 5) AS a, 'K' || (s_suppkey % 3 + 10) AS b, 'p' || (s_suppkey % 4) AS p, (s_suppkey % 10) / 10.0::DOUBLE AS w FROM supplier), r AS (SELECT unnest([a, b]) AS code, unnest([[p, 'q'], [p, 'q']]) AS ps, family, w FROM s), f AS (SELECT code, unnest(ps) AS pattern, family, w FROM r UNION ALL SELECT 'K1', 'built', NULL, 0.7) SELECT code, pattern, family, max(w) AS weight FROM f GROUP BY 1, 2, 3")
def supervision_rules(spark, sf_dir):
    s = F.col("s_suppkey")
    name = lambda prefix, v: F.concat(F.lit(prefix), v.cast("string"))
    entry = F.struct(F.array(name("K", s % 5), name("K", s % 3 + 10)).alias("codes"), F.array(name("p", s % 4), F.lit("q")).alias("patterns"), ((s % 10) / 10.0).alias("weight"))
    forms = table(spark, sf_dir, "supplier").select(F.array(F.struct(name("s", s % 7).alias("family"), F.array(entry).alias("entries"))).alias("forms"))
    path = fresh_path(spark, "rules")
    forms.write.json(path)
    flat = readers.supervision_rules(spark, [path, f"{path}-missing"], [("K1", "built", 0.7, None)], multi_line=False)
    return flat


@register("model_bundle", "SELECT * FROM (VALUES ('consistency', false, NULL), ('geometry', false, NULL), ('roles', true, '{\"roles\":5}')) t(model, present, payload)")
def model_bundle(spark, sf_dir):
    folder = fresh_path(spark, "models")
    regions = table(spark, sf_dir, "region").agg(F.count("*").alias("roles")).select(F.to_json(F.struct("roles")).alias("value"))
    regions.coalesce(1).write.text(f"{folder}/roles.json")
    return readers.model_bundle(spark, folder, ["roles", "geometry", "consistency"])


@register("keyed_store", "SELECT 'R' AS flag, o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 2 UNION ALL SELECT 'N', o_orderkey, 'new' FROM orders WHERE o_orderkey % 3 = 1")
def keyed_store(spark, sf_dir):
    path = fresh_path(spark, "keyed")
    k = F.col("o_orderkey") % 3
    rows = table(spark, sf_dir, "orders").select(F.when(k == 0, "A").when(k == 1, "N").otherwise("R").alias("flag"), "o_orderkey", "o_orderstatus")
    sinks.write_keyed(rows, path, "flag")
    sinks.write_keyed(rows.filter("flag = 'N'").withColumn("o_orderstatus", F.lit("new")), path, "flag")
    names = ["flag", "o_orderkey", "o_orderstatus"]
    return readers.read_keyed(spark, path, "flag", "R").select(*names).unionByName(readers.read_keyed(spark, path, "flag", "N").select(*names))


@register("replay_batches", "WITH f AS (SELECT 'f' || n_regionkey AS fixture, count(*) AS n FROM nation GROUP BY 1) SELECT fixture, n AS baseline_rows, CASE WHEN fixture = 'f0' THEN 0 ELSE n END AS replay_rows FROM f")
def replay_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("f"), F.col("n_regionkey").cast("string")).alias("fixture"), "n_name")
    a, b = fresh_path(spark, "baseline"), fresh_path(spark, "replay")
    rows.write.partitionBy("fixture").json(a)
    rows.filter("fixture <> 'f0'").write.partitionBy("fixture").json(b)
    return readers.replay_batches(spark, a, b, "n_name string")


_FORM = """concat('<form><page><label>', n_name, ' date</label><help>Please say "are you sure?" or "why so early?"</help><field sid="F', n_nationkey, '" x="1" y="2" width="30" height="4"/><check sid="C', n_nationkey, '" x="5" y="6"/></page><page><label>Total amount</label><field sid="G', n_nationkey, '" x="1" y="9"/></page></form>')"""


def _forms(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumn("xml", F.expr(_FORM))
    content = F.when(F.col("n_nationkey") == 3, "<form><page>").otherwise(F.col("xml"))
    plain = nation.select(F.col("n_name").alias("form_id"), content.alias("content"))
    packed = "application/x; content-encoding=base64-gzip\n" + base64.b64encode(gzip.compress(b'<form><page><label>Zip</label><radio sid="R1" x="1" y="1"/></page></form>', mtime=0)).decode()
    return plain.unionByName(spark.createDataFrame([("packed", packed), ("nothing", None)], "form_id string, content string"))


_FORM_SQL = """fm AS (SELECT n_name AS form_id, 'F' || n_nationkey AS sid, 1 AS page, 1 AS place, 'field' AS tag, n_name || ' date' AS label, 'date' AS value_type, 'are you sure?' AS question, 1.0 AS x FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT n_name, 'C' || n_nationkey, 1, 2, 'check', n_name || ' date', 'boolean', 'are you sure?', 5.0 FROM nation WHERE n_nationkey <> 3
 UNION ALL SELECT n_name, 'G' || n_nationkey, 2, 1, 'field', 'Total amount', 'currency', NULL, 1.0 FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'packed', 'R1', 1, 1, 'radio', 'Zip', 'boolean', NULL, 1.0)"""


@register("form_controls", f"WITH {_FORM_SQL} SELECT form_id, sid, page, place, tag, label, value_type, question, CAST(x AS DOUBLE) AS x, 'page' || page || '/' || tag || '[' || place || ']' AS path FROM fm")
def form_controls(spark, sf_dir):
    found = readers.semantic_fields(readers.form_fields(_forms(spark, sf_dir)))
    return found.select("form_id", "sid", "page", "place", "tag", "label", "value_type", "question", "x", "path")


@register("form_truth", f"WITH {_FORM_SQL}, g AS (SELECT form_id, max(page) AS pages, count(*) AS fields, count(DISTINCT label) AS labels, string_agg(sid, ',' ORDER BY page, place) AS sids, '' AS faults FROM fm GROUP BY 1) SELECT form_id, CAST(pages AS INTEGER) AS pages, fields, CAST(labels AS INTEGER) AS labels, sids, faults FROM g UNION ALL SELECT n_name, 0, 0, 0, '', 'ParseError' FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'nothing', 0, 0, 0, '', 'ParseError'")
def form_truth(spark, sf_dir):
    found = readers.ground_truth(readers.form_fields(_forms(spark, sf_dir)))
    return found.select("form_id", "pages", "fields", "labels", F.array_join(F.transform("entries", lambda e: e["sid"]), ",").alias("sids"), F.array_join("faults", ",").alias("faults"))


@register("form_choice", """WITH d AS (SELECT p_partkey AS doc, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 20 ELSE -1 END AS number, p_name AS name FROM part), f AS (SELECT p_partkey AS form, p_partkey AS number, p_type AS name FROM part),
 tk AS (SELECT doc, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda v: length(v) >= 2)) AS a FROM d), fk AS (SELECT form, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda v: length(v) >= 2)) AS b FROM f),
 n AS (SELECT d.doc, f.form FROM d JOIN f ON d.number = f.number), s AS (SELECT doc, form, round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS s FROM tk JOIN fk ON list_has_any(a, b) WHERE doc NOT IN (SELECT doc FROM n)), b AS (SELECT doc, form, row_number() OVER (PARTITION BY doc ORDER BY s DESC, form) AS rn FROM s WHERE s >= 0.4)
SELECT d.doc, coalesce(n.form, b.form, -1) AS form, CASE WHEN n.form IS NOT NULL THEN 'number' WHEN b.form IS NOT NULL THEN 'name' END AS by FROM d LEFT JOIN n ON d.doc = n.doc LEFT JOIN b ON d.doc = b.doc AND b.rn = 1""")
def form_choice(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    documents = part.select(key.alias("doc"), F.when(key % 3 == 0, key % 20).otherwise(-1).alias("number"), F.col("p_name").alias("name"))
    forms = part.select(key.alias("form"), key.alias("number"), F.col("p_type").alias("name"))
    return readers.choose_form(documents, forms, 0.4).select("doc", F.coalesce("form", F.lit(-1)).alias("form"), "by")


@register("artefact_rows", "SELECT 'node' AS kind, 'n' || r_regionkey AS id, NULL AS other, r_name AS role FROM region UNION ALL SELECT 'alias', 'n' || r_regionkey, lower(r_name), r_name FROM region UNION ALL SELECT 'edge', 'n' || r_regionkey, 'root', 'part' FROM region")
def artefact_rows(spark, sf_dir):
    regions = sorted(tuple(r) for r in table(spark, sf_dir, "region").collect())  # five rows: an artefact is one small file
    payload = {"nodes": [{"id": f"n{k}", "role": name, "aliases": [name.lower()]} for k, name in regions], "edges": [{"from": f"n{k}", "to": "root", "type": "part"} for k, _ in regions]}
    text = readers.canonical_json(payload)
    path = fresh_path(spark, "artefact")
    spark.createDataFrame([(readers.canonical_json({"payload": payload, "hash": hashlib.sha256(text.encode()).hexdigest()}),)], "value string").coalesce(1).write.text(path)
    return readers.artefact_rows(spark.read.text(path, wholetext=True).select(F.trim("value").alias("content")))


@register("page_lines", "WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_suppkey, round((l_partkey % 700) / 97.0 * 96, 4) AS x, round((l_suppkey % 90) / 13.0 * 96, 4) AS y, 'w' || l_partkey AS content FROM lineitem) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY y, x, content) AS INTEGER) AS place, content, round(x, 2) AS x, round(y, 2) AS y FROM l")
def page_lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    at = lambda dx, dy: F.struct((F.col("l_partkey") % 700 / 97.0 + dx).alias("x"), (F.col("l_suppkey") % 90 / 13.0 + dy).alias("y"))
    line = F.struct(F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("content"), F.array(at(0.0, 0.0), at(1.0, 0.5)).alias("polygon"))
    pages = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(line).alias("lines")).withColumns({"pageNumber": F.lit(1), "unit": F.lit("inch"), "selectionMarks": F.array().cast("array<struct<state:string,polygon:array<struct<x:double,y:double>>>>")})
    return readers.layout_lines(pages).select("doc_id", "place", "content", F.round("box.x", 2).alias("x"), F.round("box.y", 2).alias("y"))


@register("xml_elements", "SELECT n_nationkey, k AS \"at\", CASE k WHEN 0 THEN 'Name' ELSE 'Amount' END AS tag, CASE k WHEN 0 THEN 'n' || n_nationkey ELSE 'USD' END AS attribute, CASE k WHEN 0 THEN n_name || ' & co' ELSE CAST(n_regionkey AS VARCHAR) END AS value FROM nation, (VALUES (0), (1)) t(k)")
def xml_elements(spark, sf_dir):
    xml = F.expr("""concat('<All><Name id="n', n_nationkey, '">', n_name, ' &amp; co</Name><Amount unit="USD" x="1">', n_regionkey, '</Amount></All>')""")
    found = readers.elements(table(spark, sf_dir, "nation").withColumn("xml", xml), "n_nationkey", "xml")
    return found.select("n_nationkey", "at", "tag", F.coalesce(F.col("attributes")["id"], F.col("attributes")["unit"]).alias("attribute"), "value")


# --- sinks ---------------------------------------------------------------------------------------

_CODES = "['Full Name', 'Full Name 2', 'Amount', 'Full-Name', '', NULL, 'Amount']"
_NAMES = f"c0 AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS o, {_CODES}[CAST((l_linenumber + l_partkey) % 7 + 1 AS INTEGER)] AS code, CASE WHEN l_partkey % 2 = 0 THEN 'number' ELSE 'string' END AS kind FROM lineitem)"


def _named(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    order = F.row_number().over(sinks.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    code = F.element_at(F.array(*map(F.lit, ["Full Name", "Full Name 2", "Amount", "Full-Name", "", None, "Amount"])), ((F.col("l_linenumber") + F.col("l_partkey")) % 7 + 1).cast("int"))
    return li.select(F.col("l_orderkey").alias("doc"), order.alias("o"), code.alias("code"), F.when(F.col("l_partkey") % 2 == 0, "number").otherwise("string").alias("kind"))


_UNIQUE = f"""{_NAMES}, b0 AS (SELECT *, trim(regexp_replace(lower(code), '[^a-z0-9]+', '_', 'g'), '_') AS base FROM c0 WHERE trim(coalesce(code, '')) <> ''), n0 AS (SELECT *, row_number() OVER (PARTITION BY doc, base ORDER BY o) AS n, list_contains(list(base) OVER (PARTITION BY doc), base || '_2') AS clash FROM b0),
 un AS (SELECT doc, o, code, kind, CASE WHEN n = 1 THEN base WHEN clash THEN base || '_' || (n + 1) ELSE base || '_' || n END AS name FROM n0)"""


@register("unique_names", f"WITH {_UNIQUE} SELECT doc, o, code, name FROM un")
def unique_names(spark, sf_dir):
    return sinks.unique_names(_named(spark, sf_dir), "doc", ["o"], "code").select("doc", "o", "code", "name")


@register("ui_schemas", f"""WITH {_UNIQUE} SELECT doc, '{{"type":"VerticalLayout","elements":[' || string_agg('{{"scope":"#/properties/' || name || '","widget":"' || CASE kind WHEN 'number' THEN 'number' ELSE 'text' END || '"}}', ',' ORDER BY o) || ']}}' AS ui FROM un GROUP BY doc""")
def ui_schemas(spark, sf_dir):
    return sinks.to_ui_schema(_named(spark, sf_dir), "doc", ["o"], "code", "kind")


@register("unified_exports", f"""WITH {CANDIDATES}, p AS (SELECT 'g' || (ordinal % 9) AS "group", arg_min(code, (doc, ordinal)) AS code, array_to_string(list_sort(list_distinct(list(family))), ',') AS families, floor(round(avg(conf), 6) * 1000 + 0.5001) / 1000 AS confidence FROM cand GROUP BY 1)
SELECT "group", '<' || code || ' group="' || "group" || '" families="' || families || '"/>' AS xml, '{{"code":"' || code || '","families":["' || replace(families, ',', '","') || '"],"confidence":' || CAST(confidence AS VARCHAR) || '}}' AS schema FROM p""")
def unified_exports(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("group", F.concat(F.lit("g"), (F.col("ordinal") % 9).cast("string")))
    profiles = fusion(c, "group", "doc", "family", "code", ["conf"], ["doc", "ordinal"]).select("group", F.col("canonical").alias("code"), "families", (F.floor(F.col("conf") * 1000 + 0.5001) / 1000).alias("confidence"))
    return sinks.unified_exports(profiles)


@register("carrier_payloads", f"""WITH {CANDIDATES}, p AS (SELECT doc, '{{"carrier":"one","fields":[' || string_agg('{{"code":"' || code || '","value":"' || CAST(CAST(quantity AS BIGINT) AS VARCHAR) || '"}}', ',' ORDER BY ordinal) || ']}}' AS json, '<Submission>' || string_agg('<' || code || '>' || CAST(CAST(quantity AS BIGINT) AS VARCHAR) || '</' || code || '>', '' ORDER BY ordinal) || '</Submission>' AS xml FROM cand GROUP BY 1)
SELECT doc, sha256(json) AS json_sha256, sha256(xml) AS xml_sha256 FROM p""")
def carrier_payloads(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("value", F.col("quantity").cast("long"))
    return sinks.carrier_payloads(c, "doc", ["ordinal"], "code", "value", "one").select("doc", "json_sha256", "xml_sha256")


@register("merged_reports", "SELECT s_suppkey AS form, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 2 ELSE s_suppkey END AS errors FROM supplier")
def merged_reports(spark, sf_dir):
    before = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("form"), F.col("s_suppkey").alias("errors"))
    fresh = before.filter("form % 2 = 0").withColumn("errors", F.col("errors") * 2)
    return sinks.merged_reports(sinks.merged_reports(before, fresh, "form"), fresh, "form")


@register("snapshot_manifest", "SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey END AS previous, CASE WHEN c_custkey % 7 = 0 AND c_custkey % 5 <> 0 THEN 0 ELSE c_custkey * 2 END AS current, CASE WHEN c_custkey % 7 = 0 AND c_custkey % 5 <> 0 THEN 0 ELSE c_custkey * 2 END - CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey END AS delta, CASE WHEN NOT (c_custkey % 7 = 0 AND c_custkey % 5 <> 0) THEN sha256(c_name) END AS sha256 FROM customer")
def snapshot_manifest(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("v"), F.col("c_name").alias("t"))
    now = c.filter("not (k % 7 = 0 and k % 5 <> 0)").withColumn("v", F.col("v") * 2)
    return sinks.manifest(c.filter("k % 5 <> 0"), now, "k", "v", "t")


@register("profile_upserts", "SELECT 'f' || n_nationkey AS family, CASE WHEN n_nationkey % 2 = 0 THEN 'a,z' ELSE 'b,c' END AS codes, CASE WHEN n_nationkey % 2 = 0 THEN CASE WHEN n_nationkey % 3 = 0 THEN 5 ELSE 1 END ELSE 4 END AS version FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 2 = 0")
def profile_upserts(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    name = F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("family")
    before = nation.filter("n_nationkey % 3 = 0").select(name, F.array(F.lit("c"), F.lit("b")).alias("codes"), F.lit(4).alias("version"))
    changes = nation.filter("n_nationkey % 2 = 0").select(name, F.array(F.lit("z"), F.lit("a")).alias("codes"))
    return sinks.upsert_profiles(before, changes, "family")[0].select("family", F.array_join("codes", ",").alias("codes"), "version")


@register("audit_log", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_id)), ',') AS ids FROM events GROUP BY 1")
def audit_log(spark, sf_dir):
    path = fresh_path(spark, "audit")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    for batch in (events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1"), events.filter("event_id % 10 = 0")):
        sinks.append_audit(batch, path, "event_id", "ts")
    held = spark.read.parquet(path).dropDuplicates(["event_id", "digest"])
    return sinks.audit_index(held, "user_id", "event_id").select("user_id", F.array_join("ids", ",").alias("ids"))




@register("dictionary_file", """WITH p AS (SELECT regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g') || 'Date_' || p_partkey AS code, p_type || ';' || chr(10) || 'said "' || p_brand || '"' AS glossary, p_partkey FROM part)
SELECT code, glossary AS description, CAST(len(list_distinct([p_type, 'said "' || p_brand || '"'])) AS INTEGER) AS parts FROM (SELECT p.*, p_type, p_brand FROM p JOIN part USING (p_partkey)) WHERE p_partkey % 9 <> 0""")
def dictionary_file(spark, sf_dir):
    """The dictionary written as a quoted CSV with line ends and quotes inside, and rows without a code, and read again."""
    path = fresh_path(spark, "dictionary")
    name = F.concat(F.regexp_replace("p_name", "[^A-Za-z0-9]", ""), F.lit("Date_"), F.col("p_partkey").cast("string"))
    glossary = F.concat("p_type", F.lit(';\nsaid "'), "p_brand", F.lit('"'))
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 9 != 0, name).otherwise("").alias("code"), glossary.alias("glossary"))
    rows.write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    found = readers.dictionary_csv(spark, path)
    # beside the glossary's parts the keywords hold the label's words
    return found.select("code", "description", F.size(F.array_intersect("keywords", F.transform(F.split("description", ";"), F.trim))).alias("parts"))
