"""Sources: dictionary CSV, taxonomy JSON, plain-text blocks, layout lines, form markup, hash-checked artefacts."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions import numeric, text
from fieldloom.operators import joins

#: Data type of a code by its name, first match first.
DATA_TYPES = [("date", "date|effective|expiration"), ("currency", "amount|premium|limit|price"), ("boolean", "indicator|flag"), ("number", "count|number|percent|size")]


def dictionary_csv(spark: SparkSession, path: str) -> DataFrame:
    """code and glossary rows of a quoted, multi-line CSV with a header line."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', schema="code string, glossary string", mode="PERMISSIVE")
    return dictionary(raw)


def dictionary(raw: DataFrame) -> DataFrame:
    """code, label, description, data_type and distinct keywords of (code, glossary) rows; rows without a code go."""
    code, glossary = F.trim("code"), F.coalesce(F.trim("glossary"), F.lit(""))
    label = text.label_of_code(code)
    parts = F.filter(F.transform(F.split(glossary, ";"), F.trim), lambda k: k != "")
    words = F.filter(F.split(label, " "), lambda w: F.length(w) > 2)
    kind = F
    for name, pattern in DATA_TYPES:
        kind = kind.when(F.lower(label).rlike(pattern), name)
    return raw.filter(F.coalesce(code, F.lit("")) != "").select(
        code.alias("code"), label.alias("label"), F.coalesce(F.nullif(glossary, F.lit("")), label).alias("description"),
        kind.otherwise("string").alias("data_type"), F.array_distinct(F.concat(parts, words)).alias("keywords"),
    )


def malformed(raw: DataFrame) -> int:
    """Rows without a code."""
    return raw.filter(F.coalesce(F.trim("code"), F.lit("")) == "").count()


def optional_json(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Rows of JSON files; none where the path does not exist, and none for a file that cannot be parsed."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path, multiLine=multi_line)
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def taxonomy_json(spark: SparkSession, path: str) -> DataFrame:
    """label, category of a JSON array; a missing file is an empty taxonomy, not an error."""
    return optional_json(spark, path, "eLabelName string, category string").select(F.col("eLabelName").alias("label"), "category").filter("label is not null")


def with_category(df: DataFrame, taxonomy: DataFrame, label: str) -> DataFrame:
    """Adds ``category`` of the label's exact name, else of its normalised one; null for unknown labels. The first of equal names counts."""
    exact = taxonomy.groupBy("label").agg(F.min("category").alias("_exact"))
    loose = taxonomy.groupBy(text.normalise(F.col("label")).alias("_norm")).agg(F.min("category").alias("_loose"))
    met = df.withColumn("_norm", text.normalise(F.col(label))).join(exact.withColumnRenamed("label", label), label, "left").join(loose, "_norm", "left")
    return met.withColumn("category", F.coalesce("_exact", "_loose")).drop("_norm", "_exact", "_loose")


_RULES = "forms array<struct<family:string,entries:array<struct<codes:array<string>,patterns:array<string>,weight:double>>>>"


def supervision_rules(spark: SparkSession, paths: list[str], built_in: list[tuple[str, str, float, str | None]], multi_line: bool = True) -> DataFrame:
    """code, pattern, weight, family of nested rule files (any may be missing) and of built-in rules; the greatest weight of equal rules stays."""
    rules = spark.createDataFrame(built_in, "code string, pattern string, weight double, family string")
    for path in paths:
        forms = optional_json(spark, path, _RULES, multi_line).select(F.explode("forms").alias("f")).select("f.family", F.explode("f.entries").alias("e"))
        flat = forms.select("family", F.explode("e.codes").alias("code"), "e.patterns", F.coalesce("e.weight", F.lit(0.5)).alias("weight")).withColumn("pattern", F.explode("patterns"))
        rules = rules.unionByName(flat.select("code", "pattern", "weight", "family"))
    return rules.filter(F.trim("pattern") != "").groupBy("code", "pattern", "family").agg(F.max("weight").alias("weight"))


def model_bundle(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """model, present, payload (JSON text) of optional model files ``<name>.json``."""
    found = None
    for name in names:
        try:
            held = spark.read.text(f"{folder}/{name}.json", wholetext=True).select(F.lit(name).alias("model"), F.lit(True).alias("present"), F.regexp_replace("value", r"\s+$", "").alias("payload"))
        except AnalysisException as fault:
            if fault.getCondition() != "PATH_NOT_FOUND":
                raise
            held = spark.range(1).select(F.lit(name).alias("model"), F.lit(False).alias("present"), F.lit(None).cast("string").alias("payload"))
        found = held if found is None else found.unionByName(held)
    return found


def read_keyed(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Rows of one key of a keyed store; none where the store or the key is missing."""
    try:
        return spark.read.json(path).filter(F.col(key) == value)
    except AnalysisException as fault:
        if fault.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], f"`{key}` string")


def replay_batches(spark: SparkSession, baseline: str, replay: str, schema: str) -> DataFrame:
    """fixture (the file's name), baseline and replay arrays of rows, for every fixture of the baseline folder; a missing replay is empty."""
    rows = lambda path, name: (
        spark.read.schema(schema).json(path).withColumn("fixture", F.regexp_extract(F.col("_metadata.file_path"), r"fixture=([^/]+)", 1)).groupBy("fixture").agg(F.count("*").alias(f"{name}_rows"))
    )
    return rows(baseline, "baseline").join(rows(replay, "replay"), "fixture", "left").fillna(0, ["replay_rows"])


def text_blocks(docs: DataFrame, key: str, value: str, height: int = 24) -> DataFrame:
    """One block per non-blank line, with a made-up box below the one before."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(value), F.lit("")), "\r?\n")).alias("line", "block")).filter(F.trim("block") != "")
    box = numeric.box(F.lit(0), F.col("line") * height, F.length("block") * 7, F.lit(height))
    return lines.select(key, "line", F.trim("block").alias("block"), box.alias("box"))


def layout_lines(pages: DataFrame, digits: int = 4) -> DataFrame:
    """doc_id, page, kind, content, box (pixels, ``digits`` digits) and place in reading order (y, x, text) of pages with lines and selection marks."""
    def rows(array: str, kind: str, content: Column) -> DataFrame:
        each = pages.select("doc_id", F.col("pageNumber").alias("page"), "unit", F.explode(array).alias("r"))
        pixels = F.transform(F.col("r.polygon"), lambda p: F.struct(numeric.to_pixels(p["x"], F.col("unit")).alias("x"), numeric.to_pixels(p["y"], F.col("unit")).alias("y")))
        return each.select("doc_id", "page", F.lit(kind).alias("kind"), content.alias("content"), numeric.bounds(pixels).alias("box"))

    found = rows("lines", "text", F.col("r.content")).unionByName(rows("selectionMarks", "mark", F.col("r.state")))
    found = found.withColumn("box", F.struct(*[numeric.quantise(F.col(f"box.{c}"), digits).alias(c) for c in ("x", "y", "width", "height")]))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("box.y", "box.x", "content")))


def tags(pages: DataFrame, key: str, value: str) -> DataFrame:
    """key and lower-cased name of every opening tag, by pattern: no nesting."""
    return pages.select(key, F.explode(F.regexp_extract_all(F.lower(F.col(value)), F.lit(r"<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))


def elements(pages: DataFrame, key: str, value: str) -> DataFrame:
    """key, at, tag, attributes (map) and value of every ``<tag ...>text</tag>`` by pattern: no nesting, entities resolved."""
    pattern = r"<([A-Za-z][\w.-]*)((?:\s+[\w:.-]+\s*=\s*\"[^\"]*\")*)\s*>([^<]*)</"
    found = lambda group: F.regexp_extract_all(F.col(value), F.lit(pattern), F.lit(group))
    each = pages.select(key, F.posexplode(F.arrays_zip(found(1).alias("tag"), found(2).alias("attrs"), found(3).alias("value"))).alias("at", "e"))
    names, values = (F.regexp_extract_all("e.attrs", F.lit(r'([\w:.-]+)\s*=\s*"([^"]*)"'), F.lit(g)) for g in (1, 2))
    return each.select(key, "at", "e.tag", F.map_from_arrays(F.array_distinct(names), F.slice(values, 1, F.size(F.array_distinct(names)))).alias("attributes"), text.unescape_xml(F.col("e.value")).alias("value"))


CONTROLS = ("field", "check", "radio", "combobox", "signature")
_FIELDS = ["form_id", "page", "place", "sid", "path", "tag", "label", "help", "x", "y", "width", "height", "fault"]
_FIELD_SCHEMA = "form_id string, page int, place int, sid string, path string, tag string, label string, help string, x double, y double, width double, height double, fault string"
#: Value type of a control by its tag and label, first match first.
CONTROL_TYPES = [("boolean", "^check |^radio "), ("choice", "^combobox "), ("signature", "^signature "), ("date", "date|dob|expir|effective"), ("currency", r"amount|premium|limit|\$"), ("number", "number|count|percent|zip|year")]


def form_fields(files: DataFrame) -> DataFrame:
    """One row a control of XML forms (form_id, content), plain or in a base64-gzip envelope: page, place, sid, path, tag, label, help, box.

    A control's label and help are the last ones before it on its page. A form that cannot be parsed gives one row with its fault and
    no control. A form is parsed where it lies, one at a time.
    """

    def controls(form: str, root: ET.Element) -> Iterator[tuple]:
        pages = [e for e in root.iter() if e.tag.rsplit("}", 1)[-1] == "page"] or [root]
        for number, page in enumerate(pages, 1):
            label = help_text = None
            place = 0
            for node in page.iter():
                name = node.tag.rsplit("}", 1)[-1]
                if name == "label":
                    label, help_text = (node.text or "").strip(), None
                elif name == "help":
                    help_text = (node.text or "").strip()
                elif name in CONTROLS:
                    place += 1
                    box = [float(node.get(c, "nan")) for c in ("x", "y", "width", "height")]
                    yield form, number, place, node.get("sid"), f"page{number}/{name}[{place}]", name, label, help_text, *box, None

    def one(form: str, content: str) -> Iterator[tuple]:
        try:
            if "base64-gzip" in content[:200]:
                content = gzip.decompress(base64.b64decode(content.split("\n", 1)[1])).decode()
            yield from list(controls(form, ET.fromstring(content)))
        except (ET.ParseError, ValueError, OSError, IndexError) as fault:
            yield form, *[None] * 11, type(fault).__name__

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [row for form, content in zip(pdf.form_id, pdf.content) for row in one(form, content or "")]
            yield pd.DataFrame(rows, columns=_FIELDS).astype({"page": "Int32", "place": "Int32"})

    return files.select("form_id", "content").mapInPandas(run, _FIELD_SCHEMA)


def semantic_fields(fields: DataFrame) -> DataFrame:
    """Sound controls with their value type, the question of their help text, and tokens."""
    kind = F
    for name, pattern in CONTROL_TYPES:
        kind = kind.when(F.lower(F.concat("tag", F.lit(" "), F.coalesce("label", F.lit("")))).rlike(pattern), name)
    return fields.filter("fault is null").withColumns({"value_type": kind.otherwise("text"), "question": text.quoted_question(F.col("help")), "tokens": text.semantic_tokens(F.coalesce("label", F.lit("")))})


def ground_truth(fields: DataFrame) -> DataFrame:
    """form_id, pages, fields, labels, kinds (map), entries (in order) and faults of every form: one nested row a form."""
    sound = F.col("fault").isNull()
    entry = F.when(sound, F.struct("page", "place", "sid", "tag", "label"))
    counts = fields.filter(sound).groupBy("form_id", "tag").agg(F.count("*").alias("n")).groupBy("form_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "n")))).alias("kinds"))
    found = fields.groupBy("form_id").agg(
        F.coalesce(F.max("page"), F.lit(0)).alias("pages"), F.count_if(sound).alias("fields"), F.size(F.collect_set(F.when(sound, F.col("label")))).alias("labels"),
        F.array_sort(F.array_compact(F.collect_list(entry))).alias("entries"), F.array_sort(F.collect_set("fault")).alias("faults"),
    )
    return found.join(counts, "form_id", "left")


def choose_form(documents: DataFrame, forms: DataFrame, least: float = 0.55) -> DataFrame:
    """doc, form, by: the form of a document's number, else the one whose name is most similar (Dice of tokens, at least ``least``); null without one.

    ``documents``: doc, number, name; ``forms``: form, number, name. Documents meet forms by number, else the distinct token sets of names meet by their rare tokens
    (``joins.dice_join``), of forms with one set the first: names that repeat make no pairs of their own.
    """
    numbered = documents.join(forms.groupBy("number").agg(F.min("form").alias("form")), "number").select("doc", "form", F.lit("number").alias("by"))
    of = lambda c: F.array_sort(F.array_distinct(text.tokens(F.col(c), 2)))
    named = documents.join(numbered.select("doc"), "doc", "left_anti").select("doc", of("name").alias("a"))
    known = forms.groupBy(of("name").alias("b")).agg(F.min("form").alias("form"))
    # similarities are rounded before they are compared
    met = joins.dice_join(named.select("a", F.col("a").alias("t")).distinct(), known.select("b", F.col("b").alias("t")), "a", "b", "t", max(1e-9, least - 1e-6))
    scored = met.withColumn("s", F.round("dice", 6)).filter(F.col("s") >= least).join(known, "b")
    first = F.min(F.struct((-F.col("s")).alias("s"), "form"))
    sets = scored.groupBy("a").agg(first.alias("_best")).select("a", "_best.*")
    best = named.join(sets, "a").groupBy("doc").agg(first["form"].alias("form")).withColumn("by", F.lit("name"))
    return documents.select("doc").join(numbered.unionByName(best), "doc", "left")


def canonical_json(value: object) -> str:
    """Keys in order, no white space."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def checked_artefact(content: str) -> dict:
    """An artefact {payload, hash} whose SHA-256 over the canonical payload must agree."""
    found = json.loads(content)
    if hashlib.sha256(canonical_json(found["payload"]).encode()).hexdigest() != found.get("hash"):
        raise ValueError("the artefact's hash does not agree")
    return found["payload"]


def artefact_rows(files: DataFrame) -> DataFrame:
    """kind, id, other, role of the nodes, aliases and edges of artefact files (content); a hash that does not agree fails the query."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for content in pdf.content:
                payload = checked_artefact(content)
                for node in payload.get("nodes", []):
                    rows.append(("node", node["id"], None, node.get("role")))
                    rows += [("alias", node["id"], alias, node.get("role")) for alias in node.get("aliases", [])]
                rows += [("edge", edge["from"], edge["to"], edge.get("type")) for edge in payload.get("edges", [])]
            yield pd.DataFrame(rows, columns=["kind", "id", "other", "role"])

    return files.select("content").mapInPandas(run, "kind string, id string, other string, role string")
