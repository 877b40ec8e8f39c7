"""Sinks: keyed tables, element exports, schema exports, append-only audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions import text


def write_keyed(df: DataFrame, path: str, key: str) -> None:
    """One partition folder per key; only the keys of ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path)


def to_elements(df: DataFrame, doc: str, order: list[str], code: str, value: str) -> DataFrame:
    """doc, xml: one element per row in order, escaped."""
    tag = text.xml_tag(F.col(code))
    element = F.concat(F.lit("<"), tag, F.lit(">"), text.escape_xml(F.coalesce(F.col(value).cast("string"), F.lit(""))), F.lit("</"), tag, F.lit(">"))
    rows = df.select(doc, F.struct(*order, element.alias("element")).alias("row"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["element"]), "")
    return rows.groupBy(doc).agg(F.concat(F.lit("<Submission>"), body, F.lit("</Submission>")).alias("xml"))


def unique_names(df: DataFrame, doc: str, order: list[str], code: str) -> DataFrame:
    """Adds ``name``: the canonical name of a code, numbered from its second row in a document; a number that makes another code's name is
    counted on until it is free there. Rows without a code go."""
    rows = df.filter(F.coalesce(F.trim(code), F.lit("")) != "").withColumn("_base", text.canonical_name(F.col(code)))
    w = Window.partitionBy(doc, "_base").orderBy(*order)
    rows = rows.withColumns({"_n": F.row_number().over(w), "_bases": F.collect_set("_base").over(Window.partitionBy(doc))})
    # base names of the document that look like this base with a number shift the numbers from there on
    numbers = F.transform("_bases", lambda b: F.when(b == F.concat("_base", F.lit("_"), F.regexp_extract(b, r"_(\d{1,9})$", 1)), F.regexp_extract(b, r"_(\d{1,9})$", 1).try_cast("long")))
    taken = F.array_sort(F.filter(numbers, lambda k: k >= 2))
    shifted = F.aggregate(taken, F.col("_n").cast("long"), lambda n, k: F.when((k <= n) & (F.col("_n") > 1), n + 1).otherwise(n))
    return rows.withColumn("name", F.when(F.col("_n") > 1, F.concat_ws("_", "_base", shifted.cast("string"))).otherwise(F.col("_base"))).drop("_base", "_n", "_bases")


def to_schema(df: DataFrame, doc: str, order: list[str], code: str, kind: str) -> DataFrame:
    """doc, schema: JSON of property name to type; repeated names are numbered (``unique_names``)."""
    rows = unique_names(df, doc, order, code)
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct(F.col(kind).alias("type"))))))
    return rows.groupBy(doc).agg(F.to_json(F.struct(F.lit("object").alias("type"), entries.alias("properties"))).alias("schema"))


#: The input element of a value type.
WIDGETS = {"boolean": "checkbox", "date": "date", "number": "number", "currency": "number"}


def to_ui_schema(df: DataFrame, doc: str, order: list[str], code: str, kind: str) -> DataFrame:
    """doc, ui: JSON list of elements in order: scope, widget, place."""
    widget = F.lit("text")
    for name, element in WIDGETS.items():
        widget = F.when(F.col(kind) == name, element).otherwise(widget)
    rows = unique_names(df, doc, order, code)
    item = F.struct(*order, F.struct(F.concat(F.lit("#/properties/"), "name").alias("scope"), widget.alias("widget")).alias("element"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda r: r["element"])
    return rows.groupBy(doc).agg(F.to_json(F.struct(F.lit("VerticalLayout").alias("type"), listed.alias("elements"))).alias("ui"))


def unified_exports(profiles: DataFrame) -> DataFrame:
    """xml element and schema JSON of each fused profile (group, code, families, confidence)."""
    tag = text.xml_tag(F.col("code"))
    part = lambda name, value: F.concat(F.lit(f' {name}="'), text.escape_xml(value), F.lit('"'))
    xml = F.concat(F.lit("<"), tag, part("group", F.col("group")), part("families", F.col("families")), F.lit("/>"))
    schema = F.to_json(F.struct("code", F.split("families", ",").alias("families"), "confidence"))
    return profiles.select("group", xml.alias("xml"), schema.alias("schema"))


def carrier_payloads(df: DataFrame, doc: str, order: list[str], code: str, value: str, carrier: str) -> DataFrame:
    """doc, carrier, json, xml and the SHA-256 of both: the two renditions of one submission."""
    xml = to_elements(df, doc, order, code, value)
    row = F.struct(*order, F.struct(F.col(code).alias("code"), F.col(value).cast("string").alias("value")).alias("field"))
    json = df.groupBy(doc).agg(F.to_json(F.struct(F.lit(carrier).alias("carrier"), F.transform(F.array_sort(F.collect_list(row)), lambda r: r["field"]).alias("fields"))).alias("json"))
    both = json.join(xml, doc)
    return both.select(doc, F.lit(carrier).alias("carrier"), "json", "xml", F.sha2("json", 256).alias("json_sha256"), F.sha2("xml", 256).alias("xml_sha256"))


def merged_reports(before: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Reports of all keys, the fresh one where there are two: writing the same batch again changes nothing."""
    return before.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def manifest(before: DataFrame, now: DataFrame, key: str, value: str, content: str) -> DataFrame:
    """key, previous, current, delta and the content's SHA-256 over all keys of two snapshots; a missing side counts 0."""
    a = before.select(key, F.col(value).alias("previous"))
    b = now.select(key, F.col(value).alias("current"), F.sha2(F.col(content).cast("string"), 256).alias("sha256"))
    both = a.join(b, key, "full_outer").fillna(0, ["previous", "current"])
    return both.select(key, "previous", "current", (F.col("current") - F.col("previous")).alias("delta"), "sha256")


def upsert_profiles(before: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(profiles, audit): changed profiles get the next version, others stay; an audit row a change. key, codes (array), version; changes: key, codes."""
    last = before.select(key, F.col("version").alias("_v"))
    fresh = changes.join(last, key, "left").select(key, F.array_sort("codes").alias("codes"), (F.coalesce("_v", F.lit(0)) + 1).alias("version"))
    kept = before.join(changes.select(key), key, "left_anti").select(key, F.array_sort("codes").alias("codes"), "version")
    audit = fresh.select(key, "version", F.sha2(F.array_join("codes", "|"), 256).alias("digest"))
    return kept.unionByName(fresh), audit


def audit_index(events: DataFrame, group: str, key: str) -> DataFrame:
    """group, ids: the sorted distinct ids of an audit log."""
    return events.groupBy(group).agg(F.array_sort(F.collect_set(key)).alias("ids"))


def audit_rows(events: DataFrame, key: str, at: str) -> DataFrame:
    """Event rows with the digest of their content; equal ones once."""
    digest = F.sha2(F.to_json(F.struct(*sorted(events.columns))), 256)
    return events.withColumn("digest", digest).dropDuplicates([key, "digest"])


def append_audit(events: DataFrame, path: str, key: str, at: str) -> None:
    audit_rows(events, key, at).write.mode("append").parquet(path)
