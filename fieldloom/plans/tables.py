"""Driver tables shaped as the engine's own: candidates, blocks with boxes, dictionary entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import numeric, text
from fieldloom.sources.readers import dictionary


def place() -> Column:
    """Line numbers repeat within an order; part, supplier and quantity make the place unique."""
    return ((F.col("l_linenumber").cast("long") * 10_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored candidates of documents (orders)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), place().alias("ordinal"), F.concat(F.lit("C"), (F.col("l_partkey") % 40).cast("string")).alias("code"),
        F.col("l_returnflag").alias("family"), F.round(F.col("l_discount") * 10, 6).alias("conf"), F.round(F.col("l_tax") * 12.5, 6).alias("sim"), F.col("l_quantity").alias("quantity"),
    )


CANDIDATES = """cand AS (
  SELECT l_orderkey AS doc, ((CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS ordinal, 'C' || CAST(l_partkey % 40 AS VARCHAR) AS code, l_returnflag AS family,
         round(l_discount * 10, 6) AS conf, round(l_tax * 12.5, 6) AS sim, l_quantity AS quantity FROM lineitem)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes on pages (orders): whole numbers from ids."""
    li = table(spark, sf_dir, "lineitem")
    box = numeric.box(F.col("l_partkey") % 600, F.col("l_suppkey") % 40 * 20, 60 + F.col("l_partkey") % 40, F.lit(20))
    return li.select(F.col("l_orderkey").alias("page"), place().alias("block"), box.alias("box"), F.round(F.col("l_discount") * 10, 6).alias("conf"), F.col("l_returnflag").alias("flag"))


BLOCKS = """blk AS (
  SELECT l_orderkey AS page, ((CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS block, CAST(l_partkey % 600 AS DOUBLE) AS x, CAST(l_suppkey % 40 * 20 AS DOUBLE) AS y,
         CAST(60 + l_partkey % 40 AS DOUBLE) AS w, 20.0::DOUBLE AS h, round(l_discount * 10, 6) AS conf, l_returnflag AS flag FROM lineitem)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as dictionary entries: code, label, description, data_type, keywords."""
    part = table(spark, sf_dir, "part")
    code = F.concat(F.regexp_replace(F.initcap("p_name"), "[^A-Za-z0-9]", ""), F.lit("_"), F.col("p_partkey").cast("string"))
    return dictionary(part.select(code.alias("code"), F.concat_ws(";", F.col("p_type"), F.col("p_brand")).alias("glossary")))


def normalised_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def part_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", text.tokens(F.col("p_name")).alias("name_tokens"), text.tokens(F.col("p_type")).alias("type_tokens"))


PART_TOKENS = f"""pt AS (SELECT p_partkey, list_filter(string_split({normalised_sql('p_name')}, ' '), lambda t: length(t) >= 3) AS name_tokens,
  list_filter(string_split({normalised_sql('p_type')}, ' '), lambda t: length(t) >= 3) AS type_tokens FROM part)"""


#: Texts of form blocks; a block's text is picked by its numbers.
PROMPT_TEXTS = [
    "Named Insured:", "Mailing Address", "City:", "State", "Zip Code", "Policy Number", "Agent Name", "Date Business Started", "Commercial Insurance Application Form Schedule",
    "Page 1 of 4", "Description of Operations", "Have you had any claims during the last five years?", "If yes, explain in detail on the next sheet", "Yes", "No", "12 of 20",
    "Copyright 2020 all rights reserved", "Total Premium Amount", "Phone (800) 555-1234", "GENERAL LIABILITY SECTION", "Number of full time employees", "Applicant Name",
    "Loss history and prior claims", "Roof and electrical hazard notes", "Annual payroll and gross sales", "Premises Operations of the contractor", "Please note: complete this section before you sign",
    "Producer:", "Fax", "Signature", "", "Effective Date", "Year license issued", "Location of work performed and receipts by trade with day laborers listed", "Agency, Inc. www services 555 123 4567 office",
    "E-mail Address", "Contact Representative", "Type of work performed", "Limit", "Remarks ....... ", "NamedInsured FullName 1,200", "City State Zip", "Deductible", "The quick brown fox",
]
FAMILIES = ["form 125", "contractors supplement", "form 140"]


def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with form texts: page, block, text, family, box, conf."""
    li = table(spark, sf_dir, "lineitem")
    box = numeric.box(F.col("l_partkey") % 600, F.col("l_suppkey") % 50 * 20, 60 + F.col("l_partkey") % 400, 14 + F.col("l_suppkey") % 20)
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    return li.select(
        F.col("l_orderkey").alias("page"), place().alias("block"), pick(PROMPT_TEXTS, F.col("l_partkey") * 7 + F.col("l_suppkey")).alias("text"),
        pick(FAMILIES, F.col("l_suppkey")).alias("family"), box.alias("box"), F.round(F.col("l_discount") * 10, 6).alias("conf"),
    )


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


PROMPT_BLOCKS = f"""pb AS (
  SELECT l_orderkey AS page, ((CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS block,
   {sql_list(PROMPT_TEXTS)}[CAST((l_partkey * 7 + l_suppkey) % {len(PROMPT_TEXTS)} + 1 AS INTEGER)] AS text, {sql_list(FAMILIES)}[CAST(l_suppkey % {len(FAMILIES)} + 1 AS INTEGER)] AS family,
   CAST(l_partkey % 600 AS DOUBLE) AS x, CAST(l_suppkey % 50 * 20 AS DOUBLE) AS y, CAST(60 + l_partkey % 400 AS DOUBLE) AS w, CAST(14 + l_suppkey % 20 AS DOUBLE) AS h, round(l_discount * 10, 6) AS conf FROM lineitem)"""
