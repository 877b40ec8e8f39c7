"""Corpus preparation: from raw documents to packed training sequences.

Five stages, each a function of (spark, docs, sf_dir). All but the last return the columns of ``documents``; the last
returns the packing (bin_group, bin, slot, doc_id, piece, start_word, n_words). Between stages the rows are written as
Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import cotraining, crf_langid, jaccard_join, packing, substring_dedup
from fieldloom.llm.common import dropped, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose words are on average less sure of any one language is rejected.
MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: no letters, or no language with a mean probability of one half."""
    docs = docs.select(*COLUMNS)
    found = crf_langid.identify(docs, crf_langid.fit(docs))
    return found.filter((F.col("lang_pred") != crf_langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the co-trained classifier scores below one half."""
    docs = docs.select(*COLUMNS)
    model = cotraining.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotraining.classify(docs, model).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component at five words and 0.8.

    Rows without an id are not judged. Where several rows have the id that stays, each of their different texts stays once, with the
    smallest of its other columns. Ids are joined, not texts: those that stay are a stored table of which Spark knows the size.
    """
    docs = docs.select(*COLUMNS)
    found = jaccard_join.jaccard_components(docs, n=5, percent=80)
    first = stored(found.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("n")), "kept-ids")
    dropped(found)
    once = docs.join(first.filter("n = 1").select("doc_id"), "doc_id", "left_semi")
    many = docs.join(first.filter("n > 1").select("doc_id"), "doc_id", "left_semi")
    many = many.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest")).select("doc_id", "text", "rest.*")
    return once.select(*COLUMNS).unionByName(many.select(*COLUMNS)).unionByName(docs.filter(F.col("doc_id").isNull()))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes chunks that came before out of the texts; ``n_chars`` follows."""
    found = substring_dedup.deduplicate(docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packed", packed),
]

#: The first stages hold trained models, which SQL cannot express; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        dropped(*before)
        before = [docs]
    packing_of = STAGES[-1][1](spark, docs, sf_dir)
    dropped(*before)  # the packing reads its own table of lengths
    return packing_of
