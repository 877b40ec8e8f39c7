"""Aggregates: summaries, profiles, consistency, fusion, conflicts, risk. Empty groups give 0, not null, where stated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions import numeric

#: Weights of the risk score and its class limits.
RISK_WEIGHTS, RISK_LIMITS = (0.32, 0.33, 0.2, 0.15), (0.34, 0.67)


def summary(df: DataFrame, keys: Sequence[str], value: str, digits: int = 6) -> DataFrame:
    """Count, mean, least and greatest; 0 for no values."""
    part = lambda f: F.coalesce(F.round(f(value), digits), F.lit(0.0))
    return df.groupBy(*keys).agg(F.count(value).alias("n"), part(F.avg).alias("mean"), part(F.min).alias("least"), part(F.max).alias("greatest"))


def histogram(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows in five fixed buckets of 0.2, closed on the left; what lies outside goes to the edge buckets."""
    bucket = F.when(F.col(value) < 0.2, "0.0-0.2").when(F.col(value) < 0.4, "0.2-0.4").when(F.col(value) < 0.6, "0.4-0.6").when(F.col(value) < 0.8, "0.6-0.8").otherwise("0.8-1.0")
    return df.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def code_profile(df: DataFrame, code: str, value: str, threshold: str, ordinal: Sequence[str], gap: Column) -> DataFrame:
    """Per code: rows, mean, range, rows below their threshold, share of disagreements, and the last threshold seen."""
    return df.groupBy(code).agg(
        F.count("*").alias("n"),
        F.round(F.avg(value), 6).alias("mean"),
        F.min(value).alias("least"),
        F.max(value).alias("greatest"),
        F.count_if(F.col(value) < F.col(threshold)).alias("n_below"),
        F.round(F.avg(gap.cast("int")), 6).alias("disagreement"),
        F.max_by(threshold, F.struct(*ordinal)).alias("threshold"),
    )


def consistency(df: DataFrame, code: str, family: str, value: str, spread: float = 0.35, rate: float = 0.45, accepted: Column | None = None) -> DataFrame:
    """Per code over families: range of the family means, and flags beyond ``spread`` and ``rate`` (share of weak rows). Rows that are not ``accepted`` do not count."""
    df = df if accepted is None else df.filter(accepted)
    means = df.groupBy(code, family).agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.count_if(F.col(value) < 0.4).alias("weak"))
    return means.groupBy(code).agg(
        F.count("*").alias("n_families"),
        F.sum("n").alias("n"),
        F.round(F.max("mean") - F.min("mean"), 6).alias("delta"),
        (F.round(F.max("mean") - F.min("mean"), 6) >= spread).alias("inconsistent"),
        (F.sum("weak") / F.sum("n") >= rate).alias("weak"),
    )


def family_means(df: DataFrame, family: str, value: str) -> DataFrame:
    """Family means beside the unweighted mean of all families, and 1 - mean absolute difference."""
    everything = Window.partitionBy(F.lit(0))  # one row a family
    each = df.groupBy(family).agg(F.avg(value).alias("mean")).withColumn("overall", F.avg("mean").over(everything))
    gaps = each.withColumn("delta", F.col("mean") - F.col("overall")).withColumn("transferability", 1 - F.avg(F.abs("delta")).over(everything))
    return gaps.select(family, *[F.round(c, 6).alias(c) for c in ("mean", "overall", "delta", "transferability")])


def fusion(df: DataFrame, group: str, doc: str, family: str, code: str, signals: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per equivalence group: distinct documents and families, signal means, canonical (first) code, and conflict of codes.

    Rows are summed by (group, code, family) first, and documents made distinct by (group, document): a group with very many rows is
    many keys until few are left of it.
    """
    sums = [F.sum(s).alias(f"_s{k}") for k, s in enumerate(signals)] + [F.count(s).alias(f"_n{k}") for k, s in enumerate(signals)]
    parts = df.groupBy(group, code, family).agg(*sums, F.min(F.struct(*order, code)).alias("_first"))
    docs = df.select(group, doc).distinct().groupBy(group).agg(F.count(doc).alias("n_docs"))
    codes = parts.groupBy(group).agg(
        F.array_join(F.array_sort(F.collect_set(family)), ",").alias("families"),
        *[F.round(F.sum(f"_s{k}") / F.sum(f"_n{k}"), 6).alias(s) for k, s in enumerate(signals)],
        F.min("_first")[code].alias("canonical"),
        F.size(F.collect_set(code)).cast("long").alias("n_codes"),
    )
    return docs.join(codes, group).withColumn("conflict", F.col("n_codes") > 1).select(group, "n_docs", "families", *signals, "canonical", "conflict", "n_codes")


def contradictions(df: DataFrame, text: str, code: str, value: str, review: float) -> DataFrame:
    """Texts with two rows or more, several codes, and every row at least at ``review``."""
    found = df.filter(F.col(text) != "").groupBy(text).agg(F.count("*").alias("n"), F.countDistinct(code).alias("n_codes"), F.min(value).alias("least"))
    return found.filter((F.col("n") >= 2) & (F.col("n_codes") >= 2) & (F.col("least") >= review))


def risk(df: DataFrame, key: str, parts: Sequence[Column]) -> DataFrame:
    """Weighted mean of four conditional averages (missing: 0), and its class."""
    found = df.groupBy(key).agg(*[F.coalesce(F.avg(p), F.lit(0.0)).alias(f"_p{k}") for k, p in enumerate(parts)])
    total = F.lit(0.0)
    for k, weight in enumerate(RISK_WEIGHTS):
        total = total + weight * F.col(f"_p{k}")
    score = F.round(numeric.clamp01(total), 9)
    label = F.when(score < RISK_LIMITS[0], "low").when(score < RISK_LIMITS[1], "medium").otherwise("high")
    return found.select(key, score.alias("score"), label.alias("class"))


def mode_priors(df: DataFrame, category: str, evidence: str, static: dict[tuple[str, str], float]) -> DataFrame:
    """Evidence share of each category at 0.35 + share, at least the stated prior."""
    counts = df.groupBy(category, evidence).agg(F.count("*").alias("n"))
    totals = counts.groupBy(category).agg(F.sum("n").alias("total"))
    prior = F.lit(0.0)
    for (c, e), value in static.items():
        prior = F.when((F.col(category) == c) & (F.col(evidence) == e), value).otherwise(prior)
    return counts.join(totals, category).select(category, evidence, F.round(F.greatest(0.35 + F.col("n") / F.col("total"), prior), 6).alias("weight"))
