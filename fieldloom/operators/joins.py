"""Joins: scored dictionary search, rule joins, token index, vector and spatial joins, constraint checks.

Rule lists and search queries are stated by the caller: every row of the large table meets them where it lies. Everything
else is an equi-join on page, token, key or block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import numeric, text
from fieldloom.operators import spatial
from fieldloom.operators.rows import top_k
from fieldloom.storage import small, stored

#: Most queries or rules of one call: they become literals of the plan.
MAX_STATED = 2000
#: Fixed values of the search score: equal, begins, holds; of code, label, description; then of each token.
CODE_SCORES, LABEL_SCORES, DESCRIPTION_SCORE = (200, 140, 100), (160, 90, 70), 50
TOKEN_SCORES = {"code": 25, "label": 18, "description": 10, "keywords": 14}


def _stated(values: list) -> list:
    if len(values) > MAX_STATED:
        raise ValueError(f"{len(values)} stated values; at most {MAX_STATED}")
    return values


def search_score(query: Column, words: Column, code: Column, label: Column, description: Column, keywords: Column) -> Column:
    """Score of one dictionary entry (normalised columns) for a normalised query and its tokens."""
    ladder = lambda of, s: F.when(of == query, s[0]).when(of.startswith(query), s[1]).when(of.contains(query), s[2]).otherwise(0)
    score = ladder(code, CODE_SCORES) + ladder(label, LABEL_SCORES) + F.when(description.contains(query), DESCRIPTION_SCORE).otherwise(0)

    def of_token(word: Column) -> Column:
        hit = lambda found, name: F.when(found, TOKEN_SCORES[name]).otherwise(0)
        return hit(code.contains(word), "code") + hit(label.contains(word), "label") + hit(description.contains(word), "description") + hit(F.exists(keywords, lambda k: k.contains(word)), "keywords")

    return score + F.aggregate(words, F.lit(0), lambda s, w: s + of_token(w))


def search_dictionary(dictionary: DataFrame, queries: list[str], limit: int = 20) -> DataFrame:
    """query, rank, code, label and score of the best entries (code, label, description, keywords) of each stated query.

    Empty queries find nothing; ties go by code, then label; the limit lies between 1 and 100.
    """
    asked = F.array(*[F.lit(q) for q in _stated(sorted(set(queries)))])
    entry = dictionary.select(
        "code", "label", text.normalise(F.col("code")).alias("c"), text.normalise(F.col("label")).alias("l"),
        text.normalise(F.col("description")).alias("d"), F.transform("keywords", text.normalise).alias("k"),
    )
    met = entry.withColumn("query", F.explode(asked)).withColumn("q", text.normalise(F.col("query"))).filter("q <> ''")
    words = F.filter(F.split("q", " "), lambda t: F.length(t) > 1)
    found = met.withColumn("score", search_score(F.col("q"), words, F.col("c"), F.col("l"), F.col("d"), F.col("k"))).filter("score > 0")
    order = [F.col("score").desc(), F.col("code"), F.col("label")]
    return top_k(found, ["query"], order, max(1, min(limit, 100))).select("query", "rank", "code", "label", "score")


@dataclass(frozen=True)
class Rule:
    """A pattern that speaks for a code; ``family`` None fits every family."""

    code: str
    pattern: str
    weight: float
    family: str | None = None


def rule_join(df: DataFrame, value: str, rules: list[Rule], family: str | None = None) -> DataFrame:
    """One row per input row and code whose rule fits: ``code`` and its greatest ``weight``. Nothing is shuffled: a row's hits are an array."""
    by_code: dict[str, list[Column]] = {}
    low = F.lower(F.col(value))
    for rule in _stated(rules):
        fits = low.rlike(rule.pattern)
        if rule.family is not None and family is not None:
            fits = fits & (F.col(family) == rule.family)
        by_code.setdefault(rule.code, []).append(F.when(fits, F.lit(float(rule.weight))))
    best = {code: weights[0] if len(weights) == 1 else F.greatest(*weights) for code, weights in by_code.items()}
    hits = F.array(*[F.struct(F.lit(code).alias("code"), weight.alias("weight")) for code, weight in best.items()])
    found = df.withColumn("_hit", F.explode(F.filter(hits, lambda h: h["weight"].isNotNull())))
    return found.select(*df.columns, "_hit.code", "_hit.weight")


def first_rule(value: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first (name, pattern) that fits the lower-cased text."""
    out = F
    for name, pattern in rules:
        out = out.when(F.lower(value).rlike(pattern), name)
    return out.otherwise(otherwise)


def token_index_join(df: DataFrame, key: str, items: str, hints: str, asked: Column | None = None) -> DataFrame:
    """key, other: rows that own a token which the first row hints at, itself excluded. Joined by token.

    ``asked`` states the query set; all rows may answer. Distinct token sets meet, each pair of them once, and stand for their rows.
    """
    each = lambda rows, name, tokens: rows.select(F.col(key).alias(name), F.explode(tokens).alias("token"))
    askers, hinted = token_classes(each(df if asked is None else df.filter(asked), key, hints), [key])
    owners, owned = token_classes(each(df, "other", items), ["other"])
    return of_classes(class_pairs(hinted, owned), askers, owners).filter(F.col(key) != F.col("other")).select(key, "other")


def token_classes(each: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, sets) of rows (keys, token): each key once with the number of its token set (``class``), and the distinct sets (class, tokens)."""
    held = each.groupBy(*keys).agg(F.sort_array(F.collect_set("token")).alias("tokens")).filter(F.size("tokens") > 0)
    return classes_of(held, keys)


def classes_of(held: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``token_classes`` of rows (keys, tokens) whose sorted distinct tokens are known."""
    held = stored(held, "token-sets")
    sets = stored(held.select("tokens").distinct().withColumn("class", F.monotonically_increasing_id()), "sets")
    return held.join(small(sets), "tokens").select(*keys, "class"), sets


def class_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """_l, _r: the classes whose sets share a token."""
    each = lambda sets, name: sets.select(F.col("class").alias(name), F.explode("tokens").alias("token"))
    return each(left, "_l").join(each(right, "_r"), "token").select("_l", "_r").distinct()


#: Rows of a class that lie together where classes stand for their rows.
CLASS_ROWS = 4096


def of_classes(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of ``left`` beside those of ``right`` (columns named apart, and ``class`` in both) whose classes are one of the distinct ``pairs`` (_l, _r).

    A class of very many rows is dealt in parts, so no pair of classes is one task's work; the pairs of rows are made by the join alone and never shuffled.
    """
    left, right = left.withColumnRenamed("class", "_l"), right.withColumnRenamed("class", "_r")
    parts = stored(right.groupBy("_r").agg(F.ceil(F.count("*") / CLASS_ROWS).cast("int").alias("_parts")), "class-parts")
    deal = F.pmod(F.xxhash64(*[c for c in right.columns if c != "_r"]), F.col("_parts")).cast("int")
    tasks = int(right.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = right.join(small(parts), "_r").withColumn("_part", deal).drop("_parts").repartition(tasks, "_r", "_part")
    asked = pairs.join(small(parts), "_r").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts").join(left, "_l").drop("_l")
    return asked.hint("merge").join(held, ["_r", "_part"]).drop("_r", "_part")


def dice_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, tokens: str, least: float) -> DataFrame:
    """left_key, right_key, dice of token sets that are alike by ``least`` or more (Dice), by rare-first prefix filtering.

    Sets of n and m tokens with a Dice of t share at least t (n + m) / 2, and m is n t / (2 - t) or more, so a partner shares one of the n - n t / (2 - t) + 1
    rarest tokens. Rows meet by these only, under the length and position filters, so a common token makes no pairs unless a set has no other; each pair
    is verified once. Keys tell rows of a side apart; empty sets are like nothing.
    """
    if not 0 < least <= 1:
        raise ValueError("the least Dice lies between 0 and 1")
    each = lambda df, key: df.select(F.col(key).alias("_key"), F.explode(F.array_distinct(tokens)).alias("_t"))
    seen = each(left, left_key).unionByName(each(right, right_key)).groupBy("_t").agg(F.count("*").alias("_n"))

    def prefixes(df: DataFrame, key: str, side: str) -> DataFrame:
        rare = each(df, key).join(seen, "_t").groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_n", "_t"))).alias("_o"))
        n = F.size("_o")
        kept = (n - F.ceil(n * (least / (2 - least)) - 1e-9) + 1).cast("int")
        rare = rare.select(F.col("_key").alias(key), F.col("_o._t").alias(f"_s{side}"), n.alias(f"_n{side}"), F.posexplode(F.slice("_o._t", 1, kept)).alias(f"_p{side}", "_t"))
        return rare

    met = prefixes(left, left_key, "l").join(prefixes(right, right_key, "r"), "_t")
    both = F.col("_nl") + F.col("_nr")
    possible = 1 + F.least(F.col("_nl") - F.col("_pl"), F.col("_nr") - F.col("_pr")) - 1 + F.least("_pl", "_pr")
    met = met.filter((2 * F.least("_nl", "_nr") >= least * both - 1e-9) & (2 * possible >= least * both - 1e-9))
    pairs = met.dropDuplicates([left_key, right_key]).withColumn("dice", text.dice(F.col("_sl"), F.col("_sr")))
    return pairs.filter(F.col("dice") >= least).select(left_key, right_key, "dice")


#: Rows of one block of a vector search.
BLOCK_ROWS = 4096


def vector_join(queries: DataFrame, rows: DataFrame, key: str, vector: str, least: float = 0.3, k: int = 12) -> DataFrame:
    """query_id, rank, key and similarity: the ``k`` nearest rows by cosine of at least ``least``, itself excluded.

    Unit vectors are made once; each row lies in one block of about ``BLOCK_ROWS`` rows (so there are as many as the table needs), each query
    visits every block, and a block keeps the ``k`` best of a query before anything is shuffled.
    """
    blocks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // BLOCK_ROWS))
    unit = numeric.unit_vector(F.col(vector))
    asked = queries.select(F.col(key).alias("query_id"), unit.alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    held = rows.select(key, unit.alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))
    met = asked.join(held, "block").filter(F.col("query_id") != F.col(key))
    found = met.select("block", "query_id", key, F.round(numeric.dot(F.col("q"), F.col("v")), 6).alias("similarity")).filter(F.col("similarity") >= least)
    order = [F.col("similarity").desc(), F.col(key)]
    best = top_k(found, ["block", "query_id"], order, k, "_in_block").select("query_id", key, "similarity")
    return top_k(best, ["query_id"], order, k)


def nearest(fields: DataFrame, labels: DataFrame, page: str, field_key: str, label_key: str, cost: Column, k: int = 1, **bounds) -> DataFrame:
    """The ``k`` labels of least ``cost`` on a field's page; ``cost`` speaks of columns ``fb`` and ``lb`` (boxes). ``bounds`` are those of ``spatial.k_nearest``."""
    f = fields.select(page, field_key, F.col("box").alias("fb"))
    found = spatial.k_nearest(f, labels.select(page, label_key, F.col("box").alias("lb")), [page], field_key, label_key, F.round(cost, 6), k, **bounds)
    return found.select(page, field_key, label_key, "rank", "cost")


def overlapping(boxes: DataFrame, page: str, key: str, least: float) -> DataFrame:
    """Pairs of boxes of one page with an intersection over union of at least ``least``: met cell by cell, each pair once."""
    from fieldloom.operators.catalogue import touching

    met = touching(boxes.select(page, F.col(key).alias("left"), F.col("box").alias("lb")), boxes.select(page, F.col(key).alias("right"), F.col("box").alias("rb")), page)
    value = F.round(numeric.iou(F.col("lb"), F.col("rb")), 6)
    return met.filter("left < right").select(page, "left", "right", value.alias("iou")).filter(F.col("iou") >= least)


def constraint_violations(selected: DataFrame, parents: DataFrame, exclusive: DataFrame) -> DataFrame:
    """doc, code, kind, other: a selected code without its parent, or beside one it excludes.

    ``selected``: doc, code; ``parents``: code, parent; ``exclusive``: code, other.
    """
    chosen = selected.select("doc", "code").distinct()
    needs = chosen.join(parents, "code").select("doc", "code", F.col("parent").alias("other"))
    present = chosen.withColumnRenamed("code", "other")
    missing = needs.join(present, ["doc", "other"], "left_anti").withColumn("kind", F.lit("missing-parent"))
    clash = chosen.join(exclusive, "code").join(present, ["doc", "other"], "left_semi").withColumn("kind", F.lit("exclusive"))
    names = ["doc", "code", "kind", "other"]
    return missing.select(*names).unionByName(clash.select(*names))


def sibling_violations(selected: DataFrame, needs: DataFrame, members: DataFrame) -> DataFrame:
    """doc, code, kind, other: a selected code that lacks one of the siblings that it requires.

    ``selected``: doc, code; ``needs``: code, sibling_group (a code may need several); ``members``: sibling_group, code. Siblings are groups and their members, never pairs of codes. A document's selected
    members are counted first: complete groups go before any member is looked at.
    """
    chosen = selected.select("doc", "code").distinct()
    asked = chosen.join(needs, "code").select("doc", "code", "sibling_group").distinct()
    members = members.select("sibling_group", F.col("code").alias("other")).distinct()
    sizes = members.groupBy("sibling_group").agg(F.count("*").alias("_all"))
    present = chosen.withColumnRenamed("code", "other")
    have = present.join(members, "other").groupBy("doc", "sibling_group").agg(F.count("*").alias("_have"))
    groups = asked.select("doc", "sibling_group").distinct().join(sizes, "sibling_group").join(have, ["doc", "sibling_group"], "left")
    short = groups.filter(F.coalesce("_have", F.lit(0)) < F.col("_all")).select("doc", "sibling_group")
    missing = short.join(members, "sibling_group").join(present, ["doc", "other"], "left_anti")
    out = asked.join(missing, ["doc", "sibling_group"]).filter("code <> other")
    return out.select("doc", "code", F.lit("missing-sibling").alias("kind"), "other").distinct()
