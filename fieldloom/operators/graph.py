"""Property graph operators over node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import joins
from fieldloom.storage import stored


def neighbours(nodes: DataFrame, edges: DataFrame, incoming_only: bool = True) -> DataFrame:
    """node, kind, sources: one step over edges (src, dst, kind) into each node; both ways if asked."""
    into = edges.select(F.col("dst").alias("node"), F.col("src").alias("source"), "kind")
    if not incoming_only:
        into = into.unionByName(edges.select(F.col("src").alias("node"), F.col("dst").alias("source"), "kind"))
    found = into.join(nodes.select("node"), "node", "left_semi").distinct()
    return found.groupBy("node", "kind").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable over undirected edges (src, dst).

    Each round takes the least root of a node and its neighbours and then jumps to that root's root; rounds end when
    nothing changes. Every round is a written table, so a lost executor never recomputes earlier ones.
    """
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"))
    both = stored(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    roots = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("other"), F.col("root").alias("seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        low = roots.join(near, "node", "left").select("node", F.least("root", "seen").alias("low"), F.col("root").alias("before"))
        jump = roots.select(F.col("node").alias("low"), F.col("root").alias("beyond"))
        after = stored(low.join(jump, "low", "left").select("node", F.least("low", "beyond").alias("root"), "before"))
        roots = after.select("node", "root")
        if not after.filter("root <> before").limit(1).count():
            return roots


def ontology(entries: DataFrame, key: str, items: str, asked: Column | None = None) -> DataFrame:
    """parent, child: an entry whose tokens are all among another's more numerous tokens is that one's parent.

    Distinct token sets meet by the rarest token of the fewer, are verified, and stand for their entries, so no pair is made for a common token alone. ``asked`` (over
    ``id``) states the parents.
    """
    each = entries.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(items)).alias("tokens")).filter(F.size("tokens") > 0)
    # an id may have several token sets: its class is all of them, so that it meets another once
    held, classes = joins.classes_of(each.groupBy("id").agg(F.sort_array(F.collect_set("tokens")).alias("tokens")), ["id"])
    held = stored(held, "entries")
    spread = classes.select("class", F.explode("tokens").alias("tokens")).withColumn("token", F.explode("tokens"))
    counts = spread.groupBy("token").agg(F.count("*").alias("n"))
    parents = held if asked is None else held.filter(asked)
    rare = spread.join(parents.select("class").distinct(), "class").join(counts, "token").groupBy(F.col("class").alias("_l"), F.col("tokens").alias("few")).agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    met = rare.join(spread.select(F.col("class").alias("_r"), "token", F.col("tokens").alias("many")), "token")
    pairs = met.filter((F.size("few") < F.size("many")) & (F.size(F.array_except("few", "many")) == 0)).select("_l", "_r").distinct()
    return joins.of_classes(pairs, parents.withColumnRenamed("id", "parent"), held.withColumnRenamed("id", "child")).select("parent", "child")


def inference_scores(edges: DataFrame, weights: dict[str, float], needed: tuple[str, ...]) -> DataFrame:
    """node, typed_score, abstain, both_score of (src, dst, kind) edges.

    typed_score: each kind of incoming edge gives its weight once; abstain: none of the ``needed`` kinds comes in; both_score: neighbours on either
    side, up to three, and edges, up to four, half each.
    """
    into = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "kind", F.lit(True).alias("incoming"))
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "kind", F.lit(False).alias("incoming"))
    # one row a node, neighbour, kind and direction; neighbours are counted by an aggregate of their own
    ends = into.unionByName(out).distinct()
    typed = ends.groupBy("node").agg(F.count("*").alias("_m"), *[F.max((F.col("incoming") & (F.col("kind") == k)).cast("int")).alias(f"_k{i}") for i, k in enumerate(weights)])
    others = ends.select("node", "other").distinct().groupBy("node").agg(F.count("*").alias("_n"))
    score = sum((F.col(f"_k{i}") * w for i, w in enumerate(weights.values())), F.lit(0.0))
    none = sum((F.col(f"_k{i}") for i, k in enumerate(weights) if k in needed), F.lit(0)) == 0
    both = F.least(F.lit(1.0), F.col("_n") / 3) * 0.5 + F.least(F.lit(1.0), F.col("_m") / 4) * 0.5
    return typed.join(others, "node").select("node", F.round(F.least(F.lit(1.0), score), 6).alias("typed_score"), none.alias("abstain"), F.round(both, 6).alias("both_score"))
