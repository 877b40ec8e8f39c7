"""Codes, namespaces and graphs: ontologies, aliases, adapters, families, conflicts, memory, submissions.

Code tables (aliases, bundles, prototypes) are tables or stated lists; documents meet them by equi-joins or as expressions over each row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions import numeric
from fieldloom.operators import joins
from fieldloom.operators.rows import first_wins

#: Weights of graph edges by kind, and of conflict classes.
EDGE_WEIGHTS = {"parent": 0.9, "carrier": 0.8, "fusion": 0.7, "memory": 0.6}
CONFLICT_WEIGHTS = {"code": 1.0, "type": 0.8, "value": 0.6}


# --- graph ---------------------------------------------------------------------------------------


def property_graph(parts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of edge tables (src, src_kind, dst, dst_kind) by the kind of their edges; the strongest edge of a pair and kind stays.

    nodes: id, kind, degree; edges: src, dst, kind, weight.
    """
    all_edges = None
    for kind, df in parts.items():
        held = df.select("src", "src_kind", "dst", "dst_kind", F.lit(kind).alias("kind"), F.lit(EDGE_WEIGHTS[kind]).alias("weight"))
        all_edges = held if all_edges is None else all_edges.unionByName(held)
    edges = all_edges.filter("src <> dst").groupBy("src", "src_kind", "dst", "dst_kind", "kind").agg(F.max("weight").alias("weight"))
    ends = edges.select(F.col("src").alias("id"), F.col("src_kind").alias("kind")).unionByName(edges.select(F.col("dst").alias("id"), F.col("dst_kind").alias("kind")))
    return ends.groupBy("id", "kind").agg(F.count("*").alias("degree")), edges.select("src", "dst", "kind", "weight")


def content_sum(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, content: a sum over the rows' digests, the same in every order of rows."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    part = F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(part).alias("content"))


def ontology_links(entries: DataFrame, hints: DataFrame, asked: Column) -> DataFrame:
    """id, kind, other: entries that own a token which a rule calls for beside one of the asking entry's own; ``child`` inverts ``parent``.

    ``entries``: id, tokens; ``hints``: token, kind, hint. Entries that are ``asked`` are the stated query set; all may answer. What an entry calls for, and what it owns
    of what is called for, are sets: distinct sets meet and stand for their entries.
    """
    tokens = entries.select("id", F.explode("tokens").alias("token"))
    wanted = tokens.filter(asked).join(hints, "token").select("id", "kind", F.col("hint").alias("token"))
    askers, called = joins.token_classes(wanted, ["id", "kind"])
    answers = tokens.join(hints.select(F.col("hint").alias("token")).distinct(), "token").select(F.col("id").alias("other"), "token")
    owners, owned = joins.token_classes(answers, ["other"])
    pairs = joins.class_pairs(called, owned)
    links = joins.of_classes(pairs, askers, owners).filter("id <> other").select("id", "kind", "other")
    parents = joins.of_classes(pairs, askers.filter("kind = 'parent'"), owners).filter("id <> other")
    return links.unionByName(parents.select(F.col("other").alias("id"), F.lit("child").alias("kind"), F.col("id").alias("other")))


def equivalence(codes: DataFrame, roots: DataFrame, code: str) -> DataFrame:
    """code, canonical, group_id, size: a code's component (node, root); an unknown code is a group of its own.

    The id is the hash of the sorted codes, found once a group and joined to its members.
    """
    codes_of = F.array_sort(F.collect_set("node"))
    groups = roots.groupBy("root").agg(numeric.fnv1a(F.array_join(codes_of, "|")).alias("group_id"), F.size(codes_of).alias("size"))
    known = roots.join(groups, "root").select(F.col("node").alias(code), "root", "group_id", "size")
    met = codes.select(code).distinct().join(known, code, "left")
    return met.select(code, F.coalesce("root", F.col(code)).alias("canonical"), F.coalesce("group_id", numeric.fnv1a(F.col(code))).alias("group_id"), F.coalesce("size", F.lit(1)).alias("size"))


def arbitrated(candidates: DataFrame, bundles: DataFrame, code: str, default: str) -> DataFrame:
    """Adds ``namespace`` of highest precedence that holds the code (``default`` without one), ``overridden`` and ``namespace_score``.

    ``bundles``: code, namespace, precedence.
    """
    held = bundles.groupBy(code).agg(F.max(F.struct("precedence", "namespace")).alias("_best"), F.array_sort(F.collect_set("namespace")).alias("_all"))
    met = candidates.join(held, code, "left")
    name = F.coalesce("_best.namespace", F.lit(default))
    return met.withColumns({"namespace": name, "overridden": F.coalesce(F.array_except("_all", F.array(name)), F.array().cast("array<string>")), "namespace_score": F.round(F.coalesce(F.col("_best.precedence"), F.lit(0)) / 300, 6)}).drop("_best", "_all")


def harmonisation(bundles: DataFrame, code: str, meaning: str) -> DataFrame:
    """Pairs of namespaces (left < right), the codes both hold, and how many of these mean different things."""
    a = bundles.select(code, F.col("namespace").alias("left"), F.col(meaning).alias("_a"))
    b = bundles.select(code, F.col("namespace").alias("right"), F.col(meaning).alias("_b"))
    return a.join(b, code).filter("left < right").groupBy("left", "right").agg(F.count("*").alias("shared"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("incompatible"))


def lattice(df: DataFrame, key: str, items: str, radius: int = 1, window: int = 3) -> DataFrame:
    """key, src, dst, kind: ``near`` edges between tokens within ``radius`` places and ``span`` edges between the ends of windows, each once."""
    each = df.select(key, F.posexplode(items).alias("_at", "src"), F.col(items).alias("_all"))
    near = each.withColumn("dst", F.explode(F.slice(F.col("_all"), F.col("_at") + 2, F.lit(radius)))).withColumn("kind", F.lit("near"))
    span = each.filter(F.col("_at") + window <= F.size("_all")).withColumns({"dst": F.element_at("_all", F.col("_at") + window), "kind": F.lit("span")})
    names = [key, "src", "dst", "kind"]
    return near.select(*names).unionByName(span.select(*names)).filter("src <> dst").distinct()


def projected(candidates: DataFrame, aliases: DataFrame, key: str, alias: str, ordinal: str, role: str) -> DataFrame:
    """Adds node, status and ``place``: canonical nodes first, then dictionary-only codes, sections last, each in input order; ``chosen`` is the
    first selectable of a key.

    ``aliases``: alias, node, node_role, section. A node of another role than the row's (when both have one) is blocked.
    """
    met = candidates.join(aliases, alias, "left")
    blocked = F.col(role).isNotNull() & F.col("node_role").isNotNull() & (F.col(role) != F.col("node_role"))
    status = F.when(F.col("node").isNull(), "dictionary-only").when(blocked, "blocked").when(F.col("section"), "section").otherwise("canonical")
    met = met.withColumn("status", status)
    weight = F.when(F.col("status") == "canonical", 0).when(F.col("status") == "dictionary-only", 1).when(F.col("status") == "section", 2).otherwise(3)
    w = Window.partitionBy(key)
    met = met.withColumn("place", F.row_number().over(w.orderBy(weight, ordinal)))
    return met.withColumn("chosen", (F.col("place") == 1) & (F.col("status") != "blocked")).drop("node_role", "section")


def assert_chosen_first(df: DataFrame, key: str, code: str, chosen: str) -> DataFrame:
    """``df`` with a check: a query fails where a key's chosen code is not that of its first selectable row (``place`` 1)."""
    first = F.max(F.when(F.col("place") == 1, F.col(code))).over(Window.partitionBy(key))
    fault = F.concat(F.lit("the chosen code is not the first selectable one for "), F.col(key).cast("string"))
    sound = F.coalesce(~F.col(chosen) | (F.col(code) == F.col("_first")), F.lit(True))
    return df.withColumn("_first", first).filter(F.when(sound, True).otherwise(F.raise_error(fault).cast("boolean"))).drop("_first")


def sections(df: DataFrame, page: str, node: str, instance: str, ordinal: str) -> DataFrame:
    """page, node, instance of every section occurrence, once, with the ordinal of its first row."""
    return df.filter(F.col(node).isNotNull()).groupBy(page, node, instance).agg(F.min(ordinal).alias(ordinal))


def broken_signatures(bundles: DataFrame, key: str, columns: Sequence[str], stated: DataFrame) -> DataFrame:
    """key and both sums of bundles whose content does not have the stated sum (key, content)."""
    found = content_sum(bundles, columns, [key]).select(key, F.col("content").alias("found"))
    both = found.join(stated.select(key, F.col("content").alias("stated")), key, "full_outer")
    return both.filter(~F.col("found").eqNullSafe(F.col("stated")))


# --- adapters and generalisations ----------------------------------------------------------------


@dataclass(frozen=True)
class AdapterNode:
    """A carrier's field: its code there, the codes it equals, and words of its label."""

    carrier: str
    code: str
    equals: tuple[str, ...]
    aliases: tuple[str, ...]
    precedence: int


def adapted(df: DataFrame, code: str, label: Column, nodes: Sequence[AdapterNode], forced: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """carrier, carrier_code, mapped_code, carrier_confidence: the first node in order that equals the code or names it; else the default."""
    low, tries = F.lower(label), []
    for n in nodes:
        equal = F.col(code).isin(*n.equals) if n.equals else F.lit(False)
        named = F.lit(False)
        for word in n.aliases:
            named = named | low.contains(word.lower())
        to = (forced or {}).get((n.carrier, n.code)) or (n.equals[0] if n.equals else None)
        sure = F.least(F.lit(1.0), F.when(equal, 0.7).otherwise(0.45) + F.when(named, 0.2).otherwise(0.0) + n.precedence / 1000)
        tries.append(F.when(equal | named, F.struct(F.lit(n.carrier).alias("a"), F.lit(n.code).alias("b"), F.coalesce(F.lit(to), F.col(code)).alias("c"), F.round(sure, 6).alias("d"))))
    tries.append(F.struct(F.lit("carrier-default").alias("a"), F.col(code).alias("b"), F.col(code).alias("c"), F.lit(0.0).alias("d")))
    found = df.withColumn("_m", F.coalesce(*tries))
    return found.withColumns({"carrier": F.col("_m.a"), "carrier_code": F.col("_m.b"), "mapped_code": F.col("_m.c"), "carrier_confidence": F.col("_m.d")}).drop("_m")


def geometry_signature(box: Column, grid: int = 20) -> Column:
    """A box on a grid, as text."""
    at = lambda v: (F.floor(v / grid + 0.5) * grid).cast("int").cast("string")
    return F.concat_ws(":", at(box["x"]), at(box["y"]), at(box["width"]), at(box["height"]))


def carrier_signals(df: DataFrame, box: Column, tokens: Column, profiles: DataFrame, words: Sequence[str]) -> DataFrame:
    """``carrier_score``: 0.04 where the box's signature is in a profile (signature), 0.045 for a stated word, both capped at 0.1."""
    known = profiles.select(F.col("signature").alias("_sig")).distinct().withColumn("_in", F.lit(True))
    met = df.withColumn("_sig", geometry_signature(box)).join(known, "_sig", "left")
    word = F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
    return met.withColumn("carrier_score", F.round(F.least(F.lit(0.1), F.when(F.col("_in"), 0.04).otherwise(0.0) + F.when(word, 0.045).otherwise(0.0)), 6)).drop("_sig", "_in")


def generalised(df: DataFrame, code: str, value: Column, signature: Column, clusters: DataFrame, exceptions: DataFrame) -> DataFrame:
    """``cluster_score`` and ``excepted``: a code's clusters (code, pattern, signature) that fit by text or place give 0.05 or 0.04, up to 0.1;
    an exception of the code (code, pattern) that fits turns them off.
    """
    by_code = clusters.groupBy(code).agg(F.collect_list(F.struct("pattern", "signature")).alias("_clusters"))
    held = exceptions.groupBy(code).agg(F.collect_list("pattern").alias("_exceptions"))
    met = df.join(by_code, code, "left").join(held, code, "left")
    excepted = F.coalesce(F.exists("_exceptions", lambda p: F.regexp(value, p)), F.lit(False))
    text_hit = F.coalesce(F.exists("_clusters", lambda c: F.regexp(value, c["pattern"])), F.lit(False))
    place_hit = F.coalesce(F.exists("_clusters", lambda c: c["signature"] == signature), F.lit(False))
    score = F.when(excepted, 0.0).otherwise(F.least(F.lit(0.1), F.when(text_hit, 0.05).otherwise(0.0) + F.when(place_hit, 0.04).otherwise(0.0)))
    return met.withColumns({"excepted": excepted, "cluster_score": F.round(score, 6)}).drop("_clusters", "_exceptions")


def best_suggestion(queries: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, code, confidence: the best entry (key, code, score, rank 1) of each query, ``UNKNOWN`` at 0.5 without one."""
    best = found.filter("rank = 1").select(key, "code", "score")
    sure = F.when(F.col("score").isNotNull(), F.least(F.lit(0.99), 0.5 + F.col("score") / 300)).otherwise(0.5)
    return queries.select(key).distinct().join(best, key, "left").select(key, F.coalesce("code", F.lit("UNKNOWN")).alias("code"), F.round(sure, 6).alias("confidence"))


# --- families ------------------------------------------------------------------------------------


def hashed_features(df: DataFrame, key: str, features: str, size: int = 16) -> DataFrame:
    """key, vector: signed feature hashing; a feature's FNV hash gives its place (mod ``size``) and, by bit 8, its sign. Unit length, zero-safe."""
    code = F.conv(numeric.fnv1a(F.col("_f")), 16, 10).cast("long")
    each = df.select(key, F.explode(features).alias("_f")).withColumn("_h", code)
    sums = each.groupBy(key, (F.col("_h") % size).cast("int").alias("_i")).agg(F.sum(F.when(F.shiftright("_h", 8).bitwiseAND(F.lit(1)) == 0, 1).otherwise(-1)).alias("_v"))
    held = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0)).cast("double"))
    return df.select(key).distinct().join(held, key, "left").select(key, numeric.unit_vector(F.when(F.col("_m").isNull(), F.array_repeat(F.lit(0.0), size)).otherwise(dense)).alias("vector"))


def sha_features(df: DataFrame, key: str, features: str, size: int = 64) -> DataFrame:
    """key, place, value: the same with SHA-256: the first eight hex digits give the place, the next two the sign."""
    digest = F.sha2(F.col("_f"), 256)
    number = lambda a, n: F.conv(F.substring(digest, a, n), 16, 10).cast("long")
    each = df.select(key, F.explode(features).alias("_f")).select(key, (number(1, 8) % size).cast("int").alias("place"), F.when(number(9, 2) % 2 == 0, 1).otherwise(-1).alias("_s"))
    return each.groupBy(key, "place").agg(F.sum("_s").alias("value")).filter("value <> 0")


@dataclass(frozen=True)
class Prototype:
    """A form family: words of its texts, beginnings of its codes, and its unit vector."""

    family: str
    keywords: tuple[str, ...]
    prefixes: tuple[str, ...]
    vector: tuple[float, ...]


def classified(df: DataFrame, value: Column, codes: Column, name: Column, vector: Column, prototypes: Sequence[Prototype]) -> DataFrame:
    """family and family_score: .16 a keyword, .08 a code prefix, .35 of the cosine, .25 for the family in the name, at most 1; below .2 ``unclassified``."""
    low, scored = F.lower(value), []
    for p in prototypes:
        score = F.lit(0.0)
        for word in p.keywords:
            score = score + F.when(low.contains(word), 0.16).otherwise(0.0)
        for prefix in p.prefixes:
            score = score + F.when(F.exists(codes, lambda c: F.lower(c).startswith(prefix.lower())), 0.08).otherwise(0.0)  # noqa: B023
        near = F.greatest(F.lit(0.0), numeric.dot(vector, F.array(*map(F.lit, p.vector)))) if p.vector else F.lit(0.0)
        score = score + near * 0.35 + F.when(F.lower(name).contains(p.family.replace("-", " ")), 0.25).otherwise(0.0)
        scored.append(F.struct((-F.round(F.least(F.lit(1.0), score), 6)).alias("s"), F.lit(p.family).alias("f")))
    best = df.withColumn("_b", F.array_min(F.array(*scored)))
    return best.withColumns({"family": F.when(-F.col("_b.s") >= 0.2, F.col("_b.f")).otherwise("unclassified"), "family_score": -F.col("_b.s")}).drop("_b")


def role_scores(df: DataFrame, key: str, tokens: str, box: str, weights: DataFrame, centres: DataFrame, least: float = 0.08) -> DataFrame:
    """key, role: the role of highest .7 token weights + .3 nearness; null below ``least``. A block meets the roles that its tokens or page know.

    ``weights``: token, role, weight; ``centres``: role, cx, cy, sx, sy (few rows).
    """
    words = df.select(key, F.explode(tokens).alias("token")).join(weights, "token").groupBy(key, "role").agg(F.sum("weight").alias("_t"))
    roles = centres.agg(F.collect_list(F.struct("role", "cx", "cy", "sx", "sy")).alias("_roles"))
    placed = df.select(key, F.col(box).alias("_b")).withColumn("_one", F.lit(1)).join(F.broadcast(roles.withColumn("_one", F.lit(1))), "_one").select(key, "_b", F.explode("_roles").alias("_r"))
    far = F.sqrt(F.pow((F.col("_b.x") - F.col("_r.cx")) / F.greatest(F.lit(1.0), F.col("_r.sx")), 2) + F.pow((F.col("_b.y") - F.col("_r.cy")) / F.greatest(F.lit(1.0), F.col("_r.sy")), 2))
    near = placed.select(key, F.col("_r.role").alias("role"), F.greatest(F.lit(0.0), 1 - far).alias("_g"))
    both = near.join(words, [key, "role"], "left").withColumn("_s", F.round(F.coalesce("_t", F.lit(0.0)) * 0.7 + F.col("_g") * 0.3, 6))
    best = both.groupBy(key).agg(F.min(F.struct((-F.col("_s")).alias("s"), "role")).alias("_b"))
    return best.select(key, F.when(-F.col("_b.s") >= least, F.col("_b.role")).alias("role"))


def pair_score(name: Column, form: Column, layout: Column, penalty: Column) -> Column:
    """A pair's score from what is known of it (null: unknown): name similarity, equal form number, layout similarity; less a penalty."""
    parts = [(0.45, name), (0.35, form), (0.2, layout)]
    total = sum((F.when(v.isNotNull(), w).otherwise(0.0) for w, v in parts), F.lit(0.0))
    found = sum((F.coalesce(v, F.lit(0.0)) * w for w, v in parts), F.lit(0.0))
    bonus = F.when((name >= 0.9) & (form == 1), 0.05).otherwise(0.0)
    return F.round(numeric.clamp01(F.when(total > 0, found / total).otherwise(0.0) + bonus - F.coalesce(penalty, F.lit(0.0))), 6)


# --- conflicts and memory ------------------------------------------------------------------------


def prioritised(conflicts: DataFrame, memory: DataFrame) -> DataFrame:
    """Adds severity (.6 of the class weight, .4 of the recurrence over ten) and priority. ``memory``: group, recurrence."""
    weight = F.lit(0.4)
    for name, w in CONFLICT_WEIGHTS.items():
        weight = F.when(F.col("class") == name, w).otherwise(weight)
    met = conflicts.join(memory, "group", "left").withColumn("recurrence", F.coalesce("recurrence", F.lit(0.0)))
    met = met.withColumn("severity", F.round(weight * 0.6 + F.least(F.lit(1.0), F.col("recurrence") / 10) * 0.4, 6))
    return met.withColumn("priority", F.when(F.col("severity") >= 0.75, "high").when(F.col("severity") >= 0.45, "medium").otherwise("low"))


def recommended(profiles: DataFrame, memory: DataFrame, conflicts: DataFrame) -> DataFrame:
    """group, code, confidence, priority: .65 fused + .35 stability - .2 severity. ``profiles``: group, code, fused; ``memory``: group, stability;
    ``conflicts``: group, severity."""
    worst = conflicts.groupBy("group").agg(F.max("severity").alias("severity"))
    met = profiles.join(memory.select("group", "stability"), "group", "left").join(worst, "group", "left").fillna(0.0, ["stability", "severity"])
    met = met.withColumn("confidence", F.round(numeric.clamp01(F.col("fused") * 0.65 + F.col("stability") * 0.35 - F.col("severity") * 0.2), 6))
    c, s = F.col("confidence"), F.col("severity")
    return met.select("group", "code", "confidence", F.when((c < 0.55) | (s >= 0.7), "high").when((c < 0.75) | (s >= 0.45), "medium").otherwise("low").alias("priority"))


def resolved(conflicts: DataFrame, candidates: DataFrame, overrides: DataFrame) -> DataFrame:
    """conflict, code, score, reason: an override decides, else the best candidate of the conflict's blocks.

    ``conflicts``: conflict, blocks; ``candidates``: block, code, base, namespace_score, graph, rule_delta, hard; ``overrides``: conflict, forced, ordinal
    (the first counts).
    """
    each = conflicts.select("conflict", F.explode("blocks").alias("block")).join(candidates, "block")
    score = F.round(F.col("base") * 0.72 + F.col("namespace_score") * 0.12 + F.col("graph") * 0.08 + F.col("rule_delta") * 0.08 - F.when(F.col("hard"), 0.2).otherwise(0.0), 6)
    best = each.groupBy("conflict").agg(F.min(F.struct((-score).alias("s"), "code")).alias("_b"))
    first = overrides.groupBy("conflict").agg(F.min_by("forced", "ordinal").alias("_f"))
    met = conflicts.select("conflict").join(best, "conflict", "left").join(first, "conflict", "left")
    reason = F.when(F.col("_f").isNotNull(), "reviewer-override").when(F.col("_b").isNotNull(), "best-score").otherwise("unresolved")
    return met.select("conflict", F.coalesce("_f", "_b.code").alias("code"), F.when(F.col("_f").isNotNull(), 1.0).otherwise(-F.col("_b.s")).alias("score"), reason.alias("reason"))


def rationale(df: DataFrame, keys: Sequence[str], gap: float = 0.05) -> DataFrame:
    """keys, candidates (sorted ``code=confidence`` texts), ambiguous (top two within ``gap``), evidence (distinct sources, sorted)."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "code")))
    found = df.groupBy(*keys).agg(ranked.alias("_r"), F.array_sort(F.collect_set("source")).alias("evidence"))
    shown = F.transform("_r", lambda r: F.concat(r["code"], F.lit("="), F.format_string("%.3f", -r["c"])))
    close = (F.size("_r") > 1) & (F.round(F.element_at("_r", 2)["c"] - F.element_at("_r", 1)["c"], 9) <= gap)
    return found.select(*keys, shown.alias("candidates"), F.coalesce(close, F.lit(False)).alias("ambiguous"), "evidence")


def replayed(snapshot: DataFrame, decisions: DataFrame) -> DataFrame:
    """group, code, lineage: the snapshot with the last decision of each group pinned, and all decisions of it in order added to the lineage.

    ``snapshot``: group, code, lineage (array); ``decisions``: group, id, pinned.
    """
    held = decisions.groupBy("group").agg(F.max_by("pinned", "id").alias("_p"), F.transform(F.array_sort(F.collect_list(F.struct("id", "pinned"))), lambda d: F.concat(d["id"].cast("string"), F.lit(":"), d["pinned"])).alias("_l"))
    met = snapshot.join(held, "group", "left")
    return met.select("group", F.coalesce("_p", "code").alias("code"), F.concat("lineage", F.coalesce("_l", F.array().cast("array<string>"))).alias("lineage"))


def snapshot_version(rows: DataFrame, columns: Sequence[str], keys: Sequence[str], before: DataFrame) -> DataFrame:
    """keys, n, content, version: one more than the last version where the content changed, the last one where it did not.

    ``before``: keys, content, version.
    """
    now = content_sum(rows, columns, keys)
    last = before.select(*keys, F.col("content").alias("_c"), F.col("version").alias("_v"))
    met = now.join(last, list(keys), "left")
    version = F.when(F.col("_v").isNull(), 1).when(F.col("_c") == F.col("content"), F.col("_v")).otherwise(F.col("_v") + 1)
    return met.select(*keys, "n", "content", version.alias("version"))


# --- submissions ---------------------------------------------------------------------------------


def idempotent(requests: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """Adds ``outcome`` and ``response``: ``replay`` with the stored answer for an equal request, ``conflict`` for another one under its key,
    ``fresh`` else; of equal keys in one batch the first (``ordinal``) is fresh. ``stored``: key, digest, response."""
    known = stored.select(key, F.col(digest).alias("_d"), F.col("response").alias("_r"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("ordinal"))
    first = F.first(digest).over(Window.partitionBy(key).orderBy("ordinal"))
    met = requests.withColumns({"_n": place, "_first": first}).join(known, key, "left")
    before = F.coalesce("_d", F.when(F.col("_n") > 1, F.col("_first")))
    outcome = F.when(before.isNull(), "fresh").when(before == F.col(digest), "replay").otherwise("conflict")
    return met.withColumns({"outcome": outcome, "response": F.when(outcome == "replay", F.col("_r"))}).drop("_n", "_first", "_d", "_r")


def submission_step(submissions: DataFrame, answers: DataFrame, limit: int = 5, wait_s: int = 30) -> DataFrame:
    """The next state of each submission after its gate and the carrier's answer; one row each, so a step is a join and an expression.

    ``submissions``: id, ready, open, attempts, at (timestamp); ``answers``: id, ok (null or missing: none yet). status: blocked (gate), held (breaker open),
    sent, accepted, retry (with ``due``), dead.
    """
    met = submissions.join(answers.groupBy("id").agg(F.max(F.col("ok").cast("int")).alias("_ok")), "id", "left")
    tried = F.col("attempts") + (F.col("_ok").isNotNull() & F.col("ready") & F.col("open")).cast("int")
    status = (
        F.when(~F.col("ready"), "blocked").when(~F.col("open"), "held").when(F.col("_ok").isNull(), "sent").when(F.col("_ok") == 1, "accepted").when(tried >= limit, "dead").otherwise("retry")
    )
    met = met.withColumns({"status": status, "attempts": tried})
    return met.withColumn("due", F.when(F.col("status") == "retry", F.col("at") + F.expr(f"INTERVAL {int(wait_s)} SECONDS"))).drop("_ok", "ready", "open")


def edit_log(edits: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """key, step, before, after: every real change of a value in order; equal neighbours are no edit."""
    w = Window.partitionBy(key).orderBy(ordinal)
    met = edits.withColumns({"before": F.lag(value).over(w), "_first": F.row_number().over(w) == 1}).filter(F.col("_first") | ~F.col("before").eqNullSafe(F.col(value)))
    return met.withColumn("step", F.row_number().over(w)).select(key, "step", "before", F.col(value).alias("after"))


def cluster_faults(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """label, nearest, similarity: labels whose mean vector (of odd rows) is nearest to the mean (of even rows) of another label.

    ``rows``: key, label, vector. Labels are few: their number is checked.
    """
    most = 1000
    half = rows.select(label, (F.col("key") % 2).alias("_half"), F.posexplode(vector).alias("_i", "_x"))
    means = half.groupBy(label, "_half", "_i").agg(F.avg("_x").alias("_x")).groupBy(label, "_half").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("_v"))
    own = means.filter("_half = 1").select(label, F.col("_v").alias("_own"), F.lit(1).alias("_one"))
    others = means.filter("_half = 0").agg(F.collect_list(F.struct(F.col(label).alias("nearest"), "_v")).alias("_all")).withColumn("_one", F.lit(1))
    others = others.filter(F.when(F.size("_all") <= most, True).otherwise(F.raise_error(F.lit(f"more than {most} labels")).cast("boolean")))
    met = own.join(F.broadcast(others), "_one").select(label, "_own", F.explode("_all").alias("_o"))
    met = met.withColumn("similarity", F.round(numeric.cosine(F.col("_own"), F.col("_o._v")), 6)).withColumn("nearest", F.col("_o.nearest"))
    return first_wins(met, [label], [F.col("similarity").desc(), F.col("nearest")]).select(label, "nearest", "similarity")
