"""Row operators: dedupe rules, ranking, fallback filters, ordered gaps and frames.

Everything is a window or an aggregate; a partition of a window is one document, page or key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.storage import SMALL_ROWS, stored


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def last_wins(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """One row per key, the last; ``ordinal`` becomes that of the key's first row."""
    keyed = Window.partitionBy(*keys)
    found = df.withColumns({"_first": F.min(ordinal).over(keyed), "_place": F.row_number().over(keyed.orderBy(F.col(ordinal).desc()))})
    return found.filter("_place = 1").withColumn(ordinal, F.col("_first")).drop("_first", "_place")


def max_wins(df: DataFrame, keys: Sequence[str], score: str, ordinal: str) -> DataFrame:
    """One row per key: the greatest score, the earlier among equals."""
    return first_wins(df, keys, [F.col(score).desc_nulls_last(), F.col(ordinal)])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def with_fallback(df: DataFrame, keys: Sequence[str], wanted: Column, least: int = 1, otherwise: Column | None = None) -> DataFrame:
    """The ``wanted`` rows of a key; where fewer than ``least`` exist, its rows that meet ``otherwise`` (all, if none is given)."""
    n = F.count_if(wanted).over(Window.partitionBy(*keys))
    loose = F.lit(True) if otherwise is None else otherwise
    return df.withColumn("_n", n).filter(F.when(F.col("_n") >= least, wanted).otherwise(loose)).drop("_n")


def gap_groups(df: DataFrame, keys: Sequence[str], order: str, limit: float, name: str = "run", least: int = 1) -> DataFrame:
    """Numbers runs: a new one begins where ``order`` grew by more than ``limit``; runs under ``least`` rows go."""
    w = Window.partitionBy(*keys).orderBy(order)
    opens = F.when(F.col(order) - F.lag(order).over(w) > limit, 1).otherwise(0)
    found = df.withColumn("_opens", opens).withColumn(name, F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")
    if least > 1:
        found = found.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, name))).filter(F.col("_n") >= least).drop("_n")
    return found


def neighbour_probe(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, cue: str, rows: int, within: float, name: str) -> DataFrame:
    """Whether any of the ``rows`` rows on either side, itself excluded, has ``cue`` at most ``within`` away in ``value``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    item = F.when(F.col(cue), F.col(value))
    sides = [F.collect_list(item).over(w.rowsBetween(-rows, -1)), F.collect_list(item).over(w.rowsBetween(1, rows))]
    return df.withColumn(name, F.exists(F.concat(*sides), lambda v: F.abs(v - F.col(value)) <= within))


def look_back(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, role: str, rows: int, within: float, name: str) -> DataFrame:
    """The row's own role, else the nearest role of the ``rows`` rows before with 0 <= distance <= ``within``; ties to the smaller name."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-rows, -1)
    past = F.collect_list(F.when(F.col(role).isNotNull(), F.struct(F.col(value).alias("v"), F.col(role).alias("r")))).over(w)
    near = F.filter(F.transform(past, lambda p: F.struct((F.col(value) - p["v"]).alias("d"), p["r"].alias("r"))), lambda p: (p["d"] >= 0) & (p["d"] <= within))
    return df.withColumn(name, F.coalesce(F.col(role), F.array_min(near)["r"]))


def history(df: DataFrame, keys: Sequence[str], order: str, value: str, keep: int = 12) -> DataFrame:
    """The last ``keep`` values of each key in order, and how many there were."""
    ranked = top_k(df, keys, [F.col(order).desc()], keep, "_back")
    n = df.groupBy(*keys).agg(F.count("*").alias("n_seen"))
    last = ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value)))), lambda s: s[value]).alias("history"))
    return n.join(last, list(keys))


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], fill: object = None) -> DataFrame:
    """Key by key and field by field: value before and after where they differ (null-safe; ``fill`` stands for missing)."""
    names = list(values)
    pick = lambda df, side: df.select(*keys, *[F.col(v).alias(f"{side}_{v}") for v in names])
    both = pick(left, "before").join(pick(right, "after"), list(keys), "full_outer")
    value = lambda side, v: F.coalesce(F.col(f"{side}_{v}"), F.lit(fill)) if fill is not None else F.col(f"{side}_{v}")
    fields = F.array(*[F.struct(F.lit(v).alias("field"), value("before", v).alias("before"), value("after", v).alias("after")) for v in names])
    return both.select(*keys, F.explode(fields).alias("f")).select(*keys, "f.*").filter(~F.col("before").eqNullSafe(F.col("after")))


def apply_overrides(df: DataFrame, overrides: DataFrame, key: str, ordinal: str, active: str) -> DataFrame:
    """The last override of a key deletes the row (not active), replaces it, or adds it."""
    last = top_k(overrides, [key], [F.col(ordinal).desc()], 1, "_place").drop("_place", ordinal)
    kept = df.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.filter(active).select(*df.columns))


def role_gate(df: DataFrame, keys: Sequence[str], code: str, similarity: str, role: Column, address: Column, prefixes: dict[str, str], margin: float = 0.08) -> DataFrame:
    """Candidates of a row's section role: unchanged without a role or a candidate of it; for an address prompt only that role's;
    otherwise those of the other role only where their similarity exceeds the role's best by more than ``margin``."""
    prefix = F
    for name, start in prefixes.items():
        prefix = prefix.when(role == name, start)
    df = df.withColumn("_prefix", prefix.otherwise(None))
    of_role = F.col(code).startswith(F.col("_prefix"))
    rival = F.greatest(*[(F.col(code).startswith(p) & (F.col("_prefix") != p)).cast("int") for p in prefixes.values()]) == 1
    best = F.max(F.when(of_role, F.col(similarity))).over(Window.partitionBy(*keys))
    df = df.withColumn("_best", best)
    kept = F.when(F.col("_prefix").isNull() | F.col("_best").isNull(), True).when(address, of_role).otherwise(~rival | (F.col(similarity) > F.col("_best") + margin))
    return df.filter(kept).drop("_prefix", "_best")


def denied(df: DataFrame, restricted: Column, scope: Column, excuse: Column) -> DataFrame:
    """Rows that are not ``restricted`` inside ``scope`` without an ``excuse``; a group may lose all its rows."""
    return df.filter(~F.coalesce(restricted & scope & ~excuse, F.lit(False)))


def allowed_codes(df: DataFrame, keys: Sequence[str], code: str, score: str, ordinal: str, extra: Column, k: int = 3, least: float = 0.42) -> DataFrame:
    """Candidates whose code is among the ``k`` highest scores of their key, or ``extra``; all (``relaxed``) where no score reaches ``least``."""
    group = Window.partitionBy(*keys)
    ranked = df.withColumns({"_rank": F.row_number().over(group.orderBy(F.col(score).desc(), ordinal)), "relaxed": F.max(score).over(group) < least})
    named = F.collect_set(F.when(F.col("_rank") <= k, F.col(code))).over(group)
    return ranked.withColumn("_codes", named).filter(F.array_contains("_codes", F.col(code)) | extra | F.col("relaxed")).drop("_rank", "_codes")


def exclusive_rows(df: DataFrame, doc: str, ordinal: str, code: str, excludes: dict[str, list[str]]) -> DataFrame:
    """The rows that are written: in order, a code excluded by one written before is left out. No window per code: one aggregate of first places.

    For rules in which no excluding code is excluded itself; a chain of rules depends on what was left out before (``ordered.exclusive_export``).
    """
    by: dict[str, list[str]] = {}
    for one, others in excludes.items():
        for other in others:
            by.setdefault(other, []).append(one)
    if set(by) & set(excludes):
        raise ValueError("an excluding code is excluded itself")
    w = Window.partitionBy(doc)
    barred = F.lit(False)
    for other, ones in by.items():
        first = F.min(F.when(F.col(code).isin(*ones), F.col(ordinal))).over(w)
        df = df.withColumn(f"_first_{len(df.columns)}", first)
        barred = barred | ((F.col(code) == other) & (F.col(ordinal) > F.col(df.columns[-1])))
    return df.filter(~F.coalesce(barred, F.lit(False))).drop(*[c for c in df.columns if c.startswith("_first_")])


def accepted(decisions: DataFrame, mappings: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, chosen and its first candidate's ordinal and score: accepted rows with a chosen code (of the decision, else of the mapping) that has
    a candidate. ``decisions``: keys, decision, chosen; ``mappings``: keys, fallback; ``candidates``: keys, code, ordinal, score.
    """
    chosen = F.coalesce(F.nullif(F.col("chosen"), F.lit("")), F.nullif(F.col("fallback"), F.lit("")))
    kept = decisions.filter("decision = 'accepted'").join(mappings, list(keys), "left").withColumn("chosen", chosen).filter("chosen is not null").select(*keys, "chosen")
    first = candidates.groupBy(*keys, "code").agg(F.min_by("score", "ordinal").alias("score"), F.min("ordinal").alias("ordinal")).withColumnRenamed("code", "chosen")
    return kept.join(first, [*keys, "chosen"])


def strictly_accepted(bindings: DataFrame, suppressed: DataFrame, key: str) -> DataFrame:
    """Bindings (mapping, label, field, candidate: decisions) that nothing speaks against."""
    sound = (F.col("mapping") == "accepted") & (F.coalesce("label", F.lit("")) != "rejected") & (F.col("field") == "accepted") & (F.coalesce("candidate", F.lit("")) != "rejected")
    return bindings.filter(sound).join(suppressed.select(key).distinct(), key, "left_anti")


def promoted(df: DataFrame, doc: str, value: str, code: str, confidence: str, ordinal: str, rules: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Post-pass over a document: of the rows whose text fits a rule (code, pattern, floor), the most confident gets the code and at least the floor.

    Rules come in order; a row takes the first that picks it. Adds ``promoted``.
    """
    low, picks = F.lower(F.col(value)), []
    for k, (to, pattern, floor) in enumerate(rules):
        fits = low.rlike(pattern)
        best = F.max(F.when(fits, F.struct(F.col(confidence), -F.col(ordinal)))).over(Window.partitionBy(doc))
        df = df.withColumn(f"_best_{k}", best)
        mine = fits & (F.struct(F.col(confidence), -F.col(ordinal)) == F.col(f"_best_{k}"))
        picks.append(F.when(F.coalesce(mine, F.lit(False)), F.struct(F.lit(to).alias("code"), F.lit(float(floor)).alias("floor"))))
    df = df.withColumn("_pick", F.coalesce(*picks))
    df = df.withColumns({"promoted": F.col("_pick").isNotNull(), code: F.coalesce("_pick.code", code), confidence: F.greatest(F.col(confidence), F.coalesce(F.col("_pick.floor"), F.lit(0.0)))})
    return df.drop("_pick", *[f"_best_{k}" for k in range(len(rules))])


def merge_maps(low: Column, high: Column) -> Column:
    """Both maps' entries; where both have a key, that of ``high``."""
    return F.map_zip_with(low, high, lambda _, a, b: F.coalesce(b, a))


def each_value(df: DataFrame, value: str, columns: dict[str, Column]) -> DataFrame:
    """Adds ``columns`` that depend on ``value`` alone: found once a distinct value while these are few, and on each row beyond."""
    values = stored(df.select(value).distinct(), "values")
    if values.count() > SMALL_ROWS:
        return df.withColumns(columns)
    known = values.withColumns(columns).withColumnRenamed(value, "_value")
    return df.join(F.broadcast(known), F.col(value).eqNullSafe(F.col("_value"))).drop("_value")
