"""Evaluation of mapped documents: quality reports, profiles, deltas, reconciliation, and what follows from rules.

Reports are one aggregate a key with conditional parts; ratios of nothing are 0. Rules and expectations are stated lists: they become
expressions over each row, never a join that makes pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.functions import numeric, text
from fieldloom.operators import spatial
from fieldloom.operators.rows import top_k
from fieldloom.storage import stored


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole, 0 where there is no whole."""
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(0.0)


def chosen_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], code: str, chosen: str) -> DataFrame:
    """keys, chosen, rank: the place of the chosen code's first candidate in order; null without one."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.groupBy(*keys).agg(F.first(chosen).alias(chosen), F.min(F.when(F.col(code) == F.col(chosen), F.col("_rank"))).alias("rank"))


def quality_report(fields: DataFrame, key: str, top_n: int = 3) -> DataFrame:
    """Coverage, accuracy, calibration, ranking quality and signal stability of each document.

    ``fields``: key, chosen, confidence, threshold, rank, expected, expected_rank, disagreement, weighted.
    """
    mapped, known = F.col("chosen").isNotNull(), F.col("expected").isNotNull()
    n, n_mapped, n_known = F.count("*"), F.count_if(mapped), F.count_if(known)
    low = mapped & (F.col("confidence") < F.col("threshold"))
    near = low & (F.col("confidence") >= F.greatest(F.lit(0.0), F.col("threshold") - 0.1))
    quality = F.when(mapped, numeric.clamp01(F.coalesce(1 / F.col("rank"), F.lit(0.0)) * F.when(F.col("threshold") > 0, F.col("confidence") / F.col("threshold")).otherwise(0.0))).otherwise(0.0)
    return fields.groupBy(key).agg(
        n.alias("fields"),
        n_mapped.alias("mapped"),
        ratio(n_mapped, n).alias("mapped_rate"),
        ratio(F.count_if(known & mapped & (F.col("chosen") == F.col("expected"))), n_known).alias("exact_accuracy"),
        ratio(F.count_if(known & (F.col("expected_rank") <= top_n)), n_known).alias("top_n_accuracy"),
        ratio(F.count_if(mapped & (F.col("rank") <= top_n)), n).alias("chosen_in_top_n"),
        ratio(F.count_if(mapped & (F.col("confidence") >= F.col("threshold"))), n).alias("calibrated"),
        F.count_if(low).alias("low_confidence"),
        F.count_if(near).alias("borderline"),
        ratio(F.count_if(F.col("disagreement")), n).alias("disagreement_rate"),
        ratio(F.sum(quality), n).alias("ranking_quality"),
        ratio(F.sum(F.when(mapped, numeric.clamp01(F.col("weighted"))).otherwise(0.0)), n).alias("signal_stability"),
    )


def family_bias(df: DataFrame, family: str, value: str, threshold: str) -> DataFrame:
    """Per family: rows, mean, and the share below their threshold."""
    return df.groupBy(family).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), ratio(F.count_if(F.col(value) < F.col(threshold)), F.count("*")).alias("below_rate"))


def cross_namespace(df: DataFrame, namespace: str, value: str) -> DataFrame:
    """Namespace means, the mean of all of them, and their mean absolute deviation from it."""
    each = df.groupBy(namespace).agg(F.avg(value).alias("mean"))
    # as many rows as there are namespaces
    everything = Window.partitionBy(F.lit(0))
    held = each.withColumn("overall", F.avg("mean").over(everything))
    return held.withColumn("deviation", F.avg(F.abs(F.col("mean") - F.col("overall"))).over(everything)).select(namespace, *[F.round(c, 6).alias(c) for c in ("mean", "overall", "deviation")])


@dataclass(frozen=True)
class Check:
    """A rule over a row: its condition (SQL), whether a failure blocks, and the score that it gives or takes."""

    name: str
    condition: str
    hard: bool = False
    impact: float = 0.0


def rule_scores(df: DataFrame, checks: Sequence[Check], forced: Column | None = None) -> DataFrame:
    """``score_delta`` (each impact, negative where the rule fails) and ``hard_failures`` (sorted names).

    ``forced``: a map of rule names to a verdict that takes the place of a rule's own in the failures.
    """
    delta, failures = F.lit(0.0), []
    for c in sorted(checks, key=lambda c: c.name):
        passed = F.coalesce(F.expr(c.condition), F.lit(False))
        delta = delta + F.when(passed, c.impact).otherwise(-c.impact)
        final = passed if forced is None else F.coalesce(forced[c.name], passed)
        if c.hard:
            failures.append(F.when(~final, c.name))
    none = F.array().cast("array<string>")
    return df.withColumns({"score_delta": F.round(delta, 6), "hard_failures": F.array_compact(F.array(*failures)) if failures else none})


def decision_rollup(df: DataFrame, key: str, score: str, blockers: Column, conflicts: Column, abstains: Column, overrides: DataFrame) -> DataFrame:
    """key, outcome, conditions: blockers, the score ladder, abstentions and conflicts; the last override of a key wins.

    ``overrides``: key, ordinal, forced.
    """
    each = df.groupBy(key).agg(F.max(score).alias("_score"), F.count_if(blockers).alias("_b"), F.count_if(conflicts).alias("_c"), F.count_if(abstains).alias("_a"))
    last = overrides.groupBy(key).agg(F.max_by("forced", "ordinal").alias("_forced"))
    s, conditional = F.col("_score"), (F.col("_score") >= 0.4) | (F.col("_c") > 0)
    outcome = F.when((F.col("_b") > 0) | (s >= 0.9), "decline").when((s >= 0.67) | (F.col("_a") > 0), "refer-to-underwriter").when(conditional, "accept-with-conditions").otherwise("accept")
    listed = F.array_compact(F.array(F.lit("additional-documentation"), F.when(F.col("_c") > 0, "rule-exception-review")))
    met = each.join(last, key, "left").withColumn("_own", outcome)
    return met.select(key, F.coalesce("_forced", "_own").alias("outcome"), F.when(F.col("_own") == "accept-with-conditions", listed).otherwise(F.array().cast("array<string>")).alias("conditions"))


def family_clusters(df: DataFrame, family: str, value: str, signature: str) -> DataFrame:
    """Per family: documents, mean confidence, and a hash of their signatures that does not depend on order.

    Code units are found a row, where it lies: what is left for a family's one task is to sort its signatures and to go through their units once.
    """
    each = df.withColumn("_signature", F.when(F.col(signature).isNotNull(), F.struct(F.col(signature).alias("text"), numeric.code_units(F.col(signature)).alias("units"))))
    bar = F.array(F.lit(ord("|")).cast("long"))
    found = each.groupBy(family).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.sort_array(F.collect_list("_signature")).alias("_all"))
    units = F.flatten(F.transform("_all", lambda s, k: F.when(k > 0, F.concat(bar, s["units"])).otherwise(s["units"])))
    return found.select(family, "n", "mean", numeric.fnv1a_units(units).alias("signature"))


def calibration_suggestions(df: DataFrame, keys: Sequence[str], code: str, value: str, gap: Column, accepted: float, review: float, limit: int = 12) -> DataFrame:
    """Codes of a key seen twice or more that are weak or disagree: proposed thresholds, and how sure; the ``limit`` surest."""
    each = df.groupBy(*keys, code).agg(F.count("*").alias("n"), F.avg(value).alias("_mean"), F.avg(gap.cast("int")).alias("_gap"))
    each = each.filter((F.col("n") >= 2) & ~((F.col("_mean") >= accepted) & (F.col("_gap") < 0.35)))
    proposed = F.round(F.greatest(F.lit(review), F.least(F.lit(0.95), F.col("_mean") + 0.08)), 6)
    sure = F.round(F.least(F.lit(1.0), F.col("n") / 5 + F.col("_gap") * 0.4), 6)
    held = each.withColumns({"proposed": proposed, "confidence": sure})
    return top_k(held, list(keys), [F.col("confidence").desc(), F.col(code)], limit).select(*keys, "rank", code, "n", "proposed", "confidence")


def error_totals(df: DataFrame, key: str, kind: str, kinds: Sequence[str], fields: DataFrame) -> DataFrame:
    """Per key: counts of the stated error kinds, all of them, and accuracy 1 - errors / fields, negative where errors overlap.

    ``fields``: key, fields.
    """
    counts = df.groupBy(key).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds], F.count("*").alias("errors"))
    met = fields.join(counts, key, "left").fillna(0, [*kinds, "errors"])
    return met.withColumn("accuracy", F.round(1 - F.col("errors") / F.greatest(F.col("fields"), F.lit(1)), 6))


def counters(df: DataFrame, keys: Sequence[str], counts: dict[str, Column], rates: Sequence[str] = ()) -> DataFrame:
    """Filtered counts of one scan, and ``<name>_rate`` over all rows for ``rates``."""
    found = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in counts.items()])
    return found.withColumns({f"{name}_rate": F.round(F.col(name) / F.greatest(F.col("n"), F.lit(1)), 6) for name in rates})


def mismatch_rates(df: DataFrame, keys: Sequence[str], mismatch: str, kinds: Sequence[str]) -> DataFrame:
    """keys, n, the rows of each kind of mismatch and their share of all rows, and ``any_rate``; the row of a kind that is not stated counts in ``any_rate`` only."""
    counts = [F.count_if(F.col(mismatch) == kind).alias(kind) for kind in kinds]
    found = df.groupBy(*keys).agg(F.count("*").alias("n"), *counts, F.count(mismatch).alias("_any"))
    rates = {f"{kind}_rate": ratio(F.col(kind), F.col("n")) for kind in kinds}
    return found.withColumns({**rates, "any_rate": ratio(F.col("_any"), F.col("n"))}).drop("_any")


def same_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with their number of rows on both sides, and whether these are the same."""
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    both = n(left, "left_n").join(n(right, "right_n"), list(keys), "full_outer").fillna(0, ["left_n", "right_n"])
    return both.withColumn("same", F.col("left_n") == F.col("right_n"))


def alignment_score(df: DataFrame, keys: Sequence[str], truth: tuple[str, str], found: tuple[str, str]) -> DataFrame:
    """keys, dx, dy, rmse, score: the exact median shift between matched points, the error left after it, and exp(-30 error)."""
    pairs = df.withColumns({"_dx": F.col(truth[0]) - F.col(found[0]), "_dy": F.col(truth[1]) - F.col(found[1])})
    shift = pairs.groupBy(*keys).agg(F.median("_dx").alias("dx"), F.median("_dy").alias("dy"))
    left = pairs.join(shift, list(keys)).withColumn("_e", F.pow(F.col("_dx") - F.col("dx"), 2) + F.pow(F.col("_dy") - F.col("dy"), 2))
    out = left.groupBy(*keys).agg(F.first("dx").alias("dx"), F.first("dy").alias("dy"), F.sqrt(F.avg("_e")).alias("rmse"))
    return out.withColumn("score", F.exp(-30 * F.col("rmse")))


def layout_similarity(truth: DataFrame, found: DataFrame, form: str, page: str, kind: str, pages: DataFrame) -> DataFrame:
    """form, score, median_distance, compared_pages, page_coverage: how alike two layouts of a form are, without knowing which field is which.

    Both sides: form, page, kind, x, y (middles), width, height as shares of the page. A page's shift is the difference of the median middles; each field of ``truth``
    is met by the nearest field of its kind on the page (|dx| + |dy| + half of |dwidth| + |dheight|), found by rings. A page scores exp(-24 median distance) times the root of
    the ratio of the field counts, a form the mean of its pages times ``pages``' ratio (form, truth_pages, found_pages). Fields without one of their kind
    and pages without any pair are left out; a form without pages has no row.
    """
    shares = ["x", "y", "width", "height"]
    keys = [form, page]
    middles = lambda df, side: df.groupBy(*keys).agg(F.median("x").alias(f"{side}x"), F.median("y").alias(f"{side}y"), F.count("*").alias(f"{side}n"))
    both = stored(middles(truth, "t").join(middles(found, "f"), keys), "layout-pages")
    moved = found.join(both, keys).select(*keys, kind, (F.col("x") + F.col("tx") - F.col("fx")).alias("px"), (F.col("y") + F.col("ty") - F.col("fy")).alias("py"), F.col("width").alias("pw"), F.col("height").alias("ph"))
    moved = moved.withColumn("_other", F.lit(0))
    asked = truth.select(*keys, kind, *shares).groupBy(*keys, kind, *shares).agg(F.count("*").alias("_same"))  # fields alike have one distance
    asked = asked.withColumn("_field", F.struct(*shares))
    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    cost = gap("x", "px") + gap("y", "py") + gap("width", "pw") * 0.5 + gap("height", "ph") * 0.5
    near = spatial.k_nearest(asked, moved, [*keys, kind], "_field", "_other", cost, query_at=(F.col("x"), F.col("y")), point_at=(F.col("px"), F.col("py")))
    scored = near.groupBy(*keys).agg(F.expr("percentile(cost, 0.5, _same)").alias("distance")).join(both, keys)
    ratio = F.least("tn", "fn") / F.greatest("tn", "fn")
    scored = scored.withColumn("page_score", F.exp(-24 * F.col("distance")) * F.sqrt(ratio))
    out = scored.groupBy(form).agg(F.avg("page_score").alias("mean"), F.median("distance").alias("median_distance"), F.count("*").alias("compared_pages")).join(pages, form)
    coverage = F.least("truth_pages", "found_pages") / F.greatest("truth_pages", "found_pages")
    return out.select(form, (F.col("mean") * coverage).alias("score"), "median_distance", "compared_pages", coverage.alias("page_coverage"))


def hot_spot(timings: dict[str, Column]) -> Column:
    """stage and ms of the slowest stage, the first among equals."""
    parts = [F.struct(c.cast("double").alias("ms"), F.lit(-k).alias("place"), F.lit(name).alias("stage")) for k, (name, c) in enumerate(timings.items())]
    best = F.greatest(*parts)
    return F.struct(best["stage"].alias("stage"), best["ms"].alias("ms"))


def reconcile(stated: DataFrame, rows: DataFrame, key: str, counts: dict[str, Column]) -> DataFrame:
    """key, failed (sorted names of counts that differ from the stated ones), ok; keys on one side only fail."""
    actual = rows.groupBy(key).agg(*[F.count_if(c).alias(f"_{name}") for name, c in counts.items()])
    both = stated.join(actual, key, "full_outer")
    failed = F.array_sort(F.array_compact(F.array(*[F.when(~F.col(name).eqNullSafe(F.col(f"_{name}")), name) for name in counts])))
    return both.select(key, failed.alias("failed")).withColumn("ok", F.size("failed") == 0)


def graded_difference(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, change, grade: removed keys are errors, added ones warnings."""
    side = lambda a, b, change, grade: a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_anti").withColumns({"change": F.lit(change), "grade": F.lit(grade)})
    return side(before, after, "removed", "error").unionByName(side(after, before, "added", "warning"))


def one_sided_difference(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, change, before, after: keys that are new or have another value now; those that are gone are not told."""
    met = after.select(key, F.col(value).alias("after")).join(before.select(key, F.col(value).alias("before"), F.lit(True).alias("_had")), key, "left")
    change = F.when(F.col("_had").isNull(), "added").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return met.withColumn("change", change).filter(F.col("change").isNotNull()).select(key, "change", "before", "after")


@dataclass(frozen=True)
class Expectation:
    """What a record should be mapped to: by its id, or by a pattern of its text."""

    code: str
    record: int | None = None
    pattern: str | None = None


def with_expectation(df: DataFrame, key: str, value: str, expectations: Sequence[Expectation]) -> DataFrame:
    """``expected``: the code of the first expectation that names the row's id or fits its text (any case); null without one."""
    found = F
    for e in expectations:
        fits = F.lit(False) if e.record is None else F.col(key) == e.record
        if e.pattern is not None:
            fits = fits | F.col(value).rlike(f"(?i){e.pattern}")
        found = found.when(fits, e.code)
    return df.withColumn("expected", found.otherwise(None) if expectations else F.lit(None).cast("string"))


def export_faults(accepted: DataFrame, exported: DataFrame, doc: str, code: str, value: str, single: Sequence[str], needs: dict[str, str]) -> DataFrame:
    """doc, code, fault: accepted codes that were not written, values of the wrong shape, codes written too often, and missing companions.

    ``accepted``: doc, code; ``exported``: doc, code, value.
    """
    from fieldloom.operators import predicates

    wanted, present = accepted.select(doc, code).distinct(), exported.select(doc, code).distinct()
    missing = wanted.join(present, [doc, code], "left_anti").withColumn("fault", F.lit("missing"))
    shaped = exported.filter(~predicates.fits_shape(F.col(value), predicates.expected_type(F.col(code)))).select(doc, code).distinct().withColumn("fault", F.lit("type"))
    many = exported.filter(F.col(code).isin(*single)).groupBy(doc, code).agg(F.count("*").alias("_n")).filter("_n > 1").select(doc, code, F.lit("cardinality").alias("fault"))
    pairs = F.create_map(*[F.lit(x) for item in needs.items() for x in item])
    asked = present.withColumn("_needs", pairs[F.col(code)]).filter("_needs is not null")
    held = present.select(doc, F.col(code).alias("_needs"))
    alone = asked.join(held, [doc, "_needs"], "left_anti").select(doc, code, F.lit("dependency").alias("fault"))
    return missing.unionByName(shaped).unionByName(many).unionByName(alone)


def replay_mismatch(baseline: DataFrame, replay: DataFrame, key: str, label: str, category: str, ordinal: str) -> DataFrame:
    """``missing``, ``label``, ``category`` or ``box`` mismatch of each baseline row against the last replay row of its key; null if equal.

    Both have key, label, category and ``box``.
    """
    last = replay.groupBy(key).agg(F.max_by(F.struct(label, category, "box"), ordinal).alias("_r"))
    far = F.greatest(*[F.abs(F.col(f"box.{p}") - F.col(f"_r.box.{p}")) for p in ("x", "y", "width", "height")]) > 4
    met = baseline.join(last, key, "left")
    kind = F.when(F.col("_r").isNull(), "missing").when(F.col(label) != F.col(f"_r.{label}"), "label").when(F.col(category) != F.col(f"_r.{category}"), "category").when(far, "box")
    return met.withColumn("mismatch", kind).drop("_r")


def duplicate_contradictions(df: DataFrame, value: str, code: str, confidence: str, review: float) -> DataFrame:
    """Normalised texts with two rows or more, several codes, and every row at least at ``review``."""
    found = df.withColumn("text", text.normalise(F.col(value))).filter("text <> ''").groupBy("text").agg(F.count("*").alias("n"), F.size(F.collect_set(code)).alias("n_codes"), F.min(confidence).alias("least"))
    return found.filter((F.col("n") >= 2) & (F.col("n_codes") >= 2) & (F.col("least") >= review))


#: Latencies that a service remembers, and parts into which one service's rows are dealt before the last are found.
LAST_LATENCIES, PARTS = 250, 64


def metric_snapshot(rows: DataFrame, service: str, at: Sequence[str], latency: str, counts: dict[str, Column], gauges: dict[str, Column], fallback: float, keep: int = LAST_LATENCIES) -> DataFrame:
    """service, the counters, the gauges (last value that is not null) and mean_latency (of the last ``keep``, rounded half up; ``fallback`` without any).

    Rows with the greatest ``at`` (which tells rows apart) are the last. They are found in ``PARTS`` parts of each service first, so a service with a third of all rows is many keys, and no
    window holds more than its part; counters and gauges are sums and greatest structs that combine before the shuffle.
    """
    order = F.struct(*at)
    sums = [F.count_if(c).alias(name) for name, c in counts.items()]
    lasts = [F.max(F.when(c.isNotNull(), F.struct(order.alias("at"), c.alias("v"))))["v"].alias(name) for name, c in gauges.items()]
    totals = rows.groupBy(service).agg(*sums, *lasts)
    timed = rows.filter(F.col(latency).isNotNull()).select(service, *at, latency).withColumn("_part", F.pmod(F.xxhash64(*at), F.lit(PARTS)))
    newest = [F.col(c).desc() for c in at]
    last = top_k(top_k(timed, [service, "_part"], newest, keep, "_rank"), [service], newest, keep, "_rank")
    means = last.groupBy(service).agg(F.floor(F.avg(latency) + 0.5).cast("double").alias("mean_latency"))
    return totals.join(means, service, "left").withColumn("mean_latency", F.coalesce("mean_latency", F.lit(float(fallback))))
