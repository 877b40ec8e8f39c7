"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

All of it is DataFrame expressions. Base statistics are computed per text from its array of words and lines. Of the
documents that pass the base rules, a statistic vector (log word length; square roots of the symbol, repeated-line and
repeated-word shares) is judged by its Mahalanobis distance from its group's minimum-covariance-determinant estimate.

The estimate is regularised, as most documents have no symbol or repeat at all: the square of ``LEAST``, the deviation that a
statistic may have anywhere, is added to each variance (a share of ``CUTOFF * LEAST ** 2``, 19 percent of repeated lines or
words, is an outlier alone). Every group has ``STARTS`` starts: the moments of all its rows, and those of about ``SEEDS`` rows
picked by hash. All starts take concentration steps together, until no determinant falls any more: the ``SUPPORT`` share of rows
nearest to the centre gives the next mean and covariance. The start with the least determinant wins; its covariance is made
consistent by ``CONSISTENT``; the rows within ``REWEIGHT`` of it give the final mean and covariance (the usual reweighting step).
Groups are (language, source). Each is joined with its whole language's estimate as with ``PRIOR`` rows more, whatever its size.
Rows beyond ``CUTOFF`` are rejected.

A step is one pass: distances fall into buckets of 1/16 octave, and a bucket's count and moments are partial sums, so neither a row
nor a group of rows moves; the buckets up to the support are added up. (The support so ends at a bucket's end.) Estimates are a
stored table of a few numbers a group, broadcast when it is counted to be small. Texts are read once, where they lie.

Cases: a null text has no words and fails the base rules, as do empty and white-space texts; null language and null source
are groups of their own; repeated rows count each; equal distances are all kept or all rejected; an empty
table gives no rows; extra columns are ignored by ``judge``; ``base_statistics`` keeps columns that have the names of its own
under ``given_<name>``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.llm.common import small, stored

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: The statistics, and the variation of each that is never unusual (a standard deviation).
LEAST = {"word_length": 0.05, "symbols": 0.05, "lines": 0.09, "repeats": 0.09}
FEATURES = tuple(LEAST)
#: Share of a group's rows that the estimate rests on, starts, rows of a random start, most concentration steps, and the fall of
#: a log-determinant that goes on.
SUPPORT, STARTS, SEEDS, STEPS, FALL = 0.75, 5, 12, 12, 0.001
#: Chi-square with four degrees of freedom: its 0.975 and 0.9999 quantiles, and 0.75 over the share of six degrees of freedom below
#: the 0.75 quantile.
REWEIGHT, CUTOFF, CONSISTENT = 11.143, 23.513, 1.4866
#: Rows that the language's estimate counts as in each of its groups.
PRIOR = 50
#: Buckets of distances to an octave.
OCTAVE = 16


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that a text holds twice or more."""
    pairs = lambda xs, f: F.zip_with(xs, F.slice(xs, 2, F.size(xs)), f)

    def covered(places: Column) -> Column:
        gaps = pairs(places, lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)

    def places(windows: Column) -> Column:
        # windows in order of their hash: equal ones are neighbours
        equal_next = pairs(windows, lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
        both = let(equal_next, lambda e: F.zip_with(e, F.concat(F.array(F.lit(False)), F.slice(e, 1, F.size(e) - 1)), lambda x, y: x | y))
        marked = F.zip_with(windows, both, lambda w, m: F.when(m, w["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def count(ws: Column) -> Column:
        second, third = F.slice(ws, 2, F.size(ws)), F.slice(ws, 3, F.size(ws))
        two = F.zip_with(ws, second, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        hashes = F.zip_with(two, third, lambda ab, c: F.xxhash64(ab["a"], ab["b"], c))
        windows = F.slice(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))), 1, F.size(ws) - 2)
        return let(F.sort_array(windows), lambda w: let(places(w), covered))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(words, count))


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed."""
    own = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "_words", "_lines"}
    docs = docs.withColumnsRenamed({c: f"given_{c}" for c in docs.columns if c.lower() in own and c != text_col})
    text = F.coalesce(F.col(text_col), F.lit(""))
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    words = F.filter(F.split(spaced, " "), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, " \t\n\x0b\x0c\r", "") != "")
    by_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("repeats")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    found = docs.withColumns(
        {
            "_words": by_words,
            "_lines": by_lines,
            "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        }
    )
    found = found.withColumns(
        {"n_words": F.col("_words.n"), "n_repeat_words": F.col("_words.repeats"), "n_lines": F.col("_lines.n"), "n_dup_lines": F.col("_lines.dup")}
    ).drop("_words", "_lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def _vector() -> dict[str, Column]:
    share = lambda part, whole: F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    return {
        "word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        "symbols": share("n_symbols", "word_chars"),
        "lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
    }


_CELLS = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
_SUMS = ["n", *[f"s{i}" for i in range(len(FEATURES))], *[f"c{i}{j}" for i, j in _CELLS]]


def _groups() -> dict[str, Column]:
    """``cell``: the row's group; ``wide``: the group of its language."""
    name = lambda level, *parts: F.to_json(F.struct(F.lit(level).alias("level"), *parts))
    return {"cell": name(2, "lang", "source"), "wide": name(1, "lang")}


def _moments(rows: DataFrame, *keys: str) -> DataFrame:
    """Count, sums and sums of products of the statistics of each group."""
    at = [F.col(x) for x in FEATURES]
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(at)] + [F.sum(at[i] * at[j]).alias(f"c{i}{j}") for i, j in _CELLS]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums)


def _estimate(sums: DataFrame, factor: float = 1.0) -> DataFrame:
    """Mean and regularised covariance ``cov`` of sums (``_SUMS``), in place of them; ``n`` stays."""
    mean = [F.col(f"s{i}") / F.col("n") for i in range(len(FEATURES))]
    cov = {(i, j): factor * (F.col(f"c{i}{j}") / F.col("n") - mean[i] * mean[j]) for i, j in _CELLS}
    for i, x in enumerate(FEATURES):
        cov[i, i] = F.greatest(cov[i, i], F.lit(0.0)) + LEAST[x] ** 2
    kept = [c for c in sums.columns if c == "n" or c not in _SUMS]
    return sums.select(*kept, F.struct(*[m.alias(x) for m, x in zip(mean, FEATURES)]).alias("mean"), F.struct(*[v.alias(f"c{i}{j}") for (i, j), v in cov.items()]).alias("cov"))


def _with_root(found: DataFrame) -> DataFrame:
    """Adds ``root``, the Cholesky root of ``cov``, and ``logdet``."""
    done: dict[tuple[int, int], str] = {}
    for j in range(len(FEATURES)):
        for i in range(j, len(FEATURES)):
            value = F.col(f"cov.c{i}{j}")
            for k in range(j):
                value = value - F.col(done[i, k]) * F.col(done[j, k])
            # a diagonal is at least the square of LEAST, but for rounding
            value = F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(done[j, j])
            done[i, j] = f"_l{i}{j}"
            found = found.withColumn(done[i, j], value)
    logdet = sum((2 * F.log(done[i, i]) for i in range(len(FEATURES))), F.lit(0.0))
    root = F.struct(*[F.col(c).alias(f"l{i}{j}") for (i, j), c in done.items()])
    return found.withColumns({"root": root, "logdet": logdet}).drop(*done.values())


def _distance() -> Column:
    """Squared Mahalanobis distance from ``mean`` by forward substitution with ``root``."""
    solved: list[Column] = []
    total = F.lit(0.0)
    for i, x in enumerate(FEATURES):
        value = F.col(x) - F.col(f"mean.{x}")
        for j in range(i):
            value = value - F.col(f"root.l{i}{j}") * solved[j]
        solved.append(value / F.col(f"root.l{i}{i}"))
        total = total + solved[i] * solved[i]
    return total


def _concentrated(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The next estimate of every (cell, start): one concentration step."""
    bucket = F.floor(OCTAVE * F.log2(F.greatest(F.col("d"), F.lit(1e-9)))).cast("int")
    near = rows.join(small(found).select("cell", "start", "mean", "root"), "cell").withColumn("d", _distance()).withColumn("bucket", bucket)
    sums = _moments(near, "cell", "start", "bucket")
    group = Window.partitionBy("cell", "start")
    nearer = F.coalesce(F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = sums.withColumns({"_nearer": nearer, "_all": F.sum("n").over(group)}).filter(F.col("_nearer") < F.ceil(SUPPORT * F.col("_all")))
    return _with_root(_estimate(inside.groupBy("cell", "start").agg(*[F.sum(c).alias(c) for c in _SUMS])))


def estimates(rows: DataFrame) -> DataFrame:
    """cell, n, mean and cov of every group of ``rows`` (key, cell and FEATURES); n is the number of rows that the last step takes."""
    sizes = stored(rows.groupBy("cell").agg(F.count("*").alias("_n")), "group-sizes")
    picked = [F.lit(0)] + [F.when(F.pmod(F.xxhash64("key", *FEATURES, F.lit(k)), F.col("_n")) < SEEDS, k) for k in range(1, STARTS)]
    first = rows.join(small(sizes), "cell").withColumn("start", F.explode(F.array_compact(F.array(*picked))))
    found = stored(_with_root(_estimate(_moments(first, "cell", "start"))), "starts")
    for _ in range(STEPS):
        after = stored(_concentrated(rows, found), "concentrated")
        fell = after.join(found.select("cell", "start", F.col("logdet").alias("before")), ["cell", "start"])
        most = fell.agg(F.max(F.col("before") - F.col("logdet"))).first()[0]
        found = after
        if most is None or most <= FALL:
            break
    least = found.groupBy("cell").agg(F.min_by(F.struct("mean", "cov"), F.struct("logdet", "start")).alias("best")).select("cell", "best.*")
    wider = F.struct(*[(F.col(f"cov.c{i}{j}") * CONSISTENT).alias(f"c{i}{j}") for i, j in _CELLS])
    raw = stored(_with_root(least.withColumn("cov", wider)), "least-determinant")
    inside = rows.join(small(raw), "cell").withColumn("d", _distance()).filter(F.col("d") <= REWEIGHT)
    final = _estimate(_moments(inside.select("cell", *FEATURES), "cell"))
    # a group none of whose rows is that near keeps its first estimate
    return raw.select("cell", F.col("mean").alias("m"), F.col("cov").alias("v")).join(final, "cell", "left").select(
        "cell", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", "m").alias("mean"), F.coalesce("cov", "v").alias("cov")
    )


def _shrunk(found: DataFrame, groups: DataFrame) -> DataFrame:
    """cell, mean, root: each group's estimate joined with that of its language as with ``PRIOR`` rows more."""
    wide = found.select(F.col("cell").alias("wide"), F.col("mean").alias("wide_mean"), F.col("cov").alias("wide_cov"))
    both = found.join(groups, "cell").join(wide, "wide")
    part = F.col("n") / (F.col("n") + PRIOR)
    mixed = lambda name, x: (part * F.col(f"{name}.{x}") + (1 - part) * F.col(f"wide_{name}.{x}")).alias(x)
    mean = F.struct(*[mixed("mean", x) for x in FEATURES])
    cov = F.struct(*[mixed("cov", f"c{i}{j}") for i, j in _CELLS])
    return _with_root(both.select("cell", mean.alias("mean"), cov.alias("cov"))).select("cell", "mean", "root")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance and kept of every row of documents (doc_id, text, lang, source)."""
    rows = base_statistics(docs.select("doc_id", "text", "lang", "source")).drop("text")
    rows = stored(rows.withColumns({**_vector(), **_groups()}), "statistics")
    ok = rows.filter(~F.col("base_failed")).withColumn("key", F.xxhash64("doc_id"))
    each = ok.withColumn("cell", F.explode(F.array("cell", "wide"))).select("key", "cell", *FEATURES)
    found = stored(_shrunk(stored(estimates(each), "estimates"), ok.select("cell", "wide").distinct()), "shrunk")
    judged = rows.join(small(found), "cell", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return judged.withColumn("kept", kept)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the verdict of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
    return judge(docs).select(*names)
