"""Quality classification by co-training of two views.

The content view is a logistic model on a text's tokens (each hashed as itself and by its shape, averaged over the
text, with the share of tokens that repeat their predecessor); the metadata view is one on the page's language, source,
length and line layout. Both start from a labelled sample. In each round both views score the unlabelled pool where its
vectors lie, and of each class the ``PER_ROUND`` documents that a view is most sure of join the other view's training set as
pseudo-labels. At the end each view is calibrated (Platt) on labelled documents kept out of its training, and a logistic model
of both calibrated scores gives the score of every document; those below ``threshold`` are not kept.

The labelled sample is bounded: the ``max_labelled`` labels with the smallest hash of their id. The pool is not: it is all unlabelled documents.
Executors turn texts into sparse vectors of counts where they lie and keep the pool's as a stored table; each task hands the scores of its own most
confident rows to a ranking, and only the winners' vectors are looked up, so the driver gets no more than the pseudo-labels of a round, and fits on them and
the labelled sample.
The model has a fixed size and is broadcast; scoring reads every whole text where it lies and shuffles nothing.

Cases: null or empty text: no tokens, the content view gives its prior; null language, source or length are values of
their own; several labels of one id: their mean, 0.5 counting as good; null labels are ignored; no labels: score 0.5; labels
of one class only: that class's share (1 or 0); repeated rows are scored each; an empty table gives no
rows; extra columns pass through ``classify``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.llm.common import bounded_batches, dropped, give_back, small, stored, tidy

MAX_LABELLED = 3000
#: Most ids of labelled documents that are broadcast.
LABELLED_IDS = 1_000_000
#: Rounds, and pseudo-labels of each class that a view may hand over per round, and how sure it must be.
ROUNDS, PER_ROUND, CONFIDENT = 3, 150, 0.97
BUCKETS = 1 << 18
META_BUCKETS = 1 << 12
SCALE = 10.0
EPOCHS, RATE, DECAY = 60, 0.3, 1e-4
THRESHOLD = 0.5
CACHE_TOKENS = 150_000

_SHAPE = {**{c: "A" for c in range(65, 91)}, **{c: "a" for c in range(97, 123)}, **{c: "9" for c in range(48, 58)}}
_RUNS = re.compile(r"(.)\1+", re.S)


def shape(token: str) -> str:
    """The token with letters, capitals and digits as a, A and 9, and runs as one character."""
    plain = token.translate(_SHAPE)
    if not plain.isascii():
        plain = "".join(c if c < "\x80" else "A" if c.isupper() else "a" if c.isalpha() else c for c in plain)
    return _RUNS.sub(r"\1", plain)


def token_buckets(token: str) -> tuple[int, int]:
    data = token.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) & (BUCKETS - 1), zlib.crc32(shape(token).encode("utf-8", "surrogatepass"), 1) & (BUCKETS - 1)


#: Bucket of the share of tokens equal to the one before.
REPEATS = BUCKETS


def text_counts(text: str | None) -> tuple[list[int], list[int], int]:
    """Buckets of a text's tokens, how often each is met, and the number of tokens."""
    tokens = (text or "").split()
    sums: dict[int, int] = {}
    for token, n in Counter(tokens).items():
        for bucket in token_buckets(token):
            sums[bucket] = sums.get(bucket, 0) + n
    same = sum(map(str.__eq__, tokens, tokens[1:]))
    if same:
        sums[REPEATS] = same
    return list(sums), list(sums.values()), len(tokens)


def text_vector(text: str | None) -> tuple[list[int], list[float]]:
    """Sparse content vector."""
    cols, counts, n = text_counts(text)
    return cols, [c * (SCALE / n) for c in counts]


def meta_buckets(lang: str | None, source: str | None, n_chars: int | None, text: str | None) -> list[int]:
    """Metadata features, as hashed indicators."""
    lines = (text or "").count("\n") + 1
    size = len(text or "")
    level = lambda x: int(2 * math.log2(x + 1))
    names = (
        f"lang {lang}",
        f"source {source}",
        f"both {lang} {source}",
        f"chars {None if n_chars is None else level(max(0, n_chars))}",
        f"lines {level(lines)}",
        f"line {level(size // lines)}",
        f"agrees {n_chars == size}",
    )
    return [zlib.crc32(name.encode("utf-8", "surrogatepass"), 2) & (META_BUCKETS - 1) for name in names]


@dataclass
class Sparse:
    """Rows of sparse vectors."""

    rows: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    n: int

    @classmethod
    def of(cls, vectors: list[tuple[list[int], list[float]]]) -> Sparse:
        sizes = [len(c) for c, _ in vectors]
        flat = lambda k, kind: np.array([x for v in vectors for x in v[k]], kind)
        return cls(np.repeat(np.arange(len(vectors)), sizes), flat(0, np.int64), flat(1, np.float64), len(vectors))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * weights[self.cols], self.n)

    def back(self, errors: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.cols, self.values * errors[self.rows], width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: Sparse, y: np.ndarray, use: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Weights and bias on the rows ``use``, both classes weighing the same."""
    weights, bias = np.zeros(width), 0.0
    squares, square = np.full(width, 1e-8), 1e-8
    weigh = np.zeros(x.n)
    for value in (0, 1):
        rows = use & (y == value)
        weigh[rows] = 0.5 / max(1, rows.sum())
    for _ in range(EPOCHS):
        errors = weigh * (y - _sigmoid(x.dot(weights) + bias))
        grad, grad_bias = x.back(errors, width) - DECAY * weights, errors.sum()
        squares += grad * grad
        square += grad_bias**2
        weights += RATE * grad / np.sqrt(squares)
        bias += RATE * grad_bias / np.sqrt(square)
    return weights, bias


def fit_dense(columns: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.column_stack([*columns, np.ones(len(y))])
    beta, ridge = np.zeros(x.shape[1]), np.diag([*[1e-2] * len(columns), 1e-4])
    for _ in range(30):
        p = _sigmoid(x @ beta)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta = beta + np.clip(step, -5, 5)
    return beta


@dataclass
class Model:
    """Two calibrated views and their combination; ``prior`` alone where there was nothing to learn from."""

    prior: float = 0.5
    text: tuple[np.ndarray, float] | None = None
    meta: tuple[np.ndarray, float] | None = None
    platt: tuple[np.ndarray, np.ndarray] | None = None
    stack: np.ndarray | None = None
    history: list[tuple[int, int]] = field(default_factory=list)

    def combine(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of both views and the final score, from raw scores."""
        a = text * self.platt[0][0] + self.platt[0][1]
        b = meta * self.platt[1][0] + self.platt[1][1]
        return _sigmoid(a), _sigmoid(b), _sigmoid(np.clip(a, -10, 10) * self.stack[0] + np.clip(b, -10, 10) * self.stack[1] + self.stack[2])


def _raw(view: Sparse, fitted: tuple[np.ndarray, float]) -> np.ndarray:
    return view.dot(fitted[0]) + fitted[1]


@dataclass
class Marked:
    """Rows of the driver: both vectors and the label that each view is trained with (-1: not with this row)."""

    text: list
    meta: list
    labels: list[list[int]]

    def views(self) -> tuple[Sparse, Sparse]:
        return Sparse.of(self.text), Sparse.of(self.meta)


Teach = Callable[[list[tuple[np.ndarray, float]], list[np.ndarray]], list[tuple[int, int, tuple, tuple]]]


def co_train(text: list, meta: list, labels: np.ndarray, teach: Teach, rounds: int = ROUNDS) -> Model:
    """Fit on labelled rows (1 or 0), every third of a class for calibration, and on what ``teach`` finds in the pool.

    ``teach(fitted, platt)`` gives (view that learns, label, text vector, metadata vector) of the round's most confident documents.
    """
    if not len(labels):
        return Model()
    prior = float(labels.mean())
    if prior in (0.0, 1.0):
        return Model(prior)
    aside = np.zeros(len(labels), bool)
    for value in (0, 1):
        aside[np.flatnonzero(labels == value)[2::3]] = True
    own = np.where(aside, -1, labels).tolist()
    rows = Marked(list(text), list(meta), [list(own), list(own)])
    ground = aside if len(set(labels[aside])) == 2 else np.ones(len(labels), bool)
    truth = labels[ground].astype(float)
    model = Model(prior)
    for turn in range(rounds + 1):
        marks = [np.array(x) for x in rows.labels]
        views = rows.views()
        fitted = [fit_logistic(x, np.maximum(m, 0), m >= 0, width) for x, m, width in zip(views, marks, (BUCKETS + 1, META_BUCKETS))]
        raw = [_raw(x, f)[: len(labels)][ground] for x, f in zip(views, fitted)]
        platt = [fit_dense([r], truth) for r in raw]
        if turn == rounds:
            break
        given = [0, 0]
        for pupil, value, t, m in teach(fitted, platt):
            rows.text.append(t)
            rows.meta.append(m)
            rows.labels[pupil].append(value)
            rows.labels[1 - pupil].append(-1)
            given[1 - pupil] += 1
        model.history.append((given[0], given[1]))
    model.text, model.meta = fitted
    model.platt = platt[0], platt[1]
    logits = [np.clip(r * p[0] + p[1], -10, 10) for r, p in zip(raw, platt)]
    model.stack = fit_dense(logits, truth)
    return model


# --- Spark jobs ----------------------------------------------------------------------------------

_VECTORS = pa.schema([("key", pa.int64()), ("label", pa.float64()), ("cols", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("tokens", pa.int32()), ("meta", pa.list_(pa.int32()))])
_VECTORS_DDL = "key long, label double, cols array<int>, counts array<int>, tokens int, meta array<int>"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both vectors of (text, lang, source, n_chars, label, key) rows."""
    for batch in batches:
        text, lang, source, n_chars = (batch.column(k).to_pylist() for k in range(4))
        found = [text_counts(t) for t in text]
        meta = [meta_buckets(*x) for x in zip(lang, source, n_chars, text)]
        kinds = _VECTORS.types
        yield pa.RecordBatch.from_arrays(
            [batch.column(5), batch.column(4), *(pa.array([v[k] for v in found], kinds[k + 2]) for k in range(3)), pa.array(meta, kinds[5])], schema=_VECTORS
        )


_SURE = pa.schema([("pupil", pa.int32()), ("value", pa.int32()), ("score", pa.float64()), ("key", pa.int64())])
_SURE_DDL = "pupil int, value int, score double, key long"


def _most_confident(pool: DataFrame, fitted: list, platt: list, taken: tuple[set[int], set[int]]) -> list[tuple[int, int, int]]:
    """The round's (pupil, value, key): ``PER_ROUND`` of each view and class, in order."""
    shared = pool.sparkSession.sparkContext.broadcast((fitted, platt, taken))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (text_fit, meta_fit), (text_platt, meta_platt), known = shared.value
        best: dict[tuple[int, int], list] = {(pupil, value): [] for pupil in (0, 1) for value in (0, 1)}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(0).to_pylist()
            cols, counts, metas = batch.column(1), batch.column(2), batch.column(4)
            owner = np.repeat(np.arange(n), np.asarray(cols.value_lengths()))
            sums = np.bincount(owner, text_fit[0][np.asarray(cols.flatten())] * np.asarray(counts.flatten()), n)
            sums *= SCALE / np.maximum(np.asarray(batch.column(3)), 1)
            meta_owner = np.repeat(np.arange(n), np.asarray(metas.value_lengths()))
            raws = (sums + text_fit[1], np.bincount(meta_owner, meta_fit[0][np.asarray(metas.flatten())], n) + meta_fit[1])
            sure = [_sigmoid(r * p[0] + p[1]) for r, p in zip(raws, (text_platt, meta_platt))]
            for (pupil, value), held in best.items():
                score = sure[1 - pupil] if value else 1 - sure[1 - pupil]
                rows = {(float(score[k]), keys[k]) for k in np.flatnonzero(score >= CONFIDENT).tolist() if keys[k] not in known[pupil]}
                held[:] = sorted({*held, *rows}, key=lambda r: (-r[0], r[1]))[:PER_ROUND]  # equal rows are one
        rows = [(pupil, value, *r) for (pupil, value), held in best.items() for r in held]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SURE.types)], schema=_SURE)

    found = pool.select("key", "cols", "counts", "tokens", "meta").mapInArrow(tidy(run), _SURE_DDL).distinct()
    order = Window.partitionBy("pupil", "value").orderBy(F.col("score").desc(), "key")
    rows = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PER_ROUND).collect()
    shared.destroy()
    return [(r["pupil"], r["value"], r["key"]) for r in sorted(rows, key=lambda r: (r["pupil"], r["value"], r["place"]))]


def _vector(row: dict) -> tuple[tuple[list[int], list[float]], tuple[list[int], list[float]]]:
    """Both sparse vectors of a stored row."""
    return (row["cols"], [c * (SCALE / row["tokens"]) for c in row["counts"]]), (row["meta"], [1.0] * len(row["meta"]))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> Model:
    """Co-train on documents (doc_id, text, lang, source, n_chars) and labels (doc_id, quality)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"), "doc_id")
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    # a bounded table, whatever the number of labels
    some = stored(marks.orderBy(F.xxhash64("doc_id", F.lit(21)), "doc_id").limit(max_labelled), "labelled-sample")
    key = F.xxhash64("doc_id", "text", "lang", "source", "n_chars").alias("key")
    names = ["text", "lang", "source", "n_chars", "label", key]
    known = docs.join(F.broadcast(some), "doc_id").select(*names).mapInArrow(tidy(_vectors), _VECTORS_DDL)
    # rows of one id may be many: of equal rows one is enough
    names_of = ("label", "cols", "counts", "tokens", "meta")
    found = known.groupBy("key").agg(*[F.first(c).alias(c) for c in names_of]).orderBy("key").limit(2 * max_labelled).toArrow()
    # a million ids are a few megabytes; beyond, the join moves texts once
    labelled = stored(marks.select("doc_id"), "labelled-ids")
    free = docs.join(small(labelled, LABELLED_IDS), "doc_id", "left_anti").withColumn("label", F.lit(-1.0))
    pool = stored(free.select(*names).mapInArrow(tidy(_vectors), _VECTORS_DDL), "pool")
    taken: tuple[set[int], set[int]] = (set(), set())

    def teach(fitted: list, platt: list) -> list:
        rows = _most_confident(pool, fitted, platt, taken)
        for pupil, _, key in rows:
            taken[pupil].add(key)
        # at most 4 * PER_ROUND keys
        asked = pool.filter(F.col("key").isin([key for *_, key in rows])).dropDuplicates(["key"]).select("key", *names_of[1:])
        vectors = {r["key"]: _vector(r) for r in asked.collect()} if rows else {}
        return [(pupil, value, *vectors[key]) for pupil, value, key in rows]

    both = [_vector(r) for r in found.select(list(names_of[1:])).to_pylist()]
    model = co_train([t for t, _ in both], [m for _, m in both], np.asarray(found["label"]).astype(int), teach, rounds)
    dropped(some, pool, labelled)
    give_back()
    return model


class Scorer:
    """Scores documents, with a bounded cache of token weights."""

    def __init__(self, model: Model):
        self.model = model
        self.weights: dict[str, float] = {}

    def _weight(self, token: str) -> float:
        a, b = token_buckets(token)
        found = float(self.model.text[0][a] + self.model.text[0][b])
        if len(self.weights) >= CACHE_TOKENS:
            self.weights.clear()
        self.weights[token] = found
        return found

    def raw_text(self, text: str | None) -> float:
        tokens = (text or "").split()
        weights, bias = self.model.text
        if not tokens:
            return bias
        get, miss = self.weights.get, self._weight
        total = 0.0
        for token in tokens:
            found = get(token)
            total += miss(token) if found is None else found
        total += float(weights[REPEATS]) * sum(map(str.__eq__, tokens, tokens[1:]))
        return bias + total * SCALE / len(tokens)

    def score(self, text: list, lang: list, source: list, n_chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.model.text is None:
            same = np.full(len(text), self.model.prior)
            return same, same, same
        raw = np.array([self.raw_text(t) for t in text])
        weights, bias = self.model.meta
        meta = np.array([bias + sum(weights[k] for k in meta_buckets(*x)) for x in zip(lang, source, n_chars, text)])
        return self.model.combine(raw, meta)


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with p_text, p_meta, quality_score and kept (prefixed by ``cot_`` where the input has such columns)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = []
    for name in ("p_text", "p_meta", "quality_score", "kept"):
        while name in {c.lower() for c in docs.columns}:
            name = f"cot_{name}"
        names.append(name)
    at = [docs.columns.index(c) for c in ("text", "lang", "source", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            parts = [scorer.score(*(batch.column(c).slice(k, 500).to_pylist() for c in at)) for k in range(0, batch.num_rows, 500)]
            found = [np.concatenate(x) for x in zip(*parts)] or [np.zeros(0)] * 3
            columns = [pa.array(x, pa.float64()) for x in found] + [pa.array(found[2] >= threshold)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    schema = type(docs.schema)([*docs.schema.fields])
    for name, kind in zip(names, ("double", "double", "double", "boolean")):
        schema = schema.add(name, kind)
    return docs.mapInArrow(tidy(run), schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of both views and of their combination for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = classify(docs, fit(docs, labels))
    return scored.select("doc_id", "p_text", "p_meta", F.col("quality_score").alias("score"), "kept")
