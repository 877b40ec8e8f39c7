"""Language identification of code-switched text with a linear-chain conditional random field.

The words of a line form a chain. A word's label scores come from hashed features: prefixes and suffixes,
character n-grams, and lexicon features (in which languages' frequent-word lists it is); transition scores
are learned with them by maximising the conditional likelihood (forward-backward gradients). At prediction the
forward-backward algorithm gives every word's label distribution; a document's language is the label with the largest
mean probability over its words, and that mean is the score.

Training uses a bounded sample: of every label the ``per_label`` labelled documents with the smallest hash of the id, and of each up to
``RUNS`` runs of ``SEGMENT`` words, spread over the whole text and cut out where it lies. Runs of words of one line, from different documents, are joined to chains, so that transitions between languages are
seen. Every label is learned with a table of its own, so one more label changes nothing for the others; the model (hash table, lexicons, transitions)
grows with the labels, not with the documents. It is broadcast. Prediction reads every whole text where it lies and
shuffles nothing.

Cases: null text, or one without letters (Unicode category L; ``½`` and ``Ⅷ`` are none): ``und`` with score 0; no labelled documents: all ``und``; one label: that
label wherever there is a letter; ties go to the smaller label; a word of any length has all its n-grams; repeated rows are
predicted each; an empty table gives no rows; a null id counts as not held out; extra columns pass through ``identify``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.llm.common import bounded_batches, dropped, give_back, random_table, small, splitmix, stored, tidy

#: Words are runs of word characters other than decimal digits and ``_`` with a letter in them; a line end closes a chain.
TOKENS = re.compile(r"[^\W\d_]+|\n")
#: Documents of each label in the training sample.
PER_LABEL = 200
#: Documents of all labels in it: beyond MAX_SAMPLE / PER_LABEL labels each has fewer, but one at least.
MAX_SAMPLE = 20_000
#: Runs of SEGMENT words that one document of the sample gives, spread over its whole text.
RUNS = 200
#: Rows of the hashed feature table, the same for any number of labels.
BUCKETS = 1 << 16
#: Frequent words kept per label.
LEXICON = 400
#: Words per training chain segment of one document, and segments per chain.
SEGMENT, SEGMENTS = 12, 3
EPOCHS, RATE, DECAY = 25, 0.5, 1e-6
#: Distinct words kept in one task's cache; when it is full it starts anew.
CACHE_WORDS = 150_000
#: Words in one run of the forward-backward algorithm.
CHAIN_WORDS = 100_000
UNKNOWN = "und"

_ROW_SEEDS = random_table(16, 71)


def tokens(text: str) -> list[str]:
    """Lower-cased words, and the line ends between them."""
    found = TOKENS.findall(text.lower())
    if not text.isascii():
        found = [w for w in found if w == "\n" or w.isalpha() or any(map(str.isalpha, w))]
    return found


def _char_matrix(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word numbers, characters padded by 0 with one mark at both ends, lengths) for words of like length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        longest = max(8, 1 << int(lengths[order[at]] - 1).bit_length()) if lengths[order[at]] > 1 else 8
        end = min(int(np.searchsorted(lengths[order], longest, side="right")), at + max(1, 400_000 // longest))
        rows = order[at:end]
        flat = np.array([words[k] for k in rows], dtype=f"U{longest}")
        chars = flat.view(np.uint32).reshape(len(rows), longest).astype(np.uint64)
        yield rows, chars, lengths[rows]
        at = end


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (splitmix(h ^ _ROW_SEEDS[kind]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word number, bucket) pairs of all hashed features, in parts: affixes up to 3, n-grams up to 4, the word."""
    with np.errstate(over="ignore"):
        mult = np.uint64(0x100000001B3)
        for rows, chars, lengths in _char_matrix(words):
            n, width = chars.shape
            place = np.arange(width)
            inside = place < lengths[:, None]
            gram = np.zeros_like(chars)
            for size in range(1, 5):
                # the hash of the `size` characters that begin at each place
                gram = gram[:, : width - size + 1] * mult + splitmix(chars[:, size - 1 :] + np.uint64(1)) if size > 1 else splitmix(chars + np.uint64(1))
                ok = inside[:, size - 1 :]
                if size >= 2:
                    r, c = np.nonzero(ok)
                    yield rows[r], _bucket(gram[r, c], size), np.full(len(r), size)
                if size <= 3:
                    r = np.flatnonzero(lengths >= size)
                    yield rows[r], _bucket(gram[r, 0], 5 + size), np.full(len(r), 5)
                    yield rows[r], _bucket(gram[r, lengths[r] - size], 8 + size), np.full(len(r), 5)
            whole = np.zeros(n, np.uint64)
            for k in range(width):
                whole = np.where(inside[:, k], whole * mult + splitmix(chars[:, k] + np.uint64(1)), whole)
            yield rows, _bucket(whole, 12), np.full(n, 6)


@dataclass
class Crf:
    """A trained model; all arrays have fixed bounds."""

    labels: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    #: word -> bit set of the labels whose lexicon has it
    lexicon: dict[str, int] = field(default_factory=dict)
    lexicon_weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))

    def emissions(self, words: list[str]) -> np.ndarray:
        """Label scores of distinct words."""
        out = np.tile(self.bias, (len(words), 1)).astype(np.float32)
        count = np.ones(len(words), np.float32)
        for rows, buckets, _ in features(words):
            buckets = buckets & (len(self.weights) - 1)
            for label in range(len(self.labels)):
                out[:, label] += np.bincount(rows, self.weights[buckets, label], len(words)).astype(np.float32)
            count += np.bincount(rows, minlength=len(words))
        out = out / np.sqrt(count)[:, None]
        for k, word in enumerate(words):
            bits = self.lexicon.get(word, 0)
            for label in range(len(self.labels) if bits else 0):
                if bits >> label & 1:
                    out[k] += self.lexicon_weights[label]
        return out


def marginals(scores: np.ndarray, words: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Label distributions of the words of chains laid end to end, by scaled forward-backward.

    ``scores``: label scores of each distinct word; ``words``: the distinct word of each place. With ``pairs`` also the
    expected number of each transition and the log of the partition functions' sum.
    """
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    move = np.exp(transitions).astype(np.float64)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    alpha = np.zeros((len(words), scores.shape[1]))
    scale = np.ones(len(words))
    longest = int(sizes.max(initial=0))
    live = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
    prior = None
    for t in range(longest):
        at = starts[: live[t]] + t
        a = emit[words[at]] if prior is None else (prior[: live[t]] @ move) * emit[words[at]]
        total = a.sum(axis=1, keepdims=True)
        prior = a / total
        alpha[at], scale[at] = prior, total[:, 0]
    out = alpha
    expected = np.zeros_like(move)
    beta = np.ones((live[0] if longest else 0, scores.shape[1]))
    for t in range(longest - 1, 0, -1):
        at = starts[: live[t]] + t
        back = beta[: live[t]] * emit[words[at]] / scale[at][:, None]
        if pairs:
            expected += (alpha[at - 1].T @ back) * move
        step = back @ move.T
        out[at] = out[at] * beta[: live[t]]
        beta = np.ones_like(beta)
        beta[: live[t]] = step
    if longest:
        at = starts[: live[0]]
        out[at] = out[at] * beta[: live[0]]
    out = out / np.maximum(out.sum(axis=1, keepdims=True), 1e-300)
    if not pairs:
        return out
    return out, expected, float(np.log(scale).sum() + scores.max(axis=1)[words].sum())


def train(samples: list[tuple[str, str]], epochs: int = EPOCHS) -> Crf:
    """Fit on (text, label) pairs; every word of a text carries the text's label."""
    labels = sorted({label for _, label in samples})
    if not labels:
        return Crf([])
    number = {label: k for k, label in enumerate(labels)}
    counts = [Counter() for _ in labels]
    runs: list[tuple[int, list[str]]] = []
    for text, label in samples:
        for line in text.split("\n"):
            found = [w for w in tokens(line) if w != "\n"]
            counts[number[label]].update(found)
            runs += [(number[label], found[k : k + SEGMENT]) for k in range(0, len(found), SEGMENT)]
    n = len(labels)
    lexicon: dict[str, int] = {}
    for k, counter in enumerate(counts):
        for word, _ in sorted(counter.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon[word] = lexicon.get(word, 0) | 1 << k
    size = BUCKETS
    vocabulary = sorted(set().union(*counts))
    index = {w: k for k, w in enumerate(vocabulary)}
    model = Crf(labels, np.zeros((size, n), np.float32), np.zeros(n, np.float32), np.zeros((n, n), np.float32), lexicon, np.zeros((n, n), np.float32))
    if not runs or n == 1:
        return model
    # chains: documents in a fixed random order, SEGMENTS runs each
    shuffled = np.random.default_rng(3).permutation(len(runs))
    runs = [runs[k] for k in shuffled]
    words = np.array([index[w] for _, run in runs for w in run])
    gold = np.repeat([label for label, _ in runs], [len(run) for _, run in runs])
    sizes = np.array([len(run) for _, run in runs])
    lengths = np.add.reduceat(sizes, np.arange(0, len(sizes), SEGMENTS))
    parts = [(r, b) for r, b, _ in features(vocabulary)]
    row, bucket = np.concatenate([r for r, _ in parts]), np.concatenate([b for _, b in parts]) & (size - 1)
    norm = 1 / np.sqrt(1.0 + np.bincount(row, minlength=len(vocabulary)))
    member = np.array([[lexicon.get(w, 0) >> k & 1 for k in range(n)] for w in vocabulary], np.float64)
    inside = np.ones(len(words), bool)
    inside[np.cumsum(lengths) - lengths] = False  # no transition into a chain's first word
    into = np.flatnonzero(inside)
    gold_moves = np.zeros((n, n))
    np.add.at(gold_moves, (gold[into - 1], gold[into]), 1)
    gold_words = np.zeros((len(vocabulary), n))
    np.add.at(gold_words, (words, gold), 1)
    total = len(words)
    params = [np.zeros((size, n)), np.zeros(n), np.zeros((n, n)), np.zeros((n, n))]
    squares = [np.full_like(p, 1e-8) for p in params]
    for _ in range(epochs):
        weights, bias, moves, lex = params
        raw = np.stack([np.bincount(row, weights[bucket, k], len(vocabulary)) for k in range(n)], axis=1)
        scores = (raw + bias) * norm[:, None] + member @ lex
        post, expected, _ = marginals(scores, words, lengths, moves, pairs=True)
        error = gold_words - np.stack([np.bincount(words, post[:, k], len(vocabulary)) for k in range(n)], axis=1)
        error /= total
        scaled = error * norm[:, None]
        grads = [
            np.stack([np.bincount(bucket, scaled[row, k], size) for k in range(n)], axis=1) - DECAY * weights,
            scaled.sum(axis=0),
            (gold_moves - expected) / total - DECAY * moves,
            member.T @ error - DECAY * lex,
        ]
        for p, s, g in zip(params, squares, grads):
            s += g * g
            p += RATE * g / np.sqrt(s)
    model.weights, model.bias, model.transitions, model.lexicon_weights = (p.astype(np.float32) for p in params)
    return model


class Labeller:
    """Predicts documents with a bounded cache of word scores."""

    def __init__(self, model: Crf):
        self.model = model
        self.known: dict[str, int] = {"\n": -1}
        self.scores = np.zeros((0, len(model.labels)), np.float32)

    def _numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        fresh = set().union(*texts) - self.known.keys()
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known, self.scores = {"\n": -1}, self.scores[:0]
            fresh = set().union(*texts) - self.known.keys()
        new = sorted(fresh)
        self.known.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
        if new:
            self.scores = np.concatenate([self.scores, self.model.emissions(new)])
        get = self.known.__getitem__
        return [np.fromiter(map(get, t), np.int64, len(t)) for t in texts]

    def word_labels(self, text: str | None) -> list[tuple[str, str, float]]:
        """(word, label, probability) of every word of a text."""
        found = tokens(text or "")
        words = [t for t in found if t != "\n"]
        if not words or not self.model.labels:
            return [(w, UNKNOWN, 0.0) for w in words]
        numbers = self._numbers([found])[0]
        post = self._marginals(numbers)
        best = post.argmax(axis=1)
        return [(w, self.model.labels[k], float(p[k])) for w, k, p in zip(words, best, post)]

    def _marginals(self, numbers: np.ndarray) -> np.ndarray:
        ends = np.flatnonzero(numbers < 0)
        lengths = np.diff(np.r_[-1, ends, len(numbers)]) - 1
        return marginals(self.scores, numbers[numbers >= 0], lengths[lengths > 0], self.model.transitions)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """(label, score) of each text."""
        labels, values = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.model.labels:
            return labels, values
        batch: list[int] = []
        held: list[list[str]] = []
        size = 0
        for k, text in enumerate(texts):
            found = tokens(text) if text else []
            found.append("\n")
            batch.append(k)
            held.append(found)
            size += len(found)
            if size >= CHAIN_WORDS:
                self._flush(batch, held, labels, values)
                batch, held, size = [], [], 0
        if batch:
            self._flush(batch, held, labels, values)
        return labels, values

    def _flush(self, batch: list[int], held: list[list[str]], labels: list[str], values: list[float]) -> None:
        each = self._numbers(held)
        numbers = np.concatenate(each)
        owner = np.repeat(np.arange(len(each)), [len(e) for e in each])[numbers >= 0]
        if not len(owner):
            return
        post = self._marginals(numbers)
        n = np.bincount(owner, minlength=len(each))
        mean = np.stack([np.bincount(owner, post[:, k], len(each)) for k in range(post.shape[1])], axis=1) / np.maximum(n, 1)[:, None]
        best = mean.argmax(axis=1)
        for k, row in enumerate(batch):
            if n[k]:
                labels[row], values[row] = self.model.labels[best[k]], min(1.0, float(mean[k, best[k]]))


def held_out(doc_id: Column) -> Column:
    """True where the CRC-32 of the id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def excerpt(text: str, runs: int = RUNS) -> str:
    """At most ``runs`` runs of SEGMENT words of the text, a line each, evenly spread from its beginning to its end."""
    found: list[list[str]] = []
    for line in text.split("\n"):
        words = [w for w in tokens(line) if w != "\n"]
        found += [words[k : k + SEGMENT] for k in range(0, len(words), SEGMENT)]
    if len(found) > runs:
        found = [found[k * len(found) // runs] for k in range(runs)]
    return "\n".join(" ".join(run) for run in found)


_SAMPLE = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("text", pa.string())])


def _excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array([excerpt(t) for t in batch.column(2).to_pylist()], pa.string())], schema=_SAMPLE)


def fit(docs: DataFrame, per_label: int = PER_LABEL, max_sample: int = MAX_SAMPLE) -> Crf:
    """Train on a bounded sample of the documents (doc_id, text, lang) that are not held out.

    The driver gets excerpts of at most ``RUNS * SEGMENT`` words of at most ``max_sample`` documents (or one a label, if there are more labels).
    """
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # ids first: each task keeps its per_label smallest hashes of a label, and no text moves
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id")
    picked = known.select("doc_id", "lang").withColumn("place", F.row_number().over(by_hash)).filter(F.col("place") <= per_label)
    picked = stored(picked, "language-sample")
    labels = picked.filter("place = 1").count()
    each = max(1, min(per_label, max_sample // max(1, labels)))
    chosen = small(picked.filter(F.col("place") <= each).select("doc_id", "lang").distinct(), max_sample)
    # of repeated ids the smallest text
    texts = known.join(chosen, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = [{"doc_id": r["doc_id"], "lang": r["lang"], "sample": r["text"]} for r in texts.mapInArrow(tidy(_excerpts), "doc_id long, lang string, text string").collect()]
    dropped(picked)
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["lang"], r["sample"]))
    model = train([(r["sample"], r["lang"]) for r in rows])
    give_back()
    return model


def identify(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (prefixed by ``crf_`` where the input has such columns)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = []
    for name in ("lang_pred", "score"):
        while name in {c.lower() for c in docs.columns}:
            name = f"crf_{name}"
        names.append(name)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            labels, values = [], []
            for k in range(0, batch.num_rows, 500):
                found = labeller.predict(batch.column(at).slice(k, 500).to_pylist())
                labels += found[0]
                values += found[1]
            columns = [*batch.columns, pa.array(labels, pa.string()), pa.array(values, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    schema = docs.schema
    for name, kind in zip(names, ("string", "double")):
        schema = type(schema)([*schema.fields]).add(name, kind)
    return docs.mapInArrow(tidy(run), schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
