"""Exact n-gram Jaccard self-join by rare-first prefix filtering, and its connected components.

A document is the set of its distinct word n-grams (64-bit hashes). Two documents link when their Jaccard
similarity reaches the threshold; components are the sets of documents reachable by links.

1. One scan hashes every text: the set's size, a 128-bit digest of the set, its parity sketch, and a counting sketch of
   n-gram frequencies of fixed size. Equal sets form one class, so copies are never expanded into pairs.
2. A second scan orders each set rarest first (by sketch class, then hash: one order for all documents) and emits the
   prefix that any partner must share a gram with, with its position. A task emits equal sets once.
3. Grams with one class are dropped. Candidates pass the length, positional and suffix filters (the suffix
   filter counts the bits in which the sets' parity sketches differ, a bound on the grams that only one of them has), are
   made distinct, and are verified once per pair on the whole sets, which only documents of the remaining pairs give.
4. Pairs are made in star turns: each gram's classes meet one hub of their gram, the class that most lists hold (in a group
   of near copies the one with fewest grams of its own), so a group of k near copies gives k pairs, not k squared.
   Components are built, lists that hold one component only are closed, and the hub, which has met all others of its
   list, leaves it. After ``STAR_TURNS`` turns all pairs that still share an open list are made. Pairs inside a component
   cannot change the answer and a pair that was refused is not made again, so none that matters is lost.
5. Components grow by large-star and small-star rounds over stored tables.

Fixed-size parts: the sketch (one byte a cell after counting). Everything else is shuffled by gram, pair or class. A gram's
rows never meet in one task by a window: counts and hubs are partial aggregates, and the joins back to the rows have one
row a gram on the other side, so that Spark may split a gram with very many rows.

Cases: A-Z are lower-cased; a text with fewer words than n is one gram, its whole word sequence; null, empty and
word-less texts are empty sets, linked with nothing, in a component of their own; repeated rows are
copies; a null id is no document (its row has a null component unless copies have ids); rows with one id and
different texts are different documents of one component name; an empty table gives no rows; extra columns are ignored.
Hash collisions: two different grams of one pair collide with odds of about 1e-14 for a pair of 500 grams.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldloom.llm.common import dropped, random_table, slices, small, splitmix, stored, tidy, utf8

#: Cells of the frequency sketch, and of one shuffled slice of it.
SKETCH_CELLS, SLICE_CELLS = 1 << 22, 1 << 16
#: Bits of a parity sketch: so many for each gram of the set or more, a power of two, at least as many as the folded
#: sketch has that is compared while pairs are made, and at most the last number (beyond it the filter is weaker, not wrong).
BITS_PER_GRAM, FOLDED_BITS, MAX_BITS = 2, 512, 1 << 20
_FOLDED = [f"p{k}" for k in range(FOLDED_BITS // 64)]
#: The grams that a set has in lists just before this one, in the common order.
_BEFORE = ["before1", "before2"]
#: Versions of one slice of the sketch that are added in one task.
FAN_IN = 64
#: Star turns before all remaining pairs are made.
STAR_TURNS = 3
#: Bytes of text hashed at a time.
BLOCK_BYTES = 1_000_000

_BYTE = random_table(256, 900)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of texts laid end to end; A-Z count as a-z."""
    raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    solid = ~space
    begins = np.flatnonzero(solid & (edge[:-1] | np.r_[True, space[:-1]]))
    ends = np.flatnonzero(solid & (edge[1:] | np.r_[space[1:], True])) + 1
    # prefix sums of byte * base**-place give any slice's polynomial hash
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers(_INVERSE, len(raw)), out=sums[1:])
    hashes = (sums[ends] - sums[begins]) * _powers(_BASE, len(raw) + 1)[begins]
    rows = np.searchsorted(offsets, begins, side="right") - 1
    return splitmix(hashes ^ (ends - begins).astype(np.uint64)), rows


def gram_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct grams of consecutive rows end to end, their n + 1 offsets), part by part."""
    whole, offsets = utf8(column)
    with np.errstate(over="ignore"):
        for first, last in slices(offsets, BLOCK_BYTES):
            at = offsets[first : last + 1] - offsets[first]
            raw = whole[offsets[first] : offsets[last]]
            if not len(raw):
                yield first, np.zeros(0, np.uint64), np.zeros(last - first + 1, np.int64)
                continue
            words, rows = word_hashes(raw, at)
            counts = np.bincount(rows, minlength=last - first)
            mult = np.uint64(0xD6E8FEB86659FD93)
            grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
            for k in range(n):
                grams = grams * mult + words[k : k + len(grams)]
            inside = rows[: len(grams)] == rows[n - 1 : n - 1 + len(grams)] if len(grams) else np.zeros(0, bool)
            grams, owner = splitmix(grams[inside]), rows[: len(grams)][inside]
            short = np.flatnonzero((counts > 0) & (counts < n))
            if len(short):
                starts = np.cumsum(counts) - counts
                lone = []
                for row in short:
                    h = np.uint64(counts[row])
                    for w in words[starts[row] : starts[row] + counts[row]]:
                        h = h * mult + w
                    lone.append(h)
                grams = np.concatenate([grams, splitmix(np.array(lone, np.uint64) ^ np.uint64(77))])
                owner = np.concatenate([owner, short])
            order = np.lexsort((grams, owner))
            grams, owner = grams[order], owner[order]
            keep = np.ones(len(grams), bool)
            keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
            grams, owner = grams[keep], owner[keep]
            yield first, grams, np.searchsorted(owner, np.arange(last - first + 1))


def _cells(grams: np.ndarray, cells: int) -> np.ndarray:
    return (grams >> np.uint64(20)).astype(np.int64) & (cells - 1)


_SCAN = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("parity", pa.binary()), ("slice", pa.int32()), ("blob", pa.binary())])
_SCAN_DDL = "doc_id long, n long, d1 long, d2 long, parity binary, slice int, blob binary"


def _scan(n: int, cells: int) -> Callable:
    """First pass: a row per document, then a row per used slice of this task's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(cells, np.uint32)
        for batch in batches:
            ids = batch.column(0)
            for first, grams, offsets in gram_sets(batch.column(1), n):
                np.add.at(sketch, _cells(grams, cells), np.uint32(1))
                bounds = offsets.tolist()
                sets = [grams[x:y] for x, y in zip(bounds, bounds[1:])]
                digests = b"".join([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets])
                halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
                parities = pa.array([_parity(x).tobytes() if len(x) else None for x in sets], pa.binary())
                m = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, m).cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(halves[:, 0]), pa.array(halves[:, 1]), parities, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                    schema=_SCAN,
                )
        for k in range(cells // SLICE_CELLS):
            part = sketch[k * SLICE_CELLS : (k + 1) * SLICE_CELLS]
            if part.any():
                yield pa.RecordBatch.from_pylist([{"slice": k, "blob": zlib.compress(part.tobytes(), 1)}], schema=_SCAN)

    return run


def _total(group: pa.Table) -> np.ndarray:
    """The sum of the group's slices."""
    total = np.zeros(SLICE_CELLS, np.uint64)
    for blob in group["blob"]:
        total += np.frombuffer(zlib.decompress(blob.as_py()), np.uint32)
    return total


def _some_slices(key: tuple, group: pa.Table) -> pa.Table:
    """The sum of some of the tasks' versions of one slice; counts end at the greatest of 32 bits, where the classes of rarity end too."""
    total = np.minimum(_total(group), np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["slice", "blob"])


def _add_slices(key: tuple, group: pa.Table) -> pa.Table:
    """The sum of one slice over all tasks, as one byte a cell: 8 classes to each doubling."""
    level = np.minimum(255, np.round(8 * np.log2(_total(group) + 1.0))).astype(np.uint8)
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["slice", "levels"])


def _sketch(scan: DataFrame, cells: int) -> np.ndarray:
    """The merged sketch on the driver: ``cells`` bytes whatever the input.

    There is a version of each slice for each task of the scan, so they are added ``FAN_IN`` or so at a time until few are left.
    """
    slices_, held = scan.filter("slice is not null").select("slice", "blob"), []
    while True:
        most = slices_.groupBy("slice").count().agg(F.max("count").alias("n")).first()["n"] or 0
        if most <= 2 * FAN_IN:
            break
        salt = F.pmod(F.xxhash64("blob"), F.lit(-(-most // FAN_IN))).alias("salt")
        slices_ = stored(slices_.groupBy("slice", salt).applyInArrow(_some_slices, "slice int, blob binary"), "sketch-slices")
        held.append(slices_)
    rows = slices_.groupBy("slice").applyInArrow(_add_slices, "slice int, levels binary").collect()
    dropped(*held)
    out = np.zeros(cells, np.uint8)
    for row in rows:
        out[row["slice"] * SLICE_CELLS : (row["slice"] + 1) * SLICE_CELLS] = np.frombuffer(row["levels"], np.uint8)
    return out


_PREFIX = pa.schema([("gram", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
_FOLDS = pa.schema([("node", pa.int64()), ("cls", pa.int64()), ("size", pa.int32()), ("parity", pa.binary()), *((p, pa.int64()) for p in _FOLDED)])


def _with_folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, cls, size, parity) rows with the folded sketch."""
    for batch in batches:
        if batch.num_rows:
            folded = np.array([_fold(np.frombuffer(x.as_buffer(), np.uint8), FOLDED_BITS // 8) for x in batch.column(3)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in folded.T.copy())], schema=_FOLDS)


def _prefixes(n: int, percent: int, cells: int, levels) -> Callable:
    """Second pass: (gram, class, set size, position) of every prefix gram; equal sets once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        level = levels.value
        for batch in batches:
            for _, grams, offsets in gram_sets(batch.column(1), n):
                if not len(grams):
                    continue
                sizes = np.diff(offsets)
                data, at = grams.tobytes(), (offsets * 8).tolist()
                fresh = np.zeros(len(sizes), bool)
                classes = np.zeros(len(sizes), np.int64)
                for k in np.flatnonzero(sizes):
                    digest = hashlib.blake2b(data[at[k] : at[k + 1]], digest_size=16).digest()
                    classes[k] = int.from_bytes(digest[:8], "little", signed=True)
                    if digest not in seen:
                        if len(seen) >= 200_000:  # bounded; a set emitted twice is made distinct later
                            seen.clear()
                        seen.add(digest)
                        fresh[k] = True
                owner = np.repeat(np.arange(len(sizes)), sizes)
                mine = fresh[owner]
                owner, kept = owner[mine], grams[mine]
                order = np.lexsort((kept, level[_cells(kept, cells)], owner))
                owner, kept = owner[order], kept[order]
                pos = np.arange(len(kept)) - np.searchsorted(owner, owner)
                total = sizes[owner]
                short = pos < total - -(-percent * total // 100) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kept[short].view(np.int64)), pa.array(classes[owner[short]]), pa.array(total[short].astype(np.int32)), pa.array(pos[short].astype(np.int32))],
                    schema=_PREFIX,
                )

    return run


def _class_of(blob: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(blob, digest_size=16).digest()[:8], "little", signed=True)


def _parity(grams: np.ndarray) -> np.ndarray:
    """Bytes of the sketch: bit k tells whether an odd number of the grams have k as the low bits of their hash.

    A gram of one set only turns one bit, so two sets differ in at least as many grams as their sketches in bits.
    """
    bits = min(MAX_BITS, max(FOLDED_BITS, 1 << (BITS_PER_GRAM * max(1, len(grams)) - 1).bit_length()))
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def _fold(parity: np.ndarray, size: int) -> np.ndarray:
    """The sketch of ``size`` bytes of the same set."""
    return np.bitwise_xor.reduce(parity.reshape(-1, size), axis=0)


_PAIR, _PAIR_DDL = ("a", "ca", "b", "cb"), "a long, ca long, b long, cb long"
_SETS = pa.schema([("node", pa.int64()), ("cls", pa.int64()), ("grams", pa.binary())])


def _sets(n: int) -> Callable:
    """The whole set of each document whose class is the one asked for (doc_id, text, cls)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asked = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, grams, offsets in gram_sets(batch.column(1), n):
                data, at = grams.tobytes(), (offsets * 8).tolist()
                rows = [(ids[k], asked[k], data[x:y]) for k, (x, y) in enumerate(zip(at, at[1:]), first) if _class_of(data[x:y]) == asked[k]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SETS.types)], schema=_SETS)

    return run


def _suffix(percent: int) -> Callable:
    """Pairs (a, ca, b, cb, pa, pb, na, nb) whose parity sketches leave enough room for the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            total = np.asarray(batch.column(6)).astype(np.int64) + np.asarray(batch.column(7))
            for x, y, both in zip(batch.column(4), batch.column(5), total):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                size = min(len(x), len(y))
                apart = int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum())
                keep.append(apart * (100 + percent) <= int(both) * (100 - percent))
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(percent: int) -> Callable:
    """Pairs of sets whose similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            keep = []
            for k in range(batch.num_rows):
                x, y = np.frombuffer(a[k].as_buffer(), np.uint64), np.frombuffer(b[k].as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def connected(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of every node of (a, b) edges, by alternating stars; a stored table."""
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    links = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before, earlier = mark(links), links
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: every larger neighbour of a node goes to the smallest of its neighbourhood
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        links = stored(small.filter("a <> b").distinct(), "links")
        now = mark(links)
        dropped(earlier)
        earlier = links
        if now == before:
            break
        before = now
    out = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out.stored_path = links.stored_path
    return out


def _bound_ok(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Length and positional filters of a pair that shares a gram at these positions."""
    longest, shortest = F.greatest(n1, n2), F.least(n1, n2)
    length = shortest * 100 >= longest * percent
    # overlap needed: percent / (100 + percent) of the sum of sizes
    possible = F.lit(1) + F.least(n1 - p1 - 1, n2 - p2 - 1) + F.least(p1, p2)
    return length & (possible * (100 + percent) >= (n1 + n2) * percent)


def _verified(close: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The (a, b) pairs of a stored table that pass the exact check on whole sets.

    Only the documents of these pairs are read as text; few ids are broadcast by Spark, many are joined by a shuffle.
    """
    side = lambda df, node, **named: df.select(F.col("node").alias(node), *(F.col(c).alias(k) for k, c in named.items()))
    ends = close.select(F.col("a").alias("doc_id"), F.col("ca").alias("cls")).unionByName(close.select(F.col("b").alias("doc_id"), F.col("cb").alias("cls")))
    asked = stored(ends.distinct(), "asked")
    sets = stored(docs.join(asked, "doc_id").select("doc_id", "text", "cls").mapInArrow(tidy(_sets(n)), "node long, cls long, grams binary").dropDuplicates(["node", "cls"]), "sets")
    joined = close.join(side(sets, "a", ca="cls", ga="grams"), ["a", "ca"]).join(side(sets, "b", cb="cls", gb="grams"), ["b", "cb"])
    links = stored(joined.select("a", "b", "ga", "gb").mapInArrow(tidy(_verify(percent)), "a long, b long").distinct(), "verified")
    dropped(asked, sets)
    return links


def _close(pairs: DataFrame, signatures: DataFrame, seen: list[DataFrame], percent: int) -> DataFrame:
    """The (a, ca, b, cb) pairs that were not verified before and whose parity sketches leave enough room for the overlap; a stored table.

    The sketches of the pairs' documents are drawn first, so that few pairs shuffle no sketches of all documents.
    """
    pairs = stored(_without(pairs, seen), "pairs")
    ends = pairs.select(F.col("a").alias("node"), F.col("ca").alias("cls")).unionByName(pairs.select(F.col("b").alias("node"), F.col("cb").alias("cls")))
    drawn = stored(signatures.select("node", "cls", "size", "parity").join(ends.distinct(), ["node", "cls"], "left_semi"), "drawn")
    side = lambda k: drawn.select(F.col("node").alias(k), F.col("cls").alias(f"c{k}"), F.col("parity").alias(f"p{k}"), F.col("size").alias(f"n{k}"))
    met = pairs.join(side("a"), ["a", "ca"]).join(side("b"), ["b", "cb"])
    close = stored(met.select(*_PAIR, "pa", "pb", "na", "nb").mapInArrow(tidy(_suffix(percent)), _PAIR_DDL), "close")
    dropped(pairs, drawn)
    return close


def _without(pairs: DataFrame, seen: list[DataFrame]) -> DataFrame:
    """``pairs`` without those that were verified before."""
    for done in seen:
        pairs = pairs.join(done, list(_PAIR), "left_anti")
    return pairs


def _as_pair(x: str, y: str) -> list[Column]:
    """a, ca, b, cb of two rows, the smaller node first."""
    swap = F.col(f"{x}.node") > F.col(f"{y}.node")
    pick = lambda p, q, c: F.when(swap, F.col(f"{q}.{c}")).otherwise(F.col(f"{p}.{c}"))
    return [pick(x, y, "node").alias("a"), pick(x, y, "cls").alias("ca"), pick(y, x, "node").alias("b"), pick(y, x, "cls").alias("cb")]


def _hubs(lists: DataFrame) -> DataFrame:
    """Of every list with several components its hub: the row that is in most lists."""
    row = F.struct("lists", F.xxhash64("node", "cls").alias("h"), "node", "cls", "n", "pos", "comp")
    found = lists.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(row).alias("hub"))
    return found.filter("lo <> hi").select("gram", "hub")


def _star(opened: DataFrame, percent: int) -> DataFrame:
    """Pairs of every row (with its list's ``hub``) of another component and the hub."""
    met = opened.filter("comp <> hub.comp").filter(_bound_ok(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), percent))
    return met.select(F.struct("node", "cls").alias("x"), "hub").select(*_as_pair("x", "hub")).distinct()


def _all_pairs(lists: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Every pair of rows of one list in different components that passes the filters.

    Rows meet in bands of set size: the larger set lies in the band of the smaller one or the next. A linked pair also passes
    at its first common gram, where no overlap lies before, so rows that also share one of their last listed grams wait for
    that list; and the folded parity sketches must leave enough room for the overlap.
    """
    # the small addend keeps exact powers in their own band
    band = F.floor(F.log(F.col("n").cast("double")) / float(max(np.log(100 / percent), 1e-6)) + 1e-9)
    known = lists.join(signatures.select("node", "cls", *_FOLDED), ["node", "cls"]).withColumn("band", band)
    x = known.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1))).alias("x")
    y = known.alias("y")
    apart = sum((F.bit_count(F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}"))) for p in _FOLDED), F.lit(0))
    total = F.col("x.n") + F.col("y.n")
    first = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    fits = (first * (100 + percent) >= total * percent) & (apart * (100 + percent) <= total * (100 - percent))
    same = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.band") == F.col("y.band"))
    later = sum((F.coalesce((F.col(f"x.{p}") == F.col(f"y.{q}")).cast("int"), F.lit(0)) for p in _BEFORE for q in _BEFORE), F.lit(0)) > 0
    ordered = F.struct("x.n", "x.node", "x.cls") < F.struct("y.n", "y.node", "y.cls")
    met = x.join(y, same & (F.col("x.comp") != F.col("y.comp")) & ordered & ~later & fits)
    return met.select(*_as_pair("x", "y")).distinct()


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, cells: int = SKETCH_CELLS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of documents (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scan = stored(docs.mapInArrow(tidy(_scan(n, cells)), _SCAN_DDL), "scan")
    levels = docs.sparkSession.sparkContext.broadcast(_sketch(scan, cells))
    found = scan.filter("slice is null").select("doc_id", "n", "d1", "d2", "parity")
    classes = stored(found.filter("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    named = docs.filter("doc_id is not null")
    prefixes = stored(named.mapInArrow(tidy(_prefixes(n, percent, cells, levels)), "gram long, cls long, n int, pos int"), "prefixes")
    levels.destroy()
    several = stored(prefixes.groupBy("gram").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo <> hi").select("gram"), "several")
    reps = classes.select(F.col("d1").alias("cls"), F.col("rep").alias("node"))
    own = Window.partitionBy("cls", "node")
    placed = {name: F.lag("gram", k).over(own.orderBy("pos")) for k, name in enumerate(_BEFORE, 1)}
    # a table of its own, so that the shuffle by gram is gone before the one by class begins
    shared = stored(prefixes.join(several, "gram"), "shared-prefixes")
    dropped(prefixes, several)
    met = shared.join(reps, "cls").dropDuplicates(["cls", "gram"])
    lists = stored(met.withColumns({**placed, "lists": F.count("*").over(own), "comp": F.col("node")}), "lists")
    dropped(shared)
    chosen = lists.select("node", "cls").distinct()
    drawn = found.select(F.col("doc_id").alias("node"), F.col("d1").alias("cls"), F.col("n").cast("int").alias("size"), "parity").join(chosen, ["node", "cls"], "left_semi").dropDuplicates(["node", "cls"])
    signatures = stored(drawn.mapInArrow(_with_folds, "node long, cls long, size int, parity binary, " + ", ".join(f"{p} long" for p in _FOLDED)), "signatures")

    seen: list[DataFrame] = []
    older: list[DataFrame] = []
    roots = docs.sparkSession.createDataFrame([], "node long, root long")
    rest = lists
    for turn in range(STAR_TURNS + 1):
        hubs = stored(_hubs(rest), "hubs")
        if hubs.isEmpty():
            dropped(hubs)
            break
        opened = rest.join(small(hubs), "gram")
        pairs = _star(opened, percent) if turn < STAR_TURNS else _all_pairs(opened, signatures, percent)
        close = _close(pairs, signatures, seen, percent)
        if not close.isEmpty():
            fresh = _verified(close, named, n, percent)
            roots = connected(fresh.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
            dropped(fresh, *older)
            older = [roots]
        seen.append(close)
        if turn < STAR_TURNS:
            left = opened.filter("node <> hub.node or cls <> hub.cls").drop("hub", "comp").join(roots, "node", "left")
            before, rest = rest, stored(left.withColumn("comp", F.coalesce("root", "node")).drop("root"), "open-lists")
            dropped(before)
        dropped(hubs)
    dropped(signatures, rest, *seen)
    named_classes = classes.join(roots, classes["rep"] == roots["node"], "left").select("d1", "d2", F.coalesce("root", "rep").alias("comp"))
    out = found.drop("parity").join(named_classes, ["d1", "d2"], "left")
    name = F.when((F.col("n") > 0) | F.col("doc_id").isNull(), F.col("comp")).otherwise(F.col("doc_id"))
    result = stored(out.select("doc_id", F.col("n").alias("n_shingles"), name.alias("component_id")), "components")
    dropped(scan, classes, *older)
    return result


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 4-word shingles and a similarity of 0.85."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, percent=85)
