"""Best-fit packing of documents into fixed-size training sequences, without conflicts in a bin.

Documents are cut into pieces of at most ``capacity`` words. Full pieces fill bins of their own; each
remainder goes, longest first, into the bin with the least free room that can take it and holds neither
its source nor its duplicate cluster. Bins are kept ordered by free room and carry a bitmap of sources and
a bitmap of clusters; the search starts at the first bin with enough room and goes on to its successors until
a compatible one is found. If there is none, a bin is opened.

Pieces are dealt to groups of about ``group_rows`` rows by a hash of id, length and cluster, so no source or cluster
can crowd a group, and their number grows with the input; a group is packed in one task's bounded memory. Rows that are alike in all three
lie in one group up to ``COPIES`` of them; more are dealt over several groups by their place in the stored table.
Texts are read once and do not move: only ids, lengths and two keys are shuffled. At most the last bins of a group stay part-filled.

Words are runs without space or tab to carriage return; a duplicate cluster is a text's lower-cased (A-Z) words.

Cases: a null or word-less text has no pieces and no row; a document without an id is packed like any other, its id stays null; a null source
or cluster conflicts with nothing; repeated rows are packed each, and conflict through their equal cluster; the order among equals is by id, then piece;
an empty table gives no rows; extra columns are ignored. ``capacity`` counts words plus one separator per piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import small, stored, tidy

#: Words in one training sequence.
CAPACITY = 4096
#: Remainders packed together in one task.
GROUP_ROWS = 8192
#: Rows of one id, length and cluster in one group.
COPIES = 64
#: Bins looked at in one step of the successor search.
STRIDE = 256

_BINS = pa.schema(
    [("bin_group", pa.int32()), ("bin", pa.int32()), ("slot", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("run", pa.int32()), ("n_words", pa.int64())]
)


class Bins:
    """Open bins ordered by free room, with bitmaps of the sources and clusters they hold."""

    def __init__(self, capacity: int, n: int, n_sources: int, n_clusters: int):
        self.capacity, self.used = capacity, 0
        self.free = np.zeros(n, np.int64)  # ascending over the first `used` places
        self.order = np.zeros(n, np.int64)  # the bins in that order
        self.count = np.zeros(n, np.int64)
        self.sources = np.zeros((n, n_sources // 64 + 1), np.uint64)
        self.clusters = np.zeros((n, n_clusters // 64 + 1), np.uint64)

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, slot) of the tightest compatible bin; -1 stands for no source or no cluster."""
        at = int(np.searchsorted(self.free[: self.used], size))
        place = -1
        while at < self.used and place < 0:
            bins = self.order[at : min(at + STRIDE, self.used)]
            taken = np.zeros(len(bins), np.uint64)
            for key, bits in ((source, self.sources), (cluster, self.clusters)):
                if key >= 0:
                    taken |= bits[bins, key >> 6] & np.uint64(1 << (key & 63))
            fits = np.flatnonzero(taken == 0)
            if len(fits):
                place = at + int(fits[0])
            at += STRIDE
        if place < 0:
            bin_, left = self.used, self.capacity - size
            place, self.used = self.used, self.used + 1
        else:
            bin_, left = int(self.order[place]), int(self.free[place]) - size
        # the bin's room shrank: it moves down to its new place
        to = int(np.searchsorted(self.free[:place], left))
        self.free[to + 1 : place + 1] = self.free[to:place].copy()
        self.order[to + 1 : place + 1] = self.order[to:place].copy()
        self.free[to], self.order[to] = left, bin_
        for key, bits in ((source, self.sources), (cluster, self.clusters)):
            if key >= 0:
                bits[bin_, key >> 6] |= np.uint64(1 << (key & 63))
        self.count[bin_] += 1
        return bin_, int(self.count[bin_]) - 1


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    """Dense numbers of a column's values, -1 for null."""
    coded = column.combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return np.asarray(coded.indices.fill_null(-1), dtype=np.int64)


def pack(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit bins and slots for pieces in the given order."""
    bins = Bins(capacity, len(sizes), int(sources.max(initial=-1)) + 1, int(clusters.max(initial=-1)) + 1)
    placed = [bins.put(int(s), int(a), int(b)) for s, a, b in zip(sizes, sources, clusters)]
    out = np.asarray(placed, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def _pack_group(capacity: int):
    """One row for each remainder, and one for the run of full pieces of each document: its first bin and piece, and their number."""
    room = capacity - 1

    def run(key: tuple, group: pa.Table) -> pa.Table:
        words = np.asarray(group["n_words"], np.int64)
        null = np.asarray(group["doc_id"].is_null())
        ids = np.asarray(group["doc_id"].fill_null(np.iinfo(np.int64).min), np.int64)
        hash_group, pieces, left = key[0].as_py(), words // room, words % room
        # full pieces: a bin each, numbered by document and piece
        by_id = np.lexsort((words, ids, ~null))  # rows without an id come first
        by_id = by_id[pieces[by_id] > 0]
        runs, n_full = pieces[by_id], len(by_id)
        zeros = np.zeros(n_full, np.int32)
        full = [np.full(n_full, -1 - hash_group, np.int32), (np.cumsum(runs) - runs).astype(np.int32), zeros, ids[by_id], zeros, runs.astype(np.int32), np.full(n_full, room, np.int64)]
        # remainders: longest first into the best-fitting bin
        order = np.lexsort((pieces, ids, ~null, -left))
        order = order[left[order] > 0]
        sources, clusters = _keys(group["source"])[order], _keys(group["cluster"])[order]
        # clusters with one piece here conflict with nothing
        sizes = np.bincount(clusters[clusters >= 0], minlength=1)
        clusters = np.where((clusters >= 0) & (sizes[clusters] > 1), clusters, -1)
        clusters[clusters >= 0] = np.unique(clusters[clusters >= 0], return_inverse=True)[1]
        bins, slots = pack(left[order] + 1, sources, clusters, capacity)
        n = len(order)
        rest = [np.full(n, hash_group, np.int32), bins.astype(np.int32), slots.astype(np.int32), ids[order], pieces[order].astype(np.int32), np.ones(n, np.int32), left[order]]
        columns = [pa.array(np.concatenate(both), kind) for both, kind in zip(zip(rest, full), _BINS.types)]
        columns[3] = pa.array(np.concatenate([ids[order], ids[by_id]]), mask=np.concatenate([null[order], null[by_id]]))
        return pa.Table.from_arrays(columns, schema=_BINS)

    return run


_PIECES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("source", pa.string()), ("cluster", pa.string())])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each whole text, and the digest of its lower-cased words where no cluster is given."""
    for batch in batches:
        counts, clusters = [], []
        for text, given in zip(batch.column(1), batch.column(3).to_pylist()):
            words = text.as_buffer().to_pybytes().lower().split() if text.is_valid else []
            counts.append(len(words))
            clusters.append(given or (hashlib.blake2b(b" ".join(words), digest_size=16).hexdigest() if words else None))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), batch.column(2), pa.array(clusters, pa.string())], schema=_PIECES)


def best_fit_bins(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Bins for a stored table of (doc_id, n_words, source, cluster) rows: bin_group, bin, slot, doc_id, piece, start_word, n_words.

    Full pieces get bins of group -1 - (their hash group), one each, numbered by document and piece in the same grouped pass.
    """
    room = capacity - 1
    rows = pieces.filter("n_words > 0")
    n = rows.agg(F.count("*").alias("n")).first()["n"]
    groups = max(1, -(-n // group_rows))
    alike = ["doc_id", "n_words", "cluster"]
    many = rows.groupBy(*alike).agg(F.count("*").alias("copies")).filter(F.col("copies") > COPIES)
    many = small(stored(many.select(*(F.col(c).alias(f"many_{c}") for c in alike), "copies"), "many-copies"))
    same = F.lit(True)
    for c in alike:
        same &= F.col(c).eqNullSafe(F.col(f"many_{c}"))
    placed = rows.withColumn("copy", F.xxhash64(F.col("_metadata.file_name"), F.col("_metadata.row_index"))).join(many, same, "left")
    share = F.when(F.col("copies").isNull(), 0).otherwise(F.pmod("copy", F.ceil(F.col("copies") / COPIES)))
    dealt = placed.select(
        F.pmod(F.xxhash64(*alike, share, F.lit(11)), F.lit(groups)).cast("int").alias("bin_group"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        "source",
        "cluster",
    )
    ddl = "bin_group int, bin int, slot int, doc_id long, piece int, run int, n_words long"
    packed = dealt.groupBy("bin_group").applyInArrow(_pack_group(capacity), ddl)
    # the pieces of a run lie in consecutive bins
    packed = packed.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("run") - 1)))
    packed = packed.withColumns({"bin": F.col("bin") + F.col("step"), "piece": F.col("piece") + F.col("step")})
    return packed.select("bin_group", "bin", "slot", "doc_id", "piece", (F.col("piece").cast("long") * room).alias("start_word"), "n_words")


def pack_documents(docs: DataFrame, cluster_col: str | None = None, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Bins for documents (doc_id, text, source); clusters are equal texts unless a column gives them."""
    given = F.col(cluster_col).cast("string") if cluster_col else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), given.alias("cluster"))
    pieces = stored(rows.mapInArrow(tidy(_measure), "doc_id long, n_words long, source string, cluster string"), "pieces")
    return best_fit_bins(pieces, capacity, group_rows)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of ``CAPACITY`` words."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
