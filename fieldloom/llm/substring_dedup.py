"""Substring deduplication by content-defined chunks.

A gear hash rolls over a text's UTF-8 bytes; a chunk ends where a word begins and the hash of the 32 bytes before
has its top bits clear, so chunk ends depend on nearby content only and an insertion shifts no other chunk.
``MIN_BYTES`` and ``MAX_BYTES`` bound a chunk. Chunks with equal 128-bit digests are copies: the one with the
smallest (doc_id, text checksum, place) stays. Chunks are short, so that two texts cut a passage alike soon after it begins, but
a short copy is a phrase rather than a passage: copies go only where neighbouring ones make a run of ``MIN_RUN`` bytes or more.

The counting shuffle carries digests only and combines before it. Digests with more than a thousandth of all
chunks are fewer than a thousand by arithmetic; they are joined by broadcast, all other repeated digests by an
ordinary join, so no copied passage can fill one task. Texts move once, to meet their own removed spans,
and only those of documents that lose something are rebuilt.

Cases: a null text stays null; an empty text has no chunks; a text without word starts is cut at ``MAX_BYTES`` (never
inside a character); a passage repeated inside one document loses its later copies; repeated rows (equal id and
text) are one document and come out alike; equal ids with different texts are different documents; a null id counts
as the smallest; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import dropped, random_table, slices, stored, tidy, utf8

MIN_BYTES, MAX_BYTES = 32, 512
#: Least bytes of neighbouring copies that are removed.
MIN_RUN = 120
#: Top bits that must be clear: one word start in 2 ** BITS ends a chunk.
BITS = 2
#: Bytes hashed at a time.
BLOCK_BYTES = 4_000_000
#: A digest with more than this share of all chunks is joined by broadcast: there are fewer than 1 / HOT_SHARE.
HOT_SHARE = 0.001

_GEAR = (random_table(256, 20) >> np.uint64(32)).astype(np.uint32)
_CHUNKS = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("high", pa.int64()), ("low", pa.int64())])


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """At each byte the hash ``h = 2 h + gear[byte]`` (mod 2**32), which covers its last 32 bytes."""
    h = _GEAR[raw]
    for step in (1, 2, 4, 8, 16):  # doubles the number of bytes covered
        nxt = h.copy()
        nxt[step:] += h[:-step] << np.uint32(step)
        h = nxt
    return h


def chunk_ends(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, end) of every chunk of texts laid end to end; ends are places in ``raw``."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    calm = (gear_hash(raw) >> np.uint32(32 - BITS)) == 0
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    wide = raw >= 0xE0  # scripts without spaces: any of their characters may begin a word
    ok = np.zeros(n, bool)
    ok[1:] = calm[:-1] & ((space[:-1] & ~space[1:]) | (wide[1:] & (raw[:-1] >= 128)))
    cuts = np.flatnonzero(ok)
    firsts = np.searchsorted(cuts, offsets)
    inner = (raw & 0xC0) == 0x80
    rows: list[int] = []
    ends: list[int] = []
    cut_list = cuts.tolist()
    for row in range(len(offsets) - 1):
        at, stop = int(offsets[row]), int(offsets[row + 1])
        if at == stop:
            continue
        for k in range(firsts[row], firsts[row + 1]):
            cut = cut_list[k]
            if cut - at < MIN_BYTES:
                continue
            while cut - at > MAX_BYTES:
                at += MAX_BYTES
                while inner[at]:
                    at -= 1
                rows.append(row)
                ends.append(at)
            if cut - at >= MIN_BYTES and stop - cut >= MIN_BYTES:
                rows.append(row)
                ends.append(cut)
                at = cut
        while stop - at > MAX_BYTES:
            at += MAX_BYTES
            while inner[at]:
                at -= 1
            rows.append(row)
            ends.append(at)
        rows.append(row)
        ends.append(stop)
    return np.asarray(rows, np.int64), np.asarray(ends, np.int64)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every chunk: doc_id, version (CRC-32 of the text), start, size (bytes) and the digest's two halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, offsets = utf8(batch.column(1))
            ids = batch.column(0)
            for first, last in slices(offsets, BLOCK_BYTES):
                at = offsets[first : last + 1] - offsets[first]
                raw = whole[offsets[first] : offsets[last]]
                rows, ends = chunk_ends(raw, at)
                if not len(rows):
                    continue
                starts = np.where(np.r_[True, rows[1:] != rows[:-1]], at[rows], np.r_[0, ends[:-1]])
                data, digest = raw.tobytes(), hashlib.blake2b
                joined = b"".join([digest(data[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())])
                halves = np.frombuffer(joined, np.int64).reshape(-1, 2)
                bounds = at.tolist()
                versions = np.asarray([zlib.crc32(data[a:b]) for a, b in zip(bounds, bounds[1:])], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(first + rows)).cast(pa.int64()),
                        pa.array(versions[rows]),
                        pa.array((starts - at[rows]).astype(np.int32)),
                        pa.array((ends - starts).astype(np.int32)),
                        pa.array(halves[:, 0]),
                        pa.array(halves[:, 1]),
                    ],
                    schema=_CHUNKS,
                )

    return docs.select(id_col, text_col).mapInArrow(tidy(run), "doc_id long, version long, start int, size int, high long, low long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, version and ``spans`` (start, size in bytes, in order): the chunks of each document that came before."""
    found = stored(chunks(docs), "chunks")
    place = F.struct("doc_id", "version", "start")
    repeated = stored(
        found.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"), "repeated-chunks"
    )
    total = found.count()
    hot = repeated.filter(F.col("n") > max(1000.0, total * HOT_SHARE)).select("high", "low", F.col("first").alias("hot_first"))
    # the hot digests are fewer than 1 / HOT_SHARE rows, so this broadcast cannot grow with the data
    marked = found.join(F.broadcast(hot), ["high", "low"], "left")
    cold = repeated.filter(F.col("n") <= max(1000.0, total * HOT_SHARE)).select("high", "low", "first")
    later = lambda first: ~(place.eqNullSafe(first))
    spans = marked.filter("hot_first is not null").filter(later(F.col("hot_first"))).select("doc_id", "version", "start", "size")
    spans = spans.unionByName(
        marked.filter("hot_first is null").join(cold, ["high", "low"]).filter(later(F.col("first"))).select("doc_id", "version", "start", "size")
    )
    out = stored(spans.distinct().groupBy("doc_id", "version").agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("spans")), "spans")
    dropped(found, repeated)
    return out


def runs(spans: list[dict] | None, least: int) -> list[dict]:
    """The spans (in order) that lie in runs of neighbours with ``least`` bytes or more."""
    kept: list[dict] = []
    first = 0
    spans = spans or []
    for k, span in enumerate(spans):
        if k + 1 == len(spans) or spans[k + 1]["start"] != span["start"] + span["size"]:
            if span["start"] + span["size"] - spans[first]["start"] >= least:
                kept += spans[first : k + 1]
            first = k + 1
    return kept


def _without(text: str | None, spans: list[dict]) -> str | None:
    if not spans or text is None:
        return text
    raw, out, at = text.encode(), [], 0
    for span in spans:
        out.append(raw[at : span["start"]])
        at = span["start"] + span["size"]
    return b"".join([*out, raw[at:]]).decode()


def deduplicate(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text``, plus removed_spans (byte start and size) of each row."""
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        while name in taken:
            name = f"dedup_{name}"
        taken.add(name)
        return name

    spans_col, id_col, version_col = free("removed_spans"), free("span_id"), free("span_version")
    spans = repeated_spans(docs).select(F.col("doc_id").alias(id_col), F.col("version").alias(version_col), F.col("spans").alias(spans_col))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_col)) & (F.crc32(F.col("text").cast("binary")) == F.col(version_col))
    joined = docs.join(spans, same, "left").drop(id_col, version_col)
    names = joined.columns
    at_text, at_spans = names.index("text"), names.index(spans_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [runs(s, min_run) if s else None for s in batch.column(at_spans).to_pylist()]
            columns = list(batch.columns)
            columns[at_spans] = pa.array([s or None for s in held], batch.schema.field(at_spans).type)
            if any(held):
                texts = [_without(t, s) if s else t for t, s in zip(batch.column(at_text).to_pylist(), held)]
                columns[at_text] = pa.array(texts, batch.schema.field(at_text).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return joined.mapInArrow(tidy(run), joined.schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the chunks that came before, and what was removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    removed = F.coalesce(F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["size"]), F.lit(0).cast("long"))
    return deduplicate(docs).select(
        "doc_id",
        "text",
        F.coalesce(F.size("removed_spans"), F.lit(0)).cast("long").alias("n_removed_chunks"),
        removed.alias("removed_bytes"),
        "removed_spans",
    )
