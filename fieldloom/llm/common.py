"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.storage import shared_dir

#: Horizontal tab to carriage return, and the space: the separators of a word.
WHITESPACE = " \t\n\x0b\x0c\r"
#: Most rows and bytes of one Arrow batch: texts are long, and each batch is held by the JVM and by Python.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20
#: Java regular expression of one run of separators.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches for the session where it still has Spark's defaults: set once, so that concurrent queries meet no change."""
    for key, defaults, value in (("maxRecordsPerBatch", ("10000",), ARROW_ROWS), ("maxBytesPerBatch", ("67108864b", "67108864"), ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, None) in defaults:
            spark.conf.set(key, str(value))


#: Spark's own setting that removes an execution's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts lineage so that the loss of an executor never recomputes what lies before. The write's shuffle files go with it, as nothing
    reads them again. (That setting is the session's: a query that runs beside this write may lose its shuffle files at its own end
    too, which changes no result.)
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/fieldloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing reads any more (what was made of them is stored itself)."""
    for table_ in tables:
        jvm = table_.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table_.stored_path)
        path.getFileSystem(table_.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A stored table, with a broadcast hint if it has been counted to have at most ``most`` (narrow) rows; as it is beyond."""
    return F.broadcast(df) if df.count() <= most else df


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column laid end to end, and the n + 1 offsets of its rows (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes each (a longer row stands alone)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer, so that close inputs give unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_table(n: int, seed: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit numbers from a rule."""
    with np.errstate(over="ignore"):
        steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return splitmix(steps + np.uint64(seed))


_ASCII_LOWER = {code: code + 32 for code in range(65, 91)}


def ascii_lower(text: str) -> str:
    """``text`` with A-Z, and nothing else, in lower case."""
    return text.lower() if text.isascii() else text.translate(_ASCII_LOWER)


def parts_of(text: str, beyond: re.Pattern, size: int = 1 << 20) -> Iterator[str]:
    """``text`` in parts of ``size`` characters or some more, cut at characters that match ``beyond`` and so lie in no word."""
    at = 0
    while len(text) - at > size:
        cut = beyond.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


MapArrow = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """The memory of arrays that are gone goes back to the system: a process that lives on holds what it does not return."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: MapArrow) -> MapArrow:
    """``run``, after which the worker gives the memory of its arrays back, as workers outlive tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
