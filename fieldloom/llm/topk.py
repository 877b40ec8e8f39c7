"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows (``floor(scale * x)``, zeros left out). The candidate rows are dealt
to shards of bounded size; a shard stores postings, built once: for each term (dimension) the rows that carry it and
their weights. The queries of a block are sparse rows too. A block is scored against a shard term by term: the query weights
times the posting weights are scattered into a dense score array, one line per query; terms that no query or no row
carries cost nothing, and memory grows with the non-zero weights, not with the dimension. ``argpartition`` selects
k per query and shard, and a ranked merge over the shards gives the answer.

Every query block meets every shard exactly once through an equi-join on (shard, block) numbers; both
sides are bounded blocks, so memory does not grow with the tables. At Q queries and N rows the work is
Q * N * (terms) by definition of exhaustive search.

Cases: vectors that are null, or hold a null or non-finite component, take no part, neither as query nor
as candidate; vectors of different lengths score over their common leading dimensions (missing components
count 0); ties go to the smaller id; a query has fewer than k rows if there are fewer candidates; no
queries or no candidates give an empty result. A repeated candidate row counts each time; an exactly
repeated query row is answered once; a query id with several different vectors is answered for each.
A null id takes no part. Integer scores wrap like a 64-bit long beyond its range. Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows of one shard, and queries of one block: together they bound a task's memory.
SHARD_ROWS = 4096
BLOCK_QUERIES = 2048
#: Dense score cells held at once (8 bytes each).
SCORE_CELLS = 1_000_000

_PAIR = pa.schema([("query_id", pa.int64()), ("query_no", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component, as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """True for vectors that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & finite


Postings = dict[int, tuple[np.ndarray, np.ndarray]]


def postings(column: pa.ChunkedArray, places: np.ndarray) -> Postings:
    """Of a list column the non-zero weights by term: (rows, weights), where row k of the column counts as ``places[k]``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = np.asarray(column.flatten())
    rows = np.repeat(places, lengths)
    terms = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    held = np.flatnonzero(flat)
    order = held[np.lexsort((rows[held], terms[held]))]
    terms, rows, flat = terms[order], rows[order], flat[order]
    found, first = np.unique(terms, return_index=True)
    return {int(t): (rows[a:b], flat[a:b]) for t, a, b in zip(found, first, [*first[1:], len(terms)])}


def _select(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, row) of the k best cells of each line, ties to the smaller row."""
    n = scores.shape[1]
    if n <= k:
        line, row = np.indices(scores.shape)
        return line.ravel(), row.ravel()
    limit = np.int64(2**62) // n
    if int(scores.max(initial=0)) < limit and int(scores.min(initial=0)) > -limit:
        keys = scores * n + np.arange(n - 1, -1, -1)
        row = np.argpartition(keys, n - k, axis=1)[:, n - k :]
    else:
        row = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.repeat(np.arange(len(scores)), k), row.ravel()


def accumulate(asked: Postings, held: Postings, first: int, last: int, n_rows: int) -> np.ndarray:
    """Inner products of the queries ``first`` to ``last`` and all rows: one term's postings at a time into dense score lines."""
    scores = np.zeros((last - first, n_rows), np.int64)
    for term, (queries, weights) in asked.items():
        if term not in held:
            continue
        a, b = np.searchsorted(queries, (first, last))
        if a == b:
            continue
        rows, values = held[term]
        part = np.multiply.outer(weights[a:b], values)
        if len(rows) == n_rows and b - a == last - first:
            scores += part  # all lines and all rows carry the term
        else:
            scores[np.ix_(queries[a:b] - first, rows)] += part
    return scores


def _score_block(k: int):
    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = _PAIR.empty_table()
        if not left.num_rows or not right.num_rows:
            return empty
        order = np.argsort(np.asarray(right["vec_id"]), kind="stable")
        ids = np.asarray(right["vec_id"])[order]
        places = np.empty(len(ids), np.int64)
        places[order] = np.arange(len(ids))
        held = postings(right["vector"], places)
        q_ids, q_no = np.asarray(left["query_id"]), np.asarray(left["query_no"])
        asked = postings(left["vector"], np.arange(len(q_ids)))
        out = []
        step = max(1, SCORE_CELLS // max(1, len(ids)))
        for at in range(0, len(q_ids), step):
            scores = accumulate(asked, held, at, min(at + step, len(q_ids)), len(ids))
            # a query's own rows are one run of the sorted ids: more rows are selected, then those go
            lo, hi = np.searchsorted(ids, q_ids[at : at + step]), np.searchsorted(ids, q_ids[at : at + step], "right")
            line, row = _select(scores, min(len(ids), k + int((hi - lo).max(initial=0))))
            other = ids[row] != q_ids[at + line]
            line, row = line[other], row[other]
            value = scores[line, row]
            ranked = np.lexsort((row, -value, line))
            line, row, value = line[ranked], row[ranked], value[ranked]
            first = np.searchsorted(line, np.arange(len(scores)))
            best = np.arange(len(line)) - first[line] < k
            line, row, value = line[best], row[best], value[best]
            out.append(pa.table([q_ids[at + line], q_no[at + line], ids[row], value], schema=_PAIR))
        return pa.concat_tables(out) if out else empty

    return score


def exact_top_k(
    queries: DataFrame,
    rows: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The k highest-scoring rows of each query: query_id, query_no, rank (from 1), vec_id, score."""
    shape = lambda df: df.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("vector")
    )
    candidates, asked = shape(rows), shape(queries).distinct()
    count = lambda df: df.agg(F.count("*").alias("n")).first()["n"]
    parts = rows.sparkSession.sparkContext.defaultParallelism
    n_rows, n_queries = count(rows.select(id_col)), count(queries.select(id_col))
    shards = max(min(parts * 2, n_rows // 256), -(-n_rows // shard_rows), 1)
    blocks = max(1, -(-n_queries // block_queries))
    salt = F.xxhash64("vec_id", "vector", F.lit(7))
    left = (
        asked.select(F.col("vec_id").alias("query_id"), F.xxhash64("vector").alias("query_no"), F.pmod(salt, F.lit(blocks)).cast("int").alias("block"), "vector")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )
    right = candidates.withColumn("shard", F.pmod(salt, F.lit(shards)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    schema = T.StructType([T.StructField(f.name, T.LongType()) for f in _PAIR])
    best = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_score_block(k), schema)
    order = Window.partitionBy("query_id", "query_no").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "query_no", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id is divisible by 50, searched among all rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return exact_top_k(rows.filter(F.col("vec_id") % 50 == 0), rows).select("query_id", "rank", "vec_id", "score")


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

