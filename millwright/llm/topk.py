"""Operator 4: exact top-k inner products by term-at-a-time accumulation.

Vector components are the terms.  A candidate batch is held as postings, one dense weight row for
each term; the query rows are sparse.  Terms are taken one at a time and every query that has
the term scatters weight * posting into its dense score row.  Each batch selects its best rows
(a partial selection; ties at the cut stay in), and a ranked merge over all batches gives the result.

Queries are taken in blocks of at most ``block_rows``; a block is broadcast (its size is bounded by the
parameter), each block sees all candidates, and blocks are merged by union.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.llm.common import shared_folder

STEP = 4096


def integer_vectors(df: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; vectors that are null or hold null or
    non-finite components, and rows without an id, are left out; rows that repeat stay as they are,
    vectors of any length are taken whole, an empty one has no components."""
    x = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    fine = ~F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return x.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull()).where(fine).select("vec_id", F.transform("e", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _dense(column: pa.Array, width: int) -> np.ndarray:
    off = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    size = np.diff(off)
    row = np.repeat(np.arange(len(size)), size)
    col = np.arange(off[0], off[-1]) - np.repeat(off[:-1], size)
    ok = col < width
    out[row[ok], col[ok]] = flat[off[0] : off[-1]][ok]
    return out


def _scores(query: np.ndarray, postings: np.ndarray) -> np.ndarray:
    score = np.zeros((len(query), postings.shape[1]), np.int64)
    for term in range(query.shape[1]):
        rows = np.flatnonzero(query[:, term])
        if len(rows) and postings[term].any():
            score[rows] += query[rows, term, None] * postings[term]
    return score


def _select(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, query = shared.value
        best = [np.zeros(0, np.int64)] * 3  # query row, vec_id, score kept by this task
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                part = batch.slice(lo, STEP)
                vec = part.column("vec_id").to_numpy(zero_copy_only=False)
                postings = np.ascontiguousarray(_dense(part.column("v"), query.shape[1]).T)
                for q in range(0, len(ids), 256):
                    score = _scores(query[q : q + 256], postings)
                    own = ids[q : q + 256, None] == vec[None, :]
                    floor = np.iinfo(np.int64).min
                    score[own] = floor
                    cut = np.partition(score, -k, axis=1)[:, -k, None] if score.shape[1] > k else np.full((len(score), 1), floor)
                    row, col = np.nonzero((score >= cut) & ~own)
                    best = _top(*(np.concatenate(x) for x in zip(best, (row + q, vec[col], score[row, col]))), k)
        yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "vec_id", "score"])

    return run


def _top(row, vec, score, k: int):
    order = np.lexsort((vec, -score, row))
    row, vec, score = row[order], vec[order], score[order]
    lead = np.searchsorted(row, row, side="left")
    keep = np.arange(len(row)) - lead < k
    return [row[keep], vec[keep], score[keep]]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, block_rows: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query by inner product, ties to the
    smaller id; a candidate with the query's own id takes no part.

    Both inputs: (vec_id long, v array<long>).  Shorter vectors count as padded with zeros; queries
    that repeat an id are one query (its smallest vector); repeated candidates stay apart rows.  Without
    queries or without candidates the result is empty; further columns are left out.  Above ``block_rows``
    queries the blocks run as jobs when the function is called, with the same rows.
    """
    spark = queries.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    total = queries.count()
    if not total:
        return spark.createDataFrame([], _TOP)
    if total <= block_rows:
        return _block(queries, candidates, k)
    # one job for each block, its rows added to one table: no plan grows with the number of queries
    blocks = -(-2 * total // block_rows)
    path = f"{shared_folder(spark)}/millwright/top-k-{uuid.uuid4().hex}"
    for b in range(blocks):
        _block(queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b), candidates, k).write.mode("append").parquet(path)
    return spark.read.schema(_TOP).parquet(path)


_TOP = "query_id long, rank int, vec_id long, score long"


def _block(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """``top_k`` of one block of queries, about ``block_rows`` of them, that goes to all tasks."""
    spark = queries.sparkSession
    rows = queries.collect()
    query = np.zeros((len(rows), max((len(r[1]) for r in rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        query[i, : len(r[1])] = r[1]
    shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), query))
    found = candidates.select("vec_id", "v").mapInArrow(_select(shared, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
