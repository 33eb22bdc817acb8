"""Operator 13: whitening of embedding vectors by spectral divide and conquer.

Sums and the centred covariance are partial sums of the partitions.  The covariance, as large as the
number of dimensions squared and no larger with more rows, is taken apart on the driver: the polar factor
U of ``V - s I``, found by dynamically weighted Halley steps on QR factors, gives the projector (U + I) / 2
on the eigenvectors above ``s``; an orthonormal basis of its range and of the rest splits V into two
smaller blocks, and so on until every block is one number.  The components are broadcast and every row is
whitened where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import staged

EPS = np.finfo(float).eps
LONG = 2**63 - 1


def polar(a: np.ndarray, steps: int = 40) -> np.ndarray:
    """Orthogonal polar factor of a square matrix by QR-based dynamically weighted Halley iteration."""
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    try:
        low = min(1.0, max(1 / np.linalg.norm(np.linalg.inv(x)), EPS))  # a lower bound of the smallest singular value
    except np.linalg.LinAlgError:
        low = EPS
    for _ in range(steps):
        d = np.cbrt(4 * (1 - low * low) / low**4) if low < 1 else 0.0
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low * low) / (low * low * np.sqrt(1 + d))))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack((np.sqrt(wc) * x, np.eye(n))))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        low = min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        moved = np.linalg.norm(new - x)
        x = new
        if moved < np.cbrt(8 * EPS) and 1 - low < 8 * EPS:
            break
    return x


def _basis(p: np.ndarray, k: int) -> np.ndarray:
    """Orthonormal columns, the first ``k`` in the range of the projector, the others in its complement."""
    most = np.argsort(-np.linalg.norm(p, axis=0), kind="stable")[:k]
    q, _ = np.linalg.qr(p @ np.linalg.qr(p[:, most])[0], mode="complete")
    first = q[:, :k]
    rest = q[:, k:] - p @ q[:, k:]
    rest -= first @ (first.T @ rest)
    return np.hstack((first, np.linalg.qr(rest)[0]))


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """(basis, size of the upper block), or None where all eigenvalues are one to double precision."""
    n = len(a)
    d = np.sort(np.diag(a))
    spread = np.linalg.norm(a - np.eye(n) * (np.trace(a) / n))
    if spread <= 4 * n * EPS * scale:
        return None
    best = None
    # the middle of the diagonal first: each block's share of the work is even then
    tries = [(d[(n - 1) // 2] + d[n // 2]) / 2, np.trace(a) / n, *(np.trace(a) / n + spread / n * x for x in (0.3, -0.3, 0.05, -0.05, 0.011, -0.011))]
    for s in tries:
        p = (polar(a - s * np.eye(n)) + np.eye(n)) / 2
        k = int(round(np.trace(p)))
        if not 0 < k < n:
            continue
        q = _basis(p, k)
        off = np.linalg.norm(q[:, :k].T @ a @ q[:, k:])
        if best is None or off < best[0]:
            best = off, q, k
        if off <= 8 * n * EPS * scale:  # the shift lay in a gap
            break
    return (best[1], best[2]) if best else None


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix."""
    n, scale = len(v), np.linalg.norm(v)
    values, vectors = np.zeros(n), np.eye(n)
    todo = [(0, v, np.eye(n))]
    while todo:
        at, a, q = todo.pop()
        cut = _split(a, scale) if len(a) > 1 and scale else None
        if cut is None:
            values[at : at + len(a)], vectors[:, at : at + len(a)] = np.diag(a), q
            continue
        basis, k = cut
        part = basis.T @ a @ basis
        part = (part + part.T) / 2
        todo += [(at, part[:k, :k], q @ basis[:, :k]), (at + k, part[k:, k:], q @ basis[:, k:])]
    vectors, r = np.linalg.qr(vectors)  # orthonormal to the last digit
    vectors *= np.sign(np.diag(r))
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for b in batches:
        if b.num_rows:
            x = _matrix(b)
            n += len(x)
            fits = max(x.max(), -x.min()) < 2**40  # times the rows of a batch
            total = (x.sum(0).astype(object) if fits else x.astype(object).sum(0)) + (0 if total is None else total)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total)), pa.array(list(map(str, total)))], names=["d", "n", "s"])


def _gram(mean: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                y = _matrix(b.slice(lo, 2000)) - mean
                out = y.T @ y + (0.0 if out is None else out)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(list(out), pa.list_(pa.float64()))], names=["d", "row"])

    return run


def _add(key, table):
    rows = table.column("row").combine_chunks()
    total = rows.flatten().to_numpy().reshape(len(rows), -1).sum(0)
    return pa.table({"d": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([total], pa.list_(pa.float64()))})


def covariance(x: DataFrame, mean: np.ndarray, n: int) -> np.ndarray:
    """Of the long vectors ``x`` around ``mean``, divisor n: each partition sends one row for each dimension,
    the rows of a dimension are added up by tens of partitions and then altogether."""
    rows = x.select("x").mapInArrow(_gram(mean), "d int, row array<double>")
    rows = rows.withColumn("g", F.floor(F.spark_partition_id() / 50))
    some = rows.groupBy("d", "g").applyInArrow(_add, "d int, row array<double>")
    out = np.zeros((len(mean), len(mean)))
    for d, row in some.groupBy("d").applyInArrow(_add, "d int, row array<double>").collect():  # a row for each dimension
        out[d] = row
    return (out + out.T) / (2 * n)


def _whiten(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, mean, w = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                if not part.num_rows:
                    continue
                x = _matrix(part)
                bound = max(abs(int(x.max()) * n - s) for s in sums) + max(abs(int(x.min()) * n - s) for s in sums)
                if bound * bound * len(sums) <= LONG:
                    deviation = ((x * n - np.array(sums, np.int64)) ** 2).sum(1).tolist()
                else:
                    deviation = [sum((v * n - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
                out = (x - mean) @ w
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array([d if d <= LONG else None for d in deviation], pa.int64()), pa.array(list(out), pa.list_(pa.float64()))],
                    names=["vec_id", "deviation", "w"])

    return run


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): floor(1024 c) + 100000 of every component.  Vectors that are null, empty or hold a null or
    non-finite entry take no part, nor those with an entry beyond 2**52, where the sum isn't exact."""
    v = F.col("embedding").cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * 1024) < 2.0**52))
    rows = embeddings.where(fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c * 1024).cast("long") + 100_000).alias("x"))


def whiten(embeddings: DataFrame, components: int = 8) -> DataFrame:
    """Per remaining row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    All remaining vectors are the fit list.  Where lengths differ, the most frequent one counts (the longest
    of equally frequent ones) and the others take no part.  Components whose eigenvalue is 0 to double
    precision can't be scaled to variance 1 and are left out, so that one row, or rows that are all equal,
    give no result, and an empty table an empty one.  ``deviation`` is null where it doesn't fit into a long.
    Rows that repeat count and come out as often as they came in, a null vec_id stays null; columns besides
    vec_id and embedding are left out.  ``identity_error`` is measured on the whitened rows.
    """
    spark = embeddings.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = integer_vectors(embeddings)
    sizes = sorted((c, k) for k, c in x.groupBy(F.size("x").alias("k")).count().collect())  # a row for each length
    if not sizes:
        return spark.createDataFrame([], schema)
    n, dims = sizes[-1]
    x = x.where(F.size("x") == dims)
    parts = x.mapInArrow(_sums, "d int, n long, s string").groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = [int(s) for _, s in sorted(parts.collect())]  # a row for each dimension
    mean = np.array([s / n for s in sums])
    v = covariance(x, mean, n)
    values, vectors = eigen(v)
    keep = min(components, int((values > dims * EPS * 16 * max(values[0], 0.0)).sum())) if values[0] > 0 else 0
    if not keep:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast((n, sums, mean, vectors[:, :keep] / np.sqrt(values[:keep])))
    rows = staged(x.mapInArrow(_whiten(shared), "vec_id long, deviation long, w array<double>"), "whitened")
    own = rows.select(*[F.get("w", F.lit(k)).alias(f"w{k}") for k in range(keep)])
    pairs = [(i, j) for i in range(keep) for j in range(i, keep)]
    got = own.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(got, pairs))
    share = F.array(*[F.lit(float(e / np.trace(v))) for e in values[:keep]])
    out = rows.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return out.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, "k").alias("explained"), F.lit(float(error)).alias("identity_error"))
