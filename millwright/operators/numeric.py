"""Small influence and level models: Spark aggregates, tiny solves on what is left."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.operators.ranks import order_statistics
from millwright.sources.staging import staged


def neighbours(dg: Column | str, k: int = 2) -> Column:
    """M1: for every zone its 2k+1 neighbours, zero beyond the edges."""
    dg = F.col(dg) if isinstance(dg, str) else dg
    pad = F.array_repeat(F.lit(0.0), k)
    padded = F.concat(pad, dg, pad)
    return F.transform(F.sequence(F.lit(1), F.size(dg)), lambda z: F.slice(padded, z, 2 * k + 1))


def _demean(a: Column) -> Column:
    fine = F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x))
    mean = F.aggregate(fine, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(fine), F.lit(0))
    return F.transform(a, lambda x: x - mean)


def _kernel_rows(samples: DataFrame, k: int, *keep: str) -> DataFrame:
    """(x, y) of every measured zone of every sample: its 2k+1 neighbours and its response, both without the sample's mean."""
    rows = samples.select(*keep, F.explode(F.arrays_zip(neighbours(_demean(F.col("dg")), k).alias("x"), _demean(F.col("dw")).alias("y"))).alias("r")).select(*keep, "r.x", "r.y")
    return rows.where(F.col("y").isNotNull() & ~F.isnan("y") & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))


def _kernel_sums(n: int) -> list[Column]:
    """Sums of x x', of x y and of y y, and the number of rows."""
    at = [F.element_at("x", i + 1) for i in range(n)]
    return [*[F.sum(at[i] * at[j]) for i in range(n) for j in range(i, n)], *[F.sum(at[i] * F.col("y")) for i in range(n)], F.sum(F.col("y") * F.col("y")), F.count(F.lit(1))]


class KernelSums(NamedTuple):
    """What a kernel fit and its error need of some rows; sums of more rows are sums of these."""

    a: np.ndarray
    b: np.ndarray
    yy: float
    n: int

    @classmethod
    def of(cls, sums, n: int) -> KernelSums:
        a, it = np.zeros((n, n)), iter(v or 0.0 for v in sums)
        for i in range(n):
            for j in range(i, n):
                a[i, j] = a[j, i] = next(it)
        return cls(a, np.array([next(it) for _ in range(n)]), next(it), int(next(it)))

    def __add__(self, other: KernelSums) -> KernelSums:
        return KernelSums(self.a + other.a, self.b + other.b, self.yy + other.yy, self.n + other.n)

    def fit(self, alpha: float) -> np.ndarray:
        return np.linalg.solve(self.a + alpha * np.eye(len(self.b)), self.b) if self.n else np.zeros(len(self.b))

    def rmse(self, w: np.ndarray) -> float | None:
        return float(np.sqrt(max(0.0, self.yy - 2 * w @ self.b + w @ self.a @ w) / self.n)) if self.n else None


def fit_kernel(samples: DataFrame, k: int = 2, alpha: float = 1.0) -> np.ndarray:
    """M2: ridge kernel of 2k+1 weights; both sides lose their event mean.  One pass of sums."""
    n = 2 * k + 1
    return KernelSums.of(_kernel_rows(samples, k).agg(*_kernel_sums(n)).first(), n).fit(alpha)


def evaluate_kernel(samples: DataFrame, alphas: list[float], k: int = 2, fold: str = "fold") -> DataFrame:
    """(fold, alpha, n, rmse, kernel) of every fold's rows under the kernel fitted to all other folds.

    One scan: sums per fold hold all that the fits and the errors of any number of ``alphas`` need; the other
    folds' sums are added up (and not the total less the fold, which would lose digits).  ``rmse`` is over the
    responses without their sample's mean; a fold without measured zones has none.  Rows without a fold
    take no part.
    """
    n = 2 * k + 1
    kind = dict(samples.dtypes)[fold]
    rows = _kernel_rows(samples.where(F.col(fold).isNotNull()), k, fold).groupBy(fold).agg(*_kernel_sums(n)).collect()  # a row for each fold
    sums = {r[0]: KernelSums.of(r[1:], n) for r in rows}
    out = []
    for f, own in sorted(sums.items()):
        rest = KernelSums(np.zeros((n, n)), np.zeros(n), 0.0, 0)
        for g, s in sorted(sums.items()):
            rest = rest if g == f else rest + s
        out += [(f, float(alpha), own.n, own.rmse(w), w.tolist()) for alpha in alphas for w in [rest.fit(alpha)]]
    return samples.sparkSession.createDataFrame(out, f"{fold} {kind}, alpha double, n long, rmse double, kernel array<double>")


def kernel_matrix(kernel, n_zones: int = 25) -> np.ndarray:
    """M3: banded Toeplitz."""
    k = len(kernel) // 2
    return sum(np.diag(np.full(n_zones - abs(o), kernel[o + k]), o) for o in range(-k, k + 1) if abs(o) < n_zones)


def kernel_rows(spark, kernel, n_zones: int = 25) -> DataFrame:
    """M3 as rows (i, j, weight), edges cut."""
    k = len(kernel) // 2
    w = F.array(*[F.lit(float(x)) for x in kernel])
    rows = spark.range(n_zones).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(-k), F.lit(k))).alias("o"))
    return rows.withColumn("j", F.col("i") + F.col("o")).where(f"j between 0 and {n_zones - 1}").select("i", "j", F.element_at(w, F.col("o") + k + 1).alias("weight"))


def rank_diagnostics(samples: DataFrame, n_zones: int = 25) -> DataFrame:
    """M4: singular values (ten largest, T4) and effective rank by a QR of every partition, then of the
    stacked triangles; the Gram matrix would lose half the digits."""

    def qr(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, n = np.zeros((0, n_zones)), 0
        for b in batches:
            x = np.nan_to_num(np.array(b.column(0).to_pylist(), float).reshape(-1, n_zones))
            n += len(x)
            r = np.linalg.qr(np.vstack((r, x)), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "r"])

    def merge(key, table):
        parts = [np.array(r, float).reshape(-1, n_zones) for r in table.column("r").to_pylist()]
        n = sum(table.column("n").to_pylist())
        sv = np.linalg.svd(np.vstack(parts), compute_uv=False)[: min(n, n_zones)] if n else np.zeros(0)
        tol = sv.max() * max(n, n_zones) * np.finfo(float).eps if len(sv) else 0.0
        return pa.table({"singular_values": pa.array([sv[:10].tolist()], pa.list_(pa.float64())), "effective_rank": [int((sv > tol).sum())], "n_events": [n]})

    # (partition, zones x zones) rows, combined in groups of 64 before the last
    tri = samples.select("dg").mapInArrow(qr, "n long, r array<double>")

    def fold(key, table):
        parts = [np.array(r, float).reshape(-1, n_zones) for r in table.column("r").to_pylist()]
        return pa.table({"n": [sum(table.column("n").to_pylist())], "r": pa.array([np.linalg.qr(np.vstack(parts), mode="r").ravel().tolist()], pa.list_(pa.float64()))})

    folded = tri.groupBy(F.floor(F.spark_partition_id() / 64).alias("g")).applyInArrow(fold, "n long, r array<double>")
    return folded.groupBy(F.lit(1).alias("g")).applyInArrow(merge, "singular_values array<double>, effective_rank long, n_events long")


def available_features(df: DataFrame, candidates: list[str]) -> list[str]:
    """M5."""
    have = [c for c in candidates if c in df.columns]
    counts = df.agg(*[F.count(c) for c in have]).first() if have else []
    return [c for c, n in zip(have, counts) if n]


class LevelModel(NamedTuple):
    """A fitted level model: ``weights`` has one row for each product, the rest is a few numbers."""

    inputs: list[Column]
    slopes: list[float]
    intercept: float
    product: str
    weights: DataFrame

    def predict(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        """``df`` with the prediction; an unknown product has no weight of its own."""
        level = F.lit(self.intercept)
        for x, b in zip(self.inputs, self.slopes):
            level = level + x * b
        joined = df.withColumn(out, level).join(self.weights, self.product, "left")
        return joined.withColumn(out, F.col(out) + F.coalesce("_w", F.lit(0.0))).drop("_w")


def fit_level(df: DataFrame, features: list[str], label: str = "wet_mean", product: str = "product", alpha: float = 1.0) -> LevelModel:
    """M6: median impute, population scaling, product one-hot (an unknown product is all zero), ridge with a
    free intercept.

    The one-hot block of the normal equations is diagonal, so it is eliminated product by product from
    sums of each product; what is left to solve is as wide as the features, however many products there are.
    """
    df = df.where(F.col(label).isNotNull())
    med = [m[0] for m in order_statistics(df, {c: [0.5] for c in features}).values()] if features else ()
    filled = [F.coalesce(F.col(c), F.lit(m)) for c, m in zip(features, med)]
    moments = df.agg(*[f(x) for x in filled for f in (F.avg, F.stddev_pop)]).first() if features else ()
    scaled = [(x - m) / (s or 1.0) for x, m, s in zip(filled, moments[::2], moments[1::2])]
    x = [*scaled, F.lit(1.0)]
    n = len(x)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    y = F.col(label)
    per = df.groupBy(product).agg(
        *[F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i, j in pairs], *[F.sum(x[i] * y).alias(f"y{i}") for i in range(n)], *[F.sum(x[i]).alias(f"s{i}") for i in range(n)], F.sum(y).alias("t"))
    size = F.col(f"s{n - 1}") + alpha  # rows of the product
    own = F.col(product).isNotNull()
    less = lambda v: F.when(own, v / size).otherwise(0.0)
    sums = iter(per.agg(
        *[F.sum(F.col(f"a{i}_{j}") - less(F.col(f"s{i}") * F.col(f"s{j}"))) for i, j in pairs],
        *[F.sum(F.col(f"y{i}") - less(F.col(f"s{i}") * F.col("t"))) for i in range(n)]).first())
    a = np.zeros((n, n))
    for i, j in pairs:
        a[i, j] = a[j, i] = next(sums) or 0.0
    w = np.linalg.solve(a + np.diag([alpha] * (n - 1) + [1e-12]), np.array([v or 0.0 for v in sums]))
    rest = F.col("t")
    for i in range(n):
        rest = rest - F.col(f"s{i}") * float(w[i])
    weights = per.where(own).select(product, (rest / size).alias("_w"))
    return LevelModel(scaled, [float(v) for v in w[:-1]], float(w[-1]), product, weights)


def recommend_gap(lots: DataFrame, g: np.ndarray, bounds: tuple[float, float], max_step: float, lam_move: float = 0.01, lam_smooth: float = 0.01, tol: float = 1e-9, steps: int = 20_000) -> DataFrame:
    """M7: (lot_id, gap): box-constrained quadratic program of every lot, a batch at a time, by
    accelerated projected gradient until the projected step is below ``tol``.

    What is returned is optimal: a lot that isn't there after ``steps`` raises an error."""
    n = g.shape[1]
    d = np.diff(np.eye(n), axis=0)
    h = 2 * (g.T @ g + lam_move * np.eye(n) + lam_smooth * d.T @ d)
    rate = 1 / np.linalg.eigvalsh(h)[-1]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gap, now, want = (np.array(b.column(c).to_pylist(), float).reshape(-1, n) for c in ("current_gap", "current_profile", "target_profile"))
            err = np.nan_to_num(want - now)
            lo, hi = np.maximum(bounds[0] - gap, -max_step), np.minimum(bounds[1] - gap, max_step)
            if (lo > hi).any():
                raise ValueError("limits leave no room for a lot")
            x = y = np.clip(np.zeros_like(gap), lo, hi)
            t = 1.0
            for _ in range(steps):
                new = np.clip(y - rate * (y @ h - 2 * err @ g), lo, hi)
                t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
                y = new + (t - 1) / t2 * (new - x)
                if np.abs(new - x).max(initial=0) < tol:
                    x = new
                    break
                x, t = new, t2
            # a gradient step from the answer must lead back to it
            left = np.abs(np.clip(x - rate * (x @ h - 2 * err @ g), lo, hi) - x).max(axis=1, initial=0)
            if (left > 100 * tol).any():
                raise ValueError(f"not converged after {steps} steps: {b.column('lot_id')[int(left.argmax())]}")
            yield pa.RecordBatch.from_arrays([b.column("lot_id"), pa.array((gap + x).tolist(), pa.list_(pa.float64()))], names=["lot_id", "gap"])

    return lots.select("lot_id", "current_gap", "current_profile", "target_profile").mapInArrow(solve, "lot_id string, gap array<double>")


def prev_lot_baseline(finals: DataFrame, cols: list[str]) -> DataFrame:
    """W10."""
    w = W.partitionBy("product").orderBy("worked_at", "lot_id")
    rows = finals
    out = rows.select("lot_id", "product", *[F.lag(c).over(w).alias(c) for c in cols])
    return out.dropna(subset=cols)


def _running_medians(cols: list[str]):
    """Rows come sorted by product and time; two heaps hold the lower and the upper half seen so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, heaps = None, []
        for b in batches:
            names = b.column("product").to_pylist()
            values = [b.column(c).to_pylist() for c in cols]
            out: list[list] = [[None] * b.num_rows for _ in cols]
            for k, name in enumerate(names):
                if k == 0 and not heaps or name != product:
                    product, heaps = name, [([], []) for _ in cols]
                for (low, high), v, o in zip(heaps, values, out):
                    if low:
                        o[k] = -low[0] if len(low) > len(high) else (high[0] - low[0]) / 2
                    if v[k] is None:
                        continue
                    heapq.heappush(high, -heapq.heappushpop(low, -v[k]))
                    if len(high) > len(low):
                        heapq.heappush(low, -heapq.heappop(high))
            yield pa.RecordBatch.from_arrays([b.column("lot_id"), b.column("product"), *(pa.array(o, pa.float64()) for o in out)], names=["lot_id", "product", *cols])

    return run


def median_baseline(finals: DataFrame, cols: list[str]) -> DataFrame:
    """Median of all earlier lots of the product, kept up to date by two heaps: a row costs a
    logarithm, where a percentile over a growing frame would sort all rows before it anew."""
    kinds = {f.name: f.dataType.simpleString() for f in finals.schema}
    rows = finals.select("lot_id", "product", "worked_at", *[F.col(c).cast("double").alias(c) for c in cols])
    rows = rows.repartition("product").sortWithinPartitions("product", "worked_at", "lot_id").drop("worked_at")
    schema = f"lot_id {kinds['lot_id']}, product {kinds['product']}, " + ", ".join(f"{c} double" for c in cols)
    return rows.mapInArrow(_running_medians(cols), schema).dropna(subset=cols)


def time_holdout(df: DataFrame, at: str, tie: str, frac: float = 0.2) -> DataFrame:
    """Adds fold; the first int(n * (1 - frac)) rows by time, then ``tie``, train.

    The keys are dealt out by range and written once; the one key at which training ends is looked up
    in the one partition that holds it, and every row compares itself with it.  Rows that agree in both
    columns stay on one side; a null time comes last.
    """
    keys = F.struct(F.col(at).isNull(), F.col(at), F.col(tie).isNull(), F.col(tie))
    ranged = staged(df.select(at, tie).repartitionByRange(F.asc_nulls_last(at), F.asc_nulls_last(tie)).withColumn("_p", F.spark_partition_id()), "time-ranges")
    sizes = sorted(tuple(r) for r in ranged.groupBy("_p").count().collect())  # a row for each partition
    left = int(sum(n for _, n in sizes) * (1 - frac))
    for part, n in sizes:
        if left < n:
            break
        left -= n
    else:
        return df.withColumn("fold", F.lit("train"))
    rank = F.row_number().over(W.orderBy(keys)) - 1  # of one partition's keys
    first = ranged.where(F.col("_p") == part).select(at, tie, keys.alias("_k"), rank.alias("_r")).where(F.col("_r") == left).select(F.col("_k").alias("_cut"))
    out = df.withColumn("_one", F.lit(1)).join(F.broadcast(first.withColumn("_one", F.lit(1))), "_one")  # one row
    return out.withColumn("fold", F.when(keys < F.col("_cut"), "train").otherwise("test")).drop("_cut", "_one")


def lot_group_splits(df: DataFrame, n_splits: int, lot: str = "lot_id") -> DataFrame:
    """(lot, n, fold): no lot is split; lots go in descending size, each to the fold with the fewest
    rows so far (the first of equals)."""
    sizes = df.groupBy(lot).agg(F.count(F.lit(1)).alias("n"))
    return lot_folds(sizes, n_splits, lot)


def deal_sizes(counts: list[tuple[int, int]], n_splits: int) -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """Greedy deal of ``many`` lots of each size, largest size first: (size, [(first rank, folds in turn)]).

    Lots of one size that go to the lightest fold take the folds in turn as soon as those are level to
    within one lot; before that the folds that are behind take turns among themselves.
    """
    load, out = [0] * n_splits, []
    for size, many in sorted(counts, reverse=True):
        runs, rank = [], 0
        while rank < many:
            low = min(load)
            behind = sorted((f for f in range(n_splits) if load[f] < low + size), key=lambda f: (load[f], f))
            # a turn gives each of them one lot; the next fold joins in when they come within one lot of it
            ahead = min((load[f] for f in range(n_splits) if f not in behind), default=None)
            turns = -(-(many - rank) // len(behind)) if ahead is None else max(1, (ahead - max(load[f] for f in behind)) // size)
            take = min(many - rank, turns * len(behind))
            runs.append((rank, behind))
            for k, f in enumerate(behind):
                load[f] += size * (take // len(behind) + (k < take % len(behind)))
            rank += take
        out.append((size, runs))
    return out


def lot_folds(sizes: DataFrame, n_splits: int, lot: str, parts: int = 64) -> DataFrame:
    """``lot_group_splits`` from (lot, n).  The deal follows from how many lots there are of each size, a
    short table; lots of one size are numbered in ``parts`` of their own, as one size may hold most lots."""
    rows = staged(sizes.withColumn("_part", F.pmod(F.xxhash64(lot), F.lit(parts)).cast("int")), "lot-sizes")
    counts = rows.groupBy("n", "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_s", F.coalesce(F.sum("_c").over(W.partitionBy("n").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    k = F.row_number().over(W.partitionBy("n", "_part").orderBy(lot)) - 1
    ranked = rows.withColumn("_k", k).join(before, ["n", "_part"]).withColumn("_r", F.col("_k") + F.col("_s"))
    totals = [(int(r[0]), int(r[1])) for r in counts.groupBy("n").agg(F.sum("_c")).collect()]  # a row for each distinct size
    table = sizes.sparkSession.createDataFrame(deal_sizes(totals, n_splits), "n long, runs array<struct<first:long,folds:array<int>>>")
    run = F.element_at(F.filter("runs", lambda x: x["first"] <= F.col("_r")), -1)
    fold = F.get(run["folds"], ((F.col("_r") - run["first"]) % F.size(run["folds"])).cast("int"))
    return ranked.join(table, "n").select(lot, "n", fold.alias("fold"))


def hit_rate(df: DataFrame) -> DataFrame:
    """Share of samples whose every measured zone is inside target +- tolerance."""
    ok = F.forall("wet", lambda z: z.isNull() | (F.abs(z - F.col("target")) <= F.col("tolerance")))
    return df.agg(F.avg(ok.cast("double")).alias("hit_rate"))


def level_mae(df: DataFrame, pred: str, actual: str) -> DataFrame:
    """A19."""
    return df.agg(F.avg(F.abs(F.col(pred) - F.col(actual))).alias("level_mae"))


def profile_rmse(df: DataFrame, pred: str, actual: str) -> DataFrame:
    """After each sample's own mean is taken off both sides."""
    diff = F.zip_with(_demean(F.col(pred)), _demean(F.col(actual)), lambda a, b: (a - b) * (a - b))
    return df.select(F.explode(diff).alias("d")).agg(F.sqrt(F.avg("d")).alias("profile_rmse"))


def cross_width_sigma(df: DataFrame) -> DataFrame:
    """Population std over each sample's measured zones."""
    return df.select("sample_id", F.explode_outer("wet").alias("z")).groupBy("sample_id").agg(F.stddev_pop("z").alias("sigma"))
