"""Exact order statistics of columns of any size: counts in ranges, then the range that holds the rank again."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTS = 255


@dataclass
class Search:
    """Ranks (from 0) of one column that are known to lie in [low, high]; ``before`` values are smaller than low."""

    column: str
    low: float
    high: float
    before: int
    size: int
    ranks: list[int]

    def inside(self) -> Column:
        v = F.col(self.column).cast("double")
        return F.when(v.between(self.low, self.high) & ~F.isnan(v), v)


def _bucket(cuts: list[float], value: str) -> str:
    """SQL of the number of ``cuts`` below the value, as a tree of comparisons."""
    if not cuts:
        return "0"

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        number = f"{cuts[mid]!r}D" if math.isfinite(cuts[mid]) else f"double('{cuts[mid]}')"
        return f"CASE WHEN {value} <= {number} THEN {tree(lo, mid)} ELSE {tree(mid + 1, hi)} END"

    return tree(0, len(cuts))


def _split(df: DataFrame, open_: list[Search]) -> list[Search]:
    """Each search narrowed to the buckets between sketched quantiles that hold its ranks: two scans, and from a
    task at most CUTS + 1 rows for each search."""
    quantiles = [(k + 1) / (CUTS + 1) for k in range(CUTS)]
    cuts = df.agg(*[F.percentile_approx(s.inside(), F.array(*map(F.lit, quantiles)), 20 * CUTS) for s in open_]).first()
    cuts = [sorted({s.low, *c}) for s, c in zip(open_, cuts)]
    cells = df.select(*[s.inside().alias(f"v{k}") for k, s in enumerate(open_)])
    cells = cells.select(F.explode(F.array(*[F.struct(F.lit(k).alias("s"), F.expr(_bucket(c, f"v{k}")).alias("b"), F.col(f"v{k}").alias("v")) for k, c in enumerate(cuts)])).alias("x")).select("x.*")
    counts = cells.where("v is not null").groupBy("s", "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    out = []
    before = [s.before for s in open_]
    for r in sorted(counts.collect(), key=lambda r: (r.s, r.b)):  # CUTS + 2 rows for each search at most
        s, first = open_[r.s], before[r.s]
        before[r.s] += r.n
        if ranks := [k for k in s.ranks if first <= k < first + r.n]:
            out.append(Search(s.column, r.low, r.high, first, r.n, ranks))
    return out


def order_statistics(df: DataFrame, wanted: dict[str, list[float]], small: int = 20_000) -> dict[str, list[float | None]]:
    """Percentiles of columns, interpolated as ``percentile`` does; nulls don't count, NaN is the largest value.

    The driver gets counts of ranges, and at the end the distinct values of a range of ``small`` rows at most.
    Every round makes a range about CUTS times smaller, so a billion rows take two; a range whose rows are all
    equal is done at once, however many they are.
    """
    stats = df.agg(*[f for c in wanted for v in [F.col(c).cast("double")] for f in (F.count(v), F.count_if(F.isnan(v)), F.min(F.when(~F.isnan(v), v)), F.max(F.when(~F.isnan(v), v)))]).first()
    found: dict[tuple[str, int], float] = {}
    positions, open_ = {}, []
    for k, (c, shares) in enumerate(wanted.items()):
        n, n_nan, low, high = stats[4 * k : 4 * k + 4]
        positions[c] = [(n - 1) * p if n else None for p in shares]
        ranks = sorted({r for p in positions[c] if p is not None for r in (math.floor(p), math.ceil(p))})
        found |= {(c, r): math.nan for r in ranks if r >= n - n_nan}
        if ranks := [r for r in ranks if r < n - n_nan]:
            open_.append(Search(c, low, high, 0, n - n_nan, ranks))
    last: list[Search] = []
    while open_:
        more = []
        for s in open_:
            if s.low == s.high:
                found |= {(s.column, r): s.low for r in s.ranks}
            elif s.size <= small:
                last.append(s)
            else:
                more.append(s)
        open_ = _split(df, more) if more else []
    if last:
        cells = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("s"), s.inside().alias("v")) for k, s in enumerate(last)])).alias("x")).select("x.*").where("v is not null")
        before = [s.before for s in last]
        for r in sorted(cells.groupBy("s", "v").count().collect(), key=lambda r: (r.s, r.v)):
            s, first = last[r.s], before[r.s]
            before[r.s] += r["count"]
            found |= {(s.column, k): r.v for k in s.ranks if first <= k < first + r["count"]}

    def value(c: str, p: float | None) -> float | None:
        if p is None:
            return None
        lo, hi = math.floor(p), math.ceil(p)
        a, b = found[c, lo], found[c, hi]
        return a if lo == hi or a == b else (hi - p) * a + (p - lo) * b

    return {c: [value(c, p) for p in positions[c]] for c in wanted}
