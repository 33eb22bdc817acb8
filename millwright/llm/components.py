"""Connected components of an edge table by local contraction and alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millwright.llm.common import Scratch


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition to a star for each component that they form by themselves."""
    parts = [np.array([b.column(c).to_numpy() for c in ("u", "v")]) for b in batches if b.num_rows]
    if not parts:
        return
    node, place = np.unique(np.hstack(parts), return_inverse=True)
    a, b = place.reshape(2, -1)
    label = np.arange(len(node))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(node))
    yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[label[own]])], names=["u", "v"])


def _written(e: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, int, object]:
    """(the written edges, their number, a sum of their hashes)."""
    seen = Observation()
    e = scratch.put(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), name)
    return e, seen.get["n"], seen.get["h"]


def components(edges: DataFrame, scratch: Scratch, name: str = "edges", part_edges: int = 500_000) -> DataFrame:
    """(node, label): label is the smallest node that ``a``-``b`` links reach.

    The edges are dealt at random into parts of about ``part_edges`` and each part is contracted to stars.
    One part is the result then.  Several parts go on: every step joins each node's edges to its smallest
    neighbour (minima are aggregated before they are joined back, so a star's centre costs one row per task
    and its edges are split by the skew join) and contracts anew, until a step changes nothing.  Each step
    is written to the shared folder in place of the one before.  The result reads the scratch table ``name``.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e, n, last = _written(e, scratch, name)
    while n:
        parts = -(-n // part_edges)
        e = e.repartition(parts).mapInArrow(_contract, "u long, v long")
        if parts > 1:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            e = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e, n, now = _written(e, scratch, name)
        if parts == 1 or now == last:
            break
        last = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
