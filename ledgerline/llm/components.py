"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import common as C


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index of each of n nodes, for edges a-b. Vectorised hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        live = lo != hi
        if not live.any():
            break
        a, b, lo, hi = a[live], b[live], lo[live], hi[live]
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars around each local component's smallest node; bounded runs."""

    def star(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([np.asarray(r.column(i)) for r in rows]) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = forest(at[: len(a)], at[len(a) :], len(nodes))
        used = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[used]), pa.array(nodes[root[used]])], names=["src", "dst"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= RUN:
            yield star(held)
            held, n = [], 0
    if held:
        yield star(held)


#: Most links that one task contracts at once.
RUN = 1_000_000


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node (as a signed long) of its component.

    Each round first contracts every task's links to stars, RUN of them at most at a time, then takes a large-star and a
    small-star step with aggregation instead of neighbour lists. A hub's links meet the hub's one row in a join, whose
    large partitions Spark splits (its skew join), and no task holds them as a list. A list of RUN links or fewer needs no
    more than its first contraction. Each round is written to the shared folder. edges: src,
    dst long; null, repeated and self edges are allowed and ignored. Raises if it hasn't converged after most_rounds.
    """
    e = C.materialise(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src <> dst"), "cc")
    for _ in range(most_rounds):
        tasks = -(-e.count() // RUN)
        if tasks == 0:
            return e.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        e = C.materialise(e.coalesce(tasks).mapInArrow(_contract, "src long, dst long"), "cc")
        # done if all are stars: nobody points to two nodes, and nobody who is pointed to points on
        if tasks == 1 or not e.select("src", F.lit(1).alias("k")).union(e.select("dst", F.lit(2))).groupBy("src").agg(F.count_if(F.col("k") == 1).alias("out"), F.max("k").alias("k")).filter("out > 1 or (out = 1 and k = 2)").head(1):
            return e.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(e.select(F.col("dst"), F.col("dst")).distinct())
        # large-star: every larger neighbour of a node points to the smallest of the node and its neighbours
        both = e.union(e.select("dst", "src"))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).filter("src <> dst").distinct()
        # small-star: a node and its smaller neighbours point to the smallest
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src").select(F.explode(F.array(F.struct("src", F.col("m").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")))).alias("x")).select("x.*").filter("src <> dst").distinct()
        e = C.materialise(small, "cc")
    raise RuntimeError("connected components did not converge")
