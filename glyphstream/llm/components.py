"""Connected components of an undirected graph, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import discard, materialise

# A graph that has shrunk to so many edges is solved by one task; they take a few megabytes.
ONE_TASK = 50_000


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the edges of all batches."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    yield pa.record_batch([pa.array(list(root), type=pa.int64()), pa.array([find(n) for n in list(root)], type=pa.int64())], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), long; the root is the least node of its component.

    Each node points to the least of itself and its neighbours. Edges between what their ends
    point to form the next, smaller graph, until no more than ONE_TASK are left; the pointers
    are then composed. Minima are combined before they shuffle, and the joins read written
    tables, so that Spark can split a node with very many edges. Loops and null ends are left out.
    """
    left = materialise(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    levels = []
    while left.count() > ONE_TASK:
        ends = left.select(F.col("a").alias("node"), F.least("a", "b").alias("to")).unionByName(left.select(F.col("b").alias("node"), F.least("a", "b").alias("to")))
        step = materialise(ends.groupBy("node").agg(F.min("to").alias("to")), "pointers")
        levels.append(step)
        one = left.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        one = materialise(one.select("b", "x"), "edges-half")
        both = one.join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        next_ = materialise(both.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(left, one)
        left = next_
    found = materialise(left.coalesce(1).mapInArrow(_solve, "node long, root long"), "roots")
    while levels:
        step = levels.pop()
        upper = found.select(F.col("node").alias("to"), "root")
        found = materialise(step.join(upper, "to", "left").select("node", F.coalesce("root", "to").alias("root")), "roots")
    return found
