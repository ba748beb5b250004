"""Connected components by local union-find and star contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from slipstream.llm.common import written


def _forest(batches):
    """Each task's edges reduced to a spanning forest, every node under its smallest root."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) >= 1_000_000:  # bounds the memory; more edges stay, none is lost
            nodes = [n for n in parent if root(n) != n]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(n) for n in nodes], kind)], ["a", "b"])
            parent.clear()
    nodes = [n for n in parent if root(n) != n]
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(n) for n in nodes], kind)], ["a", "b"])


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``links`` (a, b); root is the smallest node.

    Large-star and small-star steps alternate until nothing changes; the driver sees one number a
    round. Every step joins edges with a minimum per node, so a node with many edges is dealt out
    like any skewed join.
    """
    kind = links.schema["a"].dataType
    schema = f"a {kind.simpleString()}, b {kind.simpleString()}"
    edges = written(links.mapInArrow(_forest, schema).where("a > b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = written(large.unionByName(least.select("a", F.col("low").alias("b"))).where("a > b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        new = written(small.where("a > b").distinct())
        same = new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty()
        edges = new
        if same:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
