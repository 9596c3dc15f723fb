"""Connected components as a distributed union-find.

Each task first contracts the edges it holds (numpy union-find, half a million at a time); alternating large-star and
small-star joins then join the tasks' trees. A node's neighbours never meet in one task: minima are partial
aggregates, and the join back is an equi join whose large partitions Spark may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Tables

EDGE = "a long, b long"


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges and each one's smallest reachable node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, parent = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (differ := parent[x] != parent[y]).any():
        p, q = parent[x[differ]], parent[y[differ]]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return nodes, nodes[parent]


def _contract(batches: Iterator[pa.RecordBatch], rows: int = 500_000) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def trees() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        node, root = roots(table.column(0).to_numpy(), table.column(1).to_numpy())
        keep = node != root
        return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], ["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield trees()
            held.clear()
    if held:
        yield trees()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b) with b < a. Links each neighbour that the star covers to the least one."""
    if large:
        around = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = around.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node but the roots has one link, and that to a root."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("own"), F.lit(0).alias("root")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("v").agg(F.sum("own").alias("own"), F.max("root").alias("root")).where("own + root > 1").isEmpty()


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(a, b) long links -> (node, root) for every linked node; root is the least node reachable.

    Null ends and loops are no links. A node without links is not in the result.
    """
    found = tables.save(edges.where("a <> b").mapInArrow(_contract, EDGE).distinct())
    while not _settled(found):
        nxt = tables.save(_star(_star(found, True), False))
        tables.drop(found)
        found = nxt
    everyone = found.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return everyone.unionAll(found.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
