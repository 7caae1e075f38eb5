"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges that one task may hold: 16 MB of them.
AT_ONCE = 1 << 20


def components(edges: DataFrame, at_once: int = 0) -> DataFrame:
    """edges (a, b) of long: (node, root) for every node that has an edge; root is the smallest node of its component.

    Each round gives a node the smallest label among its neighbours', hands that on to the node's own root, and replaces labels by
    their labels' labels; the number of rounds grows with the logarithm of the longest path. Every round's labels are written to the shared folder,
    one row a node. Only the count of changed labels reaches the driver. A node with very many edges is no trouble: its rows are
    reduced before each shuffle, or stand on the side of a join that may be split.
    Self-loops give a component of one; null ends are left out; no edges, no rows.
    at_once: a graph of so many rows or fewer is joined in one task instead of rounds, each of which is a dozen stages that the driver plans and keeps account of.
    """
    both = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna()
    if at_once:
        both = common.materialise(both, "some-edges")
        if both.count() <= at_once:
            common.ship(both.sparkSession)
            return common.materialise(both.coalesce(1).mapInArrow(_joined, "node long, root long"), "labels")
    both = common.materialise(both.union(both.select("b", "a")).distinct(), "edges")
    labels = common.materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("x")).select("node", F.least("node", "x").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = common.materialise(labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("new")), "step")
        hook = step.groupBy(F.col("old").alias("node")).agg(F.min("new").alias("hook"))
        hooked = step.join(hook, "node", "left").select("node", "old", F.least("new", "hook").alias("new"))
        hooked = common.materialise(hooked, "hooked")
        jump = hooked.select(F.col("node").alias("new"), F.col("new").alias("next"))
        labels = common.materialise(hooked.join(jump, "new").select("node", F.col("next").alias("root"), (F.col("next") != F.col("old")).alias("changed")), "labels")
        if labels.where("changed").isEmpty():
            return labels.select("node", "root")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """components() of all edges of a task."""
    held = [np.stack([x.to_numpy(zero_copy_only=False) for x in batch.columns]) for batch in batches]
    nodes, root = roots_of(*np.concatenate([np.empty((2, 0), np.int64), *held], axis=1))
    yield pa.RecordBatch.from_pydict({"node": pa.array(nodes), "root": pa.array(root)})


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges a, b in rising order and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
        if not len(x):
            return nodes, nodes[root]
        # a root takes the smallest of the roots that edges show it, and labels are followed to their ends: a smaller place each time, so no circle
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (root[root] != root).any():
            root = root[root]
