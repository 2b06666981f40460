"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, frequent, lean, spread_join, stage

#: Edges that a task contracts at a time.
EDGES = 1 << 18


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: long), once each; root is the smallest node of its component.

    Rounds of large-star and small-star.  The small star is a contraction: edges of a node meet in a task, and what they
    connect there becomes a star.  Edges are contracted where they lie as well, before each round, as sums are combined before
    a shuffle: a node then has one edge down for each piece at most, so no node's edges down are many, and rounds are fewer.
    Edges never become more.  Each round's edges are written to the shared folder, and only two numbers come to the driver.
    """
    now = stage(spark, edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    while True:
        old, now = now, stage(spark, _contracted(now), "contracted")
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Sums are written before they are joined, and hubs are dealt over many tasks.
        least = stage(spark, both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.max("b").alias("high"), F.count("*").alias("n")), "least")
        discard(old)
        # Done when every node is a root or has no neighbour but one, a smaller one.
        total, rest = least.agg(F.sum("n"), F.count_if(F.expr("m < a and high > m"))).first()
        if not rest:
            discard(now)
            return least.select(F.col("a").alias("node"), F.col("m").alias("root"))
        large = spread_join(now.select(F.col("b").alias("a"), F.col("a").alias("b")), least.select("a", "m"), "a", frequent(least, "a", "n", total), ["b"], merge=True)
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, now = now, stage(spark, _contracted(large.repartition("a").sortWithinPartitions("a")), "stars")
        discard(old, least)


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same nodes: in each piece of a partition, each node and the smallest that it is connected with there.

    Rows with the same ``a`` that follow each other are in one piece.
    """

    def star(held: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.concatenate(held, 1)
        node, place = np.unique(ends, return_inverse=True)
        label = labels(len(node), place.reshape(2, -1).T)
        far = np.flatnonzero(label != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[label[far]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.stack([batch.column(k).to_numpy() for k in (0, 1)])
            if sum(x.shape[1] for x in held) >= EDGES:
                cut = int(np.argmax(ends[0] != held[-1][0, -1])) if (ends[0] != held[-1][0, -1]).any() else ends.shape[1]
                held.append(ends[:, :cut])
                ends = ends[:, cut:]
                if ends.shape[1]:
                    yield star(held)
                    held = []
            if ends.shape[1]:
                held.append(ends)
        if held:
            yield star(held)

    return edges.select("a", "b").mapInArrow(lean(run), "a long, b long")


def labels(n: int, pairs: np.ndarray) -> np.ndarray:
    """For each of n items the smallest item that the pairs connect it with."""
    root = np.arange(n)
    if len(pairs):
        a, b = pairs.T
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
    while (root[root] != root).any():
        root = root[root]
    return root
