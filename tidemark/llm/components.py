"""Connected components of links between documents: in one task while the links are few, else by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import release, staged

#: Links that one task joins (16 bytes each); more are joined by shuffles. The result is the same.
FEW = 1 << 17


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes, and the least node of the component of each."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)  # the roots of both ends move to the lesser one
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = list(batches)
    u, v = (np.concatenate([np.zeros(0, np.int64), *(b.column(c).to_numpy() for b in rows)]) for c in ("u", "v"))
    node, label = least_labels(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], names=["node", "label"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label, the smallest node of its component, for every node of links(a, b) that has a link to another.

    By steps: every step replaces edges by edges to the least neighbour; a fixed point is a star around
    each component's least node. Steps grow with the logarithm of the longest path.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v")
    if edges.count() <= FEW:
        return staged(edges.coalesce(1).mapInArrow(_in_one_task, "node long, label long"), "component-labels")
    edges = staged(edges.distinct(), "component-edges")
    seen = _checksum(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, staged(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "component-edges")
        release(before)
        now = _checksum(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
