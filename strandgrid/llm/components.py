"""Connected components of a table of edges, on the executors alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Below so many edges one task finishes; the count is taken first.
LAST_EDGES = 20_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of the edges that aren't the smallest themselves."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if found:
        x, y = forest(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        yield pa.record_batch([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["node", "label"])


def components(edges: DataFrame, last_edges: int = LAST_EDGES) -> DataFrame:
    """(node, label) for every node of the edges (u, v: longs): nodes linked by any path have the same label, one of them.

    Each round every node is merged into the neighbour (or itself) whose hash of
    that round is smallest, which removes a fixed share of the nodes whatever the
    graph's shape; hubs are handled by a partial min, never as lists. Rounds end
    when a counted ``last_edges`` or fewer are left, for one task to finish.
    Edges of a node with itself are dropped; an empty table gives an empty result.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    labels = None
    step = 0
    while True:
        small = edges.limit(last_edges + 1).count() <= last_edges
        if small:
            merged = edges.coalesce(1).mapInArrow(_finish, "node long, label long")
        else:
            both = edges.select("u", "v").union(edges.select("v", "u")).toDF("u", "v")
            h = lambda c: F.xxhash64(F.col(c), F.lit(step))
            near = both.groupBy("u").agg(F.min(F.struct(h("v").alias("h"), F.col("v").alias("to"))).alias("m"))
            merged = near.select(F.col("u").alias("node"), F.when(F.col("m.h") < h("u"), F.col("m.to")).otherwise(F.col("u")).alias("label"))
        merged = cut(merged)
        if labels is None:
            labels = merged
        else:
            up = merged.toDF("__n", "__l")
            labels = labels.join(up, F.col("label") == F.col("__n"), "left").select("node", F.coalesce("__l", "label").alias("label"))
        if small:
            # nodes that one task left as smallest of their own don't appear in its output
            own = labels.select(F.col("label").alias("node"), "label").distinct()
            return labels.union(own).groupBy("node").agg(F.min("label").alias("label")) if step == 0 else labels
        a, b = merged.toDF("u", "__u"), merged.toDF("v", "__v")
        edges = cut(edges.join(a, "u").join(b, "v").where("__u <> __v").select(F.greatest("__u", "__v").alias("u"), F.least("__u", "__v").alias("v")).distinct())
        step += 1
