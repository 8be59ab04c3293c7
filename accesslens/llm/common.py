"""Helpers shared by the text operators: scratch tables, Arrow batches in pieces, connected components."""

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import functions as F

from accesslens.session import materialize

#: Bytes of text that one vectorised step of a Python worker takes; longer documents form a step of their own.
STEP_BYTES = 1 << 21


def stored(df, name):
    """Write a frame to the shared folder and read it back, so that a lost executor does not repeat its lineage."""
    return materialize(df, f"llm-{name}")


def pieces(batches, text_column=1, limit=STEP_BYTES):
    """Arrow batches as lists of columns (Python values), each holding about ``limit`` characters of text at most.

    Only the rows of a piece become Python values at a time; a batch is held once, as it came.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch.column(text_column)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(sizes.tolist()):
            size += n + 1
            if size >= limit:
                yield [c.to_pylist() for c in batch.slice(start, i + 1 - start).columns]
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield [c.to_pylist() for c in batch.slice(start).columns]


def connected_components(edges, name="components"):
    """(node, component) of every node of ``edges`` (a, b: long); the component is named by its smallest node.

    Every round maps each node to its smallest neighbour (or itself) and contracts the edges by that map. The larger
    end of each edge goes away, so the nodes at least halve. Each round is written to the shared folder. Hubs need no
    group in one task: the minimum is pre-aggregated and the contraction is a join, which adaptive execution splits.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .distinct(), name)
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to")), name)
        left = step.select(F.col("node").alias("a"), F.col("to").alias("_a"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        edges = stored(edges.join(left, "a").join(right, "b").where("_a <> _b")
                       .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), name)
        if labels is None:
            labels = step.withColumnRenamed("to", "component")
        else:
            moved = step.select(F.col("node").alias("component"), "to")
            labels = stored(labels.join(moved, "component", "left")
                            .select("node", F.coalesce("to", "component").alias("component")), name)
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def join_labels(labels, i, j):
    """Merge the label trees of linked nodes; afterwards every label is the smallest index of its tree."""
    while True:
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            return
        i, j = i[open_], j[open_]
        low, high = np.minimum(a[open_], b[open_]), np.maximum(a[open_], b[open_])
        np.minimum.at(labels, high, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up
