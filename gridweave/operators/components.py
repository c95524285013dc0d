"""Connected components of an edge table, by alternating large and small stars.

Each round sends every edge to the least neighbour of one of its ends; the number of rounds grows
with the logarithm of the longest path. Rounds are cut by checkpoints in the shared folder. Only
minima per node are gathered, so a node with any number of edges is summed before it is shuffled.
At most ``TASK_EDGES`` edges, a number that is checked, are joined by one task instead of some ten rounds of jobs; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from gridweave.storage import dealt, shared_dir, stored


def indexed(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its place in the order, from 0. Ranges are sorted by themselves; only their sizes go to the driver, so no task holds all rows."""
    shared_dir(df.sparkSession)
    placed = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    before, at = [], 0
    for r in placed.groupBy("_range").count().orderBy("_range").collect():
        before.append((r["_range"], at))
        at += r["count"]
    offsets = df.sparkSession.createDataFrame(before, "_range int, _before long")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return placed.withColumn("_own", own).join(F.broadcast(offsets), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")


#: Edges that one task joins: some megabytes.
TASK_EDGES = 250_000


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (a, b) at once: labels sink to the least on either end, and on to the label of the label."""
    held = list(batches)
    ends = [np.concatenate([b.column(k).to_numpy() for b in held]) if held else np.zeros(0, np.int64) for k in ("a", "b")]
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    a, b = np.split(at, 2)
    label, before = np.arange(len(nodes)), None
    while before is None or (label != before).any():
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def components(edges: DataFrame, most_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """edges (a, b) of long ids to (node, component), component being the least node that a node reaches. Nodes without edges are absent."""
    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if current.count() <= task_edges:
        return current.repartition(1).mapInArrow(joined, "node long, component long")
    before = None
    for _ in range(most_rounds):
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(dealt(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(dealt(least), "a").select("a", "b", "m")
        linked = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        seen = Observation()
        current = linked.union(least.select("a", F.col("m").alias("b"))).distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h")).checkpoint()
        state = seen.get
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components are not complete after {most_rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
