"""Connected components of an edge table, and size-checked broadcasts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import Scratch

#: Rows up to which a table of a few numbers is broadcast.
BROADCAST_ROWS = 200_000
#: Edges of a partition that are contracted together.
CONTRACTED = 1 << 19


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to be small; as it is otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the least node that each is connected with by them."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contracted(edges: DataFrame, least_too: bool = False) -> DataFrame:
    """Edges (u, v) with the same components: in runs of a partition, each node with its least one, a least one with itself if asked for."""

    def run(batches):
        held, size = [], 0

        def stars():
            nodes, least = least_reached(*(np.concatenate(x) for x in zip(*held)))
            own = (nodes != least) | least_too
            return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(least[own])], names=["u", "v"])

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size >= CONTRACTED:
                yield stars()
                held, size = [], 0
        if size:
            yield stars()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(h, root): every node of the links and the least node it is connected with.

    Alternates large-star and small-star steps (Kiveris et al. 2014), which join
    every neighbourhood to its least member, until no edge changes; the number of
    rounds grows with the logarithm of the nodes.  The edges of a partition are
    contracted before they are shuffled, and a hub's edges are aggregated.  Once
    no more than CONTRACTED edges are left, one task contracts them all and no
    further round is needed.  ``links`` has columns a and b; an empty table has no
    components.
    """
    scratch = Scratch(spark, "components")
    edges = scratch.table(_contracted(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")), "round0")
    step, before = 0, None
    while True:
        if edges.limit(CONTRACTED + 1).count() <= CONTRACTED:
            return scratch.table(_contracted(edges.coalesce(1), least_too=True).select(F.col("u").alias("h"), F.col("v").alias("root")), "stars")
        step += 1
        ways = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: larger neighbours of u go to the least of u and its neighbours
        large = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        edges = scratch.table(_contracted(star).distinct(), f"round{step}")
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        if step > 1:
            scratch.drop(f"round{step - 2}")
        before = now
    roots = edges.select(F.col("u").alias("h"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("h"), F.col("v").alias("root")).distinct())
