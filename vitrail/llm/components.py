"""Connected components of an edge table by alternating large and small stars.

Every round is aggregations and joins on (node, salt of the neighbour): a hub's
edges are dealt over many tasks, its least neighbour is taken per salt and then over the salts.
Before a round, each task contracts the edges it reads to stars, which spares rounds.  No node's neighbours are ever gathered.  Rounds are stored in the shared folder, so a lost
executor costs at most one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrail.llm.scratch import partitions, written

LEAST_SALTS = 16
HELD = 2_000_000  # edges that a task contracts at a time


def _pointed(edges: DataFrame, salts: int) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v, m) with the least v of each u as m, and (u, m) per node.

    Edges are dealt by (u, salt of v) once, for the salted minima and for the join."""

    def dealt() -> DataFrame:
        return edges.select("u", "v", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int").alias("s")).repartition(partitions(edges.sparkSession), "u", "s")

    parts = dealt().groupBy("u", "s").agg(F.min("v").alias("m"))
    nodes = parts.groupBy(F.col("u").alias("k")).agg(F.min("m").alias("m"), F.collect_list("s").alias("salts"))
    told = nodes.select("k", "m", F.explode("salts").alias("ks"))
    met = dealt().join(told.hint("shuffle_hash"), (F.col("u") == F.col("k")) & (F.col("s") == F.col("ks")))
    return met.select("u", "v", "m"), nodes.select(F.col("k").alias("u"), "m")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges (u, v) with u > v."""
    salts = max(LEAST_SALTS, partitions(edges.sparkSession))
    if large:  # both directions; larger neighbours point to the least one
        both, _ = _pointed(edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))), salts)
        out = both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:  # smaller neighbours and the node itself point to the least one
        moved, nodes = _pointed(edges, salts)
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(nodes.select("u", F.col("m").alias("v"))).distinct()
    return out.where("u > v")


def _settled(edges: DataFrame) -> bool:
    """Every node points to one node, which points to none: all are stars."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in"))
    )
    seen = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return seen.agg(F.count_if((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0)))).first()[0] == 0


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the same components, each from its least node: what a task sends
    of the edges it has, so that few rounds are left."""
    nodes, place = np.unique(np.r_[a, b], return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) as stars of what each task reads, at most HELD edges at a time."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars() -> pa.RecordBatch:
            v, u = local_stars(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        parts, n = [], 0
        for batch in batches:
            parts.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            n += batch.num_rows
            if n >= HELD:
                yield stars()
                parts, n = [], 0
        if parts:
            yield stars()

    return edges.select("u", "v").mapInArrow(task, "u long, v long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node of the component, for every node with an
    edge to another node.  Self-loops and repeated edges change nothing."""
    named = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    cur = written(_contracted(named).distinct(), "edges")
    while not _settled(cur):
        cur = written(_star(_star(_contracted(cur), True), False), "star")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
