"""Connected components of an edge table, by alternating large and small stars.

Edges go through joins and aggregates only: minima are aggregated before the shuffle and joined back, so a
node with a third of all edges is an ordinary skewed join.  Each round is written to the shared checkpoint
folder, which ends its lineage there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneloom.llm.common import cut_lineage


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "of")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = _minima(both).withColumn("m", F.least("m", "of"))
    return both.where("v > u").join(m, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    m = _minima(edges)
    joined = edges.join(m, F.col("u") == F.col("of"))
    lower = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(m.select(F.col("of").alias("u"), F.col("m").alias("v"))).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node points to one other at most and none that is pointed to points on: then the edges are the components."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("e"))
    per = ends.groupBy("e.node").agg(F.sum("e.out").alias("out"), F.max(1 - F.col("e.out")).alias("into"))
    return per.where("out > 1 or (out = 1 and into = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of an edge (a, b) and the smallest node it reaches.

    Rounds go on until the edges are stars, which is tested exactly.  Self-links and repeated edges do not matter;
    no edges give no rows.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    down = cut_lineage(down)
    while not _is_stars(down):
        down = cut_lineage(_small(_large(down)))
    roots = down.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return down.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node it reaches) with the components of the edges (a, b): at most one a node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
