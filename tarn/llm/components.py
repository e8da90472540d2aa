"""Connected components of a graph of links, without any node's links meeting in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import dropped, saved

#: Links that a task reduces together.
LINKS = 1 << 20


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b), and for each the least node that it is linked with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        else:
            parent[x] = y
    root = np.array(parent, np.int64)
    while len(root) and (root[root] != root).any():
        root = root[root]
    return nodes, nodes[root] if len(nodes) else nodes


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links, reduced to one link from each node to the least of its group; LINKS at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(a) for a, _ in held) >= LINKS:
            held = [_stars(held)]
            if len(held[0][0]) >= LINKS // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["u", "v"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(held)], ["u", "v"])


def _stars(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    nodes, roots = union_find(*(np.concatenate(x) for x in zip(*held, strict=True)))
    other = nodes != roots
    return nodes[other], roots[other]


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    return e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(u, v) for each node u of the links (columns a and b, long) but the least of its component, which is v.

    Each task first reduces its links by union-find; then stars are drawn to the least neighbour, of
    larger and of smaller nodes in turn, until each node but the least has one link, to the least. Null ends and
    self-links are left out.
    """
    e = links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    e = saved(e.mapInArrow(_forest, "u long, v long").distinct(), "links")
    while True:
        # how often each node is a larger and how often a smaller end
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select(F.col("v"), F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        if ends.where("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            return e
        e, old = saved(_small_star(_large_star(e).distinct()).distinct(), "links"), e
        dropped(old)
