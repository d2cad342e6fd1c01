"""Connected components of links, by union-find inside partitions and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catloom.llm.common import Kept


class UnionFind:
    """Sets of numbers; the root of a set is its smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as links to the smallest member of each set (one per member at most)."""
    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            sets.union(a, b)
    pairs = [(x, r) for x in list(sets.parent) if (r := sets.find(x)) != x]
    yield pa.record_batch([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["a", "b"])


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node that points somewhere points to one node only, and that one points nowhere."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("hit")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("hit"))
    )
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("hit").alias("hit")).where("out > 1 or (out = 1 and hit = 1)").isEmpty()


def components(links: DataFrame, kept: Kept, name: str) -> DataFrame:
    """node, component (smallest node reachable) of every node of the links (a, b).

    Links of one partition are reduced by union-find. Then each round makes every node point to the smallest neighbour of its neighbours
    and flattens, until all links are stars; linked nodes stay linked throughout, so a star is a component. The
    number of rounds grows with the logarithm of the longest path.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().mapInArrow(_forest, "a long, b long")
    edges = kept.table(edges.distinct(), f"{name}-0")
    turn = 0
    while not _are_stars(edges):
        turn += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = kept.table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-least-{turn}")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = kept.table(large, f"{name}-large-{turn}")
        smallest = kept.table(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-smallest-{turn}")
        small = large.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        flat = small.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct()
        edges = kept.table(flat, f"{name}-{turn}")
        for old in (f"{name}-{turn - 1}", f"{name}-least-{turn}", f"{name}-large-{turn}", f"{name}-smallest-{turn}"):
            kept.drop(old)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
