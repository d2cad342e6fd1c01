"""Exact top-k by inner product: a ball tree for each shard of vectors, searched by branch and bound.

Components become integers, so scores are exact. A node's bound for a query q is q.c + |q| * r with its centre c and
radius r: no vector below scores more. Nodes are opened in the order of their bounds until the best bound lies below the
k-th score so far. Each vector lies in one shard and is sent there once per pass; queries, the smaller side, travel to the shards. First
every query searches the shard it belongs to; the k-th scores found there are then known to the searches of all
other shards, which skip what lies below them. Nothing is broadcast: a task holds one shard, of bounded size, and lets the queries
pass by in batches.

Edge cases: vectors that are null, empty of components or hold null or non-finite components take no part; vectors of another
length than a query are no candidates of it; a query that has no other vector returns no row; equal scores go to the
smaller id. Rows equal in id and vector count as one. Rows that share an id but not the vector are separate candidates, none of them
a candidate of a query with that id; as a query such an id asks with the smallest of its vectors. Other columns are ignored. The
result does not depend on the size of the shards. Scores are exact as long as they fit 64 bits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catloom.llm.common import Kept

K = 20
SCALE = 64
QUERY_MODULUS = 20
SHARD_VECTORS = 16_384
LEAF = 256


class BallTree:
    """Balls around the halves of halves of the vectors, split along the coordinate that varies most."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(vectors))
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        centres, radii = [], []
        stack = [(0, len(vectors), -1, 0)]
        while stack:
            lo, hi, parent, side = stack.pop()
            own = vectors[self.order[lo:hi]]
            centre = own.mean(axis=0)
            node = len(self.span)
            self.span.append((lo, hi))
            self.children.append(None)
            centres.append(centre)
            radii.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())))
            if parent >= 0:
                a, b = self.children[parent] or (-1, -1)
                self.children[parent] = (node, b) if side == 0 else (a, node)
            if hi - lo > leaf and radii[-1] > 0:
                axis = int(own.var(axis=0).argmax())
                middle = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(own[:, axis], middle)]
                stack.append((lo, lo + middle, node, 0))
                stack.append((lo + middle, hi, node, 1))
        self.centres, self.radii = np.array(centres), np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of all scores below each node, rounded up past any floating-point error."""
        exact = queries @ self.centres.T + np.sqrt((queries**2).sum(axis=1))[:, None] * self.radii
        return exact + 1e-9 * np.abs(exact) + 1e-6


def _products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where that is exact."""
    most = float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, len(query))
    if most < 2**53:
        return (vectors @ query).astype(np.int64)
    return vectors.astype(np.int64) @ query.astype(np.int64)


class Shard:
    """The vectors of one shard, with a tree for each length of vectors."""

    def __init__(self) -> None:
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.trees: dict[int, tuple[BallTree, np.ndarray, np.ndarray]] = {}

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.parts.setdefault(vectors.shape[1], []).append((ids, vectors))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> tuple[list, list, list]:
        """query_id, vec_id, score of at most k best candidates of each query (all of one length) that score at least its floor."""
        length = queries.shape[1]
        if length not in self.parts:
            return [], [], []
        if length not in self.trees:
            ids, vectors = (np.concatenate(x) for x in zip(*self.parts[length]))
            tree = BallTree(vectors)
            self.trees[length] = tree, vectors[tree.order], ids[tree.order]
            self.parts[length] = [(ids[:0], vectors[:0])]
        tree, ordered, ids = self.trees[length]
        bounds = tree.bounds(queries)
        out: tuple[list, list, list] = [], [], []
        for row in range(len(queries)):
            best_v, best_s = self._one(tree, ordered, ids, bounds[row], query_ids[row], queries[row], floors[row], k)
            for part, values in zip(out, (np.full(len(best_s), query_ids[row]), best_v, best_s)):
                part.append(values)
        return out

    @staticmethod
    def _one(tree, ordered, ids, bounds, query_id, query, floor, k: int) -> tuple[np.ndarray, np.ndarray]:
        best_s, best_v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < floor:  # the k-th score known so far
                break
            if tree.children[node] is not None:
                for child in tree.children[node]:
                    if bounds[child] >= floor:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            lo, hi = tree.span[node]
            score = _products(ordered[lo:hi], query)
            keep = (score >= floor) & (ids[lo:hi] != query_id)
            if not keep.any():
                continue
            best_s, best_v = np.concatenate([best_s, score[keep]]), np.concatenate([best_v, ids[lo:hi][keep]])
            first = np.lexsort((best_v, -best_s))[:k]
            best_s, best_v = best_s[first], best_v[first]
            if len(best_s) == k:
                floor = max(floor, best_s[-1])
        return best_v, best_s


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
    """(shard, kind, first row, row after the last) of the unbroken runs of equal shard and kind."""
    shard, kind = (batch.column(c).to_numpy() for c in ("shard", "kind"))
    cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1
    bounds = np.concatenate([[0], cuts, [len(shard)]])
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi > lo:
            yield int(shard[lo]), int(kind[lo]), int(lo), int(hi)


def _by_shard(vectors: DataFrame, queries: DataFrame, shards: int, k: int) -> DataFrame:
    """query_id, vec_id, score: the best candidates of the queries in the shards they are sent to.

    Both kinds of rows are dealt by shard and sorted, a shard's vectors before its queries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, Shard()
        for batch in batches:
            found: tuple[list, list, list] = [], [], []
            flat = batch.column("v")
            values, ends = flat.values.to_numpy(), flat.offsets.to_numpy()
            for shard, kind, lo, hi in _runs(batch):
                if shard != at:
                    at, held = shard, Shard()
                sizes = np.diff(ends[lo : hi + 1])
                for length in np.unique(sizes):
                    rows = lo + np.flatnonzero(sizes == length)
                    own = values[ends[rows][:, None] + np.arange(length)]
                    ids = batch.column("id").to_numpy()[rows]
                    if kind == 0:
                        held.add(ids, own)
                    else:
                        for part, more in zip(found, held.search(ids, own, batch.column("floor").to_numpy()[rows], k)):
                            part.extend(more)
            if found[0]:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in found], ["query_id", "vec_id", "score"])

    rows = vectors.select("shard", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "v", F.lit(0).cast("long").alias("floor"))
    rows = rows.unionByName(queries.select("shard", F.lit(1).alias("kind"), F.col("query_id").alias("id"), "v", "floor"))
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    embeddings: DataFrame, *, k: int = K, modulus: int = QUERY_MODULUS, scale: int = SCALE, shard_vectors: int = SHARD_VECTORS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of each vector whose id is divisible by ``modulus``."""
    kept = Kept(embeddings.sparkSession, "topk")
    fine = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    usable = embeddings.where("vec_id is not null and embedding is not null and size(embedding) > 0").where(fine)
    vectors = kept.table(usable.select(F.col("vec_id").cast("long"), whole.alias("v")).distinct(), "vectors")
    shards = max(1, -(-vectors.count() // shard_vectors))
    shard = F.pmod(F.xxhash64("vec_id", F.hash("v")), F.lit(shards)).cast("int")
    stored = vectors.withColumn("shard", shard)
    asked = vectors.where(F.col("vec_id") % modulus == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    asked = kept.table(asked.withColumn("home", F.pmod(F.xxhash64("query_id", F.hash("v")), F.lit(shards)).cast("int")), "asked")
    none = F.lit(-(1 << 63)).cast("long")

    first = _by_shard(stored, asked.withColumn("shard", F.col("home")).withColumn("floor", none), shards, k)
    first = kept.table(_best(first, k).drop("rank"), "first")
    if shards == 1:
        return _best(first, k).select("query_id", "rank", "vec_id", "score")
    floors = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))
    others = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", none))
    others = others.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != F.col("home"))
    rest = _by_shard(stored, others, shards, k)
    return _best(first.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")
