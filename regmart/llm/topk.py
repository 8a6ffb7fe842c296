"""Exact top-k search: ball-tree branch and bound in shards.

Vectors are dealt by a hash of their id to shards of about ``SHARD_ROWS``; each shard builds a ball tree. Queries come in blocks of about
``BLOCK_ROWS``. Nodes are visited in the order of their inner-product upper bound q.c + |q| r, and those whose bound lies under the current
kth score are cut. The kth score is shared: shards are searched in rounds of 1, 3, 12, 48, ... shards, and every round starts from the kth scores that all rounds before it
have found. What shards find is ranked once more for each query.

Inner products are exact: in doubles while they fit 52 bits, in longs while they fit 63, in Python's integers beyond; a score beyond a long is the long nearest to it, as is a
component.

Defined cases: vectors that are null, empty, or hold null or non-finite components, and rows without an id, take no part; ties go to the smaller
vec_id; rows that repeat an id are candidates of their own (not for a query of that id); vectors of another length than the query's are
no candidates; without queries or candidates, or from an empty table, there are no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regmart.llm.common import checkpointed

SHARD_ROWS, BLOCK_ROWS, LEAF = 4096, 8192, 96
LEAST, MOST = -(1 << 63), (1 << 63) - 1
FOUND = "query_id long, vec_id long, score long"


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **more: Column) -> DataFrame:
    """vec_id, quantised components floor(256 x) and their number, of the rows that take part; further columns under the names given."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(math.inf)))
    return rows.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * 256).cast("long")).alias("q"), F.size(x).alias("dim"), *(c.alias(name) for name, c in more.items()))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, dim)


class BallTree:
    """Balls over rows of an integer matrix, split at the median of the widest component."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.spans, self.centers, self.radii, self.children = [], [], [], []
        order = np.argsort(ids, kind="stable")
        self.order, self.f = order, x.astype(np.float64)
        self.build(0, len(ids))
        self.ids, self.x = ids[self.order], x[self.order]
        self.center, self.radius = np.array(self.centers), np.array(self.radii)
        self.largest = float(np.abs(x.astype(np.float64)).max()) if len(x) else 0.0
        self.far = np.sqrt((self.center**2).sum(axis=1)) + self.radius
        self.f = self.x.astype(np.float64)

    def build(self, a: int, b: int) -> int:
        own = self.f[self.order[a:b]]
        center = own.mean(axis=0)
        me = len(self.spans)
        self.spans.append((a, b))
        self.centers.append(center)
        self.radii.append(float(np.sqrt(((own - center) ** 2).sum(axis=1).max())))
        self.children.append(())
        if b - a > LEAF and self.radii[me] > 0:
            widest = int(own.var(axis=0).argmax())
            self.order[a:b] = self.order[a:b][np.argsort(own[:, widest], kind="stable")]
            middle = (a + b) // 2
            self.children[me] = (self.build(a, middle), self.build(middle, b))
        return me

    def search(self, query_id: int, q: np.ndarray, k: int, floor: float) -> list[tuple[int, int]]:
        """At most k (score, vec_id), best first, of scores not under ``floor``."""
        qf = q.astype(np.float64)
        norm = math.sqrt(float(qf @ qf))
        upper = self.center @ qf + norm * self.radius + 1e-6 + 1e-9 * norm * self.far
        heap, best = [(-upper[0], 0)], []
        most = self.largest * float(np.abs(qf).max()) * len(qf)
        while heap:
            bound, node = heapq.heappop(heap)
            kth = best[-1][0] if len(best) == k else floor
            if -bound < kth:
                break
            if self.children[node]:
                for c in self.children[node]:
                    if upper[c] >= kth:
                        heapq.heappush(heap, (-upper[c], c))
                continue
            a, b = self.spans[node]
            scores = self.f[a:b] @ qf if most < 2**52 else self.x[a:b] @ q if most < 2**62 else np.clip(self.x[a:b].astype(object) @ q.astype(object), LEAST, MOST).astype(np.int64)
            hit = np.flatnonzero((scores >= kth) & (self.ids[a:b] != query_id))
            if len(hit) > k:
                hit = hit[np.lexsort((self.ids[a:b][hit], ~scores[hit].astype(np.int64)))[:k]]
            best = sorted(best + [(int(scores[i]), int(self.ids[a + i])) for i in hit], key=lambda s: (-s[0], s[1]))[:k]
        return best


def top_k(rows: DataFrame, is_query: Column, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of every query's k best other vectors. ``is_query`` is a condition on vec_id."""
    all_rows = vectors(rows)
    n, n_queries = all_rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(n_queries / block_rows))
    spread = F.xxhash64("vec_id")
    data = all_rows.withColumn("shard", F.pmod(spread, F.lit(shards)).cast("int"))
    queries = all_rows.filter(is_query).withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int"))

    def search(keys: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            dim = right.column("dim")[0].as_py()
            tree = BallTree(left.column("vec_id").to_numpy(), matrix(left.column("q"), dim))
            floors = right.column("floor").to_pylist() if "floor" in right.column_names else [None] * right.num_rows
            for query_id, q, floor in zip(right.column("vec_id").to_pylist(), matrix(right.column("q"), dim), floors):
                found += [(query_id, i, s) for s, i in tree.search(query_id, q, k, -math.inf if floor is None else floor)]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * 3)], names=["query_id", "vec_id", "score"])

    keys = ("shard", "block", "dim")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def run(low: int, high: int, with_floor: DataFrame) -> DataFrame:
        left = data.filter((F.col("shard") >= low) & (F.col("shard") < high)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = with_floor.withColumn("shard", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        right = right.toDF(*right.columns)  # attributes of its own: both sides come from one table
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, FOUND)

    once = queries.dropDuplicates(["vec_id", "q"])
    best, low, high = None, 0, 1
    while low < shards:
        if best is None:
            found = run(low, high, once)
        else:
            floors = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("least")).alias("floor"))
            found = run(low, high, once.join(floors, "vec_id", "left")).unionByName(best.select("query_id", "vec_id", "score"))
        best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        low, high = high, min(shards, 4 * high)
        if low < shards:
            best = checkpointed(best)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
