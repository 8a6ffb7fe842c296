"""Connected components of a table of links, by star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regmart.llm.common import checkpointed, mix


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every node to the least node that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    roots = np.array([find(x) for x in range(len(nodes))], np.int64)
    keep = roots != np.arange(len(nodes))
    return nodes[keep], nodes[roots[keep]]


#: A node that occurs more often than OFTEN in a batch of links is dealt over PORTIONS tasks there.
OFTEN, PORTIONS = 16, 16
LINKS = "a long, b long, portion int"


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within what one task holds, links become stars: (a, b) with b the least node reached. Taken up batch by batch, so a task keeps no more links than it has nodes.

    ``portion`` is -1, or for links of a frequent b one of PORTIONS.
    """
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        if batch.num_rows:
            a, b = forest(np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()]))
    for low in range(0, len(a), 1 << 14):
        x, y = a[low : low + (1 << 14)], b[low : low + (1 << 14)]
        _, at, n = np.unique(y, return_inverse=True, return_counts=True)
        portion = np.where(n[at] > OFTEN, (mix(x.astype(np.uint64)) % np.uint64(PORTIONS)).astype(np.int32), np.int32(-1))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(portion.astype(np.int32))], ["a", "b", "portion"])


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reached) for the nodes of ``links`` (longs a and b); a node without links is not listed.

    Rounds until no link changes: every node hands its least neighbour to its greater neighbours (large star), then the links of each greater node meet in one task, which
    contracts all it holds to stars. A node with many links never meets them in one task: its least neighbour is sent to every portion of them. Every round is cut from
    its lineage in the shared folder; only two numbers of a round reach the driver.
    """
    edges = checkpointed(links.select("a", "b").filter("a <> b").mapInArrow(_contract, LINKS))
    before = None
    while True:
        ends = edges.select(F.col("b").alias("n"), F.col("a").alias("m"), (F.col("portion") >= 0).alias("often")).unionByName(edges.select(F.col("a").alias("n"), F.col("b").alias("m"), F.lit(False).alias("often")))
        least = ends.groupBy("n").agg(F.min("m").alias("m"), F.max("often").alias("often"))
        portions = F.when(F.col("often"), F.sequence(F.lit(-1), F.lit(PORTIONS - 1))).otherwise(F.array(F.lit(-1)))
        least = least.select(F.col("n").alias("b"), F.least("n", "m").alias("m"), F.explode(portions).alias("portion"))
        large = edges.join(least, ["b", "portion"]).select("a", F.col("m").alias("b"))
        edges = checkpointed(large.repartition("a").mapInArrow(_contract, LINKS))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
