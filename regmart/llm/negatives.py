"""Hard-negative mining: STR-packed R-trees, searched best first.

For every anchor the best rows of its own label are its positives; for every positive the best rows of other labels whose score lies within a window below the
positive's are its hard negatives. Rows are dealt to shards by a hash; a shard's rows are sorted by label and tiled by sort-tile-recursive packing along the widest
components of each label into leaves, and boxes are packed into boxes. With a query, the box of a node gives an interval of inner products, a sum of one interval a component, and
its labels an interval too. Nodes are visited in the order of their upper ends; those whose interval lies outside every window, or strictly below the kth score of every
window, or that hold no label asked for, are cut.

Rows alike are counted before they are dealt. A shard is packed once, whatever the number of anchors, which stream past it; they bring the kth scores that the first shard has
found. What shards find is ranked once more for each anchor. The number of shards follows the session's parallelism until a shard holds ``SHARD_ROWS``.

Inner products are exact as in ``topk``: in doubles while they fit 52 bits, in longs while they fit 63, in Python's integers beyond (and then the nearest long).

Defined cases: rows without an id or a label, and vectors that are null, empty, or hold null or non-finite components, take no part; higher scores come first, ties by
the smaller vec_id; rows that repeat an id, alike or not, are rows of their own, but never partners of an anchor of that id; rows alike are one anchor; anchors of one id that
differ in label or vector are anchors of their own, with the rows of each in the result; vectors of another length than the anchor's are no partners; other columns are ignored; without anchors, or from an empty table, there are no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regmart.llm.common import checkpointed, partitions
from regmart.llm.topk import LEAST, MOST, matrix, vectors

SHARD_ROWS, LEAST_ROWS = 1 << 17, 1 << 12
LEAF, FANOUT = 128, 8
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95


def tiles(x: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Sort-tile-recursive packing: rows sorted by the widest component, cut into slabs, each slab by the next one, and so on down to runs of ``leaf`` rows."""
    pages = math.ceil(len(x) / leaf)
    wide = np.argsort(-x.astype(np.float64).var(axis=0), kind="stable")[: max(1, math.ceil(math.log2(max(2, pages))))]

    def cut(rows: np.ndarray, axes: np.ndarray) -> Iterator[np.ndarray]:
        own = math.ceil(len(rows) / leaf)
        rows = rows[np.argsort(x[rows, axes[0]], kind="stable")] if own > 1 else rows
        if own <= 1:
            yield rows
        elif len(axes) == 1:
            yield from (rows[i : i + leaf] for i in range(0, len(rows), leaf))
        else:
            slab = leaf * math.ceil(own / math.ceil(own ** (1 / len(axes))))
            for i in range(0, len(rows), slab):
                yield from cut(rows[i : i + slab], axes[1:])

    return list(cut(np.arange(len(x)), wide))


class RTree:
    """Boxes over rows of an integer matrix. ``low`` and ``high`` hold every node's box; a leaf has a run of rows, an inner node a run of nodes of the level below."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, copies: np.ndarray, x: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        by_label = np.lexsort((ids, labels))
        cuts = np.flatnonzero(np.diff(labels[by_label])) + 1
        runs = [rows[t] for rows in np.split(by_label, cuts) for t in tiles(x[rows], leaf)]
        if len(cuts) > 1 and len(runs) > 2 * math.ceil(len(ids) / leaf):  # more labels than leaves: labels share them
            runs = [by_label[i : i + leaf] for i in range(0, len(by_label), leaf)]
        order = np.concatenate(runs)
        self.ids, self.labels, self.copies, self.x = ids[order], labels[order], copies[order], x[order]
        self.f = self.x.astype(np.float64)
        ends = np.cumsum([len(r) for r in runs]).tolist()
        self.spans = list(zip([0, *ends[:-1]], ends))
        self.leaves, level = len(self.spans), range(len(self.spans))
        lows, highs = ([f(self.x[a:b], axis=0) for a, b in self.spans] for f in (np.min, np.max))
        label_low, label_high = ([f(self.labels[a:b]) for a, b in self.spans] for f in (np.min, np.max))
        while len(level) > 1:
            made = len(lows)
            for i in range(level.start, level.stop, fanout):
                own = slice(i, min(i + fanout, level.stop))
                self.spans.append((own.start, own.stop))
                for values, f in ((lows, np.min), (highs, np.max), (label_low, np.min), (label_high, np.max)):
                    values.append(f(values[own], axis=0))
            level = range(made, len(lows))
        self.low, self.high = np.array(lows, np.float64), np.array(highs, np.float64)
        self.label_low, self.label_high = np.array(label_low), np.array(label_high)
        self.largest = float(np.abs(self.f).max())

    def intervals(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product with ``q`` that the box of every node allows, a little wider for rounding."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        slack = 1e-6 + 1e-12 * len(q) * float(np.abs(q).sum()) * self.largest
        return self.low @ up + self.high @ down - slack, self.high @ up + self.low @ down + slack

    def scores(self, a: int, b: int, q: np.ndarray, qf: np.ndarray, most: float) -> np.ndarray:
        if most < 2**52:
            return self.f[a:b] @ qf
        return self.x[a:b] @ q if most < 2**62 else np.clip(self.x[a:b].astype(object) @ q.astype(object), LEAST, MOST).astype(np.int64)

    def search(self, own_id: int, label: int, same: bool, q: np.ndarray, k: int, windows: list[tuple[int, int]], kth: list[int]) -> list[list[tuple[int, int]]]:
        """For every window at most k (score, vec_id), best first, of scores within it and not under its ``kth``, of the same label or of all others."""
        qf = q.astype(np.float64)
        least, most = (np.clip(v, LEAST, MOST) for v in self.intervals(qf))
        size = self.largest * float(np.abs(qf).max()) * len(q)
        asked = (self.label_low <= label) & (label <= self.label_high) if same else (self.label_low != label) | (self.label_high != label)
        best: list[list[tuple[int, int]]] = [[] for _ in windows]
        floor = [max(w[0], f) for w, f in zip(windows, kth)]
        root = len(self.spans) - 1
        queue = [(-most[root], root)] if asked[root] else []
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < min(floor):
                break
            fits = [j for j in range(len(windows)) if most[node] >= floor[j] and least[node] <= windows[j][1]]
            if not fits:
                continue
            a, b = self.spans[node]
            if node >= self.leaves:
                for child in range(a, b):
                    if asked[child]:
                        heapq.heappush(queue, (-most[child], child))
                continue
            scores = self.scores(a, b, q, qf, size)
            other = (self.ids[a:b] != own_id) & ((self.labels[a:b] == label) == same)
            for j in fits:
                hit = np.flatnonzero(other & (scores >= floor[j]) & (scores <= windows[j][1]))
                if len(hit) > k:
                    hit = hit[np.lexsort((self.ids[a:b][hit], ~scores[hit].astype(np.int64)))[:k]]
                if len(hit):
                    found = [(int(scores[i]), int(self.ids[a + i])) for i in hit for _ in range(min(k, int(self.copies[a + i])))]
                    best[j] = sorted(best[j] + found, key=lambda s: (-s[0], s[1]))[:k]
                    if len(best[j]) == k:
                        floor[j] = max(floor[j], best[j][-1][0])
        return best


FOUND = "anchor string, slot int, vec_id long, score long"
ASKED = ("anchor", "slots", "lows", "highs", "floors")


def search_shards(shards: DataFrame, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """anchor, slot, vec_id and score that the shards find for what is asked of them. Rows and questions of a shard meet sorted, the rows first; the tree is built once and the questions stream past it."""
    both = shards.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    both = both.repartition(partitions(shards), "shard", "dim").sortWithinPartitions("shard", "dim", "asks").select("shard", "dim", "asks", "vec_id", "label", "copies", "q", *ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, now, rows = None, None, []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            starts = [i for i, key in enumerate(keys) if not i or key != keys[i - 1]]
            for i, j in zip(starts, [*starts[1:], len(keys)]):
                shard, dim, asks = keys[i]
                if (shard, dim) != now:
                    tree, now, rows = None, (shard, dim), []
                part = batch.slice(i, j - i)
                x = matrix(part.column(6), dim)
                if not asks:
                    rows.append((*(part.column(c).to_numpy() for c in (3, 4, 5)), x))
                    continue
                if rows:
                    tree, rows = RTree(*map(np.concatenate, zip(*rows))), []
                if tree is None:
                    continue
                found: list[tuple[str, int, int, int]] = []
                for own_id, label, q, anchor, slots, lows, highs, floors in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), x, *(part.column(c).to_pylist() for c in range(7, 12))):
                    best = tree.search(own_id, label, same, q, k, list(zip(lows, highs)), floors)
                    found += [(anchor, slot, vec_id, score) for slot, own in zip(slots, best) for score, vec_id in own]
                columns = list(zip(*found)) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["anchor", "slot", "vec_id", "score"])

    return both.mapInArrow(run, FOUND)


def best_of(shards: DataFrame, n_shards: int, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """anchor, slot, rank, vec_id, score of the k best rows in every window of every anchor; from the second shard on the search starts from the first one's kth scores."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    none = anchors.withColumn("floors", F.transform("lows", lambda x: F.lit(LEAST)))
    found = ranked(search_shards(shards.filter("shard = 0"), none.withColumn("shard", F.lit(0)), same, k))
    if n_shards == 1:
        return found
    found = checkpointed(found)
    kth = found.groupBy("anchor", "slot").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") == k)
    kth = kth.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "kth"))).alias("kth"))  # at most as many entries as an anchor has windows
    floors = F.transform("slots", lambda s: F.coalesce(F.try_element_at("kth", s), F.lit(LEAST)))
    told = anchors.join(kth, "anchor", "left").withColumn("floors", floors).drop("kth").withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(n_shards - 1))))
    more = search_shards(shards.filter("shard > 0"), told, same, k)
    return ranked(more.unionByName(found.select("anchor", "slot", "vec_id", "score")))


def dealt(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """vec_id, label, quantised vector, its length and the number of copies of the rows that take part."""
    one = vectors(rows, id_col, vector_col, label=F.col(label_col).cast("long")).filter("label IS NOT NULL")
    return one.groupBy("vec_id", "label", "q", "dim").agg(F.count("*").alias("copies"))


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = 5, k: int = 3, low: int = LOW, high: int = HIGH, shard_rows: int = SHARD_ROWS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. ``is_anchor`` is a condition on vec_id; ``low`` and ``high`` are hundredths of the positive's score."""
    shards = dealt(rows).withColumn("anchor", F.concat_ws(":", "vec_id", F.xxhash64("label", "q")))
    shards = checkpointed(shards)
    n = shards.count()
    n_shards = max(1, math.ceil(n / shard_rows), min(math.ceil(n / least_rows), 2 * partitions(shards)))
    anchors = shards.filter(is_anchor).select("anchor", "vec_id", "label", "q", "dim")
    spread = shards.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(n_shards)).cast("int")).drop("anchor")
    everything = anchors.withColumn("slots", F.array(F.lit(0))).withColumn("lows", F.array(F.lit(LEAST))).withColumn("highs", F.array(F.lit(MOST)))
    positives = checkpointed(best_of(spread, n_shards, everything, True, n_positives).select("anchor", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # The ends of a window in whole numbers; hundredths of a long fit a decimal.
    score = F.col("positive_score").cast("decimal(20,0)")
    ends = positives.filter(score * low <= score * high).select("anchor", "slot", F.ceil(score * low / 100).cast("long").alias("low"), F.floor(score * high / 100).cast("long").alias("high"))
    lists = ends.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "low", "high"))).alias("w"))  # n_positives entries at most
    windows = anchors.join(lists.select("anchor", F.col("w.slot").alias("slots"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs")), "anchor")
    found = best_of(spread, n_shards, windows, False, k)
    return (
        found.select("anchor", "slot", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(positives, ["anchor", "slot"])
        .select(F.substring_index("anchor", ":", 1).cast("long").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
