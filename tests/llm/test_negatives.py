"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regmart.llm import negatives
from regmart.llm.negatives import RTree, tiles

CLIP = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))


def brute(rows, n_positives=5, k=3, low=50, high=95):
    fine = [(i, label, [CLIP(math.floor(256 * x)) for x in v]) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, label, q in {(i, label, tuple(q)) for i, label, q in fine if i % 50 == 0}:
        scored = sorted((-CLIP(sum(a * b for a, b in zip(q, r))), j, other) for j, other, r in fine if j != i and len(r) == len(q))
        for s, p, _ in [x for x in scored if x[2] == label][:n_positives]:
            hits = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:k]
            out |= {(i, p, n + 1, j, -s, -t) for n, (t, j, _) in enumerate(hits)}
    return out


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit(1)).withColumn("anchor", F.lit("x"))
    return {tuple(r) for r in negatives.mine(df, F.col("vec_id") % 50 == 0, **options).collect()}


@pytest.mark.parametrize("least_rows", [40, 1 << 12])
def test_against_brute_force(spark, least_rows):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0.3, 1) for _ in range(6)], rnd.choice([0, 0, 0, 1, 2, 9])) for i in range(500)]
    rows += [(i + 500, rows[i][1], rows[i][2]) for i in range(0, 60)]  # ties
    rows += [(900, None, 1), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (902, [math.inf] * 6, 1), (903, [1.0] * 6, None), (None, [1.0] * 6, 1), (904, [], 2), (950, [1.0, 2.0], 0), (951, [1.0, 1.0], 0), (952, [0.5, 1.0], 4)]
    rows += [(1000 + i, [2.0, 2.0, 2.0, 2.0, 2.0, 2.0], 7) for i in range(0, 60)]
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows, least_rows=least_rows) == want


def test_beyond_doubles_and_empty(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.choice((1e300, 3e6, 7e12, 0.5, 1.0, -2.0)) for _ in range(3)], i % 3) for i in range(200)]
    assert mined(spark, rows, least_rows=50) == brute(rows)
    assert mined(spark, [(1, [1.0], 1)]) == set() and mined(spark, []) == set()
    assert mined(spark, [(0, [-1.0], 1), (1, [1.0], 1), (2, [1.0], 2)]) == set()  # below zero the window is empty


def test_copies_are_rows_of_their_own(spark):
    rows = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (2, [0.9], 2), (3, [0.8], 2), (4, [0.7], 2)]
    assert mined(spark, rows) == {(0, 1, 1, 2, 65536, 58880), (0, 1, 2, 2, 65536, 58880), (0, 1, 3, 3, 65536, 52224)}


def test_boxes_hold_their_rows_and_cut_what_is_far():
    random_ = np.random.default_rng(2)
    x = random_.integers(-500, 500, (3000, 5))
    leaves = tiles(x)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(3000)) and max(map(len, leaves)) <= negatives.LEAF
    tree = RTree(np.arange(3000), np.zeros(3000, np.int64), np.ones(3000, np.int64), x)
    for q in random_.integers(-300, 300, (20, 5)):
        low, high = tree.intervals(q.astype(np.float64))
        scores = tree.x @ q
        for (a, b), least, most in list(zip(tree.spans, low, high))[: tree.leaves]:
            assert least <= scores[a:b].min() and scores[a:b].max() <= most
    # Two far clusters: with the floor of the near one, no leaf of the other is scored.
    far = np.concatenate([x, x - 100_000])
    tree, visited = RTree(np.arange(6000), np.zeros(6000, np.int64), np.ones(6000, np.int64), far), []
    plain = tree.scores
    tree.scores = lambda a, b, *more: visited.append((a, b)) or plain(a, b, *more)
    tree.search(-1, 0, True, np.array([1, 1, 1, 1, 1]), 3, [(negatives.LEAST, negatives.MOST)], [negatives.LEAST])
    assert 0 < len(visited) < tree.leaves / 2
