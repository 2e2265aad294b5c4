import hashlib
import math

import numpy as np
import pytest

from tidemark.llm import centroids


def plain(vectors, k=16, rounds=3):
    """vec_id -> cluster, distance by loops over all components."""
    rows = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors]
    seeds = sorted(rows, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    now = [list(x) for _, x in seeds]

    def place(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(now))

    for _ in range(rounds):
        at = [place(x)[1] for _, x in rows]
        for j in range(len(now)):
            own = [x for (_, x), a in zip(rows, at) if a == j]
            if own:
                now[j] = [sum(c) // len(own) for c in zip(*own)]
    return [(i, place(x)[1], place(x)[0]) for i, x in rows], now


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")


@pytest.mark.parametrize("size,spread", [(3, 0.02), (40, 0.02), (200, 1.0), (60, 3e7)])
def test_equals_loops(spark, size, spread):
    """Few distinct integers make many ties; large ones need more than 64 bits."""
    r = np.random.default_rng(size)
    vectors = [(i, (r.normal(size=64) * spread).tolist()) for i in range(size)]
    got = centroids.cluster(frame(spark, [(i, v, "x") for i, v in vectors]))
    want, now = plain(vectors)
    assert got.centroids == now
    assert sorted(map(tuple, got.assigned.collect())) == sorted((i, j, min(d, 2**63 - 1)) for i, j, d in want)
    assert sum(got.inertia) == sum(min(d, 2**63 - 1) for _, _, d in want)


def test_order_and_step_change_nothing():
    r = np.random.default_rng(1)
    x, c = r.integers(-3, 4, (500, 64)), r.integers(-3, 4, (16, 64))
    every = ((x[:, None] - c[None]) ** 2).sum(2)
    for order in (np.arange(64), r.permutation(64)):
        for step in (1, 5, 8, 64):
            label, far = centroids.nearest(x, c, order, step)
            assert (label == every.argmin(1)).all() and (far == every.min(1)).all()


def test_ties_take_the_smaller_number():
    x = np.zeros((4, 64), np.int64)
    c = np.ones((3, 64), np.int64) * np.array([[1], [-1], [1]])
    assert centroids.nearest(x, c, np.arange(64))[0].tolist() == [0] * 4


def test_rows_that_are_left_out_and_odd_ids(spark):
    good = [0.5] * 64
    rows = [(1, good, "a"), (1, good, "a"), (None, good, "b"), (2, None, "c"), (3, good[1:], "d"), (4, [*good, 1.0], "e"), (5, [None, *good[1:]], "f"),
            (6, [math.nan, *good[1:]], "g"), (7, [math.inf, *good[1:]], "h"), (8, [-math.inf, *good[1:]], "i"), (9, [-0.3, *good[1:]], "j"), (10, [1e30, *good[1:]], "k")]
    got = centroids.cluster(frame(spark, rows))
    assert sorted((r["vec_id"] or 0) for r in got.assigned.collect()) == [0, 1, 1, 9] and len(got.centroids) == 4
    assert centroids.cluster(frame(spark, rows[3:9])).assigned.count() == 0
    again = centroids.cluster(frame(spark, rows).repartition(3).selectExpr("vec_id", "embedding", "1 AS x", "2 AS cluster", "3 AS distance"))
    assert again.centroids == got.centroids and sorted(map(repr, again.assigned.collect())) == sorted(map(repr, got.assigned.collect()))
