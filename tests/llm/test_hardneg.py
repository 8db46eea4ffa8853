"""Hard negatives against brute force, and bounds against exact products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisift.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, anchor=lambda i: i % 5 == 0, positives=hardneg.POSITIVES, negatives=hardneg.NEGATIVES):
    from collections import Counter

    def fine(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1])

    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label) for i, v, label in filter(fine, rows)]
    if not good:
        return []
    width = sorted(Counter(len(v) for _, v, _ in good).items(), key=lambda x: (-x[1], x[0]))[0][0]
    good = [r for r in good if len(r[1]) == width]
    asks = {}
    for i, v, label in good:
        if anchor(i):
            own = (np.array(v, dtype="<i4").tobytes(), str(label), v, label)
            asks[i] = min(asks.get(i, own), own)
    out = []
    for a, (_, _, v, label) in asks.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, w, other in good if i != a)
        for k, (p, i, _) in enumerate([s for s in scored if s[2] == label][:positives], 1):
            hard = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            out += [(a, i, rank, s[1], -p, -s[0], k) for rank, s in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows, **how):
    found = hardneg.mine(spark.createDataFrame(rows, SCHEMA), lambda i: i % 5 == 0, **how)
    return sorted(tuple(r) for r in found.collect())


def random_rows(n, width, seed, labels=3):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(4, width))
    return [(i, (heads[rng.integers(4)] + 0.4 * rng.normal(size=width)).round(3).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("width", [3, 20, 40])
def test_equals_brute_force(spark, width):
    rows = random_rows(160, width, width)
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 50


def test_ties_repeated_rows_nulls_and_other_lengths(spark):
    rows = random_rows(60, 6, 1)
    same = [0.5, -0.25, 1.0, 0.0, 0.125, 2.0]
    rows += [(100 + i, same, i % 2) for i in range(30)]  # ties, broken by id
    rows += [rows[0], rows[0], rows[7], (5, same, 1)]  # repeated rows, and an id with two vectors
    rows += [(200, None, 1), (205, [], 1), (210, same, None), (None, same, 1), (215, [float("nan"), 1.0, 1.0, 1.0, 1.0, 1.0], 1), (220, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 1), (225, [1.0], 1), (230, [float("inf")] * 6, 0), (235, [0.0] * 6, 0), (240, [1e30] * 6, 0)]
    assert mined(spark, rows) == brute([r for r in rows if r[0] != 240])  # products beyond a long take no part


def test_empty_table_and_clashing_columns(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0)]) == []  # no anchor
    rows = random_rows(40, 4, 2)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("x")).withColumn("id", F.lit(1)).withColumn("block", F.lit(2)).withColumn("x", F.lit(3))
    assert sorted(tuple(r) for r in hardneg.mine(df, lambda i: i % 5 == 0).collect()) == brute(rows)


def test_bounds_hold_and_discard():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(500, 64)) * np.exp(-np.arange(64) / 6) * 256 @ np.linalg.qr(rng.normal(size=(64, 64)))[0]).astype(np.int32)
    axes = np.linalg.eigh(x.astype(float).T @ x)[1][:, ::-1]
    side = hardneg.Rotated(x, axes, hardneg.stages_of(64))
    exact = x.astype(np.int64) @ x.astype(np.int64).T
    for lower, upper in hardneg.bounds(side, side):
        assert (lower <= exact).all() and (exact <= upper).all()
    at, to, score, verified = hardneg.best(side, side, ~np.eye(500, dtype=bool), np.arange(500), 5)
    assert (score == exact[at, to]).all() and verified < 500 * 500 / 5  # most pairs are never multiplied whole
