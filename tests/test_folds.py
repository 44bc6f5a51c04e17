"""Folds of hot voxels by ranges against a plain loop; carving, projection and rays of frames are held against SQL in test_queries."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import fusion

MOST = 3.0


def replayed(kind, seen):
    x, y, n = (1.0 if kind == "tsdf" else 0.0), 0.0, 0
    for t, v in seen:
        if kind == "tsdf":
            x, y = (y * x + max(-1.0, min(1.0, v))) / (y + 1), min(y + 1, MOST)
        elif kind == "mean":
            x, y, n = (y * x + v) / (y + 1), min(y + 1, MOST), n + 1
        elif v != 0.5:
            from math import log2

            p = max(0.03, min(0.97, v))
            x, y = max(-8.0, min(8.0, x * max(0.5, 1 / (1 + (t - y) / 4.0)) + log2(p / (1 - p)))), float(t)
    return (x, y, n) if kind == "mean" else (x, y)


@pytest.mark.parametrize("kind", ["tsdf", "mean", "odds"])
@pytest.mark.parametrize("many", [7, 4096])
def test_hot_voxel_equals_a_plain_loop(spark, kind, many):
    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(1, 40), t // 3, t, rng.choice([0.5, rng.uniform(0, 1), rng.uniform(-1.5, 1.5)])) for t in range(3000)]
    want = {}
    for k, t, _, v in rows:
        want.setdefault(k, []).append((t, v))
    rng.shuffle(rows)
    seen = spark.createDataFrame(rows, "k long, t long, o long, v double").repartition(4)
    run = {"tsdf": lambda: fusion.fuse_tsdf(seen, ["k"], ["t", "o"], "v", MOST, many=many), "mean": lambda: fusion.fuse_mean(seen, ["k"], ["t", "o"], "v", MOST, many=many), "odds": lambda: fusion.fuse_log_odds(seen, ["k"], ["t", "o"], "v", "t", most=8.0, many=many)}[kind]
    got = {r["k"]: tuple(r[1:]) for r in run().collect()}
    assert got.keys() == want.keys()
    for k, s in want.items():
        assert got[k] == pytest.approx(replayed(kind, s), abs=1e-9), k


def test_hot_voxel_fills_no_task(spark):
    """A voxel with 300,000 observations: no list of it is longer than the bound, and its mean is right."""
    seen = spark.range(300_000).select(F.lit(1).alias("k"), "id", (F.col("id") % 10).cast("double").alias("v"))
    r = fusion.fuse_mean(seen, ["k"], ["id"], "v", 1e9).first()
    assert r["n"] == 300_000 and r["x"] == pytest.approx(4.5)
