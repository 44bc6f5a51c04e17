"""The region map against the whole map made anew after each batch."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import frontiers
from cairn.streaming.regions import RegionMap

DEPTH, LOW = 5, -10.0


def batches(seed):
    """A cube of free voxels that grows, then single changes, one of them within a pruned block."""
    rng = random.Random(seed)
    cube = lambda lo, hi: [(x, y, z, -6.0, 2.0) for x in range(lo, hi) for y in range(lo, hi) for z in range(lo, hi)]
    yield [v for v in cube(0, 24) if rng.random() < 0.98]
    yield cube(0, 24)
    yield [(3, 3, 3, 4.0, 2.0), (20, 9, 9, -7.0, 1.0)]
    yield [(30, 30, 30, 1.0, 1.0)]


def frontier_of(spark, voxels):
    df = spark.createDataFrame([(*k, *v) for k, v in voxels.items()], "x long, y long, z long, value double, weight double")
    return {tuple(r) for r in frontiers.frontier_blocks(df, DEPTH).collect()}


@pytest.mark.parametrize("low", [None, LOW])
def test_batches_equal_the_map_made_anew(spark, tmp_path, low):
    table, voxels = RegionMap(spark, str(tmp_path), DEPTH, 2, min_occupancy=low), {}
    for b, rows in enumerate(batches(4)):
        changed = spark.createDataFrame(rows, "vx long, vy long, vz long, value double, weight double")
        before = table.versions(b - 1)
        for _ in range(1 + (b == 2)):  # the third comes twice
            table.update(changed, b)
        voxels |= {r[:3]: r[3:] for r in rows}
        opened = {b for b in {tuple(c - c % 8 for c in k) for k in voxels}}
        got = {tuple(r)[:3]: tuple(r)[3:] for r in table.voxels(b, whole=True).collect()}
        assert got.keys() == voxels.keys()
        assert {k: v for k, v in got.items() if v != voxels[k]} == {} or low is not None
        assert {tuple(r) for r in table.frontier(b).collect()} == frontier_of(spark, voxels)
        after = table.versions(b)
        if b == 3:  # one voxel in a corner: far regions keep their versions
            assert [r for r in after if after[r] == 3] and [r for r in after if after[r] < 3 and before.get(r) == after[r]]
        shut = table._read("pruned", table._manifest(b)).count()
        if low is None:
            assert shut == 0
        else:
            inner = sum(all(tuple(c + d for c, d in zip(k, (i, j, m))) in voxels and voxels[tuple(c + d for c, d in zip(k, (i, j, m)))][0] < 0 for i in range(8) for j in range(8) for m in range(8)) for k in opened)
            assert table.voxels(b).count() == len(voxels) - 512 * shut
            assert 0 < shut <= inner if b in (1, 2) else shut <= inner


def test_eight_pruned_siblings_become_their_parent(spark, tmp_path):
    table = RegionMap(spark, str(tmp_path), 4, 0, min_occupancy=LOW)
    cube = spark.range(4096).select((F.col("id") % 16).alias("vx"), F.floor(F.col("id") / 16 % 16).alias("vy"), F.floor(F.col("id") / 256).alias("vz"), F.lit(-6.0).alias("value"), F.lit(2.0).alias("weight"))
    table.update(cube, 0)
    assert [tuple(r) for r in table.pruned(0).collect()] == [(0, -6.0, 2.0)] and table.voxels(0).count() == 0
    table.update(spark.createDataFrame([(9, 1, 1, -6.5, 2.0)], "vx long, vy long, vz long, value double, weight double"), 1)
    assert table.voxels(1, whole=True).count() == 4096
