"""Covers of shapes: the very voxels, disjoint, in far fewer rows; status over leaves of mixed sizes; keys to allocate."""

import itertools

from cairn.operators import shapes

SCHEMA = "shape long, ax double, ay double, az double, bx double, by double, bz double, radius double"


def cells(x, y, z, size):
    return [(x + i, y + j, z + k) for i, j, k in itertools.product(range(size), repeat=3)]


def voxels(s, edge):
    _, *a, bx, by, bz, r = s
    axis = [p - q for p, q in zip((bx, by, bz), a)]
    length, out = sum(d * d for d in axis), set()
    for p in itertools.product(range(edge), repeat=3):
        off = [c + 0.5 - q for c, q in zip(p, a)]
        t = sum(o * d for o, d in zip(off, axis)) / length if length else 0
        if 0 <= t <= 1 and sum((o - t * d) ** 2 for o, d in zip(off, axis)) <= r * r:
            out.add(p)
    return out


def test_cover_equals_the_voxels_in_few_rows(spark):
    rows = [(0, 30.3, 31.1, 29.7, 30.3, 31.1, 29.7, 21.2), (1, 5.1, 6.2, 40.3, 50.2, 44.1, 20.9, 9.3), (2, -3.0, 2.2, 2.1, -3.0, 2.2, 2.1, 6.4), (3, 100.0, 0.0, 0.0, 100.0, 0.0, 0.0, 2.0), (4, 8.5, 8.5, 8.5, 8.5, 8.5, 8.5, 0.1)]
    got = {}
    for r in shapes.cover(spark.createDataFrame(rows, SCHEMA), 6).collect():
        got.setdefault(r["shape"], []).append((r["x"], r["y"], r["z"], r["size"]))
    for s in rows:
        listed = [c for o in got.get(s[0], []) for c in cells(*o)]
        assert len(listed) == len(set(listed)) and set(listed) == voxels(s, 64), s
    assert len(got[0]) < len(voxels(rows[0], 64)) / 4 and max(o[3] for o in got[0]) >= 8


def test_status_over_mixed_leaves(spark):
    sphere = spark.createDataFrame([(k, x, 16.0, 16.0, x, 16.0, 16.0, 5.0) for k, x in enumerate((16.0, 40.0, 8.0))], SCHEMA)
    free = [(x, y, z, 16, -1.0) for x in (0, 16) for y in (0, 16) for z in (0, 16)]
    small = [(x, y, z, 8, -1.0) for x in (32, 40) for y in (8, 16) for z in (8, 16)] + [(48, y, z, 1, 1.0) for y in range(8, 24) for z in range(8, 24)]
    leaves = spark.createDataFrame(free + small, "x long, y long, z long, size long, value double")
    got = {r["shape"]: (r["free"], r["occupied"]) for r in shapes.status(shapes.cover(sphere, 6), leaves, 6).collect()}
    assert got == {0: (True, False), 1: (True, False), 2: (True, False)}
    wall = spark.createDataFrame([(0, 46.0, 16.0, 16.0, 46.0, 16.0, 16.0, 5.0), (1, 16.0, 40.0, 16.0, 16.0, 40.0, 16.0, 3.0)], SCHEMA)
    got = {r["shape"]: (r["free"], r["occupied"]) for r in shapes.status(shapes.cover(wall, 6), leaves, 6).collect()}
    assert got == {0: (False, True), 1: (False, False)}


def test_keys_to_allocate(spark):
    sphere = spark.createDataFrame([(0, 16.0, 16.0, 16.0, 16.0, 16.0, 16.0, 14.1)], SCHEMA)
    got = {r["key"]: r["whole"] for r in shapes.keys(shapes.cover(sphere, 6), 6).collect()}
    blocks = {}
    for p in voxels((0, 16.0, 16.0, 16.0, 16.0, 16.0, 16.0, 14.1), 64):
        b = tuple(c - c % 8 for c in p)
        blocks[b] = blocks.get(b, 0) + 1
    code = lambda b: sum((c >> i & 1) << 3 * i + k for i in range(6) for k, c in enumerate(b))
    assert got == {code(b) + 3: n == 512 for b, n in blocks.items()}
