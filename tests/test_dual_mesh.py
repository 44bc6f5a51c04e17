"""Dual marching cubes: closed over borders of scales, the plain mesh on one scale, the surface where it should be."""

import itertools
import random
from collections import Counter

import pytest

from cairn.operators import meshing

SCHEMA = "x long, y long, z long, scale int, value double"


def leaves(scale_of, field, edge=24):
    out = []
    for b in itertools.product(range(0, edge, 8), repeat=3):
        s = scale_of(b)
        n = 1 << s
        out += [(*[c + i for c, i in zip(b, o)], s, field(*[c + i + n / 2 for c, i in zip(b, o)])) for o in itertools.product(range(0, 8, n), repeat=3)]
    return out


def triangles(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["x"], r["y"], r["z"], r["triangle"]), {})[r["vertex"]] = tuple(round(r[c], 6) for c in ("vx", "vy", "vz"))
    return [tuple(t[i] for i in range(3)) for t in out.values()]


SPHERE = lambda x, y, z: ((x - 11.3) ** 2 + (y - 12.1) ** 2 + (z - 12.7) ** 2) ** 0.5 - 7.05


@pytest.mark.parametrize("scale_of", [lambda b: 0, lambda b: 1, lambda b: int(b[0] >= 8), lambda b: (b[0] // 8 + b[1] // 8) % 2, lambda b: random.Random(sum(c * 31**i for i, c in enumerate(b))).randrange(3)])
def test_surface_is_closed(spark, scale_of):
    found = triangles(meshing.dual_marching_cubes(spark.createDataFrame(leaves(scale_of, SPHERE), SCHEMA)))
    assert len(found) > 100
    edges = Counter(tuple(sorted((t[i], t[(i + 1) % 3]))) for t in found for i in range(3))
    assert all(n % 2 == 0 for n in edges.values()), [e for e, n in edges.items() if n % 2][:3]
    assert all(abs(SPHERE(*p)) < 1.2 for t in found for p in t)


def test_one_scale_equals_the_plain_mesh(spark):
    rng = random.Random(8)
    rows = leaves(lambda b: 0, lambda x, y, z: rng.uniform(-1, 1), 8)
    dual = triangles(meshing.dual_marching_cubes(spark.createDataFrame(rows, SCHEMA)))
    plain = meshing.marching_cubes(spark.createDataFrame([(x, y, z, v) for x, y, z, _, v in rows], "x long, y long, z long, value double"))
    plain = [tuple(tuple(round(c + 0.5, 6) for c in p) for p in t) for t in triangles(plain)]
    assert sorted(dual) == sorted(plain)
