import math
import random

import numpy as np
from pyspark.sql import functions as F

from cairn.functions import geometry, morton, scalars
from cairn.operators import allocation, association, images, meshing, tracking


def code(x, y, z):
    return sum((v >> i & 1) << 3 * i + k for i in range(21) for k, v in enumerate((x, y, z)))


def test_morton_round_trip(spark):
    rng = random.Random(1)
    rows = [tuple(rng.randrange(1 << 21) for _ in range(3)) for _ in range(200)] + [(0, 0, 0), (2**21 - 1,) * 3]
    df = spark.createDataFrame(rows, "x long, y long, z long").withColumn("code", morton.interleave(F.col("x"), F.col("y"), F.col("z")))
    for r in df.select("*", *[morton.gather(F.shiftright("code", k)).alias(n) for k, n in enumerate("abc")]).collect():
        assert r["code"] == code(r["x"], r["y"], r["z"]) and (r["a"], r["b"], r["c"]) == (r["x"], r["y"], r["z"])


def test_ancestors_and_unique(spark):
    rows = [(64, 0, 64, 4), (96, 0, 64, 5), (80, 0, 64, 5), (128, 24, 80, 5)]
    keys = spark.createDataFrame(rows, "x long, y long, z long, d long").select(morton.encode(F.col("x"), F.col("y"), F.col("z"), F.col("d"), 10).alias("key"))
    assert allocation.filter_ancestors(keys, 10).count() == 3
    assert allocation.unique_multiscale(keys).count() == 3
    assert allocation.filter_ancestors(keys.limit(0), 10).count() == 0


def test_balanced_neighbours(spark):
    keys = spark.createDataFrame([(0, 0, 0)], "x long, y long, z long").select(morton.encode(F.col("x"), F.col("y"), F.col("z"), 5, 8).alias("key"))
    got = {r["key"] for r in allocation.balance(keys, 8).collect()}
    assert len(got) > 6 and all(any(k & 511 == d for k in got) for d in range(6))


def test_integration_scale_hysteresis(spark):
    z = spark.createDataFrame([(1.6, -1), (1.6, 0), (1.9, 0), (1.2, 1), (9.0, 2), (5.8, 3)], "r double, last int")
    got = [r[0] for r in z.select(scalars.integration_scale(F.col("r"), 1.0, 1.0, F.col("last"))).collect()]
    assert got == [1, 0, 1, 0, 3, 3]


def test_slerp(spark):
    a, b = scalars.yaw_quaternion(F.lit(0.2)), scalars.yaw_quaternion(F.lit(1.0))
    q = spark.range(1).select(*scalars.slerp(a, b, F.lit(0.25))).first()
    assert math.isclose(2 * math.atan2(q[2], q[3]), 0.4, abs_tol=1e-9)


def test_transform_and_inverse(spark):
    q, t = tuple(scalars.yaw_quaternion(F.lit(0.7))), (F.lit(1.0), F.lit(2.0), F.lit(3.0))
    p = tuple(F.lit(v) for v in (0.3, -0.4, 0.5))
    got = spark.range(1).select(*geometry.inverse_transform(q, t, geometry.transform(q, t, p))).first()
    assert np.allclose(got, (0.3, -0.4, 0.5))


def test_every_marching_case_closes():
    for case in range(256):
        edges = [tuple(sorted(p)) for t in meshing.triangles_of(case) for p in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))]
        inside = [case >> i & 1 for i in range(8)]
        crossed = {k for k, (i, j) in enumerate(meshing.EDGES) if inside[i] != inside[j]}
        assert {v for e in edges for v in e} == crossed
        # sides within the cell are shared by two triangles; the others lie on its faces
        assert all(edges.count(e) in (1, 2) for e in edges)


def test_nearest_at_edges(spark):
    a = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, 99.0)], "frame long, t double")
    b = spark.createDataFrame([(7, 2.0), (8, 8.0), (9, 12.0)], "other long, t double")
    got = {r["frame"]: r["other"] for r in association.nearest(a, b, "t", ["other"], 3.0).collect()}
    assert got == {1: 7, 2: 8}
    assert association.nearest(a, b.limit(0), "t", ["other"], 3.0).count() == 0


def test_components(spark):
    from cairn.sources.scratch import Scratch

    pixels = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (0, 3, 0), (0, 1, 1), (0, 3, 1), (0, 2, 2), (0, 3, 2), (0, 9, 9)], "frame int, u long, v long")
    got = {(r["u"], r["v"]): r["component"] for r in images.components(pixels, ["frame"], Scratch(spark, "components")).collect()}
    assert len({got[p] for p in ((0, 0), (1, 0), (1, 1))}) == 1 and len({got[p] for p in ((3, 0), (3, 1), (3, 2), (2, 2))}) == 1
    assert len(set(got.values())) == 3


def test_tracking_recovers_a_shift(spark):
    camera = geometry.Pinhole(width=32, height=24, fx=30.0, fy=30.0, cx=15.5, cy=11.5)
    depth = [(u, v, 2.0 + 0.2 * math.sin(u / 4.0) + 0.15 * math.cos(v / 3.0)) for u in range(32) for v in range(24)]
    image = spark.createDataFrame(depth, "u long, v long, depth double")
    p = camera.back_project(F.col("u"), F.col("v"), F.col("depth"))
    reference = image.select("u", "v", *[c.alias("p" + k) for k, c in zip("xyz", p)]).join(images.normals(image, camera), ["u", "v"]).cache()
    live = reference.withColumn("pz", F.col("pz") + 0.02).withColumn("px", F.col("px") - 0.01)
    pose, rmse, share = tracking.track(live, reference, camera, 6)
    assert tracking.accepted(rmse, share) and abs(pose[2, 3] + 0.02) < 0.01
