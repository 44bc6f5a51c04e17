"""Queries over voxels: fusion, pyramids, lookups, frontiers, volumes, rays."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import morton
from ..operators import frontiers, fusion, lookup, meshing, pyramid, views
from .relations import key_sql, relation, sql

DEPTH = 5
EDGE = 32
ORDER = ["ts", "o1", "frame", "o2", "o3", "o4"]
XYZ = ["x", "y", "z"]


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def tsdf_fusion(spark, sf_dir):
    return _rounded(_named(fusion.fuse_tsdf(_apart(relation(spark, sf_dir, "dense")), ["vx", "vy", "vz"], ORDER, "tsdf", 3.0)), "value", digits=9)


def _apart(df):
    return df.withColumnsRenamed({"x": "vx", "y": "vy", "z": "vz"})


def _named(df):
    return df.withColumnsRenamed({"x": "value", "y": "weight"})


def mean_fusion(spark, sf_dir):
    return _rounded(_named(fusion.fuse_mean(_apart(relation(spark, sf_dir, "dense")), ["vx", "vy", "vz"], ORDER, "sample", 3.0)), "value", digits=11)


def log_odds_fusion(spark, sf_dir):
    seen = _apart(relation(spark, sf_dir, "dense")).withColumn("p", (F.col("tsdf") + 1) / 2).withColumn("t", F.datediff(F.col("ts").cast("date"), F.lit("1992-01-01").cast("date")) / 30.0)
    return _rounded(_named(fusion.fuse_log_odds(seen, ["vx", "vy", "vz"], ["ts", "t", "o1", "frame", "o2", "o3", "o4"], "p", "t")), "value", "weight", digits=9)


def _leaves(spark, sf_dir):
    return relation(spark, sf_dir, "voxels").withColumns({"scale": F.lit(0), "observed": F.lit(True), "frontier": F.col("value") < -4.5})


def pyramid_levels(spark, sf_dir):
    up = pyramid.coarser(_leaves(spark, sf_dir))
    return _rounded(up.select("x", "y", "z", "value", "weight", "max_value", "max_weight", "observed", "frontier", "children"), "value", digits=7)


def propagate_to_root(spark, sf_dir):
    blocks = _leaves(spark, sf_dir).groupBy(*[(F.col(k) - F.col(k) % 8).alias(k) for k in XYZ]).agg(F.max("value").alias("value"), F.lit(1.0).alias("weight"), F.lit(True).alias("observed"), F.max("frontier").alias("frontier")).withColumn("scale", F.lit(3))
    return _rounded(pyramid.propagate_to_root(blocks, DEPTH, -15.0).select("x", "y", "z", "scale", "value", "observed", "frontier", "pruned"), "value")


def _octants(spark, sf_dir):
    """Blocks' means at depth 2, their parents' at depth 1 and the root's, where enough voxels are known."""
    v = relation(spark, sf_dir, "voxels")
    levels = [v.groupBy(morton.encode(F.col("x"), F.col("y"), F.col("z"), d, DEPTH).alias("key")).agg(F.avg("value").alias("value"), F.count("*").cast("double").alias("weight")) for d in (0, 1, 2)]
    return levels[0].unionByName(levels[1]).unionByName(levels[2].where("weight > 380"))


def _probes(spark, sf_dir):
    return relation(spark, sf_dir, "dense").groupBy("o1").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.max("z").alias("z")).withColumnRenamed("o1", "probe")


def point_lookup(spark, sf_dir):
    return _rounded(lookup.lookup(_probes(spark, sf_dir), _octants(spark, sf_dir), DEPTH, 2), "value")


def threshold_lookup(spark, sf_dir):
    return _rounded(lookup.lookup(_probes(spark, sf_dir), _octants(spark, sf_dir), DEPTH, 2, choose="coarsest", threshold=-600.0), "value")


def face_neighbours(spark, sf_dir):
    return lookup.neighbours(relation(spark, sf_dir, "voxels"), EDGE)


def _places(spark, sf_dir):
    return _probes(spark, sf_dir).select("probe", *[(F.col(k) + (F.col("probe") % (7 + i)) / (7.0 + i)).alias("p" + k) for i, k in enumerate(XYZ)])


def interpolation(spark, sf_dir):
    return _rounded(lookup.interpolate(_places(spark, sf_dir), relation(spark, sf_dir, "voxels"), "probe"), "value")


def gradients(spark, sf_dir):
    return _rounded(lookup.gradient(_places(spark, sf_dir), relation(spark, sf_dir, "voxels"), 0.05, "probe"), "gx", "gy", "gz", digits=4)


def frontier_voxels(spark, sf_dir):
    return frontiers.frontier_voxels(relation(spark, sf_dir, "voxels"), EDGE)


def frontier_blocks(spark, sf_dir):
    return frontiers.frontier_blocks(relation(spark, sf_dir, "voxels"), DEPTH, 0.2)


def explored_volume(spark, sf_dir):
    leaves = relation(spark, sf_dir, "voxels").withColumn("size", F.lit(1))
    return _rounded(frontiers.explored_volume(leaves, (0.12, 0.12, 0.12), (1.23, 1.1, 0.9), 0.05), "explored", "free", "occupied")


def structure(spark, sf_dir):
    v = relation(spark, sf_dir, "voxels")
    blocks = v.groupBy(*[(F.col(k) - F.col(k) % 8).alias(k) for k in XYZ]).agg(F.count("*").alias("n"))
    return blocks.groupBy(F.when(F.col("n") >= 400, 0).when(F.col("n") >= 350, 1).when(F.col("n") >= 100, 2).otherwise(3).alias("scale")).agg(F.count("*").alias("blocks"), F.sum("n").alias("voxels"))


def box_status(spark, sf_dir):
    boxes = _probes(spark, sf_dir).select(F.col("probe").alias("box"), "x", "y", "z", *[F.lit(n).alias("n" + k) for k, n in zip(XYZ, (2, 1, 2))])
    return frontiers.box_status(boxes, None, relation(spark, sf_dir, "voxels"), EDGE)


def sphere_free(spark, sf_dir):
    spheres = _places(spark, sf_dir).select(F.col("probe").alias("sphere"), *[F.col("p" + k).alias(k) for k in XYZ], F.lit(1.2).alias("radius"))
    return frontiers.sphere_free(spheres, relation(spark, sf_dir, "voxels"))


def _rays(spark, sf_dir):
    return _probes(spark, sf_dir).select(F.col("probe").alias("ray"), *[(F.col(k) + 0.5).alias("o" + k) for k in XYZ], F.lit(0.6).alias("dx"), F.lit(-0.48).alias("dy"), F.lit(0.64).alias("dz"))


def ray_hits(spark, sf_dir):
    return _rounded(lookup.path_hits(_rays(spark, sf_dir), relation(spark, sf_dir, "voxels"), 0.0, 24, 0.5, "ray"), "t")


def ray_entropy(spark, sf_dir):
    return _rounded(views.ray_entropy(_rays(spark, sf_dir), relation(spark, sf_dir, "voxels"), 1.0, 13.0, 1.0, EDGE, ["ray"]), "entropy")


def best_yaw(spark, sf_dir):
    image = relation(spark, sf_dir, "points").groupBy(F.col("frame"), F.col("x").alias("u"), (F.col("y") % 10).alias("v")).agg(F.avg("z").alias("entropy"))
    fov = 2 * math.pi * 13 / 64
    return _rounded(views.best_yaw(views.yaw_windows(image, 64, fov, ["frame"]), 64, fov, ["frame"]), "mean", "yaw")


def mesh(spark, sf_dir):
    triangles = meshing.marching_cubes(relation(spark, sf_dir, "voxels"))
    return _rounded(triangles.groupBy("x", "y", "z").agg((F.max("triangle") + 1).alias("triangles"), F.count("*").alias("vertices"), F.avg("vx").alias("vx"), F.avg("vy").alias("vy"), F.avg("vz").alias("vz")), "vx", "vy", "vz")


QUERIES = {f.__name__: f for f in (tsdf_fusion, mean_fusion, log_odds_fusion, pyramid_levels, propagate_to_root, point_lookup, threshold_lookup, face_neighbours, interpolation, gradients, frontier_voxels, frontier_blocks, explored_volume, structure, box_status, sphere_free, ray_hits, ray_entropy, best_yaw, mesh)}

_V = sql("voxels")
_BY = "ts, o1, frame, o2, o3, o4"


_PROBES = "probes AS (SELECT o1 AS probe, min(x) AS x, max(y) AS y, max(z) AS z FROM dense GROUP BY o1)"
_OCT = "oct AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT {d} AS d, x - x % {32 >> d} AS x, y - y % {32 >> d} AS y, z - z % {32 >> d} AS z, avg(value) AS value, CAST(count(*) AS DOUBLE) AS weight FROM voxels GROUP BY ALL" for d in range(3)) + ") WHERE d < 2 OR weight > 380)"
_HOLDS = "o.x = p.x - p.x % (32 >> o.d) AND o.y = p.y - p.y % (32 >> o.d) AND o.z = p.z - p.z % (32 >> o.d)"
_PLACES = "places AS (SELECT probe, x + (probe % 7) / 7e0 AS px, y + (probe % 8) / 8e0 AS py, z + (probe % 9) / 9e0 AS pz FROM probes)"
_RAYS = "rays AS (SELECT probe AS ray, x + 0.5e0 AS ox, y + 0.5e0 AS oy, z + 0.5e0 AS oz FROM probes)"
_CORNER = "CROSS JOIN (VALUES (0), (1)) i(i) CROSS JOIN (VALUES (0), (1)) j(j) CROSS JOIN (VALUES (0), (1)) k(k)"
_B = {c: f"floor(p{c} - 0.5e0)" for c in "xyz"}
_W = " * ".join(f"CASE {n} WHEN 1 THEN p{c} - 0.5e0 - {_B[c]} ELSE 1 - (p{c} - 0.5e0 - {_B[c]}) END" for c, n in zip("xyz", "ijk"))
_H = "CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE -p * log2(p) - (1 - p) * log2(1 - p) END"
ORACLE = {
    "tsdf_fusion": f"""{sql('dense')}, f AS (SELECT vx, vy, vz, list_reduce(l, lambda s, o: {{'x': greatest(-1, least(1, (s.y * s.x + greatest(-1, least(1, o.x))) / (s.y + 1))), 'y': least(s.y + 1, 3)}}, {{'x': 1e0, 'y': 0e0}}) AS s
      FROM (SELECT x AS vx, y AS vy, z AS vz, list({{'x': tsdf, 'y': 0e0}} ORDER BY {_BY}) AS l FROM dense GROUP BY x, y, z)) SELECT vx, vy, vz, round(s.x, 9) + 0e0 AS value, s.y AS weight FROM f""",
    "mean_fusion": f"""{sql('dense')}, f AS (SELECT vx, vy, vz, len(l) AS n, list_reduce(l, lambda s, o: {{'x': (s.y * s.x + o.x) / (s.y + 1), 'y': least(s.y + 1, 3)}}, {{'x': 0e0, 'y': 0e0}}) AS s
      FROM (SELECT x AS vx, y AS vy, z AS vz, list({{'x': sample, 'y': 0e0}} ORDER BY {_BY}) AS l FROM dense GROUP BY x, y, z)) SELECT vx, vy, vz, round(s.x, 11) + 0e0 AS value, s.y AS weight, CAST(n AS INTEGER) AS n FROM f""",
    "log_odds_fusion": f"""{sql('dense')}, f AS (SELECT vx, vy, vz, list_reduce(l, lambda s, o: CASE WHEN o.x = 0.5e0 THEN s ELSE {{'x': greatest(-100, least(100, s.x * greatest(0.5e0, 1 / (1 + (o.y - s.y) / 4)) + log2(greatest(0.03e0, least(0.97e0, o.x)) / (1 - greatest(0.03e0, least(0.97e0, o.x)))))), 'y': o.y}} END, {{'x': 0e0, 'y': 0e0}}) AS s
      FROM (SELECT x AS vx, y AS vy, z AS vz, list({{'x': (tsdf + 1) / 2, 'y': date_diff('day', DATE '1992-01-01', CAST(ts AS DATE)) / 30e0}} ORDER BY {_BY}) AS l FROM dense GROUP BY x, y, z)) SELECT vx, vy, vz, round(s.x, 9) + 0e0 AS value, round(s.y, 9) + 0e0 AS weight FROM f""",
    "pyramid_levels": f"""{_V}, p AS (SELECT x - x % 2 AS px, y - y % 2 AS py, z - z % 2 AS pz, * FROM voxels), r AS (SELECT *, row_number() OVER (PARTITION BY px, py, pz ORDER BY value * weight DESC, z, y, x) AS n FROM p)
      SELECT px AS x, py AS y, pz AS z, round(avg(value), 7) + 0e0 AS value, CAST(ceil(sum(weight) / count(*)) AS DOUBLE) AS weight, max(CASE WHEN n = 1 THEN value END) AS max_value, max(CASE WHEN n = 1 THEN weight END) AS max_weight, count(*) = 8 AS observed, bool_or(value < -4.5e0) AS frontier, count(*) AS children FROM r GROUP BY px, py, pz""",
    "propagate_to_root": f"""{_V}, b AS (SELECT x - x % 8 AS x, y - y % 8 AS y, z - z % 8 AS z, max(value) AS value, true AS observed, bool_or(value < -4.5e0) AS frontier FROM voxels GROUP BY 1, 2, 3),
      c AS (SELECT x - x % 16 AS x, y - y % 16 AS y, z - z % 16 AS z, max(value) AS value, count(*) = 8 AS observed, bool_or(frontier) AS frontier FROM b GROUP BY 1, 2, 3),
      d AS (SELECT x - x % 32 AS x, y - y % 32 AS y, z - z % 32 AS z, max(value) AS value, count(*) FILTER (observed) = 8 AS observed, bool_or(frontier) AS frontier FROM c GROUP BY 1, 2, 3),
      e AS (SELECT *, 3 AS scale FROM b UNION ALL SELECT *, 4 FROM c UNION ALL SELECT *, 5 FROM d) SELECT x, y, z, scale, round(value, 6) AS value, observed, frontier, observed AND NOT frontier AND value <= -14.25e0 AS pruned FROM e""",
    "point_lookup": f"{_V}, {_PROBES}, {_OCT}, r AS (SELECT p.*, o.d, o.value, o.weight, row_number() OVER (PARTITION BY probe ORDER BY o.d DESC) AS n FROM probes p LEFT JOIN oct o ON {_HOLDS}) SELECT probe, x, y, z, CAST(d AS BIGINT) AS depth, round(value, 6) AS value, weight FROM r WHERE n = 1",
    "threshold_lookup": f"{_V}, {_PROBES}, {_OCT}, r AS (SELECT p.*, o.d, o.value, o.weight, row_number() OVER (PARTITION BY probe ORDER BY CASE WHEN o.value * o.weight <= -600 THEN o.d ELSE 10 - o.d END) AS n FROM probes p LEFT JOIN oct o ON {_HOLDS}) SELECT probe, x, y, z, CAST(d AS BIGINT) AS depth, round(value, 6) AS value, weight FROM r WHERE n = 1",
    "face_neighbours": f"{_V}, m AS (SELECT x, y, z, face, x + dx AS nx, y + dy AS ny, z + dz AS nz FROM voxels, (VALUES (0, -1, 0, 0), (1, 1, 0, 0), (2, 0, -1, 0), (3, 0, 1, 0), (4, 0, 0, -1), (5, 0, 0, 1)) f(face, dx, dy, dz)) SELECT m.x, m.y, m.z, face, v.value, nx BETWEEN 0 AND 31 AND ny BETWEEN 0 AND 31 AND nz BETWEEN 0 AND 31 AS inside FROM m LEFT JOIN voxels v ON v.x = nx AND v.y = ny AND v.z = nz",
    "interpolation": f"{_V}, {_PROBES}, {_PLACES}, c AS (SELECT probe, CAST({_B['x']} + i AS BIGINT) AS x, CAST({_B['y']} + j AS BIGINT) AS y, CAST({_B['z']} + k AS BIGINT) AS z, {_W} AS w FROM places {_CORNER}), s AS (SELECT probe, sum(w * value) AS value, count(value) AS n FROM c LEFT JOIN voxels USING (x, y, z) GROUP BY probe) SELECT probe, CASE WHEN n = 8 THEN round(value, 6) END AS value FROM s",
    "gradients": f"""{_V}, {_PROBES}, {_PLACES}, c AS (SELECT probe, a.a, CAST({_B['x']} + i + CASE WHEN a.a = 0 THEN s.s ELSE 0 END AS BIGINT) AS x, CAST({_B['y']} + j + CASE WHEN a.a = 1 THEN s.s ELSE 0 END AS BIGINT) AS y, CAST({_B['z']} + k + CASE WHEN a.a = 2 THEN s.s ELSE 0 END AS BIGINT) AS z, {_W} * s.s / 0.1e0 AS w
      FROM places {_CORNER} CROSS JOIN (VALUES (0), (1), (2)) a(a) CROSS JOIN (VALUES (-1), (1)) s(s)) SELECT probe, round(sum(CASE WHEN a = 0 THEN w * value END), 4) AS gx, round(sum(CASE WHEN a = 1 THEN w * value END), 4) AS gy, round(sum(CASE WHEN a = 2 THEN w * value END), 4) AS gz FROM c LEFT JOIN voxels USING (x, y, z) GROUP BY probe HAVING count(value) = 48""",
    "frontier_voxels": f"{_V} SELECT x, y, z, value, weight FROM voxels v WHERE value < 0 AND EXISTS (SELECT 1 FROM (VALUES (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)) f(dx, dy, dz) WHERE v.x + dx BETWEEN 0 AND 31 AND v.y + dy BETWEEN 0 AND 31 AND v.z + dz BETWEEN 0 AND 31 AND (v.x + dx, v.y + dy, v.z + dz) NOT IN (SELECT (x, y, z) FROM voxels))",
    "frontier_blocks": f"{_V}, near AS (SELECT DISTINCT v.x, v.y, v.z FROM voxels v, (VALUES (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)) f(dx, dy, dz) WHERE value < 0 AND v.x + dx BETWEEN 0 AND 31 AND v.y + dy BETWEEN 0 AND 31 AND v.z + dz BETWEEN 0 AND 31 AND NOT EXISTS (SELECT 1 FROM voxels w WHERE w.x = v.x + dx AND w.y = v.y + dy AND w.z = v.z + dz)) SELECT {key_sql('x', 'y', 'z', 2, 5)} AS key, count(*) AS volume, count(*) / 512 AS ratio FROM near GROUP BY 1 HAVING count(*) / 512 >= 0.2",
    "explored_volume": f"{_V}, c AS (SELECT value, " + " * ".join(f"greatest(0, least({c} * 5e-2 + 5e-2, {h}e0) - greatest({c} * 5e-2, 0.12e0))" for c, h in zip("xyz", (1.23, 1.1, 0.9))) + " AS v FROM voxels) SELECT round(sum(v), 6) AS explored, round(sum(CASE WHEN value < 0 THEN v ELSE 0 END), 6) AS free, round(sum(CASE WHEN value < 0 THEN 0 ELSE v END), 6) AS occupied FROM c",
    "structure": f"{_V}, b AS (SELECT count(*) AS n FROM voxels GROUP BY x // 8, y // 8, z // 8) SELECT CASE WHEN n >= 400 THEN 0 WHEN n >= 350 THEN 1 WHEN n >= 100 THEN 2 ELSE 3 END AS scale, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS voxels FROM b GROUP BY 1",
    "box_status": f"{_V}, {_PROBES} SELECT probe AS box, CASE WHEN bool_or(coalesce(value > 0, false)) THEN 'occupied' WHEN bool_or(value IS NULL) THEN 'unseen' ELSE 'empty' END AS status FROM (SELECT probe, p.x + i AS x, p.y AS y, p.z + k AS z FROM probes p CROSS JOIN (VALUES (0), (1)) i(i) CROSS JOIN (VALUES (0), (1)) k(k)) c LEFT JOIN voxels v USING (x, y, z) WHERE x < 32 AND z < 32 GROUP BY probe",
    "sphere_free": f"{_V}, {_PROBES}, {_PLACES}, c AS (SELECT probe, CAST(floor(px) + a AS BIGINT) AS x, CAST(floor(py) + b AS BIGINT) AS y, CAST(floor(pz) + c AS BIGINT) AS z FROM places, (SELECT unnest(range(-3, 4)) AS a), (SELECT unnest(range(-3, 4)) AS b), (SELECT unnest(range(-3, 4)) AS c) WHERE pow(floor(px) + a + 0.5e0 - px, 2) + pow(floor(py) + b + 0.5e0 - py, 2) + pow(floor(pz) + c + 0.5e0 - pz, 2) <= 1.2e0 * 1.2e0) SELECT probe AS sphere, bool_and(coalesce(value < 0, false)) AS free, count(*) AS cells FROM c LEFT JOIN voxels USING (x, y, z) GROUP BY probe",
    "ray_hits": f"{_V}, {_PROBES}, {_RAYS}, s AS (SELECT ray, i, value, lag(value) OVER (PARTITION BY ray ORDER BY i) AS before FROM (SELECT ray, i, CAST(floor(ox + 0.6e0 * i * 0.5e0) AS BIGINT) AS x, CAST(floor(oy + -0.48e0 * i * 0.5e0) AS BIGINT) AS y, CAST(floor(oz + 0.64e0 * i * 0.5e0) AS BIGINT) AS z FROM rays, (SELECT unnest(range(0, 25)) AS i)) c LEFT JOIN voxels USING (x, y, z)), f AS (SELECT ray, min(i) AS i FROM s WHERE before <= 0 AND value > 0 GROUP BY ray) SELECT rays.ray, round((f.i - 1 + (0 - before) / (value - before)) * 0.5e0, 6) AS t FROM rays LEFT JOIN f USING (ray) LEFT JOIN s ON s.ray = f.ray AND s.i = f.i",
    "ray_entropy": f"{_V}, {_PROBES}, {_RAYS}, c AS (SELECT ray, i, CAST(floor(ox + 0.6e0 * (1 + i)) AS BIGINT) AS x, CAST(floor(oy + -0.48e0 * (1 + i)) AS BIGINT) AS y, CAST(floor(oz + 0.64e0 * (1 + i)) AS BIGINT) AS z FROM rays, (SELECT unnest(range(0, 12)) AS i)), s AS (SELECT ray, i, NOT (x BETWEEN 0 AND 31 AND y BETWEEN 0 AND 31 AND z BETWEEN 0 AND 31) AS gone, coalesce(value * weight, 0) AS l FROM c LEFT JOIN voxels USING (x, y, z)), e AS (SELECT ray, min(i) FILTER (gone) AS leave, min(i) FILTER (l > 0) AS hit FROM s GROUP BY ray), h AS (SELECT s.ray, CASE WHEN l <= -100 THEN 0 WHEN l >= 100 THEN 1 ELSE pow(2, l) / (1 + pow(2, l)) END AS p FROM s JOIN e USING (ray) WHERE i < coalesce(leave, 99) AND i <= coalesce(hit, 99)) SELECT rays.ray, round(coalesce(sum({_H}), 0) / 12, 6) AS entropy FROM rays LEFT JOIN h USING (ray) GROUP BY rays.ray",
    # the cases' triangles are those that test_functions.py holds against the rules of a closed surface
    "mesh": f"""{_V}, corners AS (SELECT x - dx AS x, y - dy AS y, z - dz AS z, i, value FROM voxels, (VALUES {", ".join(str((i, *c)) for i, c in enumerate(meshing.CORNERS))}) c(i, dx, dy, dz)),
      closed AS (SELECT x, y, z, list(value ORDER BY i) AS v, sum(CASE WHEN value < 0 THEN 1 << i ELSE 0 END) AS case_of FROM corners GROUP BY x, y, z HAVING count(value) = 8),
      edges AS (SELECT * FROM (VALUES {", ".join(str((k, a, b, *meshing.CORNERS[a], *(q - p for p, q in zip(meshing.CORNERS[a], meshing.CORNERS[b])))) for k, (a, b) in enumerate(meshing.EDGES))}) e(edge, a, b, x0, y0, z0, lx, ly, lz)),
      cases AS (SELECT * FROM (VALUES {", ".join(str((c, k, e)) for c in range(256) for k, t in enumerate(meshing.triangles_of(c)) for e in t)}) t(case_of, triangle, edge)),
      vertices AS (SELECT x, y, z, triangle, e.*, (0 - v[a + 1]) / (v[b + 1] - v[a + 1]) AS t FROM closed JOIN cases USING (case_of) JOIN edges e USING (edge))
      SELECT x, y, z, max(triangle) + 1 AS triangles, count(*) AS vertices, round(avg(x + x0 + lx * t), 6) AS vx, round(avg(y + y0 + ly * t), 6) AS vy, round(avg(z + z0 + lz * t), 6) AS vz FROM vertices GROUP BY x, y, z""",
    "best_yaw": f"{sql('points')}, im AS (SELECT frame, x AS u, y % 10 AS v, avg(z) AS e FROM points GROUP BY 1, 2, 3), w AS (SELECT frame, (u - i + 64) % 64 AS start, avg(e) AS mean FROM im, (SELECT unnest(range(0, 13)) AS i) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY round(mean, 9) DESC, start) AS n FROM w) SELECT frame, start, round(mean, 6) AS mean, round(pi() - 2 * pi() * (start + 0.5e0) / 64 - pi() * 13 / 64, 6) AS yaw FROM r WHERE n = 1",
}
