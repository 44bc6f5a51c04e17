"""Queries over sequences of depth images taken from moving and turning cameras: pooling, carving, ray allocation, projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import morton
from ..functions.geometry import Pinhole, norm, rotate
from ..operators import carving, integration
from .relations import key_sql, relation, sql

CAMERA = Pinhole(64, 64, 60.0, 60.0, 31.5, 31.5, 0.3, 6.0)
DEPTH, DIM, SIGMA3, TAU = 7, 0.05, 0.13, 0.17


def _poses(spark, sf_dir):
    """A pose for each frame: the camera turns about the vertical and a little about its axis, and moves."""
    a = F.col("frame") % 7 * 0.071 - 0.2
    q = F.array(F.lit(0.0), F.sin(a / 2) * 0.96, F.sin(a / 2) * 0.28, F.cos(a / 2))
    t = F.array(3.2137 + 0.031 * (F.col("frame") % 5), F.lit(3.1771), 0.2131 + 0.0173 * (F.col("frame") % 3))
    return relation(spark, sf_dir, "shots").select("frame").distinct().withColumns({"q": q, "t": t})


def pooled_boxes(spark, sf_dir):
    """Pixel boxes of all sizes, one for each pixel with depth, against the depths in them."""
    depths = relation(spark, sf_dir, "depths")
    pool = carving.pooled(depths, 64, 64, ["frame"])
    end = lambda c, n: F.least(F.col(c) + (F.col("u") * 7 + F.col("v") * 3) % n, F.lit(63))
    boxes = depths.select("frame", "u", "v", F.col("u").alias("u0"), F.col("v").alias("v0"), end("u", 23).alias("u1"), end("v", 9).alias("v1"))
    return carving.pool_boxes(boxes, pool, 64, 64, ["frame"], ["u", "v"])


def carved_octants(spark, sf_dir):
    """What each frame frees and updates in a map of 128 voxels along each edge."""
    found = carving.carve(_poses(spark, sf_dir), relation(spark, sf_dir, "depths"), CAMERA, DIM, DEPTH, SIGMA3, TAU)
    return found.withColumn("depth", morton.depth(F.col("key")))


def _points(spark, sf_dir):
    """Rays of pixels with depth: camera, unit direction, depth and range, in the map."""
    r = CAMERA.ray(F.col("u"), F.col("v"))
    seen = relation(spark, sf_dir, "depths").where("depth >= 0.3").join(_poses(spark, sf_dir), "frame").withColumn("n", norm(r))
    d = rotate([F.col("q")[i] for i in range(4)], [c / F.col("n") for c in r])
    return seen.select("frame", *[F.col("t")[i].alias("o" + k) for i, k in enumerate("xyz")], *[c.alias("d" + k) for c, k in zip(d, "xyz")], "depth", (F.col("depth") * F.col("n")).alias("range"))


def ray_allocation(spark, sf_dir):
    keys = carving.ray_octants(_points(spark, sf_dir), DIM, DEPTH, 0.01, 0.03, 0.15, 3.1)
    return keys.withColumn("depth", morton.depth(F.col("key")))


def turned_projection(spark, sf_dir):
    """Voxels in which points of the frames lie, projected into the frame with its pose."""
    p = [F.col(f"o{k}") + F.col(f"d{k}") * (F.col("range") - 0.04) for k in "xyz"]
    voxels = _points(spark, sf_dir).select("frame", *[F.floor(c / DIM).cast("long").alias(k) for c, k in zip(p, "xyz")]).distinct().join(_poses(spark, sf_dir), "frame")
    image = relation(spark, sf_dir, "depths").withColumn("gray", (F.col("u") * 3 + F.col("v")) % 256)
    seen = integration.project_voxels(voxels, image, CAMERA, [F.col("t")[i] for i in range(3)], DIM, ("frame",), [F.col("q")[i] for i in range(4)], ("gray",))
    return seen.select("frame", "x", "y", "z", "u", "v", "gray", F.round("sdf", 6).alias("sdf"))


QUERIES = {f.__name__: f for f in (pooled_boxes, carved_octants, ray_allocation, turned_projection)}

_A = "((frame % 7) * 0.071e0 - 0.2e0)"
_POSES = f"""poses AS (SELECT *, qx * qx + qy * qy + qz * qz + qw * qw AS q1 FROM (SELECT DISTINCT frame, 0e0 AS qx, sin({_A} / 2) * 0.96e0 AS qy, sin({_A} / 2) * 0.28e0 AS qz, cos({_A} / 2) AS qw,
  3.2137e0 + 0.031e0 * (frame % 5) AS tx, 3.1771e0 AS ty, 0.2131e0 + 0.0173e0 * (frame % 3) AS tz FROM shots))"""


def _turned(p: list[str], sign: int) -> list[str]:
    """A vector turned by the pose's quaternion (sign 1) or back, by its rotation matrix."""
    x, y, z, w = "qx", "qy", "qz", f"({sign} * qw)"
    m = [[f"(1 - 2 * ({y} * {y} + {z} * {z}))", f"(2 * ({x} * {y} - {z} * {w}))", f"(2 * ({x} * {z} + {y} * {w}))"],
         [f"(2 * ({x} * {y} + {z} * {w}))", f"(1 - 2 * ({x} * {x} + {z} * {z}))", f"(2 * ({y} * {z} - {x} * {w}))"],
         [f"(2 * ({x} * {z} - {y} * {w}))", f"(2 * ({y} * {z} + {x} * {w}))", f"(1 - 2 * ({x} * {x} + {y} * {y}))"]]
    return ["(" + " + ".join(f"{a} * ({c})" for a, c in zip(row, p)) + ")" for row in m]


_BLOCKS = DEPTH - 3
_CX, _CY, _CZ = _turned(["x * 5e-2 + a * s - tx", "y * 5e-2 + b * s - ty", "z * 5e-2 + c * s - tz"], -1)
_MX, _MY, _MZ = _turned(["x * 5e-2 + s / 2 - tx", "y * 5e-2 + s / 2 - ty", "z * 5e-2 + s / 2 - tz"], -1)
_R = "s * sqrt(3e0) / 2"
_SIDES = " AND ".join(
    f"(({nx}) * mx + ({ny}) * my + ({nz}) * mz) / sqrt(pow({nx}, 2) + pow({ny}, 2) + pow({nz}, 2)) >= -({_R})"
    for nx, ny, nz in (("1e0", "0e0", "32e0 / 60"), ("-1e0", "0e0", "32e0 / 60"), ("0e0", "1e0", "32e0 / 60"), ("0e0", "-1e0", "32e0 / 60"))
)
_DIRS = _turned(["(u - 31.5e0) / 60 / n", "(v - 31.5e0) / 60 / n", "1 / n"], 1)
_RAYS = f"""rays AS (SELECT frame, tx AS ox, ty AS oy, tz AS oz, {', '.join(f'{d} AS d{k}' for d, k in zip(_DIRS, 'xyz'))}, depth, depth * n AS reach FROM (
  SELECT *, sqrt(pow((u - 31.5e0) / 60, 2) + pow((v - 31.5e0) / 60, 2) + 1) AS n FROM depths WHERE depth >= 0.3e0) JOIN poses USING (frame))"""
ORACLE = {
    "pooled_boxes": f"""{sql('depths')} SELECT a.frame, a.u, a.v, min(CASE WHEN b.depth > 0 THEN b.depth END) AS low, max(CASE WHEN b.depth > 0 THEN b.depth END) AS high,
      CASE WHEN count(*) FILTER (b.depth > 0) = 0 THEN 'none' WHEN count(*) FILTER (b.depth > 0) = (least(a.u + (a.u * 7 + a.v * 3) % 23, 63) - a.u + 1) * (least(a.v + (a.u * 7 + a.v * 3) % 9, 63) - a.v + 1) THEN 'all' ELSE 'part' END AS known
      FROM depths a JOIN depths b ON a.frame = b.frame AND b.u BETWEEN a.u AND least(a.u + (a.u * 7 + a.v * 3) % 23, 63) AND b.v BETWEEN a.v AND least(a.v + (a.u * 7 + a.v * 3) % 9, 63) GROUP BY a.frame, a.u, a.v""",
    # every octant of every depth is judged by itself; then those count whose ancestors are all split
    "carved_octants": f"""{sql('depths')}, {_POSES}, octants AS (SELECT d, i * {1 << DEPTH} // (1 << d) AS x, j * {1 << DEPTH} // (1 << d) AS y, k * {1 << DEPTH} // (1 << d) AS z, ({1 << DEPTH} >> d) * 5e-2 AS s FROM
        (SELECT unnest(range({_BLOCKS + 1})) AS d), (SELECT unnest(range({1 << _BLOCKS})) AS i), (SELECT unnest(range({1 << _BLOCKS})) AS j), (SELECT unnest(range({1 << _BLOCKS})) AS k) WHERE greatest(i, j, k) < 1 << d),
      corners AS (SELECT frame, d, x, y, z, s, tx, ty, tz, {_MX} AS mx, {_MY} AS my, {_MZ} AS mz, {_CX} AS cx, {_CY} AS cy, {_CZ} AS cz FROM octants, poses, (VALUES (0), (1)) i(a), (VALUES (0), (1)) j(b), (VALUES (0), (1)) k(c)),
      shapes AS (SELECT frame, d, x, y, z, s, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz, min(cz) AS z0, max(cz) AS z1, count(*) FILTER (cz >= 0.3e0) AS front,
        bool_or(cz >= 0.3e0 AND 60 * cx / cz + 31.5e0 BETWEEN -0.5e0 AND 63.499999999e0 AND 60 * cy / cz + 31.5e0 BETWEEN -0.5e0 AND 63.499999999e0) AS seen,
        bool_or(tx >= x * 5e-2 AND tx < x * 5e-2 + s AND ty >= y * 5e-2 AND ty < y * 5e-2 + s AND tz >= z * 5e-2 AND tz < z * 5e-2 + s) AS holds,
        floor(min(60 * cx / cz + 31.5e0) FILTER (cz >= 0.3e0)) AS u0, floor(max(60 * cx / cz + 31.5e0) FILTER (cz >= 0.3e0)) AS u1, floor(min(60 * cy / cz + 31.5e0) FILTER (cz >= 0.3e0)) AS v0, floor(max(60 * cy / cz + 31.5e0) FILTER (cz >= 0.3e0)) AS v1
        FROM corners GROUP BY frame, d, x, y, z, s),
      boxes AS (SELECT *, mz - {_R} > 6 OR mz + {_R} < 0.3e0 OR front = 0 AS away, u0 < 0 OR v0 < 0 OR u1 > 63 OR v1 > 63 AS crossing, (least(u1, 63) - greatest(u0, 0) + 1) * (least(v1, 63) - greatest(v0, 0) + 1) AS n FROM shapes),
      pooled AS (SELECT b.frame, d, x, y, z, min(depth) AS low, max(depth) AS high, count(*) AS m FROM boxes b JOIN depths p ON b.frame = p.frame AND p.u BETWEEN u0 AND u1 AND p.v BETWEEN v0 AND v1 WHERE NOT away AND front = 8 AND depth > 0 GROUP BY ALL),
      judged AS (SELECT b.*, m, CASE WHEN away OR front < 8 OR m IS NULL THEN NULL WHEN z0 - high > 1.25e0 * {TAU}e0 THEN 1 WHEN z1 - low < -1.25e0 * {SIGMA3}e0 THEN -1 ELSE 0 END AS variance, low, high FROM boxes b LEFT JOIN pooled USING (frame, d, x, y, z)),
      told AS (SELECT *, CASE WHEN away THEN 'skip' WHEN front < 8 THEN CASE WHEN holds OR seen OR mz - 0.3e0 >= -({_R}) AND {_SIDES} THEN 'split' ELSE 'skip' END WHEN m IS NULL OR z0 > high + {TAU}e0 THEN 'skip' WHEN crossing OR m < n OR variance = 0 THEN 'split' WHEN variance < 0 THEN 'free' ELSE 'skip' END AS decision FROM judged),
      reached AS (SELECT t.* FROM told t WHERE NOT EXISTS (SELECT 1 FROM told a WHERE a.frame = t.frame AND a.d < t.d AND a.x = t.x - t.x % ({1 << DEPTH} >> a.d) AND a.y = t.y - t.y % ({1 << DEPTH} >> a.d) AND a.z = t.z - t.z % ({1 << DEPTH} >> a.d) AND a.decision <> 'split'))
      SELECT frame, CASE d {' '.join(f"WHEN {d} THEN {key_sql('x', 'y', 'z', d, DEPTH)}" for d in range(_BLOCKS + 1))} END AS key, CASE decision WHEN 'split' THEN 'update' ELSE decision END AS decision, variance AS low_variance, coalesce(m = n AND NOT away AND front = 8, false) AS inside, CAST(d AS BIGINT) AS depth
      FROM reached WHERE decision = 'free' OR decision = 'split' AND d = {_BLOCKS}""",
    # each ray is walked step by step
    "ray_allocation": f"""{sql('depths')}, {_POSES}, {_RAYS}, bands AS (SELECT *, greatest(0.03e0, least(0.15e0, 0.01e0 * least(depth, 3.1e0) * least(depth, 3.1e0))) AS sg FROM rays),
      walk AS (SELECT *, reach * least(1, 3.1e0 / depth) + sg AS far, 0 AS back, 0 AS coarse FROM bands
        UNION ALL SELECT frame, ox, oy, oz, dx, dy, dz, depth, reach, sg, far, back + CASE WHEN back * 5e-2 < 2 * sg THEN 1 WHEN back * 5e-2 < 3 * sg THEN 10 ELSE 30 END, CASE WHEN back * 5e-2 < 2 * sg THEN 0 WHEN back * 5e-2 < 3 * sg THEN 4 ELSE 5 END FROM walk
        WHERE (back + CASE WHEN back * 5e-2 < 2 * sg THEN 1 WHEN back * 5e-2 < 3 * sg THEN 10 ELSE 30 END) * 5e-2 < far),
      cells AS (SELECT CAST(floor((ox + dx * (far - back * 5e-2)) / 5e-2) AS BIGINT) AS x, CAST(floor((oy + dy * (far - back * 5e-2)) / 5e-2) AS BIGINT) AS y, CAST(floor((oz + dz * (far - back * 5e-2)) / 5e-2) AS BIGINT) AS z, least({DEPTH} - coarse, {_BLOCKS}) AS d FROM walk)
      SELECT DISTINCT CASE d {' '.join(f"WHEN {d} THEN {key_sql('x', 'y', 'z', d, DEPTH)}" for d in (2, 3, 4))} END AS key, CAST(d AS BIGINT) AS depth FROM cells WHERE least(x, y, z) >= 0 AND greatest(x, y, z) < {1 << DEPTH}""",
    "turned_projection": f"""{sql('depths')}, {_POSES}, {_RAYS}, cells AS (SELECT DISTINCT frame, {', '.join(f'CAST(floor((o{k} + d{k} * (reach - 0.04e0)) / 5e-2) AS BIGINT) AS {k}' for k in 'xyz')} FROM rays),
      placed AS (SELECT frame, x, y, z, {', '.join(f'{c} AS c{k}' for c, k in zip(_turned(['(x + 0.5e0) * 5e-2 - tx', '(y + 0.5e0) * 5e-2 - ty', '(z + 0.5e0) * 5e-2 - tz'], -1), 'xyz'))} FROM cells JOIN poses USING (frame)),
      pixels AS (SELECT *, CAST(floor(60 * cx / cz + 32) AS BIGINT) AS u, CAST(floor(60 * cy / cz + 32) AS BIGINT) AS v FROM placed WHERE cz > 0)
      SELECT frame, x, y, z, u, v, (u * 3 + v) % 256 AS gray, round((depth - cz) / cz * sqrt(cx * cx + cy * cy + cz * cz), 6) AS sdf FROM pixels JOIN depths USING (frame, u, v) WHERE depth > 0""",
}
