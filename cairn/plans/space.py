"""Queries over integration of frames, frustums, bounds, histories and the functions behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, scalars
from ..operators import association, detections, histories, integration, views
from .relations import relation, sql
from .scenes import CAMERA

VOXEL = 0.2
CENTRE = (3.2, 3.2, 0.0)
BAND = 0.8


def _r(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def integrate_frame(spark, sf_dir):
    """A depth image over all voxels of the map."""
    image = relation(spark, sf_dir, "image")
    voxels = relation(spark, sf_dir, "voxels").select("x", "y", "z", "value", "weight")
    seen = integration.project_voxels(voxels, image, CAMERA, CENTRE, VOXEL)
    return _r(integration.update_tsdf(seen, BAND, 100.0).select("x", "y", "z", "sdf", "value", "weight"), 8, "sdf", "value")


def integrate_occupancy(spark, sf_dir):
    """The same with the inverse sensor model, as log-odds."""
    image = relation(spark, sf_dir, "image")
    seen = integration.project_voxels(relation(spark, sf_dir, "voxels"), image, CAMERA, CENTRE, VOXEL)
    return _r(integration.update_occupancy(seen, 0.05, 0.1, 0.5, 0.05, 0.1, 0.6, 20.0).select("x", "y", "z", "sample", "value", "weight"), 8, "sample", "value")


def reprojection(spark, sf_dir):
    """Points of a depth image and back to pixels and depths."""
    i = relation(spark, sf_dir, "image")
    p = CAMERA.back_project(F.col("u"), F.col("v"), F.col("depth"))
    u, v, seen = CAMERA.project(p)
    return _r(i.select("u", "v", u.alias("pu"), v.alias("pv"), seen.alias("seen"), p[2].alias("depth")), 8, "depth")


def frustum_tests(spark, sf_dir):
    """Boxes, rays and distances against a camera's frustum."""
    i = relation(spark, sf_dir, "image")
    p = [(F.col("u") - 32) / 10 + 0.0137, (F.col("v") - 32) / 10 + 0.0137, F.col("depth")]  # off the planes
    high = [c + 0.4 for c in p]
    ray = CAMERA.ray(F.col("u"), F.col("v"))
    out = i.select("u", "v", CAMERA.box_in_frustum(p, high).alias("box"), CAMERA.box_in_frustum(p, high, True).alias("endless_box"), CAMERA.point_in_frustum(p, True).alias("endless_point"), CAMERA.ray_in_frustum(p).alias("ray"), CAMERA.near_distance(ray).alias("near"), CAMERA.far_distance(ray).alias("far"))
    return _r(out, 8, "near", "far")


def ray_image(spark, sf_dir):
    """Unit rays of an image of 360 degrees."""
    return _r(views.ray_grid(36, 10, 1.2, spark).select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), "dx", "dy", "dz"), 9, "dx", "dy", "dz")


def map_bounds(spark, sf_dir):
    """Bounds and bounding sphere of each frame's voxels."""
    p = relation(spark, sf_dir, "points")
    box = integration.bounds(p, ["frame"], ["x", "y", "z"])
    return _r(integration.bounding_spheres(box, ["x", "y", "z"]).drop("n"), 8, "radius")


def merged_spheres(spark, sf_dir):
    """Each frame's sphere merged with that of the frame before."""
    p = relation(spark, sf_dir, "points").withColumn("x", F.col("x") + F.col("frame") * 20)
    s = integration.bounding_spheres(integration.bounds(p, ["frame"], ["x", "y", "z"]), ["x", "y", "z"])
    a, b = ([F.col(f"{t}.{c}") for c in ("centre_x", "centre_y", "centre_z", "radius")] for t in "ab")
    both = s.alias("a").join(s.alias("b"), F.col("b.frame") == F.col("a.frame") + 1)
    m = geometry.merge_spheres(a[:3], a[3], b[:3], b[3])
    return _r(both.select(F.col("a.frame").alias("frame"), *[c.alias(n) for c, n in zip(m, ("x", "y", "z", "radius"))]), 7, "x", "y", "z", "radius")


def object_extents(spark, sf_dir):
    """Bounds and map size of new objects."""
    p = relation(spark, sf_dir, "points").select((F.col("o3") % 13).alias("obj_id"), *[(F.col(k) * 0.02).alias("p" + k) for k in "xyz"])
    return _r(detections.object_extent(p), 7, "min_px", "max_px", "mean_px", "min_py", "max_py", "mean_py", "min_pz", "max_pz", "mean_pz", "map_dim")


def occlusion(spark, sf_dir):
    """Pixels of objects whose depth is off the scene's."""
    p = relation(spark, sf_dir, "points")
    objects = p.groupBy(F.col("frame").alias("obj_id"), F.col("x").alias("u"), F.col("y").alias("v")).agg((F.min("z") / 10).alias("depth"))
    return _r(detections.occluded(objects, relation(spark, sf_dir, "image"), 0.1), 9, "depth")


def pose_density(spark, sf_dir):
    """Densities of candidates' poses around past poses."""
    p = relation(spark, sf_dir, "poses").select("seq", "x", "y", "z", F.round("yaw", 3).alias("yaw"))
    asked, past = p.where("yaw < 0.5"), p.where("yaw > 3").select("x", "y", "z", "yaw").distinct()
    return _r(histories.density_rejection(asked, past, "seq", (0.3, 0.3, 0.3, 1.2), 1.0), 7, "rejection")


def merged_metrics(spark, sf_dir):
    """Metrics merged within iterations as their type asks."""
    m = relation(spark, sf_dir, "metrics")
    kinds = F.element_at(F.array(*map(F.lit, ("COUNT", "POWER", "FREQUENCY", "OTHER"))), (F.length("key") % 4 + 1).cast("int"))
    return _r(histories.merge_iterations(m.withColumn("type", kinds)), 6, "value")


def dense_paths(spark, sf_dir):
    """Paths with poses no more than 3 apart."""
    out = association.densify(relation(spark, sf_dir, "poses"), ["body"], "seq", 3.0)
    return _r(out.withColumn("part", F.col("part").cast("long")), 7, "x", "y", "z")


def pose_errors(spark, sf_dir):
    """Errors between consecutive poses of a body, and whether they are within a threshold."""
    s = association.segments(relation(spark, sf_dir, "poses"), ["body"], "seq", 1.0, 1.0)
    out = s.select("body", "seq", F.col("distance").alias("position_error"), F.col("turn").alias("yaw_error"), scalars.within_threshold(F.col("distance"), F.col("turn"), 5.0, 1.0).alias("near"))
    return _r(out, 6, "position_error", "yaw_error")


def tree_depths(spark, sf_dir):
    """Octants by depth after deleting all deeper ones, and after allocating all children down to a depth."""
    from ..functions import morton
    from ..operators import allocation
    from .keys import DEPTH, _key

    keys = allocation.with_ancestors(relation(spark, sf_dir, "points").select(_key().alias("key")).distinct(), DEPTH)
    up = allocation.delete_up_to(keys, 2)
    down = allocation.allocate_down_to(up, 3, DEPTH)
    count = lambda df, what: df.groupBy(morton.depth(F.col("key")).alias("depth")).agg(F.count("*").alias("n")).withColumn("what", F.lit(what))
    return count(up, "up").unionByName(count(down, "down"))


def sensor_functions(spark, sf_dir):
    """Scalar functions of sensors and images."""
    a, p = F.col("value") / 10.0, F.col("value") / 500.0
    f = relation(spark, sf_dir, "frames")
    q = scalars.yaw_quaternion(scalars.wrap_pi(a))
    digits = scalars.digits(F.col("frame") % 4096, [16, 16, 16])
    out = f.select(
        "frame", scalars.three_sigma(a, 0.01, 0.05, 0.2).alias("sigma"), scalars.three_sigma(a, 0.001, 0.05, 0.2, True).alias("sigma2"), scalars.surface_thickness(a, 0.05, 0.1, 0.5).alias("tau"),
        scalars.bspline_occupancy(a / 10 - 2).alias("step"), scalars.saturating_add(F.col("frame") % 20, 3, 15).cast("long").alias("more"), scalars.normal_pdf(a, 20.0, 7.0).alias("density"),
        scalars.low_variance(a, a + 1, F.lit(20.0), F.lit(22.0), F.lit(0.4), F.lit(0.8)).cast("long").alias("variance"), scalars.gray_ramp(a, 5.0, 40.0).alias("gray"), scalars.roll_pitch_yaw(q)[2].alias("yaw"),
        scalars.mixed_radix([(d, 16) for d in digits]).alias("index"), digits[1].cast("long").alias("digit"), scalars.distance_gain(a, p * 20, 4.0, 60.0).alias("gain"),
        geometry.polar(F.col("frame") % 30, 30, 1.1).alias("polar"), geometry.azimuth_column(scalars.wrap_pi(a), 72).alias("column"),
        scalars.integration_scale(p * 9, 525.0, 0.01, F.col("frame") % 5 - 1).cast("long").alias("scale"),
    )
    return _r(out, 7, "sigma", "sigma2", "tau", "step", "density", "yaw", "gain", "polar")


QUERIES = {f.__name__: f for f in (integrate_frame, integrate_occupancy, reprojection, frustum_tests, ray_image, map_bounds, merged_spheres, object_extents, occlusion, pose_density, merged_metrics, dense_paths, pose_errors, tree_depths, sensor_functions)}

_TAU = "6.283185307179586e0"
_WRAP = lambda a: f"(({a}) - floor(({a}) / {_TAU}) * {_TAU})"
_PI = "3.141592653589793e0"
_WPI = lambda a: f"({_WRAP(f'{a} + {_PI}')} - {_PI})"
_SEEN = f"""{sql('voxels', 'image')}, c AS (SELECT x, y, z, value, weight, (x + 0.5e0) * 2e-1 - 3.2e0 AS px, (y + 0.5e0) * 2e-1 - 3.2e0 AS py, (z + 0.5e0) * 2e-1 AS pz FROM voxels),
  j AS (SELECT *, CAST(floor(60 * px / pz + 31.5e0 + 0.5e0) AS BIGINT) AS u, CAST(floor(60 * py / pz + 31.5e0 + 0.5e0) AS BIGINT) AS v FROM c),
  s AS (SELECT j.*, i.depth, (i.depth - pz) / pz * sqrt(px * px + py * py + pz * pz) AS sdf FROM j JOIN image i ON i.u = j.u AND i.v = j.v WHERE i.depth > 0)"""
_CLAMP = lambda x, a, b: f"greatest({a}, least({x}, {b}))"
_BOX = "SELECT frame, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_, min(z) AS az, max(z) AS bz FROM {} GROUP BY frame"
_NORMS = {"w": "32e0 / 60", "s": "sqrt(1 + pow(32e0 / 60, 2))"}
ORACLE = {
    "integrate_frame": f"{_SEEN}, t AS (SELECT *, {_CLAMP('sdf / 8e-1', -1, 1)} AS d FROM s WHERE sdf > -8e-1) SELECT x, y, z, round(sdf, 8) + 0e0 AS sdf, round({_CLAMP('(value * weight + d) / (weight + 1)', -1, 1)}, 8) + 0e0 AS value, least(weight + 1, 100e0) AS weight FROM t",
    "integrate_occupancy": f"""{_SEEN}, k AS (SELECT *, 3 * {_CLAMP('depth * 5e-2', '1e-1', '5e-1')} AS sigma, {_CLAMP('depth * 5e-2', '1e-1', '6e-1')} AS tau, -sdf AS r FROM s),
      o AS (SELECT *, CASE WHEN r < -sigma THEN -5.015e0 WHEN r < tau / 2 THEN least(-5.015e0 + 5.015e0 / sigma * (r + sigma), 5.015e0) WHEN r < tau THEN least(5.015e0 * tau / (2 * sigma), 5.015e0) END AS sample FROM k)
      SELECT x, y, z, round(sample, 8) + 0e0 AS sample, round((value * weight + sample) / (weight + 1), 8) + 0e0 AS value, least(weight + 1, 20e0) AS weight FROM o WHERE sample IS NOT NULL""",
    "reprojection": f"{sql('image')} SELECT u, v, CASE WHEN depth > 0 THEN u END AS pu, CASE WHEN depth > 0 THEN v END AS pv, depth > 0 AS seen, round(depth, 8) AS depth FROM image",
    "frustum_tests": f"""{sql('image')}, p AS (SELECT u, v, (u - 32) / 10e0 + 1.37e-2 AS x, (v - 32) / 10e0 + 1.37e-2 AS y, depth AS z FROM image), k AS (SELECT *, {_NORMS['w']} AS w FROM p)
      SELECT u, v, x + 4e-1 + w * (z + 4e-1) >= 0 AND -x + w * (z + 4e-1) >= 0 AND y + 4e-1 + w * (z + 4e-1) >= 0 AND -y + w * (z + 4e-1) >= 0 AND z + 4e-1 >= 4e-1 AND z <= 6 AS box,
      x + 4e-1 + w * (z + 4e-1) >= 0 AND -x + w * (z + 4e-1) >= 0 AND y + 4e-1 + w * (z + 4e-1) >= 0 AND -y + w * (z + 4e-1) >= 0 AND z + 4e-1 >= 4e-1 AS endless_box,
      abs(x) <= w * z AND abs(y) <= w * z AND z >= 4e-1 AS endless_point, abs(x) <= w * z AND abs(y) <= w * z AS ray,
      round(4e-1 * sqrt(pow((u - 31.5e0) / 60, 2) + pow((v - 31.5e0) / 60, 2) + 1), 8) AS near, round(6 * sqrt(pow((u - 31.5e0) / 60, 2) + pow((v - 31.5e0) / 60, 2) + 1), 8) AS far FROM k""",
    "ray_image": f"WITH g AS (SELECT u, v, {_PI} - 2 * {_PI} * (u + 0.5e0) / 36 AS a, {_PI} / 2 - 6e-1 + 1.2e0 * (v + 0.5e0) / 10 AS p FROM (SELECT unnest(range(0, 36)) AS u), (SELECT unnest(range(0, 10)) AS v)) SELECT u, v, round(sin(p) * cos(a), 9) + 0e0 AS dx, round(sin(p) * sin(a), 9) + 0e0 AS dy, round(cos(p), 9) + 0e0 AS dz FROM g",
    "map_bounds": f"{sql('points')}, b AS ({_BOX.format('points')}) SELECT frame, ax AS min_x, bx AS max_x, ay AS min_y, by_ AS max_y, az AS min_z, bz AS max_z, (ax + bx) / 2e0 AS centre_x, (ay + by_) / 2e0 AS centre_y, (az + bz) / 2e0 AS centre_z, round(sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2) + pow(bz - az, 2)) / 2, 8) AS radius FROM b",
    "merged_spheres": f"""{sql('points')}, p AS (SELECT frame, x + frame * 20 AS x, y, z FROM points), b AS ({_BOX.format('p')}), s AS (SELECT frame, (ax + bx) / 2e0 AS x, (ay + by_) / 2e0 AS y, (az + bz) / 2e0 AS z, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2) + pow(bz - az, 2)) / 2 AS r FROM b),
      j AS (SELECT a.frame, a.x, a.y, a.z, a.r, b.x AS x2, b.y AS y2, b.z AS z2, b.r AS r2, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2)) AS d FROM s a JOIN s b ON b.frame = a.frame + 1),
      m AS (SELECT *, (d + r + r2) / 2 AS rm FROM j)
      SELECT frame, round(CASE WHEN d + r2 <= r THEN x WHEN d + r <= r2 THEN x2 ELSE x + (x2 - x) * (rm - r) / d END, 7) + 0e0 AS x, round(CASE WHEN d + r2 <= r THEN y WHEN d + r <= r2 THEN y2 ELSE y + (y2 - y) * (rm - r) / d END, 7) + 0e0 AS y, round(CASE WHEN d + r2 <= r THEN z WHEN d + r <= r2 THEN z2 ELSE z + (z2 - z) * (rm - r) / d END, 7) + 0e0 AS z,
      round(CASE WHEN d + r2 <= r THEN r WHEN d + r <= r2 THEN r2 ELSE rm END, 7) AS radius FROM m""",
    "object_extents": f"""{sql('points')}, p AS (SELECT o3 % 13 AS obj_id, x * 2e-2 AS px, y * 2e-2 AS py, z * 2e-2 AS pz FROM points), b AS (SELECT obj_id, min(px) AS min_px, max(px) AS max_px, avg(px) AS mean_px, min(py) AS min_py, max(py) AS max_py, avg(py) AS mean_py, min(pz) AS min_pz, max(pz) AS max_pz, avg(pz) AS mean_pz, count(*) AS n FROM p WHERE px <> 0 OR py <> 0 OR pz <> 0 GROUP BY obj_id),
      e AS (SELECT *, least(2.5e0 * greatest(max_px - min_px, max_py - min_py, max_pz - min_pz), 5e0) AS map_dim FROM b)
      SELECT obj_id, {', '.join(f'round({c}_{k}, 7) + 0e0 AS {c}_{k}' for k in ('px', 'py', 'pz') for c in ('min', 'max', 'mean'))}, n, round(map_dim, 7) AS map_dim, CAST(least(pow(2e0, ceil(log2(greatest(map_dim / 5e-2, 1e0))) + 1), 2048e0) AS BIGINT) AS map_size FROM e""",
    "occlusion": f"{sql('points', 'image')}, o AS (SELECT frame AS obj_id, x AS u, y AS v, min(z) / 10 AS depth FROM points GROUP BY ALL) SELECT o.u, o.v, o.obj_id, round(o.depth, 9) AS depth FROM o JOIN image i ON i.u = o.u AND i.v = o.v WHERE abs(o.depth - i.depth) > 4 * 1e-1",
    "pose_density": f"""{sql('poses')}, p AS (SELECT seq, x, y, z, round(yaw, 3) AS yaw FROM poses), h AS (SELECT DISTINCT x, y, z, yaw FROM p WHERE yaw > 3),
      b AS (SELECT seq, max(exp(-(pow((a.x - h.x) / 3e-1, 2) + pow((a.y - h.y) / 3e-1, 2) + pow((a.z - h.z) / 3e-1, 2) + pow({_WPI('h.yaw - a.yaw')} / 1.2e0, 2)) / 2)) AS d FROM p a JOIN h ON abs(floor(a.x) - floor(h.x)) <= 1 AND abs(floor(a.y) - floor(h.y)) <= 1 AND abs(floor(a.z) - floor(h.z)) <= 1 WHERE a.yaw < 0.5 GROUP BY seq)
      SELECT p.seq, round(coalesce(d, 0e0), 7) AS rejection FROM p LEFT JOIN b ON b.seq = p.seq WHERE p.yaw < 0.5""",
    "merged_metrics": f"{sql('metrics')}, m AS (SELECT *, ['COUNT', 'POWER', 'FREQUENCY', 'OTHER'][length(key) % 4 + 1] AS type FROM metrics) SELECT key, type, iter, round(CASE type WHEN 'COUNT' THEN sum(value) WHEN 'POWER' THEN max(value) WHEN 'FREQUENCY' THEN avg(value) ELSE arg_max(value, seq) END, 6) AS value FROM m GROUP BY key, type, iter",
    "dense_paths": f"""{sql('poses')}, m AS (SELECT body, seq, x, y, z, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM poses WINDOW w AS (PARTITION BY body ORDER BY seq)),
      n AS (SELECT *, CAST(coalesce(greatest(1, ceil(sqrt(pow(x2 - x, 2) + pow(y2 - y, 2) + pow(z2 - z, 2)) / 3e0)), 1) AS BIGINT) AS k FROM m), e AS (SELECT *, unnest(range(0, k)) AS part FROM n)
      SELECT body, seq, part, round(coalesce(x + (x2 - x) * part / k, x), 7) AS x, round(coalesce(y + (y2 - y) * part / k, y), 7) AS y, round(coalesce(z + (z2 - z) * part / k, z), 7) AS z FROM e""",
    "pose_errors": f"""{sql('poses')}, m AS (SELECT body, seq, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2) + pow(lead(z) OVER w - z, 2)) AS d, {_WPI('lead(yaw) OVER w - yaw')} AS t FROM poses WINDOW w AS (PARTITION BY body ORDER BY seq))
      SELECT body, seq, round(d, 6) AS position_error, round(t, 6) + 0e0 AS yaw_error, d <= 5 AND abs(t) <= 1 AS near FROM m WHERE d IS NOT NULL""",
    "tree_depths": f"""{sql('points')}, u AS (SELECT DISTINCT d, x - x % (64 >> d) AS x, y - y % (64 >> d) AS y, z - z % (64 >> d) AS z FROM points, (VALUES (0), (1), (2)) f(d)), n AS (SELECT d, count(*) AS n FROM u GROUP BY d)
      SELECT CAST(d AS BIGINT) AS depth, n, 'up' AS what FROM n UNION ALL SELECT CAST(d AS BIGINT), n, 'down' FROM n UNION ALL SELECT CAST(3 AS BIGINT), n * 8, 'down' FROM n WHERE d = 2""",
    "sensor_functions": f"""{sql('frames')}, f AS (SELECT frame, value / 10e0 AS a, value / 500e0 AS p FROM frames), t AS (SELECT *, a / 10 - 2 AS b, a / 10 - 5 AS b3, p * 9 / 5.25e0 AS ratio, frame % 5 - 1 AS last FROM f),
      q AS (SELECT *, CASE WHEN b <= -3 THEN 0e0 WHEN b >= 3 THEN 1e0 WHEN b < -1 THEN pow(b + 3, 3) / 48 WHEN b < 1 THEN 0.5e0 + b * (3 + b) * (3 - b) / 24 ELSE 1 - pow(3 - b, 3) / 48 END AS q0, CASE WHEN b3 <= -3 THEN 0e0 WHEN b3 >= 3 THEN 1e0 WHEN b3 < -1 THEN pow(b3 + 3, 3) / 48 WHEN b3 < 1 THEN 0.5e0 + b3 * (3 + b3) * (3 - b3) / 24 ELSE 1 - pow(3 - b3, 3) / 48 END AS q3 FROM t)
      SELECT frame, round(3 * {_CLAMP('1e-2 * a', '5e-2', '2e-1')}, 7) AS sigma, round(3 * {_CLAMP('1e-3 * a * a', '5e-2', '2e-1')}, 7) AS sigma2, round({_CLAMP('5e-2 * a', '1e-1', '5e-1')}, 7) AS tau, round(q0 - q3 * 0.5e0, 7) + 0e0 AS step, CAST(least(frame % 20 + 3, 15) AS BIGINT) AS more,
      round(exp(-pow((a - 20) / 7, 2) / 2) / (7 * sqrt({_TAU})), 7) AS density, CAST(CASE WHEN a - 22 > 1 THEN 1 WHEN a + 1 - 20 < -0.5e0 THEN -1 ELSE 0 END AS BIGINT) AS variance, CAST(floor(255 * {_CLAMP('(a - 5) / 35', '0e0', '1e0')}) AS BIGINT) AS gray, round({_WPI('a')}, 7) + 0e0 AS yaw,
      CAST(frame % 4096 AS BIGINT) AS index, CAST(frame % 4096 // 16 % 16 AS BIGINT) AS digit, round(CASE WHEN a <= 4 OR p * 20 >= a THEN 0e0 ELSE (a - greatest(p * 20, 4e0)) / 60 END, 7) + 0e0 AS gain, round({_PI} / 2 - 0.55e0 + 1.1e0 * (frame % 30 + 0.5e0) / 30, 7) AS polar,
      CAST(floor(({_PI} - {_WPI('a')}) / (2 * {_PI}) * 72) AS BIGINT) % 72 AS column,
      CAST(CASE WHEN last < 0 THEN CASE WHEN ratio < 1.5e0 THEN 0 WHEN ratio < 3 THEN 1 WHEN ratio < 6 THEN 2 ELSE 3 END WHEN ratio < [0, 1.25e0, 2.75e0, 5.75e0][last + 1] THEN last - 1 WHEN ratio > [1.75e0, 3.25e0, 6.25e0, 1e300][last + 1] THEN last + 1 ELSE last END AS BIGINT) AS scale FROM q""",
}
