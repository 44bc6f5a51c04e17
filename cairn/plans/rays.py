"""Queries over rays through the map and reads of it at mixed scales."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gather, meshing, traversal
from .relations import relation, sql

EDGE = 32
_TURN = [("x", 0.61, 7), ("y", -0.43, 5), ("z", 0.37, 11)]


def _rays(spark, sf_dir):
    """A ray for each order that has points, from beside its least coordinates, in directions that vary with it; some run along an axis."""
    p = relation(spark, sf_dir, "dense").groupBy("o1").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.min("z").alias("z"))
    d = [(F.lit(a) + F.col("o1") % m * 0.217 - 0.5).alias("d" + k) if k != "z" else F.when(F.col("o1") % 6 == 0, 0.0).otherwise(F.lit(a) + F.col("o1") % m * 0.217 - 0.5).alias("d" + k) for k, a, m in _TURN]
    return p.select(F.col("o1").alias("ray"), *[(F.col(k) + 0.37 + F.col("o1") % 3 * 0.11).alias("o" + k) for k in "xyz"], *d)


def ray_blocks(spark, sf_dir):
    full = relation(spark, sf_dir, "voxels").groupBy(*[(F.col(k) - F.col(k) % 8).alias(k) for k in "xyz"]).agg(F.sum("value").alias("s")).where("s < -900 or s % 2 < 1")
    found = traversal.ray_blocks(_rays(spark, sf_dir), full, EDGE, 0.5, 60.0)
    return found.withColumns({c: F.round(c, 6) for c in ("t_in", "t_out")})


def ray_casts(spark, sf_dir):
    found = traversal.raycast(_rays(spark, sf_dir), relation(spark, sf_dir, "voxels"), EDGE, 0.0, 60.0, -2.0, 9.0)
    return found.withColumns({c: F.round(c, 6) for c in ("t", "t_known")})


def _mixed(spark, sf_dir):
    """Voxels of blocks that hold scales 0 to 2, by their place."""
    v = relation(spark, sf_dir, "voxels").withColumn("scale", ((F.col("x") / 8).cast("int") + 2 * (F.col("y") / 8).cast("int") + 5 * (F.col("z") / 8).cast("int")) % 3)
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("scale"))
    return v.groupBy(*[(F.col(k) - F.col(k) % size).alias(k) for k in "xyz"], "scale").agg(F.avg("value").alias("value"), F.count("*").cast("double").alias("weight"))


def mixed_interpolation(spark, sf_dir):
    p = relation(spark, sf_dir, "dense").groupBy("o1").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.max("z").alias("z"))
    places = p.select(F.col("o1").alias("probe"), *[(F.col(k) + (F.col("o1") % (7 + i)) / (7.0 + i) + 0.003).alias("p" + k) for i, k in enumerate("xyz")])
    found = gather.interpolate(places, gather.halo_blocks(_mixed(spark, sf_dir)))
    return found.withColumn("value", F.round("value", 6) + F.lit(0.0))


def _three_scales(spark, sf_dir):
    """Voxels at scales 2, 1 and 0, with changes at the coarsest and gaps at the finer ones."""
    out = None
    for s in range(3):
        size = 1 << s
        level = relation(spark, sf_dir, "voxels").groupBy(*[(F.col(k) - F.col(k) % size).alias(k) for k in "xyz"]).agg(F.avg(F.col("value") / 5).alias("value"), F.count("*").alias("n"), F.sum("weight").alias("w"))
        gap = F.col("w") % 3 == 0 if s < 2 else F.lit(False)
        change = (F.col("n") % 7 - 3) * 0.05 if s == 2 else F.lit(0.0)
        delta = F.col("n") % 3 if s == 2 else F.lit(0)
        level = level.select("x", "y", "z", F.lit(s).alias("scale"), F.when(gap, 0.0).otherwise(F.col("value")).alias("value"), F.when(gap, 0.0).otherwise(F.col("value") - change).alias("last"), F.when(gap, 0.0).otherwise(F.col("n").cast("double")).alias("weight"), delta.cast("double").alias("delta"))
        out = level if out is None else out.unionByName(level)
    return out


def propagate_down(spark, sf_dir):
    found = gather.propagate_down(_three_scales(spark, sf_dir), 2, 0, 9.0)
    return found.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("value", "last")})


def dual_mesh(spark, sf_dir):
    """The mesh over blocks of mixed scales, by corner."""
    found = meshing.dual_marching_cubes(_mixed(spark, sf_dir), -2.0).groupBy("x", "y", "z").agg((F.count("*") / 3).cast("long").alias("triangles"), *[F.avg(c).alias(c) for c in ("vx", "vy", "vz")])
    return found.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("vx", "vy", "vz")})


QUERIES = {f.__name__: f for f in (ray_blocks, ray_casts, mixed_interpolation, propagate_down, dual_mesh)}

_D = {k: f"({a}e0 + (o1 % {m}) * 0.217e0 - 0.5e0)" for k, a, m in _TURN}
_D["z"] = f"CASE WHEN o1 % 6 = 0 THEN 0e0 ELSE {_D['z']} END"
_RAYS = f"rays AS (SELECT o1 AS ray, {', '.join(f'{k} + 0.37e0 + (o1 % 3) * 0.11e0 AS o{k}, {_D[k]} AS d{k}' for k in 'xyz')} FROM (SELECT o1, min(x) AS x, max(y) AS y, min(z) AS z FROM dense GROUP BY o1))"


def _cells(size: int, nearest: str, farthest: str) -> str:
    """Every crossing of every ray with every plane of the map, cut to the map; the cells lie between neighbours."""
    low = ", ".join(f"CASE WHEN d{k} = 0 THEN {nearest} ELSE least(-o{k} / d{k}, ({EDGE} - o{k}) / d{k}) END" for k in "xyz")
    high = ", ".join(f"CASE WHEN d{k} = 0 THEN {farthest} ELSE greatest(-o{k} / d{k}, ({EDGE} - o{k}) / d{k}) END" for k in "xyz")
    beside = " OR ".join(f"d{k} = 0 AND (o{k} < 0 OR o{k} >= {EDGE})" for k in "xyz")
    cuts = " UNION ".join(f"SELECT ray, (k * {size} - o{c}) / d{c} AS t FROM clip, (SELECT unnest(range({EDGE // size + 1})) AS k) WHERE d{c} <> 0 AND (k * {size} - o{c}) / d{c} > t0 AND (k * {size} - o{c}) / d{c} < t1" for c in "xyz")
    at = ", ".join(f"CAST(floor((o{k} + (t + u) / 2 * d{k}) / {size}) * {size} AS BIGINT) AS {k}" for k in "xyz")
    return f"""clip AS (SELECT * FROM (SELECT *, greatest({nearest}, {low}) AS t0, least({farthest}, {high}) AS t1 FROM rays WHERE NOT ({beside})) WHERE t0 < t1), cuts AS (SELECT ray, t0 AS t FROM clip UNION SELECT ray, t1 FROM clip UNION {cuts}),
      cells AS (SELECT ray, t AS t_in, u AS t_out, {at} FROM (SELECT *, lead(t) OVER (PARTITION BY ray ORDER BY t) AS u FROM cuts) JOIN clip USING (ray) WHERE u IS NOT NULL)"""


_BITS = "(VALUES (0), (1)) i(i), (VALUES (0), (1)) j(j), (VALUES (0), (1)) k(k)"


def _up(level: str, size: int) -> str:
    return f"SELECT {', '.join(f'{c} - {c} % {size} AS {c}' for c in 'xyz')}, avg(value) AS value FROM {level} GROUP BY 1, 2, 3"


_LEAVES = """scaled AS (SELECT *, (x // 8 + 2 * (y // 8) + 5 * (z // 8)) % 3 AS s FROM voxels), leaves AS (SELECT s, x - x % (1 << s) AS x, y - y % (1 << s) AS y, z - z % (1 << s) AS z, avg(value) AS value FROM scaled GROUP BY ALL)"""
_LEAVES += ", " + ", ".join(f"l{s} AS (SELECT x, y, z, value FROM leaves WHERE s = {s}" + (f" UNION ALL {_up(f'l{s - 1}', 1 << s)}" if s else "") + ")" for s in range(4))
_LEAVES += ", held AS (SELECT DISTINCT s, x - x % 8 AS x, y - y % 8 AS y, z - z % 8 AS z FROM scaled), levels AS (" + " UNION ALL ".join(f"SELECT {s} AS s, * FROM l{s}" for s in range(4)) + ")"


def _down(parents: str, children: str, size: int) -> str:
    """One level of propagation: name_of_children_done from the parents' table and the children's."""
    near = {c: f"floor((c.{c} + {size // 4}e0) / {size} - 0.5e0)" for c in "xyz"}
    if size == 2:
        near = {c: f"floor((c.{c} + 0.5e0) / 2 - 0.5e0)" for c in "xyz"}
    middle = f"{size / 4}e0"
    share = " * ".join(f"CASE {b} WHEN 1 THEN (c.{c} + {middle}) / {size} - 0.5e0 - {near[c]} ELSE 1 - ((c.{c} + {middle}) / {size} - 0.5e0 - {near[c]}) END" for c, b in zip("xyz", "ijk"))
    on = " AND ".join(f"p.{c} = ({near[c]} + {b}) * {size}" for c, b in zip("xyz", "ijk"))
    return f"""{children}_given AS (SELECT c.x, c.y, c.z, sum(w * p.value) AS given FROM (SELECT c.x, c.y, c.z, i, j, k, {share} AS w FROM {children} c, {_BITS} WHERE c.weight = 0) c JOIN {parents} p ON {on} WHERE p.weight > 0 GROUP BY ALL HAVING count(*) = 8),
      {children}_both AS (SELECT c.*, p.value AS pv, p.last AS pl, p.weight AS pw, p.delta AS pd, CASE WHEN p.weight > 0 THEN given END AS given FROM {children} c LEFT JOIN {parents} p ON p.x = c.x - c.x % {size} AND p.y = c.y - c.y % {size} AND p.z = c.z - c.z % {size} LEFT JOIN {children}_given g ON g.x = c.x AND g.y = c.y AND g.z = c.z),
      {children}_done AS (SELECT x, y, z, scale, CASE WHEN weight > 0 THEN greatest(value + coalesce(pv - pl, 0), -1) WHEN given IS NOT NULL THEN greatest(-1, least(1, given)) ELSE value END AS value,
        CASE WHEN weight = 0 AND given IS NOT NULL THEN greatest(-1, least(1, given)) ELSE last END AS last, CASE WHEN weight > 0 THEN least(weight + coalesce(pd, 0), 9e0) WHEN given IS NOT NULL THEN pw ELSE weight END AS weight, CASE WHEN weight > 0 THEN coalesce(pd, 0e0) ELSE 0e0 END AS delta FROM {children}_both)"""


def _scale(s: int) -> str:
    gap = "w % 3 = 0" if s < 2 else "false"
    change, delta = ("(n % 7 - 3) * 5e-2", "n % 3") if s == 2 else ("0e0", "0")
    at = ", ".join(f"{c} - {c} % {1 << s} AS {c}" for c in "xyz")
    return f"v{s} AS (SELECT x, y, z, {s} AS scale, CASE WHEN {gap} THEN 0e0 ELSE value END AS value, CASE WHEN {gap} THEN 0e0 ELSE value - {change} END AS last, CASE WHEN {gap} THEN 0e0 ELSE CAST(n AS DOUBLE) END AS weight, CAST({delta} AS DOUBLE) AS delta FROM (SELECT {at}, avg(value / 5) AS value, count(*) AS n, sum(weight) AS w FROM voxels GROUP BY 1, 2, 3))"


ORACLE = {
    "dual_mesh": f"""{sql('voxels')}, {_LEAVES}, corners AS (SELECT DISTINCT x + i * (1 << s) AS x, y + j * (1 << s) AS y, z + k * (1 << s) AS z FROM leaves, {_BITS}),
      asked AS (SELECT x, y, z, n, x + dx - 1 AS cx, y + dy - 1 AS cy, z + dz - 1 AS cz FROM corners, (VALUES {", ".join(str((i, *c)) for i, c in enumerate(meshing.CORNERS))}) c(n, dx, dy, dz) WHERE x + dx > 0 AND y + dy > 0 AND z + dz > 0),
      found AS (SELECT a.x, a.y, a.z, n, l.value, l.x + (1 << l.s) / 2e0 AS px, l.y + (1 << l.s) / 2e0 AS py, l.z + (1 << l.s) / 2e0 AS pz FROM asked a JOIN held h ON h.x = cx - cx % 8 AND h.y = cy - cy % 8 AND h.z = cz - cz % 8
        JOIN leaves l ON l.s = h.s AND l.x = cx - cx % (1 << h.s) AND l.y = cy - cy % (1 << h.s) AND l.z = cz - cz % (1 << h.s)),
      cells AS (SELECT x, y, z, list(struct_pack(px := px, py := py, pz := pz, value := value) ORDER BY n) AS v, sum(CASE WHEN value < -2 THEN 1 << n ELSE 0 END) AS case_of FROM found GROUP BY x, y, z HAVING count(*) = 8),
      cases AS (SELECT * FROM (VALUES {", ".join(str((c, *(i + 1 for e in t for i in meshing.EDGES[e]))) for c in range(256) for t in meshing.triangles_of(c))}) t(case_of, a0, b0, a1, b1, a2, b2)),
      made AS (SELECT x, y, z, list_sort([v[a0], v[b0]]) AS p, list_sort([v[a1], v[b1]]) AS q, list_sort([v[a2], v[b2]]) AS r FROM cells JOIN cases USING (case_of)),
      real AS (SELECT x, y, z, unnest([p, q, r]) AS e FROM made WHERE p <> q AND q <> r AND p <> r)
      SELECT x, y, z, count(*) // 3 AS triangles, {", ".join(f"round(avg(e[1].p{c} + (e[2].p{c} - e[1].p{c}) * ((-2e0 - e[1].value) / (e[2].value - e[1].value))), 6) + 0e0 AS v{c}" for c in "xyz")} FROM real GROUP BY x, y, z""",
    "mixed_interpolation": f"""{sql('voxels')}, {_LEAVES}, places AS (SELECT o1 AS probe, x + (o1 % 7) / 7e0 + 3e-3 AS px, y + (o1 % 8) / 8e0 + 3e-3 AS py, z + (o1 % 9) / 9e0 + 3e-3 AS pz FROM (SELECT o1, min(x) AS x, max(y) AS y, max(z) AS z FROM dense GROUP BY o1)),
      based AS (SELECT *, floor(px / n - 0.5e0) AS fx, floor(py / n - 0.5e0) AS fy, floor(pz / n - 0.5e0) AS fz FROM (SELECT *, 1 << s AS n FROM places, (SELECT unnest(range(4)) AS s))),
      corners AS (SELECT probe, s, CAST((fx + i) * n AS BIGINT) AS x, CAST((fy + j) * n AS BIGINT) AS y, CAST((fz + k) * n AS BIGINT) AS z,
        (CASE i WHEN 1 THEN px / n - 0.5e0 - fx ELSE 1 - (px / n - 0.5e0 - fx) END) * (CASE j WHEN 1 THEN py / n - 0.5e0 - fy ELSE 1 - (py / n - 0.5e0 - fy) END) * (CASE k WHEN 1 THEN pz / n - 0.5e0 - fz ELSE 1 - (pz / n - 0.5e0 - fz) END) AS w FROM based, {_BITS}),
      needs AS (SELECT probe, c.s, greatest(c.s, coalesce(max(h.s), 0)) AS need FROM corners c LEFT JOIN held h ON h.x = c.x - c.x % 8 AND h.y = c.y - c.y % 8 AND h.z = c.z - c.z % 8 AND c.x >= 0 AND c.y >= 0 AND c.z >= 0 GROUP BY probe, c.s),
      own AS (SELECT probe, s FROM places JOIN held ON x = CAST(floor(px / 8) * 8 AS BIGINT) AND y = CAST(floor(py / 8) * 8 AS BIGINT) AND z = CAST(floor(pz / 8) * 8 AS BIGINT)),
      told AS (SELECT o.probe, c.need AS s FROM own o JOIN needs a ON a.probe = o.probe AND a.s = o.s JOIN needs b ON b.probe = o.probe AND b.s = a.need JOIN needs c ON c.probe = o.probe AND c.s = b.need),
      sums AS (SELECT probe, s, sum(w * value) AS value FROM told JOIN corners USING (probe, s) JOIN levels USING (s, x, y, z) GROUP BY probe, s HAVING count(*) = 8)
      SELECT probe, round(value, 6) + 0e0 AS value, CAST(s AS INTEGER) AS scale FROM places LEFT JOIN sums USING (probe)""",
    "propagate_down": f"""{sql('voxels')}, {_scale(2)}, {_scale(1)}, {_scale(0)}, {_down('v2', 'v1', 4)}, {_down('v1_done', 'v0', 2)},
      every AS (SELECT x, y, z, scale, value, value AS last, weight, 0e0 AS delta FROM v2 UNION ALL SELECT x, y, z, scale, value, value, weight, 0e0 FROM v1_done UNION ALL SELECT x, y, z, scale, value, last, weight, delta FROM v0_done)
      SELECT x, y, z, scale, round(value, 6) + 0e0 AS value, round(last, 6) + 0e0 AS last, weight, delta FROM every""",
    "ray_blocks": f"""{sql('voxels')}, {_RAYS}, {_cells(8, '0.5e0', '60e0')}, blocks AS (SELECT x - x % 8 AS x, y - y % 8 AS y, z - z % 8 AS z, sum(value) AS s FROM voxels GROUP BY 1, 2, 3)
      SELECT ray, CAST(row_number() OVER (PARTITION BY ray ORDER BY t_in) - 1 AS INTEGER) AS n, x, y, z, round(t_in, 6) AS t_in, round(t_out, 6) AS t_out FROM cells SEMI JOIN (SELECT * FROM blocks WHERE s < -900 OR s % 2 < 1) USING (x, y, z)""",
    "ray_casts": f"""{sql('voxels')}, {_RAYS}, {_cells(1, '0e0', '60e0')}, seen AS (SELECT cells.*, value, lag(t_in) OVER w AS p_in, lag(t_out) OVER w AS p_out, lag(value) OVER w AS p FROM cells JOIN voxels USING (x, y, z) WINDOW w AS (PARTITION BY ray ORDER BY t_in)),
      hits AS (SELECT *, (p_in + p_out) / 2 + ((t_in + t_out) / 2 - (p_in + p_out) / 2) * (-2e0 - p) / (value - p) AS t, row_number() OVER (PARTITION BY ray ORDER BY t_in) AS n FROM seen WHERE p_out = t_in AND p <= -2 AND value > -2),
      firsts AS (SELECT ray, min(t_in) AS t_known FROM seen WHERE value <= -2 GROUP BY ray)
      SELECT ray, round(h.t, 6) AS t, h.x, h.y, h.z, round(CASE WHEN h.t IS NULL OR t_known < h.t THEN t_known END, 6) AS t_known FROM rays LEFT JOIN (SELECT * FROM hits WHERE n = 1) h USING (ray) LEFT JOIN firsts USING (ray)""",
}
