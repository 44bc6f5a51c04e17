"""Queries over keys: algebra, sets, allocation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, morton
from ..operators import allocation
from .relations import key_sql, morton_sql, relation, sql

DEPTH = 6
BLOCK = DEPTH - 3


def _key(at=BLOCK):
    return morton.encode(F.col("x"), F.col("y"), F.col("z"), at, DEPTH)


def key_encode(spark, sf_dir):
    p = relation(spark, sf_dir, "points").select("x", "y", "z").distinct()
    full = morton.interleave(F.col("x"), F.col("y"), F.col("z"), DEPTH)
    back = morton.coords(F.col("key"), DEPTH)
    return p.select("x", "y", "z", full.alias("code"), _key().alias("key")).select("x", "y", "z", "code", "key", *[c.alias("b" + k) for k, c in zip("xyz", back)], morton.gather(F.shiftright("code", 1), DEPTH).alias("y_back"))


def key_family(spark, sf_dir):
    keys = relation(spark, sf_dir, "points").select(_key().alias("key")).distinct()
    k = F.col("key")
    far = morton.far_corner(k, DEPTH)
    return keys.select("key", morton.depth(k).alias("depth"), morton.parent(k, DEPTH).alias("parent"), morton.child_index(k, DEPTH).cast("long").alias("child"), F.array_min(morton.siblings(k, DEPTH)).alias("first_sibling"), F.array_max(morton.siblings(k, DEPTH)).alias("last_sibling"), morton.prefix(k, 1, DEPTH).alias("top"), morton.is_descendant(k, morton.prefix(k, 1, DEPTH), DEPTH).alias("below"), *[c.alias("far_" + n) for n, c in zip("xyz", far)])


def key_neighbours(spark, sf_dir):
    blocks = relation(spark, sf_dir, "points").select(*[(F.col(k) - F.col(k) % 8).alias(k) for k in "xyz"]).distinct()
    near = blocks.select("x", "y", "z", F.explode(morton.face_neighbours(F.col("x"), F.col("y"), F.col("z"), 8, 64)).alias("n")).select("x", "y", "z", "n.face", F.col("n.x").alias("nx"), F.col("n.y").alias("ny"), F.col("n.z").alias("nz"))
    return near.withColumn("key", morton.encode(F.col("nx"), F.col("ny"), F.col("nz"), BLOCK, DEPTH))


def key_exterior(spark, sf_dir):
    keys = relation(spark, sf_dir, "points").select(_key().alias("key")).distinct()
    decoded = keys.withColumns(dict(zip("xyz", morton.coords(F.col("key"), DEPTH)))).repartition("key")  # a stage of its own: the plan of 7 keys each stays small
    near = decoded.select("key", F.explode(F.array_distinct(morton.exterior_neighbours(F.col("key"), DEPTH, (F.col("x"), F.col("y"), F.col("z"))))).alias("near"))
    return near.groupBy("key").agg(F.count("*").alias("n"), F.min("near").alias("first"), F.max("near").alias("last"))


def key_ancestry(spark, sf_dir):
    keys = relation(spark, sf_dir, "points").select(_key().alias("key")).distinct()
    return keys.select(F.explode(morton.ancestors(F.col("key"), DEPTH)).alias("ancestor")).groupBy("ancestor").agg(F.count("*").alias("blocks"))


def coordinates(spark, sf_dir):
    p = relation(spark, sf_dir, "points").select("x", "y", "z").distinct()
    index = F.col("x") % 8 + F.col("y") % 8 * 8 + F.col("z") % 8 * 64
    vx, vy, vz = morton.block_voxel(index % 64, F.lit(1))
    return p.select("x", "y", "z", *[((F.col(k) + 0.5) * 0.05).alias("m" + k) for k in "xyz"], index.alias("index"), *[c.cast("long").alias("s" + k) for k, c in zip("xyz", (vx, vy, vz))], morton.block_offset(F.col("x") % 4).cast("long").alias("offset"), *[F.floor((F.col(k) + 0.5) * 0.05 / 0.4).cast("long").alias("c" + k) for k in "xyz"])


def _occupied(spark, sf_dir):
    """(key, n, hundredths): each block's points, and the sum of their discounts, with the mean of points in a block (blocks, points)."""
    blocks = relation(spark, sf_dir, "points").groupBy(_key().alias("key")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("disc") * 100).cast("long")).alias("hundredths"))
    return blocks, *blocks.agg(F.count("*"), F.sum("n")).first()


def _wanted(spark, sf_dir):
    """Keys at depths 1 to 3 that mix ancestors and descendants: blocks with at least the mean of points, octants of those with at least 9/10 of it, and of the others."""
    blocks, many, points = _occupied(spark, sf_dir)
    k, share = F.col("key"), F.col("n") * many
    return blocks.select(F.when(share >= points, k).when(share * 10 >= F.lit(points) * 9, morton.prefix(k, 2, DEPTH)).otherwise(morton.prefix(k, 1, DEPTH)).alias("key")).distinct()


def filter_ancestors(spark, sf_dir):
    return allocation.filter_ancestors(_wanted(spark, sf_dir), DEPTH)


def unique_multiscale(spark, sf_dir):
    return allocation.unique_multiscale(_wanted(spark, sf_dir))


def allocate(spark, sf_dir):
    existing = _occupied(spark, sf_dir)[0].where("hundredths > 5 * n").select("key")  # blocks whose mean distance is positive
    return allocation.allocate(existing, _wanted(spark, sf_dir), DEPTH).withColumn("depth", morton.depth(F.col("key")))


def delete_subtrees(spark, sf_dir):
    keys = allocation.with_ancestors(relation(spark, sf_dir, "points").select(_key().alias("key")), DEPTH)
    roots = keys.where(morton.depth(F.col("key")) == 1).where(morton.child_index(F.col("key"), DEPTH) % 2 == 1)
    return allocation.delete_subtrees(keys, roots, DEPTH)


def _leaves_by_occupancy(spark, sf_dir):
    """Leaves that hold all points: blocks with at least the mean of points in a block, and the depth-1 octants of the others."""
    blocks, many, points = _occupied(spark, sf_dir)
    return blocks.select(F.when(F.col("n") * many >= points, F.col("key")).otherwise(morton.prefix(F.col("key"), 1, DEPTH)).alias("key")).distinct()


def balance(spark, sf_dir):
    return allocation.balance(_leaves_by_occupancy(spark, sf_dir), DEPTH).withColumn("depth", morton.depth(F.col("key")))


def boxes(spark, sf_dir):
    p = relation(spark, sf_dir, "points").select("x", "y", "z", "o1", "o2", "o3", "frame").distinct()
    a, sa = [F.col("x"), F.col("y"), F.col("z")], [F.col("frame")] * 3
    b, sb = [F.lit(20), F.lit(20), F.lit(20)], [F.lit(16)] * 3
    f = lambda v: [x.cast("double") for x in v]
    both = p.select(geometry.boxes_overlap(a, sa, b, sb).alias("overlap"), geometry.box_inside(a, sa, b, sb).alias("inside"), geometry.overlap_volume(f(a), f(sa), f(b), f(sb)).alias("volume"), geometry.in_box(a, b, [x + y for x, y in zip(b, sb)]).alias("corner"))
    return both.groupBy("overlap", "inside", "corner").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


QUERIES = {f.__name__: f for f in (key_encode, key_family, key_neighbours, key_exterior, key_ancestry, coordinates, filter_ancestors, unique_multiscale, allocate, delete_subtrees, balance, boxes)}

_P = sql("points")
_BLOCKS = f"{_P}, blocks AS (SELECT DISTINCT x - x % 8 AS x, y - y % 8 AS y, z - z % 8 AS z FROM points)"
_OCCUPIED = "occupied AS (SELECT x - x % 8 AS x, y - y % 8 AS y, z - z % 8 AS z, count(*) AS n, sum(CAST(round(disc * 100) AS BIGINT)) AS s FROM points GROUP BY ALL), ranked AS (SELECT *, n * count(*) OVER () AS share, sum(n) OVER () AS points FROM occupied)"
_WANT = f"{_OCCUPIED}, deep AS (SELECT *, CASE WHEN share >= points THEN 3 WHEN share * 10 >= points * 9 THEN 2 ELSE 1 END AS d FROM ranked), want AS (SELECT DISTINCT d, " + ", ".join(f"{c} - {c} % (1 << (6 - d)) AS {c}" for c in "xyz") + " FROM deep)"
_LEAVES = f"{_OCCUPIED}, deep AS (SELECT *, CASE WHEN share >= points THEN 3 ELSE 1 END AS d FROM ranked), leaves AS (SELECT DISTINCT d, " + ", ".join(f"{c} - {c} % (1 << (6 - d)) AS {c}" for c in "xyz") + " FROM deep)"
_KEY = morton_sql("x", "y", "z", DEPTH)
_PARENT = lambda n: ", ".join(f"{c} - {c} % {n} AS {c}" for c in "xyz")
_SIZE = "(1 << CAST(6 - {} AS INTEGER))"
_UP = "".join(f" UNION SELECT {d}, {_PARENT(64 >> d)} FROM {{0}} WHERE d > {d}" for d in range(3))
ORACLE = {
    "key_encode": f"{_P} SELECT DISTINCT x, y, z, {_KEY} AS code, {key_sql('x', 'y', 'z', 3, 6)} AS key, x - x % 8 AS bx, y - y % 8 AS by, z - z % 8 AS bz, y AS y_back FROM points",
    "key_family": f"""{_BLOCKS} SELECT {_KEY} + 3 AS key, CAST(3 AS BIGINT) AS depth, {key_sql('x', 'y', 'z', 2, 6)} AS parent, (x // 8) % 2 + 2 * ((y // 8) % 2) + 4 * ((z // 8) % 2) AS child,
      {morton_sql('(x - x % 16)', '(y - y % 16)', '(z - z % 16)', 6)} + 3 AS first_sibling, {morton_sql('(x - x % 16 + 8)', '(y - y % 16 + 8)', '(z - z % 16 + 8)', 6)} + 3 AS last_sibling,
      {key_sql('x', 'y', 'z', 1, 6)} AS top, true AS below, x + CASE WHEN x % 16 >= 8 THEN 8 ELSE 0 END AS far_x, y + CASE WHEN y % 16 >= 8 THEN 8 ELSE 0 END AS far_y, z + CASE WHEN z % 16 >= 8 THEN 8 ELSE 0 END AS far_z FROM blocks""",
    "key_neighbours": f"{_BLOCKS}, near AS (SELECT x, y, z, face, greatest(0, least(63, x + dx)) AS nx, greatest(0, least(63, y + dy)) AS ny, greatest(0, least(63, z + dz)) AS nz FROM blocks, (VALUES (0, -8, 0, 0), (1, 8, 0, 0), (2, 0, -8, 0), (3, 0, 8, 0), (4, 0, 0, -8), (5, 0, 0, 8)) f(face, dx, dy, dz)) SELECT *, {key_sql('nx', 'ny', 'nz', 3, 6)} AS key FROM near",
    "key_exterior": f"{_BLOCKS}, near AS (SELECT DISTINCT {_KEY} + 3 AS key, greatest(0, least(56, x + a * CASE WHEN x % 16 >= 8 THEN 8 ELSE -8 END)) AS nx, greatest(0, least(56, y + b * CASE WHEN y % 16 >= 8 THEN 8 ELSE -8 END)) AS ny, greatest(0, least(56, z + c * CASE WHEN z % 16 >= 8 THEN 8 ELSE -8 END)) AS nz FROM blocks, (VALUES (0), (1)) i(a), (VALUES (0), (1)) j(b), (VALUES (0), (1)) k(c) WHERE a + b + c > 0) SELECT key, count(*) AS n, min({key_sql('nx', 'ny', 'nz', 3, 6)}) AS first, max({key_sql('nx', 'ny', 'nz', 3, 6)}) AS last FROM near GROUP BY key",
    "key_ancestry": f"{_BLOCKS} " + " UNION ALL ".join(f"SELECT {key_sql('x', 'y', 'z', d, 6)} AS ancestor, count(*) AS blocks FROM blocks GROUP BY 1" for d in range(3)),
    "coordinates": f"{_P} SELECT DISTINCT x, y, z, (x + 0.5e0) * 5e-2 AS mx, (y + 0.5e0) * 5e-2 AS my, (z + 0.5e0) * 5e-2 AS mz, x % 8 + y % 8 * 8 + z % 8 * 64 AS index, ((x % 8 + y % 8 * 8) % 4) * 2 AS sx, (x % 8 + y % 8 * 8) // 4 % 4 * 2 AS sy, (x % 8 + y % 8 * 8) // 16 * 2 AS sz, CAST(CASE x % 4 WHEN 0 THEN 0 WHEN 1 THEN 512 WHEN 2 THEN 576 ELSE 584 END AS BIGINT) AS offset, CAST(floor((x + 0.5e0) * 5e-2 / 4e-1) AS BIGINT) AS cx, CAST(floor((y + 0.5e0) * 5e-2 / 4e-1) AS BIGINT) AS cy, CAST(floor((z + 0.5e0) * 5e-2 / 4e-1) AS BIGINT) AS cz FROM points",
    "filter_ancestors": f"{_P}, {_WANT} SELECT {_KEY} + d AS key FROM want a WHERE NOT EXISTS (SELECT 1 FROM want b WHERE b.d > a.d AND b.x - b.x % {_SIZE.format('a.d')} = a.x AND b.y - b.y % {_SIZE.format('a.d')} = a.y AND b.z - b.z % {_SIZE.format('a.d')} = a.z)",
    "unique_multiscale": f"{_P}, {_WANT} SELECT {_KEY} + max(d) AS key FROM want GROUP BY x, y, z",
    "allocate": f"{_P}, {_WANT}, have AS (SELECT x, y, z FROM occupied WHERE s > 5 * n), every AS (SELECT d, x, y, z FROM want{_UP.format('want')}) SELECT {_KEY} + d AS key, CAST(d AS BIGINT) AS depth FROM every WHERE NOT (d = 3 AND (x, y, z) IN (SELECT (x, y, z) FROM have))",
    "delete_subtrees": f"{_BLOCKS}, want AS (SELECT 3 AS d, x, y, z FROM blocks), every AS (SELECT d, x, y, z FROM want{_UP.format('want')}) SELECT {_KEY} + d AS key FROM every WHERE d = 0 OR x < 32",
    "balance": f"""{_P}, {_LEAVES}, every AS (SELECT d, x, y, z FROM leaves UNION SELECT * FROM (
      SELECT d - 1 AS d, x - x % (1 << (7 - d)) + a * (1 << (7 - d)) AS x, y - y % (1 << (7 - d)) + b * (1 << (7 - d)) AS y, z - z % (1 << (7 - d)) + c * (1 << (7 - d)) AS z
      FROM every, (VALUES (0, 0, 0), (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)) f(a, b, c) WHERE d > 0) WHERE x BETWEEN 0 AND 63 AND y BETWEEN 0 AND 63 AND z BETWEEN 0 AND 63)
      SELECT {_KEY} + d AS key, CAST(d AS BIGINT) AS depth FROM every""",
    "boxes": f"""{_P}, p AS (SELECT DISTINCT x, y, z, o1, o2, o3, frame AS s FROM points), f AS (SELECT
      abs(2 * x + s - 56) <= s + 16 AND abs(2 * y + s - 56) <= s + 16 AND abs(2 * z + s - 56) <= s + 16 AS overlap,
      x > 20 AND x + s < 36 AND y > 20 AND y + s < 36 AND z > 20 AND z + s < 36 AS inside,
      x >= 20 AND x < 36 AND y >= 20 AND y < 36 AND z >= 20 AND z < 36 AS corner,
      CAST(greatest(0, least(x + s, 36) - greatest(x, 20)) * greatest(0, least(y + s, 36) - greatest(y, 20)) * greatest(0, least(z + s, 36) - greatest(z, 20)) AS DOUBLE) AS v FROM p)
      SELECT overlap, inside, corner, count(*) AS n, sum(v) AS volume FROM f GROUP BY 1, 2, 3""",
}
