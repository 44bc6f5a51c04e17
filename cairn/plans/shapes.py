"""Queries over shapes in the map."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import shapes
from .relations import relation, sql

DEPTH = 5


def _shapes(spark, sf_dir):
    """A sphere or a cylinder for each order, some over the map's border."""
    p = relation(spark, sf_dir, "dense").groupBy("o1").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.min("z").alias("z"))
    a = p.select(F.col("o1").alias("shape"), *[(F.col(k) + F.col("o1") % (5 + i) * 0.173 + 0.0137).alias("a" + k) for i, k in enumerate("xyz")])
    tall = F.col("shape") % 2 == 1
    ends = [F.when(tall, F.col("a" + k) + F.col("shape") % m - c).otherwise(F.col("a" + k)).alias("b" + k) for k, m, c in (("x", 5, 1.9), ("y", 4, 1.1), ("z", 3, 0.7))]
    radius = F.when(tall, 0.83 + F.col("shape") % 4 * 0.5).otherwise(0.61 + F.col("shape") % 6 * 0.55)
    return a.select("*", *ends, radius.alias("radius"))


def shape_cover(spark, sf_dir):
    """Voxels of each shape's cover: their number and the sums of their coordinates."""
    c = shapes.cover(_shapes(spark, sf_dir), DEPTH)
    cube = F.col("size") * F.col("size") * F.col("size")
    sums = [F.sum(cube * F.col(k) + F.floor(cube * (F.col("size") - 1) / 2)).cast("long").alias("s" + k) for k in "xyz"]
    return c.groupBy("shape").agg(F.sum(cube).alias("cells"), *sums)


def shape_status(spark, sf_dir):
    leaves = relation(spark, sf_dir, "voxels").withColumn("size", F.lit(1))
    return shapes.status(shapes.cover(_shapes(spark, sf_dir), DEPTH), leaves, DEPTH, -2.0)


QUERIES = {f.__name__: f for f in (shape_cover, shape_status)}

_SHAPES = f"""{sql('voxels')}, a AS (SELECT o1 AS shape, x + (o1 % 5) * 0.173e0 + 0.0137e0 AS ax, y + (o1 % 6) * 0.173e0 + 0.0137e0 AS ay, z + (o1 % 7) * 0.173e0 + 0.0137e0 AS az FROM (SELECT o1, min(x) AS x, max(y) AS y, min(z) AS z FROM dense GROUP BY o1)),
  axes AS (SELECT *, CASE WHEN shape % 2 = 1 THEN shape % 5 - 1.9e0 ELSE 0 END AS lx, CASE WHEN shape % 2 = 1 THEN shape % 4 - 1.1e0 ELSE 0 END AS ly, CASE WHEN shape % 2 = 1 THEN shape % 3 - 0.7e0 ELSE 0 END AS lz, CASE WHEN shape % 2 = 1 THEN 0.83e0 + (shape % 4) * 0.5e0 ELSE 0.61e0 + (shape % 6) * 0.55e0 END AS r FROM a),
  near AS (SELECT *, CAST(floor(ax) AS BIGINT) + i AS x, CAST(floor(ay) AS BIGINT) + j AS y, CAST(floor(az) AS BIGINT) + k AS z FROM axes, (SELECT unnest(range(-5, 7)) AS i), (SELECT unnest(range(-5, 7)) AS j), (SELECT unnest(range(-5, 7)) AS k)),
  offs AS (SELECT *, x + 0.5e0 - ax AS px, y + 0.5e0 - ay AS py, z + 0.5e0 - az AS pz, lx * lx + ly * ly + lz * lz AS ll FROM near WHERE least(x, y, z) >= 0 AND greatest(x, y, z) < 32),
  along AS (SELECT *, CASE WHEN ll > 0 THEN (px * lx + py * ly + pz * lz) / ll ELSE 0 END AS t FROM offs),
  cells AS (SELECT shape, x, y, z FROM along WHERE t BETWEEN 0 AND 1 AND pow(px - t * lx, 2) + pow(py - t * ly, 2) + pow(pz - t * lz, 2) <= r * r)"""
ORACLE = {
    "shape_cover": f"{_SHAPES} SELECT shape, count(*) AS cells, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(z) AS BIGINT) AS sz FROM cells GROUP BY shape",
    "shape_status": f"{_SHAPES} SELECT shape, bool_and(coalesce(value < -2, false)) AS free, bool_or(coalesce(value > -2, false)) AS occupied, count(*) AS cells FROM cells LEFT JOIN voxels USING (x, y, z) GROUP BY shape",
}
