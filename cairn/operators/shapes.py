"""Spheres and cylinders in the map: covered by the largest octants that lie in them, checked and freed by those."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import morton
from ..functions.geometry import dot, norm
from ..sources.scratch import Scratch


def _place(p) -> tuple[Column, Column]:
    """Of a point: how far along a shape's axis it lies (unit vector ux, uy, uz from a on; 0 for a sphere), and its squared distance from the axis."""
    off = [x - F.col("a" + k) for x, k in zip(p, "xyz")]
    along = dot(off, [F.col("u" + k) for k in "xyz"])
    return along, dot(off, off) - along * along


def _inside(p) -> Column:
    along, apart = _place(p)
    return (along >= 0) & (along <= F.col("length")) & (apart <= F.col("radius") * F.col("radius"))


#: Octants of at most this size are divided within their task; larger ones are spread again, level by level.
SPREAD = 16


def _divided(octants: DataFrame) -> DataFrame:
    """Octants (x, y, z, size, whole) one step on: whole ones and single voxels stay, those within become whole, those that stay clear go, the others give way to their eight children."""
    rest = [c for c in octants.columns if c not in ("x", "y", "z", "size", "whole")]
    centre = [F.col(k) + F.col("size") / 2.0 for k in "xyz"]
    along, apart = _place(centre)
    # from the centre to the outermost voxels' centres: along an axis, along the shape's axis and in all
    half = (F.col("size") - 1) / 2.0
    lean, clear = half * sum((F.abs(F.col("u" + k)) for k in "xyz"), F.lit(0.0)), half * math.sqrt(3)
    farthest = [F.abs(c - F.col("a" + k)) + half for c, k in zip(centre, "xyz")]
    placed = octants.select("*", along.alias("__along"), F.sqrt(F.greatest(apart, F.lit(0.0))).alias("__apart"), lean.alias("__lean"), clear.alias("__clear"), dot(farthest, farthest).alias("__farthest"))
    along, apart, lean, clear = (F.col(c) for c in ("__along", "__apart", "__lean", "__clear"))
    # the nearest voxel centre is no nearer to the axis' line, or to its ends along it, than this
    away = (apart > F.col("radius") + clear + 1e-6) | (along < -clear - 1e-6) | (along > F.col("length") + clear + 1e-6)
    sphere = F.col("__farthest") <= F.col("radius") * F.col("radius") - 1e-6
    within = F.when(F.col("length") == 0, sphere).otherwise((along - lean >= 1e-6) & (along + lean <= F.col("length") - 1e-6) & (apart + clear <= F.col("radius") - 1e-6))
    one = lambda *i: F.array(*map(F.lit, i)).cast("array<int>")
    step = F.when(F.col("whole"), one(-1)).when(away, one()).when(F.col("size") == 1, one(-2)).when(within, one(-1)).otherwise(one(*range(8)))
    split, size = F.col("i") >= 0, F.shiftright("size", 1)
    at = [F.when(split, F.col(k) + F.shiftright("i", n).bitwiseAND(F.lit(1)) * size).otherwise(F.col(k)).alias(k) for n, k in enumerate("xyz")]
    return placed.select(*rest, "x", "y", "z", "size", F.explode(step).alias("i")).select(*rest, *at, F.when(split, size).otherwise(F.col("size")).alias("size"), (F.col("i") == -1).alias("whole"))


def cover(shapes: DataFrame, depth_of_map: int, id_col: str = "shape") -> DataFrame:
    """(shape, x, y, z, size): disjoint octants that hold exactly the voxels of the map whose centres lie in each shape.

    shapes: id, ax, ay, az, bx, by, bz, radius, in voxels: a cylinder with its axis from a to b and flat ends, or a sphere where both are
    the same point. An octant is taken whole if the centres of its outermost voxels lie within (for a cylinder: if the sphere around them
    does); it is left out if that sphere stays clear; else its eight children are asked, down to voxels, which are judged by their centres. So there are about as many rows as voxels on
    the shape's surface, not within it. Shapes are written once; octants of over SPREAD voxels along an edge are written level by
    level, so that a giant shape is shared out, and smaller ones are divided in one pass without a shuffle.
    """
    scratch = Scratch(shapes.sparkSession, "cover")
    line = ["ax", "ay", "az", "ux", "uy", "uz", "length", "radius"]
    edge = 1 << depth_of_map
    reach = [(F.least(F.col("a" + k), F.col("b" + k)) - F.col("radius"), F.greatest(F.col("a" + k), F.col("b" + k)) + F.col("radius")) for k in "xyz"]
    # the smallest size of which two octants along each axis span the shape
    span = F.greatest(*[high - low for low, high in reach], F.lit(1.0))
    size = F.least(F.lit(edge), F.pow(F.lit(2.0), F.ceil(F.log2(span)))).cast("long")
    axis = [(F.col("b" + k) - F.col("a" + k)).cast("double") for k in "xyz"]
    units = [F.coalesce(F.try_divide(d, norm(axis)), F.lit(0.0)).alias("u" + k) for d, k in zip(axis, "xyz")]
    sized = scratch.save(shapes.select(id_col, *[F.col(c).cast("double").alias(c) for c in ("ax", "ay", "az", "bx", "by", "bz", "radius")], *units, norm(axis).alias("length")).withColumn("size", size), "shapes")
    for k, (low, high) in zip("xyz", reach):
        first, last = F.floor(F.greatest(low, F.lit(0.0)) / F.col("size")), F.floor(F.least(high, F.lit(edge - 1.0)) / F.col("size"))
        sized = sized.withColumn(k, F.explode(F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<long>")))).withColumn(k, F.col(k) * F.col("size"))
    roots = sized.select(id_col, *line, "x", "y", "z", "size", F.lit(False).alias("whole"))
    large, small, step = roots.where(F.col("size") > SPREAD), roots.where(F.col("size") <= SPREAD), 0
    while large.limit(1).count():
        level = scratch.save(_divided(large), f"level{step}")
        ready = F.col("whole") | (F.col("size") <= SPREAD)
        large, small, step = level.where(~ready), small.unionByName(level.where(ready)), step + 1
    most = min(SPREAD, edge)
    while most > 1:
        small, most = _divided(small), most // 2
    centre = [F.col(k) + F.col("size") / 2.0 for k in "xyz"]
    return small.where(F.col("whole") | _inside(centre)).select(id_col, "x", "y", "z", "size")


def status(cover_of: DataFrame, leaves: DataFrame, depth_of_map: int, surface: float = 0.0, id_col: str = "shape") -> DataFrame:
    """(shape, free, occupied, cells): whether all of a shape's voxels are known to be free, whether one is occupied, and how many there are.

    leaves: the map's disjoint octants x, y, z, size, value. They are summed up once into the octants of every size that hold them, so
    that an octant of the cover asks one row for all leaves in it, and one more for each larger size that leaves have. The
    sums are written, so that Spark knows how small they are, and cover_of is read once.
    """
    scratch = Scratch(cover_of.sparkSession, "status")
    volume = lambda c: F.col(c) * F.col(c) * F.col(c)
    corner = lambda s: [(F.col(k) - F.col(k) % s).alias("c" + k) for k in "xyz"]
    ups = F.explode(F.filter(F.array(*[F.lit(1 << k).cast("long") for k in range(depth_of_map + 1)]), lambda s: s >= F.col("size"))).alias("s")
    held = leaves.select("x", "y", "z", F.col("size").cast("long").alias("size"), "value").select("*", ups).select(*corner(F.col("s")), "s", "size", "value")
    empty = F.sum(F.when(F.col("value") < surface, volume("size")).otherwise(0))
    summed = held.groupBy("cx", "cy", "cz", "s").agg(empty.alias("empty"), F.max(F.coalesce(F.col("value") > surface, F.lit(False))).alias("occupied"), F.max(F.col("size") == F.col("s")).alias("leaf"))
    summed = scratch.save(summed, "sums")
    # a map has few sizes
    sizes = [r["s"] for r in summed.where("leaf").select("s").distinct().collect()]
    asked = F.concat(F.array("size"), F.filter(F.array(*map(F.lit, sizes)).cast("array<long>"), lambda s: s > F.col("size"))) if max(sizes, default=1) > 1 else F.array("size")
    asks = cover_of.select(id_col, "x", "y", "z", "size", F.explode(asked).alias("s")).select(id_col, "size", "s", *corner(F.col("s")))
    found = asks.join(summed, ["cx", "cy", "cz", "s"], "left")
    own = F.col("s") == F.col("size")
    told = F.when(own, F.col("empty")).when(F.col("leaf") & (F.col("empty") > 0), volume("size")).otherwise(0)
    sums = found.groupBy(id_col).agg(F.sum(told).alias("empty"), F.max(F.col("occupied") & (own | F.col("leaf"))).alias("occupied"), F.sum(F.when(own, volume("size"))).alias("cells"))
    return sums.select(id_col, (F.coalesce("empty", F.lit(0)) == F.col("cells")).alias("free"), F.coalesce("occupied", F.lit(False)).alias("occupied"), "cells")


def keys(cover_of: DataFrame, depth_of_map: int) -> DataFrame:
    """(shape, key, whole) of the octants down to blocks that a cover touches: to be allocated, and whole if the cover holds all of it."""
    blocks = depth_of_map - morton.BLOCK_SCALE
    depth = F.least(F.lit(depth_of_map) - F.round(F.log2(F.col("size"))).cast("int"), F.lit(blocks))
    key = morton.encode(F.col("x"), F.col("y"), F.col("z"), depth.cast("long"), depth_of_map)
    rest = [c for c in cover_of.columns if c not in ("x", "y", "z", "size")]
    return cover_of.select(*rest, key.alias("key"), F.col("size")).groupBy(*rest, "key").agg(F.sum(F.col("size") * F.col("size") * F.col("size")).alias("v")).select(*rest, "key", (F.col("v") >= 512).alias("whole"))
