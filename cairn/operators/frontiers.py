"""Frontiers of the explored space, and volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, morton
from ..sources.scratch import measured
from .lookup import neighbours


def frontier_voxels(voxels: DataFrame, edge: int, surface: float = 0.0) -> DataFrame:
    """Free voxels (value under the surface) with a neighbour in the map that is not known."""
    near = neighbours(voxels, edge).where("inside and value is null").select("x", "y", "z").distinct()
    return voxels.where(F.col("value") < surface).join(near, ["x", "y", "z"], "left_semi")


def frontier_blocks(voxels: DataFrame, depth_of_map: int, min_ratio: float = 0.0, surface: float = 0.0) -> DataFrame:
    """(key, volume, ratio) of the blocks whose frontier voxels make up more than none and at least min_ratio of them."""
    found = frontier_voxels(voxels, 1 << depth_of_map, surface)
    key = morton.encode(F.col("x"), F.col("y"), F.col("z"), depth_of_map - morton.BLOCK_SCALE, depth_of_map)
    sums = found.groupBy(key.alias("key")).agg(F.count("*").alias("volume"))
    return sums.select("key", "volume", (F.col("volume") / 512).alias("ratio")).where((F.col("volume") > 0) & (F.col("ratio") >= min_ratio))


def explored_volume(leaves: DataFrame, low=None, high=None, voxel_dim: float = 1.0, surface: float = 0.0) -> DataFrame:
    """One row: explored, free and occupied volume of valid leaves (x, y, z, size, value, weight), clipped to a box if there is one."""
    at = [F.col(k) * voxel_dim for k in "xyz"]
    size = [F.col("size") * voxel_dim] * 3
    volume = size[0] * size[1] * size[2] if low is None else geometry.overlap_volume(at, size, [F.lit(float(x)) for x in low], [F.lit(float(h - x)) for x, h in zip(low, high)])
    free = F.col("value") < surface
    valid = leaves.where("weight > 0").select(volume.alias("v"), free.alias("free"))
    return valid.agg(F.sum("v").alias("explored"), F.sum(F.when(F.col("free"), F.col("v")).otherwise(0.0)).alias("free"), F.sum(F.when(F.col("free"), 0.0).otherwise(F.col("v"))).alias("occupied"))


def box_status(boxes: DataFrame, blocks: DataFrame, voxels: DataFrame, edge: int, id_col: str = "box") -> DataFrame:
    """(box, status) of integer boxes (x, y, z, nx, ny, nz): occupied if a voxel in it is, else unseen if one is not known, else empty.

    The fold over voxels does not depend on their order: occupied wins over unseen, and that over empty.
    """
    span = lambda k: F.explode(F.sequence(F.greatest(F.col(k), F.lit(0)), F.least(F.col(k) + F.col("n" + k), F.lit(edge)) - 1))
    cells = boxes.select(id_col, span("x").alias("vx"), "y", "z", "ny", "nz").select(id_col, "vx", span("y").alias("vy"), "z", "nz").select(id_col, F.col("vx").alias("x"), F.col("vy").alias("y"), span("z").alias("z"))
    seen = cells.join(voxels.select("x", "y", "z", "value"), ["x", "y", "z"], "left")
    return seen.groupBy(id_col).agg(F.when(F.max(F.coalesce(F.col("value") > 0, F.lit(False))), "occupied").when(F.max(F.col("value").isNull()), "unseen").otherwise("empty").alias("status"))


def sphere_free(spheres: DataFrame, voxels: DataFrame, threshold: float = 0.0, id_col: str = "sphere") -> DataFrame:
    """Whether all voxels whose centres lie in a sphere (x, y, z, radius; in voxels) are known and under the threshold."""
    span = lambda k: F.explode(F.sequence(F.ceil(F.col(k) - F.col("radius") - 0.5).cast("long"), F.floor(F.col(k) + F.col("radius") - 0.5).cast("long")))
    cells = spheres.select("*", span("x").alias("vx")).select("*", span("y").alias("vy")).select("*", span("z").alias("vz"))
    off = [F.col("v" + k) + 0.5 - F.col(k) for k in "xyz"]
    inside = cells.where(off[0] * off[0] + off[1] * off[1] + off[2] * off[2] <= F.col("radius") * F.col("radius"))
    seen = inside.select(id_col, F.col("vx").alias("x"), F.col("vy").alias("y"), F.col("vz").alias("z")).join(measured(voxels.select("x", "y", "z", "value"), "voxels"), ["x", "y", "z"], "left")
    return seen.groupBy(id_col).agg(F.min(F.coalesce(F.col("value") < threshold, F.lit(False))).alias("free"), F.count("*").alias("cells"))
