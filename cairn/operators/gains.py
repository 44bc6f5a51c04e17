"""What a view would gain: finer scales and shorter distances of the blocks that its rays hit, and how finely objects are mapped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.geometry import inverse_transform


def gain_images(hits: DataFrame, blocks: DataFrame, orientation, position, voxel_dim: float, focal: float, far: float, desired_scale: int = 0, desired_dist: float = 0.0, keys: tuple[str, ...] = ("u", "v")) -> DataFrame:
    """(keys, scale_gain, dist_gain) of each pixel, 0 to 1: what the block that its ray hits would gain if it were seen from here.

    hits: keys and hx, hy, hz in metres, null without a hit; blocks: x, y, z (corners in voxels), min_scale, min_dist, last_scale.
    orientation (unit quaternion x, y, z, w) and position take the camera to the map; numbers, or columns of hits. A block's
    expected scale follows from its centre's depth, the expected distance is that depth; pixels that hit no block gain nothing.
    An equi-join on the hit's block.
    """
    lit = lambda c: F.lit(float(c)) if isinstance(c, (int, float)) else c
    cell = [(F.floor(F.col("h" + k) / (8 * voxel_dim)) * 8).cast("long").alias(k) for k in "xyz"]
    told = hits.select("*", *cell).join(blocks.select("x", "y", "z", "min_scale", "min_dist", "last_scale"), ["x", "y", "z"], "left")
    centre = inverse_transform([lit(c) for c in orientation], [lit(c) for c in position], [(F.col(k) + 4) * voxel_dim for k in "xyz"])
    z = centre[2]
    expected = scalars.integration_scale(z, focal, voxel_dim, F.col("last_scale"))
    scale = scalars.scale_gain(F.col("min_scale"), expected, F.lit(desired_scale)) / (3.0 - desired_scale)
    dist = scalars.distance_gain(F.col("min_dist"), z, desired_dist, far)
    known = F.col("min_scale").isNotNull()
    return told.select(*keys, F.when(known, scale).otherwise(0.0).alias("scale_gain"), F.when(known, dist).otherwise(0.0).alias("dist_gain"))


def scale_shares(blocks: DataFrame, keys: list[str] = []) -> DataFrame:
    """(keys, share0 .. share3, gain): the shares of blocks whose finest scale so far is each one, and of those that aren't at the finest; keys: for each object, none: for all together."""
    scales = [F.avg((F.col("min_scale") == s).cast("double")).alias(f"share{s}") for s in range(4)]
    return blocks.groupBy(*keys).agg(*scales, F.avg((F.col("min_scale") > 0).cast("double")).alias("gain"))


def visible_only(objects: DataFrame, visible: DataFrame, id_col: str = "obj_id") -> DataFrame:
    """Objects that are seen, a semi-join."""
    return objects.join(visible.select(id_col).distinct(), id_col, "left_semi")


def nearest_hits(hits: DataFrame, objects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, obj_id, min_scale, expected): of each pixel's hits on objects (keys, obj_id, dist, fg, min_scale, expected) the nearest valid one.

    objects: obj_id, voxel_dim, kind (thing, stuff or background). Hits on the background count as one voxel farther, on stuff as half
    of one; a hit counts if its foreground probability (for the background the complement) is over a half. Of equally near ones the
    most probable, then the smallest id.
    """
    told = hits.join(objects.select("obj_id", "voxel_dim", "kind"), "obj_id")
    behind = F.when(F.col("kind") == "background", F.col("voxel_dim")).when(F.col("kind") == "stuff", F.col("voxel_dim") / 2).otherwise(0.0)
    fg = F.when(F.col("kind") == "background", 1 - F.col("fg")).otherwise(F.col("fg"))
    good = told.withColumns({"__d": F.col("dist") + behind, "__p": fg}).where("__p > 0.5")
    best = F.min_by(F.struct("obj_id", "min_scale", "expected"), F.struct("__d", -F.col("__p"), "obj_id"))
    return good.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.obj_id", "b.min_scale", "b.expected")


def view_gain(nearest: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, obj_id, pixels, gain): for each object in a view, the share of its pixels whose blocks aren't at the finest scale and would get finer."""
    finer = (F.col("min_scale") > 0) & (F.col("expected") < F.col("min_scale"))
    return nearest.groupBy(*keys, "obj_id").agg(F.count("*").alias("pixels"), F.avg(finer.cast("double")).alias("gain"))


def seeded_normal(key: Column, seed: int) -> Column:
    """A standard normal number for each key, the same in every run: two uniform numbers from its digest, by the polar form of Box and Muller."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    u, v = ((F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 0.5) / 4294967296.0 for at in (1, 9))
    return F.sqrt(-2 * F.log(u)) * F.cos(6.283185307179586 * v)


def add_depth_noise(image: DataFrame, key: Column, k_sigma: float, low: float, high: float, seed: int = 0) -> DataFrame:
    """Depths with normal noise of a deviation that grows with the depth, between low and high; pixels without depth stay. key tells pixels apart, so that a repeated task draws the same."""
    sigma = scalars.clamp(k_sigma * F.col("depth"), low, high)
    return image.withColumn("depth", F.when(F.col("depth") > 0, F.col("depth") + sigma * seeded_normal(key, seed)).otherwise(F.col("depth")))
