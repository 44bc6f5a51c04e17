"""Sets of keys: deduplication across depths, allocation with all ancestors, pruning, balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import morton
from ..sources.scratch import Scratch


def filter_ancestors(keys: DataFrame, depth_of_map: int) -> DataFrame:
    """Distinct keys none of whose descendants is listed too. An equi-join on exploded strict ancestors, which are deduplicated before they move."""
    keys = keys.select("key").distinct()
    above = keys.select(F.explode(morton.ancestors(F.col("key"), depth_of_map)).alias("key")).distinct()
    return keys.join(above, "key", "left_anti")


def unique_multiscale(keys: DataFrame) -> DataFrame:
    """Of keys with one corner, the deepest."""
    return keys.groupBy(morton.code(F.col("key")).alias("code")).agg(F.max(morton.depth(F.col("key"))).alias("depth")).select((F.col("code") + F.col("depth")).alias("key"))


def with_ancestors(keys: DataFrame, depth_of_map: int, lowest: int = 0) -> DataFrame:
    return keys.select(F.explode(F.concat(F.array("key"), morton.ancestors(F.col("key"), depth_of_map, lowest))).alias("key")).distinct()


def allocate(existing: DataFrame, wanted: DataFrame, depth_of_map: int) -> DataFrame:
    """Keys to insert so that all wanted ones and their ancestors exist."""
    return with_ancestors(filter_ancestors(wanted, depth_of_map), depth_of_map).join(existing.select("key"), "key", "left_anti")


def delete_subtrees(keys: DataFrame, roots: DataFrame, depth_of_map: int) -> DataFrame:
    """Keys that neither are roots nor lie below one."""
    up = keys.select("key", F.explode(F.concat(F.array("key"), morton.ancestors(F.col("key"), depth_of_map))).alias("up"))
    gone = up.join(roots.select(F.col("key").alias("up")), "up", "left_semi").select("key").distinct()
    return keys.join(gone, "key", "left_anti")


def delete_up_to(keys: DataFrame, depth: int) -> DataFrame:
    """Keys no deeper than a depth."""
    return keys.where(morton.depth(F.col("key")) <= depth)


def allocate_down_to(keys: DataFrame, depth: int, depth_of_map: int) -> DataFrame:
    """Adds all descendants of the deepest level down to a depth: eight for each key and level."""
    deepest = keys.agg(F.max(morton.depth(F.col("key")))).first()[0]
    level, out = keys.where(morton.depth(F.col("key")) == deepest), keys
    for _ in range(deepest or 0, depth):
        level = level.select(F.explode(F.array(*[morton.child(F.col("key"), i, depth_of_map) for i in range(8)])).alias("key"))
        out = out.unionByName(level)
    return out


def balance(keys: DataFrame, depth_of_map: int) -> DataFrame:
    """Adds keys until the parent of each octant has all its face neighbours: depths of neighbours differ by one at most.

    Octants ask level by level, from the deepest up: a level needs only what the one below it has asked for, so the number of
    steps is the map's depth and not a matter of data.
    """
    scratch = Scratch(keys.sparkSession, "balance")
    edge, out = 1 << depth_of_map, scratch.save(with_ancestors(keys, depth_of_map), "keys")
    for d in range(depth_of_map, 1, -1):  # each level is written, so the plan stays small
        up = out.where(morton.depth(F.col("key")) == d).select(morton.prefix(F.col("key"), d - 1, depth_of_map).alias("key")).distinct()
        x, y, z = morton.coords(F.col("key"), depth_of_map)
        near = up.select(F.explode(morton.face_neighbours(x, y, z, 1 << (depth_of_map - d + 1), edge)).alias("n"))
        asked = near.select(morton.encode(F.col("n.x"), F.col("n.y"), F.col("n.z"), d - 1, depth_of_map).alias("key")).distinct()
        out = scratch.save(out.unionByName(with_ancestors(asked, depth_of_map)).distinct(), f"depth{d}")
    return out


def band_blocks(rays: DataFrame, voxel_dim: float, band: float, depth_of_map: int) -> DataFrame:
    """Keys of the blocks that rays pass within `band` before and behind their measured points.

    rays: origin ox, oy, oz and point px, py, pz. Samples lie one voxel apart.
    """
    n = max(1, int(-(-2 * band // voxel_dim)))
    d = [F.col(f"p{k}") - F.col(f"o{k}") for k in "xyz"]
    length = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    t = F.col("i") * F.lit(2 * band / n) - band
    at = [F.col(f"p{k}") + F.try_divide(c, length) * t for k, c in zip("xyz", d)]
    cells = rays.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n)))).select(*[F.floor(c / voxel_dim).cast("long").alias(k) for k, c in zip("xyz", at)])
    edge = 1 << depth_of_map
    inside = cells.where(" and ".join(f"{k} >= 0 and {k} < {edge}" for k in "xyz"))
    return inside.select(morton.encode(F.col("x"), F.col("y"), F.col("z"), depth_of_map - morton.BLOCK_SCALE, depth_of_map).alias("key")).distinct()
