"""Propagating voxel data to coarser scales and to the root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def coarser(voxels: DataFrame, by: int = 2) -> DataFrame:
    """Mean and maximum over the 2 x 2 x 2 children with data (y > 0) of each voxel at the next scale.

    voxels: x, y, z (multiples of the voxel's size), scale, value, weight, observed, frontier. max_value and max_weight are those
    of the child with the greatest value * weight, first in x, y, z on ties; a parent is observed if all 8 are, and a
    frontier if one is.
    """
    stride = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("scale") + 1).cast("int"))
    at = [(F.col(k) - F.col(k) % stride).alias(k) for k in "xyz"]
    valid = F.col("weight") > 0
    first = F.struct(F.col("value") * F.col("weight"), -F.col("z"), -F.col("y"), -F.col("x"))
    return voxels.where(valid).groupBy(*at, (F.col("scale") + 1).alias("scale")).agg(
        F.avg("value").alias("value"), F.ceil(F.sum("weight") / F.count("*")).cast("double").alias("weight"), F.max_by(F.struct("value", "weight"), first).alias("best"),
        (F.sum(F.col("observed").cast("int")) == by**3).alias("observed"), F.max("frontier").alias("frontier"), F.count("*").alias("children"),
    ).select("x", "y", "z", "scale", "value", "weight", F.col("best.value").alias("max_value"), F.col("best.weight").alias("max_weight"), "observed", "frontier", "children")


def pyramid(voxels: DataFrame, scales: int) -> DataFrame:
    """Voxels of all scales up to `scales`, mean data only; each level aggregates the one below, which is written."""
    scratch, level, out = Scratch(voxels.sparkSession, "pyramid"), voxels, voxels
    for k in range(scales):
        level = scratch.save(coarser(level).select("x", "y", "z", "scale", "value", "weight", "observed", "frontier"), f"level{k}")
        out = out.unionByName(level)
    return out


def prunable(nodes: DataFrame, min_occupancy: float) -> DataFrame:
    """Nodes whose subtree says no more than they do: observed, no frontier, and as free as can be."""
    return nodes.where(F.col("observed") & ~F.col("frontier") & (F.col("value") * F.col("weight") <= 0.95 * min_occupancy))


def propagate_to_root(blocks: DataFrame, depth_of_map: int, min_occupancy: float) -> DataFrame:
    """Maxima from the blocks' level to the root, with what may be pruned at each level.

    blocks: x, y, z, scale, value, weight, observed, frontier. A node takes its greatest child (value * weight).
    """
    scratch, level, out = Scratch(blocks.sparkSession, "root"), blocks, blocks.select("x", "y", "z", "scale", "value", "weight", "observed", "frontier")
    first = min(3, depth_of_map)
    for k in range(first, depth_of_map):
        up = coarser(level)
        level = scratch.save(up.select("x", "y", "z", "scale", F.col("max_value").alias("value"), F.col("max_weight").alias("weight"), "observed", "frontier"), f"level{k}")
        out = out.unionByName(level)
    return out.withColumn("pruned", F.col("observed") & ~F.col("frontier") & (F.col("value") * F.col("weight") <= 0.95 * min_occupancy))
