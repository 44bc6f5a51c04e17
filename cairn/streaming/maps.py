"""Maps kept up to date by streams of observations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import frontiers, histories


def fuse_stream(observations: DataFrame, order: list[str], value: str, max_weight: float = 100.0) -> DataFrame:
    """Running voxels (vx, vy, vz, value, weight, n) of a stream of observations (vx, vy, vz, order, value), an update for each voxel seen in a micro-batch.

    Each voxel's capped weighted mean is state in Spark's store. Within a micro-batch observations are folded in order; over
    micro-batches in the order of their arrival, as an online map does.
    """
    def step(key, batches, state: GroupState):
        x, y, n = state.get if state.exists else (0.0, 0.0, 0)
        seen = pd.concat(list(batches)).sort_values(order)
        for v in seen[value]:
            x, y, n = (x * y + v) / (y + 1), min(y + 1, max_weight), n + 1
        state.update((float(x), float(y), int(n)))
        yield pd.DataFrame({"vx": [key[0]], "vy": [key[1]], "vz": [key[2]], "value": [float(x)], "weight": [float(y)], "n": [int(n)]})

    return observations.groupBy("vx", "vy", "vz").applyInPandasWithState(step, "vx long, vy long, vz long, value double, weight double, n long", "x double, y double, n long", "update", GroupStateTimeout.NoTimeout)


def least_so_far(observations: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Monotone minima (least distance, least scale) of a stream; safe to repeat."""
    return observations.groupBy(*keys).agg(F.min(value).alias(value))


def visits(poses: DataFrame, resolution: float, yaw_bins: int, most: int = 255) -> DataFrame:
    """Pose grid of a stream of poses."""
    return histories.pose_grid(poses, resolution, yaw_bins, most)


def every(frames: DataFrame, rate: int, first: int = 3) -> DataFrame:
    """Frames that a stage with a rate handles: the first ones, then each multiple."""
    return frames.where((F.col("frame") <= first) | (F.col("frame") % rate == 0))


class MapTable:
    """A voxel table and its frontier blocks, brought up to date by foreachBatch.

    Each batch's voxels replace older ones; frontiers are found anew. Tables are numbered by batch and the older one is kept
    until the next is complete, so a repeated batch starts from the same state and ends the same.
    """

    def __init__(self, spark, path: str, depth_of_map: int, min_ratio: float = 0.0):
        self.spark, self.path, self.depth, self.min_ratio = spark, path.rstrip("/"), depth_of_map, min_ratio

    def voxels(self, batch: int) -> DataFrame:
        schema = "x long, y long, z long, value double, weight double"
        return self.spark.createDataFrame([], schema) if batch < 0 else self.spark.read.schema(schema).parquet(f"{self.path}/voxels-{batch}")

    def frontier(self, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/frontier-{batch}")

    def update(self, changed: DataFrame, batch: int) -> None:
        fresh = changed.select(F.col("vx").alias("x"), F.col("vy").alias("y"), F.col("vz").alias("z"), "value", "weight")
        old = self.voxels(batch - 1).join(fresh.select("x", "y", "z"), ["x", "y", "z"], "left_anti")
        old.unionByName(fresh).write.mode("overwrite").parquet(f"{self.path}/voxels-{batch}")
        frontiers.frontier_blocks(self.voxels(batch), self.depth, self.min_ratio).write.mode("overwrite").parquet(f"{self.path}/frontier-{batch}")
