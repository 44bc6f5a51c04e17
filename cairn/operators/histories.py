"""Histories of poses, and statistics of measurements."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars


def pose_cells(poses: DataFrame, resolution: float, yaw_bins: int) -> DataFrame:
    """Adds ix, iy, iz, iyaw."""
    return poses.withColumns({f"i{k}": F.floor(F.col(k) / resolution).cast("long") for k in "xyz"} | {"iyaw": F.floor(scalars.wrap_2pi(F.col("yaw")) / (2 * math.pi) * yaw_bins).cast("long") % yaw_bins})


def pose_grid(poses: DataFrame, resolution: float, yaw_bins: int, most: int = 255) -> DataFrame:
    """Visits of each cell, saturating."""
    return pose_cells(poses, resolution, yaw_bins).groupBy("ix", "iy", "iz", "iyaw").agg(F.least(F.count("*"), F.lit(most)).alias("visits"))


def rejection(grid: DataFrame, yaw_bins: int) -> DataFrame:
    """Share of a position's yaws that were visited."""
    return grid.groupBy("ix", "iy", "iz").agg((F.countDistinct("iyaw") / yaw_bins).alias("rejection"))


def density_rejection(candidates: DataFrame, history: DataFrame, id_col: str, sigma: tuple[float, float, float, float], reach: float) -> DataFrame:
    """Greatest normal density of a candidate's pose around past poses within reach, over the density at 0.

    Cells of that size pair candidates' poses (equal ones once) with past positions, not with past poses: of a position's yaws only the
    nearest one counts, and a sort by yaw leaves four that it can be, the ones beside the candidate's and, around the turn, the first and the last.
    """
    pose, spot, cells = ["x", "y", "z", "yaw"], ["hx", "hy", "hz"], ["cx", "cy", "cz"]
    turn = lambda c: scalars.wrap_2pi(F.col(c))
    cell = lambda k: F.floor(F.col(k) / reach).cast("long")
    near = F.explode(F.array(*[F.struct(*[(F.lit(v)).alias(n) for n, v in zip("abc", o)]) for o in itertools.product((-1, 0, 1), repeat=3)]))
    asked = candidates.select(pose).distinct().withColumn("o", near).select(*pose, *[(cell(k) + F.col(f"o.{n}")).alias("c" + k) for k, n in zip("xyz", "abc")])
    past = history.select(*[F.col(k).alias("h" + k) for k in pose]).distinct().withColumn("__t", turn("hyaw"))
    spots = past.groupBy(spot).agg(F.min_by("hyaw", "__t").alias("__first"), F.max_by("hyaw", "__t").alias("__last")).select("*", *[cell("h" + k).alias("c" + k) for k in "xyz"])
    pairs = asked.join(spots, cells).select(*spot, *pose, "__first", "__last", turn("yaw").alias("__t"), F.lit(None).cast("double").alias("hyaw"))
    both = pairs.unionByName(past.select(*spot, F.col("hyaw").cast("double").alias("hyaw"), "__t", F.lit(True).alias("__past")), allowMissingColumns=True)
    upto = lambda order: F.last("hyaw", True).over(Window.partitionBy(spot).orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    told = both.select(*spot, *pose, "__past", "__first", "__last", upto(F.col("__t")).alias("__back"), upto(F.col("__t").desc()).alias("__ahead")).where("__past is null")

    def power(yaw: str) -> Column:
        d = [F.col(k) - F.col("h" + k) for k in "xyz"] + [scalars.angle_difference(F.col("yaw"), F.col(yaw))]
        return sum(((x / s) * (x / s) for x, s in zip(d, sigma)), F.lit(0.0))

    least = F.least(*map(power, ("__first", "__last", "__back", "__ahead")))
    best = told.groupBy(pose).agg(F.exp(-F.min(least) / 2).alias("rejection"))
    return candidates.select(id_col, *pose).join(best, pose, "left").select(id_col, F.coalesce("rejection", F.lit(0.0)).alias("rejection"))


def metric_summary(samples: DataFrame) -> DataFrame:
    """(key, ...) of samples (key, iter, seq, value): iterations are summarised first; mean is the mean of their means."""
    each = samples.groupBy("key", "iter").agg(F.avg("value").alias("mean"), F.sum("value").alias("sum"), F.min("value").alias("least"), F.max("value").alias("most"), F.max_by("value", "seq").alias("last"))
    return each.groupBy("key").agg(F.avg("mean").alias("mean"), F.sum("sum").alias("sum"), F.min("least").alias("min"), F.max("most").alias("max"), F.max_by("last", "iter").alias("last"), F.count("*").alias("iterations"))


#: How samples of an iteration merge, by the kind of metric.
MERGE = {"COUNT": "sum", "DURATION": "sum", "CURRENT": "max", "ENERGY": "max", "MEMORY": "max", "POWER": "max", "VOLTAGE": "max", "FREQUENCY": "mean"}


def merge_iterations(samples: DataFrame) -> DataFrame:
    """One value for each (key, type, iter), merged as its type asks: sum, maximum, mean, or the last."""
    how = F.create_map(*[F.lit(x) for pair in MERGE.items() for x in pair])
    each = samples.groupBy("key", "type", "iter").agg(F.sum("value").alias("sum"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.max_by("value", "seq").alias("last"))
    kind = F.coalesce(how[F.col("type")], F.lit("last"))
    return each.select("key", "type", "iter", F.when(kind == "sum", F.col("sum")).when(kind == "max", F.col("max")).when(kind == "mean", F.col("mean")).otherwise(F.col("last")).alias("value"))


def column_summary(results: DataFrame, columns: list[str], order: str) -> DataFrame:
    """mean, median, std, min, max and last of each column, a row for each."""
    long = results.select(order, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("s")).select(order, "s.*")
    return long.groupBy("column").agg(F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.max_by("value", order).alias("last"))


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The element in the middle of the sorted values, the upper one of two. Ranks come from counts of equal values, so a group's rows are not listed."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    line = Window.partitionBy(*keys)
    ranked = counts.withColumn("upto", F.sum("n").over(line.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(line))
    return ranked.where((F.col("upto") > F.floor(F.col("total") / 2)) & (F.col("upto") - F.col("n") <= F.floor(F.col("total") / 2))).select(*keys, F.col(value).alias("median"))
