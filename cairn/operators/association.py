"""Matching streams by time, interpolating poses, and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars


def around(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """Each left row with the last right row at or before its time (prev) and the first at or after it (next), as structs.

    Both are sorted by key and time, once each way; equal right times keep the first by values. keys should spread the data (a sensor, a
    session); with none all rows are in one order, so a long stream should pass a coarse time bucket and widen it by its neighbours.
    """
    here = left.select(*keys, F.col(time).alias("__t"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(F.struct(F.col(time).alias("t"), *values).alias("s")).schema["s"].dataType).alias("__seen"))
    there = right.groupBy(*keys, F.col(time).alias("__t")).agg(F.min(F.struct(F.col(time).alias("t"), *values)).alias("__seen")).select(*keys, "__t", F.lit(None).cast(here.schema["__row"].dataType).alias("__row"), "__seen")
    both = here.unionByName(there)
    # both ways from an end on: a frame that runs to the last row is summed up anew for every row
    upto = lambda order: F.last("__seen", True).over(Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    told = both.select("__row", upto(F.col("__t")).alias("prev"), upto(F.col("__t").desc()).alias("next"))
    return told.where("__row is not null").select("__row.*", "prev", "next")


def bucketed(left: DataFrame, right: DataFrame, time: str, width: float) -> tuple[DataFrame, DataFrame]:
    """Both with a column bucket for around(): rows of the right are also in the buckets beside theirs, so none within `width` is missed."""
    b = F.floor(F.col(time) / width)
    return left.withColumn("bucket", b), right.withColumn("bucket", F.explode(F.array(b - 1, b, b + 1)))


def nearest(left: DataFrame, right: DataFrame, time: str, values: list[str], tolerance: float) -> DataFrame:
    """Left rows with the values of the right row nearest in time, the earlier on ties; rows without one within the tolerance are left out."""
    a, b = bucketed(left, right, time, tolerance)
    found = around(a, b, ["bucket"], time, values)
    back, ahead = F.col(time) - F.col("prev.t"), F.col("next.t") - F.col(time)
    pick = F.when(F.col("next").isNull() | (back <= ahead), F.col("prev")).otherwise(F.col("next"))
    told = found.withColumn("match", pick).where("match is not null").withColumn("gap", F.abs(F.col(time) - F.col("match.t"))).where(F.col("gap") <= tolerance)
    return told.select(*left.columns, *[F.col(f"match.{v}").alias(v) for v in values], "gap")


def interpolate_poses(frames: DataFrame, poses: DataFrame, time: str, most: float) -> DataFrame:
    """Each frame's pose at its time between the two around it, if these are at most `most` apart; other frames are dropped.

    poses: time, tx, ty, tz, qx, qy, qz, qw. Positions are interpolated linearly, orientations spherically.
    """
    values = ["tx", "ty", "tz", "qx", "qy", "qz", "qw"]
    a, b = bucketed(frames, poses, time, most)
    found = around(a, b, ["bucket"], time, values).where("prev is not null and next is not null").where(F.col("next.t") - F.col("prev.t") <= most)
    t = F.coalesce(F.try_divide(F.col(time) - F.col("prev.t"), F.col("next.t") - F.col("prev.t")), F.lit(0.0))
    place = [scalars.lerp(F.col(f"prev.{v}"), F.col(f"next.{v}"), t).alias(v) for v in values[:3]]
    turn = scalars.slerp([F.col(f"prev.{v}") for v in values[3:]], [F.col(f"next.{v}") for v in values[3:]], t)
    return found.select(*frames.columns, *place, *[q.alias(v) for v, q in zip(values[3:], turn)])


def segments(path: DataFrame, keys: list[str], order: str, speed: float, turning: float) -> DataFrame:
    """Consecutive poses (x, y, z, yaw) of each path: distance, yaw change the shorter way, and seconds, null for no motion."""
    ahead = Window.partitionBy(*keys).orderBy(order)
    step = [F.lead(k).over(ahead) - F.col(k) for k in "xyz"]
    out = path.select(*keys, order, F.sqrt(step[0] * step[0] + step[1] * step[1] + step[2] * step[2]).alias("distance"), scalars.angle_difference(F.col("yaw"), F.lead("yaw").over(ahead)).alias("turn"))
    return out.where("distance is not null").withColumn("seconds", scalars.path_time(F.col("distance"), F.col("turn"), speed, turning))


def densify(path: DataFrame, keys: list[str], order: str, step: float) -> DataFrame:
    """Poses no more than a step apart: positions interpolated between consecutive ones, the last pose added."""
    ahead = Window.partitionBy(*keys).orderBy(order)
    moved = path.select("*", *[F.lead(k).over(ahead).alias(f"__{k}") for k in "xyz"])
    d = [F.col(f"__{k}") - F.col(k) for k in "xyz"]
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) / step)).cast("int")
    many = moved.withColumn("__n", F.coalesce(n, F.lit(1))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return many.select(*keys, order, "part", *[F.coalesce(F.col(k) + (F.col(f"__{k}") - F.col(k)) * F.col("part") / F.col("__n"), F.col(k)).alias(k) for k in "xyz"])


def trajectory_error(estimate: DataFrame, truth: DataFrame, on: str) -> DataFrame:
    """One row: root mean square, mean, median, deviation, least and greatest distance of estimated and true positions."""
    both = estimate.select(on, "x", "y", "z").join(truth.select(on, *[F.col(k).alias("t" + k) for k in "xyz"]), on)
    d = [F.col(k) - F.col("t" + k) for k in "xyz"]
    e = both.select(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("e"))
    return e.agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("mean"), F.median("e").alias("median"), F.stddev_pop("e").alias("std"), F.min("e").alias("min"), F.max("e").alias("max"), F.count("*").alias("n"))
