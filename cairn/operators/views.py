"""Entropy along rays, the best window of yaw, gains, and the choice of a view."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, scalars
from ..sources.scratch import measured


def ray_grid(width: int, height: int, vertical_fov: float, spark) -> DataFrame:
    """(u, v, dx, dy, dz): a unit ray for each pixel of an image of 360 degrees."""
    pixels = spark.range(width * height).select((F.col("id") % width).alias("u"), F.floor(F.col("id") / width).alias("v"))
    d = geometry.direction(geometry.azimuth(F.col("u"), width), geometry.polar(F.col("v"), height, vertical_fov))
    return pixels.select("u", "v", *[c.alias("d" + k) for k, c in zip("xyz", d)])


def ray_entropy(rays: DataFrame, voxels: DataFrame, near: float, far: float, step: float, edge: int, id_cols: list[str], surface: float = 0.0) -> DataFrame:
    """Entropy that each ray (o, d; in voxels) meets, over the most it could meet.

    Samples lie `step` apart from near to far. A ray ends behind its first occupied sample, or where it leaves the map;
    voxels that are not known have probability a half. voxels: x, y, z, value, weight.
    """
    n = int(round((far - near) / step))
    at = rays.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    t = near + F.col("i") * step
    cells = at.select(*id_cols, "i", *[F.floor(F.col("o" + k) + F.col("d" + k) * t).cast("long").alias(k) for k in "xyz"])
    inside = F.lit(True)
    for k in "xyz":
        inside = inside & F.col(k).between(0, edge - 1)
    known = measured(voxels.select("x", "y", "z", (F.col("value") * F.col("weight")).alias("l")), "voxels")
    seen = cells.withColumn("out", ~inside).join(known, ["x", "y", "z"], "left")
    h = scalars.entropy(scalars.probability(F.coalesce("l", F.lit(0.0))))
    # a column for each sample, so that a ray's samples need no order
    line = seen.groupBy(*id_cols).agg(*[F.max(F.when((F.col("i") == i) & ~F.col("out"), h)).alias(f"__h{i}") for i in range(n)], F.min(F.when(F.col("out") | (F.col("l") > surface), F.col("i"))).alias("__stop"))
    sums = line.select(*id_cols, sum((F.when(F.coalesce("__stop", F.lit(n)) >= i, F.coalesce(f"__h{i}", F.lit(0.0))).otherwise(0.0) for i in range(n)), F.lit(0.0)).alias("h"))
    return rays.select(*id_cols).join(sums, id_cols, "left").select(*id_cols, (F.coalesce("h", F.lit(0.0)) / n).alias("entropy"))


def window_width(width: int, horizontal_fov: float) -> int:
    return int(width * horizontal_fov / (2 * math.pi) + 0.5)


def yaw_windows(image: DataFrame, width: int, horizontal_fov: float, keys: list[str] = [], value: str = "entropy") -> DataFrame:
    """(keys, start, mean) of each window of columns that a camera sees, wrapping around."""
    w = window_width(width, horizontal_fov)
    starts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda i: F.pmod(F.col("u") - i, F.lit(width)))).alias("start")
    # columns first: a window sums few numbers instead of pixels
    columns = image.groupBy(*keys, "u").agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    return columns.select(*keys, "s", "n", starts).groupBy(*keys, "start").agg((F.sum("s") / F.sum("n")).alias("mean"))


def best_yaw(windows: DataFrame, width: int, horizontal_fov: float, keys: list[str] = []) -> DataFrame:
    """(keys, start, mean, yaw): the first window of greatest mean, and the yaw of its middle."""
    best = F.max_by(F.struct("start", "mean"), F.struct(F.round("mean", 9), -F.col("start"))).alias("b")
    got = windows.groupBy(*keys).agg(best)
    return got.select(*keys, "b.start", "b.mean", (geometry.azimuth(F.col("b.start"), width) - horizontal_fov / 2).alias("yaw"))


def utility(candidates: DataFrame, weights: dict[str, float], seconds: str = "seconds") -> DataFrame:
    """Weighted gains over the time to get there; null, so never chosen, without motion."""
    gain = F.lit(0.0)
    for k, w in weights.items():
        gain = gain + w * F.coalesce(F.col(k), F.lit(0.0))
    return candidates.withColumn("gain", gain).withColumn("utility", F.try_divide(F.col("gain"), F.col(seconds)))


def best_candidate(candidates: DataFrame, keys: list[str], id_col: str, value: str = "utility") -> DataFrame:
    """The valid candidate of greatest value for each key, the lowest id on ties; NaN and null are not valid."""
    valid = candidates.where(F.col(value).isNotNull() & ~F.isnan(value))
    best = F.max_by(F.struct(id_col, value), F.struct(F.col(value), -F.col(id_col))).alias("b")
    return valid.groupBy(*keys).agg(best).select(*keys, f"b.{id_col}", f"b.{value}")


def stratified_sample(keys: DataFrame, rounds: int, depth_of_map: int, level: int, seed: int = 0) -> DataFrame:
    """`rounds` keys from each octant at depth `level`, spread by a seeded hash; the cells are the strata."""
    from ..functions import morton

    cell = morton.prefix(F.col("key"), level, depth_of_map)
    order = Window.partitionBy("cell").orderBy(F.xxhash64("key", F.lit(seed)), "key")
    return keys.withColumn("cell", cell).withColumn("round", F.row_number().over(order)).where(F.col("round") <= rounds)
