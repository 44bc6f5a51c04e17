"""Integrating depth images into voxels, and bounding volumes of what is mapped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.geometry import Pinhole, inverse_transform, norm


def project_voxels(voxels: DataFrame, image: DataFrame, camera: Pinhole, position, voxel_dim: float, keys: tuple[str, ...] = (), orientation=None, extra: tuple[str, ...] = ()) -> DataFrame:
    """The projective join: each voxel (x, y, z and more) whose centre falls on a pixel (u, v) with depth > 0, with depth and sdf.

    The camera stands at a position and looks along z, or as an orientation (unit quaternion x, y, z, w, from the camera to the
    map) turns it; both may be numbers or columns of voxels. sdf is the measured minus the voxel's distance along the voxel's ray,
    positive before the surface. keys: columns that voxels and image share, such as a frame's number; extra: more columns of the
    image, such as colours or masks. An equi-join on the pixel, so voxels and images are dealt by pixel and neither has to be small.
    """
    centre = [(F.col(k) + 0.5) * voxel_dim for k in "xyz"]
    at = [F.lit(p) if isinstance(p, (int, float)) else p for p in position]
    if orientation is None:
        centre = [c - p for c, p in zip(centre, at)]
    else:
        centre = inverse_transform([F.lit(c) if isinstance(c, (int, float)) else c for c in orientation], at, centre)
    voxels = voxels.withColumn("__c", F.array(*centre))
    centre = [F.col("__c")[k] for k in range(3)]
    u, v, seen = camera.project(centre)
    placed = voxels.withColumns({"u": u, "v": v, "__pz": centre[2], "__range": norm(centre)}).where(seen)
    measured = image.where("depth > 0").select(*keys, "u", "v", "depth", *extra)
    sdf = (F.col("depth") - F.col("__pz")) / F.col("__pz") * F.col("__range")
    return placed.join(measured, [*keys, "u", "v"]).withColumn("sdf", sdf).drop("__pz", "__range", "__c")


def update_tsdf(seen: DataFrame, band: float, max_weight: float) -> DataFrame:
    """Voxels no farther than the band behind the surface get the running mean of truncated distances (in bands), and one more weight."""
    sample = scalars.clamp(F.col("sdf") / band, -1.0, 1.0)
    mean = scalars.clamp((F.col("value") * F.col("weight") + sample) / (F.col("weight") + 1), -1.0, 1.0)
    return seen.where(F.col("sdf") > -band).withColumns({"value": mean, "weight": F.least(F.col("weight") + 1, F.lit(max_weight))})


def update_occupancy(seen: DataFrame, k_sigma: float, sigma_low: float, sigma_high: float, k_tau: float, tau_low: float, tau_high: float, max_weight: float) -> DataFrame:
    """Voxels that the inverse sensor model says something of get the weighted mean of its log-odds."""
    sigma3 = scalars.three_sigma(F.col("depth"), k_sigma, sigma_low, sigma_high)
    tau = scalars.surface_thickness(F.col("depth"), k_tau, tau_low, tau_high)
    told = seen.withColumn("sample", scalars.occupancy_sample(-F.col("sdf"), sigma3, tau)).where("sample is not null")
    mean = (F.col("value") * F.col("weight") + F.col("sample")) / (F.col("weight") + 1)
    return told.withColumns({"value": mean, "weight": F.least(F.col("weight") + 1, F.lit(max_weight))})


def bounds(points: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """min_ and max_ of each axis: the box around each group, and the merge of boxes of its parts."""
    return points.groupBy(*keys).agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("n"))


def bounding_spheres(boxes: DataFrame, axes: list[str]) -> DataFrame:
    """Adds centre_ of each axis and radius of the sphere around each box."""
    middle = {f"centre_{a}": (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 for a in axes}
    return boxes.withColumns(middle).withColumn("radius", norm([F.col(f"max_{a}") - F.col(f"min_{a}") for a in axes]) / 2)
