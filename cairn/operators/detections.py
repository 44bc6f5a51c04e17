"""Detections as sparse mask pixels (frame, det_id, u, v) and class confidences; matching them with objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import argmax


def mask_overlap(left: DataFrame, right: DataFrame, left_id: list[str], right_id: list[str], on: list[str]) -> DataFrame:
    """Intersection, union, IoU and greatest share of two masks' pixels, for pairs that share some. Pixels are distinct rows."""
    na = left.groupBy(*left_id).agg(F.count("*").alias("area_left"))
    nb = right.groupBy(*right_id).agg(F.count("*").alias("area_right"))
    both = left.join(right, on).groupBy(*dict.fromkeys([*left_id, *right_id])).agg(F.count("*").alias("common"))
    out = both.join(na, left_id).join(nb, right_id)
    return out.withColumn("iou", F.col("common") / (F.col("area_left") + F.col("area_right") - F.col("common"))).withColumn("share", F.greatest(F.col("common") / F.col("area_left"), F.col("common") / F.col("area_right")))


def match_objects(pixels: DataFrame, objects: DataFrame, least: float = 0.25) -> DataFrame:
    """(frame, det_id, obj_id, share): each detection's object of greatest share over `least`, the lowest id on ties; else null.

    objects: visible objects' mask pixels (frame, obj_id, u, v).
    """
    scored = mask_overlap(pixels, objects, ["frame", "det_id"], ["frame", "obj_id"], ["frame", "u", "v"]).where(F.col("share") > least)
    best = scored.groupBy("frame", "det_id").agg(F.max_by(F.struct("obj_id", "share"), F.struct("share", -F.col("obj_id"))).alias("b"))
    return pixels.select("frame", "det_id").distinct().join(best, ["frame", "det_id"], "left").select("frame", "det_id", "b.obj_id", "b.share")


def undetected(objects: DataFrame, matches: DataFrame, background: int = 0) -> DataFrame:
    """(frame, obj_id) of visible objects, the background aside, that no detection matched."""
    visible = objects.where(F.col("obj_id") != background).select("frame", "obj_id").distinct()
    return visible.join(matches.where("obj_id is not null").select("frame", "obj_id"), ["frame", "obj_id"], "left_anti")


def remove_small(pixels: DataFrame, total: int, least: float = 0.02) -> DataFrame:
    """Pixels of detections that cover at least that share of an image."""
    large = pixels.groupBy("frame", "det_id").agg(F.count("*").alias("n")).where(F.col("n") >= least * total)
    return pixels.join(large.select("frame", "det_id"), ["frame", "det_id"], "left_semi")


def keep_classes(detections: DataFrame, classes: DataFrame, least: float = 0.0) -> DataFrame:
    """Detections of enabled classes whose confidence is high enough, with class_id and confidence."""
    told = detections.withColumn("class_id", argmax(F.col("conf"))).withColumn("confidence", F.array_max("conf"))
    return told.where(F.col("confidence") >= least).join(classes.where("enabled").select(F.col("class_id").cast("bigint").alias("class_id")), "class_id", "left_semi")


def merge_confidences(detections: DataFrame, key: str) -> DataFrame:
    """Mean confidence vector of each key, weighted by update counts, with its class: the first greatest; -1 if all are near 0."""
    long = detections.select(key, "n_updates", F.posexplode("conf").alias("class_id", "c"))
    mean = long.groupBy(key, "class_id").agg((F.sum(F.col("n_updates") * F.col("c").cast("double")) / F.sum("n_updates")).alias("c"))
    # as many rows for a key as there are classes
    merged = mean.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("class_id", "c"))).alias("v"), F.max(F.abs("c")).alias("most"))
    merged = merged.select(key, F.transform("v", lambda s: s["c"]).alias("conf"), "most")
    return merged.select(key, "conf", F.when(F.col("most") > 1e-6, argmax(F.col("conf"))).otherwise(-1).alias("class_id"))


def background(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(frame, u, v) of all pixels in no detection's mask."""
    grid = pixels.select("frame").distinct().select("frame", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("u")).select("frame", "u", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("v"))
    return grid.join(pixels.select("frame", "u", "v"), ["frame", "u", "v"], "left_anti")


def instance_mask(pixels: DataFrame) -> DataFrame:
    """(frame, u, v, det_id): where masks overlap, the later detection shows."""
    return pixels.groupBy("frame", "u", "v").agg(F.max("det_id").alias("det_id"))


def depth_outliers(points: DataFrame, keys: list[str], sigma: float = 0.5) -> DataFrame:
    """Without pixels over three deviations behind the mean of their mask, where the deviation is over sigma."""
    stats = points.groupBy(*keys).agg(F.avg("depth").alias("mean"), F.stddev_pop("depth").alias("dev"))
    return points.join(stats, keys).where((F.col("dev") <= sigma) | (F.col("depth") - F.col("mean") <= 3 * F.col("dev"))).drop("mean", "dev")


def nearest_hits(hits: DataFrame, key: list[str], least_fg: float = 0.5) -> DataFrame:
    """Each ray's nearest object hit with enough foreground, the greater foreground on ties, then the lower id."""
    first = Window.partitionBy(*key).orderBy("dist", F.col("fg").desc(), "obj_id")
    return hits.where(F.col("fg") > least_fg).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def occluded(objects: DataFrame, scene: DataFrame, voxel_dim: float) -> DataFrame:
    """Pixels where an object's depth is over four voxels off the scene's."""
    return objects.join(scene.withColumnRenamed("depth", "scene_depth"), ["u", "v"]).where(F.abs(F.col("depth") - F.col("scene_depth")) > 4 * voxel_dim).drop("scene_depth")


def scale_histogram(blocks: DataFrame, key: str = "obj_id", scales: int = 4) -> DataFrame:
    """For each object: blocks, their share at each least scale, least and greatest scale, and whether it is finished (over 90 % at scale 0)."""
    n = F.count("*")
    shares = [(F.sum((F.col("min_scale") == s).cast("int")) / n).alias(f"share_{s}") for s in range(scales)]
    return blocks.groupBy(key).agg(n.alias("blocks"), *shares, F.min("min_scale").alias("least"), F.max("min_scale").alias("most")).withColumn("finished", F.col("share_0") > 0.9)


def object_extent(points: DataFrame, key: str = "obj_id", resolution: float = 0.05) -> DataFrame:
    """Bounds of each object's points (the origin means none), its map's edge in metres (2.5 extents, 5 at most) and voxels (a power of two, 2048 at most)."""
    seen = points.where("px <> 0 or py <> 0 or pz <> 0").groupBy(key).agg(*[f(k).alias(f"{n}_{k}") for k in ("px", "py", "pz") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))], F.count("*").alias("n"))
    extent = F.greatest(*[F.col(f"max_{k}") - F.col(f"min_{k}") for k in ("px", "py", "pz")])
    dim = F.least(2.5 * extent, F.lit(5.0))
    size = F.least(F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(dim / resolution, F.lit(1.0)))) + 1), F.lit(2048.0)).cast("long")
    return seen.withColumn("map_dim", dim).withColumn("map_size", size)
