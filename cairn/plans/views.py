"""Queries over what views would gain, and over segmentations of frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import gains, images, segments
from .relations import relation, sql


def _blocks(spark, sf_dir):
    """Blocks of the map with the finest scale and the least distance that they have been seen at, by their voxels."""
    v = relation(spark, sf_dir, "voxels").groupBy(*[(F.col(k) - F.col(k) % 8).alias(k) for k in "xyz"]).agg(F.count("*").alias("n"), F.sum("weight").cast("long").alias("w"))
    return v.select("x", "y", "z", (F.col("w") % 4).cast("int").alias("min_scale"), (1.5 + F.col("w") % 17 * 0.25).alias("min_dist"), (F.col("n") % 4).cast("int").alias("last_scale"))


def _hits(spark, sf_dir):
    """A hit for each pixel of the image, in the map of 32 voxels of 0.1 m; some pixels have none."""
    far = F.when(F.col("v") % 11 != 5, F.lit(1.0))
    return relation(spark, sf_dir, "image").select("u", "v", (F.col("u") * 0.05 * far).alias("hx"), (F.col("v") * 0.05 * far).alias("hy"), (F.col("depth") * 0.5 * far).alias("hz"))


def gain_images(spark, sf_dir):
    found = gains.gain_images(_hits(spark, sf_dir), _blocks(spark, sf_dir), (0.0, 0.28, 0.0, 0.96), (0.4, 1.55, -0.53), 0.1, 12.0, 6.0, 1, 0.7)
    return found.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in ("scale_gain", "dist_gain")})


def object_gains(spark, sf_dir):
    """For each frame and object in it, the share of its pixels that would get finer; of objects that the frame's detections show."""
    p = relation(spark, sf_dir, "object_pixels")
    objects = p.select("obj_id").distinct().select("obj_id", (0.01 * F.col("obj_id")).alias("voxel_dim"), F.element_at(F.array(*map(F.lit, ("thing", "stuff", "background"))), (F.col("obj_id") % 3 + 1).cast("int")).alias("kind"))
    number = F.col("obj_id") * 7 + F.col("u") * 3 + F.col("v") * 5 + F.col("frame")
    hits = p.select("frame", "obj_id", F.col("u"), F.col("v"), (1 + number % 5 * 0.02).alias("dist"), (number % 10 / 10.0 + 0.03).alias("fg"), (number % 4).cast("int").alias("min_scale"), (number % 3).cast("int").alias("expected"))
    seen = gains.visible_only(hits, p.where("v > 40"))
    found = gains.view_gain(gains.nearest_hits(seen, objects, ["frame", "u", "v"]), ["frame"])
    return found.withColumn("gain", F.round("gain", 9))


def scale_shares(spark, sf_dir):
    """Of the blocks in each layer of the map, and of all (layer -1)."""
    b = _blocks(spark, sf_dir).withColumn("layer", F.col("z") / 8)
    every = gains.scale_shares(b.withColumn("layer", F.lit(-1.0)), ["layer"]).unionByName(gains.scale_shares(b, ["layer"]))
    return every.select(F.col("layer").cast("long").alias("layer"), *[F.round(c, 9).alias(c) for c in every.columns[1:]])


def noisy_depths(spark, sf_dir):
    i = relation(spark, sf_dir, "image").withColumn("depth", F.when((F.col("u") + F.col("v")) % 9 == 0, 0.0).otherwise(F.col("depth")))
    return gains.add_depth_noise(i, F.col("v") * 4096 + F.col("u"), 0.01, 0.005, 0.03, 11).select("u", "v", F.round("depth", 9).alias("depth"))


def downsampled_colour(spark, sf_dir):
    i = relation(spark, sf_dir, "depths").select("frame", "u", "v", scalars.pack_rgba((F.col("u") * 5 + F.col("v")) % 256, (F.col("u") * F.col("v")) % 256, F.col("v") % 256).alias("rgba"))
    return images.downsample_colour(i, 4, ["frame"])


def absorbed_masks(spark, sf_dir):
    """Which object's mask takes each detection of a frame."""
    masks = relation(spark, sf_dir, "pixels")
    return segments.absorb(relation(spark, sf_dir, "object_pixels"), masks, 0.3)[0]


def label_images(spark, sf_dir):
    """The last object over each pixel with a valid depth."""
    p = relation(spark, sf_dir, "object_pixels")
    depth = relation(spark, sf_dir, "pixels").select("frame", "u", "v", (F.col("det_id") / 10).alias("depth")).groupBy("frame", "u", "v").agg(F.min("depth").alias("depth"))
    return segments.label_image(segments.valid_only(p, depth, 0.5, 3.0), "obj_id", "obj_id")


QUERIES = {f.__name__: f for f in (gain_images, object_gains, scale_shares, noisy_depths, downsampled_colour, absorbed_masks, label_images)}

_BLOCKS = "blocks AS (SELECT x, y, z, w % 4 AS min_scale, 1.5e0 + (w % 17) * 0.25e0 AS min_dist, n % 4 AS last_scale FROM (SELECT x - x % 8 AS x, y - y % 8 AS y, z - z % 8 AS z, count(*) AS n, CAST(sum(weight) AS BIGINT) AS w FROM voxels GROUP BY 1, 2, 3))"
# the camera's rotation is about y alone: a depth is the third row of its inverse times the way from the camera
_Z = "(2 * 0.28e0 * 0.96e0 * ((x + 4) * 0.1e0 - 0.4e0) + (1 - 2 * 0.28e0 * 0.28e0) * ((z + 4) * 0.1e0 + 0.53e0))"
_U = "((CAST('0x' || sha256('11:' || CAST(v * 4096 + u AS VARCHAR))[{0}:{1}] AS BIGINT) + 0.5e0) / 4294967296e0)"
_GAINS = "CAST(CASE WHEN min_scale = {0} THEN 1 ELSE 0 END AS DOUBLE)"
_SHARES = ", ".join(f"round(avg({_GAINS.format(s)}), 9) AS share{s}" for s in range(4)) + ", round(avg(CASE WHEN min_scale > 0 THEN 1e0 ELSE 0e0 END), 9) AS gain"
ORACLE = {
    "gain_images": f"""{sql('voxels', 'image')}, {_BLOCKS}, hits AS (SELECT u, v, CASE WHEN v % 11 <> 5 THEN CAST(floor(u * 5e-2 / 0.8e0) * 8 AS BIGINT) END AS x, CAST(floor(v * 5e-2 / 0.8e0) * 8 AS BIGINT) AS y, CAST(floor(depth * 0.5e0 / 0.8e0) * 8 AS BIGINT) AS z FROM image),
      seen AS (SELECT u, v, b.*, {_Z.replace('x +', 'b.x +').replace('z +', 'b.z +')} AS d FROM hits LEFT JOIN blocks b USING (x, y, z)), r AS (SELECT *, d / 1.2e0 AS ratio FROM seen),
      e AS (SELECT *, CASE WHEN ratio < [0, 1.25, 2.75, 5.75][last_scale + 1] THEN last_scale - 1 WHEN ratio > [1.75, 3.25, 6.25, 1e300][last_scale + 1] THEN last_scale + 1 ELSE last_scale END AS expected FROM r)
      SELECT u, v, round(CASE WHEN min_scale IS NULL OR min_scale <= 1 OR expected >= min_scale THEN 0e0 ELSE (min_scale - greatest(expected, 1)) / 2e0 END, 9) AS scale_gain,
        round(CASE WHEN min_dist IS NULL OR min_dist <= 0.7e0 OR d >= min_dist THEN 0e0 ELSE (min_dist - greatest(d, 0.7e0)) / 6e0 END, 9) AS dist_gain FROM e""",
    "object_gains": f"""{sql('object_pixels')}, n AS (SELECT *, obj_id * 7 + u * 3 + v * 5 + frame AS k FROM object_pixels WHERE obj_id IN (SELECT obj_id FROM object_pixels WHERE v > 40)),
      h AS (SELECT *, 1 + (k % 5) * 0.02e0 + CASE obj_id % 3 WHEN 2 THEN 0.01e0 * obj_id WHEN 1 THEN 0.01e0 * obj_id / 2 ELSE 0 END AS d, CASE obj_id % 3 WHEN 2 THEN 1 - ((k % 10) / 10e0 + 0.03e0) ELSE (k % 10) / 10e0 + 0.03e0 END AS p FROM n),
      r AS (SELECT *, row_number() OVER (PARTITION BY frame, u, v ORDER BY d, p DESC, obj_id) AS n FROM h WHERE p > 0.5e0)
      SELECT frame, obj_id, count(*) AS pixels, round(avg(CASE WHEN k % 4 > 0 AND k % 3 < k % 4 THEN 1e0 ELSE 0e0 END), 9) AS gain FROM r WHERE n = 1 GROUP BY frame, obj_id""",
    "scale_shares": f"{sql('voxels')}, {_BLOCKS} SELECT CAST(-1 AS BIGINT) AS layer, {_SHARES} FROM blocks UNION ALL SELECT z // 8, {_SHARES} FROM blocks GROUP BY 1",
    "noisy_depths": f"{sql('image')}, i AS (SELECT u, v, CASE WHEN (u + v) % 9 = 0 THEN 0e0 ELSE depth END AS depth FROM image) SELECT u, v, round(CASE WHEN depth > 0 THEN depth + greatest(0.005e0, least(0.03e0, 0.01e0 * depth)) * sqrt(-2 * ln({_U.format(1, 8)})) * cos(6.283185307179586e0 * {_U.format(9, 16)}) ELSE depth END, 9) AS depth FROM i",
    "downsampled_colour": f"{sql('depths')}, s AS (SELECT frame, u // 4 AS u, v // 4 AS v, sum((u * 5 + v) % 256) // 16 AS r, sum((u * v) % 256) // 16 AS g, sum(v % 256) // 16 AS b FROM depths GROUP BY 1, 2, 3) SELECT frame, u, v, CAST(r + 256 * g + 65536 * b + 4278190080 AS BIGINT) AS rgba FROM s",
    "label_images": f"{sql('object_pixels', 'pixels')}, d AS (SELECT frame, u, v, min(det_id / 10e0) AS depth FROM pixels GROUP BY 1, 2, 3) SELECT frame, u, v, max(obj_id) AS obj_id FROM object_pixels JOIN d USING (frame, u, v) WHERE depth BETWEEN 0.5e0 AND 3e0 GROUP BY 1, 2, 3",
}
