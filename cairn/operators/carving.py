"""Allocation from depth images: which octants of a map a frame splits, frees or leaves alone, decided from pooled depths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, morton, scalars
from ..functions.geometry import Pinhole
from ..sources.scratch import Scratch


#: As many boxes as may be sent to all tasks, if Spark's measure of them says so. It knows the size of the octants' file only,
#: which is far less than that of their squares.
FEW = 100_000


def levels(width: int, height: int) -> int:
    """Sizes of pooled boxes: squares of 1, 2, 4 ... pixels, as large as fit."""
    return int(math.log2(min(width, height))) + 1


def pooled(image: DataFrame, width: int, height: int, keys: list[str], near: float = 0.0) -> DataFrame:
    """(keys, u, v, low, high, n): for squares of 1, 2, 4 ... pixels with their corner at u, v, the least and greatest valid depth and the number of valid pixels.

    A range-minimum structure: squares overlap, one begins at every pixel. image: keys, u, v, depth; a depth is valid over
    `near`, pixels without a row have none. Sizes are doubled along rows and then along columns, each by one step to the
    neighbour at that distance, so two shuffles do for all sizes, and a pixel's work is the square of their number.
    """
    k = levels(width, height)
    raster = image.select(*keys).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))))
    raster = raster.select(*keys, (F.col("i") % width).cast("long").alias("u"), F.floor(F.col("i") / width).cast("long").alias("v"))
    valid = F.when(F.col("depth") > near, F.col("depth").cast("double"))
    df = raster.join(image.where(F.col("u").between(0, width - 1) & F.col("v").between(0, height - 1)).select(*keys, F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), "depth"), [*keys, "u", "v"], "left")
    df = df.select(*keys, "u", "v", valid.alias("low0"), valid.alias("high0"), valid.isNotNull().cast("long").alias("n0"))

    def doubled(df: DataFrame, names: list[tuple[str, str]], step: int, window) -> DataFrame:
        pair = {"low": F.least, "high": F.greatest, "n": lambda a, b: a + F.coalesce(b, F.lit(0))}
        return df.withColumns({new: pair[old.rstrip("0123456789")](F.col(old), F.lead(old, step).over(window)) for old, new in names})

    row, column = Window.partitionBy(*keys, "v").orderBy("u"), Window.partitionBy(*keys, "u").orderBy("v")
    for i in range(1, k):
        df = doubled(df, [(f"{c}{i - 1}", f"{c}{i}") for c in ("low", "high", "n")], 1 << i - 1, row)
    for j in range(1, k):  # sizes that aren't square yet
        df = doubled(df, [(f"{c}{i}", f"{c}{i}") for c in ("low", "high", "n") for i in range(j, k)], 1 << j - 1, column)
    return df.select(*keys, "u", "v", *[F.array(*[f"{c}{i}" for i in range(k)]).alias(c) for c in ("low", "high", "n")])


def pool_boxes(boxes: DataFrame, pool: DataFrame, width: int, height: int, keys: list[str], box: list[str], few: bool = False) -> DataFrame:
    """(keys, box, low, high, known): the pixels from u0, v0 to u1, v1 (both included, within the image) of each box: exact least and greatest depth; known: all, part or none of the pixels are valid.

    A box is covered by the largest squares that fit, four unless one side is over twice the other, and each is one pooled row.
    Squares are dealt out to meet their pooled rows, so that a task holds few boxes at once; few leaves that to Spark.
    """
    most = levels(width, height) - 1
    short = F.least(F.col("u1") - F.col("u0"), F.col("v1") - F.col("v0")) + 1
    level = F.least(F.floor(F.log2(short.cast("double") + 0.5)).cast("int"), F.lit(most))
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))

    def corners(a: str, b: str) -> Column:
        last = F.col(b) - size + 1
        return F.array_distinct(F.concat(F.sequence(F.col(a).cast("long"), last, size), F.array(last)))

    asked = boxes.withColumn("level", level).select(*keys, *box, "level", F.explode(corners("u0", "u1")).alias("__u"), "v0", "v1")
    asked = asked.select(*keys, *box, "level", "__u", F.explode(corners("v0", "v1")).alias("__v"))
    at = F.col("level") + 1
    # squares over the image's border are never asked for
    within = F.floor(F.log2(F.least(width - F.col("u"), height - F.col("v")).cast("double") + 0.5)).cast("int") + 1
    pooled = pool.select(*keys, F.col("u").alias("__u"), F.col("v").alias("__v"), *[F.slice(c, F.lit(1), within).alias(c) for c in ("low", "high", "n")])
    got = (asked if few else asked.hint("merge")).join(pooled, [*keys, "__u", "__v"]).select(*keys, *box, *[F.element_at(c, at).alias(c) for c in ("low", "high", "n")], F.call_function("shiftleft", F.lit(1).cast("long"), 2 * F.col("level")).alias("all"))
    sums = got.groupBy(*keys, *box).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("n").alias("some"), F.min(F.col("n") == F.col("all")).alias("full"))
    return sums.select(*keys, *box, "low", "high", F.when(F.col("some") == 0, "none").when(F.col("full"), "all").otherwise("part").alias("known"))


def to_camera(frames: DataFrame) -> DataFrame:
    """Adds m, the 12 numbers that take a point of the map into the camera's frame: a matrix by rows, then a shift. frames: q (x, y, z, w) and t, from the camera to the map."""
    q, t = [F.col("q")[i] for i in range(4)], [F.col("t")[i] for i in range(3)]
    zero = [F.lit(0.0)] * 3
    columns = [geometry.inverse_transform(q, zero, [F.lit(float(i == k)) for i in range(3)]) for k in range(3)]
    return frames.withColumn("m", F.array(*[columns[k][i] for i in range(3) for k in range(3)], *geometry.inverse_transform(q, t, zero)))


def judge(octants: DataFrame, pool: DataFrame, camera: Pinhole, voxel_dim: float, sigma3: float, tau: float, known_free: DataFrame | None = None, few: bool = False) -> DataFrame:
    """Adds decision (split, free or skip), low_variance (-1 before the surface, 1 behind it, 0 mixed, null unless judged by depths) and inside (all pixels valid).

    octants: frame, key, corner x, y, z and size in voxels, and of the frame m (to_camera) and t, the camera's place. Octants out of
    reach, beside the image, without valid pixels or behind the surface are skipped; those around the camera, over the image's
    border, with invalid pixels or with depths near them are split; those that lie before all depths are free. known_free: keys
    that are observed and free: they are skipped unless depths near them could change that. few: FEW octants at most.
    """
    m, t, low = [F.col("m")[i] for i in range(12)], [F.col("t")[i] for i in range(3)], [F.col(k) * voxel_dim for k in "xyz"]
    side = F.col("size") * voxel_dim

    def at(*offset: Column) -> Column:
        """A point of the octant, offset in sizes, before the camera."""
        p = [a + o * side for a, o in zip(low, offset)]
        return F.struct(*[(m[3 * k] * p[0] + m[3 * k + 1] * p[1] + m[3 * k + 2] * p[2] + m[9 + k]).alias(n) for k, n in enumerate("xyz")])

    bit = lambda i, k: F.call_function("shiftright", i, F.lit(k)).bitwiseAND(F.lit(1))
    corners = F.transform(F.array(*map(F.lit, range(8))), lambda i: at(bit(i, 0), bit(i, 1), bit(i, 2)))
    half = F.lit(0.5)
    placed = octants.withColumns({"__corners": corners, "__centre": at(half, half, half)})
    pixel = lambda p: F.struct((camera.fx * p["x"] / p["z"] + camera.cx).alias("u"), (camera.fy * p["y"] / p["z"] + camera.cy).alias("v"))
    before = F.transform(F.filter("__corners", lambda p: p["z"] >= camera.near), pixel)
    radius = side * (math.sqrt(3) / 2)
    placed = placed.withColumns({"__pixels": before, "__z0": F.array_min("__corners.z"), "__z1": F.array_max("__corners.z")})
    placed = placed.withColumn("__front", F.size("__pixels"))
    seen = F.exists("__pixels", lambda p: (p["u"] >= -0.5) & (p["u"] < camera.width - 0.5) & (p["v"] >= -0.5) & (p["v"] < camera.height - 0.5))
    centred = [F.col(f"__centre.{k}") for k in "xyz"]
    holds = geometry.in_box(t, low, [c + side for c in low])
    placed = placed.withColumn("__near", F.when((centred[2] - radius > camera.far) | (centred[2] + radius < camera.near) | (F.col("__front") == 0), "skip").when(F.col("__front") < 8, F.when(holds | seen | camera.sphere_in_frustum(centred, radius, True), "split").otherwise("skip")))
    span = {f"{c}{n}": F.floor(f(F.col(f"__pixels.{c}"))).cast("long") for c in "uv" for n, f in ((0, F.array_min), (1, F.array_max))}
    boxed = placed.where("__near is null").withColumns(span)
    w, h = camera.width - 1, camera.height - 1
    out = (F.col("u1") < 0) | (F.col("v1") < 0) | (F.col("u0") > w) | (F.col("v0") > h)
    crossing = (F.col("u0") < 0) | (F.col("v0") < 0) | (F.col("u1") > w) | (F.col("v1") > h)
    boxed = boxed.where(~out).select("frame", "key", "__z0", "__z1", crossing.alias("__crossing"), *[F.greatest(F.lit(0), F.least(F.col(c), F.lit(m))).cast("long").alias(c) for c, m in (("u0", w), ("u1", w), ("v0", h), ("v1", h))])
    depths = pool_boxes(boxed, pool, camera.width, camera.height, ["frame"], ["key", "__z0", "__z1", "__crossing"], few)
    if known_free is None:
        free = F.lit(False)
    else:
        depths = depths.join(known_free.select("key").distinct().withColumn("__free", F.lit(True)), "key", "left")
        free = F.coalesce("__free", F.lit(False))
    variance = F.when(F.col("known") != "none", scalars.low_variance(F.col("__z0"), F.col("__z1"), F.col("low"), F.col("high"), F.lit(sigma3), F.lit(tau)))
    told = F.when((F.col("known") == "none") | (F.col("__z0") > F.col("high") + tau) | (variance != 0) & free, "skip").when(F.col("__crossing") | (F.col("known") == "part") | (variance == 0), "split").when(variance < 0, "free").otherwise("skip")
    depths = depths.select("frame", "key", told.alias("__told"), variance.alias("low_variance"), (F.col("known") == "all").alias("inside"))
    both = placed.select(*octants.columns, "__near").join(depths, ["frame", "key"], "left")
    return both.select(*octants.columns, F.coalesce("__near", "__told", F.lit("skip")).alias("decision"), "low_variance", F.coalesce("inside", F.lit(False)).alias("inside"))


def carve(frames: DataFrame, image: DataFrame, camera: Pinhole, voxel_dim: float, depth_of_map: int, sigma3: float, tau: float, known_free: DataFrame | None = None) -> DataFrame:
    """(frame, key, decision, low_variance, inside): the octants that each frame frees, and the blocks that it updates.

    frames: frame, q (array x, y, z, w) and t (array), the camera's pose in the map, in metres; image: frame, u, v, depth. From
    the root down each octant is judged by the depths that its projection covers; those to be split ask for their eight
    children, down to blocks. Work grows with the octants near surfaces and borders, not with the map. Each level is written.
    """
    scratch = Scratch(frames.sparkSession, "carving")
    pool = scratch.save(pooled(image, camera.width, camera.height, ["frame"]), "pool")
    root = [F.lit(0).cast("long").alias(k) for k in "xyz"]
    now = scratch.save(to_camera(frames).select("frame", "m", "t", *root, F.lit(1 << depth_of_map).cast("long").alias("size"), F.lit(0).cast("long").alias("key")), "root")
    blocks, ended, octants = depth_of_map - morton.BLOCK_SCALE, None, now.count()
    for d in range(blocks + 1):
        judged = scratch.save(judge(now, pool, camera, voxel_dim, sigma3, tau, known_free, octants <= FEW), f"depth{d}")
        octants = 8 * judged.where("decision = 'split'").count()
        done = judged.where("decision = 'free'") if d < blocks else judged.where("decision <> 'skip'").withColumn("decision", F.when(F.col("decision") == "split", "update").otherwise(F.col("decision")))
        done = done.select("frame", "key", "decision", "low_variance", "inside")
        ended = done if ended is None else ended.unionByName(done)
        step = F.explode(F.array(*[F.struct(*[F.lit(i >> k & 1).alias(n) for k, n in enumerate("xyz")], (F.lit(i << 3 * (depth_of_map - d - 1)) + F.lit(1)).alias("key")) for i in range(8)])).alias("c")
        now = judged.where("decision = 'split'").select("frame", "m", "t", "x", "y", "z", (F.col("size") / 2).cast("long").alias("size"), "key", step)
        # a child's key: its parent's, one bit of each axis more, and a depth greater by one
        now = now.select("frame", "m", "t", *[(F.col(k) + F.col(f"c.{k}") * F.col("size")).alias(k) for k in "xyz"], "size", (F.col("key") + F.col("c.key")).alias("key"))
    return ended


def ray_octants(rays: DataFrame, voxel_dim: float, depth_of_map: int, k_sigma: float, sigma_low: float, sigma_high: float, far: float) -> DataFrame:
    """Keys that rays ask for, from behind the measured point back to the camera: small steps within the band, then steps of 10 and 30 voxels, each at the depth whose octants are about as large.

    rays: camera ox, oy, oz, unit direction dx, dy, dz and the measured distance along the optical axis `depth`, with `range`, the
    distance of the point. Steps are counted, not walked: their numbers in each zone follow from the zone's length.
    """
    sigma = scalars.clamp(k_sigma * F.least(F.col("depth"), F.lit(far)) * F.least(F.col("depth"), F.lit(far)), sigma_low, sigma_high)
    reach = F.col("range") * F.least(F.lit(1.0), F.lit(far) / F.col("depth")) + sigma  # where the walk back begins, from the camera
    fine = F.ceil(2 * sigma / voxel_dim)  # steps of one voxel, until the band is passed; the first step is one voxel anyway
    wide = F.greatest(F.lit(0), F.ceil((3 * sigma - fine * voxel_dim) / (10 * voxel_dim)))
    steps = rays.withColumns({"__reach": reach, "__fine": fine, "__wide": wide})
    at = F.when(F.col("i") <= F.col("__fine"), F.col("i")).when(F.col("i") <= F.col("__fine") + F.col("__wide"), F.col("__fine") + 10 * (F.col("i") - F.col("__fine"))).otherwise(F.col("__fine") + 10 * F.col("__wide") + 30 * (F.col("i") - F.col("__fine") - F.col("__wide"))) * voxel_dim
    last = F.col("__fine") + F.col("__wide") + F.greatest(F.lit(0), F.ceil((F.col("__reach") - (F.col("__fine") + 10 * F.col("__wide")) * voxel_dim) / (30 * voxel_dim)))
    walked = steps.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("__at", at).where("__at < __reach")
    cell = [F.floor((F.col(f"o{k}") + F.col(f"d{k}") * (F.col("__reach") - F.col("__at"))) / voxel_dim).cast("long").alias(k) for k in "xyz"]
    # the step that led here sets the depth: log2 of 1, 10 and 30 voxels, rounded up
    coarse = F.when(F.col("i") <= F.col("__fine"), 0).when(F.col("i") <= F.col("__fine") + F.col("__wide"), 4).otherwise(5)
    depth = F.least(F.lit(depth_of_map) - coarse, F.lit(depth_of_map - morton.BLOCK_SCALE))
    cells = walked.select(*cell, depth.alias("__depth"))
    edge = 1 << depth_of_map
    inside = cells.where(" and ".join(f"{k} >= 0 and {k} < {edge}" for k in "xyz"))
    return inside.select(morton.encode(F.col("x"), F.col("y"), F.col("z"), F.col("__depth"), depth_of_map).alias("key")).distinct()
