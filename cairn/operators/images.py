"""Images in long form (u, v, depth), and stencils over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry


def stencil(image: DataFrame, offsets: list[tuple[int, int]], width: int, height: int, value: str = "depth", keys: list[str] = [], clamp: bool = True) -> DataFrame:
    """Each pixel with one row for each offset: (keys, u, v, du, dv, near), null where there is no pixel. Clamped at the edges or not."""
    def at(c, most):
        return F.greatest(F.lit(0), F.least(c, F.lit(most - 1))) if clamp else c

    asked = F.explode(F.array(*[F.struct(F.lit(du).alias("du"), F.lit(dv).alias("dv"), at(F.col("u") + du, width).cast("long").alias("nu"), at(F.col("v") + dv, height).cast("long").alias("nv")) for du, dv in offsets]))
    rows = image.select(*keys, "u", "v", asked.alias("o")).select(*keys, "u", "v", "o.*")
    known = image.select(*keys, F.col("u").cast("long").alias("nu"), F.col("v").cast("long").alias("nv"), F.col(value).alias("near"))
    return rows.join(known, [*keys, "nu", "nv"], "left").select(*keys, "u", "v", "du", "dv", "near")


def bilateral(image: DataFrame, width: int, height: int, radius: int = 2, space: float = 4.0, tone: float = 0.1) -> DataFrame:
    """Smoothed depths that keep edges; pixels without depth (0) stay 0 and give nothing."""
    offsets = [(du, dv) for du in range(-radius, radius + 1) for dv in range(-radius, radius + 1)]
    near = stencil(image, offsets, width, height).join(image, ["u", "v"])
    w = F.exp(-(F.col("du") * F.col("du") + F.col("dv") * F.col("dv")) / (2 * space * space)) * F.exp(-F.pow(F.col("near") - F.col("depth"), 2) / (2 * tone * tone))
    w = F.when((F.col("near") > 0) & (F.col("depth") > 0), w).otherwise(0.0)
    sums = near.groupBy("u", "v").agg(F.sum(w * F.coalesce("near", F.lit(0.0))).alias("s"), F.sum(w).alias("w"))
    return sums.select("u", "v", F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(0.0).alias("depth"))


def half_sample(image: DataFrame, spread: float) -> DataFrame:
    """Half the size: the mean of those of 2 x 2 pixels that are within `spread` of the one at the corner."""
    corner = image.where("u % 2 = 0 and v % 2 = 0").select(F.col("u").alias("cu"), F.col("v").alias("cv"), F.col("depth").alias("anchor"))
    parts = image.select((F.col("u") - F.col("u") % 2).alias("cu"), (F.col("v") - F.col("v") % 2).alias("cv"), "depth").join(corner, ["cu", "cv"])
    return parts.where(F.abs(F.col("depth") - F.col("anchor")) <= spread).groupBy("cu", "cv").agg(F.avg("depth").alias("depth")).select((F.col("cu") / 2).cast("long").alias("u"), (F.col("cv") / 2).cast("long").alias("v"), "depth")


def downsample(image: DataFrame, ratio: int) -> DataFrame:
    """ratio x ratio boxes: the upper median of the valid depths, 0 if there is none. A box has ratio ** 2 pixels."""
    box = [F.floor(F.col(k) / ratio).cast("long").alias(k) for k in "uv"]
    listed = image.groupBy(*box).agg(F.array_sort(F.collect_list(F.when(F.col("depth") > 0, F.col("depth")))).alias("d"))
    return listed.select("u", "v", F.when(F.size("d") > 0, F.try_element_at("d", F.floor(F.size("d") / 2).cast("int") + 1)).otherwise(0.0).alias("depth"))


def every_nth(image: DataFrame, ratio: int) -> DataFrame:
    return image.where((F.col("u") % ratio == 0) & (F.col("v") % ratio == 0)).select((F.col("u") / ratio).cast("long").alias("u"), (F.col("v") / ratio).cast("long").alias("v"), "depth")


def normals(image: DataFrame, camera: geometry.Pinhole) -> DataFrame:
    """(u, v, nx, ny, nz) from central differences of the points, null where a neighbour has no depth."""
    near = stencil(image, [(-1, 0), (1, 0), (0, -1), (0, 1)], camera.width, camera.height)
    at = lambda c, d, n: F.greatest(F.lit(0), F.least(F.col(c) + F.col(d), F.lit(n - 1)))
    p = camera.back_project(at("u", "du", camera.width), at("v", "dv", camera.height), F.col("near"))
    sign = F.col("du") + F.col("dv")
    sums = [F.sum(F.when(F.col(d) != 0, sign * p[k])).alias(f"{d}{n}") for d in ("du", "dv") for k, n in enumerate("xyz")]
    got = near.groupBy("u", "v").agg(*sums, F.min(F.coalesce(F.col("near"), F.lit(0.0))).alias("least"))
    n = geometry.normalised(geometry.cross([F.col(f"dv{k}") for k in "xyz"], [F.col(f"du{k}") for k in "xyz"]))
    return got.select("u", "v", *[F.when(F.col("least") > 0, c).alias("n" + k) for k, c in zip("xyz", n)])


def edges(image: DataFrame, width: int, height: int, weight: float = 1.0) -> DataFrame:
    """Greatest difference to the four diagonal neighbours, plus weight times the greatest fall towards them."""
    near = stencil(image, [(-1, -1), (1, -1), (-1, 1), (1, 1)], width, height, clamp=False).where("near is not null").join(image, ["u", "v"])
    gap = F.col("near") - F.col("depth")
    return near.groupBy("u", "v").agg((F.max(F.abs(gap)) + weight * F.max(F.greatest(-gap, F.lit(0.0)))).alias("edge"))


def morphology(pixels: DataFrame, radius: int, width: int, height: int, kind: str, keys: list[str] = []) -> DataFrame:
    """Mask pixels (keys, u, v) dilated or eroded by a square; pixels outside the image neither grow nor erode a mask.

    A mask becomes one row with the set of its places, which the image bounds, so its square's copies meet in that row. Eroding
    a mask is dilating the image's other pixels.
    """
    wide = width + 2 * radius  # with a margin, which also takes what leaves a row at either end
    inside = F.col("u").between(-radius, width + radius - 1) & F.col("v").between(-radius, height + radius - 1)
    masks = pixels.where(inside).groupBy(*keys).agg(F.collect_set(((F.col("v") + radius) * wide + F.col("u") + radius).cast("int")).alias("p"))
    image = F.flatten(F.transform(F.sequence(F.lit(radius), F.lit(radius + height - 1)), lambda v: F.sequence(v * wide + radius, v * wide + (radius + width - 1))))

    moved = lambda by: lambda p: p + by

    def grown(places: Column) -> Column:
        for step in (1, wide):  # along rows, then along columns
            places = F.array_distinct(F.concat(*[F.transform(places, moved(d * step)) for d in range(-radius, radius + 1)]))
        return places

    within = lambda p: (p % wide).between(radius, radius + width - 1) & p.between(radius * wide, (radius + height) * wide - 1)
    if kind == "dilate":
        rows = masks.select(*keys, F.explode(F.filter(grown(F.col("p")), within)).alias("p"))
    else:
        own = F.filter("p", within)
        rows = masks.select(*keys, F.explode(F.array_except(own, grown(F.array_except(image, own)))).alias("p"))
    return rows.select(*keys, (F.col("p") % wide - radius).cast("long").alias("u"), (F.floor(F.col("p") / wide) - radius).cast("long").alias("v"))


def pooling(image: DataFrame, levels: int, near: float = 0.0) -> DataFrame:
    """(level, u, v, low, high, known): least and greatest depth of the valid pixels in boxes of 2 ** level, and whether all, part or none are valid."""
    out = None
    valid = F.when(F.col("depth") > near, F.col("depth"))
    level = image.select(F.col("u"), F.col("v"), valid.alias("low"), valid.alias("high"), F.col("depth").isNotNull().cast("long").alias("n"), valid.isNotNull().cast("long").alias("m"))
    for k in range(1, levels + 1):
        level = level.groupBy(F.floor(F.col("u") / 2).cast("long").alias("u"), F.floor(F.col("v") / 2).cast("long").alias("v")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("m").alias("m"))
        told = level.select(F.lit(k).alias("level"), "u", "v", "low", "high", F.when(F.col("m") == 0, "unknown").when(F.col("m") < F.col("n"), "part").otherwise("known").alias("known"))
        out = told if out is None else out.unionByName(told)
    return out


def components(pixels: DataFrame, keys: list[str], scratch) -> DataFrame:
    """Pixels with the least number (v * 2 ** 20 + u) of those that steps between face neighbours lead to, within their keys.

    Labels fall along runs first: neighbours in a row share the row's run, found by windows, so a step crosses a whole row;
    runs are then joined until nothing changes, each round's table being written to the shared folder.
    """
    row = _runs(pixels, keys)
    runs = scratch.save(row, "pixels")
    small = scratch.save(runs.groupBy(*keys, "v", "run").agg(F.min("u").alias("lo"), F.max("u").alias("hi"), F.min("run").alias("label")), "runs0")
    touch = small.alias("a").join(small.alias("b"), [*[F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], F.col("a.v") + 1 == F.col("b.v")]).where("a.lo <= b.hi and b.lo <= a.hi")
    links = touch.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.run").alias("x"), F.col("b.run").alias("y"))
    links = scratch.save(links.unionByName(links.select(*keys, F.col("y").alias("x"), F.col("x").alias("y"))), "links")
    labels, step = scratch.save(small.select(*keys, "run", "label"), "labels0"), 0
    while True:
        near = links.join(labels.withColumnRenamed("run", "y"), [*keys, "y"]).groupBy(*keys, F.col("x").alias("run")).agg(F.min("label").alias("least"))
        now = labels.join(near, [*keys, "run"], "left").select(*keys, "run", F.least("label", F.coalesce("least", "label")).alias("label"), F.col("label").alias("old"))
        jump = now.select(*keys, F.col("run").alias("label"), F.col("label").alias("next"))
        step += 1
        now = scratch.save(now.join(jump, [*keys, "label"]).select(*keys, "run", F.least("label", "next").alias("label"), "old"), f"labels{step}")
        if not now.where("label <> old").limit(1).count():
            return runs.join(now.select(*keys, "run", "label"), [*keys, "run"]).select(*keys, "u", "v", F.col("label").alias("component"))
        labels = now.drop("old")


def _runs(pixels: DataFrame, keys: list[str]) -> DataFrame:
    line = Window.partitionBy(*keys, "v").orderBy("u")
    start = F.when(F.coalesce(F.col("u") - F.lag("u").over(line) > 1, F.lit(True)), F.col("v") * (1 << 20) + F.col("u"))
    return pixels.select(*keys, "u", "v").distinct().withColumn("__s", start).withColumn("run", F.last("__s", True).over(line)).drop("__s")


def downsample_colour(image: DataFrame, ratio: int, keys: list[str] = []) -> DataFrame:
    """ratio x ratio boxes of an image (keys, u, v, rgba): the means of red, green and blue, rounded down, opaque."""
    from ..functions import scalars

    box = [F.floor(F.col(k) / ratio).cast("long").alias(k) for k in "uv"]
    r, g, b, _ = scalars.unpack_rgba(F.col("rgba"))
    sums = image.groupBy(*keys, *box).agg(*[F.floor(F.sum(c) / (ratio * ratio)).cast("long").alias(n) for c, n in zip((r, g, b), "rgb")])
    return sums.select(*keys, "u", "v", scalars.pack_rgba(F.col("r"), F.col("g"), F.col("b")).alias("rgba"))


def surface_edges(points: DataFrame, width: int, height: int, weight: float = 1.0) -> DataFrame:
    """(u, v, edge): how much of an edge each inner pixel is, from the planes of its four diagonal neighbours.

    points: u, v, px, py, pz, nx, ny, nz (null normals: none). A neighbour's distance is that of its point from the pixel's plane, taken
    as -1 if one of both has no normal; edge is the greatest distance either way, plus weight times the greatest bend (one minus
    the normals' product) towards neighbours that don't lie behind the plane.
    """
    here = points.where(F.col("u").between(1, width - 2) & F.col("v").between(1, height - 2))
    moves = F.explode(F.array(*[F.struct(F.lit(du).alias("du"), F.lit(dv).alias("dv")) for du in (-1, 1) for dv in (-1, 1)])).alias("d")
    asked = here.select("*", moves).select("*", (F.col("u") + F.col("d.du")).alias("mu"), (F.col("v") + F.col("d.dv")).alias("mv"))
    near = points.select(F.col("u").alias("mu"), F.col("v").alias("mv"), *[F.col(f"{a}{k}").alias(f"m{a}{k}") for a in "pn" for k in "xyz"], F.lit(True).alias("there"))
    both = asked.join(near, ["mu", "mv"], "left")
    n, m = [F.col("n" + k) for k in "xyz"], [F.col("mn" + k) for k in "xyz"]
    away = F.coalesce(F.when(n[0].isNotNull() & m[0].isNotNull(), geometry.dot(n, [F.col("mp" + k) - F.col("p" + k) for k in "xyz"])), F.lit(-1.0))
    bend = F.when(away >= 0, 1 - geometry.dot(n, m)).otherwise(0.0)
    return both.groupBy("u", "v").agg((F.max(F.abs(away)) + weight * F.max(bend)).alias("edge"))


def geometric_segments(points: DataFrame, width: int, height: int, weight: float, most: float, radius: int, least: int, scratch) -> DataFrame:
    """(u, v, component): connected areas of at least `least` pixels without edges, which are thickened by `radius` first."""
    edge = surface_edges(points, width, height, weight)
    inner = points.select("u", "v").where(F.col("u").between(1, width - 2) & F.col("v").between(1, height - 2))
    thick = morphology(edge.where(F.col("edge") > most).select("u", "v"), radius, width, height, "dilate")
    areas = components(inner.join(thick, ["u", "v"], "left_anti").withColumn("k", F.lit(0)), ["k"], scratch).drop("k")
    large = areas.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("component")
    return areas.join(large, "component").select("u", "v", "component")
