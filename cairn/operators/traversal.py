"""Rays through a map: the cells that they cross, exactly and in order, and the first surface that they meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def _crossings(o: Column, d: Column, size: int, start: Column, stop: Column) -> Column:
    """Where a ray o + t d crosses planes at multiples of size, for start < t < stop: an arithmetic sequence along one axis."""
    a, b = (o + start * d) / size, (o + stop * d) / size
    low, high = F.floor(F.least(a, b)), F.ceil(F.greatest(a, b))
    planes = F.sequence(low.cast("long"), high.cast("long"))
    inside = F.filter(F.transform(planes, lambda k: (k * size - o) / d), lambda t: (t > start) & (t < stop))
    return F.when(d != 0, inside).otherwise(F.array().cast("array<double>"))


def _cuts(size: int, start: Column, stop: Column) -> Column:
    """Where a ray passes from cell to cell between start and stop, with both ends, in order."""
    ends = F.array(start.cast("double"), stop.cast("double"))
    return F.array_sort(F.array_distinct(F.concat(ends, *[_crossings(F.col("o" + k).cast("double"), F.col("d" + k).cast("double"), size, start, stop) for k in "xyz"])))


def cells(rays: DataFrame, size: int, keys: list[str], start: str = "t0", stop: str = "t1") -> DataFrame:
    """(keys, n, t_in, t_out, x, y, z): the cells of an edge of `size` (corners x, y, z) that each ray crosses between t0 and t1, from the first on.

    rays: keys, ox, oy, oz, dx, dy, dz, t0, t1, in voxels. The crossings of the three axes are merged, so no step is fixed and no cell
    is missed or met twice; a ray through an edge or a corner goes straight to the cell behind it. A ray crosses three cells for
    each cell's edge of its length, at most.
    """
    cuts = _cuts(size, F.col(start), F.col(stop))
    spans = F.arrays_zip(F.slice("__cuts", F.lit(1), F.size("__cuts") - 1).alias("t_in"), F.slice("__cuts", F.lit(2), F.size("__cuts") - 1).alias("t_out"))
    rows = rays.where(F.col(start) < F.col(stop)).withColumn("__cuts", cuts).select(*keys, *[f"{c}{k}" for c in "od" for k in "xyz"], F.posexplode(spans).alias("n", "__s"))
    rows = rows.select(*keys, *[f"{c}{k}" for c in "od" for k in "xyz"], "n", "__s.t_in", "__s.t_out")
    middle = (F.col("t_in") + F.col("t_out")) / 2
    at = [(F.floor((F.col("o" + k) + middle * F.col("d" + k)) / size) * size).cast("long").alias(k) for k in "xyz"]
    return rows.select(*keys, "n", "t_in", "t_out", *at)


def clipped(rays: DataFrame, edge: int, nearest: float, farthest: float) -> DataFrame:
    """Adds t0 and t1, where a ray is within the map and between the nearest and the farthest t; rays that miss the map are left out."""
    low, high = F.lit(float(nearest)), F.lit(float(farthest))
    for k in "xyz":
        o, d = F.col("o" + k), F.col("d" + k)
        a, b = F.try_divide(-o, d), F.try_divide(edge - o, d)
        beside = (d == 0) & ((o < 0) | (o >= edge))
        low, high = F.greatest(low, F.when(beside, float("inf")).otherwise(F.coalesce(F.least(a, b), low))), F.least(high, F.coalesce(F.greatest(a, b), high))
    return rays.withColumns({"t0": low, "t1": high}).where("t0 < t1")


def ray_blocks(rays: DataFrame, blocks: DataFrame, edge: int, nearest: float, farthest: float, id_col: str = "ray") -> DataFrame:
    """(ray, n, x, y, z, t_in, t_out): the allocated blocks (corners x, y, z) that each ray crosses, numbered in order."""
    crossed = cells(clipped(rays, edge, nearest, farthest), 8, [id_col])
    met = crossed.join(blocks.select("x", "y", "z").distinct(), ["x", "y", "z"], "left_semi")
    return met.select(id_col, (F.row_number().over(Window.partitionBy(id_col).orderBy("t_in")) - 1).alias("n"), "x", "y", "z", "t_in", "t_out")


def raycast(rays: DataFrame, voxels: DataFrame, edge: int, nearest: float, farthest: float, surface: float = 0.0, span: float = 16.0, id_col: str = "ray") -> DataFrame:
    """(ray, t, x, y, z, t_known): where each ray first passes from a voxel at or below the surface into one above it.

    Both voxels must be known and follow one another along the ray. t lies between the middles of the ray's ways through both, where
    the line between their values meets the surface; x, y, z is the voxel behind it. t_known: where the ray first enters a voxel
    with data at or below the surface, null if it meets none before t. A ray that meets nothing has nulls.

    Rays advance in rounds, each twice as long as the one before: blocks that a ray crosses in the round are looked up first, and
    only allocated ones are cut into voxels; rays that have hit or left the map drop out, so the rows of a round are those of
    unfinished rays. A round deals out rays, not what they cross, if the map is small; its number is the logarithm of the ray's length.
    """
    scratch = Scratch(rays.sparkSession, "raycast")
    known = scratch.save(voxels.select("x", "y", "z", "value"), "voxels")
    blocks = scratch.save(known.select(*[(F.col(k) - F.col(k) % 8).alias(k) for k in "xyz"]).distinct(), "blocks")
    line, none = [f"{c}{k}" for c in "od" for k in "xyz"], F.lit(None).cast("double")
    now = clipped(rays.select(id_col, *line), edge, nearest, farthest).withColumnRenamed("t1", "t_end").withColumn("t_known", none)
    now = scratch.save(now.withColumn("last", F.struct(none.alias("t_in"), none.alias("t_out"), none.alias("value"))), "rays0")
    done, n = None, 0
    while now.limit(1).count():
        now = now.repartition(id_col).withColumn("t1", F.least(F.col("t_end"), F.col("t0") + span * 2**n))
        # the block at a round's end is cut short: it is taken whole in the next round
        cuts = _cuts(8, F.col("t0"), F.col("t1"))
        reach = now.withColumn("__next", F.when(F.col("t1") < F.col("t_end"), F.element_at(cuts, -2)))
        bare = reach.select(id_col, *line, "t0", "t1", "t_end", "last")
        crossed = cells(bare.select(id_col, "t0", "t1", "t_end", "last", *line, *[F.col(c).alias("__" + c) for c in line]), 8, [id_col, "t1", "t_end", "last", *["__" + c for c in line]])
        met = crossed.where((F.col("t_out") < F.col("t1")) | (F.col("t1") >= F.col("t_end"))).join(blocks, ["x", "y", "z"], "left_semi")
        met = met.select(id_col, "last", F.col("t_in").alias("t0"), F.col("t_out").alias("t1"), *[F.col("__" + c).alias(c) for c in line])
        through = cells(met, 1, [id_col, "last"]).join(known, ["x", "y", "z"])
        # the last voxel of a round is carried over: the one that ends where the next round begins
        before = F.coalesce(F.lag(F.struct("t_in", "t_out", "value")).over(Window.partitionBy(id_col).orderBy("t_in")), F.col("last"))
        pairs = through.select(id_col, "t_in", "t_out", "x", "y", "z", "value", before.alias("p"))
        crossing = (F.col("p.t_out") == F.col("t_in")) & (F.col("p.value") <= surface) & (F.col("value") > surface)
        a, b = (F.col("p.t_in") + F.col("p.t_out")) / 2, (F.col("t_in") + F.col("t_out")) / 2
        hit = F.struct((a + (b - a) * (surface - F.col("p.value")) / (F.col("value") - F.col("p.value"))).alias("t"), "x", "y", "z")
        found = pairs.groupBy(id_col).agg(F.min_by(F.when(crossing, hit), F.when(crossing, F.col("t_in"))).alias("hit"), F.min(F.when(F.col("value") <= surface, F.col("t_in"))).alias("__first"), F.max_by(F.struct("t_in", "t_out", "value"), "t_in").alias("__last"))
        state = scratch.save(reach.join(found, id_col, "left").withColumn("t_known", F.coalesce("t_known", "__first")).withColumn("last", F.coalesce("__last", "last")).drop("__last", "t1"), f"state{n}")
        over = state.where("hit is not null or __next is null").select(id_col, "hit.t", "hit.x", "hit.y", "hit.z", F.when(F.col("hit").isNull() | (F.col("t_known") < F.col("hit.t")), F.col("t_known")).alias("t_known"))
        done = over if done is None else done.unionByName(over)
        left = state.where("hit is null and __next is not null")
        kept = [F.when(F.col("last.t_out") == F.col("__next"), F.col(f"last.{c}")).alias(c) for c in ("t_in", "t_out", "value")]
        now = left.select(id_col, *line, F.col("__next").alias("t0"), "t_end", "t_known", F.struct(*kept).alias("last"))
        n += 1
    names = [id_col, "t", "x", "y", "z", "t_known"]
    whole = rays.select(id_col)
    return whole.join(done, id_col, "left").select(names) if done is not None else whole.selectExpr(id_col, "cast(null as double) t", *[f"cast(null as long) {k}" for k in "xyz"], "cast(null as double) t_known")
