"""Reads of a map whose blocks hold their data at different scales: blocks with a halo, interpolation at a negotiated scale, changes sent down the scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, measured
from . import pyramid

#: Where a scale's voxels begin in a block with a halo of one voxel: 10, 6, 4 and 3 voxels along each edge.
HALO = (0, 1000, 1216, 1280)
HALO_SIZE = 1307
_BLOCK = ["bx", "by", "bz"]


def _shift(x, by: Column) -> Column:
    return F.call_function("shiftleft", (F.lit(x) if isinstance(x, int) else x).cast("int"), by.cast("int"))


def _right(x, by: Column) -> Column:
    return F.call_function("shiftright", (F.lit(x) if isinstance(x, int) else x).cast("int"), by.cast("int"))


def all_scales(leaves: DataFrame) -> DataFrame:
    """(x, y, z, scale, value, weight): voxels at their blocks' scales, and the means of their children at all coarser ones. leaves: the same columns."""
    level = leaves.select("x", "y", "z", "scale", "value", "weight").withColumns({"observed": F.lit(True), "frontier": F.lit(False)})
    return pyramid.pyramid(level, 3).where("scale <= 3 and weight > 0").select("x", "y", "z", "scale", "value", "weight")


def halo_blocks(leaves: DataFrame) -> DataFrame:
    """(bx, by, bz, scale, scales, values): each block with what a read within it can need of its neighbours.

    values: data at every scale from its own on, of the block and one voxel around it, by place (HALO); scales: the scales of the 27
    blocks around, by dx + 3 dy + 9 dz with 0 to 2 for -1 to 1; both are arrays. A voxel goes to two blocks on average, once for all reads, where
    asking for the eight voxels of each point would move eight rows a point. leaves: x, y, z, scale, value, weight.
    """
    block = [(F.col(k) - F.col(k) % 8).alias("b" + k) for k in "xyz"]
    own = leaves.select(*block, "scale").distinct()
    steps = [(F.col("b" + k) + 8 * (F.col("o")[i] - 1)).alias("b" + k) for i, k in enumerate("xyz")]
    around = own.withColumn("o", F.explode(F.transform(F.sequence(F.lit(0), F.lit(26)), lambda i: F.array((i % 3).cast("int"), (F.floor(i / 3) % 3).cast("int"), F.floor(i / 9).cast("int")))))
    # a block at an offset sees this one at the opposite offset
    seen = around.select(*steps, F.struct((26 - (F.col("o")[0] + 3 * F.col("o")[1] + 9 * F.col("o")[2])).cast("int").alias("i"), F.col("scale").cast("int").alias("s")).alias("e"))
    scales = seen.groupBy(*_BLOCK).agg(F.map_from_entries(F.collect_list("e")).alias("m")).select(*_BLOCK, F.transform(F.sequence(F.lit(0), F.lit(26)), lambda i: F.col("m")[i]).alias("scales"))

    n, local = _right(8, F.col("scale")), lambda k: _right(F.col(k) % 8, F.col("scale"))

    def targets(k: str) -> Column:
        at = lambda b, p: F.struct((F.col(k) - F.col(k) % 8 + b).alias("b"), p.cast("int").alias("p"))
        edge = F.concat(F.when(local(k) == 0, F.array(at(-8, n + 1))).otherwise(F.array()), F.when(local(k) == n - 1, F.array(at(8, F.lit(0)))).otherwise(F.array()))
        return F.explode(F.concat(F.array(at(0, local(k) + 1)), edge))

    rows = all_scales(leaves)
    for k in "xyz":
        rows = rows.withColumn("t" + k, targets(k))
    width = n + 2
    place = F.element_at(F.array(*map(F.lit, HALO)), F.col("scale").cast("int") + 1) + F.col("tx.p") + width * (F.col("ty.p") + width * F.col("tz.p"))
    entries = rows.select(*[F.col(f"t{k}.b").alias("b" + k) for k in "xyz"], place.cast("int").alias("i"), "value")
    # every place has a row, so that sorted places are an array that is read by index
    places = own.select(*_BLOCK, F.explode(F.sequence(F.lit(0), F.lit(HALO_SIZE - 1))).alias("i"), F.lit(None).cast("double").alias("value"))
    filled = entries.unionByName(places).groupBy(*_BLOCK, "i").agg(F.max("value").alias("v"))
    values = filled.groupBy(*_BLOCK).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("values")).withColumn("values", F.transform("values", lambda e: e["v"]))
    return own.join(scales, _BLOCK).join(values, _BLOCK)


def interpolate(points: DataFrame, halos: DataFrame, id_col: str = "probe", least_scale: int = 0) -> DataFrame:
    """(id, value, scale): the trilinear value at px, py, pz (in voxels) at the finest scale that all eight voxels around can serve.

    It starts at the scale of the point's own block; if one of the eight voxels lies in a coarser block, all are read at that scale,
    which may reach other blocks, and so on. Null unless all eight have data there. Each point moves once, to its block.
    """
    block = [F.floor(F.col(f"p{k}") / 8).cast("long") * 8 for k in "xyz"]
    rows = points.select(id_col, "px", "py", "pz", *[b.alias("b" + k) for b, k in zip(block, "xyz")]).join(measured(halos, "halos"), _BLOCK, "left")

    def base(k: str, s: Column) -> Column:
        """Place within the block of the lower of the two voxels around the point."""
        size = _shift(1, s)
        return (F.floor(F.col("p" + k) / size - 0.5) - F.col("b" + k) / size).cast("int")

    def side(k: str, s: Column, bit: int) -> Column:
        at = base(k, s) + bit
        return F.when(at < 0, 0).when(at >= _right(8, s), 2).otherwise(1)

    def need(s: int) -> Column:
        """The coarsest of the blocks that the eight voxels at scale s lie in."""
        at = F.lit(s)
        return F.greatest(F.lit(s), *[F.get("scales", side("x", at, c & 1) + 3 * side("y", at, c >> 1 & 1) + 9 * side("z", at, c >> 2)) for c in range(8)])

    rows = rows.withColumn("__s", F.greatest(F.col("scale"), F.lit(least_scale)).cast("int")).withColumn("__need", F.array(*[need(s).cast("int") for s in range(4)]))
    for _ in range(3):  # scales only rise, from 0 to 3
        rows = rows.withColumn("__s", F.element_at("__need", F.col("__s") + 1))
    s = F.col("__s")
    rows = rows.withColumns({f"__b{k}": base(k, s) for k in "xyz"} | {f"__f{k}": F.col(f"p{k}") / _shift(1, s) - 0.5 - F.floor(F.col(f"p{k}") / _shift(1, s) - 0.5) for k in "xyz"})
    width, total = _right(8, s) + 2, None
    for c in range(8):
        bits = {k: c >> i & 1 for i, k in enumerate("xyz")}
        at = {k: F.col("__b" + k) + bits[k] + 1 for k in "xyz"}
        place = F.element_at(F.array(*map(F.lit, HALO)), s + 1) + at["x"] + width * (at["y"] + width * at["z"])
        w = F.lit(1.0)
        for k in "xyz":
            w = w * (F.col("__f" + k) if bits[k] else 1 - F.col("__f" + k))
        term = w * F.get("values", place.cast("int"))
        total = term if total is None else total + term
    return rows.select(id_col, total.alias("value"), F.when(total.isNotNull(), s).alias("scale"))


def propagate_down(voxels: DataFrame, scale: int, until: int, max_weight: float, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Sends what voxels at a scale have changed since they last did down to finer scales, level by level, each being written.

    voxels: x, y, z, scale, value, last, weight, delta (weight gained since). A child with data moves by its parent's value - last,
    not below `low`, and gains its delta, up to max_weight; one without (weight 0) takes what its parents' values give at its
    centre, clamped, with its parent's weight, if all eight around are known. Afterwards parents' changes are settled. Returns
    all voxels. An equi-join on the parent, and the eight parents of unseen children only.
    """
    scratch, cols = Scratch(voxels.sparkSession, "down"), ["x", "y", "z", "scale", "value", "last", "weight", "delta"]
    from .lookup import interpolate as at_scale

    out, above = voxels.where(F.col("scale") > scale).select(cols), voxels.where(F.col("scale") == scale).select(cols)
    for s in range(scale, until, -1):
        size = 1 << s
        parents = above.select(*[F.col(k).alias("p" + k) for k in "xyz"], F.col("value").alias("pv"), F.col("last").alias("pl"), F.col("weight").alias("pw"), F.col("delta").alias("pd"))
        children = voxels.where(F.col("scale") == s - 1).select(*cols, *[(F.col(k) - F.col(k) % size).alias("p" + k) for k in "xyz"])
        both = children.join(parents, ["px", "py", "pz"], "left")
        unseen = both.where("weight = 0 and pw > 0").select(F.struct("x", "y", "z").alias("probe"), *[(F.col(k) + size / 4).alias("p" + k) for k in "xyz"])
        given = at_scale(unseen, above.where("weight > 0"), "probe", size).select("probe.x", "probe.y", "probe.z", F.col("value").alias("given"))
        seen = F.col("weight") > 0
        moved = F.greatest(F.col("value") + F.coalesce(F.col("pv") - F.col("pl"), F.lit(0.0)), F.lit(low))
        fresh = F.greatest(F.lit(low), F.least(F.col("given"), F.lit(high)))
        known = F.col("given").isNotNull()
        level = both.join(given, ["x", "y", "z"], "left").select(
            "x", "y", "z", "scale", F.when(seen, moved).when(known, fresh).otherwise(F.col("value")).alias("value"), F.when(known & ~seen, fresh).otherwise(F.col("last")).alias("last"),
            F.when(seen, F.least(F.col("weight") + F.coalesce("pd", F.lit(0.0)), F.lit(max_weight))).when(known, F.col("pw")).otherwise(F.col("weight")).alias("weight"), F.when(seen, F.coalesce("pd", F.lit(0.0))).otherwise(0.0).alias("delta"),
        )
        level = scratch.save(level, f"scale{s - 1}")
        out = out.unionByName(above.withColumns({"last": F.col("value"), "delta": F.lit(0.0)}))
        above = level
    return out.unionByName(above).unionByName(voxels.where(F.col("scale") < until).select(cols))
