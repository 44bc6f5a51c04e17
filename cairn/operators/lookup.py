"""Reading a map at coordinates: deepest data, thresholds, neighbours, interpolation, gradients. Descent becomes an equi-join on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import morton
from ..sources.scratch import measured


def lookup(probes: DataFrame, octants: DataFrame, depth_of_map: int, deepest: int, id_col: str = "probe", choose: str = "deepest", threshold: float | None = None) -> DataFrame:
    """Each probe (id, x, y, z) with the octant (key, value, weight) that holds it; value is null where none does.

    choose "deepest": the one of greatest depth. "coarsest": the least deep whose value * weight is at most the threshold and
    whose weight is over 0, else the deepest. Each probe asks for its keys at all depths, which are few; no side is collected.
    """
    asked = probes.select(id_col, F.explode(F.array(*[morton.encode(F.col("x"), F.col("y"), F.col("z"), d, depth_of_map) for d in range(deepest + 1)])).alias("key"))
    found = asked.join(octants.select("key", "value", "weight"), "key")
    data = F.struct("key", "value", "weight")
    at = morton.depth(F.col("key"))
    best = F.max_by(data, at)
    if choose == "coarsest":
        low = (F.col("value") * F.col("weight") <= threshold) & (F.col("weight") > 0)
        best = F.coalesce(F.min_by(F.when(low, data), F.when(low, at)), best)
    hits = found.groupBy(id_col).agg(best.alias("hit"))
    return probes.join(hits, id_col, "left").select(*probes.columns, morton.depth(F.col("hit.key")).alias("depth"), F.col("hit.value").alias("value"), F.col("hit.weight").alias("weight"))


def neighbours(voxels: DataFrame, edge: int, size: int = 1) -> DataFrame:
    """Each voxel's values at its 6 faces, null where nothing is known or outside: (x, y, z, face, value, inside)."""
    moved = F.array(*[F.struct(F.lit(i).alias("face"), (F.col("x") + dx * size).alias("nx"), (F.col("y") + dy * size).alias("ny"), (F.col("z") + dz * size).alias("nz")) for i, (dx, dy, dz) in enumerate(morton.FACES)])
    asked = voxels.select("x", "y", "z", F.explode(moved).alias("m")).select("x", "y", "z", "m.*")
    known = voxels.select(F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("z").alias("nz"), "value")
    inside = F.lit(True)
    for k in ("nx", "ny", "nz"):
        inside = inside & F.col(k).between(0, edge - 1)
    return asked.join(known, ["nx", "ny", "nz"], "left").select("x", "y", "z", "face", "value", inside.alias("inside"))


def interpolate(probes: DataFrame, voxels: DataFrame, id_col: str = "probe", stride: int = 1) -> DataFrame:
    """Trilinear value at px, py, pz (in voxels; values stand at voxel centres); null unless all 8 voxels have data."""
    base = [F.floor(F.col(f"p{k}") / stride - 0.5) for k in "xyz"]
    frac = [F.col(f"p{k}") / stride - 0.5 - b for k, b in zip("xyz", base)]
    corners = F.array(*[F.struct(*[((b + (i >> k & 1)) * stride).cast("long").alias(n) for k, (n, b) in enumerate(zip("xyz", base))], _weight(frac, i).alias("w")) for i in range(8)])
    asked = probes.select(id_col, F.explode(corners).alias("c")).select(id_col, "c.*")
    found = asked.join(measured(voxels.select("x", "y", "z", "value"), "voxels"), ["x", "y", "z"])
    sums = found.groupBy(id_col).agg(F.sum(F.col("w") * F.col("value")).alias("value"), F.count("value").alias("n"))
    return probes.select(id_col).join(sums, id_col, "left").select(id_col, F.when(F.col("n") == 8, F.col("value")).alias("value"))


def _weight(frac, corner: int):
    out = F.lit(1.0)
    for k, f in enumerate(frac):
        out = out * (f if corner >> k & 1 else 1 - f)
    return out


def gradient(probes: DataFrame, voxels: DataFrame, voxel_dim: float, id_col: str = "probe") -> DataFrame:
    """Central differences of the voxels around a point, blended trilinearly: a stencil of -1 to +2 along each axis. Null unless all are known."""
    base = [F.floor(F.col(f"p{k}") - 0.5) for k in "xyz"]
    frac = [F.col(f"p{k}") - 0.5 - b for k, b in zip("xyz", base)]
    # 32 voxels serve the 48 differences: each with its weight in all three
    weights: dict[tuple, list] = {}
    for axis in range(3):
        for corner in range(8):
            for sign in (-1, 1):
                at = tuple((corner >> k & 1) + (sign if k == axis else 0) for k in range(3))
                w = weights.setdefault(at, [F.lit(0.0)] * 3)
                w[axis] = _weight(frac, corner) * (0.5 * sign / voxel_dim)
    stencil = [F.struct(*[(b + o).cast("long").alias(n) for n, b, o in zip("xyz", base, at)], *[c.alias("w" + n) for n, c in zip("xyz", w)]) for at, w in weights.items()]
    asked = probes.select(id_col, F.explode(F.array(*stencil)).alias("c")).select(id_col, "c.*")
    found = asked.join(measured(voxels.select("x", "y", "z", "value"), "voxels"), ["x", "y", "z"])
    sums = found.groupBy(id_col).agg(*[F.sum(F.col("w" + k) * F.col("value")).alias("g" + k) for k in "xyz"], F.count("value").alias("n"))
    return sums.where(F.col("n") == len(stencil)).select(id_col, "gx", "gy", "gz")


def upsert(voxels: DataFrame, changes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Voxels with changed values; changes outside allocated blocks are no-ops. All have x, y, z; blocks the corners of blocks."""
    at = [(F.col(k) - F.col(k) % 8).alias("b" + k) for k in "xyz"]
    inside = changes.select("*", *at).join(blocks.select(*[F.col(k).alias("b" + k) for k in "xyz"]), ["bx", "by", "bz"], "left_semi").select("x", "y", "z", "value")
    return voxels.join(inside, ["x", "y", "z"], "left_anti").select("x", "y", "z", "value").unionByName(inside)


def path_hits(rays: DataFrame, voxels: DataFrame, surface: float, steps: int, step: float, id_col: str = "ray") -> DataFrame:
    """First sample along each ray (o + t d, in voxels) whose value rises over the surface from a known one that doesn't; t is refined linearly.

    Null t without a hit. Steps are fixed, so a ray costs `steps` rows, each of which asks for its own cell and the one before; the first crossing is a minimum.
    """
    known = measured(voxels.select("x", "y", "z", "value"), "voxels")
    at = rays.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("i"))
    cell = lambda i, name: [F.floor(F.col(f"o{k}") + F.col(f"d{k}") * i * step).cast("long").alias(name + k) for k in "xyz"]
    asked = at.select(id_col, "i", *cell(F.col("i"), "n"), *cell(F.col("i") - 1, "b"))
    side = lambda name, value: known.select(*[F.col(k).alias(name + k) for k in "xyz"], F.col("value").alias(value))
    behind, ahead = side("b", "before").where(F.col("before") <= surface), side("n", "value").where(F.col("value") > surface)
    crossing = asked.join(ahead, ["nx", "ny", "nz"]).join(behind, ["bx", "by", "bz"])
    first = crossing.groupBy(id_col).agg(F.min_by(F.struct("i", "value", "before"), "i").alias("c"))
    refined = (F.col("c.i") - 1 + (surface - F.col("c.before")) / (F.col("c.value") - F.col("c.before"))) * step
    return rays.select(id_col).join(first.select(id_col, refined.alias("t")), id_col, "left")
