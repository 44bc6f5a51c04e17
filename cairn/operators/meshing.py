"""Surface triangles from voxels: cases by the signs at a cell's corners, vertices on its edges."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Corners of a cell, in the order of their bits in a case.
CORNERS = [(0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1), (0, 1, 0), (1, 1, 0), (1, 1, 1), (0, 1, 1)]
EDGES = sorted((i, j) for i, j in itertools.combinations(range(8), 2) if sum(a != b for a, b in zip(CORNERS[i], CORNERS[j])) == 1)


def triangles_of(case: int) -> list[tuple[int, int, int]]:
    """Triangles (edge numbers) of a case, whose bits tell the corners inside.

    On each face, crossed edges are joined so that corners inside stay apart; the pieces close to loops, and each loop is a fan.
    """
    inside = [bool(case >> i & 1) for i in range(8)]
    crossed = {e: k for k, e in enumerate(EDGES) if inside[e[0]] != inside[e[1]]}
    joins: dict[int, list[int]] = {}
    for axis, side in itertools.product(range(3), (0, 1)):
        face = [i for i in range(8) if CORNERS[i][axis] == side]
        on = {e: k for e, k in crossed.items() if e[0] in face and e[1] in face}
        pairs = [tuple(on.values())] if len(on) == 2 else [tuple(k for e, k in on.items() if c in e) for c in face if inside[c]] if on else []
        for a, b in pairs:
            joins.setdefault(a, []).append(b)
            joins.setdefault(b, []).append(a)
    out, left = [], set(joins)
    while left:
        loop = [min(left)]
        left.discard(loop[0])
        while True:
            ahead = [k for k in joins[loop[-1]] if k in left]
            if not ahead:
                break
            loop.append(ahead[0])
            left.discard(ahead[0])
        out += [(loop[0], loop[i], loop[i + 1]) for i in range(1, len(loop) - 1)]
    return out


def marching_cubes(voxels: DataFrame, surface: float = 0.0) -> DataFrame:
    """(x, y, z, triangle, vertex, vx, vy, vz): triangles of the cells all of whose 8 corners are known; vertices are interpolated linearly.

    A voxel goes to the 8 cells that it is a corner of, and each cell gathers its corners in one aggregation. voxels: x, y, z,
    value, with values over the surface outside.
    """
    spark = voxels.sparkSession
    cells = voxels.select(F.explode(F.array(*[F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), (F.col("z") - dz).alias("z"), F.lit(i).alias("corner"), F.col("value").alias("value")) for i, (dx, dy, dz) in enumerate(CORNERS)])).alias("c")).select("c.*")
    corner = [F.max(F.when(F.col("corner") == i, F.col("value"))).alias(f"c{i}") for i in range(8)]
    full = cells.groupBy("x", "y", "z").agg(*corner, F.count("value").alias("n")).where("n = 8")
    case = sum((F.when(F.col(f"c{i}") < surface, 1 << i).otherwise(0) for i in range(1, 8)), F.when(F.col("c0") < surface, 1).otherwise(0))
    table = F.broadcast(spark.createDataFrame([(c, k, v, e) for c in range(256) for k, t in enumerate(triangles_of(c)) for v, e in enumerate(t)], "case int, triangle int, vertex int, edge int"))
    hit = full.withColumn("case", case).where("case > 0 and case < 255").join(table, "case")
    values = F.array(*[F.col(f"c{i}") for i in range(8)])
    a, b = (F.element_at(F.array(*[F.lit(e[k]) for e in EDGES]), F.col("edge") + 1) for k in (0, 1))
    t = (surface - F.element_at(values, a + 1)) / (F.element_at(values, b + 1) - F.element_at(values, a + 1))
    place = []
    for k, n in enumerate("xyz"):
        at = F.array(*[F.lit(float(c[k])) for c in CORNERS])
        place.append((F.col(n) + F.element_at(at, a + 1) + (F.element_at(at, b + 1) - F.element_at(at, a + 1)) * t).alias("v" + n))
    return hit.select("x", "y", "z", "triangle", "vertex", *place)


def dual_marching_cubes(leaves: DataFrame, surface: float = 0.0) -> DataFrame:
    """(x, y, z, triangle, vertex, vx, vy, vz): triangles over voxels of unequal scales, closed across the borders of scales.

    leaves: x, y, z, scale, value: disjoint voxels of 2 ** scale, one scale in each block of 8. Around each corner x, y, z of a voxel
    the centres of the eight voxels that meet there are a cell; where a larger voxel fills several of its places, their edges
    have no length, and triangles on them are left out. Cells of neighbouring corners share faces, at borders of scales too.
    Each corner asks for the scales of the blocks around it (few rows, which Spark may broadcast), then for eight voxels.
    Corners without all eight have no cell.
    """
    spark = leaves.sparkSession
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("scale").cast("int"))
    ends = F.explode(F.array(*[F.struct(*[(F.col(k) + (i >> j & 1) * size).alias(k) for j, k in enumerate("xyz")]) for i in range(8)])).alias("c")
    corners = leaves.select(ends).select("c.*").distinct()
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *[(F.col(k) + d - 1).alias("c" + k) for k, d in zip("xyz", c)]) for i, c in enumerate(CORNERS)])).alias("p")
    asked = corners.select("x", "y", "z", places).select("x", "y", "z", "p.*").where("cx >= 0 and cy >= 0 and cz >= 0")
    blocks = leaves.select(*[(F.col(k) - F.col(k) % 8).alias("b" + k) for k in "xyz"], "scale").distinct()
    asked = asked.select("*", *[(F.col("c" + k) - F.col("c" + k) % 8).alias("b" + k) for k in "xyz"]).join(blocks, ["bx", "by", "bz"])
    own = leaves.select(*[F.col(k).alias("l" + k) for k in "xyz"], "scale", "value")
    found = asked.select("x", "y", "z", "i", "scale", *[(F.col("c" + k) - F.col("c" + k) % size).alias("l" + k) for k in "xyz"]).join(own, ["lx", "ly", "lz", "scale"])
    data = F.struct("i", "value", *[(F.col("l" + k) + size / 2).alias("p" + k) for k in "xyz"])
    cells = found.groupBy("x", "y", "z").agg(F.array_sort(F.collect_list(data)).alias("v")).where(F.size("v") == 8)  # eight at most
    case = F.aggregate("v", F.lit(0), lambda a, s: a + F.when(s["value"] < surface, F.call_function("shiftleft", F.lit(1), s["i"])).otherwise(0))
    table = F.broadcast(spark.createDataFrame([(c, k, [EDGES[e][0] for e in t], [EDGES[e][1] for e in t]) for c in range(256) for k, t in enumerate(triangles_of(c))], "case int, triangle int, a array<int>, b array<int>"))
    hit = cells.withColumn("case", case).where("case > 0 and case < 255").join(table, "case")

    def pair(i: int):
        """The two voxels between which a vertex lies, in order of their centres: neighbouring cells compute it alike."""
        ends = [F.element_at("v", F.col(c)[i] + 1) for c in "ab"]
        return F.array_sort(F.array(*[F.struct(e["px"].alias("px"), e["py"].alias("py"), e["pz"].alias("pz"), e["value"].alias("value")) for e in ends]))

    q = [F.col("q")[i] for i in range(3)]
    made = hit.withColumn("q", F.array(*map(pair, range(3)))).where((q[0] != q[1]) & (q[1] != q[2]) & (q[0] != q[2]))
    rows = made.select("x", "y", "z", "triangle", F.posexplode("q").alias("vertex", "q"))
    a, b = F.col("q")[0], F.col("q")[1]
    t = (surface - a["value"]) / (b["value"] - a["value"])
    return rows.select("x", "y", "z", "triangle", "vertex", *[(a["p" + k] + (b["p" + k] - a["p" + k]) * t).alias("v" + k) for k in "xyz"])
