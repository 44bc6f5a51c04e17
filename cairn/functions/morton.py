"""Morton keys as column expressions.

A map has size 2 ** depth voxels along each edge. A key holds the interleaved coordinates of an octant's corner (x lowest)
and, in the low 9 bits, which blocks of 8 voxels leave free, the octant's depth from the root. All are longs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW = 511
BLOCK_SIZE = 8
BLOCK_SCALE = 3

def _long(x) -> Column:
    return F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")


def _and(a: Column, b) -> Column:
    return a.bitwiseAND(_long(b))


def spread(x: Column, bits: int = 21) -> Column:
    """Bit i of x goes to place 3 i. A sum of single bits: x is named once for each, so that nested keys stay small plans."""
    x = _long(x)
    return reduce(Column.bitwiseOR, [F.shiftleft(_and(x, 1 << i), 2 * i) for i in range(bits)])


def gather(code: Column, bits: int = 21) -> Column:
    """The inverse of spread()."""
    code = _long(code)
    return reduce(Column.bitwiseOR, [F.shiftright(_and(code, 1 << 3 * i), 2 * i) for i in range(bits)])


def interleave(x: Column, y: Column, z: Column, bits: int = 21) -> Column:
    return spread(x, bits).bitwiseOR(F.shiftleft(spread(y, bits), 1)).bitwiseOR(F.shiftleft(spread(z, bits), 2))


def coords(key: Column, bits: int = 21) -> tuple[Column, Column, Column]:
    """Corner of a key's octant. bits: the map's depth, or more."""
    c = code(key)
    return gather(c, bits), gather(F.shiftright(c, 1), bits), gather(F.shiftright(c, 2), bits)


def code(key: Column) -> Column:
    return _and(key, ~LOW)


def depth(key: Column) -> Column:
    return _and(key, LOW)


def _level_mask(at, depth_of_map: int) -> Column | int:
    """Keeps the bits of the first `at` levels."""
    if isinstance(at, int):
        return ~((1 << 3 * (depth_of_map - at)) - 1)
    return -F.call_function("shiftleft", F.lit(1).cast("long"), (3 * (depth_of_map - at)).cast("int"))


def encode(x: Column, y: Column, z: Column, at, depth_of_map: int) -> Column:
    """Key of the octant at depth `at` (a number or a column) that holds the voxel."""
    return _and(_and(interleave(x, y, z, depth_of_map), ~LOW), _level_mask(at, depth_of_map)).bitwiseOR(_long(at))


def prefix(key: Column, at, depth_of_map: int) -> Column:
    """Key of the ancestor at depth `at`."""
    return _and(code(key), _level_mask(at, depth_of_map)).bitwiseOR(_long(at))


def parent(key: Column, depth_of_map: int) -> Column:
    return prefix(key, depth(key) - 1, depth_of_map)


def child_index(key: Column, depth_of_map: int) -> Column:
    """Which of its parent's 8 children it is: bit 0 for x, 1 for y, 2 for z."""
    return _and(F.call_function("shiftright", code(key), (3 * (depth_of_map - depth(key))).cast("int")), 7)


def child(key: Column, index, depth_of_map: int) -> Column:
    at = depth(key) + 1
    return code(key).bitwiseOR(F.call_function("shiftleft", _long(index), (3 * (depth_of_map - at)).cast("int"))).bitwiseOR(at)


def siblings(key: Column, depth_of_map: int) -> Column:
    """All 8 children of its parent."""
    up = parent(key, depth_of_map)
    return F.array(*[child(up, i, depth_of_map) for i in range(8)])


def is_descendant(key: Column, ancestor: Column, depth_of_map: int) -> Column:
    """Whether it is the ancestor or lies in it."""
    return (depth(key) >= depth(ancestor)) & (prefix(key, depth(ancestor), depth_of_map) == ancestor)


def ancestors(key: Column, depth_of_map: int, lowest: int = 0) -> Column:
    """Keys of all strict ancestors from depth `lowest` on."""
    return F.when(depth(key) > lowest, F.transform(F.sequence(F.lit(lowest).cast("long"), depth(key) - 1), lambda d: prefix(key, d, depth_of_map))).otherwise(F.array().cast("array<long>"))


def octant_size(key: Column, depth_of_map: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (depth_of_map - depth(key)).cast("int"))


#: The 6 face neighbours: -x, +x, -y, +y, -z, +z.
FACES = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]


def face_neighbours(x: Column, y: Column, z: Column, size, edge: int) -> Column:
    """Array of (face, x, y, z) one `size` away, clamped to the map of that edge."""
    clamp = lambda v: F.greatest(F.lit(0).cast("long"), F.least(v.cast("long"), F.lit(edge - 1).cast("long")))
    size = F.lit(size) if isinstance(size, int) else size
    return F.array(*[F.struct(F.lit(i).alias("face"), clamp(x + dx * size).alias("x"), clamp(y + dy * size).alias("y"), clamp(z + dz * size).alias("z")) for i, (dx, dy, dz) in enumerate(FACES)])


def far_corner(key: Column, depth_of_map: int) -> tuple[Column, Column, Column]:
    """Its corner farthest from its parent's centre."""
    size, i = octant_size(key, depth_of_map), child_index(key, depth_of_map)
    return tuple(c + F.when(_and(i, 1 << k) != 0, size).otherwise(0) for k, c in enumerate(coords(key, depth_of_map)))


def exterior_neighbours(key: Column, depth_of_map: int, corner: tuple[Column, Column, Column] | None = None) -> Column:
    """Keys at its depth of the 7 octants across its far corner, clamped to the map. corner: its coordinates, if they are columns already (a smaller plan)."""
    size, i, xyz = octant_size(key, depth_of_map), child_index(key, depth_of_map), corner or coords(key, depth_of_map)
    step = [F.when(_and(i, 1 << k) != 0, size).otherwise(-size) for k in range(3)]
    edge = F.lit(1 << depth_of_map)
    out = []
    for n in range(1, 8):
        at = [F.greatest(F.lit(0), F.least(c + (s if n >> k & 1 else F.lit(0)), edge - size)) for k, (c, s) in enumerate(zip(xyz, step))]
        out.append(encode(*at, depth(key), depth_of_map))
    return F.array(*out)


def block_offset(scale: Column) -> Column:
    """Voxels of a block at all finer scales: (512, 64, 8, 1 from scale 0) summed before `scale`."""
    return F.element_at(F.array(*map(F.lit, (0, 512, 576, 584))), scale.cast("int") + 1)


def block_voxel(index: Column, scale: Column) -> tuple[Column, Column, Column]:
    """Coordinates in a block of a voxel by its linear index at a scale, x fastest."""
    n = F.call_function("shiftright", F.lit(8), scale.cast("int"))
    stride = F.call_function("shiftleft", F.lit(1), scale.cast("int"))
    return index % n * stride, F.floor(index / n) % n * stride, F.floor(index / (n * n)) * stride
