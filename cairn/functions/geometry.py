"""Poses, boxes, frustums and projections as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a, b) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a) -> Vector:
    n = norm(a)
    return tuple(F.try_divide(c, n) for c in a)


def rotate_yaw(p: Vector, yaw: Column) -> Vector:
    return p[0] * F.cos(yaw) - p[1] * F.sin(yaw), p[0] * F.sin(yaw) + p[1] * F.cos(yaw), p[2]


def rotate(q, p) -> Vector:
    """By a unit quaternion (x, y, z, w)."""
    t = tuple(2 * c for c in cross(q[:3], p))
    u = cross(q[:3], t)
    return tuple(p[k] + q[3] * t[k] + u[k] for k in range(3))


def transform(q, t, p) -> Vector:
    """From a body's frame to the one that its pose is given in."""
    return tuple(a + b for a, b in zip(rotate(q, p), t))


def inverse_transform(q, t, p) -> Vector:
    return rotate((-q[0], -q[1], -q[2], q[3]), tuple(a - b for a, b in zip(p, t)))


# ---- boxes: corner and size along each axis


def in_box(p, low, high) -> Column:
    """Half-open: low <= p < high."""
    return (p[0] >= low[0]) & (p[0] < high[0]) & (p[1] >= low[1]) & (p[1] < high[1]) & (p[2] >= low[2]) & (p[2] < high[2])


def axis_overlap(a, na, b, nb) -> Column:
    """Touching counts."""
    return F.abs((a + a + na) - (b + b + nb)) <= na + nb


def boxes_overlap(a, sa, b, sb) -> Column:
    return axis_overlap(a[0], sa[0], b[0], sb[0]) & axis_overlap(a[1], sa[1], b[1], sb[1]) & axis_overlap(a[2], sa[2], b[2], sb[2])


def box_inside(a, sa, b, sb) -> Column:
    """a strictly within b."""
    axis = lambda k: (a[k] > b[k]) & (a[k] + sa[k] < b[k] + sb[k])
    return axis(0) & axis(1) & axis(2)


def overlap_volume(a, sa, b, sb) -> Column:
    side = lambda k: F.greatest(F.lit(0.0), F.least(a[k] + sa[k], b[k] + sb[k]) - F.greatest(a[k], b[k]))
    return side(0) * side(1) * side(2)


def merge_spheres(a, ra: Column, b, rb: Column) -> tuple[Column, Column, Column, Column]:
    """Centre and radius of the smallest sphere around two: the larger one if it holds the other."""
    step = tuple(y - x for x, y in zip(a, b))
    d = norm(step)
    r = (d + ra + rb) / 2
    pick = lambda outer, inner, else_: F.when(d + rb <= ra, outer).when(d + ra <= rb, inner).otherwise(else_)
    return (*[pick(x, y, x + F.try_divide(s * (r - ra), d)) for x, y, s in zip(a, b, step)], pick(ra, rb, r))


# ---- pinhole camera: z forward, x right, y down


@dataclass(frozen=True)
class Pinhole:
    width: int = 64
    height: int = 48
    fx: float = 52.5
    fy: float = 52.5
    cx: float = 31.5
    cy: float = 23.5
    near: float = 0.4
    far: float = 6.0

    def ray(self, u: Column, v: Column) -> Vector:
        """Direction of a pixel at depth 1."""
        return (u - self.cx) / self.fx, (v - self.cy) / self.fy, F.lit(1.0)

    def back_project(self, u: Column, v: Column, depth: Column) -> Vector:
        """Point of a measurement; the origin without one."""
        return tuple(F.when(depth > 0, c * depth).otherwise(0.0) for c in self.ray(u, v))

    def project(self, p) -> tuple[Column, Column, Column]:
        """Pixel column and row (rounded), and whether the point is before the camera and in the image."""
        z = F.when(p[2] > 0, p[2])
        u, v = F.floor(self.fx * p[0] / z + self.cx + 0.5), F.floor(self.fy * p[1] / z + self.cy + 0.5)
        seen = (p[2] > 0) & (u >= 0) & (u < self.width) & (v >= 0) & (v < self.height)
        return u, v, F.coalesce(seen, F.lit(False))

    def planes(self, endless: bool = False) -> list[tuple[tuple[float, float, float], float]]:
        """Inward unit normals and offsets: normal . p + offset >= 0 inside. The four sides, near, and far unless endless."""
        left, right = (-0.5 - self.cx) / self.fx, (self.width - 0.5 - self.cx) / self.fx
        top, bottom = (-0.5 - self.cy) / self.fy, (self.height - 0.5 - self.cy) / self.fy
        sides = [(1.0, 0.0, -left), (-1.0, 0.0, right), (0.0, 1.0, -top), (0.0, -1.0, bottom)]
        out = [(tuple(c / math.sqrt(sum(x * x for x in n)) for c in n), 0.0) for n in sides]
        out.append(((0.0, 0.0, 1.0), -self.near))
        return out if endless else [*out, ((0.0, 0.0, -1.0), self.far)]

    def point_in_frustum(self, p, endless: bool = False) -> Column:
        return self.sphere_in_frustum(p, 0.0, endless)

    def sphere_in_frustum(self, p, radius, endless: bool = False) -> Column:
        out = F.lit(True)
        for n, d in self.planes(endless):
            out = out & (n[0] * p[0] + n[1] * p[1] + n[2] * p[2] + d >= -radius)
        return out

    def box_in_frustum(self, low, high, endless: bool = False) -> Column:
        """For each plane some corner lies inside: the one farthest along its normal."""
        out = F.lit(True)
        for n, d in self.planes(endless):
            out = out & (sum((n[k] * (high[k] if n[k] > 0 else low[k]) for k in range(3)), F.lit(0.0)) + d >= 0)
        return out

    def ray_in_frustum(self, r) -> Column:
        out = F.lit(True)
        for n, _ in self.planes()[:4]:
            out = out & (n[0] * r[0] + n[1] * r[1] + n[2] * r[2] >= 0)
        return out

    def near_distance(self, ray) -> Column:
        return self.near * norm(ray) / ray[2]

    def far_distance(self, ray) -> Column:
        return self.far * norm(ray) / ray[2]


# ---- rays around the vertical axis, for images of 360 degrees


def azimuth(u: Column, width: int) -> Column:
    """Angle of an image column's middle, from pi at column 0 down to -pi."""
    return math.pi - 2 * math.pi * (u + 0.5) / width


def polar(v: Column, height: int, vertical_fov: float) -> Column:
    """Angle from the zenith of an image row's middle."""
    return math.pi / 2 - vertical_fov / 2 + vertical_fov * (v + 0.5) / height


def azimuth_column(a: Column, width: int) -> Column:
    return F.floor((math.pi - a) / (2 * math.pi) * width).cast("long") % width


def direction(a: Column, p: Column) -> Vector:
    return F.sin(p) * F.cos(a), F.sin(p) * F.sin(a), F.cos(p)
