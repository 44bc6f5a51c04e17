"""Scalar math as column expressions: angles, log-odds, entropy, gains, scales, poses, colours."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def fraction(x: Column) -> Column:
    return x - F.floor(x)


def saturating_add(x: Column, n, most) -> Column:
    return F.least(x + n, F.lit(most))


def wrap_2pi(a: Column) -> Column:
    """To [0, 2 pi)."""
    return a - F.floor(a / TAU) * TAU


def wrap_pi(a: Column) -> Column:
    """To [-pi, pi)."""
    return wrap_2pi(a + math.pi) - math.pi


def angle_difference(a: Column, b: Column) -> Column:
    """From a to b, the shorter way."""
    return wrap_pi(b - a)


def log_odds(p: Column) -> Column:
    """log2 of the odds; infinite at 0 and 1."""
    return F.when(p <= 0, float("-inf")).when(p >= 1, float("inf")).otherwise(F.log2(F.try_divide(p, 1 - p)))


def probability(l: Column) -> Column:
    """From log2 odds, 0 and 1 beyond 100."""
    odds = F.pow(F.lit(2.0), clamp(l, -100.0, 100.0))
    return F.when(l <= -100, 0.0).when(l >= 100, 1.0).otherwise(odds / (1 + odds))


def entropy(p: Column) -> Column:
    """Bits of a Bernoulli variable."""
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))


def normal_pdf(x: Column, mean, sigma) -> Column:
    return F.exp(-F.pow((x - mean) / sigma, 2) / 2) / (sigma * math.sqrt(TAU))


def scale_gain(min_scale: Column, expected: Column, desired: Column, max_scale: int = 3) -> Column:
    """Scales that an observation would refine by: none if it is fine enough or would not get finer."""
    none = (desired >= max_scale) | (min_scale <= desired) | (expected >= min_scale)
    return F.when(none, 0).otherwise(min_scale - F.greatest(expected, desired))


def distance_gain(min_dist: Column, expected: Column, desired, far: float) -> Column:
    none = (min_dist <= desired) | (expected >= min_dist)
    return F.when(none, 0.0).otherwise((min_dist - F.greatest(expected, F.lit(desired))) / far)


#: Pixels for each voxel at which scales change, and the bands in which a scale stays.
SCALE_LIMITS = (1.5, 3.0, 6.0)
SCALE_BANDS = ((0.0, 1.75), (1.25, 3.25), (2.75, 6.25), (5.75, float("inf")))


def integration_scale(z: Column, focal: float, voxel_dim: float, last: Column | None = None) -> Column:
    """Scale at which a block at depth z is updated; with a last scale, it moves by one step and only out of its band."""
    ratio = z / (focal * voxel_dim)
    fresh = F.when(ratio < SCALE_LIMITS[0], 0).when(ratio < SCALE_LIMITS[1], 1).when(ratio < SCALE_LIMITS[2], 2).otherwise(3)
    if last is None:
        return fresh
    low, high = (F.element_at(F.array(*[F.lit(b[k]) for b in SCALE_BANDS]), last.cast("int") + 1) for k in (0, 1))
    return F.when(last < 0, fresh).when(ratio < low, last - 1).when(ratio > high, last + 1).otherwise(last)


def three_sigma(d: Column, k: float, low: float, high: float, quadratic: bool = False) -> Column:
    return 3 * clamp(k * (d * d if quadratic else d), low, high)


def surface_thickness(d: Column, k: float, low: float, high: float) -> Column:
    return clamp(k * d, low, high)


def occupancy_sample(r: Column, sigma3: Column, tau: Column, low: float = -5.015, high: float = 5.015) -> Column:
    """Log-odds of a voxel at signed distance r behind the measured surface; null beyond the surface's thickness."""
    ahead = F.least(low - low / sigma3 * (r + sigma3), F.lit(high))
    behind = F.least(-low * tau / (2 * sigma3), F.lit(high))
    return F.when(r < -sigma3, low).when(r < tau / 2, ahead).when(r < tau, behind)


def low_variance(node_min: Column, node_max: Column, depth_min: Column, depth_max: Column, sigma3: Column, tau: Column) -> Column:
    """+1: all behind the surface; -1: all before it; 0: mixed."""
    return F.when(node_min - depth_max > 1.25 * tau, 1).when(node_max - depth_min < -1.25 * sigma3, -1).otherwise(0)


def bspline_occupancy(v: Column) -> Column:
    """Smoothed step of a signed distance in sigmas: Q(v) - Q(v - 3) / 2 with the quadratic B-spline's integral Q."""
    def q(t: Column) -> Column:
        inner = F.when(t < -1, F.pow(t + 3, 3) / 48).when(t < 1, 0.5 + t * (3 + t) * (3 - t) / 24).otherwise(1 - F.pow(3 - t, 3) / 48)
        return F.when(t <= -3, 0.0).when(t >= 3, 1.0).otherwise(inner)

    return q(v) - q(v - 3) * 0.5


def slerp(a: list[Column], b: list[Column], t: Column) -> list[Column]:
    """Between unit quaternions (x, y, z, w), the shorter way; nearly equal ones are interpolated linearly."""
    dot = sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])
    near = F.abs(dot)
    angle = F.acos(F.least(near, F.lit(1.0)))
    u = F.when(near > 1 - 1e-12, 1 - t).otherwise(F.try_divide(F.sin((1 - t) * angle), F.sin(angle)))
    v = F.when(near > 1 - 1e-12, t).otherwise(F.try_divide(F.sin(t * angle), F.sin(angle))) * F.when(dot < 0, -1.0).otherwise(1.0)
    return [u * x + v * y for x, y in zip(a, b)]


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def yaw_quaternion(yaw: Column) -> list[Column]:
    return [F.lit(0.0), F.lit(0.0), F.sin(yaw / 2), F.cos(yaw / 2)]


def roll_pitch_yaw(q: list[Column]) -> list[Column]:
    x, y, z, w = q
    return [F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), F.asin(clamp(2 * (w * y - z * x), -1.0, 1.0)), F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))]


def path_time(distance: Column, yaw_change: Column, speed: float, turning: float) -> Column:
    """Seconds; null for no motion at all."""
    t = F.greatest(distance / speed, F.abs(yaw_change) / turning)
    return F.when(t > 1e-9, t)


def within_threshold(position_error: Column, yaw_error: Column, most_apart: float, most_turned: float) -> Column:
    """Whether a pose has reached its goal."""
    return (position_error <= most_apart) & (F.abs(yaw_error) <= most_turned)


def pack_rgba(r: Column, g: Column, b: Column, a=255) -> Column:
    return r.cast("long").bitwiseOR(F.shiftleft(g.cast("long"), 8)).bitwiseOR(F.shiftleft(b.cast("long"), 16)).bitwiseOR(F.shiftleft(F.lit(a).cast("long"), 24))


def unpack_rgba(c: Column) -> list[Column]:
    return [F.shiftright(c, 8 * k).bitwiseAND(F.lit(255).cast("long")) for k in range(4)]


def gray_ramp(x: Column, low: float, high: float) -> Column:
    return F.floor(255 * clamp((x - low) / (high - low), 0.0, 1.0)).cast("long")


def argmax(values: Column) -> Column:
    """Index of the first greatest element."""
    return F.array_position(values, F.array_max(values)) - 1


def mixed_radix(parts: list[tuple[Column, int]]) -> Column:
    """Linear index of digits, most significant first."""
    out = F.lit(0).cast("long")
    for x, n in parts:
        out = out * n + x
    return out


def digits(index: Column, radices: list[int]) -> list[Column]:
    """The inverse of mixed_radix()."""
    out = []
    for n in reversed(radices):
        out.append(index % n)
        index = F.floor(index / n)
    return list(reversed(out))
