"""Aligning a frame with a reference: association by projection, sums of the normal equations, and the solving loop."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry


def associate(live: DataFrame, reference: DataFrame, camera: geometry.Pinhole, pose=None, most: float = 0.1, least_dot: float = 0.8) -> DataFrame:
    """Live points with the reference pixel that they project to: code 1 with error and Jacobian, or why not.

    live and reference: u, v, px, py, pz, nx, ny, nz. pose (q, t) moves live points into the reference's frame. Codes: -1 no
    point, -2 outside the image, -3 no reference, -4 too far, -5 normals disagree.
    """
    q, t = pose or ((0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.0))
    q, t = tuple(map(F.lit, q)), tuple(map(F.lit, t))
    p = geometry.transform(q, t, tuple(F.col("p" + k) for k in "xyz"))
    n = geometry.rotate(q, tuple(F.col("n" + k) for k in "xyz"))
    moved = live.select("u", "v", F.col("nx").isNotNull().alias("some"), *[c.alias("p" + k) for k, c in zip("xyz", p)], *[c.alias("n" + k) for k, c in zip("xyz", n)])
    ru, rv, seen = camera.project(tuple(F.col("p" + k) for k in "xyz"))
    asked = moved.withColumns({"ru": ru, "rv": rv, "seen": seen})
    known = reference.select(F.col("u").alias("ru"), F.col("v").alias("rv"), *[F.col(f"{a}{k}").alias(f"r{a}{k}") for a in "pn" for k in "xyz"]).where("rnx is not null")
    both = asked.join(known, ["ru", "rv"], "left")
    gap = tuple(F.col("rp" + k) - F.col("p" + k) for k in "xyz")
    far, agree = geometry.norm(gap) > most, geometry.dot([F.col("n" + k) for k in "xyz"], [F.col("rn" + k) for k in "xyz"]) >= least_dot
    code = F.when(~F.col("some"), -1).when(~F.col("seen"), -2).when(F.col("rnx").isNull(), -3).when(far, -4).when(~agree, -5).otherwise(1)
    rn = [F.col("rn" + k) for k in "xyz"]
    j = [*rn, *geometry.cross([F.col("p" + k) for k in "xyz"], rn)]
    return both.select("u", "v", code.alias("code"), geometry.dot(rn, gap).alias("error"), *[c.alias(f"j{i}") for i, c in enumerate(j)])


def normal_sums(associated: DataFrame) -> DataFrame:
    """One row of sums: squared error, J'e (6), J'J (21), and how many of each code."""
    good = F.col("code") == 1
    j = [F.col(f"j{i}") for i in range(6)]
    total = lambda e, name: F.coalesce(F.sum(F.when(good, e)), F.lit(0.0)).alias(name)
    return associated.agg(total(F.col("error") * F.col("error"), "ee"), *[total(j[i] * F.col("error"), f"je{i}") for i in range(6)], *[total(j[i] * j[k], f"jj{i}{k}") for i in range(6) for k in range(i, 6)], *[F.sum((F.col("code") == c).cast("long")).alias(f"n{abs(c)}" + ("" if c > 0 else "_rejected")) for c in (1, -1, -2, -3, -4, -5)])


def track(live: DataFrame, reference: DataFrame, camera: geometry.Pinhole, iterations: int = 10, least_step: float = 1e-5) -> tuple[np.ndarray, float, float]:
    """Pose (4 x 4) of the live frame, root mean square error and share of inliers: one aggregation job for each step, whose 32 sums are solved on the driver."""
    pose = np.eye(4)
    rmse, share = float("inf"), 0.0
    for _ in range(iterations):
        q, t = quaternion(pose[:3, :3]), pose[:3, 3]
        s = normal_sums(associate(live, reference, camera, (tuple(map(float, q)), tuple(map(float, t))))).first()
        if not s["n1"]:
            break
        a = np.zeros((6, 6))
        for i in range(6):
            for k in range(i, 6):
                a[i, k] = a[k, i] = s[f"jj{i}{k}"]
        x = np.linalg.lstsq(a, np.array([s[f"je{i}"] for i in range(6)]), rcond=None)[0]
        pose = exponential(x) @ pose
        rmse, share = (s["ee"] / s["n1"]) ** 0.5, s["n1"] / max(1, sum(s[k] for k in s.asDict() if k.startswith("n")))
        if np.linalg.norm(x) < least_step:
            break
    return pose, rmse, share


def accepted(rmse: float, share: float, most: float = 2e-2, least: float = 0.15) -> bool:
    return rmse <= most and share >= least


def exponential(x: np.ndarray) -> np.ndarray:
    """4 x 4 transformation of a twist (translation, rotation)."""
    w = x[3:]
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    a = np.linalg.norm(w)
    b, c, d = (1.0, 0.5, 1 / 6) if a < 1e-9 else (np.sin(a) / a, (1 - np.cos(a)) / a**2, (a - np.sin(a)) / a**3)
    out = np.eye(4)
    out[:3, :3] = np.eye(3) + b * k + c * k @ k
    out[:3, 3] = (np.eye(3) + c * k + d * k @ k) @ x[:3]
    return out


def quaternion(r: np.ndarray) -> np.ndarray:
    """(x, y, z, w) of a rotation matrix."""
    i = int(np.argmax([r[0, 0], r[1, 1], r[2, 2], np.trace(r)]))
    if i == 3:
        q = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1], 1 + np.trace(r)])
    else:
        j, k = (i + 1) % 3, (i + 2) % 3
        q = np.zeros(4)
        q[i], q[j], q[k], q[3] = 1 + r[i, i] - r[j, j] - r[k, k], r[j, i] + r[i, j], r[k, i] + r[i, k], r[k, j] - r[j, k]
    return q / np.linalg.norm(q)
