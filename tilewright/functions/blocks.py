"""Expressions over several channels of a tile: eigenvalues, angles, gravity, spectra, matrices, draws."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import uniform
from . import arrays as A


def eigenvalues3(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> list[Column]:
    """Of a symmetric 3 x 3 matrix, greatest first, in closed form."""
    q = (xx + yy + zz) / 3
    p = F.sqrt(F.greatest(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6, F.lit(1e-24)))
    det = (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)
    phi = F.acos(F.greatest(F.least(det / (2 * p * p * p), F.lit(1.0)), F.lit(-1.0))) / 3
    first, last = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    return [first, 3 * q - first - last, last]


def angles(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Pitch and roll of a mean acceleration."""
    return F.atan2(-x, F.sqrt(y * y + z * z)), F.atan2(y, z)


def vertical_horizontal(x: Column, y: Column, z: Column, gx: Column, gy: Column, gz: Column, n: Column) -> tuple[Column, Column]:
    """Per sample, what moves along gravity (gx, gy, gz) of length n, and the length of what moves across it."""
    rows = F.arrays_zip(x.alias("x"), y.alias("y"), z.alias("z"))
    along = lambda s: ((s["x"] - gx) * gx + (s["y"] - gy) * gy + (s["z"] - gz) * gz) / n
    length = lambda s: (s["x"] - gx) * (s["x"] - gx) + (s["y"] - gy) * (s["y"] - gy) + (s["z"] - gz) * (s["z"] - gz)
    return F.transform(rows, along), F.transform(rows, lambda s: F.sqrt(F.greatest(length(s) - along(s) * along(s), F.lit(0.0))))


def phase(a: Column, n: int, k: Column) -> Column:
    """Angle of the Fourier coefficient k of n samples."""
    turn = lambda i: 2 * math.pi * k * i / n
    return F.atan2(A.total(F.transform(a, lambda x, i: -x * F.sin(turn(i)))), A.total(F.transform(a, lambda x, i: x * F.cos(turn(i)))))


def welch(a: Column, n: int, size: int, step: int) -> Column:
    """Mean power spectrum of centred, Hann-weighted segments."""
    hann = F.array(*[F.lit(0.5 - 0.5 * math.cos(2 * math.pi * j / size)) for j in range(size)])
    parts = [A.power(F.zip_with(A.centred(F.slice(a, s + 1, size)), hann, lambda x, w: x * w), size) for s in range(0, n - size + 1, step)]
    return F.array(*[sum((F.get(p, F.lit(k)) for p in parts[1:]), F.get(parts[0], F.lit(k))) / len(parts) for k in range(size // 2 + 1)])


def mirrored(v: Column, limb: Column, which: int) -> Column:
    """The value, negated on one limb, so that left and right move alike."""
    return F.when(limb == which, -v).otherwise(v)


def applied(a: Column, matrix: np.ndarray) -> Column:
    """matrix times a."""
    return F.array(*[A.dot(a, F.array(*[F.lit(float(v)) for v in row])) for row in matrix])


def augmented(df: DataFrame, key: Column) -> DataFrame:
    """x, y, z scaled by 0.9 to 1.1, turned about z by up to 15 degrees, jittered by up to 0.01 with
    alternating sign; z dropped in one of five. Every draw is a hash of the key."""
    u = lambda seed: uniform(key, seed)
    df = df.withColumns({"__k": 0.9 + 0.2 * u(1), "__a": (u(2) - 0.5) * (math.pi / 6), "__j": 0.02 * (u(3) - 0.5), "__gone": u(4) < 0.2})
    k, a, j = F.col("__k"), F.col("__a"), F.col("__j")
    sign = lambda i: F.pow(F.lit(-1.0), i.cast("double"))
    rows = F.arrays_zip("x", "y")
    x = F.transform(rows, lambda s, i: k * (F.cos(a) * s["x"] - F.sin(a) * s["y"]) + j * sign(i))
    y = F.transform(rows, lambda s, i: k * (F.sin(a) * s["x"] + F.cos(a) * s["y"]) + j * sign(i))
    z = F.transform("z", lambda v, i: F.when(F.col("__gone"), F.lit(0.0)).otherwise(k * v + j * sign(i)))
    return df.withColumns({"x": x, "y": y, "z": z}).drop("__k", "__a", "__j", "__gone")
