"""Column helpers: 3-D vectors, rotations, draws that depend on their key alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str = "", suffix: str = "") -> Vec:
    """The columns <prefix>x, <prefix>y, <prefix>z."""
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in "xyz")


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Vec, k) -> Vec:
    return tuple(x * k for x in a)


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def unit(a: Vec) -> Vec:
    """a / |a|; null where |a| is 0."""
    n = F.nullif(norm(a), F.lit(0.0))
    return tuple(x / n for x in a)


def named(a: Vec, prefix: str) -> list[Column]:
    return [x.alias(f"{prefix}{c}") for x, c in zip(a, "xyz", strict=True)]


def mat_apply(m: Column, a: Vec, w: float = 1.0) -> Vec:
    """Rows 1-3 of a 4 x 4 matrix (array of 16, row-major) times (a, w)."""
    return tuple(F.element_at(m, 4 * i + 1) * a[0] + F.element_at(m, 4 * i + 2) * a[1] + F.element_at(m, 4 * i + 3) * a[2] + F.element_at(m, 4 * i + 4) * w for i in range(3))


def mat_mul(a: Column, b: Column, n: int = 4) -> Column:
    """Product of two n x n matrices held as arrays."""
    return F.array(*[sum((F.element_at(a, n * i + k + 1) * F.element_at(b, n * k + j + 1) for k in range(1, n)), F.element_at(a, n * i + 1) * F.element_at(b, j + 1)) for i in range(n) for j in range(n)])


def rigid_inverse(m: Column) -> Column:
    """Inverse of a rigid 4 x 4 transform."""
    at = lambda i, j: F.element_at(m, 4 * i + j + 1)
    rows = [[at(j, i) for j in range(3)] + [-(at(0, i) * at(0, 3) + at(1, i) * at(1, 3) + at(2, i) * at(2, 3))] for i in range(3)]
    return F.array(*[x for r in rows for x in r], F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def rot_axis_angle(axis: Vec, angle: Column) -> list[list[Column]]:
    """Rotation matrix about a unit axis."""
    c, s = F.cos(angle), F.sin(angle)
    x, y, z = axis
    t = 1 - c
    return [[t * x * x + c, t * x * y - s * z, t * x * z + s * y], [t * x * y + s * z, t * y * y + c, t * y * z - s * x], [t * x * z - s * y, t * y * z + s * x, t * z * z + c]]


def sph_to_cart(r: Column, azimuth: Column, elevation: Column) -> Vec:
    """Elevation is measured from +z."""
    return (r * F.cos(azimuth) * F.sin(elevation), r * F.sin(azimuth) * F.sin(elevation), r * F.cos(elevation))


def once(df: DataFrame, *columns: Column) -> DataFrame:
    """Adds columns that are computed once a row, however often later columns use them.

    A one-row generator keeps the optimizer from copying long expressions into each use, which would outgrow a method
    of generated code.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on seed and keys alone, so that other engines draw the same."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def gauss(seed: int, *keys: Column) -> Column:
    """A standard normal number, by Box and Muller."""
    u, v = uniform(seed, *keys, F.lit("u")), uniform(seed, *keys, F.lit("v"))
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)
