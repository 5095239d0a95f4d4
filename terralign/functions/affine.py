"""3x3 matrices as arrays of nine doubles, row by row, and what is read from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


def matrix(*cells) -> Column:
    return F.array(*(c if isinstance(c, Column) else F.lit(float(c)) for c in cells))


def similarity(x: Column, y: Column, theta: Column, scale: Column, cx: Column, cy: Column) -> Column:
    """Turns and scales about an image's centre (cx, cy), which lands on (x, y)."""
    c, s = F.cos(theta) * scale, F.sin(theta) * scale
    return matrix(c, -s, x - cx * c + cy * s, s, c, y - cx * s - cy * c, 0, 0, 1)


def project(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """The point that m maps (x, y) to; a depth next to zero counts as 1e-8."""
    at = lambda i: F.get(m, i)
    z = at(6) * x + at(7) * y + at(8)
    z = F.when(F.abs(z) < 1e-8, 1e-8).otherwise(z)
    return (at(0) * x + at(1) * y + at(2)) / z, (at(3) * x + at(4) * y + at(5)) / z


def multiply(a: Column, b: Column) -> Column:
    return F.array(*(sum((F.get(a, 3 * i + k) * F.get(b, 3 * k + j) for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)))


def shift(dx: Column, dy: Column) -> Column:
    return matrix(1, 0, dx, 0, 1, dy, 0, 0, 1)


def determinant2(m: Column) -> Column:
    return F.get(m, 0) * F.get(m, 4) - F.get(m, 1) * F.get(m, 3)


def _minor(m: Column, i: int, j: int) -> Column:
    (a, b), (c, d) = ([3 * r + k for k in range(3) if k != j] for r in range(3) if r != i)
    return F.get(m, a) * F.get(m, d) - F.get(m, b) * F.get(m, c)


def determinant(m: Column) -> Column:
    return F.get(m, 0) * _minor(m, 0, 0) - F.get(m, 1) * _minor(m, 0, 1) + F.get(m, 2) * _minor(m, 0, 2)


def inverse(m: Column) -> Column:
    """The inverse; null or infinite entries where the determinant is 0."""
    det = determinant(m)
    return F.array(*((_minor(m, c, r) * (-1) ** (r + c)) / det for r in range(3) for c in range(3)))


def scale_and_rotation(m: Column) -> tuple[Column, Column]:
    return F.sqrt(F.get(m, 0) * F.get(m, 0) + F.get(m, 3) * F.get(m, 3)), F.atan2(F.get(m, 3), F.get(m, 0))


def is_perspective(m: Column, eps: float = 1e-6) -> Column:
    return (F.abs(F.get(m, 6)) > eps) | (F.abs(F.get(m, 7)) > eps) | (F.abs(F.get(m, 8) - 1) > eps)


def is_sane(m: Column, width: Column, height: Column, max_scale: float = 2.5, max_rotation: float = 75.0, max_shift: float = 1.5) -> Column:
    """Whether a pair's transform is believable: area, scale along both axes, turn and shift within bounds."""
    det = determinant2(m)
    sx = F.sqrt(F.get(m, 0) * F.get(m, 0) + F.get(m, 3) * F.get(m, 3))
    sy = F.sqrt(F.get(m, 1) * F.get(m, 1) + F.get(m, 4) * F.get(m, 4))
    turn = F.abs(F.degrees(F.atan2(F.get(m, 3), F.get(m, 0))))
    ok = (det > 0.05) & (det < 20) & sx.between(1 / max_scale, max_scale) & sy.between(1 / max_scale, max_scale) & (turn <= max_rotation)
    ok = ok & (F.abs(F.get(m, 2)) <= max_shift * width) & (F.abs(F.get(m, 5)) <= max_shift * height)
    return F.coalesce(ok, F.lit(False))


def canvas_transform(left: Column, top: Column, pixel: Column) -> Column:
    """A north-up canvas' pixel to world transform as six numbers: a, b, c, d, e, f of x = a col + b row + c, y = d col + e row + f."""
    return F.array(*(c.cast("double") for c in (pixel, F.lit(0), left, F.lit(0), -pixel, top)))


def world_to_pixel(x: Column, y: Column, left: Column, top: Column, pixel: Column) -> tuple[Column, Column]:
    return (x - left) / pixel, (top - y) / pixel


def pixel_to_world(col: Column, row: Column, left: Column, top: Column, pixel: Column) -> tuple[Column, Column]:
    return left + col * pixel, top - row * pixel
