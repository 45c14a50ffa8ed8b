"""Complex numbers as pairs of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def product(a: tuple[Column, Column], b: tuple[Column, Column], conj: bool = False) -> tuple[Column, Column]:
    """Real and imaginary part of ``a * b``, or of ``a * conj(b)``."""
    sign = -1.0 if conj else 1.0
    return a[0] * b[0] - sign * a[1] * b[1], sign * a[0] * b[1] + a[1] * b[0]


def square(a: tuple[Column, Column]) -> Column:
    return a[0] * a[0] + a[1] * a[1]


def modulus(a: tuple[Column, Column]) -> Column:
    return F.sqrt(square(a))
