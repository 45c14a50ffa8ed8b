"""Matrix sizes: one number for all scans, or a column with each scan's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Size = int | str | Column


def size(n: Size) -> Column:
    """The size as a column; a string names one."""
    return F.lit(n) if isinstance(n, int) else F.col(n) if isinstance(n, str) else n


def corner(full: Size, part: Size) -> Column:
    """Where a centre block begins."""
    return F.floor((size(full) - size(part)) / 2).cast("bigint")


def upto(n: Column) -> Column:
    """The numbers from 0 to below ``n``."""
    return F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)
