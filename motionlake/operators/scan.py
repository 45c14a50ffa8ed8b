"""Ordered scans in two levels: inside ranges of rows, and over one carried row per range.

A window by key alone sorts a whole key in one task. Here rows are first dealt into ranges of (key, order), so that a key
with a large share of all rows fills many of them; what a range needs from those before or after it is one small row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.sources.tables import materialize

BUCKET = "_bucket"


def bucketed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_bucket``, written to the shared folder: the number of its range of keys and order, nulls last.

    There are as many ranges as shuffle partitions; their borders come from Spark's sample of the rows. Rows equal in
    keys and order share a range, whatever their number.
    """
    by = [F.col(c).asc_nulls_last() for c in (*keys, *order)]
    return materialize(df.repartitionByRange(*by).withColumn(BUCKET, F.spark_partition_id()))


def _inside(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, BUCKET).orderBy(*(F.col(c).asc_nulls_last() for c in order))


def _ranges(keys: list[str]):
    """Over a key's ranges; without keys all ranges, one row each, meet in one task."""
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(BUCKET)


def _with_carried(df: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the carried values of its range; null keys meet null keys."""
    other = carried.withColumnsRenamed({k: f"_k_{k}" for k in (*keys, BUCKET)})
    on = F.col(BUCKET) == F.col(f"_k_{BUCKET}")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(other, on).drop(*(f"_k_{k}" for k in (*keys, BUCKET)))


def running(rows: DataFrame, keys: list[str], order: list[str], ties: bool = False, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """Bucketed ``rows`` with running sums and maxima from the key's first row on, the row itself included.

    With ``ties`` rows of equal order count as well; else they stand in any order.
    """
    sums, maxima = sums or {}, maxima or {}
    todo = {n: (F.sum, v) for n, v in sums.items()} | {n: (F.max, v) for n, v in maxima.items()}
    w = _inside(keys, order)
    w = w if ties else w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_v_{n}": v for n, (_, v) in todo.items()})
    whole = rows.groupBy(*keys, BUCKET).agg(*(f(f"_v_{n}").alias(f"_c_{n}") for n, (f, _) in todo.items()))
    earlier = _ranges(keys).rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(*keys, BUCKET, *(f(f"_c_{n}").over(earlier).alias(f"_c_{n}") for n, (f, _) in todo.items()))
    out = _with_carried(rows.withColumns({n: f(f"_v_{n}").over(w) for n, (f, _) in todo.items()}), carried, keys)
    joined = {n: F.coalesce(F.col(n) + F.col(f"_c_{n}"), n, f"_c_{n}") for n in sums} | {n: F.greatest(n, f"_c_{n}") for n in maxima}
    return out.withColumns(joined).drop(*(f"_{p}_{n}" for n in todo for p in "vc"))


def neighbour(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, ahead: bool = False) -> DataFrame:
    """Bucketed ``rows`` with ``name``: a value of the row before, or after with ``ahead``; null where the key has none."""
    w, place = _inside(keys, order), F.struct(*(F.struct(F.col(c).isNull(), F.col(c)) for c in order))
    rows = rows.withColumn("_v", F.struct(value.alias("v")))
    edge = (F.min_by if ahead else F.max_by)("_v", place)
    shift = F.lead if ahead else F.lag
    carried = rows.groupBy(*keys, BUCKET).agg(edge.alias("_c")).select(*keys, BUCKET, shift("_c").over(_ranges(keys)).alias("_c"))
    out = _with_carried(rows.withColumn("_n", shift("_v").over(w)), carried, keys)
    return out.withColumn(name, F.coalesce("_n", "_c")["v"]).drop("_v", "_n", "_c")
