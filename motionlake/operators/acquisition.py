"""Readouts: selection, placement on the k-space grid, and tables per slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.functions.sizes import Size, size
from motionlake.operators import scan

#: Bit numbers of the public raw-data format for readouts that are no image data: noise, navigator,
#: phase correction, feedback of two kinds, dummy scan. A flag n is the bit n - 1.
REJECTED_FLAGS = (19, 23, 24, 26, 27, 28)


def flag_mask(flags: tuple[int, ...] = REJECTED_FLAGS) -> int:
    return sum(1 << n - 1 for n in flags)


def keep_imaging(acq: DataFrame, mask: int = flag_mask()) -> DataFrame:
    """Readouts without any of the mask's flags; null flags count as none."""
    return acq.filter(F.coalesce(F.col("flags"), F.lit(0)).bitwiseAND(F.lit(mask)) == 0)


def encoded_sizes(meta: DataFrame) -> DataFrame:
    """``n_slices``, ``n_reps``, ``n_partitions`` per scan: the header's maximum plus one, or one where it is null."""
    one_more = lambda c: F.coalesce(F.col(c) + 1, F.lit(1)).cast("bigint")
    return meta.select("scan_id", one_more("max_slice").alias("n_slices"), one_more("max_rep").alias("n_reps"), one_more("max_step2").alias("n_partitions"))


def volume_axis(acq: DataFrame, meta: DataFrame) -> DataFrame:
    """``acq`` with ``z``: the partition in a slab, else the slice."""
    sizes = encoded_sizes(meta).select("scan_id", "n_slices", "n_partitions")
    slab = (F.col("n_slices") <= 1) & (F.col("n_partitions") > 1)
    return acq.join(sizes, "scan_id").withColumn("z", F.when(slab, F.col("kz")).otherwise(F.col("slice"))).drop("n_slices", "n_partitions")


def expanded_size(lines: Column, acceleration: Column) -> Column:
    """Even number of lines that an acceleration stands for."""
    r = F.greatest(F.lit(1), F.coalesce(acceleration.cast("int"), F.lit(1)))
    return (2 * F.ceil(r * F.ceil(lines / r) / 2)).cast("bigint")


def matrix_size(meta: DataFrame) -> DataFrame:
    """``ny`` and ``nz`` of every scan under its accelerations."""
    one = lambda c: F.coalesce(F.col(c) + 1, F.lit(1))
    return meta.select("scan_id", expanded_size(one("max_step1"), F.col("accel1")).alias("ny"), expanded_size(one("max_step2"), F.col("accel2")).alias("nz"))


def readout_time(acq: DataFrame, tick_s: float = 2.5e-3) -> DataFrame:
    """``acq`` with ``t_s``: seconds from the last kept readout in file order, not from the latest."""
    last = acq.groupBy("scan_id").agg(F.max_by("acq_ts", "acq_idx").alias("_last"))
    return acq.join(last, "scan_id").withColumn("t_s", (F.col("acq_ts") - F.col("_last")) * F.lit(tick_s)).drop("_last")


def scatter_lines(acq: DataFrame, keys: tuple[str, ...] = ("scan_id", "coil", "nex", "ky", "z"), order: str = "acq_idx") -> DataFrame:
    """One readout per grid place: of several the last in file order.

    The last index of each place is pre-aggregated on the keys alone and joined back, so that
    sample arrays are not sorted.
    """
    last = acq.groupBy(*keys).agg(F.max(order).alias(order))
    return acq.join(last, [*keys, order])


def dense_grid(lines: DataFrame, ny: int, values: tuple[str, ...], scan: str = "scan_id", axis: str = "ky") -> DataFrame:
    """Every place of every scan, zero where no line was acquired."""
    grid = lines.select(scan).distinct().select(scan, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ny - 1).cast("bigint"))).alias(axis))
    return grid.join(lines, [scan, axis], "left").select(scan, axis, *(F.coalesce(v, F.lit(0.0)).alias(v) for v in values))


def slice_counts(readouts: DataFrame, n_z: Size | None = None) -> DataFrame:
    """Lines of each slice, empty ones too, and whether the scan's slices have equally many.

    ``n_z`` is one number of slices, or a column with each scan's own; without it a scan's slices go up to the last seen.
    """
    last = F.max("z") if n_z is None else F.max(size(n_z)) - 1
    per = readouts.groupBy("scan_id").agg(last.cast("bigint").alias("_last"))
    grid = per.select("scan_id", F.explode(F.sequence(F.lit(0).cast("bigint"), "_last")).alias("z"))
    counts = grid.join(readouts.groupBy("scan_id", "z").agg(F.count("*").alias("n_lines")), ["scan_id", "z"], "left").fillna(0, ["n_lines"])
    range_ = counts.groupBy("scan_id").agg((F.min("n_lines") == F.max("n_lines")).alias("uniform"))
    return counts.join(range_, "scan_id")


def slice_tables(readouts: DataFrame, n_z: Size | None = None) -> DataFrame:
    """``readouts`` of the scans whose slices have equally many lines, with their chronological ``line_idx``."""
    good = slice_counts(readouts, n_z).filter("uniform").select("scan_id").distinct()
    return line_index(readouts.join(good, "scan_id", "left_semi"))


def quarantine(readouts: DataFrame, n_z: Size | None = None) -> DataFrame:
    """Scans whose slices differ in lines, with the least and most."""
    return slice_counts(readouts, n_z).filter(~F.col("uniform")).groupBy("scan_id").agg(F.min("n_lines").alias("least"), F.max("n_lines").alias("most"))


def line_index(readouts: DataFrame, order: str = "acq_idx") -> DataFrame:
    """``readouts`` with ``line_idx``: their order in file within a slice, from 0."""
    rows = scan.bucketed(readouts, ["scan_id", "z"], [order])
    return scan.running(rows, ["scan_id", "z"], [order], sums={"line_idx": F.lit(1).cast("bigint")}).withColumn("line_idx", F.col("line_idx") - 1).drop(scan.BUCKET)


def nex_values(acq: DataFrame) -> DataFrame:
    """Sorted repetition numbers seen in each scan."""
    return acq.groupBy("scan_id").agg(F.sort_array(F.collect_set("nex")).alias("nex_values"))


def select_slice(readouts: DataFrame, z: int = 0) -> DataFrame:
    """One slice of a stack; ValueError if the number is negative or beyond every scan."""
    if z < 0:
        raise ValueError("the slice must not be negative")
    top = readouts.agg(F.max("z")).first()[0]
    if top is None or z > top:
        raise ValueError(f"slice {z} is beyond the last, {top}")
    return readouts.filter(F.col("z") == z)
