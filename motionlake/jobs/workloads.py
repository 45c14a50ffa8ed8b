"""Whole workloads made of the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.operators import acquisition, alignment, binning, kspace, scan, signal
from motionlake.sources.tables import materialize, read_bundle, write_bundle


@dataclass(frozen=True)
class Binned:
    """Readouts with motion and state, scans with too few samples, and scans whose slices are uneven."""

    readouts: DataFrame
    too_few: DataFrame
    uneven: DataFrame


@dataclass(frozen=True)
class Bundle:
    """Gridded lines without readout oversampling, readouts with motion, and the scans left out with their ``reason``."""

    lines: DataFrame
    readouts: DataFrame
    quarantined: DataFrame


def aligned_motion(readouts: DataFrame, sensor: DataFrame, triggers: DataFrame, ticks_per_s: float, cutoff: float) -> DataFrame:
    """``readouts(scan_id, acq_idx, acq_ts, ...)`` with ``t`` and ``motion``, written to the shared folder.

    ``sensor(scan_id, channel, t, y)`` and ``triggers(scan_id, kind, t)`` are in ticks. The stronger channel is low-pass
    filtered and freed of its drift, times are counted from the end of the sequence and of the readouts, and the signal
    is interpolated at the readouts. A scan without a sequence or a sample has null motion.
    """
    lines = acquisition.readout_time(readouts).withColumnRenamed("t_s", "t")
    # One row a scan, and the narrow samples of one channel: both are read by several steps.
    timed = alignment.sensor_time(sensor, materialize(alignment.pair_sequences(triggers)), ticks_per_s)
    strong = materialize(timed.join(signal.pick_channel(timed).select("scan_id", "channel"), ["scan_id", "channel"]))
    smooth = signal.zero_phase(strong.select("scan_id", "channel", F.col("t_s").alias("t"), "y"), cutoff, "low", ("scan_id", "channel"))
    clean = signal.detrend_quadratic(smooth.select("scan_id", "t", F.col("filtered").alias("y")))
    # Several steps read the narrow aligned table, which filters in Python precede: it is kept.
    return materialize(alignment.interp_asof(clean.select("scan_id", "t", F.col("detrended").alias("y")), lines))


def align_and_bin(acq: DataFrame, sensor: DataFrame, triggers: DataFrame, n_z: int, k: int, ticks_per_s: float, cutoff: float = 3.0, n_iter: int = 20, digits: int | None = None) -> Binned:
    """Raw readouts to readouts with a motion state.

    ``acq(scan_id, acq_idx, acq_ts, flags, ky, kz, nex, z)`` without sample arrays; sensor and triggers as in
    ``aligned_motion``. Arrays are joined to the result by ``acq_idx`` where they are needed. With ``digits``, those of the
    sensor's resolution, states are those of the rounded motion: rounds then read a number of values that the range bounds.
    """
    placed = aligned_motion(acquisition.keep_imaging(acq), sensor, triggers, ticks_per_s, cutoff)
    readouts = materialize(acquisition.slice_tables(placed, n_z))
    seen = F.col("motion") if digits is None else F.round("motion", digits)
    binned = binning.bin_motion(readouts.select("scan_id", "acq_idx", seen.alias("motion")), k, n_iter, key="acq_idx")
    out = readouts.join(binned.select("scan_id", "acq_idx", F.col("label").alias("state"), "center"), ["scan_id", "acq_idx"])
    return Binned(out, binning.too_few(readouts, k), acquisition.quarantine(placed, n_z))


def raw_to_bundle(acq: DataFrame, meta: DataFrame, sensor: DataFrame, triggers: DataFrame, path: str, ticks_per_s: float, cutoff: float = 3.0) -> Bundle:
    """Raw acquisitions of all scans to an aligned bundle below ``path``, in one job.

    ``acq`` has a row per readout and coil, coils from 0; ``meta`` holds each scan's largest counters. Readouts of the
    rejected kinds go, the volume axis is the slice or the partition, each readout gets its motion, and lines are placed
    (of several at a place the last in file order) and freed of the readout's oversampling. Scans whose slices differ in
    lines, or that have no motion signal, are left out whole and listed in ``quarantine``; an uneven scan counts as that.
    Sample arrays meet only the narrow tables' outcome: which lines stay.
    """
    spark = acq.sparkSession
    kept = acquisition.volume_axis(acquisition.keep_imaging(acq), meta).withColumnRenamed("repetition", "nex")
    counters = kept.filter("coil = 0").select("scan_id", "acq_idx", "acq_ts", "ky", "kz", "nex", "z")
    placed = aligned_motion(counters, sensor, triggers, ticks_per_s, cutoff)
    uneven = acquisition.quarantine(placed).select("scan_id", F.lit("uneven slices").alias("reason"))
    silent = placed.groupBy("scan_id").agg(F.count("motion").alias("n")).filter("n = 0").select("scan_id", F.lit("no motion signal").alias("reason"))
    uneven.unionByName(silent).groupBy("scan_id").agg(F.max("reason").alias("reason")).write.parquet(f"{path}/quarantine")
    out = spark.read.parquet(f"{path}/quarantine")
    readouts = acquisition.line_index(placed.join(out, "scan_id", "left_anti"))
    last = acquisition.scatter_lines(kept.join(out, "scan_id", "left_anti"))
    lines = kspace.remove_oversampling(last.select("scan_id", "coil", "nex", "ky", "z", "re", "im"))
    write_bundle(lines, readouts, path)
    return Bundle(*read_bundle(spark, path), out)


def best_accelerometer(samples: DataFrame, cutoff: float, seconds: float = 50.0, threshold: float = 0.002) -> DataFrame:
    """The low band of each scan's best channel, over its deviation ``dev``: ``samples(scan_id, sensor_id, channel, t, y)`` with one sample a time.

    Both bands are filtered; a channel's quality weighs the noise of its high band against what the bands differ by;
    of the channels kept the strongest of the strongest sensor stays.
    """
    keys = ["scan_id", "sensor_id", "channel"]
    low, high = (signal.zero_phase(samples, cutoff, kind).select(*keys, "t", F.col("filtered").alias(kind)) for kind in ("low", "high"))
    rows = scan.bucketed(low.join(high, [*keys, "t"]), keys, ["t"])
    bands = materialize(scan.running(rows, keys, ["t"], sums={"idx": F.lit(1).cast("bigint")}).withColumn("idx", F.col("idx") - 1).drop(scan.BUCKET))
    quality = signal.channel_quality(bands, seconds, threshold)
    own = bands.select(*keys, "t", F.col("low").alias("y"))
    dev = own.groupBy(*keys).agg(F.stddev_pop("y").alias("dev"))
    return signal.best_stream(own, quality).join(dev, keys)
