"""Reading and writing scan tables as Parquet."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACQUISITIONS = "scan_id bigint, acq_idx bigint, coil int, flags bigint, ky int, kz int, repetition int, slice int, acq_ts bigint, re array<double>, im array<double>"
SENSOR_SAMPLES = "scan_id bigint, sensor_id int, channel int, sensor_type string, t_ticks bigint, value double"
READOUTS = "scan_id bigint, z int, line_idx int, ky int, kz int, nex int, motion double"
#: Sensor families: belts of two channels, accelerometers of three.
SENSOR_TYPES = {"BELT": "BELT", "MARMOT": "MARMOT"}
#: Lines of a slice that a row of a bundle holds at most.
BLOCK_LINES = 1024


def shared_path(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``, which driver and executors share.

    Where that is unset, a session on one machine gets a temporary folder; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='motionlake-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back, which ends the lineage."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_acquisitions(spark: SparkSession, path: str) -> DataFrame:
    """Readouts, one row per acquisition and coil."""
    return spark.read.schema(ACQUISITIONS).parquet(path)


def read_sensor(spark: SparkSession, path: str, sensor_type: str) -> DataFrame:
    """Samples of one sensor family; sensors without a finite value are dropped. Unknown families are an error."""
    if sensor_type not in SENSOR_TYPES:
        raise ValueError(f"unknown sensor type {sensor_type}")
    samples = spark.read.schema(SENSOR_SAMPLES).parquet(path).filter(F.col("sensor_type") == SENSOR_TYPES[sensor_type])
    return drop_empty_sensors(samples)


def drop_empty_sensors(samples: DataFrame, value: str = "value") -> DataFrame:
    some = samples.filter(F.col(value).isNotNull() & ~F.isnan(value)).select("scan_id", "sensor_id").distinct()
    return samples.join(some, ["scan_id", "sensor_id"], "left_semi")


def bundle_rows(bundle: DataFrame) -> DataFrame:
    """A bundle's blocks, whose lines are arrays (motion, idx_ky, idx_kz, idx_nex), as one row per readout.

    A block begins at its ``first_line``; a bundle without that column has a slice's lines in one row, from 0.
    """
    first = F.col("first_line") if "first_line" in bundle.columns else F.lit(0)
    lines = bundle.select("scan_id", "z", first.alias("_first"), F.posexplode(F.arrays_zip("motion", "idx_ky", "idx_kz", "idx_nex")).alias("_pos", "l"))
    return lines.select("scan_id", "z", (F.col("_first") + F.col("_pos")).alias("line_idx"), F.col("l.idx_ky").alias("ky"), F.col("l.idx_kz").alias("kz"), F.col("l.idx_nex").alias("nex"), F.col("l.motion").alias("motion"))


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The k-space lines and the readouts of an aligned bundle."""
    return spark.read.parquet(f"{path}/kspace_lines"), bundle_rows(spark.read.parquet(f"{path}/bundle"))


def write_bundle(lines: DataFrame, readouts: DataFrame, path: str, nex_source: str = "repetition", block: int = BLOCK_LINES) -> None:
    """Write k-space lines, and readouts in blocks of ``block`` lines of a slice; the repetitions seen and their source stand as columns.

    A slice's ``line_idx`` run from 0 without gaps. Lines are rebalanced by scan and sorted in their files: adaptive execution
    splits a large scan and puts small ones together, so that files are bounded by size, and a scan is found by row groups.
    """
    seen = readouts.groupBy("scan_id").agg(F.sort_array(F.collect_set("nex")).alias("nex_values"))
    matrix = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("line_idx", c))), lambda x: x[c])
    blocks = readouts.withColumn("_block", F.floor(F.col("line_idx") / block)).groupBy("scan_id", "z", "_block")
    slices = blocks.agg(F.min("line_idx").alias("first_line"), *(matrix(c).alias(c) for c in ("motion", "ky", "kz", "nex"))).drop("_block")
    bundle = slices.withColumnsRenamed({"ky": "idx_ky", "kz": "idx_kz", "nex": "idx_nex"})
    bundle.join(seen, "scan_id").withColumn("nex_source", F.lit(nex_source)).write.parquet(f"{path}/bundle")
    order = [c for c in ("scan_id", "z", "coil", "nex", "ky") if c in lines.columns]
    lines.hint("rebalance", "scan_id").sortWithinPartitions(*order).write.parquet(f"{path}/kspace_lines")


def ingest_images(pixels: DataFrame) -> DataFrame:
    """Luminance of ``pixels(image_id, voxel, r, g, b)``, scaled to [0, 1] per image; a flat image becomes 0."""
    grey = pixels.select("image_id", "voxel", (0.2989 * F.col("r") + 0.5870 * F.col("g") + 0.1140 * F.col("b")).alias("v"))
    span = grey.groupBy("image_id").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.col("v") - F.col("_lo"))
    return grey.join(span, "image_id").select("image_id", "voxel", scaled.alias("v"))


def mean_over_nex(images: DataFrame, scale: DataFrame | None = None) -> DataFrame:
    """Mean image over repetitions of ``images(scan_id, nex, voxel, re, im)``, times the scan's k-space scale."""
    out = images.groupBy("scan_id", "voxel").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    if scale is None:
        return out
    return out.join(scale, "scan_id").select("scan_id", "voxel", (F.col("re") * F.col("scale")).alias("re"), (F.col("im") * F.col("scale")).alias("im"))


def write_results(images: DataFrame, motion: DataFrame, log: DataFrame, path: str, scale: DataFrame | None = None) -> None:
    """Write images, their mean over repetitions, the motion model and the log."""
    images.write.parquet(f"{path}/images")
    mean_over_nex(images, scale).write.parquet(f"{path}/image_mean")
    motion.write.parquet(f"{path}/motion")
    log.write.parquet(f"{path}/log")
