"""Helpers that several text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """URI of a new folder that driver and executors share.

    It lies below ``spark.checkpoint.dir``. Where that is unset, a session on one machine gets a
    temporary folder; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='motionlake-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """The pyarrow file system and path of a URI, usable in driver and tasks alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A column's strings as UTF-8 bytes; null becomes the empty string."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in column.to_pylist()]


#: Rows that JVM and Python exchange at once.
BATCH_ROWS = 2000


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session exchanges at most ``BATCH_ROWS`` rows at once with Python from now on.

    A batch of whole texts stands in memory several times, on both sides and in both directions.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str
) -> DataFrame:
    """``mapInArrow`` over single batches; ``make`` runs once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows and (out := step(batch)) is not None:
                yield out
                del out, batch
        # A worker outlives its task: what Arrow holds unused would stand beside the next task's.
        pa.default_memory_pool().release_unused()

    return bounded_batches(df).mapInArrow(run, schema)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with marks before it where columns have it already, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(doc_id: int | None, mod: int) -> int:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def fold_column(doc_id: str, mod: int):
    """:func:`fold` as a column."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(mod))
