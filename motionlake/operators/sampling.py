"""Phase-encode lines: their order and shots, and the cells that they fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions.sizes import Size, size, upto
from motionlake.operators import scan


def sample_cells(readouts: DataFrame, nx: Size, ny: Size, nz: Size = 1) -> DataFrame:
    """A row per flat cell of each readout: ``kx * ny + ky``, or ``(kx * ny + ky) * nz + kz`` in 3D; sizes are numbers or columns."""
    flat, deep = F.col("kx") * size(ny) + F.col("ky"), size(nz)
    cell = F.when(deep == 1, flat).otherwise(flat * deep + F.col("kz"))
    return readouts.withColumn("kx", F.explode(upto(size(nx)))).withColumn("cell", cell.cast("bigint")).drop("kx")


def lines(meta: DataFrame) -> DataFrame:
    """All lines of ``meta(scan_id, nex, ny, nz)``: a row per repetition, ky and kz."""
    span = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    return meta.select("scan_id", span("n_nex").alias("nex"), "ny", "nz").select("scan_id", "nex", "nz", "ny", span("ny").alias("ky")).select("scan_id", "nex", "ny", "nz", "ky", span("nz").alias("kz"))


def permute(df: DataFrame, seed: int, keys: tuple[str, ...] = ("scan_id", "nex"), items: tuple[str, ...] = ("ky", "kz")) -> DataFrame:
    """``df`` with ``pos``: a random place within its keys, the rank of a hash of seed, keys and items."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in (*keys, *items))))
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(h, *items)).cast("bigint") - 1)


def global_shots(readouts: DataFrame) -> DataFrame:
    """``readouts`` with ``global_shot``: their shot after all shots of earlier repetitions."""
    shots = scan.bucketed(readouts.select("scan_id", "nex", "shot").distinct(), ["scan_id"], ["nex", "shot"])
    numbered = scan.running(shots, ["scan_id"], ["nex", "shot"], sums={"global_shot": F.lit(1).cast("bigint")})
    return readouts.join(numbered.select("scan_id", "nex", "shot", (F.col("global_shot") - 1).alias("global_shot")), ["scan_id", "nex", "shot"])


def concat_nex(tables: list[DataFrame]) -> DataFrame:
    """Tables of single repetitions, with their number in ``nex``."""
    out = None
    for k, t in enumerate(tables):
        t = t.withColumn("nex", F.lit(k).cast("bigint"))
        out = t if out is None else out.unionByName(t)
    if out is None:
        raise ValueError("no table given")
    return out


def order_map(readouts: DataFrame, order: str = "acq_idx") -> DataFrame:
    """Time rank of each ky, kz: from 0 to 1 over a scan's places; the last readout counts where one repeats."""
    last = readouts.groupBy("scan_id", "ky", "kz").agg(F.max(order).alias("_last"))
    rows = scan.bucketed(last, ["scan_id"], ["_last", "ky", "kz"])
    ranked = scan.running(rows, ["scan_id"], ["_last", "ky", "kz"], sums={"_rank": F.lit(1).cast("bigint")})
    n = rows.groupBy("scan_id").agg(F.count("*").alias("_n"))
    return ranked.join(n, "scan_id").select("scan_id", "ky", "kz", ((F.col("_rank") - 1) / F.greatest(F.lit(1), F.col("_n") - 1)).alias("order"))


def coverage(readouts: DataFrame, ny: Size, nz: Size) -> DataFrame:
    """Every cell (ky, kz) of each scan and repetition with its last line's ``state``; null where never acquired. Sizes are numbers or columns."""
    keys = ["scan_id", "nex", "ky", "kz"]
    own = readouts.select("scan_id", "nex", size(ny).alias("_ny"), size(nz).alias("_nz")).distinct()
    grid = own.select("scan_id", "nex", "_nz", F.explode(upto(F.col("_ny"))).alias("ky")).select("scan_id", "nex", "ky", F.explode(upto(F.col("_nz"))).alias("kz"))
    return grid.join(readouts.groupBy(*keys).agg(F.max_by("state", "line_idx").alias("state")), keys, "left")
