"""K-space lines and images: scaling, cropping, Fourier transforms, coils and errors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.functions.complexes import product, square
from motionlake.functions.sizes import Size, corner, size, upto
from motionlake.operators import scan

C = lambda re, im: (F.col(re), F.col(im))


def kspace_scale(lines: DataFrame, mode: str, eps: float = 1e-12) -> DataFrame:
    """``scale`` per scan of ``lines(scan_id, re[], im[])``: largest modulus, or root mean square; at least ``eps``."""
    pairs = F.zip_with("re", "im", lambda a, b: a * a + b * b)
    if mode == "max":
        out = lines.groupBy("scan_id").agg(F.sqrt(F.max(F.array_max(pairs))).alias("scale"))
    elif mode == "rms":
        total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)
        out = lines.groupBy("scan_id").agg(F.sqrt(F.sum(total) / F.sum(F.size("re"))).alias("scale"))
    else:
        raise ValueError(f"unknown mode {mode}")
    return out.withColumn("scale", F.greatest(F.lit(eps), "scale"))


def normalize_kspace(lines: DataFrame, mode: str, eps: float = 1e-12) -> DataFrame:
    """``lines`` divided by their scan's scale, with ``scale``. One small row per scan is joined back."""
    over = lambda c: F.transform(c, lambda x: x / F.col("scale"))
    return lines.join(kspace_scale(lines, mode, eps), "scan_id").withColumns({"re": over("re"), "im": over("im")})


def level_size(n: str, factor: float):
    """A level's size: rounded half to even, at least one."""
    return F.greatest(F.lit(1), F.bround(F.col(n) * F.lit(factor), 0)).cast("bigint")


def crop_kspace(lines: DataFrame, full: tuple[Size, Size, Size], part: tuple[Size, Size, Size]) -> DataFrame:
    """The centre block of ``lines(ky, kz, re[], im[])``, numbered from its corner; sizes are numbers or each scan's columns."""
    ox, oy, oz = (corner(n, m) for n, m in zip(full, part))
    inside = F.col("ky").between(oy, oy + size(part[1]) - 1) & F.col("kz").between(oz, oz + size(part[2]) - 1)
    cut = lambda c: F.slice(c, (ox + 1).cast("int"), size(part[0]).cast("int"))
    return lines.filter(inside).withColumns({"ky": F.col("ky") - oy, "kz": F.col("kz") - oz, "re": cut("re"), "im": cut("im")})


def crop_cells(samples: DataFrame, full: tuple[Size, Size, Size], part: tuple[Size, Size, Size]) -> DataFrame:
    """Samples whose ``cell`` lies in the centre block, numbered on the small grid; sizes are numbers or each scan's columns."""
    (nx, ny, nz), (mx, my, mz) = map(size, full), map(size, part)
    ox, oy, oz = (corner(n, m) for n, m in zip(full, part))
    kz = F.pmod("cell", nz) - oz
    ky = F.pmod(F.floor(F.col("cell") / nz), ny) - oy
    kx = F.floor(F.col("cell") / (ny * nz)) - ox
    inside = kx.between(0, mx - 1) & ky.between(0, my - 1) & kz.between(0, mz - 1)
    return samples.filter(inside).withColumn("cell", ((kx * my + ky) * mz + kz).cast("bigint"))


def calibration_kspace(cells: DataFrame, measured: bool) -> DataFrame:
    """Mean over repetitions of ``cells(scan_id, coil, nex, cell, re, im)`` if measured, else repetition 0."""
    if measured:
        return cells.groupBy("scan_id", "coil", "cell").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    return cells.filter("nex = 0").select("scan_id", "coil", "cell", "re", "im")


def calibration_width(width: int, *sizes: str):
    """A width bounded by the matrix: at least one, at most each size."""
    return F.greatest(F.lit(1), F.least(F.lit(width), *sizes))


def apply_maps(img: DataFrame, smaps: DataFrame, conj: bool = False) -> DataFrame:
    """Image voxels times coil maps, or times their conjugates; ``img`` may have a coil already."""
    keys = ["scan_id", *(["coil"] if "coil" in img.columns else []), "voxel"]
    m = smaps.withColumnsRenamed({"re": "_mr", "im": "_mi"})
    re, im = product(C("re", "im"), C("_mr", "_mi"), conj)
    return img.join(m, keys).withColumns({"re": re, "im": im}).drop("_mr", "_mi")


def combine_coils(imgs: DataFrame, smaps: DataFrame) -> DataFrame:
    """Sum over coils of image times conjugate map, per scan, repetition and voxel."""
    keys = ["scan_id", *(["nex"] if "nex" in imgs.columns else []), "voxel"]
    return apply_maps(imgs, smaps, conj=True).groupBy(*keys).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def relative_error(a: DataFrame, b: DataFrame, keys: list[str], eps: float = 1e-12) -> DataFrame:
    """Norm of ``a - b`` over norm of ``b`` per scan; a place that one side lacks is zero there."""
    j = a.select("scan_id", *keys, F.col("re").alias("ar"), F.col("im").alias("ai")).join(b.select("scan_id", *keys, "re", "im"), ["scan_id", *keys], "full").fillna(0.0, ["ar", "ai", "re", "im"])
    gap = square((F.col("ar") - F.col("re"), F.col("ai") - F.col("im")))
    return j.groupBy("scan_id").agg((F.sqrt(F.sum(gap)) / (F.sqrt(F.sum(square(C("re", "im")))) + eps)).alias("error"))


def percentiles(img: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """``scan_id, n, q`` of ``img(scan_id, v)``: exact percentiles with linear interpolation, NaN above all numbers, nulls left out.

    Distinct values with their counts are ordered in two levels, so that no task holds a scan's values and equal ones are one row.
    """
    counts = img.filter("v is not null").groupBy("scan_id", "v").agg(F.count("*").alias("_m"))
    rows = scan.running(scan.bucketed(counts, ["scan_id"], ["v"]), ["scan_id"], ["v"], sums={"_upto": F.col("_m")}).drop(scan.BUCKET)
    total = rows.groupBy("scan_id").agg(F.max("_upto").alias("n")).withColumnRenamed("scan_id", "_k")
    placed = rows.join(total, F.col("scan_id").eqNullSafe(F.col("_k")))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_m") <= place) & (F.col("_upto") > place), F.col("v")))

    spots = [(F.col("n") - 1) * F.lit(p) for p in shares]
    edges = placed.groupBy("scan_id", "n").agg(*(at(f(x)).alias(f"_{f.__name__}{i}") for i, x in enumerate(spots) for f in (F.floor, F.ceil)))
    between = [F.col(f"_floor{i}") + (F.col(f"_ceil{i}") - F.col(f"_floor{i}")) * (x - F.floor(x)) for i, x in enumerate(spots)]
    return edges.select("scan_id", "n", F.array(*between).alias("q"))


def robust_window(img: DataFrame, lo: float = 0.02, hi: float = 0.98, exact: bool = True) -> DataFrame:
    """``img(scan_id, voxel, v)`` with ``scaled``: clamped between two percentiles and mapped to [0, 1].

    Percentiles interpolate linearly; ``exact=False`` takes a sketch of bounded size instead of ordering values.
    """
    if exact:
        q = percentiles(img, (lo, hi))
    else:
        q = img.groupBy("scan_id").agg(F.percentile_approx("v", [lo, hi], 10_000).alias("q"))
    w = q.select("scan_id", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return img.join(w, "scan_id").withColumn("scaled", F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))


def fft_centred(x: np.ndarray, axes: tuple[int, ...], inverse: bool = False) -> np.ndarray:
    """Orthonormal Fourier transform with its origin in the middle."""
    f = np.fft.ifftn if inverse else np.fft.fftn
    return np.fft.fftshift(f(np.fft.ifftshift(x, axes=axes), axes=axes, norm="ortho"), axes=axes)


def _map_arrays(df: DataFrame, f) -> DataFrame:
    """Rows with ``re`` and ``im`` replaced by what ``f(shape, complex arrays of it)`` makes of those of a shape; no shuffle.

    A row's shape is its ``nx, ny, nz``, or its length. Values stay in Arrow's buffers: rows of a shape are one array.
    """
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, j = b.schema.get_field_index("re"), b.schema.get_field_index("im")
            length = b.column(i).value_lengths().to_numpy(zero_copy_only=False)
            shape = np.stack([b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("nx", "ny", "nz")], axis=1) if "nx" in b.schema.names else length[:, None]
            values = [b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (i, j)]
            out: list[np.ndarray | None] = [None] * b.num_rows
            begins = np.cumsum(length) - length
            for s in np.unique(shape, axis=0):
                rows = np.flatnonzero((shape == s).all(axis=1))
                at = begins[rows][:, None] + np.arange(int(np.prod(s)))
                done = f(tuple(int(n) for n in s), (values[0][at] + 1j * values[1][at]).reshape(-1, *s)).reshape(len(rows), -1)
                for row, x in zip(rows, done):
                    out[row] = x
            columns = b.columns
            ends = pa.array(np.r_[0, np.cumsum([len(x) for x in out])].astype(np.int32))
            flat = np.concatenate(out) if out else np.zeros(0, complex)
            columns[i], columns[j] = (pa.ListArray.from_arrays(ends, pa.array(v)) for v in (flat.real, flat.imag))
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)
        # A worker outlives its task: what Arrow holds unused would stand beside the next task's.
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def fftc(planes: DataFrame, axes: tuple[int, ...] = (0, 1, 2), inverse: bool = False) -> DataFrame:
    """Transform of ``planes(nx, ny, nz, re[], im[])``, one whole coil image to a row; sizes may differ between rows."""
    return _map_arrays(planes, lambda _, x: fft_centred(x, tuple(a + 1 for a in axes), inverse))


def remove_oversampling(lines: DataFrame) -> DataFrame:
    """Lines at half their length: to image space along kx, the middle half, and back."""

    def f(shape: tuple[int, ...], x: np.ndarray) -> np.ndarray:
        n = shape[0]
        return fft_centred(fft_centred(x, (1,), inverse=True)[:, n // 4 : n // 4 + n // 2], (1,))

    return _map_arrays(lines, f)


def planes(cells: DataFrame, keys: list[str], nx: Size, ny: Size, nz: Size = 1, flat: str = "voxel") -> DataFrame:
    """Voxel rows, one per place, gathered to one row per key with arrays in flat order; absent voxels are zero.

    Sizes are numbers, or columns of ``cells`` that are the same throughout a key.

    A plane is sorted once, with a zero for each place that a hash lookup finds missing.
    """
    own = [n for n in (nx, ny, nz) if isinstance(n, str)]
    places = upto(size(nx) * size(ny) * size(nz))
    found = F.collect_list(F.struct(F.col(flat).cast("bigint").alias("i"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im")))
    zero = F.lit(0.0)
    missing = F.transform(F.array_except(places, F.transform("m", lambda x: x["i"])), lambda i: F.struct(i.alias("i"), zero.alias("re"), zero.alias("im")))
    full = cells.groupBy(*keys, *own).agg(found.alias("m")).withColumn("m", F.sort_array(F.concat("m", missing)))
    return full.select(*keys, *(size(n).cast("int").alias(c) for n, c in zip((nx, ny, nz), ("nx", "ny", "nz"))), F.col("m.re").alias("re"), F.col("m.im").alias("im"))


def voxels(plane_rows: DataFrame, keys: list[str], flat: str = "voxel") -> DataFrame:
    """Plane rows exploded to voxel rows."""
    each = plane_rows.select(*keys, F.posexplode(F.arrays_zip("re", "im")).alias("_i", "_v"))
    return each.select(*keys, F.col("_i").cast("bigint").alias(flat), F.col("_v.re").alias("re"), F.col("_v.im").alias("im"))


def resize(img: DataFrame, n: tuple[Size, ...], m: tuple[Size, ...], keys: list[str] | None = None, values: tuple[str, ...] = ("re", "im")) -> DataFrame:
    """Bilinear or trilinear resize of ``img(voxel, re, im)`` from n to m, with half-pixel centres and borders held.

    Sizes are numbers or columns of ``img``, as many as there are axes. Each voxel is added to those it is a neighbour of, so there is
    no join with a stencil: one grouping, whose sums begin before its shuffle.
    """
    keys = keys or ["scan_id"]
    out, rest = img, F.col("voxel")
    for k in reversed(range(len(n))):
        out, rest = out.withColumn(f"_x{k}", F.pmod(rest, size(n[k])) if k else rest), F.floor(rest / size(n[k]))
    weight, place = F.lit(1.0), F.lit(0).cast("bigint")
    for k in range(len(n)):
        out = _targets(out, k, size(n[k]), size(m[k]))
        weight, place = weight * F.col(f"_w{k}"), place * size(m[k]) + F.col(f"_o{k}")
    return out.groupBy(*keys, place.cast("bigint").alias("voxel")).agg(*(F.sum(weight * F.col(v)).alias(v) for v in values))


def _targets(img: DataFrame, k: int, n: Column, m: Column) -> DataFrame:
    """A row for each place ``_o`` of a new axis of m that place ``_x`` of n is a neighbour of, with its weight ``_w`` there."""
    x, ratio = F.col(f"_x{k}"), n / m
    near = lambda at, up: F.floor((at + 0.5) / ratio - 0.5).cast("bigint") + up
    some = F.sequence(F.greatest(F.lit(0).cast("bigint"), near(x - 1, 0)), F.least(m.cast("bigint") - 1, near(x + 1, 1)))
    out = img.withColumn(f"_o{k}", F.explode(some))
    out = out.withColumn("_at", F.greatest(F.lit(0.0), (F.col(f"_o{k}") + 0.5) * ratio - 0.5))
    out = out.withColumn("_low", F.least(F.floor("_at"), n - 1))
    at, low = F.col("_at"), F.col("_low")
    weight = F.when(low == x, 1 - (at - low)).otherwise(0.0) + F.when(F.least(low + 1, n - 1) == x, at - low).otherwise(0.0)
    return out.withColumn(f"_w{k}", weight).filter(F.col(f"_w{k}") != 0).drop("_at", "_low")
