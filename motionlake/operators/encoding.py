"""From images to the k-space cells that a moving scan samples, and back, for all scans in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.functions.complexes import product
from motionlake.operators import kspace, motion

C = kspace.C
PLANE = ["scan_id", "nex", "state", "coil"]


def by_scan(df: DataFrame) -> DataFrame:
    """``df`` partitioned by scan. Its session lets joins on a scan's places keep that partitioning from now on.

    All tables of an encoding then meet where their scan is, and none is shuffled once for each combination of keys. Joins are by merging: a stencil
    or a grid is made from few states after the shuffle, whose size would tell adaptive execution to send hundreds of times as many rows to the driver.
    """
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return df.repartition("scan_id").hint("merge")


def owned(samples: DataFrame) -> DataFrame:
    """``samples(scan_id, nex, state, cell)`` with each cell in one state: the last of those that hold it."""
    return samples.groupBy("scan_id", "nex", "cell").agg(F.max("state").alias("state"))


@dataclass(frozen=True)
class Encoding:
    """What encodes the images of a cohort, whose scans may differ in size.

    ``grids(scan_id, nx, ny, nz)``, ``smaps(scan_id, coil, voxel, re, im)``, ``samples(scan_id, nex, state, cell)`` and
    ``stencil(scan_id, state, out_voxel, src_voxel, w)`` (:func:`motionlake.operators.motion.stencil`). Images are
    ``(scan_id, nex, voxel, re, im)``, measured values ``(scan_id, coil, nex, cell, re, im)``. No row is more than a plane of one coil,
    and pairs of repetition and state without samples are left out early.

    Tables meet by scan (:func:`by_scan`): images, maps and samples are shuffled once for each use, and planes once after their transform. A stencil
    that was generated from states partitioned by scan is not shuffled at all.
    """

    grids: DataFrame
    smaps: DataFrame
    samples: DataFrame
    stencil: DataFrame

    def warped(self, image: DataFrame) -> DataFrame:
        """The image of each repetition as each of its states shows it."""
        pairs = by_scan(self.samples.select("scan_id", "nex", "state")).distinct()
        return motion.warp(by_scan(image), self.stencil, keys=("nex",)).join(pairs, ["scan_id", "nex", "state"], "left_semi")

    def measured(self, warped: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
        """The sampled cells of warped images, which may have more keys; where states share a cell, the last one's value stands."""
        plane = [*PLANE, *keys]
        coils = warped.join(by_scan(self.smaps).withColumnsRenamed({"re": "_mr", "im": "_mi"}), ["scan_id", "voxel"])
        re, im = product(C("re", "im"), C("_mr", "_mi"))
        seen = coils.select(*plane, "voxel", re.alias("re"), im.alias("im")).join(self.grids, "scan_id")
        cells = kspace.voxels(by_scan(kspace.fftc(kspace.planes(seen, plane, "nx", "ny", "nz"))), plane, "cell")
        kept = cells.join(owned(by_scan(self.samples)), ["scan_id", "nex", "state", "cell"], "left_semi")
        return kept.select("scan_id", "coil", "nex", "cell", *keys, "re", "im")

    def spread(self, values: DataFrame) -> DataFrame:
        """Measured values as an image of each repetition and state, of all coils together; cells of several states go to each."""
        cells = values.join(by_scan(self.samples), ["scan_id", "nex", "cell"]).join(self.grids, "scan_id")
        planes = kspace.planes(cells, PLANE, "nx", "ny", "nz", flat="cell")
        imgs = kspace.voxels(by_scan(kspace.fftc(planes, inverse=True)), PLANE).join(by_scan(self.smaps).withColumnsRenamed({"re": "_mr", "im": "_mi"}), ["scan_id", "coil", "voxel"])
        re, im = product(C("re", "im"), C("_mr", "_mi"), conj=True)
        return imgs.groupBy("scan_id", "nex", "state", "voxel").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))

    def forward(self, image: DataFrame) -> DataFrame:
        """Measured values of an image."""
        return self.measured(self.warped(image))

    def adjoint(self, values: DataFrame) -> DataFrame:
        """The image of measured values: the transpose of :meth:`forward` where no cell is in two states of a repetition (:func:`owned`)."""
        return self._back(by_scan(values))

    def _back(self, values: DataFrame) -> DataFrame:
        out = motion.warp(self.spread(values), self.stencil, adjoint=True, keys=("nex",))
        return out.groupBy("scan_id", "nex", "voxel").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))

    def normal(self, image: DataFrame) -> DataFrame:
        return self._back(self.forward(image))

    def voxels(self) -> DataFrame:
        """All places of the images: ``scan_id, nex, voxel``."""
        each = self.samples.select("scan_id", "nex").distinct().join(self.grids, "scan_id")
        return motion.on_grid(each, "nx", "ny", "nz").select("scan_id", "nex", "voxel")


def uncorrected(values: DataFrame, grids: DataFrame, smaps: DataFrame) -> DataFrame:
    """Images as if nothing had moved: inverse transform of all measured values, coils combined."""
    keys = ["scan_id", "nex", "coil"]
    planes = kspace.planes(values.join(grids, "scan_id"), keys, "nx", "ny", "nz", flat="cell")
    return kspace.combine_coils(kspace.voxels(kspace.fftc(planes, inverse=True), keys), smaps)


def inner(a: DataFrame, b: DataFrame, places: list[str]) -> DataFrame:
    """``re, im`` per scan: the sum of ``conj(a) * b`` over places that both have; what one lacks is zero."""
    j = a.select("scan_id", *places, "re", "im").hint("merge").join(b.select("scan_id", *places, F.col("re").alias("_br"), F.col("im").alias("_bi")), ["scan_id", *places])
    re, im = product(C("_br", "_bi"), C("re", "im"), conj=True)
    return j.groupBy("scan_id").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


@dataclass(frozen=True)
class Perturbation:
    """First-order change of measured values under a change of motion, about an image.

    ``changes`` of displacement are ``(scan_id, state, voxel, dux, duy[, duz])``. A warped image changes by its gradient times the
    displacement's change; the rest is :class:`Encoding`.
    """

    encoding: Encoding
    image: DataFrame
    axes: str = "xy"

    def gradients(self) -> DataFrame:
        """``g{axis}_re, g{axis}_im`` of the warped images on their voxels."""
        w = self.encoding.warped(self.image).join(self.encoding.grids, "scan_id")
        ny, nz = F.col("ny"), F.col("nz")
        w = w.withColumns({"x": F.floor(F.col("voxel") / (ny * nz)), "y": F.pmod(F.floor(F.col("voxel") / nz), ny), "z": F.pmod("voxel", nz)})
        keys = ["scan_id", "nex", "state", *(a for a in "xyz" if a not in self.axes)]
        return motion.gradient(w, tuple(f"n{a}" for a in self.axes), keys)

    def forward(self, changes: DataFrame) -> DataFrame:
        """Changes of measured values."""
        j = self.gradients().join(changes, ["scan_id", "state", "voxel"])
        part = lambda p: sum((F.col(f"g{a}_{p}") * F.col(f"du{a}") for a in self.axes), F.lit(0.0)).alias(p)
        return self.encoding.measured(j.select("scan_id", "nex", "state", "voxel", part("re"), part("im")))

    def adjoint(self, values: DataFrame) -> DataFrame:
        """Displacement changes of measured values: ``du{axis}`` and its imaginary part ``du{axis}_im``, summed over repetitions."""
        r = self.encoding.spread(by_scan(values)).withColumnsRenamed({"re": "_rr", "im": "_ri"})
        j = self.gradients().join(r, ["scan_id", "nex", "state", "voxel"])
        sums = []
        for a in self.axes:
            re, im = product(C("_rr", "_ri"), C(f"g{a}_re", f"g{a}_im"), conj=True)
            sums += [F.sum(re).alias(f"du{a}"), F.sum(im).alias(f"du{a}_im")]
        return j.groupBy("scan_id", "state", "voxel").agg(*sums)


def maps_adjoint(changes: DataFrame, states: DataFrame, axes: str = "xy") -> DataFrame:
    """Displacement changes as changes of a scan's maps, ``a0, a1[, a2]`` per voxel: each times its state's signal, summed over states."""
    j = changes.join(states.select("scan_id", "state", "signal"), ["scan_id", "state"])
    return j.groupBy("scan_id", "voxel").agg(*(F.sum(F.col("signal") * F.col(f"du{a}")).alias(f"a{k}") for k, a in enumerate(axes)))


@dataclass(frozen=True)
class Level:
    """A cohort at one resolution: ``grids(scan_id, nx, ny, nz)``, maps, samples and measured values of its centre block."""

    grids: DataFrame
    smaps: DataFrame
    samples: DataFrame
    values: DataFrame


def build_level(grids: DataFrame, smaps: DataFrame, samples: DataFrame, values: DataFrame, factor: float) -> Level:
    """The cohort at ``factor`` of its resolution, each scan at its own sizes: maps resized, samples and k-space cropped to the centre.

    Maps are resized where their scan is: from few small files one task would make all of their rows.
    """
    sizes = grids.select("scan_id", "nx", "ny", "nz", *(kspace.level_size(n, factor).alias(f"m{n[1]}") for n in ("nx", "ny", "nz")))
    full, part = ("nx", "ny", "nz"), ("mx", "my", "mz")
    cut = lambda df: kspace.crop_cells(df.join(sizes, "scan_id"), full, part).select(*df.columns)
    maps = kspace.resize(by_scan(smaps).join(sizes, "scan_id"), full, part, ["scan_id", "coil"])
    return Level(sizes.select("scan_id", *(F.col(m).cast("int").alias(n) for n, m in zip(full, part))), maps, cut(samples), cut(values))


def upsample(image: DataFrame, states: DataFrame, small: DataFrame, large: DataFrame, translations: tuple[str, ...] = ("tx", "ty")) -> tuple[DataFrame, DataFrame]:
    """An image and its motion carried from one level's grids to another's: resized, and translations times their axis's ratio."""
    both = small.join(large.select("scan_id", *(F.col(n).alias(f"m{n[1]}") for n in ("nx", "ny", "nz"))), "scan_id")
    img = kspace.resize(by_scan(image).join(both, "scan_id"), ("nx", "ny", "nz"), ("mx", "my", "mz"), ["scan_id", "nex"])
    moved = motion.upsample_motion(states.join(both, "scan_id"), {t: F.col(f"m{t[1]}") / F.col(f"n{t[1]}") for t in translations})
    return img, moved.select(*states.columns)
