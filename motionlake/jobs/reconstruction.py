"""Images and motion of a cohort from what its scans measured: the solves, and the loop over levels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionlake.functions.complexes import square
from motionlake.operators import encoding, kspace, motion, solvers
from motionlake.sources.tables import materialize

VALUE = ["coil", "nex", "cell"]


def _filled(df: DataFrame, grid: DataFrame, places: list[str], values: tuple[str, ...]) -> DataFrame:
    """A row for each place of ``grid``, zero where ``df`` has none."""
    return grid.join(df, ["scan_id", *places], "left").fillna(0.0, list(values)).select("scan_id", *places, *values)


def solve_image(enc: encoding.Encoding, values: DataFrame, x0: DataFrame | None = None, weight: DataFrame | None = None, tol: float = 1e-3, rounds: int = 20, **how) -> solvers.Solved:
    """Images whose measured values are nearest to ``values``; ``weight(scan_id, weight)`` times the image's own norm is added."""
    places = ["nex", "voxel"]
    b = _filled(enc.adjoint(values), enc.voxels(), places, ("re", "im"))
    apply = enc.normal if weight is None else solvers.damped(enc.normal, lambda x: x, weight, places)
    return solvers.cg_solve(apply, b, places, x0=x0, tol=tol, rounds=rounds, **how)


def residual(enc: encoding.Encoding, values: DataFrame, image: DataFrame) -> DataFrame:
    """What of the measured values the image does not explain."""
    e = enc.forward(image).withColumnsRenamed({"re": "_er", "im": "_ei"})
    j = values.join(e, ["scan_id", *VALUE], "left").fillna(0.0, ["_er", "_ei"])
    return j.select("scan_id", *VALUE, (F.col("re") - F.col("_er")).alias("re"), (F.col("im") - F.col("_ei")).alias("im"))


def rigid_step(enc: encoding.Encoding, image: DataFrame, jacobian: DataFrame, rest: DataFrame, lam: float = 0.0, three: bool = False) -> DataFrame:
    """Changes ``d0 ...`` of each state's parameters that explain the residual best, to first order.

    The derivatives of all parameters are encoded in one plan, and a state's equations are sums over its own cells:
    states don't touch, so nothing is iterated.
    """
    n = 6 if three else 3
    parts = motion.image_derivatives(encoding.Perturbation(enc, image, "xyz" if three else "xy").gradients(), jacobian, three)
    each = parts.select("scan_id", "nex", "state", "voxel", F.explode(F.array(*(F.struct(F.lit(k).alias("part"), F.col(f"j{k}_re").alias("re"), F.col(f"j{k}_im").alias("im")) for k in range(n)))).alias("p"))
    cells = enc.measured(each.select("scan_id", "nex", "state", "voxel", "p.*"), ("part",)).join(encoding.owned(enc.samples), ["scan_id", "nex", "cell"])
    one = lambda k, v: F.sum(F.when(F.col("part") == k, F.col(v)).otherwise(0.0)).alias(f"j{k}_{v}")
    wide = cells.groupBy("scan_id", "state", *VALUE).agg(*(one(k, v) for k in range(n) for v in ("re", "im")))
    wide = wide.join(rest.withColumnsRenamed({"re": "r_re", "im": "r_im"}), ["scan_id", *VALUE])
    return motion.solve_normal(motion.rigid_normal_equations(wide, tuple(f"j{k}" for k in range(n))), n, lam)


def map_step(
    enc: encoding.Encoding, image: DataFrame, maps: DataFrame, states: DataFrame, rest: DataFrame, weight: DataFrame,
    axes: str = "xy", tol: float = 1e-3, rounds: int = 20, **how,
) -> solvers.Solved:
    """Changes of each scan's displacement maps ``a0, a1[, a2]``, kept smooth as the maps are to become.

    Solves ``(J'J + w R) d = J'r - w R(maps)``: J takes changes of maps through each state's signal to measured values,
    R is :func:`motionlake.operators.motion.smoothness` and w the scan's ``weight``.
    """
    change, values = encoding.Perturbation(enc, image, axes), tuple(f"a{k}" for k in range(len(axes)))
    signal = states.select("scan_id", "state", "signal")

    def back(measured: DataFrame) -> DataFrame:
        return encoding.maps_adjoint(change.adjoint(measured), states, axes)

    def normal(d: DataFrame) -> DataFrame:
        moved = motion.nonrigid_field(d, signal).withColumnsRenamed({f"u{a}": f"du{a}" for a in axes})
        return back(change.forward(moved.select("scan_id", "state", "voxel", *(f"du{a}" for a in axes))))

    def rough(d: DataFrame) -> DataFrame:
        at = d.join(enc.grids, "scan_id").withColumns({"x": F.floor(F.col("voxel") / (F.col("ny") * F.col("nz"))), "y": F.pmod(F.floor(F.col("voxel") / F.col("nz")), F.col("ny")), "z": F.pmod("voxel", F.col("nz"))})
        for v in values:
            at = motion.smoothness(at, tuple(f"n{a}" for a in axes), ["scan_id", *(a for a in "xyz" if a not in axes)], v).drop(v).withColumnRenamed("smooth", v)
        return at.select("scan_id", "voxel", *values)

    held = rough(maps).join(weight, "scan_id").select("scan_id", "voxel", *((-F.col("weight") * F.col(v)).alias(v) for v in values))
    grid = enc.voxels().select("scan_id", "voxel").distinct()
    b = _filled(back(rest).unionByName(held).groupBy("scan_id", "voxel").agg(*(F.sum(v).alias(v) for v in values)), grid, ["voxel"], values)
    return solvers.cg_solve(solvers.damped(normal, rough, weight, ["voxel"], values), b, ["voxel"], values, tol=tol, rounds=rounds, **how)


@dataclass(frozen=True)
class Reconstruction:
    """Images ``(scan_id, nex, voxel, re, im)``, motion ``(scan_id, state, tx, ty, phi)`` and a log row for each scan, level and iteration."""

    images: DataFrame
    states: DataFrame
    log: DataFrame


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that was written to its end, or None."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def reconstruct(
    grids: DataFrame, smaps: DataFrame, samples: DataFrame, values: DataFrame, states: DataFrame, path: str,
    levels: tuple[float, ...] = (0.25, 0.5, 1.0), iterations: int = 3, rounds: int = 10, lam: float = 0.0, weight: float = 0.0, tol: float = 1e-3,
    after: Callable[[int, int], None] | None = None,
) -> Reconstruction:
    """Images and rigid in-plane motion of a cohort, from coarse levels to fine ones.

    At each level an iteration solves the images, looks at what they leave unexplained, and corrects the motion; the
    level starts from the one before it, enlarged. The greatest of ``levels`` is the full size. A scan stops at a level with the first iteration whose residual is
    above the one before, and keeps the iterate of least residual; scans that have stopped leave the next iteration.
    ``states(scan_id, state, tx, ty, phi)`` is the motion to start from, in voxels of the last level.

    Each iteration's images, motion and log are written below ``path``, the log last. A run that finds them goes on
    after the last complete iteration, so one that was ended (``after`` is called between iterations) can be repeated with the
    same path and arguments; a log without its images is never read.
    """
    spark = grids.sparkSession
    top = max(levels)
    before: tuple[DataFrame, DataFrame, DataFrame] | None = None
    logs: list[DataFrame] = []
    for number, factor in enumerate(levels):
        level = encoding.build_level(grids, smaps, samples, values, factor / top)
        level = encoding.Level(*(materialize(t) for t in (level.grids, level.smaps, level.samples, level.values)))
        norms = level.values.groupBy("scan_id").agg(F.sqrt(F.sum(square(kspace.C("re", "im")))).alias("norm"))
        if before is None:
            full = grids.select("scan_id", "nx", "ny", "nz")
            ratio = level.grids.select("scan_id", F.col("nx").alias("_x"), F.col("ny").alias("_y")).join(full, "scan_id")
            moved = states.join(ratio, "scan_id").withColumns({"tx": F.col("tx") * F.col("_x") / F.col("nx"), "ty": F.col("ty") * F.col("_y") / F.col("ny")})
            image, motions = None, materialize(moved.select("scan_id", "state", "tx", "ty", "phi"))
        else:
            image, motions = (materialize(t) for t in encoding.upsample(before[0], before[1], before[2], level.grids))
        best: tuple[DataFrame, DataFrame] | None = None
        last: DataFrame | None = None
        for k in range(iterations):
            here = f"{path}/level={number}/iteration={k}"
            log = _read(spark, f"{here}/log")
            if log is None:
                if last is None:
                    own, now = level, motions
                else:
                    scans = materialize(last.filter("not stopped").select("scan_id"))
                    if scans.isEmpty():
                        break
                    own = encoding.Level(*(materialize(t.join(scans, "scan_id", "left_semi")) for t in (level.grids, level.smaps, level.samples, level.values)))
                    now, image = (materialize(t.join(scans, "scan_id", "left_semi")) for t in (motions, image))
                field = motion.rigid_field_2d(encoding.by_scan(now.join(own.grids, "scan_id")), "nx", "ny")
                enc = encoding.Encoding(own.grids, own.smaps, own.samples, motion.stencil(field, ("nx", "ny")))
                w = own.grids.select("scan_id", F.lit(weight).alias("weight")) if weight else None
                solve_image(enc, own.values, image, w, tol, rounds).x.write.mode("overwrite").parquet(f"{here}/images")
                solved = spark.read.parquet(f"{here}/images")
                rest = materialize(residual(enc, own.values, solved))
                both = now.withColumns({f"next_{p}": F.col(p) for p in motion.RIGID_2D})
                if k + 1 < iterations:
                    step = rigid_step(enc, solved, motion.rigid_jacobian(now.join(own.grids, "scan_id"), "nx", "ny"), rest, lam)
                    both = now.join(step, ["scan_id", "state"], "left").fillna(0.0, ["d0", "d1", "d2"])
                    both = both.withColumns({f"next_{p}": F.col(p) + F.col(f"d{i}") for i, p in enumerate(motion.RIGID_2D)}).drop("d0", "d1", "d2")
                both.write.mode("overwrite").parquet(f"{here}/states")
                left = rest.groupBy("scan_id").agg(F.sqrt(F.sum(square(kspace.C("re", "im")))).alias("left"))
                row = own.grids.select("scan_id").join(norms, "scan_id").join(left, "scan_id", "left")
                row = row.select("scan_id", F.lit(number).alias("level"), F.lit(k).alias("gn_iter"), F.when(F.col("norm") > 0, F.coalesce("left", F.lit(0.0)) / F.col("norm")).otherwise(0.0).alias("relres"))
                earlier = row.select("scan_id", F.lit(None).cast("double").alias("earlier")) if last is None else last.select("scan_id", F.col("relres").alias("earlier"))
                row.join(earlier, "scan_id").withColumn("stopped", F.coalesce(F.col("relres") > F.col("earlier"), F.lit(False))).drop("earlier").write.mode("overwrite").parquet(f"{here}/log")
                log = spark.read.parquet(f"{here}/log")
                if after is not None:
                    after(number, k)
            images, both = spark.read.parquet(f"{here}/images"), spark.read.parquet(f"{here}/states")
            kept = log.filter("not stopped").select("scan_id")
            used = both.select("scan_id", "state", *motion.RIGID_2D)
            best = (images, used) if best is None else tuple(materialize(_replaced(old, new, kept)) for old, new in zip(best, (images, used)))
            image, motions = images, both.select("scan_id", "state", *(F.col(f"next_{p}").alias(p) for p in motion.RIGID_2D))
            logs.append(log)
            last = log
        before = (*best, level.grids)
    log = logs[0]
    for x in logs[1:]:
        log = log.unionByName(x)
    return Reconstruction(before[0], before[1], log)


def _replaced(old: DataFrame, new: DataFrame, scans: DataFrame) -> DataFrame:
    """``old`` with the rows of some scans taken from ``new``."""
    return old.join(scans, "scan_id", "left_anti").unionByName(new.join(scans, "scan_id", "left_semi"))
