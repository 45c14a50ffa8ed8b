"""Motion models: curves, states, displacement fields and warps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions.sizes import Size, size, upto
from motionlake.operators import scan

RIGID_2D = ("tx", "ty", "phi")
RIGID_3D = ("tx", "ty", "tz", "rx", "ry", "rz")


def limits_px(params: DataFrame, meta: DataFrame) -> DataFrame:
    """Translation limits in pixels: mm times amplitude times size over field of view; centre offsets without the amplitude."""
    j = params.join(meta, "scan_id")
    per = lambda c, n, fov: F.col(c) * F.col(n) / F.col(fov)
    s = F.greatest(F.lit(0.0), "scale")
    return j.select(
        "scan_id", (per("tx_mm", "nx", "fov") * s).alias("tx_px"), (per("ty_mm", "ny", "fov") * s).alias("ty_px"), (per("tz_mm", "nz", "fov_z") * s).alias("tz_px"),
        per("cx_mm", "nx", "fov").alias("cx_px"), per("cy_mm", "ny", "fov").alias("cy_px"),
    )


def display_components(maps: DataFrame, nx: int, flip: bool = False) -> DataFrame:
    """``maps(voxel row x, y, a0, a1)`` as display components: x is minus axis 1, y minus axis 0; rows turned if ``flip``."""
    x = (F.lit(nx - 1) - F.col("x")) if flip else F.col("x")
    return maps.select("scan_id", x.alias("x"), "y", (-F.col("a1")).alias("dx"), (-F.col("a0")).alias("dy"))


def motion_curves(readouts: DataFrame, events: DataFrame, tau: int, n: int) -> DataFrame:
    """``readouts(scan_id, t)`` with ``value``: sum over events of amplitude times a raised cosine.

    An event begins at ``t0``, rises over ``min(tau, n - t0)`` readouts and then holds its amplitude; a
    rise of one readout is zero there. Instead of pairing every readout with every earlier event,
    held amplitudes are a running sum by scan, and only the ramp's rows, at most ``tau`` to an
    event, are made and added. Amplitudes of events beyond the readouts don't count.
    """
    m = F.least(F.lit(tau), F.lit(n) - F.col("t0"))
    e = events.filter((F.col("t0") >= 0) & (F.col("t0") < n)).withColumn("m", m)
    ramp = e.select("scan_id", "t0", "m", "amplitude", F.explode(F.sequence(F.lit(0), (F.col("m") - 1).cast("int"))).alias("i"))
    value = F.when(F.col("m") == 1, 0.0).otherwise(F.col("amplitude") * 0.5 * (1 - F.cos(math.pi * F.col("i") / (F.col("m") - 1))))
    ramps = ramp.groupBy("scan_id", (F.col("t0") + F.col("i")).alias("t")).agg(F.sum(value).alias("r"))
    held = e.groupBy("scan_id", (F.col("t0") + F.col("m")).alias("t")).agg(F.sum("amplitude").alias("h"))
    j = readouts.join(ramps, ["scan_id", "t"], "left").join(held, ["scan_id", "t"], "left").fillna(0.0, ["r", "h"])
    summed = scan.running(scan.bucketed(j, ["scan_id"], ["t"]), ["scan_id"], ["t"], ties=True, sums={"value": F.col("h")})
    return summed.withColumn("value", F.col("value") + F.col("r")).drop("r", "h", scan.BUCKET)


def compress_states(curves: DataFrame, params: tuple[str, ...], order: str = "t") -> DataFrame:
    """``curves`` with ``state``: consecutive readouts of exactly equal parameters are one state, numbered from 0."""
    key, own = ["scan_id"], F.struct(*params)
    rows = scan.neighbour(scan.bucketed(curves, key, [order]), key, [order], own, "_before")
    # A struct of nulls is none itself, so a missing one is the scan's first readout.
    changed = F.col("_before").isNotNull() & ~F.col("_before").eqNullSafe(own)
    return scan.running(rows, key, [order], sums={"state": changed.cast("bigint")}).drop("_before", scan.BUCKET)


def state_values(compressed: DataFrame, params: tuple[str, ...], order: str = "t") -> DataFrame:
    """One row per state: its first readout's parameters and its number of readouts."""
    first = F.min_by(F.struct(*params), order)
    return compressed.groupBy("scan_id", "state").agg(first.alias("p"), F.count("*").alias("n_readouts")).select("scan_id", "state", "p.*", "n_readouts")


def navigator(curves: DataFrame, params: tuple[str, ...], order: str = "t") -> DataFrame:
    """``scan_id, order, navigator``: curves projected on their first principal component, over the largest modulus.

    The covariance is one aggregation per scan; only these small matrices meet NumPy. The sign makes
    the largest loading positive, the first of equally large ones.
    """
    pairs = [(i, j) for i in range(len(params)) for j in range(i, len(params))]
    cov = curves.groupBy("scan_id").agg(*(F.avg(p).alias(f"m{i}") for i, p in enumerate(params)), *(F.covar_pop(params[i], params[j]).alias(f"c{i}_{j}") for i, j in pairs))
    k = len(params)

    @F.pandas_udf("array<double>")
    def first_component(*columns: pd.Series) -> pd.Series:
        a = np.zeros((len(columns[0]), k, k))
        for (i, j), c in zip(pairs, columns):
            a[:, i, j] = a[:, j, i] = c.fillna(0.0)
        v = np.linalg.eigh(a)[1][:, :, -1]
        lead = np.take_along_axis(v, np.abs(np.round(v, 9)).argmax(axis=1)[:, None], axis=1)
        return pd.Series((v * np.where(lead < 0, -1.0, 1.0)).tolist())

    v = cov.withColumn("v", first_component(*(f"c{i}_{j}" for i, j in pairs))).select("scan_id", "v", *(f"m{i}" for i in range(k)))
    j = curves.join(v, "scan_id")
    value = sum(((F.col(p) - F.col(f"m{i}")) * F.col("v")[i] for i, p in enumerate(params)), F.lit(0.0))
    j = j.select("scan_id", order, value.alias("navigator"))
    top = j.groupBy("scan_id").agg(F.greatest(F.lit(1e-12), F.max(F.abs("navigator"))).alias("top"))
    return j.join(top, "scan_id").select("scan_id", order, (F.col("navigator") / F.col("top")).alias("navigator"))


def curve_limits(curves: DataFrame, translations: tuple[str, ...], rotations: tuple[str, ...], pad: float = 0.05) -> DataFrame:
    """Common range of a scan's curves, rotations in degrees, padded; a flat range is widened by a tenth of its size or of one."""
    cols = [*(F.col(c) for c in translations), *(F.degrees(c) for c in rotations)]
    r = curves.groupBy("scan_id").agg(F.min(F.least(*cols) if len(cols) > 1 else cols[0]).alias("lo"), F.max(F.greatest(*cols) if len(cols) > 1 else cols[0]).alias("hi"))
    span = F.col("hi") - F.col("lo")
    extra = F.when(F.abs(span) < 1e-12, 0.1 * F.greatest(F.abs("hi"), F.lit(1.0))).otherwise(pad * span)
    return r.select("scan_id", (F.col("lo") - extra).alias("lo"), (F.col("hi") + extra).alias("hi"))


def displacement_summary(maps: DataFrame) -> DataFrame:
    """Largest modulus of both components and of the amplitude, at least 1e-12."""
    floor = lambda c: F.greatest(F.lit(1e-12), F.max(c))
    return maps.groupBy("scan_id").agg(floor(F.abs("dx")).alias("max_x"), floor(F.abs("dy")).alias("max_y"), floor(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).alias("max_amplitude"))


def on_grid(states: DataFrame, nx: Size, ny: Size, nz: Size = 1) -> DataFrame:
    """Each row with every voxel of its grid, whose sizes are numbers or columns; made by generating rows, not by a join."""
    nx, ny, nz = size(nx), size(ny), size(nz)
    each = states.withColumn("voxel", F.explode(upto(nx * ny * nz)))
    return each.withColumns({"x": F.floor(F.col("voxel") / (ny * nz)), "y": F.pmod(F.floor(F.col("voxel") / nz), ny), "z": F.pmod("voxel", nz)})


def _offsets(n: tuple[Size, ...], centres: tuple[str, ...] | None, axes: str) -> list[Column]:
    return [F.col(a) - (F.col(c) if centres else size(s) / 2) for a, s, c in zip(axes, n, centres or axes)]


def rigid_field_2d(states: DataFrame, nx: Size, ny: Size, centres: tuple[str, str] | None = None) -> DataFrame:
    """Displacement ``ux, uy`` of every voxel and state under ``tx, ty, phi`` about the centre, by default the middle."""
    f = on_grid(states, nx, ny)
    dx, dy = _offsets((nx, ny), centres, "xy")
    c, s = F.cos("phi"), F.sin("phi")
    return f.withColumns({"ux": c * dx - s * dy - dx + F.col("tx"), "uy": s * dx + c * dy - dy + F.col("ty")})


def rotation(rx: Column, ry: Column, rz: Column) -> list[list[Column]]:
    """Rz Ry Rx as columns."""
    cx, sx, cy, sy, cz, sz = F.cos(rx), F.sin(rx), F.cos(ry), F.sin(ry), F.cos(rz), F.sin(rz)
    return [
        [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx],
        [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx],
        [-sy, cy * sx, cy * cx],
    ]


def rigid_field_3d(states: DataFrame, nx: Size, ny: Size, nz: Size, centres: tuple[str, str, str] | None = None) -> DataFrame:
    """Displacement ``ux, uy, uz`` under ``tx, ty, tz, rx, ry, rz``."""
    f = on_grid(states, nx, ny, nz)
    d = _offsets((nx, ny, nz), centres, "xyz")
    r = rotation(F.col("rx"), F.col("ry"), F.col("rz"))
    u = {f"u{a}": sum((r[i][j] * d[j] for j in range(3)), F.lit(0.0)) - d[i] + F.col(f"t{a}") for i, a in enumerate("xyz")}
    return f.withColumns(u)


def nonrigid_field(maps: DataFrame, states: DataFrame) -> DataFrame:
    """Displacement of every voxel and state: the scan's maps ``a0, a1[, a2]`` times the state's signal.

    A scan's states are one small row, so the join meets each voxel once, and a scan with a large share of
    all voxels is a partition that adaptive execution can split.
    """
    each = states.groupBy("scan_id").agg(F.collect_list(F.struct("state", "signal")).alias("_s"))
    j = maps.join(each, "scan_id").withColumn("_s", F.explode("_s")).withColumn("state", F.col("_s.state"))
    parts = {f"u{axis}": F.col(a) * F.col("_s.signal") for axis, a in zip("xyz", ("a0", "a1", "a2")) if a in maps.columns}
    return j.withColumns(parts).drop("_s")


def stencil(field: DataFrame, sizes: tuple[Size, ...]) -> DataFrame:
    """Sources and weights of every displaced voxel: four in 2D, eight in 3D.

    A position is held between 1 and n, and its lower neighbour at most n - 1, counting from 1. Sizes are numbers or
    columns of ``field``; along an axis of one voxel both neighbours are that voxel.
    """
    axes, sizes = "xyz"[: len(sizes)], [size(n) for n in sizes]
    # Each step is a column of its own: an explode computes again what its entries share.
    at = field.withColumns({f"_at{a}": F.greatest(F.lit(1.0), F.least(n.cast("double"), F.col(a) + 1 + F.col(f"u{a}"))) for a, n in zip(axes, sizes)})
    at = at.withColumns({f"_lo{a}": F.greatest(F.lit(1), F.least(F.floor(f"_at{a}"), n - 1)) for a, n in zip(axes, sizes)})
    field = at.withColumns({f"_up{a}": F.col(f"_at{a}") - F.col(f"_lo{a}") for a in axes})
    entries = []
    for corner in range(1 << len(axes)):
        src, w = F.lit(0).cast("bigint"), F.lit(1.0)
        for k, (a, n) in enumerate(zip(axes, sizes)):
            up = corner >> k & 1
            src = src * n + F.least(F.col(f"_lo{a}") - 1 + up, n - 1)
            w = w * (F.col(f"_up{a}") if up else 1 - F.col(f"_up{a}"))
        entries.append(F.struct(src.cast("bigint").alias("src_voxel"), w.alias("w")))
    return field.select("scan_id", "state", F.col("voxel").alias("out_voxel"), F.explode(F.array(*entries)).alias("e")).select("scan_id", "state", "out_voxel", "e.*")


def warp(img: DataFrame, st: DataFrame, adjoint: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """``img(scan_id, [state,] keys, voxel, re, im)`` pulled through a stencil, or pushed through its transpose, for every state."""
    take, give = ("out_voxel", "src_voxel") if adjoint else ("src_voxel", "out_voxel")
    on = ["scan_id", *(["state"] if "state" in img.columns else []), "voxel"]
    j = img.join(st.withColumnRenamed(take, "voxel"), on)
    return j.groupBy("scan_id", "state", *keys, F.col(give).alias("voxel")).agg(F.sum(F.col("w") * F.col("re")).alias("re"), F.sum(F.col("w") * F.col("im")).alias("im"))


def gradient(img: DataFrame, sizes: tuple[Size, ...], keys: list[str], values: tuple[str, ...] = ("re", "im")) -> DataFrame:
    """``img(x, y[, z])`` with ``g{axis}_{value}``: central differences, one-sided at the borders; zero along one voxel."""
    axes = "xyz"[: len(sizes)]
    out = img
    for a, n in zip(axes, sizes):
        w = Window.partitionBy(*keys, *(b for b in axes if b != a)).orderBy(a)
        for v in values:
            before, after = F.lag(v).over(w), F.lead(v).over(w)
            g = F.when(size(n) == 1, 0.0).when(F.col(a) == 0, after - F.col(v)).when(F.col(a) == size(n) - 1, F.col(v) - before).otherwise((after - before) / 2)
            out = out.withColumn(f"g{a}_{v}", g)
    return out


def smoothness(maps: DataFrame, sizes: tuple[Size, ...], keys: list[str], value: str = "v") -> DataFrame:
    """``maps`` with ``smooth``: minus the divergence of the gradient, no flow over the border."""
    axes = "xyz"[: len(sizes)]
    total, out = F.lit(0.0), maps
    for a in axes:
        w = Window.partitionBy(*keys, *(b for b in axes if b != a)).orderBy(a)
        flow = lambda f: F.coalesce(F.col(value) - f(value).over(w), F.lit(0.0))  # noqa: B023, E731
        out = out.withColumn(f"_s{a}", flow(F.lag) + flow(F.lead))
        total = total + F.col(f"_s{a}")
    return out.withColumn("smooth", total).drop(*(f"_s{a}" for a in axes))


def rigid_jacobian(states: DataFrame, nx: Size, ny: Size, centres: tuple[str, str] | None = None) -> DataFrame:
    """Derivatives of the 2D rigid field by the angle, ``jx, jy``; those by the translations are one and zero."""
    f = on_grid(states, nx, ny)
    dx, dy = _offsets((nx, ny), centres, "xy")
    return f.withColumns({"jx": -dx * F.sin("phi") - dy * F.cos("phi"), "jy": dx * F.cos("phi") - dy * F.sin("phi")})


def apply_jacobian(jac: DataFrame, change: DataFrame) -> DataFrame:
    """Displacement change ``dux, duy`` under parameter changes ``dtx, dty, dphi`` of each state."""
    j = jac.join(change, ["scan_id", "state"])
    return j.withColumns({"dux": F.col("dtx") + F.col("jx") * F.col("dphi"), "duy": F.col("dty") + F.col("jy") * F.col("dphi")})


def apply_jacobian_adjoint(jac: DataFrame) -> DataFrame:
    """Parameter sums of a field ``dux, duy`` on the derivatives' voxels, per state."""
    return jac.groupBy("scan_id", "state").agg(F.sum("dux").alias("tx"), F.sum("duy").alias("ty"), F.sum(F.col("jx") * F.col("dux") + F.col("jy") * F.col("duy")).alias("phi"))


def _product(a: list[list[Column | float]], b: list[list[Column | float]]) -> list[list[Column | float]]:
    """A 3 by 3 product, in which zeros and ones leave no trace."""

    def entry(i: int, j: int) -> Column | float:
        terms = [y if x is ONE else x if y is ONE else x * y for x, y in ((a[i][k], b[k][j]) for k in range(3)) if x is not ZERO and y is not ZERO]
        return sum(terms[1:], terms[0]) if terms else ZERO

    return [[entry(i, j) for j in range(3)] for i in range(3)]


ZERO, ONE = 0.0, 1.0


def _turn(axis: int, angle: Column, derivative: bool = False) -> list[list[Column | float]]:
    """The rotation about an axis, or its derivative by the angle."""
    c, s, one = (-F.sin(angle), F.cos(angle), ZERO) if derivative else (F.cos(angle), F.sin(angle), ONE)
    m: list[list[Column | float]] = [[ZERO] * 3 for _ in range(3)]
    i, j = ((1, 2), (2, 0), (0, 1))[axis]
    m[axis][axis], m[i][i], m[j][j], m[i][j], m[j][i] = one, c, c, -s, s
    return m


def rigid_jacobian_3d(states: DataFrame, nx: Size, ny: Size, nz: Size, centres: tuple[str, str, str] | None = None) -> DataFrame:
    """Derivatives of the 3D rigid field by its angles, ``j{angle}_{axis}`` for ``rx, ry, rz``; those by the translations are one along their axis."""
    f = on_grid(states, nx, ny, nz)
    d = _offsets((nx, ny, nz), centres, "xyz")
    out = {}
    for k, name in enumerate(("rx", "ry", "rz")):
        turns = [_turn(i, F.col(c), i == k) for i, c in enumerate(("rx", "ry", "rz"))]
        m = _product(turns[2], _product(turns[1], turns[0]))
        out |= {f"j{name}_{a}": sum((m[i][j] * d[j] for j in range(3) if m[i][j] is not ZERO), F.lit(0.0)) for i, a in enumerate("xyz")}
    return f.withColumns(out)


def apply_jacobian_3d(jac: DataFrame, change: DataFrame) -> DataFrame:
    """Displacement change ``dux, duy, duz`` under changes ``dtx, dty, dtz, drx, dry, drz`` of each state."""
    j = jac.join(change, ["scan_id", "state"])
    return j.withColumns({f"du{a}": F.col(f"dt{a}") + sum((F.col(f"j{r}_{a}") * F.col(f"d{r}") for r in ("rx", "ry", "rz")), F.lit(0.0)) for a in "xyz"})


def apply_jacobian_adjoint_3d(jac: DataFrame) -> DataFrame:
    """Parameter sums of a field ``dux, duy, duz`` on the derivatives' voxels, per state."""
    turned = {r: F.sum(sum((F.col(f"j{r}_{a}") * F.col(f"du{a}") for a in "xyz"), F.lit(0.0))) for r in ("rx", "ry", "rz")}
    return jac.groupBy("scan_id", "state").agg(*(F.sum(f"du{a}").alias(f"t{a}") for a in "xyz"), *(e.alias(r) for r, e in turned.items()))


def image_derivatives(gradients: DataFrame, jac: DataFrame, three: bool = False) -> DataFrame:
    """``j{k}_re, j{k}_im``: the derivative of warped images by each parameter, their gradient along its derivative field."""
    j = gradients.join(jac, ["scan_id", "state", "voxel"])
    turned = [[f"j{r}_{a}" for a in "xyz"] for r in ("rx", "ry", "rz")] if three else [["jx", "jy"]]
    axes = "xyz" if three else "xy"
    out = {}
    for p in ("re", "im"):
        out |= {f"j{k}_{p}": F.col(f"g{a}_{p}") for k, a in enumerate(axes)}
        out |= {f"j{len(axes) + k}_{p}": sum((F.col(f"g{a}_{p}") * F.col(c) for a, c in zip(axes, t)), F.lit(0.0)) for k, t in enumerate(turned)}
    return j.withColumns(out)


def rigid_normal_equations(fields: DataFrame, parts: tuple[str, ...] = ("jt", "ju", "jp")) -> DataFrame:
    """Normal matrix and right side per state of ``fields``, whose parts have ``_re`` and ``_im`` columns, and ``r_re, r_im``.

    States are independent, so the motion step of a rigid model is one aggregation.
    """
    dot = lambda a, b: F.sum(F.col(f"{a}_re") * F.col(f"{b}_re") + F.col(f"{a}_im") * F.col(f"{b}_im"))
    aggs = [dot(parts[i], parts[j]).alias(f"n{i}{j}") for i in range(len(parts)) for j in range(i, len(parts))]
    return fields.groupBy("scan_id", "state").agg(*aggs, *(dot(p, "r").alias(f"b{i}") for i, p in enumerate(parts)))


def solve_normal_3(eq: DataFrame, lam: float = 0.0) -> DataFrame:
    """Solution ``d0, d1, d2`` of each state's symmetric 3 by 3 system with ``lam`` on its diagonal, by Cramer's rule; zero if singular."""
    a, b, c, d, e, f = F.col("n00") + lam, F.col("n01"), F.col("n02"), F.col("n11") + lam, F.col("n12"), F.col("n22") + lam
    p, q, r = F.col("b0"), F.col("b1"), F.col("b2")
    det = a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c)
    x = p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)
    y = a * (q * f - e * r) - p * (b * f - e * c) + c * (b * r - q * c)
    z = a * (d * r - q * e) - b * (b * r - q * c) + p * (b * e - d * c)
    ok = F.abs(det) > 1e-12
    return eq.select("scan_id", "state", *(F.when(ok, v / det).otherwise(0.0).alias(f"d{i}") for i, v in enumerate((x, y, z))))


def solve_normal(eq: DataFrame, n: int, lam: float = 0.0, least: float = 1e-10) -> DataFrame:
    """Solution ``d0 ... `` of each state's symmetric n by n system ``n{i}{j}, b{i}`` with ``lam`` on its diagonal, by Cholesky.

    A pivot of at most ``least`` times the largest diagonal entry tells that its parameter depends on those before it:
    that parameter is left at zero, and the others solve the rest. Factors are columns; nothing leaves the JVM.
    """
    c = F.col
    tops = [c(f"n{i}{i}") + lam for i in range(n)]
    out = eq.withColumn("_floor", F.greatest(*tops, F.lit(0.0)) * least if n > 1 else F.greatest(tops[0], F.lit(0.0)) * least)
    less = lambda first, terms: first - sum(terms[1:], terms[0]) if terms else first
    for i in range(n):
        out = out.withColumn(f"_p{i}", less(c(f"n{i}{i}") + lam, [c(f"_l{i}{k}") * c(f"_l{i}{k}") for k in range(i)]))
        out = out.withColumn(f"_l{i}{i}", F.when(c(f"_p{i}") > c("_floor"), F.sqrt(f"_p{i}")))
        out = out.withColumns({f"_l{j}{i}": F.coalesce(less(c(f"n{i}{j}"), [c(f"_l{j}{k}") * c(f"_l{i}{k}") for k in range(i)]) / c(f"_l{i}{i}"), F.lit(0.0)) for j in range(i + 1, n)} | {f"_y{i}": F.coalesce(less(c(f"b{i}"), [c(f"_l{i}{k}") * c(f"_y{k}") for k in range(i)]) / c(f"_l{i}{i}"), F.lit(0.0))})
    for i in reversed(range(n)):
        out = out.withColumn(f"d{i}", F.coalesce(less(c(f"_y{i}"), [c(f"_l{k}{i}") * c(f"d{k}") for k in range(i + 1, n)]) / c(f"_l{i}{i}"), F.lit(0.0)))
    return out.select("scan_id", "state", *(f"d{i}" for i in range(n)))


def upsample_motion(models: DataFrame, ratio: dict[str, float | Column]) -> DataFrame:
    """Motion carried to the next level: translations times their axis's size ratio, a number or a column; rotations as they are."""
    return models.withColumns({c: F.col(c) * r for c, r in ratio.items()})


def best_iterate(log: DataFrame) -> DataFrame:
    """Per scan and level the kept iteration and where it stopped.

    Iterations up to the first whose residual is worse than the one before, after iteration 0, count;
    of those the least residual is kept, the last of equal ones.
    """
    w = Window.partitionBy("scan_id", "level").orderBy("gn_iter")
    marked = log.withColumn("_worse", F.coalesce(F.col("relres") > F.min("relres").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)).cast("int"))
    before = marked.withColumn("_stopped", F.coalesce(F.sum("_worse").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ran = before.filter("_stopped = 0")
    return ran.groupBy("scan_id", "level").agg(F.min_by("gn_iter", F.struct(F.col("relres"), -F.col("gn_iter"))).alias("best_iter"), F.min("relres").alias("best_relres"), F.max("gn_iter").alias("last_iter"))


def residual_curves(log: DataFrame) -> DataFrame:
    """Residuals of each scan and level in order of iteration, with the scan's largest."""
    level = log.groupBy("scan_id", "level").agg(F.transform(F.sort_array(F.collect_list(F.struct("gn_iter", "relres"))), lambda x: x["relres"]).alias("relres"), F.max("relres").alias("_top"))
    top = level.groupBy("scan_id").agg(F.max("_top").alias("top"))
    return level.drop("_top").join(top, "scan_id")
