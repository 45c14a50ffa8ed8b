"""Solvers, encoding and reconstruction against NumPy."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from motionlake.jobs import reconstruction
from motionlake.operators import encoding, kspace, motion, scan, solvers



@pytest.fixture(autouse=True)
def one_task(spark):
    """Tables of a few hundred rows: one partition each, and plans that are not made again between stages."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


SIZES = {1: (4, 6, 1), 2: (5, 3, 1), 3: (3, 4, 2)}


def dense_system(spark, mats):
    rows = [(s, i, j, float(m[i, j])) for s, m in mats.items() for i in range(len(m)) for j in range(len(m))]
    a = spark.createDataFrame(rows, "scan_id long, i long, j long, a double").cache()
    seen = []

    def apply(x):
        seen.append({r.scan_id for r in x.select("scan_id").distinct().collect()})
        return a.join(x.withColumnRenamed("i", "j"), ["scan_id", "j"]).groupBy("scan_id", "i").agg(F.sum(F.col("a") * F.col("v")).alias("v"))

    return apply, seen


def test_conjugate_gradients_of_scans_that_end_at_different_rounds(spark):
    rng = np.random.default_rng(0)
    mats = {s: (lambda m: m @ m.T + np.eye(len(m)))(rng.normal(size=(n, n))) for s, n in ((1, 2), (2, 5), (3, 7))}
    mats[4], mats[5] = np.eye(3), np.zeros((2, 2))
    b = {s: rng.normal(size=len(m)) for s, m in mats.items()}
    b[6], mats[6] = np.zeros(2), np.eye(2)
    rhs = spark.createDataFrame([(s, i, float(v)) for s, x in b.items() for i, v in enumerate(x)], "scan_id long, i long, v double")
    apply, seen = dense_system(spark, mats)
    out = solvers.cg_solve(apply, rhs, ["i"], ("v",), tol=1e-9, rounds=12)
    got = {}
    for r in out.x.collect():
        got.setdefault(r.scan_id, {})[r.i] = r.v
    for s in (1, 2, 3, 4):
        assert np.allclose([got[s][i] for i in range(len(b[s]))], np.linalg.solve(mats[s], b[s]), atol=1e-6)
    assert set(got[6].values()) == {0.0} and len(got) == 6
    last = {r.scan_id: r for r in out.log.filter("reason is not null").collect()}
    assert {s: r.reason for s, r in last.items()} == {1: "tolerance", 2: "tolerance", 3: "tolerance", 4: "tolerance", 5: "breakdown", 6: "tolerance"}
    assert last[6].round == 0 and last[4].round == last[5].round == 1 and last[1].round < last[3].round
    # A scan that has stopped is in no later round.
    assert seen[0] == {1, 2, 3, 4, 5} and seen[1] == {1, 2, 3} and seen[-1] <= {2, 3}
    # From the solution there is nothing to do; a limit of rounds is told.
    again, _ = dense_system(spark, mats)
    few = solvers.cg_solve(again, rhs.filter("scan_id = 3"), ["i"], ("v",), x0=out.x.filter("scan_id = 3"), tol=1e-6, rounds=3).log.collect()
    assert [(r.round, r.reason) for r in few] == [(0, "tolerance")]
    few = solvers.cg_solve(again, rhs.filter("scan_id = 3"), ["i"], ("v",), tol=1e-9, rounds=2).log.collect()
    assert sorted((r.round, r.reason or "") for r in few) == [(0, ""), (1, ""), (2, "rounds")]
    assert solvers.cg_solve(again, rhs.filter("scan_id = 9"), ["i"], ("v",)).x.count() == 0


def test_scale_is_the_lower_median(spark):
    grid = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0)], "scan_id long, i long")
    twice = lambda v: v.withColumn("v", 2 * F.col("v"))
    none = lambda v: v.filter("scan_id = 1")
    got = {r.scan_id: r.scale for r in solvers.regularisation_scale(twice, none, grid, ["i"], ("v",), probes=4).collect()}
    assert math.isclose(got[1], 2.0) and got[2] == 1.0


def world(spark, nex=2, states=2, coils=2, seed=0):
    """A cohort of three sizes, one of them a volume, whose samples lie in one state each."""
    rng = np.random.default_rng(seed)
    pick = lambda *n: rng.normal(size=n) + 1j * rng.normal(size=n)
    img = {s: pick(nex, math.prod(n)) for s, n in SIZES.items()}
    maps = {s: 1 + 0.2 * pick(coils, math.prod(n)) for s, n in SIZES.items()}
    owner = {s: rng.integers(-1, states, (nex, math.prod(n))) for s, n in SIZES.items()}
    par = {s: rng.normal(size=(states, 6)) * [0.7, 0.7, 0.3, 0.0, 0.0, 0.2] for s in SIZES}
    df = lambda rows, schema: spark.createDataFrame(rows, schema).cache()
    images = df([(s, e, v, float(x.real), float(x.imag)) for s, a in img.items() for e, row in enumerate(a) for v, x in enumerate(row)], "scan_id long, nex long, voxel long, re double, im double")
    smaps = df([(s, c, v, float(x.real), float(x.imag)) for s, a in maps.items() for c, row in enumerate(a) for v, x in enumerate(row)], "scan_id long, coil long, voxel long, re double, im double")
    samples = df([(s, e, int(o), v) for s, a in owner.items() for e, row in enumerate(a) for v, o in enumerate(row) if o >= 0], "scan_id long, nex long, state long, cell long")
    grids = df([(s, *n) for s, n in SIZES.items()], "scan_id long, nx int, ny int, nz int")
    st = df([(s, k, *map(float, p)) for s, a in par.items() for k, p in enumerate(a)], "scan_id long, state long, tx double, ty double, tz double, rx double, ry double, rz double")
    field = motion.rigid_field_3d(st.join(grids, "scan_id"), "nx", "ny", "nz")
    enc = encoding.Encoding(grids, smaps, samples, motion.stencil(field, ("nx", "ny", "nz")).cache())
    return enc, images, st, img, maps, owner


def complexes(df, *keys):
    return {tuple(r[k] for k in keys): complex(r.re, r.im) for r in df.collect()}


def test_encoding_of_scans_of_different_sizes(spark):
    enc, images, _, img, maps, owner = world(spark)
    pull = {}
    for r in enc.stencil.collect():
        pull.setdefault((r.scan_id, r.state), []).append((r.out_voxel, r.src_voxel, r.w))
    assert all(0 <= src < math.prod(SIZES[s]) for (s, _), rows in pull.items() for _, src, _ in rows)
    want = {}
    for s, n in SIZES.items():
        for e in range(2):
            for k in range(2):
                w = np.zeros(math.prod(n), complex)
                for out, src, weight in pull[s, k]:
                    w[out] += weight * img[s][e][src]
                for c in range(2):
                    f = kspace.fft_centred((w * maps[s][c]).reshape(n), (0, 1, 2)).ravel()
                    want |= {(s, c, e, v): f[v] for v in range(len(f)) if owner[s][e][v] == k}
    got = complexes(enc.forward(images), "scan_id", "coil", "nex", "cell")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_adjoints_and_first_order_changes(spark):
    enc, images, st, *_ = world(spark, seed=1)
    values = enc.forward(world(spark, seed=2)[1]).cache()
    per = encoding.Perturbation(enc, images, "xyz")
    change = st.select("scan_id", "state", *((F.col("tx") + k).alias(f"d{p}") for k, p in enumerate(motion.RIGID_3D)))
    jac = motion.rigid_jacobian_3d(st.join(enc.grids, "scan_id"), "nx", "ny", "nz").select("scan_id", "state", "voxel", *(f"j{r}_{a}" for r in ("rx", "ry", "rz") for a in "xyz"))
    moved = motion.apply_jacobian_3d(jac, change).select("scan_id", "state", "voxel", "dux", "duy", "duz")
    left = {r.scan_id: r.re for r in encoding.inner(per.forward(moved), values, ["coil", "nex", "cell"]).collect()}
    back = motion.apply_jacobian_adjoint_3d(jac.join(per.adjoint(values), ["scan_id", "state", "voxel"])).join(change, ["scan_id", "state"])
    right = {r.scan_id: r.v for r in back.groupBy("scan_id").agg(F.sum(sum((F.col(p) * F.col(f"d{p}") for p in motion.RIGID_3D), F.lit(0.0))).alias("v")).collect()}
    assert left.keys() == right.keys() and all(math.isclose(left[s], right[s], rel_tol=1e-9, abs_tol=1e-9) for s in left)
    # A field that is linear in x moves by its slope times the shift, as far as no border is met.
    grids = spark.createDataFrame([(1, 8, 4, 1)], "scan_id long, nx int, ny int, nz int")
    flat = spark.createDataFrame([(1, 0, v, 2.0 * (v // 4), 0.0) for v in range(32)], "scan_id long, nex long, voxel long, re double, im double")
    states = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 0.25, 0.0, 0.0)], "scan_id long, state long, tx double, ty double, phi double")
    both = motion.warp(flat, motion.stencil(motion.rigid_field_2d(states.join(grids, "scan_id"), "nx", "ny"), ("nx", "ny")), keys=("nex",))
    shown = complexes(both, "state", "voxel")
    grad = {(r.state, r.voxel): r.gx_re for r in encoding.Perturbation(encoding.Encoding(grids, None, flat.select("scan_id", "nex", F.lit(0).alias("state"), F.col("voxel").alias("cell")), motion.stencil(motion.rigid_field_2d(states.filter("state = 0"), 8, 4), (8, 4))), flat).gradients().collect()}
    for v in range(4, 24):
        assert math.isclose((shown[1, v] - shown[0, v]).real, 0.25 * grad[0, v], abs_tol=1e-9)


def test_true_motion_gives_the_image_back(spark):
    """Every cell of every repetition is sampled, in one state or the other, by coils that see all."""
    enc, images, *_ = world(spark, states=1)
    every = enc.voxels().select("scan_id", "nex", F.lit(0).cast("long").alias("state"), F.col("voxel").alias("cell"))
    enc = encoding.Encoding(enc.grids, enc.smaps, every.cache(), motion.stencil(enc.grids.select("scan_id", F.lit(0).cast("long").alias("state"), "nx", "ny", "nz").transform(lambda d: motion.on_grid(d, "nx", "ny", "nz")).withColumns({f"u{a}": F.lit(0.0) for a in "xyz"}), ("nx", "ny", "nz")).cache())
    solved = reconstruction.solve_image(enc, enc.forward(images).cache(), tol=1e-3, rounds=5)
    error = kspace.relative_error(solved.x, images, ["nex", "voxel"]).collect()
    assert len(error) == 3 and all(r.error < 0.05 for r in error)


def moving(spark):
    """Two scans of 8 by 8 voxels whose second state is shifted; a smooth image, two coils."""
    n, rows, maps = 8, [], []
    for s in (1, 2):
        for v in range(n * n):
            x, y = v // n - 3.5, v % n - 3.5
            rows.append((s, 0, v, math.exp(-(x * x + y * y) / 6) + 0.3 * math.exp(-((x - 2) ** 2 + y * y) / 3), 0.1 * x))
            maps += [(s, 0, v, 1.0 + 0.05 * x, 0.02 * y), (s, 1, v, 0.5 - 0.05 * y, 0.1)]
    img = spark.createDataFrame(rows, "scan_id long, nex long, voxel long, re double, im double").cache()
    smaps = spark.createDataFrame(maps, "scan_id long, coil long, voxel long, re double, im double").cache()
    grids = img.select("scan_id").distinct().select("scan_id", F.lit(n).alias("nx"), F.lit(n).alias("ny"), F.lit(1).alias("nz")).cache()
    samples = img.select("scan_id", "nex", (F.col("voxel") % 2).alias("state"), F.col("voxel").alias("cell")).cache()
    true = spark.createDataFrame([(s, k, 0.4 * k * s, -0.3 * k, 0.0) for s in (1, 2) for k in (0, 1)], "scan_id long, state long, tx double, ty double, phi double").cache()
    enc = encoding.Encoding(grids, smaps, samples, motion.stencil(motion.rigid_field_2d(true, n, n), (n, n)))
    still = true.select("scan_id", "state", *(F.lit(0.0).alias(p) for p in motion.RIGID_2D)).cache()
    return grids, smaps, samples, enc.forward(img).cache(), still


def test_loop_is_resumed_where_it_ended(spark, tmp_path):
    how = {"levels": (0.75,), "iterations": 2, "rounds": 2, "lam": 1e-3, "weight": 1e-3}
    whole = reconstruction.reconstruct(*moving(spark), str(tmp_path / "whole"), **how)
    ran = []

    def ended(level, k):
        ran.append((level, k))
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        reconstruction.reconstruct(*moving(spark), str(tmp_path / "parts"), after=ended, **how)
    rest = reconstruction.reconstruct(*moving(spark), str(tmp_path / "parts"), after=lambda level, k: ran.append((level, k)), **how)
    assert ran == [(0, 0), (0, 1)]
    a, b = (sorted(map(tuple, x.log.collect())) for x in (whole, rest))
    assert len(a) == len(b) == 4 and all(x[:3] == y[:3] and math.isclose(x[3], y[3], rel_tol=1e-6) and x[4] == y[4] for x, y in zip(a, b))
    a, b = (complexes(x.images, "scan_id", "nex", "voxel") for x in (whole, rest))
    assert len(a) == 128 and all(abs(a[k] - b[k]) < 1e-6 for k in a)
    # Correcting the motion explains more of what was measured.
    left = {(r.scan_id, r.gn_iter): r.relres for r in whole.log.collect()}
    assert all(left[s, 1] < left[s, 0] for s in (1, 2))


def test_scans_in_two_levels_split_a_hot_key(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = [(1 if i % 3 else i % 7, (i * 37) % 4001, float(i % 11) - 5) for i in range(4000)]
    df = spark.createDataFrame(rows, "k long, t long, v double")
    b = scan.bucketed(df, ["k"], ["t"]).cache()
    sizes = [r["count"] for r in b.groupBy(scan.BUCKET).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
    out = scan.neighbour(scan.running(b, ["k"], ["t"], sums={"s": F.col("v")}, maxima={"m": F.col("v")}), ["k"], ["t"], F.col("t"), "before")
    out = scan.neighbour(out, ["k"], ["t"], F.col("t"), "next", ahead=True)
    by = {}
    for k, t, v in sorted(rows):
        by.setdefault(k, []).append((t, v))
    want = {(k, t): (sum(x for _, x in r[: i + 1]), max(x for _, x in r[: i + 1]), r[i - 1][0] if i else None, r[i + 1][0] if i + 1 < len(r) else None) for k, r in by.items() for i, (t, _) in enumerate(r)}
    assert {(r.k, r.t): (r.s, r.m, r.before, r.next) for r in out.collect()} == want
