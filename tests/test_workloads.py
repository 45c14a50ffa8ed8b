"""The raw-to-bundle job, and percentiles and clusters of hot or tied keys, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.jobs import workloads
from motionlake.operators import acquisition, binning, kspace
from motionlake.sources import tables

ACQ = "scan_id long, acq_idx long, coil int, flags long, ky int, kz int, repetition int, slice int, acq_ts long, re array<double>, im array<double>"
META = "scan_id long, max_slice int, max_rep int, max_step1 int, max_step2 int"


def readout(scan, i, ky, z=0, flags=0, coils=2):
    return [(scan, i, c, flags, ky, 0, 0, z, i * 40, [float(i + c)] * 8, [0.0] * 8) for c in range(coils)]


@pytest.fixture(scope="module")
def bundle(spark):
    acq = [r for i in range(6) for r in readout(1, i, i % 4, i % 2)]
    acq += readout(1, 6, 0, 0, flags=1 << 18)
    acq += [r for i in range(5) for r in readout(2, i, i, i % 2)]
    acq += [r for i in range(4) for r in readout(3, i, i, i % 2)]
    meta = [(s, 1, 0, 4, 0) for s in (1, 2, 3)]
    sensor = [(s, c, t, float(t % 7) * (c + 1)) for s in (1, 2) for c in (0, 1) for t in range(-100, 10)]
    triggers = [(s, k, t) for s in (1, 2) for k, t in (("start", -90), ("stop", 0))]
    path = tables.shared_path(spark)
    return workloads.raw_to_bundle(
        spark.createDataFrame(acq, ACQ), spark.createDataFrame(meta, META),
        spark.createDataFrame(sensor, "scan_id long, channel int, t long, y double"), spark.createDataFrame(triggers, "scan_id long, kind string, t long"), path, 10.0, cutoff=1.0,
    )


def test_scans_left_out_whole(bundle):
    assert {r.scan_id: r.reason for r in bundle.quarantined.collect()} == {2: "uneven slices", 3: "no motion signal"}
    assert {r.scan_id for r in bundle.readouts.collect()} == {1} == {r.scan_id for r in bundle.lines.collect()}


def test_lines_of_slices(bundle):
    got = sorted((r.z, r.line_idx, r.ky) for r in bundle.readouts.collect())
    assert got == [(0, 0, 0), (0, 1, 2), (0, 2, 0), (1, 0, 1), (1, 1, 3), (1, 2, 1)]
    assert all(r.motion is not None for r in bundle.readouts.collect())


def test_last_line_of_a_place_without_oversampling(bundle):
    lines = {(r.coil, r.z, r.ky): r for r in bundle.lines.collect()}
    assert sorted(lines) == sorted((c, z, ky) for c in (0, 1) for z, ky in ((0, 0), (0, 2), (1, 1), (1, 3)))
    whole = kspace.fft_centred(np.full((1, 8), 4.0 + 1.0, complex), (1,), inverse=True)
    want = kspace.fft_centred(whole[:, 2:6], (1,))[0]
    assert np.allclose(np.array(lines[1, 0, 0].re) + 1j * np.array(lines[1, 0, 0].im), want)


def test_slices_by_scan(spark):
    rows = spark.createDataFrame([(1, 0, 2, 0), (1, 1, 2, 1), (2, 0, 2, 0)], "scan_id long, z long, n long, acq_idx long")
    assert acquisition.quarantine(rows).count() == 0
    assert [tuple(r) for r in acquisition.quarantine(rows, "n").collect()] == [(2, 0, 1)]
    assert acquisition.slice_tables(rows.filter("scan_id < 0")).count() == 0


def test_percentiles_of_a_hot_scan(spark):
    rng = np.random.default_rng(3)
    values = {1: np.r_[np.zeros(3000), rng.normal(size=2000)], 2: np.array([5.0]), 3: rng.integers(0, 4, 50).astype(float), None: np.array([1.0, 2.0])}
    rows = [(s, float(v)) for s, vs in values.items() for v in vs] + [(1, None), (4, None)]
    out = kspace.percentiles(spark.createDataFrame(rows, "scan_id long, v double"), (0.02, 0.5, 0.98)).collect()
    assert {r.scan_id for r in out} == {1, 2, 3, None}
    for r in out:
        assert r.n == len(values[r.scan_id]) and np.allclose(r.q, np.quantile(values[r.scan_id], (0.02, 0.5, 0.98)))
    exact = kspace.robust_window(spark.createDataFrame([(1, i, float(i)) for i in range(101)], "scan_id long, voxel long, v double"))
    assert {r.voxel: r.scaled for r in exact.collect()}[50] == 0.5


def test_clusters_of_equal_samples(spark):
    rows = [(1, i, 0.1) for i in range(9)] + [(2, i, float(i // 3)) for i in range(9)] + [(3, 0, 1.0)]
    out = binning.bin_motion(spark.createDataFrame(rows, "scan_id long, line_idx long, motion double"), 3, n_iter=10).collect()
    assert {r.scan_id for r in out} == {1, 2}
    assert all(abs(r.center - 0.1) < 1e-12 for r in out if r.scan_id == 1)
    near = [r for r in out if r.scan_id == 2]
    assert all(r.center is not None for r in near) and {r.label for r in out if r.scan_id == 1} == {0}
    assert all(a.label == b.label for a in near for b in near if a.motion == b.motion)


def test_bundle_readouts_number_from_zero(bundle):
    per = bundle.readouts.groupBy("scan_id", "z").agg(F.min("line_idx").alias("a"), F.max("line_idx").alias("b"), F.count("*").alias("n")).collect()
    assert all(r.a == 0 and r.b == r.n - 1 for r in per)
