"""Closed forms, adjoints, round trips and end-to-end properties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.operators import acquisition, alignment, binning, signal
from motionlake.operators.kspace import fft_centred
from motionlake.sources import tables


def test_transform_round_trip_and_delta():
    x = np.random.default_rng(0).standard_normal((6, 5, 4))
    assert np.allclose(fft_centred(fft_centred(x, (0, 1, 2)), (0, 1, 2), inverse=True), x)
    delta = np.zeros((8, 8, 1))
    delta[4, 4, 0] = 1
    assert np.allclose(fft_centred(delta, (0, 1, 2)), 1 / 8)


def plain_filter(y, rate, cutoff, kind):
    """Sample by sample: extend, run forward and backward, cut."""
    k = math.tan(math.pi * cutoff / rate)
    b0, b1 = (k / (1 + k),) * 2 if kind == "low" else (1 / (1 + k), -1 / (1 + k))
    a, pad = (k - 1) / (k + 1), min(6, len(y) - 1)
    x = [2 * y[0] - y[i] for i in range(pad, 0, -1)] + list(y) + [2 * y[-1] - y[-1 - i] for i in range(1, pad + 1)]
    for _ in range(2):
        out, last, before = [], x[0] * (b0 + b1) / (1 + a), x[0]
        for v in x:
            last, before = b0 * v + b1 * before - a * last, v
            out.append(last)
        x = out[::-1]
    return x[pad : pad + len(y)]


def test_filter_keeps_a_constant_and_damps_fast_waves(spark):
    t = np.arange(2000) / 100
    slow, fast = np.sin(2 * np.pi * 0.2 * t), np.sin(2 * np.pi * 20 * t)
    signals = {0: np.ones(2000), 1: slow + fast, 2: slow + 5}
    df = spark.createDataFrame([(s, float(a), float(b)) for s, ys in signals.items() for a, b in zip(t, ys)], "scan_id long, t double, y double")

    def run(kind):
        out = {}
        for r in signal.zero_phase(df, 3.0, kind, ("scan_id",), chunk=128).orderBy("t").collect():
            out.setdefault(r.scan_id, []).append(r.filtered)
        return {s: np.array(v) for s, v in out.items()}

    low, high = run("low"), run("high")
    assert np.allclose(low[0], 1) and np.abs(low[1] - slow)[100:-100].max() < 0.1 and np.abs(high[2]).max() < 0.2


@pytest.mark.parametrize("kind", ["low", "high"])
@pytest.mark.parametrize("chunk", [1, 3, 50, 10_000])
def test_filter_in_chunks_is_the_filter_of_the_whole(spark, kind, chunk):
    rng = np.random.default_rng(chunk)
    # Short and long channels, gaps and bursts, a null key, columns of the operator's own names.
    lengths = {None: 40, 1: 2, 2: 3, 3: 8, 4: 700}
    rows = [(s, float(a), float(rng.standard_normal())) for s, n in lengths.items() for a in np.sort(rng.choice(5000, n, replace=False)) ** (1.5 if s == 4 else 1.0)]
    alone = [(7, 5.0, 3.0), (8, 1.0, 2.0), (8, 1.0, 4.0), (4, None, 1.0), (4, 10.0, None)]
    df = spark.createDataFrame(rows + alone, "scan_id long, t double, y double").withColumn("_n", F.lit("x"))
    cutoff = 1e-4
    got = {(r.scan_id, r.t, r.y): r.filtered for r in signal.zero_phase(df, cutoff, kind, ("scan_id",), chunk).collect()}
    assert len(got) == len(rows) + len(alone)
    for s in lengths:
        part = sorted((t, y) for k, t, y in rows if k == s)
        want = plain_filter([y for _, y in part], len(part) / (part[-1][0] - part[0][0]), cutoff, kind)
        assert np.allclose([got[s, t, y] for t, y in part], want, atol=1e-9)
    assert got[7, 5.0, 3.0] == (0.0 if kind == "high" else 3.0)
    assert (got[8, 1.0, 2.0], got[8, 1.0, 4.0]) == (2.0, 4.0)
    assert got[4, None, 1.0] is None and got[4, 10.0, None] is None
    assert signal.zero_phase(df.limit(0), cutoff, kind, ("scan_id",)).count() == 0
    assert signal.zero_phase(df, 1e9, kind, ("scan_id",)).filter("filtered <> y and scan_id <> 7").count() == 0


@pytest.mark.parametrize("kind", ["low", "high"])
def test_short_channels_are_filtered_together(spark, kind):
    """Each of the many channels of a few samples was a group of its own in Python, at some milliseconds each."""
    rng = np.random.default_rng(5)
    rows = [(s, float(a), float(v)) for s in range(400) for a, v in zip(np.sort(rng.choice(900, 2 + s % 11, replace=False)), rng.standard_normal(2 + s % 11))]
    out = signal.zero_phase(spark.createDataFrame(rows, "scan_id long, t double, y double"), 1e-4, kind, ("scan_id",))
    got = {(r.scan_id, r.t): r.filtered for r in out.collect()}
    assert len(got) == len(rows)
    for s in range(400):
        part = [(t, y) for k, t, y in rows if k == s]
        want = plain_filter([y for _, y in part], len(part) / (part[-1][0] - part[0][0]), 1e-4, kind)
        assert np.allclose([got[s, t] for t, _ in part], want, atol=1e-9)
    done = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "MapInArrow" in done and "FlatMapGroups" not in done


def test_pairs_match_a_two_pointer_loop(spark):
    random.seed(2)
    rows, want = [], {}
    for scan in range(200):
        times = random.sample(range(60), random.randint(1, 20))
        kinds = [random.choice(["start", "stop"]) for _ in times]
        rows += [(scan, k, t) for k, t in zip(kinds, times)]
        starts, stops = (sorted(t for k, t in zip(kinds, times) if k == x) for x in ("start", "stop"))
        at, best = 0, None
        for s in starts:
            while at < len(stops) and stops[at] <= s:
                at += 1
            if at == len(stops):
                break
            if best is None or stops[at] - s > best[2]:
                best = (s, stops[at], stops[at] - s)
            at += 1
        if best:
            want[scan] = best
    got = alignment.pair_sequences(spark.createDataFrame(rows, "scan_id long, kind string, t long")).collect()
    assert {r.scan_id: (r.start_t, r.stop_t, r.duration) for r in got} == want


@pytest.mark.parametrize("bucket", [1.0, 5.0, 1000.0])
def test_interpolation_at_any_bucket(spark, bucket):
    rng = np.random.default_rng(4)
    ts, q = np.unique(rng.integers(0, 60, 25)).astype(float), rng.uniform(-5, 70, 40)
    q[:5] = ts[:5]
    ys = rng.standard_normal(len(ts))
    s = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(ts, ys)], "scan_id long, t double, y double")
    r = spark.createDataFrame([(1, i, float(a)) for i, a in enumerate(q)], "scan_id long, i long, t double")
    got = {x.i: x.motion for x in alignment.interp_asof(s, r, bucket).collect()}
    assert np.allclose([got[i] for i in range(len(q))], np.interp(q, ts, ys))


def test_bins_do_not_depend_on_partitions(spark):
    rows = [(s, i, float(np.sin(i * 0.7 + s))) for s in range(3) for i in range(40)] + [(9, 0, 1.0)]
    df = spark.createDataFrame(rows, "scan_id long, line_idx long, motion double")
    out = [sorted((r.scan_id, r.line_idx, r.label, round(r.center, 9)) for r in binning.bin_motion(df.repartition(p), 3, n_iter=6).collect()) for p in (1, 5)]
    assert out[0] == out[1] and len(out[0]) == 120
    assert [r.scan_id for r in binning.too_few(df, 3).collect()] == [9]


def test_guards(spark):
    r = spark.createDataFrame([(1, 0, 0)], "scan_id long, z long, acq_idx long")
    for z in (-1, 1):
        with pytest.raises(ValueError):
            acquisition.select_slice(r, z)
    with pytest.raises(ValueError):
        tables.read_sensor(spark, "/nowhere", "SONAR")
