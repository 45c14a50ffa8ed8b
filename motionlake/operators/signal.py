"""Physiological signals: channels, drift, filters and quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples by which a filtered channel is extended at most, and samples of a chunk on average.
PAD, CHUNK_SAMPLES = 6, 1024
#: Samples of short channels that are filtered at once.
BLOCK_SAMPLES = 1 << 18


def argmax_by(df: DataFrame, keys: list[str], index: str, score: str) -> DataFrame:
    """Per key the index with the highest score, the lowest of equal ones."""
    best = F.max_by(F.struct(F.col(index), F.col(score)), F.struct(F.col(score), -F.col(index)))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def pick_channel(sig: DataFrame) -> DataFrame:
    """Of a belt's channels 0 and 1 the one with the larger population deviation, 1 if equal."""
    dev = sig.groupBy("scan_id").agg(*(F.coalesce(F.stddev_pop(F.when(F.col("channel") == k, F.col("y"))), F.lit(0.0)).alias(f"s{k}") for k in (0, 1)))
    return dev.select("scan_id", F.when(F.col("s0") > F.col("s1"), 0).otherwise(1).cast("bigint").alias("channel"), "s0", "s1")


def detrend_quadratic(sig: DataFrame, two_sided: bool = False, width: float = 2.0) -> DataFrame:
    """``sig(scan_id, t, y)`` with ``detrended``: ``y`` minus a parabola fitted to the clamped signal.

    The clamp is at ``width`` deviations below the mean; above it only if ``two_sided``. The fit
    is from moments about the mean time, added up in one aggregation per scan. Scans whose
    times don't determine a parabola keep ``y`` minus its mean.
    """
    base = sig.groupBy("scan_id").agg(F.avg("y").alias("_m"), F.stddev_pop("y").alias("_d"), F.avg("t").alias("_t0"))
    low = F.greatest(F.col("y"), F.col("_m") - width * F.col("_d"))
    clamped = F.least(low, F.col("_m") + width * F.col("_d")) if two_sided else low
    x, v = F.col("t") - F.col("_t0"), F.col("_c")
    moments = (
        sig.join(base, "scan_id").withColumn("_c", clamped).withColumn("_x", x).groupBy("scan_id", "_t0")
        .agg(F.count("*").alias("n"), *(F.sum(F.pow("_x", F.lit(k))).alias(f"x{k}") for k in (1, 2, 3, 4)), F.sum(v).alias("y0"), F.sum(v * F.col("_x")).alias("y1"), F.sum(v * F.col("_x") * F.col("_x")).alias("y2"))
    )
    n, x1, x2, x3, x4, y0, y1, y2 = (F.col(c) for c in ("n", "x1", "x2", "x3", "x4", "y0", "y1", "y2"))
    det = n * (x2 * x4 - x3 * x3) - x1 * (x1 * x4 - x3 * x2) + x2 * (x1 * x3 - x2 * x2)
    a = y0 * (x2 * x4 - x3 * x3) - x1 * (y1 * x4 - x3 * y2) + x2 * (y1 * x3 - x2 * y2)
    b = n * (y1 * x4 - y2 * x3) - y0 * (x1 * x4 - x3 * x2) + x2 * (x1 * y2 - y1 * x2)
    c = n * (x2 * y2 - x3 * y1) - x1 * (x1 * y2 - x2 * y1) + y0 * (x1 * x3 - x2 * x2)
    # Relative to the product of its diagonal the determinant tells whether three times differ.
    flat = (n < 3) | (F.abs(det) <= 1e-12 * n * x2 * x4)
    fit = moments.select("scan_id", "_t0", F.when(flat, y0 / n).otherwise(a / det).alias("_a"), F.when(flat, 0.0).otherwise(b / det).alias("_b"), F.when(flat, 0.0).otherwise(c / det).alias("_q"))
    drift = F.col("_a") + F.col("_b") * x + F.col("_q") * x * x
    return sig.join(fit, "scan_id").withColumn("detrended", F.col("y") - drift).drop("_t0", "_a", "_b", "_q")


def coefficients(rate, cutoff: float, kind: str):
    """``b0, b1, a`` of a first-order Butterworth filter, so that ``out[n] = b0 y[n] + b1 y[n-1] - a out[n-1]``; arrays for an array of rates."""
    k = np.tan(np.pi * cutoff / rate)
    b0, b1 = (k, k) if kind == "low" else (1.0, -1.0)
    return b0 / (1 + k), b1 / (1 + k), (k - 1) / (k + 1)


def run_filter(y: np.ndarray, b0, b1, a, state) -> tuple[np.ndarray, np.ndarray]:
    """The filter's output and last state along the last axis, when it starts in ``state``.

    Signals of one length go together as rows, with coefficients and states in columns. A state is what the samples so far add to the next output: ``(b1 - a b0) y[n] - a state[n-1]``, summed up here in
    doubling steps.
    """
    states = (b1 - a * b0) * y
    states[..., :1] -= a * state
    step, factor = 1, -a
    while step < y.shape[-1] and np.any(factor):
        states[..., step:] = states[..., step:] + factor * states[..., :-step]
        step, factor = 2 * step, factor * factor
    return b0 * y + np.concatenate([np.broadcast_to(state, y[..., :1].shape), states[..., :-1]], axis=-1), states[..., -1][()]


def _filter_rows(y: np.ndarray, rate: np.ndarray, cutoff: float, kind: str) -> np.ndarray:
    """Whole channels of one length, a row each, filtered as :func:`_chunk_starts` tells."""
    b0, b1, a = coefficients(rate[:, None], cutoff, kind)
    pad, n = min(PAD, y.shape[1] - 1), y.shape[1]
    out = np.concatenate([2 * y[:, :1] - y[:, pad:0:-1], y, 2 * y[:, -1:] - y[:, -2 : -pad - 2 : -1]], axis=1)
    for _ in range(2):
        out = run_filter(out, b0, b1, a, (b1 - a * (b0 + b1) / (1 + a)) * out[:, :1])[0][:, ::-1]
    return out[:, pad : pad + n]


def _filter_short(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], cutoff: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows ``(*keys, _rate, _t[], _y[])`` of whole channels as one row per sample; many channels pass at once."""
    for batch in batches:
        upto = np.cumsum(batch.column("_y").value_lengths().to_numpy(zero_copy_only=False))
        edges = [0, *(np.flatnonzero(np.diff(upto // BLOCK_SAMPLES)) + 1), batch.num_rows]
        for first, end in zip(edges, edges[1:]):
            b = batch.slice(first, end - first)
            rate, t, y = b.column("_rate").to_numpy(zero_copy_only=False), b.column("_t").flatten(), b.column("_y").flatten()
            values, size = y.to_numpy(zero_copy_only=False), b.column("_y").value_lengths().to_numpy(zero_copy_only=False)
            begins, out = np.cumsum(size) - size, np.empty(len(values))
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                at = begins[rows][:, None] + np.arange(n)
                out[at] = _filter_rows(values[at], rate[rows], cutoff, kind)
            each = pa.array(np.repeat(np.arange(len(size)), size))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(each) for k in keys), t, y, pa.array(out)], names=[*keys, "t", "y", "filtered"])


def _chunk_ends(pdf: pd.DataFrame, cutoff: float, kind: str) -> pd.DataFrame:
    """Of chunks of a channel's samples the number, the outer samples, and the last states of both directions from zero."""
    out = []
    for y, rate in zip(pdf.pop("_y"), pdf["_rate"]):
        b = coefficients(rate, cutoff, kind)
        forward, state = run_filter(y, *b, 0.0)
        out.append((len(y), y[: PAD + 1], y[-PAD - 1 :], state, run_filter(forward[::-1], *b, 0.0)[1]))
    return pdf.assign(**dict(zip(("_m", "_head", "_tail", "_fore", "_back"), map(list, zip(*out)))))


def _chunk_starts(pdf: pd.DataFrame, cutoff: float, kind: str) -> pd.DataFrame:
    """The states in which each chunk of one channel starts, forward and backward.

    The channel is extended at both ends by its first and last samples, mirrored at the end's time and value. The filter starts in the
    state that a constant input of the first value leaves.
    """
    pdf = pdf.sort_values("_chunk").reset_index(drop=True)
    b0, b1, a = coefficients(pdf["_rate"].iloc[0], cutoff, kind)
    rest, gain = b1 - a * (b0 + b1) / (1 + a), b1 - a * b0
    sizes = pdf["_m"].tolist()
    pad = min(PAD, sum(sizes) - 1)
    head = np.concatenate(pdf["_head"].iloc[: PAD + 1].tolist())
    tail = np.concatenate(pdf["_tail"].iloc[-PAD - 1 :].tolist())
    before, after = 2 * head[0] - head[pad:0:-1], 2 * tail[-1] - tail[-2 : -pad - 2 : -1]
    state, start = run_filter(before, b0, b1, a, rest * before[0])[1], []
    for m, fore in zip(sizes, pdf["_fore"]):
        start.append(state)
        state = fore + (-a) ** m * state
    after = run_filter(after, b0, b1, a, state)[0][::-1]
    state, back_start = run_filter(after, b0, b1, a, rest * after[0])[1], []
    for m, back, first in zip(reversed(sizes), reversed(pdf["_back"].tolist()), reversed(start)):
        back_start.append(state)
        # What the forward start adds to the chunk's output decays from sample to sample, and so does its share of the state.
        state = back + gain * first * (1 - a ** (2 * m)) / (1 - a * a) + (-a) ** m * state
    return pdf.assign(_start=start, _back_start=back_start[::-1])


def zero_phase(sig: DataFrame, cutoff: float, kind: str, keys: tuple[str, ...] = ("scan_id", "sensor_id", "channel"), chunk: int = CHUNK_SAMPLES) -> DataFrame:
    """``sig(*keys, t, y)`` with ``filtered``: a first-order Butterworth filter forward and backward, odd extension at both ends.

    The rate is samples over the time from first to last; samples of equal times are ordered by value. A channel without a rate, or with
    a cutoff from half its rate on, keeps ``y``; of a single sample nothing passes ``"high"``. Rows without ``t`` or ``y`` get null and take no part.

    A channel of fewer than ``chunk`` samples is one row, and a task filters many such rows at once. Longer channels are cut by time
    into chunks of ``chunk`` samples on average, which are filtered from zero in parallel. A channel
    then passes states from chunk to chunk, one row each, and chunks are filtered again from theirs.
    """
    if kind not in ("low", "high"):
        raise ValueError(f"unknown kind {kind}")
    rows = sig.select(*keys, F.col("t").cast("double").alias("t"), F.col("y").cast("double").alias("y"))
    valid = F.col("t").isNotNull() & F.col("y").isNotNull()
    per = rows.filter(valid).groupBy(*keys).agg(F.count("*").alias("_n"), F.min("t").alias("_t0"), (F.max("t") - F.min("t")).alias("_span"))
    per = per.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_n", "_t0", "_span", (F.col("_n") / F.when(F.col("_span") > 0, F.col("_span"))).alias("_rate"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    timed = rows.join(per, same, "left").drop(*(f"_k{i}" for i in range(len(keys))))
    passes = valid & (F.col("_n") > 1) & F.coalesce(F.col("_rate") > 2 * cutoff, F.lit(False))
    as_is = F.when(~valid, None).when((F.col("_n") < 2) & F.lit(kind == "high"), 0.0).otherwise(F.col("y"))
    plain = timed.filter(~passes).select(*keys, "t", "y", as_is.alias("filtered"))

    sorted_rows = F.sort_array(F.collect_list(F.struct("t", "y")))
    short = timed.filter(passes & (F.col("_n") < chunk)).groupBy(*keys, "_rate").agg(sorted_rows.alias("_s"))
    typed = ", ".join(f"`{k}` {sig.schema[k].dataType.simpleString()}" for k in keys)
    whole = short.select(*keys, "_rate", F.col("_s.t").alias("_t"), F.col("_s.y").alias("_y")).mapInArrow(
        lambda batches: _filter_short(batches, keys, cutoff, kind), f"{typed}, t double, y double, filtered double"
    )

    at = F.floor((F.col("t") - F.col("_t0")) * F.col("_rate") / chunk)
    chunks = timed.filter(passes & (F.col("_n") >= chunk)).withColumn("_chunk", at).groupBy(*keys, "_rate", "_chunk").agg(sorted_rows.alias("_s"))
    chunks = chunks.select(*keys, "_rate", "_chunk", F.col("_s.t").alias("_t"), F.col("_s.y").alias("_y"))
    names = f"{typed}, _rate double, _chunk bigint"

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (_chunk_ends(f, cutoff, kind) for f in frames if len(f))

    local = chunks.drop("_t").mapInPandas(ends, f"{names}, _m bigint, _head array<double>, _tail array<double>, _fore double, _back double")
    states = local.groupBy(*keys).applyInPandas(
        lambda pdf: _chunk_starts(pdf, cutoff, kind)[[*keys, "_chunk", "_start", "_back_start"]],
        f"{typed}, _chunk bigint, _start double, _back_start double",
    )
    states = states.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_chunk").alias("_c"), "_start", "_back_start")

    def filtered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for y, rate, start, back in zip(f["_y"], f["_rate"], f.pop("_start"), f.pop("_back_start")):
                b = coefficients(rate, cutoff, kind)
                out.append(run_filter(run_filter(y, *b, start)[0][::-1], *b, back)[0][::-1])
            yield f.assign(_f=out)

    # Null-safe, so that no filter is inferred for one of the two uses of the chunks and their shuffle is made once.
    started = chunks.join(states, [*same, F.col("_chunk").eqNullSafe(F.col("_c"))]).select(*chunks.columns, "_start", "_back_start")
    done = started.mapInPandas(filtered, f"{names}, _t array<double>, _y array<double>, _f array<double>")
    zipped = F.explode(F.arrays_zip("_t", "_y", "_f")).alias("_z")
    return done.select(*keys, zipped).select(*keys, F.col("_z._t").alias("t"), F.col("_z._y").alias("y"), F.col("_z._f").alias("filtered")).unionByName(whole).unionByName(plain)


def channel_quality(bands: DataFrame, seconds: float = 50.0, threshold: float = 0.002) -> DataFrame:
    """Score of each channel of ``bands(scan_id, sensor_id, channel, idx, t, low, high)`` and whether it is kept.

    Noise is the least deviation of the high band over segments of about ``seconds``; the score is the
    root of the summed squared difference of the bands over the number of samples and the noise, and a
    channel is kept below the threshold. ``idx`` counts a channel's samples from 0.
    """
    keys = ["scan_id", "sensor_id", "channel"]
    whole = bands.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("low").alias("_m"), F.stddev_pop("high").alias("_d"), (F.max("t") - F.min("t")).alias("_span"))
    size = F.greatest(F.lit(1), F.when(F.col("_span") > 0, F.floor(seconds / F.col("_span") * F.col("n"))).otherwise(F.col("n")))
    joined = bands.join(whole, keys).withColumn("_seg", F.floor(F.col("idx") / size))
    segments = joined.groupBy(*keys, "_seg").agg(F.stddev_pop("high").alias("_sd"), F.sum(F.pow(F.col("low") - F.col("_m") - F.col("high"), F.lit(2))).alias("_ss"), F.first("n").alias("n"), F.first("_d").alias("_d"))
    out = segments.groupBy(*keys).agg(F.least(F.min("_sd"), F.first("_d")).alias("noise"), F.sum("_ss").alias("_ss"), F.first("n").alias("n"))
    score = F.sqrt("_ss") / F.col("n") / F.when(F.col("noise") > 0, F.col("noise"))
    return out.select(*keys, "noise", score.alias("score"), F.coalesce(score < threshold, F.lit(False)).alias("kept"))


def best_stream(sig: DataFrame, quality: DataFrame) -> DataFrame:
    """Of all sensors of a scan the best channel, its signal divided by its deviation.

    A channel's strength is its deviation if it is kept, else zero; the best channel of each sensor
    is taken first, then the best sensor, the first of equal ones.
    """
    dev = sig.groupBy("scan_id", "sensor_id", "channel").agg(F.stddev_pop("y").alias("dev")).join(quality.select("scan_id", "sensor_id", "channel", "kept"), ["scan_id", "sensor_id", "channel"])
    strength = dev.withColumn("strength", F.when(F.col("kept"), F.col("dev")).otherwise(0.0))
    channel = argmax_by(strength, ["scan_id", "sensor_id"], "channel", "strength")
    order = F.struct("strength", -F.col("sensor_id"))
    sensor = channel.groupBy("scan_id").agg(F.max_by(F.struct("sensor_id", "channel"), order).alias("b")).select("scan_id", "b.*")
    best = sensor.join(dev.select("scan_id", "sensor_id", "channel", "dev"), ["scan_id", "sensor_id", "channel"])
    return sig.join(best, ["scan_id", "sensor_id", "channel"]).withColumn("y", F.col("y") / F.when(F.col("dev") > 0, F.col("dev"))).drop("dev")
