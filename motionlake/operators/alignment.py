"""Times: sensor signals at readouts, and sequences of triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionlake.operators import scan


def interp_asof(sensor: DataFrame, readouts: DataFrame, bucket_s: float = 60.0, t: str = "t", y: str = "y") -> DataFrame:
    """``readouts`` with ``motion``: the sensor's value at their time, linear between its neighbours.

    The neighbours are the last sample before the readout and the first at its time or after it.
    Outside of the recording the nearest value holds; between two samples of one time the earlier's.
    ``sensor(scan_id, t, y)`` has one sample per time. A long recording is cut into time buckets:
    windows run within a bucket, and only each bucket's first and last sample pass to others,
    so no task holds a whole recording. Scans without a sample get null.
    """
    bucket = F.floor(F.col(t) / F.lit(bucket_s))
    rest = [c for c in readouts.columns if c not in ("scan_id", t)]
    s = sensor.select("scan_id", F.col(t).alias("_t"), F.lit(1).alias("_kind"), F.struct(F.col(t).alias("t"), F.col(y).alias("y")).alias("_s"), *(F.lit(None).cast(readouts.schema[c].dataType).alias(c) for c in rest), bucket.alias("_b"))
    q = readouts.select("scan_id", F.col(t).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(s.schema["_s"].dataType).alias("_s"), *rest, bucket.alias("_b"))
    both = s.unionByName(q)
    edges = both.groupBy("scan_id", "_b").agg(F.min(F.when(F.col("_kind") == 1, F.col("_s"))).alias("_lo"), F.max(F.when(F.col("_kind") == 1, F.col("_s"))).alias("_hi"))
    # What follows is looked for from the end: a frame that grows is kept up, one that shrinks is made anew for each row.
    w, back = Window.partitionBy("scan_id").orderBy("_b"), Window.partitionBy("scan_id").orderBy(F.desc("_b"))
    edges = edges.select("scan_id", "_b", F.last("_hi", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_prev"), F.last("_lo", True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("_next"))
    # At one time readouts stand before samples: those are "at or after" it.
    w, back = Window.partitionBy("scan_id", "_b").orderBy("_t", "_kind"), Window.partitionBy("scan_id", "_b").orderBy(F.desc("_t"), F.desc("_kind"))
    inside = both.withColumn("_l", F.last("_s", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", F.last("_s", True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    found = inside.filter("_kind = 0").join(edges, ["scan_id", "_b"]).select("scan_id", F.col("_t").alias(t), *rest, F.coalesce("_l", "_prev").alias("_l"), F.coalesce("_r", "_next").alias("_r"))
    width = F.col("_r.t") - F.col("_l.t")
    value = (
        F.when(F.col("_l").isNull(), F.col("_r.y"))
        .when(F.col("_r").isNull() | (width == 0), F.col("_l.y"))
        .otherwise(F.col("_l.y") + (F.col("_r.y") - F.col("_l.y")) * (F.col(t) - F.col("_l.t")) / width)
    )
    return found.withColumn("motion", value).drop("_l", "_r")


def pair_sequences(triggers: DataFrame) -> DataFrame:
    """The longest start/stop pair of each scan, the first of equal ones: ``start_t, stop_t, duration``.

    Each start takes the first later stop that no earlier start has taken. With ``lo`` the number of
    stops up to start i, that is stop number ``i + max(lo - i)`` over the starts so far, so a
    running maximum replaces the loop.
    """
    stop = F.col("kind") == "stop"
    # A stop at the very time of a start is not later than it.
    one, key = F.lit(1).cast("bigint"), ["scan_id"]
    rows = scan.running(scan.bucketed(triggers.select("scan_id", "kind", "t"), key, ["t"]), key, ["t"], ties=True, sums={"lo": F.when(stop, one).otherwise(0)})
    # Numbers of starts and of stops, each in order of time, are running counts over the same ranges.
    rows = scan.running(rows, key, ["t"], sums={"n_start": F.when(stop, 0).otherwise(one), "n_stop": F.when(stop, one).otherwise(0)})
    starts = rows.filter(~stop).select("scan_id", F.col("t").alias("start_t"), (F.col("n_start") - 1).alias("i"), "lo", scan.BUCKET)
    ahead = scan.running(starts, key, ["start_t", "i"], maxima={"ahead": F.col("lo") - F.col("i")})
    stops = rows.filter(stop).select("scan_id", (F.col("n_stop") - 1).alias("j"), F.col("t").alias("stop_t"))
    pairs = ahead.withColumn("j", F.col("i") + F.col("ahead")).join(stops, ["scan_id", "j"]).withColumn("duration", F.col("stop_t") - F.col("start_t"))
    best = F.max_by(F.struct("start_t", "stop_t", "duration"), F.struct("duration", -F.col("start_t")))
    return pairs.groupBy("scan_id").agg(best.alias("p")).select("scan_id", "p.*")


def sensor_time(samples: DataFrame, sequences: DataFrame, ticks_per_s: float) -> DataFrame:
    """``samples`` with ``t_s``: seconds from the end of their scan's sequence."""
    return samples.join(sequences.select("scan_id", "stop_t"), "scan_id").withColumn("t_s", (F.col("t") - F.col("stop_t")).cast("double") / F.lit(ticks_per_s)).drop("stop_t")
