"""Motion states: clusters of a scan's motion signal, and their readouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionlake.sources.tables import materialize


#: Bytes of centres, estimated from their number, that a round broadcasts at most.
BROADCAST_BYTES = 8 << 20


def too_few(readouts: DataFrame, k: int) -> DataFrame:
    """Scans with fewer motion samples than states, which are not binned."""
    return readouts.groupBy("scan_id").agg(F.count("motion").alias("n")).filter(F.col("n") < k)


def in_units(values: DataFrame) -> DataFrame:
    """``values(scan_id, motion, n)`` with ``unit``, 2 to the power of -82 of a scan's largest modulus or less, and ``units``: motion times n in whole units.

    Sums of units are exact in any order. Scans with a modulus that is not finite, or whose unit would not be a normal number, have null there.
    """
    top = values.groupBy("scan_id").agg(F.max(F.abs("motion")).alias("_top"))
    # With NaN as the greatest, one comparison finds both kinds.
    power = F.when((F.col("_top") > 1e-270) & (F.col("_top") < 1e270), F.ceil(F.log2("_top")) + 1).when(F.col("_top") == 0, 0)
    top = top.select("scan_id", F.pow(F.lit(2.0), power - 82).alias("unit"), F.pow(F.lit(2.0), 52 - power).alias("_scale"))
    at = F.col("motion") * F.col("_scale")
    whole = F.floor(at)
    units = whole.cast("decimal(17,0)") * F.lit(1 << 30).cast("decimal(10,0)") + F.floor((at - whole) * float(1 << 30)).cast("decimal(10,0)")
    return values.join(top, "scan_id").withColumn("units", units * F.col("n").cast("decimal(10,0)")).drop("_scale")


def bin_motion(readouts: DataFrame, k: int, n_iter: int = 20, seed: int = 0, key: str = "line_idx") -> DataFrame:
    """``readouts(scan_id, key, motion)`` with ``label`` and ``center``: one-dimensional k-means per scan.

    The first centres are the k samples whose hash of seed, scan and key is least. Each round
    assigns every sample to the nearest centre, the lowest of equally near ones, and takes means; a
    cluster left empty starts again from the sample of the hash's next rank. Labels are those of the
    last assignment and centres the means after it. All scans go through the rounds together. Rounds read
    a scan's distinct values with their counts, so equal samples are one row and samples are read
    only before the rounds and after them. Means are the doubles nearest to the exact ones (:func:`in_units`), so a sample midway
    between two centres goes to the same one in every run. Centres are broadcast while they take less than ``BROADCAST_BYTES``, and joined
    beyond; values are never shuffled by a broadcast round, which adds up one partial sum per task, scan and label. Centres are
    written to the shared folder every fifth round, each round if they are joined, which ends their lineage. Scans of fewer than k samples are left out.
    """
    few = too_few(readouts, k).select("scan_id")
    points = materialize(readouts.filter("motion is not null").join(few, "scan_id", "left_anti"))
    rank = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("scan_id").cast("string"), F.col(key).cast("string")))
    ranked = points.select("scan_id", F.struct(rank.alias("h"), F.col(key).alias("i"), "motion").alias("s"))
    state = materialize(_least(ranked, 2 * k).select("scan_id", F.slice("s.motion", 1, k).alias("c"), F.slice("s.motion", k + 1, k).alias("spare")))
    small = state.count() * (2 * k * 8 + 64) <= BROADCAST_BYTES
    held = F.broadcast if small else (lambda df: df)
    near = F.array_min(F.transform("c", lambda c, j: F.struct(F.abs(F.col("motion") - c).alias("d"), j.alias("j"))))["j"]

    values = materialize(in_units(points.groupBy("scan_id", "motion").agg(F.count("*").alias("n"))))

    def assigned(rows: DataFrame, state: DataFrame) -> DataFrame:
        return rows.join(held(state.select("scan_id", "c")), "scan_id").withColumn("label", near.cast("bigint"))

    def moved(state: DataFrame, i: int) -> DataFrame:
        # Rounding must not move the mean of equal values away from them, or ties fall to another cluster.
        exact = (F.sum("units") / F.sum("n").cast("decimal(20,0)")).cast("double") * F.max("unit")
        mean = F.greatest(F.min("motion"), F.least(F.max("motion"), F.coalesce(exact, F.sum(F.col("motion") * F.col("n")) / F.sum("n"))))
        means = assigned(values, state).groupBy("scan_id", "label").agg(mean.alias("m"))
        means = means.groupBy("scan_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "m"))).alias("m"))
        # A scan of just k samples has no spare ones: an index into the empty array must give null.
        again = F.coalesce(F.get("spare", F.pmod(F.lit(i), F.greatest(F.size("spare"), F.lit(1)))), F.col("c")[0])
        c = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.coalesce(F.try_element_at("m", j.cast("bigint")), again))
        return state.join(means, "scan_id").select("scan_id", c.alias("c"), "spare")

    for i in range(n_iter - 1):
        state = moved(state, i)
        # Joins keep memory in each round of a plan, and several such rounds in one plan run out of it.
        if not small or i % 5 == 4 or i == n_iter - 2:
            state = materialize(state)
    labelled = assigned(points, state).drop("c")
    centers = moved(state, n_iter - 1).select("scan_id", "c")
    return labelled.join(held(centers), "scan_id").withColumn("center", F.col("c")[F.col("label").cast("int")]).drop("c")


def _least(ranked: DataFrame, n: int) -> DataFrame:
    """The n least structs of each scan as a sorted array; the row-number filter limits groups before the shuffle."""
    kept = ranked.withColumn("r", F.row_number().over(Window.partitionBy("scan_id").orderBy("s"))).filter(F.col("r") <= n)
    return kept.groupBy("scan_id").agg(F.sort_array(F.collect_list("s")).alias("s"))


def attach_states(readouts: DataFrame, states: DataFrame) -> DataFrame:
    """``readouts`` with the values of their state; ``states`` has one row per scan and state."""
    return readouts.join(states, ["scan_id", "state"], "left")


def state_groups(readouts: DataFrame, n_nex: int, n_states: int) -> DataFrame:
    """Number of lines of every repetition and state of each scan, pairs without lines too.

    A null state means that there is no motion signal: the readout is its own group.
    """
    labelled = readouts.withColumn("state", F.coalesce(F.col("state"), F.col("line_idx")))
    grid = labelled.select("scan_id").distinct().select("scan_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_nex - 1).cast("bigint"))).alias("nex")).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_states - 1).cast("bigint"))).alias("state"))
    counts = labelled.groupBy("scan_id", "nex", "state").agg(F.count("*").alias("n_lines"))
    return grid.join(counts, ["scan_id", "nex", "state"], "full").fillna(0, ["n_lines"])
