"""Conjugate gradients for all scans of a cohort in lockstep, on vectors whose entries are rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.sources.tables import materialize

Apply = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Solved:
    """Solutions ``(scan_id, places, values)``, and a log row ``scan_id, round, relres, reason`` for each round of each scan; ``reason`` stands in its last."""

    x: DataFrame
    log: DataFrame


def _dot(values: tuple[str, ...], a: str, b: str) -> Column:
    """Real part of the inner product, as an aggregate."""
    return F.sum(sum((F.col(f"{a}_{v}") * F.col(f"{b}_{v}") for v in values), F.lit(0.0)))


def _named(df: DataFrame, places: list[str], values: tuple[str, ...], name: str) -> DataFrame:
    return df.select("scan_id", *places, *(F.col(v).cast("double").alias(f"{name}_{v}") for v in values))


def cg_solve(
    apply: Apply, b: DataFrame, places: list[str], values: tuple[str, ...] = ("re", "im"), x0: DataFrame | None = None,
    tol: float = 1e-6, rounds: int = 20, patience: int | None = None,
) -> Solved:
    """Solve ``apply(x) = b`` for every scan, where ``apply`` is linear, symmetric (Hermitian) and positive.

    A vector is a table of rows (scan, places) with values, complex ones as two columns; a place that ``apply`` leaves
    out is zero, and ``b`` has a row for each place of the solution. Every round applies the operator once to the
    directions of all scans that are still running; a scan's two inner products, of the direction with its image and of the
    new residual with itself, are sums over the written rows.
    The state with the operator's image is written to the shared folder in each round, so the operator runs once and lineage ends.

    A scan stops when its residual is at most ``tol`` times the norm of ``b`` ("tolerance"; so does one whose ``b`` is
    zero), when its direction has no curvature left ("breakdown"), when ``patience`` rounds have not lowered its
    residual ("stagnation"), or after the last round ("rounds"). A scan that has stopped leaves the next round's input.
    The iterate of least residual is returned.
    """
    rows = _named(b, places, values, "b")
    if x0 is None:
        rows = rows.withColumns({f"x_{v}": F.lit(0.0) for v in values} | {f"r_{v}": F.col(f"b_{v}") for v in values})
    else:
        start = _named(x0, places, values, "x")
        image = _named(apply(x0), places, values, "q")
        rows = rows.join(start, ["scan_id", *places], "left").join(image, ["scan_id", *places], "left").fillna(0.0)
        rows = rows.withColumns({f"r_{v}": F.col(f"b_{v}") - F.col(f"q_{v}") for v in values}).drop(*(f"q_{v}" for v in values))
    rows = rows.withColumns({f"{n}_{v}": F.col(f"{o}_{v}") for v in values for n, o in (("p", "r"), ("best", "x"))})
    rows = materialize(rows)
    norms = rows.groupBy("scan_id").agg(_dot(values, "b", "b").alias("bb"), _dot(values, "r", "r").alias("rr"))
    scan = materialize(norms.select("scan_id", "bb", "rr", F.col("rr").alias("least"), F.lit(0).alias("idle"), _reason(F.col("rr"), F.col("bb"), tol, None, None).alias("reason")))
    rows = rows.drop(*(f"b_{v}" for v in values))
    logs, done = [_logged(scan, 0)], [_result(rows, scan.filter("reason is not null"), places, values)]
    running = scan.filter("reason is null").drop("reason")
    for k in range(1, rounds + 1):
        if running.isEmpty():
            break
        live = rows.join(running.select("scan_id"), "scan_id", "left_semi")
        image = apply(live.select("scan_id", *places, *(F.col(f"p_{v}").alias(v) for v in values)))
        met = materialize(live.join(_named(image, places, values, "q"), ["scan_id", *places], "left").fillna(0.0))
        alpha = F.when(F.col("pq") > 0, F.col("rr") / F.col("pq")).otherwise(0.0)
        step = running.join(met.groupBy("scan_id").agg(_dot(values, "p", "q").alias("pq")), "scan_id").withColumn("alpha", alpha)
        left = [F.col(f"r_{v}") - F.col("alpha") * F.col(f"q_{v}") for v in values]
        after = met.join(step.select("scan_id", "alpha"), "scan_id").groupBy("scan_id").agg(F.sum(sum((x * x for x in left), F.lit(0.0))).alias("new"))
        step = step.join(after, "scan_id")
        step = step.withColumns({"beta": F.when(F.col("rr") > 0, F.col("new") / F.col("rr")).otherwise(0.0), "better": F.col("new") < F.col("least")})
        idle = F.when(F.col("better"), 0).otherwise(F.col("idle") + 1)
        step = step.withColumn("reason", _reason(F.col("new"), F.col("bb"), tol, F.col("pq"), (idle, patience) if patience else None, k == rounds)).withColumn("idle", idle)
        step = materialize(step.select("scan_id", "bb", F.col("new").alias("rr"), F.least("least", "new").alias("least"), "idle", "reason", "alpha", "beta", "better"))
        rows = _moved(met.join(step.select("scan_id", "alpha", "beta", "better"), "scan_id"), places, values)
        scan = step.drop("alpha", "beta", "better")
        logs.append(_logged(scan, k))
        done.append(_result(rows, scan.filter("reason is not null"), places, values))
        running = scan.filter("reason is null").drop("reason")
    return Solved(_union(done), _union(logs))


def _reason(rr: Column, bb: Column, tol: float, pq: Column | None, idle: tuple[Column, int] | None, last: bool = False) -> Column:
    out = F.when((rr <= tol * tol * bb) | (bb == 0), "tolerance")
    if pq is not None:
        out = out.when(pq <= 0, "breakdown")
    if idle is not None:
        out = out.when(idle[0] >= idle[1], "stagnation")
    return out.otherwise(F.lit("rounds" if last else None).cast("string"))


def _moved(met: DataFrame, places: list[str], values: tuple[str, ...]) -> DataFrame:
    c, out = F.col, {}
    for v in values:
        x, r = c(f"x_{v}") + c("alpha") * c(f"p_{v}"), c(f"r_{v}") - c("alpha") * c(f"q_{v}")
        out |= {f"x_{v}": x, f"r_{v}": r, f"p_{v}": r + c("beta") * c(f"p_{v}"), f"best_{v}": F.when(c("better"), x).otherwise(c(f"best_{v}"))}
    return met.select("scan_id", *places, *(e.alias(n) for n, e in out.items()))


def _logged(scan: DataFrame, k: int) -> DataFrame:
    return scan.select("scan_id", F.lit(k).alias("round"), F.when(F.col("bb") > 0, F.sqrt(F.col("rr") / F.col("bb"))).otherwise(0.0).alias("relres"), "reason")


def _result(rows: DataFrame, stopped: DataFrame, places: list[str], values: tuple[str, ...]) -> DataFrame:
    return rows.join(stopped.select("scan_id"), "scan_id", "left_semi").select("scan_id", *places, *(F.col(f"best_{v}").alias(v) for v in values))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def damped(apply: Apply, regular: Apply, weight: DataFrame, places: list[str], values: tuple[str, ...] = ("re", "im")) -> Apply:
    """``apply(x) + weight * regular(x)`` with a ``weight(scan_id, weight)`` for each scan."""

    def f(x: DataFrame) -> DataFrame:
        held = regular(x).join(weight, "scan_id")
        both = apply(x).select("scan_id", *places, *values).unionByName(held.select("scan_id", *places, *((F.col("weight") * F.col(v)).alias(v) for v in values)))
        return both.groupBy("scan_id", *places).agg(*(F.sum(v).alias(v) for v in values))

    return f


def gaussian(keys: list[Column], part: str, seed: int = 0) -> Column:
    """A standard normal number for each key: two hashes of seed, key and part, by Box and Muller."""

    def uniform(n: int) -> Column:
        h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(f"{part}{n}"), *(k.cast("string") for k in keys)))
        return (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0

    return F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * F.pi() * uniform(1))


def regularisation_scale(apply: Apply, regular: Apply, grid: DataFrame, places: list[str], values: tuple[str, ...] = ("re", "im"), probes: int = 8, seed: int = 0) -> DataFrame:
    """``scan_id, scale``: the lower median over Gaussian probes of the norm of ``apply(v)`` over that of ``regular(v)``.

    ``grid`` has a row for each place. Probes are hashes of the places, the same in every run. A probe whose
    regulariser is zero has no ratio; a scan without any gets the scale 1.
    """
    parts = []
    for k in range(probes):
        v = grid.select("scan_id", *places, *(gaussian([F.lit(k), F.col("scan_id"), *map(F.col, places)], p, seed).alias(p) for p in values))
        for name, f in (("n", apply), ("d", regular)):
            norm = F.sqrt(F.sum(sum((F.col(p) * F.col(p) for p in values), F.lit(0.0))))
            # Under one key of scan and probe the union's parts no longer count as partitioned by scan: each runs in tasks of its own,
            # where else one task would hold the sorts of all probes and of both operators.
            key = F.struct("scan_id", F.lit(k).alias("probe")).alias("key")
            parts.append(f(v).groupBy("scan_id").agg(norm.alias("norm")).select(key, F.lit(name).alias("of"), "norm"))
    of = lambda name: F.max(F.when(F.col("of") == name, F.col("norm")))
    norms = _union(parts).groupBy("key").agg(of("n").alias("n"), of("d").alias("d"), F.bool_or(F.col("of") == "n").alias("applied")).filter("applied")
    ratios = norms.select("key.scan_id", F.when(F.col("d") > 0, F.col("n") / F.col("d")).alias("ratio"))
    sorted_ = ratios.groupBy("scan_id").agg(F.sort_array(F.collect_list("ratio")).alias("r"))
    return sorted_.select("scan_id", F.coalesce(F.get("r", F.floor((F.size("r") - 1) / 2).cast("int")), F.lit(1.0)).alias("scale"))
