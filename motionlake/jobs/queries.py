"""Registered queries over whole tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motionlake.jobs import reconstruction, workloads
from motionlake.jobs.fixtures import fixture, with_fixtures
from motionlake.operators import acquisition, alignment, binning, encoding, kspace, motion, sampling, signal, solvers
from motionlake.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

Fx = Callable[[str], DataFrame]


def query(sql: str | None = None):
    """Register a function of a fixture reader, with its SQL."""

    def add(f: Callable[[Fx], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: fixture(spark, sf_dir, name))
        if sql:
            SQL[f.__name__] = with_fixtures(sql)
        return f

    return add


def r6(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, 6) + 0.0).alias(name or c)


def r6_scaled(c: str) -> Column:
    """Rounded as DuckDB does: the millionfold to a whole number. A decimal midway, such as a mean of 32 cents, may else go the other way."""
    return (F.round(F.col(c) * 1e6) / 1e6 + 0.0).alias(c)


def meta(read: DataFrame) -> DataFrame:
    """A header per scan: largest counters, accelerations of which some are null."""
    return read.groupBy("scan_id").agg(F.max("slice").alias("max_slice"), F.max("nex").alias("max_rep"), F.max("ky").alias("max_step1"), F.max("kz").alias("max_step2")).withColumns(
        {"accel1": F.when(F.col("scan_id") % 3 > 0, F.col("scan_id") % 3), "accel2": F.lit(None).cast("bigint")}
    )


META = "meta AS (SELECT scan_id, max(slice) AS max_slice, max(nex) AS max_rep, max(ky) AS max_step1, max(kz) AS max_step2, CASE WHEN scan_id % 3 > 0 THEN scan_id % 3 END AS accel1 FROM fx_read GROUP BY scan_id)"


@query("SELECT scan_id, acq_idx, flags FROM fx_read WHERE flags & 239337472 = 0")
def f1_keep_imaging(fx):
    return acquisition.keep_imaging(fx("fx_read")).select("scan_id", "acq_idx", "flags")


@query(f"WITH {META} SELECT r.scan_id, acq_idx, CASE WHEN max_slice + 1 <= 1 AND max_step2 + 1 > 1 THEN kz ELSE slice END AS z FROM fx_read r JOIN meta USING (scan_id)")
def f2_volume_axis(fx):
    read = fx("fx_read")
    return acquisition.volume_axis(read, meta(read)).select("scan_id", "acq_idx", "z")


@query(
    f"WITH {META} SELECT scan_id, CAST(2 * ceil(greatest(1, coalesce(accel1, 1)) * ceil((max_step1 + 1) / greatest(1, coalesce(accel1, 1))) / 2) AS bigint) AS ny, CAST(2 * ceil(ceil(max_step2 + 1) / 2) AS bigint) AS nz FROM meta"
)
def f3_matrix_size(fx):
    return acquisition.matrix_size(meta(fx("fx_read")))


@query("SELECT scan_id, acq_idx, round((acq_ts - last_value(acq_ts) OVER (PARTITION BY scan_id ORDER BY acq_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) * 2.5e-3, 4) + 0.0 AS t_s FROM fx_read WHERE flags = 0")
def f4_readout_time(fx):
    return acquisition.readout_time(acquisition.keep_imaging(fx("fx_read"))).select("scan_id", "acq_idx", (F.round("t_s", 4) + 0.0).alias("t_s"))


PAIRS = """starts AS (SELECT scan_id, t, row_number() OVER (PARTITION BY scan_id ORDER BY t) - 1 AS i FROM fx_trig WHERE kind = 'start'),
  stops AS (SELECT scan_id, t, row_number() OVER (PARTITION BY scan_id ORDER BY t) - 1 AS j FROM fx_trig WHERE kind = 'stop'),
  walk AS (
    SELECT s.scan_id, s.i, s.t AS start_t, (SELECT min(j) FROM stops p WHERE p.scan_id = s.scan_id AND p.t > s.t) AS j FROM starts s WHERE s.i = 0
    UNION ALL
    SELECT s.scan_id, s.i, s.t, (SELECT min(p.j) FROM stops p WHERE p.scan_id = s.scan_id AND p.t > s.t AND p.j > w.j) FROM walk w JOIN starts s ON s.scan_id = w.scan_id AND s.i = w.i + 1 WHERE w.j IS NOT NULL),
  pairs AS (SELECT w.scan_id, w.start_t, p.t AS stop_t, p.t - w.start_t AS duration FROM walk w JOIN stops p ON p.scan_id = w.scan_id AND p.j = w.j),
  best AS (SELECT scan_id, start_t, stop_t, duration FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY duration DESC, start_t) AS k FROM pairs) WHERE k = 1)"""


@query(f"WITH RECURSIVE {PAIRS} SELECT scan_id, start_t, stop_t, duration FROM best")
def j2_pair_sequences(fx):
    return alignment.pair_sequences(fx("fx_trig"))


@query(f"WITH RECURSIVE {PAIRS} SELECT s.scan_id, s.idx, round(CAST(s.us - b.stop_t AS double) / 1e6, 6) + 0.0 AS t_s FROM fx_sensor s JOIN best b USING (scan_id)")
def f5_sensor_time(fx):
    samples = fx("fx_sensor").withColumn("t", F.col("us"))
    return alignment.sensor_time(samples, alignment.pair_sequences(fx("fx_trig")), 1e6).select("scan_id", "idx", r6("t_s"))


@query("SELECT scan_id, acq_idx, (k.x * 8 + ky) * 2 + kz AS cell FROM fx_read, generate_series(0, 7) AS k(x)")
def f6_sample_cells(fx):
    return sampling.sample_cells(fx("fx_read"), 8, 8, 2).select("scan_id", "acq_idx", "cell")


@query("SELECT scan_id, ky - 2 AS ky, acq_idx, re FROM fx_grid WHERE ky BETWEEN 2 AND 4")
def f7_crop_kspace(fx):
    lines = fx("fx_grid").select("scan_id", "ky", "acq_idx", F.lit(0).alias("kz"), F.array("im", "re", "im").alias("re"), F.array("im").alias("im"))
    return kspace.crop_kspace(lines, (3, 7, 1), (1, 3, 1)).select("scan_id", "ky", "acq_idx", F.col("re")[0].alias("re"))


@query(
    """WITH c AS (SELECT scan_id, acq_idx, (k.x * 8 + ky) * 2 + kz AS cell FROM fx_read, generate_series(0, 7) AS k(x)), d AS (SELECT *, cell // 16 - 2 AS x, (cell // 2) % 8 - 2 AS y, cell % 2 AS z FROM c)
    SELECT scan_id, acq_idx, (x * 4 + y) * 2 + z AS cell FROM d WHERE x BETWEEN 0 AND 3 AND y BETWEEN 0 AND 3"""
)
def f8_crop_cells(fx):
    return kspace.crop_cells(sampling.sample_cells(fx("fx_read"), 8, 8, 2), (8, 8, 2), (4, 4, 2)).select("scan_id", "acq_idx", "cell")


@query("SELECT scan_id, CAST(greatest(1, round_even(n * 0.25, 0)) AS bigint) AS n_quarter, CAST(greatest(1, round_even(n * 0.5, 0)) AS bigint) AS n_half FROM (SELECT scan_id, count(*) AS n FROM fx_read GROUP BY scan_id)")
def f9_level_size(fx):
    n = fx("fx_read").groupBy("scan_id").agg(F.count("*").alias("n"))
    return n.select("scan_id", kspace.level_size("n", 0.25).alias("n_quarter"), kspace.level_size("n", 0.5).alias("n_half"))


@query(
    """SELECT scan_id, round(a * 8 / 200 * s, 6) + 0.0 AS tx_px, round(2 * a * 16 / 200 * s, 6) + 0.0 AS ty_px, round(a * 4 / 50 * s, 6) + 0.0 AS tz_px, round(a * 8 / 200, 6) + 0.0 AS cx_px, round(a * 16 / 200, 6) + 0.0 AS cy_px
    FROM (SELECT scan_id, max(amplitude) AS a, greatest(0.0, max(amplitude) - 0.5) AS s FROM fx_mev GROUP BY scan_id)"""
)
def f10_limits_px(fx):
    a = fx("fx_mev").groupBy("scan_id").agg(F.max("amplitude").alias("a"))
    params = a.select("scan_id", F.col("a").alias("tx_mm"), (2 * F.col("a")).alias("ty_mm"), F.col("a").alias("tz_mm"), F.col("a").alias("cx_mm"), F.col("a").alias("cy_mm"), (F.col("a") - 0.5).alias("scale"))
    sizes = a.select("scan_id", F.lit(8).alias("nx"), F.lit(16).alias("ny"), F.lit(4).alias("nz"), F.lit(200.0).alias("fov"), F.lit(50.0).alias("fov_z"))
    out = motion.limits_px(params, sizes)
    return out.select("scan_id", *(r6(c) for c in out.columns[1:]))


def xy(img: DataFrame) -> DataFrame:
    return img.withColumns({"x": F.floor(F.col("voxel") / 8), "y": F.pmod("voxel", F.lit(8))})


@query("SELECT scan_id, 7 - voxel // 8 AS x, voxel % 8 AS y, round(-im, 6) + 0.0 AS dx, round(-re, 6) + 0.0 AS dy FROM fx_img")
def f11_display_components(fx):
    out = motion.display_components(xy(fx("fx_img")).withColumnsRenamed({"re": "a0", "im": "a1"}), 8, flip=True)
    return out.select("scan_id", "x", "y", r6("dx"), r6("dy"))


@query(
    """WITH q AS (SELECT r.scan_id, r.acq_idx, r.t, l.t AS lt, l.y AS ly FROM fx_read r ASOF LEFT JOIN fx_sensor l ON r.scan_id = l.scan_id AND r.t > l.t), b AS (SELECT q.*, h.t AS ht, h.y AS hy FROM q ASOF LEFT JOIN fx_sensor h ON q.scan_id = h.scan_id AND q.t <= h.t)
    SELECT scan_id, acq_idx, round(CASE WHEN lt IS NULL THEN hy WHEN ht IS NULL OR ht = lt THEN ly ELSE ly + (hy - ly) * (t - lt) / (ht - lt) END, 6) + 0.0 AS motion FROM b"""
)
def j1_interp_asof(fx):
    return alignment.interp_asof(fx("fx_sensor").select("scan_id", "t", "y"), fx("fx_read").select("scan_id", "acq_idx", "t"), bucket_s=3600.0).select("scan_id", "acq_idx", r6("motion"))


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY scan_id, ky ORDER BY acq_idx DESC) AS r FROM fx_grid), g AS (SELECT DISTINCT scan_id, unnest(generate_series(0, 7)) AS ky FROM fx_grid) SELECT g.scan_id, g.ky, coalesce(re, 0.0) AS re, coalesce(im, 0.0) AS im FROM g LEFT JOIN k ON k.scan_id = g.scan_id AND k.ky = g.ky AND r = 1")
def j3_scatter_lines(fx):
    last = acquisition.scatter_lines(fx("fx_grid"), ("scan_id", "ky"))
    return acquisition.dense_grid(last, 8, ("re", "im"))


BINNED = "(SELECT scan_id, idx AS line_idx, idx % 4 AS state, idx % 2 AS nex, idx % 8 AS ky, idx % 3 % 2 AS kz, y FROM fx_sensor)"


def stated(fx) -> DataFrame:
    return fx("fx_sensor").select("scan_id", F.col("idx").alias("line_idx"), (F.col("idx") % 4).alias("state"), (F.col("idx") % 2).alias("nex"), (F.col("idx") % 8).alias("ky"), (F.col("idx") % 3 % 2).alias("kz"), "y")


@query(f"SELECT g.scan_id, g.nex, g.state, count(b.line_idx) AS n_lines FROM (SELECT DISTINCT scan_id, n.i AS nex, s.i AS state FROM fx_sensor, generate_series(0, 1) AS n(i), generate_series(0, 3) AS s(i)) g LEFT JOIN {BINNED} b ON b.scan_id = g.scan_id AND b.nex = g.nex AND b.state = g.state GROUP BY ALL")
def j4_state_groups(fx):
    return binning.state_groups(stated(fx), 2, 4)


@query(f"SELECT b.scan_id, b.line_idx, b.state, round(v.top, 6) + 0.0 AS top FROM {BINNED} b LEFT JOIN (SELECT scan_id, state, max(y) AS top FROM {BINNED} WHERE state > 0 GROUP BY ALL) v ON v.scan_id = b.scan_id AND v.state = b.state")
def j4_attach_states(fx):
    lines = stated(fx)
    states = lines.filter("state > 0").groupBy("scan_id", "state").agg(F.max("y").alias("top"))
    return binning.attach_states(lines, states).select("scan_id", "line_idx", "state", r6("top"))


@query("SELECT scan_id, t, round(sum(v), 6) + 0.0 AS value FROM (SELECT g.scan_id, g.t, CASE WHEN e.t0 IS NULL OR g.t < t0 THEN 0.0 WHEN g.t - t0 >= m THEN amplitude WHEN m = 1 THEN 0.0 ELSE amplitude * 0.5 * (1 - cos(pi() * (g.t - t0) / (m - 1))) END AS v FROM (SELECT DISTINCT scan_id, k.t FROM fx_mev, generate_series(0, 15) AS k(t)) g LEFT JOIN (SELECT *, least(4, 16 - t0) AS m FROM fx_mev) e ON e.scan_id = g.scan_id) GROUP BY scan_id, t")
def j5_motion_curves(fx):
    return curves(fx).select("scan_id", "t", r6("value"))


def curves(fx) -> DataFrame:
    lines = fx("fx_mev").select("scan_id").distinct().select("scan_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint"))).alias("t"))
    return motion.motion_curves(lines, fx("fx_mev").select("scan_id", "t0", "amplitude"), 4, 16)


@query("SELECT i.scan_id, i.voxel, round(i.re * m.re + i.im * m.im, 6) + 0.0 AS re, round(i.im * m.re - i.re * m.im, 6) + 0.0 AS im FROM fx_img i JOIN fx_img m ON m.scan_id = i.scan_id AND m.voxel = 63 - i.voxel")
def j6_apply_maps(fx):
    img = fx("fx_img").select("scan_id", "voxel", "re", "im")
    return kspace.apply_maps(img, img.withColumn("voxel", 63 - F.col("voxel")), conj=True).select("scan_id", "voxel", r6("re"), r6("im"))


@query(f"SELECT g.scan_id, g.nex, g.ky, g.kz, coalesce(max_by(b.state, b.line_idx), -1) AS state FROM (SELECT DISTINCT scan_id, nex, y.i AS ky, z.i AS kz FROM {BINNED}, generate_series(0, 7) AS y(i), generate_series(0, 1) AS z(i)) g LEFT JOIN {BINNED} b ON b.scan_id = g.scan_id AND b.nex = g.nex AND b.ky = g.ky AND b.kz = g.kz GROUP BY ALL")
def j7_coverage(fx):
    return sampling.coverage(stated(fx), 8, 2).fillna(-1, ["state"])


@query("SELECT scan_id, round(sqrt(max(re * re + im * im)), 6) AS max_scale, round(sqrt(avg(re * re + im * im)), 6) AS rms_scale FROM fx_img GROUP BY scan_id")
def a1_kspace_scale(fx):
    lines = fx("fx_img").groupBy("scan_id", F.floor(F.col("voxel") / 8).alias("ky")).agg(F.collect_list("re").alias("re"), F.collect_list("im").alias("im"))
    both = kspace.kspace_scale(lines, "max").withColumnRenamed("scale", "m").join(kspace.kspace_scale(lines, "rms"), "scan_id")
    return both.select("scan_id", r6("m", "max_scale"), r6("scale", "rms_scale"))


@query("SELECT scan_id, voxel AS kx, round(re / m, 6) + 0.0 AS re, round(im / m, 6) + 0.0 AS im FROM fx_img JOIN (SELECT scan_id, greatest(1e-12, sqrt(max(re * re + im * im))) AS m FROM fx_img GROUP BY scan_id) USING (scan_id)")
def a1_normalize_kspace(fx):
    lines = kspace.planes(images(fx), ["scan_id"], 64, 1).select("scan_id", "re", "im")
    return kspace.voxels(kspace.normalize_kspace(lines, "max"), ["scan_id"], "kx").select("scan_id", "kx", r6("re"), r6("im"))


@query("WITH g AS (SELECT s.scan_id, z.i AS z, count(r.acq_idx) AS n FROM (SELECT DISTINCT scan_id FROM fx_read) s CROSS JOIN generate_series(0, 2) AS z(i) LEFT JOIN fx_read r ON r.scan_id = s.scan_id AND r.slice = z.i GROUP BY ALL) SELECT scan_id, min(n) AS least, max(n) AS most FROM g GROUP BY scan_id HAVING min(n) <> max(n)")
def a2_quarantine(fx):
    return acquisition.quarantine(fx("fx_read").withColumnRenamed("slice", "z"), 3)


@query("SELECT scan_id, string_agg(CAST(nex AS varchar), ',' ORDER BY nex) AS nex_values FROM (SELECT DISTINCT scan_id, nex FROM fx_read) GROUP BY scan_id")
def a3_nex_values(fx):
    return acquisition.nex_values(fx("fx_read")).select("scan_id", F.array_join(F.col("nex_values").cast("array<string>"), ",").alias("nex_values"))


@query(f"WITH {META} SELECT scan_id, CAST(greatest(1, least(6, max_step1 + 1, max_step2 + 1)) AS bigint) AS width FROM meta")
def a4_calibration_width(fx):
    sizes = meta(fx("fx_read")).select("scan_id", (F.col("max_step1") + 1).alias("ny"), (F.col("max_step2") + 1).alias("nz"))
    return sizes.select("scan_id", kspace.calibration_width(6, "ny", "nz").cast("bigint").alias("width"))


@query("SELECT scan_id, voxel AS cell, round(re, 6) + 0.0 AS re FROM fx_img WHERE scan_id % 2 = 0")
def a4_calibration_simulated(fx):
    cells = fx("fx_img").select("scan_id", F.lit(0).alias("coil"), (F.col("scan_id") % 2).alias("nex"), F.col("voxel").alias("cell"), "re", "im")
    return kspace.calibration_kspace(cells, measured=False).select("scan_id", "cell", r6("re"))


@query("SELECT grp AS scan_id, voxel AS cell, round(avg(re), 6) + 0.0 AS re, round(avg(im), 6) + 0.0 AS im FROM fx_img GROUP BY grp, voxel")
def a4_calibration(fx):
    cells = fx("fx_img").select(F.col("grp").alias("scan_id"), F.lit(0).alias("coil"), F.col("scan_id").alias("nex"), F.col("voxel").alias("cell"), "re", "im")
    return kspace.calibration_kspace(cells, measured=True).select("scan_id", "cell", r6("re"), r6("im"))


@query("SELECT i.grp AS scan_id, i.voxel, round(sum(i.re * m.re + i.im * m.im), 6) + 0.0 AS re, round(sum(i.im * m.re - i.re * m.im), 6) + 0.0 AS im FROM fx_img i JOIN fx_img m ON m.scan_id = i.scan_id AND m.voxel = 63 - i.voxel GROUP BY ALL")
def a5_combine_coils(fx):
    img = fx("fx_img").select(F.col("grp").alias("scan_id"), F.col("scan_id").alias("coil"), "voxel", "re", "im")
    return kspace.combine_coils(img, img.withColumn("voxel", 63 - F.col("voxel"))).select("scan_id", "voxel", r6("re"), r6("im"))


def kmeans_sql(k: int, rounds: int, src: str = "fx_sensor", before: str = "", center: str = "round(c[label + 1], 6) + 0.0") -> str:
    """Unrolled Lloyd rounds over lists of centres of ``src(scan_id, idx, y)``."""
    pts = f"pts AS MATERIALIZED (SELECT scan_id, idx, y FROM {src} WHERE y IS NOT NULL AND scan_id IN (SELECT scan_id FROM {src} GROUP BY scan_id HAVING count(y) >= {k}))"
    rank = "ranked AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY md5(concat_ws('|', '0', scan_id, idx)), idx) AS r FROM pts)"
    state = f"s0 AS MATERIALIZED (SELECT scan_id, list(y ORDER BY r) FILTER (r <= {k}) AS c, coalesce(list(y ORDER BY r) FILTER (r > {k} AND r <= {2 * k}), []) AS spare FROM ranked GROUP BY scan_id)"
    parts = [pts, rank, state]
    for i in range(rounds):
        label = "list_position(list_transform(c, lambda v: abs(y - v)), list_min(list_transform(c, lambda v: abs(y - v)))) - 1"
        parts.append(f"l{i} AS MATERIALIZED (SELECT p.scan_id, p.idx, p.y, {label} AS label FROM pts p JOIN s{i} USING (scan_id))")
        parts.append(f"m{i} AS MATERIALIZED (SELECT scan_id, label, greatest(min(y), least(max(y), sum(y * n) / sum(n))) AS m FROM (SELECT scan_id, label, y, count(*) AS n FROM l{i} GROUP BY ALL) GROUP BY ALL)")
        again = f"CASE WHEN len(spare) > 0 THEN spare[{i} % len(spare) + 1] ELSE c[1] END"
        parts.append(f"s{i + 1} AS MATERIALIZED (SELECT s.scan_id, list(coalesce(m, {again}) ORDER BY j.i) AS c, any_value(spare) AS spare FROM s{i} s CROSS JOIN generate_series(0, {k - 1}) AS j(i) LEFT JOIN m{i} m ON m.scan_id = s.scan_id AND m.label = j.i GROUP BY s.scan_id)")
    last = rounds - 1
    return f"WITH {before}{', '.join(parts)} SELECT l.scan_id, l.idx AS line_idx, CAST(label AS bigint) AS label, {center} AS center FROM l{last} l JOIN s{rounds} USING (scan_id)"


@query(kmeans_sql(4, 20))
def a6_bin_motion(fx):
    points = fx("fx_sensor").select("scan_id", F.col("idx").alias("line_idx"), F.col("y").alias("motion"))
    return binning.bin_motion(points, 4).select("scan_id", "line_idx", "label", r6_scaled("center"))


def two_curves(fx) -> DataFrame:
    return curves(fx).select("scan_id", "t", F.col("value").alias("tx"), (F.col("value") * F.col("value") / 10 - F.col("t") / 8).alias("ty"))


CURVES = "(SELECT scan_id, t, sum(v) AS tx, sum(v) * sum(v) / 10 - t / 8 AS ty FROM (SELECT g.scan_id, g.t, CASE WHEN e.t0 IS NULL OR g.t < t0 THEN 0.0 WHEN g.t - t0 >= m THEN amplitude WHEN m = 1 THEN 0.0 ELSE amplitude * 0.5 * (1 - cos(pi() * (g.t - t0) / (m - 1))) END AS v FROM (SELECT DISTINCT scan_id, k.t FROM fx_mev, generate_series(0, 15) AS k(t)) g LEFT JOIN (SELECT *, least(4, 16 - t0) AS m FROM fx_mev) e ON e.scan_id = g.scan_id) GROUP BY scan_id, t)"


@query(
    f"""WITH c AS {CURVES}, m AS (SELECT scan_id, avg(tx) AS mx, avg(ty) AS my, 0.5 * atan2(2 * covar_pop(tx, ty), var_pop(tx) - var_pop(ty)) AS a FROM c GROUP BY scan_id),
    v AS (SELECT scan_id, mx, my, cos(a) AS vx, sin(a) AS vy, CASE WHEN round(abs(cos(a)), 9) >= round(abs(sin(a)), 9) THEN cos(a) ELSE sin(a) END AS lead FROM m),
    n AS (SELECT c.scan_id, c.t, ((tx - mx) * vx + (ty - my) * vy) * CASE WHEN lead < 0 THEN -1 ELSE 1 END AS p FROM c JOIN v USING (scan_id))
    SELECT scan_id, t, round(p / greatest(1e-12, max(abs(p)) OVER (PARTITION BY scan_id)), 6) + 0.0 AS navigator FROM n"""
)
def a7_navigator(fx):
    return motion.navigator(two_curves(fx), ("tx", "ty")).select("scan_id", "t", r6("navigator"))


def detrend_sql(src: str, row: str) -> str:
    return f"""b AS (SELECT scan_id, avg(y) AS m, stddev_pop(y) AS d, avg(t) AS t0, count(*) AS n FROM {src} GROUP BY scan_id),
  p AS (SELECT s.scan_id, s.{row}, s.y, s.t - b.t0 AS x, greatest(s.y, b.m - 2 * b.d) AS c FROM {src} s JOIN b USING (scan_id)),
  q AS (SELECT scan_id, CAST(count(*) AS double) AS n, sum(x) AS x1, sum(x*x) AS x2, sum(x*x*x) AS x3, sum(x*x*x*x) AS x4, sum(c) AS y0, sum(c*x) AS y1, sum(c*x*x) AS y2 FROM p GROUP BY scan_id),
  f AS (SELECT scan_id, n, x2, x4, n*(x2*x4-x3*x3)-x1*(x1*x4-x3*x2)+x2*(x1*x3-x2*x2) AS det, y0*(x2*x4-x3*x3)-x1*(y1*x4-x3*y2)+x2*(y1*x3-x2*y2) AS a, n*(y1*x4-y2*x3)-y0*(x1*x4-x3*x2)+x2*(x1*y2-y1*x2) AS b, n*(x2*y2-x3*y1)-x1*(x1*y2-x2*y1)+y0*(x1*x3-x2*x2) AS q, y0 FROM q)"""


DETRENDED = "p.y - CASE WHEN n < 3 OR abs(det) <= 1e-12*n*x2*x4 THEN y0/n ELSE a/det + b/det*x + q/det*x*x END"


@query(f"WITH {detrend_sql('fx_sensor', 'idx')} SELECT p.scan_id, p.idx, round({DETRENDED}, 4) + 0.0 AS detrended FROM p JOIN f USING (scan_id)")
def a8_detrend(fx):
    return signal.detrend_quadratic(fx("fx_sensor")).select("scan_id", "idx", (F.round("detrended", 4) + 0.0).alias("detrended"))


@query("SELECT scan_id, CAST(CASE WHEN coalesce(stddev_pop(y) FILTER (channel = 0), 0) > coalesce(stddev_pop(y) FILTER (channel = 1), 0) THEN 0 ELSE 1 END AS bigint) AS channel FROM fx_sensor GROUP BY scan_id")
def a9_pick_channel(fx):
    return signal.pick_channel(fx("fx_sensor")).select("scan_id", "channel")


def bands(fx) -> DataFrame:
    s = fx("fx_sensor")
    rank = F.row_number().over(alignment.Window.partitionBy("scan_id", "sensor_id", "channel").orderBy("idx")) - 1
    return s.select("scan_id", "sensor_id", "channel", F.col("idx").alias("event"), rank.alias("idx"), "t", (F.col("y") / 2).alias("low"), (F.col("y") % 7).alias("high"))


QUALITY = """b AS (SELECT scan_id, sensor_id, channel, row_number() OVER (PARTITION BY scan_id, sensor_id, channel ORDER BY idx) - 1 AS i, t, y / 2 AS low, y % 7 AS high FROM fx_sensor),
  w AS (SELECT scan_id, sensor_id, channel, count(*) AS n, avg(low) AS m, stddev_pop(high) AS d, max(t) - min(t) AS span FROM b GROUP BY ALL),
  j AS (SELECT b.*, n, m, d, b.i // CAST(greatest(1, CASE WHEN span > 0 THEN floor(100000 / span * n) ELSE n END) AS bigint) AS seg FROM b JOIN w USING (scan_id, sensor_id, channel)),
  s AS (SELECT scan_id, sensor_id, channel, seg, stddev_pop(high) AS sd, sum((low - m - high) * (low - m - high)) AS ss, any_value(n) AS n, any_value(d) AS d FROM j GROUP BY ALL),
  k AS (SELECT scan_id, sensor_id, channel, least(min(sd), any_value(d)) AS noise, sum(ss) AS ss, any_value(n) AS n FROM s GROUP BY ALL)"""


@query(f"WITH {QUALITY} SELECT scan_id, sensor_id, channel, round(noise, 6) + 0.0 AS noise, round(CASE WHEN noise > 1e-9 THEN sqrt(ss) / n / noise END, 6) + 0.0 AS score FROM k")
def a10_channel_quality(fx):
    out = signal.channel_quality(bands(fx), seconds=100000.0)
    return out.select("scan_id", "sensor_id", "channel", r6("noise"), r6(F.when(F.col("noise") > 1e-9, F.col("score")), "score"))


@query(
    """WITH d AS (SELECT scan_id, sensor_id, channel, stddev_pop(y) AS dev, CASE WHEN (sensor_id + channel) % 2 = 0 THEN stddev_pop(y) ELSE 0.0 END AS s FROM fx_sensor GROUP BY scan_id, sensor_id, channel),
    c AS (SELECT *, row_number() OVER (PARTITION BY scan_id, sensor_id ORDER BY s DESC, channel) AS r FROM d), b AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY s DESC, sensor_id) AS q FROM c WHERE r = 1)
    SELECT f.scan_id, f.idx, f.sensor_id, f.channel, round(f.y / nullif(b.dev, 0), 6) + 0.0 AS y FROM fx_sensor f JOIN b ON q = 1 AND f.scan_id = b.scan_id AND f.sensor_id = b.sensor_id AND f.channel = b.channel"""
)
def a11_best_stream(fx):
    s = fx("fx_sensor").select("scan_id", "sensor_id", "channel", "idx", "y")
    quality = s.select("scan_id", "sensor_id", "channel").distinct().withColumn("kept", (F.col("sensor_id") + F.col("channel")) % 2 == 0)
    return signal.best_stream(s, quality).select("scan_id", "idx", "sensor_id", "channel", r6("y"))


@query("SELECT a.scan_id, round(sqrt(sum((a.re - b.re) ** 2 + (a.im - b.im) ** 2)) / (sqrt(sum(b.re ** 2 + b.im ** 2)) + 1e-12), 6) AS error FROM fx_img a JOIN fx_img b ON b.scan_id = a.scan_id AND b.voxel = 63 - a.voxel GROUP BY a.scan_id")
def a12_relative_error(fx):
    img = fx("fx_img").select("scan_id", "voxel", "re", "im")
    return kspace.relative_error(img, img.withColumn("voxel", 63 - F.col("voxel")), ["voxel"]).select("scan_id", r6("error"))


@query("SELECT scan_id, round(lo - e, 6) + 0.0 AS lo, round(hi + e, 6) + 0.0 AS hi FROM (SELECT *, CASE WHEN abs(hi - lo) < 1e-12 THEN 0.1 * greatest(abs(hi), 1.0) ELSE 0.05 * (hi - lo) END AS e FROM (SELECT scan_id, min(least(amplitude, degrees(amplitude / 50))) AS lo, max(greatest(amplitude, degrees(amplitude / 50))) AS hi FROM fx_mev GROUP BY scan_id))")
def a13_curve_limits(fx):
    c = fx("fx_mev").withColumn("phi", F.col("amplitude") / 50)
    return motion.curve_limits(c, ("amplitude",), ("phi",)).select("scan_id", r6("lo"), r6("hi"))


@query("WITH w AS (SELECT scan_id, quantile_cont(re, 0.02) AS lo, quantile_cont(re, 0.98) AS hi FROM fx_img GROUP BY scan_id) SELECT scan_id, voxel, round(CASE WHEN hi > lo THEN greatest(0.0, least(1.0, (re - lo) / (hi - lo))) ELSE 0.0 END, 6) + 0.0 AS scaled FROM fx_img JOIN w USING (scan_id)")
def a14_robust_window(fx):
    return kspace.robust_window(fx("fx_img").withColumn("v", F.col("re"))).select("scan_id", "voxel", r6("scaled"))


@query("SELECT label AS scan_id, CAST(count(*) AS bigint) AS n, round(quantile_cont(v, 0.02), 6) + 0.0 AS lo, round(quantile_cont(v, 0.5), 6) + 0.0 AS middle, round(quantile_cont(v, 0.98), 6) + 0.0 AS hi FROM (SELECT label, unnest(list_transform(embedding, lambda x: floor(CAST(x AS double) * 64))) AS v FROM embeddings WHERE label IS NOT NULL) GROUP BY label")
def a14_group_percentiles(fx):
    """Percentiles of a few groups that hold all voxels, most of them equal to others."""
    v = fx("fx_img").filter("grp is not null").select(F.col("grp").alias("scan_id"), F.floor(F.col("re") * 64).cast("double").alias("v"))
    out = kspace.percentiles(v, (0.02, 0.5, 0.98))
    return out.select("scan_id", "n", *(r6(F.col("q")[i], name) for i, name in enumerate(("lo", "middle", "hi"))))


@query("SELECT scan_id, round(greatest(1e-12, max(abs(re))), 6) AS max_x, round(greatest(1e-12, max(abs(im))), 6) AS max_y, round(greatest(1e-12, max(sqrt(re * re + im * im))), 6) AS max_amplitude FROM fx_img GROUP BY scan_id")
def a15_displacement_summary(fx):
    return motion.displacement_summary(fx("fx_img").withColumnsRenamed({"re": "dx", "im": "dy"})).select("scan_id", r6("max_x"), r6("max_y"), r6("max_amplitude"))


LOG = "(SELECT scan_id, idx % 2 AS level, row_number() OVER (PARTITION BY scan_id, idx % 2 ORDER BY idx) - 1 AS gn_iter, y AS relres FROM fx_sensor)"


def log_rows(fx) -> DataFrame:
    w = alignment.Window.partitionBy("scan_id", "level").orderBy("idx")
    return fx("fx_sensor").withColumn("level", F.col("idx") % 2).select("scan_id", "level", (F.row_number().over(w) - 1).cast("bigint").alias("gn_iter"), F.col("y").alias("relres"))


@query(f"SELECT scan_id, level, string_agg(CAST(CAST(round(relres * 100) AS bigint) AS varchar), ',' ORDER BY gn_iter) AS curve, round(max(max(relres)) OVER (PARTITION BY scan_id), 6) AS top FROM {LOG} GROUP BY scan_id, level")
def a16_residual_curves(fx):
    curve = F.array_join(F.transform("relres", lambda v: F.round(v * 100).cast("bigint").cast("string")), ",")
    return motion.residual_curves(log_rows(fx)).select("scan_id", "level", curve.alias("curve"), r6("top"))


@query(f"WITH m AS (SELECT *, relres > min(relres) OVER (PARTITION BY scan_id, level ORDER BY gn_iter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS worse FROM {LOG}), s AS (SELECT *, coalesce(sum(CASE WHEN worse THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id, level ORDER BY gn_iter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM m) SELECT scan_id, level, arg_min(gn_iter, {{'a': relres, 'b': -gn_iter}}) AS best_iter, min(relres) AS best_relres, max(gn_iter) AS last_iter FROM s WHERE stopped = 0 GROUP BY scan_id, level")
def t2_best_iterate(fx):
    return motion.best_iterate(log_rows(fx))


@query("SELECT scan_id, acq_idx, row_number() OVER (PARTITION BY scan_id, slice ORDER BY acq_idx) - 1 AS line_idx FROM fx_read")
def w1_line_index(fx):
    return acquisition.line_index(fx("fx_read").withColumnRenamed("slice", "z")).select("scan_id", "acq_idx", "line_idx")


@query("WITH p AS (SELECT scan_id, acq_idx, round(re / 25) AS a FROM fx_read), c AS (SELECT *, CASE WHEN lag(a) OVER w IS NOT NULL AND lag(a) OVER w <> a THEN 1 ELSE 0 END AS n FROM p WINDOW w AS (PARTITION BY scan_id ORDER BY acq_idx)), s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY scan_id ORDER BY acq_idx) AS bigint) AS state FROM c) SELECT scan_id, state, min(a) AS a, count(*) AS n_readouts FROM s GROUP BY scan_id, state")
def w2_compress_states(fx):
    c = fx("fx_read").select("scan_id", "acq_idx", F.round(F.col("re") / 25).alias("a"))
    return motion.state_values(motion.compress_states(c, ("a",), "acq_idx"), ("a",), "acq_idx")


@query("WITH n AS (SELECT scan_id, nex, count(DISTINCT slice) AS n FROM fx_read GROUP BY ALL), b AS (SELECT scan_id, nex, coalesce(sum(n) OVER (PARTITION BY scan_id ORDER BY nex ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n) SELECT r.scan_id, acq_idx, CAST(before + dense_rank() OVER (PARTITION BY r.scan_id, r.nex ORDER BY slice) - 1 AS bigint) AS global_shot FROM fx_read r JOIN b USING (scan_id, nex)")
def w3_global_shots(fx):
    return sampling.global_shots(fx("fx_read").withColumnRenamed("slice", "shot")).select("scan_id", "acq_idx", F.col("global_shot").cast("bigint").alias("global_shot"))


@query(
    """WITH i AS (SELECT scan_id, voxel, voxel // 8 AS x, voxel % 8 AS y, re FROM fx_img), w AS (SELECT *, lag(re) OVER (PARTITION BY scan_id, y ORDER BY x) AS xa, lead(re) OVER (PARTITION BY scan_id, y ORDER BY x) AS xb, lag(re) OVER (PARTITION BY scan_id, x ORDER BY y) AS ya, lead(re) OVER (PARTITION BY scan_id, x ORDER BY y) AS yb FROM i)
    SELECT scan_id, voxel, round(CASE WHEN x = 0 THEN xb - re WHEN x = 7 THEN re - xa ELSE (xb - xa) / 2 END, 6) + 0.0 AS gx_re, round(CASE WHEN y = 0 THEN yb - re WHEN y = 7 THEN re - ya ELSE (yb - ya) / 2 END, 6) + 0.0 AS gy_re FROM w"""
)
def w4_gradient(fx):
    return motion.gradient(xy(fx("fx_img")), (8, 8), ["scan_id"]).select("scan_id", "voxel", r6("gx_re"), r6("gy_re"))


def zero_phase_sql(cutoff: float, low: bool, src: str = "fx_sensor", keys: str = "scan_id, sensor_id, channel") -> str:
    """The filter over lists: each step of a reduction appends an output to those before it, from the output at rest on."""

    def sweep(x: str) -> str:
        steps = f"list_transform(range(1, len({x}) + 1), lambda i: [b0 * {x}[i] + b1 * {x}[greatest(i - 1, 1)]])"
        return f"list_reduce(list_concat([[{x}[1] * (b0 + b1) / (1 + a)]], {steps}), lambda o, u: list_append(o, u[1] - a * o[len(o)]))[2:]"

    k = f"tan(pi() * {cutoff} * span / n)"
    b0, b1 = (f"{k} / (1 + {k})",) * 2 if low else (f"1 / (1 + {k})", f"-1 / (1 + {k})")
    return f"""WITH c AS (SELECT {keys}, list(t ORDER BY t, y) AS ts, list(y ORDER BY t, y) AS ys, count(*) AS n, max(t) - min(t) AS span FROM {src} GROUP BY ALL),
    e AS (SELECT *, least(6, n - 1) AS pad, {b0} AS b0, {b1} AS b1, ({k} - 1) / ({k} + 1) AS a FROM c WHERE n > 1 AND span > 0 AND n / span > 2 * {cutoff}),
    p AS (SELECT *, list_concat(list_transform(range(pad, 0, -1), lambda i: 2 * ys[1] - ys[i + 1]), ys, list_transform(range(1, pad + 1), lambda i: 2 * ys[n] - ys[n - i])) AS x FROM e),
    f AS (SELECT *, list_reverse({sweep("x")}) AS r FROM p), b AS (SELECT *, list_reverse({sweep("r")})[pad + 1 : pad + n] AS z FROM f),
    o AS (SELECT {keys}, unnest(ts) AS t, unnest(z) AS filtered FROM b UNION ALL
        SELECT {keys}, unnest(ts), unnest(CASE WHEN n < 2 AND NOT {low} THEN [0.0] ELSE ys END) FROM c WHERE NOT coalesce(n > 1 AND span > 0 AND n / span > 2 * {cutoff}, false))
    SELECT {keys}, t, round(filtered, 6) + 0.0 AS filtered FROM o"""


def filtered_channels(fx: Fx, kind: str) -> DataFrame:
    out = signal.zero_phase(fx("fx_sensor"), 2e-7, kind)
    return out.select("scan_id", "sensor_id", "channel", "t", r6("filtered"))


@query(zero_phase_sql(2e-7, True))
def w5_zero_phase(fx):
    return filtered_channels(fx, "low")


@query(zero_phase_sql(2e-7, False))
def w5_zero_phase_high(fx):
    return filtered_channels(fx, "high")


@query(
    """WITH i AS (SELECT scan_id, voxel, voxel // 8 AS x, voxel % 8 AS y, re FROM fx_img)
    SELECT scan_id, voxel, round(coalesce(re - lag(re) OVER (PARTITION BY scan_id, y ORDER BY x), 0) + coalesce(re - lead(re) OVER (PARTITION BY scan_id, y ORDER BY x), 0) + coalesce(re - lag(re) OVER (PARTITION BY scan_id, x ORDER BY y), 0) + coalesce(re - lead(re) OVER (PARTITION BY scan_id, x ORDER BY y), 0), 6) + 0.0 AS smooth FROM i"""
)
def w6_smoothness(fx):
    return motion.smoothness(xy(fx("fx_img")), (8, 8), ["scan_id"], "re").select("scan_id", "voxel", r6("smooth"))


@query("WITH l AS (SELECT scan_id, ky, kz, max(acq_idx) AS a FROM fx_read GROUP BY ALL) SELECT scan_id, ky, kz, round((row_number() OVER (PARTITION BY scan_id ORDER BY a) - 1) / greatest(1, count(*) OVER (PARTITION BY scan_id) - 1), 6) AS order_rank FROM l")
def w7_order_map(fx):
    return sampling.order_map(fx("fx_read")).select("scan_id", "ky", "kz", r6("order", "order_rank"))


@query("WITH d AS (SELECT scan_id, sensor_id, channel, round(stddev_pop(y), 6) AS s FROM fx_sensor GROUP BY ALL) SELECT scan_id, sensor_id, arg_max(channel, {'a': s, 'b': -channel}) AS channel, max(s) AS s FROM d GROUP BY scan_id, sensor_id")
def t1_argmax(fx):
    d = fx("fx_sensor").groupBy("scan_id", "sensor_id", "channel").agg(F.round(F.stddev_pop("y"), 6).alias("s"))
    return signal.argmax_by(d, ["scan_id", "sensor_id"], "channel", "s")


def plan_meta(fx, nz: int) -> DataFrame:
    """19 lines of ky for every scan, which four shots don't divide."""
    b = lambda v: F.lit(v).cast("bigint")
    return fx("fx_read").select("scan_id").distinct().select("scan_id", b(2).alias("n_nex"), b(19).alias("ny"), b(nz).alias("nz"))


LINES = "(SELECT DISTINCT scan_id, n.i AS nex, y.i AS ky, z.i AS kz FROM fx_read, generate_series(0, 1) AS n(i), generate_series(0, 18) AS y(i), generate_series(0, 0) AS z(i))"


@query(f"SELECT scan_id, nex, ky, row_number() OVER (PARTITION BY scan_id, nex ORDER BY md5(concat_ws('|', '3', scan_id, nex, ky, kz)), ky) - 1 AS pos FROM {LINES}")
def t3_permute(fx):
    return sampling.permute(sampling.lines(plan_meta(fx, 1)), 3).select("scan_id", "nex", "ky", "pos")


@query("SELECT scan_id, acq_idx, nex FROM fx_read")
def t4_concat_nex(fx):
    r = fx("fx_read").select("scan_id", "acq_idx", "nex")
    return sampling.concat_nex([r.filter(F.col("nex") == k).drop("nex") for k in (0, 1)])


@query("WITH g AS (SELECT grp AS image_id, scan_id, voxel, 0.2989 * abs(re) + 0.5870 * abs(im) + 0.1140 * re * re AS v FROM fx_img), s AS (SELECT scan_id, min(v) AS lo, max(v) AS hi FROM g GROUP BY scan_id) SELECT g.scan_id AS image_id, voxel, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE v - lo END, 6) + 0.0 AS v FROM g JOIN s USING (scan_id)")
def s5_ingest_images(fx):
    px = fx("fx_img").select(F.col("scan_id").alias("image_id"), "voxel", F.abs("re").alias("r"), F.abs("im").alias("g"), (F.col("re") * F.col("re")).alias("b"))
    return tables.ingest_images(px).select("image_id", "voxel", r6("v"))


@query("SELECT grp AS scan_id, voxel, round(avg(re) * 3, 6) + 0.0 AS re, round(avg(im) * 3, 6) + 0.0 AS im FROM fx_img GROUP BY grp, voxel")
def s6_mean_image(fx):
    img = fx("fx_img").select(F.col("grp").alias("scan_id"), "voxel", "re", "im")
    scale = img.select("scan_id").distinct().withColumn("scale", F.lit(3.0))
    return tables.mean_over_nex(img, scale).select("scan_id", "voxel", r6("re"), r6("im"))


@query("SELECT scan_id, acq_idx, slice AS z FROM fx_read WHERE slice = 1")
def s7_select_slice(fx):
    return acquisition.select_slice(fx("fx_read").withColumnRenamed("slice", "z"), 1).select("scan_id", "acq_idx", "z")


@query("SELECT scan_id, sensor_id, channel, idx, y FROM fx_sensor s WHERE EXISTS (SELECT 1 FROM fx_sensor f WHERE f.scan_id = s.scan_id AND f.sensor_id = s.sensor_id AND f.y IS NOT NULL)")
def s4_drop_empty_sensors(fx):
    return tables.drop_empty_sensors(fx("fx_sensor"), "y").select("scan_id", "sensor_id", "channel", "idx", "y")


def acquisitions(fx) -> DataFrame:
    r = fx("fx_read")
    return r.select("scan_id", "acq_idx", F.col("coil").cast("int"), "flags", F.col("ky").cast("int"), F.col("kz").cast("int"), F.col("nex").cast("int").alias("repetition"), F.col("slice").cast("int"), "acq_ts", F.array("re", "im").alias("re"), F.array("im", "re").alias("im"))


@query("SELECT scan_id, acq_idx, flags, CAST(ky AS int) AS ky, acq_ts, re AS first_re FROM fx_read")
def s1_acquisitions_round_trip(fx):
    df = acquisitions(fx)
    path = tables.shared_path(df.sparkSession)
    df.write.parquet(path)
    return tables.read_acquisitions(df.sparkSession, path).select("scan_id", "acq_idx", "flags", "ky", "acq_ts", F.col("re")[0].alias("first_re"))


@query("SELECT scan_id, slice AS z, row_number() OVER (PARTITION BY scan_id, slice ORDER BY acq_idx) - 1 AS line_idx, ky, kz, nex, round(re, 6) + 0.0 AS motion FROM fx_read")
def s3_bundle_round_trip(fx):
    r = acquisition.line_index(fx("fx_read").withColumnsRenamed({"slice": "z", "re": "motion"}))
    path = tables.shared_path(r.sparkSession)
    tables.write_bundle(r.select("scan_id", "ky", "kz", "nex"), r, path)
    bundle = r.sparkSession.read.parquet(f"{path}/bundle")
    out = tables.bundle_rows(bundle)
    return out.select("scan_id", "z", F.col("line_idx").cast("bigint").alias("line_idx"), "ky", "kz", "nex", r6("motion"))


def images(fx) -> DataFrame:
    return fx("fx_img").select("scan_id", "grp", "voxel", "re", "im")


def dft_sql(value_re: str, value_im: str, sign: int, n: int = 8) -> str:
    """Centred orthonormal transform of 8 by 8 voxels by joining twiddle factors."""
    phase = f"2 * pi() * ((k.u - {n // 2}) * (voxel // {n} - {n // 2}) + (k.v - {n // 2}) * (voxel % {n} - {n // 2})) / {n}"
    return f"SELECT scan_id, k.u * {n} + k.v AS voxel, sum({value_re} * cos({phase}) - {sign} * {value_im} * sin({phase})) / {n} AS re, sum({sign} * {value_re} * sin({phase}) + {value_im} * cos({phase})) / {n} AS im FROM fx_img, (SELECT u.i AS u, v.i AS v FROM generate_series(0, {n - 1}) AS u(i), generate_series(0, {n - 1}) AS v(i)) k GROUP BY ALL"


@query(f"SELECT scan_id, voxel, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM ({dft_sql('re', 'im', -1)})")
def i1_fft_centred(fx):
    planes = kspace.planes(images(fx), ["scan_id"], 8, 8)
    out = kspace.voxels(kspace.fftc(planes), ["scan_id"])
    return out.select("scan_id", "voxel", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))


def line_dft(src: str, n: int, sign: int, shift: int = 0) -> str:
    p = f"2 * pi() * (k.u - {n // 2}) * (i - {shift} - {n // 2}) / {n}"
    return f"SELECT scan_id, k.u AS i, sum(re * cos({p}) - {sign} * im * sin({p})) / sqrt({n}) AS re, sum({sign} * re * sin({p}) + im * cos({p})) / sqrt({n}) AS im FROM {src}, generate_series(0, {n - 1}) AS k(u) GROUP BY ALL"


@query(
    f"WITH l AS (SELECT scan_id, voxel AS i, re, im FROM fx_img), a AS ({line_dft('l', 64, 1)}), m AS (SELECT * FROM a WHERE i BETWEEN 16 AND 47), b AS ({line_dft('m', 32, -1, 16)}) SELECT scan_id, i AS kx, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM b"
)
def i2_remove_oversampling(fx):
    lines = kspace.planes(images(fx), ["scan_id"], 64, 1).select("scan_id", "re", "im")
    out = kspace.voxels(kspace.remove_oversampling(lines), ["scan_id"], "kx")
    return out.select("scan_id", "kx", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))


STATES = "(SELECT scan_id, k.s AS state, max(amplitude) * (k.s + 1) / 2 AS tx, max(amplitude) * (1 - k.s) AS ty, max(amplitude) * (k.s + 1) / 20 AS phi FROM fx_mev, generate_series(0, 1) AS k(s) GROUP BY scan_id, k.s)"


def rigid_states(fx) -> DataFrame:
    a = fx("fx_mev").groupBy("scan_id").agg(F.max("amplitude").alias("a")).select("scan_id", "a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("state"))
    s = F.col("state")
    return a.select("scan_id", "state", (F.col("a") * (s + 1) / 2).alias("tx"), (F.col("a") * (1 - s)).alias("ty"), (F.col("a") * (s + 1) / 20).alias("phi"))


FIELD2 = f"(SELECT scan_id, state, v.i AS voxel, v.i // 8 AS x, v.i % 8 AS y, phi, cos(phi) * (v.i // 8 - 4) - sin(phi) * (v.i % 8 - 4) - (v.i // 8 - 4) + tx AS ux, sin(phi) * (v.i // 8 - 4) + cos(phi) * (v.i % 8 - 4) - (v.i % 8 - 4) + ty AS uy FROM {STATES}, generate_series(0, 63) AS v(i))"


@query(f"SELECT scan_id, state, voxel, round(ux, 6) + 0.0 AS ux, round(uy, 6) + 0.0 AS uy FROM {FIELD2}")
def i3_rigid_field_2d(fx):
    return motion.rigid_field_2d(rigid_states(fx), 8, 8).select("scan_id", "state", "voxel", r6("ux"), r6("uy"))


@query(
    f"""WITH s AS (SELECT scan_id, state, tx, ty, tx / 2 AS tz, phi AS rx, phi / 2 AS ry, -phi AS rz, v.i AS voxel, v.i // 8 - 2 AS x, v.i // 2 % 4 - 2 AS y, v.i % 2 - 1 AS z FROM {STATES}, generate_series(0, 31) AS v(i)),
    a AS (SELECT *, y * cos(rx) - z * sin(rx) AS y1, y * sin(rx) + z * cos(rx) AS z1 FROM s), b AS (SELECT *, x * cos(ry) + z1 * sin(ry) AS x2, -x * sin(ry) + z1 * cos(ry) AS z2 FROM a)
    SELECT scan_id, state, voxel, round(x2 * cos(rz) - y1 * sin(rz) - x + tx, 6) + 0.0 AS ux, round(x2 * sin(rz) + y1 * cos(rz) - y + ty, 6) + 0.0 AS uy, round(z2 - z + tz, 6) + 0.0 AS uz FROM b"""
)
def i4_rigid_field_3d(fx):
    s = rigid_states(fx).withColumns({"tz": F.col("tx") / 2, "rx": F.col("phi"), "ry": F.col("phi") / 2, "rz": -F.col("phi")})
    return motion.rigid_field_3d(s, 4, 4, 2).select("scan_id", "state", "voxel", r6("ux"), r6("uy"), r6("uz"))


@query("SELECT scan_id, k.s AS state, voxel, round(re * (k.s + 1) / 3, 6) + 0.0 AS ux, round(im * (k.s + 1) / 3, 6) + 0.0 AS uy FROM fx_img, generate_series(0, 2) AS k(s)")
def i5_nonrigid_field(fx):
    maps = images(fx).select("scan_id", "voxel", F.col("re").alias("a0"), F.col("im").alias("a1"))
    states = maps.select("scan_id").distinct().select("scan_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("state")).withColumn("signal", (F.col("state") + 1) / 3)
    return motion.nonrigid_field(maps, states).select("scan_id", "state", "voxel", r6("ux"), r6("uy"))


@query("SELECT scan_id, k.s AS state, voxel, round(re * (k.s + 1), 6) + 0.0 AS ux, round(im * (k.s + 1), 6) + 0.0 AS uy, round((re - im) * (k.s + 1), 6) + 0.0 AS uz FROM fx_img, generate_series(0, 1) AS k(s)")
def i5_nonrigid_field_3d(fx):
    maps = images(fx).select("scan_id", "voxel", F.col("re").alias("a0"), F.col("im").alias("a1"), (F.col("re") - F.col("im")).alias("a2"))
    states = maps.select("scan_id").distinct().select("scan_id", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("state")).withColumn("signal", F.col("state") + 1.0)
    return motion.nonrigid_field(maps, states).select("scan_id", "state", "voxel", r6("ux"), r6("uy"), r6("uz"))


STENCIL2 = f"""st AS (SELECT scan_id, state, voxel, (lx - 1 + a.i) * 8 + ly - 1 + b.i AS src, (CASE WHEN a.i = 1 THEN px - lx ELSE 1 - px + lx END) * (CASE WHEN b.i = 1 THEN py - ly ELSE 1 - py + ly END) AS w
  FROM (SELECT *, greatest(1, least(7, floor(px))) AS lx, greatest(1, least(7, floor(py))) AS ly FROM (SELECT scan_id, state, voxel, greatest(1.0, least(8.0, x + 1 + ux)) AS px, greatest(1.0, least(8.0, y + 1 + uy)) AS py FROM {FIELD2})), generate_series(0, 1) AS a(i), generate_series(0, 1) AS b(i))"""


def stencil_2d(fx) -> DataFrame:
    return motion.stencil(motion.rigid_field_2d(rigid_states(fx), 8, 8), (8, 8))


@query(f"WITH {STENCIL2} SELECT scan_id, state, voxel AS out_voxel, round(sum(w), 6) AS total, round(sum(w * src), 4) AS place FROM st GROUP BY ALL")
def i6_stencil_2d(fx):
    s = stencil_2d(fx).groupBy("scan_id", "state", "out_voxel").agg(F.sum("w").alias("total"), F.sum(F.col("w") * F.col("src_voxel")).alias("place"))
    return s.select("scan_id", "state", "out_voxel", r6("total"), F.round("place", 4).alias("place"))


@query(f"SELECT scan_id, state, voxel AS out_voxel, 1.0 AS total, round(greatest(0.0, least(3.0, x + tx)) * 8 + greatest(0.0, least(3.0, y + ty)) * 2 + greatest(0.0, least(1.0, z + tx / 2)), 6) AS place FROM (SELECT *, v.i AS voxel, v.i // 8 AS x, v.i // 2 % 4 AS y, v.i % 2 AS z FROM {STATES}, generate_series(0, 31) AS v(i))")
def i7_stencil_3d(fx):
    zero = F.lit(0.0)
    s = rigid_states(fx).withColumns({"tz": F.col("tx") / 2, "rx": zero, "ry": zero, "rz": zero})
    st = motion.stencil(motion.rigid_field_3d(s, 4, 4, 2), (4, 4, 2)).groupBy("scan_id", "state", "out_voxel").agg(F.sum("w").alias("total"), F.sum(F.col("w") * F.col("src_voxel")).alias("place"))
    return st.select("scan_id", "state", "out_voxel", r6("total"), r6("place"))


@query(f"WITH {STENCIL2} SELECT st.scan_id, state, st.voxel, round(sum(w * i.re), 5) + 0.0 AS re, round(sum(w * i.im), 5) + 0.0 AS im FROM st JOIN fx_img i ON i.scan_id = st.scan_id AND i.voxel = st.src GROUP BY ALL")
def i8_warp(fx):
    out = motion.warp(images(fx).select("scan_id", "voxel", "re", "im"), stencil_2d(fx))
    return out.select("scan_id", "state", "voxel", (F.round("re", 5) + 0.0).alias("re"), (F.round("im", 5) + 0.0).alias("im"))


@query(f"WITH {STENCIL2} SELECT st.scan_id, state, CAST(st.src AS bigint) AS voxel, round(sum(w * i.re), 5) + 0.0 AS re FROM st JOIN fx_img i ON i.scan_id = st.scan_id AND i.voxel = st.voxel GROUP BY ALL")
def i8_warp_adjoint(fx):
    out = motion.warp(images(fx).select("scan_id", "voxel", "re", "im"), stencil_2d(fx), adjoint=True)
    return out.select("scan_id", "state", "voxel", (F.round("re", 5) + 0.0).alias("re"))


@query(
    f"SELECT scan_id, state, round(sum(ux), 4) + 0.0 AS tx, round(sum(uy), 4) + 0.0 AS ty, round(sum(ux * (-(x - 4) * sin(phi) - (y - 4) * cos(phi)) + uy * ((x - 4) * cos(phi) - (y - 4) * sin(phi))), 4) + 0.0 AS phi FROM {FIELD2} GROUP BY scan_id, state"
)
def i14_jacobian_adjoint(fx):
    field = motion.rigid_field_2d(rigid_states(fx), 8, 8).select("scan_id", "state", "voxel", F.col("ux").alias("dux"), F.col("uy").alias("duy"))
    jac = motion.rigid_jacobian(rigid_states(fx), 8, 8).join(field, ["scan_id", "state", "voxel"])
    out = motion.apply_jacobian_adjoint(jac)
    return out.select("scan_id", "state", *((F.round(c, 4) + 0.0).alias(c) for c in ("tx", "ty", "phi")))


@query(f"SELECT scan_id, state, voxel, round(state + 1 + (-(x - 4) * sin(phi) - (y - 4) * cos(phi)) * phi, 6) + 0.0 AS dux, round(2 - state + ((x - 4) * cos(phi) - (y - 4) * sin(phi)) * phi, 6) + 0.0 AS duy FROM {FIELD2}")
def i14_apply_jacobian(fx):
    change = rigid_states(fx).select("scan_id", "state", (F.col("state") + 1.0).alias("dtx"), (2.0 - F.col("state")).alias("dty"), F.col("phi").alias("dphi"))
    return motion.apply_jacobian(motion.rigid_jacobian(rigid_states(fx), 8, 8), change).select("scan_id", "state", "voxel", r6("dux"), r6("duy"))


def axis_sql(n: int, m: int) -> str:
    at = f"greatest(0.0, (o + 0.5) * {n / m} - 0.5)"
    return f"SELECT o, CAST(least(floor({at}) + b.i, {n - 1}) AS bigint) AS i, CASE WHEN b.i = 1 THEN {at} - floor({at}) ELSE 1 - ({at} - floor({at})) END AS w FROM generate_series(0, {m - 1}) AS t(o), generate_series(0, 1) AS b(i)"


@query(f"WITH ax AS ({axis_sql(8, 4)}), ay AS ({axis_sql(8, 6)}) SELECT scan_id, ax.o * 6 + ay.o AS voxel, round(sum(ax.w * ay.w * re), 5) + 0.0 AS re FROM fx_img JOIN ax ON ax.i = voxel // 8 JOIN ay ON ay.i = voxel % 8 GROUP BY ALL")
def i15_resize(fx):
    out = kspace.resize(images(fx), (8, 8), (4, 6))
    return out.select("scan_id", "voxel", (F.round("re", 5) + 0.0).alias("re"))


@query(f"SELECT scan_id, state, round(tx * 2, 6) + 0.0 AS tx, round(ty * 1.5, 6) + 0.0 AS ty, round(phi, 6) + 0.0 AS phi FROM {STATES}")
def i16_upsample_motion(fx):
    return motion.upsample_motion(rigid_states(fx), {"tx": 2.0, "ty": 1.5}).select("scan_id", "state", r6("tx"), r6("ty"), r6("phi"))


@query(
    """WITH f AS (SELECT scan_id, voxel % 2 AS state, voxel // 2 AS k, re, im, sin(voxel) AS a, cos(2 * voxel) AS b FROM fx_img), n AS (SELECT scan_id, state, sum(re*re+im*im) + 0.1 AS a, sum(re*a+im*b) AS b, sum(re*b) AS c, sum(a*a+b*b) + 0.1 AS d, sum(a*b) AS e, sum(b*b) + 0.1 AS f, sum(re*k) AS p, sum(a*k) AS q, sum(b*k) AS r FROM f GROUP BY ALL),
    d AS (SELECT *, a*(d*f-e*e)-b*(b*f-e*c)+c*(b*e-d*c) AS det FROM n) SELECT scan_id, state, round((p*(d*f-e*e)-b*(q*f-e*r)+c*(q*e-d*r))/det, 4) + 0.0 AS d0, round((a*(q*f-e*r)-p*(b*f-e*c)+c*(b*r-q*c))/det, 4) + 0.0 AS d1, round((a*(d*r-q*e)-b*(b*r-q*c)+p*(b*e-d*c))/det, 4) + 0.0 AS d2 FROM d"""
)
def i20_rigid_motion_step(fx):
    v = F.col("voxel")
    f = images(fx).select("scan_id", (v % 2).alias("state"), F.col("re").alias("jt_re"), F.col("im").alias("jt_im"), F.sin(v).alias("ju_re"), F.cos(2 * v).alias("ju_im"), F.cos(2 * v).alias("jp_re"), F.lit(0.0).alias("jp_im"), F.floor(v / 2).cast("double").alias("r_re"), F.lit(0.0).alias("r_im"))
    out = motion.solve_normal_3(motion.rigid_normal_equations(f), 0.1)
    return out.select("scan_id", "state", *((F.round(c, 4) + 0.0).alias(c) for c in ("d0", "d1", "d2")))


#: A scan of two repetitions, its coils' maps, two states and the cells sampled in each, some of them in both.
SCANS = f"""img AS MATERIALIZED (SELECT scan_id // 2 AS scan_id, scan_id % 2 AS nex, voxel, re, im FROM fx_img),
  sm AS MATERIALIZED (SELECT scan_id, nex AS coil, 63 - voxel AS voxel, re + 1 AS re, im FROM img),
  sts AS (SELECT scan_id, k.s AS state, re * (k.s + 1) * 4 AS tx, 1.3 * (1 - k.s) AS ty, 0.1 * (k.s + 1) + re / 10 AS phi FROM img, generate_series(0, 1) AS k(s) WHERE nex = 0 AND voxel = 0),
  smp AS (SELECT scan_id, nex, k.s AS state, voxel AS cell FROM img, generate_series(0, 1) AS k(s) WHERE CASE WHEN k.s = 0 THEN (voxel + nex) % 3 <> 1 ELSE (voxel + nex) % 3 = 1 OR voxel % 5 = 0 END),
  own AS (SELECT scan_id, nex, cell, max(state) AS state FROM smp GROUP BY ALL),
  fld AS (SELECT scan_id, state, v.i AS voxel, v.i // 8 AS x, v.i % 8 AS y, phi, cos(phi) * (v.i // 8 - 4) - sin(phi) * (v.i % 8 - 4) - (v.i // 8 - 4) + tx AS ux, sin(phi) * (v.i // 8 - 4) + cos(phi) * (v.i % 8 - 4) - (v.i % 8 - 4) + ty AS uy FROM sts, generate_series(0, 63) AS v(i)),
  {STENCIL2.replace(FIELD2, "fld").replace("st AS (", "st AS MATERIALIZED (")},
  wrp AS MATERIALIZED (SELECT st.scan_id, nex, state, st.voxel, sum(w * re) AS re, sum(w * im) AS im FROM st JOIN img i ON i.scan_id = st.scan_id AND i.voxel = st.src GROUP BY ALL)"""


def twiddled(src: str, sign: int, keys: str) -> str:
    """The centred transform of 8 by 8 planes by joining twiddle factors."""
    phase = "2 * pi() * ((k.u - 4) * (voxel // 8 - 4) + (k.v - 4) * (voxel % 8 - 4)) / 8"
    return f"SELECT {keys}, k.u * 8 + k.v AS cell, sum(re * cos({phase}) - {sign} * im * sin({phase})) / 8 AS re, sum({sign} * re * sin({phase}) + im * cos({phase})) / 8 AS im FROM {src}, (SELECT u.i AS u, v.i AS v FROM generate_series(0, 7) AS u(i), generate_series(0, 7) AS v(i)) k GROUP BY ALL"


def measured_sql(src: str) -> str:
    coils = f"(SELECT w.scan_id, nex, state, coil, w.voxel, w.re * m.re - w.im * m.im AS re, w.re * m.im + w.im * m.re AS im FROM {src} w JOIN sm m ON m.scan_id = w.scan_id AND m.voxel = w.voxel)"
    return f"SELECT f.* FROM ({twiddled(coils, -1, 'scan_id, nex, state, coil')}) f SEMI JOIN own o ON o.scan_id = f.scan_id AND o.nex = f.nex AND o.state = f.state AND o.cell = f.cell"


def spread_sql(values: str) -> str:
    cells = f"(SELECT v.scan_id, v.nex, s.state, v.coil, v.cell AS voxel, v.re, v.im FROM {values} v JOIN smp s ON s.scan_id = v.scan_id AND s.nex = v.nex AND s.cell = v.cell)"
    return f"SELECT f.scan_id, nex, state, f.cell AS voxel, sum(f.re * m.re + f.im * m.im) AS re, sum(f.im * m.re - f.re * m.im) AS im FROM ({twiddled(cells, 1, 'scan_id, nex, state, coil')}) f JOIN sm m ON m.scan_id = f.scan_id AND m.coil = f.coil AND m.voxel = f.cell GROUP BY ALL"


def scan_images(fx) -> DataFrame:
    i = fx("fx_img")
    return i.select(F.expr("scan_id div 2").alias("scan_id"), (i["scan_id"] % 2).alias("nex"), "voxel", "re", "im")


def scan_states(fx) -> DataFrame:
    first = scan_images(fx).filter("nex = 0 AND voxel = 0").select("scan_id", "re", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("state"))
    s, first = F.col("state"), encoding.by_scan(first)
    return first.select("scan_id", "state", (F.col("re") * (s + 1) * 4).alias("tx"), (1.3 * (1 - s)).alias("ty"), (0.1 * (s + 1) + F.col("re") / 10).alias("phi"))


def scan_encoding(fx, overlap: bool = True) -> encoding.Encoding:
    img = scan_images(fx)
    place = img.select("scan_id", "nex", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("state"), F.col("voxel").alias("cell"))
    third = (F.col("cell") + F.col("nex")) % 3
    samples = place.filter(F.when(F.col("state") == 0, third != 1).otherwise((third == 1) | (F.col("cell") % 5 == 0)))
    grids = img.select("scan_id").distinct().select("scan_id", F.lit(8).alias("nx"), F.lit(8).alias("ny"), F.lit(1).alias("nz"))
    smaps = img.select("scan_id", F.col("nex").alias("coil"), (63 - F.col("voxel")).alias("voxel"), (F.col("re") + 1).alias("re"), "im")
    st = motion.stencil(motion.rigid_field_2d(scan_states(fx), 8, 8), (8, 8))
    return encoding.Encoding(grids, smaps, samples if overlap else encoding.owned(samples), st)


def r5(out: DataFrame, *values: str) -> list[Column]:
    return [(F.round(v, 5) + 0.0).alias(v) for v in values]


def values_of(img: DataFrame) -> DataFrame:
    """Measured values of two coils, made of image voxels."""
    each = img.withColumn("coil", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))))
    return each.select("scan_id", "coil", "nex", F.col("voxel").alias("cell"), (F.col("re") * (F.col("coil") + 1)).alias("re"), (F.col("im") - F.col("coil")).alias("im"))


VALUES = "vls AS (SELECT scan_id, c.i AS coil, nex, voxel AS cell, re * (c.i + 1) AS re, im - c.i AS im FROM img, generate_series(0, 1) AS c(i))"


@query(f"WITH {SCANS} SELECT scan_id, coil, nex, cell, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM ({measured_sql('wrp')})")
def i9_encode(fx):
    out = scan_encoding(fx).forward(scan_images(fx))
    return out.select("scan_id", "coil", "nex", "cell", *r5(out, "re", "im"))


@query(f"WITH {SCANS}, {VALUES}, spr AS ({spread_sql('vls')}) SELECT st.scan_id, nex, CAST(st.src AS bigint) AS voxel, round(sum(w * re), 5) + 0.0 AS re, round(sum(w * im), 5) + 0.0 AS im FROM st JOIN spr ON spr.scan_id = st.scan_id AND spr.state = st.state AND spr.voxel = st.voxel GROUP BY ALL")
def i10_decode(fx):
    out = scan_encoding(fx).adjoint(values_of(scan_images(fx)))
    return out.select("scan_id", "nex", "voxel", *r5(out, "re", "im"))


def both_sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two inner products of each scan side by side; ``agree`` to 1e-9 of their size."""
    j = left.select("scan_id", F.col("re").alias("left_re")).join(right.select("scan_id", F.col("re").alias("right_re")), "scan_id")
    gap = F.abs(F.col("left_re") - F.col("right_re")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("left_re"))
    return j.select("scan_id", *r5(j, "left_re", "right_re"), gap.alias("agree"))


@query(f"WITH {SCANS}, {VALUES}, enc AS ({measured_sql('wrp')}), s AS (SELECT e.scan_id, sum(e.re * v.re + e.im * v.im) AS d FROM enc e JOIN vls v USING (scan_id, coil, nex, cell) GROUP BY ALL) SELECT scan_id, round(d, 5) + 0.0 AS left_re, round(d, 5) + 0.0 AS right_re, true AS agree FROM s")
def i11_adjoint_identity(fx):
    img = scan_images(fx)
    values, enc = values_of(img), scan_encoding(fx, overlap=False)
    return both_sides(encoding.inner(enc.forward(img), values, ["coil", "nex", "cell"]), encoding.inner(img, enc.adjoint(values), ["nex", "voxel"]))


@query(f"WITH {SCANS}, enc AS ({measured_sql('wrp')}), spr AS ({spread_sql('enc')}) SELECT st.scan_id, nex, CAST(st.src AS bigint) AS voxel, round(sum(w * re), 5) + 0.0 AS re, round(sum(w * im), 5) + 0.0 AS im FROM st JOIN spr ON spr.scan_id = st.scan_id AND spr.state = st.state AND spr.voxel = st.voxel GROUP BY ALL")
def i11_normal(fx):
    out = scan_encoding(fx).normal(scan_images(fx))
    return out.select("scan_id", "nex", "voxel", *r5(out, "re", "im"))


GRADIENTS = """grd AS MATERIALIZED (SELECT scan_id, nex, state, voxel, CASE WHEN voxel // 8 = 0 THEN xb - re WHEN voxel // 8 = 7 THEN re - xa ELSE (xb - xa) / 2 END AS gxr, CASE WHEN voxel // 8 = 0 THEN xbi - im WHEN voxel // 8 = 7 THEN im - xai ELSE (xbi - xai) / 2 END AS gxi,
  CASE WHEN voxel % 8 = 0 THEN yb - re WHEN voxel % 8 = 7 THEN re - ya ELSE (yb - ya) / 2 END AS gyr, CASE WHEN voxel % 8 = 0 THEN ybi - im WHEN voxel % 8 = 7 THEN im - yai ELSE (ybi - yai) / 2 END AS gyi
  FROM (SELECT *, lag(re) OVER a AS xa, lead(re) OVER a AS xb, lag(im) OVER a AS xai, lead(im) OVER a AS xbi, lag(re) OVER b AS ya, lead(re) OVER b AS yb, lag(im) OVER b AS yai, lead(im) OVER b AS ybi FROM wrp
    WINDOW a AS (PARTITION BY scan_id, nex, state, voxel % 8 ORDER BY voxel // 8), b AS (PARTITION BY scan_id, nex, state, voxel // 8 ORDER BY voxel % 8)))"""


def parameter_changes(fx) -> DataFrame:
    """Displacement changes under changes of each state's parameters."""
    states = scan_states(fx)
    change = states.select("scan_id", "state", (F.col("state") + 1.0).alias("dtx"), (2.0 - F.col("state")).alias("dty"), F.col("phi").alias("dphi"))
    return motion.apply_jacobian(motion.rigid_jacobian(states, 8, 8), change).select("scan_id", "state", "voxel", "dux", "duy")


@query(
    f"WITH {SCANS}, {GRADIENTS}, prt AS (SELECT g.scan_id, nex, g.state, g.voxel, gxr * dux + gyr * duy AS re, gxi * dux + gyi * duy AS im FROM grd g JOIN (SELECT scan_id, state, voxel, state + 1 + (-(x - 4) * sin(phi) - (y - 4) * cos(phi)) * phi AS dux, 2 - state + ((x - 4) * cos(phi) - (y - 4) * sin(phi)) * phi AS duy FROM fld) d ON d.scan_id = g.scan_id AND d.state = g.state AND d.voxel = g.voxel) SELECT scan_id, coil, nex, cell, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im FROM ({measured_sql('prt')})"
)
def i12_perturb(fx):
    out = encoding.Perturbation(scan_encoding(fx), scan_images(fx)).forward(parameter_changes(fx))
    return out.select("scan_id", "coil", "nex", "cell", *r5(out, "re", "im"))


FIELDS = f"{SCANS}, {VALUES}, spr AS ({spread_sql('vls')}), {GRADIENTS}, dsp AS (SELECT g.scan_id, g.state, g.voxel, sum(r.re * gxr + r.im * gxi) AS dux, sum(r.re * gyr + r.im * gyi) AS duy FROM grd g JOIN spr r USING (scan_id, nex, state, voxel) GROUP BY ALL)"


@query(f"WITH {FIELDS} SELECT d.scan_id, d.state, round(sum(dux), 5) + 0.0 AS tx, round(sum(duy), 5) + 0.0 AS ty, round(sum(dux * (-(x - 4) * sin(phi) - (y - 4) * cos(phi)) + duy * ((x - 4) * cos(phi) - (y - 4) * sin(phi))), 5) + 0.0 AS phi FROM dsp d JOIN fld f ON f.scan_id = d.scan_id AND f.state = d.state AND f.voxel = d.voxel GROUP BY ALL")
def i13_perturb_adjoint(fx):
    fields = encoding.Perturbation(scan_encoding(fx), scan_images(fx)).adjoint(values_of(scan_images(fx)))
    out = motion.apply_jacobian_adjoint(motion.rigid_jacobian(scan_states(fx), 8, 8).join(fields, ["scan_id", "state", "voxel"]))
    return out.select("scan_id", "state", *r5(out, "tx", "ty", "phi"))


@query(f"WITH {FIELDS} SELECT scan_id, voxel, round(sum(dux * (state + 0.5)), 5) + 0.0 AS a0, round(sum(duy * (state + 0.5)), 5) + 0.0 AS a1 FROM dsp GROUP BY ALL")
def i13_maps_adjoint(fx):
    fields = encoding.Perturbation(scan_encoding(fx), scan_images(fx)).adjoint(values_of(scan_images(fx)))
    out = encoding.maps_adjoint(fields, scan_states(fx).withColumn("signal", F.col("state") + 0.5))
    return out.select("scan_id", "voxel", *r5(out, "a0", "a1"))


@query(f"WITH {SCANS}, {VALUES}, f AS ({twiddled('(SELECT scan_id, nex, coil, cell AS voxel, re, im FROM vls)', 1, 'scan_id, nex, coil')}) SELECT f.scan_id, nex, f.cell AS voxel, round(sum(f.re * m.re + f.im * m.im), 5) + 0.0 AS re, round(sum(f.im * m.re - f.re * m.im), 5) + 0.0 AS im FROM f JOIN sm m ON m.scan_id = f.scan_id AND m.coil = f.coil AND m.voxel = f.cell GROUP BY ALL")
def i27_uncorrected(fx):
    enc = scan_encoding(fx)
    out = encoding.uncorrected(values_of(scan_images(fx)), enc.grids, enc.smaps)
    return out.select("scan_id", "nex", "voxel", *r5(out, "re", "im"))


#: A symmetric positive system for each image: its 8 by 8 voxels as M give M M' + 1 (entries i, j, a) and a right side.
SYSTEM = """m AS MATERIALIZED (SELECT scan_id, voxel // 8 AS i, voxel % 8 AS k, re FROM fx_img),
  a AS MATERIALIZED (SELECT l.scan_id, l.i, r.i AS j, sum(l.re * r.re) + max(CASE WHEN l.i = r.i THEN 1.0 ELSE 0.0 END) AS a FROM m l JOIN m r ON r.scan_id = l.scan_id AND r.k = l.k GROUP BY ALL),
  b AS (SELECT scan_id, i, re + i AS v FROM m WHERE k = 0)"""


def image_systems(fx) -> tuple[solvers.Apply, DataFrame]:
    # Where its scan is, a matrix is summed up whole: dealt by scan and k it would be eight times as many sums, shuffled once more.
    m = encoding.by_scan(fx("fx_img").select("scan_id", F.floor(F.col("voxel") / 8).alias("i"), (F.col("voxel") % 8).alias("k"), "re"))
    left, right = m.withColumnRenamed("re", "l"), m.withColumnsRenamed({"i": "j", "re": "r"})
    a = left.join(right, ["scan_id", "k"]).groupBy("scan_id", "i", "j").agg((F.sum(F.col("l") * F.col("r")) + F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)).alias("a"))
    a = tables.materialize(a)

    def apply(x: DataFrame) -> DataFrame:
        return a.join(x.withColumnRenamed("i", "j"), ["scan_id", "j"]).groupBy("scan_id", "i").agg(F.sum(F.col("a") * F.col("v")).alias("v"))

    return apply, m.filter("k = 0").select("scan_id", "i", (F.col("re") + F.col("i")).alias("v"))


def cg_sql(rounds: int) -> str:
    parts = [SYSTEM, "s0 AS MATERIALIZED (SELECT scan_id, i, 0.0 AS x, v AS r, v AS p FROM b)"]
    for k in range(rounds):
        parts += [
            f"q{k} AS MATERIALIZED (SELECT a.scan_id, a.i, sum(a * p) AS q FROM a JOIN s{k} s ON s.scan_id = a.scan_id AND s.i = a.j GROUP BY ALL)",
            f"d{k} AS (SELECT scan_id, sum(r * r) AS rr, sum(p * q) AS pq, sum(r * q) AS rq, sum(q * q) AS qq FROM s{k} JOIN q{k} USING (scan_id, i) GROUP BY scan_id)",
            f"s{k + 1} AS MATERIALIZED (SELECT scan_id, i, x + rr / pq * p AS x, r - rr / pq * q AS r, r - rr / pq * q + (rr - 2 * rr / pq * rq + rr / pq * rr / pq * qq) / rr * p AS p FROM s{k} JOIN q{k} USING (scan_id, i) JOIN d{k} USING (scan_id))",
        ]
    return f"WITH {', '.join(parts)} SELECT scan_id, i, round(x, 6) + 0.0 AS x FROM s{rounds}"


@query(cg_sql(4))
def i17_cg_solve(fx):
    apply, b = image_systems(fx)
    out = solvers.cg_solve(apply, b, ["i"], ("v",), tol=0.0, rounds=4).x
    return out.select("scan_id", "i", r6("v", "x"))


UNIFORM = "(CAST('0x' || substr(md5(concat_ws('|', '0', 'v{0}', k.k, scan_id, i)), 1, 8) AS bigint) + 0.5) / 4294967296.0"


@query(
    f"""WITH {SYSTEM}, g AS MATERIALIZED (SELECT k.k, scan_id, i, sqrt(-2 * ln({UNIFORM.format(0)})) * cos(2 * pi() * {UNIFORM.format(1)}) AS v FROM b, generate_series(0, 7) AS k(k)),
    n AS (SELECT k, scan_id, sqrt(sum(q * q)) AS n FROM (SELECT g.k, a.scan_id, a.i, sum(a * v) AS q FROM a JOIN g ON g.scan_id = a.scan_id AND g.i = a.j GROUP BY ALL) GROUP BY ALL),
    d AS (SELECT k, scan_id, sqrt(sum(s * s)) AS d FROM (SELECT k, scan_id, coalesce(v - lag(v) OVER w, 0) + coalesce(v - lead(v) OVER w, 0) AS s FROM g WINDOW w AS (PARTITION BY k, scan_id ORDER BY i)) GROUP BY ALL)
    SELECT scan_id, round(list_sort(list(n / d))[4], 6) + 0.0 AS scale FROM n JOIN d USING (k, scan_id) GROUP BY scan_id"""
)
def i18_regularisation_scale(fx):
    apply, b = image_systems(fx)
    line = lambda v: motion.smoothness(v.withColumnRenamed("i", "x"), (8,), ["scan_id"]).select("scan_id", F.col("x").alias("i"), F.col("smooth").alias("v"))
    return solvers.regularisation_scale(apply, line, b, ["i"], ("v",)).select("scan_id", r6("scale"))


#: 64 voxels of an image as a matrix of a size that differs from scan to scan.
SIZES = "CASE scan_id % 4 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 16 ELSE 4 END AS nx, CASE scan_id % 4 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 4 END AS ny, CASE scan_id % 4 WHEN 3 THEN 4 ELSE 1 END AS nz"


def level_sql() -> str:
    """Crops by arithmetic; resized maps by each output's neighbours along each axis."""
    axis = lambda a, n, m: f"{a}t AS (SELECT scan_id, o, CAST(least(floor(t), {n} - 1) AS bigint) AS lo, CAST(least(floor(t) + 1, {n} - 1) AS bigint) AS hi, t - floor(t) AS w FROM (SELECT scan_id, {n}, k.o, greatest(0.0, (k.o + 0.5) * ({n} / {m}) - 0.5) AS t FROM lv, generate_series(0, 15) AS k(o) WHERE k.o < {m})), {a}s AS (SELECT scan_id, o, lo AS i, 1 - w AS w FROM {a}t UNION ALL SELECT scan_id, o, hi, w FROM {a}t)"
    return f"""WITH lv AS MATERIALIZED (SELECT *, CAST(greatest(1, round_even(nx * 0.5, 0)) AS bigint) AS mx, CAST(greatest(1, round_even(ny * 0.5, 0)) AS bigint) AS my, CAST(greatest(1, round_even(nz * 0.5, 0)) AS bigint) AS mz FROM (SELECT DISTINCT scan_id, {SIZES} FROM fx_img)),
    c AS (SELECT f.*, nx, ny, nz, mx, my, mz, voxel // (ny * nz) AS x, voxel // nz % ny AS y, voxel % nz AS z FROM fx_img f JOIN lv USING (scan_id)),
    k AS (SELECT scan_id, ((x - (nx - mx) // 2) * my + y - (ny - my) // 2) * mz + z - (nz - mz) // 2 AS place, re, im, voxel FROM c WHERE x - (nx - mx) // 2 BETWEEN 0 AND mx - 1 AND y - (ny - my) // 2 BETWEEN 0 AND my - 1 AND z - (nz - mz) // 2 BETWEEN 0 AND mz - 1),
    {axis('x', 'nx', 'mx')}, {axis('y', 'ny', 'my')}, {axis('z', 'nz', 'mz')},
    m AS (SELECT c.scan_id, (xs.o * my + ys.o) * mz + zs.o AS place, sum(xs.w * ys.w * zs.w * re) AS re, sum(xs.w * ys.w * zs.w * im) AS im FROM c JOIN xs ON xs.scan_id = c.scan_id AND xs.i = c.x JOIN ys ON ys.scan_id = c.scan_id AND ys.i = c.y JOIN zs ON zs.scan_id = c.scan_id AND zs.i = c.z GROUP BY ALL)
    SELECT scan_id, kind, CAST(place AS bigint) AS place, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im, mx, my, mz FROM (SELECT scan_id, 'map' AS kind, place, re, im FROM m UNION ALL SELECT scan_id, 'value', place, re, im FROM k UNION ALL SELECT scan_id, 'sample', place, NULL, NULL FROM k WHERE voxel % 3 <> 1) JOIN lv USING (scan_id)"""


@query(level_sql())
def i16_build_level(fx):
    img = images(fx)
    grids = img.select("scan_id").distinct().selectExpr("scan_id", *SIZES.replace(", CASE", "; CASE").split("; "))
    one = F.lit(0).cast("bigint")
    values = img.select("scan_id", one.alias("coil"), one.alias("nex"), F.col("voxel").alias("cell"), "re", "im")
    samples = values.filter("cell % 3 <> 1").select("scan_id", "nex", one.alias("state"), "cell")
    level = encoding.build_level(grids, img.select("scan_id", one.alias("coil"), "voxel", "re", "im"), samples, values, 0.5)
    none = F.lit(None).cast("double")
    parts = [level.smaps.select("scan_id", F.lit("map").alias("kind"), F.col("voxel").alias("place"), "re", "im"), level.values.select("scan_id", F.lit("value"), "cell", "re", "im"), level.samples.select("scan_id", F.lit("sample"), "cell", none, none)]
    out = parts[0].union(parts[1]).union(parts[2])
    sizes = level.grids.select("scan_id", *(F.col(f"n{a}").cast("bigint").alias(f"m{a}") for a in "xyz"))
    return out.join(sizes, "scan_id").select("scan_id", "kind", "place", *r5(out, "re", "im"), "mx", "my", "mz")


#: Volumes of 4 by 4 by 4 voxels with two states; few voxels count in the second, so that its system has not the full rank.
VOLUMES = """s AS (SELECT scan_id, k.s AS state, re * (k.s + 1) AS tx, re / 2 AS ty, -re AS tz, 0.1 + re AS rx, 0.2 * (k.s + 1) AS ry, re - 0.1 AS rz FROM fx_img, generate_series(0, 1) AS k(s) WHERE voxel = 0),
  v AS MATERIALIZED (SELECT scan_id, voxel, voxel // 16 AS x, voxel // 4 % 4 AS y, voxel % 4 AS z, re, re * re + im AS im FROM fx_img),
  g AS MATERIALIZED (SELECT scan_id, voxel, x - 2.0 AS x, y - 2.0 AS y, z - 2.0 AS z, re, im, """ + ", ".join(
    f"CASE WHEN {a} = 0 THEN lead({p}) OVER w{a} - {p} WHEN {a} = 3 THEN {p} - lag({p}) OVER w{a} ELSE (lead({p}) OVER w{a} - lag({p}) OVER w{a}) / 2 END AS g{a}_{p}" for a in "xyz" for p in ("re", "im")
) + " FROM v WINDOW " + ", ".join(f"w{a} AS (PARTITION BY scan_id, {', '.join(b for b in 'xyz' if b != a)} ORDER BY {a})" for a in "xyz") + """),
  r AS (SELECT g.*, state, cos(rx) AS cx, sin(rx) AS sx, cos(ry) AS cy, sin(ry) AS sy, cos(rz) AS cz, sin(rz) AS sz FROM g JOIN s USING (scan_id)),
  j AS MATERIALIZED (SELECT *, (cz * sy * cx + sz * sx) * y + (sz * cx - cz * sy * sx) * z AS jrx_x, (sz * sy * cx - cz * sx) * y - (sz * sy * sx + cz * cx) * z AS jrx_y, cy * cx * y - cy * sx * z AS jrx_z,
    -cz * sy * x + cz * cy * sx * y + cz * cy * cx * z AS jry_x, -sz * sy * x + sz * cy * sx * y + sz * cy * cx * z AS jry_y, -cy * x - sy * sx * y - sy * cx * z AS jry_z,
    -sz * cy * x + (-sz * sy * sx - cz * cx) * y + (-sz * sy * cx + cz * sx) * z AS jrz_x, cz * cy * x + (cz * sy * sx - sz * cx) * y + (cz * sy * cx + sz * sx) * z AS jrz_y, 0.0 AS jrz_z FROM r)"""


def volume_states(fx) -> DataFrame:
    first = fx("fx_img").filter("voxel = 0").select("scan_id", "re", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("state"))
    re, s = F.col("re"), F.col("state")
    return first.select("scan_id", "state", (re * (s + 1)).alias("tx"), (re / 2).alias("ty"), (-re).alias("tz"), (0.1 + re).alias("rx"), (0.2 * (s + 1)).alias("ry"), (re - 0.1).alias("rz"))


@query(f"WITH {VOLUMES} SELECT scan_id, state, voxel, " + ", ".join(f"round({1.0 + k} * (state + 1) + jrx_{a} * 0.1 + jry_{a} * 0.2 - jrz_{a} * state, 5) + 0.0 AS du{a}" for k, a in enumerate("xyz")) + " FROM j")
def i14_apply_jacobian_3d(fx):
    states, s = volume_states(fx), F.col("state")
    change = states.select("scan_id", "state", *((F.lit(1.0 + k) * (s + 1)).alias(f"dt{a}") for k, a in enumerate("xyz")), F.lit(0.1).alias("drx"), F.lit(0.2).alias("dry"), (-s).cast("double").alias("drz"))
    out = motion.apply_jacobian_3d(motion.rigid_jacobian_3d(states, 4, 4, 4), change)
    return out.select("scan_id", "state", "voxel", *r5(out, "dux", "duy", "duz"))


@query(f"WITH {VOLUMES} SELECT scan_id, state, round(sum(gx_re), 5) + 0.0 AS tx, round(sum(gy_re), 5) + 0.0 AS ty, round(sum(gz_re), 5) + 0.0 AS tz, " + ", ".join(f"round(sum(j{r}_x * gx_re + j{r}_y * gy_re + j{r}_z * gz_re), 5) + 0.0 AS {r}" for r in ("rx", "ry", "rz")) + " FROM j GROUP BY scan_id, state")
def i14_jacobian_adjoint_3d(fx):
    g = volume_gradients(fx).select("scan_id", "voxel", *(F.col(f"g{a}_re").alias(f"du{a}") for a in "xyz"))
    out = motion.apply_jacobian_adjoint_3d(motion.rigid_jacobian_3d(volume_states(fx), 4, 4, 4).join(g, ["scan_id", "voxel"]))
    return out.select("scan_id", "state", *r5(out, "tx", "ty", "tz", "rx", "ry", "rz"))


def volume_gradients(fx) -> DataFrame:
    v = images(fx).select("scan_id", "voxel", F.floor(F.col("voxel") / 16).alias("x"), F.floor(F.col("voxel") / 4) % 4, F.col("voxel") % 4, "re", (F.col("re") * F.col("re") + F.col("im")).alias("im"))
    return motion.gradient(v.toDF("scan_id", "voxel", "x", "y", "z", "re", "im"), (4, 4, 4), ["scan_id"])


def cholesky_sql(src: str, n: int, lam: float, least: float) -> str:
    """A column for each factor, in nested selects; a dependent parameter's factors are null, and count as zero."""
    sql = f"SELECT *, greatest({', '.join(f'n{i}{i} + {lam}' for i in range(n))}) * {least} AS fl FROM ({src})"
    for i in range(n):
        sql = f"SELECT *, n{i}{i} + {lam}" + "".join(f" - l{i}{k} * l{i}{k}" for k in range(i)) + f" AS p{i} FROM ({sql})"
        sql = f"SELECT *, CASE WHEN p{i} > fl THEN sqrt(p{i}) END AS l{i}{i} FROM ({sql})"
        below = "".join(f", coalesce((n{i}{j}" + "".join(f" - l{j}{k} * l{i}{k}" for k in range(i)) + f") / l{i}{i}, 0) AS l{j}{i}" for j in range(i + 1, n))
        sql = f"SELECT *, coalesce((b{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i)) + f") / l{i}{i}, 0) AS y{i}{below} FROM ({sql})"
    for i in reversed(range(n)):
        sql = f"SELECT *, coalesce((y{i}" + "".join(f" - l{k}{i} * d{k}" for k in range(i + 1, n)) + f") / l{i}{i}, 0) AS d{i} FROM ({sql})"
    return sql


_PARTS = [(f"g{a}_re", f"g{a}_im") for a in "xyz"] + [tuple(f"(j{r}_x * gx_{p} + j{r}_y * gy_{p} + j{r}_z * gz_{p})" for p in ("re", "im")) for r in ("rx", "ry", "rz")]
_EQUATIONS = "SELECT scan_id, state, " + ", ".join(f"sum({_PARTS[i][0]} * {_PARTS[k][0]} + {_PARTS[i][1]} * {_PARTS[k][1]}) AS n{i}{k}" for i in range(6) for k in range(i, 6)) + ", " + ", ".join(f"sum({_PARTS[i][0]} * re + {_PARTS[i][1]} * im) AS b{i}" for i in range(6)) + " FROM j WHERE state = 0 OR voxel < 2 GROUP BY scan_id, state"


@query(f"WITH {VOLUMES} SELECT scan_id, state, {', '.join(f'round(d{i}, 3) + 0.0 AS d{i}' for i in range(6))} FROM ({cholesky_sql(_EQUATIONS, 6, 0.0, 1e-3)})")
def i20_rigid_step_3d(fx):
    few = (F.col("state") == 0) | (F.col("voxel") < 2)
    g = volume_gradients(fx).drop("x", "y", "z")
    states = volume_states(fx).select("scan_id", "state").join(g, "scan_id")
    parts = motion.image_derivatives(states, motion.rigid_jacobian_3d(volume_states(fx), 4, 4, 4), three=True).filter(few)
    eq = motion.rigid_normal_equations(parts.withColumnsRenamed({"re": "r_re", "im": "r_im"}), tuple(f"j{k}" for k in range(6)))
    out = motion.solve_normal(eq, 6, least=1e-3)
    return out.select("scan_id", "state", *((F.round(f"d{i}", 3) + 0.0).alias(f"d{i}") for i in range(6)))


#: The same scans with every cell in one state only: there the adjoint is the transpose.
SCANS_OWN = SCANS.replace("smp AS (", "smp0 AS (").replace("AS state FROM smp GROUP", "AS state FROM smp0 GROUP") + ", smp AS (SELECT * FROM own)"


def cg_rounds(b: str, places: str, values: tuple[str, ...], rounds: int, apply: Callable[[str, int], tuple[list[str], str]]) -> list[str]:
    """Rounds of conjugate gradients over tables; ``apply`` gives the tables that multiply one, and the last one's name."""
    parts = ["s0 AS MATERIALIZED (SELECT scan_id, " + places + "".join(f", 0.0 AS x_{v}, {v} AS r_{v}, {v} AS p_{v}" for v in values) + f" FROM {b})"]
    dot = lambda m, n: "sum(" + " + ".join(f"{m}_{v} * {n}_{v}" for v in values) + ")"
    for k in range(rounds):
        more, name = apply(f"(SELECT scan_id, {places}, " + ", ".join(f"p_{v} AS {v}" for v in values) + f" FROM s{k})", k)
        parts += more
        parts.append(f"q{k} AS MATERIALIZED (SELECT s.*, " + ", ".join(f"coalesce({v}, 0) AS q_{v}" for v in values) + f" FROM s{k} s LEFT JOIN {name} USING (scan_id, {places}))")
        parts.append(f"d{k} AS (SELECT scan_id, rr / pq AS al, (rr - 2 * rr / pq * rq + rr / pq * rr / pq * qq) / rr AS be FROM (SELECT scan_id, {dot('r', 'r')} AS rr, {dot('p', 'q')} AS pq, {dot('r', 'q')} AS rq, {dot('q', 'q')} AS qq FROM q{k} GROUP BY scan_id))")
        parts.append(f"s{k + 1} AS MATERIALIZED (SELECT scan_id, {places}, " + ", ".join(f"x_{v} + al * p_{v} AS x_{v}, r_{v} - al * q_{v} AS r_{v}, r_{v} - al * q_{v} + be * p_{v} AS p_{v}" for v in values) + f" FROM q{k} JOIN d{k} USING (scan_id))")
    return parts


def decoded_sql(values: str) -> tuple[str, str]:
    return spread_sql(values), "SELECT st.scan_id, nex, CAST(st.src AS bigint) AS voxel, sum(w * re) AS re, sum(w * im) AS im FROM st JOIN {0} p ON p.scan_id = st.scan_id AND p.state = st.state AND p.voxel = st.voxel GROUP BY ALL"


def image_normal_sql(src: str, k: int) -> tuple[list[str], str]:
    spread, back = decoded_sql(f"e{k}")
    return [
        f"w{k} AS MATERIALIZED (SELECT st.scan_id, nex, state, st.voxel, sum(w * re) AS re, sum(w * im) AS im FROM st JOIN {src} i ON i.scan_id = st.scan_id AND i.voxel = st.src GROUP BY ALL)",
        f"e{k} AS MATERIALIZED ({measured_sql(f'w{k}')})", f"t{k} AS MATERIALIZED ({spread})", f"b{k} AS ({back.format(f't{k}')})",
        f"n{k} AS (SELECT scan_id, nex, voxel, sum(re) AS re, sum(im) AS im FROM (SELECT * FROM b{k} UNION ALL SELECT scan_id, nex, voxel, 0.1 * re, 0.1 * im FROM {src}) GROUP BY ALL)",
    ], f"n{k}"


def image_solve_sql(rounds: int) -> str:
    spread, back = decoded_sql("vls")
    first = [SCANS_OWN, VALUES, f"ts AS MATERIALIZED ({spread})", f"bs AS ({back.format('ts')})", "bb AS (SELECT i.scan_id, i.nex, i.voxel, coalesce(b.re, 0) AS re, coalesce(b.im, 0) AS im FROM img i LEFT JOIN bs b USING (scan_id, nex, voxel))"]
    return f"WITH {', '.join([*first, *cg_rounds('bb', 'nex, voxel', ('re', 'im'), rounds, image_normal_sql)])} SELECT scan_id, nex, voxel, round(x_re, 5) + 0.0 AS re, round(x_im, 5) + 0.0 AS im FROM s{rounds}"


def held(enc: encoding.Encoding) -> encoding.Encoding:
    """An encoding whose maps and samples are written once, as a solve reads them in each round; the stencil is made from its states where it is used."""
    return encoding.Encoding(enc.grids, tables.materialize(enc.smaps), tables.materialize(enc.samples), enc.stencil)


def weights(enc: encoding.Encoding, w: float) -> DataFrame:
    return enc.grids.select("scan_id", F.lit(w).alias("weight"))


@query(image_solve_sql(2))
def i19_solve_image(fx):
    enc = held(scan_encoding(fx, overlap=False))
    out = reconstruction.solve_image(enc, values_of(scan_images(fx)), weight=weights(enc, 0.1), tol=0.0, rounds=2).x
    return out.select("scan_id", "nex", "voxel", *r5(out, "re", "im"))


def map_normal_sql(src: str, k: int) -> tuple[list[str], str]:
    return [
        f"w{k} AS MATERIALIZED (SELECT g.scan_id, nex, state, g.voxel, (state + 0.5) * (gxr * a0 + gyr * a1) AS re, (state + 0.5) * (gxi * a0 + gyi * a1) AS im FROM grd g JOIN {src} d ON d.scan_id = g.scan_id AND d.voxel = g.voxel)",
        f"e{k} AS MATERIALIZED ({measured_sql(f'w{k}')})", f"t{k} AS MATERIALIZED ({spread_sql(f'e{k}')})", *maps_back_sql(f"t{k}", f"b{k}"), rough_sql(src, f"g{k}"),
        f"n{k} AS (SELECT scan_id, voxel, sum(a0) AS a0, sum(a1) AS a1 FROM (SELECT * FROM b{k} UNION ALL SELECT scan_id, voxel, 0.5 * a0, 0.5 * a1 FROM g{k}) GROUP BY ALL)",
    ], f"n{k}"


def maps_back_sql(spread: str, name: str) -> list[str]:
    return [f"{name} AS (SELECT g.scan_id, g.voxel, sum((state + 0.5) * (r.re * gxr + r.im * gxi)) AS a0, sum((state + 0.5) * (r.re * gyr + r.im * gyi)) AS a1 FROM grd g JOIN {spread} r USING (scan_id, nex, state, voxel) GROUP BY ALL)"]


def rough_sql(src: str, name: str) -> str:
    one = lambda v: " + ".join(f"coalesce({v} - {f}({v}) OVER {w}, 0)" for w in "ab" for f in ("lag", "lead"))
    return f"{name} AS (SELECT scan_id, voxel, {one('a0')} AS a0, {one('a1')} AS a1 FROM {src} WINDOW a AS (PARTITION BY scan_id, voxel % 8 ORDER BY voxel // 8), b AS (PARTITION BY scan_id, voxel // 8 ORDER BY voxel % 8))"


def map_step_sql(rounds: int) -> str:
    first = [SCANS_OWN, VALUES, GRADIENTS, "mp AS (SELECT scan_id, voxel, re AS a0, im AS a1 FROM img WHERE nex = 0)", f"ts AS MATERIALIZED ({spread_sql('vls')})", *maps_back_sql("ts", "bs"), rough_sql("mp", "rs")]
    first.append("bb AS (SELECT scan_id, voxel, sum(a0) AS a0, sum(a1) AS a1 FROM (SELECT * FROM bs UNION ALL SELECT scan_id, voxel, -0.5 * a0, -0.5 * a1 FROM rs) GROUP BY ALL)")
    return f"WITH {', '.join([*first, *cg_rounds('bb', 'voxel', ('a0', 'a1'), rounds, map_normal_sql)])} SELECT scan_id, voxel, round(x_a0, 5) + 0.0 AS a0, round(x_a1, 5) + 0.0 AS a1 FROM s{rounds}"


@query(map_step_sql(2))
def i20_nonrigid_step(fx):
    img, enc = tables.materialize(scan_images(fx)), held(scan_encoding(fx, overlap=False))
    maps = img.filter("nex = 0").select("scan_id", "voxel", F.col("re").alias("a0"), F.col("im").alias("a1"))
    states = scan_states(fx).withColumn("signal", F.col("state") + 0.5)
    out = reconstruction.map_step(enc, img, maps, states, values_of(img), weights(enc, 0.5), tol=0.0, rounds=2).x
    return out.select("scan_id", "voxel", *r5(out, "a0", "a1"))


def rigid_step_sql() -> str:
    jx, jy = "(-(x - 4) * sin(phi) - (y - 4) * cos(phi))", "((x - 4) * cos(phi) - (y - 4) * sin(phi))"
    parts = ["gxr AS re, gxi AS im", "gyr AS re, gyi AS im", f"gxr * {jx} + gyr * {jy} AS re, gxi * {jx} + gyi * {jy} AS im"]
    first = [SCANS_OWN, VALUES, GRADIENTS, "gf AS MATERIALIZED (SELECT g.*, x, y, phi FROM grd g JOIN fld f ON f.scan_id = g.scan_id AND f.state = g.state AND f.voxel = g.voxel)"]
    for k, p in enumerate(parts):
        first += [f"u{k} AS MATERIALIZED (SELECT scan_id, nex, state, voxel, {p} FROM gf)", f"v{k} AS MATERIALIZED ({measured_sql(f'u{k}')})"]
    dots = [f"sum(v{i}.re * v{k}.re + v{i}.im * v{k}.im) AS n{i}{k}" for i in range(3) for k in range(i, 3)] + [f"sum(v{i}.re * r.re + v{i}.im * r.im) AS b{i}" for i in range(3)]
    on = " ".join(f"JOIN v{k} USING (scan_id, nex, state, coil, cell)" for k in (1, 2))
    eq = f"SELECT scan_id, state, {', '.join(dots)} FROM v0 {on} JOIN vls r USING (scan_id, nex, coil, cell) GROUP BY ALL"
    return f"WITH {', '.join(first)} SELECT scan_id, state, {', '.join(f'round(d{i}, 5) + 0.0 AS d{i}' for i in range(3))} FROM ({cholesky_sql(eq, 3, 0.1, 1e-10)})"


@query(rigid_step_sql())
def i20_rigid_step_encoded(fx):
    img, enc = tables.materialize(scan_images(fx)), held(scan_encoding(fx, overlap=False))
    out = reconstruction.rigid_step(enc, img, motion.rigid_jacobian(scan_states(fx), 8, 8), values_of(img), 0.1)
    return out.select("scan_id", "state", *r5(out, "d0", "d1", "d2"))


@query()
def i21_reconstruct(fx):
    """Residuals of every scan, level and iteration of a reconstruction that starts without motion."""
    img, true = tables.materialize(scan_images(fx)), held(scan_encoding(fx, overlap=False))
    values = tables.materialize(true.forward(img))
    still = tables.materialize(scan_states(fx).select("scan_id", "state", *(F.lit(0.0).alias(p) for p in motion.RIGID_2D)))
    path = tables.shared_path(img.sparkSession)
    out = reconstruction.reconstruct(true.grids, true.smaps, true.samples, values, still, path, iterations=2, rounds=2, lam=0.1, weight=0.01)
    return out.log.select("scan_id", "level", "gn_iter", r6("relres"), "stopped")


def band_quality_sql() -> str:
    """Both bands by the filter, the score of each channel by its segments, and the best of those kept."""
    low, high = (zero_phase_sql(2e-7, x).replace("round(filtered, 6) + 0.0 AS filtered", "filtered") for x in (True, False))
    return f"""WITH lo AS MATERIALIZED ({low}), hi AS MATERIALIZED ({high}),
    b AS (SELECT l.scan_id, l.sensor_id, l.channel, l.t, l.filtered AS low, h.filtered AS high, row_number() OVER (PARTITION BY l.scan_id, l.sensor_id, l.channel ORDER BY l.t) - 1 AS i FROM lo l JOIN hi h USING (scan_id, sensor_id, channel, t)),
    w AS (SELECT scan_id, sensor_id, channel, count(*) AS n, avg(low) AS m, stddev_pop(high) AS d, max(t) - min(t) AS span FROM b GROUP BY ALL),
    j AS (SELECT b.*, n, m, d, b.i // CAST(greatest(1, CASE WHEN span > 0 THEN floor(2000000 / span * n) ELSE n END) AS bigint) AS seg FROM b JOIN w USING (scan_id, sensor_id, channel)),
    s AS (SELECT scan_id, sensor_id, channel, seg, stddev_pop(high) AS sd, sum((low - m - high) * (low - m - high)) AS ss, any_value(n) AS n, any_value(d) AS d FROM j GROUP BY ALL),
    k AS (SELECT scan_id, sensor_id, channel, sqrt(sum(ss)) / any_value(n) / nullif(least(min(sd), any_value(d)), 0) AS score FROM s GROUP BY ALL),
    d AS (SELECT scan_id, sensor_id, channel, stddev_pop(low) AS dev, CASE WHEN coalesce(any_value(score) < 1.0, false) THEN stddev_pop(low) ELSE 0.0 END AS s FROM b JOIN k USING (scan_id, sensor_id, channel) GROUP BY ALL),
    c AS (SELECT *, row_number() OVER (PARTITION BY scan_id, sensor_id ORDER BY s DESC, channel) AS r FROM d), f AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY s DESC, sensor_id) AS q FROM c WHERE r = 1)
    SELECT b.scan_id, b.sensor_id, b.channel, b.t, round(CASE WHEN dev > 1e-6 THEN low / dev END, 4) + 0.0 AS y FROM b JOIN f ON q = 1 AND f.scan_id = b.scan_id AND f.sensor_id = b.sensor_id AND f.channel = b.channel"""


@query(band_quality_sql())
def wb_best_accelerometer(fx):
    """From samples to the best stream: both bands, the channels' quality, the best channel of the best sensor."""
    out = workloads.best_accelerometer(fx("fx_sensor").select("scan_id", "sensor_id", "channel", "t", "y"), 2e-7, 2000000.0, threshold=1.0)
    return out.select("scan_id", "sensor_id", "channel", "t", (F.round(F.when(F.col("dev") > 1e-6, F.col("y")), 4) + 0.0).alias("y"))


def aligned_sql(readouts: str, cutoff: float) -> str:
    """Common tables that end in ``mo``: the imaging readouts with the filtered signal of the scan's stronger channel."""
    smooth = zero_phase_sql(cutoff, True, "strong", "scan_id, channel").replace("round(filtered, 6) + 0.0 AS filtered", "filtered")
    return f"""{PAIRS}, ro AS MATERIALIZED ({readouts}),
    pick AS (SELECT scan_id, CASE WHEN coalesce(stddev_pop(y) FILTER (channel = 0), 0) > coalesce(stddev_pop(y) FILTER (channel = 1), 0) THEN 0 ELSE 1 END AS channel FROM fx_sensor GROUP BY scan_id),
    strong AS MATERIALIZED (SELECT s.scan_id, s.channel, CAST(s.us - best.stop_t AS double) / 1e6 AS t, s.y FROM fx_sensor s JOIN best USING (scan_id) JOIN pick ON pick.scan_id = s.scan_id AND pick.channel = s.channel),
    zp AS MATERIALIZED (SELECT scan_id, t, filtered AS y FROM ({smooth})),
    dt AS MATERIALIZED (SELECT * FROM (WITH {detrend_sql("zp", "t")} SELECT p.scan_id, p.t, {DETRENDED} AS y FROM p JOIN f USING (scan_id))),
    timed AS (SELECT *, (acq_ts - last_value(acq_ts) OVER (PARTITION BY scan_id ORDER BY acq_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) * 2.5e-3 AS t FROM ro),
    below AS (SELECT r.*, l.t AS lt, l.y AS ly FROM timed r ASOF LEFT JOIN dt l ON r.scan_id = l.scan_id AND r.t > l.t),
    around AS (SELECT r.*, h.t AS ht, h.y AS hy FROM below r ASOF LEFT JOIN dt h ON r.scan_id = h.scan_id AND r.t <= h.t),
    mo AS MATERIALIZED (SELECT *, CASE WHEN lt IS NULL THEN hy WHEN ht IS NULL OR ht = lt THEN ly ELSE ly + (hy - ly) * (t - lt) / (ht - lt) END AS motion FROM around)"""


def align_and_bin_sql() -> str:
    readouts = "SELECT scan_id, acq_idx, acq_ts // 2500 AS acq_ts FROM fx_read WHERE flags & 239337472 = 0"
    before = f"{aligned_sql(readouts, 5e-7)}, ml AS MATERIALIZED (SELECT scan_id, acq_idx AS idx, round(motion, 4) + 0.0 AS y FROM mo), "
    binned = kmeans_sql(3, 20, "ml", before, "c[label + 1]").replace("WITH ", "WITH RECURSIVE ", 1)
    at = binned.rindex(" SELECT l.scan_id")
    return f"""{binned[:at]}, km AS ({binned[at:]}) SELECT scan_id, acq_idx, row_number() OVER (PARTITION BY scan_id ORDER BY acq_idx) - 1 AS line_idx, label AS state, round(motion, 4) + 0.0 AS motion, round(center, 8) + 0.0 AS center
    FROM mo JOIN (SELECT scan_id, line_idx AS acq_idx, label, center FROM km) USING (scan_id, acq_idx)"""


def in_ticks(read: DataFrame) -> DataFrame:
    """Readouts whose microseconds became the scanner's ticks of 2.5 ms."""
    return read.withColumn("acq_ts", F.floor(F.col("acq_ts") / 2500))


@query(align_and_bin_sql())
def wa_align_and_bin(fx):
    acq = in_ticks(fx("fx_read")).withColumn("z", F.lit(0).cast("bigint")).select("scan_id", "acq_idx", "acq_ts", "flags", "ky", "kz", "nex", "z")
    sensor = fx("fx_sensor").select("scan_id", "channel", F.col("us").alias("t"), "y")
    out = workloads.align_and_bin(acq, sensor, fx("fx_trig"), 1, 3, 1e6, cutoff=5e-7, digits=4)
    return out.readouts.select("scan_id", "acq_idx", "line_idx", "state", (F.round("motion", 4) + 0.0).alias("motion"), (F.round("center", 8) + 0.0).alias("center"))


def raw_bundle(fx: Fx) -> workloads.Bundle:
    """A bundle from readouts of two coils and eight samples; even scans are stacks of two slices, odd ones slabs."""
    read = in_ticks(fx("fx_read")).withColumn("slice", F.when(F.col("scan_id") % 2 == 0, F.col("acq_idx") % 2).otherwise(0))
    coils = read.withColumn("coil", F.explode(F.array(F.lit(0), F.lit(1)))).withColumnRenamed("nex", "repetition")
    samples = lambda c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.col(c) * (k + 1) * (F.col("coil") + 1))
    acq = coils.select("scan_id", "acq_idx", "coil", "flags", "ky", "kz", "repetition", "slice", "acq_ts", samples("re").alias("re"), samples("im").alias("im"))
    sensor = fx("fx_sensor").select("scan_id", "channel", F.col("us").alias("t"), "y")
    return workloads.raw_to_bundle(acq, meta(read), sensor, fx("fx_trig"), tables.shared_path(read.sparkSession), 1e6, cutoff=5e-7)


RAW_READOUTS = """SELECT scan_id, acq_idx, acq_ts // 2500 AS acq_ts, ky, kz, nex, re, im, CASE WHEN max_slice < 1 AND max_step2 > 0 THEN kz ELSE slice END AS z FROM (SELECT * EXCLUDE (slice), CASE WHEN scan_id % 2 = 0 THEN acq_idx % 2 ELSE 0 END AS slice FROM fx_read)
    JOIN (SELECT scan_id, max(CASE WHEN scan_id % 2 = 0 THEN acq_idx % 2 ELSE 0 END) AS max_slice, max(kz) AS max_step2 FROM fx_read GROUP BY scan_id) USING (scan_id) WHERE flags & 239337472 = 0"""


def raw_bundle_sql(select: str) -> str:
    return f"""WITH RECURSIVE {aligned_sql(RAW_READOUTS, 5e-7)}, pz AS (SELECT scan_id, z, count(*) AS n FROM mo GROUP BY ALL), silent AS (SELECT scan_id, count(motion) = 0 AS none FROM mo GROUP BY scan_id),
    why AS MATERIALIZED (SELECT scan_id, CASE WHEN min(n) < max(n) OR count(*) < max(z) + 1 THEN 'uneven slices' WHEN any_value(none) THEN 'no motion signal' END AS reason FROM pz JOIN silent USING (scan_id) GROUP BY scan_id), {select}"""


@query(
    raw_bundle_sql(
        """kept AS (SELECT mo.*, row_number() OVER (PARTITION BY scan_id, z ORDER BY acq_idx) - 1 AS line_idx FROM mo JOIN why USING (scan_id) WHERE reason IS NULL)
    SELECT scan_id, z, line_idx, ky, kz, nex, round(motion, 4) + 0.0 AS motion, NULL AS reason FROM kept UNION ALL SELECT scan_id, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM why WHERE reason IS NOT NULL"""
    )
)
def wb_raw_to_bundle(fx):
    """The readouts of the bundle, and one row with the reason for each scan left out."""
    out = raw_bundle(fx)
    return out.readouts.withColumn("motion", F.round("motion", 4) + 0.0).unionByName(out.quarantined, allowMissingColumns=True)


@query(
    raw_bundle_sql(
        f"""placed AS (SELECT *, row_number() OVER (PARTITION BY scan_id, nex, ky, z ORDER BY acq_idx DESC) AS r FROM mo JOIN why USING (scan_id) WHERE reason IS NULL),
    l AS (SELECT {{'s': scan_id, 'c': c.i, 'n': nex, 'y': ky, 'z': z}} AS scan_id, k.i AS i, re * (k.i + 1) * (c.i + 1) AS re, im * (k.i + 1) * (c.i + 1) AS im FROM placed, generate_series(0, 1) AS c(i), generate_series(0, 7) AS k(i) WHERE r = 1),
    a AS ({line_dft('l', 8, 1)}), m AS (SELECT * FROM a WHERE i BETWEEN 2 AND 5), d AS ({line_dft('m', 4, -1, 2)})
    SELECT scan_id.s AS scan_id, CAST(scan_id.c AS int) AS coil, scan_id.n AS nex, scan_id.y AS ky, scan_id.z AS z, i AS kx, round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im FROM d"""
    )
)
def wb_raw_bundle_lines(fx):
    """The k-space lines of the same bundle, sample by sample."""
    lines = raw_bundle(fx).lines
    keys = ["scan_id", "coil", "nex", "ky", "z"]
    out = kspace.voxels(lines, keys, "kx")
    return out.select(*keys, "kx", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))
