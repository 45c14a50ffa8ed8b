"""Scan tables derived from the given event, image and order tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: View name to (table, SQL). ``$us`` stands for a timestamp's microseconds.
FIXTURES = {
    "fx_read": """SELECT user_id AS scan_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS bigint) AS acq_idx,
        CAST($us AS double) / 1e6 AS t, CAST($us AS bigint) AS acq_ts, event_id * 7 % 8 AS ky, event_id * 3 % 2 AS kz, event_id % 2 AS nex, event_id % 3 AS slice,
        CAST(0 AS bigint) AS coil, CAST(CASE WHEN event_id % 10 = 0 THEN 262144 ELSE 0 END AS bigint) AS flags, value AS re, -value / 2 AS im FROM events WHERE event_type = 'purchase'""",
    "fx_sensor": """SELECT user_id AS scan_id, CAST($us AS double) / 1e6 AS t, CAST($us AS bigint) AS us, event_id % 2 AS channel, event_id % 3 AS sensor_id, event_id AS idx, value AS y FROM events WHERE event_type = 'view'""",
    "fx_trig": """SELECT user_id AS scan_id, CASE WHEN event_type = 'signup' THEN 'start' ELSE 'stop' END AS kind, CAST($us AS bigint) AS t FROM events WHERE event_type IN ('signup', 'error')""",
    "fx_mev": """SELECT user_id AS scan_id, event_id % 16 AS t0, value / 100 AS amplitude, event_id FROM events WHERE event_type = 'click'""",
    "fx_grid": """SELECT l_orderkey AS scan_id, CAST(l_linenumber AS bigint) AS ky, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS bigint) AS acq_idx, l_extendedprice AS re, -l_quantity AS im FROM lineitem""",
    "fx_img": """SELECT vec_id AS scan_id, CAST(label AS bigint) AS grp, CAST($pos AS bigint) AS voxel, CAST($val AS double) AS re, CAST($val AS double) / 2 AS im FROM ($explode) e""",
}
_DIALECT = {
    "spark": {"$us": "unix_micros(CAST(ts AS timestamp))", "$pos": "pos", "$val": "val", "$explode": "SELECT vec_id, label, posexplode(embedding) AS (pos, val) FROM embeddings"},
    "duckdb": {"$us": "epoch_us(ts)", "$pos": "pos", "$val": "val", "$explode": "SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS val FROM embeddings"},
}
_TABLES = ("events", "lineitem", "embeddings")


def _text(name: str, dialect: str) -> str:
    sql = FIXTURES[name]
    for a, b in _DIALECT[dialect].items():
        sql = sql.replace(a, b)
    return sql


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the tables of a folder."""
    sql = _text(name, "spark")
    used = [t for t in _TABLES if re.search(rf"\b{t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b{t}\b", f"{{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_fixtures(sql: str) -> str:
    """DuckDB SQL with the fixture views that it names in front."""
    used = [n for n in FIXTURES if re.search(rf"\b{n}\b", sql)]
    views = ", ".join(f"{n} AS ({_text(n, 'duckdb')})" for n in used)
    sql = sql.strip()
    if not views:
        return sql
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", sql):
        return f"WITH {m[1] or ''}{views}, {sql[m.end():]}"
    return f"WITH {views} {sql}"
