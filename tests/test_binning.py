"""k-means of scans with as few samples as states, and of centres that are joined."""

import pytest

from motionlake.operators import binning


@pytest.mark.parametrize("most", [binning.BROADCAST_BYTES, 0])
def test_scan_of_just_k_samples_with_equal_values(spark, monkeypatch, most):
    """An empty cluster has no spare sample to start from again; the index into the empty array was an error."""
    monkeypatch.setattr(binning, "BROADCAST_BYTES", most)
    rows = [(1, 0, 2.0), (1, 1, 2.0), (1, 2, 2.0), (2, 0, 1.0), (2, 1, 1.0), (2, 2, 5.0), (3, 0, 1.0), (3, 1, 2.0)]
    got = binning.bin_motion(spark.createDataFrame(rows, "scan_id long, line_idx long, motion double"), 3, 4).collect()
    assert sorted((r.scan_id, r.line_idx) for r in got) == [(s, i) for s in (1, 2) for i in range(3)]
    assert all(r.center == r.motion for r in got)
    assert len({r.label for r in got if r.scan_id == 2}) == 2


def test_sample_midway_between_centres_goes_to_the_lower(spark):
    """35.75 lies midway between means 26.23 and 45.27; sums in the rows' order put the latter at 45.269999999999996, which took the sample."""
    values = {40082854: 18.19, 40044083: 22.33, 40063033: 26.23, 40029313: 35.75, 40060352: 38.68, 40034005: 43.74, 40015384: 52.98, 40031172: 55.2, 40068672: 110.74, 40012690: 120.87, 40046956: 132.25, 40040942: 134.78, 40019979: 135.23}
    want = [22.25, 126.774, 39.39, 54.09]
    for order in (sorted, lambda rows: sorted(rows, key=lambda r: r[2])):
        rows = order([(4000162, i, y) for i, y in values.items()])
        got = binning.bin_motion(spark.createDataFrame(rows, "scan_id long, line_idx long, motion double"), 4).collect()
        assert {(r.label, round(r.center, 9)) for r in got} == {(i, c) for i, c in enumerate(want)}


def test_exact_sums_at_all_sizes(spark):
    """Sums in whole units do not depend on order; moduli beyond them, and infinite ones, fall back to plain sums."""
    rows = [(s, i, x * f) for s, f in ((1, 1.0), (2, 1e-200), (3, -1e200), (4, 1e-300), (5, 0.0)) for i, x in enumerate((0.1, 0.2, 0.3, 7.0, 7.2))]
    rows += [(6, 0, 1.0), (6, 1, 2.0), (6, 2, float("inf"))]
    got = binning.bin_motion(spark.createDataFrame(rows, "scan_id long, line_idx long, motion double"), 2, 5).collect()
    assert len(got) == 28
    for s, f in ((1, 1.0), (2, 1e-200), (3, -1e200), (4, 1e-300)):
        near = {r.line_idx: r.center / f for r in got if r.scan_id == s}
        assert all(abs(near[i] - (0.2 if i < 3 else 7.1)) < 1e-9 for i in range(5))


def test_means_midway_between_two_decimals_are_rounded_as_in_sql(spark, tmp_path):
    """A mean of 32 cents has seven decimals; rounded as a decimal it went up where SQL goes down."""
    import datetime

    import duckdb

    from motionlake.jobs.queries import QUERIES, SQL

    each = [0.06] * 31 + [0.15] + [v for v in (10.0, 20.0, 30.0) for _ in range(32)]
    at = datetime.datetime(2024, 1, 1)
    rows = [(u * 1000 + i, at, u, "view", v, "") for u in range(20) for i, v in enumerate(each)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in QUERIES["a6_bin_motion"](spark, str(tmp_path)).select("scan_id", "line_idx", "label", "center").collect()}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = set(duck.execute(f"SELECT scan_id, line_idx, label, center FROM ({SQL['a6_bin_motion']})").fetchall())
    assert any(r[3] == 0.062812 for r in want)
    assert got == want
