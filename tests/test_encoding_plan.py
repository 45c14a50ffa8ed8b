"""Tables of an encoding meet by scan: nothing is shuffled by voxels or cells."""

import re

import pytest

from motionlake.jobs import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["i9_encode", "i10_decode", "i11_normal", "i12_perturb", "i13_maps_adjoint"])
def test_shuffles_are_by_scan(spark, name):
    """Stencils, coil images and cells were each shuffled for every combination of keys that met them."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)
    assert keys and all(re.fullmatch(r"scan_id#\d+L", k) for k in keys), keys


@pytest.mark.parametrize("part", ["probes", "matrix"])
def test_scale_of_a_regulariser_holds_one_probe_in_a_task(spark, monkeypatch, part):
    """A union partitioned by scan put the sorts of all probes in one task; matrices were summed up in parts for each k."""
    made, keep = [], queries.tables.materialize
    monkeypatch.setattr(queries.tables, "materialize", lambda df: made.append(df) or keep(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = queries.QUERIES["i18_regularisation_scale"](spark, SF)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (out, *made)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    if part == "probes":
        assert "Exchange" in plans[0].split("Union")[0]
    else:
        keys = re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plans[1])
        assert len(plans) == 2 and keys and all(re.fullmatch(r"scan_id#\d+L", k) for k in keys), keys


@pytest.mark.parametrize("name", ["i9_encode", "i10_decode", "i11_adjoint_identity", "i11_normal", "i12_perturb", "i13_maps_adjoint", "i13_perturb_adjoint"])
def test_only_rows_of_whole_scans_are_broadcast(spark, name):
    """A stencil was made from few states after their shuffle, which looked small, and went to the driver whole."""
    df = queries.QUERIES[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    keys = re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan)
    assert all(re.fullmatch(r"scan_id#\d+L", k) for k in keys), keys


def test_a_stencil_computes_positions_once(spark):
    """Each of a stencil's entries held the whole computation of its position."""
    states = spark.createDataFrame([(1, 0, 0.5, 0.25, 0.1)], "scan_id bigint, state bigint, tx double, ty double, phi double")
    plan = queries.motion.stencil(queries.motion.rigid_field_2d(states, 8, 8), (8, 8))._jdf.queryExecution().optimizedPlan().toString()
    explodes = [x for x in plan.splitlines() if "Generate explode(array(" in x or "Generate explode([" in x]
    assert explodes and not any("greatest(" in x or "FLOOR(" in x for x in explodes), explodes


def test_images_are_enlarged_where_their_scan_is(spark):
    """Rows of an enlarged image were all made by the one task that read its few small files."""
    image = spark.createDataFrame([(1, 0, v, 1.0 * v, 0.5) for v in range(4)], "scan_id bigint, nex bigint, voxel bigint, re double, im double")
    states = spark.createDataFrame([(1, 0, 0.5, 0.25, 0.1)], "scan_id bigint, state bigint, tx double, ty double, phi double")
    small, large = (spark.createDataFrame([(1, n, n, 1)], "scan_id bigint, nx int, ny int, nz int") for n in (2, 4))
    image, small, large = map(queries.tables.materialize, (image, small, large))
    out = queries.encoding.upsample(image, states, small, large)[0]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.rindex("Generate explode(")] and "Exchange hashpartitioning(scan_id" in plan
    assert out.count() == 16
