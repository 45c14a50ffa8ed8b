"""Tables written and read back."""

from pyspark.sql import functions as F

from motionlake.sources import tables


def test_bundle_round_trip(spark):
    rows = [(s, z, i, (i * 3 + z) % 8, z, i % 2, float(s + z + i)) for s in (1, 2) for z in (0, 1) for i in range(5)]
    readouts = spark.createDataFrame(rows, "scan_id long, z int, line_idx int, ky int, kz int, nex int, motion double").repartition(3)
    lines = readouts.select("scan_id", "ky", "kz", F.array("motion").alias("re"), F.array(F.lit(0.0)).alias("im"))
    path = tables.shared_path(spark)
    tables.write_bundle(lines, readouts, path)
    back_lines, back = tables.read_bundle(spark, path)
    assert sorted(map(tuple, back.select("scan_id", "z", "line_idx", "ky", "kz", "nex", "motion").collect())) == sorted(rows)
    assert back_lines.count() == len(rows)
    bundle = spark.read.parquet(f"{path}/bundle")
    assert {tuple(r.nex_values) for r in bundle.collect()} == {(0, 1)} and bundle.first().nex_source == "repetition"


def test_results_and_sensors(spark):
    images = spark.createDataFrame([(1, 0, 0, 2.0, 0.0), (1, 1, 0, 4.0, 2.0)], "scan_id long, nex int, voxel long, re double, im double")
    scale = spark.createDataFrame([(1, 10.0)], "scan_id long, scale double")
    path = tables.shared_path(spark)
    tables.write_results(images, scale, scale, path, scale)
    assert [tuple(r) for r in spark.read.parquet(f"{path}/image_mean").collect()] == [(1, 0, 30.0, 10.0)]
    rows = [(1, 0, 0, "BELT", 5, 1.0), (1, 1, 0, "BELT", 5, None), (1, 2, 0, "MARMOT", 5, 2.0), (1, 1, 1, "BELT", 6, float("nan"))]
    path = tables.shared_path(spark)
    spark.createDataFrame(rows, tables.SENSOR_SAMPLES).write.parquet(path)
    assert [(r.sensor_id, r.value) for r in tables.read_sensor(spark, path, "BELT").collect()] == [(0, 1.0)]


def test_flat_image_becomes_zero(spark):
    px = spark.createDataFrame([(1, v, 5.0, 5.0, 5.0) for v in range(4)], "image_id long, voxel long, r double, g double, b double")
    assert {r.v for r in tables.ingest_images(px).collect()} == {0.0}


def test_slices_in_blocks_and_few_files(spark):
    rows = [(s, 0, i, i % 8, 0, 0, float(i)) for s in range(40) for i in range(25 if s == 7 else 3)]
    readouts = spark.createDataFrame(rows, "scan_id long, z int, line_idx int, ky int, kz int, nex int, motion double")
    lines = readouts.select("scan_id", "ky", F.array("motion").alias("re"), F.array(F.lit(0.0)).alias("im"))
    path = tables.shared_path(spark)
    tables.write_bundle(lines, readouts, path, block=10)
    back_lines, back = tables.read_bundle(spark, path)
    assert sorted(map(tuple, back.select("scan_id", "z", "line_idx", "ky", "kz", "nex", "motion").collect())) == sorted(rows)
    blocks = spark.read.parquet(f"{path}/bundle").filter("scan_id = 7").select("first_line", F.size("motion").alias("n")).collect()
    assert sorted(map(tuple, blocks)) == [(0, 10), (10, 10), (20, 5)]
    assert back_lines.count() == len(rows) and len(back_lines.inputFiles()) <= 8


def test_bundle_without_blocks(spark):
    old = spark.createDataFrame([(1, 0, [1.0, 2.0], [3, 4], [0, 0], [0, 1])], "scan_id long, z int, motion array<double>, idx_ky array<int>, idx_kz array<int>, idx_nex array<int>")
    assert [tuple(r) for r in tables.bundle_rows(old).orderBy("line_idx").collect()] == [(1, 0, 0, 3, 0, 0, 1.0), (1, 0, 1, 4, 0, 1, 2.0)]
