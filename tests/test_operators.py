"""Edge cases of operators, against values worked out by hand or by a second way."""

import datetime as dt
import math

import numpy as np
import pytest
from plumeworks.functions import geo
from plumeworks.operators import activity, metrics, raster, sequence, splits
from plumeworks.plans import work
from plumeworks.sources import ingest
from pyspark.sql import functions as F


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_projection_and_back(spark):
    points = spark.createDataFrame([(-96.0, 23.0), (-75.0, 35.0), (-120.5, 48.25), (-96.0, 40.0)], "lon double, lat double")
    x, y = geo.albers(F.col("lon"), F.col("lat"))
    lon, lat = geo.albers_inverse(F.col("x"), F.col("y"))
    for r in points.withColumns({"x": x, "y": y}).select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert abs(r["lon"] - r["lon2"]) < 1e-9 and abs(r["lat"] - r["lat2"]) < 1e-9
    assert points.withColumns({"x": x, "y": y}).first()["x"] == pytest.approx(0, abs=1e-6)


def test_quadrilaterals():
    box = np.array([[0.0, 0, 2, 2]])
    area = lambda x, y: raster.clipped_areas(np.array([x], float), np.array([y], float), box)[0]
    assert area([-1, 1, 1, -1], [-1, -1, 1, 1]) == pytest.approx(1)
    assert area([1, 3, 1, -1], [-1, 1, 3, 1]) == pytest.approx(4)
    assert area([0, 1, 0, 1], [0, 1, 1, 0]) == 0  # crossed
    assert area([0, 1, 2, 1], [0, 0, 0, 0]) == 0 and area([5, 6, 6, 5], [5, 5, 6, 6]) == 0


def test_slanted_kernel_equals_the_rectangles(spark):
    rows = [(1, 0.0, 0.0, -4000.0, 5000.0, -100.0, 7000.0, 2.0, 0.2, 0, 1.0), (1, 0.0, 0.0, 4000.0, 8000.0, 100.0, 3000.0, 4.0, 0.2000001, 0, 1.0), (1, 0.0, 0.0, 90000.0, 91000.0, 0.0, 1.0, 4.0, 0.0, 0, 1.0)]
    p = spark.createDataFrame(rows, "key int, x double, y double, bx0 double, bx1 double, by0 double, by1 double, value double, cloud double, flag int, uncertainty double")
    cells = raster.touched_cells(p.withColumns({"cx": F.array("bx0", "bx1", "bx1", "bx0"), "cy": F.array("by0", "by0", "by1", "by1")}))
    both = cells.select(raster.rectangle_area().alias("a"), raster.quad_area("cx", "cy", "x0", "y0", "x1", "y1").alias("b")).collect()
    assert both and all(r["a"] == pytest.approx(r["b"], abs=1e-9) for r in both)
    out = raster.tessellated(cells.withColumn("area", raster.rectangle_area()), ["key"]).collect()
    assert sum(r["total_area"] for r in out) == pytest.approx((9 * 7.1) + 4 * 2.9)
    assert sum(r["accepted_count"] for r in out) < sum(r["native_count"] for r in out)
    assert {r["value"] for r in out if r["accepted_count"]} == {2.0} and any(math.isnan(r["value"]) for r in out)


def test_flags_and_clean_hours(spark):
    flags = spark.createDataFrame([(None,), (" INVALID x",), ("Measured",), ("unavailable",)], "f string").select(activity.usable(F.col("f")).alias("u"))
    assert [r["u"] for r in flags.collect()] == [True, False, True, False]
    rows = spark.createDataFrame([(1, 1, 5.0, None), (1, 1, None, None), (1, 2, 5.0, None), (1, 2, float("nan"), None), (1, 3, 5.0, "Invalid")], "facility_id int, hour int, nox_mass double, flag string")
    got = activity.clean_hours(rows, spark.createDataFrame([(9, 1)], "aoi_id int, facility_id int")).collect()
    assert [(r["aoi_id"], r["hour"], r["nox_mass"]) for r in got] == [(9, 1, 5.0)]


def test_sequence_bounds_are_in_cut_off_seconds(spark):
    t = dt.datetime(2024, 1, 1)
    for seconds, n in ((39 * 60 + 59.9, 0), (2400, 1), (4200, 1), (4200.9, 1), (4201, 0)):
        scans = spark.createDataFrame([(1, t), (1, t + dt.timedelta(seconds=seconds))], "aoi_id int, scan_time timestamp_ntz")
        assert sequence.sequences(scans, steps=2).count() == n


def test_capacities_drop_conflicts(spark):
    rows = spark.createDataFrame([(1, 2024, "A (5), A (6), B (x), C (0)"), (1, 2024, None), (2, 2024, "a (5), A (5.0), D(2.5)")], "f int, y int, t string")
    assert {r["f"]: r["mw"] for r in ingest.capacities(rows, "f", "y", "t").collect()} == {1: 0.0, 2: 7.5}


def test_auroc_of_ties_and_of_missing_classes(spark):
    rows = spark.createDataFrame([(i % 3, 1, 1, 1) for i in range(9)], "truth int, a int, b int, c int")
    assert metrics.auroc(rows, ["a", "b", "c"]).first()[0] == 0.5
    assert metrics.auroc(rows.filter("truth < 2"), ["a", "b", "c"]).first()[0] is None


def test_last_clusters_fill_empty_splits(spark):
    counts = spark.createDataFrame([(1, 100, [100]), (2, 1, [1]), (3, 1, [1])], "cluster long, records long, counts array<long>")
    assert {r["split"] for r in splits.greedy_splits(counts, "cluster").collect()} == {"train", "val", "test"}
    with pytest.raises(Exception, match="fewer than 3"):
        splits.greedy_splits(counts.limit(2), "cluster").collect()


def test_runs_of_ids(spark):
    got = work.id_ranges(spark.createDataFrame([(x,) for x in (1, 2, 3, 3, 7, 9, 10, None)], "id long"))
    assert sorted(map(tuple, got.collect())) == [(1, 3), (7, 7), (9, 10)]
    assert work.range_text(got).first()["spec"] == "1-3,7,9-10"
    assert work.id_ranges(spark.createDataFrame([], "id long")).count() == 0


def test_bilinear_keeps_points_that_repeat(spark):
    from plumeworks.operators import raster

    field = spark.createDataFrame([(1, i, j, 1.0) for i in range(3) for j in range(3)], "key int, i int, j int, value double")
    points = spark.createDataFrame([(1, 0.5, 0.5), (1, 0.5, 0.5), (1, 2.5, -1.0)], "key int, fi double, fj double")
    assert [r["value"] for r in raster.bilinear(points, field, 3, 3, ["key"]).collect()] == [1.0, 1.0, 1.0]
