"""What larger tables bring about: late years, pairs of scans in a second, many areas of a place, few clusters."""


from plumeworks.functions import times
from pyspark.sql import functions as F


def test_gps_microseconds_of_late_years(spark):
    seconds = [5_999_999 * 130000.0 + 0.25, 46828800.5, -0.75]
    got = [r.m for r in spark.createDataFrame([(s,) for s in seconds], "s double").select(F.unix_micros(times.gps_to_utc(F.col("s"))).alias("m")).collect()]
    assert got == [(5_999_999 * 130000 + 315964800 - 18) * 1_000_000 + 250_000, (46828800 + 315964800 - 1) * 1_000_000 + 500_000, 315964800 * 1_000_000 - 750_000]


def test_windows_within_a_second_are_no_error(spark):
    from plumeworks.operators import sequence

    t = "timestamp_ntz '2024-01-01 05:00:00.1'"
    windows = spark.sql(f"SELECT 1L AS aoi_id, 1L AS k, {t} AS previous, {t} + interval 300 milliseconds AS current UNION ALL SELECT 1L, 2L, {t}, {t} + interval 2 seconds")
    hourly = spark.sql("SELECT 1L AS aoi_id, timestamp_ntz '2024-01-01 05:00:00' AS hour, 3D AS delta_nox")
    got = {r.k: r.delta_nox for r in sequence.overlap_weighted(windows, hourly, ("k",)).collect()}
    assert got[1] != got[1] and got[2] == 3.0


def test_few_clusters_and_lacking_classes_are_no_error_unless_strict(spark):
    from plumeworks.operators import splits

    counts = spark.createDataFrame([(1, 3, [1, 1, 1])], "cluster long, records long, counts array<long>")
    assert [tuple(r) for r in splits.greedy_splits(counts, "cluster", strict=False).collect()] == [(1, "train")]
    assert splits.greedy_splits(counts.limit(0), "cluster", strict=False).count() == 0
    frame = spark.createDataFrame([("train", "a", 1, 0.0, 1.0), ("val", "a", 2, 0.0, 1.0), ("val", "b", 3, 0.0, 1.0)], "split string, label string, id long, innovation double, threshold double")
    got = splits.balanced(frame, "label", ("a", "b"), ["id"], "a", strict=False).select("split", "id")
    assert sorted(map(tuple, got.collect())) == [("val", 2), ("val", 3)]


def test_areas_of_a_place_share_sums_and_ranks(spark):
    from plumeworks.operators import activity, aoi

    spots = spark.range(40).select(F.col("id").alias("facility_id"), (F.col("id") % 4 * 1e6).alias("x"), F.lit(0.0).alias("y"))
    sites = aoi.sites(spots, spots.withColumnRenamed("facility_id", "aoi_id"))
    assert sites.reach.count() == 4
    rows = spots.select("facility_id", F.col("facility_id").alias("unit_id"), F.lit(1.0).alias("op_time"), (F.col("facility_id") * 0.1).alias("nox_mass"), F.lit("h").alias("hour"), F.lit(None).cast("string").alias("flag"), F.lit("coal").alias("fuel"), F.lit(None).cast("string").alias("attribute_fuel"), F.lit(2.0).alias("heat_input"), F.lit(3.0).alias("gross_load"), F.col("facility_id").cast("double").alias("capacity_mw"))
    pairs = aoi.membership(spots, spots.withColumnRenamed("facility_id", "aoi_id"))
    assert pairs.count() == 400
    for made in (activity.operating_characteristics, activity.activity_features, activity.static_characteristics, activity.clean_hours):
        wanted = {r["aoi_id"]: r.asDict() for r in made(rows, pairs).collect()}
        got = {r["aoi_id"]: r.asDict() for r in made(rows, sites).collect()}
        assert {k: {c: round(v, 9) if isinstance(v, float) else v for c, v in r.items()} for k, r in got.items()} == {k: {c: round(v, 9) if isinstance(v, float) else v for c, v in r.items()} for k, r in wanted.items()}
    scores = activity.operating_characteristics(rows, sites)
    assert scores.select("active_median_nox").distinct().count() == 4


def test_clusters_of_areas_that_share_places(spark):
    from plumeworks.operators import aoi

    rows = [(7, 0.0, 0.0), (3, 0.0, 0.0), (5, 60000.0, 0.0), (9, 60000.0, 0.0), (1, None, 0.0), (2, None, 0.0), (4, 1e7, 0.0)]
    got = aoi.clusters(spark.createDataFrame(rows, "aoi_id long, x double, y double"))
    assert {r.aoi_id: r.cluster for r in got.collect()} == {7: 3, 3: 3, 5: 3, 9: 3, 1: 1, 2: 2, 4: 4}


def test_boxes_and_scans_that_are_alike_are_tried_once(spark, monkeypatch):
    from plumeworks.operators import mapping

    seen = []
    real = mapping._polygon_scans
    monkeypatch.setattr(mapping, "_polygon_scans", lambda b, f, s: seen.append((b.count(), f.count())) or real(b, f, s))
    boxes = spark.createDataFrame([(k, 0.2, 0.2, 0.8, 0.8) for k in range(5)], "aoi_id long, x0 double, y0 double, x1 double, y1 double")
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    prints = spark.createDataFrame([(s, f"g{s}", ring) for s in range(3)], "scan long, granule string, footprint array<struct<x: double, y: double>>")
    got = sorted((r.aoi_id, r.scan, tuple(r.granules)) for r in mapping.polygon_scans(boxes, prints).collect())
    assert got == [(a, s, (f"g{s}",)) for a in range(5) for s in range(3)] and seen == [(1, 1)]


def test_requests_of_one_centre_are_sampled_once(spark, monkeypatch):
    from plumeworks.operators import weather

    seen = []
    real = weather.cell_centres
    monkeypatch.setattr(weather, "cell_centres", lambda df, *a: seen.append(df.count()) or real(df, *a))
    grid = weather.ConicGrid.from_first_point(-96.6, 36.9, parallel=38.5, lon_0=-97.5, dx=14000.0, dy=13000.0, rows=4, cols=4)
    requests = spark.createDataFrame([("a", 1, 0.0, 1.6e6), ("b", 1, 0.0, 1.6e6)], "key string, path long, x double, y double")
    fields = spark.range(16).selectExpr("1L AS path", "id div 4 AS i", "id % 4 AS j", "1D AS u", "2D AS v", "3D AS t")
    rows = weather.aligned(requests, fields, grid, size=2).collect()
    assert seen == [1] and sorted((r.key, r.cell) for r in rows) == [(k, c) for k in "ab" for c in range(4)]


def test_areas_of_equal_mass_rank_by_id(spark):
    import datetime as dt

    from plumeworks.operators import activity

    hour = dt.datetime(2024, 1, 1)
    parts = {1: [0.1, 0.2], 2: [0.3], 3: [0.29], 4: [1e25, 1.0], 5: [1e-20]}
    rows = [(i, k, hour, 1.0, x, None) for i, xs in parts.items() for k, x in enumerate(xs)]
    rows = spark.createDataFrame(rows, "facility_id long, unit_id long, hour timestamp, op_time double, nox_mass double, flag string")
    members = spark.createDataFrame([(i, i) for i in parts], "aoi_id long, facility_id long")
    got = {r["aoi_id"]: r for r in activity.ranked_scores(activity.operating_characteristics(rows, members)).collect()}
    assert [got[i]["active_median_nox"] for i in parts] == [0.3, 0.3, 0.29, 1e25 + 1.0, 1e-20]
    assert [got[i]["score_rank"] for i in parts] == [3, 4, 2, 5, 1]
    assert all(r["emitting_fraction"] == 1.0 for r in got.values())


def test_observations_are_of_all_pixels(spark):
    from plumeworks.operators import mapping

    pixels = [(g, g % 3, g % 3 * 10.0, 0.1 * g, 0.5) for g in range(8)]
    boxes = spark.createDataFrame([(k, 0.0, 0.65, 0.0, 1.0) for k in (1, 2)], "aoi_id long, lon_min double, lon_max double, lat_min double, lat_max double")
    got = mapping.all_observations(spark.createDataFrame(pixels, "granule long, step long, step_time double, lon double, lat double"), boxes).collect()
    assert sorted((r["aoi_id"], r["sampled_pixels"], round(r["observed_at"], 9)) for r in got) == [(k, 7, round(60 / 7, 9)) for k in (1, 2)]
    assert all([s["granule"] for s in r["steps"]] == list(range(7)) for r in got)


def test_boxes_that_scans_cover_are_paired_without_a_shuffle_of_the_pairs(spark, monkeypatch):
    from plumeworks.operators import mapping

    monkeypatch.setattr(mapping, "PACK", 3, raising=False)
    boxes = spark.createDataFrame([(k, 0.2, 0.2, 0.8, 0.8) for k in range(9)], "aoi_id long, x0 double, y0 double, x1 double, y1 double")
    halves = {"w": [(0.0, 0.0), (0.5, 0.0), (0.5, 1.0), (0.0, 1.0)], "e": [(0.5, 0.0), (1.0, 0.0), (1.0, 1.0), (0.5, 1.0)]}
    prints = [(s, f"{k}{s}", ring) for s in range(20) for k, ring in halves.items()] + [(99, "w99", halves["w"])]
    got = mapping.polygon_scans(boxes, spark.createDataFrame(prints, "scan long, granule string, footprint array<struct<x: double, y: double>>"))
    assert sorted((r.aoi_id, r.scan, tuple(r.granules)) for r in got.collect()) == [(a, s, (f"e{s}", f"w{s}")) for a in range(9) for s in range(20)]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "Generate explode(scans" in plan[: plan.index("Join")]
