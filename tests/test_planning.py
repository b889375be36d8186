"""Metadata, zones, masks, plans and publication, against values worked out by hand."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from plumeworks.operators import candidates, masks, metrics, zones
from plumeworks.plans import planning, work
from plumeworks.sources import granules
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def values(spark, column, kind, rows):
    return [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}").orderBy("i").select(column(F.col("x"))).collect()]


def test_times_with_and_without_zone(spark):
    utc = lambda x: F.date_format(granules.parse_utc(x), "yyyy-MM-dd HH:mm:ss")
    got = values(spark, utc, "string", ["2024-03-01T10:00:00Z", "2024-03-01T10:00:00+01:00", " 2024-03-01T10:00:00 ", "2024-03-01", "soon", None, ""])
    assert got == ["2024-03-01 10:00:00", "2024-03-01 09:00:00", "2024-03-01 10:00:00", "2024-03-01 00:00:00", None, None, None]


def test_footprints_that_cannot_be(spark):
    texts = ["POLYGON ((1 2, 3 2, 3 5, 1 2))", "POLYGON((2 1, 2 3, 5 3, 2 1))", "POLYGON ((1 2, 3 2, 3 5, 1 3))", "POLYGON ((1 2, 3 2, 1 2))", "POLYGON ((1 2, a 2, 3 5, 1 2))", "POINT (1 2)", "", None, "POLYGON ((9 2, 3 2, 3 5, 9 2))"]
    rows = spark.createDataFrame([(i, t, 1.0, 3.0, 2.0, 5.0) for i, t in enumerate(texts)], "i int, bounds_text string, lon_min double, lon_max double, lat_min double, lat_max double")
    got = granules.footprints(rows).orderBy("i").collect()
    assert [r["error"] is None for r in got] == [True, True] + [False] * 7
    assert [tuple(p) for p in got[0]["footprint"]] == [tuple(p) for p in got[1]["footprint"]] == [(1, 2), (3, 2), (3, 5), (1, 2)]
    assert all(r["footprint"] is None for r in got[2:])


def test_array_files_round_trip(spark, tmp_path):
    x = np.arange(6, dtype=np.float32).reshape(2, 3)
    np.savez_compressed(tmp_path / "a.npz", no2=x, t=np.ones((2, 3)))
    np.savez_compressed(tmp_path / "b.npz", no2=x, t=np.full((2, 3), np.nan))
    np.savez_compressed(tmp_path / "c.npz", no2=x)
    rows = granules.read_bundles(spark, str(tmp_path))
    first = rows.filter("path like '%a.npz' and name = 'no2'").collect()
    assert [(r["shape"], r["values"]) for r in first] == [([2, 3], x.ravel().tolist())]
    assert {r["path"][-5:]: r["clean"] for r in granules.clean_bundles(rows, ["no2", "t"], 6).collect()} == {"a.npz": True, "b.npz": False, "c.npz": False}
    assert dict(granules.as_rasters(rows, ["values"]).dtypes)["values"] == "array<float>"


def test_only_major_cities(spark):
    places = spark.createDataFrame([(1.0, 2.0, 500_000), (3.0, 4.0, 499_999), (5.0, 6.0, None)], "lon double, lat double, pop_max long")
    assert [tuple(r) for r in granules.major_cities(places).collect()] == [(1.0, 2.0)]


def test_standard_offsets(spark):
    assert values(spark, zones.standard_offset_hours, "string", ["America/Denver", "America/Phoenix", "Pacific/Honolulu", "America/Puerto_Rico", "Australia/Sydney", "UTC", None]) == [-7, -7, -10, -4, 10, 0, None]
    with pytest.raises(PySparkException):
        values(spark, zones.standard_offset_hours, "string", ["Asia/Kolkata"])


def test_zones_by_slanted_rings(spark):
    rings = spark.createDataFrame([("America/Denver", [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]), ("America/Chicago", [(4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (4.0, 0.0)])], "time_zone string, ring array<struct<x: double, y: double>>")
    places = lambda *rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "facility_id long, lon double, lat double")
    assert [r["time_zone"] for r in zones.with_zones(places((1.0, 1.0), (3.0, 3.0), (1.9, 1.9), (2.1, 2.1)), rings).orderBy("facility_id").collect()] == ["America/Denver", "America/Chicago", "America/Denver", "America/Chicago"]
    for bad in ((9.0, 9.0), (None, 1.0)):
        with pytest.raises(PySparkException):
            zones.with_zones(places(bad), rings).collect()


def test_gaps_grow_from_a_records_own_numbers(spark):
    ids = [f"r{i}" for i in range(40)] + [None]
    got = values(spark, lambda x: masks.visible_mask(x, 3, 24, 24), "string", ids)
    again = values(spark, lambda x: masks.visible_mask(x, 3, 24, 24), "string", ids[::-1])[::-1]
    assert got == again and got[-1] is None and got[0] != got[1]
    hidden = np.array([1 - np.array(m).reshape(24, 24) for m in got[:-1]])
    assert all(round(0.01 * 576) <= h.sum() <= round(0.15 * 576) for h in hidden)
    ring = np.ones((24, 24), bool)
    ring[3:-3, 3:-3] = False
    assert hidden[:, ring].mean() > 2 * hidden[:, ~ring].mean()
    share = np.random.default_rng(int.from_bytes(hashlib.sha256(b"3:r0").digest()[:8], "little")).uniform(0.01, 0.15)
    assert hidden[0].sum() == max(1, round(share * 576))


def mask_by_one_loop(identifier, seed, rows, cols):
    """One mask, a cell at a time, its border kept in a dictionary in order of arrival."""
    rng, edge = masks.stream(identifier, seed), masks.edge_weights(rows, cols)
    left = max(1, round(rng.uniform(0.01, 0.15) * rows * cols))
    hidden, border = set(), {}
    for _ in range(left):
        if border and rng.random() < 0.94:
            pool = list(border)
            odds = np.array([edge[c] * (1 + border[c]) ** 2 for c in pool])
        else:
            pool = [c for c in range(rows * cols) if c not in hidden]
            odds = edge[pool]
        cell = pool[rng.choice(len(pool), p=odds / odds.sum())]
        hidden.add(cell)
        border.pop(cell, None)
        for r in range(max(0, cell // cols - 1), min(rows, cell // cols + 2)):
            for c in range(max(0, cell % cols - 1), min(cols, cell % cols + 2)):
                if r * cols + c not in hidden:
                    border[r * cols + c] = border.get(r * cols + c, 0) + 1
    return [int(c not in hidden) for c in range(rows * cols)]


@pytest.mark.parametrize(("rows", "cols", "n"), [(24, 24, 150), (1, 1, 3), (1, 7, 40), (9, 2, 40)])
def test_masks_that_grow_together_equal_those_of_one_loop(rows, cols, n):
    ids = [f"r{i}" for i in range(n)]
    assert masks.grown(ids, 7, rows, cols).tolist() == [mask_by_one_loop(i, 7, rows, cols) for i in ids]


def test_masks_of_fixed_seeds():
    assert [np.flatnonzero(masks.grown(["a"], s, 6, 6)[0] == 0).tolist() for s in (1, 2, 3)] == [[26, 31], [16, 17, 22, 23, 30], [17, 23]]


def test_paths_of_lists(spark):
    got = values(spark, lambda x: planning.absolute_paths(x, "/a/"), "string", ['["x","y"]', "[]", "no list", None])
    assert got == [["/a/x", "/a/y"], [], None, None]


def test_bounds_rows_and_dates(spark):
    rows = spark.createDataFrame([("7", 1.0, 2.0, 3.0, 4.0, "x")], "aoi_id string, lat_min double, lat_max double, lon_min double, lon_max double, other string")
    assert tuple(planning.bounds_of(rows).first()) == (7, 1.0, 2.0, 3.0, 4.0)
    g = spark.createDataFrame([(i, dt.datetime(2024, 1, 30, 23) + dt.timedelta(days=i)) for i in range(4)], "i int, time_coverage_start timestamp_ntz")
    days = spark.createDataFrame([(dt.date(2024, 1, 31),)], "scan_date date")
    assert sorted(r["i"] for r in planning.granules_on(g, days).collect()) == [1, 2]


def test_needs_batches_and_cache(spark):
    rows = [("train", 1, 5, 1.0, 2.0, '["b","a"]', "w"), ("train", 2, 5, 1.0, 2.0, '["a","b"]', "w"), ("val", 1, 6, 1.0, 2.0, '["a","b"]', "w"), ("val", 2, 6, 1.0, 2.0, None, None), ("val", 3, 6, 1.0, 2.0, "[null]", "w")]
    needs = planning.record_needs(spark.createDataFrame(rows, "split string, record_index long, aoi_id long, lon double, lat double, no2_paths_t0 string, weather_path_t0 string"), 1, "/r", ["t"])
    good, failed = planning.prepared(needs)
    assert sorted(tuple(r) for r in failed.collect()) == [("val", 2, "no scan paths at step 0"), ("val", 3, "no scan paths at step 0")]
    none = good.limit(0)
    scans = planning.source_batches(good, none, "scan").collect()
    assert sorted((r["aoi_id"], r["batch_size"]) for r in scans) == [(5, 2), (6, 2)]  # paths in another order are the same scan
    cached = good.filter("aoi_id = 5")
    assert [(r["aoi_id"], r["batch_size"]) for r in planning.source_batches(good, cached, "weather").collect()] == [(6, 1)]


def test_publication_and_shards(spark, tmp_path):
    source = spark.createDataFrame([("train", i, i % 2) for i in range(5)], "split string, record_index long, aoi_id long")
    made = spark.createDataFrame([("train", i, f"/d/r/{i}", 1.0 if i else 0.9) for i in range(4)], "split string, record_index long, raster_path string, min_no2_finite_fraction double")
    failed = spark.createDataFrame([("train", 4, "x")], "split string, record_index long, error string")
    rows, report = planning.published(source, made, failed, "/d/")
    assert sorted(r["raster_bundle_path"] for r in rows.collect()) == ["r/0", "r/1", "r/2", "r/3"]
    assert report.first().asDict() == {"split": "train", "source_records": 5, "generated_records": 4, "full_coverage_records": 3, "full_coverage_fraction": 0.75, "aoi_count": 2, "processing_failures": 1}
    assert planning.published(source, made.limit(0), failed, "/d")[1].first()["full_coverage_fraction"] == 0
    with pytest.raises(PySparkException):
        planning.published(source, made, failed, "/other")[0].collect()
    planning.write_shards(source.withColumn("place", F.col("record_index")), str(tmp_path / "s"), 2)
    assert sorted(r["record_index"] for r in planning.read_shard(spark, str(tmp_path / "s"), "train", 1, 2).collect()) == [2, 3]
    with pytest.raises(ValueError):
        planning.read_shard(spark, str(tmp_path / "s"), "train", 2, 2)


def test_hashes_of_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"one")
    (tmp_path / "b").write_bytes(b"two")
    each = planning.content_hashes(spark, str(tmp_path))
    want = [hashlib.sha256(x).hexdigest() for x in (b"one", b"two")]
    assert sorted(r["sha256"] for r in each.collect()) == sorted(want)
    assert planning.combined_hash(each).first()[0] == hashlib.sha256("".join(want).encode()).hexdigest()


def test_progress_is_summed(spark):
    rows = spark.createDataFrame([("train", 3), ("train", 4), ("val", None)], "split string, record_count long")
    assert {r["split"]: r["records"] for r in planning.discovered(rows).collect()} == {"train": 7, "val": 0}


def test_eligible_takes_only_finite(spark):
    fine = {"t0_nox": 1.0, "avg_heat_input": 1.0, "avg_gross_load": 1.0, "city_km": 1.0}
    rows = [fine] + [fine | {c: v} for c in fine for v in (float("nan"), float("inf"), None)]
    frame = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} double" for c in fine))
    assert [r["i"] for r in candidates.eligible(frame, 1).collect()] == [0]


def test_chosen_aois_and_their_audit(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(f, f, at, 1.0, float(f), None) for f in (1, 2, 3)]
    records = spark.createDataFrame(rows, "facility_id long, unit_id long, hour timestamp_ntz, op_time double, nox_mass double, flag string")
    members = spark.createDataFrame([(i, i) for i in (1, 2, 3, 4)], "aoi_id long, facility_id long")
    chosen, audit = candidates.chosen_aois(records, members, 0.5)
    assert sorted((r["aoi_id"], r["aoi_score"]) for r in chosen.collect()) == [(2, 2.0), (3, 3.0)]
    assert sorted((r["aoi_id"], r["has_score"], r["selected"]) for r in audit.collect()) == [(1, True, False), (2, True, True), (3, True, True), (4, False, False)]


def test_gain_of_the_second_model(spark):
    rows = [(a, float(a), 1, 1, int(a > 1)) for a in (1, 2, 3)]
    frame = spark.createDataFrame(rows, "aoi_id long, v double, truth int, x int, y int")
    got = {r["stratum"]: (r["x_accuracy"], r["y_accuracy"], r["accuracy_gain"]) for r in metrics.gain_by_tertile(frame, "v", "x", "y").collect()}
    assert got == {"Low": (1, 0, -1), "Middle": (1, 1, 0), "High": (1, 1, 0)}


def test_sums_and_places_over_ranges(spark):
    rows = [(g, i * 7 % 50, i) for g in ("a", "b") for i in range(50)]
    frame = spark.createDataFrame(rows, "g string, k long, v long").repartition(7)
    got = {(r["g"], r["k"]): r["s"] for r in work.summed_before(frame, ["k"], ["g"], {"s": "v"}).collect()}
    assert got == {(g, k): sum(v for h, j, v in rows if h == g and j < k) for g, k, _ in rows}
    kept = work.trimmed(frame.withColumnsRenamed({"g": "split", "k": "candidate_index"}), {"a": 3, "c": 2}).collect()
    assert sorted((r["split"], r["candidate_index"], r["new_index"]) for r in kept) == [("a", 0, 0), ("a", 1, 1), ("a", 2, 2)]
    none = frame.limit(0)
    assert work.summed_before(none, ["k"], ["g"], {"s": "v"}).collect() == []
