"""Batches of shared sources and the shard store, against a second way."""

import math
import random

import numpy as np
import pytest
from plumeworks.operators import batches, raster
from plumeworks.sources import shards
from pyspark.sql import functions as F

PIXEL = "path string, cx array<double>, cy array<double>, value double, cloud double, flag int, uncertainty double"


def some_pixels(rng, n):
    out = []
    for i in range(n):
        x, y, s = rng.uniform(-90000, 90000), rng.uniform(-90000, 90000), rng.uniform(500, 9000)
        corners = [(x, y), (x + s, y + rng.uniform(-s, s) / 3), (x + s + rng.uniform(-s, s) / 3, y + s), (x + rng.uniform(-s, s) / 3, y + s)]
        out.append((f"g{i % 3}", [c[0] for c in corners], [c[1] for c in corners], rng.choice([rng.random(), math.nan]), rng.random() * 0.4, rng.choice([0, 0, 1]), rng.choice([rng.random(), math.nan])))
    return out


@pytest.mark.parametrize(("tile", "areas"), [(288_000.0, 256), (30_000.0, 2)])
def test_each_area_equals_the_raster_of_its_own_pixels(spark, tile, areas):
    rng = random.Random(4)
    pixels = spark.createDataFrame(some_pixels(rng, 400), PIXEL)
    wanted = [(f"k{i}", rng.uniform(-60000, 60000), rng.uniform(-60000, 60000), rng.choice([["g0"], ["g0", "g1"], ["g1", "g0"], ["g2", "g0"]])) for i in range(12)] + [("far", 9e6, 9e6, ["g0"])]
    requests = spark.createDataFrame(wanted, "key string, x double, y double, paths array<string>")
    files = spark.createDataFrame([(f"g{i}", None) for i in range(3)], "path string, error string")
    got = {r["key"]: r for r in batches.regridded(requests, pixels, files, tile=tile, areas=areas).collect()}
    assert len(got) == len(wanted) and all(r["error"] is None for r in got.values())
    cells = raster.touched_cells(raster.with_bounds(requests.withColumn("path", F.explode("paths")).join(pixels, "path")))
    want = raster.full_grid(raster.cells(requests.select("key", "x", "y")), raster.tessellated(cells.withColumn("area", raster.quad_area("cx", "cy", "x0", "y0", "x1", "y1")), ["key"]), ["key"]).collect()
    assert len(want) == 576 * len(wanted)
    for r in want:
        for c in batches.EMPTY:
            assert got[r["key"]][c][r["row"] * 24 + r["col"]] == pytest.approx(float(r[c]), abs=1e-9, nan_ok=True), (r, c)
    assert sum(got["far"]["native_count"]) == 0 and set(got["far"]["worst_flag"]) == {-1.0}


def test_errors_are_kept_by_area(spark):
    square = lambda path, n=4: (path, [0.0, 3000.0, 3000.0, 0.0][:n], [0.0, 0.0, 3000.0, 3000.0][:n], 1.0, 0.0, 0, 1.0)
    pixels = spark.createDataFrame([square("a"), square("bad"), square("odd"), square("odd", 3), ("a", None, None, 1.0, 0.0, 0, 1.0)], PIXEL)
    files = spark.createDataFrame([("a", None), ("bad", "cut short"), ("odd", None), ("bad", None)], "path string, error string")
    rows = [("ok", 0.0, 0.0, ["a"]), ("unread", 0.0, 0.0, ["a", "bad"]), ("gone", 0.0, 0.0, ["a", "zzz"]), ("none", 0.0, 0.0, []), ("null", 0.0, 0.0, None), ("place", None, 0.0, ["a"]), ("nan", math.nan, 0.0, ["a"]), ("odd", 0.0, 0.0, ["odd"]), ("odd but far", 9e5, 0.0, ["odd"])]
    got = {r["key"]: r["error"] for r in batches.regridded(spark.createDataFrame(rows, "key string, x double, y double, paths array<string>"), pixels, files).collect()}
    assert got == {"ok": None, "unread": "reading bad failed: cut short", "gone": "no source zzz", "none": "no source", "null": "no source", "place": "no finite centre", "nan": "no finite centre", "odd": "regridding failed: a footprint hasn't four corners", "odd but far": None}


def test_pixels_are_read_once(spark, tmp_path):
    pixels = spark.createDataFrame(some_pixels(random.Random(1), 30), PIXEL)
    pixels.write.parquet(f"{tmp_path}/pixels")
    requests = spark.createDataFrame([("a", 0.0, 0.0, ["g0", "g1"]), ("b", 0.0, 0.0, ["g0"])], "key string, x double, y double, paths array<string>")
    made = batches.regridded(requests, spark.read.parquet(f"{tmp_path}/pixels"), spark.createDataFrame([("g0", None), ("g1", None)], "path string, error string"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [path") == 1


# --- the shard store -------------------------------------------------------------------------------


def plan_of(spark, n=40):
    return spark.range(n).select(F.when(F.col("id") % 4 > 0, "train").otherwise("val").alias("split"), (F.col("id") / 16).cast("int").alias("shard"), F.col("id").alias("record_index"))


def outcomes_of(spark, n=40):
    rows = plan_of(spark, n).drop("shard")
    error = F.when(F.col("record_index") % 5 == 0, F.concat(F.lit("failed "), F.col("record_index").cast("string")))
    return rows.select("split", "record_index", error.alias("error"), (F.col("record_index") * 1.5).alias("feature"), F.array(F.lit(1.0), F.col("record_index").cast("double")).alias("bundle"))


def test_a_store_reads_back_what_was_written(spark, tmp_path):
    path = f"{tmp_path}/store"
    shards.write_shards(plan_of(spark), outcomes_of(spark), path)
    good, bad = shards.read_shards(spark, path), shards.read_shards(spark, path, "failures")
    assert {(r["split"], r["shard"], r["record_index"], r["feature"]) for r in good.collect()} == {("train" if i % 4 else "val", i // 16, i, i * 1.5) for i in range(40) if i % 5}
    assert {(r["record_index"], r["error"]) for r in bad.collect()} == {(i, f"failed {i}") for i in range(0, 40, 5)}
    one = good.filter("record_index = 7").first()
    assert np.load(one["raster_path"])["bundle"].tolist() == [1.0, 7.0] and "/record-rasters/train/7.npz" in one["raster_path"]
    assert shards.read_shards(spark, path, split="val").select("split").distinct().count() == 1
    assert sum(r["candidates"] + r["failures"] for r in shards.manifest(path)) == 40


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda o: o.filter("record_index <> 11"), "record 11 of train has no outcome"),
        (lambda o: o.unionByName(o.filter("record_index = 13")), "record 13 of train has several outcomes"),
        (lambda o: o.unionByName(o.filter("record_index = 13").withColumn("record_index", F.lit(99).cast("long"))), "record 99 of train isn't planned"),
        (lambda o: o.withColumn("raster_path", F.when(F.col("record_index") == 2, "record-rasters/val/2.npz")), "lies outside record-rasters/train"),
        (lambda o: o.withColumn("raster_path", F.lit("../2.npz")), "lies outside"),
        (lambda o: o.withColumn("raster_path", F.concat(F.lit("record-rasters/"), "split", F.lit("/x.npz"))), "is there twice"),
        (lambda o: o.withColumn("feature", F.when(F.col("record_index") == 39, F.raise_error(F.lit("lost"))).otherwise(F.col("feature"))), "lost"),
    ],
)
def test_a_bad_shard_publishes_nothing(spark, tmp_path, change, message):
    path = f"{tmp_path}/store"
    with pytest.raises(Exception, match=message):
        shards.write_shards(plan_of(spark), change(outcomes_of(spark)), path)
    assert shards.manifest(path) == [] and not list((tmp_path / "store").glob("run-*"))
    shards.write_shards(plan_of(spark), outcomes_of(spark), path)
    before = shards.manifest(path)
    with pytest.raises(Exception, match=message):
        shards.write_shards(plan_of(spark), change(outcomes_of(spark)), path)
    assert shards.manifest(path) == before and len(list((tmp_path / "store").glob("run-*"))) == 1
    with pytest.raises(FileNotFoundError):
        shards.read_shards(spark, f"{tmp_path}/nothing")
