"""From observations and split records to the scans and weather fields they need, and to published tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import keep_one
from ..functions.times import nearest_hour
from ..tables import materialized
from .work import numbered, scan_key, weather_key

# How weather files are named.
WEATHER_PRODUCT, WEATHER_FIELDS = "wrfsfcf00", "wind-temp-blh"

# --- paths and dates -------------------------------------------------------------------------------


def hour_path(date: Column, hour: Column) -> Column:
    """The weather file of a UTC date and hour."""
    day = lambda form: F.date_format(date, form)
    return F.concat(F.lit("raw/"), day("yyyy/MM/dd"), F.lit("/hrrr_"), day("yyyyMMdd"), F.lit("_"), F.lpad(hour.cast("string"), 2, "0"), F.lit(f"z_{WEATHER_PRODUCT}_{WEATHER_FIELDS}.grib2"))


def weather_path(at: Column) -> Column:
    """The weather file nearest to a time, the later of two as near."""
    hour = nearest_hour(at)
    return hour_path(hour.cast("date"), F.hour(hour))


def with_weather_paths(frame: DataFrame, steps: int) -> DataFrame:
    """Adds weather_path_t{i} of each t{i}_timestamp."""
    return frame.withColumns({f"weather_path_t{i}": weather_path(F.col(f"t{i}_timestamp")) for i in range(steps)})


def absolute_paths(text: Column, root: str) -> Column:
    """Paths under root of a JSON list's text; null if it isn't one."""
    return F.transform(F.from_json(text, "array<string>"), lambda p: F.concat(F.lit(root.rstrip("/") + "/"), p))


def bounds_of(aois: DataFrame) -> DataFrame:
    """aoi_id as a whole number, and its bounds."""
    return aois.select(F.col("aoi_id").cast("long").alias("aoi_id"), "lat_min", "lat_max", "lon_min", "lon_max")


def granules_on(granules: DataFrame, dates: DataFrame, start: str = "time_coverage_start") -> DataFrame:
    """Granules that start on one of the dates (scan_date) or on the day after, as scans cross midnight."""
    days = dates.select(F.explode(F.array("scan_date", F.date_add("scan_date", 1))).alias("_day")).distinct()
    return granules.withColumn("_day", F.to_date(start)).join(days, "_day", "left_semi").drop("_day")


def scan_dates(granules: DataFrame, year: int, month: int, start: str = "time_coverage_start") -> DataFrame:
    """The dates of a month's granules."""
    return granules.filter((F.col("year") == year) & (F.col("month") == month)).select(F.to_date(start).alias("scan_date")).distinct()


def month_owners(granules: DataFrame, tasks: int) -> DataFrame:
    """year, month and the task, of so many, that owns it: months go round in order. One row per month goes through one task."""
    months = granules.select("year", "month").distinct()
    return months.withColumn("task", ((F.row_number().over(Window.orderBy("year", "month")) - 1) % tasks).cast("int"))


def by_locality(frame: DataFrame, hour: str = "emissions_hour_utc", index: str = "record_index") -> DataFrame:
    """Adds `place` from 0 by hour, whole degree of latitude and of longitude, aoi_id and source index, so that neighbours share a shard."""
    tiles = frame.withColumns({"_lat": F.floor("lat"), "_lon": F.floor("lon")})
    return numbered(tiles, [hour, "_lat", "_lon", "aoi_id", index]).drop("_lat", "_lon")


# --- records and what they need --------------------------------------------------------------------


def candidate_pool(observations: DataFrame, aois: DataFrame) -> DataFrame:
    """One observation of each AOI, scan date and scan number, with the AOI's place and its weather file; of several the earliest, then that of the least paths."""
    rows = observations.join(aois.select("aoi_id", "lat", "lon"), "aoi_id")
    return keep_one(rows, ["aoi_id", "scan_date", "scan_num"], F.col("tempo_time"), F.col("granule_paths")).withColumn("weather_path", weather_path(F.col("tempo_time")))


def record_needs(records: DataFrame, steps: int, root: str, fields: list[str]) -> DataFrame:
    """One row per record, step and kind (scan, weather): cache key, source paths, and an error where a path is missing.

    records: split, record_index, aoi_id, lon, lat and, by step, no2_paths_t{i} (a JSON list's text) and weather_path_t{i}.
    """
    ids = ["split", "record_index", "aoi_id", "lon", "lat"]
    each = [F.struct(F.lit(i).alias("step"), F.col(f"no2_paths_t{i}").alias("text"), F.col(f"weather_path_t{i}").alias("weather")) for i in range(steps)]
    rows = records.select(*ids, F.explode(F.array(*each)).alias("_s")).select(*ids, "_s.step", "_s.weather", F.array_sort(absolute_paths(F.col("_s.text"), root)).alias("paths"))
    weather, paths, at = F.col("weather"), F.col("paths"), F.col("step").cast("string")
    bad = F.coalesce((F.size(paths) < 1) | F.exists(paths, lambda p: p.isNull()), F.lit(True))
    scan = F.struct(F.lit("scan").alias("kind"), F.when(~bad, scan_key(F.col("aoi_id"), F.col("lon"), F.col("lat"), paths)).alias("key"), F.when(~bad, paths).alias("paths"), F.when(bad, F.concat(F.lit("no scan paths at step "), at)).alias("error"))
    field = F.struct(F.lit("weather").alias("kind"), F.when(weather.isNotNull(), weather_key(F.col("aoi_id"), fields, weather)).alias("key"), F.when(weather.isNotNull(), F.array(weather)).alias("paths"), F.when(weather.isNull(), F.concat(F.lit("no weather path at step "), at)).alias("error"))
    return rows.select(*ids, "step", F.explode(F.array(scan, field)).alias("_n")).select(*ids, "step", "_n.*")


def prepared(needs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Needs of the records that lack nothing, and the others' (split, record_index, error): their first error by step, then kind. The needs are worked out once, and written."""
    needs = materialized(needs, "needs")
    each = needs.groupBy("split", "record_index").agg(F.min(F.when(F.col("error").isNotNull(), F.struct("step", "kind", "error"))).alias("_e"))
    failures = each.filter("_e is not null").select("split", "record_index", F.col("_e.error").alias("error"))
    return needs.join(failures, ["split", "record_index"], "left_anti").drop("error"), failures


def source_batches(needs: DataFrame, cached: DataFrame, kind: str) -> DataFrame:
    """What isn't cached yet, once per key, with the number of keys that are made from the same source paths, which are read once.

    cached: key. Returns paths, batch (a hash of the paths), key, aoi_id, lon, lat, batch_size; written by
    `repartition("batch")`, a batch is one task's. A batch is counted and not gathered.
    """
    wanted = needs.filter((F.col("kind") == kind) & F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct("paths", "aoi_id", "lon", "lat")).alias("_x"))
    missing = wanted.join(cached.select("key").distinct(), "key", "left_anti").select(F.col("_x.paths").alias("paths"), F.sha2(F.to_json(F.col("_x.paths")), 256).alias("batch"), "key", "_x.aoi_id", "_x.lon", "_x.lat")
    return missing.join(missing.groupBy("batch").agg(F.count("*").alias("batch_size")), "batch")


# --- publication -----------------------------------------------------------------------------------


def coverage_summary(frame: DataFrame, by: list[str] | None = None, fraction: str = "min_no2_finite_fraction") -> DataFrame:
    """records, full_coverage_records, full_coverage_fraction (0 of none) and aoi_count."""
    full = F.count_if(F.col(fraction) >= 1.0)
    share = F.coalesce(full / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))
    return frame.groupBy(*(by or [])).agg(F.count("*").alias("records"), full.alias("full_coverage_records"), share.alias("full_coverage_fraction"), F.count_distinct("aoi_id").alias("aoi_count"))


def published(source: DataFrame, features: DataFrame, failures: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Source records with their features and raster_bundle_path under root, and by split source_records, generated_records, processing_failures and coverage.

    source: split, record_index; features: split, record_index, raster_path, min_no2_finite_fraction; failures:
    split, record_index, error. A raster outside root is an error.
    """
    prefix = root.rstrip("/") + "/"
    relative = F.when(F.startswith("raster_path", F.lit(prefix)), F.expr(f"substring(raster_path, {len(prefix) + 1})")).otherwise(F.raise_error(F.concat(F.lit("outside the dataset: "), F.coalesce("raster_path", F.lit("null")))))
    rows = source.join(features, ["split", "record_index"]).withColumn("raster_bundle_path", relative).drop("raster_path")
    n = lambda df, name: df.groupBy("split").agg(F.count("*").alias(name))
    report = n(source, "source_records").join(coverage_summary(rows, ["split"]), "split", "left").join(n(failures, "processing_failures"), "split", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("records", "full_coverage_records", "aoi_count", "processing_failures")}
    return rows, report.withColumns(zero | {"full_coverage_fraction": F.coalesce("full_coverage_fraction", F.lit(0.0))}).withColumnRenamed("records", "generated_records")


def write_shards(frame: DataFrame, path: str, size: int, index: str = "record_index") -> None:
    """A split's rows (with `place`) as Parquet by split and shard of `size` places, sorted by source index; only the shards that are there are replaced."""
    rows = frame.withColumn("shard", F.floor(F.col("place") / size).cast("int")).repartition("split", "shard").sortWithinPartitions("split", "shard", index)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("split", "shard").parquet(path)


def read_shard(spark, path: str, split: str, shard: int, size: int) -> DataFrame:
    """One shard's rows; another number of rows than planned is an error."""
    rows = spark.read.parquet(path).filter((F.col("split") == split) & (F.col("shard") == shard))
    if (n := rows.count()) != size:
        raise ValueError(f"{n} rows in shard {shard} of {split}, not {size}")
    return rows


def content_hashes(spark, path: str) -> DataFrame:
    """path and SHA-256 of each file that isn't empty; empty ones give no row."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def combined_hash(hashes: DataFrame, order: str = "path") -> DataFrame:
    """SHA-256 of the files' hashes in order: it changes with any file. Manifests are few."""
    return hashes.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "sha256"))), lambda x: x["sha256"]), ""), 256).alias("sha256"))


def discovered(progress: DataFrame, by: str = "split") -> DataFrame:
    """Records that all workers have found so far."""
    return progress.groupBy(by).agg(F.coalesce(F.sum("record_count"), F.lit(0)).alias("records"))


def kept_discoveries(candidates: DataFrame, index: DataFrame, targets: dict[str, int]) -> DataFrame:
    """Of each split the first `target` candidates, by candidate_index, that the validity index calls valid, and those before them that still have no outcome.

    candidates: split, candidate_index, cache_key. A discovery that is taken up again tries
    only the latter. Places are counted by sorted ranges, not in one task a split.
    """
    rows = candidates.join(index.select("cache_key", "status"), "cache_key", "left").filter("status is null or status = 'valid'")
    rows = numbered(rows, ["candidate_index", "cache_key"], ["split"])
    target = F.coalesce(*(F.when(F.col("split") == s, F.lit(n)) for s, n in targets.items()), F.lit(0))
    return rows.filter(F.col("place") < target)
