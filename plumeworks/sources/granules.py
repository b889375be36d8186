"""Granule metadata, footprints, native pixels and array bundles, from tables of what a file declares."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.polygons import simple_ring
from ..functions.semantics import finite

# Scan and granule in a file name, the least population of a major city, and the bounds' tolerance in degrees.
NUMBERS = r"_S(\d+)G(\d+)"
MAJOR_CITY = 500_000
BOUNDS_TOLERANCE = 1e-3


def parse_utc(text: Column) -> Column:
    """UTC timestamp of ISO text; text without a zone is UTC, and what isn't a time is null."""
    clean = F.trim(text)
    day = clean.rlike(r"^\d{4}-\d{2}-\d{2}$")
    zoned = clean.rlike(r"(Z|[+-]\d{2}(:?\d{2})?)$")
    return F.try_to_timestamp(F.when(day, F.concat(clean, F.lit("T00:00:00Z"))).when(zoned, clean).otherwise(F.concat(clean, F.lit("Z"))))


def month_directory(base: Column, at: Column) -> Column:
    """base/YYYY/MM of a time."""
    return F.concat_ws("/", base, F.date_format(at, "yyyy/MM"))


def numbers(scan: Column, granule: Column, name: Column) -> tuple[Column, Column]:
    """Scan and granule number by the declared attributes where both are whole numbers, else by the file name; null where that has none."""
    declared = scan.try_cast("int").isNotNull() & granule.try_cast("int").isNotNull()
    by_name = lambda i: F.nullif(F.regexp_extract(name, NUMBERS, i), F.lit("")).try_cast("int")
    return F.when(declared, scan.try_cast("int")).otherwise(by_name(1)), F.when(declared, granule.try_cast("int")).otherwise(by_name(2))


def ring(wkt: Column) -> Column:
    """Points (x, y) of a polygon's outer ring from its text; null without one."""
    body = F.nullif(F.regexp_extract(wkt, r"(?i)^\s*POLYGON\s*\(\s*\(([^()]*)\)", 1), F.lit(""))
    pair = lambda p: F.split(F.trim(p), r"\s+")
    return F.transform(F.split(body, ","), lambda p: F.struct(F.get(pair(p), 0).try_cast("double").alias("x"), F.get(pair(p), 1).try_cast("double").alias("y")))


def footprints(granules: DataFrame) -> DataFrame:
    """Adds `footprint`, points (x: longitude, y: latitude), and `error`, null where all is well.

    granules: bounds_text (a polygon's text, in either order of its coordinates) and the declared
    lat_min, lat_max, lon_min, lon_max. Points whose bounds are those of latitude before longitude
    are turned; bounds that fit neither order, an open ring, one of under four points and one that crosses itself are
    errors, and such rows keep a null footprint.
    """
    p = F.col("_ring")
    xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    extent = [f(v) for f in (F.array_min, F.array_max) for v in (xs, ys)]
    near = lambda names: F.coalesce(F.array_min(F.array(*((F.abs(e - F.col(n)) <= BOUNDS_TOLERANCE).cast("int") for e, n in zip(extent, names, strict=True)))) == 1, F.lit(False))
    whole = F.coalesce(F.forall(p, lambda q: F.coalesce(finite(q["x"]) & finite(q["y"]), F.lit(False))), F.lit(False)) & (F.size(p) >= 4)
    closed = F.coalesce(F.get(p, 0) == F.element_at(p, -1), F.lit(False))
    as_is, turned = near(["lon_min", "lat_min", "lon_max", "lat_max"]), near(["lat_min", "lon_min", "lat_max", "lon_max"])
    error = F.when(~whole | ~closed, "no polygon").when(~as_is & ~turned, "the polygon isn't within the declared bounds").when(~simple_ring(F.col("_ring")), "the polygon crosses itself")
    points = F.when(turned, F.transform(p, lambda q: F.struct(q["y"].alias("x"), q["x"].alias("y")))).otherwise(p)
    rows = granules.withColumn("_ring", ring(F.col("bounds_text"))).withColumn("error", error)
    return rows.withColumn("footprint", F.when(F.col("error").isNull(), points)).drop("_ring")


def filled(x: Column) -> Column:
    """A double, NaN for null."""
    return F.coalesce(x.cast("double"), F.lit(float("nan")))


def valid_pixels(pixels: DataFrame, max_solar_zenith: float | None = None, max_snow_ice: float | None = None) -> DataFrame:
    """Native pixels with finite place, cloud, flag and corners; the limits, where given, take out what is above or unknown. Values may be NaN.

    pixels: value, lon, lat, corner_lon, corner_lat (arrays), cloud, flag, uncertainty, and solar_zenith or snow_ice where limited.
    """
    good = lambda c: F.coalesce(finite(F.col(c).cast("double")), F.lit(False))
    corners = lambda c: F.coalesce(F.forall(c, lambda v: F.coalesce(finite(v), F.lit(False))), F.lit(False))
    keep = good("lon") & good("lat") & good("cloud") & good("flag") & corners("corner_lon") & corners("corner_lat")
    for c, most in (("solar_zenith", max_solar_zenith), ("snow_ice", max_snow_ice)):
        if most is not None:
            keep &= good(c) & (F.col(c) <= most)
    return pixels.filter(keep).withColumns({"value": filled(F.col("value")), "uncertainty": filled(F.col("uncertainty")), "flag": F.col("flag").cast("short")})


def major_cities(places: DataFrame, least: int = MAJOR_CITY) -> DataFrame:
    """lon and lat of the places with at least so many people (pop_max)."""
    return places.filter(F.col("pop_max") >= least).select("lon", "lat")


def read_bundles(spark, path: str) -> DataFrame:
    """path, name, shape and values of each array in the compressed array files under a folder; files are read where Spark puts them, one at a time."""

    def arrays(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with np.load(io.BytesIO(content.as_buffer())) as bundle:
                    for name in bundle.files:
                        x = bundle[name]
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([name]), pa.array([list(x.shape)], pa.list_(pa.int32())), pa.array([x.astype(np.float64).ravel()], pa.list_(pa.float64()))], ["path", "name", "shape", "values"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInArrow(arrays, "path string, name string, shape array<int>, values array<double>")


def clean_bundles(bundles: DataFrame, names: list[str], cells: int = 576) -> DataFrame:
    """path and `clean`: whether every named array is there once, with so many values, all finite."""
    good = (F.size("values") == cells) & F.forall("values", lambda v: F.coalesce(finite(v), F.lit(False)))
    n = bundles.filter(F.col("name").isin(names)).groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("name").alias("d"), F.bool_and(good).alias("g"))
    return bundles.select("path").distinct().join(n, "path", "left").select("path", F.coalesce((F.col("n") == len(names)) & (F.col("d") == len(names)) & F.col("g"), F.lit(False)).alias("clean"))


def as_rasters(frame: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as arrays of 32-bit numbers, as rasters are kept."""
    return frame.withColumns({c: F.col(c).cast("array<float>") for c in columns})
