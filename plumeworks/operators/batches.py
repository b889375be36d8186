"""Rasters of many areas from shared sources: a batch's sources are read once for all its areas, and each area gets its raster or its error."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import materialized
from .raster import CELL, GOOD, MAX_CLOUD, SIZE, clipped_areas, with_bounds

#: Side of the squares, in metres, by which a batch's areas and pixels are dealt out, and areas of a square that one task makes at once.
TILE, AREAS = 288_000.0, 256

#: Fields of a raster, in long form as in `raster.tessellated`; what a cell has where no pixel, or no accepted one, overlaps it.
EMPTY = {"native_count": 0.0, "total_area": 0.0, "cloud_mean": math.nan, "worst_flag": -1.0, "good_share": 0.0, "weight": 0.0, "accepted_count": 0.0, "value": math.nan, "n_eff": 0.0, "uncertainty": math.nan}

RASTERS = pa.schema([("key", pa.string()), ("error", pa.string()), *((c, pa.list_(pa.float64())) for c in EMPTY)])
RASTERS_DDL = "key string, error string, " + ", ".join(f"{c} array<double>" for c in EMPTY)


def source_errors(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """key and error of the requests that can't be made: no finite centre, no sources, or a source, the first by path, that is missing or wasn't read.

    requests: key, x, y, paths; sources: path and error, null if it was read well. All requests of a batch fail by the same source.
    """
    centre = F.coalesce(F.col("x"), F.col("y")).isNull() | F.coalesce(F.isnan(F.col("x") + F.col("y")) | (F.abs(F.col("x") + F.col("y")) == float("inf")), F.lit(True))
    needs = requests.select("key", F.posexplode_outer(F.array_sort("paths")).alias("_at", "path"))
    known = sources.groupBy("path").agg(F.max(F.struct(F.col("error").isNotNull().alias("bad"), "error")).alias("_s"))
    reason = F.when(F.col("path").isNull(), "no source").when(F.col("_s").isNull(), F.concat(F.lit("no source "), F.col("path"))).when(F.col("_s.bad"), F.concat(F.lit("reading "), F.col("path"), F.lit(" failed: "), F.col("_s.error")))
    bad = needs.join(known, "path", "left").withColumn("error", reason).filter("error is not null").groupBy("key").agg(F.min(F.struct("_at", "error"))["error"].alias("error"))
    lost = requests.filter(centre).select("key", F.lit("no finite centre").alias("error"))
    return bad.unionByName(lost).groupBy("key").agg(F.min("error").alias("error"))


def raster_of(x: float, y: float, p: dict[str, np.ndarray], size: int, cell: float, max_cloud: float, good: int) -> dict[str, np.ndarray]:
    """The fields of one area's cells, row by row from the north, from pixels whose bounds reach into it."""
    half, n = size * cell / 2, size * size
    near = np.flatnonzero((p["bx1"] > x - half) & (p["bx0"] < x + half) & (p["by1"] > y - half) & (p["by0"] < y + half) & (p["bx1"] > p["bx0"]) & (p["by1"] > p["by0"]))
    if (p["corners"][near] != 4).any():
        raise ValueError("a footprint hasn't four corners")
    left, top = x - half, y + half
    first = np.maximum(0, np.floor((p["bx0"][near] - left) / cell)).astype(int), np.maximum(0, np.floor((top - p["by1"][near]) / cell)).astype(int)
    last = np.minimum(size, np.ceil((p["bx1"][near] - left) / cell)).astype(int), np.minimum(size, np.ceil((top - p["by0"][near]) / cell)).astype(int)
    wide, high = np.maximum(0, last[0] - first[0]), np.maximum(0, last[1] - first[1])
    pixel = np.repeat(np.arange(len(near)), wide * high)
    k = np.arange(len(pixel)) - np.repeat(np.cumsum(wide * high) - wide * high, wide * high)
    col, row = first[0][pixel] + k % np.maximum(1, wide)[pixel], first[1][pixel] + k // np.maximum(1, wide)[pixel]
    boxes = np.stack([left + col * cell, top - (row + 1) * cell, left + (col + 1) * cell, top - row * cell], axis=1)
    pixel = near[pixel]
    corners = p["first"][pixel][:, None] + np.arange(4)
    area = clipped_areas(p["cx"][corners], p["cy"][corners], boxes) / 1e6
    some = area > 0
    area, pixel, at = area[some], pixel[some], (row * size + col)[some]
    value, cloud, flag, sure = (p[c][pixel] for c in ("value", "cloud", "flag", "uncertainty"))
    taken = (flag == good) & (cloud <= max_cloud) & np.isfinite(value)
    known = taken & np.isfinite(sure)
    total = lambda w: np.bincount(at, w, n)
    part = lambda w, where: np.bincount(at[where], w[where], n)
    over = lambda a, b, other: np.divide(a, b, out=np.full(n, other), where=b > 0)
    out = {"native_count": total(np.ones(len(at))), "total_area": total(area), "weight": part(area, taken), "accepted_count": np.bincount(at[taken], minlength=n).astype(float)}
    out["cloud_mean"] = over(total(area * cloud), out["total_area"], math.nan)
    out["worst_flag"] = np.full(n, -1.0)
    np.maximum.at(out["worst_flag"], at, flag.astype(float))
    out["good_share"] = over(part(area, flag == good), out["total_area"], 0.0)
    out["value"] = over(part(area * value, taken), out["weight"], math.nan)
    out["n_eff"] = over(out["weight"] ** 2, part(area * area, taken), 0.0)
    out["uncertainty"] = over(part(area * sure, known), part(area, known), math.nan)
    return out


def made(size: int, cell: float, max_cloud: float, good: int):
    """The rasters of a group's areas from its pixels; what goes wrong in one area is its error alone."""

    def run(pixels: pa.Table, areas: pa.Table) -> pa.Table:
        corner = {c: pixels.column(c).combine_chunks() for c in ("cx", "cy")}
        p = {c: pixels.column(c).to_numpy().astype(float) for c in ("bx0", "bx1", "by0", "by1", "value", "cloud", "flag", "uncertainty")}
        sizes = [np.asarray(c.value_lengths().fill_null(0)) for c in corner.values()]
        p["corners"] = np.where(sizes[0] == sizes[1], sizes[0], -1)
        p["first"] = np.cumsum(sizes[0]) - sizes[0]
        p |= {c: np.asarray(corner[c].flatten()).astype(float) for c in ("cx", "cy")}
        keys, errors, fields = areas.column("key").to_pylist(), [], []
        for x, y in zip(areas.column("x").to_pylist(), areas.column("y").to_pylist(), strict=True):
            try:
                fields.append(raster_of(x, y, p, size, cell, max_cloud, good))
                errors.append(None)
            except (IndexError, TypeError, ValueError) as error:
                errors.append(f"regridding failed: {error}")
        ends = pa.array(np.cumsum([0, *(0 if e else size * size for e in errors)], dtype=np.int32))
        gone = pa.array([e is not None for e in errors], pa.bool_())
        column = lambda c: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[c].astype(float) for f in fields]) if fields else np.zeros(0)), mask=gone)
        return pa.table([pa.array(keys, pa.string()), pa.array(errors, pa.string()), *(column(c) for c in EMPTY)], schema=RASTERS)

    return run


def regridded(requests: DataFrame, pixels: DataFrame, sources: DataFrame, *, size: int = SIZE, cell: float = CELL, max_cloud: float = MAX_CLOUD, good: int = GOOD, tile: float = TILE, areas: int = AREAS) -> DataFrame:
    """key, error and the fields of EMPTY as arrays of size * size cells, row by row from the north, for each request: its raster (error is null) or its error.

    requests: key (once each), x, y (the centre), paths of its sources. pixels: path, cx, cy (four corners in order),
    value, cloud, flag, uncertainty. sources: path, error (null if it was read well). Lengths are in metres.

    Requests of the same sources make a batch. The pixels are read once; each goes to the squares of the batches
    that need its source and that its bounds come near, where it meets a bounded number of areas. An area
    without pixels has a raster of empty cells.
    """
    rasters, keys, errors = shared_rasters(requests, pixels, sources, size=size, cell=cell, max_cloud=max_cloud, good=good, tile=tile, areas=areas)
    nothing = [F.lit(None).cast("array<double>").alias(c) for c in EMPTY]
    return keys.join(rasters.withColumnRenamed("key", "first"), "first").drop("first").unionByName(errors.select("key", "error", *nothing))


def shared_rasters(requests: DataFrame, pixels: DataFrame, sources: DataFrame, *, size: int = SIZE, cell: float = CELL, max_cloud: float = MAX_CLOUD, good: int = GOOD, tile: float = TILE, areas: int = AREAS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rasters, keys, errors) as in `regridded`, where requests of one centre and the same sources share a raster, that of the least key: keys has each request's key and this `first`."""
    half = size * cell / 2
    requests = requests.select("key", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "paths")
    errors = source_errors(requests, sources)
    place = lambda c: F.floor(F.col(c) / tile).cast("long")
    errors = materialized(errors, "request-errors")
    one = ["x", "y", "_paths"]
    asked = requests.join(errors.select("key"), "key", "left_anti").withColumn("_paths", F.array_sort("paths"))
    firsts = materialized(asked.groupBy(*one).agg(F.min("key").alias("first")), "first-requests")
    keys = asked.join(firsts, one).select("key", "first")
    ready = firsts.select(F.col("first").alias("key"), "x", "y", F.col("_paths").alias("paths")).withColumns({"batch": F.sha2(F.to_json(F.array_sort("paths")), 256), "ti": place("x"), "tj": place("y")})
    square = ["batch", "ti", "tj"]
    counts = ready.groupBy(*square, "paths").agg(F.ceil(F.count("*") / areas).cast("int").alias("parts"))
    counts = counts.groupBy(*square).agg(F.sum("parts").cast("int").alias("parts"), F.min("paths").alias("paths"))
    wanted = materialized(counts.select(*square, "parts", F.explode(F.array_distinct("paths")).alias("path")), "batch-sources")
    dealt = ready.join(counts.select(*square, "parts"), square).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    span = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - half) / tile), F.floor((F.col(hi) + half) / tile)))
    near = with_bounds(pixels.select("path", "cx", "cy", *(F.col(c).cast("double").alias(c) for c in ("value", "cloud", "flag", "uncertainty"))))
    near = near.filter("bx0 is not null and by0 is not null").withColumn("ti", span("bx0", "bx1")).withColumn("tj", span("by0", "by1"))
    near = near.join(wanted, ["path", "ti", "tj"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    by = [*square, "part"]
    fields = ("cx", "cy", "bx0", "bx1", "by0", "by1", "value", "cloud", "flag", "uncertainty")
    rasters = near.select(*by, *fields).groupBy(*by).cogroup(dealt.select(*by, "key", "x", "y").groupBy(*by)).applyInArrow(made(size, cell, max_cloud, good), RASTERS_DDL)
    return rasters, keys, errors
