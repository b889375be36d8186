"""From what records need to what was made: scans that no cache holds are regridded in batches, fields are sampled, and each record is ready or has its reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import batches, weather
from ..tables import materialized
from .planning import source_batches
from .work import record_status


def _requests(needs: DataFrame, cached: DataFrame, kind: str) -> DataFrame:
    x, y = geo.albers(F.col("lon"), F.col("lat"))
    return source_batches(needs, cached, kind).select("key", x.alias("x"), y.alias("y"), "paths")


def made_scans(needs: DataFrame, cached: DataFrame, pixels: DataFrame, sources: DataFrame, **how) -> DataFrame:
    """key, error and the raster's fields of the needed scans that aren't cached: a batch's files are read once for all its areas. As in `batches.regridded`."""
    return batches.regridded(_requests(needs, cached, "scan"), pixels, sources, **how)


def made_weather(needs: DataFrame, cached: DataFrame, fields: DataFrame, grid: weather.ConicGrid, **how) -> DataFrame:
    """key, u, v, t and error of the needed weather that isn't cached; a file that isn't there is an error of all that need it. As in `weather.aligned`."""
    asked = _requests(needs, cached, "weather").select("key", "x", "y", F.col("paths")[0].alias("path"))
    return weather.as_rasters(weather.aligned(asked, fields, grid, **how), how.get("size", weather.SIZE))


def record_outcomes(needs: DataFrame, cached: DataFrame, *made: DataFrame) -> DataFrame:
    """split, record_index, ready and error of the records, from what was cached (key) and what was made (key, error). What is neither is missing."""
    outcomes = cached.select("key", F.lit(None).cast("string").alias("error")).distinct()
    for m in made:
        outcomes = outcomes.unionByName(m.select("key", "error"))
    return record_status(needs.select("split", "record_index", "key"), materialized(outcomes, "outcomes"), ["split", "record_index"])
