"""Time zones of places, and their standard offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of noon on a day of winter and on one of summer; the lesser offset of the two is a zone's standard one.
DAYS = (1735732800, 1751371200)


def standard_offset_hours(zone: Column) -> Column:
    """Whole hours of a zone's standard time from UTC, without daylight saving; other offsets are an error, null stays null."""
    at = [F.timestamp_seconds(F.lit(s)) for s in DAYS]
    seconds = F.least(*(F.unix_seconds(F.from_utc_timestamp(t, zone)) - F.unix_seconds(t) for t in at))
    return F.when(seconds % 3600 == 0, (seconds / 3600).cast("tinyint")).when(zone.isNotNull(), F.raise_error(F.concat(F.lit("no whole-hour standard offset: "), zone)))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is within a ring of points (x, y): a ray to its right meets an odd number of edges."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    edges = F.arrays_zip(ring.alias("p"), following.alias("q"))
    meets = lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < e["p"]["x"] + (y - e["p"]["y"]) * (e["q"]["x"] - e["p"]["x"]) / F.nullif(e["q"]["y"] - e["p"]["y"], F.lit(0.0)))
    return F.aggregate(edges, F.lit(0), lambda n, e: n + F.coalesce(meets(e), F.lit(False)).cast("int")) % 2 == 1


def with_zones(facilities: DataFrame, zones: DataFrame) -> DataFrame:
    """Adds time_zone and utc_standard_offset_hours; a facility without a place, or in no zone, is an error.

    facilities: facility_id, lon, lat. zones: time_zone and `ring`, points (x, y) in degrees; a zone may
    have several rings. Both meet by one-degree cells. Of overlapping zones the least name counts.
    """
    reach = lambda c: F.sequence(F.floor(F.array_min(F.transform("ring", lambda p: p[c]))), F.floor(F.array_max(F.transform("ring", lambda p: p[c]))))
    cells = zones.withColumn("_i", F.explode(reach("x"))).withColumn("_j", F.explode(reach("y")))
    places = facilities.select("facility_id", "lon", "lat").distinct().withColumns({"_i": F.floor("lon"), "_j": F.floor("lat")})
    found = places.join(cells, ["_i", "_j"]).filter(inside(F.col("lon"), F.col("lat"), F.col("ring"))).groupBy("facility_id").agg(F.min("time_zone").alias("time_zone"))
    rows = facilities.join(found, "facility_id", "left")
    named = F.when(F.col("time_zone").isNotNull(), F.col("time_zone")).otherwise(F.raise_error(F.concat(F.lit("no time zone for facility "), F.col("facility_id").cast("string"))))
    return rows.withColumn("time_zone", named).withColumn("utc_standard_offset_hours", standard_offset_hours(F.col("time_zone")))
