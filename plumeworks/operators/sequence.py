"""Scan sequences, interpolation, irregular-time averages and labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import finite, keep_one, seconds_between

STEPS = 4
GAP_MINUTES = (40, 70)
DECAY_HOURS = 2.0
ABSOLUTE_FLOOR, RELATIVE_FLOOR = 200.0, 0.25
CLASSES = ("decrease", "steady", "increase")


def sequences(scans: DataFrame, steps: int = STEPS, bounds: tuple[float, float] = GAP_MINUTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """The last `steps` scans of an AOI, as t0_timestamp and so on, where all gaps are within bounds in minutes.

    scans: aoi_id, scan_time and the carried columns. Adds date and hour of the last
    scan and label_delta_mins, its gap. One window on aoi_id makes all lags.
    """
    w = Window.partitionBy("aoi_id").orderBy("scan_time")
    columns = []
    for i in range(steps):
        back = steps - 1 - i
        columns.append(F.lag("scan_time", back).over(w).alias(f"t{i}_timestamp"))
        columns += [F.lag(c, back).over(w).alias(f"{c}_t{i}") for c in carry]
    rows = scans.select("aoi_id", *columns)
    gaps = [seconds_between(F.col(f"t{i}_timestamp"), F.col(f"t{i + 1}_timestamp")) / 60 for i in range(steps - 1)]
    fits = gaps[0].between(*bounds)
    for g in gaps[1:]:
        fits &= g.between(*bounds)
    last = F.col(f"t{steps - 1}_timestamp")
    return rows.filter(fits).withColumns({"date": last.cast("date"), "hour": F.hour(last), "label_delta_mins": gaps[-1]})


def with_sequences(hours: DataFrame, scans: DataFrame, **options) -> DataFrame:
    """AOI hours (aoi_id, date, hour, ...) with the sequences that end in them; two scans in an hour make two rows."""
    return hours.join(sequences(scans, **options), ["aoi_id", "date", "hour"], "left")


def interpolated(frame: DataFrame, hourly: DataFrame, steps: int = STEPS) -> DataFrame:
    """Adds t{i}_nox: hourly mass (aoi_id, hour, nox_mass) between the hours around each step; on the hour the hour's own; null where a needed side is missing.

    Each hour carries the next hour's mass, so that a step takes one join.
    """
    w = Window.partitionBy("aoi_id").orderBy("hour")
    following = F.when(F.lead("hour").over(w) == F.col("hour") + F.expr("interval 1 hour"), F.lead("nox_mass").over(w))
    pairs = hourly.select("aoi_id", "hour", F.col("nox_mass").alias("low"), following.alias("high"))
    for i in range(steps):
        t = F.col(f"t{i}_timestamp")
        part = seconds_between(F.date_trunc("hour", t), t) / 3600.0
        side = pairs.withColumnsRenamed({"hour": f"_h{i}", "low": f"_l{i}", "high": f"_u{i}"})
        frame = frame.withColumn(f"_h{i}", F.date_trunc("hour", t)).join(side, ["aoi_id", f"_h{i}"], "left")
        value = F.when(part == 0, F.col(f"_l{i}")).otherwise(F.col(f"_l{i}") + part * (F.col(f"_u{i}") - F.col(f"_l{i}")))
        frame = frame.withColumn(f"t{i}_nox", value).drop(f"_h{i}", f"_l{i}", f"_u{i}")
    return frame


def ema(frame: DataFrame, steps: int = STEPS, decay_hours: float = DECAY_HOURS) -> DataFrame:
    """Adds previous_nox, current_nox and delta_nox of the average that decays with the time between steps, and age_hours_t{i}."""
    at = [F.col(f"t{i}_timestamp") for i in range(steps)]
    average, before = F.col("t0_nox"), None
    for i in range(1, steps):
        keep = F.exp(-(seconds_between(at[i - 1], at[i]) / 3600.0) / decay_hours)
        average, before = keep * average + (1 - keep) * F.col(f"t{i}_nox"), average
    ages = {f"age_hours_t{i}": seconds_between(at[i], at[-1]) / 3600.0 for i in range(steps)}
    return frame.withColumns({"previous_nox": before, "current_nox": average, "delta_nox": average - before} | ages)


def innovation_labels(frame: DataFrame, steps: int = STEPS, decay_hours: float = DECAY_HOURS, floors: tuple[float, float] = (ABSOLUTE_FLOOR, RELATIVE_FLOOR)) -> DataFrame:
    """Adds aoi_scale, alpha, innovation, threshold and delta_category; rows of AOIs without a positive value go."""
    values = frame.select("aoi_id", F.explode(F.array(*(f"t{i}_nox" for i in range(steps)))).alias("v")).filter(finite(F.col("v")) & (F.col("v") > 0))
    scale = values.groupBy("aoi_id").agg(F.median("v").alias("aoi_scale"))
    gap = seconds_between(F.col(f"t{steps - 2}_timestamp"), F.col(f"t{steps - 1}_timestamp")) / 3600.0
    rows = frame.join(scale, "aoi_id").withColumn("alpha", 1 - F.exp(-gap / decay_hours))
    rows = rows.withColumn("innovation", F.col("delta_nox") / F.col("alpha")).withColumn("threshold", F.greatest(F.lit(floors[0]), floors[1] * F.col("aoi_scale")))
    label = F.when(F.col("innovation") >= F.col("threshold"), CLASSES[2]).when(F.col("innovation") <= -F.col("threshold"), CLASSES[0]).otherwise(CLASSES[1])
    return rows.withColumn("delta_category", label)


def hourly_deltas(hourly: DataFrame) -> DataFrame:
    """Adds delta_nox against the AOI's row of exactly one hour earlier; else null."""
    w = Window.partitionBy("aoi_id").orderBy("hour")
    return hourly.withColumn("delta_nox", F.when(F.col("hour") - F.lag("hour").over(w) == F.expr("interval 1 hour"), F.col("nox_mass") - F.lag("nox_mass").over(w)))


def overlapped_hours(windows: DataFrame, start: str, end: str) -> DataFrame:
    """Each window once for every hour that it overlaps, with overlap_s; a window without length or with a null end keeps one row."""
    hours = F.when(F.col(start) < F.col(end), F.sequence(F.date_trunc("hour", start), F.date_trunc("hour", F.col(end) - F.expr("interval 1 microsecond")), F.expr("interval 1 hour")))
    rows = windows.withColumn("_hour", F.explode_outer(hours))
    return rows.withColumn("overlap_s", seconds_between(F.greatest(F.col(start), F.col("_hour")), F.least(F.col(end), F.col("_hour") + F.expr("interval 1 hour"))))


def overlap_weighted(windows: DataFrame, hourly: DataFrame, keys: tuple[str, ...], start: str = "previous", end: str = "current") -> DataFrame:
    """For each window (aoi_id and keys) the mean of hourly delta_nox by overlap; null unless all of the overlap has a finite one, NaN for overlaps without a whole second."""
    rows = overlapped_hours(windows, start, end).join(hourly.select("aoi_id", F.col("hour").alias("_hour"), "delta_nox"), ["aoi_id", "_hour"], "left")
    good = finite(F.col("delta_nox"))
    covered = F.sum(F.when(good, F.col("overlap_s")))
    total = F.sum("overlap_s")
    mean = F.when(total == 0, float("nan")).otherwise(F.try_divide(F.sum(F.when(good, F.col("delta_nox") * F.col("overlap_s"))), total))
    return rows.groupBy("aoi_id", *keys).agg(F.when(covered == total, mean).alias("delta_nox"))


def best_overlap(scans: DataFrame, bounds: tuple[float, float] = GAP_MINUTES) -> DataFrame:
    """For each AOI hour the pair of scans in a row that overlaps it most, the earlier of equals; coverage_percent of the hour."""
    w = Window.partitionBy("aoi_id").orderBy("scan_time")
    pairs = scans.select("aoi_id", F.lag("scan_time").over(w).alias("previous"), F.col("scan_time").alias("current"))
    gap = seconds_between(F.col("previous"), F.col("current")) / 60
    rows = overlapped_hours(pairs.filter(gap.between(*bounds)), "previous", "current").filter("overlap_s > 0")
    best = keep_one(rows, ["aoi_id", "_hour"], F.col("overlap_s").desc(), F.col("previous"))
    return best.select("aoi_id", F.col("_hour").alias("hour"), "previous", "current", (F.col("overlap_s") * 100 / 3600.0).alias("coverage_percent"))
