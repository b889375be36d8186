"""Activity-conditioned statistics of areas of interest (AOIs).

Records are unit hours: facility_id, unit_id, hour, op_time, nox_mass, flag, fuel,
attribute_fuel, heat_input, gross_load. Membership ties aoi_id to facility_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import any0, decimals, finite, sum0, sum_decimals
from ..tables import materialized
from . import aoi


def usable(flag: Column) -> Column:
    """Whether a measurement flag doesn't call the value invalid or unavailable; a null flag is fine."""
    return ~F.lower(F.trim(F.coalesce(flag, F.lit("")))).rlike("invalid|unavailable")


def fuel_flags() -> tuple[Column, Column]:
    """Coal and natural gas, by the record's fuel or else the attribute's; null without either."""
    fuel = F.lower(F.coalesce("fuel", "attribute_fuel"))
    return F.contains(fuel, F.lit("coal")), F.contains(fuel, F.lit("natural gas"))


def positive_hours(records: DataFrame, members: aoi.Sites, mass: Column, units: bool) -> DataFrame:
    """Site hours with the mean operating time, the operating units and the mass that qualifies. Places' hours are summed before they meet their sites.

    Masses are summed as decimals, so that sites with as much are equal, and ranked by id, whatever the order of their records.
    """
    qualifies = mass & usable(F.col("flag")) & finite(F.col("nox_mass")) & (F.col("nox_mass") >= 0)
    rows = members.at_home(records.filter(finite(F.col("op_time")) & (F.col("op_time") >= 0)))
    running = [F.count_if(F.col("op_time") > 0).alias("operating_units")] if units else []
    rows = rows.withColumn("_mass", F.when(qualifies, F.col("nox_mass"))).withColumn("_exact", decimals(F.col("_mass")))
    exact = F.when(F.count("_exact") == F.count("_mass"), F.coalesce(F.try_sum("_exact"), F.when(F.count("_mass") == 0, F.lit(0).cast("decimal(38, 18)"))))
    each = rows.groupBy("place", "hour").agg(F.sum("op_time").alias("_t"), F.count("*").alias("_n"), exact.alias("_exact"), sum0(F.col("_mass")).alias("_mass"), *running)
    sums = [F.sum("operating_units").alias("operating_units")] if units else []
    return each.join(members.reach, "place").groupBy("site", "hour").agg((F.sum("_t") / F.sum("_n")).alias("mean_op_time"), sum_decimals(F.col("_exact"), F.col("_mass")).alias("mass"), *sums)


def active_hours(hours: DataFrame) -> DataFrame:
    """Hours whose mean operating time reaches the site's median."""
    cut = hours.groupBy("site").agg(F.median("mean_op_time").alias("cut"))
    return hours.join(cut, "site").filter("mean_op_time >= cut").drop("cut")


def operating_characteristics(records: DataFrame, membership: DataFrame | aoi.Sites) -> DataFrame:
    """aoi_id, active_median_nox, active_mean_units over active hours, and emitting_fraction over all. Areas of one site have the very same values."""
    members = aoi.as_sites(membership)
    hours = materialized(positive_hours(records, members, F.lit(True), True), "site-hours")
    active = active_hours(hours).groupBy("site").agg(F.median("mass").alias("active_median_nox"), F.avg("operating_units").alias("active_mean_units"))
    return members.of_areas(active.join(hours.groupBy("site").agg(F.avg((F.col("mass") > 0).cast("double")).alias("emitting_fraction")), "site"))


def ranked_scores(scores: DataFrame, score: str = "active_median_nox") -> DataFrame:
    """Adds score_rank from 1, by (score, aoi_id), and score_percentile. One row per AOI goes through one task."""
    order = Window.orderBy(score, "aoi_id")
    return scores.withColumn("score_rank", F.row_number().over(order)).withColumn("score_percentile", F.col("score_rank") / F.count("*").over(Window.partitionBy()))


def top_share(ranked: DataFrame, share: float, score: str = "active_median_nox") -> DataFrame:
    """The ceil(share * n) AOIs of highest score, lesser ids first among equals."""
    order = Window.orderBy(F.col(score).desc(), "aoi_id")
    n = F.count("*").over(Window.partitionBy())
    return ranked.withColumn("_place", F.row_number().over(order)).withColumn("_n", n).filter(F.col("_place") <= F.ceil(F.col("_n") * share)).drop("_place", "_n")


def activity_features(records: DataFrame, membership: DataFrame | aoi.Sites) -> DataFrame:
    """Unit counts by fuel, and means of coal mass, heat input and load over active hours."""
    members = aoi.as_sites(membership)
    coal, gas = fuel_flags()
    tagged = records.withColumn("is_coal", coal).withColumn("is_gas", gas)
    home = members.at_home(tagged)
    units = home.groupBy("place", "facility_id", "unit_id").agg(any0(F.col("is_coal")).alias("coal"), any0(F.col("is_gas")).alias("gas"))
    units = units.groupBy("place").agg(F.count("*").alias("num_units"), F.count_if("coal").alias("num_coal_units"), F.count_if("gas").alias("num_gas_units"))
    units = units.join(members.reach, "place").groupBy("site").agg(*(F.sum(c).alias(c) for c in ("num_units", "num_coal_units", "num_gas_units")))
    chosen = materialized(active_hours(positive_hours(tagged, members, F.col("is_coal"), False)), "active-hours")
    fields = ("heat_input", "gross_load")
    known = {c: F.when(finite(F.col(c)), F.col(c)) for c in fields}
    each = home.groupBy("place", "hour").agg(*(f(x).alias(f"{p}_{c}") for c, x in known.items() for p, f in (("_s", F.sum), ("_n", F.count))))
    means = each.join(members.reach, "place").join(chosen.select("site", "hour"), ["site", "hour"]).groupBy("site")
    means = means.agg(*(F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_n_{c}")).alias(f"avg_{c}") for c in fields))
    return members.of_areas(units.join(chosen.groupBy("site").agg(F.avg("mass").alias("avg_coal_nox")), "site").join(means, "site"))


def static_characteristics(records: DataFrame, membership: DataFrame | aoi.Sites) -> DataFrame:
    """Facilities and units of an AOI; the sum, the largest and the share of their largest capacities. A facility has one place, so that places' counts add up."""
    members = aoi.as_sites(membership)
    units = members.at_home(records.select("facility_id", "unit_id", "capacity_mw")).groupBy("place", "facility_id", "unit_id").agg(F.max("capacity_mw").alias("mw"))
    each = units.groupBy("place", "facility_id").agg(F.count("*").alias("num_units"), F.max("mw").alias("mw"))
    places = each.groupBy("place").agg(F.count("*").alias("num_facilities"), F.sum("num_units").alias("num_units"), F.sum("mw").alias("mw"), F.max("mw").alias("largest_mw"))
    sums = places.join(members.reach, "place").groupBy("site").agg(F.sum("num_facilities").alias("num_facilities"), F.sum("num_units").alias("num_units"), sum0(F.col("mw")).alias("total_mw"), F.max("largest_mw").alias("largest_mw"))
    return members.of_areas(sums.withColumn("largest_share", F.when(F.col("total_mw") > 0, F.col("largest_mw") / F.col("total_mw"))))


def clean_hours(records: DataFrame, membership: DataFrame | aoi.Sites) -> DataFrame:
    """Mass of AOI hours, without the hours of which a member is flagged or NaN. A null mass only drops its own row."""
    members = aoi.as_sites(membership)
    good = usable(F.col("flag")) & finite(F.col("nox_mass"))
    bad = ~usable(F.col("flag")) | ~finite(F.col("nox_mass"))
    each = members.at_home(records).groupBy("place", "hour").agg(F.sum(F.when(good, F.col("nox_mass"))).alias("nox_mass"), F.count_if(good).alias("_good"), any0(bad).alias("_bad"))
    hours = each.join(members.reach, "place").groupBy("site", "hour").agg(F.sum("nox_mass").alias("nox_mass"), F.sum("_good").alias("_good"), F.bool_or("_bad").alias("_bad"))
    return members.of_areas(hours.filter("_good > 0 and not _bad").select("site", "hour", "nox_mass"))


def class_floor(frame: DataFrame, group: str, label: str, classes: tuple[str, ...], least: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the groups with at least so many of every class, and all groups' counts with whether they pass."""
    audit = frame.groupBy(group).agg(*(F.count_if(F.col(label) == c).alias(f"{c}_count") for c in classes))
    passes = F.least(*(F.col(f"{c}_count") for c in classes)) >= least
    audit = audit.withColumn("passes", passes)
    return frame.join(audit.filter("passes").select(group), group, "left_semi"), audit
