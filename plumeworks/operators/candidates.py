"""From hourly records, facilities and scans to the labelled candidates that are split and sampled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import finite
from ..plans.planning import with_weather_paths
from ..tables import materialized
from . import activity, aoi, sequence, splits

LABEL_MODE = "linear_interpolated_timestep_ema"


def eligible(frame: DataFrame, steps: int = sequence.STEPS) -> DataFrame:
    """Rows whose steps' masses, mean heat input and load, and distance to a city are all finite; null isn't."""
    needed = [*(f"t{i}_nox" for i in range(steps)), "avg_heat_input", "avg_gross_load", "city_km"]
    keep = F.lit(True)
    for c in needed:
        keep &= F.coalesce(finite(F.col(c)), F.lit(False))
    return frame.filter(keep)


def chosen_aois(records: DataFrame, membership: DataFrame | aoi.Sites, share: float) -> tuple[DataFrame, DataFrame]:
    """aoi_id, aoi_score and aoi_score_percentile of the share of AOIs with the highest scores; and of all AOIs, with whether they have a score and are chosen."""
    scored = activity.operating_characteristics(records, membership)
    scored = scored.filter(finite(F.col("active_median_nox")) & (F.col("active_median_nox") >= 0))
    ranked = materialized(activity.ranked_scores(scored), "scores")
    name = {"active_median_nox": "aoi_score", "score_percentile": "aoi_score_percentile"}
    chosen = activity.top_share(ranked, share).withColumnsRenamed(name).select("aoi_id", *name.values())
    audit = aoi.as_sites(membership).all_areas().join(ranked.withColumnsRenamed(name).select("aoi_id", *name.values()), "aoi_id", "left")
    audit = audit.join(chosen.select("aoi_id", F.lit(True).alias("selected")), "aoi_id", "left").withColumns({"selected": F.coalesce("selected", F.lit(False)), "has_score": F.col("aoi_score").isNotNull()})
    return chosen, audit


def stratification_candidates(records: DataFrame, facilities: DataFrame, scans: DataFrame, cities: DataFrame, *, share: float = 0.5, steps: int = sequence.STEPS, bounds: tuple[float, float] = sequence.GAP_MINUTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """AOI hours that end a sequence of scans and have all that a record needs, before splitting.

    records: unit hours as in `activity`; facilities: facility_id, x, y, lon, lat, one row each and
    each the centre of an AOI; scans: aoi_id, scan_time and the carried columns; cities: lon, lat. Of the AOIs the share with the
    highest score takes part. An hour with an invalid member is neither a record nor a neighbour
    of one in time.
    """
    aois = facilities.withColumnRenamed("facility_id", "aoi_id")
    members = aoi.sites(facilities, aois)
    chosen = materialized(chosen_aois(records, members, share)[0], "chosen")
    mine = members.chosen(chosen)
    places = aois.join(chosen, "aoi_id")
    static = aoi.city_distance(places.join(aoi.clusters(aois.join(chosen.select("aoi_id"), "aoi_id", "left_semi")), "aoi_id"), cities)
    static = static.drop("x", "y").join(activity.activity_features(records, mine), "aoi_id")
    hourly = materialized(activity.clean_hours(records, mine), "clean-hours")
    hours = hourly.select("aoi_id", F.col("hour").alias("emissions_hour_utc"), F.to_date("hour").alias("date"), F.hour("hour").alias("hour"), "nox_mass")
    frame = sequence.with_sequences(hours, scans.join(chosen.select("aoi_id"), "aoi_id", "left_semi"), steps=steps, bounds=bounds, carry=carry).filter(F.col(f"t{steps - 1}_timestamp").isNotNull())
    frame = sequence.ema(sequence.interpolated(frame, hourly, steps), steps)
    frame = with_weather_paths(frame.join(static, "aoi_id"), steps).withColumn("label_mode", F.lit(LABEL_MODE))
    return eligible(frame, steps).filter(finite(F.col("delta_nox")))


def stratified(frame: DataFrame, *, least: int, floors: tuple[float, float] = (sequence.ABSOLUTE_FLOOR, sequence.RELATIVE_FLOOR), steps: int = sequence.STEPS, seed: int = splits.SEED, strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(balanced, eligible, audit) of candidates: the rest of the way from labels to splits.

    Candidates get their class by innovation; AOIs with fewer than `least` of a class go, as the audit (aoi_id, a count for each
    class, passes) tells; whole clusters go to train, val or test by their classes' counts; and each split is balanced to
    its rarest class. eligible is what was there before balancing. Fewer clusters than splits, and a split that lacks a class, are errors unless strict is off: then such splits stay empty.
    """
    labelled = materialized(sequence.innovation_labels(frame, steps, floors=floors), "labelled")
    kept, audit = activity.class_floor(labelled, "aoi_id", "delta_category", sequence.CLASSES, least)
    kept = materialized(kept, "above-floor")
    assigned = splits.greedy_splits(splits.cluster_counts(kept, "cluster", "delta_category", sequence.CLASSES), "cluster", seed, strict=strict)
    eligible = materialized(kept.join(assigned, "cluster"), "eligible")
    balanced = splits.balanced(eligible, "delta_category", sequence.CLASSES, ["aoi_id", f"t{steps - 1}_timestamp"], seed=seed, strict=strict)
    return balanced, eligible, audit
