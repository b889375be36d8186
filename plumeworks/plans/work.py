"""Content-keyed plans: what has to be made, in which shard, and what came of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import numbered, summed_before  # noqa: F401  (used with plans too)


def content_key(*columns: Column) -> Column:
    """SHA-256 of the canonical JSON of the columns."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def scan_key(aoi: Column, lon: Column, lat: Column, granules: Column) -> Column:
    return content_key(aoi.alias("aoi"), F.array(lon, lat).alias("center"), F.array_sort(granules).alias("granules"))


def weather_key(aoi: Column, fields: list[str], path: Column) -> Column:
    return content_key(aoi.alias("aoi"), F.array(*map(F.lit, sorted(fields))).alias("fields"), path.alias("path"))


def shard_ranges(frame: DataFrame, split: str, size: int) -> DataFrame:
    """shard, split, first and end of consecutive ranges of up to `size` rows in each split."""
    n = frame.groupBy(split).agg(F.count("*").alias("_n"))
    rows = n.withColumn("_k", F.explode(F.sequence(F.lit(0), ((F.col("_n") - 1) / size).cast("long"))))
    rows = rows.select(F.col(split), (F.col("_k") * size).alias("first"), F.least((F.col("_k") + 1) * size, F.col("_n")).alias("end"))
    return rows.withColumn("shard", F.row_number().over(Window.orderBy(split, "first")) - 1)


def even_shards(place: Column, total: Column, shards: int) -> Column:
    """The shard of a place where shard i of k has places [n i // k, n (i + 1) // k)."""
    return (((place + 1) * shards - 1) / total).cast("long")


def id_ranges(ids: DataFrame, column: str = "id") -> DataFrame:
    """first and last of each run of ids without a gap: within a run, the id less its place stays the same."""
    rows = numbered(ids.select(column).filter(F.col(column).isNotNull()).distinct(), [column], name="_place")
    return rows.groupBy((F.col(column) - F.col("_place")).alias("_g")).agg(F.min(column).alias("first"), F.max(column).alias("last")).drop("_g")


def range_text(ranges: DataFrame) -> DataFrame:
    """One text such as 1-3,7 of all ranges."""
    part = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    return ranges.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", part.alias("t")))), lambda x: x["t"]), ",").alias("spec"))


def missing_work(needs: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """One row per key that is needed and not cached."""
    return needs.dropDuplicates([key]).join(cache.select(key).distinct(), key, "left_anti")


def record_status(needs: DataFrame, outcomes: DataFrame, record: list[str], key: str = "key") -> DataFrame:
    """Per record, whether all its keys came out well, and else the reasons in the order of the keys.

    needs: record and key; outcomes: key and error (null: well). A key without an outcome is missing.
    """
    rows = needs.join(outcomes.select(key, "error", F.lit(True).alias("_known")), key, "left")
    reason = F.when(F.col("_known").isNull(), F.concat(F.lit("missing "), F.col(key))).otherwise(F.col("error"))
    agg = rows.groupBy(*record).agg(F.array_sort(F.collect_set(F.when(reason.isNotNull(), F.struct(F.col(key).alias("k"), reason.alias("r"))))).alias("_r"))
    return agg.select(*record, (F.size("_r") == 0).alias("ready"), F.array_join(F.transform("_r", lambda x: x["r"]), "; ").alias("error"))


def reconciled(expected: DataFrame, good: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Per key that isn't accounted for exactly once: expected, outcomes and what is wrong. No row: all is well."""
    union = expected.select(key, F.lit(1).alias("e"), F.lit(0).alias("o")).unionByName(good.select(key, F.lit(0).alias("e"), F.lit(1).alias("o"))).unionByName(failed.select(key, F.lit(0).alias("e"), F.lit(1).alias("o")))
    n = union.groupBy(key).agg(F.sum("e").alias("expected"), F.sum("o").alias("outcomes"))
    wrong = F.when(F.col("expected") == 0, "unexpected").when(F.col("outcomes") == 0, "no outcome").when(F.col("outcomes") > 1, "several outcomes").when(F.col("expected") > 1, "repeated")
    return n.withColumn("problem", wrong).filter("problem is not null")


def upserted(frames: list[DataFrame], key: str) -> DataFrame:
    """Of each key the row of the last frame that has it; within a frame the last by its columns' order. By one grouping, without a window."""
    marked = [f.withColumn("_frame", F.lit(i)) for i, f in enumerate(frames)]
    rows = marked[0]
    for m in marked[1:]:
        rows = rows.unionByName(m)
    rest = [c for c in frames[0].columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct("_frame", *rest)).alias("_x")).select(key, *(F.col(f"_x.{c}").alias(c) for c in rest))


def checked_index(index: DataFrame) -> DataFrame:
    """A validity index, of which a valid row without both paths, or an unknown status, is an error."""
    bad = (F.col("status") == "valid") & (F.col("tempo_cache_path").isNull() | F.col("weather_cache_path").isNull()) | ~F.coalesce(F.col("status").isin("valid", "invalid"), F.lit(False))
    return index.withColumn("status", F.when(bad, F.raise_error(F.concat(F.lit("bad index row "), F.col("cache_key")))).otherwise(F.col("status")))


def discovery_status(scan_error: Column, complete: Column, weather_error: Column) -> Column:
    """valid, invalid (kept) or retryable (not kept): a scan's error comes before its gaps, and these before the weather's error."""
    return F.when(scan_error.isNotNull(), "retryable").when(~F.coalesce(complete, F.lit(False)), "invalid").when(weather_error.isNotNull(), "retryable").otherwise("valid")


def trimmed(candidates: DataFrame, targets: dict[str, int], split: str = "split", order: str = "candidate_index") -> DataFrame:
    """The first `target` candidates of each split by order, with a compact index from 0."""
    target = F.coalesce(*(F.when(F.col(split) == s, F.lit(n)) for s, n in targets.items()), F.lit(0))
    rows = candidates.filter(F.col(split).isin(list(targets)))
    return numbered(rows, [order], [split], "new_index").filter(F.col("new_index") < target)


def shortfalls(candidates: DataFrame, targets: dict[str, int], split: str = "split") -> DataFrame:
    """split, found, target and shortfall."""
    want = candidates.sparkSession.createDataFrame(list(targets.items()), f"{split} string, target long")
    return want.join(candidates.groupBy(split).agg(F.count("*").alias("found")), split, "left").select(split, F.coalesce("found", F.lit(0)).alias("found"), "target", F.greatest(F.lit(0), F.col("target") - F.coalesce("found", F.lit(0))).alias("shortfall"))
