"""Typed ingest, file names, text indexes, attributes and capacities."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.semantics import keep_one
from ..tables import materialized
from .pages import JsonPages

# The provider's file names, and what counts as a generator with its capacity.
GRANULE_NAME = r"^TEMPO_NO2_(L2|L3)_(V\d{2})_(\d{8}T\d{6})Z_S(\d{3})(?:G(\d{2}))?\.nc$"
GENERATOR_CAPACITY = r"^\s*([^(),]+?)\s*\(\s*(\d+(?:\.\d*)?|\.\d+)\s*\)\s*$"


def normalized(df: DataFrame, kind: T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """The schema's columns in its order: cast where possible, null where missing or not castable."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    return df.select(*((F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind))


def read_table(spark, path: str | list[str], kind: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """Parquet by a declared schema; only the chosen columns are read."""
    df = spark.read.schema(kind).parquet(*([path] if isinstance(path, str) else path))
    return df.select(*columns) if columns else df


def read_csv(spark, path: str, kind: T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """CSV with a header by a declared schema; a required column that the header lacks is an error."""
    header = spark.read.option("header", True).csv(path).columns
    if missing := [c for c in required if c not in header]:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    text = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    return normalized(text, kind, required)


def granule_name(name: Column) -> list[Column]:
    """level, version, taken_at, scan_num, granule_num and well_formed of a granule's file name: level 2 has a granule number, level 3 none."""
    part = lambda i: F.nullif(F.regexp_extract(name, GRANULE_NAME, i), F.lit(""))
    level, granule = part(1), part(5)
    good = F.coalesce((level == "L2") == granule.isNotNull(), F.lit(False))
    return [level.alias("level"), part(2).alias("version"), F.try_to_timestamp(part(3), F.lit("yyyyMMdd'T'HHmmss")).alias("taken_at"), part(4).cast("int").alias("scan_num"), granule.cast("int").alias("granule_num"), good.alias("well_formed")]


def byte_ranges(lines: DataFrame, fields: dict[str, str]) -> DataFrame:
    """field, first and last byte (null at the end of the file) of the wanted messages of text indexes.

    lines: path, place, line as `number:offset:rest`. fields: name to a part of `rest`. A
    field that a path lacks, or has twice, is an error.
    """
    parts = F.split("line", ":", 3)
    rows = lines.select("path", "place", parts[1].cast("long").alias("first"), parts[2].alias("rest"))
    rows = rows.withColumn("last", F.lead("first").over(Window.partitionBy("path").orderBy("place")) - 1)
    name = F.coalesce(*(F.when(F.contains("rest", F.lit(text)), F.lit(k)) for k, text in fields.items()))
    found = rows.withColumn("field", name).filter("field is not null")
    n = F.count("*").over(Window.partitionBy("path", "field"))
    all_of = F.count("*").over(Window.partitionBy("path"))
    checked = found.withColumn("_bad", (n > 1) | (all_of != len(fields)))
    guard = F.when(F.col("_bad"), F.raise_error(F.concat(F.lit("fields are missing or repeated in "), "path"))).otherwise(F.col("first"))
    return checked.select("path", "field", guard.alias("first"), "last")


def generator_capacities(attributes: DataFrame, text: str = "associatedGeneratorsAndNameplateCapacity") -> DataFrame:
    """One row per generator of `A (12.5), B (3)`: its name in upper case and positive megawatts; malformed parts go."""
    rows = attributes.withColumn("_part", F.explode(F.split(F.coalesce(F.col(text), F.lit("")), ",")))
    rows = rows.withColumn("generator", F.upper(F.trim(F.regexp_extract("_part", GENERATOR_CAPACITY, 1)))).withColumn("mw", F.regexp_extract("_part", GENERATOR_CAPACITY, 2).try_cast("double"))
    return rows.filter("generator <> '' and mw > 0 and not isnan(mw) and mw < double('infinity')").drop("_part")


def capacities(attributes: DataFrame, facility: str = "facilityId", year: str = "year", text: str = "associatedGeneratorsAndNameplateCapacity") -> DataFrame:
    """facility, year and mw of every facility year: the sum over generators with one capacity; those with several conflict and count nothing."""
    each = generator_capacities(attributes, text).groupBy(facility, year, "generator").agg(F.collect_set("mw").alias("values"))
    sums = each.groupBy(facility, year).agg(F.sum(F.when(F.size("values") == 1, F.col("values")[0])).alias("mw"))
    every = attributes.select(facility, year).distinct()
    return every.join(sums, [facility, year], "left").withColumn("mw", F.coalesce("mw", F.lit(0.0)))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """Adds right's values at the newest right_at that isn't after left_at, by keys; null without one.

    Both sides go into one window by the keys, so that no pairs are made. Of right
    rows with equal keys and right_at, the last by the values' order counts.
    """
    payload = F.struct(F.col(right_at).alias("_found_at"), *values)
    union = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_right"))
    union = union.unionByName(right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), payload.alias("_right")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at", "_side", "_right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = union.withColumn("_found", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1")
    return found.select("_left.*", F.col("_found._found_at").alias(right_at), *(F.col(f"_found.{v}").alias(v) for v in values))


def deduplicated(attributes: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The first row of each key in ingest order."""
    return keep_one(attributes, keys, F.col(ordinal))


def required_present(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of the required ids; ids without a row are an error that names up to 20 of them."""
    missing = [r[0] for r in ids.select(key).distinct().join(rows, key, "left_anti").orderBy(key).limit(20).collect()]
    if missing:
        raise ValueError(f"no attributes for {missing}")
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def facility_attributes(spark: SparkSession, url: str, ids: DataFrame, latest: int, earliest: int, *, key: str = "facilityId", size: int = 500, tries: int = 4) -> DataFrame:
    """year, facility_id and record (JSON text) of the required facilities, ids: facility_id, from a paged source's years, the newest first.

    A record without a whole number as its facility is left out. A facility that no year has is an error. Each year is one
    task's; the pages are read once, and written.
    """
    spark.dataSource.register(JsonPages)
    years = json.dumps(list(range(latest, earliest - 1, -1)))
    rows = spark.read.format("json_pages").options(url=url, queries=years, size=str(size), tries=str(tries)).load()
    facility = F.get_json_object("record", f"$.{key}").try_cast("long")
    rows = rows.select(F.col("query").cast("int").alias("year"), facility.alias("facility_id"), "record").filter("facility_id is not null")
    return required_present(ids, materialized(rows, "attributes"), "facility_id")


def write_enriched(source: DataFrame, facility: DataFrame, unit: DataFrame, path: str, keys: tuple[list[str], list[str]]) -> int:
    """Left-joins attributes and writes zstd Parquet, if no row is lost or repeated: attribute keys must be unique, which is checked before."""
    for rows, key in zip((facility, unit), keys, strict=True):
        if not rows.groupBy(*key).count().filter("count > 1").isEmpty():
            raise ValueError(f"attributes repeat {key}: the join would repeat rows")
    before = source.count()
    source.join(facility, keys[0], "left").join(unit, keys[1], "left").write.mode("overwrite").option("compression", "zstd").parquet(path)
    after = source.sparkSession.read.parquet(path).count()
    if after != before:
        raise ValueError(f"{after} rows written of {before}")
    return after
