"""Declared schemas; files are never read with inferred ones."""

from __future__ import annotations

from pyspark.sql import types as T
from pyspark.sql.types import BinaryType, BooleanType, ByteType, DateType, DoubleType, IntegerType, LongType, ShortType, StringType, TimestampType


def schema(**fields: T.DataType) -> T.StructType:
    """Nullable fields in the order given."""
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# The names and order of hourly unit records are the provider's.
HOURLY = schema(
    stateCode=StringType(),
    facilityName=StringType(),
    facilityId=LongType(),
    unitId=StringType(),
    date=DateType(),
    hour=ByteType(),
    opTime=DoubleType(),
    grossLoad=DoubleType(),
    noxMass=DoubleType(),
    noxMassMeasureFlg=StringType(),
    noxRate=DoubleType(),
    noxRateMeasureFlg=StringType(),
    so2Mass=DoubleType(),
    so2MassMeasureFlg=StringType(),
    so2Rate=DoubleType(),
    so2RateMeasureFlg=StringType(),
    co2Mass=DoubleType(),
    co2MassMeasureFlg=StringType(),
    co2Rate=DoubleType(),
    co2RateMeasureFlg=StringType(),
    heatInput=DoubleType(),
    heatInputMeasureFlg=StringType(),
    primaryFuelInfo=StringType(),
    unitType=StringType(),
)
HOURLY_REQUIRED = ("facilityId", "unitId", "date", "hour", "opTime")

# Names of attribute records are the provider's.
ATTRIBUTES = schema(
    facilityId=LongType(),
    unitId=StringType(),
    year=LongType(),
    latitude=DoubleType(),
    longitude=DoubleType(),
    epaRegion=DoubleType(),
    maxHourlyHIRate=DoubleType(),
    associatedGeneratorsAndNameplateCapacity=StringType(),
)

# Columns of the tables that are kept between steps.
GRANULES = schema(relative_path=StringType(), scan_num=IntegerType(), granule_num=ShortType(), time_coverage_start=TimestampType(), time_coverage_end=TimestampType(), footprint_wkb=BinaryType(), year=ShortType(), month=ByteType())
FAILURES = schema(record_index=LongType(), error=StringType())
CANDIDATES = schema(
    candidate_index=LongType(),
    aoi_id=LongType(),
    lat=DoubleType(),
    lon=DoubleType(),
    scan_date=DateType(),
    scan_num=IntegerType(),
    tempo_time=TimestampType(),
    granule_paths=T.ArrayType(StringType()),
    weather_path=StringType(),
    tempo_cached=BooleanType(),
    weather_cached=BooleanType(),
)
VALIDITY = schema(cache_key=StringType(), status=StringType(), tempo_cache_path=StringType(), weather_cache_path=StringType(), reason=StringType())


def empty(spark, kind: T.StructType):
    """A typed frame without rows."""
    return spark.createDataFrame([], kind)
