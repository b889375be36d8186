"""Rules for nulls, NaN, order and hashing that all operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Modulus of the seeded uniform numbers. A fixed value.
UNIFORM = 1_000_000_007


def finite(x: Column) -> Column:
    """True for finite numbers, false for NaN and infinities, null for null."""
    return F.when(x.isNull(), F.lit(None).cast("boolean")).otherwise(~F.isnan(x) & (F.abs(x) < float("inf")))


def sum0(x: Column, where: Column | None = None) -> Column:
    """A sum that is 0 where nothing qualifies."""
    return F.coalesce(F.sum(x if where is None else F.when(where, x)), F.lit(0.0))


def decimals(x: Column) -> Column:
    """A number as the decimal that it is written as; null if this has more than 18 places or 20 digits before them."""
    d = x.try_cast("decimal(38, 18)")
    return F.when(d.cast("double") == x, d)


def sum_decimals(parts: Column, sums: Column) -> Column:
    """The sum of `parts` (decimals) as a double, the same in any order and for any terms that add up to as much; where one is null, or they overflow, that of `sums`, their doubles."""
    return F.coalesce(F.when(F.count(parts) == F.count(sums), F.try_sum(parts)).cast("double"), F.sum(sums), F.lit(0.0))


def any0(x: Column) -> Column:
    """Whether any is true; nulls don't count, and of no rows it is false."""
    return F.coalesce(F.bool_or(x), F.lit(False))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, cut off towards zero."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return ((micros(end) - micros(start)) / 1_000_000).cast("long")


def distinct_with_null(x: Column) -> Column:
    """The number of distinct values, where null is one."""
    return F.count_distinct(x) + F.max(F.when(x.isNull(), 1).otherwise(0))


def keep_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def seeded_hash(seed: int, *keys: Column) -> Column:
    """A whole number below 2^60 from SHA-256 of the seed and the keys: the same in any engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def uniform(h: Column) -> Column:
    """A number in (0, 1) from a seeded hash."""
    return (h % UNIFORM + 0.5) / float(UNIFORM)
