"""Places and running sums of rows in a total order, by one shuffle into sorted ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import materialized
from .quantiles import same

#: `monotonically_increasing_id` has the place within a partition in its low bits.
PLACE_BITS = (1 << 33) - 1


def _ranges(frame: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return frame.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)


def numbered(frame: DataFrame, order: list[str], by: list[str] | None = None, name: str = "place") -> DataFrame:
    """Adds a row's place from 0, within `by`, by a total order.

    Ranges are sorted in parallel and written with each row's place in its range; a small table of the ranges' first places and
    counts turns it into the place in all, so that no task takes a whole group and nothing is shuffled again.
    """
    by = by or []
    rows = _ranges(frame, by, order).withColumns({"_part": F.spark_partition_id(), "_local": F.monotonically_increasing_id().bitwiseAND(PLACE_BITS)})
    rows = materialized(rows, "numbered")
    ranges = rows.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_local").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialized(ranges.select("_part", *by, (before - F.col("_first")).alias("_start")), "range-starts")
    out = rows.alias("r").join(starts.alias("s"), (F.col("r._part") == F.col("s._part")) & same("r", "s", by))
    return out.select(*(F.col(f"r.{c}") for c in frame.columns), (F.col("_start") + F.col("_local")).alias(name))


def summed(schema: T.StructType, by: list[str], columns: dict[str, str]):
    """Adds the sums of the rows before in the range and group; rows come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, so_far = None, dict.fromkeys(columns, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.select(by).to_pylist() if by else [{}] * batch.num_rows
            if group is not None and keys[0] != group:
                so_far = dict.fromkeys(columns, 0)
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])]
            size, group, out = np.diff([*starts, len(keys)]), keys[-1], {}
            for name, c in columns.items():
                v = batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)
                total = np.concatenate((np.zeros(1, v.dtype), np.cumsum(v)))[:-1]
                base = total[starts].copy()
                base[0] -= so_far[name]
                out[name] = total - np.repeat(base, size)
                so_far[name] = out[name][-1] + v[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[n]) for n in columns)], names=[*batch.schema.names, *columns])

    return run


def summed_before(frame: DataFrame, order: list[str], by: list[str], columns: dict[str, str]) -> DataFrame:
    """Adds, for each new name, the sum of its column (long or double; null counts as 0) over the rows before, within `by` and by a total order; 0 for the first.

    As with places, each sorted range adds up its own rows as they are written, and a small table of the ranges' sums is its offset.
    """
    kinds = {n: frame.schema[c].dataType if isinstance(frame.schema[c].dataType, T.DoubleType) else T.LongType() for n, c in columns.items()}
    rows = frame.withColumns({f"_{n}": F.col(c).cast(kinds[n]) for n, c in columns.items()})
    rows = _ranges(rows, by, order).withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, kinds[n]) for n in columns)])
    rows = materialized(rows.mapInArrow(summed(schema, by, {n: f"_{n}" for n in columns}), schema), "summed")
    ranges = rows.groupBy("_part", *by).agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in columns))
    over = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialized(ranges.select("_part", *by, *(F.coalesce(F.sum(f"_{n}").over(over), F.lit(0)).alias(f"_s_{n}") for n in columns)), "range-sums")
    out = rows.alias("r").join(starts.alias("s"), (F.col("r._part") == F.col("s._part")) & same("r", "s", by))
    return out.select(*(F.col(f"r.{c}") for c in frame.columns), *((F.col(f"r.{n}") + F.col(f"s._s_{n}")).alias(n) for n in columns))
