"""Geographic splits and deterministic samples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.semantics import seeded_hash, uniform
from ..tables import materialized
from .quantiles import order_statistics, same

SPLITS, SHARES, SEED = ("train", "val", "test"), (0.70, 0.15, 0.15), 42


def cluster_counts(frame: DataFrame, cluster: str, category: str | None, classes: tuple[str, ...]) -> DataFrame:
    """cluster, records and an array of its counts by class (of all records without a category)."""
    counts = [F.count_if(F.col(category) == c) for c in classes] if category else [F.count("*")]
    return frame.groupBy(cluster).agg(F.count("*").alias("records"), F.array(*counts).alias("counts"))


def folded(schema, total: list[float], n: int, shares: tuple[float, ...], scaled: bool):
    """Gives clusters, which come one by one in their order, to splits; it holds what each split has so far and no cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, left = len(shares), n
        wanted = [[t * s for t in total] for s in shares]
        unit = [[max(w, 1.0) if scaled else 1.0 for w in ws] for ws in wanted]
        held, used = [[0.0] * len(total) for _ in shares], [0] * k
        for batch in batches:
            out = []
            for counts in batch.column("counts").to_pylist():
                empty = used.count(0)
                best, least = 0, None
                for i in range(k):
                    if left == empty and used[i]:
                        continue
                    gain = sum(((h + c - w) / u) ** 2 for h, c, w, u in zip(held[i], counts, wanted[i], unit[i], strict=True)) - sum(((h - w) / u) ** 2 for h, w, u in zip(held[i], wanted[i], unit[i], strict=True))
                    gain = round(gain, 12)
                    if least is None or gain < least:
                        best, least = i, gain
                held[best] = [h + c for h, c in zip(held[best], counts, strict=True)]
                used[best] += 1
                left -= 1
                out.append(SPLITS[best])
            yield pa.RecordBatch.from_arrays([batch.column("cluster"), pa.array(out, pa.string())], names=list(schema.names))

    return run


def greedy_splits(counts: DataFrame, cluster: str, seed: int = SEED, shares: tuple[float, ...] = SHARES, scaled: bool = True, strict: bool = True) -> DataFrame:
    """cluster and split: clusters, the largest first, go to the split that leaves the least squared miss of its targets.

    With scaled, misses are divided by the target (1 at least) and summed over splits and classes. Equal misses go to the
    earlier split. The last clusters fill splits that are still empty. Fewer clusters than
    splits are an error; if not strict, some splits stay empty. Each choice depends on those before, so that one row per cluster, not of the frame, passes
    through one task in order, as a stream: the task keeps the splits' sums alone.
    """
    items = materialized(counts.select(F.col(cluster).alias("cluster"), "records", seeded_hash(seed, F.col(cluster)).alias("_h"), F.transform("counts", lambda c: c.cast("double")).alias("counts")), "clusters")
    width = items.agg(F.count("*").alias("n"), F.max(F.size("counts")).alias("width")).first()
    if strict and width["n"] < len(shares):
        raise ValueError(f"fewer than {len(shares)} clusters")
    total = list(items.agg(*(F.sum(F.get("counts", F.lit(i))).alias(f"c{i}") for i in range(width["width"]))).first()) if width["n"] else []
    schema = T.StructType([T.StructField(cluster, items.schema["cluster"].dataType), T.StructField("split", T.StringType())])
    ordered = items.repartition(1).sortWithinPartitions(F.col("records").desc(), "_h", "cluster")
    return ordered.select("cluster", "counts").mapInArrow(folded(schema, total, width["n"], shares, scaled), schema)


def weighted_sample(frame: DataFrame, count: int | Column, weight: Column, identity: list[str], by: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """`count` rows (in each group `by`; a column has one value in a group) without replacement, chances by weight: the least -ln(u) / weight, u from a
    seeded hash of the identity; of equal ones the least hash, then identity. A row whose weight is null or NaN is never drawn.

    The key of the last row that is drawn is found by order statistics. Rows below it are drawn where they are, and only
    those that share this very key are ranked, so that no group is sorted.
    """
    by = by or []
    h = seeded_hash(seed, *(F.col(c) for c in identity))
    rows = frame.withColumn("_h", h).withColumn("_key", -F.log(uniform(F.col("_h"))) / weight).withColumn("_count", (F.lit(count) if isinstance(count, int) else count).cast("long"))
    rows = materialized(rows.filter("_key is not null and not isnan(_key)"), "keys")
    sizes = materialized(rows.groupBy(*by).agg(F.count("*").alias("_n"), F.max("_count").alias("_count")), "key-counts")
    wanted = sizes.filter("_count > 0 and _count < _n").select(*by, (F.col("_count") - 1).alias("rank"))
    last = materialized(order_statistics(rows, by, wanted, "_key").select(*by, F.col("value").alias("_last")), "last-keys")
    cut = rows.alias("r").join(last.alias("l"), same("r", "l", by), "left").select("r.*", "_last").filter("_count > 0")
    drawn = cut.filter("_last is null or _key < _last")
    ties = materialized(cut.filter("_key = _last"), "tied-keys")
    below = drawn.filter("_last is not null").groupBy(*by).agg(F.count("*").alias("_below"))
    ranked = ties.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy("_h", *identity)))
    tied = ranked.alias("t").join(below.alias("b"), same("t", "b", by), "left").filter(F.col("_place") <= F.col("_count") - F.coalesce("_below", F.lit(0)))
    return drawn.select(*frame.columns).unionByName(tied.select("t.*").select(*frame.columns))


def balanced(frame: DataFrame, label: str, classes: tuple[str, ...], identity: list[str], steady: str = "steady", seed: int = SEED, by: str = "split", strict: bool = True) -> DataFrame:
    """As many rows of each class in each split as its rarest class has; the steady class by weight, those far from the threshold more likely.

    frame has innovation and threshold. A split that lacks a class is an error; if not strict, it has no rows.
    """
    least = frame.groupBy(by).agg(*(F.count_if(F.col(label) == c).alias(f"_{c}") for c in classes))
    n = F.least(*(F.col(f"_{c}") for c in classes))
    least = least.select(by, (F.when(n > 0, n).otherwise(F.raise_error(F.concat(F.lit("a class is missing in "), F.col(by)))) if strict else n).alias("_least"))
    weight = F.when(F.col(label) == steady, F.least(F.lit(1.0), F.greatest(F.lit(0.01), 1 - F.abs(F.col("innovation")) / F.col("threshold")))).otherwise(F.lit(1.0))
    return weighted_sample(frame.join(F.broadcast(least), by), F.col("_least"), weight, identity, [by, label], seed).drop("_least")
