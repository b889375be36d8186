"""Exact order statistics and quantiles of groups of any size, by passes that narrow each wanted rank to a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import finite
from ..tables import discard, materialized

#: Points of a pass's sketch, its accuracy, and distinct values of a range from which the rank is taken at once.
GRID, ACCURACY, FEW = 1000, 20_000, 50_000
#: Wanted ranks that are sent to every task; more are joined by shuffle.
BROADCAST_RANKS = 50_000


def same(a: str, b: str, columns: list[str]) -> Column:
    """Rows of two aliased tables with the same keys; null is a key too."""
    out = F.lit(True)
    for c in columns:
        out &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def order_statistics(values: DataFrame, by: list[str], ranks: DataFrame, value: str = "value") -> DataFrame:
    """by, rank and value: in each group the value of each wanted rank, from 0 for the least.

    values: by and a number that isn't null; ranks: by and rank, distinct and below the group's size. Each pass sketches the rows
    that are left for a rank in bounded memory, takes the two points of the sketch around the rank, counts exactly what
    lies below and between them, and keeps what is between; a rank outside keeps its side. Once a range has few distinct
    values their counts give the value. No task ever holds a group, and each pass leaves about a thousandth of its rows.
    """
    keys = [*by, "rank"]
    wanted = materialized(ranks.select(*keys, F.col("rank").alias("_at"), F.lit(None).cast("long").alias("_before")), "ranks")
    sent = F.broadcast if wanted.count() <= BROADCAST_RANKS else (lambda df: df)
    state = ["_at", "_before"]
    rows = values.select(*by, F.col(value).alias("_v")).alias("v").join(sent(wanted).alias("w"), same("v", "w", by)).select(*(F.col(f"w.{k}") for k in keys), "_v", *state)
    done, written = None, [wanted]
    while True:
        points = F.percentile_approx("_v", F.array(*(F.lit(i / GRID) for i in range(GRID + 1))), F.lit(ACCURACY)).alias("_p")
        sketch = materialized(rows.groupBy(*keys, *state).agg(F.count("*").alias("_n"), F.approx_count_distinct("_v").alias("_d"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), points), "sketch")
        few = sketch.filter(F.col("_d") <= FEW).select(*keys)
        each = rows.alias("r").join(sent(few).alias("f"), same("r", "f", keys), "left_semi").groupBy(*keys, "_at", "_v").agg(F.count("*").alias("_c"))
        sums = each.groupBy(*keys, "_at").agg(F.array_sort(F.collect_list(F.struct("_v", "_c"))).alias("_s"))
        first = F.aggregate("_s", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast(values.schema[value].dataType).alias("v")), lambda a, x: F.struct((a["n"] + x["_c"]).alias("n"), F.when(a["n"] > F.col("_at"), a["v"]).otherwise(x["_v"]).alias("v")))
        found = materialized(sums.select(*keys, first["v"].alias("value")), "found-ranks")
        done = found if done is None else done.unionByName(found)
        many = sketch.filter(F.col("_d") > FEW)
        if many.isEmpty():
            discard(sketch, *written)
            return done
        # A range that the last pass left as it was is cut in its middle.
        point = lambda x: F.get("_p", x.cast("int"))
        step, stuck = F.col("_at") * GRID / F.col("_n"), F.coalesce(F.col("_n") == F.col("_before"), F.lit(False))
        low = F.when(stuck, F.col("_least")).otherwise(point(F.greatest(F.lit(0), F.floor(step) - 2)))
        high = F.when(stuck, (F.col("_least") + F.col("_most")) / 2).otherwise(point(F.least(F.lit(GRID), F.ceil(step) + 2)))
        ends = many.select(*keys, "_at", "_n", low.alias("_lo"), high.alias("_hi"))
        marked = rows.drop(*state).alias("r").join(sent(ends).alias("e"), same("r", "e", keys)).select(*(F.col(f"e.{k}") for k in keys), "_v", "_at", "_n", "_lo", "_hi")
        side = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).otherwise(0)
        counts = marked.groupBy(*keys, "_at", "_n", "_lo", "_hi").agg(F.count_if(side == -1).alias("_b"), F.count_if(side == 0).alias("_i"))
        where = F.when(F.col("_at") < F.col("_b"), -1).when(F.col("_at") >= F.col("_b") + F.col("_i"), 1).otherwise(0)
        less = F.when(where == -1, F.lit(0)).when(where == 0, F.col("_b")).otherwise(F.col("_b") + F.col("_i"))
        kept = materialized(counts.select(*keys, "_lo", "_hi", where.alias("_where"), (F.col("_at") - less).alias("_at"), F.col("_n").alias("_before")), "bounds")
        left = rows.drop(*state).alias("r").join(sent(kept).alias("e"), same("r", "e", keys)).filter(side == F.col("_where"))
        rows = materialized(left.select(*(F.col(f"e.{k}") for k in keys), "_v", *state), "in-range")
        discard(sketch, *written)
        written = [kept, rows]


def quantiles(values: DataFrame, by: list[str], shares: dict[str, float], value: str = "value") -> DataFrame:
    """by, n and a column for each named share: the quantile between the two nearest ranks, of the finite values of each group. A group without any has no row."""
    rows = values.filter(finite(F.col(value)))
    sizes = materialized(rows.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 0"), "group-sizes")
    at = {name: share * (F.col("n") - 1) for name, share in shares.items()}
    wanted = sizes.select(*by, F.explode(F.array(*(f(p).cast("long") for p in at.values() for f in (F.floor, F.ceil)))).alias("rank")).distinct()
    found = materialized(order_statistics(rows, by, wanted, value), "quantile-ranks")
    ranked = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_m"))
    rows = sizes.alias("s").join(ranked.alias("q"), same("s", "q", by)).select(*(F.col(f"s.{c}") for c in by), "n", "_m")
    low = lambda p: F.element_at("_m", F.floor(p).cast("long"))
    high = lambda p: F.element_at("_m", F.ceil(p).cast("long"))
    return rows.select(*by, "n", *((low(p) + (high(p) - low(p)) * (p - F.floor(p))).alias(name) for name, p in at.items()))
