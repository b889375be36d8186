"""Area-weighted regridding of footprints, sampling of gridded fields, and raster statistics, in long form: one row per cell."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.semantics import finite

SIZE, CELL = 24, 3000.0
MAX_CLOUD, GOOD, COVERAGE = 0.20, 0, 0.90


def cells(keys: DataFrame, size: int = SIZE, cell: float = CELL) -> DataFrame:
    """row, col and bounds x0, y0, x1, y1 of each cell of each key's grid (x, y: its centre), row 0 in the north."""
    half = size * cell / 2
    rows = keys.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))))
    rows = rows.withColumns({"row": F.floor(F.col("_c") / size).cast("int"), "col": (F.col("_c") % size).cast("int")}).drop("_c")
    return rows.withColumns({"x0": F.col("x") - half + F.col("col") * cell, "x1": F.col("x") - half + (F.col("col") + 1) * cell, "y1": F.col("y") + half - F.col("row") * cell, "y0": F.col("y") + half - (F.col("row") + 1) * cell})


def touched_cells(pixels: DataFrame, size: int = SIZE, cell: float = CELL) -> DataFrame:
    """Pixels (with bounds bx0.. and their grid's centre x, y) once for each cell that their bounds reach into, with the cell's bounds."""
    half = size * cell / 2
    span = lambda lo, hi: F.sequence(F.greatest(F.lit(0), F.floor(lo / cell)).cast("int"), F.least(F.lit(size - 1), F.ceil(hi / cell) - 1).cast("int"))
    inside = pixels.filter(f"bx1 > x - {half} and bx0 < x + {half} and by1 > y - {half} and by0 < y + {half} and bx1 > bx0 and by1 > by0")
    left, top = F.col("x") - half, F.col("y") + half
    rows = inside.withColumn("col", F.explode(span(F.col("bx0") - left, F.col("bx1") - left))).withColumn("row", F.explode(span(top - F.col("by1"), top - F.col("by0"))))
    return rows.withColumns({"x0": left + F.col("col") * cell, "x1": left + (F.col("col") + 1) * cell, "y1": top - F.col("row") * cell, "y0": top - (F.col("row") + 1) * cell})


def with_bounds(pixels: DataFrame) -> DataFrame:
    """Adds the bounds of corner arrays cx, cy."""
    return pixels.withColumns({"bx0": F.array_min("cx"), "bx1": F.array_max("cx"), "by0": F.array_min("cy"), "by1": F.array_max("cy")})


def rectangle_area() -> Column:
    """Overlap in km2 of axis-aligned bounds and a cell."""
    side = lambda a, b, c, d: F.greatest(F.lit(0.0), F.least(F.col(b), F.col(d)) - F.greatest(F.col(a), F.col(c)))
    return side("bx0", "bx1", "x0", "x1") * side("by0", "by1", "y0", "y1") / 1e6


def clipped_areas(x: np.ndarray, y: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Area of each quadrilateral (rows of x, y) inside its box (x0, y0, x1, y1), each clipped by the box's four sides in turn; 0 for crossed or flat ones."""
    n = len(x)
    cross = lambda ax, ay, bx, by: ax * by - ay * bx

    def crossing(i: int, j: int, k: int, m: int) -> np.ndarray:
        side = lambda a, b, c: cross(x[:, b] - x[:, a], y[:, b] - y[:, a], x[:, c] - x[:, a], y[:, c] - y[:, a])
        return (side(i, j, k) * side(i, j, m) < 0) & (side(k, m, i) * side(k, m, j) < 0)

    bad = crossing(0, 1, 2, 3) | crossing(1, 2, 3, 0)
    px, py, size = np.zeros((n, 12)), np.zeros((n, 12)), np.full(n, x.shape[1])
    px[:, :4], py[:, :4] = x, y
    rows = np.arange(n)
    for axis, column, sign in ((0, 0, 1), (0, 2, -1), (1, 1, 1), (1, 3, -1)):
        qx, qy, count = np.zeros_like(px), np.zeros_like(py), np.zeros(n, int)
        for v in range(int(size.max(initial=0))):
            here = v < size
            nxt = np.where(v + 1 < size, v + 1, 0)
            ax, ay, bx, by = px[:, v], py[:, v], px[rows, nxt], py[rows, nxt]
            da, db = (sign * ((ax if axis == 0 else ay) - boxes[:, column]), sign * ((bx if axis == 0 else by) - boxes[:, column]))
            keep = here & (da >= 0)
            qx[rows[keep], count[keep]], qy[rows[keep], count[keep]] = ax[keep], ay[keep]
            count += keep
            cut = here & ((da >= 0) != (db >= 0))
            t = np.where(cut, da / np.where(da == db, 1, da - db), 0)
            qx[rows[cut], count[cut]], qy[rows[cut], count[cut]] = (ax + t * (bx - ax))[cut], (ay + t * (by - ay))[cut]
            count += cut
        px, py, size = qx, qy, count
    total = np.zeros(n)
    for v in range(int(size.max(initial=0))):
        here = v < size
        nxt = np.where(v + 1 < size, v + 1, 0)
        total += np.where(here, cross(px[:, v], py[:, v], px[rows, nxt], py[rows, nxt]), 0)
    return np.where(bad, 0.0, np.abs(total) / 2)


@F.pandas_udf(T.DoubleType())
def quad_area(cx: pd.Series, cy: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    """Overlap in km2 of quadrilaterals and cells."""
    if not len(cx):
        return pd.Series([], dtype=float)
    return pd.Series(clipped_areas(np.stack(cx), np.stack(cy), np.stack([x0, y0, x1, y1], axis=1)) / 1e6)


def tessellated(overlaps: DataFrame, key: list[str], max_cloud: float = MAX_CLOUD, good: int = GOOD) -> DataFrame:
    """Statistics of each cell that a pixel overlaps, from rows with area (km2), value, cloud, flag, uncertainty.

    Native count, area, cloud mean, worst flag and good share take all overlaps; value,
    weights, effective number and uncertainty those that are accepted: flag good, cloud
    up to max_cloud, value finite.
    """
    a = F.col("area")
    accepted = (F.col("flag") == good) & (F.col("cloud") <= max_cloud) & finite(F.col("value"))
    sure = accepted & finite(F.col("uncertainty"))
    some = lambda x, where: F.coalesce(F.sum(F.when(where, x)), F.lit(0.0))
    out = overlaps.filter("area > 0").groupBy(*key, "row", "col").agg(
        F.count("*").alias("native_count"), F.sum("area").alias("total_area"), (F.sum(a * F.col("cloud")) / F.sum(a)).alias("cloud_mean"), F.max("flag").alias("worst_flag"),
        (some(a, F.col("flag") == good) / F.sum(a)).alias("good_share"), some(a, accepted).alias("weight"), some(a * a, accepted).alias("_w2"), some(a * F.col("value"), accepted).alias("_wv"),
        F.count_if(accepted).alias("accepted_count"), some(a, sure).alias("_ws"), some(a * F.col("uncertainty"), sure).alias("_wu"),
    )
    over = lambda x, y, other: F.when(F.col(y) > 0, F.col(x) / F.when(F.col(y) > 0, F.col(y))).otherwise(F.lit(other))
    out = out.withColumns({"value": over("_wv", "weight", float("nan")), "n_eff": F.when(F.col("_w2") > 0, F.col("weight") * F.col("weight") / F.when(F.col("_w2") > 0, F.col("_w2"))).otherwise(F.lit(0.0)), "uncertainty": over("_wu", "_ws", float("nan"))})
    return out.drop("_w2", "_wv", "_ws", "_wu")


def full_grid(grid: DataFrame, values: DataFrame, key: list[str], floor_km2: float = 0.0) -> DataFrame:
    """All cells of the grid: unobserved ones with NaN means, zero weights and flag -1; value is NaN where the weight is under a positive floor."""
    rows = grid.select(*key, "row", "col").join(values, [*key, "row", "col"], "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("native_count", "accepted_count")} | {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("total_area", "weight", "n_eff", "good_share")}
    nan = {c: F.coalesce(F.col(c), F.lit(float("nan"))) for c in ("value", "cloud_mean", "uncertainty")}
    rows = rows.withColumns(zero | nan | {"worst_flag": F.coalesce(F.col("worst_flag"), F.lit(-1))})
    return rows.withColumn("value", F.when(F.col("weight") < floor_km2, F.lit(float("nan"))).otherwise(F.col("value"))) if floor_km2 > 0 else rows


def bilinear(points: DataFrame, field: DataFrame, rows: int, cols: int, key: list[str]) -> DataFrame:
    """Adds value, the field (key, i, j, value) at fractional (fi, fj), held at the edges: the four neighbours come by one join and are summed by weight. Points that repeat stay one row each."""
    clamp = lambda v, n: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(n - 1)))
    p = points.withColumn("_row", F.monotonically_increasing_id()).withColumns({"_fi": clamp(F.col("fi"), rows), "_fj": clamp(F.col("fj"), cols)})
    p = p.withColumns({"_i": F.least(F.floor("_fi"), F.lit(rows - 2)).cast("int"), "_j": F.least(F.floor("_fj"), F.lit(cols - 2)).cast("int")})
    di, dj = F.col("_fi") - F.col("_i"), F.col("_fj") - F.col("_j")
    corner = lambda a, b: F.struct((F.col("_i") + a).alias("i"), (F.col("_j") + b).alias("j"), ((di if a else 1 - di) * (dj if b else 1 - dj)).alias("w"))
    around = p.withColumn("_c", F.explode(F.array(*(corner(a, b) for a in (0, 1) for b in (0, 1))))).select(*points.columns, "_row", F.col("_c.i").alias("i"), F.col("_c.j").alias("j"), F.col("_c.w").alias("_w"))
    return around.join(field, [*key, "i", "j"]).groupBy(*points.columns, "_row").agg(F.sum(F.col("_w") * F.col("value")).alias("value")).drop("_row")


def coverage_features(rasters: DataFrame, floor: float = COVERAGE) -> DataFrame:
    """Per record: min_fraction, means of diagnostics over finite cells of all steps (null where there are none), the first step under the floor and whether all pass.

    rasters: record, t, value, cloud, quality, uncertainty, one row per cell.
    """
    seen = finite(F.col("value"))
    steps = rasters.groupBy("record", "t").agg(F.avg(seen.cast("double")).alias("fraction"), *(f(F.when(seen & finite(F.col(c)), F.col(c))).alias(f"{c}_{n}") for c in ("cloud", "quality", "uncertainty") for n, f in (("sum", F.sum), ("count", F.count))))
    means = [(F.sum(f"{c}_sum") / F.nullif(F.sum(f"{c}_count"), F.lit(0))).alias(f"mean_{c}") for c in ("cloud", "quality", "uncertainty")]
    return steps.groupBy("record").agg(F.min("fraction").alias("min_fraction"), F.min(F.when(F.col("fraction") < floor, F.col("t"))).alias("failed_step"), (F.min("fraction") >= floor).alias("complete"), *means)


def gap_filled(image: DataFrame, key: list[str]) -> DataFrame:
    """Adds filled: for gaps, the mean of the row's and of the column's linear interpolation (ends held); a line without support gives the image's mean.

    image: key, row, col, value (null or NaN in gaps).
    """
    seen = F.when(finite(F.col("value")), F.col("value"))
    rows = image.withColumn("_v", seen).withColumn("_mean", F.avg(seen).over(Window.partitionBy(*key)))

    def line(along: str, across: str) -> Column:
        w = Window.partitionBy(*key, across).orderBy(along)
        mark = F.when(F.col("_v").isNotNull(), F.struct(F.col(along).cast("double").alias("p"), F.col("_v").alias("v")))
        a = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        b = F.first(mark, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        between = a["v"] + (b["v"] - a["v"]) * (F.col(along) - a["p"]) / F.nullif(b["p"] - a["p"], F.lit(0.0))
        return F.coalesce(between, a["v"], b["v"], F.col("_mean"))

    rows = rows.withColumn("_r", line("col", "row")).withColumn("_c", line("row", "col"))
    return rows.withColumn("filled", F.coalesce("_v", (F.col("_r") + F.col("_c")) / 2)).drop("_v", "_mean", "_r", "_c")
