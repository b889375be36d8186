"""Channel statistics, scaling, masks and elementwise model inputs on array columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import finite
from .quantiles import quantiles

CLIP, LEAST_SCALE, IQR_SCALE = 8.0, 1e-12, 1.349


def safe_scale(x: Column) -> Column:
    """The scale, or 1 where it is not finite or not above 1e-12."""
    return F.when(finite(x) & (x > LEAST_SCALE), x).otherwise(F.lit(1.0))


def channel_stats(values: DataFrame, channel: str = "channel", robust: tuple = ()) -> DataFrame:
    """channel, count, center and scale of finite values: mean and population deviation, or for robust channels the exact median and IQR / 1.349. A channel may have any number of values."""
    rows = values.filter(finite(F.col("value")))
    sturdy = F.col(channel).isin(*robust) if robust else F.lit(False)
    plain = rows.filter(~sturdy).groupBy(channel).agg(F.count("*").alias("count"), F.avg("value").alias("center"), safe_scale(F.stddev_pop("value")).alias("scale"))
    if not robust:
        return plain
    q = quantiles(rows.filter(sturdy), [channel], {"low": 0.25, "center": 0.5, "high": 0.75})
    return plain.unionByName(q.select(channel, F.col("n").alias("count"), "center", safe_scale((F.col("high") - F.col("low")) / IQR_SCALE).alias("scale")))


def training_stats(values: DataFrame, features: DataFrame, names: tuple[str, ...], *, robust: tuple = (), split: str = "train", fixed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(image statistics by channel, statistics by feature: name, count, center, scale) of one split's records alone.

    values: split, channel, value; features: split and a column for each name. With fixed image statistics (channel,
    count, center, scale), such as those of an earlier training, only the features' are computed.
    """
    image = channel_stats(values.filter(F.col("split") == split), robust=robust) if fixed is None else fixed.select("channel", "count", "center", "scale")
    rows = features.filter(F.col("split") == split).select(F.explode(F.array(*(F.struct(F.lit(n).alias("channel"), F.col(n).cast("double").alias("value")) for n in names))).alias("f")).select("f.*")
    return image, channel_stats(rows).withColumnRenamed("channel", "name")


def clipped_share(values: DataFrame, stats: DataFrame, channel: str = "channel", clip: float = CLIP) -> DataFrame:
    """Share of each channel's finite values beyond clip scales of its center. stats has a row per channel."""
    z = (F.col("value") - F.col("center")) / F.col("scale")
    return values.filter(finite(F.col("value"))).join(F.broadcast(stats), channel).groupBy(channel).agg(F.avg((F.abs(z) > clip).cast("double")).alias("clipped"))


def normalized_array(x: Column, center: Column, scale: Column, clip: float = CLIP) -> Column:
    """Scaled and clipped values; gaps become 0 afterwards."""
    return F.transform(x, lambda v: F.when(F.coalesce(finite(v), F.lit(False)), F.greatest(F.lit(-clip), F.least(F.lit(clip), (v - center) / scale))).otherwise(F.lit(0.0)))


def valid_mask(x: Column) -> Column:
    """1 for finite values and 0 for gaps."""
    return F.transform(x, lambda v: F.coalesce(finite(v), F.lit(False)).cast("int"))


def kept_or_filled(observed: Column, mask: Column, predicted: Column, clip: float = CLIP) -> Column:
    """Observed values where the mask is 1, else predictions, clipped."""
    return F.transform(F.arrays_zip(observed.alias("o"), mask.alias("m"), predicted.alias("p")), lambda z: F.greatest(F.lit(-clip), F.least(F.lit(clip), F.when(z["m"] == 1, z["o"]).otherwise(z["p"]))))


def masked_l1(prediction: Column, target: Column, mask: Column) -> Column:
    """Sum of |p - t| m over sum of m, in an aggregate."""
    return F.sum(F.abs(prediction - target) * mask) / F.sum(mask)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it: otherwise an expression of expressions grows with a power of its layers."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column) -> Column:
    exponents = let(logits, lambda x: let(F.array_max(x), lambda top: F.transform(x, lambda z: F.exp(z - top))))
    return let(exponents, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda z: z / total)))


def argmax(x: Column) -> Column:
    """The first place of the largest, from 0."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def fused_logits(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def edge_weight(row: Column, col: Column, rows: int, cols: int) -> Column:
    """exp(-d / 2.5) + 0.06, d cells from the nearest edge."""
    d = F.least(row, col, F.lit(rows - 1) - row, F.lit(cols - 1) - col)
    return F.exp(-d / 2.5) + 0.06


def linear_layer(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """Weights times an array column, and the bias."""
    dot = lambda v, w: F.aggregate(F.zip_with(v, F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return let(x, lambda v: F.array(*(dot(v, w) + float(c) for w, c in zip(weights, bias, strict=True))))


def layer_norm(x: Column, gain: list[float], shift: list[float], eps: float = 1e-5) -> Column:
    n = float(len(gain))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
    spread = lambda v, mean: total(F.transform(v, lambda b: (b - mean) * (b - mean))) / n
    scaled = lambda v, mean, var: F.zip_with(F.zip_with(v, F.array(*map(F.lit, gain)), lambda y, g: (y - mean) / F.sqrt(var + eps) * g), F.array(*map(F.lit, shift)), lambda y, b: y + b)
    return let(x, lambda v: let(total(v) / n, lambda mean: let(spread(v, mean), lambda var: scaled(v, mean, var))))


def silu(x: Column) -> Column:
    return F.transform(x, lambda v: v / (1 + F.exp(-v)))


def seasonal_mlp(features: Column, layers: list[dict]) -> Column:
    """Logits of a small perceptron: linear layers, each but the last with a layer norm and SiLU. Meant for inference with given weights."""
    x = features
    for layer in layers[:-1]:
        x = silu(layer_norm(linear_layer(x, layer["weight"], layer["bias"]), layer["gain"], layer["shift"]))
    return linear_layer(x, layers[-1]["weight"], layers[-1]["bias"])


def finite_raster(x: Column, size: int) -> Column:
    """Whether an array has size values, all finite."""
    return (F.size(x) == size) & F.forall(x, lambda v: F.coalesce(finite(v), F.lit(False)))


def log_scale(x: Column) -> Column:
    return F.log(1 + x) / math.log(10)
