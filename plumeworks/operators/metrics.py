"""Classification and reconstruction metrics, overall and by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import finite
from .order import summed_before
from .quantiles import quantiles


def classification_metrics(frame: DataFrame, classes: int = 3, by: list[str] | None = None) -> DataFrame:
    """n, accuracy, balanced_accuracy (over classes that occur), macro_f1 (0 where undefined) of truth and predicted, from counts by pair."""
    by = by or []
    pairs = frame.groupBy(*by, "truth", "predicted").agg(F.count("*").alias("n"))
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("double")
    hit = [of((F.col("truth") == k) & (F.col("predicted") == k)).alias(f"hit{k}") for k in range(classes)]
    true = [of(F.col("truth") == k).alias(f"true{k}") for k in range(classes)]
    said = [of(F.col("predicted") == k).alias(f"said{k}") for k in range(classes)]
    c = pairs.groupBy(*by).agg(F.sum("n").alias("n"), *hit, *true, *said)
    total = lambda xs: sum(xs[1:], xs[0])
    over = lambda a, b: a / F.nullif(b, F.lit(0.0))
    recalls = [over(F.col(f"hit{k}"), F.col(f"true{k}")) for k in range(classes)]
    f1 = [F.coalesce(over(2 * F.col(f"hit{k}"), F.col(f"true{k}") + F.col(f"said{k}")), F.lit(0.0)) for k in range(classes)]
    present = total([(F.col(f"true{k}") > 0).cast("int") for k in range(classes)])
    seen = total([((F.col(f"true{k}") + F.col(f"said{k}")) > 0).cast("int") for k in range(classes)])
    return c.select(
        *by, "n", over(total([F.col(f"hit{k}") for k in range(classes)]), F.col("n").cast("double")).alias("accuracy"),
        over(total([F.coalesce(r, F.lit(0.0)) for r in recalls]), present.cast("double")).alias("balanced_accuracy"), over(total(f1), seen.cast("double")).alias("macro_f1"),
        *(r.alias(f"recall_{k}") for k, r in enumerate(recalls)),
    )


def confusion(frame: DataFrame, classes: int = 3) -> DataFrame:
    """truth, predicted and n of all pairs of classes."""
    spark = frame.sparkSession
    every = spark.range(classes * classes).select(F.floor(F.col("id") / classes).cast("int").alias("truth"), (F.col("id") % classes).cast("int").alias("predicted"))
    n = frame.groupBy(F.col("truth").cast("int").alias("truth"), F.col("predicted").cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    return every.join(n, ["truth", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def auroc(frame: DataFrame, scores: list[str], by: list[str] | None = None) -> DataFrame:
    """macro_auroc, the mean over classes of the chance that a row of the class has the higher score, ties half; null unless all classes are there.

    It is counted from distinct scores by running sums over each class's scores, which
    are sorted in ranges, so that no task takes a class.
    """
    by = by or []
    long = frame.select(*by, "truth", F.explode(F.array(*(F.struct(F.lit(k).alias("class"), F.col(s).cast("double").alias("score")) for k, s in enumerate(scores)))).alias("x"))
    g = long.groupBy(*by, F.col("x.class").alias("class"), F.col("x.score").alias("score")).agg(F.count_if(F.col("truth") == F.col("x.class")).alias("pos"), F.count("*").alias("n"))
    rows = summed_before(g.withColumn("neg", F.col("n") - F.col("pos")), ["score"], [*by, "class"], {"below": "neg"})
    rows = rows.withColumn("wins", F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    each = rows.groupBy(*by, "class").agg(F.sum("wins").alias("wins"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    value = F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("wins") / F.nullif((F.col("p") * F.col("q")).cast("double"), F.lit(0.0)))
    return each.withColumn("a", value).groupBy(*by).agg(F.when(F.count("a") == len(scores), F.avg("a")).alias("macro_auroc"))


def tertiles(value: Column, by: list[str] | None = None) -> Column:
    """Low, Middle or High by the average rank's share of all values."""
    w = Window.partitionBy(*(by or []))
    rank = F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*(by or []), value)) - 1) / 2.0
    share = rank / F.count("*").over(w)
    return F.when(share <= 1 / 3, "Low").when(share <= 2 / 3, "Middle").otherwise("High")


def accuracy_by_tertile(frame: DataFrame, characteristic: str, unit: str = "aoi_id") -> DataFrame:
    """Accuracy in the thirds of the units by their median characteristic: units, records, value_min, value_max, accuracy."""
    unit_rows = frame.groupBy(unit).agg(F.median(characteristic).alias("_v")).filter("_v is not null")
    strata = unit_rows.withColumn("stratum", tertiles(F.col("_v")))
    rows = frame.join(strata, unit)
    return rows.groupBy("stratum").agg(F.count_distinct(unit).alias("units"), F.count("*").alias("records"), F.min("_v").alias("value_min"), F.max("_v").alias("value_max"), F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("accuracy"))


def compared(metrics: DataFrame, models: list[str]) -> DataFrame:
    """metrics in rows and models in columns, for each split, from (split, model, metric, value)."""
    return metrics.groupBy("split", "metric").pivot("model", models).agg(F.first("value"))


def aligned(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Two prediction frames side by side; a record that one lacks, or whose truth differs, is an error."""
    x, y = (f.select(*key, F.col("truth").alias(f"truth_{n}"), F.col("predicted").alias(f"predicted_{n}")) for f, n in ((a, "a"), (b, "b")))
    both = x.join(y, key, "full_outer")
    return both.withColumn("truth", F.when(F.col("truth_a") == F.col("truth_b"), F.col("truth_a")).otherwise(F.raise_error(F.lit("frames do not align")))).drop("truth_a", "truth_b")


def reconstruction(frame: DataFrame, methods: list[str]) -> DataFrame:
    """mae, rmse and bias of each method's column against target where hidden is 1, and the first method's gain over the last in mae."""
    out = []
    for m in methods:
        e = F.col(m) - F.col("target")
        out += [(F.sum(F.abs(e)) / F.count("*")).alias(f"{m}_mae"), F.sqrt(F.sum(e * e) / F.count("*")).alias(f"{m}_rmse"), (F.sum(e) / F.count("*")).alias(f"{m}_bias")]
    rows = frame.filter("hidden = 1").agg(F.count("*").alias("n"), *out)
    return rows.withColumn("mae_gain", 1 - F.col(f"{methods[0]}_mae") / F.nullif(F.col(f"{methods[-1]}_mae"), F.lit(0.0)))


def histogram(frame: DataFrame, value: str, bins: int, low: float = 0.01, high: float = 0.99, by: list[str] | None = None) -> DataFrame:
    """Counts in equal bins between two exact quantiles of all finite values; the edges' bins take what lies beyond."""
    rows = frame.filter(finite(F.col(value)))
    lim = quantiles(rows, [], {"_lo": low, "_hi": high}, value).select("_lo", "_hi")
    b = F.least(F.greatest(F.floor((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins), F.lit(0)), F.lit(bins - 1))
    return rows.crossJoin(F.broadcast(lim)).groupBy(*(by or []), b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def balance_histogram(frame: DataFrame, value: str, by: list[str], bins: int = 70, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """by, bin, from, to and n of the finite values within the wider of two exact quantiles on both sides of 0, in equal bins; values beyond are left out."""
    rows = frame.filter(finite(F.col(value)))
    lim = quantiles(rows, [], {"_lo": low, "_hi": high}, value).select(F.greatest(F.abs("_lo"), F.abs("_hi")).alias("_lim"))
    lim = lim.select(F.when(F.col("_lim") == 0, 1.0).otherwise(F.col("_lim")).alias("_lim"))
    place = F.least(F.floor((F.col(value) + F.col("_lim")) / (2 * F.col("_lim")) * bins), F.lit(bins - 1)).cast("int")
    out = rows.crossJoin(F.broadcast(lim)).filter(F.abs(F.col(value)) <= F.col("_lim")).groupBy(*by, "_lim", place.alias("bin")).agg(F.count("*").alias("n"))
    width = 2 * F.col("_lim") / bins
    return out.select(*by, "bin", (F.col("bin") * width - F.col("_lim")).alias("from"), ((F.col("bin") + 1) * width - F.col("_lim")).alias("to"), "n")


def class_shares(eligible: DataFrame, balanced: DataFrame, label: str, by: list[str]) -> DataFrame:
    """by, label, records and share before balancing, and after; a class that is gone has 0."""
    n = lambda df, name: df.groupBy(*by, label).agg(F.count("*").alias(name))
    both = n(eligible, "eligible").join(n(balanced, "balanced"), [*by, label], "full").fillna(0, ["eligible", "balanced"])
    total = lambda c: F.sum(c).over(Window.partitionBy(*by))
    return both.withColumns({f"{c}_share": F.coalesce(F.col(c) / F.nullif(total(c), F.lit(0)), F.lit(0.0)) for c in ("eligible", "balanced")})


def gain_by_tertile(frame: DataFrame, characteristic: str, first: str, second: str, unit: str = "aoi_id", by: list[str] | None = None) -> DataFrame:
    """Of two models' predictions of the same records, in the thirds of the units by their median characteristic (in each group `by`): aoi_count, record_count, value_min, value_max, both accuracies and the second's gain."""
    by = by or []
    units = frame.groupBy(*by, unit).agg(F.median(characteristic).alias("_v")).filter("_v is not null")
    rows = frame.join(units.withColumn("stratum", tertiles(F.col("_v"), by)), [*by, unit])
    right = lambda c: F.avg((F.col("truth") == F.col(c)).cast("double"))
    out = rows.groupBy(*by, "stratum").agg(F.count_distinct(unit).alias("aoi_count"), F.count("*").alias("record_count"), F.min("_v").alias("value_min"), F.max("_v").alias("value_max"), right(first).alias(f"{first}_accuracy"), right(second).alias(f"{second}_accuracy"))
    return out.withColumn("accuracy_gain", F.col(f"{second}_accuracy") - F.col(f"{first}_accuracy"))


def cohort_histogram(frame: DataFrame, value: str, cohort: str, bins: int = 30, low: float = 0.01, high: float = 0.99, log: bool = False) -> tuple[DataFrame, DataFrame]:
    """(histogram, medians) of a characteristic in cohorts of units: cohort, bin and n of the finite values between two exact quantiles of all, the
    ends included, in equal bins; and cohort, median (as it is) and n. With log, the histogram is of log10(1 + x), values below 0 as 0.

    Quantiles that are equal are taken half a unit apart on both sides.
    """
    rows = frame.filter(finite(F.col(value))).select(cohort, F.col(value).cast("double").alias("raw"))
    medians = quantiles(rows, [cohort], {"median": 0.5}, "raw")
    rows = rows.withColumn("_v", F.log10(1 + F.greatest("raw", F.lit(0.0))) if log else F.col("raw"))
    ends = quantiles(rows, [], {"_lo": low, "_hi": high}, "_v").select(F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"), F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    place = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("int")
    inside = rows.crossJoin(F.broadcast(ends)).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    return inside.groupBy(cohort, place.alias("bin")).agg(F.count("*").alias("n")), medians
