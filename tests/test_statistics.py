"""Order statistics, threshold samples, the streaming fold and statistics of the train split, against a second way."""

import math
import random
import time

import numpy as np
import pytest
from plumeworks.functions.semantics import seeded_hash, uniform
from plumeworks.operators import metrics, normalization, quantiles, splits
from pyspark.sql import Window
from pyspark.sql import functions as F


def some_values(n=1500):
    rng = random.Random(6)
    kinds = {0: lambda: rng.random(), 1: lambda: rng.choice([0.0, 0.0, 0.0, rng.random()]), 2: lambda: float(rng.randint(0, 3)), 3: lambda: math.exp(rng.gauss(0, 20)), None: lambda: -rng.random()}
    return [(g, kinds[g]()) for g in kinds for _ in range(n if g else n + 1)] + [(0, math.nan), (0, math.inf), (0, None), (9, 4.0), (8, math.nan)]


@pytest.mark.parametrize(("few", "grid"), [(50_000, 1000), (60, 40)])
def test_quantiles_by_passes(spark, monkeypatch, few, grid):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "GRID", grid)
    rows = some_values()
    df = spark.createDataFrame(rows, "g int, value double").repartition(5)
    got = {r["g"]: r for r in quantiles.quantiles(df, ["g"], {"a": 0.0, "b": 0.25, "d": 0.999, "e": 1.0}).collect()}
    assert set(got) == {0, 1, 2, 3, None, 9}
    for g, r in got.items():
        v = [x for h, x in rows if h == g and x is not None and math.isfinite(x)]
        assert r["n"] == len(v)
        assert [r[c] for c in "abde"] == pytest.approx(np.quantile(v, [0, 0.25, 0.999, 1]).tolist(), rel=1e-12)


def test_quantiles_of_one_group_and_of_nothing(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "value double")
    assert quantiles.quantiles(df, [], {"m": 0.5, "q": 0.25}).select("m", "q").first() == (5.0, 2.5)
    assert quantiles.quantiles(df.limit(0), [], {"m": 0.5}).count() == 0


def test_a_bad_sketch_changes_nothing(spark, monkeypatch):
    """Bounds are counted exactly: a sketch that points beside the rank costs passes, not the result."""
    monkeypatch.setattr(quantiles, "FEW", 40)
    real = F.percentile_approx
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda c, p, a: F.transform(real(c, p, a), lambda v: v + 0.2))
    v = np.random.default_rng(1).random(3000)
    df = spark.createDataFrame([(float(x),) for x in v], "value double")
    assert quantiles.quantiles(df, [], {"m": 0.37}).first()["m"] == pytest.approx(np.quantile(v, 0.37))


@pytest.mark.parametrize("count", [0, 1, 7, 60, 500])
def test_samples_equal_the_least_keys(spark, count):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i % 90, rng.choice([0.5, 1.0, 3.0, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, id long, w double")  # ids repeat, and with them keys
    got = splits.weighted_sample(df, count, F.col("w"), ["id"], ["g"])
    assert got.columns == df.columns
    h = seeded_hash(splits.SEED, F.col("id"))
    keyed = df.filter("w is not null").withColumn("k", -F.log(uniform(h)) / F.col("w")).withColumn("h", h)
    want = keyed.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("k", "h", "id"))).filter(F.col("n") <= count)
    plain = lambda frame: sorted(((r["g"] or "", r["id"], r["w"]) for r in frame.collect()))
    assert plain(got) == plain(want)


def test_a_million_clusters_are_split_as_one_by_one(spark):
    n = 1_000_000
    counts = spark.range(n).select(F.col("id").alias("cluster"), (F.col("id") % 977).alias("a"), (F.col("id") % 31).alias("b")).select("cluster", (F.col("a") + F.col("b")).alias("records"), F.array("a", "b").alias("counts"))
    began = time.time()
    got = splits.greedy_splits(counts, "cluster").groupBy("split").agg(F.count("*").alias("n")).collect()
    assert time.time() - began < 60 and sum(r["n"] for r in got) == n and len(got) == 3
    few = counts.limit(300)
    order = [(r["cluster"], r["counts"]) for r in few.orderBy(F.col("records").desc(), seeded_hash(42, F.col("cluster"))).collect()]
    total = [sum(c[i] for _, c in order) for i in range(2)]
    held, want = [[0.0, 0.0] for _ in splits.SHARES], {}
    for cluster, c in order:
        cost = lambda i: round(sum(((held[j][k] + (c[k] if i == j else 0) - total[k] * s) / max(total[k] * s, 1)) ** 2 for j, s in enumerate(splits.SHARES) for k in range(2)), 9)  # noqa: B023, E731
        best = min(range(3), key=cost)
        held[best] = [h + x for h, x in zip(held[best], c)]
        want[cluster] = splits.SPLITS[best]
    got = {r["cluster"]: r["split"] for r in splits.greedy_splits(few, "cluster").collect()}
    assert sum(got[c] != want[c] for c in want) == 0


def test_statistics_of_the_train_split_alone(spark):
    rows = [(s, c, float(v) * (1 if s == "train" else 100)) for s in ("train", "val") for c in ("no2", "wind") for v in range(9)] + [("train", "no2", math.nan)]
    values = spark.createDataFrame(rows, "split string, channel string, value double")
    features = spark.createDataFrame([("train", 1.0, 5.0), ("train", 3.0, 5.0), ("val", 99.0, 99.0)], "split string, day double, hour double")
    image, seasonal = normalization.training_stats(values, features, ("day", "hour"), robust=("no2",))
    got = {r["channel"]: (r["count"], r["center"], r["scale"]) for r in image.collect()}
    assert got["no2"] == (9, 4.0, pytest.approx(4 / 1.349)) and got["wind"] == (9, 4.0, pytest.approx(np.std(range(9))))
    assert {r["name"]: (r["center"], r["scale"]) for r in seasonal.collect()} == {"day": (2.0, 1.0), "hour": (5.0, 1.0)}
    fixed = spark.createDataFrame([("no2", 1, 0.5, 2.0)], "channel string, count long, center double, scale double")
    assert normalization.training_stats(values, features, ("day",), fixed=fixed)[0].collect() == fixed.collect()


def test_mean_channels_compute_no_quantile(spark):
    values = spark.createDataFrame([("a", 1.0)], "channel string, value double")
    plan = normalization.channel_stats(values)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "collect" not in plan


def test_balance_diagnostics(spark):
    rows = [("train", "up", float(v)) for v in range(-50, 51)] + [("val", "down", 1e9), ("val", "down", math.nan)]
    frame = spark.createDataFrame(rows, "split string, label string, value double")
    got = metrics.balance_histogram(frame, "value", ["split"], bins=10, low=0.0, high=0.9).collect()
    limit = max(50, np.quantile([v for *_, v in rows if math.isfinite(v)], 0.9))
    counts, edges = np.histogram([v for *_, v in rows if math.isfinite(v) and abs(v) <= limit], 10, (-limit, limit))
    assert {r["bin"]: (r["n"], round(r["from"], 9)) for r in got} == {i: (c, round(edges[i], 9)) for i, c in enumerate(counts) if c}
    shares = {(r["split"], r["label"]): (r["eligible"], r["balanced"], r["eligible_share"], r["balanced_share"]) for r in metrics.class_shares(frame, frame.filter("split = 'train'"), "label", ["split"]).collect()}
    assert shares == {("train", "up"): (101, 101, 1.0, 1.0), ("val", "down"): (2, 0, 1.0, 0.0)}
