"""Outputs: tables by partition, CSV, and the results of models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_partitions(df: DataFrame, path: str, columns: list[str], order: list[str] | None = None) -> None:
    """Zstd Parquet by partition columns; only the partitions that df has are replaced."""
    # A partition of any size is dealt out over tasks: by ranges of the order, or as much as the plan finds it large.
    rows = df.repartitionByRange(*columns, *order).sortWithinPartitions(*columns, *order) if order else df.hint("rebalance", *columns)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*columns).parquet(path)


def missing_partitions(wanted: DataFrame, present: DataFrame, columns: list[str]) -> DataFrame:
    """Partition keys that are wanted and not there yet."""
    return wanted.select(*columns).distinct().join(present.select(*columns).distinct(), columns, "left_anti")


def lists_as_json(df: DataFrame) -> DataFrame:
    """Array columns as JSON text, which CSV can hold; null lists are []."""
    return df.withColumns({c: F.coalesce(F.to_json(F.col(c)), F.lit("[]")) for c, kind in df.dtypes if kind.startswith("array")})


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, lists as JSON."""
    lists_as_json(df).write.mode("overwrite").option("header", True).csv(path)


def as_json(frame: DataFrame, keys: list[str]) -> dict:
    """A small table of numbers as nested objects by its keys."""
    out: dict = {}
    for row in frame.collect():
        at = out
        for k in keys:
            at = at.setdefault(str(row[k]), {})
        at.update({c: row[c] for c in frame.columns if c not in keys})
    return out


def write_text(spark, text: str, path: str) -> None:
    """A file of the shared folder, in one move from beside its place; what was there is replaced."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    part, target = hadoop.Path(f"{path}.part"), hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"can't publish {path}")


def write_results(metrics: DataFrame, predictions: DataFrame, path: str, *, primary: str, classes: list[str], extra: dict | None = None) -> None:
    """results.json of the metrics by model and split, those of the primary model first; and each model's predictions as CSV by model and split.

    metrics: model, split and numbers; predictions: model, split and any columns, lists as JSON.
    """
    models = as_json(metrics, ["model", "split"])
    if primary not in models:
        raise ValueError(f"no metrics of {primary}")
    lists_as_json(predictions).repartition("model", "split").write.mode("overwrite").option("header", True).partitionBy("model", "split").csv(f"{path}/predictions")
    results = {"primary_model": primary, "class_names": classes, "splits": models[primary], "models": models} | (extra or {})
    write_text(metrics.sparkSession, json.dumps(results, indent=2, sort_keys=True), f"{path}/results.json")


def write_stats(image: DataFrame, seasonal: DataFrame, path: str) -> None:
    """Normalization statistics of a training as one JSON file: image by channel and features by name."""
    write_text(image.sparkSession, json.dumps({"image": as_json(image, ["channel"]), "features": as_json(seasonal, ["name"])}, indent=2, sort_keys=True), path)
