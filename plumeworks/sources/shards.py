"""A store of dataset shards that is published as a whole or not at all: a Python data source whose tasks write and check shards, and whose commit publishes them."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "plumeworks_shards"
#: Holds the name of the published run.
CURRENT = "CURRENT"
#: Columns of a row besides a candidate's features.
OWN = ("split", "shard", "record_index", "error", "bundle", "_planned", "_outcome")


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else pafs.FileSystem.from_uri(f"file://{path.removeprefix('file:')}")


def raster_folder(split: str) -> str:
    return f"record-rasters/{split}"


@dataclass
class Shards(WriterCommitMessage):
    """What a task wrote: a row of the manifest for each shard."""

    rows: list[dict]


def problem(split: str, shard: int | None, rows: list[dict]) -> str | None:
    """What keeps a shard from being whole: each record that is planned has just one outcome, and no other record has any; a candidate's raster lies in its split's folder, once."""
    seen: dict[int, int] = {}
    paths: set[str] = set()
    for r in rows:
        i = r["record_index"]
        if not r["_planned"]:
            return f"record {i} of {split} isn't planned"
        if not r["_outcome"]:
            return f"record {i} of {split} has no outcome"
        seen[i] = seen.get(i, 0) + 1
        if seen[i] > 1:
            return f"record {i} of {split} has several outcomes"
        if r["error"] is None and (path := r.get("raster_path")) is not None:
            folder, _, name = path.rpartition("/")
            if folder != raster_folder(split) or name in ("", ".", ".."):
                return f"raster {path} of {split} lies outside {raster_folder(split)}"
            if path in paths:
                return f"raster {path} of {split} is there twice"
            paths.add(path)
    return None


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.root, self.shards = options["path"].rstrip("/"), int(options["shards"])
        self.run = f"run-{uuid.uuid4().hex}"
        self.features = [f for f in schema.names if f not in OWN]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shards:
        """Writes whole shards, which come one after the other, under names of this attempt alone. A shard that isn't whole fails the task."""
        fs, root = filesystem(self.root)
        attempt, done, held = uuid.uuid4().hex, [], []
        for batch in iterator:
            for row in batch.to_pylist():
                if held and (held[0]["split"], held[0]["shard"]) != (row["split"], row["shard"]):
                    done.append(self.write_shard(fs, root, attempt, held, batch.schema))
                    held = []
                held.append(row)
            schema = batch.schema
        if held:
            done.append(self.write_shard(fs, root, attempt, held, schema))
        return Shards(done)

    def write_shard(self, fs: pafs.FileSystem, root: str, attempt: str, rows: list[dict], schema: pa.Schema) -> dict:
        split, shard = rows[0]["split"], rows[0]["shard"]
        if wrong := problem(split, shard, rows):
            raise ValueError(wrong)
        folder = f"{root}/{self.run}/{split}/{shard:06d}-{attempt}"
        fs.create_dir(f"{folder}/{raster_folder(split)}")
        good = [r for r in rows if r["error"] is None]
        for r in good:
            if r.get("bundle") is not None:
                r["raster_path"] = r.get("raster_path") or f"{raster_folder(split)}/{r['record_index']}.npz"
                data = io.BytesIO()
                np.savez_compressed(data, bundle=np.asarray(r["bundle"], np.float32))
                with fs.open_output_stream(f"{folder}/{r['raster_path']}") as out:
                    out.write(data.getvalue())
        columns = pa.schema([schema.field("record_index"), *(schema.field(c) for c in self.features if c != "raster_path"), pa.field("raster_path", pa.string())])
        order = lambda r: r["record_index"]
        for name, table in (("candidates", pa.Table.from_pylist(sorted(good, key=order), columns)), ("failures", pa.Table.from_pylist(sorted((r for r in rows if r["error"] is not None), key=order), pa.schema([schema.field("record_index"), pa.field("error", pa.string())])))):
            pq.write_table(table, f"{folder}/{name}.parquet", filesystem=fs, compression="zstd")
        return {"split": split, "shard": shard, "folder": folder.removeprefix(root + "/"), "candidates": len(good), "failures": len(rows) - len(good)}

    def commit(self, messages: list[Shards | None]) -> None:
        """Publishes the run if every shard came just once: its name replaces that of the run before in one move."""
        rows = [r for m in messages if m is not None for r in m.rows]
        fs, root = filesystem(self.root)
        if len(rows) != self.shards or len({(r["split"], r["shard"]) for r in rows}) != self.shards:
            self.abort(messages)
            raise ValueError(f"{len(rows)} shards were written, not {self.shards}")
        fs.create_dir(f"{root}/{self.run}")
        with fs.open_output_stream(f"{root}/{self.run}/manifest.json") as out:
            out.write(json.dumps(sorted(rows, key=lambda r: (r["split"], r["shard"]))).encode())
        with fs.open_output_stream(f"{root}/{self.run}/{CURRENT}") as out:
            out.write(self.run.encode())
        fs.move(f"{root}/{self.run}/{CURRENT}", f"{root}/{CURRENT}")

    def abort(self, messages: list[Shards | None]) -> None:
        """Removes all that this run wrote; what was published before stays."""
        fs, root = filesystem(self.root)
        if fs.get_file_info(f"{root}/{self.run}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.run}")


class ShardStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options, schema)


def write_shards(plan: DataFrame, outcomes: DataFrame, path: str) -> None:
    """Publishes the outcomes of all planned records under path, or fails and leaves what was there.

    plan: split, shard, record_index. outcomes: split, record_index, error (null: a candidate) and the candidates' features; of these raster_path
    must lie in the split's folder, and bundle (numbers) is written there as an array file. Each shard is one task's, as the plan bounds it.
    """
    spark = plan.sparkSession
    spark.dataSource.register(ShardStore)
    key = ["split", "record_index"]
    rows = plan.select("split", "shard", "record_index", F.lit(True).alias("_planned")).join(outcomes.withColumn("_outcome", F.lit(True)), key, "full")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("_planned", "_outcome")}).withColumn("shard", F.coalesce("shard", F.lit(-1)))
    shards = plan.select("split", "shard").distinct().count()
    rows = rows.repartition("split", "shard").sortWithinPartitions("split", "shard", "record_index")
    rows.write.format(FORMAT).option("path", path).option("shards", str(shards)).mode("append").save()


def manifest(path: str) -> list[dict]:
    """The published shards: split, shard, folder, candidates, failures. Without a published run, none."""
    fs, root = filesystem(path.rstrip("/"))
    if fs.get_file_info(f"{root}/{CURRENT}").type == pafs.FileType.NotFound:
        return []
    run = fs.open_input_stream(f"{root}/{CURRENT}").read().decode()
    return json.loads(fs.open_input_stream(f"{root}/{run}/manifest.json").read())


def read_shards(spark: SparkSession, path: str, kind: str = "candidates", split: str | None = None) -> DataFrame:
    """split, shard and the rows of the published shards' candidates, raster_path under `path`, or failures; of one split or all."""
    rows = [r for r in manifest(path) if split in (None, r["split"])]
    if not rows:
        raise FileNotFoundError(f"no shards are published in {path}" + (f" for {split}" if split else ""))
    base = path.rstrip("/")
    found = spark.read.parquet(*(f"{base}/{r['folder']}/{kind}.parquet" for r in rows))
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"(run-[0-9a-f]+/[^/]+/[^/]+)/[^/]+$", 1)
    found = found.withColumn("_folder", folder)
    found = found.withColumn("shard", F.regexp_extract("_folder", r"/(\d+)-[0-9a-f]+$", 1).cast("int")).withColumn("split", F.regexp_extract("_folder", r"^[^/]+/([^/]+)/", 1))
    if kind == "candidates":
        found = found.withColumn("raster_path", F.concat(F.lit(base + "/"), "_folder", F.lit("/"), "raster_path"))
    return found.drop("_folder")
