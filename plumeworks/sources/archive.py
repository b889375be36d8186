"""Hours of a gridded archive, their addresses, and a data source that fetches byte ranges of its files, one partition for each file."""

from __future__ import annotations

import time
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.planning import WEATHER_PRODUCT
from .pages import fetched
from .shards import filesystem

FORMAT = "archive_ranges"
#: Bytes that are copied at once.
CHUNK = 1 << 20


def hours(spark: SparkSession, start: str, end: str) -> DataFrame:
    """valid_time, each UTC hour of the dates from start to end, both included."""
    at = lambda day, clock: F.lit(f"{day} {clock}").cast("timestamp_ntz")
    times = F.sequence(at(start, "00:00:00"), at(end, "23:00:00"), F.expr("interval 1 hour"))
    if start > end:
        return spark.createDataFrame([], "valid_time timestamp_ntz")
    return spark.range(1).select(F.explode(times).alias("valid_time"))


def addresses(base: str, at: Column) -> tuple[Column, Column]:
    """The address of an hour's file, and of its text index."""
    day, hour = F.date_format(at, "yyyyMMdd"), F.date_format(at, "HH")
    file = F.concat(F.lit(base.rstrip("/") + "/hrrr."), day, F.lit("/conus/hrrr.t"), hour, F.lit(f"z.{WEATHER_PRODUCT}.grib2"))
    return file, F.concat(file, F.lit(".idx"))


@dataclass
class FileRanges(InputPartition):
    """The ranges of one file, in the order in which their bytes are put together."""

    file: str
    target: str
    ranges: tuple[tuple[int, int | None], ...]

    def __post_init__(self):
        super().__init__(self.target)


def range_bytes(file: str, first: int, last: int | None, tries: int) -> Iterator[bytes]:
    """The bytes first .. last (null: to the end) of a file, or of an address that answers to ranges."""
    if file.startswith(("http://", "https://")):

        def opener(url: str):
            response = urllib.request.urlopen(urllib.request.Request(url, headers={"Range": f"bytes={first}-{'' if last is None else last}"}))
            if response.status != 206:
                raise ValueError(f"{url} ignores byte ranges")
            return response

        yield fetched(file, tries, opener, time.sleep)
        return
    fs, path = filesystem(file)
    with fs.open_input_file(path) as source:
        source.seek(first)
        left = None if last is None else last - first + 1
        while left is None or left > 0:
            part = source.read(CHUNK if left is None else min(CHUNK, left))
            if not part:
                return
            left = None if left is None else left - len(part)
            yield part


class RangesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.manifest, self.root = options["manifest"], options["root"].rstrip("/")
        self.tries, self.overwrite = int(options.get("tries", 4)), options.get("overwrite", "false").lower() == "true"

    def partitions(self) -> list[FileRanges]:
        """A partition for each target of the manifest."""
        fs, path = filesystem(self.manifest)
        held: dict[tuple[str, str], list] = {}
        for r in ds.dataset(path, filesystem=fs, format="parquet").to_table(["file", "target", "first", "last"]).to_pylist():
            held.setdefault((r["file"], r["target"]), []).append((r["first"], r["last"]))
        return [FileRanges(file, target, tuple(sorted(ranges, key=lambda x: x[0]))) for (file, target), ranges in sorted(held.items())]

    def read(self, partition: FileRanges) -> Iterator[tuple[str, int, str | None, str]]:
        """Writes a target beside its place and moves it there once its ranges are all of the right length; one that is there is left alone."""
        fs, root = filesystem(self.root)
        target = f"{root}/{partition.target}"
        info = fs.get_file_info(target)
        if info.type == pafs.FileType.File and info.size and not self.overwrite:
            yield partition.target, info.size, None, "present"
            return
        part = f"{target}.{uuid.uuid4().hex}.part"
        fs.create_dir(target.rpartition("/")[0])
        error, total = None, 0
        try:
            with fs.open_output_stream(part) as out:
                for first, last in partition.ranges:
                    size = sum(out.write(x) for x in range_bytes(partition.file, first, last, self.tries))
                    total += size
                    if last is not None and size != last - first + 1:
                        raise ValueError(f"{size} bytes from {first}, not {last - first + 1}")
            if not total:
                raise ValueError("no bytes")
            fs.move(part, target)
        except (OSError, ValueError) as e:
            error, total = f"{type(e).__name__}: {e}", 0
            if fs.get_file_info(part).type == pafs.FileType.File:
                fs.delete_file(part)
        yield partition.target, total, error, "failed" if error else "fetched"


class ArchiveRanges(DataSource):
    """`spark.read.format("archive_ranges")` with options manifest (Parquet: file, target, first, last; a null last is the file's end), root, overwrite and tries.

    Rows: target, bytes, error and status (fetched, present or failed). A range that comes short, or an empty target, fails and
    publishes nothing; a run that is taken up again fetches only what isn't there.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "target string, bytes long, error string, status string"

    def reader(self, schema) -> RangesReader:
        return RangesReader(self.options)


def fetch_ranges(ranges: DataFrame, manifest: str, root: str, **options: str) -> DataFrame:
    """target, bytes, error, status of the ranges (file, target, first, last), whose manifest is written first. Reading the result fetches; it is to be written or counted once."""
    spark = ranges.sparkSession
    spark.dataSource.register(ArchiveRanges)
    ranges.select("file", "target", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last")).write.mode("overwrite").parquet(manifest)
    return spark.read.format(FORMAT).options(manifest=manifest, root=root, **options).load()
