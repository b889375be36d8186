"""Tables and settings that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; with long texts the default of 10,000 needs too much memory in a worker.
ARROW_ROWS = 2000
#: Least and most bits of a sieve: 16 for each key, as long as its broadcast stays within 32 MB.
SIEVE_LEAST, SIEVE_MOST = 20, 28
#: Removes an execution's shuffle files once it has ended; what it made is on the shared folder by then.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only a local master may leave it unset, and gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="plumeworks-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def saved(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written to the shared folder and read again: it cuts the lineage, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.saved_in = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes tables of `saved` that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.saved_in)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_rows(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch, for the session: results are computed after their operator has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def sieved(df: DataFrame, key: str | Column, keys: DataFrame) -> DataFrame:
    """df with `_maybe`: false for rows whose key isn't among keys (one column); true for all others and a few more.

    A bitmap of the keys' hashes in rows of 4 KB, whose size is bounded, is joined by broadcast, so
    that rows beside the keys need no shuffle. By DataFrame functions alone.
    """
    n = max(1, keys.count())
    bits = 1 << min(SIEVE_MOST, max(SIEVE_LEAST, (16 * n).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    marks = keys.select(place(F.col(keys.columns[0])).alias("_at"))
    rows = marks.groupBy(F.expr("bitmap_bucket_number(_at)").alias("_row")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_at))").alias("_bits"))
    # Two bytes make a number of 16 bits, less 2^15, so that a probe is one array access.
    pair = lambda i: (F.conv(F.hex(F.substring("_bits", i * 2 + 1, F.lit(2))), 16, 10).cast("int") - 32768).cast("smallint")
    table = saved(rows.select("_row", F.transform(F.sequence(F.lit(0), (F.length("_bits") / 2).cast("int") - 1), pair).alias("_bits")), "sieve")
    at = df.withColumn("_at", place(F.col(key) if isinstance(key, str) else key)).withColumn("_row", F.expr("bitmap_bucket_number(_at)"))
    number = F.expr("cast(get(_bits, cast(bitmap_bit_position(_at) div 16 as int)) as bigint) + 32768")
    bit = F.getbit(number, F.expr("cast((bitmap_bit_position(_at) + 8) % 16 as int)"))
    return at.join(F.broadcast(table), "_row", "left").withColumn("_maybe", F.coalesce(bit == 1, F.lit(False))).drop("_row", "_at", "_bits")


def among(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of df whose key is among keys (one column of the same name). Only rows that a sieve lets through are shuffled."""
    return sieved(df, key, keys).filter("_maybe").drop("_maybe").join(keys, key, "left_semi")


def not_among(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of df whose key isn't among keys (one column of the same name). Only rows that a sieve lets through are shuffled."""
    rows = sieved(df, key, keys)
    return rows.filter("not _maybe").drop("_maybe").unionByName(rows.filter("_maybe").drop("_maybe").join(keys, key, "left_anti"))


def least_hashed(df: DataFrame, n: int, keys: tuple[str, ...], columns: tuple[str, ...]) -> list[Row]:
    """`columns` of the n rows with the least hashes of `keys`, on the driver. A threshold lets some 2 n rows through, however many tasks there are."""
    share = min(1.0, 2 * n / max(1, df.count()))
    few = df.withColumn("_order", F.xxhash64(*keys)).filter(F.col("_order") / F.lit(2.0**64) + 0.5 <= share)
    return few.orderBy("_order", *keys).limit(n).select(*columns).collect()
