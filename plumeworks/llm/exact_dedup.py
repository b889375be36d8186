"""Exact deduplication through an extendible-hash index on shared files, by DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved, sieved

#: Keys of a bucket beyond which the directory doubles and the bucket is split.
BUCKET_KEYS = 4096
#: Cells of a directory that is sent to every task; beyond, it is joined by shuffle.
BROADCAST_CELLS = 200_000


def squeezed(text: Column) -> Column:
    """The text without [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), " \t\n\x0b\x0c\r", "")


def directory_of(keys: DataFrame, depth: int, bucket_keys: int) -> DataFrame:
    """cell (the first `depth` bits of a key), bucket and local_depth: the directory after all doublings.

    The directory begins with one bucket. As long as a bucket holds more keys
    than bucket_keys it is split by one more bit, which doubles the directory
    where needed. A cell's bucket is thus its shortest prefix that isn't overfull
    (the whole cell at most). Prefix counts come from the cells' counts, of which
    there are about 16 for every bucket_keys keys.
    """
    cells = keys.groupBy("cell").agg(F.count("*").alias("n"))
    prefixes = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d")).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - d)"))
    full = prefixes.groupBy("d", "prefix").agg(F.sum("n").alias("held")).filter(F.col("held") > bucket_keys)
    split = prefixes.join(full, ["d", "prefix"], "left_semi").groupBy("cell").agg(F.count("*").alias("splits"))
    local = F.least(F.coalesce("splits", F.lit(0)), F.lit(depth)).cast("int")
    return cells.join(split, "cell", "left").select("cell", local.alias("local_depth")).withColumn("bucket", F.expr(f"shiftright(cell, {depth} - local_depth)"))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Groups of texts that are equal without white space.

    Returns one row per row of docs: id_col, keep_id (of the row that stays: the
    most code points in the original text, then the least id; null ids come
    last), group_size, kept, text_sha256. A null text counts as empty and is equal to
    texts of white space alone. Where rows of a group repeat the id that stays, each of
    them with that length is marked as kept. An empty table gives no rows.
    Other columns are ignored. key_bits: a shorter key makes chains of unlike
    texts, for tests.

    The index entries are (key, text's SHA-256, length, id) on shared files.
    Keys are counted into cells, a directory of buckets is made from them, and it routes
    every entry and text to its bucket; owner tasks take ranges of (bucket, key). Entries
    that share a key form a chain in their bucket, whose links are told apart by the texts'
    bytes, copies combined before the shuffle: only texts whose key is shared travel. An
    entry finds its link in its bucket's chains; one without a link is alone.
    """
    text = squeezed(F.col(text_col))
    key = F.xxhash64("norm") if key_bits == 64 else F.expr(f"xxhash64(norm) & {(1 << key_bits) - 1}L")
    source = docs.select(F.col(id_col).alias("id"), text.alias("norm"), F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("points")).withColumn("key", key)
    entries = saved(source.select("id", "key", "points", F.sha2("norm", 256).alias("sha")), "index-entries")
    keys = saved(entries.groupBy("key").agg(F.count("*").alias("n")), "index-keys")
    depth = max(4, min(30, math.ceil(math.log2(max(1, keys.count()) / bucket_keys + 1)) + 4))
    cell = F.expr(f"shiftrightunsigned(key, {64 - depth})" if key_bits == 64 else f"key & {(1 << depth) - 1}L")
    directory = saved(directory_of(keys.select(cell.alias("cell")), depth, bucket_keys), "directory")
    cells = F.broadcast(directory) if directory.count() <= BROADCAST_CELLS else directory
    routed = lambda rows: rows.withColumn("cell", cell).join(cells, "cell").drop("cell")
    index = saved(routed(keys).repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key"), "index")
    # The sieve lets a few lone keys through, whose chains have one entry.
    chained = sieved(source, "key", index.filter("n > 1").select("key")).filter("_maybe")
    # Of equal texts: the longest original, then the least id, null ids last.
    best = F.min(F.struct((-F.col("points")).alias("short"), F.col("id").isNull().alias("none"), "id"))
    links = routed(chained).groupBy("bucket", "key", "norm").agg(F.count("*").alias("group_size"), best.alias("best")).filter("group_size > 1")
    links = saved(links.select("bucket", "key", F.sha2("norm", 256).alias("sha"), "group_size", (-F.col("best.short")).alias("keep_points"), F.col("best.id").alias("keep_id")), "chains")
    found = routed(entries).join(links, ["bucket", "key", "sha"], "left")
    alone = F.col("group_size").isNull()
    kept = alone | (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points")))
    return found.select(F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"), "bucket", "local_depth")
