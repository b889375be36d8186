"""Benchmark decontamination by winnowing.

Every text keeps, of each `window` consecutive words, the k-gram with the least
hash. Two texts that share `window` words keep the same k-gram of them, so a
join on kept k-grams finds every shared window; each hit is then extended word
by word to the longest common run around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_rows, saved
from .textnum import ALNUM_WORDS, U64, Words, gram_hashes, slices

#: Bits of the sieve that lets document fingerprints through; its 4 MB are the same for any benchmark.
SIEVE_BITS = 25
#: Benchmark fingerprints that are sent to every task; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
#: Copies of each benchmark fingerprint in the shuffled join, against keys that a large share of documents has.
SALTS = 16

FINGERPRINT = T.StructType(
    [T.StructField("h", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("before", T.IntegerType()), T.StructField("words", T.BinaryType())]
)
ARROW_FINGERPRINT = pa.struct([("h", pa.int64()), ("size", pa.int32()), ("at", pa.int32()), ("before", pa.int32()), ("words", pa.binary())])


def kept_grams(w: Words, k: int, window: int, short: tuple[int, ...], sieve: np.ndarray | None) -> Iterator[tuple[int, int, int, int, int]]:
    """(word, size, hash, first and last word of the surroundings) of each fingerprint; `size` is `window`, or the length of a short item."""
    hashes, doc = w.hashes(), w.doc()
    passes = lambda h: np.flatnonzero(sieve[(h >> U64(3)).astype(np.int64) & (len(sieve) - 1)] >> (h & U64(7)).astype(np.uint8) & 1) if sieve is not None else np.arange(len(h))
    first, last = w.first[doc], w.first[doc + 1]
    grams = gram_hashes(hashes, k)
    span, reach = window - k + 1, window - k
    at = passes(grams)
    at = at[at + k <= last[at]]
    keep = np.zeros(len(at), bool)
    for back in range(span):  # the window of `span` k-grams that begins `back` before
        begin = at - back
        fits = (begin >= first[at]) & (begin + window <= last[at])
        least = fits.copy()
        for j in range(span):
            other = grams[np.minimum(np.maximum(begin + j, 0), len(grams) - 1)]
            least &= (other >= grams[at]) if j <= back else (other > grams[at])
        keep |= least
    for p in at[keep]:
        yield int(p), window, int(grams[p]), max(int(p) - reach, int(first[p])), min(int(p) + k + reach, int(last[p]))
    for n in short:
        grams = gram_hashes(hashes, n)
        at = passes(grams)
        for p in at[at + n <= last[at]]:
            yield int(p), n, int(grams[p]), int(p), int(p) + n


def fingerprinted(df: DataFrame, key: Column, text: Column, k: int, window: int, short: tuple[int, ...], sieve=None, whole_short: bool = False) -> DataFrame:
    """key, n_words and the kept fingerprints of each row. whole_short: a text of fewer words than the window is one fingerprint (benchmark items)."""
    source = df.select(key.alias("key"), text.cast("string").alias("text"))
    schema = T.StructType([source.schema["key"], T.StructField("n_words", T.LongType()), T.StructField("prints", T.ArrayType(FINGERPRINT))])

    def run(batches):
        bits = None if sieve is None else np.frombuffer(sieve.value, np.uint8)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                w = Words(data, offsets, ALNUM_WORDS)
                rows: list[list | None] = [None] * (hi - lo)
                doc = w.doc()
                found = kept_grams(w, k, window, short, bits)
                if whole_short:
                    found = [x for x in found if w.counts[doc[x[0]]] >= window]
                    for n in range(1, window):
                        if (which := np.flatnonzero(w.counts == n)).size:
                            grams = gram_hashes(w.hashes(), n)
                            found += [(int(p), n, int(grams[p]), int(p), int(p) + n) for p in w.first[which]]
                for p, size, h, a, b in found:
                    d = doc[p]
                    rows[d] = rows[d] or []
                    rows[d].append({"h": int(np.int64(np.uint64(h))), "size": size, "at": p - int(w.first[d]), "before": p - a, "words": w.text(a, b)})
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(lo, hi - lo), pa.array(w.counts, pa.int64()), pa.array(rows, pa.list_(ARROW_FINGERPRINT))], ["key", "n_words", "prints"])

    return source.mapInArrow(run, schema)


def sieve_of(spark: SparkSession, hashes: DataFrame):
    """A broadcast bitmap with a bit for each hash. Its size is fixed, so a large benchmark lets more through but loses nothing."""
    bits = 1 << SIEVE_BITS
    slot = F.expr(f"(h & {bits - 1}L)")
    parts = hashes.select(slot.alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot + 1))").alias("bits"))
    table = np.zeros(bits // 8, np.uint8)
    for bucket, part in parts.toLocalIterator():
        at = (bucket - 1) * 4096
        table[at : at + 4096] = np.frombuffer(part, np.uint8)
    return spark.sparkContext.broadcast(table.tobytes())


RUN = T.StructType([T.StructField("uid", T.LongType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("passage", T.LongType())])


def extended(k: int, window: int):
    """Runs of equal words around each joined pair of fingerprints, of `window` words or the whole short item at least."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("uid", "at", "before", "words", "i_before", "i_words", "size", "passage")]
            for uid, at, before, words, i_before, i_words, size, passage in zip(*columns, strict=True):
                x, y = words.split(b" "), i_words.split(b" ")
                n = size if size < window else k
                if x[before : before + n] != y[i_before : i_before + n]:
                    continue
                left = right = 0
                if size >= window:
                    while left < min(before, i_before) and x[before - left - 1] == y[i_before - left - 1]:
                        left += 1
                    while before + n + right < len(x) and i_before + n + right < len(y) and x[before + n + right] == y[i_before + n + right]:
                        right += 1
                if left + n + right >= size:
                    out.append((uid, at - left, at + n + right, passage))
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["uid", "a", "b", "passage"])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, k: int = 6) -> DataFrame:
    """Which documents hold windows of benchmark items.

    Returns one row per row of docs: id_col, n_words, n_hit (words inside any
    occurrence of an item's window), n_items, item_ids (sorted as strings),
    contaminated. An item with fewer words than the window is one window; one
    without words has none. Null texts have no words. Rows with the same or a
    null id are separate rows. A null item_id makes hits but isn't listed;
    repeated items count once. Empty tables give no rows, or no hits. Other
    columns of either table are ignored.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    prints = fingerprinted(items, F.col(item_col), F.col(item_text_col), k, window, (), whole_short=True)
    prints = saved(prints.select("key", F.explode("prints").alias("p")).select("key", "p.*"), "item-prints")
    short = tuple(sorted(r[0] for r in prints.filter(F.col("size") < window).select("size").distinct().collect()))  # at most window - 1
    sieve = sieve_of(spark, prints)
    # A passage: equal fingerprints in equal surroundings, whichever items have them.
    passage = F.xxhash64("h", "size", "before", "words")
    prints = prints.withColumn("passage", passage)
    passages = prints.groupBy("h", "size", "before", "words", "passage").agg(F.count("*").alias("n")).drop("n").withColumnsRenamed({"before": "i_before", "words": "i_words"})
    members = prints.select("passage", F.col("key").cast("string").alias("item")).filter("item is not null").distinct()

    rows = saved(fingerprinted(docs, F.col(id_col), F.col(text_col), k, window, short, sieve).withColumn("uid", F.monotonically_increasing_id()), "doc-prints")
    seeds = rows.filter(F.size("prints") > 0).select("uid", F.explode("prints").alias("p")).select("uid", "p.*")
    if passages.count() <= BROADCAST_ROWS:
        joined = seeds.join(F.broadcast(passages), ["h", "size"])
    else:
        joined = seeds.withColumn("salt", (F.rand(7) * SALTS).cast("int")).join(passages.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["h", "size", "salt"])
    runs = saved(joined.select("uid", "at", "before", "words", "i_before", "i_words", "size", "passage").mapInArrow(extended(k, window), RUN), "runs")

    interval = F.array_sort(F.collect_set(F.struct("a", "b")))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct((acc.n + F.greatest(F.lit(0), x.b - F.greatest(x.a, acc.end))).cast("long").alias("n"), F.greatest(acc.end, x.b).alias("end")),
        lambda acc: acc.n,
    )
    hits = runs.groupBy("uid").agg(interval.alias("spans")).select("uid", covered.alias("n_hit"))
    found = runs.select("uid", "passage").distinct().join(members, "passage").groupBy("uid").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    none = F.array().cast("array<string>")
    return (
        rows.select("uid", F.col("key").alias(id_col), "n_words")
        .join(hits, "uid", "left")
        .join(found, "uid", "left")
        .select(
            id_col,
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"),
            F.coalesce("item_ids", none).alias("item_ids"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )
