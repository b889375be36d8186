"""MinHash near-deduplication: universal hash minima, banding, verification, connected components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import arrow_rows, discard, not_among, saved
from .textnum import SPACE_WORDS, U64, Words, gram_hashes, mix, slices

#: Chance that a pair at the threshold shares no band.
MISS = 1e-6
#: Hash functions at most; the bands get as many rows as this allows.
MAX_HASHES = 360
#: Members of a bucket beside its main component that are all compared in one round; of more, PIVOTS are taken in each round.
FEW = PIVOTS = 256
#: Members of a bucket's main component that each round of trials takes, and the share of outsiders that a round may leave for another to follow.
LEADERS, PROGRESS = 2, 0.8
#: Members of mixed buckets that have a rare shingle, at most.
RARE = 64
#: Minima whose bytes make the signature by which pairs are estimated.
SIGNATURE = 128


def bands_for(threshold: float) -> tuple[int, int]:
    """Bands and rows of each."""
    for rows in range(12, 0, -1):
        n = math.ceil(math.log(MISS) / math.log1p(-(threshold**rows)))
        if n * rows <= MAX_HASHES or rows == 1:
            return n, rows
    raise AssertionError


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, in a row; and how many each has. Fewer than k words are one shingle."""
    hashes, texts = w.hashes(), len(w.counts)
    grams, doc = gram_hashes(hashes, k), w.doc()
    fits = np.flatnonzero(doc[: len(grams)] == doc[k - 1 :]) if len(grams) else np.zeros(0, np.int64)
    values, owner = [grams[fits]], [doc[fits]]
    for n in range(1, k):
        which = np.flatnonzero(w.counts == n)
        if len(which):
            values.append(gram_hashes(hashes, n)[w.first[which]])
            owner.append(which)
    values, owner = np.concatenate(values), np.concatenate(owner)
    order = np.argsort(values)
    small = owner.astype(np.uint16) if texts < 65536 else owner
    order = order[np.argsort(small[order], kind="stable")]
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=texts)


def set_keys(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set: sums of two independent hashes of its members."""
    ends = np.cumsum(counts)
    out = []
    for seed in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(values ^ U64(seed)))))
        out.append((total[ends] - total[ends - counts]).view(np.int64))
    return out[0], out[1]


def minima(values: np.ndarray, counts: np.ndarray, hashes: int) -> np.ndarray:
    """The least value of each hash function over each set that isn't empty: hashes x sets."""
    rng = np.random.default_rng(20250)
    a = rng.integers(0, 1 << 32, hashes, np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, hashes, np.uint32)
    first = (np.cumsum(counts) - counts)[counts > 0]
    x = (values >> U64(32)).astype(np.uint32)
    out, y = np.empty((hashes, len(first)), np.uint32), np.empty_like(x)
    for i in range(hashes):
        np.multiply(x, a[i], out=y)
        np.add(y, b[i], out=y)
        out[i] = np.minimum.reduceat(y, first) if len(first) else 0
    return out


def signed(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """id, n_shingles, the set's key, a byte of each of SIGNATURE minima and the band keys of each row."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([source.schema["id"], *(T.StructField(c, T.LongType()) for c in ("n_shingles", "set_a", "set_b")), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    hashes = bands * rows

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                values, counts = shingle_sets(Words(data, offsets, SPACE_WORDS), k)
                key_a, key_b = set_keys(values, counts)
                m = minima(values, counts, hashes)
                few = m[:SIGNATURE]
                sig, band = np.zeros((hi - lo, len(few)), np.uint8), np.zeros((hi - lo, bands), np.int64)
                full = counts > 0
                sig[full] = (few >> np.uint32(24)).astype(np.uint8).T ^ few.astype(np.uint8).T
                for i in range(bands):
                    band[full, i] = mix(gram_hashes_of(m[i * rows : (i + 1) * rows]) + U64(i)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(key_a), pa.array(key_b), pa.array([x.tobytes() for x in sig], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), pa.array(band.reshape(-1)))],
                    ["id", "n_shingles", "set_a", "set_b", "sig", "bands"],
                )

    return source.mapInArrow(run, schema)


def gram_hashes_of(rows: np.ndarray) -> np.ndarray:
    total = np.zeros(rows.shape[1], U64)
    for r in rows:
        total = mix(total * U64(0x9E3779B97F4A7C15) + r)
    return total


def full_sets(docs: DataFrame, text_col: str, k: int, wanted: DataFrame) -> DataFrame:
    """cid and the sorted shingle hashes of each wanted class (set_a, set_b, cid), from the texts."""
    from .decontamination import sieve_of

    sieve = sieve_of(docs.sparkSession, wanted.select(F.col("set_a").alias("h")))

    def run(batches):
        bits, seen = np.frombuffer(sieve.value, np.uint8), set()
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                values, counts = shingle_sets(Words(data, offsets, SPACE_WORDS), k)
                a, b = set_keys(values, counts)
                slot = a & (len(bits) * 8 - 1)
                ends, out = np.cumsum(counts), []
                for i in np.flatnonzero((counts > 0) & (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0)).tolist():
                    key = (int(a[i]), int(b[i]))
                    if key not in seen:  # one copy from each task
                        seen.add(key)
                        out.append((*key, values[ends[i] - counts[i] : ends[i]].tobytes()))
                columns = list(zip(*out, strict=True)) if out else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["set_a", "set_b", "shingles"])

    made = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "set_a long, set_b long, shingles binary")
    return made.join(wanted, ["set_a", "set_b"]).select("cid", "shingles").dropDuplicates(["cid"])


def likely(least: float, hashes: int):
    """Pairs whose signatures agree in a share that a pair at the threshold falls below with a chance of 1e-9."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, hashes) for c in ("x", "y"))
                keep = (x == y).mean(axis=1) >= least
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return run


def linked(percent: int):
    """Pairs with 100 * intersection >= percent * union, on whole sets."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                if len(x) > len(y):
                    x, y = y, x
                common = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return run


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after further links (a, b): only the components that these tie are run through again. `parts` is discarded."""
    ends = links
    for end in ("a", "b"):
        ends = ends.join(parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part")), end, "left")
    more = components(ends.select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b")))
    moved = more.select(F.col("node").alias("component"), F.col("component").alias("to"))
    known = parts.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out = saved(known.union(more.join(parts.select("node"), "node", "left_anti").select("node", "component")), "parts")
    discard(parts, more)
    return out


def postings(sets: DataFrame, sieve=None) -> DataFrame:
    """Rows (cid, h) of each class's shingles, with a sieve those that it lets through."""

    def run(batches):
        bits = None if sieve is None else np.frombuffer(sieve.value, np.uint8)
        for batch in batches:
            for cid, raw in zip(batch.column("cid").to_pylist(), batch.column("shingles"), strict=True):
                h = np.frombuffer(raw.as_buffer(), np.int64)
                if bits is not None:
                    slot = h & (len(bits) * 8 - 1)
                    h = h[bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), cid, np.int64)), pa.array(h)], ["cid", "h"])

    return sets.mapInArrow(run, "cid long, h long")


def by_rare_shingles(sets: DataFrame, outsiders: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of an outsider and a member that share a rare shingle, one that RARE members have at most; and each outsider's number `rare` of such shingles.

    The others of its shingles bound what an outsider can have in common with a member that isn't in a pair with it.
    """
    from .decontamination import sieve_of

    spark, inside = sets.sparkSession, sets.join(members, "cid", "left_semi")
    own = postings(sets.join(outsiders, "cid", "left_semi")).groupBy("h").agg(F.count("*").alias("outsiders")).filter(f"outsiders <= {RARE}").select("h")
    own = saved(own, "outsiders-shingles")
    few = saved(postings(inside, sieve_of(spark, own)).groupBy("h").agg(F.count("*").alias("n")).filter(f"n <= {RARE}").select("h").join(own, "h", "left_semi"), "rare-shingles")
    found = saved(postings(inside, sieve_of(spark, few)).join(few, "h", "left_semi"), "rare-postings")
    theirs = found.join(outsiders, "cid", "left_semi")
    pairs = theirs.select("h", F.col("cid").alias("a")).join(found.select("h", F.col("cid").alias("b")), "h").filter("a <> b").select("a", "b").distinct()
    return pairs, theirs.groupBy("cid").agg(F.count("*").cast("int").alias("rare"))


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 85) -> DataFrame:
    """Groups of documents linked, directly or through others, by 100 * intersection >= percent * union of their word shingles.

    Returns one row per row of docs: id_col, n_shingles, component_id (the least
    id of the group), kept. A null text, or one without words, has no shingles and no
    links; it forms its own group. Null ids are never the least of a group, unless it
    has no others; of rows that repeat the least id each one is kept. An empty
    table gives no rows. Other columns are ignored.

    Documents with the same shingle set are one class. Classes that share a band
    of minima are candidates. First each member is compared with the pivot of one of its
    buckets. Then, where a bucket still has members in different components,
    those outside its largest are compared with a few members of it, as long as this
    joins many, then with those that share one of their rare shingles, and at last, where
    the other shingles could be enough for a link, with all the others, some at a time,
    until no two components are left that could be linked. Candidates pass a
    signature estimate and are confirmed on whole sets. A band is shared at the
    threshold except with a chance of MISS.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    bands, rows = bands_for(percent / 100)
    signs = saved(signed(docs, id_col, text_col, shingle, bands, rows).withColumn("uid", F.monotonically_increasing_id()), "signatures")
    keys = signs.filter("n_shingles > 0")
    classes = saved(keys.groupBy("set_a", "set_b").agg(F.min("uid").alias("cid"), F.min("id").alias("least_id"), F.count("*").alias("copies")), "classes")
    # The first row of each class stands for it; the others are those of classes with copies that aren't the first.
    again = keys.join(classes.filter("copies > 1").select("set_a", "set_b", "cid"), ["set_a", "set_b"]).filter("uid <> cid").select("uid")
    again = saved(again, "again")
    heads = not_among(keys, "uid", again).withColumnRenamed("uid", "cid")
    shared = saved(heads.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "shared-bands")
    buckets = saved(heads.select(F.explode("bands").alias("key"), "cid", F.col("n_shingles").cast("int").alias("n")).join(shared, "key"), "buckets")
    # Of a bucket's members, the one that meets the most others in all its buckets is the likeliest to be near them.
    met = saved(buckets.groupBy("cid").agg(F.sum("members").alias("met")), "met")
    sigs = saved(heads.select("cid", "n_shingles", "set_a", "set_b", "sig").join(met.select("cid"), "cid", "left_semi"), "bucket-signatures")
    ids = saved(signs.select("id", "n_shingles", "set_a", "set_b"), "ids")
    buckets = buckets.drop("members").join(met, "cid")
    discard(shared, signs)
    sets = saved(full_sets(docs, text_col, shingle, sigs.select("set_a", "set_b", "cid")), "sets", "lz4")
    hashes = min(SIGNATURE, bands * rows)
    spread = math.sqrt(percent * (100 - percent) / 1e4 / hashes)
    least = max(0.0, percent / 100 - 6 * spread)
    sized = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.filter(sized).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        both = pairs.join(sigs.select(F.col("cid").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("cid").alias("b"), F.col("sig").alias("y")), "b")
        some = saved(both.select("a", "b", "x", "y").mapInArrow(likely(least, hashes), "a long, b long"), "likely")
        both = some.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b")
        links = saved(both.select("a", "b", "x", "y").mapInArrow(linked(percent), "a long, b long"), "links")
        discard(some)
        return links

    # Each member is compared with one bucket's pivot: the one that it shares the most buckets with.
    pivots = buckets.groupBy("key").agg(F.max(F.struct("met", "cid", "n")).alias("p")).select("key", F.col("p.met").alias("met_a"), F.col("p.cid").alias("a"), F.col("p.n").alias("n_a"))
    pairs = pivots.join(buckets.select("key", F.col("cid").alias("b"), F.col("n").alias("n_b")), "key").filter(f"a <> b and {sized}")
    best = pairs.groupBy("b", "n_b", "a").agg(F.count("*").alias("times"), F.max("met_a").alias("met_a"), F.max("n_a").alias("n_a")).groupBy("b", "n_b").agg(F.max(F.struct("times", "met_a", "a", "n_a")).alias("p"))
    links = verified(best.select("p.a", "b", "p.n_a", "n_b"))
    parts = components(links)
    discard(links)
    rest, sampling, before, rare, left, tried = buckets, True, None, None, None, None
    while True:
        marked = rest.join(parts, F.col("cid") == F.col("node"), "left").select("key", "cid", "n", "met", F.coalesce("component", "cid").alias("label"))
        by_label = marked.groupBy("key", "label").agg(F.count("*").alias("c"))
        main = by_label.groupBy("key").agg(F.max(F.struct("c", "label")).alias("main"), F.sum("c").alias("members"), F.count("*").alias("labels")).filter("labels > 1")
        main = main.select("key", F.col("main.label").alias("main"), (F.col("members") - F.col("main.c")).alias("outside"))
        left, old = saved(marked.join(main, "key"), "mixed-buckets"), left
        discard(*(x for x in (old, tried) if x is not None))
        tried = None
        waiting = left.filter("label <> main").count()
        if not waiting:
            break
        sampling = sampling and (before is None or waiting <= PROGRESS * before)
        before = waiting
        member = lambda side: ("key", F.col("cid").alias(side), F.col("n").alias(f"n_{side}"), F.col("label").alias(f"label_{side}"))
        outsiders = left.filter("label <> main")
        lead = lambda rows, slots: rows.withColumn("slot", F.expr(f"pmod(xxhash64(cid, {waiting}), {slots})")).groupBy("key", "slot").agg(F.max(F.struct("met", "cid", "n", "label")).alias("p")).select("key", "p.*")
        if sampling:  # leaders of the main component against those outside, as long as that joins many of them
            pairs = lead(left.filter("label = main"), LEADERS).select(*member("a")).join(outsiders.select(*member("b")), "key")
        elif rare is None:
            found, rare = by_rare_shingles(sets, outsiders.select("cid").distinct(), left.select("cid").distinct())
            rare, pairs = saved(rare, "rare"), found
            for end in ("a", "b"):
                pairs = pairs.join(left.select(F.col("cid").alias(end), F.col("n").alias(f"n_{end}"), F.col("label").alias(f"label_{end}")).distinct(), end)
        else:  # few outsiders are all compared with the others; of many, some are taken in each round
            tried = saved(outsiders.filter(f"outside <= {FEW}").select("key", "met", "cid", "n", "label").unionByName(lead(outsiders.filter(f"outside > {FEW}"), PIVOTS)), "pivots")
            bound = lambda side: (F.col(f"n_{side}") - F.coalesce(f"rare_{side}", F.lit(0)))
            of = lambda rows, side: rows.join(rare, "cid", "left").select(*member(side), F.col("rare").alias(f"rare_{side}"))
            pairs = of(tried, "a").join(of(left, "b"), "key").withColumn("common", F.least(bound("a"), bound("b"))).filter(f"100 * common >= {percent} * (n_a + n_b - common)")
        new = verified(pairs.filter(f"a <> b and label_a <> label_b and {sized}").select("a", "b", "n_a", "n_b"))
        if not new.isEmpty():
            parts = merged(parts, new)
        discard(new)
        rest = left.select("key", "cid", "n", "met", "outside")
        if tried is not None:  # what was compared with all others of its bucket is done
            rest = rest.filter(f"outside > {FEW}").join(tried.select("key", "cid"), ["key", "cid"], "left_anti")
    labelled = classes.join(parts, F.col("cid") == F.col("node"), "left").select("set_a", "set_b", "least_id", F.coalesce("component", "cid").alias("label"))
    named = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = saved(labelled.join(named, "label").select("set_a", "set_b", "component_id"), "named")
    discard(sets, sigs, left, parts, classes)
    found = ids.join(named, ["set_a", "set_b"], "left")
    group = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id_col), "n_shingles", group.alias("component_id"), F.col("id").eqNullSafe(group).alias("kept"))
