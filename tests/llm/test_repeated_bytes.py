import hashlib
import random

import numpy as np
import pytest
from plumeworks.llm import repeated_bytes as rb


def brute(texts, length):
    """By comparing every string of `length` bytes."""
    raw, seen = [(t or "").encode() for t in texts], {}
    for b in raw:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = []
        for i, g in enumerate(gone):
            if g and (i == 0 or not gone[i - 1]):
                spans.append([i, i])
            if g:
                spans[-1][1] = i + 1
        out.append((len(b), sum(gone), [tuple(s) for s in spans], hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def found(spark, texts, length, parts=5, shard_symbols=300):
    df = spark.createDataFrame([(i, t, b"", 0) for i, t in enumerate(texts)], "doc_id long, text string, key binary, at int").repartition(parts)
    rows = rb.repeated_bytes(df, length=length, shard_symbols=shard_symbols).collect()
    assert len(rows) == len(texts)
    return [(r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], r["kept_sha256"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def edited(rng, text, edits):
    for _ in range(edits):
        p = rng.randrange(len(text) + 1)
        text = rng.choice([text[:p] + rng.choice("xyz") + text[p:], text[:p] + text[p + 1 :], text[:p] + text[p : p + rng.randint(1, 60)] + text[p:]])
    return text


@pytest.mark.parametrize(("length", "letters"), [(12, "ab"), (40, "abcdefgh "), (100, "abcdefghijklmnop é"), (400, "abcdefghijklmnopqrstuvwxyz ")])
def test_equals_brute_force(spark, length, letters):
    rng = random.Random(length)
    some = lambda n: "".join(rng.choices(letters, k=n))
    passages = [some(rng.randint(length - 3, 3 * length)) for _ in range(5)]
    texts = [None, "", "a", some(length), passages[0], passages[0]]
    for _ in range(60):
        text = "".join(rng.choice([some(rng.randint(0, length)), rng.choice(passages), edited(rng, rng.choice(passages), 2)]) for _ in range(rng.randint(1, 5)))
        texts += [text] * rng.choice([1, 1, 1, 2])
    # Runs and periods have no cuts, and their windows overlap.
    texts += ["z" * (length - 1), "y" * length, "x" * (length + 1), "w" * (4 * length), some(30) + "w" * (2 * length) + some(30), "ab" * length, "b" + "ab" * length]
    assert found(spark, texts, length) == brute(texts, length)


def test_windows_at_all_places_around_a_passage(spark):
    """Passages of just the length, one less and one more, alone and next to each other, with the same or other bytes around."""
    rng, length = random.Random(7), 60
    some = lambda n: "".join(rng.choices("abcdefghij", k=n))
    texts = []
    for extra in (-1, 0, 1, 5, 40):
        p = some(length + extra)
        texts += [some(rng.randint(0, 90)) + p + some(rng.randint(0, 90)) for _ in range(3)]
        texts += [p[: length // 2] + some(70), some(70) + p[length // 2 :], "q" + p + "q", "r" + p + "q", "q" + p + "r"]
    assert found(spark, texts, length) == brute(texts, length)


def test_a_window_of_a_repeat_equals_one_at_a_repeats_end(spark):
    """Two long copies hold a passage of which a third text has just a window: its partners lie within whole repeats."""
    rng, length = random.Random(9), 100
    some = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    long = some(2000)
    texts = [long, some(50) + long + some(50), long + "a"]
    texts += [some(80) + long[p : p + length] + some(80) for p in range(100, 1800, 37)]
    assert found(spark, texts, length) == brute(texts, length)


@pytest.mark.parametrize(("parts", "shard_symbols"), [(1, 1_000_000), (1, 2), (7, 50)])
def test_any_shards_give_the_same(spark, parts, shard_symbols):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdefgh", k=800)) for _ in range(4)]
    texts = [edited(rng, rng.choice(base), rng.randint(0, 6)) for _ in range(40)]
    assert found(spark, texts, 64, parts, shard_symbols) == brute(texts, 64)


def test_repeated_and_null_ids_and_a_long_text(spark):
    long = "".join(np.random.default_rng(1).choice(list("abcdefgh "), 3_000_000))
    rows = [(1, long), (1, long[:1000]), (None, "b" * 399), (None, None), (2, long[500:1500])]
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], len(r["spans"])) for r in rb.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, 0, 0), (0, 399, 0, 0), (1, 1000, 1000, 1), (1, 3_000_000, 1500, 1), (2, 1000, 1000, 1)]


def test_empty_table(spark):
    assert rb.repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_merged_prefixes_equal_those_of_one_sort(spark):
    """The symbols that a suffix shares with its neighbours in one suffix array of all texts, as far as windows need them."""
    rng = random.Random(5)
    c = rb.cutting(100)
    texts = [edited(rng, "ab".join(rng.choices(["passage one of some length ", "another that is longer than the first ", "third"], k=12)), 3) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string").repartition(4)
    cut = rb.saved(df.mapInArrow(rb.phrases(c), rb.PHRASES_DDL), "t").filter("symbols is not null")
    strings = {r["text_id"]: np.frombuffer(r["symbols"], np.uint64).tolist() for r in cut.collect()}
    sieve = spark.sparkContext.broadcast(bytes([255]) * 1024)
    part = rb.F.spark_partition_id().cast("long").alias("part")
    shards = rb.saved(cut.select("text_id", "symbols", "cuts", part).mapInArrow(rb.sharded(c, sieve, 40), rb.SHARDS_DDL), "s")
    assert shards.count() > 4
    levels = rb.merged(shards, c)
    got = {r["text_id"]: dict(zip(np.frombuffer(r["index"], np.int32).tolist(), r["shared"])) for r in shards.groupBy("shard").cogroup(levels.groupBy("shard")).applyInArrow(rb.common_prefixes, rb.SHARED_DDL).collect()}
    suffixes = sorted((s[i:], t, i) for t, s in strings.items() for i in range(len(s)))
    common = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    lcp = [0, *(common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:])), 0]
    for k, (s, t, i) in enumerate(suffixes):
        want, have = max(lcp[k], lcp[k + 1]), got.get(t, {}).get(i, 0)
        assert have == want or (have < want and have >= 1 and spans_window(texts[t], i, have, c))


def spans_window(text, i, symbols, c):
    data = np.frombuffer(text.encode(), np.uint8)
    cuts, _ = rb.cuts_of(data, np.array([0, len(data)]), c)
    return cuts[i + symbols] - cuts[i + 1] >= c.length - 1
