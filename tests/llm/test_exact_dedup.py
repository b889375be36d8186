import hashlib
import random

import pytest
from plumeworks.llm import exact_dedup


def brute(docs):
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for i, t in docs:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in docs:
        points, _, _, keep = min(groups[norm(t)])
        out.append((i, keep, len(groups[norm(t)]), i == keep and -len(t or "") == points, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("bits", "bucket"), [(64, 4096), (3, 2), (64, 2)])
def test_equals_brute_force(spark, bits, bucket):
    rng = random.Random(2)
    texts = [None, "", " \n", "a b", "ab", "a b", "é", "é", "x" * 50_000, *("".join(rng.choices("ab \t", k=rng.randint(0, 5))) for _ in range(120))]
    docs = [(None if j % 40 == 7 else j, t) for j, t in enumerate(texts)]
    df = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, key int, norm string").repartition(3)
    got = exact_dedup.exact_groups(df, key_bits=bits, bucket_keys=bucket)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got.collect()), key=repr) == brute(docs)


def test_repeated_rows(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (3, "a ")]
    got = sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 3, False), (1, 3, False), (2, 3, False), (3, 3, True)]


def test_directory_splits_overfull_buckets(spark):
    keys = spark.createDataFrame([(c,) for c in [0] * 5 + [1] * 2 + [8] * 2 + [15]], "cell long")
    got = {r["cell"]: (r["local_depth"], r["bucket"]) for r in exact_dedup.directory_of(keys, 4, 4).collect()}
    assert got == {0: (4, 0), 1: (4, 1), 8: (1, 1), 15: (1, 1)}


def test_empty_table(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_answer_comes_through_the_directory(spark, monkeypatch):
    """Without one of the directory's buckets the texts of that bucket are gone."""
    df = spark.createDataFrame([(i, f"text {i % 20}") for i in range(60)], "doc_id long, text string")
    whole = {r["doc_id"]: r["bucket"] for r in exact_dedup.exact_groups(df, bucket_keys=2).collect()}
    lost, real = next(iter(whole.values())), exact_dedup.directory_of
    monkeypatch.setattr(exact_dedup, "directory_of", lambda *a: real(*a).filter(f"bucket <> {lost}"))
    got = {r["doc_id"] for r in exact_dedup.exact_groups(df, bucket_keys=2).collect()}
    assert got == {i for i, b in whole.items() if b != lost} and len(got) < 60
