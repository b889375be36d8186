import math
import random

import numpy as np
import pytest
from plumeworks.llm import vector_codes, vector_queries


def brute(rows, parts, entries, rounds):
    """code and error of each whole vector, by comparing every part with every entry."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [(i, [math.floor(x * 1024) for x in v]) for i, v in kept if len(v) == len(kept[0][1])]
    cuts = [len(kept[0][1]) * i // parts for i in range(parts + 1)]
    cut = lambda v: [tuple(v[a:b]) for a, b in zip(cuts, cuts[1:])]
    books = [[cut(v)[p] for _, v in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, v in kept:
                held.setdefault(near(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            for i, xs in held.items():
                books[p][i] = tuple(sum(c) // len(xs) for c in zip(*xs))
    out = []
    for i, v in kept:
        found = [near(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, [f[1] for f in found], sum(f[0] for f in found)))
    return sorted(out, key=repr), books


def coded(spark, rows, **how):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<float>, id long, vector string").repartition(3)
    found, books = vector_codes.compress(df, **how)
    return sorted(((r["vec_id"], r["code"], r["error"]) for r in found.collect()), key=repr), [[tuple(e) for e in b.tolist()] for b in books]


@pytest.mark.parametrize(("size", "values", "parts", "entries"), [(8, 3, 4, 40), (8, 1000, 4, 64), (6, 4, 4, 9), (4, 2, 1, 30), (0, 1, 4, 5)])
def test_equals_brute_force(spark, size, values, parts, entries):
    rng = random.Random(size + values)
    rows = [(i if i % 17 else None, [rng.randint(-values, values) / (1024 if i % 2 else 3000) for _ in range(size)]) for i in range(150)]
    rows += [(3, rows[4][1]), (5, rows[5][1]), (500, None), (501, [*[0.0] * (size + 1)])]
    if size:
        rows += [(-9, [float("nan")] * size), (-8, [None] * size), (-7, [float("-inf"), *[0.0] * (size - 1)])]
    assert coded(spark, rows, parts=parts, entries=entries, rounds=3) == brute([(i, v and [float(np.float32(x)) if x is not None else None for x in v]) for i, v in rows], parts, entries, 3)


def test_the_tree_gives_the_lower_index_of_equally_near_entries():
    rng = np.random.default_rng(3)
    for _ in range(30):
        entries, points = rng.integers(-2, 3, (200, 3)), rng.integers(-3, 4, (300, 3))
        at, least = vector_codes.nearest(vector_codes.tree_of(entries), points)
        d = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (at == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()


def test_components_too_large_for_doubles_are_exact():
    entries, points = np.array([[1 << 27, 0], [(1 << 27) - 1, 0]]), np.array([[-(1 << 28), 3]])
    at, least = vector_codes.nearest(vector_codes.tree_of(entries), points)
    assert at.tolist() == [1] and least.tolist() == [((1 << 28) + (1 << 27) - 1) ** 2 + 9]


def test_all_vectors_equal_and_fewer_than_entries(spark):
    got, books = coded(spark, [(i, [0.5, -0.25]) for i in range(6)], parts=2)
    assert got == [(i, [0, 0], 0) for i in range(6)] and books == [[(512,)] * 6, [(-256,)] * 6]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [float("nan")])]])
def test_nothing_to_code(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found, books = vector_codes.compress(df)
    assert found.count() == 0 and books == [] and found.columns == ["vec_id", "code", "error"]


def test_a_component_out_of_range_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        coded(spark, [(1, [1e30]), (2, [0.0])], parts=1)


def test_sums_of_labels_take_nulls_together(spark, tmp_path):
    rows = [(i, [float(i % 5), 1.0, 2.0, 3.0], None if i % 3 else 1) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_queries.op13_vector_codes(spark, str(tmp_path)).collect()
    by = {}
    for r in got:
        by.setdefault(rows[r["vec_id"]][2], []).append(r)
    assert len(got) == 300 and all(r["label_error"] == sum(x["error"] for x in g) for g in by.values() for r in g)
    assert len({r["codebooks_sha256"] for r in got}) == 1 and all(len(r["code"]) == 8 for r in got)
