"""Each stage of the pipeline against a brute-force version, on a whole small table with odd rows."""

import corpus_pipeline
import pytest
import test_decontamination
import test_exact_dedup
import test_near_dedup
from plumeworks.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "x", 0), (10**6 + 2, "12 + 3", "en", "x", 6), (None, "a text without an id", None, None, None), (10**6 + 3, "z" * 30_000, None, None, 1)]
    return table.union(spark.createDataFrame(odd, table.schema))


def test_stages_equal_brute_force(spark, docs):
    kept = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    wants = (
        lambda rows: [r for r in rows if any(c.isalpha() for c in r[1] or "")],
        lambda rows: [r for r in rows if r[0] in {x[0] for x in test_exact_dedup.brute(rows) if x[3]}],
        lambda rows: [r for r in rows if r[0] in {x[0] for x in test_near_dedup.brute(rows, 5, 80) if x[3]}],
        lambda rows: [r for r in rows if r[0] not in {x[0] for x in test_decontamination.brute(rows, items) if x[5]}],
    )
    sizes = [len(kept)]
    for (_, stage), want in zip(corpus_pipeline.STAGES[:-1], wants, strict=True):
        docs = stage(spark, docs, SF)
        assert docs.columns == list(corpus_pipeline.DOCUMENT)
        kept = want(kept)
        assert sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr) == sorted(kept, key=repr)
        sizes.append(len(kept))
    assert all(a > b for a, b in zip(sizes, sizes[1:], strict=False))

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r["length"] for r in rows) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in kept)
    assert {r["doc_id"] for r in rows} == {x for x, _ in kept}


def test_a_row_that_goes_takes_no_other_along(spark, docs):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    one, two, near = ("%s red apples lay under the old tree by the river until the boys of the village came and took all of them home %s" % x for x in (("Many", "at night"), ("No", "as was said elsewhere in a quite different book"), ("Many", "at dawn")))
    rows = [(i, t, None, None, None) for i in (None, 7) for t in ("a b c", "another text of its own", item, one + " " + two)]
    rows += [(1, "a b c", None, None, None), (1, "a b c", "en", None, None)]
    rows += [(1, "a b c", "en", None, None), (2, (one + " " + two) * 3 + " x", "en", None, None), (1, (one + " " + two) * 3 + " y", "en", None, None), (1, "clean and alone", "en", None, None), (8, near, None, None, None)]
    table = spark.createDataFrame(rows, docs.schema)
    texts = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    plain = [(r[0], r[1]) for r in rows]
    exact = texts(corpus_pipeline.one_of_exact_copies(spark, table, SF))
    assert exact == sorted({t: (i, t) for i, t in sorted(plain, key=lambda r: (r[0] is not None, -(r[0] or 0)))}.values(), key=repr)
    clean = texts(corpus_pipeline.without_benchmark(spark, table, SF))
    assert clean == sorted((r for r in plain if r[1] != item), key=repr)
    left = texts(corpus_pipeline.one_of_near_copies(spark, table, SF))
    assert (1, rows[12][1]) in left and (2, rows[11][1]) not in left and (1, "clean and alone") in left and (None, "another text of its own") not in left and (7, "another text of its own") in left


def test_a_null_language_is_the_classifiers(spark, docs):
    some = docs.filter("doc_id % 2 = 0 and lang is not null").limit(1).select("text").first()["text"]
    extra = spark.createDataFrame([(10**7, some, None, None, None)], docs.schema)
    got = corpus_pipeline.known_language(spark, docs.union(extra), SF)
    assert got.filter("lang is null").count() == 0 and got.filter(f"doc_id = {10**7}").count() == 1


def test_empty_table(spark, docs):
    none = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
