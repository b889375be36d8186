import zlib

import numpy as np
import pytest
from plumeworks.llm import language_id


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(spark, documents):
    got = language_id.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"] and r["lang"] is not None and r["lang_pred"] != "und"]
    assert len(held) > 100
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(spark, documents):
    odd = spark.createDataFrame([(None, "the cat", None), (-1, None, "en"), (-2, "", None), (-3, "12 .", "de"), (-4, "x" * 200_000, None), (-4, "x" * 200_000, None)], "doc_id long, text string, lang string")
    got = language_id.identify(documents.select("doc_id", "text", "lang").union(odd)).filter("doc_id is null or doc_id < 0").collect()
    assert len(got) == 6
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {-1, -2, -3}
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)


def test_nothing_to_learn_from(spark):
    rows = spark.createDataFrame([(1, "some text", None, 1)], "doc_id long, text string, lang string, score int")
    assert [(r["lang_pred"], r["score"]) for r in language_id.identify(rows).collect()] == [("und", 0.0)]
    assert language_id.identify(rows.filter("false")).count() == 0


def test_presence_is_of_each_text_alone():
    texts = [b"ab", b"", b"Ab", b"c"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    x = language_id.presence(data, np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    assert x.sum(axis=1).tolist() == [3, 0, 3, 1] and (x[0] == x[2]).all()


def test_scores_are_those_of_the_kernel():
    """The folded matrix against ridge regression on Nyström features of a kernel that is computed pair by pair from sets of n-grams."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list(alphabet), 30)) for _ in range(12) for alphabet in ("abcd ", "cdef ")]
    labels = ["a", "b"] * 12
    grams = [{t.encode()[i : i + n] for n in language_id.GRAMS for i in range(len(t) - n + 1)} for t in texts]
    kernel = np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in grams] for x in grams])
    marks = [i for n in ("a", "b") for i in [j for j, l in enumerate(labels) if l == n][:5]]
    values, vectors = np.linalg.eigh(kernel[np.ix_(marks, marks)])
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    phi = kernel[:, marks] @ root
    y = np.array([[1.0, -1.0] if l == "a" else [-1.0, 1.0] for l in labels])
    want = phi @ np.linalg.solve(phi.T @ phi + language_id.RIDGE * len(texts) * np.eye(phi.shape[1]) / phi.shape[1], phi.T @ y)
    names, weights = language_id.fit(texts, labels, landmarks=5)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    _, x, norm = next(language_id.blocks(data, np.arange(len(texts) + 1) * 30))
    assert names == ["a", "b"] and np.allclose(x.astype(float) @ weights / norm[:, None], want, atol=0.02)
