import random
import re

import pytest
from plumeworks.llm import personal_data as pd

BASE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain(text):
    out = []
    for k, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m[0] if c.isdigit())
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (14 <= len(digits) <= 19 and pd.luhn(digits)) or k == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns_equal_the_contract():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "@x.y", "1", "12", "255", "256", ".", "..", "-", " ", "+", "+49", "(0)", "4111111111111111", "4111 1111 1111 1111", "+1 (555) 123-4567", "é", "\n", "%", "000", "1.2.3.4"]
    for _ in range(20000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        assert pd.patterns(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "@" * 300_000):
        pd.patterns(text)


@pytest.fixture(scope="module")
def found(spark):
    texts = [
        None,
        "",
        "call +49 1512 3456789 now, or later 1512-3456789",
        "mail a@b.org and +4915123456789; again 4915123456789 and 4915123456780.",
        "clean text with 2021-2022 and 12 items",
        "ip 10.0.0.1 twice 10.0.0.1",
    ]
    docs = spark.createDataFrame([(i if i != 1 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    return {r["doc_id"]: r["spans"] for r in pd.find(docs).collect()}, texts


def test_skip_edges_carry_labels(found):
    rows, texts = found
    added = [(texts[3][s["start"] : s["end"]], s["kind"]) for s in rows[3] if s["added"]]
    assert added == [("4915123456789", "phone")]
    assert not any(s["added"] for s in rows[4] + rows[5]) and len(rows[5]) == 2


def test_null_and_empty_texts_have_none(found):
    assert found[0][0] == [] and found[0][None] == []


def test_empty_table(spark):
    assert pd.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_span_can_label_a_token():
    """Long tokens under many spans: the one that meets a later token isn't among the first few."""
    text = ",".join(["1.2.3.4"] * 20) + " 10.0.0.1 5.6.7.8"
    nodes = pd.Nodes()
    nodes.add(0, text, pd.patterns(text))
    assert nodes.label == [2, 2, 2]
