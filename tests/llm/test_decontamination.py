import random
import re

import pytest
from plumeworks.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[key]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(ids), ids, bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(4)
    some = lambda n, letters="abc": [rng.choice(letters) * rng.randint(1, 2) for _ in range(n)]
    items = [(i, " ".join(some(rng.randint(10, 30)))) for i in range(12)]
    items += [(20, "Short one"), (21, None), (22, "..."), (20, "Short one"), (None, " ".join(some(12))), (23, items[0][1]), (100, "é word 7")]
    docs = []
    for i in range(60):
        w = some(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            x = words(rng.choice(items)[1])
            at, a = rng.randint(0, len(w)), rng.randint(0, max(0, len(x) - 12))
            w[at:at] = x[a : a + rng.randint(8, 20)]
        docs.append((i % 50, "; ".join(x.upper() if rng.random() < 0.3 else x for x in w)))
    docs += [(None, items[1][1]), (90, None), (91, ""), (92, "short ONE, short one"), (93, "x" * 100_000 + " short one")]
    return docs, items


def collected(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["item_ids"], r["contaminated"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("broadcast", [True, False])
def test_equals_brute_force(spark, tables, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    docs, items = tables
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, words string, uid int").repartition(3)
    b = spark.createDataFrame([(*r, 2) for r in items], "item_id long, text string, h int")
    assert collected(decontamination.decontaminate(d, b)) == brute(docs, items)


def test_empty_tables(spark, tables):
    docs, items = tables
    no_docs, no_items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(no_docs, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    got = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), no_items)
    assert collected(got) == brute(docs, [])
