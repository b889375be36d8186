import random
import re

import pytest
from plumeworks.llm import near_dedup
from plumeworks.llm.components import components


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, k, percent):
    sets = [shingles(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    out = []
    for i, (doc, _) in enumerate(docs):
        group = least.get(find(i)) if sets[i] else doc
        out.append((doc, len(sets[i]), group, doc == group))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdef", k=4))
    out = [None, "", " \n", "One", "one", "one two", "ONE  two", "one two three"]
    for base in ([word() for _ in range(100)] for _ in range(3)):
        for _ in range(45):  # a family whose members are now above the threshold and now below it
            w = base[:]
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice(([], [word()], [w[at], word()]))
            out.append(" ".join(w))
    out += [" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(40)] + out[-5:]
    rng.shuffle(out)
    return [(None if i % 60 == 11 else i, t) for i, t in enumerate(out)]


def collected(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("k", "percent", "few", "rare"), [(3, 85, 256, 64), (5, 80, 256, 64), (3, 85, 3, 64), (3, 85, 3, 1)])
def test_equals_brute_force(spark, docs, monkeypatch, k, percent, few, rare):
    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(near_dedup, "PIVOTS", few)
    monkeypatch.setattr(near_dedup, "RARE", rare)
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, cid int, n_shingles int").repartition(3)
    assert collected(near_dedup.near_groups(df, shingle=k, percent=percent)) == brute(docs, k, percent)


def test_empty_table(spark):
    assert near_dedup.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(7, 7), (None, 3), (900, 899), (899, 900)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if None not in (a, b) and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
