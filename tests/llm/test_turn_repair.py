import functools
import hashlib
import random

import pytest
from plumeworks.llm import turn_queries, turn_repair


def brute(rows):
    """Totals, least cost and audit and the turns that it leaves, by trying every edit of every turn."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda a: (a[0] is not None, a[0] or 0, a[1], hashlib.sha256(a[2].encode()).digest()))
    faults, seen = [], set()
    for _, r, x in rows:
        end = x.rstrip(" \t\n\x0b\x0c\r")
        faults.append("b" if not end else "d" if (r, x) in seen else "t" if end[-1] not in ".!?" else "-")
        seen.add((r, x))

    @functools.cache
    def best(i, state, inserted):
        """(cost, audit, turns) from turn i on, the last role's initial being state."""
        ways = [(0, "", ())] if i == len(rows) and state in "^a" else []
        follows = {"^": "su", "s": "u", "u": "a", "a": "u"}[state]
        turns = [("I", 5, "user", ""), ("I", 5, "assistant", "")] if inserted < 2 else []
        if i < len(rows):
            _, r, x = rows[i]
            ways += [(2 + c, "D" + a, t) for c, a, t in [best(i + 1, state, 0)]]
            if faults[i] not in "bd":
                extra = 5 * (faults[i] == "t")
                turns += [("K", extra, r, x), ("R", 1 + extra, "user", x), ("R", 1 + extra, "assistant", x)]
        for letter, cost, role, text in turns:
            if role[:1] and role[0] in follows:
                c, a, t = best(i + (letter != "I"), role[0], inserted + 1 if letter == "I" else 0)
                ways.append((cost + c, letter + a, ((role, text), *t)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, turns = best(0, "^", 0)
    known = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (len(rows), gaps, faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost), audit, list(turns)


def repaired(spark, rows, **how):
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, lines string").repartition(4)
    conversations, pieces = turn_repair.repair(df, **how)
    totals = {r["conv_id"]: tuple(r[c] for c in ("rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")) for r in conversations.collect()}
    edits = {}
    for r in pieces.orderBy("part", "no").collect():
        audit, lines = edits.get(r["conv_id"], ("", []))
        edits[r["conv_id"]] = (audit + r["audit"], lines + [(x["role"], x["text"]) for x in r["lines"]])
    return {i: (totals[i], *edits[i]) for i in totals}


def some(seed, conversations, most):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["", " \n", None, "a.", "b!", "c? \t", "cut", f"{t}.", f"{t} cut", "é."])
            rows.append((c or None, rng.choice([t, t, t, None, t // 2]), role, text))
            if rng.random() < 0.2:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize(("seed", "most", "piece"), [(1, 8, 1000), (2, 12, 2), (3, 60, 7), (4, 5, 1)])
def test_equals_brute_force(spark, seed, most, piece):
    rows = some(seed, 60 if most < 20 else 8, most)
    want = {}
    for c, *r in rows:
        want.setdefault(c, []).append(tuple(r))
    assert repaired(spark, rows, piece_turns=piece) == {c: brute(r) for c, r in want.items()}


def test_one_conversation_over_many_ranges(spark):
    """Pieces in all partitions are chained to what the whole gives at once."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"{t}.", f"{t}", "again."])) for t in range(3000)]
    initials, faults, seen = "", "", set()
    for _, _, r, x in rows:
        initials += r[0]
        faults += "d" if (r, x) in seen else "-" if x.endswith(".") else "t"
        seen.add((r, x))
    (totals, audit, lines), (cost, want) = repaired(spark, rows, piece_turns=50)[1], turn_repair.whole_edits(initials, faults)
    assert (totals[-1], audit) == (cost, want)
    assert [(x["role"], x["text"]) for x in turn_repair.applied(want, [r[2] for r in rows], [r[3] for r in rows], "^")] == lines


def test_least_audit_of_equally_cheap_ones():
    assert turn_repair.whole_edits("", "") == (0, "")
    assert turn_repair.whole_edits("uu", "--") == (1, "KR")
    assert turn_repair.whole_edits("s", "-") == (2, "D")
    assert turn_repair.whole_edits("uaua", "----") == (0, "KKKK")
    assert turn_repair.whole_edits("uau", "---") == (2, "KKD")
    assert turn_repair.whole_edits("xx", "--") == (2, "RR")


def test_long_texts_and_empty_table(spark):
    long = "é" * 5_000_000
    got = repaired(spark, [(1, 0, "user", long + "."), (1, 1, "assistant", long), (2, 0, "user", "a.")])
    assert got[1][0] == (2, 0, 0, 0, 1, 0, 4) and got[1][1:] == ("DD", []) and got[2] == ((1, 0, 0, 0, 0, 0, 2), "D", [])
    conversations, pieces = turn_repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert conversations.count() == 0 and pieces.count() == 0


def test_a_conversation_whose_rows_are_all_dropped(spark, tmp_path):
    import zlib

    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    kept = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 > 4)
    spark.createDataFrame([(dropped, 0, "user", "a."), (kept, 0, "user", "a."), (None, None, None, None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in turn_queries.op12_turn_repair(spark, str(tmp_path)).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert tuple(got[dropped])[1:] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert (got[kept]["cost"], got[kept]["audit"]) == (2, "D") and None in got and len(got) == 3


def test_damage(spark):
    import zlib

    rows = [(c, t, r, x) for c in [None, *range(30)] for t in [None, 0, 1, 2] for r, x in [("user", "a. b! c?"), (None, None)]]
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        new = (c, t, "user" if kind == 4 else r, "" if kind == 1 else x.translate(str.maketrans("", "", ".!?")) if kind == 2 else x)
        want += [new] * (0 if kind == 0 else 2 if kind == 3 else 1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, turn_queries.damaged(df).collect()), key=repr) == sorted(want, key=repr)
