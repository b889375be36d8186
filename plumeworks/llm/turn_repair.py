"""Repair of conversations: the cheapest edits that make the roles alternate, by a dynamic program over the turns that stay.

A state is the role of the last turn that stayed. The price of a gap between two turns that stay comes from
prefix sums of the deletions and a running minimum for each state; the pair of roles says how many turns must be
inserted between them; of equally cheap edits the least audit wins. Conversations lie in ranges of one order of
all turns. One that a range's border cuts, or a very long one, is solved in pieces: each piece gives the
cheapest edits from every state to every other, and these are chained.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_rows, saved, sieved

#: Prices of the edits, and of a turn that is kept though it is cut short.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Nothing kept yet, or the initial of the last kept turn's role.
STATES = "^sua"
#: Turns to insert between a state and the role of the next kept turn; other pairs can't follow each other.
BETWEEN = {("^", "s"): 0, ("^", "u"): 0, ("^", "a"): 1, ("s", "u"): 0, ("s", "a"): 1, ("u", "a"): 0, ("u", "u"): 1, ("a", "u"): 0, ("a", "a"): 1}
#: Turns to insert after the last kept one.
AFTER = {"^": 0, "s": 2, "u": 1, "a": 0}
LEGAL = {"su", "ua", "au"}
#: Turns and characters of a piece, at most; a longer turn is a piece of its own.
PIECE_TURNS, PIECE_CHARS = 1000, 4_000_000

#: [\x20\x09-\x0D]
SPACE = " \t\n\x0b\x0c\r"


class Best(NamedTuple):
    """A state's cheapest edits: their price less the price of deleting all turns before `place`, and the audit up to there."""

    price: int
    audit: str
    place: int


def best_edits(initials: str, faults: str, entry: str) -> dict[str, tuple[int, str]]:
    """(cost, audit) of the cheapest edits of these turns from state `entry` to each state that can be reached, the least audit of equal cost."""
    gone = [DELETE * i for i in range(len(initials) + 1)]
    best = {entry: Best(0, "", 0)}
    for i, (role, fault) in enumerate(zip(initials, faults, strict=True)):
        if fault in "bd":
            continue
        kept = {}
        for state in "sua":
            if state == "s" and role != "s":
                continue
            own = (0 if role == state else REROLE) + (TRUNCATED if fault == "t" else 0)
            letter = "K" if role == state else "R"
            ways = [(b.price + gone[i] + INSERT * BETWEEN[last, state] + own, b.audit + "D" * (i - b.place) + "I" * BETWEEN[last, state] + letter) for last, b in best.items() if (last, state) in BETWEEN]
            if ways:
                kept[state] = min(ways)
        for state, (cost, audit) in kept.items():
            new, old = Best(cost - gone[i + 1], audit, i + 1), best.get(state)
            if old is None or (new.price, new.audit) < (old.price, old.audit + "D" * (i + 1 - old.place)):
                best[state] = new
    return {state: (b.price + gone[-1], b.audit + "D" * (len(initials) - b.place)) for state, b in best.items()}


def whole_edits(initials: str, faults: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return min((cost + INSERT * AFTER[state], audit + "I" * AFTER[state]) for state, (cost, audit) in best_edits(initials, faults, "^").items())


def chained(pieces: list[dict[tuple[str, str], tuple[int, int]]]) -> tuple[int, list[str]]:
    """The cost of a conversation and the state before each piece and after the last. pieces: (cost, rank of the audit among the piece's) from state to state.

    Audits of one piece are never a part of one another, so that a chain's audit is the lesser if its first differing rank is.
    """
    now, back = {"^": (0, 0)}, []
    for piece in pieces:
        ways: dict[str, tuple[int, tuple[int, int], str]] = {}
        for (a, b), (cost, rank) in piece.items():
            if a in now:
                way = (now[a][0] + cost, (now[a][1], rank), a)
                ways[b] = min(ways.get(b, way), way)
        places = {x: i for i, x in enumerate(sorted({w[1] for w in ways.values()}))}
        now = {state: (w[0], places[w[1]]) for state, w in ways.items()}
        back.append({state: w[2] for state, w in ways.items()})
    cost, _, _, state = min((cost + INSERT * AFTER[s], place, AFTER[s], s) for s, (cost, place) in now.items())
    path = [state]
    for step in reversed(back):
        path.append(step[path[-1]])
    return cost, path[::-1]


def applied(audit: str, roles: list[str], texts: list[str], state: str) -> list[dict[str, str]]:
    """The turns that an audit leaves, from the state before them."""
    out, rows = [], iter(zip(roles, texts, strict=True))
    for letter in audit:
        role, text = (None, "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if state == "u" else "user"
        out.append({"role": role, "text": text})
        state = role[0]
    return out


def ranked(initials: str, faults: str) -> dict[tuple[str, str], tuple[int, int]]:
    found = {(a, b): x for a in STATES for b, x in best_edits(initials, faults, a).items()}
    place = {audit: i for i, audit in enumerate(sorted({audit for _, audit in found.values()}))}
    return {k: (cost, place[audit]) for k, (cost, audit) in found.items()}


class Piece:
    """Turns of one conversation that follow each other."""

    def __init__(self):
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.faults = ""
        self.turns: list[int | None] = []
        self.chars = 0

    def add(self, role: str, text: str, fault: str, turn: int | None) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.faults += fault
        self.turns.append(turn)
        self.chars += len(text)

    def row(self, whole: bool) -> dict:
        initials = "".join(r[:1] or "\0" for r in self.roles)
        known = [t for t in self.turns if t is not None]
        totals = {"rows": len(self.roles), "blank": self.faults.count("b"), "duplicate": self.faults.count("d"), "truncated": self.faults.count("t")}
        totals |= {"illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)), "least": known[0] if known else None, "most": known[-1] if known else None, "distinct": len(set(known)), "first": initials[:1], "last": initials[-1:]}
        out = {"totals": totals, "whole": whole}
        if whole:
            out["cost"], out["audit"] = whole_edits(initials, self.faults)
            return out | {"lines": applied(out["audit"], self.roles, self.texts, "^")}
        ways = ranked(initials, self.faults)
        ways = [{"before": a, "after": b, "cost": c, "rank": r} for (a, b), (c, r) in sorted(ways.items())]
        return out | {"ways": ways, "initials": initials, "faults": self.faults, "lines": [{"role": r, "text": t} for r, t in zip(self.roles, self.texts, strict=True)]}


LINES = "array<struct<role:string,text:string>>"
TOTALS = "struct<rows:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,least:bigint,most:bigint,distinct:bigint,first:string,last:string>"
WAYS = "array<struct<before:string,after:string,cost:bigint,rank:int>>"
PIECES = f"part long, no long, whole boolean, totals {TOTALS}, cost long, audit string, lines {LINES}, initials string, faults string, ways {WAYS}"
CHAIN = f"totals {TOTALS}, cost long, path array<struct<part:bigint,no:bigint,before:string,after:string,final:boolean>>"


def with_conv(conv: T.StructField, ddl: str) -> T.StructType:
    return T.StructType([T.StructField("conv", conv.dataType), *T._parse_datatype_string(ddl).fields])


def arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def cut(schema: T.StructType, piece_turns: int):
    """Pieces of the conversations of a range, whose rows come in order; the first and last conversation may go on in other ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, out, held, no, chars = arrow(schema), [], Piece(), 0, 0
        conv, begun, others = object(), False, False

        def close(whole: bool) -> None:
            nonlocal held, no, chars
            out.append({"conv": conv, "part": part, "no": no} | held.row(whole))
            chars += held.chars
            no, held = no + 1, Piece()

        for batch in batches:
            for r in batch.to_pylist():
                part = r["part"]
                if r["conv"] != conv:
                    if held.roles:
                        close(begun)
                    conv, begun, others = r["conv"], others, True
                held.add(r["role"], r["text"], r["fault"], r["turn"])
                if len(held.roles) >= piece_turns or held.chars >= PIECE_CHARS:
                    close(False)
                    begun = False
                if len(out) >= 2000 or chars >= PIECE_CHARS:
                    yield pa.RecordBatch.from_pylist(out, schema=columns)
                    out, chars = [], 0
        if held.roles:
            close(False)
        yield pa.RecordBatch.from_pylist(out, schema=columns)

    return run


def chain(schema: T.StructType):
    """Totals, cost and the states around each piece of the conversations that are in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, pieces in zip(batch.column("conv").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                cost, path = chained([{(w["before"], w["after"]): (w["cost"], w["rank"]) for w in p["ways"]} for p in pieces])
                total = dict(pieces[0]["totals"])
                for p in pieces[1:]:
                    t = p["totals"]
                    total["illegal"] += t["illegal"] + (total["last"] + t["first"] not in LEGAL)
                    total["distinct"] += t["distinct"] - (t["least"] is not None and t["least"] == total["most"])
                    for c in ("rows", "blank", "duplicate", "truncated"):
                        total[c] += t[c]
                    total["least"] = t["least"] if total["least"] is None else total["least"]
                    total["most"] = total["most"] if t["most"] is None else t["most"]
                    total["last"] = t["last"]
                steps = [{"part": p["part"], "no": p["no"], "before": path[i], "after": path[i + 1], "final": i == len(pieces) - 1} for i, p in enumerate(pieces)]
                out.append({"conv": conv, "totals": total, "cost": cost, "path": steps})
            yield pa.RecordBatch.from_pylist(out, schema=arrow(schema))

    return run


def solved(schema: T.StructType):
    """Audit and turns of pieces whose states before and after are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                audit = best_edits(r["initials"], r["faults"], r["before"])[r["after"]][1]
                if r["final"]:
                    audit += "I" * AFTER[r["after"]]
                lines = applied(audit, [x["role"] for x in r["lines"]], [x["text"] for x in r["lines"]], r["before"])
                out.append({"conv": r["conv"], "part": r["part"], "no": r["no"], "audit": audit, "lines": lines})
            yield pa.RecordBatch.from_pylist(out, schema=arrow(schema))

    return run


def fault(text: Column, again: Column) -> Column:
    """The first fault of a turn: b(lank), d(uplicate), t(runcated), or -."""
    end = F.expr(f"rtrim('{SPACE}', text)")
    return F.when(end == "", "b").when(again, "d").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "t").otherwise("-")


def repair(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece_turns: int = PIECE_TURNS) -> tuple[DataFrame, DataFrame]:
    """(conversations, pieces) of the turns of each conversation, taken by number, null numbers first, then by role and the text's SHA-256.

    conversations: conv_col, rows, gaps, blank, duplicate, truncated, illegal (neighbours whose roles' initials are none of su, ua, au) and
    cost of the cheapest edits. pieces: conv_col, part, no, audit and lines (role, text) of the repaired turns; a conversation's pieces
    follow each other by (part, no), nearly always there is one. Edits: K(eep), R(erole to user or assistant), D(elete; a must for blank
    and duplicate turns) and I(nsert an empty user or assistant turn), at the prices above; the remaining roles' initials are
    s?(ua)+ or nothing, and of equally cheap audits the least is taken.

    A null role or text counts as one space; rows with a null conversation are one conversation; of repeated rows the first
    stays and the others are duplicates, in whatever order they come. A conversation without rows isn't there; an empty
    table gives no rows. Other columns are ignored. A conversation of any length is dealt out over tasks in pieces, and no text is cut.
    """
    spark = turns.sparkSession
    arrow_rows(spark)
    plain = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.hex("digest"), F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("-"))), 256)
    rows = saved(plain.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("said", F.unhex(said)).withColumn("uid", F.monotonically_increasing_id()), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "uid")
    again = saved(rows.groupBy("said").agg(F.count("*").alias("n"), F.min(place)["uid"].alias("first")).filter("n > 1").select("said", "first"), "said-again")
    maybe = sieved(rows, "said", again.select("said"))
    once = maybe.filter("not _maybe").drop("_maybe").withColumn("first", F.col("uid"))
    rows = once.unionByName(maybe.filter("_maybe").drop("_maybe").join(again, "said", "left"))
    marked = rows.withColumn("fault", fault(F.col("text"), F.coalesce(F.col("first") != F.col("uid"), F.lit(False))))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("uid")]
    ranges = marked.drop("first").repartitionByRange(*order).sortWithinPartitions(*order)
    conv = plain.schema["conv"]
    pieces = with_conv(conv, PIECES)
    cuts = ranges.select("conv", "turn", "role", "text", "fault", F.spark_partition_id().cast("long").alias("part"))
    found = saved(cuts.mapInArrow(cut(pieces, piece_turns), pieces), "turn-pieces")

    parts = found.filter("not whole")
    gathered = parts.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "no", "totals", "ways"))).alias("pieces"))
    chains = with_conv(conv, CHAIN)
    linked = saved(gathered.mapInArrow(chain(chains), chains), "turn-chains")
    steps = linked.select(F.explode("path").alias("s")).select("s.*")
    ends = with_conv(conv, f"part long, no long, audit string, lines {LINES}")
    joined = parts.select("conv", "part", "no", "initials", "faults", "lines").join(steps, ["part", "no"]).select("conv", "part", "no", "initials", "faults", "lines", "before", "after", "final")
    whole = found.filter("whole")
    repaired = whole.select("conv", "part", "no", "audit", "lines", F.lit(True).alias("whole")).unionByName(joined.mapInArrow(solved(ends), ends).withColumn("whole", F.lit(False)))
    t = lambda c: F.col(f"totals.{c}")
    gaps = F.coalesce(t("most") - t("least") + 1 - t("distinct"), F.lit(0).cast("long"))
    totals = whole.select("conv", "totals", "cost").unionByName(linked.select("conv", "totals", "cost"))
    conversations = totals.select(F.col("conv").alias(conv_col), t("rows").alias("rows"), gaps.alias("gaps"), *(t(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")), "cost")
    return conversations, repaired.withColumnRenamed("conv", conv_col)
