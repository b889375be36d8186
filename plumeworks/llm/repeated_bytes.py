"""Bytes of long strings that occur more than once, from the merged Burrows-Wheeler transforms of shards of the texts.

Texts are cut into phrases at local minima of a rolling hash, so that two places with the same bytes have the same cuts away
from their ends. A phrase is a symbol, a text a string of symbols. Each shard of texts sorts its own suffixes once and keeps
its transform: from a suffix's rank to the rank of the suffix one symbol longer. The shards are then merged by refining their
interleave: a block is all suffixes that share h symbols, and holds one interval of each shard's ranks; the step to h + 1
goes from every interval through the transform, and intervals of different shards meet again by (symbol, block). Blocks of one
suffix are gone, so that the last block that a suffix was in is the longest prefix that it shares with any other. No suffix is
sorted again. Windows within such repeats are repeated; those that begin or end between two cuts are compared by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontamination import sieve_of
from .shared import among, arrow_rows, discard, saved, sieved
from .textnum import U64, slices, span_hashes

#: Symbols of a shard.
SHARD_SYMBOLS = 1_000_000
#: A suffix that runs into its text's end before it spans a window.
ENDLESS = 255


class Cutting(NamedTuple):
    """length: bytes of a window; a cut is the least hash of `gram` bytes among `reach` places on either side."""

    length: int
    reach: int
    gram: int

    @property
    def most(self) -> int:
        """Symbols that span a window and the phrase before it, at most."""
        return self.length // (self.reach + 1) + 3


def cutting(length: int) -> Cutting:
    """A dozen reaches in a window, so that nearly every window has several cuts that depend on its own bytes alone."""
    return Cutting(length, 1 << max(0, (length // 12).bit_length() - 1), max(1, min(8, length // 8)))


#: Two independent numbers for each byte; windows are told apart by two hashes of 64 bits.
BYTES = [np.random.default_rng(seed).integers(0, 1 << 63, 256, np.int64).astype(U64) for seed in (11, 12)]


def window_hashes(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    first, second = (span_hashes(b[data], at, at + length).view(np.int64) for b in BYTES)
    return first, second


def cuts_of(data: np.ndarray, offsets: np.ndarray, c: Cutting) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, first): the places of all texts' cuts in data, each text's begin and end included, and the index of each text's begin, and one more."""
    n = len(data)
    wide = np.concatenate((data, np.zeros(8, np.uint8)))
    grams = np.ndarray(n, "<u8", wide, strides=(1,)) & U64((1 << 8 * c.gram) - 1)
    h = ((grams * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32)
    least, wide_by = h, 1
    while wide_by < c.reach:
        least = np.minimum(least[:-wide_by], least[wide_by:])
        wide_by *= 2
    inner = np.zeros(0, np.int64)
    if n > 2 * c.reach:
        middle = h[c.reach : n - c.reach]
        inner = np.flatnonzero((middle < least[: n - 2 * c.reach]) & (middle <= least[c.reach + 1 : n - c.reach + 1])) + c.reach
        text = np.searchsorted(offsets, inner, "right") - 1
        inner = inner[(inner - c.reach >= offsets[text]) & (inner + c.reach + c.gram <= offsets[text + 1])]
    ends = np.concatenate((offsets[:-1], offsets[1:]))
    cuts = np.concatenate((inner, ends))
    text = np.concatenate((np.searchsorted(offsets, inner, "right") - 1, np.arange(len(offsets) - 1), np.arange(len(offsets) - 1)))
    order = np.lexsort((cuts, text))
    return cuts[order], np.searchsorted(text[order], np.arange(len(offsets)))


class Segments(NamedTuple):
    """Windows begin .. end - 1 of a text that have the same cuts, from `a` to `b`. full: they lie in a repeat; bare: no cut depends on
    their own bytes alone; lone: just one does; open: the phrases between their cuts repeat, and their bytes will tell."""

    begin: np.ndarray
    end: np.ndarray
    full: np.ndarray
    bare: np.ndarray
    lone: np.ndarray
    open: np.ndarray
    a: np.ndarray
    b: np.ndarray


def segments(cuts: np.ndarray, shared: np.ndarray, c: Cutting) -> Segments:
    """cuts: of one text, begin and end included; shared: the symbols that the suffix at each cut but the last shares with another."""
    last = int(cuts[-1]) - c.length + 1
    inner = cuts[1:-1]
    reached = cuts[np.arange(len(shared)) + shared]
    edges = np.concatenate((cuts[:-1], inner - c.reach + 1, inner - c.length + c.reach + c.gram, reached - c.length + 1, [0, last]))
    edges = np.unique(edges[(edges >= 0) & (edges <= last)])
    begin, end = edges[:-1], edges[1:]
    here = np.searchsorted(cuts, begin, "right") - 1
    full = end - 1 + c.length <= reached[here]
    a = np.searchsorted(inner, begin + c.reach, "left") + 1
    b = np.searchsorted(inner, begin + c.length - c.reach - c.gram, "right")
    return Segments(begin, end, full, b < a, a == b, ~full & (b > a) & (shared[np.minimum(a, len(shared) - 1)] >= b - a), a, b)


def places(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, in a row."""
    size = end - begin
    return np.repeat(end - np.cumsum(size), size) + np.arange(int(size.sum()))


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = max((len(x) for x in columns.values()), default=0)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


WINDOWS = pa.schema([("text_id", pa.int64()), ("at", pa.int64()), ("end", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("n", pa.int64())])
WINDOWS_DDL = "text_id long, at long, end long, h long, g long, n long"


def window_rows(schema: pa.Schema, ids: np.ndarray, text: np.ndarray, at: np.ndarray, asked: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int) -> pa.RecordBatch:
    """Rows for the windows at places `at` of data, ascending within a text: its place and hashes of one that is alone here and asked for; hashes and
    number of others; and ranges of places (without hashes) of those asked for that already occur twice here."""
    h, g = window_hashes(data, at, length)
    order = np.lexsort((g, h))
    new = np.ones(len(at), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    one = order[first]
    single = (n == 1) & asked[one]
    twice = np.zeros(len(at), bool)
    twice[order] = np.repeat(n > 1, n)
    met = np.flatnonzero(twice & asked)
    begins = np.ones(len(met), bool)
    begins[1:] = (at[met[1:]] != at[met[:-1]] + 1) | (text[met[1:]] != text[met[:-1]])
    from_ = met[begins]
    to = met[np.append(np.flatnonzero(begins)[1:], len(met)) - 1] if len(met) else met
    rows = [one[single], one[~single]]
    nothing = lambda k: pa.nulls(k, pa.int64())
    local = lambda i: pa.array(at[i] - offsets[text[i]], pa.int64())
    many = lambda x, i: pa.array(x[i], pa.int64())
    columns = {
        "text_id": [many(ids, text[rows[0]]), nothing(len(rows[1])), many(ids, text[from_])],
        "at": [local(rows[0]), nothing(len(rows[1])), local(from_)],
        "end": [nothing(len(rows[0])), nothing(len(rows[1])), pa.array(at[to] - offsets[text[to]] + 1, pa.int64())],
        "h": [many(h, rows[0]), many(h, rows[1]), nothing(len(from_))],
        "g": [many(g, rows[0]), many(g, rows[1]), nothing(len(from_))],
        "n": [many(n, single), many(n, ~single), nothing(len(from_))],
    }
    return batch_of(schema, **{k: pa.concat_arrays(v) for k, v in columns.items()})


PHRASES = pa.schema([("symbols", pa.binary()), ("cuts", pa.binary()), ("margin", pa.int64()), *WINDOWS])
PHRASES_DDL = "symbols binary, cuts binary, margin long, " + WINDOWS_DDL


def phrases(c: Cutting):
    """Each text's symbols and cuts; a row for each cut that is alone in a window, by a hash of its surroundings; and rows for the windows without a cut of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids = np.asarray(batch.column("text_id"))
            for lo, hi, data, offsets in slices(batch.column("text")):
                ids = all_ids[lo:hi]
                cuts, first = cuts_of(data, offsets, c)
                begins = np.ones(len(cuts), bool)
                begins[first[1:] - 1] = False
                starts = np.flatnonzero(begins)
                symbols = span_hashes(data, cuts[starts], cuts[starts + 1])
                # Cuts so far apart that a window may have one or none between them.
                apart = np.zeros(len(cuts), bool)
                apart[:-2] = cuts[2:] - cuts[:-2] > c.length - 2 * c.reach - c.gram
                wide = np.add.reduceat(apart, first[:-1]) > 0
                local = [cuts[first[i] : first[i + 1]] - offsets[i] for i in range(hi - lo)]
                ends = first - np.arange(len(first))
                yield batch_of(PHRASES, text_id=ids, symbols=[symbols[ends[i] : ends[i + 1]].tobytes() for i in range(hi - lo)], cuts=[x.astype(np.int32).tobytes() for x in local])
                text, at, lone, owner = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, int)]
                for i in np.flatnonzero(wide | (np.diff(first) < 4)).tolist():
                    s = segments(local[i], np.zeros(len(local[i]) - 1, np.int64), c)
                    at.append(places(s.begin[s.bare], s.end[s.bare]) + offsets[i])
                    text.append(np.full(len(at[-1]), i))
                    lone.append(np.unique(s.a[s.lone]) + first[i])
                    owner.append(np.full(len(lone[-1]), i))
                text, at, lone, owner = (np.concatenate(x) for x in (text, at, lone, owner))
                yield batch_of(PHRASES, text_id=ids[owner], margin=span_hashes(BYTES[0][data], cuts[lone] - c.reach, cuts[lone] + c.reach + c.gram).view(np.int64))
                yield window_rows(PHRASES, ids, text, at, np.ones(len(at), bool), data, offsets, c.length)

    return run


COUNTS = pa.schema([("h", pa.int64()), ("n", pa.int64())])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, n = np.unique(np.frombuffer(b"".join(batch.column("symbols").to_pylist()), np.int64), return_counts=True)
        yield batch_of(COUNTS, h=values, n=n)


SHARDS = pa.schema([("shard", pa.int64()), ("symbols", pa.binary()), ("needs", pa.binary()), ("longer", pa.binary()), ("place", pa.binary()), ("texts", pa.binary()), ("first", pa.binary()), ("index", pa.binary())])
SHARDS_DDL = "shard long, symbols binary, needs binary, longer binary, place binary, texts binary, first binary, index binary"


def ranks_of(symbols: np.ndarray, text: np.ndarray, index: np.ndarray, most: int) -> np.ndarray:
    """Rank order of the suffixes by their first `most` symbols at least, by prefix doubling within the shard."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    order, by = np.argsort(rank, kind="stable"), 1
    while by < most:
        beyond = np.zeros(n, np.int64)
        follows = (text[by:] == text[:-by]) & (index[by:] == index[:-by] + by)
        beyond[:-by][follows] = rank[by:][follows]
        key = rank * (n + 1) + beyond
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if rank.max(initial=0) == n:
            break
        by *= 2
    return order


def sharded(c: Cutting, sieve, shard_symbols: int):
    """Shards of the symbols that may repeat: sorted suffixes, and from each the rank of the one that is a symbol longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, size, part, no = np.frombuffer(sieve.value, np.uint8), [], 0, None, 0

        def shard() -> pa.RecordBatch:
            nonlocal held, size, no
            texts = np.array([t for t, *_ in held], np.int64)
            symbols, needs, index = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            counts = np.array([len(x[1]) for x in held])
            text = np.repeat(np.arange(len(held)), counts)
            order = ranks_of(symbols, text, index, c.most)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            before = np.zeros(len(order), bool)
            before[1:] = (text[1:] == text[:-1]) & (index[1:] == index[:-1] + 1)
            longer = np.where(before[order], rank[order - 1], -1).astype(np.int32)
            columns = {"symbols": symbols[order], "needs": needs[order], "longer": longer, "place": order.astype(np.int32), "texts": texts, "first": np.concatenate(([0], np.cumsum(counts))), "index": index.astype(np.int32)}
            held, size, no = [], 0, no + 1
            return batch_of(SHARDS, shard=[part << 24 | no], **{k: [x.tobytes()] for k, x in columns.items()})

        for batch in batches:
            part = batch.column("part")[0].as_py() if part is None and batch.num_rows else part
            rows = [np.frombuffer(b, np.uint64) for b in batch.column("symbols").to_pylist()]
            if not rows:
                continue
            all_symbols = np.concatenate(rows)
            slot = all_symbols & U64(len(bits) * 8 - 1)
            maybe = bits[slot >> U64(3)] >> (slot & U64(7)).astype(np.uint8) & 1 > 0
            first = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
            # Cuts of all texts on one line, further apart than a window, give the symbols that a suffix needs.
            line = [np.frombuffer(b, np.int32).astype(np.int64) for b in batch.column("cuts").to_pylist()]
            base = np.cumsum([0, *(int(x[-1]) + 2 * c.length for x in line[:-1])])
            cuts = np.concatenate([x + b for x, b in zip(line, base, strict=True)])
            text = np.repeat(np.arange(len(rows)), np.diff(first))
            at = np.arange(len(all_symbols)) + text
            to = np.searchsorted(cuts, cuts[at + 1] + c.length - 1, "left")
            needs = np.where(to <= (first[text + 1] + text), np.minimum(to - at, ENDLESS), ENDLESS).astype(np.uint8)
            index = np.arange(len(all_symbols)) - first[text]
            for i, t in enumerate(batch.column("text_id").to_pylist()):
                kept = np.flatnonzero(maybe[first[i] : first[i + 1]]) + first[i]
                if len(kept):
                    held.append((t, all_symbols[kept], needs[kept], index[kept]))
                    size += len(kept)
                    if size >= shard_symbols:
                        yield shard()
        if held:
            yield shard()

    return run


INTERVALS = pa.schema([("symbol", pa.int64()), ("block", pa.int64()), ("shard", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
INTERVALS_DDL = "symbol long, block long, shard long, start int, n int"


def intervals(shard: int, at: np.ndarray, symbols: np.ndarray, blocks: np.ndarray) -> dict:
    """Runs of equal (symbol, block) of the suffixes at the ranks `at`, which ascend."""
    new = np.ones(len(at), bool)
    new[1:] = (symbols[1:] != symbols[:-1]) | (blocks[1:] != blocks[:-1])
    starts = np.flatnonzero(new)
    return {"symbol": symbols[starts].view(np.int64), "block": blocks[starts], "shard": np.full(len(starts), shard), "start": at[starts], "n": np.diff(np.append(starts, len(at)))}


def first_intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shard's suffixes by their first symbol."""
    for batch in batches:
        for shard, own in zip(batch.column("shard").to_pylist(), batch.column("symbols").to_pylist(), strict=True):
            symbols = np.frombuffer(own, np.uint64)
            yield batch_of(INTERVALS, **intervals(shard, np.arange(len(symbols)), symbols, np.zeros(len(symbols), np.int64)))


def longer_intervals(h: int):
    """From the blocks of h symbols to intervals of h + 1, through the shard's transform. Suffixes that span a window already go no further."""

    def run(shards: pa.Table, level: pa.Table) -> pa.Table:
        out = []
        if shards.num_rows and level.num_rows:
            symbols, needs, longer = (np.frombuffer(shards.column(c)[0].as_py(), t) for c, t in (("symbols", np.uint64), ("needs", np.uint8), ("longer", np.int32)))
            start, n, block = (np.asarray(level.column(c)).astype(np.int64) for c in ("start", "n", "block"))
            at, blocks = places(start, start + n), np.repeat(block, n)
            to = longer[at].astype(np.int64)
            goes = to >= 0
            goes[goes] = needs[to[goes]] > h
            to, blocks = to[goes], blocks[goes]
            order = np.argsort(to)
            to, blocks = to[order], blocks[order]
            out.append(batch_of(INTERVALS, **intervals(shards.column("shard")[0].as_py(), to, symbols[to], blocks)))
        return pa.Table.from_batches(out, schema=INTERVALS)

    return run


def blocks_of(found: DataFrame) -> DataFrame:
    """The interleave's next blocks: intervals of all shards that meet by (symbol, block), if they hold two suffixes at least."""
    members = F.collect_list(F.struct("shard", "start", "n")).alias("members")
    met = found.groupBy("symbol", "block").agg(F.sum("n").alias("size"), members).filter("size > 1")
    return met.select(F.monotonically_increasing_id().alias("block"), "members").select("block", F.inline("members"))


def merged(shards: DataFrame, c: Cutting) -> DataFrame:
    """shard, start, n and h of each block's intervals, for all h that windows need."""
    index = shards.select("shard", "symbols", "needs", "longer")
    level, levels = saved(blocks_of(shards.select("shard", "symbols").mapInArrow(first_intervals, INTERVALS_DDL)), "blocks"), []
    for h in range(1, c.most + 1):
        levels.append(level.withColumn("h", F.lit(h)))
        if h == c.most or level.isEmpty():
            break
        found = index.groupBy("shard").cogroup(level.groupBy("shard")).applyInArrow(longer_intervals(h), INTERVALS_DDL)
        level = saved(blocks_of(found), "blocks")
    return reduce(DataFrame.unionByName, levels).select("shard", "start", "n", "h")


SHARED = pa.schema([("text_id", pa.int64()), ("index", pa.binary()), ("shared", pa.binary())])
SHARED_DDL = "text_id long, index binary, shared binary"


def common_prefixes(shards: pa.Table, levels: pa.Table) -> pa.Table:
    """Of each text in the shard: the places of its symbols that repeat, and how many symbols the suffix there shares with another."""
    out = []
    if shards.num_rows and levels.num_rows:
        place, texts, first, index = (np.frombuffer(shards.column(c)[0].as_py(), t) for c, t in (("place", np.int32), ("texts", np.int64), ("first", np.int64), ("index", np.int32)))
        start, n, h = (np.asarray(levels.column(c)).astype(np.int64) for c in ("start", "n", "h"))
        shared = np.zeros(len(place), np.uint8)
        order = np.argsort(h, kind="stable")
        shared[places(start[order], (start + n)[order])] = np.repeat(h[order], n[order])
        by_place = np.empty(len(place), np.uint8)
        by_place[place] = shared
        some = np.flatnonzero(np.maximum.reduceat(by_place, first[:-1]))
        cut = [slice(first[i], first[i + 1]) for i in some]
        out.append(batch_of(SHARED, text_id=texts[some], index=[index[s].tobytes() for s in cut], shared=[by_place[s].tobytes() for s in cut]))
    return pa.Table.from_batches(out, schema=SHARED)


def row_segments(cuts: bytes, index: bytes | None, shared: bytes | None, copied: bool, c: Cutting) -> tuple[np.ndarray, Segments]:
    """The text's cuts, and its windows' segments; all windows of a text with copies are repeated."""
    line = np.frombuffer(cuts, np.int32).astype(np.int64)
    own = np.zeros(len(line) - 1, np.int64)
    if index:
        own[np.frombuffer(index, np.int32)] = np.frombuffer(shared, np.uint8)
    s = segments(line, own, c)
    if copied:
        s = s._replace(full=np.ones(len(s.full), bool), open=np.zeros(len(s.open), bool))
    return line, s


CANDIDATES = pa.schema([("text_id", pa.int64()), ("cores", pa.list_(pa.int64()))])


def margin_spans(cuts: np.ndarray, s: Segments, c: Cutting) -> np.ndarray:
    """Begin and end of the bytes that all windows with the cuts of these segments have in common, wherever they occur."""
    return np.stack((cuts[s.a] - c.reach, cuts[s.b] + c.reach + c.gram))


def core_keys(symbols: bytes, s: Segments, which: np.ndarray) -> np.ndarray:
    """A hash of the phrases between the cuts of these segments' windows."""
    return span_hashes(np.frombuffer(symbols, np.uint64), s.a[which], s.b[which]).view(np.int64)


def candidates(c: Cutting):
    """Texts that have repeated windows, or open ones with the keys of the phrases within them; and those with copies, whose windows others may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cores = [], []
            for r in batch.to_pylist():
                _, s = row_segments(r["cuts"], r["index"], r["shared"], r["copied"], c)
                if s.full.any() or s.open.any():
                    ids.append(r["text_id"])
                    cores.append(np.unique(core_keys(r["symbols"], s, s.open)).tolist())
            yield batch_of(CANDIDATES, text_id=ids, cores=cores)

    return run


MARGINS = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("asked", pa.bool_())])


def passes(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = keys & (len(bits) * 8 - 1)
    return bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0


def in_question(batch: pa.RecordBatch, c: Cutting, cores: np.ndarray) -> Iterator[tuple]:
    """(ids, data, offsets, text, Segments, place of the segments' text in data, margin keys) of a batch's segments that are open or lone, or that an open one may equal."""
    rows = batch.select(["text_id", "symbols", "cuts", "index", "shared", "copied"]).to_pylist()
    for lo, hi, data, offsets in slices(batch.column("text")):
        text, found, keys = [], [], []
        for i in range(hi - lo):
            r = rows[lo + i]
            line, s = row_segments(r["cuts"], r["index"], r["shared"], r["copied"], c)
            which = np.flatnonzero((s.b > s.a) & (s.full | s.open))
            which = np.concatenate((which[passes(core_keys(r["symbols"], s, which), cores)], np.flatnonzero(s.lone)))
            which.sort()
            text.append(np.full(len(which), i))
            found.append(Segments(*(x[which] for x in s)))
            keys.append(margin_spans(line, found[-1], c) + offsets[i])
        spans = np.concatenate(keys, axis=1)
        yield np.array([r["text_id"] for r in rows[lo:hi]], np.int64), data, offsets, np.concatenate(text), Segments(*(np.concatenate(x) for x in zip(*found, strict=True))), span_hashes(BYTES[0][data], spans[0], spans[1]).view(np.int64)


def margins(c: Cutting, sieve):
    """Of the segments in question, how many have the same margins, and whether one of them isn't known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cores = np.frombuffer(sieve.value, np.uint8)
        for batch in batches:
            for *_, s, keys in in_question(batch, c, cores):
                h, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
                asked = np.zeros(len(h), bool)
                np.logical_or.at(asked, inverse, ~s.full)
                yield batch_of(MARGINS, h=h, n=n, asked=asked)

    return run


def windows(c: Cutting, sieve, margin_sieve):
    """Rows of `window_rows` for the windows of segments whose margins others have, asked for where they aren't known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cores, bits = np.frombuffer(sieve.value, np.uint8), np.frombuffer(margin_sieve.value, np.uint8)
        for batch in batches:
            for ids, data, offsets, text, s, keys in in_question(batch, c, cores):
                which = np.flatnonzero(passes(keys, bits))
                size = s.end[which] - s.begin[which]
                owner = np.repeat(text[which], size)
                at = places(s.begin[which], s.end[which]) + offsets[owner]
                yield window_rows(WINDOWS, ids, owner, at, np.repeat(~s.full[which], size), data, offsets, c.length)

    return run


FOUND = pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string())])
FOUND_DDL = "key binary, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string"


def removed(c: Cutting):
    """The maximal runs of bytes in repeated windows of each text, and what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = batch.drop_columns(["text"]).to_pylist(), []
            for lo, hi, data, offsets in slices(batch.column("text")):
                for r, a, b in zip(rows[lo:hi], offsets[:-1], offsets[1:], strict=True):
                    _, s = row_segments(r["cuts"], r["index"], r["shared"], False, c)
                    change = np.zeros(b - a + 1, np.int32)
                    np.add.at(change, s.begin[s.full], 1)
                    np.add.at(change, s.end[s.full] + c.length - 1, -1)
                    np.add.at(change, np.array([x["at"] for x in r["found"] or []], np.int64), 1)
                    np.add.at(change, np.array([x["end"] for x in r["found"] or []], np.int64) + c.length - 1, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
                    starts, ends = np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist()
                    if starts:
                        kept = hashlib.sha256(data[a:b][~gone].tobytes()).hexdigest()
                        out.append((r["key"], int(gone.sum()), [{"start": x, "end": y} for x, y in zip(starts, ends, strict=True)], kept))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield batch_of(FOUND, **dict(zip(FOUND.names, columns, strict=True)))

    return run


def repeated_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """id_col, n_bytes, n_removed, spans (start, end of the maximal runs that go, ascending) and kept_sha256 (of the bytes that stay) of each row of docs.

    A byte goes if it lies in a string of `length` bytes that also starts at another place, in the same text or another;
    strings are taken as they are in the input, and overlapping ones count. Texts are UTF-8 bytes, so that a run may cut a
    character. A null text counts as empty; of equal texts, rows that repeat an id among them, all bytes go if there are
    `length`. Texts shorter than `length` stay as they are. Other columns are ignored; an empty table gives no rows.
    shard_symbols: fewer make more shards, for tests.

    Equal texts are worked on once. Windows are told apart by 128 bits, phrases by 64.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    c = cutting(length)
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = plain.withColumn("key", F.unhex(F.sha2("text", 256))).withColumn("n_bytes", F.octet_length("text").cast("long"))
    ids = saved(keyed.select("id", "key", "n_bytes"), "text-keys")
    copied = saved(ids.filter(F.col("n_bytes") >= length).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "text-copies")
    maybe = sieved(keyed.filter(F.col("n_bytes") >= length).select("key", "text"), "key", copied)
    again = maybe.filter("_maybe").select("key", "text").groupBy("key").agg(F.first("text").alias("text")).join(copied.withColumn("copied", F.lit(True)), "key", "left")
    once = maybe.filter("not _maybe").select("key", "text", F.lit(False).alias("copied")).unionByName(again.withColumn("copied", F.coalesce("copied", F.lit(False))).select("key", "text", "copied"))
    texts = saved(once.withColumn("text_id", F.monotonically_increasing_id()), "texts")

    cut = saved(texts.select("text_id", "text").mapInArrow(phrases(c), PHRASES_DDL), "phrases")
    strings = cut.filter("symbols is not null").select("text_id", "symbols", "cuts")
    symbols = saved(strings.select("symbols").mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"), "symbols")
    sieve = sieve_of(spark, symbols)
    numbered = strings.withColumn("part", F.spark_partition_id().cast("long"))
    shards = saved(numbered.mapInArrow(sharded(c, sieve, shard_symbols), SHARDS_DDL), "shards")
    levels = merged(shards, c)
    places_of = shards.select("shard", "place", "texts", "first", "index")
    shared = saved(places_of.groupBy("shard").cogroup(levels.groupBy("shard")).applyInArrow(common_prefixes, SHARED_DDL), "prefixes")

    flags = texts.select("text_id", "copied")
    known = strings.join(shared, "text_id").join(flags, "text_id")
    some = saved(known.mapInArrow(candidates(c), "text_id long, cores array<long>"), "candidates")
    cores = sieve_of(spark, some.select(F.explode("cores").alias("h")))
    # What equals a window without a cut of its own, or with just one, is such a window too.
    bare = saved(met_windows(cut.filter("at is not null or n is not null")), "bare-windows")
    alone = cut.filter("margin is not null").select("text_id", F.col("margin").alias("h"))
    paired = alone.join(alone.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "h", "left_semi")
    wanted = saved(some.select("text_id").union(bare.select("text_id")).union(paired.select("text_id")).distinct(), "wanted")
    work = saved(among(texts, "text_id", wanted).join(strings, "text_id").join(shared, "text_id", "left"), "work")
    discard(texts, cut, shards, shared, symbols)
    pairs = work.mapInArrow(margins(c, cores), "h long, n long, asked boolean").groupBy("h").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    margin_sieve = sieve_of(spark, pairs.filter("n > 1 and asked").select("h"))
    found = saved(work.mapInArrow(windows(c, cores, margin_sieve), WINDOWS_DDL), "windows")
    found = saved(bare.unionByName(met_windows(found)).groupBy("text_id").agg(F.collect_list(F.struct("at", "end")).alias("found")), "found")
    gone = saved(work.filter("not copied").join(found, "text_id", "left").select("key", "text", "cuts", "index", "shared", "found").mapInArrow(removed(c), FOUND_DDL), "removed")
    discard(work, found, bare, some, wanted)
    nothing = F.array().cast("array<struct<start:long,end:long>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    rows = ids.join(copied.withColumn("copied", F.lit(True)), "key", "left").join(gone, "key", "left")
    return rows.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copied"), whole).otherwise(F.coalesce("spans", nothing)).alias("spans"),
        F.when(F.col("copied"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("key")))).alias("kept_sha256"),
    )


def met_windows(rows: DataFrame) -> DataFrame:
    """text_id and ranges (at, end) of places of the windows asked for that at least two places have, from rows of `window_rows`."""
    hashed = rows.filter("h is not null")
    twice = hashed.groupBy("h", "g").agg(F.sum("n").alias("n"), F.max(F.col("at").isNotNull()).alias("asked")).filter("n > 1 and asked").select("h", "g")
    far = hashed.filter("at is not null").join(twice, ["h", "g"], "left_semi").select("text_id", "at", (F.col("at") + 1).alias("end"))
    return rows.filter("end is not null").select("text_id", "at", "end").unionByName(far)
