"""Concatenate and cut: documents' tokens in a row, cut into windows of a fixed length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_rows, saved
from .textnum import U64, slices, span_hashes

SEQUENCE = 2048
END_ID = 1
#: Distinct pieces whose ids a worker remembers; when full it starts anew.
CACHE_PIECES = 300_000
#: Partitions whose offsets are sent to every task; beyond, they are joined.
BROADCAST_PARTITIONS = 200_000

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0
#: The endings that the pre-tokeniser splits off after an apostrophe. Fixed values.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def raw_bytes() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable ones stand for themselves, the others are numbered from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Pieces:
    """Token ids of many texts at once: they are split into the pre-tokeniser's pieces by numpy, and each distinct piece is encoded once.

    It gives the same ids as encoding text by text, which texts with the name of a special token still take.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The same vocabulary for a library that is faster with short pieces: its ids are in the order of its merges.
        raw = raw_bytes()
        ranks = {bytes(raw[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in self.special}
        self.encoding = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        self.kinds = np.zeros(0x110000, np.uint8)
        text = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(pattern, text):
                a, b = (x + (0x800 if x >= 0xD800 else 0) for x in m.span())
                self.kinds[a:b] = kind
        self.forget()

    def forget(self) -> None:
        """Known pieces: sorted hashes, and where each one's ids begin and end in `ids`."""
        self.known, self.begin, self.end = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16)

    def learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        made = [self.encoding.encode_ordinary(x) for x in pieces]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        ends = len(self.ids) + np.cumsum(sizes)
        self.ids = np.concatenate((self.ids, np.fromiter((i for ids in made for i in ids), np.uint16, int(sizes.sum()))))
        hashes, begin, end = (np.concatenate(x) for x in ((self.known, hashes), (self.begin, ends - sizes), (self.end, ends)))
        order = np.argsort(hashes)
        self.known, self.begin, self.end = hashes[order], begin[order], end[order]

    def cuts(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin. points: the texts' code points in a row, a text beginning at each of offsets."""
        n = len(points)
        kind = self.kinds[points]
        begins = np.ones(n, bool)
        begins[1:] = kind[1:] != kind[:-1]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        begins |= first[:n]
        last = first[1:].copy()  # of its text
        space = kind == _SPACE
        # The last white space before something else is a piece of its own, or begins the next piece if it is U+0020.
        before = np.zeros(n, bool)
        before[:-1] = space[:-1] & ~space[1:] & ~last[:-1]
        begins |= before
        lead = before & (points == 0x20)
        joined = np.zeros(n, bool)
        joined[1:] = lead[:-1]
        begins &= ~joined
        # An apostrophe alone, not led by a space, takes one of the endings with it.
        mark = np.flatnonzero((points == 0x27) & begins)
        mark = mark[mark + 1 < n]
        mark = mark[~first[mark + 1] & (kind[mark + 1] == _LETTER)]
        for p in mark:
            tail = "".join(map(chr, points[p + 1 : p + 3][: 1 if p + 2 >= n or first[p + 2] else 2]))
            size = next((len(e) for e in ENDINGS if tail.startswith(e)), 0)
            if size:
                begins[p + 1] = False
                if p + 1 + size < n:
                    begins[p + 1 + size] = True
        return np.flatnonzero(begins)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of each text's."""
        texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(texts, np.int64)
        lead = (data & 0xC0) != 0x80  # the first byte of each code point
        place = np.zeros(len(data) + 1, np.int64)
        np.cumsum(lead, out=place[1:])
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        starts = self.cuts(points, place[offsets[:-1]][offsets[:-1] < len(data)])
        at = np.flatnonzero(lead)[starts]  # in bytes
        ends = np.append(at[1:], len(data))
        hashes = span_hashes(data, at, ends)
        distinct, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > CACHE_PIECES:
            self.forget()
        new = np.flatnonzero(~np.isin(distinct, self.known, assume_unique=True))
        raw = data.tobytes()
        self.learn(distinct[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[index[new]].tolist(), ends[index[new]].tolist(), strict=True)])
        slot = np.searchsorted(self.known, distinct)[inverse]
        begin, each = self.begin[slot], (self.end - self.begin)[slot]
        out = np.concatenate(([0], np.cumsum(each)))
        ids = self.ids[np.repeat(begin - out[:-1], each) + np.arange(out[-1])]
        first = np.searchsorted(at, offsets)
        return ids, np.diff(out[first])

    def each(self, data: np.ndarray, offsets: np.ndarray):
        """The ids of each text."""
        raw = data.tobytes()
        odd = any(s.encode() in raw for s in self.special)
        ids, counts = self.encode(data, offsets)
        ends = np.cumsum(counts)
        for i, (end, count) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
            if odd and any(s.encode() in raw[offsets[i] : offsets[i + 1]] for s in self.special):
                yield np.array(self.tokenizer.encode(raw[offsets[i] : offsets[i + 1]].decode(), add_special_tokens=False).ids, np.uint16)
            else:
                yield ids[end - count : end]


def tokenized(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """part, start (tokens before in the partition), id, n, ids (16 bits each) of each row."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType()), source.schema["id"], T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        part, total, pieces = TaskContext.get().partitionId(), 0, Pieces(tokenizer)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                ids = [x.tobytes() + np.uint16(end_id).tobytes() for x in pieces.each(data, offsets)]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
                starts = total + np.cumsum(sizes) - sizes
                total += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, part, np.int32)), pa.array(starts), batch.column("id").slice(lo, hi - lo), pa.array(sizes), pa.array(ids, pa.binary())], ["part", "start", "id", "n", "ids"])

    return source.mapInArrow(run, schema)


PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The documents' tokens, concatenated and cut into sequences of `length`; only the last may be shorter.

    Returns one row per piece of a document in a sequence: id_col, start,
    length, ids_crc32, doc_tokens, sequence_id, offset, and the ids on
    request. Each text is followed by end_id, so that a null or empty text is one piece of one token.
    Rows with the same or a null id are packed one by one. An empty
    table gives no rows. Other columns are ignored. The order is the order
    of the partitions and of the rows in them.

    The first pass tokenises and sums each partition's tokens; prefix sums over
    these totals give every partition's place; the second pass cuts each document where
    a window ends. No token is shuffled.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    tokens = saved(tokenized(docs, tokenizer, id_col, text_col, end_id), "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))  # a row for each partition
    bases = saved(totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base")), "bases")
    based = tokens.join(F.broadcast(bases) if bases.count() <= BROADCAST_PARTITIONS else bases, "part").select("id", (F.col("base") + F.col("start")).alias("at"), "n", "ids")
    kinds = [based.schema["id"], *(T.StructField(c, T.LongType()) for c in PIECE), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])]

    def cut(batches):
        for batch in batches:
            at, n = (np.asarray(batch.column(c)) for c in ("at", "n"))
            pieces = (at + n - 1) // length - at // length + 1
            doc = np.repeat(np.arange(len(at)), pieces)
            sequence = at[doc] // length + np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.maximum(sequence * length, at[doc]) - at[doc]
            size = np.minimum((sequence + 1) * length, at[doc] + n[doc]) - at[doc] - start
            raw = batch.column("ids")
            parts = [np.frombuffer(raw[d].as_buffer(), np.uint16)[s : s + z] for d, s, z in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)]
            crc = [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
            columns = [batch.column("id").take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(sequence), pa.array(at[doc] + start - sequence * length)]
            if with_ids:
                columns.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["id", *PIECE, *(["ids"] if with_ids else [])])

    return based.mapInArrow(cut, T.StructType(kinds)).withColumnRenamed("id", id_col)
