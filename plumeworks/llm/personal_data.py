"""Personal data by patterns, and by a skip-chain conditional random field on top.

The field's nodes are tokens with digits or an @. Neighbours in the text share a
chain potential, and repeated or similar tokens anywhere in the document a skip
potential. Loopy message passing carries the labels that patterns found to the
tokens' other occurrences.
"""

from __future__ import annotations

import re
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_rows, least_hashed
from .textnum import slices

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1
#: Documents that may hold a base span, by LIKELY, that the field is trained on: the least by a hash of id and text.
SAMPLE = 1500
LIKELY = r"@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){13}|\+[0-9][ ().0-9-]{8}"
ROUNDS, DAMPING = 10, 0.3
#: Least belief in a label for a token that no pattern found.
BELIEF = 0.9
#: Log potential of one label at both ends of a skip edge: the consistency that is enforced, as patterns' labels can't teach it.
CONSISTENCY = 6.0
#: Digits that a token without an @ needs for skip edges.
SKIP_DIGITS = 7

# The patterns of the contract, written so that long runs cost linear time: the look-behind and the
# possessive repeats change no match, as a match never begins or ends inside a run of digits.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_EDGE = "\"'()[]{}<>,;:!?.-"


def emails(text: str) -> list[tuple[int, int]]:
    out, at, done = [], text.find("@"), 0
    runs = {m.end(): m.start() for m in _LOCAL.finditer(text)} if at >= 0 else {}
    while at >= 0:
        start = max(runs.get(at, at), done)
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


class Nodes:
    """Candidate tokens of some texts: position, label (-1 where no pattern found it), features, and edges."""

    def __init__(self):
        self.doc, self.start, self.end, self.label, self.x = [], [], [], [], []
        self.chain, self.skip = [], []

    def add(self, doc: int, text: str, base: list[tuple[int, int, int]]) -> None:
        seen: dict[str, int] = {}
        at, before = 0, None
        for number, m in enumerate(_TOKEN.finditer(text)):
            raw = m[0]
            if raw.isalpha():
                continue
            core = raw.strip(_EDGE)
            digits = "".join(c for c in core if "0" <= c <= "9")
            if not core or not (digits or "@" in core):
                continue
            a = m.start() + raw.index(core)
            b = a + len(core)
            while at < len(base) and base[at][2] <= a:
                at += 1
            label = next((k + 1 for s, k, e in takewhile(lambda x: x[0] < b, islice(base, at, None)) if a < e), 0)
            i = len(self.doc)
            self.doc.append(doc)
            self.start.append(a)
            self.end.append(b)
            self.label.append(label)
            self.x.append((1.0, "@" in core, raw[:1] == "+" or core[:1] == "+", len(digits) >= 4, len(digits) >= 7, len(digits) >= 10, len(digits) >= 14, core.count(".") == 3, core.count(".") in (1, 2), "-" in core, len(digits) < len(core) / 2, "(" in raw))
            if before is not None and before[1] == number - 1:
                self.chain.append((before[0], i))
            before = (i, number)
            key = core.lower() if "@" in core else digits.lstrip("0") if len(digits) >= SKIP_DIGITS else ""
            if key:
                if key in seen:
                    self.skip.append((seen[key], i))  # a chain through the occurrences, so that they need no pairs
                seen[key] = i

    def arrays(self):
        pairs = lambda e: np.array(e, np.int64).reshape(-1, 2)
        return np.array(self.label, np.int64), np.array(self.x, np.float64).reshape(-1, 12), pairs(self.chain), pairs(self.skip)


def trained(nodes: Nodes) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Node weights by softmax regression on the patterns' labels; chain potentials as smoothed log odds of label pairs; skip potentials.

    Tokens without a label that repeat a labelled one are left out of the regression.
    """
    labels, x, chain, _ = nodes.arrays()
    if not (labels > 0).any():
        return None
    clear = (labels > 0) | ~carried(nodes).any(axis=1)
    y, x = labels[clear], x[clear]
    w = np.zeros((x.shape[1], LABELS))
    target = np.eye(LABELS)[y]
    for _ in range(300):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w += 0.5 * (x.T @ (target - p) / len(x) - 1e-4 * w)

    def odds(pairs: np.ndarray) -> np.ndarray:
        n = np.ones((LABELS, LABELS)) + 2 * np.eye(LABELS)
        np.add.at(n, (labels[pairs[:, 0]], labels[pairs[:, 1]]), 1)
        share = n / n.sum()
        return np.log(share / (share.sum(axis=1, keepdims=True) * share.sum(axis=0, keepdims=True)))

    return w, np.clip(odds(chain), -3, 3), CONSISTENCY * np.eye(LABELS)


def beliefs(nodes: Nodes, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Nodes x labels after message passing over all texts' graphs at once."""
    y, x, chain, skip = nodes.arrays()
    w, chain_psi, skip_psi = model
    phi = x @ w
    phi -= phi.max(axis=1, keepdims=True)
    phi[y > 0] = -20.0  # what a pattern found is given
    phi[y > 0, y[y > 0]] = 0.0
    source = np.concatenate((chain[:, 0], skip[:, 0], chain[:, 1], skip[:, 1]))
    target = np.concatenate((chain[:, 1], skip[:, 1], chain[:, 0], skip[:, 0]))
    half = len(source) // 2
    psi = np.concatenate((np.repeat(chain_psi[None], len(chain), 0), np.repeat(skip_psi[None], len(skip), 0), np.repeat(chain_psi.T[None], len(chain), 0), np.repeat(skip_psi.T[None], len(skip), 0)))
    back = np.concatenate((np.arange(half) + half, np.arange(half)))
    sent = np.zeros((len(source), LABELS))
    for _ in range(ROUNDS if half else 0):
        got = phi.copy()
        np.add.at(got, target, sent)
        z = (got[source] - sent[back])[:, :, None] + psi
        top = z.max(axis=1)
        new = top + np.log(np.exp(z - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        sent = DAMPING * sent + (1 - DAMPING) * new
    got = phi.copy()
    np.add.at(got, target, sent)
    p = np.exp(got - got.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def carried(nodes: Nodes) -> np.ndarray:
    """Nodes x labels: whether a pattern found that label in an occurrence that skip edges lead to."""
    y, _, _, skip = nodes.arrays()
    has = np.zeros((len(y), LABELS), bool)
    has[np.flatnonzero(y > 0), y[y > 0]] = True
    for pairs in (skip, skip[::-1, ::-1]):  # edges run along each token's occurrences
        for a, b in pairs.tolist():
            has[b] |= has[a]
    return has


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("added", T.BooleanType())]))
ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())])


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in every text.

    Returns one row per row of docs: id_col and spans, an array of (kind, start, end
    exclusive in code points, added) by start, then kind as in KINDS. added: the field found it,
    not a pattern; such a span touches no pattern's span. A null or empty text has none. Rows that
    repeat an id are separate. An empty table gives no rows. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    some = least_hashed(source.filter(F.col("text").rlike(LIKELY)), SAMPLE, ("id", "text"), ("text",))
    nodes = Nodes()
    for i, r in enumerate(some):
        nodes.add(i, r[0], patterns(r[0]))
    sent = spark.sparkContext.broadcast(trained(nodes))
    schema = T.StructType([source.schema["id"], T.StructField("spans", SPAN)])

    def run(batches):
        model = sent.value
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                sign = ((data >= 0x30) & (data <= 0x39)) | (data == 0x40)
                total = np.concatenate(([0], np.cumsum(sign)))
                spans: list[list] = [[] for _ in range(hi - lo)]
                nodes = Nodes()
                for i in np.flatnonzero(total[offsets[1:]] > total[offsets[:-1]]).tolist():
                    text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                    base = patterns(text)
                    spans[i] = [(a, k, b, False) for a, k, b in base]
                    if base and model is not None:  # without a label to carry, nothing can be added
                        nodes.add(i, text, base)
                if nodes.skip:
                    p, has = beliefs(nodes, model), carried(nodes)
                    best = p.argmax(axis=1)
                    y = np.array(nodes.label)
                    for j in np.flatnonzero((y == 0) & (best > 0) & (p.max(axis=1) >= BELIEF)).tolist():
                        if has[j, best[j]]:
                            spans[nodes.doc[j]].append((nodes.start[j], int(best[j]) - 1, nodes.end[j], True))
                rows = [[{"kind": KINDS[k], "start": a, "end": b, "added": new} for a, k, b, new in sorted(s)] for s in spans]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(rows, pa.list_(ARROW_SPAN))], ["id", "spans"])

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
