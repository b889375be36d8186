"""Product codes of vectors: a codebook for each part of a vector, refined in rounds, each vector coded by its nearest entries.

Every round broadcasts a kd-tree of each codebook. Tasks find each part's nearest entry by
branch and bound and send integer sums of the parts by entry, so that a codebook doesn't depend
on how rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_rows, saved

#: Parts of a vector, entries of a codebook, rounds of refinement and the scale of the integers.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a tree's leaf: a leaf's distances are one matrix product, which costs less than the visits that smaller leaves would need.
LEAF = 64
#: Integer components up to this size have exact squared distances in doubles, and up to LARGEST in 64 bits.
EXACT, LARGEST = 1 << 22, 1 << 28


@dataclass
class Node:
    """Entries of a codebook within a box; index has their places in the codebook, ascending."""

    index: np.ndarray
    entries: np.ndarray
    low: np.ndarray
    high: np.ndarray
    axis: int = 0
    split: int = 0
    children: list[Node] = field(default_factory=list)


def tree_of(entries: np.ndarray, index: np.ndarray | None = None) -> Node:
    """The kd-tree of a codebook (entries x components): the widest axis is cut at its median."""
    index = np.arange(len(entries)) if index is None else index
    own = entries[index]
    node = Node(index, own, own.min(axis=0), own.max(axis=0))
    if len(index) > LEAF and own.shape[1]:
        node.axis = int((node.high - node.low).argmax())
        line = own[:, node.axis]
        node.split = int(np.sort(line)[(len(line) - 1) // 2])
        left = line <= node.split
        if not left.all():
            node.children = [tree_of(entries, index[left]), tree_of(entries, index[~left])]
    return node


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each point from each entry."""
    if max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0)) <= EXACT and points.shape[1] <= 64:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)[None, :]).astype(np.int64)
    return sum(((points[:, d, None] - entries[None, :, d]) ** 2 for d in range(points.shape[1])), np.zeros((len(points), len(entries)), np.int64))


def nearest(tree: Node, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each point's nearest entry, the lower index of equally near ones.

    All points go down the tree together, each first to its own side. The other side is visited by
    those whose distance from its box isn't greater than the best so far: an equal one may hold a lower index.
    """
    best, at = np.full(len(points), np.iinfo(np.int64).max), np.zeros(len(points), np.int64)

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        own = points[rows]
        outside = np.maximum(np.maximum(node.low - own, own - node.high), 0)
        near = (outside * outside).sum(axis=1) <= best[rows]
        rows, own = rows[near], own[near]
        if not node.children:
            if len(rows):
                found = distances(own, node.entries)
                first = found.argmin(axis=1)
                least, index = found[np.arange(len(rows)), first], node.index[first]
                better = (least < best[rows]) | ((least == best[rows]) & (index < at[rows]))
                best[rows[better]], at[rows[better]] = least[better], index[better]
            return
        left = own[:, node.axis] <= node.split
        visit(node.children[0], rows[left])
        visit(node.children[1], rows[~left])
        visit(node.children[1], rows[left])
        visit(node.children[0], rows[~left])

    visit(tree, np.arange(len(points)))
    return at, best


def whole(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, integers): the vectors of `size` components without a null or a component that isn't finite, in SCALE-ths rounded down."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), size), False))
    rows = np.flatnonzero(fits)
    flat = pc.list_flatten(column.filter(pa.array(fits)))
    values = np.asarray(pc.fill_null(flat.cast(pa.float64()), float("nan"))).reshape(len(rows), size)
    sound = np.isfinite(values).all(axis=1)
    scaled = np.floor(values[sound] * SCALE)
    if np.abs(scaled).max(initial=0) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // SCALE}: squared distances wouldn't be exact")
    return rows[sound], scaled.astype(np.int64)


def cuts_of(size: int, parts: int) -> list[int]:
    return [size * i // parts for i in range(parts + 1)]


def first_codebooks(source: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """Each part of the vectors with the least ids, nulls last; of one id the lesser vector first. [] if no vector is whole."""
    plain = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    least = source.filter(F.col("vector").isNotNull() & plain).orderBy(*order).select("vector")
    rows = least.limit(entries).collect()
    if not rows:
        return []
    size = len(rows[0][0])
    if any(len(r[0]) != size for r in rows):
        rows = least.filter(F.size("vector") == size).limit(entries).collect()
    vectors = np.floor(np.array([r[0] for r in rows], np.float64).reshape(len(rows), size) * SCALE).astype(np.int64)
    cuts = cuts_of(size, parts)
    return [vectors[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


SUMS = "part int, entry int, n long, sums array<long>"


def refined(source: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each entry is the mean, rounded down, of the parts nearest to it; one that no part is nearest to stays."""
    spark = source.sparkSession
    trees = spark.sparkContext.broadcast([tree_of(b) for b in books])
    cuts = np.cumsum([0, *(b.shape[1] for b in books)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            _, vectors = whole(batch.column("vector"), int(cuts[-1]))
            for p, tree in enumerate(trees.value):
                points = vectors[:, cuts[p] : cuts[p + 1]]
                at, _ = nearest(tree, points)
                np.add.at(sums[p], at, points)
                counts[p] += np.bincount(at, minlength=len(counts[p]))
        out = [(p, int(i), int(counts[p][i]), sums[p][i].tolist()) for p in range(len(books)) for i in np.flatnonzero(counts[p])]
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["part", "entry", "n", "sums"])

    by_task = source.select("vector").mapInArrow(run, SUMS)
    by_place = by_task.select("part", "entry", "n", F.posexplode_outer("sums").alias("place", "x")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    new = [b.copy() for b in books]
    for r in by_place.collect():  # parts x entries x components at most
        if r["place"] is not None:
            new[r["part"]][r["entry"], r["place"]] = r["x"] // r["n"]
    trees.destroy()
    return new


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, carry: tuple[str, ...] = ()) -> tuple[DataFrame, list[np.ndarray]]:
    """(codes, codebooks): id_col, the columns of `carry`, code (array of entry indexes, one for each part) and error (squared
    distances from these entries, summed) of every whole vector; and each part's codebook of integers, entries x components.

    Left out are vectors that are null or hold a null or a component that isn't finite, and those whose length isn't
    that of the whole vector with the least id. A length that isn't a multiple of `parts` is cut as evenly as it goes.
    Components become SCALE-ths, rounded down; one beyond LARGEST / SCALE in size raises an error. A codebook begins with the vectors
    of the least ids, null ids last, fewer than `entries` if there are fewer; rows that repeat an id or a vector count as often
    as they occur. Of equally near entries the lower index is taken. An empty table gives no rows and no codebooks.
    """
    spark = vectors.sparkSession
    arrow_rows(spark)
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"))
    books = first_codebooks(source, parts, entries)
    schema = T.StructType([source.schema["id"], source.schema["carried"], T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    if not books:
        coded = spark.createDataFrame([], schema)
    else:
        for _ in range(rounds):
            books = refined(source, books)
        trees = spark.sparkContext.broadcast([tree_of(b) for b in books])
        cuts = np.cumsum([0, *(b.shape[1] for b in books)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, points = whole(batch.column("vector"), int(cuts[-1]))
                found = [nearest(tree, points[:, cuts[p] : cuts[p + 1]]) for p, tree in enumerate(trees.value)]
                code = np.stack([at for at, _ in found], axis=1).astype(np.int32)
                error = np.sum([d for _, d in found], axis=0).astype(np.int64)
                kept = pa.array(rows)
                ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(found))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(kept), batch.column("carried").take(kept), pa.ListArray.from_arrays(ends, pa.array(code.reshape(-1))), pa.array(error)], ["id", "carried", "code", "error"])

        coded = source.mapInArrow(run, schema)
    return saved(coded, "codes").select(F.col("id").alias(id_col), *(F.col(f"carried.{c}").alias(c) for c in carry), "code", "error"), books
