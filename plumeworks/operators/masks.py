"""Synthetic gaps of rasters: regions that grow from the edges, the same for a record on any machine."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Least and most hidden share, chance to go on at a region's border, the edge's weights, and how a record's random numbers are seeded.
HIDDEN = (0.01, 0.15)
BORDER = 0.94
EDGE_REACH, EDGE_FLOOR = 2.5, 0.06
SEED_BYTES, SEED_ORDER = 8, "little"

#: Masks that grow side by side.
TOGETHER = 1024


def stream(identifier: str, seed: int) -> np.random.Generator:
    """A record's own random numbers, from the first bytes of SHA-256 of seed:identifier."""
    return np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{identifier}".encode()).digest()[:SEED_BYTES], SEED_ORDER))


def edge_weights(rows: int, cols: int) -> np.ndarray:
    r, c = np.mgrid[:rows, :cols]
    return (np.exp(-np.minimum(np.minimum(r, rows - 1 - r), np.minimum(c, cols - 1 - c)) / EDGE_REACH) + EDGE_FLOOR).ravel()


def neighbours(rows: int, cols: int) -> np.ndarray:
    """Of each cell the eight around it, row by row; rows * cols where there is none."""
    r, c = np.divmod(np.arange(rows * cols), cols)
    out = []
    for dr in (-1, 0, 1):
        for dc in (-1, 0, 1):
            if dr or dc:
                inside = (r + dr >= 0) & (r + dr < rows) & (c + dc >= 0) & (c + dc < cols)
                out.append(np.where(inside, (r + dr) * cols + c + dc, rows * cols))
    return np.stack(out, axis=1)


def drawn(weights: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A column of each row by its weights: the first whose running sum is above u times the row's sum."""
    total = weights.cumsum(axis=1)
    return (total > total[:, -1:] * u[:, None]).argmax(axis=1)


def grown(identifiers: Sequence[str], seed: int, rows: int, cols: int) -> np.ndarray:
    """A row of rows * cols cells for each identifier, 1 where its raster stays visible and 0 where it is hidden.

    A mask hides a share of its cells, one by one. Mostly the next is drawn from the border of
    what is hidden, by the edge's weight and the square of one more than the number of its hidden
    neighbours, the border's cells standing in the order in which they first met a hidden one; else from
    all visible cells by the edge's weight. All masks take their steps together, each by its own
    random numbers, so that a mask is the same alone and among others.
    """
    n, size = len(identifiers), rows * cols
    edge, around = edge_weights(rows, cols), neighbours(rows, cols)
    edge, around = np.append(edge, 0.0), np.vstack((around, np.full(8, size)))
    left, draws = np.zeros(n, int), []
    for i, x in enumerate(identifiers):
        rng = stream(x, seed)
        left[i] = max(1, round(rng.uniform(*HIDDEN) * size))
        draws.append(rng.random(2 * left[i]))
    # Masks with more cells to hide come first, so that those at work are always the first ones.
    order = np.argsort(-left, kind="stable")
    most = int(left.max(initial=0))
    numbers = np.zeros((n, 2 * most))
    for i, k in enumerate(order.tolist()):
        numbers[i, : len(draws[k])] = draws[k]
    working = n - np.searchsorted(np.sort(left), np.arange(most), side="right")
    # One cell more takes what falls outside the raster. A border cell keeps its place after it is hidden, with weight 0.
    hidden, beside, place = np.zeros((n, size + 1), bool), np.zeros((n, size + 1), np.int32), np.zeros((n, size + 1), np.int32)
    hidden[:, size] = True
    cells, weight = np.zeros((n, size), np.int32), np.zeros((n, size))
    met, waiting, used = np.zeros(n, int), np.zeros(n, int), np.zeros(n, int)
    for k in working.tolist():
        at = np.arange(k)
        near = waiting[:k] > 0
        used_before = used[:k].copy()
        used[:k] += near
        near &= numbers[at, used_before] < BORDER
        u = numbers[at, used[:k]]
        used[:k] += 1
        far = np.flatnonzero(~near)
        cell = np.zeros(k, int)
        if len(far) < k:
            cell = cells[at, drawn(weight[:k, : met[:k].max()], u)]
        if len(far):
            cell[far] = drawn(edge[:size] * ~hidden[far, :size], u[far])
        known = beside[at, cell] > 0
        waiting[:k] -= known
        weight[at[known], place[at[known], cell[known]]] = 0.0
        hidden[at, cell] = True
        other = around[cell]
        row, col = np.nonzero(~hidden[at[:, None], other])
        other = other[row, col]
        count = beside[row, other] + 1
        beside[row, other] = count
        new = count == 1
        fresh, first = row[new], other[new]
        n_new = np.bincount(fresh, minlength=k)
        to = met[fresh] + np.arange(len(fresh)) - (n_new.cumsum() - n_new)[fresh]
        place[fresh, first], cells[fresh, to] = to, first
        met[:k] += n_new
        waiting[:k] += n_new
        weight[row, place[row, other]] = edge[other] * (1.0 + count) ** 2
    visible = np.empty((n, size), np.int32)
    visible[order] = ~hidden[:, :size]
    return visible


def visible_mask(identifier: Column, seed: int, rows: int, cols: int) -> Column:
    """An array of rows * cols cells, 1 where a record's raster stays visible; null for a null identifier. Masks of an Arrow batch grow together."""

    @F.arrow_udf("array<int>")
    def masks(ids: pa.Array) -> pa.Array:
        names = ids.to_pylist()
        known = [i for i, x in enumerate(names) if x is not None]
        cells = [grown([names[i] for i in known[k : k + TOGETHER]], seed, rows, cols) for k in range(0, len(known), TOGETHER)]
        size = np.zeros(len(names) + 1, np.int32)
        size[np.array(known, int) + 1] = rows * cols
        flat = pa.array(np.concatenate(cells).ravel() if cells else np.zeros(0, np.int32), pa.int32())
        return pa.ListArray.from_arrays(pa.array(np.cumsum(size, dtype=np.int32)), flat, mask=ids.is_null())

    return masks(identifier.cast("string"))
