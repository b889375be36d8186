"""Language identification by string kernels: n-gram presence, Nyström landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_rows
from .textnum import slices

#: Lengths of the byte n-grams in the blended spectrum, and hash cells for them.
GRAMS = (1, 2, 3)
CELLS = 1 << 15
#: Labelled texts for each language that the classifier is fitted on: the least by a hash of their id.
SAMPLE = 600
LANDMARKS = 60
RIDGE = 1e-2
#: Texts in one matrix product.
ROWS = 256

#: A-Z in lower case; ASCII that isn't a letter as a space.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x cells: 1 where the text has an n-gram of the cell."""
    texts = len(offsets) - 1
    out = np.zeros((texts, CELLS), np.uint8)
    codes = _FOLD[data].astype(np.uint32)
    row = np.repeat(np.arange(texts, dtype=np.int64) * CELLS, np.diff(offsets))
    code = np.zeros(len(codes), np.uint32)
    for n in GRAMS:
        m = len(codes) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint32(256) + codes[n - 1 :]
        x = (code + np.uint32(n << 24)) * np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA77)
        cell = x >> np.uint32(32 - 15)
        inside = row[:m] == row[n - 1 :]
        out.reshape(-1)[(row[:m] + cell)[inside]] = 1
    return out


def blocks(data: np.ndarray, offsets: np.ndarray):
    """(first text, presence rows of unit length, number of n-grams) of up to ROWS texts at a time."""
    for lo in range(0, len(offsets) - 1, ROWS):
        part = offsets[lo : lo + ROWS + 1]
        x = presence(data[part[0] : part[-1]], part - part[0])
        norm = np.sqrt(np.maximum(1, x.sum(axis=1, dtype=np.int64)))
        yield lo, x, norm.astype(np.float32)


def fit(texts: Sequence[str], labels: Sequence[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """The languages, and for each cell the weight of each language.

    Scores are linear in the kernel's values at the landmarks, and these in the
    presence of n-grams, so that both fold into one matrix.
    """
    names = sorted(set(labels))
    if not names:
        return [], np.zeros((CELLS, 0), np.float32)
    y = np.array([[1.0 if l == n else -1.0 for n in names] for l in labels])
    chosen = [i for n in names for i in [j for j, l in enumerate(labels) if l == n][:landmarks]]

    def rows(which):
        for _, _, data, offsets in slices(pa.array([texts[i] for i in which], pa.large_string())):
            for _, x, norm in blocks(data, offsets):
                yield x.astype(np.float32) / norm[:, None]

    marks = np.concatenate(list(rows(chosen)))
    k_mm = marks @ marks.T
    k_nm = np.concatenate([x @ marks.T for x in rows(range(len(texts)))])
    values, vectors = np.linalg.eigh(k_mm.astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # K_mm^(-1/2)
    phi = k_nm @ root
    weights = np.linalg.solve(phi.T @ phi + ridge * len(texts) * np.eye(phi.shape[1]) / phi.shape[1], phi.T @ y)
    return names, (marks.T @ (root @ weights)).astype(np.float32)


def sampled(docs: DataFrame, train: Column, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[list[str], list[str]]:
    """Up to `sample` labelled texts of each label, by a hash of the id."""
    rows = docs.filter(train & F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col).alias("order"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # a row for each language
    if not counts:
        return [], []
    share = F.coalesce(*(F.when(F.col("label") == n, F.lit(min(1.0, 2 * sample / c))) for n, c in counts.items()))
    few = rows.filter((F.col("order") / F.lit(2.0**64) + 0.5) < share)
    from pyspark.sql import Window

    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("order", "text"))).filter(F.col("rank") <= sample)
    got = few.orderBy("label", "rank").select("label", "text").collect()
    return [r["text"] for r in got], [r["label"] for r in got]


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE, carry: Sequence[str] = ()) -> DataFrame:
    """The language of every text, learned from the labels of the rows with crc32(id as text) mod 4 other than 2.

    Returns one row per row of docs: id_col, the columns named in carry (which may be any of
    docs but those below), held_out (the remainder is 2), lang_pred, score (0 to 1).
    lang_pred is `und` with score 0 where the text is null, empty or has no
    letter, and for all rows if there is no labelled text. Rows with a null
    id are not held out and not learned from. Labels are used as they
    are; null labels aren't learned from. An empty table gives no rows.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    rest = F.crc32(F.col(id_col).cast("string")) % 4
    names, weights = fit(*sampled(docs, rest != 2, id_col, text_col, label_col, sample))
    model = spark.sparkContext.broadcast(weights.tobytes())
    source = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias("_id"), F.coalesce(rest == 2, F.lit(False)).alias("held_out"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(carry)))
    kept = [f for f in source.schema.fields if f.name != "_text"]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        w = np.frombuffer(model.value, np.float32).reshape(CELLS, len(names))
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("_text")):
                lang, score = [], []
                for first, x, norm in blocks(data, offsets):
                    f = (x.astype(np.float32) @ w) / norm[:, None]
                    best = f.argmax(axis=1) if names else np.zeros(len(f), int)
                    for i in range(len(f)):
                        a, b = offsets[first + i], offsets[first + i + 1]
                        text = data[a:b]
                        ascii_letters = ((text | 0x20) - 0x61 < 26).any()
                        if not names or not (ascii_letters or any(c.isalpha() for c in text.tobytes().decode("utf-8", "replace"))):
                            lang.append("und")
                            score.append(0.0)
                        else:
                            lang.append(names[best[i]])
                            score.append(min(1.0, max(0.0, (float(f[i, best[i]]) + 1) / 2)))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(lo, hi - lo) for f in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*(f.name for f in kept), "lang_pred", "score"])

    out = source.mapInArrow(run, schema)
    return out.select(F.col("_id").alias(id_col), *(F.col(f"_{i}").alias(c) for i, c in enumerate(carry)), "held_out", "lang_pred", "score")
