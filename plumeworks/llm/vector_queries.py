"""The query op13_vector_codes and its SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vector_codes


def digest(books: list) -> str:
    """SHA-256 of all components by part, entry and place within the part."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), carry=("label",))
    two = lambda x: F.lower(F.lpad(F.hex(x.cast("long")), 2, "0"))
    labels = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    found = codes.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return found.select("vec_id", F.array_join(F.transform("code", two), "").alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _rounds(rounds: int, parts: int, entries: int, scale: int) -> str:
    """The rounds as common table expressions: a<i> are the assignments to the codebooks b<i>, of which b0 is the first."""
    text = f"""
WITH v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS r, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, part, x[part * len(x) // {parts} + 1:(part + 1) * len(x) // {parts}] AS x FROM v, range({parts}) t(part)),
b0 AS (SELECT part, r - 1 AS entry, x FROM p WHERE r <= {entries})"""
    for i in range(rounds + 1):
        text += f""",
a{i} AS (SELECT r, part, min(struct_pack(d := list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, entry := entry)) AS m FROM p JOIN b{i} b USING (part) GROUP BY r, part)"""
        if i < rounds:
            text += f""",
s{i} AS (SELECT part, entry, j, sum(y) AS s, count(*) AS n FROM (SELECT part, m.entry AS entry, unnest(range(len(x))) AS j, unnest(x) AS y FROM a{i} JOIN p USING (r, part)) GROUP BY ALL),
n{i} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x FROM s{i} GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.x, b.x) AS x FROM b{i} b LEFT JOIN n{i} n USING (part, entry))"""
    return text


def oracle(rounds: int = vector_codes.ROUNDS, parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, scale: int = vector_codes.SCALE) -> str:
    return _rounds(rounds, parts, entries, scale) + f""",
c AS (SELECT r, string_agg(lower(printf('%02x', m.entry)), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (r), h"""


QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLES = {"op13_vector_codes": oracle()}
