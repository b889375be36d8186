"""The query op11_repeated_bytes and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeated_bytes


def op11_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_bytes.repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


#: Every window of 400 bytes as 800 hexadecimal digits.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, p, md5_number(substr(x, 2 * p + 1, 800)) AS h FROM (SELECT r, x, unnest(range(length(x) // 2 - 399)) AS p FROM d WHERE length(x) >= 800)),
m AS (SELECT r, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 400 THEN 0 ELSE 1 END AS new FROM m),
i AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS k FROM g),
s AS (SELECT r, k, min(p) AS a, max(p) + 400 AS b FROM i GROUP BY r, k),
b AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY r ORDER BY a) AS after FROM s),
k AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)) || CASE WHEN after IS NULL THEN substr(x, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept FROM b JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""

QUERIES = {"op11_repeated_bytes": op11_repeated_bytes}
ORACLES = {"op11_repeated_bytes": ORACLE}
