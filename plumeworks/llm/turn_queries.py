"""The query op12_turn_repair and its SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import turn_repair

DIGEST = "audit string, repaired_sha256 string"


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of conversations with the damage that a checksum of conversation and turn chooses. Nulls become one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))), F.lit(20))
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def digests(schema: T.StructType):
    """Audit and SHA-256 of each conversation whose pieces come in order; texts pass by one piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, sha, out = object(), [], None, []

        def close() -> None:
            if sha is not None:
                out.append({"conv_id": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()})

        for batch in batches:
            for r in batch.to_pylist():
                if r["conv_id"] != conv:
                    close()
                    conv, audit, sha, empty = r["conv_id"], [], hashlib.sha256(), True
                audit.append(r["audit"])
                for line in r["lines"]:
                    sha.update((("" if empty else "\n") + line["role"] + ":" + line["text"]).encode())
                    empty = False
            yield pa.RecordBatch.from_pylist(out, schema=turn_repair.arrow(schema))
            out.clear()
        close()
        yield pa.RecordBatch.from_pylist(out, schema=turn_repair.arrow(schema))

    return run


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    conversations, pieces = turn_repair.repair(damaged(table))
    schema = T.StructType([pieces.schema["conv_id"], *T._parse_datatype_string(DIGEST).fields])
    line = lambda x: F.concat(x["role"], F.lit(":"), x["text"])
    whole = pieces.filter("whole").select("conv_id", "audit", F.sha2(F.array_join(F.transform("lines", line), "\n"), 256).alias("repaired_sha256"))
    # A digest can't be put together from those of parts: a conversation in pieces passes through one task, as a stream.
    parts = pieces.filter("not whole").select("conv_id", "part", "no", "audit", "lines").repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    found = whole.unionByName(parts.select("conv_id", "audit", "lines").mapInArrow(digests(schema), schema))
    key = F.col("conv_id")
    ids, found, totals = table.select(key).distinct(), found.withColumnRenamed("conv_id", "_a"), conversations.withColumnRenamed("conv_id", "_b")
    joined = ids.join(totals, key.eqNullSafe(F.col("_b")), "left").join(found, key.eqNullSafe(F.col("_a")), "left")
    count = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *count, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


_INITIAL = "substr(role, 1, 1)"


def _kept(state: str, initial: str) -> str:
    """The ways to keep turn i with a role of this initial, after state `^`, s, u or a of the turns before it."""
    name = {"u": "user", "a": "assistant"}.get(initial, "")
    own = f"(CASE WHEN {_INITIAL} = '{initial}' THEN 0 ELSE 1 END + CASE WHEN fault = 't' THEN 5 ELSE 0 END)"
    n = turn_repair.BETWEEN[state, initial]
    letter = f"CASE WHEN {_INITIAL} = '{initial}' THEN 'K' ELSE 'R' END"
    line = f"CASE WHEN {_INITIAL} = '{initial}' THEN role ELSE '{name}' END || ':' || text"
    other = "user" if initial == "a" else "assistant"
    before = {"^": "p", "s": "s", "u": "u", "a": "a"}[state]
    inserted = f"'{'I' * n}' || "
    lines = f"list_concat(r.{before}.t, [{f"'{other}:', " * n}{line}])"
    return f"struct_pack(c := r.{before}.c + {5 * n} + {own}, a := r.{before}.a || {inserted}{letter}, t := {lines})"


def _state(initial: str) -> str:
    froms = [s for s in turn_repair.STATES if (s, initial) in turn_repair.BETWEEN]
    can = "fault NOT IN ('b', 'd')" + (f" AND {_INITIAL} = 's'" if initial == "s" else "")
    gone = f"struct_pack(c := r.{initial}.c + 2, a := r.{initial}.a || 'D', t := r.{initial}.t)"
    return f"CASE WHEN {can} THEN list_min([{gone}, {', '.join(_kept(s, initial) for s in froms)}]) ELSE {gone} END"


_NEVER = "struct_pack(c := 1000000000000::BIGINT, a := '', t := []::VARCHAR[])"
_START = "struct_pack(c := 0::BIGINT, a := '', t := []::VARCHAR[])"

ORACLE = rf"""
WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
k AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, len(s) + 1), lambda j: list_concat([ascii(s[j])::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 20 AS kind FROM h),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '-' END AS fault, {_INITIAL} AS initial, lag({_INITIAL}) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
r AS (SELECT DISTINCT conv_id, n, 0::BIGINT AS i, {_START} AS p, {_NEVER} AS s, {_NEVER} AS u, {_NEVER} AS a FROM f
  UNION ALL
  SELECT r.conv_id, r.n, f.i, struct_pack(c := r.p.c + 2, a := r.p.a || 'D', t := r.p.t), {_state("s")}, {_state("u")}, {_state("a")}
  FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1),
e AS (SELECT conv_id, list_min([p, struct_pack(c := s.c + 10, a := s.a || 'II', t := list_concat(s.t, ['user:', 'assistant:'])), struct_pack(c := u.c + 5, a := u.a || 'I', t := list_append(u.t, 'assistant:')), a]) AS m FROM r WHERE i = n)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(m.c, 0) AS cost,
  coalesce(m.a, '') AS audit, sha256(coalesce(array_to_string(m.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""

QUERIES = {"op12_turn_repair": op12_turn_repair}
ORACLES = {"op12_turn_repair": ORACLE}
