"""Registered queries on readers and writers, characteristics, inference and diagnostics, each with the SQL that gives the same rows."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import times
from ..operators import aoi, metrics, normalization
from ..operators.sequence import CLASSES
from ..sources import ingest
from ..tables import run_folder
from . import storage, work
from .queries import MEM, facilities, query, rounded, table

# --- areas and their characteristics ---------------------------------------------------------------


@query(f"WITH {MEM} SELECT aoi_id, round(max(sqrt(pow(f.x - a.x, 2) + pow(f.y - a.y, 2)) / 1000), 6) AS max_member_km FROM mem JOIN fac f USING (facility_id) JOIN fac a ON a.facility_id = aoi_id GROUP BY 1")
def member_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facilities(spark, sf_dir)
    return rounded(aoi.geographic_characteristics(f, f.withColumnRenamed("facility_id", "aoi_id")))



@query("""
WITH p AS (SELECT c_custkey % 700 AS aoi_id, CASE WHEN c_custkey % 13 > 0 THEN -120 + (c_custkey % 350) / 10.0::DOUBLE END AS lon, CASE WHEN c_custkey % 17 > 0 THEN 26 + (c_custkey % 220) / 10.0::DOUBLE END AS lat FROM customer)
SELECT aoi_id, round(min(struct_pack(a := lon, b := lat)).a, 6) AS lon, round(min(struct_pack(a := lon, b := lat)).b, 6) AS lat FROM p WHERE lon IS NOT NULL AND lat IS NOT NULL GROUP BY 1""")
def facility_aois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One AOI for each facility with a place; their projection is in `albers_forward`."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select((k % 700).alias("facility_id"), F.when(k % 13 > 0, -120 + k % 350 / 10.0).alias("lon"), F.when(k % 17 > 0, 26 + k % 220 / 10.0).alias("lat"))
    return rounded(aoi.build_aois(rows).select("aoi_id", "lon", "lat"))


@query("""
WITH c AS (SELECT user_id % 2 = 0 AS selected, value * (user_id % 7 + 1) - 50 AS raw FROM events),
v AS (SELECT selected, raw, log10(1 + greatest(raw, 0)) AS v FROM c), l AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM v),
m AS (SELECT selected, round(median(raw), 6) AS median FROM c GROUP BY 1)
SELECT selected, least(floor((v - lo) / (hi - lo) * 30), 29)::INT AS bin, count(*) AS n, any_value(median) AS median FROM v JOIN m USING (selected), l WHERE v BETWEEN lo AND hi GROUP BY ALL""")
def cohort_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    rows = table(spark, sf_dir, "events").select((u % 2 == 0).alias("selected"), (F.col("value") * (u % 7 + 1) - 50).alias("raw_value"))
    counts, medians = metrics.cohort_histogram(rows, "raw_value", "selected", log=True)
    return counts.join(medians.select("selected", F.round("median", 6).alias("median")), "selected").select("selected", "bin", "n", "median")


_LABEL = "CASE WHEN event_id % 10 < 2 THEN 'decrease' WHEN event_id % 10 < 7 THEN 'steady' ELSE 'increase' END"


@query(f"""
WITH f AS (SELECT ['train', 'val', 'test'][(user_id % 3)::INT + 1] AS split, {_LABEL} AS label, event_id % 4 > 0 OR {_LABEL} = 'steady' AS kept FROM events),
n AS (SELECT split, label, count(*) AS eligible, count(*) FILTER (kept) AS balanced FROM f GROUP BY ALL)
SELECT split, label, eligible, balanced, round(eligible / sum(eligible) OVER (PARTITION BY split), 6) AS eligible_share, round(balanced / sum(balanced) OVER (PARTITION BY split), 6) AS balanced_share FROM n""")
def class_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 10
    label = F.when(k < 2, CLASSES[0]).when(k < 7, CLASSES[1]).otherwise(CLASSES[2])
    split = F.array(*map(F.lit, ("train", "val", "test")))[(F.col("user_id") % 3).cast("int")]
    rows = table(spark, sf_dir, "events").select("event_id", split.alias("split"), label.alias("label"))
    return rounded(metrics.class_shares(rows, rows.filter("event_id % 4 > 0 or label = 'steady'"), "label", ["split"]))


@query("""
WITH l AS (SELECT greatest(abs(quantile_cont(value - 90, 0.01)), abs(quantile_cont(value - 90, 0.99))) AS lim FROM events)
SELECT event_type, least(floor((value - 90 + lim) / (2 * lim) * 70), 69)::INT AS bin, count(*) AS n FROM events, l WHERE abs(value - 90) <= lim GROUP BY ALL""")
def balance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") - 90).alias("innovation"))
    return metrics.balance_histogram(rows, "innovation", ["event_type"]).select("event_type", "bin", "n")


# --- inference -------------------------------------------------------------------------------------


def _weight(*at: int) -> float:
    """Given weights, as a training would leave them."""
    return round(math.sin(sum(a * b for a, b in zip(at, (1.7, 0.9, 0.4), strict=False)) + 0.3), 4)


def _layer(k: int, inputs: int, outputs: int) -> dict:
    return {"weight": [[_weight(k, i, j) for j in range(inputs)] for i in range(outputs)], "bias": [_weight(k + 5, i) for i in range(outputs)], "gain": [1 + _weight(k + 9, i) / 4 for i in range(outputs)], "shift": [_weight(k + 13, i) / 4 for i in range(outputs)]}


#: 4 features, 16 and 8 hidden units, 3 classes.
LAYERS = [_layer(0, 4, 16), _layer(1, 16, 8), _layer(2, 8, 3)]


def _mlp_sql(source: str) -> str:
    out, last = "", source
    dot = lambda w, b: f"list_dot_product(x, {w}::DOUBLE[]) + {b!r}"
    for k, layer in enumerate(LAYERS):
        out += f", z{k} AS (SELECT event_id, vision, [{', '.join(dot(w, b) for w, b in zip(layer['weight'], layer['bias'], strict=True))}] AS z FROM {last})"
        if k < len(LAYERS) - 1:
            out += f", m{k} AS (SELECT *, list_avg(z) AS mean, list_avg(list_transform(z, lambda v: pow(v - list_avg(z), 2))) AS var FROM z{k})"
            out += f", n{k} AS (SELECT event_id, vision, list_transform(list_zip(z, {layer['gain']}::DOUBLE[], {layer['shift']}::DOUBLE[]), lambda v: (v[1] - mean) / sqrt(var + 1e-5) * v[2] + v[3]) AS y FROM m{k})"
            out += f", x{k} AS (SELECT event_id, vision, list_transform(y, lambda v: v / (1 + exp(-v))) AS x FROM n{k})"
            last = f"x{k}"
    return out


@query(f"""
WITH s AS (SELECT event_id, value, epoch_us(ts) + ((event_id % 360) - 180) * 240000000 AS us FROM events),
p AS (SELECT event_id, value, make_timestamp(us) AS t, (us % 86400000000) / 1000000.0 AS sec FROM s),
a AS (SELECT event_id, value, 2 * pi() * sec / 86400 AS d, 2 * pi() * (dayofyear(t) - 1 + sec / 86400) / CASE WHEN year(t) % 4 = 0 AND (year(t) % 100 <> 0 OR year(t) % 400 = 0) THEN 366 ELSE 365 END AS y FROM p),
f AS (SELECT event_id, [sin(d), cos(d), sin(y), cos(y)]::DOUBLE[] AS x, [(value % 3) - 1, (value % 5) / 5, (value % 7) / 7]::DOUBLE[] AS vision FROM a)
{_mlp_sql("f")},
o AS (SELECT event_id, list_transform(list_zip(z, vision), lambda v: v[1] + v[2]) AS l FROM z2),
e AS (SELECT event_id, list_transform(l, lambda v: exp(v - list_max(l))) AS e FROM o)
SELECT event_id, round(e[1] / list_sum(e), 6) AS p0, round(e[2] / list_sum(e), 6) AS p1, round(e[3] / list_sum(e), 6) AS p2, (list_position(e, list_max(e)) - 1)::INT AS predicted FROM e""")
def fused_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class probabilities from the logits of images and those of the frozen seasonal perceptron."""
    v = F.col("value")
    phases = times.seasonal_phases(F.col("ts"), (F.col("event_id") % 360 - 180).cast("double"))
    rows = table(spark, sf_dir, "events").select("event_id", F.array(v % 3 - 1, v % 5 / 5, v % 7 / 7).alias("vision"), *phases)
    logits = normalization.fused_logits(normalization.seasonal_mlp(F.array("day_sin", "day_cos", "year_sin", "year_cos"), LAYERS), F.col("vision"))
    rows = rows.select("event_id", logits.alias("logits")).withColumn("p", normalization.softmax(F.col("logits")))
    return rounded(rows.select("event_id", *(F.col("p")[i].alias(f"p{i}") for i in range(3)), normalization.argmax(F.col("logits")).alias("predicted")))


@query("SELECT event_type, round(sum(abs(value - 80) * (event_id % 3 > 0)::INT) / sum((event_id % 3 > 0)::INT), 6) AS l1, round(avg(log10(1 + value)), 6) AS magnitude FROM events GROUP BY 1")
def masked_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = (F.col("event_id") % 3 > 0).cast("int")
    return rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(normalization.masked_l1(F.col("value"), F.lit(80.0), mask).alias("l1"), F.avg(normalization.log_scale(F.col("value"))).alias("magnitude")))


# --- readers, writers and shards -------------------------------------------------------------------


@query("SELECT event_type AS split, ((event_id + 1) * 7 - 1) // (SELECT count(*) FROM events) AS shard, count(*) AS n FROM events GROUP BY ALL")
def even_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in seven shards of consecutive places, as even as it goes."""
    e = table(spark, sf_dir, "events")
    placed = work.numbered(e.select("event_id", "event_type"), ["event_id"])
    return placed.groupBy(F.col("event_type").alias("split"), work.even_shards(F.col("place"), F.lit(e.count()), 7).alias("shard")).agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type, CASE WHEN event_id % 9 > 0 THEN round(value, 6) END AS value, CASE WHEN event_id % 4 > 0 THEN concat('[', event_id % 4, ',', user_id, ']') ELSE '[]' END AS paths, NULL::VARCHAR AS note FROM events")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a list column written as CSV and read by a declared schema: a column that the file lacks is null, and so is what can't be cast."""
    path = f"{run_folder(spark)}/csv-{uuid.uuid4().hex}"
    k = F.col("event_id")
    value = F.when(k % 9 > 0, F.round("value", 6).cast("string")).otherwise("none")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", value.alias("value"), F.when(k % 4 > 0, F.array(k % 4, F.col("user_id"))).alias("paths"))
    storage.write_csv(rows, path)
    kind = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("paths", T.StringType()), T.StructField("note", T.StringType())])
    return ingest.read_csv(spark, path, kind, ("event_id", "paths"))


@query("SELECT year(ts)::INT AS year, month(ts)::INT AS month, count(*) AS n, round(sum(CASE WHEN event_id % 2 = 0 AND month(ts) = 1 THEN value + 1 ELSE value END), 4) AS value FROM events WHERE NOT (month(ts) = 1 AND event_id % 2 = 1) GROUP BY ALL")
def partition_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by year and month, of which January is written again with other rows: the other months stay. Read by a schema, and two columns of it."""
    path = f"{run_folder(spark)}/months-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select("event_id", "value", F.year("ts").alias("year"), F.month("ts").alias("month"))
    storage.write_partitions(rows, path, ["year", "month"], ["event_id"])
    storage.write_partitions(rows.filter("month = 1 and event_id % 2 = 0").withColumn("value", F.col("value") + 1), path, ["year", "month"], ["event_id"])
    kind = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType())])
    read = ingest.read_table(spark, path, kind, ["value", "year", "month"])
    return read.groupBy("year", "month").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
