"""Registered queries on records: ingest, readiness, indexes, scans and footprints, model arrays and comparisons, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..operators import mapping, metrics, normalization, raster, splits
from ..sources import ingest, schemas
from . import storage, work
from .dataset_queries import IMAGES, PRED, images, pixels, predictions
from .queries import query, rounded, table

# --- ingest ----------------------------------------------------------------------------------------

_BOUND = {
    "facilityId": "user_id", "unitId": "CAST(event_id AS VARCHAR)", "date": "CAST(ts AS DATE)", "hour": "CAST(hour(ts) AS TINYINT)", "opTime": "(event_id % 5) / 4.0::DOUBLE", "noxMass": "value",
    "noxMassMeasureFlg": "event_type", "heatInput": "CASE WHEN event_id % 3 > 0 THEN value * 10 END",
}
_SQL_KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "date": "DATE", "tinyint": "TINYINT", "double": "DOUBLE"}


@query("SELECT " + ", ".join(f'{_BOUND.get(f.name, "NULL")}::{_SQL_KINDS[f.dataType.simpleString()]} AS "{f.name}"' for f in schemas.HOURLY) + " FROM events")
def hourly_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly unit records from text columns, in any order and with some missing, by the declared schema."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        "ts", F.col("event_type").alias("noxMassMeasureFlg"), F.col("event_id").cast("string").alias("unitId"), F.col("user_id").cast("string").alias("facilityId"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.hour("ts").cast("string").alias("hour"),
        ((F.col("event_id") % 5) / 4.0).alias("opTime"), F.col("value").cast("string").alias("noxMass"), F.when(F.col("event_id") % 3 > 0, (F.col("value") * 10).cast("string")).otherwise("n/a").alias("heatInput"),
    )
    return ingest.normalized(rows, schemas.HOURLY, schemas.HOURLY_REQUIRED)


@query("""
WITH l AS (SELECT user_id AS path, event_id AS place, event_id * 100 + user_id AS first, lead(event_id * 100 + user_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS last, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT path, ['u', 'v'][n] AS field, first, last FROM l WHERE n <= 2 AND path IN (SELECT path FROM l WHERE n = 2)""")
def byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as lines of a text index, the first two of which are wanted fields."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    n = F.row_number().over(w.orderBy("event_id"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("place"), n.alias("n"), F.count("*").over(w).alias("all")).filter("all > 1")
    name = F.when(F.col("n") == 1, "UGRD:10 m").when(F.col("n") == 2, "VGRD:10 m").otherwise("TMP:2 m")
    line = F.concat_ws(":", F.col("n").cast("string"), (F.col("place") * 100 + F.col("path")).cast("string"), name)
    return ingest.byte_ranges(rows.select("path", "place", line.alias("line")), {"u": "UGRD:10 m", "v": "VGRD:10 m"})


@query("SELECT event_id, date_trunc('hour', ts + INTERVAL 30 MINUTE)::TIMESTAMP AS weather_hour FROM events")
def nearest_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", times.nearest_hour(F.col("ts")).cast("timestamp_ntz").alias("weather_hour"))


@query("""
WITH w AS (SELECT DISTINCT year(ts)::INT AS year, month(ts)::INT AS month FROM events), p AS (SELECT DISTINCT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month FROM orders)
SELECT year, month FROM w WHERE (year, month) NOT IN (SELECT (year, month) FROM p)""")
def missing_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = lambda name, at: table(spark, sf_dir, name).select(F.year(at).alias("year"), F.month(at).alias("month"))
    return storage.missing_partitions(month("events", "ts"), month("orders", "o_orderdate"), ["year", "month"])


# --- plans -----------------------------------------------------------------------------------------


@query("""
SELECT event_id, sha256(concat('{"aoi":', user_id, ',"center":[', user_id % 90, '.5,', user_id % 40, '.25],"granules":["', least(a, b), '","', greatest(a, b), '"]}')) AS scan_key,
  sha256(concat('{"aoi":', user_id, ',"fields":["t","u","v"],"path":"', event_type, '"}')) AS weather_key
FROM (SELECT *, concat('g', event_id % 7) AS a, concat('g', 3 + event_id % 5) AS b FROM events)""")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    granules = F.array(F.concat(F.lit("g"), (e % 7).cast("string")), F.concat(F.lit("g"), (3 + e % 5).cast("string")))
    keys = work.scan_key(u, u % 90 + 0.5, u % 40 + 0.25, granules), work.weather_key(u, ["v", "t", "u"], F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", keys[0].alias("scan_key"), keys[1].alias("weather_key"))


@query("""
WITH n AS (SELECT user_id AS record, event_id % 500 AS key FROM events), o AS (SELECT k.range AS key, CASE WHEN k.range % 9 = 0 THEN concat('bad ', k.range) END AS error FROM range(480) k),
r AS (SELECT DISTINCT record, n.key, CASE WHEN o.key IS NULL THEN concat('missing ', n.key) ELSE error END AS reason FROM n LEFT JOIN o USING (key))
SELECT record, count(reason) = 0 AS ready, coalesce(string_agg(reason, '; ' ORDER BY key), '') AS error FROM r GROUP BY 1""")
def record_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    needs = table(spark, sf_dir, "events").select(F.col("user_id").alias("record"), (F.col("event_id") % 500).alias("key"))
    outcomes = spark.range(480).select(F.col("id").alias("key"), F.when(F.col("id") % 9 == 0, F.concat(F.lit("bad "), F.col("id").cast("string"))).alias("error"))
    return work.record_status(needs, outcomes, ["record"])


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'retryable' WHEN event_id % 5 = 0 THEN 'invalid' WHEN event_type = 'signup' THEN 'retryable' ELSE 'valid' END AS status FROM events""")
def discovery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of discovery, checked as a validity index where they are kept."""
    wrong = lambda kind: F.when(F.col("event_type") == kind, F.lit("failed"))
    status = work.discovery_status(wrong("error"), F.col("event_id") % 5 != 0, wrong("signup"))
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("string").alias("cache_key"), status.alias("status"), F.lit("t").alias("tempo_cache_path"), F.lit("w").alias("weather_cache_path"))
    kept = work.checked_index(rows.filter("status <> 'retryable'"))
    return kept.unionByName(rows.filter("status = 'retryable'")).select("event_id", "status")


@query("""
WITH w AS (SELECT * FROM (VALUES ('click', 5000), ('view', 10), ('none', 3)) AS t(split, target)), n AS (SELECT event_type AS split, count(*) AS found FROM events GROUP BY 1)
SELECT split, coalesce(found, 0)::BIGINT AS found, target::BIGINT AS target, greatest(0, target - coalesce(found, 0))::BIGINT AS shortfall FROM w LEFT JOIN n USING (split)""")
def split_shortfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.shortfalls(table(spark, sf_dir, "events").select(F.col("event_type").alias("split")), {"click": 5000, "view": 10, "none": 3})


_MISS = "round(pow(h{i} + n - t * {s}, 2) - pow(h{i} - t * {s}, 2), 12)"
_MISSES = ", ".join(f"CASE WHEN k - o.i + 1 = (u0 = 0)::INT + (u1 = 0)::INT + (u2 = 0)::INT AND u{i} > 0 THEN 'infinity'::DOUBLE ELSE {_MISS.format(i=i, s=s)} END AS c{i}" for i, s in enumerate(splits.SHARES))
_HASH = "('0x' || substr(sha256('42|' || cluster), 1, 15))::BIGINT"


@query(f"""
WITH RECURSIVE c AS (SELECT user_id % 40 AS cluster, count(*)::DOUBLE AS n FROM events GROUP BY 1),
o AS (SELECT cluster, n, row_number() OVER (ORDER BY n DESC, {_HASH}, cluster)::INT AS i, sum(n) OVER () AS t, count(*) OVER () AS k FROM c),
g AS (SELECT 0 AS i, 0::DOUBLE AS h0, 0::DOUBLE AS h1, 0::DOUBLE AS h2, 0 AS u0, 0 AS u1, 0 AS u2, NULL::BIGINT AS cluster, NULL::INT AS s
  UNION ALL SELECT i, h0 + n * (s = 0)::INT, h1 + n * (s = 1)::INT, h2 + n * (s = 2)::INT, u0 + (s = 0)::INT, u1 + (s = 1)::INT, u2 + (s = 2)::INT, cluster, s
  FROM (SELECT *, CASE WHEN c0 <= c1 AND c0 <= c2 THEN 0 WHEN c1 <= c2 THEN 1 ELSE 2 END AS s FROM (SELECT o.i, o.n, o.cluster, h0, h1, h2, u0, u1, u2, {_MISSES} FROM g JOIN o ON o.i = g.i + 1)))
SELECT cluster, ['train', 'val', 'test'][s + 1] AS split FROM g WHERE i > 0""")
def greedy_split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by the squared miss in records, not scaled."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("cluster"))
    return splits.greedy_splits(splits.cluster_counts(rows, "cluster", None, ()), "cluster", scaled=False)


# --- scans and rasters -----------------------------------------------------------------------------


@query("""
SELECT user_id AS aoi_id, event_type AS scan FROM events GROUP BY ALL HAVING count(*) FILTER (event_id % 13 = 0) = 0""")
def scans_without_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.groupBy(F.col("user_id").alias("aoi_id"), F.col("event_type").alias("scan")).agg(F.collect_list("event_id").alias("granules"))
    return mapping.without_failed(rows, e.filter("event_id % 13 = 0").select(F.col("event_id").alias("granule")), ["aoi_id", "scan"]).select("aoi_id", "scan")


@query("""
WITH b AS (SELECT c_custkey AS aoi_id, c_custkey % 9 + 0.2::DOUBLE AS x0, c_custkey % 9 + 1.4::DOUBLE AS x1, c_custkey % 6 + 0.1::DOUBLE AS y0, c_custkey % 6 + 0.9::DOUBLE AS y1 FROM customer),
f AS (SELECT i.range % 4 AS scan, i.range AS granule, (i.range * 7 % 10)::DOUBLE AS a0, (i.range * 7 % 10) + 1.5::DOUBLE AS a1, (i.range * 3 % 7)::DOUBLE AS b0, (i.range * 3 % 7) + 1.0::DOUBLE AS b1 FROM range(200) i),
p AS (SELECT aoi_id, scan, granule, x0, x1, y0, y1, a0, a1 FROM b JOIN f ON a0 < x1 AND a1 > x0 AND b0 - 1e-6 <= y0 AND b1 + 1e-6 >= y1),
cut AS (SELECT aoi_id, scan, count(DISTINCT granule) AS n, bool_or(a0 <= x0 AND a1 >= x0) AND bool_or(a0 <= x1 AND a1 >= x1) AND
  (bool_or(a0 <= x0 AND a1 >= x1) OR max(CASE WHEN a0 <= x0 THEN a1 END) >= min(CASE WHEN a1 >= x1 THEN a0 END)) AS covered FROM p GROUP BY ALL)
SELECT aoi_id, scan, n AS granules FROM cut WHERE covered""")
def covered_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes less high than a row of footprints, so that a scan covers one by a footprint over each end that meet."""
    c, i = F.col("c_custkey"), F.col("id")
    boxes = table(spark, sf_dir, "customer").select(c.alias("aoi_id"), (c % 9 + 0.2).alias("x0"), (c % 9 + 1.4).alias("x1"), (c % 6 + 0.1).alias("y0"), (c % 6 + 0.9).alias("y1"))
    a, b = (i * 7 % 10).cast("double"), (i * 3 % 7).cast("double")
    footprints = spark.range(200).select((i % 4).alias("scan"), i.alias("granule"), a.alias("a0"), (a + 1.5).alias("a1"), b.alias("b0"), (b + 1.0).alias("b1"))
    return mapping.covered_scans(boxes, footprints).select("aoi_id", "scan", F.size("granules").cast("long").alias("granules"))


@query("""
WITH p AS (SELECT vec_id % 5 AS key, embedding[1]::DOUBLE * 90000 AS bx0, embedding[1]::DOUBLE * 90000 + abs(embedding[3]::DOUBLE) * 20000 + 1000 AS bx1, embedding[2]::DOUBLE * 90000 AS by0, embedding[2]::DOUBLE * 90000 + abs(embedding[4]::DOUBLE) * 20000 + 1000 AS by1,
  embedding[5]::DOUBLE AS value, abs(embedding[6]::DOUBLE) <= 0.2 AND vec_id % 3 > 0 AS ok FROM embeddings),
k AS (SELECT DISTINCT key FROM p), c AS (SELECT key, r.r AS row, c.c AS col, -36000 + c.c * 3000.0 AS x0, -36000 + (c.c + 1) * 3000.0 AS x1, 36000 - r.r * 3000.0 AS y1, 36000 - (r.r + 1) * 3000.0 AS y0 FROM k, range(24) r(r), range(24) c(c)),
o AS (SELECT key, row, col, value, ok, greatest(0, least(bx1, x1) - greatest(bx0, x0)) * greatest(0, least(by1, y1) - greatest(by0, y0)) / 1e6 AS a FROM p JOIN c USING (key) WHERE bx1 > x0 AND bx0 < x1 AND by1 > y0 AND by0 < y1),
s AS (SELECT key, row, col, count(*) AS n, coalesce(sum(a) FILTER (ok), 0) AS w, sum(a * value) FILTER (ok) AS v FROM o WHERE a > 0 GROUP BY ALL)
SELECT key, row, col, coalesce(n, 0) AS native_count, round(coalesce(w, 0), 6) AS weight, CASE WHEN w >= 2 THEN round(v / w, 6) END AS value FROM c LEFT JOIN s USING (key, row, col)""")
def full_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regridded footprints on all cells, without a value where they cover less than 2 square kilometres."""
    p = pixels(spark, sf_dir)
    values = raster.tessellated(raster.touched_cells(p).withColumn("area", raster.rectangle_area()), ["key"])
    out = raster.full_grid(raster.cells(p.select("key", "x", "y").distinct()), values, ["key"], 2.0)
    out = out.select("key", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("native_count").cast("long").alias("native_count"), "weight", F.when(~F.isnan("value"), F.col("value")).alias("value"))
    return rounded(out)


# --- model arrays ----------------------------------------------------------------------------------

_GAPS = f"{IMAGES}, z AS (SELECT *, CASE WHEN value IS NULL THEN 0 ELSE greatest(-1, least(1, (value - 0.05) / 0.1)) END AS scaled FROM im)"


@query(f"""WITH {_GAPS} SELECT vec_id, round(sum(scaled), 6) AS scaled_sum, count(value) AS observed, count(value) = 64 AS complete,
  round(sum(CASE WHEN value IS NOT NULL THEN scaled ELSE greatest(-1, least(1, -scaled + pos / 100.0)) END), 6) AS kept_sum, round(sum(exp(-least(row, col, 7 - row, 7 - col) / 2.5) + 0.06), 6) AS edge_sum FROM z GROUP BY 1""")
def model_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of an image as a model takes and gives them: scaled with gaps at 0, their mask, and gaps filled by predictions."""
    rows = images(spark, sf_dir).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("value", F.lit(float("nan"))).alias("v"), "row", "col"))).alias("p"))
    x = F.transform("p", lambda p: p["v"])
    rows = rows.withColumns({"x": x, "scaled": normalization.normalized_array(x, F.lit(0.05), F.lit(0.1), 1.0), "mask": normalization.valid_mask(x)})
    rows = rows.withColumn("kept", normalization.kept_or_filled(F.col("scaled"), F.col("mask"), F.transform("scaled", lambda v, i: -v + i / 100.0), 1.0))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    edges = F.transform("p", lambda p: normalization.edge_weight(p["row"], p["col"], 8, 8))
    return rounded(rows.select("vec_id", total(F.col("scaled")).alias("scaled_sum"), F.aggregate("mask", F.lit(0).cast("long"), lambda a, b: a + b).alias("observed"), normalization.finite_raster(F.col("x"), 64).alias("complete"), total(F.col("kept")).alias("kept_sum"), total(edges).alias("edge_sum")))


@query(f"""WITH {PRED}, e AS (SELECT event_id, [exp((s0 - 30) / 10.0), exp((s1 - 30) / 10.0), exp((s2 - 30) / 10.0)] AS e, greatest(s0, s1, s2) AS top, s0, s1 FROM pred)
SELECT event_id, round(e[1] / list_sum(e), 6) AS p0, round(e[3] / list_sum(e), 6) AS p2, CASE WHEN s0 = top THEN 0 WHEN s1 = top THEN 1 ELSE 2 END AS best FROM e""")
def class_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.array(*((F.col(s) - 30) / 20.0 for s in ("s0", "s1", "s2")))
    rows = predictions(spark, sf_dir).withColumn("z", normalization.fused_logits(half, half))
    p = normalization.softmax(F.col("z"))
    return rounded(rows.select("event_id", p[0].alias("p0"), p[2].alias("p2"), normalization.argmax(F.col("z")).alias("best")))


# --- comparisons -----------------------------------------------------------------------------------


@query(f"""WITH {PRED}, m AS (SELECT event_id % 3 AS split, avg((truth = predicted)::INT) AS a, avg((truth = (predicted + 1) % 3)::INT) AS b FROM pred GROUP BY 1)
SELECT ['train', 'val', 'test'][split + 1] AS split, 'accuracy' AS metric, round(a, 6) AS first, round(b, 6) AS second FROM m""")
def models_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accuracy of two models on the same records, by split."""
    rows = predictions(spark, sf_dir).withColumn("split", F.array(*map(F.lit, splits.SPLITS))[(F.col("event_id") % 3).cast("int")])
    both = metrics.aligned(rows.select("event_id", "split", "truth", "predicted"), rows.select("event_id", "split", "truth", ((F.col("predicted") + 1) % 3).alias("predicted")), ["event_id", "split"])
    each = [both.groupBy("split").agg(F.avg((F.col("truth") == F.col(c)).cast("double")).alias("value")).select("split", F.lit(model).alias("model"), F.lit("accuracy").alias("metric"), "value") for model, c in (("first", "predicted_a"), ("second", "predicted_b"))]
    return rounded(metrics.compared(each[0].union(each[1]), ["first", "second"]))


@query("""
WITH l AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events)
SELECT event_type, least(greatest(floor((value - lo) / (hi - lo) * 70), 0), 69)::INT AS bin, count(*) AS n FROM events, l GROUP BY ALL""")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(table(spark, sf_dir, "events"), "value", 70, by=["event_type"])
