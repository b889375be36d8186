"""Registered queries on candidates, plans of records, granule metadata and publication, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import candidates, masks, metrics, zones
from ..operators.sequence import CLASSES
from ..operators.splits import SHARES
from ..sources import granules as files
from . import planning
from .dataset_queries import DRAW, HASH, PRED, _metrics_sql, predictions
from .queries import BOUNDS, MEM, ORACLES, REC, SEC, facilities, query, records, rounded, table

# --- granule metadata ------------------------------------------------------------------------------


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 2 THEN date_trunc('second', ts) END::TIMESTAMP AS utc,
  CASE WHEN event_id % 4 < 3 THEN concat('archive/', strftime(date_trunc('second', ts) - CASE WHEN event_id % 4 = 1 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END, '%Y/%m')) ELSE 'archive' END AS directory FROM events""")
def utc_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written with Z, with an offset, without a zone, and not at all."""
    e = F.col("event_id") % 4
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(e == 0, "Z").when(e == 1, "+02:00").otherwise(""))
    rows = table(spark, sf_dir, "events").withColumn("utc", files.parse_utc(F.when(e == 3, "no time").otherwise(text)))
    return rows.select("event_id", F.col("utc").cast("timestamp_ntz").alias("utc"), files.month_directory(F.lit("archive"), F.col("utc")).alias("directory"))


@query("""
WITH c AS (SELECT c_custkey AS k, -120 + c_custkey % 40 AS x, 25 + c_custkey % 20 AS y FROM customer)
SELECT k AS granule, (k % 30)::INT AS scan_num, CASE WHEN k % 3 = 0 THEN (k % 9)::INT ELSE (k % 7)::INT END AS granule_num, k % 5 = 4 AS failed,
  CASE WHEN k % 5 < 4 THEN concat(x, ' ', y, ',', x + 2, ' ', y, ',', x + 2, ' ', y + 1, ',', x, ' ', y) END AS footprint FROM c""")
def granule_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles in either order of their coordinates, or beside their bounds; numbers by attributes or by the name."""
    k = F.col("c_custkey")
    x, y = (-120 + k % 40).cast("int"), (25 + k % 20).cast("int")
    corner = lambda a, b: F.when(k % 5 < 2, F.concat_ws(" ", b.cast("string"), a.cast("string"))).otherwise(F.concat_ws(" ", a.cast("string"), b.cast("string")))
    text = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", corner(x, y), corner(x + 2, y), corner(x + 2, y + 1), corner(x, y)), F.lit("))"))
    number = lambda m, width: F.lpad((k % m).cast("string"), width, "0")
    off = F.when(k % 5 == 4, 0.5).otherwise(0.0005)
    # A small file is one task's: rows are dealt out, as a footprint costs far more than its row.
    rows = table(spark, sf_dir, "customer").repartition(spark.sparkContext.defaultParallelism).select(
        k.alias("granule"), text.alias("bounds_text"), (x + off).alias("lon_min"), (x + 2.0).alias("lon_max"), y.cast("double").alias("lat_min"), (y + 1.0).alias("lat_max"),
        F.when(k % 3 == 0, (k % 30).cast("string")).alias("scan"), F.when(k % 3 == 0, (k % 9).cast("string")).otherwise("none").alias("part"), F.concat(F.lit("X_S"), number(30, 3), F.lit("G"), number(7, 2), F.lit(".nc")).alias("name"),
    )
    scan, part = files.numbers(F.col("scan"), F.col("part"), F.col("name"))
    shape = F.array_join(F.transform("footprint", lambda p: F.concat_ws(" ", p["x"].cast("int").cast("string"), p["y"].cast("int").cast("string"))), ",")
    return files.footprints(rows).select("granule", scan.alias("scan_num"), part.alias("granule_num"), F.col("error").isNotNull().alias("failed"), shape.alias("footprint"))


@query("""
WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS lon, CASE WHEN vec_id % 11 > 0 THEN embedding[2]::DOUBLE END AS lat, CASE WHEN vec_id % 7 = 0 THEN 'nan'::DOUBLE ELSE embedding[3]::DOUBLE END AS corner, vec_id % 90 AS zenith FROM embeddings)
SELECT vec_id, vec_id % 5 = 0 AS gap FROM p WHERE lat IS NOT NULL AND NOT isnan(corner) AND zenith <= 70""")
def usable_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, at = F.col("vec_id"), lambda i: F.col("embedding")[i].cast("double")
    corner = F.when(v % 7 == 0, float("nan")).otherwise(at(2))
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(v % 5 > 0, at(4)).alias("value"), at(0).alias("lon"), F.when(v % 11 > 0, at(1)).alias("lat"), F.array(corner, at(2)).alias("corner_lon"), F.array(at(3), at(3)).alias("corner_lat"), at(5).alias("cloud"), (v % 2).alias("flag"), at(6).alias("uncertainty"), (v % 90).cast("double").alias("solar_zenith"),
    )
    return files.valid_pixels(rows, max_solar_zenith=70.0).select("vec_id", F.isnan("value").alias("gap"))


_RINGS = {"America/Los_Angeles": (-125, -114), "America/Denver": (-114, -102), "America/Chicago": (-102, -87), "America/New_York": (-87, -65)}


@query("""
WITH p AS (SELECT c_custkey, -120 + (c_custkey * 37 % 5000) / 100.0 AS lon FROM customer)
SELECT c_custkey AS facility_id, CASE WHEN lon < -114 THEN 'America/Los_Angeles' WHEN lon < -102 THEN 'America/Denver' WHEN lon < -87 THEN 'America/Chicago' ELSE 'America/New_York' END AS time_zone,
  CASE WHEN lon < -114 THEN -8 WHEN lon < -102 THEN -7 WHEN lon < -87 THEN -6 ELSE -5 END::TINYINT AS utc_standard_offset_hours FROM p""")
def facility_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facilities in four zones, whose rings are rectangles."""
    c = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(c.alias("facility_id"), (-120 + c * 37 % 5000 / 100.0).alias("lon"), (26 + c * 61 % 2200 / 100.0).alias("lat"))
    rings = spark.createDataFrame([(name, [(float(a), 20.0), (float(b), 20.0), (float(b), 55.0), (float(a), 55.0)]) for name, (a, b) in _RINGS.items()], "time_zone string, ring array<struct<x: double, y: double>>")
    return zones.with_zones(rows, rings).select("facility_id", "time_zone", "utc_standard_offset_hours")


# --- paths, dates and places -----------------------------------------------------------------------

_FILE = "concat(strftime({0}, 'raw/%Y/%m/%d/hrrr_%Y%m%d_%H'), 'z_wrfsfcf00_wind-temp-blh.grib2')"


@query(f"SELECT event_id, {_FILE.format('ts')} AS hour_path, {_FILE.format('ts + INTERVAL 30 MINUTE')} AS weather_path FROM events")
def weather_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", planning.hour_path(F.to_date(ts), F.hour(ts)).alias("hour_path"), planning.weather_path(ts).alias("weather_path"))


@query("""
WITH d AS (SELECT DISTINCT ts::DATE AS d FROM events WHERE month(ts) = 1 AND year(ts) = 2024 AND event_type = 'error' AND value > 120)
SELECT event_id FROM events WHERE ts::DATE IN (SELECT d FROM d) OR ts::DATE - 1 IN (SELECT d FROM d)""")
def granules_on_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on days with an error of a high value, or on the days after."""
    e = table(spark, sf_dir, "events").withColumns({"year": F.year("ts"), "month": F.month("ts")})
    return planning.granules_on(e, planning.scan_dates(e.filter("event_type = 'error' and value > 120"), 2024, 1, "ts"), "ts").select("event_id")


@query("""
WITH m AS (SELECT DISTINCT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month FROM orders)
SELECT year, month, ((row_number() OVER (ORDER BY year, month) - 1) % 7)::INT AS task FROM m""")
def month_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.month_owners(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")), 7)


@query("""
WITH r AS (SELECT event_id, user_id, date_trunc('hour', ts) AS h, 26 + (user_id * 61 % 2200) / 100.0 AS lat, -120 + (user_id * 37 % 5000) / 100.0 AS lon FROM events)
SELECT event_id, row_number() OVER (ORDER BY h, floor(lat), floor(lon), user_id, event_id) - 1 AS place FROM r""")
def locality_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("record_index"), u.alias("aoi_id"), F.date_trunc("hour", "ts").alias("emissions_hour_utc"), (26 + u * 61 % 2200 / 100.0).alias("lat"), (-120 + u * 37 % 5000 / 100.0).alias("lon"))
    return planning.by_locality(rows).select(F.col("record_index").alias("event_id"), F.col("place").cast("long").alias("place"))


# --- records and what they need --------------------------------------------------------------------


@query(f"""
SELECT user_id AS aoi_id, ts::DATE::VARCHAR AS scan_date, (event_id % 4)::INT AS scan_num, event_id, {_FILE.format('ts + INTERVAL 30 MINUTE')} AS weather_path FROM events WHERE user_id % 2 = 0
QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE, event_id % 4 ORDER BY ts, event_id) = 1""")
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of the AOIs that have a place, once for each scan."""
    e = table(spark, sf_dir, "events")
    seen = e.select(F.col("user_id").alias("aoi_id"), F.to_date("ts").alias("scan_date"), (F.col("event_id") % 4).cast("int").alias("scan_num"), F.col("ts").alias("tempo_time"), F.array(F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("granule_paths"), "event_id")
    places = e.filter("user_id % 2 = 0").select(F.col("user_id").alias("aoi_id"), F.lit(40.0).alias("lat"), F.lit(-100.0).alias("lon")).distinct()
    return planning.candidate_pool(seen, places).select("aoi_id", F.col("scan_date").cast("string").alias("scan_date"), "scan_num", "event_id", "weather_path")


def record_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of two steps; their scan paths depend on the user and the day, and some lack a list."""
    e, u = F.col("event_id"), F.col("user_id")
    day = F.date_format("ts", "yyyyMMdd")
    paths = lambda i: F.when(e % 17 == i, F.lit("[]")).when(e % 19 == i, F.lit(None)).otherwise(F.concat(F.lit('["g'), day, F.lit('_'), (e % 3 + i).cast("string"), F.lit('","f'), day, F.lit('"]')))
    columns = {f"no2_paths_t{i}": paths(i) for i in (0, 1)} | {f"weather_path_t{i}": F.when(e % 23 > 0, F.concat(F.lit(f"w{i}_"), day)) for i in (0, 1)}
    rows = table(spark, sf_dir, "events").select(F.lit("train").alias("split"), e.alias("record_index"), (u % 20).alias("aoi_id"), (u % 20 - 100.5).alias("lon"), (u % 20 + 25.25).alias("lat"), *(c.alias(n) for n, c in columns.items()))
    return planning.record_needs(rows, 2, "/archive/", ["t", "u", "v"])


_NEEDS = """
r AS (SELECT event_id AS id, user_id % 20 AS aoi, strftime(ts, '%Y%m%d') AS d, [0, 1] AS steps FROM events),
s AS (SELECT id, aoi, d, unnest(steps) AS i FROM r),
n AS (SELECT *, id % 17 = i OR id % 19 = i AS noscan, id % 23 = 0 AS noweather FROM s)"""


@query(f"""
WITH {_NEEDS}, e AS (SELECT id, i, 'scan' AS kind, concat('no scan paths at step ', i) AS error FROM n WHERE noscan UNION ALL SELECT id, i, 'weather', concat('no weather path at step ', i) FROM n WHERE noweather)
SELECT id AS record_index, error FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY i, kind) = 1""")
def unprepared_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.prepared(record_needs(spark, sf_dir))[1].select("record_index", "error")


@query(f"""
WITH {_NEEDS}, good AS (SELECT id FROM n GROUP BY 1 HAVING NOT bool_or(noscan OR noweather)),
k AS (SELECT DISTINCT aoi, ['/archive/f' || d, '/archive/g' || d || '_' || (id % 3 + i)] AS paths FROM n JOIN good USING (id))
SELECT aoi AS aoi_id, array_to_string(paths, '|') AS paths, count(*) OVER (PARTITION BY paths) AS batch_size FROM k""")
def scan_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans that no cache holds, with how many are made from the same files."""
    ready = planning.prepared(record_needs(spark, sf_dir))[0]
    return planning.source_batches(ready, ready.limit(0), "scan").select("aoi_id", F.array_join("paths", "|").alias("paths"), "batch_size")


@query("""
WITH c AS (SELECT event_type AS split, event_id, CASE WHEN event_id % 5 = 0 THEN 'invalid' WHEN event_id % 3 > 0 THEN 'valid' END AS status FROM events)
SELECT split, event_id AS candidate_index, status IS NULL AS open FROM c WHERE status IS NULL OR status = 'valid' QUALIFY row_number() OVER (PARTITION BY split ORDER BY event_id) <= CASE split WHEN 'click' THEN 50 WHEN 'view' THEN 20 ELSE 0 END""")
def resumed_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("split"), F.col("event_id").alias("candidate_index"), F.col("event_id").cast("string").alias("cache_key"))
    index = e.select(F.col("event_id").cast("string").alias("cache_key"), F.when(F.col("event_id") % 5 == 0, "invalid").otherwise("valid").alias("status")).filter("cache_key % 5 = 0 or cache_key % 3 > 0")
    return planning.kept_discoveries(rows, index, {"click": 50, "view": 20}).select("split", "candidate_index", F.col("status").isNull().alias("open"))


# --- publication -----------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT event_type AS split, event_id, user_id, event_id % 8 > 0 AS made, event_id % 3 = 0 AS whole FROM events)
SELECT split, count(*) AS source_records, count(*) FILTER (made) AS generated_records, count(*) FILTER (NOT made) AS processing_failures, count(*) FILTER (made AND whole) AS full_coverage_records,
  round(count(*) FILTER (made AND whole) / count(*) FILTER (made), 6) AS full_coverage_fraction, count(DISTINCT user_id) FILTER (made) AS aoi_count FROM s GROUP BY 1""")
def publication_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    key = [F.col("event_type").alias("split"), F.col("event_id").alias("record_index")]
    made = e.filter("event_id % 8 > 0").select(*key, F.concat(F.lit("/data/run/"), F.col("event_id").cast("string")).alias("raster_path"), F.when(F.col("event_id") % 3 == 0, 1.0).otherwise(0.95).alias("min_no2_finite_fraction"))
    failed = e.filter("event_id % 8 = 0").select(*key, F.lit("failed").alias("error"))
    report = planning.published(e.select(*key, F.col("user_id").alias("aoi_id")), made, failed, "/data")[1]
    return rounded(report.select("split", "source_records", "generated_records", "processing_failures", "full_coverage_records", "full_coverage_fraction", "aoi_count"))


@query(_metrics_sql("split,").replace(PRED, PRED.replace("SELECT user_id", "SELECT ['train', 'val', 'test'][event_id % 3 + 1] AS split, user_id")))
def metrics_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumn("split", F.array(*map(F.lit, ("train", "val", "test")))[(F.col("event_id") % 3).cast("int")])
    return rounded(metrics.classification_metrics(rows, by=["split"]))


@query(f"""
WITH {PRED}, p AS (SELECT *, event_id % 2 AS half, (predicted + 1) % 3 AS other FROM pred),
u AS (SELECT half, aoi_id, median(value) AS v FROM p GROUP BY ALL),
k AS (SELECT *, (rank() OVER (PARTITION BY half ORDER BY v) + (count(*) OVER (PARTITION BY half, v) - 1) / 2.0) / count(*) OVER (PARTITION BY half) AS share FROM u),
s AS (SELECT *, CASE WHEN share <= 1 / 3.0 THEN 'Low' WHEN share <= 2 / 3.0 THEN 'Middle' ELSE 'High' END AS stratum FROM k)
SELECT half, stratum, count(DISTINCT aoi_id) AS aoi_count, count(*) AS record_count, round(min(v), 6) AS value_min, round(max(v), 6) AS value_max, round(avg((truth = predicted)::INT), 6) AS predicted_accuracy, round(avg((truth = other)::INT), 6) AS other_accuracy,
  round(avg((truth = other)::INT) - avg((truth = predicted)::INT), 6) AS accuracy_gain FROM p JOIN s USING (half, aoi_id) GROUP BY ALL""")
def gain_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumns({"half": F.col("event_id") % 2, "other": (F.col("predicted") + 1) % 3})
    return rounded(metrics.gain_by_tertile(rows, "value", "predicted", "other", by=["half"]))


@query()
def synthetic_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible cells of each user's records, 24 by 24. A small file is one task's: rows are dealt out, as a mask costs far more than its row."""
    e = table(spark, sf_dir, "events").select("event_id").repartition(spark.sparkContext.defaultParallelism)
    return e.withColumn("visible", masks.visible_mask(F.col("event_id").cast("string"), 7, 24, 24))


# --- candidates ------------------------------------------------------------------------------------

_CITIES = ((-118.2, 34.1), (-104.9, 39.7), (-87.6, 41.9), (-74.0, 40.7))
_HAVERSINE = f"2 * {geo.EARTH_KM} * asin(sqrt(least(1, pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2))))"
_GAP = f"{SEC} / 60 BETWEEN {BOUNDS[0]} AND {BOUNDS[1]}"


@query(f"""
WITH RECURSIVE {REC}, {MEM},
h AS (SELECT aoi_id, hour, avg(op_time) AS m, coalesce(sum(nox_mass) FILTER (usable AND nox_mass >= 0), 0) AS mass FROM rec JOIN mem USING (facility_id) WHERE op_time >= 0 GROUP BY ALL),
a AS (SELECT aoi_id, median(mass) AS s FROM h JOIN (SELECT aoi_id, median(m) AS cut FROM h GROUP BY 1) USING (aoi_id) WHERE m >= cut GROUP BY 1),
rk AS (SELECT *, row_number() OVER (ORDER BY s, aoi_id) / count(*) OVER () AS pct, row_number() OVER (ORDER BY s DESC, aoi_id) AS place, count(*) OVER () AS n FROM a),
ch AS (SELECT aoi_id, pct FROM rk WHERE place <= ceil(n * 0.5)),
fc AS (SELECT * FROM fac WHERE facility_id IN (SELECT aoi_id FROM ch)),
ed AS (SELECT a.facility_id AS a, b.facility_id AS b FROM fc a, fc b WHERE abs(a.x - b.x) <= 72000 AND abs(a.y - b.y) <= 72000),
re AS (SELECT facility_id AS x, facility_id AS m FROM fc UNION SELECT ed.b, re.m FROM re JOIN ed ON ed.a = re.x),
cl AS (SELECT x AS aoi_id, min(m) AS cluster FROM re GROUP BY 1),
j AS (SELECT *, coalesce(lower(fuel) LIKE '%coal%', false) AS coal FROM rec JOIN mem USING (facility_id) WHERE aoi_id IN (SELECT aoi_id FROM ch)),
hh AS (SELECT aoi_id, hour, avg(op_time) AS m FROM j WHERE op_time >= 0 GROUP BY ALL),
ac AS (SELECT aoi_id, hour FROM hh JOIN (SELECT aoi_id, median(m) AS cut FROM hh GROUP BY 1) USING (aoi_id) WHERE m >= cut),
ft AS (SELECT aoi_id, avg(heat_input) AS heat FROM j JOIN ac USING (aoi_id, hour) GROUP BY 1),
hr AS (SELECT aoi_id, hour, sum(nox_mass) AS nox FROM j GROUP BY ALL HAVING bool_and(usable)),
sc AS (SELECT DISTINCT user_id AS aoi_id, date_trunc('hour', ts)::TIMESTAMP AS t3 FROM events),
lg AS (SELECT *, lag(t3, 1) OVER w AS t2, lag(t3, 2) OVER w AS t1, lag(t3, 3) OVER w AS t0 FROM sc WINDOW w AS (PARTITION BY aoi_id ORDER BY t3)),
sq AS (SELECT lg.*, h0.nox AS x0, h1.nox AS x1, h2.nox AS x2, h3.nox AS x3, {", ".join(f"exp(-({SEC.format(a=f't{i - 1}', b=f't{i}')} / 3600.0) / 2) AS r{i}" for i in (1, 2, 3))} FROM lg {" ".join(f"JOIN hr h{i} ON h{i}.aoi_id = lg.aoi_id AND h{i}.hour = t{i}" for i in range(4))}
  WHERE {" AND ".join(_GAP.format(a=f"t{i - 1}", b=f"t{i}") for i in (1, 2, 3))}),
em AS (SELECT *, r2 * (r1 * x0 + (1 - r1) * x1) + (1 - r2) * x2 AS previous FROM sq),
pl AS (SELECT facility_id AS aoi_id, -120 + (facility_id * 37 % 5000) / 100.0::DOUBLE AS lon, 26 + (facility_id * 61 % 2200) / 100.0::DOUBLE AS lat FROM fc),
ci AS (SELECT aoi_id, min({_HAVERSINE}) AS km FROM pl, (VALUES {", ".join(map(str, _CITIES))}) AS c(clon, clat) GROUP BY 1)
SELECT aoi_id, cluster, t3 AS emissions_hour, round(x0, 6) AS t0_nox, round(x3, 6) AS t3_nox, round(r3 * previous + (1 - r3) * x3 - previous, 6) AS delta_nox, round(km, 6) AS city_km, round(heat, 6) AS avg_heat_input, round(pct, 6) AS aoi_score_percentile, {_FILE.format('t0')} AS weather_path_t0
FROM em JOIN cl USING (aoi_id) JOIN ft USING (aoi_id) JOIN ci USING (aoi_id) JOIN ch USING (aoi_id)""")
def stratification_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidate_rows(spark, sf_dir)
    return rounded(rows.select("aoi_id", "cluster", F.col("emissions_hour_utc").cast("timestamp_ntz").alias("emissions_hour"), "t0_nox", "t3_nox", "delta_nox", "city_km", "avg_heat_input", "aoi_score_percentile", "weather_path_t0"))


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("facility_id")
    places = facilities(spark, sf_dir).withColumns({"lon": -120 + u * 37 % 5000 / 100.0, "lat": 26 + u * 61 % 2200 / 100.0})
    scans = table(spark, sf_dir, "events").select(F.col("user_id").alias("aoi_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("scan_time")).distinct()
    return candidates.stratification_candidates(records(spark, sf_dir), places, scans, spark.createDataFrame(list(_CITIES), "lon double, lat double"), bounds=BOUNDS)


_CLASS = [f"count(*) FILTER (delta_category = '{c}')" for c in CLASSES]
_MISS = " + ".join("pow((h{i}[{c}] + {n} - t[{c}] * {s}) / greatest(t[{c}] * {s}, 1), 2)".replace("{c}", str(c)).replace("{n}", f"{{x}}n[{c}]") for c in (1, 2, 3))
_MOVES = ", ".join(f"CASE WHEN k - o.i + 1 = (u[1] = 0)::INT + (u[2] = 0)::INT + (u[3] = 0)::INT AND u[{i + 1}] > 0 THEN 'infinity'::DOUBLE ELSE round(({_MISS.format(i=i, s=s, x='')}) - ({_MISS.format(i=i, s=s, x='0 * ')}), 12) END AS c{i}" for i, s in enumerate(SHARES))
_GROWN = ", ".join(f"list_transform(list_zip(h{i}, n), lambda z: z[1] + z[2] * (s = {i})::INT) AS h{i}" for i in range(3))


@query(ORACLES["stratification_candidates"].split("\nSELECT aoi_id, cluster")[0] + f""",
cd AS (SELECT em.*, cluster, r3 * previous + (1 - r3) * x3 - previous AS delta FROM em JOIN cl USING (aoi_id) JOIN ft USING (aoi_id) JOIN ci USING (aoi_id) JOIN ch USING (aoi_id)),
sz AS (SELECT aoi_id, median(x) AS scale FROM (SELECT aoi_id, unnest([x0, x1, x2, x3]) AS x FROM cd) WHERE x > 0 GROUP BY 1),
lb AS (SELECT aoi_id, cluster, t3, delta / (1 - r3) AS innovation, greatest(20, 0.25 * scale) AS threshold FROM cd JOIN sz USING (aoi_id)),
ld AS (SELECT *, CASE WHEN innovation >= threshold THEN 'increase' WHEN innovation <= -threshold THEN 'decrease' ELSE 'steady' END AS delta_category FROM lb),
el AS (SELECT * FROM ld WHERE aoi_id IN (SELECT aoi_id FROM ld GROUP BY 1 HAVING least({", ".join(_CLASS)}) >= 1)),
cc AS (SELECT cluster, count(*) AS records, [{", ".join(f"{c}::DOUBLE" for c in _CLASS)}] AS n FROM el GROUP BY 1),
o AS (SELECT cluster, n, row_number() OVER (ORDER BY records DESC, {HASH.format("'42|' || cluster")}, cluster)::INT AS i, [sum(n[1]) OVER (), sum(n[2]) OVER (), sum(n[3]) OVER ()] AS t, count(*) OVER () AS k FROM cc),
g AS (SELECT 0 AS i, [0, 0, 0]::DOUBLE[] AS h0, [0, 0, 0]::DOUBLE[] AS h1, [0, 0, 0]::DOUBLE[] AS h2, [0, 0, 0] AS u, NULL::BIGINT AS cluster, NULL::INT AS s
  UNION ALL SELECT i, {_GROWN}, [u[1] + (s = 0)::INT, u[2] + (s = 1)::INT, u[3] + (s = 2)::INT], cluster, s
  FROM (SELECT *, CASE WHEN c0 <= c1 AND c0 <= c2 THEN 0 WHEN c1 <= c2 THEN 1 ELSE 2 END AS s FROM (SELECT o.i, o.n, o.cluster, h0, h1, h2, u, {_MOVES} FROM g JOIN o ON o.i = g.i + 1))),
sp AS (SELECT el.*, ['train', 'val', 'test'][s + 1] AS split FROM el JOIN g USING (cluster)),
ls AS (SELECT split, least({", ".join(_CLASS)}) AS n FROM sp GROUP BY 1),
wt AS (SELECT *, CASE WHEN delta_category = 'steady' THEN least(1, greatest(0.01, 1 - abs(innovation) / threshold)) ELSE 1 END AS weight FROM sp JOIN ls USING (split))
SELECT split, aoi_id, t3 AS emissions_hour, delta_category, round(innovation, 5) AS innovation, round(threshold, 6) AS threshold FROM wt
QUALIFY row_number() OVER (PARTITION BY split, delta_category ORDER BY {DRAW.format("'42|' || aoi_id || '|' || t3")} / weight, aoi_id, t3) <= n""")
def stratified_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From hourly facts, facilities and scans to balanced splits in one run."""
    balanced = candidates.stratified(candidate_rows(spark, sf_dir), least=1, floors=(20.0, 0.25), strict=False)[0]
    return balanced.select("split", "aoi_id", F.col("t3_timestamp").cast("timestamp_ntz").alias("emissions_hour"), "delta_category", F.round("innovation", 5).alias("innovation"), F.round("threshold", 6).alias("threshold"))
