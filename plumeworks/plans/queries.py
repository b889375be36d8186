"""The registered queries over the test tables, each with the SQL that gives the same rows.

Unit-hour records are bound to `events`: the facility is user_id, the unit event_id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import times
from ..operators import activity, aoi, mapping, sequence
from ..sources import ingest, schemas
from ..tables import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(c), digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


# --- bindings --------------------------------------------------------------------------------------


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    flag = F.when(F.col("event_type") == "error", "Invalid").when(F.col("event_type") == "signup", " Unavailable ")
    fuel = F.when(F.col("event_type") == "click", "Coal").when(F.col("event_type") == "view", "Pipeline Natural Gas")
    return e.select(
        F.col("user_id").alias("facility_id"), F.col("event_id").alias("unit_id"), "ts", F.date_trunc("hour", "ts").alias("hour"), F.col("value").alias("nox_mass"), flag.alias("flag"), fuel.alias("fuel"),
        F.lit(None).cast("string").alias("attribute_fuel"), ((F.col("event_id") % 5) / 4.0).alias("op_time"), (F.col("value") * 10).alias("heat_input"), (F.col("value") * 2).alias("gross_load"), ((F.col("event_id") % 7) * 1.5).alias("capacity_mw"),
    )


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda m: ((F.col("user_id") * m % 150) * 20000).cast("double")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("facility_id"), at(37).alias("x"), at(61).alias("y")).distinct()


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facilities(spark, sf_dir)
    return aoi.membership(f, f.withColumnRenamed("facility_id", "aoi_id"))


def sites(spark: SparkSession, sf_dir: str) -> aoi.Sites:
    f = facilities(spark, sf_dir)
    return aoi.sites(f, f.withColumnRenamed("facility_id", "aoi_id"))


REC = """
rec AS (SELECT user_id AS facility_id, event_id AS unit_id, ts, date_trunc('hour', ts)::TIMESTAMP AS hour, value AS nox_mass,
  CASE event_type WHEN 'error' THEN 'Invalid' WHEN 'signup' THEN ' Unavailable ' END AS flag,
  CASE event_type WHEN 'click' THEN 'Coal' WHEN 'view' THEN 'Pipeline Natural Gas' END AS fuel,
  (event_id % 5) / 4.0::DOUBLE AS op_time, value * 10 AS heat_input, value * 2 AS gross_load, (event_id % 7) * 1.5::DOUBLE AS capacity_mw,
  NOT regexp_matches(lower(trim(coalesce(CASE event_type WHEN 'error' THEN 'Invalid' WHEN 'signup' THEN ' Unavailable ' END, ''))), 'invalid|unavailable') AS usable
  FROM events)"""
FAC = "fac AS (SELECT DISTINCT user_id AS facility_id, (user_id * 37 % 150) * 20000::DOUBLE AS x, (user_id * 61 % 150) * 20000::DOUBLE AS y FROM events)"
MEM = f"{FAC}, mem AS (SELECT a.facility_id AS aoi_id, f.facility_id FROM fac a, fac f WHERE abs(f.x - a.x) <= 36000 AND abs(f.y - a.y) <= 36000)"


# --- activity --------------------------------------------------------------------------------------


@query(f"""
WITH {REC}, {MEM},
h AS (SELECT aoi_id, hour, avg(op_time) AS m, count(*) FILTER (op_time > 0) AS u, coalesce(sum(nox_mass) FILTER (usable AND isfinite(nox_mass) AND nox_mass >= 0), 0) AS mass
  FROM rec JOIN mem USING (facility_id) WHERE isfinite(op_time) AND op_time >= 0 GROUP BY ALL),
c AS (SELECT aoi_id, median(m) AS cut FROM h GROUP BY 1),
a AS (SELECT aoi_id, median(mass) AS s, avg(u) AS units FROM h JOIN c USING (aoi_id) WHERE m >= cut GROUP BY 1),
e AS (SELECT aoi_id, avg((mass > 0)::INT) AS f FROM h GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY s, aoi_id) AS rank, count(*) OVER () AS n, row_number() OVER (ORDER BY s DESC, aoi_id) AS place FROM a JOIN e USING (aoi_id))
SELECT aoi_id, round(s, 6) AS active_median_nox, round(units, 6) AS active_mean_units, round(f, 6) AS emitting_fraction, rank AS score_rank, round(rank / n, 6) AS score_percentile
FROM r WHERE place <= ceil(n * 0.5)""")
def aoi_active_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = activity.operating_characteristics(records(spark, sf_dir), sites(spark, sf_dir))
    return rounded(activity.top_share(activity.ranked_scores(scores), 0.5)).withColumn("score_rank", F.col("score_rank").cast("long"))


@query(f"""
WITH {REC}, {MEM}, j AS (SELECT *, coalesce(lower(fuel) LIKE '%coal%', NULL) AS coal, lower(fuel) LIKE '%natural gas%' AS gas FROM rec JOIN mem USING (facility_id)),
u AS (SELECT aoi_id, facility_id, unit_id, coalesce(bool_or(coal), false) AS c, coalesce(bool_or(gas), false) AS g FROM j GROUP BY ALL),
n AS (SELECT aoi_id, count(*) AS num_units, count(*) FILTER (c) AS num_coal_units, count(*) FILTER (g) AS num_gas_units FROM u GROUP BY 1),
h AS (SELECT aoi_id, hour, avg(op_time) AS m, coalesce(sum(nox_mass) FILTER (coal AND usable AND nox_mass >= 0), 0) AS mass FROM j WHERE op_time >= 0 GROUP BY ALL),
k AS (SELECT aoi_id, median(m) AS cut FROM h GROUP BY 1),
s AS (SELECT h.* FROM h JOIN k USING (aoi_id) WHERE m >= cut),
v AS (SELECT aoi_id, avg(heat_input) AS heat, avg(gross_load) AS load FROM j JOIN s USING (aoi_id, hour) GROUP BY 1)
SELECT aoi_id, num_units, num_coal_units, num_gas_units, round(avg(mass), 8) AS avg_coal_nox, round(any_value(heat), 8) AS avg_heat_input, round(any_value(load), 8) AS avg_gross_load
FROM s JOIN n USING (aoi_id) JOIN v USING (aoi_id) GROUP BY ALL""")
def activity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(activity.activity_features(records(spark, sf_dir), sites(spark, sf_dir)), 8)


@query(f"WITH {REC} SELECT unit_id, flag, nox_mass FROM rec WHERE usable")
def usable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).filter(activity.usable(F.col("flag"))).select("unit_id", "flag", "nox_mass")


@query(f"""
WITH {REC}, {MEM}, j AS (SELECT * FROM rec JOIN mem USING (facility_id)), bad AS (SELECT DISTINCT aoi_id, hour FROM j WHERE NOT usable OR NOT isfinite(nox_mass))
SELECT aoi_id, hour, round(sum(nox_mass), 6) AS nox_mass FROM j WHERE usable AND isfinite(nox_mass) AND (aoi_id, hour) NOT IN (SELECT (aoi_id, hour) FROM bad) GROUP BY ALL""")
def invalid_hours_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(activity.clean_hours(records(spark, sf_dir), sites(spark, sf_dir)))


@query(f"""
WITH {REC}, {MEM}, j AS (SELECT * FROM rec JOIN mem USING (facility_id)), e AS (SELECT aoi_id, facility_id, max(capacity_mw) AS mw FROM j GROUP BY ALL),
s AS (SELECT aoi_id, sum(mw) AS total_mw, max(mw) AS largest_mw FROM e GROUP BY 1),
n AS (SELECT aoi_id, count(DISTINCT facility_id) AS num_facilities, count(DISTINCT (facility_id, unit_id)) AS num_units FROM j GROUP BY 1)
SELECT aoi_id, num_facilities, num_units, total_mw, largest_mw, round(CASE WHEN total_mw > 0 THEN largest_mw / total_mw END, 6) AS largest_share FROM n JOIN s USING (aoi_id)""")
def facility_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(activity.static_characteristics(records(spark, sf_dir), sites(spark, sf_dir)))


# --- ingest ----------------------------------------------------------------------------------------


@query(r"""
WITH a AS (SELECT p_partkey % 50 AS facility, 2000 + p_size % 3 AS year, concat(p_brand, ' (', p_size / 2.0, '), ', lower(p_brand), 'x (', p_partkey % 4, '), bad') AS t FROM part),
g AS (SELECT facility, year, unnest(string_split(t, ',')) AS p FROM a),
x AS (SELECT facility, year, upper(trim(regexp_extract(p, '^\s*(.+?)\s*\(\s*([^()]*?)\s*\)\s*$', 1))) AS generator, TRY_CAST(nullif(regexp_extract(p, '^\s*(.+?)\s*\(\s*([^()]*?)\s*\)\s*$', 2), '') AS DOUBLE) AS mw FROM g),
c AS (SELECT facility, year, generator, CASE WHEN count(DISTINCT mw) = 1 THEN any_value(mw) END AS mw FROM x WHERE generator <> '' AND mw > 0 GROUP BY ALL),
s AS (SELECT facility, year, sum(mw) AS mw FROM c GROUP BY ALL)
SELECT facility, year, round(coalesce(mw, 0), 6) AS mw FROM (SELECT DISTINCT facility, year FROM a) LEFT JOIN s USING (facility, year)""")
def capacity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    text = F.concat("p_brand", F.lit(" ("), (F.col("p_size") / 2.0).cast("string"), F.lit("), "), F.lower("p_brand"), F.lit("x ("), (F.col("p_partkey") % 4).cast("string"), F.lit("), bad"))
    rows = p.select((F.col("p_partkey") % 50).alias("facility"), (2000 + F.col("p_size") % 3).alias("year"), text.alias("t"))
    return rounded(ingest.capacities(rows, "facility", "year", "t"))


@query("""
WITH a AS (SELECT o_custkey AS facility, year(o_orderdate) AS year, max(o_totalprice) AS price FROM orders GROUP BY ALL),
p AS (SELECT facility, y AS wanted FROM (SELECT DISTINCT o_custkey AS facility FROM orders), (SELECT unnest(range(1994, 2003)) AS y))
SELECT p.facility, p.wanted, coalesce(a.year, -1)::BIGINT AS year, round(a.price, 4) AS price FROM p ASOF LEFT JOIN a ON p.facility = a.facility AND p.wanted >= a.year""")
def asof_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a = o.groupBy(F.col("o_custkey").alias("facility"), F.year("o_orderdate").cast("long").alias("year")).agg(F.max("o_totalprice").alias("price"))
    years = o.select(F.col("o_custkey").alias("facility")).distinct().withColumn("wanted", F.explode(F.sequence(F.lit(1994).cast("long"), F.lit(2002).cast("long"))))
    return rounded(ingest.as_of(years, a, ["facility"], "wanted", "year", ["price"]).select("facility", "wanted", F.coalesce("year", F.lit(-1)).cast("long").alias("year"), "price"), 4)


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def keep_first_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.deduplicated(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 HOUR * (hour(ts) + 5 + event_id % 4) AS utc FROM events")
def utc_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    utc = times.local_standard_to_utc(F.to_date("ts"), F.hour("ts"), -(5 + F.col("event_id") % 4))
    return e.select("event_id", utc.cast("timestamp_ntz").alias("utc"))


@query("""
WITH a AS (SELECT o_custkey AS user_id, count(*) AS n_orders FROM orders GROUP BY 1), e AS (SELECT event_id, user_id, n_orders FROM events LEFT JOIN a USING (user_id))
SELECT (SELECT count(*) FROM events) AS source_rows, count(*) AS enriched_rows, count(DISTINCT event_id) AS distinct_rows, count(n_orders) AS matched FROM e""")
def enrich_rowcount_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written with their users' and their own attributes, and counted."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("n_orders"))
    path = f"{shared_folder(spark)}/enriched-{uuid.uuid4().hex}"
    n = ingest.write_enriched(e, a, e.select("event_id", F.lit(True).alias("known")), path, (["user_id"], ["event_id"]))
    rows = spark.read.parquet(path)
    return rows.agg(F.lit(n).cast("long").alias("source_rows"), F.count("*").alias("enriched_rows"), F.count_distinct("event_id").alias("distinct_rows"), F.count("n_orders").alias("matched"))


@query("""
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(value AS INTEGER) AS value_int, NULL::VARCHAR AS absent FROM (SELECT event_id, props, trunc(value) AS value FROM events)""")
def normalize_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.expr("cast(cast(value as int) as string)").alias("value_int"))
    return ingest.normalized(rows, schemas.schema(event_id=T.LongType(), k=T.LongType(), value_int=T.IntegerType(), absent=T.StringType()), ("event_id",))


@query("""
WITH n AS (SELECT event_id, concat('TEMPO_NO2_L', 2 + event_id % 2, '_V0', 3 + event_id % 2, '_', strftime(ts, '%Y%m%dT%H%M%S'), 'Z_S', lpad((event_id % 20)::VARCHAR, 3, '0'), CASE WHEN event_id % 3 > 0 THEN concat('G', lpad((event_id % 9)::VARCHAR, 2, '0')) ELSE '' END, '.nc') AS name, ts FROM events)
SELECT event_id, concat('L', 2 + event_id % 2) AS level, concat('V0', 3 + event_id % 2) AS version, date_trunc('second', ts)::TIMESTAMP AS taken_at, (event_id % 20)::INT AS scan_num,
  CASE WHEN event_id % 3 > 0 THEN (event_id % 9)::INT ELSE -1 END AS granule_num, (event_id % 2 = 0) = (event_id % 3 > 0) AS well_formed FROM n""")
def granule_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    number = lambda m, width: F.lpad((e % m).cast("string"), width, "0")
    name = F.concat(F.lit("TEMPO_NO2_L"), (2 + e % 2).cast("string"), F.lit("_V0"), (3 + e % 2).cast("string"), F.lit("_"), F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.lit("Z_S"), number(20, 3), F.when(e % 3 > 0, F.concat(F.lit("G"), number(9, 2))).otherwise(""), F.lit(".nc"))
    rows = table(spark, sf_dir, "events").select("event_id", name.alias("name"))
    return rows.select("event_id", *ingest.granule_name(F.col("name"))).withColumns({"taken_at": F.col("taken_at").cast("timestamp_ntz"), "granule_num": F.coalesce("granule_num", F.lit(-1))})


@query("""
WITH m AS (SELECT o_orderkey, o_orderdate::DATE AS a, (o_orderdate::DATE + (o_orderkey % 100)::INT)::DATE AS b FROM orders),
w AS (SELECT o_orderkey, a, b, unnest(generate_series(date_trunc('month', a)::TIMESTAMP, date_trunc('month', b)::TIMESTAMP, INTERVAL 1 MONTH)) AS s FROM m)
SELECT o_orderkey, greatest(s::DATE, a)::VARCHAR AS begin_date, least(last_day(s::DATE), b)::VARCHAR AS end_date, ((date_trunc('quarter', a) - INTERVAL 1 DAY)::DATE)::VARCHAR AS quarter_end FROM w""")
def month_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"), F.expr("date_add(to_date(o_orderdate), cast(o_orderkey % 100 as int))").alias("b"))
    rows = o.withColumn("w", F.explode(times.month_windows(F.col("a"), F.col("b"))))
    return rows.select("o_orderkey", F.col("w.begin").cast("string").alias("begin_date"), F.col("w.end").cast("string").alias("end_date"), times.previous_quarter_end(F.col("a")).cast("string").alias("quarter_end"))


# --- scans, sequences, labels ----------------------------------------------------------------------


def granules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("scan_num"), F.col("event_id").alias("granule"), F.col("ts").alias("start"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.floor("value") * 1_000_000).cast("long")).cast("timestamp_ntz").alias("end"))


@query("""
WITH g AS (SELECT event_type AS scan_num, event_id AS granule, ts AS s, ts + INTERVAL 1 SECOND * floor(value)::BIGINT AS e FROM events),
m AS (SELECT *, max(e) OVER (PARTITION BY scan_num ORDER BY s, granule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM g),
n AS (SELECT *, sum(CASE WHEN latest IS NULL OR s - latest > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY scan_num ORDER BY s, granule) AS scan FROM m)
SELECT scan_num, scan::BIGINT AS scan, min(s) AS scan_start, max(e) AS scan_end, count(*) AS granules, string_agg(granule::VARCHAR, ',' ORDER BY s, granule) AS members FROM n GROUP BY ALL""")
def sessionize_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapping.scans(granules(spark, sf_dir))
    return rows.select("scan_num", "scan", "scan_start", "scan_end", F.size("granules").cast("long").alias("granules"), F.array_join(F.transform("granules", lambda g: g.cast("string")), ",").alias("members"))


@query("""
WITH p AS (SELECT vec_id, embedding[1] * 3 + vec_id % 7 AS lon, embedding[2] * 3 + vec_id % 5 AS lat, vec_id % 6 AS step, (vec_id % 6) * 10.0::DOUBLE AS step_time, vec_id % 9 AS granule FROM embeddings),
b AS (SELECT c_custkey AS aoi_id, (c_custkey % 7)::DOUBLE - 0.4 AS lon_min, (c_custkey % 7)::DOUBLE + 0.5 AS lon_max, (c_custkey % 5)::DOUBLE - 0.3 AS lat_min, (c_custkey % 5)::DOUBLE + 0.4 AS lat_max FROM customer),
k AS (SELECT * FROM p JOIN b ON lon BETWEEN lon_min AND lon_max AND lat BETWEEN lat_min AND lat_max),
s AS (SELECT aoi_id, granule, min(step) AS f, max(step) AS l FROM k GROUP BY ALL),
t AS (SELECT aoi_id, string_agg(concat(granule, ':', f, '-', l), ',' ORDER BY granule) AS steps FROM s GROUP BY 1)
SELECT aoi_id, round(avg(step_time), 6) AS observed_at, count(*) AS sampled_pixels, any_value(steps) AS steps FROM k JOIN t USING (aoi_id) GROUP BY 1""")
def observation_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    p = table(spark, sf_dir, "embeddings").select((F.col("embedding")[0] * F.lit(3) + v % 7).cast("float").cast("double").alias("lon"), (F.col("embedding")[1] * F.lit(3) + v % 5).cast("float").cast("double").alias("lat"), (v % 6).alias("step"), (v % 6 * 10.0).alias("step_time"), (v % 9).alias("granule"))
    c = F.col("c_custkey")
    at = lambda m, d: ((c % m).cast("double") + d)
    b = table(spark, sf_dir, "customer").select(c.alias("aoi_id"), at(7, -0.4).alias("lon_min"), at(7, 0.5).alias("lon_max"), at(5, -0.3).alias("lat_min"), at(5, 0.4).alias("lat_max"))
    steps = F.array_join(F.transform("steps", lambda s: F.concat(s["granule"].cast("string"), F.lit(":"), s["first"].cast("string"), F.lit("-"), s["last"].cast("string"))), ",")
    return rounded(mapping.all_observations(p, b).withColumn("steps", steps))


@query("""
WITH l AS (SELECT * FROM (VALUES (TIMESTAMP '1981-07-01'), ('1982-07-01'), ('1983-07-01'), ('1985-07-01'), ('1988-01-01'), ('1990-01-01'), ('1991-01-01'), ('1992-07-01'), ('1993-07-01'), ('1994-07-01'), ('1996-01-01'), ('1997-07-01'), ('1999-01-01'), ('2006-01-01'), ('2009-01-01'), ('2012-07-01'), ('2015-07-01'), ('2017-01-01')) AS t(d)),
o AS (SELECT epoch(d) - 315964800 + row_number() OVER (ORDER BY d) AS g FROM l),
s AS (SELECT event_id, event_id * 130000.0 + 0.25 AS g FROM events)
SELECT event_id, make_timestamp(((g + 315964800 - (SELECT count(*) FROM o WHERE o.g <= s.g)) * 1000000)::BIGINT) AS utc FROM s""")
def gps_to_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", times.gps_to_utc(F.col("event_id") * 130000.0 + 0.25).cast("timestamp_ntz").alias("utc"))


BOUNDS = (60, 1440)


def user_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("aoi_id"), F.col("ts").alias("scan_time"), F.col("event_id").alias("path"))


def user_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("aoi_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.round(F.sum("value"), 4).alias("nox_mass"))


SEC = "trunc((epoch_us({b}) - epoch_us({a})) / 1000000.0)"
SEQ = f"""
lagged AS (SELECT user_id AS aoi_id, ts AS t3, event_id AS p3, lag(ts, 1) OVER w AS t2, lag(ts, 2) OVER w AS t1, lag(ts, 3) OVER w AS t0, lag(event_id, 3) OVER w AS p0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
seq AS (SELECT *, {SEC.format(a="t2", b="t3")} / 60 AS gap FROM lagged WHERE {SEC.format(a="t0", b="t1")} / 60 BETWEEN 60 AND 1440 AND {SEC.format(a="t1", b="t2")} / 60 BETWEEN 60 AND 1440 AND {SEC.format(a="t2", b="t3")} / 60 BETWEEN 60 AND 1440)"""
HOURS = "hours AS (SELECT user_id AS aoi_id, date_trunc('hour', ts)::TIMESTAMP AS hour, round(sum(value), 4) AS nox FROM events GROUP BY ALL)"
STEPS_SQL = f"""
{SEQ}, {HOURS},
st AS (SELECT s.*, {", ".join(f"CASE WHEN {SEC.format(a=f"date_trunc('hour', t{i})::TIMESTAMP", b=f"t{i}")} = 0 THEN l{i}.nox ELSE l{i}.nox + {SEC.format(a=f"date_trunc('hour', t{i})::TIMESTAMP", b=f"t{i}")} / 3600.0 * (u{i}.nox - l{i}.nox) END AS x{i}" for i in range(4))}
  FROM seq s {" ".join(f"LEFT JOIN hours l{i} ON l{i}.aoi_id = s.aoi_id AND l{i}.hour = date_trunc('hour', t{i})::TIMESTAMP LEFT JOIN hours u{i} ON u{i}.aoi_id = s.aoi_id AND u{i}.hour = date_trunc('hour', t{i})::TIMESTAMP + INTERVAL 1 HOUR" for i in range(4))})"""


@query(f"WITH {SEQ} SELECT aoi_id, t0 AS t0_timestamp, t1 AS t1_timestamp, t2 AS t2_timestamp, t3 AS t3_timestamp, p0 AS path_t0, p3 AS path_t3, hour(t3)::INT AS hour, round(gap, 6) AS label_delta_mins FROM seq")
def tempo_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.sequences(user_scans(spark, sf_dir), bounds=BOUNDS, carry=("path",))
    return rounded(rows.select("aoi_id", *(f"t{i}_timestamp" for i in range(4)), "path_t0", "path_t3", "hour", "label_delta_mins"))


def user_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.sequences(user_scans(spark, sf_dir), bounds=BOUNDS)
    return sequence.interpolated(rows, user_hours(spark, sf_dir).withColumn("hour", F.col("hour").cast("timestamp")))


@query(f"WITH {STEPS_SQL} SELECT aoi_id, t3 AS t3_timestamp, round(x0, 6) AS t0_nox, round(x1, 6) AS t1_nox, round(x2, 6) AS t2_nox, round(x3, 6) AS t3_nox FROM st")
def timestep_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(user_steps(spark, sf_dir).select("aoi_id", "t3_timestamp", *(f"t{i}_nox" for i in range(4))))


def filled_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps where hours without a record count as 5."""
    rows = user_steps(spark, sf_dir)
    return rows.withColumns({f"t{i}_nox": F.coalesce(f"t{i}_nox", F.lit(5.0 * i + 5)) for i in range(4)})


KEEP = ", ".join(f"exp(-({SEC.format(a=f't{i - 1}', b=f't{i}')} / 3600.0) / 2) AS r{i}" for i in (1, 2, 3))
EMA = f"""
{STEPS_SQL},
f AS (SELECT aoi_id, t0, t1, t2, t3, {", ".join(f"coalesce(x{i}, {5.0 * i + 5}::DOUBLE) AS x{i}" for i in range(4))}, {KEEP} FROM st),
e AS (SELECT *, r2 * (r1 * x0 + (1 - r1) * x1) + (1 - r2) * x2 AS previous FROM f),
e3 AS (SELECT *, r3 * previous + (1 - r3) * x3 AS now FROM e)"""


@query(f"WITH {EMA} SELECT aoi_id, t3 AS t3_timestamp, round(previous, 6) AS previous_nox, round(now, 6) AS current_nox, round(now - previous, 6) AS delta_nox, round({SEC.format(a='t0', b='t3')} / 3600.0, 6) AS age_hours_t0 FROM e3")
def ema_innovation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sequence.ema(filled_steps(spark, sf_dir)).select("aoi_id", "t3_timestamp", "previous_nox", "current_nox", "delta_nox", "age_hours_t0"))


LABELS = f"""
{EMA},
sc AS (SELECT aoi_id, median(x) AS scale FROM (SELECT aoi_id, unnest([x0, x1, x2, x3]) AS x FROM e3) WHERE x > 0 GROUP BY 1),
la AS (SELECT *, (now - previous) / (1 - r3) AS innovation, greatest(20, 0.25 * scale) AS threshold FROM e3 JOIN sc USING (aoi_id)),
lab AS (SELECT *, CASE WHEN innovation >= threshold THEN 'increase' WHEN innovation <= -threshold THEN 'decrease' ELSE 'steady' END AS delta_category FROM la)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.innovation_labels(sequence.ema(filled_steps(spark, sf_dir)), floors=(20.0, 0.25))


@query(f"WITH {LABELS} SELECT aoi_id, t3 AS t3_timestamp, round(scale, 6) AS aoi_scale, round(innovation, 5) AS innovation, round(threshold, 6) AS threshold, delta_category FROM lab")
def hybrid_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("aoi_id", "t3_timestamp", F.round("aoi_scale", 6).alias("aoi_scale"), F.round("innovation", 5).alias("innovation"), F.round("threshold", 6).alias("threshold"), "delta_category")


@query(f"""WITH {LABELS}, n AS (SELECT aoi_id, count(*) FILTER (delta_category = 'decrease') AS decrease_count, count(*) FILTER (delta_category = 'steady') AS steady_count, count(*) FILTER (delta_category = 'increase') AS increase_count FROM lab GROUP BY 1)
SELECT n.*, least(decrease_count, steady_count, increase_count) >= 5 AS passes, CASE WHEN least(decrease_count, steady_count, increase_count) >= 5 THEN decrease_count + steady_count + increase_count ELSE 0 END AS kept FROM n""")
def class_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, audit = activity.class_floor(labelled(spark, sf_dir), "aoi_id", "delta_category", sequence.CLASSES, 5)
    n = kept.groupBy("aoi_id").agg(F.count("*").alias("kept"))
    return audit.join(n, "aoi_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))


DELTAS = f"{HOURS}, del AS (SELECT *, CASE WHEN hour - lag(hour) OVER w = INTERVAL 1 HOUR THEN nox - lag(nox) OVER w END AS delta FROM hours WINDOW w AS (PARTITION BY aoi_id ORDER BY hour))"


@query(f"WITH {DELTAS} SELECT aoi_id, hour, nox AS nox_mass, round(delta, 6) AS delta_nox FROM del")
def delta_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sequence.hourly_deltas(user_hours(spark, sf_dir)))


PAIRS = f"""
pr AS (SELECT user_id AS aoi_id, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS previous, ts AS current FROM events),
ov AS (SELECT *, unnest(generate_series(date_trunc('hour', previous)::TIMESTAMP, date_trunc('hour', current - INTERVAL 1 MICROSECOND)::TIMESTAMP, INTERVAL 1 HOUR)) AS h FROM pr WHERE previous IS NOT NULL AND previous < current),
os AS (SELECT *, {SEC.format(a="greatest(previous, h)", b="least(current, h + INTERVAL 1 HOUR)")} AS s FROM ov)"""


@query(f"""WITH {DELTAS}, {PAIRS},
j AS (SELECT os.*, delta FROM os LEFT JOIN del ON del.aoi_id = os.aoi_id AND del.hour = os.h)
SELECT p.aoi_id, p.event_id, round(any_value(v), 6) AS delta_nox FROM pr p LEFT JOIN
  (SELECT event_id, CASE WHEN sum(s) FILTER (delta IS NOT NULL) = sum(s) THEN sum(delta * s) / sum(s) END AS v FROM j GROUP BY 1) q USING (event_id) GROUP BY ALL""")
def overlap_weighted_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts")
    rows = e.select(F.col("user_id").alias("aoi_id"), "event_id", F.lag("ts").over(w).alias("previous"), F.col("ts").alias("current"))
    return rounded(sequence.overlap_weighted(rows, sequence.hourly_deltas(user_hours(spark, sf_dir)), ("event_id",)))


@query(f"""WITH {PAIRS} SELECT aoi_id, h AS hour, previous, current, round(s * 100 / 3600.0, 6) AS coverage_percent FROM os WHERE s > 0 AND {SEC.format(a="previous", b="current")} / 60 BETWEEN 60 AND 1440
QUALIFY row_number() OVER (PARTITION BY aoi_id, h ORDER BY s DESC, previous) = 1""")
def best_overlap_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sequence.best_overlap(user_scans(spark, sf_dir), BOUNDS)).withColumn("hour", F.col("hour").cast("timestamp_ntz"))
