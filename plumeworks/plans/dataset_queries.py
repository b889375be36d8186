"""Registered queries on splits, geography, rasters, plans and metrics, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, times
from ..operators import aoi, metrics, normalization, raster, splits
from . import work
from .queries import FAC, MEM, facilities, members, query, rounded, table

# --- geography and splits --------------------------------------------------------------------------


def user_aois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facilities(spark, sf_dir).withColumnRenamed("facility_id", "aoi_id")


def customer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c.alias("aoi_id"), (-120 + c * 37 % 5000 / 100.0).alias("lon"), (26 + c * 61 % 2200 / 100.0).alias("lat"))


PLACES = "pl AS (SELECT c_custkey AS aoi_id, -120 + (c_custkey * 37 % 5000) / 100.0::DOUBLE AS lon, 26 + (c_custkey * 61 % 2200) / 100.0::DOUBLE AS lat FROM customer)"


@query(f"WITH {MEM} SELECT aoi_id, facility_id FROM mem")
def box_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir)


@query(f"""
WITH RECURSIVE {FAC}, e AS (SELECT a.facility_id AS a, b.facility_id AS b FROM fac a, fac b WHERE abs(a.x - b.x) <= 72000 AND abs(a.y - b.y) <= 72000),
r AS (SELECT facility_id AS x, facility_id AS m FROM fac UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.x)
SELECT x AS aoi_id, min(m) AS cluster FROM r GROUP BY 1""")
def cluster_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aoi.clusters(user_aois(spark, sf_dir))


HASH = "('0x' || substr(sha256({}), 1, 15))::BIGINT"
COST = "round(pow((h{i} + n - t * {s}) / greatest(t * {s}, 1), 2) - pow((h{i} - t * {s}) / greatest(t * {s}, 1), 2), 12)"
_COSTS = ", ".join(f"CASE WHEN k - o.i + 1 = (u0 = 0)::INT + (u1 = 0)::INT + (u2 = 0)::INT AND u{i} > 0 THEN 'infinity'::DOUBLE ELSE {COST.format(i=i, s=s)} END AS c{i}" for i, s in enumerate(splits.SHARES))


@query(f"""
WITH RECURSIVE c AS (SELECT user_id % 40 AS cluster, count(*)::DOUBLE AS n FROM events GROUP BY 1),
o AS (SELECT cluster, n, row_number() OVER (ORDER BY n DESC, {HASH.format("'42|' || cluster")}, cluster)::INT AS i, sum(n) OVER () AS t, count(*) OVER () AS k FROM c),
g AS (SELECT 0 AS i, 0::DOUBLE AS h0, 0::DOUBLE AS h1, 0::DOUBLE AS h2, 0 AS u0, 0 AS u1, 0 AS u2, NULL::BIGINT AS cluster, NULL::INT AS s
  UNION ALL SELECT i, h0 + n * (s = 0)::INT, h1 + n * (s = 1)::INT, h2 + n * (s = 2)::INT, u0 + (s = 0)::INT, u1 + (s = 1)::INT, u2 + (s = 2)::INT, cluster, s
  FROM (SELECT *, CASE WHEN c0 <= c1 AND c0 <= c2 THEN 0 WHEN c1 <= c2 THEN 1 ELSE 2 END AS s FROM (SELECT o.i, o.n, o.cluster, h0, h1, h2, u0, u1, u2, {_COSTS} FROM g JOIN o ON o.i = g.i + 1)))
SELECT cluster, ['train', 'val', 'test'][s + 1] AS split FROM g WHERE i > 0""")
def greedy_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("cluster"))
    return splits.greedy_splits(splits.cluster_counts(rows, "cluster", None, ()), "cluster")


DRAW = f"-ln(({HASH.format('{0}')} % 1000000007 + 0.5) / 1000000007.0::DOUBLE)"


@query(f"SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {DRAW.format("'42|' || event_id")} / (value + 1), event_id) <= 50")
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.weighted_sample(table(spark, sf_dir, "events"), 50, F.col("value") + 1, ["event_id"], ["event_type"]).select("event_type", "event_id")


@query(f"""
WITH f AS (SELECT event_id, ['train', 'val', 'test'][(user_id % 3)::INT + 1] AS split, CASE WHEN event_id % 10 < 2 THEN 'decrease' WHEN event_id % 10 < 7 THEN 'steady' ELSE 'increase' END AS label, value - 100 AS innovation, 200.0::DOUBLE AS threshold FROM events),
l AS (SELECT split, least(count(*) FILTER (label = 'decrease'), count(*) FILTER (label = 'steady'), count(*) FILTER (label = 'increase')) AS n FROM f GROUP BY 1),
w AS (SELECT *, CASE WHEN label = 'steady' THEN least(1, greatest(0.01, 1 - abs(innovation) / threshold)) ELSE 1 END AS weight FROM f JOIN l USING (split))
SELECT split, label, event_id FROM w QUALIFY row_number() OVER (PARTITION BY split, label ORDER BY {DRAW.format("'42|' || event_id")} / weight, event_id) <= n""")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 10
    label = F.when(k < 2, "decrease").when(k < 7, "steady").otherwise("increase")
    split = F.array(*map(F.lit, splits.SPLITS))[(F.col("user_id") % 3).cast("int")]
    rows = table(spark, sf_dir, "events").select("event_id", split.alias("split"), label.alias("label"), (F.col("value") - 100).alias("innovation"), F.lit(200.0).alias("threshold"))
    return splits.balanced(rows, "label", ("decrease", "steady", "increase"), ["event_id"]).select("split", "label", "event_id")


@query(f"""
WITH {PLACES}, ci AS (SELECT -120 + n_nationkey * 2.0::DOUBLE AS clon, 26 + n_nationkey * 0.8::DOUBLE AS clat FROM nation)
SELECT aoi_id, round(min(2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2))))), 5) AS city_km FROM pl, ci GROUP BY 1""")
def city_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cities = table(spark, sf_dir, "nation").select((-120 + F.col("n_nationkey") * 2.0).alias("lon"), (26 + F.col("n_nationkey") * 0.8).alias("lat"))
    return rounded(aoi.city_distance(customer_places(spark, sf_dir), cities).select("aoi_id", "city_km"), 5)


@query(f"""
WITH {PLACES}, k AS (SELECT 1 / 298.257222101 * (2 - 1 / 298.257222101) AS e2), s AS (SELECT aoi_id, lon, e2, sqrt(e2) AS e, sin(radians(lat)) AS s FROM pl, k),
q AS (SELECT aoi_id, 6378137.0 * sqrt(1.3491820315609693 - 0.602902769065759 * (1 - e2) * (s / (1 - e2 * s * s) - ln((1 - e * s) / (1 + e * s)) / (2 * e))) / 0.602902769065759 AS rho, 0.602902769065759 * radians(lon + 96) AS theta FROM s)
SELECT aoi_id, round(rho * sin(theta), 2) AS x, round(9928937.004248794 - rho * cos(theta), 2) AS y FROM q""")
def albers_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.albers(F.col("lon"), F.col("lat"))
    return rounded(customer_places(spark, sf_dir).select("aoi_id", x.alias("x"), y.alias("y")), 2)


@query()
def aoi_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.albers(F.col("lon"), F.col("lat"))
    # A small file is one task's: rows are dealt out, as bounds cost far more than their row.
    places = customer_places(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)
    return places.select("aoi_id", *geo.box_bounds(x, y, aoi.HALF))


@query("""
WITH g AS (SELECT event_id, value AS u, (event_id % 100)::DOUBLE AS v, sin(radians(38.5)) * radians(-120 + event_id % 50 + 97.5) AS a FROM events)
SELECT event_id, round(u * cos(a) + v * sin(a), 6) AS east, round(v * cos(a) - u * sin(a), 6) AS north FROM g""")
def wind_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    east, north = geo.wind_to_north(F.col("value"), (F.col("event_id") % 100).cast("double"), -120 + F.col("event_id") % 50, 38.5, -97.5)
    return rounded(table(spark, sf_dir, "events").select("event_id", east.alias("east"), north.alias("north")))


@query("""
WITH s AS (SELECT event_id, epoch_us(ts) + ((event_id % 360) - 180) * 240000000 AS us FROM events),
p AS (SELECT event_id, make_timestamp(us) AS t, (us % 86400000000) / 1000000.0 AS sec FROM s),
a AS (SELECT event_id, 2 * pi() * sec / 86400 AS d, 2 * pi() * (dayofyear(t) - 1 + sec / 86400) / CASE WHEN year(t) % 4 = 0 AND (year(t) % 100 <> 0 OR year(t) % 400 = 0) THEN 366 ELSE 365 END AS y FROM p)
SELECT event_id, round(sin(d), 6) AS day_sin, round(cos(d), 6) AS day_cos, round(sin(y), 6) AS year_sin, round(cos(y), 6) AS year_cos FROM a""")
def seasonal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "events").select("event_id", *times.seasonal_phases(F.col("ts"), (F.col("event_id") % 360 - 180).cast("double"))))


# --- rasters ---------------------------------------------------------------------------------------


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    west, south = e(0) * 90000, e(1) * 90000
    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 5).alias("key"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), west.alias("bx0"), (west + F.abs(e(2)) * 20000 + 1000).alias("bx1"), south.alias("by0"), (south + F.abs(e(3)) * 20000 + 1000).alias("by1"),
        e(4).alias("value"), F.abs(e(5)).alias("cloud"), F.when(F.col("vec_id") % 3 == 0, 1).otherwise(0).alias("flag"), F.abs(e(6)).alias("uncertainty"),
    )


@query("""
WITH p AS (SELECT vec_id % 5 AS key, embedding[1]::DOUBLE * 90000 AS bx0, embedding[1]::DOUBLE * 90000 + abs(embedding[3]::DOUBLE) * 20000 + 1000 AS bx1, embedding[2]::DOUBLE * 90000 AS by0, embedding[2]::DOUBLE * 90000 + abs(embedding[4]::DOUBLE) * 20000 + 1000 AS by1,
  embedding[5]::DOUBLE AS value, abs(embedding[6]::DOUBLE) AS cloud, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS flag, abs(embedding[7]::DOUBLE) AS unc FROM embeddings),
c AS (SELECT r.r AS row, c.c AS col, -36000 + c.c * 3000.0 AS x0, -36000 + (c.c + 1) * 3000.0 AS x1, 36000 - r.r * 3000.0 AS y1, 36000 - (r.r + 1) * 3000.0 AS y0 FROM range(24) r(r), range(24) c(c)),
o AS (SELECT *, greatest(0, least(bx1, x1) - greatest(bx0, x0)) * greatest(0, least(by1, y1) - greatest(by0, y0)) / 1e6 AS a, flag = 0 AND cloud <= 0.2 AS ok FROM p, c WHERE bx1 > x0 AND bx0 < x1 AND by1 > y0 AND by0 < y1)
SELECT key, row, col, count(*) AS native_count, round(sum(a), 6) AS total_area, round(sum(a * cloud) / sum(a), 6) AS cloud_mean, max(flag) AS worst_flag, round(coalesce(sum(a) FILTER (flag = 0), 0) / sum(a), 6) AS good_share,
  round(coalesce(sum(a) FILTER (ok), 0), 6) AS weight, count(*) FILTER (ok) AS accepted_count, round(sum(a * value) FILTER (ok) / sum(a) FILTER (ok), 6) AS value,
  round(coalesce(pow(sum(a) FILTER (ok), 2) / sum(a * a) FILTER (ok), 0), 6) AS n_eff, round(sum(a * unc) FILTER (ok) / sum(a) FILTER (ok), 6) AS uncertainty
FROM o WHERE a > 0 GROUP BY ALL""")
def tessellate_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = raster.touched_cells(pixels(spark, sf_dir)).withColumn("area", raster.rectangle_area())
    out = raster.tessellated(cells, ["key"]).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("value", "uncertainty")})
    return rounded(out.withColumns({c: F.col(c).cast("long") for c in ("row", "col")}))


@query()
def tessellate_quad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pixels with slanted sides."""
    lean = (F.col("bx1") - F.col("bx0")) / 4
    p = pixels(spark, sf_dir).withColumns({"cx": F.array(F.col("bx0"), F.col("bx1") - lean, F.col("bx1"), F.col("bx0") + lean), "cy": F.array("by0", "by0", "by1", "by1")})
    cells = raster.touched_cells(raster.with_bounds(p)).withColumn("area", raster.quad_area("cx", "cy", "x0", "y0", "x1", "y1"))
    return rounded(raster.tessellated(cells, ["key"]))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as rasters of 8 x 8, row by row, with gaps below -0.15."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    v = F.col("v").cast("double")
    return rows.select("vec_id", "pos", F.floor(F.col("pos") / 8).cast("int").alias("row"), (F.col("pos") % 8).alias("col"), v.alias("raw"), F.when(v >= -0.15, v).alias("value"))


IMAGES = "im AS (SELECT vec_id, pos::INT AS pos, (pos // 8)::INT AS row, (pos % 8)::INT AS col, v::DOUBLE AS raw, CASE WHEN v >= -0.15 THEN v::DOUBLE END AS value FROM (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding) AS v FROM embeddings))"


@query("""
WITH p AS (SELECT vec_id, embedding AS f, least(greatest((vec_id % 90) / 10.0 - 0.5, 0), 7)::DOUBLE AS fi, least(greatest((vec_id * 7 % 90) / 10.0 - 0.3, 0), 7)::DOUBLE AS fj FROM embeddings),
q AS (SELECT *, least(floor(fi), 6)::INT AS i, least(floor(fj), 6)::INT AS j FROM p)
SELECT vec_id, round((1 - fi + i) * (1 - fj + j) * f[i * 8 + j + 1] + (1 - fi + i) * (fj - j) * f[i * 8 + j + 2] + (fi - i) * (1 - fj + j) * f[i * 8 + j + 9] + (fi - i) * (fj - j) * f[i * 8 + j + 10], 6) AS value FROM q""")
def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    points = table(spark, sf_dir, "embeddings").select("vec_id", (v % 90 / 10.0 - 0.5).alias("fi"), (v * 7 % 90 / 10.0 - 0.3).alias("fj"))
    field = images(spark, sf_dir).select("vec_id", F.col("row").alias("i"), F.col("col").alias("j"), F.col("raw").alias("value"))
    return rounded(raster.bilinear(points, field, 8, 8, ["vec_id"]).select("vec_id", "value"))


@query(f"""
WITH {IMAGES}, s AS (SELECT vec_id // 4 AS record, vec_id % 4 AS t, avg((value IS NOT NULL)::INT) AS fraction, sum(abs(raw)) FILTER (value IS NOT NULL) AS cs, count(value) AS cn,
  sum(pos % 2) FILTER (value IS NOT NULL) AS qs, sum(raw) FILTER (value IS NOT NULL AND pos % 7 > 0) AS us, count(*) FILTER (value IS NOT NULL AND pos % 7 > 0) AS un FROM im GROUP BY ALL)
SELECT record, round(min(fraction), 6) AS min_fraction, coalesce(min(t) FILTER (fraction < 0.9), -1) AS failed_step, min(fraction) >= 0.9 AS complete, round(sum(cs) / sum(cn), 6) AS mean_cloud, round(sum(qs) / sum(cn), 6) AS mean_quality, round(sum(us) / sum(un), 6) AS mean_uncertainty
FROM s GROUP BY 1""")
def coverage_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images(spark, sf_dir).select(
        F.floor(F.col("vec_id") / 4).alias("record"), (F.col("vec_id") % 4).alias("t"), F.coalesce("value", F.lit(float("nan"))).alias("value"), F.abs("raw").alias("cloud"), (F.col("pos") % 2).cast("double").alias("quality"),
        F.when(F.col("pos") % 7 == 0, float("nan")).otherwise(F.col("raw")).alias("uncertainty"),
    )
    return rounded(raster.coverage_features(rows).withColumn("failed_step", F.coalesce("failed_step", F.lit(-1).cast("long"))))


def _line(along: str, across: str) -> str:
    w = f"PARTITION BY vec_id, {across} ORDER BY {along}"
    a, b = (f"{f}(CASE WHEN value IS NOT NULL THEN {{x}} END IGNORE NULLS) OVER ({w} ROWS BETWEEN {r})" for f, r in (("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"), ("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING")))
    return ", ".join(f"{s.format(x=x)} AS {along}_{n}{k}" for n, s in (("a", a), ("b", b)) for k, x in (("p", along), ("v", "value")))


def _between(along: str) -> str:
    return f"coalesce({along}_av + ({along}_bv - {along}_av) * ({along} - {along}_ap) / nullif({along}_bp - {along}_ap, 0)::DOUBLE, {along}_av, {along}_bv, mean)"


@query(f"""
WITH {IMAGES}, l AS (SELECT vec_id, row, col, value, avg(value) OVER (PARTITION BY vec_id) AS mean, {_line("col", "row")}, {_line("row", "col")} FROM im)
SELECT vec_id, row, col, round(coalesce(value, ({_between("col")} + {_between("row")}) / 2), 6) AS filled FROM l""")
def gap_fill_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.gap_filled(images(spark, sf_dir).select("vec_id", "row", "col", "value"), ["vec_id"]).select("vec_id", "row", "col", "filled"))


def channel_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select((F.col("pos") % 4).alias("channel"), F.coalesce("value", F.lit(float("nan"))).alias("value"))


STATS = f"""
{IMAGES}, st AS (SELECT pos % 4 AS channel, count(*) AS count, CASE WHEN pos % 4 = 0 THEN median(value) ELSE avg(value) END AS center,
  CASE WHEN pos % 4 = 0 THEN (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349 ELSE stddev_pop(value) END AS scale FROM im WHERE value IS NOT NULL GROUP BY 1)"""


@query(f"WITH {STATS} SELECT channel, count, round(center, 6) AS center, round(scale, 6) AS scale FROM st")
def image_norm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(normalization.channel_stats(channel_values(spark, sf_dir), robust=(0,)))


@query(f"WITH {STATS} SELECT channel, round(avg((abs((value - center) / scale) > 1.5)::INT), 6) AS clipped FROM im JOIN st ON st.channel = pos % 4 WHERE value IS NOT NULL GROUP BY 1")
def clip_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = channel_values(spark, sf_dir)
    return rounded(normalization.clipped_share(values, normalization.channel_stats(values, robust=(0,)), clip=1.5))


# --- plans -----------------------------------------------------------------------------------------


@query("""
WITH n AS (SELECT event_type AS split, count(*) AS n FROM events GROUP BY 1), r AS (SELECT split, n, unnest(range(0, (n - 1) // 70 + 1)) AS k FROM n)
SELECT split, k * 70 AS first, least((k + 1) * 70, n) AS end, row_number() OVER (ORDER BY split, k) - 1 AS shard FROM r""")
def shard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.shard_ranges(table(spark, sf_dir, "events").select(F.col("event_type").alias("split")), "split", 70).withColumn("shard", F.col("shard").cast("long"))


@query("""
WITH i AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey % 7 <> 3 AND o_totalprice > 20000), g AS (SELECT id, id - row_number() OVER (ORDER BY id) AS g FROM i)
SELECT min(id) AS first, max(id) AS last FROM g GROUP BY g""")
def id_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.id_ranges(table(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 3 and o_totalprice > 20000").select(F.col("o_orderkey").alias("id")))


@query("SELECT DISTINCT user_id AS key FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def cache_miss_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))
    return work.missing_work(table(spark, sf_dir, "events").select(F.col("user_id").alias("key")), cache)


@query("""
WITH u AS (SELECT event_id, 1 AS e, 0 AS o FROM events WHERE event_id % 11 > 0 UNION ALL SELECT event_id, 0, 1 FROM events WHERE event_id % 3 > 0 UNION ALL SELECT event_id, 0, 1 FROM events WHERE event_id % 4 = 0),
n AS (SELECT event_id, sum(e)::BIGINT AS expected, sum(o)::BIGINT AS outcomes FROM u GROUP BY 1)
SELECT * FROM (SELECT *, CASE WHEN expected = 0 THEN 'unexpected' WHEN outcomes = 0 THEN 'no outcome' WHEN outcomes > 1 THEN 'several outcomes' WHEN expected > 1 THEN 'repeated' END AS problem FROM n) WHERE problem IS NOT NULL""")
def outcome_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return work.reconciled(e.filter("event_id % 11 > 0"), e.filter("event_id % 3 > 0"), e.filter("event_id % 4 = 0"), "event_id")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, event_id DESC, event_type DESC) = 1")
def validity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return work.upserted([e.filter(F.col("event_id") % 3 == i) for i in range(3)], "user_id")


@query("""
SELECT event_type AS split, event_id AS candidate_index, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS new_index FROM events
WHERE event_type IN ('click', 'view') QUALIFY new_index < CASE event_type WHEN 'click' THEN 120 ELSE 35 END""")
def candidate_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("split"), F.col("event_id").alias("candidate_index"))
    return work.trimmed(rows, {"click": 120, "view": 35}).withColumn("new_index", F.col("new_index").cast("long"))


# --- metrics ---------------------------------------------------------------------------------------


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("aoi_id"), "event_id", "value", F.least(F.floor(F.col("value") / 120), F.lit(2)).cast("int").alias("truth"), (e * 7 % 3).cast("int").alias("predicted"),
        (F.floor("value") % 50).alias("s0"), (e % 40).alias("s1"), (e * 13 % 60).alias("s2"),
    )


PRED = "pred AS (SELECT user_id AS aoi_id, event_id, value, least(floor(value / 120), 2)::INT AS truth, (event_id * 7 % 3)::INT AS predicted, floor(value)::BIGINT % 50 AS s0, event_id % 40 AS s1, event_id * 13 % 60 AS s2 FROM events)"


def _metrics_sql(by: str) -> str:
    n = lambda c: f"count(*) FILTER ({c})"
    recall = [f"{n(f'truth = {k} AND predicted = {k}')} / nullif({n(f'truth = {k}')}, 0)::DOUBLE" for k in range(3)]
    f1 = [f"coalesce(2.0 * {n(f'truth = {k} AND predicted = {k}')} / nullif({n(f'truth = {k}')} + {n(f'predicted = {k}')}, 0), 0)" for k in range(3)]
    present = " + ".join(f"({n(f'truth = {k}')} > 0)::INT" for k in range(3))
    seen = " + ".join(f"({n(f'truth = {k}')} + {n(f'predicted = {k}')} > 0)::INT" for k in range(3))
    recalls = " + ".join(f"coalesce({r}, 0)" for r in recall)
    each = ", ".join(f"round({r}, 6) AS recall_{k}" for k, r in enumerate(recall))
    return f"WITH {PRED} SELECT {by} count(*) AS n, round(avg((truth = predicted)::INT), 6) AS accuracy, round(({recalls}) / ({present}), 6) AS balanced_accuracy, round(({' + '.join(f1)}) / ({seen}), 6) AS macro_f1, {each} FROM pred {'GROUP BY 1' if by else ''}"


@query(_metrics_sql(""))
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.classification_metrics(predictions(spark, sf_dir)))


@query(_metrics_sql("aoi_id,"))
def metrics_by_aoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.classification_metrics(predictions(spark, sf_dir), by=["aoi_id"]))


@query(f"""
WITH {PRED}, l AS (SELECT unnest([0, 1, 2]) AS class, unnest([s0, s1, s2]) AS score, truth FROM pred),
r AS (SELECT class, truth = class AS pos, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0 AS r FROM l),
a AS (SELECT class, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS q, sum(r) FILTER (pos) AS s FROM r GROUP BY 1)
SELECT round(avg((s - p * (p + 1) / 2.0) / (p::DOUBLE * q)), 6) AS macro_auroc FROM a""")
def ovr_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auroc(predictions(spark, sf_dir), ["s0", "s1", "s2"]))


@query(f"""
WITH {PRED}, u AS (SELECT aoi_id, median(value) AS v FROM pred GROUP BY 1),
k AS (SELECT *, (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0) / count(*) OVER () AS share FROM u),
s AS (SELECT aoi_id, v, CASE WHEN share <= 1 / 3.0::DOUBLE THEN 'Low' WHEN share <= 2 / 3.0::DOUBLE THEN 'Middle' ELSE 'High' END AS stratum FROM k)
SELECT stratum, count(DISTINCT aoi_id) AS units, count(*) AS records, round(min(v), 6) AS value_min, round(max(v), 6) AS value_max, round(avg((truth = predicted)::INT), 6) AS accuracy FROM pred JOIN s USING (aoi_id) GROUP BY 1""")
def tertile_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.accuracy_by_tertile(predictions(spark, sf_dir), "value"))


@query(f"WITH {PRED}, k AS (SELECT t.t AS truth, p.p AS predicted FROM (VALUES (0), (1), (2)) t(t), (VALUES (0), (1), (2)) p(p)) SELECT truth, predicted, count(event_id) AS n FROM k LEFT JOIN pred USING (truth, predicted) GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(predictions(spark, sf_dir))


@query("""
WITH f AS (SELECT event_id % 7 - 3 AS a, event_id % 11 - 5 AS b FROM events WHERE event_id % 4 = 0)
SELECT count(*) AS n, round(avg(abs(a)), 6) AS a_mae, round(sqrt(avg(a * a)), 6) AS a_rmse, round(avg(a), 6) AS a_bias, round(avg(abs(b)), 6) AS b_mae, round(sqrt(avg(b * b)), 6) AS b_rmse, round(avg(b), 6) AS b_bias, round(1 - avg(abs(a)) / avg(abs(b)), 6) AS mae_gain FROM f""")
def reconstruction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("value").alias("target"), (F.col("value") + e % 7 - 3).alias("a"), (F.col("value") + e % 11 - 5).alias("b"), F.when(e % 4 == 0, 1).otherwise(0).alias("hidden"))
    return rounded(metrics.reconstruction(rows, ["a", "b"]))
