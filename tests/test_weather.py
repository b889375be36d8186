"""Weather on the areas' grids, against numbers worked out point by point."""

import datetime as dt
import math

import numpy as np
import pytest
from plumeworks.functions import geo
from plumeworks.operators import mapping, weather
from pyspark.sql import functions as F

GRID = weather.ConicGrid.from_first_point(-97.0, 36.5, parallel=38.5, lon_0=-97.5, dx=12000.0, dy=12000.0, rows=14, cols=15)


def field(path, lack=()):
    rng = np.random.default_rng(len(path))
    return [(path, i, j, float(rng.random()), float(rng.random()), 280 + i + j / 10) for i in range(GRID.rows) for j in range(GRID.cols) if (i, j) not in lack]


@pytest.fixture(scope="module")
def fields(spark):
    return spark.createDataFrame(field("a") + field("bb", lack={(5, 5)}), "path string, i int, j int, u double, v double, t double")


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, path string, x double, y double")


def by_cell(frame):
    return {(r["key"], r["cell"]): (r["u"], r["v"], r["t"]) for r in frame.collect()}


def test_first_point_is_row_and_column_0(spark):
    i, j = GRID.place(F.lit(-97.0), F.lit(36.5))
    assert spark.range(1).select(i, j).first() == pytest.approx((0, 0), abs=1e-9)


def test_each_point_by_hand(spark, fields):
    asked = requests(spark, ("k", "a", 10000.0, 1590000.0))
    got = by_cell(weather.aligned(asked, fields, GRID, tile=4))
    values = {(i, j): (u, v, t) for _, i, j, u, v, t in field("a")}
    points = weather.cell_centres(asked)
    fi, fj = GRID.place(F.col("lon"), F.col("lat"))
    assert len(got) == 576
    for r in points.select("cell", "lon", fi.alias("fi"), fj.alias("fj")).collect():
        a, b = min(max(r["fi"], 0), GRID.rows - 1), min(max(r["fj"], 0), GRID.cols - 1)
        i, j = min(int(a), GRID.rows - 2), min(int(b), GRID.cols - 2)
        mix = [sum(values[i + p, j + q][k] * (a - i if p else 1 - a + i) * (b - j if q else 1 - b + j) for p in (0, 1) for q in (0, 1)) for k in range(3)]
        turn = math.sin(math.radians(38.5)) * math.radians(r["lon"] + 97.5)
        want = (mix[0] * math.cos(turn) + mix[1] * math.sin(turn), mix[1] * math.cos(turn) - mix[0] * math.sin(turn), mix[2])
        assert got["k", r["cell"]] == pytest.approx(want, rel=1e-9)


def test_tiles_and_parts_change_nothing(spark, fields):
    asked = requests(spark, *((f"k{n}", "a", n * 9000.0 - 30000, 1580000.0 + n * 5000) for n in range(7)), ("far", "a", 9e5, 2.5e6))
    plain = by_cell(weather.aligned(asked, fields, GRID))
    assert plain == by_cell(weather.aligned(asked, fields, GRID, tile=3, areas=1)) and len(plain) == 8 * 576
    edge = {plain["far", c][2] for c in range(576)}
    assert all(280 <= t <= 280 + 13 + 1.4 for t in edge)


def test_gaps_are_errors(spark, fields):
    asked = requests(spark, ("whole", "a", 10000.0, 1590000.0), ("gap", "bb", 10000.0, 1590000.0), ("none", "zzz", 10000.0, 1590000.0))
    got = {r["key"]: r for r in weather.as_rasters(weather.aligned(asked, fields, GRID, tile=5)).collect()}
    assert got["whole"]["error"] is None and len(got["whole"]["t"]) == 576
    assert got["gap"]["error"] == "the field has gaps" and any(not math.isnan(t) for t in got["gap"]["t"])
    assert got["none"]["error"] == "the field has gaps" and all(math.isnan(t) for t in got["none"]["t"])


def test_centres_go_east_and_south(spark):
    rows = weather.cell_centres(requests(spark, ("k", "a", 100.0, 200.0)), 2, 10.0).orderBy("cell").collect()
    assert [(r["cx"], r["cy"]) for r in rows] == [(95, 205), (105, 205), (95, 195), (105, 195)]
    x, y = geo.albers(F.lit(rows[0]["lon"]), F.lit(rows[0]["lat"]))
    assert spark.range(1).select(x, y).first() == pytest.approx((95, 205), abs=1e-5)


def test_scans_over_days_and_midnight(spark):
    """As one loop over each number's files gives them, breaks of half an hour and more apart."""
    rng, start = np.random.default_rng(8), dt.datetime(2024, 1, 1, 22)
    rows = []
    for scan_num in (1, 2, None):
        at = start
        for k in range(150):
            at += dt.timedelta(minutes=int(rng.choice([0, 5, 30, 31, 200, 1500], p=[0.05, 0.55, 0.15, 0.1, 0.1, 0.05])))
            rows.append((scan_num, f"g{k:03}", at, at + dt.timedelta(minutes=int(rng.choice([1, 5, 90])))))
    want = []
    for scan_num in (1, 2, None):
        held, latest = [], None
        for r in sorted((r for r in rows if r[0] == scan_num), key=lambda r: (r[2], r[1])):
            if latest is not None and r[2] - latest > dt.timedelta(minutes=30):
                want.append((scan_num, held))
                held, latest = [], None
            held.append(r)
            latest = r[3] if latest is None else max(latest, r[3])
        want.append((scan_num, held))
    want = sorted(((n or 0, h[0][2], max(r[3] for r in h), [r[1] for r in h]) for n, h in want), key=str)
    frame = spark.createDataFrame(rows, "scan_num int, granule string, start timestamp_ntz, end timestamp_ntz").repartition(5)
    got = mapping.scans(frame).collect()
    assert sorted(((r["scan_num"] or 0, r["scan_start"], r["scan_end"], r["granules"]) for r in got), key=str) == want
    assert any(s.date() != e.date() for _, s, e, _ in want)
