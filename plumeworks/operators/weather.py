"""Wind and temperature of gridded fields at the cells of areas' grids: fields are dealt out in tiles, and no task holds a whole field."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..tables import materialized
from .raster import CELL, SIZE

#: Field cells along a tile's side, and areas of a tile that one task samples at once.
TILE, AREAS = 64, 256


@dataclass(frozen=True)
class ConicGrid:
    """A regular grid on a spherical conformal conic of one standard parallel: its first point's place, spacing in metres, rows northward and columns eastward."""

    parallel: float
    lon_0: float
    x_first: float
    y_first: float
    dx: float
    dy: float
    rows: int
    cols: int
    radius: float = 6371229.0

    @classmethod
    def from_first_point(cls, lon: float, lat: float, **rest) -> ConicGrid:
        """The grid whose first point has this longitude and latitude."""
        radius, n = rest.get("radius", cls.radius), math.sin(math.radians(rest["parallel"]))
        tan = lambda p: math.tan(math.radians(p) / 2 + math.pi / 4)
        f = math.cos(math.radians(rest["parallel"])) * tan(rest["parallel"]) ** n / n
        rho, theta = radius * f / tan(lat) ** n, n * math.radians((lon - rest["lon_0"] + 180) % 360 - 180)
        return cls(x_first=rho * math.sin(theta), y_first=radius * f / tan(rest["parallel"]) ** n - rho * math.cos(theta), **rest)

    def place(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Fractional row and column of a point."""
        x, y = geo.lambert(lon, lat, self.parallel, self.lon_0, self.radius)
        return (y - self.y_first) / self.dy, (x - self.x_first) / self.dx


def cell_centres(areas: DataFrame, size: int = SIZE, cell: float = CELL) -> DataFrame:
    """Adds cell (row by row from the north), and cx, cy, lon, lat of each cell's centre; areas have a projected centre x, y."""
    half = size * cell / 2
    rows = areas.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))))
    rows = rows.withColumns({"cx": F.col("x") - half + (F.col("cell") % size + 0.5) * cell, "cy": F.col("y") + half - (F.floor(F.col("cell") / size) + 0.5) * cell})
    lon, lat = geo.albers_inverse(F.col("cx"), F.col("cy"))
    return rows.withColumns({"lon": lon, "lat": lat})


SAMPLED = pa.schema([("key", pa.string()), ("cell", pa.int32()), ("lon", pa.float64()), ("u", pa.float64()), ("v", pa.float64()), ("t", pa.float64())])
SAMPLED_DDL = "key string, cell int, lon double, u double, v double, t double"


def sampled(tile: int):
    """Bilinear samples of a tile's fields at the points in it; a cell that the field lacks gives NaN."""

    def run(field: pa.Table, points: pa.Table) -> pa.Table:
        if not points.num_rows:
            return SAMPLED.empty_table()
        i0, j0 = points.column("ti")[0].as_py() * tile, points.column("tj")[0].as_py() * tile
        fi, fj = points.column("fi").to_numpy() - i0, points.column("fj").to_numpy() - j0
        i, j = points.column("i").to_numpy() - i0, points.column("j").to_numpy() - j0
        at = (field.column("i").to_numpy() - i0, field.column("j").to_numpy() - j0)
        out = {}
        for name in ("u", "v", "t"):
            grid = np.full((tile + 1, tile + 1), math.nan)
            grid[at] = field.column(name).to_numpy()
            a, b = fi - i, fj - j
            corners = [(grid[i + di, j + dj], (a if di else 1 - a) * (b if dj else 1 - b)) for di in (0, 1) for dj in (0, 1)]
            # A corner without weight may be missing.
            out[name] = sum(np.where(w == 0, 0.0, g * w) for g, w in corners)
        return pa.table({"key": points.column("key"), "cell": points.column("cell"), "lon": points.column("lon")} | out, schema=SAMPLED)

    return run


def aligned(requests: DataFrame, fields: DataFrame, grid: ConicGrid, *, size: int = SIZE, cell: float = CELL, tile: int = TILE, areas: int = AREAS) -> DataFrame:
    """key, cell, u, v, t: eastward and northward wind and temperature at the centre of each cell of each request's grid, bilinear, held at the field's edges.

    requests: key (text, once each), path, x, y (the projected centre, in metres). fields: path, i, j (row northward, column
    eastward, once each), u, v (along the grid's axes), t. Cells where the field lacks a neighbour, or all where its file isn't there, are NaN.

    A field's cells go to tiles, those of a border to the tiles on both sides, and points to the tile that
    holds their four neighbours; a tile that very many areas share is sampled in parts. Requests of the same file and centre are
    sampled once.
    """
    clamp = lambda v, n: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(n - 1)))
    asked = requests.select("key", "path", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    one = ["path", "x", "y"]
    firsts = materialized(asked.groupBy(*one).agg(F.min("key").alias("_first")), "weather-requests")
    keys = asked.join(firsts, [asked[c].eqNullSafe(firsts[c]) for c in one]).select("key", "_first")
    asked = firsts.select(F.col("_first").alias("key"), *one)
    points = cell_centres(asked, size, cell)
    fi, fj = grid.place(F.col("lon"), F.col("lat"))
    points = points.withColumns({"fi": clamp(fi, grid.rows), "fj": clamp(fj, grid.cols)})
    points = points.withColumns({"i": F.least(F.floor("fi"), F.lit(grid.rows - 2)).cast("int"), "j": F.least(F.floor("fj"), F.lit(grid.cols - 2)).cast("int")})
    points = points.withColumns({"ti": F.floor(F.col("i") / tile).cast("int"), "tj": F.floor(F.col("j") / tile).cast("int")})
    points = materialized(points.select("key", "path", "cell", "lon", "fi", "fj", "i", "j", "ti", "tj"), "weather-points")
    by = ["path", "ti", "tj"]
    tiles = materialized(points.groupBy(*by).agg(F.ceil(F.count("*") / (areas * size * size)).cast("int").alias("parts")), "weather-tiles")
    own = lambda k: F.floor(F.col(k) / tile).cast("int")
    border = lambda k: F.explode(F.when((F.col(k) % tile == 0) & (F.col(k) > 0), F.array(own(k) - 1, own(k))).otherwise(F.array(own(k))))
    cells = fields.select("path", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), *(F.col(c).cast("double").alias(c) for c in ("u", "v", "t")))
    cells = cells.withColumn("ti", border("i")).withColumn("tj", border("j")).join(tiles, by).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = points.join(tiles.withColumnRenamed("parts", "_parts"), by).withColumn("part", F.pmod(F.xxhash64("key"), F.col("_parts")).cast("int")).drop("_parts")
    key = [*by, "part"]
    found = cells.select(*key, "i", "j", "u", "v", "t").groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(sampled(tile), SAMPLED_DDL)
    east, north = geo.wind_to_north(F.col("u"), F.col("v"), F.col("lon"), grid.parallel, grid.lon_0)
    sampled_once = materialized(found.select(F.col("key").alias("_first"), "cell", east.alias("u"), north.alias("v"), "t"), "weather-cells")
    return keys.join(sampled_once, "_first").drop("_first")


def as_rasters(found: DataFrame, size: int = SIZE) -> DataFrame:
    """key and arrays u, v, t of size * size cells in order, and `error` where a cell has no value."""
    cells = F.array_sort(F.collect_list(F.struct("cell", "u", "v", "t")))
    rows = found.groupBy("key").agg(cells.alias("_c"))
    rasters = rows.select("key", *(F.col(f"_c.{c}").alias(c) for c in ("u", "v", "t")))
    whole = F.lit(True)
    for c in ("u", "v", "t"):
        whole &= (F.size(c) == size * size) & F.forall(c, lambda x: ~F.isnan(x))
    return rasters.withColumn("error", F.when(~whole, "the field has gaps"))
