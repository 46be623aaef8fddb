"""Grid pyramids in long form: a row per populated cell, never a raster object.

A cell of tile (z, x, y) with 2**bits cells a side is the tile grid at zoom z + bits.  All coarser levels come
from one explode over the zooms and one aggregation, instead of a shuffle a level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text


@dataclass(frozen=True)
class Grid:
    """base_zoom: finest tile zoom; cells: cells a side, a power of two."""

    base_zoom: int
    cells: int

    @property
    def bits(self) -> int:
        return self.cells.bit_length() - 1


HISTOGRAM = Grid(10, 128)
FOOTPRINT = Grid(14, 512)
KEEP_SEQUENCES = 1000


def points_to_cells(points: DataFrame, grid: Grid, *keep: str, value: Column | None = None) -> DataFrame:
    """keep, gx, gy (cell in the whole grid at base zoom), value; null, NaN and out-of-range points go."""
    deep = grid.base_zoom + grid.bits
    ok = points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lon") & ~F.isnan("lat"))
    x, y = geo.tile_x(F.col("lon"), deep), geo.tile_y(F.col("lat"), deep)
    cells = ok.select(*keep, x.alias("gx"), y.alias("gy"), (F.lit(1) if value is None else value).cast("long").alias("value"))
    return cells.where(geo.in_grid(F.col("gx"), F.col("gy"), deep))


def facet_rows(points: DataFrame, facets: list[str]) -> DataFrame:
    """Each point once plain (value 1) and once per positive facet, keyed ``key:facet``."""
    plain = F.struct(F.col("key").cast("string").alias("key"), F.lit(1).cast("long").alias("value"))
    each = [F.struct(text.facet_key(F.col("key").cast("string"), F.lit(f)).alias("key"), F.col(f).cast("long").alias("value")) for f in facets]
    rest = [c for c in points.columns if c not in ("key", *facets)]
    return points.select(*rest, F.explode(F.array(plain, *each)).alias("f")).select(*rest, "f.key", "f.value").where("value > 0")


def rasterize(cells: DataFrame, *keys: str) -> DataFrame:
    return cells.groupBy(*keys, "gx", "gy").agg(F.sum("value").cast("long").alias("value"))


def pyramid(cells: DataFrame, grid: Grid, *keys: str, zooms: list[int] | None = None) -> DataFrame:
    """keys, z, x, y, cell (Z-order code in the tile), value, for every zoom from the base up."""
    zooms = list(range(grid.base_zoom + 1)) if zooms is None else zooms
    base = rasterize(cells, *keys)  # combine once before fanning out over the zooms
    fanned = _climb(base, grid, zooms, *keys)
    return _placed(rasterize(fanned, *keys, "z"), grid, *keys).where("value > 0")


def _climb(cells: DataFrame, grid: Grid, zooms: list[int], *keys: str) -> DataFrame:
    shift = lambda c: F.expr(f"shiftright({c}, {grid.base_zoom} - z)")
    fanned = cells.withColumn("z", F.explode(F.array(*[F.lit(z) for z in zooms if z <= grid.base_zoom])))
    return fanned.select(*keys, "z", shift("gx").alias("gx"), shift("gy").alias("gy"), "value")


def _placed(cells: DataFrame, grid: Grid, *keys: str) -> DataFrame:
    mask = F.lit(grid.cells - 1)
    return cells.select(
        *keys, F.col("z").cast("int"), F.shiftright("gx", grid.bits).alias("x"), F.shiftright("gy", grid.bits).alias("y"),
        geo.zorder(F.col("gx").bitwiseAND(mask), F.col("gy").bitwiseAND(mask), grid.bits).alias("cell"), "value",
    )


def fan_out(cells: DataFrame, grid: Grid, zooms: list[int], *keys: str) -> DataFrame:
    """keys, z, x, y, cell, value: every cell (gx, gy) once at each zoom, not yet added up."""
    return _placed(_climb(cells, grid, zooms, *keys), grid, *keys)


def vectorize(cells: DataFrame) -> DataFrame:
    """One row per cell with its values by key (the feature of a vector tile)."""
    return cells.groupBy("z", "x", "y", "cell").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("key").cast("string"), "value")))).alias("values"))


def tile_counts(cells: DataFrame, *keys: str) -> DataFrame:
    """Cells and total by tile: what a run reports."""
    return cells.groupBy(*keys, "z", "x", "y").agg(F.countDistinct("cell").alias("count"), F.sum("value").cast("long").alias("total"))


def uncommitted(rows: DataFrame, committed: DataFrame) -> DataFrame:
    """Rows whose sequence a tile does not hold yet."""
    return rows.join(committed.select("z", "x", "y", "sequence"), ["z", "x", "y", "sequence"], "left_anti")


def merge_cells(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Both tables added cell by cell: existing counts of a day grow."""
    cols = [*keys, "z", "x", "y", "cell"]
    return old.select(*cols, "value").unionByName(new.select(*cols, "value")).groupBy(*cols).agg(F.sum("value").cast("long").alias("value"))


def totals_by_facet(cells: DataFrame) -> DataFrame:
    """Per tile and facet (null: all edits): the sum and the last day with an edit."""
    day = text.base_key(F.col("key").cast("string")).cast("int")
    return cells.select("z", "x", "y", text.facet_of(F.col("key").cast("string")).alias("facet"), day.alias("day"), "value").groupBy("z", "x", "y", "facet").agg(F.sum("value").cast("long").alias("total"), F.max("day").alias("last_day"))


def remember_sequences(old: Column, new: Column, keep: int = KEEP_SEQUENCES) -> Column:
    """Set union of two sequence arrays, the newest ``keep``."""
    union = F.array_sort(F.array_union(F.coalesce(old, F.array().cast("array<long>")), F.coalesce(new, F.array().cast("array<long>"))))
    return F.slice(union, F.greatest(F.size(union) - keep + 1, F.lit(1)), keep)


def newest_sequences(committed: DataFrame, keep: int = KEEP_SEQUENCES) -> DataFrame:
    """z, x, y, sequence: the newest ``keep`` of every tile."""
    newest = Window.partitionBy("z", "x", "y").orderBy(F.desc("sequence"))
    return committed.select("z", "x", "y", "sequence").withColumn("n", F.row_number().over(newest)).where(F.col("n") <= keep).drop("n")


def contents(rows: DataFrame, feature: str, largest: str | None = None) -> DataFrame:
    """z, x, y, features: what a tile holds, in order, or those with the largest measure first."""
    order = F.array_sort(F.collect_list(F.struct((-F.col(largest)).alias("m"), feature) if largest else F.struct(feature)))
    return rows.groupBy("z", "x", "y").agg(F.transform(order, lambda e: e[feature]).alias("features"))


def load(table: DataFrame, asked: DataFrame) -> DataFrame:
    """The tiles (z, x, y) of a list with their contents, null where the table has none."""
    return asked.select("z", "x", "y").distinct().join(table, ["z", "x", "y"], "left")


def bundles(table: DataFrame, zoom: int, levels: int) -> DataFrame:
    """bundle, tiles: the tiles of one zoom in Z order, those under one tile ``levels`` zooms up together."""
    placed = table.where(F.col("z") == zoom).withColumn("code", geo.zorder(F.col("x"), F.col("y"), zoom))
    inside = F.array_sort(F.collect_list(F.struct("code", "x", "y", "features")))
    return placed.groupBy(F.shiftright("code", 2 * levels).alias("bundle")).agg(inside.alias("tiles"))


def newest_first(features: DataFrame) -> DataFrame:
    """z, x, y, features: the cells of ``vectorize`` by their last day, newest first, with that day; values as entries."""
    day = F.array_max(F.transform(F.map_keys("values"), lambda k: text.base_key(k).cast("int")))
    ordered = F.array_sort(F.collect_list(F.struct((-day).alias("order"), "cell", day.alias("last_day"), F.map_entries("values").alias("values"))))
    return features.groupBy("z", "x", "y").agg(ordered.alias("features"))
