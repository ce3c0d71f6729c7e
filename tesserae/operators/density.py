"""Sparse density histograms, their pyramid, prefix sums, and what is decided from them.

A histogram is a table (row, col, cnt) at some zoom: row 0 is north, so (row, col)
is the tile (y, x).  Cells count vertices.  Nothing dense is made but at the sink.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import mercator as M
from ..functions import wkb


def vertices(features: DataFrame, geometry: str = "geometry") -> DataFrame:
    """(lon, lat) of every vertex: whole Arrow columns from each batch of geometries, without a row or list in between."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            xy = wkb.Batch(batch.column(0).to_pandas()).xy
            for i in range(0, len(xy), 1 << 20):
                part = np.ascontiguousarray(xy[i : i + (1 << 20)].T)
                yield pa.record_batch({"lon": pa.array(part[0]), "lat": pa.array(part[1])})

    return features.select(geometry).mapInArrow(run, "lon double, lat double")


def histogram(points: DataFrame, zoom: int, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Counts of points (lon, lat) by cell at ``zoom``: one aggregation that combines before its shuffle."""
    ok = points.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    x, y = M.cell(M.mercator_x(F.col(lon)), M.mercator_y(F.col(lat)), M.check_zoom(zoom))
    return ok.groupBy(y.alias("row"), x.alias("col")).agg(F.count("*").alias("cnt"))


def pyramid(cells: DataFrame, zoom: int, lowest: int = 0) -> DataFrame:
    """(z, row, col, cnt) of all zooms down to ``lowest`` by adding up cells, not points."""
    z = F.explode(F.sequence(F.lit(lowest), F.lit(zoom))).alias("z")
    x = cells.select(z, "row", "col", "cnt")
    # shiftright takes a number, so divide by the power of two
    scale = F.pow(F.lit(2.0), F.lit(zoom) - F.col("z"))
    return x.groupBy("z", F.floor(F.col("row") / scale).cast("int").alias("row"), F.floor(F.col("col") / scale).cast("int").alias("col")).agg(F.sum("cnt").alias("cnt"))


def nonempty_tiles(cells: DataFrame, zoom: int, threshold: float, max_zoom: int) -> DataFrame:
    """Tiles (z, row, col) that reach the threshold.  Below the histogram's zoom, those whose
    parent cell holds threshold * 4^(levels); each cell's children are made only there."""
    upper = pyramid(cells, zoom).filter(F.col("cnt") >= threshold)
    out = upper.filter(F.col("z") <= max_zoom).select("z", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    if max_zoom > zoom:
        deep = cells.withColumn("z", F.explode(F.sequence(F.lit(zoom + 1), F.lit(max_zoom))))
        scale = F.pow(F.lit(2.0), F.col("z") - zoom)
        deep = deep.filter(F.col("cnt") >= threshold * scale * scale)
        n = scale.cast("long")
        deep = deep.withColumn("row", F.explode(F.sequence(F.col("row") * n, F.col("row") * n + n - 1))).withColumn("col", F.explode(F.sequence(F.col("col") * n, F.col("col") * n + n - 1)))
        out = out.unionByName(deep.select("z", "row", "col"))
    return out


def occupancy(cells: DataFrame, zoom: int, threshold: float, max_zoom: int) -> DataFrame:
    """(z, tiles, share of 4^z).  Deeper than the histogram only counts are made."""
    share = F.col("tiles") / F.pow(F.lit(4.0), F.col("z"))
    upper = pyramid(cells, zoom).filter((F.col("cnt") >= threshold) & (F.col("z") <= max_zoom)).groupBy("z").agg(F.count("*").alias("tiles"))
    if max_zoom > zoom:
        z = cells.withColumn("z", F.explode(F.sequence(F.lit(zoom + 1), F.lit(max_zoom))))
        four = F.pow(F.lit(4.0), F.col("z") - zoom)
        deep = z.filter(F.col("cnt") >= threshold * four).groupBy("z").agg(F.sum(four.cast("long")).alias("tiles"))
        upper = upper.unionByName(deep)
    return upper.withColumn("share", share)


def auto_zoom(cells: DataFrame, zoom: int, threshold: float, max_zoom: int, least_share: float = 0.01) -> int:
    """The zoom before the first, from the histogram's own on, whose share of tiles falls below ``least_share``."""
    shares = {r["z"]: r["share"] for r in occupancy(cells, zoom, threshold, max_zoom).filter(F.col("z") >= zoom).collect()}  # a row a zoom
    for z in range(zoom, max_zoom + 1):
        if shares.get(z, 0.0) < least_share:
            return max(0, z - 1)
    return max_zoom


def prefix_sum(cells: DataFrame) -> DataFrame:
    """The inclusive two-dimensional running sum at every cell of the grid's used rows and columns.

    Rows first, then columns of the row sums: each window is partitioned, so no
    single task holds the table."""
    rows, cols = cells.select("row").distinct(), cells.select("col").distinct()
    across = W.partitionBy("row").orderBy("col").rowsBetween(W.unboundedPreceding, W.currentRow)
    down = W.partitionBy("col").orderBy("row").rowsBetween(W.unboundedPreceding, W.currentRow)
    # the used columns are one array (a scalar subquery) of no more numbers than the grid is wide
    full = rows.select("row", F.explode(cols.agg(F.collect_set("col")).scalar()).alias("col"))
    x = full.join(cells, ["row", "col"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    return x.withColumn("r", F.sum("cnt").over(across)).withColumn("prefix", F.sum("r").over(down)).select("row", "col", "cnt", "prefix")


def inverse_prefix(prefix: DataFrame, value: str = "prefix") -> DataFrame:
    """The cells whose running sum ``prefix`` is."""
    across, down = W.partitionBy("row").orderBy("col"), W.partitionBy("col").orderBy("row")
    x = prefix.withColumn("d", F.col(value) - F.lag(value, 1, 0).over(down))
    return x.withColumn("cell", F.col("d") - F.lag("d", 1, 0).over(across)).drop("d")


def rectangle_sum(cells: DataFrame, row0: int, col0: int, row1: int, col1: int, grid: int) -> Column | DataFrame:
    """The sum of a closed rectangle of cells, clamped to the grid; 0.0 outside of it."""
    a, b, c, d = max(0, row0), max(0, col0), min(grid - 1, row1), min(grid - 1, col1)
    return cells.filter(F.col("row").between(a, c) & F.col("col").between(b, d)).agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("double").alias("total"))


def value_of_tiles(tiles: DataFrame, cells: DataFrame, zoom: int) -> DataFrame:
    """(z, x, y) with the histogram's value: deeper than it, the parent cell's over scale squared;
    above it, the block's sum."""
    shift = F.greatest(F.col("z") - zoom, F.lit(0))
    scale = F.pow(F.lit(2.0), shift)
    deep = tiles.filter(F.col("z") >= zoom).withColumn("row", F.floor(F.col("y") / scale).cast("int")).withColumn("col", F.floor(F.col("x") / scale).cast("int"))
    deep = deep.join(cells, ["row", "col"], "left").select("z", "x", "y", (F.coalesce("cnt", F.lit(0)) / (scale * scale)).alias("value"))
    up = tiles.filter(F.col("z") < zoom).select("z", "x", "y")
    sums = pyramid(cells, zoom).select("z", F.col("row").alias("y"), F.col("col").alias("x"), "cnt")
    return deep.unionByName(up.join(sums, ["z", "x", "y"], "left").select("z", "x", "y", F.coalesce("cnt", F.lit(0)).cast("double").alias("value")))
