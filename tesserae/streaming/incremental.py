"""Structured Streaming over growing inputs: density by cell and windowed counts.

Both are aggregations whose state is one row a cell (and window); late rows beyond
the watermark are dropped by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import mercator as M
from ..operators.density import histogram


def density(points: DataFrame, zoom: int, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Running counts by cell; for output modes update and complete."""
    return histogram(points, zoom, lon, lat)


def windowed_density(points: DataFrame, zoom: int, time: str, window: str = "1 hour", late: str = "10 minutes", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Counts by cell and time window, for output mode append behind the watermark."""
    x, y = M.cell(M.mercator_x(F.col(lon)), M.mercator_y(F.col(lat)), M.check_zoom(zoom))
    rows = points.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withWatermark(time, late)
    got = rows.groupBy(F.window(time, window).alias("w"), y.alias("row"), x.alias("col")).agg(F.count("*").alias("cnt"))
    return got.select(F.col("w.start").alias("start"), "row", "col", "cnt")


def keep(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The latest counts as Parquet, replaced at each batch."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
