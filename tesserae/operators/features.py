"""Features: exact geometry filters, and CSV and GeoJSON lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import wkb
from ..functions.boxes import INTERNAL_COLUMNS, Box, intersects


def intersecting(features: DataFrame, area, geometry: str = "geometry") -> DataFrame:
    """Features that share a point with ``area``: by their box columns or bounds first, then exactly."""
    b = wkb.bounds(area)
    if b is None:
        return features.limit(0)
    raw = wkb.dumps(area)

    @F.pandas_udf("boolean")
    def exact(column: pd.Series) -> pd.Series:
        other = wkb.loads(raw)
        return pd.Series([G.intersects(wkb.parse(r), other) for r in column], dtype=bool)

    if "_bbox_xmin" in features.columns:
        features = features.filter(intersects(Box(*b)))
    return features.filter(F.coalesce(exact(F.col(geometry)), F.lit(False)))


def in_box(features: DataFrame, box: Box, geometry: str = "geometry") -> DataFrame:
    """Features whose bounds touch the box; those without geometry don't."""
    if "_bbox_xmin" in features.columns:
        return features.filter(intersects(box))
    x = features.withColumn("__b", wkb.st_bounds(geometry))
    return x.filter(intersects(box, *[F.col(f"__b.{n}") for n in ("xmin", "ymin", "xmax", "ymax")])).drop("__b")


def properties(features: DataFrame, geometry: str = "geometry") -> list[str]:
    return [c for c in features.columns if c != geometry and c not in INTERNAL_COLUMNS]


def csv_line(values: list[Column]) -> Column:
    """Joined by commas; only texts that hold a comma or a quote are quoted; null is empty."""

    def one(c: Column) -> Column:
        s = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(F.contains(s, F.lit(",")) | F.contains(s, F.lit('"')), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)

    return F.concat_ws(",", *map(one, values))


def csv_lines(features: DataFrame, geometry: str = "geometry") -> tuple[str, DataFrame]:
    """The header and a frame (value) of lines: properties, geometry_type, x, y (points only)."""
    names = properties(features, geometry)
    t = wkb.st_geometry_type(geometry)
    x = features.withColumns({"__t": t, "__c": wkb.st_centroid(geometry)})
    at = [F.when(F.col("__t") == "Point", F.col(f"__c.{n}")) for n in ("x", "y")]
    return ",".join([*names, "geometry_type", "x", "y"]), x.select(csv_line([*[F.col(f"`{n}`") for n in names], F.col("__t"), *at]).alias("value"))


def geojson_feature(features: DataFrame, geometry: str = "geometry") -> Column:
    """One feature as JSON; null properties are left out, a null geometry is null."""
    names = properties(features, geometry)
    props = F.to_json(F.struct(*[F.col(f"`{n}`") for n in names])) if names else F.lit("{}")
    return F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(wkb.wkb_to_geojson(F.col(geometry)), F.lit("null")), F.lit(',"properties":'), props, F.lit("}"))


def geojson_lines(features: DataFrame, geometry: str = "geometry") -> DataFrame:
    return features.select(geojson_feature(features, geometry).alias("value"))


def _csv(features: DataFrame, geometry: str):
    header, lines = csv_lines(features, geometry)
    yield header + "\n"
    for r in lines.toLocalIterator():
        yield r[0] + "\n"


def _collection(features: DataFrame, geometry: str):
    yield '{"type":"FeatureCollection","features":['
    for i, r in enumerate(geojson_lines(features, geometry).toLocalIterator()):
        yield ("," if i else "") + r[0]
    yield "]}"


#: Download format -> (MIME type, pieces of text of a frame and its geometry column).  Others may be added.
FORMATS: dict = {"csv": ("text/csv", _csv), "geojson": ("application/geo+json", _collection)}
