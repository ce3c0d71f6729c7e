"""Features to Web-Mercator tiles: candidates, semi-join with non-empty tiles, top-K, rendering."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import geometry as G
from ..functions import mercator as M
from ..functions import mvt, tilebatch, wkb

MAX_PER_TILE, MAX_ON_THE_FLY = 25_000, 4096
#: A box over more tiles than this at a zoom is met with the tiles there are, not with all it covers.
WIDE = 4096
RESERVED = ("_tile_id", "_sfc", "_bbox_xmin", "_bbox_ymin", "_bbox_xmax", "_bbox_ymax")


def priority(raw: Column) -> Column:
    """The same number for a geometry in each of its tiles, so tiles agree along their edges."""
    return F.crc32(raw)


def covered_tiles(boxes: DataFrame, low: int, high: int, nonempty: DataFrame | None = None) -> DataFrame:
    """Rows with xmin, ymin, xmax, ymax (EPSG:3857) once for each tile (z, x, y) their box touches.

    With ``nonempty`` (z, row, col) only tiles in it are kept.  Boxes over more than
    WIDE tiles of a zoom are then met through their parent tiles at a coarser zoom
    instead of being spread over every tile."""
    M.check_zoom(high)
    rows = boxes.withColumn("z", F.explode(F.sequence(F.lit(low), F.lit(high))))
    x0, y0, x1, y1 = M.tile_range(F.col("z"), F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    rows = rows.withColumns({"__x0": x0, "__y0": y0, "__x1": x1, "__y1": y1}).filter("__x0 <= __x1 and __y0 <= __y1")
    count = (F.col("__x1") - F.col("__x0") + 1) * (F.col("__y1") - F.col("__y0") + 1)

    def spread(df: DataFrame) -> DataFrame:
        df = df.withColumn("x", F.explode(F.sequence("__x0", "__x1"))).withColumn("y", F.explode(F.sequence("__y0", "__y1")))
        return df.withColumn("x", F.col("x").cast("int")).withColumn("y", F.col("y").cast("int")).drop("__x0", "__y0", "__x1", "__y1")

    if nonempty is None:
        return spread(rows)
    tiles = nonempty.select("z", F.col("col").cast("int").alias("x"), F.col("row").cast("int").alias("y"))
    narrow = spread(rows.filter(count <= WIDE)).join(tiles, ["z", "x", "y"], "left_semi")
    # a wide box at zoom z meets the tiles by their parents 6 levels up, which are 4096 times fewer
    up = F.greatest(F.col("z") - 6, F.lit(0))
    scale = F.pow(F.lit(2.0), F.col("z") - up)
    wide = rows.filter(count > WIDE).withColumn("__s", scale)
    wide = wide.withColumn("__px", F.explode(F.sequence(F.floor(F.col("__x0") / F.col("__s")), F.floor(F.col("__x1") / F.col("__s"))))).withColumn("__py", F.explode(F.sequence(F.floor(F.col("__y0") / F.col("__s")), F.floor(F.col("__y1") / F.col("__s"))))).drop("__s")
    parents = tiles.withColumn("__px", F.floor(F.col("x") / scale)).withColumn("__py", F.floor(F.col("y") / scale))
    wide = wide.join(parents, ["z", "__px", "__py"]).filter("x between __x0 and __x1 and y between __y0 and __y1").drop("__x0", "__y0", "__x1", "__y1", "__px", "__py")
    return narrow.unionByName(wide.select(*narrow.columns))


def top_per_tile(assigned: DataFrame, order: list[Column], k: int = MAX_PER_TILE) -> DataFrame:
    """The first k rows of each tile; cut in every partition before the shuffle (WindowGroupLimit)."""
    n = F.row_number().over(W.partitionBy("z", "x", "y").orderBy(*order))
    return assigned.withColumn("__n", n).filter(F.col("__n") <= k).drop("__n")


def top_overall(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k of all rows: a top-k in every partition, merged once."""
    return rows.orderBy(*order).limit(k)


def prepare(features: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Features (WKB, EPSG:4326) with attributes as one JSON column, geometry in EPSG:3857 and its box; null and empty ones go."""
    attributes = [c for c in features.columns if c != geometry and c not in RESERVED]

    @F.pandas_udf("struct<wkb binary, xmin double, ymin double, xmax double, ymax double>")
    def project(raw: pd.Series) -> pd.DataFrame:
        geometries, boxes = tilebatch.project_rows(raw.tolist())
        out = pd.DataFrame(boxes, columns=["xmin", "ymin", "xmax", "ymax"])
        out.insert(0, "wkb", pd.Series(geometries, dtype=object))
        return out

    props = F.to_json(F.struct(*[F.col(f"`{c}`") for c in attributes])) if attributes else F.lit("{}")
    x = features.select(props.alias("properties"), F.col(geometry).alias("__raw"), project(F.col(geometry)).alias("__g"))
    return x.filter("__g.wkb is not null").select("properties", priority(F.col("__raw")).alias("priority"), "__g.*")


def drawn(assigned: DataFrame) -> DataFrame:
    """(z, x, y, priority, kind, drawing, properties) of rows with wkb: what of each geometry is
    in its tile, as the tile format's commands.  A few bytes go on to the shuffle instead of the geometry."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                z, x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("z", "x", "y"))
                rows, kind, data = tilebatch.encode_rows(z, x, y, batch.column("wkb").to_pylist())
                at = pa.array(rows)
                yield pa.record_batch([*(batch.column(c).take(at) for c in ("z", "x", "y", "priority")), pa.array(kind, pa.int32()), data, batch.column("properties").take(at)], names=["z", "x", "y", "priority", "kind", "drawing", "properties"])

    return assigned.select("z", "x", "y", "priority", "wkb", "properties").mapInArrow(run, "z int, x int, y int, priority long, kind int, drawing binary, properties string")


def render_tiles(parts: DataFrame) -> DataFrame:
    """(z, x, y, data, features) of drawn rows, the largest priorities first."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["priority", "drawing"], ascending=[False, True], kind="stable")
        tags = {t: mvt.tags_of(json.loads(t)) for t in set(p["properties"])}
        data = mvt.assemble([(k, d, tags[t]) for k, d, t in zip(p["kind"].tolist(), p["drawing"], p["properties"], strict=True)])
        return pd.DataFrame([(*(int(p[c].iat[0]) for c in ("z", "x", "y")), data, len(p))], columns=["z", "x", "y", "data", "features"])

    return parts.groupBy("z", "x", "y").applyInPandas(one, "z int, x int, y int, data binary, features int")


def build_tiles(features: DataFrame, max_zoom: int, *, geometry: str = "geometry", nonempty: DataFrame | None = None, k: int = MAX_PER_TILE) -> DataFrame:
    """Tiles of zooms 0 to ``max_zoom``: each feature is drawn where it is read; tiles meet
    drawings, of which each partition passes on its k of largest priority for a tile."""
    assigned = covered_tiles(prepare(features, geometry), 0, max_zoom, nonempty)
    return render_tiles(top_per_tile(drawn(assigned), [F.desc("priority"), F.col("drawing")], k))


def tile_now(features: DataFrame, z: int, x: int, y: int, *, geometry: str = "geometry", k: int = MAX_ON_THE_FLY) -> bytes:
    """One tile, cut at its own edge: rows by the box columns if there are any, the k of largest priority, attributes only for those."""
    a, b, c, d = M.lonlat_of_tile(z, x, y)
    if "_bbox_xmin" in features.columns:
        from ..functions.boxes import Box, intersects

        features = features.filter(intersects(Box(a, b, c, d)))
    minx, miny, maxx, maxy = M.bounds_of_tile(z, x, y)
    got = prepare(features, geometry).filter(F.expr(f"xmax >= {minx} and xmin <= {maxx} and ymax >= {miny} and ymin <= {maxy}"))
    rows = top_overall(got, [F.desc("priority"), F.col("wkb")], k).collect()  # k rows
    out = mvt.render(z, x, y, [(wkb.loads(bytes(r["wkb"])), json.loads(r["properties"])) for r in rows], pad=0)
    return out[0] if out else mvt.empty_tile()
