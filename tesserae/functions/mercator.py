"""Web-Mercator and tile arithmetic as column expressions: no UDF, all inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of EPSG:3857, the tile format and the engine's defaults.
HALF_WORLD = 20037508.342789244
RADIUS = 6378137.0
MAX_LATITUDE = 85.0511287798
EXTENT = 4096
LAYER = "layer0"
MAX_ZOOM = 24


def check_zoom(z: int) -> int:
    if not 0 <= z <= MAX_ZOOM:
        raise ValueError(f"zoom {z} is not in 0..{MAX_ZOOM}")
    return z


def mercator_x(lon: Column) -> Column:
    return lon * F.lit(HALF_WORLD / 180.0)


def mercator_y(lat: Column) -> Column:
    """Latitudes beyond the square world are clamped to its edge."""
    phi = F.radians(F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), lat)))
    return F.lit(RADIUS) * F.ln(F.tan(F.lit(math.pi / 4) + phi / 2))


def longitude(x: Column) -> Column:
    return x * F.lit(180.0 / HALF_WORLD)


def latitude(y: Column) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(y / F.lit(RADIUS))) - F.lit(math.pi / 2))


def to_mercator(lon: float, lat: float) -> tuple[float, float]:
    lat = max(-MAX_LATITUDE, min(MAX_LATITUDE, lat))
    return lon * HALF_WORLD / 180.0, RADIUS * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))


def cell(x: Column, y: Column, zoom: Column | int) -> tuple[Column, Column]:
    """Column and row of the tile that holds a point; row 0 is north, edges are clamped."""
    n = F.pow(F.lit(2.0), zoom if isinstance(zoom, Column) else F.lit(float(zoom)))
    w = F.lit(2 * HALF_WORLD)
    last = n - 1

    def place(v: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(last, F.floor(v).cast("double"))).cast("int")

    return place((x + F.lit(HALF_WORLD)) / w * n), place((F.lit(HALF_WORLD) - y) / w * n)


def tile_bounds(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """minx, miny, maxx, maxy in EPSG:3857."""
    w = F.lit(2 * HALF_WORLD) / F.pow(F.lit(2.0), z)
    return x * w - HALF_WORLD, F.lit(HALF_WORLD) - (y + 1) * w, (x + 1) * w - HALF_WORLD, F.lit(HALF_WORLD) - y * w


def bounds_of_tile(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    w = 2 * HALF_WORLD / (1 << check_zoom(z))
    return x * w - HALF_WORLD, HALF_WORLD - (y + 1) * w, (x + 1) * w - HALF_WORLD, HALF_WORLD - y * w


def lonlat_of_tile(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    def back(mx: float, my: float) -> tuple[float, float]:
        return mx * 180.0 / HALF_WORLD, math.degrees(2 * math.atan(math.exp(my / RADIUS)) - math.pi / 2)

    a, b, c, d = bounds_of_tile(z, x, y)
    return *back(a, b), *back(c, d)


def tile_range(zoom: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> tuple[Column, Column, Column, Column]:
    """tx0, ty0, tx1, ty1 of the tiles that a box in EPSG:3857 touches; clamped below to 0, above to the last."""
    n = F.pow(F.lit(2.0), zoom)
    w = F.lit(2 * HALF_WORLD) / n

    def low(v: Column) -> Column:
        return F.greatest(F.lit(0), F.floor(v / w).cast("long"))

    def high(v: Column) -> Column:
        return F.least((n - 1).cast("long"), F.floor(v / w).cast("long"))

    return low(minx + HALF_WORLD), low(F.lit(HALF_WORLD) - maxy), high(maxx + HALF_WORLD), high(F.lit(HALF_WORLD) - miny)


def to_tile_space(v: Column, low: Column, high: Column, extent: int = EXTENT) -> Column:
    return (v - low) / (high - low) * extent


def scale_to_uint(v: Column, low: float, high: float, bits: int) -> Column:
    """round_half_even((v - low) / (high - low) * (2^bits - 1)), clipped; 0 if the extent is a point."""
    if not high > low:
        return F.lit(0).cast("long")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - F.lit(low)) / F.lit(high - low)))
    return F.rint(share * F.lit(float((1 << bits) - 1))).cast("long")


_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _low(v: Column) -> Column:
    return v.cast("long").bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))


def _apart(v: Column, shift: int, mask: int) -> Column:
    return v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))


def _spread(v: Column) -> Column:
    """The low 31 bits of v on the even places of 62."""
    v = _low(v)
    for step in _SPREAD:
        v = _apart(v, *step)
    return v


def morton(x: Column, y: Column) -> Column:
    """Z-order code of numbers of up to 31 bits; y takes the odd bits."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def with_morton(df: DataFrame, x: Column, y: Column, into: str) -> DataFrame:
    """``morton`` as a column, a projection a step: one expression holds its numbers 64 times."""
    df = df.withColumns({"__mx": _low(x), "__my": _low(y)})
    for step in _SPREAD:
        df = df.withColumns({n: _apart(F.col(n), *step) for n in ("__mx", "__my")})
    return df.withColumn(into, F.col("__mx").bitwiseOR(F.shiftleft("__my", 1))).drop("__mx", "__my")


def hilbert(x: Column, y: Column, bits: int) -> Column:
    """Distance along the Hilbert curve of order ``bits``: one step per bit, from the top.

    The steps are a fold over the bit numbers, so the expression stays small."""
    if not bits:
        return F.lit(0).cast("long")

    def step(a: Column, i: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("long"), i)
        rx = F.call_function("shiftright", a["x"], i).bitwiseAND(F.lit(1).cast("long"))
        ry = F.call_function("shiftright", a["y"], i).bitwiseAND(F.lit(1).cast("long"))
        lx, ly = a["x"].bitwiseAND(side - 1), a["y"].bitwiseAND(side - 1)
        turn = rx == 1
        fx, fy = F.when(turn, side - 1 - lx).otherwise(lx), F.when(turn, side - 1 - ly).otherwise(ly)
        d = a["d"] + side * side * (rx * 3).bitwiseXOR(ry)
        return F.struct(F.when(ry == 0, fy).otherwise(lx).alias("x"), F.when(ry == 0, fx).otherwise(ly).alias("y"), d.alias("d"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda a: a["d"])


def hilbert_number(x: int, y: int, bits: int) -> int:
    d = 0
    for i in range(bits - 1, -1, -1):
        side = 1 << i
        rx, ry = (x >> i) & 1, (y >> i) & 1
        d += side * side * ((3 * rx) ^ ry)
        x, y = x & (side - 1), y & (side - 1)
        if ry == 0:
            if rx:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
    return d


def archive_id(z: int, x: int, y: int) -> int:
    """Place of a tile in an archive: all tiles of lower zooms, then the Hilbert curve."""
    return (4**z - 1) // 3 + hilbert_number(x, y, z)


def archive_id_column(z: int, x: Column, y: Column) -> Column:
    return F.lit((4**z - 1) // 3).cast("long") + hilbert(x, y, z)
