"""Well-known binary on executors: a parser, writers, and Arrow-batched functions.

A geometry is (type name, data): Point (x, y) or None; LineString an (n, 2)
array; Polygon a list of rings; Multi* and GeometryCollection lists of geometries.
Both byte orders, EWKB SRIDs and Z/M coordinates are read (only x, y are kept).
What can't be decoded is null.
"""

from __future__ import annotations

import json
import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format.
TYPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
CODES = {name: code for code, name in TYPES.items()}
CODES["LinearRing"] = 2
_PARTS = {"MultiPoint": "Point", "MultiLineString": "LineString", "MultiPolygon": "Polygon"}


def loads(raw: bytes):
    geometry, end = _read(memoryview(raw), 0)
    return geometry


def parse(raw: bytes | None):
    """The geometry, or None if there is none or it can't be decoded."""
    if raw is None:
        return None
    try:
        return loads(raw)
    except (struct.error, ValueError, IndexError, KeyError):
        return None


def _read(raw: memoryview, at: int):
    order = "<" if raw[at] == 1 else ">" if raw[at] == 0 else None
    if order is None:
        raise ValueError("byte order")
    (code,) = struct.unpack_from(order + "I", raw, at + 1)
    at += 5
    dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    if code & 0x20000000:
        at += 4
    code &= 0x0FFFFFFF
    dims = max(dims, {0: 2, 1: 3, 2: 3, 3: 4}[code // 1000])
    name = TYPES[code % 1000]

    def points(n: int, at: int):
        if n * dims * 8 > len(raw) - at:
            raise ValueError("truncated")
        got = np.frombuffer(raw, order + "f8", n * dims, at).reshape(n, dims)[:, :2].astype(float)
        return got, at + n * dims * 8

    if name == "Point":
        xy, at = points(1, at)
        return (name, None if np.isnan(xy).all() else (float(xy[0, 0]), float(xy[0, 1]))), at
    (n,) = struct.unpack_from(order + "I", raw, at)
    at += 4
    if name == "LineString":
        xy, at = points(n, at)
        return (name, xy), at
    parts = []
    for _ in range(n):
        if name == "Polygon":
            (k,) = struct.unpack_from(order + "I", raw, at)
            part, at = points(k, at + 4)
        else:
            part, at = _read(raw, at)
        parts.append(part)
    return (name, parts), at


def dumps(geometry) -> bytes:
    """Little-endian, two-dimensional."""
    name, data = geometry
    head = struct.pack("<BI", 1, CODES[name])
    if name == "Point":
        return head + struct.pack("<dd", *(data if data is not None else (math.nan, math.nan)))
    if name in ("LineString", "LinearRing"):
        return head + struct.pack("<I", len(data)) + np.asarray(data, "<f8").tobytes()
    if name == "Polygon":
        return head + struct.pack("<I", len(data)) + b"".join(struct.pack("<I", len(r)) + np.asarray(r, "<f8").tobytes() for r in data)
    return head + struct.pack("<I", len(data)) + b"".join(dumps(p) for p in data)


def point(x: float, y: float):
    return "Point", (x, y)


def box(xmin: float, ymin: float, xmax: float, ymax: float):
    return "Polygon", [np.array([(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)], float)]


def lines(geometry):
    """The coordinate arrays of a geometry in document order."""
    name, data = geometry
    if name == "Point":
        return [] if data is None else [np.array([data], float)]
    if name in ("LineString", "LinearRing"):
        return [data] if len(data) else []
    if name == "Polygon":
        return [r for r in data if len(r)]
    return [x for part in data for x in lines(part)]


def vertices(geometry) -> np.ndarray:
    got = lines(geometry)
    return np.concatenate(got) if got else np.zeros((0, 2))


def bounds(geometry):
    v = vertices(geometry)
    return None if not len(v) else (*v.min(0).tolist(), *v.max(0).tolist())


def _weights(geometry):
    """(dimension, weight, x * weight, y * weight) of each part."""
    name, data = geometry
    if name == "Point":
        if data is not None:
            yield 0, 1.0, data[0], data[1]
    elif name in ("LineString", "LinearRing"):
        d = np.hypot(*np.diff(data, axis=0).T) if len(data) > 1 else np.zeros(0)
        if d.sum() > 0:
            mid = (data[1:] + data[:-1]) / 2
            yield 1, float(d.sum()), float(d @ mid[:, 0]), float(d @ mid[:, 1])
        elif len(data):
            yield 0, 1.0, float(data[0, 0]), float(data[0, 1])
    elif name == "Polygon":
        total = [0.0, 0.0, 0.0]
        for i, r in enumerate(data):
            if len(r) < 3:
                continue
            o = r[0]
            a, b = r[:-1] - o, r[1:] - o
            cross = a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]
            area = cross.sum() / 2
            sign = (1 if area >= 0 else -1) * (1 if i == 0 else -1)
            moment = ((a + b) * cross[:, None]).sum(0) / 6
            total[0] += sign * area
            total[1] += sign * (moment[0] + o[0] * area)
            total[2] += sign * (moment[1] + o[1] * area)
        if total[0] > 0:
            yield 2, *total
        else:
            for r in data[:1]:
                yield from _weights(("LineString", r))
    else:
        for part in data:
            yield from _weights(part)


def centroid(geometry):
    """Of the parts of the highest dimension: by area, else length, else the points' mean."""
    parts = list(_weights(geometry))
    if not parts:
        return None
    top = max(p[0] for p in parts)
    w, x, y = (sum(p[i] for p in parts if p[0] == top) for i in (1, 2, 3))
    return x / w, y / w


def from_geojson(g: dict | None):
    if not g or "type" not in g:
        return None
    name = g["type"]
    if name == "GeometryCollection":
        return name, [x for x in map(from_geojson, g.get("geometries") or []) if x]
    c = g.get("coordinates")
    if c is None or name not in CODES:
        return None

    def xy(points):
        return np.array([p[:2] for p in points], float).reshape(-1, 2)

    if name == "Point":
        return name, (float(c[0]), float(c[1])) if len(c) else None
    if name == "LineString":
        return name, xy(c)
    if name == "Polygon":
        return name, [xy(r) for r in c]
    return name, [from_geojson({"type": _PARTS[name], "coordinates": p}) for p in c]


def to_geojson(geometry):
    if geometry is None:
        return None
    name, data = geometry
    if name == "GeometryCollection":
        return {"type": name, "geometries": [to_geojson(p) for p in data]}
    if name == "Point":
        return {"type": name, "coordinates": list(data) if data is not None else []}
    if name in ("LineString", "LinearRing"):
        return {"type": "LineString", "coordinates": np.asarray(data).tolist()}
    if name == "Polygon":
        return {"type": name, "coordinates": [np.asarray(r).tolist() for r in data]}
    return {"type": name, "coordinates": [to_geojson(p)["coordinates"] for p in data]}


BOUNDS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")])
XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


class Batch:
    """A column of geometries as flat vertices: row i has ``xy[off[i]:off[i+1]]``, or
    none if it is null, empty or undecodable.

    Little-endian two-dimensional points, lines and polygons of one ring with equal
    length and head are decoded together; the others one by one (``slow``)."""

    def __init__(self, raw: pd.Series) -> None:
        n = len(raw)
        self.kind = np.full(n, None, object)
        groups: dict[tuple, list[int]] = {}
        values = raw.tolist()
        for i, r in enumerate(values):
            if r is not None:
                groups.setdefault((len(r), bytes(r[:13])), []).append(i)
        counts = np.zeros(n, np.int64)
        chunks: list[tuple[np.ndarray, np.ndarray]] = []  # rows, (rows, points, 2)
        self.slow: dict[int, tuple] = {}
        for (size, head), rows in groups.items():
            start = self._plain(size, head)
            if start is None:
                for i in rows:
                    g = parse(values[i])
                    if g is not None:
                        self.slow[i], self.kind[i] = g, g[0]
                        counts[i] = len(vertices(g))
                continue
            name, skip = start
            at = np.array(rows)
            xy = np.frombuffer(b"".join(values[i] for i in rows), np.uint8).reshape(len(rows), size)[:, skip:]
            xy = np.ascontiguousarray(xy).view("<f8").reshape(len(rows), -1, 2)
            self.kind[at] = name
            if name == "Point":
                counts[at] = ~np.isnan(xy[:, 0]).all(1)
            else:
                counts[at] = xy.shape[1]
            chunks.append((at, xy))
        self.off = np.r_[0, np.cumsum(counts)]
        self.xy = np.zeros((self.off[-1], 2))
        for at, xy in chunks:
            has = counts[at] > 0
            at, xy = at[has], xy[has]
            self.xy[(self.off[at][:, None] + np.arange(xy.shape[1])).ravel()] = xy.reshape(-1, 2)
        for i, g in self.slow.items():
            if counts[i]:
                self.xy[self.off[i] : self.off[i + 1]] = vertices(g)
        self.counts, self.chunks = counts, chunks

    @staticmethod
    def _plain(size: int, head: bytes):
        """(type, bytes before the coordinates) if the rest is nothing but them."""
        if len(head) < 9 or head[0] != 1:
            return None
        code, k = struct.unpack_from("<II", head, 1)
        if code == 1 and size == 21:
            return "Point", 5
        if code == 2 and k and size == 9 + 16 * k:
            return "LineString", 9
        if code == 3 and k == 1 and len(head) == 13:
            (m,) = struct.unpack_from("<I", head, 9)
            if m and size == 13 + 16 * m:
                return "Polygon", 13
        return None

    def first_vertices(self) -> np.ndarray:
        out = np.full((len(self.counts), 2), np.nan)
        some = self.counts > 0
        out[some] = self.xy[self.off[:-1][some]]
        return out

    def bounds(self) -> np.ndarray:
        out = np.full((len(self.counts), 4), np.nan)
        some = np.flatnonzero(self.counts)
        if len(some):
            cut = self.off[some]
            out[some, :2] = np.minimum.reduceat(self.xy, cut)
            out[some, 2:] = np.maximum.reduceat(self.xy, cut)
        return out

    def centroids(self) -> np.ndarray:
        out = np.full((len(self.counts), 2), np.nan)
        for at, xy in self.chunks:
            if self.kind[at[0]] == "Point":
                out[at] = xy[:, 0]
                continue
            done = np.zeros(len(at), bool)
            if self.kind[at[0]] == "Polygon" and xy.shape[1] > 2:
                o = xy[:, :1]
                a, b = xy[:, :-1] - o, xy[:, 1:] - o
                cross = a[..., 0] * b[..., 1] - b[..., 0] * a[..., 1]
                area = cross.sum(1) / 2
                done = area != 0
                moment = ((a + b) * cross[..., None]).sum(1) / 6
                out[at[done]] = moment[done] / area[done, None] + o[done, 0]
            for i, p in zip(at[~done].tolist(), xy[~done], strict=True):
                out[i] = centroid((self.kind[i], [p] if self.kind[i] == "Polygon" else p))
        for i, g in self.slow.items():
            c = centroid(g)
            if c is not None:
                out[i] = c
        return out


def _of(raw: pd.Series, use, empty=None) -> list:
    out = []
    for r in raw:
        g = parse(r)
        out.append(empty if g is None else use(g))
    return out


@F.pandas_udf(BOUNDS)
def st_bounds(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(Batch(raw).bounds(), columns=BOUNDS.names).astype(object).where(lambda d: d.notna(), None)


@F.pandas_udf(XY)
def st_centroid(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(Batch(raw).centroids(), columns=["x", "y"]).astype(object).where(lambda d: d.notna(), None)


@F.pandas_udf(XY)
def st_first_vertex(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(Batch(raw).first_vertices(), columns=["x", "y"]).astype(object).where(lambda d: d.notna(), None)


@F.pandas_udf(T.ArrayType(XY))
def st_vertices(raw: pd.Series) -> pd.Series:
    b = Batch(raw)
    points = [{"x": x, "y": y} for x, y in b.xy.tolist()]
    return pd.Series([None if k is None else points[i:j] for k, i, j in zip(b.kind, b.off[:-1].tolist(), b.off[1:].tolist(), strict=True)], dtype=object)


@F.pandas_udf(T.LongType())
def st_n_points(raw: pd.Series) -> pd.Series:
    b = Batch(raw)
    return pd.Series(b.counts, dtype="Int64").where(pd.Series([k is not None for k in b.kind], dtype=bool))


@F.pandas_udf(T.StringType())
def st_geometry_type(raw: pd.Series) -> pd.Series:
    return pd.Series(Batch(raw).kind, dtype=object)


@F.pandas_udf(T.BinaryType())
def geojson_to_wkb(text: pd.Series) -> pd.Series:
    def one(t):
        try:
            g = from_geojson(json.loads(t)) if t is not None else None
            return None if g is None else dumps(g)
        except (ValueError, TypeError, IndexError, KeyError):
            return None

    return pd.Series([one(t) for t in text], dtype=object)


@F.pandas_udf(T.StringType())
def wkb_to_geojson(raw: pd.Series) -> pd.Series:
    return pd.Series(_of(raw, lambda g: json.dumps(to_geojson(g), separators=(",", ":"))), dtype=object)


def point_wkb(x, y):
    """WKB of points from two columns (Arrow-batched; numpy writes all points at once)."""

    @F.pandas_udf("binary")
    def write(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x), np.dtype([("o", "u1"), ("t", "<u4"), ("x", "<f8"), ("y", "<f8")]))
        out["o"], out["t"], out["x"], out["y"] = 1, 1, x, y
        raw = out.tobytes()
        return pd.Series([None if np.isnan(a) or np.isnan(b) else raw[i : i + 21] for i, a, b in zip(range(0, len(raw), 21), x.to_numpy(float), y.to_numpy(float), strict=True)], dtype=object)

    return write(x, y)


@F.pandas_udf(T.BinaryType())
def box_wkb(xmin: pd.Series, ymin: pd.Series, xmax: pd.Series, ymax: pd.Series) -> pd.Series:
    """Rectangles, all written at once; null if a bound is."""
    b = np.stack([c.to_numpy(float, na_value=np.nan) for c in (xmin, ymin, xmax, ymax)], 1)
    out = np.zeros(len(b), np.dtype([("o", "u1"), ("t", "<u4"), ("r", "<u4"), ("n", "<u4"), ("xy", "<f8", (10,))]))
    out["o"], out["t"], out["r"], out["n"] = 1, 3, 1, 5
    out["xy"] = b[:, [0, 1, 2, 1, 2, 3, 0, 3, 0, 1]]
    raw, size = out.tobytes(), out.itemsize
    return pd.Series([raw[i * size : (i + 1) * size] if ok else None for i, ok in enumerate(~np.isnan(b).any(1))], dtype=object)
