"""Geometry, Mercator arithmetic and vector tiles against golden values and brute force."""

import json
import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import boxes as B
from tesserae.functions import geometry as G
from tesserae.functions import mercator as M
from tesserae.functions import mvt, tilebatch, wkb

finite = st.floats(-1e6, 1e6, allow_nan=False)
xy = st.tuples(finite, finite)


@given(st.lists(xy, min_size=2, max_size=8), st.lists(st.lists(xy, min_size=4, max_size=6), min_size=1, max_size=3))
@settings(max_examples=50, deadline=None)
def test_wkb_round_trip(line, rings):
    for g in (("Point", line[0]), ("LineString", np.array(line)), ("Polygon", [np.array(r) for r in rings]), ("GeometryCollection", [("Point", line[0]), ("MultiLineString", [("LineString", np.array(line))])])):
        raw = wkb.dumps(g)
        assert wkb.dumps(wkb.loads(raw)) == raw
        assert wkb.to_geojson(wkb.from_geojson(wkb.to_geojson(g))) == wkb.to_geojson(g)


def test_wkb_variants_and_rubbish():
    assert wkb.loads(struct.pack(">BIdd", 0, 1, 3.0, 4.0)) == ("Point", (3.0, 4.0))
    assert wkb.loads(struct.pack("<BIIdd", 1, 1 | 0x20000000, 4326, 3.0, 4.0)) == ("Point", (3.0, 4.0))
    assert wkb.loads(struct.pack("<BIddd", 1, 1001, 3.0, 4.0, 5.0)) == ("Point", (3.0, 4.0))
    assert wkb.loads(struct.pack("<BIdddd", 1, 1 | 0xC0000000, 3.0, 4.0, 5.0, 6.0)) == ("Point", (3.0, 4.0))
    assert wkb.loads(struct.pack("<BIdd", 1, 1, math.nan, math.nan)) == ("Point", None)
    for raw in (b"", b"\x05", b"\x01\x63\x00\x00\x00", struct.pack("<BII", 1, 2, 1 << 30), None):
        assert wkb.parse(raw) is None


def test_bounds_centroid_vertices():
    hole = ("Polygon", [wkb.box(0, 0, 10, 10)[1][0], wkb.box(0, 0, 5, 10)[1][0]])
    assert wkb.centroid(hole) == pytest.approx((7.5, 5))
    assert wkb.centroid(("LineString", np.array([(0, 0), (10, 0), (10, 2)], float))) == pytest.approx((70 / 12, 2 / 12))
    assert wkb.centroid(("GeometryCollection", [wkb.point(100, 100), wkb.box(0, 0, 2, 2)])) == pytest.approx((1, 1))
    assert wkb.centroid(("Polygon", [np.array([(0, 0), (4, 0), (0, 0), (0, 0)], float)])) == pytest.approx((2, 0))
    assert wkb.centroid(("Polygon", [])) is None and wkb.bounds(("Point", None)) is None
    nested = ("GeometryCollection", [wkb.point(1, 2), ("GeometryCollection", [("LineString", np.array([(0, 0), (5, 5)], float)), ("Polygon", [np.array([(0, 0), (1, 0), (0, 0)], float)])])])
    assert wkb.vertices(nested).tolist() == [[1, 2], [0, 0], [5, 5], [0, 0], [1, 0], [0, 0]]


def test_functions_on_columns(spark):
    geometries = [wkb.point(1, 2), wkb.box(0, 0, 10, 10), ("MultiPolygon", [wkb.box(0, 0, 10, 10), wkb.box(15, 15, 25, 25)]), ("Point", None)]
    df = spark.createDataFrame([(i, wkb.dumps(g)) for i, g in enumerate(geometries)] + [(8, b"junk"), (9, None)], "id int, g binary")
    got = {r["id"]: r for r in df.select("id", wkb.st_n_points("g").alias("n"), wkb.st_geometry_type("g").alias("t"), wkb.st_bounds("g").alias("b"), wkb.st_centroid("g").alias("c"), wkb.wkb_to_geojson("g").alias("j"), wkb.st_vertices("g").alias("v")).collect()}
    assert [got[i]["n"] for i in (0, 1, 2, 3, 8, 9)] == [1, 5, 10, 0, None, None]
    assert got[2]["t"] == "MultiPolygon" and tuple(got[2]["b"]) == (0, 0, 25, 25) and tuple(got[1]["c"]) == (5, 5)
    assert got[8]["t"] is None and tuple(got[3]["b"]) == (None,) * 4
    assert json.loads(got[0]["j"]) == {"type": "Point", "coordinates": [1.0, 2.0]} and len(got[2]["v"]) == 10
    back = df.filter("id < 3").select("g", wkb.geojson_to_wkb(wkb.wkb_to_geojson("g")).alias("h"))
    assert all(bytes(r["g"]) == bytes(r["h"]) for r in back.collect())


@given(st.floats(-179.9, 179.9), st.floats(-85, 85), st.integers(0, 14))
@settings(max_examples=50, deadline=None)
def test_tiles_hold_their_points(lon, lat, z):
    x, y = M.to_mercator(lon, lat)
    n = 1 << z
    tx = min(n - 1, max(0, int((x + M.HALF_WORLD) / (2 * M.HALF_WORLD) * n)))
    ty = min(n - 1, max(0, int((M.HALF_WORLD - y) / (2 * M.HALF_WORLD) * n)))
    a, b, c, d = M.bounds_of_tile(z, tx, ty)
    assert a - 1e-6 <= x <= c + 1e-6 and b - 1e-6 <= y <= d + 1e-6


def test_codes(spark):
    df = spark.createDataFrame([(x, y) for x in range(8) for y in range(8)], "x long, y long")
    rows = df.select("x", "y", M.morton(F.col("x"), F.col("y")).alias("m"), M.hilbert(F.col("x"), F.col("y"), 3).alias("h"), M.archive_id_column(3, F.col("x"), F.col("y")).alias("a")).collect()
    for r in rows:
        want = sum(((r["x"] >> i & 1) << 2 * i) | ((r["y"] >> i & 1) << 2 * i + 1) for i in range(3))
        assert r["m"] == want and r["h"] == M.hilbert_number(r["x"], r["y"], 3) and r["a"] == M.archive_id(3, r["x"], r["y"])
    path = sorted((r["h"], r["x"], r["y"]) for r in rows)
    assert [p[0] for p in path] == list(range(64))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(path, path[1:], strict=False))
    # published values of the archive format
    assert [M.archive_id(*t) for t in ((0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0), (2, 0, 0))] == [0, 1, 2, 3, 4, 5]


def test_poles_and_zooms(spark):
    df = spark.createDataFrame([(0.0, 90.0), (180.0, -90.0), (-180.0, 85.06)], "lon double, lat double")
    x, y = M.cell(M.mercator_x(F.col("lon")), M.mercator_y(F.col("lat")), 4)
    assert [tuple(r) for r in df.select(x.alias("x"), y.alias("y")).collect()] == [(8, 0), (15, 15), (0, 0)]
    for z in (-1, 25):
        with pytest.raises(ValueError):
            M.check_zoom(z)


def test_boxes_and_sizes():
    b = B.Box(10, 5, 0, 0)
    assert (b.xmin, b.ymin, b.xmax, b.ymax) == (0, 0, 10, 5)
    assert b.intersects(B.Box(10, 5, 20, 20)) and not b.intersects(B.Box(10.1, 0, 20, 5))
    assert b.area == 50 and b.margin == 15 and b.overlap(B.Box(5, 0, 20, 2)) == 10 and B.Box(1, 1, 1, 5).is_empty
    assert B.Box.parse("1,2,3,4").contains(1, 4)
    for bad in ("1,2,3", "a,b,c,d", ""):
        with pytest.raises(ValueError):
            B.Box.parse(bad)
    assert [B.parse_size(s) for s in ("12", "1kb", "1.5 MB", "2gb")] == [12, 1024, 1572864, 2 << 30]
    assert B.human_size(1536) == "1.5 KB"
    with pytest.raises(ValueError):
        B.parse_size("many")


box_st = st.tuples(st.floats(-5, 5), st.floats(-5, 5), st.floats(6, 15), st.floats(6, 15))


@given(st.lists(st.tuples(st.floats(-20, 20), st.floats(-20, 20)), min_size=3, max_size=7), box_st)
@settings(max_examples=60, deadline=None)
def test_clipping_stays_in_the_box_and_keeps_area(points, box):
    hull = sorted(points, key=lambda p: math.atan2(p[1] - sum(q[1] for q in points) / len(points), p[0] - sum(q[0] for q in points) / len(points)))
    g = G.repair(("Polygon", [np.array(hull)]))
    if g is None:
        return
    got = G.clip(g, box)
    if got is not None:
        a, b, c, d = wkb.bounds(got)
        assert a >= box[0] - 1e-9 and b >= box[1] - 1e-9 and c <= box[2] + 1e-9 and d <= box[3] + 1e-9
        assert _area(got) <= _area(g) + 1e-6
    parts = G.clip(("LineString", np.array(points)), box)
    if parts is not None:
        assert G.intersects(parts, wkb.box(*box))


def test_clip_known_shapes():
    got = G.clip(wkb.box(-5, -5, 5, 5), (0, 0, 10, 10))
    assert abs(G.signed_area(got[1][0])) == 25
    line = G.clip(("LineString", np.array([(-5, 5), (5, 5), (5, 20), (6, 20), (6, 5)], float)), (0, 0, 10, 10))
    assert line[0] == "MultiLineString" and [p[1].tolist() for p in line[1]] == [[[0, 5], [5, 5], [5, 10]], [[6, 10], [6, 5]]]
    assert G.clip(wkb.point(11, 0), (0, 0, 10, 10)) is None
    assert G.simplify_line(np.array([(0, 0), (1, 0.01), (2, 0)], float), 0.1).tolist() == [[0, 0], [2, 0]]
    assert G.repair(("Polygon", [np.array([(0, 0), (1, 0), (1, 0), (1, 1)], float)]))[1][0].tolist() == [[0, 0], [1, 0], [1, 1], [0, 0]]
    assert G.repair(("Polygon", [np.array([(0, 0), (1, 1), (2, 2), (0, 0)], float)])) is None


def test_intersects():
    square = wkb.box(0, 0, 10, 10)
    ring = ("Polygon", [square[1][0], wkb.box(2, 2, 8, 8)[1][0]])
    cases = [(wkb.point(5, 5), True, False), (wkb.point(10, 10), True, True), (wkb.box(3, 3, 4, 4), True, False), (wkb.box(-5, -5, 20, 20), True, True), (wkb.box(11, 0, 12, 1), False, False), (("LineString", np.array([(-1, 5), (11, 5)], float)), True, True)]
    for g, with_square, with_ring in cases:
        assert G.intersects(square, g) == G.intersects(g, square) == with_square
        assert G.intersects(ring, g) == with_ring


def test_vector_tiles_round_trip():
    square = ("Polygon", [np.array([(0, 0), (0, 4096), (4096, 4096), (4096, 0), (0, 0)], float), np.array([(10, 10), (20, 10), (20, 20), (10, 10)], float)])
    props = {"id": 1, "name": None, "value": 42, "neg": -5, "x": 1.5, "ok": True, "s": "ü", "nan": math.nan}
    got = mvt.decode(mvt.encode([(square, props), (("MultiPoint", [wkb.point(1, 2), wkb.point(3, 4)]), {}), (("LineString", np.array([(0, 0), (5, 5), (5, 5)], float)), {"id": 1})]))["layer0"]
    assert got["extent"] == 4096 and [f["type"] for f in got["features"]] == [3, 1, 2]
    assert got["features"][0]["properties"] == {"id": 1, "value": 42, "neg": -5, "x": 1.5, "ok": True, "s": "ü"}
    assert len(got["features"][0]["geometry"]) == 2 and got["features"][2]["geometry"] == [[(0, 0), (5, 5)]]
    assert mvt.decode(mvt.empty_tile())["layer0"]["features"] == []
    big = mvt.render(2, 1, 1, [(wkb.box(-1e7, -1e7, 1e7, 1e7), {"id": 7})])
    ring = mvt.decode(big[0])["layer0"]["features"][0]["geometry"][0]
    assert big[1] == 1 and all(-256 <= v <= 4352 for p in ring for v in p)
    assert mvt.render(5, 0, 0, [(wkb.point(0, 0), {})]) is None


def test_batches_equal_single_geometries():
    import pandas as pd

    rng = np.random.default_rng(0)
    shapes = [wkb.point(*rng.random(2)) for _ in range(5)] + [wkb.box(0, 0, *(1 + rng.random(2))) for _ in range(5)] + [("LineString", rng.random((k, 2))) for k in (1, 2, 2, 7)]
    shapes += [("Point", None), ("Polygon", []), ("LineString", np.zeros((0, 2))), ("Polygon", [np.zeros((4, 2))]), ("MultiPoint", [wkb.point(1, 1), wkb.point(3, 3)]), ("GeometryCollection", [])]
    raw = pd.Series([wkb.dumps(g) for g in shapes] + [None, b"junk", b"\x01\x02"], dtype=object)
    b = wkb.Batch(raw)
    for i, g in enumerate(shapes):
        assert b.kind[i] == g[0] and b.xy[b.off[i] : b.off[i + 1]].tolist() == wkb.vertices(g).tolist()
        want, c = wkb.bounds(g), wkb.centroid(g)
        assert b.bounds()[i].tolist() == pytest.approx(want) if want else np.isnan(b.bounds()[i]).all()
        assert b.centroids()[i].tolist() == pytest.approx(c) if c else np.isnan(b.centroids()[i]).all()
    assert list(b.kind[len(shapes) :]) == [None] * 3 and b.counts[len(shapes) :].tolist() == [0, 0, 0]


def _ring(rng, n, c, s):
    t, r = np.sort(rng.random(n)) * 2 * np.pi, s * (0.3 + rng.random(n))
    p = np.stack([np.cos(t) * r, np.sin(t) * r], 1) + c
    return np.concatenate([p, p[:1]])


def _area(g):
    if g is None or g[0] in ("Point", "LineString"):
        return 0
    return sum(map(G.signed_area, g[1])) if g[0] == "Polygon" else sum(map(_area, g[1]))


def test_repair_of_crossing_rings():
    bow = ("Polygon", [np.array([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)], float)])
    got = G.repair(bow)
    assert got[0] == "MultiPolygon" and len(got[1]) == 2 and _area(got) == pytest.approx(2)
    assert all(G.is_simple(p[1]) for p in got[1])
    several = G.repair(("MultiPolygon", [bow, wkb.box(5, 5, 6, 6)]))
    assert len(several[1]) == 3 and _area(several) == pytest.approx(3)
    hole = ("Polygon", [wkb.box(0, 0, 4, 4)[1][0], wkb.box(2, 1, 6, 3)[1][0]])  # a hole that reaches out of its ring
    assert _area(G.repair(hole)) == pytest.approx(16 - 4 + 4)
    rng = np.random.default_rng(0)
    for n in (5, 9, 14):
        ring = rng.random((n, 2))
        ring = np.concatenate([ring, ring[:1]])
        parts, points = G.rebuild([ring]), rng.random((500, 2))
        assert [G._inside([ring], p) for p in points] == [sum(G._inside(q, p) for q in parts) == 1 for p in points]
    assert G.is_simple([_ring(rng, 20, np.zeros(2), 1.0)])


def test_clip_of_concave_polygons():
    comb = ("Polygon", [np.array([(0, 0), (10, 0), (10, 2), (2, 2), (2, 8), (10, 8), (10, 10), (0, 10), (0, 0)], float)])
    got = G.clip(comb, (5, -1, 12, 12))
    assert got[0] == "MultiPolygon" and [_area(p) for p in got[1]] == [10, 10]
    cut = G.clip(("Polygon", [wkb.box(0, 0, 4, 4)[1][0], wkb.box(1, 1, 3, 3)[1][0][::-1]]), (2, -1, 5, 5))
    assert cut[0] == "Polygon" and len(cut[1]) == 1 and _area(cut) == pytest.approx(6)
    rng = np.random.default_rng(1)
    for _ in range(60):
        ring, box = _ring(rng, rng.integers(5, 14), np.zeros(2), 1.0), (-0.3, -0.4, 0.5, 0.3)
        got = G.clip(G.repair(("Polygon", [ring])), box)
        parts = [] if got is None else [got[1]] if got[0] == "Polygon" else [p[1] for p in got[1]]
        for p in rng.random((60, 2)) * [0.8, 0.7] + [-0.3, -0.4]:
            assert G._inside([ring], p) == (sum(G._inside(q, p) for q in parts) == 1)


def test_simplified_rings_stay_apart():
    x = np.linspace(0, 10, 41)
    thin = np.concatenate([np.stack([x, np.where(np.arange(41) % 2, 0.9, 0.0)], 1), np.stack([x, np.where(np.arange(41) % 2, 0.95, 0.5)], 1)[::-1], [[0, 0]]])
    assert G.is_simple(G.simplify(("Polygon", [thin]), 1.0)[1])


def _turned(features):
    """With every ring begun at its smallest point."""
    for f in features:
        if f["type"] == 3:
            for k, r in enumerate(f["geometry"]):
                i = r.index(min(r))
                f["geometry"][k] = [*r[i:-1], *r[:i], r[i]]
    return features


def test_tiles_drawn_at_once_equal_tiles_drawn_one_by_one():
    rng = np.random.default_rng(1)
    rows = []
    for k in range(150):
        c, s = (rng.random(2) - 0.5) * 3e7, 10 ** rng.uniform(3, 7)
        g = [
            lambda: wkb.point(*c),
            lambda: ("LineString", c + np.cumsum(rng.standard_normal((rng.integers(2, 40), 2)), 0) * s * 0.2),
            lambda: wkb.box(*(c - s), *(c + s)),
            lambda: ("Polygon", [_ring(rng, rng.integers(3, 25), c, s)]),
            lambda: ("MultiPolygon", [("Polygon", [_ring(rng, 9, c, s)]), ("Polygon", [_ring(rng, 12, c + 3 * s, s)])]),
            lambda: ("Polygon", [_ring(rng, 30, c, s), _ring(rng, 5, c, s * 0.1)[::-1]]),
            lambda: ("GeometryCollection", [wkb.point(*c), ("LineString", c + rng.standard_normal((5, 2)) * s), ("MultiPoint", [wkb.point(*c), wkb.point(*(c + s))])]),
        ][k % 7]()
        g = G.repair(g)
        for z in range(6) if g else ():
            b, w = wkb.bounds(g), 2 * M.HALF_WORLD / (1 << z)
            rows.append((z, min(max(int((b[0] + M.HALF_WORLD) // w), 0), (1 << z) - 1), min(max(int((M.HALF_WORLD - b[3]) // w), 0), (1 << z) - 1), wkb.dumps(g)))
    of, kind, data = tilebatch.encode_rows(*(np.array([r[k] for r in rows]) for k in range(3)), [r[3] for r in rows])
    assert (np.diff(of) >= 0).all()
    for i, (z, x, y, raw) in enumerate(rows):
        one = mvt.render(z, x, y, [(wkb.loads(raw), {})])
        want = mvt.decode(one[0])["layer0"]["features"] if one else []
        here = np.flatnonzero(of == i).tolist()
        assert _turned(mvt.decode(mvt.assemble([(int(kind[j]), data[j].as_py(), []) for j in here]))["layer0"]["features"]) == _turned(want)
    assert len(tilebatch.encode_rows(*(np.zeros(0, int),) * 3, [])[0]) == 0


def test_rows_projected_at_once_equal_rows_projected_one_by_one():
    odd = [None, b"", b"\x01\x02", wkb.dumps(("Point", None)), wkb.dumps(("Polygon", [np.array([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)], float)])), wkb.dumps(("Polygon", [wkb.box(0, 0, 1, 1)[1][0][::-1]])), wkb.dumps(("LineString", np.array([(1, 1), (1, 1), (2, 2)], float))), wkb.dumps(wkb.point(3, 95)), wkb.dumps(wkb.box(0, 0, 0, 1)), wkb.dumps(wkb.box(1, 2, 3, 4))]
    got, box = tilebatch.project_rows(odd)
    for raw, g, b in zip(odd, got, box, strict=True):
        want = G.repair(wkb.parse(raw or None))
        want = None if want is None else G.transform(want, G.to_mercator)
        assert (g is None) == (want is None)
        if want is not None:
            assert _area(wkb.loads(g)) == pytest.approx(_area(want)) and b == pytest.approx(wkb.bounds(want))
