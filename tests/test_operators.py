"""Partitions, density, statistics, tiles and the catalog."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import mvt, wkb
from tesserae.functions.boxes import Box
from tesserae.operators import density, features, partition, profile, search, tiles
from tesserae.session import configure


def test_tree_golden():
    t = partition.KDTree([[5, 0, 1, -3], [3, 1, -1, -2]])
    assert [t.find(1, 1), t.find(1, 4), t.find(6, 1)] == [0, 1, 2]
    assert t.find(5, 3) == 0  # a coordinate on the split goes low
    assert t.boxes(Box(0, 0, 10, 10)) == [Box(0, 0, 5, 3), Box(0, 3, 5, 10), Box(5, 0, 10, 10)]
    with pytest.raises(IndexError):
        t.box(3, Box(0, 0, 10, 10))


@pytest.mark.parametrize("parts", [1, 4, 16, 60])
def test_trees_balance_and_agree_with_columns(spark, parts):
    p = np.random.default_rng(42).uniform(0, 100, (1000, 2))
    t = partition.build_tree(p, parts)
    found = [t.find(x, y) for x, y in p.tolist()]
    counts = np.bincount(found, minlength=t.partitions)
    assert t.partitions >= parts and (counts > 0).all() and counts.max() <= math.ceil(1000 / parts)
    for (x, y), i in zip(p.tolist(), found, strict=True):
        assert t.box(i, Box(0, 0, 100, 100)).contains(x, y)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)] + [(-1, None, 1.0)], "id int, x double, y double")
    got = {r["id"]: r["tile_id"] for r in partition.assign(df, t).collect()}
    assert [got[i] for i in range(1000)] == found and got[-1] == 0


def test_large_trees_are_descended_in_batches(spark, monkeypatch):
    p = np.random.default_rng(3).uniform(0, 100, (600, 2))
    t = partition.build_tree(p, 60)
    odd = np.r_[p, [[np.nan, 5.0], [5.0, np.nan]]]
    assert t.find_all(p[:, 0], p[:, 1]).tolist() == [t.find(x, y) for x, y in p.tolist()]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(odd)] + [(-1, None, 1.0)], "id int, x double, y double")
    small = {r["id"]: r["tile_id"] for r in partition.assign(df, t).collect()}
    monkeypatch.setattr(partition, "MOST_CASES", 2)
    assert {r["id"]: r["tile_id"] for r in partition.assign(df, t).collect()} == small


def test_trees_of_weights_and_nothing():
    p = np.array([[float(i), 0.0] for i in range(8)])
    t = partition.build_tree(p, 2, weights=np.array([7.0, 1, 1, 1, 1, 1, 1, 1]))
    assert t.rows[0][0] == 0.0  # the heavy point is half of the weight
    assert partition.build_tree(np.zeros((0, 2)), 4, around=Box(0, 0, 1, 1)).partitions >= 4
    assert partition.build_tree(np.zeros((50, 2)), 5).partitions >= 5


def test_samples_repeat(spark):
    df = spark.range(500).select("id", F.col("id").cast("double").alias("x"), (F.col("id") * 2).cast("double").alias("y"))
    a = {r["id"] for r in partition.sample_points(df, cap=50).collect()}
    assert len(a) == 50 and a == {r["id"] for r in partition.sample_points(df.repartition(7), cap=50).collect()}
    assert 0.3 < partition.sample_points(df, cap=10**6, ratio=0.5).count() / 500 < 0.7
    assert partition.envelope(df) == Box(0, 0, 499, 998)
    with pytest.raises(ValueError):
        partition.envelope(df.limit(0))


def test_many_boxes_are_met_by_a_grid(spark):
    rows = spark.createDataFrame([(i, i * 0.7, 0.0, i * 0.7 + 1.5, 0.5) for i in range(20)] + [(99, 500.0, 0.0, 501.0, 1.0)], "id int, xmin double, ymin double, xmax double, ymax double")
    boxes = spark.createDataFrame([(i, float(i), 0.0, i + 1.0 + i % 3, 1.0, i) for i in range(20)], "id int, minx double, miny double, maxx double, maxy double, pos int")
    few = sorted(map(tuple, partition.assign_smallest_box(rows, boxes).collect()))
    assert few == sorted(map(tuple, partition.assign_smallest_box(rows, boxes, limit=3).collect())) and len(few) == 20


def test_grids_fit_any_unit(spark):
    rng = np.random.default_rng(2)
    half = 2.0e7
    rows = [(i, *c, *(c + s)) for i, (c, s) in enumerate(zip(rng.uniform(-half, half, (60, 2)), 10 ** rng.uniform(0, 6, (60, 2)), strict=True))] + [(60, -half, -half, half, half), (61, 5.0, 5.0, 5.0, 5.0)]
    boxes = [(i, *c, *(c + s), i) for i, (c, s) in enumerate(zip(rng.uniform(-half, half, (40, 2)), 10 ** rng.uniform(5, 7.3, (40, 2)), strict=True))] + [(40, -half, -half, half, half, 40)]
    r = spark.createDataFrame([tuple(map(float, x[1:])) + (x[0],) for x in rows], "xmin double, ymin double, xmax double, ymax double, id int")
    b = spark.createDataFrame([(x[0], *map(float, x[1:5]), x[5]) for x in boxes], "id int, minx double, miny double, maxx double, maxy double, pos int")
    want = sorted(map(tuple, partition.assign_smallest_box(r, b).collect()))
    assert sorted(map(tuple, partition.assign_smallest_box(r, b, limit=3).collect())) == want and len(want) == 62


def test_z_order_of_many_bits(spark):
    from tesserae.functions import mercator as M

    def spread(v):
        return sum((v >> i & 1) << 2 * i for i in range(31))

    pairs = [(65536, 1), (1 << 19, (1 << 20) - 1), ((1 << 31) - 1, 5), (0, 0)]
    got = spark.createDataFrame(pairs, "x long, y long").select(M.morton(F.col("x"), F.col("y")).alias("c")).collect()
    assert [r["c"] for r in got] == [spread(x) | spread(y) << 1 for x, y in pairs]


def cells_of(spark, array):
    r, c = np.nonzero(array)
    return spark.createDataFrame([(int(a), int(b), int(array[a, b])) for a, b in zip(r, c, strict=True)], "row int, col int, cnt long")


def test_prefix_sums_and_their_inverse(spark):
    a = np.arange(1, 17).reshape(4, 4)
    got = {(r["row"], r["col"]): r for r in density.inverse_prefix(density.prefix_sum(cells_of(spark, a))).collect()}
    want = a.cumsum(0).cumsum(1)
    assert all(got[i, j]["prefix"] == want[i, j] and got[i, j]["cell"] == a[i, j] for i in range(4) for j in range(4))
    assert want[3, 3] == 136
    assert density.rectangle_sum(cells_of(spark, a), 1, 1, 9, 2, 4).first()[0] == a[1:, 1:3].sum()
    assert density.rectangle_sum(cells_of(spark, a), 9, 9, 9, 9, 4).first()[0] == 0.0
    at = spark.createDataFrame([(2, 1, 2), (1, 0, 1), (3, 3, 3), (0, 0, 0)], "z int, x int, y int")
    values = {tuple(r)[:3]: r["value"] for r in density.value_of_tiles(at, cells_of(spark, a), 2).collect()}
    assert values == {(2, 1, 2): a[2, 1], (1, 0, 1): a[2:, :2].sum(), (3, 3, 3): a[1, 1] / 4, (0, 0, 0): 136}


def test_thresholds_and_auto_zoom(spark):
    a = np.zeros((64, 64), int)
    a[10, 10], a[20, 20] = 100, 5
    top = density.nonempty_tiles(cells_of(spark, a), 6, 50, 6).filter("z = 6").collect()
    assert [(r["row"], r["col"]) for r in top] == [(10, 10)]
    deep = density.nonempty_tiles(cells_of(spark, a), 6, 20, 7).filter("z = 7").collect()
    assert sorted((r["row"], r["col"]) for r in deep) == [(20, 20), (20, 21), (21, 20), (21, 21)]
    dense, single = np.full((64, 64), 100), np.zeros((64, 64), int)
    single[5, 5] = 1000
    assert density.auto_zoom(cells_of(spark, dense), 6, 1, 10) >= 6
    assert density.auto_zoom(cells_of(spark, single), 6, 1, 10) < 10
    zooms = [density.auto_zoom(cells_of(spark, dense), 6, t, 12) for t in (1, 10, 100, 1000)]
    assert zooms == sorted(zooms, reverse=True)
    got = {r["z"]: r["tiles"] for r in density.occupancy(cells_of(spark, dense), 6, 1, 8).collect()}
    assert got[6] == 4096 and got[7] == 4 * 4096


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, "a", True, wkb.dumps(wkb.point(0, 0))), (None, None, None, b"junk"), (3.0, "a", False, wkb.dumps(wkb.box(0, 0, 10, 10))), (float("nan"), "bcd", True, None), (5.0, "é", True, wkb.dumps(("Point", None)))], "n double, s string, b boolean, geometry binary")
    got = {a["name"]: a["stats"] for a in profile.profile(df)["attributes"]}
    n = got["n"]
    assert (n["non_null_count"], n["min"], n["max"], n["mean"], n["approx_distinct"]) == (3, 1, 5, 3, 3) and n["stddev"] == pytest.approx(math.sqrt(8 / 3))
    assert (got["s"]["avg_length"], got["s"]["min_length"], got["s"]["max_length"]) == (1.5, 1, 3)
    assert got["s"]["top_k"][0] == {"value": "a", "count": 2} and got["b"]["top_k"][0] == {"value": "True", "count": 3}
    assert got["geometry"] == {"mbr": [0, 0, 10, 10], "geom_types": {"Point": 1, "Polygon": 1}, "total_points": 6}
    assert profile.top_values(spark.range(4).withColumn("v", F.col("id")), "v", k=3).count() == 0  # 75 %
    empty = {a["name"]: a["stats"] for a in profile.profile(df.limit(0))["attributes"]}
    assert empty["n"]["non_null_count"] == 0 and empty["geometry"]["mbr"] is None and empty["s"]["avg_length"] == 0


def test_merged_statistics_equal_one_pass(spark):
    df = spark.range(4000).select(((F.col("id") * 7919) % 1009).cast("double").alias("v"), "id")
    want = {a["name"]: a["stats"] for a in profile.profile(df.select("v"))["attributes"]}["v"]
    for parts in (1, 3, 40):
        got = profile.merge_numeric(profile.partial_numeric(df, "v", F.col("id") % parts)).first()
        assert (got["min"], got["max"], got["non_null_count"]) == (want["min"], want["max"], 4000)
        assert got["approx_distinct"] == pytest.approx(1009, rel=0.03) == want["approx_distinct"]
        assert got["mean"] == pytest.approx(want["mean"]) and got["stddev"] == pytest.approx(want["stddev"])


def test_top_k_per_tile_is_cut_before_the_shuffle(spark):
    configure(spark)
    df = spark.range(30_000).select(*[(F.col("id") % 1).alias(c) for c in "zxy"], "id")
    got = tiles.top_per_tile(df, [F.desc("id")], 25_000)
    assert got.count() == 25_000
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_wide_boxes_meet_only_tiles_there_are(spark):
    w = 20037508.0
    df = spark.createDataFrame([(1, -w, -w, w, w), (2, 1.0, 1.0, 2.0, 2.0)], "id int, xmin double, ymin double, xmax double, ymax double")
    there = spark.createDataFrame([(8, r, c) for r, c in ((0, 0), (127, 128), (255, 255))], "z int, row long, col long")
    got = sorted((r["id"], r["x"], r["y"]) for r in tiles.covered_tiles(df, 8, 8, there).collect())
    assert got == [(1, 0, 0), (1, 128, 127), (1, 255, 255), (2, 128, 127)]


def test_built_tiles_agree_along_edges(spark):
    configure(spark)
    rows = [(i, f"n{i}", wkb.dumps(wkb.box(-170 + i * 3, -60, -168 + i * 3, 60))) for i in range(100)] + [(200, None, None), (201, "x", b"bad")]
    df = spark.createDataFrame(rows, "id int, name string, geometry binary").withColumn("_tile_id", F.lit(1))
    built = {(r["z"], r["x"], r["y"]): mvt.decode(bytes(r["data"]))["layer0"]["features"] for r in tiles.build_tiles(df, 1).collect()}
    assert set(built) == {(0, 0, 0)} | {(1, x, y) for x in (0, 1) for y in (0, 1)}
    assert len(built[0, 0, 0]) == 100 and set(built[0, 0, 0][0]["properties"]) == {"id", "name"}
    few = tiles.build_tiles(df, 1, k=10)
    north, south = ({f["properties"]["id"] for f in mvt.decode(bytes(few.filter(f"z = 1 and x = 0 and y = {y}").first()["data"]))["layer0"]["features"]} for y in (0, 1))
    assert north == south and len(north) == 10
    now = mvt.decode(tiles.tile_now(df, 1, 0, 0))["layer0"]["features"]
    assert {f["properties"]["id"] for f in now} == {f["properties"]["id"] for f in built[1, 0, 0]}


def test_features_as_text(spark):
    df = spark.createDataFrame([(1, 'say "hi", ok', wkb.dumps(wkb.point(1, 2))), (2, None, wkb.dumps(wkb.box(0, 0, 2, 2))), (3, "x", None)], "id int, name string, geometry binary")
    header, lines = features.csv_lines(df)
    assert header == "id,name,geometry_type,x,y"
    assert [r[0] for r in lines.collect()] == ['1,"say ""hi"", ok",Point,1.0,2.0', "2,,Polygon,,", "3,x,,,"]
    got = [json.loads(r[0]) for r in features.geojson_lines(df).collect()]
    assert got[0]["geometry"]["coordinates"] == [1, 2] and got[1]["properties"] == {"id": 2} and got[2]["geometry"] is None
    assert [r["id"] for r in features.intersecting(df, wkb.box(1.5, 1.5, 3, 3)).collect()] == [2]
    assert [r["id"] for r in features.in_box(df, Box(2, 2, 3, 3)).collect()] == [2]


def test_catalog_functions(spark):
    e = search.HashingEmbedder(64)
    df = search.embedded(spark.createDataFrame([("roads", "lines of roads and streets"), ("parks", "green parks and trees"), ("none", None)], "name string, text string"), "text", e)
    got = search.nearest(df, e.embed("streets and roads"), 2, key="name").collect()
    assert [r["name"] for r in got][0] == "roads" and len(got) == 2
    assert search.nearest(df, e.embed("x"), 0, key="name").count() == 1
    d = search.describe("my_roads", {"attributes": [{"name": "geometry", "stats": {"mbr": [0, 0, 1, 1], "geom_types": {"Point": 2}, "total_points": 2}}, {"name": "kind", "stats": {"non_null_count": 2, "approx_distinct": 2, "avg_length": 3.0, "top_k": [{"value": "a", "count": 2}]}}]}, "streets")
    assert "My Roads" in d["text"] and "Point (2)" in d["text"] and d["summary"]["attributes"] == [{"name": "kind", "role": "categorical_text", "top_values": ["a"]}]
