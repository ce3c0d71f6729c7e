"""Sources, sinks, the public functions, routes, commands and streams, end to end on small datasets."""

import gzip
import json
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import mvt, wkb
from tesserae.functions.boxes import Box
from tesserae.plans import api, cli, queries
from tesserae.plans.server import TileCache, create_app
from tesserae.session import configure
from tesserae.sources import files, readers, sinks
from tesserae.streaming import incremental


def collection(n, extra=None):
    return {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "EPSG:4326"}}, "features": [{"type": "Feature", "id": f"f{i}", "geometry": {"type": "Point", "coordinates": [i, 2 * i]}, "properties": {"id": i, "name": f"é {i}", **(extra(i) if extra else {})}} for i in range(n)]}


def ids(spark, path, split):
    return sorted(r["id"] for r in readers.read_geojson(spark, str(path), split_bytes=split).select("id").collect())


@pytest.mark.parametrize("indent", [None, 2])
def test_every_feature_once_whatever_the_split(spark, tmp_path, indent):
    tricky = lambda i: {"text": '{"type":"Feature","properties":{}} \\" {', "nested": {"type": "Feature", "properties": {"a": i}}, "type": "Feature"}
    f = tmp_path / "a.geojson"
    f.write_text(json.dumps(collection(40, tricky), indent=indent))
    size = f.stat().st_size
    for split in (size, size // 4, 97, 1000):
        found = [json.loads(raw)["properties"]["id"] for o, n in readers.byte_ranges(size, -(-size // split)) for raw in readers.features_in(str(f), o, n)]
        assert sorted(found) == list(range(40)), split
    assert ids(spark, f, size // 4) == list(range(40))
    assert readers.crs_hint(str(f)) == "EPSG:4326"


def test_type_behind_other_members_and_lines(spark, tmp_path):
    lines = "\n".join(json.dumps({"geometry": None, "properties": {"id": i, "m": {"b": 1, "a": [i]}}, "type": "Feature"}) for i in range(9))
    (tmp_path / "x.jsonl").write_text(lines)
    assert ids(spark, tmp_path / "x.jsonl", 200) == list(range(9))
    df = readers.read_geojson(spark, str(tmp_path / "x.jsonl"))
    assert df.filter("id = 3").first().asDict() == {"geometry": None, "id": 3, "m": '{"a":[3],"b":1}'}
    assert df.schema["m"].dataType.simpleString() == "string"


def test_long_ranges_are_scanned_once(tmp_path):
    """60,000 features in one range; a copy of the text for each of them took minutes."""
    path = tmp_path / "long.jsonl"
    path.write_text("\n".join('{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"id":%d,"name":"%s"}}' % (i, "x" * 60) for i in range(60_000)))
    start = time.process_time()
    assert sum(1 for _ in readers.features_in(str(path), 0, path.stat().st_size)) == 60_000
    assert time.process_time() - start < 8


def test_small_ranges_share_tasks_and_tasks_write_files(spark, tmp_path):
    rows = [(i, f"a\n\"{i}\"", wkb.dumps(wkb.point(i, -i))) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, name string, geometry binary").repartition(3)
    assert sinks.write_features(df, str(tmp_path / "f")) == 500
    assert [f.rsplit("/", 1)[1] for f in readers.list_files(str(tmp_path / "f"))] == ["part-0.geojson", "part-1.geojson", "part-2.geojson"] and not (tmp_path / "f" / "_temporary").exists()
    back = readers.read_geojson(spark, str(tmp_path / "f"), split_bytes=500)
    assert back.rdd.getNumPartitions() == 1  # of over 100 ranges
    assert sorted((r["id"], r["name"], bytes(r["geometry"])) for r in back.collect()) == rows
    ranges = [("a", 0, 5), ("a", 5, 5), ("b", 0, 3), ("c", 0, 20), ("d", 0, 1)]
    assert readers.packed(ranges, 10) == [ranges[:2], ranges[2:3], ranges[3:4], ranges[4:]] and readers.packed(ranges, 1) == [[r] for r in ranges]


@pytest.mark.parametrize("length", [1 << 20, 1 << 30])
def test_type_far_behind_its_brace(tmp_path, length):
    rows = ['{"properties": {"id": %d}, "note": "%s", "type": "Feature", "geometry": null}' % (i, "x" * n) for i, n in enumerate((10, 5 << 20, 10, 9 << 20))]
    path = tmp_path / "far.geojson"
    path.write_text('{"type": "FeatureCollection", "features": [' + ", ".join(rows) + "]}")
    size = path.stat().st_size
    got = [json.loads(f)["properties"]["id"] for i in range(0, size, length) for f in readers.features_in(str(path), i, min(length, size - i))]
    assert got == [0, 1, 2, 3]


def against_sql(spark, name, folder):
    """Rows of a query and of its SQL over a folder of tables, as texts, so that -0.0 isn't 0.0."""
    import duckdb

    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f / '*.parquet' if f.is_dir() else f}')")
    got = sorted(repr(tuple(r)) for r in queries.QUERIES[name](spark, str(folder)).collect())
    return got, sorted(map(repr, con.execute(queries.ORACLES[name]).fetchall()))


def test_vectors_of_length_one_are_rounded_as_the_sql_rounds(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    odd = [[3.0, 4.0], [-1e-9, 1.0], [-0.0, 1.0], [0.0, -0.0], [0.0, None], [None, 3.0, 4.0], [None, None], [], None, [nan, 1.0], [None, nan], [inf, -1.0], [inf, None, 2.0], [1e-45, 0.0]]
    spark.createDataFrame(list(enumerate(odd)), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got, want = against_sql(spark, "l2_normalise", tmp_path)
    assert got == want and "-0.0" in str(want) and "nan" in str(want)


def test_coordinates_that_round_to_zero_keep_their_sign(spark, tmp_path):
    """Latitude 0 is a little below 0 m (events), and so are places on some tiles' edges (customers)."""
    spark.range(100_000).filter("id % 17000 in (8500, 1)").select(F.col("id").alias("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(6850, 8), (11900, 22), (14950, 11), (1, 5)], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    for name in ("mercator_project", "tile_space"):
        got, want = against_sql(spark, name, tmp_path)
        assert got == want and "-0.0" in str(want)


def test_schema_is_locked(spark, tmp_path):
    f = tmp_path / "a.json"
    c = collection(3)
    c["features"][1]["properties"] = {"id": "not a number", "name": 5, "new": 1}
    c["features"][2]["properties"] = {"tagsMap": {"b": "2"}}
    f.write_text(json.dumps(c))
    df = readers.read_geojson(spark, str(f), readers.infer_schema(str(f), 1))
    assert df.columns == ["geometry", "id", "name"]
    assert [(r["id"], r["name"]) for r in df.collect()] == [(0, "é 0"), (None, "5"), (None, None)]


def test_source_choice(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_dataset(spark, str(tmp_path / "none"))
    (tmp_path / "d").mkdir()
    with pytest.raises(ValueError):
        readers.kind_of(str(tmp_path / "d"))
    for i in range(2):
        (tmp_path / "d" / f"{i}.geojson").write_text(json.dumps(collection(i + 1)))
    assert readers.read_dataset(spark, str(tmp_path / "d")).count() == 3
    (tmp_path / "d" / "x.parquet").write_bytes(b"")
    with pytest.raises(ValueError):
        readers.kind_of(str(tmp_path / "d"))
    assert readers.byte_ranges(0, 3) == [] and readers.byte_ranges(10, 3) == [(0, 4), (4, 4), (8, 2)]
    assert [readers.partition_count(n, 10) for n in (0, 10, 11)] == [1, 1, 2]
    with pytest.raises(ValueError):
        readers.partition_count(1, 0)


def test_parquet_source(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    t = pa.table({"geometry": [wkb.dumps(wkb.point(i, i)) for i in range(5)], "id": range(5)})
    (tmp_path / "p" / "deep").mkdir(parents=True)
    pq.write_table(t, tmp_path / "p" / "a.parquet", row_group_size=2)
    pq.write_table(t, tmp_path / "p" / "deep" / "b.geoparquet")
    df = readers.read_dataset(spark, str(tmp_path / "p"))
    assert df.count() == 10
    only = readers.read_parquet(spark, str(tmp_path / "p"), geometry_only=True)
    assert "ReadSchema: struct<geometry:binary>" in only._jdf.queryExecution().explainString(only._jdf.queryExecution().explainMode() if False else spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    with pytest.raises(ValueError):
        readers.read_parquet(spark, str(tmp_path / "p"), geometry="shape")
    assert [(f.rsplit("/", 1)[1], g) for f, g in readers.row_group_splits(str(tmp_path / "p"))] == [("a.parquet", [0]), ("a.parquet", [1]), ("a.parquet", [2]), ("b.geoparquet", [0])]
    assert len(readers.row_group_splits(str(tmp_path / "p"), 2)) == 3


def test_partition_csv(spark, tmp_path):
    f = tmp_path / "i.csv"
    f.write_text("id,minx,miny,maxx,maxy\n3,0,0,1,1\n4,1,1,2,2\n")
    assert [r["id"] for r in readers.read_partition_boxes(spark, str(f)).orderBy("pos").collect()] == [3, 4]
    f.write_text("id,minx\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_partition_boxes(spark, str(f))


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """A folder with one built dataset."""
    configure(spark)
    base = tmp_path_factory.mktemp("data")
    rng = np.random.default_rng(1)
    rows = [(i, f"place {i % 3}", wkb.dumps(wkb.point(*rng.uniform(-80, 80, 2)))) for i in range(300)] + [(300, "box, big", wkb.dumps(wkb.box(-10.25, -0.5, 40, 30))), (301, None, None)]
    spark.createDataFrame(rows, "id int, name string, geometry binary").repartition(3).write.parquet(str(base / "in"))
    first, second, archive = api.build(str(base / "in"), str(base / "sets" / "some_places"), zoom=2, partition_size=2000, threshold=1, pmtiles=True, histogram_zoom=6, covering_bbox=True, spark=spark)
    return base, first, second, archive


def test_built_dataset(spark, root):
    base, first, second, archive = root
    out = str(base / "sets" / "some_places")
    ds = api.Dataset(out)
    df = spark.read.parquet(f"{out}/parquet_tiles")
    assert first.total_rows == df.count() == 302 and first.num_files == ds.num_tiles == df.select("_tile_id").distinct().count() > 2
    assert ds.bbox == pytest.approx(first.bbox) and ds.has_stats and ds.has_histograms and ds.zoom_levels == [0, 1, 2] == second.zoom_levels
    m = {r["tile_id"]: r for r in spark.read.parquet(f"{out}/manifest").collect()}
    inside = df.filter("geometry is not null").groupBy("_tile_id").agg(F.min("_bbox_xmin").alias("a"), F.max("_bbox_ymax").alias("b")).collect()
    assert all((m[r["_tile_id"]]["xmin"], m[r["_tile_id"]]["ymax"]) == (r["a"], r["b"]) for r in inside)
    assert sum(r["rows"] for r in m.values()) == 302
    box = Box(0, 0, 20, 20)
    got = {r["id"] for r in sinks.read_tiles(spark, out, box).collect()}
    want = {r["id"] for r in df.filter("_bbox_xmax >= 0 and _bbox_xmin <= 20 and _bbox_ymax >= 0 and _bbox_ymin <= 20").collect()}
    assert got == want and 300 in got
    plan = sinks.read_tiles(spark, out, box)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "_tile_id" in plan.split("PartitionFilters: [")[1].split("]")[0] and "_bbox_xmax" in plan.split("PushedFilters: [")[1].split("]")[0]
    prefix = sinks.read_histogram(f"{out}/histograms/global.npy")
    assert prefix[-1, -1] == 305 == json.loads((base / "sets/some_places/histograms/global.json").read_text())["sum"]
    assert sinks.prefix_value(prefix, 0, 0, 0) == 305 and sinks.prefix_value(prefix, 1, 9, 0) == 0.0
    assert sum(sinks.prefix_value(prefix, 2, x, y) for x in range(4) for y in range(4)) == 305
    assert (np.load(f"{out}/histograms/global_prefix.npy") == prefix).all()
    top = mvt.decode(files.read(f"{ds.path}/mvt/0/0/0.mvt"))["layer0"]["features"]
    assert len(top) == 301 and set(top[0]["properties"]) <= {"id", "name"}


def test_archive_holds_the_tiles(root):
    base, _, second, archive = root
    raw = open(archive, "rb").read()
    n = struct.unpack("<11Q", raw[8:96])
    assert raw[:8] == b"PMTiles\x03" and n[8] == second.tile_count
    data = gzip.decompress(raw[n[0] : n[0] + n[1]])
    numbers = []
    i = 0
    while i < len(data):
        v, i = mvt._take(data, i)
        numbers.append(v)
    k = numbers[0]
    tile_ids = np.cumsum(numbers[1 : k + 1])
    assert tile_ids[0] == 0 and (np.diff(tile_ids) > 0).all()
    length, offset = numbers[1 + 2 * k], numbers[1 + 3 * k] - 1
    first = gzip.decompress(raw[n[6] + offset : n[6] + offset + length])
    assert first == (base / "sets/some_places/mvt/0/0/0.mvt").read_bytes()
    with pytest.raises(ValueError):
        sinks.write_archive([], str(base / "x.pmtiles"))
    with pytest.raises(FileNotFoundError):
        api.export_pmtiles(str(base / "nowhere"), str(base / "x.pmtiles"))


@pytest.mark.parametrize("sort", ["Hilbert", "none", "columns", "odd"])
def test_other_orders(spark, root, tmp_path, sort):
    base = root[0]
    r = api.tile(str(base / "in"), str(tmp_path / "o"), sort=sort, sort_keys=[("id", False)] if sort == "columns" else None, covering_bbox=sort != "none", histogram_zoom=4, orchestrator="two_stage", spark=spark)
    assert r.total_rows == 302 and r.histogram_path.endswith("global_prefix.npy")
    near = {r["id"] for r in sinks.read_tiles(spark, str(tmp_path / "o"), Box(0, 0, 20, 20)).collect()}
    assert near == {r["id"] for r in sinks.read_tiles(spark, str(base / "sets" / "some_places"), Box(0, 0, 20, 20)).collect()}
    with pytest.raises(ValueError):
        api.tile(str(base / "in"), str(tmp_path / "p"), orchestrator="other", spark=spark)
    with pytest.raises(TypeError):
        api.tile(str(base / "in"), str(tmp_path / "p"), partition_sise=1, spark=spark)


def test_tile_files_carry_their_bounds(spark, root):
    import pyarrow.parquet as pq

    out = str(root[0] / "sets" / "some_places")
    bounds = {r["tile_id"]: r for r in spark.read.parquet(f"{out}/manifest").collect()}
    found = [f for f, folder in files.listing(f"{out}/parquet_tiles", recursive=True) if not folder]
    assert len(found) == len(bounds)
    for f in found:
        geo = json.loads(pq.ParquetFile(f).metadata.metadata[b"geo"])
        r = bounds[int(f.split("_tile_id=")[1].split("/")[0])]
        assert geo["primary_column"] == "geometry" and geo["columns"]["geometry"]["encoding"] == "WKB"
        assert geo["columns"]["geometry"]["bbox"] == [r["xmin"], r["ymin"], r["xmax"], r["ymax"]]


@pytest.mark.parametrize("sort", ["zorder", "hilbert", "columns", "none"])
def test_large_tiles_are_several_tasks(spark, tmp_path, monkeypatch, sort):
    """About as many rows a task, whatever tiles they are in; every row once, tiles in order over their files."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(sinks, "TASK_ROWS", 100)
    x, y = (F.col("id") * 37 % 360 - 180).cast("double"), (F.col("id") * 91 % 180 - 90).cast("double")
    df = spark.range(0, 2000, 1, 3).select("id", x.alias("_cx"), y.alias("_cy"), x.alias("_bbox_xmin"), y.alias("_bbox_ymin"), x.alias("_bbox_xmax"), y.alias("_bbox_ymax"), F.lit(None).cast("binary").alias("geometry"))
    df = df.withColumn("_tile_id", F.when(F.col("id") % 50 == 0, 1).when(F.col("id") % 51 == 0, 2).otherwise(7))
    n = sinks.write_tiles(sinks.clustered(df, Box(-180, -90, 180, 90), sort, keys=[("id", False)]), str(tmp_path))
    sinks.write_manifest(df, str(tmp_path))
    got = [(int(f.split("_tile_id=")[1].split("/")[0]), pq.ParquetFile(f)) for f, folder in files.listing(f"{tmp_path}/parquet_tiles", recursive=True) if not folder]
    ids = [(t, i) for t, f in got for i in f.read(["id"]).column("id").to_pylist()]
    assert len(got) == n > 15 and max(f.metadata.num_rows for _, f in got) < 250
    assert sorted(i for _, i in ids) == list(range(2000)) and all(t == (1 if i % 50 == 0 else 2 if i % 51 == 0 else 7) for t, i in ids)
    if sort == "columns":
        assert ids == sorted(ids, key=lambda r: (r[0], -r[1]))
    for _, f in got:
        box, t = json.loads(f.metadata.metadata[b"geo"])["columns"]["geometry"]["bbox"], f.read(["_bbox_xmin", "_bbox_ymax"]).to_pandas()
        assert (box[0], box[3]) == (t["_bbox_xmin"].min(), t["_bbox_ymax"].max())
    assert sinks.read_tiles(spark, str(tmp_path), Box(0, 0, 40, 40)).count() == df.filter("_cx between 0 and 40 and _cy between 0 and 40").count()


def test_tiles_named_by_their_bounds(spark, tmp_path):
    d = tmp_path / "sets" / "flat" / "parquet_tiles"
    d.mkdir(parents=True)
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name, x in (("tile_000000__-1_5_0_0_1_5_2_0", 0.0), ("tile_000001__10_0_10_0_12_25_12_0", 11.0), ("odd", 50.0)):
        pq.write_table(pa.table({"geometry": [wkb.dumps(wkb.point(x, 1.0 + (x > 5) * 10))], "id": [int(x)]}), d / f"{name}.parquet")
    ds = api.Dataset(str(tmp_path / "sets" / "flat"))
    assert ds.num_tiles == 3 and ds.bbox == pytest.approx((-1.5, 0, 12.25, 12), abs=0.2)
    assert [r["id"] for r in sinks.read_tiles(spark, ds.path, Box(9, 9, 20, 20)).collect()] == [11]
    assert sinks.read_tiles(spark, ds.path).count() == 3
    assert sinks.named_box("tile_1__a_b_c_d.parquet") is None and sinks.named_box("tile_1__-0_25_1_0_2_0_3_0.parquet")[0] == pytest.approx(-0.26)


def test_schema_of_all_features(spark, tmp_path):
    c = collection(1500, lambda i: {"late": i} if i >= 1200 else {"mixed": 1})
    c["features"][3]["properties"]["mixed"] = 1.5
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.geojson").write_text(json.dumps(c))
    (tmp_path / "d" / "b.geojson").write_text(json.dumps(collection(2, lambda i: {"other": True})))
    df = readers.read_geojson(spark, str(tmp_path / "d"))
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("geometry", "binary"), ("id", "bigint"), ("name", "string"), ("mixed", "double"), ("late", "bigint"), ("other", "boolean")]
    assert df.agg(F.count("late"), F.count("other")).first() == (300, 2)
    assert readers.infer_schema(str(tmp_path / "d")) == df.schema


def test_first_vertices_are_sampled(spark):
    g = wkb.dumps(("GeometryCollection", [("LineString", np.array([(3.0, 4.0), (9.0, 9.0)])), wkb.point(1, 1)]))
    r = api.located(spark.createDataFrame([(g,), (None,)], "geometry binary"), "geometry", True).collect()
    assert [(x["_sx"], x["_sy"]) for x in r] == [(3.0, 4.0), (None, None)]


def body(got):
    return got[0], b"".join(got[2])


def test_routes(spark, root):
    base = root[0]
    app = create_app(str(base / "sets"), spark=spark)
    assert json.loads(body(app.get("/api/datasets"))[1]) == {"datasets": ["some_places"]}
    assert body(app.get("/"))[0] == 200
    assert json.loads(body(app.get("/datasets.json?q=SOME"))[1])["datasets"][0]["name"] == "Some Places" and json.loads(body(app.get("/datasets.json?q=zz"))[1]) == {"datasets": []}
    assert json.loads(body(app.get("/datasets/some_places.json"))[1])["files"] > 2
    assert app.get("/datasets/some_places.html")[0] == 302
    assert "attributes" in json.loads(body(app.get("/api/datasets/some_places/stats"))[1])
    status, data = body(app.get("/some_places/1/0/0.mvt"))
    assert status == 200 and mvt.decode(data)["layer0"]["features"]
    deep = body(app.get("/some_places/3/4/3.mvt"))  # not built before
    assert deep[0] == 200 and "layer0" in mvt.decode(deep[1])
    assert body(app.get("/some_places/3/4/3.mvt"))[1] == deep[1] and len(app.partitions) > 0
    assert json.loads(body(app.get("/some_places/histograms/global.json"))[1])["grid_size"] == 64 and app.get("/../in")[0] == 404
    app._route, kept = (lambda *a: 1 / 0), app._route
    assert app.get("/")[0] == 500
    app._route = kept
    for url, want in (("/none/0/0/0.mvt", 404), ("/some_places/1/5/0.mvt", 400), ("/some_places/a/0/0.mvt", 400), ("/datasets/some_places/features.xml", 400), ("/datasets/some_places/features.csv?mbr=1,2", 400), ("/datasets/none/features.csv", 404), ("/api/datasets/none/stats", 404), ("/datasets/some_places/features/sample.json", 400), ("/nothing/here", 404)):
        assert app.get(url)[0] == want, url
    lines = body(app.get("/datasets/some_places/features.csv?mbr=0,0,20,20"))[1].decode().splitlines()
    assert lines[0] == "id,name,geometry_type,x,y" and '300,"box, big",Polygon,,' in lines
    got = json.loads(body(app.get("/datasets/some_places/features.geojson?mbr=0,0,20,20"))[1])["features"]
    assert len(got) == len(lines) - 1
    area = {"geometry": {"type": "Polygon", "coordinates": [[[0, 0], [20, 0], [20, 20], [0, 0]]]}}
    few = json.loads(body(app.post("/datasets/some_places/features.geojson", json.dumps(area).encode()))[1])["features"]
    assert 0 < len(few) < len(got) and all(f["properties"]["id"] == 300 or f["geometry"]["coordinates"][0] >= f["geometry"]["coordinates"][1] for f in few)
    assert app.post("/datasets/some_places/features.geojson", b"{}")[0] == 400 and app.post("/api/datasets", b"")[0] == 405
    sample = json.loads(body(app.get("/datasets/some_places/features/sample.geojson?mbr=0,0,20,20"))[1])
    assert sample["type"] == "Feature"


def test_cache_forgets_the_oldest():
    c = TileCache(2)
    c.put(1, b"a"), c.put(2, b"b"), c.get(1), c.put(3, b"c")
    assert (c.get(1), c.get(2), len(c)) == (b"a", None, 2)


def test_catalog(spark, root):
    base = str(root[0] / "sets")
    with pytest.raises(FileNotFoundError):
        api.search_catalog(str(root[0]), "x", spark=spark)
    assert api.build_catalog(base, spark).count() == 1
    assert api.search_catalog(base, "some places", spark=spark).first()["dataset"] == "some_places"
    assert json.loads(files.read(f"{base}/_catalog.json"))["version"] == 2 and np.load(f"{base}/_catalog.npy").shape == (1, 256)
    for wrong in ({"backend": "other"}, {"backend": "jdbc"}):
        with pytest.raises(ValueError):
            api.search_catalog(base, "x", spark=spark, **wrong)


def test_commands(root, capsys):
    assert cli.main(["info", "--dir", str(root[0] / "sets" / "some_places")]) == 0
    assert "tiles" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["unknown"])


def test_commands_take_the_functions_parameters():
    import inspect

    args = vars(cli.parser().parse_args(["tile", "--input", "a", "--outdir", "b", "--partition-size", "2mb", "--covering-bbox", "--two-stage-reducers", "3"]))
    assert args["partition_size"] == 2 << 20 and args["covering_bbox"] and args["two_stage_reducers"] == 3
    assert set(args) - {"command", "log_level"} <= set(inspect.signature(api.tile).parameters)
    args = vars(cli.parser().parse_args(["build", "--input", "a", "--outdir", "b", "--zoom", "3"]))
    assert set(args) - {"command", "log_level"} <= set(inspect.signature(api.build).parameters) | set(inspect.signature(api.tile).parameters)


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 5}:10:00", float(i % 7) * 20, 10.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, ts string, lon double, lat double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.keep(incremental.density(stream, 4), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    from tesserae.operators.density import histogram

    want = sorted(map(tuple, histogram(df, 4).collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want
    q = incremental.windowed_density(stream, 4, "ts").writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select count(distinct start) from windows").first()[0] >= 3


def test_entry_and_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(queries.ORACLES) <= set(e.queries()) and len(queries.ORACLES) > 40
    assert sum(r["rows"] for r in e.queries()["rstar_partitions"](spark, "/root/testdata/sf0.001").collect()) == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
    assert e.queries()["vector_tiles"](spark, "/root/testdata/sf0.001").count() > 10
