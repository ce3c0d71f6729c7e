"""HTTP over dataset folders: tiles, feature downloads, statistics, metadata, samples."""

from __future__ import annotations

import json
import threading
from collections import OrderedDict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import functions as F

from ..functions import wkb
from ..functions.boxes import Box
from ..functions.mercator import MAX_ZOOM
from ..operators import features as features_
from ..operators import tiles
from ..session import get_or_create
from ..functions import mercator, mvt
from ..sources import files, sinks
from .api import Dataset, dataset_dirs

#: Rows of a partition up to which the server keeps it.
KEEP_ROWS = 200_000
STATIC = {"html": "text/html", "js": "text/javascript", "css": "text/css", "json": "application/json", "png": "image/png", "svg": "image/svg+xml", "ico": "image/x-icon", "pmtiles": "application/octet-stream"}


class TileCache:
    """The most recently used tiles, or partitions."""

    def __init__(self, capacity: int = 256) -> None:
        self.capacity, self._held, self._lock = capacity, OrderedDict(), threading.Lock()

    def get(self, key):
        with self._lock:
            if key in self._held:
                self._held.move_to_end(key)
                return self._held[key]
        return None

    def put(self, key, value) -> None:
        with self._lock:
            self._held[key] = value
            self._held.move_to_end(key)
            while len(self._held) > self.capacity:
                self._held.popitem(last=False)

    def __len__(self) -> int:
        return len(self._held)


class Problem(Exception):
    def __init__(self, status: int, text: str) -> None:
        super().__init__(text)
        self.status = status


class App:
    """Routes without a socket: ``get`` and ``post`` return (status, content type, chunks)."""

    def __init__(self, data_dir: str, spark=None, cache_size: int = 256) -> None:
        self.root, self.cache, self.partitions, self.manifests = str(data_dir), TileCache(cache_size), TileCache(4), TileCache(64)
        self.spark = spark or get_or_create()

    def get(self, url: str):
        return self._answer(url, None)

    def post(self, url: str, body: bytes):
        return self._answer(url, body)

    def _answer(self, url: str, body: bytes | None):
        try:
            return self._route(url, body)
        except Problem as p:
            return p.status, "application/json", iter([json.dumps({"error": str(p)}).encode()])
        except Exception as e:  # whatever else fails is the server's fault
            return 500, "application/json", iter([json.dumps({"error": f"{type(e).__name__}: {e}".split("\n")[0]}).encode()])

    def _dataset(self, name: str) -> Dataset:
        if name not in dataset_dirs(self.root):
            raise Problem(404, f"no dataset {name}")
        return Dataset(f"{self.root}/{name}")

    def _route(self, url: str, body: bytes | None):
        u = urlparse(url)
        args = {k: v[0] for k, v in parse_qs(u.query).items()}
        parts = [p for p in u.path.split("/") if p]

        def answer(x):
            return 200, "application/json", iter([json.dumps(x, default=str).encode()])

        if body is not None and not (len(parts) == 3 and parts[0] == "datasets" and parts[2].startswith("features.")):
            raise Problem(405, "POST is for feature downloads")
        if not parts:
            page = "<ul>" + "".join(f'<li><a href="/datasets/{d}.json">{d}</a></li>' for d in dataset_dirs(self.root)) + "</ul>"
            return 200, "text/html", iter([page.encode()])
        if parts == ["api", "datasets"]:
            return answer({"datasets": dataset_dirs(self.root)})
        if parts == ["datasets.json"]:
            q = args.get("q", "").lower()
            shown = [{"id": d, "name": d.replace("_", " ").title(), "size": self._size(d)} for d in dataset_dirs(self.root)]
            return answer({"datasets": [s for s in shown if q in s["name"].lower() or q in s["id"].lower()]})
        if len(parts) == 4 and parts[:2] == ["api", "datasets"] and parts[3] == "stats":
            ds = self._dataset(parts[2])
            if not ds.has_stats:
                raise Problem(404, "no statistics")
            return answer(ds.stats())
        if len(parts) == 2 and parts[0] == "datasets" and parts[1].endswith(".json"):
            name = parts[1][:-5]
            ds = self._dataset(name)
            return answer({"id": name, "name": name.replace("_", " ").title(), "size": self._size(name), "files": ds.num_tiles, "bbox": ds.bbox, "zoom_levels": ds.zoom_levels})
        if len(parts) == 2 and parts[0] == "datasets" and parts[1].endswith(".html"):
            self._dataset(parts[1][:-5])
            return 302, f"/datasets/{parts[1][:-5]}.json", iter([])
        if len(parts) == 4 and parts[0] == "datasets" and parts[2] == "features" and parts[3] in ("sample.json", "sample.geojson"):
            return self._sample(parts[1], parts[3].endswith("geojson"), args)
        if len(parts) == 3 and parts[0] == "datasets" and parts[2].startswith("features."):
            return self._features(parts[1], parts[2].split(".", 1)[1], args, body)
        if len(parts) == 4 and parts[3].endswith(".mvt"):
            return self._tile(parts[0], parts[1], parts[2], parts[3][:-4])
        kind = STATIC.get(parts[-1].rsplit(".", 1)[-1].lower())
        path = "/".join([self.root, *parts])
        if kind and ".." not in parts and not parts[0].startswith((".", "_")) and files.is_file(path):
            return 200, kind, iter([files.read(path)])
        raise Problem(404, "no such page")

    def _size(self, name: str) -> int:
        return sum(files.size(f) for f, folder in files.listing(f"{self.root}/{name}", recursive=True) if not folder)

    def _tile(self, name: str, *address: str):
        ds = self._dataset(name)
        try:
            z, x, y = map(int, address)
        except ValueError:
            raise Problem(400, "a tile is z/x/y") from None
        if not (0 <= z <= MAX_ZOOM and 0 <= x < 1 << z and 0 <= y < 1 << z):
            raise Problem(400, "no such tile")
        key = (name, z, x, y)
        data = self.cache.get(key)
        if data is None:
            file = f"{ds.path}/mvt/{z}/{x}/{y}.mvt"
            data = files.read(file) if files.is_file(file) else self._drawn(ds, z, x, y)
            self.cache.put(key, data)
        return 200, "application/vnd.mapbox-vector-tile", iter([data])

    def _drawn(self, ds: Dataset, z: int, x: int, y: int) -> bytes:
        """A tile that isn't built: from partitions that are held, if they are few and small, else by Spark."""
        if not files.is_dir(f"{ds.path}/manifest"):
            return tiles.tile_now(sinks.read_tiles(self.spark, ds.path), z, x, y)
        manifest = self.manifests.get(ds.path)
        if manifest is None:
            manifest = self.spark.read.parquet(f"{ds.path}/manifest").toPandas()  # a row a partition
            self.manifests.put(ds.path, manifest)
        a, b, c, d = mercator.lonlat_of_tile(z, x, y)
        hit = manifest[(manifest.xmax >= a) & (manifest.xmin <= c) & (manifest.ymax >= b) & (manifest.ymin <= d)]
        if len(hit) > self.partitions.capacity or (hit["rows"] > KEEP_ROWS).any():
            return tiles.tile_now(sinks.read_tiles(self.spark, ds.path), z, x, y)
        minx, miny, maxx, maxy = mercator.bounds_of_tile(z, x, y)
        rows = []
        for tile_id in hit.tile_id.tolist():
            held = self.partitions.get((ds.path, tile_id))
            if held is None:
                held = tiles.prepare(sinks.read_tiles(self.spark, ds.path).filter(F.col("_tile_id") == tile_id)).toPandas()  # KEEP_ROWS at most
                self.partitions.put((ds.path, tile_id), held)
            rows.append(held[(held.xmax >= minx) & (held.xmin <= maxx) & (held.ymax >= miny) & (held.ymin <= maxy)])
        found = [r for p in rows for r in p[["priority", "wkb", "properties"]].itertuples(index=False)]
        found = sorted(found, key=lambda r: (-r.priority, bytes(r.wkb)))[: tiles.MAX_ON_THE_FLY]
        got = mvt.render(z, x, y, [(wkb.loads(bytes(r.wkb)), json.loads(r.properties)) for r in found], pad=0)
        return got[0] if got else mvt.empty_tile()

    def _box(self, args: dict) -> Box | None:
        if "mbr" not in args:
            return None
        try:
            return Box.parse(args["mbr"])
        except ValueError as e:
            raise Problem(400, str(e)) from None

    def _features(self, name: str, fmt: str, args: dict, body: bytes | None):
        if fmt not in features_.FORMATS:
            raise Problem(400, f"format {fmt!r}")
        ds, box, area = self._dataset(name), self._box(args), None
        if body is not None:
            try:
                area = wkb.from_geojson(json.loads(body)["geometry"])
            except (ValueError, KeyError, TypeError):
                area = None
            if area is None:
                raise Problem(400, "a geometry is needed")
            b = wkb.bounds(area)
            box = box or (Box(*b) if b else None)
        df = sinks.read_tiles(self.spark, str(ds.path), box)
        if area is not None:
            df = features_.intersecting(df, area)
        df = df.filter(F.col("geometry").isNotNull())
        kind, pieces = features_.FORMATS[fmt]
        return 200, kind, (t.encode() for t in pieces(df, "geometry"))

    def _sample(self, name: str, whole: bool, args: dict):
        ds, box = self._dataset(name), self._box(args)
        if box is None:
            raise Problem(400, "mbr is needed")
        row = sinks.read_tiles(self.spark, str(ds.path), box).limit(1).select(features_.geojson_feature(sinks.read_tiles(self.spark, str(ds.path), box)).alias("value")).collect()
        if not row:
            raise Problem(404, "no feature there")
        feature = json.loads(row[0][0])
        return 200, "application/json", iter([json.dumps(feature if whole else feature["properties"]).encode()])


def create_app(data_dir: str, cache_size: int = 256, spark=None) -> App:
    return App(data_dir, spark, cache_size)


def serve(data_dir: str, host: str = "127.0.0.1", port: int = 8765, cache_size: int = 256) -> None:
    app = create_app(data_dir, cache_size)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self._send(app.get(self.path))

        def do_POST(self):  # noqa: N802
            self._send(app.post(self.path, self.rfile.read(int(self.headers.get("Content-Length", 0)))))

        def _send(self, got):
            status, kind, chunks = got
            self.send_response(status)
            self.send_header("Location" if status == 302 else "Content-Type", kind)
            self.end_headers()
            for c in chunks:
                self.wfile.write(c)

    ThreadingHTTPServer((host, port), Handler).serve_forever()
