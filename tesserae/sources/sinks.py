"""Writing datasets: clustered Parquet tiles with a manifest, histograms, tile files, archives, features.

A dataset folder holds parquet_tiles/ (Parquet, one folder a partition), manifest/
(tile_id, bounds, rows), histograms/, stats/attributes.json and mvt/z/x/y.mvt.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mercator as M
from ..functions import wkb
from ..functions.boxes import Box
from . import files

ROW_GROUP_BYTES = 8 << 20
#: Rows that one task sorts and writes, about; more tasks for more rows.
TASK_ROWS = 1 << 18


def with_boxes(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Covering-box columns, by which readers skip row groups."""
    x = df.withColumn("__b", wkb.st_bounds(geometry))
    return x.withColumns({f"_bbox_{n}": F.col(f"__b.{n}") for n in ("xmin", "ymin", "xmax", "ymax")}).drop("__b")


def clustered(df: DataFrame, extent: Box, sort: str = "zorder", bits: int = 16, keys: list | None = None, geometry: str = "geometry") -> DataFrame:
    """Rows by tile_id, each task's rows in the wanted order: zorder, hilbert, columns or none.

    Up to TASK_ROWS rows, a task has whole tiles.  More rows are dealt by ranges of (tile, order),
    about TASK_ROWS a task, so that a large tile is that of several tasks, one behind the other."""
    order = []
    if sort == "columns":
        order = [F.col(k[0]).asc() if k[1] else F.col(k[0]).desc() for k in (k if isinstance(k, tuple) else (k, True) for k in keys or [])]
    elif sort != "none":
        x = M.scale_to_uint(F.col("_cx"), extent.xmin, extent.xmax, bits)
        y = M.scale_to_uint(F.col("_cy"), extent.ymin, extent.ymax, bits)
        df = df.withColumn("_sfc", M.hilbert(x, y, bits)) if sort == "hilbert" else M.with_morton(df, x, y, "_sfc")
        # rows without a place come last
        df = df.withColumn("_sfc", F.when(F.col("_cx").isNull(), F.lit(2**63 - 1)).otherwise(F.col("_sfc")))
        order = [F.col("_sfc")]
    tasks = -(-df.count() // TASK_ROWS)
    if tasks <= 1:
        df = df.repartition(F.col("_tile_id"))
    else:  # what is equal in the order is told apart by its values
        values = [F.col(f"`{f.name}`") for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
        df = df.repartitionByRange(tasks, F.col("_tile_id"), *order, F.xxhash64(*values))
    return df.sortWithinPartitions("_tile_id", *order).drop("_sfc")


def geo_block(geometry: str, crs: str | None, bounds: list[float] | None, types: list[str]) -> dict:
    """The ``geo`` entry of a GeoParquet footer (1.1.0)."""
    column: dict = {"encoding": "WKB", "geometry_types": types}
    if crs:
        column["crs"] = crs
    if bounds:
        column["bbox"] = bounds
    return {"version": "1.1.0", "primary_column": geometry, "columns": {geometry: column}}


def write_tiles(df: DataFrame, outdir: str, compression: str = "zstd", geometry: str = "geometry", crs: str | None = None, boxes: bool = True) -> int:
    """One GeoParquet file a tile and task, in a folder by _tile_id, which readers prune; how many.

    Each task holds tiles, or a part of a large one (``clustered``), row by row in order; a
    file's footer has its rows' bounds, and its name the task's number, by which the files of a
    tile are in order.  A file is written under a name of its own and moved into place,
    so a task that runs again leaves one file.  Internal columns aren't written."""
    root = f"{outdir}/parquet_tiles"
    files.remove(root)
    drop = {"_cx", "_cy", "_tile_id"} | (set() if boxes else {f"_bbox_{n}" for n in ("xmin", "ymin", "xmax", "ymax")})

    def write(batches):
        import uuid

        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        tile, writer, out, path, bounds, held, size, done = None, None, None, "", [], [], 0, 0
        task, times = TaskContext.get().partitionId(), Counter()

        def flush():
            nonlocal held, size
            if held:
                writer.write_table(pa.Table.from_batches(held))  # a row group
            held, size = [], 0

        def close():
            nonlocal done
            if writer is None:
                return
            flush()
            low = [pc.min(pa.array([x for x in (b[i] for b in bounds) if x is not None], pa.float64())).as_py() for i in (0, 1)]
            top = [pc.max(pa.array([x for x in (b[i] for b in bounds) if x is not None], pa.float64())).as_py() for i in (2, 3)]
            block = geo_block(geometry, crs, None if low[0] is None else [*low, *top], [])
            writer.add_key_value_metadata({"geo": json.dumps(block)})
            writer.close()
            out.close()
            files.move(path, f"{root}/_tile_id={tile}/part-{task:06}-{times[tile]}.parquet")
            times[tile] += 1  # rows in no order may come back to a tile
            done += 1

        for batch in batches:
            ids = batch.column("_tile_id").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1], True]) if len(ids) else []
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                part = batch.slice(i, j - i)
                if ids[i] != tile:
                    close()
                    tile, bounds = ids[i], []
                    kept = part.select([n for n in part.schema.names if n not in drop])
                    path = f"{root}/_temporary/{tile}-{uuid.uuid4().hex}"
                    out = files.create(path)
                    writer = pq.ParquetWriter(out, kept.schema, compression=compression)
                bounds.append([f(part.column(f"_bbox_{n}")).as_py() for f, n in ((pc.min, "xmin"), (pc.min, "ymin"), (pc.max, "xmax"), (pc.max, "ymax"))])
                held.append(part.select([n for n in part.schema.names if n not in drop]))
                size += held[-1].nbytes
                if size >= ROW_GROUP_BYTES:
                    flush()
        close()
        yield pa.record_batch({"n": pa.array([done], pa.int64())})

    n = df.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    files.remove(f"{root}/_temporary")
    return n


def manifest(df: DataFrame, tile: str = "_tile_id", prefix: str = "_bbox_") -> DataFrame:
    """(tile_id, rows, xmin, ymin, xmax, ymax) of every tile."""
    bounds = [f(f"{prefix}{n}").alias(n) for n, f in (("xmin", F.min), ("ymin", F.min), ("xmax", F.max), ("ymax", F.max))]
    return df.groupBy(F.col(tile).alias("tile_id")).agg(F.count("*").alias("rows"), *bounds)


def write_manifest(df: DataFrame, outdir: str) -> None:
    """Exact bounds and rows of every tile, instead of bounds in file names."""
    manifest(df).coalesce(1).write.mode("overwrite").parquet(f"{outdir}/manifest")


def named_box(name: str) -> tuple[float, float, float, float] | None:
    """The bounds in a file name tile_N__minx_miny_maxx_maxy.parquet, whose numbers have _ for
    their point, widened by a unit of their last digit."""
    parts = name.rsplit("/", 1)[-1].removesuffix(".parquet").split("__")
    words = parts[1].split("_") if len(parts) == 2 else []
    if len(words) != 8:
        return None
    try:
        numbers = [(float(f"{a}.{b}"), 10.0 ** -len(b)) for a, b in zip(words[::2], words[1::2], strict=True)]
    except ValueError:
        return None
    return tuple(v - unit if i < 2 else v + unit for i, (v, unit) in enumerate(numbers))


def flat_tiles(outdir: str) -> list[str]:
    """Tile files that lie in one folder under names with their bounds, as other writers leave them."""
    return [f for f, folder in files.listing(f"{outdir}/parquet_tiles") if not folder and f.endswith(".parquet")]


def read_tiles(spark, outdir: str, box: Box | None = None, geometry: str = "geometry") -> DataFrame:
    """Rows of the tiles whose bounds touch the box: tiles by the manifest or their files' names,
    row groups by statistics, rows by their boxes."""
    from ..functions.boxes import intersects
    from ..operators.features import in_box

    flat = flat_tiles(outdir)
    if flat:
        hit = [f for f in flat if box is None or (b := named_box(f)) is None or not (b[2] < box.xmin or b[0] > box.xmax or b[3] < box.ymin or b[1] > box.ymax)]
        df = spark.read.parquet(*(hit or flat[:1]))
        df = df if hit else df.limit(0)
    else:
        df = spark.read.parquet(f"{outdir}/parquet_tiles")
    if box is None:
        return df
    if not flat:
        hit = [r[0] for r in spark.read.parquet(f"{outdir}/manifest").filter(intersects(box, "xmin", "ymin", "xmax", "ymax")).select("tile_id").collect()]  # a number a tile
        df = df.filter(F.col("_tile_id").isin(hit) if hit else F.lit(False))
    return in_box(df, box, geometry)


def write_histogram(cells: DataFrame, outdir: str, zoom: int) -> None:
    """Sparse Parquet for queries, and the dense arrays with their descriptions.

    The arrays' size is the grid's (4096^2 numbers for zoom 12), whatever the input;
    they are filled from at most as many cells."""
    folder = f"{outdir}/histograms"
    cells.write.mode("overwrite").parquet(f"{folder}/cells")
    n = 1 << zoom
    dense = np.zeros((n, n))
    p = cells.sparkSession.read.parquet(f"{folder}/cells").toPandas()
    dense[p["row"], p["col"]] = p["cnt"]
    w = M.HALF_WORLD
    about = {"dtype": "float64", "grid_size": n, "shape": [n, n], "crs": "EPSG:3857", "bbox": [-w, -w, w, w]}
    for name, array, more in (("global", dense, {"sum": float(dense.sum()), "nonzero": int((dense != 0).sum())}), ("global_prefix", dense.cumsum(0).cumsum(1), {"desc": "inclusive two-dimensional prefix sum"})):
        raw = io.BytesIO()
        np.save(raw, array)
        files.write(f"{folder}/{name}.npy", raw.getvalue())
        files.write(f"{folder}/{name}.json", json.dumps({"filename": f"{name}.npy", **about, **more}, indent=2).encode())


def read_histogram(path: str) -> np.ndarray:
    """The prefix-sum array of a .npy file, whichever of the two it holds."""
    array = np.load(io.BytesIO(files.read(path)))
    return array if path.endswith("_prefix.npy") else array.cumsum(0).cumsum(1)


def prefix_value(prefix: np.ndarray, z: int, x: int, y: int) -> float:
    """The histogram's value of a tile: a block's sum, or the parent cell's over scale squared; 0.0 outside."""
    n = prefix.shape[1]
    zoom = round(np.log2(n))
    if not (0 <= x < 1 << z and 0 <= y < 1 << z):
        return 0.0
    if z > zoom:
        s = 1 << (z - zoom)
        return prefix_value(prefix, zoom, x // s, y // s) / (s * s)
    s = n >> z
    padded = lambda r, c: float(prefix[r, c]) if r >= 0 and c >= 0 else 0.0
    r0, c0, r1, c1 = y * s - 1, x * s - 1, (y + 1) * s - 1, (x + 1) * s - 1
    return padded(r1, c1) - padded(r0, c1) - padded(r1, c0) + padded(r0, c0)


def write_features(df: DataFrame, outdir: str, geometry: str = "geometry") -> int:
    """Feature collections, one a task, a feature a line; how many features.

    Each task streams its rows into a file of its own, which is moved into place when it is
    complete, so a task that runs again leaves one file."""
    from ..operators.features import geojson_lines

    def write(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        n, task = 0, TaskContext.get().partitionId()
        path = f"{outdir}/_temporary/{task}-{uuid.uuid4().hex}"
        with files.create(path) as out:
            out.write(b'{"type":"FeatureCollection","features":[')
            for batch in batches:
                if batch.num_rows:
                    out.write(((",\n" if n else "") + ",\n".join(batch.column(0).to_pylist())).encode())
                n += batch.num_rows
            out.write(b"]}")
        files.move(path, f"{outdir}/part-{task}.geojson")
        yield pa.record_batch({"n": pa.array([n], pa.int64())})

    n = geojson_lines(df, geometry).mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    files.remove(f"{outdir}/_temporary")
    return n


def write_mvt(tiles: DataFrame, outdir: str) -> int:
    """mvt/z/x/y.mvt from (z, x, y, data), written by the tasks into the folder or store all share; how many."""

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.select(["z", "x", "y", "data"]).to_pylist():
                files.write(f"{outdir}/mvt/{r['z']}/{r['x']}/{r['y']}.mvt", r["data"])
            yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64())})

    return tiles.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


# --- archives ---------------------------------------------------------------------------

_TILE_TYPES = {"mvt": 1, "png": 2, "jpg": 3, "jpeg": 3, "webp": 4, "avif": 5}
_COMPRESSION = {"none": 1, "gzip": 2, "brotli": 3, "zstd": 4}


def compressor(name: str):
    if name == "none":
        return lambda b: b
    if name == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress
    if name == "brotli":
        try:
            import brotli
        except ImportError:
            raise RuntimeError("the brotli codec is not available") from None
        return brotli.compress
    return lambda b: gzip.compress(b, mtime=0)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    """(tile id, offset, length, run length) columns, each as differences or plain, gzipped."""
    out, last, after = [_varint(len(entries))], 0, 0
    for t, _, _, _ in entries:
        out.append(_varint(t - last))
        last = t
    out += [_varint(e[3]) for e in entries] + [_varint(e[2]) for e in entries]
    for i, (_, offset, length, _) in enumerate(entries):
        out.append(_varint(0 if i and offset == after else offset + 1))
        after = offset + length
    return gzip.compress(b"".join(out), mtime=0)


def write_archive(tiles, path: str, tile_type: str = "mvt", compression: str = "gzip", metadata: dict | None = None) -> int:
    """A PMTiles v3 archive from an iterable of (z, x, y, bytes or what gives them); equal content is stored once.

    Only numbers and digests of the tiles stay in memory: contents go to a file beside the
    archive, one after the other in the archive's order, and from there behind the directory."""
    import hashlib

    pack = compressor(compression)
    tiles = list(tiles)
    rows = sorted((M.archive_id(z, x, y), z, x, y, i) for i, (z, x, y, _) in enumerate(tiles))
    if not rows:
        raise ValueError("no tiles to archive")
    seen: dict[bytes, tuple[int, int]] = {}
    entries, size, body = [], 0, f"{path}.body"
    with files.create(body) as out:
        for t, _, _, _, i in rows:
            data = tiles[i][3]
            data = pack(data() if callable(data) else data)
            key = hashlib.blake2b(data, digest_size=16).digest()
            if key not in seen:
                seen[key] = (size, len(data))
                out.write(data)
                size += len(data)
            offset, length = seen[key]
            if entries and entries[-1][0] + entries[-1][3] == t and entries[-1][1] == offset:
                entries[-1] = (*entries[-1][:3], entries[-1][3] + 1)
            else:
                entries.append((t, offset, length, 1))
    root, leaves = _directory(entries), b""
    step = 4096
    while len(root) > 16384 - 127:
        leaves, pointers = b"", []
        for i in range(0, len(entries), step):
            leaf = _directory(entries[i : i + step])
            pointers.append((entries[i][0], len(leaves), len(leaf), 0))
            leaves += leaf
        root = _directory(pointers)
        step *= 2
    about = gzip.compress(json.dumps(metadata or {"vector_layers": [{"id": M.LAYER, "fields": {}}]}).encode(), mtime=0)
    zooms = [r[1] for r in rows]
    boxes = [M.lonlat_of_tile(*r[1:4]) for r in rows if r[1] == max(zooms)]
    box = [f(b[i] for b in boxes) for i, f in ((0, min), (1, min), (2, max), (3, max))]
    at = 127
    head = b"PMTiles\x03"
    for n in (at, len(root), at + len(root), len(about), at + len(root) + len(about), len(leaves), at + len(root) + len(about) + len(leaves), size, len(rows), len(entries), len(seen)):
        head += struct.pack("<Q", n)
    head += bytes([1, 2, _COMPRESSION.get(compression, 2), _TILE_TYPES.get(tile_type, 1), min(zooms), max(zooms)])
    head += struct.pack("<4i", *(round(v * 1e7) for v in box)) + bytes([min(zooms)])
    head += struct.pack("<2i", round((box[0] + box[2]) / 2 * 1e7), round((box[1] + box[3]) / 2 * 1e7))
    assert len(head) == 127
    with files.create(path) as out:
        out.write(head + root + about + leaves)
        with files.open_input(body) as file:
            while data := file.read(1 << 24):
                out.write(data)
    files.remove(body)
    return len(rows)


def archive_folder(mvt_dir: str, path: str, tile_type: str = "mvt", compression: str = "gzip") -> int:
    """All files z/x/y.* of a folder, read one at a time; others are skipped."""
    if not files.is_dir(mvt_dir):
        raise FileNotFoundError(mvt_dir)
    lead, tiles = len(str(mvt_dir).rstrip("/")) + 1, []
    for f, folder in files.listing(mvt_dir, recursive=True):
        parts = f[lead:].rsplit(".", 1)[0].split("/")
        if not folder and "." in f[lead:].rsplit("/", 1)[-1] and len(parts) == 3 and all(p.isdigit() for p in parts):
            tiles.append((*map(int, parts), lambda f=f: files.read(f)))
    return write_archive(tiles, path, tile_type, compression)
