"""The public functions: tile, generate_mvt, build, export_pmtiles, and the dataset handle."""

from __future__ import annotations

import io
import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import mercator as M
from ..functions import wkb
from ..functions.boxes import Box, parse_size
from ..operators import density, partition, profile, tiles
from ..session import get_or_create
from ..sources import files, readers, sinks

GEOJSON_BYTES, PARQUET_BYTES = 512 << 20, 128 << 20
GRID_ZOOM = 12


@dataclass(frozen=True)
class TileResult:
    outdir: str
    num_files: int
    total_rows: int
    bbox: tuple[float, float, float, float] | None
    histogram_path: str | None


@dataclass(frozen=True)
class MVTResult:
    outdir: str
    zoom_levels: list[int]
    tile_count: int


class Dataset:
    """What a dataset folder holds."""

    def __init__(self, path: str) -> None:
        if not files.is_dir(path):
            raise FileNotFoundError(path)
        self.path = str(path).rstrip("/")

    @property
    def num_tiles(self) -> int:
        return sum(f.rsplit("/", 1)[-1].startswith("_tile_id=") if folder else f.endswith(".parquet") for f, folder in files.listing(f"{self.path}/parquet_tiles"))

    @property
    def bbox(self) -> tuple[float, float, float, float] | None:
        import pyarrow.parquet as pq

        if files.is_dir(f"{self.path}/manifest"):
            store, inner = files.at(f"{self.path}/manifest")
            t = pq.read_table(inner, filesystem=store).to_pandas().dropna()
            boxes = t[["xmin", "ymin", "xmax", "ymax"]].to_numpy()
        else:
            boxes = np.array([b for b in map(sinks.named_box, sinks.flat_tiles(self.path)) if b]).reshape(-1, 4)
        return (*boxes[:, :2].min(0).tolist(), *boxes[:, 2:].max(0).tolist()) if len(boxes) else None

    @property
    def zoom_levels(self) -> list[int]:
        return sorted(int(n) for f, _ in files.listing(f"{self.path}/mvt") if (n := f.rsplit("/", 1)[-1]).isdigit())

    @property
    def has_histograms(self) -> bool:
        return files.is_file(f"{self.path}/histograms/global.npy")

    @property
    def has_mvt(self) -> bool:
        return bool(self.zoom_levels)

    @property
    def has_stats(self) -> bool:
        return files.is_file(f"{self.path}/stats/attributes.json")

    def stats(self) -> dict:
        return json.loads(files.read(f"{self.path}/stats/attributes.json"))


def located(features: DataFrame, geometry: str, first_vertex: bool = False) -> DataFrame:
    """With centroid, covering box and the point that samples take (_sx, _sy: the centroid or
    the first vertex); rows without geometry have nulls and stay."""
    names = ["_cx", "_cy", "_sx", "_sy", *(f"_bbox_{n}" for n in ("xmin", "ymin", "xmax", "ymax"))]

    def run(batches):
        import pyarrow as pa

        for batch in batches:  # every geometry is parsed once
            b = wkb.Batch(batch.column(geometry).to_pandas())
            centre = b.centroids()
            found = [*centre.T, *(b.first_vertices() if first_vertex else centre).T, *b.bounds().T]
            yield pa.record_batch([*batch.columns, *(pa.array(v, mask=np.isnan(v)) for v in found)], names=[*batch.schema.names, *names])

    return features.mapInArrow(run, T.StructType([*features.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)]))


SORTS = {"zorder": "zorder", "z": "zorder", "z-order": "zorder", "hilbert": "hilbert", "columns": "columns", "none": "none"}


def tile(
    input: str,
    outdir: str,
    *,
    partition_size: int | str | None = None,
    sort: str = "zorder",
    sort_keys: list | None = None,
    compression: str = "zstd",
    sample_cap: int | None = 10_000,
    sample_ratio: float = 1.0,
    seed: int = 42,
    geom_col: str = "geometry",
    sfc_bits: int = 16,
    covering_bbox: bool = False,
    orchestrator: str = "two-stage",
    histogram_zoom: int = GRID_ZOOM,
    spark: SparkSession | None = None,
    max_parallel_files: int = 64,
    geojson_executor: str = "process",
    two_stage_executor: str = "process",
    two_stage_assignment_workers: int | None = None,
    two_stage_write_workers: int | None = None,
    two_stage_reducers: int | None = None,
    temp_dir: str | None = None,
) -> TileResult:
    """Partition a dataset spatially: sample, tree, one shuffle, write; then manifest, statistics, histogram.

    The input is parsed once, into a staging table below ``outdir`` with boxes and centroids.
    The sample holds ``sample_cap`` points (None: a thousand times the partitions), or 32 for
    each partition if that is more, so that every leaf has points.  The last seven
    options, for pools of workers, are accepted and have no use here."""
    if orchestrator.strip().lower().replace("_", "-") not in ("two-stage", "twostage", "round"):
        raise ValueError("orchestrator must be 'round' or 'two-stage'")
    if not 0 <= sfc_bits <= 31:
        raise ValueError(f"sfc_bits {sfc_bits} is not in 0..31")
    sort = SORTS.get(sort.strip().lower(), "zorder")
    spark = spark or get_or_create()
    kind = readers.kind_of(input)
    size = parse_size(partition_size) if isinstance(partition_size, str) else partition_size if partition_size is not None else (GEOJSON_BYTES if kind == "geojson" else PARQUET_BYTES)
    parts = readers.partition_count(readers.input_bytes(input), size)

    staging = f"{outdir}/_staging"
    located(readers.read_dataset(spark, input, geom_col), geom_col, kind == "geojson").write.mode("overwrite").parquet(staging)
    rows = spark.read.parquet(staging)
    points = rows.filter(F.col("_cx").isNotNull()).select(F.hash(geom_col).alias("id"), F.col("_sx").alias("x"), F.col("_sy").alias("y"))
    got = rows.agg(F.min("_bbox_xmin"), F.min("_bbox_ymin"), F.max("_bbox_xmax"), F.max("_bbox_ymax")).first()
    extent = Box(*got) if got[0] is not None else Box(-180, -90, 180, 90)
    cap = max(1000 * parts if sample_cap is None else sample_cap, 32 * parts)
    sample = partition.sample_points(points, cap=cap, ratio=sample_ratio, seed=seed)
    tree = partition.build_tree(sample.select("x", "y").toPandas().to_numpy(), parts, around=extent, seed=seed)

    placed = partition.assign(rows, tree, x="_cx", y="_cy", into="_tile_id").drop("_sx", "_sy")
    # rows without a place are dealt to all partitions
    placed = placed.withColumn("_tile_id", F.when(F.col("_cx").isNull(), F.pmod(F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in placed.columns]))), F.lit(tree.partitions)).cast("int")).otherwise(F.col("_tile_id")))
    out = sinks.clustered(placed, extent, sort, sfc_bits, sort_keys, geom_col)
    sinks.write_tiles(out, outdir, compression, geom_col, readers.crs_hint(input) if kind == "geojson" else None, covering_bbox)
    sinks.write_manifest(placed, outdir)
    attributes = rows.drop("_cx", "_cy", "_sx", "_sy", *[c for c in rows.columns if c.startswith("_bbox")])
    profile.write_profile(profile.profile(attributes, geom_col), f"{outdir}/stats/attributes.json")
    sinks.write_histogram(density.histogram(density.vertices(rows, geom_col), histogram_zoom), outdir, histogram_zoom)
    total = spark.read.parquet(f"{outdir}/manifest").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    files.remove(staging)
    return TileResult(outdir, Dataset(outdir).num_tiles, total, None if got[0] is None else tuple(got), f"{outdir}/histograms/global_prefix.npy")


def density_of(spark: SparkSession, tile_dir: str) -> tuple[DataFrame, int]:
    """Cells and zoom of a dataset's histogram; of the dense array, where it has no table of cells."""
    if files.is_dir(f"{tile_dir}/histograms/cells"):
        grid = int(json.loads(files.read(f"{tile_dir}/histograms/global.json"))["grid_size"]).bit_length() - 1
        return spark.read.parquet(f"{tile_dir}/histograms/cells"), grid
    dense = np.load(io.BytesIO(files.read(f"{tile_dir}/histograms/global.npy")))
    row, col = np.nonzero(dense)
    cells = pd.DataFrame({"row": row.astype(np.int32), "col": col.astype(np.int32), "cnt": dense[row, col].astype(np.int64)})
    return spark.createDataFrame(cells, "row int, col int, cnt long"), int(dense.shape[0]).bit_length() - 1


def generate_mvt(
    tile_dir: str,
    *,
    zoom: int = 7,
    threshold: float = 0,
    outdir: str | None = None,
    auto_zoom: bool = True,
    occupancy_threshold: float = 0.01,
    geom_col: str = "geometry",
    spark: SparkSession | None = None,
) -> MVTResult:
    """Vector tiles of zooms 0 to ``zoom``; ``threshold`` counts vertices of the histogram."""
    M.check_zoom(zoom)
    spark = spark or get_or_create()
    cells, grid = density_of(spark, tile_dir)
    top = density.auto_zoom(cells, grid, threshold, zoom, occupancy_threshold) if auto_zoom and zoom >= grid else zoom
    # with no threshold every tile counts, so there is nothing to join with
    nonempty = density.nonempty_tiles(cells, grid, threshold, top) if threshold > 0 else None
    features = sinks.read_tiles(spark, tile_dir)
    built = tiles.build_tiles(features, top, geometry=geom_col, nonempty=nonempty)
    outdir = outdir or tile_dir
    n = sinks.write_mvt(built, outdir)
    return MVTResult(outdir, Dataset(outdir).zoom_levels, n)


def export_pmtiles(mvt_dir: str, output_path: str, tile_type: str = "mvt", compression: str = "gzip") -> int:
    return sinks.archive_folder(mvt_dir, output_path, tile_type, compression)


def build(input: str, outdir: str, *, zoom: int = 7, partition_size: int | str | None = None, threshold: float = 100_000, pmtiles: bool = False, pmtiles_compression: str = "gzip", spark: SparkSession | None = None, **tile_options) -> tuple[TileResult, MVTResult, str | None]:
    spark = spark or get_or_create()
    first = tile(input, outdir, partition_size=partition_size, spark=spark, **tile_options)
    second = generate_mvt(outdir, zoom=zoom, threshold=threshold, geom_col=tile_options.get("geom_col", "geometry"), spark=spark)
    path = None
    if pmtiles:
        path = f"{outdir.rstrip('/')}.pmtiles"
        export_pmtiles(f"{outdir}/mvt", path, compression=pmtiles_compression)
    return first, second, path


# --- catalog ----------------------------------------------------------------------------


def dataset_dirs(root: str) -> list[str]:
    names = (f.rsplit("/", 1)[-1] for f, folder in files.listing(root) if folder)
    return sorted(n for n in names if not n.startswith((".", "_")))


def build_catalog(root: str, spark: SparkSession | None = None, embedder=None) -> DataFrame:
    """Descriptors and embeddings of all datasets with statistics: as Parquet in root/_catalog, and
    as root/_catalog.json (version 2) with the vectors in root/_catalog.npy."""
    from ..operators import search

    spark = spark or get_or_create()
    embedder = embedder or search.HashingEmbedder()
    rows = []
    for name in dataset_dirs(root):
        ds = Dataset(f"{root}/{name}")
        if ds.has_stats:
            d = search.describe(name, ds.stats())
            rows.append((name, f"{ds.path}/stats/attributes.json", d["text"], json.dumps(d["summary"]), embedder.embed(d["text"])))
    df = spark.createDataFrame(rows, "dataset string, stats_path string, descriptor string, summary string, embedding array<float>")
    df.write.mode("overwrite").parquet(f"{root}/_catalog")
    raw = io.BytesIO()
    np.save(raw, np.array([r[4] for r in rows], np.float32).reshape(len(rows), -1))
    files.write(f"{root}/_catalog.npy", raw.getvalue())
    about = {"version": 2, "count": len(rows), "items": [{"dataset": r[0], "stats_path": r[1], "descriptor": r[2], "summary": json.loads(r[3])} for r in rows]}
    files.write(f"{root}/_catalog.json", json.dumps(about, indent=2).encode())
    return spark.read.parquet(f"{root}/_catalog")


def search_catalog(root: str, text: str, k: int = 5, spark: SparkSession | None = None, embedder=None, backend: str = "auto", jdbc: dict | None = None) -> DataFrame:
    """The k nearest datasets.  ``backend``: "npy" (the files of ``build_catalog``), "jdbc" (a table with
    the catalog's columns, the embedding as JSON text; ``jdbc`` has the reader's options) or "auto"."""
    from ..operators import search

    spark = spark or get_or_create()
    table = search.catalog(spark, root, backend, jdbc)
    q = (embedder or search.HashingEmbedder()).embed_query(text)
    return search.nearest(table, q, k, key="dataset").select("dataset", "score", "descriptor")
