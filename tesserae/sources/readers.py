"""Reading datasets: choosing the source, Parquet scans, splits, GeoJSON.

GeoJSON files are cut into byte ranges; a feature belongs to the range its first
byte is in, so every feature is read once.  ``geojson`` registers the same reader
as a Spark data source: ``spark.read.format("geojson").load(path)``.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import wkb
from . import files

GEOJSON_SUFFIXES = (".geojson", ".geojsonl", ".json", ".jsonl")
PARQUET_SUFFIXES = (".parquet", ".geoparquet")
SPLIT_BYTES = 32 << 20
#: Least bytes a task reads if there are so many: its start costs as much as a few thousand features.
TASK_BYTES = 1 << 20


def list_files(path: str) -> list[str]:
    """Data files below a path; hidden files and folders are skipped."""
    if files.is_file(path):
        return [path]
    if not files.is_dir(path):
        raise FileNotFoundError(path)
    lead = len(str(path).rstrip("/")) + 1

    def shown(name: str) -> bool:
        *folders, last = name[lead:].split("/")
        return not last.startswith((".", "_")) and not any(d.startswith((".", "_")) and "=" not in d for d in folders)

    return [f for f, folder in files.listing(path, recursive=True) if not folder and shown(f) and f.lower().endswith(GEOJSON_SUFFIXES + PARQUET_SUFFIXES)]


def kind_of(path: str) -> str:
    """"geojson" or "parquet"; a folder must hold files of one kind only."""
    if files.is_file(path):
        return "geojson" if path.lower().endswith(GEOJSON_SUFFIXES) else "parquet"
    kinds = {"geojson" if f.lower().endswith(GEOJSON_SUFFIXES) else "parquet" for f in list_files(path)}
    if len(kinds) != 1:
        raise ValueError(f"{path} holds {'both GeoJSON and Parquet' if kinds else 'no data'} files")
    return kinds.pop()


def input_bytes(path: str) -> int:
    return sum(files.size(f) for f in list_files(path))


def partition_count(size: int, partition_bytes: int) -> int:
    if partition_bytes <= 0:
        raise ValueError("a partition's size must be positive")
    return max(1, math.ceil(size / partition_bytes))


def read_dataset(spark: SparkSession, path: str, geometry: str = "geometry") -> DataFrame:
    return read_geojson(spark, path) if kind_of(path) == "geojson" else read_parquet(spark, path, geometry)


def read_parquet(spark: SparkSession, path: str, geometry: str = "geometry", geometry_only: bool = False) -> DataFrame:
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{parquet,geoparquet}").parquet(path)
    if geometry not in df.columns:
        raise ValueError(f"no column {geometry!r}")
    return df.select(geometry) if geometry_only else df


def row_group_splits(path: str, splits: int | None = None) -> list[tuple[str, list[int]]]:
    """(file, row groups): one for each row group, or about ``splits`` of them; none spans files."""
    import pyarrow.parquet as pq

    groups = []
    for f in list_files(path):
        with files.open_input(f) as file:
            groups.append((f, pq.ParquetFile(file).num_row_groups))
    size = 1 if splits is None else math.ceil(sum(n for _, n in groups) / max(1, splits))
    return [(f, list(range(i, min(n, i + size)))) for f, n in groups for i in range(0, n, max(1, size))]


def byte_ranges(size: int, splits: int) -> list[tuple[int, int]]:
    """Contiguous (offset, length) of rounded-up equal length."""
    if not size:
        return []
    step = math.ceil(size / max(1, splits))
    return [(i, min(step, size - i)) for i in range(0, size, step)]


# --- features of a byte range -----------------------------------------------------------

_IS_FEATURE = re.compile(r'"type"\s*:\s*"Feature"')
_DECODER = json.JSONDecoder()
_CHUNK = 1 << 20
#: Read first beyond a range's end while its last feature goes on; then twice as much each time.
_AHEAD = 1 << 14


def features_in(path: str, offset: int, length: int) -> Iterator[bytes]:
    """The JSON texts of the features that begin in a range.

    A feature is an object whose own "type" is "Feature" and which is no member's
    value.  Every find of that pair is decoded from the nearest brace before it
    that makes such an object, so the pair inside a text (its quotes are escaped
    there) or in a nested value is never taken for a feature."""
    with files.open_input(path) as file:
        back = 1 if offset else 0
        file.seek(offset - back)
        text = file.read(length + back).decode("latin-1")  # one character per byte
        at, stop, ahead = back, length + back, _AHEAD

        def beyond() -> str:
            nonlocal ahead
            ahead *= 2
            return file.read(ahead // 2).decode("latin-1")

        while True:
            m = _IS_FEATURE.search(text, at)
            if not m or len(text) - m.end() < 64:
                more = beyond()
                if more:
                    # what begins behind the range is another's; an unfinished object may still begin before
                    if not m and text.rfind("{", 0, stop) < at:
                        return
                    text += more
                    continue
                if not m:
                    return
            begin, end = _object_around(text, m.start(), at)
            while end is None and (more := beyond()):
                text += more
                begin, end = _object_around(text, m.start(), at)
            if end is None:
                at = m.end()
                continue
            if begin >= stop:
                return
            before = begin - 1
            while before >= 0 and text[before].isspace():
                before -= 1
            if before < 0 or text[before] != ":":
                yield text[begin:end].encode("latin-1")
            at = end


def _object_around(text: str, pair: int, low: int):
    """Bounds of the feature that the pair at ``pair`` belongs to; (None, None) if there is none."""
    brace = pair
    while True:
        brace = text.rfind("{", low, brace)
        if brace < 0:
            return None, None
        try:
            value, end = _DECODER.raw_decode(text, brace)
        except ValueError:
            continue
        if end > pair and isinstance(value, dict) and value.get("type") == "Feature":
            return brace, end


# --- rows -------------------------------------------------------------------------------


def normalise(value):
    """Decimals as floats; objects and lists as compact JSON with sorted keys."""
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (dict, list)):
        return json.dumps(value, separators=(",", ":"), sort_keys=True, default=str)
    return value


def _type_of(seen: set[str]) -> T.DataType:
    if seen == {"bool"}:
        return T.BooleanType()
    if seen == {"int"}:
        return T.LongType()
    return T.DoubleType() if seen and seen <= {"int", "float"} else T.StringType()


def _properties_of(path: str, offset: int, length: int, most: int | None = None) -> dict[str, tuple[int, set[str]]]:
    """Name -> where it came first, and the types of its values, in a range's features."""
    found: dict[str, tuple[int, set[str]]] = {}
    for n, raw in enumerate(features_in(path, offset, length)):
        if n == most:
            break
        for k, v in (json.loads(raw).get("properties") or {}).items():
            _, seen = found.setdefault(k, (len(found), set()))
            if v is not None:
                seen.add(type(normalise(v)).__name__)
    return found


def infer_schema(path: str, most: int | None = None, spark: SparkSession | None = None) -> T.StructType:
    """Of all features, read in parallel if there is a session; or of the first ``most`` of
    the first file that has any.  Columns stand in the order in which they come first."""
    ranges = [(i, f, o, n) for i, f in enumerate(list_files(path)) for o, n in byte_ranges(files.size(f), math.ceil(files.size(f) / SPLIT_BYTES))]
    columns: dict[str, tuple[tuple, set[str]]] = {}

    def add(name: str, place: tuple, seen: set[str]) -> None:
        old, types = columns.get(name, (place, set()))
        columns[name] = (min(old, place), types | seen)

    if most is not None or spark is None:
        for f in list_files(path):
            for name, (n, seen) in _properties_of(f, 0, files.size(f), most).items():
                add(name, (f, 0, n), seen)
            if most is not None and columns:
                break
    else:
        def scan(batches):
            import pyarrow as pa

            for batch in batches:
                for i, f, o, n in batch.to_pandas().itertuples(index=False):
                    found = _properties_of(f, o, n)
                    yield pa.record_batch({"name": pa.array(list(found), pa.string()), "file": pa.array([i] * len(found), pa.int64()), "at": pa.array([o] * len(found), pa.int64()), "no": pa.array([k for k, _ in found.values()], pa.int64()), "types": pa.array([sorted(t) for _, t in found.values()], pa.list_(pa.string()))})

        table = spark.createDataFrame(ranges, "file long, path string, at long, length long").repartition(max(1, len(ranges)))
        got = table.mapInArrow(scan, "name string, file long, at long, no long, types array<string>").groupBy("name").agg(F.min(F.struct("file", "at", "no")).alias("place"), F.array_distinct(F.flatten(F.collect_list("types"))).alias("types"))
        for r in got.collect():  # a row a column
            add(r["name"], tuple(r["place"]), set(r["types"]))
    names = sorted((k for k in columns if k != "geometry"), key=lambda k: columns[k][0])
    return T.StructType([T.StructField("geometry", T.BinaryType()), *(T.StructField(k, _type_of(columns[k][1])) for k in names)])


def _fit(value, kind: T.DataType):
    value = normalise(value)
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value)
    try:
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else None
        return int(value) if isinstance(kind, T.LongType) else float(value)
    except (TypeError, ValueError):
        return None


def row_of(raw: bytes, schema: T.StructType) -> tuple:
    feature = json.loads(raw)
    try:
        g = wkb.from_geojson(feature.get("geometry"))
    except (TypeError, ValueError, IndexError, KeyError):
        g = None
    props = feature.get("properties") or {}
    return tuple((wkb.dumps(g) if g is not None else None) if f.name == "geometry" else _fit(props.get(f.name), f.dataType) for f in schema.fields)


class _Ranges(InputPartition):
    """Byte ranges (path, offset, length) that one task reads, one after the other."""

    def __init__(self, ranges: list[tuple[str, int, int]]) -> None:
        self.ranges = ranges


def packed(ranges: list[tuple[str, int, int]], task_bytes: int) -> list[list[tuple[str, int, int]]]:
    """Ranges in order, as many together as ``task_bytes`` hold, one at least."""
    out, size = [], 0
    for r in ranges:
        if not out or size + r[2] > task_bytes:
            out.append([])
            size = 0
        out[-1].append(r)
        size += r[2]
    return out


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options) -> None:
        self.schema, self.options = schema, options

    def partitions(self):
        size = int(self.options.get("splitBytes", SPLIT_BYTES))
        ranges = [(f, o, n) for f in list_files(self.options["path"]) for b in [files.size(f)] for o, n in byte_ranges(b, math.ceil(b / size))]
        return [_Ranges(r) for r in packed(ranges, int(self.options.get("taskBytes", size)))] or [_Ranges([])]

    def read(self, part: _Ranges):
        for path, offset, length in part.ranges:
            for raw in features_in(path, offset, length):
                yield row_of(raw, self.schema)


class GeoJSONSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geojson"

    def schema(self) -> T.StructType:
        return infer_schema(self.options["path"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def read_geojson(spark: SparkSession, path: str, schema: T.StructType | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    if not files.exists(path):
        raise FileNotFoundError(path)
    spark.dataSource.register(GeoJSONSource)
    # small ranges share a task, as many as leave every core one
    task_bytes = min(SPLIT_BYTES, max(split_bytes, TASK_BYTES, math.ceil(input_bytes(path) / spark.sparkContext.defaultParallelism)))
    return spark.read.format("geojson").schema(schema or infer_schema(path, spark=spark)).option("splitBytes", split_bytes).option("taskBytes", task_bytes).load(path)


def crs_hint(path: str) -> str | None:
    """crs.properties.name of a collection's header."""
    with files.open_input(list_files(path)[0]) as f:
        head = f.read(_CHUNK).split(b'"features"')[0].decode(errors="ignore")
    m = re.search(r'"crs"\s*:\s*\{.*?"name"\s*:\s*"([^"]+)"', head, re.DOTALL)
    return m.group(1) if m else None


def read_partition_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(id, minx, miny, maxx, maxy, pos) of a CSV file; other columns are an error to lack."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    lack = {"id", "minx", "miny", "maxx", "maxy"} - set(df.columns)
    if lack:
        raise ValueError(f"{path} lacks {sorted(lack)}")
    return df.select("id", *[F.col(c).cast("double").alias(c) for c in ("minx", "miny", "maxx", "maxy")]).withColumn("pos", F.monotonically_increasing_id())
