"""Helpers shared by the operators: scratch tables, Arrow access, hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_U = np.uint64


_LOCAL: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share.  ``spark.checkpoint.dir`` names it; only a
    local session without one (tests on a single machine) gets a temporary folder,
    one folder a process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            if not _LOCAL:
                _LOCAL.append(tempfile.mkdtemp(prefix="tesserae_"))
            root = _LOCAL[0]
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone when the interpreter exits
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.  The copy
    outlives lost executors and cuts the lineage."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(df: DataFrame) -> None:
    """Delete the copy that ``materialize`` made, which nothing needs any more."""
    path = getattr(df, "_scratch", None)
    if path:
        _remove(df.sparkSession, path)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; null ids count as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def crc_text(value: object) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode())


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    n = len(col)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64, n + 1 + col.offset)[col.offset :]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]] if n else data[:0], off - off[0]


def slices(batches, column: int | str = 1, limit: int = 4 << 20, rows: int = 1 << 13):
    """The batches cut into slices of about ``limit`` bytes of a text column and at most
    ``rows`` rows, so that what is made of a slice stays small however many rows a batch holds."""
    for batch in batches:
        _, off = utf8(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = min(i + rows, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
            yield batch.slice(i, j - i)
            i = j


def texts(col: pa.Array) -> Iterator[str]:
    for x in col:
        yield x.as_py() or ""


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (public-domain splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = x.astype(_U) + _U((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_BACK = pow(_STEP, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, off: np.ndarray, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` (A-Z lowered) of the
    texts ``data[off[i]:off[i+1]]`` in order, and each text's word offsets; or of
    the runs of bytes that ``word`` marks.

    A word's hash is the polynomial of its bytes, read off one running sum."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(off), np.int64)
    low = _LOWER[data]
    word = ~_SPACE[data] if word is None else word.copy()
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True  # a text's end ends its word
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        # positions count from the word's 64 KB block, so the power tables stay small
        out = np.empty(len(s), _U)
        block = 1 << 20
        i = 0
        while i < len(s):
            at = s[i]
            j = int(np.searchsorted(s, at + block))
            end = e[j - 1]
            fwd, back = _powers(_STEP, end - at), _powers(_BACK, end - at)
            run = np.zeros(end - at + 1, _U)
            np.cumsum((low[at:end].astype(_U) + _U(1)) * fwd, out=run[1:])
            out[i:j] = (run[e[i:j] - at] - run[s[i:j] - at]) * back[s[i:j] - at]
            i = j
        out ^= (e - s).astype(_U) * _U(0x9FB21C651E98DF25)
    return mix64(out), np.searchsorted(s, off)


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
#: Lead bytes, next bytes and length of characters above ASCII that part words:
#: Latin-1 signs, general punctuation, ideographic punctuation.
_SIGNS = ((0xC2, range(0x80, 0xC0), 2), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3))


def letter_runs(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of the lower-cased runs of letters (all above ASCII but signs)."""
    data, off = utf8(pc.utf8_lower(col))
    word = _LETTER[data]
    for lead, after, n in _SIGNS:
        at = np.flatnonzero(data == lead)
        at = at[at + n <= len(data)]
        at = at[np.isin(data[at + 1], after)]
        for i in range(n):
            word[at + i] = False
    return word_hashes(data, off, word)


def free_name(taken, name: str) -> str:
    """``name``, made longer until no column in ``taken`` has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the distinct ``width``-word shingles of one text, sorted; a
    shorter text is one shingle, an empty one has none."""
    n = len(words)
    if not n:
        return words
    k = min(width, n)
    with np.errstate(over="ignore"):
        h = np.zeros(n - k + 1, _U)
        for i in range(k):
            h = h * _U(0xC2B2AE3D27D4EB4F) + words[i : n - k + 1 + i]
            h = mix64(h, i + 1) if i == k - 1 else h ^ (h >> _U(29))
        h ^= _U(k) if k < width else _U(0)
    return np.unique(h)
