"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

1. Equal vectors are one class; everything else works on classes.
2. Rotations are learnt on a bounded sample of classes (``sample`` rows, the
   smallest hashes): principal axes, then alternate between the codes' signs and
   the rotation that brings the axes closest to them.  Several random starts give
   several codes.  Vectors aren't centred, since that widens the angle of a pair at
   the limit; a common direction makes larger buckets instead.
3. The code is cut into substrings of ``bits`` bits, one hash table each.  The
   number of tables follows from the wanted miss rate of a pair at the limit:
   one bit agrees with probability 1 - angle / pi.  Bits grow with three quarters of
   the logarithm of the classes: buckets of the fourth root of their number keep the
   tables, and so what is shuffled, few.
4. A bucket first compares whole codes (xor and bit counts): a vector goes on only if
   it has a partner within the Hamming radius that it met in no earlier table.
5. There original vectors are compared in double precision.  A bucket of any size is cut
   into blocks of ``BLOCK`` vectors that meet two by two in tasks of their own.  A pair
   that meets in several tables counts in the first one.  Partners are counted
   there; of the links only a spanning forest is passed on to the components.

Nulls: vectors that are null, zero, or hold null or non-finite components link
with nothing, and so do those of another length than the most frequent one.  A
null id is kept, unlinked.  Rows that repeat an id are vectors of their own with
the same id.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import materialize

BLOCK = 4096
#: Rows in one task's call, but for whole pairs of blocks; rows of a tile.
PART, TILE = 20_000, 256
#: Large buckets up to which their list is broadcast; more are joined.
FEW = 1_000_000
_U = np.uint64


def usable(v: Column) -> Column:
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def rotations(x: np.ndarray, starts: int, rounds: int = 30, seed: int = 5) -> list[np.ndarray]:
    """For each random start, a matrix whose columns give the bits."""
    _, axes = np.linalg.eigh(x.T @ x)
    v = x @ axes
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(starts):
        r = np.linalg.qr(rng.standard_normal((x.shape[1],) * 2))[0]
        for _ in range(rounds):
            b = np.sign(v @ r)
            u, _, w = np.linalg.svd(b.T @ v)
            r = (u @ w).T
        out.append(axes @ r)
    return out


def tables_for(similarity: float, bits: int, miss: float) -> int:
    """Tables of so many bits that a pair at the limit meets in one, but for ``miss``."""
    agree = (1 - math.acos(similarity) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def unit(rows) -> np.ndarray:
    x = np.array(rows if isinstance(rows, list) else list(rows), np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def forest(rows: np.ndarray, cols: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the components that the edges (rows, cols) make of ``size`` nodes."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[rows], label[cols])
        new = label.copy()
        np.minimum.at(new, rows, low)
        np.minimum.at(new, cols, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(size))
    return node, label[node]


class Layout:
    """How the substrings of ``tables`` tables lie in words of 64 bits."""

    def __init__(self, bits: int, tables: int):
        self.bits, self.tables = bits, tables
        self.per = 64 // bits
        self.words = -(-tables // self.per)
        fields = np.arange(self.per, dtype=_U) * _U(bits)
        self.low = np.bitwise_or.reduce(_U(1) << fields)
        self.high = self.low << _U(bits - 1)

    def pack(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and keys (rows x tables) of rows of tables * bits truth values."""
        place = _U(1) << np.arange(self.bits, dtype=_U)
        keys = (b[:, : self.tables * self.bits].reshape(len(b), self.tables, self.bits) * place).sum(2, dtype=_U)
        words = np.zeros((len(b), self.words), _U)
        for t in range(self.tables):
            words[:, t // self.per] |= keys[:, t] << _U(t % self.per * self.bits)
        return words, keys.astype(np.int64)

    def first_met(self, a: np.ndarray, b: np.ndarray, table: int, radius: int) -> np.ndarray:
        """Which of all pairs of two lists of words are within the radius and agree in
        none of the tables before this one."""
        near = np.zeros((len(a), len(b)), np.uint16)
        before = np.zeros((len(a), len(b)), bool)
        for w in range(self.words):
            x = a[:, w, None] ^ b[None, :, w]
            near += np.bitwise_count(x)
            fields = min(self.per, table - w * self.per)
            if fields > 0:
                if fields * self.bits < 64:
                    x |= ~((_U(1) << _U(fields * self.bits)) - _U(1))
                # a field of zeros borrows into its highest bit
                before |= ((x - self.low) & ~x & self.high) != 0
        return (near <= radius) & ~before


def similar_vectors(
    embeddings: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    similarity: float = 0.95,
    miss: float = 1e-5,
    sample: int = 20_000,
) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).withColumn("ok", usable(F.col("v")) & F.col("id").isNotNull())
    sizes = rows.filter("ok").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = sizes[0] if sizes else 0
    # minus zero equals zero
    rows = rows.withColumn("v", F.when(F.col("ok") & (F.size("v") == dim), F.transform("v", lambda x: x + F.lit(0.0)))).drop("ok")
    rows = rows.withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("v")).otherwise(F.xxhash64("id")))
    # an id may stand for several vectors, so classes get numbers of their own
    classes = materialize(rows.filter("v is not null").groupBy("h", "v").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("c", F.monotonically_increasing_id()), "itq_classes")
    count = classes.count()
    if not count:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))

    bits = int(min(dim, 30, max(6, round(0.75 * math.log2(max(2, count)) - 3.7))))
    lay = Layout(bits, tables_for(similarity, bits, miss))
    learnt = unit([r[0] for r in classes.orderBy("h").select("v").limit(sample).collect()])
    starts = -(-lay.tables * bits // dim)
    model = spark.sparkContext.broadcast(np.concatenate(rotations(learnt, starts), 1))

    def code(batches):
        for batch in batches:
            if batch.num_rows:
                words, keys = lay.pack(unit(batch.column(1).to_pylist()) @ model.value > 0)
                buckets = keys + (np.arange(lay.tables, dtype=np.int64) << bits)
                yield pa.record_batch([batch.column(0), pa.array(list(buckets), pa.list_(pa.int64())), pa.array([x.tobytes() for x in words], pa.binary())], names=["c", "buckets", "code"])

    coded = materialize(classes.select("c", "v").mapInArrow(code, "c long, buckets array<bigint>, code binary"), "itq_codes")
    # the expected distance at the limit and six deviations
    flips = math.acos(similarity) / math.pi
    width = lay.tables * bits
    radius = min(width, math.ceil(width * flips + 6 * math.sqrt(width * flips * (1 - flips))))
    placed = coded.select("c", "code", F.explode("buckets").alias("bucket"))
    met = in_blocks(placed, count * lay.tables)
    some = materialize(met.groupBy("part").applyInPandas(_met(lay, radius), "c long, bucket long").distinct(), "itq_some")

    placed = some.join(coded.select("c", "code"), "c").join(classes.select("c", F.col("n").alias("copies"), "v"), "c")
    found = materialize(in_blocks(placed, some.count()).groupBy("part").applyInPandas(_rerank(lay, radius, similarity), "a long, b long, links long"), "itq_found")

    links = found.filter("links > 0").groupBy(F.col("a").alias("c")).agg(F.sum("links").alias("links"))
    component = components(found.filter("links = 0").select("a", "b"))
    done = classes.select("c", "h", "v", "id", "n").join(links, "c", "left").join(component, F.col("c") == F.col("node"), "left")
    done = done.withColumn("component", F.coalesce("component", "c"))
    named = done.groupBy("component").agg(F.min("id").alias("component_id"))
    done = done.join(named, "component").select("h", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    return (
        rows.join(done, ["h", "v"], "left")
        .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )


def in_blocks(placed: DataFrame, rows: int) -> DataFrame:
    """Each row once for every pair of blocks (i <= j) of its bucket that holds its
    own block; ``part`` puts whole pairs of blocks together, PART rows or so."""
    large = materialize(placed.groupBy("bucket").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK), "itq_large")
    x = placed.join(F.broadcast(large) if large.count() <= FEW else large, "bucket", "left")
    x = x.withColumn("blocks", F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int")).drop("size")
    x = x.withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other")
    return x.withColumn("part", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(max(1, -(-rows // PART)))).cast("int"))


def _groups(p: pd.DataFrame, lay: Layout):
    """The rows of each pair of blocks: table, codes, row numbers of either block (equal for one with itself)."""
    p = p.sort_values(["bucket", "i", "j", "own", "c"], kind="stable", ignore_index=True)
    at = p[["bucket", "i", "j"]].to_numpy()
    cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(1)])
    code = np.frombuffer(b"".join(p["code"]), _U).reshape(len(p), lay.words)
    own = p["own"].to_numpy()

    def each():
        for a, b in zip(cut, np.r_[cut[1:], len(p)], strict=True):
            bucket, i, j = at[a]
            here = np.arange(a, b)
            yield int(bucket) >> lay.bits, here[own[a:b] == i], here[own[a:b] == j]

    return p, code, each()


def _met(lay: Layout, radius: int):
    """The vectors with a partner within the radius that they meet here first."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p, code, groups = _groups(p, lay)
        hit = np.zeros(len(p), bool)
        for t, a, b in groups:
            same = a[0] == b[0] if len(a) and len(b) else True
            for x, y in ((a, b),) if same else ((a, b), (b, a)):
                s = 0
                while s < len(x):  # rows already hit need no turn of their own
                    tile = x[s : s + 4 * TILE]
                    s += 4 * TILE
                    tile = tile[~hit[tile]]
                    for r in range(0, len(tile), TILE):
                        part = tile[r : r + TILE]
                        m = lay.first_met(code[part], code[y], t, radius) & (part[:, None] != y)
                        hit[part[m.any(1)]] = True
                        hit[y[m.any(0)]] = True
        return p.loc[hit, ["c", "bucket"]].drop_duplicates()

    return run


def _rerank(lay: Layout, radius: int, similarity: float):
    """Rows (a, b, 0): links of a spanning forest; (a, -1, n): a has n partners here that count in this table."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p, code, groups = _groups(p, lay)
        ids, copies = p["c"].to_numpy(), p["copies"].to_numpy().astype(float)
        v = unit(p["v"].tolist())
        total = np.zeros(len(p))
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        for t, a, b in groups:
            same = a[0] == b[0] if len(a) and len(b) else True
            for r in range(0, len(a), TILE):
                part = a[r : r + TILE]
                m = lay.first_met(code[part], code[b], t, radius) & (v[part] @ v[b].T >= similarity) & (part[:, None] != b)
                if not m.any():
                    continue
                total[part] += m @ copies[b]
                if not same:
                    total[b] += copies[part] @ m
                u, w = np.nonzero(m)
                node, root = forest(u, len(part) + w, len(part) + len(b))
                both = np.r_[part, b]
                edges.append((both[node], both[root]))
        # a row stands here once for each pair of blocks
        u, w = (np.concatenate([e[k] for e in edges] or [np.zeros(0, np.int64)]) for k in (0, 1))
        name, at = np.unique(ids, return_inverse=True)
        node, root = forest(at[u], at[w], len(name))
        some = np.flatnonzero(total)
        return pd.DataFrame({"a": np.r_[name[node], ids[some]], "b": np.r_[name[root], np.full(len(some), -1)], "links": np.r_[np.zeros(len(node), np.int64), total[some].astype(np.int64)]})

    return run
