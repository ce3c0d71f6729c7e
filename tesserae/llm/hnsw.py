"""Approximate nearest neighbours: one hierarchical small-world graph per shard.

Rows are dealt by hash to shards of about ``shard_size`` distinct vectors (by default
16 times the root of the rows' number, between 4,096 and 131,072), so building grows in
proportion to the rows.  A shard's graph has levels with geometrically fewer nodes.
Levels are built from the top down, each by insertion: a batch of nodes descends
the levels above, runs a beam search among the nodes already inserted, and takes its neighbours
from what it finds and from its own batch, by the usual rule that a neighbour must be
nearer to the node than to any neighbour already chosen; links are made both ways, and
a node with too many keeps those that the rule chooses.  Nodes of upper levels come first, the
first batch meets itself.  The graph is stored as flat arrays: a level's nodes, and a row
of neighbours for each of them.

A shard's index is read once; the queries stream past it, each descending the levels
and running a beam search on the lowest, many in step.  A shard returns its best ``k`` by
exact distance; the shards' results are merged.  Vectors equal in a shard are
one node that holds their smallest ids, as many as can be returned.

Nulls: vectors that are null, zero, or hold null or non-finite components take
no part, neither do null ids or vectors of another length than the most frequent
one.  Rows that repeat an id are rows of their own, as queries and as candidates:
only the query's own row isn't returned.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .itq import usable
from .shared import materialize

_NONE = -1
#: Nodes inserted, or queries answered, in step.
STEP = 256


def _gap(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = x[a] - x[b]
    return np.einsum("...i,...i->...", d, d)


def choose(x: np.ndarray, node: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """The rule above for many nodes at once; candidates are sorted by distance, -1 for none."""
    n, m = candidates.shape
    far = np.where(candidates >= 0, _gap(x, node[:, None], np.maximum(candidates, 0)), np.inf)
    kept = np.full((n, degree), _NONE, np.int64)
    used = np.zeros(n, np.int64)
    taken = np.zeros((n, m), bool)
    for i in range(m):
        c = candidates[:, i]
        ok = (c >= 0) & (used < degree)
        d = np.where(kept >= 0, _gap(x, np.maximum(c, 0)[:, None], np.maximum(kept, 0)), np.inf)
        ok &= d.min(1) >= far[:, i]
        at = np.flatnonzero(ok)
        kept[at, used[at]] = c[at]
        used[at] += 1
        taken[at, i] = True
    for i in range(m):  # the nearest of the others fill what room is left
        ok = np.flatnonzero((candidates[:, i] >= 0) & ~taken[:, i] & (used < degree // 2))
        kept[ok, used[ok]] = candidates[ok, i]
        used[ok] += 1
    return kept


def beam(x: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ef rows nearest to it that a beam search finds (-1 for none), and their
    squared distances, nearest first.  ``start``: a row for each query."""
    q = len(queries)
    seen = np.zeros((q, len(x)), bool)
    seen[np.arange(q), start] = True
    ids = np.full((q, ef), _NONE, np.int64)
    dist = np.full((q, ef), np.inf)
    done = np.zeros((q, ef), bool)
    ids[:, 0], dist[:, 0] = start, ((x[start] - queries) ** 2).sum(1)
    rows = np.arange(q)
    while len(rows):
        open_ = np.where(done[rows] | (ids[rows] < 0), np.inf, dist[rows])
        i = open_.argmin(1)
        live = np.isfinite(open_[np.arange(len(rows)), i])
        rows, i = rows[live], i[live]
        if not len(rows):
            break
        done[rows, i] = True
        near = links[ids[rows, i]]
        new = (near >= 0) & ~seen[rows[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(new)
        seen[rows[r], near[r, c]] = True
        d = np.full(near.shape, np.inf)
        d[r, c] = ((x[near[r, c]] - queries[rows[r]]) ** 2).sum(1)
        all_d = np.concatenate([dist[rows], d], 1)
        order = np.argsort(all_d, 1, kind="stable")[:, :ef]
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(new, near, _NONE)], 1), order, 1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], np.zeros(near.shape, bool)], 1), order, 1)
        dist[rows] = np.take_along_axis(all_d, order, 1)
    return ids, dist


def descend(x: np.ndarray, levels: list[np.ndarray], queries: np.ndarray, top: int) -> np.ndarray:
    """The row that each query ends at when it goes to nearer neighbours on each level, from row ``top``."""
    q = len(queries)
    at = np.full(q, top)
    best = ((x[at] - queries) ** 2).sum(1)
    for links in levels:
        while True:
            near = links[at]
            d = np.where(near >= 0, ((x[np.maximum(near, 0)] - queries[:, None]) ** 2).sum(2), np.inf)
            i = d.argmin(1)
            low = d[np.arange(q), i]
            move = low < best
            if not move.any():
                break
            at = np.where(move, near[np.arange(q), i], at)
            best = np.minimum(best, low)
    return at


def _linked(x: np.ndarray, links: np.ndarray, node: np.ndarray, other: np.ndarray) -> None:
    """Add links node -> other; a node with more than fit keeps those that the rule chooses."""
    width = links.shape[1]
    touched, first, count = np.unique(node, return_index=True, return_counts=True)
    order = np.argsort(node, kind="stable")
    rank = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
    have = (links[touched] >= 0).sum(1)
    wide = np.full((len(touched), width + int(count.max())), _NONE, np.int64)
    wide[:, :width] = links[touched]
    row = np.repeat(np.arange(len(touched)), count)
    wide[row, have[row] + rank] = other[order]
    few = have + count <= width
    links[touched[few]] = wide[few, :width]
    node, wide = touched[~few], wide[~few]
    if len(node):
        d = np.where(wide >= 0, _gap(x, node[:, None], np.maximum(wide, 0)), np.inf)
        links[node] = choose(x, node, np.take_along_axis(wide, np.argsort(d, 1, kind="stable"), 1), width)


def build(x: np.ndarray, degree: int = 16, ratio: int = 16, ef: int = 64, seed: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the top down: the nodes, and for each of them its neighbours (-1 for none)."""
    n = len(x)
    rng = np.random.default_rng(seed)
    height = np.floor(-np.log(np.maximum(rng.random(n), 1e-12)) / math.log(ratio)).astype(np.int64)
    order = np.argsort(-height, kind="stable")
    above: list[np.ndarray] = []
    levels = []
    for level in range(int(height.max(initial=0)), -1, -1):
        rows = order[: int((height >= level).sum())]
        width = degree if level else degree * 2
        links = np.full((n, width), _NONE, np.int32)
        settled = len(levels[-1][0]) if levels else 0
        inserted = 0
        while inserted < len(rows):
            part = rows[inserted : inserted + STEP]
            d = ((x[part] ** 2).sum(1)[:, None] + (x[part] ** 2).sum(1) - 2 * (x[part] @ x[part].T)) if len(part) > 1 else np.zeros((1, 1))
            np.fill_diagonal(d, np.inf)
            near = np.argsort(d, 1, kind="stable")[:, : min(ef, len(part) - 1)]
            found, dist = part[near], np.take_along_axis(d, near, 1)
            if inserted:
                # a node of the level above may not be here yet while those are being inserted
                start = descend(x, above, x[part], order[0]) if inserted >= settled else np.full(len(part), order[0])
                ids, far = beam(x, links, x[part], start, ef)
                found, dist = np.concatenate([found, ids], 1), np.concatenate([dist, far], 1)
            best = np.argsort(dist, 1, kind="stable")[:, :ef]
            found = np.where(np.isfinite(np.take_along_axis(dist, best, 1)), np.take_along_axis(found, best, 1), _NONE)
            out = choose(x, part, found, width // 2) if found.shape[1] else np.full((len(part), 0), _NONE)
            a, b = np.repeat(part, out.shape[1])[out.ravel() >= 0], out.ravel()[out.ravel() >= 0]
            if len(a):
                both = np.unique(np.r_[np.stack([a, b], 1), np.stack([b, a], 1)], axis=0)
                old = (links[both[:, 0]] == both[:, 1:2]).any(1)
                _linked(x, links, both[~old, 0], both[~old, 1])
            inserted += len(part)
        levels.append((rows, links[rows]))
        above.append(links)
    return levels


def opened(levels: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[list[np.ndarray], int]:
    """Stored levels as arrays by row, and the row to begin at."""
    out = []
    for rows, links in levels:
        x = np.full((n, links.shape[1]), _NONE, np.int32)
        x[rows] = links
        out.append(x)
    return out, int(levels[0][0][0])


def search(x: np.ndarray, levels: list[np.ndarray], top: int, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    return beam(x, levels[-1], queries, descend(x, levels[:-1], queries, top), ef)


def _index(k: int, degree: int):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["id", "rid"], kind="stable")
        x = np.array(p["v"].tolist(), np.float64)
        rows, which = np.unique(x, axis=0, return_inverse=True)
        which = which.ravel()
        order = np.argsort(which, kind="stable")
        rank = np.arange(len(order)) - np.searchsorted(which[order], which[order])
        few = rank <= k  # the smallest ids; one more, as a query's own row doesn't count
        held = np.full((2, len(rows), k + 1), _NONE, np.int64)
        there = np.zeros(held.shape[1:], bool)
        for i, c in enumerate(("id", "rid")):
            held[i][which[order][few], rank[few]] = p[c].to_numpy()[order][few]
        there[which[order][few], rank[few]] = True
        levels = build(rows, degree)
        return pd.DataFrame({"shard": [p["shard"].iat[0]], "x": [rows.tobytes()], "ids": [held.tobytes()], "there": [there.tobytes()], "dim": [x.shape[1]], "nodes": [[r.astype(np.int32).tobytes() for r, _ in levels]], "links": [[n.tobytes() for _, n in levels]]})

    return run


def _answer(k: int, ef: int):
    """Rows sorted by shard, its index before its queries."""

    def answers(index, qid, points):
        x, held, rids, there, levels, top = index
        out: list[list] = [[], [], [], []]
        for i in range(0, len(points), STEP):
            found, _ = search(x, levels, top, points[i : i + STEP], ef)
            for (own, name), point, at in zip(qid[i : i + STEP], points[i : i + STEP], found, strict=True):
                at = at[at >= 0]
                d = np.sqrt(((x[at] - point) ** 2).sum(1))
                ok = there[at] & (rids[at] != own)
                ids, dist = held[at][ok], np.repeat(d[:, None], held.shape[1], 1)[ok]
                best = np.lexsort((ids, dist))[:k]
                for c, v in zip(out, ([own] * len(best), [name] * len(best), ids[best].tolist(), dist[best].tolist()), strict=True):
                    c += v
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["rid", "query_id", "vec_id", "score"])

    def run(batches):
        index = None
        for batch in batches:
            query = np.array(batch.column("dim").is_null())
            # runs of queries, parted by index rows
            cuts = [-1, *np.flatnonzero(~query).tolist(), batch.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i >= 0:
                    row = batch.slice(i, 1).to_pylist()[0]
                    x = np.frombuffer(row["x"]).reshape(-1, row["dim"])
                    ids, rids = np.frombuffer(row["ids"], np.int64).reshape(2, len(x), -1)
                    levels = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)) for a, b in zip(row["nodes"], row["links"], strict=True)]
                    levels, top = opened([(a, b.reshape(len(a), -1)) for a, b in levels], len(x))
                    index = x, ids, rids, np.frombuffer(row["there"], bool).reshape(len(x), -1), levels, top
                part = batch.slice(i + 1, j - i - 1)
                if part.num_rows and index is not None:
                    qid = list(zip(part.column("rid").to_pylist(), part.column("id").to_pylist(), strict=True))
                    points = part.column("v").combine_chunks() if isinstance(part.column("v"), pa.ChunkedArray) else part.column("v")
                    yield answers(index, qid, points.flatten().to_numpy().reshape(part.num_rows, -1))

    return run


def nearest_neighbours(
    embeddings: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 100,
    k: int = 10,
    shard_size: int | None = None,
    degree: int = 16,
    ef: int = 128,
) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance); queries are the rows whose id is divisible by ``every``."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim, count = top if top else (0, 0)
    # a number for each row, since ids may repeat
    rows = materialize(rows.filter(F.size("v") == dim).withColumn("rid", F.monotonically_increasing_id()), "hnsw_rows")
    shards = max(1, -(-count // (shard_size or min(131_072, max(4096, 16 * math.isqrt(count))))))
    index = rows.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")).groupBy("shard")
    index = materialize(index.applyInPandas(_index(k, degree), "shard int, x binary, ids binary, there binary, dim int, nodes array<binary>, links array<binary>"), "hnsw_index")
    asked = rows.filter(F.col("id") % every == 0).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = index.unionByName(asked, allowMissingColumns=True).repartition(shards, "shard").sortWithinPartitions("shard", F.col("dim").isNull())
    found = both.mapInArrow(_answer(k, ef), "rid long, query_id long, vec_id long, score double")
    order = W.partitionBy("rid").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
