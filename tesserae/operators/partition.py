"""Balanced spatial partitions: an R*-style KD tree over a bounded sample, compiled to a column expression.

The tree is built on the driver from a sample whose size is a parameter; assigning
rows needs no join and no shuffle: a small tree is a nested CASE inside code
generation, a larger one is descended by Arrow batches over its broadcast rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import Box

#: Leaves up to which a tree is compiled to a nested CASE.
MOST_CASES = 256

@dataclass
class KDTree:
    """Rows (value, axis, low, high): a child is a row number, or -partition-1 for a leaf.
    A coordinate that equals the split value goes low.  No rows: one partition."""

    rows: list[list[float]] = field(default_factory=list)

    @property
    def partitions(self) -> int:
        return len(self.rows) + 1

    def find(self, x: float, y: float) -> int:
        at = 0 if self.rows else -1
        while at >= 0:
            value, axis, low, high = self.rows[at]
            at = int(low if (x, y)[int(axis)] <= value else high)
        return -at - 1

    def find_all(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``find`` for many points, level by level; NaN goes low."""
        at = np.full(len(x), 0 if self.rows else -1, np.int64)
        if self.rows:
            rows, p = np.array(self.rows, float), np.stack([x, y], 1)
            left = np.arange(len(x))
            while len(left):
                r = rows[at[left]]
                low = ~(p[left, r[:, 1].astype(int)] > r[:, 0])
                at[left] = np.where(low, r[:, 2], r[:, 3]).astype(np.int64)
                left = left[at[left] >= 0]
        return -at - 1

    def expression(self, x: Column, y: Column) -> Column:
        """The partition of a point; null coordinates are in partition 0, NaN goes low."""
        if len(self.rows) >= MOST_CASES:
            tree = SparkSession.getActiveSession().sparkContext.broadcast(self)  # four numbers a leaf

            @F.pandas_udf("int")
            def descend(a: pd.Series, b: pd.Series) -> pd.Series:
                return pd.Series(tree.value.find_all(a.to_numpy(float), b.to_numpy(float)).astype(np.int32))

            return F.when(x.isNull() | y.isNull(), F.lit(0)).otherwise(descend(x, y))
        x, y = (F.nanvl(c.cast("double"), F.lit(float("-inf"))) for c in (x, y))

        def node(at: int) -> Column:
            if at < 0:
                return F.lit(-at - 1)
            value, axis, low, high = self.rows[at]
            return F.when((x, y)[int(axis)] <= F.lit(value), node(int(low))).otherwise(node(int(high)))

        return F.when(x.isNull() | y.isNull(), F.lit(0)).otherwise(node(0 if self.rows else -1)).cast("int")

    def boxes(self, around: Box) -> list[Box]:
        """Each partition's part of ``around``."""
        out: dict[int, Box] = {}
        todo = [(0 if self.rows else -1, around)]
        while todo:
            at, b = todo.pop()
            if at < 0:
                out[-at - 1] = b
                continue
            value, axis, low, high = self.rows[at]
            lows, highs = [b.xmin, b.ymin], [b.xmax, b.ymax]
            cut_high, cut_low = list(highs), list(lows)
            cut_high[int(axis)] = min(highs[int(axis)], value)
            cut_low[int(axis)] = max(lows[int(axis)], value)
            todo.append((int(low), Box(*lows, *cut_high)))
            todo.append((int(high), Box(*cut_low, *highs)))
        return [out[i] for i in range(len(out))]

    def box(self, partition: int, around: Box) -> Box:
        all_ = self.boxes(around)
        if not 0 <= partition < len(all_):
            raise IndexError(f"partition {partition} of {len(all_)}")
        return all_[partition]


def split_bounds(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every cut of ordered points: lowest and highest of those up to it, and of those behind it."""
    back = p[::-1]
    return np.minimum.accumulate(p), np.maximum.accumulate(p), np.minimum.accumulate(back)[::-1], np.maximum.accumulate(back)[::-1]


def running_weight(w: np.ndarray) -> np.ndarray:
    """Weight up to and with each of ordered points."""
    return np.cumsum(w)


def _scores(p: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """(margins, overlap, areas) of the two boxes for each cut: the low side is p[:cut]."""
    lows, tops, behind_low, behind_top = split_bounds(p)
    lo_min, lo_max, hi_min, hi_max = lows[cuts - 1], tops[cuts - 1], behind_low[cuts], behind_top[cuts]
    low, high = lo_max - lo_min, hi_max - hi_min
    both = np.maximum(0, np.minimum(lo_max, hi_max) - np.maximum(lo_min, hi_min))
    return np.stack([low.sum(1) + high.sum(1), both.prod(1), low.prod(1) + high.prod(1)], 1)


def choose_split(p: np.ndarray, w: np.ndarray, least: float, band: float = 0.0) -> tuple[int, int, np.ndarray]:
    """Axis, cut and order of the best split that leaves ``least`` weight on both sides:
    smallest margins, then overlap, then areas; earlier axes and cuts win ties."""
    best = None
    for axis in range(p.shape[1]):
        order = np.argsort(p[:, axis], kind="stable")
        below = running_weight(w[order])
        cuts = np.flatnonzero((below >= least) & (below[-1] - below >= least)) + 1
        cuts = cuts[cuts < len(p)]
        if not len(cuts):
            cuts = np.array([min(len(p) // 2 + 1, len(p) - 1)])
        elif band > 0:
            a, b = int((1 - band) / 2 * len(cuts)), int((1 + band) / 2 * len(cuts))
            cuts = cuts[a:b] if b > a else cuts
        s = _scores(p[order], cuts)
        i = np.lexsort((cuts, s[:, 2], s[:, 1], s[:, 0]))[0]
        if best is None or tuple(s[i]) < best[0]:
            best = (tuple(s[i]), axis, int(cuts[i]), order)
    return best[1], best[2], best[3]


def build_tree(points: np.ndarray, partitions: int, *, weights: np.ndarray | None = None, ratio: float = 0.95, band: float = 0.0, around: Box | None = None, seed: int = 42) -> KDTree:
    """A tree whose leaves hold at most ceil(N / partitions) points (or that share of the
    weight), so there may be more leaves than asked for.  Without points, a thousand
    uniform ones stand in."""
    p = np.asarray(points, float).reshape(-1, 2)
    if not len(p):
        b = around or Box(-180, -90, 180, 90)
        p, weights = np.random.default_rng(seed).uniform((b.xmin, b.ymin), (b.xmax, b.ymax), (1000, 2)), None
    if weights is None:
        w = np.ones(len(p))
        most = math.ceil(len(p) / max(1, partitions))
        least = math.ceil(ratio * most)
    else:
        w = np.asarray(weights, float)
        most = math.ceil(w.sum() / max(1, partitions))
        least = w.sum() * ratio / max(1, partitions)
    tree = KDTree()
    leaves = 0
    # pre-order, the low side first; a row's children are filled in as they are reached
    todo = [(np.arange(len(p)), -1, 0)]
    while todo:
        at, parent, side = todo.pop()
        ref = None
        if w[at].sum() > most and len(at) > 1:
            axis, cut, order = choose_split(p[at], w[at], least, band)
            at = at[order]
            ref = len(tree.rows)
            tree.rows.append([float(p[at[cut - 1], axis]), axis, 0, 0])
            todo += [(at[cut:], ref, 3), (at[:cut], ref, 2)]
        else:
            ref = -leaves - 1
            leaves += 1
        if parent >= 0:
            tree.rows[parent][side] = ref
    return tree


def sample_points(rows: DataFrame, *, x: str = "x", y: str = "y", key: str = "id", cap: int | None = 10_000, ratio: float = 1.0, seed: int = 42, order: Column | None = None) -> DataFrame:
    """A share ``ratio`` of the rows by hash, then those of the ``cap`` smallest hashes: the
    same rows in every run, and never more than ``cap`` of them on the driver.  ``order``:
    another whole number to go by than the hash of ``key`` and ``seed``."""
    h = F.xxhash64(F.col(key), F.lit(seed)) if order is None else order
    got = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    if ratio < 1:
        got = got.filter(F.pmod(h, F.lit(1_000_000)) < int(ratio * 1_000_000))
    return got if cap is None else got.orderBy(h, key).limit(cap)


def envelope(rows: DataFrame, xmin: str = "x", ymin: str = "y", xmax: str | None = None, ymax: str | None = None) -> Box:
    got = rows.agg(F.min(xmin), F.min(ymin), F.max(xmax or xmin), F.max(ymax or ymin)).first()
    if got[0] is None:
        raise ValueError("no geometry to take the bounds of")
    return Box(*got)


def assign(rows: DataFrame, tree: KDTree, *, x: str = "x", y: str = "y", into: str = "tile_id") -> DataFrame:
    return rows.withColumn(into, tree.expression(F.col(x), F.col(y)))


def assign_smallest_box(rows: DataFrame, boxes: DataFrame, *, key: str = "id", limit: int = 10_000) -> DataFrame:
    """Each row with the smallest of the boxes (id, minx, miny, maxx, maxy) that its own box
    touches; ties go to the first in order of ``pos``; rows without one are dropped.

    Up to ``limit`` boxes are broadcast and aggregated at once; more are met by way
    of grids.  A box lies in at most four cells of the grid whose cells (powers of two)
    are as wide as itself; a row and a box meet in the wider one's grid, whatever the unit."""
    area = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    touch = (F.col("xmax") >= F.col("minx")) & (F.col("xmin") <= F.col("maxx")) & (F.col("ymax") >= F.col("miny")) & (F.col("ymin") <= F.col("maxy"))
    boxes = boxes.withColumnRenamed("id", "box_id")
    if boxes.limit(limit + 1).count() <= limit:
        met = rows.join(F.broadcast(boxes), touch)
        return met.groupBy(key).agg(F.min_by("box_id", F.struct(area, F.col("pos"))).alias("tile"))
    wide = boxes.agg(F.avg(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")))).first()[0]
    least = math.floor(math.log2(wide)) if wide and wide > 0 else -20  # finer grids than the boxes' own bring nothing

    def leveled(df: DataFrame, a: str, b: str, c: str, d: str, into: str) -> DataFrame:
        size = F.greatest(F.col(c) - F.col(a), F.col(d) - F.col(b))
        return df.withColumn(into, F.when(size > 0, F.greatest(F.ceil(F.log2(size)).cast("int"), F.lit(least))).otherwise(F.lit(least)))

    rows, boxes = leveled(rows, "xmin", "ymin", "xmax", "ymax", "row_level"), leveled(boxes, "minx", "miny", "maxx", "maxy", "box_level")
    # a handful: powers of two between the narrowest and the widest
    row_levels, box_levels = (sorted(r[0] for r in df.select(c).distinct().collect() if r[0] is not None) for df, c in ((rows, "row_level"), (boxes, "box_level")))

    def cells(df: DataFrame, names, own: str, levels: list[int]) -> DataFrame:
        level = F.explode(F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v >= F.col(own)))
        df = df.withColumn("level", level)
        a, b, c, d = (F.floor(F.col(n) / F.pow(F.lit(2.0), F.col("level"))) for n in names)
        return df.withColumn("cx", F.explode(F.sequence(a, c))).withColumn("cy", F.explode(F.sequence(b, d)))

    levels = sorted({*row_levels, *box_levels})
    if not row_levels or not box_levels:
        return rows.join(boxes, touch).groupBy(key).agg(F.min_by("box_id", area).alias("tile"))  # one of them is empty
    left = cells(rows.filter("xmin <= xmax and ymin <= ymax"), ("xmin", "ymin", "xmax", "ymax"), "row_level", levels)
    right = cells(boxes.filter("minx <= maxx and miny <= maxy"), ("minx", "miny", "maxx", "maxy"), "box_level", levels)
    met = left.join(right, ["level", "cx", "cy"]).filter(touch & (F.col("level") == F.greatest("row_level", "box_level")))
    return met.groupBy(key).agg(F.min_by("box_id", F.struct(area, F.col("pos"))).alias("tile"))


def point_weights(points: DataFrame, bins: DataFrame, keys: list[str]) -> DataFrame:
    """Each point's share of its bin's value, rounded down."""
    counts = points.groupBy(*keys).agg(F.count("*").alias("__n"))
    return points.join(bins.join(counts, keys), keys).withColumn("weight", F.floor(F.col("value") / F.col("__n"))).drop("__n")
