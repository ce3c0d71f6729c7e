"""Toxicity from the nearest labelled examples.

Terms are a text's lower-cased letter runs, held as 51-bit hashes.  Of all terms of
the labelled rows (of up to ``max_labels`` ids, a documented bound; the smallest
hashes), a log-likelihood test marks those tied to label 1: in at least
``min_df`` texts, most of them label 1, at most ``max_terms``, and as many of the
strongest as hold no more than ``false_share`` chance finds.  Copies of one text
(equal smallest hash of five words) with one label are one text in all of this.

The examples are up to ``max_examples`` of those texts (a documented bound; the
smallest hashes, an equal part of either label with and without marked terms while
all four suffice).  All their terms span the space; document frequencies over all
documents give the IDF.  Vectors are unit-length TF-IDF; terms without a mark weigh
``FAINT`` times as much, so they decide where no marked one occurs and break ties
where one does.  A text's terms that no example has lengthen its vector as if no
other document had them.

The inverted index lies in blocks of ``BLOCK`` examples; each term keeps its largest
weight in each block.  A query adds up those maxima, reads the postings in the
blocks of the largest bounds, then those in all blocks whose bound still reaches its
k-th cosine, so the neighbours are exact.  Neighbours vote with weight
1 / (distance + 0.05), less that of an unrelated example, against one vote for label 0; votes of the four parts are
weighed back to the parts' true shares, and a monotone map makes them probabilities.
It is fitted on the examples' own leave-one-out votes and, with the weight ``REPEAT``,
on their votes as repeated texts.  A text that shares no term with an example
gets the share of toxic ones among labelled texts without marked terms.

``evidence`` holds the nearest examples' ids and cosines.

Nulls: a null text is empty; labels other than 0 and 1, and null ids among the
labels, teach nothing.  An id with several labels is label 1 if any is.  Rows that
repeat an id are each scored.  Ties between neighbours go to the earlier example.
A text is scored whole, however long.  Without labels, or with labels of one value
only, every text gets one score.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import crc_mod, crc_text, letter_runs, materialize, shingles, slices, utf8, word_hashes

BLOCK = 64
#: Terms whose counts a task holds before it passes them on.
HELD = 2_000_000
CLOSE = 0.05
#: Weight of terms without a mark; of an example's repeat in the map's fit.
FAINT, REPEAT = 1e-3, 0.05
#: Blocks that a query reads first.
FIRST = 4
#: Bytes of text that are cut and counted at a time.
SLICE = 1 << 20
_BITS = 51


def bag(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the distinct terms of each text, in that order; 8,192 texts at most."""
    h, w = letter_runs(col)
    row = np.repeat(np.arange(len(col), dtype=np.uint64), np.diff(w))
    key = np.sort((row << np.uint64(_BITS)) | (h >> np.uint64(64 - _BITS)))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(key)])
    key = key[first]
    return (key >> np.uint64(_BITS)).astype(np.int64), (key & np.uint64((1 << _BITS) - 1)).astype(np.int64), count


class Places:
    """The numbers of a fixed set of terms: an open-addressed table."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.asarray(terms, np.int64)
        bits = max(4, (2 * len(self.terms)).bit_length())
        self.shift, self.mask = _BITS - bits, (1 << bits) - 1
        self.table = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(self.terms))
        slot = self.terms >> self.shift
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            out = self.table[slot] != left
            left, slot = left[out], (slot[out] + 1) & self.mask

    def __len__(self) -> int:
        return len(self.terms)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The number of each term, -1 for one that isn't there."""
        out = np.full(len(x), -1, np.int64)
        left, slot = np.arange(len(x)), x >> self.shift
        while len(left):
            t = self.table[slot]
            there = t >= 0
            left, slot, t = left[there], slot[there], t[there]
            hit = self.terms[t] == x[left]
            out[left[hit]] = t[hit]
            left, slot = left[~hit], (slot[~hit] + 1) & self.mask
        return out


def _label_counts(batches):
    """(term, texts, texts of label 1) of rows (id, text, y)."""
    held, n = [], 0

    def out():
        term, at = np.unique(np.concatenate([t for t, _ in held] or [np.zeros(0, np.int64)]), return_inverse=True)
        y = np.concatenate([y for _, y in held] or [np.zeros(0)])
        return pa.record_batch({"term": pa.array(term), "n": pa.array(np.bincount(at, minlength=len(term))), "pos": pa.array(np.bincount(at, y, len(term)).astype(np.int64))})

    for part in slices(batches, limit=SLICE):
        row, term, _ = bag(part.column(1))
        held.append((term, part.column(2).to_numpy(zero_copy_only=False)[row]))
        n += len(term)
        if n > HELD:
            yield out()
            held, n = [], 0
    yield out()


def _document_counts(shared):
    def run(batches):
        places = shared.value
        total = np.zeros(len(places) + 1, np.int64)
        for part in slices(batches, limit=SLICE):
            at = places(bag(part.column(1))[1])
            total += np.bincount(at[at >= 0], minlength=len(total))
            total[-1] += part.num_rows
        at = np.flatnonzero(total)
        yield pa.record_batch({"i": pa.array(at, pa.int32()), "n": pa.array(total[at])})

    return run


def vectors(row: np.ndarray, at: np.ndarray, count: np.ndarray, rows: int, idf: np.ndarray, rare: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row its terms in the space and their weights; ``rare`` is the weight of
    a term that isn't (``at`` -1)."""
    w = (1 + np.log(count)) * np.where(at < 0, rare, idf[at] if len(idf) else rare)
    size = np.sqrt(np.bincount(row, w * w, rows))
    there = at >= 0
    row, at, w = row[there], at[there], w[there]
    w = w / size[row]
    order = np.lexsort((at, row))
    cut = np.searchsorted(row, np.arange(1, rows))
    return list(zip(np.split(at[order], cut), np.split(w[order], cut), strict=True))


def discoveries(signals: list[float], tests: int, share: float) -> int:
    """How many of the strongest signals to take so that no more than ``share`` of
    them are expected to be chance among so many tests (Benjamini and Hochberg)."""
    best = 0
    for k, g in enumerate(signals, 1):
        if math.erfc(math.sqrt(g / 2)) / 2 <= share * k / max(1, tests):
            best = k
    return best


def _signal(base: float):
    """Log-likelihood ratio of ``pos`` of n texts being label 1 against the share ``base`` of all."""
    n, p = F.col("n"), F.col("pos")
    return 2 * (F.when(p > 0, p * F.log(p / (n * base))).otherwise(0.0) + F.when(n > p, (n - p) * F.log((n - p) / (n * (1 - base)))).otherwise(0.0))


def _kinds(batches):
    """Rows (id, text, y) with their smallest hash of five words, which copies share."""
    for batch in slices(batches, limit=SLICE):
        h, w = word_hashes(*utf8(batch.column(1)))
        kinds = [int(s[0]) >> 1 if len(s) else -1 for s in (shingles(h[a:b], 5) for a, b in zip(w[:-1], w[1:], strict=True))]
        yield pa.record_batch([*batch.columns, pa.array(kinds, pa.int64())], names=["id", "text", "y", "kind"])


class BlockMaxIndex:
    """Exact cosine neighbours among a bounded set of unit vectors."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK):
        self.size, self.block = len(vectors), block
        self.blocks = max(1, -(-len(vectors) // block))
        term = np.concatenate([v[0] for v in vectors] or [np.zeros(0, np.int64)])
        weight = np.concatenate([v[1] for v in vectors] or [np.zeros(0)])
        doc = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
        order = np.lexsort((doc, term))
        self.doc, self.weight = doc[order].astype(np.int32), weight[order]
        self.first = np.searchsorted(term[order], np.arange(terms + 1)).astype(np.int32)
        self._cells()

    def _cells(self) -> None:
        """The blocks each term is in, its postings there and the largest weight."""
        term = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        cell = term * self.blocks + self.doc // self.block
        start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        self.where = (cell[start] % self.blocks).astype(np.int32)
        self.top = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.begin = np.r_[start, len(cell)].astype(np.int32)
        self.cells = np.searchsorted(start, self.first).astype(np.int32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("where", "top", "begin", "cells")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._cells()

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine (ties to the earlier) and their cosines."""
        cell, n = _spread(self.cells[at], self.cells[at + 1])
        x = np.repeat(w, n)
        block = self.where[cell]
        bound = np.bincount(block, x * self.top[cell], self.blocks)
        order = np.argsort(-bound, kind="stable")
        ids, cos = np.zeros(0, np.int64), np.zeros(0)
        for chosen in (order[:FIRST], order[FIRST:]):
            if len(ids) >= k:
                chosen = chosen[bound[chosen] >= cos[-1] - 1e-12]
            if not len(chosen):
                continue
            here = np.zeros(self.blocks, bool)
            here[chosen] = True
            read = here[block]
            post, n = _spread(self.begin[cell[read]], self.begin[cell[read] + 1])
            score = np.bincount(self.doc[post], np.repeat(x[read], n) * self.weight[post], self.size)
            new = (chosen[:, None] * self.block + np.arange(self.block)).ravel()
            new = new[(new < self.size) & (new != skip)]
            ids, cos = np.r_[ids, new], np.r_[cos, score[new]]
            if len(ids) > k:
                keep = cos >= np.partition(cos, len(cos) - k)[len(cos) - k]
                ids, cos = ids[keep], cos[keep]
            best = np.lexsort((ids, -cos))[:k]
            ids, cos = ids[best], cos[best]
        return ids, cos


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges, one after the other, and the ranges' lengths."""
    n = (end - begin).astype(np.int64)
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), n


def votes(cos: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Share of the neighbours' votes for label 1."""
    v = weight * (1 / (np.sqrt(np.clip(2 - 2 * cos, 0, 2)) + CLOSE) - 1 / (math.sqrt(2) + CLOSE))
    return float((v * y).sum() / (v.sum() + 1))


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least-squares fit (pooled neighbours): knots and values."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        pools.append([w, w * b, w * a])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def learn(
    documents: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    modulus: int = 4,
    held_out: int | None = 2,
    k: int = 15,
    max_labels: int = 20_000,
    max_examples: int = 2048,
    max_terms: int = 4096,
    min_df: int = 3,
    min_signal: float = 10.0,
    false_share: float = 0.01,
) -> Callable:
    """A function from a column of texts to pairs (score, evidence), to be run on executors.
    ``held_out`` None: all labelled rows teach."""
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    if held_out is not None:
        known = known.filter(crc_mod(F.col("id"), modulus) != held_out)
    by_hash = [F.xxhash64("id"), "id"]
    chosen = known.orderBy(*by_hash).limit(max_labels)
    train = docs.withColumn("id", F.col("id").cast("long")).join(F.broadcast(chosen), "id")  # max_labels pairs of numbers

    # copies of a text count as one from the start: a large group of them has many words of its own
    train = train.select("id", "text", "y").mapInArrow(_kinds, "id long, text string, y int, kind long")
    one = train.groupBy("kind", "y").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id", "text")).alias("x")).select("x.id", "x.text", "y", "kind")
    train = materialize(one, "toxic_rows")
    texts_, toxic_ = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    strong_terms = np.zeros(0, np.int64)
    if 0 < toxic_ < texts_:
        base = toxic_ / texts_
        counts = materialize(train.select("id", "text", "y").mapInArrow(_label_counts, "term long, n long, pos long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).filter(F.col("n") >= min_df), "toxic_terms")
        tests = counts.count()
        found = counts.withColumn("g", _signal(base)).filter(F.col("g") >= min_signal).filter(F.col("pos") / F.col("n") >= (1 + base) / 2)
        best = found.select("term", "g").orderBy(F.desc("g"), "term").limit(max_terms).collect()
        strong_terms = np.array([r["term"] for r in best[: discoveries([r["g"] for r in best], tests, false_share)]], np.int64)
    strong = len(strong_terms)
    marked = spark.sparkContext.broadcast(Places(strong_terms))  # max_terms at most

    def has_marked(batches):
        for part in slices(batches, limit=SLICE):
            row, term, _ = bag(part.column(1))
            some = np.bincount(row, minlength=part.num_rows) > 0
            has = np.bincount(row, marked.value(term) >= 0, part.num_rows) > 0
            yield pa.record_batch([part.column(0), part.column(2), part.column(3), pa.array(has.astype(np.int32)), pa.array(some)], names=["id", "y", "kind", "has", "some"])

    rows = materialize(train.mapInArrow(has_marked, "id long, y int, kind long, has int, some boolean"), "toxic_marks")
    # examples: texts with terms, an equal part of either label with and without marked ones; what a part lacks the others get
    some = np.zeros((2, 2))
    for y, has, n in rows.filter("some").groupBy("y", "has").count().collect():
        some[y, has] = n
    want, left = {}, max_examples
    for i, (y, has) in enumerate(sorted(np.ndindex(2, 2), key=lambda c: some[c])):
        want[y, has] = min(int(some[y, has]), left // (4 - i))
        left -= want[y, has]
    parts = [rows.filter(F.col("some") & (F.col("y") == y) & (F.col("has") == has)).orderBy(*by_hash, "kind").limit(n).select("kind", "y") for (y, has), n in want.items()]
    taken = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])

    def example_terms(batches):
        for part in slices(batches, limit=SLICE):
            row, term, count = bag(part.column(1))
            off = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
            yield pa.record_batch([part.column(0), part.column(2), pa.ListArray.from_arrays(off, pa.array(term)), pa.ListArray.from_arrays(off, pa.array(count, pa.int32()))], names=["id", "y", "terms", "n"])

    of_examples = train.join(F.broadcast(taken), ["kind", "y"], "left_semi").select("id", "text", "y").mapInArrow(example_terms, "id long, y int, terms array<bigint>, n array<int>")
    got = of_examples.toArrow().combine_chunks().sort_by([("y", "ascending"), ("id", "ascending")])  # max_examples texts
    ids, y = got["id"].to_numpy(), got["y"].to_numpy().astype(float)
    row = np.repeat(np.arange(len(ids)), [len(x) for x in got["terms"]])
    term, count = (np.array([v for x in got[c].to_pylist() for v in x], np.int64) for c in ("terms", "n"))
    places = Places(np.r_[strong_terms, np.setdiff1d(term, strong_terms)])
    shared = spark.sparkContext.broadcast(places)  # the terms of max_examples texts
    df = np.zeros(len(places) + 1)
    counted = docs.mapInArrow(_document_counts(shared), "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    df[counted["i"].to_numpy()] = counted["n"].to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    idf[strong:] *= FAINT
    rare = FAINT * (math.log((1 + df[-1]) / 2) + 1)
    found = vectors(row, places(term), count, len(ids), idf, rare) if len(ids) else []
    # neighbours in a block should be alike, so that bounds differ between blocks
    order = sorted(range(len(ids)), key=lambda i: (found[i][0][int(np.argmax(found[i][1]))], len(found[i][0])))
    found, ids, y = [found[i] for i in order], ids[order], y[order]
    index = BlockMaxIndex(found, max(1, len(places)))
    # the parts are weighed back to their true shares
    has = np.array([at[0] < strong for at, _ in found], int)
    weight = np.ones(len(y))
    for part in np.ndindex(2, 2):
        here = (y == part[0]) & (has == part[1])
        if here.any():
            weight[here] = some[part] / here.sum()
    own = np.zeros((2, len(y)))
    for i, (at, w) in enumerate(found):
        for repeated in (0, 1):
            near, cos = index.nearest(at, w, k, -1 if repeated else i)
            own[repeated, i] = votes(cos, y[near], weight[near])
    knots, values = monotone(own.reshape(-1), np.r_[y, y], np.r_[weight, REPEAT * weight]) if len(y) else (np.zeros(1), np.zeros(1))
    bare = rows.filter("has = 0").agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    none = float((bare[1] + 0.5 * (toxic_ > 0)) / (bare[0] + 1)) if texts_ else 0.0
    model = spark.sparkContext.broadcast((index, y, weight, ids, idf, rare, knots, values, none))  # max_examples vectors

    def score(col: pa.Array, kept: dict) -> list[tuple]:
        index, y, weight, ids, idf, rare, knots, values, none = model.value
        row, term, count = bag(col)
        out = []
        for at, w in vectors(row, shared.value(term), count, len(col), idf, rare):
            if not len(at) or not len(y):
                out.append((none, []))
                continue
            key = blake2b(at.tobytes() + w.tobytes(), digest_size=16).digest()  # texts of equal terms have equal scores
            if key not in kept:
                if len(kept) > 50_000:
                    kept.clear()
                near, cos = index.nearest(at, w, k)
                s = float(np.interp(votes(cos, y[near], weight[near]), knots, values))
                kept[key] = (min(1.0, max(0.0, s)), [{"id": int(i), "cosine": float(c)} for i, c in zip(ids[near[:3]], cos[:3], strict=True) if c > 0])
            out.append(kept[key])
        return out

    return score


def toxicity(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, held_out: int | None = 2, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence."""
    score = learn(documents, labels, id_col=id_col, text_col=text_col, modulus=modulus, held_out=held_out, **options)
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        kept: dict = {}
        for batch in slices(batches, limit=SLICE):
            got = score(batch.column(1), kept)
            held = [held_out is not None and crc_text(i) % modulus == held_out for i in batch.column(0).to_pylist()]
            why = pa.array([e for _, e in got], pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64())])))
            yield pa.record_batch([batch.column(0), pa.array(held, pa.bool_()), pa.array([s for s, _ in got], pa.float64()), pa.array([int(s >= threshold) for s, _ in got], pa.int32()), why], names=[id_col, "held_out", "score", "predicted", "evidence"])

    evidence = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("cosine", T.DoubleType())]))
    return docs.mapInArrow(run, T.StructType([T.StructField(id_col, docs.schema["id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", evidence)]))


def with_toxicity(documents: DataFrame, labels: DataFrame, *, text_col: str = "text", score_col: str = "__score", **options) -> DataFrame:
    """All columns of ``documents`` and ``score_col``."""
    score = learn(documents, labels, text_col=text_col, **options)

    def run(batches):
        kept: dict = {}
        for batch in slices(batches, text_col, SLICE):
            got = score(batch.column(text_col), kept)
            yield pa.record_batch([*batch.columns, pa.array([s for s, _ in got], pa.float64())], names=[*batch.schema.names, score_col])

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(score_col, T.DoubleType())]))
