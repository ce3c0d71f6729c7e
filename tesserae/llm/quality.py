"""Quality by histogram gradient-boosted trees over document statistics.

One pass computes a fixed number of statistics of each whole text (lengths,
shares of character classes, repetition of lines and words, ends of lines and
words).  Trees are fitted on up to ``max_rows`` labelled rows (a documented
bound; the smallest hashes of id) with at most 64 quantile bins a statistic.
All trees are flattened into arrays of feature, cut, child and value, which a
batch of documents descends together, one numpy step per level.

``score`` is the logistic of the summed leaves.

Nulls: a null text is an empty one; labels that are null or no 0/1 teach
nothing; of rows that repeat an id in the labels the largest counts.  With
labels of one kind only, every score is their share.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import crc_mod, crc_text, texts

STATISTICS = (
    "log_chars log_words mean_word log_lines mean_line upper digits punctuation symbols other_ascii controls non_ascii "
    "spaces distinct_words top_word distinct_lines repeated_chars long_words lines_stopped bullets pipes upper_words "
    "odd_words short_words bang digit_words"
).split()
_DIGIT, _UPPER, _PUNCT, _LOWER = b"0123456789", bytes(range(65, 91)), b".,;:!?'\"-()", bytes(range(97, 123))
_SYMBOL = b"#$%&*+/<=>@[\\]^_`{|}~"
_CONTROL = bytes(i for i in range(32) if i not in (9, 10, 13)) + b"\x7f"
_HIGH = bytes(range(128, 256))


def statistics(text: str) -> list[float]:
    raw = text.encode()
    n = max(1, len(raw))
    words = raw.split()
    m = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    bag = Counter(words)
    line_bag = Counter(lines)

    def share(which: bytes) -> float:
        return (len(raw) - len(raw.translate(None, which))) / n

    tidy = [w.rstrip(b".,;:!?") for w in bag]
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        sum(len(w) * c for w, c in bag.items()) / m,
        np.log1p(len(lines)),
        len(words) / k,
        share(_UPPER),
        share(_DIGIT),
        share(_PUNCT),
        share(_SYMBOL),
        share(_LOWER),
        share(_CONTROL),
        share(_HIGH),
        share(b" \t\n\r"),
        len(bag) / m,
        max(bag.values(), default=0) / m,
        len(line_bag) / k,
        sum(len(x) * (c - 1) for x, c in line_bag.items()) / n,
        sum(c for w, c in bag.items() if len(w) > 18) / m,
        sum(x.rstrip()[-1:] in b".!?:\"" for x in lines) / k,
        sum(x.lstrip()[:1] in b"-*|#>" for x in lines) / k,
        raw.count(b"|") / m,
        sum(c for w, c in bag.items() if w.isupper()) / m,
        sum(not t.isalpha() and t.isascii() for t in tidy) / max(1, len(bag)),
        sum(c for w, c in bag.items() if len(w) < 4) / m,
        raw.count(b"!") / m,
        sum(c for w, c in bag.items() if any(48 <= b < 58 for b in w)) / m,
    ]


@dataclass
class Forest:
    """Node i sends a row left if row[feature] <= cut; a leaf is its own child."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Forest:
    """Boosting of the logistic loss on binned statistics."""
    n, d = x.shape
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if n else 0.5
    start = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(d)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f]) for f in range(d)], 1) if n else np.zeros((0, d), np.int64)
    flat = binned + np.arange(d) * bins
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        i = len(feature)
        feature.append(0), cut.append(np.inf), left.append(i), right.append(i), value.append(0.0)
        return i

    margin = np.full(n, start)
    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(node())
        open_ = [(roots[-1], np.arange(n), 0)]
        while open_:
            i, rows, level = open_.pop()
            sg, sh = g[rows].sum(), h[rows].sum()
            best, where = 1e-6, None
            if level < depth and len(rows) >= 2 * least:
                k = flat[rows].ravel()
                hist = [np.bincount(k, w, d * bins).reshape(d, bins).cumsum(1)[:, :-1] for w in (np.repeat(g[rows], d), np.repeat(h[rows], d), np.ones(len(k)))]
                gl, hl, nl = hist
                gain = gl**2 / (hl + ridge) + (sg - gl) ** 2 / (sh - hl + ridge) - sg**2 / (sh + ridge)
                gain[(nl < least) | (len(rows) - nl < least)] = 0
                for f in range(d):
                    gain[f, len(cuts[f]) :] = 0
                k = int(gain.argmax())
                if gain.flat[k] > best:
                    where = divmod(k, bins - 1)
            if where is None:
                value[i] = -rate * sg / (sh + ridge)
                margin[rows] += value[i]
                continue
            f, b = where
            low = binned[rows, f] <= b
            feature[i], cut[i] = f, float(cuts[f][b])
            left[i], right[i] = node(), node()
            open_ += [(left[i], rows[low], level + 1), (right[i], rows[~low], level + 1)]
    return Forest(np.array(feature, np.int64), np.array(cut), np.array(left, np.int64), np.array(right, np.int64), np.array(value), np.array(roots, np.int64), depth, start)


def learn(
    documents: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    modulus: int = 3,
    held_out: int | None = 1,
    max_rows: int = 20_000,
) -> Callable:
    """A function from texts to scores, to be run on executors.  ``held_out`` None: all labelled rows teach."""
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    if held_out is not None:
        known = known.filter(crc_mod(F.col("id"), modulus) != held_out)

    def measure(batches):
        for batch in batches:
            rows = np.array([statistics(x) for x in texts(batch.column(1))], float).reshape(-1, len(STATISTICS))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(list(rows), pa.list_(pa.float64()))], names=["id", "y", "x"])

    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    train = docs.withColumn("id", F.col("id").cast("long")).join(F.broadcast(chosen), "id").mapInArrow(measure, "id long, y int, x array<double>")
    # of the texts of one id, one teaches: max_rows rows, however often an id comes
    train = train.groupBy("id").agg(F.max("y").alias("y"), F.min("x").alias("x")).toPandas()
    train = train.sort_values("id", kind="stable")
    forest = fit(np.array(train["x"].tolist(), float).reshape(-1, len(STATISTICS)), train["y"].to_numpy(float))
    model = spark.sparkContext.broadcast(forest)

    def score(batch_texts) -> np.ndarray:
        x = np.array([statistics(t) for t in batch_texts], float).reshape(-1, len(STATISTICS))
        return np.concatenate([np.zeros(0), *(model.value.score(x[i : i + 2000]) for i in range(0, len(x), 2000))])

    return score


def quality(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, held_out: int | None = 1, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    score = learn(documents, labels, id_col=id_col, text_col=text_col, modulus=modulus, held_out=held_out, **options)
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            s = score(texts(batch.column(1)))
            held = [held_out is not None and crc_text(i) % modulus == held_out for i in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(held, pa.bool_()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([T.StructField(id_col, docs.schema["id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def with_quality(documents: DataFrame, labels: DataFrame, *, text_col: str = "text", score_col: str = "__score", **options) -> DataFrame:
    """All columns of ``documents`` and ``score_col``."""
    score = learn(documents, labels, text_col=text_col, **options)

    def run(batches):
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array(score(texts(batch.column(text_col))))], names=[*batch.schema.names, score_col])

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(score_col, T.DoubleType())]))
