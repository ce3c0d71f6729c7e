"""Language-model scoring by a lattice of all segmentations.

A text is its words ``[^\\x20\\x09-\\x0D]+`` (A-Z lowered) and one end.  Each word
is the lattice of every way to write the whitespace marker and the word with
pieces of a fixed public vocabulary (byte pieces included).  The vocabulary's own
scores are the first piece weights; expectation-maximisation over all training
words, each as often as it occurs, re-weighs them.  A forward recursion in log space
sums all segmentations.  Because the marker can only begin a word, a text's marginal
is the product over its words and its end, so each distinct word is summed once.

``score`` is that marginal.  ``mixed_score`` adds to each word's lattice one arc for
the word itself, which takes its training count less a discount, while the
discounts' mass goes to the pieces:

    P(word) = (max(c - D, 0) + D * types * P(pieces)) / words

Scale: the word table is one shuffle of pre-aggregated counts.  At most
``hot_words`` of the words used most are broadcast; all other (document,
word) pairs meet their scores in a shuffle join.

Nulls: a null text is empty (its end only), a null id counts as ''.  Rows that
repeat id and text are each returned.  With no training rows every word has the
vocabulary's weight alone.  A text is read whole, however long; an empty table
gives an empty one.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pieces as P
from .shared import crc_text, materialize, texts

#: Bytes of words in one lattice batch.
BATCH = 200_000
#: Distinct words a task holds before it passes their counts on.
HELD = 300_000


def _count(modulus: int, remainder: int):
    """(word, training count, uses anywhere); the ends of training texts as the empty word."""

    def run(batches):
        held: Counter = Counter()
        seen: Counter = Counter()

        def out():
            names = list(seen.keys() | held.keys())
            c = np.array([held.get(w, 0) for w in names], np.int64)
            return pa.record_batch({"word": pa.array(names, pa.binary()), "c": pa.array(c), "u": pa.array(c + np.array([seen.get(w, 0) for w in names], np.int64))})

        ends = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                words = text.encode().lower().split()
                if crc_text(i) % modulus == remainder:
                    seen.update(words)
                else:
                    held.update(words)
                    ends += 1
                if len(held) + len(seen) > HELD:
                    yield out()
                    held.clear()
                    seen.clear()
        yield out()
        yield pa.record_batch({"word": pa.array([b""], pa.binary()), "c": pa.array([ends], pa.int64()), "u": pa.array([0], pa.int64())})  # no word is empty

    return run


def word_logs(v: P.Vocabulary, words: list[bytes], lp: np.ndarray) -> np.ndarray:
    """Log probability of each word, all its segmentations into pieces summed."""
    mark = P.MARK.encode()
    marked = [mark + w for w in words]
    out = np.empty((len(words), *lp.shape[1:]))
    for idx in P.by_length(marked, BATCH):
        out[idx] = P.marginals(P.lattice(v, *P.pack([marked[i] for i in idx]), True), lp)
    return out


def _expect(shared, lp):
    def run(batches):
        v, total, mark = shared.value, np.zeros(len(lp)), P.MARK.encode()
        for batch in batches:
            marked = [mark + w for w in batch.column(0).to_pylist()]
            count = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            for idx in P.by_length(marked, BATCH):
                x = P.lattice(v, *P.pack([marked[i] for i in idx]), True)
                total += np.bincount(x.piece, P.expected(x, lp) * count[idx][x.text], len(lp))
        used = np.flatnonzero(total)
        yield pa.record_batch({"piece": pa.array(used, pa.int32()), "n": pa.array(total[used])})

    return run


def lm_score(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | P.Vocabulary = P.DEFAULT_VOCABULARY,
    modulus: int = 5,
    held_out: int = 1,
    rounds: int = 4,
    discount: float = 0.75,
    hot_words: int = 200_000,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mixed_score (log10)."""
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    v = P.Vocabulary.load(vocabulary) if isinstance(vocabulary, str) else vocabulary
    shared = spark.sparkContext.broadcast(v)  # a fixed file of 32 thousand pieces

    words = materialize(docs.mapInArrow(_count(modulus, held_out), "word binary, c long, u long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("u").alias("u")), "lm_words")
    n_words, types, ends = words.agg(F.sum(F.when(F.length("word") > 0, F.col("c"))), F.sum(((F.length("word") > 0) & (F.col("c") > 0)).cast("long")), F.sum(F.when(F.length("word") == 0, F.col("c")))).first()
    n_words, types, ends = n_words or 0, types or 0, ends or 0
    total = n_words + ends
    words = words.filter(F.length("word") > 0)

    lp = v.log_scores()
    for _ in range(rounds if types else 0):
        got = words.filter("c > 0").select("word", "c").mapInArrow(_expect(shared, lp), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        mass = np.where(np.isfinite(lp), 0.1, 0.0)
        for piece, n in got.collect():  # one row for each piece of the fixed vocabulary at most
            mass[piece] += n
        with np.errstate(divide="ignore"):
            lp = np.log(mass / mass.sum())

    known = total + 0.5 * ((types + (ends > 0)) + 1)
    log_end = math.log10((ends + 0.5) / (total + 1))
    log_word = math.log10((n_words + 0.5) / (total + 1))
    base_end = math.log10((ends + 0.5) / known)

    def score_words(batches):
        for batch in batches:
            names, c = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            logs = mixed = word_logs(shared.value, names, lp)
            if n_words:
                with np.errstate(divide="ignore"):
                    arc = np.log(np.maximum(c - discount, 0) / n_words)
                mixed = np.logaddexp(arc, logs + math.log(max(discount * types, 1e-9) / n_words))
            three = [np.log10((c + 0.5) / known), logs / math.log(10) + log_word, mixed / math.log(10) + log_word]
            yield pa.record_batch([*batch.columns, *map(pa.array, three)], names=["word", "c", "u", "b", "s", "x"])

    scored = materialize(words.mapInArrow(score_words, "word binary, c long, u long, b double, s double, x double"), "lm_scored")

    # the words used most, as many as are surely no more than hot_words
    size = F.floor(F.log2("u") * 8).cast("int")
    room, least = hot_words, None
    for bucket, n in scored.filter("u > 0").groupBy(size.alias("k")).count().orderBy(F.desc("k")).collect():  # 8 rows for each power of two
        room -= n
        if room < 0:
            break
        least = bucket
    hot = {} if least is None else {bytes(w): (k, b, s, x) for w, k, b, s, x in scored.filter((F.col("u") > 0) & (size >= least)).select("word", F.col("c") > 0, "b", "s", "x").collect()}
    hot_shared = spark.sparkContext.broadcast(hot)

    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType)] + [T.StructField(n, T.LongType()) for n in ("h", "rows", "n_tokens", "n_known")] + [T.StructField(n, T.DoubleType()) for n in ("b", "s", "x")] + [T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])

    def split(batches):
        known_words = hot_shared.value
        for batch in batches:
            ids = batch.column(0)
            rows, cols = [], [[] for _ in schema.names[1:]]
            for row, text in enumerate(texts(batch.column(1))):
                raw = text.encode().lower()
                mark = hash_of(raw)
                tokens, seen, base, score, mixed = 1, 0, 0.0, 0.0, 0.0
                for w, k in Counter(raw.split()).items():
                    tokens += k
                    got = known_words.get(w)
                    if got is None:
                        rows.append(row)
                        for c, x in zip(cols, (mark, 0, 0, 0, 0.0, 0.0, 0.0, w, k), strict=True):
                            c.append(x)
                    else:
                        seen += k * got[0]
                        base += k * got[1]
                        score += k * got[2]
                        mixed += k * got[3]
                rows.append(row)
                # the row's own word holds spaces, so it is no word
                for c, x in zip(cols, (mark, 1, tokens, seen, base, score, mixed, b" %d %d" % (mark, crc_text(ids[row].as_py())), 0), strict=True):
                    c.append(x)
                if len(rows) > 100_000:
                    yield table(ids, rows, cols)
                    rows, cols = [], [[] for _ in schema.names[1:]]
            yield table(ids, rows, cols)

    def table(ids, rows, cols):
        kinds = [pa.int64()] * 4 + [pa.float64()] * 3 + [pa.binary(), pa.int64()]
        return pa.record_batch([ids.take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=schema.names)

    def hash_of(raw: bytes) -> int:
        import xxhash

        return xxhash.xxh3_64_intdigest(raw) - (1 << 63)

    table_of = scored.select(F.col("word"), F.col("c").alias("wc"), F.col("b").alias("wb"), F.col("s").alias("ws"), F.col("x").alias("wx"))
    n, c = F.col("n"), F.coalesce("wc", F.lit(0))
    met = docs.mapInArrow(split, schema).join(table_of, "word", "left")
    done = met.groupBy("id", "h").agg(
        F.sum("rows").alias("m"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(c > 0, n).otherwise(0)).alias("n_known"),
        F.sum(F.col("b") + F.coalesce(n * F.col("wb"), F.lit(0.0))).alias("b"),
        F.sum(F.col("s") + F.coalesce(n * F.col("ws"), F.lit(0.0))).alias("s"),
        F.sum(F.col("x") + F.coalesce(n * F.col("wx"), F.lit(0.0))).alias("x"),
    )
    m = F.col("m")
    return done.select(
        F.col("id").alias(id_col),
        (F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % modulus == held_out).alias("held_out"),
        (F.col("n_tokens") / m).cast("long").alias("n_tokens"),
        (F.col("n_known") / m + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("b") / m + base_end).alias("base_score"),
        (F.col("s") / m + log_end).alias("score"),
        (F.col("x") / m + log_end).alias("mixed_score"),
        F.explode(F.sequence(F.lit(1), m.cast("int"))).alias("copy"),
    ).drop("copy")
