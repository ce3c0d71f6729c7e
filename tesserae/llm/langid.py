"""Language identification by unigram pieces, all segmentations summed.

Each language has a probability for every piece of a fixed public vocabulary.
They are learnt from the training texts' word counts: the posterior of each
piece over all segmentations of each word (forward-backward with the
vocabulary's own scores), times the word's count in each language.  A text's log
likelihood under a language is the sum over its words of the forward recursion
over all their segmentations; the prior is the language's share of documents.

Words are maximal runs of letters, lower-cased.  ``score`` is the posterior of
the predicted language.  A null text, or one without letters, is ``und`` with
score 0; so is every text if nothing was learnt.  Ties go to the language that
sorts first.  A null id counts as '' where texts are held out; rows that repeat an
id are each predicted, and each teaches.  A text is read whole, however long; other
columns are ignored.

Scale: word counts are pre-aggregated before their shuffle; learnt pieces are
bounded by vocabulary times languages (at most ``max_languages``, else an error
says so).  Scoring is one pass without a shuffle; each worker keeps the scores
of a bounded number of words.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pieces as P
from .lm_score import BATCH, HELD, word_logs
from .shared import crc_text, slices, texts

LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: Distinct words whose scores a worker keeps between batches.
KEPT = 400_000
_cache: dict[str, tuple[dict[str, int], np.ndarray]] = {}


def words_of(text: str) -> Counter:
    bag = Counter(LETTERS.findall(text.lower()))
    for w in [w for w in bag if not w.isalpha()]:  # numerals that aren't decimal digits
        n = bag.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            bag[part] += n
    return bag


def _count(modulus: int, remainder: int):
    def run(batches):
        held: Counter = Counter()

        def out():
            keys = list(held)
            return pa.record_batch({"lang": pa.array([k[0] for k in keys], pa.string()), "word": pa.array([k[1] for k in keys], pa.string()), "n": pa.array([held[k] for k in keys], pa.int64())})

        for batch in batches:
            for i, text, lang in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if lang is None or crc_text(i) % modulus == remainder:
                    continue
                held[lang, ""] += 1  # the document itself
                for w, k in words_of(text).items():
                    held[lang, w] += k
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    return run


def _expect(shared, lp, place):
    def run(batches):
        v, mark = shared.value, P.MARK.encode()
        total = np.zeros((len(place), len(lp)))
        for batch in batches:
            lang = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            n = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            marked = [mark + w.encode() for w in batch.column(1).to_pylist()]
            for idx in P.by_length(marked, BATCH):
                x = P.lattice(v, *P.pack([marked[i] for i in idx]), True)
                weight = P.expected(x, lp) * n[idx][x.text]
                total += np.bincount(lang[idx][x.text] * len(lp) + x.piece, weight, total.size).reshape(total.shape)
        row, piece = np.nonzero(total)
        yield pa.record_batch({"row": pa.array(row, pa.int32()), "piece": pa.array(piece, pa.int32()), "n": pa.array(total[row, piece])})

    return run


def language_id(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    vocabulary: str | P.Vocabulary = P.DEFAULT_VOCABULARY,
    modulus: int = 3,
    held_out: int = 1,
    smoothing: float = 0.5,
    max_languages: int = 400,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    import uuid

    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    v = P.Vocabulary.load(vocabulary) if isinstance(vocabulary, str) else vocabulary
    shared = spark.sparkContext.broadcast(v)
    from .shared import materialize

    counts = materialize(docs.filter("lang is not null").mapInArrow(_count(modulus, held_out), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lid_words")
    langs = counts.filter("word = ''").select("lang", "n").orderBy("lang").limit(max_languages + 1).collect()
    if len(langs) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    names = [r[0] for r in langs]
    prior = np.log(np.array([r[1] for r in langs], float) / max(1, sum(r[1] for r in langs)))
    lp0 = v.log_scores()
    lp = np.zeros((len(lp0), len(names)))
    if names:
        got = counts.filter("word <> ''").mapInArrow(_expect(shared, lp0, {x: i for i, x in enumerate(names)}), "row int, piece int, n double").groupBy("row", "piece").agg(F.sum("n").alias("n")).toPandas()  # pieces x languages at most
        mass = np.where(np.isfinite(lp0), smoothing, 0.0)[:, None].repeat(len(names), 1)
        mass[got["piece"], got["row"]] += got["n"]
        with np.errstate(divide="ignore"):
            lp = np.log(mass / mass.sum(0))
    model = spark.sparkContext.broadcast(lp)
    key = uuid.uuid4().hex

    def run(batches):
        if key not in _cache:
            _cache.clear()
            _cache[key] = ({}, np.zeros((0, len(names))))
        for batch in slices(batches, limit=16 << 20):
            place, logs = _cache[key]
            ids = batch.column(0).to_pylist()
            bags = [words_of(x) for x in texts(batch.column(1))]
            used = {w for bag in bags for w in bag} if names else set()
            new = sorted(used.difference(place))
            if len(place) + len(new) > KEPT:  # words that came before and came again stay
                old = [w for w in place if w in used]
                logs, place = logs[[place[w] for w in old]], {w: i for i, w in enumerate(old)}
            if new:
                first = len(place)
                place.update((w, first + i) for i, w in enumerate(new))
                logs = np.concatenate([logs, word_logs(shared.value, [w.encode() for w in new], model.value)])
            _cache[key] = (place, logs)
            pred, score = [], []
            for bag in bags:
                if not bag or not names:
                    pred.append(UNDETERMINED), score.append(0.0)
                    continue
                log = prior + np.fromiter(bag.values(), float, len(bag)) @ logs[[place[w] for w in bag]]
                log = log - log.max()
                best = int(log.argmax())
                pred.append(names[best]), score.append(float(1 / np.exp(log).sum()))
            yield pa.record_batch([batch.column(0), pa.array([crc_text(i) % modulus == held_out for i in ids], pa.bool_()), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    schema = T.StructType([T.StructField(id_col, docs.schema["id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select("id", "text").mapInArrow(run, schema)
