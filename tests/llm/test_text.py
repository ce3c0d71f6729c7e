"""Scoring, languages, encoding: against brute force on small texts."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import codec, langid, lm_score, shared
from tesserae.llm import pieces as P

TEXTS = ["The the THE of", "", None, "  of\tthe\nend ", "naïve café 日本 the", "x" * 5000, "The the THE of", "unseenword the of"]


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary.load()


def small_vocabulary():
    names = ["<unk>", "▁", "▁a", "b", "ab", "▁ab", "a", "ba"] + [f"<0x{i:02X}>" for i in range(256)]
    kinds = [P.UNKNOWN] + [P.NORMAL] * 7 + [P.BYTE] * 256
    return P.Vocabulary.of(names, [0.0, -1.0, -2.0, -2.5, -3.0, -3.5, -1.5, -4.0] + [0.0] * 256, kinds)


def all_paths(v, raw, byte_edges):
    """Every segmentation of raw as a list of piece ids."""
    if not raw:
        return [[]]
    out = []
    for i, p in enumerate(v.pieces):
        if v.kinds[i] == P.NORMAL and raw.startswith(p):
            out += [[i, *rest] for rest in all_paths(v, raw[len(p) :], byte_edges)]
    if byte_edges:
        out += [[int(v.byte_ids[raw[0]]), *rest] for rest in all_paths(v, raw[1:], byte_edges)]
    return out


def test_trie_holds_every_piece_and_nothing_else(vocabulary):
    t = vocabulary.trie
    for i in list(range(259, 2000)) + list(range(31000, 32000)):
        state = 0
        for b in vocabulary.pieces[i]:
            nxt = t.base[state] + b
            assert t.check[nxt] == state
            state = nxt
        assert t.value[state] == i


def test_forward_sums_all_segmentations():
    v = small_vocabulary()
    lp = v.log_scores()
    words = [b"\xe2\x96\x81ab", b"\xe2\x96\x81abba", b"\xe2\x96\x81", b"\xe2\x96\x81zab"]
    got = P.marginals(P.lattice(v, *P.pack(words), True), lp)
    for w, g in zip(words, got, strict=True):
        want = np.logaddexp.reduce([lp[p].sum() for p in all_paths(v, w, True)])
        assert g == pytest.approx(want)
    two = P.marginals(P.lattice(v, *P.pack(words), True), np.stack([lp, lp - 1], 1))
    assert two[:, 0] == pytest.approx(got)


def test_expected_counts_are_posteriors():
    v = small_vocabulary()
    lp = v.log_scores()
    word = b"\xe2\x96\x81abab"
    x = P.lattice(v, *P.pack([word]), True)
    got = np.bincount(x.piece, P.expected(x, lp), len(lp))
    want = np.zeros(len(lp))
    paths = all_paths(v, word, True)
    weight = np.exp([lp[p].sum() for p in paths])
    for p, w in zip(paths, weight / weight.sum(), strict=True):
        np.add.at(want, p, w)
    assert got == pytest.approx(want)


def test_word_hashes_follow_words():
    texts = ["A b\tc", "", "a  B", "\n", "abc", "a b c abc"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    off = np.r_[0, np.cumsum([len(r) for r in raw])]
    h, w = shared.word_hashes(data, off)
    words = [x for r in raw for x in r.lower().split()]
    assert list(np.diff(w)) == [len(r.split()) for r in raw]
    assert len({(a, b) for a, b in zip(words, h.tolist(), strict=True)}) == len(set(words)) == len(set(h.tolist()))


def test_lm_score_matches_counts_and_repeats_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x"), (None, "the", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = lm_score.lm_score(df, hot_words=2).collect()
    assert len(got) == len(rows)
    train = collections.Counter()
    ends = 0
    for i, t, _ in rows:
        if shared.crc_text(i) % 5 != 1:
            train.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(train.values()) + ends, len(train) + 1
    by_id = {r["doc_id"]: r for r in got}
    for i, t, _ in rows:
        words = (t or "").encode().lower().split()
        r = by_id[i]
        assert r["train_tokens"] == n and r["n_tokens"] == len(words) + 1
        assert r["n_known"] == sum(w in train for w in words) + 1
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        assert r["base_score"] == pytest.approx(base)
        assert -1e9 < r["score"] < 0
        assert r["held_out"] == (shared.crc_text(i) % 5 == 1)
    cold = {r["doc_id"]: r["score"] for r in lm_score.lm_score(df, hot_words=0).collect()}
    for i, s in cold.items():
        assert s == pytest.approx(by_id[i]["score"])


def test_lm_score_is_the_sum_over_all_segmentations(spark):
    v = small_vocabulary()
    rows = [(i, t) for i, t in enumerate(["ab ba abba", "a ab ab", "Bab", "", None, "b z", "ab"])]
    train = collections.Counter(w for i, t in rows if shared.crc_text(i) % 5 != 1 for w in (t or "").lower().encode().split())
    ends = sum(shared.crc_text(i) % 5 != 1 for i, _ in rows)
    n = sum(train.values())
    mark, lp = P.MARK.encode(), v.log_scores()
    for _ in range(4):
        mass = np.where(np.isfinite(lp), 0.1, 0.0)
        for w, c in train.items():
            paths = all_paths(v, mark + w, True)
            weight = np.exp([lp[p].sum() for p in paths])
            for p, x in zip(paths, weight / weight.sum(), strict=True):
                np.add.at(mass, p, c * x)
        with np.errstate(divide="ignore"):
            lp = np.log(mass / mass.sum())
    log = lambda w: np.logaddexp.reduce([lp[p].sum() for p in all_paths(v, mark + w, True)])
    word, end = math.log10((n + 0.5) / (n + ends + 1)), math.log10((ends + 0.5) / (n + ends + 1))
    for r in lm_score.lm_score(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary=v, hot_words=3).collect():
        words = (rows[r["doc_id"]][1] or "").lower().encode().split()
        assert r["score"] == pytest.approx(sum(log(w) / math.log(10) + word for w in words) + end)
        mixed = [math.log10((max(train[w] - 0.75, 0) + 0.75 * len(train) * math.exp(log(w))) / n) + word for w in words]
        assert r["mixed_score"] == pytest.approx(sum(mixed) + end)


@pytest.mark.parametrize("operator", [lm_score.lm_score, langid.language_id, codec.encode_documents])
def test_long_texts_repeated_rows_and_clashing_columns(spark, operator):
    long = "the cat and the dog " * 60_000 + "y" * 20_000
    rows = [(1, long, "en", 1), (2, "das haus", "de", 2), (2, "das haus", "de", 2), (None, "das haus", "de", 3), (3, None, "en", 4), (4, "", None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, word int").withColumn("score", F.lit("x")).withColumn("id", F.lit(9))
    got = operator(df).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    twice = [r for r in got if r["doc_id"] == 2]
    assert twice[0] == twice[1]
    if operator is lm_score.lm_score:
        assert next(r["n_tokens"] for r in got if r["doc_id"] == 1) == 300_002
    if operator is codec.encode_documents:
        assert next(r["decoded"] for r in got if r["doc_id"] == 1) == long


def test_lm_score_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.lm_score(df).collect() == []
    one = spark.createDataFrame([(7, "a b")], "doc_id long, text string")  # crc32("7") % 5
    assert lm_score.lm_score(one, held_out=shared.crc_text(7) % 5).first()["train_tokens"] == 0


def test_language_id_learns_and_keeps_und(spark):
    en, de = "the house and the garden with water", "das haus und der garten mit wasser für"
    rows = [(i, (en if i % 2 else de) + f" {i}", "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, None, "en"), (101, "123 !!", "de"), (102, "the garden", None), (103, "", None)]
    got = {r["doc_id"]: r for r in langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(40))
    assert got[102]["lang_pred"] == "en" and 0.5 < got[102]["score"] <= 1
    assert {got[i]["lang_pred"] for i in (100, 101, 103)} == {"und"}
    assert langid.language_id(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
    none = langid.language_id(spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")).first()
    assert none["lang_pred"] == "und"


def test_language_posterior_matches_brute_force(spark):
    v = small_vocabulary()
    rows = [(i, t, lg) for i, (t, lg) in enumerate([("ab abba", "x"), ("ba b", "y"), ("a ab", "x"), ("bb ba", "y"), ("AB b", None), ("b", "y"), ("ab1ab", "x"), ("ba", "x")])]
    train = [(t.lower(), lg) for i, t, lg in rows if lg and shared.crc_text(i) % 3 != 1]
    names = sorted({lg for _, lg in train})
    lp0, mark = v.log_scores(), P.MARK.encode()
    split = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).encode().split()
    mass = np.where(np.isfinite(lp0), 0.5, 0.0)[:, None].repeat(len(names), 1)
    for t, lg in train:
        for w in split(t):
            paths = all_paths(v, mark + w, True)
            weight = np.exp([lp0[p].sum() for p in paths])
            for p, x in zip(paths, weight / weight.sum(), strict=True):
                np.add.at(mass[:, names.index(lg)], p, x)
    with np.errstate(divide="ignore"):
        lp = np.log(mass / mass.sum(0))
    prior = np.log([sum(lg == x for _, lg in train) / len(train) for x in names])
    for r in langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), vocabulary=v).collect():
        log = prior + sum(np.array([np.logaddexp.reduce([lp[p, k].sum() for p in all_paths(v, mark + w, True)]) for k in range(len(names))]) for w in split(rows[r["doc_id"]][1]))
        p = np.exp(log - np.logaddexp.reduce(log))
        assert r["lang_pred"] == names[int(p.argmax())] and r["score"] == pytest.approx(p.max())


def test_viterbi_finds_the_best_path():
    v = small_vocabulary()
    for raw in (b"\xe2\x96\x81ab", b"\xe2\x96\x81abba", b"\xe2\x96\x81bbaab"):
        got = codec.best_paths(v, v.scores, [raw])[0]
        assert v.scores[got].sum() == pytest.approx(max(v.scores[p].sum() for p in all_paths(v, raw, False)))
        assert b"".join(v.pieces[i] for i in got) == raw


@pytest.mark.parametrize("scores", ["zipf", "file"])
def test_encoded_documents_take_the_best_segmentations(spark, scores):
    v = small_vocabulary()
    lp = v.log_scores() if scores == "zipf" else v.scores
    texts = ["ab abba", "a", "ba ab a b", "abab  ba"]
    got = codec.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocabulary=v, scores=scores).collect()
    for r in got:
        raw = codec.marked(texts[r["doc_id"]])
        raw = raw if isinstance(raw, bytes) else raw.encode()
        assert b"".join(v.pieces[i] for i in r["ids"]) == raw
        assert lp[r["ids"]].sum() == pytest.approx(max(lp[p].sum() for p in all_paths(v, raw, False)))
        assert r["n_pieces"] == len(r["ids"]) and r["n_byte_pieces"] == 0 and r["decoded"] == texts[r["doc_id"]]


def test_paths_agree_with_the_public_library(vocabulary):
    spm = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    with open(P.DEFAULT_VOCABULARY, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    m = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
    words = ["hello", "thondedle", "café", "日本語", "\U0001f600x", "Straße", "a.b,c"]
    cut = codec.chunker(vocabulary)
    for w in words:
        got = [i for c in cut(codec.marked(w)) for i in codec.best_paths(vocabulary, vocabulary.scores, [c])[0]]
        assert got == m.encode(w)


def test_encoding_round_trips(spark, vocabulary):
    texts = [*TEXTS, "a   b", " lead and trail ", "▁ literal ▁", "\x00\x01", "ἡ\U0001f600", "   "]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r for r in codec.encode_documents(df).collect()}
    for i, t in enumerate(texts):
        assert got[i]["decoded"] == t
        assert (got[i]["ids"] is None) == (t is None)
    assert codec.encode_documents(df.limit(0)).collect() == []
    assert {r["decoded"] for r in codec.encode_documents(df, scores="file").collect()} == set(texts)
