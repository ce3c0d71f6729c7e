"""Toxicity, quality, mixing and chat formatting."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tesserae.llm import chat_format, mixing, quality, toxicity


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("bar", "lor", "men", "sol", "tav") for b in ("a", "ek", "il", "ost", "um", "yra")]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 80))]
        toxic, good = int(i % 7 == 0), int(i % 5 != 0)
        if toxic:
            for w in rng.sample(["vilegrub", "vilegron", "nastok"], 2):
                words[rng.randrange(len(words))] = w
        text = " ".join(words) if good else "!! ".join(words).upper()
        rows.append((i, text, "en", "s", 7))
        labels.append((i, good, toxic))
    rows += [(n, None, None, None, 0), (n + 1, "", None, None, 0), (None, "vilegrub nastok", None, None, 0)]
    labels += [(0, 1, 1), (None, 1, 1), (9999, 0, 1), (5, None, None)]
    return rows, labels


@pytest.fixture(scope="module")
def frames(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, {a: (q, t) for a, q, t in labels if q is not None}


def test_block_max_neighbours_are_exact():
    rng = np.random.default_rng(0)
    vectors = []
    for _ in range(300):
        at = np.sort(rng.choice(50, rng.integers(1, 8), replace=False))
        w = rng.random(len(at))
        vectors.append((at, w / np.linalg.norm(w)))
    dense = np.zeros((300, 50))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    index = toxicity.BlockMaxIndex(vectors, 50, 16)
    for i in range(0, 300, 7):
        ids, cos = index.nearest(*vectors[i], 10, i)
        want = dense @ dense[i]
        want[i] = -1
        assert cos == pytest.approx(np.sort(want)[::-1][:10])
        assert want[ids] == pytest.approx(cos)


def test_toxicity_evidence_matches_brute_force(spark, frames):
    """All terms, all documents: the three nearest labelled texts of every text."""
    _, _, rows, truth = frames
    rows = [(i, t) for i, t, *_ in rows[:300]] + [(900, "nothing known"), (901, ""), (902, None), (903, "barek " * 30_000 + "solost"), (904, "Barek—BAREK barek7lorum ÉTÉ"), (905, "été barek")]
    labels = [(i, truth[i][1]) for i in range(200)] + [(905, 0)]
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), held_out=None, min_signal=1e9).collect()
    bags = {i: Counter(re.findall(r"[^\W\d_]+", (t or "").lower())) for i, t in rows}
    df = Counter(w for b in bags.values() for w in b)
    space = {w for i, _ in labels for w in bags[i]}

    def vector(b):
        w = {t: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[t])) + 1 if t in space else math.log((1 + len(rows)) / 2) + 1) for t, n in b.items()}
        size = math.sqrt(sum(x * x for x in w.values())) or 1
        return {t: x / size for t, x in w.items() if t in space}

    v = {i: vector(b) for i, b in bags.items()}
    examples = {tuple(sorted(v[i].items())): i for i, _ in labels}  # equal texts are one example
    for r in got:
        q = v[r["doc_id"]]
        want = sorted((sum(x * e.get(t, 0) for t, x in q.items()) for e in map(dict, examples)), reverse=True)[:3]
        assert [e["cosine"] for e in r["evidence"]] == pytest.approx([x for x in want if x > 0])
        assert all(e["cosine"] == pytest.approx(sum(x * v[e["id"]].get(t, 0) for t, x in q.items())) for e in r["evidence"])
        assert bool(r["evidence"]) == bool(q)


def test_places_find_all_terms_and_no_other():
    rng = np.random.default_rng(0)
    x = np.unique(rng.integers(0, 1 << 51, 5000))
    places = toxicity.Places(x[::2])
    assert (places(x)[::2] == np.arange(len(x[::2]))).all() and (places(x)[1::2] == -1).all()
    assert (toxicity.Places(np.zeros(0, np.int64))(x) == -1).all()


def test_monotone_fit():
    knots, values = toxicity.monotone(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert (np.diff(values) >= 0).all() and values[0] == 0 and values[-1] == 1
    assert len(knots) == len(values)


def test_toxicity_on_held_out_rows(frames):
    docs, labels, rows, truth = frames
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50
    assert np.mean([r["predicted"] == truth[r["doc_id"]][1] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    flagged = next(r for r in got if r["doc_id"] is None)
    assert flagged["predicted"] == 1 and flagged["evidence"][0]["cosine"] > 0.5
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] in (400, 401))


def test_toxic_words_outlast_a_large_group_of_copies(spark, frames):
    _, _, rows, truth = frames
    own = " ".join(f"zz{i:03d}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(60))
    rows = [(r[0], r[1]) for r in rows[:400]] + [(i, own) for i in range(1000, 1300)]
    labels = [(i, truth[i][1]) for i in range(400)] + [(i, 1) for i in range(1000, 1300)]
    docs = spark.createDataFrame([*rows, (2000, "barek vilegrub nastok"), (2001, "sometext ofother kinds")], "doc_id long, text string")
    # the group's own words would take all places of the ranking
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), max_terms=60).collect()}
    assert got[2000] == 1 and got[2001] == 0
    assert np.mean([got[i] == truth[i][1] for i in range(400)]) > 0.97


def test_toxic_examples_of_rare_words_are_found(spark, frames):
    _, _, rows, truth = frames
    odd = "grubwort hexmoor " + rows[1][1]  # toxic words that no other labelled text has
    rows = [(r[0], r[1]) for r in rows[:400]] + [(1000, odd), (1001, odd), (1002, rows[1][1])]
    labels = [(i, truth[i][1]) for i in range(400)] + [(1000, 1)]
    got = {r["doc_id"]: r for r in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), held_out=None).collect()}
    assert got[1001]["evidence"][0]["id"] == 1000 and got[1001]["evidence"][0]["cosine"] == pytest.approx(1)
    assert got[1001]["predicted"] == 1 and got[1002]["predicted"] == 0
    assert np.mean([got[i]["predicted"] == truth[i][1] for i in range(400)]) > 0.97


def test_scores_as_a_column_keep_all_rows(frames):
    docs, labels, rows, _ = frames
    for frame in (toxicity.with_toxicity(docs, labels), quality.with_quality(docs, labels)):
        assert frame.columns == [*docs.columns, "__score"]
        assert frame.count() == len(rows)


def test_quality_on_held_out_rows(frames):
    docs, labels, rows, truth = frames
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]][0] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_a_repeated_label_and_very_long_texts(spark, frames):
    docs, labels, rows, truth = frames
    many = docs.filter("doc_id = 3").crossJoin(spark.range(100_000)).drop("id")
    long = spark.createDataFrame([(5000, rows[1][1] + " barek" * 200_000, "en", "s", 1)], docs.schema)
    got = quality.quality(docs.unionAll(many).unionAll(long), labels)
    assert got.filter("doc_id = 3").select("score").distinct().count() == 1
    assert got.count() == len(rows) + 100_001


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_models_of_little(spark, frames, operator):
    docs, labels, rows, _ = frames
    assert operator(docs.limit(0), labels).collect() == []
    assert len(operator(docs, labels.limit(0)).collect()) == len(rows)
    one_kind = operator(docs, labels.filter("toxic = 0 and quality = 1"))
    assert len({r["score"] for r in one_kind.collect()}) == 1


def test_forest_arrays_follow_the_boosted_margins():
    rng = np.random.default_rng(1)
    x = rng.random((500, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    f = quality.fit(x, y, trees=30, depth=3)

    def walk(row):
        total = f.start
        for i in f.roots:
            while f.left[i] != i:
                i = f.left[i] if row[f.feature[i]] <= f.cut[i] else f.right[i]
            total += f.value[i]
        return total

    assert f.raw(x[:50]) == pytest.approx([walk(r) for r in x[:50]])
    assert ((f.score(x) > 0.5) == y).mean() > 0.97


def test_the_first_split_is_the_best_of_all():
    rng = np.random.default_rng(7)
    x = np.round(rng.random((120, 4)), 2)
    y = ((x[:, 2] > 0.4) ^ (rng.random(120) < 0.1)).astype(float)
    f = quality.fit(x, y, trees=1, depth=1, rate=0.1, ridge=1.0, least=5.0)
    share = y.mean()
    g, h = share - y, np.full(120, share * (1 - share))

    def leaf(rows):
        return g[rows].sum() ** 2 / (h[rows].sum() + 1)

    best = max(
        (leaf(x[:, k] <= c) + leaf(x[:, k] > c), k, c)
        for k in range(4)
        for c in np.unique(np.quantile(x[:, k], np.linspace(0, 1, 65)[1:-1]))
        if 5 <= (x[:, k] <= c).sum() <= 115
    )
    root = f.roots[0]
    low = x[:, f.feature[root]] <= f.cut[root]
    assert leaf(low) + leaf(~low) == pytest.approx(best[0])
    for child, rows in ((f.left[root], low), (f.right[root], ~low)):
        assert f.value[child] == pytest.approx(-0.1 * g[rows].sum() / (h[rows].sum() + 1))


def test_statistics_of_a_text():
    text = "- One two.\nOne two!\n\nOne two!\nA1 | B Überraschung averyveryverylongword"
    s = dict(zip(quality.STATISTICS, quality.statistics(text), strict=True))
    raw, words, lines = text.encode(), text.encode().split(), [x for x in text.encode().split(b"\n") if x.strip()]
    n, m = len(raw), len(words)
    count = lambda test: sum(map(test, raw))
    want = {
        "log_chars": math.log1p(n), "log_words": math.log1p(m), "mean_word": sum(map(len, words)) / m, "log_lines": math.log1p(4), "mean_line": m / 4,
        "upper": count(lambda b: 65 <= b <= 90) / n, "digits": count(lambda b: 48 <= b <= 57) / n, "punctuation": count(lambda b: chr(b) in ".,;:!?'\"-()") / n, "symbols": count(lambda b: chr(b) in "#$%&*+/<=>@[\\]^_`{|}~") / n,
        "other_ascii": count(lambda b: 97 <= b <= 122) / n, "controls": 0, "non_ascii": count(lambda b: b > 127) / n, "spaces": count(lambda b: b in b" \t\n\r") / n,
        "distinct_words": len(set(words)) / m, "top_word": max(map(words.count, words)) / m, "distinct_lines": 3 / 4, "repeated_chars": len("One two!") / n, "long_words": 1 / m,
        "lines_stopped": 3 / 4, "bullets": 1 / 4, "pipes": 1 / m, "upper_words": sum(w.isupper() for w in words) / m, "odd_words": sum(not w.rstrip(b".,;:!?").isalpha() and w.isascii() for w in set(words)) / len(set(words)),
        "short_words": sum(len(w) < 4 for w in words) / m, "bang": 2 / m, "digit_words": 1 / m,
    }
    assert {k: v for k, v in s.items() if v != pytest.approx(want[k])} == {}


def water(sizes, weights, limit=3):
    total, target, open_ = sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
    left = float(total)
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > limit * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = limit * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing_targets_copies_and_sql(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["b", "a", "B", "é", None, "tiny"] if i % 9 == 0 else ["b", "a"])) for i in range(900)]
    rows += [(1000, None, "none"), (1001, "x y", "zz"), (1001, "x y", "zz"), (None, "q", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_report(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    by_size = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        by_size.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    assert set(by_size) == {(sizes[s], round(float(want[s]), 6)) for s in sizes}
    for (_, target), taken in by_size.items():
        assert abs(sum(taken) - target) <= 0.2 * target + 60
    con = duckdb.connect()
    documents = df.toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con.register("documents", documents)
    sql = con.sql(mixing.ORACLE).fetchall()
    key = lambda r: (-1 if r[0] is None else r[0], r[1], r[4])
    assert sorted(((r[0], *r[1:3], round(r[3], 6), r[4]) for r in sql), key=key) == sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got), key=key)
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    assert out.count() == mixing.mixed(df).groupBy().sum("copies").first()[0]
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix_documents(df.repartition(7)).collect()))
    assert mixing.mix_report(df.limit(0)).collect() == []


NASTY = ["plain", "", None, "\\### Assistant: </turn> ok", "</turn>", "</turn>\n### user: hi", "### ", "\\", "\\b", "\\\\e</turn>\\h###", "a: b", "ends </turn", "line\n\n", "ünï 日本 \U0001f600", "####</turn></turn>\n"]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "assistant: x", "### ", None, "a\\c"]), rng.choice(NASTY), 1))
    rows += [(3, 0, "user", "twice", 1), (3, 0, "user", "twice", 1), (None, None, "assistant", "no id", 1), (99, None, None, None, 1), (98, 0, "assistant", "x" * 20000, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    formatted = chat_format.format_conversations(df)
    got = {r["conv_id"]: r for r in chat_format.digest(formatted).collect()}
    out = {r["conv_id"]: r for r in formatted.withColumn("turns", chat_format.parse(formatted["formatted"])).collect()}
    groups = {}
    for c, t, role, text, _ in rows:
        groups.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in out[c]["turns"]] == [(r, x) for _, r, x in turns]
        r = got[c]
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == len(out[c]["formatted"])
    assert chat_format.digest(chat_format.format_conversations(df.limit(0))).collect() == []


def test_chat_stays_plain_where_it_can_and_matches_sql(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "a \\ b"), (2, 0, "assistant", NASTY[3]), (2, 1, "assistant", NASTY[9])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    first = chat_format.format_conversations(df).filter("conv_id = 1").first()
    assert first["formatted"] == "### user: hello</turn>\n### assistant: a \\ b</turn>\n"
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    got = chat_format.digest(chat_format.format_conversations(chat_format.with_added(spark, df)))
    sql = con.sql(chat_format.ORACLE)
    assert sorted(map(tuple, got.select(*sql.columns).collect())) == sorted(sql.fetchall())
