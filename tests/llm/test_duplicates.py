"""Near duplicates, neighbours and components against brute force."""

import math
import random

import numpy as np
import pytest

from tesserae.llm import components, hnsw, itq, minhash


def brute_components(nodes, linked):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, x) for x in range(2, 30)] + [(50, 50), (None, 3), (60, 61), (61, 60)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141))
    assert all(got[i] == 1 for i in range(1, 30))
    assert got[60] == got[61] == 60 and 50 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def make_documents(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(120)]
    docs = [" ".join(base)]
    for i in range(60):  # one large group, some of it near, some far
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        docs.append(" ".join(w))
    passage = " ".join(rng.choice(vocab) for _ in range(50))
    for i in range(40):
        docs.append(passage + " " + " ".join(rng.choice(vocab) for _ in range(60)))
    docs += [docs[-1].upper(), docs[-2] + " tail", "one two", "One  Two", "one", "", None, "   ", " ".join(["r"] * 3000)]
    return docs


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_match_brute_force(spark, width):
    docs = make_documents()
    sets = {}
    for i, t in enumerate(docs):
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if w else set()
    want = brute_components(list(sets), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    df = spark.createDataFrame([(i, t, 5, "v") for i, t in enumerate(docs)], "doc_id long, text string, n int, value string")
    got = minhash.near_duplicates(df, width=width).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    left = minhash.dedup_documents(df, width=width)
    assert left.columns == df.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, c in want.items() if i == c}


@pytest.mark.parametrize("k", [8, 20, 32, 64])
def test_least_shared_keeps_its_miss_rate(k):
    def below(t):
        return sum(math.comb(k, i) * 0.8**i * 0.2 ** (k - i) for i in range(t))

    t, miss = minhash.least_shared(k, 0.8, 4.5), math.erfc(4.5 / math.sqrt(2)) / 2
    assert below(t) <= miss < below(t + 1) or t == 1


def test_near_duplicates_edge_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = minhash.near_duplicates(df).collect()
    assert len(got) == 4
    assert {r["component_id"] for r in got if r["doc_id"] == 2} == {1}
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True]
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_documents_that_share_most_of_a_passage(spark, monkeypatch):
    """More of the words than a sketch tells apart, up to and beyond the limit."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    docs = []
    for own in (60, 16, 9):
        passage = [word() for _ in range(80)]
        docs += [" ".join(passage + [word() for _ in range(own)]) for _ in range(40)]
        docs += [docs[-1] + " x y", docs[-2] + " z"]
    sets = [{tuple(t.split()[a : a + 5]) for a in range(len(t.split()) - 4)} for t in docs]
    want = brute_components(list(range(len(docs))), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), small=4).collect()}
    assert got == want


def test_dedup_of_repeated_rows_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a, 1), (1, a, 1), (1, b, 2), (None, a, 3), (None, "own text of five words here", 4), (None, "own text of five words here", 4), (7, None, 5), (8, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, no int")
    got = minhash.dedup_documents(df)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, [df.filter("doc_id = 1 and no = 1").first(), df.filter("no = 2").first(), df.filter("no = 4").first(), df.filter("no = 5").first(), df.filter("no = 6").first()]))
    clash = df.withColumnRenamed("no", "__gone")
    assert minhash.dedup_documents(clash).columns == clash.columns


def vectors(n=300, d=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    for i in range(60, 120):
        x[i] = x[i % 7] + rng.standard_normal(d) * rng.choice([0.05, 0.1, 0.2])
    x[200] = x[201] = x[202]
    x[203] = x[204] * 3
    return x.astype(np.float32)


ODD = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [float("inf")] * 16), (1005, [1.0, None] + [0.0] * 14), (1006, [1.0, 2.0])]


def test_similar_vectors_match_brute_force(spark):
    x = vectors()
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)] + [(i, v, "b") for i, v in ODD]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, c string")
    got = {r["vec_id"]: r for r in itq.similar_vectors(df).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    link = (y @ y.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    want = brute_components(list(range(len(x))), lambda a, b: bool(link[a, b]))
    assert len(got) == len(rows)
    assert {i: got[i]["component_id"] for i in range(len(x))} == want
    assert [got[i]["n_links"] for i in range(len(x))] == link.sum(1).tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] and got[i]["component_id"] == i for i, _ in ODD)
    assert itq.similar_vectors(df.limit(0)).collect() == []


def test_similar_vectors_with_a_common_direction(spark):
    rng = np.random.default_rng(4)
    n, d = 500, 64
    common = np.eye(d)[0]

    def at_right_angles(*others):
        x = rng.standard_normal(d)
        for o in others:
            x -= (x @ o) * o
        return x / np.linalg.norm(x)

    rows = []
    for i in range(n):  # pairs just within the limit
        own = at_right_angles(common)
        x = 0.9 * common + np.sqrt(1 - 0.81) * own
        y = 0.9505 * x + np.sqrt(1 - 0.9505**2) * at_right_angles(x)
        rows += [(2 * i, x.tolist()), (2 * i + 1, y.tolist())]
    x = np.array([r[1] for r in rows])
    want = (x @ x.T >= 0.95).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in itq.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert want.min() >= 1 and [got[i] for i in range(2 * n)] == want.tolist()


def test_components_that_do_not_end_raise(spark):
    with pytest.raises(RuntimeError):
        components.components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"), max_rounds=1).collect()


def test_vectors_that_share_an_id(spark):
    rows = [(5, [1.0, 0.0]), (6, [1.0, 0.05]), (5, [0.0, 1.0]), (7, [0.05, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, n string, c int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in itq.similar_vectors(df).collect())
    assert got == [(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False)]


def test_first_met_is_what_the_keys_say():
    rng = np.random.default_rng(0)
    for bits, tables in ((8, 21), (6, 25), (13, 9), (16, 4)):
        lay = itq.Layout(bits, tables)
        b = rng.random((60, tables * bits)) < 0.5
        b[30:] = b[:30] ^ (rng.random((30, tables * bits)) < 0.1)
        words, keys = lay.pack(b)
        far = (b[:, None] != b[None]).sum(2)
        agree = keys[:, None] == keys[None]
        for t in range(tables):
            want = (far <= tables * bits // 4) & ~agree[:, :, :t].any(2)
            assert (lay.first_met(words, words, t, tables * bits // 4) == want).all()


def test_similar_vectors_in_large_groups(spark, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK", 16)
    monkeypatch.setattr(itq, "TILE", 8)
    rng = np.random.default_rng(0)
    x = np.r_[rng.standard_normal(8) + rng.standard_normal((80, 8)) * 0.02, rng.standard_normal((30, 8))].astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in itq.similar_vectors(df).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert [got[i] for i in range(len(x))] == ((y @ y.T >= 0.95).sum(1) - 1).tolist()


def test_graphs_of_many_levels_find_most_neighbours():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16))
    levels = hnsw.build(x, degree=8)
    assert len(levels) >= 3 and [len(r) for r, _ in levels] == sorted(len(r) for r, _ in levels) and len(levels[-1][0]) == 3000
    assert all(links.shape[0] == len(rows) for rows, links in levels)
    queries = rng.standard_normal((100, 16))
    found, _ = hnsw.search(x, *hnsw.opened(levels, len(x)), queries, 100)
    want = np.argsort(((x[None] - queries[:, None]) ** 2).sum(2), 1)[:, :10]
    assert np.mean([len(set(f[:10]) & set(w)) for f, w in zip(found.tolist(), want.tolist(), strict=True)]) >= 9.5


def test_neighbours_recall_ties_and_odd_rows(spark):
    x = vectors(1200)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(i * 100, v, 0) for i, v in ODD]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in hnsw.nearest_neighbours(df, shard_size=150).collect():  # eight shards
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    y, hits, total = x.astype(float), 0, 0
    assert set(got) == set(range(0, 1200, 100))
    for q, found in got.items():
        found.sort()
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(d)), d))[:10]
        hits += len(set(want.tolist()) & {v for _, v, _ in found})
        total += 10
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        assert all(s == pytest.approx(d[v]) for _, v, s in found)
    assert hits >= 0.9 * total
    assert {v for _, v, _ in got[200]} >= {201, 202}  # equal vectors
    twice = spark.createDataFrame([(0, [1.0, 2.0]), (0, [5.0, 5.0]), (7, [1.0, 2.5])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in hnsw.nearest_neighbours(twice).collect())
    assert got == sorted([(0, 1, 7, 0.5), (0, 2, 0, 5.0), (0, 1, 7, round(math.hypot(4, 2.5), 6)), (0, 2, 0, 5.0)])
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["rank"]) for r in hnsw.nearest_neighbours(few).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert hnsw.nearest_neighbours(few.limit(0)).collect() == []
