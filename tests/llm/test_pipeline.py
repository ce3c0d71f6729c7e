"""The pipeline, stage by stage, against plain Python on a small corpus."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    vocab = [f"{a}{b}" for a in ("bar", "lor", "men", "sol", "tav", "kip") for b in ("a", "ek", "il", "ost", "um", "yra", "on")]
    rows, labels = [], []
    for i in range(300):
        words = [rng.choice(vocab) for _ in range(rng.randint(30, 80))]
        toxic, good = int(i % 6 == 0), int(i % 5 != 0)
        if toxic:
            for w in rng.sample(["vilegrub", "vilegron", "nastok"], 2):
                words[rng.randrange(len(words))] = w
        text = " ".join(words) if good else "!! ".join(words).upper()
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, good, toxic))
    clean = [r for r in rows if r[0] % 6 and r[0] % 5]
    rows += [(1000 + i, r[1] + " x" * (i % 2), "en", "s0", 1) for i, r in enumerate(clean[:20])]  # exact and near copies
    rows += [(2000, None, None, None, None)]
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), rows, {a: (q, t) for a, q, t in labels}


def test_stages_and_run(spark, folder):
    d, rows, labels = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] and len(pipeline.STAGES) == 5
    kept = []
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append(docs.collect())
    ids = [{r["doc_id"] for r in k} for k in kept]
    everything = {r[0] for r in rows}
    toxic = {i for i, (_, t) in labels.items() if t}
    assert everything - ids[0] == toxic
    poor = {i for i, (q, _) in labels.items() if not q} & ids[0]
    assert poor <= ids[0] - ids[1] <= poor | {2000}

    def shingles(t):
        w = (t or "").lower().split()
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = {r["doc_id"]: shingles(r["text"]) for r in kept[1]}
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    assert ids[2] == {i for i, c in label.items() if i == c}

    sizes = {}
    for r in kept[2]:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    want = []
    for r in kept[2]:
        rate = target[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 1.0
        u = int(hashlib.md5(f"20:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        want += [r["doc_id"]] * (int(rate) + (u < rate - int(rate)))
    assert sorted(r["doc_id"] for r in kept[3]) == sorted(want)

    out = pipeline.STAGES[-1][1](spark, docs, d).collect()
    texts = {r[0]: r[1] for r in rows}
    assert sorted(r["doc_id"] for r in out) == sorted(want) and all(r["decoded"] == texts[r["doc_id"]] for r in out)
    assert sorted(r["doc_id"] for r in pipeline.run(spark, d).collect()) == sorted(want)


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, folder[0]).collect() == []


def test_stages_with_clashing_columns(spark, folder):
    d, rows, _ = folder
    names = ["__score", "__gone", "score", "no", "id", "__h"]
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(60).withColumns({n: F.lit(1) for n in names})
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == [*COLUMNS, *names]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert pipeline.STAGES[-1][1](spark, docs, d).count() == docs.count() > 0
