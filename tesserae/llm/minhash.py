"""Near-duplicate documents by bottom-k sketches from one hash function.

1. A document's set is the hashes of its distinct word shingles.  Documents with
   equal sets are one class, which its smallest id stands for.
2. A class keeps its ``k`` smallest values under one hash function.  With
   similarity J two sketches share about J*k values; at least T of them but for as
   small a share of pairs as lies beyond ``slack`` standard deviations of a normal
   variable (4.5: once in 300,000 pairs at the limit itself, far less often above
   it), taken from the binomial tail.
3. Inverted lists hold each class under its rarest k - T + 1 values: two sketches
   that share T values meet in one of those lists.  Passages that many documents
   share are common values, so they open no lists unless a document has little else.
4. Lists of up to ``small`` classes are compared pair by pair.  In a larger one
   every class is compared to ``HUBS`` hubs, the members with the fewest values of
   their own (those nearest to what the list's members are copies of).  Where the
   verified links leave several components in such a list, its members are sifted by
   sketches of ``WIDE`` values: one that shares too few of them with any others has no
   partner, so a passage that fills less than some two thirds of its documents brings no pairs.
   Of what is left, members outside the list's main component meet the
   whole list in blocks, full set against full set, where a pair counts in the first
   list it shares; only a spanning forest of the links found is written out.  (Members that share
   more than that and still aren't linked are compared pair by pair.)
5. The union sketch of a pair estimates J; pairs well below the limit go.  The
   others' full sets are compared exactly.
6. Components of the verified links, by star contractions.

Which pairs of one component were linked doesn't change the result, so members
of a component need no comparison with each other.

Nulls: a null text has no set and is linked with nothing; rows with a null id
are kept, unlinked.  Rows that share an id are one node: its links are those of
all its texts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .components import components
from .itq import forest
from .shared import free_name, materialize, mix64, shingles, slices, utf8, word_hashes

#: Classes in one block of the comparison that large lists' rest gets.
BLOCK = 512
#: Members of a large list that all others are compared to.
HUBS = 6
#: Lists up to which a row for each is broadcast; more are joined.
FEW = 1_000_000
#: Values in the longer sketches that large lists' members are sifted by.
WIDE = 128
SKETCH = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))])


def _sets(batch_col: pa.Array, width: int):
    data, off = utf8(batch_col)
    # in slices, so that the working arrays stay small
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + (4 << 20), "right")) - 1)
        h, w = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
        for a, b in zip(w[:-1], w[1:], strict=True):
            yield shingles(h[a:b], width)
        i = j


def _sketches(width: int, k: int):
    def run(batches):
        for batch in batches:
            n, key, sketch = [], [], []
            for s in _sets(batch.column(1), width):
                n.append(len(s))
                if len(s):
                    m = mix64(s, 7)
                    with np.errstate(over="ignore"):
                        key.append(np.array([s.sum(), np.bitwise_xor.reduce(m), len(s)], np.uint64).tobytes())
                    low = np.sort(np.partition(m, k - 1)[:k] if len(m) > k else m)
                    sketch.append(low.view(np.int64))
                else:
                    key.append(None)
                    sketch.append(np.zeros(0, np.int64))
            off = np.zeros(len(n) + 1, np.int32)
            np.cumsum([len(x) for x in sketch], out=off[1:])
            values = pa.array(np.concatenate(sketch) if sketch else np.zeros(0, np.int64))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.ListArray.from_arrays(pa.array(off), values)], names=["id", "n", "key", "sketch"])

    return run


def least_shared(k: int, similarity: float, slack: float) -> int:
    """Sketch values that two sets of this similarity share at least."""
    miss, below = math.erfc(slack / math.sqrt(2)) / 2, 0.0
    for t in range(k):
        below += math.comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if below > miss:
            return max(1, t)
    return max(1, k)


def _estimates(similarity: float, slack: float, k: int):
    """Keeps the pairs whose union sketch allows the similarity."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("sa").to_numpy(zero_copy_only=False), batch.column("sb").to_numpy(zero_copy_only=False), strict=True):
                a, b = a.view(np.uint64), b.view(np.uint64)
                union = np.union1d(a, b)[:k]
                both = np.intersect1d(a, b, assume_unique=True)
                shared = int((both <= union[-1]).sum())
                keep.append(shared >= least_shared(len(union), similarity, slack))
            yield pa.record_batch([c for c in batch.columns[:3]], names=batch.schema.names[:3]).filter(pa.array(keep, pa.bool_()))

    return run


def _exact(width: int, percent: int):
    def run(batches):
        for batch in batches:
            a, b = _sets(batch.column("ta"), width), _sets(batch.column("tb"), width)
            keep = []
            for x, y in zip(a, b, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(len(x)) and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _blocks(percent: int):
    """Links between two blocks of a list, as a spanning forest."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        edges = [np.zeros((0, 2), np.int64)]
        if len(left) and len(right):
            value = left["value"].iat[0]
            ids, labels = right["rid"].to_numpy(), right["rlabel"].to_numpy()
            sets = [np.asarray(x, np.int64) for x in right["rset"]]
            sizes = np.array([len(x) for x in sets])
            flat, owner = _flat(sets)
            before, before_owner = _flat([np.asarray([v for v in x if v < value], np.int64) for x in right["rprefix"]])
            for i, label, prefix, raw in zip(left["id"], left["label"], left["prefix"], left["set"], strict=True):
                x = np.asarray(raw, np.int64)
                mine = np.asarray(prefix, np.int64)
                open_ = (labels != label) & (ids != i) & (_shared(before, before_owner, mine[mine < value], len(ids)) == 0)
                open_ &= 100 * np.minimum(sizes, len(x)) >= percent * np.maximum(sizes, len(x))
                if open_.any():
                    both = _shared(flat, owner, x, len(ids))
                    hit = np.flatnonzero(open_ & (100 * both >= percent * (sizes + len(x) - both)))
                    edges.append(np.stack([np.full(len(hit), i), ids[hit]], 1))
        pairs = np.concatenate(edges)
        names, at = np.unique(pairs, return_inverse=True)
        at = at.reshape(-1, 2)
        a, b = forest(at[:, 0], at[:, 1], len(names)) if len(at) else (at[:, 0], at[:, 1])
        return pd.DataFrame({"a": names[a], "b": names[b]})

    return run


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All values of some sets, sorted, and which set each is of."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    return flat[order], owner[order]


def _shared(flat: np.ndarray, owner: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """How many values of ``x`` each of the n sets holds."""
    lo = np.searchsorted(flat, x)
    size = np.searchsorted(flat, x, "right") - lo
    total = int(size.sum())
    if not total:
        return np.zeros(n, np.int64)
    start = np.cumsum(size) - size
    return np.bincount(owner[np.repeat(lo - start, size) + np.arange(total)], minlength=n)


def _full_sets(width: int):
    def run(batches):
        for part in slices(batches, limit=1 << 20):
            sets = [s.view(np.int64) for s in _sets(part.column(1), width)]
            off = np.r_[0, np.cumsum([len(s) for s in sets])]
            yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(sets)))], names=["id", "set"])

    return run


def meet(left: DataFrame, right: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Join with one row per key.  Up to FEW rows (if that is known) are broadcast;
    else both sides are shuffled for this join alone, as its second key sees to, so
    that adaptive execution can split a key that very many rows of ``left`` hold."""
    if rows is not None and rows <= FEW:
        return left.join(F.broadcast(right), key)
    return left.withColumn("__h", F.xxhash64(key)).join(right.withColumn("__h", F.xxhash64(key)), [key, "__h"]).drop("__h")


def near_duplicates(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    k: int = 32,
    slack: float = 4.5,
    small: int = 16,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    j = percent / 100
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = materialize(docs.mapInArrow(_sketches(width, k), SKETCH), "minhash_sets")
    links = verified_links(docs, sets, width, percent, j, k, slack, small)

    # equal sets are linked through their class
    classes = sets.filter("id is not null and key is not null").groupBy("key").agg(F.min("id").alias("class"))
    same = meet(sets.filter("id is not null and key is not null"), classes, "key").filter("id <> class").select(F.col("id").alias("a"), F.col("class").alias("b"))
    found = components(links.unionAll(same))
    return (
        sets.join(found, sets["id"] == found["node"], "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )


def verified_links(docs: DataFrame, sets: DataFrame, width: int, percent: int, j: float, k: int, slack: float, small: int) -> DataFrame:
    """Links (a, b) between different classes, enough for their components."""
    reps = materialize(sets.filter("id is not null and key is not null").groupBy("key").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch")).drop("key"), "minhash_classes")

    posts = reps.select("id", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    common = posts.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = meet(posts, common, "value").groupBy("id", "s").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("x"))
    least = F.element_at(F.array(*[F.lit(least_shared(i, j, slack)) for i in range(1, k + 1)]), F.col("s"))
    # values of one document come first of all and open no list
    room = (F.col("s") - least + 1) - (F.col("s") - F.size("x"))
    central = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.ln(v["df"])) / F.col("s")
    kept = ranked.filter(room > 0).select("id", central.alias("central"), F.transform(F.slice("x", F.lit(1), room), lambda v: v["value"]).alias("prefix"))
    kept = materialize(kept, "minhash_prefixes")
    lists = kept.select("id", "central", F.explode("prefix").alias("value"))

    large = materialize(lists.groupBy("value").agg(F.count("*").alias("size")).filter(F.col("size") > small), "minhash_large")
    n = large.count()
    many = materialize(meet(lists, large, "value", n), "minhash_many")
    top = Window.partitionBy("value").orderBy(F.desc("central"), "id")
    hubs = many.withColumn("no", F.row_number().over(top)).filter(F.col("no") <= HUBS).groupBy("value").agg(F.collect_list("id").alias("hubs"))
    stars = meet(many.select("value", "id"), hubs, "value", n).select(F.explode("hubs").alias("h"), "id").distinct()
    stars = stars.select(F.least("h", "id").alias("a"), F.greatest("h", "id").alias("b")).filter("a <> b")
    pairs = materialize(few(lists, large, n).select("a.id", "b.id").toDF("a", "b").unionAll(stars).distinct(), "minhash_pairs")
    links = materialize(verify(docs, reps, pairs, width, percent, j, k, slack), "minhash_links")

    # what large lists still hold of different components
    label = components(links)
    held = materialize(many.select("value", "id").join(label, many["id"] == label["node"], "left").select("value", "id", F.coalesce("component", "id").alias("label")), "minhash_held")
    mixed = held.groupBy("value").agg((F.min("label") < F.max("label")).alias("mixed")).filter("mixed").select("value")
    members = materialize(meet(held, mixed, "value", n).select("id", "label").distinct(), "minhash_members")
    if not members.head(1):
        return links
    # a member is out if its longer sketch shares too few values with any others'
    wide = likely(docs, members).mapInArrow(_sketches(width, WIDE), SKETCH).filter("key is not null").dropDuplicates(["id", "key"])
    wide = materialize(wide.select("id", "sketch").withColumn("rid", F.monotonically_increasing_id()), "minhash_wide")
    items = wide.select("rid", F.explode("sketch").alias("value"))
    common = items.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1").select("value")
    shared = meet(items, common, "value").groupBy("rid").agg(F.count("*").alias("shared"))
    enough = F.element_at(F.array(*[F.lit(least_shared(i, j, slack)) for i in range(1, WIDE + 1)]), F.size("sketch"))
    open_ = materialize(wide.join(shared, "rid").filter(F.col("shared") >= enough).select("id").distinct(), "minhash_open")
    held = materialize(meet(held, mixed, "value", n).join(open_, "id", "left_semi"), "minhash_held")
    by_label = held.groupBy("value", "label").agg(F.count("*").alias("n"))
    main = by_label.groupBy("value").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.count("*") > 1).alias("mixed"), F.sum("n").alias("size"))
    rest = materialize(meet(held, main.filter("mixed").drop("mixed"), "value", n), "minhash_rest")
    full = likely(docs, rest.select("id").distinct()).mapInArrow(_full_sets(width), "id long, set array<bigint>").dropDuplicates(["id", "set"])
    rest = rest.join(kept.select("id", "prefix"), "id").join(full.hint("merge"), "id")
    rest = rest.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    each = F.sequence(F.lit(0), F.col("blocks") - 1)
    # those outside a list's main component meet all the list, block by block
    left = rest.filter("label <> main").select("value", "id", "label", "prefix", "set", F.col("block").alias("i"), F.explode(each).alias("j"))
    right = rest.select(F.col("value").alias("rvalue"), F.col("id").alias("rid"), F.col("label").alias("rlabel"), F.col("prefix").alias("rprefix"), F.col("set").alias("rset"), F.explode(each).alias("ri"), F.col("block").alias("rj"))
    last = left.groupBy("value", "i", "j").cogroup(right.groupBy("rvalue", "ri", "rj")).applyInPandas(_blocks(percent), "a long, b long")
    return links.unionAll(materialize(last, "minhash_more"))


def few(lists: DataFrame, large: DataFrame, n: int) -> DataFrame:
    """Pairs (a, b) of the rows, without ``value``, of all lists but the n large ones."""
    large = large.select("value")
    short = lists.join(F.broadcast(large) if n <= FEW else large, "value", "left_anti")
    row = F.struct(*[c for c in lists.columns if c != "value"])
    short = short.groupBy("value").agg(F.sort_array(F.collect_set(row)).alias("r")).filter(F.size("r") > 1)
    return short.select(F.posexplode("r").alias("i", "a"), "r").select("a", F.explode(F.slice("r", F.col("i") + 2, F.size("r"))).alias("b"))


def likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without most of the rows whose id isn't in ``ids``: a bitmap of 256 rows of
    4 KB, whatever the input, so that few texts are shuffled.  As ids grow it lets more pass."""

    def place(c):
        return F.pmod(F.xxhash64(c, F.lit(11)), F.lit(1 << 23))

    bits = ids.select(place(F.col("id")).alias("h")).groupBy(F.shiftright("h", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("h") % 32768).alias("bits"))
    at = place(F.col("id")) % 32768
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 >= 1
    return docs.withColumn("bucket", F.shiftright(place(F.col("id")), 15)).join(F.broadcast(bits), "bucket").filter(there).select(*docs.columns)


def verify(docs: DataFrame, reps: DataFrame, pairs: DataFrame, width: int, percent: int, j: float, k: int, slack: float) -> DataFrame:
    """The pairs whose full sets have the similarity.  A class in very many pairs
    is dealt to several tasks: its rows are asked for once per 256 partners."""
    degree = materialize(pairs.groupBy("a").agg(F.count("*").alias("d")).filter("d > 256"), "minhash_degree")
    degree = F.broadcast(degree) if degree.count() <= FEW else degree
    salted = pairs.join(degree, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.coalesce("d", F.lit(1)) / 256)).alias("salt"))
    salted = materialize(salted, "minhash_salted")

    def bring(p: DataFrame, of: DataFrame, col: str, x: str, y: str) -> DataFrame:
        asked = p.select("a", "salt").distinct().join(of.select(F.col("id").alias("a"), F.col(col).alias(x)), "a")
        with_a = p.join(asked, ["a", "salt"])
        return with_a.join(of.select(F.col("id").alias("b"), F.col(col).alias(y)), "b").select("a", "b", "salt", x, y)

    near = materialize(bring(salted, reps, "sketch", "sa", "sb").mapInArrow(_estimates(j, slack, k), "a long, b long, salt long"), "minhash_near")
    full = likely(docs, near.select(F.explode(F.array("a", "b")).alias("id"))).hint("merge")
    return bring(near, full, "text", "ta", "tb").mapInArrow(_exact(width, percent), "a long, b long").distinct()


def dedup_documents(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``documents`` that stand for their group; of rows that repeat id and
    text one stays.  Rows with a null id get a number of their text's here, so they
    are compared like the others and stay only where no row with an id stands for them."""
    no, text = free_name(documents.columns, "no"), F.col(text_col).cast("string")
    beyond = F.lit(1 << 62) + F.shiftright(F.xxhash64(text).bitwiseAND(F.lit(2**63 - 1)), 2)
    numbered = documents.withColumn(no, F.coalesce(F.col(id_col).cast("long"), beyond))
    found = materialize(near_duplicates(numbered.select(no, text_col), id_col=no, text_col=text_col, **options), "minhash_found")
    gone = found.filter("not kept").select(no).distinct()
    twice = materialize(found.groupBy(no).count().filter("count > 1").select(no), "minhash_twice")
    rest = numbered.join(gone, no, "left_anti")
    n = twice.count()
    if n:
        small = F.broadcast(twice) if n <= FEW else twice
        rest = rest.join(small, no, "left_anti").unionByName(rest.join(small, no, "left_semi").dropDuplicates([no, text_col]))
    return rest.select(*[F.col(f"`{c}`") for c in documents.columns])
