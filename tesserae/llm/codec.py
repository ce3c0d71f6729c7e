"""SentencePiece-style encoding and decoding by a unigram Viterbi search.

A text is one dummy marker and the text with each space written as the marker.
The search runs over a double-array trie of the vocabulary's pieces with their
log scores; a character no piece covers is one unknown step (lowest score less
10) and is written as its UTF-8 bytes' pieces.  A marker character in the text
itself is written as bytes, so that it isn't read back as a space.

No piece of the public vocabulary holds a marker behind another character, so
the best path of a text is that of its chunks, a run of markers and what follows
it; each distinct chunk is searched once and a bounded number are kept.  A
vocabulary with such pieces is searched by whole texts.

Nulls: a null text has null ids and decodes to null; an empty text has no ids.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pieces as P
from .shared import slices

UNKNOWN_PENALTY = 10.0
BATCH = 200_000
#: Distinct chunks a worker keeps, and the longest that is kept.
KEPT, KEPT_BYTES = 200_000, 64
_cache: dict[str, dict[bytes, bytes]] = {}  # of each chunk the ids, four bytes each
_MARK = P.MARK.encode()
#: Stands for a marker character that the text itself holds; no UTF-8 text has this byte.
_LITERAL = b"\xff"


def best_paths(v: P.Vocabulary, scores: np.ndarray, chunks: list[bytes]) -> list[list[int]]:
    """The piece ids of each chunk's best segmentation."""
    return [np.frombuffer(x, np.int32).tolist() for x in packed_paths(v, scores, chunks)]


def packed_paths(v: P.Vocabulary, scores: np.ndarray, chunks: list[bytes]) -> list[bytes]:
    """The same as 32-bit numbers.  Among equal scores the longer last piece wins."""
    out: list[bytes] = [b""] * len(chunks)
    mark_ids = byte_pieces(v, _MARK)
    has_bytes = (v.byte_ids >= 0).all()
    floor = scores[np.isin(v.kinds, (P.NORMAL, P.USER))].min(initial=0.0) - UNKNOWN_PENALTY
    for idx in P.by_length(chunks, BATCH):
        data, off = P.pack([chunks[i] for i in idx])
        x = P.lattice(v, data, off, False)
        # characters that no piece of their own covers get one step
        head = np.flatnonzero((data & 0xC0) != 0x80)
        doc = np.searchsorted(off, head, "right") - 1
        tail = np.minimum(np.r_[head[1:], len(data)], off[doc + 1])
        start, end = head + doc, tail + doc
        width = tail - head
        have = np.zeros((5, x.nodes), bool)
        short = x.end - x.start <= 4
        have[(x.end - x.start)[short], x.start[short]] = True
        lone = ~have[np.minimum(width, 4), start]
        s = np.r_[x.start, start[lone]]
        e = np.r_[x.end, end[lone]]
        p = np.r_[x.piece, np.full(int(lone.sum()), -1, np.int32)]
        w = np.where(p >= 0, scores[p], floor)
        rel = e - np.r_[x.first[x.text], x.first[doc[lone]]]
        order = np.lexsort((s, e, rel))
        s, e, p, w, rel = s[order], e[order], p[order], w[order], rel[order]
        steps = np.searchsorted(rel, np.arange(1, (int(rel[-1]) if len(rel) else 0) + 2))
        best = np.full(x.nodes, -np.inf)
        best[x.first] = 0.0
        via = np.full(x.nodes, -1, np.int64)
        for i, j in zip(steps[:-1], steps[1:], strict=True):
            if j > i:
                value = best[s[i:j]] + w[i:j]
                cut = np.flatnonzero(np.r_[True, e[i + 1 : j] != e[i : j - 1]])
                top = np.maximum.reduceat(value, cut)
                size = np.diff(np.r_[cut, j - i])
                at = np.where(value >= np.repeat(top, size), np.arange(j - i), j)
                to = e[i:j][cut]
                best[to], via[to] = top, np.minimum.reduceat(at, cut) + i
        # walk all texts back together
        node, live = x.last.copy(), np.arange(len(idx))
        live = live[node[live] > x.first[live]]
        who, edge, turn = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(live):
            step = via[node[live]]
            who.append(live)
            edge.append(step)
            turn.append(np.full(len(live), len(turn)))
            node[live] = s[step]
            live = live[node[live] > x.first[live]]
        who, edge, turn = np.concatenate(who), np.concatenate(edge), np.concatenate(turn)
        order = np.lexsort((-turn, who))
        who, edge = who[order], edge[order]
        ids, begin = p[edge], s[edge] - who
        # an unknown step is as many byte pieces as it has bytes, a literal marker those of the marker
        unknown = ids < 0
        literal = unknown & (data[np.minimum(begin, len(data) - 1)] == _LITERAL[0]) if len(data) else unknown
        size = np.where(unknown, (e[edge] - s[edge]) if has_bytes else 1, 1)
        size[literal] = len(mark_ids)
        at = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.int32)
        flat[at[~unknown]] = ids[~unknown]
        for k in np.flatnonzero(literal).tolist():
            flat[at[k] : at[k] + size[k]] = mark_ids
        plain_ = unknown & ~literal
        if has_bytes:
            inner = np.arange(int(size[plain_].sum())) - np.repeat(np.cumsum(size[plain_]) - size[plain_], size[plain_])
            flat[np.repeat(at[plain_], size[plain_]) + inner] = v.byte_ids[data[np.repeat(begin[plain_], size[plain_]) + inner]]
        else:
            flat[at[plain_]] = byte_pieces(v, b"?")[0]
        stop = np.cumsum(np.bincount(who, size, len(idx))).astype(np.int64).tolist()
        raw, last = flat.tobytes(), 0
        for i, end in zip(idx.tolist(), stop, strict=True):
            out[i] = raw[4 * last : 4 * end]
            last = end
    return out


def byte_pieces(v: P.Vocabulary, raw: bytes) -> list[int]:
    ids = v.byte_ids[list(raw)]
    if (ids < 0).any():  # a vocabulary without byte pieces
        return [int(np.flatnonzero(v.kinds == P.UNKNOWN)[0])]
    return ids.tolist()


def chunker(v: P.Vocabulary):
    """Cuts a marked text into parts that no piece crosses."""
    crossing = any(re.search(f"[^{P.MARK}]{P.MARK}", p.decode(errors="ignore")) for p in v.pieces)
    if crossing:
        return lambda raw: [raw] if raw else []
    parts = re.compile(b"(?:" + _MARK + b")+(?:(?!" + _MARK + b").)*|(?:(?!" + _MARK + b").)+", re.DOTALL)

    def cut(raw: bytes) -> list[bytes]:
        if _MARK + _MARK in raw or not raw.startswith(_MARK):
            return parts.findall(raw)
        return [_MARK + p for p in raw.split(_MARK)[1:]]  # the same where each run is one marker

    return cut


def marked(text: str) -> bytes:
    return (_MARK + text.encode().replace(_MARK, _LITERAL).replace(b" ", _MARK)) if text else b""


def plain(v: P.Vocabulary, i: int) -> bytes:
    """What a piece stands for: a byte, nothing for control pieces, else itself with spaces for markers."""
    if v.kinds[i] == P.BYTE:
        return bytes([int(v.pieces[i][3:5], 16)])
    return b"" if v.kinds[i] == P.CONTROL else v.pieces[i].replace(_MARK, b" ")


def joined(text_of, ids: list[int]) -> str:
    raw = b"".join([text_of[i] for i in ids])
    return (raw[1:] if raw[:1] == b" " else raw).decode(errors="replace")  # the dummy marker goes


def decode(v: P.Vocabulary, ids: list[int]) -> str:
    """The text of piece ids: byte pieces are bytes, markers are spaces, and the dummy marker goes."""
    return joined({i: plain(v, i) for i in set(ids)}, ids)


def encode_documents(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | P.Vocabulary = P.DEFAULT_VOCABULARY,
    scores: str = "zipf",
) -> DataFrame:
    """doc_id, ids, n_pieces, n_byte_pieces, decoded.

    ``scores``: "file" takes the vocabulary's scores as log scores, "zipf" the
    log probabilities of their ranks."""
    if scores not in ("zipf", "file"):
        raise ValueError(f"scores is {scores!r}")
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    v = P.Vocabulary.load(vocabulary) if isinstance(vocabulary, str) else vocabulary
    shared = spark.sparkContext.broadcast(v)
    key = uuid.uuid4().hex

    def run(batches):
        if key not in _cache:
            _cache.clear()
            _cache[key] = {}
        cache, v = _cache[key], shared.value
        logs = v.log_scores() if scores == "zipf" else v.scores
        cut = chunker(v)
        is_byte = v.kinds == P.BYTE
        text_of = [plain(v, i) for i in range(len(v.pieces))]
        for batch in slices(batches, limit=1 << 20):
            raw = [None if x is None else cut(marked(x)) for x in batch.column(1).to_pylist()]
            used = {c for cs in raw if cs for c in cs}
            new = list(used.difference(cache))
            if len(cache) + len(new) > KEPT:  # chunks that came before and came again stay
                cache = _cache[key] = {c: cache[c] for c in used if c in cache}
            cache.update(zip(new, packed_paths(v, logs, new), strict=True))
            rows = [None if cs is None else np.frombuffer(b"".join([cache[c] for c in cs]), np.int32) for cs in raw]
            some = [r for r in rows if r is not None]
            off = np.r_[0, np.cumsum([0 if r is None else len(r) for r in rows])].astype(np.int32)
            missing = pa.array([r is None for r in rows] + [False], pa.bool_())
            lists = pa.ListArray.from_arrays(pc.if_else(missing, None, pa.array(off, pa.int32())), pa.array(np.concatenate(some) if some else np.zeros(0, np.int32)))
            yield pa.record_batch(
                [
                    batch.column(0),
                    lists,
                    pa.array([None if r is None else len(r) for r in rows], pa.int64()),
                    pa.array([None if r is None else int(is_byte[r].sum()) for r in rows], pa.int64()),
                    pa.array([None if r is None else joined(text_of, r.tolist()) for r in rows], pa.string()),
                ],
                names=[id_col, "ids", "n_pieces", "n_byte_pieces", "decoded"],
            )
            for c in [c for c in new if len(c) > KEPT_BYTES]:
                del cache[c]

    schema = T.StructType([T.StructField(id_col, docs.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("n_byte_pieces", T.LongType()), T.StructField("decoded", T.StringType())])
    return docs.mapInArrow(run, schema)
