"""A fixed public piece vocabulary: reading it, a double-array trie over its
UTF-8 bytes, and lattices of all segmentations of many words at once.

The only public vocabulary at hand with a score per piece is a BPE model, whose
scores are negative merge ranks.  ``Vocabulary.log_scores`` turns the rank into
a log probability by Zipf's law, p(rank) = 1 / (rank + 1) / H.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the file format
DEFAULT_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def _fields(data: bytes):
    """(field number, value) of each field of a protocol-buffer message."""
    i, n = 0, len(data)

    def varint() -> int:
        nonlocal i
        shift = value = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < n:
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        elif wire == 1:
            i += 8
            yield key >> 3, data[i - 8 : i]
        elif wire == 2:
            size = varint()
            i += size
            yield key >> 3, data[i - size : i]
        elif wire == 5:
            i += 4
            yield key >> 3, data[i - 4 : i]
        else:
            raise ValueError(f"wire type {wire} in a piece vocabulary")


@dataclass
class Trie:
    """Double array: the child of state s by byte b is t = base[s] + b if check[t] == s."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # piece id of a state, or -1

    @classmethod
    def build(cls, keys: list[bytes], ids: list[int]) -> Trie:
        order = sorted(range(len(keys)), key=keys.__getitem__)
        base, check, value = [0] * 1024, [-1] * 1024, [-1] * 1024
        used = bytearray(1024)
        used[0] = 1
        gap = tail = 1  # where the search for one child's slot, and for several children's, begins
        todo = [(0, 0, len(order), 0)]  # state, range of keys, depth
        while todo:
            state, lo, hi, depth = todo.pop()
            if len(keys[order[lo]]) == depth:
                value[state] = ids[order[lo]]
                lo += 1
            kids = []
            while lo < hi:
                b, at = keys[order[lo]][depth], lo
                while lo < hi and keys[order[lo]][depth] == b:
                    lo += 1
                kids.append((b, at, lo))
            if not kids:
                continue
            low = kids[0][0]
            slot = max(low + 1, gap if len(kids) == 1 else tail)
            tried = 0
            while True:
                if slot + 512 > len(used):
                    more = len(used)
                    used.extend(bytes(more))
                    base += [0] * more
                    check += [-1] * more
                    value += [-1] * more
                slot = used.index(0, slot)
                b0 = slot - low
                if b0 + 512 < len(used) and not any(used[b0 + b] for b, _, _ in kids):
                    break
                if b0 + 512 < len(used):
                    slot += 1
                    tried += 1
            if len(kids) == 1:
                gap = slot
            elif tried > 32:  # this stretch is nearly full
                tail = slot
            base[state] = b0
            for b, at, end in kids:
                used[b0 + b], check[b0 + b] = 1, state
                todo.append((b0 + b, at, end, depth + 1))
        pad = [0] * 256
        return cls(np.array(base + pad, np.int32), np.array(check + [-1] * 256, np.int32), np.array(value + [-1] * 256, np.int32))


@dataclass
class Vocabulary:
    pieces: list[bytes]
    scores: np.ndarray
    kinds: np.ndarray
    trie: Trie = field(repr=False)
    byte_ids: np.ndarray  # piece id of each byte value, or -1

    @classmethod
    def of(cls, pieces: list[str], scores: list[float], kinds: list[int]) -> Vocabulary:
        raw = [p.encode() for p in pieces]
        byte_ids = np.full(256, -1, np.int32)
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == BYTE:
                byte_ids[int(p[3:5], 16)] = i
        plain = [i for i, k in enumerate(kinds) if k in (NORMAL, USER) and raw[i]]
        return cls(raw, np.array(scores, np.float64), np.array(kinds, np.int32), Trie.build([raw[i] for i in plain], plain), byte_ids)

    @classmethod
    def load(cls, path: str = DEFAULT_VOCABULARY) -> Vocabulary:
        pieces, scores, kinds = [], [], []
        with open(path, "rb") as file:
            for number, value in _fields(file.read()):
                if number == 1:
                    got = dict(_fields(value))
                    pieces.append(got.get(1, b"").decode())
                    scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
                    kinds.append(got.get(3, NORMAL))
        return cls.of(pieces, scores, kinds)

    def log_scores(self) -> np.ndarray:
        """Natural log probabilities of all pieces by Zipf's law over their order
        of score; byte pieces share the weight of one last rank, others get -inf."""
        out = np.full(len(self.pieces), -np.inf)
        plain = np.flatnonzero((self.kinds == NORMAL) | (self.kinds == USER))
        plain = plain[np.lexsort((plain, -self.scores[plain]))]
        out[plain] = -np.log(np.arange(len(plain)) + 2.0)
        bytes_ = self.byte_ids[self.byte_ids >= 0]
        out[bytes_] = -np.log(len(plain) + 2.0)
        return out - np.logaddexp.reduce(out[np.isfinite(out)])


@dataclass
class Lattice:
    """All pieces of the texts ``data[off[i]:off[i+1]]``: an edge runs from node
    ``start`` to node ``end``.  Text i has the nodes off[i]+i ... off[i+1]+i.
    Edges are sorted by their end's place in its text; ``steps`` bounds them."""

    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    steps: np.ndarray
    first: np.ndarray
    last: np.ndarray
    nodes: int
    text: np.ndarray  # of each edge


def lattice(v: Vocabulary, data: np.ndarray, off: np.ndarray, byte_edges: bool) -> Lattice:
    n = len(data)
    length = np.diff(off)
    doc = np.repeat(np.arange(len(length), dtype=np.int32), length)
    stop = off[1:][doc]
    at = np.arange(n, dtype=np.int64)
    state = np.zeros(n, np.int32)
    starts, ends, ids = [], [], []
    base, check, value = v.trie.base, v.trie.check, v.trie.value
    pos = at
    while len(at):
        nxt = base[state] + data[pos]
        ok = check[nxt] == state
        at, pos, state = at[ok], pos[ok] + 1, nxt[ok]
        found = value[state]
        hit = found >= 0
        starts.append(at[hit])
        ends.append(pos[hit])
        ids.append(found[hit])
        more = pos < stop[at]
        at, pos, state = at[more], pos[more], state[more]
    if byte_edges and n:
        at = np.arange(n, dtype=np.int64)
        known = v.byte_ids[data] >= 0
        starts.append(at[known])
        ends.append(at[known] + 1)
        ids.append(v.byte_ids[data[known]])
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    e = np.concatenate(ends) if ends else s
    p = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    d = doc[s]
    rel = e - off[d]
    order = np.lexsort((e, rel)) if len(rel) else np.zeros(0, np.int64)
    s, e, p, d, rel = s[order], e[order], p[order], d[order], rel[order]
    steps = np.searchsorted(rel, np.arange(1, (int(rel[-1]) if len(rel) else 0) + 2))
    return Lattice(s + d, e + d, p, steps, off[:-1] + np.arange(len(length)), off[1:] + np.arange(len(length)), n + len(length), d)


def _add(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log-sum-exp of runs of equal ``group``."""
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    top = np.maximum.reduceat(values, cut)
    safe = np.where(np.isfinite(top), top, 0.0)
    size = np.diff(np.r_[cut, len(group)])
    total = np.add.reduceat(np.exp(values - np.repeat(safe, size, axis=0)), cut)
    with np.errstate(divide="ignore"):
        return group[cut], np.log(total) + safe


def forward(x: Lattice, lp: np.ndarray) -> np.ndarray:
    """Log weight of all ways to each node; lp: log probability by piece, or a column per model."""
    alpha = np.full((x.nodes, *lp.shape[1:]), -np.inf)
    alpha[x.first] = 0.0
    for i, j in zip(x.steps[:-1], x.steps[1:], strict=True):
        if j > i:
            to, got = _add(alpha[x.start[i:j]] + lp[x.piece[i:j]], x.end[i:j])
            alpha[to] = got
    return alpha


def marginals(x: Lattice, lp: np.ndarray) -> np.ndarray:
    """Log probability of each text, summed over all its segmentations."""
    return forward(x, lp)[x.last]


def expected(x: Lattice, lp: np.ndarray) -> np.ndarray:
    """Posterior probability of each edge given its text (forward-backward)."""
    alpha = forward(x, lp)
    beta = np.full(x.nodes, -np.inf)
    beta[x.last] = 0.0
    # backwards by the same steps: all edges that end at a place are done before those that end earlier
    for k in range(len(x.steps) - 2, -1, -1):
        i, j = x.steps[k], x.steps[k + 1]
        if j > i:
            np.logaddexp.at(beta, x.start[i:j], beta[x.end[i:j]] + lp[x.piece[i:j]])
    total = alpha[x.last]
    return np.exp(alpha[x.start] + lp[x.piece] + beta[x.end] - total[x.text])


def pack(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    off = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=off[1:])
    return np.frombuffer(b"".join(words), np.uint8), off


def by_length(words: list[bytes], limit: int):
    """Index arrays that cut ``words`` into batches of like length and at most
    ``limit`` bytes (a longer word is a batch of its own)."""
    size = np.fromiter((len(w) for w in words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    total = np.cumsum(size[order])
    i = 0
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + limit, "right")))
        yield order[i:j]
        i = j
