"""Geometries of many tiles as Mapbox Vector Tile commands, all at once.

Points, lines and polygons of one ring are simplified, cut, rounded and written by
whole arrays; what has holes or several parts goes through the planar operations
one by one and joins the others for the writing.  ``mvt.render`` is the same for
one tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import geometry as G
from . import mvt, wkb
from .mercator import EXTENT, HALF_WORLD

POINT, LINE, OUTER, HOLE = 0, 1, 2, 3
_KIND = np.array([1, 2, 3, 3])


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def simplify_paths(xy: np.ndarray, off: np.ndarray, tolerance: float, least: np.ndarray) -> np.ndarray:
    """Which points Douglas-Peucker keeps of each path; all, where fewer than ``least`` would stay.
    Every round splits all open stretches at their farthest points."""
    keep = np.zeros(len(xy), bool)
    size = np.diff(off)
    some = size > 0
    keep[off[:-1][some]] = keep[off[1:][some] - 1] = True
    i, j = off[:-1][size > 2], off[1:][size > 2] - 1
    while len(i):
        n = j - i - 1
        at = _ranges(i + 1, n)
        of = np.repeat(np.arange(len(i)), n)
        p, d = xy[at] - xy[i][of], xy[j] - xy[i]
        length = (d * d).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(length[of] > 0, np.clip((p * d[of]).sum(1) / length[of], 0, 1), 0)
        far = ((p - t[:, None] * d[of]) ** 2).sum(1)
        top = np.maximum.reduceat(far, np.cumsum(n) - n)
        best = np.flatnonzero(far == top[of])
        which, first = np.unique(of[best], return_index=True)
        k = at[best[first]]
        split = top[which] > tolerance * tolerance
        i, j, k = i[which][split], j[which][split], k[split]
        keep[k] = True
        i, j = np.r_[i, k], np.r_[k, j]
        open_ = j - i > 1
        i, j = i[open_], j[open_]
    few = np.add.reduceat(np.r_[keep.astype(np.int64), 0], off[:-1]) < least if len(size) else np.zeros(0, bool)
    keep[_ranges(off[:-1][few & some], size[few & some])] = True
    return keep


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all numbers (below 2**35), and each number's place among them."""
    v = values.astype(np.uint64)
    n = 1 + sum((v >= np.uint64(1 << s)).astype(np.int64) for s in (7, 14, 21, 28))
    off = np.r_[0, np.cumsum(n)]
    out = np.zeros(off[-1], np.uint8)
    for k in range(5):
        has = n > k
        out[off[:-1][has] + k] = (v[has] >> np.uint64(7 * k)) & np.uint64(127) | np.where(n[has] > k + 1, np.uint64(128), np.uint64(0))
    return out, off


def commands(xy: np.ndarray, off: np.ndarray, role: np.ndarray, feature: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Paths in tile space (y down) as commands.  ``feature`` of each path is in order;
    a hole's ``group`` is that of its outer ring.  Gives the features with anything left,
    their kinds, and their bytes with places."""
    p = np.rint(xy).astype(np.int64)
    size = np.diff(off)
    path = np.repeat(np.arange(len(size)), size)
    ring = role >= OUTER
    # one of equal points in a row, and no ring's last
    first = np.zeros(len(p), bool)
    first[off[:-1][size > 0]] = True
    stay = first | (role[path] == POINT)
    stay[1:] |= (p[1:] != p[:-1]).any(1)
    p, path, first = p[stay], path[stay], first[stay]
    last = np.r_[first[1:], True] if len(first) else first
    start = np.flatnonzero(first)
    begin = np.repeat(start, np.diff(np.r_[start, len(p)]))
    closing = last & ring[path] & ~first & (p == p[begin]).all(1)
    p, path = p[~closing], path[~closing]
    size = np.bincount(path, minlength=len(role))
    off = np.r_[0, np.cumsum(size)]
    # rings by area: none, or the wrong way round
    after = np.arange(1, len(p) + 1)
    after[off[1:][size > 0] - 1] = off[:-1][size > 0]
    o = p[off[:-1][path]] if len(p) else p
    a, b = (p - o).astype(float), (p[after] - o).astype(float)
    area = np.bincount(path, a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1], len(role))
    ok = np.where(ring, (size >= 3) & (area != 0), size >= np.where(role == POINT, 1, 2))
    outer = np.zeros(int(group.max()) + 1 if len(group) else 0, bool)
    outer[group[ok & (role != HOLE)]] = True
    ok &= outer[group]
    back = ring & ((area > 0) != (role == OUTER))
    place = np.arange(len(p)) - off[:-1][path]
    p = p[off[:-1][path] + np.where(back[path], (size[path] - place) % np.maximum(size[path], 1), place)]
    keep = ok[path]
    p, role, feature, size = p[keep], role[ok], feature[ok], size[ok]
    off = np.r_[0, np.cumsum(size)]
    new = np.r_[True, feature[1:] != feature[:-1]] if len(feature) else np.zeros(0, bool)
    before = np.zeros_like(p)
    before[1:] = p[:-1]
    before[off[:-1][new]] = 0
    step = p - before
    zigzag = (step << 1) ^ (step >> 63)
    # points: head and all steps; others: move, line, and a ring's end
    dots = role == POINT
    length = 2 * size + np.where(dots, 1, 2 + (role >= OUTER))
    at = np.r_[0, np.cumsum(length)]
    out = np.zeros(at[-1], np.int64)
    out[at[:-1]] = np.where(dots, size << 3 | 1, 9)
    out[at[:-1][~dots] + 3] = (size[~dots] - 1) << 3 | 2
    out[at[1:][role >= OUTER] - 1] = 15
    path = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(p)) - off[:-1][path]
    here = at[:-1][path] + 1 + 2 * place + ((place > 0) & ~dots[path])
    out[here], out[here + 1] = zigzag[:, 0], zigzag[:, 1]
    raw, where = _varints(out)
    return feature[new], _KIND[role[new]], raw, where[np.r_[at[:-1][new], at[-1]]]


def _paths(g) -> list[tuple[int, np.ndarray]]:
    """Roles and points of a geometry that isn't a collection."""
    name, data = g
    if name == "Point":
        return [(POINT, np.array([data], float))]
    if name == "MultiPoint":
        return [(POINT, np.array([q[1] for q in data], float))] if data else []
    if name in ("LineString", "LinearRing"):
        return [(LINE, data)]
    if name == "MultiLineString":
        return [(LINE, q[1]) for q in data]
    return [(HOLE if i else OUTER, r) for rings in ([q[1] for q in data] if name == "MultiPolygon" else [data]) for i, r in enumerate(rings)]


def project_rows(raw: list) -> tuple[list, np.ndarray]:
    """WKB (EPSG:4326) repaired and in EPSG:3857, with its box; None for what is null, empty or beyond repair."""
    out: list = [None] * len(raw)
    box = np.full((len(raw), 4), np.nan)
    slow: list[int] = []
    groups: dict[tuple, list[int]] = {}
    for i, r in enumerate(raw):
        if r is not None:
            groups.setdefault((len(r), bytes(r[:13])), []).append(i)
    for (size, head), rows in groups.items():
        plain = wkb.Batch._plain(size, head)
        if plain is None:
            slow += rows
            continue
        name, skip = plain
        at = np.array(rows)
        xy = np.frombuffer(b"".join(raw[i] for i in rows), np.uint8).reshape(len(rows), size)[:, skip:]
        xy = np.ascontiguousarray(xy).view("<f8").reshape(len(rows), -1, 2)
        good = np.isfinite(xy).all((1, 2))
        if name != "Point":
            good &= (xy[:, 1:] != xy[:, :-1]).any(2).all(1) & (xy.shape[1] > (1 if name == "LineString" else 3))
        if name == "Polygon":
            # rings that turn one way and once around need no repair but their direction
            with np.errstate(invalid="ignore"):
                d = np.diff(xy, axis=1)
                n = np.roll(d, -1, 1)
                turn = d[..., 0] * n[..., 1] - d[..., 1] * n[..., 0]
                around = np.arctan2(turn, (d * n).sum(2)).sum(1)
            good &= (xy[:, 0] == xy[:, -1]).all(1) & ((turn >= 0).all(1) | (turn <= 0).all(1)) & (np.abs(np.abs(around) - 2 * np.pi) < 1e-6)
            xy = np.where((around < 0)[:, None, None], xy[:, ::-1], xy)
        slow += at[~good].tolist()
        at, xy = at[good], xy[good]
        if not len(at):
            continue
        flat = G.to_mercator(xy.reshape(-1, 2)).reshape(xy.shape)
        box[at, :2], box[at, 2:] = flat.min(1), flat.max(1)
        body, skip_head = np.ascontiguousarray(flat, "<f8").view(np.uint8).reshape(len(at), -1).tobytes(), head[:skip]
        step = size - skip
        for k, i in enumerate(at.tolist()):
            out[i] = skip_head + body[k * step : (k + 1) * step]
    for i in slow:
        g = G.repair(wkb.parse(raw[i]))
        g = None if g is None else G.transform(g, G.to_mercator)
        b = None if g is None else wkb.bounds(g)
        if b is not None:
            out[i], box[i] = wkb.dumps(g), b
    return out, box


def encode_rows(z: np.ndarray, x: np.ndarray, y: np.ndarray, raw: list[bytes], pad: float = mvt.PAD) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For geometries (WKB, EPSG:3857) and the tile each is wanted in: the rows of the
    features left (a collection gives several), their kinds and commands."""
    width = 2 * HALF_WORLD / (1 << z.astype(np.int64))
    minx, maxy = x * width - HALF_WORLD, HALF_WORLD - y * width
    margin = pad * EXTENT
    chunks: list[tuple[np.ndarray, ...]] = []  # xy, sizes, roles, rows, parts, simplified?
    slow: list[int] = []
    groups: dict[tuple, list[int]] = {}
    for i, r in enumerate(raw):
        groups.setdefault((len(r), bytes(r[:13])), []).append(i)
    for (size, head), rows in groups.items():
        plain = wkb.Batch._plain(size, head)
        if plain is None:
            slow += rows
            continue
        name, skip = plain
        at = np.array(rows)
        xy = np.frombuffer(b"".join(raw[i] for i in rows), np.uint8).reshape(len(rows), size)[:, skip:]
        xy = np.ascontiguousarray(xy).view("<f8").reshape(len(rows), -1, 2)
        w = width[at, None]
        xy = np.stack([(xy[..., 0] - minx[at, None]) / w, (maxy[at, None] - xy[..., 1]) / w], 2) * EXTENT
        if name == "Point":
            inside = ((xy >= -margin) & (xy <= EXTENT + margin)).all((1, 2))
            at, xy = at[inside], xy[inside]
        role = {"Point": POINT, "LineString": LINE, "Polygon": OUTER}[name]
        chunks.append((xy.reshape(-1, 2), np.full(len(at), xy.shape[1]), np.full(len(at), role), at, np.zeros(len(at), np.int64)))
    xy, size, role, row, part = (np.concatenate([c[k] for c in chunks]) if chunks else np.zeros((0, 2) if not k else 0, float if not k else np.int64) for k in range(5))
    off = np.r_[0, np.cumsum(size)].astype(np.int64)
    keep = simplify_paths(xy, off, mvt.TOLERANCE * EXTENT, np.where(role >= OUTER, 4, 2))
    left = np.add.reduceat(np.r_[keep.astype(np.int64), 0], off[:-1]) if len(size) else size
    for k in np.flatnonzero((role >= OUTER) & (left < size) & (left > 4)):  # as coarse as leaves the ring apart
        here = slice(off[k], off[k + 1])
        keep[here] = np.isin(np.arange(size[k]), _kept(xy[here]))
        left[k] = keep[here].sum()
    xy, size = xy[keep], left
    more: list[list] = [[], [], [], [], []]
    # paths that the padded tile cuts
    low, high = -margin, EXTENT + margin
    path = np.repeat(np.arange(len(size)), size)
    cut = np.bincount(path, ((xy < low) | (xy > high)).any(1), len(size)) > 0
    if cut.any():
        whole = ~cut[path]
        lines, rings = cut & (role == LINE), cut & (role == OUTER)
        got = [_clip_lines(xy[lines[path]], size[lines], row[lines], low, high), _clip_rings(xy[rings[path]], size[rings], row[rings], low, high)]
        xy, size, role, row, part = (np.concatenate([a, *b]) for a, *b in zip((xy[whole], size[~cut], role[~cut], row[~cut], part[~cut]), *got, strict=True))
    for i in slow:
        w = width[i]
        box = (minx[i] - pad * w, maxy[i] - w - pad * w, minx[i] + w + pad * w, maxy[i] + pad * w)
        for k, g in enumerate(mvt.fitted(wkb.loads(raw[i]), box, mvt.TOLERANCE * w)):
            for r, points in _paths(g):
                more[0].append(np.stack([(points[:, 0] - minx[i]) / w, (maxy[i] - points[:, 1]) / w], 1) * EXTENT)
                for c, v in zip(more[1:], (len(points), r, i, k), strict=True):
                    c.append(v)
    if more[0]:
        xy = np.concatenate([xy, *more[0]])
        size, role, row, part = (np.r_[a, np.array(b, np.int64)] for a, b in zip((size, role, row, part), more[1:], strict=True))
    off = np.r_[0, np.cumsum(size)].astype(np.int64)
    order = np.lexsort((np.arange(len(row)), part, row))
    xy = xy[_ranges(off[:-1][order], size[order].astype(np.int64))] if len(order) else xy
    size, role, row, part = size[order].astype(np.int64), role[order].astype(np.int64), row[order].astype(np.int64), part[order].astype(np.int64)
    feature = np.cumsum(np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])]) - 1 if len(row) else row
    of = row[np.r_[True, feature[1:] != feature[:-1]]] if len(row) else row
    group = np.cumsum(role != HOLE) - 1
    found, kind, out, where = commands(xy, np.r_[0, np.cumsum(size)], role, feature, group)
    data = pa.BinaryArray.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(where.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])
    return of[found], kind, data


def _clip_lines(xy: np.ndarray, size: np.ndarray, row: np.ndarray, low: float, high: float) -> tuple[np.ndarray, ...]:
    """What of lines lies in a square: points, sizes, roles, rows, parts.  Every segment is cut by its own; runs of joined ones are a line."""
    line = np.repeat(np.arange(len(size)), size)
    joined = line[1:] == line[:-1]
    a, d, line = xy[:-1][joined], np.diff(xy, axis=0)[joined], line[:-1][joined]
    t0, t1, ok = np.zeros(len(a)), np.ones(len(a)), np.ones(len(a), bool)
    for axis in (0, 1):
        flat = d[:, axis] == 0
        ok &= ~flat | ((a[:, axis] >= low) & (a[:, axis] <= high))
        with np.errstate(divide="ignore", invalid="ignore"):
            u, v = (low - a[:, axis]) / d[:, axis], (high - a[:, axis]) / d[:, axis]
        t0 = np.where(flat, t0, np.maximum(t0, np.minimum(u, v)))
        t1 = np.where(flat, t1, np.minimum(t1, np.maximum(u, v)))
    ok &= t0 <= t1
    new = np.ones(len(a), bool)
    new[1:] = ~((line[1:] == line[:-1]) & ok[:-1] & (t1[:-1] == 1) & (t0[1:] == 0))
    new, a, d, t0, t1, line = new[ok], a[ok], d[ok], t0[ok], t1[ok], line[ok]
    p, q = (np.clip(a + d * t[:, None], low, high) for t in (t0, t1))
    out = np.stack([p, q], 1).reshape(-1, 2)[np.stack([new, np.ones(len(new), bool)], 1).ravel()]
    run = np.cumsum(new) - 1
    n = np.bincount(run, minlength=int(new.sum())) + 1
    return out, n, np.full(len(n), LINE), row[line[new]], np.zeros(len(n), np.int64)


def _clip_rings(xy: np.ndarray, size: np.ndarray, row: np.ndarray, low: float, high: float) -> tuple[np.ndarray, ...]:
    """What of polygons of one ring lies in a square, as ``_clip_lines`` gives it: all rings half-plane by
    half-plane; those that leave and come back on one side are taken apart one by one."""
    off = np.r_[0, np.cumsum(size)].astype(np.int64)
    p, ring = xy[_ranges(off[:-1], size - 1)], np.repeat(np.arange(len(size)), size - 1)

    def following() -> np.ndarray:
        after = np.arange(1, len(ring) + 1)
        end = np.r_[ring[1:] != ring[:-1], True] if len(ring) else np.zeros(0, bool)
        after[end] = np.flatnonzero(np.r_[True, ring[1:] != ring[:-1]]) if len(ring) else after[end]
        return after

    for axis, bound, above in ((0, low, True), (0, high, False), (1, low, True), (1, high, False)):
        after = following()
        d = p[:, axis] - bound if above else bound - p[:, axis]
        inside = d >= 0
        crosses = inside != inside[after]
        with np.errstate(divide="ignore", invalid="ignore"):
            edge = p + (p[after] - p) * (d / (d - d[after]))[:, None]
        edge[:, axis] = bound
        both = np.stack([inside, crosses], 1).ravel()
        p, ring = np.stack([p, edge], 1).reshape(-1, 2)[both], np.repeat(ring, 2)[both]
    after = following()
    same = np.flatnonzero((p == p[after]).all(1))
    again = np.zeros(len(p), bool)
    again[np.where(after[same] == same + 1, same + 1, same)] = True  # the later of two, a ring's last before its first
    p, ring = p[~again], ring[~again]
    few = np.bincount(ring, minlength=len(size))[ring] < 3
    p, ring = p[~few], ring[~few]
    after = following()
    d = p[after] - p
    turn = d[:, 0] * d[after, 1] - d[:, 1] * d[after, 0]
    around = np.abs(np.bincount(ring, np.arctan2(turn, (d * d[after]).sum(1)), len(size)))
    odd = ((np.bincount(ring, turn > 0, len(size)) > 0) & (np.bincount(ring, turn < 0, len(size)) > 0)) | (np.abs(around - 2 * np.pi) > 1e-6)
    n = np.bincount(ring, minlength=len(size))
    for k in np.flatnonzero(odd & (n > 0)):  # not convex
        here = np.flatnonzero(ring == k)
        closed = p[np.r_[here, here[:1]]]
        odd[k] = G._bridged([closed], (low, low, high, high)) or not G.is_simple([closed])
    plain = ~odd[ring]
    n = n * ~odd
    some = n > 0
    # each ring's first point once more, at its end
    start = np.r_[0, np.cumsum(n[some])].astype(np.int64)
    kept = p[plain]
    out = kept[np.minimum(_ranges(start[:-1], n[some] + 1), len(kept) - 1)] if some.any() else kept
    if some.any():
        ends = np.cumsum(n[some] + 1) - 1
        out[ends] = kept[start[:-1]]
    points, sizes, roles, rows = [out], [n[some] + 1], [np.full(int(some.sum()), OUTER)], [row[some]]
    for k in np.flatnonzero(odd & (np.bincount(ring, minlength=len(size)) > 0)):
        here = np.flatnonzero(ring == k)
        for rings in G.rebuild([p[np.r_[here, here[:1]]]]):
            for i, r in enumerate(rings):
                points.append(r), sizes.append(np.array([len(r)])), roles.append(np.array([HOLE if i else OUTER])), rows.append(row[k : k + 1])
    sizes = np.concatenate(sizes)
    return np.concatenate(points), sizes, np.concatenate(roles), np.concatenate(rows), np.zeros(len(sizes), np.int64)


def _kept(ring: np.ndarray) -> np.ndarray:
    """Numbers of a ring's points that G.simplify keeps."""
    _, (got,) = G.simplify(("Polygon", [ring]), mvt.TOLERANCE * EXTENT)
    out, at = [], 0
    for p in got:
        while (ring[at] != p).any():
            at += 1
        out.append(at)
        at += 1
    return np.array(out)
