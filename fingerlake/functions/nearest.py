"""Near pairs of two sets of vectors in numpy: matrix products pick, float64 decides.

A product in float32 is off by no more than ``_slack``, so every pair that can count is
looked at again by differences. Tiles bound the memory whatever the sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Columns of a tile, pairs of a tile, and candidates whose differences are taken at once.
COLUMNS, TILE, CHUNK = 8192, 1 << 21, 1 << 17


def _kind(x: np.ndarray, y: np.ndarray) -> type:
    """float32, unless squares would leave its range."""
    top = max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0))
    return np.float32 if top == 0 or 1e-12 < top < 1e12 else np.float64


def _slack(dtype: type, length: int) -> float:
    """How far a sum of ``length`` products may be off, for a size of 1."""
    return float(2 * (length + 8) * np.finfo(dtype).eps)


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true elements."""
    flat = mask.reshape(-1)
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    at = (words[:, None] * 8 + np.arange(8)).ravel()
    at = np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])
    return at // mask.shape[1], at % mask.shape[1]


def squared(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (i, j), by differences, so that equal ones tie."""
    out = np.empty(len(i))
    for at in range(0, len(i), CHUNK):
        out[at : at + CHUNK] = ((x[i[at : at + CHUNK]] - y[j[at : at + CHUNK]]) ** 2).sum(1)
    return out


def _cosine(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for at in range(0, len(i), CHUNK):
        a, b = x[i[at : at + CHUNK]], y[j[at : at + CHUNK]]
        out[at : at + CHUNK] = 1 - (a * b).sum(1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
    return out


def _unequal(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for at in range(0, len(i), CHUNK):
        out[at : at + CHUNK] = (x[i[at : at + CHUNK]] != y[j[at : at + CHUNK]]).mean(1)
    return out


def exact(metric: str, x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the pairs (i, j); euclidean ones are left squared."""
    return {"hamming": _unequal, "cosine": _cosine}.get(metric, squared)(x, y, i, j)


def _tiles(x: np.ndarray, y: np.ndarray, metric: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(row, column, s, base, slack)``: ``s + base`` is near the distance, euclidean ones squared.

    ``base`` and ``slack`` are columns, one value for each row. Pairs with a value that is not finite, or whose
    cosine is not, are never near. Hamming distances are those of bits, times the length.
    """
    length = x.shape[1]
    if metric == "hamming" and not all(((v == 0) | (v == 1)).all() for v in (x, y)):
        yield from _counted(x, y)
        return
    fine_x, fine_y = np.isfinite(x).all(1), np.isfinite(y).all(1)
    if metric == "cosine":
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        fine_x, fine_y = fine_x & (nx > 0), fine_y & (ny > 0)
        x, y = x / np.where(nx > 0, nx, 1)[:, None], y / np.where(ny > 0, ny, 1)[:, None]
    x, y = np.where(fine_x[:, None], x, 0), np.where(fine_y[:, None], y, 0)
    dtype = np.float32 if metric == "hamming" else _kind(x, y)
    if metric == "hamming":
        a, b = 0.5 - x, 2 * y - 1
        more, base, scale = np.zeros(len(y)), np.full(len(x), length / 2), np.zeros(len(x))
    elif metric == "cosine":
        a, b = -x, y
        more, base, scale = np.zeros(len(y)), np.ones(len(x)), np.ones(len(x))
    else:
        a, b = -2 * x, y
        more, base = (y * y).sum(1), (x * x).sum(1)
        scale = base + 2 * more.max(initial=0.0)
    a = np.concatenate([a, np.ones((len(a), 1))], axis=1).astype(dtype)
    b = np.concatenate([b, np.where(fine_y, more, np.inf)[:, None]], axis=1).astype(dtype).T
    base = np.where(fine_x, base, np.inf)[:, None]
    slack = (_slack(dtype, length + 1) * scale)[:, None]
    for lo in range(0, b.shape[1], COLUMNS):
        part = np.ascontiguousarray(b[:, lo : lo + COLUMNS])
        rows = max(1, TILE // part.shape[1])
        for at in range(0, len(a), rows):
            yield at, lo, a[at : at + rows] @ part, base[at : at + rows], slack[at : at + rows]


def _counted(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """As :func:`_tiles`, of unequal values that are not bits."""
    zero = np.zeros((len(x), 1))
    rows = max(1, TILE // (COLUMNS * x.shape[1]))
    for lo in range(0, len(y), COLUMNS):
        for at in range(0, len(x), rows):
            part = slice(at, at + rows)
            yield at, lo, (x[part, None, :] != y[None, lo : lo + COLUMNS]).sum(2).astype(np.float64), zero[part], zero[part]


def each_within(x: np.ndarray, y: np.ndarray, metric: str, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`within` tile by tile, so that no more than a tile's pairs are held."""
    if not len(x) or not len(y) or metric == "euclidean" and threshold <= 0:
        return
    limit, length = threshold * threshold if metric == "euclidean" else threshold, x.shape[1]
    for at, lo, s, base, slack in _tiles(x, y, metric):
        if metric == "hamming":
            # Counts are whole and exact in float32, so a quarter of a bit of room leaves the decision to the division.
            i, j = _where(s <= (limit * length + 0.25 - base).astype(s.dtype))
            d = (s[i, j] + base[i, 0]) / length
        else:
            i, j = _where(s <= (limit + 2 * slack - base).astype(s.dtype) + slack.astype(s.dtype))
            d = exact(metric, x, y, i + at, j + lo)
            d = np.sqrt(d) if metric == "euclidean" else d
        ok = d < threshold
        yield i[ok] + at, j[ok] + lo, d[ok]


def within(x: np.ndarray, y: np.ndarray, metric: str, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, distance)`` of all pairs with ``distance < threshold``; bits for hamming."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(none, *each_within(x, y, metric, threshold)))


def nearest(x: np.ndarray, y: np.ndarray, k: int = 1, metric: str = "sqeuclidean", groups: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, distance)`` of the ``k`` nearest rows of ``y`` to each row of ``x``, by i and distance.

    Of equally near ones the first rows of ``y`` count. Euclidean distances are left
    squared. With ``groups``, a number for each row of both, those of ``y`` ascending, pairs of one
    group do not count.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(x) or not len(y):
        return none
    found = [none]
    for at, lo, s, base, slack in _tiles(x, y, metric):
        if groups is not None:
            s[_same(groups[0][at : at + len(s)], groups[1][lo : lo + s.shape[1]])] = np.inf
        # The k-th least of the minima of some columns each is no less than the k-th least of all.
        strips = min(s.shape[1], max(256, 8 * k))
        if k == 1:
            most = s.min(1)
        elif strips <= k:
            most = np.full(len(s), np.inf, s.dtype)
        else:
            whole = s.shape[1] // strips * strips
            most = np.partition(s[:, :whole].reshape(len(s), -1, strips).min(1), k - 1, axis=1)[:, k - 1]
        most = most[:, None] + (3 * slack).astype(s.dtype)
        i, j = _where((s <= most) & (s < np.inf) & np.isfinite(base))
        d = exact(metric, x, y, i + at, j + lo)
        found.append(_first(i + at, j + lo, d, k))
    return _first(*(np.concatenate(c) for c in zip(*found)), k)


def _same(gx: np.ndarray, gy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of equal groups; ``gy`` ascends."""
    first = np.searchsorted(gy, gx)
    n = np.searchsorted(gy, gx, "right") - first
    i = np.repeat(np.arange(len(gx)), n)
    return i, np.arange(len(i)) + np.repeat(first - np.cumsum(n) + n, n)


def nearest_same(x: np.ndarray, y: np.ndarray, metric: str, groups: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least distance of each row of ``x`` to the rows of ``y`` in its group, or inf; euclidean ones squared."""
    gx, gy = groups
    out = np.full(len(x), np.inf)
    ends = np.cumsum(np.searchsorted(gy, gx, "right") - np.searchsorted(gy, gx))
    at = 0
    while at < len(x):  # as many rows as have a bounded number of pairs, one at least
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        i, j = _same(gx[at:to], gy)
        np.fmin.at(out, i + at, exact(metric, x, y, i + at, j))
        at = to
    return out


def _first(i: np.ndarray, j: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    keep = rank < k
    return i[keep], j[keep], d[keep]
