"""Exact nearest neighbours of many sparse query rows.

Train rows come in pieces.  The columns that more than ``SHARE`` (by p) of a piece's rows have are a dense matrix, multiplied
with batches of queries in single precision; the other columns are lists of rows, of which only those of a query's own columns are
read.  Together they bound all distances of a query from below: for Euclid up to the rounding of the products, for Manhattan
the dense part multiplies the roots of the weights, as min(a, b) <= sqrt(a b).  Rows whose bound reaches the k-th distance so far
get their exact distance.  Nothing is skipped that could matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SHARE = {1: 0.2, 2: 0.1}
BATCH = 64  # queries of one product
PAIRS = 8_192  # exact distances at a time
EPS = 2.0 ** -23
SLACK = 1e-8
DECIMALS = 9


def flat(col) -> tuple[np.ndarray, np.ndarray]:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    off = col.offsets.to_numpy().astype(np.int64)
    return col.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]], off - off[0]


def ranges(counts: np.ndarray) -> np.ndarray:
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) if total else np.zeros(0, np.int64)


class Piece:
    """Train rows (``tid``, ``label``, ``idx``, ``val``, perhaps ``fold``) by id."""

    def __init__(self, table: pa.Table, p: int):
        table = table.sort_by("tid").combine_chunks()
        idx, self.off = flat(table["idx"])
        self.val, _ = flat(table["val"])
        self.p, self.n = p, len(self.off) - 1
        self.tid, self.label = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (table["tid"], table["label"]))
        self.fold = table["fold"].to_numpy() if "fold" in table.column_names else None
        self.cols, col = np.unique(idx, return_inverse=True)
        self.col, width = col.astype(np.int32), len(self.cols)
        row = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.off))
        self.norm = np.bincount(row, self.val * self.val if p == 2 else self.val, minlength=self.n)
        self.longest = float(np.sqrt(self.norm.max())) if self.n else 0.0
        count = np.bincount(self.col, minlength=width)
        self.dense = np.flatnonzero(count > SHARE[p] * self.n)
        place = np.full(width, -1, np.int32)
        place[self.dense] = np.arange(len(self.dense))
        spot = place[self.col]
        common = spot >= 0
        self.matrix = np.zeros((self.n, len(self.dense)), np.float32)
        self.matrix[row[common], spot[common]] = self.val[common] if p == 2 else np.sqrt(self.val[common])
        rare = np.flatnonzero(~common)
        by = rare[np.argsort(self.col[rare], kind="stable")]
        self.post_row, self.post_val = row[by].astype(np.intp), self.val[by].astype(np.float32)
        count[self.dense] = 0
        self.post_off = np.concatenate(([0], np.cumsum(count)))


class Search:
    """The ``k`` nearest train rows of each query row, over all pieces that it meets."""

    def __init__(self, idx: np.ndarray, off: np.ndarray, val: np.ndarray, k: int, p: int, fold: np.ndarray | None = None):
        self.idx, self.off, self.val, self.k, self.p, self.fold = idx, off, val, k, p, fold
        self.n = len(off) - 1
        self.own = np.bincount(np.repeat(np.arange(self.n), np.diff(off)), val * val if p == 2 else val, minlength=self.n)
        self.dist = np.full((self.n, k), np.inf)
        self.key = np.full((self.n, k), np.iinfo(np.int64).max)  # piece and place by id in it
        self.met: dict[int, tuple[pa.Array, pa.Array]] = {}

    def meet(self, piece: Piece, number: int = 0) -> None:
        """``number``: pieces of smaller ids have smaller ones."""
        self.met[number] = (piece.tid, piece.label)
        if not piece.n:
            return
        norm = piece.norm.astype(np.float32)
        room = np.empty((BATCH, piece.n), np.float32)
        weights = np.zeros(len(piece.cols))
        for lo in range(0, self.n, BATCH):
            hi = min(lo + BATCH, self.n)
            cells = slice(self.off[lo], self.off[hi])
            at = np.searchsorted(piece.cols, self.idx[cells])
            known = at < len(piece.cols)
            known[known] = piece.cols[at[known]] == self.idx[cells][known]
            at, val = at[known], self.val[cells][known]
            begin = np.concatenate(([0], np.cumsum(known)))[self.off[lo:hi + 1] - self.off[lo]]
            left = np.zeros((hi - lo, len(piece.cols)), np.float32)
            left[np.repeat(np.arange(hi - lo), np.diff(begin)), at] = val if self.p == 2 else np.sqrt(val)
            far = np.matmul(left[:, piece.dense], piece.matrix.T, out=room[:hi - lo])
            far *= -2
            far += norm
            for i in range(hi - lo):
                cols, w = at[begin[i]:begin[i + 1]], val[begin[i]:begin[i + 1]]
                weights[cols] = w
                self._one(piece, number << 32, lo + i, cols, w, weights, far[i])
                weights[cols] = 0

    def _one(self, piece: Piece, base: int, q: int, cols: np.ndarray, w: np.ndarray, weights: np.ndarray, far: np.ndarray) -> None:
        """``far``: bounds from the dense columns, without the query's own part."""
        for a, b, x in zip(piece.post_off[cols].tolist(), piece.post_off[cols + 1].tolist(), w.astype(np.float32), strict=True):
            if a < b:
                held = piece.post_val[a:b]
                np.subtract.at(far, piece.post_row[a:b], held * (2 * x) if self.p == 2 else 2 * np.minimum(held, x))
        if piece.fold is not None:
            far[piece.fold == self.fold[q]] = np.inf
        own, first = self.own[q], None
        if not np.isfinite(self.dist[q, -1]):  # the exact distances of some rows give a first bound
            first = np.argpartition(far, self.k - 1)[:self.k] if len(far) > self.k else np.arange(len(far))
            first = first[np.isfinite(far[first])]
            self._add(piece, base, q, first, weights)
            far[first] = np.inf
        length = np.sqrt(own) * piece.longest
        error = 2 * (len(piece.dense) + len(cols) + 16) * EPS * length + 16 * EPS * (own + length + piece.longest ** 2)
        near = np.flatnonzero(far <= np.float32(min(self.dist[q, -1] + SLACK - own + 1.01 * error, 1e30)))
        for i in range(0, len(near), PAIRS):
            self._add(piece, base, q, near[i:i + PAIRS], weights)

    def _add(self, piece: Piece, base: int, q: int, rows: np.ndarray, weights: np.ndarray) -> None:
        """Puts train rows among the k nearest of a query, if they are."""
        size = piece.off[rows + 1] - piece.off[rows]
        at = np.repeat(piece.off[rows], size) + ranges(size)
        w = weights[piece.col[at]]
        shared = w * piece.val[at] if self.p == 2 else np.minimum(w, piece.val[at])
        dot = np.bincount(np.repeat(np.arange(len(rows)), size), shared, minlength=len(rows))
        dist = np.round(np.maximum(self.own[q] + piece.norm[rows] - 2 * dot, 0.0), DECIMALS)
        near = dist <= self.dist[q, -1]
        if near.any():
            dist, key = np.concatenate((self.dist[q], dist[near])), np.concatenate((self.key[q], base + rows[near]))
            best = np.lexsort((key, dist))[:self.k]
            self.dist[q], self.key[q] = dist[best], key[best]

    def result(self) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
        """(query row, train id, label, distance), by query row, best first."""
        at = np.nonzero(np.isfinite(self.dist))
        dist, key = self.dist[at], self.key[at]
        numbers = sorted(self.met)
        start = np.cumsum([0] + [len(self.met[i][0]) for i in numbers])[:-1]
        place = start[np.searchsorted(numbers, key >> 32)] + (key & 0xFFFFFFFF) if len(key) else np.zeros(0, np.int64)
        tid, label = (pa.concat_arrays([self.met[i][j] for i in numbers]).take(pa.array(place)) for j in (0, 1))
        return at[0], tid, label, np.sqrt(dist) if self.p == 2 else dist
