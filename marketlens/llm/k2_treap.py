"""A grid of terms and documents as a K2-treap, and best-first search in it.

The grid is cut into four again and again; a node of the tree is a square that holds cells,
and knows which of its four quarters do (four bits) and the largest value in it. Nodes lie
level by level in the order of their squares, so the children of a node follow from the
number of bits before it and no pointer is stored; a largest value is stored as what it is
below that of its parent.

A search follows the paths of several rows at once. Its state is a range of columns with
one node for each row, and the sum of their weighted maxima bounds every column of the
range. The best states are halved first; a range of one column has its exact sum, and what
can't reach the k-th best sum is given up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_COUNT = np.array([bin(i).count("1") for i in range(16)], np.uint8)
#: Bits of a nibble before each of the four quarters: [nibble, quarter].
_BEFORE = np.array([[bin(i & ((1 << q) - 1)).count("1") for q in range(4)] for i in range(16)], np.uint8)
#: States that are halved at once.
WIDTH = 256


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of numbers below 2^31, moved to the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def _packed(values: np.ndarray) -> bytes:
    """Bytes of 32-bit numbers, equal places together, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def build(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> tuple[list[int], bytes, bytes]:
    """``(nodes per level, quarters, maxima)`` of cells with values of 0 to 2^32 - 1, every cell once, at least one."""
    height = max(1, int(max(rows.max(), columns.max())).bit_length())
    codes = (_spread(rows) << np.uint64(1)) | _spread(columns)
    order = np.argsort(codes, kind="stable")
    codes, largest = codes[order], values[order].astype(np.int64)
    sizes, quarters, below = [len(codes)], [], []
    for _ in range(height):
        parents = codes >> np.uint64(2)
        first = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        above = np.maximum.reduceat(largest, first)
        quarters.append(np.bitwise_or.reduceat(np.left_shift(1, (codes & np.uint64(3)).astype(np.uint8), dtype=np.uint8), first))
        below.append(np.repeat(above, np.diff(np.append(first, len(codes)))) - largest)
        codes, largest = parents[first], above
        sizes.append(len(codes))
    nibbles = np.concatenate(quarters[::-1])
    nibbles = np.append(nibbles, np.zeros(len(nibbles) % 2, np.uint8))
    halves = (nibbles[0::2] | (nibbles[1::2] << 4)).astype(np.uint8)
    return sizes[::-1], pa.compress(halves.tobytes(), "zstd", asbytes=True), _packed(np.concatenate([largest, *below[::-1]]))


class Treap:
    """A stored tree, opened for searches."""

    def __init__(self, sizes: list[int], quarters: bytes, maxima: bytes):
        self.height, total = len(sizes) - 1, sum(sizes)
        inner = total - sizes[-1]
        halves = np.frombuffer(pa.decompress(quarters, (inner + 1) // 2, "zstd", asbytes=True), np.uint8)
        #: One node more, without quarters and with maximum 0, stands for every square without cells.
        self.none = total
        self.quarters = np.zeros(total + 1, np.uint8)
        self.quarters[:inner] = np.stack([halves & 15, halves >> 4], axis=1).ravel()[:inner]
        counts = _COUNT[self.quarters[:inner]].astype(np.int64)
        self.first = np.zeros(total + 1, np.int64)
        self.first[:inner] = 1 + np.cumsum(counts) - counts
        parent = np.repeat(np.arange(inner), counts)
        largest = np.append(_unpacked(maxima, total), 0)
        end = 1
        for n in sizes[1:]:
            largest[end : end + n] = largest[parent[end - 1 : end - 1 + n]] - largest[end : end + n]
            end += n
        self.largest = largest

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, least: int = 1, looked: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``(columns, sums)`` of all columns among the k largest weighted sums over the rows, ties with the last one included.

        Sums below ``least`` are left out, so are sums of 0. ``looked`` gets the number of states that were halved.
        """
        least = max(1, least)
        inside = rows >> self.height == 0
        rows, weights = rows[inside], weights[inside]
        exact = float(weights.sum()) * float(self.largest[0]) < 2.0**53
        weigh = weights.astype(float) if exact else weights.astype(np.int64)
        level, column, bound = np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([np.iinfo(np.int64).max])
        nodes = np.zeros((1, len(rows)), np.int64)
        got_columns, got_sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(level):
            if len(level) > WIDTH:
                at = np.argpartition(bound, len(bound) - WIDTH)
                rest, now = at[:-WIDTH], at[-WIDTH:]
            else:
                rest, now = np.zeros(0, np.int64), np.arange(len(level))
            if looked is not None:
                looked.append(len(now))
            quarter = ((rows[None, :] >> (self.height - 1 - level[now])[:, None]) & 1) * 2
            some = nodes[now]
            nibble, start = self.quarters[some], self.first[some]
            made = []
            for half in (0, 1):
                q = quarter + half
                child = np.where((nibble >> q) & 1, start + _BEFORE[nibble, q], self.none)
                sums = self.largest[child] @ weigh
                sums = sums.astype(np.int64) if exact else sums
                ok = sums >= least
                made.append((level[now][ok] + 1, column[now][ok] * 2 + half, sums[ok], child[ok]))
            new = [np.concatenate(x) for x in zip(*made)]
            done = new[0] == self.height
            if done.any():
                got_columns, got_sums = np.concatenate([got_columns, new[1][done]]), np.concatenate([got_sums, new[2][done]])
                if len(got_sums) >= k:
                    least = max(least, int(np.partition(got_sums, len(got_sums) - k)[len(got_sums) - k]))
                    kept = got_sums >= least
                    got_columns, got_sums = got_columns[kept], got_sums[kept]
            level, column, bound, nodes = (np.concatenate([old[rest], x[~done]]) for old, x in zip((level, column, bound, nodes), new))
            alive = bound >= least
            if not alive.all():
                level, column, bound, nodes = level[alive], column[alive], bound[alive], nodes[alive]
        return got_columns, got_sums
