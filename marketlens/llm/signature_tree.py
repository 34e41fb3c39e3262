"""Signature trees: nodes hold OR-combined bitmaps and size ranges of the sets below them.

A bitmap has one bit per hashed element, so two sets share at most as many elements as
their bitmaps share bits, plus the elements that fell on a bit already taken
(``excess``). For two nodes the bits shared by the combined bitmaps, the largest excess
and the largest sizes bound the overlap of every pair of sets below them, and a pair of
nodes whose bound can't reach the wanted similarity is left out with all below it.

Only groups of connected sets are asked for, so pairs that earlier links connect are
left out as well: a group of n near copies needs about n comparisons, not n squared.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

FANOUT = 8


def width_of(size: int) -> int:
    """Bits of the bitmap of a set: a power of two near its size, 64 at least."""
    return max(64, 1 << (size - 1).bit_length()) if size else 64


def folded(bitmap: int, width: int, to: int) -> int:
    """The bitmap of the same set with fewer bits."""
    while width > to:
        width >>= 1
        bitmap = (bitmap >> width) | (bitmap & ((1 << width) - 1))
    return bitmap


class Forest:
    """Connected groups of numbered things."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


class Node:
    __slots__ = ("bitmap", "children", "excess", "high", "item", "low", "one")

    def __init__(self, bitmap: int, low: int, high: int, excess: int, item: int, children: Sequence["Node"] = ()):
        self.bitmap, self.low, self.high, self.excess, self.item, self.children = bitmap, low, high, excess, item, children
        self.one = not children


def grow(items: Sequence[int], sizes: Sequence[int], bitmaps: Sequence[int]) -> Node:
    """Tree over items in order of size, then bitmap, so that like sets share nodes."""
    level = [Node(bitmaps[i], sizes[i], sizes[i], sizes[i] - bitmaps[i].bit_count(), i) for i in sorted(items, key=lambda i: (sizes[i], bitmaps[i], i))]
    while len(level) > 1:
        above = []
        for start in range(0, len(level), FANOUT):
            part = level[start : start + FANOUT]
            bitmap = 0
            for node in part:
                bitmap |= node.bitmap
            above.append(Node(bitmap, part[0].low, max(n.high for n in part), max(n.excess for n in part), part[0].item, part))
        level = above
    return level[0]


class Search:
    """Dual traversal that joins sets of at least ``percent`` Jaccard similarity in ``forest``."""

    def __init__(self, forest: Forest, percent: int, confirm: Callable[[int, int], bool] | None = None):
        self.forest, self.percent, self.confirm = forest, percent, confirm
        self.links: list[tuple[int, int]] = []

    def possible(self, a: Node, b: Node) -> bool:
        p = self.percent
        if 100 * a.high < p * b.low or 100 * b.high < p * a.low:
            return False
        most = min(a.high, b.high, (a.bitmap & b.bitmap).bit_count() + min(a.excess, b.excess))
        return (100 + p) * most >= p * (a.low + b.low)

    def within(self, node: Node) -> None:
        for child in node.children:
            if child.children:
                self.within(child)
        for i, a in enumerate(node.children):
            for b in node.children[i + 1 :]:
                self.between(a, b)
        self._settle(node)

    def between(self, a: Node, b: Node) -> None:
        find = self.forest.find
        if a.one and b.one and find(a.item) == find(b.item) or not self.possible(a, b):
            return
        if not a.children and not b.children:
            if self.confirm is None or self.confirm(a.item, b.item):
                self.forest.join(a.item, b.item)
                self.links.append((a.item, b.item))
            return
        if not b.children or a.children and a.high - a.low >= b.high - b.low:
            for child in a.children:
                self.between(child, b)
        else:
            for child in b.children:
                self.between(a, child)

    def _settle(self, node: Node) -> None:
        """Marks a node below which all sets are connected by now."""
        find = self.forest.find
        node.one = all(c.one for c in node.children) and len({find(c.item) for c in node.children}) == 1


def connect(sizes: Sequence[int], bitmaps: Sequence[int], percent: int, confirm: Callable[[int, int], bool] | None = None, forest: Forest | None = None) -> Search:
    """Joins all sets that reach the similarity; without ``confirm`` all whose bound reaches it.

    Sets are dealt to trees by the width of their bitmaps; a similarity above one half
    can only join sets of the same or of neighbouring widths.
    """
    if percent <= 50:
        raise ValueError("the similarity must be above one half")
    search = Search(forest or Forest(len(sizes)), percent, confirm)
    by_width: dict[int, list[int]] = {}
    for i, size in enumerate(sizes):
        by_width.setdefault(width_of(size), []).append(i)
    trees = {w: grow(items, sizes, bitmaps) for w, items in by_width.items()}
    for w, tree in trees.items():
        search.within(tree)
        if 2 * w in trees:
            narrow = {i: folded(bitmaps[i], 2 * w, w) for i in by_width[2 * w]}
            search.between(tree, grow(by_width[2 * w], sizes, narrow))
    return search
