"""Byte context trees in flat arrays, shared by language identification and language-model scoring.

Text becomes a stream of small symbol classes; the context of a position is the run of symbols before it, padded with
class 0 at a text's start.  A tree holds contexts of up to ``depth`` symbols; looking up the longest context that the
tree has is a chain of ``depth`` array gathers over a whole batch, and costs are one more gather.
"""

from __future__ import annotations

import numpy as np

PAD = 0
CHUNK = 1 << 19


class Alphabet:
    """Classes of bytes: 0 is padding, 1 the end of a text, 2 every byte not listed, 3.. the listed bytes."""

    END, OTHER = 1, 2

    def __init__(self, common: list[int], fold: bool = True):
        self.table = np.full(256, self.OTHER, dtype=np.uint8)
        for k, b in enumerate(common):
            self.table[b] = 3 + k
        if fold:
            self.table[65:91] = self.table[97:123]
        self.size = 3 + len(common)
        self.others = int((self.table == self.OTHER).sum()) or 1

    @classmethod
    def of_counts(cls, counts: np.ndarray, most: int, fold: bool = True) -> Alphabet:
        counts = np.array(counts, dtype=np.int64)
        if fold:
            counts[97:123] += counts[65:91]
            counts[65:91] = 0
        order = np.argsort(-counts, kind="stable")[:most]
        return cls(sorted(int(b) for b in order if counts[b]), fold)


def contexts(sym: np.ndarray, offsets: np.ndarray, depth: int) -> list[np.ndarray]:
    """For d = 1..depth the symbol d places earlier in the same text, else padding."""
    out, n = [], len(sym)
    first, last = offsets[:-1], offsets[1:]
    for d in range(1, depth + 1):
        c = np.zeros(n, dtype=np.uint8)
        c[d:] = sym[: max(0, n - d)]
        for j in range(d):
            c[(first + j)[first + j < last]] = PAD
        out.append(c)
    return out


def gram_codes(sym: np.ndarray, ctx: list[np.ndarray], size: int) -> np.ndarray:
    """One integer for each position: its symbol in the lowest digit, then the context, the nearest symbol first."""
    code = np.zeros(len(sym), dtype=np.int64)
    for c in reversed(ctx):
        code = code * size + c
    return code * size + sym


class GramCounts:
    """Counts of integers, merged now and then so that memory follows the distinct values."""

    def __init__(self, merge_at: int = 4_000_000):
        self.merge_at, self.parts, self.held = merge_at, [], 0

    def add(self, values: np.ndarray) -> None:
        keys, n = np.unique(values, return_counts=True)
        self.parts.append((keys, n.astype(np.int64)))
        self.held += len(keys)
        if self.held > self.merge_at:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = np.concatenate([k for k, _ in self.parts])
        n = np.concatenate([c for _, c in self.parts])
        own, where = np.unique(keys, return_inverse=True)
        total = np.zeros(len(own), np.int64)
        np.add.at(total, where, n)
        self.parts, self.held = [(own, total)], len(own)
        return self.parts[0]

    def full(self) -> bool:
        return len(self.parts) == 1 and self.held > self.merge_at // 2

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.merge()
        self.parts, self.held = [], 0
        return out


class ContextTree:
    """The contexts that are kept, numbered by depth from the root (node 0); a context is kept only with all its suffixes.

    ``codes[d]`` has the sorted context codes of depth d (nearest symbol in the lowest digit); ``child`` maps
    node * size + symbol to the node that is one symbol longer, or -1.  ``costs`` (node, symbol, column) is set by the model.
    """

    def __init__(self, size: int, wanted: list[np.ndarray]):
        self.size, self.depth = size, len(wanted) - 1
        self.codes, self.base, parents = [np.zeros(1, np.int64)], [0], [np.full(1, -1)]
        links = []
        for d in range(1, self.depth + 1):
            code = np.unique(wanted[d])
            tail = code % size ** (d - 1)
            at = np.minimum(np.searchsorted(self.codes[-1], tail), len(self.codes[-1]) - 1) if len(self.codes[-1]) else np.zeros(len(code), np.int64)
            has = self.codes[-1][at] == tail if len(self.codes[-1]) else np.zeros(len(code), bool)
            code, parent = code[has], self.base[-1] + at[has]
            base = self.base[-1] + len(self.codes[-1])
            links.append((parent * size + code // size ** (d - 1), base + np.arange(len(code))))
            self.codes.append(code)
            self.base.append(base)
            parents.append(parent)
        self.parent = np.concatenate(parents)
        self.child = np.full(len(self.parent) * size, -1, dtype=np.int32)
        for slot, node in links:
            self.child[slot] = node
        self.costs = np.zeros((len(self.parent), size, 1), np.float32)

    def place(self, d: int, codes: np.ndarray) -> np.ndarray:
        """Nodes of these context codes of depth d, -1 for those not kept."""
        own = self.codes[d]
        if not len(own):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(own, codes), len(own) - 1)
        return np.where(own[at] == codes, self.base[d] + at, -1)

    def layers(self) -> list[slice]:
        """The nodes of each depth, so that parents can be worked on before their children."""
        return [slice(b, b + len(c)) for b, c in zip(self.base, self.codes, strict=True)]

    def nodes(self, ctx: list[np.ndarray], n: int) -> np.ndarray:
        """The node of the longest context kept, for each position."""
        node = np.zeros(n, dtype=np.int64)
        live: np.ndarray | None = None
        for c in ctx:
            if live is None:
                nxt = self.child[c]
                live = np.flatnonzero(nxt >= 0)
                node[live] = nxt[live]
            else:
                nxt = self.child[node[live] * self.size + c[live]]
                hit = nxt >= 0
                live = live[hit]
                node[live] = nxt[hit]
        return node

    def sums(self, sym: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Summed costs of each text's symbols; one column for each column of the costs."""
        size, wide = self.size, self.costs.shape[2]
        flat = self.costs.reshape(-1, wide)
        out = np.zeros((len(offsets) - 1, wide))
        ctx = contexts(sym, offsets, self.depth)
        for a in range(0, len(sym), CHUNK):
            b = min(len(sym), a + CHUNK)
            node = self.nodes([c[a:b] for c in ctx], b - a)
            node *= size
            node += sym[a:b]
            cost = flat[node]
            rows = np.arange(np.searchsorted(offsets, a, side="right") - 1, np.searchsorted(offsets, b - 1, side="right"))
            begin, end = np.maximum(offsets[rows], a), np.minimum(offsets[rows + 1], b)
            some = end > begin
            out[rows[some]] += np.add.reduceat(cost, begin[some] - a, axis=0, dtype=np.float64)
        return out
