"""Suffix arrays of byte strings by induced sorting, and their permuted common prefixes.

All steps work on whole numpy arrays. Inducing goes by buckets of the first symbol. A large
bucket is a step of its own, where what it induces into itself (runs of one symbol) needs one
more step each. Small buckets that follow one another are a step together: what they induce
among themselves is found first and put in order by rank, and all that they induce beyond goes
to its places at once. So the reduced string, whose symbols are very many and rare, is sorted by
the same function, as often as it has equal names.

The strings of a shard are joined by separators that match nothing.
"""

from __future__ import annotations

import numpy as np

#: Suffixes of the buckets that are a step together.
TOGETHER = 4096


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next (S); the last symbol is the least and S."""
    n = len(text)
    rises, turns = np.ones(n, bool), np.arange(n)
    rises[:-1] = text[:-1] < text[1:]
    turns[:-1][text[:-1] == text[1:]] = n
    return rises[np.minimum.accumulate(turns[::-1])[::-1]]


class _Inducer:
    """Places for all suffixes, from the order of the leftmost-smaller ones."""

    def __init__(self, text: np.ndarray, smaller: np.ndarray, symbols: int):
        self.text, self.smaller = text, smaller
        counts = np.bincount(text, minlength=symbols)
        self.ends = np.cumsum(counts)
        self.heads = self.ends - counts

    def _dealt(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes by first symbol, each with its number among those of the symbol."""
        symbol = self.text[found]
        order = np.argsort(symbol, kind="stable")
        symbol = symbol[order]
        first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        sizes = np.diff(np.append(first, len(symbol)))
        nth = np.arange(len(symbol)) - np.repeat(first, sizes)
        return found[order], symbol, nth, symbol[first], sizes

    def _steps(self) -> list[tuple[int, int]]:
        """Ranges of symbols that are taken together."""
        present = np.flatnonzero(self.ends > self.heads)
        group = self.heads[present] // TOGETHER
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        last = np.append(first[1:], len(present)) - 1
        return list(zip(present[first].tolist(), (present[last] + 1).tolist(), strict=True))

    @staticmethod
    def _inside(start: np.ndarray, induced) -> tuple[np.ndarray, np.ndarray, int]:
        """(suffixes, parents, steps) that ``start`` induces into its own buckets, directly or not;
        parents are places in start and the suffixes before."""
        found, parents, block, at, steps = [], [], start, 0, 0
        while True:
            made, parent = induced(block)
            if not len(made):
                break
            steps += 1
            found.append(made)
            parents.append(parent + at)
            at += len(block)
            block = made
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        return np.concatenate(found), np.concatenate(parents), steps

    @staticmethod
    def _ranked(base: np.ndarray, parents: np.ndarray, known: int, steps: int) -> np.ndarray:
        """Order of a step's suffixes: by ``base`` (bucket and kind), then, for the known ones, as they
        stand, and for the others as their parents; rounds reach twice as far each."""
        n = len(base)
        up = np.concatenate([np.arange(known), parents])
        second = np.where(np.arange(n) < known, np.arange(n), 0)
        order, reach = np.lexsort((second, base)), 1
        while steps:
            new = np.ones(n, bool)
            new[1:] = (base[order][1:] != base[order][:-1]) | (second[order][1:] != second[order][:-1])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            base, second = rank, rank[up]
            order = np.lexsort((second, base))
            if reach > steps:
                break
            up, reach = up[up], 2 * reach
        return order

    def order(self, leftmost: np.ndarray) -> np.ndarray:
        """leftmost: the leftmost-smaller suffixes in their order (within a symbol at least)."""
        text, smaller = self.text, self.smaller
        out = np.full(len(text), -1, np.int32)
        at = self.heads.copy()
        steps = self._steps()

        def forward(block: np.ndarray) -> None:
            found = block[block > 0] - 1
            found = found[~smaller[found]]
            if len(found):
                found, symbol, nth, kinds, sizes = self._dealt(found)
                out[at[symbol] + nth] = found
                at[kinds] += sizes

        cut = np.searchsorted(text[leftmost], np.arange(len(self.heads) + 1))

        def forward_one(c: int) -> None:
            done = self.heads[c]
            while done < at[c]:
                block = out[done : at[c]]
                done = at[c]
                forward(block)
            if cut[c] < cut[c + 1]:
                forward(leftmost[cut[c] : cut[c + 1]])

        def forward_some(low: int, high: int) -> None:
            region = out[self.heads[low] : self.ends[high - 1]]
            placed, own = region[region >= 0].astype(np.int64), leftmost[cut[low] : cut[high]].astype(np.int64)
            start = np.concatenate([placed, own])

            def induced(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                parent = np.flatnonzero(block > 0)
                made = block[parent] - 1
                kept = ~smaller[made] & (text[made] < high)
                return made[kept], parent[kept]

            made, parents, depth = self._inside(start, induced)
            every = np.concatenate([start, made])
            kind = np.concatenate([np.zeros(len(placed), np.int64), np.full(len(own), 2), np.ones(len(made), np.int64)])
            order = self._ranked(text[every].astype(np.int64) * 3 + kind, parents, len(start), depth)
            scan = every[order]
            larger = scan[kind[order] < 2]
            if len(larger):
                larger, symbol, nth, kinds, sizes = self._dealt(larger)
                out[self.heads[symbol] + nth] = larger
                at[kinds] = self.heads[kinds] + sizes
            forward(scan[(scan > 0) & (text[scan - 1] >= high)])

        for low, high in steps:
            if high - low == 1:
                forward_one(low)
            else:
                forward_some(low, high)
        larger_end, back = at, self.ends.copy()

        def backward(block: np.ndarray) -> None:
            found = block[block > 0] - 1
            found = found[smaller[found]]
            if len(found):
                found, symbol, nth, kinds, sizes = self._dealt(found)
                out[back[symbol] - 1 - nth] = found
                back[kinds] -= sizes

        def backward_one(c: int) -> None:
            done = self.ends[c]
            while done > back[c]:
                block = out[back[c] : done][::-1]
                done = back[c]
                backward(block)
            backward(out[self.heads[c] : larger_end[c]][::-1])

        def backward_some(low: int, high: int) -> None:
            region = out[self.heads[low] : self.ends[high - 1]][::-1]
            start = region[region >= 0].astype(np.int64)

            def induced(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                parent = np.flatnonzero(block > 0)
                made = block[parent] - 1
                kept = smaller[made] & (text[made] >= low)
                return made[kept], parent[kept]

            made, parents, depth = self._inside(start, induced)
            every = np.concatenate([start, made])
            kind = np.concatenate([np.where(smaller[start], 0, 2), np.ones(len(made), np.int64)])
            order = self._ranked(kind - text[every].astype(np.int64) * 3, parents, len(start), depth)
            scan = every[order]
            small = scan[kind[order] < 2]
            if len(small):
                small, symbol, nth, kinds, sizes = self._dealt(small)
                out[self.ends[symbol] - 1 - nth] = small
                back[kinds] = self.ends[kinds] - sizes
            backward(scan[(scan > 0) & (text[scan - 1] < low)])

        for low, high in reversed(steps):
            if high - low == 1:
                backward_one(low)
            else:
                backward_some(low, high)
        out[0] = len(text) - 1
        return out


def _names(text: np.ndarray, ordered: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """A number for each sorted leftmost-smaller substring; equal ones get the same."""
    following = np.full(len(text), len(text) - 1, np.int64)
    following[leftmost[:-1]] = leftmost[1:]
    length = following[ordered] - ordered + 1
    new = np.ones(len(ordered), bool)
    a, b = ordered[:-1].astype(np.int64), ordered[1:].astype(np.int64)
    alike = np.flatnonzero(length[1:] == length[:-1])
    off = 0
    while len(alike):
        alike = alike[text[a[alike] + off] == text[b[alike] + off]]
        off += 1
        whole = length[1:][alike] <= off
        new[1:][alike[whole]] = False
        alike = alike[~whole]
    return np.cumsum(new) - 1


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Suffixes of ``text`` in order.

    text: numbers below ``symbols``; the last is 0 and occurs once.
    """
    smaller = _types(text)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if not len(leftmost):  # the last symbol alone
        return np.zeros(1, np.int32)
    inducer = _Inducer(text, smaller, symbols)
    sorted_once = inducer.order(leftmost[np.argsort(text[leftmost], kind="stable")])
    is_leftmost = np.zeros(len(text), bool)
    is_leftmost[leftmost] = True
    ordered = sorted_once[is_leftmost[sorted_once]]
    names = _names(text, ordered, leftmost)
    count = int(names[-1]) + 1
    if count < len(leftmost):
        named = np.empty(len(text), np.int64)
        named[ordered] = names
        reduced = named[leftmost]
        ordered = leftmost[suffix_array(reduced.astype(np.int32), count)]
    return inducer.order(ordered)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix, in order of the text, how much it shares with the suffix sorted before it.

    Only where the two don't go on from their predecessors are symbols compared; from there on
    the length falls by one at each step.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    head = np.ones(n, bool)
    head[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0) | (text[:-1] != text[before[:-1]])
    heads = np.flatnonzero(head & (before >= 0))
    two = np.empty(n + 1, np.int64)
    two[:n] = text.astype(np.int64) << 32
    two[: n - 1] |= text[1:].astype(np.int64) & 0xFFFFFFFF
    two[n - 1 :] = -1
    length = np.zeros(n, np.int64)
    a, b, active, off = heads, before[heads], np.arange(len(heads)), 0
    shared = np.zeros(len(heads), np.int64)
    while len(active):
        x, y = a[active] + off, b[active] + off
        inside = (x < n - 1) & (y < n - 1)
        active, x, y = active[inside], x[inside], y[inside]
        same = two[x] == two[y]
        half = ~same & (text[x] == text[y])
        shared[active[half]] = off + 1
        active = active[same]
        off += 2
        shared[active] = off
    length[heads] = shared
    # from a head on
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    return np.where(before >= 0, np.maximum(length[start] - (np.arange(n) - start), 0), 0)


def later_copies(pieces: list[bytes], depth: int) -> np.ndarray:
    """For the pieces joined with one place after each: True where a ``depth``-byte string begins
    that also begins at an earlier place of the joined text."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes + 1) - 1
    n = int(ends[-1]) + 2
    joined = np.frombuffer(b"\0".join(pieces) + b"\0\0", np.uint8)
    text = joined.astype(np.uint16) + 2
    text[ends] = 1
    text[n - 1] = 0
    order = suffix_array(text, 258)
    apart = text.astype(np.int32)
    apart[ends] = -1 - np.arange(len(ends), dtype=np.int32)
    shares = common_prefixes(apart, order)[order] >= depth
    group = np.flatnonzero(~shares)
    least = np.minimum.reduceat(order, group)
    copies = np.zeros(n, bool)
    copies[order] = order != np.repeat(least, np.diff(np.append(group, n)))
    return copies[: n - 1]
