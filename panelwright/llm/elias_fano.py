"""Elias-Fano sequences and the n-gram trie made of them."""

from __future__ import annotations

import os
import tempfile

import numpy as np

ABSENT = np.uint16(0xFFFF)
#: Steps of a quantised value in a factor of ten, and the power of ten of the largest value.
STEPS, LARGEST = 1250, 10
#: Added to the code of a pair's value, to tell it from a triple's.
PAIR = 0x8000


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def sorted_places(key: np.ndarray, top: int) -> np.ndarray:
    """The stable order of numbers from 0 to below top. Where number and place fit into 63 bits they are sorted as one."""
    bits = len(key).bit_length()
    if int(top) > 1 << (63 - bits):
        return np.argsort(key, kind="stable")
    both = (key.astype(np.int64) << bits) | np.arange(len(key))
    both.sort()
    return both & ((1 << bits) - 1)


def numbered(key: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of numbers from 0 to below top, in order, and the place of each number among them."""
    order = sorted_places(key, top)
    ranked = key[order]
    new = changes(ranked)
    at = np.empty(len(key), np.int64)
    at[order] = np.cumsum(new) - 1
    return ranked[new], at


class EliasFano:
    """A non-decreasing sequence of integers: low bits packed into words of 64 bits, high bits in unary."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.width, self.low = n, width, low
        bits = np.unpackbits(high, bitorder="little").view(bool)
        # The directory of the unary part, of four bytes a value, lives as long as its shard is asked.
        self.ones, self.zeros = (np.flatnonzero(x).astype(np.int32) for x in (bits, ~bits))

    @staticmethod
    def encoded(values: np.ndarray, universe: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        n = len(values)
        values = values.astype(np.int64)
        width = max(0, int(max(universe, 1) // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if n and width:
            at = np.arange(n, dtype=np.int64) * width
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            bits = (values & ((1 << width) - 1)).astype(np.uint64)
            # In every word up to the last one at least one value begins, as none has 64 bits.
            low[: word[-1] + 1] = np.bitwise_or.reduceat(bits << shift, np.flatnonzero(changes(word)))
            over = np.flatnonzero(shift + np.uint64(width) > 64)
            low[word[over] + 1] |= bits[over] >> (np.uint64(64) - shift[over])
        high = np.zeros(n + (max(universe, 1) >> width) + 2, np.uint8)
        high[(values >> width) + np.arange(n)] = 1
        return n, width, low, np.packbits(high, bitorder="little")

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = (self.low[word] >> shift) | ((self.low[word + 1] << (np.uint64(63) - shift)) << np.uint64(1))
        return out.view(np.int64) & ((1 << self.width) - 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        return ((self.ones[i].astype(np.int64) - i) << self.width) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Where x stands, by search for its successor among the values with its high bits; -1 if it doesn't."""
        if not self.n:
            return np.full(len(x), -1)
        h = np.minimum(x >> self.width, len(self.zeros) - 1)
        begin = np.where(h > 0, self.zeros[np.maximum(h - 1, 0)] - (h - 1), 0).astype(np.int64)
        stop = self.zeros[h] - h
        low = x & ((1 << self.width) - 1)
        places = np.flatnonzero(begin < stop)
        first, end, wanted = begin[places], stop[places], low[places]
        while places.size:
            mid = (first + end) >> 1
            less = self._low(mid) < wanted
            first, end = np.where(less, mid + 1, first), np.where(less, end, mid)
            begin[places] = first
            rest = np.flatnonzero(first < end)
            places, first, end, wanted = places[rest], first[rest], end[rest], wanted[rest]
        # Beyond the largest value no bucket has any, so equal low bits are enough.
        found = np.flatnonzero((begin < stop) & (x >= 0))
        out = np.full(len(x), -1)
        hit = found[self._low(begin[found]) == low[found]]
        out[hit] = begin[hit]
        return out


def quantised(x: np.ndarray) -> np.ndarray:
    """Codes of values from 1e-16 to 1e10, below PAIR, to within one part in 1000."""
    return np.clip(np.rint((LARGEST - np.log10(x)) * STEPS), 0, PAIR - 2).astype(np.uint16)


_RESTORED = 10.0 ** (LARGEST - np.arange(PAIR) / STEPS)


def restored(code: np.ndarray, absent: float = 0.0) -> np.ndarray:
    """Values of codes; those of pairs too."""
    return np.where(code == ABSENT, absent, _RESTORED[code & (PAIR - 1)])


def _in_order(v: np.ndarray, w: np.ndarray, u: np.ndarray) -> bool:
    """Whether rows never fall, by v, then w, then u."""
    a, b, c = (x[1:] > x[:-1] for x in (v, w, u))
    return bool((a | ((v[1:] == v[:-1]) & (b | ((w[1:] == w[:-1]) & (c | (u[1:] == u[:-1])))))).all())


class Trie:
    """Levels: context words v; their successors w; the words u before v, as ranks among all that precede v. Every
    level is an Elias-Fano sequence with monotone pointers into the next. Values are smoothed probabilities over the
    back-off weight of their context: a pair v w holds value2 = c(v w) / k2 + p1(w), and the back-off weight
    k3 / (c(v w) + k3) of v w as a context; a triple u v w holds c(u v w) / k3 + back1(v) value2. All are quantised.
    The levels lie in one file, which is memory-mapped and goes when the trie is closed."""

    def __init__(self, v: np.ndarray, w: np.ndarray, u: np.ndarray, count: np.ndarray, p1: np.ndarray, back1: np.ndarray, k2: float, k3: float) -> None:
        if not _in_order(v, w, u):
            order = np.lexsort((u, w, v))
            v, w, u, count, p1, back1 = (x[order] for x in (v, w, u, count, p1, back1))
        new1, new2 = changes(v), changes(v, w)
        new3 = changes(v, w, u)
        c3, c2 = (np.add.reduceat(count, np.flatnonzero(x)) if len(v) else count for x in (new3, new2))
        value2 = c2 / k2 + p1[new2]
        pair3 = (np.cumsum(new2) - 1)[new3]
        value3 = c3 / k3 + (back1[new2] * value2)[pair3]
        contexts = v[new1]
        rank1 = np.cumsum(new1) - 1
        self.top = int(max(u.max(initial=0), v.max(initial=0), w.max(initial=0))) + 1
        words, word2 = numbered(w[new2], self.top)
        self.n_words = max(1, len(words))
        context3 = rank1[new3]
        pairs, place = numbered(context3 * self.top + u[new3], len(contexts) * self.top)  # context and what precedes it
        starts = np.searchsorted(pairs, np.arange(len(contexts) + 1) * self.top)
        self.widest = int(np.diff(starts).max(initial=0)) + 1
        level2 = rank1[new2] * self.n_words + word2
        level3 = pair3 * self.widest + place - starts[context3]
        parts: list = []
        for values, universe in ((contexts, self.top), (words, self.top), (pairs, len(contexts) * self.top), (starts, len(pairs) + 1), (level2, len(contexts) * self.n_words), (level3, len(level2) * self.widest)):
            parts.append(EliasFano.encoded(values, int(universe) + 1))
        arrays = [a for p in parts for a in p[2:]] + [quantised(value2), quantised(k3 / (c2 + k3)), quantised(value3)]
        handle, self.path = tempfile.mkstemp(prefix="trie-")
        at, places = 0, []
        with os.fdopen(handle, "wb") as out:
            for a in arrays:
                gap = -at % 8  # words of 64 bits lie at multiples of 8
                out.write(bytes(gap) + a.tobytes())
                places.append((at + gap, a.dtype, len(a)))
                at += gap + a.nbytes
        mapped = np.asarray(np.memmap(self.path, np.uint8, "r") if at else np.zeros(0, np.uint8))
        views = [mapped[b : b + n * d.itemsize].view(d) for b, d, n in places]
        self.bytes = at
        self.contexts, self.words, self.pairs, self.starts, self.level2, self.level3 = (EliasFano(p[0], p[1], views[2 * k], views[2 * k + 1]) for k, p in enumerate(parts))
        self.value2, self.back2, self.value3 = views[-3:]

    def codes(self, v: np.ndarray, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each u v w the code of the longest match, of u v w or else (PAIR more) of v w, and that of the back-off weight of v w."""
        # Neighbours with the same v, or the same v w, are looked up once.
        new1, new2 = changes(v), changes(v, w)
        pair_of = np.cumsum(new2) - 1
        context1 = self.contexts.find(v[new1])
        context = context1[(np.cumsum(new1) - 1)[new2]]
        word = self.words.find(w[new2])
        known = np.flatnonzero((context >= 0) & (word >= 0))
        i2 = np.full(len(context), -1)
        i2[known] = self.level2.find(context[known] * self.n_words + word[known])
        seen = np.flatnonzero(i2 >= 0)
        value2, back = np.full(len(context), ABSENT), np.full(len(context), ABSENT)
        value2[seen], back[seen] = self.value2[i2[seen]] + np.uint16(PAIR), self.back2[i2[seen]]
        value, ok = value2[pair_of], np.flatnonzero((i2 >= 0)[pair_of])
        at = pair_of[ok]
        pair = self.pairs.find(context[at] * self.top + u[ok])
        met = pair >= 0
        ok, pair, at = ok[met], pair[met], at[met]
        begin = np.zeros(len(context), np.int64)
        begin[seen] = self.starts.at(context[seen])
        i3 = self.level3.find(i2[at] * self.widest + pair - begin[at])
        value[ok[i3 >= 0]] = self.value3[i3[i3 >= 0]]
        return value, back[pair_of]

    def close(self) -> None:
        os.unlink(self.path)
