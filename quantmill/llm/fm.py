"""An FM-index over a sequence of small integers, in numpy: wavelet matrix, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. The symbol 0 separates: each 0 is a symbol of its own, ordered by its place and below all
    others, so no comparison goes beyond it, and the rounds are logarithmic in the longest run without a 0."""
    n = len(text)
    zero = text == 0
    rank = np.empty(n, np.int64)
    rank[zero] = np.arange(int(zero.sum()))
    rank[~zero] = text[~zero].astype(np.int64) + n
    step = 1
    order = np.argsort(rank, kind="stable")
    rank = _ranks(rank[order], order)
    while n and rank.max() < n - 1:
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:] + 1
        both = rank * (n + 1) + nxt
        order = np.argsort(both, kind="stable")
        rank = _ranks(both[order], order)
        step *= 2
    return order


def _ranks(in_order: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.append(0, in_order[1:] != in_order[:-1])) if len(order) else 0
    return out


class Bits:
    """A bit vector with rank in constant time."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.append(0, np.cumsum(np.bitwise_count(words).astype(np.int64)))

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class Wavelet:
    """A wavelet matrix: rank and access over an alphabet of any size by one bit vector per bit."""

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        t = text.astype(np.int64)
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            b = ((t >> bit) & 1).astype(np.bool_)
            zeros = int((~b).sum())
            self.levels.append((bit, Bits(b), zeros))
            t = np.concatenate([t[~b], t[b]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before place i."""
        lo, hi = np.zeros_like(i), i
        for bit, bits, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(np.bool_)
            l1, h1 = bits.rank1(lo), bits.rank1(hi)
            lo = np.where(one, zeros + l1, lo - l1)
            hi = np.where(one, zeros + h1, hi - h1)
        return hi - lo

    def get(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for bit, bits, zeros in self.levels:
            b = bits.get(i)
            one = bits.rank1(i)
            i = np.where(b == 1, zeros + one, i - one)
            out |= b << bit
        return out


class FMIndex:
    """``text`` holds 1 .. sigma - 1, and 0 as separator; its first symbol must be 0."""

    SAMPLE = 16

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        sa = suffix_array(text)
        self.n = len(text)
        self.bwt = Wavelet(text[sa - 1], sigma)
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=sigma)))
        # sampled places: every SAMPLE-th, and all that follow a separator, so that no walk crosses one
        sampled = (sa % self.SAMPLE == 0) | (text[sa - 1] == 0)
        self.sampled = Bits(sampled)
        self.places = sa[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that start with each phrase; a row of ``phrases`` holds a phrase from its left."""
        k = len(phrases)
        lo, hi = np.zeros(k, np.int64), np.full(k, self.n, np.int64)
        for j in range(int(lengths.max(initial=0)) - 1, -1, -1):
            use = np.flatnonzero((j < lengths) & (lo < hi))
            if not len(use):
                continue
            c = phrases[use, j].astype(np.int64)
            lo[use] = self.first[c] + self.bwt.rank(c, lo[use])
            hi[use] = self.first[c] + self.bwt.rank(c, hi[use])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the text of suffixes given by row: steps back until a sampled one."""
        out = np.full(len(rows), -1, np.int64)
        steps = np.zeros(len(rows), np.int64)
        at, row = np.arange(len(rows)), rows.copy()
        while len(at):
            done = self.sampled.get(row) == 1
            out[at[done]] = self.places[self.sampled.rank1(row[done])] + steps[at[done]]
            at, row = at[~done], row[~done]
            c = self.bwt.get(row)
            row = self.first[c] + self.bwt.rank(c, row)
            steps[at] += 1
        return out
