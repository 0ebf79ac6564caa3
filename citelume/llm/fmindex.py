"""An FM-index over a sequence of small integers: suffix order, wavelet matrix, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: 64-bit words and the number of ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, "<u8")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, low = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << low) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """A wavelet matrix: one bit vector for each bit of a symbol, the highest first, zeros moved ahead of ones."""

    def __init__(self, symbols: np.ndarray, width: int) -> None:
        self.levels: list[tuple[Bits, int]] = []
        self.width = width
        for shift in range(width - 1, -1, -1):
            bit = ((symbols >> shift) & 1).astype(bool)
            self.levels.append((Bits(bit), int((~bit).sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol stands before position `at`, for each pair."""
        lo, hi = np.zeros_like(at), at.copy()
        for level, (bits, zeros) in enumerate(self.levels):
            one = ((symbol >> (self.width - 1 - level)) & 1).astype(bool)
            a, b = bits.rank(lo), bits.rank(hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def get(self, at: np.ndarray) -> np.ndarray:
        at, symbol = at.copy(), np.zeros(len(at), np.int64)
        for bits, zeros in self.levels:
            one, ones = bits.get(at).astype(bool), bits.rank(at)
            symbol = symbol << 1 | one
            at = np.where(one, zeros + ones, at - ones)
        return symbol


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by doubling the compared prefix; text ends in a symbol that occurs once."""
    rank, n, k = np.unique(text, return_inverse=True)[1].astype(np.int64), len(text), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k if k < n else 0] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        step = np.zeros(n, np.int64)
        step[1:] = key[order[1:]] != key[order[:-1]]
        new = np.cumsum(step)
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


class FMIndex:
    """text: symbols from 1 on, 1 a separator that no pattern holds; every `sample`-th position is kept."""

    def __init__(self, text: np.ndarray, sample: int = 16) -> None:
        text = np.append(text.astype(np.int64), 0)
        order = suffix_order(text)
        self.n, self.sample = len(text), sample
        last = text[order - 1]
        top = int(text.max())
        self.first = np.zeros(top + 2, np.int64)  # rows whose suffix begins with a smaller symbol
        np.cumsum(np.bincount(text, minlength=top + 1), out=self.first[1:])
        self.wavelet = Wavelet(last, max(1, top.bit_length()))
        kept = order % sample == 0
        self.marks, self.positions = Bits(kept), order[kept]
        self.top = top

    def search(self, words: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [lo, hi) of the patterns words[start : start + length], by backward search."""
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64)
        live = np.arange(len(starts))
        for column in range(length - 1, -1, -1):
            c = words[starts[live] + column].astype(np.int64)
            here = c <= self.top
            hi[live[~here]] = 0
            live, c = live[here], c[here]
            a = self.first[c] + self.wavelet.rank(c, lo[live])
            b = self.first[c] + self.wavelet.rank(c, hi[live])
            lo[live], hi[live] = a, b
            live = live[b > a]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a sampled position, counted."""
        out, steps, at, row = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(at):
            marked = self.marks.get(row).astype(bool)
            out[at[marked]] = self.positions[self.marks.rank(row[marked])] + steps
            at, row = at[~marked], row[~marked]
            symbol = self.wavelet.get(row)
            row = self.first[symbol] + self.wavelet.rank(symbol, row)
            steps += 1
        return out
