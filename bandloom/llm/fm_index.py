"""An FM-index over word numbers: suffix array, wavelet matrix, backward search and sampled positions, all on numpy arrays."""

from __future__ import annotations

import numpy as np

#: Every so many positions of the text keep their place in the index; others are walked back to one of them.
SAMPLE = 8


class _Bits:
    """A bit vector with counts: packed words and the number of ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """A wavelet matrix over small non-negative numbers: the symbol at a place, and how often it stands before a place."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        self.levels: list[tuple[int, _Bits, int]] = []
        for shift in reversed(range(max(1, int(top).bit_length()))):
            bits = ((symbols >> shift) & 1).astype(np.uint8)
            zeros = symbols[bits == 0]
            self.levels.append((shift, _Bits(bits), len(zeros)))
            symbols = np.concatenate([zeros, symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        start = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            a, b = bits.ones(start), bits.ones(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at position i, how often it stands before i)."""
        symbol, start, place = np.zeros_like(i), np.zeros_like(i), i
        for shift, bits, zeros in self.levels:
            one = bits.at(place) == 1
            symbol |= one.astype(np.int64) << shift
            a, b = bits.ones(start), bits.ones(place)
            start, place = np.where(one, zeros + a, start - a), np.where(one, zeros + b, place - b)
        return symbol, place - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling; each 0 is a separator, smaller than all words and than later separators."""
    n = len(text)
    stops = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(stops)
    rank[stops] = np.arange(len(stops))
    step = 1
    while True:
        following = np.zeros(n, dtype=np.int64)
        following[: n - step] = rank[step:] + 1
        key = rank * np.int64(max(n, int(rank.max(initial=0))) + 2) + following
        order = np.argsort(key, kind="stable")
        in_order = key[order]
        new = np.r_[0, np.cumsum(in_order[1:] != in_order[:-1])]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if not n or new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """text: word numbers from 1; 0 separates runs and ends the text."""

    def __init__(self, text: np.ndarray, words: int) -> None:
        order = suffix_array(text)
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=words + 1))]
        self.wavelet = Wavelet(text[order - 1].astype(np.int64), words)
        # the start of a run is always kept: a walk back never has to cross a separator
        kept = (order % SAMPLE == 0) | (text[order - 1] == 0)
        self.kept = _Bits(kept.astype(np.uint8))
        self.places = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index intervals of all patterns (rows of word numbers, filled up on the right), searched backward together."""
        n = self.first[-1]
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), n)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (lo < hi))
            word = patterns[live, lengths[live] - back]
            lo[live] = self.first[word] + self.wavelet.rank(word, lo[live])
            hi[live] = self.first[word] + self.wavelet.rank(word, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows: walk back to a kept position, then add the steps."""
        out, at, steps, open_ = np.zeros(len(rows), dtype=np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(open_):
            here = self.kept.at(at) == 1
            out[open_[here]] = self.places[self.kept.ones(at[here])] + steps
            open_, at = open_[~here], at[~here]
            if len(open_):
                word, before = self.wavelet.access(at)
                at = self.first[word] + before
            steps += 1
        return out
