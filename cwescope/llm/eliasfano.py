"""Elias-Fano lists and the bigram trie that a task builds for its shard.

Everything is flat arrays, so a trie is a set of memory-mapped files and
queries are vectorised over them.
"""

from __future__ import annotations

import os

import numpy as np

from cwescope.llm.common import ship

ship(__name__)

ONE = np.uint64(1)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` low bits of each value, one after the other, and 8 bytes more."""
    out = np.zeros((len(values) * width + 7) // 8 + 8, np.uint8)
    step = 1 << 18  # a multiple of 8 values ends on a whole byte
    for lo in range(0, len(values), step):
        part = values[lo:lo + step].astype(np.uint64)
        bits = ((part[:, None] >> np.arange(width, dtype=np.uint64)) & ONE).astype(np.uint8)
        packed = np.packbits(bits.reshape(-1), bitorder="little")
        at = lo * width // 8
        out[at:at + len(packed)] = packed
    return out


def unpack_bits(packed: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    """The values at ``index``; width is at most 56."""
    if not width:
        return np.zeros(len(index), np.uint64)
    bit = index.astype(np.int64) * width
    at = bit >> 3
    word = np.zeros(len(index), np.uint64)
    for k in range(8):
        word |= packed[at + k].astype(np.uint64) << np.uint64(8 * k)
    return (word >> (bit & 7).astype(np.uint64)) & ((ONE << np.uint64(width)) - ONE)


class EliasFano:
    """A non-decreasing list of integers: low bits packed, high bits in unary,
    with the running count of ones per 64-bit word."""

    def __init__(self, width: int, size: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.width, self.size, self.low, self.high, self.ones = width, size, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        heads = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        words = np.zeros((int(heads[-1]) if n else 0) // 64 + 2, np.uint64)
        np.bitwise_or.at(words, heads >> 6, ONE << (heads & 63).astype(np.uint64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
        return cls(width, n, pack_bits(values, width), words, ones)

    def _in_word(self, word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Place of the set bit number ``rank`` (from 0) of each word."""
        place = np.zeros(len(word), np.uint64)
        rank = rank.astype(np.uint64)
        for step in (32, 16, 8, 4, 2, 1):
            step = np.uint64(step)
            count = np.bitwise_count(word & ((ONE << step) - ONE)).astype(np.uint64)
            right = rank >= count
            rank = np.where(right, rank - count, rank)
            place += np.where(right, step, np.uint64(0))
            word = np.where(right, word >> step, word)
        return place.astype(np.int64)

    def access(self, index: np.ndarray) -> np.ndarray:
        """Values at the given places."""
        word = np.searchsorted(self.ones, index, side="right") - 1
        head = word * 64 + self._in_word(self.high[word], index - self.ones[word]) - index
        return (head.astype(np.uint64) << np.uint64(self.width)) | unpack_bits(self.low, index, self.width)

    def _starts(self, head: np.ndarray) -> np.ndarray:
        """Number of values whose high part is below ``head``."""
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        want = head - 1  # values below follow from the zero that closes the high part before
        inside = want < zeros[-1]
        safe = np.clip(want, 0, zeros[-1] - 1)
        word = np.searchsorted(zeros, safe, side="right") - 1
        place = word * 64 + self._in_word(~self.high[word], safe - zeros[word])
        return np.where(want < 0, 0, np.where(inside, place - safe, self.size))

    def find(self, values: np.ndarray) -> np.ndarray:
        """First place whose value is not less: the successor's place."""
        values = values.astype(np.uint64)
        head = (values >> np.uint64(self.width)).astype(np.int64)
        top = (len(self.high) + 1) * 64
        at, end = self._starts(np.minimum(head, top)), self._starts(np.minimum(head + 1, top))
        low = values & ((ONE << np.uint64(self.width)) - ONE)
        while True:  # binary search among the few values of one high part
            open_ = np.flatnonzero(at < end)
            if not len(open_):
                return at
            mid = (at[open_] + end[open_]) >> 1
            less = unpack_bits(self.low, mid, self.width) < low[open_]
            at[open_] = np.where(less, mid + 1, at[open_])
            end[open_] = np.where(less, end[open_], mid)

    def mapped(self, folder: str, name: str) -> EliasFano:
        """The same list with its arrays in memory-mapped files."""
        return EliasFano(self.width, self.size, *(
            to_file(a, os.path.join(folder, f"{name}.{k}")) for k, a in
            (("low", self.low), ("high", self.high), ("ones", self.ones))))


def to_file(a: np.ndarray, path: str) -> np.ndarray:
    a.tofile(path)
    return np.memmap(path, a.dtype, "r", shape=a.shape) if len(a) else a


class BigramTrie:
    """Level 1: contexts; monotone pointers into level 2: successors, each
    offset by the last value of the context before it, so that the level is one
    non-decreasing list; and one byte per successor, the quantised log10
    probability."""

    def __init__(self, context: np.ndarray, word: np.ndarray, log_prob: np.ndarray, folder: str):
        """Rows sorted by (context, word), without repeats."""
        heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) \
            else np.zeros(0, np.int64)
        ends = np.append(heads[1:], len(context))
        steps = word[ends - 1].astype(np.int64) + 1 if len(heads) else np.zeros(0, np.int64)
        base = np.cumsum(steps) - steps
        values = word.astype(np.int64) + np.repeat(base, ends - heads)
        self.contexts = EliasFano.build(context[heads]).mapped(folder, "contexts")
        self.pointers = EliasFano.build(np.append(heads, len(context))).mapped(folder, "pointers")
        self.successors = EliasFano.build(values).mapped(folder, "successors")
        self.low = float(log_prob.min()) if len(log_prob) else 0.0
        self.step = (float(log_prob.max()) - self.low) / 255 if len(log_prob) else 0.0
        codes = np.rint((log_prob - self.low) / self.step) if self.step else np.zeros(len(log_prob))
        self.codes = to_file(codes.astype(np.uint8), os.path.join(folder, "codes"))

    def query(self, context: np.ndarray, counts: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 probability of each word after its context, NaN if the pair is
        not there; ``counts`` words follow each of the contexts."""
        if not len(word) or not self.contexts.size:
            return np.full(len(word), np.nan)
        at = np.minimum(self.contexts.find(context), self.contexts.size - 1)
        known = self.contexts.access(at) == context.astype(np.uint64)
        start, end = (self.pointers.access(at + k).astype(np.int64) for k in (0, 1))
        # words are relative to the last value of the context before
        before = np.where(start > 0, self.successors.access(np.maximum(start - 1, 0)).astype(np.int64) + 1, 0)
        known, start, end, before = (np.repeat(x, counts) for x in (known, start, end, before))
        want = before + word.astype(np.int64)
        place = self.successors.find(want)
        inside = known & (place >= start) & (place < end)
        safe = np.where(inside, place, 0)
        inside &= self.successors.access(safe).astype(np.int64) == want
        return np.where(inside, self.low + self.step * self.codes[safe], np.nan)
