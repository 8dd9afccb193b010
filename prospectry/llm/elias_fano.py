"""Elias-Fano coding of increasing integers in numpy, with vectorised access and search.

Low bits lie packed one after another. High bits are a bit vector in which each value sets the bit (high part +
index). Every 32nd one and zero has its position sampled; from a sample, words are counted through, and the place in
a word comes from the counts of its bytes and a table. All arrays can be memory-mapped.
"""

from __future__ import annotations

import os

import numpy as np

U = np.uint64
EVERY = 32
#: Bits between two samples beyond which the samples of the other kind are looked at.
FAR = 192
#: Every byte of a word: its lowest bits (by 1, 2, 4), its lowest bit, its highest bit.
PAIRS, FOURS, NIBBLES, LOWEST, HIGHEST = (U(x * 0x0101010101010101) for x in (0x55, 0x33, 0x0F, 0x01, 0x80))
#: Position of the k-th set bit of byte b, at 256 * k + b.
IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for k in range(8) for b in range(256)], np.uint8)


def narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers, none negative, in the smallest type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max()))) if len(values) else values


def _or_into(size: int, at: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """uint64 words with ``bits`` or-ed in at the non-decreasing places ``at``."""
    words = np.zeros(size, U)
    if len(at):
        first = np.flatnonzero(np.diff(at, prepend=-1))
        words[at[first]] = np.bitwise_or.reduceat(bits, first)
    return words


class EliasFano:
    NAMES = ("meta", "low", "high", "ones", "zeros")

    def __init__(self, **arrays: np.ndarray) -> None:
        self.arrays = arrays
        self.low, self.high, self.ones, self.zeros = (arrays[k] for k in self.NAMES[1:])
        self.n, self.bits, self.buckets = (int(x) for x in arrays["meta"])
        # The 64 bits from each byte on: at least 57 from any place come with one look.
        self.low_at, self.high_at = (np.ndarray((8 * len(x) - 7,), "<u8", buffer=x, strides=(1,)) for x in (self.low, self.high))

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """From non-decreasing values below 2**63; only strictly increasing ones can be searched."""
        values = values.astype(U)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        high = (values >> U(bits)).astype(np.int64)
        buckets = (top >> bits) + 1
        low = values & U((1 << bits) - 1)
        start = np.arange(n, dtype=np.int64) * bits
        size = (n * bits >> 6) + 2
        shift = (start & 63).astype(U)
        packed = _or_into(size, start >> 6, low << shift)
        over = np.flatnonzero((start & 63) + bits > 64)
        packed |= _or_into(size, (start[over] >> 6) + 1, low[over] >> (U(64) - shift[over]))
        places = high + np.arange(n)
        words = _or_into((n + buckets >> 6) + 2, places >> 6, U(1) << (places & 63).astype(U))
        sampled = np.arange(0, buckets, EVERY)
        zeros = sampled + np.searchsorted(high, sampled, "right")
        return cls(meta=np.array([n, bits, buckets], np.int64), low=packed, high=words, ones=narrow(places[::EVERY]), zeros=narrow(zeros))

    def save(self, folder: str, name: str) -> None:
        for k in self.NAMES:
            save(folder, f"{name}-{k}", self.arrays[k])

    @classmethod
    def open(cls, folder: str, name: str) -> EliasFano:
        return cls(**{k: load(folder, f"{name}-{k}") for k in cls.NAMES})

    def _low(self, i: np.ndarray) -> np.ndarray:
        start = i * self.bits
        if self.bits <= 57:
            return (self.low_at[start >> 3] >> (start & 7).astype(U)) & U((1 << self.bits) - 1)
        word, shift = start >> 6, (start & 63).astype(U)
        value = self.low[word] >> shift
        over = (start & 63) + self.bits > 64
        if over.any():
            value[over] |= self.low[word[over] + 1] << (U(64) - shift[over])
        return value & U((1 << self.bits) - 1)

    def _select(self, k: np.ndarray, samples: np.ndarray, flip: np.uint64) -> np.ndarray:
        """Position of the k-th one (flip = 0) or zero (flip = all ones)."""
        sample = k // EVERY
        place, left = samples[sample].astype(np.int64), k - sample * EVERY
        last = sample + 1 == len(samples)
        ended = np.where(last, self.n + self.buckets, samples[sample + 1 - last])
        far = np.flatnonzero(ended - place > FAR)
        if len(far):
            place[far], left[far] = self._nearer(k[far], place[far], left[far], ended[far], self.zeros if flip == 0 else self.ones)
        left = left.astype(U)
        bits = (self.high_at[place >> 3] ^ flip) >> (place & 7).astype(U)
        count = np.bitwise_count(bits)
        going = np.flatnonzero(left >= count)
        while len(going):
            left[going] -= count[going]
            place[going] = (place[going] | 7) + 57
            bits[going] = self.high_at[place[going] >> 3] ^ flip
            count[going] = np.bitwise_count(bits[going])
            going = going[left[going] >= count[going]]
        # Set bits up to the end of each byte, all eight in one word; bytes that end before the bit looked for are counted.
        sums = bits - ((bits >> U(1)) & PAIRS)
        sums = (sums & FOURS) + ((sums >> U(2)) & FOURS)
        sums = ((sums + (sums >> U(4))) & NIBBLES) * LOWEST
        at = np.bitwise_count(((left * LOWEST | HIGHEST) - sums) & HIGHEST).astype(U) << U(3)
        left -= ((sums << U(8)) >> at) & U(255)
        at += IN_BYTE[(left << U(8)) | ((bits >> at) & U(255))]
        return place + at.astype(np.int64)

    @staticmethod
    def _nearer(k: np.ndarray, place: np.ndarray, left: np.ndarray, ended: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of the way to the k-th bit of one kind, and how many of the kind to pass: the last sample of the other kind before it, if nearer.

        Where bits of the other kind are dense, samples of one kind lie far apart, and those of the other kind lead on.
        """
        least = -(-(place - (k - left)) // EVERY)
        low, high = least, np.minimum((ended - (k - left)) // EVERY, len(others) - 1)
        while (low <= high).any():
            middle = np.clip((low + high) >> 1, 0, len(others) - 1)
            going, before = low <= high, others[middle].astype(np.int64) - EVERY * middle <= k
            low, high = np.where(going & before, middle + 1, low), np.where(going & ~before, middle - 1, high)
        nearer = high >= least
        at = np.where(nearer, high, 0)
        start = others[at].astype(np.int64)
        return np.where(nearer, start, place), np.where(nearer, k - (start - EVERY * at), left)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i``."""
        i = np.asarray(i, np.int64)
        return ((self._select(i, self.ones, U(0)) - i) << self.bits) | self._low(i).astype(np.int64)

    def neighbours(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at places ``i`` and at the places after them, which exist: one search for both."""
        one = self._select(i, self.ones, U(0))
        next_one = one + 1
        bits = self.high_at[next_one >> 3] >> (next_one & 7).astype(U)
        going = np.flatnonzero(bits == 0)
        while len(going):
            next_one[going] = (next_one[going] | 7) + 57
            bits[going] = self.high_at[next_one[going] >> 3]
            going = going[bits[going] == 0]
        next_one += np.bitwise_count(bits ^ (bits - U(1))).astype(np.int64) - 1
        return ((one - i) << self.bits) | self._low(i).astype(np.int64), ((next_one - i - 1) << self.bits) | self._low(i + 1).astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, or -1: the successor of a value in its bucket of equal high bits, if equal to it."""
        values = np.asarray(values, np.int64)
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        high = values >> self.bits
        inside = np.flatnonzero((values >= 0) & (high < self.buckets))
        high = high[inside]
        flip = ~U(0)
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros, flip) + 1, 0)
        start = begin - high
        # The bucket's values are the ones up to the next zero; those that go beyond the bits looked at are counted up to that zero's place.
        shift = begin & 7
        bits = ~(self.high_at[begin >> 3] >> shift.astype(U))
        count = np.bitwise_count(bits ^ (bits - U(1))).astype(np.int64) - 1
        over = np.flatnonzero(count + shift >= 63)
        count[over] = self._select(high[over], self.zeros, flip) - begin[over]
        want = (values[inside] & ((1 << self.bits) - 1)).astype(U)
        place = start.copy()
        # Low bits spread evenly where words are numbered by hashes, so a value's place is guessed from its neighbours'; halving bounds the rest.
        going = np.flatnonzero(count > 1)
        least, most, below = start[going], start[going] + count[going], want[going].astype(np.int64)
        floor, top = np.zeros(len(going), np.int64), np.full(len(going), 1 << self.bits, np.int64)
        turn = 0
        while len(going):
            turn += 1
            span = most - least
            if turn > 5 and turn % 2:
                guess = least + (span >> 1)
            else:
                guess = least + np.minimum(((below - floor) / (top - floor) * span).astype(np.int64), span - 1)
            found = self._low(guess).astype(np.int64)
            less = found < below
            least, most = np.where(less, guess + 1, least), np.where(less, most, guess)
            floor, top = np.where(less, found + 1, floor), np.where(less, top, found)
            ended = (found == below) | (least >= most)
            place[going[ended]] = guess[ended]
            left = np.flatnonzero(~ended)
            going, least, most, below, floor, top = (x[left] for x in (going, least, most, below, floor, top))
        hit = np.flatnonzero(count > 0)
        hit = hit[self._low(place[hit]) == want[hit]]
        out[inside[hit]] = place[hit]
        return out


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Write under another name first, so that a task that runs again or twice leaves whole files."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{name}.npy")
    aside = f"{path}.{os.getpid()}"
    with open(aside, "wb") as f:
        np.save(f, array)
    os.replace(aside, path)


def load(folder: str, name: str) -> np.ndarray:
    path = os.path.join(folder, f"{name}.npy")
    array = np.load(path, mmap_mode="r")
    # A plain view: numpy does more for each step on its own class of mapped arrays.
    return array.view(np.ndarray) if array.size else np.array(array)
