"""Words of many texts at once, in numpy: where they are, and 64-bit hashes of them.

Texts are one array of units (bytes or code points) and the offsets at which each
begins; a word is a run of units of a given set inside one text. No Python object
is made per word.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15
_C1, _C2, _S = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(32)
#: Units that are hashed in one go; a longer word is hashed by itself.
RUN = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    x = x * _C1
    x ^= x >> _S
    x *= _C2
    x ^= x >> _S
    return x


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        powers = np.full(RUN + 1, base, dtype=np.uint64)
        powers[0] = 1
        both.append(np.cumprod(powers, dtype=np.uint64))
    return both[0], both[1]


@functools.cache
def word_points() -> np.ndarray:
    r"""Of every code point, whether ``\w`` matches it."""
    inside = np.zeros(0x110000, dtype=bool)
    for m in re.finditer(r"\w+", "".join(map(chr, range(0x110000)))):
        inside[m.start() : m.end()] = True
    return inside


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array without nulls, and where each text begins (and the last ends)."""
    import pyarrow as pa

    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    units = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return units, at - at[0]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts, and where each text begins (and the last ends)."""
    units = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return units, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def slices(offsets: np.ndarray, units: int) -> list[tuple[int, int]]:
    """Runs of texts (first, last + 1) of about so many units each; a longer text is a run of its own."""
    cuts, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + units, side="right")) - 1)
        cuts.append((a, min(b, n)))
        a = cuts[-1][1]
    return cuts


def spans(units: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts and ends of all words, and the number of words before each text (and in all)."""
    held = inside[units]
    begin, last = held.copy(), held.copy()
    begin[1:] &= ~held[:-1]
    last[:-1] &= ~held[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(units))]
    begin[cuts] = held[cuts]
    last[cuts - 1] = held[cuts - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, the same wherever the word stands."""
    out = np.empty(len(starts), dtype=np.uint64)
    powers, inverse = _powers()
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + RUN, side="right"))
        if j == i:  # one word longer than a run
            out[i] = xxhash.xxh3_64_intdigest(units[base : ends[i]].astype(np.uint32).tobytes())
            i += 1
            continue
        part = units[base : ends[j - 1]].astype(np.uint64)
        part += np.uint64(1)
        part *= powers[: len(part)]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part, out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        h = (sums[b] - sums[a]) * inverse[a]
        out[i:j] = mix(h ^ ((b - a).astype(np.uint64) << np.uint64(48)))
        i = j
    return out


def room(values: np.ndarray, used: int, more: int) -> np.ndarray:
    """``values`` with room for so many more than the used ones; grows by doubling."""
    if used + more <= len(values):
        return values
    return np.concatenate([values[:used], np.zeros(used + more, dtype=values.dtype)])


class Index:
    """From distinct 64-bit hashes to their places 0, 1, ... in order of arrival."""

    def __init__(self, keys: np.ndarray | None = None):
        self._keys, self._n = np.zeros(1, dtype=np.uint64), 0
        self._slots = np.full(1024, -1, dtype=np.int32)
        if keys is not None:
            self.add(keys)

    def __len__(self) -> int:
        return self._n

    def add(self, keys: np.ndarray) -> None:
        """New keys, none of which is known yet."""
        first, self._keys = self._n, room(self._keys, self._n, len(keys))
        self._keys[first : first + len(keys)] = keys
        self._n += len(keys)
        if 2 * self._n > len(self._slots):
            self._slots = np.full(1 << (4 * self._n).bit_length(), -1, dtype=np.int32)
            first = 0
        mask = np.uint64(len(self._slots) - 1)
        open_ = np.arange(first, self._n, dtype=np.int32)
        at = self._keys[open_] & mask
        while len(open_):
            free = self._slots[at] < 0
            self._slots[at[free]] = open_[free]
            lost = self._slots[at] != open_
            open_, at = open_[lost], (at[lost] + np.uint64(1)) & mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of every hash; -1 for unknown ones."""
        mask = np.uint64(len(self._slots) - 1)
        out = self._slots[hashes & mask]
        wrong = np.flatnonzero((out >= 0) & (self._keys[out] != hashes))
        at = hashes[wrong] & mask
        while len(wrong):
            at = (at + np.uint64(1)) & mask
            got = self._slots[at]
            out[wrong] = got
            still = (got >= 0) & (self._keys[got] != hashes[wrong])
            wrong, at = wrong[still], at[still]
        return out


class Memory:
    """Lists of ids by the 64-bit hash of what they stand for, gathered many at a time."""

    def __init__(self, kind: np.dtype):
        self._kind = kind
        self.forget()

    def __len__(self) -> int:
        return len(self._index)

    def forget(self) -> None:
        self._index, self._ids, self._used = Index(), np.zeros(1 << 16, dtype=self._kind), 0
        self._at, self._size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        return self._index.find(keys)

    def add(self, keys: np.ndarray, lists: list[list[int]]) -> None:
        """The lists of new keys."""
        n, used = len(self._index), self._used
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        self._used += int(sizes.sum())
        self._ids = room(self._ids, used, self._used - used)
        self._ids[used : self._used] = np.fromiter(chain.from_iterable(lists), dtype=self._kind, count=self._used - used)
        self._at, self._size = room(self._at, n, len(lists)), room(self._size, n, len(lists))
        self._at[n : n + len(lists)] = used + np.cumsum(sizes) - sizes
        self._size[n : n + len(lists)] = sizes
        self._index.add(keys)

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the lists at these places, one list after the other, and where each begins (and the last ends)."""
        sizes = self._size[places]
        begins = np.concatenate([[0], np.cumsum(sizes)])
        return self._ids[np.repeat(self._at[places] - begins[:-1], sizes) + np.arange(begins[-1])], begins

    def recall(self, keys: np.ndarray, most: int, learn: Callable[[np.ndarray], list[list[int]]]) -> np.ndarray:
        """The places of all keys; ``learn`` makes the lists of new ones, from the position of one occurrence of each.

        Once there would be more than ``most``, all that is known is forgotten.
        """
        places = self.find(keys)
        new = np.flatnonzero(places < 0)
        if len(new):
            if len(self) + len(new) > most:
                self.forget()
                new = np.arange(len(keys))
            fresh, at = np.unique(keys[new], return_index=True)
            self.add(fresh, learn(new[at]))
            places = self.find(keys)
        return places
