"""Encoding texts cut by cut: each different cut is encoded once by a library and kept in a bounded table that a worker
holds from task to task. All steps but the library's are numpy over whole batches.

A cut of up to SHORT bytes is known by its bytes themselves, packed into three words with its length; a hash of them only
says where to look, and what is found there is compared. Longer cuts are looked up by their bytes in a dictionary, and
those of over LONGEST bytes are encoded wherever they stand, so that no text can fill the table.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import NamedTuple

import numpy as np

SHORT, LONGEST = 23, 256


def threads(count: int = 2) -> None:
    """How many threads the tokenizers library takes in this process; holds if said before its first batch."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(count))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")


def ragged(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions first, first + 1, ... of every run, one run after the other; and where each run ends."""
    close = np.cumsum(length)
    return np.repeat(first - (close - length), length) + np.arange(int(close[-1]) if len(close) else 0), close


def split_at(ids: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """Where the cuts of ``ids`` begin: at each id that ``starts`` one."""
    at = np.flatnonzero(starts[ids])
    if len(at) != count or (count and at[0]):
        raise ValueError("cuts and ids don't fit")
    return at


#: For each length, which bytes of the three words belong to the cut.
_MASKS = np.array([[0xFF] * n + [0] * (24 - n) for n in range(SHORT + 1)], np.uint8).view(np.uint64)


def packed(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Three words for each cut of up to SHORT bytes: its bytes, zeros, and its length in the last byte."""
    padded = np.concatenate([data, np.zeros(24, np.uint8)])
    windows = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 24), (1, 1)).view("V24")[:, 0]
    words = windows[at].view(np.uint64).reshape(-1, 3) & _MASKS[length]
    words[:, 2] |= length.astype(np.uint64) << np.uint64(56)
    return words


def places(words: np.ndarray) -> np.ndarray:
    """A hash of the words, to look them up by."""
    h = (words[:, 0] ^ (words[:, 2] * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= (h >> np.uint64(29)) ^ (words[:, 1] * np.uint64(0xBF58476D1CE4E5B9))
    return h * np.uint64(0x94D049BB133111EB)


class Learned(NamedTuple):
    """Ids of cuts: those of cut k are flat[first[k] : first[k] + length[k]]."""

    flat: np.ndarray
    first: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, got: list[np.ndarray] | Learned) -> Learned:
        if isinstance(got, Learned):
            return got
        length = np.array([len(g) for g in got], np.int64)
        return cls(np.concatenate(got), np.cumsum(length) - length, length)

    def each(self) -> list[np.ndarray]:
        return [self.flat[f : f + n] for f, n in zip(self.first.tolist(), self.length.tolist(), strict=True)]


Learn = Callable[[list[bytes]], tuple[list[np.ndarray] | Learned, list[bool]]]


class CutTable:
    """``learn`` gets cuts as bytes and gives the ids of each, and whether it is odd. A table of over ``most`` cuts
    (some 100 bytes each) is begun anew, which changes no result."""

    def __init__(self, learn: Learn, kind: type, most: int = 500_000, most_long: int = 62_500) -> None:
        self.learn, self.kind, self.most, self.most_long = learn, kind, most, most_long
        self._forget()
        self.long: dict[bytes, tuple[np.ndarray, bool]] = {}

    def _forget(self) -> None:
        self.hashes, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted by hash, and where each stands below
        self.words = np.zeros((1 << 12, 3), np.uint64)
        self.first, self.length, self.odd = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, bool)
        self.flat, self.used = np.zeros(1 << 16, self.kind), 0

    def _room(self, name: str, need: int) -> None:
        now = getattr(self, name)
        if need > len(now):
            more = np.zeros((max(need, 2 * len(now)), *now.shape[1:]), now.dtype)
            more[: len(now)] = now
            setattr(self, name, more)

    def _slots(self, h: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Places in the table of sorted different hashes."""
        if len(self.hashes) > self.most:
            self._forget()
        place = np.searchsorted(self.hashes, h)
        there = np.zeros(len(h), bool)
        inside = place < len(self.hashes)
        there[inside] = self.hashes[place[inside]] == h[inside]
        new = np.flatnonzero(~there)
        if not len(new):
            return self.slot[place]
        raw = words[new].tobytes()
        got, odd = self.learn([raw[24 * k : 24 * k + raw[24 * k + 23]] for k in range(len(new))])
        got = Learned.of(got)
        at, end = len(self.hashes), len(self.hashes) + len(new)
        need = self.used + len(got.flat)
        for name in ("words", "first", "length", "odd"):
            self._room(name, end)
        self._room("flat", need)
        self.flat[self.used : need] = got.flat
        self.words[at:end], self.length[at:end], self.odd[at:end] = words[new], got.length, odd
        self.first[at:end] = self.used + got.first
        self.used = need
        out = np.empty(len(h), np.int64)
        old = np.flatnonzero(there)
        out[old], out[new] = self.slot[place[old]], np.arange(at, end)
        where = place[new]
        self.hashes, self.slot = np.insert(self.hashes, where, h[new]), np.insert(self.slot, where, out[new])
        return out

    def _others(self, cuts: list[bytes]) -> list[tuple[np.ndarray, bool]]:
        """Ids of cuts by their bytes."""
        if len(self.long) > self.most_long:
            self.long = {}
        new = [c for c in dict.fromkeys(cuts) if c not in self.long]
        known: dict[bytes, tuple[np.ndarray, bool]] = {}
        if new:
            got, odd = self.learn(new)
            known = dict(zip(new, zip((ids.copy() for ids in Learned.of(got).each()), odd, strict=True), strict=True))
        out = [known.get(c) or self.long[c] for c in cuts]
        self.long.update((c, v) for c, v in known.items() if len(c) <= LONGEST)
        return out

    def encode(self, data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All cuts' ids in one row, where each cut's end, and which cuts are odd."""
        if not len(at):
            return np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, bool)
        size = ends - at
        short = size <= SHORT
        plain = bool(short.all())
        words = packed(data, at, size) if plain else packed(data, at[short], size[short])
        different, where, inverse = np.unique(places(words), return_index=True, return_inverse=True)
        first_of = words[where]
        slots = self._slots(different, first_of)
        slot = slots[inverse]
        # cuts of a hash that the table, or the batch's first cut, knows for another cut
        wrong = (self.words[slots] != first_of).any(1)
        unlike = first_of[inverse]
        unlike ^= words
        unlike[:, 0] |= unlike[:, 1]
        unlike[:, 0] |= unlike[:, 2]
        other = np.flatnonzero(unlike[:, 0] if not wrong.any() else (unlike[:, 0] != 0) | wrong[inverse])
        if plain and not len(other):
            position, close = ragged(self.first[slot], self.length[slot])
            return self.flat[position], close, self.odd[slot]
        known = np.arange(len(at)) if plain else np.flatnonzero(short)
        first, length, odd = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        first[known], length[known], odd[known] = self.first[slot], self.length[slot], self.odd[slot]
        others = np.concatenate([np.flatnonzero(~short), known[other]])
        found = self._others([data[s:e].tobytes() for s, e in zip(at[others].tolist(), ends[others].tolist(), strict=True)])
        # the others' ids stand behind the table's for this once
        size = np.array([len(ids) for ids, _ in found], np.int64)
        end = self.used + int(size.sum())
        self._room("flat", end)
        self.flat[self.used : end] = np.concatenate([ids for ids, _ in found])
        first[others], length[others], odd[others] = self.used + np.cumsum(size) - size, size, [o for _, o in found]
        position, close = ragged(first, length)
        return self.flat[position], close, odd
