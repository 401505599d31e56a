"""Locally consistent parsing by recompression: runs and pairs of neighbouring symbols get names in rounds.

A name is a 64-bit digest of what it stands for, so every task gives equal runs and pairs the same name without any
exchange. Each round first names maximal runs of one symbol (first round only: later runs are left to the pairs), then
splits the alphabet in two by a hash bit and names every pair of a left symbol followed by a right one. Of a word
sequence that occurs twice, all symbols but a few at its borders come out the same; how far a symbol depends on its
surroundings is tracked exactly as ``lo`` and ``hi``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from benchweave.llm.words import mix

_PAIR = np.uint64(0x8CB92BA72F3D8DD7)
_RUN = np.uint64(0xD1B54A32D192ED03)


@dataclass
class Level:
    """Symbols in text order: covers words [start, stop), determined by words [lo, hi); ``row`` is the text."""

    name: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    row: np.ndarray

    def take(self, keep: np.ndarray) -> Level:
        return Level(*(getattr(self, f)[keep] for f in ("name", "start", "stop", "lo", "hi", "row")))


def _neighbours(level: Level, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``lo`` of the symbol to the left and ``hi`` of the one to the right; past a text's edge, one word beyond it."""
    left, right = np.empty_like(level.lo), np.empty_like(level.hi)
    left[1:], right[:-1] = level.lo[:-1], level.hi[1:]
    left[first], right[last] = level.start[first] - 1, level.stop[last] + 1
    return left, right


def _edges(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.ones(len(row), dtype=bool)
    first[1:] = row[1:] != row[:-1]
    last = np.ones(len(row), dtype=bool)
    last[:-1] = first[1:]
    return first, last


def name_runs(level: Level) -> Level:
    first, last = _edges(level.row)
    head = first.copy()
    head[1:] |= level.name[1:] != level.name[:-1]
    at = np.flatnonzero(head)
    end = np.append(at[1:], len(head)) - 1
    left, right = _neighbours(level, first, last)
    length = (end - at + 1).astype(np.uint64)
    name = np.where(length > 1, mix(level.name[at] * _RUN + length), level.name[at])
    return Level(name, level.start[at], level.stop[end], np.minimum(level.lo[at], left[at]), np.maximum(level.hi[end], right[end]), level.row[at])


def name_pairs(level: Level, turn: int) -> Level:
    first, last = _edges(level.row)
    is_right = (mix(level.name ^ np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(1)).astype(bool)
    joins = np.zeros(len(is_right), dtype=bool)
    joins[:-1] = ~is_right[:-1] & is_right[1:] & ~last[:-1]
    joined = np.zeros_like(joins)
    joined[1:] = joins[:-1]
    left, right = _neighbours(level, first, last)
    single = ~joins & ~joined
    lo = np.where(single & is_right, np.minimum(level.lo, left), level.lo)
    hi = np.where(single & ~is_right, np.maximum(level.hi, right), level.hi)
    name, stop = level.name.copy(), level.stop.copy()
    at = np.flatnonzero(joins)
    name[at] = mix(level.name[at] * _PAIR + level.name[at + 1])
    stop[at] = level.stop[at + 1]
    lo[at], hi[at] = np.minimum(level.lo[at], level.lo[at + 1]), np.maximum(level.hi[at], level.hi[at + 1])
    return Level(name, level.start, stop, lo, hi, level.row).take(~joined)


def parse(hashes: np.ndarray, row: np.ndarray, rounds: int, span: int) -> list[Level]:
    """All levels from the words up; symbols that no window of ``span`` words can determine are kept for context."""
    at = np.arange(len(hashes), dtype=np.int64)
    levels = [Level(hashes, at, at + 1, at, at + 1, row)]
    if len(hashes):
        current = name_runs(levels[0])
        for turn in range(1, rounds + 1):
            current = name_pairs(current, turn)
            levels.append(current)
    return levels
