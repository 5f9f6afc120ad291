"""A run-length grammar by recompression, and common extensions read from it.

The sequence is shrunk in turns. A block step gives every maximal repetition of
one symbol a name; a pair step deals the symbols into a left and a right half
and gives every left symbol that precedes a right one a common name with it. A
name stands for the same words wherever it occurs, because names are given by
content and never by a hash. Both steps look at direct neighbours only, so equal
stretches get equal names except near their ends.

A common extension climbs from two places as long as the names above them are
equal, steps over equal names at their ends, and descends to the first word
that differs. Every step rests on equal names, so the answer is exact however the
symbols are dealt; the dealing only decides how many steps are needed. All
queries move together, as arrays.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

ROUNDS = 64


class Level(NamedTuple):
    """Symbols of one level; ``parent`` and ``first`` tie it to the next: ``first`` has the first child of each parent, and the end."""

    symbols: np.ndarray
    parent: np.ndarray | None
    first: np.ndarray | None
    block: bool


def _half(symbols: np.ndarray, turn: int) -> np.ndarray:
    h = symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((turn * 0xD6E8FEB86659FD93 + 1) % 2**64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(63)).astype(bool)


def _named(symbols: np.ndarray, starts: np.ndarray, keys: np.ndarray, chosen: np.ndarray, free: int) -> tuple[np.ndarray, int]:
    """Symbols of the next level: of ``starts``, the chosen ones get names for their keys."""
    out = symbols[starts]
    if len(keys):
        names, own = np.unique(keys, return_inverse=True)
        out[chosen] = free + own
        free += len(names)
    return out, free


def grammar(words: np.ndarray, parts: int = 1) -> list[Level]:
    """Levels from the words (numbers from 0) upwards; ends at about four symbols for each of ``parts``."""
    symbols, free, levels = words.astype(np.int64), int(words.max(initial=0)) + 1, []
    for turn in range(ROUNDS):
        if len(symbols) <= 4 * parts + 16:
            break
        edge = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        starts = np.concatenate(([0], edge))
        if len(starts) < len(symbols):
            lengths = np.diff(np.append(starts, len(symbols)))
            chosen = np.flatnonzero(lengths > 1)
            above, free = _named(symbols, starts, symbols[starts[chosen]] << 32 | lengths[chosen], chosen, free)
            levels.append(_level(symbols, starts, True))
            symbols = above
        left = ~_half(symbols, turn)
        pairs = np.flatnonzero(left[:-1] & ~left[1:])
        keep = np.ones(len(symbols), bool)
        keep[pairs + 1] = False
        starts = np.flatnonzero(keep)
        chosen = np.searchsorted(starts, pairs)
        above, free = _named(symbols, starts, symbols[pairs] << 32 | symbols[pairs + 1], chosen, free)
        levels.append(_level(symbols, starts, False))
        symbols = above
    return [*levels, Level(symbols, None, None, False)]


def _level(symbols: np.ndarray, starts: np.ndarray, block: bool) -> Level:
    parent = np.zeros(len(symbols), np.int64)
    parent[starts[1:]] = 1
    return Level(symbols, np.cumsum(parent), np.append(starts, len(symbols)), block)


def mirrored(levels: list[Level]) -> list[Level]:
    """The grammar of the same words from right to left."""
    out = []
    for level in levels:
        if level.parent is None:
            out.append(Level(level.symbols[::-1], None, None, False))
        else:
            above = len(level.first) - 2
            out.append(Level(level.symbols[::-1], above - level.parent[::-1], len(level.symbols) - level.first[::-1], level.block))
    return out


def _steps(level: Level, x: np.ndarray, y: np.ndarray):
    """How many equal symbols follow at once: the rest of the shorter block."""
    if not level.block:
        return 1
    return np.minimum(level.first[level.parent[x] + 1] - x, level.first[level.parent[y] + 1] - y)


def extension(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of places the number of equal words that follow, both places included.

    The sequence must hold a word after each place that ends the match before
    the sequence ends, such as a mark that occurs once.
    """
    at, to = a.astype(np.int64), b.astype(np.int64)
    stopped = np.zeros(len(at), np.int64)
    climbing = np.arange(len(at))
    for depth, level in enumerate(levels):
        todo, risen = climbing, []
        while len(todo):
            x, y = at[todo], to[todo]
            same = level.symbols[x] == level.symbols[y]
            stopped[todo[~same]] = depth
            todo, x, y = todo[same], x[same], y[same]
            if level.parent is not None:
                above = levels[depth + 1].symbols
                p, q = level.parent[x], level.parent[y]
                rises = (level.first[p] == x) & (level.first[q] == y) & (above[p] == above[q])
                at[todo[rises]], to[todo[rises]] = p[rises], q[rises]
                risen.append(todo[rises])
                todo, x, y = todo[~rises], x[~rises], y[~rises]
            step = _steps(level, x, y)
            at[todo], to[todo] = x + step, y + step
        climbing = np.concatenate(risen) if risen else climbing[:0]
        if not len(climbing):
            break
    for depth in range(len(levels) - 2, -1, -1):
        level = levels[depth]
        todo = np.flatnonzero(stopped > depth)
        at[todo], to[todo] = level.first[at[todo]], level.first[to[todo]]
        while len(todo):
            x, y = at[todo], to[todo]
            same = level.symbols[x] == level.symbols[y]
            todo, x, y = todo[same], x[same], y[same]
            step = _steps(level, x, y)
            at[todo], to[todo] = x + step, y + step
    return at - a
