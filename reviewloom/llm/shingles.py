"""Word and shingle hashes of texts, computed with whole-array operations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: A-Z to a-z, white space to a space.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))
PIECE_BYTES = 1 << 20
#: Words of so many bytes and more get a keyed hash; sums of powers modulo 2^64 cannot tell some long words apart.
LONGEST = 1 << 8
_BASE, _SHINGLE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    np.multiply.accumulate(np.full(n - 1, base, np.uint64), out=out[1:])
    return out


_POWERS = _powers(_BASE, LONGEST)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _pieces(data: bytes) -> Iterator[bytes]:
    start, end = 0, len(data)
    while start < end:
        stop = start + PIECE_BYTES
        if stop < end:
            cut = data.find(b" ", stop)
            stop = end if cut < 0 else cut
        yield data[start:stop]
        start = stop


def _piece_hashes(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    inside = np.empty(len(b) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = b != 32
    steps = np.diff(inside)
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    owner = np.repeat(starts, np.diff(np.append(starts, len(b))))
    place = np.arange(starts[0], len(b)) - owner
    np.minimum(place, LONGEST - 1, out=place)
    terms = (b[starts[0]:].astype(np.uint64) + np.uint64(1)) * inside[1 + starts[0]:-1].astype(np.uint64) * _POWERS[place]
    h = mix(np.add.reduceat(terms, starts - starts[0]) + lengths.astype(np.uint64) * np.uint64(_SHINGLE))
    for i in np.flatnonzero(lengths >= LONGEST):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]], digest_size=8).digest(), "little")
    return h


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ after A-Z became a-z."""
    parts = [_piece_hashes(p) for p in _pieces(text.translate(LOWER))]
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; fewer words are one run, none is none."""
    n = len(words)
    if not n:
        return words
    run = min(size, n)
    h = np.zeros(n - run + 1, np.uint64)
    for j in range(run):
        h = h * np.uint64(_SHINGLE) + words[j:n - run + 1 + j]
    return np.unique(mix(h + np.uint64(run)))
