"""Rabin-Karp hashes of words and of windows of words, for many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Odd multipliers of the polynomials over bytes and words; the second over words gives bits that
#: do not follow from the first.
BYTE_BASE, WORD_BASE, SIDE_BASE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
#: Bytes hashed at a time; longer texts are cut between words.
SLAB = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit hangs on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_BYTES[_SPACE] = 0


@lru_cache(maxsize=8)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, BYTE_BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _slab(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words in raw, and their hashes."""
    a = np.frombuffer(raw, np.uint8)
    space = _SPACE[a]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    spans = np.diff(starts, append=len(a))
    at = np.arange(starts[0], len(a)) - np.repeat(starts, spans)
    powers = _powers(1 << int(at.max()).bit_length())
    return starts, mixed(np.add.reduceat(_BYTES[a[starts[0] :]] * powers[at], starts - starts[0]))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all the texts' words in order, and the place of each text's first word, with the end."""
    hashes, sizes, waiting, held = [], [], [], 0

    def flush() -> None:
        nonlocal waiting, held
        if waiting:
            starts, h = _slab(b" ".join(waiting))
            edges = np.cumsum([0] + [len(x) + 1 for x in waiting])
            hashes.append(h)
            sizes.append(np.diff(np.searchsorted(starts, edges)))
        waiting, held = [], 0

    for raw in texts:
        if held + len(raw) > SLAB:
            flush()
        if len(raw) <= SLAB:
            waiting.append(raw)
            held += len(raw)
            continue
        parts, n = pieces(raw), 0
        for part in parts:
            h = _slab(part)[1]
            hashes.append(h)
            n += len(h)
        sizes.append(np.array([n]))
    flush()
    every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    return every, np.concatenate([[0], np.cumsum(np.concatenate(sizes))] if sizes else [[0]]).astype(np.int64)


def pieces(raw: bytes):
    """The text in parts of about SLAB bytes that end where a word does."""
    start = 0
    while start < len(raw):
        end = min(len(raw), start + SLAB)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        yield raw[start:end]
        start = end


def window_hashes(words: np.ndarray, width: int, base: np.uint64 = WORD_BASE) -> np.ndarray:
    """Hashes of the windows of so many words, by the place of their first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = h * base + words[i : i + n]
    return mixed(h)
