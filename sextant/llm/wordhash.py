"""Hashes of words and of runs of consecutive words, for whole batches of texts in numpy.

Words are what lies between ASCII white space (\\x20, \\x09-\\x0D).  A word's
64-bit hash is a polynomial over a random table of byte values, taken from
prefix sums, so that no loop runs per word; a run's hash is the same over its
words' hashes.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
MAX = U64(0xFFFFFFFFFFFFFFFF)
#: Bytes that are hashed at a time.
SLICE = 1 << 20
#: Odd multipliers of the two independent families.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_TABLES = [np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) for seed in (17, 29)]
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(base: int, n: int, inverse: bool) -> np.ndarray:
    known = _POWERS.get((base, inverse))
    if known is None or len(known) < n:
        b = pow(base, -1, 1 << 64) if inverse else base
        size = max(n, SLICE + 4096)
        known = np.multiply.accumulate(np.concatenate(([U64(1)], np.full(size - 1, b, dtype=np.uint64))))
        if size <= 4 * SLICE:
            _POWERS[base, inverse] = known
    return known[:n]


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The polynomial of values[start:end] for each pair, whatever its place."""
    prefix = np.concatenate(([U64(0)], np.cumsum(values * _powers(base, len(values), False), dtype=np.uint64)))
    return (prefix[ends] - prefix[starts]) * _powers(base, len(values) + 1, True)[starts]


def word_hashes(joined: bytes, family: int = 0) -> np.ndarray:
    """One hash per word of words joined by single spaces; none for an empty text."""
    out = []
    at = 0
    while at < len(joined):
        to = len(joined)
        if to - at > SLICE:
            cut = joined.rfind(b" ", at, at + SLICE)
            to = cut if cut > at else joined.find(b" ", at + SLICE)
            to = len(joined) if to < 0 else to
        a = np.frombuffer(joined, dtype=np.uint8, count=to - at, offset=at)
        spaces = np.flatnonzero(a == 32)
        starts, ends = np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(a)]))
        out.append(mix(sums(_TABLES[family][a], starts, ends, BASES[family])))
        at = to + 1
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def run_hashes(words: np.ndarray, k: int, family: int = 0) -> np.ndarray:
    """The hash of words[i:i + k] for every i."""
    if len(words) < k:
        return np.empty(0, dtype=np.uint64)
    starts = np.arange(len(words) - k + 1)
    return mix(_run_sums(words, starts, k, BASES[1 - family]))


def _run_sums(words: np.ndarray, starts: np.ndarray, k: int, base: int) -> np.ndarray:
    if len(words) <= SLICE:
        return sums(words, starts, starts + k, base)
    parts = []
    for at in range(0, len(starts), SLICE // 2):  # powers stay short for very long texts
        own = starts[at:at + SLICE // 2]
        parts.append(sums(words[own[0]:own[-1] + k], own - own[0], own - own[0] + k, base))
    return np.concatenate(parts)


def sliding(values: np.ndarray, n: int, fold) -> np.ndarray:
    """``fold`` (minimum or maximum) of values[i:i + n] for every i."""
    span, out = 1, values
    while 2 * span <= n:
        out = fold(out[:-span], out[span:])
        span *= 2
    return fold(out[:len(values) - n + 1], out[n - span:][:len(values) - n + 1]) if span < n else out


def anchors(hashes: np.ndarray, n: int, lengths: np.ndarray) -> np.ndarray:
    """Places whose value is the least of some ``n`` consecutive ones of one text.

    ``hashes`` are the values of texts one behind the other, ``lengths`` how
    many each has.  Equal stretches of ``n`` values have equal anchors.
    """
    if len(hashes) < n:
        return np.empty(0, dtype=np.int64)
    least = sliding(hashes, n, np.minimum)
    left = np.repeat(np.cumsum(lengths), lengths)[:len(least)] - np.arange(len(least))  # values to the end of the text
    least[left < n] = 0
    around = np.concatenate((np.zeros(n - 1, U64), least, np.zeros(n - 1, U64)))
    return np.flatnonzero(sliding(around, n, np.maximum) == hashes)
