"""64-bit hashes of words and of windows of bytes, as numpy arrays.

A string's hash is the sum of its bytes' random numbers times powers of an odd
number, divided by the power of its first place, and mixed; sums of prefixes give
the hash of any substring. All arithmetic is modulo 2^64.
"""

from __future__ import annotations

import numpy as np

BREAK = np.zeros(256, bool)
BREAK[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z
LOW = np.arange(256, dtype=np.uint8)
LOW[0x41:0x5B] += 32
RNG = np.random.default_rng(20240611)
BYTE = RNG.integers(0, 1 << 64, 256, np.uint64)
R = np.uint64(0x9E3779B97F4A7C15)
R_INV = np.uint64(pow(int(R), -1, 1 << 64))
WORDS_AT_ONCE = 200_000
_POWERS: dict[int, np.ndarray] = {}


def powers(r: np.uint64, n: int) -> np.ndarray:
    """r^0, r^1, …, r^(n-1)."""
    held = _POWERS.get(int(r))
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), r, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held, dtype=np.uint64)
        if n <= 1 << 23:
            _POWERS[int(r)] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    out = np.empty(len(raw) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE[raw] * powers(R, len(raw)), dtype=np.uint64, out=out[1:])
    return out


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z folded) of all texts, and words per text."""
    n = len(offsets) - 1
    word = ~BREAK[raw]
    filled = offsets[:-1][np.diff(offsets) > 0]
    lead, tail = word.copy(), word.copy()
    lead[1:] &= ~word[:-1]
    tail[:-1] &= ~word[1:]
    lead[filled] = word[filled]                  # a text's first byte follows nothing,
    last = offsets[1:][np.diff(offsets) > 0] - 1
    tail[last] = word[last]                      # and nothing follows its last
    starts, ends = np.flatnonzero(lead), np.flatnonzero(tail) + 1
    out = np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), WORDS_AT_ONCE):
        s, e = starts[k:k + WORDS_AT_ONCE], ends[k:k + WORDS_AT_ONCE]
        a = s[0]
        sums = prefix_sums(LOW[raw[a:e[-1]]])
        out[k:k + len(s)] = mix((sums[e - a] - sums[s - a]) * powers(R_INV, int(s[-1] - a) + 1)[s - a] + (e - s).astype(np.uint64))
    per = np.diff(np.searchsorted(starts, offsets)) if n else np.zeros(0, np.int64)
    return out, per
