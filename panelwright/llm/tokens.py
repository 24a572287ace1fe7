"""Word hashes and rolling window hashes of one text, vectorised."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multipliers of the polynomial hashes.
BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 14)
        inverse = pow(BASE, -1, 2**64)
        for k, b in enumerate((BASE, inverse)):
            p = np.full(size, b, U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * BASE**position over every prefix, modulo 2**64."""
    out = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * powers(len(raw))[0], out=out[1:], dtype=U)
    return out


def spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not ASCII white space."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~SPACE[raw]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash per word (run without ASCII white space)."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if not len(raw):
        return np.empty(0, U)
    start, end = spans(raw)
    if not len(start):
        return np.empty(0, U)
    sums = prefix_sums(raw)
    return mix((sums[end] - sums[start]) * powers(len(raw))[1][start])


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``k`` words (none if there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U)
    out = h[:n].copy()
    for j in range(1, k):
        out *= U(STEP)
        out += h[j : j + n]
    return mix(out)


def window_minima(keys: np.ndarray, m: int) -> np.ndarray:
    """Minimum of every ``m`` consecutive keys, from minima that run forwards and backwards in blocks of ``m``."""
    n = len(keys)
    padded = np.full(-(-n // m) * m, 2**64 - 1, U)
    padded[:n] = keys
    blocks = padded.reshape(-1, m)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - m + 1], ahead[m - 1 : n])
