"""One-permutation MinHash of character shingles with optimal densification, vectorised over many strings."""

from __future__ import annotations

import numpy as np

from .common import GOLD, U64, mix64

U32 = np.uint32
EMPTY = U32(0xFFFFFFFF)


def char_shingles(lines: list[str], k: int, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hash, or 64-bit if wide, of every k-character shingle of every line, number of shingles of each line). A shorter line is one shingle."""
    pad = ["" if len(s) >= k else "\0" * (k - len(s)) for s in lines]
    c = np.frombuffer("".join([s + p for s, p in zip(lines, pad)]).encode("utf-32-le", "surrogatepass"), dtype=U32)
    size = np.array([max(len(s), k) for s in lines], dtype=np.int64)
    n = size - k + 1
    with np.errstate(over="ignore"):
        m = len(c) - k + 1
        h = np.zeros(max(m, 0), dtype=U64)
        for j in range(k):
            h *= U64(0x100000001B3)
            h += c[j : j + m]
        h *= GOLD
        h ^= h >> U64(29)
        h *= U64(0xBF58476D1CE4E5B9)
        h = mix64(h) if wide else (h >> U64(32)).astype(U32)
    keep = np.ones(len(c), dtype=bool)
    if len(lines):
        last = np.cumsum(size)
        for j in range(1, k):
            keep[last - j] = False
    return h[keep[: len(h)]], n


def signatures(lines: list[str], k: int, bins: int) -> np.ndarray:
    """A row of `bins` values for each line: the least hash in each bin, empty bins filled from bins chosen by a fixed hash."""
    h, n = char_shingles(lines, k)
    row = np.repeat(np.arange(len(lines), dtype=np.int64) * bins, n)
    at = row + ((h.astype(U64) * U64(bins)) >> U64(32)).astype(np.int64)
    sig = np.full(len(lines) * bins, EMPTY, dtype=U32)
    with np.errstate(over="ignore"):
        np.minimum.at(sig, at, h * U32(0x9E3779B1) & U32(0xFFFFFFFE))
    sig = sig.reshape(len(lines), bins)
    full = sig != EMPTY
    out, attempt = sig.copy(), 0
    todo_r, todo_b = np.nonzero(~full)
    while len(todo_r):
        with np.errstate(over="ignore"):
            src = (mix64(todo_b.astype(U64) * GOLD + U64(attempt + 1) * U64(0xD6E8FEB86659FD93)) % U64(bins)).astype(np.int64)
        ok = full[todo_r, src]
        out[todo_r[ok], todo_b[ok]] = sig[todo_r[ok], src[ok]] ^ U32(attempt + 1)
        todo_r, todo_b, attempt = todo_r[~ok], todo_b[~ok], attempt + 1
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of `rows` values; the band number is part of it."""
    out = []
    with np.errstate(over="ignore"):
        for b in range(sig.shape[1] // rows):
            x = np.full(len(sig), b + 1, dtype=U64)
            for j in range(rows):
                x = mix64(x * GOLD + sig[:, b * rows + j].astype(U64))
            out.append(x)
    return np.stack(out, axis=1).view(np.int64)
