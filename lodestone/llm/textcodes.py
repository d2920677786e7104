"""Texts as arrays of code points and words as 64-bit hashes, a bounded number of characters at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Characters worked on at once; a longer text is worked on alone.
CHUNK_CHARS = 2_000_000


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of SplitMix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(texts: pa.Array, most: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, texts) of consecutive runs of about `most` characters; null texts are empty."""
    at, size, run = 0, 0, []
    for i, t in enumerate(texts):
        s = t.as_py() or ""
        if run and size + len(s) > most:
            yield at, run
            at, size, run = i, 0, []
        run.append(s)
        size += len(s)
    if run:
        yield at, run


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each text starts (one more offset at the end)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


@dataclass
class Words:
    """Words between ASCII white space: hash and text index of each; first: index of each text's first word."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(cps: np.ndarray, offsets: np.ndarray) -> Words:
    """Hash every word by a sum of independent values of (character, place in the word)."""
    solid = ~((cps == 32) | ((cps >= 9) & (cps <= 13)))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(cps)]
    begins[edges] |= solid[edges]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), first, starts, starts)
    at = np.flatnonzero(solid)
    rank = np.cumsum(begins[at]) - 1
    place = (at - starts[rank]).astype(np.uint64)
    terms = mix64(cps[at].astype(np.uint64) | (place << np.uint64(21)))
    heads = np.searchsorted(at, starts)
    lengths = np.diff(np.append(heads, len(at)))
    return Words(np.add.reduceat(terms, heads), first, starts, starts + lengths)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on, by doubling; the last n - 1 places hold no window."""
    out, size = mix64(hashes), 1
    parts, left = [], n
    while True:  # binary decomposition of n, largest windows doubled from smaller ones
        if left & 1:
            parts.append((size, out))
        left >>= 1
        if not left:
            break
        ahead = np.zeros_like(out)
        ahead[:-size or None] = out[size:] if size < len(out) else ahead[:0]
        if size >= len(out):
            ahead[:] = 0
        out = mix64(out * np.uint64(3) + mix64(ahead + np.uint64(size)))
        size *= 2
    total, shift = np.zeros_like(hashes), 0
    for size, part in parts:
        moved = np.zeros_like(part)
        if shift < len(part):
            moved[: len(part) - shift] = part[shift:]
        total = mix64(total * np.uint64(5) + moved)
        shift += size
    return total
