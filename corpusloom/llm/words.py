"""Hashes of white-space words and of runs of words, computed with numpy over
whole batches of texts at once.

A word's hash is its polynomial over random byte values, taken as a difference
of prefix sums modulo 2^64, so no loop over words is needed. All hashes are
64 bits and the same in every task and session."""

from __future__ import annotations

import numpy as np

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
CHUNK = 1 << 18  # bytes hashed at a time; a longer word gets a chunk of its own

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BASE = int(_rng.integers(1, 2**63 - 1)) | 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


class Words:
    """Words of a batch of texts. starts, ends: byte positions in `data`;
    hashes: one for each word; first: text i has words first[i] to first[i + 1]."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        begins = np.concatenate(([0], np.cumsum(sizes)))
        blank = np.concatenate(([True], _IS_SPACE[np.frombuffer(self.data, np.uint8)], [True]))
        change = np.flatnonzero(blank[1:] != blank[:-1])
        self.starts, self.ends = change[::2], change[1::2]
        self.first = np.searchsorted(self.starts, begins)
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        raw = np.frombuffer(self.data, np.uint8)
        out = np.empty(len(self.starts), np.uint64)
        j = 0
        while j < len(out):
            begin = self.starts[j]
            k = max(j + 1, int(np.searchsorted(self.starts, begin + CHUNK)))
            end = self.ends[k - 1]
            up, down = powers(int(end - begin))
            sums = np.zeros(end - begin + 1, np.uint64)
            np.cumsum(_BYTE[raw[begin:end]] * up[: end - begin], out=sums[1:])
            s, e = self.starts[j:k] - begin, self.ends[j:k] - begin
            out[j:k] = mix((sums[e] - sums[s]) * down[s])
            j = k
        return out

    def words(self, i: int) -> list[bytes]:
        return [self.data[s:e] for s, e in zip(self.starts[self.first[i] : self.first[i + 1]], self.ends[self.first[i] : self.first[i + 1]])]


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of `n` words; fewer words than `n` are one run."""
    m = min(n, len(hashes))
    if m == 0:
        return np.empty(0, np.uint64)
    up, _ = powers(n + 1)
    count = len(hashes) - m + 1
    total = np.full(count, up[n : n + 1] * np.uint64(m))
    for j in range(m):
        total += hashes[j : j + count] * up[j]
    return mix(total)
