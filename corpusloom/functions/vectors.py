"""Vectors: the default encoder, normalisation and sign hashing."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, functions as F

# An encoder turns a batch of texts into one row of floats per text.
Encoder = Callable[[Sequence[str]], np.ndarray]


class WordHashEncoder:
    """Counts of lower-case words, hashed to `dim` places, of unit length.

    It stands in for a language model: no model files are needed. Any callable
    with the same shape can be used in its place."""

    def __init__(self, dim: int = 256) -> None:
        self.dim = dim
        self._place: dict[str, int] = {}

    def _of(self, word: str) -> int:
        place = self._place.get(word)
        if place is None:
            place = int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % self.dim
            if len(self._place) < 100_000:  # only a memo; misses are computed
                self._place[word] = place
        return place

    def __getstate__(self):
        return {"dim": self.dim, "_place": {}}

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        for i, text in enumerate(texts):
            places = [self._of(w) for w in re.findall(r"[^\W_]+", text.lower())]
            if places:
                out[i] = np.bincount(places, minlength=self.dim)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1.0)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column | str) -> Column:
    """Vector of length 1; a zero vector stays as it is."""
    v = F.col(v) if isinstance(v, str) else v
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def sign_planes(bits: int, dim: int, seed: str = "plane") -> np.ndarray:
    """Fixed directions of +1 and -1; the same on every machine."""
    return np.array(
        [[1.0 if hashlib.md5(f"{seed}:{b}:{d}".encode()).hexdigest()[0] < "8" else -1.0 for d in range(dim)]
         for b in range(bits)]
    )


def cells(matrix: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Number of the cell each vector lies in: one bit per plane."""
    signs = (np.asarray(matrix, dtype=np.float64) @ planes.T) > 0
    return signs.astype(np.int64) @ (1 << np.arange(len(planes), dtype=np.int64))
