"""Words and word shingles as 64-bit hashes, a batch of texts at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd

from . import common

U = np.uint64


def mixed(x):
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_lists(texts: list[str]) -> list[list[bytes]]:
    """Lower-cases A-Z only; words are the longest runs without space, tab, LF, VT, FF, CR. bytes.lower and bytes.split do just that."""
    return [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the batch, and where each text's words begin (one more entry than texts)."""
    common.release()
    lists = word_lists(texts)
    at = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=at[1:])
    flat = np.empty(at[-1], object)
    flat[:] = [w for x in lists for w in x]
    return (pd.util.hash_array(flat, categorize=False) if len(flat) else np.empty(0, np.uint64)), at


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of a text's k-word shingles in text order; with fewer words the whole sequence is one; no words, none."""
    n = len(words)
    if n == 0:
        return words
    with np.errstate(over="ignore"):
        take = min(k, n)
        out = np.full(n - take + 1, U(take * 0x9E37), U)
        for i in range(take):
            out = mixed(out * U(0x9E3779B97F4A7C15) + words[i : n - take + 1 + i])
        return out


def shingle_lists(words: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """The shingles of each text of a batch (as `word_hashes` gives it): all windows of k words at once, then cut into texts."""
    every = shingles(words, k) if len(words) >= k else words[:0]
    return [every[a : b - k + 1] if b - a >= k else shingles(words[a:b], k) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
