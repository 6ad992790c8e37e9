"""Word shingles of texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd

_A, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes], key: str = "0123456789123456") -> np.ndarray:
    """A 64-bit hash of each word, the same in every process; another one for another key of 16 characters."""
    cells = np.empty(len(words), object)
    cells[:] = words
    return pd.util.hash_array(cells, hash_key=key, categorize=False)


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for every `size` consecutive words; for fewer words none. By doubling: log2(size) steps."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, "uint64")
    done, out, power, bit = 0, None, hashes, 1
    while True:  # power: hashes of `bit` words from each place
        if size & bit:
            out = power if out is None else mix64(out[: len(hashes) - done - bit + 1] * _A + power[done:])
            done += bit
        if done == size:
            return out[:n]
        power = mix64(power[: len(power) - bit] * _A + power[bit:])
        bit *= 2


def lowered_words(text: str) -> list[bytes]:
    """A-Z lower-cased, then the words [^\\x20\\x09-\\x0D]+ (bytes.lower and bytes.split know ASCII only)."""
    return text.encode("utf-8").lower().split()


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of `size`-word shingles; of fewer words the whole sequence; none without words."""
    words = lowered_words(text or "")
    if not words:
        return np.zeros(0, "uint64")
    hashes = word_hashes(words)
    return np.unique(rolling(hashes, size)) if len(words) >= size else rolling(hashes, len(words))
