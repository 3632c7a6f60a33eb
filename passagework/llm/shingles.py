"""Words, word hashes and word shingles of whole texts as arrays; helpers of tasks."""

from __future__ import annotations

import numpy as np
import xxhash

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
S1, S2 = np.uint64(29), np.uint64(32)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``lower`` folds A-Z only. Null has none."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two adjacent pieces from their hashes; order matters."""
    with np.errstate(over="ignore"):
        mixed = (left ^ (left >> S1)) * M1 + (right ^ (right >> S2)) * M2
        mixed = (mixed ^ (mixed >> S2)) * M3
    return mixed ^ (mixed >> S1)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` hashes."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n]
    for i in range(1, length):
        out = joined(out, hashes[i : i + n])
    return out


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of the lower-cased text.

    A text with fewer words gives its whole sequence, one without words nothing.
    """
    hashes = word_hashes(words_of(text, lower=True))
    return np.unique(windows(hashes, min(size, len(hashes)) or 1))
