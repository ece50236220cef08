"""Hashed word shingles of texts, shared by the near-duplicate operators."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SEED = 42
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of every ``k``-word sequence (ASCII case folded), repeats included; of the whole sequence if it is shorter."""
    words = [w.encode().translate(LOWER) for w in WORD.findall(text or "")]
    if not words:
        return np.zeros(0, np.uint64)
    h, join = xxhash.xxh64_intdigest, b" ".join
    return np.array([h(join(words[i : i + k]), SEED) for i in range(max(1, len(words) - k + 1))], np.uint64)


def fold(h: np.ndarray) -> np.uint64:
    """SimHash: the bits that over half the hashes set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return _BIT[2 * ones > len(h)].sum(dtype=np.uint64)
