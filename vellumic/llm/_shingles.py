"""Words, shingle sets and minwise sketches of texts."""

from __future__ import annotations

import numpy as np
import xxhash

_ONE, _X, _Y = np.uint64(1), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    MOST = 1 << 18

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = WordHashes()


def words(text: str | None) -> list[bytes]:
    """Runs of anything but the six ASCII spaces, A-Z in lower case; none for null."""
    return text.encode().lower().split() if text else []


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S29)) * _Y
    return x ^ (x >> _S32)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words; of the whole sequence where it is shorter."""
    n = max(1, len(hashes) - width + 1) if len(hashes) else 0
    width = min(width, len(hashes))
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mixed(out * _X + hashes[k : k + n] + _ONE)
    return out


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    return np.unique(windows(word_hashes(words(text)), width))


class Sketcher:
    """``keys`` full minwise tokens and ``size`` 16-bit ones of a shingle set."""

    BLOCK = 4096

    def __init__(self, keys: int, size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.keys = keys
        self.factors = rng.integers(0, 2**63, keys + size, dtype=np.uint64) * np.uint64(2) + _ONE
        self.shifts = rng.integers(0, 2**63, keys + size, dtype=np.uint64)

    def __call__(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.full(len(self.factors), np.uint64(2**64 - 1), np.uint64)
        for k in range(0, len(shingles), self.BLOCK):
            part = shingles[k : k + self.BLOCK]
            np.minimum(low, (self.factors[:, None] * part[None, :] + self.shifts[:, None]).min(axis=1), out=low)
        token = mixed(low)
        return token[: self.keys], (token[self.keys :] >> np.uint64(48)).astype(np.uint16)
