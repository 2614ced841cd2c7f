"""Words of many texts at once, as numpy arrays: where they lie, their hashes, and hashes of runs of words.

Words are runs of bytes other than ASCII white space. A polynomial hash of each word comes from one running sum over all
bytes; runs of words combine the mixed hashes of their words. Equal runs always have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd bases of the sums over the bytes of a word, and the factors by which words of a run are moved on: one of each per
#: family of hashes. Hashes of two families are sums of their own, so that words or runs that meet in one differ in the other.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_STEPS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
#: Text bytes that are hashed at a time; the arrays for them take some 40 times as much.
PIECE_BYTES = 1 << 20


def mixed(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    values = values ^ np.uint64(salt)
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def _word_hashes(texts: list[bytes], families: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all words in each family, and the number of words of each text."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    blank = _SPACE[data]
    start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    size = max(2 * PIECE_BYTES, len(data))
    values = data.astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    hashes = []
    for base in _BASES[:families]:
        np.cumsum(values * _powers(base, size)[: len(data)], out=sums[1:])
        hashes.append(mixed((sums[end] - sums[start]) * _powers(pow(base, -1, 1 << 64), size)[start] + (end - start).astype(np.uint64)))
    places = np.cumsum([1] + [len(text) + 1 for text in texts])
    return hashes, np.diff(np.searchsorted(start, places))


def text_pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in lists of PIECE_BYTES each, or of one text."""
    piece, size = [], 0
    for text in texts:
        if piece and size + len(text) > PIECE_BYTES:
            yield piece
            piece, size = [], 0
        piece.append(text)
        size += len(text) + 1
    if piece:
        yield piece


class Words:
    """Words of texts (bytes). hashes: of each word; text: number of its text; first: of each text, its first word, and the end."""

    def __init__(self, texts: list[bytes], families: int = 1):
        found = [_word_hashes(piece, families) for piece in text_pieces(texts)]
        self.families = [np.concatenate([np.zeros(0, dtype=np.uint64), *[hashes[k] for hashes, _ in found]]) for k in range(families)]
        self.hashes = self.families[0]
        self.first = np.cumsum(np.concatenate([[0], *[counts for _, counts in found]]).astype(np.int64))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def runs(self, length: int, salt: int = 0, family: int = 0) -> np.ndarray:
        """Hash of the run of `length` words from each word on; meaningless where the text ends before."""
        n = len(self.hashes)
        total = np.zeros(n, dtype=np.uint64)
        for place in range(min(length, n)):
            total[: n - place] = total[: n - place] * _STEPS[family] if place else total[:n]
            total[: n - place] += self.families[family][place:]
        return mixed(total + np.uint64(length), salt)

    def whole(self, length: int) -> np.ndarray:
        """Words from which a run of `length` lies within one text."""
        n = len(self.hashes) - length + 1
        return np.flatnonzero(self.text[:n] == self.text[length - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)


def members(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted array."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values
