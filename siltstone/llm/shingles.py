"""Word shingles of whole texts as sorted sets of 64-bit hashes, vectorised over Arrow buffers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from siltstone.llm.common import LOWER, Roller, mix, text_bytes, words


def shingle_sets(array: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its `width`-word shingles; words split at space and 0x09-0x0D, A-Z lowered.

    A text with fewer words gives its whole sequence as one shingle; one without words, and null, an empty set.
    """
    data, offsets = text_bytes(array)
    starts, ends, first = words(data, offsets)
    hashes = Roller(LOWER[data]).hashes(starts, ends)
    n = len(hashes)
    rolled = hashes.copy()
    for k in range(1, width):
        rolled[: n - k] = mix(rolled[: n - k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        count = b - a
        if count >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif count:
            yield mix(np.array([int(hashes[a]) ^ 0xA5A5], np.uint64)) if count == 1 else _short(hashes[a:b])
        else:
            yield np.zeros(0, np.uint64)


def _short(hashes: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer words than the width."""
    return np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), np.uint64)


def digest(shingles: np.ndarray) -> bytes:
    """A 16-byte address of a set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
