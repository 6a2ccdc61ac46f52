"""Words of many texts at once, as 64-bit hashes in flat arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
IDENTITY = np.arange(256, dtype=np.uint8)
_STEP, _SEED = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def byte_ends(texts: pa.Array) -> np.ndarray:
    """Running total of the bytes of texts."""
    return np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_SEED)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_SEED)
    return x ^ (x >> np.uint64(32))


class Words:
    """hashes, doc (row of the text), within (place in its text) and left (words to its end, itself included).

    Words are the runs of bytes that are no blank, after each byte has been put through `fold`.
    Equal words have equal hashes; null texts have no words.
    """

    def __init__(self, texts: pa.Array, blank: np.ndarray = BLANK, fold: np.ndarray = IDENTITY) -> None:
        if texts.null_count:
            texts = texts.fill_null(b"")
        if not pa.types.is_binary(texts.type):
            texts = texts.cast(pa.binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        data = whole[offsets[0]:offsets[-1]]
        offsets -= offsets[0]
        inside = ~blank[data]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        start[heads] = inside[heads]
        at = np.flatnonzero(start)
        n = len(at)
        upto = np.searchsorted(at, offsets)
        counts = np.diff(upto)
        self.n_words = counts
        self.doc = np.repeat(np.arange(len(texts)), counts)
        self.within = np.arange(n) - np.repeat(upto[:-1], counts)
        self.left = np.repeat(counts, counts) - self.within
        if n:
            place = np.arange(len(data)) - np.repeat(np.append(0, at), np.diff(np.concatenate([[0], at, [len(data)]])))
            power = np.cumprod(np.full(int(place.max()) + 1, _STEP, np.uint64))
            value = np.where(inside, fold[data].astype(np.uint64) + np.uint64(1), np.uint64(0)) * power[place]
            self.hashes = mix(np.add.reduceat(value, at))
        else:
            self.hashes = np.empty(0, np.uint64)

    def grams(self, size: int) -> np.ndarray:
        """Hashes of `size` words from each word on; runs over the end of a text are not marked."""
        total = np.zeros(max(len(self.hashes) - size + 1, 0), np.uint64)
        for k in range(size):
            total = total * np.uint64(_STEP) + self.hashes[k:k + len(total)]
        return mix(total)
