"""Sets of word shingles of whole texts, as 64-bit hashes, made over many rows at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from plumbline.llm.common import U64, RollingHash, groups_of_rows, mix

SLICE_BYTES = 1 << 20
ROLL = RollingHash(8)
#: An odd factor for each word of a shingle.
FACTORS = mix(np.arange(1, 65, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word `[^\\x20\\x09-\\x0D]+`, and how many words each row has."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets) - 1, np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    # A row's first byte begins a word even where the row before ends in one.
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.concatenate([solid[1:], [False]])
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lowered."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with A-Z lowered, and how many words each row has."""
    starts, ends, counts = word_places(data, offsets)
    if not len(starts):
        return np.zeros(0, U64), counts
    return ROLL.stretch(ROLL.sums(lowered(data)), starts, ends), counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row; fewer words than ``size`` are one shingle, none give none."""
    for first, last in groups_of_rows(offsets, SLICE_BYTES):
        part = offsets[first : last + 1] - offsets[first]
        words, counts = word_hashes(data[offsets[first] : offsets[last]], part)
        ends = np.cumsum(counts)
        total = max(len(words) - size + 1, 0)
        joined = np.zeros(total, U64)
        for i in range(size):
            joined += words[i : i + total] * FACTORS[i]
        joined = mix(joined + U64(size))
        for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
            start = end - count
            if count >= size:
                yield np.unique(joined[start : end - size + 1])
            elif count:
                yield mix(np.sum(words[start:end] * FACTORS[:count], keepdims=True, dtype=U64) + U64(count))
            else:
                yield joined[:0]
