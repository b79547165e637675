"""Words [^\\x20\\x09-\\x0D]+ of whole columns of texts at once, on the Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from quillmark.llm._common import mix

STRETCH = 1 << 18  # bytes of text handled at a time (and at least one whole text)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_power = np.zeros(0, np.uint64)


def multipliers(n: int) -> np.ndarray:
    """n odd 64-bit numbers, one for each place in a word."""
    global _power
    if n > len(_power):
        _power = mix(np.arange(max(1024, 2 * n), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x51ED270B)) | np.uint64(1)
    return _power[:n]


@dataclass
class Stretch:
    """Consecutive texts: their bytes (A-Z lowered), each word's first byte and length, and each text's words (first, end)."""

    row: int
    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray

    def prefix_sums(self) -> tuple[np.ndarray, np.ndarray]:
        """(running sum of place-weighted bytes over all words' bytes, each word's first place in it)."""
        at = np.cumsum(self.length) - self.length
        place = np.arange(int(self.length.sum()), dtype=np.int32) - np.repeat(at.astype(np.int32), self.length)
        byte = self.data[~_BLANK[self.data]].astype(np.uint64)
        byte += np.uint64(1)
        byte *= multipliers(int(self.length.max(initial=1)))[place]
        return np.cumsum(byte, out=byte), at

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        run, at = self.prefix_sums()
        end = run[at + self.length - 1]
        return mix((end - np.where(at > 0, run[at - 1], np.uint64(0))) ^ (self.length.astype(np.uint64) << np.uint64(48)))


def stretches(texts: pa.Array) -> Iterator[Stretch]:
    """The words of a string column; null texts have none."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, ends, values = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + STRETCH, side="right")) - 1)
        bounds = ends[row : last + 1] - ends[row]
        data = _LOWER[raw[ends[row] : ends[last]]]
        word = ~_BLANK[data]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        cut = bounds[:-1][bounds[:-1] < len(data)]
        begin[cut] = word[cut]
        stop = word.copy()
        stop[:-1] &= ~word[1:]
        cut = bounds[1:][bounds[1:] > 0] - 1
        stop[cut] = word[cut]
        start = np.flatnonzero(begin)
        yield Stretch(row, data, start, np.flatnonzero(stop) + 1 - start, np.searchsorted(start, bounds))
        row = last
