"""Words of whole columns of texts, found in the bytes of an Arrow batch.

Words, hashes and windows of all texts of a batch are computed at once on its byte buffer. Every separator is an
ASCII character, so UTF-8 bytes can be split without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text worked on at once; one longer text is worked on alone.
SLICE_BYTES = 1 << 21
_MULTIPLIER = 0x9E3779B97F4A7C15
_U64 = (1 << 64) - 1

#: Separators of plain words: space and the controls 0x09 to 0x0D.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of bare words: every ASCII character but letters and digits.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(c).isalnum() for c in range(128)]

#: Lower case of A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Texts:
    """The bytes of some texts end to end; text i is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()

    def lower(self) -> Texts:
        return Texts(LOWER[self.data], self.offsets)


@dataclass
class Words:
    """Byte spans of the words of some texts; the words of text i are ``first[i]:first[i + 1]``."""

    texts: Texts
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, equal for equal words everywhere under one seed.

        Words are read in lanes of eight bytes, as many rounds as the longest of them has; much longer words are hashed
        one by one. Beside the bytes this takes a few numbers per word, whatever the length of the text.
        """
        data = np.concatenate((self.texts.data, np.zeros(8, np.uint8)))
        lanes = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        out = np.empty(len(self.start), np.uint64)
        for at in range(0, len(out), WORDS_AT_ONCE):
            some = slice(at, at + WORDS_AT_ONCE)
            out[some] = self._hashes(lanes, self.start[some], self.end[some], seed)
        return out

    def _hashes(self, lanes: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
        size = end - start
        out = mixed(size.astype(np.uint64) + np.uint64(mixed_number(seed)))
        left = np.flatnonzero(size <= LONG_WORD)
        at = 0
        while len(left):
            lane = lanes[start[left] + at] & _KEPT_BYTES[np.minimum(size[left] - at, 8)]
            out[left] = mixed((out[left] ^ lane) * np.uint64(_MULTIPLIER) + np.uint64(at))
            at += 8
            left = left[size[left] > at]
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            out[i] = xxhash.xxh64_intdigest(self.texts.data[start[i]:end[i]], seed & _U64)
        return out


#: Words hashed at once.
WORDS_AT_ONCE = 1 << 18
#: Longer words (in bytes) are hashed one by one.
LONG_WORD = 128
#: Masks of the first 0 to 8 bytes of a lane.
_KEPT_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed_number(x: int) -> int:
    """``mixed`` of one number."""
    return int(mixed(np.array([x & _U64], np.uint64))[0])


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The texts of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    n, at = len(column), column.offset
    if not n:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    offsets = np.frombuffer(offsets, np.int64)[at:at + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(data, offsets - offsets[0])


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``limit`` bytes of text each, at least one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(sizes)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words_of(texts: Texts, separators: np.ndarray) -> Words:
    """Maximal runs of bytes that are no separators, within each text."""
    inside = ~separators[texts.data]
    opens, closes = inside.copy(), inside.copy()
    if len(inside):
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edges = texts.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(inside))]
        opens[edges] = inside[edges]
        closes[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes)
    end += 1
    return Words(texts, start, end, np.searchsorted(start, texts.offsets))


def window_hashes(word_hash: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words, by first word; runs may cross texts, the caller masks them.

    Every place in a run has a multiplier of its own, unrelated to the others."""
    n = len(word_hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, product = np.zeros(n, np.uint64), np.empty(n, np.uint64)
    for k in range(width):
        np.multiply(word_hash[k:k + n], np.uint64(mixed_number(_MULTIPLIER + k) | 1), out=product)
        out += product
    return mixed(out)
