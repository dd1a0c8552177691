"""Vectorised words and word hashes over Arrow string buffers.

A word is a maximal run of bytes above 0x20. All functions work on whole Arrow batches in NumPy, without a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are held as NumPy arrays at once. It bounds memory only: a longer text makes a slice of its own, whole.
SLICE_BYTES = 2 << 20
WORD_MUL = U64(0x9E3779B97F4A7C15)
ROLL_MUL = U64(0xD6E8FEB86659FD93)


@dataclass
class Words:
    """Words of some texts: seg holds the bytes, word w is seg[start[w]:end[w]], text d has the words first[d]:first[d + 1]."""

    seg: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive parts of a batch of about `most` bytes of text each, with the bytes and offsets of their texts."""
    if not batch.num_rows:
        return
    data, offsets = byte_view(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def split(seg: np.ndarray, bounds: np.ndarray, inside: np.ndarray | None = None) -> Words:
    """Words of the texts in seg. inside: which bytes belong to words; by default those above 0x20."""
    inside = seg > 32 if inside is None else inside
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = bounds[(bounds > 0) & (bounds < len(seg))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(begins)
    return Words(seg, bounds, start, np.flatnonzero(ends) + 1, np.searchsorted(start, bounds))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def hashes(seg: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of seg[start:end], eight bytes a step."""
    left = (end - start).astype(np.int64)
    h = mix(left.astype(U64) * WORD_MUL + U64(seed))
    if not len(h):
        return h
    padded = np.concatenate([seg, np.zeros(8, np.uint8)])
    window = np.ndarray((len(seg) + 1,), "<u8", padded, strides=(1,))
    mask = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
    todo, at = None, start
    while True:
        piece = window[at] & mask[np.minimum(left, 8)]
        if todo is None:
            h = mix(h ^ piece)
        else:
            h[todo] = mix(h[todo] * WORD_MUL ^ piece)
        more = left > 8
        if not more.any():
            return h
        todo = np.flatnonzero(more) if todo is None else todo[more]
        at, left = at[more] + 8, left[more] - 8


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values that begin at each place; the last k - 1 places wrap and mean nothing. By doubling, so about 2 log k passes."""
    out, width, done = None, 1, 0
    power, result_power = h.copy(), ROLL_MUL
    while True:
        if k & width:
            out = power.copy() if out is None else out * U64(pow(int(ROLL_MUL), width, 1 << 64)) + np.roll(power, -done)
            done += width
        width *= 2
        if width > k:
            return mix(out)
        result_power = U64(pow(int(ROLL_MUL), width // 2, 1 << 64))
        power = power * result_power + np.roll(power, -(width // 2))


def spread(first: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of count[i] each, one after another."""
    total = int(count.sum())
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(start - (np.cumsum(count) - count), count)


def as_signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower_table()
#: Letters, digits and every byte of a multi-byte character.
ALNUM = np.array([48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in range(256)])


def lowered(seg: np.ndarray) -> np.ndarray:
    """The bytes in lower case, for ASCII and for the accented capitals of U+00C0 to U+00DE."""
    out = LOWER[seg]
    accents = np.flatnonzero(seg[:-1] == 0xC3) + 1
    capitals = accents[(seg[accents] >= 0x80) & (seg[accents] <= 0x9E) & (seg[accents] != 0x97)]
    out[capitals] += 32
    return out


def plain(seg: np.ndarray, bounds: np.ndarray) -> Words:
    """Words as runs of letters and digits in lower case: punctuation, case and layout don't count."""
    low = lowered(seg)
    return split(low, bounds, ALNUM[low])
