"""Best-two-fit packing of documents into sequences of a fixed number of words.

A bin is filled greedily, always with the longest unpacked piece that fits. Then its shortest piece goes back if two
unpacked pieces fit the gap that it leaves more tightly. Only counts of lengths decide, so a bin's pattern is repeated as
long as the counts last, and the whole corpus is packed exactly with a plan of a few thousand rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import plans, words
from .shared import checkpointed, ranked

CAPACITY = 2048


def patterns(counts: dict[int, int], capacity: int) -> Iterator[tuple[list[int], int]]:
    """(lengths in a bin, how many such bins), bin after bin; counts has positive lengths of up to capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    index = np.arange(capacity + 1)
    while True:
        below = np.maximum.accumulate(np.where(left > 0, index, 0))  # the longest piece of up to each length
        if not below[capacity]:
            return
        used: dict[int, int] = {}
        bin_, gap = [], capacity
        while gap:
            length = int(below[gap])
            while length and left[length] <= used.get(length, 0):
                length = int(below[length - 1])
            if not length:
                break
            bin_.append(length)
            used[length] = used.get(length, 0) + 1
            gap -= length
        shortest = bin_[-1]
        if gap and len(bin_) > 1:
            room = gap + shortest
            free = left.copy()
            for length, n in used.items():
                free[length] -= n
            some = np.flatnonzero(free[: room + 1] > 0)
            if len(some):
                fits = np.maximum.accumulate(np.where(free > 0, index, 0))
                second = fits[room - some]
                same = (second == some) & (free[some] < 2)
                second[same] = fits[np.maximum(some[same] - 1, 0)]
                total = np.where(second > 0, some + second, 0)
                best = int(total.argmax())
                if total[best] > shortest:
                    used[shortest] -= 1
                    bin_ = [*bin_[:-1], *sorted((int(some[best]), int(second[best])), reverse=True)]
        need: dict[int, int] = {}
        for length in bin_:
            need[length] = need.get(length, 0) + 1
        times = min(int(left[length]) // n for length, n in need.items())
        for length, n in need.items():
            left[length] -= n * times
        yield bin_, times


def plan(counts: dict[int, int], capacity: int) -> plans.Plan:
    out, next_bin, taken = plans.Plan(), 0, dict.fromkeys(counts, 0)
    for bin_, times in patterns(counts, capacity):
        offsets: dict[int, list[int]] = {}
        at = 0
        for length in bin_:
            offsets.setdefault(length, []).append(at)
            at += length
        for length, some in offsets.items():
            out.add(length, taken[length], next_bin, len(some), some)
            taken[length] += len(some) * times
        next_bin += times
    return out


def _pieces(capacity: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seg, bounds in words.slices(batch, "text"):
                n = words.split(seg, bounds).counts
                pieces = -(-n // capacity)
                of = np.repeat(np.arange(len(n)), pieces)
                piece = words.ranges(np.zeros(len(n), np.int64), pieces)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(piece), pa.array(np.minimum(capacity, n[of] - piece * capacity))], ["doc_id", "piece", "n_words"])

    return apply


def pack(docs: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, piece, n_words, bin_id, bin_offset): where each piece of each document lies.

    A word is a run of characters above the space. A text of more than `capacity` words is cut into pieces of `capacity`
    words and a rest; null texts and those without words have no piece. Rows without an id are packed, with a null id. Each
    of repeated rows is packed. Pieces of equal length are taken in the order of a hash of their id. An empty table gives
    an empty result.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    schema = T.StructType([source.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("piece", "n_words")]])
    pieces = checkpointed(source.mapInArrow(_pieces(capacity), schema))
    lengths, many = plans.counts(pieces, "n_words")
    made = plan(dict(zip(lengths.tolist(), many.tolist(), strict=True)), capacity)
    return plans.assigned(ranked(pieces, "n_words", ["doc_id", "piece"], salts=plans.salts(many)), made, "n_words", "rank", "bin_id", "bin_offset").select("doc_id", "piece", "n_words", "bin_id", "bin_offset")
