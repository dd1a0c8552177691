"""Applying a packing plan that was made from the counts of sizes alone.

Items of equal size are alike to a packer, so a plan need only say which ranks within a size go where. Its length follows
the number of different sizes, which is bounded, and not the number of items.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Plan:
    """Of the items of `size`, ranks from `first` on go in runs of `each` into bins `bin`, `bin` + 1, ...; the k-th of a run lies at offsets[at + k]."""

    size: array = field(default_factory=lambda: array("q"))
    first: array = field(default_factory=lambda: array("q"))
    bin: array = field(default_factory=lambda: array("q"))
    each: array = field(default_factory=lambda: array("q"))
    at: array = field(default_factory=lambda: array("q"))
    offsets: array = field(default_factory=lambda: array("q"))

    def add(self, size: int, first: int, bin_: int, each: int, offsets: list[int]) -> None:
        for values, value in ((self.size, size), (self.first, first), (self.bin, bin_), (self.each, each), (self.at, len(self.offsets))):
            values.append(value)
        self.offsets.extend(offsets)


def assigned(df: DataFrame, plan: Plan, size: str, rank: str, bin_name: str, offset_name: str | None = None) -> DataFrame:
    """df with each row's bin, and the offset in it, looked up in the plan by binary search. size and rank are longs below 2 ** 25 and 2 ** 38."""
    order = np.lexsort((plan.first, plan.size))
    sizes, first, bins, each, at = (np.array(x, np.int64)[order] for x in (plan.size, plan.first, plan.bin, plan.each, plan.at))
    offsets = np.array([*plan.offsets, 0], np.int64)
    shared = df.sparkSession.sparkContext.broadcast(((sizes << 38) + first, first, bins, each, at, offsets))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, bins, each, at, offsets = shared.value
        for batch in batches:
            if batch.num_rows:
                s, r = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (size, rank))
                k = np.searchsorted(keys, (s << 38) + r, "right") - 1
                past = r - first[k]
                extra = [pa.array(bins[k] + past // each[k])] + ([pa.array(offsets[np.minimum(at[k] + past % each[k], len(offsets) - 1)])] if offset_name else [])
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, bin_name, *([offset_name] if offset_name else [])])

    schema = T.StructType([*df.schema, T.StructField(bin_name, T.LongType()), *([T.StructField(offset_name, T.LongType())] if offset_name else [])])
    return df.mapInArrow(apply, schema)


def counts(df: DataFrame, size: str) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and how many rows each has, on the driver as two arrays; as many entries as there are different sizes."""
    found = df.groupBy(F.col(size).cast("long")).agg(F.count("*")).toArrow()
    return tuple(found.column(k).to_numpy() for k in (0, 1))


def salts(many: np.ndarray, least: int = 32, rows: int = 1 << 20) -> int:
    """Parts into which rows of one size are split to be ranked, so that a part has about `rows` at most."""
    return max(least, -(-int(many.max(initial=0)) // rows))
