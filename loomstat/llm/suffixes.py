"""Suffix-array deduplication by distributed prefix doubling.

The suffixes that begin at each word are ranked by their first h words. Suffixes of equal rank by 2h words are those of
equal pairs (rank at i, rank at i + h), so a round sorts the pairs and gives new ranks; what is left with a rank that no
other document has is unique and drops out. Offsets grow until LENGTH words are ranked. Spark partitions the pairs by
range of rank, each partition sorts its range, and new ranks go back to the documents' partitions for the next round.
Suffixes travel as arrays, some thousands to a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, words

#: Words by which suffixes are ranked at first, by the hash of these words. Two documents with an equal passage of LENGTH words have all its parts in common.
START = 13
SLICE_BYTES = 8 << 20
#: A rank has the number of the range in the bits from this one on, and the place in the range below.
PLACE_BITS = 32
#: Ranks and first hashes have 48 bits, so a pair is told by 96; with more than 1 << 16 ranges all 64 bits travel.
RANK_BYTES = 6
PACKED = "part int, docs binary, runs binary, pos binary, low binary, high binary, more binary"
NAMES = ["part", "docs", "runs", "pos", "low", "high", "more"]
#: The rank of what isn't there, or is unique.
NONE = np.uint64((1 << 48) - 1)


def _bytes(ranks: np.ndarray) -> bytes:
    wide = len(ranks) and int(ranks.max()) >> (8 * RANK_BYTES)
    return ranks.tobytes() if wide else np.ascontiguousarray(ranks.view(np.uint8).reshape(-1, 8)[:, :RANK_BYTES]).tobytes()


def _ranks(data: pa.Scalar, n: int) -> np.ndarray:
    raw = np.frombuffer(data.as_buffer(), np.uint8)
    out = np.zeros((n if len(raw) else 0, 8), np.uint8)
    if len(out):
        raw = raw.reshape(n, -1)
        out[:, : raw.shape[1]] = raw
    return out.view("<u8")[:, 0]


def packed(part: np.ndarray, doc: np.ndarray, pos: np.ndarray, low: np.ndarray, high: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    """A row for each part: its documents, how many suffixes each has, and each suffix's place and ranks."""
    order = np.lexsort((pos, doc, part))
    part, doc, pos = part[order], doc[order], pos[order].astype(np.int32)
    low, high, more = (x[order] if len(x) else x for x in (low, high, more))
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
    rows: list[list] = [[] for _ in NAMES]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        some = doc[a:b]
        first = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
        values = (int(part[a]), some[first].tobytes(), np.diff(np.append(first, b - a)).astype(np.int32).tobytes(), pos[a:b].tobytes(), _bytes(low[a:b]), _bytes(high[a:b]), _bytes(more[a:b]))
        for column, value in zip(rows, values, strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(c, pa.binary()) for c in rows[1:]]], NAMES)


def unpacked(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, low, high, more) of all suffixes of some rows."""

    def column(name: str, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(x.as_buffer(), kind) for b in batches for x in b.column(name)] or [np.zeros(0, kind)])

    def ranks(name: str) -> np.ndarray:
        return np.concatenate([_ranks(x, len(p.as_buffer()) // 4) for b in batches for x, p in zip(b.column(name), b.column("pos"), strict=True)] or [np.zeros(0, np.uint64)])

    return np.repeat(column("docs", np.int64), column("runs", np.int32)), column("pos", np.int32).astype(np.int64), ranks("low"), ranks("high"), ranks("more")


def by_part(apply: Callable[[int, list[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A map over rows sorted by part, that calls apply with all rows of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                part = batch.column(0).to_numpy()
                now = held[0].column(0)[0].as_py() if held else part[0]
                cut = int(np.searchsorted(part, now, "right"))
                if cut:
                    held.append(batch.slice(0, cut))
                batch = batch.slice(cut)
                if batch.num_rows:
                    yield from apply(int(now), held)
                    held = []
        if held:
            yield from apply(int(held[0].column(0)[0].as_py()), held)

    return run


def _first_pairs(step: int, reach: int, parts: int, last: bool):
    """Pairs of the suffixes that begin in, or in `reach` words behind, a window that may repeat."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seg, bounds in repeats.opened(batch, SLICE_BYTES):
                w = words.split(seg, bounds)
                gram = words.grams(words.hashes(seg, w.start, w.end), START)
                (_, runs), (start, _), (many, _) = (repeats.flat(part.column(part.schema.get_field_index(c))) for c in ("anchors", "starts", "manys"))
                text = np.repeat(np.arange(part.num_rows), runs)
                wanted = np.zeros(len(gram) + 1, np.int64)
                np.add.at(wanted, w.first[:-1][text] + start, 1)
                np.add.at(wanted, w.first[:-1][text] + start + many + reach, -1)
                at = np.flatnonzero(np.cumsum(wanted[:-1]) > 0)
                of = np.searchsorted(w.first, at, "right") - 1
                whole = at + step + START <= w.first[of + 1]
                at, of = at[whole], of[whole]
                ids = part.column(part.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
                low, high = gram[at] >> words.U64(16), gram[at + step] >> words.U64(16)
                more = low[:0]
                if last:
                    there = at + step + 1 + START <= w.first[of + 1]
                    more = np.where(there, gram[np.minimum(at + step + 1, len(gram) - 1)] >> words.U64(16), NONE)
                yield packed((low >> words.U64(16)).astype(np.int64) * parts >> 32, ids[of], at - w.first[of], low, high, more)

    return apply


def _ranked(parts: int, last: bool):
    """New ranks of one range's pairs, for the partitions of the documents.

    The last round needs no ranks, but each suffix's place, doubled, and 1 if it goes on by a word in another document.
    """

    def apply(part: int, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, pos, low, high, more = unpacked(rows)
        order = np.lexsort((more, high, low) if last else (high, low))
        doc, pos, low, high = doc[order], pos[order], low[order], high[order]
        new = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])]

        def in_two(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(low)))
            return np.repeat(np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first), size), np.repeat(first, size)

        keep, first = in_two(new)
        rank = ((part << PLACE_BITS) + first)[keep].astype(np.uint64)
        if last:
            more = more[order]
            goes_on = in_two(new | np.r_[True, more[1:] != more[:-1]])[0] & (more != NONE)
            pos = 2 * pos + goes_on
        doc, pos = doc[keep], pos[keep]
        home = (words.mix(doc.astype(np.uint64)) % words.U64(parts)).astype(np.int64)
        none = rank[:0]
        yield packed(home, doc, pos, none if last else rank, none, none)

    return by_part(apply)


def _next_pairs(step: int, last: bool):
    """Pairs (rank at i, rank at i + step) of one partition of documents; without a second rank a suffix is unique."""

    def apply(_: int, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, pos, rank, _, _ = unpacked(rows)
        names, local = np.unique(doc, return_inverse=True)
        key = (local << 32) + pos
        order = np.argsort(key, kind="stable")
        key, rank, local, pos = key[order], rank[order], local[order], pos[order]


        def of(by: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(key, key[some] + by), len(key) - 1)
            return at, key[at] == key[some] + by

        at, there = of(step, np.arange(len(key)))
        have = np.flatnonzero(there)
        low, more = rank[have], rank[:0]
        if last:
            further, there = of(step + 1, have)
            more = np.where(there, rank[further], NONE)
        yield packed((low >> words.U64(PLACE_BITS)).astype(np.int64), names[local[have]], pos[have], low, rank[at[have]], more)

    return by_part(apply)


def _spans(length: int, joined: bool):
    def apply(_: int, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, pos, _, _, _ = unpacked(rows)
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        once = np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])]  # rows of one id may repeat
        doc, pos, goes_on = doc[once], pos[once] >> 1, pos[once] & 1
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | ((pos[1:] > pos[:-1] + length) if joined else (pos[1:] > pos[:-1] + 1) | (goes_on[:-1] == 0))
        first = np.flatnonzero(new)
        start, end = pos[first], pos[np.append(first[1:], len(doc)) - 1] + length
        yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(start), pa.array(end), pa.array(end - start)], ["doc_id", "start_word", "end_word", "n_words"])

    return by_part(apply)


def repeated_suffixes(docs: DataFrame, length: int = repeats.LENGTH, id_column: str = "doc_id", text_column: str = "text", joined: bool = True) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): the unions of the parts of `length` words of each document that another document has too.

    joined: parts that overlap or touch are united; else only those that begin a word apart and whose length + 1 words together
    are in another document, as in substrings.repeats_with_partners.

    Words and the treatment of nulls, short texts, repeated rows and empty tables are those of substrings.repeated_passages,
    and so are the rows. Repeats of START words or more in one document alone drop out in the round that shows it.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).where("doc_id is not null and text is not null")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps, have = [], START
    while have < length:
        steps.append(min(have, length - have))
        have += steps[-1]

    def exchanged(df: DataFrame) -> DataFrame:
        return df.repartitionById(parts, "part").sortWithinPartitions("part")

    # windows of `length` words are compared from their first words on, so suffixes further on are needed as far as later rounds look
    state = repeats.candidates(source, length, repeats.K).mapInArrow(_first_pairs(steps[0], sum(steps[1:]) + 1, parts, len(steps) == 1), PACKED)
    for k, step in enumerate(steps):
        if k:
            state = exchanged(state).mapInArrow(_next_pairs(step, k == len(steps) - 1), PACKED)
        state = exchanged(state).mapInArrow(_ranked(parts, k == len(steps) - 1), PACKED)
    return exchanged(state).mapInArrow(_spans(length, joined), "doc_id long, start_word long, end_word long, n_words long")


ORACLE = repeats.oracle(False)
