"""Substring deduplication by seed and extend.

Documents meet at shared winnowed anchors. Every match is extended both ways: for each number of words to the left of the
anchor and the rest to its right, the frame of LENGTH words around it is compared with those of all other documents at
that anchor, and each frame together with the next one, so that a match goes on as long as LENGTH + 1 words at a time are
in another document, and a run of frames is a repeat. What meets is told by 128 bits, the anchor's hash and the frame's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, words


def _frame_batches(length: int):
    """For each shared anchor of each document, the hashes of all frames that have it as anchor, and of the frame behind them, 0 if there is none."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seg, bounds in repeats.opened(batch):
                w = words.split(seg, bounds)
                frame = words.grams(words.hashes(seg, w.start, w.end), length)
                (anchor, runs), (start, _), (many, _) = (repeats.flat(part.column(part.schema.get_field_index(c))) for c in ("anchors", "starts", "manys"))
                doc, many = np.repeat(np.arange(part.num_rows), runs), many.astype(np.int64)
                place = words.ranges(w.first[:-1][doc] + start, many + 1)
                hashes = frame[np.minimum(place, len(frame) - 1)] if len(place) else frame[:0]
                ends = np.cumsum(many + 1) - 1
                hashes[ends[start + many > w.counts[doc] - length]] = 0
                offsets = np.concatenate([[0], 8 * (ends + 1)]).astype(np.int32)
                blobs = pa.Array.from_buffers(pa.binary(), len(anchor), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(hashes.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(anchor), part.column(part.schema.get_field_index("doc_id")).take(pa.array(doc)), pa.array(start), blobs], ["anchor", "doc_id", "start", "frames"])

    return apply


class _Shared:
    """Which of an anchor's items two documents or more have, over batches sorted by anchor and document.

    Of an anchor that goes on, one place is held of each item that two documents have, and of others the places in their one document.
    """

    def __init__(self) -> None:
        none = np.zeros(0, np.int64)
        self.item, self.doc, self.place, self.shown = np.zeros(0, np.uint64), none, none, np.zeros(0, bool)

    def told(self, on: bool, anchor: np.ndarray, item: np.ndarray, doc: np.ndarray, place: np.ndarray, last: int, held_anchor: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, place, the least other document) of the items that are now known to be in two documents, each once."""
        held = slice(None) if on else slice(0)
        n = len(self.item[held])
        anchor = np.concatenate([np.full(n, held_anchor if on else 0, np.int64), anchor])
        item, doc, place = np.concatenate([self.item[held], item]), np.concatenate([self.doc[held], doc]), np.concatenate([self.place[held], place])
        shown = np.concatenate([self.shown[held], np.zeros(len(item) - n, bool)])
        order = np.lexsort((doc, item, anchor))
        by_item, by_doc, by_anchor = item[order], doc[order], anchor[order]
        first = np.flatnonzero(np.r_[True, (by_item[1:] != by_item[:-1]) | (by_anchor[1:] != by_anchor[:-1])]) if len(order) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(order)))
        least = np.repeat(by_doc[first], size)
        own = np.add.reduceat((by_doc == least).astype(np.int64), first) if len(first) else size
        before = np.logical_or.reduceat(shown[order], first) if len(first) else np.zeros(0, bool)
        common = (own < size) | before
        second = np.repeat(by_doc[np.minimum(first + own, len(order) - 1)], size) if len(first) else least
        hit, partner = np.zeros(len(order), bool), np.zeros(len(order), np.int64)
        hit[order], partner[order] = np.repeat(common, size), np.where(by_doc == least, second, least)
        leader = np.zeros(len(order), bool)
        leader[order[first]] = True
        keep = np.flatnonzero((anchor == last) & (leader | ~hit))
        self.item, self.doc, self.place, self.shown = item[keep], doc[keep], place[keep], hit[keep]
        new = hit & ~shown
        return doc[new], place[new], partner[new]


class _Anchors:
    def __init__(self) -> None:
        self.frames, self.chains = _Shared(), _Shared()
        self.anchor: int | None = None

    def extended(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """Runs of frames that are in another document and go on in one, as far as this batch shows them for the first time."""
        anchor, doc, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2))
        blobs = batch.column(3)
        offsets = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
        many = np.diff(offsets).astype(np.int64) // 8 - 1
        all_ = np.frombuffer(blobs.buffers()[2], np.uint64, int((many + 1).sum()), int(offsets[0]))
        row = np.repeat(np.arange(len(doc)), many)
        at = words.ranges(np.cumsum(many + 1) - many - 1, many)
        frame, following = all_[at], all_[at + 1]
        place = words.ranges(start.astype(np.int64), many)
        on, last, held = anchor[0] == self.anchor, anchor[-1], self.anchor
        docs, places, partners = self.frames.told(on, anchor[row], frame, doc[row], place, last, held)
        some = np.flatnonzero(following != 0)
        chain = words.mix(frame[some] * words.ROLL_MUL + following[some])
        chain_docs, chain_places, chain_partners = self.chains.told(on, anchor[row][some], chain, doc[row][some], place[some], last, held)
        self.anchor = last
        # chained frames make runs that reach to the next frame; a frame that doesn't go on is a run of itself
        order = np.lexsort((chain_places, chain_docs))
        chain_docs, chain_places, chain_partners = chain_docs[order], chain_places[order], chain_partners[order]
        new = np.ones(len(order), bool)
        new[1:] = (chain_docs[1:] != chain_docs[:-1]) | (chain_places[1:] > chain_places[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(order))[: len(begin)] - 1
        known = set(zip(chain_docs.tolist(), chain_places.tolist(), strict=True)) if len(chain_docs) < 64 else None
        alone = np.array([p not in known for p in zip(docs.tolist(), places.tolist(), strict=True)], bool) if known is not None else ~_among(docs, places, chain_docs, chain_places)
        columns = [np.concatenate(x) for x in ((chain_docs[begin], docs[alone]), (chain_places[begin], places[alone]), (chain_places[end] + 1, places[alone]), (chain_partners[begin], partners[alone]))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "low", "high", "partner_id"])


def _among(doc: np.ndarray, place: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether each (doc, place) is among (docs, places)."""
    both = np.concatenate([docs, doc])
    names = np.unique(both, return_inverse=True)[1]
    key = (names << 32) + np.concatenate([places, place])
    return np.isin(key[len(docs) :], key[: len(docs)])


def _extend_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = _Anchors()
    for batch in batches:
        if batch.num_rows:
            yield anchors.extended(batch)


def _windows(docs: DataFrame, length: int, k: int, id_column: str, text_column: str) -> DataFrame:
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).where("doc_id is not null and text is not null")
    frames = repeats.candidates(source, length, k).mapInArrow(_frame_batches(length), "anchor long, doc_id long, start int, frames binary")
    frames = frames.repartition("anchor").sortWithinPartitions("anchor", "doc_id")
    return frames.mapInArrow(_extend_batches, "doc_id long, low long, high long, partner_id long")


def repeated_passages(docs: DataFrame, length: int = repeats.LENGTH, k: int = repeats.K, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, n_words): the spans of each document of which every part of `length` words is also in another document, overlapping and touching ones united.

    A word is a run of characters above the space, compared as it is; words count from 0 and end_word is exclusive. Repeats
    within one document alone don't count, nor do those between rows of equal id. Null texts, rows without an id and texts
    of fewer than `length` words have none. An empty table gives an empty result.
    """
    return repeats.merged(_windows(docs, length, k, id_column, text_column), length, True)


def repeats_with_partners(docs: DataFrame, length: int = repeats.LENGTH, k: int = repeats.K, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, n_words, partner_id): the repeats of each document, maximal runs in which any length + 1 words in a row are in another document.

    So two passages that touch or overlap by fewer than `length` words, but have no document in common, are two repeats. A repeat
    of exactly `length` words has those in another document. partner_id is the least other document with the repeat's first
    length + 1 words, or its only `length`. No pairs are made: a document has a row for each repeat, however many have it.
    All else is as in repeated_passages.
    """
    return repeats.merged(_windows(docs, length, k, id_column, text_column), length, False, True)


ORACLE = repeats.oracle(True)
