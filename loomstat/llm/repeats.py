"""Seeds of repeated passages, and their end results, for the two substring deduplications.

A k-gram of words is the anchor of each window of LENGTH words in which it has the least hash (winnowing with the guarantee
that equal windows have equal anchors). So a window can only repeat in another text if its anchor does, and all but the
windows of shared anchors are left out at once, without loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words

LENGTH = 50
K = 16


def anchors(w: words.Words, h: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first window, windows) of each anchor; a window is named by the place of its first word in the text."""
    width = length - k + 1
    n = w.counts
    starts = np.maximum(n - length + 1, 0)
    places = words.ranges(w.first[:-1], starts)
    if not len(places):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    gram = words.grams(h, k)
    least, at, have = gram, np.arange(len(gram)), 1
    while have < width:
        by = min(have, width - have)
        right = least[by:]
        lower = right < least[: len(right)]
        at = np.where(lower, at[by:], at[: len(right)])
        least = np.where(lower, right, least[: len(right)])
        have += by
    chosen = at[places]
    text = np.repeat(np.arange(len(n)), starts)
    new = np.ones(len(chosen), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(chosen)))
    return gram[chosen[first]], text[first], places[first] - w.first[text[first]], many


def _anchor_batches(length: int, k: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seg, bounds in words.slices(batch, "text"):
                w = words.split(seg, bounds)
                anchor, text, start, many = anchors(w, words.hashes(seg, w.start, w.end), length, k)
                yield pa.RecordBatch.from_arrays([words.as_signed(anchor), part.column(0).take(pa.array(text)), pa.array(start.astype(np.int32)), pa.array(many.astype(np.int32))], ["anchor", "doc_id", "start", "many"])

    return apply


def _shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of anchors in two documents or more, of rows sorted by anchor and document; only one document's rows are ever held."""
    held, shared = None, None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        anchor, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        last = np.append(first[1:], len(anchor)) - 1
        many = doc[first] != doc[last]
        if shared is not None:
            many |= anchor[first] == shared
        keep = np.repeat(many, last - first + 1)
        shared, held = (anchor[-1], None) if many[-1] else (None, batch.slice(int(first[-1])))
        yield batch.filter(pa.array(keep))


def _squeezed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, in which they are shuffled."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze(x.as_buffer()) for x in batch.column(1)], pa.binary())], ["doc_id", "squeezed"])


def opened(batch: pa.RecordBatch, most: int = words.SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """As words.slices, of the compressed texts of candidates."""
    inflate = zstandard.ZstdDecompressor().decompress
    texts, size, at = [], 0, 0
    for i, x in enumerate(batch.column(batch.schema.get_field_index("squeezed"))):
        texts.append(inflate(x.as_buffer()))
        size += len(texts[-1])
        if size >= most or i + 1 == batch.num_rows:
            yield batch.slice(at, i + 1 - at), np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            texts, size, at = [], 0, i + 1


def candidates(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(doc_id, squeezed, anchors, starts, manys) of the documents with shared anchors: all runs of windows that may repeat elsewhere.

    docs has doc_id and text, neither null.
    """
    docs = docs.where(F.octet_length("text") >= 2 * length - 1)  # fewer bytes can't hold so many words
    found = docs.mapInArrow(_anchor_batches(length, k), "anchor long, doc_id long, start int, many int")
    shared = found.repartition("anchor").sortWithinPartitions("anchor", "doc_id").mapInArrow(_shared_batches, found.schema)
    runs = shared.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("start").alias("starts"), F.collect_list("many").alias("manys"))
    return docs.mapInArrow(_squeezed_batches, "doc_id long, squeezed binary").join(runs, "doc_id")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)


def merged(windows: DataFrame, length: int, joined: bool, partner: bool = False) -> DataFrame:
    """(doc_id, start_word, end_word, n_words) out of runs (doc_id, low, high) of windows that go on one into the next, by their first words.

    Runs are one span if they share a window; joined: if their words overlap or touch. partner: of the run that begins the span.
    """
    order = Window.partitionBy("doc_id").orderBy("low", "high")
    before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = windows.withColumn("new", F.when(before + (length if joined else 0) >= F.col("low"), 0).otherwise(1))
    parts = parts.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = [F.min_by("partner_id", F.struct("low", -F.col("high"))).alias("partner_id")] if partner else []
    out = parts.groupBy("doc_id", "part").agg(F.min("low").cast("long").alias("start_word"), (F.max("high") + length).cast("long").alias("end_word"), *first)
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), *[c for c in ("partner_id",) if partner])


def oracle(partner: bool) -> str:
    """DuckDB SQL of the spans, windows being joined where the LENGTH + 1 words of two are in another document."""
    other = "CASE WHEN g.a <> m.doc_id THEN g.a ELSE g.b END"
    return f"""
WITH split AS (SELECT doc_id, regexp_extract_all(text, '[^\\x00-\\x20]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - {LENGTH} + 2)) AS s FROM split WHERE len(w) >= {LENGTH}),
wins AS (SELECT doc_id, s, md5(array_to_string(w[s:s + {LENGTH - 1}], ' ')) AS key, CASE WHEN s + {LENGTH} <= len(w) THEN md5(array_to_string(w[s:s + {LENGTH}], ' ')) END AS more FROM places),
docs AS (SELECT DISTINCT key, doc_id FROM wins), longer AS (SELECT DISTINCT more, doc_id FROM wins WHERE more IS NOT NULL),
again AS (SELECT key, min(doc_id) AS a, min(doc_id, 2)[2] AS b FROM docs GROUP BY key HAVING count(*) > 1),
on_ AS (SELECT more, min(doc_id) AS a, min(doc_id, 2)[2] AS b FROM longer GROUP BY more HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, s - 1 AS s, key, more FROM wins WHERE key IN (SELECT key FROM again)),
marked AS (SELECT doc_id, s, key, more, CASE WHEN lag(s) OVER w = s - 1 AND lag(more) OVER w IN (SELECT more FROM on_) THEN 0 ELSE 1 END AS new FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
parts AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS part FROM marked),
spans AS (SELECT doc_id, min(s) AS start_word, max(s) + {LENGTH} AS end_word, max(s) + {LENGTH} - min(s) AS n_words, arg_min(key, s) AS key, arg_min(coalesce(more, ''), s) AS more FROM parts GROUP BY doc_id, part)
""" + (f"SELECT m.doc_id, start_word, end_word, n_words, coalesce({other.replace('g.', 'o.')}, {other}) AS partner_id FROM spans m JOIN again g ON g.key = m.key LEFT JOIN on_ o ON o.more = m.more" if partner else "SELECT doc_id, start_word, end_word, n_words FROM spans")
