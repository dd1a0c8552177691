"""Quality and toxicity classifier: factorisation machines over hashed words, structure statistics and metadata.

score(x) = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2): all pairwise interactions of low rank, in time
linear in the features. One machine per label, trained here on a bounded sample of labelled documents. All words that occur in
LEAST_DOCS documents of the sample are fitted together: the regularisation decides in the fit which weights differ from zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words

#: Labelled documents to train on at most: those of the smallest hash of their id. The only bound here; all documents are scored.
TRAIN_ROWS = 6000
BUCKETS = 1 << 21
RANK = 8
#: A bucket has weights if so many documents of the sample have it; a weight that one or two documents tell can't be checked.
LEAST_DOCS = 3
EPOCHS = 6
BATCH = 128
#: Rates of the linear weights and the factors, and how much their gradients must add up to before they leave zero.
RATE, FACTOR_RATE = 2.0, 0.03
LASSO, FACTOR_LASSO = 20.0, 3.0
DECAY = 1.0
START = 0.05
#: A document's values, as the interactions see them, have at most this length.
REACH = 4.0
#: Lengths of the word beginnings that are features of their own.
PREFIXES = (5, 7)
STATS = 12
BINS = 16
#: Structure and metadata features take the buckets below this one.
RESERVED = 1 << 12


def _stats(seg: np.ndarray, bounds: np.ndarray, w: words.Words, h: np.ndarray) -> np.ndarray:
    """[text, STATS] shares and scaled logarithms between 0 and 1."""
    n_text, size, counts = len(bounds) - 1, np.maximum(np.diff(bounds), 1), np.maximum(w.counts, 1)

    def per_text(marks: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks)])
        return total[edges[1:]] - total[edges[:-1]]

    def share(marks: np.ndarray) -> np.ndarray:
        return per_text(marks, bounds) / size

    upper = (seg >= 65) & (seg <= 90)
    letters = np.maximum(per_text(words.ALNUM[seg], bounds), 1)
    text = words.spread(w.first)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    # text << 40 and 40 bits of the word's hash: equal only for a repeated word
    order = np.sort((text.astype(np.uint64) << words.U64(40)) | (h >> words.U64(24)))
    new = np.ones(len(order), bool)
    new[1:] = order[1:] != order[:-1]
    different = np.bincount((order[new] >> words.U64(40)).astype(np.int64), minlength=n_text)
    out = [
        per_text(upper, bounds) / letters,
        share((seg == 33) | (seg == 63)),
        share((seg >= 35) & (seg <= 38) | (seg == 42) | (seg == 64) | (seg == 126) | (seg == 94)),
        share((seg == 124) | (seg == 60) | (seg == 62) | (seg == 123) | (seg == 125)),
        share((seg >= 48) & (seg <= 57)),
        share(seg == 10) * 10,
        share((seg == 46) | (seg == 44)) * 5,
        share(seg >= 128),
        per_text(again, w.first) / counts,
        different / counts,
        np.log1p(w.counts) / 12,
        np.minimum(letters / counts / 16, 1),
    ]
    return np.clip(np.stack(out, axis=1), 0, 1)


def features(seg: np.ndarray, bounds: np.ndarray, metadata: list[list[str | None]], slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, their texts and values, by text: words and their first PREFIXES bytes by log2(1 + their number), bins of statistics and metadata by 1/2.

    By text and then by bucket. With slot, only the buckets that have a weight.
    """
    w = words.plain(seg, bounds)
    h = words.hashes(w.seg, w.start, w.end)
    n_text = len(bounds) - 1
    text = words.spread(w.first)
    found = [(h, text)]
    for size in PREFIXES:
        long = np.flatnonzero(w.end - w.start > size)
        found.append((words.hashes(w.seg, w.start[long], w.start[long] + size, seed=size), text[long]))
    codes = []
    for hashed, of in found:
        bucket = (hashed % words.U64(BUCKETS - RESERVED)).astype(np.int64) + RESERVED
        if slot is not None:
            use = np.flatnonzero(slot[bucket] >= 0)
            bucket, of = bucket[use], of[use]
        codes.append(of * BUCKETS + bucket)
    stats = _stats(seg, bounds, w, h)
    # bins by the square root, as most shares are near 0
    bins = np.minimum((np.sqrt(stats) * BINS).astype(np.int64), BINS - 1) + np.arange(STATS) * BINS
    meta = np.empty((n_text, len(metadata)), np.int64)
    for k, column in enumerate(metadata):
        names = {v: np.frombuffer(f"{k}={v}".encode(), np.uint8) for v in set(column)}
        known = {v: int(words.hashes(name, np.array([0]), np.array([len(name)]))[0]) % (RESERVED - STATS * BINS) for v, name in names.items()}
        meta[:, k] = [STATS * BINS + known[v] for v in column]
    extra = np.concatenate([bins, meta], axis=1)
    if slot is not None:
        rows, columns = np.nonzero(slot[extra] >= 0)
        codes.append(rows * BUCKETS + extra[rows, columns])
    else:
        codes.append((np.arange(n_text)[:, None] * BUCKETS + extra).ravel())
    pairs, many = np.unique(np.concatenate(codes), return_counts=True)
    text, bucket = pairs // BUCKETS, pairs % BUCKETS
    return bucket, text, np.where(bucket < RESERVED, 0.5, np.log2(1 + many))


@dataclass
class Model:
    """slot: bucket to row of the weights, -1 for a bucket without one. Of each label: bias, linear weights, factors."""

    slot: np.ndarray
    bias: np.ndarray
    linear: np.ndarray
    factors: np.ndarray


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, first[d]:first[d + 1] for each d."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), values.dtype)
    full = first[1:] > first[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, first[:-1][full])
    return out


def reached(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Values as the interactions see them: each document's scaled to the length REACH, shorter ones than 1 less."""
    return x * np.repeat(REACH / np.sqrt(np.maximum(_sums(x * x, first), 1)), np.diff(first)).astype(x.dtype)


def machine(bias: float, linear: np.ndarray, factors: np.ndarray, slot: np.ndarray, text: np.ndarray, x: np.ndarray, n_text: int, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores by the sum-of-squares identity, and sum_i v_if y_i; features sorted by text, y being x in the interactions unless given."""
    first = np.searchsorted(text, np.arange(n_text + 1))
    v = factors[slot] * (x if y is None else y)[:, None]
    sums = _sums(v, first)
    squares = _sums((v * v).sum(axis=1), first)
    return bias + _sums(linear[slot] * x, first) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


class _Weights:
    """Weights that follow the regularised leader: zero until the sum of their gradients exceeds `lasso`, with a rate of their own."""

    def __init__(self, start: np.ndarray, rate: float, lasso: float):
        self.now, self.rate, self.lasso = start.astype(np.float32), rate, lasso
        self.led = -(self.now * (1 / rate + DECAY) + np.sign(self.now) * lasso)
        self.square = np.zeros_like(self.now)

    def step(self, at: np.ndarray, gradient: np.ndarray) -> None:
        before = self.square[at]
        after = before + gradient * gradient
        led = self.led[at] + gradient - (np.sqrt(after) - np.sqrt(before)) / self.rate * self.now[at]
        self.square[at], self.led[at] = after, led
        self.now[at] = -np.sign(led) * np.maximum(np.abs(led) - self.lasso, 0) / ((1 + np.sqrt(after)) / self.rate + DECAY)


def fit(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """samples: buckets and values of each document. labels: [document, label] of 0, 1."""
    n, n_label = labels.shape
    rng = np.random.default_rng(7)
    slot = np.full(BUCKETS, -1, np.int32)
    if not n:
        return Model(slot, np.zeros(n_label), np.zeros((n_label, 0), np.float32), np.zeros((n_label, 0, RANK), np.float32))
    bucket, x = (np.concatenate([s[k] for s in samples]) for k in (0, 1))
    text = np.repeat(np.arange(n), [len(s[0]) for s in samples])
    kept = np.flatnonzero(np.bincount(bucket, minlength=BUCKETS) >= LEAST_DOCS)
    slot[kept] = np.arange(len(kept), dtype=np.int32)
    use = slot[bucket] >= 0
    bucket, text, x = slot[bucket[use]], text[use], x[use].astype(np.float32)
    first = np.searchsorted(text, np.arange(n + 1))
    y = reached(x, first)
    order, batches = rng.permutation(n), []
    for at in range(0, n, BATCH):
        docs = order[at : at + BATCH]
        count = first[docs + 1] - first[docs]
        take = words.ranges(first[docs], count)
        by = np.argsort(bucket[take], kind="stable")
        touched, edges = np.unique(bucket[take][by], return_index=True)
        batches.append((labels[docs].astype(np.float32), np.concatenate([[0], np.cumsum(count)]), bucket[take], x[take, None], y[take, None], by, touched, np.append(edges, len(take))))
    linear = _Weights(np.zeros((len(kept), n_label)), RATE, LASSO)
    factors = _Weights(rng.normal(0, START, (len(kept), n_label * RANK)), FACTOR_RATE, FACTOR_LASSO)
    share = (labels.sum(axis=0) + 1) / (n + 2)
    bias, seen = np.log(share / (1 - share)), np.ones(n_label)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(batches)):
            truth, edges, i, xi, yi, by, touched, ends = batches[k]
            of = np.repeat(np.arange(len(truth)), np.diff(edges))
            v = factors.now[i] * yi
            sums = _sums(v, edges)
            pairs = (sums * sums - _sums(v * v, edges)).reshape(-1, n_label, RANK).sum(axis=2)
            score = bias + _sums(linear.now[i] * xi, edges) + 0.5 * pairs
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - truth).astype(np.float32)
            seen += error.sum(axis=0) ** 2
            bias = bias - RATE * error.sum(axis=0) / np.sqrt(seen)
            linear.step(touched, _sums((error[of] * xi)[by], ends))
            factors.step(touched, _sums((np.repeat(error[of] * yi, RANK, axis=1) * (sums[of] - v))[by], ends))
    split = factors.now.reshape(len(kept), n_label, RANK).transpose(1, 0, 2)
    return Model(slot, bias, np.ascontiguousarray(linear.now.T), np.ascontiguousarray(split))


def score(model: Model, seg: np.ndarray, bounds: np.ndarray, metadata: list[list[str | None]]) -> np.ndarray:
    """[label, text] probabilities."""
    n = len(bounds) - 1
    bucket, text, x = features(seg, bounds, metadata, model.slot)
    slot, x = model.slot[bucket], x.astype(np.float32)
    y = reached(x, np.searchsorted(text, np.arange(n + 1)))
    scores = np.stack([machine(model.bias[k], model.linear[k], model.factors[k], slot, text, x, n, y)[0] for k in range(len(model.bias))])
    return 1 / (1 + np.exp(-np.clip(scores, -30, 30)))


def _metadata(part: pa.RecordBatch, columns: list[str]) -> list[list[str | None]]:
    return [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]


def train(docs: DataFrame, labels: DataFrame, names: tuple[str, ...], id_column: str = "doc_id", text_column: str = "text", metadata: tuple[str, ...] = ("lang", "source"), most: int = TRAIN_ROWS) -> Model:
    """A machine for each label column. At most `most` labelled rows, by the hash of their id, come to the driver as feature lists."""
    metadata = tuple(c for c in metadata if c in docs.columns)
    sample = labels.select(F.col(id_column).alias("_id"), *[F.col(c).cast("double").alias(f"_y{k}") for k, c in enumerate(names)]).dropna()
    sample = F.broadcast(sample.orderBy(F.xxhash64("_id"), "_id").limit(most))  # bounded by a parameter
    source = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"), *[F.col(c).cast("string").alias(f"_m{k}") for k, c in enumerate(metadata)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seg, bounds in words.slices(batch, "_text"):
                bucket, text, x = features(seg, bounds, _metadata(part, [f"_m{k}" for k in range(len(metadata))]))
                edges = np.searchsorted(text, np.arange(part.num_rows + 1))
                lists = [pa.array([v[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()) for v in (bucket.astype(np.int32), x.astype(np.float32))]
                ys = [part.column(part.schema.get_field_index(f"_y{k}")) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([part.column(0), *ys, *lists], ["_id", *[f"_y{k}" for k in range(len(names))], "_b", "_e"])

    joined = source.join(sample, "_id").select("_id", "_text", *[f"_m{k}" for k in range(len(metadata))], *[f"_y{k}" for k in range(len(names))])
    kind = dict(source.dtypes)["_id"]
    found = joined.mapInArrow(apply, f"_id {kind}, " + ", ".join(f"_y{k} double" for k in range(len(names))) + ", _b binary, _e binary").toArrow().combine_chunks()
    rows = sorted(zip(*[found.column(k).to_pylist() for k in range(found.num_columns)], strict=True), key=lambda r: (r[0], r[-2], *r[1:-2]))
    return fit([(np.frombuffer(r[-2], np.int32), np.frombuffer(r[-1], np.float32).astype(float)) for r in rows], np.array([r[1:-2] for r in rows]).reshape(-1, len(names)))


def classify(docs: DataFrame, labels: DataFrame, least_quality: float = 0.5, most_toxic: float = 0.5, scores: bool = True, id_column: str = "doc_id", text_column: str = "text", metadata: tuple[str, ...] = ("lang", "source"), most: int = TRAIN_ROWS) -> DataFrame:
    """The documents that are kept: of a quality of at least least_quality and toxic with at most most_toxic.

    With scores, (doc_id, p_quality, p_toxic) of the kept documents; without, all columns of docs. A null or empty text has
    no words and is scored by its statistics and metadata; null metadata is a value of its own, and metadata columns that docs lacks are left out; rows without an id are scored
    like others. Repeated rows are scored each by itself, alike. Labels that are null don't count; without any labels both
    probabilities are 0.5 and all documents are kept. Documents that are both in the sample and scored get no special treatment.
    """
    metadata = tuple(c for c in metadata if c in docs.columns)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, ("quality", "toxic"), id_column, text_column, metadata, most))
    if scores:
        docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), *[F.col(c).cast("string").alias(f"m{k}") for k, c in enumerate(metadata)])
        schema = T.StructType([docs.schema["doc_id"], T.StructField("p_quality", T.DoubleType()), T.StructField("p_toxic", T.DoubleType())])
        text_name, columns = "text", [f"m{k}" for k in range(len(metadata))]
    else:
        schema, text_name, columns = docs.schema, text_column, list(metadata)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seg, bounds in words.slices(batch, text_name):
                p = np.round(score(model.value, seg, bounds, _metadata(part, columns)), 6)
                keep = pa.array((p[0] >= least_quality) & (p[1] <= most_toxic))
                if scores:
                    part = pa.RecordBatch.from_arrays([part.column(0), pa.array(p[0]), pa.array(p[1])], ["doc_id", "p_quality", "p_toxic"])
                yield part.filter(keep)

    return docs.mapInArrow(apply, schema)
