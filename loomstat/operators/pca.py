"""Principal components: one pass over the rows for the covariance, a small eigenproblem on the driver, one pass for the scores."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats


def _rows(batch: pa.RecordBatch, column: str) -> np.ndarray:
    values = batch.column(batch.schema.get_field_index(column))
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1)


def covariance(df: DataFrame, features: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and population covariance of a vector column, in one job: each partition makes one matrix, shifted by its own mean, and matrices are added in a tree."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, scatter = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch, features)
            m = x.mean(0)
            s = (x - m).T @ (x - m)
            if mean is None:
                n, mean, scatter = len(x), m, s
            else:
                d, total = m - mean, n + len(x)
                scatter = scatter + s + np.outer(d, d) * (n * len(x) / total)
                mean, n = mean + d * (len(x) / total), total
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tobytes()]), pa.array([scatter.tobytes()])], ["n", "mean", "scatter"])

    found = df.where(F.col(features).isNotNull()).select(features).mapInArrow(apply, PARTIAL)
    some = math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    row = found.repartition(some).mapInArrow(added(0), PARTIAL).repartition(1).mapInArrow(added(0), PARTIAL).first()
    if row is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    mean = np.frombuffer(row["mean"])
    return row["n"], mean, np.frombuffer(row["scatter"]).reshape(len(mean), -1) / row["n"]


PARTIAL = "n long, mean binary, scatter binary"


def _sum(a: tuple | None, b: tuple) -> tuple:
    """Rows, mean and scatter of two sets of rows together."""
    if a is None:
        return b
    (n, mean, scatter), (m, other, theirs) = a, b
    d, total = other - mean, n + m
    return total, mean + d * (m / total), scatter + theirs + np.outer(d, d) * (n * m / total)


def _partial(keys: list, parts: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*keys, pa.array([p[0] for p in parts]), *[pa.array([p[k].tobytes() for p in parts], pa.binary()) for k in (1, 2)]], names)


def added(keys: int):
    """A map that adds rows (n, mean, scatter): all of a partition, or those of equal first column of rows sorted by it. One sum is held at a time."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, names = None, None, None
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                key = batch.column(0).slice(i, 1) if keys else None
                if keys and now is not None and not key.equals(now):
                    yield _partial([now], [total], names)
                    total = None
                mean = np.frombuffer(batch.column(keys + 1)[i].as_buffer())
                total = _sum(total, (batch.column(keys)[i].as_py(), mean, np.frombuffer(batch.column(keys + 2)[i].as_buffer()).reshape(len(mean), -1)))
                now = key
        if total is not None:
            yield _partial([now] if keys else [], [total], names)

    return apply


@dataclass
class Basis:
    """loadings: [feature, component], of unit length with their largest entry positive."""

    names: list[str]
    mean: np.ndarray
    loadings: np.ndarray
    variance: np.ndarray
    share: np.ndarray

    def scores(self, df: DataFrame, features: str, name: str = "scores") -> DataFrame:
        """df with the scores of each row, an array."""
        mean, loadings = self.mean, self.loadings

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    z = (_rows(batch, features) - mean) @ loadings
                    offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))], [*batch.schema.names, name])

        df = df.where(F.col(features).isNotNull())
        return df.mapInArrow(apply, T.StructType([*df.schema, T.StructField(name, T.ArrayType(T.DoubleType()))]))

    def reconstructed(self, scores: np.ndarray) -> np.ndarray:
        return scores @ self.loadings[:, : scores.shape[1]].T + self.mean

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Rows of features as the components rebuild them."""
        return self.reconstructed((x - self.mean) @ self.loadings)


def fit(df: DataFrame, features: str, names: list[str] | None = None, components: int | None = None) -> Basis:
    n, mean, cov = covariance(df, features)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][: components or len(values)]
    values, vectors = np.maximum(values[order], 0), stats.fixed_signs(vectors[:, order])
    total = max(float(np.trace(cov)), 1e-300)
    return Basis(names or [f"x{i}" for i in range(len(mean))], mean, vectors, values * (n / max(n - 1, 1)), values / total)


def explained(basis: Basis) -> list[tuple[int, float, float]]:
    """(component from 1, share, cumulative share)."""
    return [(i + 1, float(s), float(c)) for i, (s, c) in enumerate(zip(basis.share, np.cumsum(basis.share), strict=True))]


def thresholds(basis: Basis, levels: tuple[float, ...] = (0.5, 0.7, 0.8, 0.9, 0.95)) -> dict[float, int | None]:
    """Components that reach each share."""
    cumulative = np.cumsum(basis.share) + 1e-12
    return {t: int(np.searchsorted(cumulative, t)) + 1 if len(cumulative) and cumulative[-1] >= t else None for t in levels}


def loadings(basis: Basis, sources: list[str], components: int) -> list[tuple[int, str, float, float]]:
    """(component, source, signed, absolute): loadings added by source column."""
    out = []
    for k in range(min(components, basis.loadings.shape[1])):
        for s in dict.fromkeys(sources):
            some = basis.loadings[[i for i, x in enumerate(sources) if x == s], k]
            out.append((k + 1, s, float(some.sum()), float(np.abs(some).sum())))
    return out


def contributions(basis: Basis, sources: list[str], components: int) -> list[tuple[str, float, float]]:
    """(source, weight, share): squared loadings by the components' shares of variance."""
    weight = (basis.loadings[:, :components] ** 2 * basis.share[:components]).sum(1)
    found = {s: float(sum(w for w, x in zip(weight, sources, strict=True) if x == s)) for s in dict.fromkeys(sources)}
    total = sum(found.values()) or 1.0
    return sorted(((s, w, w / total) for s, w in found.items()), key=lambda r: (-r[1], r[0]))


def compare(old: Basis, new: Basis, components: int) -> list[tuple[int, float, float, float]]:
    """(component, cosine, change of share, principal angle in degrees) over the union of names, a missing one being 0; signs are aligned first."""
    names = list(dict.fromkeys(old.names + new.names))
    components = min(components, old.loadings.shape[1], new.loadings.shape[1])

    def spread(b: Basis) -> np.ndarray:
        out = np.zeros((len(names), components))
        out[[names.index(n) for n in b.names]] = b.loadings[:, :components]
        return out

    a, b = spread(old), spread(new)
    cosine = np.abs((a * b).sum(0)) / np.maximum(np.linalg.norm(a, axis=0) * np.linalg.norm(b, axis=0), 1e-300)
    angles = stats.principal_angles(a, b)
    return [(k + 1, float(cosine[k]), float(new.share[k] - old.share[k]), float(angles[k])) for k in range(components)]


def stability(df: DataFrame, features: str, key: str, components: int = 5, runs: int = 5, share: float = 0.8, seed: int = 42) -> list[tuple[int, int, float, float]]:
    """(run, component, share, cosine to the first run) over hashed samples of the rows."""
    bases = [fit(df.where(F.pmod(F.xxhash64(F.lit(seed + r), key), F.lit(1000)) < int(1000 * share)), features) for r in range(runs)]
    return [(r, c, float(b.share[c - 1]), cos) for r, b in enumerate(bases) for c, cos, _, _ in compare(bases[0], b, components)]


def stability_summary(runs: DataFrame, warn: float = 0.8, alarm: float = 0.6) -> DataFrame:
    """(component, runs, share_mean, share_std, share_min, share_max, cosine_mean, cosine_min, warning) of rows of `stability`; the first run isn't compared with itself."""
    other = F.when(F.col("run") > 0, F.col("cosine"))
    found = runs.groupBy("component").agg(F.count("*").alias("runs"), F.avg("share").alias("share_mean"), F.stddev_pop("share").alias("share_std"), F.min("share").alias("share_min"), F.max("share").alias("share_max"), F.avg(other).alias("cosine_mean"), F.min(other).alias("cosine_min"))
    return found.withColumn("warning", F.when(F.col("cosine_mean") < alarm, "unstable").when(F.col("cosine_mean") < warn, "weak").otherwise("stable"))


def drivers(bases: list[Basis], component: int, most: int = 10) -> list[tuple[str, float]]:
    """(feature, share of the bases that have it among the `most` largest absolute loadings of a component), the most frequent first."""
    hits: dict[str, int] = {}
    for b in bases:
        size = np.abs(b.loadings[:, component - 1])
        for i in sorted(range(len(size)), key=lambda i: (-size[i], b.names[i]))[:most]:
            hits[b.names[i]] = hits.get(b.names[i], 0) + 1
    return sorted(((n, c / len(bases)) for n, c in hits.items()), key=lambda r: (-r[1], r[0]))


def compared_loadings(old: Basis, new: Basis, components: int) -> dict:
    """Over the features that both have: correlations of the components' aligned loadings, and the cosines of the angles between the spaces."""
    names = [n for n in old.names if n in new.names]
    components = min(components, old.loadings.shape[1], new.loadings.shape[1])
    a, b = (x.loadings[[x.names.index(n) for n in names], :components] for x in (old, new))
    b = b * np.where((a * b).sum(0) < 0, -1, 1)
    angles = stats.principal_angles(a, b)
    return {"features": len(names), "correlation": [stats.correlation(a[:, k], b[:, k]) for k in range(components)], "subspace_cosines": [float(np.cos(np.radians(x))) for x in angles]}


def bootstrap(df: DataFrame, features: str, group: str, runs: int = 20, components: int = 5, seed: int = 17) -> list[tuple[int, int, float, float]]:
    """(component, feature, low, high): 95 % intervals of aligned loadings over resamples of groups.

    Each batch of rows makes a matrix for each of its groups, these are added, and a resample only weighs the groups' sums,
    which come to the driver: a matrix a group.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(0).dictionary_encode()
            of, x = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False), _rows(batch, features)
            parts = []
            for k in np.unique(of):
                some = x[of == k]
                m = some.mean(0)
                parts.append((len(some), m, (some - m).T @ (some - m)))
            first = [int(np.flatnonzero(of == k)[0]) for k in np.unique(of)]
            yield _partial([batch.column(0).take(pa.array(first))], parts, [group, "n", "mean", "scatter"])

    schema = T.StructType([df.schema[group], T.StructField("n", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("mean", "scatter")]])
    parts = df.where(F.col(features).isNotNull()).select(group, features).mapInArrow(apply, schema)
    rows = parts.repartition(group).sortWithinPartitions(group).mapInArrow(added(1), schema).orderBy("mean").collect()
    n = np.array([r["n"] for r in rows], float)
    means = np.stack([np.frombuffer(r["mean"]) for r in rows])
    scatters = np.stack([np.frombuffer(r["scatter"]).reshape(means.shape[1], -1) for r in rows])

    def vectors(weight: np.ndarray) -> np.ndarray:
        w = weight * n
        mean = (w[:, None] * means).sum(0) / w.sum()
        cov = (np.tensordot(weight, scatters, 1) + (means - mean).T @ ((means - mean) * w[:, None])) / w.sum()
        return stats.fixed_signs(np.linalg.eigh(cov)[1][:, ::-1][:, :components])

    base, rng, found = vectors(np.ones(len(n))), np.random.default_rng(seed), []
    for _ in range(runs):
        v = vectors(np.bincount(rng.integers(0, len(n), len(n)), minlength=len(n)).astype(float))
        found.append(v * np.sign((v * base).sum(0)))
    low, high = np.percentile(np.stack(found), [2.5, 97.5], axis=0)
    return [(k + 1, i, float(low[i, k]), float(high[i, k])) for k in range(components) for i in range(base.shape[0])]
