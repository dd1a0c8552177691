"""Reconstruction, clusters, agreement, stability and neighbours of embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats

#: Bytes of vectors that a cell of the grid of all pairs holds at once.
CELL_BYTES = 32 << 20
#: Pairs whose distances a task holds at once, 8 MB of them, however many rows there are or lie at one distance.
PAIRS = 1 << 20


def reconstruction(df: DataFrame, actual: str, rebuilt: str | Callable[[np.ndarray], np.ndarray], sources: list[str] | None = None) -> DataFrame:
    """(source, mse, mae): errors of each encoded column, or of the encoded columns of each source. rebuilt is a column, or a function of a matrix of actual rows.

    A batch of rows is a matrix, and a partition returns its columns' sums; entries that either side hasn't don't count.
    """

    def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        flat = column.flatten()
        there = np.arange(int(sizes.max()))[None] < sizes[:, None]
        out = np.zeros(there.shape)
        out[there] = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
        if flat.null_count:
            there[there] = flat.is_valid().to_numpy(zero_copy_only=False)
        return out, there

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            a, there = matrix(batch.column(0))
            b, other = (rebuilt(a), there) if callable(rebuilt) else matrix(batch.column(1))
            width = min(a.shape[1], b.shape[1])
            there = there[:, :width] & other[:, :width]
            error = np.where(there, a[:, :width] - b[:, :width], 0.0)
            found = np.stack([there.sum(0), np.einsum("ij,ij->j", error, error), np.abs(error).sum(0)])
            if width > sums.shape[1]:
                sums = np.pad(sums, ((0, 0), (0, width - sums.shape[1])))
            sums[:, :width] += found
        if sums.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.shape[1], dtype=np.int32)), *[pa.array(s) for s in sums]], ["i", "n", "squares", "sizes"])

    parts = df.select(actual, *([] if callable(rebuilt) else [F.col(rebuilt)])).mapInArrow(apply, "i int, n double, squares double, sizes double")
    names = F.array(*[F.lit(s) for s in sources])[F.col("i")] if sources else F.concat(F.lit("x"), F.col("i"))
    return parts.groupBy(names.alias("source")).agg(F.try_divide(F.sum("squares"), F.sum("n")).alias("mse"), F.try_divide(F.sum("sizes"), F.sum("n")).alias("mae"))


def categorical_accuracy(df: DataFrame, actual: str, rebuilt: str, blocks: dict[str, tuple[int, int]]) -> DataFrame:
    """(source, n, accuracy, top2): whether the largest rebuilt entry of a one-hot block, or one of the two largest, is the actual; all-zero blocks are unknown and left out."""
    rows = []
    for source, (at, size) in blocks.items():
        a, b = F.slice(actual, at + 1, size), F.slice(rebuilt, at + 1, size)
        order = F.sort_array(F.transform(b, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
        rows.append(F.struct(F.lit(source).alias("source"), (F.array_position(a, 1.0) - 1).alias("truth"), order[0]["i"].alias("first"), F.try_element_at(order, F.lit(2))["i"].alias("second")))
    long = df.select(F.inline(F.array(*rows))).where("truth >= 0")
    hit = F.col("truth") == F.col("first")
    return long.groupBy("source").agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("accuracy"), F.avg((hit | F.coalesce(F.col("truth") == F.col("second"), F.lit(False))).cast("double")).alias("top2"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n), pairs that occur."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def contingency(df: DataFrame, a: str, b: str) -> np.ndarray:
    """The table of two labellings; its size is that of the labels."""
    rows = df.groupBy(a, b).count().collect()
    xs, ys = sorted({r[0] for r in rows}, key=str), sorted({r[1] for r in rows}, key=str)
    out = np.zeros((len(xs), len(ys)))
    for r in rows:
        out[xs.index(r[0]), ys.index(r[1])] = r[2]
    return out


def agreement(df: DataFrame, a: str, b: str) -> dict[str, float]:
    """Adjusted Rand index, normalised mutual information, and the mean Jaccard overlap of the best assignment of clusters."""
    table = contingency(df, a, b)
    jaccard = table / (table.sum(1)[:, None] + table.sum(0)[None] - table)
    return {"ari": stats.adjusted_rand(table), "nmi": stats.normalised_information(table), "overlap": float(np.mean([jaccard[r, c] for r, c in stats.assignment(jaccard)]))}


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(label, i, n, mean, m2): by cluster and dimension."""
    long = df.select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    return long.groupBy(label, "i").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("m2"))


def cluster_scores(df: DataFrame, vector: str, label: str) -> dict[str, float]:
    """Davies-Bouldin, Calinski-Harabasz and the balance of sizes of a given clustering: one pass for centroids, one for distances."""
    rows = centroids(df, vector, label).orderBy(label, "i").collect()  # clusters x dimensions
    labels = list(dict.fromkeys(r[0] for r in rows))
    means = np.array([[r["mean"] for r in rows if r[0] == c] for c in labels])
    n = np.array([next(r["n"] for r in rows if r[0] == c) for c in labels], float)
    within = sum(r["m2"] for r in rows)
    k, total = len(labels), n.sum()
    between = float((n[:, None] * (means - (n[:, None] * means).sum(0) / total) ** 2).sum())
    centre = F.create_map(*[x for c, m in zip(labels, means, strict=True) for x in (F.lit(c), F.array(*[F.lit(float(v)) for v in m]))])[F.col(label)]
    distance = F.sqrt(F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    spread = {r[0]: r[1] for r in df.groupBy(label).agg(F.avg(distance)).collect()}
    s = np.array([spread[c] for c in labels])
    apart = np.linalg.norm(means[:, None] - means[None], axis=2)
    np.fill_diagonal(apart, np.inf)
    return {"davies_bouldin": float(((s[:, None] + s[None]) / apart).max(1).mean()), "calinski_harabasz": between / (k - 1) / (within / (total - k)), "balance": float(n.min() / n.max())}


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean Euclidean silhouette of sampled rows; a cluster of one counts 0."""
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    names, of = np.unique(labels, return_inverse=True)
    one = np.eye(len(names))[of]
    sums, sizes = d @ one, one.sum(0)
    own = sizes[of]
    a = sums[np.arange(len(x)), of] / np.maximum(own - 1, 1)
    other = sums / sizes
    other[np.arange(len(x)), of] = np.inf
    b = other.min(1)
    return float(np.where(own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0).mean())


def kmeans_sweep(df: DataFrame, vector: str, key: str, ks: tuple[int, ...] = tuple(range(2, 11)), inits: int = 3, seed: int = 42, most: int = 4000) -> list[dict]:
    """For each k the best of several fits, with its scores; the silhouette is of a hashed sample."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from .units import sample

    points = df.select(key, vector, array_to_vector(F.col(vector).cast("array<double>")).alias("_v")).cache()
    out = []
    for k in ks:
        best = min((KMeans(k=k, seed=seed + i, featuresCol="_v", predictionCol="_c").fit(points) for i in range(inits)), key=lambda m: m.summary.trainingCost)
        labelled = best.transform(points).select(key, vector, "_c")
        some = sample(labelled, most, seed, key).select(vector, "_c").toPandas()
        scores = cluster_scores(labelled, vector, "_c")
        out.append({"k": k, "cost": best.summary.trainingCost, "silhouette": silhouette(np.stack(some[vector].to_numpy()).astype(float), some["_c"].to_numpy()), **scores})
    points.unpersist()
    return out


def neighbours(df: DataFrame, vector: str, key: str, k: int = 10, skip_first: bool = False, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(key, rank, neighbour, distance): the k nearest of all rows to each row, equal distances by key; skip_first leaves the very nearest out. Rows without a key or vector take no part.

    All pairs are compared in the cells of a grid of row blocks; a cell keeps the k best of its pairs for each of its queries.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where("key is not null and v is not null")
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    cells = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = max(1, -(-n * 8 * (width or 1) // cell_bytes), min(round(cells**0.5), n // 256))
    block, every = F.pmod(F.xxhash64("key"), F.lit(side)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    corpus = rows.select(block.alias("at"), every.alias("of"), F.lit(0).alias("side"), "key", "v")
    asked = rows.select(every.alias("at"), block.alias("of"), F.lit(1).alias("side"), "key", "v")
    want = k + int(skip_first)

    def nearest(names: np.ndarray, points: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        squares = np.einsum("ij,ij->i", points, points)
        step, part = max(1, PAIRS // len(names)), max(1, PAIRS // points.shape[1])
        for i in range(0, len(ids), step):
            some, own = x[i : i + step], ids[i : i + step]
            size = np.einsum("ij,ij->i", some, some)
            rough = some @ points.T
            rough *= -2
            rough += squares[None]
            rough += size[:, None]
            rough[own[:, None] == names[None]] = np.inf
            limit = np.partition(rough, min(want, len(names)) - 1, axis=1)[:, min(want, len(names)) - 1]
            slack = 1e-9 * (size + squares.max())  # far more than products of matrices are off by
            q, j = np.nonzero((rough <= (limit + slack)[:, None]) & np.isfinite(rough))
            d = np.concatenate([np.sqrt(((points[j[a : a + part]] - some[q[a : a + part]]) ** 2).sum(1)) for a in range(0, len(q), part)] or [np.zeros(0)])
            order = np.lexsort((names[j], d, q))
            q, j, d = q[order], j[order], d[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < want
            yield pa.RecordBatch.from_arrays([pa.array(own[q[keep]]), pa.array(names[j[keep]]), pa.array(d[keep])], ["key", "neighbour", "distance"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, ready = None, [], None
        for batch in batches:
            at, of, kind, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "of", "side", "key"))
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))
            edges = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (of[1:] != of[:-1]) | (kind[1:] != kind[:-1]), True]) if batch.num_rows else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if (at[a], of[a]) != cell:
                    cell, held, ready = (at[a], of[a]), [], None
                if kind[a] == 0:
                    held.append((ids[a:b].copy(), x[a:b]))
                elif held or ready:
                    ready = ready or tuple(np.concatenate(y) for y in zip(*held, strict=True))
                    yield from nearest(*ready, ids[a:b], x[a:b])

    grid = corpus.unionByName(asked).repartition(max(cells, min(side * side, 4 * cells)), "at", "of").sortWithinPartitions("at", "of", "side")
    found = grid.mapInArrow(apply, "key bigint, neighbour bigint, distance double")
    place = F.row_number().over(Window.partitionBy("key").orderBy("distance", "neighbour")).cast("long") - int(skip_first)
    return found.withColumn("rank", place).where((F.col("rank") >= 1) & (F.col("rank") <= k)).select("key", "rank", "neighbour", "distance")


def neighbour_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (n, overlap): the mean Jaccard overlap of two tables of neighbours, over the rows that both have."""
    lists = lambda df, name: df.groupBy("key").agg(F.collect_set("neighbour").alias(name))
    both = lists(a, "_a").join(lists(b, "_b"), "key")  # of k neighbours a row
    return both.agg(F.count("*").alias("n"), F.avg(F.size(F.array_intersect("_a", "_b")) / F.size(F.array_union("_a", "_b"))).alias("overlap"))


def reconstruction_levels(df: DataFrame, actual: str, rebuilt: str | Callable[[np.ndarray], np.ndarray], sources: list[str], kinds: dict[str, str]) -> DataFrame:
    """(level, name, mse, mae): errors of all encoded columns, of each kind of source, and of each source; sources count alike in a kind."""
    by_source = reconstruction(df, actual, rebuilt, sources)
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("source")]
    mean = [F.avg("mse").alias("mse"), F.avg("mae").alias("mae")]
    whole = reconstruction(df, actual, rebuilt).agg(*mean).select(F.lit("overall").alias("level"), F.lit("all").alias("name"), "mse", "mae")
    balanced = by_source.agg(*mean).select(F.lit("balanced").alias("level"), F.lit("all").alias("name"), "mse", "mae")
    typed = by_source.groupBy(kind.alias("name")).agg(*mean).select(F.lit("kind").alias("level"), "name", "mse", "mae")
    return whole.unionByName(balanced).unionByName(typed).unionByName(by_source.select(F.lit("source").alias("level"), F.col("source").alias("name"), "mse", "mae"))


def error_rank(errors: DataFrame, name: str, error: str, by: list[str] = ()) -> DataFrame:
    """errors with rank, the largest error first and equal ones by name."""
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc(error), name)  # a row for each feature
    return errors.withColumn("rank", F.row_number().over(window).cast("bigint"))


def stability(a: np.ndarray, b: np.ndarray, k: int = 10) -> dict[str, float]:
    """Of two embeddings of the same sampled rows: mean absolute correlation after Procrustes, rank correlation of distances, Jaccard overlap of neighbours, and their mean."""
    turned = stats.procrustes(a, b)
    cors = [abs(c) for i in range(a.shape[1]) if (c := stats.correlation(a[:, i], turned[:, i])) is not None]

    def distances(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0))

    da, db = distances(a), distances(b)
    upper = np.triu_indices(len(a), 1)
    ranks = stats.correlation(stats.ranks(da[upper]), stats.ranks(db[upper])) or 0.0
    for d in (da, db):
        np.fill_diagonal(d, np.inf)
    na, nb = np.argsort(da, 1, kind="stable")[:, :k], np.argsort(db, 1, kind="stable")[:, :k]
    shared = np.array([len(set(x) & set(y)) for x, y in zip(na, nb, strict=True)])
    jaccard = float((shared / (na.shape[1] + nb.shape[1] - shared)).mean())
    found = {"alignment": float(np.mean(cors)) if cors else 0.0, "distance_spearman": ranks, "neighbour_jaccard": jaccard}
    return found | {"score": float(np.mean(list(found.values())))}


def ridge(df: DataFrame, vector: str, target: str, alpha: float = 1.0):
    """Linear regression with a penalty of alpha on the sum of squared weights and a free intercept: (weights, intercept), in closed form from one pass."""
    from .pca import covariance

    both = df.where(F.col(target).isNotNull()).select(F.concat(F.col(vector).cast("array<double>"), F.array(F.col(target).cast("double"))).alias("_xy"))
    n, mean, cov = covariance(both, "_xy")
    weights = np.linalg.solve(n * cov[:-1, :-1] + alpha * np.eye(len(mean) - 1), n * cov[:-1, -1])
    return weights, float(mean[-1] - weights @ mean[:-1])
