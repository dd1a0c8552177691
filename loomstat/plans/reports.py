"""Reports that put operators together: structure against performance, overlays, narratives, run tables and their comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import binned, pearson
from ..operators import encode, pca, ranks


def structure_against_performance(spark, structure: list[tuple[str, float]], performance: list[tuple[str, float]], most: int = 10) -> DataFrame:
    """(feature, structure_rank, performance_rank, verdict) over the union of both lists' first `most`."""
    ranked = lambda rows, name: spark.createDataFrame([(f, i + 1) for i, (f, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0]))[:most])], f"feature string, {name} bigint")
    both = ranked(structure, "structure_rank").join(ranked(performance, "performance_rank"), "feature", "full")
    verdict = F.when(F.col("structure_rank").isNull(), "drives performance only").when(F.col("performance_rank").isNull(), "shapes structure only").otherwise("both")
    return both.withColumn("verdict", verdict)


def overlay(df: DataFrame, scores: str, target: str, components: int = 5, bins: int = 5) -> DataFrame:
    """(component, pearson, spearman): how a target goes with each component; null without spread."""
    present = df.where(F.col(target).isNotNull())
    out = []
    for k in range(components):
        one = present.select(F.get(scores, k).alias("s"), F.col(target).cast("double").alias("t"))
        both = one.agg(pearson(F.col("s"), F.col("t")).alias("pearson")).crossJoin(ranks.spearman(one, "s", "t").select("spearman"))
        out.append(both.select(F.lit(k + 1).cast("bigint").alias("component"), "pearson", "spearman"))
    return reduce(DataFrame.unionByName, out)


def binned_overlay(df: DataFrame, value: str, target: str, bins: int = 5) -> DataFrame:
    """(bin, n, low, high, median, mean) of the target in equally filled bins of a value."""
    edges = ranks.quantile_edges(df, value, bins)
    if not edges:
        return df.sparkSession.createDataFrame([], "bin bigint, n bigint, low double, high double, median double, mean double")
    at = binned(F.col(value), F.array(*[F.lit(float(e)) for e in edges])).cast("bigint")
    return df.where(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.median(target).alias("median"), F.avg(target).alias("mean"))


def narrative(basis: pca.Basis, sources: list[str], components: int = 3, most: int = 3) -> list[dict]:
    """Of each component its share, the source with the most weight, a name that no earlier component has, and its strongest loadings to either side."""
    out, taken = [], set()
    for k in range(min(components, basis.loadings.shape[1])):
        table = [r for r in pca.loadings(basis, sources, k + 1) if r[0] == k + 1]
        heavy = sorted(table, key=lambda r: (-r[3], r[1]))
        name = next((r[1] for r in heavy if r[1] not in taken), heavy[0][1])
        taken.add(name)
        column = sorted(zip(basis.names, basis.loadings[:, k], strict=True), key=lambda r: (-r[1], r[0]))
        out.append({"component": k + 1, "share": float(basis.share[k]), "dominant": heavy[0][1], "axis": name, "positive": [n for n, v in column[:most] if v > 0], "negative": [n for n, v in reversed(column[-most:]) if v < 0]})
    return out


def representatives(df: DataFrame, scores: str, dimensions: int, key: str, most: int = 3) -> DataFrame:
    """(dimension, side, key, value): the rows at the ends of each dimension."""
    long = df.select(key, F.posexplode(F.slice(scores, 1, dimensions)).alias("dimension", "value"))
    within = Window.partitionBy("dimension")
    ends = long.withColumn("_l", F.row_number().over(within.orderBy("value", key))).withColumn("_h", F.row_number().over(within.orderBy(F.desc("value"), key)))
    pick = lambda side, c: ends.where(F.col(c) <= most).select(F.col("dimension").cast("bigint").alias("dimension"), F.lit(side).alias("side"), key, "value")
    return pick("low", "_l").unionByName(pick("high", "_h"))


def feature_consistency(runs: DataFrame, run: str, feature: str, value: str, top: int = 5) -> DataFrame:
    """(feature, mean, std, top_share): a feature's values over runs, and the share of runs that have it among their `top`."""
    place = runs.withColumn("_k", F.row_number().over(Window.partitionBy(run).orderBy(F.desc(value), feature)))
    return place.groupBy(feature).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.avg((F.col("_k") <= top).cast("double")).alias("top_share"))


def pairwise_runs(runs: DataFrame, run: str, feature: str, value: str) -> DataFrame:
    """(run, other, spearman) of each pair of runs over the features that both have."""
    left = runs.select(F.col(run).alias("run"), feature, F.col(value).alias("_a"))
    right = runs.select(F.col(run).alias("other"), feature, F.col(value).alias("_b"))
    both = left.join(right, feature).where(F.col("run") < F.col("other"))
    return ranks.spearman(both, "_a", "_b", ["run", "other"]).drop("n")


def variation(runs: DataFrame, partition: str, seed: str, metric: str) -> DataFrame:
    """One row: the mean of a metric, its deviation between partitions' means, and the mean deviation between seeds within a partition."""
    inner = runs.groupBy(partition).agg(F.avg(metric).alias("_m"), F.stddev_pop(metric).alias("_s"))
    return inner.agg(F.avg("_m").alias("mean"), F.stddev_pop("_m").alias("between_partitions"), F.avg("_s").alias("within_partitions"))


def leakage_table(strict: DataFrame, full: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """(keys..., strict, full, change): a metric with encoders fitted on training rows alone and on all rows."""
    both = strict.select(*keys, F.col(metric).alias("strict")).join(full.select(*keys, F.col(metric).alias("full")), keys)
    return both.withColumn("change", F.try_divide(F.col("full") - F.col("strict"), "strict"))


def ablation(train: DataFrame, valid: DataFrame, families: dict[str, tuple[list[str], list[str]]], components: int = 5) -> DataFrame:
    """(family, columns, mse): reconstruction of validation rows by components of families of features, all fitted on training rows."""
    rows = []
    for name, (numeric, categories) in families.items():
        encoder = encode.fit(train, numeric, categories)
        basis = pca.fit(encoder.transform(train), "features", encoder.names(), components)
        n, mean, cov = pca.covariance(encoder.transform(valid), "features")
        # the error of a projection follows from the validation rows' mean and covariance
        spread = cov + (mean - basis.mean)[:, None] * (mean - basis.mean)[None]
        left = float(spread.trace() - (basis.loadings.T @ spread @ basis.loadings).trace())
        rows.append((name, len(encoder.names()), left / max(len(encoder.names()), 1)))
    return train.sparkSession.createDataFrame(rows, "family string, columns bigint, mse double")


def overview(df: DataFrame, config: str, workload: list[str], stamp: str) -> DataFrame:
    """One row: runs, configurations, workloads, first and last date."""
    return df.agg(F.count("*").alias("runs"), F.count_distinct(config).alias("configurations"), F.count_distinct(F.struct(*workload)).alias("workloads"), F.min(stamp).alias("first_date"), F.max(stamp).alias("last_date"))
