"""Folds and roles that keep groups together. Every split is a function of hashes and counts, so it repeats on any cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import shuffled


def greedy_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, fold): the largest group first, of equal ones the least name, each to the fold with the fewest rows; at most as many folds as groups, two groups at least.

    Groups of one size are alike to the plan, so the driver gets how many groups each size has, and no names.
    """
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_n"))
    counts = {r["_n"]: r["_g"] for r in sizes.groupBy("_n").agg(F.count("*").alias("_g")).collect()}  # a row for each size
    if sum(counts.values()) < 2:
        raise ValueError("grouped folds need two groups")
    plan = greedy_plan(counts, min(max(folds, 2), sum(counts.values())))
    plan = df.sparkSession.createDataFrame(plan, "_size bigint, _from bigint, _to bigint, _cycle array<int>")
    order = Window.partitionBy("_n").orderBy(F.col(group).cast("string"))
    placed = sizes.withColumn("_k", F.row_number().over(order) - 1)
    met = placed.join(plan, (F.col("_n") == F.col("_size")) & (F.col("_k") >= F.col("_from")) & (F.col("_k") < F.col("_to")))
    return met.select(group, F.get("_cycle", F.pmod(F.col("_k") - F.col("_from"), F.size("_cycle")).cast("int")).alias("fold"))


def greedy_plan(counts: dict[int, int], folds: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, from, to, cycle): the groups of a size whose ranks are from..to - 1 go to the folds of the cycle in turn.

    Folds with the fewest rows take groups in turn until they have as many as the next fold; so a size has at most as many
    entries as there are folds, twice.
    """
    rows, out = [0] * folds, []
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            order = sorted(range(folds), key=lambda k: (rows[k], k))
            # those that take a group before the least of them is due again
            cycle = [k for k in order if (rows[k], k) < (rows[order[0]] + size, order[0])]
            due = [k for k in order if k not in cycle]
            # rounds after which the cycle is still the same: until its first member would not be before the next fold
            rounds = min([left // len(cycle), *[max(1, (rows[k] - rows[cycle[0]] - (k < cycle[0])) // size) for k in due[:1]]])
            if rounds:
                n = rounds * len(cycle)
            else:
                rounds, n = 1, left
                cycle = cycle[:left]
            out.append((size, rank, rank + n, cycle))
            for k in cycle:
                rows[k] += rounds * size
            rank, left = rank + n, left - n
    return out


def hashed_folds(df: DataFrame, group: str, folds: int, seed: int) -> DataFrame:
    """(group, fold): groups in a random order that the seed fixes, cut into equal parts."""
    groups = df.where(F.col(group).isNotNull()).select(group).distinct().withColumn("_h", shuffled(seed, group))
    order = Window.partitionBy(F.lit(0)).orderBy("_h", group)  # one row a group: a table of the size of a dimension
    place = groups.withColumn("_k", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0))))
    return place.select(group, F.floor(F.col("_k") * folds / F.col("_n")).cast("int").alias("fold"))


def random_folds(df: DataFrame, folds: int, seed: int, *keys: str) -> DataFrame:
    """df with fold by a hash of the row's keys; no shuffle."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(folds)).cast("int"))


def known_group_folds(df: DataFrame, group: str, folds: int, seed: int, key: str) -> DataFrame:
    """Rows for validation on known groups: one row of each group of two or more, at random, with a fold; every fold's groups stay in training through their other rows."""
    within = Window.partitionBy(group)
    picked = df.withColumn("_h", shuffled(seed, key)).withColumn("_n", F.count("*").over(within)).withColumn("_k", F.row_number().over(within.orderBy("_h", key)))
    picked = picked.where((F.col("_n") >= 2) & (F.col("_k") == 1))
    return picked.withColumn("fold", (F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint") % folds).cast("int")).drop("_h", "_n", "_k")


def three_roles(df: DataFrame, group: str, seed: int) -> DataFrame:
    """(group, role): half of the groups context, a quarter uncertainty, a quarter calibration."""
    order = Window.partitionBy(F.lit(0)).orderBy("_h", group)
    groups = df.where(F.col(group).isNotNull()).select(group).distinct().withColumn("_h", shuffled(seed, group))
    place = groups.withColumn("_k", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0))))
    role = F.when(F.col("_k") * 4 < F.col("_n") * 2, "context").when(F.col("_k") * 4 < F.col("_n") * 3, "uncertainty").otherwise("calibration")
    return place.select(group, role.alias("role"))


def overlap(assigned: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """(group, folds) of groups in more than one fold; no rows if nothing leaks."""
    return assigned.groupBy(group).agg(F.count_distinct(fold).alias("folds")).where("folds > 1")


def assert_disjoint(assigned: DataFrame, group: str, fold: str = "fold") -> None:
    if leaks := overlap(assigned, group, fold).head(3):
        raise ValueError(f"groups in several folds: {[r[0] for r in leaks]}")
