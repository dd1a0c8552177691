"""Joining runs with their configurations, and the units of analysis: runs, latest rows, medians, one row a configuration."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import first_value, latest, number, row_identity

KEYS = ("config_id", "benchmark_type", "isl", "osl", "conc")


def grouping_keys(df: DataFrame) -> list[str]:
    return [c for c in KEYS if c in df.columns]


def prefixed(configs: DataFrame, prefix: str = "config_") -> DataFrame:
    """id becomes config_id and all other columns get the prefix, once."""
    return configs.withColumnsRenamed({c: "config_id" if c == "id" else c if c.startswith(prefix) else prefix + c for c in configs.columns})


def join_configurations(runs: DataFrame, configs: DataFrame, key: str = "config_id", check: bool = True) -> DataFrame:
    """Left join of many runs to one configuration. Columns that runs has too are the runs'; without the key on both sides runs are returned.

    With check, repeated configuration keys are an error: otherwise they would multiply runs. No side is broadcast by hint;
    Spark does it below its size limit.
    """
    if key not in runs.columns or key not in configs.columns:
        return runs
    if check and (twice := configs.groupBy(key).count().where("count > 1").select(key).head(5)):
        raise ValueError(f"configurations that occur more than once: {[r[0] for r in twice]}")
    return runs.join(configs.drop(*[c for c in configs.columns if c in runs.columns and c != key]), key, "left")


def majority(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys..., label, n): the most frequent label of each group, of equally frequent ones the least; counted before any shuffle."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.min_by(F.struct(label, "n"), F.struct(-F.col("n"), label)).alias("_b"))
    return best.select(*keys, F.col(f"_b.{label}").alias(label), F.col("_b.n").alias("n"))


def filtered(df: DataFrame, equal: dict[str, Any], stamp: str | None = None, prefix: str = "") -> DataFrame:
    """Rows whose columns, as text, equal the chosen ones, and whose stamp begins with a prefix such as 2026-07; nothing chosen keeps all."""
    for c, v in equal.items():
        df = df.where(F.col(c).cast("string") == F.lit(str(v)))
    return df.where(F.col(stamp).cast("string").startswith(prefix)) if stamp and prefix else df


def cohort_digest(df: DataFrame, keys: list[str], group: str, expected: dict[str, int] | None = None) -> DataFrame:
    """One row: rows, groups, and a digest of all row ids whatever their order. Other numbers than expected are an error."""
    ids = df.select(group, row_identity(*[F.col(c) for c in keys]).alias("_id"))
    found = ids.agg(F.count("*").alias("rows"), F.count_distinct(group).alias("groups"), F.sum(F.conv(F.substring("_id", 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest"))
    if expected:
        row = found.first().asDict()
        if wrong := {k: row[k] for k, v in expected.items() if row[k] != v}:
            raise ValueError(f"unexpected numbers: {wrong}")
    return found


def unmatched(runs: DataFrame, configs: DataFrame, key: str = "config_id") -> DataFrame:
    """(key, rows) of runs without a configuration."""
    return runs.join(configs.select(key), key, "left_anti").groupBy(key).agg(F.count("*").alias("rows"))


def median_unit(df: DataFrame, keys: list[str], medians: list[str], modes: list[str] = (), firsts: list[str] = (), ordinal: str | None = None) -> DataFrame:
    """One row a group: medians of numbers, the most frequent of other values (of equally frequent the least), the first metadata by ordinal, and row_count_in_group. Null keys are groups."""
    found = [F.median(number(F.col(c))).alias(c) for c in medians] + [F.mode(c, True).alias(c) for c in modes]
    found += [first_value(F.col(c), F.col(ordinal)).alias(c) for c in firsts]
    return df.groupBy(*keys).agg(*found, F.count("*").alias("row_count_in_group"))


def latest_unit(df: DataFrame, keys: list[str], stamp: str, ordinal: str) -> DataFrame:
    """Each group's last row with row_count_in_group, by partial aggregation; a row whose stamp is null or unreadable counts as the last."""
    others = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(latest(others, F.col(stamp), F.col(ordinal)).alias("_row"), F.count("*").alias("row_count_in_group"))
    return found.select(*keys, "_row.*", "row_count_in_group")


def repeated_groups(df: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Groups of several rows, the largest first."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") >= least).orderBy(F.desc("rows"), *keys)


def snapshot_difference(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., state): groups retained, new or gone between two snapshots, with nulls as values."""
    both = old.select(*keys, F.lit(1).alias("_old"), F.lit(0).alias("_new")).unionByName(new.select(*keys, F.lit(0).alias("_old"), F.lit(1).alias("_new")))
    state = F.when((F.max("_old") == 1) & (F.max("_new") == 1), "retained").when(F.max("_new") == 1, "new").otherwise("gone")
    return both.groupBy(*keys).agg(state.alias("state"))


def sample(df: DataFrame, most: int, seed: int, *keys: str) -> DataFrame:
    """At most `most` rows, at random but always the same: those of the least hash."""
    from ..functions.columns import shuffled

    return df.orderBy(shuffled(seed, *keys), *keys).limit(max(1, most))


def evenly_spaced(df: DataFrame, most: int, order: str) -> DataFrame:
    """At most `most` rows at equal steps of their order."""
    from .ranks import positions

    step = F.greatest(F.ceil(F.col("_total") / most), F.lit(1))
    return positions(df, order).where(F.col("_before") % step == 0).drop("_before", "_ties", "_total")
