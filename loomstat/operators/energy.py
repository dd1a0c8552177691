"""Observed energy only: support, exact lookup, nearest measured configurations, dominance, conversions. Nothing here predicts."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import positive
from .ranks import quantile_table

#: There is no predictor, and asking for one is an error rather than an estimate.
PREDICTION_AVAILABLE = False


def measured(df: DataFrame, energy: str) -> DataFrame:
    """Rows whose energy is a finite number above 0."""
    return df.where(positive(F.col(energy)).isNotNull())


def conversions(df: DataFrame, joules: str, price: float | None = None) -> DataFrame:
    """df with kwh_per_million_tokens, tokens_per_kwh and, with a price per kWh, cost_per_million_tokens; null for joules that aren't above 0."""
    if price is not None and price < 0:
        raise ValueError("a price can't be negative")
    j = positive(F.col(joules))
    out = df.withColumn("kwh_per_million_tokens", j / 3.6).withColumn("tokens_per_kwh", F.lit(3.6e6) / j)
    return out if price is None else out.withColumn("cost_per_million_tokens", j / 3.6 * F.lit(float(price)))


def aggregate(df: DataFrame, keys: list[str], energy: str, metrics: list[str], stamp: str) -> DataFrame:
    """Medians of energy and metrics, rows and first and last stamp of each measured configuration and workload."""
    return measured(df, energy).groupBy(*keys).agg(*[F.median(c).alias(c) for c in (energy, *metrics)], F.count("*").alias("rows"), F.min(stamp).alias("first_date"), F.max(stamp).alias("last_date"))


def support(df: DataFrame, energy: str, config: str, workload: list[str], stamp: str) -> DataFrame:
    """One row: measured rows, their share of all, configurations, different workloads and the range of stamps."""
    there = positive(F.col(energy)).isNotNull()
    when = lambda c: F.when(there, c)
    return df.agg(F.count_if(there).alias("measured_rows"), F.avg(there.cast("double")).alias("coverage"), F.count_distinct(when(F.col(config))).alias("configurations"), F.count_distinct(when(F.struct(*workload))).alias("workloads"), F.min(when(F.col(stamp))).alias("first_date"), F.max(when(F.col(stamp))).alias("last_date"))


def monthly(df: DataFrame, energy: str, stamp: str) -> DataFrame:
    """(month, n, median, mean) of measured rows."""
    some = measured(df, energy).withColumn("month", F.date_format(stamp, "yyyy-MM"))
    medians = quantile_table(some, [energy], {"median": 0.5}, ["month"])
    return some.groupBy("month").agg(F.count("*").alias("n"), F.avg(energy).alias("mean")).join(medians, "month").select("month", "n", "median", "mean")


def matches(selection: dict[str, Any]):
    """A predicate: all fields equal the selection's, null only null."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in selection.items()])


def unsupported(df: DataFrame, energy: str, selection: dict[str, Any]) -> list[str]:
    """Fields of the selection whose value no measured row has; one pass."""
    row = measured(df, energy).agg(*[F.max(F.col(c).eqNullSafe(F.lit(v))).alias(c) for c, v in selection.items()]).first()
    return [c for c in selection if not row[c]]


def exact_lookup(df: DataFrame, energy: str, selection: dict[str, Any], config: str, stamp: str) -> DataFrame:
    """One row: status observed, no_exact_match or unsupported, with count, configurations, median, min, max and dates of the measured rows that equal the selection in every field."""
    hit = matches(selection)
    there = [F.max(F.col(c).eqNullSafe(F.lit(v))).alias(f"_f{i}") for i, (c, v) in enumerate(selection.items())]
    x = F.when(hit, F.col(energy))
    found = measured(df, energy).agg(*there, F.count_if(hit).alias("n"), F.count_distinct(F.when(hit, F.col(config))).alias("configurations"), F.median(x).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"), F.min(F.when(hit, F.col(stamp))).alias("first_date"), F.max(F.when(hit, F.col(stamp))).alias("last_date"))
    known = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"_f{i}"), F.lit(False)) for i in range(len(selection))])
    status = F.when(F.col("n") > 0, "observed").when(known, "no_exact_match").otherwise("unsupported")
    return found.select(status.alias("status"), "n", "configurations", "median", "min", "max", "first_date", "last_date")


def observed_values(df: DataFrame, energy: str, fields: list[str]) -> DataFrame:
    """(field, place, value): the different values of each field among measured rows, numbers in their order and all else as text."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    rows = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"), (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("_x")) for c in fields]
    found = measured(df, energy).select(F.inline(F.array(*rows))).where("value is not null").distinct()
    return found.withColumn("place", F.row_number().over(Window.partitionBy("field").orderBy("_x", "value")).cast("bigint")).select("field", "place", "value")


def configuration_coverage(df: DataFrame, energy: str, config: str, stamp: str) -> DataFrame:
    """One row: measured rows, measured and all configurations, the share of the former, and the range of stamps."""
    there = positive(F.col(energy)).isNotNull()
    found = df.agg(F.count_if(there).alias("measured_rows"), F.count_distinct(F.when(there, F.col(config))).alias("measured_configurations"), F.count_distinct(config).alias("all_configurations"), F.min(F.when(there, F.col(stamp))).alias("first_date"), F.max(F.when(there, F.col(stamp))).alias("last_date"))
    return found.withColumn("configuration_coverage", F.coalesce(F.try_divide("measured_configurations", "all_configurations"), F.lit(0.0)))


def observed_report(df: DataFrame, energy: str, selection: dict[str, Any], config: str, metrics: list[str], stamp: str, price: float) -> DataFrame:
    """exact_lookup's row with the matching configurations' names in their order, medians of metrics, and conversions of the median energy at a price."""
    if price < 0:
        raise ValueError("a price can't be negative")
    hit = matches(selection)
    names = F.array_join(F.transform(F.array_sort(F.collect_set(F.when(hit, F.col(config).cast("string")))), lambda x: x), ";")  # the result's own size
    more = measured(df, energy).agg(names.alias("config_ids"), *[F.median(F.when(hit, F.col(c))).alias(f"{c}_median") for c in metrics])
    both = exact_lookup(df, energy, selection, config, stamp).crossJoin(more)
    return conversions(both, "median", price)


def nearest(unit: DataFrame, selection: dict[str, Any], numeric: list[str], workload: list[str], energy: str, config: str, most: int = 5) -> DataFrame:
    """The `most` rows of the least distance: differences of numbers by their range over all rows, 1 for another or missing value; rows of the same workload come before any others and hide them. differing_fields names what differs."""
    ranges = unit.agg(*[(F.max(c) - F.min(c)).alias(c) for c in numeric]).first() if numeric else {}
    parts, names = [], []
    for c, v in selection.items():
        same = F.col(c).eqNullSafe(F.lit(v))
        if c in numeric and v is not None and ranges[c]:
            parts.append(F.coalesce(F.abs(F.col(c) - F.lit(v)) / F.lit(float(ranges[c])), F.lit(1.0)))
        else:
            parts.append(F.when(same, 0.0).otherwise(1.0))
        names.append(F.when(~same, F.lit(c)))
    alike = matches({c: selection[c] for c in workload if c in selection}) if any(c in selection for c in workload) else F.lit(True)
    scored = unit.withColumn("distance", reduce(lambda a, b: a + b, parts)).withColumn("differing_fields", F.concat_ws("; ", *names)).withColumn("_alike", alike)
    # the pool is decided by the rows that are kept: if any is alike, they sort first
    best = scored.orderBy(F.desc("_alike"), "distance", energy, config).limit(most)
    return best.withColumn("_any", F.max("_alike").over(Window.partitionBy(F.lit(0)))).where(F.col("_alike") | ~F.col("_any")).drop("_alike", "_any")


def dominated(df: DataFrame, workload: list[str], energy: str, throughput: str) -> DataFrame:
    """df with dominated: whether a row of the same workload needs less energy and has more throughput.

    Without pairs of rows: a workload's different energies, with the largest throughput at each, are swept once.
    """
    best = df.where(F.col(energy).isNotNull()).groupBy(*workload, energy).agg(F.max(throughput).alias("_most"))
    lower = Window.partitionBy(*workload).orderBy(energy).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("_below", F.max("_most").over(lower)).drop("_most")
    same = reduce(lambda a, b: a & b, [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in (*workload, energy)])
    joined = df.alias("_l").join(best.alias("_r"), same, "left")
    return joined.select("_l.*", F.coalesce(F.col("_r._below") > F.col(f"_l.{throughput}"), F.lit(False)).alias("dominated"))
