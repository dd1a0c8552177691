"""Profiles, coverage, missingness and data quality. Exact quantiles take two scans of the data, all else one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import category, corrected_skewness, number
from .ranks import quantile_table

#: Columns in one aggregate: generated code has a size limit.
WIDE = 40


def _long(df: DataFrame, columns: list[str], measures: dict[str, callable], name: str = "column") -> DataFrame:
    """A row for each column with the measures, aggregates of the column's expression, each computed in wide passes and stacked."""
    parts = []
    for at in range(0, len(columns), WIDE):
        some = columns[at : at + WIDE]
        wide = df.agg(*[make(c).alias(f"{m}_{i}") for i, c in enumerate(some) for m, make in measures.items()])
        rows = F.array(*[F.struct(F.lit(c).alias(name), *[F.col(f"{m}_{i}").alias(m) for m in measures]) for i, c in enumerate(some)])
        parts.append(wide.select(F.inline(rows)))
    return reduce(DataFrame.unionByName, parts)


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, missing, mean, std, min, quartiles and max of each numeric column."""
    x = lambda c: number(F.col(c))
    made = {"count": lambda c: F.count(x(c)), "missing": lambda c: F.count_if(x(c).isNull()), "mean": lambda c: F.avg(x(c)), "std": lambda c: F.stddev_samp(x(c)), "min": lambda c: F.min(x(c)), "max": lambda c: F.max(x(c))}
    return _long(df, columns, made).join(quantile_table(df, columns, {"p25": 0.25, "median": 0.5, "p75": 0.75}), "column", "left")


def extended_distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """p1 to p99, population deviation, corrected skewness, and the number of values beyond 1.5 interquartile ranges from the quartiles."""
    x = lambda c: number(F.col(c))
    table = quantile_table(df, columns, {f"p{p}": p / 100 for p in (1, 5, 25, 50, 75, 95, 99)})
    reach = 1.5 * (F.col("p75") - F.col("p25"))
    fences = table.agg(*[F.max(F.when(F.col("column") == c, F.struct((F.col("p25") - reach).alias("a"), (F.col("p75") + reach).alias("b")))).alias(f"_f{i}") for i, c in enumerate(columns)])
    fenced = df.crossJoin(F.broadcast(fences))  # one row
    place = {c: i for i, c in enumerate(columns)}
    made = {"std": lambda c: F.stddev_pop(x(c)), "skewness": lambda c: corrected_skewness(x(c)), "outliers": lambda c: F.count_if(~x(c).between(F.col(f"_f{place[c]}.a"), F.col(f"_f{place[c]}.b")))}
    return _long(fenced, columns, made).join(table, "column", "left").select(*table.columns, "std", "skewness", "outliers")


def value_counts(df: DataFrame, columns: list[str], most: int | None = None) -> DataFrame:
    """(column, value, n, share): values by frequency, in one scan of all columns; at most `most` of each column."""
    from pyspark.sql.window import Window

    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), category(F.col(c)).alias("value")) for c in columns])))
    found = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("column")
    found = found.withColumn("share", F.col("n") / F.sum("n").over(whole))
    if most:
        found = found.withColumn("_k", F.row_number().over(whole.orderBy(F.desc("n"), "value"))).where(F.col("_k") <= most).drop("_k")
    return found


def dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, kind, role, non_null, missing_share, unique): exact counts of each column, with its type and its role by name."""
    from ..functions import roles

    kinds = dict(df.dtypes)
    made = {"non_null": lambda c: F.count(c), "missing_share": lambda c: F.avg(F.col(c).isNull().cast("double")), "unique": lambda c: F.count_distinct(c)}
    found = _long(df, columns, made)
    facts = F.create_map(*[F.lit(x) for c in columns for x in (c, f"{kinds[c]};{roles.feature_family(c)}")])
    fact = F.split(facts[F.col("column")], ";")
    return found.select("column", fact[0].alias("kind"), fact[1].alias("role"), "non_null", "missing_share", "unique")


def feature_dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, source, family, role, dtype, non_null, missing_pct, unique, examples, use, meaning) of each column.

    One scan counts the values of all columns, equal ones before any shuffle; examples are the three least as text.
    """
    from pyspark.sql.window import Window

    from ..functions import roles

    kinds = {f.name: f.dataType for f in df.schema}
    facts = [(c, roles.source_table(c), roles.feature_family(c), roles.role(c), kinds[c].simpleString(), isinstance(kinds[c], T.NumericType), roles.fixed_use(c), roles.varying_use(c), roles.meaning(c)) for c in columns]
    facts = df.sparkSession.createDataFrame(facts, "column string, source string, family string, role string, dtype string, _numeric boolean, _fixed string, _varying string, meaning string")
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])))
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    told = counts.groupBy("column").agg(F.sum("n").alias("_rows"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"), F.count("value").alias("unique"))
    least = counts.where("value is not null").withColumn("_k", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where("_k <= 3")
    examples = least.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("examples"))
    met = facts.join(told, "column", "left").join(examples, "column", "left").na.fill(0, ["non_null", "unique"]).na.fill("", ["examples"])
    use = F.coalesce("_fixed", F.when((F.col("unique") <= 1) | ((F.col("unique") > roles.MOST_LEVELS) & ~F.col("_numeric")), "exclude").otherwise(F.col("_varying")))
    missing = F.coalesce(100 * (1 - F.col("non_null") / F.col("_rows")), F.lit(0.0))
    return met.select("column", "source", "family", "role", "dtype", "non_null", missing.alias("missing_pct"), "unique", "examples", use.alias("use"), "meaning")


def metric_guide(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, kind, direction, use, meaning, non_null, missing_pct) of each metric; one scan."""
    from ..functions import roles

    facts = df.sparkSession.createDataFrame([(c, *roles.metric_kind(c), roles.meaning(c)) for c in metrics], "metric string, kind string, direction string, use string, meaning string")
    counts = _long(df, metrics, {"non_null": lambda c: F.count(c), "missing_pct": lambda c: 100 * F.avg(F.col(c).isNull().cast("double"))}, "metric")
    return facts.join(counts, "metric")


def quality_report(df: DataFrame, columns: list[str], keys: list[str], failed: Column, metrics: list[str], workload: list[str]) -> DataFrame:
    """(check, column, n): repeated keys, failed rows, missing, negative and not positive values where there are any, and columns of one value, of many values without use, or excluded."""
    from ..functions import roles

    grouped = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(failed).alias("_f"), *[F.count_if(F.col(c).isNull()).alias(f"_u{i}") for i, c in enumerate(metrics)], *[F.count_if(F.col(c) < 0).alias(f"_m{i}") for i, c in enumerate(metrics)], *[F.count_if(F.col(c) <= 0).alias(f"_w{i}") for i, c in enumerate(workload)])
    row = lambda check, column, n: F.struct(F.lit(check).alias("check"), F.lit(column).cast("string").alias("column"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n"))
    sums = [row("duplicate_rows", None, F.sum(F.when(F.col("_n") > 1, F.col("_n")))), row("failed_rows", None, F.sum("_f"))]
    sums += [row("missing_values", c, F.sum(f"_u{i}")) for i, c in enumerate(metrics)] + [row("negative_values", c, F.sum(f"_m{i}")) for i, c in enumerate(metrics)] + [row("nonpositive_values", c, F.sum(f"_w{i}")) for i, c in enumerate(workload)]
    counted = grouped.agg(F.array(*sums).alias("_r")).select(F.inline("_r")).where("n > 0 or column is null")
    facts = feature_dictionary(df, columns)
    kinds = {"high_cardinality": (F.col("unique") > roles.MOST_LEVELS) & F.col("role").isin("metadata", "provenance"), "single_value": F.col("unique") <= 1, "excluded": F.col("use") == "exclude"}
    told = facts.select(F.inline(F.array(*[F.struct(F.when(on, F.lit(k)).alias("check"), "column", F.col("unique").alias("n")) for k, on in kinds.items()]))).where("check is not null")
    return counted.unionByName(told)


def described(df: DataFrame, columns: list[str], log: bool = False) -> DataFrame:
    """(column, n, mean, std, min, p25, p50, p75, p90, p95, p99, max) of each column, or of log1p of its values, negative ones left out."""
    some = df.select(*[(F.when(F.col(c) >= 0, F.log1p(F.col(c).cast("double"))) if log else number(F.col(c))).alias(c) for c in columns])
    measures = {"n": lambda c: F.count(c), "mean": lambda c: F.avg(c), "std": lambda c: F.stddev_samp(c), "min": lambda c: F.min(c), "max": lambda c: F.max(c)}
    return _long(some, columns, measures).join(quantile_table(some, columns, {f"p{p}": p / 100 for p in (25, 50, 75, 90, 95, 99)}), "column", "left")


def clipped(df: DataFrame, column: str, low: float = 0.05, high: float = 0.95, name: str = "clipped") -> DataFrame:
    """df with the column's values brought between two of its quantiles, for display."""
    ends = quantile_table(df, [column], {"_low": low, "_high": high}).drop("column")
    return df.crossJoin(F.broadcast(ends)).withColumn(name, F.when(F.col(column).isNotNull(), F.greatest("_low", F.least("_high", column)))).drop("_low", "_high")  # one row


def signs_and_dates(df: DataFrame, value: str, stamp: str, limit) -> DataFrame:
    """One row: values above 0, other values, and rows before, and from a date on."""
    x, before = number(F.col(value)), F.col(stamp) < F.lit(limit)
    return df.agg(F.count_if(x > 0).alias("positive"), F.count_if(x <= 0).alias("nonpositive"), F.count_if(x.isNull()).alias("missing"), F.count_if(before).alias("rows_before"), F.count_if(~before).alias("rows_after"))


def missingness(df: DataFrame, features: list[str], dimension: str | None = None, failed: Column | None = None) -> DataFrame:
    """Shares of missing values: of each feature, by the levels of a dimension, or among failed and other rows."""
    if failed is not None:
        return _long(df.withColumn("_failed", F.coalesce(failed, F.lit(False))), features, {"missing_failed": lambda c: F.avg(F.when(F.col("_failed"), F.col(c).isNull().cast("double"))), "missing_other": lambda c: F.avg(F.when(~F.col("_failed"), F.col(c).isNull().cast("double")))}, "feature")
    if dimension is None:
        return _long(df, features, {"missing_share": lambda c: F.avg(F.col(c).isNull().cast("double"))}, "feature")
    found = df.groupBy(category(F.col(dimension)).alias("level")).agg(F.count("*").alias("rows"), *[F.avg(F.col(c).isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(features)])
    return found.select("level", "rows", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("missing_share")) for i, c in enumerate(features)])))


def quality(df: DataFrame, keys: list[str], failed: Column, metrics: list[str], workload: list[str]) -> DataFrame:
    """One row: rows, rows whose key repeats, failed rows, negative metrics and workload sizes that aren't positive."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(failed).alias("_failed"), *[F.count_if(F.col(c) < 0).alias(f"_m{i}") for i, c in enumerate(metrics)], *[F.count_if(F.col(c) <= 0).alias(f"_w{i}") for i, c in enumerate(workload)])
    total = lambda names: reduce(lambda a, b: a + b, [F.sum(n) for n in names]) if names else F.lit(0).cast("bigint")
    return groups.agg(F.sum("_n").alias("rows"), F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("duplicate_rows"), F.sum("_failed").alias("failed_rows"), total([f"_m{i}" for i in range(len(metrics))]).alias("negative_metrics"), total([f"_w{i}" for i in range(len(workload))]).alias("nonpositive_workload"))


def coverage(df: DataFrame, rows: str, columns: str, levels: list[str]) -> DataFrame:
    """Counts of rows x levels, 0 where there are none; levels are given, so no extra pass looks for them."""
    found = df.groupBy(category(F.col(rows)).alias(rows)).pivot(columns, levels).agg(F.count(F.lit(1)))
    return found.na.fill(0)


def support(df: DataFrame, dimension: str, value: str, least: int = 30) -> DataFrame:
    """(level, n, median, mean, supported): rows with a value in each level, and whether they are enough."""
    some = df.where(F.col(value).isNotNull()).withColumn("level", category(F.col(dimension)))
    medians = quantile_table(some, [value], {"median": 0.5}, ["level"]).drop("column")
    found = some.groupBy("level").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (F.count("*") >= least).alias("supported"))
    return found.join(medians, "level", "left").select("level", "n", "median", "mean", "supported")


def sparse_levels(df: DataFrame, columns: list[str], least: int) -> DataFrame:
    """(column, value, n) of levels with fewer rows than needed."""
    return value_counts(df, columns).where(F.col("n") < least).select("column", "value", "n")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, n): counts in bins of equal width from the least to the largest value, empty bins included."""
    x = number(F.col(column))
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin bigint, low double, n bigint")
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("bigint")
    found = df.where(x.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").alias("bin"), (F.lit(low) + F.col("id") * width).alias("low")).join(found, "bin", "left").na.fill(0, ["n"])


