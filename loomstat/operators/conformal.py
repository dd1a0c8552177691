"""Conformal prediction intervals: three families, their scores, and coverage by subgroup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import category
from .ranks import at_share

FLOOR = 1e-8


def quantile(scores: DataFrame, score: str, level: float, by: list[str]) -> DataFrame:
    """(by..., q): the score at place min(n, ceil((n + 1) level)) in each group; ranges of values are sorted apart, not a group as a whole. Groups are few: their rows are broadcast to what they are joined with."""
    return at_share(scores, score, level, lambda n: F.least(n, F.ceil((n + 1) * F.lit(level))), by).withColumnRenamed(score, "q")


def global_intervals(calibration: DataFrame, validation: DataFrame, residual: str, prediction: str, level: float, by: list[str]) -> DataFrame:
    """validation with lower and upper: the prediction and the quantile of absolute residuals to both sides."""
    q = quantile(calibration.withColumn("_score", F.abs(residual)), "_score", level, by)
    return validation.join(F.broadcast(q), by).withColumn("lower", F.col(prediction) - F.col("q")).withColumn("upper", F.col(prediction) + F.col("q")).drop("q")


def scaled_intervals(calibration: DataFrame, validation: DataFrame, residual: str, prediction: str, scale: str, level: float, by: list[str]) -> DataFrame:
    """As global_intervals, with residuals by an estimate of their scale."""
    s = F.greatest(F.col(scale), F.lit(FLOOR))
    q = quantile(calibration.withColumn("_score", F.abs(residual) / s), "_score", level, by)
    return validation.join(F.broadcast(q), by).withColumn("lower", F.col(prediction) - F.col("q") * s).withColumn("upper", F.col(prediction) + F.col("q") * s).drop("q")


def quantile_intervals(calibration: DataFrame, validation: DataFrame, target: str, low: str, high: str, level: float, by: list[str]) -> DataFrame:
    """Intervals from estimated quantiles, widened or narrowed by the conformal score; bounds that cross are swapped."""
    lo, hi = F.least(low, high), F.greatest(low, high)
    q = quantile(calibration.withColumn("_score", F.greatest(lo - F.col(target), F.col(target) - hi)), "_score", level, by)
    out = validation.join(F.broadcast(q), by).withColumn("_lo", lo - F.col("q")).withColumn("_hi", hi + F.col("q"))
    return out.withColumn("lower", F.least("_lo", "_hi")).withColumn("upper", F.greatest("_lo", "_hi")).drop("_lo", "_hi", "q")


def interval_score(target: Column, lower: Column, upper: Column, level: float) -> Column:
    """The width, and 2 / (1 - level) for each unit by which the target lies outside."""
    penalty = 2 / (1 - level)
    return (upper - lower) + penalty * F.greatest(lower - target, F.lit(0.0)) + penalty * F.greatest(target - upper, F.lit(0.0))


def summary(df: DataFrame, target: str, level: float, by: list[str] = ()) -> DataFrame:
    """(by..., n, coverage, width, score) of lower and upper."""
    t, lo, up = F.col(target), F.col("lower"), F.col("upper")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(t.between(lo, up).cast("double")).alias("coverage"), F.avg(up - lo).alias("width"), F.avg(interval_score(t, lo, up, level)).alias("score"))


def subgroup_coverage(df: DataFrame, target: str, level: float, columns: list[str], least: int = 20) -> DataFrame:
    """(column, value, n, coverage, width, worst) of subgroups of `least` rows or more; worst marks each column's largest undercoverage."""
    long = df.select(target, "lower", "upper", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), category(F.col(c)).alias("value")) for c in columns])))
    found = summary(long, target, level, ["column", "value"]).where(F.col("n") >= least).drop("score")
    order = Window.partitionBy("column").orderBy("coverage", "value")
    return found.withColumn("worst", (F.row_number().over(order) == 1) & (F.col("coverage") < level))


def compared(frames: dict[str, DataFrame], target: str, level: float) -> DataFrame:
    """(method, n, coverage, width, score) of several families."""
    return reduce(DataFrame.unionByName, [summary(df.withColumn("method", F.lit(m)), target, level, ["method"]) for m, df in frames.items()])
