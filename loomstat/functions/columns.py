"""Column expressions that several operators share. All of them stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "__MISSING__"


def number(c: Column) -> Column:
    """A double; text that is none, NaN and infinities become null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def to_digits(c: Column | str, digits: int) -> Column:
    """A double to so many decimals as DuckDB's round does: the product with a power of ten goes to the nearest whole number, halves away from zero. Spark's round looks at the decimal text instead, and differs where that ends in a five."""
    c, power = F.col(c) if isinstance(c, str) else c, 10.0**digits
    return F.when(F.abs(c * power) < float("inf"), F.round(c * power, 0) / power).otherwise(c)


def flag(c: Column) -> Column:
    """1.0 or 0.0 of a boolean or of t, f, true and false in any case; null for all else."""
    return c.cast("string").try_cast("boolean").cast("double")


def positive(c: Column) -> Column:
    """The value if it is a finite number above 0, else null."""
    d = number(c)
    return F.when(d > 0, d)


def category(c: Column) -> Column:
    """Text, with null as a level of its own."""
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def key_text(c: Column) -> Column:
    """Text of a key part: whole numbers without a fraction, null as <NA>."""
    d = c.try_cast("double")
    text = F.when(d == F.floor(d), d.cast("bigint").cast("string")).otherwise(c.cast("string"))
    return F.coalesce(text, F.lit("<NA>"))


def row_identity(*parts: Column) -> Column:
    """SHA-256 of the key parts joined by bars."""
    return F.sha2(F.concat_ws("|", *[key_text(p) for p in parts]), 256)


def shuffled(seed: int, *keys: str) -> Column:
    """A reproducible random order: the MD5 of seed and keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def latest(columns: list[str], stamp: Column, ordinal: Column) -> Column:
    """Aggregate: a struct of the columns of the row with the last stamp; a row without a stamp is later than all, and of equal ones the last ordinal wins."""
    return F.max_by(F.struct(*columns), F.struct(stamp.isNull(), stamp, ordinal))


def first_value(c: Column, ordinal: Column) -> Column:
    """Aggregate: the first non-null value by ordinal."""
    return F.min_by(c, F.when(c.isNotNull(), ordinal))


def corrected_skewness(c: Column) -> Column:
    """Aggregate: skewness without bias; null below three values or without spread."""
    n = F.count(c)
    return F.when((n > 2) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def pearson(a: Column, b: Column) -> Column:
    """Aggregate: correlation, null below three pairs or without spread."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.when(F.count(x) > 2, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def binned(c: Column, edges: Column) -> Column:
    """Index from 0 of the bin (edge, next edge] that holds the value, the lowest edge included; edges is an array without repeats."""
    return F.when(c.isNotNull(), F.greatest(F.size(F.filter(edges, lambda e: e < c)) - 1, F.lit(0)))
