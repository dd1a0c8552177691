"""Positions, ranks and order statistics without a window over all rows, as plans that run when their result does."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import number

#: Of the sketches that bracket order statistics: a rank is off by at most one part in ACCURACY, so brackets reach three parts to either side.
ACCURACY = 10_000
REACH = 3 / ACCURACY


def _brackets(value: Column, shares: list[float]) -> Column:
    """Aggregate: an array of (a, b) between which lies the order statistic of each share, but for one place to either side."""
    ends = [x for p in shares for x in (max(0.0, p - REACH), min(1.0, p + REACH))]
    found = F.percentile_approx(value, ends, ACCURACY)
    return F.transform(F.sequence(F.lit(0), F.lit(len(shares) - 1)), lambda i: F.struct(F.get(found, 2 * i).alias("a"), F.get(found, 2 * i + 1).alias("b")))


Place = Callable[[Column], Column]


def at_places(df: DataFrame, columns: list[str], asked: dict[str, tuple[float, Place]], within: list[str] | None = None, few: bool = True) -> DataFrame:
    """(within..., column, _total, a value for each name): the value at a place, from 0, among the column's values in each group, in order.

    asked gives for each name a share near the place and the place as a function of the number of values. Two scans: a sketch
    brackets the places, then values between brackets are counted and values inside of them are counted one by one. Only what
    lies inside, a REACH-th of the values a place, is ever sorted, and equal values are one row before any shuffle. Nulls don't
    count; a group without a value has no row. few: the groups' brackets, two numbers a place, fit into memory and are
    broadcast, so that no task gets all rows of a group; a join by the groups has as many tasks with rows as there are groups.
    """
    within = within or []
    shares = sorted({p for p, _ in asked.values()})
    keys = [f"_g{i}" for i in range(len(within))]
    picked = df.select(*[F.col(c).alias(k) for c, k in zip(within, keys, strict=True)], *[number(F.col(c)).alias(f"_c{i}") for i, c in enumerate(columns)])
    sketches = picked.groupBy(*keys).agg(*[_brackets(F.col(f"_c{i}"), shares).alias(f"_b{i}") for i in range(len(columns))])
    if within:
        names = [f"_h{i}" for i in range(len(within))]
        sketches = sketches.withColumnsRenamed(dict(zip(keys, names, strict=True)))
        same = [F.col(k).eqNullSafe(F.col(h)) for k, h in zip(keys, names, strict=True)]
        joined = picked.join(F.broadcast(sketches) if few else sketches, same)
    else:
        joined = picked.crossJoin(F.broadcast(sketches))  # one row
    long = joined.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_c{i}").alias("v"), F.col(f"_b{i}").alias("_b")) for i, c in enumerate(columns)]))).where("v is not null")
    inside = F.exists("_b", lambda x: F.col("v").between(x["a"], x["b"]))
    gap = F.when(~inside, F.size(F.filter("_b", lambda x: x["b"] < F.col("v"))))
    pieces = long.groupBy(*keys, "column", gap.alias("_gap"), F.when(inside, F.col("v")).alias("_v")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    group = Window.partitionBy(*keys, "column")
    pieces = pieces.withColumn("before", F.sum("n").over(group.orderBy("low").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("_total", F.sum("n").over(group))
    last = F.col("before") + F.col("n") - 1

    def value(place: Column) -> Column:
        return F.max(F.when(place == F.col("before"), F.col("low")).when(place == last, F.col("high")).when((place > F.col("before")) & (place < last) & F.col("_v").isNotNull(), F.col("_v")))

    found = pieces.groupBy(*keys, "column").agg(F.max("_total").alias("_total"), *[value(place(F.col("_total"))).alias(name) for name, (_, place) in asked.items()])
    return found.withColumnsRenamed(dict(zip(keys, within, strict=True)))


def interpolated(low: Column, high: Column, part: Column) -> Column:
    """low * (1 - part) + high * part with the first product unrounded, a fused multiply and add as in DuckDB: its error is found by Veltkamp's halves and added, so both agree to the last bit."""
    rest, split = 1 - part, F.lit(134217729.0)
    halves = lambda x: (split * x - (split * x - x), x - (split * x - (split * x - x)))
    (a, b), (c, d) = halves(low), halves(rest)
    p, q = low * rest, high * part
    lost = ((a * c - p) + a * d + b * c) + b * d
    s = p + q
    lost = lost + ((p - (s - (s - p))) + (q - (s - p)))
    return F.when(F.abs(lost) < float("inf"), s + lost).otherwise(low + (high - low) * part)  # halves of the largest numbers overflow


def quantile_table(df: DataFrame, columns: list[str], shares: dict[str, float], within: list[str] | None = None) -> DataFrame:
    """(within..., column, a quantile for each name): exact quantiles, linearly interpolated; a column without a value has no row."""
    asked: dict[str, tuple[float, Place]] = {}
    for name, p in shares.items():
        asked[f"_low_{name}"] = (p, lambda t, p=p: F.floor((t - 1) * F.lit(p)))
        asked[f"_high_{name}"] = (p, lambda t, p=p: F.ceil((t - 1) * F.lit(p)))
    found = at_places(df, columns, asked, within)
    part = lambda p: (F.col("_total") - 1) * F.lit(p) - F.floor((F.col("_total") - 1) * F.lit(p))
    return found.select(*(within or []), "column", *[interpolated(F.col(f"_low_{n}"), F.col(f"_high_{n}"), part(p)).alias(n) for n, p in shares.items()])


def quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of whole columns on the driver, for what is fitted to them; a column without a value has None."""
    if not columns:
        return {}
    rows = quantile_table(df, columns, {f"q{i}": p for i, p in enumerate(shares)}).collect()  # a row for each column
    found = {r["column"]: [r[f"q{i}"] for i in range(len(shares))] for r in rows}
    return {c: found.get(c, [None] * len(shares)) for c in columns}


def quantile_edges(df: DataFrame, value: str, bins: int) -> list[float]:
    """Different edges of equally filled bins, linearly interpolated."""
    return sorted({v for v in quantiles(df, [value], [i / bins for i in range(bins + 1)])[value] if v is not None})


def at_share(df: DataFrame, value: str, share: float, place: Place, within: list[str] | None = None) -> DataFrame:
    """(within..., value) at a place counted from 1, a function of the number of values that is within one of `share` of them."""
    return at_places(df, [value], {"_at": (share, lambda t: place(t) - 1)}, within).select(*(within or []), F.col("_at").alias(value))


def ranges(df: DataFrame, value: str, count: str | None = None) -> DataFrame:
    """df with _range, the number of the range of values between approximate quantiles, as many as there are shuffle partitions; equal values share one.

    The edges are a row of their own in two levels, so that a value is compared with some two roots of their number. With the
    name of df's count of equal values, edges are read from the shuffle that counted them: without it the count is pruned, and
    another aggregate of the input is planned.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    some = math.isqrt(parts - 1) + 1
    found = F.array_sort(F.array_distinct(F.coalesce(F.percentile_approx(value, [i / parts for i in range(1, parts)], ACCURACY), F.array().cast("array<double>"))))
    found = found.cast("array<double>")
    edges = df.agg((F.when(F.sum(count) > 0, found).otherwise(F.array().cast("array<double>")) if count else found).alias("_edges"))
    chunks = F.transform(F.sequence(F.lit(0), F.lit(some - 1)), lambda i: F.slice("_edges", i * some + 1, some))
    edges = edges.select(F.filter(chunks, lambda x: F.size(x) > 0).alias("_chunks"))
    above = F.size(F.filter("_chunks", lambda x: F.element_at(x, -1) < F.col(value)))  # chunks that lie below the value as a whole
    within = F.coalesce(F.size(F.filter(F.get("_chunks", above), lambda e: e < F.col(value))), F.lit(0))
    return df.crossJoin(F.broadcast(edges)).withColumn("_range", above * some + within).drop("_chunks")  # one row


def levels(df: DataFrame, value: str, within: list[str] | None = None, count: str | None = None) -> DataFrame:
    """(within..., value, _ties, _before, _total): each different value with its rows, the rows of lower values, and all rows of its group. A row counts as many times as its `count` says.

    Equal values are one row before any shuffle; the different ones are cumulated in ranges between approximate quantiles, and
    the ranges' sizes, a table of ranges x groups, are added. Nulls are left out.
    """
    within = within or []
    counted = ranges(df.where(F.col(value).isNotNull()).groupBy(*within, value).agg((F.sum(count) if count else F.count("*")).alias("_ties")), value, "_ties")
    sizes = counted.groupBy(*within, "_range").agg(F.sum("_ties").alias("_n"))
    whole = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))  # a row for each range
    sizes = sizes.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(within)], F.col("_range").alias("_r"), (F.sum("_n").over(whole.orderBy("_range")) - F.col("_n")).alias("_offset"), F.sum("_n").over(whole).alias("_total"))
    order = Window.partitionBy(*within, "_range").orderBy(value)
    counted = counted.withColumn("_before", F.sum("_ties").over(order) - F.col("_ties"))
    same = [F.col("_range") == F.col("_r"), *[F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(within)]]
    return counted.join(sizes, same).select(*within, value, "_ties", (F.col("_before") + F.col("_offset")).alias("_before"), "_total")


def order_statistic(df: DataFrame, value: str, place: Column, within: list[str] | None = None) -> DataFrame:
    """(within..., value) at any place, counted from 1; place may use _total, the group's rows."""
    hit = levels(df, value, within).where((F.col("_before") < place) & (place <= F.col("_before") + F.col("_ties")))
    return hit.groupBy(*(within or [])).agg(F.min(value).alias(value))


def positions(df: DataFrame, value: str, within: list[str] | None = None) -> DataFrame:
    """df with _before (rows of a lower value), _ties (rows of the same value) and _total among the rows of the same `within`; nulls are left out."""
    within = within or []
    names = {c: f"_k{i}" for i, c in enumerate((*within, value))}
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in names.items()]
    return df.where(F.col(value).isNotNull()).join(levels(df, value, within).withColumnsRenamed(names), same).drop(*names.values())


def average_rank(df: DataFrame, value: str, name: str, within: list[str] | None = None) -> DataFrame:
    """df with the rank from 1 of each row's value, the mean of the places of equal values."""
    return positions(df, value, within).withColumn(name, F.col("_before") + (F.col("_ties") + 1) / 2).drop("_before", "_ties", "_total")


def spearman(df: DataFrame, a: str, b: str, within: list[str] | None = None) -> DataFrame:
    """(within..., spearman, n) over rows with both values; null below three or without spread.

    Equal pairs are one row before any shuffle, and that shuffle is read by all that follows, so rows are scanned once. Ranks lie
    around their known mean, so sums of products lose no digits.
    """
    keys = within or []
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_n"))

    def ranked(rows: DataFrame, value: str, name: str) -> DataFrame:
        names = {c: f"_k{i}" for i, c in enumerate((*keys, value))}
        same = [F.col(c).eqNullSafe(F.col(k)) for c, k in names.items()]
        places = levels(pairs, value, keys, "_n").select(*[F.col(c).alias(k) for c, k in names.items()], (F.col("_before") + (F.col("_ties") - F.col("_total")) / 2).alias(name))
        return rows.join(places, same).drop(*names.values())

    both = ranked(ranked(pairs, "_a", "_x"), "_b", "_y")
    n, x, y = F.col("_n"), F.col("_x"), F.col("_y")
    found = F.try_divide(F.sum(n * x * y), F.sqrt(F.sum(n * x * x)) * F.sqrt(F.sum(n * y * y)))
    return both.groupBy(*keys).agg(F.when(F.sum(n) > 2, found).alias("spearman"), F.coalesce(F.sum(n), F.lit(0)).alias("n"))
