"""Encoders that are fitted on training rows alone and applied to all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import category, number
from .ranks import quantiles

MOST_LEVELS = 30


@dataclass
class Encoder:
    """Medians, means and deviations of numbers; levels of categories by frequency, the most frequent first. Its size is that of the columns' levels."""

    medians: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]
    levels: dict[str, list[str]]
    folded: dict[str, bool]

    def names(self) -> list[str]:
        return list(self.medians) + [f"{c}={v}" for c, vs in self.levels.items() for v in vs] + [f"{c}=infrequent" for c, f in self.folded.items() if f]

    def sources(self) -> list[str]:
        """The source column of each encoded one."""
        return list(self.medians) + [c for c, vs in self.levels.items() for _ in vs] + [c for c, f in self.folded.items() if f]

    def columns(self) -> list[Column]:
        out = [((F.coalesce(number(F.col(c)), F.lit(m)) - F.lit(self.means[c])) / F.lit(self.scales[c])) for c, m in self.medians.items()]
        fill = {c: F.coalesce(F.col(c).cast("string"), F.lit(vs[0] if vs else "")) for c, vs in self.levels.items()}
        out += [F.when(fill[c] == F.lit(v), 1.0).otherwise(0.0) for c, vs in self.levels.items() for v in vs]
        # a level that was never seen is all zeros, unless rare levels were folded when fitting
        out += [F.when(fill[c].isin(vs), 0.0).otherwise(1.0) for c, vs in self.levels.items() if self.folded[c]]
        return [o.cast("double") for o in out]

    def transform(self, df: DataFrame, name: str = "features") -> DataFrame:
        """df with the encoded columns as an array. A level's entries are looked up in a table, as a method of one case for each level is too long for the JVM to compile."""
        given, parts = self.columns(), []
        if self.medians:
            parts.append(F.array(*given[: len(self.medians)]))
        for c, vs in self.levels.items():
            fill = F.coalesce(F.col(c).cast("string"), F.lit(vs[0] if vs else ""))
            if vs:
                hot = F.create_map(*[x for i, v in enumerate(vs) for x in (F.lit(v), F.array(*[F.lit(float(i == j)) for j in range(len(vs))]))])
                parts.append(F.coalesce(F.try_element_at(hot, fill), F.array(*[F.lit(0.0)] * len(vs))))
        if any(self.folded.values()):
            parts.append(F.array(*given[len(given) - sum(self.folded.values()) :]))
        return df.withColumn(name, F.concat(*parts) if parts else F.array().cast("array<double>"))


def fit(train: DataFrame, numeric: list[str], categories: list[str], most: int = MOST_LEVELS, whole: bool = False) -> Encoder:
    """Medians for missing numbers, then population deviations around means; the most frequent level for missing categories, and at most `most` levels, the rest folded into one. whole: no number is missing, so no medians are looked for."""
    x = {c: number(F.col(c)) for c in numeric}
    medians = dict.fromkeys(numeric, 0.0) if whole else {c: v[0] if v[0] is not None else 0.0 for c, v in quantiles(train, numeric, [0.5]).items()}
    filled = {c: F.coalesce(x[c], F.lit(medians[c])) for c in numeric}
    row = train.agg(*[F.avg(filled[c]).alias(f"m{i}") for i, c in enumerate(numeric)], *[F.stddev_pop(filled[c]).alias(f"s{i}") for i, c in enumerate(numeric)]).first() if numeric else None
    levels = {}
    if categories:
        long = train.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categories]))).where("v is not null")
        top = long.groupBy("c", "v").count().withColumn("k", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("count"), "v"))).where(F.col("k") <= most + 1)
        for r in top.orderBy("c", "k").collect():  # at most most + 1 rows a column
            levels.setdefault(r["c"], []).append(r["v"])
    levels = {c: levels.get(c, []) for c in categories}
    folded = {c: len(v) > most for c, v in levels.items()}
    return Encoder(medians, {c: row[f"m{i}"] or 0.0 for i, c in enumerate(numeric)}, {c: row[f"s{i}"] or 1.0 for i, c in enumerate(numeric)}, {c: v[: most - 1] if folded[c] else v for c, v in levels.items()}, folded)


@dataclass
class Supervised:
    """What models get: numbers filled by the training rows' medians and flagged by <name>__missing, and null categories as a level."""

    medians: dict[str, float]
    categories: list[str]

    def numeric(self) -> list[str]:
        return [*self.medians, *[f"{c}__missing" for c in self.medians]]

    def transform(self, df: DataFrame) -> DataFrame:
        made = {f"{c}__missing": number(F.col(c)).isNull().cast("double") for c in self.medians}
        made |= {c: F.coalesce(number(F.col(c)), F.lit(m)) for c, m in self.medians.items()}
        return df.withColumns(made | {c: category(F.col(c)) for c in self.categories})


def supervised(train: DataFrame, numeric: list[str], categories: list[str]) -> Supervised:
    return Supervised({c: v[0] if v[0] is not None else 0.0 for c, v in quantiles(train, numeric, [0.5]).items()}, categories)
