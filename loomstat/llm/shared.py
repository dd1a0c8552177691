"""What several operators share: the checkpoint folder, connected components, ranks without one large window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.kept import checkpoint_folder, checkpointed, release, remove

__all__ = ["checkpoint_folder", "checkpointed", "components", "ranked", "read", "release", "remove", "unused"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df hasn't, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as edges (a, b) of longs; component is the smallest node of the node's part.

    Alternating large-star and small-star rounds over a number of rows that never exceeds the edges', and the number of rounds
    grows with the logarithm of the graph's size. A node's least neighbour is an aggregate, combined before its shuffle, so no
    task holds the neighbourhood of a hub. Nulls, loops and repeated edges are ignored.
    """

    def lows(pairs: DataFrame) -> DataFrame:
        return pairs.join(pairs.groupBy("a").agg(F.min("b").alias("low")), "a")

    found = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    found = checkpointed(found)
    state = None
    while True:
        both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = lows(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b")).where("a <> b").distinct()
        large = checkpointed(large)
        small = lows(large)
        small = small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(small.select("a", F.col("low").alias("b")))
        before, found = found, checkpointed(small.where("a <> b").distinct())
        release(before)
        release(large)
        now = found.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return found.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def ranked(df: DataFrame, by: str, order: list[str], name: str = "rank", salts: int = 32) -> DataFrame:
    """df with the zero-based rank of each row among those of equal `by`.

    No window holds a whole class: rows are ranked within (by, salt), and the sizes of the salts before, a table of at most
    classes x salts rows, are added. The order is by salt (a hash of `order`), then by `order`.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    df = df.withColumn("_salt", salt)
    before = Window.partitionBy(by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(by, "_salt").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    df = df.withColumn(name, F.row_number().over(Window.partitionBy(by, "_salt").orderBy(*order)) - 1)
    return df.join(offsets, [by, "_salt"]).withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_salt", "_before")
