"""The synthetic tables in their analytic roles, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.units import join_configurations


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark runs out of lineitem; energy is measured in some only."""
    t = read(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_suppkey").alias("config_id"),
        F.col("l_returnflag").alias("benchmark_type"),
        F.when(F.col("l_quantity") <= 25, 1024).otherwise(8192).cast("bigint").alias("isl"),
        F.col("l_linenumber").cast("bigint").alias("conc"),
        F.col("l_shipdate").alias("date"),
        F.col("l_linestatus").alias("status"),
        F.col("l_extendedprice").alias("tput"),
        F.col("l_tax").alias("latency"),
        F.when(F.col("l_discount") > 0, F.col("l_extendedprice") * F.col("l_discount")).alias("energy"),
        (F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey")).alias("run_id"),
    )


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations out of suppliers with their nation and region."""
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    t = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return t.select(F.col("s_suppkey").alias("config_id"), F.col("n_name").alias("config_hardware"), F.col("r_name").alias("config_framework"), F.col("s_acctbal").alias("config_balance"), (F.col("s_acctbal") < 0).alias("config_negative"))


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_configurations(runs(spark, sf_dir), configs(spark, sf_dir), check=False)


RUNS = """runs AS (SELECT l_suppkey AS config_id, l_returnflag AS benchmark_type, CASE WHEN l_quantity <= 25 THEN 1024 ELSE 8192 END::BIGINT AS isl, l_linenumber::BIGINT AS conc, l_shipdate AS date, l_linestatus AS status,
 l_extendedprice AS tput, l_tax AS latency, CASE WHEN l_discount > 0 THEN l_extendedprice * l_discount END AS energy, l_orderkey * 1000000000 + l_partkey AS run_id FROM lineitem)"""
CONFIGS = """configs AS (SELECT s_suppkey AS config_id, n_name AS config_hardware, r_name AS config_framework, s_acctbal AS config_balance, s_acctbal < 0 AS config_negative
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
JOINED = f"{RUNS}, {CONFIGS}, joined AS (SELECT * FROM runs LEFT JOIN configs USING (config_id))"
