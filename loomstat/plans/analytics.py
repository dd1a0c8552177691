"""Queries over units, profiles, quality and energy, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import row_identity, to_digits
from ..operators import energy, profile, units
from . import tables
from .tables import CONFIGS, JOINED, RUNS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
UNIT = ["config_id", "benchmark_type", "isl", "conc"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many decimals, as sums differ in their last bits by order; halves go where the SQL's round puts them."""
    return df.select(*[to_digits(c, digits).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t in ("int", "decimal(20,0)", "decimal(38,0)") else F.col(c) for c, t in df.dtypes])


@query(f"WITH {JOINED} SELECT config_id, benchmark_type, isl, conc, round(median(tput), 6) AS tput, round(median(latency), 6) AS latency, round(median(energy), 6) AS energy, min(config_hardware) AS config_hardware, min(config_framework) AS config_framework, count(*) AS row_count_in_group FROM joined GROUP BY ALL")
def unit_median_aggregate(spark, sf_dir):
    df = units.median_unit(tables.joined(spark, sf_dir), UNIT, ["tput", "latency", "energy"], modes=["config_hardware", "config_framework"])
    return rounded(df)


@query(f"WITH {JOINED} SELECT run_id, config_id, conc, tput, config_hardware, config_framework, config_balance, config_negative FROM joined")
def join_config_dimension(spark, sf_dir):
    return tables.joined(spark, sf_dir).select("run_id", "config_id", "conc", "tput", "config_hardware", "config_framework", "config_balance", "config_negative")


@query(f"WITH {RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY config_id, benchmark_type, isl, conc ORDER BY date DESC NULLS FIRST, run_id DESC) AS k, count(*) OVER (PARTITION BY config_id, benchmark_type, isl, conc) AS row_count_in_group FROM runs) SELECT config_id, benchmark_type, isl, conc, date, tput, run_id, row_count_in_group FROM r WHERE k = 1")
def unit_latest_row(spark, sf_dir):
    df = tables.runs(spark, sf_dir).select(*UNIT, "date", "tput", "run_id")
    return units.latest_unit(df, UNIT, "date", "run_id")


@query(f"""WITH {JOINED}, c AS (SELECT config_id, benchmark_type, count(*) AS n FROM joined GROUP BY ALL), m AS (SELECT config_id, benchmark_type, row_number() OVER (PARTITION BY config_id ORDER BY n DESC, benchmark_type) AS k FROM c),
a AS (SELECT config_id, round(median(tput), 6) AS tput, count(*) AS row_count_in_group, arg_min(status, (date, run_id)) AS first_status FROM joined GROUP BY config_id)
SELECT a.*, m.benchmark_type FROM a JOIN m ON a.config_id = m.config_id AND k = 1""")
def unit_per_config(spark, sf_dir):
    df = tables.joined(spark, sf_dir).withColumn("_o", F.struct("date", "run_id")).withColumn("first_status", F.col("status"))
    return rounded(units.median_unit(df, ["config_id"], ["tput"], modes=["benchmark_type"], firsts=["first_status"], ordinal="_o"))


@query(f"WITH {RUNS} SELECT config_id, benchmark_type, isl, conc, count(*) AS rows FROM runs GROUP BY ALL HAVING count(*) >= 2")
def repeated_groups(spark, sf_dir):
    return units.repeated_groups(tables.runs(spark, sf_dir), UNIT)


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS metrics_k FROM events")
def json_metric_expand(spark, sf_dir):
    from ..sources.readers import expand_metrics

    df = tables.read(spark, sf_dir, "events").select("event_id", "props")
    return expand_metrics(df, "props", keys=["k"])


@query(f"WITH {RUNS} SELECT run_id, sha256(concat_ws('|', config_id::VARCHAR, benchmark_type, isl::VARCHAR, conc::VARCHAR)) AS row_id FROM runs")
def row_identity_hash(spark, sf_dir):
    return tables.runs(spark, sf_dir).select("run_id", row_identity(*[F.col(c) for c in UNIT]).alias("row_id"))


_SNAPSHOT = "SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderdate"


@query(f"WITH a AS (SELECT DISTINCT * FROM ({_SNAPSHOT} < TIMESTAMP '1998-01-01')), b AS (SELECT DISTINCT * FROM ({_SNAPSHOT} >= TIMESTAMP '1998-01-01')) SELECT o_custkey, o_orderpriority, CASE WHEN a.o_custkey IS NULL THEN 'new' WHEN b.o_custkey IS NULL THEN 'gone' ELSE 'retained' END AS state FROM a FULL JOIN b USING (o_custkey, o_orderpriority)")
def snapshot_diff(spark, sf_dir):
    t = tables.read(spark, sf_dir, "orders")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    return units.snapshot_difference(t.where(early), t.where(~early), ["o_custkey", "o_orderpriority"])


_NUMBERS = ["tput", "latency", "energy"]


def _each(make, names, sep=" UNION ALL "):
    return sep.join(make(c) for c in names)


@query(f"WITH {RUNS} " + _each(lambda c: f"SELECT '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS missing, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(median({c}), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}), 4) AS max FROM runs", _NUMBERS))
def profile_numeric(spark, sf_dir):
    return rounded(profile.numeric_summary(tables.runs(spark, sf_dir), _NUMBERS), 4)


@query(f"WITH {RUNS}, q AS (" + _each(lambda c: f"SELECT '{c}' AS \"column\", {c} AS x FROM runs WHERE {c} IS NOT NULL", _NUMBERS) + """), a AS (SELECT "column", quantile_cont(x, 0.01) AS p1, quantile_cont(x, 0.05) AS p5, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.99) AS p99, stddev_pop(x) AS std, skewness(x) AS skewness FROM q GROUP BY 1)
SELECT "column", round(p1, 4) AS p1, round(p5, 4) AS p5, round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75, round(p95, 4) AS p95, round(p99, 4) AS p99, round(std, 4) AS std, round(skewness, 4) AS skewness, (SELECT count(*) FROM q WHERE q."column" = a."column" AND (x < p25 - 1.5 * (p75 - p25) OR x > p75 + 1.5 * (p75 - p25))) AS outliers FROM a""")
def distribution_extended(spark, sf_dir):
    return rounded(profile.extended_distribution(tables.runs(spark, sf_dir), _NUMBERS), 4)


_TOP = ["config_hardware", "config_framework", "benchmark_type"]


@query(f"WITH {JOINED}, l AS (" + _each(lambda c: f"SELECT '{c}' AS \"column\", {c} AS value FROM joined", _TOP) + """), n AS (SELECT "column", value, count(*) AS n FROM l GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER (PARTITION BY "column") AS share, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS k FROM n) SELECT "column", value, n, round(share, 6) AS share FROM r WHERE k <= 8""")
def categorical_top_values(spark, sf_dir):
    return rounded(profile.value_counts(tables.joined(spark, sf_dir), _TOP, 8))


@query(f"WITH {RUNS} SELECT benchmark_type || '/' || isl || '/' || conc AS workload, count(*) AS n FROM runs GROUP BY 1")
def workload_mix(spark, sf_dir):
    return tables.runs(spark, sf_dir).groupBy(F.concat_ws("/", "benchmark_type", "isl", "conc").alias("workload")).agg(F.count("*").alias("n"))


@query(f"WITH {RUNS} SELECT 'conc' AS \"column\", conc::VARCHAR AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM runs), 6) AS share FROM runs GROUP BY conc")
def category_distribution(spark, sf_dir):
    return rounded(profile.value_counts(tables.runs(spark, sf_dir), ["conc"]))


_DICTIONARY = {"config_id": ("bigint", "other"), "benchmark_type": ("string", "workload"), "isl": ("bigint", "workload"), "tput": ("double", "metric"), "energy": ("double", "metric"), "config_hardware": ("string", "stack")}


@query(f"WITH {JOINED} " + _each(lambda c: f"SELECT '{c}' AS \"column\", '{_DICTIONARY[c][0]}' AS kind, '{'metadata' if c == 'config_id' else _DICTIONARY[c][1]}' AS role, count({c}) AS non_null, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_share, count(DISTINCT {c}) AS \"unique\" FROM joined", _DICTIONARY))
def feature_dictionary_counts(spark, sf_dir):
    return rounded(profile.dictionary(tables.joined(spark, sf_dir), list(_DICTIONARY)))


@query(f"WITH {JOINED} " + _each(lambda c: f"SELECT config_framework AS level, count(*) AS rows, '{c}' AS feature, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_share FROM joined GROUP BY 1", ["energy", "tput"]))
def missingness_by_dimension(spark, sf_dir):
    return rounded(profile.missingness(tables.joined(spark, sf_dir), ["energy", "tput"], "config_framework"))


@query(f"WITH {RUNS} " + _each(lambda c: f"SELECT '{c}' AS feature, round(avg(CASE WHEN status = 'F' THEN CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END END), 6) AS missing_failed, round(avg(CASE WHEN status <> 'F' THEN CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END END), 6) AS missing_other FROM runs", ["energy", "tput"]))
def missingness_by_failure(spark, sf_dir):
    return rounded(profile.missingness(tables.runs(spark, sf_dir), ["energy", "tput"], failed=F.col("status") == "F"))


@query(f"WITH {RUNS}, g AS (SELECT count(*) AS n, count(*) FILTER (status = 'F') AS f, count(*) FILTER (latency < 0) AS m, count(*) FILTER (conc <= 1) AS w FROM (SELECT * REPLACE (conc - 1 AS conc), conc AS c FROM runs) GROUP BY config_id, benchmark_type, isl, c, date) SELECT sum(n)::BIGINT AS rows, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_rows, sum(f)::BIGINT AS failed_rows, sum(m)::BIGINT AS negative_metrics, (SELECT count(*) FROM runs WHERE conc - 1 <= 0) AS nonpositive_workload FROM g")
def quality_duplicates_suspicious(spark, sf_dir):
    df = tables.runs(spark, sf_dir).withColumn("level", F.col("conc") - 1)
    return rounded(profile.quality(df, [*UNIT, "date"], F.col("status") == "F", ["latency"], ["level"]))


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(f"WITH {JOINED} SELECT benchmark_type, " + _each(lambda r: f"count(*) FILTER (config_framework = '{r}') AS \"{r}\"", _REGIONS, ", ") + " FROM joined GROUP BY 1")
def coverage_pivot(spark, sf_dir):
    return profile.coverage(tables.joined(spark, sf_dir), "benchmark_type", "config_framework", _REGIONS)


@query(f"WITH {RUNS} SELECT count(energy) AS measured_rows, round(count(energy) / count(*), 6) AS coverage, count(DISTINCT CASE WHEN energy > 0 THEN config_id END) AS configurations, (SELECT count(*) FROM (SELECT DISTINCT benchmark_type, isl, conc FROM runs WHERE energy > 0)) AS workloads, min(date) FILTER (energy > 0) AS first_date, max(date) FILTER (energy > 0) AS last_date FROM runs")
def energy_support(spark, sf_dir):
    return rounded(energy.support(tables.runs(spark, sf_dir), "energy", "config_id", ["benchmark_type", "isl", "conc"], "date"))


@query(f"WITH {RUNS} SELECT strftime(date, '%Y-%m') AS month, count(*) AS n, round(median(energy), 6) AS median, round(avg(energy), 6) AS mean FROM runs WHERE energy > 0 GROUP BY 1")
def energy_monthly(spark, sf_dir):
    return rounded(energy.monthly(tables.runs(spark, sf_dir), "energy", "date"))


@query(f"WITH {RUNS} SELECT config_id, benchmark_type, isl, conc, round(median(energy), 6) AS energy, round(median(tput), 6) AS tput, count(*) AS rows, min(date) AS first_date, max(date) AS last_date FROM runs WHERE energy > 0 GROUP BY ALL")
def energy_aggregate(spark, sf_dir):
    return rounded(energy.aggregate(tables.runs(spark, sf_dir), UNIT, "energy", ["tput"], "date"))


_SELECTION = {"config_id": 7, "benchmark_type": "A", "isl": 1024, "conc": 2}
_WHERE = "config_id = 7 AND benchmark_type = 'A' AND isl = 1024 AND conc = 2"


@query(f"WITH {RUNS} SELECT CASE WHEN count(*) > 0 THEN 'observed' ELSE 'no_exact_match' END AS status, count(*) AS n, count(DISTINCT config_id) AS configurations, round(median(energy), 4) AS median, round(min(energy), 4) AS min, round(max(energy), 4) AS max, min(date) AS first_date, max(date) AS last_date FROM runs WHERE energy > 0 AND {_WHERE}")
def energy_exact_lookup(spark, sf_dir):
    return rounded(energy.exact_lookup(tables.runs(spark, sf_dir), "energy", _SELECTION, "config_id", "date"), 4)


@query(f"WITH {RUNS} SELECT run_id, conc, energy, energy / 3.6 AS kwh_per_million_tokens, 3.6e6 / energy AS tokens_per_kwh, energy / 3.6 * 0.15 AS cost_per_million_tokens FROM runs WHERE energy > 0")
def energy_conversions(spark, sf_dir):
    df = energy.measured(tables.runs(spark, sf_dir).select("run_id", "conc", "energy"), "energy")
    return energy.conversions(df, "energy", 0.15)


_UNIT_SQL = f"{JOINED}, u AS (SELECT config_id, benchmark_type, isl, conc, config_framework, config_balance, median(energy) AS energy, median(tput) AS tput FROM joined WHERE energy > 0 GROUP BY ALL)"


def _measured_unit(spark, sf_dir):
    df = energy.measured(tables.joined(spark, sf_dir), "energy")
    return df.groupBy(*UNIT, "config_framework", "config_balance").agg(F.median("energy").alias("energy"), F.median("tput").alias("tput"))


@query(f"""WITH {_UNIT_SQL}, s AS (SELECT *, abs(conc - 3) / (SELECT max(conc) - min(conc) FROM u)::DOUBLE + abs(config_balance - 1000.0) / (SELECT max(config_balance) - min(config_balance) FROM u) + CASE WHEN benchmark_type = 'A' THEN 0 ELSE 1 END + CASE WHEN isl = 1024 THEN 0 ELSE 1 END + CASE WHEN config_framework = 'ASIA' THEN 0 ELSE 1 END AS distance,
concat_ws('; ', CASE WHEN benchmark_type <> 'A' THEN 'benchmark_type' END, CASE WHEN isl <> 1024 THEN 'isl' END, CASE WHEN conc <> 3 THEN 'conc' END, CASE WHEN config_framework <> 'ASIA' THEN 'config_framework' END, CASE WHEN config_balance <> 1000.0 THEN 'config_balance' END) AS differing_fields FROM u WHERE benchmark_type = 'A' AND isl = 1024 AND conc = 3)
SELECT config_id, benchmark_type, isl, conc, round(energy, 4) AS energy, round(distance, 6) AS distance, differing_fields FROM s ORDER BY s.distance, s.energy, config_id LIMIT 5""")
def energy_nearest(spark, sf_dir):
    selection = {"benchmark_type": "A", "isl": 1024, "conc": 3, "config_framework": "ASIA", "config_balance": 1000.0}
    df = energy.nearest(_measured_unit(spark, sf_dir), selection, ["conc", "config_balance"], ["benchmark_type", "isl", "conc"], "energy", "config_id")
    return df.select("config_id", "benchmark_type", "isl", "conc", to_digits("energy", 4).alias("energy"), to_digits("distance", 6).alias("distance"), "differing_fields")


@query(f"WITH {_UNIT_SQL} SELECT config_id, benchmark_type, isl, conc, EXISTS (SELECT 1 FROM u p WHERE p.benchmark_type = u.benchmark_type AND p.isl = u.isl AND p.conc = u.conc AND p.energy < u.energy AND p.tput > u.tput) AS dominated FROM u")
def energy_dominance(spark, sf_dir):
    df = energy.dominated(_measured_unit(spark, sf_dir), ["benchmark_type", "isl", "conc"], "energy", "tput")
    return df.select(*UNIT, "dominated")


@query(f"WITH {JOINED} SELECT config_hardware AS level, count(*) AS n, round(median(energy), 4) AS median, round(avg(energy), 4) AS mean, count(*) >= 2000 AS supported FROM joined WHERE energy IS NOT NULL GROUP BY 1")
def subgroup_support(spark, sf_dir):
    return rounded(profile.support(tables.joined(spark, sf_dir), "config_hardware", "energy", 2000), 4)


@query(f"WITH {JOINED} SELECT 'config_hardware' AS \"column\", config_hardware AS value, count(*) AS n FROM joined GROUP BY 2 HAVING count(*) < 2000 UNION ALL SELECT 'conc', conc::VARCHAR, count(*) FROM joined GROUP BY 2 HAVING count(*) < 2000")
def sparse_categories(spark, sf_dir):
    return profile.sparse_levels(tables.joined(spark, sf_dir), ["config_hardware", "conc"], 2000)


@query("SELECT vec_id, label FROM (SELECT vec_id, label FROM embeddings ORDER BY md5('42|' || vec_id), vec_id LIMIT 100)")
def sample_hash_topn(spark, sf_dir):
    return units.sample(tables.read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("label")), 100, 42, "vec_id")


@query(f"WITH {RUNS}, b AS (SELECT min(tput) AS lo, (max(tput) - min(tput)) / 30 AS w FROM runs), h AS (SELECT least(floor((tput - lo) / w), 29)::BIGINT AS bin, count(*) AS n FROM runs, b GROUP BY 1) SELECT range AS bin, round(lo + range * w, 4) AS low, coalesce(n, 0) AS n FROM range(30), b LEFT JOIN h ON bin = range")
def target_histogram(spark, sf_dir):
    return rounded(profile.histogram(tables.runs(spark, sf_dir), "tput"), 4)


@query(f"WITH {RUNS} SELECT config_id, count(*) AS rows FROM runs WHERE config_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) GROUP BY 1")
def unmatched_configurations(spark, sf_dir):
    return units.unmatched(tables.runs(spark, sf_dir), tables.configs(spark, sf_dir).where("not config_negative"))
