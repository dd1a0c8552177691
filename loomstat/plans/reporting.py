"""Queries over guides, dictionaries, quality, observed energy, fold difficulty, residuals, tails and cohorts, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import roles
from ..functions.columns import binned, to_digits
from ..operators import diagnostics, embedding, energy, encode, neural, pca, profile, ranks, units
from . import reports, research, tables
from .analytics import UNIT, rounded
from .modelling import _ALL, _FEATURES, _PREDICTED, _cohort, _fold_sql, _predicted, _vectors
from .tables import JOINED, RUNS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
METRICS = ["tput", "latency", "energy"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _each(make, names) -> str:
    return " UNION ALL ".join(make(c) for c in names)


def _text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


@query(f"WITH {RUNS} " + _each(lambda c: f"SELECT '{c}' AS metric, {', '.join(f'{_text(v)} AS {n}' for n, v in zip(('kind', 'direction', 'use', 'meaning'), (*roles.metric_kind(c), roles.meaning(c))))}, count({c}) AS non_null, round(100 * avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_pct FROM runs", METRICS))
def metric_guide(spark, sf_dir):
    return rounded(profile.metric_guide(tables.runs(spark, sf_dir), METRICS))


#: Columns of the joined runs with their types.
COLUMNS = {"config_id": "bigint", "benchmark_type": "string", "isl": "bigint", "conc": "bigint", "date": "timestamp", "status": "string", "tput": "double", "latency": "double", "config_hardware": "string", "config_framework": "string", "config_negative": "boolean"}
_PLAIN = [c for c in COLUMNS if COLUMNS[c] in ("bigint", "string", "boolean")]


def _dictionary_sql(c: str) -> str:
    facts = {"source": roles.source_table(c), "family": roles.feature_family(c), "role": roles.role(c), "dtype": COLUMNS[c], "meaning": roles.meaning(c)}
    numeric = COLUMNS[c] in ("bigint", "double")
    use = _text(roles.fixed_use(c)) if roles.fixed_use(c) else f"CASE WHEN count(DISTINCT {c}) <= 1{'' if numeric else f' OR count(DISTINCT {c}) > {roles.MOST_LEVELS}'} THEN 'exclude' ELSE {_text(roles.varying_use(c))} END"
    return f"SELECT '{c}' AS \"column\", {', '.join(f'{_text(v)} AS {n}' for n, v in facts.items())}, count({c}) AS non_null, round(100 * (1 - count({c}) / count(*)), 6) AS missing_pct, count(DISTINCT {c}) AS \"unique\", array_to_string(list_sort(list(DISTINCT {c}::VARCHAR))[1:3], ', ') AS examples, {use} AS use FROM joined"


@query(f"WITH {JOINED} " + _each(_dictionary_sql, _PLAIN))
def feature_dictionary(spark, sf_dir):
    return rounded(profile.feature_dictionary(tables.joined(spark, sf_dir), _PLAIN))


def _fact_sql(check: str, wanted) -> str:
    return _each(lambda c: f"SELECT '{check}' AS \"check\", '{c}' AS \"column\", count(DISTINCT {c}) AS n FROM joined HAVING {wanted(c)}", _PLAIN)


_UNUSED = {c: "true" if roles.fixed_use(c) == "exclude" else "false" if roles.fixed_use(c) else f"count(DISTINCT {c}) <= 1" + ("" if COLUMNS[c] == "bigint" else f" OR count(DISTINCT {c}) > {roles.MOST_LEVELS}") for c in _PLAIN}


@query(f"""WITH {JOINED}, g AS (SELECT count(*) AS n FROM joined GROUP BY config_id, benchmark_type, isl, conc, date), c AS (SELECT 'duplicate_rows' AS "check", NULL::VARCHAR AS "column", coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n FROM g UNION ALL SELECT 'failed_rows', NULL, count(*) FILTER (status = 'F') FROM joined
UNION ALL {_each(lambda c: f"SELECT 'missing_values', '{c}', count(*) FILTER ({c} IS NULL) FROM joined UNION ALL SELECT 'negative_values', '{c}', count(*) FILTER ({c} < 0) FROM joined", [*METRICS, 'config_balance'])} UNION ALL {_each(lambda c: f"SELECT 'nonpositive_values', '{c}', count(*) FILTER ({c} <= 0) FROM joined", ['isl', 'conc'])}),
f AS ({_fact_sql('high_cardinality', lambda c: f"count(DISTINCT {c}) > {roles.MOST_LEVELS} AND {'true' if roles.role(c) in ('metadata', 'provenance') else 'false'}")} UNION ALL {_fact_sql('single_value', lambda c: f"count(DISTINCT {c}) <= 1")} UNION ALL {_fact_sql('excluded', lambda c: _UNUSED[c])})
SELECT * FROM c WHERE n > 0 OR "column" IS NULL UNION ALL SELECT * FROM f""")
def quality_report(spark, sf_dir):
    return profile.quality_report(tables.joined(spark, sf_dir), _PLAIN, [*UNIT, "date"], F.col("status") == "F", [*METRICS, "config_balance"], ["isl", "conc"])


def _described_sql(c: str, x: str, where: str) -> str:
    return f"SELECT '{c}' AS \"column\", count({x}) AS n, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min, {', '.join(f'round(quantile_cont({x}, {p / 100}), 6) AS p{p}' for p in (25, 50, 75, 90, 95, 99))}, round(max({x}), 6) AS max FROM runs WHERE {where}"


@query(f"WITH {RUNS} SELECT 'raw' AS transform, * FROM ({_each(lambda c: _described_sql(c, c, f'{c} IS NOT NULL'), METRICS)}) UNION ALL SELECT 'log1p', * FROM ({_each(lambda c: _described_sql(c, f'ln(1 + {c})', f'{c} >= 0'), METRICS)})")
def describe_extended(spark, sf_dir):
    df = tables.runs(spark, sf_dir)
    both = [profile.described(df, METRICS, log).withColumn("transform", F.lit("log1p" if log else "raw")) for log in (False, True)]
    return rounded(both[0].unionByName(both[1]))


@query(f"WITH {RUNS}, q AS (SELECT quantile_cont(tput, 0.05) AS a, quantile_cont(tput, 0.95) AS b FROM runs) SELECT run_id, conc, round(greatest(a, least(b, tput)), 6) AS clipped FROM runs, q")
def percentile_clip(spark, sf_dir):
    return rounded(profile.clipped(tables.runs(spark, sf_dir), "tput")).select("run_id", "conc", "clipped")


@query(f"WITH {RUNS} SELECT count(*) FILTER (energy > 0) AS positive, count(*) FILTER (energy <= 0) AS nonpositive, count(*) FILTER (energy IS NULL) AS missing, count(*) FILTER (date < TIMESTAMP '1998-01-01') AS rows_before, count(*) FILTER (date >= TIMESTAMP '1998-01-01') AS rows_after FROM runs")
def signs_and_dates(spark, sf_dir):
    return profile.signs_and_dates(tables.runs(spark, sf_dir), "energy", "date", "1998-01-01 00:00:00")


@query(f"WITH {RUNS} SELECT run_id, conc, date FROM runs WHERE benchmark_type = 'A' AND isl = 1024 AND strftime(date, '%Y-%m') = '1997-03'")
def dashboard_filter(spark, sf_dir):
    return units.filtered(tables.runs(spark, sf_dir), {"benchmark_type": "A", "isl": "1024"}, "date", "1997-03").select("run_id", "conc", "date")


@query(f"WITH {RUNS}, c AS (SELECT config_id, benchmark_type, count(*) AS n FROM runs GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY config_id ORDER BY n DESC, benchmark_type) AS k FROM c) SELECT config_id, benchmark_type, n FROM r WHERE k = 1")
def configuration_majority(spark, sf_dir):
    return units.majority(tables.runs(spark, sf_dir), ["config_id"], "benchmark_type")


@query(f"WITH {RUNS}, u AS (SELECT DISTINCT config_id, benchmark_type, isl, conc FROM runs WHERE benchmark_type = 'A'), h AS (SELECT config_id, sha256(concat_ws('|', config_id::VARCHAR, benchmark_type, isl::VARCHAR, conc::VARCHAR)) AS id FROM u) SELECT count(*) AS rows, count(DISTINCT config_id) AS groups, sum(('0x' || id[1:15])::HUGEINT)::VARCHAR AS digest FROM h")
def cohort_digest(spark, sf_dir):
    some = roles.cohort(_cohort(spark, sf_dir), ["tput", *UNIT], "benchmark_type", "A")
    return units.cohort_digest(some, UNIT, "config_id")


# observed energy


@query(f"WITH {JOINED}, m AS (SELECT * FROM joined WHERE energy > 0), v AS (SELECT DISTINCT 'config_hardware' AS field, config_hardware AS value, NULL::DOUBLE AS x FROM m UNION ALL SELECT DISTINCT 'benchmark_type', benchmark_type, NULL FROM m UNION ALL SELECT DISTINCT 'isl', isl::VARCHAR, isl::DOUBLE FROM m UNION ALL SELECT DISTINCT 'conc', conc::VARCHAR, conc::DOUBLE FROM m) SELECT field, row_number() OVER (PARTITION BY field ORDER BY x, value) AS place, value FROM v WHERE value IS NOT NULL")
def energy_values(spark, sf_dir):
    return energy.observed_values(tables.joined(spark, sf_dir), "energy", ["config_hardware", "benchmark_type", "isl", "conc"])


@query(f"WITH {RUNS} SELECT count(*) FILTER (energy > 0) AS measured_rows, count(DISTINCT config_id) FILTER (energy > 0) AS measured_configurations, count(DISTINCT config_id) AS all_configurations, round(count(DISTINCT config_id) FILTER (energy > 0) / count(DISTINCT config_id), 6) AS configuration_coverage, min(date) FILTER (energy > 0) AS first_date, max(date) FILTER (energy > 0) AS last_date FROM runs")
def energy_coverage(spark, sf_dir):
    return rounded(energy.configuration_coverage(tables.runs(spark, sf_dir), "energy", "config_id", "date"))


_CHOSEN = {"benchmark_type": "A", "isl": 1024, "conc": 2, "config_framework": "ASIA"}


@query(f"""WITH {JOINED}, h AS (SELECT * FROM joined WHERE energy > 0 AND benchmark_type = 'A' AND isl = 1024 AND conc = 2 AND config_framework = 'ASIA')
SELECT 'observed' AS status, count(*) AS n, count(DISTINCT config_id) AS configurations, round(median(energy), 6) AS median, round(min(energy), 6) AS min, round(max(energy), 6) AS max, min(date) AS first_date, max(date) AS last_date, array_to_string(list_sort(list(DISTINCT config_id::VARCHAR)), ';') AS config_ids, round(median(tput), 6) AS tput_median, round(median(latency), 6) AS latency_median,
round(median(energy) / 3.6, 6) AS kwh_per_million_tokens, round(3600000 / median(energy), 6) AS tokens_per_kwh, round(median(energy) / 3.6 * 0.12, 6) AS cost_per_million_tokens FROM h""")
def energy_observed_report(spark, sf_dir):
    return rounded(energy.observed_report(tables.joined(spark, sf_dir), "energy", _CHOSEN, "config_id", ["tput", "latency"], "date", 0.12))


# folds, residuals and tails


@query(f"WITH {_PREDICTED}, q AS (SELECT fold, 1.5 * (quantile_cont(tput, 0.75) - quantile_cont(tput, 0.25)) AS large_limit FROM p GROUP BY 1), e AS (SELECT p.fold, large_limit, tput - prediction AS e FROM p JOIN q ON p.fold = q.fold) SELECT fold, round(large_limit, 4) AS large_limit, count(*) AS rows, round(sum(abs(e)), 2) AS abs_error, round(avg(abs(e)), 4) AS mean_abs_error, count(*) FILTER (abs(e) > large_limit) AS large, count(*) FILTER (e > 0) AS under, round(sum(abs(e)) FILTER (e > 0), 2) AS under_error, count(*) FILTER (e < 0) AS over, round(sum(abs(e)) FILTER (e < 0), 2) AS over_error FROM e GROUP BY fold, e.large_limit")
def error_attribution_totals(spark, sf_dir):
    df = diagnostics.attribution_totals(_predicted(spark, sf_dir), "tput", "prediction", ["fold"])
    digits = {"large_limit": 4, "abs_error": 2, "mean_abs_error": 4, "under_error": 2, "over_error": 2}
    return df.select(*[to_digits(c, digits[c]).alias(c) if c in digits else F.col(c).cast("bigint").alias(c) for c in df.columns])


_LEVELS = f"{_PREDICTED}, l AS (SELECT fold, 'config_hardware' AS \"column\", config_hardware AS value FROM p UNION ALL SELECT fold, 'config_id', config_id::VARCHAR FROM p UNION ALL SELECT fold, 'isl', isl::VARCHAR FROM p), v AS (SELECT fold, \"column\", value, count(*) AS valid_rows FROM l GROUP BY ALL), t AS (SELECT *, (sum(valid_rows) OVER (PARTITION BY \"column\", value) - valid_rows)::BIGINT AS train_rows FROM v)"
_CATEGORIES = ["config_hardware", "config_id", "isl"]


@query(f'WITH {_LEVELS} SELECT fold, "column", value, train_rows, valid_rows, train_rows = 0 AS unseen, train_rows <= 2 AS rare FROM t')
def fold_difficulty(spark, sf_dir):
    return rounded(diagnostics.fold_levels(_predicted(spark, sf_dir), _CATEGORIES))


@query(f'WITH {_LEVELS} SELECT fold, "column", count(*) AS levels, count(*) FILTER (train_rows = 0) AS unseen, count(*) FILTER (train_rows <= 2) AS rare, round(coalesce(sum(valid_rows) FILTER (train_rows > 0), 0) / sum(valid_rows), 6) AS coverage FROM t GROUP BY ALL')
def fold_coverage(spark, sf_dir):
    return rounded(diagnostics.fold_coverage(_predicted(spark, sf_dir), _CATEGORIES))


_RESIDUALS = f"{_PREDICTED}, e AS (SELECT tput, tput - prediction AS e FROM p)"
_Z = {v: NormalDist().inv_cdf((1 + v / 100) / 2) for v in (50, 80, 95)}


@query(f"""WITH {_RESIDUALS}, s AS (SELECT count(*) AS n, stddev_pop(e) AS s, min(e) AS low, max(e) AS high, {', '.join(f'quantile_cont(abs(e), {v / 100}) AS q{v}' for v in _Z)} FROM e), b AS (SELECT least(floor((e - low) / ((high - low) / 20)), 19)::BIGINT AS b, count(*) AS c FROM e, s GROUP BY 1), h AS (SELECT i AS b, coalesce(c, 0) AS c FROM range(20) r(i) LEFT JOIN b ON b = i), k AS (SELECT b, c, lag(c) OVER (ORDER BY b) AS l, lead(c) OVER (ORDER BY b) AS r FROM h)
SELECT max(n) AS n, round(avg(CASE WHEN e > 0 THEN 1.0 ELSE 0.0 END), 6) AS under_rate, round(avg(CASE WHEN e < 0 THEN 1.0 ELSE 0.0 END), 6) AS over_rate, {', '.join(f'round(avg(CASE WHEN abs(e) <= {z!r} * s THEN 1.0 ELSE 0.0 END), 6) AS normal_{v}' for v, z in _Z.items())}, {', '.join(f'round(avg(CASE WHEN abs(e) <= q{v} THEN 1.0 ELSE 0.0 END), 6) AS empirical_{v}' for v in _Z)}, (SELECT count(*) FROM k WHERE c > l AND c > r) AS peaks FROM e, s""")
def oof_diagnostics(spark, sf_dir):
    return rounded(diagnostics.residual_rates(_predicted(spark, sf_dir), "tput", "prediction"))


@query(f"WITH {_RESIDUALS}, q AS (SELECT quantile_cont(tput, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS c FROM e), b AS (SELECT greatest(len(list_filter(c, lambda x: x < tput)) - 1, 0) AS bin, e FROM e, q) SELECT bin, count(*) AS n, round(avg(abs(e)), 4) AS mae, round(stddev_pop(e), 4) AS std FROM b GROUP BY 1")
def residual_bins(spark, sf_dir):
    return rounded(diagnostics.residual_bins(_predicted(spark, sf_dir), "tput", "prediction"), 4)


@query(f"WITH {_PREDICTED}, e AS (SELECT abs(tput - prediction) AS a, tput FROM p), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY tput) + (count(*) OVER (PARTITION BY tput) - 1) / 2.0 AS rb FROM e) SELECT round(corr(ra, rb), 4) AS spearman, count(*) AS n FROM r")
def residual_target_spearman(spark, sf_dir):
    df = _predicted(spark, sf_dir).withColumn("_a", F.abs(F.col("tput") - F.col("prediction")))
    return rounded(ranks.spearman(df, "_a", "tput"), 4)


@query(f"""WITH {_RESIDUALS}, x AS (SELECT p.config_framework AS g, tput - prediction AS e FROM p), mo AS (SELECT count(*)::DOUBLE AS n, avg((x.e - a.m) ** 3) / avg((x.e - a.m) ** 2) ** 1.5 AS sk, avg((x.e - a.m) ** 4) / avg((x.e - a.m) ** 2) ** 2 AS ku FROM x, (SELECT avg(e) AS m FROM x) a),
c AS (SELECT *, sk * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b, 3 * (n - 1) / (n + 1) AS km, 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5)) AS kv, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS mm FROM mo),
d AS (SELECT *, sqrt(2 * (b - 1)) - 1 AS w2, (ku - km) / sqrt(kv) AS xx, 6 + 8 / mm * (2 / mm + sqrt(1 + 4 / mm ** 2)) AS a FROM c),
z AS (SELECT asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(sqrt(w2))) AS z1, ((1 - 2 / (9 * a)) - sign((1 - 2 / a) / (1 + xx * sqrt(2 / (a - 4)))) * abs((1 - 2 / a) / (1 + xx * sqrt(2 / (a - 4)))) ** (1 / 3)) / sqrt(2 / (9 * a)) AS z2 FROM d),
mg AS (SELECT g, median(e) AS md FROM x GROUP BY 1), v AS (SELECT x.g, abs(e - md) AS t FROM x JOIN mg ON x.g = mg.g), k AS (SELECT g, count(*)::DOUBLE AS n, avg(t) AS t, sum((t - u.u) ** 2) AS within_ FROM v JOIN (SELECT g AS gg, avg(t) AS u FROM v GROUP BY 1) u ON v.g = u.gg GROUP BY g)
SELECT round(z1 * z1 + z2 * z2, 3) AS k2, round((SELECT (sum(n) - count(*)) / (count(*) - 1) * sum(n * (t - (SELECT avg(t) FROM v)) ** 2) / sum(within_) FROM k), 5) AS levene FROM z""")
def residual_test_statistics(spark, sf_dir):
    from .modelling import residual_tests

    return residual_tests(spark, sf_dir).select(to_digits("k2", 3).alias("k2"), to_digits("levene", 5).alias("levene"))


def _threshold_sql(method: str) -> str:
    at = lambda p: f"quantile_cont(energy, {p})"
    value = f"{at(0.75)} + 1.5 * ({at(0.75)} - {at(0.25)})" if method == "iqr" else at(float(method[1:]) / 100)
    return f"SELECT '{method}' AS method, f.fold, {value} AS threshold FROM p, (SELECT DISTINCT fold FROM p) f WHERE p.fold <> f.fold AND energy IS NOT NULL GROUP BY f.fold"


@query(f"""WITH {_PREDICTED}, c AS ({_each(_threshold_sql, ('p95', 'p97.5', 'p99', 'iqr'))}), s AS (SELECT method, c.fold, threshold, count(*) FILTER (energy > threshold AND p.fold <> c.fold) AS train_tails, avg(CASE WHEN p.fold <> c.fold THEN CASE WHEN energy > threshold THEN 1.0 ELSE 0.0 END END) AS train_share, count(*) FILTER (energy > threshold AND p.fold = c.fold) AS valid_tails, avg(CASE WHEN p.fold = c.fold THEN CASE WHEN energy > threshold THEN 1.0 ELSE 0.0 END END) AS valid_share FROM c, p WHERE energy IS NOT NULL GROUP BY method, c.fold, threshold)
SELECT method, fold, round(threshold, 4) AS threshold, train_tails, round(train_share, 6) AS train_share, valid_tails, round(valid_share, 6) AS valid_share, round(stddev_pop(threshold) OVER w, 4) AS threshold_std, round(stddev_pop(valid_share) OVER w, 6) AS valid_share_std, min(train_tails) OVER w >= 64 AS supported FROM s WINDOW w AS (PARTITION BY method)""")
def tail_threshold_table(spark, sf_dir):
    df = diagnostics.threshold_table(_predicted(spark, sf_dir), "energy")
    digits = {"threshold": 4, "threshold_std": 4, "train_share": 6, "valid_share": 6, "valid_share_std": 6}
    return df.select(*[to_digits(c, digits[c]).alias(c) if c in digits else F.col(c).cast("bigint").alias(c) if c == "fold" else F.col(c) for c in df.columns])


@query(f"WITH {_PREDICTED}, q AS (SELECT quantile_cont(tput, [0.2, 0.4, 0.6, 0.8]) AS c FROM p WHERE fold <> 2) SELECT len(list_filter(c, lambda x: x < tput)) AS bin, count(*) AS n FROM p, q WHERE fold = 2 GROUP BY 1")
def bins_of_training_rows(spark, sf_dir):
    """Rows of one fold in bins between the quintiles of all other folds."""
    df = _predicted(spark, sf_dir)
    cuts = ranks.quantile_table(df.where("fold <> 2"), ["tput"], {f"q{i}": i / 5 for i in range(1, 5)})
    edges = cuts.select(F.array_distinct(F.array(F.lit(float("-inf")), *[f"q{i}" for i in range(1, 5)])).alias("_edges"))
    met = df.where("fold = 2").crossJoin(F.broadcast(edges))  # one row
    return met.groupBy(binned(F.col("tput"), F.col("_edges")).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {_PREDICTED}, r AS (SELECT fold, config_framework, avg(abs(tput - prediction)) AS mae FROM p GROUP BY ALL) SELECT fold, config_framework, round(mae, 4) AS mae, row_number() OVER (PARTITION BY fold ORDER BY r.mae DESC, config_framework) AS rank FROM r")
def error_rank(spark, sf_dir):
    rows = _predicted(spark, sf_dir).groupBy("fold", "config_framework").agg(F.avg(F.abs(F.col("tput") - F.col("prediction"))).alias("mae"))
    return rounded(embedding.error_rank(rows, "config_framework", "mae", ["fold"]), 4)


@query("WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) AS k FROM embeddings), c AS (SELECT vec_id, label FROM r ORDER BY k, label::VARCHAR LIMIT 64) SELECT 'stratified' AS strategy, count(*) AS context_rows, count(DISTINCT label) AS groups, count(DISTINCT label) AS label_levels, count(DISTINCT floor(vec_id)) AS vec_id_bins, sha256('stratified:42:' || array_to_string(list_sort(list(vec_id::VARCHAR)), ',')) AS signature, (SELECT count(*) FROM embeddings) AS available_rows FROM c")
def context_summary(spark, sf_dir):
    t = tables.read(spark, sf_dir, "embeddings").select("vec_id", "label")
    context = diagnostics.stratified_context(t, ["label"], 64, 42, "vec_id")
    return diagnostics.context_summary(context, t, "label", ["label"], ["vec_id"], "stratified", 42, "vec_id")


@query(f"""WITH {_ALL}, d AS (SELECT a.vec_id AS key, b.vec_id AS other, list_distance(a.e, b.e) AS x, list_distance(a.e[1:32], b.e[1:32]) AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id), r AS (SELECT key, other, row_number() OVER (PARTITION BY key ORDER BY x, other) AS kx, row_number() OVER (PARTITION BY key ORDER BY y, other) AS ky FROM d),
o AS (SELECT key, count(*) FILTER (kx <= 10 AND ky <= 10) / count(*) FILTER (kx <= 10 OR ky <= 10) AS o FROM r GROUP BY 1) SELECT count(*) AS n, round(avg(o), 6) AS overlap FROM o""")
def neighbour_overlap(spark, sf_dir):
    """How many nearest neighbours rows keep when half of their dimensions are left out."""
    df = _vectors(spark, sf_dir)
    half = df.withColumn("embedding", F.slice("embedding", 1, 32))
    return rounded(embedding.neighbour_overlap(*[embedding.neighbours(x, "embedding", "vec_id") for x in (df, half)]))


@query(f"WITH {RUNS}, q AS (SELECT quantile_cont(tput, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS c FROM runs), b AS (SELECT greatest(len(list_filter(c, lambda x: x < tput)) - 1, 0) AS bin, tput, latency FROM runs, q) SELECT bin, count(*) AS n, round(min(tput), 9) AS low, round(max(tput), 9) AS high, round(median(latency), 9) AS median, round(avg(latency), 9) AS mean FROM b GROUP BY 1")
def binned_overlay(spark, sf_dir):
    return rounded(reports.binned_overlay(tables.runs(spark, sf_dir), "tput", "latency"), 9)


@query(f"WITH {RUNS}, {_fold_sql(3)}, j AS (SELECT tput, fold FROM runs JOIN f USING (config_id)), a AS (SELECT g.fold, CASE WHEN g.fold = j.fold THEN 'validation' ELSE 'training' END AS part, tput FROM j, (SELECT DISTINCT fold FROM f) g) SELECT fold, part, count(*) AS n, round(avg(tput), 4) AS mean, round(stddev_pop(tput), 4) AS std, round(min(tput), 4) AS min, {', '.join(f'round(quantile_cont(tput, {p / 100}), 4) AS p{p}' for p in (5, 25, 50, 75, 95))}, round(max(tput), 4) AS max FROM a GROUP BY ALL")
def fold_targets(spark, sf_dir):
    return rounded(diagnostics.fold_targets(_predicted(spark, sf_dir), "tput"), 4)


# the representation study; its numbers come from networks, components and clusterings, which SQL can't express


@query()
def cross_method_agreement(spark, sf_dir):
    """Clusters of few components against those of more, of rows and of labels."""
    return research.component_agreement(_vectors(spark, sf_dir), "embedding", "vec_id", "label", {"two": (2, 3), "five": (5, 3), "ten": (10, 2)})


def _study(spark, sf_dir):
    df = _cohort(spark, sf_dir).withColumn("row_id", F.xxhash64(*UNIT))
    return research.encoded_folds(df, *_FEATURES, "config_id", 2)[1]


_ORDER = ["config_id", "benchmark_type", "isl", "conc"]


@query()
def geometry_robustness(spark, sf_dir):
    """Stability of latents of the same rows across two seeds and two partitions."""
    df = _study(spark, sf_dir)
    turned = df.withColumn("fold", 1 - F.col("fold"))
    found = research.geometry(research.seed_embeddings(df, "features", "row_id", _ORDER, "ae", 2, (17, 29), {0: df, 1: turned}, epochs=8))
    return spark.createDataFrame(found, "fixed string, value bigint, pairs bigint, stability double")


@query()
def final_representation(spark, sf_dir):
    """The final runs of a variational network, with a beta selected first, beside those of an autoencoder."""
    df = _study(spark, sf_dir)
    tried = neural.screen(df, "features", "fold", _ORDER, [{"method": "vae", "k": 2, "seed": 17, "fold": f, "beta": b} for b in (0.0001, 0.001) for f in (0, 1)], epochs=8)
    runs = [research.final_runs(df, "features", _ORDER, m, 2, (17, 29), 2, neural.select_beta(tried, least_active=1), epochs=8) for m in ("ae", "vae")]
    return research.run_summary(runs[0].unionByName(runs[1]))


@query()
def split_metadata(spark, sf_dir):
    return research.split_metadata(_study(spark, sf_dir), "config_id", UNIT)


@query()
def pca_stability_summary(spark, sf_dir):
    """Means, deviations and ends of the components' shares and cosines over samples, and whether a component is unstable."""
    runs = pca.stability(_vectors(spark, sf_dir), "embedding", "vec_id")
    return pca.stability_summary(spark.createDataFrame(runs, "run bigint, component bigint, share double, cosine double"))


@query()
def reconstruction_levels(spark, sf_dir):
    """Errors of ten components: in all, by kind of source, and by source."""
    df = _study(spark, sf_dir)
    encoder = encode.fit(df, *_FEATURES)
    basis = pca.fit(df, "features", encoder.names(), 10)
    kinds = {c: "numeric" for c in _FEATURES[0]} | {c: "category" for c in _FEATURES[1]}
    return embedding.reconstruction_levels(df, "features", basis.projected, encoder.sources(), kinds)
