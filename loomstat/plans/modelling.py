"""Queries over folds, baseline predictions, tails, intervals, encoders, components, clusters and models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.columns import to_digits
from ..operators import conformal, diagnostics, embedding, encode, folds, models, neural, pca, ranks
from ..sources.kept import checkpointed
from . import reports, tables, workflows
from .analytics import rounded
from .tables import CONFIGS, JOINED, RUNS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _fold_sql(n: int, seed: int = 17) -> str:
    return f"f AS (SELECT config_id, floor((row_number() OVER (ORDER BY md5('{seed}|' || config_id), config_id) - 1) * {n} / count(*) OVER ())::BIGINT AS fold FROM (SELECT DISTINCT config_id FROM runs))"


@query(f"WITH {RUNS}, {_fold_sql(3)} SELECT * FROM f")
def folds_hash_grouped(spark, sf_dir):
    return rounded(folds.hashed_folds(tables.runs(spark, sf_dir), "config_id", 3, 17))


@query(f"""WITH RECURSIVE {RUNS}, g AS (SELECT config_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, config_id::VARCHAR) AS k FROM runs WHERE config_id IS NOT NULL GROUP BY 1),
s AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0, 0]::BIGINT[] AS load, NULL::BIGINT AS config_id, NULL::BIGINT AS fold
UNION ALL SELECT g.k, list_transform(range(1, 6), lambda i: load[i] + CASE WHEN i = list_position(load, list_min(load)) THEN g.n ELSE 0 END)::BIGINT[], g.config_id, list_position(load, list_min(load)) - 1 FROM s JOIN g ON g.k = s.k + 1)
SELECT config_id, fold FROM s WHERE k > 0""")
def folds_greedy_grouped(spark, sf_dir):
    return rounded(folds.greedy_folds(tables.runs(spark, sf_dir), "config_id", 5))


@query(f"WITH {RUNS}, {_fold_sql(3)}, a AS (SELECT run_id, fold, config_id FROM runs JOIN f USING (config_id)) SELECT fold, count(*) AS n, count(DISTINCT config_id) AS groups, (SELECT count(*) FROM (SELECT config_id FROM a GROUP BY 1 HAVING count(DISTINCT fold) > 1)) AS overlap FROM a GROUP BY 1")
def fold_overlap_check(spark, sf_dir):
    df = tables.runs(spark, sf_dir)
    assigned = df.join(folds.hashed_folds(df, "config_id", 3, 17), "config_id")
    leaks = folds.overlap(assigned, "config_id").agg(F.count(F.lit(1)).alias("overlap"))
    return rounded(assigned.groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("config_id").alias("groups")).crossJoin(leaks))


@query(f"WITH {RUNS}, g AS (SELECT config_id, row_number() OVER (ORDER BY md5('42|' || config_id), config_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT config_id FROM runs)) SELECT config_id, CASE WHEN k * 4 < n * 2 THEN 'context' WHEN k * 4 < n * 3 THEN 'uncertainty' ELSE 'calibration' END AS role FROM g")
def roles_three_way(spark, sf_dir):
    return folds.three_roles(tables.runs(spark, sf_dir), "config_id", 42)


@query("WITH r AS (SELECT vec_id, label, md5('42|' || vec_id) AS h, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) AS k FROM embeddings) SELECT vec_id, label::BIGINT AS label, (('0x' || h[1:8])::BIGINT % 3)::BIGINT AS fold FROM r WHERE n >= 2 AND k = 1")
def known_config_folds(spark, sf_dir):
    return rounded(folds.known_group_folds(tables.read(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", 3, 42, "vec_id"))


def _predicted(spark, sf_dir):
    df = tables.joined(spark, sf_dir)
    df = df.join(folds.hashed_folds(df, "config_id", 3, 17), "config_id")
    return diagnostics.out_of_fold_means(df, "tput", ["benchmark_type", "isl"])


_PREDICTED = f"""{JOINED}, {_fold_sql(3)}, j AS (SELECT joined.*, fold FROM joined JOIN f USING (config_id)), g AS (SELECT benchmark_type, isl, fold, sum(tput) AS s, count(*) AS n FROM j GROUP BY ALL),
m AS (SELECT benchmark_type, isl, fold, (sum(s) OVER w - s) / (sum(n) OVER w - n) AS prediction FROM g WINDOW w AS (PARTITION BY benchmark_type, isl)), p AS (SELECT * FROM j JOIN m USING (benchmark_type, isl, fold))"""


@query(f"WITH {_PREDICTED} SELECT fold, count(*) AS n, round(1 - sum((tput - prediction) ** 2) / (var_pop(tput) * count(*)), 6) + 0.0 AS r2, round(avg(abs(tput - prediction)), 4) AS mae FROM p GROUP BY fold")
def fold_metrics_group_mean(spark, sf_dir):
    df = diagnostics.fold_metrics(_predicted(spark, sf_dir), "tput", "prediction", ["fold"])
    return df.select(F.col("fold").cast("bigint").alias("fold"), "n", to_digits("r2", 6).alias("r2"), to_digits("mae", 4).alias("mae"))


@query(f"WITH {_PREDICTED}, l AS (SELECT 'config_hardware' AS \"column\", config_hardware AS value, fold FROM p UNION ALL SELECT 'config_id', config_id::VARCHAR, fold FROM p) SELECT \"column\", min(fold) AS fold, value, count(*) AS rows FROM l GROUP BY 1, value HAVING min(fold) = max(fold)")
def fold_difficulty_unseen(spark, sf_dir):
    return rounded(diagnostics.unseen_levels(_predicted(spark, sf_dir), ["config_hardware", "config_id"]))


@query(f"""WITH {_PREDICTED}, q AS (SELECT quantile_cont(tput, 0.75) - quantile_cont(tput, 0.25) AS iqr FROM p), l AS (SELECT 'benchmark_type' AS "column", benchmark_type AS value, tput - prediction AS e FROM p UNION ALL SELECT 'config_framework', config_framework, tput - prediction FROM p),
a AS (SELECT "column", value, count(*) AS n, sum(abs(e)) AS abs_error, count(*) FILTER (abs(e) > 1.5 * (SELECT iqr FROM q)) AS large, count(*) FILTER (e > 0) AS under, count(*) FILTER (e < 0) AS over FROM l GROUP BY ALL) SELECT "column", value, n, round(abs_error, 2) AS abs_error, large, under, over, round(abs_error / sum(abs_error) OVER (PARTITION BY "column"), 6) AS share FROM a""")
def error_attribution(spark, sf_dir):
    df = diagnostics.error_attribution(_predicted(spark, sf_dir), "tput", "prediction", ["benchmark_type", "config_framework"])
    return df.select("column", "value", "n", to_digits("abs_error", 2).alias("abs_error"), "large", "under", "over", to_digits("share", 6).alias("share"))


@query(f"WITH {_PREDICTED} SELECT config_framework AS level, count(*) AS n, round(avg(abs(tput - prediction)), 4) AS mae, round(stddev_pop(tput - prediction), 4) AS std FROM p GROUP BY 1")
def residual_scale(spark, sf_dir):
    return rounded(diagnostics.residual_scale(_predicted(spark, sf_dir), "tput", "prediction", "config_framework"), 4)


@query(f"""WITH {_PREDICTED}, e AS (SELECT tput - prediction AS e, round(prediction, 6) AS pr FROM p), r AS (SELECT e, rank() OVER (ORDER BY abs(e)) + (count(*) OVER (PARTITION BY abs(e)) - 1) / 2.0 AS ra, rank() OVER (ORDER BY pr) + (count(*) OVER (PARTITION BY pr) - 1) / 2.0 AS rb FROM e)
SELECT count(*) AS n, round(avg(e), 4) AS mean, round(stddev_pop(e), 4) AS std, round(skewness(e), 4) AS skewness, round(quantile_cont(e, 0.05), 4) AS p5, round(quantile_cont(e, 0.5), 4) AS p50, round(quantile_cont(e, 0.95), 4) AS p95, round(corr(ra, rb), 4) AS scale_spearman FROM r""")
def residual_moments_spearman(spark, sf_dir):
    df = _predicted(spark, sf_dir)
    df = df.withColumn("residual", F.col("tput") - F.col("prediction")).withColumn("prediction", to_digits("prediction", 6))
    return rounded(diagnostics.residual_summary(df.withColumn("tput", F.col("residual") + F.col("prediction")), "tput", "prediction"), 4)


@query(f"WITH {_PREDICTED} SELECT 'p97.5' AS method, fold, round(quantile_cont(energy, 0.975), 4) AS threshold FROM p GROUP BY fold UNION ALL SELECT 'iqr', fold, round(quantile_cont(energy, 0.75) + 1.5 * (quantile_cont(energy, 0.75) - quantile_cont(energy, 0.25)), 4) FROM p GROUP BY fold")
def tail_thresholds(spark, sf_dir):
    df = _predicted(spark, sf_dir)
    found = [diagnostics.tail_threshold(df, "energy", m, ["fold"]).withColumn("method", F.lit(m)) for m in ("p97.5", "iqr")]
    return rounded(found[0].unionByName(found[1]), 4)


@query("WITH v AS (SELECT event_id, value, value * 2 AS tail, ((event_id * 37) % 101) / 100.0::DOUBLE AS p FROM events) SELECT event_id, round(CASE WHEN p >= 0.5 THEN tail ELSE value END, 6) AS hard, round(p * tail + (1 - p) * value, 6) AS soft FROM v")
def two_stage_gate(spark, sf_dir):
    df = tables.read(spark, sf_dir, "events").withColumn("p", ((F.col("event_id") * 37) % 101) / F.lit(100.0)).withColumn("tail", F.col("value") * 2)
    v, t, p = F.col("value"), F.col("tail"), F.col("p")
    return df.select("event_id", to_digits(diagnostics.gated(v, t, p), 6).alias("hard"), to_digits(diagnostics.gated(v, t, p, hard=False), 6).alias("soft"))


_LEVEL = 0.8
_SPLIT = f"{_PREDICTED}, c AS (SELECT *, tput - prediction AS residual FROM p WHERE fold < 2), v AS (SELECT *, tput - prediction AS residual FROM p WHERE fold = 2)"


def _split(spark, sf_dir):
    df = _predicted(spark, sf_dir).withColumn("residual", F.col("tput") - F.col("prediction"))
    return df.where("fold < 2"), df.where("fold = 2")


def _quantile_sql(score: str, by: str, source: str = "c") -> str:
    return f"o AS (SELECT {by}, {score} AS s, row_number() OVER (PARTITION BY {by} ORDER BY {score}) AS k, count(*) OVER (PARTITION BY {by}) AS n FROM {source}), q AS (SELECT {by}, s AS q FROM o WHERE k = least(n, ceil((n + 1) * {_LEVEL}))), w AS (SELECT {by} AS qk, q FROM q)"


@query(f"WITH {_SPLIT}, {_quantile_sql('abs(residual)', 'benchmark_type')} SELECT run_id, conc, round(prediction - q, 4) AS lower, round(prediction + q, 4) AS upper FROM v JOIN w ON qk = benchmark_type")
def conformal_global(spark, sf_dir):
    c, v = _split(spark, sf_dir)
    df = conformal.global_intervals(c, v, "residual", "prediction", _LEVEL, ["benchmark_type"])
    return df.select("run_id", "conc", to_digits("lower", 4).alias("lower"), to_digits("upper", 4).alias("upper"))


_SCALES = "t AS (SELECT config_framework AS tf, avg(abs(residual)) AS scale FROM c GROUP BY 1), cs AS (SELECT c.*, scale FROM c JOIN t ON tf = config_framework), vs AS (SELECT v.*, scale FROM v JOIN t ON tf = config_framework)"


@query(f"WITH {_SPLIT}, {_SCALES}, {_quantile_sql('abs(residual) / scale', 'benchmark_type', 'cs')} SELECT run_id, conc, round(prediction - q * scale, 4) AS lower, round(prediction + q * scale, 4) AS upper FROM vs JOIN w ON qk = benchmark_type")
def conformal_scale(spark, sf_dir):
    c, v = _split(spark, sf_dir)
    scale = c.groupBy("config_framework").agg(F.avg(F.abs("residual")).alias("scale"))
    df = conformal.scaled_intervals(c.join(F.broadcast(scale), "config_framework"), v.join(F.broadcast(scale), "config_framework"), "residual", "prediction", "scale", _LEVEL, ["benchmark_type"])
    return df.select("run_id", "conc", to_digits("lower", 4).alias("lower"), to_digits("upper", 4).alias("upper"))


_BOUNDS = "t AS (SELECT config_framework AS tf, quantile_cont(residual, 0.1) AS l, quantile_cont(residual, 0.9) AS h FROM c GROUP BY 1), cs AS (SELECT c.*, prediction + l AS lo, prediction + h AS hi FROM c JOIN t ON tf = config_framework), vs AS (SELECT v.*, prediction + l AS lo, prediction + h AS hi FROM v JOIN t ON tf = config_framework)"


@query(f"WITH {_SPLIT}, {_BOUNDS}, {_quantile_sql('greatest(lo - tput, tput - hi)', 'benchmark_type', 'cs')} SELECT run_id, conc, round(lo - q, 4) AS lower, round(hi + q, 4) AS upper FROM vs JOIN w ON qk = benchmark_type")
def conformal_cqr(spark, sf_dir):
    c, v = _split(spark, sf_dir)
    bounds = ranks.quantile_table(c, ["residual"], {"_l": 0.1, "_h": 0.9}, ["config_framework"]).drop("column")
    both = [x.join(F.broadcast(bounds), "config_framework").withColumn("low", F.col("prediction") + F.col("_l")).withColumn("high", F.col("prediction") + F.col("_h")) for x in (c, v)]
    df = conformal.quantile_intervals(*both, "tput", "low", "high", _LEVEL, ["benchmark_type"])
    return df.select("run_id", "conc", to_digits("lower", 4).alias("lower"), to_digits("upper", 4).alias("upper"))


_INTERVALS = f"{_SPLIT}, {_quantile_sql('abs(residual)', 'benchmark_type')}, i AS (SELECT v.*, prediction - q AS lower, prediction + q AS upper FROM v JOIN w ON qk = benchmark_type)"


@query(f"WITH {_INTERVALS} SELECT benchmark_type, count(*) AS n, round(avg(CASE WHEN tput BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(upper - lower), 3) AS width, round(avg(upper - lower + 2 / (1 - {_LEVEL}) * (greatest(lower - tput, 0) + greatest(tput - upper, 0))), 3) AS score FROM i GROUP BY 1")
def interval_scores(spark, sf_dir):
    df = conformal.summary(conformal.global_intervals(*_split(spark, sf_dir), "residual", "prediction", _LEVEL, ["benchmark_type"]), "tput", _LEVEL, ["benchmark_type"])
    return df.select("benchmark_type", "n", to_digits("coverage", 6).alias("coverage"), to_digits("width", 3).alias("width"), to_digits("score", 3).alias("score"))


@query(f"""WITH {_INTERVALS}, l AS (SELECT 'config_framework' AS "column", config_framework AS value, * FROM i UNION ALL SELECT 'conc', conc::VARCHAR, * FROM i), s AS (SELECT "column", value, count(*) AS n, avg(CASE WHEN tput BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END) AS coverage, avg(upper - lower) AS width FROM l GROUP BY ALL HAVING count(*) >= 20)
SELECT "column", value, n, round(coverage, 6) AS coverage, round(width, 3) AS width, row_number() OVER (PARTITION BY "column" ORDER BY s.coverage, value) = 1 AND s.coverage < {_LEVEL} AS worst FROM s""")
def coverage_subgroups(spark, sf_dir):
    df = conformal.subgroup_coverage(conformal.global_intervals(*_split(spark, sf_dir), "residual", "prediction", _LEVEL, ["benchmark_type"]), "tput", _LEVEL, ["config_framework", "conc"])
    return df.select("column", "value", "n", to_digits("coverage", 6).alias("coverage"), to_digits("width", 3).alias("width"), "worst")


@query("WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) AS k FROM embeddings) SELECT vec_id, label::BIGINT AS label FROM (SELECT * FROM r ORDER BY k, label::VARCHAR LIMIT 64)")
def context_stratified(spark, sf_dir):
    return rounded(diagnostics.stratified_context(tables.read(spark, sf_dir, "embeddings").select("vec_id", "label"), ["label"], 64, 42, "vec_id"))


@query("""WITH d AS (SELECT s_suppkey, s_acctbal, s_nationkey FROM supplier), t AS (SELECT * FROM d WHERE s_suppkey % 3 <> 0), p AS (SELECT * FROM d WHERE s_suppkey % 3 = 0 ORDER BY s_suppkey LIMIT 64), m AS (SELECT t.s_suppkey, avg(pow((t.s_acctbal - p.s_acctbal) / (SELECT stddev_pop(s_acctbal) FROM t), 2) + CASE WHEN t.s_nationkey = p.s_nationkey THEN 0 ELSE 1 END) AS distance FROM t, p GROUP BY 1)
SELECT s_suppkey, round(m.distance, 6) AS distance FROM m ORDER BY m.distance, s_suppkey LIMIT 10""")
def context_nearest(spark, sf_dir):
    t = tables.read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    inner = F.col("s_suppkey") % 3 != 0
    df = diagnostics.nearest_context(t.where(inner), t.where(~inner), ["s_acctbal"], ["s_nationkey"], 10, "s_suppkey")
    return df.select("s_suppkey", to_digits("distance", 6).alias("distance"))


@query(f"""WITH RECURSIVE {CONFIGS}, v AS (SELECT config_id, ['h' || config_hardware, 'f' || config_framework, 'n' || config_negative] AS a, ['h' || config_hardware, 'f' || config_framework, 'n' || config_negative] AS b FROM configs),
p AS (SELECT 0 AS step, NULL::BIGINT AS config_id, []::VARCHAR[] AS shown UNION ALL
SELECT step + 1, x.config_id, list_concat(shown, x.a) FROM (SELECT p.step, p.shown, v.config_id, v.a, row_number() OVER (ORDER BY len(list_filter(v.a, lambda y: NOT list_contains(p.shown, y))) DESC, v.config_id::VARCHAR) AS place, len(list_filter(v.a, lambda y: NOT list_contains(p.shown, y))) AS fresh FROM p, v) x WHERE place = 1 AND fresh > 0 AND step < 30),
c AS (SELECT config_id FROM p WHERE step > 0), r AS (SELECT config_id, row_number() OVER (ORDER BY config_id) AS k FROM configs WHERE config_id NOT IN (SELECT config_id FROM c))
SELECT config_id, config_hardware, config_framework, config_negative FROM configs WHERE config_id IN (SELECT config_id FROM c) OR config_id IN (SELECT config_id FROM r WHERE k <= 30 - (SELECT count(*) FROM c))""")
def context_coverage(spark, sf_dir):
    t = tables.configs(spark, sf_dir).select("config_id", "config_hardware", "config_framework", "config_negative")
    return diagnostics.coverage_context(t, ["config_hardware", "config_framework", "config_negative"], 30, "config_id")


@query(f"WITH {RUNS}, q AS (SELECT quantile_cont(tput, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e FROM runs), b AS (SELECT tput, latency, greatest(len(list_filter(e, lambda x: x < tput)) - 1, 0) AS bin FROM runs, q) SELECT bin, count(*) AS n, round(min(tput), 4) AS low, round(max(tput), 4) AS high, round(avg(latency), 9) AS latency FROM b GROUP BY 1")
def target_quintiles(spark, sf_dir):
    from ..functions.columns import binned

    df = tables.runs(spark, sf_dir)
    edges = F.array(*[F.lit(e) for e in ranks.quantile_edges(df, "tput", 5)])
    found = df.groupBy(binned(F.col("tput"), edges).alias("bin")).agg(F.count("*").alias("n"), F.min("tput").alias("low"), F.max("tput").alias("high"), F.avg("latency").alias("latency"))
    return found.select(F.col("bin").cast("bigint").alias("bin"), "n", to_digits("low", 4).alias("low"), to_digits("high", 4).alias("high"), to_digits("latency", 9).alias("latency"))


@query(f"WITH {RUNS}, m AS (SELECT median(energy) AS e FROM runs), x AS (SELECT run_id, conc, coalesce(energy, e) AS energy, tput FROM runs, m), s AS (SELECT avg(energy) AS me, stddev_pop(energy) AS se, avg(tput) AS mt, stddev_pop(tput) AS st FROM x) SELECT run_id, conc, round((energy - me) / se, 4) + 0.0 AS energy, round((tput - mt) / st, 4) + 0.0 AS tput FROM x, s")
def encode_impute_scale(spark, sf_dir):
    df = tables.runs(spark, sf_dir)
    encoder = encode.fit(df, ["energy", "tput"], [])
    return df.select("run_id", "conc", *[to_digits(c, 4).alias(n) for n, c in zip(encoder.names(), encoder.columns(), strict=True)])


@query(f"WITH {JOINED}, l AS (SELECT config_hardware AS level, count(*) AS n FROM joined GROUP BY 1) SELECT 'config_hardware=' || level AS name, n FROM l UNION ALL SELECT 'config_framework=' || config_framework, count(*) FROM joined GROUP BY config_framework")
def encode_onehot(spark, sf_dir):
    df = tables.joined(spark, sf_dir)
    encoder = encode.fit(df, [], ["config_hardware", "config_framework"])
    names = F.array(*[F.lit(n) for n in encoder.names()])
    hot = encoder.transform(df).select(F.posexplode("features").alias("i", "x"))
    return hot.groupBy(names[F.col("i")].alias("name")).agg(F.sum("x").cast("bigint").alias("n"))


@query("WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT a.i::BIGINT AS i, b.i::BIGINT AS j, round(covar_pop(a.x, b.x), 9) AS cov FROM e a JOIN e b USING (vec_id) WHERE a.i <= b.i GROUP BY ALL")
def covariance_matrix(spark, sf_dir):
    _, _, cov = pca.covariance(_vectors(spark, sf_dir), "embedding")
    i, j = np.triu_indices(len(cov))
    rows = [(int(a), int(b), round(float(cov[a, b]), 9)) for a, b in zip(i, j, strict=True)]
    return spark.createDataFrame(rows, "i bigint, j bigint, cov double")


def _vectors(spark, sf_dir):
    return tables.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


@query()
def pca_explained(spark, sf_dir):
    return spark.createDataFrame(pca.explained(pca.fit(_vectors(spark, sf_dir), "embedding")), "component bigint, share double, cumulative double")


@query()
def pca_scores(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    return pca.fit(df, "embedding", components=5).scores(df, "embedding").select("vec_id", "scores")


_NUMERIC, _CATEGORIES = ["isl", "conc", "config_balance"], ["config_hardware", "config_framework", "benchmark_type"]


def _encoded(spark, sf_dir):
    df = tables.joined(spark, sf_dir)
    encoder = encode.fit(df, _NUMERIC, _CATEGORIES)
    return encoder, encoder.transform(df)


@query()
def pca_loadings_source(spark, sf_dir):
    encoder, df = _encoded(spark, sf_dir)
    basis = pca.fit(df, "features", encoder.names(), 5)
    return spark.createDataFrame(pca.loadings(basis, encoder.sources(), 5), "component bigint, source string, signed double, absolute double")


@query()
def pca_contributions(spark, sf_dir):
    encoder, df = _encoded(spark, sf_dir)
    return spark.createDataFrame(pca.contributions(pca.fit(df, "features", encoder.names()), encoder.sources(), 5), "source string, weight double, share double")


@query()
def pca_stability(spark, sf_dir):
    return spark.createDataFrame(pca.stability(_vectors(spark, sf_dir), "embedding", "vec_id"), "run bigint, component bigint, share double, cosine double")


@query()
def pca_bootstrap(spark, sf_dir):
    return spark.createDataFrame(pca.bootstrap(_vectors(spark, sf_dir), "embedding", "label"), "component bigint, feature bigint, low double, high double")


@query()
def basis_compare(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    old, new = (pca.fit(df.where(c), "embedding", components=5) for c in ("vec_id % 2 = 0", "vec_id % 2 = 1"))
    return spark.createDataFrame(pca.compare(old, new, 5), "component bigint, cosine double, share_change double, angle double")


@query()
def reconstruction_by_source(spark, sf_dir):
    encoder, df = _encoded(spark, sf_dir)
    basis = pca.fit(df, "features", encoder.names(), 10)
    return embedding.reconstruction(df, "features", basis.projected, encoder.sources())


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM e GROUP BY ALL), g AS (SELECT i, avg(x) AS gm FROM e GROUP BY i),
d AS (SELECT vec_id, e.label, sqrt(sum((x - m) ** 2)) AS d FROM e JOIN c ON e.label = c.label AND e.i = c.i GROUP BY ALL), s AS (SELECT label, avg(d) AS s, count(*) AS n, sum(d * d) AS w FROM d GROUP BY 1), a AS (SELECT x.label AS p, y.label AS q, sqrt(sum((x.m - y.m) ** 2)) AS apart FROM c x JOIN c y ON x.i = y.i AND x.label <> y.label GROUP BY ALL),
r AS (SELECT p, max((s1.s + s2.s) / apart) AS r FROM a JOIN s s1 ON p = s1.label JOIN s s2 ON q = s2.label GROUP BY 1), b AS (SELECT sum(n * (m - gm) ** 2) AS b FROM c JOIN g USING (i))
SELECT round((SELECT avg(r) FROM r), 6) AS davies_bouldin, round((SELECT b FROM b) / ((SELECT count(*) FROM s) - 1) / ((SELECT sum(w) FROM s) / ((SELECT sum(n) FROM s) - (SELECT count(*) FROM s))), 6) AS calinski_harabasz, round((SELECT min(n) / max(n) FROM s), 6) AS balance""")
def cluster_metrics(spark, sf_dir):
    found = embedding.cluster_scores(_vectors(spark, sf_dir), "embedding", "label")
    return spark.createDataFrame([tuple(round(float(v), 6) for v in found.values())], "davies_bouldin double, calinski_harabasz double, balance double")


@query("SELECT label::BIGINT AS actual, vec_id % 5 AS predicted, count(*) AS n FROM embeddings GROUP BY ALL")
def cluster_contingency(spark, sf_dir):
    return rounded(embedding.confusion(_vectors(spark, sf_dir).withColumn("other", F.col("vec_id") % 5), "label", "other"))


@query("""WITH t AS (SELECT label AS a, floor(label / 2)::BIGINT AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY ALL), ra AS (SELECT a, sum(n) AS n FROM t GROUP BY 1), rb AS (SELECT b, sum(n) AS n FROM t GROUP BY 1), s AS (SELECT sum(n) AS n FROM t),
x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS both_, (SELECT sum(n * (n - 1) / 2) FROM ra) AS pa, (SELECT sum(n * (n - 1) / 2) FROM rb) AS pb, (SELECT n * (n - 1) / 2 FROM s) AS pairs),
i AS (SELECT (SELECT sum(t.n / s.n * ln((t.n / s.n) / (ra.n / s.n * rb.n / s.n))) FROM t JOIN ra USING (a) JOIN rb USING (b), s) AS mi, (SELECT -sum(ra.n / s.n * ln(ra.n / s.n)) FROM ra, s) AS ha, (SELECT -sum(rb.n / s.n * ln(rb.n / s.n)) FROM rb, s) AS hb),
o AS (SELECT avg(m / rb.n) AS hit FROM (SELECT b, max(n) AS m FROM t GROUP BY b) JOIN rb USING (b))
SELECT round((both_ - pa * pb / pairs) / ((pa + pb) / 2 - pa * pb / pairs), 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi, round((SELECT hit FROM o), 6) AS overlap FROM x, i""")
def cluster_agreement(spark, sf_dir):
    found = embedding.agreement(_vectors(spark, sf_dir).withColumn("other", F.floor(F.col("label") / 2)), "label", "other")
    return spark.createDataFrame([tuple(round(float(v), 6) for v in found.values())], "ari double, nmi double, overlap double")


@query()
def kmeans_selection(spark, sf_dir):
    rows = embedding.kmeans_sweep(_vectors(spark, sf_dir), "embedding", "vec_id", (2, 4, 8), inits=2)
    return spark.createDataFrame([tuple(float(v) if k != "k" else v for k, v in r.items()) for r in rows], "k bigint, cost double, silhouette double, davies_bouldin double, calinski_harabasz double, balance double")


_ALL = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


@query(f"WITH {_ALL}, d AS (SELECT a.vec_id AS key, b.vec_id AS neighbour, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY distance, neighbour) AS rank FROM d) SELECT key, rank, neighbour, round(distance, 6) AS distance FROM r WHERE rank <= 10")
def knn_overlap(spark, sf_dir):
    return rounded(embedding.neighbours(_vectors(spark, sf_dir), "embedding", "vec_id"))


@query(f"""WITH {_ALL}, d AS (SELECT a.vec_id AS key, b.vec_id AS neighbour, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY distance, neighbour) AS rank FROM d),
t AS (SELECT key, k.label AS own, avg(n.label) AS near FROM r JOIN embeddings k ON k.vec_id = key JOIN embeddings n ON n.vec_id = neighbour WHERE rank <= 10 GROUP BY ALL), s AS (SELECT rank() OVER (ORDER BY own) + (count(*) OVER (PARTITION BY own) - 1) / 2.0 AS a, rank() OVER (ORDER BY near) + (count(*) OVER (PARTITION BY near) - 1) / 2.0 AS b FROM t) SELECT round(corr(a, b), 6) AS spearman, count(*) AS n FROM s""")
def neighbor_target_correlation(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    near = embedding.neighbours(df, "embedding", "vec_id").join(df.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("_l")), "neighbour").groupBy("key").agg(F.avg("_l").alias("near"))
    own = df.select(F.col("vec_id").alias("key"), F.col("label").cast("double").alias("own"))
    return rounded(ranks.spearman(near.join(own, "key"), "own", "near"))


@query()
def ridge_probe(spark, sf_dir):
    weights, intercept = embedding.ridge(_vectors(spark, sf_dir), "embedding", "label")
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)] + [(-1, intercept)], "i bigint, weight double")


@query()
def residual_tests(spark, sf_dir):
    """Normality of the residuals, and equality of their spread over frameworks, from aggregates alone."""
    df = _predicted(spark, sf_dir).withColumn("e", F.col("tput") - F.col("prediction"))
    n, skew, kurt = df.agg(F.count("e"), F.skewness("e"), F.kurtosis("e") + 3).first()
    groups = diagnostics.about_medians(df, "e", "config_framework").collect()
    k2, p = stats.normality(n, skew, kurt)
    w, pw = stats.levene([tuple(g[1:]) for g in groups])
    return spark.createDataFrame([(float(k2), float(p), float(w), float(pw))], "k2 double, k2_p double, levene double, levene_p double")


def _cohort(spark, sf_dir):
    """Median units with their configuration: the rows that models are compared on, a table that each of their many passes reads."""
    from ..operators.units import median_unit
    from .analytics import UNIT

    df = tables.joined(spark, sf_dir)
    return checkpointed(median_unit(df, [*UNIT, "config_hardware", "config_framework", "config_balance"], ["tput", "latency", "energy"]))


def _assigned(df, n_folds):
    """df with the fold of its configuration, a table too."""
    return checkpointed(df.join(folds.greedy_folds(df, "config_id", n_folds), "config_id"))


_FEATURES = (["isl", "conc", "config_balance"], ["config_framework", "benchmark_type"])


@query()
def models_rf_gbt_cv(spark, sf_dir):
    df = _cohort(spark, sf_dir)
    assigned = _assigned(df, 2)
    return models.evaluate(assigned, {"forest": models.Forest(trees=20, depth=5), "boosted": models.Boosted(rounds=5, depth=4), "ridge": models.Ridge(), "foundation": models.Unavailable("no in-context model here")}, *_FEATURES, "tput", "config_id")


@query()
def permutation_importance(spark, sf_dir):
    df = _cohort(spark, sf_dir)
    assigned = _assigned(df, 2)
    return models.importance(assigned.where("fold = 0"), assigned.where("fold = 1"), models.Forest(trees=20, depth=5), *_FEATURES, "tput", repeats=3)


@query()
def tail_two_stage(spark, sf_dir):
    df = _cohort(spark, sf_dir).where("energy is not null")
    assigned = _assigned(df, 2)
    return _tail_models(assigned, 0)


def _tail_models(assigned, part):
    """The candidates' (0) or the classifiers' (1) table of every fold."""
    from functools import reduce

    found = [models.two_stage(assigned.where(F.col("fold") != k), assigned.where(F.col("fold") == k), *_FEATURES, "energy", "p95", trees=models.Boosted(rounds=5, depth=4), gate_rounds=5)[part].withColumn("fold", F.lit(k).cast("bigint")) for k in (0, 1)]
    return reduce(DataFrame.unionByName, found)


@query()
def tail_classifiers(spark, sf_dir):
    df = _cohort(spark, sf_dir).where("energy is not null")
    return _tail_models(_assigned(df, 2), 1)


@query()
def ae_vae_screen(spark, sf_dir):
    df = _cohort(spark, sf_dir)
    assigned = _assigned(df, 3)
    encoder = encode.fit(assigned.where("fold <> 0"), *_FEATURES)
    return neural.screen(encoder.transform(assigned), "features", "fold", ["config_id", *_FEATURES[1], "isl", "conc"], [{"method": m, "k": k, "seed": 17, "fold": f, "beta": 0.001} for m in ("ae", "vae") for k in (2, 4) for f in range(3)], epochs=20)


@query()
def vae_beta_select(spark, sf_dir):
    df = _cohort(spark, sf_dir)
    assigned = _assigned(df, 2)
    encoder = encode.fit(assigned.where("fold <> 0"), *_FEATURES)
    runs = neural.screen(encoder.transform(assigned), "features", "fold", ["config_id", *_FEATURES[1], "isl", "conc"], [{"method": "vae", "k": 4, "seed": 17, "fold": f, "beta": b} for b in (0.0001, 0.001, 0.01) for f in (0, 1)], epochs=12)
    return neural.select_beta(runs, least_active=1)


@query()
def uncertainty_protocol(spark, sf_dir):
    return workflows.uncertainty(_cohort(spark, sf_dir), *_FEATURES, "tput", "config_id", n_folds=2, levels=(0.8,))


@query()
def representation_runs(spark, sf_dir):
    return workflows.representation_study(_cohort(spark, sf_dir), *_FEATURES, "config_id", ks=(2, 4), seeds=(17,), n_folds=2, epochs=8)


@query()
def pca_overlay(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    return reports.overlay(pca.fit(df, "embedding", components=3).scores(df, "embedding"), "scores", "label", 3)


@query()
def pca_representatives(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    return reports.representatives(pca.fit(df, "embedding", components=3).scores(df, "embedding"), "scores", 3, "vec_id")


@query()
def ablation_families(spark, sf_dir):
    df = _cohort(spark, sf_dir)
    assigned = _assigned(df, 2)
    families = {"workload": (["isl", "conc"], ["benchmark_type"]), "configuration": (["config_balance"], ["config_framework"])}
    return reports.ablation(assigned.where("fold = 0"), assigned.where("fold = 1"), families, 3)


@query()
def structure_vs_performance(spark, sf_dir):
    encoder, df = _encoded(spark, sf_dir)
    structure = [(s, w) for s, w, _ in pca.contributions(pca.fit(df, "features", encoder.names()), encoder.sources(), 5)]
    weights, _ = embedding.ridge(df, "features", "tput")
    performance = {s: 0.0 for s in encoder.sources()}
    for s, w in zip(encoder.sources(), weights, strict=True):
        performance[s] += abs(float(w))
    return reports.structure_against_performance(spark, structure, list(performance.items()), 4)


@query(f"WITH {RUNS} SELECT count(*) AS runs, count(DISTINCT config_id) AS configurations, (SELECT count(*) FROM (SELECT DISTINCT benchmark_type, isl, conc FROM runs)) AS workloads, min(date) AS first_date, max(date) AS last_date FROM runs")
def overview(spark, sf_dir):
    return reports.overview(tables.runs(spark, sf_dir), "config_id", ["benchmark_type", "isl", "conc"], "date")


@query(f"WITH {_PREDICTED}, r AS (SELECT fold AS run, config_framework AS feature, avg(abs(tput - prediction)) AS value FROM p GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY value DESC, feature) AS k FROM r) SELECT feature, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(avg(CASE WHEN k <= 2 THEN 1.0 ELSE 0.0 END), 6) AS top_share FROM k GROUP BY 1")
def feature_consistency(spark, sf_dir):
    rows = _predicted(spark, sf_dir).groupBy(F.col("fold").alias("run"), F.col("config_framework").alias("feature")).agg(F.avg(F.abs(F.col("tput") - F.col("prediction"))).alias("value"))
    found = reports.feature_consistency(rows, "run", "feature", "value", 2)
    return found.select("feature", to_digits("mean", 4).alias("mean"), to_digits("std", 4).alias("std"), to_digits("top_share", 6).alias("top_share"))


@query(f"WITH {_PREDICTED}, r AS (SELECT fold, benchmark_type, avg(abs(tput - prediction)) AS v FROM p GROUP BY ALL), i AS (SELECT fold, avg(v) AS m, stddev_pop(v) AS s FROM r GROUP BY 1) SELECT round(avg(m), 4) AS mean, round(stddev_pop(m), 4) AS between_partitions, round(avg(s), 4) AS within_partitions FROM i")
def run_variation(spark, sf_dir):
    rows = _predicted(spark, sf_dir).groupBy("fold", "benchmark_type").agg(F.avg(F.abs(F.col("tput") - F.col("prediction"))).alias("v"))
    return rounded(reports.variation(rows, "fold", "benchmark_type", "v"), 4)
