"""Reports, studies and summaries on small frames, and the reporting queries against their SQL."""

import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.functions import roles
from loomstat.operators import diagnostics, embedding, encode, folds, models, neural, pca, profile, ranks, units
from loomstat.plans import reporting, research, workflows
from loomstat.sources import artifacts, readers

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("lineitem", "supplier", "nation", "region", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(reporting.ORACLES))
def test_reports_equal_sql(spark, duck, name):
    df = reporting.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    found = duck.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({reporting.ORACLES[name]})").fetchall()
    plain = lambda rows: sorted(repr(tuple(round(v, 3) + 0.0 if isinstance(v, float) and math.isfinite(v) else v for v in r)) for r in rows)
    assert plain([tuple(r) for r in df.select(*[F.col(f"`{c}`") for c in columns]).collect()]) == plain(found)


@pytest.mark.parametrize("parts", ["2", "40"])
def test_quantiles_and_ranks_with_a_value_in_most_rows(spark, parts):
    """Ties, groups, nulls, NaN and few values, against NumPy; one value is in 90 % of the rows."""
    rng = np.random.default_rng(4)
    values = [5.0] * 900 + rng.normal(5, 20, 100).round(1).tolist()
    rows = [(i % 3, float(v), float(i % 7)) for i, v in enumerate(values)] + [(0, None, 1.0), (1, float("nan"), 2.0), (9, None, 1.0), (8, 4.0, 0.0), (7, 1.0, 3.0), (7, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "g long, v double, w double").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        shares = {"a": 0.0, "b": 0.05, "c": 0.25, "d": 0.5, "e": 0.931, "f": 1.0}
        table = {r["g"]: r for r in ranks.quantile_table(df, ["v"], shares, ["g"]).collect()}
        for g in (0, 1, 2, 7, 8):
            own = [v for k, v, _ in rows if k == g and v is not None and not math.isnan(v)]
            assert np.allclose([table[g][n] for n in shares], np.quantile(own, list(shares.values())))
        assert 9 not in table
        assert ranks.quantiles(df.where("g = 9"), ["v", "w"], [0.5]) == {"v": [None], "w": [1.0]}
        got = {(r.g, r.v): (r._before, r._ties, r._total) for r in ranks.levels(df.where("not isnan(v)"), "v", ["g"]).collect()}
        for (g, v), found in got.items():
            own = np.array([x for k, x, _ in rows if k == g and x is not None and not math.isnan(x)])
            assert found == ((own < v).sum(), (own == v).sum(), len(own))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_covariance_is_one_job_and_profiles_build_without_any(spark):
    df = spark.createDataFrame([([float(i), float(i * i % 7)],) for i in range(400)], "features array<double>").repartition(40)
    tracker = spark.sparkContext.statusTracker()
    jobs = lambda group: len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("covariance", "")
    n, mean, cov = pca.covariance(df, "features")
    x = np.array([[i, i * i % 7] for i in range(400)], float)
    assert n == 400 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))
    assert jobs("covariance") <= 4
    spark.sparkContext.setJobGroup("profile", "")
    report = profile.numeric_summary(df.select(F.col("features")[0].alias("a")), ["a"])
    assert jobs("profile") == 0 and report.first()["median"] == 199.5
    spark.sparkContext.setJobGroup("rest", "")
    assert pca.covariance(df.limit(0), "features")[0] == 0


def test_bootstrap_by_partial_matrices(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) * [5, 2, 1]
    df = spark.createDataFrame([(i % 6, v.tolist()) for i, v in enumerate(x)], "g long, features array<double>").repartition(7)
    found = pca.bootstrap(df, "features", "g", runs=10, components=2)
    assert len(found) == 6 and all(low <= high for _, _, low, high in found)
    assert next(low for c, i, low, _ in found if (c, i) == (1, 0)) > 0.8


def test_greedy_plan_equals_one_group_at_a_time():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(2, 40))
        sizes, k = rng.integers(1, 9, n).tolist() + [int(rng.integers(1, 60))], int(rng.integers(2, 6))
        counts = {s: sizes.count(s) for s in sizes}
        rows, expected = [0] * k, {}
        for s in sorted(counts, reverse=True):
            for r in range(counts[s]):
                f = min(range(k), key=lambda j: (rows[j], j))
                expected[(s, r)] = f
                rows[f] += s
        got = {(s, r): cycle[(r - a) % len(cycle)] for s, a, b, cycle in folds.greedy_plan(counts, k) for r in range(a, b)}
        assert got == expected


def test_supervised_inputs_are_of_training_rows(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, None, None), (3, 6.0, "b"), (4, 100.0, "c")], "i long, x double, c string")
    prepared = encode.supervised(df.where("i < 4"), ["x"], ["c"])
    got = {r.i: (r.x, r.x__missing, r.c) for r in prepared.transform(df).collect()}
    assert got == {1: (2.0, 0.0, "a"), 2: (4.0, 1.0, "__MISSING__"), 3: (6.0, 0.0, "b"), 4: (100.0, 0.0, "c")}
    assert prepared.numeric() == ["x", "x__missing"]


def cohort(spark, n=160, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i % 16, "ab"[i % 2], float(rng.integers(1, 9)), float(i % 5), float(10 * (i % 16) + rng.normal())) for i in range(n)]
    return spark.createDataFrame(rows, "config_id long, config_hardware string, isl double, conc double, metrics_p99_itl double")


def test_stale_folds_are_run_again(spark):
    df = cohort(spark).join(folds.greedy_folds(cohort(spark), "config_id", 2), "config_id")
    saved, run = [], []
    args = (["isl", "conc"], ["config_hardware"], "metrics_p99_itl", "config_id")
    models.evaluate(df, {"ridge": models.Ridge()}, *args, each=saved.append).count()
    again = lambda frame, adapter: (run.clear(), models.evaluate(frame, {"ridge": adapter}, *args, done=saved, each=run.append).count(), len(run))[-1]
    assert again(df, models.Ridge()) == 0
    assert again(df, models.Ridge(alpha=2.0)) == 2  # another setting
    moved = df.withColumn("isl", F.when(F.col("config_id") == 3, F.col("isl") + 1).otherwise(F.col("isl")))
    assert again(moved, models.Ridge()) == 2  # as many rows, but others


def test_importance_uses_all_rows_and_finds_the_feature(spark):
    rng = np.random.default_rng(6)
    rows = [(float(a), float(b), float(3 * a + 0.01 * b)) for a, b in rng.normal(size=(300, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y double").repartition(6)
    got = {r.feature: r for r in models.importance(df, df, models.Ridge(0.01), ["a", "b"], [], "y", repeats=2).collect()}
    assert got["a"].mean > 1 > abs(got["b"].mean) + 0.9 and got["a"].repeats == 2
    summary = models.importance_summary(spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 2.0)], "feature string, fold long, mean double"))
    assert {r.feature: (r.mean, round(r.std, 6), r.folds) for r in summary.collect()} == {"a": (2.0, 1.414214, 2), "b": (2.0, 0.0, 1)}


def test_candidates_and_classifiers_by_hand(spark):
    long = spark.createDataFrame([("x", t, p, tail) for t, p, tail in ((1.0, 1.0, 0.0), (2.0, 3.0, 0.0), (3.0, 3.0, 0.0), (10.0, 4.0, 1.0))], "candidate string, t double, p double, _tail double")
    r = diagnostics.candidate_scores(long).first()
    assert (r.mae, r.ordinary_mae, r.tail_mae, r.large, r.worst_decile_mae) == (1.75, pytest.approx(1 / 3), 6.0, 1, 6.0)
    gates = spark.createDataFrame([("c", 0.9, 1.0), ("c", 0.8, 0.0), ("c", 0.6, 1.0), ("c", 0.1, 1.0), ("c", 0.05, 0.0)], "classifier string, p double, _tail double")
    g = diagnostics.classifier_scores(gates).first()
    assert (g.tn, g.fp, g.fn, g.tp) == (1, 1, 1, 2) and g.precision == pytest.approx(2 / 3) and g.recall == pytest.approx(2 / 3)
    assert g.average_precision == pytest.approx((1 + 2 / 3 + 3 / 4) / 3)


def test_two_stages_with_and_without_tail_support(spark):
    rng = np.random.default_rng(8)
    rows = [(float(a), float(a * 2 + (30 if a > 1.3 else 0) + rng.normal() * 0.1)) for a in rng.normal(size=600)]
    df = spark.createDataFrame(rows, "a double, y double")
    train, valid = df.where("hash(a) % 2 = 0"), df.where("hash(a) % 2 <> 0")
    for least in (5, 10_000):
        candidates, classifiers = models.two_stage(train, valid, ["a"], [], "y", "p95", least=least, trees=models.Boosted(rounds=3, depth=2), gate_rounds=3)
        got = {r.candidate: r for r in candidates.collect()}
        assert set(got) == set(models.CANDIDATES) and all(r.mae > 0 for r in got.values())
        assert {r.classifier: r.tails > 0 and r.recall > 0.5 for r in classifiers.collect()} == {"boosted": True, "logistic": True}


def test_dictionary_guide_and_quality_of_odd_columns(spark):
    df = spark.createDataFrame([(i, None, "same", float(i), "e" if i == 1 else None) for i in range(100)], "run_id long, osl double, config_model string, metrics_tput double, error string")
    got = {r.column: r for r in profile.feature_dictionary(df, df.columns).collect()}
    assert got["osl"].non_null == 0 and got["osl"].missing_pct == 100 and got["osl"].use == "exclude" and got["osl"].examples == ""
    assert got["config_model"].use == "exclude" and got["metrics_tput"].use == "target or overlay" and got["run_id"].use == "exclude"
    assert got["config_model"].unique == 1 and got["run_id"].unique == 100 and got["run_id"].examples == "0, 1, 10"
    empty = {r.column: r.non_null for r in profile.feature_dictionary(df.limit(0), df.columns).collect()}
    assert empty == dict.fromkeys(df.columns, 0)
    guide = profile.metric_guide(df, ["metrics_tput"]).first()
    assert (guide.kind, guide.direction, guide.use, guide.non_null) == ("throughput", "higher_is_better", "target", 100)
    checks = {(r.check, r.column): r.n for r in profile.quality_report(df.withColumn("conc", F.lit(0)), df.columns, ["config_model"], F.col("error").isNotNull(), ["metrics_tput"], ["conc"]).collect()}
    assert checks[("duplicate_rows", None)] == 100 and checks[("failed_rows", None)] == 1 and checks[("nonpositive_values", "conc")] == 100 and checks[("high_cardinality", "run_id")] == 100 and ("negative_values", "metrics_tput") not in checks


def test_roles_cohorts_and_filters(spark):
    assert roles.without_overlap(["b", "a", "b"], ["a", "c", "c"]) == (["b", "a"], ["c"])
    assert roles.in_families(["isl", "config_x", "metrics_itl"], {"workload"}) == ["isl"] and roles.label("config_num_gpu") == "num gpu"
    df = spark.createDataFrame([(1, "x ", "T", "3"), (2, None, "no", "nan")], "id long, c string, f string, n string")
    assert [tuple(r) for r in roles.normalised_inputs(df, ["n"], ["f"], ["c"]).orderBy("id").collect()] == [(1, "x", 1.0, 3.0), (2, "__MISSING__", 0.0, None)]
    with pytest.raises(ValueError):
        roles.cohort(df, ["missing"], "c", "x")
    assert units.filtered(df, {"id": 1}).count() == 1 and units.filtered(df, {}).count() == 2
    with pytest.raises(ValueError):
        units.cohort_digest(df, ["id", "c"], "id", {"rows": 3})
    assert roles.cardinalities(spark.range(1000).select((F.col("id") % 81).alias("k")))["k"] == (1000, 81)


def test_network_validation_is_of_all_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "i long, fold long, features array<double>")
    runs = [{"method": m, "k": 2, "seed": 1, "fold": 0, "beta": 0.01} for m in ("ae", "vae")]
    got = {r.method: r for r in neural.screen(df, "features", "fold", ["i"], runs, epochs=3, most=60).collect()}
    for r in neural.networks(df, "features", "fold", ["i"], runs, epochs=3, most=60).collect():
        net = neural.restored(4, 2, r.method == "vae", r.weights)
        expected = neural.diagnostics(net, x, x[::2])
        for name in ("validation_mse", "validation_mae", "kl", "active", "sensitivity"):
            assert got[r.method][name] == pytest.approx(expected[name])
    z = neural.latents(df, "features", "ae", 2, next(r.weights for r in neural.networks(df, "features", "fold", ["i"], runs[:1], epochs=1).collect()))
    assert len(z.first()["latent"]) == 2 and z.count() == 200


def test_final_runs_need_a_beta(spark):
    df = cohort(spark)
    _, rows = research.encoded_folds(df, ["isl", "conc"], ["config_hardware"], "config_id", 2)
    none = spark.createDataFrame([(0.1, False)], "beta double, selected boolean")
    for table in (None, none):
        with pytest.raises(ValueError):
            research.final_runs(rows, "features", ["config_id"], "vae", 1, (1,), 2, table)
    runs, chosen = research.screening(rows, "features", ["config_id", "isl", "conc"], "ae", (1, 2), (1,), 2, epochs=2)
    assert runs.count() == 4 and chosen.count() == 1 and research.run_summary(runs).count() == 2
    split = research.split_metadata(rows, "config_id", ["config_id", "isl", "conc"]).collect()
    assert sum(r.rows for r in split) == 160 and all(r.overlap == 0 for r in split)
    assert {r.digest for r in split} == {r.digest for r in research.split_metadata(rows.repartition(3), "config_id", ["config_id", "isl", "conc"]).collect()}


def test_geometry_agreement_and_outcomes(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(40, 2))
    turn = np.array([[0.0, 1.0], [-1.0, 0.0]])
    found = research.geometry({(0, 1): a, (0, 2): a @ turn, (1, 1): a, (1, 2): rng.normal(size=(40, 2))})
    scores = {(f, v): s for f, v, _, s in found}
    assert scores[("partition", 0)] == pytest.approx(1) and scores[("seed", 1)] == pytest.approx(1) and scores[("partition", 1)] < 0.9 and research.geometry({}) == []
    labels = spark.createDataFrame([(i, i // 10, i % 2, (i + 1) % 2, i // 20) for i in range(40)], "i long, g long, a long, b long, c long")
    got = {(r[0], r[1]): r[2:] for r in research.cluster_agreement(labels, "g", ["a", "b", "c"])}
    assert got[("a", "b")][0] == pytest.approx(1) and got[("a", "b")][2] == pytest.approx(1) and abs(got[("a", "c")][0]) < 0.1
    df = spark.createDataFrame([([float(x), float(y)], float(3 * x)) for x, y in a], "v array<double>, t double")
    told = research.outcomes(df, "v", "t", 2)
    assert told["strongest"] == 1 and told["pearson"] == pytest.approx(1) and told["ridge_r2"] > 0.9
    near = lambda rows: spark.createDataFrame(rows, "key long, neighbour long")
    assert embedding.neighbour_overlap(near([(1, 2), (1, 3), (2, 1)]), near([(1, 3), (1, 4), (2, 1), (9, 1)])).first() == (2, pytest.approx((1 / 3 + 1) / 2))


def test_stability_summaries_of_components(spark):
    rows = [(r, c, 0.5, 1.0 if r == 0 else x) for c, x in ((1, 0.95), (2, 0.7), (3, 0.2)) for r in range(3)]
    got = {r.component: (r.warning, r.runs) for r in pca.stability_summary(spark.createDataFrame(rows, "run long, component long, share double, cosine double")).collect()}
    assert got == {1: ("stable", 3), 2: ("weak", 3), 3: ("unstable", 3)}
    b = pca.Basis(["x", "y", "z"], np.zeros(3), np.array([[1.0, 0], [0, 1], [0.1, 0]]), np.ones(2), np.ones(2))
    c = pca.Basis(["z", "y", "x"], np.zeros(3), np.array([[-0.1, 0], [0, 1], [-1.0, 0]]), np.ones(2), np.ones(2))
    assert pca.drivers([b, b], 1, 1) == [("x", 1.0)]
    both = pca.compared_loadings(b, c, 2)
    assert both["correlation"][0] == pytest.approx(1) and both["subspace_cosines"] == pytest.approx([1, 1])


def test_reconstruction_by_levels(spark):
    df = spark.createDataFrame([([1.0, 0.0, 2.0], [0.0, 0.0, 0.0])], "a array<double>, b array<double>")
    got = {(r.level, r.name): r.mse for r in embedding.reconstruction_levels(df, "a", "b", ["h", "h", "n"], {"h": "category", "n": "numeric"}).collect()}
    assert got == {("overall", "all"): pytest.approx(5 / 3), ("balanced", "all"): 2.25, ("kind", "category"): 0.5, ("kind", "numeric"): 4.0, ("source", "h"): 0.5, ("source", "n"): 4.0}


def test_budget_guard_and_augmented_artifacts(tmp_path):
    path = str(tmp_path / "a.json")
    artifacts.write(path, {"x": 1})
    clock = iter(range(0, 1000, 10)).__next__
    done = research.within_budget([("one", lambda: 1), ("two", lambda: 2), ("three", lambda: 3)], 25, [path], lambda: float(clock()))
    assert [r["status"] for r in done] == ["done", "skipped", "skipped"] or [r["status"] for r in done] == ["done", "done", "skipped"]
    with pytest.raises(ValueError):
        research.within_budget([("bad", lambda: artifacts.write(path, {"x": 2}))], 25, [path])
    assert research.augmented(path, "warm_up", [1])["warm_up"] == [1]
    with pytest.raises(ValueError):
        research.augmented(path, "warm_up", [2])


def test_artifacts_are_compared_only_if_alike():
    part = lambda mse, dim=2: {"cohort_digest": "c", "dimension": dim, "seeds": [1], "folds": 2, "metrics": {"validation_mse": mse, "stability": 1 - mse}}
    found = research.compared_artifacts({"ae": part(0.1), "pca": part(0.3)})
    assert found["wins"] == {"ae": 2, "pca": 0} and found["matrix"][0]["best"] == "ae"
    with pytest.raises(ValueError):
        research.compared_artifacts({"ae": part(0.1), "pca": part(0.3, 3)})
    own, other = {"target": "t", "seed": 1, "fingerprint": "f", "models": {"a": 1}}, {"target": "t", "seed": 1, "fingerprint": "f", "models": {"b": 2}}
    assert research.merged_results(own, other)["models"] == {"a": 1, "b": 2}
    for wrong in (other | {"seed": 2}, own):
        with pytest.raises(ValueError):
            research.merged_results(own, wrong)


def test_research_summary_of_missing_bad_and_whole_artifacts(tmp_path, capsys):
    empty = research.research_summary(str(tmp_path), "t")
    assert set(empty["status"].values()) == {"missing"} and empty["point"] is None and "no artifact" in research.summary_text(empty)
    artifacts.write(str(tmp_path / "models.json"), {"targets": {"t": {"r2": 0.5, "r2_std": 0.1, "mae": 2.0}}})
    assert research.research_summary(str(tmp_path), "t")["point"]["r2"] == 0.5
    artifacts.write(str(tmp_path / "residuals.json"), {"metrics": {"r2_mean": 0.7, "r2_std": 0.1, "mae_mean": 1.0}, "evidence": {"k2": 9.0}})
    groups = [{"value": "a", "n": 1, "coverage": 0.0}, {"value": "b", "n": 30, "coverage": 0.7}]
    artifacts.write(str(tmp_path / "uncertainty.json"), {"intervals": [{"method": "global", "level": 0.8, "coverage": 0.81, "width": 5.0, "score": 9.0}, {"method": "scaled", "level": 0.8, "coverage": 0.8, "width": 4.0, "score": 8.0, "groups": groups}]})
    (tmp_path / "tails.json").write_text(json.dumps({"aggregate_only": True, "predictions": [1]}))
    found = research.research_summary(str(tmp_path), "t")
    assert found["point"]["r2"] == 0.7 and found["intervals"]["0.8"]["method"] == "scaled" and found["intervals"]["0.8"]["small_groups"] == 1 and found["intervals"]["0.8"]["worst_group"]["value"] == "b"
    assert found["status"]["tails"].startswith("unavailable") and found["status"]["models"] == "available"
    workflows.main(["summary", str(tmp_path), "--target", "t", "--out", str(tmp_path / "out.json")])
    assert "R2 0.700000" in capsys.readouterr().out and artifacts.read(str(tmp_path / "out.json"))["target"] == "t"


def test_diagnosis_of_targets(spark):
    df = cohort(spark).withColumn("metrics_few", F.when(F.col("conc") > 99, 1.0)).withColumn("metrics_negative", F.col("conc") - 2)
    found = workflows.diagnose(df, ["metrics_p99_itl", "metrics_few", "metrics_negative"], n_folds=2, adapters={"ridge": models.Ridge()}, kinds=("raw", "log1p"))
    ran = [r for r in found if "skipped" not in r]
    assert {(r["target"], r["kind"]) for r in ran} == {("metrics_negative", "raw")} | ({("metrics_p99_itl", "raw"), ("metrics_p99_itl", "log1p")} & {(r["target"], r["kind"]) for r in ran})
    assert {r["target"] for r in found if "skipped" in r} >= {"metrics_few", "metrics_negative"}


def test_embeddings_with_a_manifest(spark, tmp_path):
    df = spark.createDataFrame([(s, str(i), [float(i), float(s)]) for s in (1, 2) for i in range(5)], "seed long, row_id string, z array<double>")
    path = str(tmp_path / "e")
    made = readers.write_embeddings(df, path)
    assert made["rows"] == 10 and made["seeds"] == ["1", "2"] and made["different_keys"] == 5
    assert readers.read_embeddings(spark, path, rows=10).count() == 10
    with pytest.raises(ValueError):
        readers.read_embeddings(spark, path, rows=11)
    df.limit(3).write.mode("append").partitionBy("seed").parquet(path)
    with pytest.raises(ValueError, match="digest"):
        readers.read_embeddings(spark, path)


def test_json_keys_in_one_pass(spark):
    rows = ['{"b": 1, "a": {"x": 2, "y": "no"}}', '{"c": "4.5"}', "[1]", "no json", None]
    df = readers.expand_metrics(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, metrics string"))
    assert df.columns == ["i", "metrics_b", "metrics_c", "metrics_a.x", "metrics_a.y"]
    assert [tuple(r) for r in df.orderBy("i").collect()][:2] == [(0, 1.0, None, 2.0, None), (1, None, 4.5, None, None)]


def test_thresholds_agree_with_duckdb_where_decimals_end_in_five(spark):
    """Rounded halves and interpolation between unlike neighbours, to the last bit; two folds whose interquartile range is odd in its last digit."""
    from loomstat.functions.columns import to_digits

    rng = np.random.default_rng(8)
    halves = [8981.43645, 3633.6628499999997, -855.6859499999999, 0.0, 1e300, *(rng.integers(1, 10**9, 500) / 1e5).tolist()]
    duck = duckdb.connect()
    assert [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(halves)], "i long, v double").orderBy("i").select(to_digits("v", 4)).collect()] == [r[0] for r in duck.execute("SELECT round(unnest(?::DOUBLE[]), 4)", [halves]).fetchall()]
    values = (rng.integers(1, 10**7, 400) / 1e4).tolist()
    rows = [(i % 2, float(v)) for i, v in enumerate(values)]
    shares = {"a": 0.05, "b": 0.25, "c": 0.75, "d": 0.975}
    for g, *found in ranks.quantile_table(spark.createDataFrame(rows, "g long, v double"), ["v"], shares, ["g"]).drop("column").collect():
        own = [v for k, v in rows if k == g]
        assert found == list(duck.execute(f"SELECT {', '.join(f'quantile_cont(x, {p})' for p in shares.values())} FROM (SELECT unnest(?::DOUBLE[]) AS x)", [own]).fetchone())


def _sorted_joins(spark, frame):
    """How many joins of a plan bring all rows of a key to one task, where Spark knows no sizes."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return frame()._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _few_groups(spark):
    return spark.createDataFrame([(i % 3, i % 2, float(i * i % 101)) for i in range(300)], "fold long, g long, v double")


def test_groups_of_quantiles_and_means_are_not_joined_in_one_task_each(spark):
    df = _few_groups(spark)
    assert _sorted_joins(spark, lambda: ranks.quantile_table(df, ["v"], {"m": 0.5}, ["g"])) == 0
    assert _sorted_joins(spark, lambda: diagnostics.out_of_fold_means(df, "v", ["g"])) == 0
    plain, asked = [{r[0]: r[-1] for r in ranks.at_places(df, ["v"], {"m": (0.5, lambda t: t - 1)}, ["g"], few=few).collect()} for few in (True, False)], {g: max(r.v for r in df.collect() if r.g == g) for g in (0, 1)}
    assert plain == [asked, asked]


def test_distances_from_medians_are_not_joined_in_one_task_a_group(spark):
    df = _few_groups(spark)
    assert _sorted_joins(spark, lambda: diagnostics.about_medians(df, "v", "g")) == 0
    for g, n, mean, squares in diagnostics.about_medians(df, "v", "g").collect():
        own = np.array([r.v for r in df.collect() if r.g == g])
        away = np.abs(own - np.median(own))
        assert (n, pytest.approx(mean), pytest.approx(squares)) == (len(own), away.mean(), (away**2).sum())





def test_reconstruction_by_levels(spark):
    df = spark.createDataFrame([([1.0, 0.0, 2.0], [0.0, 0.0, 0.0])], "a array<double>, b array<double>")
    got = {(r.level, r.name): r.mse for r in embedding.reconstruction_levels(df, "a", "b", ["h", "h", "n"], {"h": "category", "n": "numeric"}).collect()}
    assert got == {("overall", "all"): pytest.approx(5 / 3), ("balanced", "all"): 2.25, ("kind", "category"): 0.5, ("kind", "numeric"): 4.0, ("source", "h"): 0.5, ("source", "n"): 4.0}


def test_budget_guard_and_augmented_artifacts(tmp_path):
    path = str(tmp_path / "a.json")
    artifacts.write(path, {"x": 1})
    clock = iter(range(0, 1000, 10)).__next__
    done = research.within_budget([("one", lambda: 1), ("two", lambda: 2), ("three", lambda: 3)], 25, [path], lambda: float(clock()))
    assert [r["status"] for r in done] == ["done", "skipped", "skipped"] or [r["status"] for r in done] == ["done", "done", "skipped"]
    with pytest.raises(ValueError):
        research.within_budget([("bad", lambda: artifacts.write(path, {"x": 2}))], 25, [path])
    assert research.augmented(path, "warm_up", [1])["warm_up"] == [1]
    with pytest.raises(ValueError):
        research.augmented(path, "warm_up", [2])


def test_artifacts_are_compared_only_if_alike():
    part = lambda mse, dim=2: {"cohort_digest": "c", "dimension": dim, "seeds": [1], "folds": 2, "metrics": {"validation_mse": mse, "stability": 1 - mse}}
    found = research.compared_artifacts({"ae": part(0.1), "pca": part(0.3)})
    assert found["wins"] == {"ae": 2, "pca": 0} and found["matrix"][0]["best"] == "ae"
    with pytest.raises(ValueError):
        research.compared_artifacts({"ae": part(0.1), "pca": part(0.3, 3)})
    own, other = {"target": "t", "seed": 1, "fingerprint": "f", "models": {"a": 1}}, {"target": "t", "seed": 1, "fingerprint": "f", "models": {"b": 2}}
    assert research.merged_results(own, other)["models"] == {"a": 1, "b": 2}
    for wrong in (other | {"seed": 2}, own):
        with pytest.raises(ValueError):
            research.merged_results(own, wrong)


def test_research_summary_of_missing_bad_and_whole_artifacts(tmp_path, capsys):
    empty = research.research_summary(str(tmp_path), "t")
    assert set(empty["status"].values()) == {"missing"} and empty["point"] is None and "no artifact" in research.summary_text(empty)
    artifacts.write(str(tmp_path / "models.json"), {"targets": {"t": {"r2": 0.5, "r2_std": 0.1, "mae": 2.0}}})
    assert research.research_summary(str(tmp_path), "t")["point"]["r2"] == 0.5
    artifacts.write(str(tmp_path / "residuals.json"), {"metrics": {"r2_mean": 0.7, "r2_std": 0.1, "mae_mean": 1.0}, "evidence": {"k2": 9.0}})
    groups = [{"value": "a", "n": 1, "coverage": 0.0}, {"value": "b", "n": 30, "coverage": 0.7}]
    artifacts.write(str(tmp_path / "uncertainty.json"), {"intervals": [{"method": "global", "level": 0.8, "coverage": 0.81, "width": 5.0, "score": 9.0}, {"method": "scaled", "level": 0.8, "coverage": 0.8, "width": 4.0, "score": 8.0, "groups": groups}]})
    (tmp_path / "tails.json").write_text(json.dumps({"aggregate_only": True, "predictions": [1]}))
    found = research.research_summary(str(tmp_path), "t")
    assert found["point"]["r2"] == 0.7 and found["intervals"]["0.8"]["method"] == "scaled" and found["intervals"]["0.8"]["small_groups"] == 1 and found["intervals"]["0.8"]["worst_group"]["value"] == "b"
    assert found["status"]["tails"].startswith("unavailable") and found["status"]["models"] == "available"
    workflows.main(["summary", str(tmp_path), "--target", "t", "--out", str(tmp_path / "out.json")])
    assert "R2 0.700000" in capsys.readouterr().out and artifacts.read(str(tmp_path / "out.json"))["target"] == "t"


def test_diagnosis_of_targets(spark):
    df = cohort(spark).withColumn("metrics_few", F.when(F.col("conc") > 99, 1.0)).withColumn("metrics_negative", F.col("conc") - 2)
    found = workflows.diagnose(df, ["metrics_p99_itl", "metrics_few", "metrics_negative"], n_folds=2, adapters={"ridge": models.Ridge()}, kinds=("raw", "log1p"))
    ran = [r for r in found if "skipped" not in r]
    assert {(r["target"], r["kind"]) for r in ran} == {("metrics_negative", "raw")} | ({("metrics_p99_itl", "raw"), ("metrics_p99_itl", "log1p")} & {(r["target"], r["kind"]) for r in ran})
    assert {r["target"] for r in found if "skipped" in r} >= {"metrics_few", "metrics_negative"}


def test_embeddings_with_a_manifest(spark, tmp_path):
    df = spark.createDataFrame([(s, str(i), [float(i), float(s)]) for s in (1, 2) for i in range(5)], "seed long, row_id string, z array<double>")
    path = str(tmp_path / "e")
    made = readers.write_embeddings(df, path)
    assert made["rows"] == 10 and made["seeds"] == ["1", "2"] and made["different_keys"] == 5
    assert readers.read_embeddings(spark, path, rows=10).count() == 10
    with pytest.raises(ValueError):
        readers.read_embeddings(spark, path, rows=11)
    df.limit(3).write.mode("append").partitionBy("seed").parquet(path)
    with pytest.raises(ValueError, match="digest"):
        readers.read_embeddings(spark, path)


def test_json_keys_in_one_pass(spark):
    rows = ['{"b": 1, "a": {"x": 2, "y": "no"}}', '{"c": "4.5"}', "[1]", "no json", None]
    df = readers.expand_metrics(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, metrics string"))
    assert df.columns == ["i", "metrics_b", "metrics_c", "metrics_a.x", "metrics_a.y"]
    assert [tuple(r) for r in df.orderBy("i").collect()][:2] == [(0, 1.0, None, 2.0, None), (1, None, 4.5, None, None)]


def test_thresholds_agree_with_duckdb_where_decimals_end_in_five(spark):
    """Rounded halves and interpolation between unlike neighbours, to the last bit; two folds whose interquartile range is odd in its last digit."""
    from loomstat.functions.columns import to_digits

    rng = np.random.default_rng(8)
    halves = [8981.43645, 3633.6628499999997, -855.6859499999999, 0.0, 1e300, *(rng.integers(1, 10**9, 500) / 1e5).tolist()]
    duck = duckdb.connect()
    assert [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(halves)], "i long, v double").orderBy("i").select(to_digits("v", 4)).collect()] == [r[0] for r in duck.execute("SELECT round(unnest(?::DOUBLE[]), 4)", [halves]).fetchall()]
    values = (rng.integers(1, 10**7, 400) / 1e4).tolist()
    rows = [(i % 2, float(v)) for i, v in enumerate(values)]
    shares = {"a": 0.05, "b": 0.25, "c": 0.75, "d": 0.975}
    for g, *found in ranks.quantile_table(spark.createDataFrame(rows, "g long, v double"), ["v"], shares, ["g"]).drop("column").collect():
        own = [v for k, v in rows if k == g]
        assert found == list(duck.execute(f"SELECT {', '.join(f'quantile_cont(x, {p})' for p in shares.values())} FROM (SELECT unnest(?::DOUBLE[]) AS x)", [own]).fetchone())


def _sorted_joins(spark, frame):
    """How many joins of a plan bring all rows of a key to one task, where Spark knows no sizes."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return frame()._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _few_groups(spark):
    return spark.createDataFrame([(i % 3, i % 2, float(i * i % 101)) for i in range(300)], "fold long, g long, v double")


def test_groups_of_quantiles_and_means_are_not_joined_in_one_task_each(spark):
    df = _few_groups(spark)
    assert _sorted_joins(spark, lambda: ranks.quantile_table(df, ["v"], {"m": 0.5}, ["g"])) == 0
    assert _sorted_joins(spark, lambda: diagnostics.out_of_fold_means(df, "v", ["g"])) == 0
    plain, asked = [{r[0]: r[-1] for r in ranks.at_places(df, ["v"], {"m": (0.5, lambda t: t - 1)}, ["g"], few=few).collect()} for few in (True, False)], {g: max(r.v for r in df.collect() if r.g == g) for g in (0, 1)}
    assert plain == [asked, asked]


def test_distances_from_medians_are_not_joined_in_one_task_a_group(spark):
    df = _few_groups(spark)
    assert _sorted_joins(spark, lambda: diagnostics.about_medians(df, "v", "g")) == 0
    for g, n, mean, squares in diagnostics.about_medians(df, "v", "g").collect():
        own = np.array([r.v for r in df.collect() if r.g == g])
        away = np.abs(own - np.median(own))
        assert (n, pytest.approx(mean), pytest.approx(squares)) == (len(own), away.mean(), (away**2).sum())


def test_rank_correlation_scans_rows_once_and_counts_equal_pairs(spark):
    from pyspark.sql.types import DoubleType

    seen = spark.sparkContext.accumulator(0)
    noted = F.udf(lambda v: (seen.add(1), v)[1], DoubleType())
    rows = [(i % 3, float(i * i % 23), float(i % 4)) for i in range(900)] + [(0, None, 1.0), (1, 2.0, None)]
    df = spark.createDataFrame(rows, "g long, a double, b double").repartition(3).withColumn("a", noted("a"))
    whole = ranks.spearman(df, "a", "b").first()
    assert seen.value <= 2 * len(rows)
    both = [(a, b) for _, a, b in rows if a is not None and b is not None]
    place = lambda v: np.array([(np.array(v) < x).sum() + ((np.array(v) == x).sum() + 1) / 2 for x in v])
    assert whole == (pytest.approx(np.corrcoef(place([a for a, _ in both]), place([b for _, b in both]))[0, 1], abs=1e-12), 900)
    for g, found, n in ranks.spearman(df, "a", "b", ["g"]).collect():
        own = [(a, b) for k, a, b in rows if k == g and a is not None and b is not None]
        assert (found, n) == (pytest.approx(np.corrcoef(place([a for a, _ in own]), place([b for _, b in own]))[0, 1], abs=1e-12), 300)


def test_reconstruction_by_a_function_of_rows(spark):
    """As by a column, with nulls, NaN and short arrays; the encoder's arrays are those of its columns."""
    rows = [([1.0, 2.0, None], [0.5, 2.0, 1.0]), ([3.0, 4.0, 5.0], [3.0, 1.0]), (None, [1.0]), ([0.0, 0.0, 0.0], [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>").repartition(2)
    found = {r.source: (r.mse, r.mae) for r in embedding.reconstruction(df, "a", "b").collect()}
    assert found == {"x0": (pytest.approx(1.25 / 3), pytest.approx(0.5)), "x1": (pytest.approx(10 / 3), pytest.approx(4 / 3)), "x2": (1.0, 1.0)}
    assert {tuple(r) for r in embedding.reconstruction(df.where("a[2] is not null"), "a", lambda x: x + 2, ["s", "s", "t"]).collect()} == {("s", 4.0, 2.0), ("t", 4.0, 2.0)}
    table = spark.createDataFrame([(float(i), f"l{i % 40}", None if i % 7 == 0 else f"k{i % 3}", None) for i in range(200)], "x double, many string, few string, none string")
    encoder = encode.fit(table, ["x"], ["many", "few", "none"])
    for r in encoder.transform(table.unionByName(spark.createDataFrame([(None, "new", "new", "new")], table.schema))).select("features", F.array(*encoder.columns()).alias("own")).collect():
        assert r.features == r.own and len(r.own) == len(encoder.names())


def test_neighbours_hold_few_pairs_at_once(spark, monkeypatch):
    monkeypatch.setattr(embedding, "PAIRS", 64)
    x = np.random.default_rng(4).integers(0, 2, (300, 3)).astype(float)  # most rows lie at distance 0 of many
    found = {(r.key, r.rank, r.neighbour) for r in embedding.neighbours(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "i long, v array<double>"), "v", "i", 3).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert found == {(i, r + 1, int(j)) for i in range(len(x)) for r, j in enumerate(np.argsort(d[i], kind="stable")[:3])}


def test_cohorts_and_predictions_are_tables(spark):
    """What many passes read is not worked out again by each of them."""
    from loomstat.plans import modelling

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    df = modelling._cohort(spark, SMALL)
    assert "Join" not in plan(df) and "Aggregate" not in plan(df)
    assigned = modelling._assigned(df.where("energy is not null"), 2)
    assert "Join" not in plan(assigned) and assigned.groupBy("config_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert "Join" not in plan(reporting._study(spark, SMALL))
    for table in models.two_stage(assigned.where("fold = 0"), assigned.where("fold = 1"), *modelling._FEATURES, "energy", trees=models.Boosted(rounds=2, depth=2), gate_rounds=2):
        assert "UDF" not in plan(table)


def test_networks_sort_little_more_than_their_rows(spark):
    df = spark.range(60_000).select("id", F.xxhash64("id").alias("_h"))
    near = neural._least(df, 50)
    assert near.count() < 300
    assert near.orderBy("_h").limit(50).collect() == df.orderBy("_h").limit(50).collect()
    assert neural._least(df, 20_000).count() == 60_000
