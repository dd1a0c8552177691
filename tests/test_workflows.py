"""Workflows and reports on small frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.operators import models, pca
from loomstat.plans import reports, workflows
from loomstat.sources import artifacts


def cohort(spark, n=160, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i % 16, "ab"[i % 2], float(rng.integers(1, 9)), float(i % 5), float(10 * (i % 16) + rng.normal())) for i in range(n)]
    return spark.createDataFrame(rows, "config_id long, config_hardware string, isl double, conc double, metrics_p99_itl double")


def test_uncertainty_covers_and_validation_targets_move_nothing_but_scores(spark):
    df = cohort(spark)
    table = workflows.uncertainty(df, ["isl", "conc"], ["config_hardware"], "metrics_p99_itl", "config_id", n_folds=2, levels=(0.8,)).collect()
    assert {(r.fold, r.method) for r in table} == {(k, m) for k in (0, 1) for m in ("global", "scaled", "quantile")}
    assert all(0 <= r.coverage <= 1 and r.width >= 0 and r.n > 0 for r in table)
    from loomstat.operators import folds

    first = {r.config_id for r in folds.greedy_folds(df, "config_id", 2).where("fold = 0").collect()}
    moved = df.withColumn("metrics_p99_itl", F.when(F.col("config_id").isin(list(first)), F.col("metrics_p99_itl") + 1000).otherwise(F.col("metrics_p99_itl")))
    again = workflows.uncertainty(moved, ["isl", "conc"], ["config_hardware"], "metrics_p99_itl", "config_id", n_folds=2, levels=(0.8,)).collect()
    width = lambda t: {r.method: round(r.width, 9) for r in t if r.fold == 0}
    assert width(table) == width(again)


def test_model_comparison_saves_and_resumes(spark, tmp_path):
    path = str(tmp_path / "r.json")
    run = lambda: workflows.compare_models(cohort(spark), "metrics_p99_itl", n_folds=2, out=path, adapters={"ridge": models.Ridge(), "no": models.Unavailable("no")})
    rows = run()
    assert len(rows) == 4 and run() == rows and artifacts.row_level(artifacts.read(path)) == []
    with pytest.raises(ValueError):
        workflows.compare_models(cohort(spark, 3), "metrics_p99_itl")


def test_basis_artifact(spark, tmp_path):
    a, b = cohort(spark), cohort(spark, seed=1)
    made = [workflows.basis_artifact(a, b, ["isl", "conc"], ["config_hardware"], ["metrics_p99_itl"], str(tmp_path / f"{i}.json")) for i in (0, 1)]
    assert made[0] == made[1] and artifacts.read(str(tmp_path / "0.json"))["basis_sha256"] == made[0]["basis_sha256"]
    with pytest.raises(ValueError):
        workflows.basis_artifact(a, b, ["isl"], [], [], str(tmp_path / "x.json"), {"old": 1, "new": 1})


def test_study_leaves_folds_beyond_the_budget_out(spark):
    table = workflows.representation_study(cohort(spark), ["isl", "conc"], ["config_hardware"], "config_id", ks=(1, 2), seeds=(1,), n_folds=2, epochs=2)
    assert table.count() == 2 * 2 * 3
    pcas = {(r.k, r.fold): r.validation_mse for r in table.where("method = 'pca'").collect()}
    assert all(pcas[(2, f)] <= pcas[(1, f)] for f in (0, 1))


def test_ablation_equals_projection(spark):
    df = spark.createDataFrame([(i, float(v[0]), float(v[1]), float(v[2])) for i, v in enumerate(np.random.default_rng(0).normal(size=(80, 3)))], "i long, a double, b double, c double")
    train, valid = df.where("i < 50"), df.where("i >= 50")
    got = reports.ablation(train, valid, {"all": (["a", "b", "c"], [])}, 2).first().mse
    t, v = (np.array([[r.a, r.b, r.c] for r in x.collect()]) for x in (train, valid))
    z = (v - t.mean(0)) / t.std(0)
    s = (t - t.mean(0)) / t.std(0)
    w = np.linalg.eigh(np.cov(s.T))[1][:, ::-1][:, :2]
    assert math.isclose(got, ((z - z @ w @ w.T) ** 2).mean(), rel_tol=1e-9)


def test_run_tables(spark):
    runs = spark.createDataFrame([(0, "x", 3.0), (0, "y", 1.0), (0, "z", 2.0), (1, "x", 3.0), (1, "y", 2.0), (1, "z", 1.0)], "run long, f string, v double")
    top = {r.f: r.top_share for r in reports.feature_consistency(runs, "run", "f", "v", 1).collect()}
    assert top == {"x": 1.0, "y": 0.0, "z": 0.0}
    assert math.isclose(reports.pairwise_runs(runs, "run", "f", "v").first().spearman, 0.5)
    assert reports.variation(runs, "run", "f", "v").first().between_partitions == 0.0
    joined = reports.structure_against_performance(spark, [("a", 2.0), ("b", 1.0)], [("b", 5.0), ("c", 1.0)]).collect()
    assert {(r.feature, r.verdict) for r in joined} == {("a", "shapes structure only"), ("b", "both"), ("c", "drives performance only")}


def test_narrative_names_each_axis_once():
    basis = pca.Basis(["a", "b"], np.zeros(2), np.array([[0.9, 0.8], [0.4, -0.6]]), np.ones(2), np.array([0.7, 0.3]))
    axes = [r["axis"] for r in reports.narrative(basis, ["a", "b"])]
    assert axes == ["a", "b"]
