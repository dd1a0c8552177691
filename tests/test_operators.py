"""Hand-computed values, nulls, ties and invariants of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.functions import roles, stats
from loomstat.functions.columns import corrected_skewness, flag, number, row_identity
from loomstat.operators import conformal, diagnostics, embedding, encode, energy, folds, models, neural, pca, profile, ranks, units


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_numbers_flags_and_identities(spark):
    df = frame(spark, [("1.5", "t"), ("x", "False"), ("NaN", "maybe"), ("inf", None)], "a string, b string")
    assert [tuple(r) for r in df.select(number(F.col("a")), flag(F.col("b"))).collect()] == [(1.5, 1.0), (None, 0.0), (None, None), (None, None)]
    ids = frame(spark, [(1.0, None)], "a double, b string").select(row_identity(F.col("a"), F.col("b")).alias("i")).first()[0]
    import hashlib

    assert ids == hashlib.sha256(b"1|<NA>").hexdigest()


def test_roles():
    assert roles.is_metric("metrics_p99_itl") and roles.is_metric("tput_per_gpu") and not roles.is_metric("config_itl_mode")
    assert roles.is_metadata("created_at") and not roles.is_metadata("isl")
    assert roles.feature_family("config_prefill_tp") == "topology" and roles.feature_family("isl") == "workload"
    with pytest.raises(ValueError):
        roles.without_leakage(["isl", "metrics_tput"], "metrics_tput")


def test_default_features_leave_metrics_and_target_out(spark):
    df = frame(spark, [(1, "a", 2.0, 3.0, 1.0), (2, "b", 3.0, 4.0, 2.0)], "config_id long, config_hardware string, isl double, metrics_tput double, config_tp double")
    assert roles.default_features(df, "metrics_tput") == ["config_hardware", "isl", "config_tp"]


def test_join_keeps_runs_columns_and_refuses_repeated_configurations(spark):
    runs = frame(spark, [(1, "own"), (3, None)], "config_id long, config_note string")
    configs = units.prefixed(frame(spark, [(1, "other", "h")], "id long, note string, hardware string"))
    assert sorted(map(tuple, units.join_configurations(runs, configs).collect())) == [(1, "own", "h"), (3, None, None)]
    with pytest.raises(ValueError):
        units.join_configurations(runs, configs.unionByName(configs))
    assert units.join_configurations(runs, frame(spark, [(1,)], "x long")) is runs


def test_median_unit_keeps_null_groups_and_breaks_mode_ties(spark):
    df = frame(spark, [(1, None, 1.0, "b", "m2", 2), (1, None, 3.0, "a", None, 1), (1, 5.0, float("nan"), "c", "m", 1)], "config_id long, isl double, x double, c string, m string, o int")
    out = units.median_unit(df, ["config_id", "isl"], ["x"], ["c"], ["m"], "o").orderBy("isl").collect()
    assert [tuple(r) for r in out] == [(1, None, 2.0, "a", "m2", 2), (1, 5.0, None, "c", "m", 1)]


def test_latest_row_without_a_date_wins(spark):
    df = frame(spark, [(1, "2024-01-02", 1, "a"), (1, None, 0, "b"), (2, "2024-01-02", 1, "c"), (2, "2024-01-02", 2, "d")], "k long, d string, o int, v string")
    out = {r["k"]: (r["v"], r["row_count_in_group"]) for r in units.latest_unit(df, ["k"], "d", "o").collect()}
    assert out == {1: ("b", 2), 2: ("d", 2)}


def test_snapshots(spark):
    a, b = (frame(spark, rows, "k long, j string") for rows in ([(1, None), (2, "x")], [(1, None), (3, "y")]))
    assert {(r.k, r.state) for r in units.snapshot_difference(a, b, ["k", "j"]).collect()} == {(1, "retained"), (2, "gone"), (3, "new")}


def test_sample_is_the_same_every_time(spark):
    df = spark.range(100)
    assert units.sample(df, 10, 1, "id").collect() == units.sample(df.repartition(7), 10, 1, "id").collect()
    assert units.sample(df, 10, 1, "id").collect() != units.sample(df, 10, 2, "id").collect()
    assert [r.id for r in units.evenly_spaced(df, 10, "id").orderBy("id").collect()] == list(range(0, 100, 10))


def test_ranks_agree_with_arrays(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 20, 300), rng.normal(size=300).round(1)
    df = frame(spark, [(i, float(a), float(b), "g" if i % 3 else None) for i, (a, b) in enumerate(zip(x, y))], "i long, a double, b double, g string")
    got = [r[0] for r in ranks.average_rank(df, "a", "r").orderBy("i").select("r").collect()]
    assert np.allclose(got, stats.ranks(x.astype(float)))
    found = ranks.spearman(df, "a", "b").first()["spearman"]
    assert math.isclose(found, np.corrcoef(stats.ranks(x.astype(float)), stats.ranks(y))[0, 1], abs_tol=1e-12)
    third = {r.g: r.b for r in ranks.order_statistic(df, "b", F.lit(3), ["g"]).collect()}
    assert third == {g: sorted(b for i, b in enumerate(y) if (i % 3 == 0) == (g is None))[2] for g in ("g", None)}


def test_constant_and_empty_correlations_are_null(spark):
    df = frame(spark, [(1.0, 2.0)] * 5, "a double, b double")
    assert ranks.spearman(df, "a", "b").first()["spearman"] is None
    assert df.agg(corrected_skewness(F.col("a"))).first()[0] is None


def test_skewness_by_definition(spark):
    x = np.array([1.0, 2.0, 3.0, 10.0])
    got = frame(spark, [(v,) for v in x.tolist()], "a double").agg(corrected_skewness(F.col("a"))).first()[0]
    g = ((x - x.mean()) ** 3).mean() / x.std() ** 3
    assert math.isclose(got, g * math.sqrt(12) / 2)


def test_profile_values(spark):
    df = frame(spark, [(1.0, "a"), (2.0, None), (None, "a"), (100.0, "b")], "x double, c string")
    row = profile.numeric_summary(df, ["x"]).first()
    assert (row["count"], row["missing"], row["median"], row["max"]) == (3, 1, 2.0, 100.0)
    assert {(r["value"], r["n"], r["share"]) for r in profile.value_counts(df, ["c"]).collect()} == {("a", 2, 0.5), ("b", 1, 0.25), ("__MISSING__", 1, 0.25)}
    assert profile.missingness(df, ["x"]).first()["missing_share"] == 0.25
    assert [tuple(r) for r in profile.histogram(df, "x", 2).orderBy("bin").select("bin", "n").collect()] == [(0, 2), (1, 1)]


def test_wide_profile(spark):
    df = spark.range(5).select(*[(F.col("id") + i).cast("double").alias(f"c{i}") for i in range(65)])
    out = profile.numeric_summary(df, df.columns)
    assert out.count() == 65 and out.where("column = 'c64'").first()["mean"] == 66.0


def test_quality_counts(spark):
    df = frame(spark, [(1, -1.0, "error: x"), (1, 2.0, None), (2, 3.0, "ok")], "k long, m double, e string")
    row = profile.quality(df, ["k"], F.coalesce(F.col("e").rlike("(?i)fail|error|abort"), F.lit(False)), ["m"], ["k"]).first()
    assert row.asDict() == {"rows": 3, "duplicate_rows": 2, "failed_rows": 1, "negative_metrics": 1, "nonpositive_workload": 0}


ENERGY = "config_id string, conc long, energy double, tput double, date string"


def test_energy_lookup_states(spark):
    df = frame(spark, [("a", 1, 2.0, 1.0, "2026-06-01"), ("a", 1, 4.0, 1.0, "2026-06-03"), ("b", 2, float("nan"), 1.0, "2026-06-04"), ("c", 4, 1.0, 1.0, "2026-06-05")], ENERGY)
    row = energy.exact_lookup(df, "energy", {"config_id": "a", "conc": 1}, "config_id", "date").first()
    assert tuple(row) == ("observed", 2, 1, 3.0, 2.0, 4.0, "2026-06-01", "2026-06-03")
    assert energy.exact_lookup(df, "energy", {"config_id": "a", "conc": 4}, "config_id", "date").first()[0] == "no_exact_match"
    assert energy.exact_lookup(df, "energy", {"config_id": "b", "conc": 2}, "config_id", "date").first()[0] == "unsupported"
    assert energy.unsupported(df, "energy", {"config_id": "b", "conc": 1}) == ["config_id"]


def test_energy_conversions(spark):
    df = frame(spark, [(3.6,), (0.0,), (None,)], "energy double")
    rows = energy.conversions(df, "energy", 0.15).collect()
    assert tuple(rows[0])[1:] == (1.0, 1e6, 0.15) and all(v is None for r in rows[1:] for v in tuple(r)[1:])
    with pytest.raises(ValueError):
        energy.conversions(df, "energy", -1)


def test_dominance_equals_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(f"c{i}", int(rng.integers(0, 3)), float(rng.integers(1, 8)), float(rng.integers(1, 8)), "d") for i in range(80)]
    got = {r.config_id: r.dominated for r in energy.dominated(frame(spark, rows, ENERGY), ["conc"], "energy", "tput").collect()}
    assert got == {a[0]: any(b[1] == a[1] and b[2] < a[2] and b[3] > a[3] for b in rows) for a in rows}


def test_nearest_prefers_the_same_workload(spark):
    df = frame(spark, [("a", 1, 2.0, 1.0, "d"), ("b", 2, 1.0, 5.0, "d"), ("c", 2, 1.0, 1.0, "d")], ENERGY)
    out = energy.nearest(df, {"conc": 2, "tput": 1.0}, ["tput"], ["conc"], "energy", "config_id").collect()
    assert [(r.config_id, r.distance, r.differing_fields) for r in out] == [("c", 0.0, ""), ("b", 1.0, "tput")]
    assert [r.config_id for r in energy.nearest(df, {"conc": 9, "tput": 1.0}, ["tput"], ["conc"], "energy", "config_id").collect()] == ["c", "a", "b"]


def runs(spark, n=12, each=4):
    return frame(spark, [(i, j, float(i + j)) for i in range(n) for j in range(each + i % 2)], "config_id long, j long, y double")


def test_folds_are_disjoint_complete_and_repeatable(spark):
    df = runs(spark)
    for made in (folds.greedy_folds(df, "config_id", 3), folds.hashed_folds(df, "config_id", 3, 7)):
        assert made.count() == 12 and made.select("fold").distinct().count() == 3
        folds.assert_disjoint(df.join(made, "config_id"), "config_id")
    sizes = [r[1] for r in df.join(folds.greedy_folds(df, "config_id", 3), "config_id").groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 5
    assert sorted(folds.hashed_folds(df, "config_id", 3, 7).collect()) == sorted(folds.hashed_folds(df.repartition(5), "config_id", 3, 7).collect())
    with pytest.raises(ValueError):
        folds.greedy_folds(df.where("config_id = 0"), "config_id", 3)
    with pytest.raises(ValueError):
        folds.assert_disjoint(frame(spark, [(1, 0), (1, 1)], "config_id long, fold int"), "config_id")


def test_roles_and_known_groups(spark):
    df = runs(spark)
    counts = {r[0]: r[1] for r in folds.three_roles(df, "config_id", 1).groupBy("role").count().collect()}
    assert counts == {"context": 6, "uncertainty": 3, "calibration": 3}
    known = folds.known_group_folds(df.withColumn("k", F.concat_ws("-", "config_id", "j")), "config_id", 3, 1, "k")
    assert known.count() == 12 == known.select("config_id").distinct().count()


def test_predictions_ignore_their_own_fold(spark):
    df = runs(spark).join(folds.hashed_folds(runs(spark), "config_id", 3, 7), "config_id")
    base = {(r.config_id, r.j): r.prediction for r in diagnostics.out_of_fold_means(df, "y", ["j"]).where("fold = 0").collect()}
    moved = df.withColumn("y", F.when(F.col("fold") == 0, F.col("y") * 100).otherwise(F.col("y")))
    assert base == {(r.config_id, r.j): r.prediction for r in diagnostics.out_of_fold_means(moved, "y", ["j"]).where("fold = 0").collect()}


def test_attribution_is_conserved(spark):
    df = runs(spark).withColumn("p", F.lit(3.0)).withColumn("c", (F.col("config_id") % 3).cast("string"))
    total = df.agg(F.sum(F.abs(F.col("y") - 3))).first()[0]
    out = diagnostics.error_attribution(df, "y", "p", ["c", "j"]).groupBy("column").agg(F.sum("abs_error"), F.sum("share")).collect()
    assert all(math.isclose(r[1], total) and math.isclose(r[2], 1) for r in out)


def test_tails_and_gate(spark):
    df = frame(spark, [(0.1, 0.49), (0.2, 0.5), (0.3, 0.9), (0.4, 0.1)], "y double, p double")
    assert [tuple(r) for r in df.limit(2).select(diagnostics.gated(F.lit(1.0), F.lit(9.0), F.col("p")), diagnostics.gated(F.lit(1.0), F.lit(9.0), F.col("p"), hard=False)).collect()] == [(1.0, 4.92), (9.0, 5.0)]
    three = frame(spark, [(1.0, False), (3.0, False), (100.0, True)], "y double, t boolean")
    assert diagnostics.conservative_tail(three, "y", "t") == 3.0
    labels = frame(spark, [(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)], "s double, y int")
    assert math.isclose(diagnostics.average_precision(labels, "s", "y").first()[0], (1 + 2 / 3) / 2)


def test_contexts(spark):
    df = frame(spark, [(i, "ab"[i % 2], float(i)) for i in range(20)], "k long, c string, x double")
    picked = diagnostics.stratified_context(df, ["c"], 6, 1, "k").groupBy("c").count().collect()
    assert {tuple(r) for r in picked} == {("a", 3), ("b", 3)}
    near = diagnostics.nearest_context(df, df.where("k = 4"), ["x"], ["c"], 2, "k").select("k").collect()
    assert sorted(r.k for r in near) == [4, 6] or sorted(r.k for r in near) == [2, 4]
    assert {r.c for r in diagnostics.coverage_context(df, ["c"], 2, "k").collect()} == {"a", "b"}


def interval_frames(spark, calibration, validation, schema):
    return frame(spark, [(*r, 1) for r in calibration], schema + ", g int"), frame(spark, [(*r, 1) for r in validation], schema + ", g int")


def test_conformal_by_hand(spark):
    c, v = interval_frames(spark, [(1.0, 0.0), (-2.0, 0.0), (3.0, 0.0)], [(0.0, 10.0), (0.0, 20.0)], "r double, p double")
    out = conformal.global_intervals(c, v, "r", "p", 0.5, ["g"]).orderBy("p").collect()
    assert [(r.lower, r.upper) for r in out] == [(8.0, 12.0), (18.0, 22.0)]
    c, v = interval_frames(spark, [(2.0, 0.0, 2.0), (4.0, 0.0, 2.0)], [(0.0, 10.0, 3.0), (0.0, 20.0, 1.0)], "r double, p double, s double")
    assert [r.upper for r in conformal.scaled_intervals(c, v, "r", "p", "s", 0.5, ["g"]).orderBy("p").collect()] == [16.0, 22.0]
    c, v = interval_frames(spark, [(-4.0, -1.0, 1.0), (4.0, -1.0, 1.0)], [(0.0, 10.0, 12.0), (0.0, 14.0, 12.0)], "y double, lo double, hi double")
    assert [(r.lower, r.upper) for r in conformal.quantile_intervals(c, v, "y", "lo", "hi", 0.5, ["g"]).orderBy("lo").collect()] == [(7.0, 15.0), (9.0, 17.0)]


def test_interval_summary(spark):
    df = frame(spark, [(0.0, -1.0, 1.0), (10.0, 1.0, 5.0)], "y double, lower double, upper double")
    row = conformal.summary(df, "y", 0.8).first()
    assert (row.coverage, row.width) == (0.5, 3.0) and math.isclose(row.score, 3 + 10 * 5 / 2)
    many = frame(spark, [("good", 0.0, -1.0, 1.0)] * 20 + [("one", 9.0, -1.0, 1.0)] + [("bad", 9.0, -1.0, 1.0)] * 20, "c string, y double, lower double, upper double")
    assert {(r.value, r.worst) for r in conformal.subgroup_coverage(many, "y", 0.8, ["c"]).collect()} == {("good", False), ("bad", True)}


def test_encoder_fits_on_training_rows(spark):
    train = frame(spark, [(1.0, "a"), (3.0, "a"), (None, "b"), (2.0, None)], "x double, c string")
    encoder = encode.fit(train, ["x"], ["c"])
    assert encoder.names() == ["x", "c=a", "c=b"] and encoder.medians == {"x": 2.0}
    rows = encoder.transform(frame(spark, [(2.0, "new"), (None, None)], "x double, c string")).collect()
    assert [r.features for r in rows] == [[0.0, 0.0, 0.0], [0.0, 1.0, 0.0]]
    wide = encode.fit(spark.range(40).select(F.col("id").cast("string").alias("c")), [], ["c"])
    assert len(wide.names()) == 30 and wide.names()[-1] == "c=infrequent"


def vectors(spark, n=200, p=6, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, p)) @ np.diag(np.arange(1, p + 1)) + 5
    return x, frame(spark, [(i, r.tolist(), int(i % 4)) for i, r in enumerate(x)], "i long, v array<double>, g int").repartition(3)


def test_components_equal_singular_values(spark):
    x, df = vectors(spark)
    basis = pca.fit(df, "v")
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert np.allclose(basis.share, s**2 / (s**2).sum()) and np.allclose(basis.variance, s**2 / (len(x) - 1))
    scores = np.stack([r.scores for r in basis.scores(df, "v").orderBy("i").collect()])
    assert np.allclose(basis.reconstructed(scores), x) and pca.thresholds(basis)[0.5] == int(np.searchsorted(np.cumsum(basis.share), 0.5)) + 1
    flipped = pca.Basis(basis.names, basis.mean, -basis.loadings, basis.variance, basis.share)
    assert all(math.isclose(r[1], 1.0) and r[3] < 1e-5 for r in pca.compare(basis, flipped, 3))
    assert math.isclose(sum(r[2] for r in pca.contributions(basis, list("aabbcc"), 6)), 1.0)
    assert all(low <= high for _, _, low, high in pca.bootstrap(df, "v", "g", 5, 2))


def test_ridge_equals_closed_form(spark):
    x, df = vectors(spark, seed=2)
    y = x[:, 0] * 2 - x[:, 3]
    df = df.withColumn("y", F.col("v")[0] * 2 - F.col("v")[3])
    w, b = embedding.ridge(df, "v", "y", 1.0)
    c = x - x.mean(0)
    expected = np.linalg.solve(c.T @ c + np.eye(6), c.T @ (y - y.mean()))
    assert np.allclose(w, expected) and np.isclose(b, y.mean() - expected @ x.mean(0))


def test_reconstruction_and_categories(spark):
    df = frame(spark, [([1.0, 0.0, 1.0], [0.5, 0.7, 0.2]), ([0.0, 1.0, 0.0], [0.0, 1.0, 0.0])], "a array<double>, b array<double>")
    assert {(r.source, round(r.mae, 3)) for r in embedding.reconstruction(df, "a", "b", ["s", "s", "t"]).collect()} == {("s", 0.3), ("t", 0.4)}
    row = embedding.categorical_accuracy(df, "a", "b", {"s": (0, 2)}).first()
    assert tuple(row) == ("s", 2, 0.5, 1.0)


def test_cluster_agreement_and_silhouette(spark):
    df = frame(spark, [(i, i % 3, (i % 3 + 1) % 3) for i in range(30)], "i long, a int, b int")
    assert all(math.isclose(v, 1.0) for v in embedding.agreement(df, "a", "b").values())
    x = np.array([[0.0], [1.0], [10.0], [11.0]])
    assert math.isclose(embedding.silhouette(x, np.array([0, 0, 1, 1])), np.mean([1 - 1 / 10.5, 1 - 1 / 9.5] * 2))


def test_neighbours_and_stability(spark):
    x, df = vectors(spark, 60)
    got = {(r.key, r.rank): r.neighbour for r in embedding.neighbours(df, "v", "i", 3).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert all(got[(i, k + 1)] == j for i in range(60) for k, j in enumerate(np.argsort(d[i])[:3]))
    skipped = {(r.key, r.rank): r.neighbour for r in embedding.neighbours(df, "v", "i", 2, skip_first=True).collect()}
    assert all(skipped[(i, 1)] == got[(i, 2)] for i in range(60))
    turn = np.linalg.qr(np.random.default_rng(5).normal(size=(6, 6)))[0]
    assert math.isclose(embedding.stability(x, x @ turn)["score"], 1.0, abs_tol=1e-9)


def test_neighbours_of_more_rows_than_a_sample_or_a_cell(spark):
    x = np.random.default_rng(4).integers(0, 9, (2300, 4)).astype(float)  # with ties
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(9000, None)], "i long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    expected = {(i, r + 1, int(j)) for i in range(len(x)) for r, j in enumerate(np.argsort(d[i], kind="stable")[:3])}
    for cell in (1 << 25, 20_000):
        assert {(r.key, r.rank, r.neighbour) for r in embedding.neighbours(df, "v", "i", 3, cell_bytes=cell).collect()} == expected


def test_statistics():
    k2, p = stats.normality(100, 0.2, 3.1)
    assert 0 < p < 1 and k2 > 0
    assert math.isclose(stats.incomplete_beta(2, 3, 0.4), 0.5248, abs_tol=1e-9)
    assert math.isclose(stats.f_tail(1.0, 5, 5), 0.5, abs_tol=1e-9)
    assert math.isclose(stats.normal_quantile(0.975), 1.959963984540054)
    assert stats.adjusted_rand(np.array([[5, 0], [0, 5]])) == 1.0
    gain = np.random.default_rng(0).random((5, 5))
    from itertools import permutations

    assert math.isclose(sum(gain[r, c] for r, c in stats.assignment(gain)), max(sum(gain[i, q[i]] for i in range(5)) for q in permutations(range(5))))
    assert np.allclose(stats.principal_angles(np.eye(3)[:, :2], np.eye(3)[:, 1:]), [0, 90])


@pytest.mark.parametrize("variational", [False, True])
def test_gradients_equal_differences(variational):
    rng = np.random.default_rng(0)
    net = neural.Network(5, 2, variational, rng)
    x, noise = rng.normal(size=(7, 5)), rng.normal(size=(7, 2))
    _, grads = net.gradients(x, x, noise, 0.3)
    for w, g in zip(net.weights, grads):
        at = tuple(rng.integers(0, s) for s in w.shape)
        w[at] += 1e-6
        up = net.gradients(x, x, noise, 0.3)[0]
        w[at] -= 2e-6
        down = net.gradients(x, x, noise, 0.3)[0]
        w[at] += 1e-6
        assert math.isclose((up - down) / 2e-6, g[at], rel_tol=1e-4, abs_tol=1e-7)


def test_networks_have_the_known_sizes_and_repeat():
    sizes = [neural.Network(51, 15, v, np.random.default_rng(0)).parameters for v in (False, True)]
    assert sizes == [11842, 12337]
    x = np.random.default_rng(1).normal(size=(60, 5))
    a, b = (neural.train(x[:40], x[40:], "ae", 2, 3, epochs=3)[1] for _ in range(2))
    assert a == b


def test_beta_selection_refuses_collapse(spark):
    rows = [(0.1, 0, 0.5), (0.1, 2, 0.4), (0.01, 6, 0.3), (0.01, 5, 0.3)]
    df = frame(spark, [(b, a, m) for b, a, m in rows], "beta double, active long, validation_mse double")
    assert {(r.beta, r.selected) for r in neural.select_beta(df).collect()} == {(0.1, False), (0.01, True)}
    assert not any(r.selected for r in neural.select_beta(df.where("beta = 0.1")).collect())


def test_evaluation_keeps_failures_and_resumes(spark):
    df = runs(spark).withColumn("c", (F.col("config_id") % 2).cast("string")).join(folds.hashed_folds(runs(spark), "config_id", 2, 7), "config_id")
    adapters = {"ridge": models.Ridge(), "none": models.Unavailable("not here")}
    saved = []
    rows = models.evaluate(df, adapters, ["j"], ["c"], "y", "config_id", each=saved.append).collect()
    assert len(rows) == 4 == len(saved) and all((r.failure is None) == (r.model == "ridge") for r in rows)
    again = []
    models.evaluate(df, adapters, ["j"], ["c"], "y", "config_id", done=saved, each=again.append)
    assert again == []
    models.evaluate(df, adapters, ["j"], ["c"], "y", "config_id", seed=1, done=saved, each=again.append)
    assert len(again) == 4
