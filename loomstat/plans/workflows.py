"""Workflows over whole folders of data, as functions and from the command line. They write aggregates alone."""

from __future__ import annotations

import argparse
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import roles
from ..operators import conformal, diagnostics, encode, folds, models, neural, pca, ranks, units
from ..sources import artifacts, readers
from . import reports, research

LEVELS = (0.5, 0.8, 0.95)


def tree_quantiles(train: DataFrame, frames: list[DataFrame], target: str, levels: tuple[float, float], depth: int = 4, seed: int = 42) -> list[DataFrame]:
    """frames with low and high: the target's quantiles over the training rows of each leaf of a regression tree. Frames have _v, a feature vector."""
    from pyspark.ml.regression import DecisionTreeRegressor

    tree = DecisionTreeRegressor(labelCol=target, featuresCol="_v", leafCol="_leaf", maxDepth=depth, seed=seed).fit(train)
    leaves = ranks.quantile_table(tree.transform(train), [target], {"low": levels[0], "high": levels[1]}, ["_leaf"]).drop("column")
    return [tree.transform(f).drop("prediction").join(F.broadcast(leaves), "_leaf").drop("_leaf") for f in frames]


def uncertainty(df: DataFrame, numeric: list[str], categories: list[str], target: str, group: str, adapter: models.Adapter | None = None, n_folds: int = 3, seed: int = 42, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """(fold, method, level, n, coverage, width, score) of three interval families.

    In each outer fold the training groups have three roles: the point model is fitted on context, the scale and quantile
    models on the residuals of uncertainty rows, and intervals are calibrated on the rest. The point model is called once.
    """
    adapter = adapter or models.Ridge()
    df = df.where(F.col(target).isNotNull())
    assigned = df.join(folds.greedy_folds(df, group, n_folds), group).cache()
    found = []
    for k in sorted(r[0] for r in assigned.select("fold").distinct().collect()):
        inner = assigned.where(F.col("fold") != k)
        roled = inner.join(folds.three_roles(inner, group, seed), group)
        context = roled.where("role = 'context'")
        rest = roled.where("role <> 'context'").unionByName(assigned.where(F.col("fold") == k).withColumn("role", F.lit("validation")))
        encoder = encode.fit(context, numeric, categories)
        from pyspark.ml.functions import array_to_vector

        vector = lambda x, e=encoder: e.transform(x, "_a").withColumn("_v", array_to_vector("_a"))
        predicted = adapter.fit(vector(context), target, seed)(vector(rest)).withColumnRenamed("prediction", "point").withColumn("residual", F.col(target) - F.col("point")).withColumn("_g", F.lit(1)).cache()
        spread = predicted.where("role = 'uncertainty'").withColumn("_log", F.log1p(F.abs("residual")))
        scale = models.Boosted(rounds=10, depth=3).fit(spread, "_log", seed)
        scaled = scale(predicted).withColumn("scale", F.expm1("prediction")).drop("prediction").cache()
        cal, val = (scaled.where(F.col("role") == r) for r in ("calibration", "validation"))
        for level in levels:
            low, high = tree_quantiles(spread, [cal, val], "residual", ((1 - level) / 2, (1 + level) / 2), seed=seed)
            bounds = [x.withColumn("low", F.col("point") + F.col("low")).withColumn("high", F.col("point") + F.col("high")) for x in (low, high)]
            made = {"global": conformal.global_intervals(cal, val, "residual", "point", level, ["_g"]), "scaled": conformal.scaled_intervals(cal, val, "residual", "point", "scale", level, ["_g"]), "quantile": conformal.quantile_intervals(*bounds, target, "low", "high", level, ["_g"])}
            found += [(int(k), float(level), *map(lambda v: v if isinstance(v, (str, int)) else float(v), tuple(r))) for r in conformal.compared(made, target, level).collect()]
        predicted.unpersist()
        scaled.unpersist()
    assigned.unpersist()
    return df.sparkSession.createDataFrame(found, "fold bigint, level double, method string, n bigint, coverage double, width double, score double")


def compare_models(df: DataFrame, target: str, group: str = "config_id", n_folds: int = 3, seed: int = 42, most: int | None = None, out: str | None = None, adapters: dict[str, models.Adapter] | None = None) -> list[dict]:
    """Rows of models x folds on the default features, resumed from and saved to `out` after every fold."""
    numeric, categories = _features(df, target)
    work = df.where(F.col(target).isNotNull())
    if most:
        work = units.sample(work, most, seed, group, *numeric, *categories)
    if len(work.head(4)) < 4:
        raise ValueError("fewer than four rows have the target")
    work = work.join(folds.greedy_folds(work, group, n_folds), group)
    done, save = artifacts.resumable(out, seed) if out else ([], None)
    adapters = adapters or {"forest": models.Forest(), "boosted": models.Boosted(), "ridge": models.Ridge(), "foundation": models.Unavailable("no in-context model is installed")}
    return [r.asDict() for r in models.evaluate(work, adapters, numeric, categories, target, group, seed=seed, done=done, each=save).collect()]


def representation_study(df: DataFrame, numeric: list[str], categories: list[str], group: str, ks: tuple[int, ...] = (2, 5, 10), seeds: tuple[int, ...] = (17, 29, 43), n_folds: int = 3, methods: tuple[str, ...] = ("ae", "vae"), epochs: int = 60, budget: float | None = None, most: int = 20_000) -> DataFrame:
    """The run table of components and networks over dimensions, seeds and folds, encoders fitted on each fold's training rows; the runs of a fold go in parallel, and folds that begin after `budget` seconds are left out."""
    began = time.monotonic()
    assigned = df.join(folds.greedy_folds(df, group, n_folds), group).cache()
    tables = []
    for k in range(n_folds):
        if budget is not None and time.monotonic() - began > budget:
            break
        train, valid = assigned.where(F.col("fold") != k), assigned.where(F.col("fold") == k)
        encoder = encode.fit(train, numeric, categories)
        rows = [(int(r.family), float(r.mse)) for d in ks for r in reports.ablation(train, valid, {str(d): (numeric, categories)}, d).collect()]
        linear = df.sparkSession.createDataFrame([("pca", d, 0, k, 0.0, mse) for d, mse in rows], "method string, k bigint, seed bigint, fold bigint, beta double, validation_mse double")
        settings = [{"method": m, "k": d, "seed": s, "fold": k, "beta": 0.001} for m in methods for d in ks for s in seeds]
        nets = neural.screen(encoder.transform(assigned), "features", "fold", [group, *numeric, *categories], settings, epochs=epochs, most=most)
        tables += [linear, nets.select(linear.columns)]
    assigned.unpersist()
    return reduce(DataFrame.unionByName, tables)


def basis_artifact(old: DataFrame, new: DataFrame, numeric: list[str], categories: list[str], targets: list[str], path: str, expected: dict[str, int] | None = None) -> dict:
    """Components of two snapshots, their comparison, the overlay of targets, and a hash of the basis; counts other than expected are an error."""
    counts = {"old": old.count(), "new": new.count()}
    if expected and counts != expected:
        raise ValueError(f"unexpected numbers of rows: {counts}")
    encoders = [encode.fit(x, numeric, categories) for x in (old, new)]
    bases = [pca.fit(e.transform(x), "features", e.names(), 5) for e, x in zip(encoders, (old, new), strict=True)]
    scored = bases[1].scores(encoders[1].transform(new), "features")
    payload = {
        "counts": counts,
        "explained": pca.explained(bases[1]),
        "thresholds": {str(t): n for t, n in pca.thresholds(bases[1]).items()},
        "comparison": pca.compare(*bases, 5),
        "contributions": pca.contributions(bases[1], encoders[1].sources(), 5),
        "narrative": reports.narrative(bases[1], encoders[1].sources()),
        "overlays": {t: [list(r) for r in reports.overlay(scored, "scores", t).orderBy("component").collect()] for t in targets},
        "basis_sha256": artifacts.signature(names=bases[1].names, loadings=_rounded(bases[1].loadings.tolist(), 6)),
    }
    payload = _rounded(payload)
    artifacts.write(path, payload)
    return payload


def _rounded(value, digits: int = 9):
    """Numbers to so many decimals: sums differ in their last bits by the order in which partitions arrive."""
    if isinstance(value, float):
        return round(value, digits) + 0.0
    if isinstance(value, dict):
        return {k: _rounded(v, digits) for k, v in value.items()}
    return [_rounded(v, digits) for v in value] if isinstance(value, (list, tuple)) else value


def diagnose(df: DataFrame, targets: list[str], group: str = "config_id", kinds: tuple[str, ...] = ("raw", "log1p"), n_folds: int = 3, seed: int = 42, adapters: dict[str, models.Adapter] | None = None, done: list[dict] | None = None, each=None, least: int = 20) -> list[dict]:
    """Rows of targets x kinds x models x folds, with each fold's unseen and rare levels; targets with fewer than `least` rows are skipped, and so are logarithms of negative ones."""
    adapters = adapters or {"ridge": models.Ridge(), "boosted": models.Boosted()}
    out = []
    for target in targets:
        present = df.where(F.col(target).isNotNull())
        if present.limit(least).count() < least:
            out.append({"target": target, "skipped": f"fewer than {least} rows"})
            continue
        numeric, categories = _features(df, target)
        assigned = present.join(folds.greedy_folds(present, group, n_folds), group)
        hard = {(r["fold"], r["column"]): (r["unseen"], r["rare"]) for r in diagnostics.fold_coverage(assigned, categories).collect()} if categories else {}
        for kind in kinds:
            if kind == "log1p" and present.where(F.col(target) < 0).head(1):
                out.append({"target": target, "kind": kind, "skipped": "negative values"})
                continue
            for r in models.evaluate(assigned, adapters, numeric, categories, target, group, seed=seed, kind=kind, done=done, each=each).collect():
                out.append({"target": target, "kind": kind, **r.asDict(), "unseen": sum(u for (f, _), (u, _) in hard.items() if f == r["fold"]), "rare": sum(x for (f, _), (_, x) in hard.items() if f == r["fold"])})
    return out


def tails(df: DataFrame, target: str, group: str = "config_id", method: str = "p95", n_folds: int = 3, seed: int = 42, **options) -> dict:
    """Thresholds by fold and method, and the means over folds of six candidates and two classifiers."""
    present = df.where(F.col(target).isNotNull())
    assigned = present.join(folds.greedy_folds(present, group, n_folds), group).cache()
    numeric, categories = _features(df, target)
    tables: tuple[list[DataFrame], list[DataFrame]] = ([], [])
    for k in range(n_folds):
        for held, found in zip(tables, models.two_stage(assigned.where(F.col("fold") != k), assigned.where(F.col("fold") == k), numeric, categories, target, method, seed=seed, **options), strict=True):
            held.append(found)
    means = [[r.asDict() for r in reduce(DataFrame.unionByName, t).groupBy(name).agg(*[F.avg(c).alias(c) for c in t[0].columns if c != name]).orderBy(name).collect()] for t, name in zip(tables, ("candidate", "classifier"), strict=True)]
    thresholds = [r.asDict() for r in diagnostics.threshold_table(assigned, target).orderBy("method", "fold").collect()]
    assigned.unpersist()
    return {"target": target, "seed": seed, "thresholds": thresholds, "candidates": means[0], "classifiers": means[1]}


def _features(df: DataFrame, target: str) -> tuple[list[str], list[str]]:
    kinds = dict(df.dtypes)
    features = roles.without_leakage(roles.default_features(df, target), target)
    categories = [c for c in features if kinds[c] in ("string", "boolean")]
    return [c for c in features if c not in categories], categories


TASKS = ("status", "compare", "diagnose", "tails", "uncertainty", "screen", "final", "summary")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("task", choices=TASKS)
    parser.add_argument("folder")
    parser.add_argument("--target", action="append")
    parser.add_argument("--folds", type=int, default=3)
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--max-rows", type=int)
    parser.add_argument("--method", choices=["ae", "vae"], default="ae")
    parser.add_argument("--dimension", type=int, action="append")
    parser.add_argument("--epochs", type=int, default=60)
    parser.add_argument("--out", default="result.json")
    o = parser.parse_args(args)
    targets = o.target or ["metrics_p99_itl"]
    if o.task == "summary":
        found = research.research_summary(o.folder, targets[0])
        artifacts.write(o.out, found)
        print(research.summary_text(found))
        return
    spark = SparkSession.builder.appName("workflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if o.task == "status":
        print(artifacts.markdown(readers.sources(o.folder, spark)))
        return
    mode, df = readers.load(spark, o.folder)
    if mode == "missing":
        raise SystemExit("no complete source in the folder")
    if o.task == "compare":
        print(artifacts.markdown(compare_models(df, targets[0], n_folds=o.folds, seed=o.seed, most=o.max_rows, out=o.out)))
        return
    if o.task == "diagnose":
        found = diagnose(df, targets, n_folds=o.folds, seed=o.seed)
        artifacts.write(o.out, {"seed": o.seed, "folds": found})
        print(artifacts.markdown([{k: r.get(k) for k in ("target", "kind", "model", "fold", "r2", "mae", "unseen", "rare", "failure", "skipped")} for r in found]))
        return
    if o.task == "tails":
        found = tails(df, targets[0], n_folds=o.folds, seed=o.seed)
        artifacts.write(o.out, found)
        print(artifacts.markdown(found["candidates"]))
        return
    numeric, categories = _features(df, targets[0])
    if o.task in ("screen", "final"):
        _, rows = research.encoded_folds(df, numeric, categories, "config_id", o.folds)
        order = ["config_id", *numeric, *categories]
        if o.task == "screen":
            runs, chosen = research.screening(rows, "features", order, o.method, tuple(o.dimension or (5, 10, 15)), (o.seed,), o.folds, epochs=o.epochs)
            table = [r.asDict() for r in chosen.collect()]
        else:
            tried = neural.screen(rows, "features", "fold", order, [{"method": "vae", "k": (o.dimension or [15])[0], "seed": o.seed, "fold": f, "beta": b} for b in (0.0001, 0.001, 0.01) for f in range(o.folds)], epochs=o.epochs) if o.method == "vae" else None
            runs = research.final_runs(rows, "features", order, o.method, (o.dimension or [15])[0], n_folds=o.folds, beta_table=None if tried is None else neural.select_beta(tried), epochs=o.epochs)
            table = [r.asDict() for r in research.run_summary(runs).collect()]
        artifacts.write(o.out, research.metadata("representation-1") | {"runs": [r.asDict() for r in runs.collect()], "selected": table})
        print(artifacts.markdown(table))
        return
    table = uncertainty(df, numeric, categories, targets[0], "config_id", n_folds=o.folds, seed=o.seed)
    found = [r.asDict() for r in table.groupBy("method", "level").agg(F.avg("coverage").alias("coverage"), F.avg("width").alias("width"), F.avg("score").alias("score")).orderBy("level", "method").collect()]
    artifacts.write(o.out, {"intervals": found, "decision": artifacts.decision([], [r for r in found if r["level"] == max(LEVELS)], max(LEVELS))})
    print(artifacts.markdown(found))


if __name__ == "__main__":
    main()
