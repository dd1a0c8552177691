"""The representation study from screening to validation, comparisons of artifacts, and the research summary. Aggregates alone leave them."""

from __future__ import annotations

import hashlib
import json
import platform
import subprocess
import time
from collections.abc import Callable
from functools import reduce
from itertools import combinations
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diagnostics, embedding, encode, folds, neural, pca, units
from ..sources import artifacts
from ..sources.kept import checkpointed

METRICS = ["validation_mse", "validation_mae", "kl", "sensitivity"]


def encoded_folds(df: DataFrame, numeric: list[str], categories: list[str], group: str, n_folds: int) -> tuple[encode.Encoder, DataFrame]:
    """The encoder of all rows, and the rows with features and a fold that keeps groups together."""
    assigned = checkpointed(df.join(folds.greedy_folds(df, group, n_folds), group))
    encoder = encode.fit(assigned, numeric, categories)
    return encoder, encoder.transform(assigned)


def split_metadata(assigned: DataFrame, group: str, keys: list[str], fold: str = "fold") -> DataFrame:
    """(fold, rows, groups, overlap, digest): what each fold holds, and a digest of its row ids whatever their order."""
    digest = F.sum(F.xxhash64(*keys).cast("decimal(38,0)")).cast("string")
    leaks = folds.overlap(assigned, group, fold).count()
    return assigned.groupBy(fold).agg(F.count("*").alias("rows"), F.count_distinct(group).alias("groups"), F.lit(leaks).cast("bigint").alias("overlap"), digest.alias("digest"))


def screening(df: DataFrame, features: str, order: list[str], method: str, ks: tuple[int, ...], seeds: tuple[int, ...], n_folds: int, beta: float = 0.001, **options) -> tuple[DataFrame, DataFrame]:
    """The run table over dimensions, seeds and folds, and the selected dimension: the least within one percent of the best error."""
    settings = [{"method": method, "k": k, "seed": s, "fold": f, "beta": beta} for k in ks for s in seeds for f in range(n_folds)]
    runs = neural.screen(df, features, "fold", order, settings, **options)
    return runs, neural.select_dimension(runs)


def selected_beta(table: DataFrame) -> float | None:
    """The beta that a table of select_beta marks, None if all collapse."""
    row = table.where("selected").first()
    return None if row is None else float(row["beta"])


def final_runs(df: DataFrame, features: str, order: list[str], method: str, k: int, seeds: tuple[int, ...] = (17, 29, 43), n_folds: int = 3, beta_table: DataFrame | None = None, **options) -> DataFrame:
    """Runs of every seed and fold at a fixed dimension. A variational network needs a beta that was selected before; without one it isn't run."""
    beta = 0.0
    if method == "vae":
        if beta_table is None or (beta := selected_beta(beta_table)) is None:
            raise ValueError("no beta was selected, so the variational runs don't begin")
    settings = [{"method": method, "k": k, "seed": s, "fold": f, "beta": beta} for s in seeds for f in range(n_folds)]
    return neural.screen(df, features, "fold", order, settings, **options)


def run_summary(runs: DataFrame, by: list[str] = ("method", "k")) -> DataFrame:
    """Means, deviations and ends of the metrics over the runs of each setting, and the least active dimensions."""
    found = diagnostics.run_summary(runs, METRICS, list(by))
    return found.join(runs.groupBy(*by).agg(F.count("*").alias("runs"), F.min("active").alias("least_active")), list(by))


def seed_embeddings(df: DataFrame, features: str, key: str, order: list[str], method: str, k: int, seeds: tuple[int, ...], partitions: dict[int, DataFrame], beta: float = 0.0, sample: int = 500, **options) -> dict[tuple[int, int], np.ndarray]:
    """Latents of the same hashed sample of rows for each partition seed and network seed; stability compares pairs of them."""
    rows = units.sample(df.select(key, features), sample, 7, key).cache()
    out = {}
    for p, assigned in partitions.items():
        nets = neural.networks(assigned, features, "fold", order, [{"method": method, "k": k, "seed": s, "fold": 0, "beta": beta} for s in seeds], **options)
        for r in nets.select("seed", "weights").collect():
            found = neural.latents(rows, features, method, k, r["weights"]).select(key, "latent").orderBy(key).toArrow()  # `sample` rows
            out[(p, r["seed"])] = np.stack(found.column("latent").combine_chunks().to_numpy(zero_copy_only=False))
    rows.unpersist()
    return out


def geometry(embeddings: dict[tuple[int, int], np.ndarray]) -> list[tuple[str, int, int, float]]:
    """(what is fixed, its value, pairs, mean stability): within each partition across seeds, within each seed across partitions, and all together.

    Fixed values with a single embedding have no pairs and no row.
    """
    out = []
    for name, at in (("partition", 0), ("seed", 1)):
        for value in sorted({k[at] for k in embeddings}):
            some = [embeddings[k] for k in sorted(embeddings) if k[at] == value]
            scores = [embedding.stability(a, b)["score"] for a, b in combinations(some, 2)]
            if scores:
                out.append((name, value, len(scores), float(np.mean(scores))))
    return [*out, ("all", -1, sum(r[2] for r in out), float(np.mean([r[3] for r in out])))] if out else []


def clustered(df: DataFrame, vector: str, key: str, k: int, seed: int, name: str) -> DataFrame:
    """(key, name): the cluster of each row."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol=name).fit(points).transform(points).select(key, name)


def cluster_agreement(labels: DataFrame, group: str, methods: list[str]) -> list[tuple[str, str, float, float, float, float, float]]:
    """(left, right, ari, nmi, overlap, group_ari, group_overlap) of each pair of labellings, of rows and of groups' most frequent labels."""
    out = []
    for a, b in combinations(methods, 2):
        rows = embedding.agreement(labels, a, b)
        both = units.majority(labels, [group], a).drop("n").join(units.majority(labels, [group], b).drop("n"), group)
        groups = embedding.agreement(both, a, b)
        out.append((a, b, *(float(v) for v in (rows["ari"], rows["nmi"], rows["overlap"], groups["ari"], groups["overlap"]))))
    return out


def outcomes(df: DataFrame, vector: str, target: str, dimensions: int) -> dict:
    """How a target goes with an embedding: the dimension of the largest correlation, and the R2 of a ridge regression on all."""
    from .reports import overlay

    rows = overlay(df, vector, target, dimensions).collect()
    size = lambda r: max(abs(r["pearson"] or 0.0), abs(r["spearman"] or 0.0))
    best = max(rows, key=lambda r: (size(r), -r["component"]))
    weights, intercept = embedding.ridge(df, vector, target)
    w = F.array(*[F.lit(float(x)) for x in weights])
    predicted = df.withColumn("_p", F.lit(intercept) + F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    return {"strongest": best["component"], "pearson": best["pearson"], "spearman": best["spearman"], "ridge_r2": diagnostics.fold_metrics(predicted.where(F.col(target).isNotNull()), target, "_p", []).first()["r2"]}


def within_budget(stages: list[tuple[str, Callable[[], object]]], budget: float, guarded: list[str] = (), clock: Callable[[], float] = time.monotonic) -> list[dict]:
    """(stage, status, seconds, result) of each stage: done, or skipped if it would begin after the budget. A guarded file that a stage changes is an error."""
    before, began, out = {p: artifacts.fingerprint(p)["sha256"] for p in guarded}, clock(), []
    for name, run in stages:
        start = clock()
        if start - began > budget:
            out.append({"stage": name, "status": "skipped", "seconds": 0.0, "result": None})
            continue
        result = run()
        out.append({"stage": name, "status": "done", "seconds": clock() - start, "result": result})
        if changed := [p for p, h in before.items() if artifacts.fingerprint(p)["sha256"] != h]:
            raise ValueError(f"{name} changed {changed}")
    return out


def augmented(path: str, key: str, value: object) -> dict:
    """The artifact at path with one more part, all other parts as they were; a part that is there already is an error."""
    held = artifacts.read(path)
    if key in held:
        raise ValueError(f"{key} is in the artifact already")
    artifacts.write(path, held | {key: value})
    return artifacts.read(path)


def merged_results(own: dict, other: dict, same: tuple[str, ...] = ("target", "seed", "fingerprint")) -> dict:
    """own with the models of another run, which must have the same target, seed and data; a model in both is an error."""
    if wrong := [k for k in same if own.get(k) != other.get(k)]:
        raise ValueError(f"results that differ in {wrong}")
    if both := sorted(set(own["models"]) & set(other["models"])):
        raise ValueError(f"models in both results: {both}")
    return own | {"models": own["models"] | other["models"]}


#: Of each metric of a comparison, whether less or more is better.
BETTER = {"validation_mse": min, "validation_mae": min, "stability": max, "silhouette": max, "ridge_r2": max, "parameters": min}


def compared_artifacts(parts: dict[str, dict], same: tuple[str, ...] = ("cohort_digest", "dimension", "seeds", "folds")) -> dict:
    """Of artifacts of methods with equal cohorts, dimensions, seeds and folds: a row for each metric with every method's value and the best one, and how often each method is best."""
    names = sorted(parts)
    for k in same:
        if len({json.dumps(parts[n].get(k), sort_keys=True) for n in names}) > 1:
            raise ValueError(f"artifacts that differ in {k} can't be compared")
    rows = []
    for metric, best in BETTER.items():
        values = {n: parts[n]["metrics"].get(metric) for n in names}
        known = {n: v for n, v in values.items() if v is not None}
        rows.append({"metric": metric, **values, "best": best(known, key=lambda n: known[n]) if known else None})
    return {"matrix": rows, "wins": {n: sum(r["best"] == n for r in rows) for n in names}}


def metadata(schema: str, repository: str | None = None) -> dict:
    """Versions of what made an artifact, and the commit if there is one."""
    import pyspark

    commit = subprocess.run(["git", "-C", repository or ".", "rev-parse", "HEAD"], capture_output=True, text=True, check=False).stdout.strip() or None
    return {"schema_version": schema, "python": platform.python_version(), "numpy": np.__version__, "spark": pyspark.__version__, "commit": commit}


def artifact_set(folder: str, files: dict[str, str]) -> tuple[dict[str, dict], dict[str, str]]:
    """The artifacts that can be read, and for each whether it is available, missing or why it isn't to be used."""
    found, status = {}, {}
    for name, file in files.items():
        path = Path(folder) / file
        if not path.exists():
            status[name] = "missing"
            continue
        try:
            found[name] = artifacts.read(str(path))
            status[name] = "available"
        except (OSError, ValueError) as error:  # also what isn't JSON
            status[name] = f"unavailable: {error}"
    return found, status


FILES = {"models": "models.json", "residual_pass": "residuals.json", "uncertainty": "uncertainty.json", "tails": "tails.json"}


def point_metrics(residuals: dict | None, models: dict | None, target: str) -> dict | None:
    """r2, its deviation and mae of the point model: those of the residual pass, which is the last one, or else of the model comparison."""
    last = (residuals or {}).get("metrics", {})
    if {"r2_mean", "r2_std", "mae_mean"} <= last.keys():
        return {"r2": last["r2_mean"], "r2_std": last["r2_std"], "mae": last["mae_mean"]}
    held = (models or {}).get("targets", {}).get(target, {})
    return held if {"r2", "r2_std", "mae"} <= held.keys() else None


def research_summary(folder: str, target: str, files: dict[str, str] | None = None, least: int = 20) -> dict:
    """The decision that the artifacts of a folder carry: point model, interval method by level, residual evidence, tail candidates, and each artifact's status."""
    held, status = artifact_set(folder, files or FILES)
    intervals = held.get("uncertainty", {}).get("intervals", [])
    chosen = {}
    for level in sorted({r["level"] for r in intervals}):
        best = artifacts.decision([], [r for r in intervals if r["level"] == level], level)
        row = next(r for r in intervals if r["level"] == level and r["method"] == best["interval"])
        groups = [g for g in row.get("groups", []) if g["n"] >= least]
        worst = min(groups, key=lambda g: (g["coverage"], g["value"]), default=None)
        chosen[str(level)] = {k: row[k] for k in ("method", "coverage", "width", "score")} | {"covers": best["covered"], "small_groups": len(row.get("groups", [])) - len(groups), "worst_group": worst}
    tails = held.get("tails", {}).get("candidates", [])
    single = next((r for r in tails if r["candidate"] == "single"), None)
    better = [r["candidate"] for r in tails if single and r is not single and r["mae"] < single["mae"] and r["tail_mae"] < single["tail_mae"]]
    return {"schema_version": 1, "target": target, "status": status, "point": point_metrics(held.get("residual_pass"), held.get("models"), target), "intervals": chosen, "evidence": held.get("residual_pass", {}).get("evidence", {}), "tails": {"better_than_single": better, "candidates": len(tails)}}


def summary_text(summary: dict) -> str:
    """The summary as Markdown; what is missing is named as missing."""
    point = summary["point"]
    lines = ["# Summary", "", f"Target: `{summary['target']}`.", ""]
    lines.append(f"Point model: R2 {point['r2']:.6f} +/- {point['r2_std']:.6f}, mean absolute error {point['mae']:.6f}." if point else "Point model: no artifact has its metrics.")
    for level, r in summary["intervals"].items():
        lines.append(f"Level {level}: {r['method']}, coverage {r['coverage']:.4f}, width {r['width']:.4f}{'' if r['covers'] else ', below the level'}.")
    lines.append("Tail candidates better than one model for all: " + (", ".join(summary["tails"]["better_than_single"]) or "none") + ".")
    return "\n".join([*lines, "", "## Artifacts", "", *[f"- {name}: {state}" for name, state in sorted(summary["status"].items())]]) + "\n"


def target_report(df: DataFrame, basis: pca.Basis, sources: list[str], importances: list[tuple[str, float]], target: str, most: int = 5) -> str:
    """Markdown: which features tell the target, which shape the components, and which do both."""
    structure = [s for s, _, _ in pca.contributions(basis, sources, min(5, basis.loadings.shape[1]))[:most]]
    told = [f for f, _ in sorted(importances, key=lambda r: (-r[1], r[0]))[:most]]
    rows = [{"feature": f, "importance": v, "structure": f in structure} for f, v in sorted(importances, key=lambda r: (-r[1], r[0]))[:most]]
    both = [f for f in told if f in structure]
    return f"# {target}\n\nRows with the target: {df.where(F.col(target).isNotNull()).count():,}.\n\n{artifacts.markdown(rows)}\n\nAlso among the first {most} of structure: {', '.join(both) or 'none'}.\n"


def stable_hash(value: object) -> str:
    return hashlib.sha256(artifacts.canonical(value).encode()).hexdigest()


def component_agreement(df: DataFrame, features: str, key: str, group: str, settings: dict[str, tuple[int, int]], seed: int = 42) -> DataFrame:
    """Agreement of clusterings of components: settings names (components, clusters) for each labelling."""
    parts = []
    for name, (k, clusters) in settings.items():
        scored = pca.fit(df, features, components=k).scores(df.select(key, features), features)
        parts.append(clustered(scored, "scores", key, clusters, seed, name))
    labels = reduce(lambda a, b: a.join(b, key), parts).join(df.select(key, group), key).cache()
    rows = cluster_agreement(labels, group, list(settings))
    labels.unpersist()
    return df.sparkSession.createDataFrame(rows, "left string, right string, ari double, nmi double, overlap double, group_ari double, group_overlap double")
