"""Model adapters and their evaluation over grouped folds: the same folds for all, failures kept as text, finished folds not run again."""

from __future__ import annotations

import hashlib
import json
import math
import random
from dataclasses import dataclass
from typing import Protocol

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.kept import checkpointed
from . import diagnostics, encode, ranks
from .folds import assert_disjoint

ROW = "model string, fold bigint, n bigint, r2 double, mae double, failure string, signature string"


class Adapter(Protocol):
    def fit(self, train: DataFrame, target: str, seed: int):
        """A function that adds prediction to a frame with a features vector."""


@dataclass
class Forest:
    trees: int = 150
    depth: int = 10
    least: int = 2

    def fit(self, train: DataFrame, target: str, seed: int):
        from pyspark.ml.regression import RandomForestRegressor

        model = RandomForestRegressor(labelCol=target, featuresCol="_v", numTrees=self.trees, maxDepth=self.depth, minInstancesPerNode=self.least, seed=seed).fit(train)
        return model.transform


@dataclass
class Boosted:
    rounds: int = 100
    depth: int = 6
    rate: float = 0.05

    def fit(self, train: DataFrame, target: str, seed: int):
        from pyspark.ml.regression import GBTRegressor

        return GBTRegressor(labelCol=target, featuresCol="_v", maxIter=self.rounds, maxDepth=self.depth, stepSize=self.rate, seed=seed).fit(train).transform


@dataclass
class Ridge:
    alpha: float = 1.0

    def fit(self, train: DataFrame, target: str, seed: int):
        from .embedding import ridge

        weights, intercept = ridge(train, "_a", target, self.alpha)
        w = F.array(*[F.lit(float(x)) for x in weights])
        return lambda df: df.withColumn("prediction", F.lit(intercept) + F.aggregate(F.zip_with("_a", w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))


@dataclass
class Unavailable:
    """A model that isn't here: its folds are recorded as failures, and nothing takes its place."""

    reason: str

    def fit(self, train: DataFrame, target: str, seed: int):
        raise RuntimeError(self.reason)


def transformed(df: DataFrame, target: str, kind: str = "raw") -> DataFrame:
    """The target as it is or as log1p, of which negative values are an error."""
    if kind == "raw":
        return df
    if df.where(F.col(target) < 0).head(1):
        raise ValueError("log1p needs targets of 0 or more")
    return df.withColumn(target, F.log1p(target))


def restored(column: str, kind: str = "raw"):
    return F.col(column) if kind == "raw" else F.expm1(column)


def _encoded(train: DataFrame, frames: list[DataFrame], numeric: list[str], categories: list[str]) -> list[DataFrame]:
    """frames with feature vectors: medians, flags of missing numbers and levels, all fitted on train alone."""
    prepared = encode.supervised(train, numeric, categories)
    encoder = encode.fit(prepared.transform(train), prepared.numeric(), categories, whole=True)
    return [_vectors(prepared, encoder, f) for f in frames]


def _vectors(prepared: encode.Supervised, encoder: encode.Encoder, df: DataFrame) -> DataFrame:
    return encoder.transform(prepared.transform(df), "_a").withColumn("_v", array_to_vector("_a"))


def fold_signature(model: str, adapter: Adapter, fold: int, features: list[str], target: str, seed: int, train: str, valid: str) -> str:
    """Another model, setting, feature, target, seed or row of either side makes another signature."""
    return hashlib.sha256(json.dumps([model, repr(adapter), fold, features, target, seed, train, valid]).encode()).hexdigest()


def _row_digests(df: DataFrame, columns: list[str], fold: str) -> dict[int, tuple[int, int]]:
    """Of each fold the number of its rows and the sum of their hashes, whatever their order; one aggregate."""
    digest = F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
    return {r[0]: (r[1], int(r[2])) for r in df.groupBy(fold).agg(F.count("*"), digest).collect()}


def evaluate(df: DataFrame, adapters: dict[str, Adapter], numeric: list[str], categories: list[str], target: str, group: str, fold: str = "fold", seed: int = 42, kind: str = "raw", done: list[dict] | None = None, each=None) -> DataFrame:
    """(model, fold, n, r2, mae, failure, signature) for every model and fold; predictions never leave.

    Groups in several folds are an error. done: rows of an earlier run, of which those with the same signature are kept. each
    is called with every new row, so that a runner can save it.
    """
    df = df.where(F.col(target).isNotNull()).cache()
    assert_disjoint(df, group, fold)
    digests = _row_digests(df, [*numeric, *categories, target, group], fold)
    earlier = {(r["model"], r["fold"], r["signature"]): r for r in done or []}
    rows = []
    for k in sorted(digests):
        rest = [v for f, v in digests.items() if f != k]
        signs = (f"{sum(n for n, _ in rest)}/{sum(h for _, h in rest)}", f"{digests[k][0]}/{digests[k][1]}")
        train, valid = (transformed(x, target, kind) for x in (df.where(F.col(fold) != k), df.where(F.col(fold) == k)))
        train, valid = (x.cache() for x in _encoded(train, [train, valid], numeric, categories))
        for name, adapter in adapters.items():
            signature = fold_signature(name, adapter, k, [*numeric, *categories], f"{target}/{kind}", seed, *signs)
            if (name, k, signature) in earlier:
                rows.append(earlier[(name, k, signature)])
                continue
            row = {"model": name, "fold": k, "n": digests[k][0], "r2": None, "mae": None, "failure": None, "signature": signature}
            try:
                predicted = adapter.fit(train, target, seed)(valid)
                back = predicted.select(restored(target, kind).alias("t"), restored("prediction", kind).alias("p"))
                found = diagnostics.fold_metrics(back, "t", "p", []).first()
                row |= {"r2": found["r2"], "mae": found["mae"]}
            except Exception as error:  # a failed model is a result, and other models go on
                row["failure"] = f"{type(error).__name__}: {error}"[:500]
            rows.append(row)
            if each:
                each(row)
        train.unpersist()
        valid.unpersist()
    df.unpersist()
    names = [c.split(" ")[0] for c in ROW.split(", ")]
    return df.sparkSession.createDataFrame([tuple(r[c] for c in names) for r in rows], ROW)


def importance(train: DataFrame, valid: DataFrame, adapter: Adapter, numeric: list[str], categories: list[str], target: str, repeats: int = 3, seed: int = 42) -> DataFrame:
    """(feature, mean, std, repeats): the loss of r2 when one feature's values are exchanged between rows; on all validation rows, all features and repeats in one pass.

    Rows are numbered in the order of a hash, partition by partition, and a trial gives row i the value of row (a i + b) mod n,
    with a and n coprime, so every value goes to one row and no task orders all rows.
    """
    prepared = encode.supervised(train, numeric, categories)
    encoder = encode.fit(prepared.transform(train), prepared.numeric(), categories, whole=True)
    predict = adapter.fit(_vectors(prepared, encoder, train), target, seed)
    features = [*numeric, *categories]
    hashed = valid.select(*features, target).withColumn("_h", F.xxhash64(F.lit(seed), *features, target))
    placed = hashed.repartition("_h").sortWithinPartitions("_h").withColumn("_m", F.monotonically_increasing_id()).cache()
    part = F.shiftright("_m", 33)
    sizes = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")).orderBy("_p").collect()  # a row for each partition
    n, before = 0, []
    for r in sizes:
        before.append((r["_p"], n))
        n += r["_n"]
    offsets = train.sparkSession.createDataFrame(before, "_p bigint, _before bigint")
    rows = placed.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn("_i", F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_h", "_m", "_p", "_before")
    rng, made = random.Random(seed), [("", r, 1, 0) for r in range(repeats)]
    for f in features:
        for r in range(repeats):
            a = rng.randrange(max(n, 2)) | 1
            while math.gcd(a, max(n, 1)) != 1:
                a += 1
            made.append((f, r, a, rng.randrange(max(n, 1))))
    trials = train.sparkSession.createDataFrame(made, "feature string, repeat int, _x bigint, _y bigint")
    asked = rows.crossJoin(F.broadcast(trials)).withColumn("_j", F.pmod(F.col("_i").cast("decimal(20,0)") * F.col("_x") + F.col("_y"), F.lit(max(n, 1)).cast("decimal(20,0)")).cast("bigint"))
    other = rows.select(F.col("_i").alias("_j"), *[F.col(f).alias(f"_o_{f}") for f in features])
    mixed = asked.join(other, "_j").withColumns({f: F.when(F.col("feature") == f, F.col(f"_o_{f}")).otherwise(F.col(f)) for f in features})
    scores = diagnostics.fold_metrics(predict(_vectors(prepared, encoder, mixed)), target, "prediction", ["feature", "repeat"])
    base = scores.where("feature = ''").select("repeat", F.col("r2").alias("_base"))
    return scores.where("feature <> ''").join(base, "repeat").groupBy("feature").agg(F.avg(F.col("_base") - F.col("r2")).alias("mean"), F.stddev_pop(F.col("_base") - F.col("r2")).alias("std"), F.count("*").alias("repeats"))


def importance_summary(folds: DataFrame) -> DataFrame:
    """(feature, mean, std, folds) of rows (feature, fold, mean): over folds, with the sample deviation, 0 of one fold."""
    return folds.groupBy("feature").agg(F.avg("mean").alias("mean"), F.coalesce(F.stddev_samp("mean"), F.lit(0.0)).alias("std"), F.count_distinct("fold").alias("folds"))


def _gates(train: DataFrame, valid: DataFrame, seed: int, rounds: int) -> DataFrame:
    """valid with _boosted and _logistic, the probabilities of the tail by two classifiers; where training rows have one class, it is certain."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.functions import vector_to_array

    n, tails = train.agg(F.count("*"), F.sum("_tail")).first()
    if not tails or tails == n:
        return valid.withColumns({c: F.lit(float(bool(tails))) for c in ("_boosted", "_logistic")})
    weighted = train.withColumn("_w", F.when(F.col("_tail") == 1, n / (2 * tails)).otherwise(n / (2 * (n - tails))))
    fitted = {"_boosted": GBTClassifier(labelCol="_tail", featuresCol="_v", maxIter=rounds, maxDepth=5, stepSize=0.05, seed=seed).fit(train), "_logistic": LogisticRegression(labelCol="_tail", featuresCol="_v", weightCol="_w", maxIter=100).fit(weighted)}
    for name, model in fitted.items():
        valid = model.transform(valid).drop("prediction", "rawPrediction").withColumn(name, vector_to_array("probability")[1]).drop("probability")
    return valid


#: Of each candidate its gate, whether that is hard, and what predicts tails: the main model, a boosted one, or a median.
CANDIDATES = {"single": None, "hard_boosted_tail_main": ("_boosted", True, "_main"), "hard_boosted_tail_boosted": ("_boosted", True, "_trees"), "hard_boosted_tail_median": ("_boosted", True, "_median"), "weighted_boosted_tail_boosted": ("_boosted", False, "_trees"), "hard_logistic_tail_boosted": ("_logistic", True, "_trees")}


def two_stage(train: DataFrame, valid: DataFrame, numeric: list[str], categories: list[str], target: str, method: str = "p95", least: int = 64, seed: int = 42, main: Adapter | None = None, trees: Adapter | None = None, gate_rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """Tables of six candidates and of two classifiers: one model for all, and tail classifiers with models for either side.

    Candidates: (candidate, n, r2, mae, ordinary_mae, tail_mae, large, worst_decile_mae); large errors exceed 1.5 interquartile
    ranges of the target. Classifiers: (classifier, n, tails, precision, recall, average_precision, tn, fp, fn, tp). The
    threshold and all models are of training rows; with fewer than `least` tail rows, the median stands for tail models.
    """
    main, trees = main or Ridge(), trees or Boosted(rounds=20, depth=5)
    limit = diagnostics.tail_threshold(train, target, method).first()["threshold"]
    mark = lambda df: df.withColumn("_tail", (F.col(target) > limit).cast("double"))
    train, valid = (mark(x).cache() for x in _encoded(train, [train, valid], numeric, categories))
    tails = train.where("_tail = 1")
    enough = tails.limit(least).count() >= least
    middle = diagnostics.conservative_tail(train.withColumn("_t", F.col("_tail") == 1), target, "_t", least)
    whole = ranks.quantiles(train, [target], [0.5])[target][0]
    out = _gates(train, valid, seed, gate_rounds)
    out = main.fit(train, target, seed)(out).withColumnRenamed("prediction", "_one")
    out = main.fit(train.where("_tail = 0"), target, seed)(out).withColumnRenamed("prediction", "_low")
    for name, adapter in (("_main", main), ("_trees", trees)):
        out = adapter.fit(tails, target, seed)(out).withColumnRenamed("prediction", name) if enough else out.withColumn(name, F.lit(float(middle)))
    out = out.withColumn("_median", F.lit(float(whole)))
    made = {n: F.col("_one") if how is None else diagnostics.gated(F.col("_low"), F.col(how[2]), F.col(how[0]), hard=how[1]) for n, how in CANDIDATES.items()}
    out = checkpointed(out.select(target, "_tail", "_one", "_low", "_main", "_trees", "_median", "_boosted", "_logistic"))  # read by every score
    train.unpersist()
    valid.unpersist()
    long = out.select(F.col(target).alias("t"), "_tail", F.inline(F.array(*[F.struct(F.lit(n).alias("candidate"), c.alias("p")) for n, c in made.items()])))
    gates = out.select("_tail", F.inline(F.array(*[F.struct(F.lit(c[1:]).alias("classifier"), F.col(c).alias("p")) for c in ("_boosted", "_logistic")])))
    return diagnostics.candidate_scores(long), diagnostics.classifier_scores(gates)
