"""Small autoencoders and variational autoencoders in NumPy, one task for each run.

p - 64 - 32 - k - 32 - 64 - p with rectifiers, Adam and early stopping. Runs are independent, so Spark fans them out; a run's
training rows are a hashed sample of bounded size, as they are in one worker's memory. Its diagnostics are of all its
validation rows, by sums that each batch of rows adds to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .ranks import ACCURACY, REACH

HIDDEN = (64, 32)
ACTIVE = 0.01
RESULT = "method string, k bigint, seed bigint, fold bigint, beta double, parameters bigint, best_epoch bigint, train_mse double, validation_mse double, validation_mae double, kl double, active bigint, sensitivity double"


@dataclass
class Network:
    """weights: encoder layers, mean head, log-variance head of a variational one, decoder layers, each (matrix, bias)."""

    p: int
    k: int
    variational: bool
    rng: np.random.Generator
    weights: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        a, b = HIDDEN
        sizes = [(self.p, a), (a, b), (b, self.k)] + [(b, self.k)] * self.variational + [(self.k, b), (b, a), (a, self.p)]
        for i, o in sizes:
            self.weights += [self.rng.uniform(-1, 1, (i, o)) / np.sqrt(i), self.rng.uniform(-1, 1, o) / np.sqrt(i)]

    @property
    def parameters(self) -> int:
        return sum(w.size for w in self.weights)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        w = self.weights
        h = np.maximum(np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3], 0)
        return h @ w[4] + w[5], np.clip(h @ w[6] + w[7], -10, 10) if self.variational else None

    def decode(self, z: np.ndarray) -> np.ndarray:
        w = self.weights[-6:]
        return np.maximum(np.maximum(z @ w[0] + w[1], 0) @ w[2] + w[3], 0) @ w[4] + w[5]

    def gradients(self, x: np.ndarray, target: np.ndarray, noise: np.ndarray | None, beta: float) -> tuple[float, list[np.ndarray]]:
        """Mean squared error, and beta times the divergence for a variational network, with the gradient of each weight."""
        w, n = self.weights, len(x)
        a1 = x @ w[0] + w[1]
        h1 = np.maximum(a1, 0)
        a2 = h1 @ w[2] + w[3]
        h2 = np.maximum(a2, 0)
        mean = h2 @ w[4] + w[5]
        loss, log_var = 0.0, None
        if self.variational:
            raw = h2 @ w[6] + w[7]
            log_var = np.clip(raw, -10, 10)
            z = mean + np.exp(log_var / 2) * noise
            loss += beta * float(-0.5 * (1 + log_var - mean**2 - np.exp(log_var)).sum() / n)
        else:
            z = mean
        d = w[-6:]
        b1 = z @ d[0] + d[1]
        g1 = np.maximum(b1, 0)
        b2 = g1 @ d[2] + d[3]
        g2 = np.maximum(b2, 0)
        out = g2 @ d[4] + d[5]
        loss += float(((out - target) ** 2).mean())
        e = 2 * (out - target) / out.size
        up: list[np.ndarray] = [g2.T @ e, e.sum(0)]
        e = e @ d[4].T * (b2 > 0)
        up = [g1.T @ e, e.sum(0), *up]
        e = e @ d[2].T * (b1 > 0)
        up = [z.T @ e, e.sum(0), *up]
        e = e @ d[0].T
        heads = [(4, e + beta * mean / n if self.variational else e)]
        if self.variational:
            ev = e * noise * np.exp(log_var / 2) / 2 + beta * 0.5 * (np.exp(log_var) - 1) / n
            heads.append((6, ev * ((raw > -10) & (raw < 10))))
        down, back = [], 0.0
        for at, g in heads:
            down += [h2.T @ g, g.sum(0)]
            back = back + g @ w[at].T
        back = back * (a2 > 0)
        first = [h1.T @ back, back.sum(0)]
        back = back @ w[2].T * (a1 > 0)
        return loss, [x.T @ back, back.sum(0), *first, *down, *up]


def train(x: np.ndarray, valid: np.ndarray, method: str, k: int, seed: int, beta: float = 0.001, epochs: int = 60, batch: int = 256, rate: float = 1e-3, patience: int = 10, corruption: float = 0.0, warm_up: int = 0) -> tuple[Network, dict]:
    """The network of the epoch with the least validation error, with its diagnostics. corruption: the share of inputs set to 0 while training. warm_up: epochs over which beta rises."""
    rng = np.random.default_rng(seed)
    net = Network(x.shape[1], k, method == "vae", rng)
    m, v = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    best, best_weights, best_epoch, step = np.inf, [w.copy() for w in net.weights], 0, 0
    for epoch in range(1, epochs + 1):
        now = beta * min(1.0, epoch / warm_up) if warm_up else beta
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = x[order[at : at + batch]]
            seen = rows * (rng.random(rows.shape) >= corruption) if corruption else rows
            _, grads = net.gradients(seen, rows, rng.normal(size=(len(rows), k)), now)
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                net.weights[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        error = float(((net.decode(net.encode(valid)[0]) - valid) ** 2).mean()) if len(valid) else 0.0
        if error < best - 1e-9:
            best, best_weights, best_epoch = error, [w.copy() for w in net.weights], epoch
        elif epoch - best_epoch >= patience:
            break
    net.weights = best_weights
    return net, diagnostics(net, x, valid) | {"best_epoch": best_epoch}


def diagnostics(net: Network, x: np.ndarray, valid: np.ndarray) -> dict:
    """Errors; divergence and active dimensions (above ACTIVE) of a variational network, else dimensions with variance; the mean change of the output when a latent rises by 1."""
    mean, log_var = net.encode(valid)
    rebuilt = net.decode(mean)
    kl = (-0.5 * (1 + log_var - mean**2 - np.exp(log_var))).mean(0) if log_var is not None else None
    active = int((kl > ACTIVE).sum()) if kl is not None else int((mean.var(0) > ACTIVE).sum())
    shift = [float(np.abs(net.decode(mean + np.eye(net.k)[i]) - rebuilt).mean()) for i in range(net.k)]
    return {"train_mse": float(((net.decode(net.encode(x)[0]) - x) ** 2).mean()), "validation_mse": float(((rebuilt - valid) ** 2).mean()), "validation_mae": float(np.abs(rebuilt - valid).mean()), "kl": float(kl.sum()) if kl is not None else 0.0, "active": active, "sensitivity": float(np.mean(shift))}


def traversal(net: Network, sources: list[str]) -> list[tuple[int, str, float]]:
    """(dimension, source, change): the absolute change of each source's outputs as one latent goes from -1 to 1."""
    out = []
    for i in range(net.k):
        ends = net.decode(np.stack([-np.eye(net.k)[i], np.eye(net.k)[i]]))
        change = np.abs(ends[1] - ends[0])
        out += [(i, s, float(change[[j for j, x in enumerate(sources) if x == s]].sum())) for s in dict.fromkeys(sources)]
    return out


class _Sums:
    """What validation rows add to a run's diagnostics: errors, divergence and moments of each dimension, and the output's change as each latent rises by 1."""

    def __init__(self, net: Network, x: np.ndarray):
        mean, log_var = net.encode(x)
        rebuilt = net.decode(mean)
        kl = -0.5 * (1 + log_var - mean**2 - np.exp(log_var)) if log_var is not None else np.zeros_like(mean)
        shift = [np.abs(net.decode(mean + np.eye(net.k)[i]) - rebuilt).sum() for i in range(net.k)]
        self.values = np.concatenate([[((rebuilt - x) ** 2).sum(), np.abs(rebuilt - x).sum()], kl.sum(0), mean.sum(0), (mean**2).sum(0), shift])


def summarised(n: int, p: int, k: int, variational: bool, sums: np.ndarray) -> dict:
    """The diagnostics of n rows out of their sums."""
    kl, first, second, shift = (sums[2 + i * k : 2 + (i + 1) * k] / n for i in range(4))
    active = (kl > ACTIVE) if variational else (second - first**2 > ACTIVE)
    return {"validation_mse": sums[0] / (n * p), "validation_mae": sums[1] / (n * p), "kl": float(kl.sum()), "active": int(active.sum()), "sensitivity": float((shift / p).mean())}


NETWORK = "run int, method string, k bigint, seed bigint, fold bigint, beta double, parameters bigint, best_epoch bigint, train_mse double, weights binary"


def _least(df: DataFrame, most: int) -> DataFrame:
    """df without most of the rows that aren't among the `most` of least _h: a sketch gives a hash below which there are more than these, so beyond them a two-thousandth of the rows is sorted."""
    n = df.count()
    if n <= 4 * most:
        return df
    edge = df.agg(F.percentile_approx("_h", min(1.0, most / n + REACH), ACCURACY)).first()[0]
    near = df.where(F.col("_h") <= edge)
    return near if near.limit(most).count() == most else df


def networks(df: DataFrame, features: str, fold: str, order: list[str], runs: list[dict], epochs: int = 60, most: int = 20_000, **options) -> DataFrame:
    """A row for each run, a dict of method, k, seed, fold and beta, with its weights: trained on all other folds, stopped by its own, in parallel.

    A run has at most `most` rows, those of the least hash of `order`; they are multiplied by the number of runs, one group each.
    """
    import pandas as pd

    some = _least(df.select(features, F.col(fold).alias("_fold"), F.xxhash64(*order).alias("_h")), most).orderBy("_h", F.xxhash64(features)).limit(most)
    table = df.sparkSession.createDataFrame([(i, r["method"], r["k"], r["seed"], r["fold"], float(r.get("beta", 0.0))) for i, r in enumerate(runs)], "run int, method string, k bigint, seed bigint, fold bigint, beta double")
    fields = [c.split(" ")[0] for c in NETWORK.split(", ")]

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_h", kind="stable")
        x = np.stack(pdf[features].to_numpy()).astype(float)
        r = pdf.iloc[0]
        held = (pdf["_fold"] == r["fold"]).to_numpy()
        net, found = train(x[~held], x[held], r["method"], int(r["k"]), int(r["seed"]), float(r["beta"]), epochs, **options)
        return pd.DataFrame([{**{c: r[c] for c in fields[:6]}, "parameters": net.parameters, **found, "weights": np.concatenate([w.ravel() for w in net.weights]).tobytes()}])[fields]

    return some.crossJoin(F.broadcast(table)).groupBy("run").applyInPandas(fitted, NETWORK)


def latents(df: DataFrame, features: str, method: str, k: int, weights: bytes, name: str = "latent") -> DataFrame:
    """df with the mean latent of each row."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = None
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(batch.schema.get_field_index(features)).to_numpy(zero_copy_only=False)).astype(float)
                net = net or restored(x.shape[1], k, method == "vae", weights)
                z = net.encode(x)[0]
                offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))], [*batch.schema.names, name])

    return df.mapInArrow(apply, T.StructType([*df.schema, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def screen(df: DataFrame, features: str, fold: str, order: list[str], runs: list[dict], epochs: int = 60, most: int = 20_000, **options) -> DataFrame:
    """One row of diagnostics for each run of `networks`, of all rows of its fold."""
    import pandas as pd

    spark = df.sparkSession
    nets = networks(df, features, fold, order, runs, epochs, most, **options).cache()
    held = {r["run"]: r for r in nets.select("run", "method", "k", "fold", "weights").collect()}  # a network a run
    shared = spark.sparkContext.broadcast({i: (r["method"] == "vae", int(r["k"]), int(r["fold"]), r["weights"]) for i, r in held.items()})

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Network] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, of = np.stack(batch.column(0).to_numpy(zero_copy_only=False)).astype(float), batch.column(1).to_numpy(zero_copy_only=False)
            for i, (variational, k, own, weights) in shared.value.items():
                rows = x[of == own]
                if len(rows):
                    if i not in made:
                        made[i] = restored(x.shape[1], k, variational, weights)
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([x.shape[1]], pa.int64()), pa.array([_Sums(made[i], rows).values])], ["run", "n", "p", "sums"])

    parts = df.where(F.col(features).isNotNull()).select(features, F.col(fold).cast("bigint")).mapInArrow(judged, "run int, n bigint, p bigint, sums array<double>")
    added = parts.select("run", "n", "p", F.posexplode("sums").alias("i", "x")).groupBy("run", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.max("p").alias("p"))
    line = added.groupBy("run").agg(F.max("n").alias("n"), F.max("p").alias("p"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("sums"))

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        found = summarised(int(r["n"]), int(r["p"]), int(r["k"]), r["method"] == "vae", np.array(r["sums"]))
        return pd.DataFrame([{**r, **found}])[[c.split(" ")[0] for c in RESULT.split(", ")]]

    return nets.drop("weights").join(line, "run").groupBy("run").applyInPandas(told, RESULT)  # a row for each run


def restored(p: int, k: int, variational: bool, weights: bytes) -> Network:
    net, flat, at = Network(p, k, variational, np.random.default_rng(0)), np.frombuffer(weights), 0
    for i, w in enumerate(net.weights):
        net.weights[i] = flat[at : at + w.size].reshape(w.shape)
        at += w.size
    return net


def select_dimension(runs: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Of each method, the least k whose mean error is within the tolerance of the best."""
    means = runs.groupBy("method", "k").agg(F.avg("validation_mse").alias("mse"), F.stddev_pop("validation_mse").alias("spread"))
    near = means.withColumn("_best", F.min("mse").over(Window.partitionBy("method"))).where(F.col("mse") <= F.col("_best") * (1 + tolerance))
    return near.withColumn("_k", F.row_number().over(Window.partitionBy("method").orderBy("k", "spread"))).where("_k = 1").drop("_k", "_best")


def select_beta(runs: DataFrame, least_active: int = 5) -> DataFrame:
    """(beta, active, mse, spread, selected): of the betas with enough active dimensions in every fold, the one with the most, then the least error; none is selected if all collapse."""
    found = runs.groupBy("beta").agg(F.min("active").alias("active"), F.avg("validation_mse").alias("mse"), F.stddev_pop("validation_mse").alias("spread"))
    fit = F.col("active") >= least_active
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(fit.cast("int")), F.desc("active"), "mse", "spread", "beta")
    return found.withColumn("selected", fit & (F.row_number().over(order) == 1))
