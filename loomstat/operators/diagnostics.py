"""Metrics, attribution, residuals and tails of predictions, and the choice of context rows."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import binned, category, corrected_skewness, shuffled
from .ranks import quantile_table, quantiles, ranges, spearman


def fold_metrics(df: DataFrame, target: str, prediction: str, by: list[str]) -> DataFrame:
    """(by..., n, r2, mae): r2 is null without spread."""
    error = F.col(target) - F.col(prediction)
    spread = F.var_pop(target) * F.count(target)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.when(spread > 0, 1 - F.sum(error * error) / spread).alias("r2"), F.avg(F.abs(error)).alias("mae"))


def run_summary(df: DataFrame, metrics: list[str], by: list[str] = (), population: bool = True) -> DataFrame:
    """mean, std, min and max of each metric over runs or folds; one run has a sample deviation of 0."""
    std = (lambda c: F.stddev_pop(c)) if population else (lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0)))
    return df.groupBy(*by).agg(*[e.alias(f"{c}_{n}") for c in metrics for n, e in (("mean", F.avg(c)), ("std", std(c)), ("min", F.min(c)), ("max", F.max(c)))])


def out_of_fold_means(df: DataFrame, target: str, by: list[str], fold: str = "fold", few: bool = True) -> DataFrame:
    """df with prediction: the target's mean over the group's rows in all other folds, or over all their rows where the group has none. One aggregate, no loop over folds.

    few: the means, a row for each group and fold, fit into memory and are broadcast, so that no task gets all rows of a group.
    """
    parts = df.groupBy(*by, fold).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    group, all_ = Window.partitionBy(*by), Window.partitionBy(F.lit(0))
    rest = lambda c: F.sum(c).over(group) - F.col(c)
    parts = parts.withColumn("_gs", rest("_s")).withColumn("_gn", rest("_n"))
    in_fold = Window.partitionBy(fold)
    other = lambda c: F.sum(c).over(all_) - F.sum(c).over(in_fold)
    parts = parts.withColumn("prediction", F.when(F.col("_gn") > 0, F.try_divide("_gs", "_gn")).otherwise(F.try_divide(other("_s"), other("_n"))))
    means = parts.select(*by, fold, "prediction")
    return df.join(F.broadcast(means) if few else means, [*by, fold])


def unseen_levels(df: DataFrame, columns: list[str], fold: str = "fold") -> DataFrame:
    """(column, fold, value, rows): levels of a fold that no other fold has."""
    long = df.select(fold, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), category(F.col(c)).alias("value")) for c in columns])))
    found = long.groupBy("column", "value").agg(F.min(fold).alias(fold), F.max(fold).alias("_last"), F.count("*").alias("rows"))
    return found.where(F.col(fold) == F.col("_last")).select("column", fold, "value", "rows")


def error_attribution(df: DataFrame, target: str, prediction: str, columns: list[str]) -> DataFrame:
    """(column, value, n, abs_error, share, large, under, over): where the absolute error comes from; large is beyond 1.5 interquartile ranges of the target."""
    spread = quantile_table(df, [target], {"low": 0.25, "high": 0.75}).agg(F.max(F.col("high") - F.col("low")).alias("_iqr"))
    error = F.col(target) - F.col(prediction)
    long = df.crossJoin(F.broadcast(spread)).select(error.alias("_e"), "_iqr", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), category(F.col(c)).alias("value")) for c in columns])))
    found = long.groupBy("column", "value").agg(F.count("*").alias("n"), F.sum(F.abs("_e")).alias("abs_error"), F.count_if(F.abs("_e") > 1.5 * F.col("_iqr")).alias("large"), F.count_if(F.col("_e") > 0).alias("under"), F.count_if(F.col("_e") < 0).alias("over"))
    return found.withColumn("share", F.try_divide("abs_error", F.sum("abs_error").over(Window.partitionBy("column"))))


def residual_scale(df: DataFrame, target: str, prediction: str, column: str) -> DataFrame:
    """(level, n, mae, std) of residuals in each level."""
    error = F.col(target) - F.col(prediction)
    return df.groupBy(category(F.col(column)).alias("level")).agg(F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.stddev_pop(error).alias("std"))


def about_medians(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, n, mean, squares) of the distances of values from their group's median. The medians, a row for each group, are broadcast: no task gets all rows of a group."""
    medians = quantile_table(df, [value], {"_m": 0.5}, [group]).drop("column")
    away = F.abs(F.col(value) - F.col("_m"))
    return df.join(F.broadcast(medians), group).groupBy(group).agg(F.count("*").alias("n"), F.avg(away).alias("mean"), F.sum(away * away).alias("squares"))


def residual_summary(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """One row: moments and percentiles of the residuals, and the rank correlation of their size with the prediction."""
    with_error = df.withColumn("_e", F.col(target) - F.col(prediction)).withColumn("_a", F.abs("_e"))
    found = quantile_table(with_error, ["_e"], {"p5": 0.05, "p50": 0.5, "p95": 0.95}).agg(*[F.max(c).alias(c) for c in ("p5", "p50", "p95")])
    moments = with_error.agg(F.count("_e").alias("n"), F.avg("_e").alias("mean"), F.stddev_pop("_e").alias("std"), corrected_skewness(F.col("_e")).alias("skewness")).crossJoin(found)
    return moments.crossJoin(spearman(with_error, "_a", prediction).select(F.col("spearman").alias("scale_spearman")))


def tail_threshold(df: DataFrame, target: str, method: str, by: list[str] = ()) -> DataFrame:
    """(by..., threshold) of training rows: pNN, such as p97.5, or iqr, the third quartile and 1.5 interquartile ranges."""
    shares = {"low": 0.25, "high": 0.75} if method == "iqr" else {"high": float(method[1:]) / 100}
    value = F.col("high") + 1.5 * (F.col("high") - F.col("low")) if method == "iqr" else F.col("high")
    return quantile_table(df, [target], shares, list(by)).select(*by, value.alias("threshold"))


def gated(ordinary: Column, tail: Column, probability: Column, hard: bool = True) -> Column:
    """The tail's prediction from a probability of one half on, or both weighted by it."""
    return F.when(probability >= 0.5, tail).otherwise(ordinary) if hard else probability * tail + (1 - probability) * ordinary


def conservative_tail(df: DataFrame, target: str, is_tail: str, least: int = 64) -> float | None:
    """The median of the tail's training rows, or of all if the tail has fewer than `least`."""
    some = df.select(F.col(target).alias("all"), F.when(F.col(is_tail), F.col(target)).alias("tail"))
    middle = quantiles(some, ["all", "tail"], [0.5])
    return middle["tail"][0] if some.where("tail is not null").limit(least).count() >= least else middle["all"][0]


def average_precision(df: DataFrame, score: str, label: str, by: list[str] = ()) -> DataFrame:
    """(by..., average_precision): the step-wise area under precision and recall, equal scores together."""
    levels = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("bigint")).alias("_hits"), F.count("*").alias("_rows"))
    levels = ranges(levels, score, "_rows")
    down = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("_range"))  # a row for each range
    above = levels.groupBy(*by, "_range").agg(F.sum("_hits").alias("_h"), F.sum("_rows").alias("_r")).select(*by, "_range", (F.sum("_h").over(down) - F.col("_h")).alias("_above_hits"), (F.sum("_r").over(down) - F.col("_r")).alias("_above_rows"))
    within = Window.partitionBy(*by, "_range").orderBy(F.desc(score))
    levels = levels.join(above, [*by, "_range"]).withColumn("_tp", F.col("_above_hits") + F.sum("_hits").over(within)).withColumn("_all", F.col("_above_rows") + F.sum("_rows").over(within))
    return levels.groupBy(*by).agg(F.try_divide(F.sum(F.col("_hits") * F.col("_tp") / F.col("_all")), F.sum("_hits")).alias("average_precision"))


def candidate_scores(long: DataFrame) -> DataFrame:
    """(candidate, n, r2, mae, ordinary_mae, tail_mae, large, worst_decile_mae) of rows (candidate, t, p, _tail): truth, prediction, and whether the truth is in the tail."""
    error = F.abs(F.col("t") - F.col("p"))
    spread = quantile_table(long, ["t"], {"low": 0.25, "high": 0.75}, ["candidate"]).select(F.col("candidate"), (F.col("high") - F.col("low")).alias("_iqr"))
    worst = quantile_table(long.withColumn("_e", error), ["_e"], {"_worst": 0.9}, ["candidate"]).drop("column")
    whole = long.join(F.broadcast(spread.join(worst, "candidate")), "candidate")  # a row for each candidate
    made = {"ordinary_mae": F.avg(F.when(F.col("_tail") == 0, error)), "tail_mae": F.avg(F.when(F.col("_tail") == 1, error)), "large": F.count_if(error > 1.5 * F.col("_iqr")), "worst_decile_mae": F.avg(F.when(error >= F.col("_worst"), error))}
    return fold_metrics(long, "t", "p", ["candidate"]).join(whole.groupBy("candidate").agg(*[c.alias(n) for n, c in made.items()]), "candidate")


def classifier_scores(gates: DataFrame) -> DataFrame:
    """(classifier, n, tails, precision, recall, average_precision, tn, fp, fn, tp) of rows (classifier, p, _tail); a tail is said from a probability of one half on."""
    said, true = F.col("p") >= 0.5, F.col("_tail") == 1
    counts = {"tn": ~said & ~true, "fp": said & ~true, "fn": ~said & true, "tp": said & true}
    found = gates.groupBy("classifier").agg(F.count("*").alias("n"), F.count_if(true).alias("tails"), *[F.count_if(c).alias(n) for n, c in counts.items()])
    found = found.withColumn("precision", F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).withColumn("recall", F.col("tp") / F.greatest("tails", F.lit(1)))
    return found.join(average_precision(gates, "p", "_tail", ["classifier"]), "classifier", "left").select("classifier", "n", "tails", "precision", "recall", "average_precision", "tn", "fp", "fn", "tp")


def threshold_table(train: DataFrame, target: str, fold: str = "fold", methods: tuple[str, ...] = ("p95", "p97.5", "p99", "iqr"), least: int = 64) -> DataFrame:
    """(method, fold, threshold, train_tails, train_share, valid_tails, valid_share, threshold_std, valid_share_std, supported): for each fold, thresholds of the rows of all other folds.

    supported: every fold's training rows have `least` tails. Labels are strict: above the threshold.
    """
    present = train.where(F.col(target).isNotNull())
    folds = [r[0] for r in present.select(fold).distinct().orderBy(fold).collect()]
    others = present.select(target, F.explode(F.filter(F.array(*[F.lit(f) for f in folds]), lambda x: x != F.col(fold))).alias("_of"))  # each row is training row of all folds but its own
    shares = {f"_q{i}": float(m[1:]) / 100 for i, m in enumerate(methods) if m != "iqr"} | ({"_low": 0.25, "_high": 0.75} if "iqr" in methods else {})
    value = {m: F.col(f"_q{i}") if m != "iqr" else F.col("_high") + 1.5 * (F.col("_high") - F.col("_low")) for i, m in enumerate(methods)}
    cuts = quantile_table(others, [target], shares, ["_of"]).select("_of", F.inline(F.array(*[F.struct(F.lit(m).alias("method"), v.alias("threshold")) for m, v in value.items()])))
    marked = present.crossJoin(F.broadcast(cuts))  # a row for each method and fold
    tail, own = F.col(target) > F.col("threshold"), F.col(fold) == F.col("_of")
    share = lambda side: F.avg(F.when(side, tail.cast("double")))
    found = marked.groupBy("method", F.col("_of").alias(fold), "threshold").agg(F.count_if(tail & ~own).alias("train_tails"), share(~own).alias("train_share"), F.count_if(tail & own).alias("valid_tails"), share(own).alias("valid_share"))
    method = Window.partitionBy("method")
    return found.withColumns({"threshold_std": F.stddev_pop("threshold").over(method), "valid_share_std": F.stddev_pop("valid_share").over(method), "supported": F.min("train_tails").over(method) >= least})


def attribution_totals(df: DataFrame, target: str, prediction: str, by: list[str] = ()) -> DataFrame:
    """(by..., rows, abs_error, mean_abs_error, large_limit, large, under, under_error, over, over_error): what error_attribution splits, in all."""
    error = F.col(target) - F.col(prediction)
    spread = quantile_table(df, [target], {"low": 0.25, "high": 0.75}, list(by)).select(*by, (1.5 * (F.col("high") - F.col("low"))).alias("large_limit"))
    met = df.join(F.broadcast(spread), list(by)) if by else df.crossJoin(F.broadcast(spread))  # a row for each group, which are few as in quantile_table
    size = F.abs(error)
    return met.groupBy(*by, "large_limit").agg(F.count("*").alias("rows"), F.sum(size).alias("abs_error"), F.avg(size).alias("mean_abs_error"), F.count_if(size > F.col("large_limit")).alias("large"), F.count_if(error > 0).alias("under"), F.coalesce(F.sum(F.when(error > 0, size)), F.lit(0.0)).alias("under_error"), F.count_if(error < 0).alias("over"), F.coalesce(F.sum(F.when(error < 0, size)), F.lit(0.0)).alias("over_error"))


def fold_levels(df: DataFrame, columns: list[str], fold: str = "fold", rare: int = 2) -> DataFrame:
    """(fold, column, value, train_rows, valid_rows, unseen, rare): of each fold, its levels with the rows that they have in it and in all other folds."""
    long = df.select(fold, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), category(F.col(c)).alias("value")) for c in columns])))
    found = long.groupBy(fold, "column", "value").agg(F.count("*").alias("valid_rows"))
    found = found.withColumn("train_rows", F.sum("valid_rows").over(Window.partitionBy("column", "value")) - F.col("valid_rows"))
    return found.select(fold, "column", "value", "train_rows", "valid_rows", (F.col("train_rows") == 0).alias("unseen"), (F.col("train_rows") <= rare).alias("rare"))


def fold_coverage(df: DataFrame, columns: list[str], fold: str = "fold") -> DataFrame:
    """(fold, column, levels, unseen, rare, coverage): coverage is the share of a fold's rows whose level other folds have too."""
    seen = F.sum(F.when(~F.col("unseen"), F.col("valid_rows")).otherwise(0))
    return fold_levels(df, columns, fold).groupBy(fold, "column").agg(F.count("*").alias("levels"), F.count_if("unseen").alias("unseen"), F.count_if("rare").alias("rare"), (seen / F.sum("valid_rows")).alias("coverage"))


def fold_targets(df: DataFrame, target: str, fold: str = "fold") -> DataFrame:
    """(fold, part, n, mean, std, min, p5, p25, p50, p75, p95, max): the target among a fold's rows, and among those of all other folds."""
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    of = F.explode(F.array(*[F.lit(f) for f in folds]))
    parts = df.where(F.col(target).isNotNull()).select(target, F.col(fold).alias("_own"), of.alias(fold)).withColumn("part", F.when(F.col(fold) == F.col("_own"), "validation").otherwise("training"))
    found = parts.groupBy(fold, "part").agg(F.count("*").alias("n"), F.avg(target).alias("mean"), F.stddev_pop(target).alias("std"), F.min(target).alias("min"), F.max(target).alias("max"))
    return found.join(quantile_table(parts, [target], {f"p{p}": p / 100 for p in (5, 25, 50, 75, 95)}, [fold, "part"]).drop("column"), [fold, "part"])


def residual_rates(df: DataFrame, target: str, prediction: str, levels: tuple[float, ...] = (0.5, 0.8, 0.95), bins: int | None = None) -> DataFrame:
    """One row: rates of under- and overprediction, what shares of residuals normal and empirical intervals of each level hold, and how many peaks a histogram has."""
    with_error = df.select((F.col(target) - F.col(prediction)).alias("_e")).where("_e is not null").withColumn("_a", F.abs("_e"))
    cuts = quantile_table(with_error, ["_a"], {f"_q{i}": v for i, v in enumerate(levels)}).drop("column")
    shape = with_error.agg(F.count("*").alias("n"), F.stddev_pop("_e").alias("_s"), F.min("_e").alias("_low"), F.max("_e").alias("_high"))
    met = with_error.crossJoin(F.broadcast(cuts.crossJoin(shape)))  # one row
    held = [F.avg((F.col("_a") <= NormalDist().inv_cdf((1 + v) / 2) * F.col("_s")).cast("double")).alias(f"normal_{round(100 * v)}") for v in levels]
    held += [F.avg((F.col("_a") <= F.col(f"_q{i}")).cast("double")).alias(f"empirical_{round(100 * v)}") for i, v in enumerate(levels)]
    rates = met.agg(F.max("n").alias("n"), F.avg((F.col("_e") > 0).cast("double")).alias("under_rate"), F.avg((F.col("_e") < 0).cast("double")).alias("over_rate"), *held)
    size = F.lit(bins) if bins else F.least(F.lit(20), F.greatest(F.lit(5), F.floor(F.sqrt("n")))).cast("int")
    width = F.nullif((F.col("_high") - F.col("_low")) / size, F.lit(0.0))
    at = F.coalesce(F.least(F.floor((F.col("_e") - F.col("_low")) / width), size - 1), F.lit(0)).cast("int")
    counts = met.groupBy(at.alias("_b"), size.alias("_k")).agg(F.count("*").alias("_c"))  # at most 20 rows
    line = counts.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("_b", "_c"))).alias("_m"))
    heights = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0)))
    inner = F.filter(F.sequence(F.lit(1), F.col("_k") - 2), lambda i: (F.get("_h", i) > F.get("_h", i - 1)) & (F.get("_h", i) > F.get("_h", i + 1)))
    return rates.crossJoin(line.withColumn("_h", heights).select(F.size(inner).cast("bigint").alias("peaks")))


def residual_bins(df: DataFrame, target: str, prediction: str, bins: int = 5) -> DataFrame:
    """(bin, n, mae, std): the residuals' size and deviation in equally filled bins of the target."""
    cuts = quantile_table(df, [target], {f"_q{i}": i / bins for i in range(bins + 1)}).select(F.array_sort(F.array_distinct(F.array(*[f"_q{i}" for i in range(bins + 1)]))).alias("_edges"))
    error = F.col(target) - F.col(prediction)
    met = df.crossJoin(F.broadcast(cuts)).withColumn("bin", binned(F.col(target), F.col("_edges")).cast("bigint"))  # one row
    return met.where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.stddev_pop(error).alias("std"))


def context_summary(context: DataFrame, available: DataFrame, group: str, categories: list[str], workload: list[str], strategy: str, seed: int, key: str) -> DataFrame:
    """One row: strategy, rows available and used, groups, how many levels of each category and workload column the context shows, and the signature of its rows whatever their order."""
    counts = [F.count_distinct(category(F.col(c))).alias(f"{c}_levels") for c in categories] + [F.count_distinct(category(F.floor(F.col(c)))).alias(f"{c}_bins") for c in workload]
    names = F.concat(F.lit(f"{strategy}:{seed}:"), F.concat_ws(",", F.array_sort(F.collect_list(F.col(key).cast("string")))))  # a context is of bounded size
    found = context.agg(F.lit(strategy).alias("strategy"), F.count("*").alias("context_rows"), F.count_distinct(category(F.col(group))).alias("groups"), *counts, F.sha2(names, 256).alias("signature"))
    return found.crossJoin(available.agg(F.count("*").alias("available_rows")))


def stratified_context(df: DataFrame, strata: list[str], most: int, seed: int, key: str) -> DataFrame:
    """`most` rows, taken from the strata in turn."""
    stratum = F.concat_ws("|", *[category(F.col(c)) for c in strata])
    turn = df.withColumn("_s", stratum).withColumn("_h", shuffled(seed, key))
    turn = turn.withColumn("_k", F.row_number().over(Window.partitionBy("_s").orderBy("_h", key)))
    return turn.orderBy("_k", "_s").limit(most).drop("_s", "_h", "_k")


def nearest_context(df: DataFrame, panel: DataFrame, numeric: list[str], categories: list[str], most: int, key: str, panel_rows: int = 64) -> DataFrame:
    """The `most` rows with the least mean distance to a panel of at most panel_rows rows: squared scaled differences and categories that differ."""
    scale = df.agg(*[F.stddev_pop(c).alias(c) for c in numeric]).first()
    small = F.broadcast(panel.orderBy(key).limit(panel_rows).select(*[F.col(c).alias(f"_p_{c}") for c in (*numeric, *categories)]))  # of a fixed number of rows
    terms = [F.pow((F.col(c) - F.col(f"_p_{c}")) / F.lit(scale[c] or 1.0), 2.0) for c in numeric] + [(~F.col(c).eqNullSafe(F.col(f"_p_{c}"))).cast("double") for c in categories]
    met = df.crossJoin(small).groupBy(*df.columns).agg(F.avg(reduce(lambda a, b: a + b, terms)).alias("distance"))
    return met.orderBy("distance", key).limit(most)


def coverage_context(df: DataFrame, columns: list[str], most: int, key: str) -> DataFrame:
    """Rows chosen one by one so that each shows the most category values not shown before; of equally good ones the least key as text.

    A pick is an aggregate over the different combinations of categories; the driver holds the values that picks have shown.
    """
    combos = df.groupBy(*columns).agg(F.min_by(key, F.col(key).cast("string")).alias("_key")).cache()
    shown: dict[str, list] = {c: [] for c in columns}
    chosen: list = []
    while len(chosen) < most:
        fresh = reduce(lambda a, b: a + b, [reduce(lambda a, b: a & b, [~F.col(c).eqNullSafe(F.lit(v)) for v in shown[c]], F.lit(True)).cast("int") for c in columns])
        best = combos.select(F.struct(-fresh, F.col("_key").cast("string")).alias("o"), fresh.alias("n"), "_key", *columns).where("n > 0").agg(F.min_by(F.struct("_key", *columns), "o").alias("best")).first()["best"]
        if best is None:
            break
        chosen.append(best["_key"])
        for c in columns:
            if best[c] not in shown[c]:
                shown[c].append(best[c])
    combos.unpersist()
    rest = most - len(chosen)
    picked = df.where(F.col(key).isin(chosen)) if chosen else df.limit(0)
    return picked.unionByName(df.where(~F.col(key).isin(chosen)).orderBy(key).limit(rest)) if rest > 0 else picked
