"""Roles of columns by name and type: metrics, metadata, configuration; default features; leakage guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import category, flag, number

METRIC_PREFIX, CONFIG_PREFIX = "metrics_", "config_"
METRIC_TERMS = tuple(sorted(("energy", "e2el", "intvty", "itl", "joules", "latency", "power", "throughput", "tpot", "tput", "ttft", "util")))
METADATA_TERMS = tuple(sorted(("commit", "created", "date", "error", "id", "image", "log", "path", "raw", "run", "time", "updated", "url")))
WORKLOAD = ("benchmark_type", "isl", "osl", "conc")
FAMILIES = ("tput", "ttft", "tpot", "itl", "e2el", "intvty", "joules", "power")
STATISTICS = ("median", "mean", "p99", "p95", "p90", "std")
MOST_LEVELS = 80
MOST_NUMERIC = 12


def is_config(name: str) -> bool:
    return name.startswith(CONFIG_PREFIX) and name != "config_id"


def is_metric(name: str) -> bool:
    """By prefix, or by a term anywhere in the name of what is no configuration."""
    low = name.lower()
    return low.startswith(METRIC_PREFIX) or (not low.startswith(CONFIG_PREFIX) and any(t in low for t in METRIC_TERMS))


def is_metadata(name: str) -> bool:
    low = name.lower()
    return not is_metric(name) and not is_config(name) and name not in WORKLOAD and any(t in low for t in METADATA_TERMS)


def metric_order(name: str) -> tuple[int, int, str]:
    """Sort key: family, statistic, name."""
    low = name.lower()
    rank = lambda terms: next((i for i, t in enumerate(terms) if t in low), len(terms))
    return rank(FAMILIES), rank(STATISTICS), low


def feature_family(name: str) -> str:
    low = name.lower()
    if name in WORKLOAD:
        return "workload"
    if any(t in low for t in ("_tp", "_ep", "gpu", "worker", "disagg", "multinode", "dp_attention")):
        return "topology"
    return "metric" if is_metric(name) else "stack" if is_config(name) else "metadata" if is_metadata(name) else "other"


#: By terms in a metric's name, the first that fits: kind, direction and use.
METRIC_KINDS = (
    (("e2el", "itl", "latency", "tpot", "ttft"), ("latency", "lower_is_better", "target")),
    (("interactivity", "intvty", "qps", "rps", "throughput", "tput"), ("throughput", "higher_is_better", "target")),
    (("energy", "joules"), ("energy", "lower_is_better", "target")),
    (("power",), ("power", "diagnostic", "diagnostic or cost input")),
    (("util",), ("utilization", "diagnostic", "diagnostic")),
    (("mem",), ("memory", "diagnostic", "diagnostic")),
    (("temp",), ("temperature", "diagnostic", "diagnostic")),
    (("score",), ("score", "unknown", "overlay")),
)
#: What a term in a metric's name says.
MEANINGS = (("ttft", "time until the first token"), ("tpot", "time for each output token"), ("itl", "time between tokens"), ("e2el", "time of a whole request"), ("intvty", "interactivity"), ("tput", "tokens a second"), ("power", "electrical power"), ("joules", "energy for each token"), ("energy", "measured energy"), ("latency", "waiting time"), ("temp", "temperature"), ("util", "utilization"), ("mem", "memory in use"))
NAMED = {"benchmark_type": "kind of workload", "isl": "input tokens of a request", "osl": "output tokens of a request", "conc": "requests at once", "config_id": "key of the configuration", "benchmark_id": "key of the run", "date": "when the run was made", "error": "why a run failed", "run_id": "key of the run"}


def metric_kind(name: str) -> tuple[str, str, str]:
    """Kind, direction and recommended use of a metric, by its name."""
    low = name.lower()
    return next((found for terms, found in METRIC_KINDS if any(t in low for t in terms)), ("metric", "unknown", "overlay"))


def meaning(name: str) -> str:
    low = name.lower()
    if name in NAMED:
        return NAMED[name]
    if is_metric(name):
        return next((text for term, text in MEANINGS if term in low), "a measured result")
    return f"setting {name.removeprefix(CONFIG_PREFIX)} of the configuration" if is_config(name) else "a field of the joined tables"


def source_table(name: str) -> str:
    return "configurations" if name.startswith(CONFIG_PREFIX) else "metrics" if name.startswith(METRIC_PREFIX) else "runs"


def role(name: str) -> str:
    return "outcome" if is_metric(name) else "workload" if name in WORKLOAD else "provenance" if is_metadata(name) or name in ("error", "image") else "input" if is_config(name) else "metadata"


def fixed_use(name: str) -> str | None:
    """What a column is for whatever its values, None if that depends on how many there are."""
    if is_metadata(name) or name in ("error", "image"):
        return "exclude"
    return "target or overlay" if is_metric(name) else None


def varying_use(name: str) -> str:
    return "input" if is_config(name) or name in WORKLOAD else "overlay"


def without_overlap(numeric: list[str], categories: list[str]) -> tuple[list[str], list[str]]:
    """Both lists without repeats, in their order; a column in both is numeric."""
    numbers = list(dict.fromkeys(numeric))
    return numbers, [c for c in dict.fromkeys(categories) if c not in numbers]


def in_families(columns: list[str], families: set[str]) -> list[str]:
    """The columns that are in any of the chosen families; all if none is chosen."""
    return [c for c in columns if not families or feature_family(c) in families]


def label(name: str) -> str:
    """A name to read: without prefix, with spaces."""
    return name.removeprefix(CONFIG_PREFIX).removeprefix(METRIC_PREFIX).replace("_", " ").strip()


def cardinalities(df: DataFrame, most: int = MOST_LEVELS) -> dict[str, tuple[int, int]]:
    """(non-null values, different values) of each column: estimates, and for columns whose estimate is up to twice `most` exact counts, which hold few values."""
    flat = [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    if not flat:
        return {}
    row = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(flat)], *[F.approx_count_distinct(c, 0.01).alias(f"d{i}") for i, c in enumerate(flat)]).first()
    few = [i for i in range(len(flat)) if row[f"d{i}"] <= 2 * most]
    exact = df.agg(*[F.size(F.collect_set(flat[i])).alias(f"e{i}") for i in few]).first() if few else {}
    return {c: (row[f"n{i}"], exact[f"e{i}"] if i in few else row[f"d{i}"]) for i, c in enumerate(flat)}


def numeric_columns(df: DataFrame, known: dict[str, tuple[int, int]] | None = None) -> list[str]:
    """Numeric columns of two values or more."""
    known = known or cardinalities(df)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and known[f.name][0] >= 2]


def categorical_columns(df: DataFrame, known: dict[str, tuple[int, int]] | None = None, most: int = MOST_LEVELS) -> list[str]:
    """Text and boolean columns of 2 to `most` levels."""
    known = known or cardinalities(df)
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType)) and 1 < known[f.name][1] <= most]


def default_features(df: DataFrame, target: str | None = None) -> list[str]:
    """Configuration and workload categories, then the first MOST_NUMERIC configuration or workload numbers; never a metric or the target."""
    known = cardinalities(df)
    wanted = lambda c: c != target and not is_metric(c) and (is_config(c) or c in WORKLOAD)
    categories = [c for c in categorical_columns(df, known) if wanted(c)]
    return list(dict.fromkeys(categories + [c for c in numeric_columns(df, known) if wanted(c)][:MOST_NUMERIC]))


def without_leakage(features: list[str], target: str) -> list[str]:
    """The features, or an error if they hold the target, a metric, an identifier or nothing."""
    wrong = [c for c in features if c == target or is_metric(c) or c == "config_id" or is_metadata(c)]
    if wrong or not features:
        raise ValueError(f"not allowed as features: {wrong}" if wrong else "no features")
    return features


def cohort(df: DataFrame, required: list[str], column: str, value) -> DataFrame:
    """The rows of one kind of workload; a required column that isn't there is an error."""
    if missing := [c for c in (*required, column) if c not in df.columns]:
        raise ValueError(f"columns that the cohort lacks: {missing}")
    return df.where(F.col(column) == F.lit(value))


def normalised_inputs(df: DataFrame, numeric: list[str], flags: list[str], categories: list[str]) -> DataFrame:
    """Numbers as finite doubles, flags as 0 and 1, categories as trimmed text with a level for null; other columns stay."""
    made = {c: number(F.col(c)) for c in numeric} | {c: flag(F.col(c)) for c in flags} | {c: category(F.trim(F.col(c).cast("string"))) for c in categories}
    return df.withColumns(made)


def model_frame(df: DataFrame, features: list[str]) -> DataFrame:
    """Numbers without NaN and infinities, and no row without any feature."""
    kinds = {f.name: f.dataType for f in df.schema}
    clean = df.select(*[number(F.col(c)).alias(c) if isinstance(kinds[c], (T.FloatType, T.DoubleType)) else F.col(c) for c in df.columns])
    return clean.na.drop(how="all", subset=features)
