"""Reading runs, configurations and side tables: CSV, JSON in several shapes, Parquet."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import number
from ..operators.units import join_configurations, prefixed

WRAPPERS = ("rows", "data", "items", "results")
NESTED = (T.StructType, T.MapType, T.ArrayType)
SMALL_BYTES = 10 << 20


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A header, and the schema given or inferred; malformed fields become null."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def read_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Records of a JSON file: an array, an object with one under rows, data, items or results, an object of objects, or lines (lines=True, which Spark splits)."""
    df = spark.read.json(path, multiLine=not lines)
    if "_corrupt_record" in df.columns and len(df.columns) == 1 and not lines:
        return read_records(spark, path, lines=True)
    kinds = {f.name: f.dataType for f in df.schema}
    for name in WRAPPERS:
        if isinstance(kinds.get(name), T.ArrayType) and isinstance(kinds[name].elementType, T.StructType):
            return df.select(F.inline(name))
    if len(kinds) > 0 and all(isinstance(k, T.StructType) for k in kinds.values()) and len(df.head(2)) == 1:
        fields = sorted({f.name: f.dataType for k in kinds.values() for f in k}.items())
        rows = [F.struct(*[(F.col(f"`{c}`.`{n}`") if n in k.fieldNames() else F.lit(None)).cast(t).alias(n) for n, t in fields]) for c, k in kinds.items()]
        return df.select(F.inline(F.array(*rows)))
    if not kinds:
        raise ValueError(f"no records in {path}")
    return df


def flattened(df: DataFrame, separator: str = "_") -> DataFrame:
    """Fields of structs as columns, joined by the separator; what stays nested becomes JSON text."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema):
        columns = []
        for f in df.schema:
            if isinstance(f.dataType, T.StructType):
                columns += [F.col(f"`{f.name}`.`{s}`").alias(f"{f.name}{separator}{s}".replace(".", separator)) for s in f.dataType.fieldNames()]
            else:
                columns.append(F.col(f"`{f.name}`").alias(f.name.replace(".", separator)))
        df = df.select(*columns)
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, NESTED) else F.col(f"`{f.name}`") for f in df.schema])


def expand_metrics(df: DataFrame, column: str = "metrics", prefix: str = "metrics_", keys: list[str] | None = None) -> DataFrame:
    """The numbers of a JSON column as columns of their own, nested ones with a point; text that isn't an object has none. Keys are looked for in one pass unless given."""
    parsed = F.try_parse_json(F.col(column))
    if keys is None:
        # one level of nesting; different names are combined before the shuffle, and each comes to the driver once
        flat = df.select(F.explode(F.from_json(column, "map<string,string>", {"mode": "PERMISSIVE"})).alias("a", "_v"))
        names = flat.select("a", F.explode_outer(F.map_keys(F.from_json("_v", "map<string,string>"))).alias("b")).distinct().collect()
        below = sorted((r["a"], r["b"]) for r in names if r["b"] is not None)
        parents = {a for a, _ in below}
        keys = sorted({r["a"] for r in names} - parents) + [f"{a}.{b}" for a, b in below]
    values = [number(F.try_variant_get(parsed, "$." + k, "string")).alias(prefix + k) for k in keys]
    return df.select(*[c for c in df.columns if c != column], *values)


def file_size(spark: SparkSession | None, path: str) -> int | None:
    """Bytes of a file in any file system that Spark knows, None if there is no such file; without a session, of a local file."""
    if spark is None:
        return Path(path).stat().st_size if Path(path).is_file() else None
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getFileStatus(where).getLen() if system.exists(where) and not system.getFileStatus(where).isDirectory() else None


def sources(folder: str, spark: SparkSession | None = None, fallbacks: tuple[str, ...] = ("json", "dump")) -> list[dict]:
    """Which of the known files a folder has, by precedence: flat CSV, raw CSV, then JSON there or in one of the folders below it."""
    base = folder.rstrip("/")
    known = [("csv", base, "benchmark_results.csv", "configs.csv"), ("raw_csv", base, "benchmark_results_raw.csv", "configs.csv")]
    known += [("json", place, "benchmark_results.json", "configs.json") for place in (base, *[f"{base}/{f}" for f in fallbacks])]
    found = [{"mode": mode, "runs": f"{place}/{runs}", "configs": f"{place}/{configs}"} for mode, place, runs, configs in known]
    return [f | {"available": all(file_size(spark, f[k]) is not None for k in ("runs", "configs"))} for f in found]


def load(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    """(mode, joined runs) of the first source that is complete; mode is missing with an empty frame otherwise."""
    for s in sources(folder, spark):
        if s["available"]:
            read = read_csv if s["mode"] != "json" else read_records
            runs, configs = read(spark, s["runs"]), flattened(read(spark, s["configs"]))
            if "metrics" in runs.columns and dict(runs.dtypes)["metrics"] == "string":
                runs = expand_metrics(runs)
            runs = flattened(runs)
            if "id" in runs.columns:
                runs = runs.withColumnRenamed("id", "benchmark_id")
            return s["mode"], join_configurations(runs, prefixed(configs))
    return "missing", spark.createDataFrame([], "config_id string")


def side_tables(spark: SparkSession, folder: str, names: tuple[str, ...] = ("availability", "run_stats", "eval_results", "changelog_entries", "workflow_runs"), most: int = SMALL_BYTES) -> dict[str, DataFrame]:
    """Small optional tables, CSV before JSON; files beyond `most` bytes are left alone."""
    out = {}
    for name in names:
        for suffix, read in ((".csv", read_csv), (".json", read_records)):
            path = f"{folder.rstrip('/')}/{name}{suffix}"
            size = None if name in out else file_size(spark, path)
            if size is not None and size <= most:
                out[name] = read(spark, path)
    return out


def write_embeddings(df: DataFrame, path: str, seed: str = "seed", keys: tuple[str, ...] = ("row_id",)) -> dict:
    """Parquet with Zstandard, a folder for each seed, and beside it a manifest of its rows, seeds, columns and a digest, which is returned.

    The digest is of all values, whatever their order; `read_embeddings` checks it.
    """
    df.write.mode("overwrite").partitionBy(seed).option("compression", "zstd").parquet(path)
    manifest = _embedding_manifest(df.sparkSession.read.parquet(path), seed, keys)
    rows = df.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string")
    rows.coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}.manifest")
    return manifest


def _embedding_manifest(df: DataFrame, seed: str, keys: tuple[str, ...]) -> dict:
    columns = sorted(df.columns)
    row = df.agg(F.count("*").alias("rows"), F.array_sort(F.collect_set(F.col(seed).cast("string"))).alias("seeds"), F.count_distinct(*keys).alias("keys"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("digest")).first()
    return {"rows": row["rows"], "seeds": list(row["seeds"]), "different_keys": row["keys"], "columns": columns, "digest": row["digest"]}


def read_embeddings(spark: SparkSession, path: str, seed: str = "seed", keys: tuple[str, ...] = ("row_id",), **expected) -> DataFrame:
    """The embeddings, if they are as their manifest says, and it as expected; else an error that names what differs."""
    manifest = json.loads(spark.read.text(f"{path.rstrip('/')}.manifest").first()[0])
    df = spark.read.parquet(path)
    found = _embedding_manifest(df, seed, keys)
    if wrong := sorted(k for k in manifest if manifest[k] != found[k]) + sorted(k for k, v in expected.items() if manifest.get(k) != v):
        raise ValueError(f"embeddings that differ in {wrong}")
    return df


def write_signed(df: DataFrame, path: str, signature: str) -> None:
    """CSV with the analysis signature as first column."""
    df.select(F.lit(signature).alias("analysis_signature"), *df.columns).write.mode("overwrite").option("header", True).csv(path)
