"""URL filters as a sort-merge range join.

A URL's canonical key is its host with the labels reversed, then its path, so that a rule for a domain, a host or a path
prefix is an interval of keys. Keys and rules are split into ranges of keys, a rule going to each range that it meets;
a sweep over a range's sorted keys keeps a stack of the nested rules that are open, and the innermost decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that are sampled to choose the ranges; only their evenness depends on it.
SAMPLED = 20_000


def canonical(url: Column) -> Column:
    """"org.example.www./path?query" in the host's case-folded labels: no scheme, user, port, fragment, "www." or final slash. Null if there is no host.

    Each label ends in a point, so that a domain's key is a prefix of its subdomains' but of no longer name.
    """
    rest = F.regexp_extract(F.trim(url), r"^(?i:[a-z][a-z0-9+.-]*:)?//([^\x00-\x20]*)$", 1)
    rest = F.regexp_replace(rest, r"#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"^(?:[^/?@]*@)?([^/?:@]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*(.*)$", 1), r"/+$", "")
    path = F.when(path.startswith("?"), F.concat(F.lit("/"), path)).otherwise(path)
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."), path))


def rules(spark, rows: list[tuple[str, str]]) -> DataFrame:
    """(rule, prefix, action) of rules such as ("example.com", "block"), a domain with all below it, or ("example.com/a/", "allow"), a prefix of paths there."""
    made = []
    for rule, action in rows:
        host, slash, path = rule.partition("/")
        made.append((rule, ".".join(reversed(host.lower().split("."))) + "." + slash + path, action))
    return spark.createDataFrame(made, "rule string, prefix string, action string")


def _below(keys: pa.Array, least: bytes, low: int, high: int) -> int:
    """The first place of low..high whose key isn't below `least`; keys are sorted there."""
    while low < high:
        middle = (low + high) // 2
        if keys[middle].as_py() < least:
            low = middle + 1
        else:
            high = middle
    return low


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, key, rules first): each URL with the innermost rule that is open at its key.

    The stack changes where a rule begins or the innermost one's interval ends; all URLs between two such places are done at once.
    """
    stack: list[tuple[bytes, str, str]] = []
    now = None
    for batch in batches:
        n = batch.num_rows
        keys, part = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
        opens = np.append(np.flatnonzero(batch.column(3).is_valid().to_numpy(zero_copy_only=False)), n)
        names: list[tuple[str | None, str | None, int]] = []
        runs: list[int] = []
        at = 0
        for end in np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, n).tolist() if n else []:
            if part[at] != now:
                stack, now = [], part[at]
            while at < end:
                key = keys[at].as_py()
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                rule = int(opens[np.searchsorted(opens, at)])
                if rule == at:
                    stack.append((key, batch.column(3)[at].as_py(), batch.column(4)[at].as_py()))
                    at += 1
                    continue
                stop = min(rule, end)
                if stack:
                    stop = _below(keys, stack[-1][0] + b"\xff", at, stop)
                names.append((stack[-1][1], stack[-1][2], len(stack)) if stack else (None, None, 0))
                runs.append(stop - at)
                at = stop
        which = np.repeat(np.arange(len(runs)), runs)
        mask = np.ones(n, bool)
        mask[opens[:-1]] = False
        rows = [pa.array([x[k] for x in names], t).take(pa.array(which)) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(pa.array(mask)) for k in (5, 6)), *rows], ["page_id", "url", "rule", "action", "nested"])


def filtered(pages: DataFrame, ruleset: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(page_id, url, rule, action, nested) of all pages: the innermost rule on the URL, null if there is none, and how many rules are on it.

    ruleset has rule, prefix and action. Of rules of one prefix the last by (action, rule) is the innermost, and each counts;
    rules with a null or empty prefix are ignored. A URL that is null, empty or without a host has no rule. Repeated rows
    and rows without an id are each judged. An empty table of pages gives an empty result, one of rules no rule.
    """
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.encode(F.coalesce(canonical(F.col(url_column)), F.lit("")), "UTF-8").alias("key"))
    sample = keyed.select("key").orderBy(F.xxhash64("url", "page_id")).limit(SAMPLED).distinct().toArrow().column(0).to_pylist()
    bounds = sorted(set(sorted(sample)[i * len(sample) // parts] for i in range(1, parts))) if sample else []
    shared = spark.sparkContext.broadcast(np.array([*bounds, None], object)[:-1])

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ranges(low: pd.Series, high: pd.Series) -> pd.Series:  # those of all keys of an interval
        first, last = (np.searchsorted(shared.value, x.map(bytes).to_numpy(object), "right") for x in (low, high))
        return pd.Series([list(range(a, b + 1)) for a, b in zip(first, last, strict=True)], dtype=object)

    @F.pandas_udf(T.IntegerType())
    def range_of(key: pd.Series) -> pd.Series:  # the number of bounds that aren't above it
        return pd.Series(np.searchsorted(shared.value, key.map(bytes).to_numpy(object), "right"))

    end = F.concat("key", F.unhex(F.lit("FF")))  # no UTF-8 text has this byte
    opened = ruleset.where("prefix is not null and prefix <> ''").select(F.encode("prefix", "UTF-8").alias("key"), F.lit(0).alias("kind"), F.coalesce("rule", F.lit("")).alias("rule"), F.coalesce("action", F.lit("")).alias("action"))
    opened = opened.select(F.explode(ranges("key", end)).alias("part"), "key", "kind", "rule", "action", F.lit(None).cast(keyed.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("url"))
    asked = keyed.select(range_of("key").alias("part"), "key", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"), "page_id", "url")
    both = opened.unionByName(asked).repartitionById(parts, "part").sortWithinPartitions("part", "key", "kind", "action", "rule")
    schema = T.StructType([T.StructField("page_id", keyed.schema["page_id"].dataType), *[T.StructField(n, t) for n, t in (("url", T.StringType()), ("rule", T.StringType()), ("action", T.StringType()), ("nested", T.LongType()))]])
    return both.mapInArrow(_sweep, schema)


#: Rules for the query: domains, hosts and nested path prefixes with exceptions.
RULES = [
    ("free-bets.example.com", "block"),
    ("cheap-pills.example.com", "block"),
    ("example.com/de/", "review"),
    ("example.com", "allow"),
    ("example.net", "allow"),
    ("blog.tionsh.example.net", "review"),
    ("blog.tionsh.example.net/en/", "allow"),
    ("blog.tionsh.example.net/en/5", "block"),
    ("therou.example.com/fr/", "block"),
    ("m.therou.example.com", "allow"),
    ("example.org", "review"),
    ("thther.example.org/de/", "block"),
    ("thther.example.org/de/6", "allow"),
    ("free-bets.example.com/en/", "review"),
    ("m.free-bets.example.com", "allow"),
    ("other.invalid", "block"),
]
_VALUES = ", ".join(f"('{r}', '{'.'.join(reversed(r.partition('/')[0].split('.'))) + '.' + ''.join(r.partition('/')[1:])}', '{a}')" for r, a in RULES)
ORACLE = rf"""
WITH rules(rule, prefix, action) AS (VALUES {_VALUES}),
a AS (SELECT page_id, url, regexp_replace(regexp_extract(trim(url), '^(?i:[a-z][a-z0-9+.-]*:)?//([^\x00-\x20]*)$', 1), '#.*$', '') AS rest FROM pages),
b AS (SELECT page_id, url, rest, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^(?:[^/?@]*@)?([^/?:@]*)', 1)), '\.+$', ''), '^www\.', '') AS host, regexp_replace(regexp_extract(rest, '^[^/?]*(.*)$', 1), '/+$', '') AS path FROM a),
c AS (SELECT page_id, url, CASE WHEN host <> '' THEN array_to_string(list_reverse(string_split(host, '.')), '.') || '.' || CASE WHEN starts_with(path, '?') THEN '/' || path ELSE path END END AS key FROM b)
SELECT page_id, url, arg_max(rule, length(prefix)) AS rule, arg_max(action, length(prefix)) AS action, count(rule) AS nested
FROM c LEFT JOIN rules ON starts_with(key, prefix) GROUP BY page_id, url
"""
