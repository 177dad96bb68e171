"""Readers with declared schemas, sinks, resumable appends, hashing and manifests."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import as_bool
from weftline.sources.layout import exists, input_paths

PAIRS = "repo string, pr_a long, pr_b long, agent_a string, agent_b string, opened_a timestamp, closed_a timestamp, opened_b timestamp, closed_b timestamp, cross_agent string, conflict string, both_files string"
FILES = "repo string, pr long, filepath string, additions long, deletions long"
TEXTS = "repo string, pr long, agent string, state string, title string, body string, merged string"
REPOS = "repo string, n_agent_prs long, language string, stars long"
TABLES = {"pairs_labeled": PAIRS, "pr_files": FILES, "pr_texts": TEXTS, "repo_stats": REPOS}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, gzipped or not; texts may hold line ends."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=not path.endswith(".gz") and "title" in schema, escape='"')


def load_tables(spark: SparkSession, root: str, paths: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The four source tables, truth values of any spelling made boolean; paths override where they are."""
    out = {}
    for name, path in input_paths(spark, root, paths).items():
        df = read_csv(spark, path, TABLES[name])
        flags = [c for c in ("cross_agent", "conflict", "both_files", "merged") if c in df.columns]
        out[name] = df.withColumns({c: as_bool(F.col(c), "string") for c in flags})
    return out


def first_column(df: DataFrame, candidates=("filename", "file_path", "path", "file")) -> str:
    """The first of some names that the table has; only the schema is read."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {candidates} among {df.columns}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip" if path.endswith(".gz") else "none").csv(path)


def pending(df: DataFrame, done: DataFrame | None, key: list[str]) -> DataFrame:
    """Rows whose key is not done yet."""
    return df if done is None else df.join(done.select(*key).distinct(), key, "left_anti")


def append_log(df: DataFrame, path: str, key: list[str], schema: str) -> DataFrame:
    """Append the rows whose key the JSON-lines log lacks; gives the log, first entry per key."""
    spark = df.sparkSession
    log = lambda: spark.read.schema(schema).json(path)
    done = log() if exists(spark, path) else None  # its files are those of now, whatever is appended
    pending(df, done, key).write.mode("append").json(path)
    return log().dropDuplicates(key)


def append_csv(df: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Append the rows whose key the table of CSV files lacks; each file has a header.  Gives the table, one row a key."""
    spark = df.sparkSession
    done = spark.read.schema(df.schema).csv(path, header=True) if exists(spark, path) else None
    pending(df, done, key).write.mode("append").option("header", True).csv(path)
    return spark.read.schema(df.schema).csv(path, header=True).dropDuplicates(key)


def with_versions(df: DataFrame, version: str) -> DataFrame:
    """Dataset and configuration version of each record, where it has none yet."""
    stamp = lambda c: F.coalesce(F.col(c), F.lit(version)) if c in df.columns else F.lit(version)
    return df.withColumns({c: stamp(c) for c in ("dataset_version", "config_version")})


def lookup(df: DataFrame, keys: list[tuple], names: list[str]) -> DataFrame:
    """Rows of the listed keys, with `place` telling the place of the key in the list; a key that is missing has no row."""
    kinds = dict(df.dtypes)
    asked = df.sparkSession.createDataFrame([(*k, i) for i, k in enumerate(keys)], ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", place int")
    return df.join(F.broadcast(asked), names).orderBy("place")  # as many rows as keys are listed


def first_per_key(df: DataFrame, key: list[str], *order) -> DataFrame:
    """The first row of each key in an explicit order, which has to decide; by an aggregate, so that no key is sorted."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*key, *(F.col(f"_row.`{c}`").alias(c) for c in rest)).select(*df.columns)


def compared(a: DataFrame, b: DataFrame, key: list[str], columns: list[str], tolerance: float = 1e-3) -> DataFrame:
    """Per column: rows that both have, the largest absolute difference, and how many differ by more than the tolerance."""
    j = a.select(*key, *(F.col(c).alias(f"{c}_a") for c in columns)).join(b.select(*key, *(F.col(c).alias(f"{c}_b") for c in columns)), key)
    diff = lambda c: F.abs(F.col(f"{c}_a").cast("double") - F.col(f"{c}_b").cast("double"))
    one = j.agg(F.count("*").alias("n"), *(F.max(diff(c)).alias(f"m_{i}") for i, c in enumerate(columns)), *(F.count_if(diff(c) > tolerance).alias(f"k_{i}") for i, c in enumerate(columns)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col("n"), F.col(f"m_{i}").alias("max_diff"), F.col(f"k_{i}").alias("n_differ")) for i, c in enumerate(columns)))))


def sha256_file(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def manifest(inputs: dict[str, str], counts: dict[str, int], pool_counts: dict[str, int] | None = None) -> dict:
    """Versions, commit, hashes of input files and row counts of a run."""
    import numpy
    import pyspark

    try:
        commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip()
    except OSError:
        commit = ""
    return {"git_commit": commit, "versions": {"python": platform.python_version(), "pyspark": pyspark.__version__, "numpy": numpy.__version__}, "inputs": {k: sha256_file(p) for k, p in sorted(inputs.items()) if os.path.isfile(p)}, "row_counts": counts, "pool_counts": pool_counts or {}}


def compare_manifests(old: dict, new: dict, parts=("inputs", "row_counts", "pool_counts")) -> list[str]:
    """Differences, one line each."""
    out = []
    for p in parts:
        for k in sorted(set(old.get(p, {})) | set(new.get(p, {}))):
            a, b = old.get(p, {}).get(k), new.get(p, {}).get(k)
            if a != b:
                out.append(f"{p}.{k}: {a} -> {b}")
    return out


def write_json(path: str, value) -> None:
    with open(path, "w") as f:
        json.dump(value, f, indent=2, default=str)


def read_json(path: str):
    with open(path) as f:
        return json.load(f)


def write_table(df: DataFrame | None, path: str, why: str = "") -> None:
    """A result table as CSV; without one, a row that says it is not available, and why."""
    if df is None:
        df = SparkSession.active().createDataFrame([("NOT AVAILABLE", why)], "status string, reason string")
    write_csv(df, path)


def write_benchmark(gold: DataFrame, silver: DataFrame | None, path: str, group: str = "repo", split: str = "split") -> DataFrame:
    """Gold rows as one table a split; silver rows (judged, not checked) join train only.  Gives the groups in more than one split.

    Silver rows of a group that stands in test or dev are left out.
    """
    if silver is not None:
        held = gold.where(F.col(split).isin("test", "dev")).select(group).distinct()
        more = silver.join(held, group, "left_anti").withColumn(split, F.lit("train"))
        gold = gold.withColumn("source", F.lit("gold")).unionByName(more.withColumn("source", F.lit("silver")), allowMissingColumns=True)
    gold.write.mode("overwrite").partitionBy(split).parquet(path)
    return gold.groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)
