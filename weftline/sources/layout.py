"""Where a study's files are: its root, its input tables by role, prompt templates with their hash."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Environment variable that names the root outright.
ROOT = "WEFTLINE_ROOT"
# Where the input tables are under a root, by role, the gzipped name first.
INPUTS = {
    "pairs_labeled": ("derived/pairs_labeled.csv.gz", "pairs_labeled.csv.gz", "pairs_labeled.csv"),
    "pr_files": ("data/pr_files.csv.gz", "pr_files.csv.gz", "pr_files.csv"),
    "pr_texts": ("data/pr_texts.csv.gz", "pr_texts.csv.gz", "pr_texts.csv"),
    "repo_stats": ("data/repo_stats.csv", "repo_stats.csv", "repo_stats.csv.gz"),
}


def find_root(start: str = ".", markers: tuple[str, ...] = ("derived/pairs_labeled.csv.gz", "data/pr_files.csv.gz")) -> str:
    """The folder that the environment names, or the nearest one at or above `start` that holds all markers."""
    if named := os.environ.get(ROOT):
        return os.path.abspath(named)
    at = os.path.abspath(start)
    while not all(os.path.exists(os.path.join(at, m)) for m in markers):
        up = os.path.dirname(at)
        if up == at:
            raise FileNotFoundError(f"no folder at or above {os.path.abspath(start)} holds {', '.join(markers)}; set {ROOT}")
        at = up
    return at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's own file systems know the path, wherever it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def input_paths(spark: SparkSession, root: str, over: dict[str, str] | None = None) -> dict[str, str]:
    """Role -> path: the override (under the root unless absolute or a URL), else the first usual place that exists, else the first."""
    out = {}
    for role, usual in INPUTS.items():
        named = (over or {}).get(role)
        if named:
            out[role] = named if named.startswith("/") or "://" in named else f"{root.rstrip('/')}/{named}"
        else:
            places = [f"{root.rstrip('/')}/{p}" for p in usual]
            out[role] = next((p for p in places if exists(spark, p)), places[0])
    return out


def load_prompt(folder: str, version: str = "v1", name: str = "judge") -> tuple[str, str, str]:
    """Text, SHA-256 and path of a template; the first version's, if there is none of this one."""
    path = os.path.join(folder, f"{name}_{version}.txt")
    if not os.path.exists(path):
        path = os.path.join(folder, f"{name}_v1.txt")
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return text, hashlib.sha256(text.encode()).hexdigest(), path


def render_item(rubric: str, body_chars: int = 1200) -> Column:
    """The prompt of a pair: columns repo, title_, body_, n_files_, files_ (as text) of both sides, files_shared."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def side(s: str) -> Column:
        # Headings of the prompt.
        return F.concat(F.lit(f"--- PR {s} ---\nTITLE: "), text(f"title_{s}"), F.lit("\nDESCRIPTION: "), F.substring(text(f"body_{s}"), 1, body_chars), F.lit("\nCHANGED FILES ("), text(f"n_files_{s}"), F.lit("):\n"), text(f"files_{s}"), F.lit("\n"))

    shared = F.when(text("files_shared") == "", "(none)").otherwise(text("files_shared"))
    return F.concat(F.lit(f"{rubric}\nREPOSITORY: "), text("repo"), F.lit("\n\n"), side("a"), F.lit("\n"), side("b"), F.lit("\nFILES CHANGED BY BOTH:\n"), shared, F.lit("\n"))
