"""Merge conflicts in text: marker parsing, anchors, trivial resolvers and their scores."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HUNK = "hunk int, pre array<string>, ours array<string>, theirs array<string>, post array<string>"
LONG = 20_000
RESOLVERS = ("ours", "theirs", "union_ot", "union_to")


def parse_hunks(text: str | None, context: int = 3) -> list[dict]:
    """Conflict hunks of a file: both sides and up to `context` lines around; the base section is skipped.

    Lines before are the last ones outside all hunks so far; lines after end at the next hunk.  A hunk that the file's end cuts off counts.
    """
    out, side, plain, after = [], None, [], 0
    for line in (text or "").split("\n"):
        if side is None and line.startswith("<<<<<<< "):
            out.append({"hunk": len(out), "pre": plain[-context:], "ours": [], "theirs": [], "post": []})
            side = "ours"
        elif side == "ours" and line.startswith("||||||| "):
            side = "base"
        elif side in ("ours", "base") and line.startswith("======="):
            side = "theirs"
        elif side == "theirs" and line.startswith(">>>>>>> "):
            side, after = None, context
        elif side in ("ours", "theirs"):
            out[-1][side].append(line)
        elif side is None:
            plain.append(line)
            if after:
                out[-1]["post"].append(line)
                after -= 1
    return out


def _find(lines: list[str], want: list[str], at: int = 0) -> int:
    return next((i for i in range(at, len(lines) - len(want) + 1) if lines[i : i + len(want)] == want), -1)


def locate(lines: list[str], pre: list[str], post: list[str]) -> list[str] | None:
    """The lines between the first match of pre and the next of post; an empty anchor is the file's edge."""
    a = _find(lines, pre) + len(pre) if pre else 0
    if pre and a < len(pre):
        return None
    b = _find(lines, post, a) if post else len(lines)
    return lines[a:b] if b >= 0 else None


def similarity(a: str, b: str) -> tuple[bool, float]:
    """Equal after squeezing white space; and the ratio of matching blocks (a quick bound on prefixes of long texts)."""
    a, b = " ".join(a.split()), " ".join(b.split())
    if not a and not b:
        return True, 1.0
    long = max(len(a), len(b)) > LONG
    m = difflib.SequenceMatcher(None, a[:LONG], b[:LONG])
    return a == b, round(m.quick_ratio() if long else m.ratio(), 4)


def explode_hunks(files: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """One row a hunk of each file with markers."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(text).to_pylist()):
                for h in parse_hunks(t):
                    at.append(i)
                    rows.append(h)
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(at, pa.int64())) for k in key), pa.array([r["hunk"] for r in rows], pa.int32()), *(pa.array([r[c] for r in rows], kind) for c in ("pre", "ours", "theirs", "post"))], names=[*key, "hunk", "pre", "ours", "theirs", "post"])

    kinds = dict(files.dtypes)
    return files.where(F.contains(F.col(text), F.lit("<<<<<<<"))).select(*key, text).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", " + HUNK)


def resolver_scores(hunks: DataFrame, truth: str = "truth") -> DataFrame:
    """For each trivial resolver: exact and similar to the lines that stand there in the end; null where these are not known."""

    @F.pandas_udf(", ".join(f"{n}_exact boolean, {n}_sim double" for n in RESOLVERS))
    def score(ours: pd.Series, theirs: pd.Series, want: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b, w in zip(ours, theirs, want, strict=True):
            tried = (a, b, f"{a}\n{b}", f"{b}\n{a}")
            rows.append([None] * 8 if w is None else [x for t in tried for x in similarity(t, w)])
        return pd.DataFrame(rows, columns=[f"{n}_{x}" for n in RESOLVERS for x in ("exact", "sim")])

    lines = lambda c: F.array_join(c, "\n")
    d = hunks.withColumn("_s", score(lines("ours"), lines("theirs"), lines(truth)))
    return d.select(*hunks.columns, *(F.col(f"_s.{n}_{x}").alias(f"{n}_{x}") for n in RESOLVERS for x in ("exact", "sim")))


def resolver_summary(scored: DataFrame, names=("ours", "theirs", "union_ot", "union_to")) -> DataFrame:
    """Per resolver and for the best of all, over the hunks that have a truth: exact rate, rate of similarity of .9 or more, mean similarity."""
    rows = [F.struct(F.lit(n).alias("resolver"), F.col(f"{n}_exact").alias("exact"), F.col(f"{n}_sim").alias("sim")) for n in names]
    rows.append(F.struct(F.lit("best").alias("resolver"), F.greatest(*(F.col(f"{n}_exact") for n in names)).alias("exact"), F.greatest(*(F.col(f"{n}_sim") for n in names)).alias("sim")))
    t = scored.select(F.inline(F.array(*rows))).where("exact is not null")
    return t.groupBy("resolver").agg(F.count("*").alias("n"), F.round(F.avg(F.col("exact").cast("int")), 6).alias("exact_rate"), F.round(F.avg((F.col("sim") >= 0.9).cast("int")), 6).alias("sim90_rate"), F.round(F.avg("sim"), 6).alias("mean_sim"))


def locatable(hunks: DataFrame, group: list[str], truth: str = "truth") -> DataFrame:
    """One row: hunks, those whose place is known in the end, their share, and its mean over the groups."""
    g = hunks.groupBy(*group).agg(F.count("*").alias("n"), F.count(truth).alias("k"))
    return g.agg(F.sum("n").alias("n_hunks"), F.sum("k").alias("n_located"), F.round(F.sum("k") / F.sum("n"), 6).alias("share"), F.round(F.avg(F.col("k") / F.col("n")), 6).alias("macro_share"), F.count("*").alias("n_groups"))


def write_bundle(hunks: DataFrame, path: str) -> None:
    """Hunks as gzipped JSON lines, lists as lists."""
    hunks.write.mode("append").option("compression", "gzip").json(path)


def read_bundle(spark, path: str, key: str = "path string") -> DataFrame:
    return spark.read.schema(f"{key}, {HUNK}, truth array<string>").json(path)


def merge_status(exit_code, missing_ref, merge_base, conflict_files, timed_out):
    """Status of a trial merge from what the tool reported."""
    return (
        F.when(missing_ref, "ref_missing").when(timed_out, "merge_timeout").when(merge_base.isNull(), "no_merge_base").when(exit_code == 0, "clean").when((exit_code == 1) & (F.size(conflict_files) > 0), "conflict").otherwise("merge_error")
    )


def first_commit_after(pairs: DataFrame, commits: DataFrame, bucket_days: int = 30) -> DataFrame:
    """As-of join: each pair's first main-line commit strictly after both closes (repo, at, sha in commits).

    Pairs and commits meet in windows of (repo, time bucket); where a bucket has no later commit, the first one of the next bucket
    that has any is taken, so a repo with most of the rows is spread over its history.
    """
    from pyspark.sql import Window

    from weftline.functions.numbers import micros
    from weftline.sources.scratch import settle

    bucket = F.floor(F.col("at") / (bucket_days * 86_400_000_000)).cast("long").alias("b")
    ask = pairs.select("repo", "pr_a", "pr_b", micros(F.greatest("closed_a", "closed_b")).alias("at"), F.lit(None).cast("string").alias("sha"))
    have = commits.select("repo", F.lit(None).cast("long").alias("pr_a"), F.lit(None).cast("long").alias("pr_b"), micros(F.col("at")).alias("at"), "sha")
    t = settle(ask.union(have).select("*", bucket))
    mine = F.min(F.when(F.col("sha").isNotNull(), F.struct("at", "sha")))
    first = t.groupBy("repo", "b").agg(mine.alias("f")).withColumn("later", F.min("f").over(Window.partitionBy("repo").orderBy("b").rowsBetween(1, Window.unboundedFollowing))).select("repo", "b", "later")
    w = Window.partitionBy("repo", "b").orderBy("at").rangeBetween(1, Window.unboundedFollowing)
    t = t.withColumn("nxt", mine.over(w)).where("pr_a is not null").join(first, ["repo", "b"])
    return t.select("repo", "pr_a", "pr_b", F.coalesce("nxt", "later")["sha"].alias("recon_sha"))
