"""Joins over intervals: co-activity, concurrency at a time, trailing rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.numbers import micros
from weftline.sources.scratch import settle

DAY = 86_400_000_000


def running_sums(t: DataFrame, by: str, at: str, sums: list[str], order: list[str] | None = None, bucket_days: int = 30) -> DataFrame:
    """t with <name>_so_far: sums over the group's rows at or before, in order of `at` and `order`; without `order`, strictly before `at`.

    Windows are within (group, time bucket), shifted by the totals of the buckets before, so that a group which holds most of the rows
    is spread over its history.  The rows are written first, as they are read twice.
    """
    t = settle(t.withColumn("_b", F.floor(F.col(at) / (bucket_days * DAY)).cast("long")))
    earlier = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = t.groupBy(by, "_b").agg(*(F.sum(c).alias(c) for c in sums)).select(by, "_b", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in sums))
    w = Window.partitionBy(by, "_b").orderBy(at, *(order or []))
    w = w.rangeBetween(Window.unboundedPreceding, -1) if order is None else w.rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumns({f"{c}_so_far": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in sums}).join(whole, [by, "_b"]).withColumns({f"{c}_so_far": F.col(f"{c}_so_far") + F.col(f"_{c}") for c in sums}).drop("_b", *(f"_{c}" for c in sums))


def censored(df: DataFrame) -> DataFrame:
    """Missing closes at the latest time seen (one scalar); rows without an open go."""
    cutoff = df.agg(F.max(F.greatest("opened", "closed")).alias("_cutoff"))
    return df.where("opened is not null").crossJoin(F.broadcast(cutoff)).withColumn("closed", F.coalesce("closed", "_cutoff")).drop("_cutoff")  # one row


def coactive_pairs(df: DataFrame, bucket_days: int = 60) -> DataFrame:
    """Pairs of one repo's requests of which the earlier is open when the later opens; ties by number.

    The later side stands in the time bucket of its opening only, the earlier one in each bucket that it is open in,
    so every pair meets once, and a large repository is spread over its history.
    """
    df = censored(df)
    width = bucket_days * DAY
    at = lambda c: F.floor(micros(F.col(c)) / width).cast("long")
    late = df.withColumn("_bucket", at("opened"))
    early = df.withColumn("_bucket", F.explode(F.sequence(at("opened"), F.greatest(at("closed"), at("opened")))))
    a, b = early.alias("a"), late.alias("b")
    earlier = (F.col("a.opened") < F.col("b.opened")) | ((F.col("a.opened") == F.col("b.opened")) & (F.col("a.pr") < F.col("b.pr")))
    on = (F.col("a.repo") == F.col("b.repo")) & (F.col("a._bucket") == F.col("b._bucket")) & (F.col("a.closed") > F.col("b.opened")) & earlier
    sides = [F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in ("pr", "agent", "opened", "closed", "merged") for s in "ab"]
    return a.join(b, on).select(F.col("a.repo").alias("repo"), *sides, (F.col("a.agent") != F.col("b.agent")).alias("cross_agent"))


def intervals(pairs: DataFrame) -> DataFrame:
    """The different requests of both roles: repo, pr, opened, closed."""
    side = lambda s: pairs.select("repo", F.col(f"pr_{s}").alias("pr"), F.col(f"opened_{s}").alias("opened"), F.col(f"closed_{s}").alias("closed"))
    return side("a").unionByName(side("b")).groupBy("repo", "pr").agg(F.min(F.struct("opened", "closed")).alias("s")).select("repo", "pr", "s.opened", "s.closed")


def concurrency_at(points: DataFrame, spans: DataFrame, at: str = "at") -> DataFrame:
    """points (repo, key columns, `at` in microseconds) with `concurrency`: spans of the repo open then, ends included.

    Opens, closes and points go into one running sum a repo: linear, where a range join would be quadratic.
    """
    keys = [c for c in points.columns if c not in ("repo", at)]
    none = [F.lit(None).cast(dict(points.dtypes)[k]).alias(k) for k in keys]
    up = spans.select("repo", micros(F.col("opened")).alias(at), F.lit(0).alias("kind"), F.lit(1).alias("step"), *none)
    down = spans.select("repo", micros(F.col("closed")).alias(at), F.lit(2).alias("kind"), F.lit(-1).alias("step"), *none)
    ask = points.select("repo", at, F.lit(1).alias("kind"), F.lit(0).alias("step"), *keys)
    t = running_sums(up.union(down).union(ask), "repo", at, ["step"], ["kind"])
    return t.where("kind = 1").select("repo", at, *keys, F.col("step_so_far").alias("concurrency"))


def concurrency_profile(spans: DataFrame) -> DataFrame:
    """Per repo: requests, greatest concurrency, span in days and time-weighted mean concurrency."""
    up = spans.select("repo", micros(F.col("opened")).alias("at"), F.lit(1).alias("step"))
    down = spans.select("repo", micros(F.col("closed")).alias("at"), F.lit(-1).alias("step"))
    steps = up.union(down).groupBy("repo", "at").agg(F.sum("step").alias("step"), F.count_if(F.col("step") > 0).alias("opens"))
    t = running_sums(steps, "repo", "at", ["step"], []).withColumnRenamed("step_so_far", "level")
    # The next step of a repo is in its bucket, or else the first one of the next bucket that it has.
    b = F.floor(F.col("at") / (30 * DAY)).cast("long")
    t = settle(t.withColumn("_b", b))
    first = t.groupBy("repo", "_b").agg(F.min("at").alias("_first")).withColumn("_after", F.lead("_first").over(Window.partitionBy("repo").orderBy("_b"))).select("repo", "_b", "_after")
    t = t.withColumn("_next", F.lead("at").over(Window.partitionBy("repo", "_b").orderBy("at"))).join(first, ["repo", "_b"])
    t = t.withColumn("held", F.coalesce("_next", "_after") - F.col("at"))
    out = t.groupBy("repo").agg(F.sum("opens").alias("n_prs"), F.max("level").alias("max_level"), (F.max("at") - F.min("at")).alias("span"), F.sum(F.col("level") * F.col("held")).alias("area"))
    return out.select("repo", "n_prs", "max_level", (F.col("span") / DAY).alias("span_days"), F.when(F.col("span") > 0, F.col("area") / F.col("span")).alias("mean_level"))


def trailing_rate(pairs: DataFrame, prior: float = 10.0, default: float = 0.5) -> DataFrame:
    """Each pair's smoothed conflict rate over the repo's pairs that were over before it began."""
    over = pairs.select("repo", micros(F.greatest("closed_a", "closed_b")).alias("at"), F.lit(0).alias("ask"), F.col("conflict").cast("long").alias("k"), F.lit(1).alias("n"), F.lit(None).cast("long").alias("pr_a"), F.lit(None).cast("long").alias("pr_b"))
    ask = pairs.select("repo", micros(F.col("opened_b")).alias("at"), F.lit(1).alias("ask"), F.lit(0).cast("long").alias("k"), F.lit(0).alias("n"), F.col("pr_a").cast("long").alias("pr_a"), F.col("pr_b").cast("long").alias("pr_b"))
    t = running_sums(over.union(ask), "repo", "at", ["k", "n"]).where("ask = 1")
    return t.select("repo", "pr_a", "pr_b", F.col("n_so_far").alias("n_before"), ((F.col("k_so_far") + prior * default) / (F.col("n_so_far") + prior)).alias("rate"))


def all_pairs_by_file(files: DataFrame) -> DataFrame:
    """Pairs of one repo that touch a common path, co-active or not: repo, pr_a < pr_b, n_shared."""
    a, b = files.alias("a"), files.alias("b")
    on = (F.col("a.repo") == F.col("b.repo")) & (F.col("a.path") == F.col("b.path")) & (F.col("a.pr") < F.col("b.pr"))
    return a.join(b, on).groupBy(F.col("a.repo").alias("repo"), F.col("a.pr").alias("pr_a"), F.col("b.pr").alias("pr_b")).agg(F.count("*").alias("n_shared"))
