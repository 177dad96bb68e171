"""The interval operators over streams of arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_coactive(opens: DataFrame, closes: DataFrame, lateness: str = "10 minutes", longest: str = "30 days") -> DataFrame:
    """Pairs of one repo as they become known: a request that opens within another's interval.

    opens: repo, pr, opened; closes: repo, pr, opened, closed (sent at the close).  A stream-stream join in which
    both sides have watermarks and a bound on an interval's length, so that state is dropped in time.
    """
    a = closes.withWatermark("closed", lateness).select("repo", F.col("pr").alias("pr_a"), F.col("opened").alias("opened_a"), "closed")
    b = opens.withWatermark("opened", lateness).select(F.col("repo").alias("repo_b"), F.col("pr").alias("pr_b"), F.col("opened").alias("opened_b"))
    later = (F.col("opened_a") < F.col("opened_b")) | ((F.col("opened_a") == F.col("opened_b")) & (F.col("pr_a") < F.col("pr_b")))
    on = F.expr(f"repo = repo_b AND opened_b < closed AND opened_b >= closed - INTERVAL {longest}") & later
    return a.join(b, on).select("repo", "pr_a", "pr_b", "opened_a", "opened_b")


def arrivals(opens: DataFrame, window: str = "1 day", lateness: str = "1 hour", by: str = "agent") -> DataFrame:
    """Requests opened per window and group, final once the watermark is past the window."""
    return opens.withWatermark("opened", lateness).groupBy(F.window("opened", window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def first_judgements(log: DataFrame, key: str = "frame_id", at: str = "utc", lateness: str = "1 hour") -> DataFrame:
    """The first entry of each key of an append-only log, late repeats within the watermark dropped."""
    return log.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])
