"""Replay of arrivals under scheduling policies, and the price of avoiding conflicts."""

from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.numbers import micros
from weftline.sources.scratch import settle

DAY = 86_400_000_000


def episodes(pairs: DataFrame, min_pairs: int = 100, min_conflicts: int = 20) -> DataFrame:
    """Requests of the repositories with enough pairs and conflicts: repo, pr, opened, dur, arr (microseconds).

    A close at the last time seen is censored; its duration is capped by the repo's median of the others, or, where
    all are censored, by the overall median.
    """
    from weftline.operators.coactive import intervals

    big = pairs.groupBy("repo").agg(F.count("*").alias("n"), F.count_if("conflict").alias("k")).where((F.col("n") >= min_pairs) & (F.col("k") >= min_conflicts)).select("repo")
    spans = intervals(pairs).join(big, "repo", "left_semi").select("repo", "pr", micros(F.col("opened")).alias("open"), micros(F.col("closed")).alias("close"))
    last = pairs.agg(F.max(F.greatest(micros(F.col("closed_a")), micros(F.col("closed_b")))).alias("_last"))
    t = spans.crossJoin(F.broadcast(last)).withColumn("cens", F.col("close") >= F.col("_last")).withColumn("dur", F.col("close") - F.col("open"))  # one row
    whole = t.agg(F.median(F.when(~F.col("cens"), F.col("dur"))).alias("_all"))
    med = t.groupBy("repo").agg(F.median(F.when(~F.col("cens"), F.col("dur"))).alias("_med"), F.min("open").alias("_first"))
    t = t.join(med, "repo").crossJoin(F.broadcast(whole))  # one row
    dur = F.when(F.col("cens"), F.least("dur", F.floor(F.coalesce("_med", "_all", "dur")).cast("long"))).otherwise(F.col("dur"))
    return t.select("repo", "pr", dur.alias("dur"), (F.col("open") - F.col("_first")).alias("arr"))


def fifo(eps: DataFrame) -> DataFrame:
    """start of each request when a repo runs one at a time, in order of arrival: a prefix sum, and a prefix maximum over it.

    Both go by (repo, time bucket) and are shifted by the buckets before, so that a repo with most of the requests is spread over its history.
    """
    from weftline.operators.coactive import running_sums

    t = running_sums(eps, "repo", "arr", ["dur"], ["pr"]).withColumn("_before", F.col("dur_so_far") - F.col("dur")).drop("dur_so_far")
    t = settle(t.withColumn("_slack", F.col("arr") - F.col("_before")).withColumn("_b", F.floor(F.col("arr") / (30 * DAY)).cast("long")))
    earlier = Window.partitionBy("repo").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    most = t.groupBy("repo", "_b").agg(F.max("_slack").alias("_m")).select("repo", "_b", F.max("_m").over(earlier).alias("_m"))
    w = Window.partitionBy("repo", "_b").orderBy("arr", "pr").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_upto", F.max("_slack").over(w)).join(most, ["repo", "_b"])
    return t.select(*eps.columns, (F.greatest("_upto", "_m") + F.col("_before")).alias("start"))


def observed(eps: DataFrame) -> DataFrame:
    return eps.withColumn("start", F.col("arr"))


def gate(prs: list, arr: list[int], dur: list[int], blocks: Callable[[object, object], bool]) -> list[int]:
    """Start times when a request waits while it is blocked by one that runs.

    Events are finishes (first, on ties) and arrivals.  Waiting requests are looked at in order of arrival after each
    event; those started in the same look count as running for the later ones.
    """
    order = sorted(range(len(prs)), key=lambda i: (arr[i], prs[i]))
    start, running, waiting, ends, nxt = [0] * len(prs), set(), [], [], 0
    while nxt < len(order) or ends:
        if ends and (nxt == len(order) or ends[0][0] <= arr[order[nxt]]):
            now = ends[0][0]
            while ends and ends[0][0] == now:
                running.discard(heapq.heappop(ends)[1])
            look, waiting = waiting, []
        else:
            now, look = arr[order[nxt]], [order[nxt]]
            nxt += 1
        for i in look:
            if any(blocks(prs[i], prs[j]) for j in running):
                waiting.append(i)
            else:
                start[i] = now
                running.add(i)
                heapq.heappush(ends, (now + dur[i], i))
    return start


def gated(eps: DataFrame, scores: DataFrame | None, tau: float, strict: bool = False, score_fn: Callable[[object, object], float] | None = None) -> DataFrame:
    """start under the gate that blocks pairs whose score is at least tau (`strict`: above it).

    scores: repo, pr_a, pr_b, score; or score_fn(pr, pr) instead.  Inherently sequential in a repo, so each repo is one
    group; a repo's requests and blocking pairs are its group's size.
    """
    return gated_at(eps, scores, (tau,), strict, score_fn).drop("tau")


def gated_at(eps: DataFrame, scores: DataFrame | None, taus: tuple[float, ...], strict: bool = False, score_fn: Callable[[object, object], float] | None = None) -> DataFrame:
    """As gated(), for several thresholds side by side: a group is a repo and a threshold."""
    import pandas as pd

    enough = (lambda s, tau: s > tau) if strict else (lambda s, tau: s >= tau)

    def start(left: pd.DataFrame, blocks) -> pd.DataFrame:
        return left[["repo", "pr", "dur", "arr", "tau"]].assign(start=gate(left["pr"].tolist(), left["arr"].tolist(), left["dur"].tolist(), blocks))

    kinds = dict(eps.dtypes)
    schema = f"repo {kinds['repo']}, pr {kinds['pr']}, dur long, arr long, tau double, start long"
    several = F.explode(F.array(*(F.lit(float(t)) for t in taus))).alias("tau")
    e = eps.select("repo", "pr", "dur", "arr", several)
    if score_fn is not None:
        return e.groupBy("repo", "tau").applyInPandas(lambda left: start(left, lambda x, y: enough(score_fn(x, y), left["tau"].iloc[0])), schema)

    def run(left, right):
        if left.empty:
            return pd.DataFrame({c: [] for c in ("repo", "pr", "dur", "arr", "tau", "start")})
        bad = set(zip(right["a"].tolist(), right["b"].tolist(), strict=True))
        return start(left, lambda x, y: (min(x, y), max(x, y)) in bad)

    hits = scores.select("repo", F.least("pr_a", "pr_b").alias("a"), F.greatest("pr_a", "pr_b").alias("b"), "score", several)
    hits = hits.where(enough(F.col("score"), F.col("tau"))).select("repo", "tau", "a", "b").distinct()
    return e.groupBy("repo", "tau").cogroup(hits.groupBy("repo", "tau")).applyInPandas(run, schema)


def schedule_conflicts(starts: DataFrame, shared: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Pairs that share a file (repo, pr_a, pr_b) and overlap under the start times; ends excluded.  `more`: columns that tell schedules apart."""
    side = lambda s: starts.select("repo", *more, F.col("pr").alias(f"pr_{s}"), F.col("start").alias(f"s_{s}"), (F.col("start") + F.col("dur")).alias(f"e_{s}"))
    t = shared.join(side("a"), ["repo", "pr_a"]).join(side("b"), ["repo", *more, "pr_b"])
    return t.where(F.greatest("s_a", "s_b") < F.least("e_a", "e_b")).select("repo", *more, "pr_a", "pr_b")


def episode_metrics(starts: DataFrame, base: DataFrame, shared: DataFrame, policy: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Per repo (and per value of `more`, which tells schedules apart): conflicts under the policy and as observed, share avoided, new ones, added delay, makespan inflation."""
    by = ["repo", *more]
    mine, seen = schedule_conflicts(starts, shared, more), schedule_conflicts(base, shared)
    count = lambda df, n, keys: df.groupBy(*keys).agg(F.count("*").alias(n))
    new = mine.join(seen, ["repo", "pr_a", "pr_b"], "left_anti")
    end = F.max(F.col("start") + F.col("dur"))
    g = starts.groupBy(*by).agg(F.count("*").alias("n_prs"), F.sum(F.col("start") - F.col("arr")).alias("delay"), end.alias("makespan"))
    g = g.join(base.groupBy("repo").agg(end.alias("base_makespan")), "repo").join(count(seen, "obs_conflicts", ["repo"]), "repo", "left")
    g = g.join(count(mine, "conflicts", by), by, "left").join(count(new, "new_conflicts", by), by, "left").fillna(0, ["obs_conflicts", "conflicts", "new_conflicts"])
    c, o = F.col("conflicts"), F.col("obs_conflicts")
    return g.select(
        *by, F.lit(policy).alias("policy"), "n_prs", "conflicts", "obs_conflicts", F.round(F.try_divide(100.0 * (o - c), o), 6).alias("avoided_pct"), "new_conflicts",
        F.round(F.col("delay") / DAY, 6).alias("added_delay_days"), F.round(F.col("delay") / DAY / F.col("n_prs"), 6).alias("delay_days_per_pr"), F.round(F.col("makespan") / DAY, 6).alias("makespan_days"),
        F.round(F.try_divide(100.0 * (F.col("makespan") - F.col("base_makespan")), F.col("base_makespan")), 6).alias("makespan_inflation_pct"),
    )


def policy_summary(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Per policy: episodes, quartiles over episodes and pooled shares."""
    q = lambda c: F.transform(F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))), lambda x: F.round(x, 6))
    g = metrics.groupBy(*by).agg(*(q(c).alias(f"_{c}") for c in ("avoided_pct", "makespan_inflation_pct", "delay_days_per_pr")), F.count("*").alias("n_episodes"), F.sum("conflicts").alias("c"), F.sum("obs_conflicts").alias("o"))
    return g.select(*by, "n_episodes", *(F.col(f"_{c}")[i].alias(f"{c}_{n}") for c in ("avoided_pct", "makespan_inflation_pct", "delay_days_per_pr") for i, n in enumerate(("p25", "p50", "p75"))), F.round(F.try_divide(100.0 * (F.col("o") - F.col("c")), F.col("o")), 6).alias("pooled_avoided_pct"))
