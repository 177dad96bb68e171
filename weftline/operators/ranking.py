"""Rank metrics over a score and a 0/1 label.

Global ranks are taken over distinct scores, after aggregation.  Sums up to a score come from windows within ranges of scores
(cut at approximate quantiles) and the totals of the ranges before, so no task sorts a whole table; random order goes by
prefixes of the hash in the same way.  The ranges of one table are written first, as several steps read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.numbers import wilson
from weftline.functions.text import order_hash
from weftline.sources.scratch import settle

RANGES = 256


def sums_before(g: DataFrame, order: str, sums: list[str], descending: bool = False) -> DataFrame:
    """g with <name>_before: the sum of each column over the rows before in the order of a number that is different in each row."""
    g = settle(g)
    cuts = sorted(set(g.approxQuantile(order, [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES)))) if g.count() > RANGES else []
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col(order).cast("double"))) if cuts else F.lit(0)
    t = g.withColumn("_range", bucket)
    turn = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    earlier = Window.partitionBy(F.lit(1)).orderBy(turn("_range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = t.groupBy("_range").agg(*(F.sum(c).alias(c) for c in sums)).select("_range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in sums))
    within = Window.partitionBy("_range").orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, -1)
    t = t.join(F.broadcast(whole), "_range")  # RANGES rows
    return t.select(*g.columns, *((F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_{c}")).alias(f"{c}_before") for c in sums))


def hash_ranks(df: DataFrame, seed: int, key: list[str], out: str = "rank") -> DataFrame:
    """df with the row's place in hash order (from 0) and the number of rows, _total: ranks within prefixes of the hash, and the counts of those before."""
    h = df.withColumn("_h", order_hash(seed, *map(F.col, key)))
    h = h.withColumn("_p", F.substring("_h", 1, 3))
    n = h.groupBy("_p").agg(F.count("*").alias("_n"))
    every = Window.partitionBy(F.lit(1))
    n = n.select("_p", (F.sum("_n").over(every.orderBy("_p")) - F.col("_n")).alias("_before"), F.sum("_n").over(every).alias("_total"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy("_h", *key)) - 1
    return h.withColumn("_r", within).join(F.broadcast(n), "_p").select(*df.columns, (F.col("_r") + F.col("_before")).alias(out), "_total")  # 4096 rows


def score_blocks(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Per distinct score (within `by`): positives, rows, and both counted below it."""
    g = df.groupBy(*(by or []), F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    if by:
        w = Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
        return g.withColumn("n_below", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("pos_below", F.coalesce(F.sum("pos").over(w), F.lit(0)))
    return sums_before(g, "score", ["n", "pos"]).withColumnsRenamed({"n_before": "n_below", "pos_before": "pos_below"})


def auc(df: DataFrame, score: str, label: str, by: list[str] | None = None, digits: int = 9) -> DataFrame:
    """Rank AUC with ties at mid-rank; null if one class is missing."""
    by = by or []
    b = score_blocks(df, score, label, by)
    neg_below = F.col("n_below") - F.col("pos_below")
    wins2 = F.sum(F.col("pos") * (2 * neg_below + F.col("n") - F.col("pos")))
    g = (b.groupBy(*by) if by else b).agg(wins2.alias("w"), F.sum("pos").alias("n_pos"), F.sum(F.col("n") - F.col("pos")).alias("n_neg"))
    return g.select(*by, "n_pos", "n_neg", F.round(F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("w") / (2 * F.col("n_pos") * F.col("n_neg"))), digits).alias("auc"))


def mid_ranks(df: DataFrame, score: str, key: list[str], out: str = "rank") -> DataFrame:
    """key columns and the mid-rank of the score."""
    b = sums_before(df.groupBy(F.col(score).alias("_s")).agg(F.count("*").alias("n")), "_s", ["n"])
    return df.join(b, F.col(score) == F.col("_s")).select(*key, (F.col("n_before") + (F.col("n") + 1) / 2).alias(out))


def cumulative_share(df: DataFrame, value: str, out: str = "share", digits: int = 9) -> DataFrame:
    """df with the share of rows whose value is at most the row's."""
    b = sums_before(df.groupBy(F.col(value).alias("_s")).agg(F.count("*").alias("n")), "_s", ["n"])
    total = b.agg(F.sum("n").alias("_total"))
    b = b.crossJoin(F.broadcast(total)).select("_s", F.round((F.col("n_before") + F.col("n")) / F.col("_total"), digits).alias(out))  # one row
    return df.join(b, F.col(value) == F.col("_s")).drop("_s")


def rank_ensemble(df: DataFrame, scores: list[str], key: list[str], digits: int = 9) -> DataFrame:
    """key columns and the mean of the scores' mid-ranks, each over the number of rows."""
    n = df.agg(F.count("*").alias("_total"))
    out = df.select(*key)
    for i, s in enumerate(scores):
        out = out.join(mid_ranks(df, s, key, f"_r{i}"), key)
    return out.crossJoin(F.broadcast(n)).select(*key, F.round(sum((F.col(f"_r{i}") for i in range(len(scores))), F.lit(0.0)) / (F.col("_total") * len(scores)), digits).alias("ensemble"))  # one row


def _down(df: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score: rows and positives, those at or above it, and all."""
    b = sums_before(df.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n")), "score", ["pos", "n"], descending=True)
    whole = b.agg(F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n"))
    return b.crossJoin(F.broadcast(whole)).select("score", "pos", "n", (F.col("pos") + F.col("pos_before")).alias("up_pos"), (F.col("n") + F.col("n_before")).alias("up_n"), "all_pos", "all_n")  # one row


def roc_points(df: DataFrame, score: str, label: str, digits: int = 9) -> DataFrame:
    """One point for each distinct score, descending: score, tpr, fpr."""
    c = F.col
    return _down(df, score, label).select("score", F.round(c("up_pos") / c("all_pos"), digits).alias("tpr"), F.round((c("up_n") - c("up_pos")) / (c("all_n") - c("all_pos")), digits).alias("fpr"))


def average_precision(df: DataFrame, score: str, label: str, digits: int = 9) -> DataFrame:
    """Sum of precision times gain in recall over distinct thresholds; and Brier's score."""
    p = F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))
    brier = F.sum(F.col("pos") * (1 - p) * (1 - p) + (F.col("n") - F.col("pos")) * p * p) / F.sum("n")
    t = _down(df, score, label)
    return t.agg(F.round(F.sum(F.col("pos") * F.col("up_pos") / F.col("up_n")) / F.nullif(F.sum("pos"), F.lit(0)), digits).alias("average_precision"), F.round(brier, digits).alias("brier"))


def precision_at(df: DataFrame, score: str, label: str, ks: list[int], key: list[str], digits: int = 9) -> DataFrame:
    """k, precision among the k highest scores, ties by key; at most max(ks) rows are ranked."""
    top = df.orderBy(F.desc(score), *key).limit(max(ks)).select(F.col(label).cast("long").alias("y"), score, *key)
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc(score), *key)
    t = top.select(F.row_number().over(w).alias("k"), F.sum("y").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("hits"))
    return t.where(F.col("k").isin(*ks)).select("k", F.round(F.col("hits") / F.col("k"), digits).alias("precision"))


def reliability(df: DataFrame, score: str, label: str, bins: int = 5, digits: int = 9) -> DataFrame:
    """Per equal bin of a probability: n, mean score, actual rate and its interval."""
    g = df.groupBy(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("m"), F.sum(F.col(label).cast("long")).alias("k"))
    p, lo, hi = wilson(F.col("k"), F.col("n"))
    return g.select("bin", "n", F.round("m", digits).alias("mean_score"), *(F.round(x, digits).alias(c) for x, c in ((p, "rate"), (lo, "lo"), (hi, "hi"))))


def within_group_auc(df: DataFrame, group: str, score: str, label: str, least: int = 10, digits: int = 9) -> DataFrame:
    """One row: groups with enough rows and both classes; mean, median, share over .5 and weighted mean of their AUCs."""
    a = auc(df, score, label, [group], 15).where((F.col("n_pos") + F.col("n_neg") >= least) & F.col("auc").isNotNull()).withColumn("n", F.col("n_pos") + F.col("n_neg"))
    rd = lambda x, name: F.round(x, digits).alias(name)
    return a.agg(F.count("*").alias("n_groups"), rd(F.avg("auc"), "mean_auc"), rd(F.median("auc"), "median_auc"), rd(F.avg((F.col("auc") > 0.5).cast("int")), "share_over_half"), rd(F.sum(F.col("auc") * F.col("n")) / F.sum("n"), "weighted_auc"))


def concentration(df: DataFrame, key: str, n: str = "n", digits: int = 9) -> DataFrame:
    """Rank by n (ties by key) and the cumulative share."""
    w = Window.partitionBy(F.lit(1))
    order = w.orderBy(F.desc(n), key)
    return df.select(key, n, F.row_number().over(order).alias("rank"), F.round(F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(n).over(w), digits).alias("cum_share"))


def folds(df: DataFrame, key: list[str], k: int, seed: int) -> DataFrame:
    """fold (1 to k) of equal sizes (the first ones one more, if need be), by hash order."""
    t = hash_ranks(df, seed, key, "_rank")
    small, more = F.floor(F.col("_total") / k), F.pmod(F.col("_total"), F.lit(k))
    wide = more * (small + 1)
    fold = F.when(F.col("_rank") < wide, F.floor(F.col("_rank") / (small + 1))).otherwise(more + F.floor((F.col("_rank") - wide) / F.greatest(small, F.lit(1))))
    return t.withColumn("fold", (fold + 1).cast("int")).drop("_rank", "_total")


def binary_report(df: DataFrame, score: str, label: str, cut: float = 0.5, digits: int = 9) -> DataFrame:
    """One row: rows by class, AUC, average precision, Brier's score, and precision, recall and F1 of scores at or above the cut (0 without any)."""
    y, hit = F.col(label).cast("long"), F.col(score) >= cut
    n = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(y), F.lit(0)).alias("n_pos"), F.count_if(hit & (y == 1)).alias("tp"), F.count_if(hit).alias("guessed"))
    p, r = F.coalesce(F.try_divide("tp", "guessed"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "n_pos"), F.lit(0.0))
    rates = auc(df, score, label, digits=digits).select(F.col("auc").alias("auroc")).crossJoin(F.broadcast(average_precision(df, score, label, digits)))  # one row each
    one = n.crossJoin(F.broadcast(rates))
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    return one.select("n", "n_pos", (F.col("n") - F.col("n_pos")).alias("n_neg"), "auroc", F.when(both, F.col("average_precision")).alias("auprc"), "brier", F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), digits).alias("f1"))
