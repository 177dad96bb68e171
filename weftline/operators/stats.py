"""Stratified odds ratios, design-weighted means, agreement and confusion, all as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.numbers import Z, gap_hours, wilson

PRIME = (1 << 31) - 1


def rate_table(df: DataFrame, *by, flag: str = "conflict") -> DataFrame:
    """Per group: n, k and rate of a flag."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("k")).withColumn("rate", F.col("k") / F.col("n"))


def with_wilson(df: DataFrame, k: str = "k", n: str = "n", z: float = Z, digits: int = 9) -> DataFrame:
    p, lo, hi = wilson(F.col(k), F.col(n), z)
    return df.withColumns({"p": F.round(p, digits), "lo": F.round(lo, digits), "hi": F.round(hi, digits)})


def strata_cells(df: DataFrame, stratum: str, exposed: Column, outcome: Column) -> DataFrame:
    return df.groupBy(stratum).agg(*(c.alias(n) for n, c in zip("abcd", _cells(exposed, outcome), strict=True)))


def _cells(exposed: Column, outcome: Column) -> list[Column]:
    return [F.count_if(e & o) for e, o in ((exposed, outcome), (exposed, ~outcome), (~exposed, outcome), (~exposed, ~outcome))]


def mantel_haenszel(df: DataFrame, stratum: str, exposed: Column, outcome: Column, z: float = Z, digits: int = 9) -> DataFrame:
    """One row: pooled odds ratio over strata with four positive margins, its interval, and crude figures.

    The interval is that of Robins, Breslow and Greenland.  Crude cells are over the used strata.
    """
    return pooled_odds(strata_cells(df, stratum, F.coalesce(exposed, F.lit(False)), F.coalesce(outcome, F.lit(False))), [], z, digits)


def pooled_odds(cells: DataFrame, by: list[str], z: float = Z, digits: int = 9) -> DataFrame:
    """mantel_haenszel's figures from the cells a, b, c, d of each stratum, per group of `by`."""
    a, b, c, d = (F.col(x) for x in "abcd")
    used = cells.where((a + b > 0) & (c + d > 0) & (a + c > 0) & (b + d > 0)).withColumn("n", a + b + c + d)
    n = F.col("n").cast("double")
    r, s, p, q = a * d / n, b * c / n, (a + d) / n, (b + c) / n
    g = used.groupBy(*by).agg(
        F.count("*").alias("n_strata"), F.count_if((a * d > 0) | (b * c > 0)).alias("n_discordant"), *(F.sum(x).alias(x) for x in "abcd"),
        F.sum(r).alias("r"), F.sum(s).alias("s"), F.sum(p * r).alias("pr"), F.sum(p * s + q * r).alias("psqr"), F.sum(q * s).alias("qs"),
    )
    r, s = F.col("r"), F.col("s")
    ratio = F.when(s > 0, r / s)
    se = F.sqrt(F.when((r > 0) & (s > 0), F.col("pr") / (2 * r * r) + F.col("psqr") / (2 * r * s) + F.col("qs") / (2 * s * s)))
    crude = F.when((b > 0) & (c > 0), a * d / (b * c))
    rd = lambda x, name: F.round(x, digits).alias(name)
    return g.select(*by, "n_strata", "n_discordant", (a + b).alias("n_exposed"), (a + b + c + d).alias("n_used"), rd(ratio, "odds_ratio"), rd(ratio * F.exp(-z * se), "lo"), rd(ratio * F.exp(z * se), "hi"), rd(crude, "crude_or"))


def outcome_battery(flags: DataFrame) -> DataFrame:
    """The odds ratio of each contrast with the later request's merge; flags also has merged_later and pr_later.

    The flags are read once: counts go by later request, then by repository, and all contrasts are pooled together.
    Contrasts per request take one as exposed if any of its pairs is.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    every = F.lit(True)
    contrasts = {"conflict": (every, "conflict"), "dup_title": (every, "dup_title"), "fix_in_flight": (yes("conflict"), "fix_in_flight"), "near_miss": (~yes("conflict"), "near_miss"), "conflict_no_mega": (~yes("mega"), "conflict")}
    parts = [x.alias(f"{n}_{k}") for n, (who, e) in contrasts.items() for k, x in zip("abcd", [F.count_if(who & p & q) for p, q in ((yes(e), yes("merged_later")), (yes(e), ~yes("merged_later")), (~yes(e), yes("merged_later")), (~yes(e), ~yes("merged_later")))], strict=True)]
    ever = [F.bool_or(yes(c)).alias(f"ever_{c}") for c in ("conflict", "dup_title", "merged_later")]
    per = flags.groupBy("repo", "pr_later").agg(*parts, *ever)
    once = [x.alias(f"{c}_per_pr_{k}") for c in ("conflict", "dup_title") for k, x in zip("abcd", _cells(F.col(f"ever_{c}"), F.col("ever_merged_later")), strict=True)]
    names = [*contrasts, "conflict_per_pr", "dup_title_per_pr"]
    g = per.groupBy("repo").agg(*(F.sum(f"{n}_{k}").alias(f"{n}_{k}") for n in contrasts for k in "abcd"), *once)
    t = g.select("repo", F.inline(F.array(*(F.struct(F.lit(n).alias("contrast"), *(F.col(f"{n}_{k}").alias(k) for k in "abcd")) for n in names))))
    whole = flags.sparkSession.createDataFrame([(n,) for n in names], "contrast string")
    return whole.join(pooled_odds(t, ["contrast"]), "contrast", "left").fillna(0, ["n_strata", "n_discordant"])  # seven rows


def headlines(flags: DataFrame) -> DataFrame:
    """Shares of the outcome report with Wilson intervals, from one pass: headline, k, n, p, lo, hi.

    The intervals take pairs as independent; cluster_bootstrap gives those that do not.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    every, dup, bm = F.lit(True), yes("dup_title"), yes("bm_shared")
    hours = gap_hours(F.col("closed_a"), F.col("closed_b"))
    a, b = yes("merged_a"), yes("merged_b")
    shares = {
        "conflict_rate_all_pairs": (every, yes("conflict")), "conflict_rate_cross_agent": (yes("cross_agent"), yes("conflict")),
        "dup_both_merged": (dup, a & b), "dup_exactly_one_merged": (dup, a != b), "dup_neither_merged": (dup, ~a & ~b), "dup_no_shared_file": (dup, ~yes("conflict")),
        "both_merged_shared_gap_lt24h": (bm, F.coalesce(hours < 24, F.lit(False))),
    }
    one = flags.agg(*(F.count_if(w).alias(f"n_{h}") for h, (w, _) in shares.items()), *(F.count_if(w & k).alias(f"k_{h}") for h, (w, k) in shares.items()))
    rows = one.select(F.inline(F.array(*(F.struct(F.lit(h).alias("headline"), F.col(f"k_{h}").alias("k"), F.col(f"n_{h}").alias("n")) for h in shares))))
    return with_wilson(rows.where("n > 0"))


def design_weighted(df: DataFrame, y: str, pi: str, population: float | None = None, ratio: float = 50.0, digits: int = 9) -> DataFrame:
    """Hájek and Horvitz-Thompson means, Kish's effective size and weight figures; a share outside (0, 1] raises."""
    checked = df.withColumn("_w", 1 / F.when((F.col(pi) > 0) & (F.col(pi) <= 1), F.col(pi)).otherwise(F.raise_error(F.lit("inclusion shares must be in (0, 1]")).cast("double")))
    w, v = F.col("_w"), F.col(y).cast("double")
    med = checked.agg(F.median("_w").alias("_m"))
    g = checked.crossJoin(F.broadcast(med)).agg(  # one row
        F.count("*").alias("n"), F.sum(v * w).alias("yw"), F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"),
        F.min(w).alias("w_min"), F.max(w).alias("w_max"), F.first("_m").alias("w_median"), F.count_if(w >= F.col("_m") * ratio).alias("n_extreme"),
    )
    rd = lambda x, name: F.round(x, digits).alias(name)
    return g.select("n", rd(F.col("yw") / F.col("sw"), "hajek"), rd(F.col("yw") / (F.lit(population) if population else F.col("sw")), "horvitz_thompson"), rd(F.col("sw") ** 2 / F.col("sw2"), "n_eff"), rd(F.col("w_min"), "w_min"), rd(F.col("w_max"), "w_max"), rd(F.col("w_median"), "w_median"), "n_extreme")


def cohen_kappa(df: DataFrame, a: str, b: str, digits: int = 9) -> DataFrame:
    """n, raw agreement and kappa of two raters; null if chance agreement is whole or nothing is rated."""
    ok = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    both = ok.groupBy("a", "b").agg(F.count("*").alias("n"))
    side = lambda s: both.groupBy(F.col(s).alias("v")).agg(F.sum("n").alias(f"n{s}"))
    pe = side("a").join(side("b"), "v").agg(F.sum(F.col("na") * F.col("nb")).alias("pe"))
    g = both.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same")).crossJoin(F.broadcast(pe))  # one row
    n = F.col("n").cast("double")
    po, pe = F.col("same") / n, F.coalesce("pe", F.lit(0)) / (n * n)
    return g.select(F.coalesce("n", F.lit(0)).alias("n"), F.round(po, digits).alias("agreement"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)), digits).alias("kappa"))


def fleiss_kappa(ratings: DataFrame, item: str, label: str, digits: int = 9) -> DataFrame:
    """Of long ratings (item, label), all items rated equally often."""
    per = ratings.groupBy(item, label).agg(F.count("*").alias("n"))
    m = per.groupBy(item).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    p = m.agg(F.count("*").alias("items"), F.avg((F.col("n2") - F.col("m")) / (F.col("m") * (F.col("m") - 1))).alias("po"), F.sum("m").alias("total"))
    q = per.groupBy(label).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("q"))
    pe = F.col("q") / F.col("total").cast("double") / F.col("total").cast("double")
    return p.crossJoin(F.broadcast(q)).select("items", F.round(F.when(pe < 1, (F.col("po") - pe) / (1 - pe)), digits).alias("kappa"))  # one row


def krippendorff_alpha(ratings: DataFrame, item: str, label: str, digits: int = 9) -> DataFrame:
    """Nominal alpha of long ratings; nulls are missing, items rated once do not count."""
    per = ratings.where(F.col(label).isNotNull()).groupBy(item, label).agg(F.count("*").cast("double").alias("n"))
    m = per.groupBy(item).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("n2")).where("m > 1")
    observed = m.agg(F.sum((F.col("m") * F.col("m") - F.col("n2")) / (F.col("m") - 1)).alias("do"), F.sum("m").alias("total"))
    margins = per.join(m.select(item), item, "left_semi").groupBy(label).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("q"))
    t = F.col("total")
    de = (t * t - F.col("q")) / (t - 1)
    return observed.crossJoin(F.broadcast(margins)).select(t.cast("long").alias("n_values"), F.round(F.when(de > 0, 1 - F.col("do") / de), digits).alias("alpha"))  # one row


def crosstab(df: DataFrame, true: str, pred: str, labels: list[str]) -> DataFrame:
    """Counts over the full grid of labels, zeros filled."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "label_true string, label_pred string")
    n = df.groupBy(F.col(true).cast("string").alias("label_true"), F.col(pred).cast("string").alias("label_pred")).agg(F.count("*").alias("n"))
    return grid.join(n, ["label_true", "label_pred"], "left").fillna(0, ["n"])


def class_scores(df: DataFrame, true: str, pred: str, digits: int = 9) -> DataFrame:
    """Per class: support, precision, recall and F1; a zero denominator gives null."""
    t = df.select(F.col(true).cast("string").alias("t"), F.col(pred).cast("string").alias("p"))
    role = t.select(F.inline(F.array(F.struct(F.col("t").alias("label"), F.lit(1).alias("s"), F.lit(0).alias("g"), (F.col("t") == F.col("p")).cast("int").alias("h")), F.struct(F.col("p").alias("label"), F.lit(0).alias("s"), F.lit(1).alias("g"), F.lit(0).alias("h")))))
    g = role.groupBy("label").agg(F.sum("s").alias("support"), F.sum("g").alias("guessed"), F.sum("h").alias("hit"))
    p, r = F.try_divide(F.col("hit"), F.col("guessed")), F.try_divide(F.col("hit"), F.col("support"))
    return g.select("label", "support", F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), digits).alias("f1"))


def multiclass(df: DataFrame, true: str, pred: str, digits: int = 9) -> DataFrame:
    """One row: accuracy (also micro F1), balanced accuracy and macro F1 over the classes that have them."""
    per = class_scores(df, true, pred, 15).agg(F.avg("recall").alias("balanced"), F.avg("f1").alias("macro"))
    acc = df.agg(F.avg((F.col(true).cast("string") == F.col(pred).cast("string")).cast("int")).alias("accuracy"))
    return acc.crossJoin(F.broadcast(per)).select(F.round("accuracy", digits).alias("accuracy"), F.round("balanced", digits).alias("balanced_accuracy"), F.round("macro", digits).alias("macro_f1"), F.round("accuracy", digits).alias("micro_f1"))  # one row


def binary_confusion(df: DataFrame, positive: Column, flag: Column, digits: int = 9) -> DataFrame:
    """One row: TP, FP, FN, TN of a flag against a positive class, and the usual rates."""
    g = df.agg(F.count_if(flag & positive).alias("tp"), F.count_if(flag & ~positive).alias("fp"), F.count_if(~flag & positive).alias("fn"), F.count_if(~flag & ~positive).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    rd = lambda x, y, name: F.round(F.try_divide(x, y), digits).alias(name)
    return g.select("tp", "fp", "fn", "tn", rd(tp, tp + fp, "precision"), rd(tp, tp + fn, "recall"), rd(tn, tn + fp, "specificity"), rd(2 * tp, 2 * tp + fp + fn, "f1"), rd(fp, fp + tn, "fpr"), rd(fn, fn + tp, "fnr"))


def crude_odds(df: DataFrame, exposed: Column, outcome: Column, digits: int = 9) -> DataFrame:
    """One row: the outcome's rate with and without the exposure, over all rows, and the odds ratio of the two rates."""
    e, o = F.coalesce(exposed, F.lit(False)), F.coalesce(outcome, F.lit(False))
    g = df.agg(F.count_if(e).alias("n_exposed"), F.count_if(~e).alias("n_other"), F.count_if(e & o).alias("a"), F.count_if(~e & o).alias("c"))
    p, q = F.try_divide("a", "n_exposed"), F.try_divide("c", "n_other")
    return g.select("n_exposed", "n_other", F.round(p, digits).alias("rate_exposed"), F.round(q, digits).alias("rate_other"), F.round(F.try_divide(p * (1 - q), q * (1 - p)), digits).alias("odds_ratio"))


def overlap_by_category(df: DataFrame, label: str, flag: str, labels: list[str]) -> DataFrame:
    """Per label, those without rows too: n, and how many have the flag and do not."""
    every = df.sparkSession.createDataFrame([(x,) for x in labels], f"{label} string")
    g = df.groupBy(label).agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias("n_flag"), F.count_if(~F.col(flag)).alias("n_other"))
    return every.join(g, label, "left").fillna(0, ["n", "n_flag", "n_other"])


def cluster_bootstrap(df: DataFrame, cluster: str, y: str, iterations: int = 5000, seed: int = 20260824, level: float = 0.95, digits: int = 9) -> DataFrame:
    """Percentile interval of a mean over clusters drawn with replacement (Poisson weights from hashes).

    Only each cluster's sum and count enter; replicates are dealt over the cluster, and a cluster's weight in a
    replicate is the Poisson(1) quantile of a number that a hash of the cluster and the replicate's own give, so nothing depends on
    partitioning and reruns agree.
    """
    sums = df.groupBy(cluster).agg(F.sum(F.col(y).cast("double")).alias("s"), F.count("*").alias("n"))
    # Cumulative Poisson(1) probabilities.
    steps = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)
    # Numbers below a prime of 31 bits, squared twice between linear steps: products stay within 62 bits in any engine.
    part = lambda at: F.pmod(F.conv(F.substring("h", at, 12), 16, 10).cast("long"), F.lit(PRIME))
    sums = sums.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(cluster).cast("string")))).select("s", "n", part(1).alias("x"), part(13).alias("y"))
    it = F.col("it").cast("long")
    step = lambda z, k, c: (z * z % PRIME * k + c) % PRIME
    u = (step(step((F.col("x") + it * 1103515245) % PRIME, 48271, F.col("y")), 69621, it) + 0.5) / float(PRIME)
    weight = sum(((u > t).cast("int") for t in steps), F.lit(0))
    reps = sums.withColumn("it", F.explode(F.sequence(F.lit(1), F.lit(iterations)))).withColumn("w", weight).groupBy("it").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("m"))
    q = (1 - level) / 2
    point = sums.agg((F.sum("s") / F.sum("n")).alias("estimate"), F.count("*").alias("n_clusters"))
    return point.crossJoin(F.broadcast(reps.agg(F.percentile("m", F.array(F.lit(q), F.lit(1 - q))).alias("p")))).select(*(F.round(c, digits).alias(n) for n, c in (("estimate", F.col("estimate")), ("lo", F.col("p")[0]), ("hi", F.col("p")[1]))), "n_clusters")  # one row


def cluster_bootstrap_any(df: DataFrame, cluster: str, statistic, iterations: int = 200, seed: int = 20260824) -> DataFrame:
    """Replicates of any statistic of a pandas frame; rows carry weight, one group per replicate.

    Each replicate sees the whole table, so this is for tables that fit a task; means go by cluster_bootstrap.
    """
    import numpy as np

    def one(pdf):
        it = int(pdf["_it"].iloc[0])
        names = np.sort(pdf[cluster].unique())
        draw = np.random.Generator(np.random.PCG64([seed, it])).choice(names, len(names))
        rows = pdf.set_index(cluster, drop=False).drop(columns="_it")
        return __import__("pandas").DataFrame({"it": [it], "value": [float(statistic(rows.loc[draw]))]})

    return df.withColumn("_it", F.explode(F.sequence(F.lit(1), F.lit(iterations)))).groupBy("_it").applyInPandas(one, "it int, value double")
