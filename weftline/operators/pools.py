"""Pools of candidate pairs: flags, strata, counts, reconciliation and threshold sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.config import Settings
from weftline.functions import paths as P
from weftline.functions import text as X

S = Settings()


def later_is_b() -> Column:
    return F.coalesce(F.col("opened_b") >= F.col("opened_a"), F.lit(False))


def pool_flags(pairs: DataFrame, mega: list | DataFrame, s: Settings = S) -> DataFrame:
    """The flags of each pair (titles, files, outcomes of both sides in its columns), and its primary stratum.

    mega: the repositories that count as such, or a table of a few (column repo).
    """
    if isinstance(mega, DataFrame):
        pairs = pairs.join(F.broadcast(mega.select("repo", F.lit(True).alias("mega"))), "repo", "left")  # as many rows as were asked for
        is_mega = F.coalesce("mega", F.lit(False))
    else:
        is_mega = F.col("repo").isin(*mega) if mega else F.lit(False)
    na, nb = X.normalize_title(F.col("title_a")), X.normalize_title(F.col("title_b"))
    d = pairs.withColumns({"norm_a": na, "norm_b": nb, "merged_a": F.coalesce("merged_a", F.lit(False)), "merged_b": F.coalesce("merged_b", F.lit(False))})
    key = lambda p: P.directory_key(p, s.near_depth)
    near = F.when(F.col("conflict"), False).otherwise(F.arrays_overlap(P.key_set(F.col("files_a"), key), P.key_set(F.col("files_b"), key)))
    d = d.withColumns(
        {
            "dup_title": X.is_duplicate_title(F.col("norm_a"), F.col("norm_b"), s),
            "revert": X.has_revert(F.col("title_a"), s) | X.has_revert(F.col("title_b"), s),
            "fix_in_flight": F.col("conflict") & X.has_fix_word(F.when(later_is_b(), F.col("norm_b")).otherwise(F.col("norm_a")), s),
            "both_merged": F.col("merged_a") & F.col("merged_b"),
            "bm_shared": F.col("merged_a") & F.col("merged_b") & F.col("conflict"),
            "mega": is_mega,
            "near_miss": F.coalesce(near, F.lit(False)),
        }
    )
    return d.withColumns({"primary_stratum": primary_stratum(), "cross_agent_candidate": F.col("cross_agent") & (F.col("bm_shared") | F.col("dup_title") | F.col("revert"))})


def primary_stratum() -> Column:
    """First flag that holds, in a fixed order."""
    return F.when(F.col("revert"), "revert").when(F.col("dup_title"), "dup").when(F.col("fix_in_flight"), "fix_in_flight").when(F.col("bm_shared"), "bm_shared").when(F.col("conflict"), "overlap_other").when(F.col("near_miss"), "near_miss").otherwise("control")


POOLS = ("conflict", "dup_title", "revert", "fix_in_flight", "near_miss", "both_merged", "bm_shared", "cross_agent", "cross_agent_candidate", "mega")


def pool_counts(flags: DataFrame) -> DataFrame:
    """One row: pairs, repos and the size of each pool."""
    return flags.agg(F.count("*").alias("n_pairs"), F.countDistinct("repo").alias("n_repos"), *(F.count_if(F.col(c)).alias(f"n_{c}") for c in POOLS))


def near_miss_variants() -> dict[str, Column]:
    """Whether two disjoint file sets share a directory key, for each reading of the key."""
    keys = {
        "canonical": lambda p: P.directory_key(p, 2),
        "with_name": lambda p: P.directory_key(p, 2, "<root>", True),
        "dirs_only": lambda p: P.deep_key(p, 2),
        "depth1": lambda p: P.directory_key(p, 1),
        "depth2_root": lambda p: P.directory_key(p, 2, "<root>"),
        "depth3": lambda p: P.directory_key(p, 3),
        "same_parent": P.parent_directory,
    }
    return {n: ~F.col("conflict") & F.arrays_overlap(P.key_set(F.col("files_a"), k), P.key_set(F.col("files_b"), k)) for n, k in keys.items()}


def near_miss_sweep(pairs: DataFrame) -> DataFrame:
    """One row: disjoint pairs, and those near under each reading."""
    v = near_miss_variants()
    d = pairs.select("conflict", *(c.alias(n) for n, c in v.items()))
    return d.agg(F.count_if(~F.col("conflict")).alias("n_disjoint"), *(F.count_if(F.col(n)).alias(f"n_{n}") for n in v))


def duplicate_title_sweep(pairs: DataFrame, steps=(0.3, 0.4, 0.5, 0.6, 0.7, 0.8), s: Settings = S) -> DataFrame:
    """threshold, n: similar titles at each step, from one pass over the similarities."""
    ta, tb = (X.title_tokens(X.normalize_title(F.col(c))) for c in ("title_a", "title_b"))
    j = pairs.select(X.jaccard(ta, tb, 1.0).alias("j"), ((F.size(ta) >= s.dup_min_tokens) & (F.size(tb) >= s.dup_min_tokens)).alias("enough"))
    one = j.agg(*(F.count_if(F.col("enough") & (F.col("j") >= t)).alias(f"n{i}") for i, t in enumerate(steps)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"n{i}").alias("n")) for i, t in enumerate(steps)))))


def later_outcome(pairs: DataFrame) -> DataFrame:
    pick = lambda x, y: F.when(later_is_b(), F.col(x)).otherwise(F.col(y))
    return pairs.withColumns({"pr_later": pick("pr_b", "pr_a"), "merged_later": F.coalesce(pick("merged_b", "merged_a"), F.lit(False)), "merged_earlier": F.coalesce(pick("merged_a", "merged_b"), F.lit(False))})


def largest_repos(pairs: DataFrame, n: int = 2) -> DataFrame:
    """The n repos with the most pairs, ties by key."""
    return pairs.groupBy("repo").count().orderBy(F.desc("count"), "repo").limit(n).select("repo")


def pending_repos(pairs: DataFrame, done: DataFrame | None, key: list[str], n: int | None = None) -> DataFrame:
    """repo, pending: repos by the number of pairs whose key is not done yet; the first n of them."""
    left = pairs if done is None else pairs.join(done.select(*key).distinct(), key, "left_anti")
    order = left.groupBy("repo").agg(F.count("*").alias("pending")).orderBy(F.desc("pending"), "repo")
    return order if n is None else order.limit(n)


def near_miss_examples(pairs: DataFrame, key: list[str], names: tuple[str, ...] = ("canonical", "with_name", "dirs_only", "depth1", "depth3"), most: int = 15) -> DataFrame:
    """Up to `most` disjoint pairs, by key, on which readings of the directory key differ from the first one named."""
    v = near_miss_variants()
    d = pairs.where(~F.col("conflict")).select(*key, "files_a", "files_b", *(F.coalesce(v[n], F.lit(False)).alias(n) for n in names))
    differ = [F.col(n) != F.col(names[0]) for n in names[1:]]
    return d.where(reduce(lambda x, y: x | y, differ)).orderBy(*key).limit(most)
