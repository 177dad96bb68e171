"""Invariants as one aggregate a table, and audit reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.config import LABELS, STRATA


class InvariantError(ValueError):
    """Raised in strict mode with all violations."""


def violations(df: DataFrame, rules: dict[str, Column], key: list[str] | None = None, strict: bool = False) -> DataFrame:
    """check, n: how many rows break each rule, and how many keys repeat."""
    one = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(rules.values())))
    out = one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check"), F.col(f"c{i}").alias("n")) for i, n in enumerate(rules)))))
    if key:
        dup = df.groupBy(*key).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_key").alias("check"), "n")
        out = out.unionByName(dup)
    if strict:
        bad = [f"{r['check']}: {r['n']}" for r in out.where("n > 0").collect()]
        if bad:
            raise InvariantError("; ".join(bad))
    return out


def require_columns(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise InvariantError(f"missing columns: {missing}")


def pair_rules() -> dict[str, Column]:
    c = F.col
    return {"null_key": c("repo").isNull() | c("pr_a").isNull() | c("pr_b").isNull(), "self_pair": c("pr_a") == c("pr_b"), "opened_out_of_order": c("opened_b") < c("opened_a"), "null_conflict": c("conflict").isNull(), "conflict_differs": c("conflict") != F.arrays_overlap("files_a", "files_b"), "cross_agent_differs": c("cross_agent") != (c("agent_a") != c("agent_b"))}


def flag_rules() -> dict[str, Column]:
    c = F.col
    return {"near_miss_with_conflict": c("near_miss") & c("conflict"), "bm_shared_without_conflict": c("bm_shared") & ~c("conflict"), "fix_in_flight_without_conflict": c("fix_in_flight") & ~c("conflict"), "unknown_stratum": ~c("primary_stratum").isin(*STRATA) | c("primary_stratum").isNull()}


def share_rules(pi: str) -> dict[str, Column]:
    return {f"{pi}_out_of_range": F.col(pi).isNull() | (F.col(pi) <= 0) | (F.col(pi) > 1)}


def label_rules(label: str, labels=LABELS) -> dict[str, Column]:
    return {f"unknown_{label}": F.col(label).isNull() | ~F.col(label).isin(*labels)}


def audit(sections: dict[str, DataFrame], warn: tuple[str, ...] = ()) -> DataFrame:
    """section, check, n, status of several violation tables."""
    out = None
    for name, df in sections.items():
        d = df.select(F.lit(name).alias("section"), "check", "n")
        out = d if out is None else out.unionByName(d)
    status = F.when(F.col("n") == 0, "PASS").when(F.col("check").isin(*warn), "WARN").otherwise("FAIL") if warn else F.when(F.col("n") == 0, "PASS").otherwise("FAIL")
    return out.withColumn("status", status)


# Sections of the audit, in order.
SECTIONS = ("data", "pools", "sampling", "gold", "judge", "static_analysis", "benchmark", "reproducibility")


def full_audit(pairs: DataFrame, flags: DataFrame | None = None, frame: DataFrame | None = None, gold: DataFrame | None = None, judged: DataFrame | None = None, evidence: DataFrame | None = None, splits: DataFrame | None = None, manifest: dict | None = None, strict: bool = False) -> DataFrame:
    """section, check, n, status over eight sections.  What a section needs and is not there is a warning, but a missing manifest is a failure if strict.

    gold: item, label; judged: item, category, raw_text; evidence: repo, pr_a, pr_b; splits: repo, split.
    """
    spark, key = pairs.sparkSession, ["repo", "pr_a", "pr_b"]
    one = lambda name, n: spark.createDataFrame([(name, int(n))], "check string, n long")
    absent = lambda name: one(f"{name}_missing", 1)
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    outside = lambda df, name: count(df.join(pairs.select(*key), key, "left_anti"), name)
    parts: dict[str, list[DataFrame]] = {s: [] for s in SECTIONS}
    parts["data"].append(violations(pairs, pair_rules(), key))
    parts["pools"].append(violations(flags, flag_rules()) if flags is not None else absent("flags"))
    if frame is None:
        parts["sampling"].append(absent("frame"))
    else:
        parts["sampling"] += [violations(frame, {"frame_id_null": F.col("frame_id").isNull()}, ["frame_id"]), outside(frame, "outside_population")]
        for name in ("enriched", "prevalence"):
            parts["sampling"].append(violations(frame.where(f"in_{name}_sample"), share_rules(f"pi_{name}")))
    parts["gold"].append(violations(gold, label_rules("label"), ["item"]) if gold is not None else absent("gold"))
    parts["judge"].append(violations(judged, {"raw_missing": F.col("raw_text").isNull(), **label_rules("category")}, ["item"]) if judged is not None else absent("judge"))
    parts["static_analysis"].append(outside(evidence.select(*key).distinct(), "evidence_outside_population") if evidence is not None else absent("evidence"))
    if splits is None:
        parts["benchmark"].append(absent("splits"))
    else:
        both = splits.groupBy("repo").agg(F.countDistinct("split").alias("k")).where("k > 1")
        parts["benchmark"].append(count(both, "repo_in_two_splits"))
    if manifest is None:
        parts["reproducibility"].append(one("manifest_absent" if strict else "manifest_missing", 1))
    else:
        for name in ("git_commit", "inputs", "row_counts", "pool_counts"):
            parts["reproducibility"].append(one(f"{name}_empty" if name != "git_commit" else "git_commit_missing", not manifest.get(name)))
    out = None
    for section, tables in parts.items():
        for d in tables:
            d = d.select(F.lit(section).alias("section"), "check", "n")
            out = d if out is None else out.unionByName(d)
    status = F.when(F.col("n") == 0, "PASS").when(F.col("check").endswith("_missing") & ~F.col("check").isin("raw_missing"), "WARN").otherwise("FAIL")
    return out.withColumn("status", status)


def exit_code(report: DataFrame) -> int:
    return int(not report.where("status = 'FAIL'").isEmpty())


def status_coverage(pairs: DataFrame, status: DataFrame, by: str) -> DataFrame:
    """Per slice: pairs, those whose two requests were both fetched, and their share; a request without a status was not."""
    ok = status.groupBy("repo", "pr").agg(F.bool_or("ok").alias("ok"))
    side = lambda s: ok.select("repo", F.col("pr").alias(f"pr_{s}"), F.col("ok").alias(f"ok_{s}"))
    j = pairs.join(side("a"), ["repo", "pr_a"], "left").join(side("b"), ["repo", "pr_b"], "left")
    both = F.coalesce(F.col("ok_a") & F.col("ok_b"), F.lit(False))
    g = j.groupBy(by).agg(F.count("*").alias("n"), F.count_if(both).alias("n_both_ok"))
    return g.withColumn("share", F.round(F.col("n_both_ok") / F.col("n"), 9))


def replay_check(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """Per repository: labelled conflicts, and those that a replay of its intervals finds anew; equal if the machinery holds.

    `shared` has repo, pr_a, pr_b of all requests with a common file, smaller number first.
    """
    side = lambda s: pairs.select("repo", F.col(f"pr_{s}").alias("pr"), F.col(f"opened_{s}").alias("opened"), F.col(f"closed_{s}").alias("closed"))
    spans = side("a").union(side("b")).dropDuplicates(["repo", "pr"])
    one = lambda s: spans.select("repo", F.col("pr").alias(f"pr_{s}"), F.col("opened").alias(f"o_{s}"), F.col("closed").alias(f"c_{s}"))
    j = shared.select("repo", "pr_a", "pr_b").join(one("a"), ["repo", "pr_a"]).join(one("b"), ["repo", "pr_b"])
    again = j.where(F.greatest("o_a", "o_b") < F.least("c_a", "c_b")).groupBy("repo").agg(F.count("*").alias("replayed"))
    known = pairs.groupBy("repo").agg(F.count_if("conflict").alias("labeled"))
    return known.join(again, "repo", "left").fillna(0, ["replayed"]).withColumn("same", F.col("labeled") == F.col("replayed"))


def check_values(got: dict[str, float], want: dict[str, float], tolerance: float = 1e-9) -> list[str]:
    """Names of figures that are missing or differ by more than the tolerance, with both values."""
    off = lambda k: k not in got or got[k] is None or abs(got[k] - want[k]) > tolerance
    return [f"{k}: {got.get(k)}, not {want[k]}" for k in sorted(want) if off(k)]
