"""Exactly weighted stratified samples, frames and leakage-free splits; all random order is by hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.config import Settings
from weftline.functions.text import order_hash
from weftline.operators.ranking import hash_ranks
from weftline.sources.scratch import settle

S = Settings()


def hamilton(sizes: DataFrame, key: str, size: str, n: int, least: int = 0) -> DataFrame:
    """key, size, quota: n seats by largest remainder over the sizes, none above its size; all if they fit.

    With `least`, each cell first takes as many (or all it has) and the rest goes by remaining size.  Floors of
    proportional shares never exceed a size, and a leftover seat goes to a cell that has room; so one pass is enough.
    """
    everything = Window.partitionBy(F.lit(1))
    t = sizes.select(key, F.col(size).cast("long").alias("size")).withColumn("base", F.least("size", F.lit(least)))
    t = t.withColumn("room", F.col("size") - F.col("base")).withColumn("free", F.greatest(F.lit(n) - F.sum("base").over(everything), F.lit(0)))
    t = t.withColumn("all", F.sum("room").over(everything))
    product = F.col("room") * F.col("free")
    t = t.withColumn("whole", F.when(F.col("all") <= F.col("free"), F.col("room")).otherwise(F.floor(product / F.greatest("all", F.lit(1))).cast("long")))
    t = t.withColumn("rem", F.when(F.col("whole") < F.col("room"), F.pmod(product, F.greatest("all", F.lit(1)))).otherwise(-1))
    t = t.withColumn("left", F.least(F.col("free"), F.col("all")) - F.sum("whole").over(everything))
    t = t.withColumn("turn", F.row_number().over(everything.orderBy(F.desc("rem"), key)))
    return t.select(key, "size", (F.col("base") + F.col("whole") + ((F.col("turn") <= F.col("left")) & (F.col("whole") < F.col("room"))).cast("long")).alias("quota"))


def draw(df: DataFrame, quotas: DataFrame, cell: str, key: list[str], seed: int = S.seed) -> DataFrame:
    """quota rows of each cell in hash order, and their inclusion share pi = quota / size.

    Rows are ranked only where the hash is below a share of its range that leaves twelve deviations and 60 rows of room above the quota.
    """
    order = Window.partitionBy(cell).orderBy("_h", *key)
    asked = df.join(F.broadcast(quotas.select(cell, "size", "quota")), cell).withColumn("_h", order_hash(seed, *map(F.col, key)))  # one row a cell
    share = (F.col("quota") + 12 * F.sqrt(F.col("quota").cast("double")) + 60) / F.col("size")
    near = asked.where(F.conv(F.substring("_h", 1, 13), 16, 10).cast("double") <= share * float(1 << 52))
    ranked = near.withColumn("_turn", F.row_number().over(order))
    return ranked.where(F.col("_turn") <= F.col("quota")).withColumn("pi", F.col("quota") / F.col("size")).drop("_turn", "_h", "size", "quota")


def cells(df: DataFrame, cell: str) -> DataFrame:
    return df.groupBy(cell).agg(F.count("*").alias("size"))


def prevalence_sample(flags: DataFrame, key: list[str], n: int = S.prevalence_n, least: int = S.prevalence_min, seed: int = S.seed) -> DataFrame:
    """Sample by mega x cross_agent x conflict: a minimum in each cell, the rest in proportion."""
    d = flags.withColumn("cell", F.concat_ws("|", *(F.col(c).cast("string") for c in ("mega", "cross_agent", "conflict"))))
    return draw(d, hamilton(cells(d, "cell"), "cell", "size", n, least), "cell", key, seed)


def enriched_sample(flags: DataFrame, key: list[str], targets: dict | None = None, census: int = S.census, seed: int = S.seed) -> DataFrame:
    """Sample by primary stratum and within it by mega, cross_agent and both_merged.

    A stratum without a target, cells of at most `census` rows, reverts and cross-agent candidates are taken whole
    (pi 1); the rest of a stratum's target is shared among its other cells in proportion.
    """
    targets = S.targets if targets is None else targets
    forced = (F.col("primary_stratum") == "revert") | F.col("cross_agent_candidate")
    d = flags.withColumn("cell", F.concat_ws("|", "primary_stratum", *(F.col(c).cast("string") for c in ("mega", "cross_agent", "both_merged")), F.when(forced, "census").otherwise("sampled")))
    t = F.element_at(F.create_map(*(F.lit(x) for k, v in targets.items() for x in (k, -1 if v is None else v))), F.col("primary_stratum"))
    c = d.groupBy("cell", "primary_stratum").agg(F.count("*").alias("size"), F.first(t).alias("target"))
    c = c.withColumn("whole", (F.col("target") < 0) | (F.col("size") <= census) | F.col("cell").endswith("|census"))
    w = Window.partitionBy("primary_stratum")
    c = c.withColumn("free", F.greatest(F.col("target") - F.sum(F.when(F.col("whole"), F.col("size")).otherwise(0)).over(w), F.lit(0)))
    c = c.withColumn("all", F.sum(F.when(F.col("whole"), 0).otherwise(F.col("size"))).over(w))
    product = F.col("size") * F.col("free")
    seats = F.when(F.col("all") <= F.col("free"), F.col("size")).otherwise(F.floor(product / F.greatest("all", F.lit(1))).cast("long"))
    c = c.withColumn("seats", F.when(F.col("whole"), F.lit(0)).otherwise(seats)).withColumn("rem", F.when(~F.col("whole") & (F.col("seats") < F.col("size")), F.pmod(product, F.greatest("all", F.lit(1)))).otherwise(-1))
    c = c.withColumn("left", F.least("free", "all") - F.sum("seats").over(w)).withColumn("turn", F.row_number().over(w.orderBy(F.desc("rem"), "cell")))
    quota = F.when(F.col("whole"), F.col("size")).otherwise(F.col("seats") + ((F.col("turn") <= F.col("left")) & (F.col("rem") >= 0)).cast("long"))
    return draw(d, c.select("cell", "size", quota.alias("quota")), "cell", key, seed)


def sample_audit(sample: DataFrame) -> DataFrame:
    """cell, rows drawn, inclusion share and the size it stands for."""
    return sample.groupBy("cell").agg(F.count("*").alias("n"), F.first("pi").alias("pi"), F.round(F.sum(1 / F.col("pi")), 6).alias("weight"))


def frame(prevalence: DataFrame, enriched: DataFrame, key: list[str], seed: int = S.seed) -> DataFrame:
    """Union of two samples with both shares (never one for the union), in hash order with a running frame_id."""
    p = prevalence.select(*key, F.col("pi").alias("pi_prevalence"), F.lit(True).alias("in_prevalence_sample"))
    e = enriched.select(*key, F.col("pi").alias("pi_enriched"), F.lit(True).alias("in_enriched_sample"))
    u = p.join(e, key, "full_outer").fillna(False, ["in_prevalence_sample", "in_enriched_sample"]).withColumn("incl_prob", F.col("pi_enriched"))
    return hash_ranks(u, seed, key, "frame_id").drop("_total").withColumn("frame_id", (F.col("frame_id") + 1).cast("int"))


def quota_sample(df: DataFrame, quotas: dict[str, tuple[Column, int]], total: int, key: list[str], seed: int = S.seed + 1) -> DataFrame:
    """For each name its quota of rows that fit, in hash order; rows drawn twice stay once; cut to the total, or topped up to it.

    `drawn` tells rows of the quotas from those of the top-up.  Each draw is a bounded top-k, taken in part by every task.
    """
    h = order_hash(seed, *map(F.col, key))
    first = lambda d, n: d.orderBy("_h", *key).limit(n)
    marks = {f"_q{i}": F.coalesce(cond, F.lit(False)) for i, (cond, _) in enumerate(quotas.values())}
    t = settle(df.withColumns({"_h": h, **marks}))
    parts = [first(t.where(f"_q{i}"), q) for i, (_, q) in enumerate(quotas.values())]
    drawn = settle(first(reduce(DataFrame.union, parts, t.limit(0)).dropDuplicates(key), total))  # no more rows than the total
    room = total - drawn.count()
    rest = first(t.join(F.broadcast(drawn.select(*key)), key, "left_anti"), room)
    return drawn.withColumn("drawn", F.lit(True)).unionByName(rest.withColumn("drawn", F.lit(False))).select(*df.columns, "drawn")


def repo_split(df: DataFrame, repo: str = "repo", test_share: float = S.test_share, min_train: int = S.min_train, dev_share: float = 0.2, seed: int = S.seed) -> DataFrame:
    """repo, n, split: whole repositories in hash order fill test up to its share of all rows, then dev up to its own, then train.

    What test has too many is not taken from dev.  Below min_train rows there is no train.
    """
    g = df.groupBy(repo).agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(1))
    order = everything.orderBy(order_hash(seed, F.col(repo)), repo).rowsBetween(Window.unboundedPreceding, -1)
    t = g.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).withColumn("total", F.sum("n").over(everything))
    share = lambda x: F.bround(F.col("total") * F.lit(float(x)))
    small = F.col("total") < min_train
    goal = F.when(small, F.least(F.greatest(share(test_share), F.lit(1.0)), F.col("total").cast("double"))).otherwise(share(test_share))
    t = t.withColumn("test", F.col("before") < goal)
    tested = F.coalesce(F.sum(F.when(F.col("test"), F.col("n"))).over(everything), F.lit(0))
    split = F.when(F.col("test"), "test").when(small | (F.col("before") - tested < share(dev_share)), "dev").otherwise("train")
    return t.withColumn("split", split).select(repo, "n", "split")


def framed(prevalence: DataFrame, enriched: DataFrame, flags: DataFrame, key: list[str], s: Settings = S, version: str = "v1") -> dict[str, DataFrame]:
    """The frame with its rows' columns and versions; a calibration sample of it; a validation sample apart from that; and the design's figures."""
    f = settle(frame(prevalence, enriched, key, s.seed).join(flags, key).withColumns({"dataset_version": F.lit(version), "config_version": F.lit(version)}))
    named = {k: F.col("conflict") if k == "overlap" else F.col("primary_stratum") == k for k in s.calibration}
    cal = quota_sample(f, {k: (c, s.calibration[k]) for k, c in named.items()}, s.calibration_n, key)
    val = f.join(F.broadcast(cal.select(*key)), key, "left_anti").withColumn("_h", order_hash(s.seed + 2, *map(F.col, key)))  # calibration_n rows
    val = val.orderBy("_h", *key).limit(s.validation_n).drop("_h")
    return {"frame": f, "calibration": cal, "validation": val, "design": design_report(f, cal, val, s)}


def design_report(f: DataFrame, calibration: DataFrame, validation: DataFrame, s: Settings = S) -> DataFrame:
    """One row a sample: rows, effective size, range and median of the weights, and how many are extreme; and rows of calibration and validation."""
    out = None
    for name in ("prevalence", "enriched"):
        w = f.where(f"in_{name}_sample").select((1 / F.col(f"pi_{name}")).alias("w"))
        med = w.agg(F.median("w").alias("m"))
        one = w.crossJoin(F.broadcast(med)).agg(F.count("*").alias("n"), F.round(F.sum("w") ** 2 / F.sum(F.col("w") * F.col("w")), 6).alias("n_eff"), F.min("w").alias("w_min"), F.first("m").alias("w_median"), F.max("w").alias("w_max"), F.count_if(F.col("w") >= F.col("m") * s.extreme).alias("n_extreme"))  # one row
        one = one.withColumn("sample", F.lit(name))
        out = one if out is None else out.unionByName(one)
    for name, d in (("frame", f), ("calibration", calibration), ("validation", validation)):
        out = out.unionByName(d.agg(F.count("*").alias("n")).withColumn("sample", F.lit(name)), allowMissingColumns=True)
    return out.fillna(0, ["n_extreme"]).select("sample", "n", "n_eff", "w_min", "w_median", "w_max", "n_extreme")


def cap_per_group(df: DataFrame, group: str, label: str, cap: int, key: list[str], seed: int = S.seed) -> DataFrame:
    """At most `cap` rows a group, half of each label as far as there are, in hash order."""
    w = Window.partitionBy(group, label).orderBy(order_hash(seed, *map(F.col, key)), *key)
    t = df.withColumn("_r", F.row_number().over(w))
    turn = F.row_number().over(Window.partitionBy(group).orderBy("_r", label, *key))
    return t.withColumn("_t", turn).where(F.col("_t") <= cap).drop("_r", "_t")


def judge_inputs(pairs: DataFrame, body_chars: int = S.body_chars, cap: int = S.file_cap) -> DataFrame:
    """Bodies cut, file lists sorted and capped, counts before the cap."""
    d = pairs
    for s in "ab":
        d = d.withColumn(f"n_files_{s}", F.size(f"files_{s}")).withColumn(f"files_{s}_text", F.array_join(F.slice(F.array_sort(F.array_distinct(f"files_{s}")), 1, cap), "\n"))
        if f"body_{s}" in d.columns:
            d = d.withColumn(f"body_{s}", F.substring(F.coalesce(f"body_{s}", F.lit("")), 1, body_chars))
    return d.withColumn("files_shared", F.array_join(F.slice(F.array_sort(F.array_intersect("files_a", "files_b")), 1, cap), "\n"))
