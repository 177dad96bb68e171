"""Queries on rates, distributions, odds ratios and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.config import LABELS, SPEC_CONFIG, Settings
from weftline.functions import numbers as N
from weftline.functions import paths as P
from weftline.operators import annotate
from weftline.operators import stats as S
from weftline.operators.ranking import cumulative_share
from weftline.plans import binding as B
from weftline.plans.binding import with_parts as w
from weftline.plans.joins import _MID, _SPANS, PAIR
from weftline.plans.pools import _CLASS, _NAMES, flags, wf
from weftline.plans.ranks import scored
from weftline.plans.registry import query
from weftline.sources.scratch import settle

Z = "1.959963984540054"


def q_wilson(k, n):
    p, z = f"(CAST({k} AS DOUBLE) / {n})", Z
    c, s, d = f"({p} + {z}::DOUBLE * {z} / (2.0 * {n}))", f"({z}::DOUBLE * sqrt({p} * (1 - {p}) / {n} + {z}::DOUBLE * {z} / (4.0 * {n} * {n})))", f"(1 + {z}::DOUBLE * {z} / {n})"
    return f"round({p}, 9) AS p, round(greatest(0, ({c} - {s}) / {d}), 9) AS lo, round(least(1, ({c} + {s}) / {d}), 9) AS hi"


def q_bins(x, edges, labels):
    inf = float("inf")
    return "CASE " + " ".join(f"WHEN {x} >= {lo}" + (f" AND {x} < {hi}" if hi != inf else "") + f" THEN '{label}'" for lo, hi, label in zip(edges[:-1], edges[1:], labels, strict=True)) + " END"


HOURS = "(greatest(0, epoch_us(least(closed_a, closed_b)) - epoch_us(greatest(opened_a, opened_b))) / 3600000000)"


@query(w(f"SELECT agent_1, agent_2, n, k, CASE WHEN n >= 100 THEN p END AS rate, lo, hi FROM (SELECT *, {q_wilson('k', 'n')} FROM (SELECT least(agent_a, agent_b) AS agent_1, greatest(agent_a, agent_b) AS agent_2, count(*) AS n, count(*) FILTER (conflict) AS k FROM labeled GROUP BY 1, 2))", "labeled"))
def agent_matrix(spark, sf):
    d = S.with_wilson(S.rate_table(B.labeled(spark, sf), F.least("agent_a", "agent_b").alias("agent_1"), F.greatest("agent_a", "agent_b").alias("agent_2")))
    return d.select("agent_1", "agent_2", "n", "k", F.when(F.col("n") >= 100, F.col("p")).alias("rate"), "lo", "hi")


@query(w(f"SELECT *, {q_wilson('k', 'n')} FROM (SELECT {q_bins(HOURS, *N.DURATION)} AS bin, count(*) AS n, count(*) FILTER (conflict) AS k FROM labeled GROUP BY 1)", "labeled"))
def dose_duration(spark, sf):
    h = N.overlap_hours(*map(F.col, ("opened_a", "closed_a", "opened_b", "closed_b")))
    return S.with_wilson(S.rate_table(B.labeled(spark, sf), N.binned(h, *N.DURATION).alias("bin"))).drop("rate")


@query(w(f"SELECT *, {q_wilson('k', 'n')} FROM (SELECT {q_bins('concurrency', *N.CONCURRENCY)} AS bin, count(*) AS n, count(*) FILTER (conflict) AS k FROM (SELECT conflict, (SELECT count(*) FROM spans s WHERE s.repo = p.repo AND epoch_us(s.opened) <= at_us AND epoch_us(s.closed) >= at_us) AS concurrency FROM mid p JOIN labeled l ON l.repo = p.repo AND l.pr_a = p.pr_a AND l.pr_b = p.pr_b) GROUP BY 1)", "labeled", spans=_SPANS, mid=_MID))
def dose_concurrency(spark, sf):
    from weftline.operators.coactive import concurrency_at, intervals

    p = B.labeled(spark, sf)
    at = p.select(*PAIR, "conflict", N.midpoint(*map(F.col, ("opened_a", "closed_a", "opened_b", "closed_b"))).alias("at"))
    d = concurrency_at(at, intervals(B.pairs(spark, sf)))
    return S.with_wilson(S.rate_table(d, N.binned(F.col("concurrency"), *N.CONCURRENCY).alias("bin"))).drop("rate")


@query(w("SELECT count(*) AS n, round(avg(s), 9) AS mean, median(s) AS med, quantile_cont(s, 0.9) AS p90, quantile_cont(s, 0.99) AS p99, CAST(max(s) AS INT) AS most, count(*) FILTER (s = 1) AS n1, count(*) FILTER (s = 2) AS n2, count(*) FILTER (s = 3) AS n3, count(*) FILTER (s > 3) AS n4 FROM (SELECT len(list_intersect(files_a, files_b)) AS s FROM labeled WHERE conflict)", "labeled"))
def shared_dist(spark, sf):
    s = F.col("s")
    d = B.labeled(spark, sf).where("conflict").select(F.size(F.array_intersect("files_a", "files_b")).alias("s"))
    return d.agg(F.count("*").alias("n"), F.round(F.avg("s"), 9).alias("mean"), F.median("s").alias("med"), F.percentile("s", F.lit(0.9)).alias("p90"), F.percentile("s", F.lit(0.99)).alias("p99"), F.max("s").alias("most"), F.count_if(s == 1).alias("n1"), F.count_if(s == 2).alias("n2"), F.count_if(s == 3).alias("n3"), F.count_if(s > 3).alias("n4"))


# Files of both sides, with a name of each class among them.
_NAMED = f"SELECT repo, pr_a, pr_b, list_intersect(list_append(files_a, {_NAMES}[(pr_a % 12) + 1]), list_append(files_b, {_NAMES}[(pr_b % 12) + 1])) AS s FROM labeled"
_CLASSED = f"SELECT repo, pr_a, pr_b, {_CLASS} AS class FROM (SELECT repo, pr_a, pr_b, lower(p) AS low, string_split(lower(p), '/')[-1] AS name FROM (SELECT repo, pr_a, pr_b, unnest(s) AS p FROM named))"
_SPEC = f"class IN ({', '.join(repr(c) for c in SPEC_CONFIG)})"


def classed(spark, sf):
    """Shared files of each pair as classes."""
    name = lambda c: F.element_at(F.array(*(F.lit(x.strip().strip("'")) for x in _NAMES.strip("[]").split(", "))), (F.col(c) % 12 + 1).cast("int"))
    s = F.array_intersect(F.array_append("files_a", name("pr_a")), F.array_append("files_b", name("pr_b")))
    d = B.labeled(spark, sf).select(*PAIR, s.alias("s")).where(F.size("s") > 0)
    return d.select(*PAIR, F.transform("s", P.file_class).alias("classes"))


@query(w(f"SELECT count(*) AS n, CAST(count(*) FILTER (spec) AS BIGINT) AS n_pure_config, CAST(count(*) FILTER (src) AS BIGINT) AS n_any_source, CAST(count(*) FILTER (NOT spec) AS BIGINT) AS n_any_other, round(count(*) FILTER (spec) / count(*), 9) AS pure_config_rate, round(count(*) FILTER (src) / count(*), 9) AS source_rate FROM (SELECT bool_and({_SPEC}) AS spec, bool_or(class = 'source') AS src FROM classed GROUP BY repo, pr_a, pr_b)", "labeled", named=_NAMED, classed=_CLASSED))
def composition(spark, sf):
    """Pairs by the classes of the files they share: configuration alone, any source, anything else."""
    spec = F.forall("classes", lambda c: c.isin(*SPEC_CONFIG))
    source = F.exists("classes", lambda c: c == "source")
    g = classed(spark, sf).agg(F.count("*").alias("n"), F.count_if(spec).alias("n_pure_config"), F.count_if(source).alias("n_any_source"), F.count_if(~spec).alias("n_any_other"))
    return g.select("*", F.round(F.col("n_pure_config") / F.col("n"), 9).alias("pure_config_rate"), F.round(F.col("n_any_source") / F.col("n"), 9).alias("source_rate"))


@query(w("SELECT class, count(*) AS n FROM classed GROUP BY 1", "labeled", named=_NAMED, classed=_CLASSED))
def shared_classes(spark, sf):
    """How many shared files there are of each class."""
    return classed(spark, sf).select(F.explode("classes").alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query(w("SELECT language, count(*) AS n, count(*) FILTER (spec) AS n_pure_config FROM (SELECT repo, bool_and(" + _SPEC + ") AS spec FROM classed GROUP BY repo, pr_a, pr_b) JOIN repositories USING (repo) GROUP BY 1", "labeled", "repositories", named=_NAMED, classed=_CLASSED))
def composition_by_language(spark, sf):
    d = classed(spark, sf).join(B.repositories(spark, sf), "repo")
    return d.groupBy("language").agg(F.count("*").alias("n"), F.count_if(F.forall("classes", lambda c: c.isin(*SPEC_CONFIG))).alias("n_pure_config"))


@query(w("SELECT name, count(*) AS n FROM (SELECT string_split(x.path, '/')[-1] AS name FROM pairs p JOIN files x ON x.pr = pr_a JOIN files y ON y.pr = pr_b AND x.path = y.path) GROUP BY 1 ORDER BY n DESC, name LIMIT 12", "pairs", "files"))
def hot_files(spark, sf):
    d = B.labeled(spark, sf).where("conflict").select(F.explode(F.array_intersect("files_a", "files_b")).alias("path")).select(P.basename(F.col("path")).alias("name"))
    return d.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(12)


@query(w("SELECT repo, n, row_number() OVER (ORDER BY n DESC, repo) AS rank, round(sum(n) OVER (ORDER BY n DESC, repo ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 9) AS cum_share FROM (SELECT repo, count(*) AS n FROM labeled WHERE conflict GROUP BY 1)", "labeled"))
def concentration(spark, sf):
    from weftline.operators.ranking import concentration as c

    return c(B.labeled(spark, sf).where("conflict").groupBy("repo").agg(F.count("*").alias("n")), "repo").withColumn("rank", F.col("rank").cast("long"))


_GAP = "SELECT repo, pr_a, pr_b, mega, abs(epoch_us(closed_a) - epoch_us(closed_b)) / 3600000000 AS gap FROM flags WHERE dup_title"


@query(wf("SELECT count(*) AS n, median(gap) AS med, quantile_cont(gap, 0.25) AS p25, quantile_cont(gap, 0.75) AS p75, quantile_cont(gap, 0.9) AS p90, count(*) FILTER (gap < 24) AS n_day, count(*) FILTER (gap < 72) AS n_3days, round(avg(gap), 9) AS mean, count(*) FILTER (gap < 1) AS n_hour, count(*) FILTER (gap < 24 AND NOT mega) AS n_day_no_mega, count(*) FILTER (NOT mega) AS n_no_mega FROM gaps", gaps=_GAP))
def close_gap_stats(spark, sf):
    g = N.gap_hours(F.col("closed_a"), F.col("closed_b"))
    d = flags(spark, sf).where("dup_title").select(g.alias("gap"), "mega")
    q = lambda x: F.percentile("gap", F.lit(x))
    return d.agg(F.count("*").alias("n"), F.median("gap").alias("med"), q(0.25).alias("p25"), q(0.75).alias("p75"), q(0.9).alias("p90"), F.count_if(F.col("gap") < 24).alias("n_day"), F.count_if(F.col("gap") < 72).alias("n_3days"), F.round(F.avg("gap"), 9).alias("mean"), F.count_if(F.col("gap") < 1).alias("n_hour"), F.count_if((F.col("gap") < 24) & ~F.col("mega")).alias("n_day_no_mega"), F.count_if(~F.col("mega")).alias("n_no_mega"))


@query(wf("SELECT repo, count(*) AS n FROM flags WHERE dup_title GROUP BY 1 ORDER BY n DESC, repo LIMIT 5"))
def dup_top_repos(spark, sf):
    """The five repositories with the most pairs of alike titles."""
    return flags(spark, sf).where("dup_title").groupBy("repo").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "repo").limit(5)


@query(wf("SELECT repo, pr_a, pr_b, gap, round(cume_dist() OVER (ORDER BY gap), 9) AS share FROM gaps", gaps=_GAP))
def close_gap_ecdf(spark, sf):
    g = N.gap_hours(F.col("closed_a"), F.col("closed_b"))
    return cumulative_share(settle(flags(spark, sf).where("dup_title").select(*PAIR, g.alias("gap"))), "gap")


@query(w("SELECT coalesce(language, 'All') AS language, count(*) AS n, count(*) FILTER (conflict) AS k, CAST(count(*) FILTER (merged_a AND merged_b) AS BIGINT) AS n_both_merged FROM labeled l JOIN repositories r ON r.repo = l.repo GROUP BY ROLLUP (language)", "labeled", "repositories"))
def language_rollup(spark, sf):
    d = B.labeled(spark, sf).join(B.repositories(spark, sf), "repo")
    r = d.rollup("language").agg(F.count("*").alias("n"), F.count_if("conflict").alias("k"), F.count_if(F.col("merged_a") & F.col("merged_b")).alias("n_both_merged"))
    return r.withColumn("language", F.coalesce("language", F.lit("All")))


_STARS = "CASE WHEN stars > -1 AND stars <= 10 THEN '0-10' WHEN stars > 10 AND stars <= 100 THEN '11-100' WHEN stars > 100 AND stars <= 1000 THEN '101-1k' WHEN stars > 1000 THEN '>1k' END"


@query(w(f"SELECT bin, n, k, k / n AS rate FROM (SELECT {_STARS} AS bin, count(*) AS n, count(*) FILTER (conflict) AS k FROM labeled l JOIN repositories r ON r.repo = l.repo GROUP BY 1)", "labeled", "repositories"))
def stars_bins(spark, sf):
    d = B.labeled(spark, sf).join(B.repositories(spark, sf), "repo")
    return S.rate_table(d, N.binned(F.col("stars"), *N.STARS, right=True).alias("bin"))


_SLICES = {"full": "true", "no_mega": "NOT mega", "cross_agent": "cross_agent", "same_agent": "NOT cross_agent", "near_or_dup": "near_miss OR dup_title"}


@query(wf(" UNION ALL ".join(f"SELECT '{k}' AS slice, *, {q_wilson('k', 'n')} FROM (SELECT count(*) FILTER ({c}) AS n, count(*) FILTER (({c}) AND both_merged) AS k FROM flags)" for k, c in _SLICES.items())))
def slice_matrix(spark, sf):
    """Merge rates of overlapping slices, all from one pass."""
    f = flags(spark, sf)
    one = f.agg(*(F.count_if(F.expr(c)).alias(f"n_{k}") for k, c in _SLICES.items()), *(F.count_if(F.expr(f"({c}) AND both_merged")).alias(f"k_{k}") for k, c in _SLICES.items()))
    return S.with_wilson(one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("slice"), F.col(f"n_{k}").alias("n"), F.col(f"k_{k}").alias("k")) for k in _SLICES)))))


@query(wf(f"SELECT repo, n, k, {q_wilson('k', 'n')} FROM (SELECT repo, count(*) AS n, count(*) FILTER (conflict) AS k FROM flags GROUP BY 1)"))
def wilson_by_repo(spark, sf):
    return S.with_wilson(S.rate_table(B.labeled(spark, sf), "repo")).drop("rate")


def q_mh(source, exposed, stratum="repo", outcome="merged_later"):
    e, o = f"coalesce({exposed}, false)", f"coalesce({outcome}, false)"
    cells = ", ".join(f"CAST(count(*) FILTER ({x}) AS DOUBLE) AS {c}" for c, x in (("a", f"{e} AND {o}"), ("b", f"{e} AND NOT {o}"), ("c", f"NOT {e} AND {o}"), ("d", f"NOT {e} AND NOT {o}")))
    return (
        f"SELECT n_strata, n_discordant, CAST(ta + tb AS BIGINT) AS n_exposed, CAST(ta + tb + tc + td AS BIGINT) AS n_used, round(orr, 9) AS odds_ratio, round(orr * exp(-{Z} * se), 9) AS lo, round(orr * exp({Z} * se), 9) AS hi, round(CASE WHEN tb > 0 AND tc > 0 THEN ta * td / (tb * tc) END, 9) AS crude_or FROM ("
        "SELECT *, CASE WHEN s > 0 THEN r / s END AS orr, CASE WHEN r > 0 AND s > 0 THEN sqrt(pr / (2 * r * r) + psqr / (2 * r * s) + qs / (2 * s * s)) END AS se FROM ("
        "SELECT count(*) AS n_strata, count(*) FILTER (a * d > 0 OR b * c > 0) AS n_discordant, sum(a) AS ta, sum(b) AS tb, sum(c) AS tc, sum(d) AS td, sum(a * d / n) AS r, sum(b * c / n) AS s, sum((a + d) / n * a * d / n) AS pr, sum((a + d) / n * b * c / n + (b + c) / n * a * d / n) AS psqr, sum((b + c) / n * b * c / n) AS qs FROM ("
        f"SELECT *, a + b + c + d AS n FROM (SELECT {stratum}, {cells} FROM {source} GROUP BY 1) WHERE a + b > 0 AND c + d > 0 AND a + c > 0 AND b + d > 0)))"
    )


@query(wf(q_mh("flags", "near_miss", "agent_a")))
def mantel_haenszel(spark, sf):
    return S.mantel_haenszel(flags(spark, sf), "agent_a", F.col("near_miss"), F.col("merged_later"))


_CONTRASTS = [("conflict", "flags", "conflict"), ("dup_title", "flags", "dup_title"), ("fix_in_flight", "(SELECT * FROM flags WHERE conflict)", "fix_in_flight"), ("near_miss", "(SELECT * FROM flags WHERE NOT conflict)", "near_miss"), ("conflict_no_mega", "(SELECT * FROM flags WHERE NOT mega)", "conflict"), ("conflict_per_pr", "(SELECT repo, pr_later, bool_or(conflict) AS e, bool_or(merged_later) AS merged_later FROM flags GROUP BY 1, 2)", "e"), ("dup_title_per_pr", "(SELECT repo, pr_later, bool_or(dup_title) AS e, bool_or(merged_later) AS merged_later FROM flags GROUP BY 1, 2)", "e")]


@query(wf(" UNION ALL ".join(f"SELECT *, '{n}' AS contrast FROM ({q_mh(src, e)})" for n, src, e in _CONTRASTS)))
def outcome_battery(spark, sf):
    return S.outcome_battery(flags(spark, sf))


_GAPH = "abs(epoch_us(closed_b) - epoch_us(closed_a)) / 3600000000"
_HEADS = {"conflict_rate_all_pairs": ("true", "conflict"), "conflict_rate_cross_agent": ("cross_agent", "conflict"), "dup_both_merged": ("dup_title", "merged_a AND merged_b"), "dup_exactly_one_merged": ("dup_title", "merged_a <> merged_b"), "dup_neither_merged": ("dup_title", "NOT merged_a AND NOT merged_b"), "dup_no_shared_file": ("dup_title", "NOT conflict"), "both_merged_shared_gap_lt24h": ("bm_shared", f"{_GAPH} < 24")}


@query(wf("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{h}' AS headline, k, n, {q_wilson('k', 'n')} FROM (SELECT count(*) FILTER (({who}) AND ({what})) AS k, count(*) FILTER ({who}) AS n FROM flags)" for h, (who, what) in _HEADS.items()) + ") WHERE n > 0"))
def outcome_headlines(spark, sf):
    return S.headlines(flags(spark, sf))


_PI = "SELECT conflict::INT AS y, 1.0::DOUBLE / (1 + pr_b % 7) AS pi FROM labeled"


@query(w("SELECT count(*) AS n, round(sum(y / pi) / sum(1 / pi), 9) AS hajek, round(sum(y / pi) / 10000.0, 9) AS horvitz_thompson, round(sum(1 / pi) ** 2 / sum(1 / pi / pi), 9) AS n_eff, round(min(1 / pi), 9) AS w_min, round(max(1 / pi), 9) AS w_max, round(median(1 / pi), 9) AS w_median, count(*) FILTER (1 / pi >= 1.7 * (SELECT median(1 / pi) FROM q)) AS n_extreme FROM q", "labeled", q=_PI))
def design_weighted(spark, sf):
    d = B.labeled(spark, sf).select(F.col("conflict").cast("int").alias("y"), (F.lit(1.0) / (1 + F.col("pr_b") % 7)).alias("pi"))
    return S.design_weighted(d, "y", "pi", 10000.0, 1.7)


# Two raters of the labelled documents.
_TWO = "SELECT doc_id, CAST(quality AS VARCHAR) AS a, CAST(1 - toxic AS VARCHAR) AS b FROM labels"
_LONG = "SELECT doc_id AS item, a AS label FROM two UNION ALL SELECT doc_id, b FROM two"


def two_raters(spark, sf):
    return B.read(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("a"), (1 - F.col("toxic")).cast("string").alias("b"))


def long_ratings(spark, sf):
    t = two_raters(spark, sf)
    return t.select(F.col("doc_id").alias("item"), F.col("a").alias("label")).union(t.select("doc_id", "b"))


@query(w("SELECT n, round(po, 9) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 9) AS kappa FROM (SELECT count(*) AS n, avg((a = b)::INT) AS po, (SELECT sum(x.n * y.n) FROM (SELECT a AS v, count(*) AS n FROM two GROUP BY 1) x JOIN (SELECT b AS v, count(*) AS n FROM two GROUP BY 1) y ON x.v = y.v) / (CAST(count(*) AS DOUBLE) * count(*)) AS pe FROM two)", two=_TWO))
def kappa(spark, sf):
    return S.cohen_kappa(two_raters(spark, sf), "a", "b")


@query(w("SELECT items, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 9) AS kappa FROM (SELECT count(*) AS items, avg((n2 - 2) / 2) AS po FROM (SELECT item, sum(n * n) AS n2 FROM (SELECT item, label, count(*) AS n FROM lr GROUP BY 1, 2) GROUP BY 1)), (SELECT sum(CAST(n AS DOUBLE) * n) / (sum(n) * sum(n)) AS pe FROM (SELECT label, count(*) AS n FROM lr GROUP BY 1))", two=_TWO, lr=_LONG))
def fleiss(spark, sf):
    return S.fleiss_kappa(long_ratings(spark, sf), "item", "label")


@query(w("SELECT CAST(t AS BIGINT) AS n_values, round(1 - dob / ((t * t - q) / (t - 1)), 9) AS alpha FROM (SELECT sum((4 - n2) / 1.0::DOUBLE) AS dob, sum(2.0::DOUBLE) AS t FROM (SELECT item, sum(n * n) AS n2 FROM (SELECT item, label, count(*) AS n FROM lr GROUP BY 1, 2) GROUP BY 1)), (SELECT sum(CAST(n AS DOUBLE) * n) AS q FROM (SELECT label, count(*) AS n FROM lr GROUP BY 1))", two=_TWO, lr=_LONG))
def krippendorff(spark, sf):
    return S.krippendorff_alpha(long_ratings(spark, sf), "item", "label")


@query(w("SELECT x AS label_true, y AS label_pred, count(a) AS n FROM (SELECT unnest(['0', '1', 'none']) AS x) g, (SELECT unnest(['0', '1', 'none']) AS y) h LEFT JOIN two ON a = x AND b = y GROUP BY 1, 2", two=_TWO))
def confusion_grid(spark, sf):
    return S.crosstab(two_raters(spark, sf), "a", "b", ["0", "1", "none"])


_PRF = "SELECT label, CAST(sum(s) AS BIGINT) AS support, sum(g) AS guessed, sum(h) AS hit FROM (SELECT a AS label, 1 AS s, 0 AS g, (a = b)::INT AS h FROM two UNION ALL SELECT b, 0, 1, 0 FROM two) GROUP BY 1"
_PR = "round(hit / nullif(guessed, 0), 9) AS precision, round(hit / nullif(support, 0), 9) AS recall, round(2 * (hit / nullif(guessed, 0)) * (hit / nullif(support, 0)) / nullif(hit / nullif(guessed, 0) + hit / nullif(support, 0), 0), 9) AS f1"


@query(w(f"SELECT label, support, {_PR} FROM prf", two=_TWO, prf=_PRF))
def class_scores(spark, sf):
    return S.class_scores(two_raters(spark, sf), "a", "b")


@query(w(f"SELECT round(acc, 9) AS accuracy, round(avg(recall), 9) AS balanced_accuracy, round(avg(f1), 9) AS macro_f1, round(acc, 9) AS micro_f1 FROM (SELECT avg((a = b)::INT) AS acc FROM two), (SELECT {_PR.replace(', 9)', ', 15)')} FROM prf) GROUP BY acc", two=_TWO, prf=_PRF))
def multiclass(spark, sf):
    return S.multiclass(two_raters(spark, sf), "a", "b")


@query(wf("SELECT tp, fp, fn, tn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(tn / (tn + fp), 9) AS specificity, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round(fp / (fp + tn), 9) AS fpr, round(fn / (fn + tp), 9) AS fnr FROM (SELECT count(*) FILTER (near_miss AND dup_title) AS tp, count(*) FILTER (near_miss AND NOT dup_title) AS fp, count(*) FILTER (NOT near_miss AND dup_title) AS fn, count(*) FILTER (NOT near_miss AND NOT dup_title) AS tn FROM flags)"))
def overlap_confusion(spark, sf):
    return S.binary_confusion(flags(spark, sf), F.col("dup_title"), F.col("near_miss"))


_RATE = "['D', 'H', 'B', 'none']"


@query(w(f"SELECT label, count(pr_a) AS n, count(*) FILTER (conflict) AS n_flag, count(*) FILTER (NOT conflict) AS n_other FROM (SELECT unnest(['D', 'C', 'H', 'B', 'I', 'none']) AS label) LEFT JOIN (SELECT *, {_RATE}[(pr_b % 4) + 1] AS label FROM labeled) USING (label) GROUP BY 1", "labeled"))
def overlap_by_category(spark, sf):
    """Of each gold label: pairs with a shared file, and without."""
    label = F.element_at(F.array(*map(F.lit, ("D", "H", "B", "none"))), (F.col("pr_b") % 4 + 1).cast("int"))
    return S.overlap_by_category(B.labeled(spark, sf).withColumn("label", label), "label", "conflict", list(LABELS))


@query(wf("SELECT n_exposed, n_other, round(p, 9) AS rate_exposed, round(q, 9) AS rate_other, round(p * (1 - q) / nullif(q * (1 - p), 0), 9) AS odds_ratio FROM (SELECT count(*) FILTER (conflict) AS n_exposed, count(*) FILTER (NOT conflict) AS n_other, count(*) FILTER (conflict AND merged_later) / nullif(count(*) FILTER (conflict), 0) AS p, count(*) FILTER (NOT conflict AND merged_later) / nullif(count(*) FILTER (NOT conflict), 0) AS q FROM flags)"))
def crude_odds(spark, sf):
    return S.crude_odds(flags(spark, sf), F.col("conflict"), F.col("merged_later"))


@query(w(f"SELECT label, support, {_PR}, (SELECT round(avg(round(2 * (hit / nullif(guessed, 0)) * (hit / nullif(support, 0)) / nullif(hit / nullif(guessed, 0) + hit / nullif(support, 0), 0), 9)), 9) FROM prf) AS macro_f1 FROM prf", two=_TWO, prf=_PRF))
def agreement_by_class(spark, sf):
    t = two_raters(spark, sf)
    return annotate.agreement_by_class([t.select("doc_id", F.col(c).alias("label_category")) for c in "ab"], "doc_id", ["0", "1"])[0]


@query(w("SELECT item, ann1, ann2, decided, ann1 IS NOT NULL AND ann2 IS NOT NULL AND ann1 = ann2 AS agreed, coalesce(decided, CASE WHEN ann1 = ann2 THEN ann1 END) AS gold, CASE WHEN decided IS NOT NULL THEN 'adjudicated' WHEN ann1 = ann2 THEN 'agreed' END AS label_source FROM s1 FULL JOIN s2 USING (item) LEFT JOIN dd USING (item)",
  s1=f"SELECT doc_id AS item, {_RATE}[(doc_id % 4) + 1] AS ann1 FROM labels WHERE doc_id % 5 <> 0", s2=f"SELECT doc_id AS item, {_RATE}[(doc_id // 3 % 4) + 1] AS ann2 FROM labels WHERE doc_id % 7 <> 0", dd="SELECT doc_id AS item, 'C' AS decided FROM labels WHERE doc_id % 11 = 0"))
def adjudicate(spark, sf):
    d = B.read(spark, sf, "labels").select(F.col("doc_id").alias("item"))
    names = F.array(*map(F.lit, ("D", "H", "B", "none")))
    sheet = lambda cond, k: d.where(cond).select("item", F.element_at(names, (k % 4 + 1).cast("int")).alias("label_category"), F.lit(2).alias("confidence"))
    one, two = sheet("item % 5 <> 0", F.col("item")), sheet("item % 7 <> 0", F.floor(F.col("item") / 3))
    out = annotate.adjudicate([one, two], d.where("item % 11 = 0").withColumn("label_category", F.lit("C")))
    return out.select("item", "ann1", "ann2", "decided", "agreed", "gold", "label_source")


# Cumulative Poisson(1) probabilities.
_POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def q_bootstrap(source, y):
    weight = " + ".join(f"(u > {x!r}::DOUBLE)::INT" for x in _POISSON)
    step = "(({z}) * ({z}) % 2147483647 * {k} + {c}) % 2147483647".format
    one = step(z="(x + it * 1103515245) % 2147483647", k=48271, c="y")
    drawn = f"SELECT it, s, n, {one} AS z FROM h, range(1, 5001) AS r(it)"
    reps = f"SELECT it, sum(w * s) / nullif(sum(w * n), 0) AS m FROM (SELECT it, s, n, {weight} AS w FROM (SELECT it, s, n, ({step(z='z', k=69621, c='it')} + 0.5::DOUBLE) / 2147483647 AS u FROM ({drawn}))) GROUP BY 1"
    part = "CAST('0x' || substr(md5(concat_ws('|', '20260824', repo)), {}, 12) AS BIGINT) % 2147483647".format
    return f"WITH g AS (SELECT repo, sum({y}::INT)::DOUBLE AS s, count(*) AS n FROM {source} GROUP BY 1), h AS (SELECT s, n, {part(1)} AS x, {part(13)} AS y FROM g) SELECT round(sum(s) / sum(n), 9) AS estimate, (SELECT round(quantile_cont(m, 0.025), 9) FROM ({reps})) AS lo, (SELECT round(quantile_cont(m, 0.975), 9) FROM ({reps})) AS hi, count(*) AS n_clusters FROM g"


@query(w(f"SELECT * FROM ({q_bootstrap('labeled', 'conflict')})", "labeled"))
def cluster_bootstrap(spark, sf):
    return S.cluster_bootstrap(B.labeled(spark, sf), "repo", "conflict", Settings().bootstrap)


@query(wf(f"SELECT * FROM ({q_bootstrap('(SELECT * FROM flags WHERE NOT conflict)', 'near_miss')})"))
def near_miss_bootstrap(spark, sf):
    """Share of near misses among disjoint pairs, over clusters drawn anew."""
    return S.cluster_bootstrap(flags(spark, sf).where(~F.col("conflict")).withColumn("near_miss", F.col("near_miss").cast("int")), "repo", "near_miss", Settings().bootstrap)


@query(w("SELECT kind, item, gold, pred FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY item) AS r FROM (SELECT *, CASE WHEN pred <> 'none' AND gold IN ('none', 'B') THEN 'FP' WHEN gold IN ('D', 'C', 'H', 'I') AND pred IN ('none', 'B') THEN 'FN' END AS kind FROM g) WHERE kind IS NOT NULL) WHERE r <= 50", g=f"SELECT doc_id AS item, {_RATE}[(doc_id % 4) + 1] AS gold, {_RATE}[(doc_id // 3 % 4) + 1] AS pred FROM labels"))
def error_bundles(spark, sf):
    d = B.read(spark, sf, "labels").select(F.col("doc_id").alias("item"))
    names = F.array(*map(F.lit, ("D", "H", "B", "none")))
    pick = lambda k: F.element_at(names, (k % 4 + 1).cast("int"))
    return annotate.error_bundles(d.withColumn("gold", pick(F.col("item"))), d.withColumn("category", pick(F.floor(F.col("item") / 3))), "item").select("kind", "item", "gold", "pred")


@query(w("SELECT round(sum(n * m) / sum(n), 9) AS weighted, round(corr(m, y), 9) AS r FROM (SELECT repo, count(*) AS n, avg(score) AS m, avg(label::DOUBLE) AS y FROM s GROUP BY 1)", "titled", s=scored.sql))
def repo_level_correlation(spark, sf):
    d = scored(spark, sf).groupBy("repo").agg(F.count("*").alias("n"), F.avg("score").alias("m"), F.avg("label").alias("y"))
    return d.agg(F.round(F.sum(F.col("n") * F.col("m")) / F.sum("n"), 9).alias("weighted"), F.round(F.corr("m", "y"), 9).alias("r"))
