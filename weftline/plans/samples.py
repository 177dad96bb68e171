"""Queries on samples, frames and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.config import Settings
from weftline.functions import text as X
from weftline.functions.paths import repo_of_url
from weftline.operators import audit, pools
from weftline.operators import sampling as S
from weftline.plans import binding as B
from weftline.plans.binding import with_parts as w
from weftline.plans.joins import PAIR
from weftline.plans.pools import flags, wf
from weftline.plans.registry import query
from weftline.sources.layout import render_item
from weftline.sources.scratch import settle
from weftline.sources.tables import lookup

SMALL = {"revert": None, "dup": 60, "fix_in_flight": 80, "bm_shared": 40, "overlap_other": 80, "near_miss": 200, "control": 200}
KEY = "repo, pr_a, pr_b"
HASH = "md5(concat_ws('|', '{}', repo, pr_a, pr_b))"


def q_hamilton(source, n, least):
    """Cells with their sizes and quotas."""
    return (
        f"SELECT cell, size, CAST(base + whole + (turn <= least(free, total) - given AND whole < room)::INT AS BIGINT) AS quota FROM (SELECT *, sum(whole) OVER () AS given, row_number() OVER (ORDER BY CASE WHEN whole < room THEN (room * free) % greatest(total, 1) ELSE -1 END DESC, cell) AS turn FROM ("
        f"SELECT *, CASE WHEN total <= free THEN room ELSE (room * free) // greatest(total, 1) END AS whole FROM (SELECT *, sum(room) OVER () AS total FROM (SELECT *, size - base AS room, greatest({n} - sum(base) OVER (), 0) AS free FROM (SELECT cell, count(*) AS size, least(count(*), {least}) AS base FROM {source} GROUP BY 1)))))"
    )


PREV_D = "SELECT *, concat_ws('|', mega, cross_agent, conflict) AS cell FROM flags"
PREV = f"SELECT {KEY}, d.cell, quota / size AS pi FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {HASH.format(20260824)}, {KEY}) AS turn FROM pd) d JOIN pq q ON q.cell = d.cell WHERE turn <= quota"
ENR_D = "SELECT *, concat_ws('|', primary_stratum, mega, cross_agent, both_merged, CASE WHEN primary_stratum = 'revert' OR cross_agent_candidate THEN 'census' ELSE 'sampled' END) AS cell FROM flags"
ENR = f"SELECT {KEY}, d.cell, quota / size AS pi FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {HASH.format(20260824)}, {KEY}) AS turn FROM ed) d JOIN eq q ON q.cell = d.cell WHERE turn <= quota"


def q_enriched(targets, census):
    goal = "CASE primary_stratum " + " ".join(f"WHEN '{k}' THEN {-1 if v is None else v}" for k, v in targets.items()) + " END"
    return (
        "SELECT cell, size, CASE WHEN whole THEN size ELSE seats + (turn <= least(free, total) - given AND rem >= 0)::INT END AS quota FROM (SELECT *, sum(seats) OVER (PARTITION BY primary_stratum) AS given, row_number() OVER (PARTITION BY primary_stratum ORDER BY rem DESC, cell) AS turn FROM ("
        "SELECT *, CASE WHEN NOT whole AND seats < size THEN (size * free) % greatest(total, 1) ELSE -1 END AS rem FROM (SELECT *, CASE WHEN whole THEN 0 WHEN total <= free THEN size ELSE (size * free) // greatest(total, 1) END AS seats FROM ("
        "SELECT *, greatest(target - sum(CASE WHEN whole THEN size ELSE 0 END) OVER (PARTITION BY primary_stratum), 0) AS free, sum(CASE WHEN whole THEN 0 ELSE size END) OVER (PARTITION BY primary_stratum) AS total FROM ("
        f"SELECT *, target < 0 OR size <= {census} OR cell LIKE '%|census' AS whole FROM (SELECT cell, primary_stratum, count(*) AS size, {goal} AS target FROM ed GROUP BY 1, 2))))))"
    )


def parts(n, least, targets, census):
    return {"pd": PREV_D, "pq": q_hamilton("pd", n, least), "ps": PREV, "ed": ENR_D, "eq": q_enriched(targets, census), "es": ENR}


C = Settings()
PARTS = parts(C.prevalence_n, C.prevalence_min, C.targets, C.census)
FEW = parts(600, 20, SMALL, 20)


def prevalence(spark, sf, f=None):
    return S.prevalence_sample(flags(spark, sf) if f is None else f, PAIR)


def enriched(spark, sf, f=None):
    return S.enriched_sample(flags(spark, sf) if f is None else f, PAIR)


@query(w("SELECT cell, size, quota FROM q", "requests", q=q_hamilton("(SELECT agent AS cell FROM requests)", 700, 3)))
def hamilton_alloc(spark, sf):
    c = B.requests(spark, sf).select(F.col("agent").alias("cell"))
    return S.hamilton(S.cells(c, "cell"), "cell", "size", 700, 3)


@query(wf(f"SELECT {KEY}, cell, pi FROM ps", **PARTS))
def prevalence_sample(spark, sf):
    return prevalence(spark, sf).select(*PAIR, "cell", "pi")


@query(wf(f"SELECT {KEY}, cell, pi FROM es", **PARTS))
def enriched_sample(spark, sf):
    return enriched(spark, sf).select(*PAIR, "cell", "pi")


@query(wf(f"SELECT {KEY}, cell, pi FROM ps", **FEW))
def prevalence_few(spark, sf):
    """A smaller sample, of which small tables are not the whole."""
    return S.prevalence_sample(flags(spark, sf), PAIR, 600, 20).select(*PAIR, "cell", "pi")


@query(wf(f"SELECT {KEY}, cell, pi FROM es", **FEW))
def enriched_few(spark, sf):
    return S.enriched_sample(flags(spark, sf), PAIR, SMALL, 20).select(*PAIR, "cell", "pi")


@query(wf("SELECT cell, count(*) AS n, any_value(pi) AS pi, round(sum(1 / pi), 6) AS weight FROM es GROUP BY 1", **PARTS))
def sample_audit(spark, sf):
    return S.sample_audit(enriched(spark, sf))


@query(wf(f"SELECT repo, pr_a, pr_b, p.pi AS pi_prevalence, e.pi AS pi_enriched, p.pi IS NOT NULL AS in_prevalence_sample, e.pi IS NOT NULL AS in_enriched_sample, e.pi AS incl_prob, CAST(row_number() OVER (ORDER BY {HASH.format(20260824)}, {KEY}) AS INT) AS frame_id FROM ps p FULL JOIN es e USING (repo, pr_a, pr_b)", **PARTS))
def judging_frame(spark, sf):
    f = settle(flags(spark, sf).select(*PAIR, "mega", "cross_agent", "conflict", "primary_stratum", "both_merged", "cross_agent_candidate"))
    return S.frame(prevalence(spark, sf, f), enriched(spark, sf, f), PAIR)


_CAL = {"overlap": ("conflict", 30), **{k: (f"primary_stratum = '{k}'", n) for k, n in (("dup", 30), ("revert", 10), ("near_miss", 15), ("control", 15))}}
_CALH = f"SELECT *, {HASH.format(20260825)} AS h FROM flags"
_CALQ = " UNION ".join(f"SELECT * FROM (SELECT {KEY}, h FROM ch WHERE {c} ORDER BY h, {KEY} LIMIT {n})" for c, n in _CAL.values())


def q_calibration(total):
    return f"SELECT {KEY}, drawn FROM (SELECT *, row_number() OVER (ORDER BY drawn DESC, h, {KEY}) AS turn FROM (SELECT {KEY}, h, (repo, pr_a, pr_b) IN (SELECT (repo, pr_a, pr_b) FROM cq) AS drawn FROM ch)) WHERE turn <= {total}"


def quotas():
    return {k: (F.expr(c), n) for k, (c, n) in _CAL.items()}


@query(wf(q_calibration(100), ch=_CALH, cq=_CALQ))
def calibration_quota(spark, sf):
    return S.quota_sample(flags(spark, sf), quotas(), 100, PAIR).select(*PAIR, "drawn")


@query(wf(q_calibration(60), ch=_CALH, cq=_CALQ))
def calibration_cut(spark, sf):
    """Fewer rows than the quotas draw: the draw is cut to the total."""
    return S.quota_sample(flags(spark, sf), quotas(), 60, PAIR).select(*PAIR, "drawn")


_SIZES = "SELECT repo, n, coalesce(sum(n) OVER (ORDER BY md5(concat_ws('|', '20260824', repo)), repo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM (SELECT repo, count(*) AS n FROM labeled GROUP BY 1)"
_TESTED = "SELECT *, before < CASE WHEN total < 200 THEN least(greatest(round_even(total * 0.6::DOUBLE, 0), 1), total) ELSE round_even(total * 0.6::DOUBLE, 0) END AS test FROM sizes"


def q_split(dev):
    return f"SELECT repo, n, CASE WHEN test THEN 'test' WHEN total < 200 OR before - coalesce(sum(CASE WHEN test THEN n END) OVER (), 0) < round_even(total * {dev}::DOUBLE, 0) THEN 'dev' ELSE 'train' END AS split FROM tested"


@query(w(q_split(0.4), "labeled", sizes=_SIZES, tested=_TESTED))
def repo_split(spark, sf):
    return S.repo_split(B.labeled(spark, sf), dev_share=Settings().dev_share)


@query(w(q_split(0.2), "labeled", sizes=_SIZES, tested=_TESTED))
def repo_split_three(spark, sf):
    """With a fifth for dev, so that train has rows too."""
    return S.repo_split(B.labeled(spark, sf), dev_share=0.2)


_VAL = f"SELECT {KEY} FROM jf WHERE (repo, pr_a, pr_b) NOT IN (SELECT (repo, pr_a, pr_b) FROM cal) ORDER BY {HASH.format(20260826)}, {KEY} LIMIT 300"
_FRAMED = {**PARTS, "jf": f"SELECT {KEY}, p.pi AS pi_prevalence, e.pi AS pi_enriched, conflict, primary_stratum FROM ps p FULL JOIN es e USING (repo, pr_a, pr_b) JOIN flags USING (repo, pr_a, pr_b)", "ch": _CALH.replace("FROM flags", "FROM jf"), "cq": _CALQ, "cal": q_calibration(100), "val": _VAL}
_WEIGHTS = " UNION ALL ".join(f"SELECT '{n}' AS sample, count(*) AS n, round(sum(w) ** 2 / sum(w * w), 6) AS n_eff, min(w) AS w_min, median(w) AS w_median, max(w) AS w_max, count(*) FILTER (w >= 50 * (SELECT median(1 / pi_{n}) FROM jf WHERE pi_{n} IS NOT NULL)) AS n_extreme FROM (SELECT 1 / pi_{n} AS w FROM jf WHERE pi_{n} IS NOT NULL)" for n in ("prevalence", "enriched"))


def framed(spark, sf):
    f = settle(flags(spark, sf))
    return S.framed(prevalence(spark, sf, f), enriched(spark, sf, f), f, PAIR)


@query(wf(f"{_WEIGHTS} UNION ALL " + " UNION ALL ".join(f"SELECT '{n}', count(*), NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 0 FROM {t}" for n, t in (("frame", "jf"), ("calibration", "cal"), ("validation", "val"))), **_FRAMED))
def design_report(spark, sf):
    """Figures of the sampling design: effective sizes, weights, and the sizes of frame, calibration and validation."""
    return framed(spark, sf)["design"]


@query(wf(f"SELECT {KEY} FROM val", **_FRAMED))
def validation_sample(spark, sf):
    """Rows of the frame that the calibration sample does not hold."""
    return framed(spark, sf)["validation"].select(*PAIR)


@query(w(f"SELECT {KEY}, conflict FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY r, conflict, {KEY}) AS t FROM (SELECT *, row_number() OVER (PARTITION BY repo, conflict ORDER BY {HASH.format(20260824)}, {KEY}) AS r FROM labeled)) WHERE t <= 4", "labeled"))
def cap_per_repo(spark, sf):
    return S.cap_per_group(B.labeled(spark, sf).select(*PAIR, "conflict"), "repo", "conflict", 4, PAIR)


def q_inputs(cap):
    return w(f"SELECT repo, pr_a, pr_b, CAST(len(files_a) AS INT) AS n_files_a, CAST(len(files_b) AS INT) AS n_files_b, array_to_string(files_a[1:{cap}], chr(10)) AS files_a_text, array_to_string(files_b[1:{cap}], chr(10)) AS files_b_text, array_to_string(list_sort(list_intersect(files_a, files_b))[1:{cap}], chr(10)) AS files_shared FROM labeled", "labeled")


INPUTS = ("n_files_a", "n_files_b", "files_a_text", "files_b_text", "files_shared")


@query(q_inputs(C.file_cap))
def judge_inputs(spark, sf):
    return S.judge_inputs(B.labeled(spark, sf)).select(*PAIR, *INPUTS)


@query(q_inputs(3))
def judge_inputs_cut(spark, sf):
    """With so low a cap on file lists that it cuts some."""
    return S.judge_inputs(B.labeled(spark, sf), cap=3).select(*PAIR, *INPUTS)


@query(wf("SELECT 'pi_out_of_range' AS \"check\", count(*) FILTER (pi IS NULL OR pi <= 0 OR pi > 1) AS n FROM es UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT 1 FROM es GROUP BY repo, pr_a, pr_b HAVING count(*) > 1)", **PARTS))
def sample_invariants(spark, sf):
    return audit.violations(enriched(spark, sf), audit.share_rules("pi"), PAIR).withColumn("check", F.regexp_replace("check", "^pi_pi_", "pi_"))


_SPLIT = f"SELECT repo, CASE WHEN test THEN 'test' ELSE 'rest' END AS split FROM (SELECT * FROM ({_TESTED.replace('FROM sizes', f'FROM ({_SIZES})')}))"


@query(w("SELECT count(*) AS n_shared_repos, (SELECT count(*) FROM (SELECT repo, pr_a AS pr FROM labeled JOIN sp USING (repo) WHERE split = 'test' INTERSECT SELECT repo, pr_b FROM labeled JOIN sp USING (repo) WHERE split <> 'test')) AS n_shared_prs FROM (SELECT repo FROM sp WHERE split = 'test' INTERSECT SELECT repo FROM sp WHERE split <> 'test')", "labeled", sp=_SPLIT))
def split_leakage(spark, sf):
    """Repositories and requests that stand on both sides of a split: none."""
    d = B.labeled(spark, sf).select(*PAIR)
    s = S.repo_split(d).select("repo", (F.col("split") == "test").alias("test"))
    repos = s.where("test").select("repo").intersect(s.where("not test").select("repo"))
    j = d.join(s, "repo")
    prs = j.where("test").select("repo", F.col("pr_a").alias("pr")).intersect(j.where("not test").select("repo", F.col("pr_b").alias("pr")))
    return repos.agg(F.count("*").alias("n_shared_repos")).crossJoin(F.broadcast(prs.agg(F.count("*").alias("n_shared_prs"))))  # one row each


_SIDE = "'--- PR {s} ---' || chr(10) || 'TITLE: ' || coalesce(title_{s}, '') || chr(10) || 'DESCRIPTION: ' || substr(coalesce({s}.body, ''), 1, 1200) || chr(10) || 'CHANGED FILES (' || len(files_{s}) || '):' || chr(10) || array_to_string(files_{s}[1:80], chr(10)) || chr(10)"
_BOTH = "CASE WHEN len(list_intersect(files_a, files_b)) = 0 THEN '(none)' ELSE array_to_string(list_sort(list_intersect(files_a, files_b))[1:80], chr(10)) END"


@query(w(f"SELECT repo, pr_a, pr_b, sha256('Rate the pair.' || chr(10) || 'REPOSITORY: ' || repo || chr(10) || chr(10) || {_SIDE.format(s='a')} || chr(10) || {_SIDE.format(s='b')} || chr(10) || 'FILES CHANGED BY BOTH:' || chr(10) || {_BOTH} || chr(10)) AS prompt_sha256 FROM titled LEFT JOIN bodies a ON a.pr = pr_a LEFT JOIN bodies b ON b.pr = pr_b", "titled", "bodies"))
def judge_prompts(spark, sf):
    """Digest of each pair's whole prompt."""
    d = S.judge_inputs(B.with_bodies(spark, sf, B.titled(spark, sf)))
    d = d.withColumns({f"files_{s}": F.col(f"files_{s}_text") for s in "ab"})
    return d.select(*PAIR, F.sha2(render_item("Rate the pair."), 256).alias("prompt_sha256"))


@query(w("SELECT repo, count(*) AS pending FROM pairs WHERE pr_b % 3 <> 0 GROUP BY 1 ORDER BY pending DESC, repo LIMIT 20", "pairs"))
def pending_repos(spark, sf):
    """The repositories with the most pairs that are not done yet (a third of the pairs is)."""
    d = B.pairs(spark, sf)
    return pools.pending_repos(d, d.where("pr_b % 3 = 0"), PAIR, 20)


@query("SELECT c_custkey AS repo, CASE WHEN c_custkey % 4 <> 0 THEN 'known/r' || c_custkey WHEN c_custkey % 8 = 0 THEN 'own' || c_nationkey || '/r' || c_custkey END AS full_name FROM customer")
def repo_from_url(spark, sf):
    """The repository's name by its id, or else from its URL; null if neither has it."""
    c = B.read(spark, sf, "customer").select(F.col("c_custkey").alias("repo"), "c_nationkey")
    known = c.where("repo % 4 <> 0").select("repo", F.concat(F.lit("known/r"), F.col("repo").cast("string")).alias("full_name"))
    url = F.when(F.col("repo") % 8 == 0, F.concat(F.lit("https://host/repos/own"), F.col("c_nationkey").cast("string"), F.lit("/r"), F.col("repo").cast("string"), F.lit("/pulls/7"))).otherwise("https://host/none")
    return c.join(known, "repo", "left").select("repo", F.coalesce("full_name", repo_of_url(url)).alias("full_name"))


@query("SELECT o_orderkey AS pr, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS opened, string_split(o_orderpriority, '-') AS parts, '{\"pr\":' || o_orderkey || ',\"agent\":\"' || o_orderpriority || '\"}' AS entry FROM orders")
def value_helpers(spark, sf):
    """Times from text (a fifth of it unreadable), lists from text, and JSON objects."""
    o = B.read(spark, sf, "orders").select(F.col("o_orderkey").alias("pr"), F.col("o_orderpriority").alias("agent"), F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("not yet").alias("t"))
    return o.select("pr", X.utc(F.col("t")).cast("timestamp_ntz").alias("opened"), X.listed(F.col("agent"), "-").alias("parts"), X.json_object("pr", "agent").alias("entry"))


@query("SELECT n_nationkey, n_name, place::INT AS place FROM nation JOIN (VALUES (7, 0), (3, 1), (19, 3)) AS k(n, place) ON n = n_nationkey")
def keyed_lookup(spark, sf):
    """Rows of listed keys, with their place in the list; one of the keys is in no row."""
    return lookup(B.read(spark, sf, "nation").select("n_nationkey", "n_name"), [(7,), (3,), (99,), (19,)], ["n_nationkey"])
