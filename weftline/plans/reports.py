"""Queries on robustness, coverage, features and replays, over the pool flags."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import annotate, audit
from weftline.operators import coactive as C
from weftline.operators import sampling as S2
from weftline.operators import similarity as T
from weftline.operators import stats as S
from weftline.plans import binding as B
from weftline.plans.binding import with_parts as w
from weftline.plans.joins import PAIR
from weftline.plans.measures import flags, q_mh, two_raters
from weftline.plans.pools import _CLASS, FLAGS, FLAGS0, MEGA, NORM, TOKS, q_jaccard, wf
from weftline.plans.registry import QUERIES, SQL, query
from weftline.sources.scratch import settle
from weftline.sources.tables import compared

KEY = "repo, pr_a, pr_b"


@query(
    wf(
        f"SELECT *, 'titles_differ' AS contrast FROM ({q_mh(f'(SELECT * FROM flags WHERE {q_jaccard("toks_a", "toks_b", "1.0")} < 0.5)', 'conflict')}) UNION ALL SELECT *, 'texts_differ' FROM ({q_mh('(SELECT f.* FROM flags f JOIN cos USING (repo, pr_a, pr_b) WHERE cosine < 0.7)', 'conflict')})",
        cos=SQL["tfidf_cosine"],
    )
)
def mh_robustness(spark, sf):
    """Odds of a merge by conflict, without pairs of alike titles, or of alike texts."""
    f = settle(flags(spark, sf).select(*PAIR, "title_a", "title_b", "conflict", "merged_later"))
    ta, tb = (X.title_tokens(X.normalize_title(F.col(c))) for c in ("title_a", "title_b"))
    cos = T.tfidf_cosine(f, PAIR, F.col("title_a"), F.col("title_b"))
    kept = {"titles_differ": f.where(X.jaccard(ta, tb, 1.0) < 0.5), "texts_differ": f.join(cos.where("cosine < 0.7"), PAIR, "left_semi")}
    one, two = (S.mantel_haenszel(d, "repo", F.col("conflict"), F.col("merged_later")).withColumn("contrast", F.lit(n)) for n, d in kept.items())
    return one.unionByName(two)


_SHARED = f"SELECT {KEY}, bool_and(class IN ('ci_workflow', 'lockfile', 'manifest', 'docker', 'readme')) AS pure FROM (SELECT {KEY}, {_CLASS} AS class FROM (SELECT {KEY}, lower(p) AS low, string_split(lower(p), '/')[-1] AS name FROM (SELECT {KEY}, unnest(list_intersect(files_a, files_b)) AS p FROM flags))) GROUP BY 1, 2, 3"


@query(wf(f"SELECT f.repo, f.pr_a, f.pr_b, 0 AS always_safe, coalesce(conflict, false)::INT AS file_overlap, (coalesce(conflict, false) AND NOT coalesce(pure, false))::INT AS config_aware_overlap, coalesce(dup_title, false)::INT AS duplicate_title FROM flags f LEFT JOIN sh ON sh.repo = f.repo AND sh.pr_a = f.pr_a AND sh.pr_b = f.pr_b", sh=_SHARED))
def indicator_scores(spark, sf):
    return T.indicator_scores(flags(spark, sf), PAIR)


_TEXTS = f"SELECT {KEY}, coalesce(title_a, '') || ' ' || coalesce(x.body, '') AS ta, coalesce(title_b, '') || ' ' || coalesce(y.body, '') AS tb FROM titled LEFT JOIN bodies x ON x.pr = pr_a LEFT JOIN bodies y ON y.pr = pr_b"
_WORDS = " UNION ALL ".join(f"SELECT {KEY}, '{s}' AS side, unnest(regexp_extract_all(lower(t{s}), '[a-z0-9_]+')) AS token FROM texts" for s in "ab")
_COUNTS = f"SELECT {KEY}, side, token, count(*) AS c FROM words GROUP BY ALL"
_IDF = "SELECT token, ln((1 + 2 * (SELECT count(*) FROM texts)) / (1 + count(*))) + 1 AS idf FROM counts GROUP BY 1"
_VECTORS = f"SELECT {KEY}, side, token, c * idf AS w FROM counts JOIN idf USING (token)"
_NORMS = f"SELECT {KEY}, sum(w * w) FILTER (side = 'a') AS na, sum(w * w) FILTER (side = 'b') AS nb FROM vectors GROUP BY 1, 2, 3"
_DOTS = f"SELECT {KEY}, sum(a.w * b.w) AS dot FROM (SELECT * FROM vectors WHERE side = 'a') a JOIN (SELECT * FROM vectors WHERE side = 'b') b USING (repo, pr_a, pr_b, token) GROUP BY 1, 2, 3"
_COS = "round(coalesce(CASE WHEN na > 0 AND nb > 0 THEN dot / sqrt(na * nb) END, 0), 9) AS cosine"


def wt(body, **more):
    """SQL over flags and the texts of both sides."""
    parts = dict(texts=_TEXTS, words=_WORDS, counts=_COUNTS, idf=_IDF, vectors=_VECTORS, norms=_NORMS, dots=_DOTS)
    return w(body, "titled", "bodies", megas=MEGA, norm=NORM, toks=TOKS, flags0=FLAGS0, flags=FLAGS, **parts, **more)


@query(wt(f"SELECT f.repo, f.pr_a, f.pr_b, round({q_jaccard('toks_a', 'toks_b', '1.0')}, 9) AS title_jaccard, {', '.join(f'coalesce({c}, false)::INT AS {c}' for c in ('dup_title', 'conflict', 'cross_agent', 'near_miss'))}, {_COS} FROM flags f LEFT JOIN norms n ON n.repo = f.repo AND n.pr_a = f.pr_a AND n.pr_b = f.pr_b LEFT JOIN dots d ON d.repo = f.repo AND d.pr_a = f.pr_a AND d.pr_b = f.pr_b"))
def hybrid_features(spark, sf):
    return T.hybrid_features(settle(B.with_bodies(spark, sf, flags(spark, sf)).drop("files_a", "files_b")), PAIR)


@query(wf("SELECT primary_stratum, n, n_both_ok, round(n_both_ok / n, 9) AS share FROM (SELECT primary_stratum, count(*) AS n, count(*) FILTER (pr_a % 5 NOT IN (0, 1) AND pr_b % 5 NOT IN (0, 1)) AS n_both_ok FROM flags GROUP BY 1)"))
def fetch_coverage(spark, sf):
    """A fifth of the requests was never fetched, and another failed."""
    status = B.requests(spark, sf).where("pr % 5 <> 0").select("repo", "pr", (F.col("pr") % 5 != 1).alias("ok"))
    return audit.status_coverage(flags(spark, sf), status, "primary_stratum")


_SPANS = "SELECT repo, pr_a AS pr, opened_a AS o, closed_a AS c FROM labeled UNION SELECT repo, pr_b, opened_b, closed_b FROM labeled"
_TOUCH = "SELECT DISTINCT repo, pr, path FROM spans JOIN files USING (pr)"
_AGAIN = "SELECT x.repo, count(*) AS replayed FROM (SELECT DISTINCT a.repo, a.pr AS pa, b.pr AS pb FROM touch a JOIN touch b ON a.repo = b.repo AND a.path = b.path AND a.pr < b.pr) x JOIN spans s ON s.repo = x.repo AND s.pr = pa JOIN spans t ON t.repo = x.repo AND t.pr = pb WHERE greatest(s.o, t.o) < least(s.c, t.c) GROUP BY 1"


@query(w("SELECT l.repo, labeled, coalesce(replayed, 0) AS replayed, labeled = coalesce(replayed, 0) AS same FROM (SELECT repo, count(*) FILTER (conflict) AS labeled FROM labeled GROUP BY 1) l LEFT JOIN again r ON r.repo = l.repo", "labeled", "files", spans=_SPANS, touch=_TOUCH, again=_AGAIN))
def replay_check(spark, sf):
    d = B.labeled(spark, sf)
    f = B.files(spark, sf).join(B.requests(spark, sf).select("repo", "pr"), "pr").select("repo", "pr", "path")
    return audit.replay_check(d, C.all_pairs_by_file(f))


@query(f"SELECT k.n, k.agreement, k.kappa, f.kappa AS fleiss, a.alpha FROM ({SQL['kappa']}) k, ({SQL['fleiss']}) f, ({SQL['krippendorff']}) a")
def agreement_report(spark, sf):
    t = two_raters(spark, sf)
    return annotate.agreement([t.select("doc_id", F.col(c).alias("label_category")) for c in "ab"], "doc_id")


@query(w("SELECT count(*) AS n_repos, round(avg(r), 9) AS macro_rate, round(sum(k) / sum(n), 9) AS pooled_rate FROM (SELECT count(*) AS n, count(*) FILTER (conflict) AS k, avg(conflict::INT) AS r FROM labeled GROUP BY repo)", "labeled"))
def macro_rate(spark, sf):
    """Conflict rate as a mean over repositories, and over pairs."""
    g = S.rate_table(B.labeled(spark, sf), "repo")
    return g.agg(F.count("*").alias("n_repos"), F.round(F.avg(F.col("k") / F.col("n")), 9).alias("macro_rate"), F.round(F.sum("k") / F.sum("n"), 9).alias("pooled_rate"))


@query(w("SELECT CAST(length(CAST(size AS VARCHAR)) AS INT) AS n_digits, count(*) AS n, sum(size)::BIGINT AS n_lines FROM (SELECT pr, sum(additions + deletions) AS size FROM files GROUP BY 1) GROUP BY 1", "files"))
def pr_size_histogram(spark, sf):
    """Changed lines of a request, in bins of one decimal digit more each."""
    s = B.files(spark, sf).groupBy("pr").agg(F.sum(F.col("additions") + F.col("deletions")).alias("size"))
    return s.groupBy(F.length(F.col("size").cast("string")).alias("n_digits")).agg(F.count("*").alias("n"), F.sum("size").alias("n_lines"))


_ORDER = "md5(concat_ws('|', '7', repo, pr_a, pr_b))"


@query(w(f"SELECT {KEY} FROM (SELECT *, {_ORDER} AS h, row_number() OVER (PARTITION BY repo ORDER BY {_ORDER}, {KEY}) AS r FROM labeled) WHERE r <= 10 ORDER BY h, {KEY} LIMIT 300", "labeled"))
def pilot_sample(spark, sf):
    """At most 10 pairs of a repository, and of those 300: a pilot for a judge, drawn in seeded order."""
    h = F.md5(F.concat_ws("|", F.lit("7"), *(F.col(c).cast("string") for c in PAIR)))
    d = B.labeled(spark, sf).select(*PAIR).withColumn("h", h)
    d = d.withColumn("r", F.row_number().over(Window.partitionBy("repo").orderBy("h", *PAIR))).where("r <= 10")
    return d.orderBy("h", *PAIR).limit(300).select(*PAIR)


@query(w("SELECT 'conflicts' AS \"column\", count(*) AS n, max(abs(labeled - coalesce(replayed, 0)))::DOUBLE AS max_diff, count(*) FILTER (abs(labeled - coalesce(replayed, 0)) > 0.001) AS n_differ FROM (SELECT repo, count(*) FILTER (conflict) AS labeled FROM labeled GROUP BY 1) LEFT JOIN again USING (repo)", "labeled", "files", spans=_SPANS, touch=_TOUCH, again=_AGAIN))
def replay_differences(spark, sf):
    """Labelled and replayed conflicts by repository: the largest difference, and how many differ."""
    r = settle(replay_check(spark, sf))
    return compared(r.select("repo", F.col("labeled").alias("conflicts")), r.select("repo", F.col("replayed").alias("conflicts")), ["repo"], ["conflicts"])


@query()
def audit_sections(spark, sf):
    """All eight sections of the audit over pairs, flags, frame, labels, judgements, evidence and split."""
    from weftline.plans import programs, samples

    f = settle(flags(spark, sf))
    made = S2.framed(samples.prevalence(spark, sf, f), samples.enriched(spark, sf, f), f, PAIR)
    gold = B.read(spark, sf, "labels").select(F.col("doc_id").alias("item"), F.when(F.col("toxic") == 1, "H").otherwise("none").alias("label"))
    judged = programs.judge_echo(spark, sf).select(F.col("doc_id").alias("item"), "category", F.lit("kept").alias("raw_text"))
    return audit.full_audit(f, f, made["frame"], gold, judged, programs.evidence(spark, sf), S2.repo_split(f))


@query(f"SELECT contrast, odds_ratio, lo, hi, n_exposed, odds_ratio IS NOT NULL AND (lo > 1 OR hi < 1) AS apart FROM (SELECT * FROM ({SQL['outcome_battery']}) UNION ALL SELECT * FROM ({SQL['mh_robustness']}))")
def odds_forest(spark, sf):
    """Odds ratios of all contrasts with their intervals, as a forest plot shows them."""
    d = QUERIES["outcome_battery"](spark, sf).unionByName(mh_robustness(spark, sf))
    return d.select("contrast", "odds_ratio", "lo", "hi", "n_exposed", F.coalesce((F.col("lo") > 1) | (F.col("hi") < 1), F.lit(False)).alias("apart"))
