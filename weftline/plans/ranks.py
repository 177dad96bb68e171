"""Queries on scores against labels, and on text similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import ranking as R
from weftline.operators import similarity as T
from weftline.plans import binding as B
from weftline.plans.binding import with_parts as w
from weftline.plans.joins import PAIR
from weftline.plans.registry import SQL, query
from weftline.sources.scratch import settle


def q_words(t):
    return f"list_distinct(regexp_extract_all(lower({t}), '[a-z0-9_]+'))"


def scored(spark, sf):
    """Each pair's title similarity as a score of conflict."""
    ta, tb = F.array_distinct(X.word_tokens(F.col("title_a"))), F.array_distinct(X.word_tokens(F.col("title_b")))
    return B.titled(spark, sf).select(*PAIR, F.round(X.jaccard(ta, tb, 0.0), 9).alias("score"), F.col("conflict").cast("int").alias("label"))


scored.sql = f"SELECT repo, pr_a, pr_b, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) END AS score, conflict::INT AS label FROM (SELECT *, {q_words('title_a')} AS a, {q_words('title_b')} AS b FROM titled)"
_BLOCKS = "SELECT score, sum(label) AS pos, count(*) AS n, coalesce(sum(count(*)) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb, coalesce(sum(sum(label)) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb FROM s GROUP BY 1"


def ws(body, **more):
    return w(body, "titled", s=scored.sql, **more)


@query(ws("SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(n - pos) AS BIGINT) AS n_neg, round(sum(pos * (2 * (nb - pb) + n - pos)) / (2 * sum(pos) * sum(n - pos)), 9) AS auc FROM k", k=_BLOCKS))
def auc(spark, sf):
    return R.auc(scored(spark, sf), "score", "label")


@query(ws("SELECT score, round(sum(pos) OVER (ORDER BY score DESC) / sum(pos) OVER (), 9) AS tpr, round(sum(n - pos) OVER (ORDER BY score DESC) / sum(n - pos) OVER (), 9) AS fpr FROM k", k=_BLOCKS))
def roc_points(spark, sf):
    return R.roc_points(scored(spark, sf), "score", "label")


@query(ws("SELECT k, round(hits / k, 9) AS precision FROM (SELECT CAST(row_number() OVER o AS INT) AS k, sum(label) OVER (ORDER BY score DESC, repo, pr_a, pr_b ROWS UNBOUNDED PRECEDING) AS hits FROM s WINDOW o AS (ORDER BY score DESC, repo, pr_a, pr_b)) WHERE k % 10 = 0 AND k <= 400"))
def precision_at_k(spark, sf):
    return R.precision_at(scored(spark, sf), "score", "label", list(range(10, 401, 10)), PAIR)


@query(ws("SELECT round(sum(pos * prec) / nullif(sum(pos), 0), 9) AS average_precision, round(sum(pos * (1 - score) * (1 - score) + (n - pos) * score * score) / sum(n), 9) AS brier FROM (SELECT *, sum(pos) OVER (ORDER BY score DESC) / sum(n) OVER (ORDER BY score DESC) AS prec FROM k)", k=_BLOCKS))
def avg_precision(spark, sf):
    return R.average_precision(scored(spark, sf), "score", "label")


@query(ws("SELECT bin, n, round(m, 9) AS mean_score, round(p, 9) AS rate, round(greatest(0, (p + 3.8414588206941236 / (2.0 * n) - sp) / (1 + 3.8414588206941236 / n)), 9) AS lo, round(least(1, (p + 3.8414588206941236 / (2.0 * n) + sp) / (1 + 3.8414588206941236 / n)), 9) AS hi FROM (SELECT *, 1.959963984540054 * sqrt(p * (1 - p) / n + 3.8414588206941236 / (4.0 * n * n)) AS sp FROM (SELECT CAST(least(floor(score * 5), 4) AS INT) AS bin, count(*) AS n, avg(score) AS m, sum(label)::DOUBLE / count(*) AS p FROM s GROUP BY 1))"))
def reliability(spark, sf):
    return R.reliability(scored(spark, sf), "score", "label")


@query(
    ws(
        "SELECT count(*) AS n_groups, round(avg(auc), 9) AS mean_auc, round(median(auc), 9) AS median_auc, round(avg((auc > 0.5)::INT), 9) AS share_over_half, round(sum(auc * n) / sum(n), 9) AS weighted_auc FROM (SELECT repo, sum(n) AS n, sum(pos) AS np, round(sum(pos * (2 * (nb - pb) + n - pos)) / (2 * sum(pos) * sum(n - pos)), 15) AS auc FROM k GROUP BY 1 HAVING sum(pos) > 0 AND sum(n - pos) > 0 AND sum(n) >= 5)",
        k="SELECT repo, score, sum(label) AS pos, count(*) AS n, coalesce(sum(count(*)) OVER (PARTITION BY repo ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb, coalesce(sum(sum(label)) OVER (PARTITION BY repo ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb FROM s GROUP BY 1, 2",
    )
)
def within_repo_auc(spark, sf):
    return R.within_group_auc(scored(spark, sf), "repo", "score", "label", 5)


@query(ws("SELECT repo, pr_a, pr_b, round((r1 + r2) / (n * 2), 9) AS ensemble FROM (SELECT repo, pr_a, pr_b, count(*) OVER () AS n, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r1, rank() OVER (ORDER BY other) + (count(*) OVER (PARTITION BY other) - 1) / 2 AS r2 FROM (SELECT *, pr_b % 13 AS other FROM s))"))
def rank_ensemble(spark, sf):
    return R.rank_ensemble(scored(spark, sf).withColumn("other", F.col("pr_b") % 13), ["score", "other"], PAIR)


@query(
    w(
        "SELECT t.repo, t.pr_a, t.pr_b, round(coalesce(CASE WHEN na > 0 AND nb > 0 THEN dot / sqrt(na * nb) ELSE 0 END, 0), 9) AS cosine FROM titled t LEFT JOIN (SELECT repo, pr_a, pr_b, sum(wa * wb) AS dot, sum(wa * wa) AS na, sum(wb * wb) AS nb FROM (SELECT tf.*, CASE WHEN ca > 0 THEN 1 + ln(ca) ELSE 0 END * idf AS wa, CASE WHEN cb > 0 THEN 1 + ln(cb) ELSE 0 END * idf AS wb FROM tf JOIN (SELECT token, ln((1 + (SELECT 2 * count(*) FROM titled)) / (1 + sum((ca > 0)::INT + (cb > 0)::INT))) + 1 AS idf FROM tf GROUP BY 1) d USING (token)) GROUP BY 1, 2, 3) g ON g.repo = t.repo AND g.pr_a = t.pr_a AND g.pr_b = t.pr_b",
        "titled",
        tf="SELECT repo, pr_a, pr_b, token, count(*) FILTER (side = 0) AS ca, count(*) FILTER (side = 1) AS cb FROM (SELECT repo, pr_a, pr_b, 0 AS side, unnest(regexp_extract_all(lower(coalesce(title_a, '')), '[a-z0-9_]+')) AS token FROM titled UNION ALL SELECT repo, pr_a, pr_b, 1, unnest(regexp_extract_all(lower(coalesce(title_b, '')), '[a-z0-9_]+')) FROM titled) GROUP BY 1, 2, 3, 4",
    )
)
def tfidf_cosine(spark, sf):
    return T.tfidf_cosine(B.titled(spark, sf), PAIR, F.col("title_a"), F.col("title_b"))


@query(w(f"SELECT repo, pr_a, pr_b, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) END AS title_jaccard, round(ln(1 + greatest(0, epoch_us(least(closed_a, closed_b)) - epoch_us(greatest(opened_a, opened_b))) / 3600000000), 9) AS log_overlap, (agent_a = agent_b)::INT AS same_agent, CAST(len(list_intersect(list_filter(files_a, lambda p: contains(p, '/')), list_filter(files_b, lambda p: contains(p, '/')))) AS INT) AS filename_overlap, least(agent_a, agent_b) || '+' || greatest(agent_a, agent_b) AS agent_pair FROM (SELECT *, {q_words('title_a')} AS a, {q_words('title_b')} AS b FROM titled)", "titled"))
def ladder_features(spark, sf):
    return T.ladder_features(B.titled(spark, sf), PAIR)


@query(ws("SELECT count(*) FILTER (label = 0 AND score >= 0.9) AS n_false_high, count(*) FILTER (label = 1 AND score <= 0.1) AS n_false_low, count(*) AS n FROM s"))
def confident_errors(spark, sf):
    s, y = F.col("score"), F.col("label")
    return scored(spark, sf).agg(F.count_if((y == 0) & (s >= 0.9)).alias("n_false_high"), F.count_if((y == 1) & (s <= 0.1)).alias("n_false_low"), F.count("*").alias("n"))


@query(ws("(SELECT 'high' AS side, repo, pr_a, pr_b, score FROM s WHERE label = 0 ORDER BY score DESC, repo, pr_a, pr_b LIMIT 5) UNION ALL (SELECT 'low', repo, pr_a, pr_b, score FROM s WHERE label = 1 ORDER BY score, repo, pr_a, pr_b LIMIT 5)"))
def worst_errors(spark, sf):
    d = scored(spark, sf)
    high = d.where("label = 0").orderBy(F.desc("score"), *PAIR).limit(5).select(F.lit("high").alias("side"), *PAIR, "score")
    return high.union(d.where("label = 1").orderBy("score", *PAIR).limit(5).select(F.lit("low").alias("side"), *PAIR, "score"))


@query(ws("SELECT repo, pr_a, pr_b, CAST(ntile(5) OVER (ORDER BY md5(concat_ws('|', '0', repo, pr_a, pr_b)), repo, pr_a, pr_b) AS INT) AS fold FROM s"))
def folds(spark, sf):
    return R.folds(B.labeled(spark, sf).select(*PAIR), PAIR, 5, 0)


@query(ws("SELECT CAST(least(floor(abs(label - score) * 20), 19) AS INT) AS bin, count(*) AS n FROM s GROUP BY 1"))
def error_histogram(spark, sf):
    e = F.abs(F.col("label") - F.col("score"))
    return scored(spark, sf).groupBy(F.least(F.floor(e * 20), F.lit(19)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query(ws("SELECT n, n_pos, n - n_pos AS n_neg, auroc, CASE WHEN n_pos BETWEEN 1 AND n - 1 THEN average_precision END AS auprc, brier, round(coalesce(tp / nullif(guessed, 0), 0), 9) AS precision, round(coalesce(tp / nullif(n_pos, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(guessed + n_pos, 0), 0), 9) AS f1 FROM (SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos, count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (score >= 0.5) AS guessed FROM s), (SELECT auc AS auroc FROM (" + SQL["auc"] + ")), (" + SQL["avg_precision"] + ")"))
def binary_report(spark, sf):
    return R.binary_report(settle(scored(spark, sf)), "score", "label")
