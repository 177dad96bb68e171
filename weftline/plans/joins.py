"""Queries on entities and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import numbers as N
from weftline.operators import coactive as C
from weftline.plans import binding as B
from weftline.plans.binding import with_parts as w
from weftline.plans.registry import query

PAIR = ["repo", "pr_a", "pr_b"]


@query(w("SELECT least(agent_a, agent_b) AS agent_1, greatest(agent_a, agent_b) AS agent_2, count(*) AS n, count(*) FILTER (conflict) AS k, count(*) FILTER (conflict) / count(*) AS rate FROM labeled GROUP BY 1, 2", "labeled"))
def coactive_conflict_rate_by_agent_pair(spark, sf):
    d = B.labeled(spark, sf).groupBy(F.least("agent_a", "agent_b").alias("agent_1"), F.greatest("agent_a", "agent_b").alias("agent_2"))
    return d.agg(F.count("*").alias("n"), F.count_if("conflict").alias("k")).withColumn("rate", F.col("k") / F.col("n"))


@query(w("SELECT repo, pr_a, pr_b, cross_agent, greatest(0, epoch_us(least(closed_a, closed_b)) - epoch_us(greatest(opened_a, opened_b))) / 3600000000 AS hours FROM pairs", "pairs"))
def coactive_pairs(spark, sf):
    return B.pairs(spark, sf).select(*PAIR, "cross_agent", N.overlap_hours(*map(F.col, ("opened_a", "closed_a", "opened_b", "closed_b"))).alias("hours"))


@query(w("SELECT repo, pr_a, pr_b, conflict, CAST(len(list_intersect(files_a, files_b)) AS INT) AS n_shared FROM labeled", "labeled"))
def conflict_label(spark, sf):
    return B.labeled(spark, sf).select(*PAIR, "conflict", F.size(F.array_intersect("files_a", "files_b")).alias("n_shared"))


@query(w("SELECT p.repo, p.pr_a, p.pr_b, x.path FROM pairs p JOIN files x ON x.pr = pr_a JOIN files y ON y.pr = pr_b AND x.path = y.path", "pairs", "files"))
def shared_files(spark, sf):
    return B.labeled(spark, sf).where("conflict").select(*PAIR, F.explode(F.array_intersect("files_a", "files_b")).alias("path"))


@query(w("SELECT q.repo, n_prs, language, stars FROM (SELECT repo, count(*) AS n_prs FROM requests GROUP BY 1) q LEFT JOIN repositories r ON q.repo = r.repo", "requests", "repositories"))
def repo_dim_left(spark, sf):
    return B.requests(spark, sf).groupBy("repo").agg(F.count("*").alias("n_prs")).join(B.repositories(spark, sf), "repo", "left")


@query(w("SELECT p.repo, p.pr_a, p.pr_b, coalesce(x.title, '') AS title_a, coalesce(y.title, '') AS title_b FROM pairs p LEFT JOIN titles x ON x.pr = pr_a LEFT JOIN titles y ON y.pr = pr_b", "pairs", "titles"))
def lookup_titles(spark, sf):
    t = B.titles(spark, sf)
    d = B.pairs(spark, sf).select(*PAIR)
    for s in "ab":
        d = d.join(t.select(F.col("pr").alias(f"pr_{s}"), F.col("title").alias(f"title_{s}")), f"pr_{s}", "left")
    return d.select(*PAIR, F.coalesce("title_a", F.lit("")).alias("title_a"), F.coalesce("title_b", F.lit("")).alias("title_b"))


@query(w("SELECT repo, pr, epoch_us(opened) AS opened_us, epoch_us(closed) AS closed_us FROM (SELECT repo, pr_a AS pr, opened_a AS opened, closed_a AS closed FROM pairs UNION SELECT repo, pr_b, opened_b, closed_b FROM pairs)", "pairs"))
def pr_intervals(spark, sf):
    return C.intervals(B.pairs(spark, sf)).select("repo", "pr", N.micros(F.col("opened")).alias("opened_us"), N.micros(F.col("closed")).alias("closed_us"))


@query(w("SELECT a.repo, x.pr AS pr_a, y.pr AS pr_b, count(*) AS n_shared FROM files x JOIN files y ON x.path = y.path AND x.pr < y.pr JOIN requests a ON a.pr = x.pr JOIN requests b ON b.pr = y.pr AND a.repo = b.repo GROUP BY 1, 2, 3", "files", "requests"))
def all_pairs_conflict(spark, sf):
    f = B.files(spark, sf).join(B.requests(spark, sf).select("repo", "pr"), "pr").select("repo", "pr", "path")
    return C.all_pairs_by_file(f)


_SCORED = "SELECT repo, CASE WHEN (pr_a + pr_b) % 3 = 0 THEN pr_b ELSE pr_a END AS pa, CASE WHEN (pr_a + pr_b) % 3 = 0 THEN pr_a ELSE pr_b END AS pb, CAST((pr_a * 7 + pr_b) % 100 AS INT) AS score FROM labeled"


@query(w("SELECT l.repo, l.pr_a, l.pr_b, conflict, score, l.pr_a <> s.pa AS swapped FROM labeled l JOIN scored s ON l.repo = s.repo AND ((l.pr_a = s.pa AND l.pr_b = s.pb) OR (l.pr_a = s.pb AND l.pr_b = s.pa))", "labeled", scored=_SCORED))
def swapped_key_join(spark, sf):
    """Scores whose sides may be swapped: two equi-joins, the second over what the first has not."""
    d = B.labeled(spark, sf).select(*PAIR, "conflict")
    odd = (F.col("pr_a") + F.col("pr_b")) % 3 == 0
    s = d.select("repo", F.when(odd, F.col("pr_b")).otherwise(F.col("pr_a")).alias("pa"), F.when(odd, F.col("pr_a")).otherwise(F.col("pr_b")).alias("pb"), ((F.col("pr_a") * 7 + F.col("pr_b")) % 100).cast("int").alias("score"))
    direct = d.join(s.toDF("repo", "pr_a", "pr_b", "score"), PAIR).withColumn("swapped", F.lit(False))
    swapped = d.join(s.toDF("repo", "pr_b", "pr_a", "score"), PAIR).select(*direct.columns[:-1], F.lit(True).alias("swapped"))
    return direct.unionByName(swapped)


@query(w("SELECT repo, pr_a, pr_b FROM labeled l WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.repo = l.repo AND d.pr_a = l.pr_a AND d.pr_b = l.pr_b)", "labeled", done="SELECT repo, pr_a, pr_b FROM labeled WHERE pr_b % 4 = 1"))
def anti_done(spark, sf):
    from weftline.sources.tables import pending

    d = B.labeled(spark, sf).select(*PAIR)
    return pending(d, d.where("pr_b % 4 = 1"), PAIR)


@query(w("SELECT repo, pr, agent, merged FROM requests WHERE pr IN (SELECT pr FROM files WHERE path NOT LIKE '%/%')", "requests", "files"))
def semi_subset(spark, sf):
    root = B.files(spark, sf).where(~F.contains("path", F.lit("/"))).select("pr")
    return B.requests(spark, sf).join(root, "pr", "left_semi").select("repo", "pr", "agent", "merged")


_HELD = "SELECT repo, pr_a, pr_b, conflict FROM labeled WHERE pr_a % 3 = 0"


@query(w("SELECT h.repo, h.pr_a, h.pr_b, round(coalesce(r, (SELECT avg(conflict::INT) FROM train)), 9) AS repo_rate FROM held h LEFT JOIN (SELECT repo, avg(conflict::INT) AS r FROM train GROUP BY 1) q ON q.repo = h.repo", "labeled", held=_HELD, train="SELECT * FROM labeled WHERE NOT pr_a % 3 = 0"))
def rate_backfill(spark, sf):
    from weftline.operators.similarity import repo_rates

    d = B.labeled(spark, sf).select(*PAIR, "conflict")
    return repo_rates(d, d.where("pr_a % 3 = 0"), PAIR).drop("conflict")


@query(w("SELECT 'orders' AS side, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, count(*) - count(o_orderkey) AS n_null FROM orders UNION ALL SELECT 'lines', count(*), count(DISTINCT (l_orderkey, l_linenumber)), count(*) - count(l_orderkey) FROM lineitem"))
def one_to_one_check(spark, sf):
    """Whether a key may stand on either side of a one-to-one join."""
    o, li = B.read(spark, sf, "orders"), B.read(spark, sf, "lineitem")
    one = lambda df, name, key: df.agg(F.lit(name).alias("side"), F.count("*").alias("n_rows"), F.countDistinct(*key).alias("n_keys"), F.count_if(F.col(key[0]).isNull()).alias("n_null"))
    return one(o, "orders", ["o_orderkey"]).union(one(li, "lines", ["l_orderkey", "l_linenumber"]))


@query(w("SELECT agent, count(*) AS n, CAST(sum(size) AS BIGINT) AS total, median(size) AS median_size FROM (SELECT agent, coalesce(s, 0) AS size FROM requests r LEFT JOIN (SELECT pr, sum(additions + deletions) AS s FROM files GROUP BY 1) f ON f.pr = r.pr) GROUP BY 1", "requests", "files"))
def pr_size_median(spark, sf):
    size = B.files(spark, sf).groupBy("pr").agg(F.sum(F.col("additions") + F.col("deletions")).alias("s"))
    d = B.requests(spark, sf).join(size, "pr", "left").select("agent", F.coalesce("s", F.lit(0)).alias("size"))
    return d.groupBy("agent").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.median("size").alias("median_size"))


@query(w("SELECT l_orderkey AS pr, path, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS additions, CAST(sum(l_linenumber) AS BIGINT) AS deletions FROM lines GROUP BY 1, 2", "lines"))
def file_changes(spark, sf):
    return B.files(spark, sf)


@query(w("SELECT n_name AS language, coalesce(r_name, '') AS region, count(*) AS n, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS n_merged FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"))
def merged_by_language(spark, sf):
    n, r = B.read(spark, sf, "nation"), B.read(spark, sf, "region")
    d = B.read(spark, sf, "orders").join(B.read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    d = d.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left")  # 25 and 5 rows
    return d.groupBy(F.col("n_name").alias("language"), F.coalesce("r_name", F.lit("")).alias("region")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_merged"))


_CONC = "SELECT p.repo, p.pr_a, p.pr_b, at_us, (SELECT count(*) FROM spans s WHERE s.repo = p.repo AND epoch_us(s.opened) <= at_us AND epoch_us(s.closed) >= at_us) AS concurrency FROM mid p"
_SPANS = "SELECT repo, pr_a AS pr, opened_a AS opened, closed_a AS closed FROM pairs UNION SELECT repo, pr_b, opened_b, closed_b FROM pairs"
_MID = "SELECT repo, pr_a, pr_b, (epoch_us(greatest(opened_a, opened_b)) + epoch_us(least(closed_a, closed_b))) // 2 AS at_us FROM pairs"


@query(w(_CONC, "pairs", spans=_SPANS, mid=_MID))
def concurrency_at_midpoint(spark, sf):
    p = B.pairs(spark, sf)
    at = p.select(*PAIR, N.midpoint(*map(F.col, ("opened_a", "closed_a", "opened_b", "closed_b"))).alias("at_us"))
    return C.concurrency_at(at, C.intervals(p), "at_us")


@query(
    w(
        "SELECT repo, CAST(sum(opens) AS BIGINT) AS n_prs, CAST(max(level) AS BIGINT) AS max_level, (max(at_us) - min(at_us)) / 86400000000 AS span_days, CASE WHEN max(at_us) > min(at_us) THEN sum(level * held) / (max(at_us) - min(at_us)) END AS mean_level FROM lv GROUP BY 1",
        "pairs", spans=_SPANS,
        ev="SELECT repo, at_us, sum(step) AS step, count(*) FILTER (step > 0) AS opens FROM (SELECT repo, epoch_us(opened) AS at_us, 1 AS step FROM spans UNION ALL SELECT repo, epoch_us(closed), -1 FROM spans) GROUP BY 1, 2",
        lv="SELECT *, CAST(sum(step) OVER (PARTITION BY repo ORDER BY at_us) AS BIGINT) AS level, lead(at_us) OVER (PARTITION BY repo ORDER BY at_us) - at_us AS held FROM ev",
    )
)
def mean_concurrency(spark, sf):
    return C.concurrency_profile(C.intervals(B.pairs(spark, sf)))


@query(
    w(
        "SELECT repo, pr_a, pr_b, n_before, (k + 5.0::DOUBLE) / (n_before + 10.0::DOUBLE) AS rate FROM (SELECT repo, pr_a, pr_b, (SELECT count(*) FROM labeled o WHERE o.repo = l.repo AND greatest(o.closed_a, o.closed_b) < l.opened_b) AS n_before, (SELECT count(*) FROM labeled o WHERE o.repo = l.repo AND o.conflict AND greatest(o.closed_a, o.closed_b) < l.opened_b) AS k FROM labeled l)",
        "labeled",
    )
)
def trailing_rate(spark, sf):
    return C.trailing_rate(B.labeled(spark, sf))


@query("SELECT user_id, event_type, count(*) AS n, CAST(count(*) FILTER (gap_us <= 3600000000) AS BIGINT) AS n_within_hour FROM (SELECT user_id, event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events) GROUP BY 1, 2")
def event_gaps(spark, sf):
    from pyspark.sql import Window

    o = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = B.read(spark, sf, "events").select("user_id", "event_type", (N.micros(F.col("ts")) - F.lag(N.micros(F.col("ts"))).over(o)).alias("gap"))
    return d.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("gap") <= 3_600_000_000).alias("n_within_hour"))
