"""Queries on schedules, merge hunks, symbols, models and judges."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import numbers as N
from weftline.functions import text as X
from weftline.operators import coactive as C
from weftline.operators import hunks as H
from weftline.operators import models as M
from weftline.operators import ranking as R
from weftline.operators import sampling as S
from weftline.operators import schedule as D
from weftline.operators import similarity as T
from weftline.operators import symbols as Y
from weftline.plans import binding as B
from weftline.plans.binding import with_parts as w
from weftline.plans.joins import PAIR
from weftline.plans.pools import flags
from weftline.plans.ranks import scored
from weftline.plans.registry import SQL, query
from weftline.sources.scratch import settle

# Episodes of the small corpus: repositories with at least 8 pairs and one conflict.
_EPS = (
    "SELECT s.repo, pr, CASE WHEN cens THEN least(dur, CAST(floor(coalesce(med, (SELECT median(dur) FILTER (NOT cens) FROM sp), dur)) AS BIGINT)) ELSE dur END AS dur, opened - first AS arr FROM sp s JOIN (SELECT repo, median(dur) FILTER (NOT cens) AS med, min(opened) AS first FROM sp GROUP BY 1) m ON m.repo = s.repo"
)
_SP = "SELECT repo, pr, opened, closed - opened AS dur, closed >= (SELECT max(greatest(epoch_us(closed_a), epoch_us(closed_b))) FROM labeled) AS cens FROM (SELECT repo, pr_a AS pr, epoch_us(opened_a) AS opened, epoch_us(closed_a) AS closed FROM labeled UNION SELECT repo, pr_b, epoch_us(opened_b), epoch_us(closed_b) FROM labeled) WHERE repo IN (SELECT repo FROM labeled GROUP BY 1 HAVING count(*) >= 8 AND count(*) FILTER (conflict) >= 1)"
_FIFO = "SELECT *, CAST(max(arr - before) OVER (PARTITION BY repo ORDER BY arr, pr) + before AS BIGINT) AS start FROM (SELECT *, coalesce(sum(dur) OVER (PARTITION BY repo ORDER BY arr, pr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM eps)"
_SHARED = "SELECT a.repo, a.pr AS pr_a, b.pr AS pr_b FROM (SELECT DISTINCT e.repo, e.pr, path FROM eps e JOIN files f ON f.pr = e.pr) a JOIN (SELECT DISTINCT e.repo, e.pr, path FROM eps e JOIN files f ON f.pr = e.pr) b ON a.repo = b.repo AND a.path = b.path AND a.pr < b.pr GROUP BY 1, 2, 3"
_OBS = "SELECT s.repo, s.pr_a, s.pr_b FROM shared s JOIN eps x ON x.repo = s.repo AND x.pr = s.pr_a JOIN eps y ON y.repo = s.repo AND y.pr = s.pr_b WHERE greatest(x.arr, y.arr) < least(x.arr + x.dur, y.arr + y.dur)"
EPS = {"sp": _SP, "eps": _EPS, "ff": _FIFO, "shared": _SHARED, "obs": _OBS}


def we(body):
    return w(body, "labeled", "files", **EPS)


def eps(spark, sf):
    """Episodes; they and their pairs are read several times by what follows, so both are settled."""
    return settle(D.episodes(settle(B.labeled(spark, sf).drop("files_a", "files_b")), 8, 1))


def shared(spark, sf, e):
    f = B.files(spark, sf).join(e.select("repo", "pr"), "pr").select("repo", "pr", "path")
    return settle(C.all_pairs_by_file(f).select(*PAIR))


@query(we("SELECT repo, pr, dur, arr FROM eps"))
def episodes(spark, sf):
    return eps(spark, sf)


@query(we("SELECT repo, pr, dur, arr, start FROM ff"))
def fifo_schedule(spark, sf):
    return D.fifo(eps(spark, sf))


@query(we("SELECT repo, count(*) AS n_conflicts FROM obs GROUP BY 1"))
def observed_conflicts(spark, sf):
    e = eps(spark, sf)
    return D.schedule_conflicts(D.observed(e), shared(spark, sf, e)).groupBy("repo").agg(F.count("*").alias("n_conflicts"))


_DAY = "86400000000"


@query(
    we(
        f"SELECT g.repo, 'fifo' AS policy, n_prs, CAST(0 AS BIGINT) AS conflicts, coalesce(o, 0) AS obs_conflicts, round(100.0 * coalesce(o, 0) / nullif(coalesce(o, 0), 0), 6) AS avoided_pct, CAST(0 AS BIGINT) AS new_conflicts, round(delay / {_DAY}, 6) AS added_delay_days, round(delay / {_DAY} / n_prs, 6) AS delay_days_per_pr, round(ms / {_DAY}, 6) AS makespan_days, round(100.0 * (ms - bms) / bms, 6) AS makespan_inflation_pct FROM (SELECT repo, count(*) AS n_prs, sum(start - arr) AS delay, max(start + dur) AS ms, max(arr + dur) AS bms FROM ff GROUP BY 1) g LEFT JOIN (SELECT repo, count(*) AS o FROM obs GROUP BY 1) q ON q.repo = g.repo"
    )
)
def episode_metrics(spark, sf):
    e = eps(spark, sf)
    return D.episode_metrics(D.fifo(e), D.observed(e), shared(spark, sf, e), "fifo")


def gate_metrics(e, both, scores, tau, name):
    return D.episode_metrics(settle(D.gated(e, scores, tau)), D.observed(e), both, name)


@query()
def oracle_gate(spark, sf):
    """No conflict is left: the gate knows all pairs that share a file."""
    e = eps(spark, sf)
    both = shared(spark, sf, e)
    return gate_metrics(e, both, both.withColumn("score", F.lit(1.0)), 0.5, "oracle")


# Thresholds of the sweep.
TAUS = (0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.65, 0.8)


def sweep(spark, sf):
    """Per repository and threshold: the predictor's gate at nine thresholds."""
    e = eps(spark, sf)
    t = B.titles(spark, sf)
    both = d = shared(spark, sf, e)
    for s in "ab":
        d = d.join(t.select(F.col("pr").alias(f"pr_{s}"), F.col("title").alias(f"title_{s}")), f"pr_{s}", "left")
    j = X.jaccard(X.title_tokens(X.normalize_title(F.col("title_a"))), X.title_tokens(X.normalize_title(F.col("title_b"))), 1.0)
    starts = settle(D.gated_at(e, settle(d.select(*PAIR, j.alias("score"))), TAUS))
    return D.episode_metrics(starts, D.observed(e), both, "predictor", ("tau",))


@query()
def tau_sweep(spark, sf):
    """Summary of the predictor's gate at each threshold."""
    return D.policy_summary(settle(sweep(spark, sf)), ["policy", "tau"])


@query()
def policy_pareto(spark, sf):
    """Quartiles of delay, makespan and avoided conflicts over episodes, of every policy and threshold: both Pareto figures."""
    e = eps(spark, sf)
    both = shared(spark, sf, e)
    none = F.lit(None).cast("double")
    fixed = D.episode_metrics(D.fifo(e), D.observed(e), both, "fifo").unionByName(gate_metrics(e, both, both.withColumn("score", F.lit(1.0)), 0.5, "oracle"))
    return D.policy_summary(settle(fixed.withColumn("tau", none).unionByName(sweep(spark, sf))), ["policy", "tau"])


@query()
def tau_knee(spark, sf):
    """Of each episode: the largest threshold that still avoids nine tenths of its conflicts, and its delay there; null where none does."""
    m = settle(sweep(spark, sf)).where("obs_conflicts > 0")
    good = F.when(F.col("avoided_pct") >= 90, F.struct("tau", "delay_days_per_pr"))
    return m.groupBy("repo").agg(F.max("obs_conflicts").alias("obs_conflicts"), F.max(good).alias("k")).select("repo", "obs_conflicts", "k.tau", "k.delay_days_per_pr")


# Patches made of the lines of an order: definitions and uses of names by return flag.
_PATCH = "SELECT l_orderkey AS pr, lower(p_type) || '/' || split_part(p_name, ' ', 2) || '.py' AS path, string_agg(CASE WHEN l_returnflag = 'A' THEN '+def ' WHEN l_returnflag = 'R' THEN '-def ' ELSE '+  ' END || replace(p_name, ' ', '_') || '(x)', chr(10) ORDER BY l_returnflag, p_name) AS patch FROM lines GROUP BY 1, 2"


def patches(spark, sf):
    name = F.regexp_replace("p_name", " ", "_")
    line = F.concat(F.when(F.col("l_returnflag") == "A", "+def ").when(F.col("l_returnflag") == "R", "-def ").otherwise("+  "), name, F.lit("(x)"))
    path = F.concat(F.lower("p_type"), F.lit("/"), F.split("p_name", " ")[1], F.lit(".py"))
    d = B.lines(spark, sf).select(F.col("l_orderkey").alias("pr"), path.alias("path"), F.struct("l_returnflag", "p_name", line.alias("line")).alias("s"))
    return d.groupBy("pr", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["line"]), "\n").alias("patch"))


@query(w(f"SELECT pr, path, array_to_string(list_transform(list_filter(string_split(patch, chr(10)), lambda x: x LIKE '+%'), lambda x: x[2:]), chr(10)) AS added, array_to_string(list_transform(list_filter(string_split(patch, chr(10)), lambda x: x LIKE '-%'), lambda x: x[2:]), chr(10)) AS deleted FROM ({_PATCH})", "lines"))
def diff_split(spark, sf):
    return patches(spark, sf).select("pr", "path", F.inline(F.array(Y.split_diff(F.col("patch")))))


_EVENTS = "SELECT DISTINCT l_orderkey AS pr, lower(p_type) || '/' || split_part(p_name, ' ', 2) || '.py' AS file, 'python' AS lang, unnest(CASE l_returnflag WHEN 'A' THEN ['def', 'use'] WHEN 'R' THEN ['deleted_def', 'use'] ELSE ['use'] END) AS kind, replace(p_name, ' ', '_') AS name FROM lines"


@query(w(_EVENTS, "lines"))
def symbol_events(spark, sf):
    return Y.symbol_events(patches(spark, sf), ["pr"])


_SIDES = "SELECT repo, pr_a, pr_b, 'A' AS side, p.* EXCLUDE pr FROM labeled JOIN pf p ON p.pr = pr_a UNION ALL SELECT repo, pr_a, pr_b, 'B', p.* EXCLUDE pr FROM labeled JOIN pf p ON p.pr = pr_b"
_PROFILE = "SELECT pr, name, min(file) FILTER (kind = 'def') AS def, min(file) FILTER (kind = 'deleted_def') AS del, min(file) FILTER (kind = 'use') AS used FROM ev GROUP BY 1, 2"
_MET = "SELECT a.repo, a.pr_a, a.pr_b, a.side || '->' || b.side AS direction, a.name AS symbol, a.def, a.del, b.used FROM sides a JOIN sides b ON a.repo = b.repo AND a.pr_a = b.pr_a AND a.pr_b = b.pr_b AND a.name = b.name AND a.side <> b.side WHERE b.used IS NOT NULL"
_KEYS = "repo, pr_a, pr_b"
_EVIDENCE = (
    f"SELECT {_KEYS}, 'changed_definition_used_by_partner' AS relation, 0.91::DOUBLE AS confidence, direction, symbol, def AS definition_file, used AS consumer_file FROM met WHERE def IS NOT NULL"
    f" UNION ALL SELECT {_KEYS}, 'deleted_definition_used_by_partner', 0.93::DOUBLE, direction, symbol, del, used FROM met WHERE del IS NOT NULL"
    f" UNION ALL SELECT {_KEYS}, 'identifier_similarity_fallback', 0.35::DOUBLE, direction, symbol, def, used FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY symbol) AS r FROM met WHERE def IS NOT NULL AND direction = 'A->B' AND length(symbol) >= 6) WHERE r <= 8"
)
EVIDENCE = {"ev": _EVENTS, "pf": _PROFILE, "sides": _SIDES, "met": _MET, "evidence": _EVIDENCE}


def evidence(spark, sf):
    ev = settle(Y.symbol_events(patches(spark, sf), ["pr"]))
    pairs = B.labeled(spark, sf).select(*PAIR)
    return Y.detect_requests(pairs, ev, PAIR)


@query(w(f"SELECT {_KEYS}, relation, confidence, direction, symbol, definition_file, consumer_file FROM evidence", "labeled", "lines", **EVIDENCE))
def def_use_pairs(spark, sf):
    return evidence(spark, sf).drop("changed_file")


_TOLD = f"SELECT {_KEYS}, min((-confidence, relation, direction, symbol, definition_file, consumer_file)) AS t, bool_or(direction = 'A->B') AS ab, bool_or(direction = 'B->A') AS ba, count(*) AS n FROM evidence WHERE confidence >= 0.5 GROUP BY 1, 2, 3"


@query(w("SELECT l.repo, l.pr_a, l.pr_b, t IS NOT NULL AS prediction, CASE WHEN ab AND ba THEN 'both' WHEN ab THEN 'A->B' WHEN ba THEN 'B->A' ELSE 'none' END AS direction, coalesce(t[2], 'none') AS relation, coalesce(t[4], '') AS symbol, coalesce(t[5], '') AS definition_file, coalesce(t[6], '') AS consumer_file, coalesce(-t[1], 0) AS confidence, coalesce(n, 0) AS n_evidence FROM labeled l LEFT JOIN told d ON d.repo = l.repo AND d.pr_a = l.pr_a AND d.pr_b = l.pr_b", "labeled", "lines", **EVIDENCE, told=_TOLD))
def pair_verdict(spark, sf):
    """Every pair's verdict; of two relations of one confidence the first in the table leads (here confidences differ)."""
    return Y.verdict(evidence(spark, sf), PAIR, pairs=B.labeled(spark, sf))


@query()
def verification_bundle(spark, sf):
    """What a human checks: verdicts that predict, with their evidence and both titles."""
    e = settle(evidence(spark, sf))
    t = B.titled(spark, sf).select(*PAIR, "title_a", "title_b")
    return Y.verification_bundle(Y.verdict(e, PAIR).where("prediction"), e, PAIR, t)


def conflicted(spark, sf):
    """A file with two hunks for each text, over all its words: one whose sides lack the last and the first word, one of the first and the last alone."""
    d = B.read(spark, sf, "documents").where("text is not null").select("doc_id", F.split("text", " ").alias("w"))
    ours, theirs = F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1)
    first, last = F.col("w")[0], F.element_at("w", -1)
    text = F.concat(F.lit("head\n<<<<<<< ours\n"), F.array_join(ours, "\n"), F.lit("\n||||||| base\nx\n=======\n"), F.array_join(theirs, "\n"), F.lit("\n>>>>>>> theirs\nmid\n<<<<<<< ours\n"), first, F.lit("\n=======\n"), last, F.lit("\n>>>>>>> theirs\ntail"))
    truth = F.when(F.col("doc_id") % 2 == 0, ours).otherwise(F.col("w"))
    return d.select("doc_id", text.alias("text"), truth.alias("truth"))


_LINES = "array_to_string(string_split(array_to_string({}, chr(10)), chr(10)), '|')"


@query(f"SELECT doc_id, h.* FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL), LATERAL (SELECT CAST(0 AS INT) AS hunk, 'head' AS pre, {_LINES.format('w[1:len(w) - 1]')} AS ours, {_LINES.format('w[2:]')} AS theirs, 'mid' AS post UNION ALL SELECT CAST(1 AS INT), 'head|mid', {_LINES.format('w[1:1]')}, {_LINES.format('w[len(w):]')}, 'tail') h")
def parse_hunks(spark, sf):
    """Two hunks a file: what stands between them is after the one and before the other."""
    h = H.explode_hunks(conflicted(spark, sf), ["doc_id"])
    return h.select("doc_id", "hunk", *(F.array_join(c, "|").alias(c) for c in ("pre", "ours", "theirs", "post")))


def with_truth(spark, sf):
    """The first hunk of each file with the lines that stand there in the end; of texts with an id divisible by 7 the place is not known."""
    c = conflicted(spark, sf)
    known = F.when(F.col("doc_id") % 7 != 0, F.col("truth"))
    return H.explode_hunks(c, ["doc_id"]).where("hunk = 0").join(c.select("doc_id", known.alias("truth")), "doc_id")


@query()
def resolver_scores(spark, sf):
    c = conflicted(spark, sf)
    h = H.explode_hunks(c, ["doc_id"]).where("hunk = 0").join(c.select("doc_id", "truth"), "doc_id")
    return H.resolver_summary(H.resolver_scores(h))


@query("SELECT sum(n)::BIGINT AS n_hunks, sum(k)::BIGINT AS n_located, round(sum(k) / sum(n), 6) AS share, round(avg(k / n), 6) AS macro_share, count(*) AS n_groups FROM (SELECT source, count(*) AS n, count(*) FILTER (doc_id % 7 <> 0) AS k FROM documents WHERE text IS NOT NULL GROUP BY 1)")
def locatable_share(spark, sf):
    """Of hunks whose place in the end is known, as a share and as a mean over sources."""
    by = B.read(spark, sf, "documents").select("doc_id", "source")
    return H.locatable(with_truth(spark, sf).join(by, "doc_id"), ["source"])


_COMMITS = "SELECT o_custkey AS repo, o_orderdate AS done, 'c' || o_orderkey AS sha FROM orders"


@query(w("SELECT l.repo, l.pr_a, l.pr_b, (SELECT min((epoch_us(done), sha))[2] FROM cm WHERE cm.repo = l.repo AND done > greatest(l.closed_a, l.closed_b)) AS recon_sha FROM labeled l", "labeled", cm=_COMMITS))
def recon_commit(spark, sf):
    c = B.read(spark, sf, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderdate").alias("at"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("sha"))
    return H.first_commit_after(B.labeled(spark, sf), c)


_STATUS = "CASE WHEN doc_id % 11 = 0 THEN 'ref_missing' WHEN doc_id % 7 = 0 THEN 'merge_timeout' WHEN doc_id % 5 = 0 THEN 'no_merge_base' WHEN doc_id % 3 = 0 THEN 'clean' WHEN doc_id % 3 = 1 THEN 'conflict' ELSE 'merge_error' END"


@query(f"SELECT {_STATUS} AS status, count(*) AS n FROM documents GROUP BY 1")
def merge_status(spark, sf):
    i = F.col("doc_id")
    s = H.merge_status(i % 3, i % 11 == 0, F.when(i % 5 != 0, F.lit("base")), F.array(F.lit("f")), i % 7 == 0)
    return B.read(spark, sf, "documents").groupBy(s.alias("status")).agg(F.count("*").alias("n"))


FEATS = ["title_jaccard", "log_overlap", "same_agent"]


def model_rows(spark, sf):
    d = B.titled(spark, sf)
    return T.ladder_features(d, [*PAIR, "conflict"]).withColumn("label", F.col("conflict").cast("int")).select(*PAIR, "label", *FEATS)


@query()
def logreg_irls(spark, sf):
    d = settle(model_rows(spark, sf))
    weights = M.fit_logistic(M.standardized(d, M.moments(d, FEATS)), FEATS, "label")
    return spark.createDataFrame([(n, round(float(x), 6)) for n, x in zip(["bias", *FEATS], weights, strict=True)], "term string, weight double")


@query()
def oof_auc(spark, sf):
    """AUC of out-of-fold scores, pooled and as a mean of the folds."""
    return M.cv_auc(settle(model_rows(spark, sf)), FEATS, "label", PAIR)


def train_and_test(spark, sf):
    """Pairs with titles and bodies, of repositories in and out of the training half (by hash order)."""
    d = settle(B.with_bodies(spark, sf, B.titled(spark, sf)))
    half = S.repo_split(d.select("repo"), test_share=0.5, min_train=0, dev_share=0.0).select("repo", (F.col("split") == "test").alias("held"))
    d = d.join(half, "repo")
    return d.where(~F.col("held")), d.where("held")


@query()
def trained_scores(spark, sf):
    """A model of some repositories' pairs, scored on the others': its report."""
    train, test = train_and_test(spark, sf)
    x, y, names = T.trained_features(train, test, PAIR, X.task_text(F.col("title_a"), F.col("body_a")), X.task_text(F.col("title_b"), F.col("body_b")))
    return R.binary_report(settle(M.train_to_test(settle(x), settle(y), names, "label", PAIR)), "prob", "label")


HYBRID = ["title_jaccard", "dup_title", "cross_agent", "near_miss", "cosine"]


@query()
def hybrid_fit(spark, sf):
    """Weights of the hybrid classifier of a shared file, on all features but the shared file itself."""
    f = settle(B.with_bodies(spark, sf, flags(spark, sf)).drop("files_a", "files_b"))
    d = settle(T.hybrid_features(f, PAIR).withColumn("label", F.col("conflict")))
    weights = M.fit_hybrid(d, HYBRID, "label")
    return spark.createDataFrame([(n, round(float(x), 6)) for n, x in zip(["bias", *HYBRID], weights, strict=True)], "term string, weight double")


_GATE = "-0.889 + 0.232 * (cosine - 0.160) / 0.145 + 0.213 * (score - 0.088) / 0.151 + 0.004 * ((agent_a = agent_b)::INT - 0.956) / 0.204 + 0.546 * (rate - 0.292) / 0.120"


@query(w(f"SELECT t.repo, t.pr_a, t.pr_b, round(1 / (1 + exp(-({_GATE}))), 6) AS gate FROM titled t JOIN s USING (repo, pr_a, pr_b) JOIN ({SQL['tfidf_cosine']}) c USING (repo, pr_a, pr_b) JOIN ({SQL['trailing_rate']}) r USING (repo, pr_a, pr_b)", "titled", s=scored.sql))
def gate_score(spark, sf):
    """The released gate on its own inputs: cosine and Jaccard of titles, same agent, and the repository's rate so far."""
    d = settle(B.titled(spark, sf).drop("files_a", "files_b"))
    same = d.select(*PAIR, (F.col("agent_a") == F.col("agent_b")).cast("int").alias("same"))
    g = same.join(T.tfidf_cosine(d, PAIR, F.col("title_a"), F.col("title_b")), PAIR).join(scored(spark, sf).select(*PAIR, "score"), PAIR).join(C.trailing_rate(d).select(*PAIR, "rate"), PAIR)
    return g.select(*PAIR, F.round(M.gate_score(F.col("cosine"), F.col("score"), F.col("same"), F.col("rate")), 6).alias("gate"))


@query("SELECT doc_id, 'none' AS category, CAST(1 AS INT) AS confidence, has_diff, CASE WHEN doc_id % 4 = 1 AND NOT has_diff THEN 'none' ELSE ['D', 'H', 'C', 'none'][(doc_id % 4) + 1] END AS official FROM (SELECT doc_id, doc_id % 3 = 0 AS has_diff FROM documents)")
def judge_echo(spark, sf):
    """Prompts answered by Echo, parsed; and the demotion of labels that need a diff."""
    from weftline.operators.annotate import official_label
    from weftline.sources.providers import get_provider, judge

    d = B.read(spark, sf, "documents").select("doc_id", X.pair_prompt(F.lit(1), F.col("text"), F.col("text"), 1 << 30).alias("prompt"))
    a = judge(d, lambda: get_provider("echo"), ["doc_id"]).select("doc_id", X.parse_judgement(F.col("raw_text")).alias("j"), (F.col("doc_id") % 3 == 0).alias("has_diff"))
    label = F.element_at(F.array(*map(F.lit, ("D", "H", "C", "none"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return a.select("doc_id", "j.category", "j.confidence", "has_diff", official_label(label, F.col("has_diff")).alias("official"))
