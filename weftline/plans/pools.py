"""Queries on titles, paths and pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.config import FIX_WORDS, LOCKFILES, MANIFESTS, SPEC_CONFIG
from weftline.functions import paths as P
from weftline.functions import text as X
from weftline.operators import annotate, audit
from weftline.operators import pools as O
from weftline.plans import binding as B
from weftline.plans.binding import with_parts as w
from weftline.operators.ranking import hash_ranks
from weftline.plans.joins import PAIR
from weftline.plans.registry import query


def q_norm(t):
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({t}, '')), '\\[[^\\]]*\\]', ' ', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def q_tokens(n):
    return f"list_distinct(list_filter(string_split({n}, ' '), lambda x: x <> ''))"


def q_jaccard(a, b, empty):
    return f"(CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN {empty} ELSE len(list_intersect({a}, {b})) / greatest(len(list_distinct(list_concat({a}, {b}))), 1) END)"


def q_list(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def q_keys(files, key):
    return f"list_distinct(list_filter(list_transform({files}, lambda p: {key}), lambda k: k IS NOT NULL AND k <> ''))"


_PARTS = "string_split(p, '/')"
KEYS = {
    "canonical": f"array_to_string({_PARTS}[1:least(2, len({_PARTS}) - 1)], '/')",
    "with_name": f"array_to_string({_PARTS}[1:2], '/')",
    "dirs_only": f"CASE WHEN len({_PARTS}) >= 3 THEN array_to_string({_PARTS}[1:2], '/') END",
    "depth1": f"array_to_string({_PARTS}[1:least(1, len({_PARTS}) - 1)], '/')",
    "depth2_root": f"CASE WHEN len({_PARTS}) = 1 THEN '<root>' ELSE array_to_string({_PARTS}[1:least(2, len({_PARTS}) - 1)], '/') END",
    "depth3": f"array_to_string({_PARTS}[1:least(3, len({_PARTS}) - 1)], '/')",
    "same_parent": f"array_to_string({_PARTS}[1:len({_PARTS}) - 1], '/')",
}
NEAR = {k: f"NOT conflict AND list_has_any({q_keys('files_a', v)}, {q_keys('files_b', v)})" for k, v in KEYS.items()}
MEGA = "SELECT repo FROM titled GROUP BY 1 ORDER BY count(*) DESC, repo LIMIT 2"
NORM = f"SELECT *, {q_norm('title_a')} AS norm_a, {q_norm('title_b')} AS norm_b FROM titled"
TOKS = f"SELECT *, {q_tokens('norm_a')} AS toks_a, {q_tokens('norm_b')} AS toks_b FROM norm"
DUP = f"len(toks_a) >= 3 AND len(toks_b) >= 3 AND ({q_jaccard('toks_a', 'toks_b', '1.0')} >= 0.5 OR (length(norm_a) >= 15 AND length(norm_b) >= 15 AND (contains(norm_a, norm_b) OR contains(norm_b, norm_a))))"
REVERT_SQL = r"(regexp_matches(lower(coalesce(title_a, '')), '\b(revert|undo|rollback)\b') OR regexp_matches(lower(coalesce(title_b, '')), '\b(revert|undo|rollback)\b'))"
FIF = f"conflict AND list_has_any(CASE WHEN opened_b >= opened_a THEN toks_b ELSE toks_a END, {q_list(FIX_WORDS)})"
FLAGS0 = f"SELECT *, {DUP} AS dup_title, {REVERT_SQL} AS revert, {FIF} AS fix_in_flight, merged_a AND merged_b AS both_merged, merged_a AND merged_b AND conflict AS bm_shared, repo IN (SELECT repo FROM megas) AS mega, {NEAR['canonical']} AS near_miss FROM toks"
FLAGS = "SELECT *, CASE WHEN revert THEN 'revert' WHEN dup_title THEN 'dup' WHEN fix_in_flight THEN 'fix_in_flight' WHEN bm_shared THEN 'bm_shared' WHEN conflict THEN 'overlap_other' WHEN near_miss THEN 'near_miss' ELSE 'control' END AS primary_stratum, cross_agent AND (bm_shared OR dup_title OR revert) AS cross_agent_candidate, CASE WHEN opened_b >= opened_a THEN pr_b ELSE pr_a END AS pr_later, CASE WHEN opened_b >= opened_a THEN merged_b ELSE merged_a END AS merged_later, CASE WHEN opened_b >= opened_a THEN merged_a ELSE merged_b END AS merged_earlier FROM flags0"


def wf(body, **more):
    """SQL over the pool flags."""
    return w(body, "titled", megas=MEGA, norm=NORM, toks=TOKS, flags0=FLAGS0, flags=FLAGS, **more)


def flags(spark, sf):
    d = B.titled(spark, sf)
    return O.later_outcome(O.pool_flags(d, O.largest_repos(B.labeled(spark, sf))))


@query(w(f"SELECT pr, {q_norm('title')} AS norm, CAST(len({q_tokens(q_norm('title'))}) AS INT) AS n_tokens FROM titles", "titles"))
def normalize_title(spark, sf):
    n = X.normalize_title(F.col("title"))
    return B.titles(spark, sf).select("pr", n.alias("norm"), F.size(X.title_tokens(n)).alias("n_tokens"))


@query(w(f"SELECT repo, pr_a, pr_b, {DUP} AS dup_title, round({q_jaccard('toks_a', 'toks_b', '1.0')}, 9) AS jaccard FROM toks", "titled", norm=NORM, toks=TOKS))
def dup_title(spark, sf):
    na, nb = X.normalize_title(F.col("title_a")), X.normalize_title(F.col("title_b"))
    return B.titled(spark, sf).select(*PAIR, X.is_duplicate_title(na, nb).alias("dup_title"), F.round(X.jaccard(X.title_tokens(na), X.title_tokens(nb), 1.0), 9).alias("jaccard"))


@query(wf("SELECT repo, pr_a, pr_b, conflict, dup_title, revert, fix_in_flight, both_merged, bm_shared, mega, near_miss, primary_stratum, cross_agent_candidate FROM flags"))
def pool_flags(spark, sf):
    return flags(spark, sf).select(*PAIR, "conflict", "dup_title", "revert", "fix_in_flight", "both_merged", "bm_shared", "mega", "near_miss", "primary_stratum", "cross_agent_candidate")


@query(wf("SELECT primary_stratum, count(*) AS n, CAST(count(*) FILTER (cross_agent) AS BIGINT) AS n_cross FROM flags GROUP BY 1"))
def primary_stratum(spark, sf):
    return flags(spark, sf).groupBy("primary_stratum").agg(F.count("*").alias("n"), F.count_if("cross_agent").alias("n_cross"))


@query(wf("SELECT count(*) AS n_pairs, count(DISTINCT repo) AS n_repos, " + ", ".join(f"count(*) FILTER ({c}) AS n_{c}" for c in O.POOLS) + " FROM flags"))
def pool_counts(spark, sf):
    return O.pool_counts(flags(spark, sf))


@query(w("SELECT count(*) FILTER (NOT conflict) AS n_disjoint, " + ", ".join(f"count(*) FILTER ({c}) AS n_{k}" for k, c in NEAR.items()) + " FROM labeled", "labeled"))
def near_miss_reconcile(spark, sf):
    return O.near_miss_sweep(B.labeled(spark, sf))


@query(w(f"SELECT repo, pr_a, pr_b, {NEAR['canonical']} AS near_miss FROM labeled WHERE NOT conflict", "labeled"))
def near_miss(spark, sf):
    return B.labeled(spark, sf).where("not conflict").select(*PAIR, O.near_miss_variants()["canonical"].alias("near_miss"))


_STEPS = " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS threshold, count(*) FILTER (len(toks_a) >= 3 AND len(toks_b) >= 3 AND {q_jaccard('toks_a', 'toks_b', '1.0')} >= {t}) AS n FROM toks" for t in (0.3, 0.4, 0.5, 0.6, 0.7, 0.8))


@query(w(_STEPS, "titled", norm=NORM, toks=TOKS))
def dup_sweep(spark, sf):
    return O.duplicate_title_sweep(B.titled(spark, sf))


@query(wf("SELECT repo, pr_a, pr_b, pr_later, merged_later, merged_earlier FROM flags"))
def later_outcome(spark, sf):
    return flags(spark, sf).select(*PAIR, "pr_later", "merged_later", "merged_earlier")


# A column of file names with every class among them, from parts and order keys.
_NAMES = "['.github/workflows/ci.yml', 'a/Cargo.lock', 'package.json', 'requirements-dev.txt', 'Dockerfile.dev', 'README.md', 'docs/CHANGELOG', 'x/y.rst', '.env.local', 'conf/app.toml', 'src/main.py', 'go.mod']"
_PATHS = f"SELECT path, pr FROM files UNION ALL SELECT {_NAMES}[(o_orderkey % 12) + 1], o_orderkey FROM orders"
_CLASS = (
    "CASE WHEN contains(low, '.github/workflows') THEN 'ci_workflow'"
    f" WHEN name LIKE '%.lock' OR list_contains({q_list(LOCKFILES)}, name) THEN 'lockfile'"
    f" WHEN name LIKE 'requirements%' OR list_contains({q_list(MANIFESTS)}, name) THEN 'manifest'"
    " WHEN name LIKE 'dockerfile%' OR name IN ('docker-compose.yml', 'docker-compose.yaml') THEN 'docker'"
    " WHEN name LIKE 'readme%' THEN 'readme'"
    r" WHEN name LIKE 'changelog%' OR regexp_matches(name, '\.(md|rst|txt)$') THEN 'other_docs'"
    r" WHEN name LIKE '.gitignore%' OR name LIKE '.env%' OR regexp_matches(name, '\.(yml|yaml|toml|ini|cfg|json)$') THEN 'other_config'"
    " ELSE 'source' END"
)


def named_paths(spark, sf):
    names = F.array(*(F.lit(x.strip().strip("'")) for x in _NAMES.strip("[]").split(", ")))
    extra = B.read(spark, sf, "orders").select(F.element_at(names, (F.col("o_orderkey") % 12 + 1).cast("int")).alias("path"), F.col("o_orderkey").alias("pr"))
    return B.files(spark, sf).select("path", "pr").union(extra)


@query(w(f"SELECT class, count(*) AS n, count(DISTINCT path) AS n_paths, CAST(count(*) FILTER (class IN ({', '.join(repr(c) for c in SPEC_CONFIG)})) AS BIGINT) AS n_spec FROM (SELECT path, {_CLASS} AS class FROM (SELECT path, lower(path) AS low, string_split(lower(path), '/')[-1] AS name FROM paths)) GROUP BY 1", "files", paths=_PATHS))
def classify_path(spark, sf):
    d = named_paths(spark, sf).select("path", P.file_class(F.col("path")).alias("class"), P.is_spec_config(F.col("path")).alias("spec"))
    return d.groupBy("class").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_paths"), F.count_if("spec").alias("n_spec"))


@query(w(r"SELECT pr, list_sort(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(t, '[A-Za-z0-9_./-]*[A-Za-z0-9_-]\.[A-Za-z][A-Za-z0-9]{0,5}'), regexp_extract_all(t, '[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+')), lambda x: regexp_replace(regexp_replace(x, '^(\./)+', ''), '^[/.]+|[/.]+$', '', 'g')), lambda x: contains(x, '.') OR contains(x, '/')))) AS names FROM (SELECT pr, 'see ./src/' || string_agg(path, ' and ' ORDER BY path) || '.py.' AS t FROM files GROUP BY 1)", "files"))
def filename_tokens(spark, sf):
    t = F.concat(F.lit("see ./src/"), F.array_join("files", " and "), F.lit(".py."))
    return B.file_sets(spark, sf).select("pr", F.array_sort(X.filename_tokens(t)).alias("names"))


@query(w("SELECT repo, pr_a, pr_b, 'P' || substr(sha256('v1:20260824|' || concat_ws('|', repo, pr_a, pr_b)), 1, 16) AS anon_id FROM pairs", "pairs"))
def anon_ids(spark, sf):
    return B.pairs(spark, sf).select(*PAIR, X.anon_id("v1", 20260824, *(F.col(c).cast("string") for c in PAIR)).alias("anon_id"))


@query(wf("SELECT repo, pr_a, pr_b, title_a, title_b, conflict, '' AS label_category, '' AS confidence, '' AS evidence, '' AS ambiguous, '' AS annotator, '' AS \"timestamp\" FROM flags WHERE primary_stratum = 'dup'"))
def blinded_sheet(spark, sf):
    d = flags(spark, sf).where("primary_stratum = 'dup'").select(*PAIR, "title_a", "title_b", "conflict", "merged_a", "primary_stratum", F.lit(0.5).alias("pi_enriched"))
    return annotate.blinded(d)


@query(wf("SELECT least(agent_a, agent_b) AS agent_1, greatest(agent_a, agent_b) AS agent_2, count(*) AS n, CAST(count(*) FILTER (dup_title) AS BIGINT) AS n_dup, CAST(count(*) FILTER (bm_shared) AS BIGINT) AS n_bm_shared, CAST(count(*) FILTER (both_merged) AS BIGINT) AS n_both_merged FROM flags WHERE cross_agent_candidate GROUP BY 1, 2"))
def cross_agent_cases(spark, sf):
    d = flags(spark, sf).where("cross_agent_candidate").groupBy(F.least("agent_a", "agent_b").alias("agent_1"), F.greatest("agent_a", "agent_b").alias("agent_2"))
    return d.agg(F.count("*").alias("n"), F.count_if("dup_title").alias("n_dup"), F.count_if("bm_shared").alias("n_bm_shared"), F.count_if("both_merged").alias("n_both_merged"))




@query(w("SELECT repo, pr_a, pr_b, CAST(len(list_filter(list_intersect(files_a, files_b), lambda p: NOT contains(lower(p), 'standard'))) AS INT) AS n_shared_src, CAST(x.s AS BIGINT) AS sa, CAST(y.s AS BIGINT) AS sb FROM labeled JOIN sizes x ON x.pr = pr_a JOIN sizes y ON y.pr = pr_b WHERE conflict AND merged_a AND merged_b AND len(list_filter(list_intersect(files_a, files_b), lambda p: NOT contains(lower(p), 'standard'))) > 0 AND x.s <= 1000 AND y.s <= 1000", "labeled", sizes="SELECT pr, sum(additions + deletions) AS s FROM files GROUP BY 1"))
def merge_candidates(spark, sf):
    """Conflicting pairs of merged requests that share a source file and are small on both sides."""
    size = B.files(spark, sf).groupBy("pr").agg(F.sum(F.col("additions") + F.col("deletions")).alias("s"))
    shared = F.filter(F.array_intersect("files_a", "files_b"), lambda p: ~P.is_generated(p) & ~F.contains(F.lower(p), F.lit("standard")))
    d = B.labeled(spark, sf).where("conflict and merged_a and merged_b").select(*PAIR, F.size(shared).alias("n_shared_src")).where("n_shared_src > 0")
    for s in "ab":
        d = d.join(size.where("s <= 1000").select(F.col("pr").alias(f"pr_{s}"), F.col("s").alias(f"s{s}")), f"pr_{s}")
    return d.select(*PAIR, "n_shared_src", "sa", "sb")


_READINGS = ("canonical", "with_name", "dirs_only", "depth1", "depth3")


@query(w(f"SELECT * FROM (SELECT repo, pr_a, pr_b, {', '.join(f'coalesce({NEAR[k]}, false) AS {k}' for k in _READINGS)} FROM labeled WHERE NOT conflict) WHERE {' OR '.join(f'canonical <> {k}' for k in _READINGS[1:])} ORDER BY repo, pr_a, pr_b LIMIT 15", "labeled"))
def near_miss_examples(spark, sf):
    return O.near_miss_examples(B.labeled(spark, sf), PAIR).select(*PAIR, *_READINGS)


@query(wf("SELECT * FROM (SELECT 'pairs' AS section, unnest(['null_key', 'self_pair', 'opened_out_of_order', 'null_conflict', 'conflict_differs', 'cross_agent_differs', 'duplicate_key']) AS \"check\", CAST(0 AS BIGINT) AS n, 'PASS' AS status UNION ALL SELECT 'flags', unnest(['near_miss_with_conflict', 'bm_shared_without_conflict', 'fix_in_flight_without_conflict', 'unknown_stratum']), CAST(count(*) FILTER (near_miss AND conflict) AS BIGINT), 'PASS' FROM flags)"))
def audit_report(spark, sf):
    f = flags(spark, sf)
    return audit.audit({"pairs": audit.violations(f, audit.pair_rules(), PAIR), "flags": audit.violations(f, audit.flag_rules())})




@query(f"SELECT doc_id, ['D','C','Q','none'][(doc_id % 4) + 1] AS category, CAST(doc_id % 5 AS INT) AS confidence, 'e' || doc_id AS evidence FROM documents WHERE doc_id % 4 <> 2 AND doc_id % 5 BETWEEN 1 AND 3")
def judge_json_parse(spark, sf):
    d = B.read(spark, sf, "documents").select("doc_id")
    c = F.element_at(F.array(*map(F.lit, ("D", "C", "Q", "none"))), (F.col("doc_id") % 4 + 1).cast("int"))
    raw = F.format_string('Sure: {"category": "%s", "confidence": %d, "evidence": "e%d"} ok', c, F.col("doc_id") % 5, F.col("doc_id"))
    return d.select("doc_id", X.parse_judgement(raw).alias("j")).where("j is not null").select("doc_id", "j.category", "j.confidence", "j.evidence")


@query("SELECT doc_id, CAST(doc_id % 7 AS INT) AS id, least(greatest(CAST(doc_id % 120 AS DOUBLE), 0), 100) / 100 AS prob FROM documents WHERE doc_id % 7 <> 6")
def batch_parse(spark, sf):
    d = B.read(spark, sf, "documents").select("doc_id")
    raw = F.when(F.col("doc_id") % 2 == 0, F.format_string('[{"id": %d, "prob": %d}]', F.col("doc_id") % 7, F.col("doc_id") % 120)).otherwise(F.format_string("id: %d gives prob: %d", F.col("doc_id") % 7, F.col("doc_id") % 120))
    return d.select("doc_id", F.inline(X.parse_batch(raw, F.array(*map(F.lit, range(6))))))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['a', 'b' || doc_id] END AS lines FROM documents WHERE doc_id % 3 <> 2")
def fenced_code(spark, sf):
    d = B.read(spark, sf, "documents").select("doc_id")
    raw = F.when(F.col("doc_id") % 3 == 0, F.lit("x ```python\n``` y")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```\na\nb"), F.col("doc_id").cast("string"), F.lit("\n```"))).otherwise(F.lit("none"))
    return d.select("doc_id", X.fenced_code(raw).alias("lines")).where("lines is not null")


@query(w("SELECT batch, count(*) AS n, sha256(string_agg(p, '' ORDER BY rn)) AS digest FROM (SELECT rn, (rn - 1) // 10 AS batch, format('### Pair {}\nA: {}\nB: {}\n', rn, title_a, title_b) AS p FROM (SELECT row_number() OVER (ORDER BY md5(concat_ws('|', '7', repo, pr_a, pr_b))) AS rn, substr(coalesce(title_a, ''), 1, 900) AS title_a, substr(coalesce(title_b, ''), 1, 900) AS title_b FROM titled)) GROUP BY 1", "titled"))
def prompt_batches(spark, sf):
    """Prompts of ten pairs each, in hash order."""
    d = hash_ranks(B.titled(spark, sf).select(*PAIR, "title_a", "title_b"), 7, PAIR)
    d = d.select((F.col("rank") + 1).alias("rn"), F.coalesce("title_a", F.lit("")).alias("title_a"), F.coalesce("title_b", F.lit("")).alias("title_b"))
    p = d.select("rn", F.floor((F.col("rn") - 1) / 10).cast("long").alias("batch"), X.pair_prompt(F.col("rn"), F.col("title_a"), F.col("title_b")).alias("p"))
    return p.groupBy("batch").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "p"))), lambda x: x["p"]), ""), 256).alias("digest"))
