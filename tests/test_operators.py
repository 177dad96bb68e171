"""Operators on small tables with results known by hand, and properties that must hold."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weftline.operators import annotate, audit, coactive, models, pools, ranking, sampling, stats, symbols
from weftline.sources import providers, tables
from weftline.streaming import live


def t(day, hour=0):
    return datetime(2024, 1, day, hour)


@pytest.fixture(scope="module")
def requests(spark):
    rows = [("r", 1, "x", t(1), t(5), True), ("r", 2, "y", t(2), t(3), False), ("r", 3, "x", t(3), None, True), ("r", 4, "x", t(5), t(6), True), ("r", 5, "x", t(2), t(9), True), ("q", 1, "x", t(1), t(2), True), ("q", 9, "x", None, t(2), True)]
    return spark.createDataFrame(rows, "repo string, pr long, agent string, opened timestamp, closed timestamp, merged boolean")


@pytest.mark.parametrize("days", [1, 60])
def test_coactive_pairs(requests, days):
    got = {(r.pr_a, r.pr_b, r.cross_agent) for r in coactive.coactive_pairs(requests, days).collect()}
    assert got == {(1, 2, True), (1, 3, False), (1, 5, False), (2, 5, True), (5, 3, False), (5, 4, False), (3, 4, False)}


def test_concurrency_counts_both_ends(requests, spark):
    spans = requests.where("closed is not null and opened is not null")
    at = spark.createDataFrame([("r", 1, t(3)), ("r", 2, t(5)), ("q", 3, t(9))], "repo string, k int, ts timestamp").select("repo", "k", F.unix_micros("ts").alias("at"))
    assert {r.k: r.concurrency for r in coactive.concurrency_at(at, spans).collect()} == {1: 3, 2: 3, 3: 0}


def test_flags_and_strata(spark):
    schema = "repo string, pr_a long, pr_b long, title_a string, title_b string, files_a array<string>, files_b array<string>, merged_a boolean, merged_b boolean, opened_a timestamp, opened_b timestamp, cross_agent boolean, conflict boolean"
    rows = [
        ("t", 1, 2, "add user login flow", "add user login form", ["src/a.py"], ["src/b.py"], True, True, t(1), t(2), False, False),
        ("t", 1, 3, "add x", "Revert add x", ["a.py"], ["a.py"], True, None, t(1), t(2), True, True),
        ("t", 1, 4, "one thing", "fix other", ["s/a.py"], ["s/a.py"], True, True, t(1), t(2), False, True),
        ("m", 5, 6, None, "z", ["README.md"], ["LICENSE"], True, False, t(1), t(2), False, False),
    ]
    f = {r.pr_b: r for r in pools.pool_flags(spark.createDataFrame(rows, schema), ["m"]).collect()}
    assert [f[k].primary_stratum for k in (2, 3, 4, 6)] == ["dup", "revert", "fix_in_flight", "control"]
    assert f[2].near_miss and not f[6].near_miss and f[6].mega and f[4].bm_shared and f[3].cross_agent_candidate and not f[3].both_merged


def cells(spark, *strata):
    rows = [(s, e, o) for s, (a, b, c, d) in enumerate(strata) for e, o, n in ((True, True, a), (True, False, b), (False, True, c), (False, False, d)) for _ in range(n)]
    return spark.createDataFrame(rows, "s int, e boolean, o boolean")


def test_mantel_haenszel(spark):
    mh = lambda *x: stats.mantel_haenszel(cells(spark, *x), "s", F.col("e"), F.col("o")).first()
    r = mh((1, 3, 3, 1), (2, 6, 6, 2))
    assert r.odds_ratio == pytest.approx(1 / 9) and r.lo < 1 / 9 < r.hi
    r = mh((1, 1, 2, 1), (1, 0, 0, 2), (0, 0, 2, 2))
    assert r.odds_ratio == pytest.approx(13 / 6, abs=1e-8) and r.n_strata == 2 and r.n_discordant == 2 and r.crude_or == pytest.approx(3.0)


def test_weighted_means(spark):
    d = spark.createDataFrame([(y, 0.5) for y in (1, 1, 1, 0, 0)], "y int, pi double")
    r = stats.design_weighted(d, "y", "pi", 10.0).first()
    assert (r.hajek, r.horvitz_thompson, r.n_eff) == (0.6, 0.6, 5.0)
    with pytest.raises(Exception, match="inclusion"):
        stats.design_weighted(d.withColumn("pi", F.lit(0.0)), "y", "pi").collect()


def test_agreement(spark):
    same = spark.createDataFrame([(i, c) for i, c in enumerate("DBHD")], "item int, label_category string")
    r = annotate.agreement([same, same]).first()
    assert (r.agreement, r.kappa, r.fleiss, r.alpha) == (1.0, 1.0, 1.0, 1.0)
    a = spark.createDataFrame([(1, "D", 2), (2, "none", 2), (3, "H", 2)], "item int, label_category string, confidence int")
    b = spark.createDataFrame([(1, "D", 2), (2, "B", 2), (3, "H", 2)], "item int, label_category string, confidence int")
    gold = lambda d: {r["item"] for r in annotate.adjudicate([a, b], d).where("gold is not null").collect()}
    assert gold(None) == {1, 3} and gold(spark.createDataFrame([(2, "B")], "item int, label_category string")) == {1, 2, 3}
    with pytest.raises(ValueError, match="range"):
        annotate.import_labels(a.withColumn("label_category", F.lit("Q")), "me")


def test_blinded_sheet(spark):
    d = spark.createDataFrame([(1, "t", True, 0.5, "dup")], "item int, title_a string, merged_a boolean, pi_enriched double, primary_stratum string")
    assert annotate.blinded(d).columns[:2] == ["item", "title_a"] and not any("merged" in c or "pi_" in c for c in annotate.blinded(d).columns)


def test_confusion(spark):
    d = spark.createDataFrame([(True, "H"), (True, "B"), (False, "D"), (False, "none"), (True, "I")], "c boolean, g string")
    r = stats.binary_confusion(d, F.col("g").isin("D", "C", "H", "I"), F.col("c")).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 1)


def test_bootstrap_is_repeatable_and_covers(spark):
    d = spark.range(2000).select((F.col("id") % 50).alias("c"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    a, b = (stats.cluster_bootstrap(d.repartition(n), "c", "y", 200).first() for n in (2, 7))
    assert [round(x, 9) for x in a] == [round(x, 9) for x in b] and a.lo <= 0.25 <= a.hi and a.n_clusters == 50
    g = stats.cluster_bootstrap_any(d, "c", lambda p: p["y"].mean(), 5).collect()
    assert len(g) == 5 and all(0 <= r.value <= 1 for r in g)


def test_hamilton(spark):
    d = spark.createDataFrame([("a", 10), ("b", 5), ("c", 1)], "cell string, size long")
    q = lambda n, m=0: {r.cell: r.quota for r in sampling.hamilton(d, "cell", "size", n, m).collect()}
    assert sum(q(8).values()) == 8 and all(q(8)[c] <= s for c, s in (("a", 10), ("b", 5), ("c", 1)))
    assert q(100) == {"a": 10, "b": 5, "c": 1} and q(6, 2)["c"] == 1 and sum(q(6, 2).values()) == 6


def test_draw_has_exact_shares(spark):
    d = spark.range(20).select((F.col("id") % 2).alias("cell"), "id")
    s = sampling.draw(d, sampling.hamilton(sampling.cells(d, "cell"), "cell", "size", 8, 2), "cell", ["id"]).collect()
    assert len(s) == 8 and {r.pi for r in s} == {0.4}


def test_split_keeps_repos_apart(spark):
    d = spark.range(100).select((F.col("id") % 10).alias("repo"))
    s = sampling.repo_split(d).collect()
    assert len(s) == 10 and {r.split for r in s} == {"test", "dev"}
    assert {r.split for r in sampling.repo_split(d, min_train=10).collect()} == {"test", "dev", "train"}


def test_rank_metrics_against_pairs(spark):
    rows = [(i, (i * 7 % 11) / 10, int(i * i % 5 in (1, 4))) for i in range(60)]
    d = spark.createDataFrame(rows, "id int, s double, y int")
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert ranking.auc(d, "s", "y").first().auc == pytest.approx(want, abs=1e-9)
    assert ranking.auc(d.where("y = 1"), "s", "y").first().auc is None
    pts = ranking.roc_points(d, "s", "y").orderBy("fpr", "tpr").collect()
    area = sum((b.fpr - a.fpr) * (a.tpr + b.tpr) / 2 for a, b in zip([pts[0], *pts], pts, strict=False)) + pts[0].fpr * pts[0].tpr / 2
    assert area == pytest.approx(want, abs=1e-6)


def test_logistic_recovers_weights(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 2))
    y = (rng.random(3000) < 1 / (1 + np.exp(-(0.5 + 1.0 * x[:, 0] - 2.0 * x[:, 1])))).astype(int)
    d = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, (a, b), c in zip(range(3000), x.tolist(), y.tolist(), strict=True)], "id int, a double, b double, y int")
    w = models.fit_logistic(d, ["a", "b"], "y")
    assert np.allclose(w, [0.5, 1.0, -2.0], atol=0.2)
    assert models.cv_auc(d, ["a", "b"], "y", ["id"]).first().auc > 0.8


def detect(spark, a, b):
    files = spark.createDataFrame([("A", p, x) for p, x in a] + [("B", p, x) for p, x in b], "side string, path string, text string").withColumn("pair", F.lit(1))
    e = symbols.symbol_events(files, ["pair", "side"], text="text")
    v = symbols.verdict(symbols.detect(e, ["pair"]), ["pair"]).collect()
    return v[0] if v else None


def test_symbol_detector(spark):
    r = detect(spark, [("a.py", "def load_collection(x):\n    pass")], [("b.py", "y = load_collection(3)")])
    assert r.prediction and r.symbol == "load_collection" and r.direction == "A->B" and r.definition_file == "a.py"
    r = detect(spark, [("a.py", "def alpha_one():\n    pass")], [("b.py", "def beta_two():\n    pass")])
    assert r is None or not r.prediction
    r = detect(spark, [("a.ts", "export function fetchUser() {}")], [("b.ts", "import {x} from './u'\nfetchUser()")])
    assert r.prediction and r.symbol == "fetchUser"
    r = detect(spark, [("poetry.lock", "name = 1")], [("b.py", "def other_thing():\n    pass")])
    assert r is None or not r.prediction
    r = detect(spark, [("c.yaml", "database_url: x")], [("b.py", 'cfg["database_url"]')])
    assert r.prediction and r.symbol == "database_url"


def test_invariants(spark):
    d = spark.createDataFrame([("r", 1, 1), ("r", 1, 2), ("r", 1, 2)], "repo string, pr_a int, pr_b int")
    got = {r.check: r.n for r in audit.violations(d, {"self_pair": F.col("pr_a") == F.col("pr_b")}, ["repo", "pr_a", "pr_b"]).collect()}
    assert got == {"self_pair": 1, "duplicate_key": 1}
    with pytest.raises(audit.InvariantError):
        audit.violations(d, {"self_pair": F.col("pr_a") == F.col("pr_b")}, strict=True)
    assert audit.exit_code(audit.audit({"x": audit.violations(d, {"never": F.lit(False)})})) == 0


def test_csv_and_logs(spark, tmp_path):
    (tmp_path / "pr_texts.csv").write_text('repo,pr,agent,state,title,body,merged\nr,1,a,closed,"x, y","two\nlines",true\nr,2,a,open,z,,False\n')
    rows = tables.read_csv(spark, str(tmp_path / "pr_texts.csv"), tables.TEXTS).collect()
    assert [r.title for r in rows] == ["x, y", "z"] and rows[0].body == "two\nlines"
    d = spark.createDataFrame([(1, "a"), (2, "b")], "frame_id int, raw string")
    log = str(tmp_path / "log")
    assert tables.append_log(d.limit(1), log, ["frame_id"], "frame_id int, raw string").count() == 1
    assert tables.append_log(d, log, ["frame_id"], "frame_id int, raw string").count() == 2
    assert tables.first_column(spark.createDataFrame([("p",)], "file_path string")) == "file_path"
    m = tables.manifest({"t": str(tmp_path / "pr_texts.csv")}, {"t": 2})
    assert tables.compare_manifests(m, m) == [] and tables.compare_manifests(m, m | {"row_counts": {"t": 3}}) == ["row_counts.t: 2 -> 3"]


def test_judges(spark):
    d = spark.createDataFrame([(1, "p"), (2, "q")], "frame_id int, prompt string")
    rows = providers.judge(d, lambda: providers.get_provider("echo", category="D"), ["frame_id"]).collect()
    assert len(rows) == 2 and all('"D"' in r.raw_text and r.error is None for r in rows)
    with pytest.raises(ValueError, match="no provider"):
        providers.get_provider("other")


def test_streams(spark, tmp_path):
    src = spark.createDataFrame([("r", 1, "x", t(1), t(5)), ("r", 2, "y", t(2), t(3)), ("r", 3, "x", t(6), t(7))], "repo string, pr long, agent string, opened timestamp, closed timestamp")
    src.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = live.live_coactive(stream().select("repo", "pr", "opened"), stream().select("repo", "pr", "opened", "closed")).writeStream.format("memory").queryName("pairs_live").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.pr_a, r.pr_b) for r in spark.sql("SELECT * FROM pairs_live").collect()} == {(1, 2)}
    q = live.arrivals(stream()).writeStream.format("memory").queryName("arrivals_live").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert math.isfinite(spark.sql("SELECT count(*) FROM arrivals_live").first()[0])


def test_evidence_of_imports_and_of_nothing_strong(spark):
    r = detect(spark, [("crate/net/wire.rs", "struct Zzz")], [("b.rs", "use crate::net::wire")])
    assert r.prediction and (r.relation, r.symbol, r.direction, r.consumer_file, r.confidence) == ("import_path_dependency", "crate::net::wire", "A->B", "b.rs", 0.7)
    r = detect(spark, [("pkg/mod.py", "x = 1\nmaking(2)")], [("b.py", "import other.mod")])
    assert r.prediction and r.symbol == "other.mod"
    files = spark.createDataFrame([("A", "a.py", "def long_name_here():\n    pass"), ("B", "b.py", "def long_name_here_too():\n    pass\nx = long_name")], "side string, path string, text string").withColumn("pair", F.lit(1))
    events = spark.createDataFrame([(1, "A", "a.py", "ident", "shared_identifier"), (1, "B", "b.md", "ident", "shared_identifier"), (1, "B", "b.md", "ident", "short")], "pair int, side string, file string, kind string, name string")
    every = spark.createDataFrame([(1,), (2,)], "pair int")
    got = {r.pair: r for r in symbols.verdict(symbols.detect(events, ["pair"]), ["pair"], pairs=every).collect()}
    for k, confidence, n in ((1, 0.35, 1), (2, 0.0, 0)):
        r = got[k]
        assert (r.prediction, r.direction, r.relation, r.symbol, r.definition_file, r.consumer_file, r.confidence, r.n_evidence) == (False, "none", "none", "", "", "", confidence, n)
    assert symbols.symbol_events(files, ["pair", "side"], text="text").count() > 0


def test_relations_and_their_files(spark):
    """Every relation, both ways; any deleted name counts as a deleted definition."""
    rows = [("A", "d.py", "def", "made"), ("B", "u.py", "use", "made"), ("B", "c.yml", "deleted_config_key", "conf.key"), ("A", "r.py", "use", "conf.key"), ("A", "e.ts", "export", "shown"), ("B", "i.ts", "import", "shown"), ("A", ".env", "env", "HOME_DIR"), ("B", "x.py", "env", "HOME_DIR"), ("B", "t.sql", "schema", "orders"), ("A", "m.md", "ident", "orders")]
    e = spark.createDataFrame([(1, *r) for r in rows], "pair int, side string, file string, kind string, name string")
    got = {(r.relation, r.direction, r.symbol, r.definition_file, r.consumer_file) for r in symbols.detect(e, ["pair"]).collect()}
    assert got == {
        ("changed_definition_used_by_partner", "A->B", "made", "d.py", "u.py"), ("deleted_definition_used_by_partner", "B->A", "conf.key", "", "r.py"),
        ("config_key_producer_consumer", "B->A", "conf.key", "c.yml", ""), ("changed_definition_used_by_partner", "A->B", "shown", "", ""), ("exported_change_used_by_partner", "A->B", "shown", "e.ts", ""),
        ("env_var_producer_consumer", "A->B", "HOME_DIR", ".env", "x.py"), ("env_var_producer_consumer", "B->A", "HOME_DIR", "x.py", ".env"), ("schema_field_intersection", "B->A", "orders", "t.sql", ""),
    }
    pairs = spark.createDataFrame([("r", 1, 2)], "repo string, pr_a int, pr_b int")
    by_request = e.select(F.when(F.col("side") == "A", 1).otherwise(2).alias("pr"), "file", "kind", "name")
    again = {(r.relation, r.direction, r.symbol, r.definition_file, r.consumer_file) for r in symbols.detect_requests(pairs, by_request, ["repo", "pr_a", "pr_b"]).collect()}
    assert again == got
    v = symbols.verdict(symbols.detect(e, ["pair"]), ["pair"])
    b = symbols.verification_bundle(v, symbols.detect(e, ["pair"]), ["pair"], top=2).first()
    assert b.direction == "both" and b.relation == "deleted_definition_used_by_partner" and [x.place for x in b.evidence] == [1, 2] and b.human_label == ""


def test_hunks_with_lines_between(spark, tmp_path):
    from weftline.operators import hunks

    text = "a\nb\n<<<<<<< x\n1\n=======\n2\n>>>>>>> y\nc\n<<<<<<< x\n<<<<<<<no\n||||||| base\n0\n=======\n4\n>>>>>>>not yet\n>>>>>>> y\nd\ne\nf\ng"
    got = hunks.parse_hunks(text)
    assert [(h["pre"], h["ours"], h["theirs"], h["post"]) for h in got] == [(["a", "b"], ["1"], ["2"], ["c"]), (["a", "b", "c"], ["<<<<<<<no"], ["4", ">>>>>>>not yet"], ["d", "e", "f"])]
    assert hunks.parse_hunks("<<<<<<<\nx") == [] and hunks.parse_hunks("<<<<<<< a\nx")[0]["ours"] == ["x"] and hunks.parse_hunks(None) == []
    d = hunks.explode_hunks(spark.createDataFrame([("p", text)], "path string, text string"), ["path"]).withColumn("truth", F.when(F.col("hunk") == 0, F.array(F.lit("1"), F.lit("2"))))
    hunks.write_bundle(d, f"{tmp_path}/bundle")
    back = hunks.read_bundle(spark, f"{tmp_path}/bundle")
    assert sorted(map(str, back.collect())) == sorted(map(str, d.select(back.columns).collect()))
    s = {r.resolver: (r.n, r.exact_rate) for r in hunks.resolver_summary(hunks.resolver_scores(back)).collect()}
    assert s == {"ours": (1, 0.0), "theirs": (1, 0.0), "union_ot": (1, 1.0), "union_to": (1, 0.0), "best": (1, 1.0)}
    assert tuple(hunks.locatable(back, ["path"]).first()) == (2, 1, 0.5, 0.5, 1)


def test_quotas_are_cut_and_topped_up(spark):
    d = spark.range(200).select("id", (F.col("id") % 2 == 0).alias("a"), (F.col("id") % 3 == 0).alias("b"))
    q = {"a": (F.col("a"), 30), "b": (F.col("b"), 30)}
    for total in (20, 100, 500):
        got = sampling.quota_sample(d, q, total, ["id"]).collect()
        assert len(got) == len({r.id for r in got}) == min(total, 200) and sum(r.drawn for r in got) <= 60
    assert all(r.drawn for r in sampling.quota_sample(d, q, 20, ["id"]).collect())


def test_dev_counts_its_own_rows(spark):
    """What test has too many is not taken from dev."""
    sizes = [13, 7, 21, 4, 9, 30, 2, 5, 11, 8]
    d = spark.createDataFrame([(f"r{i}",) for i, n in enumerate(sizes) for _ in range(n)], "repo string")
    import hashlib

    order = sorted(range(10), key=lambda i: hashlib.md5(f"{sampling.S.seed}|r{i}".encode()).hexdigest())
    for least, dev_share in ((10, 0.2), (10, 0.4), (1000, 0.2)):
        n, test, dev, want = sum(sizes), 0, 0, {}
        for i in order:
            if test < round(n * 0.6):
                want[f"r{i}"], test = "test", test + sizes[i]
            elif n < least or dev < round(n * dev_share):
                want[f"r{i}"], dev = "dev", dev + sizes[i]
            else:
                want[f"r{i}"] = "train"
        assert {r.repo: r.split for r in sampling.repo_split(d, min_train=least, dev_share=dev_share).collect()} == want


def test_sums_over_ranges_equal_plain_ones(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(ranking, "RANGES", 8)
    rng = np.random.default_rng(1)
    rows = [(i, float(np.round(rng.normal(), 2)), int(rng.random() < 0.3)) for i in range(900)]
    d = spark.createDataFrame(rows, "id int, s double, y int")
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    assert ranking.auc(d, "s", "y").first().auc == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg), abs=1e-9)
    values = np.array([s for _, s, _ in rows])
    got = {r.id: r.rank for r in ranking.mid_ranks(d, "s", ["id"]).collect()}
    assert all(got[i] == (values < s).sum() + ((values == s).sum() + 1) / 2 for i, s, _ in rows)
    got = {r.id: r.share for r in ranking.cumulative_share(d, "s").collect()}
    assert all(got[i] == pytest.approx((values <= s).mean(), abs=1e-9) for i, s, _ in rows)
    f = ranking.folds(d, ["id"], 7, 3).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in f) == [128] * 3 + [129] * 4 and {r.fold for r in f if r["count"] == 129} == {1, 2, 3, 4}
    r = ranking.binary_report(d, "s", "y").first()
    hit = [y for _, s, y in rows if s >= 0.5]
    assert (r.n, r.n_pos, r.n_neg) == (900, len(pos), len(neg)) and r.precision == pytest.approx(sum(hit) / len(hit), abs=1e-9) and r.recall == pytest.approx(sum(hit) / len(pos), abs=1e-9)
    r = ranking.binary_report(d.where("y = 1"), "s", "y").first()
    assert r.auroc is None and r.auprc is None and r.n_neg == 0


def test_gate_by_a_function_equals_scores(spark):
    import random

    from weftline.operators import schedule

    rng = random.Random(4)
    e = spark.createDataFrame([(f"r{i % 2}", i, rng.randrange(1, 40), rng.randrange(50)) for i in range(30)], "repo string, pr int, dur long, arr long")
    score = lambda x, y: (min(x, y) * 7 + max(x, y) * 3) % 10 / 10
    pairs = spark.createDataFrame([(f"r{x % 2}", x, y, score(x, y)) for x in range(30) for y in range(x + 2, 30, 2)], "repo string, pr_a int, pr_b int, score double")
    plain = lambda d: sorted(tuple(r) for r in d.collect())
    for tau in (0.2, 0.7):
        assert plain(schedule.gated(e, None, tau, score_fn=score)) == plain(schedule.gated(e, pairs, tau))
    both = schedule.gated_at(e, pairs, (0.2, 0.7))
    assert plain(both.where("tau = 0.7").drop("tau")) == plain(schedule.gated(e, pairs, 0.7))


def slow_gate(prs, blocked):
    """Minute by minute: whoever waits starts once nobody who runs blocks him, in order of arrival."""
    order, start, end, now, waiting, running = sorted(prs, key=lambda p: (p[1], p[0])), {}, {}, 0, [], set()
    while len(start) < len(prs):
        done = {p for p in running if end[p] <= now}
        running -= done
        arrived = [p for p in order if p[1] == now]
        for batch in ([waiting, arrived] if done else [[], arrived]):
            for p in list(batch):
                if not any(blocked(p[0], q) for q in running):
                    start[p[0]] = now
                    end[p[0]] = now + p[2]
                    running.add(p[0])
                    waiting = [w for w in waiting if w[0] != p[0]]
                elif p not in waiting:
                    waiting.append(p)
        now += 1
    return start


def test_gate_against_a_clock():
    import random

    from weftline.operators import schedule

    for seed in range(20):
        rng = random.Random(seed)
        prs = [(i, rng.randrange(60), rng.randrange(1, 25)) for i in range(20)]
        bad = {frozenset((a, b)) for a in range(20) for b in range(a) if rng.random() < 0.25}
        blocked = lambda a, b: frozenset((a, b)) in bad  # noqa: E731, B023
        got = schedule.gate([p[0] for p in prs], [p[1] for p in prs], [p[2] for p in prs], blocked)
        assert dict(enumerate(got)) == slow_gate(prs, blocked)


def test_models_against_plain_newton(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)) * [1, 2, 0.5] + [0, 1, 3]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [0.8, -0.5, 0.2])))).astype(int)
    names = ["a", "b", "c"]
    d = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, c double, y int")

    def newton(x, y, l2):
        x1, w = np.hstack([np.ones((len(x), 1)), x]), np.zeros(4)
        for _ in range(50):
            p = 1 / (1 + np.exp(-x1 @ w))
            pen = l2 * np.array([0, 1, 1, 1])
            w = w - np.linalg.solve(x1.T @ (x1 * (p * (1 - p))[:, None]) + np.diag(pen), x1.T @ (p - y) + pen * w)
        return w

    assert np.allclose(models.fit_hybrid(d, names, "y"), newton(x, y, 1.0), atol=1e-5)
    train, test = d.where("id % 2 = 0"), d.where("id % 2 = 1")
    mu, sd = x[::2].mean(0), x[::2].std(0) + 1e-9
    w = newton((x[::2] - mu) / sd, y[::2], 1e-4)
    got = {r.id: r.prob for r in models.train_to_test(train, test, names, "y", ["id"]).collect()}
    assert np.allclose([got[i] for i in range(1, 400, 2)], 1 / (1 + np.exp(-(np.hstack([np.ones((200, 1)), (x[1::2] - mu) / sd]) @ w))), atol=1e-5)
    r = models.cv_auc(d, names, "y", ["id"]).first()
    assert 0.6 < r.auc < 1 and 0.6 < r.mean_fold_auc < 1


def test_pending_repos(spark):
    p = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(7)] + [("c", 1)], "repo string, k int")
    done = p.where("repo = 'b' and k > 2")
    assert [tuple(r) for r in pools.pending_repos(p, done, ["repo", "k"]).collect()] == [("a", 5), ("b", 3), ("c", 1)]
    assert [r.repo for r in pools.pending_repos(p, None, ["repo", "k"], 1).collect()] == ["b"]


def test_first_come_first_served_over_buckets(spark):
    import random

    from weftline.operators import schedule

    rng, day = random.Random(3), schedule.DAY
    rows = [(rng.choice("aab"), i, rng.randrange(0, 3) * day // 2, rng.randrange(0, 300) * day) for i in range(200)]
    got = {r.pr: r.start for r in schedule.fifo(spark.createDataFrame(rows, "repo string, pr int, dur long, arr long")).collect()}
    free: dict[str, int] = {}
    for repo, pr, dur, arr in sorted(rows, key=lambda r: (r[3], r[1])):
        start = max(arr, free.get(repo, arr))
        assert got[pr] == start
        free[repo] = start + dur
