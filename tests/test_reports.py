"""Feature and coverage operators on small tables, benchmark and table sinks, and the command line."""

import json
import math

import pytest

from weftline.__main__ import RESULTS, main
from weftline.operators import audit
from weftline.operators import similarity as T
from weftline.plans.catalog import QUERIES
from weftline.sources import tables

SF = "/root/testdata/sf0.001"
from pyspark.sql import functions as F  # noqa: E402


def slow_cosines(rows, log_tf, train=None):
    """Vectors over one vocabulary: every side of every (training) pair is a document."""
    import re
    from collections import Counter

    words = lambda t: Counter(re.findall("[a-z0-9_]+", (t or "").lower()))
    docs = [words(t) for r in (rows if train is None else train) for t in r[1:]]
    df = Counter(w for d in docs for w in d)
    idf = lambda w: math.log((1 + len(docs)) / (1 + df[w])) + 1
    out = {}
    for i, a, b in rows:
        x, y = ({w: (1 + math.log(c) if log_tf else c) * idf(w) for w, c in words(t).items()} for t in (a, b))
        n = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        out[i] = round(sum(v * y.get(w, 0) for w, v in x.items()) / n, 9) if n else 0.0
    return out


ROWS = [(1, "a a b", "a c"), (2, "same words", "same words"), (3, "", "x"), (4, None, None), (5, "p", "q"), (6, "a a b", "same c")]


@pytest.mark.parametrize("log_tf", [True, False])
def test_tfidf_is_fitted_over_all_texts(spark, log_tf):
    d = spark.createDataFrame(ROWS, "id int, a string, b string")
    got = {r.id: r.cosine for r in T.tfidf_cosine(d, ["id"], F.col("a"), F.col("b"), log_tf).collect()}
    assert got == pytest.approx(slow_cosines(ROWS, log_tf), abs=2e-9) and got[2] == 1 and got[3] == got[4] == got[5] == 0
    few = d.where("id < 3")
    got = {r.id: r.cosine for r in T.tfidf_cosine(d, ["id"], F.col("a"), F.col("b"), log_tf, train=few).collect()}
    assert got == pytest.approx(slow_cosines(ROWS, log_tf, ROWS[:2]), abs=2e-9)


def test_hybrid_cosine_takes_titles_and_bodies(spark):
    schema = "id int, title_a string, title_b string, body_a string, body_b string, dup_title boolean, conflict boolean, cross_agent boolean, near_miss boolean"
    rows = [(i, a, b, "z " * i, None if i == 2 else "b c", False, True, None, False) for i, a, b in ROWS]
    got = {r.id: r.cosine for r in T.hybrid_features(spark.createDataFrame(rows, schema), ["id"]).collect()}
    assert got == pytest.approx(slow_cosines([(r[0], f"{r[1] or ''} {r[3]}", f"{r[2] or ''} {r[4] or ''}") for r in rows], False), abs=2e-9)


def test_indicators_see_configuration_files(spark):
    d = spark.createDataFrame([(1, ["package.json"], ["package.json", "a/b.py"], True, True), (2, ["a.py"], ["a.py"], True, None), (3, [], ["x.py"], False, False)], "id int, files_a array<string>, files_b array<string>, conflict boolean, dup_title boolean")
    got = {r.id: (r.file_overlap, r.config_aware_overlap, r.duplicate_title) for r in T.indicator_scores(d, ["id"]).collect()}
    assert got == {1: (1, 0, 1), 2: (1, 1, 0), 3: (0, 0, 0)}


def test_hybrid_features_hold_no_outcome(spark):
    cols = T.hybrid_features(QUERIES_FLAGS(spark), ["repo", "pr_a", "pr_b"]).columns
    assert set(cols) == {"repo", "pr_a", "pr_b", "title_jaccard", "dup_title", "conflict", "cross_agent", "near_miss", "cosine"}


def QUERIES_FLAGS(spark):
    from weftline.plans.pools import flags

    return flags(spark, SF)


def test_coverage_counts_missing_and_failed(spark):
    p = spark.createDataFrame([("r", 1, 2, "x"), ("r", 1, 3, "x"), ("r", 2, 9, "y")], "repo string, pr_a int, pr_b int, s string")
    st = spark.createDataFrame([("r", 1, True), ("r", 2, True), ("r", 3, False), ("r", 3, False)], "repo string, pr int, ok boolean")
    assert {(r.s, r.n, r.n_both_ok, r.share) for r in audit.status_coverage(p, st, "s").collect()} == {("x", 2, 1, 0.5), ("y", 1, 0, 0.0)}


def test_replay_equals_labels(spark):
    got = QUERIES["replay_check"](spark, SF)
    assert got.count() > 0 and got.where("not same").count() == 0 and got.agg(F.sum("labeled")).first()[0] > 0


def test_check_values():
    assert audit.check_values({"a": 1.0, "b": 2.0}, {"a": 1.0, "b": 2.5, "c": 3.0}) == ["b: 2.0, not 2.5", "c: None, not 3.0"]


def test_benchmark_keeps_silver_out_of_test(spark, tmp_path):
    gold = spark.createDataFrame([("a", 1, "test"), ("b", 2, "dev"), ("c", 3, "train"), ("c", 4, "dev")], "repo string, id int, split string")
    silver = spark.createDataFrame([("a", 5), ("c", 6), ("d", 7)], "repo string, id int")
    over = tables.write_benchmark(gold, silver, f"{tmp_path}/b")
    assert [(r.repo, r.splits) for r in over.collect()] == [("c", ["dev", "train"])]
    got = {(r.id, r.split, r.source) for r in spark.read.parquet(f"{tmp_path}/b").collect()}
    assert got == {(1, "test", "gold"), (2, "dev", "gold"), (3, "train", "gold"), (4, "dev", "gold"), (7, "train", "silver")}


def test_missing_table_says_so(spark, tmp_path):
    tables.write_table(None, f"{tmp_path}/t.csv", "no gold labels")
    assert spark.read.csv(f"{tmp_path}/t.csv", header=True).first().asDict() == {"status": "NOT AVAILABLE", "reason": "no gold labels"}


def test_command_line(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and set(capsys.readouterr().out.split()) == set(QUERIES)
    assert main(["run", "nothing", "--data", SF]) == 2
    assert main(["run", "pool_counts", "--data", SF, "--out", f"{tmp_path}/o"], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/o/pool_counts.parquet").first()["n_pairs"] > 0
    assert main(["audit", "--data", SF], spark) in (0, 1)
    assert set(RESULTS) <= set(QUERIES)


def test_result_tables_and_manifest(spark, tmp_path, monkeypatch):
    import weftline.__main__ as cli

    monkeypatch.setattr(cli, "RESULTS", ("pool_counts", "macro_rate"))
    assert main(["tables", "--data", SF, "--out", f"{tmp_path}/t"], spark) == 0
    m = json.load(open(f"{tmp_path}/t/manifest.json"))
    assert m["row_counts"] == {"pool_counts": 1, "macro_rate": 1} and "documents.parquet" in m["inputs"] and len(m["inputs"]["documents.parquet"]) == 64


def test_features_are_counted_on_training_pairs_alone(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, d)
    schema = "repo string, pr_a int, pr_b int, agent_a string, agent_b string, title_a string, title_b string, files_a array<string>, files_b array<string>, opened_a timestamp, closed_a timestamp, opened_b timestamp, closed_b timestamp, conflict boolean"
    row = lambda repo, a, x, y, ta, tb, c: (repo, a, a + 100, x, y, ta, tb, ["f.py"], ["f.py"], t(1), t(5), t(2), t(4), c)
    train = spark.createDataFrame([row("r", 1, "x", "y", "add a", "add b", True), row("r", 2, "y", "x", "add a", "fix", False), row("s", 3, "x", "x", "b", "c", False)], schema)
    test = spark.createDataFrame([row("r", 4, "x", "x", "add a", "add new", True), row("t", 5, "z", "x", "new", "new", False)], schema)
    x, y, names = T.trained_features(train, test, ["repo", "pr_a", "pr_b"], F.col("title_a"), F.col("title_b"))
    assert names == ["repo_rate", "log_overlap", "cosine", "title_jaccard", "same_agent", "pair_0"]
    got = {r.pr_a: r for r in y.collect()}
    assert (got[4].repo_rate, got[4].same_agent, got[4].pair_0) == (0.5, 1, 1) and got[5].pair_0 == 0
    assert got[5].repo_rate == pytest.approx(1 / 3) and got[4].log_overlap == pytest.approx(math.log1p(48), abs=1e-8)
    want = slow_cosines([(4, "add a", "add new"), (5, "new", "new")], True, [(1, "add a", "add b"), (2, "add a", "fix"), (3, "b", "c")])
    assert {i: r.cosine for i, r in got.items()} == pytest.approx(want, abs=2e-9) and x.count() == 3


def test_one_hot_leaves_out_the_most_frequent(spark):
    d = spark.createDataFrame([("b",), ("b",), ("a",), ("c",), (None,)], "v string")
    assert T.frequent_values(d.where("v is not null"), "v") == ["a", "c"]
    assert [tuple(r) for r in T.one_hot(d.where("v is not null"), "v").orderBy("v").collect()] == [("a", 1, 0), ("b", 0, 0), ("b", 0, 0), ("c", 0, 1)]
    with pytest.raises(ValueError, match="more than"):
        T.frequent_values(d, "v", 2)
