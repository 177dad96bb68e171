"""Files of a study, prompts, logs and lookups, the audit's sections, and running sums in time buckets against plain ones."""

import hashlib
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import audit, coactive, hunks, sampling
from weftline.sources import layout, scratch, tables


def test_root_and_inputs(spark, tmp_path, monkeypatch):
    monkeypatch.delenv(layout.ROOT, raising=False)
    (tmp_path / "derived").mkdir()
    (tmp_path / "data" / "deep").mkdir(parents=True)
    (tmp_path / "derived/pairs_labeled.csv.gz").write_bytes(b"")
    with pytest.raises(FileNotFoundError, match=layout.ROOT):
        layout.find_root(str(tmp_path / "data"))
    (tmp_path / "data/pr_files.csv.gz").write_bytes(b"")
    assert layout.find_root(str(tmp_path / "data/deep")) == str(tmp_path)
    monkeypatch.setenv(layout.ROOT, str(tmp_path / "data"))
    assert layout.find_root(str(tmp_path)) == str(tmp_path / "data")
    (tmp_path / "repo_stats.csv").write_text("repo\n")
    got = layout.input_paths(spark, str(tmp_path), {"pr_texts": "x/t.csv", "pr_files": "/abs/f.csv"})
    assert got == {"pairs_labeled": f"{tmp_path}/derived/pairs_labeled.csv.gz", "pr_files": "/abs/f.csv", "pr_texts": f"{tmp_path}/x/t.csv", "repo_stats": f"{tmp_path}/repo_stats.csv"}
    assert layout.input_paths(spark, "s3a://b/root", {r: f"s3a://c/{r}" for r in layout.INPUTS})["pr_files"] == "s3a://c/pr_files"


def test_prompts(spark, tmp_path):
    (tmp_path / "judge_v1.txt").write_text("Rate it.")
    text, digest, path = layout.load_prompt(str(tmp_path), "v9")
    assert (text, digest) == ("Rate it.", hashlib.sha256(b"Rate it.").hexdigest()) and path.endswith("judge_v1.txt")
    row = {"repo": "r", "title_a": "T", "title_b": None, "body_a": "abcdef", "body_b": None, "n_files_a": 2, "n_files_b": 0, "files_a": "x\ny", "files_b": "", "files_shared": ""}
    d = spark.createDataFrame([tuple(row.values())], "repo string, title_a string, title_b string, body_a string, body_b string, n_files_a int, n_files_b int, files_a string, files_b string, files_shared string")
    assert d.select(layout.render_item(text, 3)).first()[0] == (
        "Rate it.\nREPOSITORY: r\n\n--- PR a ---\nTITLE: T\nDESCRIPTION: abc\nCHANGED FILES (2):\nx\ny\n\n--- PR b ---\nTITLE: \nDESCRIPTION: \nCHANGED FILES (0):\n\n\nFILES CHANGED BY BOTH:\n(none)\n"
    )


def test_logs_and_lookups(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    assert tables.append_csv(d.where("k < 3"), f"{tmp_path}/log", ["k"]).count() == 2
    assert sorted(tuple(r) for r in tables.append_csv(d.withColumn("v", F.upper("v")), f"{tmp_path}/log", ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "C")]
    assert [(r.k, r.place) for r in tables.lookup(d, [(3,), (9,), (1,)], ["k"]).collect()] == [(3, 0), (1, 2)]
    many = spark.createDataFrame([(1, 5, "x"), (1, 2, "y"), (2, 1, None)], "k int, o int, v string")
    assert sorted(tuple(r) for r in tables.first_per_key(many, ["k"], "o").collect()) == [(1, 2, "y"), (2, 1, None)]
    r = tables.with_versions(spark.createDataFrame([("old",), (None,)], "dataset_version string"), "v1").collect()
    assert [(x.dataset_version, x.config_version) for x in r] == [("old", "v1"), ("v1", "v1")]
    a, b = (spark.createDataFrame([(1, x, 5), (2, 3.0, 5)], "k int, p double, q int") for x in (1.0, 1.5))
    assert {(r.column, r.n, r.max_diff, r.n_differ) for r in tables.compared(a, b, ["k"], ["p", "q"]).collect()} == {("p", 2, 0.5, 1), ("q", 2, 0.0, 0)}


def test_text_helpers(spark):
    d = spark.createDataFrame([("2024-05-01 10:00:00", "a|b|", '[{"id": 1, "prob": 40}, {"id": 7, "prob": 9}]'), ("never", "", "id: 2 prob: 300")], "t string, l string, b string")
    got = d.select(X.utc(F.col("t")).alias("t"), X.listed(F.col("l")).alias("l"), X.parse_batch(F.col("b"), F.array(F.lit(1), F.lit(2))).alias("b"), X.json_object("t", "l").alias("j")).collect()
    assert got[0].t == datetime(2024, 5, 1, 10) and got[1].t is None and got[0].l == ["a", "b", ""] and got[1].l == []
    assert [[tuple(x) for x in r.b] for r in got] == [[(1, 0.4)], [(2, 1.0)]] and got[1].j == '{"t":"never","l":""}'


def test_audit_of_every_section(spark):
    t = datetime(2024, 1, 1)
    schema = "repo string, pr_a int, pr_b int, agent_a string, agent_b string, opened_a timestamp, opened_b timestamp, files_a array<string>, files_b array<string>, cross_agent boolean, conflict boolean, near_miss boolean, bm_shared boolean, fix_in_flight boolean, primary_stratum string"
    good = ("r", 1, 2, "x", "y", t, t + timedelta(1), ["a"], ["a"], True, True, False, False, False, "overlap_other")
    status = lambda d: {(r.section, r.check): r.status for r in d.collect() if r.status != "PASS"}
    pairs = spark.createDataFrame([good], schema)
    assert status(audit.full_audit(pairs)) == {("pools", "flags_missing"): "WARN", ("sampling", "frame_missing"): "WARN", ("gold", "gold_missing"): "WARN", ("judge", "judge_missing"): "WARN", ("static_analysis", "evidence_missing"): "WARN", ("benchmark", "splits_missing"): "WARN", ("reproducibility", "manifest_missing"): "WARN"}
    assert status(audit.full_audit(pairs, strict=True))["reproducibility", "manifest_absent"] == "FAIL"
    frame = spark.createDataFrame([("r", 1, 2, 1, True, 0.5, False, None), ("r", 8, 9, 1, True, 0.0, True, 1.5)], "repo string, pr_a int, pr_b int, frame_id int, in_enriched_sample boolean, pi_enriched double, in_prevalence_sample boolean, pi_prevalence double")
    gold = spark.createDataFrame([(1, "D"), (1, "Q")], "item int, label string")
    judged = spark.createDataFrame([(1, "none", None)], "item int, category string, raw_text string")
    bad = spark.createDataFrame([(*good[:10], False, True, True, False, "odd")], schema)
    found = status(audit.full_audit(pairs, bad, frame, gold, judged, frame, spark.createDataFrame([("r", "test"), ("r", "dev")], "repo string, split string"), {"git_commit": "", "inputs": {"a": "b"}, "row_counts": {}, "pool_counts": {"x": 1}}))
    assert found == {
        ("pools", "bm_shared_without_conflict"): "FAIL", ("pools", "unknown_stratum"): "FAIL", ("sampling", "duplicate_key"): "FAIL", ("sampling", "outside_population"): "FAIL",
        ("sampling", "pi_enriched_out_of_range"): "FAIL", ("sampling", "pi_prevalence_out_of_range"): "FAIL", ("gold", "duplicate_key"): "FAIL", ("gold", "unknown_label"): "FAIL", ("judge", "raw_missing"): "FAIL",
        ("static_analysis", "evidence_outside_population"): "FAIL", ("benchmark", "repo_in_two_splits"): "FAIL", ("reproducibility", "git_commit_missing"): "WARN", ("reproducibility", "row_counts_empty"): "FAIL",
    }


def spans(seed, n=120):
    rng, start = random.Random(seed), datetime(2020, 1, 1)
    out = []
    for i in range(n):
        a = start + timedelta(days=rng.randrange(400), hours=rng.randrange(3))
        out.append(("hot" if rng.random() < 0.8 else "cold", i, a, a + timedelta(days=rng.choice([0, 1, 45, 200]))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_running_sums_over_time_buckets(spark, seed):
    s = spans(seed)
    d = spark.createDataFrame(s, "repo string, pr int, opened timestamp, closed timestamp")
    points = [("hot", k, datetime(2020, 1, 1) + timedelta(days=k * 9)) for k in range(70)]
    at = spark.createDataFrame(points, "repo string, k int, ts timestamp").select("repo", "k", F.unix_micros("ts").alias("at"))
    got = {r.k: r.concurrency for r in coactive.concurrency_at(at, d).collect()}
    assert got == {k: sum(r == repo and a <= t <= b for r, _, a, b in s) for repo, k, t in points}
    p = {r.repo: r for r in coactive.concurrency_profile(d).collect()}
    for repo in ("hot", "cold"):
        mine = [(a, b) for r, _, a, b in s if r == repo]
        times = sorted({x for ab in mine for x in ab})
        levels = [sum(a <= t for a, _ in mine) - sum(b <= t for _, b in mine) for t in times]
        span = (times[-1] - times[0]).total_seconds()
        area = sum(n * (v - u).total_seconds() for n, u, v in zip(levels, times, times[1:], strict=False))
        assert p[repo].max_level == max(levels)
        assert p[repo].mean_level == pytest.approx(area / span) and p[repo].span_days == pytest.approx(span / 86400)
    pairs = [(r, i, i + 1000, b, b + timedelta(days=i % 3), a + timedelta(days=2), i % 4 == 0) for r, i, a, b in s]
    q = spark.createDataFrame(pairs, "repo string, pr_a int, pr_b int, closed_a timestamp, closed_b timestamp, opened_b timestamp, conflict boolean")
    rates = {r.pr_a: (r.n_before, r.rate) for r in coactive.trailing_rate(q).collect()}
    for repo, i, _, _, _, begun, _ in pairs:
        past = [c for r, _, _, ca, cb, _, c in pairs if r == repo and max(ca, cb) < begun]
        assert rates[i][0] == len(past) and rates[i][1] == pytest.approx((sum(past) + 5) / (len(past) + 10))
    commits = [(r, a + timedelta(hours=7), f"c{i:03}") for r, i, a, _ in s if i % 5 == 0]
    after = {r.pr_a: r.recon_sha for r in hunks.first_commit_after(q, spark.createDataFrame(commits, "repo string, at timestamp, sha string")).collect()}
    for repo, i, _, ca, cb, _, _ in pairs:
        later = sorted((t, c) for r, t, c in commits if r == repo and t > max(ca, cb))
        assert after[i] == (later[0][1] if later else None)


def test_frame_with_its_samples(spark):
    from weftline.plans import samples

    parts = samples.framed(spark, "/root/testdata/sf0.001")
    keys = lambda d: {(r.repo, r.pr_a, r.pr_b) for r in d.collect()}
    frame, cal, val = (keys(parts[k]) for k in ("frame", "calibration", "validation"))
    assert cal <= frame and val <= frame and not cal & val and len(cal) == min(sampling.S.calibration_n, len(frame))
    f = parts["frame"].collect()
    assert sorted(r.frame_id for r in f) == list(range(1, len(f) + 1)) and {r.dataset_version for r in f} == {"v1"}


def test_no_machine_local_folder_on_a_cluster():
    class Frame:
        class sparkSession:
            class sparkContext:
                master = "yarn"
                getCheckpointDir = staticmethod(lambda: None)

            class conf:
                get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.settle(Frame)


def test_every_section_of_the_tables_passes(spark):
    from weftline.plans.catalog import QUERIES

    got = defaultdict(set)
    for r in QUERIES["audit_sections"](spark, "/root/testdata/sf0.001").collect():
        got[r.section].add(r.status)
    assert set(got) == set(audit.SECTIONS) and all(s == {"PASS"} for k, s in got.items() if k != "reproducibility") and got["reproducibility"] == {"WARN"}
