"""Known values of the column functions and sequential parts."""

import pytest
from pyspark.sql import functions as F

from weftline.config import Settings, deep_merge, from_file, load_settings
from weftline.functions import numbers as N
from weftline.functions import paths as P
from weftline.functions import text as X
from weftline.operators import hunks as H
from weftline.operators import schedule as D
from weftline.operators.similarity import forbid_leaks


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


def test_titles(spark):
    dup = lambda a, b: X.is_duplicate_title(X.normalize_title(F.lit(a)), X.normalize_title(F.lit(b)))
    r = one(spark, X.normalize_title(F.lit("[Codex] Fix: Login!")), X.normalize_title(F.lit(None).cast("string")), dup("add user login flow", "add user login form"), dup("fix", "fix it"), dup("implement the retry logic", "we implement the retry logic for all of the network calls made"), X.has_revert(F.lit("Rollback of x")), X.has_revert(F.lit("undone")))
    assert tuple(r) == ("fix login", "", True, False, True, True, False)
    r = one(spark, X.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"), 1.0), X.jaccard(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")), 0.0))
    assert tuple(r) == (1.0, 0.5)


def test_paths(spark):
    k = lambda p, **o: P.directory_key(F.lit(p), **o)
    r = one(spark, k("README.md"), k("src/foo.py"), k("a/b/c/d.py"), k("a\\b\\c.py"), k("README.md", root="<root>"), k("src/login.py", with_name=True), P.parent_directory(F.lit("a/b/c/d.py")))
    assert tuple(r) == (None, "src", "a/b", "a/b", "<root>", "src/login.py", "a/b/c")
    names = {".github/workflows/ci.yml": "ci_workflow", "x/Cargo.lock": "lockfile", "go.mod": "lockfile", "requirements.txt": "manifest", "Dockerfile": "docker", "README.rst": "readme", "docs/a.md": "other_docs", ".gitignore": "other_config", "a.json": "other_config", "src/a.py": "source"}
    assert list(one(spark, *(P.file_class(F.lit(n)) for n in names))) == list(names.values())
    r = one(spark, P.path_similarity(F.array(F.lit("src/auth.py")), F.array(F.lit("src/login.py"))), P.repo_of_url(F.lit("https://api/repos/a/b/pulls")), X.filename_tokens(F.lit("see ./src/a.py and x.y/z.")))
    assert r[0] == 0.0 and r[1] == "a/b" and sorted(r[2]) == ["src/a.py", "x.y", "x.y/z"]


def test_answers(spark):
    ok = X.parse_judgement(F.lit('text {"category": "D", "confidence": 2, "evidence": "e"} more'))
    bad = [X.parse_judgement(F.lit(t)) for t in ("{oops", '{"category": "Q", "confidence": 2}', '{"category": "D", "confidence": 0}', '{"category": "D", "confidence": 9}', "")]
    r = one(spark, ok, *bad)
    assert tuple(r[0]) == ("D", 2, "e") and all(x is None for x in r[1:])
    r = one(spark, X.parse_batch(F.lit('[{"id": 1, "prob": 250}, {"id": 2, "prob": 40}]')), X.parse_batch(F.lit("id: 3, prob = 12.5")), X.fenced_code(F.lit("a\n```py\nx\ny\n```")), X.fenced_code(F.lit("none")))
    assert [tuple(x) for x in r[0]] == [(1, 1.0), (2, 0.4)] and [tuple(x) for x in r[1]] == [(3, 0.125)] and r[2] == ["x", "y"] and r[3] is None


def test_truth_values(spark):
    r = one(spark, X.as_bool(F.lit("True"), "string"), X.as_bool(F.lit(" t "), "string"), X.as_bool(F.lit("no"), "string"), X.as_bool(F.lit(2), "int"), X.as_bool(F.lit(None).cast("double"), "double"))
    assert tuple(r) == (True, True, False, True, False)


def test_numbers(spark):
    r = one(spark, *N.wilson(F.lit(0), F.lit(10)), *N.wilson(F.lit(1), F.lit(1)), N.wilson(F.lit(0), F.lit(0))[0], N.binned(F.lit(6.0), *N.DURATION), N.binned(F.lit(6.0), *N.DURATION, right=True))
    assert r[0] == 0 and r[1] >= 0 and r[3] == 1 and r[6] is None and (r[7], r[8]) == ("6-24h", "1-6h")


def test_hunks_and_anchors():
    text = "a\nb\nc\nd\n<<<<<<< x\no1\n||||||| base\nq\n=======\nt1\nt2\n>>>>>>> y\ne\nf\ng\nh\n<<<<<<< x\n=======\nz\n>>>>>>> y"
    h = H.parse_hunks(text)
    assert [(x["pre"], x["ours"], x["theirs"], x["post"]) for x in h] == [(["b", "c", "d"], ["o1"], ["t1", "t2"], ["e", "f", "g"]), (["f", "g", "h"], [], ["z"], [])]
    assert H.locate(["b", "c", "d", "N", "e", "f"], ["b", "c", "d"], ["e"]) == ["N"] and H.locate(["x"], [], []) == ["x"] and H.locate(["x"], ["y"], []) is None
    assert H.similarity("", " ") == (True, 1.0) and H.similarity("a b", "a  b") == (True, 1.0) and H.similarity("abcd", "abxd")[1] == 0.75


def test_gate_waits_and_rescans():
    start = D.gate([1, 2, 3], [0, 1, 2], [10, 5, 1], lambda a, b: {a, b} in ({1, 2}, {2, 3}))
    assert start == [0, 10, 2]
    assert D.gate([1, 2], [0, 5], [5, 5], lambda a, b: True) == [0, 5]
    assert D.gate([1, 2, 3], [0, 0, 0], [2, 2, 2], lambda a, b: True) == [0, 2, 4]


def test_settings(tmp_path):
    assert deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    (tmp_path / "base.json").write_text('{"dup_jaccard": 0.6, "targets": {"dup": 5}}')
    (tmp_path / "top.json").write_text('{"extends": "base.json", "census": 7}')
    s = from_file(str(tmp_path / "top.json"))
    assert (s.dup_jaccard, s.census, s.targets["dup"], s.targets["control"]) == (0.6, 7, 5, 2000)
    with pytest.raises(ValueError, match="unknown"):
        load_settings([{"nope": 1}])
    assert Settings().seed == 20260824


def test_leaks_are_refused():
    forbid_leaks(["title_jaccard"])
    forbid_leaks(["merged_b"], retrospective=True)
    with pytest.raises(ValueError, match="merged_b"):
        forbid_leaks(["title_jaccard", "merged_b"])
