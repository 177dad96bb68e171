"""Every registered query against its SQL in an independent engine, on the smallest tables; and the entry module."""

import importlib
import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from weftline.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or (not isinstance(v, list) and v != v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) and math.isfinite(v) else str(v)


def rows(df):
    return sorted(zip(*([plain(v) for v in df[c].tolist()] for c in sorted(df.columns)), strict=True))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_gate_that_knows_all_leaves_no_conflict(spark):
    got = QUERIES["oracle_gate"](spark, "/root/testdata/sf0.01").collect()
    assert got and all(r.conflicts == 0 and r.new_conflicts == 0 and r.added_delay_days >= 0 for r in got)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"oracle_gate", "tau_sweep"}))
def test_queries_without_sql_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() >= 1


def test_resolvers_see_whole_texts(spark):
    from weftline.operators.hunks import similarity

    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text is not None]
    sims = {"ours": [], "theirs": []}
    for r in docs:
        w = r.text.split(" ")
        for name, side in (("ours", w[:-1]), ("theirs", w[1:])):
            sims[name].append(similarity("\n".join(side), "\n".join(w[:-1] if r.doc_id % 2 == 0 else w)))
    got = {r.resolver: r for r in QUERIES["resolver_scores"](spark, SF).collect()}
    for name, s in sims.items():
        assert got[name].n == len(docs)
        assert abs(got[name].exact_rate - sum(x for x, _ in s) / len(s)) < 1e-5
        assert abs(got[name].mean_sim - sum(x for _, x in s) / len(s)) < 1e-5


def test_bootstrap_has_the_replicates_of_the_settings(spark):
    from weftline.config import Settings
    from weftline.operators.stats import cluster_bootstrap
    from weftline.plans import binding as B

    want = cluster_bootstrap(B.labeled(spark, SF), "repo", "conflict", Settings().bootstrap).first()
    assert Settings().bootstrap == 5000 and QUERIES["cluster_bootstrap"](spark, SF).first() == want


def test_entry(spark):
    e = importlib.import_module("__spark_entry__")
    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_library_stands_without_the_corpus_operators(tmp_path):
    root = Path(__file__).parents[1]
    code = (
        "import sys, importlib.util as u\n"
        f"sys.path.insert(0, {str(tmp_path)!r})\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q, q.keys()\n"
        "assert set(e.oracle_sql()) <= set(q)\n"
    )
    import shutil

    shutil.copytree(root / "weftline", tmp_path / "weftline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "weftline/llm/__pycache__").mkdir(parents=True)
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
