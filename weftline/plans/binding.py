"""Change requests, files, titles and raters as views of the driver's tables; the only place that knows both.

A repository is a customer, a change request an order, an agent an order priority, a file the part of a line.
`SQL` has the same views in the dialect of the checking engine, as named parts of a WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.coactive import coactive_pairs



def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    line = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
    words = F.split("p_name", " ")
    path = F.when(F.col("p_type").startswith("PROMO"), F.col("p_name")).otherwise(F.concat_ws("/", F.lower("p_type"), words[1], words[0]))
    return line.join(part, line.l_partkey == part.p_partkey).withColumn("path", path)


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """repo, pr, agent, opened, closed (null: still open), merged."""
    held = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("int").alias("q"))
    o = read(spark, sf, "orders").join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    closed = F.col("o_orderdate") + F.make_dt_interval(F.col("q"))
    return o.select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("pr"), F.col("o_orderpriority").alias("agent"), F.col("o_orderdate").alias("opened"), closed.alias("closed"), (F.col("o_orderstatus") == "F").alias("merged"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    """pr, path, additions, deletions: one row a file of a change request."""
    return lines(spark, sf).groupBy(F.col("l_orderkey").alias("pr"), "path").agg(F.sum(F.col("l_quantity").cast("long")).alias("additions"), F.sum(F.col("l_linenumber").cast("long")).alias("deletions"))


def file_sets(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).groupBy(F.col("l_orderkey").alias("pr")).agg(F.array_sort(F.collect_set("path")).alias("files"))


def titles(spark: SparkSession, sf: str) -> DataFrame:
    """pr, title: of the first line's part, with a marker that some lines set."""
    last = F.col("l_linenumber") == 7
    t = lines(spark, sf).groupBy("l_orderkey").agg(
        F.max(F.struct(-F.col("l_linenumber"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("t"))).alias("first"),
        F.bool_or(last & (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).alias("revert"),
        F.bool_or(last & (F.col("l_returnflag") == "A")).alias("fix"),
    )
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    marker = F.when(F.col("revert"), "revert").when(F.col("fix"), "fix")
    return t.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("pr"), F.concat_ws(" ", marker, F.col("first.t"), F.lower(F.substring("o_orderpriority", 3, 100))).alias("title"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return coactive_pairs(requests(spark, sf))


def labeled(spark: SparkSession, sf: str) -> DataFrame:
    """Co-active pairs with both file lists: files_a, files_b, conflict."""
    sets = file_sets(spark, sf)
    a, b = sets.select(F.col("pr").alias("pr_a"), F.col("files").alias("files_a")), sets.select(F.col("pr").alias("pr_b"), F.col("files").alias("files_b"))
    return pairs(spark, sf).join(a, "pr_a").join(b, "pr_b").withColumn("conflict", F.arrays_overlap("files_a", "files_b"))


def titled(spark: SparkSession, sf: str) -> DataFrame:
    t = titles(spark, sf)
    a, b = t.select(F.col("pr").alias("pr_a"), F.col("title").alias("title_a")), t.select(F.col("pr").alias("pr_b"), F.col("title").alias("title_b"))
    return labeled(spark, sf).join(a, "pr_a", "left").join(b, "pr_b", "left")


def with_bodies(spark: SparkSession, sf: str, d: DataFrame) -> DataFrame:
    """d with body_a, body_b: the names of a request's files stand for its text."""
    body = file_sets(spark, sf).select("pr", F.array_join("files", " ").alias("body"))
    for s in "ab":
        d = d.join(body.select(F.col("pr").alias(f"pr_{s}"), F.col("body").alias(f"body_{s}")), f"pr_{s}", "left")
    return d


def repositories(spark: SparkSession, sf: str) -> DataFrame:
    """repo, language, stars."""
    c, n = read(spark, sf, "customer"), read(spark, sf, "nation")
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("repo"), F.col("n_name").alias("language"), F.col("c_acctbal").cast("int").alias("stars"))  # nation: 25 rows


PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": ((), "SELECT l.*, p_name, p_type, CASE WHEN p_type LIKE 'PROMO%' THEN p_name ELSE lower(p_type) || '/' || split_part(p_name, ' ', 2) || '/' || split_part(p_name, ' ', 1) END AS path FROM lineitem l JOIN part ON l_partkey = p_partkey"),
    "requests": ((), "SELECT o_custkey AS repo, o_orderkey AS pr, o_orderpriority AS agent, o_orderdate AS opened, o_orderdate + to_days(CAST(q AS INT)) AS closed, o_orderstatus = 'F' AS merged FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"),
    "files": (("lines",), "SELECT l_orderkey AS pr, path, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS additions, CAST(sum(l_linenumber) AS BIGINT) AS deletions FROM lines GROUP BY 1, 2"),
    "sets": (("files",), "SELECT pr, list_sort(list(path)) AS files FROM files GROUP BY 1"),
    "titles": (("lines",), "SELECT o_orderkey AS pr, concat_ws(' ', CASE WHEN revert THEN 'revert' WHEN fix THEN 'fix' END, t, lower(substr(o_orderpriority, 3))) AS title FROM orders JOIN (SELECT l_orderkey, max((-l_linenumber, p_name || ' ' || lower(p_type)))[2] AS t, bool_or(l_linenumber = 7 AND l_returnflag = 'R' AND l_quantity > 45) AS revert, bool_or(l_linenumber = 7 AND l_returnflag = 'A') AS fix FROM lines GROUP BY 1) ON o_orderkey = l_orderkey"),
    "capped": (("requests",), "SELECT * REPLACE (coalesce(closed, (SELECT max(greatest(opened, coalesce(closed, opened))) FROM requests)) AS closed) FROM requests"),
    "pairs": (("capped",), "SELECT a.repo, a.pr AS pr_a, b.pr AS pr_b, a.agent AS agent_a, b.agent AS agent_b, a.opened AS opened_a, a.closed AS closed_a, b.opened AS opened_b, b.closed AS closed_b, a.merged AS merged_a, b.merged AS merged_b, a.agent <> b.agent AS cross_agent FROM capped a JOIN capped b ON a.repo = b.repo AND a.closed > b.opened AND (a.opened < b.opened OR (a.opened = b.opened AND a.pr < b.pr))"),
    "labeled": (("pairs", "sets"), "SELECT p.*, x.files AS files_a, y.files AS files_b, list_has_any(x.files, y.files) AS conflict FROM pairs p JOIN sets x ON x.pr = pr_a JOIN sets y ON y.pr = pr_b"),
    "titled": (("labeled", "titles"), "SELECT l.*, x.title AS title_a, y.title AS title_b FROM labeled l LEFT JOIN titles x ON x.pr = pr_a LEFT JOIN titles y ON y.pr = pr_b"),
    "bodies": (("sets",), "SELECT pr, array_to_string(files, ' ') AS body FROM sets"),
    "repositories": ((), "SELECT c_custkey AS repo, n_name AS language, CAST(trunc(c_acctbal) AS INT) AS stars FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"),
}


def with_parts(body: str, *names: str, **more: str) -> str:
    """SQL of a query over named views, with those that they need before them; `more` adds views of its own."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in PARTS[n][0]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    views = [f"{n} AS ({PARTS[n][1]})" for n in order] + [f"{n} AS ({t})" for n, t in more.items()]
    return f"WITH {', '.join(views)} {body}" if views else body
