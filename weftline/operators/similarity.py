"""TF-IDF cosines of text pairs, and the features of the prediction ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.config import LEAKY
from weftline.functions import numbers as N
from weftline.functions import paths as P
from weftline.functions import text as X
from weftline.sources.scratch import settle


def tfidf_cosine(pairs: DataFrame, key: list[str], a: Column, b: Column, log_tf: bool = True, digits: int = 9, train: DataFrame | None = None) -> DataFrame:
    """key columns and cosine of the two texts of each pair; 0 if either has no word.

    Each side of each pair is a document; with `train`, each side of each of its pairs is (a and b must resolve there too), and a
    token that none of them has counts as in no document.  tf is 1 + ln(count), or the count; idf is
    ln((1 + N) / (1 + df)) + 1.  Words are counted once a different text, however many pairs it stands in; pairs carry digests of texts.
    """
    sides = lambda d: d.select(*key, F.coalesce(a, F.lit("")).alias("a"), F.coalesce(b, F.lit("")).alias("b"))
    stack = lambda d, use: d.select(F.explode(F.array("a", "b")).alias("text"), F.lit(use).alias("use"))
    own, fit = sides(pairs), sides(pairs if train is None else train)
    texts = stack(own, 1) if train is None else stack(own, 0).union(stack(fit, 1))
    texts = texts.groupBy(F.md5("text").alias("id")).agg(F.first("text").alias("text"), F.sum("use").alias("uses"))
    tf = texts.select("id", "uses", F.explode(X.word_tokens(F.col("text"))).alias("token")).groupBy("id", "uses", "token").agg(F.count("*").alias("c"))
    df = tf.groupBy("token").agg(F.sum("uses").alias("df"))
    total = fit.agg((2 * F.count("*")).alias("n"))
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    count = F.col("c").cast("double")
    w = settle(tf.join(df, "token").crossJoin(F.broadcast(total)).select("id", "token", ((1 + F.log(count) if log_tf else count) * idf).alias("w")))  # one row
    norm = w.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("n"))
    size = lambda s: norm.select(F.col("id").alias(f"i{s}"), F.col("n").alias(f"n{s}"))
    ids = own.select(*key, F.md5("a").alias("ia"), F.md5("b").alias("ib"))
    left, right = (w.select(F.col("id").alias(f"i{s}"), "token", F.col("w").alias(f"w{s}")) for s in "ab")
    dot = ids.join(left, "ia").join(right, ["ib", "token"]).groupBy(*key).agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    g = ids.join(dot, key, "left").join(size("a"), "ia", "left").join(size("b"), "ib", "left")
    cos = F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("dot") / F.sqrt(F.col("na") * F.col("nb")))
    return g.select(*key, F.round(F.coalesce(cos, F.lit(0.0)), digits).alias("cosine"))


def repo_rates(pairs: DataFrame, held: DataFrame, key: list[str], group: str = "repo", flag: str = "conflict", digits: int = 9) -> DataFrame:
    """held rows with the flag's rate among the group's rows that are not held; elsewhere the rate of all those."""
    train = pairs.join(held.select(*key), key, "left_anti")
    rates = train.groupBy(group).agg(F.avg(F.col(flag).cast("int")).alias("_rate"))
    overall = train.agg(F.avg(F.col(flag).cast("int")).alias("_all"))
    return held.join(rates, group, "left").crossJoin(F.broadcast(overall)).withColumn("repo_rate", F.round(F.coalesce("_rate", "_all"), digits)).drop("_rate", "_all")  # one row


def forbid_leaks(columns: list[str], retrospective: bool = False) -> None:
    """Raise if a feature tells the outcome."""
    bad = sorted(set(columns) & set(LEAKY))
    if bad and not retrospective:
        raise ValueError(f"features that tell the outcome: {bad}")


def ladder_features(pairs: DataFrame, key: list[str]) -> DataFrame:
    """title Jaccard, log overlap, same agent, file-name overlap and rule-based scores of each pair."""
    ta, tb = F.array_distinct(X.word_tokens(F.col("title_a"))), F.array_distinct(X.word_tokens(F.col("title_b")))
    h = N.overlap_hours(F.col("opened_a"), F.col("closed_a"), F.col("opened_b"), F.col("closed_b"))
    fa, fb = X.filename_tokens(F.array_join("files_a", " ")), X.filename_tokens(F.array_join("files_b", " "))
    out = pairs.select(
        *key, F.round(X.jaccard(ta, tb, 0.0), 9).alias("title_jaccard"), F.round(F.log1p(h), 9).alias("log_overlap"),
        (F.col("agent_a") == F.col("agent_b")).cast("int").alias("same_agent"), F.size(F.array_intersect(fa, fb)).alias("filename_overlap"),
        F.concat_ws("+", F.least("agent_a", "agent_b"), F.greatest("agent_a", "agent_b")).alias("agent_pair"),
    )
    forbid_leaks(out.columns)
    return out


def frequent_values(df: DataFrame, column: str, most: int = 1000) -> list:
    """The values of a column but the most frequent (ties: the smaller), by frequency: the reference level is left out.  More than `most` raises."""
    values = [r[0] for r in df.groupBy(column).count().orderBy(F.desc("count"), column).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values")
    return values[1:]


def one_hot(df: DataFrame, column: str, prefix: str = "is_", values: list | None = None, numbered: bool = False) -> DataFrame:
    """0/1 columns for each of the values (those of frequent_values unless given), named by the value or by its place."""
    values = frequent_values(df, column) if values is None else values
    return df.select("*", *(F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{prefix}{i if numbered else v}") for i, v in enumerate(values)))


def indicator_scores(flags: DataFrame, key: list[str]) -> DataFrame:
    """Scores that need no model: always 0, overlap, overlap beyond configuration files alone, near-equal titles."""
    shared = F.array_intersect("files_a", "files_b")
    bit = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return flags.select(*key, F.lit(0).alias("always_safe"), bit(F.col("conflict")).alias("file_overlap"), bit(F.col("conflict") & ~P.is_pure_config(shared)).alias("config_aware_overlap"), bit(F.col("dup_title")).alias("duplicate_title"))


def hybrid_features(flags: DataFrame, key: list[str]) -> DataFrame:
    """Title Jaccard, flags and cosine of title and body of each pair, checked against columns that tell the outcome.

    The cosine's vocabulary and idf are those of all texts of all pairs, under raw counts.
    """
    ta, tb = (X.title_tokens(X.normalize_title(F.col(c))) for c in ("title_a", "title_b"))
    bit = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int").alias(c)
    body = lambda s: F.coalesce(F.col(f"body_{s}"), F.lit("")) if f"body_{s}" in flags.columns else F.lit("")
    text = lambda s: F.concat(F.coalesce(F.col(f"title_{s}"), F.lit("")), F.lit(" "), body(s))
    base = flags.select(*key, F.round(X.jaccard(ta, tb, 1.0), 9).alias("title_jaccard"), *map(bit, ("dup_title", "conflict", "cross_agent", "near_miss")))
    out = base.join(tfidf_cosine(flags, key, text("a"), text("b"), log_tf=False), key)
    forbid_leaks(out.columns)
    return out


def trained_features(train: DataFrame, test: DataFrame, key: list[str], a: Column, b: Column) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both tables with label and the feature block, and the features' names; everything is counted on `train` alone.

    The repository's rate of conflicts (the overall one where train has none of it), log overlap, cosine with train's
    idf, title Jaccard, same agent, and the pair of agents as 0/1 columns but for the most frequent pair.
    """
    rates = train.groupBy("repo").agg(F.avg(F.col("conflict").cast("int")).alias("_rate"))
    overall = train.agg(F.avg(F.col("conflict").cast("int")).alias("_all"))
    pairs = F.concat_ws("+", F.least("agent_a", "agent_b"), F.greatest("agent_a", "agent_b"))
    levels = frequent_values(train.select(pairs.alias("agent_pair")), "agent_pair")

    def block(d: DataFrame) -> DataFrame:
        base = ladder_features(d, [*key, "conflict"]).join(tfidf_cosine(d, key, a, b, train=train), key)
        base = base.join(rates, "repo", "left").crossJoin(F.broadcast(overall)).withColumn("repo_rate", F.coalesce("_rate", "_all"))  # one row
        return one_hot(base, "agent_pair", "pair_", levels, numbered=True).withColumn("label", F.col("conflict").cast("int"))

    names = ["repo_rate", "log_overlap", "cosine", "title_jaccard", "same_agent", *(f"pair_{i}" for i in range(len(levels)))]
    forbid_leaks(names)
    return tuple(block(d).select(*key, "label", *names) for d in (train, test)) + (names,)
