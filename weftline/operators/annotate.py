"""Annotation rounds: blinded sheets, imports, agreement, adjudication; judged labels and their errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.config import BLIND_PARTS, HARMFUL, LABELS
from weftline.operators.stats import class_scores, cohen_kappa, crosstab, fleiss_kappa, krippendorff_alpha


def blinded(df: DataFrame, hidden: tuple[str, ...] = ()) -> DataFrame:
    """Without hidden columns and those whose names tell an outcome; six empty label columns are added."""
    keep = [c for c in df.columns if c not in hidden and not any(p in c.lower() for p in BLIND_PARTS)]
    return df.select(*keep, *(F.lit("").alias(c) for c in ("label_category", "confidence", "evidence", "ambiguous", "annotator", "timestamp")))


def import_labels(df: DataFrame, annotator: str, labels=LABELS) -> DataFrame:
    """Rows with a known label and a confidence of 1 to 3; anything else raises."""
    ok = F.col("label_category").isin(*labels) & F.col("confidence").cast("string").isin("1", "2", "3")
    bad = df.where(~F.coalesce(ok, F.lit(False))).limit(5).collect()
    if bad:
        raise ValueError(f"labels or confidences out of range: {[r.asDict() for r in bad]}")
    return df.withColumn("confidence", F.col("confidence").cast("int")).withColumn("annotator", F.lit(annotator))


def adjudicate(sheets: list[DataFrame], decisions: DataFrame | None, item: str = "item") -> DataFrame:
    """All raters' labels side by side; gold is the decision, or the label that all give."""
    out = None
    for i, s in enumerate(sheets, 1):
        s = s.select(item, F.col("label_category").alias(f"ann{i}"), F.col("confidence").alias(f"conf{i}"))
        out = s if out is None else out.join(s, item, "full_outer")
    cols = [F.col(f"ann{i}") for i in range(1, len(sheets) + 1)]
    agreed = F.lit(True)
    for c in cols:
        agreed = agreed & F.coalesce(c == cols[0], F.lit(False))
    if decisions is not None:
        out = out.join(decisions.select(item, F.col("label_category").alias("decided")), item, "left")
    else:
        out = out.withColumn("decided", F.lit(None).cast("string"))
    out = out.withColumn("agreed", agreed).withColumn("gold", F.coalesce("decided", F.when(F.col("agreed"), cols[0])))
    source = F.when(F.col("decided").isNotNull(), "adjudicated").when(F.col("agreed"), "agreed")
    return out.withColumn("label_source", source)


def agreement(sheets: list[DataFrame], item: str = "item") -> DataFrame:
    """One row: raw agreement and kappa of the first two raters, Fleiss' kappa and Krippendorff's alpha over all."""
    two = sheets[0].select(item, F.col("label_category").alias("a")).join(sheets[1].select(item, F.col("label_category").alias("b")), item)
    every = None
    for s in sheets:
        s = s.select(item, "label_category")
        every = s if every is None else every.union(s)
    common = every.groupBy(item).count().where(F.col("count") == len(sheets)).select(item)
    f = fleiss_kappa(every.join(common, item, "left_semi"), item, "label_category").select(F.col("kappa").alias("fleiss"))
    return cohen_kappa(two, "a", "b").crossJoin(F.broadcast(f)).crossJoin(F.broadcast(krippendorff_alpha(every, item, "label_category").select("alpha")))  # one row each


def agreement_by_class(sheets: list[DataFrame], item: str = "item", labels=LABELS) -> tuple[DataFrame, DataFrame]:
    """Of the first two raters, the first taken as true: scores by class with the macro F1 (over classes that have one), and the confusion grid."""
    two = sheets[0].select(item, F.col("label_category").alias("a")).join(sheets[1].select(item, F.col("label_category").alias("b")), item)
    per = class_scores(two, "a", "b")
    macro = per.agg(F.round(F.avg("f1"), 9).alias("macro_f1"))
    return per.crossJoin(F.broadcast(macro)), crosstab(two, "a", "b", list(labels))  # one row


def official_label(provisional, has_diff):
    """A judged label that needs a diff counts as none without one."""
    return F.when(has_diff | provisional.isin("D", "C", "none"), provisional).otherwise("none")


def error_bundles(gold: DataFrame, pred: DataFrame, item: str, cap: int = 50) -> DataFrame:
    """False alarms and misses of a judge, the first `cap` of each by item."""
    d = gold.select(item, "gold").join(pred.select(item, F.col("category").alias("pred")), item)
    kind = F.when((F.col("pred") != "none") & F.col("gold").isin("none", "B"), "FP").when(F.col("gold").isin(*HARMFUL) & F.col("pred").isin("none", "B"), "FN")
    from pyspark.sql import Window

    return d.withColumn("kind", kind).where("kind is not null").withColumn("_r", F.row_number().over(Window.partitionBy("kind").orderBy(item))).where(F.col("_r") <= cap).drop("_r")
