"""Logistic regression by Newton steps over distributed normal equations, cross-validation and scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.numbers import sigmoid
from weftline.operators.ranking import auc, folds
from weftline.sources.scratch import settle


def moments(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature."""
    r = df.agg(*(f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {c: (r[f"m_{c}"] or 0.0, r[f"s_{c}"] or 0.0) for c in features}


def standardized(df: DataFrame, m: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - mu) / (sd + 1e-9) for c, (mu, sd) in m.items()})


def logit(features: list[str], w: np.ndarray) -> Column:
    return sum((F.col(c) * float(x) for c, x in zip(features, w[1:], strict=True)), F.lit(float(w[0])))


def fit_logistic(df: DataFrame, features: list[str], label: str, l2: float = 1e-4, iterations: int = 200, tol: float = 1e-8) -> np.ndarray:
    """Bias and weights; rows with a null take no part.

    Each step is one pass: every task adds up its gradient and Hessian by matrix products over Arrow batches, and their (k + 1)(k + 2)
    sums go to the driver, which solves for the step.
    """
    import pyarrow as pa

    k = len(features) + 1
    rows = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)), F.col(label).cast("double").alias("y")).dropna()
    w = np.zeros(k)
    for _ in range(iterations):

        def run(batches, w=w):
            total = np.zeros(k + k * k)
            for b in batches:
                x = np.column_stack([np.ones(b.num_rows), *(b.column(f"x{i}").to_numpy() for i in range(k - 1))])
                p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
                total[:k] += x.T @ (p - b.column("y").to_numpy())
                total[k:] += ((x * (p * (1 - p) + 1e-9)[:, None]).T @ x).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "v"])

        sums = {r["at"]: r["v"] for r in rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}
        total = np.array([sums.get(i, 0.0) for i in range(k + k * k)])
        ridge = l2 * np.array([0.0, *[1.0] * (k - 1)])
        step = np.linalg.solve(total[k:].reshape(k, k) + np.diag(ridge + 1e-12), total[:k] + ridge * w)
        w = w - step
        if np.abs(step).max() < tol:
            break
    return w


def out_of_fold(df: DataFrame, features: list[str], label: str, key: list[str], k: int = 5, seed: int = 0, iterations: int = 200) -> DataFrame:
    """Every row's probability from the model of the other folds; scales are those of the fold's training rows."""
    dealt = settle(folds(df.select(*key, *features, label), key, k, seed))
    out = None
    for f in range(1, k + 1):
        train, test = dealt.where(F.col("fold") != f), dealt.where(F.col("fold") == f)
        m = moments(train, features)
        w = fit_logistic(standardized(train, m), features, label, iterations=iterations)
        part = standardized(test, m).select(*key, label, "fold", sigmoid(logit(features, w)).alias("prob"))
        out = part if out is None else out.unionByName(part)
    return out


def cv_auc(df: DataFrame, features: list[str], label: str, key: list[str], k: int = 5, seed: int = 0) -> DataFrame:
    """Pooled AUC of out-of-fold scores, and the mean of the folds' own."""
    scored = settle(out_of_fold(df, features, label, key, k, seed))
    each = auc(scored, "prob", label, ["fold"], 15).agg(F.round(F.avg("auc"), 9).alias("mean_fold_auc"))
    return auc(scored, "prob", label).crossJoin(F.broadcast(each))  # one row


def train_to_test(train: DataFrame, test: DataFrame, features: list[str], label: str, key: list[str], l2: float = 1e-4) -> DataFrame:
    """Probabilities of test's rows from a model of train's, scaled by train's means and deviations."""
    m = moments(train, features)
    w = fit_logistic(settle(standardized(train, m).select(*features, label)), features, label, l2)
    return standardized(test, m).select(*key, label, sigmoid(logit(features, w)).alias("prob"))


def fit_hybrid(df: DataFrame, features: list[str], label: str) -> np.ndarray:
    """Bias and weights on the features as they are, with the penalty of half the squared weights."""
    return fit_logistic(settle(df.select(*features, label)), features, label, l2=1.0)


# Weights (bias first), means and deviations of the gate that predicts interference.
GATE = {"bias": -0.889, "cosine": (0.232, 0.160, 0.145), "jaccard": (0.213, 0.088, 0.151), "same_agent": (0.004, 0.956, 0.204), "trailing_rate": (0.546, 0.292, 0.120)}


def gate_score(cosine: Column, jaccard: Column, same_agent: Column, trailing_rate: Column) -> Column:
    z = F.lit(GATE["bias"])
    for c, name in ((cosine, "cosine"), (jaccard, "jaccard"), (same_agent, "same_agent"), (trailing_rate, "trailing_rate")):
        w, mu, sd = GATE[name]
        z = z + w * (c.cast("double") - mu) / sd
    return sigmoid(z)
