"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are its words, word pairs (a word and its own repeat share one feature), and the shapes of its
words (classes of first, second last and last byte, length) and pairs of shapes, hashed to 2^18 places with
logarithmic counts of unit length.  Training reads a bounded sample of labelled documents (the `sample` of least hash of
doc_id) in hash order, once per epoch; scoring is one sparse dot product per text, over the whole text.

Cases: null or empty text has the bias's score.  Rows without a label or with a null one teach nothing; of several
labels of a document the largest counts; of several texts of a doc_id the one of least hash is learnt.  No labels at all: score 0.5.  A null doc_id counts as the empty id and
matches no label.  Repeated rows are scored each.  An empty table gives an empty result.  Labels, lang, source and
doc_id are no inputs; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.langid import _fold
from weftline.llm.shared import MUL, batch_of, draw, hash_of, mix, placed_words, small_batches, texts

BITS, SAMPLE, EPOCHS, CUT = 18, 8000, 3, 0.7
_KIND = np.full(256, 3, np.uint64)  # other
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[128:] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
for _i, _c in enumerate(b".,;:!?'\"()-|$%&*#<>=/@_{}[]+~^\\", 4):
    _KIND[_c] = _i
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def features(docs: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, values) of each text."""
    h, off, first, last, buf = placed_words([d.lower() for d in docs])
    raw = np.frombuffer(b"\n".join(docs) + b"\n", np.uint8)
    shape = _KIND[raw[first]] | _KIND[raw[np.maximum(last - 1, first)]] << np.uint64(8) | _KIND[raw[last]] << np.uint64(16) | np.minimum(last - first, 15).astype(np.uint64) << np.uint64(24)
    same = np.where(h[1:] == h[:-1], np.uint64(1), mix(h[1:] * np.uint64(MUL) + h[:-1]))
    twice = mix(shape[1:] * np.uint64(MUL) + shape[:-1] + np.uint64(7))
    shape = mix(shape + np.uint64(1 << 40))
    down = np.uint64(64 - BITS)
    out = []
    for a, b in zip(off[:-1], off[1:], strict=True):
        g = np.concatenate([h[a:b], same[a : max(a, b - 1)], shape[a:b], twice[a : max(a, b - 1)]]) >> down
        i, n = np.unique(g.astype(np.int64), return_counts=True)
        v = np.log1p(n)
        out.append((i, v / max(1e-9, float(np.sqrt((v * v).sum())))))
    return out


class Ftrl:
    """Per-coordinate follow-the-regularised-leader with a bias at the last place."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.001, l2: float = 0.001):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, v: np.ndarray, y: float) -> None:
        i, v = np.append(i, 1 << BITS), np.append(v, 1.0)
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
        self.z[i] += g - (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha * w
        self.n[i] += g * g


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from at most `sample` labelled documents; labels: doc_id, quality (0 or 1)."""
    spark = docs.sparkSession
    small_batches(spark)
    labels = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = labels.count()
    chosen = draw(labels.select(F.lit(0).alias("key"), hash_of("doc_id").alias("h")), sample, {0: n} if n else {})
    if not chosen:
        return Ftrl().weights()
    few = labels.withColumn("h", hash_of("doc_id")).where(F.col("h") <= max(h for _, h in chosen))  # `sample` rows
    use = docs.join(F.broadcast(few), "doc_id").withColumn("t", F.xxhash64("text"))

    def run(batches):
        least: dict[int, int] = {}  # the least text hash of each document so far: `sample` of them
        for b in batches:
            new = []
            for k, (i, t) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("t").to_pylist(), strict=True)):
                if i not in least or t < least[i]:
                    least[i] = t
                    new.append(k)
            b = b.take(pa.array(new, pa.int64()))
            got = features([t.encode("utf-8", "surrogatepass") for t in texts(b)]) if new else []
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("h", "t", "quality")), pa.array([i.astype(np.int32).tobytes() for i, _ in got], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in got], pa.binary())], names=["h", "t", "y", "i", "v"])

    got = use.select("doc_id", "h", "t", "quality", "text").mapInArrow(run, "h long, t long, y int, i binary, v binary")
    got = got.groupBy("h").agg(F.min_by(F.struct("y", "i", "v"), "t").alias("x")).select("h", "x.y", "x.i", "x.v").toArrow().sort_by("h")
    y = got.column("y").to_numpy()
    idx, val = got.column("i"), got.column("v")
    model = Ftrl()
    for _ in range(epochs):
        for k in range(got.num_rows):
            model.learn(np.frombuffer(idx[k].as_buffer(), np.int32).astype(np.int64), np.frombuffer(val[k].as_buffer(), np.float32).astype(float), float(y[k]))
    return model.weights()


def score(docs: DataFrame, weights: np.ndarray, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    small_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(weights)  # 2^18 numbers

    def run(batches):
        w = told.value
        for b in batches:
            got = features([t.encode("utf-8", "surrogatepass") for t in texts(b)])
            p = 1 / (1 + np.exp(-np.clip([float(w[i] @ v) + w[-1] for i, v in got], -35, 35))) if got else np.zeros(0)
            yield batch_of(_OUT, b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= cut).astype(np.int32)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (_fold(4) == 2).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_fold(4) != 2)
    return score(docs, fit(docs, labels))
