"""Quality classifier: supervised subword embeddings (Joulin et al., 2016).

Each hashed word, pair of words and character n-gram has a learned vector; a document is the
average of its vectors (words and pairs, of which there are fewer, count WORD_TIMES each), and a softmax over a linear layer gives the class. Vectors and layer are trained
by stochastic gradient descent in numpy, on a bounded sample of labelled rows. In scoring,
vectors and layer are multiplied out first, so a feature adds a single number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused
from .labelled import held_out, learned, sample, scored
from .subwords import Subwords

#: Most labelled rows that the model learns from.
TRAIN_ROWS = 4000
DIM, EPOCHS, RATE = 8, 6, 0.5
#: Steps at least, so that a small sample is gone through more often.
STEPS = 3000
WORD_TIMES = 8
THRESHOLD = 0.3


def features() -> Subwords:
    return Subwords(bits=16, ns=(2, 3, 4), words=True, pairs=True, times=WORD_TIMES)


def fit(at: list[np.ndarray], n: list[np.ndarray], y: list[int], buckets: int, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> np.ndarray:
    """The weight of each bucket in the log odds of class 1, and the bias as a last row.

    Steps are scaled by the running squares of the gradients (AdaGrad). Without rows the
    odds are even; with one class they follow its share, smoothed by one row. A sample too
    small for STEPS steps in ``epochs`` rounds takes more of them.
    """
    y = np.asarray(y, dtype=np.int64)
    out = np.zeros((buckets + 1, 1), np.float32)
    if not len(y) or len(set(y.tolist())) < 2:
        out[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return out
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    v2, l2, b2 = np.full(buckets, 1e-8, np.float32), np.full((dim, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    total = [c.sum() for c in n]
    epochs = max(epochs, -(-STEPS // len(y)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(y)):
            a, w = at[i], n[i] / total[i]
            hidden = w @ vectors[a]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = layer @ p
            g = np.outer(hidden, p)
            l2 += g * g
            b2 += p * p
            layer -= step * g / np.sqrt(l2)
            bias -= step * p / np.sqrt(b2)
            v2[a] += w * w * (back @ back)
            vectors[a] -= (step * w / np.sqrt(v2[a]))[:, None] * back
    out[:-1, 0] = vectors @ (layer[:, 1] - layer[:, 0])
    out[-1] = bias[1] - bias[0]
    return out


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learned from at most ``rows`` labelled documents that aren't held out."""
    f = features()
    return learned(sample(docs, labels, target, rows), f, lambda at, n, y: fit(at, n, y, f.buckets))


def score_texts(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """The probability of class 1 for each whole text."""
    sums, number = features().sums(texts, weights[:-1])
    z = sums[:, 0] / np.maximum(number, 1) + weights[-1, 0]
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def classify(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on).

    A null text is empty; empty texts get the score of an empty average. Rows are scored one
    by one, so repeated rows get equal scores and an empty table stays empty. Columns named
    score or predicted are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights)
    got = scored(docs, lambda texts: {"score": score_texts(texts, held.value)}, "score double")
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for labels.quality."""
    docs = table(spark, sf_dir, "documents")
    weights = train(docs, table(spark, sf_dir, "labels"))
    got = classify(docs.select("doc_id", "text"), weights)
    return got.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go.

    A null text is judged as an empty one; rows that repeat a text stay or go together; an empty table
    stays empty. All columns stay as they are, whatever their names, nulls in them too.
    """
    held = spark.sparkContext.broadcast(train(docs, table(spark, sf_dir, "labels")))
    name = unused(docs, "_score")
    got = scored(docs, lambda texts: {name: score_texts(texts, held.value)}, f"{name} double")
    return got.filter(F.col(name) >= THRESHOLD).select(*docs.columns)
