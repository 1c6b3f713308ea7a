"""Language identification by hierarchical discrimination.

A first model predicts the family of a text's language; within the family, one-versus-one
linear support vector machines separate the related languages, and the language that wins
the most duels is the answer. All models are linear in hashed character n-grams and words,
trained by stochastic subgradient steps on the hinge loss (Shalev-Shwartz et al., 2007).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .labelled import held_out, learned, sample, scored
from .subwords import Subwords

#: Most documents with a known language that the models learn from.
TRAIN_ROWS = 4000
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")

#: Families of languages by code; what isn't listed is a family of its own kind, "other".
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "is", "lb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
}


def family_of(lang: str) -> str:
    code = re.split(r"[-_]", lang.lower())[0]
    return next((f for f, codes in FAMILIES.items() if code in codes), "other")


def features() -> Subwords:
    return Subwords(bits=15, ns=(1, 2, 3), words=True, lower=True)


def svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, buckets: int, epochs: int = 5, decay: float = 1e-4, seed: int = 11) -> np.ndarray:
    """The weights of a linear machine without bias; y is 1 or -1, rows have the length 1.

    Classes weigh alike, however often they occur. The answer is the average of the weights
    over the steps of the last epoch.
    """
    w, mean = np.zeros(buckets), np.zeros(buckets)
    scale, t, taken = 1.0, 0, 0
    rng = np.random.default_rng(seed)
    heavy = {s: len(y) / (2 * max(1, int((y == s).sum()))) for s in (1, -1)}
    for epoch in range(epochs):
        for i in rng.permutation(len(y)):
            t += 1
            step = 1 / (decay * (t + 1000))
            at, x = rows[i]
            margin = y[i] * scale * (w[at] @ x)
            scale *= 1 - step * decay
            if margin < 1:
                w[at] += (step * heavy[int(y[i])] * y[i] / scale) * x
            if epoch == epochs - 1 and t % 16 == 0:
                mean += scale * w
                taken += 1
    return mean / max(taken, 1) if taken else scale * w


@dataclass
class Model:
    """Weights of all machines in columns, and what each column decides."""

    families: list[str] = field(default_factory=list)
    langs: dict[str, list[str]] = field(default_factory=dict)
    duels: list[tuple[str, str, str]] = field(default_factory=list)
    weights: np.ndarray | None = None
    steep: float = 1.0


def fit(at: list[np.ndarray], n: list[np.ndarray], langs: list[str], buckets: int) -> Model:
    model = Model()
    unit = [(a, c / np.sqrt(c @ c)) for a, c in zip(at, n, strict=True)]
    fams = np.array([family_of(x) for x in langs])
    of = np.array(langs, dtype=object)
    model.families = sorted(set(fams.tolist()))
    model.langs = {f: sorted(set(of[fams == f].tolist())) for f in model.families}
    columns = []
    if len(model.families) > 1:
        columns += [svm(unit, np.where(fams == f, 1, -1), buckets) for f in model.families]
    for f in model.families:
        for a, b in combinations(model.langs[f], 2):
            some = np.flatnonzero((of == a) | (of == b))
            columns.append(svm([unit[i] for i in some], np.where(of[some] == a, 1, -1), buckets))
            model.duels.append((f, a, b))
    model.weights = np.stack(columns, 1).astype(np.float32) if columns else np.zeros((buckets, 0), np.float32)
    if len(n):
        # sums over features per feature -> margins of rows of length 1
        model.steep = float(np.median([c.sum() / np.sqrt(c @ c) for c in n]))
    return model


def predict(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    """The language of each whole text and a score from 0 to 1."""
    out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    some = [i for i, t in enumerate(texts) if LETTER.search(t)]
    if not some or not model.families:
        return out, score
    sums, number = features().sums([texts[i] for i in some], model.weights)
    margins = sums / np.maximum(number, 1)[:, None] * model.steep
    k = len(model.families) if len(model.families) > 1 else 0
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(2 * z, -50, 50)))
    for row, i in enumerate(some):
        if k:
            z = margins[row, :k]
            e = np.exp(2 * (z - z.max()))
            best = int(z.argmax())
            family, sure = model.families[best], float(e[best] / e.sum())
        else:
            family, sure = model.families[0], 1.0
        names = model.langs[family]
        wins = dict.fromkeys(names, 0.0)
        for j, (f, a, b) in enumerate(model.duels):
            if f == family:
                p = float(logistic(margins[row, k + j]))
                wins[a] += (p >= 0.5) + p / 1000
                wins[b] += (p < 0.5) + (1 - p) / 1000
        out[i] = max(names, key=lambda x: wins[x])
        duels = max(1, len(names) - 1)
        score[i] = min(1.0, sure * (wins[out[i]] / (duels * 1.001) if len(names) > 1 else 1.0))
    return out, score


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learned from at most ``rows`` documents with a language that aren't held out."""
    f = features()
    return learned(sample(docs, docs, "lang", rows), f, lambda at, n, y: fit(at, n, y, f.buckets))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score.

    ``und`` with score 0 where the text is null, empty or without a letter, or where nothing
    could be learned. Equal texts get equal answers; an empty table stays empty; columns
    named lang_pred or score are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list[str]) -> dict:
        langs, sure = predict(texts, held.value)
        return {"lang_pred": langs, "score": sure}

    return scored(docs, score, "lang_pred string, score double")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    docs = table(spark, sf_dir, "documents")
    got = identify(docs.select("doc_id", "text"), train(docs))
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
