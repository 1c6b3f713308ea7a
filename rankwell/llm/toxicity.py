"""Toxicity: a lexicon trie intersected with Levenshtein automata, and scores by context.

The lexicon is learned from labelled rows, near copies counted once: words, and stems that
words begin with, that toxic documents hold, in as many contexts, significantly more often
than others (log likelihood ratio, Dunning 1993). A word whose misspellings clean documents
hold as well is matched as it is. Words are read by the intersection of the lexicon's trie with the Levenshtein
automata of its entries, determinized as it is used: a state is the set of trie nodes that
the letters read so far may stand for, each with the edits that this takes. Stems take no
edits; the words below them do, which are read where the stem isn't. So one walk over
a word's letters finds the entries within reach, and most words die after a few letters.

A match counts by its kind (word, stem, misspelling) and by its window of words around: it is
quoted (between two marks that belong together), reported (a word of reporting before it),
said to someone (a word of address near it) or plain. Each kind in each window has a weight of
its own in a logistic function, learned from the labelled rows and drawn to what is given in
PRIOR, where quotation and report count less than abuse that is said to someone.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .labelled import held_out, sample, scored

#: Most labelled rows that lexicon and weights are learned from.
TRAIN_ROWS = 8000
STEM_CHARS = (4, 5, 6, 7)
WINDOW = 5
MARK = "^"  # no letter and no digit, so in no word
WORDS = r"[^\p{L}\p{N}]+"
WORD = re.compile(r"[^\W_]+")
KINDS = ("word", "stem", "misspelled")
WINDOWS = ("plain", "quoted", "reported", "said to someone")
#: Weights before any row is seen: bias, then each kind in each window; and how many rows it takes to move them.
BIAS, BY_KIND, BY_WINDOW = -3.0, (4.0, 4.0, 3.5), (1.0, 0.25, 0.5, 1.25)
PRIOR, PRIOR_ROWS = np.array([BIAS, *(k * w for k in BY_KIND for w in BY_WINDOW)]), 4.0
#: Marks that open and close a quotation, within a line.
QUOTATION = re.compile(r'"[^"\n]*"|“[^“”\n]*”|„[^„“”\n]*[“”]|«[^«»\n]*»|»[^«»\n]*«|‹[^‹›\n]*›|‘[^‘’\n]*’')
#: Words of reporting and of address; English, German, French, Spanish.
REPORTS = frozenset("said says called calls wrote writes quoted word sagte nannte schrieb wort dit appelle mot dijo llamó escribió palabra".split())
ADDRESSES = frozenset("you your du dich dein sie tu toi vous votre usted eres tú".split())


def reach(entry: str) -> int:
    """The edits that a misspelling of an entry may have."""
    return 0 if len(entry) < 5 else 1 if len(entry) < 9 else 2


class Automaton:
    """The intersection, as a deterministic automaton that grows as words are read; it starts
    anew when it has STATES states."""

    STATES = 200_000

    def __init__(self, words: list[str], stems: list[str], exact: frozenset[str] = frozenset()):
        self.entry: dict[int, str] = {}  # the word that ends at a node
        self.kids: list[dict[str, int]] = [{}]
        self.most = [0]  # the edits that any entry below a node allows
        self.word: list[int] = [-1]  # edits allowed if an entry ends here
        self.stem = [False]
        for entry, is_stem in [*((w, False) for w in words), *((s, True) for s in stems)]:
            node, k = 0, 0 if is_stem or entry in exact else reach(entry)
            self.most[0] = max(self.most[0], k)
            for ch in entry:
                if ch not in self.kids[node]:
                    self.kids[node][ch] = len(self.kids)
                    self.kids.append({})
                    self.most.append(0)
                    self.word.append(-1)
                    self.stem.append(False)
                node = self.kids[node][ch]
                self.most[node] = max(self.most[node], k)
            if is_stem:
                self.stem[node] = True
            else:
                self.word[node], self.entry[node] = k, entry
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.steps: list[dict[str, int]] = []
        self.start = self._state(self._skip({0: 0}))

    def _skip(self, at: dict[int, int]) -> dict[int, int]:
        """Entries' letters that the word leaves out."""
        todo = list(at.items())
        while todo:
            node, e = todo.pop()
            for kid in self.kids[node].values():
                if e + 1 <= self.most[kid] and at.get(kid, 99) > e + 1:
                    at[kid] = e + 1
                    todo.append((kid, e + 1))
        return at

    def _state(self, at: dict[int, int]) -> int:
        key = tuple(sorted(at.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return self.ids[key]

    def _step(self, state: int, ch: str) -> int:
        to: dict[int, int] = {}
        for node, e in self.states[state]:
            if e + 1 <= self.most[node] and to.get(node, 99) > e + 1:
                to[node] = e + 1  # a letter too many
            for c, kid in self.kids[node].items():
                cost = e + (c != ch)
                if cost <= self.most[kid] and to.get(kid, 99) > cost:
                    to[kid] = cost
        return self._state(self._skip(to)) if to else -1

    def near(self, word: str) -> list[str]:
        """The entries that a word may be a misspelling of."""
        state = self.start
        for ch in word:
            state = self.steps[state][ch] if ch in self.steps[state] else self._step(state, ch)
            if state < 0:
                return []
        return [self.entry[n] for n, e in self.states[state] if 0 < e <= self.word[n]]

    def kind(self, word: str) -> int:
        """0: a word of the lexicon, 1: begins with a stem, 2: a misspelling, -1: none."""
        if len(self.states) >= self.STATES:
            self._forget()
        state = self.start
        for ch in word:
            to = self.steps[state].get(ch)
            if to is None:
                to = self.steps[state][ch] = self._step(state, ch)
                if to >= 0 and any(e == 0 and self.stem[n] for n, e in self.states[to]):
                    to = self.steps[state][ch] = -2
            if to < 0:
                return 1 if to == -2 else -1
            state = to
        found = -1
        for node, e in self.states[state]:
            if e <= self.word[node]:
                if e == 0:
                    return 0
                found = 2
        return found


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    #: Words whose misspellings documents without toxicity hold as often: matched as they are.
    exact: frozenset[str] = frozenset()
    #: Words within reach of an entry that documents without toxicity hold.
    clean: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """Reads texts; remembers the kinds of words, as many as ROOM."""

    ROOM = 400_000

    def __init__(self, model: Model):
        self.model, self.automaton, self.known = model, Automaton(model.words, model.stems, model.exact), {}

    def kind(self, word: str) -> int:
        k = self.known.get(word)
        if k is None:
            if len(self.known) >= self.ROOM:
                self.known.clear()
            k = self.automaton.kind(word)
            k = self.known[word] = -1 if k == 2 and word in self.model.clean else k
        return k

    def matches(self, text: str) -> list[tuple[str, int, int]]:
        """(word, kind, window) of each match, numbers of KINDS and WINDOWS."""
        low = text.lower()
        kind = self.kind
        hits = {w for w in set(WORD.findall(low)) if kind(w) >= 0}
        if not hits:
            return []
        out = []
        spans = list(WORD.finditer(low))
        quoted = np.array([q.span() for q in QUOTATION.finditer(low)], np.int64).reshape(-1, 2)
        for i, m in enumerate(spans):
            w = m.group()
            if w not in hits:
                continue
            before, after = spans[max(0, i - WINDOW) : i], spans[i + 1 : i + 1 + WINDOW]
            at = np.searchsorted(quoted[:, 0], m.start(), side="right") - 1
            if at >= 0 and m.end() <= quoted[at, 1]:
                window = 1
            elif any(b.group() in REPORTS for b in before):
                window = 2
            else:
                window = 3 if any(x.group() in ADDRESSES for x in (*before, *after)) else 0
            out.append((w, kind(w), window))
        return out


def evidence(matches: list[tuple[str, int, int]]) -> np.ndarray:
    """A one, and for each kind in each window log2(1 + matches)."""
    sums = np.zeros((len(KINDS), len(WINDOWS)))
    for _, k, window in matches:
        sums[k, window] += 1
    return np.concatenate([[1.0], np.log2(1 + sums).ravel()])


def lexicon(terms: list[tuple[str, bool, int, int]], n1: int, n0: int, tested: int = 0) -> tuple[list[str], list[str]]:
    """Words and stems from (term, is a stem, toxic documents, other documents with it): all that are
    significant, as one of ``tested`` terms (as many as there are, if not given).

    Words below a stem stay, for their misspellings: a stem is matched as it is.
    """
    held = max(1, tested, len(terms))

    def ratio(a: int, b: int) -> float:
        n, total = n1 + n0, 0.0
        for x, e in ((a, n1 * (a + b) / n), (b, n0 * (a + b) / n), (n1 - a, n1 * (n - a - b) / n), (n0 - b, n0 * (n - a - b) / n)):
            total += 2 * x * math.log(x / e) if x and e else 0
        return total

    good = {}
    for term, stem, a, b in terms:
        if a / max(n1, 1) >= 20 * (b + 0.2) / max(n0 + 1, 1) and ratio(a, b) > 2 * math.log(held) + 2:
            good[term, stem] = a
    words = sorted(t for t, stem in good if not stem)
    stems: list[str] = []
    for (t, stem), a in sorted(good.items(), key=lambda x: (len(x[0][0]), x[0])):
        if not stem or any(t.startswith(s) for s in stems):
            continue
        # a longer entry that says the same is better
        if any(x != t and x.startswith(t) and len(x) <= len(t) + (1 if s else 99) and b >= 0.95 * a for (x, s), b in good.items()):
            continue
        stems.append(t)
    return words, sorted(stems)


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton's method, drawn to PRIOR; steps that don't lower the loss are halved."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + PRIOR_ROWS / 2 * ((w - PRIOR) ** 2).sum())

    w = PRIOR.copy()
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (p - y) + PRIOR_ROWS * (w - PRIOR)
        h = (x * (p * (1 - p))[:, None]).T @ x + PRIOR_ROWS * np.eye(len(w))
        step = np.linalg.solve(h, g)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        now = loss(w)
        if np.abs(step).max() < 1e-9:
            break
    return w


def said_terms(text: str) -> set[str]:
    """The words of three letters or more of a text, and with a mark before them the stems that they begin with."""
    words = {w for w in WORD.findall(text.lower()) if len(w) > 2}
    return words | {MARK + w[:k] for w in words for k in STEM_CHARS if len(w) > k}


def contexts(texts: Iterable[str], terms: list[tuple[str, bool]]) -> dict[tuple[str, bool], int]:
    """For each term (and whether it is a stem), how many different pairs of words it follows, or
    precedes if that are fewer.

    A word of a passage that many texts share has the same words on one side at least in all of
    them, so it counts once; a word that is used counts about as often as it is used.
    """
    words, stems = {t for t, stem in terms if not stem}, {t for t, stem in terms if stem}
    sides: dict[tuple[str, bool], tuple[set[str], set[str]]] = {}
    for text in texts:
        said = WORD.findall(text.lower())
        for i, w in enumerate(said):
            own = [(w, False)] * (w in words) + [(w[:k], True) for k in STEM_CHARS if len(w) > k and w[:k] in stems]
            for term in own:
                before, after = sides.setdefault(term, (set(), set()))
                before.add(" ".join(said[max(0, i - 2) : i]))
                after.add(" ".join(said[i + 1 : i + 3]))
    return {term: min(len(before), len(after)) for term, (before, after) in sides.items()}


def exact_only(got: list[dict], automaton: Automaton, n1: int, n0: int) -> frozenset[str]:
    """The words of the lexicon whose misspellings two or more documents without toxicity hold, and
    toxic ones not 20 times as often: what is near them are words of the language."""
    hits: tuple[dict[str, int], dict[str, int]] = ({}, {})
    near: dict[str, list[str]] = {}
    for r in got:
        said = {w for w, k, _ in r["m"] if k == 2}
        for w in said - near.keys():
            near[w] = automaton.near(w)
        for entry in {e for w in said for e in near[w]}:
            hits[r["y"]][entry] = hits[r["y"]].get(entry, 0) + 1
    return frozenset(e for e, b in hits[0].items() if b > 1 and hits[1].get(e, 0) * n0 < 20 * b * n1)


SHINGLE, LIKE = 5, 0.8
#: Bands of three draws: of two texts of similarity 0.8, one in a million pairs shares none.
BANDS, DRAWS = 20, 3
_ODD = np.random.default_rng(11).integers(1, 1 << 63, size=(2, BANDS * DRAWS), dtype=np.uint64) | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """The distinct hashes of the runs of five words of a text (of fewer, if it has no five)."""
    words = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in text.lower().split()], np.uint64)
    if not len(words):
        return words
    n = min(SHINGLE, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ words[k : len(words) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def copies(sets: list[np.ndarray]) -> list[int]:
    """The class of each set of shingles, as the number of its first member: sets that share a band of least
    draws with one that came before, and LIKE of all their shingles."""
    of = list(range(len(sets)))

    def root(i: int) -> int:
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    seen: dict[tuple[int, bytes], int] = {}
    for i, s in enumerate(sets):
        least = np.full(BANDS * DRAWS, np.iinfo(np.uint64).max, np.uint64)
        for lo in range(0, len(s), 1 << 14):
            least = np.minimum(least, (s[None, lo : lo + (1 << 14)] * _ODD[0][:, None] + _ODD[1][:, None]).min(axis=1))
        for k, band in enumerate(least.reshape(BANDS, DRAWS)):
            j = seen.setdefault((k, band.tobytes()), i)
            if root(i) != root(j):
                both = len(np.intersect1d(s, sets[j], assume_unique=True))
                if both >= LIKE * (len(s) + len(sets[j]) - both):
                    of[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(sets))]


def once(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The (text, y) of a sample without near copies: of each class the first text stays, with the label that
    most of the class have (ties: 1).

    All words of a text that was copied a dozen times would seem to be bound to its label.
    """
    classes: dict[int, list[int]] = {}
    for i, c in enumerate(copies([shingles(t) for t, _ in rows])):
        classes.setdefault(c, []).append(rows[i][1])
    return [(rows[c][0], int(2 * sum(ys) >= len(ys))) for c, ys in classes.items()]


def learn(rows: list[tuple[str, int]]) -> Model:
    """Lexicon and weights from the (text, y) of a bounded sample; every significant term is in the lexicon."""
    some = once(rows)
    n1 = sum(y for _, y in some)
    n0 = len(some) - n1
    if not n1 or not n0:
        return Model()
    tally: tuple[Counter, Counter] = (Counter(), Counter())
    for text, y in some:
        tally[y].update(said_terms(text))
    often = [(t, tally[1][t], tally[0][t]) for t in sorted(tally[0].keys() | tally[1].keys()) if tally[0][t] + tally[1][t] >= 3]
    bound = [(t.removeprefix(MARK), t.startswith(MARK), a, b) for t, a, b in often if a >= 3 and a * n0 >= b * 20 * n1]
    places = contexts((t for t, y in some if y), [(t, stem) for t, stem, _, _ in bound])
    model = Model()
    model.words, model.stems = lexicon([(t, stem, min(a, places.get((t, stem), 0)), b) for t, stem, a, b in bound], n1, n0, len(often))

    reader = model.reader()
    got = [{"y": y, "m": reader.matches(text)} for text, y in some]
    model.exact = exact_only(got, Automaton(model.words, model.stems), n1, n0)
    automaton = Automaton(model.words, model.stems, model.exact)
    for r in got:  # what is no match any more goes
        r["m"] = [m for m in r["m"] if m[1] != 2 or automaton.kind(m[0]) == 2]
    model.clean = frozenset(w for r in got if not r["y"] for w, k, _ in r["m"] if k == 2)
    x = np.array([evidence([m for m in r["m"] if not (m[1] == 2 and m[0] in model.clean)]) for r in got])
    model.weights = fit(x, np.array([r["y"] for r in got], float))
    return model


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Lexicon and weights from at most ``rows`` labelled documents that aren't held out, near copies
    counted once. They are learned in one task, which gets the sample; only the model comes to the driver."""
    some = sample(docs, labels, target, rows).select("doc_id", "text", (F.col("y") > 0).cast("int").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "y")), strict=True)]
        got.sort(key=lambda row: row[0])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn([(t, y) for _, t, y in got]))], pa.binary())], names=["model"])

    made = some.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else Model()


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 from ``threshold`` on) and n_matches.

    Null and empty texts have no matches and so the score of the bias. Where nothing could
    be learned, there is no lexicon and every text has that score. Repeated rows get equal
    scores; an empty table stays empty; columns of the names made here are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    readers: list[Reader] = []  # one in each worker

    def score(texts: list[str]) -> dict:
        model = held.value
        if not readers:
            readers.append(model.reader())
        reader = readers[0]
        got = [reader.matches(t) for t in texts]
        z = np.array([evidence(g) @ model.weights for g in got])
        return {"score": 1 / (1 + np.exp(-np.clip(z, -50, 50))), "n_matches": [len(g) for g in got]}

    got = scored(docs, score, "score double, n_matches int")
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for labels.toxic."""
    docs = table(spark, sf_dir, "documents")
    got = score_toxicity(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_matches")
