import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwell.llm import html_pages, html_text, language, quality, simhash, subwords, toxicity
from rankwell.llm.subwords import Subwords
from rankwell.llm.trees import boost

from .helpers import clashing, empty_docs, hard_docs, sentence


def test_subwords_do_not_depend_on_the_batch():
    f = Subwords(bits=12, pairs=True, times=3)
    texts = ["a bc bc d", "", "😀 x", "word " * 50, "\n"]
    w = np.random.default_rng(0).normal(size=(1 << 12, 2)).astype(np.float32)
    all_, n = f.sums(texts, w)
    for i, t in enumerate(texts):
        one, k = f.sums([t], w)
        at, c = f.counts(t)
        assert np.allclose(all_[i], one[0]) and n[i] == k[0] == c.sum()
        assert np.allclose(one[0], c @ w[at], atol=1e-4)


def test_pieces_add_up_to_the_whole(monkeypatch):
    r = random.Random(12)
    f = Subwords(bits=14, pairs=True, times=2)
    texts = [sentence(r, n) for n in (1, 3, 40, 400)] + ["x" * 900, "  a b  c " * 120, "w " * 70 + "y" * 300 + " z" * 60, "\0 é " * 200]
    w = np.random.default_rng(2).normal(size=(1 << 14, 2)).astype(np.float32)
    whole = [f.counts(t) for t in texts]
    sums, n = f.sums(texts, w)
    monkeypatch.setattr(subwords, "PIECE", 40)
    assert len(subwords.pieces(texts[3])) > 20 and len(subwords.pieces(texts[4])) == 1
    for t, (at, c) in zip(texts, whole, strict=True):
        got = f.counts(t)
        assert (got[0] == at).all() and (got[1] == c).all()
    parts, m = f.sums(texts, w)
    assert np.allclose(parts, sums) and (m == n).all()


def plain_fit(at, n, y, buckets, dim, epochs, rate, seed=7):
    """The steps of ``quality.fit`` number by number."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32).astype(float).tolist()
    layer, bias = [[0.0, 0.0] for _ in range(dim)], [0.0, 0.0]
    v2, l2, b2 = [1e-8] * buckets, [[1e-8, 1e-8] for _ in range(dim)], [1e-8, 1e-8]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(y)).tolist():
            share = [c / sum(n[i]) for c in n[i]]
            hidden = [sum(w * vectors[a][d] for a, w in zip(at[i], share, strict=True)) for d in range(dim)]
            z = [sum(hidden[d] * layer[d][k] for d in range(dim)) + bias[k] for k in (0, 1)]
            e = [math.exp(x - max(z)) for x in z]
            p = [x / sum(e) - (k == y[i]) for k, x in enumerate(e)]
            back = [sum(layer[d][k] * p[k] for k in (0, 1)) for d in range(dim)]
            for k in (0, 1):
                b2[k] += p[k] ** 2
                for d in range(dim):
                    l2[d][k] += (hidden[d] * p[k]) ** 2
                    layer[d][k] -= step * hidden[d] * p[k] / math.sqrt(l2[d][k])
                bias[k] -= step * p[k] / math.sqrt(b2[k])
            for a, w in zip(at[i], share, strict=True):
                v2[a] += w * w * sum(x * x for x in back)
                for d in range(dim):
                    vectors[a][d] -= step * w / math.sqrt(v2[a]) * back[d]
    return [sum(v[d] * (layer[d][1] - layer[d][0]) for d in range(dim)) for v in vectors] + [bias[1] - bias[0]]


def test_quality_fit_is_the_plain_one(monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 1)
    r = random.Random(3)
    at = [np.array(sorted(r.sample(range(20), r.randint(1, 6))), np.int32) for _ in range(14)]
    n = [np.array([r.randint(1, 4) for _ in a], np.float32) for a in at]
    y = [int(3 in a or 7 in a) for a in at]
    assert 0 < sum(y) < 14
    got = quality.fit(at, n, y, 20, dim=3, epochs=4)
    assert np.allclose(got[:, 0], plain_fit([a.tolist() for a in at], [c.tolist() for c in n], y, 20, 3, 4, quality.RATE), atol=2e-3)


def test_quality_scores_are_averages(spark):
    """The score of each text from the counts of its features, one by one."""
    f = quality.features()
    w = np.random.default_rng(4).normal(size=(f.buckets + 1, 1)).astype(np.float32)
    rows = hard_docs(spark).collect()
    got = {(x.doc_id, x.text): x.score for x in quality.classify(hard_docs(spark), w).collect()}
    for x in rows:
        at, c = f.counts(x.text or "")
        z = sum(float(w[a, 0]) * k for a, k in zip(at, c.tolist(), strict=True)) / c.sum() + float(w[-1, 0])
        assert got[x.doc_id, x.text] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def plain_svm(rows, y, buckets, epochs=5, decay=1e-4, seed=11):
    """The steps of ``language.svm``, weights held as they are."""
    w, mean, t, taken = [0.0] * buckets, [0.0] * buckets, 0, 0
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        for i in rng.permutation(len(y)).tolist():
            t += 1
            step = 1 / (decay * (t + 1000))
            margin = y[i] * sum(w[a] * x for a, x in zip(*rows[i], strict=True))
            w = [v * (1 - step * decay) for v in w]
            if margin < 1:
                for a, x in zip(*rows[i], strict=True):
                    w[a] += step * len(y) / (2 * sum(v == y[i] for v in y)) * y[i] * x
            if epoch == epochs - 1 and t % 16 == 0:
                mean = [m + v for m, v in zip(mean, w, strict=True)]
                taken += 1
    return [m / taken for m in mean] if taken else w


def test_language_machines_are_the_plain_ones():
    r = random.Random(6)
    at = [np.array(sorted(r.sample(range(15), 4)), np.int32) for _ in range(30)]
    rows = [(a, np.full(4, 0.5)) for a in at]
    y = np.array([1 if 2 in a or 5 in a else -1 for a in at])
    assert np.allclose(language.svm(rows, y, 15), plain_svm([(a.tolist(), x.tolist()) for a, x in rows], y.tolist(), 15), rtol=1e-6)


def test_language_duels_are_counted():
    """Family by the largest margin, then the language of the most duels, from plain sums."""
    texts = {"en": "the cat and the dog with this one", "de": "der hund und die katze mit dem", "nl": "de kat en het hond met een", "fr": "le chat et la chienne avec", "es": "el gato y la perra con los"}
    f = language.features()
    got = [(f.counts(t), k) for k, t in texts.items() for _ in range(4)]
    model = language.fit([a for (a, _), _ in got], [c for (_, c), _ in got], [k for _, k in got], f.buckets)
    assert model.families == ["germanic", "romance"] and len(model.duels) == 3 + 1
    for t in [*texts.values(), "the hund et la", "zz", "le hond con the"]:
        at, c = f.counts(t)
        margin = [sum(float(model.weights[a, j]) * k for a, k in zip(at, c.tolist(), strict=True)) for j in range(model.weights.shape[1])]
        family = model.families[int(margin[1] > margin[0])]
        wins = dict.fromkeys(model.langs[family], 0)
        for j, (fam, a, b) in enumerate(model.duels):
            if fam == family:
                wins[a if margin[2 + j] >= 0 else b] += 1
        pred, score = language.predict([t], model)
        assert wins[pred[0]] == max(wins.values()) and 0 <= score[0] <= 1
    assert language.predict(list(texts.values()), model)[0] == list(texts)


def test_word_hashes_are_those_of_the_words():
    h, owner = Subwords(lower=True).word_hashes(["the cat", "", "cat The dog"])
    assert owner.tolist() == [0, 0, 2, 2, 2] and h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 3


@pytest.fixture(scope="module")
def tables(spark, sf):
    return {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "pages")}


def held_out_accuracy(got, labels, target, threshold):
    both = got.join(labels, "doc_id").filter("held_out").select("score", F.col(target).alias("y")).collect()
    assert both
    return sum((r.score >= threshold) == bool(r.y) for r in both) / len(both)


def test_quality_held_out(spark, sf, tables):
    got = quality.op8_quality(spark, sf)
    assert got.count() == tables["documents"].count()
    assert held_out_accuracy(got, tables["labels"], "quality", 0.3) >= 0.85


def test_toxicity_held_out(spark, sf, tables):
    got = toxicity.op5_toxicity(spark, sf)
    assert got.count() == tables["documents"].count()
    assert held_out_accuracy(got, tables["labels"], "toxic", 0.5) >= 0.85


def test_language_held_out(spark, sf, tables):
    got = language.op10_language(spark, sf).join(tables["documents"].select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.95


def test_hard_rows_are_scored(spark, tables):
    docs = clashing(hard_docs(spark))
    w = quality.train(tables["documents"], tables["labels"])
    rows = quality.classify(docs, w).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    m = language.train(tables["documents"])
    rows = {r.doc_id: r for r in language.identify(docs, m).collect()}
    assert [rows[k].lang_pred for k in (4, 5, 6)] == ["und"] * 3 and rows[9].lang_pred != "und"
    t = toxicity.train(tables["documents"], tables["labels"])
    rows = toxicity.score_toxicity(docs, t).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    for f, x in ((quality.classify, w), (language.identify, m), (toxicity.score_toxicity, t)):
        assert f(empty_docs(spark), x).count() == 0


def test_nothing_to_learn_from(spark):
    docs = empty_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = hard_docs(spark)
    assert {r.score for r in quality.classify(rows, quality.train(docs, none)).collect()} == {0.5}
    assert {r.lang_pred for r in language.identify(rows, language.train(docs)).collect()} == {"und"}
    assert {r.n_matches for r in toxicity.score_toxicity(rows, toxicity.train(docs, none)).collect()} == {0}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_brute_force():
    r = random.Random(9)
    words, stems = ["idiot", "scum", "worthless", "moron", "pathetic", "aabbaabbaab"], ["lowei", "vequ"]
    auto = toxicity.Automaton(words, stems)

    def brute(w):
        if w in words:
            return 0
        if any(w.startswith(s) for s in stems):
            return 1
        return 2 if any(edits(w, x) <= toxicity.reach(x) for x in words) else -1

    tried = [*words, *stems, "", "oron", "idio", "loweix", "veqv"]
    for x in words * 60:
        y = list(x)
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(y) + 1)
            k = r.random()
            y[i : i + (k < 0.7)] = "" if k < 0.3 else r.choice("abdehilmoprstw")
        tried.append("".join(y))
    tried += ["".join(r.choice("abimort") for _ in range(r.randint(1, 8))) for _ in range(500)]
    assert [auto.kind(w) for w in tried] == [brute(w) for w in tried]


def test_windows():
    """Quotation by marks that belong together, else report, else address, else plain."""
    reader = toxicity.Model(words=["idiot"]).reader()
    window = lambda t: [toxicity.WINDOWS[w] for _, _, w in reader.matches(t)]
    assert window('He wrote: "what an idiot" in the letter') == ["quoted"]
    assert window('"good" idiot "bad"') == ["plain"]
    assert window("„Du idiot“, «idiot» und »idiot« “idiot”") == ["quoted"] * 4
    assert window('a " mark\nidiot " here') == ["plain"]
    assert window("She called him an idiot yesterday") == ["reported"]
    assert window("you are an idiot and so on") == ["said to someone"]
    assert window("an idjot, idiiot") == ["plain"] * 2 and reader.matches("an idjot")[0][1] == 2


def test_toxic_scores_are_brute_force(spark):
    """Score from kinds by edit distance and windows told apart by hand."""
    model = toxicity.Model(words=["idiot", "scum"], stems=["vequ"], clean=frozenset(["idot"]))
    texts = {"an idiot, a vequor and an idiqt": [(0, 0), (1, 0), (2, 0)], 'the "idiot" you know, scum': [(0, 1), (0, 3)], "idot scam scums": [], "she said vequ, idiot": [(1, 2), (0, 2)], "": [], "idiot " * 50: [(0, 0)] * 50}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for x in toxicity.score_toxicity(df, model).collect():
        found = texts[x.text]
        z = toxicity.BIAS
        for k in range(3):
            for w in range(4):
                z += toxicity.BY_KIND[k] * toxicity.BY_WINDOW[w] * math.log2(1 + sum(f == (k, w) for f in found))
        assert x.n_matches == len(found) and x.score == pytest.approx(1 / (1 + math.exp(-z))) and x.predicted == int(x.score >= 0.5)


def test_lexicon_keeps_all_that_is_significant():
    """A rare term that separates perfectly isn't pushed out by any number of frequent, weaker ones."""
    weak = [(f"zz{i:05}word", False, 900, 20) for i in range(3000)]
    words, _ = toxicity.lexicon([*weak, ("rareterm", False, 40, 0), ("chance", False, 3, 0)], 1000, 9000, 200_000)
    assert words == sorted(["rareterm", *(t for t, *_ in weak)])


def test_copies_are_found():
    """Classes of a sample against all pairs; links are found through the first text of a band."""
    r = random.Random(8)
    texts = []
    for _ in range(12):
        base = sentence(r, 90).split()
        for k in range(r.randint(1, 6)):
            w = base[:]
            for _ in range(k // 2):
                w[r.randrange(90)] = sentence(r, 1)
            texts.append(" ".join(w))
    texts += ["", "", "two words", "two words", "three words here"]
    r.shuffle(texts)
    sets = [toxicity.shingles(t) for t in texts]
    plain = [{" ".join(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t else set() for t in texts]
    of = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(plain[i] & plain[j])
            if both >= 0.8 * len(plain[i] | plain[j]):
                a, b = max(of[i], of[j]), min(of[i], of[j])
                of = [b if x == a else x for x in of]
    assert toxicity.copies(sets) == of and len(set(of)) < len(texts)


def test_weights_are_the_least_loss():
    """No step of any weight lowers the loss, also where Newton's whole steps would overshoot."""
    rng = np.random.default_rng(5)
    k = len(toxicity.PRIOR)
    x = np.concatenate([np.ones((3000, 1)), np.log2(1 + rng.poisson(0.02, (3000, k - 1)) * rng.integers(1, 200, (3000, k - 1)))], 1)
    y = ((x[:, 1] + x[:, 5] > 0) & (rng.random(3000) < 0.9)).astype(float)
    w = toxicity.fit(x, y)
    loss = lambda v: np.logaddexp(0, x @ v).sum() - y @ (x @ v) + toxicity.PRIOR_ROWS / 2 * ((v - toxicity.PRIOR) ** 2).sum()
    for j in range(k):
        for d in (-1e-3, 1e-3):
            assert loss(w + d * np.eye(k)[j]) > loss(w) - 1e-7
    assert w[0] < -1 and ((x @ w > 0) == (y > 0)).mean() > 0.9


def test_copies_and_passages_are_no_lexicon(spark):
    """Words of a toxic text with many copies, and of a passage that toxic texts share, stay out; words
    that are used come in; words whose misspellings are words of the language are matched as they are."""
    r = random.Random(31)
    copied, passage = sentence(r, 150), sentence(r, 12)
    rows, toxic = [], []
    for i in range(500):
        bad = i % 5 == 0
        w = sentence(r, 60).split()
        if i % 25 == 0:
            w = copied.split()
            w[r.randrange(150)] = sentence(r, 1)
        elif bad:
            for x in ("blockhead", "graunstein", *([passage] if i % 2 else [])):
                w.insert(r.randrange(len(w)), x)
        elif i % 3 == 0:
            w.insert(5, r.choice(["graunsteyn", "gramnstein"]))
        rows.append((i, " ".join(w)))
        toxic.append((i, 1 if bad else 0))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(toxic, "doc_id long, toxic int")
    m = toxicity.train(docs, labels)
    assert {"blockhead", "graunstein"} <= set(m.words) and m.exact == {"graunstein"}
    assert not (set(copied.split()) | set(passage.split())) & set(m.words) and not [s for s in m.stems if not "blockhead".startswith(s) and not "graunstein".startswith(s)]
    said = toxicity.contexts([t for i, t in rows if i % 5 == 0], [("blockhead", False), (passage.split()[5], False), ("bloc", True)])
    assert said["blockhead", False] > 50 and said["bloc", True] >= said["blockhead", False] and said[passage.split()[5], False] <= 3
    kinds = [m.reader().matches(t) for t in ("a blockhed here", "a graunsteyn here", "a graunstein here")]
    assert [k and k[0][1] for k in kinds] in ([2, [], 0], [1, [], 0], [1, [], 1], [2, [], 1])


def test_automaton_starts_anew(monkeypatch):
    monkeypatch.setattr(toxicity.Automaton, "STATES", 5)
    auto, same = toxicity.Automaton(["idiot", "worthless"], []), [0, 2, -1, 2, 0]
    for _ in range(3):
        assert [auto.kind(w) for w in ("idiot", "idjot", "riots", "worthles", "worthless")] == same
        assert len(auto.states) < 60


def test_fingerprints(spark):
    r = random.Random(2)
    texts = ["", "  ", "one", *[sentence(r, 80) for _ in range(6)]]
    got = simhash.fingerprints(texts)
    assert got[0] == got[1] == 0 and len(set(got[2:].tolist())) == 7
    assert simhash.fingerprints([texts[3]])[0] == got[3]
    near = simhash.fingerprints([texts[4] + " word"])
    assert simhash.likeness(near, got[4:5])[0] > 0.85 > simhash.likeness(got[4:5], got[5:6])[0]


def test_votes_are_counted_bit_by_bit(monkeypatch):
    """The fingerprint from plain loops over terms and bits, in one slice and in many."""
    r = random.Random(21)
    text = sentence(r, 300) + " " + sentence(r, 5) * 3
    words = Subwords(lower=True).word_hashes([text])[0].tolist()
    whole = (1 << 64) - 1
    votes = [0.0] * 64

    def vote(term, weight):
        for b in range(64):
            votes[b] += weight if term >> b & 1 else -weight

    for term, n in Counter(words).items():
        vote(term, simhash.WORD_WEIGHT * (1 + math.log(n)))
    pairs = Counter()
    for a, b in zip(words, words[1:], strict=False):
        h = ((a * 0x9E3779B97F4A7C15 & whole) ^ b) * 0x94D049BB133111EB & whole
        pairs[h ^ (h >> 31)] += 1
    for term, n in pairs.items():
        vote(term, 1 + math.log(n))
    # bytes in memory order, bits of a byte from its highest
    want = sum((votes[b] > 0) << b for b in range(64))
    got = int(simhash.fingerprints([text])[0])
    assert got == want
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert int(simhash.fingerprints([text])[0]) == want


def test_edited_texts_are_brute_force(spark):
    docs = clashing(hard_docs(spark).filter("doc_id IS NOT NULL AND NOT (doc_id = 9)"))
    rows = simhash.fingerprint_edits(docs, task_bytes=2000).collect()
    order = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    assert len(rows) == len(order)
    by = {r.doc_id: r for r in rows}
    import hashlib

    for i, (k, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        new = simhash.edited(t, after)
        assert by[k].n_chars == len(t) and by[k].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        a, b, c = simhash.fingerprints([t, new, after])
        assert by[k].fingerprint == f"{a:016x}" and by[k].edited_fingerprint == f"{b:016x}"
        assert by[k].near_edited == pytest.approx(1 - bin(int(a ^ b)).count("1") / 64) and by[k].near_next == pytest.approx(1 - bin(int(a ^ c)).count("1") / 64)
    assert simhash.fingerprint_edits(empty_docs(spark)).count() == 0
    assert simhash.fingerprint_edits(hard_docs(spark)).count() == 12


def test_search_is_brute_force(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = base + [b ^ sum(1 << x for x in r.sample(range(64), k)) for b in base for k in (1, 3, 4)] + [0, 0, (1 << 64) - 1]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(signed)] + [(999, None)], "id long, fingerprint long")
    for radius in (0, 3):
        got = sorted((x.query, x.fingerprint, x.distance, x.n) for x in simhash.search(clashing(df.filter("id % 5 = 0").withColumnRenamed("fingerprint", "f")).drop("fingerprint").withColumnRenamed("f", "fingerprint"), df, radius).collect())
        want = {(q, x, d, signed.count(x)) for i, q in enumerate(signed) if i % 5 == 0 for x in signed if (d := bin((q ^ x) & ((1 << 64) - 1)).count("1")) <= radius}
        assert got == sorted(want)


def test_neighbours_are_brute_force(spark):
    r = random.Random(14)
    base = [r.getrandbits(64) for _ in range(6)]
    fps = [b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(20)] + [0] * 5
    df = spark.createDataFrame([(i, f"{x:016x}") for i, x in enumerate(fps)] + [(None, f"{base[0]:016x}")], "doc_id long, fingerprint string")
    got = {x.doc_id: x.n_near for x in simhash.with_neighbours(df, 3, 5).collect()}
    assert len(got) == len(fps) + 1 and got[None] is None
    for i, x in enumerate(fps):
        assert got[i] == (sum(bin(x ^ y).count("1") <= 3 for y in [*fps, base[0]]) if i % 5 == 0 else None)


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    m = boost(x[:1500], y[:1500], trees=30, depth=3)
    assert ((m.logit(x[1500:]) > 0) == y[1500:]).mean() > 0.97


def test_unseen_layouts():
    trees = html_text.model()
    same = 0
    for h in html_pages.pages(60, seed=77):
        d = html_text.parse(h)
        mark = np.zeros(len(d.tag), int)
        for i in range(1, len(d.tag)):
            mark[i] = int(d.truth[i]) if d.truth[i] else mark[d.parent[i]]
        same += html_text.render(d, html_text.decode(d, trees.logit(html_text.node_features(d)))) == html_text.render(d, mark == 1)
    assert same >= 54


def test_no_element_is_kept_below_a_dropped_one():
    trees = html_text.model()
    for h in html_pages.pages(20, seed=5150):
        d = html_text.parse(h)
        rng = np.random.default_rng(1)
        z = trees.logit(html_text.node_features(d)) + rng.normal(0, 4, len(d.tag))
        state = html_text.states(d, z)
        for i in range(1, len(d.tag)):
            above = state[d.parent[i]]
            assert state[i] == 0 if above == 0 else above == 2 or state[i] in (0, 1)


def test_pages(spark, tables):
    import html as h
    import re

    rows = html_text.extract_pages(clashing(tables["pages"].withColumn("text", F.lit("x")))).collect()
    raw = {r.page_id: r.html for r in tables["pages"].collect()}
    for r in rows:
        inner = raw[r.page_id].split("<article>")[1].split("</article>")[0]
        parts = re.sub("<br>", " ", re.sub("</?b>", "", re.sub(r"</?(?:p|h1)>", "\0", inner))).split("\0")
        assert r.text == "\n\n".join(x for x in (" ".join(h.unescape(p).split()) for p in parts) if x) and r.n_chars == len(r.text)


def test_broken_pages(spark):
    rows = [(1, None), (2, ""), (3, "no tags at all"), (4, "<p>open <b>tags"), (5, "</div></p>&amp;&#x41;&bogus;"), (6, "<div>" * 3000 + "deep" + "</div>" * 10), (7, "<script>x<p>y"), (8, "<article><p>a\u00a0 b &lt;i&gt;</p><p></p>tail</article>"), (8, "x")]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, html string")).collect()
    assert len(got) == 9 and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert next(r.text for r in got if r.page_id == 7) == ""
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_misspelled_words_of_a_learned_stem():
    """A stem that wins by inflections leaves its words their misspellings."""
    terms = [("idiot", False, 60, 0), ("idiots", False, 20, 0), ("idiotic", False, 20, 0), ("idiot", True, 100, 0), ("idio", True, 100, 0), ("scumbag", False, 50, 0)]
    words, stems = toxicity.lexicon(terms, 200, 2000)
    assert stems and "idiot".startswith(stems[0])
    auto = toxicity.Automaton(words, stems)
    assert auto.kind("idiot") == auto.kind("idiotically") == 1
    assert auto.kind("1diot") == auto.kind("1diots") == auto.kind("idjotic") == 2
    assert auto.kind("scumbag") == 0 and auto.kind("scumbg") == 2 and auto.kind("riot") == -1


def test_pages_without_end_of_head(tables):
    """</head> may be left out, before <body>, before other elements and before text."""
    pages = [r.html for r in tables["pages"].filter("html LIKE '%</head>%'").orderBy("page_id").limit(20).collect()]
    trees = html_text.model()
    want = html_text.extract(pages, trees)
    assert all(want)
    assert html_text.extract([p.replace("</head>", "") for p in pages], trees) == want
    for page in ("<head><title>t</title><p>One <b>two</b>.", "<head><title>t</title>One <b>two</b>.", "<html><head><meta charset=x>\n<style>p {}</style><noscript>n</noscript><body>One <b>two</b>.", "<head><script>x</script><title>t</title></head> <body><p>One <b>two</b>."):
        dom = html_text.parse(page)
        assert html_text.render(dom, np.ones(len(dom.tag), bool)) == "One two."


def test_math_is_text():
    dom = html_text.parse("<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p>")
    assert html_text.render(dom, np.ones(len(dom.tag), bool)) == "So x=1 holds."


#: Pages by hand, of layouts unlike those the trees learn from: (page, paragraphs of the article).
LAYOUTS = [
    # a weblog
    """<!doctype html><html lang=en><head><title>Blog</title><link rel=x href=y></head><body class="home blog"><div id="wrap"><div id="masthead"><a href="/">My blog</a><p>Just another site</p></div>
    <ul id="menu-primary"><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul><div class="hentry post-12"><h2 class="entry-title">On rivers</h2><div class="entry-content"><p>The river runs slowly in the summer, and the boats wait.</p>
    <p>In winter it is faster. Nobody rows then, of course.</p></div></div><div id="comments"><h3>2 responses</h3><ol class="commentlist"><li class="comment"><p>Nice post, thanks for it!</p></li><li class="comment"><p>I disagree with this.</p></li></ol></div>
    <div class="widget-area sidebar"><h4>Archives</h4><ul><li><a href=1>May</a></li><li><a href=2>June</a></li></ul></div><div id="colophon" class="site-footer">Proudly powered by software</div></div></body></html>""",
    # laid out as a table
    """<html><body><table width=100%><tr><td colspan=2><a href=a>One</a> | <a href=b>Two</a> | <a href=c>Three</a> | <a href=d>Four</a></td></tr><tr><td class="sidebar"><ul><li><a href=e>Link five</a><li><a href=f>Link six</a><li><a href=g>Link seven</a></ul></td>
    <td class="content"><h1>On mills</h1><p>The mill stands at the edge of the village, and its wheel has not turned for years.</p><p>Once it ground the flour of five farms. Then the road came, and the bread with it.</p></td></tr><tr><td colspan=2 class="footer">© 2011 The village. All rights reserved.</td></tr></table></body></html>""",
    # end tags left out
    """<title>t</title><nav><ul><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>Contact</a></ul></nav><main><h1>On bread</h1><p>Flour, water, salt and time are all it takes.<p>Some add yeast, which takes less time. Some add seeds.<ul><li>Rye bread keeps for long, a week or more.<li>Wheat bread doesn't keep at all.</ul></main><footer><p>Imprint and contact</footer>""",
    # news, with an advert inside the article and notices before it
    """<html><head><style>p{}</style></head><body><div class="cookie-banner"><p>We use cookies. By going on you agree to them.</p><button>Agree</button></div><header><h1>The Daily</h1><nav><a href=1>World</a><a href=2>Sport</a><a href=3>Money</a></nav></header>
    <main><article><h1>Bridge opens</h1><p>The bridge over the strait was opened on Monday, two years late.</p><div class="advert"><p>Buy two tyres, get one free! Only today.</p></div><p>Ferries stop in May. The harbour will be a park, said the mayor.</p></article><aside class="related"><h3>Read more</h3><ul><li><a href=4>Tunnel closes</a></li><li><a href=5>Port grows</a></li></ul></aside></main>
    <footer><p>Contact | Imprint | Terms</p></footer></body></html>""",
    # documentation
    """<body><div class="topnav"><a href=a>Docs</a> <a href=b>Download</a></div><div class="sidebar"><ul><li><a href=c>Install</a></li><li><a href=d>Configure</a></li><li><a href=e>Run</a></li></ul></div><div class="content"><h1>Install</h1><p>Unpack the archive, and put the folder where you like.</p><pre>tar xf pack.tar</pre><p>Then set the path to it. That is all there is to do.</p></div><div class="footer">Built with a generator.</div></body>""",
    # sections and definition lists
    """<html><body><section class="story"><h2>Words</h2><dl><dt>Ebb<dd>The fall of the tide, which takes about six hours.<dt>Flood<dd>Its rise, which takes as long as the ebb does.</dl></section><section class="newsletter"><p>Get our letter every week.</p><form><label>Mail</label><input name=m><button>Send</button></form></section></body></html>""",
    # plain text and a fragment
    "The ferry leaves at six. It is never late, and it is never full.",
    "<p>The ferry leaves at six.</p><p>It is never late, and it is never full.</p>",
    # drawings, formulas and a template
    """<body><nav><svg class=logo viewBox="0 0 1 1"/><a href=1>Home</a><a href=2>Shop</a></nav><article><h1>On circles</h1><p>A circle of radius <math><mi>r</mi></math> is all points of one distance, which is <b>r</b>.</p><svg><title>no</title><path d="M0"/></svg><p>Its area grows with the square, as everyone knows.</p></article><template><p>not here</p></template></body>""",
    # comments below an article, as articles
    """<body><article class="post"><h1>On snow</h1><p>Snow fell in the night, and the paths were gone by morning.</p><p>We dug until noon. Then it snowed again, of course.</p></article><section class="comments"><article class="comment"><p>We had none at all, sadly.</p></article><article class="comment"><p>Send some over, please!</p></article></section></body>""",
]
WANTED = [
    "On rivers\n\nThe river runs slowly in the summer, and the boats wait.\n\nIn winter it is faster. Nobody rows then, of course.",
    "On mills\n\nThe mill stands at the edge of the village, and its wheel has not turned for years.\n\nOnce it ground the flour of five farms. Then the road came, and the bread with it.",
    "On bread\n\nFlour, water, salt and time are all it takes.\n\nSome add yeast, which takes less time. Some add seeds.\n\nRye bread keeps for long, a week or more.\n\nWheat bread doesn't keep at all.",
    "Bridge opens\n\nThe bridge over the strait was opened on Monday, two years late.\n\nFerries stop in May. The harbour will be a park, said the mayor.",
    "Install\n\nUnpack the archive, and put the folder where you like.\n\ntar xf pack.tar\n\nThen set the path to it. That is all there is to do.",
    "Words\n\nEbb\n\nThe fall of the tide, which takes about six hours.\n\nFlood\n\nIts rise, which takes as long as the ebb does.",
    "The ferry leaves at six. It is never late, and it is never full.",
    "The ferry leaves at six.\n\nIt is never late, and it is never full.",
    "On circles\n\nA circle of radius r is all points of one distance, which is r.\n\nIts area grows with the square, as everyone knows.",
    "On snow\n\nSnow fell in the night, and the paths were gone by morning.\n\nWe dug until noon. Then it snowed again, of course.",
]


def test_layouts_by_hand():
    """Blocks found of all blocks of the articles, and blocks found that aren't theirs."""
    trees = html_text.model()
    found = wrong = wanted = 0
    for got, want in zip(html_text.extract(LAYOUTS, trees), WANTED, strict=True):
        a, b = Counter(got.split("\n\n")), Counter(want.split("\n\n"))
        found, wrong, wanted = found + (a & b).total(), wrong + (a - b).total(), wanted + b.total()
    print(f"blocks found {found} of {wanted}, {wrong} that are not of an article")
    assert found >= 0.9 * wanted and wrong <= 0.1 * wanted


def consistent(dom):
    """All choices for the elements of a page: dropped with all below, kept with parts dropped, or mixed with free children."""
    n = len(dom.tag)
    out = [[2]]
    for i in range(1, n):
        above = dom.parent[i]
        out = [[*c, s] for c in out for s in ((0,) if c[above] == 0 else (0, 1) if c[above] == 1 else (0, 1, 2))]
    return out


def test_the_decoding_is_the_best_consistent_choice():
    r = np.random.default_rng(4)
    shapes = ["<p>a b c</p>", "<div>x<p>a</p><p>b c d e f</p></div>", "<div><ul><li>a</li><li>b b b b</li></ul>c c</div>", "<section><div><p>a a</p>b</div><p>c</p></section>", "<div>a<div>b<div>c<div>d</div></div></div></div>"]
    for html in shapes:
        dom = html_text.parse(html)
        n = len(dom.tag)
        assert n <= 8
        own = np.zeros(n)
        for i, _, data in dom.texts:
            own[i] += len(data.split())
        for _ in range(40):
            logit = r.normal(scale=2.5, size=n)
            score = np.clip(logit, -6, 6) * (0.3 + np.log1p(own))

            def worth(choice, score=score):
                # the root is mixed and has no text of its own that counts
                return sum((-score[i], score[i], -html_text.MIXED + (abs(score[i]) - 1 if own[i] else 0))[s] for i, s in enumerate(choice) if i)

            got = html_text.states(dom, logit)
            assert list(got) in consistent(dom)
            assert worth(got) == pytest.approx(max(map(worth, consistent(dom))))


def test_boosting_is_the_plain_loop():
    """Each tree against a loop over all splits of each node."""
    r = np.random.default_rng(6)
    x = np.round(r.normal(size=(300, 4)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.2).astype(float)
    made = boost(x, y, trees=4, depth=2, rate=0.3, bins=8, ridge=1.0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 9)[1:-1])) for j in range(4)]
    z = np.full(len(y), made.base)
    for t in range(4):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        score = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1.0)  # noqa: B023, E731

        def grow(rows, node, t=t, g=g, h=h, score=score):
            inner = 3
            if node >= inner:
                leaf = -0.3 * g[rows].sum() / (h[rows].sum() + 1.0)
                assert made.leaf[t, node - inner] == pytest.approx(leaf, abs=1e-9)
                z[rows] += leaf
                return
            best = 0.0
            for j in range(4):
                for c in cuts[j]:
                    a, b = rows & (x[:, j] <= c), rows & (x[:, j] > c)
                    if h[a].sum() >= 0.5 and h[b].sum() >= 0.5:
                        best = max(best, score(a) + score(b) - score(rows))
            j, c = made.feature[t, node], made.cut[t, node]
            a, b = rows & (x[:, j] <= c), rows & (x[:, j] > c)
            gain = score(a) + score(b) - score(rows) if np.isfinite(c) else 0.0
            assert gain == pytest.approx(best, abs=1e-6)
            grow(a, 2 * node + 1)
            grow(b, 2 * node + 2)

        grow(np.ones(len(y), bool), 0)


#: (page, blocks of the article): short pages, comments under other names, headlines in headers, tables of a cell, other languages.
MORE = [
    ("<body><div class='top'><a href=/>Home</a></div><p>The bridge is closed.</p><h3>Related</h3><ul><li><a href=1>One thing</a></li><li><a href=2>Another thing</a></li></ul></body>", ["The bridge is closed."]),
    ("<body><article><h1>On rivers</h1><p>The river runs slowly in the summer, and the boats wait for rain.</p><p>In winter it is faster. Nobody rows then, of course.</p></article><div class=x9><div class=x10><b>Ann</b><p>Nice post, thanks for it!</p></div><div class=x10><b>Bob</b><p>I disagree with this, really.</p></div></div></body>", ["On rivers", "The river runs slowly in the summer, and the boats wait for rain.", "In winter it is faster. Nobody rows then, of course."]),
    ("<body><nav><a href=/>Home</a></nav><article><header><h1>On rivers</h1></header><p>The river runs slowly in the summer, and the boats wait for rain.</p></article><footer>Imprint</footer></body>", ["On rivers", "The river runs slowly in the summer, and the boats wait for rain."]),
    ("<body><article><h1>On rivers</h1><table><tr><td>Length 120 km</td></tr></table><p>The river runs slowly in the summer, and the boats wait for rain.</p></article></body>", ["On rivers", "Length 120 km", "The river runs slowly in the summer, and the boats wait for rain."]),
    ("<body><div id=kopf><a href=/>Start</a> <a href=/b>Orte</a> <a href=/c>Wege</a></div><div id=inhalt><h1>Der Fluss</h1><p>Im Sommer ist er langsam, und die Boote warten auf Regen.</p><p>Im Winter ist er schnell. Dann rudert niemand.</p></div><div id=fuss><a href=/i>Impressum</a> <a href=/d>Datenschutz</a></div></body>", ["Der Fluss", "Im Sommer ist er langsam, und die Boote warten auf Regen.", "Im Winter ist er schnell. Dann rudert niemand."]),
    ("<body><ul class=menu-principal><li><a href=1>Inicio</a></li><li><a href=2>Libros</a></li><li><a href=3>Autores</a></li></ul><section class=contenido><h2>El molino</h2><p>El molino está al borde del pueblo, y su rueda no gira desde hace años.</p></section><div class=pie><p>© 2020 El pueblo</p></div></body>", ["El molino", "El molino está al borde del pueblo, y su rueda no gira desde hace años."]),
    ("<body><div><div><div><p>It rained all night, and the cellar was full of water by the morning.</p><p>We pumped until noon. It was of no use.</p></div></div></div></body>", ["It rained all night, and the cellar was full of water by the morning.", "We pumped until noon. It was of no use."]),
    ("<body><main><h1>Opening hours</h1><p>We open at nine.</p></main><footer><a href=1>Contact</a> <a href=2>Terms</a></footer></body>", ["Opening hours", "We open at nine."]),
    ("<body><header><a href=/>The Daily</a></header><main><article><p>A short note: the ferry doesn't sail today.</p></article></main><section id=comments><h3>3 comments</h3><div><span>Cy</span><p>Thanks for telling us.</p></div><div><span>Di</span><p>When will it sail again?</p></div></section></body>", ["A short note: the ferry doesn't sail today."]),
    ("<body><form action=/s><label>Search</label><input name=q></form><div class=post><h2>Bread</h2><ol><li>Mix flour and water, and let the dough rest for an hour.</li><li>Fold it four times, once every half an hour.</li><li>Bake it hot, until it sounds hollow.</li></ol></div></body>", ["Bread", "Mix flour and water, and let the dough rest for an hour.", "Fold it four times, once every half an hour.", "Bake it hot, until it sounds hollow."]),
    ("<body><div class=cookie-notice><p>We use cookies.</p></div><p>The shop is shut.</p></body>", ["The shop is shut."]),
    ("<body><nav><a href=1>One</a></nav><footer><p>Imprint</p></footer></body>", []),
]


def test_more_layouts_by_hand():
    trees = html_text.model()
    found = wrong = wanted = 0
    for (page, want), got in zip(MORE, html_text.extract([p for p, _ in MORE], trees), strict=True):
        a, b = Counter(x for x in got.split("\n\n") if x), Counter(want)
        assert bool(got) == bool(want)
        found, wrong, wanted = found + (a & b).total(), wrong + (a - b).total(), wanted + b.total()
    print(f"blocks found {found} of {wanted}, {wrong} that are not of an article")
    assert found >= 0.9 * wanted and wrong <= 0.1 * wanted
