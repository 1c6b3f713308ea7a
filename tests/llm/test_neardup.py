import random

import numpy as np
import pytest

from rankwell.llm import neardup

from .helpers import DOCS, clashing, empty_docs, hard_docs, sentence


def brute(rows):
    """Class (least doc_id) of each row, by all pairs of texts."""
    texts = sorted({t or "" for _, t in rows})
    sets = neardup.shingle_hashes(texts)
    counters = np.zeros(1 << neardup.COUNTERS_BITS, np.int64)
    for _, t in rows:
        h = sets[texts.index(t or "")][0]
        counters += np.bincount((h >> np.uint64(64 - neardup.COUNTERS_BITS)).astype(np.int64), minlength=len(counters))
    counters = neardup.less_load(counters)
    weights = [dict(zip(h.tolist(), neardup.weights(h, n, counters, len(rows)).tolist(), strict=True)) for h, n in sets]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    sims = {}
    for i in range(len(texts)):
        for j in range(i):
            a, b = weights[i], weights[j]
            both = sum(min(v, b[k]) for k, v in a.items() if k in b)
            if both:
                sims[i, j] = both / (sum(a.values()) + sum(b.values()) - both)
                if sims[i, j] >= neardup.THRESHOLD:
                    up[root(i)] = root(j)
    least = {}
    for k, t in rows:
        r = root(texts.index(t or ""))
        least[r] = min(least.get(r, k), k)
    return [least[root(texts.index(t or ""))] for _, t in rows], sims


def family(r, base, rates):
    out = []
    for rate in rates:
        out.append(" ".join(sentence(r, 1) if r.random() < rate else w for w in base.split()))
    return out


def test_classes_are_brute_force(spark):
    r = random.Random(8)
    texts = [sentence(r, 60) for _ in range(30)]
    big = sentence(r, 150)
    # a large group: some like each other, many like none
    texts += family(r, big, [0.004] * 30 + [0.02] * 40 + [0.06] * 60)
    texts += [big] * 10 + family(r, sentence(r, 90), [0.005] * 10)
    passage = sentence(r, 40)
    texts += [sentence(r, 12) + " " + passage + " " + sentence(r, 12) for _ in range(60)]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], DOCS)
    want, sims = brute(rows)
    got = {x.doc_id: x for x in neardup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    classes = [got[k].class_id for k, _ in rows]
    # nothing is joined that the links don't join, and of the links no more than 2 of 100 are lost
    assert all(len({w for w, c in zip(want, classes, strict=True) if c == x}) == 1 for x in set(classes))
    of = {t: c for (_, t), c in zip(rows, classes, strict=True)}
    ordered = sorted({t for _, t in rows})
    linked = [of[ordered[i]] == of[ordered[j]] for (i, j), s in sims.items() if s >= neardup.THRESHOLD]
    assert sum(linked) >= 0.98 * len(linked) and len(linked) > 200
    assert sum(x.kept for x in got.values()) == len(set(classes))
    for k, c in zip([k for k, _ in rows], classes, strict=True):
        assert got[k].class_size == classes.count(c) and got[k].kept == (k == c)


def test_hard_rows(spark):
    docs = clashing(hard_docs(spark))
    rows = neardup.near_duplicates(docs).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows}
    assert by[2].class_id == by[1].class_id == by[3].class_id == 1 and by[1].kept and not by[2].kept
    assert by[4].class_id == by[5].class_id == 4 and by[8].class_id == 8
    assert neardup.near_duplicates(empty_docs(spark)).count() == 0
    left = neardup.stage(spark, hard_docs(spark), "").collect()
    assert sorted(str(r.doc_id) for r in left) == sorted(map(str, [1, 4, 6, 7, 8, 9, 10, None]))


def test_samples_agree_as_often_as_sets_do():
    r = random.Random(1)
    base = sentence(r, 400)
    counters = np.zeros(1 << neardup.COUNTERS_BITS, np.int64)
    texts = [base, *family(r, base, [0.01, 0.03, 0.06])]
    sets = neardup.shingle_hashes(texts)
    packed = [neardup.pack(h, neardup.levels(h, n, counters, 10)) for h, n in sets]
    code, _ = neardup.draws()
    assert code.shape == (neardup.LEVELS, 1 << 16)
    keys = neardup.band_keys(sets, counters, 10)
    for i in (1, 2, 3):
        s = neardup.similarity(packed[0], packed[i])
        agree = (keys[0] == keys[i]).mean()
        assert abs(agree - s**neardup.ROWS) < 0.3
    assert neardup.similarity(packed[0], packed[0]) == pytest.approx(1)


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, r.randint(101, 140)) for _ in range(30)] + [(7, 7), (200, 201), (203, 201)]
    got = {x.t: x.c for x in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    for a, b in edges:
        for x in (a, b):
            up.setdefault(x, x)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    assert got == {x: root(x) for x in up}


def test_star_is_whole(spark):
    """An original and copies that are like it but not like each other: none that shares a band with it is lost."""
    r = random.Random(5)
    base = sentence(r, 300).split()
    texts = [" ".join(base)]
    for _ in range(1050):
        copy = base[:]
        for k in r.sample(range(300), 5):
            copy[k] = sentence(r, 1) + "x"
        texts.append(" ".join(copy))
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCS)
    counters, n = neardup.document_frequencies(df)
    sets = neardup.shingle_hashes(texts)
    keys = neardup.band_keys(sets, counters, n)
    packed = [neardup.pack(h, neardup.weights(h, c, counters, n)) for h, c in sets]
    like = [k for k in range(1, len(texts)) if (keys[k] == keys[0]).any() and neardup.similarity(packed[0], packed[k]) >= neardup.THRESHOLD]
    assert len(like) > 900
    got = {x.doc_id: x.class_id for x in neardup.near_duplicates(df).collect()}
    assert [k for k in like if got[k] != 0] == []


def test_blocks_settle_all_pairs(spark, monkeypatch):
    """One bucket, small blocks: the parts are those of all pairs."""
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 7)
    r = random.Random(6)
    texts = [t for _ in range(6) for t in family(r, sentence(r, 60), [0, 0.01, 0.02, 0.02, 0.03, 0.03, 0.04, 0.1])]
    sets = neardup.shingle_hashes(texts)
    counters = np.zeros(1 << neardup.COUNTERS_BITS, np.int64)
    packed = [neardup.pack(h, neardup.weights(h, c, counters, 10)) for h, c in sets]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if neardup.similarity(packed[i], packed[j]) >= neardup.THRESHOLD]
    want = {x.t: x.c for x in neardup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    rows = spark.createDataFrame([(1, k) for k in range(len(texts))], "bucket long, t long")
    got = {x.t: x.c for x in neardup.links(rows, spark.createDataFrame(list(enumerate(packed)), "t long, packed binary")).collect()}
    assert {k: c for k, c in got.items()} == want and len(want) > 20


def test_weights_are_not_capped(spark):
    """A line repeated 600 times and 2,500 times: similarity 0.24; 2,500 and 2,600 times: 0.96."""
    r = random.Random(7)
    line, other = sentence(r, 8), sentence(r, 8)
    texts = [" ".join([line] * 600), " ".join([line] * 2500), " ".join([other] * 2500), " ".join([other] * 2600)]
    counters = np.zeros(1 << neardup.COUNTERS_BITS, np.int64)
    packed = [neardup.pack(h, neardup.weights(h, c, counters, 4)) for h, c in neardup.shingle_hashes(texts)]
    assert neardup.similarity(packed[0], packed[1]) == pytest.approx(0.24, abs=0.001)
    assert neardup.similarity(packed[2], packed[3]) == pytest.approx(2500 / 2600, abs=0.001)
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCS)
    assert {x.doc_id: x.class_id for x in neardup.near_duplicates(df).collect()} == {0: 0, 1: 1, 2: 2, 3: 2}
    assert sorted(x.doc_id for x in neardup.stage(spark, df, "").collect()) == [0, 1, 2]


def test_stage_keeps_texts_of_equal_ids(spark):
    """Texts without an id, or with the same, stay where another row is repeated."""
    r = random.Random(9)
    texts = [sentence(r, 40) for _ in range(12)]
    rows = [(None, t) for t in texts[:5]] + [(1, t) for t in texts[5:8]] + [(k, t) for k, t in enumerate(texts[8:], 2)] + [(2, texts[8])]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], DOCS)
    left = neardup.stage(spark, df, "")
    assert left.columns == df.columns
    assert sorted((str(x.doc_id), x.text) for x in left.collect()) == sorted((str(k), t) for k, t in rows[:-1])


def test_draws_above_the_table_go_on():
    code, _ = neardup.draws()
    at = np.arange(0, 1 << 16, 7)
    assert (neardup.coded(np.full(len(at), neardup.LEVELS - 1), at) == code[-1][at]).all()
    assert (neardup.coded(np.full(len(at), neardup.LEVELS + 40), at) < code[-1][at]).mean() > 0.5
