"""Content sort, conversation trie and spelling variants against plain computations."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rankwell.llm import convtrie, exact, spelling

from .helpers import DOCS, clashing, empty_docs, hard_docs, sentence

# ---- exact duplicates


def ascii_lower(text):
    return "".join(c.lower() if c < "\x80" else c for c in text or "")


def check_exact(docs, keep):
    rows = docs.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[ascii_lower(r.text)].append(r.doc_id)
    got = exact.content_sort(docs, keep=keep).collect()
    assert len(got) == len(rows)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    seen = defaultdict(list)
    for r in got:
        ids = groups[sha[r.text_sha256]]
        known = [i for i in ids if i is not None]
        assert r.keep_id == ((max if keep == "largest" else min)(known) if known else None)
        assert r.group_size == len(ids)
        seen[r.text_sha256].append(r.doc_id)
        if r.kept:
            assert r.doc_id == r.keep_id
    assert {k: sorted(v, key=str) for k, v in seen.items()} == {k: sorted(groups[t], key=str) for k, t in sha.items()}
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == Counter(dict.fromkeys(sha, 1))  # one row of each group, also where ids repeat


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_hard_rows(spark, keep):
    check_exact(clashing(hard_docs(spark)), keep)
    more = [(None, "Null id"), (None, "null ID"), (5, "null id"), (5, "NULL ID"), (7, "É"), (8, "é"), (None, "only"), (None, "only"), (1, "\x00"), (2, ""), (3, None)]
    check_exact(spark.createDataFrame(more, "doc_id long, text string"), keep)
    assert exact.content_sort(empty_docs(spark), keep=keep).count() == 0


def test_exact_group_over_many_ranges(spark):
    r = random.Random(1)
    rows = [(i, "The same text " * 3 if i % 3 else sentence(r, 5).title(), None, None, None) for i in range(4000)]
    rows += [(5000 + i, f"THE SAME TEXT the same text the same text {i % 50}", None, None, None) for i in range(500)]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    cuts = exact.splitters(docs, "doc_id", "text")
    assert cuts == sorted(cuts) and len(cuts) > 20
    placed = exact._placed(docs, "doc_id", "text").withColumn("range", exact.range_of(F.col("place"), cuts))
    per = placed.groupBy("range").agg(F.count("*").alias("n"), F.max(F.col("norm") == ascii_lower("The same text " * 3)).alias("hot")).collect()
    assert sum(p.hot for p in per) > 10 and max(p.n for p in per) < 1000
    assert [p.range for p in placed.collect()] == [sum(c <= p.place for c in cuts) for p in placed.collect()]
    check_exact(docs, "largest")
    check_exact(docs, "smallest")


def test_exact_keys_of_letters(spark):
    docs = spark.createDataFrame([("a", "X"), ("b", "x"), (None, "x")], "doc_id string, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact.content_sort(docs).collect()} == {("a", "a", True), ("b", "a", False), (None, "a", False)}


# ---- conversation trie


def trie(convs):
    """By path: what each node of the trie of {conv_id: turns} is."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for p, ids in members.items():
        under = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(p))))
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), kids[p], sum(not kids[q] for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def lists_of(spark, convs):
    # a turnless conversation can only come from rebuilding, so it is made from one that has turns
    rows = [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)] + [(c, None, None, "gone") for c, turns in convs.items() if not turns]
    lists = convtrie.turn_lists(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    empty = [c for c, turns in convs.items() if not turns]
    return lists.withColumn("turns", F.when(F.col("conv_id").isin(empty), F.slice("turns", 1, 0)).otherwise(F.col("turns"))) if empty else lists


def random_convs(r, n, words=("a b", "c", "d\te  f", "")):
    return {c: [(r.choice(["user", "assistant"]), r.choice(words)) for _ in range(r.choice([0, 1, 2, 3, 6]))] for c in r.sample(range(-50, 9 * n), n)}


@pytest.mark.parametrize(("seed", "parts"), [(0, 1), (1, 3), (2, 17), (3, 40)])
def test_trie(spark, monkeypatch, seed, parts):
    monkeypatch.setattr(convtrie, "PIECE", 2)
    r = random.Random(seed)
    convs = random_convs(r, 120)
    for c in range(2000, 2040):  # copies that fill several partitions, and one longer conversation
        convs[c] = [("user", "same"), ("assistant", "again")]
    convs[3000] = [("user", "same"), ("assistant", "again")] + [("user", f"turn {k % 2}") for k in range(200)]
    got = [tuple(x) for x in convtrie.prefix_trie(lists_of(spark, convs), parts).collect()]
    assert sorted(got, key=str) == trie(convs)


def test_trie_wide_nodes_find_their_children(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "WIDE", 5)
    convs = random_convs(random.Random(8), 150, words=[f"w {k}" for k in range(30)])
    assert sorted((tuple(x) for x in convtrie.prefix_trie(lists_of(spark, convs), 5).collect()), key=str) == trie(convs)


def test_trie_rebuilt_hard_rows(spark):
    convs = {
        0: [(1, "user", "hi there"), (2, "assistant", "yes"), (3, "user", None), (4, None, "d")],
        7: [(None, "user", "null turn first"), (1, "assistant", "x")],
        13: [(1, "user", "one only")],
        21: [(1, "user", "leader is absent"), (2, "user", "so its head goes")],
        25: [(1, "user", "gone")],
        40: [(5, "", ""), (5, "", ""), (9, "user", "w " * 5000)],
        41: [(1, "user", "x"), (2, "user", "y"), (3, "user", "z"), (4, "user", "own")],
        -3: [(1, "user", "negative")],
    }
    rows = [(c, k, r, t, "x", "y") for c, turns in convs.items() for k, r, t in turns] + [(None, 1, "user", "of no conversation", "x", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string, head string")
    own = {c: [(r or "", t or "") for _, r, t in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0))] for c, turns in convs.items()}
    built = {}
    for c, turns in own.items():
        h, lead = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(lead, [])[:h] + turns[h:]
    got = [tuple(x) for x in convtrie.prefix_trie(convtrie.with_group_heads(convtrie.turn_lists(df))).collect()]
    assert sorted(got, key=str) == trie(built)
    assert convtrie.prefix_trie(convtrie.with_group_heads(convtrie.turn_lists(df.limit(0)))).count() == 0


# ---- spelling variants


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def groups(rows, slip):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if slip and h % slip == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if distance(v, w) == 1] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def test_letter_values_tell_exchanges_apart():
    letters = [ord(c) ** 5 for c in map(chr, [*range(97, 123), *range(0xC0, 0x100)])]
    assert len({a - b for a in letters for b in letters if a != b}) == len(letters) * (len(letters) - 1)


def test_spelling(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    monkeypatch.setattr(spelling, "PIECE", 40)
    r = random.Random(5)
    stems = ["".join(r.choice("abcdeé") for _ in range(r.randint(6, 8))) for _ in range(12)]
    words = []
    for s in stems:
        i = r.randrange(len(s))
        forms = [s, s[:i] + "x" + s[i:], s[:i] + s[i + 1 :], s[:i] + "ÿ" + s[i + 1 :], s[:i] + "xy" + s[i + 1 :], "".join(sorted(s)), s[1:] + s[0], s[::-1]]
        for k, f in enumerate(forms):
            words += [f] * (5 * 6 ** (3 - k) if k < 4 else 6)
    words += ["listen", "silent"] * 7 + ["Àbcdefg"] * 6 + ["àbcdefg"] * 40 + ["ab×def÷"] * 9 + ["z" * 5000] * 5 + ["z" * 4999] * 30
    r.shuffle(words)
    rows = [(i, r.choice([" ", "9", "_", "Ā", "\n"]).join(w.upper() if w.isascii() and r.random() < 0.3 else w for w in words[i::60])) for i in range(60)]
    rows += [(None, "misspelt words are " * 9), (None, None), (3, ""), (rows[0][0], rows[0][1])]
    docs = clashing(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)).withColumns({"word": F.lit("x"), "n": F.lit(1)}).repartition(5)
    for slip in (0, 7, 199):
        got = sorted((tuple(x) for x in spelling.spelling_groups(docs, slip=slip).collect()), key=str)
        assert got == groups(rows, slip)
        assert any(x[1] and x[2] != x[1] for x in got)  # a chain of forms
    assert spelling.spelling_groups(empty_docs(spark)).count() == 0
    assert spelling.spelling_groups(hard_docs(spark)).count() >= 0
