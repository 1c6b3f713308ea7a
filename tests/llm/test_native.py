import hashlib
import math
import re
import zlib

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from rankwell.llm import chat, decontaminate, mixing, sharding

from .helpers import clashing, empty_docs, hard_docs, sentence


def jump(key: int, shards: int) -> int:
    def draw(j: int) -> float:
        seed = xxhash.xxh64(key.to_bytes(8, "little", signed=True), seed=42).intdigest()
        h = xxhash.xxh64(j.to_bytes(8, "little"), seed=seed).intdigest()
        return (float(1 << 31)) / ((h >> 33) + 1)

    b, j = 0, 0
    while j < shards:
        b, j = j, math.floor((j + 1) * draw(j))
    return b


def test_jump_hash_is_brute_force(spark):
    from pyspark.sql import functions as F

    for shards in (1, 2, 8, 9, 60):
        got = spark.range(300).select("id", sharding.jump_hash(F.col("id"), shards).alias("s")).collect()
        assert [r.s for r in got] == [jump(r.id, shards) for r in got]


def test_place(spark):
    docs = clashing(hard_docs(spark))
    rows = sharding.place(docs).collect()
    assert len(rows) == 12
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in rows:
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.place(empty_docs(spark)).count() == 0


def test_few_rows_move(spark):
    from pyspark.sql import functions as F

    got = spark.range(20000).select(sharding.jump_hash(F.col("id"), 8).alias("a"), sharding.jump_hash(F.col("id"), 9).alias("b")).collect()
    moved = [r for r in got if r.a != r.b]
    assert all(r.b == 8 for r in moved) and 0.09 < len(moved) / 20000 < 0.13


HARD = ["", "plain", "\\### Assistant: </turn> ok", "</turn>\n### user: x</turn>\n", "\\t\\h\\b\\c", "a\\", "###", "</turn", "\n", "level 2\n", "role: x", "😀</turn>", "\\\\</turn>\\"]


def run_chat(spark, convs):
    rows = [(i, k, r, t) for i, c in enumerate(convs) for k, (r, t) in enumerate(c)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_chats(clashing(df)).collect()}
    digests = {r.conv_id: r for r in chat.digest(chat.format_chats(df)).collect()}
    for i, c in enumerate(convs):
        want = [(r or "", t or "") for r, t in c]
        assert [(t.role, t.text) for t in got[i].parsed] == want, (c, got[i].formatted)
        d = digests[i]
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()
        loss = "".join(t for r, t in want if r == "assistant")
        assert d.loss_chars == len(loss) and d.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert d.n_turns == len(want) and d.formatted_chars == len(got[i].formatted)


def test_chat_round_trip(spark):
    convs = [[("user", a), ("assistant", b)] for a in HARD for b in HARD] + [[("we: ird", "x"), (None, None)], [("a\\c", "</turn>")]]
    run_chat(spark, convs)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("\\#/<>turn: hbtc\n", max_size=6), st.text("\\#/<>turn: hbtc\n", max_size=14)), min_size=1, max_size=3), min_size=1, max_size=40))
def test_chat_any_text(spark, convs):
    run_chat(spark, convs)


def test_mix(spark):
    docs = clashing(hard_docs(spark))
    rows = mixing.mix(docs).collect()
    assert len(rows) == 12
    assert all(r.taken == r.size * r.copies and 0 <= r.copies <= 3 for r in rows)
    assert mixing.mix(empty_docs(spark)).count() == 0
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, rows), key=str)


def level(caps, weights, total):
    left, out = set(range(len(caps))), [0.0] * len(caps)
    while left:
        share = total / sum(weights[i] for i in left)
        over = [i for i in left if share * weights[i] > caps[i]]
        if not over:
            for i in left:
                out[i] = share * weights[i]
            return out
        for i in over:
            out[i] = caps[i]
            total -= caps[i]
            left.remove(i)
    return out


def test_targets_are_brute_force(spark):
    import random

    r = random.Random(1)
    for n in (1, 2, 5, 30):
        sizes = {f"s{i:02d}": r.choice([0, 1, 10, 100, 5000]) for i in range(n)}
        got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = level([3 * v for v in sizes.values()], [1 + i % 3 for i in range(n)], sum(sizes.values()))
        for s, w in zip(sizes, want, strict=True):
            assert got[s] == pytest.approx(w)


def plain_multiplier(sizes, target, mean, cap=3.0):
    """lam by halving, from plain sums."""
    z = [(1 + s / (s + mean)) / 2 for s in sizes]
    lo, hi = -200.0, 200.0
    for _ in range(300):
        lam = (lo + hi) / 2
        lo, hi = (lo, lam) if sum(s * min(cap, math.exp(lam * x)) for s, x in zip(sizes, z, strict=True)) > target else (lam, hi)
    return lam


def test_rates_solve_the_dual(spark):
    """Rates against a plain solution, sources that shrink, grow, reach their caps, and a null one."""
    import random

    r = random.Random(17)
    docs = {}
    for s, n in (("a", 200), ("b", 3), ("c", 40), (None, 25), ("e", 1)):
        docs[s] = [r.choice([0, 1, 5, 30, 300, 4000]) + 1 for _ in range(n)] + [0]
    rows = [(s, size, docs[s].count(size), sum(docs[s])) for s in docs for size in sorted(set(docs[s]))]
    for share in (0.02, 0.4, 1.0, 1.7, 2.999, 3.0):
        hist = spark.createDataFrame([(*x, share * x[3]) for x in rows], "source string, size long, n long, source_size long, target double")
        got = {(x.source, x.size): x.rate for x in mixing.balance(hist).collect()}
        for s, sizes in docs.items():
            total, mean = sum(sizes), sum(sizes) / len(sizes)
            met = sum(k * got[s, k] for k in sizes)
            assert met == pytest.approx(share * total, rel=1e-6)
            if share < 3:
                lam = plain_multiplier([k for k in sizes if k], share * total, mean)
                for k in set(sizes):
                    z = (1 + k / (k + mean)) / 2 if k else 0.5
                    assert got[s, k] == pytest.approx(min(3, math.exp(lam * z)), rel=1e-5)


def test_mix_stage_carries_all_columns(spark):
    docs = clashing(hard_docs(spark)).drop("lang")
    left = mixing.stage(spark, docs, "")
    assert left.columns == docs.columns
    known = {tuple(x) for x in docs.collect()}
    assert {tuple(x) for x in left.collect()} <= known


def test_decontaminate_stage_on_hard_rows(spark, tmp_path):
    items = spark.createDataFrame([(1, "Ünïcödé ß 😀 ñ"), (2, None), (3, "")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = clashing(hard_docs(spark))
    left = decontaminate.stage(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted(str(x.doc_id) for x in left.collect()) == sorted(str(x.doc_id) for x in docs.collect() if x.doc_id != 9)


def test_shard_stage_on_hard_rows(spark):
    docs = clashing(hard_docs(spark))
    got = sharding.stage(spark, docs, "").collect()
    assert len(got) == 12 and all(0 <= x.shard < 8 for x in got) and len({x.shard for x in got if x.doc_id == 9}) == 1


def test_mix_meets_targets(spark, sf):
    rows = mixing.op7_mixing(spark, sf).collect()
    by = {}
    for r in rows:
        t = by.setdefault((r.source_size, r.target), [0, 10**9])
        t[0] += r.taken
        t[1] = min(t[1], r.size or 10**9)
    for (_, target), (taken, least) in by.items():
        # ten documents a source here; copies are whole, so half the least one is in reach at best
        assert abs(taken - target) <= max(0.05 * target, 2 * least)


def windows_brute(docs, items, width=10):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    wins = {}
    for i, t in items:
        w = fold(t)
        for s in range(max(len(w) - width + 1, 1) if w else 0):
            wins.setdefault(tuple(w[s : s + width]), set()).add(str(i))
    for k, t in docs:
        w = fold(t)
        hit, ids = set(), set()
        for win, its in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    ids |= its
        out.setdefault(k, []).append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontaminate_is_brute_force(spark):
    import random

    r = random.Random(5)
    vocabulary = ["the", "of", "Über", "überfall", "É", "é", "x1", "Rare", "and", "s"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice([1, 3, 9, 10, 14]))) for i in range(12)] + [(12, None), (13, ""), (14, "the"), (14, "!!")]
    docs = [(i, text(r.randint(0, 60)) + " " + (r.choice(items)[1] or "")) for i in range(60)] + [(60, None), (61, ""), (61, ""), (62, items[4][1])]
    d = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for x in decontaminate.decontaminate(d, b).collect():
        got.setdefault(x.doc_id, []).append((x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated))
    want = windows_brute(docs, items)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_decontaminate_in_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(decontaminate, "BLOCK", 7)
    r = random.Random(6)
    items = [(i, sentence(r, 14)) for i in range(6)]
    docs = [(i, sentence(r, 20) + " " + items[i % 6][1] if i % 2 else sentence(r, 30)) for i in range(20)]
    got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {k: v[0] for k, v in windows_brute(docs, items).items()}


def test_decontaminate_hard(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.decontaminate(hard_docs(spark), none).collect()
    assert len(rows) == 12 and not any(r.contaminated for r in rows)
    assert decontaminate.decontaminate(empty_docs(spark), none).count() == 0
