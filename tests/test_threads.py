"""Messages one by one: the batch fold, the stream and a plain loop give the same."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rankwell.streaming import fold, threads

T0 = dt.datetime(2024, 1, 1)
MESSAGES = "mailbox string, arrived_at timestamp, message_id string, thread_id string, application_id long, strategy string, conclusive boolean, reply_type string, confidence double, received_at timestamp"
FILE = "mailbox string, application_id long, thread_id string, status string, evidence_at timestamp"
ON_FILE = [("a", 1, None, "sent", None), ("a", 2, "t9", "interview", T0 + dt.timedelta(hours=2)), ("a", 3, "t9", "sent", None), ("b", 4, None, "withdrawn", None)]


def mail(seed, n=160):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        at = T0 + dt.timedelta(minutes=r.randint(0, 600)) if r.random() < 0.95 else None
        app = r.choice([None, 1, 2, 3, 4, 5, 6])
        rows.append((r.choice("ab"), at, f"m{i:03}", r.choice(["", "t1", "t2", "t3", "t4", "t9", None]), app, app and r.choice(["domain", "body"]), app and r.random() < 0.7, r.choice(["rejection", "interview", "no_reply"]), r.random(), at))
    return rows


def loop(rows):
    """What comes of the messages, by message; the state of each application."""
    found, states = {}, {(b, a): dict(fold.start(), status=s, evidence_at=at) for b, a, _, s, at in ON_FILE}
    owner = {}
    for b, a, t, _, _ in ON_FILE:
        if t:
            owner[b, t] = min(a, owner.get((b, t), a))
    has = {(b, a) for b, a, t, _, _ in ON_FILE if t}
    for b, _, m, t, a, strategy, sure, kind, conf, at in sorted(rows, key=lambda r: (r[9] is not None, r[9] or T0, r[2])):
        taught = False
        if t and (b, t) in owner:
            a, strategy, sure = owner[b, t], "thread", True
        elif a and sure and t and (b, a) not in has:
            owner[b, t], taught = a, True
            has.add((b, a))
        if a:
            states[b, a] = fold.transition(states.get((b, a), fold.start()), at, kind, conf, sure)
        found[m] = (a, strategy, bool(sure), taught)
    return found, {k: v for k, v in states.items() if v["n_messages"]}


def streamed(spark, tmp_path, batches):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = []
    try:
        for part in batches:
            spark.createDataFrame(part, MESSAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema(MESSAGES).parquet(str(tmp_path / "in"))
            stream = threads.replies_stream(source, spark.createDataFrame(ON_FILE, FILE), patience=5 * 3600.0)
            query = stream.writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            query.awaitTermination(300)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return out


@pytest.mark.parametrize("shuffled", [False, True])
def test_stream_is_the_loop(spark, tmp_path, shuffled):
    rows = mail(3)
    rows.sort(key=lambda r: (r[9] is not None, r[9] or T0))
    parts = [rows[i * 40 : i * 40 + 40] for i in range(4)]
    # the reader sees the messages batch by batch; a few of each come a batch late, some twice
    if shuffled:
        r = random.Random(4)
        for i in range(3):
            late = [x for x in parts[i] if x[9] and r.random() < 0.2]
            parts[i] = [x for x in parts[i] if x not in late]
            parts[i + 1] = late + parts[i + 1]
        for p in parts:
            r.shuffle(p)
    clock = [max(x[9] for x in rows[: i * 40 + 40] if x[9]) for i in range(4)]
    parts = [[(b, c, *rest) for b, _, *rest in p] for p, c in zip(parts, clock, strict=True)]
    parts[1] = parts[1] + parts[1][:5]
    end = [("z", T0 + dt.timedelta(days=d), f"end{d}", None, None, None, None, None, None, T0) for d in (3, 6)]
    out = streamed(spark, tmp_path, [*parts, end[:1], end[1:]])
    found, states = loop(rows)
    got = [x for x in out if not x.message_id.startswith("end")]
    assert {x.message_id: (x.application_id, x.strategy, x.conclusive, x.taught) for x in got} == found and len(got) == len(found)
    last = {}
    for x in got:
        if x.application_id is not None:
            key = (x.mailbox, x.application_id)
            last[key] = max(last.get(key, x), x, key=lambda r: r.n_messages)
    assert {k: {c: v[c] for c in fold.start()} for k, v in last.items()} == states


def test_what_comes_too_late_counts_but_moves_nothing(spark, tmp_path):
    h = lambda n: T0 + dt.timedelta(hours=n)
    new = ("a", h(10), "new", "t1", 1, "domain", True, "interview", 0.9, h(9))
    old = ("a", h(40), "old", "t1", None, None, None, "rejection", 0.9, h(8))
    later = [("z", h(30), "end1", None, None, None, None, None, None, None)], [("z", h(80), "end2", None, None, None, None, None, None, None)]
    got = {x.message_id: x for x in streamed(spark, tmp_path, [[new], later[0], [old], later[1]])}
    assert got["new"].status == "interview" and got["new"].taught
    assert (got["old"].application_id, got["old"].strategy, got["old"].late, got["old"].status, got["old"].n_late) == (1, "thread", True, "interview", 1)


def test_batch_lessons_are_the_loop(spark):
    for seed in (5, 6, 7):
        rows = mail(seed, 300)
        found, states = loop(rows)
        known = {(b, t) for b, _, t, _, _ in ON_FILE if t} | {(b, a) for b, a, t, _, _ in ON_FILE if t}
        able = [r for r in rows if r[3] and r[4] and r[6] and (r[0], r[3]) not in known and (r[0], r[4]) not in known]
        got = threads.lessons(spark.createDataFrame(able, MESSAGES), "mailbox").collect()
        assert {(x.mailbox, x.thread_id, x.application_id, x.moment.by) for x in got} == {(r[0], r[3], found[r[2]][0], r[2]) for r in rows if found[r[2]][3]}
        # the states by aggregates, from what the loop matched
        moves = [(f"{r[0]}{found[r[2]][0]}", r[2], r[9], r[7], r[8], found[r[2]][2]) for r in rows if found[r[2]][0]]
        df = spark.createDataFrame(moves, "application_id string, message_id string, received_at timestamp, reply_type string, confidence double, conclusive boolean")
        on_file = spark.createDataFrame([(f"{b}{a}", s, at) for b, a, _, s, at in ON_FILE], "application_id string, status string, evidence_at timestamp")
        folded = {x.application_id: {c: x[c] for c in fold.start()} for x in fold.fold_messages(df, on_file).collect()}
        assert folded == {f"{b}{a}": v for (b, a), v in states.items()}
        assert any(v["n_late"] for v in states.values())


def test_lessons_of_one_hot_thread(spark):
    rows = spark.range(5000).select(F.lit("a").alias("mailbox"), F.lit("t").alias("thread_id"), F.col("id").alias("application_id"), F.col("id").cast("string").alias("message_id"), F.lit(None).cast("timestamp").alias("received_at"))
    assert [(x.application_id, x.thread_id) for x in threads.lessons(rows, "mailbox").collect()] == [(0, "t")]


def test_thread_lessons_query_is_a_loop(spark, sf):
    from rankwell.plans.resolution import thread_lessons

    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_returnflag", "l_linenumber", "l_partkey", "l_shipdate", "l_orderkey").collect()
    owner, has = {}, set()
    for r in sorted(rows, key=lambda r: (r.l_shipdate, f"{r.l_orderkey:012}-{r.l_linenumber}")):
        t, a = (r.l_suppkey, f"{r.l_returnflag} {r.l_linenumber}"), (r.l_suppkey, r.l_partkey)
        if t not in owner and a not in has:
            owner[t] = (r.l_partkey, f"{r.l_orderkey:012}-{r.l_linenumber}")
            has.add(a)
    got = thread_lessons(spark, sf).collect()
    assert {(x.mailbox, x.thread_id): (x.application_id, x.message_id) for x in got} == owner and len(got) == len(owner)
