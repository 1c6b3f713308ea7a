"""Joins by time with one key of most rows, and containment of short needles, against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rankwell.operators import joins


def hot(r, n, span):
    return [(i, "hot" if r.random() < 0.9 else r.choice(["a", "b", None]), r.choice([None, *[r.randint(0, span)] * 30])) for i in range(n)]


@pytest.mark.parametrize(("per", "span"), [(None, 300), (40, 300), (40, 25), (7, 10_000)])
def test_asof(spark, per, span):
    r = random.Random(per or 1)
    a, b = hot(r, 300, span), [(i, k, t, r.choice([None, i])) for i, k, t in hot(r, 300, span)]
    want = {}
    for i, k, t in a:
        able = [(u, v) for _, q, u, v in b if q == k and u is not None and t is not None and u <= t and v is not None]
        want[i] = max(able)[1] if able else None
    left, right = spark.createDataFrame(a, "id int, k string, t long"), spark.createDataFrame(b, "no int, k string, u long, v long")
    got = joins.asof_latest(left, right, ["k"], "t", "u", "v", per)
    assert {x.id: x.v for x in got.collect()} == want and got.columns == ["k", "id", "t", "v"]


def test_asof_of_timestamps_is_spread(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, t timestamp").withColumn("k", F.lit(1))
    of = joins._stretch([(df, "t")], 100)
    sizes = [x["count"] for x in df.groupBy(of(df, "t").alias("c")).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 300
    clicks = df.filter("id % 500 = 0").select("k", "t", F.col("id").alias("v"))
    assert all(x.v == x.id // 500 * 500 for x in joins.asof_latest(df, clicks, ["k"], "t", "t", "v", 100).collect())
    got = joins.numbered(df, ["k"], ["t", "id"], "no", 100).collect()
    assert all(x.no == x.id + 1 for x in got)


@pytest.mark.parametrize("itself", [True, False])
@pytest.mark.parametrize("per", [None, 30])
def test_interval_of_a_hot_key(spark, itself, per):
    r = random.Random(9)
    rows = hot(r, 250, 900)
    a = spark.createDataFrame(rows, "id int, k string, t long")
    b = a.withColumnRenamed("id", "other") if itself else a.filter("id % 2 = 0").withColumn("other", F.col("id") + 1000)
    theirs = rows if itself else [(i + 1000, k, t) for i, k, t in rows if i % 2 == 0]
    want = set()
    for i, k, t in rows:
        near = [j for j, q, u in theirs if None not in (k, t, u) and q == k and abs(t - u) <= 2 and not (itself and i == j)]
        if len(near) == 1:
            want.add((i, near[0]))
    got = {(x.id, x.other) for x in joins.interval_unique(a, b, ["k"], "t", 2, "id", "other", itself, per).collect()}
    assert got == want and len(want) > 20


def test_containment_of_short_needles(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcé😀") for _ in range(r.randint(1, 7)))
    texts = [" ".join(word() for _ in range(r.randint(0, 12))) for _ in range(80)] + [None, "", "aa"]
    needles = [word() for _ in range(30)] + [f"{word()} {word()}" for _ in range(30)] + [t[3:9] for t in texts if t] + ["", " ", None, "zzz", "a"]
    a = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    b = spark.createDataFrame(list(enumerate(needles)), "j int, needle string")
    joined = joins.contains_join(a, b, "text", "needle")
    want = sorted((i, j) for i, t in enumerate(texts) for j, n in enumerate(needles) if t is not None and n and n.strip() and n in t)
    assert sorted((x.i, x.j) for x in joined.collect()) == want and len(want) > 100
    p = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in p and "CartesianProduct" not in p
