"""Each stage against what it promises, on the stage's own input."""

import os
from collections import Counter

import corpus_pipeline
from rankwell.llm import decontaminate, mixing, neardup, quality, sharding

from .helpers import clashing, empty_docs, hard_docs
from .test_native import jump, windows_brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_order():
    assert [f for _, f in corpus_pipeline.STAGES] == [quality.stage, neardup.stage, decontaminate.stage, mixing.stage, sharding.stage]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = Counter(rows_of(docs))

    kept = quality.stage(spark, docs, sf)
    assert kept.columns == docs.columns
    kept = spark.createDataFrame(kept.collect(), docs.schema)
    assert 0.7 * docs.count() < kept.count() < docs.count() and not Counter(rows_of(kept)) - before
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r.doc_id for r in kept.collect()}
    assert all(k in left for k, q in labels.items() if q == 1)

    single = neardup.stage(spark, kept, sf)
    found = neardup.near_duplicates(kept).collect()
    assert {r.doc_id for r in single.collect()} == {r.class_id for r in found}
    assert single.columns == docs.columns and single.count() == len({r.class_id for r in found})

    clean = spark.createDataFrame(decontaminate.stage(spark, single, sf).collect(), docs.schema)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    brute = windows_brute([(r.doc_id, r.text) for r in single.collect()], items)
    assert {r.doc_id for r in clean.collect()} == {k for k, v in brute.items() if not v[0][4]}

    mixed = mixing.stage(spark, clean, sf)
    assert mixed.columns == docs.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert copies == Counter({r.doc_id: r.copies for r in mixing.mix(clean).collect() if r.copies}) and max(copies.values()) <= 3

    placed = sharding.stage(spark, mixed, sf).collect()
    assert sum(copies.values()) == len(placed) and all(r.shard == jump(r.doc_id, 8) for r in placed)


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == [*COLUMNS, "shard"] and got.count() > 0


def test_quality_and_near_dedup_stages_on_hard_rows(spark, sf):
    docs = clashing(hard_docs(spark))
    known = Counter(map(tuple, docs.collect()))
    for stage in (quality.stage, neardup.stage):
        left = stage(spark, docs, sf)
        assert left.columns == docs.columns and not Counter(map(tuple, left.collect())) - known
    # of the rows that repeat doc_id and text, one stays
    assert sum(x.doc_id == 9 for x in left.collect()) == 1


def test_used_up_tables_go(spark, sf):
    """A stage's own tables and what it read go when its output is written; the last input stays."""
    from rankwell.llm import common

    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    got = corpus_pipeline.run(spark, sf)
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and got.count() > 0


def test_empty_tables(spark, sf):
    docs = empty_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
