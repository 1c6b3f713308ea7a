"""Every query with SQL, side by side with DuckDB on the smallest tables."""

import os
import shutil

import duckdb
import pandas as pd
import pytest

from rankwell import queries as q


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)

    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "NULL"
        if isinstance(x, bool) or type(x).__name__ == "bool":
            return str(bool(x))
        if isinstance(x, (int, float)) or hasattr(x, "dtype"):
            return f"{float(x):.6f}".rstrip("0").rstrip(".")
        return str(x)

    return sorted(tuple(cell(x) for x in row) for row in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_equal_to_sql(spark, sf, duck, name):
    got, want = q.QUERIES[name](spark, sf).toPandas(), duck.execute(q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_runs(spark, sf, name):
    assert q.QUERIES[name](spark, sf).count() > 0


def test_restored_texts(spark, sf):
    rows = q.QUERIES["repair_mojibake"](spark, sf).collect()
    assert all(r.restored and r.untouched for r in rows)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf):
    p = plan(q.QUERIES["shortlist"](spark, sf))
    assert "LeftAnti" in p and "WindowGroupLimit" in p and "TakeOrderedAndProject" in p and "CartesianProduct" not in p
    # the ranking moves no text and no vector
    assert "text#" not in p and "embedding#" not in p and "CartesianProduct" not in p
    p = plan(q.QUERIES["semi_join_in"](spark, sf))
    assert "LeftSemi" in p and "PushedFilters: [IsNotNull(c_mktsegment)" in p


def same_as_sql(spark, folder, name):
    """A query against its SQL over tables made for a test; what the folder has."""
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}{'/*.parquet' if os.path.isdir(f'{folder}/{f}') else ''}'")
    return canonical(q.QUERIES[name](spark, str(folder)).toPandas()), canonical(con.execute(q.ORACLES[name]).df())


def test_status_of_a_customer_without_orders(spark, sf, tmp_path):
    shutil.copy(f"{sf}/customer.parquet", tmp_path)
    spark.read.parquet(f"{sf}/orders.parquet").filter("o_custkey > 3").write.parquet(str(tmp_path / "orders.parquet"))
    got, want = same_as_sql(spark, tmp_path, "left_join_status")
    assert got == want


def test_vectors_of_texts_whose_words_cancel_out(spark, tmp_path):
    """Words of opposite signs in one dimension, and white space that isn't a space, have a vector too."""
    import hashlib

    by = {}
    for i in range(400):
        h = int.from_bytes(hashlib.blake2b(f"w{i}".encode(), digest_size=8).digest(), "little")
        by.setdefault((h % 64, h >> 63), f"w{i}")
    d = next(d for d, _ in by if (d, 0) in by and (d, 1) in by)
    texts = [f"{by[d, 0]} {by[d, 1]}", f"{by[d, 1]} {by[d, 0]}", "\n", "\t ", " ", "\u00a0 \u3000", "", None, "plain words"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(8, [1.0] * 64)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got, want = same_as_sql(spark, tmp_path, "embed_missing")
    assert got == want


def test_plan_of_similar_applications(spark, sf):
    """Each fold of a name is a long expression; inlined into every way to meet, their plan alone filled a driver."""
    assert len(q.QUERIES["similar_applications"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()) < 200_000
