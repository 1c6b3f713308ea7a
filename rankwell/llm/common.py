"""What the training-data operators share: reading tables, cutting lineage, hashing rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables as a DataFrame; the path goes through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none and runs in one process, as in tests, a temporary folder
    takes its place; on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rankwell-"))
        found = sc.getCheckpointDir()
    return found


#: The tables written within each open ``scratch``, the innermost last.
_OPEN: list[list[str]] = []


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: what is behind it isn't computed again, and the loss of an executor
    loses none of it.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that are written inside go at the end, but for those that the caller takes off the list."""
    _OPEN.append([])
    try:
        yield _OPEN[-1]
    finally:
        drop_written(spark, _OPEN.pop())


def text_of(name: str = "text") -> Column:
    """The text, null taken as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def n_chunks(spark: SparkSession, rows: int, per_chunk: int = 50_000) -> int:
    """Into how many chunks to deal ``rows`` so that none is too large for a task."""
    return max(1, -(-rows // per_chunk))
