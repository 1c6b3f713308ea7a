"""Rows to learn from: a bounded sample of labelled documents, and scoring in Arrow batches."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .subwords import Subwords


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text, divisible by 5."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, target: str, rows: int) -> DataFrame:
    """``doc_id, text, y`` of at most ``rows`` labelled documents that aren't held out.

    Of all of them, those with the least hash of doc_id. Null targets aren't labels; of
    several labels of a document the most frequent counts (ties: the largest), of several
    texts of a doc_id that with the least hash, so that no doc_id gives more than one row.
    """
    one = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id", F.col(target).alias("_y")).count()
    one = one.groupBy("doc_id").agg(F.max(F.struct("count", "_y"))["_y"].alias("y"))
    one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(one), "doc_id")
    return some.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text")).select("doc_id", "text", "y")


def packed(at: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending buckets and whole counts in few bytes."""
    return zlib.compress(np.diff(at, prepend=0).astype(np.uint32).tobytes() + n.astype(np.uint32).tobytes(), 1)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(blob), np.uint32)
    half = len(raw) // 2
    return np.cumsum(raw[:half]).astype(np.int32), raw[half:].astype(np.float32)


def learned(rows: DataFrame, features: Subwords, fit: Callable[[list[np.ndarray], list[np.ndarray], list], object]) -> object:
    """What ``fit`` makes of the buckets, the counts and the y of all rows of a ``sample``.

    The features are made in parallel and brought, packed, to one task, which the sample
    bounds; ``fit`` runs there, with the rows in the order of doc_id, and only its result comes
    to the driver.
    """
    count_schema = T.StructType([rows.schema["doc_id"], T.StructField("x", T.BinaryType()), rows.schema["y"]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [packed(*features.counts(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.binary()), batch.column("y")], names=["doc_id", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "x", "y")), strict=True)]
        got.sort(key=lambda row: row[0])
        both = [unpacked(x) for _, x, _ in got]
        made = fit([a for a, _ in both], [n for _, n in both], [y for _, _, y in got])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], names=["model"])

    got = rows.select("doc_id", "text", "y").mapInArrow(count, count_schema).repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit([], [], [])


def scored(docs: DataFrame, score: Callable[[list[str]], dict[str, np.ndarray | list]], schema: str) -> DataFrame:
    """``docs`` with the columns that ``score`` makes of its texts (null: empty), named in ``schema``.

    Columns of those names that ``docs`` has already are replaced. Batches stream through
    the Python workers; no more than one batch is held at a time.
    """
    added = T._parse_datatype_string(schema)
    rest = docs.drop(*[f.name for f in added.fields])
    out = T.StructType(rest.schema.fields + added.fields)
    to = {f.name: {"double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[f.dataType.simpleString()] for f in added.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, max(batch.num_rows, 1), 2000):
                part = batch.slice(lo, 2000)
                made = score([t or "" for t in part.column("text").to_pylist()])
                for name, kind in to.items():
                    part = part.append_column(name, pa.array(made[name], kind))
                yield part

    return rest.mapInArrow(run, out)
