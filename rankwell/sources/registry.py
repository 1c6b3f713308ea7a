"""Sources by name. A source makes records; what it does after a commit is an intent, not an act."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..session import cut


@dataclass
class Source:
    """``read(spark, path, config)`` gives records in the shape of ``schema.RECORD``; ``intents``, with the
    same arguments, gives the ids to clear once the records are stored."""

    name: str
    read: Callable[[SparkSession, str, dict], DataFrame]
    kind: str = "api"
    intents: Callable[[SparkSession, str, dict], DataFrame] | None = None
    config: dict = field(default_factory=dict)


_SOURCES: dict[str, Source] = {}


def register(source: Source) -> Source:
    if source.name in _SOURCES:
        raise ValueError(f"source {source.name} is registered already")
    _SOURCES[source.name] = source
    return source


def get(name: str) -> Source:
    if name not in _SOURCES:
        raise KeyError(f"no source {name}; there are {', '.join(sorted(_SOURCES))}")
    return _SOURCES[name]


def names() -> list[str]:
    return sorted(_SOURCES)


def _errors(spark: SparkSession, failures: list[tuple[str, Exception]]) -> DataFrame:
    return spark.createDataFrame([(n, f"{type(e).__name__}: {e}".splitlines()[0][:500]) for n, e in failures], "source string, error string")


def ingest(spark: SparkSession, paths: dict[str, str], stored: DataFrame | None = None, config: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new, rejected, errors) of the sources named in ``paths``.

    Each source is read to its end on its own: one that can't be, whether its path is wrong or
    a file or a page breaks on the way, becomes a row of ``errors`` and stops no other. Records
    are validated, get their keys, and those whose key is stored already or seen before are left.
    """
    from ..operators import maintain, sets

    failures = []
    records = spark.createDataFrame([], f"{schema.RECORD}, source string")
    for name, path in paths.items():
        try:
            got = get(name).read(spark, path, (config or {}).get(name, {}))
            records = records.unionByName(cut(got.withColumn("source", F.lit(name))))
        except Exception as e:  # noqa: BLE001
            failures.append((name, e))
    valid, rejected = schema.validate(records)
    keyed = maintain.generated(valid, F.xxhash64("source"), F.col("external_id")).withColumn("_pos", F.struct("source", F.coalesce("external_id", "url")))
    new = sets.new_only(keyed, stored if stored is not None else keyed.limit(0), "content_key", [F.col("_pos")])
    return new.drop("_pos"), rejected, _errors(spark, failures)


def after_commit(spark: SparkSession, paths: dict[str, str], errors: DataFrame, config: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(intents, errors): the ids to clear, by source, of the sources that were read without error.

    To be called when the records are stored, and not before. A hook that fails stops no other.
    """
    failed = {r["source"] for r in errors.collect()}  # one row a source
    intents, failures = spark.createDataFrame([], "source string, message_id string"), []
    for name, path in paths.items():
        hook = None if name in failed else get(name).intents
        if hook is None:
            continue
        try:
            ids = hook(spark, path, (config or {}).get(name, {}))
            intents = intents.unionByName(cut(ids.select(F.lit(name).alias("source"), "message_id")))
        except Exception as e:  # noqa: BLE001
            failures.append((name, e))
    return intents, _errors(spark, failures)
