"""The corpus pipeline: quality, near-dedup, decontamination, mixing, sharding.

Counted as part of the subpackage ``rankwell.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankwell.llm import decontaminate, mixing, neardup, quality, sharding
from rankwell.llm.common import drop_written, scratch, table, written

STAGES = [
    ("quality classifier", quality.stage),
    ("MinHash near-dedup", neardup.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("mixing sources to target weights", mixing.stage),
    ("sharding", sharding.stage),
]

#: The classifier and the near-duplicate search can't be said in SQL; see tests/llm.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents; each is written as Parquet and reread as the next one's docs.

    When a stage is written, the tables it made on its way go, and so does the input it read.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (name, apply) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return apply(spark, docs, sf_dir)
        with scratch(spark) as made:
            docs = written(apply(spark, docs, sf_dir), name.split()[0])
            output = made.pop()
        drop_written(spark, before)
        before = [output]
    return docs
