"""Small tables with what goes wrong: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8))) for _ in range(n))


def hard_docs(spark: SparkSession) -> DataFrame:
    r = random.Random(3)
    base = sentence(r, 120)
    words = base.split()
    near = words[:]
    near[60] = "changed"
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, " ".join(near), "en", None, 1),
        (4, None, None, None, None),
        (5, "", "en", "b", 0),
        (6, "   \n\t ", "de", "b", 5),
        (7, sentence(r, 20000), "de", "c", 1),
        (8, "one", "en", "c", 3),
        (9, "Ünïcödé ß 😀 ñ", "es", "c", 1),
        (9, "Ünïcödé ß 😀 ñ", "es", "c", 1),
        (10, sentence(r, 50), "fr", "", 1),
        (None, sentence(r, 30), "fr", "d", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def clashing(df: DataFrame) -> DataFrame:
    """With columns of the names that operators make."""
    from pyspark.sql import functions as F

    for c in ("score", "predicted", "shard", "size", "key", "copies", "kept", "fingerprint", "lang_pred", "t", "_h", "_t", "_id", "_x", "_c", "_key", "_copy", "_carry_0", "n_near", "text_id"):
        df = df.withColumn(c, F.lit("x"))
    return df


def empty_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)
