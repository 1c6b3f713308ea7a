"""How a query is registered: a function of (spark, sf_dir), and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: Tables of texts, on which queries do much work a row.
TEXTS = ("documents", "pages")


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it lies there, for queries that only take slim columns from it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = scan(spark, sf_dir, name)
    return spread(found) if name in TEXTS else found


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the role of postings: id, company, title, body_chars, is_remote, passed, blocked, embedding.

    What the scan of the text is for is taken at the scan, so that the joins move no texts.
    """
    d, lab, e = (scan(spark, sf_dir, t) for t in ("documents", "labels", "embeddings"))
    slim = d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("company"),
        F.substring("text", 1, 40).alias("title"),
        F.length(F.trim("text")).alias("body_chars"),
        (F.col("lang") == "en").alias("is_remote"),
    )
    both = slim.join(lab, slim["id"] == lab["doc_id"], "left").join(e, slim["id"] == e["vec_id"])
    return both.select(
        *slim.columns,
        (F.coalesce("quality", F.lit(1)) == 1).alias("passed"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("blocked"),
        "embedding",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, embedding`` of the postings: the vectors of documents that there are."""
    e, d = scan(spark, sf_dir, "embeddings"), scan(spark, sf_dir, "documents")
    return e.join(d, e["vec_id"] == d["doc_id"], "left_semi").select(F.col("vec_id").alias("id"), "embedding")


#: The same in SQL, as the first of the common table expressions.
POSTINGS = """p AS (
  SELECT d.doc_id AS id, source AS company, left(text, 40) AS title, text AS description, lang = 'en' AS is_remote,
         coalesce(quality, 1) = 1 AS passed, coalesce(toxic, 0) = 1 AS blocked, embedding
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id JOIN embeddings e ON e.vec_id = d.doc_id
)"""
#: Vectors less their mean, of a relation ``src`` with id and embedding.
CENTRED = """c AS (
  SELECT list(m ORDER BY i) AS centre FROM (
    SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM src, range(1, 65) AS t(i) GROUP BY i)
), z AS (
  SELECT src.*, list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) - centre[i]) AS v FROM src, c
), scored AS (
  SELECT z.*, CASE WHEN list_dot_product(z.v, z.v) > 0 AND list_dot_product(q.v, q.v) > 0
    THEN list_dot_product(z.v, q.v) / (sqrt(list_dot_product(z.v, z.v)) * sqrt(list_dot_product(q.v, q.v))) ELSE 0 END AS raw
  FROM z, (SELECT v FROM z ORDER BY id LIMIT 1) q
)"""
