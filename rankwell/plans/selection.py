"""Scoring and selection over postings and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as X
from ..operators import discover, guards, reports, vector_index
from ..operators import select as S
from ..session import cut
from .base import CENTRED, POSTINGS, postings, query, scan, table, vectors


def scored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings with score and percentile, without text and vector; written once, since ranking reads it twice."""
    v = vectors(spark, sf_dir)
    profile = v.orderBy("id").limit(1).select(F.col("embedding").alias("profile"))
    got = X.centred_cosine(postings(spark, sf_dir), profile, corpus=v).drop("embedding")
    return X.percentile(cut(got.withColumn("score", F.when(F.col("passed"), F.round("score", 6)))))


SCORED = f"""WITH {POSTINGS}, src AS (SELECT * FROM p), {CENTRED},
s AS (SELECT *, CASE WHEN passed THEN round(raw, 6) END AS score FROM scored),
r AS (
  SELECT *, CASE WHEN score IS NOT NULL THEN
    100.0::DOUBLE * (rank() OVER (PARTITION BY score IS NULL ORDER BY score) - 1) / count(*) OVER (PARTITION BY score IS NULL) END AS percentile FROM s
)"""


@query(
    "shortlist",
    SCORED
    + """, h AS (SELECT DISTINCT lower(trim(company)) AS c, lower(trim(title)) AS t FROM p WHERE blocked),
able AS (
  SELECT *, round(score + CASE WHEN is_remote THEN 0.02 ELSE 0 END, 6) AS rank_score FROM r
  WHERE score IS NOT NULL AND passed AND NOT blocked AND percentile >= 50 AND length(trim(description)) >= 300
    AND NOT EXISTS (SELECT 1 FROM h WHERE h.c = lower(trim(company)) AND h.t = lower(trim(title)))
), twin AS (
  SELECT *, row_number() OVER (PARTITION BY lower(trim(company)), lower(trim(title)) ORDER BY rank_score DESC, id) AS tr FROM able
), cap AS (
  SELECT *, row_number() OVER (PARTITION BY lower(trim(company)) ORDER BY rank_score DESC, id) AS cr FROM twin WHERE tr = 1
)
SELECT id, company, title, is_remote, score, round(percentile, 4) AS percentile, rank_score FROM cap WHERE cr <= 3 ORDER BY rank_score DESC, id LIMIT 25""",
)
def shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scored_postings(spark, sf_dir)
    got = S.shortlist(p, p.filter("blocked"), floor=50.0)
    return got.select("id", "company", "title", "is_remote", "score", F.round("percentile", 4).alias("percentile"), "rank_score")


@query(
    "embed_missing",
    "SELECT doc_id AS id, vec_id IS NOT NULL AS stored, 64::INTEGER AS dimensions, CASE WHEN vec_id IS NULL THEN CASE WHEN trim(coalesce(text, '')) = '' THEN 0.0 ELSE 1.0 END END AS length FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
)
def embed_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the vectors that are stored; only those without one go through the encoder, whose vectors have length 1."""
    d, e = table(spark, sf_dir, "documents"), scan(spark, sf_dir, "embeddings")
    both = d.join(e, d["doc_id"] == e["vec_id"], "left").select(F.col("doc_id").alias("id"), "text", "embedding")
    have = both.filter("embedding IS NOT NULL").select("id", F.lit(True).alias("stored"), "embedding", F.lit(None).cast("double").alias("length"))
    need = X.embed(both.filter("embedding IS NULL").select("id", "text"), "text")
    made = need.select("id", F.lit(False).alias("stored"), "embedding", F.round(F.sqrt(X.dot(F.col("embedding"), F.col("embedding"))), 4).alias("length"))
    return have.unionByName(made).select("id", "stored", F.size("embedding").alias("dimensions"), "length")


@query("centered_cosine", f"WITH src AS (SELECT vec_id AS id, embedding FROM embeddings), {CENTRED} SELECT id AS vec_id, round(raw, 6) AS score FROM scored")
def centered_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    profile = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("profile"))
    return X.centred_cosine(e, profile).select("vec_id", F.round("score", 6).alias("score"))


@query(
    "raw_cosine_zero_safe",
    """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
z AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN vec_id % 10 = 9 THEN 0.0 ELSE CAST(embedding[i] AS DOUBLE) END) AS v,
  list_transform(range(1, 65), lambda i: CAST(q[i] AS DOUBLE)) AS q FROM embeddings, q)
SELECT vec_id, round(CASE WHEN list_dot_product(v, v) > 0 THEN list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) ELSE 0 END, 6) AS score FROM z""",
)
def raw_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    v = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 10 == 9, F.lit(0.0)).otherwise(x.cast("double")))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(X.cosine(v, F.col("q")), 6).alias("score"))


@query("percentile_rank", "SELECT o_orderkey, round(100.0::DOUBLE * (rank() OVER (ORDER BY o_totalprice) - 1) / count(*) OVER (), 6) AS percentile FROM orders")
def percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return X.percentile(o, "o_totalprice").select("o_orderkey", F.round("percentile", 6).alias("percentile"))


@query(
    "topk_per_entity",
    """WITH z AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE)) AS v, label FROM embeddings),
s AS (SELECT q.vec_id AS query_id, b.vec_id, round(list_dot_product(q.v, b.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS score
  FROM z q, z b WHERE q.vec_id % 50 = 0 AND b.vec_id <> q.vec_id)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
)
def topk_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated set of queries, ids divisible by 50, against all vectors, by an inverted file."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vector_index.Index(e).search(q, 5).rows.withColumnRenamed("id", "vec_id")


@query("twin_collapse", "SELECT p_partkey, p_brand, p_size FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(p_brand)), lower(trim(CAST(p_size AS VARCHAR))) ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1")
def twin_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("size", F.col("p_size").cast("string"))
    return S.collapse_twins(p, [F.desc("p_retailprice"), F.asc("p_partkey")], "p_brand", "size").select("p_partkey", "p_brand", "p_size")


@query("group_cap", "SELECT p_partkey, p_brand, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def group_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cap_groups(table(spark, sf_dir, "part"), [F.desc("p_retailprice"), F.asc("p_partkey")], 3, "p_brand").select("p_partkey", "p_brand", "p_retailprice")


@query(
    "handled_role_anti_join",
    """SELECT p_partkey FROM part p WHERE NOT EXISTS (
  SELECT 1 FROM part q JOIN lineitem l ON l.l_partkey = q.p_partkey
  WHERE l.l_quantity >= 50 AND l.l_tax >= 0.08 AND l.l_discount >= 0.09 AND lower(trim(q.p_brand)) = lower(trim(p.p_brand)) AND lower(trim(q.p_type)) = lower(trim(p.p_type)))""",
)
def handled_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    roles = part.select("p_partkey", F.col("p_brand").alias("company"), F.col("p_type").alias("title"))
    handled = roles.join(line.filter("l_quantity >= 50 AND l_tax >= 0.08 AND l_discount >= 0.09"), F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    return S.handled_roles(roles, handled).select("p_partkey")


@query(
    "first_seen_dedup",
    """SELECT doc_id, k FROM (SELECT doc_id, sha256(lower(trim(text))) AS k, row_number() OVER (PARTITION BY sha256(lower(trim(text))) ORDER BY doc_id) AS r FROM documents) WHERE r = 1""",
)
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.lower(F.trim("text")), 256).alias("k"))
    return S.first_seen(d, ["k"], [F.asc("doc_id")])


@query("order_partition_sort", "SELECT c_custkey, c_acctbal FROM customer ORDER BY (c_mktsegment = 'BUILDING') DESC, nullif(c_acctbal, round(c_acctbal)) DESC NULLS LAST, c_custkey")
def order_partition_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.orderBy((F.col("c_mktsegment") == "BUILDING").desc(), F.nullif("c_acctbal", F.round("c_acctbal")).desc_nulls_last(), "c_custkey").select("c_custkey", "c_acctbal")


@query(
    "window_then_reorder",
    """SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) AS pos
FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 300)""",
)
def window_then_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    then = [F.asc("o_orderstatus"), F.desc("o_totalprice"), F.asc("o_orderkey")]
    got = S.window_then_reorder(o, [F.desc("o_totalprice"), F.asc("o_orderkey")], 300, then)
    return got.select("o_orderkey", "o_orderstatus", F.row_number().over(Window.orderBy(*then)).cast("long").alias("pos"))


@query("recent_notes", r"SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 70) AS note FROM documents ORDER BY doc_id DESC LIMIT 8")
def recent_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("ineligible").alias("status"), F.col("text").alias("notes"), F.col("doc_id").alias("updated_at"))
    return reports.recent_notes(d).select(F.col("id").alias("doc_id"), "note")


@query(
    "first_k_groups",
    """WITH f AS (SELECT p_brand, min(p_partkey) AS m FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY m, p_brand) AS no FROM f)
SELECT p_partkey, p_brand FROM part JOIN r USING (p_brand) WHERE no <= 4 AND p_partkey < coalesce((SELECT m FROM r WHERE no = 5), p_partkey + 1)""",
)
def first_k_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_k_groups(table(spark, sf_dir, "part"), "p_brand", "p_partkey", 4).select("p_partkey", "p_brand")


@query("paged_list", "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND n_name ILIKE '%nation_1%' ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 20")
def paged_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    both = c.join(n, c["c_nationkey"] == n["n_nationkey"])
    return reports.listing(both, ["c_custkey", "c_name", "n_name"], {"c_mktsegment": "BUILDING"}, "NATION_1", ("n_name",), [F.desc("c_acctbal"), F.asc("c_custkey")], 2, 20)


@query("boolean_sort", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY (c_mktsegment <> 'MACHINERY') ASC, c_custkey")
def boolean_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").orderBy((F.col("c_mktsegment") != "MACHINERY").asc(), "c_custkey").select("c_custkey", "c_mktsegment")


@query("max_score", "SELECT label, round(max(CAST(embedding[1] AS DOUBLE)), 6) AS top FROM embeddings GROUP BY label")
def max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.round(F.max(F.col("embedding")[0].cast("double")), 6).alias("top"))


@query(
    "incremental_vs_global",
    """WITH src AS (SELECT vec_id AS id, embedding FROM embeddings WHERE vec_id % 5 <> 0
  UNION ALL SELECT vec_id, embedding FROM embeddings WHERE vec_id % 5 = 0), """ + CENTRED + " SELECT id AS vec_id, round(raw, 6) AS score, id % 5 = 0 AS fresh FROM scored",
)
def incremental_vs_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors only for rows that lack one; scores over all rows."""
    e = table(spark, sf_dir, "embeddings")
    stored = e.filter("vec_id % 5 <> 0").withColumn("fresh", F.lit(False))
    fresh = e.filter("vec_id % 5 = 0").withColumn("fresh", F.lit(True))
    both = stored.unionByName(fresh)
    profile = both.orderBy("vec_id").limit(1).select(F.col("embedding").alias("profile"))
    return X.centred_cosine(both, profile).select("vec_id", F.round("score", 6).alias("score"), "fresh")


@query(
    "end_to_end",
    SCORED
    + """, twin AS (
  SELECT *, row_number() OVER (PARTITION BY lower(trim(company)), lower(trim(title)) ORDER BY score DESC, id) AS tr FROM r WHERE passed AND NOT blocked AND percentile >= 50 AND length(trim(description)) >= 300
), cap AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(company)) ORDER BY score DESC, id) AS cr FROM twin WHERE tr = 1)
SELECT id, CASE WHEN length(description) >= 1000 THEN 'drafted' ELSE 'declined' END AS status,
  CASE WHEN length(description) >= 1000 THEN 'Subject: Application' || chr(10) || chr(10) || 'Hello,' || chr(10) || title END AS cover_letter,
  CASE WHEN length(description) >= 1000 THEN 'Leans on: ' || title ELSE 'Screen declined: too short' END AS notes FROM (SELECT * FROM cap WHERE cr <= 3 ORDER BY score DESC, id LIMIT 25)""",
)
def end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, select, screen and draft the shortlist, and the rows that are written to the applications."""
    p = scored_postings(spark, sf_dir)
    got = S.shortlist(p, p.limit(0).select("company", "title"), floor=50.0, bonus=0.0)
    # the texts of the chosen ones alone
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("posting"))
    jobs = texts.join(F.broadcast(got.select("id", "title")), "id").select("id", "posting", F.array("title").alias("bullets"))
    done = guards.screen_and_draft(jobs, lambda posting: (len(posting) >= 1000, "long enough" if len(posting) >= 1000 else "too short"))
    return guards.state_rows(done).select(F.col("job_id").alias("id"), "status", "cover_letter", "notes")


@query(
    "probe_plan",
    """WITH top AS (SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 300),
r AS (SELECT *, row_number() OVER (ORDER BY s_nationkey >= 20 DESC, s_acctbal DESC, s_suppkey) AS pos FROM top)
SELECT 'name:' || lower(trim(s_name)) AS key, s_name AS company, 'role ' || s_nationkey AS titles, left(sha256(lower(trim(s_name))), 24) AS miss FROM r WHERE s_nationkey >= 5 ORDER BY pos LIMIT 20""",
)
def probe_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best companies that haven't been tried, blocked ones first, with the keys a miss is remembered by."""
    s = table(spark, sf_dir, "supplier")
    jobs = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("company"), F.concat(F.lit("role "), F.col("s_nationkey").cast("string")).alias("title"), F.col("s_acctbal").alias("percentile"), F.lit(True).alias("passed"), (F.col("s_nationkey") >= 20).alias("blocked"))
    tried = s.filter("s_nationkey < 5").select(T.probe_key("s_name").alias("key"))
    got = discover.companies_to_probe(jobs, tried)
    return got.select("key", "company", F.array_join("titles", ",").alias("titles"), T.miss_slug("company").alias("miss"))
