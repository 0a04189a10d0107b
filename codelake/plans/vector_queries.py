"""Similarity queries over the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.operators import vectors as V
from codelake.session import table


def _query(rows: DataFrame) -> list[float]:
    return rows.where("embedding is not null").orderBy("vec_id").select("embedding").first()[0]


def q_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return V.top_k(rows, _query(rows), 10).select("rank", "vec_id", "label", "score")


def q_vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return V.top_k(rows, _query(rows), 10, F.col("label") == 3).select("rank", "vec_id", "label", "score")


def q_vector_knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every row whose id is divisible by 100, against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return V.knn(rows, rows.where("vec_id % 100 = 0"), 10)


def q_collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.collection_stats(table(spark, sf_dir, "embeddings"))


QUERIES = {"q_vector_topk": q_vector_topk, "q_vector_topk_filtered": q_vector_topk_filtered, "q_vector_knn_batch": q_vector_knn_batch, "q_collection_stats": q_collection_stats}


def _top(where: str) -> str:
    return f"""with q as (select embedding::double[] as v from embeddings order by vec_id limit 1),
      s as (select vec_id, label, round(list_cosine_similarity(embedding::double[], v), 12) as s from embeddings, q {where})
      select row_number() over (order by s desc, vec_id)::int as rank, vec_id, label, round(s, 4) as score from s order by s desc, vec_id limit 10"""


ORACLE = {
    "q_vector_topk": _top(""),
    "q_vector_topk_filtered": _top("where label = 3"),
    "q_vector_knn_batch": """with s as (select q.vec_id as query_id, d.vec_id as id, round(list_cosine_similarity(q.embedding::double[], d.embedding::double[]), 12) as s
        from embeddings q join embeddings d on q.vec_id <> d.vec_id where q.vec_id % 100 = 0),
      r as (select query_id, id, round(s, 4) as score, row_number() over (partition by query_id order by s desc, id)::int as rank from s) select * from r where rank <= 10""",
    "q_collection_stats": "select count(*) as points, count(embedding) as vectors, max(len(embedding))::int as dimension from embeddings",
}
