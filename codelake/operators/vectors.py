"""Exact similarity search and keyed vector tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions.vectors import cosine

#: Places of a score that rank it, and that are shown: ranking keeps all but what the order of a sum may change.
RANKED, SHOWN = 12, 4
#: Query vectors that travel to the tasks at once; larger query sets take several passes.
QUERIES_AT_ONCE = 20_000


def top_k(vectors: DataFrame, query: list[float], k: int = 10, where: Column | None = None, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows most similar to one vector, best first, with rank and score (shown to 4 places); ties of the whole score by id.

    Filters run before the similarity; null, zero and misfitting vectors are no results.
    """
    rows = vectors if where is None else vectors.where(where)
    scored = rows.withColumn("__s", cosine(F.col(vector), F.lit([float(x) for x in query]))).where("__s is not null").withColumn("__s", F.round("__s", RANKED))
    best = scored.orderBy(F.desc("__s"), F.asc(id_column)).limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("__s"), F.asc(id_column)))  # k rows
    return best.withColumn("rank", rank).withColumn("score", F.round("__s", SHOWN)).drop("__s", vector)


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): the k most similar rows for each query row, other than itself; exact.

    The query set meets the rows in blocks: queries travel to the tasks in passes of QUERIES_AT_ONCE, each block of rows
    keeps its best k per query by one matrix product, and only these are shuffled and ranked. Rows whose vector is null,
    zero or of another length than the first query's are passed over.
    """
    wanted = queries.where(F.col(vector).isNotNull()).select(F.col(id_column).alias("q"), vector)
    total = wanted.count()
    schema = "query_id bigint, id bigint, score double"
    found = None
    ordered = wanted.orderBy("q")
    for begin in range(0, total, QUERIES_AT_ONCE):
        rows = ordered.offset(begin).limit(QUERIES_AT_ONCE).toArrow()
        matrix = np.array(rows.column(1).to_pylist(), dtype=np.float64)
        norms = np.linalg.norm(matrix, axis=1)
        ids = np.array(rows.column(0).to_pylist(), dtype=np.int64)[norms > 0]
        shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix[norms > 0] / norms[norms > 0, None]))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            query_ids, unit = shared.value
            for batch in batches:
                pairs = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if v is not None and len(v) == unit.shape[1]]
                if not pairs or not len(unit):
                    continue
                own = np.array([i for i, _ in pairs], dtype=np.int64)
                block = np.array([v for _, v in pairs], dtype=np.float64)
                size = np.linalg.norm(block, axis=1)
                own, block = own[size > 0], block[size > 0] / size[size > 0, None]
                for at in range(0, len(unit), 256):
                    scores = np.round(unit[at : at + 256] @ block.T, RANKED)
                    scores[query_ids[at : at + 256, None] == own[None, :]] = -2
                    order = np.lexsort((np.broadcast_to(own, scores.shape), -scores))[:, :k]
                    q = np.repeat(query_ids[at : at + 256], order.shape[1])
                    s = np.take_along_axis(scores, order, axis=1).ravel()
                    keep = s > -2
                    yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(own[order].ravel()[keep]), pa.array(s[keep])], names=["query_id", "id", "score"])

        part = vectors.select(F.col(id_column).cast("bigint"), vector).mapInArrow(best, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema + ", rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", F.round("score", SHOWN))


def collection_stats(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: points, points with a vector, dimensions met."""
    return vectors.agg(F.count("*").alias("points"), F.count(vector).alias("vectors"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("dimension"))
