"""Embedding of texts through a cache, by a pluggable embedder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.functions.text import cache_key, embedder_text
from codelake.operators.incremental import with_cache

Embedder = Callable[[list[str]], list[list[float] | None]]


def hashing_embedder(dimension: int = 64) -> Embedder:
    """Deterministic vectors of unit length from hashed words: no model, no network."""

    def embed(texts: list[str]) -> list[list[float] | None]:
        out = []
        for text in texts:
            vector = np.zeros(dimension)
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                vector[h % dimension] += 1 if h >> 63 else -1
            norm = np.linalg.norm(vector)
            out.append((vector / norm).tolist() if norm else None)
        return out

    return embed


def embed(rows: DataFrame, cache: DataFrame, embedder: Embedder, model: str, text: str = "content", limit: int = 4915, batch: int = 32) -> tuple[DataFrame, DataFrame]:
    """(rows with cache_key, embedding and cached; new cache entries). Only texts whose key is not cached are embedded, each once.

    The key covers the whole text, the embedder sees its first ``limit`` characters. Null texts and failed ones get no
    embedding.
    """
    keyed = rows.withColumn("cache_key", cache_key(model, F.col(text)))
    known = with_cache(keyed, cache)
    misses = known.where("not cached and cache_key is not null").groupBy("cache_key").agg(F.min(embedder_text(F.col(text), limit)).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in batches:
            for at in range(0, records.num_rows, batch):
                part = records.slice(at, batch)
                vectors = embedder(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["cache_key", "embedding"])

    fresh = misses.mapInArrow(run, "cache_key string, embedding array<float>").where("embedding is not null")
    made = fresh.select("cache_key", F.col("embedding").alias("__new"))
    whole = known.join(made, "cache_key", "left").withColumn("embedding", F.coalesce("embedding", "__new")).drop("__new")
    return whole, fresh
