"""Deterministic embeddings from hashes, their cache, checksums, and resumable batches."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fixed

MODEL = "local_embedder"


def _name(model: str | Column) -> Column:
    return F.lit(model) if isinstance(model, str) else model


def hash_vector(text: Column, dimension: int = 64, model: str | Column = MODEL) -> Column:
    """Signed 32-bit little-endian numbers of sha256(model:text:step) over 2**31, scaled to length one; all null for a null text or model.

    An Arrow function: the text is hashed once for all steps, and a batch's numbers
    are scaled together, with squares summed in order, where the JVM cut each number out of hex digits.
    """
    steps = [f":{s}".encode() for s in range(-(-dimension // 8))]

    def run(models: pd.Series, texts: pd.Series) -> pd.Series:
        out, some, raw = [[None] * dimension] * len(texts), [], []
        for i, (m, t) in enumerate(zip(models, texts, strict=True)):
            if m is not None and t is not None:
                some.append(i)
                begun = hashlib.sha256(f"{m}:{t}".encode("utf-8", "surrogatepass"))
                for s in steps:
                    h = begun.copy()
                    h.update(s)
                    raw.append(h.digest())
        if some:
            v = np.frombuffer(b"".join(raw), "<i4").reshape(len(some), -1)[:, :dimension] / 2.0**31
            v = v / np.sqrt(np.cumsum(v * v, axis=1)[:, -1:])
            for i, x in zip(some, v, strict=True):
                out[i] = x
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(_name(model), text)


def checksum(vector: Column) -> Column:
    """sha256 over the numbers with six decimals as C's printf rounds them, comma-joined, nulls left out."""
    return F.sha2(F.array_join(F.transform(vector, lambda x: fixed(x, 6)), ","), 256)


def cache_key(model: str | Column, content_hash: Column) -> Column:
    return F.sha2(F.concat(_name(model), F.lit(":"), content_hash), 256)


def split_cached(chunks: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Chunks with the vector that the cache has, and chunks that it lacks."""
    return chunks.join(cache, key), chunks.join(cache.select(key), key, "left_anti")


def pending(chunks: DataFrame, done: DataFrame, job: str, key: str) -> DataFrame:
    """Chunks that a job's checkpoint table does not have yet."""
    return chunks.join(done.where(F.col("job_id") == job).select(key), key, "left_anti")


def embed_with_cache(chunks: DataFrame, cache: DataFrame, text: str, dimension: int = 64, model: str | Column = MODEL) -> DataFrame:
    """chunks with cache_key, vector and from_cache; only misses are embedded.

    A model named by a column may differ from row to row, and equal texts of two
    models do not share an entry. A null text counts as empty.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    keyed = chunks.withColumn("cache_key", cache_key(model, F.sha2(F.trim(content), 256)))
    hits, misses = split_cached(keyed, cache.select("cache_key", "vector"), "cache_key")
    made = misses.withColumn("vector", hash_vector(content, dimension, model)).withColumn("from_cache", F.lit(False))
    return hits.withColumn("from_cache", F.lit(True)).select(made.columns).unionByName(made)
