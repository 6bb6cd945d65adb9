"""Where query functions put themselves, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text of all documents and of the awkward inline texts, whose ids are negative."""
    return read(spark, sf_dir, "documents").select("doc_id", "text").unionByName(fixtures.table(spark, "fx_raw_text"))


TEXTS = fixtures.cte("fx_raw_text") + ",\ntexts AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM fx_raw_text)"
