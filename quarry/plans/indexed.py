"""Indexing of points as transactions, and retrieval by way of a cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embedding, hybrid, indexing, lexical
from ..sources import audit_log
from ..sources.tables import scratch
from ..sources.transactions import Store
from . import fixtures, hybrid_sql
from .cleaning import redacted_sql
from .hybrid import chunk_table
from .registry import ORACLES, query, read

_amended = "CASE WHEN chunk_index % 3 = 0 THEN content || ' amended' ELSE content END"


@query(
    f"""WITH r AS ({ORACLES["collection_routing"]}), {fixtures.CHUNK_ROWS}, p AS (SELECT chunk_id, {_amended} AS content FROM chunk_rows WHERE content <> '')
SELECT collection, count(*) AS n_points, CAST(sum(length(content)) AS BIGINT) AS n_chars, count(CASE WHEN content LIKE '% amended' THEN 1 END) AS n_amended FROM p JOIN r USING (chunk_id) GROUP BY collection"""
)
def indexed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a point, in three batches: half of them, then all with a third changed and broken ones, then the same again."""
    rows = fixtures.chunk_rows(spark, sf_dir).where("content <> ''").drop("score")
    pointed = lambda df: df.withColumn("vector", embedding.hash_vector(F.col("content"), 8))
    store = Store(spark, scratch(spark, "points"))
    indexing.index_points(store, pointed(rows.where("chunk_index % 2 = 0")), 8)
    changed = pointed(rows.withColumn("content", F.expr(_amended)))
    broken = changed.where("chunk_index % 10 = 0").withColumns({"chunk_id": F.concat("chunk_id", F.lit("-broken")), "vector": F.slice("vector", 1, 7)})
    indexing.index_points(store, changed.unionByName(broken), 8)
    indexing.index_points(store, changed, 8)
    return indexing.stored_points(store).groupBy("collection").agg(F.count("*").alias("n_points"), F.sum(F.length("content")).alias("n_chars"), F.count(F.when(F.col("content").endswith(" amended"), 1)).alias("n_amended"))


@query(f"WITH h AS ({hybrid_sql.HYBRID}) SELECT h.*, length(text) % 2 = 0 AS from_cache FROM h JOIN benchmark ON item_id = query_id")
def cached_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages after a first run has retrieved those of even length: all of them are answered, the others alone retrieved."""
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    chunks, path = chunk_table(read(spark, sf_dir, "documents")), scratch(spark, "results")
    index = lexical.build(chunks, "cid", "content", scratch(spark, "bm25"))  # both runs search it
    hybrid.cached(chunks, asked.where(F.length("text") % 2 == 0), path, index=index)
    hits, origin = hybrid.cached(chunks, asked, path, index=index)
    return hits.drop("content").join(origin, "query_id")


_note = "'user ' || user_id || ' sent password: hunter' || event_id || 'xyz'"


@query(f"SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_type AS tool, props, {redacted_sql(_note)} AS note, round(value, 2) AS took_ms, CAST(ts AS DATE) AS day FROM events")
def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an invocation, appended to a log in two parts and read again."""
    rows = read(spark, sf_dir, "events")
    note = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" sent password: hunter"), F.col("event_id").cast("string"), F.lit("xyz"))
    told = rows.select("event_id", F.col("ts").alias("at"), F.col("event_type").alias("tool"), F.create_map(F.lit("props"), F.col("props"), F.lit("note"), note).alias("arguments"), F.col("value").alias("took_ms"), F.lit("ok").alias("status"), F.lit("").alias("summary"))
    path = scratch(spark, "audit")
    for half in (0, 1):
        audit_log.append(told.where(F.col("event_id") % 2 == half), path)
    found = audit_log.records(spark, path)
    return found.select(F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "tool", F.col("arguments")["props"].alias("props"), F.col("arguments")["note"].alias("note"), "took_ms", "day")
