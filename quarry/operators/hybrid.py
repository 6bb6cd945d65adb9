"""Hybrid retrieval over a table of queries, from normalising to packed contexts, and its adaptive form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import queries as qf
from ..sources.tables import scratch, stored
from ..sources.transactions import Store
from . import candidates, embedding, lexical, metadata, ranking, vectors
from .findings import capped

#: Columns of a chunk that filters, boosts and citations look at; the first four are needed.
CHUNK = {"cid": "long", "document": "string", "index": "int", "content": "string", "document_name": "string", "source_path": "string", "category": "string", "plant_unit": "string", "page": "int", "section": "string", "equipment": "array<string>", "standards": "array<string>"}


@dataclass(frozen=True)
class Results:
    """hits (query_id, cid, document, index, score in 0..1, rank, anchor, content), contexts (query_id, context, n_tokens, n_packed) and problems (query_id, duplicates, out_of_order)."""

    hits: DataFrame
    contexts: DataFrame
    problems: DataFrame


def completed(chunks: DataFrame) -> DataFrame:
    """Chunks with all columns of CHUNK, null where they have none."""
    have = set(chunks.columns)
    return chunks.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in CHUNK.items()])


#: Parameters of a query, as columns: hits, neighbours on each side, weights of the channels, tokens of the context.
DEFAULTS = {"k": 10, "radius": 1, "dense_weight": 1.0, "bm25_weight": 1.0, "budget": 3000}


def hybrid(chunks: DataFrame, queries: DataFrame, dimension: int = 64, index: lexical.Index | None = None, **given: float) -> Results:
    """Each query (query_id, text, and what of DEFAULTS it has of its own) over chunks (cid, document, index, content, and what else of CHUNK there is).

    Normalised; sought by vectors and BM25, both wide; the filters that its
    entities plan keep what meets them, or all if nothing does; fused by
    reciprocal ranks, boosted by metadata, reranked by term overlap; neighbours
    join, near-duplicates leave, scores are cut to 0..1; hits get anchors by
    document, page and section, and their text is packed within a budget.
    Parameters are columns of the queries, so one plan serves queries of all kinds;
    `given` are those of queries that lack the column. index: of the chunks' content by
    cid, if it is stored already.
    """
    rows = completed(chunks)
    own = {n: (F.col(n) if n in queries.columns else F.lit(given.get(n, v))).cast("int" if isinstance(v, int) else "double").alias(n) for n, v in DEFAULTS.items()}
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), qf.normalize(F.coalesce("text", F.lit(""))).alias("text"), *own.values())
    asked = asked.withColumn("e", qf.entities(F.col("text"))).withColumn("intent", F.coalesce(F.get(qf.intents(F.col("text"), F.col("e")), F.lit(0)), F.lit("informational"))).withColumn("wide", F.greatest(F.lit(20), 2 * F.col("k")))
    asked = stored(asked, "asked")
    limits = asked.select("query_id", "wide", "dense_weight", "bm25_weight")
    wide = asked.agg(F.max("wide")).first()[0] or 20
    index = index or lexical.build(rows, "cid", "content", scratch(chunks.sparkSession, "bm25"), by_term=False)
    sparse = lexical.search_index(index, asked, "cid", "query_id", "text", wide, 9)
    held = rows.select("cid", embedding.hash_vector(F.col("content"), dimension).alias("v"))
    wanted = asked.select(F.col("query_id").alias("cid"), embedding.hash_vector(F.concat(F.lit("query: "), F.col("text")), dimension).alias("v"))
    dense = vectors.nearest(held, wanted, "cid", "v", wide, digits=9)
    place = lambda found: found.join(limits.select("query_id", "wide"), "query_id").where(F.col("rank") < F.col("wide")).select("query_id", "cid", (F.col("rank") + 1).alias("rank"))
    fused = ranking.fuse(place(dense), place(sparse), "query_id", "cid", by_query=limits).where(F.col("fused_rank") <= F.col("wide"))
    # what is stored before it meets the chunks has a known size: few candidates go to the chunks, not all chunks through a shuffle
    found = stored(fused.select("query_id", "cid", "score"), "fused")
    met = stored(found.join(rows, "cid").join(asked, "query_id"), "met")
    met = met.withColumn("_fits", metadata.planned_filter(F.col("e")))
    some = met.groupBy("query_id").agg(F.max("_fits").alias("_some"))
    fit = met.join(some, "query_id").where(F.col("_fits") | ~F.col("_some"))
    none = F.lit(None)
    boost: dict[str, Column] = {n: F.col(n) for n in ("category", "document_name", "source_path", "content", "page", "equipment", "plant_unit", "standards", "intent")} | {
        "query": F.col("text"),
        "target_page": F.get("e.page_references", F.lit(0)).try_cast("int"),
        "target_equipment": F.col("e.equipment_tags"),
        "target_units": F.col("e.plant_units"),
        "target_standards": F.col("e.standards"),
        "document_id": F.col("document"),
        "target_document": none.cast("string"),
    }
    boosted = fit.withColumn("score", ranking.boosted(F.col("score"), boost))
    scored = boosted.withColumn("score", F.round(ranking.lexical_score(F.col("text"), F.col("content"), F.concat_ws(" ", "document_name", "section"), F.col("score")), 9)).select("query_id", "cid", "document", "index", "score", "radius", F.greatest(F.lit(15), "k").alias("_most"))
    best = stored(lexical.top_k(scored, "query_id", "score", "cid", max(15, wide)).where(F.col("rank") < F.col("_most")), "best")  # used three times below
    near = stored(candidates.with_neighbours(best, rows, "query_id", F.col("radius")), "near")
    wider = stored(near.join(rows.select("cid", "content", "page", "section"), "cid"), "wider")  # used twice
    kept = candidates.without_near_duplicates(wider.withColumn("order", F.struct("rank", "cid")), "query_id", "cid", "content", "order")
    own = wider.drop("rank").join(kept, ["query_id", "cid"]).withColumn("score", F.round(capped(F.col("score")), 6))
    final = stored(own.withColumnRenamed("place", "rank"), "hits")
    first = ranking.first_citations(final, "query_id", "rank", ["document", "page", "section"]).select(F.col("query_id").alias("_q"), F.col("document").alias("_d"), F.col("page").alias("_p"), F.col("section").alias("_s"), "anchor")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    cited = final.join(first, (F.col("query_id") == F.col("_q")) & same("document", "_d") & same("page", "_p") & same("section", "_s"))
    hits = cited.select("query_id", "cid", "document", "index", "score", "rank", "anchor", "content")
    heading = F.concat(F.col("anchor"), F.lit(" Source: "), F.col("document"))
    packed = candidates.pack_context(hits.join(asked.select("query_id", "budget"), "query_id"), "query_id", "rank", heading, F.col("content"), F.col("budget"))
    return Results(hits, packed, candidates.violations(hits, "query_id", "cid", "score", "rank"))


def adaptive(chunks: DataFrame, queries: DataFrame, index: lexical.Index | None = None) -> Results:
    """Each query by the parameters of its intent, which become its columns."""
    text = qf.normalize(F.coalesce("text", F.lit("")))
    intent = F.coalesce(F.get(qf.intents(text, qf.entities(text)), F.lit(0)), F.lit("informational"))
    return hybrid(chunks, queries.select("query_id", "text", metadata.adaptive(intent).alias("a")).select("query_id", "text", "a.*"), index=index)


def cached(chunks: DataFrame, queries: DataFrame, path: str, ttl: int = 3600, at: Column | None = None, index: lexical.Index | None = None, **given: float) -> tuple[DataFrame, DataFrame]:
    """Hits of hybrid() by way of a cache of results under path, and (query_id, from_cache).

    A key is made from the text, trimmed and in lower case, and the parameters.
    Live keys are answered from the cache and counted; each of the others is
    retrieved once, however many queries share it, and stored for `ttl` seconds
    from `at` (now). Nothing is retrieved if all keys are there.
    """
    spark = chunks.sparkSession
    now = (F.current_timestamp() if at is None else at).cast("timestamp")
    told = F.concat_ws("::", F.lower(F.trim(F.coalesce("text", F.lit("")))), F.lit("hybrid"), *[F.lit(str(given.get(n, v))) for n, v in DEFAULTS.items()])
    asked = stored(queries.select(F.col("query_id").cast("long").alias("query_id"), "text", F.sha2(told, 256).alias("cache_key")), "asked")
    store = Store(spark, path)
    held = store.manifest().get("transactions", [])
    schema = "cache_key string, expires timestamp, hits array<struct<cid: long, document: string, index: int, score: double, rank: int, anchor: string, content: string>>"
    cache = spark.createDataFrame([], schema)
    for tx in held:
        cache = cache.unionByName(spark.read.schema(schema).parquet(f"{store.path}/data/{tx}/results"))
    live = cache.where(F.col("expires") >= now)
    misses = asked.join(live, "cache_key", "left_anti").groupBy("cache_key").agg(F.min_by("text", "query_id").alias("text")).withColumn("query_id", F.xxhash64("cache_key"))
    misses = stored(misses, "misses")
    if misses.limit(1).count():
        found = hybrid(chunks, misses.select("query_id", "text"), index=index, **given).hits
        lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "cid", "document", "index", "score", "anchor", "content"))).alias("h"))
        hits = F.transform(F.coalesce("h", F.array()), lambda h: F.struct(*[h[n].alias(n) for n in ("cid", "document", "index", "score", "rank", "anchor", "content")]))
        fresh = misses.join(lists, "query_id", "left").select("cache_key", F.timestamp_add("SECOND", F.lit(ttl), now).alias("expires"), hits.cast(T.StructType.fromDDL(schema)["hits"].dataType).alias("hits"))
        tx = store.begin()
        tx.stage(fresh, "results")
        tx.commit({"transactions": [*held, tx.tx]})
        live = live.unionByName(spark.read.schema(schema).parquet(f"{store.path}/data/{tx.tx}/results"))
    origin = asked.join(misses.select("cache_key", F.lit(1).alias("_miss")), "cache_key", "left").select("query_id", F.col("_miss").isNull().alias("from_cache"))
    latest = live.groupBy("cache_key").agg(F.max_by("hits", "expires").alias("hits"))
    return asked.join(latest, "cache_key").select("query_id", F.explode("hits").alias("h")).select("query_id", "h.*"), origin
