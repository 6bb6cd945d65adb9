"""Scores and ranks: normalising, fusion, reranking, deduplication, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.queries import STOPWORDS
from ..functions.text import words

RRF_K = 60


def normalize_scores(scored: DataFrame, score: str, by: str, tie: str) -> DataFrame:
    """Adds none, min_max, softmax, z_score and percentile, each within its group; a group of one gets 1.0.

    Groups meet in one shuffle while none is of over LARGE rows, which are counted
    first. Beyond that they are aggregated and joined to their rows, and ranks come
    from buckets of a group, so that no task holds a large group whole.
    """
    from .audit import LARGE, largest, ranked_in

    s, n = F.col(score), F.col("_count")
    if largest(scored, by) <= LARGE:
        w = W.partitionBy(by)
        rows = scored.withColumns({"_count": F.count("*").over(w), "_low": F.min(score).over(w), "_high": F.max(score).over(w), "_mean": F.avg(score).over(w), "_dev": F.stddev_pop(score).over(w), "_rank": F.row_number().over(w.orderBy(score, tie)) - 1})
        rows = rows.withColumn("_exp", F.sum(F.exp(s - F.col("_high"))).over(w))
    else:
        stats = scored.groupBy(by).agg(F.count("*").alias("_count"), F.min(score).alias("_low"), F.max(score).alias("_high"), F.avg(score).alias("_mean"), F.stddev_pop(score).alias("_dev"))
        rows = ranked_in(scored, by, score, tie, "_rank")
        rows = rows.join(stats.withColumnRenamed(by, "_key"), F.col(by).eqNullSafe(F.col("_key"))).drop("_key")
        sums = scored.join(stats.select(F.col(by).alias("_key"), "_high"), F.col(by).eqNullSafe(F.col("_key"))).groupBy("_key").agg(F.sum(F.exp(s - F.col("_high"))).alias("_exp"))
        rows = rows.join(sums, F.col(by).eqNullSafe(F.col("_key"))).drop("_key")
    one = lambda c: F.when(n == 1, 1.0).otherwise(c)
    made = {
        "none": one(s),
        "min_max": one(F.when(F.col("_high") == F.col("_low"), 1.0).otherwise((s - F.col("_low")) / (F.col("_high") - F.col("_low")))),
        "softmax": one(F.exp(s - F.col("_high")) / F.col("_exp")),
        "z_score": one(F.when(F.col("_dev") == 0, 0.5).otherwise(1 / (1 + F.exp(-(s - F.col("_mean")) / F.col("_dev"))))),
        "percentile": one(F.col("_rank") / (n - 1)),
    }
    return rows.withColumns(made).drop("_count", "_low", "_high", "_mean", "_dev", "_rank", "_exp")


def fuse(first: DataFrame, second: DataFrame, by: str, key: str, weights: tuple[float, float] = (1.0, 1.0), by_query: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (columns by, key, rank from 1): score and fused rank.

    by_query: the weights of each, as columns dense_weight and bm25_weight, which with its others are kept.
    """
    a = first.select(by, key, F.col("rank").alias("rank_a"))
    b = second.select(by, key, F.col("rank").alias("rank_b"))
    both = a.join(b, [by, key], "full_outer")
    share = lambda w, r: F.coalesce(w / (RRF_K + F.col(r)), F.lit(0.0))
    if by_query is not None:
        both = both.join(by_query, by)
    w = [F.lit(x) for x in weights] if by_query is None else [F.col("dense_weight"), F.col("bm25_weight")]
    scored = both.withColumn("score", share(w[0], "rank_a") + share(w[1], "rank_b"))
    order = W.partitionBy(by).orderBy(F.desc("score"), F.asc_nulls_last("rank_a"), F.asc_nulls_last("rank_b"), key)
    return scored.withColumn("fused_rank", F.row_number().over(order))


def query_terms(query: Column) -> Column:
    """Distinct content words of a query and the parts of hyphenated ones."""
    raw = F.filter(F.transform(words(F.lower(query)), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")), lambda w: w != "")
    content = F.filter(raw, lambda w: ~w.isin(*STOPWORDS))
    own = F.array_distinct(F.when(F.size(content) > 0, content).otherwise(raw))
    parts = F.filter(F.flatten(F.transform(F.filter(own, lambda w: w.rlike("[-_]")), lambda w: F.split(w, "[-_]+"))), lambda p: (F.length(p) > 1) & ~p.isin(*STOPWORDS))
    return F.array_distinct(F.concat(own, parts))


def lexical_score(query: Column, content: Column, meta: Column, score: Column) -> Column:
    """Term overlap and base score, with penalties for unprintable text and layout artefacts."""
    terms, low, about = query_terms(query), F.lower(content), F.lower(F.coalesce(meta, F.lit("")))
    hits = lambda text: F.size(F.filter(terms, lambda t: F.contains(text, t)))
    overlap = F.when(F.size(terms) > 0, F.least(F.lit(1.0), (hits(low) + hits(about) * 0.25) / F.size(terms))).otherwise(0.0)
    plain = F.length(F.regexp_replace(content, r"[^\x20-\x7E]", "")) / F.greatest(F.lit(1), F.length(content))
    noisy = F.contains(low, F.lit("microsoft time-stamp")) | F.contains(low, F.lit("timestamp pca")) | F.contains(low, F.lit("@v@v")) | F.contains(low, F.lit("+++]"))
    return (overlap * 0.75 + F.least(F.lit(1.0), score) * 0.25) * F.when((F.length(content) > 0) & (plain < 0.8), 0.1).otherwise(1.0) * F.when(noisy, 0.05).otherwise(1.0)


def boosted(score: Column, c: dict[str, Column]) -> Column:
    """Score with metadata boosts, 0 at least. c: the columns of candidate and query by name."""
    add = lambda cond, by: F.when(F.coalesce(cond, F.lit(False)), by).otherwise(0.0)
    has = lambda text, *xs: F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(xs))
    q, cat, name, src = F.lower(c["query"]), c["category"], c["document_name"], c["source_path"]
    bare = F.regexp_replace(F.lower(F.trim(c["content"])), "[- ]", "")
    gap = F.abs(c["page"] - c["target_page"])
    return F.greatest(
        F.lit(0.0),
        score
        + add(F.arrays_overlap(c["target_equipment"], c["equipment"]), 0.20)
        + add(F.array_contains(c["target_units"], F.upper(c["plant_unit"])), 0.15)
        + add(F.arrays_overlap(c["target_standards"], c["standards"]), 0.20)
        + add(c["document_id"] == c["target_document"], 0.10)
        + add(gap == 0, 0.10)
        + add((gap > 0) & (gap <= 2), 0.05)
        - add(F.length(F.trim(c["content"])) < 50, 0.20)
        + 0.15 * F.size(F.filter(F.coalesce(c["target_standards"], F.array().cast("array<string>")), lambda s: F.contains(bare, F.regexp_replace(F.lower(s), "[- ]", ""))))
        + add(((c["intent"] == "template_lookup") | has(q, "template", "form")) & (has(cat, "template") | has(name, "template") | has(src, "template")), 0.25)
        + add(((c["intent"] == "maintenance_lookup") | has(q, "maintenance", "repair", "work order")) & (has(cat, "maint") | has(name, "maint", "work_order") | has(src, "maint")), 0.20)
        + add(has(q, "mail", "communicat") & (has(cat, "email") | has(src, "email") | has(name, "^e")), 0.20)
        + add(has(q, "inspection") & has(q, "report", "finding") & (has(cat, "inspect") | has(name, "inspect")), 0.15),
    )


def first_citations(hits: DataFrame, by: str, order: str, keys: list[str]) -> DataFrame:
    """The first hit of each (document, page, section), nulls equal, numbered anew."""
    first = hits.withColumn("_n", F.row_number().over(W.partitionBy(by, *keys).orderBy(order))).where("_n = 1").drop("_n")
    return first.withColumn("anchor", F.format_string("[%d]", F.row_number().over(W.partitionBy(by).orderBy(order))))


def within_budget(rows: DataFrame, by: str, order: Column, size: Column, budget: int) -> DataFrame:
    """Leading rows of each group whose sizes add up to budget at most; the first row always."""
    w = W.partitionBy(by).orderBy(order)
    run = rows.withColumn("_sum", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    return run.where((F.col("_sum") <= budget) | (F.col("_n") == 1)).drop("_sum", "_n")
