"""Chunks from texts: windows, links, validation, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import chunk_id, content_hash, tok_regex, words

TARGET_TOKENS, OVERLAP_TOKENS = 384, 48
MIN_TOKENS, MAX_TOKENS = 10, 1024


def window_words(target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS) -> tuple[int, int]:
    """Words of a window, and from one start to the next."""
    size = max(10, int(target * 0.75))
    return size, max(1, size - max(0, int(overlap * 0.75)))


def word_windows(docs: DataFrame, key: str, text: str, target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """key, chunk_index, content, token_count, chunk_id of sliding windows; the last one ends with the text."""
    size, step = window_words(target, overlap)
    split = docs.select(F.col(key), words(F.coalesce(text, F.lit(""))).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("w") - size) / step).cast("int")) * step, F.lit(step))
    # a text without words explodes to nothing; a filter on their number would split each text twice
    cut = split.select(key, F.posexplode(F.when(F.size("w") > 0, F.transform(starts, lambda i: F.array_join(F.slice(F.col("w"), i + 1, size), " ")))).alias("chunk_index", "content"))
    return cut.select(key, "chunk_index", "content", tok_regex(F.col("content")).cast("long").alias("token_count"), chunk_id(F.col(key).cast("string"), F.lit(0), F.col("chunk_index"), F.col("content")).alias("chunk_id"))


def character_windows(docs: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """key, chunk_index, content: windows of `size` characters whose end is drawn back to the last blank."""
    step = max(1, size - overlap)
    rows = docs.select(F.col(key), F.coalesce(text, F.lit("")).alias("t")).where(F.length("t") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length("t") - size) / step).cast("int")) * step, F.lit(step))

    def piece(i: Column) -> Column:
        part = F.substr(F.col("t"), i + 1, F.lit(size))
        return F.trim(F.when(i + size < F.length("t"), F.regexp_replace(part, " [^ ]*$", "")).otherwise(part))

    return rows.select(key, F.posexplode(F.transform(starts, piece)).alias("chunk_index", "content")).where("content <> ''")


def validated(chunks: DataFrame, key: str, least: int = MIN_TOKENS, most: int | None = None) -> DataFrame:
    """Adds reason (null if the chunk is good); of equal contents in a document the first is good."""
    again = F.row_number().over(W.partitionBy(key, F.col("_sha")).orderBy("chunk_index")) > 1
    c = F.col("content")
    reason = F.when(F.trim(c) == "", "empty").when(~c.rlike(r"[\p{L}\p{N}]"), "no_alphanumeric").when(again, "duplicate").when(F.col("token_count") < least, "too_small")
    if most is not None:
        reason = reason.when(F.col("token_count") > most, "too_large")
    return chunks.withColumn("_sha", content_hash(c)).withColumn("reason", reason).drop("_sha")


def linked(chunks: DataFrame, key: str) -> DataFrame:
    w = W.partitionBy(key).orderBy("chunk_index")
    return chunks.withColumns({"prev_chunk_id": F.lag("chunk_id").over(w), "next_chunk_id": F.lead("chunk_id").over(w)})


def statistics(chunks: DataFrame, key: str) -> DataFrame:
    n = F.col("token_count")
    return chunks.groupBy(key).agg(F.count("*").alias("n_chunks"), F.round(F.avg(n), 2).alias("avg_tokens"), F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"), F.sum(F.length("content")).cast("long").alias("n_chars"))


def strategy(n_tables: Column, n_sections: Column, category: Column) -> Column:
    return F.when(n_tables > 2 * n_sections, "table").when(F.lower(category).rlike("procedure|sop|checklist"), "list").when(n_sections >= 2, "section").otherwise("recursive")


def neighbours(rows: DataFrame, by: str, order: str, key: str, radius: int) -> DataFrame:
    """Adds before and after: the keys of up to radius rows on each side, nearest last and first."""
    w = W.partitionBy(by).orderBy(order)
    return rows.withColumns({"before": F.collect_list(key).over(w.rowsBetween(-radius, -1)), "after": F.collect_list(key).over(w.rowsBetween(1, radius))})
