"""The whole cleaning of documents as one plan: sections in, cleaned documents with page maps and histories out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.tables import stored
from . import parsing, python_text

STAGES = ("unicode", "encoding", "whitespace", "line_ends", "paragraphs", "hyphens", "headers", "page_map", "tables", "bullets", "lists", "unmask")


def table_lines(t: Column) -> Column:
    """Lines of pipe tables with single blanks around their cells; other lines as they are."""
    cells = lambda x: F.transform(F.split(F.substring(x, 2, F.length(x) - 2), r"\|"), lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")))
    told = lambda x: F.when(x.rlike(r"^\|.*\|$") & ~x.rlike(r"^[|:\s-]+$"), F.concat(F.lit("| "), F.array_join(cells(x), " | "), F.lit(" |"))).otherwise(x)
    return F.array_join(F.transform(F.split(t, "\n"), told), "\n")


def clean_sections(sections: DataFrame, doc: str, pos: str, text: str) -> DataFrame:
    """doc, pos, cleaned, char_start, char_end, history, lost of each section.

    All stages in the order of STAGES over text whose protected tokens are
    masked. char_start and char_end are its place in its document, whose sections
    are joined by an empty line; history has each stage's characters before and
    after; lost are protected tokens that the cleaned text lacks.
    """
    rows = sections.select(F.col(doc).alias("_doc"), F.col(pos).alias("_pos"), F.coalesce(text, F.lit("")).alias("_raw"))
    rows = rows.withColumn("_m", python_text.mask("_raw")).withColumn("_t", F.col("_m.masked"))
    rows = rows.withColumn("_h", F.array().cast("array<struct<stage: string, before: int, after: int>>"))

    def stage(rows: DataFrame, name: str, made: Column) -> DataFrame:
        # the new text once, then its length beside the old one's
        rows = rows.withColumn("_new", made)
        step = F.struct(F.lit(name).alias("stage"), F.length("_t").alias("before"), F.length("_new").alias("after"))
        return rows.withColumn("_h", F.concat("_h", F.array(step))).withColumn("_t", F.col("_new")).drop("_new")

    t = F.col("_t")
    for name, made in zip(STAGES[:6], (python_text.nfkc("_t"), tx.fix_encoding(t), tx.squeeze_lines(t), tx.fix_line_ends(t), tx.join_paragraph_lines(t), tx.join_hyphens(t)), strict=True):
        rows = stage(rows, name, made)
    rows = stored(rows, "clean")  # used on both sides of the join below
    bare = parsing.without_headers(rows, "_doc", "_pos", "_t").select(F.col("_doc").alias("_d"), F.col("_pos").alias("_p"), "cleaned")
    rows = rows.join(bare, F.col("_doc").eqNullSafe(F.col("_d")) & F.col("_pos").eqNullSafe(F.col("_p"))).drop("_d", "_p")
    rows = stage(rows, "headers", F.col("cleaned")).drop("cleaned")
    rows = stage(rows, "page_map", t)
    for name, made in zip(STAGES[8:11], (table_lines(t), tx.fix_bullets(t), tx.fix_lists(t)), strict=True):
        rows = stage(rows, name, made)
    rows = stage(rows, "unmask", python_text.unmask(t, F.col("_m.tokens")))
    w = W.partitionBy("_doc").orderBy("_pos")
    size = F.length("_t") + 2
    start = F.coalesce(F.sum(size).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    lost = F.filter(F.array_distinct("_m.tokens"), lambda x: ~F.contains(t, x))
    return rows.select(F.col("_doc").alias(doc), F.col("_pos").alias(pos), t.alias("cleaned"), start.alias("char_start"), (start + F.length("_t")).alias("char_end"), F.col("_h").alias("history"), lost.alias("lost"))


def clean_documents(sections: DataFrame, doc: str, pos: str, text: str) -> DataFrame:
    """doc, cleaned, page_map (pos, char_start, char_end), chars_before, chars_after, n_lost of each document."""
    rows = clean_sections(sections, doc, pos, text).withColumn("_before", F.col("history")[0]["before"])
    part = F.struct(F.col(pos).alias("pos"), "char_start", "char_end", F.col("cleaned").alias("t"))
    made = rows.groupBy(doc).agg(F.array_sort(F.collect_list(part)).alias("_s"), F.sum("_before").alias("chars_before"), F.sum(F.size("lost")).alias("n_lost"))
    whole = F.array_join(F.transform("_s", lambda s: s["t"]), "\n\n")
    return made.select(doc, whole.alias("cleaned"), F.transform("_s", lambda s: F.struct(s["pos"].alias("pos"), s["char_start"].alias("char_start"), s["char_end"].alias("char_end"))).alias("page_map"), "chars_before", F.length(whole).cast("long").alias("chars_after"), "n_lost")
