"""Documents from recognised blocks: sections by page with paragraphs and offsets, page maps, titles, outlines that span pages, and elements to export.

Blocks are rows (doc, page, block, left, top, right, bottom, text, confidence).
Everything is a window inside a page, or inside the sections of a document, which
are few for its blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import count_words, strip
from .ocr import ARROW, CONNECTION, GUESSED, heading, stable_id
from .parsing import CROSS_REFERENCE

#: Lines of a page that a text is laid out on; heights of a line and from one line to the next; width of a character.
PAGE_LINES, LINE, PITCH, CHARACTER = 40, 12.0, 16.0, 7.0
# What stands between sections and between pages, and the title of text without a heading.
SEPARATOR = "\n\n"
UNTITLED = "Document Content"
LEVELS = 6


def laid_out(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of texts that have none: a block for each line that is not blank, PAGE_LINES lines a page."""
    lines = docs.select(F.col(key).alias("doc"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "text")).where(strip(F.col("text")) != "")
    row = F.col("pos") % PAGE_LINES
    return lines.select(
        "doc", (F.floor(F.col("pos") / PAGE_LINES) + 1).cast("int").alias("page"), row.cast("int").alias("block"), F.lit(0.0).alias("left"), (row * PITCH).alias("top"),
        (F.length("text") * CHARACTER).alias("right"), (row * PITCH + LINE).alias("bottom"), "text", (F.col("pos") % 7 / F.lit(7.0).cast("double")).alias("confidence"),
    )


def sections(blocks: DataFrame) -> DataFrame:
    """doc, page, section (from 0 on each page), title, level, explicit, content, n_paragraphs, confidence, char_start, char_end.

    A heading begins a section; text before the first of a page is a section of
    its own. Offsets are those of the canonical text: titles and contents, with
    SEPARATOR between sections and between pages.
    """
    page = W.partitionBy("doc", "page")
    order = page.orderBy(F.bround(F.col("top") / 10), "left", "block")
    tall = F.when(F.col("bottom") > F.col("top"), F.col("bottom") - F.col("top"))
    rows = blocks.withColumns({"_line": F.coalesce(F.median(tall).over(page), F.lit(20.0)), "_gap": F.greatest(F.lit(0.0), F.col("top") - F.coalesce(F.lag("bottom").over(order), F.col("top"))), "_at": F.row_number().over(order)})
    rows = rows.where(strip(F.col("text")) != "").withColumn("_h", heading(F.col("text"), F.col("_gap") > 1.5 * F.col("_line")))
    upto = page.orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_group", F.count("_h").over(upto))
    # paragraphs of the body blocks of a section
    body = rows.where(F.col("_h").isNull())
    own = W.partitionBy("doc", "page", "_group")
    along = own.orderBy("_at")
    down = F.lead("top").over(along) - F.col("bottom")
    gap = F.when(down.isNotNull(), F.greatest(F.lit(0.0), down))
    body = body.withColumn("_next", gap).withColumn("_typical", F.coalesce(F.median("_next").over(own), F.lit(5.0)))
    ends = F.col("_next").isNotNull() & ((F.col("_next") >= F.greatest(F.col("_typical") * 1.8, F.lit(8.0))) | strip(F.col("text")).rlike(r"[.!?]$"))
    parts = body.groupBy("doc", "page", "_group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "text"))), lambda b: b["text"]), "\n").alias("content"), (F.sum(ends.cast("int")) + 1).alias("n_paragraphs"), F.avg("confidence").alias("_mean"))
    heads = rows.where(F.col("_h").isNotNull()).select("doc", "page", "_group", strip(F.col("text")).alias("title"), F.col("_h.level").alias("level"), F.col("_h.confidence").alias("_sure"))
    met = heads.join(parts, ["doc", "page", "_group"], "full_outer")
    explicit = F.col("title").isNotNull()
    text = F.when(~explicit, F.col("content")).when(F.col("content").isNull(), F.col("title")).otherwise(F.concat("title", F.lit("\n"), "content"))
    made = met.select("doc", "page", "_group", F.coalesce("title", F.lit(UNTITLED)).alias("title"), F.coalesce("level", F.lit(1)).alias("level"), explicit.alias("explicit"), F.coalesce("content", F.lit("")).alias("content"), F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.round(F.coalesce("_mean", "_sure", F.lit(0.9)), 4).alias("confidence"), F.length(text).alias("_size"))
    # every section but the last of a text is followed by a separator, within a page and between pages
    before = W.partitionBy("doc").orderBy("page", "_group").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("_size") + len(SEPARATOR)).over(before), F.lit(0))
    placed = made.withColumns({"section": F.row_number().over(page.orderBy("_group")) - 1, "char_start": start})
    return placed.select("doc", "page", "section", "title", "level", "explicit", "content", "n_paragraphs", "confidence", "char_start", (F.col("char_start") + F.col("_size")).alias("char_end"))


def page_map(made: DataFrame) -> DataFrame:
    """doc, page, char_start, char_end, n_sections."""
    return made.groupBy("doc", "page").agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.count("*").alias("n_sections"))


def references(made: DataFrame) -> DataFrame:
    """doc, page, idx, target, ref_type of the references on each page, the first of those alike but for case."""
    shown = F.when(~F.col("explicit"), F.col("content")).when(F.col("content") == "", F.col("title")).otherwise(F.concat("title", F.lit("\n"), "content"))
    found = made.select("doc", "page", "section", F.posexplode(F.regexp_extract_all(shown, F.lit(CROSS_REFERENCE), 1)).alias("pos", "target")).withColumn("target", F.trim("target"))
    first = found.groupBy("doc", "page", F.lower("target").alias("_low")).agg(F.min(F.struct("section", "pos", "target")).alias("f"))
    up = F.upper("f.target")
    kind = F.when(F.contains(up, F.lit("FIG")), "FIGURE").when(F.contains(up, F.lit("TABLE")), "TABLE").when(F.contains(up, F.lit("SECTION")), "SECTION").otherwise("STANDARD")
    return first.select("doc", "page", (F.row_number().over(W.partitionBy("doc", "page").orderBy("f")) - 1).alias("idx"), F.col("f.target").alias("target"), kind.alias("ref_type"))


def titles(made: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc, title: the first heading of the first page, of one to twelve words; else its first line that is mostly in capitals; else empty."""
    first = blocks.groupBy("doc").agg(F.min("page").alias("page"))
    words = count_words(F.col("title"))
    named = made.where(F.col("explicit") & words.between(1, 12)).join(first, ["doc", "page"]).groupBy("doc").agg(F.min_by("title", "section").alias("_named"))
    t = strip(F.col("text"))
    letters, upper = (F.length(F.regexp_replace(t, p, "")) for p in (r"[^\p{L}]", r"[^\p{Lu}]"))
    loud = blocks.join(first, ["doc", "page"]).where((t != "") & (F.length(t) <= 120) & (letters >= 3) & (upper / letters >= 0.75))
    loud = loud.groupBy("doc").agg(F.min_by(t, F.struct(F.bround(F.col("top") / 10), "left", "block")).alias("_loud"))
    return first.select("doc").join(named, "doc", "left").join(loud, "doc", "left").select("doc", F.coalesce("_named", "_loud", F.lit("")).alias("title"))


def documents(blocks: DataFrame, made: DataFrame) -> DataFrame:
    """doc, title, total_pages, total_sections, total_paragraphs, total_words, total_characters."""
    shown = F.concat_ws(" ", F.when(F.col("explicit"), F.col("title")), "content")
    sums = made.groupBy("doc").agg(F.count("*").alias("total_sections"), F.sum("n_paragraphs").alias("total_paragraphs"), F.sum(count_words(shown)).alias("total_words"), F.max("char_end").cast("long").alias("total_characters"))
    pages = blocks.groupBy("doc").agg(F.countDistinct("page").alias("total_pages"))
    return titles(made, blocks).join(pages, "doc").join(sums, "doc")


def outline(made: DataFrame) -> DataFrame:
    """doc, number, path, level, first_page, last_page, n_parts of the sections of a whole document.

    A heading's path has the last heading of each level above it, unless a higher
    one came since. What stands before the first heading of a later page goes on
    with the section of the page before.
    """
    along = W.partitionBy("doc").orderBy("page", "section")
    upto = along.rowsBetween(W.unboundedPreceding, 0)
    rows = made.withColumns({"number": F.sum(F.col("explicit").cast("int")).over(upto), "_seq": F.row_number().over(along)})
    last = {n: F.last(F.when(F.col("explicit") & (F.col("level") == n), F.struct("_seq", "title")), True).over(upto) for n in range(1, LEVELS + 1)}
    rows = rows.withColumns({f"_l{n}": c for n, c in last.items()})
    live = []
    for n in range(1, LEVELS + 1):
        over = reduce(F.greatest, [F.coalesce(F.col(f"_l{m}._seq"), F.lit(0)) for m in range(1, n)], F.lit(0)) if n > 2 else F.coalesce(F.col("_l1._seq"), F.lit(0)) if n == 2 else F.lit(0)
        live.append(F.when((F.col(f"_l{n}._seq") > over) & (F.lit(n) <= F.col("_top")), F.col(f"_l{n}.title")))
    rows = rows.withColumn("_top", F.last(F.when(F.col("explicit"), F.col("level")), True).over(upto)).withColumn("path", F.array_compact(F.array(*live)))
    return rows.groupBy("doc", "number").agg(F.min_by("path", "_seq").alias("path"), F.min_by("level", "_seq").alias("level"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("n_parts"))


def tables(blocks: DataFrame) -> DataFrame:
    """doc, page, table (from 0 on each page), content: runs of two or more neighbouring `|...|` lines."""
    page = W.partitionBy("doc", "page")
    order = page.orderBy(F.bround(F.col("top") / 10), "left", "block")
    rows = blocks.withColumns({"_row": strip(F.col("text")).rlike(r"^\|.*\|$"), "_at": F.row_number().over(order)})
    rows = rows.withColumn("_run", F.sum((~F.col("_row")).cast("int")).over(page.orderBy("_at"))).where("_row")
    runs = rows.groupBy("doc", "page", "_run").agg(F.array_sort(F.collect_list(F.struct("_at", strip(F.col("text")).alias("x")))).alias("l")).where(F.size("l") > 1)
    return runs.select("doc", "page", (F.row_number().over(page.orderBy("_run")) - 1).alias("table"), F.array_join(F.transform("l", lambda x: x["x"]), "\n").alias("content"))


def stated_connections(blocks: DataFrame) -> DataFrame:
    """doc, page, from_tag, to_tag that a block states, once a page; guesses are left out."""

    def pairs(pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), 0), lambda m: F.array(F.upper(F.regexp_extract(m, pattern, 1)), F.upper(F.regexp_extract(m, pattern, 2))))

    found = F.concat(pairs(CONNECTION), pairs(ARROW))
    return blocks.where(~F.col("text").rlike(GUESSED)).select("doc", "page", F.explode(found).alias("m")).select("doc", "page", F.col("m")[0].alias("from_tag"), F.col("m")[1].alias("to_tag")).distinct()


def elements(made: DataFrame, title: DataFrame, refs: DataFrame, tables: DataFrame | None = None, connections: DataFrame | None = None) -> DataFrame:
    """element_id, doc, kind, page, heading, content: texts, tables (doc, page, table, content), figures and connections (doc, page, from_tag, to_tag) in one table.

    Ids are made from document, kind, place and content, so what is exported twice is one row.
    """
    body = F.when(strip(F.col("content")) != "", strip(F.col("content"))).otherwise(F.col("title"))
    parts = [made.select("doc", F.lit("text").alias("kind"), "page", F.col("title").alias("section"), F.concat(F.lit("sec_"), "page", F.lit("_"), "section").alias("place"), body.alias("content"))]
    parts.append(refs.where("ref_type = 'FIGURE'").select("doc", F.lit("figure").alias("kind"), "page", F.lit("Figures").alias("section"), F.concat(F.lit("fig_"), F.lower("target")).alias("place"), F.col("target").alias("content")))
    if tables is not None:
        parts.append(tables.select("doc", F.lit("table").alias("kind"), "page", F.concat(F.lit("Table tbl_"), "page", F.lit("_"), "table").alias("section"), F.concat(F.lit("tbl_"), "page", F.lit("_"), "table").alias("place"), "content"))
    if connections is not None:
        parts.append(connections.select("doc", F.lit("connection").alias("kind"), "page", F.lit("Connections").alias("section"), F.concat("from_tag", F.lit(">"), "to_tag").alias("place"), F.concat("from_tag", F.lit(" -> "), "to_tag").alias("content")))
    rows = reduce(DataFrame.unionByName, parts).join(title, "doc", "left")
    named = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.col("doc").cast("string"))
    made_id: Column = stable_id("el", F.col("doc").cast("string"), F.col("kind"), F.col("page").cast("string"), F.col("place"), F.sha2("content", 256), length=32)
    return rows.select(made_id.alias("element_id"), "doc", "kind", "page", F.concat(named, F.lit(" > "), "section").alias("heading"), "content").dropDuplicates(["element_id"])
