"""Structured chunking, classification, headers, protected tokens, graphs and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import classify, cleaning, parsing, python_text, structure
from . import fixtures
from .cleaning import s_strip
from .fixtures import cte
from .fixtures import literal as q
from .registry import TEXTS, query, read, texts

FILES = [
    ("manuals/pump_manual.pdf", "This operating manual covers the pump. See the user guide.", None),
    ("reports/ndt_report_5.md", "Inspection report: ultrasonic testing of wall thickness.", None),
    ("safety/oisd_105.txt", "Permit to work and hazard identification.", None),
    ("mail/email_1.eml", "From: a@b\nTo: c@d\nSubject: x\nDate: 2024\n\nhello", None),
    ("x/plan.dwg", "", None),
    ("x/unknown.bin", "nothing to see", None),
    ("x/unknown.pdf", "nothing to see", "Work-Orders 2024"),
    ("templates/checklist.docx", "Checklist template with form number: 7", "manual"),
]
SECTIONS = [
    ("d1", 1, "ACME Refinery\nBody of one\nPage 1 of 3"),
    ("d1", 2, "ACME Refinery\nBody of two\nmore\nPage 2 of 3"),
    ("d1", 3, "ACME Refinery\nScope\nPage 3 of 3"),
    ("d2", 1, "Only one\nsection here\n1 / 2"),
    ("d3", 1, "Scope\nalpha\nconfidential"),
    ("d3", 2, "Scope\nbeta\nconfidential"),
    ("d3", 3, "gamma"),
]
fixtures.TABLES["fx_files"] = (FILES, "path string, text string, known string")
fixtures.TABLES["fx_sections"] = (SECTIONS, "doc string, pos int, content string")


def _s_scores() -> str:
    out = []
    for c, (words, names, signatures) in classify.RULES.items():
        folder = " OR ".join(f"contains(folders, {q(w)})" for w in words)
        content = " + ".join(f"CAST(regexp_matches(sample, {q(p)}) AS INTEGER)" for p in signatures)
        more = f"CASE WHEN regexp_matches(name, {q('|'.join(chr(92) + e + '$' for e in classify.EXTENSIONS[c]))}) THEN 50 ELSE 0 END" if c in classify.EXTENSIONS else "0"
        told = " OR ".join(f"contains(before, {q(w)})" for w in words)
        out.append(f"CASE WHEN {told} THEN 40 ELSE 0 END + CASE WHEN {folder} THEN 30 ELSE 0 END + CASE WHEN regexp_matches(name, {q('|'.join(names))}) THEN 25 ELSE 0 END + least(15 * ({content}), 45) + {more}")
    return "[" + ", ".join(out) + "]"


@query(
    f"""WITH {cte("fx_files")}, files AS (SELECT * FROM fx_files UNION ALL SELECT url, html, NULL FROM pages), p AS (SELECT path, replace(replace(lower(known), ' ', '_'), '-', '_') AS before, regexp_replace(lower(path), '[^/]*$', '') AS folders, regexp_extract(lower(path), '([^/]*)$', 1) AS name, lower(text) AS sample FROM files), s AS (SELECT path, {_s_scores()} AS s FROM p), b AS (SELECT path, list_max(s) AS m, {q(list(classify.RULES))}[list_position(s, list_max(s))] AS c FROM s)
SELECT path, CASE WHEN m >= {classify.LEAST} THEN c ELSE 'Unknown' END AS category, CASE WHEN m >= {classify.LEAST} THEN round(least(0.5::DOUBLE + m / 150.0::DOUBLE * 0.49::DOUBLE, 0.99::DOUBLE), 2) ELSE 0.1::DOUBLE END AS confidence FROM b"""
)
def document_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all pages, by address and markup, and of inline files."""
    c = classify.classified(F.col("path"), F.col("text"), F.col("known"))
    pages = read(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").alias("text"), F.lit(None).cast("string").alias("known"))
    return fixtures.table(spark, "fx_files").unionByName(pages).select("path", c.alias("c")).select("path", "c.category", "c.confidence")


@query()
def parser_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_classification(spark, sf_dir)
    return rows.select("path", classify.parser(F.col("category"), F.col("confidence"), F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("parser"))


@query(
    f"""WITH {cte("fx_sections")}, l AS (SELECT *, list_filter(list_transform(string_split(content, chr(10)), lambda x: {s_strip("x")}), lambda x: x <> '') AS f FROM fx_sections),
e AS (SELECT doc, pos, content, f[1] AS top, CASE WHEN len(f) > 1 THEN f[-1] END AS fin FROM l), g AS (SELECT *, CASE WHEN NOT starts_with(top, '#') AND length(top) <= 150 AND NOT regexp_matches(top, {q(parsing.HEADING_LIKE)}) THEN top END AS t, CASE WHEN NOT starts_with(fin, '#') AND length(fin) <= 150 AND NOT regexp_matches(fin, {q(parsing.HEADING_LIKE)}) THEN fin END AS z FROM e),
c AS (SELECT *, count(*) OVER (PARTITION BY doc) AS n, count(t) OVER (PARTITION BY doc, t) AS nt, count(z) OVER (PARTITION BY doc, z) AS nz FROM g),
h AS (SELECT *, coalesce(n >= 2 AND t IS NOT NULL AND nt >= 2, false) AS head, coalesce(n >= 2 AND (z IS NOT NULL AND nz >= 2 OR regexp_matches(fin, {q(parsing.PAGINATION)})), false) AS foot FROM c),
b AS (SELECT *, CASE WHEN head THEN regexp_replace(content, '^[^\\n]*\\n?', '') ELSE content END AS cut FROM h) SELECT doc, pos, {s_strip("CASE WHEN foot THEN regexp_replace(" + s_strip("cut") + ", '" + chr(92) + "n?[^" + chr(92) + "n]*$', '') ELSE cut END")} AS cleaned FROM b"""
)
def header_footer_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.without_headers(fixtures.table(spark, "fx_sections", sf_dir), "doc", "pos", "content")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of documents: the texts of each source in the order of their ids, under a line and above a page number of theirs."""
    d = F.col("doc_id")
    framed = F.concat(F.lit("REPORT OF "), F.upper("source"), F.lit("\n"), "text", F.lit("\nPage "), d.cast("string"), F.lit(" of 99"))
    rows = read(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), (d % 50).cast("string")).alias("doc"), d.cast("int").alias("pos"), framed.alias("content"))
    return rows.unionByName(fixtures.table(spark, "fx_sections"))


@query()
def cleaned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve stages over the pages of all documents; Unicode forms and masks are beyond SQL."""
    made = cleaning.clean_documents(_pages(spark, sf_dir), "doc", "pos", "content")
    return made.select("doc", F.sha2("cleaned", 256).alias("cleaned_hash"), F.size("page_map").alias("n_pages"), "chars_before", "chars_after", "n_lost")


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.chunks(read(spark, sf_dir, "documents"), "doc_id", "text", "recursive")


@query()
def chunk_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.chunks(texts(spark, sf_dir), "doc_id", "text", "list")


@query()
def masked_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protected tokens masked and put back; round_trip says that nothing changed."""
    rows = texts(spark, sf_dir).withColumn("m", python_text.mask("text"))
    back = python_text.unmask(F.col("m.masked"), F.col("m.tokens"))
    return rows.select("doc_id", F.col("m.masked").alias("masked"), F.size("m.tokens").alias("n_tokens"), (back == F.col("text")).alias("round_trip"))


@query()
def token_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protected tokens that cleaning loses."""
    cleaned = tx.squeeze_lines(tx.fix_encoding(F.col("text")))
    return texts(spark, sf_dir).select("doc_id", F.array_join(python_text.lost_tokens(F.col("text"), cleaned), "; ").alias("lost"))


@query()
def cleaning_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir).select("doc_id", "text", tx.clean(F.col("text")).alias("c"))
    return rows.select("doc_id", python_text.diff_stats("text", "c").alias("d")).select("doc_id", "d.removed", "d.normalized")


@query()
def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "The pump P-203 feeds HX-01 and V-102. MOV-101 isolates P-203! P-203 stands near K-12. PT-11 measures the pressure.")], "doc_id long, text string")
    return parsing.entity_edges(rows.unionByName(read(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", F.col("text"))


@query(
    f"""WITH {TEXTS}, {"l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM texts)"}, s AS (SELECT doc_id, pos, length(regexp_extract({s_strip("line")}, '^(#{{1,6}})\\s+(.*)$', 1)) AS md FROM l) SELECT doc_id, count(*) AS n_lines, count(CASE WHEN md > 0 THEN 1 END) AS n_headings FROM s GROUP BY doc_id"""
)
def document_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsing.text_lines(texts(spark, sf_dir), "doc_id", F.col("text"))
    heading = F.regexp_extract(tx.strip(F.col("line")), r"^(#{1,6})\s+(.*)$", 1) != ""
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count(F.when(heading, 1)).alias("n_headings"))


@query()
def structure_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.structure_issues(parsing.sections(texts(spark, sf_dir), "doc_id", F.col("text")), "doc_id")
