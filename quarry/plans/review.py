"""Findings, claims, drawing metadata and error rates on inline rows, beside the given texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import review
from . import fixtures
from .fixtures import cte
from .fixtures import literal as q
from .registry import query, read

REPORTS = [(1, "Status: Pass\nWall Thickness: 12.5 mm\nConclusion - repair  required; Thickness: 9 mm"), (2, "Wear PPE, helmet and safety  shoes. A hot work permit and PTW are needed. Design Pressure: 12 bar; Head: 40 m"), (3, "This pump is safe to operate at 12 bar and 80 °C, 300 mm wide, inferred connection."), (4, "")]
BLOCKS = [("d1", 1, "DWG NO: AB-1001"), ("d1", 2, "REV: 3 SCALE: 1:50"), ("d1", 3, "REV: 4 DATE: 12/05/2024"), ("d2", 1, "UNIT: CDU-1"), ("d2", 2, "nothing")]
DRAWINGS = [(1, "Process Flow Sheet", "PFD"), (2, "Pump sectional", "Electrical"), (3, None, "PFD"), (4, "x", "Unknown_Kind"), (5, "Single-Line", "Electrical")]
CELLS = [("t", 0, 0, "Tag"), ("t", 0, 1, "Value"), ("t", 1, 0, "P-203"), ("t", 1, 1, "12 bar")]
SEEN = [("t", 0, 0, "Tag"), ("t", 0, 1, "value "), ("t", 1, 1, "12 bars"), ("t", 2, 0, "extra")]
fixtures.TABLES |= {
    "fx_reports": (REPORTS, "doc_id long, text string"),
    "fx_title": (BLOCKS, "doc string, pos int, text string"),
    "fx_drawings": (DRAWINGS, "id int, predicted string, expected string"),
    "fx_cells": (CELLS, "doc_id string, row_idx int, col_idx int, text string"),
    "fx_seen": (SEEN, "doc_id string, row_idx int, col_idx int, text string"),
}
R = cte("fx_reports") + ", reports AS (SELECT doc_id - 100 AS doc_id, text FROM fx_reports UNION ALL SELECT doc_id, text FROM documents)"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, "fx_reports").select((F.col("doc_id") - 100).alias("doc_id"), "text")
    return rows.unionByName(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"WITH {R} SELECT doc_id, len(regexp_extract_all(text, {q(review.FINDING)}, 1))::INTEGER AS n_findings, array_to_string(regexp_extract_all(text, {q(review.THICKNESS)}, 1), '; ') AS thicknesses, len(regexp_extract_all(text, {q(review.LIMIT)}, 1))::INTEGER AS n_limits FROM reports")
def inspection_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = review.inspection(F.col("text"))
    return reports(spark, sf_dir).select("doc_id", i.alias("i"), review.design_limits(F.col("text")).alias("n_limits")).select("doc_id", F.size("i.findings").alias("n_findings"), F.array_join("i.thicknesses", "; ").alias("thicknesses"), "n_limits")


@query()
def safety_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select("doc_id", review.safety_terms(F.col("text")).alias("s")).select("doc_id", F.array_join("s.ppe", "; ").alias("ppe"), F.array_join("s.permits", "; ").alias("permits"))


@query(f"WITH {R} SELECT doc_id, array_to_string(list_sort(list_filter([{', '.join(f'CASE WHEN regexp_matches(text, {q(p)}) THEN {q(n)} END' for n, p in review.CLAIMS)}], lambda x: x IS NOT NULL)), ',') AS flags FROM reports")
def claim_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).select("doc_id", F.array_join(review.claim_flags(F.col("text"), F.lit("PFD")), ",").alias("flags"))


@query(f"WITH {cte('fx_drawings')} SELECT id, CASE WHEN coalesce(trim(predicted), '') = '' THEN NULL " + " ".join(f"WHEN expected = {q(c)} THEN {' OR '.join(f'contains(lower(trim(predicted)), {q(w)})' for w in words)}" for c, words in review.DRAWING_WORDS.items()) + " END AS matches FROM fx_drawings")
def drawing_type_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, "fx_drawings", sf_dir).select("id", review.type_matches(F.col("predicted"), F.col("expected")).alias("matches"))


def _s_field(n: str, p: str) -> str:
    return f"arg_min(regexp_extract(text, {q(p)}, 1), pos) FILTER (regexp_matches(text, {q(p)})) AS {n}"


@query(f"WITH {cte('fx_title')} SELECT doc, {', '.join(_s_field(n, p) for n, p in review.TITLE_BLOCK.items())} FROM fx_title GROUP BY doc")
def title_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.title_block(fixtures.table(spark, "fx_title", sf_dir), "doc", "pos", "text")


@query(f"WITH {cte('fx_cells', 'fx_seen')} SELECT coalesce(t.doc_id, f.doc_id) AS doc_id, count(t.text) AS cells, count(CASE WHEN t.text = f.text THEN 1 END) AS exact, count(CASE WHEN lower(trim(t.text)) = lower(trim(f.text)) THEN 1 END) AS normalized FROM fx_cells t FULL OUTER JOIN fx_seen f ON t.doc_id = f.doc_id AND t.row_idx = f.row_idx AND t.col_idx = f.col_idx GROUP BY 1")
def table_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.cell_accuracy(fixtures.table(spark, "fx_cells", sf_dir), fixtures.table(spark, "fx_seen", sf_dir))


@query()
def word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, "fx_ocr", sf_dir).select("id", review.word_errors("reference", "hypothesis").alias("wer"))


@query()
def group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, "fx_ocr", sf_dir).withColumn("kind", F.when(F.col("confidence") >= 0.7, "clean").otherwise("degraded"))
    return review.group_metrics(rows, "kind")
