"""Labels, routing, reports and stage histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import modality
from . import fixtures
from .cleaning import s_encoding, s_strip
from .fixtures import cte
from .fixtures import literal as q
from .registry import TEXTS, query, texts

PAGES = [(1, "engineering_drawings/a.png", 3000, 2000, "DWG NO 12 P-203 HX-01 SCALE : 1:50", 0), (2, "scans/letter.png", 1000, 1500, "Subject : memo. " + "words " * 90, 3), (3, "neu/defect_1.png", 200, 200, "", 0), (4, "x/y.png", 1600, 1000, "P&ID report P-203 section 1 memo", 2), (5, "x/z.png", 0, 0, "", 0)]
MARKS = [(1, "see FIC-101 here"), (2, "P-203 pump"), (3, " a note "), (4, "PSV 22 and V-9999")]
CLAIMS = [("a.pdf", "DIRECT", "Pressure is 12 bar.", "[1]", 3, 1), ("a.pdf", "RELATED", "It runs.", "[2]", None, 2), ("b.pdf", "GENERIC_REQUIREMENT", "It shall be tested.", "[3]", 1, 3), ("c.pdf", "UNRELATED", "No.", "[4]", 1, 4)]
fixtures.TABLES |= {
    "fx_pages": (PAGES, "id int, path string, width int, height int, text string, paragraphs int"),
    "fx_marks": (MARKS, "id int, text string"),
    "fx_report": (CLAIMS, "document_name string, relation string, text string, citation string, page int, pos int"),
}


def _s_kind(a: str, b: str, c: str) -> str:
    return f"CASE WHEN regexp_matches(text, {q(modality.INSTRUMENT_TAG)}) THEN {a} WHEN regexp_matches(text, {q(modality.EQUIPMENT_TAG)}) THEN {b} ELSE {c} END"


@query(f"WITH {cte('fx_marks')} SELECT id, {_s_kind(q('instrument_tag'), q('equipment_tag'), q('note'))} AS kind, {_s_kind(f'regexp_extract(text, {q(modality.INSTRUMENT_TAG)}, 1)', f'regexp_extract(text, {q(modality.EQUIPMENT_TAG)}, 1)', s_strip('text'))} AS label FROM fx_marks")
def drawing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, "fx_marks", sf_dir).select("id", modality.label(F.col("text")).alias("m")).select("id", "m.kind", "m.label")


def _s_some(c: str, by: float) -> str:
    return f"CASE WHEN {c} THEN {by}::DOUBLE ELSE 0 END"


def _s_count(p: str) -> str:
    return f"len(regexp_extract_all(text, {q(p)}))"


@query(
    f"""WITH {cte("fx_pages")}, a AS (SELECT *, regexp_matches(lower(path), {q(modality.DRAWING_PATHS)}) AS hint, regexp_matches(lower(path), {q(modality.DOCUMENT_PATHS)}) AS doc, regexp_matches(lower(path), {q(modality.DEFECT_PATHS)}) AS defect, CASE WHEN height > 0 THEN width / height ELSE 1.0 END AS aspect FROM fx_pages),
b AS (SELECT *, {_s_some("hint", 4)} + least({_s_count(modality.DRAWING)}, 4) * 2 + least({_s_count(modality.TAG)}, 5) + {_s_some("aspect >= 1.35", 2.5)} + {_s_some("greatest(width, height) >= 2000 OR width >= 1600 AND aspect >= 1.35", 1.5)} AS drawing_score,
{_s_some("doc", 4)} + least({_s_count(modality.DOCUMENT)}, 4) * 2 + least(paragraphs, 5) * 2 + {_s_some("aspect <= 0.9 AND aspect > 0 AND NOT hint", 2)} + {_s_some("length(text) >= 400 AND paragraphs >= 1 AND aspect < 1.35", 2)} AS document_score FROM a)
SELECT id, drawing_score, document_score, CASE WHEN defect AND NOT hint AND NOT doc THEN 'visual_inspection' WHEN drawing_score >= 3 AND document_score >= 3 AND paragraphs >= 2 THEN 'mixed' WHEN drawing_score >= 3 AND drawing_score > document_score THEN 'engineering_drawing'
WHEN document_score >= 2 AND document_score >= drawing_score THEN 'plain_document' WHEN aspect >= 1.35 THEN 'engineering_drawing' ELSE 'plain_document' END AS decision FROM b"""
)
def modality_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = modality.route(*map(F.col, ("path", "width", "height", "text", "paragraphs")))
    return fixtures.table(spark, "fx_pages", sf_dir).select("id", r.alias("r")).select("id", "r.drawing_score", "r.document_score", "r.decision")


@query(
    f"""WITH {cte("fx_report")} SELECT CASE WHEN relation IN ('DIRECT', 'RELATED') THEN 'findings' ELSE 'requirements' END AS kind, document_name AS heading, string_agg(text || ' ' || citation || coalesce(' (page ' || page || ')', ''), chr(10) ORDER BY pos) AS bullets FROM fx_report WHERE relation <> 'UNRELATED' GROUP BY 1, 2"""
)
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modality.report_sections(fixtures.table(spark, "fx_report", sf_dir)).withColumn("bullets", F.array_join("bullets", "\n"))


@query(f"WITH {TEXTS} SELECT doc_id, 'encoding:' || length(text) || '>' || length({s_encoding('text')}) AS history FROM texts")
def stage_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = modality.with_history(texts(spark, sf_dir), "text", {"encoding": tx.fix_encoding})
    line = lambda h: F.format_string("%s:%d>%d", h["stage"], h["before"], h["after"])
    return rows.select("doc_id", F.array_join(F.transform("history", line), ",").alias("history"))
