"""Labels, routing and canonical text of scanned pages; reports from evidence; histories of stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# Words that speak for a drawing or for a document, tags, and hints in paths.
DRAWING = r"(?i)\b(P&ID|PFD|PIPING\s+AND\s+INSTRUMENTATION|PROCESS\s+FLOW\s+DIAGRAM|SINGLE\s+LINE\s+DIAGRAM|SLD|SCHEMATIC|FLOW\s+SHEET|DWG\s*(?:NO|\.)?|DRAWING\s*(?:NO|\.)?|SCALE\s*:|REVISION\s*:|LINE\s+NO|NOZZLE\s+SCHEDULE|INSTRUMENT\s+SCHEDULE|SUCTION|DISCHARGE|CENTRIFUGAL\s+PUMP|HEAT\s+EXCHANGER|PRESSURE\s+VESSEL)\b"
DOCUMENT = r"(?i)\b(MEMORANDUM|MEMO|REPORT|INVOICE|FORM|PURCHASE\s+ORDER|TABLE\s+\d|SECTION\s+\d|PARAGRAPH|SIGNATURE|EXECUTIVE\s+SUMMARY|DATE\s*:|SUBJECT\s*:|TO\s*:|FROM\s*:|ATTENTION\s*:|DEAR\s+)\b"
TAG = r"\b([A-Z]{1,4}-\d{2,5}[A-Z]?|[A-Z]{2,3}\s*\d{2,4}[A-Z]?)\b"
INSTRUMENT_TAG = r"\b((?:[FLPTA](?:I|T|C|IC|IT|E|V|S|AL|AH)|PSV|PRV|MOV|FCV|LCV|PCV|TCV)[-_ ]?\d{2,5}[A-Z]?)\b"
EQUIPMENT_TAG = r"\b([A-Z]{1,3}-\d{2,5}[A-Z]?)\b"
DRAWING_PATHS = r"engineering_drawings|pid|pfd|drawing|dwg|diagram|schematic"
DOCUMENT_PATHS = r"funsd|handwritten_notes|safety_docs|form|report|memo"
DEFECT_PATHS = r"defect|infrared|inspection|corrosion|anomaly|crazing|pitting|scratch|inclusion|surface"


def label(text: Column) -> Column:
    """Struct of kind (instrument_tag, equipment_tag, note) and label of a block; instruments win."""
    kind = F.when(text.rlike(INSTRUMENT_TAG), "instrument_tag").when(text.rlike(EQUIPMENT_TAG), "equipment_tag").otherwise("note")
    value = F.when(text.rlike(INSTRUMENT_TAG), F.regexp_extract(text, INSTRUMENT_TAG, 1)).when(text.rlike(EQUIPMENT_TAG), F.regexp_extract(text, EQUIPMENT_TAG, 1)).otherwise(strip(text))
    return F.struct(kind.alias("kind"), value.alias("label"))


def route(path: Column, width: Column, height: Column, text: Column, paragraphs: Column) -> Column:
    """Struct of drawing_score, document_score and decision for a page image and its text."""
    low = F.lower(path)
    hint, doc_hint, defect = low.rlike(DRAWING_PATHS), low.rlike(DOCUMENT_PATHS), low.rlike(DEFECT_PATHS)
    aspect = F.when(height > 0, width / height).otherwise(1.0)
    wide, tall = aspect >= 1.35, (aspect <= 0.9) & (aspect > 0)
    large = (F.greatest(width, height) >= 2000) | (width >= 1600) & wide
    n = lambda p: F.regexp_count(text, F.lit(p))
    some = lambda c, by: F.when(c, by).otherwise(0.0)
    drawing = some(hint, 4.0) + F.least(n(DRAWING), F.lit(4)) * 2.0 + F.least(n(TAG), F.lit(5)) * 1.0 + some(wide, 2.5) + some(large, 1.5)
    document = some(doc_hint, 4.0) + F.least(n(DOCUMENT), F.lit(4)) * 2.0 + F.least(paragraphs, F.lit(5)) * 2.0 + some(tall & ~hint, 2.0) + some((F.length(text) >= 400) & (paragraphs >= 1) & ~wide, 2.0)
    decision = (
        F.when(defect & ~hint & ~doc_hint, "visual_inspection")
        .when((drawing >= 3) & (document >= 3) & (paragraphs >= 2), "mixed")
        .when((drawing >= 3) & (drawing > document), "engineering_drawing")
        .when((document >= 2) & (document >= drawing), "plain_document")
        .when(wide, "engineering_drawing")
        .otherwise("plain_document")
    )
    return F.struct(drawing.alias("drawing_score"), document.alias("document_score"), decision.alias("decision"))


def canonical_text(sections: DataFrame, doc: str) -> DataFrame:
    """doc, text: sections (page, pos, title, content) in order, titles kept, pages apart."""
    part = F.concat_ws("\n", F.nullif("title", F.lit("")), "content")
    pages = sections.groupBy(doc, "page").agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("t")))).alias("s"))
    whole = F.array_sort(F.collect_list(F.struct("page", F.array_join(F.transform("s", lambda x: x["t"]), "\n\n").alias("t"))))
    return pages.groupBy(doc).agg(F.array_join(F.transform(whole, lambda x: x["t"]), "\n\n").alias("text"))


def connections_of(edges: DataFrame, tag: str) -> DataFrame:
    """Connections (from_tag, to_tag) with a tag at either end, case apart."""
    t = tag.upper()
    return edges.where((F.upper("from_tag") == t) | (F.upper("to_tag") == t))


def trusted(rows: DataFrame, least: float) -> DataFrame:
    """Rows whose confidence is measured and high enough."""
    return rows.where(F.coalesce(F.col("confidence") >= least, F.lit(False)))


def report_sections(claims: DataFrame) -> DataFrame:
    """kind, heading, bullets of claims (document_name, relation, text, citation, page, pos): findings of each document, then requirements of each."""
    kind = F.when(F.col("relation").isin("DIRECT", "RELATED"), "findings").when(F.col("relation") == "GENERIC_REQUIREMENT", "requirements")
    line = F.concat_ws(" ", "text", "citation", F.concat(F.lit("(page "), F.col("page").cast("string"), F.lit(")")))
    rows = claims.withColumns({"kind": kind, "line": line}).where("kind is not null")
    return rows.groupBy("kind", F.col("document_name").alias("heading")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("bullets"))


def with_history(rows: DataFrame, text: str, stages: dict) -> DataFrame:
    """Applies named column stages in order; history has the name and the characters before and after of each."""
    rows = rows.withColumn("history", F.array().cast("array<struct<stage: string, before: int, after: int>>"))
    for name, stage in stages.items():
        rows = rows.withColumn("_next", stage(F.col(text)))
        step = F.struct(F.lit(name).alias("stage"), F.length(text).alias("before"), F.length("_next").alias("after"))
        rows = rows.withColumn("history", F.array_append("history", step)).withColumn(text, F.col("_next")).drop("_next")
    return rows
