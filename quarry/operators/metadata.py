"""Equipment, inheritance of document facts by chunks, payload rules, planned filters, evidence relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types by tag prefix, longest prefixes first, and by words near a tag.
PREFIXES = {
    "PSV-": "VALVE", "MOV-": "VALVE", "SDV-": "VALVE", "BDV-": "VALVE", "LIC-": "INSTRUMENT", "PIC-": "INSTRUMENT", "TIC-": "INSTRUMENT", "FIC-": "INSTRUMENT",
    "PIT-": "INSTRUMENT", "TIT-": "INSTRUMENT", "LIT-": "INSTRUMENT", "FIT-": "INSTRUMENT", "XV-": "VALVE", "HX-": "HEAT_EXCHANGER", "TK-": "TANK",
    "P-": "PUMP", "K-": "COMPRESSOR", "C-": "COMPRESSOR", "E-": "HEAT_EXCHANGER", "V-": "PRESSURE_VESSEL", "D-": "PRESSURE_VESSEL", "F-": "FURNACE", "H-": "FURNACE", "B-": "FURNACE",
}
KEYWORDS = {"pump": "PUMP", "compressor": "COMPRESSOR", "exchanger": "HEAT_EXCHANGER", "vessel": "PRESSURE_VESSEL", "tank": "TANK", "valve": "VALVE", "furnace": "FURNACE"}
EQUIPMENT = r"\b([A-Z]{1,4}-\d{2,4}[A-Z]?)\b"
PRESSURE = r"(?i)(\d+(?:\.\d+)?)\s*(bar[g]?|bar\(g\)|psi[g]?|kPa|MPa|kg/cm[2²]|atm)\b"
TEMPERATURE = r"(?i)(-?\d+(?:\.\d+)?)\s*(°\s*C|deg\s*C|degC|°\s*F|deg\s*F|degF)"
AROUND = 60
# Longest payload fields.
LENGTHS = {"document_id": 128, "chunk_id": 128, "document_name": 256, "plant_unit": 64, "section": 512}
NORMATIVE = r"(?i)\b(?:shall|must|mandatory|required|standard|regulation)\b"
RECORD = r"(?i)inspected on \d|\d+\.\d+\s*(?:mm|psi|bar|c|kg/cm2)|zero defects|thickness measured|observed read"


def equipment_type(tag: Column, near: Column) -> Column:
    by_prefix = F.coalesce(*[F.when(F.startswith(tag, F.lit(p)), t) for p, t in PREFIXES.items()])
    by_word = F.coalesce(*[F.when(F.contains(F.lower(near), F.lit(w)), t) for w, t in KEYWORDS.items()])
    return F.coalesce(by_prefix, by_word, F.lit("OTHER"))


def equipment(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, tag, equipment_type, pressure, temperature, char_offset of the first occurrence of each tag."""
    t = F.coalesce(text, F.lit(""))
    rows = docs.select(F.col(key), t.alias("t"), F.explode(F.array_distinct(F.regexp_extract_all(t, F.lit(EQUIPMENT), 1))).alias("tag"))
    # the tag as a whole word: its own place, not that of a longer tag which it begins
    at = F.length(F.substring_index(F.regexp_replace("t", F.concat(F.lit(r"\b"), "tag", F.lit(r"\b")), "\x00"), "\x00", 1))
    rows = rows.withColumn("char_offset", at)
    near = F.substr("t", F.greatest(F.col("char_offset") - AROUND, F.lit(0)) + 1, F.least(F.col("char_offset"), F.lit(AROUND)) + F.length("tag") + AROUND)
    rows = rows.withColumn("near", near)
    value = lambda p: F.when(F.col("near").rlike(p), F.concat_ws(" ", F.regexp_extract("near", p, 1), F.regexp_extract("near", p, 2)))
    return rows.select(key, "tag", equipment_type(F.col("tag"), F.col("near")).alias("equipment_type"), value(PRESSURE).alias("pressure"), value(TEMPERATURE).alias("temperature"), "char_offset")


def inherited(chunks: DataFrame, entities: DataFrame, doc: str, key: str, content: str) -> DataFrame:
    """doc, key, tags: the document's tags that a chunk contains, case apart."""
    own = entities.groupBy(doc).agg(F.array_sort(F.collect_set("tag")).alias("_tags"))
    joined = chunks.join(own, doc, "left")
    held = F.filter(F.coalesce("_tags", F.array().cast("array<string>")), lambda t: F.contains(F.upper(content), F.upper(t)))
    return joined.select(doc, key, held.alias("tags"))


def payload_problems(tag_length: int = 64) -> Column:
    """Names of what is wrong with a chunk's payload, in order."""
    c = F.col
    return F.array_compact(
        F.array(
            F.when(F.coalesce(c("chunk_id"), F.lit("")) == "", "chunk_id"),
            F.when(c("document_id").isNull(), "document_id"),
            *[F.when(F.length(c(n)) > k, f"length:{n}") for n, k in LENGTHS.items()],
            F.when(F.exists(F.coalesce(c("equipment"), F.array().cast("array<string>")), lambda t: F.length(t) > tag_length), "equipment_tag"),
        )
    )


def planned_filter(entities: Column) -> Column:
    """A predicate over chunk columns from a query's entities: its tags (any of them), first unit and first page."""
    tags, units, pages = entities["equipment_tags"], entities["plant_units"], entities["page_references"]
    by_tag = (F.size(tags) == 0) | F.coalesce(F.arrays_overlap(F.col("equipment"), tags), F.lit(False))
    by_unit = (F.size(units) == 0) | F.coalesce(F.col("plant_unit") == units[0], F.lit(False))
    by_page = (F.size(pages) == 0) | F.coalesce(F.col("page") == pages[0].cast("int"), F.lit(False))
    return by_tag & by_unit & by_page


def filtered_counts(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, n_chunks, first_chunk for queries (query_id, e) by planned_filter.

    A query meets chunks by one key that both have, its tags, or its unit, or its
    page; one without any has all chunks, which are counted once.
    """
    tags, units, pages = F.col("e.equipment_tags"), F.col("e.plant_units"), F.col("e.page_references")
    key = lambda kind, v: F.concat(F.lit(f"{kind}:"), v.cast("string"))
    wanted = F.when(F.size(tags) > 0, F.transform(tags, lambda t: key("t", t))).when(F.size(units) > 0, F.array(key("u", units[0]))).when(F.size(pages) > 0, F.array(key("p", pages[0].cast("int"))))
    asked = queries.select("query_id", "e", F.explode(wanted).alias("_key"))
    own = F.concat(F.transform(F.array_distinct("equipment"), lambda t: key("t", t)), F.array(key("u", F.col("plant_unit")), key("p", F.col("page"))))
    keyed = chunks.select("chunk_id", "equipment", "plant_unit", "page", F.explode(F.array_compact(own)).alias("_key"))
    met = asked.join(keyed, "_key").where(planned_filter(F.col("e"))).groupBy("query_id").agg(F.countDistinct("chunk_id").alias("n_chunks"), F.min("chunk_id").alias("first_chunk"))
    every = chunks.agg(F.count("chunk_id").alias("_n"), F.min("chunk_id").alias("_first"))
    rows = queries.select("query_id", wanted.isNull().alias("_all")).join(met, "query_id", "left").crossJoin(every)  # one row
    return rows.select("query_id", F.when(F.col("_all"), F.col("_n")).otherwise(F.coalesce("n_chunks", F.lit(0))).alias("n_chunks"), F.when(F.col("_all"), F.col("_first")).otherwise(F.col("first_chunk")).alias("first_chunk"))


# K, neighbours, weights and context tokens by intent; the last row is for all others.
ADAPTIVE = [("equipment_lookup", 5, 1, 0.3, 0.7, 2500), ("safety_lookup", 15, 2, 0.5, 0.5, 4000), ("maintenance_lookup", 15, 2, 0.4, 0.6, 3500), ("specification_lookup", 8, 1, 0.4, 0.6, 2500), ("table_lookup", 8, 2, 0.3, 0.7, 3500), ("troubleshooting", 30, 3, 0.6, 0.4, 6000), ("comparison", 20, 2, 0.6, 0.4, 4500), (None, 10, 1, 0.6, 0.4, 3000)]


def adaptive(intent: Column) -> Column:
    """Struct of k, radius, dense_weight, bm25_weight, budget for an intent."""
    made = lambda r: F.struct(*[F.lit(v).alias(n) for n, v in zip(("k", "radius", "dense_weight", "bm25_weight", "budget"), r[1:], strict=True)])
    return F.coalesce(*[F.when(intent == r[0], made(r)) for r in ADAPTIVE[:-1]], made(ADAPTIVE[-1]))


def relation(requested: Column, found: Column, overlap: Column, score: Column, text: Column, has_terms: Column) -> Column:
    """How evidence stands to a query: DIRECT, RELATED, GENERIC_REQUIREMENT or UNRELATED."""
    asked, own = F.size(requested) > 0, F.size(found) > 0
    meets = F.arrays_overlap(requested, found)
    rule = text.rlike(NORMATIVE) & ~text.rlike(RECORD)
    at = lambda o, s: (overlap >= o) | (score >= s)
    return (
        F.when(asked & own & ~meets, "UNRELATED")
        .when(asked & own, F.when(rule, "GENERIC_REQUIREMENT").when(at(0.20, 0.70), "DIRECT").otherwise("RELATED"))
        .when(asked & rule, F.when(at(0.20, 0.65), "GENERIC_REQUIREMENT").otherwise("UNRELATED"))
        .when(asked, F.when(at(0.30, 0.70), "RELATED").otherwise("UNRELATED"))
        .when(has_terms & rule, F.when(at(0.30, 0.65), "GENERIC_REQUIREMENT").otherwise("UNRELATED"))
        .when(has_terms, F.when(at(0.35, 0.70), "DIRECT").when(at(0.20, 0.50), "RELATED").otherwise("UNRELATED"))
        .otherwise("UNRELATED")
    )


def compared_versions(old: DataFrame, new: DataFrame, key: str, mark: str) -> DataFrame:
    """change, n between two versions of a table."""
    from .vectors import changes

    return changes(old, new, key, mark).groupBy("change").agg(F.count("*").alias("n"))
