"""Findings, safety terms and limits in texts; checks of what models say; drawing metadata; error rates by group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of findings, protective equipment, permits, design limits.
FINDING = r"(?i)(?:Status|Finding|Result|Conclusion|Recommendation)[\s.:-]+(Pass|Fail|Satisfactory|Acceptable|Defective|Repair\s+Required|Replace)"
THICKNESS = r"(?i)(?:Thickness|Wall\s+Thickness|Remaining\s+Thickness)[\s.:-]+(\d+(?:\.\d+)?\s*(?:mm|inch|in))\b"
PROTECTIVE = r"(?i)\b(?:PPE|Protective\s+Equipment|Helmet|Safety\s+Shoes|Safety\s+Goggles|Ear\s+Plugs|SCBA|Breathing\s+Apparatus|Fire\s+Suit|Face\s+Shield)\b"
PERMIT = r"(?i)\b(?:Cold\s+Work\s+Permit|Hot\s+Work\s+Permit|Confined\s+Space\s+Entry|Working\s+at\s+Height|Electrical\s+Isolation|PTW)\b"
LIMIT = r"(?i)(?:Design\s+Pressure|Operating\s+Pressure|Design\s+Temperature|Operating\s+Temperature|Flow\s+Rate|Design\s+Capacity|Head|Power\s+Rating)[\s.:-]+([^\n;]+)"
# Claims that a picture alone cannot bear out, with their flags.
CLAIMS = [
    ("unsupported_pressure_value", r"(?i)\b\d+(?:\.\d+)?\s*(?:bar|psi|kpa|mpa|atm)\b"),
    ("unsupported_temperature_value", r"(?i)\b\d+(?:\.\d+)?\s*(?:°C|°F|deg\s*C|deg\s*F|Kelvin|K\b)"),
    ("unsupported_dimension", r"(?i)\b\d+(?:\.\d+)?\s*(?:mm|cm|inches|inch|meters|m\b)"),
    ("unsupported_safety_conclusion", r"(?i)\b(?:equipment is safe|safe to operate|fully compliant|risk-free|no safety hazard|operable condition|satisfactory operating condition|safe condition|operating within safe limits|danger-free|guaranteed safe)\b"),
    ("unsupported_connected_to_relationship", r"(?i)\b(?:connected to .* based on proximity|connected because .* adjacent|assumed connected|inferred connection|connects .* based on proximity|connected due to proximity)\b"),
]
DIMENSIONAL = ("Equipment_Drawings", "Pump_Diagrams")
# Words of each kind of drawing.
DRAWING_WORDS = {
    "PFD": ["pfd", "process flow", "flowsheet", "flow sheet"],
    "Equipment_Drawings": ["equipment", "mechanical drawing", "assembly drawing", "fabrication drawing", "sectional", "vessel drawing", "heat exchanger drawing", "cutaway"],
    "Instrumentation": ["instrumentation", "control loop", "instrument loop", "control schematic", "loop diagram", "instrument drawing"],
    "Pump_Diagrams": ["pump"],
    "Electrical": ["electrical", "single line", "single-line", "sld", "one-line diagram", "power distribution", "wiring diagram"],
}
TITLE_BLOCK = {
    "drawing_number": r"(?i)\b(?:DRAWING|DWG)\s*(?:NO\.?|NUMBER)?[.:\s]+([A-Z0-9][A-Z0-9_-]{2,30})\b",
    "revision": r"(?i)\b(?:REV(?:ISION)?)[.:\s]*([A-Z0-9]{1,5})\b",
    "scale": r"(?i)\bSCALE[:\s]+([0-9]+:[0-9]+|NTS|NONE|AS NOTED)\b",
    "date": r"(?i)\b(?:DATE)[:\s]+(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})\b",
    "plant_unit": r"(?i)\b(?:UNIT|PLANT|AREA)[:\s]+([A-Z0-9_-]{2,20})\b",
}


def _all(t: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(t, F.lit(pattern), group)


def inspection(t: Column) -> Column:
    """Struct of findings, thicknesses and the overall (last) finding."""
    found = F.transform(_all(t, FINDING, 1), F.initcap)
    return F.struct(found.alias("findings"), _all(t, THICKNESS, 1).alias("thicknesses"), F.when(F.size(found) > 0, F.element_at(found, -1)).alias("overall"))


def safety_terms(t: Column) -> Column:
    """Struct of the protective equipment and the permits that a text names."""
    named = lambda p: F.array_sort(F.array_distinct(F.transform(_all(t, p), lambda x: F.initcap(F.regexp_replace(x, r"\s+", " ")))))
    return F.struct(named(PROTECTIVE).alias("ppe"), named(PERMIT).alias("permits"))


def design_limits(t: Column) -> Column:
    return F.size(_all(t, LIMIT, 1))


def claim_flags(t: Column, category: Column) -> Column:
    """Sorted flags of claims; dimensions may stand in drawings that show them."""
    out = [F.when(t.rlike(p) & (~category.isin(*DIMENSIONAL) if name == "unsupported_dimension" else F.lit(True)), name) for name, p in CLAIMS]
    return F.array_sort(F.array_compact(F.array(*out)))


def type_matches(predicted: Column, expected: Column) -> Column:
    """Whether a drawing type fits a category; null if either is unknown."""
    low = F.lower(F.trim(predicted))
    out = F.lit(None).cast("boolean")
    for category, words in DRAWING_WORDS.items():
        out = F.when(expected == category, F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))).otherwise(out)
    return F.when(F.coalesce(low, F.lit("")) != "", out)


def title_block(blocks: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """The first value of each field, in block order."""
    value = lambda p: F.when(F.col(text).rlike(p), F.regexp_extract(text, p, 1))
    return blocks.groupBy(doc).agg(*[F.min_by(value(p), F.when(F.col(text).rlike(p), F.col(order))).alias(n) for n, p in TITLE_BLOCK.items()])


def disjoint_tags(a: DataFrame, b: DataFrame, doc: str) -> DataFrame:
    """Documents whose two tag lists (doc, tag) share nothing although both have some."""
    x, y = (d.groupBy(doc).agg(F.array_sort(F.collect_set(F.upper("tag"))).alias(n)) for d, n in ((a, "first"), (b, "second")))
    return x.join(y, doc).where(~F.arrays_overlap("first", "second"))


@F.pandas_udf(T.DoubleType())
def word_errors(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Word edits over reference words; 0 or 1 if the reference has none."""

    def one(a: str | None, b: str | None) -> float:
        x, y = (a or "").split(), (b or "").split()
        row = list(range(len(y) + 1))
        for i, w in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, v in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (w != v))
        return row[-1] / len(x) if x else float(bool(y))

    return pd.Series([one(a, b) for a, b in zip(reference, hypothesis, strict=True)], dtype="float64")


def group_metrics(rows: DataFrame, by: str) -> DataFrame:
    """Share of exact rows, mean character error and mean confidence of each group, and of all."""
    from .evaluation import character_errors

    exact = (F.trim("reference") == F.trim("hypothesis")).cast("int")
    return rows.withColumns({"cer": character_errors(F.col("reference"), F.col("hypothesis")), "exact": exact}).rollup(by).agg(F.count("*").alias("n"), F.avg("exact").alias("exact_rate"), F.avg("cer").alias("mean_cer"), F.avg("confidence").alias("mean_confidence"))


def cell_accuracy(truth: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, cells, exact, normalized: cells (doc_id, row_idx, col_idx, text) found alike, exactly and but for case and blanks."""
    keys = ["doc_id", "row_idx", "col_idx"]
    both = truth.select(*keys, F.col("text").alias("t")).join(found.select(*keys, F.col("text").alias("f")), keys, "full_outer")
    bare = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    hit = lambda e: F.coalesce(F.sum(e.cast("int")), F.lit(0))
    return both.groupBy("doc_id").agg(F.count("t").alias("cells"), hit(F.col("t") == F.col("f")).alias("exact"), hit(bare("t") == bare("f")).alias("normalized"))


# Short names of embedding models.
ALIASES = {"minilm": "sentence-transformers/all-MiniLM-L6-v2", "bge-small": "BAAI/bge-small-en-v1.5", "e5-small": "intfloat/e5-small-v2"}


def model_name(alias: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), F.lower(alias)), alias)


def with_fallback(strict: DataFrame, loose: DataFrame, by: str) -> DataFrame:
    """Hits of the filtered search; for queries that have none, those of the unfiltered one."""
    return strict.unionByName(loose.join(strict.select(by).distinct(), by, "left_anti"))
