"""Fields of inspection reports, what vision models say, recognised records: text to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intents import once
from ..functions.text import strip

# Fields of an inspection report, by pattern and group; those that everything after depends on.
FIELDS = {
    "equipment_id": (r"(?i)Equipment\s+(?:ID|Tag)[^:]*:[\s*]+([A-Z0-9][A-Z0-9\-]+)(?:\s*\((.*?)\))?", 1),
    "equipment_name": (r"(?i)Equipment\s+(?:ID|Tag)[^:]*:[\s*]+([A-Z0-9][A-Z0-9\-]+)(?:\s*\((.*?)\))?", 2),
    "report_no": (r"(?i)Report\s+(?:No|ID|Number)[^:]*:[\s*]+([A-Z0-9][A-Z0-9\-]+)", 1),
    "design_pressure": (r"(?i)Design\s+Pressure[^:]*:[\s*]+([\d.]+)\s*(kg/cm2g|psig|bar|kpa|MPa|psi)?", 1),
    "pressure_unit": (r"(?i)Design\s+Pressure[^:]*:[\s*]+([\d.]+)\s*(kg/cm2g|psig|bar|kpa|MPa|psi)?", 2),
    "design_temperature": (r"(?i)Design\s+Temperature[^:]*:[\s*]+([\d.]+)\s*[°]?C?", 1),
    "shell_original": (r"(?i)Shell\s*\(Bottom\)[\s|]+([\d.]+)[\s|]+([\d.]+)", 1),
    "shell_least": (r"(?i)Shell\s*\(Bottom\)[\s|]+([\d.]+)[\s|]+([\d.]+)", 2),
    "head_original": (r"(?i)Head\s*\(Top\)[\s|]+([\d.]+)[\s|]+([\d.]+)", 1),
    "head_least": (r"(?i)Head\s*\(Top\)[\s|]+([\d.]+)[\s|]+([\d.]+)", 2),
    "inspector": (r"(?i)Inspector[^:]*:[\s*]+(.+)", 1),
    "recommendation": (r"(?i)Recommendation[:\s]+(.+)", 1),
}
NUMBERS = ("design_pressure", "design_temperature", "shell_original", "shell_least", "head_original", "head_least")
CRITICAL = ("equipment_id", "design_pressure", "shell_least")
# Scenes and kinds of drawings by keyword, in order; words of hedged and of forbidden observations; wear.
SCENES = (
    ("engineering_drawing", "engineering_drawing"), ("p&id", "P&ID"), ("pid", "P&ID"), ("pfd", "PFD"), ("plant_layout", "plant_layout"), ("control_panel", "control_panel"), ("heat_exchanger", "heat_exchanger"), ("storage_tank", "storage_tank"), ("compressor", "compressor"),
    ("instrumentation", "instrumentation"), ("inspection", "inspection"), ("electrical", "electrical"), ("reactor", "reactor"), ("boiler", "boiler"), ("pump", "pump"), ("valve", "valve"), ("industrial_equipment", "industrial_equipment"),
)
DRAWINGS = (("p&id", "PID"), ("pid", "PID"), ("piping and instrumentation", "PID"), ("pfd", "PFD"), ("process flow", "PFD"), ("equipment", "EQUIPMENT"), ("instrumentation", "INSTRUMENTATION"), ("electrical", "ELECTRICAL"), ("plant layout", "PLANT_LAYOUT"), ("plant_layout", "PLANT_LAYOUT"), ("pump", "PUMP"), ("cad", "CAD"))
HEDGED = r"(?i)\b(possible|appears|visible|like|may|could|suggest|potential|observation|discoloration|crack|corrosion|rust|leak|damage|worn)\b"
FORBIDDEN = r"(?i)\b(is unsafe|will fail|must be|definitely)\b"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def report_fields(text: Column) -> Column:
    """Struct of a report's fields, null where the text has none, and of the critical ones that are missing; nothing is made up."""
    found = {name: F.nullif(F.trim(F.regexp_extract(text, p, i)), F.lit("")) for name, (p, i) in FIELDS.items()}
    typed = {n: c.try_cast("double") if n in NUMBERS else c for n, c in found.items()}
    missing = F.array_compact(F.array(*[F.when(typed[n].isNull(), n) for n in CRITICAL]))
    return F.struct(*[c.alias(n) for n, c in typed.items()], missing.alias("missing_critical"))


def sanitized(text: Column) -> Column:
    return strip(F.regexp_replace(text, CONTROL, ""))


def by_keyword(text: Column, table: tuple[tuple[str, str], ...], other: str) -> Column:
    """The name of the first keyword that a text has."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(k)), v) for k, v in table], F.lit(other))


def model_text(text: Column) -> Column:
    """Struct of scene, drawing, caption (two sentences), confidence by length, quoted labels, hedged observations of what a vision model wrote."""

    def told(t: Column) -> Column:
        n = F.length(t)
        quoted = lambda most: F.regexp_extract_all(t, F.lit(f'"([^"]{{2,{most}}})"'), 1)
        bare = F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(F.trim(x), r"^[*\-•1-9. ]+", ""))
        seen = F.filter(bare, lambda x: (F.length(x) >= 15) & ~x.rlike(FORBIDDEN) & x.rlike(HEDGED))
        return F.struct(
            by_keyword(t, SCENES, "unknown").alias("scene"),
            by_keyword(t, DRAWINGS, "UNKNOWN").alias("drawing"),
            F.array_join(F.slice(F.split(t, r"(?<=[.!?])\s+"), 1, 2), " ").alias("caption"),
            F.when(n < 20, 0.4).when(n < 100, 0.65).otherwise(0.8).alias("confidence"),
            F.slice(quoted(60), 1, 10).alias("labels"),  # ten at most, which is the feature
            F.transform(seen, lambda x: F.substring(x, 1, 400)).alias("observations"),
        )

    return once(sanitized(F.coalesce(text, F.lit(""))), told)


def recognised(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """key, pos, text, confidence (cut to 0..1), left, top, right, bottom of recognised records, in reading order.

    raw is JSON: an object of rec_polys, rec_texts and rec_scores, or a list of
    [polygon, [text, confidence]] records. A text that is neither, or null, has none.
    """
    new = F.from_json(F.col(raw), "rec_polys array<array<array<double>>>, rec_texts array<string>, rec_scores array<double>")
    pairs = F.arrays_zip(new["rec_polys"].alias("polygon"), new["rec_texts"].alias("text"), new["rec_scores"].alias("confidence"))
    part = lambda r, i: F.get(F.from_json(r, "array<string>"), F.lit(i))
    old = F.transform(F.from_json(F.col(raw), "array<string>"), lambda r: F.struct(F.from_json(part(r, 0), "array<array<double>>").alias("polygon"), part(part(r, 1), 0).alias("text"), part(part(r, 1), 1).try_cast("double").alias("confidence")))
    either = F.when(F.startswith(F.ltrim(F.col(raw)), F.lit("[")), old).otherwise(F.transform(pairs, lambda p: F.struct(p["polygon"].alias("polygon"), p["text"].alias("text"), p["confidence"].alias("confidence"))))
    found = rows.select(F.col(key), F.explode(either).alias("r")).where(F.col("r.polygon").isNotNull() & F.col("r.text").isNotNull())
    side = lambda f, i: f(F.transform("r.polygon", lambda p: p[i]))
    boxed = found.select(key, "r.text", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("r.confidence"))).alias("confidence"), side(F.array_min, 0).alias("left"), side(F.array_min, 1).alias("top"), side(F.array_max, 0).alias("right"), side(F.array_max, 1).alias("bottom"))
    placed = boxed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((F.bround(F.col("top") / 10) * 10).alias("line"), "left", "top", "text", "confidence", "right", "bottom"))).alias("b"))
    return placed.select(key, F.posexplode("b").alias("pos", "x")).select(key, "pos", "x.text", "x.confidence", "x.left", "x.top", "x.right", "x.bottom")


def capped(score: Column) -> Column:
    """A score cut to 0..1, as results show it."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def mean_confidence(rows: DataFrame, by: str, confidence: str, trusted: float) -> DataFrame:
    """by, mean (null if nothing was measured), n_trusted: a null confidence is left out and never trusted."""
    return rows.groupBy(by).agg(F.avg(confidence).alias("mean"), F.count(F.when(F.coalesce(F.col(confidence) >= trusted, F.lit(False)), 1)).alias("n_trusted"))
