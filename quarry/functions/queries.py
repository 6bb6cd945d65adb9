"""Query processing: normalising, expanding, rewriting, entities and intent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, strip, tokens, words

# Stop words, acronyms, synonyms, spellings and intent words.
STOPWORDS = (
    "what", "is", "the", "a", "an", "and", "or", "of", "for", "in", "on", "at", "to", "by", "with", "from", "as", "are", "were", "was", "be", "been", "being", "have", "has", "had",
    "do", "does", "did", "can", "could", "should", "would", "shall", "will", "may", "might", "must", "about", "which", "who", "whom", "this", "that", "these", "those", "it", "its",
    "give", "tell", "show", "me", "please", "state", "describe", "explain",
)
ACRONYMS = {
    "MOV": "Motor Operated Valve",
    "PRV": "Pressure Relief Valve",
    "PSV": "Pressure Safety Valve",
    "CDU": "Crude Distillation Unit",
    "VDU": "Vacuum Distillation Unit",
    "DCU": "Delayed Coker Unit",
    "NHT": "Naphtha Hydrotreater",
    "CCR": "Continuous Catalytic Reformer",
    "FCCU": "Fluidized Catalytic Cracking Unit",
    "DHDS": "Diesel Hydrodesulfurization",
    "HGU": "Hydrogen Generation Unit",
    "SRU": "Sulfur Recovery Unit",
    "SOP": "Standard Operating Procedure",
    "NDT": "Non-Destructive Testing",
    "UT": "Ultrasonic Testing",
    "MPT": "Magnetic Particle Testing",
    "DPT": "Dye Penetrant Testing",
    "P&ID": "Piping and Instrumentation Diagram",
    "PID": "Piping and Instrumentation Diagram",
    "PFD": "Process Flow Diagram",
    "ESD": "Emergency Shutdown",
    "DCS": "Distributed Control System",
    "PLC": "Programmable Logic Controller",
    "OISD": "Oil Industry Safety Directorate",
    "PNGRB": "Petroleum and Natural Gas Regulatory Board",
}
SPELLING = {
    "lubricaton": "lubrication",
    "pressue": "pressure",
    "temprature": "temperature",
    "temperatue": "temperature",
    "centrifual": "centrifugal",
    "vibraton": "vibration",
    "overhual": "overhaul",
    "maintenence": "maintenance",
    "maintanance": "maintenance",
    "clearence": "clearance",
    "impellar": "impeller",
    "flange": "flange",
    "vavle": "valve",
}
SYNONYMS = {
    "pump": ["centrifugal pump", "impeller", "casing", "suction", "discharge"],
    "valve": ["actuator", "seat", "bonnet", "stem", "disk", "closure"],
    "heat exchanger": ["cooler", "condenser", "reboiler", "tube bundle", "shell"],
    "compressor": ["rotor", "stator", "vane", "stage", "seal", "reciprocating"],
    "inspection": ["ndt", "ultrasonic testing", "visual inspection", "thickness", "wall loss"],
    "pressure": ["discharge pressure", "suction pressure", "differential pressure", "head"],
    "temperature": ["operating temperature", "skin temperature", "inlet", "outlet"],
    "maintenance": ["overhaul", "preventive maintenance", "work order", "downtime", "spares"],
    "vibration": ["amplitude", "frequency", "bearing vibration", "misalignment", "unbalance"],
    "leak": ["flange leak", "packing leak", "gasket failure", "emission"],
}
# Intents in the order in which they are tried, with triggers, top k, neighbours, category. The rule
# looks at single words, so triggers of several words, which can never be met, are not listed.
INTENTS = [
    (
        "template_lookup",
        (
            "template", "templates", "form", "forms", "checklist", "checklists", "blank_form", "format",
        ),
        12, True, "templates",
    ),
    (
        "troubleshooting",
        (
            "troubleshoot", "troubleshooting", "failure", "cause", "abnormal", "fault", "trip", "alarm", "cavitation", "overheating", "vibration", "problem", "solution", "issue",
            "diagnosis", "why",
        ),
        25, True, "manuals",
    ),
    (
        "inspection_lookup",
        (
            "inspection", "inspect", "ndt", "ultrasonic", "thickness", "radiography", "corrosion", "dye", "penetrant", "magnetic", "report",
        ),
        15, True, "inspection",
    ),
    (
        "safety_lookup",
        (
            "safety", "hazard", "ppe", "fire", "emergency", "oisd", "explosion", "danger", "warning", "flammable", "toxic", "leak", "evacuation", "interlock",
        ),
        15, True, "safety",
    ),
    (
        "procedure_lookup",
        (
            "sop", "procedure", "step", "steps", "protocol", "checklist", "sequence", "startup", "shutdown", "commissioning", "isolation",
        ),
        12, True, "sops",
    ),
    (
        "maintenance_lookup",
        (
            "maintenance", "overhaul", "repair", "replace", "pm", "preventive", "breakdown", "inspection", "ndt", "lubrication", "bearing", "vibration", "alignment", "schedule",
            "service",
        ),
        15, True, "maintenance",
    ),
    (
        "comparison",
        (
            "compare", "difference", "versus", "vs", "better", "contrast",
        ),
        10, False, None,
    ),
    (
        "table_lookup",
        (
            "table", "matrix", "schedule", "tabulated", "chart", "bom",
        ),
        8, True, None,
    ),
    (
        "numerical_lookup",
        (
            "limit", "maximum", "minimum", "max", "min", "pressure", "temperature", "setpoint", "alarm", "trip", "threshold", "range", "flow",
        ),
        8, False, None,
    ),
    (
        "specification_lookup",
        (
            "specification", "rating", "capacity", "tolerance", "dimension", "material", "datasheet", "design", "head", "rpm", "kw", "power",
        ),
        10, False, None,
    ),
    (
        "equipment_lookup",
        (),
        10, True, "manuals",
    ),
]
EXCLUDED_PREFIXES = (
    "OISD", "API", "ASME", "PNGRB", "ISO", "REV", "SEC", "PG", "FIG", "LINE", "L", "STD", "DOC", "SPEC", "FORM", "INSP", "REPORT", "ANNEXURE",
)

TAG_JOIN = r"(?i)\b(P|MOV|HX|V|C|E|K|T|TK|PU|B|R)([0-9]{2,4}[A-Z]?)\b"
UNIT_GAPS = [(r"(?i)([0-9]+(?:\.[0-9]+)?)(bar|psi|mpa|kpa)\b", r"1 2"), (r"(?i)([0-9]+(?:\.[0-9]+)?)(kg/cm2|kg/cm²)\b", r"1 2"), (r"(?i)([0-9]+(?:\.[0-9]+)?)(rpm|kw|mw)\b", r"1 2"), (r"(?i)([0-9]+(?:\.[0-9]+)?)(degc|c|degf|f)\b", r"1 °2")]
STANDARD_FORM = r"(?i)\b(OISD|API|ASME|ISO)[-_\s]+([0-9]{2,4}[A-Z0-9\.]*)\b"
TAG = r"(?i)\b([A-Z]{1,4})[-_]?([0-9]{2,4}[A-Z]?)\b"
STANDARD = r"(?i)\b(OISD(?:[-_\s]?(?:STD|RP|GDN))?[-_\s]?[0-9]{2,3}|API[-_\s]?[0-9]{2,4}|ASME[-_\s]?[A-Z0-9\.]+|PNGRB[-_\s]?[A-Z0-9\.]+|ISO[-_\s]?[0-9]{4,5})\b"
PLANT_UNIT = r"(?i)\b(CDU[-_\s]?[12]?|VDU[-_\s]?[12]?|DCU|NHT|CCR|FCCU|HGU|DHDS|SRU|OM&S|ISOM|MS[-_\s]?BLOCK|CPP)\b"
PRESSURE = r"(?i)(\b[0-9]+(?:\.[0-9]+)?)\s*(bar|kg/cm2|kg/cm²|psi|mpa|kpa)\b"
TEMPERATURE = r"(?i)\b([0-9]+(?:\.[0-9]+)?)\s*(?:°|deg|degrees)?\s*([CFK])\b"
LINE_NUMBER = r"(?i)\b(?:\d+\"?-)?(?:LINE|L)[-_][0-9]{2,4}[-_][A-Z0-9-]+\b"
DATE = r"(?i)\b(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[-_\s]?\d{1,2}[,/-]?\s*\d{2,4}|\d{4})\b"
PERSON = r"(?i)\b(?:eng(?:ineer)?\.?|approved by|inspected by|operator|technician)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b"
REVISION = r"(?i)\b(?:Rev(?:ision)?\.?|R)[-_\s]?([0-9]{1,3}|[A-Z])\b"
PAGE_REF = r"(?i)\b(?:page|pg\.?|p\.)\s*([0-9]{1,4})\b"
SECTION_REF = r"(?i)\b(?:section|sec\.?|clause)\s*([0-9]+(?:\.[0-9]+)*)\b"


def squeeze(t: Column) -> Column:
    return strip(F.regexp_replace(t, f"[{WS}]+", " "))


def normalize(t: Column) -> Column:
    """Tags get their hyphen, units their blank; for text that is in NFKC already (see nfkc in operators.python_text)."""
    t = F.regexp_replace(t, TAG_JOIN, "$1-$2")
    for pattern, put in UNIT_GAPS:
        t = F.regexp_replace(t, pattern, put.replace("1", "$1", 1).replace("2", "$2", 1))
    return squeeze(F.replace(t, F.lit("°°"), F.lit("°")))


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def expand_acronyms(t: Column) -> Column:
    bare = lambda w: F.upper(F.regexp_replace(w, r"^[.,;:?!()\[\]]+|[.,;:?!()\[\]]+$", ""))
    full = _map(ACRONYMS)
    return F.array_join(F.transform(words(normalize(t)), lambda w: F.coalesce(F.concat(w, F.lit(" ("), F.element_at(full, bare(w)), F.lit(")")), w)), " ")


def expand_terms(t: Column, most: int = 10) -> Column:
    """Names of acronyms, then synonyms, that the query suggests; `most` at the most, which is the feature."""
    norm = F.lower(normalize(t))
    named = F.array_compact(F.array(*[F.when(F.contains(norm, F.lit(k.lower())), F.lit(v.lower())) for k, v in ACRONYMS.items()]))
    terms = F.array_compact(F.array(*[F.when(F.contains(norm, F.lit(k)) & ~F.contains(norm, F.lit(s)), F.lit(s)) for k, v in SYNONYMS.items() for s in v]))
    return F.slice(F.concat(named, F.array_distinct(F.array_except(terms, named))), 1, most)


def rewrite(t: Column) -> Column:
    """Standards in one form, known misspellings put right."""
    # upper case of a match: standards are cut out, put up, and put back by splitting around them
    norm = normalize(t)
    found = F.regexp_extract_all(norm, F.lit(STANDARD_FORM), 0)
    gaps = F.split(norm, STANDARD_FORM)
    put = F.transform(found, lambda s: F.upper(F.regexp_replace(s, STANDARD_FORM, "$1-$2")))
    text = F.array_join(F.flatten(F.transform(gaps, lambda g, i: F.array(g, F.coalesce(F.get(put, i), F.lit(""))))), "")
    right = _map(SPELLING)

    def fix(w: Column) -> Column:
        known = F.element_at(right, F.regexp_replace(F.lower(w), r"^[.,?!:;]+|[.,?!:;]+$", ""))
        return F.coalesce(F.concat(known, F.regexp_extract(w, r"([.,?!])$", 1)), w)

    return F.array_join(F.transform(words(text), fix), " ")


def _all(t: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(t, F.lit(pattern), group)


def entities(t: Column) -> Column:
    """Sorted distinct lists by kind, of a normalised query."""
    ordered = lambda a: F.array_sort(F.array_distinct(a))
    tags = F.transform(_all(t, TAG), lambda m: F.upper(F.regexp_replace(m, r"(?i)^([A-Z]{1,4})[-_]?", "$1-")))
    prefix = lambda x: F.split_part(x, F.lit("-"), F.lit(1))
    tags = F.filter(tags, lambda x: ~prefix(x).isin(*EXCLUDED_PREFIXES) & ((F.length(prefix(x)) > 1) | (F.length(x) >= 5)))
    return F.struct(
        ordered(tags).alias("equipment_tags"),
        ordered(F.transform(_all(t, PLANT_UNIT), lambda x: F.replace(F.upper(x), F.lit(" "), F.lit("-")))).alias("plant_units"),
        ordered(F.transform(_all(t, STANDARD), lambda x: F.upper(F.regexp_replace(x, r"[-_\s]+", "-")))).alias("standards"),
        ordered(F.transform(_all(t, PRESSURE), lambda x: F.concat_ws(" ", F.regexp_extract(x, PRESSURE, 1), F.lower(F.regexp_extract(x, PRESSURE, 2))))).alias("pressure_values"),
        ordered(F.transform(_all(t, TEMPERATURE), lambda x: F.concat(F.regexp_extract(x, TEMPERATURE, 1), F.lit(" °"), F.upper(F.regexp_extract(x, TEMPERATURE, 2))))).alias("temperature_values"),
        ordered(F.transform(_all(t, LINE_NUMBER), F.upper)).alias("line_numbers"),
        ordered(_all(t, DATE)).alias("dates"),
        ordered(_all(t, PERSON, 1)).alias("engineer_names"),
        ordered(_all(t, REVISION, 1)).alias("revision_numbers"),
        ordered(_all(t, SECTION_REF, 1)).alias("section_references"),
        ordered(_all(t, PAGE_REF, 1)).alias("page_references"),
    )


def intents(t: Column, found: Column) -> Column:
    """All intents that a normalised query triggers, in order."""
    low = F.regexp_extract_all(F.lower(t), F.lit(r"\b[a-z0-9-]+\b"), 0)
    out = []
    for name, triggers, *_ in INTENTS:
        hit = F.arrays_overlap(low, F.array(*[F.lit(w) for w in list(triggers)])) if triggers else F.lit(False)
        if name == "safety_lookup":
            hit |= F.size(found["standards"]) > 0
        if name == "numerical_lookup":
            hit |= F.size(found["pressure_values"]) > 0
        if name == "equipment_lookup":
            hit |= F.size(found["equipment_tags"]) > 0
        out.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*out))


def search_tokens(t: Column) -> Column:
    """Tokens without stop words, or all if nothing else is left."""
    every = tokens(t)
    content = F.filter(every, lambda w: ~w.isin(*STOPWORDS))
    return F.when(F.size(content) > 0, content).otherwise(every)
