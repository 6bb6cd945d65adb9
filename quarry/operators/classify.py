"""Categories of documents by additive rules, and the parser that each takes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folder words, file name patterns and content signatures by category, in the order that settles ties.
RULES = {
    "Manual": (["manual", "manuals", "o&m", "operations", "handbook", "guide"], ["manual", "user_guide", "handbook", "specs"], [r"operating\s*manual", r"instruction\s*manual", r"technical\s*manual", r"user\s*guide", r"installation\s*manual", r"maintenance\s*and\s*operating\s*instructions"]),
    "Inspection Report": (["inspection", "inspections", "inspection_reports", "ndt", "audit", "survey"], ["inspection", "ndt_report", "thickness", "hydrotest", "survey_report"], [r"inspection\s*report", r"ndt\s*report", r"visual\s*inspection", r"wall\s*thickness", r"ultrasonic\s*testing", r"radiographic\s*testing", r"dye\s*penetrant", r"hydro\s*test"]),
    "Safety Document": (["safety", "safety_docs", "oisd", "hse", "hazard", "msds", "sop", "ppe"], ["oisd", "safety", "msds", "sop_", "hse_", "hazard"], [r"safety\s*standard", r"standard\s*operating\s*procedure", r"job\s*safety\s*analysis", r"material\s*safety\s*data\s*sheet", r"personal\s*protective\s*equipment", r"oisd-std-", r"permit\s*to\s*work", r"hazard\s*identification"]),
    "Maintenance Record": (["maintenance", "pm_records", "work_orders", "breakdown", "overhaul", "logs"], ["maintenance", "pm_log", "work_order", "overhaul_report"], [r"preventive\s*maintenance", r"work\s*order", r"equipment\s*log", r"overhaul\s*record", r"calibration\s*certificate", r"greasing\s*schedule", r"vibration\s*analysis"]),
    "Email": (["email", "emails", "correspondence", "memos", "communications"], [r"\.eml$", r"\.msg$", r"^email_", r"^memo_"], [r"(?m)^from:\s+", r"(?m)^to:\s+", r"(?m)^subject:\s+", r"(?m)^sent:\s+", r"(?m)^date:\s+.*(?:am|pm|\d{4})"]),
    "Engineering Drawing": (["drawing", "drawings", "engineering_drawings", "pid", "p&id", "pfd", "schematics", "blueprints"], [r"\.dwg$", r"\.dxf$", r"\.cad$", "_pid_", "_pfd_", "drawing_", "dwg_"], [r"title\s*block", r"drawing\s*no", r"dwg\s*no", "p&id", r"piping\s*and\s*instrumentation", r"rev\s*no\.", r"designed\s*by", r"scale:\s*\d+:\d+"]),
    "Template": (["template", "templates", "forms", "blank_forms", "checklists"], ["template", "checklist", "blank_form", "standard_form"], [r"template\s*document", r"form\s*number:", r"checklist\s*template", r"sample\s*template"]),
}
EXTENSIONS = {"Engineering Drawing": (".dwg", ".dxf"), "Email": (".eml", ".msg")}
LEAST = 20


def scores(path: Column, text: Column, known: Column | None = None) -> dict[str, Column]:
    """Score of each category: a category known before 40, folders 30, file name 25, content 15 a signature up to 45, extension 50."""
    before = F.regexp_replace(F.lower(known), "[ -]", "_") if known is not None else F.lit(None).cast("string")
    low = F.lower(path)
    folders, name = F.regexp_replace(low, "[^/]*$", ""), F.regexp_extract(low, "([^/]*)$", 1)
    low_text = F.lower(text)  # whole: a signature counts wherever it stands
    out = {}
    for category, (words, names, signatures) in RULES.items():
        folder = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(folders, w))
        content = sum((low_text.rlike(p).cast("int") for p in signatures), F.lit(0))
        told = F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(before, w)), F.lit(False))
        out[category] = F.when(told, 40).otherwise(0) + F.when(folder, 30).otherwise(0) + F.when(name.rlike("|".join(names)), 25).otherwise(0) + F.least(content * 15, F.lit(45)) + F.when(name.rlike("|".join(f"\\{e}$" for e in EXTENSIONS[category])) if category in EXTENSIONS else F.lit(False), 50).otherwise(0)
    return out


def classified(path: Column, text: Column, known: Column | None = None) -> Column:
    """Struct of category and confidence; the first of equal scores wins, and 20 are needed."""
    ranked = F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, (c, s) in enumerate(scores(path, text, known).items())])
    best = F.array_max(ranked)
    sure = best["s"] >= LEAST
    confidence = F.round(F.least(0.5 + best["s"] / 150 * 0.49, F.lit(0.99)), 2)
    return F.struct(F.when(sure, best["c"]).otherwise("Unknown").alias("category"), F.when(sure, confidence).otherwise(0.1).alias("confidence"))


def parser(category: Column, confidence: Column, extension: Column) -> Column:
    """By category from a confidence of 0.6, else by extension, else generic."""
    by_category = F.when(category == "Inspection Report", "inspection").when(category == "Safety Document", "safety").when(category == "Email", "email").when(category == "Engineering Drawing", "engineering")
    by_extension = F.when(extension.isin("pdf", "docx", "pptx", "csv"), extension).when(extension == "md", "markdown").when(extension.isin("png", "jpg", "jpeg"), "image_metadata").when(extension == "eml", "email")
    return F.coalesce(F.when(confidence >= 0.6, by_category), by_extension, F.lit("generic"))
