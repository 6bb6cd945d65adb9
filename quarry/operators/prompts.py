"""Prompts as columns: budgets, compression, citations, hashes, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_words, tok_prompt
from .evaluation import INJECTIONS, anchors

HEADROOM, WINDOW, GENERATION, CONTEXT = 64, 4096, 1024, 2000
#: Who answers, by archetype, what holds for every answer, and what each kind of answer is to be; deployments bring their own.
PERSONAS = {
    "equipment_lookup": "You look up equipment: give exact parameters, ratings and tags as the documents have them.",
    "sop_retrieval": "You give operating procedures step by step, in the order of the documents.",
    "maintenance": "You advise on maintenance: intervals, inspections, parts and recorded work.",
    "safety_compliance": "You answer for safety: permits, isolation, gas tests, protective equipment and the standards that ask for them.",
    "troubleshooting": "You trace faults to their causes and name the documented remedies.",
    "comparison": "You compare: put the items side by side, property by property.",
    "general_qa": "You answer questions from the documents at hand.",
}
DIRECTIVES = ("Use the context alone.", "Cite a source for each statement by its number in brackets.", "Say so where the documents are silent.", "Keep obligations as strong as their source has them.")
DIRECTIVES_PART = "\n\nDIRECTIVES:\n" + "\n".join(f"- {d}" for d in DIRECTIVES)
TEMPLATES = {
    "equipment_lookup": "State each parameter with its unit and source.",
    "specification": "Give the specification as a list of properties and values.",
    "sop_retrieval": "Number the steps.",
    "procedure": "Number the steps and name the checks between them.",
    "maintenance": "Separate recorded, proposed and required actions.",
    "safety_compliance": "Name each requirement with the standard that sets it.",
    "troubleshooting": "List causes, signs and remedies.",
    "comparison": "Answer with a table.",
    "email": "Write subject, salutation, body and close.",
    "approval_note": "Write purpose, background, proposal and approval.",
    "summary": "Summarise in a few points.",
    "report": "Write title, summary, sections and conclusion.",
    "extraction": "List the fields that are asked for.",
    "analysis": "Weigh the evidence, then conclude.",
    "general_qa": "Answer first, then give the evidence.",
}
VERSION = "1"
# Fixed value: lines that carry figures, limits or obligations.
SALIENT = r"(?i)\d|must|shall|limit|warning|danger|caution|maximum|minimum|oisd|api|asme"


def budget(system: Column, memory: Column, context: Column, window: int = WINDOW, generation: int = GENERATION) -> Column:
    """Struct of the parts' tokens, their total with headroom, what is left to generate, and whether the prompt fits."""
    n = lambda c: F.when(F.length(c) == 0, 0).otherwise(tok_prompt(c)).cast("int")
    total = n(system) + n(memory) + n(context) + HEADROOM
    return F.struct(n(system).alias("system"), n(memory).alias("memory"), n(context).alias("context"), total.alias("total"), F.least(F.lit(generation), F.greatest(F.lit(0), F.lit(window) - total)).alias("generation"), (total <= window - generation).alias("fits"))


def compress(text: Column, tokens: int) -> Column:
    """The text if it fits; else its salient lines if they do; else its beginning."""
    lines = F.array_join(F.filter(F.split(text, "\n"), lambda x: x.rlike(SALIENT)), "\n")
    return F.when(tok_prompt(text) <= tokens, text).when((lines != "") & (tok_prompt(lines) <= tokens), lines).otherwise(F.concat(F.substring(text, 1, 4 * tokens - 3), F.lit("...")))


def citation_lines(citations: Column, style: str = "inline") -> Column:
    """citations: array of structs (anchor, document, page, section)."""
    place = lambda c: F.concat(c["document"], F.coalesce(F.concat(F.lit(", p. "), c["page"].cast("string")), F.lit("")), F.coalesce(F.concat(F.lit(", "), c["section"]), F.lit("")))
    if style == "table":
        row = lambda c: F.concat(F.lit("| "), c["anchor"], F.lit(" | "), place(c), F.lit(" |"))
        return F.concat(F.lit("| Ref | Source |\n|---|---|\n"), F.array_join(F.transform(citations, row), "\n"))
    return F.array_join(F.transform(citations, lambda c: F.concat(c["anchor"], F.lit(" "), place(c))), "; " if style == "inline" else "\n")


def system_prompt(archetype: Column, custom: Column | None = None, personas: dict[str, str] | None = None) -> Column:
    """The persona of an archetype, or the general one, the directives, and instructions of one's own."""
    personas = personas or PERSONAS
    persona = F.coalesce(*[F.when(archetype == k, v) for k, v in personas.items()], F.lit(personas["general_qa"]))
    own = F.when(F.trim(custom) != "", F.concat(F.lit("\n\nSPECIAL INSTRUCTIONS:\n"), F.trim(custom))) if custom is not None else F.lit(None).cast("string")
    return F.concat(persona, F.lit(DIRECTIVES_PART), F.coalesce(own, F.lit("")))


def template(archetype: Column, templates: dict[str, str] | None = None) -> Column:
    """Struct of the name and instruction of an archetype's template, whatever its case; the general one if there is none."""
    templates = templates or TEMPLATES
    asked = F.lower(F.trim(archetype))
    row = lambda k: F.struct(F.lit(k).alias("name"), F.lit(templates[k]).alias("instruction"))
    return F.coalesce(*[F.when(asked == k, row(k)) for k in templates], row("general_qa"))


def assembled(system: Column, context: Column, history: Column, query: Column) -> Column:
    part = lambda name, c: F.when(F.length(c) > 0, F.concat(F.lit(f"## {name}\n"), c))
    return F.concat_ws("\n\n", part("System", system), part("Context", context), part("History", history), part("Question", query))


def prompt_hash(system: Column, context: Column, query: Column, model: str) -> Column:
    """sha256 of version, system, context, query and model; history stays out."""
    return F.sha2(F.concat_ws("\x1f", F.lit(VERSION), system, context, query, F.lit(model)), 256)


def problems(prompt: Column, most_words: int = WINDOW) -> Column:
    """Names of what is wrong with a prompt."""
    harmful = F.lit(False)
    for p in INJECTIONS:
        harmful |= prompt.rlike(p)
    return F.array_compact(F.array(F.when(F.length(F.trim(prompt)) == 0, "empty"), F.when(count_words(prompt) > most_words, "too_long"), F.when(harmful, "injection"), F.when(F.size(anchors(prompt)) == 0, "no_citation")))


def generation_key(prompt: Column, chunk_ids: Column, model: str, params: str) -> Column:
    return F.sha2(F.concat_ws("|", prompt, F.array_join(F.array_sort(chunk_ids), ","), F.lit(model), F.lit(params)), 256)


def artifact_name(query: Column, stamp: Column, extension: str = "pdf") -> Column:
    """A file name that the query gives, else a slug of at most 32 characters and a stamp."""
    given = F.regexp_extract(query, rf"(?i)\b([\w-]+\.{extension})\b", 1)
    slug = F.regexp_replace(F.substring(F.regexp_replace(F.lower(query), "[^a-z0-9]+", "_"), 1, 32), "^_+|_+$", "")
    return F.when(given != "", given).otherwise(F.concat(slug, F.lit("_"), stamp, F.lit(f".{extension}")))


def summary(rows: DataFrame, by: str, times: list[str], hit: str) -> DataFrame:
    """Means of timings and the share of cache hits."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(t).alias(f"avg_{t}") for t in times], F.avg(F.col(hit).cast("int")).alias("hit_share"))


def pipeline(queries: DataFrame, contexts: DataFrame, history: DataFrame | None = None, model: str = "local_llm", most: int = CONTEXT) -> DataFrame:
    """Prompts of queries (query_id, text, archetype), step by step: query_id, prompt, prompt_hash, template, tokens, fits, problems.

    contexts (query_id, context) are compressed to `most` tokens; history (query_id,
    history) stays out of the hash. A query without a context or history lacks that part.
    """
    rows = queries.join(contexts.select("query_id", "context"), "query_id", "left")
    rows = rows.join(history.select("query_id", "history"), "query_id", "left") if history is not None else rows.withColumn("history", F.lit(""))
    empty = F.lit("")
    rows = rows.withColumns({"system": system_prompt(F.col("archetype")), "_t": template(F.col("archetype")), "context": compress(F.coalesce("context", empty), most), "history": F.coalesce("history", empty)})
    rows = rows.withColumn("system", F.concat("system", F.lit("\n\n"), F.col("_t.instruction")))
    made = rows.withColumns({"prompt": assembled(F.col("system"), F.col("context"), F.col("history"), F.col("text")), "_b": budget(F.col("system"), F.col("history"), F.col("context"))})
    return made.select("query_id", "prompt", prompt_hash(F.col("system"), F.col("context"), F.col("text"), model).alias("prompt_hash"), F.col("_t.name").alias("template"), F.col("_b.total").alias("tokens"), F.col("_b.fits").alias("fits"), problems(F.col("prompt")).alias("problems"))
