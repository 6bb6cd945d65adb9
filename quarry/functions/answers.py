"""Answers as columns: what models should not have written goes, and Markdown becomes sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intents import once, task
from .queries import search_tokens
from .text import lines, runs, strip

# Patterns of remarks, guesses, denials and demands in answers.
REMARKS = (
    r"(?i)Therefore,\s*the\s*response\s*to\s*the\s*user(?:'s)?\s*query\s*would\s*be:\s*",
    r"(?i)Therefore,\s*the\s*answer\s*to\s*the\s*user(?:'s)?\s*query\s*is:\s*",
    r"(?i)Therefore,\s*the\s*response\s*is:\s*",
    r"(?i)In\s*conclusion,\s*the\s*response\s*would\s*be:\s*",
    r"(?i)To\s*answer\s*the\s*user(?:'s)?\s*query:\s*",
)
GUESSES = (
    r"(?i)(?:indicating\s+that\s+it\s+likely|likely\s+operates|typical\s+for\s+such|would\s+need\s+to\s+consult|typically\s+operates|normally\s+operates|presumably|assumed\s+to\s+be)[^.\n]*\.?",
    r"(?i)For\s+more\s+detailed\s+specifications[^.\n]*consult[^.\n]*\.?",
    r"(?i)However,\s*the\s*context\s*mentions\s*that\s*the\s*(?:pump|compressor|vessel|drum|equipment)\s*is\s*used[^.\n]*\.?",
)
RECORDED = r"(?i)\b(?:proposed\s+action|action\s+required|controlled\s+review|inspection|maintenance\s+scope|scheduled|approved|recommended)\b"
DENIAL = r"(?i)No\s+specific\s+(?:maintenance\s+)?actions\s+were\s+recorded[^.\n]*\.[^.\n]*does\s+not\s+specify\s+any\s+particular\s+maintenance\s+tasks?\.\s*"
CIRCULAR = r"(?i)ppe\s+required\s+[^\n.]*\s+is\s+personal\s+protective\s+equipment"
NOT_CIRCULAR = "The retrieved documentation states that Personal Protective Equipment (PPE) is required, but does not specify the individual PPE items."
ABSENT = ("not specified", "not explicitly stated", "does not contain", "cannot determine", "not defined", "not provided", "does not specify")
SALUTATION = r"(?im)^Dear\s+[^,\n]+,"
SUBJECT = r"(?im)^Subject:\s*([^\n]+)"
WRONG_SUBJECT = ("request for confirmation", "request for approval", "approval request", "action required")
DEMAND = r"(?i)I\s+am\s+writing\s+to\s+request\s+your\s+immediate\s+attention\s+to[^.\n]*\.\s*(?:As\s+per\s+our\s+recent\s+team\s+review[^.\n]*\.\s*)?"
NO_DEMAND = "Please find below a summary of the documented safety requirements:\n\n"
CONFIRM = r"(?i)(?:Specifically,\s*)?we\s+require\s+confirmation\s+of\s+([^\n.]+)\."
COMPLETE = 20
# What begins a section, a notice, a bullet, and what ends up outside the sections.
HEADING = r"^(?:#{2,4}\s+|\*\*(?:Section\s*\d*:\s*)?[^*]+\*\*|[A-Z0-9\s-]{4,}:$)"
NOT_HEADING = r"^(?:[-•]|\*(?:[^*]|$)|1\.|2\.|3\.)"
NOTICE = r"(?i)\b(CRITICAL|MANDATORY|WARNING|CAUTION|SAFETY NOTE):"
NOTICE_TEXT = r"(?i)((?:CRITICAL|MANDATORY|WARNING|CAUTION|SAFETY NOTE):.*)$"
BULLET = r"^(?:[-*•]|\d+\.)\s+(.+)$"
SUMMARY, CONCLUSION = ("executive summary", "overview"), ("conclusion", "closing remarks", "statutory remarks")
FIRST_SECTION, TITLE = "Key Requirements & Details", "Engineering & Compliance Report"


def squeezed(t: Column) -> Column:
    return strip(F.regexp_replace(t, r"[^\S\r\n]+", " "))


def sanitized(answer: Column) -> Column:
    """The answer without remarks about itself, a denial that its own records contradict, and guesses."""
    t = answer
    for p in REMARKS:
        t = F.regexp_replace(t, p, "")
    t = once(squeezed(t), lambda x: strip(F.when(x.rlike(RECORDED), F.regexp_replace(x, DENIAL, "")).otherwise(x)))
    for p in GUESSES:
        t = strip(F.regexp_replace(t, p, ""))
    t = F.regexp_replace(t, r"[^\S\r\n]+", " ")
    return strip(F.replace(F.replace(t, F.lit(" ."), F.lit(".")), F.lit(" ,"), F.lit(",")))


def guesses(answer: Column) -> Column:
    """How many guesses an answer makes."""
    t, n = answer, F.lit(0)
    for p in REMARKS:
        t = F.regexp_replace(t, p, "")
    for p in GUESSES:
        n = n + F.regexp_count(t, F.lit(p))
        t = F.regexp_replace(t, p, "")
    return n


def first_replaced(t: Column, pattern: str, put: Column) -> Column:
    """t with the first match replaced by put, taken as it is."""
    return once(F.split(t, pattern, 2), lambda p: F.when(F.size(p) < 2, t).otherwise(F.concat(p[0], put, p[1])))


def as_asked(query: Column, answer: Column) -> Column:
    """An e-mail with the recipient and purpose that the request has; other answers as they are."""

    def mail(a: Column, r: Column) -> Column:
        t = once(F.concat(F.lit("Dear "), r["recipient"], F.lit(",")), lambda dear: F.when(r["recipient"].isNotNull() & a.rlike(SALUTATION) & (F.lower(F.regexp_extract(a, SALUTATION, 0)) != F.lower(dear)), first_replaced(a, SALUTATION, dear)).otherwise(a))
        if_summary = lambda x: F.when(r["email_purpose"] == "summary", x)

        def subject(x: Column) -> Column:
            now = F.lower(F.regexp_extract(x, SUBJECT, 1))
            wrong = F.exists(F.array(*map(F.lit, WRONG_SUBJECT)), lambda w: F.contains(now, w))
            put = F.concat(F.lit("Subject: "), r["topic"], F.lit(" — Summary"))
            bare = F.concat(F.lit("Subject: "), F.regexp_replace(F.trim(F.regexp_extract(x, SUBJECT, 1)), r"(?i)\s+for\s+[A-Z]+-\d+", ""))
            general = (F.size(r["entities"]) == 0) & now.rlike(r"(?i)\bfor\s+[A-Z]+-\d+\b")
            return F.when(wrong, first_replaced(x, SUBJECT, put)).when(general, first_replaced(x, SUBJECT, bare)).otherwise(x)

        told = lambda x: F.regexp_replace(F.regexp_replace(subject(x), DEMAND, NO_DEMAND), CONFIRM, "Key requirements include: $1.")
        return once(t, lambda x: F.coalesce(if_summary(told(x)), x))

    return once(task(query), lambda r: F.when(r["output_format"] == "email", mail(answer, r)).otherwise(answer))


def alignment(query: Column, answer: Column, grounded: Column) -> Column:
    """Struct of cleaned, aligned, complete, no_fabrication and guesses of an answer to a query."""
    low = F.lower(query)
    plain = lambda t: F.when((F.contains(low, F.lit("ppe")) | F.contains(low, F.lit("personal protective equipment"))) & t.rlike(CIRCULAR), F.lit(NOT_CIRCULAR)).otherwise(t)
    cleaned = as_asked(query, once(sanitized(F.coalesce(answer, F.lit(""))), plain))
    terms = F.filter(search_tokens(F.coalesce(query, F.lit(""))), lambda w: F.length(w) > 2)

    def told(t: Column) -> Column:
        lower = F.lower(t)
        met = F.exists(terms, lambda w: F.contains(lower, w)) | F.exists(F.array(*map(F.lit, ABSENT)), lambda w: F.contains(lower, w))
        n = guesses(F.coalesce(answer, F.lit("")))
        return F.struct(t.alias("cleaned"), ((F.size(terms) == 0) | met).alias("aligned"), (F.length(t) > COMPLETE).alias("complete"), (grounded & (n == 0)).alias("no_fabrication"), n.alias("guesses"))

    return once(cleaned, told)


def sections(answer: Column) -> Column:
    """Struct of title, summary, conclusion and sections of a Markdown answer.

    A section has heading, paragraphs, bullets, table (rows of cells, the header
    first, the rule left out; the last of two rows or more counts) and callout.
    """
    rows = F.filter(F.transform(lines(F.coalesce(answer, F.lit(""))), strip), lambda x: x != "")
    heading = lambda x: x.rlike(HEADING) & ~x.rlike(NOT_HEADING) & ~x.rlike(r"^\|.*\|$")
    titled = lambda r: (F.size(r) > 0) & (F.startswith(r[0], F.lit("# ")) | F.startswith(F.lower(r[0]), F.lit("title:")))
    piped = lambda x: x.rlike(r"^\|.*\|$")
    cells = lambda x: F.transform(F.split(F.substring(x, 2, F.length(x) - 2), r"\|"), lambda c: F.trim(c))
    rule = lambda c: F.forall(F.filter(c, lambda v: v != ""), lambda v: v.rlike("^:?-+:?$"))

    def table(body: Column) -> Column:
        found = F.filter(F.transform(runs(body, lambda last, x: piped(last) != piped(x)), lambda r: F.when(piped(r[0]), F.transform(r, cells))), lambda r: r.isNotNull() & (F.size(r) >= 2))
        data = F.transform(found, lambda r: F.filter(r, lambda c, i: (i == 0) | ~rule(c)))
        return F.try_element_at(F.filter(data, lambda r: F.size(r) >= 2), F.lit(-1))

    def section(r: Column) -> Column:
        headed = heading(r[0])
        body = F.when(headed, F.slice(r, F.lit(2), F.size(r))).otherwise(r)
        text = F.filter(body, lambda x: ~piped(x))
        notice = F.filter(text, lambda x: x.rlike(NOTICE))
        item = lambda x: ~x.rlike(NOTICE) & x.rlike(BULLET)
        name = F.regexp_replace(strip(F.regexp_replace(r[0], "^#+", "")), r"^[*_:]+|[*_:]+$", "")
        return F.struct(
            F.when(headed, name).otherwise(FIRST_SECTION).alias("heading"),
            F.filter(text, lambda x: ~x.rlike(NOTICE) & ~x.rlike(BULLET)).alias("paragraphs"),
            F.transform(F.filter(text, item), lambda x: F.trim(F.regexp_extract(x, BULLET, 1))).alias("bullets"),
            table(body).alias("table"),
            F.when(F.size(notice) > 0, F.regexp_replace(F.regexp_extract(F.element_at(notice, -1), NOTICE_TEXT, 1), r"^[*_]+|[*_]+$", "")).alias("callout"),
        )

    has = lambda s, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(s["heading"]), w))

    def told(r: Column) -> Column:
        body = F.when(titled(r), F.slice(r, F.lit(2), F.size(r))).otherwise(r)
        title = F.when(titled(r), F.regexp_replace(F.trim(F.regexp_replace(r[0], r"(?i)^(#\s*|title:\s*)", "")), r"^[*_`#]+|[*_`#]+$", "")).otherwise(TITLE)
        full = lambda s: (F.size(s["paragraphs"]) > 0) | (F.size(s["bullets"]) > 0) | s["table"].isNotNull() | s["callout"].isNotNull()
        every = F.filter(F.transform(runs(body, lambda _, x: heading(x)), section), full)
        return once(every, lambda e: F.struct(title.alias("title"), _last(e, has, SUMMARY, ()).alias("summary"), _last(e, has, CONCLUSION, SUMMARY).alias("conclusion"), F.filter(e, lambda s: ~has(s, SUMMARY) & ~has(s, CONCLUSION)).alias("sections")))

    return once(rows, told)


def _last(e: Column, has, words: tuple[str, ...], but: tuple[str, ...]) -> Column:
    """The paragraphs of the last section whose heading has any of words and none of but."""
    fit = lambda s: has(s, words) & ~has(s, but) if but else has(s, words)
    return F.array_join(F.try_element_at(F.filter(e, fit), F.lit(-1))["paragraphs"], " ")
