"""Structure and entities of plain text: sections, pipe tables, references, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import strip

CROSS_REFERENCE = r"(?i)\b(Fig(?:ure)?\.?\s*\d+(?:\.\d+)*|Table\s*\d+(?:\.\d+)*|Section\s*\d+(?:\.\d+)*|OISD(?:-STD)?-\d+|API-\d+|ASME\s+[A-Z0-9.]+)\b"
DATE = r"(?i)\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4})\b"
REVISION = r"(?i)\b(?:Rev|Revision)[\s.:#-]*([A-Z0-9]+)\b"
# Notice words in the order in which they are tried.
SEVERITIES = ("DANGER", "WARNING", "CAUTION")


def text_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line of every line."""
    return docs.select(F.col(key), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line"))


def cross_references(docs: DataFrame, key: str, text: str) -> DataFrame:
    found = docs.select(F.col(key), F.posexplode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CROSS_REFERENCE), 1)).alias("pos", "target"))
    up = F.upper("target")
    return found.withColumn("ref_type", F.when(F.contains(up, F.lit("FIG")), "FIGURE").when(F.contains(up, F.lit("TABLE")), "TABLE").when(F.contains(up, F.lit("SECTION")), "SECTION").otherwise("STANDARD"))


def warnings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each line that names a severity; the first in order counts."""
    up = F.upper(strip(F.col("line")))
    severity = F.lit(None).cast("string")
    for s in reversed(SEVERITIES):
        severity = F.when(F.contains(up, F.lit(s)), s).otherwise(severity)
    rows = text_lines(docs, key, text).withColumn("severity", severity)
    return rows.where(F.col("severity").isNotNull() & (F.length(strip(F.col("line"))) > 5)).select(key, "pos", "severity", strip(F.col("line")).alias("notice"))


def dates(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(DATE), 0)))


def revisions(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(REVISION), 1)))


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, section (from 1), level, title, n_lines of Markdown, numbered and upper-case headings with what follows.

    Lines before the first heading are left out; a document without one is a single section.
    """
    line = strip(F.col("line"))
    md = F.length(F.regexp_extract(line, r"^(#{1,6})\s+(.*)$", 1))
    number = F.regexp_extract(line, r"^(\d+(?:\.\d+)*)\s+(.*)$", 1)
    numeric = (number != "") & (F.length(line) < 100) & ~line.endswith(".")
    upper = (line == F.upper(line)) & (F.length(line) >= 4) & (F.length(line) < 80) & (F.length(F.regexp_replace(line, "[^A-Z]", "")) >= 3) & ~line.startswith("|")
    level = F.when(md > 0, md).when(numeric, F.size(F.split(number, r"\."))).when(upper, 1)
    title = F.when(md > 0, F.regexp_replace(line, r"^#{1,6}\s+", "")).otherwise(line)
    rows = text_lines(docs, key, text).withColumns({"level": level, "title": F.when(level.isNotNull(), title)})
    w = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.count("level").over(w)).withColumn("any", F.count("level").over(W.partitionBy(key)))
    kept = rows.where((F.col("section") > 0) | (F.col("any") == 0))
    body = F.count(F.when(F.col("level").isNull() & (strip(F.col("line")) != ""), 1))
    return kept.groupBy(key, "section").agg(F.max("level").cast("long").alias("level"), F.max("title").alias("title"), body.alias("n_lines"))


def pipe_tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, table_no (from 1), n_rows, n_cols of runs of two or more `|...|` lines; separators are left out."""
    rows = text_lines(docs, key, text).withColumn("line", strip(F.col("line")))
    rows = rows.withColumn("is_row", F.col("line").rlike(r"^\|.*\|$"))
    w = W.partitionBy(key).orderBy("pos")
    rows = rows.withColumn("run", F.sum((~F.col("is_row")).cast("int")).over(w)).where("is_row")
    runs = rows.where(~F.col("line").rlike(r"^[|:\s-]+$")).groupBy(key, "run").agg(F.count("*").alias("n_rows"), F.min_by(F.size(F.split("line", r"\|")) - 2, "pos").cast("long").alias("n_cols")).where("n_rows >= 2")
    return runs.withColumn("table_no", F.row_number().over(W.partitionBy(key).orderBy("run"))).drop("run")


def estimates(docs: DataFrame, key: str, text: str) -> DataFrame:
    from ..functions.text import tok_loader, tok_prompt, tok_regex, tok_retrieval

    t = F.coalesce(text, F.lit(""))
    return docs.select(key, *[f(t).cast("long").alias(f.__name__) for f in (tok_regex, tok_retrieval, tok_prompt, tok_loader)])


# Lines that look like page numbers, and those that are headings although they repeat.
PAGINATION = r"(?i)^(?:Page\s+\d+(?:\s+of\s+\d+)?|\d+\s*/\s*\d+|[-—]\s*\d+\s*[-—])$"
HEADING_LIKE = r"(?i)^(?:(?:section|chapter|part|\d+\.|\d+\))\s+.*|introduction|scope|purpose|references|safety precautions)$"


def without_headers(sections_: DataFrame, doc: str, key: str, text: str, least: int = 2, longest: int = 150) -> DataFrame:
    """doc, key, cleaned: sections without first and last lines that repeat in their document.

    A last line also goes if it is a page number. Documents of one section stay.
    The last line is cut off by its length: a pattern that ends in $ would be tried
    from every character of every line.
    """
    rows = sections_.withColumn("_l", F.split(F.coalesce(text, F.lit("")), "\n"))
    rows = rows.withColumn("_full", F.filter(F.transform("_l", strip), lambda x: x != ""))
    rows = rows.withColumns({"_top": F.get("_full", F.lit(0)), "_end": F.when(F.size("_full") > 1, F.element_at("_full", -1))})
    fit = lambda c: F.when(~F.col(c).startswith("#") & (F.length(c) <= longest) & ~F.col(c).rlike(HEADING_LIKE), F.col(c))
    rows = rows.withColumns({"_n": F.count("*").over(W.partitionBy(doc)), "_tops": F.count(fit("_top")).over(W.partitionBy(doc, fit("_top"))), "_ends": F.count(fit("_end")).over(W.partitionBy(doc, fit("_end")))})
    many = F.col("_n") >= 2
    head = F.coalesce(many & fit("_top").isNotNull() & (F.col("_tops") >= least), F.lit(False))
    foot = F.coalesce(many & (fit("_end").isNotNull() & (F.col("_ends") >= least) | F.col("_end").rlike(PAGINATION)), F.lit(False))
    body = F.regexp_replace(strip(F.col(text)), r"^[^\n]*\n?", "")
    cut = strip(F.when(head, body).otherwise(F.col(text)))
    above = F.substr(cut, F.lit(1), F.greatest(F.lit(0), F.length(cut) - F.length(F.substring_index(cut, "\n", -1)) - 1))
    return rows.select(doc, key, strip(F.when(foot, above).otherwise(cut)).alias("cleaned"))


def clean_cells(rows: Column) -> Column:
    """Cells of a table with newlines and runs of blanks as one blank, and bars escaped."""
    return F.transform(rows, lambda r: F.transform(r, lambda c: F.replace(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("|"), F.lit("\\|"))))


def markdown_table(headers: Column, rows: Column, most: int = 500) -> Column:
    """Markdown of a table's first `most` rows, which is what a preview shows."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(headers, lambda _: F.lit("---")), "|"), F.lit("|"))
    return F.array_join(F.concat(F.array(line(headers), rule), F.transform(F.slice(rows, 1, most), line)), "\n")


# Verbs by relation, in the order in which they are tried.
RELATIONS = [
    ("feeds", r"(?i)\b(?:discharges\s+to|feeds|pumps\s+to|supplies|delivers\s+to)\b"),
    ("connected_to", r"(?i)\b(?:connected\s+to|linked\s+to|piped\s+to|joined\s+to)\b"),
    ("regulates", r"(?i)\b(?:regulates|throttles|controls\s+flow\s+to)\b"),
    ("monitors", r"(?i)\b(?:monitors|measures|senses|detects)\b"),
    ("powers", r"(?i)\b(?:powers|drives|actuates)\b"),
    ("bypasses", r"(?i)\b(?:bypasses|diverts\s+around)\b"),
    ("isolates", r"(?i)\b(?:isolates|blocks|shuts\s+off)\b"),
]
GRAPH_TAG = r"\b([A-Z]{1,4}-\d{2,4}[A-Z]?)\b"


def entity_edges(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, src, dst, relation: tags that follow each other in a sentence, by the verb that it has."""
    from ..functions.text import sentences

    rows = docs.select(F.col(key), F.posexplode(sentences(F.coalesce(text, F.lit("")))).alias("pos", "s"))
    rows = rows.withColumn("tags", F.array_distinct(F.regexp_extract_all("s", F.lit(GRAPH_TAG), 1))).where(F.size("tags") > 1)
    relation = F.coalesce(*[F.when(F.col("s").rlike(p), name) for name, p in RELATIONS], F.lit("connected_to"))
    pairs = F.transform(F.slice("tags", F.lit(1), F.size("tags") - 1), lambda t, i: F.struct(t.alias("src"), F.get("tags", i + 1).alias("dst")))
    return rows.select(key, "pos", F.explode(pairs).alias("p"), relation.alias("relation")).select(key, "pos", "p.src", "p.dst", "relation")


def entity_neighbours(edges: DataFrame, tag: str) -> DataFrame:
    return edges.where(F.col("src") == tag)


def marked_pages(docs: DataFrame, key: str, text: str, word: str = "Page") -> DataFrame:
    """key, number, content of the parts that `--- Page N ---` (or Slide) lines begin."""
    parts = F.filter(F.split(text, rf"(?m)(?=^--- {word} \d+ ---$)"), lambda p: p.rlike(rf"^--- {word} \d+ ---"))
    rows = docs.select(F.col(key), F.explode(parts).alias("p"))
    return rows.select(key, F.regexp_extract("p", rf"^--- {word} (\d+) ---", 1).cast("int").alias("number"), strip(F.regexp_replace("p", rf"^--- {word} \d+ ---\n?", "")).alias("content"))


def email_headers(text: Column) -> Column:
    """Map of the header lines of a message, names in lower case; a later line wins."""
    head = F.split(text, r"\n\s*\n", 2)[0]
    found = F.regexp_extract_all(head, F.lit(r"(?m)^([A-Za-z-]+:\s*[^\n]*)$"), 1)
    pair = F.transform(found, lambda x: F.struct(F.lower(F.split_part(x, F.lit(":"), F.lit(1))).alias("k"), F.trim(F.regexp_replace(x, r"^[A-Za-z-]+:\s*", "")).alias("v")))
    last = F.filter(pair, lambda x, i: ~F.exists(F.slice(pair, i + 2, F.greatest(F.size(pair), F.lit(1))), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def structure_issues(sections_: DataFrame, key: str) -> DataFrame:
    """key, section, issue of sections(): missing titles, repeated headings of a level, and jumps of more than one level."""
    w = W.partitionBy(key).orderBy("section")
    rows = sections_.withColumns({"_jump": F.col("level") - F.lag("level").over(w), "_same": F.count("*").over(W.partitionBy(key, "level", F.lower("title")))})
    issue = F.array_compact(F.array(F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "missing_title"), F.when(F.col("title").isNotNull() & (F.col("_same") > 1), "duplicate_heading"), F.when(F.col("_jump") > 1, "level_jump")))
    return rows.select(key, "section", F.explode(issue).alias("issue"))


def parsed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each document with what all extractors find: sections, tables, equipment, references, warnings, dates, revisions, edges and counts.

    Each extractor is a plan of its own over the same rows; their results meet by key,
    lists in the order of the text. A document in which nothing is found has empty lists.
    """
    from . import metadata

    t = F.coalesce(text, F.lit(""))
    rows = docs.select(F.col(key), t.alias("t"))

    def listed(found: DataFrame, name: str, order: str) -> DataFrame:
        columns = [order, *[c for c in found.columns if c not in (key, order)]]
        return found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    parts = [
        listed(sections(rows, key, "t"), "sections", "section"),
        listed(pipe_tables(rows, key, "t"), "tables", "table_no"),
        listed(metadata.equipment(rows, key, "t"), "equipment", "char_offset"),
        listed(cross_references(rows, key, "t"), "references", "pos"),
        listed(warnings(rows, key, "t"), "warnings", "pos"),
        listed(entity_edges(rows, key, "t"), "edges", "pos"),
    ]
    out = rows.select(key, dates(F.col("t")).alias("dates"), revisions(F.col("t")).alias("revisions"), F.length("t").alias("n_chars"), F.regexp_count("t", F.lit(r"\S+")).alias("n_words"))
    for part in parts:
        out = out.join(part, key, "left")
    return out.withColumns({c: F.coalesce(c, F.array()) for p in parts for c in p.columns if c != key})


# Fixed value: what begins an action item of a message.
ACTION = r"(?i)(?:Action(?:\s*Item)?|Required\s*Action|Please\s*ensure|Next\s*steps?)[\s.:-]+([^\n]+)"


def email_message(text: Column, name: Column) -> Column:
    """Struct of subject (the name, without one), sender, recipient, sent, heading, body and actions of a message; without headers, all of it is body."""
    headers = email_headers(text)
    field = lambda k, other: F.coalesce(F.nullif(F.element_at(headers, k), F.lit("")), other)
    parts = F.split(text, r"\n\s*\n", 2)
    body = F.when((F.size(parts) > 1) & (F.size(headers) > 0), parts[1]).otherwise(text)
    subject, sender, recipient, sent = field("subject", name), field("from", F.lit("Unknown Sender")), field("to", F.lit("Unknown Recipient")), field("date", F.lit(""))
    heading = F.concat(F.lit("From: "), sender, F.lit("\nTo: "), recipient, F.lit("\nDate: "), sent, F.lit("\nSubject: "), subject)
    actions = F.transform(F.regexp_extract_all(body, F.lit(ACTION), 1), strip)
    return F.struct(subject.alias("subject"), sender.alias("sender"), recipient.alias("recipient"), sent.alias("sent"), heading.alias("heading"), body.alias("body"), actions.alias("actions"))
