"""Alignment and sections of answers, report fields, model texts, recognised records, lookups."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as an
from ..operators import findings as fd
from ..operators import structure, vectors
from . import chunk_sql, fixtures
from .cleaning import s_lines, s_strip, sub
from .fixtures import cte
from .fixtures import literal as q
from .registry import TEXTS, query, read, texts
from .requests import s_case

ANSWERS = [
    ("What PPE is needed for hot work?", "Therefore, the response is: The PPE required for hot work is Personal Protective Equipment and so on."),
    ("What is the design pressure of V-101?", "To answer the user's query: V-101 has  a design pressure of 12 bar . It likely operates at 9 bar, typical for such vessels. It is rated."),
    ("maintenance of P-203", "No specific maintenance actions were recorded for it. The text does not specify any particular maintenance tasks. An inspection is scheduled for P-203 [1]."),
    ("Which valve?", "Short."),
    ("flow of the pump", "The documents do not say. The value is not specified in the records."),
    ("colour of the tower", "Nothing fits here at all, dear reader."),
    ("Draft an email summarizing hot work rules for the site safety team", "Subject: Request for Approval of works\nDear Mr. Rao,\nI am writing to request your immediate attention to gaps. We list rules. Specifically, we require confirmation of gas tests."),
    ("Draft an email summarizing hot work rules", "Subject: Rules for E-330 now\nDear all,\nHot work needs a permit."),
    ("Draft email requesting approval of the plan", "Subject: Plan\nDear Sir,\nPlease approve the plan."),
    ("", "An answer to nothing in particular."),
    (None, None),
]
MARKDOWN = [
    "# Hot Work Report\n## Executive Summary\nAll is documented.\nMore.\n## Permits\nA permit is needed.\n- gas test\n* fire watch\n1. isolate\n| Item | Limit |\n|---|---|\n| LEL | 1 % |\n| O2 | 21 % |\nWARNING: keep clear**\n## Conclusion\nDone.",
    "Title: **Pump notes**\nfirst line\n**Section 2: Seals**\nSeal text\n| a | b |\n| only header |\nSAFETY NOTES:\n| x |\n|---|\n### Empty\n### Last overview\nin short",
    "no structure here\nat all",
    "",
    "| lone | table |\n|---|---|\n| 1 | 2 |",
]
INSPECTIONS = [
    "**Equipment ID:** V-2201 (Knockout Drum)\nReport No: IR-77\n**Design Pressure:** 10.5 kg/cm2g | Design Temperature: 120 C\n| Shell (Bottom) | 12.0 | 10.2 |\n| Head (Top) | 14 | 13.1 |\n**Inspector:** S. Example\nRecommendation: monitor yearly",
    "Equipment Tag: P-203\nDesign Pressure: 7 bar",
    "Report Number: X-1\nDesign pressure: unknown\nShell (Bottom) | 9.5 | 8",
    "",
]
MODEL = [
    'Scene: P&ID drawing with a pump. Label "P-203" and "FIC-101" seen!  It appears that there is corrosion near the flange.\nThe vessel is unsafe and may leak badly soon.\n- 2. possible crack visible at the nozzle weld',
    "A control_panel photo",
    "",
    "Storage tank drawing (CAD) with process flow notes. Rust may be visible on the lower ring.",
]
RAW_OCR = [
    (1, json.dumps({"rec_polys": [[[10, 52], [60, 50], [60, 70], [10, 72]], [[5, 5], [40, 6], [40, 20], [5, 19]]], "rec_texts": ["second", "first"], "rec_scores": [1.2, 0.8]})),
    (2, json.dumps([[[[0, 0], [10, 0], [10, 5], [0, 5]], ["old style", 0.5]], [[[30, 1], [40, 1], [40, 6], [30, 6]], ["beside", -0.5]]])),
    (3, "not json"),
    (4, None),
    (5, "[]"),
]
fixtures.TABLES |= {
    "fx_answers": ([(i, a, b) for i, (a, b) in enumerate(ANSWERS)], "id int, question string, answer string"),
    "fx_markdown": ([(-100 - i, t) for i, t in enumerate(MARKDOWN)], "doc_id long, text string"),
    "fx_inspections": ([(-200 - i, t) for i, t in enumerate(INSPECTIONS)], "doc_id long, text string"),
    "fx_model": ([(i, t) for i, t in enumerate(MODEL)], "id int, text string"),
    "fx_raw_ocr": (RAW_OCR, "id int, raw string"),
}


# ---- alignment: each conversation turn as the answer to the one before, beside inline pairs

PAIRS = cte("fx_answers") + ", pairs AS (SELECT 'a' || id AS id, question, answer FROM fx_answers UNION ALL SELECT * FROM (SELECT 'c' || conv_id || '.' || turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question, text FROM conversations) WHERE question IS NOT NULL)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    own = fixtures.table(spark, "fx_answers").select(F.concat(F.lit("a"), "id").alias("id"), "question", "answer")
    turns = read(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("."), "turn").alias("id"), F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")).alias("question"), F.col("text").alias("answer"))
    return own.unionByName(turns.where(F.col("question").isNotNull()))


def s_all(t: str, patterns: tuple[str, ...], put: str = "") -> str:
    for p in patterns:
        t = f"regexp_replace({t}, {q(p)}, {q(put)}, 'g')"
    return t


def s_blank(t: str) -> str:
    return s_strip(f"regexp_replace({t}, '[^\\S\\r\\n]+', ' ', 'g')")


def _alignment() -> str:
    from .oracles import s_search
    from .requests import EMAIL_TASK

    steps = [
        s_blank(s_all("coalesce(answer, '')", an.REMARKS)),
        s_strip(f"CASE WHEN regexp_matches(t, {q(an.RECORDED)}) THEN {s_all('t', (an.DENIAL,))} ELSE t END"),
        *(s_strip(s_all("t", (p,))) for p in an.GUESSES),
        s_strip("replace(replace(regexp_replace(t, '[^\\S\\r\\n]+', ' ', 'g'), ' .', '.'), ' ,', ',')"),
        f"CASE WHEN (contains(lower(question), 'ppe') OR contains(lower(question), 'personal protective equipment')) AND regexp_matches(t, {q(an.CIRCULAR)}) THEN {q(an.NOT_CIRCULAR)} ELSE t END",
    ]
    chain = ", ".join(f"k{i} AS (SELECT * EXCLUDE (t), {s} AS t FROM {f'k{i - 1}' if i else 'k'})" for i, s in enumerate(steps))
    last = len(steps) - 1
    dear = "'Dear ' || recipient || ','"
    first = lambda t, p, put: f"(CASE WHEN regexp_matches({t}, {q(p)}) THEN regexp_split_to_array({t}, {q(p)})[1] || {put} || {t}[length(regexp_split_to_array({t}, {q(p)})[1]) + length(regexp_extract({t}, {q(p)})) + 1:] ELSE {t} END)"
    mailed = f"CASE WHEN mail AND recipient IS NOT NULL AND regexp_matches(t, {q(an.SALUTATION)}) AND lower(regexp_extract(t, {q(an.SALUTATION)})) <> lower({dear}) THEN {first('t', an.SALUTATION, dear)} ELSE t END"
    now = f"lower(regexp_extract(t, {q(an.SUBJECT)}, 1))"
    wrong = "(" + " OR ".join(f"contains({now}, {q(w)})" for w in an.WRONG_SUBJECT) + ")"
    bare = f"'Subject: ' || regexp_replace(trim(regexp_extract(t, {q(an.SUBJECT)}, 1)), '(?i)\\s+for\\s+[A-Z]+-\\d+', '', 'g')"
    subject = f"CASE WHEN summary AND {wrong} THEN {first('t', an.SUBJECT, chr(39) + 'Subject: ' + chr(39) + ' || topic || ' + q(' — Summary'))} WHEN summary AND entities = '' AND regexp_matches({now}, '(?i)\\bfor\\s+[A-Z]+-\\d+\\b') THEN {first('t', an.SUBJECT, bare)} ELSE t END"
    told = f"CASE WHEN summary THEN regexp_replace(regexp_replace(t, {q(an.DEMAND)}, {q(an.NO_DEMAND)}, 'g'), {q(an.CONFIRM)}, 'Key requirements include: \\1.', 'g') ELSE t END"
    n, t = [], s_all("coalesce(answer, '')", an.REMARKS)
    for p in an.GUESSES:
        n.append(f"len(regexp_extract_all({t}, {q(p)}))")
        t = s_all(t, (p,))
    absent = " OR ".join(f"contains(lower(t), {q(w)})" for w in an.ABSENT)
    return f"""WITH {PAIRS}, {EMAIL_TASK}, k AS (SELECT pairs.id, question, answer, NULL::VARCHAR AS t, coalesce(output_format = 'email', false) AS mail, coalesce(output_format = 'email' AND email_purpose = 'summary', false) AS summary, recipient, topic, entities FROM pairs LEFT JOIN mails ON mails.id = pairs.id), {chain},
m1 AS (SELECT * EXCLUDE (t), {mailed} AS t FROM k{last}), m2 AS (SELECT * EXCLUDE (t), {subject} AS t FROM m1), m3 AS (SELECT * EXCLUDE (t), {told} AS t FROM m2), z AS (SELECT *, list_filter({s_search("coalesce(question, '')")}, lambda w: length(w) > 2) AS terms FROM m3)
SELECT id, t AS cleaned, len(terms) = 0 OR len(list_filter(terms, lambda w: contains(lower(t), w))) > 0 OR {absent} AS aligned, length(t) > {an.COMPLETE} AS complete, {' + '.join(n)} = 0 AS no_fabrication, CAST({' + '.join(n)} AS INTEGER) AS guesses FROM z"""


@query(_alignment())
def answer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("id", an.alignment(F.coalesce("question", F.lit("")), F.col("answer"), F.lit(True)).alias("x")).select("id", "x.*")


# ---- sections of answers

M = f"{TEXTS}, {cte('fx_markdown')}, marked AS (SELECT doc_id, text FROM texts UNION ALL SELECT doc_id, text FROM fx_markdown)"
PIPED = "regexp_matches(x, '^\\|.*\\|$')"
RULE = "len(list_filter(list_transform(string_split(x[2:-2], '|'), lambda c: trim(c)), lambda c: c <> '' AND NOT regexp_matches(c, '^:?-+:?$'))) = 0"


@query(
    f"""WITH {M}, f AS (SELECT doc_id, list_filter(list_transform({s_lines("text")}, lambda x: {s_strip("x")}), lambda x: x <> '') AS r FROM marked), e AS (SELECT doc_id, unnest(range(1, len(r) + 1)) AS pos, unnest(r) AS x FROM f),
t AS (SELECT *, pos = 1 AND (starts_with(x, '# ') OR starts_with(lower(x), 'title:')) AS titled, {PIPED} AS piped FROM e),
h AS (SELECT *, NOT titled AND NOT piped AND regexp_matches(x, {q(an.HEADING)}) AND NOT regexp_matches(x, {q(an.NOT_HEADING)}) AS heading FROM t), s AS (SELECT *, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM h WHERE NOT titled),
k AS (SELECT *, regexp_matches(x, {q(an.NOTICE)}) AS notice, regexp_matches(x, {q(an.BULLET)}) AS bullet, sum(CASE WHEN piped THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, sec ORDER BY pos) AS run FROM s),
tb AS (SELECT doc_id, sec, run, count(*) AS n, min(pos) AS top FROM k WHERE piped GROUP BY ALL), tr AS (SELECT k.doc_id, k.sec, k.run, count(*) FILTER (pos = top OR NOT {RULE}) AS n FROM k JOIN tb ON k.doc_id = tb.doc_id AND k.sec = tb.sec AND k.run = tb.run WHERE piped AND tb.n >= 2 GROUP BY ALL HAVING count(*) FILTER (pos = top OR NOT {RULE}) >= 2),
lt AS (SELECT doc_id, sec, arg_max(n, run) AS n_rows FROM tr GROUP BY ALL),
g AS (SELECT doc_id, sec, coalesce(max(CASE WHEN heading THEN regexp_replace({s_strip("regexp_replace(x, '^#+', '')")}, '^[*_:]+|[*_:]+$', '', 'g') END), {q(an.FIRST_SECTION)}) AS heading, count(*) FILTER (NOT heading AND NOT piped AND NOT notice AND NOT bullet) AS n_paragraphs, count(*) FILTER (NOT heading AND NOT piped AND NOT notice AND bullet) AS n_bullets,
regexp_replace(regexp_extract(arg_max(x, pos) FILTER (NOT heading AND NOT piped AND notice), {q(an.NOTICE_TEXT)}, 1), '^[*_]+|[*_]+$', '', 'g') AS callout FROM k GROUP BY ALL),
u AS (SELECT g.*, n_rows FROM g LEFT JOIN lt ON g.doc_id = lt.doc_id AND g.sec = lt.sec WHERE n_paragraphs + n_bullets > 0 OR n_rows IS NOT NULL OR callout IS NOT NULL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS INTEGER) AS section, heading, CAST(n_paragraphs AS INTEGER) AS n_paragraphs, CAST(n_bullets AS INTEGER) AS n_bullets, CAST(n_rows AS INTEGER) AS n_rows, callout FROM u
WHERE NOT ({' OR '.join(f"contains(lower(heading), {q(w)})" for w in (*an.SUMMARY, *an.CONCLUSION))})"""
)
def answer_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir).unionByName(fixtures.table(spark, "fx_markdown"))
    found = rows.select("doc_id", F.posexplode(an.sections(F.col("text"))["sections"]).alias("section", "s"))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return found.select("doc_id", "section", "s.heading", F.size("s.paragraphs").alias("n_paragraphs"), F.size("s.bullets").alias("n_bullets"), size("s.table").alias("n_rows"), "s.callout")


@query(
    f"""WITH {M}, f AS (SELECT doc_id, list_filter(list_transform({s_lines("text")}, lambda x: {s_strip("x")}), lambda x: x <> '') AS r FROM marked)
SELECT doc_id, CASE WHEN len(r) > 0 AND (starts_with(r[1], '# ') OR starts_with(lower(r[1]), 'title:')) THEN regexp_replace(trim(regexp_replace(r[1], '(?i)^(#\\s*|title:\\s*)', '')), '^[*_`#]+|[*_`#]+$', '', 'g') ELSE {q(an.TITLE)} END AS title FROM f"""
)
def answer_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir).unionByName(fixtures.table(spark, "fx_markdown"))
    return rows.select("doc_id", an.sections(F.col("text"))["title"].alias("title"))


# ---- report fields, model texts, recognised records

I = cte("fx_inspections") + ", inspected AS (SELECT doc_id, text FROM fx_inspections UNION ALL SELECT doc_id, text FROM documents)"


def _s_field(n: str) -> str:
    p, i = fd.FIELDS[n]
    found = f"nullif(trim(regexp_extract(text, {q(p)}, {i})), '')"
    return f"try_cast({found} AS DOUBLE)" if n in fd.NUMBERS else found


@query(f"WITH {I}, f AS (SELECT doc_id, {', '.join(f'{_s_field(n)} AS {n}' for n in fd.FIELDS)} FROM inspected) SELECT *, array_to_string(list_filter([{', '.join(f'CASE WHEN {n} IS NULL THEN {q(n)} END' for n in fd.CRITICAL)}], lambda x: x IS NOT NULL), ',') AS missing_critical FROM f")
def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, "fx_inspections").unionByName(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", fd.report_fields(F.col("text")).alias("f")).select("doc_id", "f.*").withColumn("missing_critical", F.array_join("missing_critical", ","))


T = cte("fx_model") + ", told AS (SELECT 'm' || id AS id, text FROM fx_model UNION ALL SELECT 'c' || conv_id || '.' || turn, text FROM conversations)"
SANE = s_strip(sub("text", fd.CONTROL, ""))


def _s_keyword(table: tuple, other: str) -> str:
    return s_case([*((f"contains(lower(t), {q(k)})", q(v)) for k, v in table), (None, q(other))])


_ends = "regexp_replace(t, '([.!?])\\s+', '\\1' || chr(57345), 'g')"


@query(
    f"""WITH {T}, s AS (SELECT id, {SANE} AS t FROM told) SELECT id, {_s_keyword(fd.SCENES, "unknown")} AS scene, {_s_keyword(fd.DRAWINGS, "UNKNOWN")} AS drawing, array_to_string(string_split({_ends}, chr(57345))[1:2], ' ') AS caption,
CASE WHEN length(t) < 20 THEN 0.4::DOUBLE WHEN length(t) < 100 THEN 0.65::DOUBLE ELSE 0.8::DOUBLE END AS confidence, array_to_string(regexp_extract_all(t, '"([^"]{{2,60}})"', 1)[1:10], '; ') AS labels,
array_to_string(list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(trim(x), '^[*\\-•1-9. ]+', '')), lambda x: length(x) >= 15 AND NOT regexp_matches(x, {q(fd.FORBIDDEN)}) AND regexp_matches(x, {q(fd.HEDGED)})), lambda x: x[1:400]), '; ') AS observations FROM s"""
)
def model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, "fx_model").select(F.concat(F.lit("m"), "id").alias("id"), "text").unionByName(read(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("."), "turn").alias("id"), "text"))
    found = rows.select("id", fd.model_text(F.col("text")).alias("x")).select("id", "x.*")
    return found.withColumns({c: F.array_join(c, "; ") for c in ("labels", "observations")})


@query(
    f"""WITH {cte("fx_raw_ocr")}, j AS (SELECT id, CAST(raw AS JSON) AS j FROM fx_raw_ocr WHERE json_valid(raw)), a AS (SELECT id, unnest(CASE WHEN json_type(j) = 'OBJECT' THEN list_transform(range(0, CAST(json_array_length(j, '$.rec_texts') AS BIGINT)), lambda i: {{'p': json_extract(j, '$.rec_polys[' || i || ']'), 't': json_extract_string(j, '$.rec_texts[' || i || ']'), 'c': CAST(json_extract(j, '$.rec_scores[' || i || ']') AS DOUBLE)}})
ELSE list_transform(range(0, CAST(json_array_length(j) AS BIGINT)), lambda i: {{'p': json_extract(j, '$[' || i || '][0]'), 't': json_extract_string(j, '$[' || i || '][1][0]'), 'c': CAST(json_extract(j, '$[' || i || '][1][1]') AS DOUBLE)}}) END) AS r FROM j),
b AS (SELECT id, r.t AS text, least(1.0::DOUBLE, greatest(0.0::DOUBLE, r.c)) AS confidence, list_transform(CAST(r.p AS DOUBLE[][]), lambda p: p[1]) AS xs, list_transform(CAST(r.p AS DOUBLE[][]), lambda p: p[2]) AS ys FROM a)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY round_even(list_min(ys) / 10, 0) * 10, list_min(xs), list_min(ys)) - 1 AS INTEGER) AS pos, text, confidence, list_min(xs) AS "left", list_min(ys) AS top, list_max(xs) AS "right", list_max(ys) AS bottom FROM b"""
)
def recognised_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.recognised(fixtures.table(spark, "fx_raw_ocr", sf_dir), "id", "raw")


# ---- results and lookups

@query("SELECT c_custkey, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, c_acctbal / 5000)), 6) AS score FROM customer")
def capped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(fd.capped(F.col("c_acctbal") / 5000), 6).alias("score"))


@query("SELECT event_type, round(avg(CASE WHEN value < 20 THEN NULL ELSE value END), 6) AS mean, count(*) FILTER (value >= 60) AS n_trusted FROM events GROUP BY event_type")
def mean_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values of 20 or more as measured confidences, those of 60 or more trusted."""
    rows = read(spark, sf_dir, "events").select("event_type", F.when(F.col("value") >= 20, F.col("value")).alias("value"))
    return fd.mean_confidence(rows, "event_type", "value", 60).withColumn("mean", F.round("mean", 6))


POINTS = "points AS (SELECT doc_id, source AS document, regexp_extract_all(text, '\\b([A-Z]{1,4}-\\d{2,4}[A-Z]?)\\b', 1) AS equipment FROM documents)"


@query(f"WITH {POINTS}, f AS (SELECT doc_id, 'equipment' AS found_by FROM points WHERE list_contains(equipment, 'P-203') UNION ALL SELECT doc_id, 'document' FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM points WHERE document = 'src1') WHERE n <= 100 UNION ALL SELECT doc_id, 'id' FROM points WHERE doc_id = 7) SELECT * FROM f")
def point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By tag, by document (100 at most, by id, which is the feature), and by id."""
    docs = read(spark, sf_dir, "documents")
    points = docs.select("doc_id", F.col("source").alias("document"), F.regexp_extract_all("text", F.lit(r"\b([A-Z]{1,4}-\d{2,4}[A-Z]?)\b"), 1).alias("equipment"))
    found = {"equipment": vectors.find_by_equipment(points, "P-203", "doc_id"), "document": vectors.find_by_document(points, "src1", "doc_id"), "id": vectors.point(points, 7, "doc_id")}
    out = None
    for name, rows in found.items():
        part = rows.select("doc_id", F.lit(name).alias("found_by"))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections under their breadcrumbs."""
    return structure.chunks(texts(spark, sf_dir), "doc_id", "text", "section")


@query(chunk_sql.tables(M))
def chunk_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe tables, long ones in parts that repeat the header."""
    rows = texts(spark, sf_dir).unionByName(fixtures.table(spark, "fx_markdown"))
    return structure.chunks(rows, "doc_id", "text", "table")

