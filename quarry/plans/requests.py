"""What requests ask for, over benchmark passages, conversation turns and inline requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intents as it
from ..functions import queries as qf
from ..functions import text as tx
from ..operators import prompts
from . import fixtures
from .cleaning import s_strip, sub
from .fixtures import cte
from .fixtures import literal as q
from .registry import query, read

REQUESTS = [
    "Draft an email summarizing the hot work requirements for the site safety team using only the provided documents.",
    "Draft email requesting approval of the overhaul of P-203 to the Maintenance Manager.",
    "Write an email notifying the shift crew about the CDU-1 shutdown",
    "Compose an email asking the operators to take action on V-102A, based only on the records",
    "Send email to John Smith regarding recommendation for HX-01",
    "Prepare an email confirming the test addressed to the lab staff.",
    "Draft an approval note for K-3044",
    "Create a PDF report on pump vibration, do not use outside information",
    "Export as docx the safety requirements of hot work",
    "Generate an Excel spreadsheet comparing P-203 versus P-204",
    "Make a powerpoint presentation about the step-by-step startup",
    "Save an email as a word document to the audit department",
    "Generate an image of a refinery at night",
    "Show me what a modern refinery might look like from above.",
    "Can you visualize a distillation tower and the equipment around it?",
    "An aerial view of the tank farm",
    "Analyze this P&ID drawing and list the valves",
    "Read the nameplate in photos/pump_7.jpg",
    "What does this diagram show?",
    "Inspect scans/report.pdf for cracks",
    "Calculate the MAWP of V-101 with a corrosion allowance of 3 mm",
    "Write a script to parse tags, write python",
    "Generate a checklist for confined space entry",
    "Procedure for isolation of E-330",
    "Compare OISD 105 with API 650",
    "What fields are required in the template?",
    "Summarize the inspection findings of C-118",
    "List the interlocks",
    "Explain how cavitation starts",
    "compute flow rate for line L-12",
    "Which PPE is needed?",
    "What is the design pressure of the knockout drum V-9?",
    "maintenance action recorded for MOV-101",
    "Root cause of the trip of K-101",
    "hello",
    "",
    "   ",
    "the using of it",
    "Prepare a report on the corrosion of the overhead line and of all the nozzles that were found thin in the last turnaround",
]
fixtures.TABLES["fx_requests"] = ([(i, t) for i, t in enumerate(REQUESTS)], "id int, text string")
ALL = cte("fx_requests") + ", requests AS (SELECT 'r' || id AS id, text FROM fx_requests UNION ALL SELECT 'b' || item_id, text FROM benchmark UNION ALL SELECT 'c' || conv_id || '.' || turn, text FROM conversations)"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fixtures.table(spark, "fx_requests").select(F.concat(F.lit("r"), "id").alias("id"), "text")
    bench = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), "text")
    return own.unionByName(bench).unionByName(read(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("."), "turn").alias("id"), "text"))


# letters beyond ASCII belong to words in Java's \b, not in RE2's
ASCII = "regexp_replace({}, '[^\\x00-\\x7F]', '_', 'g')"


def s_case(rows: list[tuple[str | None, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rows if c is not None) + f" ELSE {next((v for c, v in rows if c is None), 'NULL')} END"


def s_in(t: str, words: tuple[str, ...]) -> str | None:
    """Whether t holds any of the words, by substring."""
    return "(" + " OR ".join(f"contains({t}, {q(w)})" for w in words) + ")" if words else None


def s_match(t: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches({t}, {q('(?i)' + p)})" for p in patterns) + ")"


def s_pick(table: tuple, i: int) -> str:
    return s_case([(s_in("low", row[0]), q(row[i])) for row in table])


S_CAPITAL = "upper(regexp_replace(x, '^ß', 'Ss')[1]) || lower(regexp_replace(x, '^ß', 'Ss')[2:])"
S_TITLE = f"array_to_string(list_transform(regexp_extract_all({{}}, '[\\p{{{{L}}}}]+|[^\\p{{{{L}}}}]+'), lambda x: {S_CAPITAL}), '')"


def s_recipient() -> str:
    found = [f"trim(regexp_replace(regexp_extract(t, {q(p)}, 1), '[,.]+$', ''))" for p in it.RECIPIENTS]
    return "coalesce(" + ", ".join(f"CASE WHEN length({f}) >= 3 AND lower({f}) NOT IN ({', '.join(map(q, it.NOT_RECIPIENTS))}) AND len(regexp_split_to_array({f}, '\\s+')) <= 5 THEN {S_TITLE.format(f)} END" for f in found) + ")"


TOPIC_STEPS = ", ".join(f"s{i} AS (SELECT *, trim(regexp_replace({f's{i - 1}.t{i - 1}' if i else 't'}, {q(cut)}, {q('')})) AS t{i} FROM {f's{i - 1}' if i else 'n'})" for i, cut in enumerate(it.TOPIC_CUTS))
LAST = len(it.TOPIC_CUTS) - 1
S_TOPIC = f"CASE WHEN t{LAST} = '' THEN {q(it.NO_TOPIC)} WHEN len(regexp_split_to_array(t{LAST}, '\\s+')) <= 8 THEN array_to_string(list_transform(regexp_split_to_array(t{LAST}, '\\s+'), lambda x: {S_CAPITAL}), ' ') ELSE {S_TITLE.format(f't{LAST}[1:50]')} END"
S_TAGS = f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(t, {q(qf.TAG)}, 0), lambda m: upper(regexp_replace(m, '(?i)^([A-Z]{{1,4}})[-_]?', '\\1-'))), lambda x: NOT list_contains({q(qf.EXCLUDED_PREFIXES)}, split_part(x, '-', 1)) AND (length(split_part(x, '-', 1)) > 1 OR length(split_part(x, '-', 2)) >= 3))))"
SQUEEZED = s_strip(sub("coalesce(text, '')", f"[{tx.WS}]+", " "))
ARTIFACT = s_case([(s_match("a", p), q(name)) for name, p in it.FILES.items()])
BY_KIND = f"CASE WHEN made AND NOT picture THEN {{0}} WHEN made THEN {{1}} WHEN email THEN {{2}} ELSE {{3}} END"


def s_tasks(source: str) -> str:
    """CTEs that end in `tasks`: what each row (id, text) of source asks for."""
    return f"""n AS (SELECT id, {SQUEEZED} AS t, {ASCII.format(SQUEEZED)} AS a, lower({SQUEEZED}) AS low FROM {source}), {TOPIC_STEPS},
tk AS (SELECT *, {ARTIFACT} AS artifact, {s_in("low", it.EMAIL)} AS email FROM s{LAST}), tm AS (SELECT *, artifact IS NOT NULL AS made, coalesce(artifact = 'png', false) AS picture FROM tk), tasks AS (
SELECT id, {BY_KIND.format("'generate_document'", "'generate_image'", s_pick(it.EMAIL_PURPOSES, 1), s_pick(it.TEXTS, 1))} AS operation, {BY_KIND.format("'artifact'", "'image'", "'email'", s_pick(it.TEXTS, 2))} AS output_format,
CASE WHEN email AND NOT made THEN {s_pick(it.EMAIL_PURPOSES, 2)} ELSE 'none' END AS email_purpose, CASE WHEN email AND NOT picture THEN {s_recipient()} END AS recipient, {S_TOPIC} AS topic, array_to_string({S_TAGS}, ',') AS entities,
{s_match("a", it.STRICT)} AS strict, {BY_KIND.format(s_pick(it.DOCUMENTS, 1), "'general_qa'", "'email'", s_pick(it.TEXTS, 3))} AS archetype, artifact FROM tm)"""


#: The tasks of the questions in `pairs`, for answer_alignment.
EMAIL_TASK = "questions AS (SELECT id, question AS text FROM pairs), " + s_tasks("questions") + ", mails AS (SELECT * FROM tasks)"


@query(f"WITH {ALL}, {s_tasks('requests')} SELECT * FROM tasks")
def task_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = requests(spark, sf_dir).select("id", it.task(F.col("text")).alias("x")).select("id", "x.*")
    return rows.withColumn("entities", F.array_join("entities", ","))


S_LOOKS = s_match("a", it.ANALYTICAL)
S_KIND = s_case([("a = ''", "'empty'"), (f"{S_LOOKS} AND ({s_match('a', it.EXISTING)} OR {s_match('a', it.IMAGE_FILE)})", "'vision'"), (f"{s_match('a', it.VISUALS)} OR ({s_match('a', it.VIEWS)} AND NOT {S_LOOKS})", "'picture'"), (s_match("a", it.OFFICE), "'document'"), (s_match("a", it.SUMS), "'calculation'"), (s_match("a", it.CODE), "'code'"), (None, "'retrieval'")])
S_OFFICE = s_case([(s_in("low", w), q(tool)) for w, tool in it.OFFICE_TOOLS])


def s_tool(capability: str) -> str:
    return s_case([(f"{capability} = 'document_generation'", S_OFFICE), *((f"{capability} = {q(k)}", q(v)) for k, v in it.TOOLS.items()), (None, "'rag_pipeline'")])


CENTRAL_ROWS = ", ".join(f"({q(k)}, {', '.join(q(x) if isinstance(x, str) else str(x).lower() for x in v)})" for k, v in it.CENTRAL.items())


@query(
    f"""WITH {ALL}, n AS (SELECT id, lower(trim(coalesce(text, ''))) AS low, {ASCII.format("trim(coalesce(text, ''))")} AS a FROM requests), k AS (SELECT *, {S_KIND} AS kind FROM n), c(kind, action, output, target, capability, use_context) AS (VALUES {CENTRAL_ROWS})
SELECT id, action, output, target, capability, {s_tool("capability")} AS tool, use_context FROM k JOIN c USING (kind)"""
)
def central_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("id", it.central(F.col("text")).alias("x")).select("id", "x.*")


S_DRAWING = f"({s_in('low', it.DRAWING)} OR regexp_matches(low, '\\b(?:{'|'.join(it.DRAWING_WORDS)})\\b'))"
S_TAKEN = [("kind = 'picture'", ("image_generation", "image_generation", "general_qa")), (f"kind = 'vision' AND {S_DRAWING}", ("engineering_drawing_analysis", "vision", "general_qa")), ("kind = 'vision'", ("vision_ocr", "vision", "general_qa")), ("kind = 'document'", ("document_generation", "document_generation", "report")), ("kind = 'calculation'", ("calculation", "calculation", "equipment_lookup")), ("kind = 'code'", ("coding", "coding", "general_qa"))]
S_ROUTED = "CASE " + " ".join(f"WHEN {c} THEN {q('|'.join(v))}" for c, v in [*S_TAKEN, *((s_match("a", it.ROUTE_PATTERNS[r[0]]) if r[0] in it.ROUTE_PATTERNS else s_in("low", r[3]), r[:3]) for r in it.ROUTES)]) + " ELSE 'general_qa|unknown|general_qa' END"
ROUTED = f"""{ALL}, n AS (SELECT id, lower({SQUEEZED}) AS low, {ASCII.format(f"lower({SQUEEZED})")} AS a FROM requests), k AS (SELECT *, {S_KIND} AS kind FROM n), r AS (SELECT *, {S_ROUTED} AS r FROM k),
routed AS (SELECT id, low, split_part(r, '|', 1) AS task, split_part(r, '|', 2) AS capability, split_part(r, '|', 3) AS archetype FROM r)"""


@query(f"WITH {ROUTED} SELECT id, task, capability, archetype, {s_tool('capability')} AS tool, task NOT IN ('general_qa', 'image_generation', 'vision_ocr', 'engineering_drawing_analysis', 'coding') AS use_context FROM routed")
def request_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("id", it.route(F.col("text")).alias("x")).select("id", "x.*")


S_SYSTEM = "CASE archetype " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in prompts.PERSONAS.items()) + f" ELSE {q(prompts.PERSONAS['general_qa'])} END || {q(prompts.DIRECTIVES_PART)}"


@query(f"WITH {ROUTED} SELECT id, archetype, sha256({S_SYSTEM}) AS system_hash, CASE WHEN archetype IN ({', '.join(map(q, prompts.TEMPLATES))}) THEN archetype ELSE 'general_qa' END AS template FROM routed")
def system_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The system prompt and template that each request's route takes."""
    rows = requests(spark, sf_dir).select("id", it.route(F.col("text"))["archetype"].alias("archetype"))
    return rows.select("id", "archetype", F.sha2(prompts.system_prompt(F.col("archetype")), 256).alias("system_hash"), prompts.template(F.col("archetype"))["name"].alias("template"))
