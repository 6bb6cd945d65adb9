"""Extractors and prompt steps chained: a parsed row for each document, a prompt for each question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intents as it
from ..operators import candidates, lexical, parsing, prompts
from ..operators import evaluation as ev
from . import collection, fixtures, hybrid_sql, requests
from .cleaning import s_strip, s_words
from .fixtures import literal as q
from .hybrid import chunk_table
from .oracles import EDGE_TEXT, ORACLES
from .registry import query, read

#: Edges of the documents alone.
_edges = ORACLES["entity_edges"].replace(f"SELECT 1::BIGINT AS doc_id, {q(EDGE_TEXT)} AS text UNION ALL ", "")


@query(
    f"""WITH s AS (SELECT doc_id, count(*) AS n, string_agg(title, '; ' ORDER BY section) AS titles FROM ({ORACLES["sections"]}) GROUP BY doc_id), t AS (SELECT doc_id, count(*) AS n FROM ({ORACLES["pipe_tables"]}) GROUP BY doc_id), r AS (SELECT doc_id, string_agg(target, '; ' ORDER BY pos) AS targets FROM ({ORACLES["cross_references"]}) GROUP BY doc_id),
w AS (SELECT doc_id, count(*) AS n FROM ({ORACLES["safety_warnings"]}) GROUP BY doc_id), e AS (SELECT doc_id, count(DISTINCT tag) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, {q(parsing.GRAPH_TAG)}, 1)) AS tag FROM documents) GROUP BY doc_id), g AS (SELECT doc_id, count(*) AS n FROM ({_edges}) GROUP BY doc_id), m AS ({ORACLES["operational_metadata"]})
SELECT d.doc_id, coalesce(s.n, 0) AS n_sections, coalesce(s.titles, '') AS titles, coalesce(t.n, 0) AS n_tables, coalesce(r.targets, '') AS targets, coalesce(w.n, 0) AS n_warnings, coalesce(e.n, 0) AS n_equipment, coalesce(g.n, 0) AS n_edges, m.dates, m.revisions FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN w USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN m USING (doc_id)"""
)
def parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through all extractors."""
    rows = parsing.parsed(read(spark, sf_dir, "documents"), "doc_id", "text")
    joined = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), "; ")
    n = lambda c: F.size(c).cast("long")
    return rows.select("doc_id", n("sections").alias("n_sections"), joined("sections", "title").alias("titles"), n("tables").alias("n_tables"), joined("references", "target").alias("targets"), n("warnings").alias("n_warnings"), n("equipment").alias("n_equipment"), n("edges").alias("n_edges"), F.array_join("dates", "; ").alias("dates"), F.array_join("revisions", "; ").alias("revisions"))


_tok = "greatest(1, length({0}) // 4)"
_n = lambda c: f"CASE WHEN length({c}) = 0 THEN 0 ELSE greatest(1, length({c}) // 4) END"
_template = "CASE template " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in prompts.TEMPLATES.items()) + " END"
_salient = f"array_to_string(list_filter(string_split(context, chr(10)), lambda x: regexp_matches(x, {q(prompts.SALIENT)})), chr(10))"
_injected = " OR ".join(f"regexp_matches(prompt, {q(p)})" for p in ev.INJECTIONS)


@query(
    f"""WITH {requests.ROUTED}, pb AS (SELECT item_id AS query_id, text, archetype, {requests.S_SYSTEM} AS persona, CASE WHEN archetype IN ({", ".join(map(q, prompts.TEMPLATES))}) THEN archetype ELSE 'general_qa' END AS template FROM benchmark JOIN routed ON id = 'b' || item_id),
pc AS (SELECT query_id, context FROM ({hybrid_sql.PACKED})), ph AS (SELECT conv_id AS query_id, history FROM ({ORACLES["conversation_history"]})),
pj AS (SELECT query_id, text, template, persona || chr(10) || chr(10) || {_template} AS system, coalesce(context, '') AS context, coalesce(history, '') AS history FROM pb LEFT JOIN pc USING (query_id) LEFT JOIN ph USING (query_id)),
pk AS (SELECT * REPLACE (CASE WHEN {_tok.format("context")} <= {prompts.CONTEXT} THEN context WHEN {_salient} <> '' AND {_tok.format(_salient)} <= {prompts.CONTEXT} THEN {_salient} ELSE context[1:{4 * prompts.CONTEXT - 3}] || '...' END AS context) FROM pj),
pp AS (SELECT *, concat_ws(chr(10) || chr(10), CASE WHEN system <> '' THEN '## System' || chr(10) || system END, CASE WHEN context <> '' THEN '## Context' || chr(10) || context END, CASE WHEN history <> '' THEN '## History' || chr(10) || history END, CASE WHEN text <> '' THEN '## Question' || chr(10) || text END) AS prompt, {_n("system")} + {_n("history")} + {_n("context")} + {prompts.HEADROOM} AS tokens FROM pk)
SELECT query_id, sha256(prompt) AS prompt_sha, sha256('1' || chr(31) || system || chr(31) || context || chr(31) || text || chr(31) || 'local_llm') AS prompt_hash, template, CAST(tokens AS INTEGER) AS tokens, tokens <= {prompts.WINDOW - prompts.GENERATION} AS fits,
array_to_string(list_filter([CASE WHEN len({s_words("prompt")}) > {prompts.WINDOW} THEN 'too_long' END, CASE WHEN {_injected} THEN 'injection' END, CASE WHEN NOT regexp_matches(prompt, '\\[\\d+\\]') THEN 'no_citation' END], lambda x: x IS NOT NULL), ',') AS problems FROM pp"""
)
def prompt_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for each benchmark passage: its route's persona and template, the context of its hits, and the conversation of its number."""
    bench = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    asked = bench.withColumn("archetype", it.route(F.col("text"))["archetype"])
    chunks = chunk_table(read(spark, sf_dir, "documents"))
    hits = lexical.search(chunks, bench, "cid", "content", "query_id", "text", 10, 9).join(chunks, "cid")
    heading = F.concat(F.lit("["), (F.col("rank") + 1).cast("string"), F.lit("] Source: "), F.col("document").cast("string"))
    contexts = candidates.pack_context(hits, "query_id", "rank", heading, F.col("content"), 600)
    history = collection.conversation_history(spark, sf_dir).select(F.col("conv_id").alias("query_id"), "history")
    made = prompts.pipeline(asked, contexts, history)
    return made.select("query_id", F.sha2("prompt", 256).alias("prompt_sha"), "prompt_hash", "template", "tokens", "fits", F.array_join("problems", ",").alias("problems"))


MAILS = [
    (1, "From: ann@example.org\nTo: all@example.org\nSubject: Pump P-203\nDate: 12/05/2024\n\nPlease ensure: the valve is closed.\nNext steps - inspect HX-01 \n\nRegards"),
    (2, "No headers here.\n\nAction item: none"),
    (3, "From: bob@example.org\nSubject: \n\n"),
    (4, ""),
]
fixtures.TABLES["fx_mail"] = (MAILS, "id int, text string")
fixtures.MORE["fx_mail"] = "SELECT CAST(1000 + conv_id * 100 + turn AS INT), 'From: ' || role || chr(10) || 'Subject: ' || CASE WHEN turn > 0 THEN 'Re: ' ELSE '' END || 'case ' || CAST(conv_id AS STRING) || chr(10) || chr(10) || 'Next step: ' || text FROM {conversations}"


def _s_header(name: str, other: str) -> str:
    return f"coalesce(nullif(trim(regexp_extract(head, '(?im)^{name}:\\s*([^\\n]*)$', 1)), ''), {other})"


@query(
    f"""WITH {fixtures.cte("fx_mail")}, h AS (SELECT id, text, regexp_split_to_array(text, '\\n\\s*\\n')[1] AS head FROM fx_mail), b AS (SELECT *, CASE WHEN length(head) < length(text) AND regexp_matches(head, '(?m)^[A-Za-z-]+:\\s*[^\\n]*$') THEN regexp_replace(substr(text, length(head) + 1), '^\\n\\s*\\n', '') ELSE text END AS body FROM h)
SELECT id, {_s_header("subject", "'mail ' || id")} AS subject, {_s_header("from", "'Unknown Sender'")} AS sender, {_s_header("to", "'Unknown Recipient'")} AS recipient, {_s_header("date", "''")} AS sent, sha256(body) AS body_hash, array_to_string(list_transform(regexp_extract_all(body, {q(parsing.ACTION)}, 1), lambda x: {s_strip("x")}), '; ') AS actions FROM b"""
)
def email_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline messages, and each conversation's turns as messages of one thread."""
    rows = fixtures.table(spark, "fx_mail", sf_dir)
    m = parsing.email_message(F.col("text"), F.concat(F.lit("mail "), F.col("id").cast("string")))
    found = rows.select("id", m.alias("m")).select("id", "m.*")
    return found.select("id", "subject", "sender", "recipient", "sent", F.sha2("body", 256).alias("body_hash"), F.array_join("actions", "; ").alias("actions"))
