"""Chunking, audits, parsing and memory over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import audit, chunking, parsing
from . import fixtures
from .cleaning import s_strip, s_words, sub
from .fixtures import literal as q
from .registry import TEXTS, query, read, texts

SIZE, STEP = chunking.window_words()
CHUNKS = f"""w AS (SELECT doc_id, {s_words("text")} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - {SIZE}) / {STEP})) AS BIGINT) * {STEP} + 1, {STEP})) AS i FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, CAST(i // {STEP} AS INTEGER) AS chunk_index, array_to_string(w[i + 1 : i + {SIZE}], ' ') AS content FROM s),
chunks AS (SELECT doc_id, chunk_index, content, CAST(len(regexp_extract_all(content, {q(tx.TOKEN)})) AS BIGINT) AS token_count,
  format('chk_{{}}_p0_{{:04d}}_{{}}', substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8), chunk_index, substr(sha256({s_strip("content")}), 1, 8)) AS chunk_id FROM c)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.word_windows(read(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {CHUNKS} SELECT * FROM chunks")
def chunk_word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir)


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_index, chunk_id, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)")
def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.linked(windows(spark, sf_dir), "doc_id").select("doc_id", "chunk_index", "chunk_id", "prev_chunk_id", "next_chunk_id")


@query(
    f"""WITH {CHUNKS}, d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sha256({s_strip("content")}) ORDER BY chunk_index) AS n FROM chunks)
SELECT doc_id, chunk_index, CASE WHEN trim(content) = '' THEN 'empty' WHEN NOT regexp_matches(content, '[\\p{{L}}\\p{{N}}]') THEN 'no_alphanumeric' WHEN n > 1 THEN 'duplicate' WHEN token_count < {chunking.MIN_TOKENS} THEN 'too_small' END AS reason FROM d"""
)
def chunk_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.validated(windows(spark, sf_dir), "doc_id").select("doc_id", "chunk_index", "reason")


@query(f"WITH {CHUNKS} SELECT doc_id, count(*) AS n_chunks, round(avg(token_count), 2) AS avg_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens, CAST(sum(length(content)) AS BIGINT) AS n_chars FROM chunks GROUP BY doc_id")
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.statistics(windows(spark, sf_dir), "doc_id")


@query(
    """WITH s AS (SELECT doc_id, text AS t, unnest(range(0, CAST(greatest(0, ceil((length(text) - 1000) / 900)) AS BIGINT) * 900 + 1, 900)) AS i FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(i // 900 AS INTEGER) AS chunk_index, trim(CASE WHEN i + 1000 < length(t) THEN regexp_replace(substr(t, i + 1, 1000), ' [^ ]*$', '') ELSE substr(t, i + 1, 1000) END, ' ') AS content FROM s
WHERE trim(CASE WHEN i + 1000 < length(t) THEN regexp_replace(substr(t, i + 1, 1000), ' [^ ]*$', '') ELSE substr(t, i + 1, 1000) END, ' ') <> ''"""
)
def chunk_character_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.character_windows(read(spark, sf_dir, "documents"), "doc_id", F.col("text"), 1000, 100)


@query("SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS canonical, count(*) - 1 AS redundant FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_groups(read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha")), "doc_id", "sha")


@query("WITH m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS c FROM documents) SELECT doc_id, doc_id > c AS is_duplicate, CASE WHEN doc_id > c THEN c END AS duplicate_of FROM m")
def duplicate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_flags(read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha")), "doc_id", "sha")


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT text) AS distinct_texts FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def collection_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("sha", F.sha2("text", 256))
    keys = [F.col("lang"), F.col("source")]
    return docs.groupingSets([[keys[0]], [keys[1]], []], *keys).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.countDistinct("sha").alias("distinct_texts"))


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(CASE WHEN i = least(floor(n * 0.5), n - 1) THEN value END) AS p50, max(CASE WHEN i = least(floor(n * 0.95::DOUBLE), n - 1) THEN value END) AS p95, max(CASE WHEN i = least(floor(n * 0.99::DOUBLE), n - 1) THEN value END) AS p99 FROM r GROUP BY event_type"""
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.nearest_rank(read(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


LINES = "l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM texts)"


@query(
    f"""WITH {TEXTS}, p AS (SELECT doc_id, regexp_extract_all(text, {q(parsing.CROSS_REFERENCE)}, 1) AS a FROM texts), r AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS target FROM p)
SELECT doc_id, pos, target, CASE WHEN upper(target) LIKE '%FIG%' THEN 'FIGURE' WHEN upper(target) LIKE '%TABLE%' THEN 'TABLE' WHEN upper(target) LIKE '%SECTION%' THEN 'SECTION' ELSE 'STANDARD' END AS ref_type FROM r"""
)
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.cross_references(texts(spark, sf_dir), "doc_id", F.col("text")).withColumn("pos", F.col("pos").cast("long"))


@query(
    f"""WITH {TEXTS}, {LINES}, w AS (SELECT doc_id, pos, CASE WHEN upper(line) LIKE '%DANGER%' THEN 'DANGER' WHEN upper(line) LIKE '%WARNING%' THEN 'WARNING' WHEN upper(line) LIKE '%CAUTION%' THEN 'CAUTION' END AS severity, {s_strip("line")} AS notice FROM l)
SELECT * FROM w WHERE severity IS NOT NULL AND length(notice) > 5"""
)
def safety_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.warnings(texts(spark, sf_dir), "doc_id", F.col("text")).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {TEXTS} SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, {q(parsing.DATE)}))), '; ') AS dates, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g'), {q(parsing.REVISION)}, 1))), '; ') AS revisions FROM texts")
def operational_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", F.array_join(parsing.dates(F.col("text")), "; ").alias("dates"), F.array_join(parsing.revisions(F.col("text")), "; ").alias("revisions"))


@query(
    f"""WITH {TEXTS}, {LINES}, a AS (SELECT doc_id, pos, {s_strip("line")} AS x, length(regexp_extract({s_strip("line")}, '^(#{{1,6}})\\s+(.*)$', 1)) AS md, regexp_extract({s_strip("line")}, '^(\\d+(?:\\.\\d+)*)\\s+(.*)$', 1) AS num FROM l),
b AS (SELECT *, CASE WHEN md > 0 THEN md WHEN num <> '' AND length(x) < 100 AND NOT ends_with(x, '.') THEN len(string_split(num, '.')) WHEN x = upper(x) AND length(x) >= 4 AND length(x) < 80 AND length({sub("x", "[^A-Z]", "")}) >= 3 AND NOT starts_with(x, '|') THEN 1 END AS level FROM a),
d AS (SELECT *, CASE WHEN level IS NOT NULL THEN CASE WHEN md > 0 THEN regexp_replace(x, '^#{{1,6}}\\s+', '') ELSE x END END AS title, count(level) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section, count(level) OVER (PARTITION BY doc_id) AS every FROM b)
SELECT doc_id, section, CAST(max(level) AS BIGINT) AS level, max(title) AS title, count(CASE WHEN level IS NULL AND x <> '' THEN 1 END) AS n_lines FROM d WHERE section > 0 OR every = 0 GROUP BY doc_id, section"""
)
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.sections(texts(spark, sf_dir), "doc_id", F.col("text"))


@query(
    f"""WITH {TEXTS}, {LINES}, a AS (SELECT doc_id, pos, {s_strip("line")} AS x FROM l), b AS (SELECT *, regexp_matches(x, '^\\|.*\\|$') AS t FROM a),
c AS (SELECT *, sum(CASE WHEN t THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM b), d AS (SELECT * FROM c WHERE t AND NOT regexp_matches(x, '^[|:\\s-]+$')),
e AS (SELECT doc_id, run, count(*) AS n_rows, CAST(arg_min(len(string_split(x, '|')) - 2, pos) AS BIGINT) AS n_cols FROM d GROUP BY doc_id, run HAVING count(*) >= 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run) AS INTEGER) AS table_no, n_rows, n_cols FROM e"""
)
def pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.pipe_tables(texts(spark, sf_dir), "doc_id", F.col("text")).select("doc_id", "table_no", "n_rows", "n_cols")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, turn, role, text FROM r WHERE n <= 10")
def conversation_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.lexical import top_k

    return top_k(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 10).drop("rank")


@query(
    f"""WITH r AS (SELECT *, len({s_words("text")}) AS n FROM conversations), s AS (SELECT *, sum(n) OVER w AS run, row_number() OVER w AS i FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING))
SELECT conv_id, string_agg('**' || CASE WHEN lower(role) = 'user' THEN 'User' ELSE 'Assistant' END || ':** ' || {s_strip("text")}, chr(10) || chr(10) ORDER BY turn) AS history, count(*) AS n_turns FROM s WHERE run <= 100 OR i = 1 GROUP BY conv_id"""
)
def conversation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ranking import within_budget

    kept = within_budget(read(spark, sf_dir, "conversations"), "conv_id", F.desc("turn"), tx.count_words(F.col("text")), 100)
    line = F.concat(F.lit("**"), F.when(F.lower("role") == "user", "User").otherwise("Assistant"), F.lit(":** "), tx.strip(F.col("text")))
    turns = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["line"]), "\n\n").alias("history"), F.count("*").alias("n_turns"))


@query(
    "SELECT conv_id, turn, coalesce(array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ','), '') AS before, coalesce(array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ','), '') AS after FROM conversations"
)
def neighbour_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.neighbours(read(spark, sf_dir, "conversations"), "conv_id", "turn", "turn", 2)
    return rows.select("conv_id", "turn", F.array_join(F.col("before").cast("array<string>"), ",").alias("before"), F.array_join(F.col("after").cast("array<string>"), ",").alias("after"))


@query("SELECT doc_id, lang, source FROM documents WHERE lang <> 'de' AND source IN ('src0', 'src1', 'src2') AND (n_chars >= 1000 OR contains(text, 'License')) AND NOT (lang IN ('fr', 'es') AND n_chars < 500)")
def filtered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.vectors import compile_filter

    keep = compile_filter(must=[("lang", "ne", "de"), ("source", "in", ["src0", "src1", "src2"])], should=[("n_chars", "ge", 1000), ("text", "contains", "License")])
    few = compile_filter(must=[("lang", "in", ["fr", "es"]), ("n_chars", "lt", 500)])
    return read(spark, sf_dir, "documents").where(keep & ~few).select("doc_id", "lang", "source")


@query(
    """WITH s AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE lang <> 'fr'), i AS (SELECT doc_id, sha256(CASE WHEN lang = 'de' THEN upper(text) ELSE text END) AS h FROM documents WHERE source <> 'src3')
SELECT coalesce(s.doc_id, i.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN 'new' WHEN i.doc_id IS NULL THEN 'deleted' WHEN s.h <> i.h THEN 'modified' ELSE 'unchanged' END AS change FROM s FULL OUTER JOIN i ON s.doc_id = i.doc_id"""
)
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored: all but French. Incoming: all but src3, German in capitals."""
    from ..operators.vectors import changes

    docs = read(spark, sf_dir, "documents")
    stored = docs.where("lang <> 'fr'").select("doc_id", F.sha2("text", 256).alias("h"))
    incoming = docs.where("source <> 'src3'").select("doc_id", F.sha2(F.when(F.col("lang") == "de", F.upper("text")).otherwise(F.col("text")), 256).alias("h"))
    return changes(stored, incoming, "doc_id", "h")


@query("SELECT l.doc_id, d.lang, l.quality FROM labels l JOIN documents d USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM labels t WHERE t.doc_id = l.doc_id AND t.toxic = 1)")
def labelled_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents")
    return labels.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti").join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "quality")


@query(f"WITH {fixtures.CHUNK_ROWS} SELECT document_id, count(*) AS n, CAST(sum(length(content) + 2) AS BIGINT) AS chars FROM chunk_rows GROUP BY document_id")
def page_map_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.chunk_rows(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("n"), F.sum(F.length("content") + 2).alias("chars"))


@query(
    f"""WITH {fixtures.CHUNK_ROWS} SELECT chunk_id, CAST(coalesce(sum(length(content) + 2) OVER (PARTITION BY document_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start,
CAST(sum(length(content) + 2) OVER (PARTITION BY document_id ORDER BY chunk_index) - 2 AS BIGINT) AS char_end FROM chunk_rows"""
)
def citation_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("document_id").orderBy("chunk_index")
    size = F.length("content") + 2
    return fixtures.chunk_rows(spark, sf_dir).select("chunk_id", F.coalesce(F.sum(size).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("char_start"), (F.sum(size).over(w) - 2).cast("long").alias("char_end"))
