"""Assembly of documents from laid-out lines, and exports, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly, ocr, parsing
from .cleaning import s_strip, s_words
from .fixtures import literal as q
from .registry import TEXTS, query, texts

_x = s_strip("text")
_letters, _upper = ("length(regexp_replace(x, '[^\\p{" + c + "}]', '', 'g'))" for c in ("L", "Lu"))
LAID = f"""ln AS (SELECT doc_id AS doc, unnest(range(len(a))) AS pos, unnest(a) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM texts)),
bl AS (SELECT doc, CAST(pos // {assembly.PAGE_LINES} + 1 AS INTEGER) AS page, CAST(pos % {assembly.PAGE_LINES} AS INTEGER) AS block, text, {_x} AS x, (pos % 7) / 7.0::DOUBLE AS conf FROM ln WHERE {_x} <> '')"""
# lines are 12 high and 16 apart, so a block is isolated where a blank line is above it
SECTIONS = f"""{LAID}, iso AS (SELECT *, coalesce(block - lag(block) OVER (PARTITION BY doc, page ORDER BY block) >= 2, false) AS iso, {_letters} AS letters, {_upper} AS upper_, regexp_extract(x, '^(\\d+(?:\\.\\d+)*)[.\\s]\\s*.+$', 1) AS num FROM bl),
hd AS (SELECT *, CASE WHEN letters < 3 THEN NULL WHEN num <> '' AND length(x) <= 120 AND NOT ends_with(x, '.') THEN 0.95 WHEN length(x) <= 80 AND upper_ / letters >= 0.75 AND NOT ends_with(x, '.') THEN 0.9 WHEN iso AND len({s_words("x")}) <= 10 AND NOT regexp_matches(x, '[.,;\\d]$') THEN 0.8 END AS sure FROM iso),
hl AS (SELECT *, CASE sure WHEN 0.95 THEN least(len(string_split(num, '.')), 6) WHEN 0.9 THEN 1 WHEN 0.8 THEN 2 END AS lv, count(sure) OVER (PARTITION BY doc, page ORDER BY block) AS g FROM hd),
bo AS (SELECT *, 16 * (lead(block) OVER w - block) - 12 AS gap FROM hl WHERE sure IS NULL WINDOW w AS (PARTITION BY doc, page, g ORDER BY block)), bm AS (SELECT *, coalesce(median(gap) OVER (PARTITION BY doc, page, g), 5) AS typical FROM bo),
pa AS (SELECT doc, page, g, string_agg(text, chr(10) ORDER BY block) AS content, 1 + count(CASE WHEN gap >= greatest(typical * 1.8::DOUBLE, 8) OR gap IS NOT NULL AND regexp_matches(x, '[.!?]$') THEN 1 END) AS n_paragraphs, avg(conf) AS mean FROM bm GROUP BY ALL),
he AS (SELECT doc, page, g, x AS title, lv, sure FROM hl WHERE sure IS NOT NULL), jo AS (SELECT doc, page, g, title, lv, sure, content, n_paragraphs, mean, CASE WHEN title IS NULL THEN content WHEN content IS NULL THEN title ELSE title || chr(10) || content END AS shown FROM he FULL OUTER JOIN pa USING (doc, page, g)),
sections AS (SELECT doc, page, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY g) - 1 AS INTEGER) AS section, coalesce(title, '{assembly.UNTITLED}') AS title, CAST(coalesce(lv, 1) AS INTEGER) AS level, title IS NOT NULL AS explicit, coalesce(content, '') AS content, CAST(coalesce(n_paragraphs, 0) AS BIGINT) AS n_paragraphs, round(coalesce(mean, sure, 0.9)::DOUBLE, 4) AS confidence,
CAST(coalesce(sum(length(shown) + 2) OVER (PARTITION BY doc ORDER BY page, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start, length(shown) AS size, shown FROM jo)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.laid_out(texts(spark, sf_dir), "doc_id", "text")


@query(f"WITH {TEXTS}, {SECTIONS} SELECT doc, page, section, title, level, explicit, sha256(content) AS content_hash, n_paragraphs, confidence, char_start, char_start + size AS char_end FROM sections")
def assembled_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = assembly.sections(blocks(spark, sf_dir))
    return made.withColumn("content_hash", F.sha2("content", 256)).drop("content")


@query(f"WITH {TEXTS}, {SECTIONS} SELECT doc, page, min(char_start) AS char_start, max(char_start + size) AS char_end, count(*) AS n_sections FROM sections GROUP BY ALL")
def assembled_page_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.page_map(assembly.sections(blocks(spark, sf_dir)))


TITLES = f"""fp AS (SELECT doc, min(page) AS page FROM bl GROUP BY doc), nm AS (SELECT doc, arg_min(title, section) AS t FROM sections SEMI JOIN fp USING (doc, page) WHERE explicit AND len({s_words("title")}) BETWEEN 1 AND 12 GROUP BY doc),
lo AS (SELECT doc, arg_min(x, block) AS t FROM bl SEMI JOIN fp USING (doc, page) WHERE length(x) <= 120 AND {_letters} >= 3 AND {_upper} / {_letters} >= 0.75 GROUP BY doc), titles AS (SELECT doc, coalesce(nm.t, lo.t, '') AS title FROM fp LEFT JOIN nm USING (doc) LEFT JOIN lo USING (doc))"""


@query(
    f"""WITH {TEXTS}, {SECTIONS}, {TITLES}, n AS (SELECT doc, count(DISTINCT page) AS total_pages FROM bl GROUP BY doc),
c AS (SELECT doc, count(*) AS total_sections, CAST(sum(n_paragraphs) AS BIGINT) AS total_paragraphs, CAST(sum(len({s_words("shown")})) AS BIGINT) AS total_words, max(char_start + size) AS total_characters FROM sections GROUP BY doc) SELECT * FROM titles JOIN n USING (doc) JOIN c USING (doc)"""
)
def assembled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir)
    return assembly.documents(rows, assembly.sections(rows))


@query(
    f"""WITH {TEXTS}, {SECTIONS}, o AS (SELECT *, row_number() OVER w AS seq, count(CASE WHEN explicit THEN 1 END) OVER (PARTITION BY doc ORDER BY page, section) AS number FROM sections WINDOW w AS (PARTITION BY doc ORDER BY page, section)), h AS (SELECT doc, number, seq, level, title FROM o WHERE explicit),
a AS (SELECT s.doc, s.number, string_agg(h.title, ' > ' ORDER BY h.seq) AS path FROM h s JOIN h ON h.doc = s.doc AND h.seq <= s.seq AND NOT EXISTS (SELECT 1 FROM h m WHERE m.doc = s.doc AND m.seq > h.seq AND m.seq <= s.seq AND m.level <= h.level) GROUP BY ALL),
g AS (SELECT doc, number, arg_min(level, seq) AS level, min(page) AS first_page, max(page) AS last_page, count(*) AS n_parts FROM o GROUP BY ALL) SELECT g.*, coalesce(path, '') AS path FROM g LEFT JOIN a USING (doc, number)"""
)
def document_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with the headings above them, over page ends."""
    return assembly.outline(assembly.sections(blocks(spark, sf_dir))).withColumn("path", F.array_join("path", " > "))


REFERENCES = f"""rs AS (SELECT doc, page, section, regexp_extract_all(shown, {q(parsing.CROSS_REFERENCE)}, 1) AS a FROM sections), rx AS (SELECT doc, page, section, unnest(range(len(a))) AS pos, trim(unnest(a), ' ') AS target FROM rs),
rf AS (SELECT * FROM rx QUALIFY row_number() OVER (PARTITION BY doc, page, lower(target) ORDER BY section, pos) = 1), refs AS (SELECT doc, page, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY section, pos) - 1 AS INTEGER) AS idx, target, CASE WHEN upper(target) LIKE '%FIG%' THEN 'FIGURE' WHEN upper(target) LIKE '%TABLE%' THEN 'TABLE' WHEN upper(target) LIKE '%SECTION%' THEN 'SECTION' ELSE 'STANDARD' END AS ref_type FROM rf)"""


@query(f"WITH {TEXTS}, {SECTIONS}, {REFERENCES} SELECT * FROM refs")
def page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.references(assembly.sections(blocks(spark, sf_dir)))


_pair = lambda p: f"list_transform(regexp_extract_all(text, {q(p)}, 0), lambda m: [upper(regexp_extract(m, {q(p)}, 1)), upper(regexp_extract(m, {q(p)}, 2))])"


@query(
    f"""WITH {TEXTS}, {SECTIONS}, {TITLES}, {REFERENCES}, tr AS (SELECT doc, page, block, x, sum(CASE WHEN regexp_matches(x, '^\\|.*\\|$') THEN 0 ELSE 1 END) OVER (PARTITION BY doc, page ORDER BY block) AS run FROM bl), tg AS (SELECT doc, page, run, string_agg(x, chr(10) ORDER BY block) AS content FROM tr WHERE regexp_matches(x, '^\\|.*\\|$') GROUP BY ALL HAVING count(*) > 1),
tb AS (SELECT doc, page, row_number() OVER (PARTITION BY doc, page ORDER BY run) - 1 AS i, content FROM tg), cn AS (SELECT DISTINCT doc, page, m[1] AS f, m[2] AS t FROM (SELECT doc, page, unnest(list_concat({_pair(ocr.CONNECTION)}, {_pair(ocr.ARROW)})) AS m FROM bl WHERE NOT regexp_matches(text, {q(ocr.GUESSED)}))),
el AS (SELECT doc, 'text' AS kind, page, title AS s, 'sec_' || page || '_' || section AS place, CASE WHEN {s_strip("content")} <> '' THEN {s_strip("content")} ELSE title END AS content FROM sections UNION ALL SELECT doc, 'figure', page, 'Figures', 'fig_' || lower(target), target FROM refs WHERE ref_type = 'FIGURE'
UNION ALL SELECT doc, 'table', page, 'Table tbl_' || page || '_' || i, 'tbl_' || page || '_' || i, content FROM tb UNION ALL SELECT doc, 'connection', page, 'Connections', f || '>' || t, f || ' -> ' || t FROM cn)
SELECT 'el_' || substr(sha256(doc || '|' || kind || '|' || page || '|' || place || '|' || sha256(content)), 1, 32) AS element_id, doc, kind, page, CASE WHEN coalesce(titles.title, '') <> '' THEN titles.title ELSE CAST(doc AS VARCHAR) END || ' > ' || s AS heading, content FROM el LEFT JOIN titles USING (doc)"""
)
def exported_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, tables, figures and connections of all documents in one table."""
    rows = blocks(spark, sf_dir)
    made = assembly.sections(rows)
    return assembly.elements(made, assembly.titles(made, rows), assembly.references(made), assembly.tables(rows), assembly.stated_connections(rows))


