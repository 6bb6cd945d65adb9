"""Equipment, payloads, planned filters, adaptive parameters, evidence and calculations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calculator
from ..functions import queries as qf
from ..functions import text as tx
from ..operators import grounding, metadata
from . import fixtures
from .fixtures import cte
from .fixtures import literal as q
from .registry import query, read
from .retrieval import ENTITIES, SEARCH, _s_intents, analysed, bm25_hits

PLANT = [(1, "The pump P-203 runs at 12.5 bar and 140 °C. HX-01 and V-102 stand by; P-203 again."), (2, "MOV-101 near K-12, 30 psi. ZZ-99 is a tank."), (3, "Nothing.")]
fixtures.TABLES["fx_plant"] = (PLANT, "doc_id long, text string")
P = cte("fx_plant") + ", plant AS (SELECT doc_id - 100 AS doc_id, text FROM fx_plant UNION ALL SELECT doc_id, text FROM documents)"


def plant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, "fx_plant").select((F.col("doc_id") - 100).alias("doc_id"), "text")
    return rows.unionByName(read(spark, sf_dir, "documents").select("doc_id", "text"))


def _s_case(table: dict[str, str], test: str) -> str:
    return "CASE " + " ".join(f"WHEN {test.format(q(k))} THEN {q(v)}" for k, v in table.items()) + " END"


@query(
    f"""WITH {P}, t AS (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, {q(metadata.EQUIPMENT)}, 1))) AS tag FROM plant), a AS (SELECT *, strpos(text, tag) - 1 AS o FROM t), n AS (SELECT *, substr(text, greatest(o - 60, 0) + 1, least(o, 60) + length(tag) + 60) AS near FROM a)
SELECT doc_id, tag, coalesce({_s_case(metadata.PREFIXES, "starts_with(tag, {0})")}, {_s_case(metadata.KEYWORDS, "contains(lower(near), {0})")}, 'OTHER') AS equipment_type, CASE WHEN regexp_matches(near, {q(metadata.PRESSURE)}) THEN regexp_extract(near, {q(metadata.PRESSURE)}, 1) || ' ' || regexp_extract(near, {q(metadata.PRESSURE)}, 2) END AS pressure,
CASE WHEN regexp_matches(near, {q(metadata.TEMPERATURE)}) THEN regexp_extract(near, {q(metadata.TEMPERATURE)}, 1) || ' ' || regexp_extract(near, {q(metadata.TEMPERATURE)}, 2) END AS temperature, CAST(o AS INTEGER) AS char_offset FROM n"""
)
def equipment_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.equipment(plant(spark, sf_dir), "doc_id", "text")


@query(f"WITH {fixtures.CHUNK_ROWS}, e AS (SELECT DISTINCT document_id, unnest(equipment) AS tag FROM chunk_rows) SELECT c.document_id, c.chunk_id, coalesce(string_agg(tag, ',' ORDER BY tag) FILTER (contains(upper(content), upper(tag))), '') AS tags FROM chunk_rows c LEFT JOIN e ON c.document_id = e.document_id GROUP BY ALL")
def metadata_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = fixtures.chunk_rows(spark, sf_dir)
    tags = chunks.select("document_id", F.explode("equipment").alias("tag"))
    return metadata.inherited(chunks, tags, "document_id", "chunk_id", "content").withColumn("tags", F.array_join("tags", ","))


# the rules once more, by themselves
TAG_LENGTH = 64
LENGTH_CHECKS = "CASE WHEN length(document_id) > 128 THEN 'length:document_id' END, CASE WHEN length(chunk_id) > 128 THEN 'length:chunk_id' END, CASE WHEN length(document_name) > 256 THEN 'length:document_name' END, CASE WHEN length(plant_unit) > 64 THEN 'length:plant_unit' END, CASE WHEN length(section) > 512 THEN 'length:section' END"
BAD = [("", None, "n", "x" * 65, None, ["t"]), ("y" * 300, "d", "", "u", "s", ["t" * 70]), ("k", "d", None, None, "s" * 400, None)]


@query(
    f"""WITH {fixtures.CHUNK_ROWS}, p AS (SELECT chunk_id, document_id, document_name, plant_unit, section, equipment FROM chunk_rows UNION ALL SELECT * FROM (VALUES {", ".join("(" + ", ".join("[" + ", ".join(map(q, v)) + "]" if isinstance(v, list) else q(v) for v in r) + ")" for r in BAD)}) AS v(chunk_id, document_id, document_name, plant_unit, section, equipment))
SELECT chunk_id, concat_ws(',', CASE WHEN chunk_id IS NULL OR chunk_id = '' THEN 'chunk_id' END, CASE WHEN document_id IS NULL THEN 'document_id' END, {LENGTH_CHECKS}, CASE WHEN len(list_filter(equipment, lambda t: length(t) > {TAG_LENGTH})) > 0 THEN 'equipment_tag' END) AS problems FROM p"""
)
def payload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.chunk_rows(spark, sf_dir).select("chunk_id", "document_id", "document_name", "plant_unit", "section", "equipment")
    bad = spark.createDataFrame(BAD, rows.schema)
    return rows.unionByName(bad).select("chunk_id", F.array_join(metadata.payload_problems(), ",").alias("problems"))


@query(
    f"""WITH {ENTITIES}, {fixtures.CHUNK_ROWS} SELECT query_id, count(chunk_id) AS n_chunks, min(chunk_id) AS first_chunk FROM e LEFT JOIN chunk_rows ON (len(equipment_tags) = 0 OR list_has_any(equipment, equipment_tags)) AND (len(plant_units) = 0 OR coalesce(plant_unit = plant_units[1], false)) AND (len(page_references) = 0 OR coalesce(page = CAST(page_references[1] AS INTEGER), false)) GROUP BY query_id"""
)
def planned_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks each query's own filters leave, and the first of them."""
    return metadata.filtered_counts(analysed(spark, sf_dir), fixtures.chunk_rows(spark, sf_dir))


def _s_adaptive(i: int) -> str:
    return "CASE p " + " ".join(f"WHEN {q(r[0])} THEN {r[i]}" for r in metadata.ADAPTIVE[:-1]) + f" ELSE {metadata.ADAPTIVE[-1][i]} END"


@query(
    f"""WITH {ENTITIES}, l AS (SELECT *, regexp_extract_all(lower(t), '\\b[a-z0-9-]+\\b') AS low FROM e), p AS (SELECT query_id, coalesce({_s_intents()}[1], 'informational') AS p FROM l)
SELECT query_id, CAST({_s_adaptive(1)} AS INTEGER) AS k, CAST({_s_adaptive(2)} AS INTEGER) AS radius, CAST({_s_adaptive(3)} AS DOUBLE) AS dense_weight, CAST({_s_adaptive(4)} AS DOUBLE) AS bm25_weight, CAST({_s_adaptive(5)} AS INTEGER) AS budget FROM p"""
)
def adaptive_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analysed(spark, sf_dir)
    intent = F.coalesce(F.get(qf.intents(F.col("t"), F.col("e")), F.lit(0)), F.lit("informational"))
    return rows.select("query_id", metadata.adaptive(intent).alias("a")).select("query_id", "a.k", "a.radius", "a.dense_weight", "a.bm25_weight", "a.budget")


def _evidence() -> str:
    from .oracles import S_OVERLAP, s_search

    terms = lambda t: f"list_distinct(list_filter({s_search(t)}, lambda w: length(w) > 2))"
    at = lambda o, v: f"(overlap >= {o}::DOUBLE OR score >= {v}::DOUBLE)"
    return f"""WITH {ENTITIES}, {fixtures.CHUNK_ROWS}, {SEARCH}, h AS (SELECT item_id, doc_id, round(score, 6) AS score FROM hits WHERE rank < 10),
j AS (SELECT h.item_id, h.doc_id, h.score, content, list_concat(equipment_tags, e.standards) AS asked, list_concat(equipment, chunk_rows.standards) AS found, {terms("e.t")} AS q_terms, {terms("content")} AS terms FROM h JOIN e ON e.query_id = h.item_id + 1000 JOIN chunk_rows ON chunk_id = 'x' || h.doc_id),
o AS (SELECT *, {S_OVERLAP} AS overlap, regexp_matches(content, {q(metadata.NORMATIVE)}) AND NOT regexp_matches(content, {q(metadata.RECORD)}) AS rule, len(asked) > 0 AS a, len(found) > 0 AS f, list_has_any(asked, found) AS m FROM j)
SELECT item_id, doc_id, round(overlap, 6) AS overlap, CASE WHEN a AND f AND NOT m THEN 'UNRELATED' WHEN a AND f AND rule THEN 'GENERIC_REQUIREMENT' WHEN a AND f THEN CASE WHEN {at(0.2, 0.7)} THEN 'DIRECT' ELSE 'RELATED' END WHEN a AND rule THEN CASE WHEN {at(0.2, 0.65)} THEN 'GENERIC_REQUIREMENT' ELSE 'UNRELATED' END
WHEN a THEN CASE WHEN {at(0.3, 0.7)} THEN 'RELATED' ELSE 'UNRELATED' END WHEN len(q_terms) = 0 THEN 'UNRELATED' WHEN rule THEN CASE WHEN {at(0.3, 0.65)} THEN 'GENERIC_REQUIREMENT' ELSE 'UNRELATED' END WHEN {at(0.35, 0.7)} THEN 'DIRECT' WHEN {at(0.2, 0.5)} THEN 'RELATED' ELSE 'UNRELATED' END AS relation FROM o"""


@query(_evidence())
def evidence_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the ten best BM25 hits of each benchmark passage stand to it."""
    asked = analysed(spark, sf_dir).where("query_id >= 1000").select((F.col("query_id") - 1000).alias("item"), "t", "e")
    chunks = fixtures.chunk_rows(spark, sf_dir).select("chunk_id", "content", "equipment", "standards")
    hits = bm25_hits(spark, sf_dir, 10)
    rows = hits.join(asked, hits["item_id"] == asked["item"]).join(chunks, F.concat(F.lit("x"), "doc_id") == F.col("chunk_id"))
    terms = lambda c: F.array_distinct(F.filter(qf.search_tokens(c), lambda w: F.length(w) > 2))
    rows = rows.withColumns({"q_terms": terms(F.col("t")), "terms": terms(F.col("content"))}).withColumn("overlap", grounding.term_overlap(F.col("q_terms"), F.col("terms")))
    how = metadata.relation(F.concat("e.equipment_tags", "e.standards"), F.concat("equipment", "standards"), F.col("overlap"), F.col("score"), F.col("content"), F.size("q_terms") > 0)
    return rows.select("item_id", "doc_id", F.round("overlap", 6).alias("overlap"), how.alias("relation"))


@query("SELECT o_orderkey, round((o_totalprice * 2 - 10) / (o_orderkey % 7 + 0.5::DOUBLE), 4) AS a, round(sqrt(o_totalprice) + power(2::DOUBLE, 3), 4) AS b FROM orders")
def calculated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders")
    return rows.select("o_orderkey", F.round(calculator.column("(o_totalprice * 2 - 10) / (o_orderkey % 7 + 0.5)"), 4).alias("a"), F.round(calculator.column("sqrt(o_totalprice) + 2 ** 3"), 4).alias("b"))


@query(
    """WITH s AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE lang <> 'fr'), i AS (SELECT doc_id, sha256(CASE WHEN lang = 'de' THEN upper(text) ELSE text END) AS h FROM documents WHERE source <> 'src3'),
c AS (SELECT CASE WHEN s.doc_id IS NULL THEN 'new' WHEN i.doc_id IS NULL THEN 'deleted' WHEN s.h <> i.h THEN 'modified' ELSE 'unchanged' END AS change FROM s FULL OUTER JOIN i ON s.doc_id = i.doc_id) SELECT change, count(*) AS n FROM c GROUP BY change"""
)
def version_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    old = docs.where("lang <> 'fr'").select("doc_id", F.sha2("text", 256).alias("h"))
    new = docs.where("source <> 'src3'").select("doc_id", F.sha2(F.when(F.col("lang") == "de", F.upper("text")).otherwise(F.col("text")), 256).alias("h"))
    return metadata.compared_versions(old, new, "doc_id", "h")


@query("SELECT page_id, 'p_' || page_id AS name, CAST(length(html) AS BIGINT) AS size_bytes, CASE WHEN length(html) < 1024 THEN length(html) || ' B' WHEN length(html) < 1048576 THEN printf('%.2f KB', length(html) / 1024) ELSE printf('%.2f MB', length(html) / 1048576) END AS size FROM pages")
def byte_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("html").cast("long")
    return read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p_"), F.col("page_id").cast("string")).alias("name"), n.alias("size_bytes"), tx.byte_size(n).alias("size"))
