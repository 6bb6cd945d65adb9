"""Guardrails, evaluation, geometry and calculations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS
from ..operators import evaluation as ev
from ..operators import geometry as geo
from . import fixtures
from .cleaning import redacted_sql, s_strip, sub
from .fixtures import cte
from .fixtures import literal as q
from .registry import query, read

SECRETS = cte("fx_secrets") + ", secret_texts AS (SELECT CAST(id AS BIGINT) - 1000 AS doc_id, text FROM fx_secrets UNION ALL SELECT doc_id, text FROM documents)"


def secret_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, "fx_secrets").select((F.col("id").cast("long") - 1000).alias("doc_id"), "text")
    return rows.unionByName(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"WITH {SECRETS} SELECT doc_id, {redacted_sql('text')} AS redacted, {redacted_sql('text')} <> text AS changed FROM secret_texts")
def redact_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = ev.redact(F.col("text"))
    return secret_texts(spark, sf_dir).select("doc_id", safe.alias("redacted"), (safe != F.col("text")).alias("changed"))


@query(f"WITH {SECRETS} SELECT doc_id, CAST({' + '.join(f'CAST(regexp_matches(text, {q(p)}) AS INTEGER)' for p in ev.INJECTIONS)} AS INTEGER) AS n_flags FROM secret_texts")
def injection_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_texts(spark, sf_dir).select("doc_id", ev.injection_flags(F.col("text")).alias("n_flags"))


@query(f"WITH {cte('fx_claims')} SELECT entity, field, count(DISTINCT lower(trim(value))) AS n_values, count(*) AS n_claims FROM fx_claims GROUP BY ALL HAVING count(DISTINCT lower(trim(value))) > 1")
def claim_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.conflicts(fixtures.table(spark, "fx_claims", sf_dir))


def s_unit(x: str) -> str:
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x}))"


@query(f"WITH {cte('fx_scores')} SELECT id, round({s_unit('0.35::DOUBLE * ' + s_unit('retrieval') + ' + 0.35::DOUBLE * ' + s_unit('citation') + ' + 0.3::DOUBLE * ' + s_unit('grounding'))}, 4) AS confidence, round({s_unit('0.35::DOUBLE * ' + s_unit('retrieval') + ' + 0.35::DOUBLE * ' + s_unit('citation') + ' + 0.3::DOUBLE * ' + s_unit('grounding'))}, 4) >= 0.8 AS high FROM fx_scores")
def answer_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ev.confidence(F.col("retrieval"), F.col("citation"), F.col("grounding"))
    return fixtures.table(spark, "fx_scores", sf_dir).select("id", c.alias("confidence"), (c >= 0.8).alias("high"))


def s_squeeze(t: str) -> str:
    return s_strip(sub(t, f"[{WS}]+", " "))


OCR = f"{cte('fx_ocr')}, o AS (SELECT *, {s_squeeze('reference')} AS a, {s_squeeze('hypothesis')} AS b FROM fx_ocr)"


@query()
def character_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, "fx_ocr", sf_dir).select("id", F.round(ev.character_errors(F.col("reference"), F.col("hypothesis")), 6).alias("cer"))


@query(f"WITH {OCR}, b AS (SELECT *, CASE {' '.join(f'WHEN confidence >= {lo}::DOUBLE AND confidence < {hi}::DOUBLE THEN {i}' for i, (lo, hi) in enumerate(ev.BUCKETS))} END AS bucket FROM o) SELECT bucket, count(*) AS n, round(avg(confidence), 9) AS mean_confidence, round(avg(CASE WHEN a = b THEN 1 ELSE 0 END), 9) AS accuracy FROM b WHERE bucket IS NOT NULL GROUP BY bucket")
def confidence_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.calibration(fixtures.table(spark, "fx_ocr", sf_dir)).withColumns({c: F.round(c, 9) for c in ("mean_confidence", "accuracy")})


@query(
    f"""WITH {cte("fx_kv_truth", "fx_kv_found")}, t AS (SELECT DISTINCT doc_id, lower({s_squeeze("key")}) AS k, lower({s_squeeze("value")}) AS v FROM fx_kv_truth), p AS (SELECT DISTINCT doc_id, lower({s_squeeze("key")}) AS k, lower({s_squeeze("value")}) AS v FROM fx_kv_found),
c AS (SELECT (SELECT count(*) FROM t SEMI JOIN p USING (doc_id, k, v)) AS matched, (SELECT count(*) FROM t) AS truth, (SELECT count(*) FROM p) AS found)
SELECT matched, truth, found, matched / found AS precision, matched / truth AS recall, 2 * (matched / found) * (matched / truth) / (matched / found + matched / truth) AS f1 FROM c"""
)
def key_value_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.key_value_scores(fixtures.table(spark, "fx_kv_truth", sf_dir), fixtures.table(spark, "fx_kv_found", sf_dir))


@query(f"WITH {cte('fx_calc')} SELECT id, CASE WHEN s * e - 0.6::DOUBLE * p > 0 THEN round(p * r / (s * e - 0.6::DOUBLE * p), 6) END AS thickness FROM fx_calc")
def wall_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, "fx_calc", sf_dir).select("id", F.round(ev.wall_thickness(*map(F.col, "prse")), 6).alias("thickness"))


def _s_relations(boxes: str, near: float, only_near: bool) -> str:
    gap = 'sqrt(power(greatest(0, a."left" - b."right", b."left" - a."right"), 2) + power(greatest(0, a.top - b.bottom, b.top - a.bottom), 2))'
    return f"""SELECT page, source, target, unnest(CASE WHEN over THEN ['OVERLAPS'] ELSE list_filter([CASE WHEN l THEN 'LEFT_OF' END, CASE WHEN r THEN 'RIGHT_OF' END, CASE WHEN u THEN 'ABOVE' END, CASE WHEN d THEN 'BELOW' END, CASE WHEN near THEN 'NEAR' END], lambda z: z IS NOT NULL) END) AS relation FROM
(SELECT a.page, a.id AS source, b.id AS target, a."left" < b."right" AND b."left" < a."right" AND a.top < b.bottom AND b.top < a.bottom AS over, a."right" <= b."left" AS l, a."left" >= b."right" AS r, a.bottom <= b.top AS u, a.top >= b.bottom AS d, {gap} <= {near} AS near FROM {boxes} a JOIN {boxes} b ON a.page = b.page AND a.id <> b.id{f" AND {gap} <= {near}" if only_near else ""})"""


#: Every document laid out: 40 lines a page, pieces of 40 characters 7 wide, lines 12 high and 14 apart.
LINES_A_PAGE, PIECE = 40, 40
LAID = f"""ll AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)), lp AS (SELECT *, unnest(range((length(line) + {PIECE - 1}) // {PIECE})) AS i FROM ll),
laid AS (SELECT doc_id * 100000 + pos // {LINES_A_PAGE} AS page, pos % {LINES_A_PAGE} * 1000000 + i AS id, i * 280.0::DOUBLE AS "left", pos % {LINES_A_PAGE} * 14.0::DOUBLE AS top, i * 280.0::DOUBLE + 7 * length(substr(line, i * {PIECE} + 1, {PIECE})) AS "right", pos % {LINES_A_PAGE} * 14.0::DOUBLE + 12 AS bottom FROM lp)"""


def laid(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("line <> ''")
    pieces = lines.select("doc_id", "pos", "line", F.explode(F.sequence(F.lit(0), F.floor((F.length("line") + PIECE - 1) / PIECE).cast("int") - 1)).alias("i"))
    row, left = F.col("pos") % LINES_A_PAGE, F.col("i") * F.lit(280.0)
    return pieces.select((F.col("doc_id") * 100000 + F.floor(F.col("pos") / LINES_A_PAGE)).alias("page"), (row.cast("long") * 1000000 + F.col("i")).alias("id"), left.alias("left"), (row * F.lit(14.0)).alias("top"), (left + 7 * F.length(F.substr("line", F.col("i") * PIECE + 1, F.lit(PIECE)))).alias("right"), (row * F.lit(14.0) + 12).alias("bottom"))


@query(f"WITH {cte('fx_boxes')}, {LAID} {_s_relations('fx_boxes', 50, False)} UNION ALL {_s_relations('laid', 1, True)}")
def spatial_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All relations of the inline boxes, and those of the documents' pieces that touch or nearly do."""
    return geo.relations(fixtures.table(spark, "fx_boxes"), "page", "id").unionAll(geo.near_relations(laid(spark, sf_dir), "page", "id", 1.0))


@query(f'WITH {cte("fx_boxes")}, {LAID}, u AS (SELECT page, id, "left", top FROM fx_boxes UNION ALL SELECT page, id, "left", top FROM laid) SELECT page, id, CAST(row_number() OVER (PARTITION BY page ORDER BY floor(top / 10), "left", id) AS INTEGER) AS place FROM u')
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, "fx_boxes").drop("text").unionAll(laid(spark, sf_dir))
    return geo.reading_order(rows, "page", "id").select("page", "id", "place")


@query("SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return events.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
