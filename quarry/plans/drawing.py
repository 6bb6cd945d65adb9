"""Recognised blocks, tags, connections and prompts on inline rows and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ocr, prompts
from . import fixtures
from .cleaning import s_words
from .fixtures import cte
from .fixtures import literal as q
from .registry import query, read

GRID = [(1, 20.0 + 200 * c, 20.0 + 40 * r, 90.0 + 200 * c, 40.0 + 40 * r, f"r{r}c{c}", 0.9) for r in range(3) for c in range(3)] + [(1, 500.0, 300.0, 510.0, 310.0, " ", 0.9), (1, 5.0, 400.0, 10.0, 410.0, "noise", 0.1)]
FORM = [(2, 10.0, 10.0, 60.0, 30.0, "Name:", 0.9), (2, 80.0, 11.0, 150.0, 29.0, "Ann Example", 0.9), (2, 10.0, 60.0, 60.0, 80.0, "Date:", 0.9), (2, 12.0, 95.0, 90.0, 110.0, "2024-01-05", 0.9), (2, 300.0, 200.0, 420.0, 220.0, "Unit: CDU-1", 0.9), (2, 10.0, 300.0, 60.0, 320.0, "Remarks:", 0.9)]
LABELS = [(1, "P-203 feeds into HX-01 and FIC-101 is near."), (2, "L1: V-12 -> K-3044"), (3, "P-203 and V-9 assumed connection: P-203 flows to V-99"), (4, "p-203 feeds into hx-01"), (5, "PDT-7 no"), (6, "LT 205")]
fixtures.TABLES["fx_blocks"] = (GRID + FORM, "page int, `left` double, top double, `right` double, bottom double, text string, confidence double")
fixtures.TABLES["fx_labels"] = (LABELS, "id int, text string")
fixtures.TABLES["fx_ocr_tags"] = ([("P-203", 0.9), ("HX-01", 0.5), ("P-203", 0.95)], "tag string, confidence double")
fixtures.TABLES["fx_vlm_tags"] = ([("P-203", 0.6), ("V-12", 0.7)], "tag string, confidence double")


def _s_clusters(values: str, gap: float) -> str:
    return f"list_reduce([{{'s': 0.0::DOUBLE, 'n': 0, 'c': -1, 'o': []::INTEGER[]}}] || list_transform({values}, lambda v: {{'s': v, 'n': 1, 'c': 0, 'o': []::INTEGER[]}}), lambda a, x: CASE WHEN a.n > 0 AND abs(x.s - a.s / a.n) <= {gap} THEN {{'s': a.s + x.s, 'n': a.n + 1, 'c': a.c, 'o': a.o || [a.c]}} ELSE {{'s': x.s, 'n': 1, 'c': a.c + 1, 'o': a.o || [a.c + 1]}} END).o"


_large, _high = 'greatest("right" - "left", bottom - top)', "(bottom - top)"
VALID = f"""v0 AS (SELECT page, "left", top, "right", bottom, trim(text) AS text, coalesce(confidence, 1.0) AS conf FROM fx_blocks WHERE trim(text) <> '' AND page <> 2),
v AS (SELECT * FROM v0 WHERE (length(text) = 1 AND regexp_matches(text, '^[\\p{{L}}\\p{{N}}]$') AND {_high} >= 12 AND conf >= 0.35) OR (text IN ('+', '-') AND {_high} >= 12 AND "right" - "left" >= 8 AND conf >= 0.5) OR (regexp_full_match(regexp_replace(text, '[.,+-]', '', 'g'), '\\d+') AND {_high} >= 12 AND conf >= 0.3)
OR NOT ((regexp_full_match(text, {q(ocr.SIGNS[1:-1])}) AND ({_large} <= 24 OR {_high} <= 11.5 OR conf < 0.6)) OR (regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]') AND ({_large} <= 24 OR conf < 0.6)) OR ({_high} <= 11.5 AND length(text) <= 4 AND conf < 0.7) OR ({_large} <= 12 AND conf < 0.4)))"""
_turn = f"tan(radians(step * {ocr.TILT_STEP}::DOUBLE))"
CELLS = f"""{VALID}, tb AS (SELECT page, step, round_even(((top + bottom) / 2 - {_turn} * ("left" + "right") / 2) / 8, 0) AS bin, count(*) AS n FROM v, range(-30, 31) AS r(step) GROUP BY ALL), ts AS (SELECT page, step, sum(n * n) AS score, sum(n) AS n FROM tb GROUP BY ALL),
tt AS (SELECT page, arg_max(step, score * 1000 - step) AS step, max(score) AS best, max(CASE WHEN step = 0 THEN score END) AS none, max(n) AS n FROM ts GROUP BY page), sl AS (SELECT page, CASE WHEN n >= 6 AND best / none >= 1.05::DOUBLE THEN {_turn} ELSE 0.0::DOUBLE END AS slope FROM tt),
y AS (SELECT v.*, (top + bottom) / 2 - slope * ("left" + "right") / 2 AS y FROM v JOIN sl USING (page)), yl AS (SELECT page, list(y ORDER BY y, "left", text) AS ys, list({{'l': "left", 't': text}} ORDER BY y, "left", text) AS bs FROM y GROUP BY page HAVING count(*) >= 4),
yr AS (SELECT page, unnest({_s_clusters("ys", ocr.ROW_GAP)}) AS r, unnest(bs) AS b FROM yl), yn AS (SELECT page, r, b.l AS l, b.t AS t, count(*) OVER (PARTITION BY page, r) AS n FROM yr), ym AS (SELECT *, max(n) OVER (PARTITION BY page) AS most FROM yn),
k AS (SELECT *, dense_rank() OVER (PARTITION BY page ORDER BY r) - 1 AS row_no FROM ym WHERE most >= 2 AND n >= greatest(2, least(3, most - 2))), kf AS (SELECT *, max(row_no) OVER (PARTITION BY page) + 1 AS n_rows, n >= greatest(3, most - 1) AS f, bool_or(n >= greatest(3, most - 1)) OVER (PARTITION BY page) AS whole FROM k),
cl AS (SELECT page, list(l ORDER BY l) AS ls, count(DISTINCT row_no) AS k FROM kf WHERE n_rows >= 2 AND (f OR NOT whole) GROUP BY page), cn AS (SELECT page, k, unnest({_s_clusters("ls", ocr.COLUMN_GAP)}) AS c, unnest(ls) AS l FROM cl),
ca AS (SELECT page, c, avg(l) AS x, count(*) >= least(2, any_value(k)) AS often FROM cn GROUP BY page, c), cb AS (SELECT *, count(CASE WHEN often THEN 1 END) OVER (PARTITION BY page) >= 2 AS enough FROM ca), an AS (SELECT page, list(x ORDER BY x) AS anchors FROM cb WHERE often OR NOT enough GROUP BY page),
fa AS (SELECT kf.page, row_no, l, t, list_transform(anchors, lambda a: abs(l - a)) AS far FROM kf JOIN an USING (page) WHERE n_rows >= 2), fb AS (SELECT *, list_position(far, list_min(far)) - 1 AS column_no FROM fa WHERE len(list_filter(far, lambda d: d - list_min(far) <= 8)) = 1)
SELECT CAST(page AS BIGINT) AS page, CAST(row_no AS BIGINT) AS row_no, CAST(column_no AS BIGINT) AS column_no, string_agg(t, ' ' ORDER BY l, t) AS value FROM fb GROUP BY ALL"""


@query(f"WITH {cte('fx_blocks')}, {CELLS}")
def ocr_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each order laid out as a table, some of them tilted, beside the inline page."""
    return ocr.table_cells(fixtures.table(spark, "fx_blocks", sf_dir).where("page <> 2"))


_box = lambda left, top, text: f"SELECT CAST(c_custkey + 10 AS BIGINT) AS page, {left}::DOUBLE AS l, {top}::DOUBLE AS t, {left + 70}::DOUBLE AS r, {top + 20}::DOUBLE AS b, {text} AS x FROM customer"
_is_label = lambda t: f"(ends_with({t}, ':') AND length({t}) <= 50 AND len({s_words(t)}) <= 6)"
FORMS = f"""f AS (SELECT page, "left" AS l, top AS t, "right" AS r, bottom AS b, text AS x FROM fx_blocks WHERE page = 2 UNION ALL {_box(10, 10, "'Name:'")} UNION ALL {_box(100, 12, "c_name")} UNION ALL {_box(10, 60, "'Segment:'")} UNION ALL {_box(12, 95, "c_mktsegment")} UNION ALL {_box(300, 200, "'Nation: ' || c_nationkey")}),
g AS (SELECT *, {_is_label("trim(x)")} AS label, split_part(x, ':', 1) AS head, trim(substr(x, length(split_part(x, ':', 1)) + 2)) AS rest FROM f), a AS (SELECT * FROM g WHERE label), v AS (SELECT * FROM g WHERE NOT label),
n AS (SELECT page, trim(head) AS label, rest AS value, 'inline' AS place FROM v WHERE contains(x, ':') AND rest <> '' AND {_is_label("trim(head || ':')")}),
c AS (SELECT a.page, a.x AS label, a.t, a.l, v.x AS value, CASE WHEN v.l - a.r BETWEEN 0 AND {ocr.RIGHT_REACH} AND (least(a.b, v.b) - greatest(a.t, v.t)) / least(a.b - a.t, v.b - v.t) >= {ocr.LEAST_OVERLAP} THEN 'right' WHEN v.t - a.b BETWEEN 0 AND {ocr.BELOW_REACH} AND least(a.r, v.r) > greatest(a.l, v.l) THEN 'below' END AS place, v.l - a.r AS dx, v.t - a.b AS dy FROM a JOIN v USING (page)),
d AS (SELECT page, label, t, l, value, place FROM c WHERE place IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page, label, t, l ORDER BY place = 'below', CASE place WHEN 'right' THEN dx ELSE dy END) = 1)
SELECT CAST(page AS BIGINT) AS page, label, value, place FROM n UNION ALL SELECT a.page, trim(rtrim(a.x, ': ')), coalesce(trim(d.value), ''), coalesce(d.place, 'empty') FROM a LEFT JOIN d ON d.page = a.page AND d.label = a.x AND d.t = a.t AND d.l = a.l"""


@query(f"WITH {cte('fx_blocks')}, {FORMS}")
def ocr_form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the inline form, and of a form that each customer's row makes."""
    rows = read(spark, sf_dir, "customer")
    page = (F.col("c_custkey") + 10).cast("int")
    box = lambda left, top, text: rows.select(page.alias("page"), F.lit(left).alias("left"), F.lit(top).alias("top"), F.lit(left + 70.0).alias("right"), F.lit(top + 20.0).alias("bottom"), text.alias("text"), F.lit(0.9).alias("confidence"))
    forms = box(10.0, 10.0, F.lit("Name:")).unionAll(box(100.0, 12.0, F.col("c_name"))).unionAll(box(10.0, 60.0, F.lit("Segment:"))).unionAll(box(12.0, 95.0, F.col("c_mktsegment"))).unionAll(box(300.0, 200.0, F.concat(F.lit("Nation: "), F.col("c_nationkey").cast("string"))))
    return ocr.form_fields(fixtures.table(spark, "fx_blocks").where("page = 2").unionAll(forms))


@query(
    f"""WITH {cte("fx_labels")}, s AS (SELECT * FROM fx_labels WHERE NOT regexp_matches(text, {q(ocr.GUESSED)})), m AS (SELECT id, unnest(list_concat(list_transform(regexp_extract_all(text, {q(ocr.CONNECTION)}, 0), lambda x: [upper(regexp_extract(x, {q(ocr.CONNECTION)}, 1)), upper(regexp_extract(x, {q(ocr.CONNECTION)}, 2))]), list_transform(regexp_extract_all(text, {q(ocr.ARROW)}, 0), lambda x: [upper(regexp_extract(x, {q(ocr.ARROW)}, 1)), upper(regexp_extract(x, {q(ocr.ARROW)}, 2))]))) AS p FROM s)
SELECT p[1] AS from_tag, p[2] AS to_tag, min(id) AS first_key FROM m GROUP BY ALL"""
)
def drawing_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.connections(fixtures.table(spark, "fx_labels", sf_dir), "id", "text")


@query()
def instrument_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, "fx_labels", sf_dir).select("id", ocr.instrument(F.col("text")).alias("i")).select("id", "i.description", "i.code", "i.loop")


@query(f"WITH {cte('fx_ocr_tags', 'fx_vlm_tags')}, a AS (SELECT tag, max(confidence) AS a FROM fx_ocr_tags GROUP BY tag), b AS (SELECT tag, max(confidence) AS b FROM fx_vlm_tags GROUP BY tag) SELECT coalesce(a.tag, b.tag) AS tag, CASE WHEN a IS NULL THEN 'vlm' WHEN b IS NULL THEN 'ocr' ELSE 'both' END AS source, greatest(a, b) AS confidence FROM a FULL OUTER JOIN b ON a.tag = b.tag")
def equipment_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.merged_registry(fixtures.table(spark, "fx_ocr_tags", sf_dir), fixtures.table(spark, "fx_vlm_tags", sf_dir))


@query("SELECT conv_id, turn, 'turn_' || substr(sha256(CAST(conv_id AS VARCHAR) || '|' || CAST(turn AS VARCHAR)), 1, 8) AS id FROM conversations")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", ocr.stable_id("turn", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"))


@query(
    f"""WITH n AS (SELECT conv_id, turn, CASE WHEN length(role) = 0 THEN 0 ELSE greatest(1, length(role) // 4) END AS s, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS c FROM conversations)
SELECT conv_id, turn, CAST(s + c + {prompts.HEADROOM} AS INTEGER) AS total, CAST(least({prompts.GENERATION}, greatest(0, {prompts.WINDOW} - (s + c + {prompts.HEADROOM}))) AS INTEGER) AS generation, s + c + {prompts.HEADROOM} <= {prompts.WINDOW - prompts.GENERATION} AS fits FROM n"""
)
def prompt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = prompts.budget(F.col("role"), F.lit(""), F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", b.alias("b")).select("conv_id", "turn", "b.total", "b.generation", "b.fits")


@query("SELECT conv_id, turn, sha256('1' || chr(31) || role || chr(31) || text || chr(31) || '' || chr(31) || 'local_llm') AS prompt_hash FROM conversations")
def prompt_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", prompts.prompt_hash(F.col("role"), F.col("text"), F.lit(""), "local_llm").alias("prompt_hash"))


@query()
def compressed_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", prompts.compress(F.col("text"), 200).alias("context"))


@query("SELECT role, count(*) AS n, round(avg(length(text)), 6) AS avg_chars, round(avg(CASE WHEN length(text) > 200 THEN 1 ELSE 0 END), 6) AS hit_share FROM conversations GROUP BY role")
def generation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("role", F.length("text").alias("chars"), (F.length("text") > 200).alias("hit"))
    return prompts.summary(rows, "role", ["chars"], "hit").select("role", "n", F.round("avg_chars", 6).alias("avg_chars"), F.round("hit_share", 6).alias("hit_share"))
