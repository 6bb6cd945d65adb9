"""DuckDB statements of queries registered elsewhere, worked out by other means than the queries' own."""

from __future__ import annotations

from ..functions import queries as qf
from ..operators import grounding, parsing, prompts, review
from . import cleaning as cl
from . import collection, drawing, fixtures, structure  # noqa: F401  whose oracles are built on below
from . import retrieval as rt
from .fixtures import literal as q
from .registry import ORACLES

S_STOP = q(list(qf.STOPWORDS))


def s_search(t: str) -> str:
    """Search tokens of a text, as a list."""
    every = cl.s_tokens(t)
    return f"(CASE WHEN len(list_filter({every}, lambda w: NOT list_contains({S_STOP}, w))) > 0 THEN list_filter({every}, lambda w: NOT list_contains({S_STOP}, w)) ELSE {every} END)"


def s_same(a: str, b: str) -> str:
    return f"({a} = {b} OR starts_with({b}, {a}) OR starts_with({a}, {b}) OR (length({a}) > 3 AND length({b}) > 3 AND {a}[1:4] = {b}[1:4]))"


S_OVERLAP = f"CASE WHEN len(q_terms) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(q_terms, lambda t: len(list_filter(terms, lambda s: {s_same('t', 's')})) > 0)) / len(q_terms) END"

_named = ", ".join(f"CASE WHEN contains(lower(t), {q(k.lower())}) THEN {q(v.lower())} END" for k, v in qf.ACRONYMS.items())
_terms = ", ".join(f"CASE WHEN contains(lower(t), {q(k)}) AND NOT contains(lower(t), {q(s)}) THEN {q(s)} END" for k, v in qf.SYNONYMS.items() for s in v)
ORACLES["query_expand_terms"] = f"""WITH {rt.NORMAL}, a AS (SELECT query_id, list_filter([{_named}], lambda x: x IS NOT NULL) AS named, list_filter([{_terms}], lambda x: x IS NOT NULL) AS terms FROM n),
k AS (SELECT query_id, unnest(range(len(named))) AS i, unnest(named) AS term FROM a UNION ALL SELECT query_id, 1000 + unnest(range(len(terms))), unnest(terms) FROM a), f AS (SELECT query_id, term, i, row_number() OVER (PARTITION BY query_id, term, i < 1000 ORDER BY i) AS nth, min(i) OVER (PARTITION BY query_id, term) AS least FROM k),
r AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS pos FROM f WHERE i < 1000 OR (nth = 1 AND least >= 1000)) SELECT query_id, CAST(pos AS INTEGER) AS pos, term FROM r WHERE pos < 10"""

_words = cl.s_words("joined")
ORACLES["query_rewrite"] = f"""WITH {rt.NORMAL}, s AS (SELECT query_id, t, regexp_extract_all(t, {q(qf.STANDARD_FORM)}, 0) AS found, regexp_split_to_array(t, {q(qf.STANDARD_FORM)}) AS gaps FROM n),
j AS (SELECT query_id, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(upper(regexp_replace(found[i], {q(qf.STANDARD_FORM)}, '\\1-\\2')), '')), '') AS joined FROM s)
SELECT query_id, array_to_string(list_transform({_words}, lambda w: coalesce({rt.s_map(qf.SPELLING)}[regexp_replace(lower(w), '^[.,?!:;]+|[.,?!:;]+$', '', 'g')] || regexp_extract(w, '([.,?!])$', 1), w)), ' ') AS rewritten FROM j"""

_raw = "list_filter(list_transform({0}, lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g')), lambda w: w <> '')".format(cl.s_words("lower(query)"))
ORACLES["lexical_rerank"] = f"""WITH {rt.SEARCH}, h AS (SELECT item_id, doc_id, round(score, 6) AS score FROM hits WHERE rank < 20), c AS (SELECT h.*, d.text AS content, d.source, b.text AS query FROM h JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)),
r AS (SELECT *, {_raw} AS raw FROM c), w AS (SELECT *, CASE WHEN len(list_filter(raw, lambda x: NOT list_contains({S_STOP}, x))) > 0 THEN list_filter(raw, lambda x: NOT list_contains({S_STOP}, x)) ELSE raw END AS own FROM r),
p AS (SELECT *, list_distinct(list_concat(own, list_filter(flatten(list_transform(list_filter(own, lambda x: regexp_matches(x, '[-_]')), lambda x: regexp_split_to_array(x, '[-_]+'))), lambda x: length(x) > 1 AND NOT list_contains({S_STOP}, x)))) AS terms FROM w),
o AS (SELECT *, CASE WHEN len(terms) > 0 THEN least(1.0::DOUBLE, (len(list_filter(terms, lambda x: contains(lower(content), x))) + 0.25::DOUBLE * len(list_filter(terms, lambda x: contains(lower(coalesce(source, '')), x)))) / len(terms)) ELSE 0.0::DOUBLE END AS overlap, length(regexp_replace(content, '[^\\x20-\\x7E]', '', 'g')) / greatest(1, length(content)) AS plain FROM p),
z AS (SELECT item_id, doc_id, round((overlap * 0.75::DOUBLE + least(1.0::DOUBLE, score) * 0.25::DOUBLE) * CASE WHEN length(content) > 0 AND plain < 0.8::DOUBLE THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN regexp_matches(lower(content), 'microsoft time-stamp|timestamp pca|@v@v|\\+\\+\\+\\]') THEN 0.05::DOUBLE ELSE 1.0::DOUBLE END, 6) AS rerank_score FROM o)
SELECT item_id, doc_id, rerank_score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, doc_id) - 1 AS INTEGER) AS rank FROM z"""

ORACLES["evidence_sufficiency"] = f"""WITH {rt.SEARCH}, h AS (SELECT item_id, doc_id, round(score, 6) AS score FROM hits WHERE rank < 3),
g AS (SELECT item_id, list_distinct({s_search("b.text")}) AS q_terms, list_distinct({cl.s_tokens("d.text")}) AS terms, score FROM h JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)),
o AS (SELECT item_id, {S_OVERLAP} AS o, score, len(q_terms) AS n FROM g), s AS (SELECT item_id, max(o) AS overlap, max(score) AS top_score, max(n) AS n FROM o GROUP BY item_id)
SELECT item_id, round(overlap, 6) AS overlap, round(top_score, 6) AS top_score, CASE WHEN n = 0 THEN top_score >= 0.65::DOUBLE ELSE overlap >= {grounding.MIN_OVERLAP}::DOUBLE AND (top_score >= {grounding.MIN_SCORE}::DOUBLE OR overlap >= 0.5::DOUBLE) END AS sufficient FROM s"""

_sentences = cl.S_SENTENCES
ORACLES["extracted_answers"] = f"""WITH {rt.SEARCH}, h AS (SELECT item_id, d.text, b.text AS question FROM hits JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) WHERE rank < 1), p AS (SELECT item_id, {s_search("question")} AS qs, {_sentences} AS parts FROM h),
e AS (SELECT item_id, qs, unnest(range(len(parts))) AS pos, unnest(parts) AS sentence FROM p), s AS (SELECT item_id, pos, sentence, len(list_intersect(list_distinct(qs), list_distinct({s_search("sentence")}))) + len(list_filter(qs, lambda t: contains(lower(sentence), t))) AS score FROM e WHERE length(sentence) >= 15),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, pos) - 1 AS place FROM s) SELECT item_id, CAST(place AS INTEGER) AS place, sentence, CAST(score AS INTEGER) AS score FROM r WHERE place < 3"""

_tok = "greatest(1, length({0}) // 4)"
ORACLES["compressed_contexts"] = f"""WITH s AS (SELECT doc_id, text, array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {q(prompts.SALIENT)})), chr(10)) AS salient FROM documents)
SELECT doc_id, CASE WHEN {_tok.format("text")} <= 200 THEN text WHEN salient <> '' AND {_tok.format("salient")} <= 200 THEN salient ELSE text[1:797] || '...' END AS context FROM s"""


def s_named(pattern: str) -> str:
    capital = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    return f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, {q(pattern)}, 0), lambda x: {capital.format(cl.sub('x', chr(92) + 's+', ' '))}))), '; ')"


from . import review as review_plans  # noqa: E402  its reports are needed below

ORACLES["safety_terms"] = f"WITH {review_plans.R} SELECT doc_id, {s_named(review.PROTECTIVE)} AS ppe, {s_named(review.PERMIT)} AS permits FROM reports"

EDGE_TEXT = "The pump P-203 feeds HX-01 and V-102. MOV-101 isolates P-203! P-203 stands near K-12. PT-11 measures the pressure."
_relation = "CASE " + " ".join(f"WHEN regexp_matches(s, {q(p)}) THEN {q(n)}" for n, p in parsing.RELATIONS) + " ELSE 'connected_to' END"
ORACLES["entity_edges"] = f"""WITH d AS (SELECT 1::BIGINT AS doc_id, {q(EDGE_TEXT)} AS text UNION ALL SELECT doc_id, text FROM documents), p AS (SELECT doc_id, {_sentences} AS parts FROM d), e AS (SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS s FROM p),
g AS (SELECT doc_id, pos, s, unnest(regexp_extract_all(s, {q(parsing.GRAPH_TAG)}, 1)) AS tag, generate_subscripts(regexp_extract_all(s, {q(parsing.GRAPH_TAG)}, 1), 1) AS i FROM e), f AS (SELECT doc_id, pos, s, tag, min(i) AS i FROM g GROUP BY ALL),
w AS (SELECT doc_id, pos, s, tag AS src, lead(tag) OVER (PARTITION BY doc_id, pos ORDER BY i) AS dst FROM f) SELECT doc_id, CAST(pos AS INTEGER) AS pos, src, dst, {_relation} AS relation FROM w WHERE dst IS NOT NULL"""

ORACLES["structure_issues"] = f"""WITH s AS ({ORACLES["sections"]}), k AS (SELECT *, level - lag(level) OVER (PARTITION BY doc_id ORDER BY section) AS jump FROM s), n AS (SELECT doc_id, level, lower(title) AS low FROM s WHERE title IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
SELECT doc_id, section, 'missing_title' AS issue FROM k WHERE coalesce(trim(title), '') = '' UNION ALL SELECT k.doc_id, section, 'duplicate_heading' FROM k JOIN n ON k.doc_id = n.doc_id AND k.level IS NOT DISTINCT FROM n.level AND lower(k.title) = n.low UNION ALL SELECT doc_id, section, 'level_jump' FROM k WHERE jump > 1"""

ORACLES["parser_dispatch"] = f"""WITH c AS ({ORACLES["document_classification"]}), k AS (SELECT *, regexp_extract(path, '\\.([^.]+)$', 1) AS ext FROM c)
SELECT path, coalesce(CASE WHEN confidence >= 0.6::DOUBLE THEN CASE category WHEN 'Inspection Report' THEN 'inspection' WHEN 'Safety Document' THEN 'safety' WHEN 'Email' THEN 'email' WHEN 'Engineering Drawing' THEN 'engineering' END END,
CASE WHEN ext IN ('pdf', 'docx', 'pptx', 'csv') THEN ext WHEN ext = 'md' THEN 'markdown' WHEN ext IN ('png', 'jpg', 'jpeg') THEN 'image_metadata' WHEN ext = 'eml' THEN 'email' END, 'generic') AS parser FROM k"""


def s_distance(a: str, b: str) -> str:
    """Edits between two lists: each different item becomes one ASCII character, for levenshtein counts bytes."""
    both = f"list_distinct(list_concat({a}, {b}))"
    code = lambda x: f"array_to_string(list_transform({x}, lambda v: chr(33 + CAST(list_position({both}, v) AS INTEGER))), '')"
    return f"levenshtein({code(a)}, {code(b)})"


from .quality import OCR, s_squeeze  # noqa: E402

_chars = lambda t: f"list_filter(string_split({t}, ''), lambda c: c <> '')"
_cer = f"CASE WHEN length(a) = 0 THEN CASE WHEN length(b) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE {s_distance(_chars('a'), _chars('b'))} / length(a) END"
ORACLES["character_error_rate"] = f"WITH {OCR} SELECT id, round({_cer}, 6) AS cer FROM o"
_wer = f"CASE WHEN len(x) = 0 THEN CASE WHEN len(y) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE {s_distance('x', 'y')} / len(x) END"
ORACLES["word_error_rate"] = f"WITH {OCR}, w AS (SELECT id, {cl.s_words('reference')} AS x, {cl.s_words('hypothesis')} AS y FROM o) SELECT id, {_wer} AS wer FROM w"
ORACLES["group_metrics"] = f"""WITH {OCR}, m AS (SELECT CASE WHEN confidence >= 0.7::DOUBLE THEN 'clean' ELSE 'degraded' END AS kind, CASE WHEN trim(reference) = trim(hypothesis) THEN 1 ELSE 0 END AS exact, {_cer} AS cer, confidence FROM o)
SELECT kind, count(*) AS n, avg(exact) AS exact_rate, avg(cer) AS mean_cer, avg(confidence) AS mean_confidence FROM m GROUP BY ROLLUP (kind)"""

from ..operators import ocr  # noqa: E402

_tag = "'\\b([A-Z]{2,4})[-_ ]?(\\d{2,5}[A-Z]?)\\b'"
ORACLES["instrument_tags"] = f"""WITH {fixtures.cte("fx_labels")}, u AS (SELECT id, upper(trim(text)) AS up FROM fx_labels), c AS (SELECT id, up, regexp_extract(up, {_tag}, 1) AS c, regexp_extract(up, {_tag}, 2) AS loop FROM u)
SELECT id, CASE WHEN c = '' THEN 'Instrument' ELSE coalesce({rt.s_map(ocr.FIRST_LETTERS)}[c[1]], c[1]) || ' ' || array_to_string(list_transform(string_split(c[2:], ''), lambda x: coalesce({rt.s_map(ocr.NEXT_LETTERS)}[x], x)), ' ') END AS description, CASE WHEN c = '' THEN up ELSE c END AS code, loop FROM c"""

__all__ = ["ORACLES"]
