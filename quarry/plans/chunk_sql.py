"""DuckDB statements of the chunkers that pack units greedily: whole texts, sections and tables."""

from __future__ import annotations

from ..functions import text as tx
from ..functions.protected import PROTECTED
from ..operators import structure
from . import cleaning as cl
from .fixtures import literal as q
from .registry import ORACLES, TEXTS

_TOKENS = q("[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]")
_EMPTY = "'o': []::VARCHAR[], 'h': '', 'has': false, 'n': 0::BIGINT"


def s_size(t: str) -> str:
    return f"len(regexp_extract_all({t}, {_TOKENS}))"


def s_unit(u: str, t: str, f: str = "[]::VARCHAR[]", big: str = "false") -> str:
    """A unit to pack: its text, tokens, and the finer pieces that it gives if it is too large."""
    return f"{{{_EMPTY}, 'u': {u}, 't': CAST({t} AS BIGINT), 'f': {f}, 'big': {big}}}"


def s_packed(units: str, target: int | str, sep: str) -> str:
    """Runs of the units of at most target tokens, as a list."""
    keep = "'u': '', 't': 0::BIGINT, 'f': []::VARCHAR[], 'big': false"
    done = f"""list_reduce([{s_unit("''", "0")}] || {units}, lambda a, x: CASE WHEN x.big THEN {{'o': a.o || (CASE WHEN a.has THEN [a.h] ELSE []::VARCHAR[] END) || x.f, 'h': '', 'has': false, 'n': 0::BIGINT, {keep}}}
WHEN a.has AND a.n + x.t > {target} THEN {{'o': a.o || [a.h], 'h': x.u, 'has': true, 'n': x.t, {keep}}} ELSE {{'o': a.o, 'h': CASE WHEN a.has THEN a.h || {sep} || x.u ELSE x.u END, 'has': true, 'n': a.n + x.t, {keep}}} END)"""
    return f"list_transform([{done}], lambda z: z.o || CASE WHEN z.has THEN [z.h] ELSE []::VARCHAR[] END)[1]"


def s_chunked(most: int) -> str:
    """CTEs that end in cut (id, pieces): the texts of the CTE items (id, text), whole up to `most` tokens, else their paragraphs packed, long ones by sentences, giant sentences by words."""
    words, step = structure.TARGET, structure.TARGET - structure.OVERLAP
    return f"""cz AS (SELECT id, text, {s_size("text")} AS n FROM items WHERE text <> ''), ca AS (SELECT id, unnest(range(len(ps))) AS i, unnest(ps) AS text FROM (SELECT id, {cl._trimmed("regexp_split_to_array(text, '" + chr(92) + "n" + chr(92) + "s*" + chr(92) + "n')")} AS ps FROM cz WHERE n > {most})), cp AS (SELECT *, {s_size("text")} AS t FROM ca),
cs AS (SELECT id, i, unnest(range(len(ss))) AS j, unnest(ss) AS u FROM (SELECT id, i, {cl.S_SENTENCES} AS ss FROM cp WHERE t > {structure.TARGET})), ct AS (SELECT *, {s_size("u")} AS t, {cl.s_words("u")} AS w FROM cs),
cw AS (SELECT *, CASE WHEN t > {structure.MOST} THEN list_transform(range(0, CAST(1 + greatest(0, ceil((len(w) - {words}) / {step})) AS BIGINT)), lambda k: array_to_string(w[k * {step} + 1 : k * {step} + {words}], ' ')) ELSE []::VARCHAR[] END AS f FROM ct),
cl AS (SELECT id, i, list({s_unit("u", "t", "f", f"t > {structure.MOST}")} ORDER BY j) AS units FROM cw GROUP BY id, i), cf AS (SELECT id, i, {s_packed("units", structure.TARGET, "' '")} AS f FROM cl),
cu AS (SELECT id, list({s_unit("text", "t", "coalesce(f, [])", f"t > {structure.TARGET}")} ORDER BY cp.i) AS units FROM cp LEFT JOIN cf USING (id, i) GROUP BY id), cut AS (SELECT id, [text] AS pieces FROM cz WHERE n <= {most} UNION ALL SELECT id, {s_packed("units", structure.TARGET, "chr(10) || chr(10)")} FROM cu)"""


_listed = "CAST(unnest(range(len(pieces))) AS INTEGER) AS chunk_index, unnest(pieces) AS content"
ORACLES["chunk_recursive"] = f"WITH items AS (SELECT doc_id AS id, {cl.s_strip('text')} AS text FROM documents), {s_chunked(structure.TARGET)} SELECT id AS doc_id, {_listed} FROM cut"

_line = cl.s_strip("line")
ORACLES["chunk_sections"] = f"""WITH {TEXTS}, sl AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM texts)), sh AS (SELECT *, length(regexp_extract({_line}, '^(#{{1,6}})\\s+(.*)$', 1)) AS level FROM sl),
sg AS (SELECT *, count(CASE WHEN level > 0 THEN 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM sh), st AS (SELECT doc_id, g, level, regexp_replace({_line}, '^#{{1,6}}\\s+', '') AS title FROM sg WHERE level > 0),
sp AS (SELECT s.doc_id, s.g, '[' || string_agg(h.title, ' > ' ORDER BY h.g) || ']' || chr(10) AS head FROM st s JOIN st h ON h.doc_id = s.doc_id AND h.g <= s.g AND NOT EXISTS (SELECT 1 FROM st m WHERE m.doc_id = s.doc_id AND m.g > h.g AND m.g <= s.g AND m.level <= h.level) GROUP BY ALL),
sb AS (SELECT doc_id, g, {cl.s_strip("coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0), '')")} AS text FROM sg GROUP BY doc_id, g), items AS (SELECT {{'d': doc_id, 'g': g}} AS id, text FROM sb), {s_chunked(structure.MOST)},
so AS (SELECT id.d AS doc_id, id.g AS g, unnest(range(len(pieces))) AS i, unnest(pieces) AS piece FROM cut) SELECT so.doc_id, CAST(row_number() OVER (PARTITION BY so.doc_id ORDER BY so.g, i) - 1 AS INTEGER) AS chunk_index, coalesce(head, '') || piece AS content FROM so LEFT JOIN sp ON sp.doc_id = so.doc_id AND sp.g = so.g"""


def tables(marked: str) -> str:
    """Of the CTE `marked` (doc_id, text)."""
    head = "rows[1] || chr(10) || rows[2]"
    return f"""WITH {marked}, tl AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM marked)), tr AS (SELECT doc_id, pos, {_line} AS x, regexp_matches({_line}, '^\\|.*\\|$') AS r FROM tl),
tg AS (SELECT *, sum(CASE WHEN r THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM tr), ta AS (SELECT doc_id, run, list(x ORDER BY pos) AS rows FROM tg WHERE r GROUP BY doc_id, run HAVING count(*) > 1),
tp AS (SELECT *, CASE WHEN len(rows) <= 3 OR {s_size("array_to_string(rows, chr(10))")} <= {structure.MOST} THEN NULL ELSE {s_packed("list_transform(rows[3:], lambda y: " + s_unit("y", s_size("y")) + ")", f"greatest(1, {structure.TARGET} - {s_size(head)})", "chr(10)")} END AS parts FROM ta),
tc AS (SELECT doc_id, run, CASE WHEN parts IS NULL THEN [array_to_string(rows, chr(10))] ELSE list_transform(range(1, len(parts) + 1), lambda i: '(Part ' || i || ' of ' || len(parts) || ')' || chr(10) || {head} || chr(10) || parts[i]) END AS c FROM tp), te AS (SELECT doc_id, run, unnest(range(len(c))) AS i, unnest(c) AS content FROM tc)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run, i) - 1 AS INTEGER) AS chunk_index, content FROM te"""


_item = "regexp_matches(line, '^\\s*(?:[-*•]|\\d{1,4}[.)])\\s+')"
# a line that is no item goes on with the kind before it if it is indented or short, and is prose otherwise
ORACLES["chunk_lists"] = f"""WITH {TEXTS}, ll AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM texts)), lk AS (SELECT *, {_item} AS item, CASE WHEN {_item} THEN 'list' WHEN NOT (line[1] IN (' ', chr(9)) OR length(line) < 80) THEN 'prose' END AS sets FROM ll WHERE {_line} <> ''),
ln AS (SELECT *, coalesce(last_value(sets IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'prose') AS kind FROM lk), lb AS (SELECT *, kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS begins FROM ln), lg AS (SELECT *, count(CASE WHEN begins THEN 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g, count(CASE WHEN item THEN 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM lb),
li AS (SELECT doc_id, g, k, string_agg(line, chr(10) ORDER BY pos) AS u FROM lg WHERE kind = 'list' GROUP BY ALL), lp AS (SELECT doc_id, g, list({s_unit("u", s_size("u"))} ORDER BY k) AS units FROM li GROUP BY doc_id, g),
pt AS (SELECT doc_id, g, string_agg(line, chr(10) ORDER BY pos) AS text FROM lg WHERE kind = 'prose' GROUP BY doc_id, g), pz AS (SELECT *, {s_size("text")} AS t FROM pt), ps AS (SELECT doc_id, g, unnest(range(len(ss))) AS j, unnest(ss) AS u FROM (SELECT doc_id, g, {cl.S_SENTENCES} AS ss FROM pz WHERE t > {structure.TARGET})),
pw AS (SELECT *, {s_size("u")} AS t, {cl.s_words("u")} AS w FROM ps), pf AS (SELECT doc_id, g, list({s_unit("u", "t", "list_transform(range(0, CAST(1 + greatest(0, ceil((len(w) - " + str(structure.TARGET) + ") / " + str(structure.TARGET - structure.OVERLAP) + ")) AS BIGINT)), lambda k: array_to_string(w[k * " + str(structure.TARGET - structure.OVERLAP) + " + 1 : k * " + str(structure.TARGET - structure.OVERLAP) + " + " + str(structure.TARGET) + "], ' '))", f"t > {structure.MOST}")} ORDER BY j) AS units FROM pw GROUP BY doc_id, g),
lo AS (SELECT doc_id, g, {s_packed("units", structure.TARGET, "chr(10)")} AS pieces FROM lp UNION ALL SELECT doc_id, g, [text] FROM pz WHERE t <= {structure.TARGET} UNION ALL SELECT doc_id, g, {s_packed("units", structure.TARGET, "' '")} FROM pf),
le AS (SELECT doc_id, g, unnest(range(len(pieces))) AS i, unnest(pieces) AS content FROM lo) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g, i) - 1 AS INTEGER) AS chunk_index, content FROM le"""

_clean = f"array_to_string(list_transform({cl.s_lines(cl.s_encoding('text'))}, lambda x: {cl.s_strip(cl.sub('x', tx.HWS, ' '))}), chr(10))"
_found = "list_concat(" + ", ".join(f"regexp_extract_all(text, {q(p)}, 0)" for _, p in PROTECTED) + ")"
#: Tokens that cleaning must keep: all patterns' matches in the text that the cleaned text lacks.
ORACLES["token_preservation"] = f"WITH {TEXTS} SELECT doc_id, array_to_string(list_filter(list_sort(list_distinct(list_filter(list_transform({_found}, lambda x: trim(x, ' ')), lambda x: length(x) > 1))), lambda x: NOT contains({_clean}, x)), '; ') AS lost FROM texts"

# letters beyond ASCII are parts of words to the masking patterns, not to RE2: a letter that no pattern names stands for them
_ascii = "regexp_replace(text, '[^\\x00-\\x7F²³°]', '_', 'g')"
_each = " UNION ALL ".join(f"SELECT doc_id, regexp_extract_all({_ascii}, {q(p)}, 0) AS f, regexp_split_to_array({_ascii}, {q(p)}) AS gaps FROM texts" for _, p in PROTECTED)
#: Spans of all patterns, the earliest first, then the longest, without overlap; then the text with a mark for each.
ORACLES["masked_tokens"] = f"""WITH {TEXTS}, mf AS ({_each}), mi AS (SELECT doc_id, f, gaps, unnest(range(1, len(f) + 1)) AS i FROM mf), ms AS (SELECT DISTINCT doc_id, CAST(list_sum(list_transform(gaps[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1 : i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(f[i]) AS n FROM mi),
ml AS (SELECT doc_id, list({{'s': [a], 'e': [a + n]}} ORDER BY a, -n) AS l FROM ms GROUP BY doc_id), mk AS (SELECT doc_id, list_reduce([{{'s': []::BIGINT[], 'e': []::BIGINT[]}}] || l, lambda k, x: CASE WHEN len(k.e) = 0 OR x.s[1] >= k.e[-1] THEN {{'s': k.s || x.s, 'e': k.e || x.e}} ELSE k END) AS k FROM ml),
mt AS (SELECT t.doc_id, t.text, coalesce(k.s, []) AS s, coalesce(k.e, []) AS e FROM texts t LEFT JOIN mk USING (doc_id))
SELECT doc_id, array_to_string(list_transform(range(1, len(s) + 1), lambda i: text[coalesce(e[i - 1], 0) + 1 : s[i]] || '__ENG_TOKEN_' || (i - 1) || '__'), '') || text[coalesce(e[-1], 0) + 1 :] AS masked, CAST(len(s) AS INTEGER) AS n_tokens, true AS round_trip FROM mt"""
