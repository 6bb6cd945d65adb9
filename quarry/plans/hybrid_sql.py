"""DuckDB statements of hybrid retrieval, step by step: both channels, fusion, boosts, reranking, neighbours, near-duplicates, contexts."""

from __future__ import annotations

from ..functions import queries as qf
from ..operators import candidates
from . import retrieval as rt
from .cleaning import s_strip, s_tokens, s_words
from .collection import CHUNKS
from .fixtures import literal as q

HEX = "strpos('0123456789abcdef', substr(h, {0}, 1)) - 1"
CID = "doc_id * 1048576 + chunk_index"


def s_number(i: str) -> str:
    """The i-th signed 32-bit little-endian number of the hexadecimal h, over 2**31."""
    value = "0::BIGINT"
    for k in (3, 2, 1, 0):
        for d in (1, 2):
            value = f"({value} * 16 + ({HEX.format(f'{i} * 8 + {2 * k + d}')}))"
    return f"(CASE WHEN {value} >= 2147483648 THEN {value} - 4294967296 ELSE {value} END) / 2147483648.0::DOUBLE"


def s_vectors(name: str, rows: str) -> str:
    """CTEs that end in `name`: id and v, the unit hash vector of 64 numbers of each (id, x)."""
    return f"""{name}_h AS (SELECT id, step, sha256('local_embedder:' || x || ':' || step) AS h FROM ({rows}), range(0, 8) AS r(step)), {name}_n AS (SELECT id, step * 8 + i AS pos, {s_number("i")} AS x FROM {name}_h, range(0, 8) AS p(i)),
{name} AS (SELECT id, list_transform(list(x ORDER BY pos), lambda y: y / sqrt(sum(x * x))) AS v FROM {name}_n GROUP BY id)"""


def s_tok(t: str) -> str:
    return f"CAST(greatest(len({s_words(t)}), ceil(length({s_strip(t)}) / 4)) AS BIGINT)"


S_STOP = q(list(qf.STOPWORDS))
#: Chunks with an id that SQL can make too.
CHUNK_TABLE = f"{CHUNKS}, ch AS (SELECT {CID} AS cid, doc_id AS document, chunk_index AS idx, content FROM chunks)"


def s_bm25(name: str, asked: str) -> str:
    """CTEs that end in `name`: query_id, cid, score, place (from 1) of chunks for queries (query_id, t) of the table `asked`."""
    every = s_tokens("t")
    return f"""b_t AS (SELECT cid, {s_tokens("content")} AS a FROM ch), b_p AS (SELECT cid, term, count(*) AS tf FROM (SELECT cid, unnest(a) AS term FROM b_t) GROUP BY ALL), b_n AS (SELECT cid, len(a) AS size FROM b_t), b_c AS (SELECT count(*) AS n_docs, avg(size) AS mean FROM b_n), b_df AS (SELECT term, count(*) AS df FROM b_p GROUP BY term),
b_a AS (SELECT query_id, {every} AS a FROM {asked}), b_f AS (SELECT query_id, CASE WHEN len(list_filter(a, lambda w: NOT list_contains({S_STOP}, w))) > 0 THEN list_filter(a, lambda w: NOT list_contains({S_STOP}, w)) ELSE a END AS a FROM b_a), b_q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(a) AS term FROM b_f) GROUP BY ALL),
b_s AS (SELECT query_id, cid, sum(times * greatest(ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1), 1e-4) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))) AS score FROM b_q JOIN b_df USING (term) JOIN b_p USING (term) JOIN b_n USING (cid) CROSS JOIN b_c GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, cid) AS place FROM b_s)"""


def s_contexts(name: str, blocks: str) -> str:
    """CTEs that end in `name`: query_id, context, n_tokens, n_packed from (query_id, rank, heading, content, budget)."""
    head, tokens = "chr(10) || '--- ' || heading || ' ---' || chr(10)", s_tok
    piece = "x.head || array_to_string(x.parts[1 : len(list_filter(x.sums, lambda s: s <= budget - a.n - x.m))], '. ') || chr(10)"
    return f"""k_b AS (SELECT query_id, rank, budget, {head} AS head, {s_strip("content")} AS t FROM ({blocks})), k_w AS (SELECT *, head || t || chr(10) AS line, string_split(t, '. ') AS parts FROM k_b),
k_t AS (SELECT *, {tokens("line")} AS n, {tokens("head")} AS m, list_transform(parts, lambda s: {tokens("s")}) AS each FROM k_w), k_s AS (SELECT *, list_transform(range(1, len(each) + 1), lambda i: CAST(list_sum(each[1 : i]) AS BIGINT)) AS sums FROM k_t),
k_l AS (SELECT query_id, any_value(budget) AS budget, list({{'line': line, 'n': n, 'm': m, 'head': head, 'parts': parts, 'sums': sums, 'stop': false}} ORDER BY rank) AS l FROM k_s GROUP BY query_id),
k_r AS (SELECT query_id, list_reduce([{{'line': '{candidates.HEADER}', 'n': {tokens(f"'{candidates.HEADER}'")}, 'm': 0::BIGINT, 'head': '', 'parts': []::VARCHAR[], 'sums': []::BIGINT[], 'stop': false}}] || l, lambda a, x: CASE WHEN a.stop THEN a
WHEN a.n + x.n <= budget THEN {{'line': a.line || x.line, 'n': a.n + x.n, 'm': a.m + 1, 'head': '', 'parts': []::VARCHAR[], 'sums': []::BIGINT[], 'stop': false}}
WHEN budget - a.n - x.m > 100 AND x.sums[1] <= budget - a.n - x.m THEN {{'line': a.line || {piece}, 'n': a.n + {tokens(piece)}, 'm': a.m + 1, 'head': '', 'parts': []::VARCHAR[], 'sums': []::BIGINT[], 'stop': true}}
ELSE {{'line': a.line, 'n': a.n, 'm': a.m, 'head': '', 'parts': []::VARCHAR[], 'sums': []::BIGINT[], 'stop': true}} END) AS r FROM k_l),
{name} AS (SELECT query_id, r.line AS context, CAST(r.n AS INTEGER) AS n_tokens, CAST(r.m AS INTEGER) AS n_packed FROM k_r)"""


_clean = "regexp_replace(w, '^[^\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+$', '', 'g')"
_raw = f"list_filter(list_transform({s_words('lower(t)')}, lambda w: {_clean}), lambda w: w <> '')"


def s_hybrid(parameters: str) -> str:
    """CTEs that end in `hits` and `blocks`; parameters: columns k, radius, dw, bw, budget over the CTE p of queries."""
    return f"""WITH {rt.ENTITIES}, {CHUNK_TABLE}, l AS (SELECT *, regexp_extract_all(lower(t), '\\b[a-z0-9-]+\\b') AS low FROM e), p AS (SELECT query_id, t, standards, coalesce({rt._s_intents()}[1], 'informational') AS p FROM l),
q0 AS (SELECT query_id, t, standards, {parameters} FROM p), qs AS (SELECT *, greatest(20, 2 * k) AS wide FROM q0),
{s_bm25("sparse", "qs")}, {s_vectors("cv", "SELECT cid AS id, content AS x FROM ch")}, {s_vectors("qv", "SELECT query_id AS id, 'query: ' || t AS x FROM qs")},
dn AS (SELECT qv.id AS query_id, cv.id AS cid, row_number() OVER (PARTITION BY qv.id ORDER BY round(list_inner_product(qv.v, cv.v), 9) DESC, cv.id) AS place FROM qv, cv QUALIFY place <= 60),
da AS (SELECT dn.* FROM dn JOIN qs USING (query_id) WHERE place <= wide), sa AS (SELECT query_id, cid, place FROM sparse JOIN qs USING (query_id) WHERE place <= wide),
fu AS (SELECT query_id, cid, da.place AS ra, sa.place AS rb FROM da FULL OUTER JOIN sa USING (query_id, cid)), fs AS (SELECT fu.*, coalesce(dw / (60 + ra), 0.0::DOUBLE) + coalesce(bw / (60 + rb), 0.0::DOUBLE) AS score, wide FROM fu JOIN qs USING (query_id)),
fk AS (SELECT * FROM fs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ra NULLS LAST, rb NULLS LAST, cid) <= wide),
bo AS (SELECT query_id, cid, document, idx, content, t, k, greatest(0.0::DOUBLE, score - CASE WHEN length(trim(content)) < 50 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + 0.15::DOUBLE * len(list_filter(standards, lambda s: contains(regexp_replace(lower(trim(content)), '[- ]', '', 'g'), regexp_replace(lower(s), '[- ]', '', 'g'))))) AS score FROM fk JOIN ch USING (cid) JOIN qs USING (query_id)),
tr AS (SELECT query_id, {_raw} AS raw FROM qs), tw AS (SELECT query_id, CASE WHEN len(list_filter(raw, lambda x: NOT list_contains({S_STOP}, x))) > 0 THEN list_filter(raw, lambda x: NOT list_contains({S_STOP}, x)) ELSE raw END AS own FROM tr),
tt AS (SELECT query_id, list_distinct(list_concat(own, list_filter(flatten(list_transform(list_filter(own, lambda x: regexp_matches(x, '[-_]')), lambda x: regexp_split_to_array(x, '[-_]+'))), lambda x: length(x) > 1 AND NOT list_contains({S_STOP}, x)))) AS terms FROM tw),
ov AS (SELECT bo.*, CASE WHEN len(terms) > 0 THEN least(1.0::DOUBLE, len(list_filter(terms, lambda x: contains(lower(content), x))) / len(terms)) ELSE 0.0::DOUBLE END AS overlap, length(regexp_replace(content, '[^\\x20-\\x7E]', '', 'g')) / greatest(1, length(content)) AS plain FROM bo JOIN tt USING (query_id)),
sc AS (SELECT query_id, cid, document, idx, k, round((overlap * 0.75::DOUBLE + least(1.0::DOUBLE, score) * 0.25::DOUBLE) * CASE WHEN length(content) > 0 AND plain < 0.8::DOUBLE THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN regexp_matches(lower(content), 'microsoft time-stamp|timestamp pca|@v@v|\\+\\+\\+\\]') THEN 0.05::DOUBLE ELSE 1.0::DOUBLE END, 9) AS score FROM ov),
be AS (SELECT query_id, cid, document, idx, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cid) - 1 AS rank, k FROM sc QUALIFY rank < greatest(15, k)),
ne AS (SELECT query_id, document, idx + step AS idx, step, score, rank FROM (SELECT be.*, unnest(range(-radius, radius + 1)) AS step FROM be JOIN qs USING (query_id)) WHERE step <> 0), nb AS (SELECT query_id, document, idx, arg_min(score, rank * 1000 + step) AS score, min(rank) AS after FROM ne GROUP BY ALL),
wi AS (SELECT query_id, cid, document, idx, score, rank FROM be UNION ALL SELECT nb.query_id, ch.cid, nb.document, nb.idx, nb.score * {candidates.NEIGHBOUR_SHARE}::DOUBLE, after + 1000 FROM nb JOIN ch USING (document, idx) ANTI JOIN be ON be.query_id = nb.query_id AND be.cid = ch.cid),
wt AS (SELECT wi.*, content, trim(content, ' ') AS x, row_number() OVER (PARTITION BY query_id ORDER BY rank, wi.cid) AS r FROM wi JOIN ch USING (cid)),
pr AS (SELECT a.query_id, b.r AS late, a.r AS early, a.x, b.x AS y FROM wt a JOIN wt b ON a.query_id = b.query_id AND a.r < b.r WHERE a.x = b.x OR length(b.x) / length(a.x) BETWEEN {candidates.LENGTHS[0]}::DOUBLE AND {candidates.LENGTHS[1]}::DOUBLE),
si AS (SELECT query_id, late, list(early) AS near FROM pr WHERE x = y OR 2.0::DOUBLE * list_sum(list_transform(list_filter(list_distinct(string_split(x, '')), lambda c: c <> ''), lambda c: least(length(x) - length(replace(x, c, '')), length(y) - length(replace(y, c, ''))))) / (length(x) + length(y)) >= {candidates.SIMILAR}::DOUBLE GROUP BY ALL),
st AS (SELECT wt.query_id, list_reduce([{{'r': []::BIGINT[], 'n': []::BIGINT[]}}] || list({{'r': [CAST(r AS BIGINT)], 'n': coalesce(near, [])}} ORDER BY r), lambda acc, cur: CASE WHEN list_has_any(acc.r, cur.n) THEN acc ELSE {{'r': acc.r || cur.r, 'n': []::BIGINT[]}} END).r AS kept FROM wt LEFT JOIN si ON si.query_id = wt.query_id AND si.late = wt.r WHERE x <> '' GROUP BY wt.query_id),
kp AS (SELECT query_id, unnest(kept) AS r, unnest(range(len(kept))) AS place FROM st), fi AS (SELECT wt.query_id, cid, document, idx, content, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, score)), 6) AS score, place AS rank FROM kp JOIN wt USING (query_id, r)),
fd AS (SELECT query_id, document, '[' || row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) || ']' AS anchor FROM fi GROUP BY query_id, document), hits AS (SELECT fi.*, anchor FROM fi JOIN fd USING (query_id, document)),
blocks AS (SELECT query_id, rank, anchor || ' Source: ' || document AS heading, content, budget FROM hits JOIN qs USING (query_id))"""


HYBRID = f"""{s_hybrid("10 AS k, 1 AS radius, 1.0::DOUBLE AS dw, 1.0::DOUBLE AS bw, 3000 AS budget").replace("FROM l), q0", "FROM l WHERE query_id >= 1000), q0").replace("FROM l),", "FROM l WHERE query_id >= 1000),")}
SELECT CAST(query_id - 1000 AS BIGINT) AS query_id, cid, CAST(document AS VARCHAR) AS document, CAST(idx AS INTEGER) AS index, score, CAST(rank AS INTEGER) AS rank, anchor FROM hits"""

PACKED = f"""WITH {CHUNK_TABLE}, qs AS (SELECT item_id AS query_id, text AS t FROM benchmark), {s_bm25("sparse", "qs")}, {s_contexts("contexts", "SELECT query_id, place AS rank, '[' || place || '] Source: ' || document AS heading, content, 600 AS budget FROM sparse JOIN ch USING (cid) WHERE place <= 10")}
SELECT query_id, context, n_tokens, n_packed FROM contexts"""


def adaptive() -> str:
    from .metadata import _s_adaptive

    columns = f"{_s_adaptive(1)} AS k, {_s_adaptive(2)} AS radius, CAST({_s_adaptive(3)} AS DOUBLE) AS dw, CAST({_s_adaptive(4)} AS DOUBLE) AS bw, {_s_adaptive(5)} AS budget"
    return f"{s_hybrid(columns)}, {s_contexts('contexts', 'SELECT * FROM blocks')} SELECT CAST(query_id AS BIGINT) AS query_id, sha256(context) AS context_hash, n_tokens, n_packed FROM contexts"
