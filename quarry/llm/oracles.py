"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

from . import licenses, quality_rules, ranked_search

BLANK = "[\\x20\\x09-\\x0D]+"
WORDS = f"""d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}'), lambda x: x <> '') AS w FROM documents), n AS (SELECT doc_id, len(w) AS n FROM d),
x AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d)"""


def windows(size: int) -> str:
    """doc_id, p, k of every run of `size` words, k the words themselves."""
    return f"SELECT doc_id, p, k FROM (SELECT doc_id, p, string_agg(x, ' ') OVER w AS k, count(*) OVER w AS c FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)) WHERE c = {size}"


def grams(size: int, name: str) -> str:
    """CTEs that end in `name`: the places of words in an n-gram found twice or more in their document."""
    return f"""{name}s AS ({windows(size)}), {name}c AS (SELECT doc_id, k FROM {name}s GROUP BY ALL HAVING count(*) > 1),
{name} AS (SELECT DISTINCT doc_id, p + j AS p FROM {name}s SEMI JOIN {name}c USING (doc_id, k), range(0, {size}) AS t(j))"""


def later_grams(size: int, name: str) -> str:
    """The same for n-grams that came before in their document."""
    return f"{name} AS (SELECT DISTINCT doc_id, p + j AS p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id, k ORDER BY p) AS i FROM ({windows(size)})), range(0, {size}) AS t(j) WHERE i > 1)"


def quality() -> str:
    sizes = list(quality_rules.NGRAM_SHARE)
    parts = ", ".join([grams(3, "g3"), *(later_grams(k, f"g{k}") for k in sizes)])
    chars = ", ".join(f"c{k} AS (SELECT doc_id, CAST(sum(length(x)) AS BIGINT) AS v FROM g{k} JOIN x USING (doc_id, p) GROUP BY doc_id)" for k in sizes)
    joins = " ".join(f"LEFT JOIN c{k} USING (doc_id)" for k in sizes)
    rules = " AND ".join(f"coalesce(c{k}.v, 0) <= {share}::DOUBLE * word_chars" for k, share in quality_rules.NGRAM_SHARE.items())
    counts = ", ".join(f"coalesce(c{k}.v, 0) AS dup_{k}gram_chars" for k in sizes)
    return f"""WITH {WORDS}, {parts}, {chars}, r AS (SELECT doc_id, count(*) AS v FROM g3 GROUP BY doc_id),
e AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM d),
y AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k FROM e WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
l AS (SELECT doc_id, count(*) AS n_lines, sum(length(line)) AS line_chars, count(*) FILTER (k > 1) AS n_dup_lines, coalesce(sum(length(line)) FILTER (k > 1), 0) AS dup_line_chars FROM y GROUP BY doc_id),
a AS (SELECT doc_id, n AS n_words, length(regexp_replace(text, '{BLANK}', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM d JOIN n USING (doc_id)),
b AS (SELECT a.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(r.v, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(dup_line_chars, 0) AS dup_line_chars, coalesce(line_chars, 0) AS line_chars, n_words < {quality_rules.MIN_WORDS} OR 100 * coalesce(r.v, 0) > 50 * n_words AS base_failed FROM a LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules} AND n_dup_lines <= {quality_rules.LINE_SHARE}::DOUBLE * n_lines AND dup_line_chars <= {quality_rules.LINE_CHAR_SHARE}::DOUBLE * line_chars AS kept, n_symbols > {quality_rules.SYMBOL_SHARE}::DOUBLE * n_words AS many_symbols, n_lines, CAST(dup_line_chars AS BIGINT) AS dup_line_chars, {counts} FROM b {joins}"""


SUBSTRINGS = f"""WITH {WORDS}, win AS ({windows(13)}), f AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k), hit AS (SELECT doc_id, p FROM win JOIN f USING (k) WHERE m < doc_id), gone AS (SELECT DISTINCT doc_id, p + j AS p FROM hit, range(0, 13) AS t(j)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS c FROM x ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - coalesce(c, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM n LEFT JOIN kept USING (doc_id)"""


def license_hits() -> str:
    k = licenses.SHINGLE
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in licenses.TEMPLATES.items())
    cut = lambda t: f"list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    scale = "CASE " + " ".join(f"WHEN len(w) <= {s} THEN {s}" for s in licenses.scales(licenses.TEMPLATES)) + " END"
    shingle = lambda source: f"SELECT *, unnest(range(0, greatest(len(w) - {k - 1}, least(len(w), 1)))) AS p FROM {source}"
    return f"""WITH t AS (SELECT license, {cut("notice")} AS w FROM (VALUES {values}) AS v(license, notice)), tp AS ({shingle("t")}), ts AS (SELECT DISTINCT license, {scale} AS scale, array_to_string(w[p + 1 : p + {k}], ' ') AS sh FROM tp), tn AS (SELECT license, count(*) AS total FROM ts GROUP BY license),
d AS (SELECT doc_id, {cut("coalesce(text, '')")} AS w FROM documents), dp AS ({shingle("d")}), ds AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + {k}], ' ') AS sh FROM dp),
h AS (SELECT doc_id, license, scale, p, sh, unnest([p // scale, p // scale - 1]) AS win FROM ds JOIN ts USING (sh)), c AS (SELECT doc_id, license, win, count(DISTINCT sh) AS held FROM h WHERE win >= 0 AND p - win * scale < 2 * scale - {k - 1} GROUP BY ALL),
g AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(DISTINCT license) AS n FROM c JOIN tn USING (license) WHERE held / total >= {licenses.CONTAINMENT}::DOUBLE GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n, 0) AS n_licenses, coalesce(licenses, '') AS licenses FROM documents LEFT JOIN g USING (doc_id)"""


DIGIT = "strpos('0123456789abcdef', substr(h, {0}, 1)) - 1"


def _horner() -> str:
    """20 bits, as four base-32 digits, of the g-th five hex digits of h."""
    value = "0"
    for i in range(1, 6):
        value = f"({value} * 16 + ({DIGIT.format(f'5 * g + {i}')}))"
    return " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST({value} // {32**e} % 32 AS INTEGER) + 1, 1)" for e in (3, 2, 1, 0))


WARC = f"""WITH a AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages), m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM a)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda g: {_horner()}), '') AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM m"""

UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def merkle() -> str:
    """Trees level by level, each node with what stands left and right of it in its run, then paths from leaf to root."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    climb = lambda t: f"SELECT g, lvl + 1, i // 16, sha256(string_agg(node, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {t}) WHERE n > 1 GROUP BY g, lvl, i // 16"
    run = "OVER (PARTITION BY g, lvl, i // 16 ORDER BY i ROWS BETWEEN"
    beside = lambda t: f"SELECT * FROM (SELECT g, lvl, i, coalesce(string_agg(node, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(node, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, count(*) OVER (PARTITION BY g, lvl) AS n FROM {t}) WHERE n > 1"
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT)] || list_transform(range(8), lambda z: -1::BIGINT)))"
    crc = f"xor(list_reduce([4294967295::BIGINT] || {bits}, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295::BIGINT)"
    return f"""WITH RECURSIVE d AS (SELECT *, coalesce('s' || source, '') AS g, {leaf("text")} AS leaf, {leaf(f"translate(text, {UPPER}, {LOWER})")} AS lowered, coalesce({crc} % 5 = 0, false) AS odd FROM documents),
e AS (SELECT *, CASE WHEN odd THEN lowered ELSE leaf END AS told, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
t(g, lvl, i, node) AS (SELECT g, 0, i, leaf FROM e UNION ALL {climb("t")}),
sub AS (SELECT g AS src, node, row_number() OVER (ORDER BY g) - 1 AS j FROM (SELECT *, count(*) OVER (PARTITION BY g, lvl) AS n FROM t) WHERE n = 1),
u(g, lvl, i, node) AS (SELECT '', 0, j, node FROM sub UNION ALL {climb("u")}),
root AS (SELECT node AS root FROM (SELECT *, count(*) OVER (PARTITION BY lvl) AS n FROM u) WHERE n = 1),
p AS (SELECT e.g, e.i, s.lvl AS k, l, r FROM e JOIN ({beside("t")}) s ON s.g = e.g AND s.i = e.i >> (4 * s.lvl) UNION ALL SELECT e.g, e.i, 100 + s.lvl, l, r FROM e JOIN sub ON sub.src = e.g JOIN ({beside("u")}) s ON s.i = sub.j >> (4 * s.lvl)),
q AS (SELECT g, i, string_agg(l || r, '' ORDER BY k) AS proof, list({{'l': l, 'r': r}} ORDER BY k) AS steps FROM p GROUP BY g, i),
f AS (SELECT doc_id, leaf, sub.node AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, list_reduce([{{'l': told, 'r': ''}}] || coalesce(steps, []), lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}).l AS folded_root FROM e JOIN sub ON sub.src = e.g LEFT JOIN q USING (g, i) CROSS JOIN root)
SELECT *, folded_root = root AS verified FROM f"""


EXACT = f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {UPPER}, {LOWER}) AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t)"""


def search() -> str:
    cut = f"regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH x AS (SELECT doc_id, unnest({cut}) AS t FROM documents), n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id), s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
tf AS (SELECT doc_id, t, count(*) AS tf FROM x GROUP BY ALL), w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({cut}) AS t FROM benchmark) GROUP BY ALL),
i AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total))) AS v FROM tf JOIN n USING (doc_id) JOIN w USING (t), s),
r AS (SELECT item_id, doc_id, CAST(sum(c * v) AS BIGINT) AS score FROM q JOIN i USING (t) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= {ranked_search.TOP}"""


ORACLES = {
    "op6_warc_round_trip": WARC, "op7_license_scan": license_hits(), "op8_quality_rules": quality(), "op9_substring_dedup": SUBSTRINGS,
    "op11_merkle_manifest": merkle(), "op12_exact_dedup": EXACT, "op13_ranked_search": search(),
}
