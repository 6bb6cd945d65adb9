"""Query processing, BM25, vectors, fusion and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import queries as qf
from ..functions import text as tx
from ..operators import lexical, ranking, vectors
from . import fixtures
from .cleaning import s_strip, s_tokens, s_words, sub
from .fixtures import cte
from .fixtures import literal as q
from .registry import query, read

ASKED = cte("fx_queries") + ", asked AS (SELECT query_id, text FROM fx_queries UNION ALL SELECT CAST(item_id AS INTEGER) + 1000, text FROM benchmark)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = read(spark, sf_dir, "benchmark").select((F.col("item_id").cast("int") + 1000).alias("query_id"), "text")
    return fixtures.table(spark, "fx_queries").unionByName(bench)


def s_normal(t: str) -> str:
    t = sub(t, qf.TAG_JOIN, "$1-$2")
    for pattern, put in qf.UNIT_GAPS:
        t = sub(t, pattern, put.replace("1", "$1", 1).replace("2", "$2", 1))
    return s_strip(sub(f"replace({t}, '°°', '°')", f"[{tx.WS}]+", " "))


NORMAL = f"{ASKED}, n AS (SELECT query_id, {s_normal('text')} AS t FROM asked)"


def s_map(d: dict[str, str]) -> str:
    return f"MAP {{{', '.join(f'{q(k)}: {q(v)}' for k, v in d.items())}}}"


@query(f"WITH {NORMAL} SELECT query_id, t AS normalized FROM n")
def query_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("query_id", qf.normalize(F.col("text")).alias("normalized"))


@query(
    f"""WITH {NORMAL} SELECT query_id, array_to_string(list_transform({s_words("t")}, lambda w: coalesce(w || ' (' || {s_map(qf.ACRONYMS)}[upper({sub("w", "^[.,;:?!()" + chr(92) + "[" + chr(92) + "]]+|[.,;:?!()" + chr(92) + "[" + chr(92) + "]]+$", "")})] || ')', w)), ' ') AS expanded FROM n"""
)
def query_expand_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("query_id", qf.expand_acronyms(F.col("text")).alias("expanded"))


@query()
def query_expand_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("query_id", F.posexplode(qf.expand_terms(F.col("text"))).alias("pos", "term"))


@query()
def query_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("query_id", qf.rewrite(F.col("text")).alias("rewritten"))


def s_sorted(a: str) -> str:
    return f"list_sort(list_distinct({a}))"


def s_all(pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all(t, {q(pattern)}, {group})"


# RE2 takes letters beyond ASCII for word ends; Java and the engine do not
ANY_LETTER = r"[^\x00-\x7F]"
S_TAGS = f"""list_filter(list_transform({s_all(qf.TAG)}, lambda m: upper(regexp_replace(m, '(?i)^([A-Z]{{1,4}})[-_]?', '\\1-'))), lambda x: NOT list_contains({q(qf.EXCLUDED_PREFIXES)}, split_part(x, '-', 1)) AND (length(split_part(x, '-', 1)) > 1 OR length(x) >= 5))"""
S_UNITS = f"list_transform({s_all(qf.PLANT_UNIT)}, lambda x: replace(upper(x), ' ', '-'))"
S_STANDARDS = f"list_transform({s_all(qf.STANDARD)}, lambda x: upper(regexp_replace(x, '[-_\\s]+', '-', 'g')))"
S_PRESSURES = f"list_transform({s_all(qf.PRESSURE)}, lambda x: regexp_extract(x, {q(qf.PRESSURE)}, 1) || ' ' || lower(regexp_extract(x, {q(qf.PRESSURE)}, 2)))"
# letters beyond ASCII stand for word ends in RE2; the sign of degrees is kept
S_ASCII = "regexp_replace(t, '[^\\x00-\\x7F°]', '_', 'g')"
ENTITIES = f"{NORMAL}, e AS (SELECT query_id, t, {s_sorted(S_TAGS)} AS equipment_tags, {s_sorted(S_UNITS)} AS plant_units, {s_sorted(S_STANDARDS)} AS standards, {s_sorted(S_PRESSURES)} AS pressure_values, {s_sorted(f"list_transform(regexp_extract_all({S_ASCII}, {q(qf.TEMPERATURE)}), lambda x: regexp_extract(x, {q(qf.TEMPERATURE)}, 1) || ' °' || upper(regexp_extract(x, {q(qf.TEMPERATURE)}, 2)))")} AS temperature_values, {s_sorted(f"list_transform(regexp_extract_all({S_ASCII}, {q(qf.LINE_NUMBER)}), lambda x: upper(x))")} AS line_numbers, {s_sorted(f"regexp_extract_all({S_ASCII}, {q(qf.DATE)})")} AS dates, {s_sorted(f"regexp_extract_all({S_ASCII}, {q(qf.PERSON)}, 1)")} AS engineer_names, {s_sorted(f"regexp_extract_all(regexp_replace(t, {q(ANY_LETTER)}, '_', 'g'), {q(qf.REVISION)}, 1)")} AS revision_numbers, {s_sorted(s_all(qf.SECTION_REF, 1))} AS section_references, {s_sorted(s_all(qf.PAGE_REF, 1))} AS page_references FROM n)"
KINDS = ("equipment_tags", "plant_units", "standards", "pressure_values", "temperature_values", "line_numbers", "dates", "engineer_names", "revision_numbers", "section_references", "page_references")


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asked(spark, sf_dir).select("query_id", qf.normalize(F.col("text")).alias("t"))
    return rows.select("query_id", "t", qf.entities(F.col("t")).alias("e"))


@query(f"WITH {ENTITIES} SELECT query_id, " + ", ".join(f"array_to_string({k}, '; ') AS {k}" for k in KINDS) + " FROM e")
def query_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed(spark, sf_dir).select("query_id", *[F.array_join(f"e.{k}", "; ").alias(k) for k in KINDS])


def _s_intents() -> str:
    out = []
    for name, triggers, *_ in qf.INTENTS:
        hit = f"list_has_any(low, {q(list(triggers))})" if triggers else "false"
        more = {"safety_lookup": "standards", "numerical_lookup": "pressure_values", "equipment_lookup": "equipment_tags"}.get(name)
        out.append(f"CASE WHEN {hit}{f' OR len({more}) > 0' if more else ''} THEN {q(name)} END")
    return f"list_filter([{', '.join(out)}], lambda x: x IS NOT NULL)"


def _s_param(i: int, default: str) -> str:
    whens = " ".join(f"WHEN {q(x[0])} THEN {q(x[i]) if not isinstance(x[i], bool) else str(x[i]).lower()}" for x in qf.INTENTS)
    return f"CASE p {whens} ELSE {default} END"


@query(
    f"""WITH {ENTITIES}, l AS (SELECT *, regexp_extract_all(lower(t), '\\b[a-z0-9-]+\\b') AS low FROM e), i AS (SELECT *, {_s_intents()} AS every FROM l), p AS (SELECT *, coalesce(every[1], 'informational') AS p FROM i)
SELECT query_id, p AS primary_intent, coalesce(array_to_string(every[2:], ','), '') AS secondary_intents, CASE WHEN len(equipment_tags) > 0 OR len(standards) > 0 THEN 0.95::DOUBLE ELSE 0.85::DOUBLE END AS confidence, CAST({_s_param(2, "10")} AS INTEGER) AS top_k, {_s_param(3, "false")} AS expand, {_s_param(4, "NULL")} AS category FROM p"""
)
def query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analysed(spark, sf_dir).withColumn("every", qf.intents(F.col("t"), F.col("e"))).withColumn("p", F.coalesce(F.get("every", F.lit(0)), F.lit("informational")))
    pick = lambda i, default: F.coalesce(*[F.when(F.col("p") == x[0], F.lit(x[i])) for x in qf.INTENTS], default)
    sure = (F.size("e.equipment_tags") > 0) | (F.size("e.standards") > 0)
    return rows.select("query_id", F.col("p").alias("primary_intent"), F.array_join(F.slice("every", 2, 99), ",").alias("secondary_intents"), F.when(sure, 0.95).otherwise(0.85).alias("confidence"), pick(2, F.lit(10)).alias("top_k"), pick(3, F.lit(False)).alias("expand"), pick(4, F.lit(None)).alias("category"))


@query("SELECT item_id, sha256(lower(trim(text, ' ')) || '::hybrid::10::None') AS cache_key FROM benchmark")
def query_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", F.sha2(F.concat(F.lower(F.trim("text")), F.lit("::hybrid::10::None")), 256).alias("cache_key"))


POSTINGS = f"t AS (SELECT doc_id, {s_tokens('text')} AS a FROM documents), x AS (SELECT doc_id, unnest(a) AS term FROM t), postings AS (SELECT doc_id, term, count(*) AS tf FROM x GROUP BY ALL), size AS (SELECT doc_id, len(a) AS doc_len FROM t)"


@query(f"WITH {POSTINGS} SELECT doc_id, term, tf FROM postings")
def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "term", "tf")


@query(f"WITH {POSTINGS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM postings GROUP BY term")
def bm25_document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(read(spark, sf_dir, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


STOP = q(qf.STOPWORDS)
SEARCH = f"""{POSTINGS}, corpus AS (SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM size), df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
qt AS (SELECT item_id, {s_tokens("text")} AS a FROM benchmark), qf AS (SELECT item_id, CASE WHEN len(list_filter(a, lambda w: NOT list_contains({STOP}, w))) > 0 THEN list_filter(a, lambda w: NOT list_contains({STOP}, w)) ELSE a END AS a FROM qt),
qx AS (SELECT item_id, unnest(a) AS term FROM qf), qc AS (SELECT item_id, term, count(*) AS times FROM qx GROUP BY ALL),
scored AS (SELECT item_id, doc_id, sum(times * greatest(ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1), 1e-4) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * doc_len / avg_len))) AS score FROM qc JOIN df USING (term) JOIN postings USING (term) JOIN size USING (doc_id) CROSS JOIN corpus GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) - 1 AS rank FROM scored)"""


def bm25_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    # ranked by the rounded score, so that the order of summing cannot decide a tie
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", k, 6)


@query(f"WITH {SEARCH} SELECT item_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM hits WHERE rank < 10")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a query over all documents."""
    return bm25_hits(spark, sf_dir, 10).select("item_id", "doc_id", "score", "rank")


DOT = "list_inner_product(a.embedding, b.embedding)"
KNN = f"""a AS (SELECT vec_id AS query_id, embedding, label FROM embeddings WHERE vec_id % 100 = 0), b AS (SELECT vec_id, embedding, label FROM embeddings),
n AS (SELECT query_id, vec_id, a.label = b.label AS same, round(CAST(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS DOUBLE), 5) AS score FROM a, b)"""


def _knn(spark: SparkSession, sf_dir: str, same: str | None) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return vectors.nearest(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 10, same=same, digits=5).withColumn("score", F.round("score", 5))


@query(f"WITH {KNN}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM n) SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank < 10")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set, ids divisible by 100, against all rows."""
    return _knn(spark, sf_dir, None)


@query(f"WITH {KNN}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM n WHERE same) SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank < 10")
def vector_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, "label")


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dimension, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm, CASE WHEN len(embedding) <> 64 THEN 'dimension' WHEN abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) - 1) > 0.02 THEN 'norm' ELSE '' END AS problems FROM embeddings")
def vector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.size(v).alias("dimension"), F.round(vectors.norm(v), 4).alias("norm"), F.array_join(vectors.problems(v, 64), ",").alias("problems"))


@query("SELECT doc_id, sha256('local_embedder:' || sha256(text)) AS cache_key FROM documents")
def embedding_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat(F.lit("local_embedder:"), F.sha2("text", 256)), 256).alias("cache_key"))


@query("SELECT label, count(*) AS points, count(embedding) AS vectors FROM embeddings GROUP BY label")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("points"), F.count("embedding").alias("vectors"))


RANKED = """c AS (SELECT c_nationkey AS query_id, c_custkey AS item, c_acctbal AS score FROM customer), o AS (SELECT c_nationkey AS query_id, c_custkey AS item, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
a AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM c QUALIFY rank <= 20), b AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, item) AS rank FROM o QUALIFY rank <= 20)"""


@query(
    f"""WITH {RANKED}, f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.item, b.item) AS item, a.rank AS rank_a, b.rank AS rank_b, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS score FROM a FULL OUTER JOIN b ON a.query_id = b.query_id AND a.item = b.item)
SELECT query_id, item, CAST(rank_a AS INTEGER) AS rank_a, CAST(rank_b AS INTEGER) AS rank_b, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank_a NULLS LAST, rank_b NULLS LAST, item) AS INTEGER) AS fused_rank FROM f"""
)
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels per nation: customers by balance, and by number of orders."""
    customer, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    c = customer.select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("item"), F.col("c_acctbal").alias("score"))
    o = orders.groupBy(F.col("o_custkey").alias("item")).agg(F.count("*").alias("n")).join(c, "item").select("query_id", "item", "n")
    first = lexical.top_k(c, "query_id", "score", "item", 20).withColumn("rank", F.col("rank") + 1)
    second = lexical.top_k(o, "query_id", "n", "item", 20).withColumn("rank", F.col("rank") + 1)
    return ranking.fuse(first, second, "query_id", "item").withColumn("score", F.round("score", 9))


@query(
    """WITH s AS (SELECT c_nationkey AS query_id, c_custkey AS item, c_acctbal AS x, count(*) OVER w AS n, min(c_acctbal) OVER w AS lo, max(c_acctbal) OVER w AS hi, avg(c_acctbal) OVER w AS mean, stddev_pop(c_acctbal) OVER w AS dev, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS r FROM customer WINDOW w AS (PARTITION BY c_nationkey))
SELECT query_id, item, round(CASE WHEN n = 1 THEN 1 WHEN hi = lo THEN 1 ELSE (x - lo) / (hi - lo) END, 6) AS min_max, round(CASE WHEN n = 1 THEN 1 ELSE exp(x / 1000 - hi / 1000) / sum(exp(x / 1000 - hi / 1000)) OVER (PARTITION BY query_id) END, 6) AS softmax,
round(CASE WHEN n = 1 THEN 1 WHEN dev = 0 THEN 0.5 ELSE 1 / (1 + exp(-(x - mean) / dev)) END, 6) AS z_score, round(CASE WHEN n = 1 THEN 1 ELSE (r - 1)::DOUBLE / (n - 1) END, 6) AS percentile FROM s"""
)
def score_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("item"), (F.col("c_acctbal") / 1000).alias("score"))
    made = ranking.normalize_scores(rows, "score", "query_id", "item")
    return made.select("query_id", "item", *[F.round(c, 6).alias(c) for c in ("min_max", "softmax", "z_score", "percentile")])


@query()
def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best BM25 hits of each passage, scored by term overlap."""
    hits = bm25_hits(spark, sf_dir, 20)
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), "source")
    asked_ = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    rows = hits.join(docs, "doc_id").join(asked_, "item_id")
    scored = rows.select("item_id", "doc_id", F.round(ranking.lexical_score(F.col("query"), F.col("content"), F.col("source"), F.col("score")), 6).alias("rerank_score"))
    return lexical.top_k(scored, "item_id", "rerank_score", "doc_id", 20)


WANTED = [
    (1, "P-203 pressure limits OISD-105", ["P-203"], ["CDU-1"], ["OISD-105"], "safety_lookup", "d1", 2),
    (2, "email about the inspection report finding", [], [], [], "inspection_lookup", None, None),
    (3, "maintenance work order template form", ["MOV-101"], [], ["API-510"], "template_lookup", "d3", 4),
]
fixtures.TABLES["fx_wanted"] = (WANTED, "query_id int, query string, target_equipment array<string>, target_units array<string>, target_standards array<string>, intent string, target_document string, target_page int")
fixtures.TABLES["fx_candidates"] = ([(w[0], c[0]) for w in WANTED for c in fixtures.CHUNKS], "query_id int, chunk_id string")
BOOSTED = ("query_id", "chunk_id", "score", "query", "category", "document_name", "source_path", "content", "page", "target_page", "target_equipment", "equipment", "target_units", "plant_unit", "target_standards", "standards", "document_id", "target_document", "intent")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best BM25 hits of each benchmark passage as chunks, and inline queries with inline candidates."""
    chunks = fixtures.chunk_rows(spark, sf_dir)
    wanted = fixtures.table(spark, "fx_wanted")
    own = fixtures.table(spark, "fx_candidates").join(wanted, "query_id").join(fixtures.table(spark, "fx_chunks"), "chunk_id").select(*BOOSTED)
    rows = analysed(spark, sf_dir).where("query_id >= 1000").withColumn("intent", F.coalesce(F.get(qf.intents(F.col("t"), F.col("e")), F.lit(0)), F.lit("informational")))
    n = F.col("query_id") - 1000
    asked_ = rows.select("query_id", F.col("t").alias("query"), F.col("e.equipment_tags").alias("target_equipment"), F.col("e.plant_units").alias("target_units"), F.col("e.standards").alias("target_standards"), "intent", F.concat(F.lit("src"), (n % 20).cast("string")).alias("target_document"), (n % 50).cast("int").alias("target_page"))
    hits = bm25_hits(spark, sf_dir, 10).select((F.col("item_id").cast("int") + 1000).alias("query_id"), F.concat(F.lit("x"), "doc_id").alias("chunk_id"), F.col("score").alias("score"))
    return hits.join(asked_, "query_id").join(chunks.drop("score"), "chunk_id").select(*BOOSTED).unionByName(own)


def _s_boost() -> str:
    add = lambda c, by: f"CASE WHEN coalesce({c}, false) THEN {by}::DOUBLE ELSE 0.0::DOUBLE END"
    has = lambda t, *xs: f"regexp_matches(lower(coalesce({t}, '')), '{'|'.join(xs)}')"
    parts = [
        add("list_has_any(target_equipment, equipment)", 0.2), add("list_contains(target_units, upper(plant_unit))", 0.15), add("list_has_any(target_standards, standards)", 0.2), add("document_id = target_document", 0.1), add("abs(page - target_page) = 0", 0.1), add("abs(page - target_page) BETWEEN 1 AND 2", 0.05),
        f"(0 - {add('length(trim(content)) < 50', 0.2)})", "0.15::DOUBLE * len(list_filter(target_standards, lambda s: contains(regexp_replace(lower(trim(content)), '[- ]', '', 'g'), regexp_replace(lower(s), '[- ]', '', 'g'))))",
        add(f"(intent = 'template_lookup' OR {has('query', 'template', 'form')}) AND ({has('category', 'template')} OR {has('document_name', 'template')} OR {has('source_path', 'template')})", 0.25),
        add(f"(intent = 'maintenance_lookup' OR {has('query', 'maintenance', 'repair', 'work order')}) AND ({has('category', 'maint')} OR {has('document_name', 'maint', 'work_order')} OR {has('source_path', 'maint')})", 0.2),
        add(f"{has('query', 'mail', 'communicat')} AND ({has('category', 'email')} OR {has('source_path', 'email')} OR {has('document_name', '^e')})", 0.2),
        add(f"{has('query', 'inspection')} AND {has('query', 'report', 'finding')} AND ({has('category', 'inspect')} OR {has('document_name', 'inspect')})", 0.15),
    ]
    columns = ", ".join(BOOSTED)
    return f"""WITH {ENTITIES}, {fixtures.CHUNK_ROWS}, {cte("fx_wanted", "fx_candidates")}, {SEARCH}, l AS (SELECT *, regexp_extract_all(lower(t), '\\b[a-z0-9-]+\\b') AS low FROM e WHERE query_id >= 1000),
w AS (SELECT query_id, t AS query, equipment_tags AS target_equipment, plant_units AS target_units, e2.standards AS target_standards, coalesce({_s_intents()}[1], 'informational') AS intent, 'src' || ((query_id - 1000) % 20) AS target_document, CAST((query_id - 1000) % 50 AS INTEGER) AS target_page FROM l e2),
h AS (SELECT item_id + 1000 AS query_id, 'x' || doc_id AS chunk_id, round(score, 6) AS score FROM hits WHERE rank < 10),
c AS (SELECT h.query_id, h.chunk_id, h.score, w.* EXCLUDE (query_id), k.* EXCLUDE (chunk_id, score) FROM h JOIN w USING (query_id) JOIN chunk_rows k ON k.chunk_id = h.chunk_id), o AS (SELECT f.query_id, f.chunk_id, k.score, v.* EXCLUDE (query_id), k.* EXCLUDE (chunk_id, score) FROM fx_candidates f JOIN fx_wanted v USING (query_id) JOIN fx_chunks k ON k.chunk_id = f.chunk_id),
u AS (SELECT {columns} FROM c UNION ALL SELECT {columns} FROM o), b AS (SELECT query_id, chunk_id, round(greatest(0.0::DOUBLE, score + {" + ".join(parts)}), 6) AS score FROM u)
SELECT CAST(query_id AS INTEGER) AS query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS INTEGER) AS rank FROM b"""


@query(_s_boost())
def metadata_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir)
    scored = rows.select("query_id", "chunk_id", F.round(ranking.boosted(F.col("score"), {n: F.col(n) for n in BOOSTED[3:]}), 6).alias("score"))
    return lexical.top_k(scored, "query_id", "score", "chunk_id", 99)


@query(
    f"""WITH {fixtures.CHUNK_ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, chunk_id) AS pos FROM chunk_rows), f AS (SELECT *, row_number() OVER (PARTITION BY category, document_id, page, section ORDER BY pos) AS n FROM r)
SELECT chunk_id, format('[{{}}]', row_number() OVER (PARTITION BY category ORDER BY pos)) AS anchor, CASE WHEN length(content) > 60 THEN substr(content, 1, 60) || '...' ELSE content END AS quote, round(score, 4) AS score FROM f WHERE n = 1"""
)
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each category as the hits of one query; only their quotes travel, and the first of a place is told before categories meet."""
    score, quote = F.col("score"), F.when(F.length("content") > 60, F.concat(F.substring("content", 1, 60), F.lit("..."))).otherwise(F.col("content"))
    place = F.struct(score.isNull().alias("none"), (-score).alias("down"), "chunk_id")
    rows = fixtures.chunk_rows(spark, sf_dir).select(F.col("category").alias("query_id"), "document_id", "page", "section", "chunk_id", quote.alias("quote"), "score", place.alias("pos"))
    first = ranking.first_citations(rows, "query_id", "pos", ["document_id", "page", "section"])
    return first.select("chunk_id", "anchor", "quote", F.round("score", 4).alias("score"))


@query(
    f"""WITH {fixtures.CHUNK_ROWS} SELECT chunk_id, CASE WHEN regexp_matches(x, 'p&id|pid_') THEN 'refinery_pid' WHEN regexp_matches(x, 'drawing') THEN 'refinery_drawings' WHEN len(standards) > 0 OR regexp_matches(x, 'safety|oisd') THEN 'refinery_safety' WHEN regexp_matches(x, 'inspection') THEN 'refinery_inspection'
WHEN regexp_matches(x, 'maintenance') THEN 'refinery_maintenance' WHEN regexp_matches(x, 'sop|procedure') THEN 'refinery_sops' WHEN regexp_matches(x, 'email') THEN 'refinery_emails' WHEN regexp_matches(x, 'manual') THEN 'refinery_manuals' ELSE 'refinery_general' END AS collection
FROM (SELECT *, lower(coalesce(category, '') || ' ' || coalesce(document_name, '')) AS x FROM chunk_rows)"""
)
def collection_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.chunk_rows(spark, sf_dir).select("chunk_id", vectors.route(F.col("standards"), F.col("category"), F.col("document_name")).alias("collection"))


@query(f"WITH {SEARCH} SELECT item_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM hits WHERE rank < 10")
def bm25_pruned_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by bounds first: only ranges that may hold one of a query's ten best are scored."""
    from ..sources.tables import scratch

    index = lexical.build(read(spark, sf_dir, "documents"), "doc_id", "text", scratch(spark, "bm25"))
    return lexical.search_index(index, read(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text", 10, 6, True)


AMENDED = "(SELECT doc_id, CASE WHEN lang = 'de' THEN text || ' pump P-203 amended' ELSE text END AS text FROM documents WHERE source <> 'src3' OR lang = 'es')"


@query(f"WITH {SEARCH.replace('FROM documents', 'FROM ' + AMENDED)} SELECT item_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM hits WHERE rank < 10")
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages over an index that took all documents but French ones; then changed German and new French ones, less a source; then Spanish ones of that source again, and a compaction."""
    from ..operators.incremental import LexicalIndex
    from ..sources.tables import scratch

    docs = read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "key")
    changed = docs.withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit(" pump P-203 amended"))).otherwise(F.col("text")))
    index = LexicalIndex(spark, scratch(spark, "lexical"))
    index.apply(docs.where("lang <> 'fr'").select("key", "text"))
    index.apply(changed.where("lang IN ('de', 'fr') AND source <> 'src3'").select("key", "text"), docs.where("source = 'src3'").select("key"))
    index.compact()
    index.apply(docs.where("source = 'src3' AND lang = 'es'").select("key", "text"), docs.where("source = 'src3' AND lang = 'de'").select("key"))
    return index.search(read(spark, sf_dir, "benchmark"), "item_id", "text", 10, 6).withColumnRenamed("key", "doc_id")


def _lists(spark: SparkSession, sf_dir: str) -> str:
    from ..sources.tables import scratch

    path = scratch(spark, "lists")
    vectors.build_lists(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", path)
    return path


@query(f"WITH {KNN}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM n) SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank < 10")
def vector_lists_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All inverted lists, for the same queries."""
    asked_ = read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")
    return vectors.search_lists(spark, _lists(spark, sf_dir), asked_, "vec_id", "embedding", 10, exact=True, digits=5)


@query("SELECT count(*) AS n_queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def vector_lists_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the nearest lists hold at least 0.95 of each query's ten nearest, taken together."""
    asked_, path = read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0"), _lists(spark, sf_dir)
    some = vectors.search_lists(spark, path, asked_, "vec_id", "embedding", 10, digits=5).select("query_id", "vec_id", F.lit(1).alias("found"))
    every = vectors.search_lists(spark, path, asked_, "vec_id", "embedding", 10, exact=True, digits=5)
    met = every.join(some, ["query_id", "vec_id"], "left")
    return met.agg(F.countDistinct("query_id").alias("n_queries"), (F.count("found") >= 0.95 * F.count("*")).alias("enough"))
