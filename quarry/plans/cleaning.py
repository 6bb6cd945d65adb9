"""Cleaning and counting over all documents and the awkward inline texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from .fixtures import literal as q
from .registry import TEXTS, query, texts


def sub(t: str, pattern: str, put: str) -> str:
    """regexp_replace of all matches in DuckDB; $n groups become \\n."""
    return f"regexp_replace({t}, {q(pattern)}, {q(re.sub(r'[$]([0-9])', lambda m: chr(92) + m[1], put))}, 'g')"


def s_strip(t: str) -> str:
    return sub(t, tx.STRIP, "")


def s_lines(t: str) -> str:
    return f"(CASE WHEN regexp_split_to_array({t}, {q(tx.LINE_BREAK)})[-1] = '' THEN regexp_split_to_array({t}, {q(tx.LINE_BREAK)})[:-2] ELSE regexp_split_to_array({t}, {q(tx.LINE_BREAK)}) END)"


def s_encoding(t: str) -> str:
    return f"replace(translate({sub(sub(t, tx.CONTROL, ''), tx.ZERO_WIDTH, '')}, {q(tx.CURLY)}, {q(tx.STRAIGHT)}), '…', '...')"


def s_words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, {q('[' + tx.WS + ']+')}), lambda w: w <> '')"


def s_tokens(t: str) -> str:
    return f"flatten(list_transform(regexp_extract_all({t}, {q('[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*')}), lambda x: CASE WHEN regexp_matches(x, '[-_]') THEN list_concat([lower(x)], regexp_split_to_array(lower(x), '[-_]+')) ELSE [lower(x)] END))"


def s_hyphens(t: str) -> str:
    return f"replace({sub(sub(t, chr(92) + 'b(' + tx.KEPT_PREFIX + ')' + tx.HYPHEN, '$1' + tx.HELD + '$2'), chr(92) + 'b([A-Za-z]{2,})' + tx.HYPHEN, '$1$2')}, {q(tx.HELD)}, '-')"


def _cleaned(f) -> object:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return texts(spark, sf_dir).select("doc_id", f(F.col("text")).alias("cleaned"))

    return run


def _register(name: str, f, sql: str) -> None:
    run = _cleaned(f)
    run.__name__ = name
    query(f"WITH {TEXTS} SELECT doc_id, {sql} AS cleaned FROM texts")(run)


_register("clean_encoding", tx.fix_encoding, s_encoding("text"))
_register("clean_line_ends", tx.fix_line_ends, s_strip(sub(sub("text", "\r\n?", "\n"), "\n{3,}", "\n\n")))
_register("clean_whitespace", tx.squeeze_lines, f"array_to_string(list_transform({s_lines('text')}, lambda x: {s_strip(sub('x', tx.HWS, ' '))}), chr(10))")
_register("clean_hyphens", tx.join_hyphens, s_hyphens("text"))
_register("clean_bullets", tx.fix_bullets, sub("text", tx.BULLET, "$1- "))
_register("clean_lists", tx.fix_lists, sub(sub("text", tx.NUMBERED, "$1$2$3$4. "), tx.NUMBER_GAP, "$1 "))


def s_paragraphs(t: str) -> str:
    """join_paragraph_lines as one fold over the text made so far, whose last line an item joins or not."""
    block = lambda x: f"(regexp_matches({x}, '^#{{1,6}}\\s') OR regexp_matches({x}, '^\\d+(?:\\.\\d+)*\\s+[A-Z]') AND NOT suffix({x}, '.') AND length({x}) < 80 OR regexp_matches({x}, '^\\|.*\\|$'))"
    last = "regexp_extract(made, '[^\\n]*$')"
    apart = f"{block(last)} OR {block('x')} OR regexp_matches(x, '^(?:[-*•]|\\d{{1,4}}[.)])\\s+') OR regexp_matches({last}, '[.?!:;-]$') OR regexp_matches({last}, '[.?!]\"$')"
    rows = f"list_filter(list_transform(string_split(p, chr(10)), lambda r: {s_strip('r')}), lambda r: r <> '')"
    fold = f"CASE WHEN len({rows}) = 0 THEN '' ELSE list_reduce({rows}, lambda made, x: made || CASE WHEN {apart} THEN chr(10) ELSE ' ' END || x) END"
    return f"array_to_string(list_filter(list_transform(string_split({t}, chr(10) || chr(10)), lambda p: {fold}), lambda p: p <> ''), chr(10) || chr(10))"


def s_steps(*steps: str) -> str:
    """CTEs k0, k1, ...: each step over the column t of the one before."""
    return ", ".join(f"k{i} AS (SELECT doc_id, text, {step} AS t FROM {f'k{i - 1}' if i else 'texts'})" for i, step in enumerate(steps))


CLEAN_STEPS = (
    s_encoding("text"),
    f"array_to_string(list_transform({s_lines('t')}, lambda x: {s_strip(sub('x', tx.HWS, ' '))}), chr(10))",
    s_strip(sub(sub("t", "\r\n?", "\n"), "\n{3,}", "\n\n")),
    s_paragraphs("t"),
    s_hyphens("t"),
    sub("t", tx.BULLET, "$1- "),
    sub(sub("t", tx.NUMBERED, "$1$2$3$4. "), tx.NUMBER_GAP, "$1 "),
)


@query(f"WITH {TEXTS}, {s_steps(*CLEAN_STEPS)} SELECT doc_id, t AS cleaned, CAST(length(text) AS BIGINT) AS chars_before FROM k6")
def clean_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text stages in order, and the characters before and after."""
    rows = texts(spark, sf_dir)
    return rows.select("doc_id", tx.clean(F.col("text")).alias("cleaned"), F.length("text").cast("long").alias("chars_before"))


@query(f"WITH {TEXTS} SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 1.0 ELSE length({sub('text', r'[^\x00-\x7F]', '')}) / length(text) END, 6) AS share, (CASE WHEN length(text) = 0 THEN 1.0 ELSE length({sub('text', r'[^\x00-\x7F]', '')}) / length(text) END) >= 0.8 AS mostly_ascii FROM texts")
def ascii_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = tx.ascii_share(F.col("text"))
    return texts(spark, sf_dir).select("doc_id", F.round(share, 6).alias("share"), (share >= 0.8).alias("mostly_ascii"))


@query(
    f"""WITH {TEXTS}, c AS (SELECT doc_id, text, len({s_words("text")}) AS n FROM texts)
SELECT doc_id, CAST(len(regexp_extract_all(text, {q(tx.TOKEN)})) AS BIGINT) AS tok_regex, CAST(greatest(n, ceil(length({s_strip("text")}) / 4)) AS BIGINT) AS tok_retrieval,
CAST(greatest(1, floor(length(text) / 4)) AS BIGINT) AS tok_prompt, CAST(CASE WHEN n = 0 THEN 0 ELSE greatest(1, round_even((length(text) / 4 + n * 1.33::DOUBLE) / 2, 0)) END AS BIGINT) AS tok_loader FROM c"""
)
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.parsing import estimates

    return estimates(texts(spark, sf_dir), "doc_id", F.col("text"))


@query(f"WITH {TEXTS} SELECT doc_id, CAST(len({s_tokens('text')}) AS BIGINT) AS n_tokens, array_to_string({s_tokens('text')}, ' ') AS tokens FROM texts")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.tokens(F.col("text"))
    return texts(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query(f"WITH {TEXTS} SELECT doc_id, sha256({s_strip('text')}) AS content_hash, CAST(length(text) AS BIGINT) AS n_chars, CAST(len({s_words('text')}) AS BIGINT) AS n_words FROM texts")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return texts(spark, sf_dir).select("doc_id", tx.content_hash(t).alias("content_hash"), F.length(t).cast("long").alias("n_chars"), tx.count_words(t).cast("long").alias("n_words"))


def _exploded(name: str, f, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return texts(spark, sf_dir).select("doc_id", F.posexplode(f(F.col("text"))).alias("pos", "part")).select("doc_id", F.col("pos").cast("long"), "part")

    run.__name__ = name
    query(f"WITH {TEXTS}, p AS (SELECT doc_id, {sql} AS parts FROM texts) SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS part FROM p" if sql else None)(run)


def _trimmed(split: str) -> str:
    return f"list_filter(list_transform({split}, lambda x: {s_strip('x')}), lambda x: x <> '')"


_exploded("split_paragraphs", tx.paragraphs, _trimmed(f"regexp_split_to_array(text, {q(chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n')})"))
_exploded("split_list_items", tx.list_items, _trimmed(s_lines("text")))
# a break before a capital, digit, quote or bracket: RE2 looks neither back nor ahead, so a mark is put there first
_MARKED = f"regexp_replace(regexp_replace(text, '([.?!])(\\s+)([A-Z0-9\"''(\\[])', '\\1' || chr(57345) || '\\3', 'g'), '([.?!])(\\s+)([A-Z0-9\"''(\\[])', '\\1' || chr(57345) || '\\3', 'g')"
_OPEN = f"(list_contains({q(list(tx.ABBREVIATIONS))}, lower(regexp_extract(made, '([^{tx.WS}\\x{{e001}}]+)$', 1))) OR regexp_matches(made, '\\b\\d+\\.$'))"
_PARTS = _trimmed(f"string_split({_MARKED}, chr(57345))")
S_SENTENCES = f"CASE WHEN len({_PARTS}) = 0 THEN []::VARCHAR[] ELSE string_split(list_reduce({_PARTS}, lambda made, x: made || CASE WHEN {_OPEN} THEN ' ' ELSE chr(57345) END || x), chr(57345)) END"
_exploded("split_sentences", tx.sentences, S_SENTENCES)


def redacted_sql(t: str) -> str:
    from ..operators.evaluation import CREDENTIALS

    for pattern, put in CREDENTIALS:
        t = sub(t, pattern, put)
    return t

