"""Evidence, citations and grounding of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.queries import TAG, search_tokens
from ..functions.text import sentences, strip
from .evaluation import anchors

MIN_OVERLAP, MIN_SCORE, GROUNDED = 0.25, 0.22, 0.85


def term_overlap(q: Column, source: Column) -> Column:
    """Share of query terms that equal a source term, are a prefix of one or it of them, or share four first letters."""
    same = lambda t, s: (t == s) | s.startswith(t) | t.startswith(s) | (F.length(t) > 3) & (F.length(s) > 3) & (F.substring(t, 1, 4) == F.substring(s, 1, 4))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.filter(q, lambda t: F.exists(source, lambda s: same(t, s)))) / F.size(q))


def sufficient(hits: DataFrame, by: str) -> DataFrame:
    """by, overlap, top_score, sufficient from hits with q_terms, terms, score, rank: the three best decide."""
    top = hits.where("rank < 3").withColumn("o", term_overlap(F.col("q_terms"), F.col("terms")))
    s = top.groupBy(by).agg(F.max("o").alias("overlap"), F.max("score").alias("top_score"), F.max(F.size("q_terms")).alias("n"))
    ok = F.when(F.col("n") == 0, F.col("top_score") >= 0.65).otherwise((F.col("overlap") >= MIN_OVERLAP) & ((F.col("top_score") >= MIN_SCORE) | (F.col("overlap") >= 0.5)))
    return s.select(by, "overlap", "top_score", ok.alias("sufficient"))


def check_citations(answers: DataFrame, answer: str, valid: str) -> DataFrame:
    """Adds cited, phantom (anchors that are not valid) and precision."""
    found = anchors(F.col(answer))
    share = F.when(F.size("cited") == 0, 0.0).otherwise(F.size(F.array_intersect("cited", valid)) / F.size("cited"))
    return answers.withColumn("cited", found).withColumn("phantom", F.array_except("cited", valid)).withColumn("precision", share)


def grounding(answer: Column, context: Column) -> Column:
    """Share of the tags and numbers in an answer that its context has; 1 if it has none."""
    found = F.array_distinct(F.concat(F.regexp_extract_all(answer, F.lit(TAG), 0), F.regexp_extract_all(answer, F.lit(r"\d+(?:\.\d+)?"), 0)))
    bare = lambda c: F.lower(F.regexp_replace(c, "[-_ ]", ""))
    held = F.filter(found, lambda e: F.contains(bare(context), bare(e)))
    return F.when(F.size(found) == 0, 1.0).otherwise(F.size(held) / F.size(found))


def first_lines(text: Column) -> Column:
    """The text without lines of over 15 characters that, case and blanks apart, came before; headings stay."""
    bare = lambda x: F.lower(F.regexp_replace(F.trim(x), r"\s+", " "))
    # sorted by what is compared, then place: repeats follow each other
    items = F.transform(F.split(text, "\n"), lambda x, i: F.struct(bare(x).alias("b"), i.alias("i"), x.alias("x")))
    again = lambda s, y, j: (j > 0) & (F.get(s, j - 1)["b"] == y["b"]) & (F.length(y["b"]) > 15) & ~F.startswith(y["b"], F.lit("#"))
    kept = F.transform(F.array(F.array_sort(items)), lambda s: F.filter(s, lambda y, j: ~F.coalesce(again(s, y, j), F.lit(False))))[0]
    return F.array_join(F.transform(F.array_sort(F.transform(kept, lambda y: F.struct(y["i"].alias("i"), y["x"].alias("x")))), lambda y: y["x"]), "\n")


def without_references(text: Column) -> Column:
    return strip(F.split(text, r"(?im)^\s*(?:#+\s*|\*\*)?(?:references|sources|citations)\s*:?(?:\*\*)?\s*$", 2)[0])


def extracted_answer(rows: DataFrame, by: str, question: str, context: str, k: int = 3) -> DataFrame:
    """by, place, sentence: the k sentences (15 characters or more) that share most with the question."""
    from .lexical import top_k

    split = rows.select(by, search_tokens(F.col(question)).alias("q"), F.posexplode(sentences(F.col(context))).alias("pos", "sentence")).where(F.length("sentence") >= 15)
    low = F.lower("sentence")
    score = F.size(F.array_intersect("q", search_tokens(F.col("sentence")))) + F.size(F.filter("q", lambda t: F.contains(low, t)))
    best = top_k(split.withColumn("score", score), by, "score", "pos", k)
    return best.select(by, F.col("rank").alias("place"), "sentence", "score")
