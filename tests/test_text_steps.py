"""Text steps take time in proportion to a text, whatever its words and lines are like."""

import time

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import candidates, parsing

BLANK_PAIR = [c + c for c in tx.BLANKS]


def timed(df):
    start = time.monotonic()
    rows = df.collect()
    return rows, time.monotonic() - start


def test_sentences_that_end_in_a_long_word(spark):
    """Each sentence is one word of 60,000 characters: a search from each of its characters to its end took minutes."""
    word = "x" * 60_000
    df = spark.range(4).select(F.lit(". A".join([word] * 6)).alias("t"))
    rows, took = timed(df.select(F.size(tx.sentences(F.col("t"))).alias("n")))
    assert [r.n for r in rows] == [6] * 4
    assert took < 20


def test_sentences_stay_open_after_abbreviations_and_numbers(spark):
    text = "See APPROX. Five. It was equip. Then xequip. Next fig. 2) no. 7. Part a12. B 12. C 3_4. D P&ID. End."
    got = spark.range(1).select(tx.sentences(F.lit(text)).alias("s")).first().s
    assert got == ["See APPROX. Five.", "It was equip. Then xequip.", "Next fig. 2) no. 7. Part a12.", "B 12. C 3_4.", "D P&ID. End."]


def test_a_footer_below_a_long_line(spark):
    """The last line is found from the end: a line of 200,000 characters above it took minutes."""
    long = "y" * 200_000
    df = spark.createDataFrame([("d", i, f"HEAD\n{long}\nPage {i}") for i in range(4)], "doc string, pos int, t string")
    rows, took = timed(parsing.without_headers(df, "doc", "pos", "t"))
    assert {r.cleaned for r in rows} == {long}
    assert took < 20


def test_a_section_that_is_its_own_footer(spark):
    df = spark.createDataFrame([("d", 1, "Page 1"), ("d", 2, "same\nPage 2"), ("d", 3, "same\n\n \nbody\r\nPage 3\n"), ("d", 4, "")], "doc string, pos int, t string")
    got = {r.pos: r.cleaned for r in parsing.without_headers(df, "doc", "pos", "t").collect()}
    assert got == {1: "Page 1", 2: "", 3: "body", 4: ""}


def test_strip_and_words_are_pythons(spark):
    texts = ["", "　", *[f"{b}a{b}b{b}" for b in BLANK_PAIR], "​é⁠", "中文 字", "ab"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = df.select("t", tx.strip(F.col("t")).alias("s"), tx.count_words(F.col("t")).alias("n")).collect()
    assert [(r.s, r.n) for r in got if r.t is not None] == [(t.strip(), len(t.split())) for t in texts]
    assert [(r.s, r.n) for r in got if r.t is None] == [(None, None)]
    plan = df.select(tx.strip(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan  # a pattern is tried at each character


def test_similarity_counts_whole_characters(spark):
    """Characters beyond 16 bits were counted by halves, and never met."""
    df = spark.createDataFrame([("😀a", "😀b"), ("", ""), ("x", None)], "a string, b string")
    assert [r[0] for r in df.select(candidates.quick_ratio(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, None]
