"""Every operator on a text of several hundred thousand words beside short ones, and mixing by size."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import licenses, mixing, order_minhash, packing, quality_rules, secrets, simhash, substring_dedup, token_counts, tokens, warc

SECRET = "q7Zp0xV9mK2sLwT4bN8cRt5Yh1Jd"


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(1)
    words = [f"{rng.choice(['alpha', 'beta', 'gamma', 'token'])}{rng.randrange(10**6)}" for _ in range(300_000)]
    words[150_000:150_000] = ["the", "private", "key", SECRET, "is", "here"]
    return " ".join(words) + " " + licenses.TEMPLATES["isc"]


@pytest.fixture(scope="module")
def docs(spark, long_text):
    shared = " ".join(long_text.split(" ")[200_000:200_040])
    rows = [(1, "short text", "a"), (2, long_text, "b"), (3, "before " + shared + " after", "a"), (4, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))


def row(df, doc_id=2):
    return df.where(F.col("doc_id") == doc_id).collect()


def test_texts_are_taken_whole(docs, long_text):
    n = len(long_text.split(" "))
    assert row(quality_rules.quality_rules(docs))[0].n_words == n
    spans = row(secrets.secret_scan(docs))[0].spans
    at = long_text.index(SECRET)
    assert f"novel:{at}:{at + len(SECRET)}" in spans.split(",")
    assert row(licenses.license_scan(docs))[0].licenses.split(",")[-1] == "isc"
    cut = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    assert cut[2].n_words == n and cut[2].n_removed == 0 and cut[3].n_removed == 40
    assert row(simhash.near_duplicates(docs))[0].fp % 2**64 == simhash.fingerprint(long_text) % 2**64
    ids = tokens.encode([long_text], tokens.vocabulary_path())[0]
    pieces = row(packing.best_fit_packing(docs))
    assert sum(r.length for r in pieces) == len(ids) // 4 + 1 and max(r.length for r in pieces) == 2048
    counts = row(token_counts.edited_counts(token_counts.with_revision(docs)))[0]
    assert counts.n_tokens == len(ids) // 4 and counts.chars_reencoded < 3000


def test_order_minhash_of_a_long_text(spark, long_text):
    half = len(long_text) // 2
    df = spark.createDataFrame([(long_text, long_text[half:] + " " + long_text[:half])], "x string, y string")
    same, turned = df.select(order_minhash.likeness(order_minhash.fingerprint(F.col("x")), order_minhash.fingerprint(F.col("x"))), order_minhash.likeness(order_minhash.fingerprint(F.col("x")), order_minhash.fingerprint(F.col("y")))).first()
    assert same == 1 and 0.2 < turned < 0.9  # the halves changed places: about half the pairs of each bin change their order


def test_warc_of_a_long_page(spark, long_text):
    df = spark.createDataFrame([(1, "u", long_text * 3), (2, "v", long_text * 3), (3, "w", "x")], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert got[1].payload_bytes == 3 * len(long_text) and got[1].valid and got[2].refers_to == 1 and got[2].payload_bytes == got[1].payload_bytes


def test_mixing_by_size(spark):
    """Blocks hold about as much of the size column, whatever the rows, and a long row leaves slots to itself."""
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.choice([1, 5, 40, 700])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(df, {"a": 3, "b": 1}, block=100, size="size").collect()
    assert sorted(r.doc_id for r in got) == list(range(600))
    size = {i: n for i, _, n in rows}
    for stream in "ab":
        mine = sorted((r.mix_slot, r.mix_place, r.doc_id, r.mix_block) for r in got if r.mix_stream == stream)
        at = 0
        for _, _, doc, block in mine:
            assert block == at // 100
            at += size[doc]
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
