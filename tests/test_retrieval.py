"""Stored BM25 indexes, ties of vectors, hybrid results, requests, batches that come twice."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions import intents
from quarry.functions import text as tx
from quarry.operators import audit, hybrid, lexical, vectors
from quarry.operators.incremental import LexicalIndex
from quarry.streaming.ingest import ingest

WORDS = ["pump", "valve", "P-203", "pressure", "of", "the", "tower", "leak", "API-610", "x_y"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    return spark.createDataFrame([*rows, (200, None), (201, "É-1 a-b_c ß Ab")], "id long, text string").repartition(3)


def test_postings_count_the_tokens_of_the_expression(corpus):
    got = {(r.id, r.term): (r.tf, r.doc_len) for r in lexical.postings(corpus, "id", "text").collect()}
    want = {}
    for r in corpus.select("id", tx.tokens(F.coalesce("text", F.lit(""))).alias("a")).collect():
        for t in r.a:
            want[r.id, t] = (r.a.count(t), len(r.a))
    assert got == want


def test_stored_index_searches_alike(spark, corpus, tmp_path):
    asked = spark.createDataFrame([(1, "pressure of the pump P-203"), (2, "leak leak tower"), (3, "nothing known")], "q int, t string")
    lexical.build(corpus, "id", "text", f"file://{tmp_path}/i")
    stored = lexical.search_index(lexical.load(spark, f"file://{tmp_path}/i"), asked, "id", "q", "t", 7, 6).collect()
    direct = lexical.search(corpus, asked, "id", "text", "q", "t", 7, 6).collect()
    assert sorted(map(tuple, stored)) == sorted(map(tuple, direct)) and {r.q for r in stored} == {1, 2}
    assert all(sum(r.q == q for r in stored) == 7 for q in (1, 2))


def test_equal_vectors_are_ranked_by_key(spark):
    rows = [(i, [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    got = vectors.nearest(df, df.where("id in (4, 9)"), "id", "v", 6, digits=5).orderBy("query_id", "rank").collect()
    assert [r.id for r in got if r.query_id == 4] == [1, 2, 4, 5, 7, 8] and [r.id for r in got if r.query_id == 9] == [0, 3, 6, 9, 12, 15]
    assert np.allclose([r.score for r in got], 1)


@pytest.mark.parametrize("large", [audit.LARGE, 100])
def test_ranks_in_buckets(spark, monkeypatch, large):
    monkeypatch.setattr(audit, "LARGE", large)
    rng = random.Random(3)
    rows = [("hot" if i % 10 else None, rng.choice([1.0, 2.0, rng.random() * 9]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double, t int").repartition(4)
    got = {r.t: r.rank for r in audit.ranked_in(df, "k", "v", "t", "rank").collect()}
    for key in ("hot", None):
        own = sorted((v, t) for k, v, t in rows if k == key)
        assert [got[t] for _, t in own] == list(range(len(own)))


def test_hybrid_results(spark):
    texts = [f"The {w} number {i} runs at {i} bar and needs care" for i, w in enumerate(["pump P-203", "valve MOV-101", "tower", "pump P-204", "boiler", "drum V-12"] * 4)]
    chunks = spark.createDataFrame([(1000 + i, f"d{i % 6}", i // 6, t, ["P-203"] if "P-203" in t else []) for i, t in enumerate(texts)], "cid long, document string, index int, content string, equipment array<string>")
    asked = spark.createDataFrame([(1, "What is the pressure of P203?"), (2, "compare boiler and tower"), (3, "")], "query_id long, text string")
    found = hybrid.hybrid(chunks, asked, k=5, budget=200)
    hits = found.hits.collect()
    assert {r.query_id for r in hits} >= {1, 2} and all(0 <= r.score <= 1 for r in hits)
    one = sorted((r for r in hits if r.query_id == 1), key=lambda r: r.rank)
    assert "P-203" in one[0].content and one[0].anchor == "[1]"
    assert len({(r.query_id, r.cid) for r in hits}) == len(hits)
    for r in hits:
        assert all(r.anchor == s.anchor for s in hits if (s.query_id, s.document) == (r.query_id, r.document))
    contexts = {r.query_id: r for r in found.contexts.collect()}
    assert contexts[1].n_tokens <= 200 and contexts[1].context.startswith("### Context")
    assert all(r.duplicates == 0 for r in found.problems.collect())
    adaptive = hybrid.adaptive(chunks, asked).hits.collect()
    assert {r.query_id for r in adaptive} >= {1, 2}


@pytest.mark.parametrize(
    ("text", "operation", "archetype", "artifact"),
    [("Draft an email summarizing hot work rules for the site safety team", "summarize", "email", None), ("Create a PDF report on pumps", "generate_document", "report", "pdf"), ("Generate an image of a tower", "generate_image", "general_qa", "png"), ("Compare A versus B", "compare", "comparison", None), ("", "answer", "general_qa", None), (None, "answer", "general_qa", None)],
)
def test_tasks(spark, text, operation, archetype, artifact):
    r = spark.createDataFrame([(text,)], "t string").select(intents.task(F.col("t")).alias("x")).first().x
    assert (r.operation, r.archetype, r.artifact) == (operation, archetype, artifact)
    assert (r.recipient == "Site Safety Team") == (operation == "summarize")


def test_a_stream_follows_changes_and_deletions(spark, tmp_path):
    """Changed texts are indexed anew, deleted documents go, and the same stream read once more changes nothing."""
    schema = "doc_id long, text string, dropped boolean"
    batches = [[(1, "pump one", None), (2, "valve two", False), (2, "valve two again", None), (4, "boiler", None)], [(2, "tower P-203", None), (3, "drum V-12", False), (4, None, True), (1, "pump one", None)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    out = f"file://{tmp_path}/index"
    for check in ("a", "b"):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        ingest(stream, "doc_id", "text", out, f"{tmp_path}/check-{check}", "dropped").awaitTermination()
        index = LexicalIndex(spark, out)
        asked = spark.createDataFrame([(1, "valve boiler tower pump")], "q int, t string")
        assert {r.key for r in index.search(asked, "q", "t").collect()} == {1, 2}
        assert {r.key: r.text for r in index.table("documents").collect()} == {1: "pump one", 2: "tower P-203", 3: "drum V-12"}
        assert {(r.key, r.tag) for r in index.table("entities").collect()} == {(2, "P-203"), (3, "V-12")}
        assert sorted(r.key for r in index.table("chunks").collect()) == [1, 2, 3]


def test_results_from_the_cache(spark, tmp_path, monkeypatch):
    texts = [f"The {w} number {i} runs at {i} bar and needs care" for i, w in enumerate(["pump P-203", "valve MOV-101", "tower", "boiler"] * 5)]
    chunks = spark.createDataFrame([(i, f"d{i % 4}", i // 4, t) for i, t in enumerate(texts)], "cid long, document string, index int, content string")
    asked = spark.createDataFrame([(1, "pump pressure"), (2, " Pump PRESSURE"), (3, "boiler care")], "query_id long, text string")
    path, at = f"file://{tmp_path}/cache", F.lit("2024-01-01 00:00:00")
    key = lambda df: sorted((r.query_id, r.rank, r.cid, r.score) for r in df.collect())
    first, origin = hybrid.cached(chunks, asked.where("query_id < 3"), path, 60, at, k=5)
    plain = key(hybrid.hybrid(chunks, asked, k=5).hits)
    assert not any(r.from_cache for r in origin.collect())
    assert [x[1:] for x in key(first) if x[0] == 1] == [x[1:] for x in key(first) if x[0] == 2] == [x[1:] for x in plain if x[0] == 1]
    both, origin = hybrid.cached(chunks, asked, path, 60, at, k=5)
    assert {r.query_id: r.from_cache for r in origin.collect()} == {1: True, 2: True, 3: False}
    assert [x for x in key(both) if x[0] == 3] == [x for x in plain if x[0] == 3]
    real = hybrid.hybrid
    monkeypatch.setattr(hybrid, "hybrid", lambda *a, **k: pytest.fail("computed again"))
    again, origin = hybrid.cached(chunks, asked, path, 60, at, k=5)
    assert key(again) == key(both) and all(r.from_cache for r in origin.collect())
    monkeypatch.setattr(hybrid, "hybrid", real)
    _, origin = hybrid.cached(chunks, asked, path, 60, F.lit("2024-01-01 00:02:00"), k=5)
    assert not any(r.from_cache for r in origin.collect())


def test_scores_are_held_in_blocks(monkeypatch):
    """Many queries over a large batch: no block of scores follows their product, and the best are those of the whole product."""
    rng = np.random.default_rng(4)
    rows, shapes, real = rng.normal(size=(10_000, 8)), [], vectors._likeness
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    asked = rows[::4]
    monkeypatch.setattr(vectors, "_likeness", lambda q, r, m: shapes.append((len(q), len(r))) or real(q, r, m))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(list(rows))], names=["id", "v"])
    out = pa.Table.from_batches(vectors._scan(iter([batch]), np.arange(len(asked)), asked, None, "id", 3, "cosine", 5))
    assert max(q * r for q, r in shapes) <= vectors.QUERIES * vectors.PART
    score = np.round(asked @ rows.T, 5)
    want = {(i, int(j)) for i, s in enumerate(score) for j in np.lexsort((np.arange(10_000), -s))[:3]}
    assert {(r["query_id"], r["id"]) for r in out.to_pylist()} == want
