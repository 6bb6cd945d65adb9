"""What plans carry through windows and shuffles."""

import hashlib
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking, embedding, incremental, indexing, lexical
from quarry.queries import QUERIES
from quarry.sources.transactions import Store

SF = "/root/testdata/sf0.001"


def nodes(plan):
    i = 0
    while (node := plan.apply(i)) is not None:
        yield node.nodeName(), {node.output().apply(k).name() for k in range(node.output().size())}
        i += 1


@pytest.mark.parametrize("name", ["citations", "text_similarity"])
def test_no_text_goes_through_a_window(spark, name):
    """A category or source may hold a large share of all texts, and a window holds its rows in one task."""
    found = [names for kind, names in nodes(QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan()) if kind == "Window"]
    assert found and not any(names & {"content", "text", "t"} for names in found)


@pytest.mark.parametrize("name", ["evidence_sufficiency", "lexical_rerank"])
def test_few_hits_meet_the_texts_without_a_shuffle(spark, name):
    at = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")  # less than the texts, more than the hits
    try:
        found = [names for kind, names in nodes(QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan()) if kind == "SortMergeJoin"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", at)
    assert not any(names & {"content", "text", "terms"} for names in found)


def test_windows_split_a_text_once(spark):
    """A filter on the number of words split each text a second time."""
    df = spark.createDataFrame([(1, "a b"), (2, " "), (3, None)], "doc_id long, text string")
    rows = chunking.word_windows(df, "doc_id", "text").select("doc_id", "content")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [tuple(r) for r in rows.collect()] == [(1, "a b")]


def test_hash_vectors_of_null_and_long_texts(spark):
    df = spark.createDataFrame([("a" * 100_000,), (None,), ("é😀",)], "t string")
    got = [r[0] for r in df.select(embedding.hash_vector(F.col("t"), 12)).collect()]
    assert got[1] == [None] * 12
    for t, v in ((df.first().t, got[0]), ("é😀", got[2])):
        raw = [x / 2**31 for s in range(2) for x in struct.unpack("<8i", hashlib.sha256(f"local_embedder:{t}:{s}".encode()).digest())][:12]
        norm = math.sqrt(sum(x * x for x in raw))
        assert np.allclose(v, [x / norm for x in raw], rtol=1e-15)


def test_both_runs_of_a_cache_search_one_index(spark, monkeypatch):
    built = []
    build = lexical.build
    monkeypatch.setattr(lexical, "build", lambda *a, **b: built.append(1) or build(*a, **b))
    assert QUERIES["cached_retrieve"](spark, SF).count() > 0
    assert len(built) == 1


def test_a_folder_of_terms_has_one_file(spark, tmp_path):
    """Every task wrote a file in every folder."""
    index = incremental.LexicalIndex(spark, f"file://{tmp_path}/index")
    index.apply(spark.range(400).select(F.col("id").alias("key"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text")).repartition(4))
    files = [p.parent.name for p in tmp_path.rglob("docs/kb=*/*.parquet")]
    assert len(files) == len(set(files)) > 30


def test_points_that_are_all_known_are_not_written(spark, tmp_path):
    """Points met their hashes through a shuffle, and an empty table was written, though nothing had changed."""
    store = Store(spark, f"file://{tmp_path}/points")
    columns = "chunk_id string, document_id string, document_name string, page int, section string, content string, chunk_index int, category string, plant_unit string, equipment array<string>, standards array<string>, vector array<double>"
    points = spark.createDataFrame([("c1", "d", "n", 1, "s", "text", 0, "manuals", "u", [], [], [0.6, 0.8])] * 2, columns)
    assert indexing.index_points(store, points, 2) == {"new": 1, "rejected": 0}
    assert indexing.index_points(store, points, 2) == {"unchanged": 1, "rejected": 0}
    assert len(list(tmp_path.rglob("data/*/points"))) == 1 and indexing.stored_points(store).count() == 1
