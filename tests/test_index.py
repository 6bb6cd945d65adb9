"""Pruned search, incremental indexes against fresh ones, transactions stopped at every step, inverted lists of vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import incremental, lexical, vectors
from quarry.operators.incremental import LexicalIndex
from quarry.sources.transactions import Store, Transaction

WORDS = [f"w{i}" for i in range(60)] + ["pump", "valve", "P-203", "leak"]
ASKED = [(1, "pump valve w1 w2"), (2, "P-203 leak leak"), (3, "w5 w6 w7 w8 w9 nothing"), (4, "unknown"), (5, "pump valve")]
SCHEMA = "key long, text string"


def text(rng):
    return " ".join(rng.choices(WORDS, weights=[1 / (i + 1) for i in range(len(WORDS))], k=rng.randint(0, 30)))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(ASKED, "q int, t string")


def hits(found):
    return sorted((r.q, r.rank, r.key, round(r.score, 6)) for r in found.collect())


def fresh(spark, rows, asked, k=7):
    return hits(lexical.search(spark.createDataFrame(sorted(rows.items()), SCHEMA), asked, "key", "text", "q", "t", k, 9))


def test_pruned_search_is_exact_and_reads_less(spark, asked, monkeypatch, tmp_path):
    monkeypatch.setattr(lexical, "RANGE", 8)
    rng = random.Random(2)
    rows = {i: text(rng) for i in range(600)} | {700 + i: "pump valve " * 6 for i in range(8)}
    index = lexical.build(spark.createDataFrame(sorted(rows.items()), SCHEMA), "key", "text", f"file://{tmp_path}/i")
    plain = hits(lexical.search_index(index, asked, "key", "q", "t", 7, 9, False))
    assert plain == hits(lexical.search_index(index, asked, "key", "q", "t", 7, 9, True)) == fresh(spark, rows, asked)
    one = asked.where("q = 5")
    every, read = lexical.blocks_read(index, one, "q", "t", 7)
    assert 0 < read < every / 3


def test_queries_in_several_passes(spark, asked, monkeypatch):
    rng = random.Random(3)
    rows = {i: text(rng) for i in range(50)}
    want = fresh(spark, rows, asked)
    monkeypatch.setattr(lexical, "SMALL", 3)
    assert fresh(spark, rows, asked) == want


def test_any_history_equals_a_fresh_build(spark, asked, tmp_path):
    rng = random.Random(4)
    index, rows = LexicalIndex(spark, f"file://{tmp_path}/index"), {}
    for step in range(5):
        put = {rng.randrange(60): text(rng) for _ in range(25)} | {k: rows[k] for k in list(rows)[:5]}
        drop = [k for k in rng.sample(range(80), 12) if k not in put]
        told = index.apply(spark.createDataFrame([*put.items(), (None, "no key")], SCHEMA), spark.createDataFrame([(k,) for k in drop], "key long"), {"lengths": lambda df: df.select("key", F.length("text").alias("n"))}, batch=step)
        assert told.get("deleted", 0) == sum(k in rows for k in drop) and told.get("new", 0) == sum(k not in rows for k in put) and told.get("unchanged", 0) == sum(rows.get(k) == t for k, t in put.items())
        rows = {k: t for k, t in rows.items() if k not in drop} | put
        if step == 2:
            index.compact()
            assert len(index.segments()) == 1
        assert hits(index.search(asked, "q", "t", 7)) == fresh(spark, rows, asked), step
        assert {r.key: r.n for r in index.table("lengths").collect()} == {k: len(t) for k, t in rows.items()}
    assert index.apply(spark.createDataFrame([(1, "again")], SCHEMA), batch=4) == {}
    df = {r.term: r.df for r in index.index().df.where("df <> 0").collect()}
    want = lexical.postings(spark.createDataFrame(sorted(rows.items()), SCHEMA), "key", "text").groupBy("term").count()
    assert df == {r["term"]: r["count"] for r in want.collect()}
    index.apply(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(k,) for k in rows], "key long"))
    assert hits(index.search(asked, "q", "t", 7)) == [] and index.store.manifest()["n_docs"] == 0


def test_a_batch_reads_its_own_folders(spark, tmp_path):
    index = LexicalIndex(spark, f"file://{tmp_path}/index")
    index.apply(spark.createDataFrame([(i, f"w{i}") for i in range(300)], SCHEMA))
    known = index.known(spark.createDataFrame([(5,), (6,)], "key long"))
    plan = known._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.key for r in known.collect()} == {5, 6} and "kb#" in filters and ("IN (" in filters or " = " in filters)


def test_large_segments_hold_whole_ranges_in_order(spark, asked, tmp_path, monkeypatch):
    """Texts and terms were shuffled by key, by folder and by range, and what a batch staged for itself stayed."""
    monkeypatch.setattr(lexical, "RANGE", 2)
    monkeypatch.setattr(incremental, "FILE_DOCS", 2)
    plans: dict[str, list[str]] = {}
    stage = Transaction.stage

    def noted(self, rows, name, *more, **options):
        plans.setdefault(name, []).append(rows._jdf.queryExecution().executedPlan().toString())
        return stage(self, rows, name, *more, **options)

    monkeypatch.setattr(Transaction, "stage", noted)
    rng = random.Random(9)
    rows = {k: text(rng) for k in range(400)}
    index = LexicalIndex(spark, f"file://{tmp_path}/index")
    index.apply(spark.createDataFrame([*rows.items(), (1, rows[1])], SCHEMA).repartition(3))
    put = {k: text(rng) for k in range(0, 500, 3)} | {1: rows[1], 2: ""}
    same = sum(rows.get(k) == t for k, t in put.items())
    assert index.apply(spark.createDataFrame(list(put.items()), SCHEMA), spark.createDataFrame([(k,) for k in (4, 5, 900)], "key long")) == {"new": 33, "modified": 136 - same, "unchanged": same, "deleted": 2}
    rows = {k: t for k, t in rows.items() if k not in (4, 5)} | put
    assert all("each" in s for s in index.segments()) and hits(index.search(asked, "q", "t", 7)) == fresh(spark, rows, asked)
    index.compact()
    blocks = index.index().blocks
    assert blocks.groupBy("rng", "term").count().where("count > 1").count() == 0 and blocks.select("rng").distinct().count() > incremental.FOLDERS
    assert hits(index.search(asked, "q", "t", 7)) == fresh(spark, rows, asked) and index.store.manifest()["n_docs"] == len(rows)
    assert [p.count("Exchange hashpartitioning") for p in plans["blocks"]] == [0] * 3
    assert all(p.count("Exchange hashpartitioning(kb") == p.count("Exchange") - p.count("BroadcastExchange") - p.count("RoundRobin") == 1 for p in plans["docs"]), plans["docs"]
    assert not [*tmp_path.rglob("data/*/batch"), *tmp_path.rglob("data/*/changes")]


def test_few_but_the_keys_among_others_pass(spark):
    keys = spark.range(0, 9000, 9).withColumnRenamed("id", "key")
    got = {r.key for r in incremental.among(spark.range(9000).withColumnRenamed("id", "key"), keys).collect()}
    assert got >= set(range(0, 9000, 9)) and len(got) < 1010


class Stop(Exception):
    pass


def test_stopped_at_every_step(spark, asked, tmp_path):
    """Whatever step a batch stops at, readers see the old rows, and after recovery the old ones or, once prepared, the new."""
    old = {1: "pump w1", 2: "valve w2", 3: "leak"}
    new = {1: "pump w1", 2: "P-203 pump", 4: "leak pump"}
    steps: list[str] = []
    probe = LexicalIndex(spark, f"file://{tmp_path}/probe")
    probe.apply(spark.createDataFrame(list(old.items()), SCHEMA))
    probe.store.on_step = steps.append
    probe.apply(spark.createDataFrame(list(new.items()), SCHEMA), spark.createDataFrame([(3,)], "key long"))
    assert steps[0] == "began" and steps[-4:] == ["prepared", "write manifest", "rename manifest", "done"] and len(steps) >= 10
    before, after = fresh(spark, old, asked), fresh(spark, new, asked)
    for at in ("began", "stage docs", "stage gone", "prepared", "write manifest", "rename manifest", "done"):
        path = f"file://{tmp_path}/{at.replace(' ', '-')}"
        LexicalIndex(spark, path).apply(spark.createDataFrame(list(old.items()), SCHEMA))

        def stop(step, at=at):
            if step == at:
                raise Stop

        index = LexicalIndex(spark, path, stop)
        with pytest.raises(Stop):
            index.apply(spark.createDataFrame(list(new.items()), SCHEMA), spark.createDataFrame([(3,)], "key long"))
        assert hits(LexicalIndex(spark, path).search(asked, "q", "t", 7)) == (after if at == "done" else before)
        again = LexicalIndex(spark, path)
        told = again.store.recover()
        forward = at in ("write manifest", "rename manifest", "done")
        assert set(told.values()) == ({"carried forward"} if forward else {"rolled back"} if at != "began" else set())
        assert hits(again.search(asked, "q", "t", 7)) == (after if forward else before)
        assert again.store.recover() == {}


def test_old_versions_and_unused_data(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    held = []
    for i in range(3):
        tx = store.begin()
        tx.stage(spark.createDataFrame([(i,)], "x int"), "t")
        held = [tx.tx]
        assert tx.commit({"transactions": held, "x": i}) == i + 1
    assert store.manifest()["x"] == 2 and store.manifest(1)["x"] == 0
    lost = store.begin()
    lost.stage(spark.createDataFrame([(9,)], "x int"), "t")
    assert store.recover() == {lost.tx: "rolled back"}
    assert len(store.remove_unused()) == 2 and store.version() == 3 and store.files.names("data") == held


def test_lists(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(12, 16))
    made = np.concatenate([m + 0.3 * rng.normal(size=(60, 16)) for m in middle])
    rows = [(i, v.tolist()) for i, v in enumerate(made)] + [(9000, None), (9001, made[0].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    monkeypatch.setattr(vectors, "PART", 50)
    path = f"file://{tmp_path}/lists"
    vectors.build_lists(df, "id", "v", path)
    queries = df.where("id % 40 = 0")
    want = {(r.query_id, r.id): r.rank for r in vectors.nearest(df, queries, "id", "v", 6, digits=6).collect()}
    exact = {(r.query_id, r.id): r.rank for r in vectors.search_lists(spark, path, queries, "id", "v", 6, exact=True, digits=6).collect()}
    some = {(r.query_id, r.id) for r in vectors.search_lists(spark, path, queries, "id", "v", 6, digits=6).collect()}
    assert exact == want and len(some & set(want)) >= 0.95 * len(want)
    probes = spark.read.parquet(f"{path}/settings").first().probes
    assert probes < spark.read.parquet(f"{path}/centroids").count() / 2 and spark.read.parquet(f"{path}/lists").count() == 721
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 100)  # queries dealt out by a shuffle
    dealt = {(r.query_id, r.id): r.rank for r in vectors.nearest(df, queries, "id", "v", 6, digits=6).collect()}
    assert dealt == want
    vectors.build_lists(df.where("id < 0"), "id", "v", f"{path}-none")
    assert vectors.search_lists(spark, f"{path}-none", queries, "id", "v").count() == 0


def test_points_are_indexed_as_a_transaction(spark, tmp_path):
    """Kinds of change, rejected points, collections that are left alone, and a stop before the rename."""
    from quarry.operators import indexing

    schema = "chunk_id string, document_id string, document_name string, plant_unit string, section string, category string, equipment array<string>, standards array<string>, content string, vector array<double>"

    def points(rows):
        return spark.createDataFrame([(i, "d", name, None, None, None, [], [], text, v) for i, name, text, v in rows], schema)

    unit = [0.6, 0.8]
    first = [("a", "manual", "one", unit), ("b", "drawing", "two", unit), ("c", "sop", "three", unit)]
    store = Store(spark, f"file://{tmp_path}/points")
    assert indexing.index_points(store, points(first), 2) == {"new": 3, "rejected": 0}
    before = store.manifest()["collections"]
    second = [("a", "manual", "one", unit), ("b", "email", "two", unit), ("d", "manual", "four", unit), ("e", "manual", "five", [1.0]), ("f", "manual", "six", [3.0, 4.0]), ("", "manual", "none", unit)]

    def stop(step):
        if step == "rename manifest":
            raise Stop

    with pytest.raises(Stop):
        indexing.index_points(Store(spark, store.path, stop), points(second), 2)
    assert {r.chunk_id: r.collection for r in indexing.stored_points(store).collect()} == {"a": "refinery_manuals", "b": "refinery_drawings", "c": "refinery_sops"}
    # the batch had been prepared, so the next carries it forward first
    assert indexing.index_points(store, points(second), 2) == {"unchanged": 3, "rejected": 3}
    after = store.manifest()["collections"]
    assert {r.chunk_id: r.collection for r in indexing.stored_points(store).collect()} == {"a": "refinery_manuals", "b": "refinery_emails", "c": "refinery_sops", "d": "refinery_manuals"}
    assert after["refinery_sops"] == before["refinery_sops"] and "refinery_drawings" not in after
    assert indexing.index_points(store, points(second[:1]), 2, complete=True) == {"unchanged": 1, "deleted": 3, "rejected": 0}
    assert [r.chunk_id for r in indexing.stored_points(store).collect()] == ["a"]
